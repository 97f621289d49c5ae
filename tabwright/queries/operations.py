"""Queries over job, scaling, cache and project tables, mapped from the test tables."""

from pyspark.sql import functions as F

from tabwright.functions.clock import moment
from tabwright.operators import cache as ca
from tabwright.operators import jobs as jb
from tabwright.operators import projects as pj
from tabwright.operators import scaling as sc
from tabwright.queries import fixtures as fx
from tabwright.queries.registry import query

NOW = "2024-01-31 00:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"

# event types stand for job states (fixed values of this fixture)
_STATES = {"signup": "pending", "view": "running", "purchase": "completed", "error": "failed", "click": "cancelled"}
_STATE_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _STATES.items()) + " END"
JOBS_SQL = f"""jobs AS (
  SELECT event_id AS job_id, user_id % 3 AS type, {_STATE_SQL} AS status, user_id % 4 AS priority,
         ts AS created_at, user_id % 2 AS pool, value AS duration FROM events)"""


def state():
    column = None
    for event_type, name in _STATES.items():
        match = F.col("event_type") == event_type
        column = F.when(match, name) if column is None else column.when(match, name)
    return column


def jobs(t):
    return t.events.select(
        F.col("event_id").alias("job_id"),
        (F.col("user_id") % 3).alias("type"),
        state().alias("status"),
        (F.col("user_id") % 4).alias("priority"),
        F.col("ts").alias("created_at"),
        (F.col("user_id") % 2).alias("pool"),
        F.col("value").alias("duration"),
    )


@query("ops_pending_order", """
SELECT o_orderkey AS job_id, o_orderstatus AS status, CAST(left(o_orderpriority, 1) AS INT) AS priority,
       o_orderdate AS created_at
FROM orders WHERE o_orderstatus = 'P' ORDER BY priority DESC, created_at, job_id""")
def pending_order(t):
    queue = t.orders.select(
        F.col("o_orderkey").alias("job_id"),
        F.when(F.col("o_orderstatus") == "P", jb.PENDING).alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.col("o_orderdate").alias("created_at"),
    )
    return jb.pending_order(queue).withColumn("status", F.lit("P"))


@query("ops_latest", f"WITH {JOBS_SQL} SELECT * FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 50")
def latest(t):
    return jb.latest_jobs(jobs(t), 50)


@query("ops_latest_by_type", f"""
WITH {JOBS_SQL} SELECT * FROM jobs
QUALIFY row_number() OVER (PARTITION BY type ORDER BY created_at DESC, job_id DESC) <= 20""")
def latest_by_type(t):
    return jb.latest_by_type(jobs(t), limit=20)


@query("ops_job_state", f"""
WITH log AS (SELECT user_id AS job_id, {_STATE_SQL} AS status, ts, event_id FROM events)
SELECT job_id, arg_max(status, (ts, event_id)) AS status,
       min(ts) FILTER (WHERE status = 'pending') AS created_at,
       min(ts) FILTER (WHERE status = 'running') AS started_at,
       max(ts) FILTER (WHERE status IN ('completed', 'failed', 'cancelled')) AS completed_at,
       count(*) AS changes
FROM log GROUP BY job_id""")
def job_state(t):
    log = t.events.select(F.col("user_id").alias("job_id"), state().alias("status"), "ts", "event_id")
    return jb.job_state(log)


@query("ops_queue_status", f"""
WITH {JOBS_SQL}
SELECT count(*) FILTER (WHERE status = 'pending') AS queue_length,
       count(*) FILTER (WHERE status = 'running') AS running_jobs,
       count(*) FILTER (WHERE status = 'completed') AS completed_jobs,
       count(*) FILTER (WHERE status = 'failed') AS failed_jobs, count(*) AS total_jobs FROM jobs""")
def queue_status(t):
    return jb.queue_status(jobs(t))


@query("ops_success_rate", f"""
WITH {JOBS_SQL}
SELECT CAST(round(100.0 * count(*) FILTER (WHERE status = 'completed') / count(*)) AS BIGINT) AS success_rate,
       CAST(round(100.0 * count(*) FILTER (WHERE status = 'failed') / count(*)) AS BIGINT) AS failure_rate
FROM jobs""")
def success_rate(t):
    return jb.success_rate(jobs(t))


@query("ops_avg_execution", f"""
WITH {JOBS_SQL}
SELECT pool, count(duration) AS processed, round(avg(duration), 4) AS average_execution FROM jobs GROUP BY pool""")
def avg_execution(t):
    return fx.rounded(jb.average_execution(jobs(t)), ["average_execution"])


@query("ops_running_avg_execution", f"""
WITH {JOBS_SQL}
SELECT job_id, pool, round(1e-9 + avg(duration) OVER (PARTITION BY pool ORDER BY created_at, job_id
                                                      ROWS UNBOUNDED PRECEDING), 4) AS average_execution
FROM jobs""")
def running_avg_execution(t):
    # short means end in exact halves, which the two engines round differently without the nudge
    found = jb.running_average_execution(jobs(t))
    found = found.withColumn("average_execution", F.col("average_execution") + 1e-9)
    return fx.rounded(found, ["average_execution"]).select("job_id", "pool", "average_execution")


@query("ops_expire_jobs", f"""
WITH {JOBS_SQL} SELECT * FROM jobs
WHERE NOT (status IN ('completed', 'failed') AND created_at < {NOW_SQL} - INTERVAL 24 HOUR)""")
def expire_jobs(t):
    return jb.expire_jobs(jobs(t), NOW, 24)


SCALING_SQL = """scaling AS (
  SELECT user_id % 2 AS pool, event_id, ts, CASE WHEN event_id % 2 = 0 THEN 'up' ELSE 'down' END AS direction
  FROM events)"""


def scaling(t):
    return t.events.select(
        (F.col("user_id") % 2).alias("pool"),
        "event_id",
        "ts",
        F.when(F.col("event_id") % 2 == 0, "up").otherwise("down").alias("direction"),
    )


@query("ops_scaling_history", f"""
WITH {SCALING_SQL} SELECT * FROM scaling WHERE ts > {NOW_SQL} - INTERVAL 24 HOUR""")
def scaling_history(t):
    return sc.scaling_history(scaling(t), NOW, 24)


@query("ops_scaling_totals", f"""
WITH {SCALING_SQL}
SELECT pool, count(*) FILTER (WHERE direction = 'up') AS scale_ups,
       count(*) FILTER (WHERE direction = 'down') AS scale_downs,
       max(ts) FILTER (WHERE direction = 'up') AS last_scale_up,
       max(ts) FILTER (WHERE direction = 'down') AS last_scale_down
FROM scaling GROUP BY pool""")
def scaling_totals(t):
    return sc.scaling_totals(scaling(t))


@query("ops_scaling_recent", f"""
WITH {SCALING_SQL} SELECT * FROM scaling
QUALIFY row_number() OVER (PARTITION BY pool ORDER BY ts DESC, event_id DESC) <= 50""")
def scaling_recent(t):
    return sc.recent_events(scaling(t))


_EFFICIENCY_SQL = f"""{SCALING_SQL},
recent AS (SELECT * FROM scaling QUALIFY row_number() OVER (PARTITION BY pool ORDER BY ts DESC, event_id DESC) <= 10),
ahead AS (SELECT *, lead(direction) OVER w AS nxt, lead(direction, 2) OVER w AS aft, lead(ts, 2) OVER w AS ts2
          FROM recent WINDOW w AS (PARTITION BY pool ORDER BY ts, event_id)),
judged AS (
  SELECT pool, count(*) AS events,
         count(*) FILTER (WHERE direction <> nxt AND direction = aft AND ts2 - ts < INTERVAL 5 MINUTE) AS oscillations
  FROM ahead GROUP BY pool),
eff AS (SELECT *, CASE WHEN events < 2 THEN 1 ELSE greatest(0, 1 - oscillations / events) END AS efficiency
        FROM judged)"""


@query("ops_scaling_efficiency", f"""
WITH {_EFFICIENCY_SQL}
SELECT pool, events, oscillations, round(efficiency, 4) AS efficiency,
       CASE WHEN events < 2 THEN 'not enough data'
            WHEN efficiency < 0.7 THEN 'frequent oscillations, check the limits'
            WHEN efficiency < 0.9 THEN 'occasional oscillations, watch performance'
            ELSE 'stable scaling' END AS analysis
FROM eff""")
def scaling_efficiency(t):
    return fx.rounded(sc.scaling_efficiency(scaling(t)), ["efficiency"])


@query("ops_stability", f"""
WITH {_EFFICIENCY_SQL}
SELECT round(avg(efficiency), 4) AS average_efficiency,
       CASE WHEN avg(efficiency) > 0.9 THEN 'Excellent' WHEN avg(efficiency) > 0.8 THEN 'Good'
            WHEN avg(efficiency) > 0.7 THEN 'Fair' ELSE 'Needs Attention' END AS stability
FROM eff""")
def stability(t):
    return fx.rounded(sc.stability(sc.scaling_efficiency(scaling(t))), ["average_efficiency"])


@query("ops_utilization", """
WITH load AS (
  SELECT user_id AS pool, count(*) % 6 AS active_workers,
         least(count(*) % 6, count(*) FILTER (WHERE event_type = 'view')) AS busy_workers,
         count(*) FILTER (WHERE event_type = 'signup') % 3 AS queue_length
  FROM events GROUP BY user_id),
used AS (SELECT *, CASE WHEN active_workers = 0 THEN 0 ELSE busy_workers / active_workers END AS u FROM load)
SELECT pool, active_workers, busy_workers, queue_length, round(u, 4) AS utilization,
       CASE WHEN active_workers = 0 THEN 'no active workers'
            WHEN u > 0.8 AND queue_length > 0 THEN 'scale up'
            WHEN u < 0.3 AND queue_length = 0 THEN 'scale down possible'
            WHEN u > 0.9 THEN 'high load, more workers needed' ELSE 'optimal' END AS recommendation
FROM used""")
def utilization(t):
    load = t.events.groupBy(F.col("user_id").alias("pool")).agg(
        (F.count(F.lit(1)) % 6).alias("active_workers"),
        F.least(F.count(F.lit(1)) % 6, F.count_if(F.col("event_type") == "view")).alias("busy_workers"),
        (F.count_if(F.col("event_type") == "signup") % 3).alias("queue_length"),
    )
    return fx.rounded(sc.utilization(load), ["utilization"])


_META_SQL = """meta AS (
  SELECT c_custkey AS project_id, sha256(c_name) AS project_hash,
         TIMESTAMP '2023-12-01' + to_minutes(c_custkey * 7) AS created_at,
         CASE WHEN c_custkey % 9 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(c_custkey % 700) END AS last_used
  FROM customer),
files AS (
  SELECT c_custkey AS project_id, 'script' AS kind, CAST(floor(abs(c_acctbal) * 100) AS BIGINT) AS size
  FROM customer WHERE c_custkey % 5 <> 0
  UNION ALL SELECT c_custkey, 'encoder', CAST(c_nationkey * 1000 AS BIGINT) FROM customer WHERE c_custkey % 2 = 0),
status AS (
  SELECT m.project_id, created_at, last_used, s.size IS NOT NULL AS script_exists, e.size IS NOT NULL AS encoder_exists,
         coalesce(s.size, 0) + coalesce(e.size, 0) AS total_size, left(project_hash, 8) || '...' AS hash,
         CAST(round(epoch(TIMESTAMP '2024-01-31' - coalesce(last_used, created_at)) / 3600) AS BIGINT) AS age_hours
  FROM meta m LEFT JOIN files s ON s.project_id = m.project_id AND s.kind = 'script'
              LEFT JOIN files e ON e.project_id = m.project_id AND e.kind = 'encoder')"""


def meta(t):
    key = F.col("c_custkey")
    start = lambda text: F.unix_date(F.lit(text).cast("date")) * F.lit(86400)
    at = lambda seconds: (F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds))
    return t.customer.select(
        key.alias("project_id"),
        F.sha2("c_name", 256).alias("project_hash"),
        at(start("2023-12-01") + key * 7 * 60).alias("created_at"),
        F.when(key % 9 != 0, at(start("2024-01-01") + key % 700 * 3600)).alias("last_used"),
    )


def files(t):
    key = F.col("c_custkey")
    scripts = t.customer.filter(key % 5 != 0).select(
        key.alias("project_id"), F.lit("script").alias("kind"), F.floor(F.abs("c_acctbal") * 100).alias("size")
    )
    encoders = t.customer.filter(key % 2 == 0).select(
        key.alias("project_id"), F.lit("encoder").alias("kind"), (F.col("c_nationkey") * 1000).cast("long").alias("size")
    )
    return scripts.unionByName(encoders)


@query("ops_cache_status", f"WITH {_META_SQL} SELECT * FROM status")
def cache_status(t):
    return ca.cache_status(meta(t), files(t), NOW)


@query("ops_cache_totals", f"""
WITH {_META_SQL}
SELECT count(*) AS total_metadata, count(*) FILTER (WHERE script_exists) AS total_scripts,
       count(*) FILTER (WHERE encoder_exists) AS total_encoders,
       CAST(coalesce(sum(total_size), 0) AS BIGINT) AS total_size_bytes,
       round(CAST(coalesce(sum(total_size), 0) AS DOUBLE) / 1048576, 2) AS total_size_mb
FROM status""")
def cache_totals(t):
    return ca.cache_totals(ca.cache_status(meta(t), files(t), NOW))


@query("ops_expire_cache", f"""
WITH {_META_SQL}
SELECT project_id FROM meta WHERE coalesce(last_used, created_at) < {NOW_SQL} - INTERVAL 168 HOUR""")
def expire_cache(t):
    return ca.expire_cache(meta(t), NOW)


_FINGERPRINT = """sha256('{{"algorithm":"' || {segment} || '","id":' || c_custkey
  || ',"model_path":' || CASE WHEN c_custkey % 4 = 0 THEN 'null' ELSE '"' || c_name || '"' END || '}}')"""
_SEGMENT_NOW = "CASE WHEN c_custkey % 6 = 0 THEN 'other' ELSE c_mktsegment END"


def _projects(t, segment):
    return t.customer.select(
        F.col("c_custkey").alias("id"),
        segment.alias("algorithm"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("model_path"),
    )


_FIELDS = ["id", "model_path", "algorithm"]


@query("ops_fingerprint", f"SELECT c_custkey AS id, {_FINGERPRINT.format(segment='c_mktsegment')} AS fingerprint FROM customer")
def fingerprint(t):
    return pj.fingerprint(_projects(t, F.col("c_mktsegment")), "id", _FIELDS)


@query("ops_changed", f"""
WITH stored AS (SELECT c_custkey AS id, {_FINGERPRINT.format(segment='c_mktsegment')} AS old FROM customer
                WHERE c_custkey % 10 <> 0),
cur AS (SELECT c_custkey AS id, {_FINGERPRINT.format(segment=_SEGMENT_NOW)} AS new FROM customer)
SELECT id FROM cur LEFT JOIN stored USING (id) WHERE new IS DISTINCT FROM old""")
def changed(t):
    segment = F.when(F.col("c_custkey") % 6 == 0, "other").otherwise(F.col("c_mktsegment"))
    stored = pj.fingerprint(_projects(t, F.col("c_mktsegment")), "id", _FIELDS).filter(F.col("id") % 10 != 0)
    return pj.changed(pj.fingerprint(_projects(t, segment), "id", _FIELDS), stored, "id")


_CHANGES_SQL = """changes AS (
  SELECT user_id AS id, ts, event_id,
         CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS op,
         CASE WHEN event_id % 2 = 0 THEN event_type END AS status,
         CASE WHEN event_id % 3 = 0 THEN value END AS score
  FROM events)"""


def changes(t):
    kind, ident = F.col("event_type"), F.col("event_id")
    return t.events.select(
        F.col("user_id").alias("id"),
        "ts",
        "event_id",
        F.when(kind == "error", "delete").when(kind == "signup", "insert").otherwise("update").alias("op"),
        F.when(ident % 2 == 0, kind).alias("status"),
        F.when(ident % 3 == 0, F.col("value")).alias("score"),
    )


@query("ops_upsert_current", f"""
WITH {_CHANGES_SQL},
gone AS (SELECT *, max(CASE WHEN op = 'delete' THEN (ts, event_id) END) OVER (PARTITION BY id) AS d FROM changes),
alive AS (SELECT * FROM gone WHERE op <> 'delete' AND (d IS NULL OR (ts, event_id) > d)),
born AS (SELECT *, min(CASE WHEN op = 'insert' THEN (ts, event_id) END) OVER (PARTITION BY id) AS b FROM alive)
SELECT id, arg_max(status, (ts, event_id)) FILTER (WHERE status IS NOT NULL) AS status,
       arg_max(score, (ts, event_id)) FILTER (WHERE score IS NOT NULL) AS score, count(*) AS versions
FROM born WHERE b IS NOT NULL AND (ts, event_id) >= b GROUP BY id""")
def upsert(t):
    return pj.current_projects(changes(t), ["status", "score"], ["ts", "event_id"])


@query("ops_list_projects", """
SELECT event_id AS id, ts AS created_at, CAST(json_extract_string(props, '$.k') AS INT) AS k
FROM events ORDER BY ts DESC, event_id""")
def list_projects(t):
    projects = t.events.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "props")
    return pj.list_projects(projects, {"props": "k int"}).select("id", "created_at", "props.k")


@query("ops_get_project", """
SELECT event_id AS id, ts AS created_at, props FROM events WHERE event_id = 77""")
def get_project(t):
    projects = t.events.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "props")
    return pj.get_project(projects, 77)
