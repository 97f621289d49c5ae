"""Prediction monitoring queries."""

from pyspark.sql import functions as F

from tabwright.operators import monitor as mo
from tabwright.queries import fixtures as fx
from tabwright.queries.registry import query

FEATURES = ["value", "k"]

BASE_SQL = f"""base AS (
  SELECT avg(value) AS mv, stddev_samp(value) AS sv, avg(k) AS mk, stddev_samp(k) AS sk
  FROM ev WHERE ts < TIMESTAMP '{fx.CUTOFF}')"""

_RUNNING_SQL = f"""{fx.EVENTS_SQL}, {BASE_SQL},
means AS (
  SELECT ev.*, avg(value) OVER w AS rv, avg(k) OVER w AS rk FROM ev
  WINDOW w AS (PARTITION BY project ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
scored AS (
  SELECT means.*, CASE WHEN rk IS NULL THEN least(abs(rv - mv) / sv, 10)
         ELSE (least(abs(rv - mv) / sv, 10) + least(abs(rk - mk) / sk, 10)) / 2 END AS raw_score
  FROM means, base)"""

_ROLLING_SQL = f"""{fx.EVENTS_SQL},
rolled AS (
  SELECT project, event_id, ts,
         CASE WHEN truth IS NOT NULL THEN round(sqrt(avg((prediction - truth) ^ 2) OVER w), 4) END AS rolling_rmse,
         CASE WHEN true_type IS NOT NULL
              THEN round(avg((predicted_type = true_type)::INT) OVER w, 4) END AS rolling_accuracy
  FROM ev WINDOW w AS (PARTITION BY project ORDER BY ts, event_id ROWS 499 PRECEDING))"""


def base_stats(t):
    return mo.baseline(fx.before_cutoff(fx.flat_events(t)), FEATURES)


def events(t):
    return fx.with_features(fx.flat_events(t))


def typed_events(t):
    return events(t).drop("prediction", "truth").withColumnsRenamed(
        {"predicted_type": "prediction", "true_type": "truth"}
    )


@query("mon_baseline", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, count({c}) AS n "
    "FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def baseline(t):
    return fx.rounded(mo.baseline(t.lineitem, ["l_quantity", "l_discount", "l_tax"]), ["mean", "std"])


@query("mon_feature_stats", f"""
WITH {fx.EVENTS_SQL},
long AS (SELECT project, 'value' AS feature, value AS v FROM ev UNION ALL SELECT project, 'k', k FROM ev)
SELECT project, feature, count(v) AS n, round(avg(v), 4) AS mean, round(coalesce(stddev_samp(v), 0), 4) AS std
FROM long WHERE v IS NOT NULL GROUP BY project, feature""")
def feature_stats(t):
    return fx.rounded(mo.feature_stats(events(t)), ["mean", "std"])


@query("mon_drift_score", f"""
WITH {fx.EVENTS_SQL}, {BASE_SQL}
SELECT project, round((least(abs(avg(value) - any_value(mv)) / any_value(sv), 10)
                       + least(abs(avg(k) - any_value(mk)) / any_value(sk), 10)) / 2, 3) AS drift_score
FROM ev, base WHERE ts >= TIMESTAMP '{fx.CUTOFF}' GROUP BY project""")
def drift_score(t):
    live = mo.feature_stats(fx.from_cutoff(events(t)))
    return mo.drift_score(base_stats(t), live).drop("raw_score")


@query("mon_running_drift", f"""
WITH {_RUNNING_SQL}
SELECT project, event_id, ts, round(raw_score, 3) AS drift_score FROM scored""")
def running_drift(t):
    return mo.running_drift(events(t), base_stats(t)).select("project", "event_id", "ts", "drift_score")


_ALERTS_SQL = f"""{_RUNNING_SQL},
alerts AS (
  SELECT project, event_id, ts, 'warning' AS severity, 'DRIFT_DETECTED' AS code, round(raw_score, 3) AS drift_score,
         row_number() OVER (PARTITION BY project ORDER BY ts DESC, event_id DESC) AS r
  FROM scored WHERE raw_score >= 3)"""


def alerts(t):
    return mo.latest_alerts(mo.drift_alerts(mo.running_drift(events(t), base_stats(t))))


@query("mon_alerts", f"""
WITH {_ALERTS_SQL}
SELECT project, event_id, ts, severity, code, drift_score FROM alerts WHERE r <= 1000""")
def drift_alerts(t):
    return alerts(t).select("project", "event_id", "ts", "severity", "code", "drift_score")


@query("mon_rolling_rmse", f"WITH {_ROLLING_SQL} SELECT project, event_id, ts, rolling_rmse FROM rolled")
def rolling_rmse(t):
    return mo.rolling_rmse(events(t)).select("project", "event_id", "ts", "rolling_rmse")


@query("mon_rolling_accuracy", f"WITH {_ROLLING_SQL} SELECT project, event_id, ts, rolling_accuracy FROM rolled")
def rolling_accuracy(t):
    return mo.rolling_accuracy(typed_events(t)).select("project", "event_id", "ts", "rolling_accuracy")


@query("mon_status", f"""
WITH {_ALERTS_SQL}, rolled AS (
  SELECT project, event_id, ts,
         CASE WHEN truth IS NOT NULL THEN round(sqrt(avg((prediction - truth) ^ 2) OVER w), 4) END AS rolling_rmse
  FROM ev WINDOW w AS (PARTITION BY project ORDER BY ts, event_id ROWS 499 PRECEDING)),
listed AS (SELECT project, count(*) AS alerts_shown, max(event_id) AS newest_alert FROM alerts WHERE r <= 50 GROUP BY 1)
SELECT project, count(*) AS recent_count,
       arg_max(rolling_rmse, (ts, event_id)) FILTER (WHERE rolling_rmse IS NOT NULL) AS rolling_rmse,
       arg_max(round(raw_score, 3), (ts, event_id)) AS drift_score,
       coalesce(any_value(alerts_shown), 0) AS alerts_shown, any_value(newest_alert) AS newest_alert
FROM scored JOIN rolled USING (project, event_id, ts) LEFT JOIN listed USING (project) GROUP BY project""")
def status(t):
    scored = mo.scored_events(events(t), base_stats(t))
    found = mo.monitor_status(scored, mo.drift_alerts(scored))
    return found.select(
        "project",
        "recent_count",
        "rolling_rmse",
        "drift_score",
        F.coalesce(F.size("alerts"), F.lit(0)).cast("long").alias("alerts_shown"),
        F.array_max("alerts.event_id").alias("newest_alert"),
    )
