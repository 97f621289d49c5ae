"""Text queries.  The texts are built from table columns, the same way on both sides."""

from pyspark.sql import functions as F

from tabwright.functions import text as tx
from tabwright.operators import texts as op
from tabwright.queries import fixtures as fx
from tabwright.queries.registry import query


def built(df, sql: str, name: str = "text"):
    """A text column from an expression both engines read alike."""
    return df.withColumn(name, F.expr(sql))


LOG = """concat('Train done. Accuracy: 0.', l_linenumber, ' RMSE: ', CAST(l_quantity AS INT), '.5 r2: -0.', l_linenumber,
  CASE WHEN l_linenumber % 2 = 0 THEN ' MSE: 12.25 F1 Score: 0.5' ELSE ' F1-Score: 0.75 mae:3' END,
  CASE WHEN l_linenumber = 3 THEN ' Precision: 1.2.3' ELSE ' Precision: .5 Accuracy: 9' END)"""


@query("text_metrics", f"""
WITH logs AS (SELECT {fx.KEY_SQL}, {LOG} AS text FROM lineitem)
SELECT {fx.KEY_SQL}, """ + ", ".join(
    f"TRY_CAST(nullif(regexp_extract(text, '(?i)(?:^|[^A-Za-z0-9_])(?:{labels}):\\s*(-?[0-9.]+)', 1), '') AS DOUBLE) AS {name}"
    for name, labels in tx.METRIC_LABELS.items()) + " FROM logs")
def metrics(t):
    lines = t.lineitem.select(*fx.LINEITEM_KEY, "l_quantity")
    return op.extract_metrics(built(lines, LOG)).drop("text", "l_quantity")


ERR = """CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'ValueError in line 3' WHEN 3 THEN 'warning only'
  WHEN 4 THEN 'called sys.exit(1) now' WHEN 5 THEN 'Traceback (most recent)' ELSE 'exit 1' END"""


@query("text_has_error", f"""
WITH logs AS (SELECT {fx.KEY_SQL}, {ERR} AS stderr, CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END AS returncode
              FROM lineitem)
SELECT *, returncode <> 0 OR """ + " OR ".join(f"contains(stderr, '{w}')" for w in tx.ERROR_WORDS) + """ AS has_error
FROM logs""")
def errors(t):
    logs = built(t.lineitem, ERR, "stderr").select(
        *fx.LINEITEM_KEY, "stderr", F.when(F.col("l_partkey") % 10 == 0, 1).otherwise(0).alias("returncode")
    )
    return op.has_error(logs)


_OBJ = """concat('{"tool": "profile", "n": "', p_size, '", "k": "None", "brand": "', p_brand, '"}')"""
JSON_TEXT = f"""CASE p_partkey % 7
  WHEN 0 THEN concat('Here it is:\n```json\n', {_OBJ}, '\n```\nDone.')
  WHEN 1 THEN concat('The answer is ', {_OBJ}, ' as asked')
  WHEN 2 THEN concat('first {{ oops\n', {_OBJ}, '\nlast')
  WHEN 3 THEN concat('{{"tool": "profile", "n": "', p_size, '", "k": "None", "bran')
  WHEN 4 THEN concat('{{{{"tool": "profile", "n": "', p_size, '", "k": "None"}}}}')
  WHEN 5 THEN {_OBJ}
  ELSE concat('no object in ', p_name) END""".replace("{{", "{").replace("}}", "}")
_TEXTS_SQL = f"texts AS (SELECT p_partkey, {JSON_TEXT} AS text FROM part)"
_BUILT = ["p_partkey", "text"]

_CASCADE_SQL = f"""{_TEXTS_SQL},
cleaned AS (SELECT p_partkey, replace(replace(text, '{{{{', '{{'), '}}}}', '}}') AS c FROM texts),
parts AS (
  SELECT p_partkey, c,
         regexp_extract(c, '(?s)```json\\s*(\\{{.*?\\}})\\s*```', 1) AS fenced,
         regexp_extract(c, '(?s)\\{{.*\\}}', 0) AS outermost,
         list_filter(string_split(c, chr(10)), lambda l: l[1] = '{{' AND l[-1] = '}}' AND json_valid(l))[1] AS line,
         regexp_extract(c, '(?s)\\{{.*', 0) AS tail
  FROM cleaned),
fixed AS (
  SELECT *, CASE WHEN tail <> '' THEN
      left(tail, length(tail) - strpos(reverse(tail), ',')) || '}}' END AS closed FROM parts),
found AS (
  SELECT p_partkey, coalesce(CASE WHEN json_valid(c) THEN c END,
      CASE WHEN fenced <> '' AND json_valid(fenced) THEN fenced END,
      CASE WHEN outermost <> '' AND json_valid(outermost) THEN outermost END,
      line, CASE WHEN closed IS NOT NULL AND json_valid(closed) THEN closed END) AS j FROM fixed)"""


def json_texts(t):
    return built(t.part, JSON_TEXT).select(*_BUILT)


@query("text_json_nested", """
SELECT p_partkey, '{"a":{"b":{"c":' || p_size || '}},"d":{"e":"{{' || p_brand || '}}"}}' AS json FROM part""")
def nested_json(t):
    """Valid objects stay as they are, whatever braces they hold."""
    text = F.concat(
        F.lit('{"a":{"b":{"c":'), F.col("p_size").cast("string"), F.lit('}},"d":{"e":"{{'), F.col("p_brand"), F.lit('}}"}}')
    )
    return t.part.select("p_partkey", tx.json_text(text).alias("json"))


@query("text_json", f"""
WITH {_CASCADE_SQL}
SELECT p_partkey, json_extract_string(j, '$.tool') AS tool, CAST(json_extract_string(j, '$.n') AS INT) AS n,
       json_extract_string(j, '$.brand') AS brand FROM found""")
def extract_json(t):
    got = op.extract_json(json_texts(t))
    return got.select(
        "p_partkey",
        F.try_variant_get("json", "$.tool", "string").alias("tool"),
        F.try_variant_get("json", "$.n", "int").alias("n"),
        F.try_variant_get("json", "$.brand", "string").alias("brand"),
    )


PARAMS = """concat('{"n": "', p_size, '", "depth": "None", "warm": "True", "cold": " False", "list": [', p_size,
  '], "pair": [1,2], "name": "', p_brand, '"}')"""


@query("text_json_normalize", """
SELECT p_partkey, CAST(p_size AS VARCHAR) AS n, CAST(NULL AS VARCHAR) AS depth, 'true' AS warm, 'false' AS cold,
       CAST(p_size AS VARCHAR) AS list, '[1,2]' AS pair, p_brand AS name FROM part""")
def normalize(t):
    maps = built(t.part, PARAMS).select("p_partkey", F.from_json("text", "map<string,string>").alias("m"))
    names = ["n", "depth", "warm", "cold", "list", "pair", "name"]
    return op.normalize_json(maps, "m").select("p_partkey", *[F.col("m")[c].alias(c) for c in names])


BROKEN = """CASE p_partkey % 4
  WHEN 0 THEN concat('{"a": ', p_size, ', "b": {"c": "', p_brand, '"')
  WHEN 1 THEN concat('{"a": ', p_size, ', "b": 2, "trunc')
  WHEN 2 THEN concat('{"a": ', p_size, '}')
  ELSE concat('[', p_size, ', {') END"""


@query("text_json_repair", f"""
WITH texts AS (SELECT p_partkey, {BROKEN} AS text FROM part),
counted AS (SELECT *, length(text) - length(replace(text, '{{', '')) - length(text) + length(replace(text, '}}', '')) AS missing,
            length(text) - strpos(reverse(text), ',') AS comma, length(text) - strpos(reverse(text), ':') AS colon FROM texts),
closed AS (SELECT *, CASE WHEN comma > colon AND comma > length(text) - 100 THEN left(text, comma) ELSE text END
                     || repeat('}}', greatest(missing, 0)) AS fixed FROM counted)
SELECT p_partkey, text, CASE WHEN text[1] = '{{' AND missing > 0 AND json_valid(fixed) THEN fixed END AS repaired
FROM closed""")
def repair(t):
    return op.repair_json(built(t.part, BROKEN).select(*_BUILT))


TALK = """CASE turn % 5
  WHEN 0 THEN concat('<think>', role, '</think> ', text, ' <THINK>again</THINK>')
  WHEN 1 THEN concat('[THINKING]', role, turn, '[/THINKING]', text)
  WHEN 2 THEN concat('Reasoning: because ', role, ' Answer: ', text)
  WHEN 3 THEN concat('Step by step: ', role, ' Final Answer: ', role)
  ELSE concat('  ', text, '  ') END"""


def _trim_sql(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@query("text_reasoning", f"""
WITH texts AS (SELECT conv_id, turn, {TALK} AS text FROM conversations),
tagged AS (
  SELECT *, array_to_string(regexp_extract_all(text, '(?is)<think>(.*?)</think>', 1), chr(10) || chr(10)) AS a,
         array_to_string(regexp_extract_all(text, '(?is)\\[THINKING\\](.*?)\\[/THINKING\\]', 1), chr(10) || chr(10)) AS b,
         regexp_extract(text, '(?is)(?:Reasoning|Let me think|Step by step):(.*?)(?:Final Answer:|Answer:|$)', 1) AS c
  FROM texts)
SELECT conv_id, turn, {_trim_sql("CASE WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE c END")} AS thinking,
       {_trim_sql('''CASE WHEN a <> '' THEN regexp_replace(text, '(?is)<think>(.*?)</think>', '', 'g')
            WHEN b <> '' THEN regexp_replace(text, '(?is)\\[THINKING\\](.*?)\\[/THINKING\\]', '', 'g')
            WHEN c <> '' THEN regexp_extract(text, '(?is)(?:Answer|Final Answer):\\s*(.*)', 1) ELSE text END''')} AS result,
       a <> '' OR b <> '' OR c <> '' AS has_thinking
FROM tagged""")
def reasoning(t):
    talk = built(t.conversations.select("conv_id", "turn", "role", "text"), TALK, "said")
    return op.split_reasoning(talk.select("conv_id", "turn", "said"), "said").drop("said")


_CALL = """concat('{"tool": "drop_columns", "arguments": {"n": ', p_size, '}}')"""
CALLS = f"""CASE p_partkey % 5
  WHEN 0 THEN concat('Do this:\n```json\n', {_CALL}, '\n```\nthen\n```JSON\n[', {_CALL}, ', {{"tool": "filter_rows"}}, {{"x": 1}}]\n```')
  WHEN 1 THEN {_CALL}
  WHEN 2 THEN concat('[', {_CALL}, ', ', {_CALL}, ']')
  WHEN 3 THEN concat('```json\n{{"broken": \n```', p_brand)
  ELSE concat('nothing to call for ', p_name) END""".replace("{{", "{").replace("{{", "{")


@query("text_tool_calls", f"""
WITH texts AS (SELECT p_partkey, {CALLS} AS text FROM part),
blocks AS (SELECT p_partkey, text, regexp_extract_all(text, '(?i)```json\\s*(\\{{[\\s\\S]*?\\}}|\\[[\\s\\S]*?\\])\\s*```', 1) AS b
           FROM texts),
chosen AS (SELECT p_partkey, unnest(CASE WHEN len(b) > 0 THEN b ELSE [text] END) AS j,
                  generate_subscripts(CASE WHEN len(b) > 0 THEN b ELSE [text] END, 1) AS i FROM blocks),
items AS (SELECT p_partkey, i, unnest(CASE WHEN j[1] = '[' THEN CAST(j AS JSON[]) ELSE [CAST(j AS JSON)] END) AS item,
                 generate_subscripts(CASE WHEN j[1] = '[' THEN CAST(j AS JSON[]) ELSE [CAST(j AS JSON)] END, 1) AS k
          FROM chosen WHERE json_valid(j))
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i, k) - 1 AS INT) AS call,
       json_extract_string(item, '$.tool') AS tool, CAST(json_extract_string(item, '$.arguments.n') AS INT) AS n
FROM items WHERE json_extract_string(item, '$.tool') IS NOT NULL""")
def tool_calls(t):
    calls = op.extract_tool_calls(built(t.part, CALLS).select(*_BUILT))
    n = F.get_json_object("arguments", "$.n").cast("int")
    return calls.select("p_partkey", "call", "tool", n.alias("n"))


FENCED = """concat('```python\nx = ', p_size, '\n# Output:\nprint(x)\n```\n', CASE WHEN p_partkey % 2 = 0 THEN '# Ausgabe:\n' ELSE '' END,
  p_name, '\n  ')"""


@query("text_strip_fences", f"""
WITH texts AS (SELECT p_partkey, {FENCED} AS text FROM part)
SELECT p_partkey, {_trim_sql('''regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '(?m)^\\s*```[\\w]*\\s*', '', 'g'), '(?m)\\s*```\\s*$', '', 'g'), '(?m)^\\s*# Output:\\s*$', '', 'g'),
  '(?m)^\\s*# Ausgabe:\\s*$', '', 'g')''')} AS text
FROM texts""")
def strip_fences(t):
    return op.strip_code_fences(built(t.part, FENCED).select(*_BUILT))


CODE = """CASE p_partkey % 8
  WHEN 0 THEN concat('x = eval(\\"', p_size, '\\")\nmodel.fit(x)')
  WHEN 1 THEN concat('try:\n  go()\nexcept:\n  pass\npassword = \\'', p_name, '\\'')
  WHEN 2 THEN concat('from sklearn import LogisticRegression, train_test_split\nm.fit(', p_size, ')')
  WHEN 3 THEN concat('while True:\n  print(', p_size, ')')
  WHEN 4 THEN concat('while True :\n  if x: break\n', repeat('print(1)\n', p_size % 9))
  WHEN 5 THEN concat('import os\nos.system(\\"ls\\")\nexec (', p_size, ')\npickle.load(f)\n__import__(\\"x\\")')
  WHEN 6 THEN concat('subprocess.call(cmd, shell = True)\nSVC() ; StandardScaler() ; model_params = {\\"n\\": ', p_size, '}')
  ELSE concat('clean = ', p_size) END"""
CODE_SQL = CODE.replace("\\'", "''").replace('\\"', '"')

_ISSUES_SQL = f"""codes AS (SELECT p_partkey, {CODE_SQL} AS text FROM part),
prints AS (SELECT *, len(regexp_extract_all(text, '\\bprint\\s*\\(')) AS n FROM codes),
issues AS (
""" + "\n".join(
    f"""  SELECT p_partkey, 'security' AS kind, 'security_risk' AS type, 'critical' AS severity, '{m}' AS message
  FROM prints WHERE regexp_matches(text, '{p}') UNION ALL""" for p, m in op.DANGEROUS) + """
  SELECT p_partkey, 'security', 'infinite_loop', 'high', 'Potential infinite loop detected (while True without break)'
  FROM prints WHERE regexp_matches(text, 'while\\s+True\\s*:') AND NOT contains(text, 'break')
  UNION ALL SELECT p_partkey, 'quality', 'hardcoded_credential', 'medium', 'Hardcoded password detected'
  FROM prints WHERE regexp_matches(text, '(?i)password\\s*=\\s*["'']')
  UNION ALL SELECT p_partkey, 'quality', 'bare_except', 'low', 'Bare except clause - should specify exception type'
  FROM prints WHERE contains(text, 'try:') AND contains(text, 'except:')
  UNION ALL SELECT p_partkey, 'quality', 'excessive_prints', 'low',
         'Excessive print statements (' || n || ') - consider using logging' FROM prints WHERE n > 5
  UNION ALL SELECT p_partkey, 'practice', 'missing_train_test_split', 'medium',
         'Model training without train-test split detected'
  FROM prints WHERE contains(text, 'fit(') AND NOT contains(text, 'train_test_split')
  UNION ALL SELECT p_partkey, 'practice', 'missing_scaling', 'medium', 'Algorithm may benefit from feature scaling'
  FROM prints WHERE regexp_matches(text, 'SVC|SVR|KNeighbors|LogisticRegression')
    AND NOT regexp_matches(text, 'StandardScaler|MinMaxScaler'))"""

_SCORES_SQL = f"""{_ISSUES_SQL},
scores AS (
  SELECT c.p_partkey,
         greatest(0, 10 - coalesce(sum(CASE WHEN kind = 'security' THEN CASE severity WHEN 'critical' THEN 3
           WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0.5 END END), 0))::DOUBLE AS security_score,
         greatest(0, 10 - coalesce(sum(CASE WHEN kind = 'quality' THEN CASE severity WHEN 'high' THEN 2
           WHEN 'medium' THEN 1 ELSE 0.5 END END), 0))::DOUBLE AS quality_score
  FROM codes c LEFT JOIN issues i ON i.p_partkey = c.p_partkey GROUP BY c.p_partkey)"""


def codes(t):
    return built(t.part, CODE).select(*_BUILT)


@query("text_code_issues", f"WITH {_ISSUES_SQL} SELECT * FROM issues")
def code_issues(t):
    return op.scan_code(codes(t))


@query("text_code_scores", f"WITH {_SCORES_SQL} SELECT * FROM scores")
def code_scores(t):
    return op.code_scores(codes(t))


@query("text_scores_from_issues", f"""
WITH {_SCORES_SQL} SELECT * FROM scores WHERE p_partkey IN (SELECT p_partkey FROM issues)""")
def scores_from_issues(t):
    return op.scores_from_issues(op.scan_code(codes(t)), "p_partkey")


def other_review(t):
    """A second opinion: one remark per text, of a type the rules know for some of them."""
    key = F.col("p_partkey")
    return t.part.select(
        key,
        F.lit("quality").alias("kind"),
        F.when(key % 2 == 0, "bare_except").when(key % 3 == 0, "security_risk").otherwise("style").alias("type"),
        F.when(key % 5 == 0, "high").otherwise("low").alias("severity"),
        F.lit("second opinion").alias("message"),
    )


_OTHER_SQL = """other AS (
  SELECT p_partkey, 'quality' AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'bare_except'
         WHEN p_partkey % 3 = 0 THEN 'security_risk' ELSE 'style' END AS type,
         CASE WHEN p_partkey % 5 = 0 THEN 'high' ELSE 'low' END AS severity, 'second opinion' AS message
  FROM part)"""


@query("text_merge_issues", f"""
WITH {_ISSUES_SQL}, {_OTHER_SQL}
SELECT * FROM issues UNION ALL
SELECT * FROM other o WHERE NOT EXISTS (SELECT 1 FROM issues i WHERE i.p_partkey = o.p_partkey AND i.type = o.type)""")
def merge_issues(t):
    return op.merge_issues(op.scan_code(codes(t)), other_review(t), "p_partkey")


@query("text_merge_scores", f"""
WITH {_SCORES_SQL}, {_OTHER_SQL},
second AS (SELECT p_partkey, 10.0 AS s, 10 - CASE severity WHEN 'high' THEN 2 ELSE 0.5 END AS q FROM other)
SELECT p_partkey, round(security_score * 0.6 + s * 0.4, 1) AS security_score,
       round(quality_score * 0.4 + q * 0.6, 1) AS quality_score
FROM scores JOIN second USING (p_partkey)""")
def merge_scores(t):
    return op.merge_scores(
        op.code_scores(codes(t)), op.scores_from_issues(other_review(t), "p_partkey"), "p_partkey"
    )


@query("text_code_safe", f"""
WITH {_SCORES_SQL}
SELECT *, security_score >= 5 AND p_partkey NOT IN (SELECT p_partkey FROM issues WHERE severity = 'critical') AS is_safe
FROM scores""")
def code_safe(t):
    return op.is_safe(op.code_scores(codes(t)), op.scan_code(codes(t)), "p_partkey")


SCRIPT = """concat('import x\nmodel_params = {"n_estimators": "', p_size, '", "max_depth": "None", "C": 0.5}\n',
  'model_params = {"n_estimators": 1}', CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END)"""


@query("text_params", f"""
WITH texts AS (SELECT p_partkey, {SCRIPT} AS text FROM part),
found AS (SELECT p_partkey, CAST(regexp_extract(text, 'model_params = (\\{{.*\\}})', 1) AS JSON) AS j FROM texts)
SELECT p_partkey, CAST(json_extract_string(j, '$.n_estimators') AS DOUBLE) AS n_estimators,
       nullif(json_extract_string(j, '$.max_depth'), 'None') AS max_depth,
       CAST(json_extract_string(j, '$.C') AS DOUBLE) AS c
FROM found""")
def params(t):
    got = op.params_from_code(built(t.part, SCRIPT).select(*_BUILT))
    return got.select(
        "p_partkey",
        F.col("params")["n_estimators"].try_cast("double").alias("n_estimators"),
        F.col("params")["max_depth"].alias("max_depth"),
        F.col("params")["C"].try_cast("double").alias("c"),
    )
