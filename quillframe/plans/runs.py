"""Queries on runs: what is done, rewards, model stages, keys, and the stream of a log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillframe.functions import numeric as N
from quillframe.functions import text as T
from quillframe.operators import model as M
from quillframe.operators import prompts as P
from quillframe.operators import regressions as G
from quillframe.operators import resume as R
from quillframe.operators import reviews as V
from quillframe.operators import scoring as S
from quillframe.plans.registry import chosen, query, r6
from quillframe.session import scratch
from quillframe.sources import files as X
from quillframe.sources import remote
from quillframe.sources import sinks as K
from quillframe.sources import stored as D
from quillframe.streaming import log as L


def outputs(t):
    """An output a customer: with all fields, with some as null or of another type, empty, or no JSON."""
    c = F.col("c_custkey")
    forms = [
        F.concat(F.lit('{"reviews":null,"synthetic":true,"paper":{},"findings":[1],"runs":[{"config_key":"k1"},{"config_key":"k'), c.cast("string"), F.lit('"}]}')),
        F.lit('{"synthetic":"true","paper":1,"findings":[],"runs":[5]}'), F.lit("[]"), F.lit("{"), F.lit('{"reviews":[],"synthetic":true,"runs":{}}'),
    ]
    text = chosen(c % 5, forms)
    return t.customer.where("c_acctbal >= 0").select("c_custkey", F.try_parse_json(text).alias("v"), F.length(text).alias("size"))


@query("""WITH o AS (SELECT c_custkey, c_custkey % 5 AS f FROM customer WHERE c_acctbal >= 0), d AS (SELECT 'field' AS way, c_custkey FROM o WHERE f IN (0, 4) UNION ALL SELECT 'flag', c_custkey FROM o WHERE f = 0 UNION ALL SELECT 'run', c_custkey FROM o WHERE f = 0 UNION ALL SELECT 'size', c_custkey FROM o WHERE f IN (0, 1) UNION ALL SELECT 'found', c_custkey FROM o WHERE f <> 1)
SELECT way, c_custkey FROM (SELECT DISTINCT way FROM d) w, customer c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.way = w.way AND d.c_custkey = c.c_custkey)""")
def resume_predicates(t):
    """What each way of telling whether work is done leaves to do."""
    v, o = F.col("v"), outputs(t)
    ways = {"field": R.has_field(v, "reviews"), "flag": R.flagged(v, "synthetic", "paper"), "run": R.has_run(v, F.concat(F.lit("k"), F.col("c_custkey").cast("string"))), "size": R.long_enough(F.col("size")), "found": ~R.no_findings(v)}
    out = [R.left_to_do(t.customer.select("c_custkey"), o, "c_custkey", F.coalesce(d, F.lit(False))).select(F.lit(w).alias("way"), "c_custkey") for w, d in ways.items()]
    for df in out[1:]:
        out[0] = out[0].unionByName(df)
    return out[0]


@query("SELECT doc_id, round(CASE doc_id % 7 WHEN 0 THEN -0.5 WHEN 1 THEN -0.3 WHEN 2 THEN -0.3 WHEN 3 THEN 0 WHEN 4 THEN 0.6 * quality ELSE 0.6 * quality + 0.4 * (1 - toxic) END::DOUBLE, 6) AS reward FROM labels")
def judged_rewards(t):
    """Rewards, and the penalties of blank outputs, bad truths and judges without an answer."""
    k, q = F.col("doc_id") % 7, F.col("quality").cast("string")
    scores = F.when(k == 4, F.concat(F.lit('{"precision":'), q, F.lit("}"))).when(k != 3, F.concat(F.lit('{"precision":'), q, F.lit(',"conciseness":'), (1 - F.col("toxic")).cast("string"), F.lit("}")))
    output, truth = F.when(k == 0, " \n").otherwise("text"), F.when(k == 1, "[1").when(k == 2, None).otherwise("[]")
    return t.labels.select("doc_id", r6(N.judged_reward(output, truth, F.parse_json(scores))).alias("reward"))


@query("SELECT event_id, substr(sha1(event_type), 1, 10) AS mark, md5(event_type || '|||' || user_id) AS key, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, CASE WHEN user_id % 2 = 0 THEN '[' || event_type ELSE event_type END || CASE WHEN user_id % 2 = 0 AND length(event_type) > 5 THEN ']' ELSE '' END AS short, 'data:image/png;base64,' || to_base64(event_type::BLOB) AS uri FROM events")
def keys_and_marks(t):
    e, u = F.col("event_type"), F.col("user_id")
    text = F.when(u % 2 == 0, F.concat(F.lit("["), e)).otherwise(e)
    letters = F.split(e, "")
    return t.events.select("event_id", N.prompt_mark(e).alias("mark"), N.reward_key(e, u.cast("string")).alias("key"), N.iso_now(F.col("ts")).alias("at"), N.cut_tokens(text, letters, 5, text).alias("short"), T.data_uri(F.encode(e, "UTF-8"), F.lit("image/png")).alias("uri"))


@query(r"""SELECT doc_id, '<paper>' || chr(10) || 'Title: ' || source || chr(10) || 'Authors: ' || lang || chr(10) || 'Abstract: ' || n_chars || chr(10) || 'Resemblance Analysis: x</paper>' AS prompt, '{' || chr(10) || '  "a": "' || source || '",' || chr(10) || '  "b": [' || chr(10) || '    1' || chr(10) || '  ]' || chr(10) || '}' AS json FROM documents""")
def prompt_records(t):
    v = F.parse_json(F.concat(F.lit('{"b":[1],"a":"'), "source", F.lit('"}')))
    return t.documents.select("doc_id", T.similar_work(F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), F.lit("x")).alias("prompt"), T.indented_json(v).alias("json"))


@query("SELECT conv_id, turn FROM conversations WHERE turn % 4 < 2")
def reference_sections(t):
    k = F.col("turn") % 4
    rows = t.conversations.withColumns({"section": F.when(k == 0, " References\n").when(k == 1, "BIBLIOGRAPHY").when(k == 2, "Reference list").otherwise("reference"), "type": F.when(k == 3, "image_url").otherwise("text")})
    return V.reference_blocks(rows).select("conv_id", "turn")


@query("SELECT event_id, 'Read the section ' || event_type || ' and report its errors.' || chr(10) || CASE WHEN user_id % 2 = 0 THEN user_id::VARCHAR ELSE '' END || chr(10) || 'Answer as {\"findings\": [...]}.' AS prompt FROM events")
def filled_prompts(t):
    return t.events.select("event_id", P.fill(P.TEMPLATES["section"], section=F.col("event_type"), text=F.when(F.col("user_id") % 2 == 0, F.col("user_id"))).alias("prompt"))


class Judge:
    """Answers with JSON in noise; the third kind of prompt gets none, the fourth an answer without the key."""

    def complete(self, prompt: str) -> str:
        kind, _, rest = prompt.partition(" ")
        if kind == "2":
            raise M.Fatal("refused")
        return f"so: {{\"other\": 1}}" if kind == "3" else f"so: {{\"score\": {len(rest)}}} end"


@query("SELECT event_id, CASE WHEN event_id % 4 < 2 THEN length(event_type) END AS score, CASE event_id % 4 WHEN 2 THEN 'refused' WHEN 3 THEN 'no score' END AS error FROM events")
def model_stage(t):
    asked = t.events.select("event_id", "event_type")
    prompt = F.concat((F.col("event_id") % 4).cast("string"), F.lit(" "), "event_type")
    return M.stage(asked, prompt, Judge(), lambda v: F.try_variant_get(v, "$.score", "bigint"), "score", tries=2, key="score").select("event_id", "score", "error")


@query("SELECT event_id, user_id, event_type, md5(event_type || '|||' || user_id) AS cache_key, min(event_id) OVER (PARTITION BY event_type, user_id) AS asked_by, length(event_type) AS size FROM events")
def calls_asked_once(t):
    """Equal questions are asked once, by the first event, and the answer reaches all that ask."""
    rows, once = M.asked_once(t.events.select("event_id", "event_type", "user_id"), F.col("event_type"), F.col("user_id").cast("string"))
    answers = once.select("cache_key", F.col("event_id").alias("asked_by"), F.length("event_type").cast("long").alias("size"))
    return M.answered(rows, answers).select("event_id", "user_id", "event_type", "cache_key", "asked_by", "size")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def log_stream(t):
    """The events as a log of JSON lines among broken ones, read as a stream in two runs of many micro-batches, and the latest of each user."""
    at = f"{scratch(t.spark)}/log-{uuid.uuid4().hex}"
    line = F.when(F.col("bad"), F.lit("{broken")).otherwise(F.to_json(F.struct("user_id", "event_type", "event_id")))
    for n, part in enumerate((F.col("event_type").isin("click", "view"), ~F.col("event_type").isin("click", "view"))):
        both = t.events.where(part).select("user_id", "event_type", "event_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("bad"))
        K.write_text(both.select(line.alias("value")).repartition(4), f"{at}/log/{n}")
        stream = L.events(t.spark, f"{at}/log/*", "user_id long, event_type string, event_id long", files_per_batch=2)
        L.keep_latest(stream, f"{at}/checkpoint", ["user_id"], ["event_id"]).awaitTermination()
    return L.current(t.spark, f"{at}/checkpoint", ["user_id", "event_type", "event_id"])


STORED = """WITH o AS (SELECT user_id, event_type, CASE WHEN value > 20 THEN 'high' ELSE 'low' END AS level, event_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events WHERE event_type IN ('click', 'view', 'error')),
n AS (SELECT user_id, event_type, level, max(event_id) AS run FROM (SELECT *, CASE WHEN value > 20 THEN 'high' ELSE 'low' END AS level FROM events WHERE event_type IN ('click', 'purchase')) GROUP BY ALL),
f AS (SELECT user_id, event_type, level, min(pos) AS pos FROM o GROUP BY ALL), top AS (SELECT user_id, max(pos) AS top FROM o GROUP BY user_id)"""


@query(STORED + """ SELECT o.user_id, o.event_type, o.level, coalesce(n.run, o.run) AS run, o.pos::INT AS pos FROM o LEFT JOIN f USING (user_id, event_type, level, pos)
LEFT JOIN n ON f.user_id IS NOT NULL AND n.user_id = o.user_id AND n.event_type = o.event_type AND n.level = o.level
UNION ALL SELECT n.user_id, n.event_type, n.level, n.run, (coalesce(top, -1) + row_number() OVER (PARTITION BY n.user_id ORDER BY n.run))::INT FROM n LEFT JOIN top USING (user_id) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = n.user_id AND f.event_type = n.event_type AND f.level = n.level)""")
def stored_runs(t):
    """Runs of users as a stored table: clicks and purchases take the places of runs with the same key or follow them. A
    writer dies before, and one that was told nothing runs again after; neither leaves a trace."""
    at = f"{scratch(t.spark)}/stored-{uuid.uuid4().hex}"
    rows = t.events.select("user_id", "event_type", F.when(F.col("value") > 20, "high").otherwise("low").alias("level"), F.col("event_id").alias("run"))
    new = rows.where(F.col("event_type").isin("click", "purchase"))
    D.create(rows.where(F.col("event_type").isin("click", "view", "error")), at, "user_id", ["run"], buckets=8)
    D.stage(new.withColumn("level", F.lit("lost")), at, ["event_type", "level"], ["run"])
    for _ in range(2):
        D.update(new, at, ["event_type", "level"], ["run"], tag="clicks")
    D.prune(t.spark, at)
    return D.load(t.spark, at)


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 0 ELSE s_suppkey END AS k, 'p' || s_suppkey % 4 AS folder FROM supplier WHERE s_suppkey % 3 < 2")
def lenient_files(t):
    """Files one level below a folder, blank ones read as an empty object, others that are no JSON as null."""
    at, s = f"{scratch(t.spark)}/lenient-{uuid.uuid4().hex}", F.col("s_suppkey")
    text = F.when(s % 3 == 0, " ").when(s % 3 == 1, F.concat(F.lit('{"k":'), s.cast("string"), F.lit("}"))).otherwise("{x")
    rows = t.supplier.select(text.alias("value"), F.concat(F.lit("p"), (s % 4).cast("string")).alias("f"), s.cast("string").alias("n"))
    K.write_files(rows, at, "f", "n", "value")
    got = X.scan_json(t.spark, at, lenient=True, name="*.txt").where("v is not null")
    return got.select(F.regexp_extract("path", "/n=([0-9]+)[^=]*$", 1).cast("long").alias("s_suppkey"), F.coalesce(F.try_variant_get("v", "$.k", "long"), F.lit(0)).alias("k"), F.regexp_extract("path", "/f=([^/=]*)/n=[^=]*$", 1).alias("folder"))


@query("SELECT n_nationkey, 2 AS depth, 'none' AS gone, true AS flag, 0.5::DOUBLE AS share, n_name FROM nation WHERE n_regionkey = 2")
def settings_and_filters(t):
    """Settings of a file by dotted keys, and filters by equality that an empty word leaves out."""
    at = f"{scratch(t.spark)}/settings-{uuid.uuid4().hex}"
    lines = "# all\na:\n  b:\n    c: 2  # deep\n\n  region: '2'\nx: 1\nnone_set:\nflag: true\nshare: 0.5"
    K.write_text(t.spark.range(1).select(F.lit(lines).alias("value")), at)
    config = remote.read_settings(t.spark, at)
    rows = G.filtered(t.nation.withColumn("region", F.col("n_regionkey").cast("string")), region=remote.setting(config, "a.region"), n_name=remote.setting(config, "none_set") or "")
    told = {"depth": "a.b.c", "gone": "x.y", "flag": "flag", "share": "share"}
    return rows.select("n_nationkey", *[F.lit(remote.setting(config, key, "none")).alias(name) for name, key in told.items()], "n_name")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND user_id % 2 = 0 UNION ALL SELECT user_id, 'new', -1 FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 1)")
def run_log_remove_and_replace(t):
    """Runs of one key taken out of a log, and others put in their place in order."""
    rows = S.latest(t.events.select("user_id", "event_type", "event_id"), "user_id", [F.desc("event_id")])
    new = rows.where("user_id % 2 = 1").select("user_id", F.lit("new").alias("event_type"), F.lit(-1).cast("long").alias("event_id"))
    return S.upsert(S.removed(rows, new, ["user_id"]), new, ["user_id"])
