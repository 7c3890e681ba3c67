"""Queries on runs that compare reviews. Carriers: lines of orders as runs, labelled documents, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import boxes as X
from quillframe.functions import numeric as N
from quillframe.functions import parse as P
from quillframe.functions import text as T
from quillframe.operators import figures as G
from quillframe.operators import regressions as R
from quillframe.operators import reviews as V
from quillframe.operators import scoring as S
from quillframe.plans.registry import query, r6


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 1.0 WHEN 1 THEN round(l_discount, 2) ELSE 0 END AS a, CASE WHEN l_linenumber % 2 = 0 THEN 0.12 ELSE 0.01 END::DOUBLE AS b, 'n' AS note FROM lineitem""")
def alignment_normalise(t):
    """Measures too large, as words, missing, and such that two ways of rounding differ."""
    k = F.col("l_linenumber")
    a = F.when(k % 3 == 0, "7.5").when(k % 3 == 1, F.concat(F.lit('" '), F.round("l_discount", 2), F.lit('"'))).otherwise('"none"')
    v = F.parse_json(F.concat(F.lit('{"strength_coverage_recall":'), a, F.lit(',"weakness_coverage_recall":'), F.when(k % 2 == 0, "0.125").otherwise("0.015"), F.lit(',"note":" n\\n"}')))
    got = R.alignment(v)
    return t.lineitem.select("l_orderkey", "l_linenumber", got["strength_coverage_recall"].alias("a"), got["weakness_coverage_recall"].alias("b"), got["note"].alias("note"))


def run_files(t):
    """Files with a list of runs, old ones with one alignment, and ones with neither."""
    k, d = F.col("p_partkey"), F.col("p_size").cast("string")
    many = F.concat(F.lit('{"runs":[{"config":{"metric":"m","ai_model":"x","other":1},"config_key":"k'), (k % 5).cast("string"), F.lit('","alignment":{"s":'), d, F.lit('}},7,{"config":{"temperature":0.5,"metric":"m"},"alignment":{"s":"bad"}}]}'))
    old = F.concat(F.lit('{"judge_model":"j","ai_model":'), F.when(k % 2 == 0, '"y"').otherwise("null"), F.lit(',"runs":[],"alignment":{"s":'), d, F.lit("}}"))
    return t.part.select("p_partkey", "p_size", F.parse_json(F.when(k % 3 == 0, many).when(k % 3 == 1, old).otherwise('{"alignment":5}')).alias("v"))


def run_rows(t):
    rows = run_files(t).select("p_partkey", F.posexplode(R.runs(F.col("v"))).alias("n", "r"))
    config = R.group_config(F.try_variant_get("r", "$.config", "variant"))
    return rows.select("p_partkey", "n", R.group_key(R.got(F.col("r"), ["config_key"], "string", F.lit("")), config).alias("grp"), R.number(F.col("r"), "$.alignment.s").alias("s"))


RUNS = """WITH r AS (SELECT p_partkey, 0 AS n, 'config_key:k' || p_partkey % 5 AS grp, p_size::DOUBLE AS s FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 1, 'config:{"metric": "m", "temperature": 0.5}', NULL FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 0, 'config:{"ai_model": ' || CASE WHEN p_partkey % 2 = 0 THEN '"y"' ELSE 'null' END || ', "ai_review_file": null, "judge_model": "j", "metric": "unknown", "review_agent": null}', p_size FROM part WHERE p_partkey % 3 = 1)"""


@query(RUNS + " SELECT p_partkey, n::INT AS n, grp, s FROM r")
def legacy_runs(t):
    return run_rows(t)


@query(RUNS + " SELECT grp, count(*) AS n, round(avg(least(s / 40, 1)), 6) AS mean, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(least(s / 40, 1)) END, 6) AS std, round(max(least(s / 40, 1)), 6) AS most FROM r WHERE s IS NOT NULL GROUP BY grp")
def group_stats(t):
    rows = R.whole_rows(run_rows(t).withColumn("s", F.col("s") / 40), ["s"])
    out = S.metric_stats(rows, ["grp"], "s")
    return out.select("grp", "n", r6("mean").alias("mean"), r6("std").alias("std"), r6("max").alias("most"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 1.0 WHEN event_id % 4 = 2 THEN 0.0 ELSE round(value / 1000, 6) END AS finite, CASE WHEN event_id % 4 IN (0, 1) THEN 1.0 WHEN event_id % 4 = 2 THEN 0.0 ELSE round(value / 1000, 6) END AS clamped, CASE WHEN event_id % 5 = 0 THEN 'UNKNOWN' WHEN event_id % 5 < 3 THEN 'DROP' ELSE 'NON_DROP' END AS bucket, floor(length(event_type) / 3.5)::INT AS tokens, greatest(100, least(1000 - user_id - 50, 900))::BIGINT AS budget FROM events")
def number_rules(t):
    k = F.col("event_id") % 4
    said = F.when(k == 0, "inf").when(k == 1, "7").when(k == 2, "-3").otherwise((F.col("value") / 1000).cast("string"))
    clamped = F.when(k == 0, "inf").otherwise(said)
    j = F.col("event_id") % 5
    delta = F.when((j > 0) & (j < 3), -1.5).when(j == 3, 0.0).when(j == 4, float("nan"))
    return t.events.select("event_id", r6(N.finite01(said)).alias("finite"), r6(N.clamp01(clamped)).alias("clamped"), N.delta_bucket(delta).alias("bucket"), N.tokens_estimate(F.col("event_type")).alias("tokens"), N.completion_budget(F.lit(1000), F.col("user_id").cast("long"), 50, 900).alias("budget"))


@query("SELECT event_id, CASE WHEN value < 100 THEN 'DROP' ELSE 'NON_DROP' END AS bucket FROM events WHERE event_type <> 'error' AND (value >= 100 OR value - 100 <= -20)")
def drop_filters(t):
    rows = t.events.withColumn("delta", F.when(F.col("event_type") != "error", F.col("value") - 100))
    return R.by_drop(rows, "delta", least_drop=20).select("event_id", "bucket")


@query("""WITH x AS (SELECT source, sum(toxic)::BIGINT AS d, sum(1 - toxic)::BIGINT AS n FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT row_number() OVER (ORDER BY d / (d + n) DESC, d + n DESC, source)::INT AS place, source, d + n AS total FROM x""")
def comparison_order(t):
    from pyspark.sql import Window

    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    out = R.compared(S.drop_rate_lift(rows, "source", F.col("toxic") == 1), "source")
    return out.select(F.row_number().over(Window.orderBy(F.desc("drop_rate"), F.desc("total"), "source")).alias("place"), "source", "total")


@query("""SELECT toxic, source, n, pct, nth FROM (SELECT toxic, source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY toxic), 6) AS pct, row_number() OVER (PARTITION BY toxic ORDER BY count(*) DESC, source)::INT AS nth FROM labels JOIN documents USING (doc_id) GROUP BY toxic, source) WHERE nth <= 5""")
def bucket_tables(t):
    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return R.counted(rows, "toxic", "source", 5).withColumn("pct", r6("pct"))


@query("""SELECT doc_id, 'paper_' || CASE WHEN doc_id % 3 = 0 THEN 'origin' ELSE 'synth_' || source END AS folder, 'root/' || lang || '/detect/deep_eval/' || source || '/p_' || doc_id || '/eval_a_b.json' AS path, 'root/' || lang AS paper, 'deep' AS mode, source AS detector, 'p_' || doc_id AS stem, 'a_b' AS judge FROM documents""")
def path_keys(t):
    path = R.eval_path(F.concat(F.lit("root/"), "lang"), F.lit("deep"), F.col("source"), F.concat(F.lit("p_"), F.col("doc_id").cast("string")), F.lit("a/b"))
    folder = R.variant_name(F.when(F.col("doc_id") % 3 > 0, F.col("source")))
    return t.documents.select("doc_id", folder.alias("folder"), path.alias("path")).withColumn("k", R.eval_keys(F.col("path"))).select("doc_id", "folder", "path", "k.*")


@query("WITH a AS (SELECT conv_id, arg_min(text, turn) AS human FROM conversations WHERE role = 'user' GROUP BY conv_id), b AS (SELECT conv_id, arg_max(text, turn) AS machine FROM conversations WHERE role = 'assistant' AND conv_id % 3 > 0 GROUP BY conv_id) SELECT conv_id, human, machine FROM a JOIN b USING (conv_id) WHERE trim(human) <> '' AND trim(machine) <> ''")
def paired_reviews(t):
    c = t.conversations
    human = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    machine = c.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text")).withColumn("text", F.when(F.col("conv_id") % 3 > 0, F.col("text")).otherwise(" \n"))
    return R.reviewed(human, machine, "conv_id", "text")


@query("SELECT a.conv_id, a.role, a.text AS baseline, b.text AS final FROM (SELECT * FROM conversations WHERE turn IN (0, 1)) a JOIN (SELECT * FROM conversations WHERE turn IN (2, 3)) b ON a.conv_id = b.conv_id AND a.role = b.role")
def baseline_and_final(t):
    rows = t.conversations.where("turn < 4").withColumn("stage", F.when(F.col("turn") < 2, "baseline").otherwise("final"))
    return R.before_and_after(rows, ["conv_id", "role"], "stage", "text")


def _runs(t, late):
    half = t.events.agg(F.floor(F.max("event_id") / 2).alias("half"))
    rows = t.events.join(half).where(F.col("event_id") > F.col("half") if late else F.col("event_id") <= F.col("half"))
    return rows.groupBy("user_id", "event_type").agg(F.max("event_id").alias("run"))


KEYED = "WITH h AS (SELECT *, event_id > (SELECT max(event_id) // 2 FROM events) AS late FROM events), o AS (SELECT user_id, event_type, max(event_id) AS run FROM h WHERE NOT late AND event_type <> 'click' GROUP BY ALL), n AS (SELECT user_id, event_type, max(event_id) AS run FROM h WHERE late AND user_id % 2 = 0 GROUP BY ALL)"


@query(KEYED + " SELECT false AS overwrite, * FROM o UNION ALL SELECT false, * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = n.user_id AND o.event_type = n.event_type) UNION ALL SELECT true, * FROM n UNION ALL SELECT true, * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.user_id = n.user_id AND o.event_type = n.event_type)")
def keyed_runs(t):
    old, new = _runs(t, False).where("event_type <> 'click'"), _runs(t, True).where("user_id % 2 = 0")
    both = [R.with_keyed_run(old, new, "user_id", "event_type", o).select(F.lit(o).alias("overwrite"), "user_id", "event_type", "run") for o in (False, True)]
    return both[0].unionByName(both[1])


@query(KEYED + " SELECT false AS overwrite, * FROM o UNION ALL SELECT false, * FROM n UNION ALL SELECT true, * FROM n UNION ALL SELECT true, * FROM o WHERE user_id NOT IN (SELECT user_id FROM n)")
def container_runs(t):
    old, new = _runs(t, False).where("event_type <> 'click'"), _runs(t, True).where("user_id % 2 = 0")
    both = [R.with_fresh_container(old, new, "user_id", o).select(F.lit(o).alias("overwrite"), "user_id", "event_type", "run") for o in (False, True)]
    return both[0].unionByName(both[1])


@query("SELECT o_orderkey, CASE WHEN nth = 1 THEN name ELSE name || '__' || (nth - 1) END AS target FROM (SELECT o_orderkey, 'p' || o_custkey AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders)")
def copy_names(t):
    return R.copied_names(t.orders.select("o_orderkey", F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("name")), "name", ["o_orderkey"]).select("o_orderkey", "target")


@query("SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def first_json_object(t):
    """An object alone, after a list and a broken brace, before further braces, and none."""
    p, k = F.col("props"), F.col("event_id") % 5
    text = F.when(k == 0, p).when(k == 1, F.concat(F.lit("[1] {bad} {'a': 1} "), p, F.lit(" {}"))).when(k == 2, F.concat(p, F.lit('} and {"j": 1}'))).when(k == 3, "no { object }").otherwise(F.concat(F.lit("{{"), p))
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json(P.first_object(text)), "$.k", "bigint").alias("k"))


@query(r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Summary' || chr(10) || source || chr(10) || chr(10) || 'Strengths' || chr(10) || '- ' || lang || chr(10) || chr(10) || 'Weaknesses' || chr(10) || '- (empty)' || chr(10) WHEN 1 THEN 'Summary' || chr(10) || source || chr(10) || chr(10) || 'Strengths' || chr(10) || '- (not explicitly separated)' || chr(10) || chr(10) || 'Weaknesses' || chr(10) || '- (not explicitly separated)' || chr(10)
  WHEN 2 THEN '' ELSE 'Weaknesses' || chr(10) || 'w' || chr(10) || 'Strengths' || chr(10) || 's' || chr(10) || 'Summary' || chr(10) || source || chr(10) END AS review FROM documents""")
def review_sections(t):
    s, k = F.col("source"), F.col("doc_id") % 4
    text = F.when(k == 0, F.concat(F.lit("## 1. Summary\n"), s, F.lit("\n### 2) STRENGTHS\n- "), F.col("lang"), F.lit("\n# 3 - Weakness\n\n"))).when(k == 1, F.concat(F.lit("\n"), s, F.lit(" "))).when(k == 2, " \n").otherwise(F.concat(F.lit("Weaknesses\nw\nStrengths\ns\nSummary\n"), s))
    return t.documents.select("doc_id", V.three_sections(text).alias("review"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN 'score_rationale_shift' WHEN l_suppkey % 3 = 1 THEN 'tone' ELSE 'other' END AS kind, l_partkey % 4 > 0 AS said, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem)
SELECT l_orderkey, coalesce(list(kind ORDER BY i) FILTER (said AND i <= 4), []) AS every, coalesce(list(kind ORDER BY i) FILTER (said AND i <= 4), [])[1:1] AS first, list_filter(coalesce(list(kind ORDER BY i) FILTER (said AND i <= 4), []), lambda k: k = 'score_rationale_shift') AS shifts,
  CASE WHEN l_orderkey % 2 = 0 THEN -1.5 END::DOUBLE AS delta, CASE WHEN l_orderkey % 3 = 0 THEN '1-10' ELSE 'unknown' END AS scale FROM x GROUP BY l_orderkey""")
def regression_normalise(t):
    """At most four differences are read, those without a summary go, unknown kinds are other."""
    kind = F.when(F.col("l_suppkey") % 3 == 0, "score_rationale_shift").when(F.col("l_suppkey") % 3 == 1, "tone").otherwise("odd")
    d = F.struct(kind.alias("diff_type"), F.when(F.col("l_partkey") % 4 > 0, " s").otherwise(" ").alias("summary"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", d.alias("d")))).alias("ds"))
    text = F.concat(F.lit('{"score_delta":{"baseline_score":"6.5","final_score":'), F.when(F.col("l_orderkey") % 2 == 0, "5").otherwise('"n/a"'), F.lit(',"scale_hint":"'), F.when(F.col("l_orderkey") % 3 == 0, "1-10").otherwise("5 stars"), F.lit('"},"differences":'), F.to_json(F.transform("ds", lambda x: x["d"])), F.lit("}"))
    rows = rows.select("l_orderkey", F.parse_json(text).alias("v"))  # once, though regression() names it often
    got = rows.select("l_orderkey", V.regression(F.col("v"), ["1-10"], ["score_rationale_shift", "tone", "other"], [], most=4).alias("r"))
    kinds = lambda mode: F.transform(V.picked(F.col("r.differences"), mode), lambda x: x["diff_type"])
    return got.select("l_orderkey", kinds("all").alias("every"), kinds("top1").alias("first"), kinds("score_shift_only").alias("shifts"), F.col("r.score_delta.delta").alias("delta"), F.col("r.score_delta.scale_hint").alias("scale"))


@query("""WITH e AS (SELECT o_custkey AS paper, o_orderkey AS pos, CASE WHEN o_orderkey % 2 = 0 THEN '[' || o_orderkey % 9 || '] Entry' ELSE 'Name' || o_orderkey % 5 || ', A. 20' || (10 + o_orderkey % 3) END AS entry FROM orders),
k AS (SELECT o_custkey AS paper, o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 9)::VARCHAR ELSE 'name' || o_orderkey % 5 || '|20' || (10 + o_orderkey % 3) END AS key FROM orders),
m AS (SELECT k.paper, k.n, key, min(e.pos) AS pos FROM k LEFT JOIN e ON k.paper = e.paper AND ((NOT contains(key, '|') AND starts_with(entry, '[' || key || ']')) OR (contains(key, '|') AND contains(lower(entry), string_split(key, '|')[1]) AND contains(entry, string_split(key, '|')[2]))) GROUP BY ALL)
SELECT * FROM m""")
def cited_entries(t):
    key, c = F.col("o_orderkey"), "o_custkey"
    n = lambda m: (key % m).cast("string")
    entry = F.when(key % 2 == 0, F.concat(F.lit("["), n(9), F.lit("] Entry"))).otherwise(F.concat(F.lit("Name"), n(5), F.lit(", A. 20"), (10 + key % 3).cast("string")))
    entries = t.orders.select(F.col(c).alias("paper"), key.alias("pos"), entry.alias("entry"))
    keys = t.orders.select(F.col(c).alias("paper"), key.alias("n"), F.when(key % 3 == 0, n(9)).otherwise(F.concat(F.lit("name"), n(5), F.lit("|20"), (10 + key % 3).cast("string"))).alias("key"))
    return V.cited_entries(entries, keys, "paper", "pos", "entry", "key").select("paper", "n", "key", "pos")


@query("""WITH RECURSIVE b AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY (20 + l_partkey % 60) * (20 + l_suppkey % 60) DESC, l_linenumber, l_partkey, l_suppkey) AS k, l_linenumber, l_partkey % 40 AS x, l_suppkey % 40 AS y, 20 + l_partkey % 60 AS w, 20 + l_suppkey % 60 AS h, l_linenumber % 2 AS page FROM lineitem),
f AS (SELECT l_orderkey, 0::BIGINT AS k, []::BIGINT[] AS kept FROM b GROUP BY l_orderkey
 UNION ALL SELECT f.l_orderkey, b.k, CASE WHEN EXISTS (SELECT 1 FROM b o WHERE o.l_orderkey = f.l_orderkey AND list_contains(f.kept, o.k) AND o.page = b.page AND o.w * o.h > b.w * b.h AND (greatest(o.x - b.x, o.y - b.y, b.x + b.w - o.x - o.w, b.y + b.h - o.y - o.h) <= 2
   OR greatest(0, (o.x - b.x) / o.w, (b.x + b.w - o.x - o.w) / o.w, (o.y - b.y) / o.h, (b.y + b.h - o.y - o.h) / o.h) <= 0.1)) THEN f.kept ELSE list_append(f.kept, b.k) END FROM f JOIN b ON b.l_orderkey = f.l_orderkey AND b.k = f.k + 1)
SELECT l_orderkey, len(arg_max(kept, k)) AS n_kept FROM f GROUP BY l_orderkey""")
def sub_images(t):
    """Boxes within larger ones of their page go, from large to small."""
    x, y, w, h = F.col("l_partkey") % 40, F.col("l_suppkey") % 40, 20 + F.col("l_partkey") % 60, 20 + F.col("l_suppkey") % 60
    rows = t.lineitem.select("l_orderkey", (F.col("l_linenumber") % 2).alias("page"), "l_linenumber", "l_partkey", "l_suppkey", X.from_size(x, y, w, h).alias("box"))
    kept = G.without_parts(rows, ["l_orderkey", "page"], "box", ["l_linenumber", "l_partkey", "l_suppkey"])
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_kept"))
