"""Queries from edits to training samples. Carrier: a conversation is a paper, its turns blocks, and each third turn gives edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.operators import blocks as B
from quillframe.operators import training as R
from quillframe.plans.registry import chosen, query, r6

#: Edits of each conversation: of turn k the text from character 6 on, found again in an earlier or later turn, then one that undoes part of it, one that is nowhere.
EDITS = """
WITH RECURSIVE c AS (SELECT conv_id, list(CASE WHEN turn % 5 = 4 THEN NULL ELSE text END ORDER BY turn) AS texts FROM conversations GROUP BY conv_id),
x AS (SELECT conv_id, 3 * turn AS o, 10 + turn AS id, substr(text, 2, 4) AS find, '<' || turn || '>' AS repl, turn FROM conversations
  UNION ALL SELECT conv_id, 3 * turn + 1, 100 + turn, '<' || (turn - turn % 2) || '>', 'the ', turn FROM conversations UNION ALL SELECT conv_id, 3 * turn + 2, 200 + turn, '@@' || turn, 'x', turn FROM conversations WHERE turn % 3 = 0),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS step FROM x),
f AS (SELECT conv_id, 0::BIGINT AS step, texts, 0::BIGINT AS id, 0::BIGINT AS hit, 0::BIGINT AS spot, ''::VARCHAR AS before, ''::VARCHAR AS after FROM c
  UNION ALL SELECT conv_id, step, list_transform(texts, lambda t, i: CASE WHEN i = hit THEN t[1 : spot - 1] || repl || t[spot + length(find) :] ELSE t END), id, hit, spot,
    substr(texts[hit], greatest(1, spot - 120), spot - greatest(1, spot - 120)), substr(texts[hit], spot + length(find), 120)
  FROM (SELECT *, CASE WHEN hit > 0 THEN instr(texts[hit], find) ELSE 0 END AS spot FROM (
    SELECT f.conv_id, e.step, f.texts, e.id, e.find, e.repl, coalesce(list_position(list_transform(f.texts, lambda t: contains(t, e.find)), true), 0) AS hit FROM f JOIN e ON f.conv_id = e.conv_id AND e.step = f.step + 1)))
"""


def edited(t):
    """conv_id, done (texts and records) and edits of each conversation."""
    text = F.when(F.col("turn") % 5 == 4, F.lit(None)).otherwise(F.col("text"))
    turn, n = F.col("turn"), F.col("turn").cast("string")
    tag = lambda x: F.concat(F.lit("<"), x.cast("string"), F.lit(">"))

    def edit(k, id_, find, repl):
        return F.struct((3 * turn + k).alias("o"), (turn + id_).cast("int").alias("id"), find.alias("find"), repl.alias("replacement"), F.when(turn % 4 != 1, turn % 4 == 0).alias("needs_cross_section"), F.concat(F.lit("type "), (turn % 3).cast("string")).alias("corruption_type"), F.concat(F.lit("why "), n).alias("error_explanation"))

    three = F.array(edit(0, 10, F.substring("text", 2, 4), tag(turn)), edit(1, 100, tag(turn - turn % 2), F.lit("the ")), edit(2, 200, F.concat(F.lit("@@"), n), F.lit("x")))
    mine = F.when(turn % 3 == 0, three).otherwise(F.slice(three, 1, 2))
    c = t.conversations.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("x")))), lambda x: x["x"]).alias("texts"),
        F.array_sort(F.flatten(F.collect_list(mine))).alias("edits"),
    )
    return c.select("conv_id", B.apply_edits(F.col("texts"), F.col("edits")).alias("done"), "edits")


@query(EDITS + "SELECT conv_id, (step - 1)::INT AS n, id::INT AS id, hit > 0 AS applied, CASE WHEN hit > 0 THEN (hit - 1)::INT END AS pos0, CASE WHEN hit > 0 THEN (spot - 1)::INT END AS \"offset\", CASE WHEN hit > 0 THEN before END AS before, CASE WHEN hit > 0 THEN after END AS after FROM f WHERE step > 0")
def sequential_edits(t):
    return edited(t).select("conv_id", F.posexplode("done.records").alias("n", "r")).select("conv_id", "n", "r.*")


@query(EDITS + "SELECT conv_id, arg_max(texts, step) AS texts FROM f GROUP BY conv_id")
def edited_texts(t):
    return edited(t).select("conv_id", "done.texts")


#: Each edit that needs no other section, with the block it changed, as the last state has it.
CHAIN = EDITS + """, last AS (SELECT conv_id, arg_max(texts, step) AS texts FROM f GROUP BY conv_id),
g AS (SELECT f.conv_id, f.step, f.id, texts[f.hit] AS text, e.repl, e.turn FROM f JOIN e USING (conv_id, step) JOIN (SELECT conv_id, texts AS now FROM last) l USING (conv_id), LATERAL (SELECT l.now AS texts) WHERE f.hit > 0 AND e.turn % 4 IN (2, 3)),
s AS (SELECT conv_id, text, min(step) AS first, list('type ' || (turn % 3) ORDER BY step) AS kinds, list(repl ORDER BY step) AS repls, list('why ' || turn ORDER BY step) AS whys FROM g WHERE text <> '' GROUP BY conv_id, text)"""
CHAIN = CHAIN.replace("texts[f.hit] AS text", "l.now[f.hit] AS text").replace(", LATERAL (SELECT l.now AS texts)", "")


def chain(t):
    rows = edited(t)
    edits = rows.select("conv_id", F.posexplode("edits").alias("n", "e")).select("conv_id", "n", "e.*")
    records = rows.select("conv_id", F.posexplode("done.records").alias("ord", "r")).select("conv_id", "ord", "r.id", "r.pos0")
    blocks = rows.select("conv_id", F.posexplode("done.texts").alias("ord", "text")).withColumn("index1", F.col("ord") + 1)
    found = R.edited_text(R.local_edits(edits), records, blocks, "conv_id")
    return R.grouped(found, ["conv_id"], "n", ["id", "corruption_type", "error_explanation", "replacement"])


@query(CHAIN + " SELECT conv_id, text, len(kinds) AS n_errors, array_to_string(kinds, ',') AS kinds FROM s")
def sft_grouping(t):
    return chain(t).select("conv_id", "text", F.size("errors").cast("long").alias("n_errors"), F.array_join("errors.corruption_type", ",").alias("kinds"))


TEMPLATE = "Task\n---\n### Text to Review ###\n{text}\n\n---\n### Instructions ###\nList errors."


@query(CHAIN + r""", o AS (SELECT conv_id, first, 'Task' || chr(10) || '---' || chr(10) || '### Text to Review ###' || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) || '### Instructions ###' || chr(10) || 'List errors.' AS instruction, text, kinds, repls, whys FROM s)
SELECT 'sample_' || row_number() OVER (ORDER BY conv_id, first) AS sample, instruction, len(kinds)::INT AS error_count, length(text)::INT AS text_length, repls, kinds, whys FROM o""")
def sft_samples(t):
    rows = R.numbered(R.samples(chain(t), ["conv_id"], TEMPLATE), ["conv_id", "first"])
    whole = "array<struct<error_location: string, error_type: string, error_explanation: string>>"
    out = rows.withColumn("o", F.from_json("output", whole))
    return out.select("sample", "instruction", "error_count", "text_length", F.col("o.error_location").alias("repls"), F.col("o.error_type").alias("kinds"), F.col("o.error_explanation").alias("whys"))


@query(CHAIN + " SELECT text AS body, '' AS input, len(kinds)::INT AS n FROM s")
def instruction_rows(t):
    rows = R.instruction_rows(R.samples(chain(t), ["conv_id"], TEMPLATE))
    return rows.select(F.regexp_extract("instruction", r"(?s)###\n(.*)\n\n---\n### I", 1).alias("body"), "input", F.size(F.from_json("output", "array<string>")).alias("n"))


def outputs(t):
    """Samples whose outputs are whole, lack a field, hold a string, are an object, and are no JSON."""
    rows = R.samples(chain(t), ["conv_id"], TEMPLATE).withColumn("form", F.col("conv_id") % 5)
    forms = [F.col("output"), F.regexp_replace("output", '"error_type":"[^"]*",', ""), F.lit('["x"]'), F.lit('{"a": 1}'), F.lit("[1")]
    return rows.withColumn("output", chosen(F.col("form"), forms))


@query(CHAIN + r""" SELECT conv_id % 5 AS form, regexp_replace(CASE WHEN contains(text, '---') THEN string_split(text, '---')[1] ELSE text END, '^\s+|\s+$', '', 'g') AS input, kinds, NULL AS fault FROM s WHERE conv_id % 5 = 0
UNION ALL SELECT conv_id % 5, NULL, NULL, CASE conv_id % 5 WHEN 1 THEN 'missing fields' WHEN 2 THEN 'missing fields' WHEN 3 THEN 'no list' ELSE 'no JSON' END FROM s WHERE conv_id % 5 > 0""")
def reward_rows(t):
    good, bad = R.reward_rows(outputs(t))
    good = good.select(F.lit(0).cast("long").alias("form"), "input", F.col("ground_truth.error_type").alias("kinds"), F.lit(None).cast("string").alias("fault"))
    return good.unionByName(bad.select(F.col("form").cast("long").alias("form"), "fault"), allowMissingColumns=True)


@query(CHAIN + " SELECT conv_id, conv_id % 5 < 3 AND len(kinds) > 1 AS ok, count(*) AS n FROM s GROUP BY ALL")
def sample_validity(t):
    rows = outputs(t).withColumn("said", F.when(F.col("error_count") > 1, F.col("instruction")).otherwise(" \n"))
    return rows.groupBy("conv_id", R.sample_ok(F.col("said"), F.col("output")).alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@query(CHAIN + " SELECT count(*) AS samples, sum(len(kinds))::BIGINT AS errors, round(avg(len(kinds)), 6) AS mean_errors, count(*) FILTER (len(kinds) > 1) AS several, round(100.0 * count(*) FILTER (len(kinds) > 1) / count(*), 6) AS several_pct FROM s")
def sample_stats(t):
    out = R.sample_stats(R.samples(chain(t), ["conv_id"], TEMPLATE))
    return out.withColumns({c: r6(F.col(c)) for c in ("mean_errors", "several_pct")})


@query(CHAIN + ", k AS (SELECT unnest(kinds) AS error_type FROM s) SELECT error_type, count(*) AS n FROM k GROUP BY error_type")
def error_type_distribution(t):
    return R.error_types(R.samples(chain(t), ["conv_id"], TEMPLATE))


@query(EDITS + """, n AS (SELECT conv_id, count(*) FILTER (hit > 0) AS n_applied FROM f WHERE step > 0 GROUP BY conv_id)
SELECT n_applied, count(*) AS papers, sum(count(*)) OVER ()::BIGINT AS total, min(n_applied) OVER () AS least, max(n_applied) OVER () AS most, round((sum(n_applied * count(*)) OVER ()) / (sum(count(*)) OVER ()), 6) AS mean FROM n GROUP BY n_applied""")
def applied_distribution(t):
    records = edited(t).select("conv_id", F.explode("done.records").alias("r")).select("conv_id", "r.applied")
    return R.applied_distribution(R.applied_counts(records, "conv_id")).withColumn("mean", r6(F.col("mean")))


@query(EDITS + ", n AS (SELECT conv_id, count(*) FILTER (hit > 0) AS n_applied FROM f WHERE step > 0 GROUP BY conv_id) SELECT DISTINCT c.conv_id FROM conversations c LEFT JOIN n ON c.conv_id = n.conv_id AND c.conv_id % 7 > 0 WHERE n.conv_id IS NULL OR n_applied < 6")
def rerun_if_few_applied(t):
    """Conversations that were not run, here those of numbers divisible by seven, or had too few edits applied."""
    records = edited(t).where("conv_id % 7 > 0").select("conv_id", F.explode("done.records").alias("r")).select("conv_id", "r.applied")
    return R.to_run(t.conversations.select("conv_id").distinct(), R.applied_counts(records, "conv_id"), "conv_id", 6)


@query("SELECT doc_id, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic = 1")
def synthetic_gate(t):
    return R.usable(t.documents.join(t.labels, "doc_id", "left").withColumn("synthetic", F.col("toxic") == 1)).select("doc_id", "lang")
