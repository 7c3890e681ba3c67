"""Registered queries over the driver's tables, and the SQL that checks them.

Carriers: labelled documents are papers (source) with buckets (lang) and a matched flag (toxic); a
document's lines are blocks; events are an append log; conversations are ordered blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import boxes as X
from quillframe.functions import numeric as N
from quillframe.functions import parse as P
from quillframe.functions import text as T
from quillframe.functions import tokens as K
from quillframe.operators import blocks as B
from quillframe.operators import checks as C
from quillframe.operators import matching as J
from quillframe.operators import resume as U
from quillframe.operators import reviews as R
from quillframe.operators import scoring as S
from quillframe.operators import selection as M
from quillframe.plans.registry import ORACLES, QUERIES, Tables, chosen, query, r6


def labelled(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id")


LABELLED = "labels JOIN documents USING (doc_id)"


@query(f"""
WITH x AS (SELECT source, unnest(['lang', 'quality', 'size', 'lined']) AS dim, unnest([lang, quality::VARCHAR, length(n_chars::VARCHAR)::VARCHAR, contains(text, chr(10))::VARCHAR]) AS value, toxic FROM {LABELLED}),
p AS (SELECT source, dim, value, count(*) AS t, sum(toxic) AS m FROM x WHERE value IS NOT NULL GROUP BY ALL)
SELECT dim, value, count(*) AS paper_count, sum(t)::BIGINT AS total, sum(m)::BIGINT AS matched,
       round(sum(m) / sum(t), 6) AS rate, round(avg(m / t), 6) AS macro_rate, row_number() OVER (PARTITION BY dim ORDER BY value)::INT AS nth FROM p GROUP BY dim, value""")
def macro_micro_breakdown(t):
    """All four dimensions in one pass, their values in order."""
    rows = t.labels.join(t.documents.select("doc_id", "lang", "source", F.length(F.col("n_chars").cast("string")).alias("size"), F.contains("text", F.lit("\n")).alias("lined")), "doc_id")
    out = S.in_order(S.breakdown(rows, "source", ["lang", "quality", "size", "lined"], F.col("toxic") == 1))
    return out.select("dim", "value", "paper_count", "total", "matched", r6("rate").alias("rate"), r6("macro_rate").alias("macro_rate"), "nth")


@query(f"""
WITH p AS (SELECT source, count(*) AS t, sum(toxic) AS m FROM {LABELLED} GROUP BY source)
SELECT count(*) AS paper_count, sum(t)::BIGINT AS total, sum(m)::BIGINT AS matched, round(sum(m) / sum(t), 6) AS micro_rate, round(avg(m / t), 6) AS macro_rate FROM p""")
def overall_micro_macro(t):
    out = S.overall(labelled(t), "source", F.col("toxic") == 1)
    return out.select("paper_count", "total", "matched", r6("micro_rate").alias("micro_rate"), r6("macro_rate").alias("macro_rate"))


@query(f"SELECT lang, quality, count(*) AS n, sum(toxic)::BIGINT AS matched FROM {LABELLED} GROUP BY GROUPING SETS ((lang), (quality))")
def breakdown_grouping_sets(t):
    labelled(t).createOrReplaceTempView("qf_labelled")
    return t.spark.sql("SELECT lang, quality, count(*) AS n, sum(toxic) AS matched FROM qf_labelled GROUP BY GROUPING SETS ((lang), (quality))")


SCORES = f"""
WITH g AS (SELECT source, count(*) FILTER (quality = 1) AS gt, count(*) FILTER (quality = 1 AND toxic = 1) AS hits, count(*) FILTER (toxic = 1) AS findings FROM {LABELLED} GROUP BY source),
s AS (SELECT *, CASE WHEN gt = 0 THEN 0 ELSE hits / gt END AS recall, CASE WHEN findings = 0 THEN 0 ELSE hits / findings END AS prec FROM g),
f AS (SELECT *, CASE WHEN prec + recall = 0 THEN 0 ELSE 2 * prec * recall / (prec + recall) END AS f1 FROM s)"""


def scored(t):
    q, x = F.col("quality") == 1, F.col("toxic") == 1
    g = labelled(t).groupBy("source").agg(F.count_if(q).alias("gt"), F.count_if(q & x).alias("hits"), F.count_if(x).alias("findings"))
    return S.per_paper_scores(g.withColumn("matched_preds", F.col("hits")))


@query(SCORES + " SELECT source, gt, hits, findings, round(recall, 6) AS recall, round(prec, 6) AS precision, round(f1, 6) AS f1 FROM f")
def precision_recall_f1(t):
    return scored(t).select("source", "gt", "hits", "findings", *[r6(c).alias(c) for c in ("recall", "precision", "f1")])


@query(SCORES + """, a AS (SELECT avg(recall) AS r, avg(prec) AS p, avg(f1) AS macro_f1, avg(hits) / avg(findings) AS msr FROM f)
SELECT round(r, 6) AS avg_recall, round(p, 6) AS avg_precision, round(macro_f1, 6) AS macro_f1, round(msr, 6) AS match_success_rate, round(2 * p * r / (p + r), 6) AS avg_f1 FROM a""")
def avg_vs_macro_f1(t):
    return S.dataset_scores(scored(t)).select(*[r6(c).alias(c) for c in ("avg_recall", "avg_precision", "macro_f1", "match_success_rate", "avg_f1")])


@query("""SELECT conv_id, turn, cum_cost FROM (SELECT conv_id, turn, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS cum_cost FROM conversations) WHERE cum_cost <= 600""")
def char_budget_prefix(t):
    return B.budget_prefix(t.conversations, "conv_id", "turn", F.length("text").cast("long"), 600).select("conv_id", "turn", "cum_cost")


@query("""
WITH c AS (SELECT conv_id, turn, sum(length(text)) OVER w AS cc, count(*) OVER w AS cp FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, coalesce(max((cc > 630 OR cp >= 5)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM c)
SELECT conv_id, turn FROM s WHERE stopped = 0""")
def soft_budget_prefix(t):
    return B.soft_budget_prefix(t.conversations, "conv_id", "turn", F.length("text").cast("long"), 600, 5).select("conv_id", "turn")


#: Blocks of three lines, every fourth of them no text.
PIECES = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
k AS (SELECT doc_id, unnest(range((len(ls) + 2) // 3)) AS pos, ls FROM s),
b AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 3 THEN 'table' ELSE 'text' END AS type, ls[3 * pos + 1 : 3 * pos + 3] AS raw FROM k),
c AS (SELECT doc_id, pos, type, CASE WHEN raw[len(raw)] = '' THEN raw[1 : len(raw) - 1] ELSE raw END AS ls, array_to_string(raw, chr(10)) AS text FROM b),
l AS (SELECT doc_id, pos, unnest(ls) AS line, unnest(range(len(ls))) AS line_no, len(ls) AS n FROM c WHERE type = 'text'),
m AS (SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^[#*]+\s*', ''), '\s+', ' ', 'g'), ' .·•|-–—~')) AS x FROM l),
n AS (SELECT *, CASE WHEN length(replace(x, ' ', '')) >= 5 THEN x ELSE '' END AS norm FROM m),
e AS (SELECT DISTINCT doc_id, pos, norm FROM n WHERE norm <> '' AND (line_no = 0 OR line_no = n.n - 1)),
t AS (SELECT doc_id, count(*) AS n_blocks FROM c WHERE type = 'text' AND len(ls) > 0 GROUP BY doc_id),
p AS (SELECT doc_id, norm, count(*) AS n, any_value(n_blocks) AS n_blocks FROM e JOIN t USING (doc_id) GROUP BY doc_id, norm HAVING count(*) >= 3 AND count(*) / any_value(n_blocks) >= 0.15)"""


def pieces(t) -> DataFrame:
    """Blocks (doc_id, pos, type, text) of three lines of each document."""
    lines = t.documents.select("doc_id", F.split("text", "\n").alias("ls"))
    rows = lines.select("doc_id", "ls", F.explode(F.sequence(F.lit(0), F.floor((F.size("ls") + 2) / 3).cast("int") - 1)).alias("pos"))
    return rows.select("doc_id", "pos", F.when(F.col("pos") % 4 == 3, "table").otherwise("text").alias("type"), F.array_join(F.slice("ls", F.col("pos") * 3 + 1, F.lit(3)), "\n").alias("text"))


@query(PIECES + " SELECT doc_id, norm, n, n_blocks FROM p")
def header_footer_patterns(t):
    return B.header_footer(pieces(t), "doc_id", "pos")


@query(PIECES + """, q AS (SELECT n.*, p.norm IS NOT NULL AS pat, row_number() OVER (PARTITION BY n.doc_id, n.norm ORDER BY pos, line_no) AS nth FROM n LEFT JOIN p USING (doc_id, norm)),
j AS (SELECT doc_id, pos, regexp_replace(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT pat OR nth = 1), '^\\s+|\\s+$', '', 'g') AS text FROM q WHERE doc_id IN (SELECT doc_id FROM p) GROUP BY doc_id, pos)
SELECT doc_id, pos::INT AS pos, text FROM j WHERE text <> ''
UNION ALL SELECT doc_id, pos::INT, text FROM c WHERE type <> 'text' OR doc_id NOT IN (SELECT doc_id FROM p)""")
def strip_header_footer(t):
    return B.strip_header_footer(pieces(t), "doc_id", "pos").select("doc_id", "pos", "text")


RUNS = """
WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx FROM events),
d AS (SELECT *, idx - row_number() OVER (PARTITION BY user_id, event_type ORDER BY idx) AS grp FROM e),
r AS (SELECT user_id, event_type AS title, min(idx) AS start_index, max(idx) AS end_index FROM d GROUP BY user_id, event_type, grp)"""


def event_runs(t):
    e = t.events.select("user_id", "event_id", "event_type").withColumn("idx", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    return e, B.section_runs(e, "user_id", "idx", "event_type")


@query(RUNS + " SELECT user_id, title, start_index, end_index FROM r")
def section_islands(t):
    return event_runs(t)[1].select("user_id", "title", "start_index", "end_index")


@query(RUNS + """ SELECT user_id, title, string_agg(CASE WHEN start_index = end_index THEN start_index::VARCHAR ELSE start_index || '-' || end_index END, ',' ORDER BY start_index) AS ranges FROM r GROUP BY ALL""")
def label_ranges(t):
    runs = event_runs(t)[1].withColumn("part", T.format_range(F.col("start_index"), F.col("end_index")))
    return runs.groupBy("user_id", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_index", "part"))), lambda x: x["part"]), ",").alias("ranges"))


@query("""SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), 'Introduction') AS filled FROM events""")
def forward_fill_labels(t):
    e = t.events.withColumn("label", F.when(F.col("event_type") != "error", F.col("event_type")))
    return B.fill_labels(e, "user_id", "event_id", "label", "Introduction").select("user_id", "event_id", "filled")


@query("""SELECT l_orderkey, l_linenumber, unnest(generate_series(l_linenumber, l_linenumber + l_quantity::INT % 4)::INT[]) AS idx FROM lineitem""")
def index_range_expand(t):
    expr = F.concat_ws("-", F.col("l_linenumber") + F.col("l_quantity").cast("int") % 4, "l_linenumber")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.explode(T.expand_ranges(F.concat(expr, F.lit(",x,"), F.col("l_linenumber").cast("string")))).alias("idx"))


@query("""WITH h AS (SELECT ceil(p_size / 5)::INT AS bin, count(*) AS n FROM part WHERE p_size > 0 GROUP BY 1), b AS (SELECT unnest(generate_series(1, (SELECT max(bin) FROM h)))::INT AS bin)
SELECT (bin - 1) * 5 + 1 AS low, bin * 5 AS high, coalesce(n, 0) AS n FROM b LEFT JOIN h USING (bin)""")
def histogram_by5(t):
    return S.histogram(t.part, "p_size", 5)


@query("SELECT count(*) AS total, count(*) FILTER (n_chars > 0) AS readable, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean, median(n_chars) AS med FROM documents")
def page_stats(t):
    """Counts and means in one pass; the exact median by narrowing ranges."""
    one = t.documents.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n_chars") > 0).alias("readable"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), r6(F.avg("n_chars")).alias("mean"))
    return one.withColumn("med", F.lit(M.median(t.documents, "n_chars")).cast("double"))


@query("SELECT event_type, median(value) AS med, count(*) AS n FROM events GROUP BY event_type")
def medians_by_kind(t):
    """The exact median of each kind of event, the kinds being few."""
    n = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = [(r.event_type, M.median(t.events.where(F.col("event_type").eqNullSafe(F.lit(r.event_type))), "value"), r.n) for r in n.collect()]
    return t.spark.createDataFrame(rows, "event_type string, med double, n long")


@query("SELECT p_partkey, CASE WHEN p_size <= 0 THEN 'unreadable' WHEN p_size < 30 THEN 'keep' ELSE 'overlong' END AS verdict FROM part")
def threshold_split(t):
    return t.part.select("p_partkey", F.when(F.col("p_size") <= 0, "unreadable").when(F.col("p_size") < 30, "keep").otherwise("overlong").alias("verdict"))


@query("""SELECT l_orderkey, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(l_quantity) END, 6) AS std, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY l_orderkey""")
def alignment_stats(t):
    return S.metric_stats(t.lineitem, ["l_orderkey"], "l_quantity").select("l_orderkey", "n", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max")


@query(r"""SELECT event_id, sha1('{"a":{"b":{"c":"' || event_type || '","d":null,"u":' || user_id || '},"y":' || value || '},"z":{"k":' || (props->>'$.k') || '}}') AS config_key FROM events""")
def nested_config(t):
    """Keys of nested configurations, whose records have their fields in any order."""
    inner = F.struct(F.col("user_id").alias("u"), F.lit(None).cast("int").alias("d"), F.col("event_type").alias("c"))
    rows = t.events.select("event_id", F.from_json("props", "k long").alias("z"), F.struct(F.col("value").alias("y"), inner.alias("b")).alias("a"))
    return rows.select("event_id", N.config_key(["z", "a"]).alias("config_key"))


@query("""SELECT sha1('{"l_linestatus":"' || l_linestatus || '","l_returnflag":"' || l_returnflag || '"}') AS config_key, count(*) AS n, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1""")
def config_group(t):
    return t.lineitem.groupBy(N.config_key(["l_returnflag", "l_linestatus"]).alias("config_key")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("l_discount")).alias("mean"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, event_id DESC) = 1")
def latest_record(t):
    return S.latest(t.events, "user_id", [F.desc(F.col("event_type") == "purchase"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


#: Events as records of a log of samples: views are predictions and purchases judgements, errors fail, clicks are
#: predictions of nothing but white space, and sign-ups records of another kind.
RECORDS = """WITH r AS (SELECT user_id AS sample, event_id AS pos, CASE WHEN event_type IN ('view', 'click', 'error') THEN 'pred' WHEN event_type = 'purchase' THEN 'judge' ELSE 'note' END AS kind,
CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, CASE event_type WHEN 'click' THEN chr(10) || chr(9) WHEN 'error' THEN NULL ELSE props END AS prediction FROM events)"""


def records(t: Tables) -> DataFrame:
    e = F.col("event_type")
    kind, text = F.when(e.isin("view", "click", "error"), "pred").when(e == "purchase", "judge").otherwise("note"), F.when(e == "click", "\n\t").when(e != "error", F.col("props"))
    return t.events.select(F.col("user_id").alias("sample"), F.col("event_id").alias("pos"), kind.alias("kind"), F.when(e == "error", "failed").otherwise("success").alias("status"), text.alias("prediction"))


@query(RECORDS + """ SELECT sample, coalesce(bool_or(kind = 'pred'), false) AS pred_done, coalesce(arg_max(status, pos) FILTER (kind = 'pred') = 'success', false) AS pred_success, coalesce(bool_or(kind = 'judge'), false) AS judge_done,
coalesce(arg_max(status, pos) FILTER (kind = 'judge') = 'success', false) AS judge_success, arg_max(prediction, pos) FILTER (kind IN ('pred', 'judge') AND trim(prediction, chr(10) || chr(9) || ' ') <> '') AS prediction FROM r GROUP BY sample""")
def resume_state(t):
    return U.sample_state(records(t), "sample", "pos", "kind", "status", "prediction")


@query(RECORDS + """ SELECT sample, kind, status, prediction, pos FROM r WHERE kind IN ('pred', 'judge') QUALIFY row_number() OVER (PARTITION BY sample ORDER BY kind = 'judge' DESC, pos DESC) = 1""")
def final_records(t):
    """The last judgement of each sample, or else its last prediction."""
    return U.final_records(records(t), "sample", "pos", "kind").select("sample", "kind", "status", "prediction", "pos")


@query("SELECT user_id, event_id FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5")
def head_of_failures(t):
    """The first five failures of each user: the limit is the feature."""
    return S.head(t.events.where("event_type = 'error'").select("user_id", "event_id"), ["user_id"], ["event_id"], 5)


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def todo_antijoin(t):
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left_anti")


@query("""WITH e AS (SELECT source, doc_id AS id, lang FROM documents), a AS (SELECT source, doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND source < 'src-05')
SELECT source, id, lang FROM e WHERE EXISTS (SELECT 1 FROM a WHERE a.source = e.source AND a.id = e.id) OR NOT EXISTS (SELECT 1 FROM a WHERE a.source = e.source)""")
def gt_semi_join(t):
    """Sources without an applied row keep all of theirs."""
    edits = t.documents.select("source", F.col("doc_id").alias("id"), "lang")
    results = labelled(t).select("source", F.col("doc_id").alias("id"), ((F.col("toxic") == 1) & (F.col("source") < "src-05")).alias("applied"))
    return J.applied_edits(edits, results, "source", "id")


@query("SELECT source, count(*) AS paper_total, count(toxic) AS paper_with_eval, sum(toxic)::BIGINT AS hits FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def optional_eval_join(t):
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("paper_total"), F.count("toxic").alias("paper_with_eval"), F.sum("toxic").alias("hits"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS pos FROM conversations)
SELECT a.conv_id, a.pos, length(a.text) AS asked, length(b.text) AS answered FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.pos = b.pos AND a.role = 'user' AND b.role = 'assistant'""")
def position_zip(t):
    r = t.conversations.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).cast("long"))
    a = r.where("role = 'user'").select("conv_id", "pos", F.length("text").cast("long").alias("asked"))
    return a.join(r.where("role = 'assistant'").select("conv_id", "pos", F.length("text").cast("long").alias("answered")), ["conv_id", "pos"])


@query("SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL")
def unique_sections(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))


@query("SELECT conv_id, role, min(turn) AS first_turn, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS merged FROM conversations GROUP BY conv_id, role")
def merge_sections(t):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return t.conversations.groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"), F.array_join(parts, "\n\n").alias("merged"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN q WHEN 1 THEN q WHEN 2 THEN q END AS overall, CASE l_linenumber % 5 WHEN 4 THEN q END AS clarity,
  CASE l_linenumber % 5 WHEN 3 THEN ['Overall', 'Clarity'] WHEN 4 THEN ['Overall'] ELSE ['Clarity'] END AS missing FROM (SELECT *, l_quantity::INT AS q FROM lineitem)""")
def score_extract(t):
    """Scores at a line's start, run into a heading, inside a line with a wide colon, with another maximum, of another label."""
    q, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 5
    forms = [
        F.concat(F.lit("Summary\n### Score- Overall (10): "), q, F.lit(" - fine\nend")), F.concat(F.lit("so far.Or Overall ( 10 )："), q, F.lit(" tail")),
        F.concat(F.lit(" * Overall (10) : "), q, F.lit("\nOverall (10): 99")), F.concat(F.lit("Overall (5): "), q), F.concat(F.lit("Overalls (10): 4\n# score: Clarity (10): "), q),
    ]
    card = T.score_card(chosen(k, forms), {"Overall": 10, "Clarity": 10})
    return t.lineitem.withColumn("card", card).select("l_orderkey", "l_linenumber", F.col("card.parsed")["Overall"].alias("overall"), F.col("card.parsed")["Clarity"].alias("clarity"), "card.missing")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, least(10, l_quantity::INT) AS a, least(5, l_linenumber::INT) AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, count(*) AS reviewers, round(avg(a), 6) AS overall, round(avg(b), 6) AS confidence FROM x WHERE i <= greatest(1, n - 1) GROUP BY l_orderkey""")
def score_multi_avg(t):
    """The i-th scores of each label are one reviewer's; the last reviewer of several gives no confidence."""
    q, i, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber"), F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))
    last = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) == F.greatest(n, F.lit(2))
    line = F.concat(F.lit("text\n- Overall (10)："), q, F.lit(" - why\nOverall (10): 3\n"), F.when(last, "").otherwise(F.concat(F.lit(" - Confidence (5): "), i.cast("string"), F.lit("\n"))))
    rows = t.lineitem.withColumn("line", line)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "line"))), lambda x: x["line"]), "")
    each = rows.groupBy("l_orderkey").agg(text.alias("text")).select("l_orderkey", F.explode(R.reviewers(F.col("text"), {"Overall": 10, "Confidence": 5})).alias("r"))
    return each.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("reviewers"), r6(F.avg("r.Overall")).alias("overall"), r6(F.avg("r.Confidence")).alias("confidence"))


@query(r"SELECT page_id, regexp_replace(regexp_extract(html, '<title>((?s:.*?))</title>', 1), '^\s+|\s+$', '', 'g') AS title, url AS padded, '' AS none FROM pages")
def tag_extract(t):
    """A tag of the page, one with white space of all kinds around its text and another after it, and none."""
    padded = F.concat(F.lit("x <t>\n\t\u00a0"), "url", F.lit("\u2003\r\n</t><t>more</t>"))
    return t.pages.select("page_id", T.first_tag(F.col("html"), "title").alias("title"), T.first_tag(padded, "t").alias("padded"), T.first_tag(F.col("url"), "t").alias("none"))


@query("""WITH x AS (SELECT lang, sum(toxic)::BIGINT AS d, sum(1 - toxic)::BIGINT AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, d, n, round(d / (d + n), 6) AS drop_rate, round((d / sum(d) OVER () + 1e-9) / (n / sum(n) OVER () + 1e-9), 6) AS lift FROM x""")
def drop_rate_lift(t):
    out = S.drop_rate_lift(labelled(t), "lang", F.col("toxic") == 1)
    return out.select("lang", "d", "n", r6("drop_rate").alias("drop_rate"), r6("lift").alias("lift"))


@query(f"SELECT toxic, lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY toxic), 6) AS share FROM {LABELLED} GROUP BY toxic, lang")
def bucket_counts_pct(t):
    return S.bucket_shares(labelled(t), "toxic", "lang").select("toxic", "lang", "n", r6("share").alias("share"))


@query("SELECT source, count(*) AS n, min(doc_id) AS first_pos FROM documents GROUP BY source ORDER BY n DESC, first_pos LIMIT 10")
def topn_stable_ties(t):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_pos")).orderBy(F.desc("n"), "first_pos").limit(10)


@query("SELECT event_id, CASE WHEN event_id % 9 = 4 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 9 = 7 AS nan FROM events")
def json_extract(t):
    """JSON alone, in noise, before other braces, before further ends, none, with a repeated key, with NaN, and with more behind it."""
    p, k = F.col("props"), F.col("event_id") % 9
    inner = F.substr(p, F.lit(2))
    text = F.when(k == 0, F.concat(F.lit("\n"), p)).when(k == 1, F.concat(F.lit("Here it is: "), p, F.lit(" -- end}"))).when(k == 2, F.concat(F.lit("a "), p, F.lit(' and {"j": 1} b')))
    text = text.when(k == 3, F.concat(p, F.lit("}}"))).when(k == 4, "none {here").when(k == 5, F.concat(p, F.lit("}"))).when(k == 6, F.concat(F.lit('{"k": null, "k": [1], '), inner))
    text = text.when(k == 7, F.concat(F.lit('say {"n": NaN, '), inner)).otherwise(F.concat(p, F.lit(" tail")))
    out = t.events.select("event_id", P.embedded_json(text).alias("v"))
    return out.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.coalesce(F.isnan(F.try_variant_get("v", "$.n", "double")), F.lit(False)).alias("nan"))


@query("SELECT doc_id, round(0.6 * quality + 0.4 * (1 - toxic), 6) AS reward FROM labels")
def reward_score(t):
    return t.labels.select("doc_id", r6(N.reward(F.col("quality"), 1 - F.col("toxic"))).alias("reward"))


@query("""WITH h AS (SELECT *, event_id > (SELECT max(event_id) // 2 FROM events) AS late FROM events),
a AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_id FROM h WHERE NOT late GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_id FROM h WHERE late AND value > 150 GROUP BY ALL)
SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND b.event_type = a.event_type) UNION ALL SELECT * FROM b""")
def upsert_runs(t):
    """Runs of the later half of the log take the place of the earlier half's with the same key."""
    half = t.events.agg(F.floor(F.max("event_id") / 2).alias("half"))
    rows = t.events.join(half).withColumn("late", F.col("event_id") > F.col("half"))
    old, new = (rows.where(c).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id")) for c in ("not late", "late and value > 150"))
    return S.upsert(old, new, ["user_id", "event_type"])


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS g FROM lineitem),
u AS (SELECT l_orderkey, count(*) AS n, coalesce(list(DISTINCT g) FILTER (g IS NOT NULL), []) AS used FROM x GROUP BY 1),
f AS (SELECT l_orderkey, [v for v in range(1, n + len(used) + 1) if NOT list_contains(used, v)] AS free FROM u)
SELECT l_orderkey, l_linenumber, coalesce(g, free[row_number() OVER (PARTITION BY l_orderkey, g IS NULL ORDER BY l_linenumber)])::INT AS fixed_id FROM x JOIN f USING (l_orderkey)""")
def id_repair(t):
    """Every order, with gaps and repeats between its line numbers."""
    x = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")).alias("g"))
    return S.repair_ids(x, "l_orderkey", "l_linenumber", "g").select("l_orderkey", "l_linenumber", "fixed_id")


@query(r"SELECT doc_id, regexp_replace(CASE WHEN contains(text, '---') THEN string_split(text, '---')[1] ELSE text END, '^\s+|\s+$', '', 'g') AS body FROM documents")
def markers_between(t):
    text = F.concat(F.lit("rules --- ### Text ###\n"), F.col("text"), F.lit("\n--- more ### Text ### tail"))
    return t.documents.select("doc_id", T.between_markers(text, "### Text ###", "---").alias("body"))


@query("""WITH x AS (SELECT o_orderkey AS k, 2000 + o_orderkey % 20 AS y, o_orderkey % 50 AS n, o_orderkey % 7 AS f FROM orders)
SELECT k AS o_orderkey, list_distinct_ordered AS keys FROM (SELECT k, CASE f
  WHEN 0 THEN ['smith|' || y, n::VARCHAR] WHEN 1 THEN ['o-neil|' || y, 'lee|' || y, '0'] WHEN 2 THEN [n::VARCHAR] WHEN 3 THEN ['lecun|' || y, 'lecun|' || (y + 1)]
  WHEN 4 THEN CASE WHEN n = 12 THEN ['rajabi|' || y, '12'] ELSE ['rajabi|' || y, '12', n::VARCHAR] END ELSE []::VARCHAR[] END AS list_distinct_ordered FROM x)""")
def citation_match(t):
    k, y, n = F.col("o_orderkey"), (2000 + F.col("o_orderkey") % 20).cast("string"), (F.col("o_orderkey") % 50).cast("string")
    forms = [
        F.concat(F.lit("As Smith  et al.,\n"), y, F.lit(" and [0"), n, F.lit("], then [00"), n, F.lit("] say")),
        F.concat(F.lit("Lee&Kim,"), y, F.lit("; O-Neil et al., "), y, F.lit("; O-Neil and Wu , "), y, F.lit("; [000]")),
        F.concat(F.lit("van Smith et al. "), y, F.lit(" lacks a comma, smith et al., "), y, F.lit(" a capital [x1] ["), n, F.lit("] ok")),
        F.concat(F.lit("LeCun et al., "), y, F.lit(" LECUN et al., "), y, F.lit(" LeCun and Bengio, "), (2001 + F.col("o_orderkey") % 20).cast("string")),
        F.concat(F.lit("Rajabi & Kosecka, "), y, F.lit(" [12] [012] ["), n, F.lit("]")),
        F.lit("no citation [a] (1999) Smith 2001"), F.lit(None).cast("string"),
    ]
    return t.orders.select("o_orderkey", T.citation_keys(chosen(k % 7, forms)).alias("keys"))


@query("""WITH x AS (SELECT l_orderkey, count(*) AS n, l_orderkey % 4 AS form, sum(500 + l_linenumber) AS size FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN form = 3 OR n = 1 THEN 1 ELSE n END AS parts, CASE form WHEN 0 THEN size WHEN 1 THEN size + 13 * n WHEN 2 THEN size + 23 * n ELSE 10 * n + 12 * (n - 1) END::BIGINT AS chars FROM x""")
def multi_review_split(t):
    """Reviews between rules, under numbered headings, from Summary to Summary, and too short to be told apart."""
    form = F.col("l_orderkey") % 4
    body = F.expr("repeat(l_returnflag, 500 + l_linenumber)")
    part = F.when(form == 0, body).when(form == 1, F.concat(F.lit("Reviewer #1:\n"), body)).when(form == 2, F.concat(F.lit("## Summary\n"), body, F.lit("\n### Overall"))).otherwise("ten chars.")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", part.alias("x")))), lambda x: x["x"])
    joined = F.when(form.isin(0, 3), F.array_join(parts, "\n----------\n")).otherwise(F.array_join(parts, "\n\n"))
    reviews = t.lineitem.groupBy("l_orderkey").agg(joined.alias("text")).select("l_orderkey", T.split_reviews(F.col("text")).alias("ts"))
    return reviews.select("l_orderkey", F.size("ts").cast("long").alias("parts"), F.expr("aggregate(ts, 0L, (a, x) -> a + length(x))").alias("chars"))


@query("""WITH n AS (SELECT conv_id, turn AS edit, substr(text, 6, 15) AS needle FROM conversations),
p AS (SELECT n.conv_id, edit, needle, c.turn AS pos, instr(c.text, needle) AS spot, c.text FROM n JOIN conversations c ON n.conv_id = c.conv_id AND needle <> '' AND instr(c.text, needle) > 0
  QUALIFY row_number() OVER (PARTITION BY n.conv_id, edit ORDER BY c.turn) = 1)
SELECT conv_id, edit, pos, (spot - 1)::BIGINT AS "offset", substr(text, greatest(1, spot - 120), spot - greatest(1, spot - 120)) AS before, substr(text, spot + length(needle), 120) AS after FROM p""")
def first_offset_context(t):
    needles = t.conversations.select("conv_id", F.col("turn").alias("edit"), F.substring("text", 6, 15).alias("needle"))
    hits = J.first_containing(t.conversations, needles, "conv_id", "turn", "text", "needle").where("pos is not null")
    return hits.select("conv_id", "edit", "pos", F.col("offset").cast("long").alias("offset"), "before", "after")


@query("""WITH n AS (SELECT DISTINCT conv_id, substr(text, 1, 6) AS needle FROM conversations WHERE text <> '')
SELECT n.conv_id, needle, min(c.turn) AS pos FROM n JOIN conversations c ON n.conv_id = c.conv_id AND contains(c.text, needle) GROUP BY ALL""")
def containment_join(t):
    needles = t.conversations.where("text <> ''").select("conv_id", F.substring("text", 1, 6).alias("needle")).distinct()
    return J.first_containing(t.conversations, needles, "conv_id", "turn", "text", "needle").select("conv_id", "needle", "pos")


@query(RUNS + """, f AS (SELECT user_id, min(start_index) AS s, arg_min(end_index, start_index) AS e FROM r WHERE contains(lower(title), 'click') GROUP BY user_id)
SELECT user_id, idx, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx FROM events) JOIN f USING (user_id) WHERE idx BETWEEN s AND e""")
def section_slice(t):
    events, runs = event_runs(t)
    return J.in_first_run(events, runs, "user_id", "idx", "Click").select("user_id", "idx", "event_id")


@query("SELECT kind, count(*) AS n FROM (SELECT 'toxic' AS kind FROM labels WHERE toxic = 1 UNION ALL SELECT 'poor' FROM labels WHERE quality = 0) GROUP BY kind")
def grouped_error_distribution(t):
    kinds = F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "poor")))
    return t.labels.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT *, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
y AS (SELECT l_orderkey, i, n, CASE WHEN q = 50 THEN 'missing fields' WHEN l_returnflag = 'R' AND q > 30 THEN 'corruption_type' WHEN q = 49 THEN 'difficulty' WHEN q = 48 THEN 'needs_cross_section' WHEN q = 47 THEN 'location' WHEN q = 46 THEN 'location too long'
  WHEN q = 45 THEN 'rationale' WHEN q = 44 THEN 'error_explanation' WHEN q = 43 THEN 'error_explanation too long' WHEN q = 42 THEN 'target_find' WHEN q = 41 THEN 'target_find too long' WHEN q = 40 THEN 'replacement' WHEN q = 39 THEN 'replacement too long'
  WHEN row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 5 ORDER BY i) > 1 THEN 'duplicate id' END AS fault FROM x)
SELECT l_orderkey, CASE WHEN any_value(n) > 6 THEN 'count' ELSE arg_min(fault, i) FILTER (fault IS NOT NULL) END AS fault FROM y GROUP BY l_orderkey""")
def edit_validator(t):
    """Every fault of an edit, by a line's quantity."""
    q = F.col("l_quantity").cast("int")
    odd = lambda blank, long, size, good: F.when(q == blank, "\n ").when(q == long, F.repeat(F.lit("x"), size)).otherwise(good)
    fields = {
        "id": F.col("l_linenumber") % 5, "corruption_type": F.when((F.col("l_returnflag") == "R") & (q > 30), "other").otherwise("swap"), "difficulty": F.when(q == 49, "odd").otherwise("easy"),
        "location": odd(47, 46, 101, "Methods"), "rationale": F.when(q == 45, "").when(q != 50, "r"), "error_explanation": odd(44, 43, 2001, "e"), "target_find": odd(42, 41, 2001, "f"),
    }
    plain = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    replacement = F.when(q == 40, "7").when(q == 39, F.concat(F.lit('"'), F.repeat(F.lit("x"), 2001), F.lit('"'))).otherwise('""')
    edit = F.concat(F.substr(plain, F.lit(1), F.length(plain) - 1), F.lit(',"needs_cross_section":'), F.when(q == 48, '"yes"').otherwise("true"), F.lit(',"replacement":'), replacement, F.lit("}")).alias("edit")
    orders = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", edit))).alias("e"))
    parsed = orders.select("l_orderkey", F.transform("e", lambda x: F.parse_json(x["edit"])).alias("edits"))  # once, though edit_fault() names them often
    return parsed.select("l_orderkey", C.edit_fault(F.col("edits"), ["swap"], 1, 6).alias("fault"))


@query("""WITH b AS (SELECT p_partkey, p_size AS w, p_partkey % 7 AS l, p_partkey % 4 AS u FROM part)
SELECT p_partkey, greatest(l, u, 24 - w, 1) <= 2 OR (l / w <= 0.1 AND u / 40 <= 0.1 AND greatest(0, 24 - w) / w <= 0.1) AS inside FROM b""")
def bbox_containment(t):
    outer = X.box(F.lit(0), F.lit(0), F.col("p_size"), F.lit(40))
    inner = X.box(-(F.col("p_partkey") % 7), -(F.col("p_partkey") % 4), F.lit(24), F.lit(41))
    return t.part.select("p_partkey", X.contains(outer, inner).alias("inside"))


@query()
def token_counts(t):
    """The tokens of every whole text, and the text cut to fifty of them; estimates where no vocabulary is installed."""
    path, text = K.installed("byte_bpe_50k.tiktoken"), F.coalesce("text", F.lit(""))
    cut = F.substring(text, 1, 175) if path is None else K.cut_to_tokens(text, 50, path)
    return t.documents.select("doc_id", K.token_count(text, path).alias("tokens"), K.token_count(text).alias("estimate"), F.sha1(cut).alias("cut_sha1"))


def queries() -> dict:
    from quillframe.plans import detection, papers, regressions, replies, runs, scans, training  # noqa: F401  they register themselves

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
