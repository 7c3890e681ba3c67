"""Queries on ground truths, findings and matches. Carriers: orders and their lines, labelled documents, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import parse as P
from quillframe.functions import text as T
from quillframe.operators import checks as C
from quillframe.operators import detection as D
from quillframe.operators import matching as J
from quillframe.operators import model as M
from quillframe.operators import scoring as S
from quillframe.plans.registry import query, r6

#: Lines of an order with a place that no tie leaves open.
LINES = "x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"


def lines(t):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey")
    return t.lineitem.withColumns({"i": F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")), "n": F.count(F.lit(1)).over(w)})


@query(f"""WITH {LINES}, a AS (SELECT l_orderkey, i FROM x WHERE l_returnflag = 'A')
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY i)::INT AS id, 'easy' AS difficulty, l_shipmode AS section_location, CASE WHEN i % 2 = 0 THEN '' ELSE l_shipinstruct END AS error_location, l_returnflag AS explanation, CASE WHEN i % 3 > 0 THEN i % 3 = 1 END AS needs_cross_section
FROM (SELECT *, 'm' || l_linenumber AS l_shipmode, 's' || l_partkey AS l_shipinstruct FROM x) x WHERE EXISTS (SELECT 1 FROM a WHERE a.l_orderkey = x.l_orderkey AND a.i = x.i) OR NOT EXISTS (SELECT 1 FROM a WHERE a.l_orderkey = x.l_orderkey)""")
def ground_truths(t):
    rows = lines(t)
    i = F.col("i")
    edits = rows.select(
        "l_orderkey", i.alias("n"), i.alias("id"), F.lit("easy").alias("difficulty"), F.concat(F.lit(" m"), "l_linenumber", F.lit("\n")).alias("location"),
        F.when(i % 4 == 2, "  ").when(i % 2 == 0, None).otherwise(F.concat(F.lit("\ts"), "l_partkey")).alias("target_find"), F.concat(F.lit(" "), "l_returnflag").alias("error_explanation"), F.when(i % 3 > 0, i % 3 == 1).alias("needs_cross_section"),
    )
    results = rows.select("l_orderkey", i.alias("id"), (F.col("l_returnflag") == "A").alias("applied"))
    return D.truths(edits, results, "l_orderkey", "n")


@query(f"""WITH {LINES} SELECT l_orderkey, '[' || string_agg('{{"id":' || i || ',"difficulty":' || CASE WHEN l_returnflag = 'R' THEN 'null' ELSE '"' || l_returnflag || '"' END || '}}', ',' ORDER BY i) || ']' AS truths FROM x GROUP BY l_orderkey""")
def judge_projection(t):
    rows = lines(t).withColumn("difficulty", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")))
    listed = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("id"), "difficulty", "l_suppkey"))).alias("items"))
    return listed.select("l_orderkey", D.minimal(F.col("items"), ["id", "difficulty"]).alias("truths"))


@query(f"""WITH {LINES}, m AS (SELECT l_orderkey, i, l_quantity > 25 AS matched FROM x WHERE i <= 4), g AS (SELECT l_orderkey, i, l_returnflag AS difficulty, 'p' || l_partkey AS error_location FROM x WHERE i % 3 > 0)
SELECT m.l_orderkey, m.i, matched, difficulty, error_location FROM m LEFT JOIN g ON m.l_orderkey = g.l_orderkey AND m.i = g.i""")
def enriched_matches(t):
    rows = lines(t)
    matches = rows.where("i <= 4").select("l_orderkey", "i", (F.col("l_quantity") > 25).alias("matched"))
    truths = rows.where("i % 3 > 0").select("l_orderkey", "i", F.col("l_returnflag").alias("difficulty"), F.lit("s").alias("section_location"), F.concat(F.lit("p"), "l_partkey").alias("error_location"), F.lit("e").alias("explanation"), F.lit(True).alias("needs_cross_section"))
    return D.enriched(matches, truths, "l_orderkey", "i").select("l_orderkey", "i", "matched", "difficulty", "error_location")


SCORED = f"""WITH {LINES}, p AS (SELECT l_orderkey, count(*) AS gt, count(*) FILTER (l_quantity > 25) AS hits FROM x GROUP BY l_orderkey),
d AS (SELECT l_orderkey, count(DISTINCT k) AS matched_preds FROM (SELECT l_orderkey, unnest([l_linenumber % 3, l_partkey % 4]) AS k FROM x WHERE l_quantity > 10) GROUP BY l_orderkey),
f AS (SELECT l_orderkey, count(*) AS findings FROM x WHERE l_returnflag <> 'N' GROUP BY l_orderkey),
c AS (SELECT l_orderkey, gt, hits, coalesce(matched_preds, 0) AS matched_preds, coalesce(findings, 0) AS findings FROM p LEFT JOIN d USING (l_orderkey) LEFT JOIN f USING (l_orderkey)),
s AS (SELECT *, hits / gt AS recall, CASE WHEN findings = 0 THEN 0 ELSE matched_preds / findings END AS prec FROM c),
z AS (SELECT *, CASE WHEN prec + recall = 0 THEN 0 ELSE 2 * prec * recall / (prec + recall) END AS f1 FROM s)"""


def scored(t):
    """Matches that name findings, some of them twice, and findings that may be fewer than are named."""
    rows = lines(t)
    named = F.when(F.col("l_quantity") > 10, F.array((F.col("l_linenumber") % 3).cast("int"), (F.col("l_partkey") % 4).cast("int"))).otherwise(F.array().cast("array<int>"))
    matches = rows.select("l_orderkey", (F.col("l_quantity") > 25).alias("matched"), named.alias("matched_pred_indices"))
    return S.per_paper_scores(D.paper_counts(matches, rows.where("l_returnflag <> 'N'"), "l_orderkey"))


@query(SCORED + " SELECT l_orderkey, gt, hits, matched_preds, findings, round(recall, 6) AS recall, round(prec, 6) AS precision, round(f1, 6) AS f1 FROM z")
def distinct_matched_scores(t):
    return scored(t).withColumns({c: r6(F.col(c)) for c in ("recall", "precision", "f1")})


@query(f"""WITH {LINES}, k AS (SELECT l_orderkey, i, n, l_quantity > 25 AS m, CASE l_suppkey % 4 WHEN 0 THEN l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 99 ELSE l_linenumber - 2 END AS g FROM x),
u AS (SELECT *, CASE WHEN g BETWEEN 0 AND n - 1 THEN g WHEN g = n THEN n - 1 END AS idx FROM k),
w AS (SELECT *, coalesce(idx, count(*) FILTER (idx IS NULL) OVER (PARTITION BY l_orderkey ORDER BY i) - 1) AS spot FROM u),
h AS (SELECT DISTINCT l_orderkey, spot FROM w WHERE m)
SELECT x.l_orderkey, list(h.spot IS NOT NULL ORDER BY x.i) AS flags FROM x LEFT JOIN h ON x.l_orderkey = h.l_orderkey AND h.spot = x.i - 1 GROUP BY x.l_orderkey""")
def hit_flags(t):
    """Indices from 0 or 1, missing ones, and ones that are no place."""
    k, n = F.col("l_suppkey") % 4, F.col("l_linenumber")
    g = F.when(k == 0, n).when(k == 2, 99).when(k == 3, n - 2)
    of = lines(t).groupBy("l_orderkey", "n").agg(F.array_sort(F.collect_list(F.struct("i", g.cast("int").alias("gt_index"), (F.col("l_quantity") > 25).alias("matched")))).alias("ms"))
    return of.select("l_orderkey", J.hit_flags(F.col("ms"), F.col("n").cast("int")).alias("flags"))


@query(SCORED + """, v AS (SELECT *, l_orderkey % 6 AS form FROM z), r AS (SELECT l_orderkey, CASE WHEN form = 5 THEN 0 ELSE gt END AS gt, CASE WHEN form = 4 THEN 0 ELSE findings END AS findings, CASE WHEN form = 3 THEN 7 WHEN form = 2 THEN 0 ELSE matched_preds END AS matched_preds,
  CASE WHEN form = 1 THEN 0.25 WHEN form IN (2, 5) THEN 0 ELSE recall END AS recall, form FROM v),
q AS (SELECT *, CASE WHEN form = 1 THEN 1 WHEN findings = 0 THEN 0 ELSE matched_preds / findings END AS prec FROM r)
SELECT l_orderkey, gt, findings, matched_preds, round(recall, 6) AS recall, round(prec, 6) AS precision, round(CASE WHEN form = 0 THEN 0.5 WHEN prec + recall = 0 THEN 0 ELSE 2 * prec * recall / (prec + recall) END, 6) AS f1 FROM q""")
def stored_or_derived_scores(t):
    """Evaluations that store all, some or none of their figures, or as words."""
    rows = lines(t)
    named = F.when(F.col("l_quantity") > 10, F.array((F.col("l_linenumber") % 3).cast("int"), (F.col("l_partkey") % 4).cast("int"))).otherwise(F.array().cast("array<int>"))
    match = F.struct((F.col("l_quantity") > 25).alias("matched"), named.alias("matched_pred_indices"))
    e = rows.groupBy("l_orderkey").agg(F.collect_list(match).alias("matches"), F.count(F.lit(1)).alias("gt"), F.count_if(F.col("l_returnflag") != "N").alias("findings")).withColumn("form", F.col("l_orderkey") % 6)
    form = F.col("form")
    gt = F.when(form == 5, '"many"').otherwise(F.col("gt").cast("string"))
    fields = [
        F.concat(F.lit('"ground_truth_count":'), gt), F.when(form != 4, F.concat(F.lit('"finding_count":'), F.col("findings").cast("string"))),
        F.when(form == 3, '"matched_pred_count":7'), F.when(form == 1, '"detection_rate":0.25,"precision":1'), F.when(form == 0, '"f1_score":0.5'), F.when(form == 5, '"precision":"high"'),
        F.when(form != 2, F.concat(F.lit('"matches":'), F.to_json("matches"))).otherwise('"matches":"none"'),
    ]
    v = F.parse_json(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
    out = D.stored_or_derived(e.select("l_orderkey", v.alias("v"))).drop("v")
    return out.withColumns({c: r6(F.col(c)) for c in ("recall", "precision", "f1")})


@query(f"""WITH {LINES}, p AS (SELECT l_orderkey, l_orderkey % 3 AS form, count(*) FILTER (l_returnflag = 'A') AS applied FROM x GROUP BY l_orderkey)
SELECT l_orderkey, list('t' || l_suppkey % 5 || '/' || l_returnflag || '/' || CASE WHEN i % 2 = 0 THEN 'Methods' ELSE 'p' || l_partkey % 3 END || '/' || (i % 4 = 1) ORDER BY i) FILTER (l_suppkey % 5 > 0 AND i % 7 > 0 AND ((form = 0 AND applied > 0 AND l_returnflag = 'A') OR (form = 0 AND applied = 0 AND i % 2 = 0) OR (form = 1 AND i % 2 = 0) OR form = 2)) AS items FROM x JOIN p USING (l_orderkey) GROUP BY l_orderkey""")
def truth_sources(t):
    """Papers with applied results, with a list of ground truths, and with a log of edits only."""
    i, form = F.col("i"), F.col("l_orderkey") % 3
    item = F.struct(
        F.when(F.col("l_suppkey") % 5 > 0, F.concat(F.lit(" t"), F.col("l_suppkey") % 5)).otherwise(" ").alias("type"), F.col("l_returnflag").alias("difficulty"), F.when(i % 7 == 0, " ").when(i % 2 == 0, "Methods").alias("location"),
        F.when(i % 2 == 1, F.concat(F.lit("p"), F.col("l_partkey") % 3)).alias("section_location"), F.when(i % 4 == 1, True).alias("needs_cross_section"), (F.col("l_returnflag") == "A").alias("applied"),
    )
    p = lines(t).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("i", item.alias("e")))).alias("es")).withColumn("form", F.col("l_orderkey") % 3)
    js = lambda xs: F.to_json(F.transform(xs, lambda x: x["e"]))
    even = js(F.filter("es", lambda x: x["i"] % 2 == 0))
    text = F.when(F.col("form") == 0, F.concat(F.lit('{"apply_results":'), js(F.col("es")), F.lit(',"ground_truth":'), even, F.lit("}"))).when(F.col("form") == 1, F.concat(F.lit('{"ground_truth":'), even, F.lit(',"audit_log":{"edits":[]}}')))
    v = F.parse_json(F.coalesce(text, F.concat(F.lit('{"apply_results":5,"audit_log":{"edits":'), js(F.col("es")), F.lit("}}"))))
    p = p.select("l_orderkey", v.alias("v"))  # parsed once, though truth_items() names it often
    got = F.transform(D.truth_items(F.col("v")), lambda g: F.concat_ws("/", g["corruption_type"], g["difficulty"], g["location"], g["needs_cross_section"].cast("string")))
    return p.select("l_orderkey", T.bound(got, lambda x: F.when(F.size(x) > 0, x)).alias("items"))


FOUND = f"""WITH {LINES}, f AS (SELECT l_orderkey, i, CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 'k' || l_suppkey % 4 END AS type, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'S' || l_partkey % 3 END AS place, i % 5 > 0 AS whole, CASE WHEN i % 4 = 0 THEN 0.5 WHEN i % 4 = 1 THEN 1.0 ELSE round(l_discount, 2) END AS confidence FROM x)"""


def answers(t):
    """An answer a order: findings with blank types, places and explanations, and confidence as number, word or too large."""
    i = F.col("i")
    said = F.when(i % 4 == 0, F.lit('"sure"')).when(i % 4 == 1, F.lit("7")).when(i % 4 == 2, F.round("l_discount", 2).cast("string")).otherwise(F.concat(F.lit('"'), F.round("l_discount", 2).cast("string"), F.lit('"')))
    type_ = F.when(F.col("l_suppkey") % 4 == 0, " ").otherwise(F.concat(F.lit(" k"), F.col("l_suppkey") % 4))
    place = F.when(F.col("l_partkey") % 3 == 0, " ").otherwise(F.concat(F.lit("S"), F.col("l_partkey") % 3))
    fields = F.struct(type_.alias("type"), place.alias("section_location"), F.lit("here").alias("error_location"), F.when(i % 5 > 0, F.lit("why")).alias("explanation"))
    plain = F.to_json(fields)
    text = F.concat(F.substr(plain, F.lit(1), F.length(plain) - 1), F.lit(',"confidence":'), said, F.lit("}"))
    listed = lines(t).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("i", text.alias("f")))).alias("fs"))
    joined = F.array_join(F.transform("fs", lambda x: x["f"]), ",")
    whole = F.when(F.size("fs") == 1, joined).otherwise(F.concat(F.lit("["), joined, F.lit(",5]")))
    return listed.select("l_orderkey", F.parse_json(F.concat(F.lit('{"findings":'), whole, F.lit("}"))).alias("v"))


def _flat(found):
    return F.transform(found, lambda f: F.concat_ws("|", f["type"], f["section_location"], f["explanation"], F.format_number(f["confidence"], 2)))


@query(FOUND + """ SELECT l_orderkey, coalesce(list(coalesce(nullif(type, ''), 'other') || '|' || place || '|why|' || printf('%.2f', confidence) ORDER BY i) FILTER (whole AND place <> ''), []) AS plain,
  coalesce(list(coalesce(nullif(type, ''), 'other') || '|' || coalesce(nullif(place, ''), 'Intro') || '|why|' || printf('%.2f', confidence) ORDER BY i) FILTER (whole), []) AS of_section,
  coalesce(list(type || '|' || place || '|why|' || printf('%.2f', confidence) ORDER BY i) FILTER (whole AND place <> '' AND type <> ''), []) AS merged FROM f GROUP BY l_orderkey""")
def parsed_findings(t):
    """The findings of an answer are read once, whatever stands for what they lack."""
    read, f = answers(t).select("l_orderkey", D.read_findings(F.col("v")).alias("fs")), F.col("fs")
    return read.select("l_orderkey", _flat(D.kept_findings(f)).alias("plain"), _flat(D.kept_findings(f, section=F.lit("Intro"))).alias("of_section"), _flat(D.kept_findings(f, default_type=None)).alias("merged"))


@query(f"""WITH {LINES} SELECT l_orderkey, list(CASE WHEN i % 2 = 0 THEN 'id' || i ELSE 'task_' || lpad(i::VARCHAR, 3, '0') END || '|' || CASE WHEN i % 3 = 0 THEN 'Section ' || i ELSE 'S' END || '|' || CASE WHEN l_returnflag = 'R' THEN 'other' ELSE l_returnflag END || '|' || CASE i % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN 'x,y' ELSE '' END || '|' || CASE WHEN i % 5 = 0 THEN '1,2' ELSE '' END ORDER BY i) AS tasks FROM x GROUP BY l_orderkey""")
def planner_tasks(t):
    i = F.col("i")
    fields = F.concat_ws(
        ",", F.when(i % 2 == 0, F.concat(F.lit('"task_id":"id'), i, F.lit('"'))), F.when(i % 3 > 0, '"section":"S"'), F.concat(F.lit('"risk_dimension":"'), F.col("l_returnflag"), F.lit('"')),
        F.when(i % 4 == 0, '"hints":["a","b"]').when(i % 4 == 1, '"hints":{"p":"x","q":"y"}').when(i % 4 == 2, '"hints":5'), F.when(i % 5 == 0, '"pages":[1,2]'),
    )
    rows = lines(t).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("i", F.concat(F.lit("{"), fields, F.lit("}")).alias("t")))).alias("ts"))
    v = F.parse_json(F.concat(F.lit('{"tasks":['), F.array_join(F.transform("ts", lambda x: x["t"]), ","), F.lit("]}")))
    return rows.select("l_orderkey", F.transform(D.tasks(v, ["A", "N"]), lambda x: F.concat_ws("|", x["task_id"], x["section"], x["risk_dimension"], F.array_join(x["hints"], ","), F.array_join(x["pages"].cast("array<string>"), ","))).alias("tasks"))


@query(r"""SELECT event_id, ['paper ' || user_id] || CASE event_id % 3 WHEN 0 THEN ['[WEB] Q: ' || event_type || chr(10) || 'A: ' || user_id] WHEN 1 THEN ['[WEB] ' || user_id] ELSE [] END AS evidence FROM events""")
def evidence_union(t):
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 3
    web = D.web_evidence(F.when(k == 0, F.concat(F.lit(" "), "event_type")), F.when(k < 2, F.concat(u, F.lit("\n"))).otherwise(" "))
    return t.events.select("event_id", D.all_evidence(F.array(F.concat(F.lit("paper "), u)), F.array(web)).alias("evidence"))


@query("SELECT phase_no, phase, event_id FROM (SELECT 0 AS phase_no, 'global' AS phase, event_id FROM events WHERE value > 100 UNION ALL SELECT 1, 'section', event_id FROM events WHERE event_type = 'click' UNION ALL SELECT 2, 'specialist', event_id FROM events WHERE value > 100)")
def phase_union(t):
    e = t.events.select("event_id", "value", "event_type")
    return D.phases({"global": e.where("value > 100"), "section": e.where("event_type = 'click'"), "specialist": e.where("value > 100").drop("event_type")}, "event_id").select("phase_no", "phase", "event_id")


@query("""WITH f AS (SELECT user_id, event_type, list(event_id ORDER BY event_id) AS prior FROM events WHERE value > 150 GROUP BY ALL)
SELECT t.user_id, t.event_type, coalesce(f.prior, []) AS prior FROM (SELECT DISTINCT user_id, event_type FROM events) t LEFT JOIN f USING (user_id, event_type)""")
def prior_findings(t):
    tasks = t.events.select("user_id", "event_type").distinct()
    out = D.with_prior(tasks, t.events.where("value > 150"), "user_id", "event_type", "event_id", ["event_id"])
    return out.select("user_id", "event_type", F.col("prior.event_id").alias("prior"))


@query(FOUND + ", a AS (SELECT l_orderkey, list(i ORDER BY i) AS given, list(i ORDER BY i) FILTER (whole AND place <> '') AS merged FROM f GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 AND merged IS NOT NULL THEN merged ELSE given END AS kept FROM a")
def merge_fallback(t):
    i = F.col("i")
    whole = (i % 5 > 0) & (F.col("l_partkey") % 3 > 0)
    rows = lines(t).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("i")).alias("given"), F.array_sort(F.collect_list(F.when(whole, i))).alias("merged"))
    merged = F.when(F.col("l_orderkey") % 2 == 0, F.col("merged"))
    return rows.select("l_orderkey", D.merged_or_given(F.col("given"), merged).alias("kept"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS ok, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus = 'P') AS skipped FROM orders")
def batch_summary(t):
    status = F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "failed").otherwise("skipped")
    return D.batch_summary(t.orders, status)


@query(f"""WITH {LINES}, m AS (SELECT l_orderkey, i, n, CASE l_suppkey % 6 WHEN 0 THEN 'missing fields' WHEN 1 THEN 'gt_index' WHEN 2 THEN 'matched' WHEN 3 THEN 'matched_pred_indices' WHEN 4 THEN 'rationale' END AS fault FROM x)
SELECT l_orderkey, CASE WHEN l_orderkey % 9 = 0 THEN 'count' ELSE arg_min(fault, i) FILTER (fault IS NOT NULL) END AS fault FROM m GROUP BY l_orderkey""")
def match_validator(t):
    k, i = F.col("l_suppkey") % 6, F.col("i")
    index = F.when(k == 1, (i + 7).cast("string")).when(i % 2 == 0, (i - 1).cast("string")).otherwise(i.cast("string"))
    fields = F.concat_ws(
        ",", F.concat(F.lit('"gt_index":'), index), F.when(k != 0, F.when(k == 2, '"matched":1').otherwise('"matched":true')),
        F.when(k == 3, '"matched_pred_indices":["a"]').otherwise('"matched_pred_indices":[1,2]'), F.when(k == 4, '"rationale":" "').otherwise('"rationale":"r"'),
    )
    rows = lines(t).groupBy("l_orderkey", "n").agg(F.array_sort(F.collect_list(F.struct("i", F.concat(F.lit("{"), fields, F.lit("}")).alias("m")))).alias("ms"))
    n = F.when(F.col("l_orderkey") % 9 == 0, F.col("n") + 1).otherwise(F.col("n"))
    parsed = rows.select("l_orderkey", n.alias("n"), F.transform("ms", lambda x: F.parse_json(x["m"])).alias("ms"))  # once
    return parsed.select("l_orderkey", C.match_fault(F.col("ms"), F.col("n")).alias("fault"))


@query("""SELECT l_orderkey, CASE WHEN count(*) = 1 THEN 'no list' WHEN max(l_quantity) > 45 THEN 'missing fields' END AS fault,
CASE WHEN count(*) = 1 THEN 0 ELSE count(*) FILTER (l_quantity <= 45 AND l_discount <> 0 AND l_tax <> 0) END::INT AS n_complete FROM lineitem GROUP BY l_orderkey""")
def truth_validator(t):
    """The truths of an order are its lines: large ones lack a field, others have a blank place or a number as text; one alone is no list."""
    n = F.when(F.col("l_tax") == 0, F.concat(F.lit('"'), F.col("l_linenumber").cast("string"), F.lit('"'))).otherwise(F.col("l_linenumber").cast("string"))
    place = F.when(F.col("l_discount") == 0, " \t").otherwise(F.col("l_returnflag")).alias("error_location")
    plain = F.to_json(F.struct(place, F.when(F.col("l_quantity") <= 45, "b").alias("error_type"), F.col("l_linestatus").alias("error_explanation")))
    one = F.concat(F.substr(plain, F.lit(1), F.length(plain) - 1), F.lit(',"n":'), n, F.lit("}"))
    joined = F.array_join(F.collect_list(one), ",")
    orders = t.lineitem.groupBy("l_orderkey").agg(F.when(F.count(F.lit(1)) == 1, joined).otherwise(F.concat(F.lit("["), joined, F.lit("]"))).alias("v"))
    orders, v = orders.select("l_orderkey", F.try_variant_get(F.parse_json("v"), "$", "array<variant>").alias("v")), F.col("v")  # parsed once
    return orders.select("l_orderkey", C.truth_fault(v).alias("fault"), F.coalesce(F.size(C.complete(v, ["error_location", "error_type"], ["n"])), F.lit(0)).alias("n_complete"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE upper(event_type) END AS answer, CASE event_id % 5 WHEN 0 THEN 'empty' END AS error FROM events")
def model_answers(t):
    """An offline stand-in for a model that answers in capitals, or not at all."""
    asked = t.events.select("event_id", F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type")).alias("prompt"))
    return M.complete(asked, "prompt", M.Stub(str.upper), tries=2).select("event_id", "answer", "error")


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN role || chr(10) || 'b' ELSE '{"a":1}' END AS body FROM conversations""")
def message_bodies(t):
    role = F.concat(F.lit('"'), "role", F.lit('"'))
    v = F.when(F.col("turn") % 3 == 0, role).when(F.col("turn") % 3 == 1, F.concat(F.lit('[{"type":"text","text":'), role, F.lit('},{"type":"image_url"},"b"]'))).otherwise('{"a":1}')
    return t.conversations.select("conv_id", "turn", M.message_text(F.parse_json(v)).alias("body"))


@query(r"SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN '[1]' WHEN 2 THEN 'x' WHEN 3 THEN 'python' || chr(10) || event_type WHEN 4 THEN '' ELSE event_type || '``` y' END AS bare, CASE WHEN event_id % 3 = 2 THEN ' <THINK>a</THINK>' ELSE ' ' || event_type || chr(9) END AS kept, CASE WHEN event_id % 3 = 1 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN length(event_type) > 5 THEN substr(event_type, 1, 5) || '...' ELSE event_type END AS short FROM events")
def answer_cleaning(t):
    """Fences of json in any case, plain ones and other words, none, and an inner one; reasoning in mixed and in capital letters alone."""
    e, k, f = F.col("event_type"), F.col("event_id") % 3, F.col("event_id") % 6
    fenced = F.when(f == 0, F.concat(F.lit("\t```JSON\r\n"), e, F.lit("\n```\n"))).when(f == 1, "Json\t[1]").when(f == 2, " ```\nx```").when(f == 3, F.concat(F.lit("```python\n"), e, F.lit("\n```"))).when(f == 4, "\n``` ```\u00a0").otherwise(F.concat(e, F.lit("``` y")))
    thought = F.when(k == 2, " <THINK>a</THINK>").otherwise(F.concat(F.lit("<think>\n{}"), e, F.lit("</THINK> "), e, F.lit("\t<think></think>")))
    braces = F.when(k == 1, F.concat(F.lit("a"), "props", F.lit("b"))).otherwise("none")
    return t.events.select("event_id", T.strip_fence(fenced).alias("bare"), T.drop_reasoning(thought).alias("kept"), F.try_variant_get(P.widest_braces(braces), "$.k", "bigint").alias("k"), T.cut_to(e, 5, "...").alias("short"))
