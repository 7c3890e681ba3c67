"""Queries on threads of replies. Carrier: a conversation is a forum, its turns notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.operators import replies as R
from quillframe.plans.registry import query

#: Turn n replies to turn (n - 1) div 2; turns 5 and 6 to each other; times run backwards with gaps.
NOTES = """n AS (SELECT conv_id, turn::INT AS id, CASE WHEN turn = 0 THEN 99 WHEN turn = 5 THEN 6 WHEN turn = 6 THEN 5 ELSE (turn - 1) // 2 END::INT AS parent, CASE WHEN turn % 3 > 0 THEN (turn * 7) % 5 ELSE 0 END AS time FROM conversations)"""
TREE = f"""WITH RECURSIVE {NOTES}, r AS (SELECT n.*, n.id AS root, 0 AS depth, [[time, id]] AS path FROM n WHERE NOT EXISTS (SELECT 1 FROM n p WHERE p.conv_id = n.conv_id AND p.id = n.parent)
UNION ALL SELECT n.*, r.root, r.depth + 1, list_append(r.path, [n.time, n.id]) FROM r JOIN n ON n.conv_id = r.conv_id AND n.parent = r.id)"""


def notes(t):
    turn = F.col("turn").cast("int")
    parent = F.when(turn == 0, 99).when(turn == 5, 6).when(turn == 6, 5).otherwise(F.floor((turn - 1) / 2))
    return t.conversations.select("conv_id", turn.alias("id"), parent.cast("int").alias("parent"), F.when(turn % 3 > 0, (turn * 7) % 5).alias("time"), "role", "text")


@query(TREE + " SELECT n.conv_id, n.id, n.parent, r.root, r.depth::INT AS depth, CASE WHEN r.root IS NOT NULL THEN (row_number() OVER (PARTITION BY n.conv_id, r.root IS NULL ORDER BY r.path) - 1)::INT END AS place FROM n LEFT JOIN r ON r.conv_id = n.conv_id AND r.id = n.id")
def reply_tree(t):
    return R.forest(notes(t), "conv_id", "id", "parent", "time")


@query(TREE + " SELECT n.conv_id, count(*) AS notes, count(*) FILTER (r.depth = 1) AS threads FROM n LEFT JOIN r ON r.conv_id = n.conv_id AND r.id = n.id GROUP BY n.conv_id")
def thread_counts(t):
    return R.thread_counts(R.forest(notes(t), "conv_id", "id", "parent", "time"), "conv_id")


@query(f"WITH {NOTES}, k AS (SELECT *, id + CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 1000000 END AS nid FROM n) SELECT conv_id, coalesce(max(nid) FILTER (nid = conv_id), arg_min(nid, time * 10000000 + nid)) AS submission FROM k GROUP BY conv_id")
def submissions(t):
    """Some forums have a note of their own number, others take the earliest."""
    rows = notes(t).withColumn("nid", F.col("id") + F.when(F.col("conv_id") % 2 == 0, 0).otherwise(1000000))
    return R.submission(rows, "conv_id", "nid", "time").withColumn("submission", F.col("submission").cast("int"))


@query("""SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'Official_Review' WHEN 1 THEN 'Meta_Review' WHEN 2 THEN 'Decision' WHEN 3 THEN 'Public_Comment' ELSE '' END AS invitation, CASE turn % 5 WHEN 0 THEN 'review' WHEN 1 THEN 'meta_review' WHEN 2 THEN 'decision' WHEN 3 THEN 'comment' ELSE 'other' END AS kind FROM conversations""")
def note_kinds(t):
    k = F.col("turn") % 5
    last = F.when(k == 0, "Official_Review").when(k == 1, "Meta_Review").when(k == 2, "Decision").when(k == 3, "Public_Comment")
    names = F.array_compact(F.array(F.lit("C/2025/-Edit/x"), F.concat(F.lit("C/2025/S/-/"), last), F.when(k < 4, "C/2025/-/Last")))
    return t.conversations.select("conv_id", "turn", R.invitation(names).alias("invitation"), R.note_kind(R.invitation(names)).alias("kind"))


@query("""SELECT conv_id, turn, role AS a, '{"value":1,"x":2,"y":3}' AS b, CASE WHEN turn % 2 = 0 THEN 'ICLR 2026 (Oral)' ELSE 'oral' END AS c FROM conversations WHERE turn % 3 > 0""")
def note_contents(t):
    """Fields that stand as their values, fields that do not, and the notes of one type by a venue among them."""
    venue = F.when(F.col("turn") % 3 == 0, "ICLR 2026 (ORAL) Poster").when(F.col("turn") % 2 == 0, "ICLR 2026 (Oral)").otherwise("oral")
    v = F.parse_json(F.concat(F.lit('{"a":{"value":"'), "role", F.lit('","note":0},"b":{"value":1,"x":2,"y":3},"venue":{"value":"'), venue, F.lit('"}}')))
    rows = t.conversations.select("conv_id", "turn", R.plain_content(F.try_variant_get(v, "$", "map<string, variant>")).alias("m"))
    rows = rows.withColumns({"a": F.try_variant_get(F.col("m")["a"], "$", "string"), "b": F.to_json(F.col("m")["b"]), "c": F.try_variant_get(F.col("m")["venue"], "$", "string")})
    return R.of_type(rows, F.col("c"), "ORAL").drop("m")
