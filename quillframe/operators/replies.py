"""Threads of replies: trees by parent, their order, and what notes are."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.operators.checks import kind
from quillframe.session import checkpointed

#: Nodes of a forum that one task may hold, and rows it hands on at a time.
WHOLE, HANDED = 1 << 20, 10_000

#: Parts of the names of invitations that only record changes, and forms of a conference's type: fixed values.
CHANGES = ["/-Edit", "/-Withdraw", "/-Revision", "/-Desk_Rejected", "/-Withdrawn"]


def forest(nodes: DataFrame, forum: str, id_: str, parent: str, time: str) -> DataFrame:
    """forum, id, parent, root, depth and place of each node: place counts the forum's nodes from 0 as they
    are read from top to bottom, children by time (null counts as 0), then by id.

    A node whose parent is not in its forum is a root with depth 0; of nodes with one id the first is the
    parent of its replies. Nodes that reach no root, on a circle, have null root, depth and place. Forums of
    up to WHOLE nodes are walked in one read of sorted rows; larger ones are ranked as lists, see ranked().
    """
    rows = nodes.select(F.col(forum).alias("forum"), F.col(id_).alias("id"), F.col(parent).alias("parent"), F.coalesce(F.col(time), F.lit(0)).cast("long").alias("time"))
    large = checkpointed(rows.groupBy(F.col("forum").alias("__large")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE).select("__large"))
    if large.isEmpty():
        out = walked(rows)
    else:
        meets = F.col("forum").eqNullSafe(F.col("__large"))
        out = walked(rows.join(large, meets, "left_anti")).unionByName(ranked(rows.join(large, meets, "left_semi")))
    return out.select(F.col("forum").alias(forum), F.col("id").alias(id_), F.col("parent").alias(parent), "root", "depth", "place")


def walked(rows: DataFrame) -> DataFrame:
    """forest() of rows (forum, id, parent, time): a task reads its forums sorted, one after the other, and holds one at a time."""
    order = ["forum", "time", "id", "parent"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[0][0]:
                    yield from _walk(held, batch.schema)
                    held = []
                held.append(row)
        if held:
            yield from _walk(held, batch.schema)

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"forum {kind['forum']}, id {kind['id']}, parent {kind['parent']}, root {kind['id']}, depth int, place int"
    return rows.repartition("forum").sortWithinPartitions(*order).select("forum", "id", "parent").mapInArrow(run, schema)


def _walk(nodes: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows (forum, id, parent) of a forum, in order, with root, depth and place."""
    first: dict = {}
    for i, (_, own, _) in enumerate(nodes):
        first.setdefault(own, i)
    up = [i if p is None else first.get(p, i) for i, (_, _, p) in enumerate(nodes)]
    child, sibling = [-1] * len(nodes), [-1] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):  # so that children stand in order
        if up[i] != i:
            child[up[i]], sibling[i] = i, child[up[i]]
    root, depth, place, n = [None] * len(nodes), [None] * len(nodes), [None] * len(nodes), 0
    for r in (i for i in range(len(nodes)) if up[i] == i):
        todo = [(r, 0)]
        while todo:
            i, level = todo.pop()
            root[i], depth[i], place[i], n = nodes[r][1], level, n, n + 1
            if sibling[i] >= 0:
                todo.append((sibling[i], level))
            if child[i] >= 0:
                todo.append((child[i], level + 1))
    forums, ids, parents = zip(*nodes)
    kinds = [schema.field(n).type for n in ("forum", "id", "parent", "id")]
    columns = [*zip((forums, ids, parents, root), kinds), (depth, pa.int32()), (place, pa.int32())]
    whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["forum", "id", "parent", "root", "depth", "place"])
    for at in range(0, len(nodes), HANDED):
        yield whole.slice(at, HANDED)


def ranked(rows: DataFrame) -> DataFrame:
    """forest() of rows (forum, id, parent, time), with no forum in one task.

    A walk through a forum enters and leaves each node: a list of two items a node, each with the item that
    follows. Steps along the list are doubled by a join a round, log n rounds: each item learns how many
    nodes are entered from it on, how deep it stands, and the next root that is left, its own. Every item
    follows one other at most, so no key is hot, however many replies a node has.
    """
    rows = checkpointed(rows.withColumn("rid", F.monotonically_increasing_id()))
    first = rows.groupBy(F.col("forum").alias("__forum"), F.col("id").alias("__id")).agg(F.min(F.struct("time", "parent", "rid"))["rid"].alias("__rid"))
    here = F.col("forum").eqNullSafe(F.col("__forum")) & (F.col("parent") == F.col("__id"))
    rows = rows.join(first, here, "left").withColumn("up", F.coalesce("__rid", "rid")).select("rid", "forum", "id", "parent", "time", "up")
    rows = rows.withColumn("above", F.when(F.col("up") != F.col("rid"), F.col("up")))
    order = ["forum", "above", "time", "id", "parent", "rid"]
    lined = checkpointed(_with_next(checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order))))
    eldest = lined.where("eldest and above is not null").select(F.col("above").alias("__of"), F.col("rid").alias("child"))
    lined = lined.join(eldest, F.col("rid") == F.col("__of"), "left")
    enter, leave = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    item = lambda at, after, entered, step, left: F.struct(at.alias("at"), after.alias("after"), F.lit(entered).alias("entered"), F.lit(step).alias("step"), left.alias("left"))
    none = F.lit(None).cast("long")
    both = F.array(
        item(enter("rid"), F.coalesce(enter("child"), leave("rid")), 1, 1, none),
        item(leave("rid"), F.coalesce(enter("following"), leave("above")), 0, -1, F.when(F.col("above").isNull(), F.col("rid"))),
    )
    items = lined.select(F.explode(both).alias("e")).select("e.at", "e.after", F.col("e.entered").cast("long").alias("entered"), F.col("e.step").cast("long").alias("step"), "e.left")
    items = checkpointed(items)
    for _ in range((2 * rows.count()).bit_length()):
        if items.where("after is not null").isEmpty():
            break
        ahead = items.select(F.col("at").alias("__at"), *[F.col(c).alias(f"__{c}") for c in ("after", "entered", "step", "left")])
        items = items.join(ahead, F.col("after") == F.col("__at"), "left")
        add = lambda c: F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0))
        items = checkpointed(items.select("at", F.col("__after").alias("after"), add("entered").alias("entered"), add("step").alias("step"), F.coalesce("left", "__left").alias("left")))
    known = items.where("after is null and at % 2 = 0").select(F.expr("at div 2").alias("__node"), "entered", (-F.col("step")).alias("depth"), F.col("left").alias("top"))
    out = rows.join(known, F.col("rid") == F.col("__node"), "left")
    sizes = out.groupBy(F.col("forum").alias("__forum")).agg(F.max("entered").alias("reached"))
    tops = rows.select(F.col("rid").alias("__top"), F.col("id").alias("root"))
    out = out.join(sizes, F.col("forum").eqNullSafe(F.col("__forum")), "left").join(tops, F.col("top") == F.col("__top"), "left")
    return out.select("forum", "id", "parent", "root", F.col("depth").cast("int").alias("depth"), (F.col("reached") - F.col("entered")).cast("int").alias("place"))


def _with_next(rows: DataFrame) -> DataFrame:
    """Sorted rows, whose partitions stay as they are, with following, the rid of the next row of the same forum and parent, and eldest, whether there is none before.

    The first rows of partitions, one each, go through the driver.
    """
    at = rows.rdd.mapPartitionsWithIndex(lambda no, it: ((no, r.forum, r.above, r.rid) for r in islice(it, 1))).collect()
    heads = {}  # of each partition, the first row of the next that has any
    for (no, *_), following in zip(sorted(at, key=lambda x: x[0]), [*sorted(at, key=lambda x: x[0])[1:], None]):
        heads[no] = following and tuple(following[1:])
    tails = rows.rdd.mapPartitionsWithIndex(lambda no, it: ((no, r.forum, r.above) for r in deque(it, maxlen=1))).collect()
    lasts, before = {}, None
    for no, *group in sorted(tails, key=lambda x: x[0]):
        lasts[no], before = before, tuple(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId()
        ahead = heads.get(no)
        previous, held = lasts.get(no), None

        def handed(batch: pa.RecordBatch, head: tuple | None) -> pa.RecordBatch:
            nonlocal previous
            groups = list(zip(batch.column("forum").to_pylist(), batch.column("above").to_pylist()))
            ids = batch.column("rid").to_pylist()
            after = [*zip(groups[1:], ids[1:]), ((head[0], head[1]), head[2]) if head else (None, None)]
            following = [rid if g == own else None for own, (g, rid) in zip(groups, after)]
            eldest = [own != last for own, last in zip(groups, [previous, *groups])]
            previous = groups[-1]
            return batch.append_column("following", pa.array(following, pa.int64())).append_column("eldest", pa.array(eldest))

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield handed(held, tuple(batch.column(c)[0].as_py() for c in ("forum", "above", "rid")))
            held = batch
        if held is not None:
            yield handed(held, ahead)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, following long, eldest boolean")


def submission(nodes: DataFrame, forum: str, id_: str, time: str) -> DataFrame:
    """forum and submission: the note whose id is the forum's, else the earliest (a null time is 0, then by id)."""
    first = F.struct((F.col(id_) != F.col(forum)).alias("other"), F.coalesce(F.col(time), F.lit(0)).alias("time"), F.col(id_).alias("id"))
    return nodes.groupBy(forum).agg(F.min(first)["id"].alias("submission"))


def invitation(names: Column) -> Column:
    """The last part of the first of a note's invitations that records no change; empty if all do."""
    kept = F.filter(names, lambda n: ~F.exists(F.array(*map(F.lit, CHANGES)), lambda c: F.contains(n, c)))
    return F.coalesce(F.element_at(F.split(F.get(kept, F.lit(0)), "/"), -1), F.lit(""))


def note_kind(invitation_: Column) -> Column:
    """review, meta_review, decision, comment or other, by the end of the invitation."""
    ends = invitation_.endswith
    return F.when(ends("Meta_Review"), "meta_review").when(ends("Review"), "review").when(ends("Decision"), "decision").when(ends("Comment"), "comment").otherwise("other")


def plain_content(content: Column) -> Column:
    """A map of variants in which an object of a value and at most one more field stands as its value."""
    held = lambda v: kind(v, "value").isNotNull() & (F.size(F.map_keys(F.try_variant_get(v, "$", "map<string, variant>"))) <= 2)
    return F.transform_values(content, lambda _, v: F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT") & held(v), F.lit(False)), F.try_variant_get(v, "$.value", "variant")).otherwise(v))


def of_type(notes: DataFrame, venue: Column, type_: str) -> DataFrame:
    """Notes whose venue names a conference's type in small letters or with a capital first."""
    low = type_.lower()
    return notes.where(F.contains(venue, F.lit(low)) | F.contains(venue, F.lit(low.capitalize())))


def thread_counts(placed: DataFrame, forum: str) -> DataFrame:
    """forum, notes and threads (the notes right below a root) of forest()."""
    return placed.groupBy(forum).agg(F.count(F.lit(1)).alias("notes"), F.count_if(F.col("depth") == 1).alias("threads"))
