"""Papers as ordered blocks: normal form, sections, and the parts of a message made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.operators.checks import kind

#: The label of blocks before the first labelled one, and the number of a new block in a paper without numbers: fixed values.
FIRST_LABEL, NO_BLOCKS = "Introduction", 10_000_000
#: Names of sections as they are written out, whatever their case: fixed values.
SECTIONS = ["Abstract", "Introduction", "Related Work", "Method", "Experiments", "Results", "Discussion", "Conclusion", "References", "Appendix", "Checklist"]


def normalized(docs: DataFrame, key: str, content: Column) -> DataFrame:
    """A row a block of content, an array of variants: key, pos (from 0), content_index, type, section,
    text (of text blocks), image (of image blocks, a variant) and rest, the whole block, of other kinds.

    content_index is the block's own index where that is a whole number (true and false count as 1 and
    0), else its position; a blank section is null. Sort by content_index, then pos.
    """
    rows = docs.select(key, F.posexplode(content).alias("pos", "b"))
    b, type_ = F.col("b"), F.try_variant_get("b", "$.type", "string")
    of = kind(b, "index")
    index = F.when(of == "BIGINT", F.try_variant_get(b, "$.index", "int")).when(of == "BOOLEAN", F.try_variant_get(b, "$.index", "boolean").cast("int"))
    section = F.when(kind(b, "section") == "STRING", F.try_variant_get(b, "$.section", "string"))
    return rows.select(
        key, "pos", F.coalesce(index, F.col("pos")).alias("content_index"), type_.alias("type"), F.when(T.trimmed(section) != "", section).alias("section"),
        F.when(type_ == "text", F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))).alias("text"),
        F.when(type_ == "image_url", F.try_variant_get(b, "$.image_url", "variant")).alias("image"), F.when(~type_.isin("text", "image_url") | type_.isNull(), b).alias("rest"),
    )


def image_url(image: Column) -> Column:
    """The address in an image's variant: a string, its url, or its base64 data as a data address; null if it cannot be fetched."""
    data = F.try_variant_get(image, "$.data_b64", "string")
    mime = F.coalesce(F.nullif(F.try_variant_get(image, "$.mime", "string"), F.lit("")), T.image_mime(data))
    whole = F.when(F.schema_of_variant(image) == "STRING", F.try_variant_get(image, "$", "string"))
    url = F.coalesce(whole, F.try_variant_get(image, "$.url", "string"), F.concat(F.lit("data:"), mime, F.lit(";base64,"), data))
    return F.when(T.fetchable(url), url)


def without_section(blocks: DataFrame, title: str = "checklist") -> DataFrame:
    """blocks but those of one section, in any case; blocks without a section stay."""
    return blocks.where(F.lower(T.trimmed(F.coalesce("section", F.lit("")))) != title)


def renumbered(rows: DataFrame, key: str, order: list[str], out: str, first: int = 1) -> DataFrame:
    """rows with out: first, first + 1, ... within each key."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)) + (first - 1))


def labels_of_blocks(labels: DataFrame, blocks: DataFrame, key: str, index: str) -> DataFrame:
    """blocks with label, from labels (key, ord, content_index as '1-3,5', section): the last label that
    names a block wins, blanks and numbers outside 1 .. the paper's blocks name none; unnamed blocks take
    the label before them, those before the first FIRST_LABEL."""
    name = T.trimmed(F.col("section"))
    known = F.get(F.filter(F.array(*map(F.lit, SECTIONS)), lambda s: F.lower(s) == F.lower(name)), F.lit(0))
    named = labels.where(name != "").select(key, "ord", F.coalesce(known, name).alias("label"), F.explode(T.expand_ranges(F.col("content_index"))).alias(index))
    last = named.groupBy(key, index).agg(F.max_by("label", "ord").alias("named"))
    run = Window.partitionBy(key).orderBy(index).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.join(last, [key, index], "left").withColumn("label", F.coalesce(F.last("named", ignorenulls=True).over(run), F.lit(FIRST_LABEL))).drop("named")


def segments(blocks: DataFrame, key: str, pos: str) -> DataFrame:
    """key, title and text of each section: blocks without a title go on with the current one, those
    before the first title belong to it, a paper without titles is 'Unknown Section'. Sections whose
    text is blank are left out; those of one title are joined, in order, by a blank line."""
    run = Window.partitionBy(key).orderBy(pos)
    title = F.nullif(T.trimmed(F.col("section")), F.lit(""))
    rows = blocks.withColumn("title", F.last(title, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("title", F.coalesce("title", F.first(title, ignorenulls=True).over(run.rowsBetween(Window.currentRow, Window.unboundedFollowing)), F.lit("Unknown Section")))
    new = F.coalesce(F.col("title") != F.lag("title").over(run), F.lit(False))
    rows = rows.withColumn("run", F.sum(new.cast("int")).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "text"))), lambda x: x["text"]), "\n")
    parts = rows.groupBy(key, "run", "title").agg(T.trimmed(part).alias("part")).where("part <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "part"))), lambda x: x["part"]), "\n\n")
    return parts.groupBy(key, "title").agg(F.min("run").alias("first_run"), joined.alias("text"))


def header(index: Column, type_: Column, section: Column) -> Column:
    """The line before a block in a message. A block without a section says None, close to its type: the form is fixed."""
    name = T.trimmed(F.coalesce(section, F.lit("")))
    tail = F.when(name != "", F.concat(F.lit(" |Section: "), name)).otherwise("None")
    return F.concat(F.lit("[Block #"), F.coalesce(index.cast("string"), F.lit("?")), F.lit(" | "), F.coalesce(F.nullif(type_, F.lit("")), F.lit("unknown")), tail, F.lit("]"))


def parts(blocks: DataFrame, key: str, order: list[str], most_blocks: int = 1000, most_images: int = 48, most_chars: int = 10_000, images: bool = True) -> DataFrame:
    """The parts of a message (key, n, kind, value) from the first blocks of each paper: a header, then a
    block's text, cut, unless it is blank, or its image's address while there are fewer than most_images;
    without images a note in its place. blocks has type, section, text, url and content_index."""
    first = renumbered(blocks, key, order, "__nth").where(F.col("__nth") <= most_blocks)
    image = F.when(F.col("type") == "image_url", F.col("url") if images else F.lit("[Image omitted: multimodal disabled]"))
    seen = F.count(F.when((F.col("type") == "image_url") & F.col("url").isNotNull(), F.lit(1))).over(Window.partitionBy(key).orderBy("__nth"))
    text = F.when((F.col("type") == "text") & (T.trimmed(F.substring("text", 1, most_chars)) != ""), F.substring("text", 1, most_chars))
    first = first.withColumn("__image", F.when((seen <= most_images) | F.lit(not images), image)).withColumn("__text", text)
    each = F.array_compact(F.array(
        F.struct(F.lit(0).alias("k"), F.lit("text").alias("kind"), header(F.col("content_index"), F.col("type"), F.col("section")).alias("value")),
        F.when(F.col("__text").isNotNull(), F.struct(F.lit(1).alias("k"), F.lit("text").alias("kind"), F.col("__text").alias("value"))),
        F.when(F.col("__image").isNotNull(), F.struct(F.lit(2).alias("k"), F.lit("image_url" if images else "text").alias("kind"), F.col("__image").alias("value"))),
    ))
    rows = first.select(key, "__nth", F.explode(each).alias("p"))
    return renumbered(rows.select(key, "__nth", "p.*"), key, ["__nth", "k"], "n").select(key, "n", "kind", "value")


def preview(index: Column, type_: Column, text: Column, url: Column, caption: Column) -> Column:
    """A block as one line of an overview: 250 characters of a text, 120 of an address, 160 of a caption, 200 of others."""
    flat = lambda c, n: F.substring(T.trimmed(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))), 1, n)
    note = flat(F.coalesce(F.nullif(caption, F.lit("")), text), 160)
    figure = F.concat(F.lit("FIG/TBL: "), F.substring(F.coalesce(url, F.lit("")), 1, 120), F.when(note != "", F.concat(F.lit(" | CAPTION: "), note)).otherwise(""))
    body = F.when(type_ == "text", F.concat(F.lit("TEXT: "), flat(text, 250))).when(type_.isin("image_url", "image", "figure", "table"), figure)
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), F.coalesce(body, F.concat(F.lit("OTHER: "), flat(text, 200))))


def titles(blocks: DataFrame, key: str, pos: str, any_case: bool = False, most: int | None = None) -> DataFrame:
    """key, nth, title: each paper's section titles once, in order, the first spelling where case does
    not count; blank ones are left out; at most `most` a paper."""
    title = T.trimmed(F.coalesce("section", F.lit("")))
    rows = blocks.withColumn("title", title).where("title <> ''").withColumn("same", F.lower("title") if any_case else F.col("title"))
    once = rows.groupBy(key, "same").agg(F.min(pos).alias("at"), F.min_by("title", pos).alias("title"))
    out = renumbered(once, key, ["at"], "nth")
    return (out if most is None else out.where(F.col("nth") <= most)).select(key, "nth", "title")


def next_index(blocks: DataFrame, key: str, index: str) -> DataFrame:
    """key and next_index, one more than the paper's largest number."""
    return blocks.groupBy(key).agg(F.coalesce(F.max(index) + 1, F.lit(NO_BLOCKS)).alias("next_index"))


def with_entries(section_blocks: DataFrame, entries: DataFrame, numbers: DataFrame, key: str, index: str) -> DataFrame:
    """section_blocks (key, section, index, type, text) and, for each section with cited entries (key,
    section, ord, entry), one more text block that lists each entry once, numbered by next_index()."""
    once = entries.groupBy(key, "section", "entry").agg(F.min("ord").alias("ord"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "entry"))), lambda x: x["entry"]), "\n")
    new = once.groupBy(key, "section").agg(listed.alias("text")).join(numbers, key)
    return section_blocks.unionByName(new.select(key, "section", F.col("next_index").alias(index), F.lit("text").alias("type"), "text"))


def merged_text(blocks: DataFrame, key: str, pos: str) -> DataFrame:
    """key and text: the paper's text blocks that are not blank, trimmed, a line each, in order."""
    body = F.when((F.col("type") == "text") & (T.trimmed(F.col("text")) != ""), F.struct(pos, T.trimmed(F.col("text")).alias("t")))
    return blocks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["t"]), "\n").alias("text"))


def memory_slice(memory: Column, titles_: Column, current: Column, most: int) -> Column:
    """What a task gets of a memory of '# title' sections: the global summary and, of the titles in order,
    all but the current one; the whole memory where that is nothing; cut to `most` characters."""
    held = T.headed_sections(memory)
    summary = F.when(F.coalesce(held["Global Summary"], F.lit("")) != "", F.concat(F.lit("# Global Summary\n"), held["Global Summary"]))
    others = F.transform(F.filter(titles_, lambda t: (t != T.trimmed(F.coalesce(current, F.lit("")))) & (F.coalesce(held[t], F.lit("")) != "")), lambda t: F.concat(F.lit("# "), t, F.lit("\n"), held[t]))
    text = T.trimmed(F.array_join(F.concat(F.array_compact(F.array(summary)), others), "\n"))
    return F.substring(F.when(text != "", text).otherwise(F.coalesce(memory, F.lit(""))), 1, most)
