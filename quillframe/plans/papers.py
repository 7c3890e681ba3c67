"""Queries on papers as blocks. Carriers: a conversation or a document is a paper, its turns or lines the blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.operators import blocks as B
from quillframe.operators import papers as P
from quillframe.plans.registry import query

#: Conversations as blocks of mixed kinds: turn 0 to 6 decide how index and section are given.
RAW = """
WITH b AS (SELECT conv_id, turn AS pos, CASE turn % 5 WHEN 3 THEN 'image_url' WHEN 4 THEN 'table' ELSE 'text' END AS type,
  CASE turn % 6 WHEN 0 THEN 10 - turn WHEN 1 THEN turn WHEN 2 THEN 1 ELSE turn END AS content_index,
  CASE turn % 4 WHEN 0 THEN role WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE ' ' || role END AS section, text FROM conversations)"""


def raw_papers(t):
    """Papers (conv_id, content) whose blocks number and name themselves in all ways that occur."""
    turn, kind = F.col("turn"), F.when(F.col("turn") % 5 == 3, "image_url").when(F.col("turn") % 5 == 4, "table").otherwise("text")
    index = F.when(turn % 6 == 0, (10 - turn).cast("string")).when(turn % 6 == 1, '"77"').when(turn % 6 == 2, "true").when(turn % 6 == 3, "2.5").when(turn % 6 == 4, "null")
    section = F.when(turn % 4 == 0, F.to_json(F.struct(F.col("role")))).when(turn % 4 == 1, F.lit('{"role":"  "}')).when(turn % 4 == 2, F.lit('{"role":5}')).otherwise(F.to_json(F.struct(F.concat(F.lit(" "), "role").alias("role"))))
    fields = F.concat(F.lit('{"type":"'), kind, F.lit('","section":'), F.get_json_object(F.regexp_replace(section, '"role":(".*")', '"role":[$1]'), "$.role"), F.coalesce(F.concat(F.lit(',"index":'), index), F.lit("")))
    fields = F.regexp_replace(fields, r'"section":\[(.*)\]', '"section":$1')
    body = F.concat(fields, F.lit(',"text":'), F.regexp_extract(F.to_json(F.struct("text")), r"(?s)^\{\"text\":(.*)\}$", 1), F.lit(',"image_url":{"url":"http://x/'), turn.cast("string"), F.lit('"}}'))
    rows = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", body.alias("b")))), lambda x: F.try_parse_json(x["b"])).alias("content"))
    return rows


@query(RAW + " SELECT conv_id, pos::INT AS pos, content_index::INT AS content_index, type, section, CASE WHEN type = 'text' THEN text END AS text, CASE WHEN type = 'image_url' THEN 'http://x/' || pos END AS url, type = 'table' AS has_rest FROM b")
def block_normalise(t):
    rows = P.normalized(raw_papers(t), "conv_id", F.col("content"))
    return rows.select("conv_id", "pos", "content_index", "type", "section", "text", P.image_url(F.col("image")).alias("url"), F.col("rest").isNotNull().alias("has_rest"))


def turns(t):
    """Conversations as blocks with a section every second turn."""
    return t.conversations.select("conv_id", F.col("turn").alias("pos"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), F.initcap("role"))).otherwise(" ").alias("section"), "text", F.lit("text").alias("type"))


TURNS = "WITH b AS (SELECT conv_id, turn AS pos, CASE WHEN turn % 2 = 0 THEN ' ' || upper(role[1]) || lower(role[2:]) ELSE ' ' END AS section, text FROM conversations)"


@query(TURNS + " SELECT conv_id, pos, row_number() OVER (PARTITION BY conv_id ORDER BY pos)::INT AS index FROM b WHERE lower(trim(section)) <> 'user'")
def drop_section_renumber(t):
    return P.renumbered(P.without_section(turns(t), "user"), "conv_id", ["pos"], "index").select("conv_id", "pos", "index")


@query("""WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS total FROM events),
l AS (SELECT user_id, i AS ord, event_type, i AS a, i + 2 AS b FROM n WHERE i % 7 = 0 UNION ALL SELECT user_id, i, 'METHOD', i + 4, i + 4 FROM n WHERE i % 7 = 3),
x AS (SELECT user_id, ord, CASE WHEN event_type = 'METHOD' THEN 'Method' ELSE event_type END AS label, unnest(generate_series(a, b)) AS i FROM l),
w AS (SELECT user_id, i, arg_max(label, ord) AS named FROM x GROUP BY ALL)
SELECT n.user_id, n.i::INT AS i, coalesce(last_value(named IGNORE NULLS) OVER (PARTITION BY n.user_id ORDER BY n.i), 'Introduction') AS label FROM n LEFT JOIN w ON n.user_id = w.user_id AND n.i = w.i""")
def labels_to_blocks(t):
    """Ranges of labels, given backwards and with junk, to blocks; later labels win."""
    n = P.renumbered(t.events.select("user_id", "event_id", "event_type"), "user_id", ["event_id"], "i")
    a = n.where("i % 7 = 0").select("user_id", F.col("i").alias("ord"), F.concat_ws("-", (F.col("i") + 2).cast("string"), F.concat(F.col("i").cast("string"), F.lit(" , x-1"))).alias("content_index"), F.concat(F.lit(" "), "event_type").alias("section"))
    b = n.where("i % 7 = 3").select("user_id", F.col("i").alias("ord"), (F.col("i") + 4).cast("string").alias("content_index"), F.lit("METHOD").alias("section"))
    blank = n.where("i % 7 = 5").select("user_id", F.col("i").alias("ord"), F.col("i").cast("string").alias("content_index"), F.lit("  ").alias("section"))
    return P.labels_of_blocks(a.unionByName(b).unionByName(blank), n.select("user_id", "i"), "user_id", "i")


@query(TURNS + r""", f AS (SELECT *, nullif(trim(section), '') AS s FROM b),
g AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos), first_value(s IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'Unknown Section') AS title FROM f),
h AS (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, title ORDER BY pos) AS run FROM g),
r AS (SELECT conv_id, title, run, min(pos) AS first, regexp_replace(string_agg(text, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS part FROM h GROUP BY conv_id, title, run)
SELECT conv_id, title, string_agg(part, chr(10) || chr(10) ORDER BY first) AS text FROM r WHERE part <> '' GROUP BY conv_id, title""")
def section_segments(t):
    return P.segments(turns(t), "conv_id", "pos").select("conv_id", "title", "text")


PART_BLOCKS = RAW + """, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY content_index, pos) AS nth FROM b),
k AS (SELECT *, count(*) FILTER (type = 'image_url') OVER (PARTITION BY conv_id ORDER BY nth) AS seen FROM n WHERE nth <= 6),
p AS (SELECT conv_id, nth, 0 AS k, 'text' AS kind, '[Block #' || content_index || ' | ' || type || CASE WHEN section IS NULL THEN 'None' ELSE ' |Section: ' || trim(section) END || ']' AS value FROM k
UNION ALL SELECT conv_id, nth, 1, 'text', substr(text, 1, 40) FROM k WHERE type = 'text' AND trim(substr(text, 1, 40)) <> ''"""


def part_blocks(t):
    rows = P.normalized(raw_papers(t), "conv_id", F.col("content"))
    return rows.withColumn("url", P.image_url(F.col("image")))


@query(PART_BLOCKS + """ UNION ALL SELECT conv_id, nth, 2, 'image_url', 'http://x/' || pos FROM k WHERE type = 'image_url' AND seen <= 1)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY nth, k)::INT AS n, kind, value FROM p""")
def message_parts(t):
    return P.parts(part_blocks(t), "conv_id", ["content_index", "pos"], most_blocks=6, most_images=1, most_chars=40)


@query(PART_BLOCKS + """ UNION ALL SELECT conv_id, nth, 2, 'text', '[Image omitted: multimodal disabled]' FROM k WHERE type = 'image_url')
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY nth, k)::INT AS n, kind, value FROM p""")
def message_parts_text_only(t):
    return P.parts(part_blocks(t), "conv_id", ["content_index", "pos"], most_blocks=6, most_images=1, most_chars=40, images=False)


@query(r"""WITH x AS (SELECT *, trim(replace(text, chr(10), ' ')) AS flat FROM conversations)
SELECT conv_id, turn, '[' || turn || '] ' || CASE turn % 3 WHEN 0 THEN 'TEXT: ' || substr(flat, 1, 250)
  WHEN 1 THEN 'FIG/TBL: http://x/' || turn || CASE WHEN turn % 2 = 0 THEN ' | CAPTION: a b' WHEN flat = '' THEN '' ELSE ' | CAPTION: ' || substr(flat, 1, 160) END ELSE 'OTHER: ' || substr(flat, 1, 200) END AS line FROM x""")
def block_previews(t):
    turn = F.col("turn")
    type_ = F.when(turn % 3 == 0, "text").when(turn % 3 == 1, "figure").otherwise("formula")
    caption = F.when(turn % 2 == 0, "a\nb ").otherwise("")
    return t.conversations.select("conv_id", "turn", P.preview(turn, type_, F.col("text"), F.concat(F.lit("http://x/"), turn.cast("string")), caption).alias("line"))


@query(TURNS + """, s AS (SELECT conv_id, pos, CASE WHEN pos % 4 = 0 THEN upper(trim(section)) ELSE trim(section) END AS title FROM b WHERE trim(section) <> ''),
o AS (SELECT conv_id, lower(title) AS low, min(pos) AS p, arg_min(title, pos) AS title FROM s GROUP BY ALL)
SELECT conv_id, nth, title FROM (SELECT conv_id, title, row_number() OVER (PARTITION BY conv_id ORDER BY p)::INT AS nth FROM o) WHERE nth <= 2""")
def titles_in_order(t):
    blocks = turns(t).withColumn("section", F.when(F.col("pos") % 4 == 0, F.upper("section")).otherwise(F.col("section")))
    return P.titles(blocks, "conv_id", "pos", any_case=True, most=2)


@query("SELECT conv_id, role, max(turn) FILTER (turn % 3 <> 1) AS m, coalesce(max(turn) FILTER (turn % 3 <> 1 AND role = 'user') + 1, 10000000)::INT AS next_index FROM conversations GROUP BY conv_id, role")
def next_block_index(t):
    rows = t.conversations.withColumn("key", F.concat_ws("/", "conv_id", "role")).withColumn("i", F.when((F.col("turn") % 3 != 1) & (F.col("role") == "user"), F.col("turn").cast("int")))
    numbered = P.next_index(rows, "key", "i")
    extra = t.conversations.groupBy("conv_id", "role").agg(F.max(F.when(F.col("turn") % 3 != 1, F.col("turn"))).alias("m"))
    return extra.join(numbered, F.concat_ws("/", "conv_id", "role") == F.col("key")).select("conv_id", "role", "m", "next_index")


@query("""WITH b AS (SELECT conv_id, role AS section, turn::INT AS index, text FROM conversations), e AS (SELECT DISTINCT conv_id, role AS section, substr(text, 1, 3) AS entry, min(turn) OVER (PARTITION BY conv_id, role, substr(text, 1, 3)) AS ord FROM conversations WHERE turn % 2 = 0)
SELECT conv_id, section, index, text FROM b UNION ALL SELECT conv_id, section, (SELECT max(turn) + 1 FROM conversations c WHERE c.conv_id = e.conv_id)::INT, string_agg(entry, chr(10) ORDER BY ord) FROM e GROUP BY conv_id, section""")
def local_references(t):
    blocks = t.conversations.select("conv_id", F.col("role").alias("section"), F.col("turn").cast("int").alias("index"), F.lit("text").alias("type"), "text")
    entries = t.conversations.where("turn % 2 = 0").select("conv_id", F.col("role").alias("section"), F.col("turn").alias("ord"), F.substring("text", 1, 3).alias("entry"))
    return P.with_entries(blocks, entries, P.next_index(blocks, "conv_id", "index"), "conv_id", "index").drop("type")


@query(r"SELECT conv_id, coalesce(string_agg(trim(text), chr(10) ORDER BY turn) FILTER (turn % 3 <> 0 AND trim(text) <> ''), '') AS text FROM conversations GROUP BY conv_id")
def references_text(t):
    rows = t.conversations.withColumn("type", F.when(F.col("turn") % 3 == 0, "image_url").otherwise("text"))
    return P.merged_text(rows.withColumn("text", F.concat(F.lit(" \n"), "text")), "conv_id", "turn")


@query(r"""WITH m AS (SELECT conv_id, list(DISTINCT role ORDER BY role) AS roles, max(text) FILTER (role = 'user') AS u, max(text) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id)
SELECT conv_id, substr(CASE WHEN conv_id % 3 = 0 THEN 'no headings here ' || conv_id ELSE '# Global Summary' || chr(10) || 'all of ' || conv_id || CASE WHEN conv_id % 3 = 1 AND coalesce(regexp_replace(a, '\s+', ' ', 'g'), '') <> '' THEN chr(10) || '# assistant' || chr(10) || trim(regexp_replace(a, '\s+', ' ', 'g')) ELSE '' END END, 1, 200) AS slice FROM m""")
def task_memory(t):
    flat = lambda role: F.coalesce(F.trim(F.regexp_replace(F.max(F.when(F.col("role") == role, F.col("text"))), r"\s+", " ")), F.lit(""))
    m = t.conversations.groupBy("conv_id").agg(flat("user").alias("u"), flat("assistant").alias("a"))
    heads = F.concat(F.lit("lead\n# Global Summary\nall of "), F.col("conv_id").cast("string"), F.lit("\n# user\n"), F.col("u"), F.when(F.col("conv_id") % 3 == 1, F.concat(F.lit("\n# assistant\nold\n# assistant\n"), F.col("a"))).otherwise("\n# other\nunlisted"))
    memory = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("no headings here "), F.col("conv_id").cast("string"))).otherwise(heads)
    return m.select("conv_id", P.memory_slice(memory, F.array(F.lit("user"), F.lit("assistant")), F.lit(" user "), 200).alias("slice"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(turn % 3 + 1) OVER w AS cp, sum(length(text)) OVER w AS cc, turn % 4 = 1 AS blank FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) QUALIFY coalesce(max(CASE WHEN NOT blank AND (cc > 630 OR cp >= 5) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0")
def soft_budget_with_blanks(t):
    """Blocks that count several parts, and blank ones, which do not stop the run."""
    return B.soft_budget_prefix(t.conversations, "conv_id", "turn", F.length("text").cast("long"), 600, 5, parts=F.col("turn") % 3 + 1, blank=F.col("turn") % 4 == 1).select("conv_id", "turn")


@query(r"""SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(l) - (l[len(l)] = '')::INT END AS n_lines, len(list_filter(string_split_regex(trim(text, chr(10) || ' '), '\n\s*\n'), lambda p: trim(p, chr(10) || ' ') <> '')) AS n_paragraphs,
  list_filter(string_split(k, ','), lambda x: trim(x) <> '') AS words FROM (SELECT *, string_split(text, chr(10)) AS l, lang || ',' || source AS k FROM documents)""")
def line_and_paragraph_split(t):
    words = F.concat(F.lit("\t\n"), "lang", F.lit("\u00a0, \r\n,"), "source", F.lit("\u2003,"))
    return t.documents.select("doc_id", F.size(T.split_lines(F.col("text"))).cast("long").alias("n_lines"), F.size(T.paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"), T.keywords(words).alias("words"))


@query(r"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN ['a ' || turn, 'b'] WHEN 1 THEN ['x' || turn] WHEN 2 THEN [''] ELSE ['no' || chr(10) || chr(10) || 'split'] END AS parts FROM conversations""")
def four_line_split(t):
    n = F.col("turn").cast("string")
    text = F.when(F.col("turn") % 4 == 0, F.concat(F.lit(" a "), n, F.lit("\n\n\n\n \n\n\n\n\n\nb"))).when(F.col("turn") % 4 == 1, F.concat(F.lit("\n\n\n\nx"), n, F.lit("\n\n\n\n"))).when(F.col("turn") % 4 == 2, " \n\n\n\n ").otherwise("no\n\nsplit")
    return t.conversations.select("conv_id", "turn", T.four_line_parts(text).alias("parts"))


@query(r"""SELECT doc_id, regexp_replace(s, '[^a-zA-Z0-9_.-]', '_', 'g') AS safe, regexp_replace(s, '[^a-zA-Z0-9_-]', '_', 'g') AS flat, regexp_replace(s, '[^0-9A-Za-z_-]+', '_', 'g') AS squeezed,
  replace(s, '/', '_') AS tag, CASE WHEN doc_id % 5 = 0 THEN 'no_title' ELSE substr(replace(regexp_replace(trim(s), '[^a-zA-Z0-9_. -]', '_', 'g'), ' ', '_'), 1, 12) END AS title, CASE WHEN doc_id % 5 = 0 THEN 'none' ELSE trim(s) END AS kept
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE ' ' || source || '/v1.2: ' || lang || ' (' || doc_id || ') ' END AS s FROM documents)""")
def safe_names(t):
    s = F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "source", F.lit("/v1.2: "), "lang", F.lit(" ("), F.col("doc_id").cast("string"), F.lit(") ")))
    return t.documents.select("doc_id", T.safe_name(s).alias("safe"), T.flat_name(s).alias("flat"), T.squeezed_name(s).alias("squeezed"), T.model_tag(s).alias("tag"), T.safe_title(s, 12).alias("title"), T.safe_string(s, "none").alias("kept"))


@query(r"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN 'a "q" ' || user_id ELSE '' END AS content, event_type || user_id AS rejoined,
  CASE event_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' ELSE 'image/png' END AS mime, event_id % 3 < 2 AS fetchable FROM events""")
def stream_lines_and_addresses(t):
    e, u = F.col("event_type"), F.col("user_id").cast("string")
    k = F.col("event_id") % 4
    line = F.when(k == 0, T.event_line(e)).when(k == 1, T.event_line(F.concat(F.lit('a "q" '), u))).when(k == 2, "data: [DONE]").otherwise('data: {"choices":[]}')
    data = F.when(k == 0, "iVBORw0").when(k == 1, "/9j/4AAQ").when(k == 2, "R0lGODlh").otherwise("UklGRg")
    url = F.when(F.col("event_id") % 3 == 0, "http://a").when(F.col("event_id") % 3 == 1, F.concat(F.lit("data:"), e)).otherwise("ftp://b")
    return t.events.select("event_id", T.event_content(line).alias("content"), T.rejoined_answer(F.concat(e, F.lit("\n\n"), u)).alias("rejoined"), T.image_mime(data).alias("mime"), T.fetchable(url).alias("fetchable"))
