"""Queries that write tables as files, read them again, and pick among files; and sources behind stand-ins."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import functions as F

from quillframe.functions.parse import json_value
from quillframe.plans.registry import query
from quillframe.session import scratch
from quillframe.sources import files as S
from quillframe.sources import remote as X
from quillframe.sources import sinks as K


def folder(t) -> str:
    return f"{scratch(t.spark)}/scans-{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name, 'region=' || n_regionkey AS folder FROM nation")
def json_files(t):
    """Nations as JSON files in a folder a region, scanned as whole values."""
    at = folder(t)
    K.write_json(t.nation.select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none"), F.col("n_regionkey").alias("region")).repartition(1, "region"), at, ["region"])
    lines = S.scan_text(t.spark, at, "*.json").select("folder", F.explode(F.split(S.trimmed(F.col("value")), "\n")).alias("value"))
    v = json_value(F.col("value"))
    return lines.where(F.is_variant_null(F.try_variant_get(v, "$.none", "variant"))).select(F.try_variant_get(v, "$.n_nationkey", "int").alias("n_nationkey"), F.try_variant_get(v, "$.n_name", "string").alias("n_name"), "folder")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS times FROM customer WHERE c_custkey % 5 > 0")
def json_lines(t):
    """Lines of JSON, appended to once, among blank lines, broken ones and ones that are no object."""
    at, c = folder(t), t.customer
    text = F.when(F.col("c_custkey") % 5 == 0, F.get(F.array(F.lit(""), F.lit("{bad"), F.lit("[1]"), F.lit("7")), (F.col("c_custkey") % 4).cast("int"))).otherwise(F.to_json(F.struct("c_custkey")))
    K.write_text(c.select(text.alias("value")), at)
    K.write_json(c.where("c_custkey % 3 = 0 and c_custkey % 5 > 0").select("c_custkey"), at, mode="append")
    return S.scan_jsonl(t.spark, at).select(F.try_variant_get("v", "$.c_custkey", "long").alias("c_custkey")).groupBy("c_custkey").agg(F.count(F.lit(1)).cast("int").alias("times"))


@query("SELECT r_regionkey, r_name FROM region")
def csv_and_parquet(t):
    """Regions as CSV with a header, read and written as Parquet, and read once more."""
    at = folder(t)
    K.write_csv(t.region.select("r_regionkey", "r_name"), f"{at}/csv")
    read = t.spark.read.option("header", True).schema(t.region.select("r_regionkey", "r_name").schema).csv(f"{at}/csv")
    K.write_parquet(read, f"{at}/parquet")
    return t.spark.read.parquet(f"{at}/parquet")


@query("SELECT s_suppkey, trim(s_name) AS name FROM supplier")
def text_files(t):
    at = folder(t)
    lines = t.supplier.select(F.concat(F.lit(" "), F.col("s_suppkey").cast("string"), F.lit("\t"), "s_name", F.lit(" ")).alias("value"))
    K.write_text(lines, at)
    got = S.scan_trimmed(t.spark, at).select(F.explode(F.split("value", "\n")).alias("line"))
    return got.select(F.split_part(F.trim("line"), F.lit("\t"), F.lit(1)).cast("long").alias("s_suppkey"), F.trim(F.split_part("line", F.lit("\t"), F.lit(2))).alias("name"))


@query("SELECT count(*)::INT AS total, count(*) FILTER (p_retailprice >= 925)::INT AS readable, count(*) FILTER (p_retailprice < 925)::INT AS unreadable, (sum(p_size) FILTER (p_retailprice >= 925))::INT AS pages FROM part")
def page_report(t):
    """The report of the parts' pages as CSV, cheap ones being unreadable, and its summary as one JSON line."""
    rows = t.part.select(F.col("p_name").alias("folder"), F.concat("p_name", F.lit(".pdf")).alias("pdf_path"), F.when(F.col("p_retailprice") < 925, -1).otherwise(F.col("p_size")).cast("int").alias("pages"))
    at = folder(t)
    K.write_page_report(rows, at)
    report = t.spark.read.json(f"{at}/summary")
    table = t.spark.read.option("header", True).schema(rows.schema).csv(f"{at}/pages")
    return report.join(table.where("pages > 0").agg(F.sum("pages").cast("int").alias("pages"))).select(*[F.col(c).cast("int").alias(c) for c in ("total", "readable", "unreadable", "pages")])


def listing(t):
    """Files by name: of each customer a final paper, of some also a synthetic one, of some one below a result."""
    c = F.col("c_custkey")
    name = F.array_compact(F.array(F.lit("paper_final.json"), F.when(c % 2 == 0, "paper_synth_m1.json"), F.when(c % 3 == 0, "paper_synth_m12.json"), F.when(c % 5 == 0, "x_eval/paper_synth_m1.json")))
    rows = t.customer.select(F.concat(F.lit("p"), c.cast("string")).alias("folder"), F.explode(name).alias("name"))
    return rows.select("folder", F.concat(F.lit("root/"), "folder", F.lit("/"), "name").alias("path"), F.element_at(F.split("name", "/"), -1).alias("file"))


FILES = """WITH n AS (SELECT c_custkey AS c, 'p' || c_custkey AS folder, unnest(['paper_final.json'] || CASE WHEN c_custkey % 2 = 0 THEN ['paper_synth_m1.json'] ELSE [] END || CASE WHEN c_custkey % 3 = 0 THEN ['paper_synth_m12.json'] ELSE [] END || CASE WHEN c_custkey % 5 = 0 THEN ['x_eval/paper_synth_m1.json'] ELSE [] END) AS name FROM customer),
f AS (SELECT folder, 'root/' || folder || '/' || name AS path, CASE WHEN starts_with(name, 'x_eval') THEN name[8:] ELSE name END AS file, starts_with(name, 'x_eval') AS below FROM n)"""


@query(FILES + " SELECT 'tag' AS way, path FROM f WHERE contains(file, 'm1') UNION ALL SELECT 'exact', path FROM f WHERE file = 'paper_synth_m1.json' AND NOT below UNION ALL SELECT 'fallback', path FROM f WHERE contains(file, 'synth') AND NOT below")
def file_choice(t):
    """Files by a part of their name, by the whole name, and by a part where no file has the whole one."""
    f = listing(t)
    ways = {"tag": S.tagged(f, "m1"), "exact": S.tagged_or_exact(f, "paper_synth_m1.json", "m1"), "fallback": S.tagged_or_exact(f, "paper_synth_zz.json", "synth")}
    out = [df.select(F.lit(w).alias("way"), "path") for w, df in ways.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(FILES + " SELECT folder, arg_min(path, file <> 'paper_synth_m12.json') AS path FROM f WHERE file IN ('paper_synth_m12.json', 'paper_final.json') GROUP BY folder")
def preferred_variant(t):
    return S.preferred(listing(t), ["paper_synth_m12.json", "paper_final.json"]).select("folder", "path")


@query(FILES + " SELECT folder, path FROM f WHERE file = 'paper_synth_m1.json' AND folder = 'p10' UNION ALL SELECT DISTINCT folder, NULL FROM f")
def file_filters(t):
    f = listing(t)
    return S.matching(f, file="paper_synth_m1.json", folder="p10", path=None).select("folder", "path").unionByName(S.folders(f).withColumn("path", F.lit(None).cast("string")))


@query("SELECT path FROM (SELECT 'p' || lpad(c_custkey::VARCHAR, 9, '0') AS path FROM customer) ORDER BY path LIMIT 7")
def first_files(t):
    """A limit that is the feature: the first papers in order of their paths."""
    return S.first_in_order(t.customer.select(F.concat(F.lit("p"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("path")), ["path"], 7)


SAMPLES = "WITH x AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)"


@query(SAMPLES + " SELECT o_custkey AS paper, i::INT AS index, CASE o_orderkey % 4 WHEN 1 THEN 'not an object' WHEN 2 THEN 'missing b' WHEN 3 THEN 'missing a, b' END AS reason FROM x")
def sample_rejects(t):
    """Samples of a JSON array and the reasons why some are none."""
    k = F.col("o_orderkey") % 4
    one = F.when(k == 0, '{"a":"x","b":"y"}').when(k == 1, "7").when(k == 2, '{"a":"x"}').otherwise("{}")
    docs = t.orders.groupBy(F.col("o_custkey").alias("path")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("j")))).alias("js"))
    docs = docs.select("path", F.parse_json(F.concat(F.lit("["), F.array_join(F.transform("js", lambda x: x["j"]), ","), F.lit("]"))).alias("v"))
    rows = S.samples(docs, ["a", "b"]).select(F.col("path").alias("paper"), "index", "reason")
    good, _ = K.split_rejects(rows)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(rows.where("reason is not null"))


@query("SELECT conv_id, count(*) AS n, sum(turn)::BIGINT AS turns FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def paper_contents(t):
    """Blocks at content or at paper.content."""
    js = F.to_json(F.array_sort(F.collect_list(F.struct("turn", "text"))))
    rows = t.conversations.where("trim(text) <> ''").groupBy("conv_id").agg(js.alias("c"))
    v = F.parse_json(F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('{"content":'), "c", F.lit("}"))).otherwise(F.concat(F.lit('{"content":5,"paper":{"content":'), "c", F.lit("}}"))))
    each = rows.select("conv_id", F.explode(S.content(v)).alias("b"))
    return each.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.try_variant_get("b", "$.turn", "long")).alias("turns"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND trim(lang) <> ''")
def write_once(t):
    return K.once(t.labels, t.documents.select("doc_id", "lang"), ["doc_id"], "lang")


@dataclass
class Counted:
    """As many notes as the request says, in pages."""

    def notes(self, request: str, offset: int, limit: int) -> list[str]:
        return [f"{request}/{i}" for i in range(offset, min(int(request), offset + limit))]


@dataclass
class Attached:
    """Notes whose number says which way has a file: a field, the public one, or none."""

    def attachment(self, note: str, field: str) -> bytes:
        if int(note) % 4 == 0 and field == "paper":
            return b"paper " + note.encode()
        if int(note) % 4 == 1:
            raise OSError(field)
        return b""

    def public(self, note: str) -> bytes | None:
        return b"public " + note.encode() if int(note) % 4 < 3 else None


@dataclass
class Found:
    """Results for words of an even or an odd length."""

    name: str
    even: bool

    def search(self, words: str, most: int) -> list[str]:
        return [f"{self.name} {words} {i}" for i in range(5)] if (len(words) % 2 == 0) == self.even else []


@dataclass
class Feeds:
    """Pages end in form feeds; a file that does not begin with P is unreadable."""

    def count(self, data: bytes) -> int:
        if not data.startswith(b"P"):
            raise ValueError("no pages")
        return data.count(b"\f") + 1


@query("SELECT n_nationkey, i::INT AS nth, n_nationkey || '/' || i AS note FROM (SELECT n_nationkey, unnest(range(n_nationkey)) AS i FROM nation)")
def paged_notes(t):
    asked = t.nation.select("n_nationkey", F.col("n_nationkey").cast("string").alias("r"))
    return X.fetch_notes(asked, "r", Counted(), limit=7).drop("r")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'paper ' || c_custkey WHEN 3 THEN NULL ELSE 'public ' || c_custkey END AS file FROM customer")
def file_fallback(t):
    asked = t.customer.select("c_custkey", F.col("c_custkey").cast("string").alias("note"))
    return X.download(asked, "note", Attached()).select("c_custkey", F.col("data").cast("string").alias("file"))


@query("SELECT c_custkey, ['a ' || c_custkey || ' 0', 'a ' || c_custkey || ' 1'] AS found FROM customer WHERE length(c_custkey::VARCHAR) % 2 = 0 UNION ALL SELECT c_custkey, ['b ' || c_custkey || ' 0', 'b ' || c_custkey || ' 1'] FROM customer WHERE length(c_custkey::VARCHAR) % 2 = 1")
def first_search_source(t):
    asked = t.customer.select("c_custkey", F.col("c_custkey").cast("string").alias("w"))
    return X.search(asked, "w", [Found("a", True), Found("b", False)], 2).drop("w")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE p_size + 1 END::INT AS pages FROM part")
def page_counts(t):
    body = F.concat(F.when(F.col("p_partkey") % 3 == 0, "?").otherwise("P"), F.expr("repeat('\\u000c', p_size)"))
    return X.count_pages(t.part.select("p_partkey", X.decoded(F.base64(F.encode(body, "UTF-8"))).alias("data")), "data", Feeds()).select("p_partkey", "pages")


@dataclass
class Paragraphs:
    """A file's paragraphs are its blocks; one that does not begin with P is unreadable."""

    def text(self, data: bytes) -> str:
        if not data.startswith(b"P"):
            raise ValueError("no text")
        return data.decode()

    def blocks(self, data: bytes) -> list[dict]:
        return [{"type": "text", "text": p} for p in self.text(data).split("\n\n")]


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'P' || p_brand || chr(10) || chr(10) || p_type END AS text, CASE WHEN p_partkey % 3 > 0 THEN 2 END AS n, CASE WHEN p_partkey % 3 > 0 THEN '2:' || p_type END AS last FROM (SELECT p_partkey, 'b' || p_size AS p_brand, 't' || p_size AS p_type FROM part)")
def parsed_files(t):
    """Files read into texts and blocks by a stand-in for a parser."""
    size = F.col("p_size").cast("string")
    body = F.concat(F.when(F.col("p_partkey") % 3 == 0, "?").otherwise("P"), F.lit("b"), size, F.lit("\n\nt"), size)
    files = t.part.select("p_partkey", F.encode(body, "UTF-8").alias("data"))
    read = X.read_blocks(X.read_text(files, "data", Paragraphs()), "data", Paragraphs()).withColumn("bs", S.content(F.col("v")))
    b = F.element_at("bs", -1)
    last = F.concat(F.try_variant_get(b, "$.index", "string"), F.lit(":"), F.try_variant_get(b, "$.text", "string"))
    return read.select("p_partkey", "text", F.when(F.col("bs").isNotNull(), F.size("bs")).alias("n"), last.alias("last"))


@query("SELECT r_regionkey::VARCHAR AS paper, r_name AS name, 4::BIGINT AS lines FROM region")
def paper_files(t):
    """One file a region with a field a line, read as whole texts."""
    at = folder(t)
    v = F.parse_json(F.concat(F.lit('{"name":"'), "r_name", F.lit('","none":null}')))
    K.write_papers(t.region.select("r_regionkey", v.alias("v")), at, "r_regionkey", "v")
    got = S.scan_json(t.spark, at, "*.txt").join(S.scan_text(t.spark, at, "*.txt").select("path", F.size(F.split(S.trimmed(F.col("value")), "\n")).cast("long").alias("lines")), "path")
    return got.select(F.split_part("folder", F.lit("="), F.lit(2)).alias("paper"), F.try_variant_get("v", "$.name", "string").alias("name"), "lines")
