"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Edge punctuation of lines: fixed values.
RESERVED = " .·•|-–—~"
#: White space that trimming takes, beyond ASCII too: fixed values.
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: The same characters as a text.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Ends of lines: fixed values.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def split_lines(text: Column) -> Column:
    """The lines of a text, without a last empty one; an empty text has none."""
    return bound(F.split(text, LINE_END), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def norm_line(line: Column) -> Column:
    """Comparable form of a line: no heading marks, single spaces, no edge punctuation, lower case;
    empty if fewer than five characters other than spaces are left."""
    x = F.regexp_replace(trimmed(line), r"(?U)^[#*]+\s*", "")
    x = F.regexp_replace(x, r"(?U)\s+", " ")
    x = F.lower(F.btrim(x, F.lit(RESERVED)))
    return bound(x, lambda y: F.when(F.length(F.replace(y, F.lit(" "), F.lit(""))) >= 5, y).otherwise(""))


def expand_ranges(expr: Column) -> Column:
    """'1-3,5' to [1, 2, 3, 5]: reversed ranges are accepted, junk is skipped, repeats dropped in order."""

    def one(part: Column) -> Column:
        ends = F.transform(F.split(part, "-"), lambda e: F.trim(e).try_cast("int"))
        a, b = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
        span = F.when(F.size(ends) == 2, F.sequence(F.least(a, b), F.greatest(a, b))).when(F.size(ends) == 1, F.array(a))
        ok = ~F.exists(ends, lambda e: e.isNull()) & F.size(ends).between(1, 2)
        return F.when(ok, span).otherwise(F.expr("cast(array() as array<int>)"))

    return F.array_distinct(F.flatten(F.transform(F.split(expr, ","), one)))


def format_range(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first, last))


def citation_keys(text: Column) -> Column:
    """'surname|year' of 'Name et al., YYYY', then of 'A & B, YYYY' and 'A and B, YYYY' (the first name), in
    lower case, then n of '[n]' without leading zeros; each once, in order of the text. Null has none."""
    text, name = F.coalesce(text, F.lit("")), r"[A-Z][A-Za-z\-]+"

    def named(pattern: str) -> Column:
        whole = F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))  # the parts are then taken from the few matches
        return F.transform(whole, lambda m: F.concat_ws("|", F.lower(F.regexp_extract(m, "(?U)" + pattern, 1)), F.regexp_extract(m, "(?U)" + pattern, 2)))

    number = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\[(\d+)\]"), F.lit(1)), lambda n: F.coalesce(F.nullif(F.ltrim(n, F.lit("0")), F.lit("")), F.lit("0")))
    return F.array_distinct(F.concat(named(rf"\b({name})\s+et al\.,\s*(\d{{4}})"), named(rf"\b({name})\s*(?:&|and)\s*{name}\s*,\s*(\d{{4}})"), number))


def first_tag(text: Column, tag: str) -> Column:
    """What stands in the first <tag>, trimmed; empty if there is none."""
    return trimmed(F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1))


def strip_fence(text: Column) -> Column:
    """An answer without a fence around it, plain or json, and without a leading word json; any case, trimmed."""
    x = F.regexp_replace(trimmed(text), rf"(?i)^```(?:json)?(?:{BLANK})?", "")
    x = F.regexp_replace(x, rf"(?:{BLANK})?```$", "")
    return trimmed(F.regexp_replace(x, rf"(?i)^(?:{BLANK})?json(?:{BLANK})?", ""))


def drop_reasoning(text: Column) -> Column:
    """A text without its <think> parts, in any case where one of the tags is in small letters; not trimmed."""
    tagged = F.contains(text, F.lit("<think>")) | F.contains(text, F.lit("</think>"))
    return F.when(tagged, F.regexp_replace(text, r"(?is)<think>.*?</think>", "")).otherwise(text)


def between_markers(text: Column, begin: str, end: str) -> Column:
    """What stands between the first begin and the first end after it, trimmed; empty without begin."""
    rest = F.substr(text, F.locate(begin, text) + len(begin))
    return F.when(F.contains(text, F.lit(begin)), trimmed(F.substring_index(rest, end, 1))).otherwise("")


#: Headings that open a review, and a heading of one of its sections: fixed values.
REVIEW_HEADINGS = [
    r"(?im)^\s*(reviewer\s*\#?\s*\d+)\s*[:\-—]\s*$",
    r"(?im)^\s*(review\s*\#?\s*\d+)\s*[:\-—]\s*$",
    r"(?im)^\s*(meta[-\s]*review)\s*[:\-—]\s*$",
    r"(?im)^\s*#{1,6}\s*(reviewer\s*\#?\s*\d+|review\s*\#?\s*\d+)\s*$",
]
SECTION_HEADING, SUMMARY_HEADING = r"(?im)^\s*#{2,6}\s*(summary|strengths|weaknesses|overall)\b", r"(?im)^\s*#{2,6}\s*summary\b"
RULE_LINE = r"(?m)^\s*[-=_]{8,}\s*$"


def split_reviews(text: Column, least: int = 500) -> Column:
    """The reviews of a text: parts between rule lines, else from heading to heading of the first kind of
    heading, else from one Summary to the next, where that gives two or more of at least `least`
    characters; else the text alone. A blank text has none."""

    def long(parts: Column) -> Column:
        return F.filter(F.transform(parts, trimmed), lambda p: F.length(p) >= least)

    def several(parts: Column) -> Column:
        return bound(long(parts), lambda chunks: F.when(F.size(chunks) >= 2, chunks))

    def headed(body: Column, pattern: str, enough: Column | None = None) -> Column:
        def chosen(parts: Column) -> Column:
            ok = F.size(parts) > 2
            return F.when(ok if enough is None else ok & enough, several(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))))

        return bound(F.split(F.regexp_replace(body, pattern, "\ue000$0"), "\ue000"), chosen)

    def reviews(body: Column) -> Column:
        said = lambda word: F.contains(F.lower(body), F.lit(word))  # noqa: E731  found sooner than a heading with the word
        named = F.when(said("review"), F.coalesce(*[headed(body, p) for p in REVIEW_HEADINGS]))
        ways = [several(F.split(body, RULE_LINE)), named, F.when(said("summary"), headed(body, SUMMARY_HEADING, F.regexp_count(body, F.lit(SECTION_HEADING)) >= 4))]
        return F.when(body == "", F.array().cast("array<string>")).otherwise(F.coalesce(*ways, F.array(body)))

    return bound(trimmed(F.coalesce(text, F.lit(""))), reviews)


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_.-]", "_")


def _scores_on_lines(text: Column) -> Column:
    """text with its scores on lines of their own, where a heading runs into the first."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)(###\s*Score)\s*-\s*", "$1\n- ")
    return F.regexp_replace(x, r"(?i)(#+\s*Score)\s*:\s*", "$1:\n")


def score_label(text: Column, label: str, most: int = 10) -> Column:
    """The first 'Label (most): value' of a text, at a line's start or else anywhere; ASCII or wide colon; not clamped."""
    return bound(_scores_on_lines(text), lambda x: _score(x, label, most))


def _score(x: Column, label: str, most: int) -> Column:
    body = rf"{label}\s*\(\s*{most}\s*\)\s*[:：]\s*(\d+)\b"
    strict, loose = F.regexp_extract(x, rf"(?im)^\s*(?:[-*]\s*)?{body}", 1), F.regexp_extract(x, rf"(?is)\b{body}", 1)
    return bound(strict, lambda s: F.when(s != "", s).otherwise(F.nullif(loose, F.lit("")))).try_cast("int")


def score_card(text: Column, labels: dict[str, int]) -> Column:
    """parsed, a map of the labels found to their values, max, and missing, the labels that were not."""

    def card(found: Column) -> Column:
        parsed = F.map_from_entries(F.filter(found, lambda e: e["value"].isNotNull()))
        missing = F.transform(F.filter(found, lambda e: e["value"].isNull()), lambda e: e["label"])
        return F.struct(parsed.alias("parsed"), F.create_map(*[F.lit(x) for e in labels.items() for x in e]).alias("max"), missing.alias("missing"))

    found = lambda x: F.array(*[F.struct(F.lit(k).alias("label"), _score(x, k, most).alias("value")) for k, most in labels.items()])
    return bound(bound(_scores_on_lines(text), found), card)


def score_lists(text: Column, labels: dict[str, int]) -> dict[str, Column]:
    """All values of each label in list items, clamped to 0 .. its most."""
    lines = _scores_on_lines(text)

    def one(label: str, most: int) -> Column:
        found = F.regexp_extract_all(lines, F.lit(rf"(?im)^\s*-\s*{label}\s*\(\s*{most}\s*\)\s*[:：]\s*(\d+)\b"), F.lit(1))
        return F.transform(found, lambda v: F.least(F.lit(most), F.greatest(F.lit(0), v.try_cast("int"))))

    return {label: one(label, most) for label, most in labels.items()}


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, trimmed; blank ones are dropped."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.btrim(p, F.lit(" \n\r\t"))), lambda p: p != "")


def keywords(text: Column) -> Column:
    """The parts of a comma list, trimmed; blank ones are dropped."""
    return F.filter(F.transform(F.split(text, ","), trimmed), lambda k: k != "")


def cut_to(text: Column, most: int, mark: str = "") -> Column:
    """The first most characters, with mark after them where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def data_uri(data: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.replace(F.base64(data), F.lit("\r\n"), F.lit("")))


def headed_sections(text: Column) -> Column:
    """A map of '# title' lines to the texts below them: of equal titles the last wins, text before the first is left out."""
    pieces = F.split(F.concat(F.lit("\n"), text), f"(?:{LINE_END})# ")
    parts = F.slice(pieces, F.lit(2), F.greatest(F.lit(0), F.size(pieces) - 1))
    ends = F.transform(parts, lambda p: F.split(p, LINE_END, 2))
    title = F.transform(ends, lambda e: trimmed(F.get(e, F.lit(0))))
    body = F.transform(ends, lambda e: trimmed(F.coalesce(F.get(e, F.lit(1)), F.lit(""))))
    pairs = F.arrays_zip(title.alias("title"), body.alias("body"))
    last = F.filter(pairs, lambda x, i: ~F.array_contains(F.slice(title, i + 2, F.size(title)), x["title"]))
    return F.map_from_entries(last)


def four_line_parts(text: Column) -> Column:
    """Parts between runs of four line ends, trimmed, without blank ones; the trimmed text if all are blank."""
    parts = F.filter(F.transform(F.split(text, "\n\n\n\n"), trimmed), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(trimmed(text)))


def flat_name(text: Column) -> Column:
    """As safe_name, without points."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_")


def squeezed_name(text: Column) -> Column:
    """ASCII letters, digits, lines and dashes; each run of others one line."""
    return F.regexp_replace(text, r"[^0-9A-Za-z_-]+", "_")


def safe_title(text: Column, most: int = 160) -> Column:
    """A title as a file's name, at most so many characters; blank is no_title."""
    x = F.regexp_replace(F.regexp_replace(trimmed(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_. -]", "_"), " ", "_")
    return F.substring(F.when(x == "", "no_title").otherwise(x), 1, most)


def model_tag(name: Column) -> Column:
    return F.replace(F.coalesce(name, F.lit("")), F.lit("/"), F.lit("_"))


def safe_string(text: Column, default: str = "") -> Column:
    return F.coalesce(F.nullif(trimmed(text), F.lit("")), F.lit(default))


def image_mime(data: Column) -> Column:
    """The type of an image by the first characters of its base64 text; PNG if unknown."""
    return F.when(data.startswith("/9j/"), "image/jpeg").when(data.startswith("R0lGOD"), "image/gif").otherwise("image/png")


def fetchable(url: Column) -> Column:
    return F.coalesce(url.startswith("http") | url.startswith("data:"), F.lit(False))


def event_content(line: Column) -> Column:
    """The text that a line of an event stream adds; empty for its end and for what is no such line."""
    body = trimmed(F.regexp_replace(line, "^data: ", ""))
    return F.coalesce(F.try_variant_get(F.try_parse_json(body), "$.choices[0].delta.content", "string"), F.lit(""))


def event_line(content: Column) -> Column:
    """A line of an event stream that adds content."""
    choice = F.struct(F.struct(content.alias("content")).alias("delta"))
    return F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("chat.completion.chunk").alias("object"), F.array(choice).alias("choices"))), F.lit("\n\n"))


def rejoined_answer(text: Column) -> Column:
    """An answer as a stream of its paragraphs gives it: what stands between blank lines, with nothing between."""
    return F.array_join(F.split(text, "\n\n"), "")


def similar_work(title: Column, authors: Column, abstract: Column, resemblance: Column) -> Column:
    """A paper like the one at hand, as a prompt shows it: the form is fixed."""
    return F.concat(F.lit("<paper>\nTitle: "), title, F.lit("\nAuthors: "), authors, F.lit("\nAbstract: "), abstract, F.lit("\nResemblance Analysis: "), resemblance, F.lit("</paper>"))


def indented_json(v: Column) -> Column:
    """A variant's JSON with a field a line and two spaces a level, as files for people have it."""
    return _indented(F.to_json(v))


@F.pandas_udf(StringType())
def _indented(x):  # noqa: ANN001, ANN202  types are given by the decorator
    import json

    return x.map(lambda t: json.dumps(json.loads(t), ensure_ascii=False, indent=2), na_action="ignore")
