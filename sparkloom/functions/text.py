"""String expressions. All are JVM-side; null stays null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman suffixes dropped from object names.
ROMAN_SUFFIX = r"(?i)[ _]+(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)$"


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def camel_to_words(c: Column) -> Column:
    return F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")


def normalize_name(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Underscores to spaces, spaces collapsed, Roman suffix dropped, lower case, aliases resolved."""
    plain = F.lower(F.trim(F.regexp_replace(collapse_spaces(F.regexp_replace(c, "_", " ")), ROMAN_SUFFIX, "")))
    return lookup(plain, aliases) if aliases else plain


def lookup(c: Column, table: dict[str, str]) -> Column:
    """``table[c]``, or c itself where the table has no entry."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c) if pairs else c


def first_nonempty(*columns: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns), F.lit(""))


def quoted_names(c: Column) -> Column:
    """Names in double or single straight quotes, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\"[^\"]+\"|'[^']+')"), F.lit(1)), lambda x: x.substr(F.lit(2), F.length(x) - 2))


def word_count(c: Column) -> Column:
    """Words between white space; 0 for a blank text."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def portable_path(c: Column, root: str) -> Column:
    """The path below ``root``; other paths as they are."""
    base = root.rstrip("/") + "/"
    return F.when(c.startswith(base), c.substr(F.lit(len(base) + 1), F.length(c))).otherwise(c)


def unsafe_path(c: Column) -> Column:
    """Absolute, or with a parent step."""
    return c.startswith("/") | F.array_contains(F.split(c, "/"), "..")


def canonical_path(c: Column) -> Column:
    """Without '.' steps and empty ones, '..' resolved; null if it would leave the root."""
    zero = F.array().cast("array<string>")
    step = lambda acc, x: F.when(acc.isNull(), None).when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))).otherwise(F.concat(acc, F.array(x)))
    steps = F.filter(F.split(c, "/"), lambda x: (x != "") & (x != "."))
    return F.array_join(F.aggregate(steps, zero, step), "/")


# Fixed value: what must not be published.
PRIVATE = r"(/(?:home|root|mnt|data|Users|workspace)/|-----BEGIN [A-Z ]*PRIVATE KEY-----|\bsk-[A-Za-z0-9]{16,}|\bhf_[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16})"


def is_private(c: Column) -> Column:
    return F.coalesce(c.rlike(PRIVATE), F.lit(False))


def classify_keywords(c: Column, rules: list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """The label of the first rule one of whose keywords occurs."""
    low, out = F.lower(c), None
    for label, words in rules:
        hit = low.rlike("|".join(words))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(default)


# Fixed value: the four spans of a trace of 32 frames.
TRACE_SPANS = [("01", "08"), ("09", "16"), ("17", "24"), ("25", "32")]
TRACE_MARK = r"(?:Segment\s+\d+\s*)?\[?(\d{2})\s*-\s*(\d{2})\]?\s*:"


def trace_is_valid(c: Column, low: int = 25, high: int = 85) -> Column:
    """Four paragraphs with the expected frame spans, each of ``low`` to ``high`` words."""
    spans = F.transform(F.regexp_extract_all(c, F.lit(TRACE_MARK), F.lit(0)), lambda m: F.concat_ws("-", F.regexp_extract(m, TRACE_MARK, 1), F.regexp_extract(m, TRACE_MARK, 2)))
    parts = F.split(c, TRACE_MARK, -1)
    counts = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), word_count)
    wanted = F.array(*(F.lit(f"{a}-{b}") for a, b in TRACE_SPANS))
    return F.coalesce((spans == wanted) & F.forall(counts, lambda n: n.between(low, high)), F.lit(False))


def media_parts(c: Column, tag: str = "<video>") -> Column:
    """A prompt cut at media tags: array of (type, text), in order, without empty texts."""
    pieces = F.split(c, tag, -1)
    each = F.transform(pieces, lambda x, i: F.array(F.struct(F.lit("video").alias("type"), F.lit(None).cast("string").alias("text"), (i > 0).alias("keep")), F.struct(F.lit("text").alias("type"), x.alias("text"), (x != "").alias("keep"))))
    return F.transform(F.filter(F.flatten(each), lambda x: x["keep"]), lambda x: F.struct(x["type"], x["text"]))


def clean_question(c: Column) -> Column:
    """A question without media tags and without instructions on the answer's format."""
    bare = F.regexp_replace(c, r"(?i)<(?:image|video)>", "")
    return collapse_spaces(F.regexp_replace(bare, r"(?i)(?:please\s+)?answer\s+(?:with|using)\s+[^.\n]*\.?", ""))


def frame_range(c: Column) -> Column:
    """struct(first, last) of 'frames 3-17', 'frame 5 to 9' or '[03-17]'; a single 'frame 5' is both ends; null without any."""
    span = r"(?i)(?:frames?\s*)?\[?(\d+)\s*(?:-|to|through)\s*(\d+)\]?"
    alone = r"(?i)\bframe\s*#?(\d+)"
    a, b, one = (F.nullif(F.regexp_extract(c, p, i), F.lit("")).cast("long") for p, i in ((span, 1), (span, 2), (alone, 1)))
    return F.when(a.isNotNull(), F.struct(a.alias("first"), b.alias("last"))).when(one.isNotNull(), F.struct(one.alias("first"), one.alias("last")))


def option_lines(c: Column) -> Column:
    """array<struct<label,text>> of lines such as 'A. text', 'B) text' or '(C) text'."""
    line = r"(?m)^\s*\(?([A-H])[.):]\s*(.+?)\s*$"
    return F.transform(F.regexp_extract_all(c, F.lit(line), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, line, 1).alias("label"), F.regexp_extract(m, line, 2).alias("text")))
