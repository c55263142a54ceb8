"""Secret scans by corpus-wide ownership frequency, with DataFrame functions only.

Each text is scanned for candidates by pattern. The hashes of all candidates
are then counted over the corpus by distinct owners and repositories: a value
that many owners hold is a copied example, one that stays with few owners looks
live. Base candidates are always reported, with that verdict; bare tokens that
no keyword announces are reported only where they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, small

# The three base kinds in their order, then the kind added here.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
BARE = r"[A-Za-z0-9+_-]{20,}"
KINDS = ("assign", "access", "hex", "bare")

#: Owners, or repositories of however few owners, from which on a value counts as widely copied.
COPIED_FROM = 3
COPIED_REPOS = 6


def _literal(pattern: str) -> Column:
    return F.lit(pattern)


def _spans(found: Column, gaps: Column, kind: int) -> Column:
    """The matches ``found`` as (start, kind, end, value): code points, end exclusive; ``gaps`` are the lengths between them.

    Positions are sums of lengths. A text of n matches takes steps of n: sums
    run over parts of about the square root of n matches, and within each.
    """
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    width = F.ceil(F.sqrt(F.size(found))).cast("int")
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / width).cast("int")), lambda i: i * width + 1)
    steps = lambda i: F.zip_with(F.slice(gaps, i, width), F.slice(found, i, F.least(width, F.size(found) - i + 1)), lambda g, m: F.when(m.isNotNull(), g + F.length(m)).otherwise(0))
    running = lambda lengths, first: F.aggregate(lengths, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    offsets = running(F.transform(starts, lambda i: F.aggregate(steps(i), F.lit(0), lambda acc, x: acc + x)), F.lit(0))

    def part(i: Column, offset: Column) -> Column:
        matches = F.slice(found, i, width)
        ends = F.slice(running(steps(i), offset), F.lit(2), F.size(matches))
        return F.zip_with(matches, ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m.alias("value")))

    return F.when(F.size(found) > 0, F.flatten(F.zip_with(starts, F.slice(offsets, F.lit(1), F.size(starts)), part))).otherwise(none)


def _value(span: Column) -> Column:
    return F.when(span["kind"] == 0, F.regexp_extract(span["value"], ASSIGN, 2)).otherwise(span["value"])


def with_candidates(rows: DataFrame) -> DataFrame:
    """``rows`` with base and bare, the candidates of the column text: arrays of (start, kind, end, hash).

    Each pattern runs over a text once, in a projection of its own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    patterns = (ASSIGN, ACCESS, HEX, BARE)
    found = rows.withColumns({f"found{k}": F.when(text.rlike(p), F.regexp_extract_all(text, _literal(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for k, p in enumerate(patterns)})
    found = found.withColumns({f"gaps{k}": F.when(F.size(f"found{k}") > 0, F.transform(F.split(text, p, -1), F.length)) for k, p in enumerate(patterns)})
    spans = [_spans(F.col(f"found{k}"), F.col(f"gaps{k}"), k) for k in range(len(patterns))]
    assign = F.filter(spans[0], lambda x: F.length(_value(x)) >= 12)
    access = F.filter(spans[1], lambda x: F.length(x["value"]) >= 18)
    bare = F.filter(spans[3], lambda x: x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[0-9]"))
    hashed = lambda x: F.struct(x["start"], x["kind"], x["end"], F.md5(_value(x).cast("binary")).alias("hash"))
    out = found.withColumn("base", F.concat(assign, access, spans[2])).withColumn("bare", bare)
    free = lambda x: ~F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    out = out.withColumn("bare", F.transform(F.filter("bare", free), hashed)).withColumn("base", F.sort_array(F.transform("base", hashed)))
    return out.drop(*(f"{c}{k}" for c in ("found", "gaps") for k in range(len(patterns))))


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos from rows (hash, owner, repo). Each level combines before it shuffles."""
    each = candidates.select("hash", "owner", "repo").distinct()
    by_owner = each.groupBy("hash", "owner").agg(F.count("repo").alias("repos"))
    return by_owner.groupBy("hash").agg(F.count("owner").alias("n_owners"), F.sum("repos").alias("n_repos"))


def widely_copied(found: DataFrame, copied_from: int = COPIED_FROM, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """hash of the candidates that many owners, or many repositories of few owners, hold."""
    each = found.select("owner", "repo", F.explode(F.concat("base", "bare")).alias("x")).select("x.hash", "owner", "repo")
    owned = ownership(each).where((F.col("n_owners") >= copied_from) | (F.col("n_repos") >= copied_repos))
    return materialize(owned.select("hash"), "copied")


def _copied_by_id(found: DataFrame, copied_from: int, copied_repos: int) -> DataFrame:
    """id, copied: for each id with any, the hashes of its candidates that are widely copied."""
    each = found.select("id", F.explode(F.concat("base", "bare")).alias("x")).select("id", "x.hash").distinct()
    by_id = each.join(small(widely_copied(found, copied_from, copied_repos)), "hash").groupBy("id")
    return small(materialize(by_id.agg(F.sort_array(F.collect_set("hash")).alias("copied")), "copied"))


def _with_copied(rows: DataFrame, copied: DataFrame) -> DataFrame:
    """``rows`` with the column copied, by id; null where there are none."""
    return rows.join(copied.withColumnRenamed("id", "of"), F.col("id").eqNullSafe(F.col("of")), "left").drop("of")


def _is_copied(span: Column) -> Column:
    return F.coalesce(F.array_contains("copied", span["hash"]), F.lit(False))


def _found(docs: DataFrame, id_col: str, text_col: str, owner: Column | None, repo: Column | None) -> DataFrame:
    """id, owner, repo, base, bare of every row, in a table of the shared folder."""
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"))
    return materialize(with_candidates(read).select("id", "owner", "repo", "base", "bare"), "secrets")


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, copied_from: int = COPIED_FROM, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """Secrets of every text.

    Returns id_col, base and added: arrays of (start, kind, end, hash, copied),
    by start and kind; kind is an index into KINDS. ``copied`` tells examples
    that ``copied_from`` owners or ``copied_repos`` repositories or more hold from
    live-looking values; a bare token is added only if it isn't copied. Owner and repository are columns of
    ``docs``; by default the source stands in for the owner, and the source with the
    language for the repository. A null owner is no owner. Null and empty texts have no spans; repeated rows give
    repeated rows; an empty table an empty one; other columns aren't read.

    One scan of the texts, whose narrow outcome is written to the shared
    folder; what is shuffled are candidates and a row for each document.
    """
    found = _found(docs, id_col, text_col, owner, repo)
    joined = _with_copied(found, _copied_by_id(found, copied_from, copied_repos))
    marked = lambda x: F.struct(x["start"], x["kind"], x["end"], x["hash"], _is_copied(x).alias("copied"))
    return joined.select(F.col("id").alias(id_col), F.transform("base", marked).alias("base"), F.transform(F.filter("bare", lambda x: ~_is_copied(x)), marked).alias("added"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def summarize(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    every = F.sort_array(F.concat("base", "added"))
    live = F.size(F.filter(every, lambda x: ~x["copied"])).cast("long")
    return scanned.select(id_col, *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(every).alias("spans"), live.alias("n_live"), (F.size(every) - live).cast("long").alias("n_copied"))


def redact_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, copied_from: int = COPIED_FROM, copied_repos: int = COPIED_REPOS, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with live-looking secrets masked in the text; every row stays, with the same columns.

    Copied examples stay as they are. Overlapping spans are masked as one. Null
    texts stay null, repeated rows stay repeated, an empty table stays empty;
    other columns, whatever their names, are carried along.
    """
    copied = _copied_by_id(_found(docs, id_col, text_col, owner, repo), copied_from, copied_repos)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = _with_copied(with_candidates(rows), copied)
    live = F.sort_array(F.filter(F.concat("base", "bare"), lambda x: ~_is_copied(x)))
    text, zero = F.col("text"), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = text.substr(acc["at"] + 1, x["start"] - acc["at"])
        out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(F.concat(gap, F.lit(mask))))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    done = joined.withColumn("live", live).withColumn("done", F.when((F.size("live") > 0) & text.isNotNull(), F.aggregate("live", zero, step)))
    masked = F.concat(F.array_join("done.out", ""), text.substr(F.col("done.at") + 1, F.length(text)))
    new = F.when(F.col("done").isNull(), F.col(f"row.`{text_col}`")).otherwise(masked)
    return done.select(*(new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
