"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Spans come from regular expressions run on the JVM; where a match stands follows
from the lengths of the gaps and matches before it. Values are then hashed and
counted by distinct owners and repositories over the whole corpus: a value that
many owners hold is a copied example, one that stays with a single owner looks live.

Null or empty texts have no spans. Documents without an owner count as one owner, those
without a repository column value as one repository of their owner. Ties in start go by the
order of the kinds. Repeated rows each give a row. Extra columns are ignored by ``scan`` and
kept by ``redact``. Empty tables give no rows. Work is linear in a text, however many matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, packed, release_own, replace_spans, unpacked

# The base kinds, in the order in which they are listed.
# name: (pattern, group holding the value, least length of that group)
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
# Public credential formats that the method adds.
ADDED = {
    "provider": (r"gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}", 0, 10),
    "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 10),
}
KINDS = [*BASE, *ADDED]


def _matches(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of the leftmost non-overlapping matches of one kind: the characters between
    the match before and this one, its own, and its value."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gap = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    parts = F.transform(
        F.arrays_zip(gap.alias("gap"), whole.alias("whole"), value.alias("value")),
        lambda p, i: F.struct(
            F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), i.alias("place"), F.length(p["gap"]).alias("gap"), F.length(p["whole"]).alias("len"),
            F.when(F.length(p["value"]) >= least, F.xxhash64(p["value"])).alias("value"),
        ),
    )
    none = F.array().cast("array<struct<rank:int,kind:string,place:int,gap:int,len:int,value:bigint>>")
    return F.when(text.rlike(pattern), parts).otherwise(none)


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repository: str | None = "lang", keep: tuple[str, ...] = ("doc_id",), example_owners: int = 3) -> DataFrame:
    """One row per document: the ``keep`` columns, ``text_hash`` and ``found``.

    ``found`` is an array, by start then kind, of struct(start, rank, kind, stop,
    value, n_owners, n_repositories, live); positions are code points, the end
    exclusive. ``live`` is true where fewer than ``example_owners`` owners hold the
    value. A repository is an owner's folder: (owner, ``repository`` column).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    arrays = [_matches(body, i, k, *(BASE | ADDED)[k]) for i, k in enumerate(KINDS)]
    rows = docs.select(
        *keep,
        F.xxhash64(body).alias("text_hash"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"),
        F.coalesce((F.col(repository) if repository else F.lit("")).cast("string"), F.lit("")).alias("_repository"),
        F.concat(*arrays).alias("_matches"),
    )
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "matches")
    each = rows.filter(F.size("_matches") > 0).select("_row", "_owner", "_repository", F.inline("_matches"))
    # A match ends where the gaps and matches up to it end; only then are short values dropped.
    along = Window.partitionBy("_row", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(along).cast("int")).filter("value is not null")
    span = F.struct((F.col("stop") - F.col("len")).alias("start"), "rank", "kind", "stop", "value")
    each = materialise(each.select("_row", "_owner", "_repository", span.alias("s")), "spans")
    held = each.groupBy(F.col("s.value").alias("value"), "_owner", "_repository").agg(F.count(F.lit(1)).alias("n"))
    owners = held.groupBy("value", "_owner").agg(F.count(F.lit(1)).alias("r"))
    spread = owners.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("r").alias("n_repositories"))
    judged = (
        each.join(spread, each["s.value"] == spread["value"])
        .select(
            "_row",
            F.struct("s.*", "n_owners", "n_repositories", (F.col("n_owners") < example_owners).alias("live")).alias("f"),
        )
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list("f")).alias("found"))
    )
    none = F.array().cast(judged.schema["found"].dataType)
    return rows.join(judged, "_row", "left").select(*keep, "text_hash", F.coalesce("found", none).alias("found"))


def joined(found: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", owner: str = "source", repository: str | None = "lang", doc_id: str = "doc_id", mask: str = "[REDACTED]", example_owners: int = 3) -> DataFrame:
    """``docs`` with the live-looking spans of ``text`` replaced by ``mask``.

    Overlapping spans are masked as one. Copied examples stay. Only documents with
    live spans meet the join's right side; the others pass unchanged.
    """
    found = scan(docs, text, owner, repository, (doc_id,), example_owners)
    hits = found.filter(F.exists("found", lambda s: s["live"])).dropDuplicates([doc_id, "text_hash"])
    live = hits.select(F.col(doc_id).alias("_id"), F.col("text_hash").alias("_hash"), F.explode("found").alias("s")).filter("s.live").select("_id", "_hash", "s.start", "s.stop")
    along = Window.partitionBy("_id", "_hash").orderBy("start", "stop")
    reached = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reached.isNull() | (F.col("start") >= reached)).cast("int")
    live = live.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = live.groupBy("_id", "_hash", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    hits = runs.groupBy("_id", "_hash").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_live"))
    hits = materialise(hits, "live")
    release_own(found, docs)
    rows = packed(docs, id=F.col(doc_id), body=F.col(text), hash=F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.join(hits, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    new = F.when(F.col("_live").isNull(), F.col("body")).otherwise(replace_spans(F.col("body"), F.col("_live"), mask))
    return rows.select(*unpacked(rows, docs.columns, **{text: new}))
