"""Mixing sources to target weights by Sainte-Laguë apportionment.

Words are cut into equal blocks. Sources get whole blocks by the highest quotients
``target / (2k + 1)``; a source's blocks go to its shards (seeded, bounded groups of
documents) by the same rule. A shard lays its documents out in a seeded order, repeats
all of them as often as the quota holds all blocks, and picks the rest as a run of blocks
from a seeded place on, so that few documents are cut and blocks need no listing.

A null text has size 0 and null sources are a source of their own, last in the order.
Documents of size 0 and sources without words take 0. Repeated rows are separate
documents; those with one id, a null id too, lie side by side in the order of their sizes.
Extra columns are ignored by ``mix`` and kept by ``mixed_documents``. An empty table gives an
empty result.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, packed, release_own, unpacked

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source (columns source, source_size, weight, target) the words it should give.

    ``sizes`` has source and source_size, one row per source. Sources are numbered
    by code point through range partitions, so no task sees them all. A level ``x``
    with target = min(weight * x, most * size) is found by rounds of one aggregate.
    """
    spread = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    spread = materialise(spread, "sources")
    offsets = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = spread.withColumn("place", place).join(offsets, "part").withColumn("place", F.col("place") + F.col("before"))
    choose = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    ranked = materialise(ranked.select("source", "source_size", choose.alias("weight")), "ranked", spread)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    goal, level, full = share * total, 0.0, -1
    while total:
        over = F.col("weight") * F.lit(level) >= most * F.col("source_size")
        row = ranked.agg(
            F.sum(F.when(over, F.col("source_size")).otherwise(0)).alias("s"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("w"), F.sum(over.cast("int")).alias("n"),
        ).first()
        if row.n == full or not row.w:
            break
        full, level = row.n, (goal - most * row.s) / row.w
    target = F.least(F.col("weight") * F.lit(level), most * F.col("source_size"))
    return ranked.withColumn("target", target.cast("double"))


def apportion_table(votes: DataFrame, key: str, vote: str, seats: int, rounds: int = 12, width: int = 32) -> DataFrame:
    """Sainte-Laguë seats for every row of ``votes``, which may be large.

    Highest quotients equal rounding ``vote / divisor`` half up for the right
    divisor. Each round counts the seats of ``width`` divisors in one aggregate;
    quotients that still tie at the end go by key order.
    """
    total = votes.agg(F.sum(vote)).first()[0] or 0.0
    if not seats or total <= 0:
        return votes.withColumn("seats", F.lit(0).cast("long"))
    count = lambda d: F.floor(F.col(vote) / F.lit(d) + 0.5).cast("long")
    low, high = 0.0, 2.0 * total + 1  # too many seats at low, too few at high
    few = high
    for k in range(rounds):
        middle = total / seats
        if k == 0:
            tries = [middle * (0.5 + i / (width - 1)) for i in range(width)]
        else:
            tries = [low + (high - low) * (i + 1) / (width + 1) for i in range(width)]
        sums = votes.agg(*[F.sum(count(d)).alias(f"s{i}") for i, d in enumerate(tries)]).first()
        for d, s in zip(tries, sums):
            if s >= seats:
                low = max(low, d)
            else:
                high = min(high, d)
        exact = [d for d, s in zip(tries, sums) if s == seats]
        few = high
        if exact:
            return votes.withColumn("seats", count(exact[0]))
        if high - low <= 1e-13 * high:
            break
    base = votes.withColumn("seats", count(few))
    left = seats - (base.agg(F.sum("seats")).first()[0] or 0)
    best = base.orderBy((F.col(vote) / (2 * F.col("seats") + 1)).desc(), F.col(key).asc_nulls_last()).limit(left)
    more = best.select(F.col(key).alias("_k"), F.lit(1).alias("_more"))
    out = base.join(more, base[key].eqNullSafe(more["_k"]), "left")
    return out.withColumn("seats", F.col("seats") + F.coalesce("_more", F.lit(0))).drop("_k", "_more")


def apportion(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Sainte-Laguë seats for a bounded list, ties to the earlier entry. Who has ``most`` seats
    takes no more; they go to the next quotient."""
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    most = most or [seats] * len(votes)
    out = [int(math.floor(v * seats / total)) for v in votes]
    # Start below every final count, then hand out by highest quotient.
    out = [min(m, max(0, n - 1) if v < total else n) for n, v, m in zip(out, votes, most)]
    import heapq

    heap = [(-v / (2 * n + 1), i) for i, (v, n) in enumerate(zip(votes, out)) if v > 0 and n < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        if not heap:
            break  # all have their most
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", keep: tuple[str, ...] = (), weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 2, shard_words: int = 1 << 18, shard_group: int = 1024, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, the ``keep`` columns, size, source_size, target,
    taken, and how: ``copies`` (whole repeats) and ``picks`` (array of struct(start,
    stop): the word ranges taken beside them).

    Shards follow the data. Blocks go to groups of shards first, then to the shards of each
    group, so that no task sees all shards of a large source.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(source).cast("string").alias("source"), size.alias("size"))
    # Sizes are hundredths of the texts: moved together first, they are not a tiny file of each task.
    rows = materialise(rows.hint("rebalance"), "sizes")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    blocks = goal.agg(F.sum("target")).first()[0] or 0.0
    made = goal
    goal = materialise(goal, "targets")
    release_own(made, rows)
    seats = apportion_table(goal, "source", "target", math.floor(blocks / block_words + 0.5))
    n_shards = F.ceil(F.col("source_size") / shard_words).cast("long")
    seats = materialise(seats.withColumn("n_shards", F.greatest(n_shards, F.lit(1))), "seats", goal)

    a, b = rows.alias("a"), seats.select(F.col("source").alias("_s"), "source_size", "target", "n_shards")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    placed = a.join(b, F.col("a.source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("size")), F.col("n_shards")))
    # A shard of some words holds ``most`` times its blocks at most.
    most_blocks = F.greatest(F.ceil(F.col("words") / block_words), F.lit(1)).cast("long") * F.lit(int(most))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("words")).withColumn("most", most_blocks)
    shards = materialise(shards.withColumn("team", F.floor(F.col("shard") / shard_group).cast("long")), "shards")
    teams = shards.groupBy("source", "team").agg(F.sum("words").alias("words"), F.sum("most").alias("most"))
    teams = teams.join(seats.select(F.col("source").alias("_s"), "seats"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    def share_out(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        words, most = ([int(w or 0) for w in pdf[c]] for c in ("words", "most"))
        quota = apportion([float(w) for w in words], int(pdf["seats"].iloc[0]), most)
        return pd.DataFrame({"_q": pdf["source"], "_place": pdf["place"], "shard_words": words, "quota": quota})

    given = "_q string, _place long, shard_words long, quota long"
    teams = teams.withColumn("place", F.col("team")).groupBy("source").applyInPandas(share_out, given)
    teams = teams.select(F.col("_q").alias("_s"), F.col("_place").alias("_t"), F.col("quota").alias("seats"))
    inner = shards.join(teams, F.col("source").eqNullSafe(F.col("_s")) & (F.col("team") == F.col("_t"))).withColumn("place", F.col("shard"))
    quotas = inner.select("source", "team", "place", "words", "most", "seats").groupBy("source", "team").applyInPandas(share_out, given)
    quotas = materialise(quotas.withColumnRenamed("_place", "_shard"), "quotas", shards)
    full = placed.join(quotas, F.col("source").eqNullSafe(F.col("_q")) & (F.col("shard") == F.col("_shard"))).drop("_q", "_shard")
    line = Window.partitionBy("source", "shard").orderBy(order, "doc_id", "size")
    full = full.withColumn("stop", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    full = full.withColumn("start", F.col("stop") - F.col("size"))
    n_blocks = F.greatest(F.ceil(F.col("shard_words") / block_words), F.lit(1)).cast("long")  # an empty shard takes nothing either way
    full = full.withColumn("n_blocks", n_blocks)
    full = full.withColumn("copies", F.floor(F.col("quota") / F.col("n_blocks")).cast("long")).withColumn("extra", F.pmod("quota", "n_blocks"))
    full = full.withColumn("shift", F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.col("n_blocks")))
    # The picked blocks are a run from the seeded shift on, and what wraps round to the start.
    first, end = F.col("shift") * block_words, (F.col("shift") + F.col("extra")) * block_words
    wrapped = (F.col("shift") + F.col("extra") - F.col("n_blocks")) * block_words
    inside = lambda lo, hi: F.struct(
        (F.greatest(lo, F.col("start")) - F.col("start")).alias("start"), (F.least(hi, F.col("stop")) - F.col("start")).alias("stop")
    )
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    runs = F.filter(F.array(inside(F.lit(0).cast("long"), wrapped), inside(first, end)), lambda p: p["stop"] > p["start"])
    picks = F.when((F.col("size") > 0) & (F.col("extra") > 0), runs).otherwise(none)
    full = full.withColumn("picks", picks)
    part = F.aggregate("picks", F.lit(0).cast("long"), lambda acc, p: acc + p["stop"] - p["start"])
    taken = F.col("copies") * F.col("size") + part
    return full.select("doc_id", *keep, "source", "size", "source_size", "target", taken.alias("taken"), "copies", "picks")


def mixed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", length: str = "n_chars", **options) -> DataFrame:
    """The mixture itself: ``docs`` rows once per whole copy, then one row with the picked words.

    A document's picked blocks are joined by a space and ``length`` is set anew;
    documents that the mix leaves out are absent. Other columns are copied. Rows with one
    id and text are one document that the mix may take more often: their other columns
    come from one of them. The id is a number.
    """
    plan = mix(docs.select(F.col(doc_id), F.col(text), F.col(source), F.xxhash64(text).alias("text_hash")), text, doc_id, source, keep=("text_hash",), **options)
    # Plain keys that cannot be null: the repeated rows and the join then share one shuffle of the texts.
    key = lambda i, h: {"id": F.coalesce(i, F.lit(0)), "void": i.isNull(), "hash": h}
    how = plan
    plan = materialise(how.filter("taken > 0"), "mix")
    release_own(how, docs)
    plan = plan.select(*[c.alias(n) for n, c in key(F.col("doc_id"), F.col("text_hash")).items()], "copies", "picks")
    rows = packed(docs, body=F.col(text), **key(F.col(doc_id), F.xxhash64(text)))
    rows = rows.dropDuplicates(["id", "void", "hash"]).join(plan, ["id", "void", "hash"])
    words = F.regexp_extract_all("body", F.lit(WORD), F.lit(0))
    some = F.array_join(F.flatten(F.transform("picks", lambda p: F.slice(words, (p["start"] + 1).cast("int"), (p["stop"] - p["start"]).cast("int")))), " ")
    versions = F.concat(F.array_repeat("body", F.col("copies").cast("int")), F.when(F.size("picks") > 0, F.array(some)).otherwise(F.array().cast("array<string>")))
    rows = rows.select("row", F.explode(versions).alias("version"))
    return rows.select(*unpacked(rows, docs.columns, **{text: F.col("version"), length: F.length("version").cast("long")}))
