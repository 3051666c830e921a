"""SimHash near-duplicates found by the generalised pigeonhole principle.

Fingerprints are 64 bits over 3-word shingles. Equal fingerprints become one row, so
groups of copies cost one. The 64 bits are grouped so that correlated bits share a
partition; from the counts of equal partition values over all fingerprints, dynamic
programming picks per-partition thresholds whose sum is ``radius - partitions + 1``
(the general principle: some partition of a true pair is within its threshold; -1 means
the partition is not looked at). A threshold of 1 is probed with one masked key per bit.

Keys held by few fingerprints are verified together. A key held by many (a dense group
of near copies) is split on by the one-bit variants of the remaining bits: two
fingerprints within two bits share a variant, one variant has at most 65 owners, and so
no group is ever listed as pairs.

A null text has no words; texts without words have fingerprint zero and link like any
other; texts of one or two words are one shingle. Repeated rows each give a row. Null ids
come after all others. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, join_groups, materialise, release

SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of the shingles' XXH64 (seed 42); words are split at ASCII space."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes.lower: A-Z only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), SEED)
    line = b" ".join(words)
    starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    marks = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, (s - 1 for s in starts[width:]))), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 1 << 16):
        ones += np.unpackbits(marks[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed 64-bit number."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col(doc_id), F.col(text), F.xxhash64(text)).mapInArrow(work, f"doc_id {kind}, text_hash long, fp long")


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and the 64 x 64 counts of bits set together, over all fingerprints."""

    def gram(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            raw = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float64)
            total, n = total + bits.T @ bits, n + len(bits)
        rows, cols = np.divmod(np.arange(4096), 64)
        yield pa.RecordBatch.from_arrays([pa.array(rows * 64 + cols), pa.array(total.ravel()), pa.array(np.full(4096, n))], ["cell", "c", "n"])

    cells = fps.select("fp").mapInArrow(gram, "cell long, c double, n long").groupBy("cell").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
    out = np.zeros(4096)
    for r in cells:
        out[r["cell"]] = r["c"]
    return (int(cells[0]["n"]) if cells else 0), out.reshape(64, 64)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Split the 64 bits into ``parts`` groups of correlated bits of nearly equal size."""
    mean = np.diag(together) / max(1, n)
    cov = together / max(1, n) - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(scale, scale))
    left, groups = set(range(64)), []
    for p in range(parts):
        size = len(left) // (parts - p)
        seed = max(left, key=lambda b: (sum(corr[b, x] for x in left), -b))
        group = [seed]
        left.discard(seed)
        while len(group) < size:
            best = max(left, key=lambda b: (sum(corr[b, x] for x in group), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds (each -1, 0 or 1 ...) summing to ``budget`` at least cost, by dynamic
    programming; ``costs[i][t + 1]`` is the estimated work of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, extra in enumerate(row, start=-1):
                if s + t not in nxt or c + extra < nxt[s + t][0]:
                    nxt[s + t] = (c + extra, [*chosen, t])
        best = nxt
    return best.get(budget, (float("inf"), []))


def choose_plan(fps: DataFrame, radius: int, choices: tuple[int, ...] = (2, 3)) -> list[tuple[list[int], int]]:
    """Partitions and thresholds of least estimated work, from counts over all rows."""
    n, together = bit_moments(fps)
    layouts = {m: group_bits(n, together, m) for m in choices}
    p = np.diag(together) / max(1, n)
    agree = np.clip(1 - 2 * p * (1 - p), 1e-6, 1)
    keyed = fps.select(F.explode(F.array(*[F.struct(F.lit(f"{m}.{i}").alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("v")) for m, gs in layouts.items() for i, g in enumerate(gs)])).alias("k"))
    same = keyed.groupBy("k.part", "k.v").agg(F.count(F.lit(1)).alias("c")).groupBy("part").agg(F.sum(F.least(F.col("c") * (F.col("c") - 1) / 2, 64.0 * F.col("c"))).alias("pairs"))
    pairs = {r["part"]: float(r["pairs"]) for r in same.collect()}
    best: tuple[float, list] = (float("inf"), [])
    for m, groups in layouts.items():
        costs = []
        for i, g in enumerate(groups):
            exact = pairs.get(f"{m}.{i}", 0.0)
            ring = sum((1 - agree[b]) / agree[b] for b in g)  # expected growth for one differing bit
            costs.append([0.0, exact + n, exact * (1 + ring) + n * len(g)])
        cost, chosen = allocate(costs, radius - m + 1)
        if cost < best[0]:
            best = (cost, list(zip(groups, chosen)))
    return best[1]


def probe_keys(fp: Column, plan: list[tuple[list[int], int]]) -> Column:
    """Array of keys (kind: partition and masked bit; value) that a fingerprint is filed under."""
    keys = []
    for i, (bits, t) in enumerate(plan):
        masks = {-1: [], 0: [(0, bits)], 1: [(b + 1, [x for x in bits if x != b]) for b in bits]}[t]
        for k, kept in masks:
            m = _mask(kept)
            keys.append(F.struct(F.lit(100 * i + k).alias("kind"), fp.bitwiseAND(F.lit(m)).alias("v")))
    return F.array(*keys)


def links(fps: DataFrame, radius: int = 2, small: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints within ``radius`` bits that connect
    exactly what all such links connect. ``fps`` has one column fp, without repeats."""
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    plan = choose_plan(fps, radius)
    none = fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    if not plan:
        return none
    keyed = fps.select("fp", F.explode(probe_keys(F.col("fp"), plan)).alias("k")).select("fp", "k.kind", "k.v")
    # Keys with one owner lead nowhere; the others are told apart by size before they meet.
    counts = materialise(keyed.groupBy("kind", "v").agg(F.count(F.lit(1)).alias("owners")).filter("owners > 1"), "keys")
    shared = materialise(keyed.join(counts.hint("merge"), ["kind", "v"]), "probes", counts)

    def verify(batches):
        for batch in batches:
            a, b = [], []
            for group in batch.column(0):
                x = np.sort(np.asarray(group.as_py(), dtype=np.int64))
                near = np.bitwise_count(x[:, None].view(np.uint64) ^ x[None, :].view(np.uint64)) <= radius
                root = np.arange(len(x))
                for i, j in np.argwhere(np.triu(near, 1)):
                    ri, rj = root[i], root[j]
                    if ri != rj:  # one link for each merge is enough
                        root[root == max(ri, rj)] = min(ri, rj)
                        a.append(int(x[i]))
                        b.append(int(x[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    few = shared.filter(F.col("owners") <= small).groupBy("kind", "v").agg(F.collect_list("fp").alias("fps"))
    cold = few.select("fps").mapInArrow(verify, "a long, b long")
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_mask([i]))) for i in range(64)])
    # Both ends of a link within 2 bits own a common variant; owners of one variant are all linked.
    dense = shared.filter(F.col("owners") > small).select("fp").distinct()
    owned = dense.select("fp", F.explode(flips).alias("variant"))
    if radius == 1:
        hot = owned.join(fps.select(F.col("fp").alias("variant")), "variant", "left_semi").select(F.col("fp").alias("a"), F.col("variant").alias("b")).filter("a <> b")
    else:
        star = owned.groupBy("variant").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n"), F.collect_list("fp").alias("fps")).filter("n > 1")
        hot = star.select("a", F.explode("fps").alias("b")).filter("a <> b").distinct()
    return cold.union(hot).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 2, hot: int = 1000) -> DataFrame:
    """One row per document: doc_id, text_hash, fp, component_id (smallest reachable
    doc_id) and first_hash (the text hash of that document; the smallest, if ids repeat).

    Null ids come last: a component has a null id only if all its documents do.
    Fingerprints that one in ``hot`` documents or more hold, and components of one fingerprint in
    ``hot`` or more, are ``hot`` at most; they meet their rows by broadcast, so that no task gets
    all copies of a text or all of a component."""
    marks = materialise(fingerprints(docs, text, doc_id), "fingerprints")
    one = F.struct("doc_id", "text_hash")
    least = lambda c: F.coalesce(F.min(F.when(c["doc_id"].isNotNull(), c)), F.min(c))
    classes = materialise(marks.groupBy("fp").agg(least(one).alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    firsts = classes
    edges = links(classes.select("fp"), radius)
    roots = components(edges)
    named = roots.join(classes.hint("merge"), roots.node == classes.fp).select("node", "component", "first")
    named = materialise(named, "named", roots)
    lowest = named.groupBy("component").agg(least(F.col("first")).alias("least"), F.count(F.lit(1)).alias("n"))
    found = join_groups(named, lowest, "component", named.count(), hot).select(F.col("node").alias("fp"), "least")
    classes = classes.join(found.hint("merge"), "fp", "left").select("fp", F.coalesce("least", "first").alias("first"), "n")
    classes = materialise(classes, "components", named)
    release(edges)
    discard(firsts)
    both = join_groups(marks, classes, "fp", marks.count(), hot)
    return both.select("doc_id", "text_hash", "fp", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("first_hash"))
