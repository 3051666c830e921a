"""Embedding near-duplicates by NN-descent.

Vectors of one label are joined in a neighbour graph. Seeded hyperplane trees give
the first lists: a tree's leaf is a bounded block of vectors on the same side of every
plane, scored by one matrix product. Rounds of NN-descent then join each vector's
neighbours (both directions, in bounded blocks) with each other and keep the best.
Neighbours below ``explore`` cannot lead to a link within reach and are not kept.
A list that is full of links is saturated and is enlarged, up to ``largest`` links.

A link (cosine >= threshold) stands in the list of one of its ends, unless both are still
saturated. Those, the dense vectors, are counted exactly: they lie in blocks, by the planes
of one tree, and every two blocks whose centres and radii leave room for a link are
multiplied; components that the lists left apart are joined there. No pair of vectors is
listed. What that costs is quadratic in the dense vectors of a label, not in the label.

An audit scores vectors that have links, and as many of all, against their whole label. If
fewer than ``recall`` of their links were found, more trees are grown and the descent goes
on; if that does not help, the operator raises an error instead of returning too few.

Null, empty and zero vectors, those with null or non-finite components, and rows with a null
label link with nothing and are their own component. Vectors are scaled by a power of two
before they meet, so no finite vector over- or underflows; multiples by a power of two are
one vector. Vectors of several lengths do not link. Repeated rows count as other vectors,
equal ones are one row with a count from the start. A null vec_id takes part in links and
comes after all others. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, discard, materialise, quoted, vector_rows


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, v): v is the vector as little-endian floats of its own width (scaled so
    that the largest component is in [0.5, 1)), null where it cannot link."""
    label_type = vectors.schema[label].dataType.simpleString()
    width = _width(vectors, embedding)

    def work(batches):
        for batch in batches:
            values, starts, lengths, good = vector_rows(batch.column(1))
            good &= batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            some = np.flatnonzero(good)
            most = np.zeros(len(good))
            if len(some):
                size = np.abs(np.where(np.isfinite(values), values, 0.0))
                held = np.flatnonzero(lengths > 0)
                most[held] = np.maximum.reduceat(size, starts[held])
            good &= most > 0
            power = np.repeat(np.frexp(np.where(good, most, 1.0))[1], lengths)
            raw = (np.ldexp(np.where(np.isfinite(values), values, 0.0), -power) + 0.0).astype(width).tobytes()
            k = np.dtype(width).itemsize
            out = [raw[k * a : k * (a + n)] if g else None for a, n, g in zip(starts.tolist(), lengths.tolist(), good.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["vec_id", "label", "v"])

    return vectors.select(F.col(quoted(vec_id)).cast("long").alias("vec_id"), F.col(quoted(embedding)), F.col(quoted(label))).mapInArrow(work, f"vec_id long, label {label_type}, v binary")


def _width(vectors: DataFrame, embedding: str) -> str:
    return "<f4" if vectors.schema[embedding].dataType.elementType.simpleString() == "float" else "<f8"


def _unit(blobs, width: str) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), dtype=width).reshape(len(blobs), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _by_length(blobs) -> list[np.ndarray]:
    lengths = np.array([len(b) for b in blobs])
    return [np.flatnonzero(lengths == n) for n in np.unique(lengths)]


def _best_pairs(width: str, threshold: float, explore: float, start: int, largest: int):
    """Rows (ids, vs): for each id its ``start`` best others of the row, from ``explore`` on, and
    its links as far as ``largest``: a list that is full of links is saturated and is enlarged."""

    def work(batches):
        for batch in batches:
            u, w, s = [], [], []
            for ids, vs in zip(batch.column(0), batch.column(1)):
                all_ids, blobs = np.asarray(ids.as_py(), dtype=np.int64), vs.as_py()
                for at in _by_length(blobs):
                    if len(at) < 2:
                        continue
                    ids_, x = all_ids[at], _unit([blobs[i] for i in at], width)
                    sim = x @ x.T
                    np.fill_diagonal(sim, -2)
                    order = np.argsort(-sim, axis=1, kind="stable")[:, :largest]
                    top = np.take_along_axis(sim, order, axis=1)
                    i, j = np.nonzero((top >= threshold) | ((top >= explore) & (np.arange(top.shape[1]) < start)))
                    u.append(ids_[i])
                    w.append(ids_[order[i, j]])
                    s.append(top[i, j])
            cat = lambda parts, t: pa.array(np.concatenate(parts) if parts else np.array([], dtype=t))
            yield pa.RecordBatch.from_arrays([cat(u, np.int64), cat(w, np.int64), cat(s, np.float64)], ["u", "w", "s"])

    return work


def _planes(label_bits: int, tree: int, seed: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, tree]).standard_normal((label_bits, dim))


def tree_leaves(reps: DataFrame, sizes: DataFrame, trees: range, leaf: int, seed: int, width: str) -> DataFrame:
    """(vec_id, tree, code): the leaf code of every vector in every tree; planes per label
    grow with the logarithm of its size, so that leaves stay near ``leaf`` rows."""

    def work(batches):
        for batch in batches:
            ids, blobs, bits = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            codes = np.zeros((len(trees), len(ids)), dtype=np.int64)
            for at in _by_length(blobs):
                x = _unit([blobs[i] for i in at], width)
                for k, t in enumerate(trees):
                    side = (x @ _planes(48, t, seed, x.shape[1]).T) > 0
                    for b in np.unique(bits[at]):
                        rows = bits[at] == b
                        codes[k, at[rows]] = side[rows, :b] @ (1 << np.arange(b, dtype=np.int64)) if b else 0
            for k, t in enumerate(trees):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ids), t, dtype=np.int32)), pa.array(codes[k])], ["vec_id", "tree", "code"])

    bits = F.least(F.lit(48), F.greatest(F.lit(0), F.floor(F.log2(F.col("n") / leaf)) + 1)).cast("int")
    sized = reps.join(sizes.select(F.col("group").alias("_g"), bits.alias("bits")), F.col("group") == F.col("_g"))
    return sized.select("vec_id", "v", "bits").mapInArrow(work, "vec_id long, tree int, code long")


def _dealt(reps: DataFrame, sizes: DataFrame, trees: range, leaf: int, seed: int, width: str) -> DataFrame:
    """The leaves of every vector, with ``part``: a leaf that holds too many (a dense group) is
    dealt into blocks of about ``leaf`` rows. Vectors are fetched once the blocks are known."""
    codes = tree_leaves(reps, sizes, trees, leaf, seed, width).join(reps.select("vec_id", "group"), "vec_id")
    codes = materialise(codes, "leaves")
    full = codes.groupBy("group", "tree", "code").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64(F.lit(seed), "vec_id", "tree"), F.ceil(F.col("n") / (2 * leaf)).cast("long"))
    return materialise(codes.join(full, ["group", "tree", "code"]).withColumn("part", part).drop("n"), "parts", codes)


def neighbour_graph(reps: DataFrame, threshold: float, width: str, start: int = 8, largest: int = 64, leaf: int = 64, explore: float = 0.6, rounds: int = 6, trees: range = range(4), known: DataFrame | None = None, seed: int = 11) -> DataFrame:
    """Edges (u, w, s): the refined neighbour lists of ``reps`` (vec_id, group, v), the ``start``
    best of each vector, or as many as ``largest`` while they are links."""
    score = _best_pairs(width, threshold, explore, start, largest)
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.col("s").desc(), "w"))

    def best(pairs: DataFrame) -> DataFrame:
        lists = pairs.groupBy("u", "w").agg(F.max("s").alias("s")).withColumn("r", rank).filter(F.col("r") <= largest)
        return lists.filter((F.col("r") <= start) | (F.col("s") >= threshold)).select("u", "w", "s")

    sizes = materialise(reps.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "sizes")
    dealt = _dealt(reps, sizes, trees, leaf, seed, width)
    blocks = dealt.join(reps.select("vec_id", "v"), "vec_id").groupBy("group", "tree", "code", "part").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("v").alias("vs"))
    pairs = blocks.filter(F.size("ids") > 1).select("ids", "vs").mapInArrow(score, "u long, w long, s double")
    if known is not None:
        pairs = pairs.union(known)
    graph = materialise(best(pairs), "graph", dealt, sizes)
    vectors = reps.select(F.col("vec_id").alias("w"), "v")
    before = None
    for _ in range(rounds):
        state = graph.agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s")).first()
        if before is not None and state.n <= before[0] * 1.001 and (state.s or 0) <= (before[1] or 0) * 1.001:
            break
        before = (state.n, state.s)
        near = graph.select("u", "w").union(graph.select(F.col("w").alias("u"), F.col("u").alias("w"))).distinct()
        near = near.union(graph.select("u", F.col("u").alias("w")).distinct())
        # Reverse neighbours of a hub are met in blocks, none is left out.
        degree = near.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
        near = near.join(degree, "u").withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "w"), F.ceil(F.col("d") / leaf).cast("long")))
        met = near.join(vectors, "w").groupBy("u", "part").agg(F.collect_list("w").alias("ids"), F.collect_list("v").alias("vs"))
        pairs = met.filter(F.size("ids") > 2).select("ids", "vs").mapInArrow(score, "u long, w long, s double")
        graph = materialise(best(pairs.union(graph)), "graph", graph)
    return graph


def trees_for(most: int, leaf: int, threshold: float, recall: float) -> int:
    """Trees in which a pair at the threshold shares a leaf with chance ``recall``."""
    planes = max(0, math.floor(math.log2(max(1, most) / leaf)) + 1)
    p = (1 - math.acos(min(1.0, threshold)) / math.pi) ** planes
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - p))) if p < 1 else 1


def _with_reach(width: str):
    """Blocks with their centre (null for vectors of several lengths) and the widest angle to it."""

    def work(batches):
        for batch in batches:
            centres, reaches = [], []
            for vs in batch.column(batch.schema.get_field_index("vs")):
                blobs, centre, reach = vs.as_py(), None, math.pi
                if len({len(b) for b in blobs}) == 1:
                    x = _unit(blobs, width)
                    mean = x.sum(axis=0)
                    size = np.sqrt(mean @ mean)
                    if size > 0:
                        mean /= size
                        centre, reach = mean.tolist(), float(np.arccos(np.clip((x @ mean).min(), -1, 1)))
                centres.append(centre)
                reaches.append(reach)
            arrays = [*batch.columns, pa.array(centres, pa.list_(pa.float64())), pa.array(reaches, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "centre", "reach"])

    return work


def vector_blocks(members: DataFrame, block: int, width: str, seed: int = 17) -> DataFrame:
    """Blocks of about ``block`` vectors of one label, each on one side of a tree's planes."""
    reps = members.select(F.col("class").alias("vec_id"), "group", "v")
    sizes = materialise(reps.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "sizes")
    dealt = _dealt(reps, sizes, range(1), block, seed, width)
    rows = dealt.select("vec_id", "code", "part").join(members.select(F.col("class").alias("vec_id"), "group", "v", "copies", "component"), "vec_id")
    lists = [F.collect_list(c).alias(n) for c, n in (("vec_id", "ids"), ("v", "vs"), ("copies", "ws"), ("component", "cs"))]
    blocks = rows.groupBy("group", "code", "part").agg(*lists).select("group", "ids", "vs", "ws", "cs")
    kind = members.schema["group"].dataType.simpleString()
    schema = f"group {kind}, ids array<long>, vs array<binary>, ws array<long>, cs array<long>, centre array<double>, reach double"
    return materialise(blocks.mapInArrow(_with_reach(width), schema).withColumn("block", F.monotonically_increasing_id()), "blocks", sizes, dealt)


def block_pairs(blocks: DataFrame, threshold: float, deal: int = 16) -> DataFrame:
    """(lo, hi): the pairs of blocks of one label, a block with itself too, that may hold a link."""
    some = blocks.select("group", "block", "centre", "reach")
    lo = some.select("group", F.col("block").alias("lo"), F.col("centre").alias("lc"), F.col("reach").alias("lr"), F.pmod(F.xxhash64("block"), F.lit(deal)).alias("salt"))
    hi = some.select(F.col("group").alias("_g"), F.col("block").alias("hi"), F.col("centre").alias("hc"), F.col("reach").alias("hr"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long"))).alias("_s"))
    pairs = lo.join(hi, (F.col("group") == F.col("_g")) & (F.col("salt") == F.col("_s")) & (F.col("lo") <= F.col("hi")))
    # Angles are a metric: a link is at most both radii and its own angle from centre to centre.
    far = F.col("lr") + F.col("hr") + math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    dot = F.aggregate(F.zip_with("lc", "hc", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return pairs.filter((far >= math.pi) | (F.col("lo") == F.col("hi")) | F.coalesce(dot >= F.cos(far), F.lit(True))).select("lo", "hi")


def _count_blocks(threshold: float, width: str):
    """Rows of two blocks -> per id the number of vectors (by weight) linked across them, and
    edges (a, b) between components that a link joins."""

    def work(batches):
        for batch in batches:
            out_id, out_n, out_a, out_b = [], [], [], []
            for same, *columns in zip(*batch.columns):
                same = same.as_py()
                sides = []
                for ids, vs, ws, cs in (columns[:4], columns[4:]):
                    ids, ws, cs = (np.asarray(c.as_py(), dtype=np.int64) for c in (ids, ws, cs))
                    blobs = vs.as_py()
                    sides.append({len(blobs[at[0]]): (ids[at], _unit([blobs[i] for i in at], width), ws[at], cs[at]) for at in _by_length(blobs)})
                for length in sides[0].keys() & sides[1].keys():
                    (ids, x, w, c), (ids2, x2, w2, c2) = sides[0][length], sides[1][length]
                    linked = x @ x2.T >= threshold
                    linked &= ids[:, None] != ids2[None, :]
                    for who, n in ((ids, linked @ w2), (ids2, w @ linked))[: 1 if same else 2]:
                        out_id.append(who[n > 0])
                        out_n.append(n[n > 0])
                    if (linked & (c[:, None] != c2[None, :])).any():
                        low, low2, before = c, c2, None
                        while before is None or (low != before).any():  # smallest component within reach
                            before, most = low, np.iinfo(np.int64).max
                            low2 = np.minimum(low2, np.where(linked, low[:, None], most).min(axis=0))
                            low = np.minimum(low, np.where(linked, low2[None, :], most).min(axis=1))
                        for a, b in ((c, low), (c2, low2)):
                            edges = np.unique(np.stack([a, b])[:, a != b], axis=1)
                            out_a.append(edges[0])
                            out_b.append(edges[1])
            ids, n, a, b = (np.concatenate(v) if v else np.array([], dtype=np.int64) for v in (out_id, out_n, out_a, out_b))
            none = lambda k: pa.nulls(k, pa.int64())
            arrays = [pa.concat_arrays([pa.array(ids), none(len(a))]), pa.concat_arrays([pa.array(n), none(len(a))]), pa.concat_arrays([none(len(ids)), pa.array(a)]), pa.concat_arrays([none(len(ids)), pa.array(b)])]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "linked", "a", "b"])

    return work


def _dense_links(members: DataFrame, threshold: float, block: int, width: str) -> DataFrame:
    """Rows (vec_id, linked) and edges between components (a, b) of the links within ``members``."""
    blocks = vector_blocks(members, block, width)
    side = lambda name, key: blocks.select(F.col("block").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in ("ids", "vs", "ws", "cs")])
    met = block_pairs(blocks, threshold).join(side("l", "lo"), "lo").join(side("h", "hi"), "hi")
    met = met.select((F.col("lo") == F.col("hi")).alias("same"), *[f"{n}_{c}" for n in "lh" for c in ("ids", "vs", "ws", "cs")])
    return materialise(met.mapInArrow(_count_blocks(threshold, width), "vec_id long, linked long, a long, b long"), "links", blocks)


def audit(classes: DataFrame, found: DataFrame, threshold: float, width: str, rows: int = 256, seed: int = 23) -> float:
    """Recall of links, as the mean over audited vectors that have any: ``rows`` vectors with
    links in ``found`` (class, linked) and as many of all, against every vector of their labels."""
    counted = classes.select("class", "group", "v", "copies").join(found, "class", "left")
    order = (F.xxhash64(F.lit(seed), "class"), F.col("class"))
    some = counted.filter("linked > 0").orderBy(*order).limit(rows).union(counted.orderBy(*order).limit(rows))
    asked = [(r["class"], r["group"], bytes(r["v"]), r["linked"] or 0) for r in some.select("class", "group", "v", "linked").distinct().collect()]
    shared = classes.sparkSession.sparkContext.broadcast(asked)  # 2 * rows vectors at most

    def work(batches):
        of: dict = {}
        for c, g, v, _ in shared.value:
            of.setdefault((g, len(v)), []).append((c, v))
        known = {key: (np.array([c for c, _ in held]), _unit([v for _, v in held], width)) for key, held in of.items()}
        for batch in batches:
            out: list[list] = [[], []]
            groups, blobs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            ids, copies = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            rows_of: dict = {}
            for i, (g, v) in enumerate(zip(groups, blobs)):
                if (g, len(v)) in known:
                    rows_of.setdefault((g, len(v)), []).append(i)
            for key, at in rows_of.items():
                who, q = known[key]
                linked = q @ _unit([blobs[i] for i in at], width).T >= threshold
                linked &= who[:, None] != ids[at][None, :]
                out[0] += who.tolist()
                out[1] += (linked @ copies[at]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["class", "n"])

    true = classes.select("class", "group", "v", "copies").mapInArrow(work, "class long, n long").groupBy("class").agg(F.sum("n").alias("n"))
    truth = {r["class"]: r["n"] for r in true.collect()}
    shares = [min(1.0, linked / truth[c]) for c, _, _, linked in asked if truth.get(c)]
    return sum(shares) / len(shares) if shares else 1.0


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98, block: int = 1024, largest: int = 32, leaf: int = 64, recall: float = 0.999, attempts: int = 4, **options) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    width = _width(vectors, embedding)
    rows = materialise(usable(vectors, vec_id, embedding, label), "vectors")
    classes = rows.filter("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    # A vec_id may repeat with other vectors: classes are numbered apart from it.
    classes = materialise(classes.withColumnRenamed("label", "group").withColumn("class", F.monotonically_increasing_id()), "classes")
    reps = classes.select(F.col("class").alias("vec_id"), "group", "v")
    most = classes.groupBy("group").count().agg(F.max("count")).first()[0] or 1
    step, graph = trees_for(most, leaf, threshold, recall), None
    for attempt in range(attempts):
        known, trees = graph, range(attempt * step, (attempt + 1) * step)
        graph = neighbour_graph(reps, threshold, width, largest=largest, leaf=leaf, trees=trees, known=known, **options)
        if known is not None:
            discard(known)
        lists = graph.filter(F.col("s") >= threshold).groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        dense = lists.filter(F.col("n") >= largest).select(F.col("u").alias("class"), F.lit(True).alias("dense"))
        near = graph.filter(F.col("s") >= threshold).select("u", "w")
        near = materialise(near.union(near.select("w", "u")).distinct(), "near")
        parts = components(near.select(F.col("u").alias("a"), F.col("w").alias("b")))
        member = classes.join(parts.withColumnRenamed("node", "class"), "class", "left").join(dense, "class", "left")
        member = linked = materialise(member.withColumn("component", F.coalesce("component", "class")).withColumn("dense", F.coalesce("dense", F.lit(False))), "members")
        # Links of two dense vectors are counted by blocks, the others from the lists.
        exact = _dense_links(member.filter("dense"), threshold, block, width)
        ends = [member.select(F.col("class").alias(c), F.col("dense").alias(f"{c}_dense"), *([F.col("copies")] if c == "w" else [])) for c in ("u", "w")]
        listed = near.join(ends[0], "u").join(ends[1], "w").filter(~(F.col("u_dense") & F.col("w_dense"))).select(F.col("u").alias("class"), F.col("copies").alias("linked"))
        counted = listed.union(exact.filter("vec_id is not null").select("vec_id", "linked")).groupBy("class").agg(F.sum("linked").alias("linked"))
        counted = materialise(counted, "counts", near)
        dense_joined = components(exact.filter("a is not null").select("a", "b"))
        reached = audit(classes, counted, threshold, width)
        if reached >= min(recall, 0.99):
            break
    else:
        raise RuntimeError(f"only {reached:.3f} of the links of audited vectors were found; raise attempts, largest or recall")
    joined = dense_joined.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    member = member.join(joined, "component", "left").withColumn("whole", F.coalesce("whole", "component"))
    first = member.groupBy("whole").agg(F.min("vec_id").alias("component_id"))
    final = member.join(first, "whole").join(counted, "class", "left").select(
        F.col("group").alias("_label"), F.col("v").alias("_v"), "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    )
    final = materialise(final, "final", graph, classes, exact, counted, parts, dense_joined, linked)
    out = rows.join(final, (rows["label"] == final["_label"]) & (rows["v"] == final["_v"]), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
