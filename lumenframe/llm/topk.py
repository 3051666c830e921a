"""Exact top-k by inner product: a ball tree per shard, branch and bound.

Rows are dealt to the nearest of at most ``pivots`` sampled rows and split into shards of
bounded size. Each shard builds its ball tree once and stores it: for a query q, a node with
centre c and radius r holds no score above ``q.c + |q| r``. A query descends best first: of
all nodes it has reached, it opens the one of highest bound, until no bound reaches its k-th
score. Queries that open the same node are scored together by one matrix product.

The k-th scores are shared: each block of queries (neighbours, too) first searches the shard
where it lies. What the k-th scores leave of the (block, shard) pairs by the bounds of the
shards' root balls is searched then; other pairs move no vectors. Without pruning, which
balls do little for vectors without structure, all pairs of blocks remain, in bounded tasks.

Scores are exact integers (components scaled and floored). Components beyond 2^62 after
scaling and scores beyond 64 bits raise an error. Ties go to the smaller id, then to the row
that was written first. A query never finds its own row; other rows of its id are candidates.
Vectors that are null or empty, or hold null or non-finite components, and rows without an id
take no part; vectors of other lengths than the query's are no candidates. Extra columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, quoted, vector_rows

NONE = np.iinfo(np.int64).min + 1  # no k-th score yet; its negative is a number too


def scaled(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, dim, v): usable vectors as little-endian 64-bit integers floor(scale * x)."""

    def work(batches):
        for batch in batches:
            values, starts, lengths, good = vector_rows(batch.column(1))
            good &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            floors = np.floor(scale * np.where(np.isfinite(values), values, 0.0))
            at = np.flatnonzero(good)
            if len(at) and any(np.abs(floors[starts[i] : starts[i] + lengths[i]]).max() >= 2.0**62 for i in (at if np.abs(floors).max() >= 2.0**62 else ())):
                raise ValueError("a component of the embedding is too large for 64-bit scores")
            raw = floors.clip(-(2.0**62), 2.0**62).astype("<i8").tobytes()
            out = [raw[8 * starts[i] : 8 * (starts[i] + lengths[i])] for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(lengths[at].astype(np.int32)), pa.array(out, pa.binary())], ["vec_id", "dim", "v"])

    return vectors.select(F.col(quoted(vec_id)).cast("long"), F.col(quoted(embedding))).mapInArrow(work, "vec_id long, dim int, v binary")


class BallTree:
    """Balanced binary tree over the rows of ``x``: node arrays and row order."""

    def __init__(self, x: np.ndarray, leaf: int = 64) -> None:
        self.order = np.arange(len(x))
        self.centre, self.radius, self.span, self.children = [], [], [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            rows = x[self.order[lo:hi]]
            centre = rows.mean(axis=0)
            away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(away.max() * (1 + 1e-9) + 1e-6)
            self.span.append((lo, hi))
            self.children.append([-1, -1])
            if parent >= 0:
                self.children[parent][side] = node
            if hi - lo > leaf and away.max() > 0:
                far = rows[away.argmax()]
                other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
                middle = (hi - lo) // 2
                split = np.argpartition(rows @ (other - far), middle)
                self.order[lo:hi] = self.order[lo:hi][split]
                todo += [(lo, lo + middle, node, 0), (lo + middle, hi, node, 1)]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.children, self.span = np.array(self.children), np.array(self.span)


def shard(ids: np.ndarray, rows: np.ndarray, x: np.ndarray, leaf: int = 64) -> dict:
    """A ball tree with what it holds, rows in the tree's order: plain arrays to be stored."""
    tree = BallTree(x.astype(np.float64), leaf)
    return {"ids": ids[tree.order], "rows": rows[tree.order], "x": x[tree.order], "centre": tree.centre, "radius": tree.radius, "span": tree.span, "children": tree.children}


def upper(queries: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Bound of the scores of ``queries`` (float) in balls, with room for rounding."""
    bound = queries @ centre.T + np.sqrt((queries * queries).sum(axis=1))[:, None] * radius[None, :]
    return bound + 1e-6 * (1 + np.abs(bound))


def _scores(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    if float(np.abs(queries).max()) * float(np.abs(x).max()) * x.shape[1] < 2.0**53:  # sums are exact doubles
        return (queries.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return (queries.astype(object) @ x.T.astype(object)).astype(np.int64)  # raises beyond 64 bits


def search(tree: dict, query_rows: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Up to k (query place, id, row, score) a query in the shard, with scores >= ``bounds``;
    and how many (query, row) pairs were scored."""
    n, q = len(queries), queries.astype(np.float64)
    best = bounds.astype(np.int64).copy()
    frontier = np.full((n, len(tree["centre"])), -np.inf)  # bounds of the nodes reached and not opened
    frontier[:, 0] = upper(q, tree["centre"][:1], tree["radius"][:1])[:, 0]
    top = np.iinfo(np.int64).max
    found_id, found_row, found = np.full((n, k), top), np.full((n, k), top), np.full((n, k), NONE)
    active, scored = np.arange(n), 0
    while len(active):
        node = frontier[active].argmax(axis=1)
        reach = frontier[active, node]
        alive = (reach > -np.inf) & ((best[active] == NONE) | (reach >= best[active]))
        active, node = active[alive], node[alive]
        frontier[active, node] = -np.inf
        order = np.argsort(node, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(node[order])) + 1) if len(order) else ():
            who, at = active[some], node[some[0]]
            below = tree["children"][at]
            if below[0] >= 0:
                frontier[who[:, None], below[None, :]] = upper(q[who], tree["centre"][below], tree["radius"][below])
                continue
            lo, hi = tree["span"][at]
            scores = _scores(queries[who], tree["x"][lo:hi])
            scored += scores.size
            scores[tree["rows"][lo:hi][None, :] == query_rows[who][:, None]] = NONE
            hit = (scores >= np.maximum(best[who], NONE + 1)[:, None]).any(axis=1)
            who, scores = who[hit], scores[hit]
            if not len(who):
                continue
            all_score = np.concatenate([found[who], scores], axis=1)
            all_id = np.concatenate([found_id[who], np.broadcast_to(tree["ids"][lo:hi], scores.shape)], axis=1)
            all_row = np.concatenate([found_row[who], np.broadcast_to(tree["rows"][lo:hi], scores.shape)], axis=1)
            pick = np.lexsort((all_row, all_id, -all_score), axis=1)[:, :k]
            for to, of in ((found, all_score), (found_id, all_id), (found_row, all_row)):
                to[who] = np.take_along_axis(of, pick, axis=1)
            best[who] = np.maximum(best[who], found[who, k - 1])
    place, j = np.nonzero((found > NONE) & (found >= bounds[:, None]))
    return place, found_id[place, j], found_row[place, j], found[place, j], scored


def _matrix(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype="<i8").reshape(len(values), -1)


def _in_cells(rows: DataFrame, pivots: list) -> DataFrame:
    """``rows`` with ``cell``, the number of the nearest pivot of the row's length (-1: none)."""
    by_dim: dict[int, list] = {}
    for i, p in enumerate(pivots):
        by_dim.setdefault(len(p) // 8, []).append((i, p))

    def work(batches):
        known = {d: (np.array([i for i, _ in some]), _matrix([p for _, p in some]).astype(np.float64)) for d, some in by_dim.items()}
        for batch in batches:
            dims, blobs = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            cell = np.full(len(dims), -1, dtype=np.int32)
            for d in set(dims.tolist()) & known.keys():
                numbers, p = known[d]
                at = np.flatnonzero(dims == d)
                for lo in range(0, len(at), 4096):
                    x = _matrix([blobs[i] for i in at[lo : lo + 4096]]).astype(np.float64)
                    cell[at[lo : lo + 4096]] = numbers[((p * p).sum(axis=1)[None, :] - 2 * x @ p.T).argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec_id", "dim", "v", "row", "cell"])

    return rows.select("vec_id", "dim", "v", "row").mapInArrow(work, "vec_id long, dim int, v binary, row long, cell int")


def _parts(rows: DataFrame, most, name: str, seed: int) -> DataFrame:
    """``rows`` with ``name``: a cell's rows are dealt into parts of about ``most`` by a seeded hash."""
    cells = rows.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("parts"))
    return rows.join(cells, ["dim", "cell"]).withColumn(name, F.pmod(F.xxhash64(F.lit(seed), "row"), "parts"))


def top_k(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, every: int = 100, scale: int = 1024, shard_rows: int = 16384, block: int = 8192, pivots: int = 256, shard_bytes: int = 8 << 20, leaf: int = 512, seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query row.

    Queries are the rows whose id is divisible by ``every``. A task holds one block of
    queries and one shard at a time, whatever the table's size.
    """
    rows = materialise(scaled(vectors, vec_id, embedding, scale).withColumn("row", F.monotonically_increasing_id()), "scaled")
    n = rows.count()
    # Two passes of counts; the sample of pivots is bounded by their number.
    some = min(pivots, -(-n // shard_rows))
    sample = [bytes(r["v"]) for r in rows.orderBy(F.xxhash64(F.lit(seed), "row"), "row").limit(some).select("v").collect()] if some > 1 else []
    placed = materialise(_in_cells(rows, sample), "cells", rows)
    most = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(F.lit(shard_bytes) / (8 * F.col("dim")))))
    sized = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    sized = sized.select("dim", "cell", F.ceil(F.col("n") / most).cast("long").alias("parts"))
    data = placed.join(sized, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "row"), "parts"))

    def build(key, pdf):
        pdf = pdf.sort_values("row")
        made = shard(pdf["vec_id"].to_numpy(), pdf["row"].to_numpy(), _matrix(pdf["v"]), leaf)
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "part": [key[2]], "tree": [pickle.dumps(made, 5)], "centre": [made["centre"][0].tobytes()], "radius": [float(made["radius"][0])]})

    made = data.select("dim", "cell", "part", "vec_id", "row", "v").groupBy("dim", "cell", "part").applyInPandas(build, "dim int, cell int, part long, tree binary, centre binary, radius double")
    shards = materialise(made.withColumn("shard", F.monotonically_increasing_id()), "shards")

    asks = _parts(placed.filter(F.pmod("vec_id", F.lit(every)) == 0), block, "qpart", seed + 2).drop("parts")
    asks = asks.join(sized, ["dim", "cell"]).withColumn("part", F.pmod("qpart", "parts"))
    home = shards.select("dim", "cell", "part", F.col("shard").alias("home"))
    asks = materialise(asks.join(home, ["dim", "cell", "part"]).select("dim", "cell", "qpart", "home", "vec_id", "row", "v"), "queries", placed)

    def bundle(key, pdf):
        one = {"dim": key[0], "home": int(pdf["home"].iloc[0]), "x": b"".join(pdf["v"])}
        one |= {c: pdf[c].to_numpy(dtype=np.int64).tobytes() for c in ("vec_id", "row", "bound")}
        return pd.DataFrame({c: [v] for c, v in one.items()})

    def blocks(bound) -> DataFrame:
        rows = bound.groupBy("dim", "cell", "qpart").applyInPandas(bundle, "dim int, home long, x binary, vec_id binary, row binary, bound binary")
        return materialise(rows.withColumn("block", F.monotonically_increasing_id()), "blocks")

    def run(batches):
        for batch in batches:
            for dim, x, ids, row, bound, tree in zip(*(c.to_pylist() for c in batch.columns)):
                ids, row, bound = (np.frombuffer(c, dtype=np.int64) for c in (ids, row, bound))
                place, found_id, found_row, score, _ = search(pickle.loads(tree), row, np.frombuffer(x, dtype="<i8").reshape(-1, dim), bound, k)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[place], row[place], found_id, found_row, score)], ["query_id", "query_row", "vec_id", "row", "score"])

    all_asks = asks
    given = ("dim", "x", "vec_id", "row", "bound")
    schema = "query_id long, query_row long, vec_id long, row long, score long"
    first = blocks(asks.withColumn("bound", F.lit(int(NONE)).cast("long")))
    trees = shards.select("shard", "tree")
    near = materialise(first.join(trees, first["home"] == trees["shard"]).select(*given, "tree").mapInArrow(run, schema), "home", first)
    kth = near.groupBy(F.col("query_row").alias("row")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k).select("row", "kth")
    asks = asks.join(kth, "row", "left").withColumn("bound", F.coalesce("kth", F.lit(int(NONE)).cast("long"))).drop("kth")
    later = blocks(asks)

    # Root balls travel in groups to every block of queries: a few hundred numbers a shard.
    balls = shards.select("dim", "shard", "centre", "radius", F.pmod(F.xxhash64("shard"), F.lit(max(1, shards.count() // 256))).alias("group"))
    balls = balls.groupBy("dim", "group").agg(F.collect_list(F.struct("shard", "centre", "radius")).alias("balls"))
    salts = F.array(*[F.lit(i) for i in range(8)])
    some = later.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(8)).cast("int")).join(balls.withColumn("salt", F.explode(salts)), ["dim", "salt"])

    def prune(batches):
        for batch in batches:
            for dim, home_, x, bound, number, held in zip(*(c.to_pylist() for c in batch.columns)):
                q, bound = np.frombuffer(x, dtype="<i8").reshape(-1, dim).astype(np.float64), np.frombuffer(bound, dtype=np.int64)
                reach = upper(q, np.array([np.frombuffer(b["centre"]) for b in held]), np.array([b["radius"] for b in held]))
                open_ = ((bound == NONE)[:, None] | (reach >= bound[:, None])).any(axis=0)
                left = [b["shard"] for b, o in zip(held, open_) if o and b["shard"] != home_]
                yield pa.RecordBatch.from_pydict({"block": pa.array([number] * len(left), pa.int64()), "shard": pa.array(left, pa.int64())})

    pairs = materialise(some.select("dim", "home", "x", "bound", "block", "balls").mapInArrow(prune, "block long, shard long"), "pairs")
    rest = pairs.join(later, "block").join(trees, "shard").select(*given, "tree").mapInArrow(run, schema)
    rest = materialise(rest, "rest", shards, later, pairs, all_asks)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    best = near.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
