"""Helpers shared by the corpus operators: written tables, row hashes, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a single-JVM session may leave it unset; it then gets a temporary folder,
    which on one machine every task can see and which goes with the process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="lumenframe-")
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[app], ignore_errors=True)
    return _LOCAL_ROOTS[app]


def materialise(df: DataFrame, label: str, *spent: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor costs nothing that was written, and rows, partition ids and
    random choices made on the way are fixed from now on. Python stages of the job take
    Arrow batches of 8 MB if the session sets no size: texts grow about fivefold in Python.
    ``spent`` are tables made here that nothing reads any more; they are deleted.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/lumenframe-{label}-{uuid.uuid4().hex}"
    conf, name = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = conf.get(name) == "67108864b"
    try:
        if usual:
            conf.set(name, "8m")
        df.write.parquet(path, compression="zstd")
    finally:
        if usual:
            conf.unset(name)
    for table in spent:
        discard(table)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenframe_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` that nothing reads any more."""
    path = getattr(df, "_lumenframe_path", None)
    if path:
        _delete(df.sparkSession, path)


def release(df: DataFrame) -> None:
    """Delete all tables made by :func:`materialise` that ``df`` reads: call it once the
    result of an operator is written or used up. Other inputs stay."""
    release_own(df)


def release_own(df: DataFrame, *inputs: DataFrame) -> None:
    """Like :func:`release`, but tables that ``inputs`` read stay."""
    kept = {f.rsplit("/", 1)[0] for i in inputs for f in i.inputFiles()}
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()} - kept:
        if path.rsplit("/", 1)[1].startswith("lumenframe-"):
            _delete(df.sparkSession, path)


def sweep(df: DataFrame) -> None:
    """Have the driver collect its garbage. Shuffle files of jobs that are over go with it, so
    disk is bounded by an operator's largest step, not by the sum of its steps."""
    df.sparkSession._jvm.System.gc()


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """``df`` as one struct column ``row`` beside ``extra``, so that no name can clash."""
    row = F.struct(*[F.col(quoted(c)).alias(c) for c in df.columns])
    return df.select(row.alias("row"), *[c.alias(n) for n, c in extra.items()])


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> list[Column]:
    """Select list that gives ``columns`` of ``row`` back, some of them changed."""
    return [changed.get(c, F.col("row").getField(c)).alias(c) for c in columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def replace_spans(body: Column, spans: Column, mask: str, block: int = 2048) -> Column:
    """``body`` with the spans (array of struct(start, stop) in code points, by start and
    without overlaps; not empty) replaced by ``mask``.

    Places in a text are found by walking it, so pieces are cut from blocks instead: the
    work stays near the text's length however many spans there are."""
    place = lambda c: F.floor(c / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), place(F.length(body))), lambda b: F.substring(body, b * block + 1, F.lit(block)))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["stop"])

    def put_together(held: Column) -> Column:
        def cut(start: Column, stop: Column) -> Column:
            near = F.array_join(F.slice(held, place(start) + 1, place(stop) - place(start) + 1), "")
            return F.substring(near, start - place(start) * block + 1, stop - start)

        pieces = F.transform(spans, lambda s, i: F.concat(cut(before(i), s["start"]), F.lit(mask)))
        return F.array_join(F.concat(pieces, F.array(cut(F.element_at(spans, -1)["stop"], F.length(body)))), "")

    return F.get(F.transform(F.array(blocks), put_together), F.lit(0))  # the blocks are made once


def vector_rows(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Components of a column of vectors as doubles, where each row's begin, how many there
    are, and which rows are whole: not null, not empty, no null or non-finite component."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    stops = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    return values, stops - lengths, lengths, (lengths > 0) & (bad[stops] == bad[stops - lengths])


def unit_hash(seed: int, *cols: Column) -> Column:
    """Seeded hash of the columns as a double in [0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int, hot: int = 1000) -> DataFrame:
    """``rows`` joined with the one row that ``groups`` has for each ``key``; its column ``n``
    says how many rows that is, and ``total`` how many there are in all.

    Keys of one row in ``hot`` or more are ``hot`` at most; they are broadcast, so that no task
    gets all rows of a key. The others meet by a merge join."""
    many = F.broadcast(groups.filter(F.col("n") * hot >= total).drop("n"))
    few = groups.filter(F.col("n") * hot < total).drop("n").hint("merge")
    rest = rows.join(many.select(key), key, "left_anti").join(few, key)
    return rows.join(many, key).unionByName(rest)


def components(edges: DataFrame, max_rounds: int = 60, hot: int = 1000) -> DataFrame:
    """Smallest reachable id of every node in ``edges`` (columns a, b: long).

    Minimum-label rounds with pointer jumping: each round aggregates the labels
    of neighbours with map-side minima, then replaces every label by its label's
    label. All state is tables; the driver sees one count a round.
    Returns (node, component). Self loops are allowed and give isolated nodes.
    """
    both = materialise(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    # Both sides of these joins grow with the edges: no side is broadcast.
    first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = materialise(first.withColumn("old", F.col("node")), "labels")
    total = labels.count()
    for _ in range(max_rounds):
        seen = both.join(labels.hint("merge"), both.b == labels.node).select(both.a.alias("node"), "component", F.lit(None).cast("long").alias("old"))
        own = labels.select("node", "component", F.col("component").alias("old"))
        best = seen.union(own).groupBy("node").agg(F.min("component").alias("component"), F.max("old").alias("old"))
        best = materialise(best, "best", labels)
        # Every label is a node. One label may be that of most nodes.
        names = best.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        up = best.select(F.col("node").alias("component"), F.col("component").alias("top")).hint("merge")
        jumped = join_groups(best, names.join(up, "component"), "component", total, hot)
        labels = materialise(jumped.select("node", F.least("top", "component").alias("component"), "old"), "labels", best)
        if not labels.filter("component <> old").limit(1).count():
            discard(both)
            out = labels.select("node", "component")
            out._lumenframe_path = labels._lumenframe_path
            return out
    raise RuntimeError("components did not settle; raise max_rounds")
