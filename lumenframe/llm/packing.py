"""Packing documents into fixed windows by best-fit decreasing.

Documents are tokenised where they lie, cut into full windows and a tail, and the
pieces written once with their length and their rank among equal lengths. The plan
needs only how many pieces each length has: open windows are kept as runs of window
numbers per remaining capacity under a segment tree, and each length, longest first,
moves whole runs from the tightest capacity that holds it. A move is one row of a
table bounded by the window size, not the data; a piece finds its window by its rank.

Null texts are empty and give the closing id alone. Repeated rows are packed as
documents of their own. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

WINDOW = 2048
LONG_SPACE = re.compile(r"\s{10000}")


class Coder:
    """Byte-level BPE by merge ranks: the ids that the tokenizer file of that name gives.

    The fast coder gives up on white space of some hundred thousand characters in a row and
    knows no added tokens; a text with either goes to the tokenizer file itself, which is
    loaded only then. Without ``added_tokens`` their strings are ordinary text.
    """

    def __init__(self, rank_file: str | None = None, tokenizer_file: str | None = None, added_tokens: bool = False) -> None:
        import public_tokenizers as names
        import tiktoken

        with open(rank_file or names.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=names.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.file, self.slow = tokenizer_file or names.path("byte_bpe_50k.json"), None
        self.ordinary, added = not added_tokens, []
        if added_tokens:
            with open(self.file, encoding="utf-8") as file:
                added = [t["content"] for t in json.load(file).get("added_tokens") or [] if t["content"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def encode(self, text: str) -> list[int]:
        if not LONG_SPACE.search(text) and not (self.added and self.added.search(text)):
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.file)
            self.slow.encode_special_tokens = self.ordinary
        return self.slow.encode(text, add_special_tokens=False).ids


class OpenWindows:
    """Runs of open windows by remaining capacity, under a segment tree of capacities."""

    def __init__(self, window: int) -> None:
        self.leaves = 1
        while self.leaves <= window:
            self.leaves *= 2
        self.tree = [False] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _mark(self, capacity: int) -> None:
        node = capacity + self.leaves
        self.tree[node] = bool(self.runs[capacity])
        node //= 2
        while node:
            self.tree[node] = self.tree[2 * node] or self.tree[2 * node + 1]
            node //= 2

    def add(self, capacity: int, first: int, count: int) -> None:
        self.runs[capacity].append((first, count))
        self._mark(capacity)

    def tightest(self, need: int) -> int | None:
        """Least capacity of an open window that is at least ``need``."""
        node = need + self.leaves
        if self.tree[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        first, count = self.runs[capacity].pop()
        used = min(most, count)
        if used < count:
            self.runs[capacity].append((first + used, count - used))
        self._mark(capacity)
        return first, used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Moves (length, first rank, count, first window, offset) of best-fit decreasing."""
    open_windows, moves, used = OpenWindows(window), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = open_windows.tightest(length)
            per = (capacity or window) // length
            need = -(-left // per)
            if capacity is None:
                capacity, first, got = window, used, need
                used += need
            else:
                first, got = open_windows.take(capacity, need)
            # The tightest window stays the tightest until the length no longer fits it.
            for start, n, each in ((first, min(got, left // per), per), (first + left // per, int(got > left // per), left % per)):
                if n:
                    for k in range(each):
                        moves.append((length, rank, n, start, window - capacity + k * length))
                        rank, left = rank + n, left - n
                    if capacity > each * length:
                        open_windows.add(capacity - each * length, start, n)
    return moves


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, end_id: int = 1, rank_file: str | None = None, tokenizer_file: str | None = None) -> DataFrame:
    """Pieces of every document: doc_id, start, length, doc_tokens, ids (little-endian
    unsigned 32-bit), and for ranking: part (task) and nth (rank within it)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length int, doc_tokens long, ids binary, part int, nth long"

    def cut(batches):
        coder = Coder(rank_file, tokenizer_file, added_tokens=True)
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, dtype=np.int64)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "doc_tokens", "ids", "part", "nth")}
            held = 0
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = body.as_py()
                ids = np.append(np.asarray(coder.encode(body or ""), dtype="<u4"), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    out["doc_id"].append(key)
                    out["start"].append(start)
                    out["length"].append(len(piece))
                    out["doc_tokens"].append(len(ids))
                    out["ids"].append(piece.tobytes())
                    out["part"].append(part)
                    out["nth"].append(int(seen[len(piece)]))
                    seen[len(piece)] += 1
                held += 4 * len(ids)
                if held > 16_000_000:
                    yield _batch(out, batch.schema.field(0).type)
                    out, held = {k: [] for k in out}, 0
            yield _batch(out, batch.schema.field(0).type)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def _batch(out: dict[str, list], key_type) -> pa.RecordBatch:
    types = {"doc_id": key_type, "start": pa.int64(), "length": pa.int32(), "doc_tokens": pa.int64(), "ids": pa.binary(), "part": pa.int32(), "nth": pa.int64()}
    return pa.RecordBatch.from_pydict({k: pa.array(v, types[k]) for k, v in out.items()})


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, end_id: int = 1, rank_file: str | None = None, tokenizer_file: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, ids_crc32, sequence_id, offset.

    Whoever leaves ``ids`` out of the result keeps them out of the scan and the join too.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, text, doc_id, window, end_id, rank_file, tokenizer_file).withColumn("ids_crc32", F.crc32("ids")), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    # Cheap to make again from two narrow columns: written, it would be a tiny file of each task.
    base = by_part.withColumn("before", before)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `window` rows
    moves = plan(counts, window)
    table = np.array(moves, dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)  # its rows grow with the window, not with the data
    base = base.drop("n").hint("merge")  # it grows with the tasks: not to be broadcast
    ranked = cut.join(base, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        table = shared.value
        keys = (window - table[:, 0]) * (1 << 45) + table[:, 1]
        at = np.searchsorted(keys, (window - length.to_numpy().astype(np.int64)) * (1 << 45) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": table[at, 3] + rank.to_numpy() - table[at, 1], "offset": table[at, 4]})

    placed = ranked.withColumn("p", place("length", "rank"))
    return placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", "ids", "ids_crc32", F.col("p.sequence_id"), F.col("p.offset").alias("offset"))


def assemble(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The sequences: sequence_id, used, ids (padded to the window, except where ``used``
    is a power of two) and doc_ids in order. A group is one window at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids", "length")))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    whole = F.bit_count("used") == 1
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), F.when(whole, 0).otherwise(F.lit(window) - F.col("used")).cast("int")))
    return rows.select("sequence_id", "used", F.concat(joined, pad).alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
