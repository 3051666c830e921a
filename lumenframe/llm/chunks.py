"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text; its least value within every ``span`` bytes is
a cut, so cuts depend on the bytes near them only: a passage that moves by an insertion is
cut alike, and no stretch of ``span`` bytes is without a cut. From each cut a chunk runs for
``chunk_words`` words; chunks vary in bytes, overlap, and are counted by digest over the corpus.

A passage repeats where ``min_words`` words in a row occur again. Such windows are counted by
a second digest where their chunks recur: from every cut, and from every word near a chunk that
has other neighbours elsewhere, where a passage may begin or end: by the documents whose run of
known chunks ends there, and by the first and last that hold the chunk. So the spans reported are those
of comparing all windows, with exact borders, as long as ``min_words`` words hold a chunk and
``span`` + 16 bytes (4.8 bytes a word, spaces included); where three or more documents overlap
in different ways a border may lie a chunk within. A report needs equality of two 64-bit
digests. Windows that have an earlier occurrence (by doc_id, then row and place) are removable.

Words end at ASCII white space; in scripts without spaces two characters count as a word, and
words beyond 24 bytes as several. Repeats inside a document count as well. Null, empty and
shorter texts have no passages. Repeated rows count as occurrences of their own; ties between
equal documents go to the row that was written first. Extra columns are ignored. Work and
memory grow with the length of a text, not with the number of its repeats.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, packed, replace_spans, sweep, unpacked

GEAR = np.random.default_rng(20240501).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_SOLID = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
LEFT, RIGHT, OUTER = 1, 2, 4  # other chunks before, after; this is the first or last row that holds it


def _sliding(best, values: np.ndarray, span: int) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``span`` values in a row."""
    size = 1
    while 2 * size <= span:
        values = best(values[:-size], values[size:])
        size *= 2
    return best(values[: len(values) - (span - size)], values[span - size :]) if size < span else values


def cuts(raw: np.ndarray, span: int, block: int = 1 << 20) -> np.ndarray:
    """Increasing offsets in ``raw`` (bytes): each is the least gear hash of some ``span`` bytes."""
    out = [np.zeros(1, dtype=np.int64)]
    for lo in range(0, max(1, len(raw) - span + 1), block):
        begin = max(0, lo - 15)
        h = GEAR[raw[begin : lo + block + span - 1]]
        for s in (1, 2, 4, 8):  # after these, h covers the last 16 bytes
            h[s:] += h[:-s] << np.uint32(s)
        h = h[lo - begin :]
        if len(h) < span:
            break
        # A cut is the least of some window: what the greatest of the windows' leasts around it is.
        least = _sliding(np.minimum, h, span)
        ends = np.zeros(span - 1, dtype=np.uint32)
        at = np.flatnonzero(_sliding(np.maximum, np.concatenate([ends, least, ends]), span) == h)
        same = np.flatnonzero(h[at[1:]] == h[at[:-1]]) + 1
        if len(same):  # a periodic stretch: one cut within each `span` bytes is enough
            keep, before = np.ones(len(at), dtype=bool), -1
            for k in same.tolist():
                before = before if before >= 0 and h[at[k]] == h[at[before]] and at[k - 1] <= at[before] + span else k - 1
                if at[k] - at[before] < span:
                    keep[k] = False
                else:
                    before = k
            at = at[keep]
        out.append(at + lo + 1)
    return np.unique(np.concatenate(out))


def units(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units of a text (bytes), and the half words before each and in all."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    solid = _SOLID[raw]
    change = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if solid[0]:
        change = np.concatenate([[0], change])
    start, stop = change[::2], change[1::2]
    if len(stop) < len(start):
        stop = np.append(stop, len(raw))
    long, high = np.flatnonzero(stop - start > 24), np.flatnonzero(raw >= 0xE0)
    if not len(long) and not len(high):
        return start, stop, 2 * np.arange(len(start) + 1)
    weight = np.zeros(len(raw), dtype=np.int8)
    weight[start] = 2
    if len(long):
        n = (stop[long] - start[long] - 1) // 24
        more = np.repeat(start[long], n) + 24 * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
        weight[more[(raw[more] & 0xC0) != 0x80]] = 2
    if len(high):
        # UTF-8 lead bytes of Thai to Lao, Myanmar, Khmer, kana and the Han blocks.
        a, b = raw[high], np.append(raw, np.uint8(0))[high + 1]
        among = lambda x, lo, hi: (x >= lo) & (x <= hi)
        wide = among(a, 0xE4, 0xE9) | ((a == 0xE3) & (b >= 0x81)) | ((a == 0xE0) & among(b, 0xB8, 0xBB)) | ((a == 0xE1) & (among(b, 0x80, 0x82) | among(b, 0x9E, 0x9F)))
        wide |= ((a == 0xEF) & among(b, 0xA4, 0xAB)) | ((a == 0xF0) & among(b, 0xA0, 0xB2))
        weight[high[wide]] = 1
    at = np.flatnonzero(weight)
    ends = stop[np.searchsorted(start, at, "right") - 1]
    ends[:-1] = np.minimum(ends[:-1], at[1:])
    return at, ends, np.concatenate([[0], np.cumsum(weight[at], dtype=np.int64)])


def chunk_starts(raw: np.ndarray, at: np.ndarray, held: np.ndarray, words: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit numbers where chunks start, and where those that fit end (the latter may be fewer)."""
    first = np.unique(np.searchsorted(at, cuts(raw, span)))
    first = first[first < len(at)]
    last = np.searchsorted(held[1:], held[first] + 2 * words)
    return first, last[last < len(at)]


def chunk_table(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", chunk_words: int = 20, span: int = 128) -> DataFrame:
    """One row per document: doc_id, the hashes of it (k) and of its text (t), the digests of its chunks."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for body in batch.column(1):
                raw = (body.as_py() or "").encode("utf-8", "replace")
                a = np.frombuffer(raw, dtype=np.uint8)
                at, ends, held = units(a)
                first, last = chunk_starts(a, at, held, chunk_words, span)
                spans = zip(at[first[: len(last)]].tolist(), ends[last].tolist())
                out.append(np.array([digest(raw[i:j]) for i, j in spans], dtype=np.uint64).view(np.int64))
            columns = [batch.column(i) for i in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.int64()))], ["doc_id", "k", "t", "digests"])

    return docs.select(F.col(doc_id), F.col(text).cast("string"), *_key(doc_id, text)).mapInArrow(work, f"doc_id {kind}, k long, t long, digests array<long>")


def _key(doc_id: str, text: str) -> list:
    return [F.xxhash64(doc_id).alias("k"), F.xxhash64(F.col(text).cast("string")).alias("t")]


def windows(body: str, places: np.ndarray, flags: np.ndarray, min_words: int, chunk_words: int, span: int) -> list[tuple[int, int, bool, int]]:
    """Windows (start, stop, from a cut, digest; code points) of ``min_words`` words that may occur
    again: ``places`` are the chunks that do, ``flags`` their LEFT, RIGHT and OUTER."""
    raw = body.encode("utf-8", "replace")
    a = np.frombuffer(raw, dtype=np.uint8)
    at, ends, held = units(a)
    first, last = chunk_starts(a, at, held, chunk_words, span)
    mark = np.zeros(len(at) + 1, dtype=np.int32)  # +1 and -1 where a range of starts begins and ends

    def add(lo: np.ndarray, hi: np.ndarray) -> None:
        np.add.at(mark, lo, 1)
        np.add.at(mark, np.maximum(lo, hi), -1)

    # Near the border of a passage cuts depend on what lies beyond: the first that is common to
    # all its occurrences is at most ``reach`` bytes from its start, and so it is at its end.
    reach = span + 16
    add(first[places], first[places] + 1)
    alone = np.diff(places, prepend=-2, append=len(first) + 1) > 1
    ends_run = lambda side, lone: places[((flags & side) > 0) & (lone | ((flags & OUTER) > 0))]
    left, right = ends_run(LEFT, alone[:-1]), ends_run(RIGHT, alone[1:])
    if len(places) and places[-1] == len(last) - 1:
        right = np.append(right, places[-1])  # the text may end with the passage
    add(np.searchsorted(at, at[first[left]] - reach), first[left])
    beyond = np.searchsorted(at, at[first[right]] + reach + 16)
    until = np.minimum(len(at) - 1, np.searchsorted(held[1:], held[np.minimum(beyond, len(at))] + 2 * chunk_words))
    begin = lambda end: np.maximum(0, np.searchsorted(held, held[end + 1] - 2 * min_words, "right") - 1)
    add(begin(last[right]), begin(until) + 1)
    some = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    stop = np.searchsorted(held[1:], held[some] + 2 * min_words)
    some, stop = some[stop < len(at)], stop[stop < len(at)]
    # A window that occurs again holds a chunk that does, and no other beyond the reach of its borders.
    hit = np.zeros(len(last), dtype=np.int64)
    hit[places] = 1
    hit = np.concatenate([[0], np.cumsum(hit)])
    start = at[first[: len(last)]]
    hi = np.searchsorted(last, stop, "right")
    lo = np.minimum(hi, np.searchsorted(start, at[some]))
    inner_hi = np.minimum(hi, np.searchsorted(start, ends[stop] - reach))
    inner_lo = np.minimum(inner_hi, np.searchsorted(start, at[some] + reach + 16))
    good = (hit[hi] > hit[lo]) & (hit[inner_hi] - hit[inner_lo] == inner_hi - inner_lo)
    some, stop = some[good], stop[good]
    points = np.cumsum((a & 0xC0) != 0x80)
    cut = np.isin(some, first)
    begun, ended = at[some], ends[stop]
    marks = [xxhash.xxh3_64_intdigest(raw[i:j], 1) for i, j in zip(begun.tolist(), ended.tolist())]
    return list(zip((points[begun] - 1).tolist(), points[ended - 1].tolist(), cut.tolist(), marks))


def _joined(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1]["stop"]:
            out[-1]["stop"] = max(stop, out[-1]["stop"])
        else:
            out.append({"start": start, "stop": stop})
    return out


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = 50, chunk_words: int = 20, span: int = 128) -> DataFrame:
    """One row per document: doc_id, n_chunks, n_repeated, repeated and removable.

    ``n_repeated`` counts the chunks at which a window found elsewhere starts; ``repeated``
    and ``removable`` are arrays of struct(start, stop) in code points.
    """
    rows = materialise(chunk_table(docs, text, doc_id, chunk_words, span).withColumn("row", F.monotonically_increasing_id()), "chunks")
    # Some bits of the chunks before and after, and their complement: a bit that differs
    # among the occurrences of a chunk is set in both halves of their union.
    part = F.lit(0xFFFF).cast("long")
    side = lambda i: F.coalesce(F.get("digests", i), F.lit(0).cast("long")).bitwiseAND(part)
    beside = lambda i: side(i - 1).bitwiseOR(F.shiftleft(side(i + 1), 16))
    both = lambda c: c.bitwiseOR(F.shiftleft(F.bitwise_not(c), 32))
    each = rows.select("row", F.inline(F.transform("digests", lambda d, i: F.struct(d.alias("digest"), both(beside(i)).alias("sides")))))
    counts = each.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.bit_or("sides").alias("sides"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))
    apart = F.col("sides").bitwiseAND(F.shiftrightunsigned("sides", 32))
    flags = F.when(apart.bitwiseAND(part) != 0, LEFT).otherwise(0) + F.when(F.shiftrightunsigned(apart, 16) != 0, RIGHT).otherwise(0)
    many = materialise(counts.filter("n > 1").select("digest", flags.cast("byte").alias("flags"), "first_row", "last_row"), "repeats")
    sweep(rows)
    # A place and its flags in one number; a document's list is bounded by its text.
    hit = F.col("place") * 8 + F.col("flags") + F.when(F.col("row").isin(F.col("first_row"), F.col("last_row")), OUTER).otherwise(0)
    hits = rows.select("row", F.posexplode("digests").alias("place", "digest")).join(many, "digest").groupBy("row").agg(F.sort_array(F.collect_list(hit)).alias("hits"))

    def near(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            lengths = []
            for i, body, found in zip(*batch.columns[:3]):
                found = np.asarray(found.as_py(), dtype=np.int64)
                some = windows(body.as_py(), found // 8, found % 8, min_words, chunk_words, span)
                lengths.append(len(some))
                out[0] += [i.as_py()] * len(some)
                for to, values in zip(out[1:], zip(*some)):
                    to += values
            arrays = [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.bool_()))]
            ids = batch.column(3).take(pa.array(np.repeat(np.arange(len(lengths)), lengths)))
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.array(out[4], dtype=np.uint64).view(np.int64)), ids], ["row", "start", "stop", "cut", "digest", "doc_id"])

    schema = f"row long, start int, stop int, cut boolean, digest long, doc_id {rows.schema['doc_id'].dataType.simpleString()}"
    # Texts move once, by their key; rows that repeat whole share one.
    hits = hits.join(rows.select("row", "doc_id", "k", "t"), "row")
    bodies = docs.select(*_key(doc_id, text), F.col(text).cast("string").alias("body")).dropDuplicates(["k", "t"])
    found = bodies.join(hits, ["k", "t"]).select("row", "body", "hits", "doc_id").mapInArrow(near, schema)
    found = materialise(found, "windows", many)
    sweep(rows)
    first = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row", "start")).alias("f"))
    first = first.filter("n > 1").select("digest", F.col("f.row").alias("first_row"), F.col("f.start").alias("first_start"))
    later = (F.col("first_row") != F.col("row")) | (F.col("first_start") != F.col("start"))
    by_row = found.drop("doc_id").join(first, "digest").groupBy("row").agg(F.sum(F.col("cut").cast("long")).alias("n_repeated"), F.collect_list(F.struct("start", "stop", later.alias("later"))).alias("found"))

    @F.pandas_udf("repeated array<struct<start:int,stop:int>>, removable array<struct<start:int,stop:int>>")
    def spans(lists):
        some = [[] if h is None else h for h in lists]
        return pd.DataFrame({
            "repeated": [_joined([(x["start"], x["stop"]) for x in h]) for h in some],
            "removable": [_joined([(x["start"], x["stop"]) for x in h if x["later"]]) for h in some],
        })

    out = rows.select("row", "doc_id", F.size("digests").cast("long").alias("n_chunks")).join(by_row, "row", "left").withColumn("s", spans("found"))
    return out.select("doc_id", "n_chunks", F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated"), "s.repeated", "s.removable")


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with the removable passages cut out of ``text``; the first occurrence of
    every passage stays. Rows that repeat whole are cut alike, so that one keeps its text."""
    rows = packed(docs, id=F.col(doc_id), body=F.col(text), hash=F.xxhash64(text))
    found = repeated_passages(rows.select(F.struct("id", "hash").alias("key"), "body"), "body", "key", **options)
    # Of rows that repeat whole only the first occurrence counts; the least cut is taken for all.
    spans = found.groupBy("doc_id").agg(F.min_by("removable", F.size("removable")).alias("spans")).filter(F.size("spans") > 0)
    spans = spans.select(F.col("doc_id.id").alias("span_id"), F.col("doc_id.hash").alias("span_hash"), "spans")
    rows = rows.join(spans, F.col("id").eqNullSafe(F.col("span_id")) & (F.col("hash") == F.col("span_hash")), "left")
    new = F.when(F.col("spans").isNull(), F.col("body")).otherwise(replace_spans(F.col("body"), F.col("spans"), ""))
    return rows.select(*unpacked(rows, docs.columns, **{text: new}))
