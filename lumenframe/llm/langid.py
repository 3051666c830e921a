"""Language identification with a string kernel.

A text is the set of its byte n-grams (orders 1 to 4 of the lower-cased text, a
blended spectrum), hashed to ``2^16`` buckets; the kernel of two texts is the cosine of
their presence vectors. Landmarks drawn from the training sample give the Nyström
feature map, and one-versus-rest kernel ridge regression is solved on it. As every
step after the presence vector is linear, a batch is scored by one product of its
presence rows with a (buckets x languages) matrix.

Training rows are a bounded sample: at most ``per_language`` rows of each language,
drawn by a seeded hash of the id among rows whose label is known; languages are not
limited. The sample is written and summed in executors, in whole numbers, so that no order
of adding changes the model; the driver gets ``landmarks`` rows and the sums, which are
``landmarks`` numbers a language. Texts are used
whole. A text that is null or holds no letter is ``und`` with score 0. Ties go to the
language that sorts first. Without any training row everything is ``und``.

The best score says which language fits best, not whether any does. With ``fenced`` a model
also holds each language's mean feature row and a fence, set on the sample: a text is
foreign if it is less like every mean than a text of its size should be, and its score is
below ``SURE`` as well. See :meth:`Features.fence` and :meth:`Model.foreign`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, packed, release_own, unit_hash, unpacked

BITS = 16
ORDERS = (1, 2, 3, 4)
STEP = 1 << 20  # features are summed as multiples of 1 / STEP
FENCED = 250  # rows of a language that set its fence, at most
LEAST = 20  # different rows of a language that a fence needs
PART = 200  # n-grams of a part, where a text may be of several languages
COPY = 0.9  # kernel value from which rows count as copies there
SURE = 0.75  # score that no fence overrules: half way from 0 (any language) to 1 (this one)


def presence(text: str) -> np.ndarray:
    """Sorted bucket numbers of the n-grams of ``text``."""
    raw = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    seen = np.zeros(1 << BITS, dtype=bool)
    code = np.zeros(len(raw), dtype=np.uint32)
    for n in ORDERS:
        if len(raw) < n:
            break
        code = code[: len(raw) - n + 1] * np.uint32(257) + raw[n - 1 :] + np.uint32(1)
        mixed = (code + np.uint32(n * 0x1234567)) * np.uint32(2654435761)
        seen[mixed >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(seen)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def sample(docs: DataFrame, usable: Column, text: str, lang: str, doc_id: str, per_language: int, seed: int) -> DataFrame:
    """At most ``per_language`` labelled rows of each language: (lang, bits, draw, k).

    Counts come first, so that a hash threshold keeps little more than the sample
    before any text is read; ``bits`` is the packed presence vector, of fixed size.
    The counts are a written table: whether they are broadcast is Spark's check of its size.
    """
    known = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = materialise(known.groupBy(F.col(lang).alias("_l")).agg(F.count(F.lit(1)).alias("_n")), "languages")
    draw = unit_hash(seed, F.col(doc_id))
    near = known.select(doc_id, F.col(lang).alias("_lang"), F.col(text).alias("_text"), draw.alias("_draw")).join(counts, F.col("_lang") == F.col("_l"))
    near = near.filter(F.col("_draw") * F.col("_n") < 2.0 * per_language + 20)
    first = F.row_number().over(Window.partitionBy("_lang").orderBy("_draw", doc_id, F.xxhash64("_text")))
    near = near.withColumn("_k", first).filter(F.col("_k") <= per_language).select("_lang", "_text", "_draw", "_k")

    def bits(body: str) -> bytes:
        row = np.zeros(1 << BITS, dtype=np.uint8)
        row[presence(body)] = 1
        return np.packbits(row).tobytes()

    def pack(batches):
        for batch in batches:
            made = pa.array([bits(body.as_py()) for body in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made, batch.column(2), batch.column(3)], ["lang", "bits", "draw", "k"])

    return near.mapInArrow(pack, "lang string, bits binary, draw double, k int")


class Model:
    """Languages and the matrices whose product, (buckets x languages), scores presence rows.

    ``matrix`` is that product; with more languages than landmarks it stays (buckets x
    landmarks) and ``last``, (landmarks x languages), is applied to what it gives. With
    ``fences`` (languages x 3: slope, floor and largest log size) there are as many columns
    again, the likeness to each language's mean."""

    def __init__(self, languages: list[str], matrix: np.ndarray, last: np.ndarray | None = None, fences: np.ndarray | None = None) -> None:
        self.languages, self.matrix, self.last, self.fences = languages, matrix, last, fences

    def scores(self, texts: list[str], cells: int = 1 << 22) -> np.ndarray:
        """One row of scores a text."""
        return self.products(texts, cells)[0][:, : len(self.languages)]

    def products(self, texts: list[str], cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
        """All columns of each text, and its number of n-grams: batches of sparse presence
        rows times the matrix.

        A presence row is ones at its ids, so the product of a batch is the segmented sum
        of the matrix rows that its ids name; a batch holds about ``cells`` numbers."""
        width = self.matrix.shape[1]
        out, held, size = [np.zeros((0, width if self.last is None else self.last.shape[1]))], [], 0
        sizes = [np.zeros(0, dtype=np.int64)]
        for k, body in enumerate(texts):
            held.append(presence(body))
            size += len(held[-1])
            if size * max(1, width) >= cells or len(held) * len(self.languages) >= cells or k == len(texts) - 1:
                lengths = np.array([len(ids) for ids in held])
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                product = np.add.reduceat(self.matrix[np.concatenate(held)], starts, axis=0, dtype=np.float64)
                product /= np.sqrt(lengths)[:, None]
                out.append(product if self.last is None else product @ self.last)
                sizes.append(lengths)
                held, size = [], 0
        return np.concatenate(out), np.concatenate(sizes)

    def margin(self, likes: np.ndarray, size: int) -> float:
        """How far above the nearest fence a text lies, as a logarithm: below 0, it is below all.

        A mean over few n-grams may lie lower by chance. Beyond the largest sample row a
        fence falls as the share of the n-grams that one such row can have."""
        slope, floor, top = self.fences[np.isfinite(self.fences[:, 1])].T
        x = math.log(size)
        line = floor + slope * np.minimum(x, top) - np.maximum(0.0, x - top) - 2 / math.sqrt(size)
        over = np.log(np.maximum(1e-9, likes[np.isfinite(self.fences[:, 1])] / math.sqrt(size))) - line
        return float(over.max())

    def foreign(self, texts: list[str], rows: np.ndarray, sizes: np.ndarray) -> list[bool]:
        """Whether each text is foreign, from its products and size.

        It is if it lies below every fence and no score is ``SURE``; where the best language has
        no fence, it is not. A text of more n-grams than any sample row is judged in parts of
        about that many, of which one above a fence is enough. A text of several languages
        may lie below the fence of each: it is not foreign if half its parts of about ``PART``
        n-grams have a score of ``SURE``."""
        k, out = len(self.languages), []
        sure = lambda scores: (scores.max(axis=-1) + 1) / 2 >= SURE
        for body, row, size in zip(texts, rows, sizes):
            at = int(row[:k].argmax())
            below = False
            if np.isfinite(self.fences[at][1]) and not sure(row[:k]):
                most = math.exp(self.fences[at][2])
                likes, ns = (row[None], [size]) if size <= most else self.products(_parts(body, math.ceil(size / most)))
                below = all(self.margin(like, n) < 0 for like, n in zip(likes[:, k:], ns))
            if below and k > 1:
                pieces = _parts(body, max(2, size // PART))
                below = 2 * np.count_nonzero(sure(self.products(pieces)[0][:, :k])) < len(pieces)
            out.append(below)
        return out


def _parts(body: str, n: int) -> list[str]:
    cuts = [len(body) * i // n for i in range(n + 1)]
    return [body[a:b] for a, b in zip(cuts, cuts[1:])]


class Features:
    """The Nyström feature map of landmark rows."""

    def __init__(self, bits: list[bytes]) -> None:
        self.marks = _rows(bits)
        self.norms = np.sqrt(np.maximum(1, self.marks.sum(axis=1, dtype=np.float64)))
        values, vectors = np.linalg.eigh(self.kernel(self.marks))
        good = values > 1e-6 * values.max()
        self.root = vectors[:, good] / np.sqrt(values[good])

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        # Common n-grams are whole numbers below 2^24, exact in single precision.
        return (rows @ self.marks.T) / np.sqrt(np.maximum(1, rows.sum(axis=1, dtype=np.float64)))[:, None] / self.norms

    def totals(self, langs: list[str], bits: list[bytes], into: dict) -> dict:
        """Adds rows to ``into``: their number and feature sums by language, and under None
        the products of features; all are whole numbers."""
        for lo in range(0, len(bits), 64):  # dense rows are large: a few at a time
            phi = np.rint(self.kernel(_rows(bits[lo : lo + 64])) @ self.root * STEP)
            into[None] = into.get(None, 0) + (phi.T @ phi).astype(np.int64).ravel()
            for lang, row in zip(langs[lo : lo + 64], phi.astype(np.int64)):
                into[lang] = into.get(lang, 0) + np.append(row, 1)
        return into

    def fence(self, bits: list[bytes]) -> np.ndarray:
        """Mean feature row of one language's rows, then slope, floor and largest log size.

        Likeness is the mean kernel value with the rows, over the square root of the size: the
        mean weight of a text's n-grams. Its logarithm falls with the log size along a line
        (slope by halves, a median). A row is measured against the others. The floor lies under
        the lowest 5 % by twice their distance from the median, so that up to 5 % of wrong
        labels do not lower it. Copies, near ones too, count once. Languages of fewer than
        ``LEAST`` different rows have no fence: the floor is minus infinity."""
        every = np.frombuffer(b"".join(sorted(bits)), dtype=np.uint8).reshape(len(bits), -1)
        kept, n = np.zeros_like(every), []
        for row in every:
            size = int(np.bitwise_count(row).sum())
            common = np.bitwise_count(kept[: len(n)] & row).sum(axis=1, dtype=np.int64)
            if not (common >= COPY * np.sqrt(size * np.array(n, dtype=np.float64))).any():
                kept[len(n)] = row
                n.append(size)
        m, width = len(n), self.root.shape[1]
        if m < LEAST:
            return np.append(np.zeros(width), [0.0, -np.inf, 0.0])
        phi = np.concatenate([self.kernel(_rows([r.tobytes() for r in kept[lo : min(m, lo + 64)]])) @ self.root for lo in range(0, m, 64)])
        mean, x = phi.mean(axis=0), np.log(n)
        y = np.log(np.maximum(1e-9, (m * (phi @ mean) - (phi * phi).sum(axis=1)) / (m - 1) / np.sqrt(n)))
        order = np.argsort(x, kind="stable")
        low, high = order[: m // 2], order[m - m // 2 :]
        apart = x[high] - x[low]
        far = apart > 0.1
        slope = min(0.0, float(np.median((y[high] - y[low])[far] / apart[far]))) if far.any() else 0.0
        least, middle = np.quantile(y - slope * x, [0.05, 0.5])
        return np.append(mean, [slope, least - 2 * (middle - least), x.max()])

    def solve(self, totals: dict, ridge: float, fences: dict | None = None) -> Model:
        """One ridge regression a language, of targets 1 for its rows and -1 for the others.
        ``fences`` holds what :meth:`fence` gives for each language."""
        languages = sorted(l for l in totals if l is not None)
        width = self.root.shape[1]
        own = np.array([totals[l] for l in languages], dtype=np.int64)
        square = totals[None].reshape(width, width) / float(STEP) ** 2
        sums = (2 * own[:, :-1] - own[:, :-1].sum(axis=0)).T / float(STEP)
        weights = np.linalg.solve(square + ridge * own[:, -1].sum() / 100 * np.eye(width), sums)
        scaled, last, lines = self.marks.T / self.norms.astype(np.float32), self.root @ weights, None
        if fences is not None:
            each = np.array([fences[l] for l in languages])
            last, lines = np.hstack([last, self.root @ each[:, :width].T]), each[:, width:]
        if len(languages) > len(self.marks):
            return Model(languages, np.ascontiguousarray(scaled), last, lines)
        return Model(languages, np.ascontiguousarray(scaled @ last.astype(np.float32)), None, lines)


def _rows(bits: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(len(bits), -1), axis=1).astype(np.float32)


def _untrained(fenced: bool = False) -> Model:
    return Model([], np.zeros((1 << BITS, 0), dtype=np.float32), None, np.zeros((0, 3)) if fenced else None)


def fit(rows: list, landmarks: int = 192, ridge: float = 1e-2) -> Model:
    """Nyström features on ``landmarks`` rows, then ridge regression for each language."""
    rows = sorted(rows, key=lambda r: (r["k"], r["lang"], r["draw"], r["bits"]))
    if not rows:
        return _untrained()
    features = Features([bytes(r["bits"]) for r in rows[:landmarks]])
    return features.solve(features.totals([r["lang"] for r in rows], [bytes(r["bits"]) for r in rows], {}), ridge)


def fit_table(rows: DataFrame, landmarks: int = 192, ridge: float = 1e-2, fenced: bool = False) -> Model:
    """:func:`fit` for a written sample: rows are summed, and fences set, in executors."""
    first = rows.orderBy("k", "lang", "draw", "bits").limit(landmarks).collect()  # 8 KB a row
    if not first:
        return _untrained(fenced)
    marks = [bytes(r["bits"]) for r in first]
    shared = rows.sparkSession.sparkContext.broadcast(marks)

    def add(batches):
        features, totals = Features(shared.value), {}
        for batch in batches:
            totals = features.totals(batch.column(0).to_pylist(), batch.column(1).to_pylist(), totals)
        for lang, sums in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sums), pa.string()), pa.array(np.arange(len(sums))), pa.array(sums)], ["lang", "cell", "total"])

    cells = rows.select("lang", "bits").mapInArrow(add, "lang string, cell long, total long").groupBy("lang", "cell").agg(F.sum("total").alias("total"))
    by_lang: dict = {}
    for r in cells.orderBy("cell").collect():  # about `landmarks` numbers a language
        by_lang.setdefault(r["lang"], []).append(r["total"])
    return Features(marks).solve({l: np.array(v, dtype=np.int64) for l, v in by_lang.items()}, ridge, _fences(rows, shared) if fenced else None)


def _fences(rows: DataFrame, shared) -> dict:
    """:meth:`Features.fence` of every language, about ``landmarks`` numbers each."""
    held: dict = {}  # one feature map a task

    def fence(table: pa.Table) -> pa.Table:
        if not held:
            held["features"] = Features(shared.value)
        line = held["features"].fence(table.column("bits").to_pylist())
        return pa.table({"lang": table.column("lang").slice(0, 1), "line": pa.array([line], pa.list_(pa.float64()))})

    some = rows.filter(F.col("k") <= FENCED).select("lang", "bits").groupBy("lang")
    return {r["lang"]: np.array(r["line"]) for r in some.applyInArrow(fence, "lang string, line array<double>").collect()}


def train(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 250, seed: int = 5, **options) -> Model:
    drawn = sample(docs, usable, text, lang, doc_id, per_language, seed)
    rows = materialise(drawn, "language_sample")
    release_own(drawn, docs)
    model = fit_table(rows, **options)
    discard(rows)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", prefix: str = "lang_") -> DataFrame:
    """``docs`` with ``<prefix>pred`` and ``<prefix>score`` (0 to 1) appended, in place of any
    columns of these names; with a fenced model ``<prefix>foreign`` (boolean) as well."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.matrix, model.last, model.fences))  # 2^16 rows x languages, or landmarks if fewer

    def label(bodies):
        import pandas as pd

        m = Model(*shared.value)
        pred, score, foreign = ["und"] * len(bodies), np.zeros(len(bodies)), np.zeros(len(bodies), dtype=bool)
        at = [i for i, b in enumerate(bodies) if has_letter(b)] if m.languages else []
        if at:
            texts = [bodies.iloc[i] for i in at]
            rows, sizes = m.products(texts)
            s = rows[:, : len(m.languages)]
            for i, k, v in zip(at, s.argmax(axis=1), s.max(axis=1)):
                pred[i], score[i] = m.languages[k], min(1.0, max(0.0, (v + 1) / 2))
            if m.fences is not None:
                foreign[at] = m.foreign(texts, rows, sizes)
        return pd.DataFrame({"pred": pred, "score": score, "foreign": foreign})

    # Deterministic ones run again for every filter on what they give.
    label = F.pandas_udf(label, "pred string, score double, foreign boolean").asNondeterministic()
    new = [prefix + n for n in ("pred", "score", "foreign")][: 2 if model.fences is None else 3]
    rows = packed(docs, p=label(F.col(text)))
    kept = [c for c in docs.columns if c not in new]
    return rows.select(*unpacked(rows, kept), *[F.col("p").getField(n[len(prefix) :]).alias(n) for n in new])
