"""The pipeline's stages keep what they should, and run() equals the stages in turn."""

import random

import pytest

import corpus_pipeline as pipeline
from lumenframe.llm import simhash

from .test_operators import DOCS, WORD, docs, make_text  # noqa: F401


def test_stages_return_document_columns(spark, docs, tmp_path):  # noqa: F811
    frame, before = docs, docs
    for i, (name, stage) in enumerate(pipeline.STAGES):
        frame = stage(spark, frame, "")
        frame.write.parquet(str(tmp_path / str(i)))
        frame = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(pipeline.STAGES) - 1:
            assert frame.columns == before.columns, name
            assert [f.dataType for f in frame.schema] == [f.dataType for f in before.schema], name
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "simhash_dedup", "secret_scan", "source_mix", "packing"]
    docs.write.parquet(str(tmp_path / "sf/documents.parquet"))
    got = pipeline.run(spark, str(tmp_path / "sf"))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(repr, got.select(key).collect())) == sorted(map(repr, frame.select(key).collect()))


def test_language_stage_keeps_clean_documents(spark, docs):  # noqa: F811
    kept = {r["doc_id"] for r in pipeline.language_id(spark, docs, "").collect()}
    assert {400, 401, 402, 403}.isdisjoint(kept)
    assert set(range(160)) <= kept


def spanish(rng, n):
    return " ".join("".join(rng.choice("ción os as ez ga jo ñ ue".split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def foreign_texts(rng):
    """Gibberish of many lengths (one longer than any labelled row), invented languages."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))
    other = lambda n, parts: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))
    out = [noise(n) for n in (40, 60, 100, 200, 500, 9000)]
    return out + [other(n, p.split()) for n in (60, 120, 400) for p in ("ova pri ako sku dze myl tak ju", "пре ова ние сто лия ко", "kuwa mba nji pia zo lek hu")]


def test_language_stage_rejects_foreign_texts(spark, docs):  # noqa: F811
    rng = random.Random(8)
    foreign = [(1000 + i, t, None, "s1", 0) for i, t in enumerate(foreign_texts(rng))]
    clean = [(2000 + i, make_text(rng, 3 + 8 * i, lang), None, "s1", 0) for i, lang in enumerate(["en", "de", "fr"] * 10)]
    clean += [(2100, make_text(rng, 20000, "fr"), None, "s1", 0), (2101, " ".join(make_text(rng, 60, l) for l in ("fr", "de", "en")), None, "s1", 0)]
    out = {r["doc_id"]: r for r in pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(foreign + clean, DOCS)), "").collect()}
    assert not [i for i in out if i is not None and 1000 <= i < 2000]
    assert {r[0] for r in clean} | set(range(160)) <= set(out)
    assert [out[2000 + i]["lang"] for i in range(3, 30)] == ["en", "de", "fr"] * 9
    labels = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(out[i]["lang"] == labels[i] for i in range(160))


def test_foreign_texts_are_not_packed(spark, docs, tmp_path):  # noqa: F811
    rng = random.Random(11)
    foreign = [(1000 + i, t, None, "s1", 0) for i, t in enumerate(foreign_texts(rng))]
    docs.unionByName(spark.createDataFrame([*foreign, (2000, make_text(rng, 60, "de"), None, "s1", 0)], DOCS)).write.parquet(str(tmp_path / "documents.parquet"))
    packed = {r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert packed.isdisjoint(range(1000, 2000)) and 404 in packed


@pytest.mark.parametrize("copies, others", [(300, 5), (3000, 40)])
def test_language_stage_keeps_texts_beside_many_copies(spark, docs, copies, others):  # noqa: F811
    """Copies of one text, a word apart, are most rows of their language."""
    rng = random.Random(9)
    one = spanish(rng, 150)
    rows = [(1000 + i, f"{one} {spanish(rng, 1)}", "es", "s", 0) for i in range(copies)]
    rows += [(9000 + i, spanish(rng, 20 + 5 * i), "es", "s", 0) for i in range(others)]
    out = pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(rows, DOCS)), "")
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert {r[0] for r in rows} | set(range(160)) <= kept


def test_wrong_labels_do_not_lower_the_fence(spark):
    rng = random.Random(10)
    rows = [(i, make_text(rng, 20 + i % 150, "de" if i % 4 == 0 else "en"), "de" if i % 4 == 0 else "en", "s", 0) for i in range(240)]
    rows += [(900 + i, t, "en", "s", 0) for i, t in enumerate(foreign_texts(rng)[:6])]
    foreign = [(1000 + i, t, None, "s1", 0) for i, t in enumerate(foreign_texts(rng)[6:])]
    kept = {r["doc_id"] for r in pipeline.language_id(spark, spark.createDataFrame(rows + foreign, DOCS), "").select("doc_id").collect()}
    assert kept.isdisjoint(range(1000, 2000)) and set(range(240)) <= kept


def test_one_document_of_each_group_stays(spark, docs):  # noqa: F811
    some = docs.filter("doc_id is not null")
    comp = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(some).collect()}
    out = [r["doc_id"] for r in pipeline.simhash_dedup(spark, some, "").collect()]
    assert sorted(out) == sorted(set(comp.values()))


def test_repeated_ids_keep_their_texts(spark):
    rng = random.Random(4)
    a, b = make_text(rng, 50), make_text(rng, 50)
    rows = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (1, b, "en", "s", 0), (2, a, "en", "s", 0), (None, b + " x", "en", "s", 0)]
    out = pipeline.simhash_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert {r["text"] for r in out} >= {a} and len(out) == len({simhash.fingerprint(r[1]) for r in rows})


def test_secrets_are_masked(spark):
    rng = random.Random(1)
    rows = [(i, make_text(rng, 20) + (" token=abcdefghijklmno" if i == 3 else ""), "en", "s", 0) for i in range(6)]
    out = {r["doc_id"]: r for r in pipeline.secret_scan(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert out[3]["text"].endswith("[REDACTED]") and out[3]["n_chars"] == len(out[3]["text"])
    assert all(out[i]["text"] == rows[i][1] for i in range(6) if i != 3)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "one two", "en", "s", 7)]])
def test_small_inputs(spark, rows, tmp_path):
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert bool(out) == any(r[1] for r in rows)
    assert all(WORD for _ in out)


def test_written_tables_go(spark, docs, tmp_path):  # noqa: F811
    from pathlib import Path

    from lumenframe.llm import common

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    root = Path(common.checkpoint_root(spark))
    before = set(root.iterdir())
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
    common.release(out)
    assert not [p.name for p in set(root.iterdir()) - before if p.name.startswith("lumenframe-")]
    assert docs.count() == spark.read.parquet(str(tmp_path / "documents.parquet")).count()
