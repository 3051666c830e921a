"""The registered queries of the corpus operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, html_text, langid, licenses, mixing, packing, secrets, simhash, topk, vector_links


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda s: s["rank"] < len(secrets.BASE))
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[of(k) for k in secrets.BASE], F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_examples"),
    )


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = langid.train(docs, ~held_out)
    out = langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    best = F.element_at(F.array_sort("matches", lambda a, b: F.when(a["coverage"] > b["coverage"], -1).when(a["coverage"] < b["coverage"], 1).otherwise(a["start"] - b["start"])), 1)
    said = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["stop"].cast("string")))
    some = F.size("matches") > 0
    return out.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"), F.when(some, best["license"]).alias("license"),
        F.when(some, F.round(best["coverage"], 6)).otherwise(0.0).alias("coverage"), F.array_join(said, ",").alias("spans"),
    )


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc_id", (F.size("repeated") > 0).alias("has_repeats"), "n_chunks", "n_repeated", total("repeated").alias("repeated_chars"), total("removable").alias("removable_chars"), said("repeated").alias("repeated_spans"), said("removable").alias("removable_spans"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_text, op2_embedding_dedup, op3_secret_scan, op4_source_mix, op5_language_id, op6_packing, op7_license_scan, op8_simhash_dedup, op9_substring_dedup, op10_exact_topk)}


# Exact scores by brute force; fine at the sizes of the SQL check.
TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

# All links by brute force, then the smallest reachable id.
LINKS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a), deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(deg.n, 0) AS n_links, least(v.vec_id, coalesce(low.m, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(low.m, v.vec_id)) AS kept
FROM v LEFT JOIN low ON low.a = v.vec_id LEFT JOIN deg ON deg.a = v.vec_id
"""


def _kind_sql(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind in SQL: where a match stands follows from the gaps before it."""
    p = pattern.replace("'", "''")
    before = "list_sum(list_transform(gap[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:k - 1], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, source, lang, {rank} AS rank, '{kind}' AS kind, start, start + length(whole) AS stop, value FROM (
  SELECT doc_id, source, lang, {before} AS start, hit[k] AS whole, val[k] AS value FROM (
    SELECT doc_id, source, lang, hit, val, gap, unnest(range(1, len(hit) + 1)) AS k FROM (
      SELECT doc_id, source, lang, regexp_extract_all(text, '{p}') AS hit, regexp_extract_all(text, '{p}', {group}) AS val, string_split_regex(text, '{p}') AS gap
      FROM documents WHERE regexp_matches(text, '{p}')))) WHERE length(value) >= {least}"""


def _secret_sql() -> str:
    # RE2 folds case beyond ASCII, so the either-case letters are written out.
    spelled = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    kinds = []
    for i, k in enumerate(secrets.KINDS):
        pattern, group, least = (secrets.BASE | secrets.ADDED)[k]
        pattern = pattern.replace("(?i:password|passwd|secret|token|api_?key)", spelled)
        kinds.append(_kind_sql(i, k, pattern, group, least))
    said = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank){}, '')"
    return f"""WITH spans AS ({" UNION ALL ".join(kinds)}),
owners AS (SELECT value, count(DISTINCT coalesce(source, '')) AS n FROM spans GROUP BY value),
each AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)},
  {said.format(f" FILTER (rank < {len(secrets.BASE)})")} AS base, {said.format("")} AS spans,
  count(*) FILTER (n < 3) AS n_live, count(*) FILTER (n >= 3) AS n_examples FROM spans JOIN owners USING (value) GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples FROM documents d LEFT JOIN each USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": LINKS_SQL, "op3_secret_scan": _secret_sql(), "op10_exact_topk": TOPK_SQL}
