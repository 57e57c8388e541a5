"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import attribution, centroids, codes, epsilon, language, licenses, mixing, packing, scoring, sharding, simhash, substrings, topk
from statuta.llm.common import table


def op1_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pseudo_likelihood(table(spark, sf_dir, "documents"), rounds=2, share=2)


def op2_nra_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op3_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(table(spark, sf_dir, "documents"), "doc_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"), width=13)


def op5_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), capacity=1024)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_amounts(table(spark, sf_dir, "documents"))


def op8_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, reach=2)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op9_offset_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(table(spark, sf_dir, "documents"), rule="most")


def op10_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsilon.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op11_partial_distance_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, width=64)


def op12_weighted_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_report(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def op13_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digests(table(spark, sf_dir, "documents"), shards=8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_masked_likelihood, op2_nra_top_k, op3_word_backoff_language, op4_substring_dedup, op5_vector_best_fit,
        op6_license_scan, op7_source_mix, op8_simhash_vptree, op9_offset_attribution, op10_epsilon_grid_join,
        op11_partial_distance_clusters, op12_weighted_codebooks, op13_stratified_shards,
    )
}

#: Vectors that take part, as doubles.
_VECTORS = """e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
_TOP_K = f"""
WITH {_VECTORS}, q AS (SELECT vec_id, list_transform(v, lambda x: floor(64 * x)) AS v FROM e),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 20"""
_WINDOWS = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS a FROM documents),
g AS (SELECT doc_id, i, array_to_string(a[i:i + 12], ' ') AS k FROM (SELECT doc_id, a, unnest(range(1, len(a) - 11)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS m FROM g GROUP BY k HAVING count(*) > 1),
r AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM g JOIN f USING (k) WHERE m < doc_id)),
w AS (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS i FROM d),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM w ANTI JOIN r ON r.doc_id = w.doc_id AND r.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, len(a)::BIGINT AS n_words, (len(a) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
_COMPONENTS = f"""
WITH RECURSIVE {_VECTORS}, u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e WHERE list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id"""


def _nearest(n: int, row: str) -> str:
    """Round n: the nearest entry (c) of each row, of lower number at equal distances."""
    pairs = f"SELECT x.{row.replace(', ', ', x.')}, y.c, sum((x.x - y.x) * (x.x - y.x))::BIGINT AS d FROM x JOIN c{n} y USING ({row.replace("r", "i", 1)}) GROUP BY ALL"
    return f"a{n} AS MATERIALIZED (SELECT {row}, min_by(c, (d, c)) AS c, min(d) AS d FROM ({pairs}) GROUP BY {row})"


def _moved(n: int, row: str, entry: str) -> str:
    """The entries after round n: floors of means, unused ones as they were."""
    means = f"SELECT {entry.replace('c', 'a.c')}, x.i, (sum(x.x) // count(*) - CASE WHEN sum(x.x) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS x FROM a{n} a JOIN x USING ({row}) GROUP BY ALL"
    return f"c{n + 1} AS MATERIALIZED (SELECT {entry}, i, coalesce(m.x, o.x) AS x FROM c{n} o LEFT JOIN ({means}) m USING ({entry}, i))"


_CLUSTERS = f"""
WITH {_VECTORS}, k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(v, lambda x: floor(64 * x)::BIGINT) AS q FROM e WHERE len(v) = 64),
x AS MATERIALIZED (SELECT r, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM k),
s AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c, q FROM k QUALIFY c < 16),
c0 AS MATERIALIZED (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM s),
{", ".join(f"{_nearest(n, 'r')}, {_moved(n, 'r', 'c')}" for n in range(3))}, {_nearest(3, "r")},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c3 GROUP BY c)
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM a3 JOIN k USING (r) JOIN h USING (c)"""
_CODES = f"""
WITH {_VECTORS.replace("vec_id,", "vec_id, label,")},
k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, v) AS r, vec_id, label, list_transform(v, lambda x: floor(256 * x)::BIGINT) AS q FROM e),
x AS MATERIALIZED (SELECT r, (i - 1) // (n // 16) AS p, i, x FROM (SELECT r, unnest(q) AS x, generate_subscripts(q, 1) AS i, len(q) AS n FROM k)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS c, i, x FROM x WHERE r <= 64),
{", ".join(f"{_nearest(n, 'r, p')}, {_moved(n, 'r, p', 'p, c')}" for n in range(2))}, {_nearest(2, "r, p")},
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, c, i)) AS h FROM c2),
z AS (SELECT r, string_agg(lower(printf('%02x', c)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM k JOIN z USING (r), h"""
#: The checksum goes over the bytes with a table of 256 remainders.
_SHARDS = """
WITH RECURSIVE p(n, c) AS (SELECT 0, range(256)::UINTEGER[] UNION ALL SELECT n + 1, list_transform(c, lambda x: xor(x >> 1, (x & 1) * 3988292384)::UINTEGER) FROM p WHERE n < 8),
t AS (SELECT c AS crc FROM p WHERE n = 8),
d AS (SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UINTEGER) AS b,
('0x' || substr(md5('13:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
z AS (SELECT doc_id, source, size, h, xor(list_reduce(list_prepend(4294967295::UINTEGER, b), lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])), 4294967295)::BIGINT AS text_crc32 FROM d, t),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS LAST) - 1 AS r, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total,
(('0x' || substr(md5('13:' || coalesce(source, '')), 1, 15))::BIGINT::DOUBLE + 0.5) / 1152921504606846976::DOUBLE AS u FROM z),
g AS (SELECT *, row_number() OVER (ORDER BY (r::DOUBLE + u) / n::DOUBLE, source NULLS LAST, r) - 1 AS i FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (i * 8 // total)::INT AS shard, (i - ((i * 8 // total) * total + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard FROM g"""

#: Queries that SQL can express.
SQL: dict[str, str] = {
    "op2_nra_top_k": _TOP_K, "op4_substring_dedup": _WINDOWS, "op6_license_scan": licenses.scan_sql(), "op10_epsilon_grid_join": _COMPONENTS,
    "op11_partial_distance_clusters": _CLUSTERS, "op12_weighted_codebooks": _CODES, "op13_stratified_shards": _SHARDS,
}
