"""Queries of the corpus operators and of the corpus pipeline, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, exact_dedup, fill_middle, language_id, language_model, licenses, mixing, near_dedup, nearest, ngram_join, packing, token_files, toxicity
from .common import workspace

BPE = public_tokenizers.path("byte_bpe_50k.json")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = workspace(spark, "tokens")
    token_files.write_token_files(documents(spark, sf_dir), store, BPE, end_id=2)
    return token_files.read_token_files(spark, store, keep_ids=False).drop("ids")


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), BPE, end_id=0)


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


ORACLES["op9_exact_dedup"] = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""


@query
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=2, percent=80)


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "source", "repetition", "block", "position", "n_tokens")


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


@query
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)


@query
def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir), folds=7, held=2)


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir), folds=5, held=0)


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=3, held=1)


@query
def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir), width=3, percent=90)


ORACLES["op11_ngram_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(g) AS g FROM s),
l AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id WHERE 100 * least(p.n_shingles, q.n_shingles) >= 90 * greatest(p.n_shingles, q.n_shingles)
GROUP BY a.doc_id, b.doc_id, p.n_shingles, q.n_shingles HAVING 100 * count(*) >= 90 * (p.n_shingles + q.n_shingles - count(*))),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.doc_id)
SELECT n.doc_id, n.n_shingles, min(r.root) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3, dimensions=64, scale=64, seed=1).drop("scans")


def _round(i: int) -> str:
    """One assignment (a) to centroids c, and the centroids after it."""
    return f"""
a{i} AS MATERIALIZED (SELECT row, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (SELECT x.row, c{i}.c, CAST(sum((x.e - y.e) * (x.e - y.e)) AS BIGINT) AS d FROM e x JOIN c{i} y ON x.i = y.i JOIN (SELECT DISTINCT c FROM c{i}) c{i} ON c{i}.c = y.c GROUP BY ALL) GROUP BY row),
m{i} AS (SELECT a.cluster AS c, e.i, CAST(sum(e.e) AS BIGINT) AS s, count(*) AS n FROM a{i} a JOIN e ON e.row = a.row GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.c, c.i, CASE WHEN m.n IS NULL THEN c.e ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) AS BIGINT) // m.n END AS e FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c AND m.i = c.i)"""


ORACLES["op12_centroids"] = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
e AS MATERIALIZED (SELECT row, unnest(range(64)) AS i, unnest(v) AS e FROM k),
s AS (SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c FROM k),
c0 AS MATERIALIZED (SELECT CAST(s.c AS INT) AS c, e.i, e.e FROM s JOIN e ON e.row = s.row WHERE s.c < 16),{",".join(map(_round, range(4)))},
h AS (SELECT c, sha256(string_agg(CAST(e AS VARCHAR), ',' ORDER BY i)) AS h FROM c3 GROUP BY c)
SELECT k.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256 FROM a3 a JOIN k ON k.row = a.row JOIN h ON h.c = a.cluster
"""


@query
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restore(fill_middle.transform(documents(spark, sf_dir).select("doc_id", "text"), seed=42, percent=50, spm_percent=80))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return made.select("doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"), digest("fim_text").alias("output_sha256"), digest("fim_restored").alias("restored_sha256"))


ORACLES["op13_fill_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS x FROM d),
n AS (SELECT *, CAST(len(u) AS BIGINT) AS n FROM t),
c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
s AS (SELECT *, list_aggregate(u[1:a], 'string_agg', '') AS p, list_aggregate(u[a + 1:b], 'string_agg', '') AS m, list_aggregate(u[b + 1:n], 'string_agg', '') AS z FROM c),
f AS (SELECT *, coalesce(p, '') AS pp, coalesce(m, '') AS mm, coalesce(z, '') AS zz FROM s)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pp) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mm) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pp || '<S>' || zz || '<M>' || mm ELSE '<S>' || zz || '<P>' || pp || '<M>' || mm END) AS output_sha256, sha256(text) AS restored_sha256 FROM f
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)
