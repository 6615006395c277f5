"""Registered queries ``opN_<name>`` over whole tables, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reclattice.llm import (
    bpe, decontaminate, embeddings, language, lookup_clusters, neardup, pii, scoring, substrings, token_files, topk,
    toxicity, whitening,
)
from reclattice.llm.common import held_out, table
from reclattice.session import scratch_path, ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digest(pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that occurs more than once, with the documents it stands in."""
    return substrings.repeats(table(spark, sf_dir, "documents"))


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of near-duplicate documents on four-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.FOUR_WORDS)


SQL["op3_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), least_of AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN least_of ON a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled ones that are not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = held_out("doc_id", 4, 2)
    model = toxicity.fit(toxicity.labelled(documents, table(spark, sf_dir, "labels"), ~kept))
    return toxicity.score(documents, model).select("doc_id", kept.alias("held_out"), "score", "predicted")


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token ids in ORC files, read back."""
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_TOKENIZER)
    )
    return token_files.crc_of_ids(token_files.read_tokens(spark, path)).select(
        "doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32"
    )


@query
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, learnt from those that are not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 5, 1).alias("held_out"))
    return scoring.scores(documents, public_tokenizers.path(BYTE_RANKS))


@query
def op7_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and clusters of embeddings within a label."""
    found = embeddings.cosine_links(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


SQL["op7_embedding_links"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), least_of AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a
), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least_of ON least_of.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op8_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT DISTINCT dw.doc_id, dw.n, dw.i, bw.item FROM dw JOIN bw USING (n, p)
), cover AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, decoded again."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(documents)


def round_trip(documents: DataFrame) -> DataFrame:
    """doc_id with the count and hash of its ids and the hash of the decoded bytes."""
    path, pattern = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN
    encoded = bpe.encode(documents.select("doc_id", "text"), path, pattern).select("doc_id", "ids")
    return bpe.decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    documents = table(spark, sf_dir, "documents")
    kept = held_out("doc_id", 5, 0)
    model = language.fit(documents.filter(~kept).select("doc_id", "text", "lang"))
    return language.predict(documents.select("doc_id", "text"), model).select(
        "doc_id", kept.alias("held_out"), "lang_pred", "score"
    )


@query
def op11_top_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    return topk.top_neighbours(table(spark, sf_dir, "embeddings"))


# Vectors that take part, as integers: components times {scale}, rounded down.
_INTEGERS = """
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
"""

SQL["op11_top_neighbours"] = f"""
WITH v AS ({_INTEGERS.format(scale=64)}
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
) SELECT * FROM ranked WHERE rank <= 20
"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the four directions of largest variance, each scaled to variance 1."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query
def op13_lookup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters after three rounds."""
    return lookup_clusters.cluster(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def _clusters_sql() -> str:
    """Rounds of assignment and floored means, spelt out."""
    parts = [
        f"v AS (SELECT vec_id, x FROM ({_INTEGERS.format(scale=64)}) WHERE len(x) = 64)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16)",
    ]
    for n in range(4):
        parts.append(f"""a{n} AS (SELECT vec_id, x, c, far FROM (
  SELECT vec_id, v.x, c, far, row_number() OVER (PARTITION BY vec_id ORDER BY far, c) AS place FROM (
    SELECT vec_id, v.x, c, list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS far FROM v, c{n} m) v) WHERE place = 1)""")
        if n < 3:
            parts.append(f"""c{n + 1} AS (SELECT m.c, coalesce(f.x, m.x) AS x FROM c{n} m LEFT JOIN (
  SELECT c, list(mean ORDER BY d) AS x FROM (
    SELECT c, d, CAST(floor(sum(value) / count(*)) AS BIGINT) AS mean FROM (SELECT c, unnest(x) AS value, unnest(range(1, 65)) AS d FROM a{n}) GROUP BY c, d
  ) GROUP BY c) f USING (c))""")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(far AS BIGINT) AS distance,
  CAST(sum(far) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(far) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a3 JOIN c3 m USING (c)
"""


SQL["op13_lookup_clusters"] = _clusters_sql()
