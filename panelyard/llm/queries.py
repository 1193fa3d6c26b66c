"""The registered queries of this subpackage: each applies one operator to its whole table and digests the result."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, infill, lm, mixing, negatives, passages, pieces, pii, quality, secrets, shards, simhash, vectors
from .common import read, sha256_hex


def tokenizer_path() -> str:
    """The public merge-type model; another one can be named by the caller of the operator."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path("piece_bpe_32k.model"))


def number_of(kind: str) -> Column:
    """Base spans of a kind."""
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    coded = pieces.encode_documents(read(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_hex(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, one row per draw."""
    return mixing.draws(mixing.plan_mix(read(spark, sf_dir, "documents"))).drop("row_key")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), width=3, most=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = read(spark, sf_dir, "documents")
    found = pii.find_personal_data(docs, pii.train(docs))
    counts = [number_of(kind) for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, sha256_hex(pii.joined(F.col("base"))).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans")
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict for every document."""
    return quality.judge(read(spark, sf_dir, "documents")).drop("row_key", "grp")


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"), least=0.9)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = secrets.find_secrets(read(spark, sf_dir, "documents"))
    counts = [number_of(kind) for kind in secrets.KINDS]
    return found.select(
        "doc_id",
        *counts,
        sha256_hex(secrets.joined(F.col("base"))).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of fifty words and more that repeat across documents."""
    return passages.repeated_passages(read(spark, sf_dir, "documents"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen shards by their ids."""
    return shards.shard_rows(read(spark, sf_dir, "documents"), 16)


def op10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the pair model of the training documents."""
    return lm.score_documents(read(spark, sf_dir, "documents"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays of every group of equal texts."""
    found = exact.exact_groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP11_SQL = """WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
  g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)"""


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at lines for filling in the middle, and rebuilt."""
    made = infill.fill_in_middle(read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        sha256_hex(F.col("output")).alias("output_sha256"),
        sha256_hex(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


_H = [f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT AS h{i + 1}" for i in range(4)]
OP12_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
  l AS (SELECT doc_id, t, {", ".join(_H)}, string_split(t, chr(10)) AS p FROM d),
  m AS (SELECT *, len(p) - CASE WHEN p[len(p)] = '' THEN 1 ELSE 0 END AS n FROM l),
  c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 AS plain FROM m),
  x AS (SELECT *, CASE WHEN a = n THEN length(t) ELSE length(array_to_string(p[1:a], chr(10))) + least(a, 1) END AS i,
      CASE WHEN b = n THEN length(t) ELSE length(array_to_string(p[1:b], chr(10))) + least(b, 1) END AS j FROM c),
  y AS (SELECT *, substr(t, 1, i) AS pre, substr(t, i + 1, j - i) AS mid, substr(t, j + 1) AS suf FROM x)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN i::BIGINT END AS prefix_chars, CASE WHEN NOT plain THEN (j - i)::BIGINT END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN h4 % 100 < 50 THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
    ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM y"""


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, for each of its nearest rows of the same label."""
    rows = read(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding"
    )
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


OP13_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.e, r.e)::BIGINT AS score
    FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_sentencepiece,
        op2_mixing,
        op3_simhash,
        op4_personal_data,
        op5_quality,
        op6_vectors,
        op7_secrets,
        op8_passages,
        op9_shards,
        op10_scores,
        op11_exact,
        op12_infill,
        op13_negatives,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL can express the last three. Hashes, trained models, tokenizers and components of the others are compared
    with brute force in ``tests/llm``."""
    return {"op11_exact": OP11_SQL, "op12_infill": OP12_SQL, "op13_negatives": OP13_SQL}
