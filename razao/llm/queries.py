"""The registered queries of the text operators and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (fill_middle, html_trees, language_id, packing, paragraph_sketch, piece_rounds, quality_neighbours, radix_dedup, secret_scan, sharding,
               simhash, spelling, topk)
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every vector whose vec_id is divisible by 20, against all other vectors."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash over 3-word shingles and its component at 2 or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts of the base kinds, their digest, and all spans."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op4_html_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html_trees.extract(table(spark, sf_dir, "pages"))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24 by virtual slots; sizes are near equal."""
    rows, _ = sharding.assign(table(spark, sf_dir, "documents"), shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def remainder(parts: int):
    """crc32(doc_id as text) mod ``parts``; null where doc_id is null."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op7_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; learned from labelled documents whose crc32 remainder of 3 isn't 1."""
    docs = table(spark, sf_dir, "documents")
    space = quality_neighbours.learn(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    found = quality_neighbours.classify(docs, space)
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_piece_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids and decoded text, as digests."""
    return piece_rounds.digest_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and the likeness to that and to the next document's."""
    return paragraph_sketch.edited_and_next(table(spark, sf_dir, "documents"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; learned from the documents whose crc32 remainder of 4 isn't 2."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.learn(docs, remainder(4) != 2))
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op11_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of texts that are equal but for runs of white space."""
    return radix_dedup.classes(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for fill-in-the-middle, and the text rebuilt from that, as digests."""
    made = fill_middle.documents(table(spark, sf_dir, "documents"), seed=1, rate=90, spm=20)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's likely correct form, the root of its forms, and its near words."""
    return spelling.variants(table(spark, sf_dir, "documents"), least_length=6, least_count=5, ratio=5, modulus=199)


QUERIES = {f.__name__: f for f in (
    op1_topk_segments, op2_simhash, op3_secrets, op4_html_trees, op5_best_fit, op6_slots, op7_quality_neighbours, op8_piece_rounds, op9_paragraph_sketch,
    op10_kneser_ney, op11_radix_dedup, op12_fill_middle, op13_spelling)}

SQL = {
    "op1_topk_segments": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20""",
    "op11_radix_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM t WINDOW same AS (PARTITION BY body)""",
    "op12_fill_middle": """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
d AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
p AS (
  SELECT doc_id, text, n, form, array_to_string(u[:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(u[greatest(a, b) + 1:], '') AS suffix
  FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p""",
    # a checksum step for each byte; near words share what is left without one code point
    "op13_spelling": r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS step, CAST(i AS BIGINT) AS c FROM range(256) r(i)
  UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS cells FROM bits WHERE step = 8),
runs AS (
  SELECT doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS x FROM documents)
  WHERE length(x) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
           string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
           lambda s: CASE WHEN unicode(s) < 128 THEN [CAST(unicode(s) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(s) - 64 AS BIGINT)] END))),
           lambda a, b: xor(a >> 8, cells[(xor(a, b) & 255) + 1]))) AS h
  FROM runs, crc),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
met AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM met GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
up AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT u.word, f.form FROM up u JOIN formed f ON u.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, u.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN up u ON f.word = u.word JOIN formed g ON u.at = g.word WHERE g.form IS NULL""",
}
