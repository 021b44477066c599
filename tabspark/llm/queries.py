"""The registered queries of the thirteen corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html, langid, minhash, negatives, overlap, packing, phrases, planes, quality, toxicity, weak, winnow
from .common import read


def _file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(read(spark, sf_dir, "documents"), 85)


def op2_wrapper_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op3_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.run(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), _file("byte_bpe_50k.json"), 2048)


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(read(spark, sf_dir, "documents"))


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak.judge(read(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), _file("byte_bpe_50k.tiktoken"), _pattern())


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.run(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.run(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.id_files(read(spark, sf_dir, "documents"), _file("byte_bpe_50k.json"), "byte")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(read(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_wrapper_html, op3_rule_quality, op4_best_fit_packing, op5_winnowing, op6_weak_supervision, op7_byte_bpe, op8_language, op9_toxicity, op10_token_planes, op11_collocations, op12_decontamination, op13_hard_negatives)}

# The others need a model, a tokenizer or a hash function of the library.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM g),
links AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM e a JOIN e b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL)
  WHERE 100 * c >= 85 * (nx + ny - c)),
reach AS (SELECT doc_id, doc_id AS other FROM g UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.other = links.x)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, min(reach.other) AS component_id, g.doc_id = min(reach.other) AS kept
FROM g JOIN reach USING (doc_id) GROUP BY g.doc_id, len(g.s)""",
    "op11_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(ws) >= m)),
total AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
f AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 100),
cut AS (
  SELECT lang, m, phrase, f AS a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:m], ' ') AS y
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)),
s AS (
  SELECT cut.lang, cut.phrase, cut.m, a, k, l.f AS l, r.f AS r, n, (1000 * a::HUGEINT * n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y JOIN total ON total.lang = cut.lang),
worst AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_part AS (
  SELECT DISTINCT b.lang, array_to_string(b.ws[i:i + q - 1], ' ') AS phrase, b.f
  FROM (SELECT *, unnest(range(1, m - q + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS q FROM f WHERE m > 2)) b),
live AS (
  SELECT * FROM worst WHERE NOT EXISTS (SELECT 1 FROM inner_part b WHERE b.lang = worst.lang AND b.phrase = worst.phrase AND 100 * b.f >= 100 * worst.a))
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM live)
WHERE rank <= 2000""",
    "op12_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS row_ix, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(ws), 10) AS m, array_to_string(ws[i:i + 9], ' ') AS w
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
place AS (
  SELECT row_ix, i, m, array_to_string(ws[i:i + m - 1], ' ') AS w
  FROM (SELECT row_ix, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(ws) >= m)),
hit AS (SELECT row_ix, i, m, item FROM place JOIN win USING (m, w)),
words AS (SELECT row_ix, count(DISTINCT p) AS n FROM (SELECT row_ix, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT row_ix, i, m FROM hit)) GROUP BY row_ix),
items AS (SELECT row_ix, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY row_ix)
SELECT doc_id, len(ws) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row_ix) LEFT JOIN items USING (row_ix)""",
    "op13_hard_negatives": r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT row_number() OVER () AS ix, * FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0)),
s AS (
  SELECT ix, a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
  FROM a JOIN v ON v.vec_id IS DISTINCT FROM a.vec_id),
pos AS (
  SELECT ix, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ix ORDER BY score DESC, vec_id NULLS LAST) AS place
  FROM s WHERE same QUALIFY place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT pos.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY pos.ix, pos.place ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM pos JOIN s ON s.ix = pos.ix AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
WHERE rank <= 10""",
}
