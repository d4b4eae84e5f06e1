"""The queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fim, htmltext, jaccard, langid, maxscore, periodic, quality, sentencepieces, sharding, simhash, tokenbin, warc
from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (unsigned 32-bit little-endian ids), text_crc32 of the decoded text, restored."""
    path = tokenizer_file("piece_bpe_32k.model")
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"), path)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_digest(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_digest(spark, table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_digest(spark, table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digest(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_digest(table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_sharding, op2_sentencepiece, op3_language_id, op4_exact_topk, op5_ngram_jaccard,
        op6_token_binary, op7_warc, op8_quality, op9_html_extraction, op10_decontamination,
        op11_periodic_runs, op12_fill_in_middle, op13_simhash,
    ]
    return {f.__name__: f for f in found}


# SQL -------------------------------------------------------------------------------------

OP1 = """WITH RECURSIVE k AS (SELECT doc_id, encode(coalesce(text, '')) AS b, coalesce(CAST(doc_id AS VARCHAR), '\\N') AS key FROM documents),
 t(i, n, c) AS (SELECT i::BIGINT, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, n + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM t WHERE n < 8),
 tab AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE n = 8),
 h AS (SELECT doc_id, octet_length(b) + 1 AS size, b, key,
  list_transform(range(17), lambda s: -1.0::DOUBLE / ln((CAST('0x' || substr(md5(s || ':' || key), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)) AS scores FROM k),
 g AS (SELECT doc_id, size, list_position(scores[1:16], list_max(scores[1:16])) - 1 AS shard, list_position(scores, list_max(scores)) - 1 AS grown_shard,
  CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % greatest(8, CAST(ceil((SELECT count(*) FROM documents) / 3200000.0) AS BIGINT)) AS bucket,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(b)), lambda j: CAST('0x' || hex(b[j + 1:j + 1]) AS BIGINT))), lambda a, x: xor(a >> 8, tab.tab[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM h, tab)
 SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM g"""
OP4 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
 r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
 SELECT * FROM r WHERE rank <= 20"""
OP5 = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
 e AS (SELECT doc_id, hash(unnest(s)) AS h, len(s) AS n FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)), u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 c(doc_id, o) AS (SELECT doc_id, doc_id FROM s UNION SELECT u.b, c.o FROM c JOIN u ON u.a = c.doc_id WHERE c.o < u.b)
 SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(c.o) AS component_id FROM s JOIN c USING (doc_id) GROUP BY s.doc_id, s.s"""
OP7 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
 g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d), r AS (SELECT *, payload_bytes >= 1000 AND page_id < top AS again FROM g)
 SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to FROM r"""
_WORDS10 = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP10 = f"""WITH d AS (SELECT doc_id, {_WORDS10} AS w FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS10} AS w FROM benchmark WHERE item_id IS NOT NULL),
 x AS (SELECT item, least(10, len(w)) AS n, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0),
 iw AS (SELECT DISTINCT item, n, hash(array_to_string(w[k:k + n - 1], ' ')) AS h FROM x),
 sizes AS (SELECT DISTINCT n FROM iw),
 dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, sizes WHERE len(w) >= n),
 m AS (SELECT dw.doc_id, dw.k, dw.n, iw.item FROM (SELECT doc_id, n, k, hash(array_to_string(w[k:k + n - 1], ' ')) AS h FROM dw) dw JOIN iw USING (n, h)),
 hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS q FROM m) GROUP BY doc_id),
 it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

OP12 = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 u AS (SELECT doc_id, text, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u, list_transform(range(4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS h FROM d),
 c AS (SELECT doc_id, text, u, len(u) AS n, h[1] % (len(u) + 1) AS x, h[2] % (len(u) + 1) AS y,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
 p AS (SELECT doc_id, text, n, form, array_to_string(u[1:least(x, y)], '') AS prefix, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS middle, array_to_string(u[greatest(x, y) + 1:n], '') AS suffix FROM c)
 SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1, "op4_exact_topk": OP4, "op5_ngram_jaccard": OP5, "op7_warc": OP7, "op10_decontamination": OP10, "op12_fill_in_middle": OP12}
