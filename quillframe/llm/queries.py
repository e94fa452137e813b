"""The queries opN_<name>: each operator over its whole table with production parameters, as its contract says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, langid, packing, quality, simhash, token_counts, token_files, topk, toxicity, url_filter
from .common import new_path, remainder

#: Vocabulary files, by the installed package that holds them; never copied here.
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4, words=4)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "token-files")
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), out, end_id=1)
    return token_files.with_crc32(token_files.read_token_files(spark, out, manifest))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), end_id=2, capacity=4096).drop("ids")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit(docs.where(remainder("doc_id", 4) != 2))
    found = langid.identify(docs, profiles)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


#: A dated block list (fixed values): domain, action, date, category.
URL_LIST = [
    ("casino-win.example.com", "add", "2024-01-10", "gambling"),
    ("free-bets.example.com", "add", "2024-01-01", "gambling"),
    ("free-bets.example.com", "remove", "2024-03-01", "gambling"),
    ("free-bets.example.com", "add", "2024-08-15", "gambling"),
    ("cheap-pills.example.com", "add", "2024-02-20", "pharmacy"),
    ("cheap-pills.example.com", "remove", "2024-11-05", "pharmacy"),
    ("example.net", "add", "2024-05-01", "parked"),
    ("example.net", "remove", "2024-06-01", "parked"),
    ("tionsh.example.net", "add", "2024-04-01", "spam"),
    ("tionsh.example.net", "remove", "2024-09-30", "spam"),
    ("blog.tionble.example.com", "add", "2024-07-04", "spam"),
    ("thering.example.org", "add", "2024-12-01", "malware"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is a capture, fetched on a day of 2024 (and minute of it) that its id gives."""
    fetched = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 37, F.lit(366)) * 86400 + F.pmod(F.col("page_id"), F.lit(1440)) * 60)
    captures = table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at"))
    entries = spark.createDataFrame(URL_LIST, "domain string, action string, day string, category string").withColumn("listed_at", F.to_timestamp("day"))
    found = url_filter.evaluate(captures, entries)
    return found.select("page_id", "blocked", "matched_domain", "matched_category")


OP4_SQL = """
WITH entries(domain, action, day, category) AS (VALUES {values}),
changes AS (
  SELECT domain, category, on_list, CAST(day AS TIMESTAMP) AS since, LAG(on_list, 1, 0) OVER w AS before
  FROM (SELECT DISTINCT domain, category, day, CASE action WHEN 'add' THEN 1 ELSE 0 END AS on_list FROM entries)
  WINDOW w AS (PARTITION BY domain, category ORDER BY day, on_list)),
valid AS (
  SELECT * FROM (
    SELECT domain, category, on_list, since AS valid_from, LEAD(since) OVER (PARTITION BY domain, category ORDER BY since, on_list) AS valid_to
    FROM changes WHERE on_list <> before)
  WHERE on_list = 1),
captures AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*)', 1)) AS host,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds((page_id * 37) % 366 * 86400 + page_id % 1440 * 60) AS t
  FROM pages),
hits AS (
  SELECT c.page_id, v.domain, v.category,
         ROW_NUMBER() OVER (PARTITION BY c.page_id ORDER BY length(v.domain) DESC, v.category) AS n
  FROM captures c JOIN valid v
    ON (c.host = v.domain OR ends_with(c.host, '.' || v.domain)) AND v.valid_from <= c.t AND (v.valid_to IS NULL OR c.t < v.valid_to))
SELECT c.page_id, h.page_id IS NOT NULL AS blocked, h.domain AS matched_domain, h.category AS matched_category
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND h.n = 1
""".format(values=", ".join("('%s', '%s', '%s', '%s')" % row for row in URL_LIST))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs.where(remainder("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, machine)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(50)) == 0, k=5)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored) WHERE n <= 5
"""


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = vocabulary(BYTE_BPE)
    return byte_bpe.digests(byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)


OP7_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS window_text
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, window_text) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM again) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(len(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) AS n_ellipsis,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[ \t]*[-*•‣●]'))) AS n_bullets,
         len(regexp_replace(text, '[^\p{L}\p{M}]+', '', 'g')) AS n_letters
  FROM w LEFT JOIN repeated r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 2 * n_dup_lines > n_lines OR 10 * n_ellipsis > 5 * n_lines OR 10 * n_bullets > 9 * n_lines
            OR 10 * n_letters < 4 * word_chars) AS kept
FROM b
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_simhash": op2_simhash,
    "op3_token_files": op3_token_files,
    "op4_url_filter": op4_url_filter,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_topk": op9_topk,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {"op4_url_filter": OP4_SQL, "op7_quality": OP7_SQL, "op9_topk": OP9_SQL}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
