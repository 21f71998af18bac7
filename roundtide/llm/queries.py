"""Registered queries of the operators, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundtide.llm import alignment, article, decontaminate, linededup, media, mixing, neardup, ngramjoin, pii, secrets, spelling, toxicity, warc
from roundtide.llm.common import work_path

WORDS_SQL = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWER_AZ = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TRIMMED = LOWER_AZ.format(text=r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_odd_sketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


OP2_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS_SQL.format(text=LOWER_AZ.format(text="coalesce(text, '')"))} AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) = 0 THEN []
    WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s
  FROM w
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * m >= 80 * (p.n + q.n - m)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x
), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN least ON least.x = d.doc_id
"""


def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.as_media(table(spark, sf_dir, "documents"))).drop("error")


def op5_recursive_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.extract(table(spark, sf_dir, "pages"))


def op7_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


#: Wanted shares of the tokens by what ``labels`` says of a document.
MIX_TARGETS = {"good": 0.73, "plain": 0.25, "toxic": 0.02}


def labelled_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic where labelled so, else good or plain by the quality label."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain")
    return labels.select("doc_id", domain.alias("domain"))


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, labelled_domains(table(spark, sf_dir, "labels")), MIX_TARGETS)


def op9_bloom_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = linededup.dedup_lines(docs, min_length=40, min_docs=5, counts=("n_lines", "n_dropped"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return done.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


OP9_SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), k AS (
  SELECT *, {TRIMMED} AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT doc_id, i, line, coalesce(keeper <> doc_id, false) AS gone FROM k LEFT JOIN r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_warc(spark, path))


BASE32_SQL = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
  (CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS BIGINT), 1)), '')"""

OP10_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), g AS (SELECT h, max(page_id) AS m FROM p GROUP BY h)
SELECT page_id, payload_bytes, {BASE32_SQL} AS payload_digest,
       CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> m THEN m END AS refers_to
FROM p JOIN g USING (h)
"""


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.typed_words(table(spark, sf_dir, "documents"), min_length=7, min_count=2, every=31)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 by its table of 256 entries, itself made by the polynomial's eight steps a byte.
OP11_SQL = rf"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, i AS v, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(v ORDER BY byte) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all({LOWER_AZ.format(text="coalesce(text, '')")}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents
  ) WHERE length(run) >= 7 GROUP BY ALL
), bytes AS (
  SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 1 + 2 * i, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h
  FROM bytes, crc
), typed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), less AS (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word AS u, b.word AS v FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT word, rest FROM less WHERE rest IN (SELECT word FROM words)
  UNION
  SELECT rest, word FROM less WHERE rest IN (SELECT word FROM words)
), near AS (
  SELECT u AS word, count(*) AS n_near, min({{'k': -w.n, 'w': v}}) AS best FROM pairs JOIN words w ON w.word = v GROUP BY u
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.k >= 10 * n THEN best.w END AS form,
         CASE WHEN -best.k >= 10 * n THEN -best.k END AS form_n
  FROM words LEFT JOIN near USING (word)
), chain AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL
  SELECT chain.word, chain.next, formed.form FROM chain JOIN formed ON formed.word = chain.next
)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN chain ON chain.word = formed.word AND chain.next IS NULL
"""

#: Where the vocabulary files are.
TOKENIZERS = "/opt/tokenizers"


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.align_documents(docs, f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.linked_documents(table(spark, sf_dir, "documents"), width=3, percent=90)


def components_sql(width: int, percent: int, chosen: str) -> str:
    """Documents linked by the Jaccard similarity of their word shingles, by a self-join on shingles."""
    shingles = " || ' ' || ".join(f"ws[i + {k}]" for k in range(width))
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS_SQL.format(text=LOWER_AZ.format(text="coalesce(text, '')"))} AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) = 0 THEN []
    WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {width - 2}), lambda i: {shingles}) END) AS s
  FROM w
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * m >= {percent} * (p.n + q.n - m)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x
), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT {chosen}
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN least ON least.x = d.doc_id
"""


OP13_SQL = components_sql(3, 90, "d.doc_id, coalesce(n, 0) AS n_shingles, component_id")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_noisy_or": op1_toxicity_noisy_or,
    "op2_odd_sketch_neardup": op2_odd_sketch_neardup,
    "op3_spaced_seed_decontamination": op3_spaced_seed_decontamination,
    "op4_png_media": op4_png_media,
    "op5_recursive_secret_scan": op5_recursive_secret_scan,
    "op6_main_text": op6_main_text,
    "op7_weak_supervision_pii": op7_weak_supervision_pii,
    "op8_soft_mixing": op8_soft_mixing,
    "op9_bloom_line_dedup": op9_bloom_line_dedup,
    "op10_warc_archives": op10_warc_archives,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_ngram_jaccard": op13_ngram_jaccard,
}
ORACLES: dict[str, str] = {
    "op2_odd_sketch_neardup": OP2_SQL,
    "op9_bloom_line_dedup": OP9_SQL,
    "op10_warc_archives": OP10_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op13_ngram_jaccard": OP13_SQL,
}
