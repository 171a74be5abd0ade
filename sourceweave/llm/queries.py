"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave.llm import chat, decontam, exact, langid, maintext, merkle, packing, quality, sharding, simhash, tokens, warc, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_read(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.parse(_read(spark, sf_dir, "conversations"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_overlap(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), decontam.items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.decisions(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_read(spark, sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_read(spark, sf_dir, "documents"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(_read(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_token_counts, op3_chat, op4_simhash, op5_decontamination, op6_exact_dedup, op7_warc, op8_language, op9_shards, op10_packing, op11_whitening, op12_merkle, op13_main_text)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP5 = rf"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
  SELECT doc_id, w, s, k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM docs) CROSS JOIN (SELECT DISTINCT k FROM windows) WHERE s + k - 1 <= len(w)
), hits AS (
  SELECT p.doc_id, p.s, p.k, x.item_id FROM (SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') AS win FROM places) p JOIN windows x ON x.k = p.k AND x.win = p.win
), covered AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS spot FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d WINDOW same AS (PARTITION BY text_sha256)
"""

_OP7 = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first_id, row_number() OVER (PARTITION BY h ORDER BY page_id) AS nth FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN first_id END AS refers_to
FROM f
"""


# crc32 byte by byte over a table of its 256 remainders; rows of equal doc_ids are ordered by size and crc
_OP9 = """
WITH remainders AS (SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, k) ORDER BY k) AS t FROM range(256) r(k)),
hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b FROM hexed),
sized AS (SELECT doc_id, CAST(len(b) + 1 AS BIGINT) AS size, CAST(xor(list_reduce(b, lambda a, x: xor(a >> 8, t[CAST(xor(a, x) & 255 AS INTEGER) + 1]), 4294967295), 4294967295) AS BIGINT) AS text_crc32 FROM bytes, remainders),
placed AS (SELECT *, CAST((2 * sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size) * 16 // (2 * sum(size) OVER ()) AS INTEGER) AS shard FROM sized)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed
"""


# nodes by levels; a proof and a fold climb from a leaf to its language's root (m = 1), go on as leaf of the last tree (-1), and end at its root;
# crc32 of the identifier's digits as in op9
_OP12 = """
WITH RECURSIVE remainders AS (SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, k) ORDER BY k) AS t FROM range(256) r(k)),
d AS (
  SELECT row_number() OVER () AS rid, *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    xor(list_reduce([ascii(c) for c in string_split(coalesce(doc_id::VARCHAR, ''), '') if c <> ''], lambda a, x: xor(a >> 8, t[CAST(xor(a, x) & 255 AS INTEGER) + 1]), 4294967295), 4294967295) % 3 = 0 AS tampers
  FROM documents, remainders
),
leaves AS (SELECT rid, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN tampers THEN sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) END AS bad FROM d),
placed AS MATERIALIZED (
  SELECT rid, doc_id, leaf, coalesce(bad, leaf) AS bad, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, count(*) OVER (PARTITION BY lang) AS m
  FROM leaves
),
low(tree, level, spot, m, h) AS (
  SELECT tree, 0, spot, m, leaf FROM placed
  UNION ALL SELECT tree, level + 1, spot // 8, (m + 7) // 8, sha256(string_agg(h, '' ORDER BY spot)) FROM low WHERE m > 1 GROUP BY tree, level, spot // 8, m
),
subroots AS (SELECT tree, h, count(*) OVER () AS m FROM low WHERE m = 1),
top(level, spot, m, h) AS (
  SELECT 0, tree, m, h FROM subroots
  UNION ALL SELECT level + 1, spot // 8, (m + 7) // 8, sha256(string_agg(h, '' ORDER BY spot)) FROM top WHERE m > 1 GROUP BY level, spot // 8, m
),
nodes AS MATERIALIZED (SELECT tree, level, spot, h FROM low UNION ALL SELECT -1, level, spot, h FROM top),
climb(rid, tree, level, spot, m, node, proof) AS (
  SELECT rid, tree, 0, spot, m, bad, '' FROM placed
  UNION ALL (
    SELECT c.rid, c.tree, c.level + 1, c.spot // 8, (c.m + 7) // 8, sha256(string_agg(CASE WHEN s.spot = c.spot THEN c.node ELSE s.h END, '' ORDER BY s.spot)), c.proof || coalesce(string_agg(s.h, '' ORDER BY s.spot) FILTER (s.spot <> c.spot), '')
    FROM climb c JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.spot // 8 = c.spot // 8 WHERE c.m > 1 GROUP BY c.rid, c.tree, c.level, c.spot, c.m, c.proof
    UNION ALL SELECT c.rid, -1, 0, c.tree, r.m, c.node, c.proof FROM climb c JOIN subroots r ON r.tree = c.tree WHERE c.m = 1
  )
)
SELECT p.doc_id, p.leaf, r.h AS subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.node AS folded_root, c.node = t.h AS verified
FROM placed p JOIN subroots r USING (tree) JOIN climb c ON c.rid = p.rid AND c.tree = -1 AND c.m = 1 CROSS JOIN (SELECT h FROM top WHERE m = 1) t
"""


# these pages mark their article, which the cut has to find without trusting the mark alone; the references in it are those of the data
_OP13 = r"""
WITH blocks AS (
  SELECT page_id, url, unnest(string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>')) AS block, generate_subscripts(string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>'), 1) AS nth
  FROM pages
), plain AS (
  SELECT page_id, url, nth, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(block, '<br>', ' '), '</?b>', '', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS block FROM blocks
), texts AS (SELECT page_id, url, coalesce(string_agg(block, chr(10) ORDER BY nth) FILTER (block <> ''), '') AS text FROM plain GROUP BY page_id, url)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": _OP5, "op6_exact_dedup": _OP6, "op7_warc": _OP7, "op9_shards": _OP9, "op12_merkle": _OP12, "op13_main_text": _OP13}
