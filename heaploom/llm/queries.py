"""The queries opN_<name>: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, licenses, near_dup, passages, pii, search, sharding, toxicity, url_filter, vectors, warc
from .common import table


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 0.95)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.decode(bpe.encode(docs)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), v AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)
), l AS (SELECT DISTINCT n FROM v),
p AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, l WHERE len(w) >= n)
), h AS (SELECT p.r, p.s, p.n, v.item_id FROM p JOIN v ON p.n = v.n AND p.t = v.t),
c AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS pos FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).drop("spans")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_by_bytes(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: The checksum in SQL takes each byte in two steps of four bits.
OP5_SQL = """
WITH RECURSIVE bits AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM generate_series(0, 15) AS t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 4
), d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes,
    (SELECT list(c ORDER BY i) FROM bits WHERE k = 4) AS step
  FROM documents
), r AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
      lambda c, b: xor(xor(xor(c, b) >> 4, step[(xor(c, b) & 15) + 1]) >> 4, step[(xor(xor(c, b) >> 4, step[(xor(c, b) & 15) + 1]) & 15) + 1])), 4294967295) AS text_crc32
  FROM d
), o AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS place FROM r
), s AS (
  SELECT *, least(23, ((2 * upto - size) * 24) // (2 * total)) AS shard FROM o
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs).select("doc_id", "cluster_id", "kept")


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score_toxicity(docs, model)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def listed(column: F.Column) -> F.Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def rank(span: F.Column) -> F.Column:
        return F.struct(F.array_position(F.lit(list(pii.KINDS)), span["kind"]), span["start"], span["end"], span["kind"].alias("kind"))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.BASE_KINDS]
    everything = F.array_sort(F.transform(F.concat("base", "added"), rank))
    return pii.find_pii(docs).select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(everything).alias("spans"), F.size(everything).cast("long").alias("n_spans"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""



def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.ranked_search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=50)


OP11_SQL = r"""
WITH t AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT row_number() OVER () AS r, * FROM documents)
), f AS (SELECT r, doc_id, w, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY r), s AS (SELECT count(*) AS rows, CAST(sum(n) AS BIGINT) AS len FROM d),
m AS (SELECT r, 100 - 50 + (50 * n * rows) // len AS m FROM d, s),
g AS (SELECT w, CAST(floor(1000 * ln((2 * any_value(rows) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, s GROUP BY w),
q AS (
  SELECT DISTINCT k, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT row_number() OVER () AS k, * FROM benchmark)
), x AS (
  SELECT k, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN f USING (w) JOIN g USING (w) JOIN m USING (r) GROUP BY ALL
), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 50
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 30
), c AS (SELECT * FROM g WHERE k > 1),
u AS (
  SELECT lang, k, phrase, a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS x, array_to_string(string_split(phrase, ' ')[j + 1:k], ' ') AS y
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c)
), v AS (
  SELECT u.lang, u.phrase, u.a, u.j, l.a AS l, r.a AS r, CAST((CAST(2000000 AS HUGEINT) * u.a) // (l.a + r.a) AS BIGINT) AS score
  FROM u JOIN g l ON l.lang = u.lang AND l.phrase = u.x JOIN g r ON r.lang = u.lang AND r.phrase = u.y
), b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS best FROM v),
e AS (
  SELECT c.lang, array_to_string(string_split(c.phrase, ' ')[i:i + z - 1], ' ') AS phrase, max(c.a) AS longer
  FROM c, (SELECT unnest([2, 3]) AS z), (SELECT unnest([1, 2, 3]) AS i) WHERE z < c.k AND i + z - 1 <= c.k GROUP BY ALL
), o AS (
  SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b LEFT JOIN e USING (lang, phrase) WHERE best = 1 AND (longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000
"""


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.RULES, id_col="page_id").select("page_id", "host", "path", "rule", "verdict", "template", "purity")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embeddings": op1_embeddings,
    "op2_bpe": op2_bpe,
    "op3_decontaminate": op3_decontaminate,
    "op4_licenses": op4_licenses,
    "op5_sharding": op5_sharding,
    "op6_minhash": op6_minhash,
    "op7_passages": op7_passages,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_warc": op10_warc,
    "op11_search": op11_search,
    "op12_collocations": op12_collocations,
    "op13_url_filter": op13_url_filter,
}
ORACLE_SQL: dict[str, str] = {"op3_decontaminate": OP3_SQL, "op5_sharding": OP5_SQL, "op10_warc": OP10_SQL, "op11_search": OP11_SQL, "op12_collocations": OP12_SQL}
