"""The queries of this subpackage over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, lm_score, media, mixing, ngram_join, packing, prefix_forest, quality, suffix_dedup, url_filter
from .common import table

#: A conversation whose texts try to close their turn.
CONTROL_ROWS = """
SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text
UNION ALL SELECT -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'"""


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.search(table(spark, sf_dir, "embeddings"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.turn_rows(table(spark, sf_dir, "conversations"))
    rows = rows.unionByName(spark.sql(CONTROL_ROWS))
    return chat_format.digest(chat_format.format_turns(rows))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.store(table(spark, sf_dir, "documents")))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lm_score.score(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("log_score", "mean_log_score", "seen_share")])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": OP3_SQL, "op4_ngram_join": OP4_SQL, "op6_lm_scoring": OP6_SQL, "op7_mixing": OP7_SQL}


_ESCAPED = r"replace(replace(replace(replace(replace({}, '\', '\\'), '<s>', '\0'), '</s>', '\1'), '[INST]', '\2'), '[/INST]', '\3')"
OP3_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<s>[INST] ' || {_ESCAPED.format('role')} || ' [/INST]' || chr(10) || {_ESCAPED.format('text')} || '</s>'))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

# Every block's quotient stands in a row of its own here; the highest are kept.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(doc_id::VARCHAR || ':7') AS pick FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs,
             row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(no - 1) % 3 + 1]::DOUBLE AS weight FROM s),
f AS (SELECT *, 3 * source_size / weight AS full_at FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY full_at, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY full_at, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM f),
g AS (SELECT *, least(3.0 * source_size, weight * (SELECT arg_min(level, full_at) FROM l WHERE level <= full_at))::DOUBLE AS target,
        (SELECT sum(source_size) // 16 FROM w)::BIGINT AS seats FROM l),
q AS (SELECT no, unnest(range(0, (target / 16 + 2)::BIGINT)) AS k, target, seats FROM g),
q2 AS (SELECT no, count(*) AS blocks FROM (SELECT no FROM q QUALIFY row_number() OVER (ORDER BY target / (2 * k + 1) DESC, no) <= seats) GROUP BY no),
x AS (SELECT d.*, g.no, source_size, target, coalesce(blocks, 0) AS blocks,
        ('0x' || pick[1:8])::BIGINT % ceil(docs / 1024)::BIGINT AS shard
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN q2 ON q2.no = g.no),
h AS (SELECT no, shard, blocks, sum(size)::DOUBLE AS shard_size FROM x GROUP BY ALL),
r AS (SELECT *, unnest(range(0, (blocks * shard_size / sum(shard_size) OVER (PARTITION BY no) + 2)::BIGINT)) AS k FROM h),
r2 AS (SELECT no, shard, count(*) * 16 AS quota FROM (SELECT no, shard FROM r QUALIFY row_number() OVER (PARTITION BY no ORDER BY shard_size / (2 * k + 1) DESC, shard) <= blocks) GROUP BY ALL),
y AS (SELECT x.*, coalesce(quota, 0)::BIGINT AS quota, shard_size::BIGINT AS shard_size,
        coalesce(sum(size) OVER (PARTITION BY x.no, x.shard ORDER BY pick, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM x JOIN h ON h.no = x.no AND h.shard = x.shard LEFT JOIN r2 ON r2.no = x.no AND r2.shard = x.shard)
SELECT doc_id, size, source_size, target,
  least(3 * size, (quota // shard_size) * size + greatest(0, least(size, quota - (quota // shard_size) * shard_size - before)))::BIGINT AS taken
FROM y"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] AS w1, w[i - 1] AS w2, w[i - 2] AS w3 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c1 AS (SELECT w1, count(*) AS n FROM g GROUP BY w1),
c2 AS (SELECT w2, w1, count(*) AS n FROM g WHERE i >= 2 GROUP BY w2, w1),
c3 AS (SELECT w3, w2, w1, count(*) AS n FROM g WHERE i >= 3 GROUP BY w3, w2, w1),
s AS (
  SELECT doc_id, i >= 3 AND c3.n >= 2 AS seen, CASE
      WHEN i >= 3 AND c3.n >= 2 THEN c3.n / h2.n
      WHEN i >= 2 AND c2.n >= 2 THEN (CASE WHEN i >= 3 THEN 0.4 ELSE 1 END)::DOUBLE * c2.n / h1.n
      ELSE (CASE WHEN i >= 3 THEN 0.4 * 0.4 WHEN i = 2 THEN 0.4 ELSE 1 END)::DOUBLE * c1.n / (SELECT count(*) FROM g) END AS p
  FROM g JOIN c1 USING (w1) LEFT JOIN c2 USING (w2, w1) LEFT JOIN c3 USING (w3, w2, w1)
    LEFT JOIN c1 AS h1 ON h1.w1 = g.w2 LEFT JOIN c2 AS h2 ON h2.w2 = g.w3 AND h2.w1 = g.w2)
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words, round(coalesce(sum(ln(p)), 0), 6) AS log_score,
  round(avg(ln(p)), 6) AS mean_log_score, round(avg(seen::INT), 6) AS seen_share
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""

OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id"""
