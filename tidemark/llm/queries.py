"""The registered queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.ann_codes import nearest
from tidemark.llm.best_fit_packing import pack_documents
from tidemark.llm.chat_format import CONVERSATION_TOOLS, conversation_calls, link_tool_calls
from tidemark.llm.html_text import extract_text
from tidemark.llm.importance import resample
from tidemark.llm.jaccard_join import ngram_jaccard_components
from tidemark.llm.mixing import mix_to_targets
from tidemark.llm.pitman_yor import score_texts
from tidemark.llm.quality_classifier import fit_quality_classifier, score_quality
from tidemark.llm.quality_rules import STOP_WORDS, apply_quality_rules
from tidemark.llm.ranked_search import ranked_documents
from tidemark.llm.segment_search import top_k
from tidemark.llm.storage import new_path, ship
from tidemark.llm.warc import payload_table, read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(column: str, divisor: int) -> Column:
    """crc32 of a number written as text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text")


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(*conversation_calls(_table(spark, sf_dir, "conversations")), CONVERSATION_TOOLS)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    rates = mix_to_targets(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), domain, {"clean": 0.94, "poor": 0.04, "toxic": 0.02})
    names = [F.col("posteriors")[k].alias(f"p_{name}") for k, name in enumerate(("clean", "poor", "toxic"))]
    return rates.select("doc_id", "n_tokens", *names, "rate", "copies", "remaining_miss")


def op4_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).drop("n_reranked")


def op5_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    forest = fit_quality_classifier(docs, labels.where(_remainder("doc_id", 3) != 1))
    scored = score_quality(docs.select("doc_id", "text"), forest)
    return scored.select("doc_id", (_remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(_table(spark, sf_dir, "documents"), _remainder("doc_id", 7) != 2)
    return scored.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(payload_table(_table(spark, sf_dir, "pages")), path)
    records = read_warc(spark, path, payloads=False).where("record_type <> 'gap'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def warc_salvage_drill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive in which every tenth page's record is damaged, read back: which pages come out of it."""
    path = new_path(spark, "drill")
    write_warc(payload_table(_table(spark, sf_dir, "pages")), path, damaged=F.col("page_id") % 10 == 3)
    found = read_warc(spark, path, payloads=False)
    # Damaged records that follow each other are one gap, and how they follow depends on partitions: gaps are counted in the tests.
    kinds = found.where("record_type <> 'gap'").groupBy(F.lit("record").alias("kind"))
    return kinds.agg(F.count("*").alias("rows"), F.sum("page_id").alias("page_ids"), F.count_if(F.col("page_id") % 10 == 3).alias("damaged_read"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP8_SQL = rf"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) >= 3),
twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM twice WHERE n >= 2) GROUP BY doc_id),
base AS (
  SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({', '.join(f"'{x}'" for x in STOP_WORDS)}))) AS n_stop
  FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words
       AND word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 18.0
       AND n_symbols / greatest(word_chars, 1) <= 0.06
       AND n_stop / greatest(n_words, 1) >= 0.01
       AND n_dup_lines / greatest(n_lines, 1) <= 0.5
       AND n_words / greatest(n_lines, 1) >= 1.5
       AND n_repeat_words / greatest(n_words, 1) <= 0.5 AS kept
FROM base
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_source_mixing": op2_source_mixing,
    "op3_tool_calls": op3_tool_calls,
    "op4_rotated_codes": op4_rotated_codes,
    "op5_quality_trees": op5_quality_trees,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_pitman_yor": op7_pitman_yor,
    "op8_quality_rules": op8_quality_rules,
    "op9_warc_salvage": op9_warc_salvage,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_segment_search": op12_segment_search,
    "op13_ranked_search": op13_ranked_search,
    "warc_salvage_drill": warc_salvage_drill,
}

OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
         CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
  FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND least IS NOT NULL AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM g
"""

OP4_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20
"""

DRILL_SQL = """
SELECT 'record' AS kind, count(*) AS rows, CAST(sum(page_id) AS BIGINT) AS page_ids, CAST(0 AS BIGINT) AS damaged_read FROM pages WHERE page_id % 10 <> 3
"""

OP10_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)),
sets AS (SELECT r, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS node FROM sh GROUP BY r),
one AS (SELECT node, min(n) AS n, min(r) AS r FROM sets GROUP BY node),
ns AS (SELECT node, n, s FROM one JOIN sh ON one.r = sh.r),
p AS (
  SELECT a.node AS a, b.node AS b, count(*) AS c, min(a.n) + min(b.n) AS both FROM ns AS a JOIN ns AS b
  ON a.s = b.s AND a.node < b.node AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (min(a.n) + min(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT node AS a, node AS b FROM one UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
named AS (SELECT reach.a AS node, min(t.doc_id) AS component_id FROM reach JOIN sets ON reach.b = sets.node JOIN t ON sets.r = t.r GROUP BY 1)
SELECT t.doc_id, CAST(coalesce(sets.n, 0) AS BIGINT) AS n_shingles, CASE WHEN sets.n IS NULL THEN t.doc_id ELSE component_id END AS component_id
FROM t LEFT JOIN sets ON t.r = sets.r LEFT JOIN named ON sets.node = named.node
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 byte by byte: all features take their first byte, then their second, and so on.
OP11_SQL = rf"""
WITH RECURSIVE
tab AS (
  SELECT n, list_reduce(list_prepend(CAST(n AS BIGINT), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
  FROM range(256) AS r(n)),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT -row_number() OVER (), NULL, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
features AS (
  SELECT r, unnest(w) AS f FROM texts
  UNION ALL
  SELECT r, w[i] || ' ' || w[i + 1] FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM texts WHERE len(w) > 1)),
bytes AS (SELECT f, hex(encode(f)) AS x, octet_length(encode(f)) AS n FROM (SELECT DISTINCT f FROM features)),
crc AS (
  SELECT f, x, n, 0 AS j, CAST(4294967295 AS BIGINT) AS c FROM bytes
  UNION ALL
  SELECT f, x, crc.n, j + 1, xor(tab.v, c >> 8) FROM crc
  JOIN tab ON tab.n = xor(c, CAST('0x' || substr(x, 2 * j + 1, 2) AS BIGINT)) & 255 WHERE j < crc.n),
bucket AS (SELECT f, xor(c, 4294967295) % 10000 AS b FROM crc WHERE j = n),
placed AS (SELECT r, b FROM features JOIN bucket USING (f)),
counts AS (SELECT b, count(*) FILTER (r > 0) AS s, count(*) FILTER (r < 0) AS t FROM placed GROUP BY b),
gains AS (SELECT b, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000) / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000)))) AS BIGINT) AS g FROM counts),
means AS (SELECT r, CAST(count(*) AS BIGINT) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM placed JOIN gains USING (b) WHERE r > 0 GROUP BY r),
scored AS (
  SELECT texts.r, doc_id, len(w) >= 20 AS fit, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM texts LEFT JOIN means ON texts.r = means.r WHERE texts.r > 0),
noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST, r) AS place, count(*) OVER (PARTITION BY fit) AS among FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 25 * among // 100 THEN place END AS rank FROM ranked
"""

OP12_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.vec_id AS vec_id, c.r AS r, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, r) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""

OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
totals AS (SELECT CAST(count(*) AS BIGINT) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM d WHERE len(w) > 0),
items AS (
  SELECT DISTINCT i, item_id, unnest(w) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark)),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM items) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM tf, totals GROUP BY term, N),
impacts AS (
  SELECT tf.r, d.doc_id, tf.term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(w) * N) // L))) AS impact
  FROM tf JOIN d ON tf.r = d.r JOIN weights ON tf.term = weights.term, totals),
scores AS (
  SELECT i, item_id, r, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM items JOIN impacts ON items.term = impacts.term GROUP BY i, item_id, r, doc_id HAVING sum(impact) > 0),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank FROM scores)
SELECT item_id, rank, doc_id, score FROM t WHERE rank <= 50
"""

ORACLE_SQL: dict[str, str] = {"op4_rotated_codes": OP4_SQL, "op8_quality_rules": OP8_SQL, "op9_warc_salvage": OP9_SQL, "op10_ngram_jaccard": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op12_segment_search": OP12_SQL, "op13_ranked_search": OP13_SQL, "warc_salvage_drill": DRILL_SQL}
