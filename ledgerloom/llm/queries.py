"""One registered query per operator, with DuckDB text where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann, chunk_encoding, embedding_dedup, html_extract, line_dedup, mixing, ngram_join, packing, ranked_search, sharding, substring_dedup, toxicity,
    whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), k=4, percent=85)


OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWERED)} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM t x JOIN t y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 85 * (x.n + y.n - o)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, least(n.doc_id, min(r.b)) AS component_id
FROM n LEFT JOIN reach r ON n.doc_id = r.a GROUP BY n.doc_id, n.n
"""


def op3_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=8)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, coalesce(f.last <> k.doc_id, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_weighted_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), repeats=3, keep=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


OP9_SQL = r"""
WITH q AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         coalesce('=' || source, '') AS src, coalesce(md5(text), '') AS tie,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS h FROM documents),
s AS (SELECT src, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS s FROM q GROUP BY src),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
p AS (
  SELECT *, row_number() OVER o AS i,
    sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY s / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY s / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z
  FROM w WINDOW o AS (ORDER BY s / w, src)),
c AS (SELECT i, CAST(l AS DOUBLE) / z AS level FROM p WHERE 3 * s * z >= w * l ORDER BY i LIMIT 1),
t AS (SELECT src, s, CASE WHEN p.i < c.i THEN 3.0::DOUBLE * s ELSE least(3.0::DOUBLE * s, w * level) END AS t FROM p, c),
r AS (SELECT q.*, s, t, sum(size) OVER (PARTITION BY q.src ORDER BY h, doc_id NULLS FIRST, size, tie ROWS UNBOUNDED PRECEDING) AS sent
      FROM q JOIN t ON q.src = t.src),
e AS (SELECT *, CAST(2 * (sent + copy * s) - size AS DOUBLE) / (2 * t) AS time
      FROM r, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0 AND t > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY time, src, h, doc_id NULLS FIRST, size, tie, copy ROWS UNBOUNDED PRECEDING) AS upto FROM e),
k AS (SELECT src, h, doc_id, size, tie, sent, count(*) AS n FROM g WHERE upto <= (SELECT sum(size) FROM q) GROUP BY ALL)
SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, r.s AS source_size, r.t AS target, CAST(coalesce(k.n, 0) * r.size AS BIGINT) AS taken
FROM r LEFT JOIN k ON r.src = k.src AND r.h = k.h AND r.sent = k.sent AND r.size = k.size AND r.tie = k.tie
  AND r.doc_id IS NOT DISTINCT FROM k.doc_id
"""

def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"), min_words=50, percent=80)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id,
       vec_id <= coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a
"""


def op6_cross_polytope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_chunk_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk_encoding.encode_documents(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_pipelined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


OP13_SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS d,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT DISTINCT item_id, unnest(
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS l FROM dw WHERE len(w) > 0),
p AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM dw) GROUP BY ALL),
t AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM p, c WHERE term IN (SELECT term FROM iw) GROUP BY term, n_docs),
m AS (SELECT d, doc_id, CAST(100 - 90 + (90 * len(w) * n_docs) // l AS BIGINT) AS m FROM dw, c WHERE len(w) > 0),
s AS (SELECT item_id, doc_id, d, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM iw JOIN t USING (term) JOIN p USING (term) JOIN m USING (d) WHERE doc_id IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_weighted_hash_tree": op3_weighted_hash_tree,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_counterfactual_toxicity": op5_counterfactual_toxicity,
    "op6_cross_polytope_search": op6_cross_polytope_search,
    "op7_line_dedup": op7_line_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_weighted_fair_queueing": op9_weighted_fair_queueing,
    "op10_html_extraction": op10_html_extraction,
    "op11_feast_whitening": op11_feast_whitening,
    "op12_chunk_encoding": op12_chunk_encoding,
    "op13_pipelined_search": op13_pipelined_search,
}
ORACLE = {
    "op2_embedding_near_dedup": OP2_SQL,
    "op4_ngram_jaccard_join": OP4_SQL,
    "op7_line_dedup": OP7_SQL,
    "op9_weighted_fair_queueing": OP9_SQL,
    "op13_pipelined_search": OP13_SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
