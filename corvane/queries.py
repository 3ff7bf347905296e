"""The engine's queries over the driver's tables, and the same in SQL.

A document is a chunk: its language is the memory type, its labels give the importance, the last
event of the user of its number the last access, and the embedding of its number the vector.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import scoring
from corvane.functions.text import body, chunked, content_hash, frontmatter, parse_meta, tokens
from corvane.operators import bm25
from corvane.operators.diff import changes
from corvane.operators.fusion import reciprocal_rank_fusion
from corvane.operators.knn import knn, knn_batch, knn_filtered
from corvane.plans.search import HybridSearch, SearchMode
from corvane.store_queries import PARAGRAPHS, chunks_sql, index_of
from corvane.store_queries import QUERIES as STORE_QUERIES
from corvane.store_queries import SQL as STORE_SQL

AS_OF = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
QUERY = "estion ndat"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, events = (_table(spark, sf_dir, t) for t in ("documents", "labels", "events"))
    worth = F.when(F.max("toxic") == 1, 0.1).when(F.max("quality") == 1, 0.9).otherwise(0.3)
    worth = labels.groupBy(F.col("doc_id").alias("id")).agg(worth.alias("worth"))
    seen = events.groupBy(F.col("user_id").alias("id")).agg(F.max("ts").cast("timestamp").alias("last_accessed"), F.count("*").cast("int").alias("access_count"))
    out = docs.withColumnRenamed("doc_id", "id").join(worth, "id", "left").join(seen, "id", "left")
    return out.select(
        "id", F.concat("source", F.lit("/"), "id", F.lit(".md")).alias("file_path"), F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text"), F.coalesce("worth", F.lit(0.5)).alias("importance"),
        F.col("lang").alias("memory_type"), F.array("source").alias("tags"), "last_accessed", F.coalesce("access_count", F.lit(0)).alias("access_count"),
    )


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(_vectors(spark, sf_dir).filter("id = 0").first()["embedding"])


def _index(spark: SparkSession, sf_dir: str) -> bm25.TextIndex:
    """The stored text index; its ids are those of the documents and one more."""
    index = index_of(spark, sf_dir).text_index()
    of_doc = lambda rows: rows.withColumn("id", F.col("id") - 1)
    return bm25.TextIndex(of_doc(index.postings), of_doc(index.lengths), index.known)


def knn_cosine(spark, d):
    return knn(_vectors(spark, d), _query_vector(spark, d), 10).select("id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


def knn_filtered_overfetch(spark, d):
    rows = _vectors(spark, d).join(_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("memory_type")), "id")
    return knn_filtered(rows, _query_vector(spark, d), 10, F.col("memory_type") == "en").select("id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


def knn_all(spark, d):
    """Queries: the vectors whose id is divisible by 50."""
    v = _vectors(spark, d)
    return knn_batch(v, v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding")), 5).select("query_id", "id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


def hash_content(spark, d):
    return _table(spark, d, "documents").select("doc_id", content_hash(F.col("text")).alias("hash"))


def hash_dedup(spark, d):
    return _table(spark, d, "documents").groupBy(content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


def tokenize_counts(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.coalesce(F.size(tokens(F.col("text"))), F.lit(0)).cast("long").alias("n_tokens"))


def term_df(spark, d):
    return bm25.term_counts(_table(spark, d, "documents"), F.col("text"))


def _bm25(query: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: bm25.search(_index(spark, d), query, 20).select("id", F.round("bm25_score", 6).alias("bm25_score"), "rank")


def rrf_fusion(spark, d):
    near = knn(_vectors(spark, d), _query_vector(spark, d), 30).select(F.col("id").alias("doc_id"), F.lit(0).alias("list_id"), "rank")
    hits = bm25.search(_index(spark, d), QUERY, 30).select(F.col("id").alias("doc_id"), F.lit(1).alias("list_id"), "rank")
    return reciprocal_rank_fusion(near.unionByName(hits)).select("doc_id", F.round("rrf", 9).alias("rrf"), "fused_rank")


def _scored(mode: SearchMode, memory_type: str | None = None, min_score: float = 0.0) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        engine = HybridSearch(_chunks(spark, d), _vectors(spark, d), None if mode is SearchMode.VECTOR_ONLY else _index(spark, d))
        found = engine.search(QUERY, _query_vector(spark, d), 10, memory_type, min_score, mode, AS_OF)
        r = lambda c: F.round(c, 6).alias(c)
        return found.select("id", "file_path", "memory_type", r("semantic_score"), r("fts_score"), r("rrf_score"), "importance", r("temporal_decay"), r("hybrid_score"))

    return run


def temporal_decay(spark, d):
    return _chunks(spark, d).select("id", F.round(scoring.temporal_decay(F.col("last_accessed"), F.lit(AS_OF)), 9).alias("decay"))


def weight_redistribution(spark, d):
    rows = _chunks(spark, d).withColumn("decay", scoring.temporal_decay(F.col("last_accessed"), F.lit(AS_OF)))
    return rows.select("id", F.round(scoring.hybrid_score(F.lit(0.7), scoring.importance(F.col("importance")), F.col("decay")), 9).alias("score"))


def min_score_filter(spark, d):
    return weight_redistribution(spark, d).filter("score >= 0.6")


def chunk_documents(spark, d):
    """Chunks of all documents, lines taken for paragraphs."""
    text = F.regexp_replace("text", "\n", "\n\n")
    pieces = chunked(_table(spark, d, "documents"), "doc_id", text)
    return pieces.select("doc_id", "chunk_index", F.length("chunk_text").alias("n_chars"), content_hash(F.col("chunk_text")).alias("content_hash"))


def frontmatter_parse(spark, d):
    text = F.concat(F.lit("---\nimportance: 0.9\ntype: "), F.col("lang"), F.lit("\ntags: ["), F.col("source"), F.lit("]\n---\n"), F.col("text"))
    rows = _table(spark, d, "documents").select("doc_id", parse_meta(frontmatter(text)).alias("m"), content_hash(body(text)).alias("body_hash"))
    return rows.select("doc_id", "m.importance", "m.memory_type", F.array_join("m.tags", ",").alias("tags"), "body_hash")


def incremental_diff(spark, d):
    """From all but the German documents to all but the French ones, the Spanish in lower case."""
    docs = _table(spark, d, "documents")
    keyed = lambda rows, text: rows.select(F.col("source").alias("file_path"), F.col("doc_id").alias("chunk_index"), content_hash(text).alias("content_hash"))
    old = keyed(docs.filter("lang <> 'de'"), F.col("text"))
    new = keyed(docs.filter("lang <> 'fr'"), F.when(F.col("lang") == "es", F.lower("text")).otherwise(F.col("text")))
    return changes(old, new).select("file_path", "chunk_index", "action")


def index_stats(spark, d):
    return _chunks(spark, d).agg(F.count("*").alias("total_chunks"), F.count_distinct("file_path").alias("total_files"), F.sum("access_count").alias("accesses"), F.round(F.avg("importance"), 9).alias("mean_importance"))


def distinct_files(spark, d):
    return _chunks(spark, d).select("file_path").distinct()


def access_log_rollup(spark, d):
    return _table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("access_count"), F.max("ts").cast("string").alias("last_accessed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **STORE_QUERIES,
    "score_hybrid": _scored(SearchMode.HYBRID),
    "score_hybrid_typed": _scored(SearchMode.HYBRID, "en"),
    "score_fts_only": _scored(SearchMode.FTS_ONLY),
    "score_vector_only": _scored(SearchMode.VECTOR_ONLY),
    "knn_cosine": knn_cosine,
    "knn_filtered_overfetch": knn_filtered_overfetch,
    "knn_batch": knn_all,
    "content_hash": hash_content,
    "hash_dedup": hash_dedup,
    "tokenize_counts": tokenize_counts,
    "term_df": term_df,
    "bm25_search": _bm25("estion"),
    "bm25_idf_floor": _bm25("the estion"),
    "bm25_duplicate_terms": _bm25("ndat ndat"),
    "bm25_phrase": _bm25("of-the"),
    "rrf_fusion": rrf_fusion,
    "temporal_decay": temporal_decay,
    "weight_redistribution": weight_redistribution,
    "min_score_filter": min_score_filter,
    "chunk_documents": chunk_documents,
    "frontmatter_parse": frontmatter_parse,
    "incremental_diff": incremental_diff,
    "index_stats": index_stats,
    "distinct_files": distinct_files,
    "access_log_rollup": access_log_rollup,
}

# the same in SQL

_TOKENS = r"regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')"
_Q0 = "q0 AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_DIST = "dist AS (SELECT vec_id AS id, 1 - list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS distance FROM embeddings, q0)"
_CHUNKS = """worth AS (SELECT doc_id AS id, CASE WHEN max(toxic) = 1 THEN 0.1::DOUBLE WHEN max(quality) = 1 THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END AS worth FROM labels GROUP BY 1),
seen AS (SELECT user_id AS id, max(ts) AS last_accessed, count(*) AS access_count FROM events GROUP BY 1),
chunks AS (SELECT d.doc_id AS id, d.source || '/' || d.doc_id || '.md' AS file_path, d.lang AS memory_type, coalesce(w.worth, 0.5::DOUBLE) AS importance, coalesce(s.access_count, 0) AS access_count,
  CASE WHEN s.last_accessed IS NULL THEN 0.5::DOUBLE ELSE exp(-0.05::DOUBLE * greatest(0, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(s.last_accessed)) / 86400000000.0::DOUBLE) END AS decay
  FROM documents d LEFT JOIN worth w ON w.id = d.doc_id LEFT JOIN seen s ON s.id = d.doc_id)"""


def _hybrid(relevance: str) -> str:
    return (
        f"(0.6::DOUBLE + CASE WHEN importance = 0.5 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN decay = 0.5 THEN 0.2::DOUBLE ELSE 0 END) * {relevance}"
        " + CASE WHEN importance = 0.5 THEN 0 ELSE 0.2::DOUBLE END * importance + CASE WHEN decay = 0.5 THEN 0 ELSE 0.2::DOUBLE END * decay"
    )


def _hits(phrases: list[list[str]], k: int) -> str:
    rows = ", ".join(f"({i}, {len(p)}, {j}, '{t}')" for i, p in enumerate(phrases) for j, t in enumerate(p))
    return f"""toks AS (SELECT doc_id AS id, {_TOKENS} AS t FROM documents),
totals AS (SELECT count(*) AS n_rows, avg(coalesce(len(t), 0)) AS avgdl FROM toks),
words AS (SELECT id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM toks),
wanted(phrase, length, place, term) AS (VALUES {rows}),
starts AS (SELECT phrase, length, id, pos - place AS start FROM words JOIN wanted USING (term) GROUP BY ALL HAVING count(*) = length),
tfs AS (SELECT phrase, id, count(*) AS tf FROM starts GROUP BY ALL),
dfs AS (SELECT phrase, count(*) AS df FROM tfs GROUP BY ALL),
parts AS (SELECT tfs.id, CASE WHEN ln((n_rows - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n_rows - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END
  * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * coalesce(len(t), 0) / avgdl)) AS part
  FROM tfs JOIN dfs USING (phrase) JOIN toks USING (id), totals),
hits AS (SELECT id, sum(part) AS bm25_score, row_number() OVER (ORDER BY sum(part) DESC, id) AS rank FROM parts GROUP BY id QUALIFY rank <= {k})"""


def _bm25_sql(*phrases: list[str]) -> str:
    return f"WITH {_hits(list(phrases), 20)} SELECT id, round(bm25_score, 6) AS bm25_score, CAST(rank AS INTEGER) AS rank FROM hits"


_NEAR = "near AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS rank FROM dist QUALIFY rank <= 30)"
_TWO = [["estion"], ["ndat"]]
_OUT = "id, file_path, memory_type, round(semantic, 6) AS semantic_score, round(fts, 6) AS fts_score, round(rrf, 6) AS rrf_score, importance, round(decay, 6) AS temporal_decay, round(score, 6) AS hybrid_score"


def _hybrid_sql(kind: str | None) -> str:
    near, after = _NEAR, ""
    if kind:
        near = f"fetched AS (SELECT * FROM dist JOIN (SELECT doc_id AS id, lang FROM documents) USING (id) ORDER BY distance, id LIMIT 90), near AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS rank FROM fetched WHERE lang = '{kind}' QUALIFY rank <= 30)"
        after = f"WHERE memory_type = '{kind}'"
    return f"""WITH {_Q0}, {_DIST}, {_CHUNKS}, {near}, {_hits(_TWO, 30)},
normed AS (SELECT id, bm25_score / greatest(max(bm25_score) OVER (), 1e-9) AS fts, rank FROM hits),
lists AS (SELECT id, 0 AS l, rank, distance, NULL AS fts FROM near UNION ALL SELECT id, 1, rank, NULL, fts FROM normed),
fused AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS raw, max(distance) AS distance, coalesce(max(fts), 0) AS fts, min(l * 1000 + rank) AS first FROM lists GROUP BY id),
ranked AS (SELECT *, raw / greatest(max(raw) OVER (), 1e-9) AS rrf, row_number() OVER (ORDER BY raw DESC, first) AS place FROM fused),
typed AS (SELECT * FROM ranked JOIN chunks USING (id) {after} ORDER BY place LIMIT 10),
scored AS (SELECT *, CASE WHEN distance IS NULL THEN 0 ELSE greatest(0, least(1, 1 - distance)) END AS semantic, {_hybrid('rrf')} AS score FROM typed)
SELECT {_OUT} FROM scored"""


SQL: dict[str, str] = {
    **STORE_SQL,
    "chunk_documents": f"""WITH RECURSIVE docs AS (SELECT doc_id AS key, replace(text, E'\\n', E'\\n\\n') AS text FROM documents), {chunks_sql(PARAGRAPHS)}
SELECT key AS doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(length(chunk_text) AS INTEGER) AS n_chars, sha256(chunk_text) AS content_hash FROM pieces""",
    "score_hybrid": _hybrid_sql(None),
    "score_hybrid_typed": _hybrid_sql("en"),
    "score_fts_only": f"""WITH {_CHUNKS}, {_hits(_TWO, 30)},
normed AS (SELECT id, bm25_score / greatest(max(bm25_score) OVER (), 1e-9) AS fts, rank FROM hits),
scored AS (SELECT *, 0.0::DOUBLE AS semantic, 0.0::DOUBLE AS rrf, {_hybrid('fts')} AS score FROM normed JOIN chunks USING (id))
SELECT {_OUT} FROM scored ORDER BY score DESC, rank LIMIT 10""",
    "score_vector_only": f"""WITH {_Q0}, {_DIST}, {_CHUNKS}, {_NEAR},
sem AS (SELECT *, greatest(0, least(1, 1 - distance)) AS semantic, 0.0::DOUBLE AS fts, 0.0::DOUBLE AS rrf FROM near JOIN chunks USING (id)),
scored AS (SELECT *, {_hybrid('semantic')} AS score FROM sem)
SELECT {_OUT} FROM scored ORDER BY score DESC, rank LIMIT 10""",
    "knn_cosine": f"WITH {_Q0}, {_DIST} SELECT id, round(distance, 6) + 0.0 AS distance, CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS rank FROM dist QUALIFY rank <= 10",
    "knn_filtered_overfetch": f"WITH {_Q0}, {_DIST}, typed AS (SELECT * FROM dist JOIN (SELECT doc_id AS id, lang FROM documents) USING (id) ORDER BY distance, id LIMIT 30) SELECT id, round(distance, 6) + 0.0 AS distance, CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS rank FROM typed WHERE lang = 'en' QUALIFY rank <= 10",
    "knn_batch": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
d AS (SELECT b.id AS query_id, a.id, 1 - list_dot_product(a.e, b.e) / (a.n * b.n) AS distance FROM v a, v b WHERE b.id % 50 = 0)
SELECT query_id, id, round(distance, 6) + 0.0 AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM d QUALIFY rank <= 5""",
    "content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "hash_dedup": "SELECT sha256(text) AS hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1",
    "tokenize_counts": f"SELECT doc_id, coalesce(len({_TOKENS}), 0) AS n_tokens FROM documents",
    "term_df": f"WITH w AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM w GROUP BY term",
    "bm25_search": _bm25_sql(["estion"]),
    "bm25_idf_floor": _bm25_sql(["the"], ["estion"]),
    "bm25_duplicate_terms": _bm25_sql(["ndat"], ["ndat"]),
    "bm25_phrase": _bm25_sql(["of", "the"]),
    "rrf_fusion": f"""WITH {_Q0}, {_DIST}, {_NEAR}, {_hits(_TWO, 30)},
lists AS (SELECT id, 0 AS l, rank FROM near UNION ALL SELECT id, 1, rank FROM hits),
fused AS (SELECT id AS doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(l * 1000 + rank) AS first FROM lists GROUP BY id)
SELECT doc_id, round(rrf, 9) AS rrf, CAST(row_number() OVER (ORDER BY rrf DESC, first) AS INTEGER) AS fused_rank FROM fused""",
    "temporal_decay": f"WITH {_CHUNKS} SELECT id, round(decay, 9) AS decay FROM chunks",
    "weight_redistribution": f"WITH {_CHUNKS} SELECT id, round({_hybrid('0.7::DOUBLE')}, 9) AS score FROM chunks",
    "min_score_filter": f"WITH {_CHUNKS}, s AS (SELECT id, round({_hybrid('0.7::DOUBLE')}, 9) AS score FROM chunks) SELECT * FROM s WHERE score >= 0.6",
    "frontmatter_parse": "SELECT doc_id, 0.9::DOUBLE AS importance, lang AS memory_type, source AS tags, sha256(text) AS body_hash FROM documents",
    "incremental_diff": """WITH o AS (SELECT source, doc_id, sha256(text) AS h FROM documents WHERE lang <> 'de'),
n AS (SELECT source, doc_id, sha256(CASE WHEN lang = 'es' THEN lower(text) ELSE text END) AS h FROM documents WHERE lang <> 'fr')
SELECT coalesce(o.source, n.source) AS file_path, coalesce(o.doc_id, n.doc_id) AS chunk_index,
  CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' WHEN o.h IS NOT DISTINCT FROM n.h THEN 'skip' ELSE 'update' END AS action
FROM o FULL JOIN n ON o.source = n.source AND o.doc_id = n.doc_id""",
    "index_stats": f"WITH {_CHUNKS} SELECT count(*) AS total_chunks, count(DISTINCT file_path) AS total_files, CAST(sum(access_count) AS BIGINT) AS accesses, round(avg(importance), 9) AS mean_importance FROM chunks",
    "distinct_files": f"WITH {_CHUNKS} SELECT DISTINCT file_path FROM chunks",
    "access_log_rollup": "SELECT user_id AS id, count(*) AS access_count, CAST(max(ts) AS VARCHAR) AS last_accessed FROM events GROUP BY 1",
}
