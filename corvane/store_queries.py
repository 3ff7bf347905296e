"""Queries that run the store, the indexer and the service over all documents, and the same in SQL.

A source is a file and a document one of its chunks; for the queries about files every document is a file of its own, its lines
are paragraphs. The index that the search queries share is built once an application and folder, as ``index_build``.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import body, cjk_segmented, content_hash, frontmatter, iso_timestamp, json_of_tags, parse_meta, preview, strip, tags_of_json, tokens
from corvane.service import RetrievalService
from corvane.sources.files import list_files
from corvane.store import ChunkStore
from corvane.workspace import staged, workspace

_stores: dict[tuple[str, str], ChunkStore] = {}


class GivenEmbedder:
    """Texts that are numbers of vectors are those vectors, all others one and the same."""

    def __init__(self, vector: Sequence[float]):
        self.vector, self.dimension = list(map(float, vector)), len(vector)

    def embed(self, text: str) -> list[float]:
        return self.vector

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        return [self.vector] * len(texts)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents_as_rows(spark: SparkSession, d: str) -> DataFrame:
    """All documents with the vector of their number, as rows to insert."""
    docs, vectors = _table(spark, d, "documents"), _table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs.join(vectors, "doc_id", "left").select("embedding", F.col("source").alias("file_path"), F.col("doc_id").cast("int").alias("chunk_index"), F.col("text").alias("chunk_text"), F.col("lang").alias("memory_type"), F.array("source", "lang").alias("tags"))


def index_of(spark: SparkSession, d: str) -> ChunkStore:
    """The store of all documents; its chunks are numbered by document."""
    key = spark.sparkContext.applicationId, d
    if key not in _stores:
        store = ChunkStore(spark)
        store.add(documents_as_rows(spark, d).withColumn("file_path", F.lit("")))
        _stores[key] = store
    return _stores[key]


def index_build(spark, d):
    """Builds the shared index; how many rows and tokens it has."""
    now = index_of(spark, d)._manifest
    return spark.createDataFrame([(now["rows"], now["tokens"])], "n_rows long, n_tokens long")


def _maintained(spark: SparkSession, d: str) -> ChunkStore:
    """All documents added, then: a fifth deleted by id, a fifth updated in lower case, one source deleted, one row inserted, accesses of all events recorded."""
    store = ChunkStore(spark)
    store.add(documents_as_rows(spark, d))
    rows = store.chunks().select("id", "chunk_index", "chunk_text")
    store.apply(delete=rows.filter("chunk_index % 5 = 0").select("id"))
    store.update(rows.filter("chunk_index % 5 = 1").select("id", F.lit(None).cast("array<float>").alias("embedding"), F.lower("chunk_text").alias("chunk_text")))
    store.delete_by_file("src1")
    store.insert_embedding([1.0, 2.0], "src1", 1_000_000, "a row of its own", tags=["x"])
    seen = _table(spark, d, "events").select((F.col("user_id")).alias("chunk_index"))
    store.record_access(store.chunks().select("id", "chunk_index").join(seen, "chunk_index").select("id"))
    return store


def store_insert(spark, d):
    out = index_of(spark, d).chunks()
    return out.select("id", "file_path", "chunk_index", "content_hash", "importance", "memory_type", F.array_join("tags", ",").alias("tags"), "access_count")


def store_maintenance(spark, d):
    return _maintained(spark, d).chunks().select("file_path", "chunk_index", "content_hash", "access_count", F.col("last_accessed").isNotNull().alias("accessed"))


def store_counts(spark, d):
    return _maintained(spark, d).counts()


def store_text_search(spark, d):
    """BM25 over the text index as changes have left it."""
    store = _maintained(spark, d)
    found = store.search_fts("estion", 20)
    return found.join(store.chunks().select("id", "file_path", "chunk_index"), "id").select("file_path", "chunk_index", F.round("bm25_score", 6).alias("bm25_score"), "rank")


def store_compacted(spark, d):
    """Nothing changes when segments are merged and deleted rows leave."""
    store = _maintained(spark, d)
    store.compact(force=True)
    return store.chunks().join(store.vectors(), "id").select("file_path", "chunk_index", "content_hash", F.coalesce(F.size("embedding"), F.lit(0)).alias("dimension"))


def store_clear(spark, d):
    store = _maintained(spark, d)
    store.clear()
    return store.counts()


def text_index_backfill(spark, d):
    """Postings after a forced rebuild of the text index."""
    store = _maintained(spark, d)
    store.backfill_text_index(force=True)
    return store.text_index().postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def hashes_for_file(spark, d):
    store = _maintained(spark, d)
    return spark.createDataFrame(sorted(store.hashes_for_file("src2").items()), "chunk_index long, content_hash string")


def point_lookup(spark, d):
    row = index_of(spark, d).get_meta(3)
    return spark.createDataFrame([(row["id"], row["chunk_index"], row["chunk_text"], row["importance"], row["memory_type"])], "id long, chunk_index long, chunk_text string, importance double, memory_type string")


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return list(_table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"])


def store_search(spark, d):
    out = index_of(spark, d).search(_first_vector(spark, d), 10)
    return out.select("id", "chunk_index", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


def store_search_filtered(spark, d):
    """Three times as many fetched, then filtered by two metadata columns."""
    out = index_of(spark, d).search(_first_vector(spark, d), 10, {"memory_type": "en", "file_path": ""})
    return out.select("id", "chunk_index", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


def store_search_prefiltered(spark, d):
    out = index_of(spark, d).search(_first_vector(spark, d), 10, {"memory_type": "en"}, prefilter=True)
    return out.select("id", "chunk_index", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


# files


_MAIN, _CHANGED = "documents", "documents-changed"


def _write_files(docs: DataFrame, root: str) -> None:
    """Rows (name, text) as files below ``root``, written by the tasks, text by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for b in batches:
            for name, text in zip(b["name"], b["text"]):
                path = os.path.join(root, name.as_py())
                if (folder := os.path.dirname(path)) not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                with open(path, "wb") as f:
                    f.write(text.as_buffer())
            yield b.select(["name"])

    docs.select("name", "text").mapInArrow(run, "name string").count()


def _folder(spark: SparkSession) -> str:
    root = f"{workspace(spark)}/files-{uuid.uuid4().hex[:12]}".removeprefix("file:")
    os.makedirs(root)
    return root


def _as_files(spark: SparkSession, d: str, text) -> DataFrame:
    docs = _table(spark, d, "documents")
    suffix = F.when(F.col("doc_id") % 7 == 0, ".txt").when(F.col("doc_id") % 7 == 1, ".MD").otherwise(".md")
    front = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\ntype: "), F.col("lang"), F.lit("\n---\n"))).otherwise("")
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("name"), F.concat(front, F.regexp_replace(text, "\n", "\n\n")).alias("text"), "doc_id")


def _service(spark: SparkSession, d: str) -> tuple[RetrievalService, str]:
    root = _folder(spark)
    _write_files(_as_files(spark, d, F.col("text")), root)
    return RetrievalService(spark, root, GivenEmbedder([1.0, 0.0]), f"{root}-index"), root


def _remove(spark: SparkSession, root: str) -> None:
    """``root`` and all below it; each of its folders is a task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b["folder"].to_pylist():
                shutil.rmtree(folder)
            yield b

    folders = [(e.path,) for e in os.scandir(root) if e.is_dir(follow_symlinks=False)]
    if folders:
        spark.createDataFrame(folders, "folder string").repartition(len(folders)).mapInArrow(run, "folder string").count()
    shutil.rmtree(root)


def _done(service: RetrievalService, root: str, out: DataFrame) -> DataFrame:
    out = staged(out, "indexed")  # the index goes with its folder
    _remove(service.spark, root)
    return out


def _of_chunks(service: RetrievalService) -> DataFrame:
    return service.store.chunks().select("file_path", "chunk_index", "content_hash", "memory_type")


def index_folder(spark, d):
    """A folder with a file for every document, indexed: whatever ends in .md."""
    service, root = _service(spark, d)
    service.rebuild_index()
    return _done(service, root, _of_chunks(service))


def index_incremental(spark, d):
    """The same, then a quarter of the files rewritten and two removed, and indexed again."""
    service, root = _service(spark, d)
    service.incremental_index()
    _write_files(_as_files(spark, d, F.replace(F.col("text"), F.lit("e"), F.lit("E"))).filter("doc_id % 4 = 1"), root)
    service.incremental_index()
    for name in ("src2/2.md", "src4/4.md"):
        service.remove_file(f"{root}/{name}")
    return _done(service, root, _of_chunks(service))


def index_text_files(spark, d):
    """All files that are text, whatever they end in: one row a file."""
    service, root = _service(spark, d)
    service.indexer.index_directory_textfiles(root)
    return _done(service, root, service.store.chunks().groupBy("file_path").agg(F.count("*").alias("chunks")))


def files_by_extension(spark, d):
    service, root = _service(spark, d)
    files = list_files(spark, root, None)
    return _done(service, root, files.groupBy("suffix").agg(F.count("*").alias("files"), F.min("file_path").alias("first")))


# search by the service


def _searched(spark: SparkSession, d: str) -> RetrievalService:
    store = index_of(spark, d)
    service = RetrievalService(spark, store.path, GivenEmbedder(_first_vector(spark, d)), store.path)
    service._store = store
    return service


def service_search(spark, d):
    out = _searched(spark, d).search("estion ndat", 10)
    return out.select("chunk_index", "score", "hybrid_score", "semantic_score", "fts_score", "importance", "temporal_decay", "memory_type", F.array_join("tags", ",").alias("tags"))


def service_search_unknown_mode(spark, d):
    """An unknown mode is hybrid."""
    out = _searched(spark, d).search("estion ndat", 10, mode="nonsense")
    return out.select("chunk_index", "score", "hybrid_score", "semantic_score", "fts_score", "importance", "temporal_decay", "memory_type", F.array_join("tags", ",").alias("tags"))


def service_blank_query(spark, d):
    return _searched(spark, d).search(" \n ", 10).select("chunk_index", "score")


def service_min_score(spark, d):
    return _searched(spark, d).search("estion ndat", 10, min_score=0.7, mode="fts_only").select("chunk_index", "score", "fts_score")


# functions


def _with_front(spark: SparkSession, d: str) -> DataFrame:
    """Documents with frontmatter of eight forms."""
    forms = [
        "---\nimportance: 0.9\ntype: note\ntags: [a, b]\n---\n",
        "---\nimportance:\ntags: one\n---\n",
        "---\ntype: [broken\n---\n",
        "---\nimportance: '0.25'\ntags: [1, 2.5, true]\n---\n",
        "no frontmatter\n",
        "---\nimportance: high\n---\n",
        "---  \n- a list\n---\t\n",
        "---\ntags:\ntype: 7\nimportance: 3\n---\n",
    ]
    front = F.lit(forms[0])
    for k in range(1, 8):
        front = F.when(F.col("doc_id") % 8 == k, F.lit(forms[k])).otherwise(front)
    return _table(spark, d, "documents").withColumn("full", F.concat(front, F.col("text")))


def frontmatter_forms(spark, d):
    rows = _with_front(spark, d).select("doc_id", parse_meta(frontmatter(F.col("full"))).alias("m"), content_hash(body(F.col("full"))).alias("body_hash"))
    return rows.select("doc_id", "m.importance", "m.memory_type", F.array_join("m.tags", ",").alias("tags"), F.col("m.error").isNotNull().alias("failed"), "body_hash")


def cjk_tokens(spark, d):
    """Tokens where Chinese, Japanese and Korean characters stand among other text."""
    text = F.concat(F.substring("text", 1, 200), F.lit("桌面端x构建カナ 한국 test"), F.col("lang"))
    return _table(spark, d, "documents").select("doc_id", F.array_join(tokens(cjk_segmented(text)), " ").alias("tokens"))


def iso_times(spark, d):
    """Times as ISO text and back; what isn't a time is null."""
    text = F.when(F.col("event_id") % 5 == 0, "not a time").when(F.col("event_id") % 5 == 1, "").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return _table(spark, d, "events").select("event_id", F.unix_micros(iso_timestamp(text)).alias("micros"))


def tags_json(spark, d):
    docs = _table(spark, d, "documents")
    text = json_of_tags(F.array("source", F.concat(F.lit('a"'), F.col("lang"))))
    text = F.when(F.col("doc_id") % 4 == 0, "not json").when(F.col("doc_id") % 4 == 1, None).otherwise(text)
    return docs.select("doc_id", F.array_join(tags_of_json(text), "|").alias("tags"))


def stripped_text(spark, d):
    return _table(spark, d, "documents").select("doc_id", content_hash(strip(F.concat(F.lit(" \n\t"), F.col("text"), F.lit("\r\n  ")))).alias("hash"))


def text_preview(spark, d):
    return _table(spark, d, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        index_build, store_insert, store_maintenance, store_counts, store_text_search, store_compacted, store_clear, text_index_backfill, hashes_for_file, point_lookup, store_search, store_search_filtered, store_search_prefiltered,
        index_folder, index_incremental, index_text_files, files_by_extension, service_search, service_search_unknown_mode, service_blank_query, service_min_score,
        frontmatter_forms, cjk_tokens, iso_times, tags_json, stripped_text, text_preview,
    )
}

# the same in SQL

_TOKENS = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}]+')"
_KEPT = """changed AS (SELECT source AS file_path, doc_id AS chunk_index, CASE WHEN doc_id % 5 = 1 THEN lower(text) ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0 AND source <> 'src1'
  UNION ALL SELECT 'src1', 1000000, 'a row of its own'),
rows AS (SELECT *, row_number() OVER (ORDER BY file_path, chunk_index) AS id FROM changed)"""


def chunks_sql(paragraphs: str) -> str:
    """Chunks of a relation (key, text) named docs, paragraphs being the expression for the list of its stripped ones: (key, chunk_index, chunk_text)."""
    return f"""parts AS (SELECT key, trim(text, E' \\n\\t\\r') AS whole, length(text) AS n, list_filter({paragraphs}, lambda x: length(x) > 0) AS p FROM docs),
sums AS (SELECT *, list_transform(generate_series(0, len(p)), lambda i: CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) AS BIGINT)) AS s FROM parts WHERE n > 1600 AND len(p) > 0),
-- s[i + 1]: characters of the first i paragraphs; the chunk that is held has the paragraphs b to i - 1
fold(key, p, s, i, b, k, e) AS (
  SELECT key, p, s, 2::BIGINT, 1::BIGINT, 0::BIGINT, 0::BIGINT FROM sums
  UNION ALL
  SELECT key, p, s, i + 1, CASE WHEN is_full THEN greatest(b, len(list_filter(s, lambda x: s[i] - x > 320)) + 1) ELSE b END, CASE WHEN is_full THEN k + 1 ELSE k END, CASE WHEN is_full THEN b ELSE 0 END
  FROM (SELECT *, s[i + 1] - s[b] > 1600 AS is_full FROM fold WHERE i <= len(p))
),
-- a chunk ends where a step found it full; e: where it had begun
long AS (SELECT key, k - 1 AS chunk_index, array_to_string(p[e:i - 2], E'\\n\\n') AS chunk_text FROM fold WHERE e > 0
  UNION ALL SELECT key, k, array_to_string(p[b:], E'\\n\\n') FROM fold WHERE i = len(p) + 1),
pieces AS (SELECT * FROM long UNION ALL SELECT key, 0, whole FROM parts WHERE n <= 1600 AND length(whole) > 0)"""


PARAGRAPHS = "list_transform(string_split(text, E'\\n\\n'), lambda x: trim(x, E' \\n\\t\\r'))"


def _files_sql(text: str, name_suffix: str = "WHERE doc_id % 7 <> 0", extra: str = "") -> str:
    suffix = "CASE WHEN doc_id % 7 = 0 THEN '.txt' WHEN doc_id % 7 = 1 THEN '.MD' ELSE '.md' END"
    return f"WITH RECURSIVE docs AS (SELECT source || '/' || doc_id || {suffix} AS key, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'semantic' END AS kind, replace({text}, E'\\n', E'\\n\\n') AS text FROM documents {name_suffix}), {chunks_sql(PARAGRAPHS)}"


_DIST = """q0 AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
dist AS (SELECT vec_id + 1 AS id, CAST(vec_id AS INTEGER) AS chunk_index, 1 - list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS distance
  FROM embeddings JOIN documents ON doc_id = vec_id, q0)"""
_NEAREST = "SELECT id, chunk_index, round(distance, 6) + 0.0 AS distance, CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS rank FROM {} QUALIFY rank <= 10"


def _bm25(terms: list[str], rows: str, k: int) -> str:
    wanted = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    return f"""toks AS (SELECT id, {_TOKENS.format('text')} AS t FROM {rows}),
totals AS (SELECT count(*) AS n_rows, avg(coalesce(len(t), 0)) AS avgdl FROM toks),
tfs AS (SELECT phrase, id, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM toks) JOIN (VALUES {wanted}) w(phrase, term) USING (term) GROUP BY ALL),
dfs AS (SELECT phrase, count(*) AS df FROM tfs GROUP BY ALL),
scored AS (SELECT tfs.id, greatest(CASE WHEN ln((n_rows - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n_rows - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END, 1e-6::DOUBLE)
  * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * coalesce(len(t), 0) / avgdl)) AS part FROM tfs JOIN dfs USING (phrase) JOIN toks USING (id), totals),
hits AS (SELECT id, sum(part) AS bm25, row_number() OVER (ORDER BY sum(part) DESC, id) AS rank FROM scored GROUP BY id QUALIFY rank <= {k})"""


_DOCS = "all_rows AS (SELECT doc_id + 1 AS id, CAST(doc_id AS INTEGER) AS chunk_index, text, lang, source FROM documents)"
# importance and decay are neutral: relevance has all the weight
_SERVICE = f"""WITH {_DOCS}, {_DIST}, {_bm25(['estion', 'ndat'], 'all_rows', 30)},
near AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS rank FROM dist QUALIFY rank <= 30),
normed AS (SELECT id, bm25 / greatest(max(bm25) OVER (), 1e-9) AS fts, rank FROM hits),
lists AS (SELECT id, 0 AS l, rank, distance, NULL AS fts FROM near UNION ALL SELECT id, 1, rank, NULL, fts FROM normed),
fused AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS raw, max(distance) AS distance, coalesce(max(fts), 0) AS fts, min(l * 1000 + rank) AS first FROM lists GROUP BY id),
ranked AS (SELECT *, raw / greatest(max(raw) OVER (), 1e-9) AS rrf, row_number() OVER (ORDER BY raw DESC, first) AS place FROM fused QUALIFY place <= 10)
SELECT chunk_index, round(rrf, 4) AS score, round(rrf, 4) AS hybrid_score, round(CASE WHEN distance IS NULL THEN 0 ELSE greatest(0, least(1, 1 - distance)) END, 4) AS semantic_score, round(fts, 4) AS fts_score,
  0.5::DOUBLE AS importance, 0.5::DOUBLE AS temporal_decay, lang AS memory_type, source || ',' || lang AS tags FROM ranked JOIN all_rows USING (id)"""

SQL: dict[str, str] = {
    "index_build": f"SELECT count(*) AS n_rows, CAST(sum(coalesce(len({_TOKENS.format('text')}), 0)) AS BIGINT) AS n_tokens FROM documents",
    "store_insert": "SELECT row_number() OVER (ORDER BY doc_id) AS id, '' AS file_path, CAST(doc_id AS INTEGER) AS chunk_index, sha256(text) AS content_hash, 0.5::DOUBLE AS importance, lang AS memory_type, source || ',' || lang AS tags, 0 AS access_count FROM documents",
    "store_maintenance": f"""WITH {_KEPT}, seen AS (SELECT user_id AS chunk_index, count(*) AS n FROM events GROUP BY 1)
SELECT file_path, CAST(chunk_index AS INTEGER) AS chunk_index, sha256(text) AS content_hash, CAST(coalesce(n, 0) AS INTEGER) AS access_count, n IS NOT NULL AS accessed FROM rows LEFT JOIN seen USING (chunk_index)""",
    "store_counts": f"WITH {_KEPT} SELECT count(*) AS chunks, count(DISTINCT file_path) AS files, count(*) AS vectors, count(*) AS indexed FROM rows",
    "store_text_search": f"""WITH {_KEPT}, numbered AS (SELECT file_path, chunk_index, text, CASE WHEN chunk_index = 1000000 THEN 1e9 ELSE row_number() OVER (ORDER BY file_path, chunk_index) END AS id FROM changed), {_bm25(['estion'], 'numbered', 20)}
SELECT file_path, CAST(chunk_index AS INTEGER) AS chunk_index, round(bm25, 6) AS bm25_score, CAST(rank AS INTEGER) AS rank FROM hits JOIN numbered USING (id)""",
    "store_compacted": f"WITH {_KEPT} SELECT file_path, CAST(chunk_index AS INTEGER) AS chunk_index, sha256(text) AS content_hash, CAST(CASE WHEN chunk_index = 1000000 THEN 2 ELSE coalesce(len(embedding), 0) END AS INTEGER) AS dimension FROM rows LEFT JOIN embeddings ON vec_id = chunk_index",
    "store_clear": "SELECT 0::BIGINT AS chunks, 0::BIGINT AS files, 0::BIGINT AS vectors, 0::BIGINT AS indexed",
    "text_index_backfill": f"WITH {_KEPT}, w AS (SELECT id, unnest({_TOKENS.format('text')}) AS term FROM rows) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM w GROUP BY term",
    "hashes_for_file": f"WITH {_KEPT} SELECT chunk_index, sha256(text) AS content_hash FROM rows WHERE file_path = 'src2'",
    "point_lookup": "SELECT 3::BIGINT AS id, doc_id AS chunk_index, text AS chunk_text, 0.5::DOUBLE AS importance, lang AS memory_type FROM documents WHERE doc_id = 2",
    "store_search": f"WITH {_DIST} {_NEAREST.format('dist')}",
    "store_search_filtered": f"WITH {_DIST}, pool AS (SELECT * FROM dist ORDER BY distance, id LIMIT 30), kept AS (SELECT pool.* FROM pool JOIN documents ON doc_id = chunk_index WHERE lang = 'en') {_NEAREST.format('kept')}",
    "store_search_prefiltered": f"WITH {_DIST}, kept AS (SELECT dist.* FROM dist JOIN documents ON doc_id = chunk_index WHERE lang = 'en') {_NEAREST.format('kept')}",
    "index_folder": f"{_files_sql('text')} SELECT key AS file_path, CAST(chunk_index AS INTEGER) AS chunk_index, sha256(chunk_text) AS content_hash, kind AS memory_type FROM pieces JOIN docs USING (key)",
    "index_incremental": f"""{_files_sql("CASE WHEN doc_id % 4 = 1 THEN replace(text, 'e', 'E') ELSE text END")} SELECT key AS file_path, CAST(chunk_index AS INTEGER) AS chunk_index, sha256(chunk_text) AS content_hash, kind AS memory_type
FROM pieces JOIN docs USING (key) WHERE key NOT IN ('src2/2.md', 'src4/4.md')""",
    "index_text_files": f"{_files_sql('text', '')} SELECT key AS file_path, count(*) AS chunks FROM pieces GROUP BY 1",
    "files_by_extension": "WITH f AS (SELECT source || '/' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.txt' WHEN doc_id % 7 = 1 THEN '.MD' ELSE '.md' END AS name FROM documents) SELECT lower(regexp_extract(name, '\\.[A-Za-z]+$')) AS suffix, count(*) AS files, min(name) AS first FROM f GROUP BY 1",
    "service_search": _SERVICE,
    "service_search_unknown_mode": _SERVICE,
    "service_blank_query": "SELECT 0 AS chunk_index, 0.0::DOUBLE AS score WHERE false",
    "service_min_score": f"""WITH {_DOCS}, {_bm25(['estion', 'ndat'], 'all_rows', 30)}, normed AS (SELECT id, bm25 / greatest(max(bm25) OVER (), 1e-9) AS fts, rank FROM hits)
SELECT chunk_index, round(fts, 4) AS score, round(fts, 4) AS fts_score FROM normed JOIN all_rows USING (id) WHERE fts >= 0.7 ORDER BY fts DESC, rank LIMIT 10""",
    "frontmatter_forms": """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN NULL WHEN 3 THEN 0.25::DOUBLE WHEN 5 THEN NULL WHEN 7 THEN 3.0::DOUBLE ELSE 0.5::DOUBLE END AS importance,
  CASE doc_id % 8 WHEN 0 THEN 'note' WHEN 7 THEN '7' ELSE 'semantic' END AS memory_type, CASE doc_id % 8 WHEN 0 THEN 'a,b' WHEN 1 THEN 'one' WHEN 3 THEN '1,2.5,True' ELSE '' END AS tags,
  doc_id % 8 IN (1, 5) AS failed, sha256(CASE WHEN doc_id % 8 = 4 THEN E'no frontmatter\\n' || text ELSE text END) AS body_hash FROM documents""",
    "cjk_tokens": r"SELECT doc_id, array_to_string(regexp_extract_all(lower(strip_accents(substr(text, 1, 200) || '桌 面 端x构 建 カ ナ 한 국 test' || lang)), '[\p{L}\p{N}]+'), ' ') AS tokens FROM documents",
    "iso_times": "SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN NULL ELSE epoch_us(ts) END AS micros FROM events",
    "tags_json": "SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN '' ELSE source || '|a\"' || lang END AS tags FROM documents",
    "stripped_text": "SELECT doc_id, sha256(trim(text, E' \\n\\t\\r')) AS hash FROM documents",
    "text_preview": "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents",
}
