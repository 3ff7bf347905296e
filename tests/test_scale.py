"""What keeps the work in proportion to the input: plans without shuffles of whole texts or postings, bounded batches, folders listed by tasks."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane import queries, store_queries
from corvane.functions.text import chunked, in_batches
from corvane.operators import bm25
from corvane.sources.files import list_files
from corvane.store import ChunkStore, among, bitmaps
from tests.test_service import folder  # noqa: F401


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_not_shuffled(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(9))) for _ in range(50)] + [None, ""]
    found = bm25.postings_of(spark.createDataFrame(list(enumerate(texts)), "id long, chunk_text string"))
    assert "Exchange" not in plan(found)
    want = {(w, i): [p for p, x in enumerate((t or "").split()) if x == w] for i, t in enumerate(texts) for w in set((t or "").split())}
    rows = found.collect()
    assert {(r["term"], r["id"]): r["positions"] for r in rows} == want and len(rows) == len(want)
    assert all(r["tf"] == len(r["positions"]) for r in rows)


@pytest.mark.parametrize("most", [1, 7, 40, 10_000])
def test_runs_of_any_size(most):
    rng = random.Random(most)
    rows = [(i, [rng.choice(["x", "yy", "é", "z"]) for _ in range(rng.randrange(12))] if i % 9 else None) for i in range(60)]
    batches = [pa.RecordBatch.from_pydict({"id": [i for i, _ in part], "t": pa.array([t for _, t in part], pa.list_(pa.string()))}) for part in (rows[:5], rows[5:6], rows[6:])]
    got = []
    for r in bm25._runs(iter(batches), most):
        assert len(r.position) <= max(most, 11)
        terms = [r.terms[int(c)].as_py() for c in r.code]
        assert terms == sorted(terms, key=str.encode)
        got += [(t, r.ids[int(k)].as_py(), r.position[a:b].tolist()) for t, k, a, b in zip(terms, r.row, r.start, r.start[1:])]
    assert sorted(got) == sorted((w, i, [p for p, x in enumerate(t) if x == w]) for i, t in rows if t for w in set(t))


def test_term_counts_shuffle_terms_only(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None), (4, "É e")], "doc_id long, text string")
    found = bm25.term_counts(docs, F.col("text"))
    assert plan(found).count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in found.collect()} == {("a", 1, 2), ("b", 2, 2), ("e", 1, 2)}


def test_deleted_rows_leave_without_a_shuffle(spark, tmp_path):
    store = ChunkStore(spark, tmp_path / "s", 2)
    store.add(spark.createDataFrame([([1.0, 0.0], "f", i, f"text {i}") for i in range(300)], "embedding array<float>, file_path string, chunk_index int, chunk_text string"))
    gone = set()
    for step in range(10):  # lists are merged on the way
        some = random.Random(step).sample(range(1, 301), 9)
        store.delete(some)
        gone |= set(some)
    read = store.chunks().select("id", "chunk_text")
    assert "SortMergeJoin" not in plan(read) and "hashpartitioning(id" not in plan(read)
    assert {r["id"] for r in read.collect()} == set(range(1, 301)) - gone == {r["id"] for r in store._table("postings").select("id").distinct().collect()}
    assert store._manifest["rows"] == 300 - len(gone)


def test_lists_of_an_older_layout(spark, tmp_path):
    store = ChunkStore(spark, tmp_path / "s", 2)
    for i in range(3):
        store.insert_embedding([1.0, 0.0], "f", i, f"text {i}")
    old = store._manifest
    spark.createDataFrame([(1, 9), (2, 1)], "id long, at long").write.parquet(str(tmp_path / "s/deleted/old"))
    store._put(old | {"version": old["version"] + 1, "deleted": [{"part": "old"}]})
    assert {r["id"] for r in store.chunks().collect()} == {2, 3}


def test_bitmaps(spark):
    ids = [0, 63, 64, 65535, 65536, 1 << 40, -1, -65537]
    maps = bitmaps(spark.createDataFrame([(i,) for i in ids], "id long"))
    near = sorted({i + k for i in ids for k in (-1, 0, 1)})
    assert sorted(r["id"] for r in among(spark.createDataFrame([(i,) for i in near], "id long"), maps, maps.count()).collect()) == sorted(ids)


def test_folders_are_listed_by_tasks(spark, folder):  # noqa: F811
    (folder / "a/b/c/d/e").mkdir(parents=True)
    (folder / "a/b/c/d/e/deep.md").write_text("x")
    os.symlink(folder / "file1.md", folder / "sub/link.md")
    os.symlink(folder / "sub", folder / "loop")
    files = list_files(spark, folder, None)
    assert "MapInArrow" in plan(files)
    want = {os.path.join(at, n) for at, _, names in os.walk(folder) for n in names}
    assert {r["path"] for r in files.collect()} == want and files.count() == len(want)
    assert {r["file_path"] for r in files.filter("path like '%link.md' or path like '%deep.md'").collect()} == {"file1.md", "a/b/c/d/e/deep.md"}


def test_batches_of_texts_are_bounded(spark):
    out = list(in_batches(((i, "x" * 1000) for i in range(100)), pa.schema([("i", pa.int64()), ("t", pa.string())]), 1, 10_000))
    assert len(out) == 10 and sum(b.num_rows for b in out) == 100
    rows = spark.createDataFrame([(1, "a" * 30 + "\n\n" + "b" * 30), (2, None), (3, " ")], "k long, t string")
    assert [tuple(r) for r in chunked(rows, "k", F.col("t"), 40, 5).orderBy("k", "chunk_index").collect()] == [(1, 0, "a" * 30), (1, 1, "b" * 30)]


def test_vector_search_builds_no_text_index(spark, monkeypatch):
    monkeypatch.setattr(queries, "index_of", lambda *a: pytest.fail("the index was built"))
    assert queries.QUERIES["score_vector_only"](spark, "/root/testdata/sf0.001").count() > 0


def test_results_of_folders_stay_off_the_driver(spark):
    assert "FileScan" in plan(store_queries.QUERIES["files_by_extension"](spark, "/root/testdata/sf0.001"))
