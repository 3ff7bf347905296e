import pytest
from pyspark.sql import functions as F

from corvane.__main__ import main, preview
from corvane.embedding import Embedder, create_embedder
from corvane.indexer import Indexer, failures
from corvane.service import RetrievalService
from corvane.sources.files import as_text, list_files, read_files
from corvane.store import ChunkStore
from corvane.streaming.incremental import file_stream, index_stream
from tests.hashing import HashingEmbedder


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / ".hid").mkdir(parents=True)
    (root / "sub").mkdir()
    (root / "file1.md").write_text("# Gardens\n\nRoses grow here.\n\nSo do lilies.")
    (root / "file2.md").write_bytes(b"---\r\nimportance: 0.9\r\ntype: episodic\r\n---\r\n# Ponds\r\n\r\nFish swim.")
    (root / "sub" / "nested.MD").write_text("# Deeper\n\nA nested page.")
    (root / "_u.md").write_text("under")
    (root / ".hid" / ".h.md").write_text("hidden")
    (root / "bad.md").write_bytes(b"\xff\xfe\xff")
    (root / "high.md").write_text("---\nimportance: high\n---\nx")
    (root / "note.txt").write_text("plain")
    return root


def test_sources(spark, folder):
    files = list_files(spark, folder)
    assert {r["file_path"] for r in files.collect()} == {"file1.md", "file2.md", "sub/nested.MD", "_u.md", ".hid/.h.md", "bad.md", "high.md"}
    texts = as_text(read_files(files))
    assert {r["file_path"] for r in texts.filter("not valid").collect()} == {"bad.md"}
    assert "\r" not in texts.filter("file_path = 'file2.md'").first()["text"]
    assert {r["file_path"] for r in failures(texts).collect()} == {"bad.md", "high.md"}
    assert list_files(spark, folder / "none").count() == 0


def test_service(spark, folder):
    s = RetrievalService(spark, folder, HashingEmbedder())
    assert s.is_available and "file1.md" in s.list_files()
    assert s.rebuild_index() == 5
    version = s.store._manifest["version"]
    assert s.incremental_index() == 0 and s.store._manifest["version"] == version  # nothing has changed
    assert not list(s.store.path.glob("tmp-*"))
    row = s.store.chunks().filter("file_path = 'file2.md'").first()
    assert (row["importance"], row["memory_type"], row["chunk_text"]) == (0.9, "episodic", "# Ponds\n\nFish swim.")
    c = s.store.counts().first()
    assert c["chunks"] == c["vectors"] == c["indexed"] == 5
    (folder / "file1.md").write_text("changed words")
    assert s.incremental_index() == 1
    assert [r["file_path"] for r in s.search("changed", mode="fts_only").collect()] == ["file1.md"]
    assert set(s.search("nested", 3).columns) == {"file_path", "chunk_text", "chunk_index", "score", "hybrid_score", "semantic_score", "fts_score", "importance", "temporal_decay", "memory_type", "tags"}
    assert s.remove_file(folder / "file1.md") == 1 and s.remove_file(folder / "file1.md") == 0
    assert s.index_file(folder / "note.txt") == 1 and s.index_file(folder / "none.md") == 0
    assert s.stats()["total_chunks"] == 5 and len(s.stats()) == 9
    s.close()


def test_store(spark, tmp_path):
    store = ChunkStore(spark, tmp_path / "store", 4)
    ids = [store.insert_embedding([1.0, 0.0, 0.0, float(i)], f"{i % 2}.md", i, f"text number {i}") for i in range(3)]
    assert ids == [1, 2, 3] and store.count() == 3
    assert store.hashes_for_file("0.md").keys() == {0, 2}
    assert store.get_meta(9) is None and store.get_meta(1)["importance"] == 0.5
    assert [r["id"] for r in store.search_similar([1.0, 0.0, 0.0, 0.0], 2).orderBy("rank").collect()] == [1, 2]
    assert [r["id"] for r in store.search([1.0, 0.0, 0.0, 0.0], 3, {"file_path": "1.md"}).collect()] == [2]
    before = store.get_meta(1)
    store.update(spark.createDataFrame([(1, [0.0, 1.0, 0.0, 0.0], "fresh words"), (2, [0.0, 1.0, 0.0, 0.0], ""), (77, [0.0] * 4, "x")], "id long, embedding array<float>, chunk_text string"))
    assert store.get_meta(1)["chunk_text"] == "fresh words" and store.get_meta(1)["content_hash"] != before["content_hash"]
    assert store.get_meta(2)["chunk_text"] == "text number 1"
    assert store.search_fts("fresh").count() == 1 and store.search_fts("number").count() == 2
    store.record_access(spark.createDataFrame([(1,), (1,), (3,)], "id long"))
    assert store.get_meta(1)["access_count"] == 2 and store.get_meta(3)["last_accessed"] is not None
    store.delete(["2", 3])
    assert store.count() == 1 and store.delete_by_file("none") == 0
    assert store.insert_embedding([0.0] * 4, "z.md", 0, "z") == 4
    again = ChunkStore(spark, tmp_path / "store", 4)
    assert again.count() == 2
    again._commit(again._manifest, tokenizer=2)
    ChunkStore(spark, tmp_path / "store", 4)
    assert again._manifest["tokenizer"] == 3
    again.clear()
    assert again.count() == 0 and again.search_fts("z").count() == 0


def test_store_writes_changes_only(spark, tmp_path):
    """A small change writes a small segment; many of them are merged, deleted rows stay deleted, and totals agree with the tables."""
    store = ChunkStore(spark, tmp_path / "store", 2)
    alive, rng = {}, __import__("random").Random(3)
    big = spark.createDataFrame([([1.0, float(i)], "big.md", i, f"word{i % 7} common text {'x ' * (i % 5)}") for i in range(60)], "embedding array<float>, file_path string, chunk_index int, chunk_text string")
    assert store.add(big) == 60
    alive = {r["id"]: r["chunk_text"] for r in store.chunks().collect()}
    first = store._manifest["segments"][0]
    for step in range(12):
        id_ = store.insert_embedding([0.0, 1.0], f"{step}.md", 0, f"step {step}")
        alive[id_] = f"step {step}"
        if step % 2:
            gone = rng.choice(sorted(alive))
            store.delete([gone, 9999])
            del alive[gone]
        if step == 5:
            store.update(spark.createDataFrame([(id_, None, "updated words")], "id long, embedding array<float>, chunk_text string"))
            alive[id_] = "updated words"
        assert len(store._manifest["segments"]) <= 9
    assert store._manifest["segments"][0] == first  # the large segment was never written again
    assert {r["id"]: r["chunk_text"] for r in store.chunks().collect()} == alive
    c, now = store.counts().first(), store._manifest
    assert c["chunks"] == c["vectors"] == c["indexed"] == len(alive) == now["rows"]
    assert now["tokens"] == store._table("lengths").agg(F.sum("dl")).first()[0]
    store.compact(force=True)
    assert len(store._manifest["segments"]) == 1 and not store._manifest["deleted"]
    assert {r["id"]: r["chunk_text"] for r in store.chunks().collect()} == alive
    assert store.search_fts("updated").count() == 1 and store.search_fts("step").count() == sum(t.startswith("step") for t in alive.values())


def test_store_writers_do_not_undo_each_other(spark, tmp_path):
    store = ChunkStore(spark, tmp_path / "store", 2)
    seen = store._manifest
    store.insert_embedding([0.0, 1.0], "a.md", 0, "a")
    with pytest.raises(RuntimeError):
        store._commit(seen, next_id=7)
    assert store.count() == 1


def test_backfill(spark, tmp_path):
    store = ChunkStore(spark, tmp_path / "store", 2)
    store.insert_embedding([0.0, 1.0], "a.md", 0, "some words")
    assert not store.backfill_text_index() and store.backfill_text_index(force=True)
    assert store.search_fts("words").count() == 1 and store._manifest["rows"] == 1


def test_stream(spark, folder, tmp_path):
    store = ChunkStore(spark, tmp_path / "s", 4)
    index = Indexer(store, HashingEmbedder(), folder)
    for _ in range(2):
        index_stream(index, file_stream(spark, str(folder), "file*.md"), str(tmp_path / "c")).awaitTermination(120)
    assert store.count() == 2
    assert store.chunks().filter(F.col("file_path") == "file1.md").count() == 1


def test_embedders():
    e = HashingEmbedder()
    assert isinstance(e, Embedder) and sum(e.embed("two words")) == 2.0 and e.embed_batch(["ab"]) == [e.embed("ab")]
    with pytest.raises(RuntimeError):
        create_embedder("none", prefer_onnx=False)


def test_cli(capsys):
    assert main(["x"]) == 0 and main(["x", "--rebuild"]) == 1 and "--model" in capsys.readouterr().err
    assert preview("a" * 201) == "a" * 200 + "..." and preview("a") == "a"
