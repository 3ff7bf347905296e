import datetime as dt
import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from corvane.functions import scoring
from corvane.functions.vector import cosine_distance, semantic_score
from corvane.operators import bm25
from corvane.operators.diff import changes
from corvane.operators.fusion import reciprocal_rank_fusion
from corvane.operators.knn import knn, knn_batch, knn_filtered
from corvane.plans.search import HybridSearch, SearchMode, pool_size

AS_OF = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)


@pytest.mark.parametrize(("rel", "imp", "decay", "want"), [(0.9, 0.8, 0.7, 0.84), (0, 0, 0, 0), (1, 1, 1, 1), (0.9, 0.5, 0.7, 0.86), (0.9, 0.8, 0.5, 0.88), (0.73, 0.5, 0.5, 0.73)])
def test_hybrid_score(spark, rel, imp, decay, want):
    df = spark.createDataFrame([(float(rel), float(imp), float(decay))], "r double, i double, d double")
    assert df.select(scoring.hybrid_score(F.col("r"), F.col("i"), F.col("d"))).first()[0] == pytest.approx(want, abs=1e-10)


def test_weights():
    with pytest.raises(ValueError):
        scoring.Weights(0.5, 0.2, 0.2)


def test_decay(spark):
    rows = [(AS_OF,), (AS_OF - dt.timedelta(days=1),), (AS_OF - dt.timedelta(days=30),), (None,), (AS_OF + dt.timedelta(days=3),)]
    got = [r[0] for r in spark.createDataFrame(rows, "t timestamp").select(scoring.temporal_decay(F.col("t"), F.lit(AS_OF))).collect()]
    assert got == pytest.approx([1, math.exp(-0.05), math.exp(-1.5), 0.5, 1])


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = [tuple(r) for r in df.select(cosine_distance(F.col("a"), F.col("b")).alias("d")).select("d", semantic_score(F.col("d"))).collect()]
    assert got[0] == (1.0, 0.0) and got[1][0] == pytest.approx(0) and got[1][1] == pytest.approx(1)
    assert got[2:] == [(None, 0.0)] * 3


def test_knn(spark):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)], "en" if i % 2 else "de") for i in range(6)] + [(9, [0.0, 0.0], "en")], "id long, embedding array<float>, kind string")
    q = [1.0, 0.0]
    want = sorted(range(6), key=lambda i: -math.cos(i))
    assert [r["id"] for r in knn(v, q, 4).orderBy("rank").collect()] == want[:4]
    assert [r["id"] for r in knn_filtered(v, q, 1, F.col("kind") == "en").collect()] == [i for i in want[:3] if i % 2][:1]
    assert [r["id"] for r in knn_filtered(v, q, 2, F.col("kind") == "en", prefilter=True).orderBy("rank").collect()] == [i for i in want if i % 2][:2]
    batch = knn_batch(v, spark.createDataFrame([(1, q)], "query_id long, query_embedding array<float>"), 3)
    assert [r["id"] for r in batch.orderBy("rank").collect()] == want[:3]
    with pytest.raises(ValueError):
        knn(v, q, 0)


TEXTS = [
    "How to deploy kubernetes on AWS", "Python programming best practices", "Deploy docker containers to production", "Memory management in low-level systems", "Full-text search with FTS5", "the deploy of the key value; key=value; v2.0",
    "", "the the of the", "École naïve deploy", "桌面端构建打包部署流程", "the production of memory", "of the value key",
]


def chunk_table(spark):
    rows = [(i, t, 0.5 + 0.03 * i, "semantic" if i % 3 else "episodic", f"{i}.md") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id long, chunk_text string, importance double, memory_type string, file_path string").withColumns({"chunk_index": F.lit(0), "tags": F.array().cast("array<string>"), "last_accessed": F.lit(None).cast("timestamp")})


@pytest.mark.parametrize("query", ["deploy", "the", "deploy deploy memory", "key=value;", "of-the deploy", "2.0", "v2.0", "!!! deploy", "École", "nothing-here", "桌面端", "", 'deploy "now', '"deploy the"', 'the"x of"y', 'the"of deploy"the', '"deploy" the', '"the" "of"', '""', 'the"of"', '"the of value"', 'a"AND"b', '!"the of"! deploy'])
def test_bm25_against_sqlite(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(t)")
    from corvane.functions.text import segment

    con.executemany("insert into f(rowid, t) values (?, ?)", [(i + 1, segment(t)) for i, t in enumerate(TEXTS)])
    match = " OR ".join(f'"{w}"' for w in segment(query).split())
    try:
        want = con.execute("select rowid, -rank from f where f match ? order by rank limit 5", (match,)).fetchall() if match else []
    except sqlite3.OperationalError:
        want = []
    got = [(r["id"] + 1, r["bm25_score"]) for r in bm25.search(bm25.build_index(chunk_table(spark)), query, 5).orderBy("rank").collect()]
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)


def test_lone_quote_finds_nothing(spark):
    assert bm25.search(bm25.build_index(chunk_table(spark)), 'deploy "now').count() == 0


def fuse(spark, lists, k=60):
    rows = [(i, r, d) for i, ranked in enumerate(lists) for r, d in enumerate(ranked, 1)]
    out = reciprocal_rank_fusion(spark.createDataFrame(rows, "list_id int, rank int, doc_id string"), k)
    return {r["doc_id"]: (r["rrf"], r["fused_rank"]) for r in out.collect()}


def test_rrf(spark):
    one = fuse(spark, [["a", "b", "c"]])
    assert [one[x] for x in "abc"] == [(1 / 61, 1), (1 / 62, 2), (1 / 63, 3)]
    two = fuse(spark, [["a", "b", "c"], ["b", "d", "a"]])
    assert two["a"][0] > two["c"][0] and two["b"][0] > two["d"][0]
    assert fuse(spark, [[], []]) == {}
    assert fuse(spark, [["a"], ["b"]])["a"][1] == 1
    gap = lambda k: (lambda s: s["a"][0] - s["c"][0])(fuse(spark, [["a", "b", "c"]], k))
    assert gap(1) > gap(100)


@pytest.fixture(scope="module")
def engine(spark):
    chunks = chunk_table(spark).cache()
    vectors = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(len(TEXTS))], "id long, embedding array<float>").cache()
    return HybridSearch(chunks, vectors, bm25.build_index(chunks))


@pytest.mark.parametrize("mode", list(SearchMode))
def test_modes(engine, mode):
    assert engine.search("  ", [1.0, 0.0], mode=mode).count() == 0
    rows = engine.search("deploy", [1.0, 0.0], 3, mode=mode, as_of=AS_OF).collect()
    assert len(rows) == 3 and [r["hybrid_score"] for r in rows] == sorted((r["hybrid_score"] for r in rows), reverse=True)
    assert engine.search("deploy", [1.0, 0.0], mode=mode, memory_type="none").count() == 0
    assert engine.search("deploy", [1.0, 0.0], mode=mode, min_score=2.0).count() == 0


def test_fts_has_no_semantic_score(engine):
    assert {r["semantic_score"] for r in engine.search("deploy", mode="fts_only").collect()} == {0.0}


def test_hybrid_without_vector_is_text(engine):
    ids = lambda rows: {r["id"] for r in rows.collect()}
    assert ids(engine.search("deploy", None)) == ids(engine.search("deploy", None, mode="fts_only"))
    assert engine.search("deploy", None, mode="vector_only").count() == 0
    assert engine.search("kubernetes", None, mode="fts_only").count() == 1


def test_modes_and_pool():
    assert SearchMode.of("what") is SearchMode.HYBRID
    assert pool_size(10) == 30 and pool_size(50) == 100
    with pytest.raises(ValueError):
        pool_size(-1)


def test_changes(spark):
    old = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z")], "file_path string, chunk_index int, content_hash string")
    new = spark.createDataFrame([("a", 0, "x"), ("a", 1, "Y"), ("b", 0, "n")], old.schema)
    got = {(r["file_path"], r["chunk_index"]): r["action"] for r in changes(old, new).collect()}
    assert got == {("a", 0): "skip", ("a", 1): "update", ("a", 2): "delete", ("b", 0): "insert"}
