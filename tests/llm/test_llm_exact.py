"""Exact top-k, repeated passages, suffix order, language model: against brute force."""

import collections
import math
import shutil

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import induced, kneser_ney, suffix, vafile
from corvane.llm.induced import RisingQueue, suffix_order
from corvane.llm.words import word_hashes


def hashes(text):
    return next(word_hashes(pa.array([text]), punctuation=False))[2].tolist() if text else []


def brute_suffixes(t, cap):
    order = sorted(range(len(t)), key=lambda i: t[i:].tolist(), reverse=True)
    shared = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < cap and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        shared.append(k)
    return order, shared


@pytest.mark.parametrize("step", [1 << 20, 5])
def test_suffix_order(tmp_path, monkeypatch, step):
    monkeypatch.setattr(induced, "_STEP", step)
    rng = np.random.default_rng(1)
    for trial in range(150):
        t = rng.integers(1, rng.integers(2, 7), rng.integers(1, 60))
        if trial % 3 == 0:
            t = np.tile(t, 3)[:80]
        if trial % 5 == 0:
            t = np.repeat(t, rng.integers(1, 8, len(t)))
        t = np.unique(np.r_[t, 0], return_inverse=True)[1]
        for cap, room in ((50, 1 << 20), (3, 1 << 20), (50, 7), (50, 2)):
            folder = tmp_path / f"{trial}-{cap}-{room}"
            folder.mkdir()
            order, shared = suffix_order(t, cap, room, str(folder))
            assert (order.tolist(), shared.tolist()) == brute_suffixes(t, cap)
            shutil.rmtree(folder)


def test_rising_queue(tmp_path):
    q = RisingQueue(np.full(20, 5), 12, str(tmp_path))
    for k in (3, 19, 7, 3, 7, 0):
        q.push(k, k * 10)
        q.push(k, k * 10 + 1)
    assert [[x for some in q.take(k) for x in some] for k in range(20) if k in (0, 3, 7, 19)] == [[0, 1], [30, 31, 30, 31], [70, 71, 70, 71], [190, 191]]


def repeats(rows, least):
    where, words = collections.defaultdict(set), [(i, hashes(t)) for i, t in rows if i is not None and t]
    for i, h in words:
        for p in range(len(h) - least + 1):
            where[tuple(h[p : p + least])].add(i)
    out = set()
    for i, h in words:
        at = [p for p in range(len(h) - least + 1) if len(where[tuple(h[p : p + least])]) > 1]
        while at:
            start = end = at[0]
            end += least
            while at and at[0] <= end:
                end = at.pop(0) + least
            out.add((i, start, end - start))
    return out


@pytest.mark.parametrize("room", [1 << 23, 200])
def test_repeated_passages(docs, room):
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(words, n))
    shared, line = say(60), "again and again this line comes"
    rows = [(i, say(40) + " " + shared + " " + say(30), "s") for i in range(4)]
    rows += [(10, shared, "s"), (11, say(49), "s"), (12, " ".join([line] * 30), "s"), (13, say(7) + " " + " ".join([line] * 20), "s"), (14, "same same " * 80, "s"), (15, None, "s"), (None, shared, "s"), (16, say(120), "s")]
    rows += [(17, rows[0][1], "s"), (18, say(51), "s"), (18, say(51), "s")]
    got = {tuple(r) for r in suffix.repeated_passages(docs(rows), 50, shard_words=100, room=room).collect()}
    assert got == repeats([r[:2] for r in rows], 50) and len(got) >= 8


def test_shard_in_files(tmp_path, monkeypatch):
    """The same runs from memory and, piece by piece, from files, which are gone afterwards; groups of copies go over many pieces."""
    rng = np.random.default_rng(8)
    shared = [rng.integers(0, 500, 40) for _ in range(3)]
    segments = [np.concatenate([rng.integers(0, 500, rng.integers(1, 20)), shared[i % 3] if i % 4 else rng.integers(0, 500, 12), rng.integers(0, 500, rng.integers(0, 20))]).astype(np.uint32) for i in range(60)]
    lo = np.arange(60) // 2
    batch = pa.RecordBatch.from_pydict({"v": np.arange(60), "sh": np.arange(60), "lo": lo, "hi": np.where(np.arange(60) % 7, lo, lo + 1), "len": np.array([max(1, len(s) - 11) for s in segments], np.int32), "words": pa.array([s.tobytes() for s in segments], pa.binary())})
    runs = lambda room: sorted(tuple(r.values()) for b in suffix._repeats(12, room, f"file://{tmp_path}")(iter([batch])) for r in b.to_pylist())
    want = runs(1 << 20)
    monkeypatch.setattr(induced, "_STEP", 7)
    assert runs(50) == runs(1 << 20) == want and len(want) > 30 and not list(tmp_path.iterdir())


def test_repeated_passages_awkward(awkward, empty):
    assert suffix.repeated_passages(empty).count() == 0
    got = {(r[0], r[1]) for r in suffix.repeated_passages(awkward).collect()}
    assert got == {(5, 0), (6, 0)}


def nearest(rows, k):
    out = set()
    for q, a in rows.items():
        d = sorted((math.dist(a, b), x) for x, b in rows.items() if x != q)[:k]
        out |= {(q, x, i) for i, (_, x) in enumerate(d, 1)}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = {i: rng.normal(size=6).astype(np.float32).tolist() for i in range(200)}
    rows |= {300 + i: rows[i] for i in range(20)} | {400: [1e4] * 6, 401: [0.0] * 6, 402: [0.0] * 6}
    extra = [(500, None), (501, []), (502, [1.0] * 3), (503, [float("nan")] * 6), (504, [1.0, None] * 3), (None, [1.0] * 6), (0, rows[0])]
    df = spark.createDataFrame([*rows.items(), *extra], "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "'x' as v", "2 as q")
    got = vafile.top_k(df, k=5, block=64, query_block=50, rows_at_once=7).collect()
    assert {(r["query_id"], r["neighbor_id"], r["rank"]) for r in got} == nearest(rows, 5)
    assert all(r["distance"] == pytest.approx(math.dist(rows[r["query_id"]], rows[r["neighbor_id"]]), abs=1e-6) for r in got)
    few = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    assert {tuple(r)[:3] for r in vafile.top_k(few, k=5).collect()} == {(1, 2, 1), (2, 1, 1)}
    assert vafile.top_k(few.filter("vec_id < 0")).count() == 0 and vafile.top_k(few, few.filter("vec_id < 0")).count() == 0
    some = vafile.top_k(df, df.filter("vec_id % 7 = 0"), k=5, block=40, query_block=9, rows_at_once=4).collect()
    assert {(r["query_id"], r["neighbor_id"], r["rank"]) for r in some} == {x for x in nearest(rows, 5) if x[0] % 7 == 0}


def test_top_k_reads_in_rounds(spark):
    """Wide cells: many candidates for each query, read round by round until the kth is certain; ties and copies beyond k."""
    rng = np.random.default_rng(6)
    rows = {i: (rng.integers(0, 3, 4) + (1000 if i == 0 else 0)).astype(np.float32).tolist() for i in range(300)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    got = vafile.top_k(df, df.filter("vec_id < 40"), k=3, block=64).collect()
    assert {(r["query_id"], r["neighbor_id"], r["rank"]) for r in got} == {x for x in nearest(rows, 3) if x[0] < 40}


def brute_model(texts):
    docs = [["s", "s", *h, "e"] for h in map(hashes, texts) if h]
    c3 = collections.Counter(tuple(x[i - 2 : i + 1]) for x in docs for i in range(2, len(x)))
    c2 = collections.Counter(k[1:] for k in c3)
    counts = {3: c3, 2: c2, 1: collections.Counter(k[1:] for k in c2)}
    discounts, contexts = {}, {}
    for o, c in counts.items():
        m = collections.Counter(c.values())
        discounts[o] = kneser_ney._discounts(m[1], m[2], m[3], m[4])
        contexts[o] = collections.defaultdict(lambda: [0, 0, 0, 0])
        for k, n in c.items():
            contexts[o][k[:-1]][0] += n
            contexts[o][k[:-1]][min(n, 3)] += 1

    def p(o, gram):
        if o == 0:
            return 1 / (len(counts[1]) + 1)
        low, c, s, d = p(o - 1, gram[1:]), counts[o][gram], contexts[o].get(gram[:-1]), discounts[o]
        return low if not s else (max(c - (d[min(c, 3) - 1] if c else 0), 0) + sum(a * b for a, b in zip(d, s[1:])) * low) / s[0]

    def score(text):
        x = ["s", "s", *hashes(text), "e"]
        return sum(math.log10(p(3, tuple(x[i - 2 : i + 1]))) for i in range(2, len(x)))

    return score


@pytest.mark.parametrize(("bucket", "merge_at"), [(1 << 20, 1 << 28), (60, 1 << 28), (60, 100)])
def test_language_model(docs, monkeypatch, bucket, merge_at):
    """Small buckets: hot words are spread over slices, and with a small ``merge_at`` summed up beforehand."""
    monkeypatch.setattr(kneser_ney, "_FLUSH", 300)
    rng = np.random.default_rng(5)
    say = lambda n: " ".join(f"v{min(int(z), 80)}" for z in rng.zipf(1.4, n))
    rows = [(i, say(80), "s") for i in range(30)]
    model, score = kneser_ney.fit_language_model(docs(rows), bucket=bucket, merge_at=merge_at), brute_model([r[1] for r in rows])
    assert (model.words.hot > 0) == (bucket == 60)
    asked = [*rows[:5], (90, "v1 never v2 seen v3", "s"), (91, "v1", "s"), (92, "new words only", "s")]
    for r in kneser_ney.perplexities(docs(asked), model).collect():
        text = next(t for i, t, _ in asked if i == r["doc_id"])
        assert r["log10_prob"] == pytest.approx(score(text), abs=1e-9)
        assert r["n_words"] == len(hashes(text)) + 1 and r["perplexity"] == pytest.approx(10 ** (-score(text) / r["n_words"]))


def test_language_model_sums_to_one(docs):
    texts = ["a b a c a b", "b c a", "c c b a"]
    model = kneser_ney.fit_language_model(docs([(i, t, "s") for i, t in enumerate(texts)]))
    words = [np.uint32(h >> 32) for h in map(lambda w: hashes(w)[0], "abc")] + [kneser_ney._END, np.uint32(12345)]
    a, b = words[0], words[1]
    ids = np.array([x for w in words for x in (a, b, w)], np.uint32)
    assert model.probabilities(ids, np.arange(2, len(ids), 3)).sum() == pytest.approx(1)


def test_language_model_awkward(awkward, empty):
    got = {r["doc_id"]: r for r in kneser_ney.perplexities(awkward, kneser_ney.fit_language_model(awkward)).collect()}
    assert got[2]["perplexity"] is None and got[3]["n_words"] == got[4]["n_words"] == 0 and got[5]["perplexity"] > 1
    model = kneser_ney.fit_language_model(empty)
    assert kneser_ney.perplexities(empty, model).count() == 0
    assert kneser_ney.perplexities(awkward, model).count() == 10
