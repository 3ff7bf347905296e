"""Benchmark decontamination by latent semantic retrieval (operator 10).

Texts are cut into blocks of ``BLOCK`` words; two neighbouring blocks make a
passage. Three scans of the corpus:

1. document frequencies of hashed words over passages;
2. one step of a randomised SVD: Omega' A'A is summed over all passages, with the
   benchmark's own passages weighted to count as much as the corpus. Its columns are
   orthonormalised into the latent axes by their Gram matrix;
3. every passage is projected and compared by cosine to the items whose answer its surroundings can hold, a long item
   passage by passage. Candidates are checked in place, where their words are at hand: the longest common
   subsequence with the item, then its rarest words (its answer).

The sums, the axes and the projected benchmark are tables in the shared folder that workers read for themselves. The
driver gets the frequencies, one small Gram matrix and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import read_shared, small_batches, written, written_to
from corvane.llm.words import word_hashes

BITS, BLOCK, RANK = 16, 24, 64
_WIDE = RANK + 8
_SPOTS = 2
_CACHED = 4096
_SIZE = 1 << BITS
_PARTS = 64
#: Tasks of the second scan join so many ordinary ones: each writes a matrix of fixed size.
_JOINED = 8
_PAIRS = 1 << 16


def _blocks(first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each run of ``span`` words of each text (and the end of the last), and the text of each run."""
    n = np.diff(first)
    per = -(-n // span)
    text = np.repeat(np.arange(len(n)), per)
    start = first[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * span
    return np.r_[start, first[-1]], text


def _feature(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _pieces(a: np.ndarray, side: int = 0) -> pa.RecordBatch:
    """The parts of an array that aren't zero."""
    parts = [(i, x.tobytes()) for i, x in enumerate(np.split(a, _PARTS)) if x.any()]
    return pa.RecordBatch.from_arrays([pa.array([side] * len(parts), pa.int32()), pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["side", "part", "data"])


_PIECES = "side int, part int, data binary"


def _added(parts: DataFrame, dtype, to) -> DataFrame:
    """Sum of the arrays of each side and part, as they come: a task holds its sums, however many arrays there are."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for side, part, data in zip(b["side"].to_pylist(), b["part"].to_pylist(), b["data"]):
                x = np.frombuffer(data.as_buffer(), dtype)
                if (side, part) in total:
                    total[side, part] += x
                else:
                    total[side, part] = x.astype(to)
        for (side, part), x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([side], pa.int32()), pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["side", "part", "data"])

    return parts.repartition("part").mapInArrow(add, _PIECES)


def passage_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Passages in which each hashed word occurs, and the number of passages."""

    def run(batches):
        df, n = np.zeros(_SIZE, np.int64), 0
        for b in batches:
            for _, _, h, first in word_hashes(b["text"], punctuation=False):
                starts, _ = _blocks(first, 2 * BLOCK)
                at = np.repeat(np.arange(len(starts) - 1, dtype=np.int64), np.diff(starts))
                df += np.bincount(np.unique(at << BITS | _feature(h)) & (_SIZE - 1), minlength=_SIZE)
                n += len(starts) - 1
        yield _pieces(df)
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([0], pa.int32()), pa.array([np.int64(n).tobytes()], pa.binary())], names=["side", "part", "data"])

    df, n = np.zeros((_PARTS, _SIZE // _PARTS), np.int64), 0
    for r in _added(texts.mapInArrow(run, _PIECES), np.int64, np.int64).collect():  # _PARTS rows of fixed size and one
        if r["side"]:
            n = int(np.frombuffer(r["data"], np.int64)[0])
        else:
            df[r["part"]] = np.frombuffer(r["data"], np.int64)
    return df.ravel(), n


def _rows(h: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``table`` for the words of each block; some blocks at a time, in a buffer that the cache holds."""
    n, f = len(starts) - 1, _feature(h)
    out = np.empty((n, table.shape[1]), np.float32)
    longest = int(np.diff(starts).max(initial=1))
    some = max(1, _CACHED // longest)
    buffer = np.empty((some * longest, table.shape[1]), np.float32)
    for i in range(0, n, some):
        j = min(n, i + some)
        s, e = starts[i], starts[j]
        rows = np.take(table, f[s:e], axis=0, out=buffer[: e - s], mode="clip")
        np.add.reduceat(rows, starts[i:j] - s, axis=0, out=out[i:j])
    return out


def latent_axes(texts: DataFrame, items: DataFrame, idf: np.ndarray, seed: int = 11) -> str:
    """Path of a table (part, data) of float32 rows for the hashed words: RANK orthonormal axes times idf, so that a passage's latent vector is the
    sum of its words' rows. ``items``: the benchmark's (words), which count as much as all ``texts`` together."""
    idf = idf.astype(np.float32)  # _SIZE values, in the tasks' closures
    rng = np.random.default_rng(seed)
    spots = rng.integers(0, _WIDE, (_SPOTS, _SIZE)).astype(np.int16)  # a sparse sign embedding: a word adds to few columns
    signs = rng.choice(np.array([-1, 1], np.int8), (_SPOTS, _SIZE))

    def step(h, starts, total, signed):
        f, n = _feature(h), len(starts) - 1
        at = np.repeat(np.arange(n), np.diff(starts))
        w = idf[f]
        y = np.zeros(n * _WIDE)
        for k in range(_SPOTS):
            y += np.bincount(at * _WIDE + spots[k][f], signed[k][f], minlength=n * _WIDE)
        norm = np.maximum(np.bincount(at, w * w, minlength=n), 1e-9)  # squared length of the passage's vector
        y = (y.reshape(n, _WIDE) / norm[:, None]).astype(np.float32)
        o = np.argsort(f.astype(np.uint16), kind="stable")  # by radix
        fs, ys = f[o], at[o]
        buffer = np.empty((_CACHED, _WIDE), np.float32)
        for i in range(0, len(fs), _CACHED):
            part = fs[i : i + _CACHED]
            rows = np.take(y, ys[i : i + _CACHED], axis=0, out=buffer[: len(part)], mode="clip")
            begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            total[part[begin]] += np.add.reduceat(rows, begin, axis=0) * idf[part[begin]][:, None]

    def corpus(batches):
        total, signed = np.zeros((_SIZE, _WIDE), np.float32), idf * signs
        for b in batches:
            for _, _, h, first in word_hashes(b["text"], punctuation=False, chunk=1 << 20):
                if len(h):
                    step(h, _blocks(first, 2 * BLOCK)[0], total, signed)
        yield _pieces(total)

    def own(batches):
        total, signed = np.zeros((_SIZE, _WIDE), np.float32), idf * signs
        for b in batches:
            pieces = [p for x in b["words"].to_pylist() for p in _pieces_of(np.frombuffer(x, np.uint64))]
            if pieces:
                step(np.concatenate(pieces), np.r_[0, np.cumsum([len(p) for p in pieces])], total, signed)
        yield _pieces(total, 1)

    cores = texts.sparkSession.sparkContext.defaultParallelism
    tasks = max(2 * cores, texts._jdf.queryExecution().toRdd().getNumPartitions() // _JOINED)
    parts = texts.coalesce(tasks).mapInArrow(corpus, _PIECES).unionByName(items.select("words").coalesce(cores).mapInArrow(own, _PIECES))
    sums = written(_added(parts, np.float32, np.float64).repartition("part"), "latent-sums")

    def both(batches, use):
        """``use`` of each part's rows of the two sides, of those that have any."""
        held: dict[int, list] = {}
        for b in batches:
            for side, part, data in zip(b["side"].to_pylist(), b["part"].to_pylist(), b["data"]):
                held.setdefault(part, [None, None])[side] = np.frombuffer(data.as_buffer(), np.float64).reshape(-1, _WIDE)
        zero = np.zeros((_SIZE // _PARTS, _WIDE))
        for part, (a, b) in held.items():
            yield part, *use(zero if a is None else a, zero if b is None else b)

    def squares(batches):
        c, o = np.zeros((_WIDE, _WIDE)), np.zeros((_WIDE, _WIDE))
        cross = np.zeros((_WIDE, _WIDE))
        for _, x, y in both(batches, lambda a, b: (a, b)):
            c += x.T @ x
            o += y.T @ y
            cross += x.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (c, o, cross)], names=["c", "o", "x"])

    grams = np.zeros((3, _WIDE, _WIDE))
    # both sides of a part are in one partition: coalescing joins partitions whole
    for r in sums.repartition(8, "part").mapInArrow(squares, "c binary, o binary, x binary").collect():  # 8 rows of fixed size
        grams += np.stack([np.frombuffer(x, np.float64).reshape(_WIDE, _WIDE) for x in r])
    scale = float(np.sqrt(np.trace(grams[0]) / max(np.trace(grams[1]), 1e-24)))
    gram = grams[0] + scale * (grams[2] + grams[2].T) + scale**2 * grams[1]
    value, vector = np.linalg.eigh(gram)
    value, vector = value[::-1][:RANK], vector[:, ::-1][:, :RANK]
    turn = vector * np.where(value > 1e-10 * max(value[0], 1e-300), 1 / np.sqrt(np.maximum(value, 1e-300)), 0)

    def axes(batches):
        size = _SIZE // _PARTS
        for part, x in both(batches, lambda a, b: ((a + scale * b) @ turn,)):
            rows = (x * idf[part * size : (part + 1) * size, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rows.tobytes()], pa.binary())], names=["part", "data"])

    return written_to(sums.repartition(8, "part").mapInArrow(axes, "part int, data binary"), "latent-axes")


_held: dict[str, object] = {}


def _once(path: str, make):
    """What ``make`` reads from a table; a worker keeps the last few."""
    if path not in _held:
        while len(_held) > 4:
            _held.pop(next(iter(_held)))
        _held[path] = make()
    return _held[path]


def _axes(path: str) -> np.ndarray:
    def make():
        out, table = np.zeros((_SIZE, RANK), np.float32), read_shared(path)
        size = _SIZE // _PARTS
        for part, data in zip(table["part"].to_pylist(), table["data"].to_pylist()):
            out[part * size : (part + 1) * size] = np.frombuffer(data, np.float32).reshape(size, RANK)
        return out

    return _once(path, make)


def _answers(answer: list[np.ndarray], share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All answer words, sorted; the items of each, and where these begin; of each item, how many different words of its answer make up ``share`` of it."""
    item = np.repeat(np.arange(len(answer)), [len(a) for a in answer])
    word = np.concatenate(answer)
    enough = np.empty(len(answer), np.int64)
    for k, a in enumerate(answer):
        times = np.sort(np.unique(a, return_counts=True)[1])[::-1].cumsum()
        enough[k] = 1 + np.searchsorted(times, share * len(a) - 1e-9)
    o = np.lexsort((item, word))
    word, item = word[o], item[o]
    new = np.r_[True, (word[1:] != word[:-1]) | (item[1:] != item[:-1])]
    word, item = word[new], item[new]
    rare, begin = np.unique(word, return_index=True)
    return rare, item, np.r_[begin, len(word)], enough


def _reach(words: int) -> int:
    """Blocks looked at on either side of a passage for an item of so many words: all of the item, wherever in it the passage lies."""
    return max(2, -(-words // BLOCK))


def _pieces_of(h: np.ndarray) -> list[np.ndarray]:
    """An item as passages: a long one is far from each passage of its copy."""
    return [h] if len(h) <= 4 * BLOCK else np.array_split(h, -(-len(h) // (2 * BLOCK)))


def _likely(h: np.ndarray, starts: np.ndarray, rare: np.ndarray, owners: np.ndarray, begin: np.ndarray, enough: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Sorted keys block * items + item where enough answer words lie within the item's reach of the passage that begins there: elsewhere the answer's check can't hold."""
    at = np.minimum(np.searchsorted(rare, h), len(rare) - 1)
    where = np.flatnonzero(rare[at] == h)
    n = begin[at[where] + 1] - begin[at[where]]
    item = owners[np.repeat(begin[at[where]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    block = np.repeat(np.searchsorted(starts, where, side="right") - 1, n)
    wide = len(starts)  # a word counts for the blocks from lo to before hi
    lo, hi = np.maximum(block - reach[item] - 1, 0), np.minimum(block + reach[item] + 1, wide - 1)
    spot, place = np.unique(np.r_[item * wide + lo, item * wide + hi], return_inverse=True)
    count = np.cumsum(np.bincount(place, np.repeat([1, -1], len(item)), minlength=len(spot))).astype(np.int64)
    good = np.flatnonzero(count >= enough[spot // wide])
    size = spot[good + 1] - spot[good]
    key = np.repeat(spot[good], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.sort(key % wide * len(enough) + key // wide)


def lcs(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel (Hyyro 2004)."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = v = (1 << len(item)) - 1
    for w in words.tolist():
        if m := masks.get(w):
            u = v & m
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


def _benchmark(bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, words) of the items that are searched, each row with a key of its own."""

    def run(batches):
        n, part = 0, TaskContext.get().partitionId()
        for b in batches:
            for i, _, h, first in word_hashes(b["text"], punctuation=False):
                k = np.flatnonzero(np.diff(first) >= 5)
                words = [h[first[x] : first[x + 1]].tobytes() for x in k.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array((part << 32) + n + np.arange(len(k)), pa.int64()), b["id"].take(pa.array(k + i)), pa.array(words, pa.binary())], names=["key", "id", "words"])
                n += len(k)

    kind = bench.schema[id_col].dataType.simpleString()
    lean = bench.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    return lean.mapInArrow(run, f"key long, id {kind}, words binary")


def _projected(items: DataFrame, axes: str, idf: np.ndarray) -> DataFrame:
    """``items`` (key, words) with ``answer``, the rarest quarter of the words, and ``z``, the unit vectors of the passages."""
    idf = idf.astype(np.float32)

    def run(batches):
        table = _axes(axes)
        for b in batches:
            answer, z = [], []
            for x in b["words"].to_pylist():
                h = np.frombuffer(x, np.uint64)
                answer.append(h[np.argsort(-idf[_feature(h)], kind="stable")[: -(-len(h) // 4)]].tobytes())
                v = np.stack([table[_feature(p)].sum(0) for p in _pieces_of(h)])
                z.append((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b["key"], b["words"], pa.array(answer, pa.binary()), pa.array(z, pa.binary())], names=["key", "words", "answer", "z"])

    return items.select("key", "words").mapInArrow(run, "key long, words binary, answer binary, z binary")


class _Items:
    """Some of the benchmark as a worker needs it."""

    def __init__(self, table: pa.Table, min_lcs: float, min_answer: float):
        self.key = table["key"].to_numpy()
        self.words = [np.frombuffer(x, np.uint64) for x in table["words"].to_pylist()]
        self.answer = [np.frombuffer(x, np.uint64) for x in table["answer"].to_pylist()]
        z = [np.frombuffer(x, np.float32).reshape(-1, RANK) for x in table["z"].to_pylist()]
        self.z, self.pieces = np.concatenate(z), np.array([len(x) for x in z])
        self.first_piece = np.cumsum(self.pieces) - self.pieces
        self.rare, self.owners, self.begin, self.enough = _answers(self.answer, min_answer)
        self.reach = np.array([_reach(len(h)) for h in self.words])
        self.need = np.array([min_lcs * len(h) for h in self.words])
        self.sets: dict[int, np.ndarray] = {}

    def words_of(self, k: int) -> np.ndarray:
        """The item's different words, sorted."""
        if k not in self.sets:
            self.sets[k] = np.unique(self.words[k])
        return self.sets[k]

    def cosines(self, block: np.ndarray, item: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Of each pair the greatest cosine of the passage, or its first block alone, and a passage of the item."""
        out = np.empty(len(block), np.float32)
        for s in range(0, len(block), _PAIRS):
            b, k = block[s : s + _PAIRS], item[s : s + _PAIRS]
            n = self.pieces[k]
            first = np.cumsum(n) - n
            piece = self.z[np.repeat(self.first_piece[k] - first, n) + np.arange(n.sum())]
            b = np.repeat(b, n)
            cos = np.maximum(np.einsum("ij,ij->i", one[b], piece), np.einsum("ij,ij->i", two[b], piece))
            out[s : s + _PAIRS] = np.maximum.reduceat(cos, first)
        return out


def _item_chunks(path: str, at_once: int, min_lcs: float, min_answer: float) -> Iterator[_Items]:
    table = _once(path, lambda: read_shared(path))
    for s in range(0, table.num_rows, at_once):
        make = lambda s=s: _Items(table.slice(s, at_once), min_lcs, min_answer)
        yield _once(f"{path}#", make) if table.num_rows <= at_once else make()


def find_leaks(docs: DataFrame, bench: DataFrame, min_cosine: float = 0.35, min_lcs: float = 0.6, min_answer: float = 0.5, items_at_once: int = 100_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(``id_col``, ``item_col``, ``cosine``, ``overlap``, ``start``) of documents that hold a benchmark passage, also paraphrased.

    ``overlap``: share of the item's words in the longest common subsequence with the passage and as many words as the item
    has, ``2 * BLOCK`` at least, on either side, at least ``min_lcs``; ``start``: first word of the passage. Of the quarter of the item's words that are
    rarest in the corpus, its answer, ``min_answer`` must occur there. One row, the best, for a document and item. Items may be of any length.

    Items of fewer than five words match too easily and are not searched, null items neither. Null and empty texts hold
    nothing; null ids of either side are reported as null. Repeated rows are one document, repeated items one item; ids may be of any type that can be grouped. Other
    columns aren't looked at. ``items_at_once``: items that a worker prepares at a time; it changes nothing in the
    result. No rows on either side: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(text_col).alias("text")).filter("text is not null")
    kind, ikind = docs.schema[id_col].dataType, bench.schema[item_col].dataType
    items = written(_benchmark(bench, item_col, item_text), "benchmark")
    if items.isEmpty():
        return spark.createDataFrame([], f"`{id_col}` {kind.simpleString()}, `{item_col}` {ikind.simpleString()}, cosine double, overlap double, start int")
    frequency, passages = passage_frequencies(texts)
    idf = np.log((passages + 1) / (frequency + 1)) + 0.05
    axes = latent_axes(texts, items, idf)
    ready = written_to(_projected(items, axes, idf), "benchmark-vectors")

    def run(batches):
        table = _axes(axes)
        for b in batches:
            best: dict[tuple[int, int], tuple] = {}
            for i, _, h, first in word_hashes(b["text"], punctuation=False, chunk=1 << 20):
                if not len(h):
                    continue
                starts, text = _blocks(first, BLOCK)
                one = _rows(h, starts, table)
                two = one.copy()
                two[:-1][text[1:] == text[:-1]] += one[1:][text[1:] == text[:-1]]
                for v in (one, two):
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                for some in _item_chunks(ready, items_at_once, min_lcs, min_answer):
                    likely = _likely(h, starts, some.rare, some.owners, some.begin, some.enough, some.reach)
                    block, item = likely // len(some.words), likely % len(some.words)
                    cos = some.cosines(block, item, one, two)
                    near = cos >= min_cosine
                    for p, k, c in zip(block[near].tolist(), item[near].tolist(), cos[near].tolist()):
                        d = text[p]
                        s = max(first[d], starts[p] - some.reach[k] * BLOCK)
                        e = min(first[d + 1], starts[p] + (some.reach[k] + 2) * BLOCK)
                        span = h[s:e]
                        own = some.words_of(k)
                        hit = own[np.minimum(np.searchsorted(own, span), len(own) - 1)] == span
                        if hit.sum() < some.need[k]:
                            continue
                        span = span[hit]
                        n = lcs(some.words[k], span)
                        if n < some.need[k] or np.isin(some.answer[k], span).mean() < min_answer:
                            continue
                        new = (n / len(some.words[k]), c, -int(starts[p] - first[d]))
                        at = (i + int(d), int(some.key[k]))
                        if new > best.get(at, (-1.0,)):
                            best[at] = new
            out = [(r, k, c, o, -s) for (r, k), (o, c, s) in best.items()]
            rows = pa.array([x[0] for x in out], pa.int64())
            cols = [pa.array([x[j] for x in out], t) for j, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b["id"].take(rows), *cols], names=["id", "key", "cosine", "overlap", "start"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").mapInArrow(run, f"id {kind.simpleString()}, key long, cosine double, overlap double, start int")
    named = found.join(items.select("key", F.col("id").alias("__item")), "key").select(F.col("id").alias(id_col), F.col("__item").alias(item_col), "cosine", "overlap", "start")
    pick = F.max_by(F.struct("cosine", "overlap", "start"), F.struct("overlap", "cosine", -F.col("start")))
    return named.groupBy(id_col, item_col).agg(pick.alias("m")).select(id_col, item_col, "m.cosine", "m.overlap", "m.start")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Leaks of all items into all documents; see :func:`find_leaks` for nulls, empty texts and repeated rows."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, bench).select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), "overlap", "start")
