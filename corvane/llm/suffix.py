"""Passages that documents repeat, by suffix order (operator 9).

A window of ``least`` words has a key: the least hash of its short grams. Equal windows
have equal keys, so what repeats is found within a key. Stretches of windows of one key are cut from the documents
as segments; only keys of more than one document go on, and of equal segments one. A shard holds whole keys; its
segments are sorted by external induced sorting (:mod:`corvane.llm.induced`), and where neighbouring
suffixes share ``least`` words, and come from different documents, every one of them begins a repeated window.
Windows that overlap or touch are joined to passages.

Between machines go rows of 40 bytes for a segment, about one for 22 words, and the words of the
distinct segments that must be sorted. A task that gets more than ``room`` words, as the key of a hot passage may bring it,
keeps them and all that is as long in files, and in memory a few numbers for each segment and each different word.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import induced
from corvane.llm.induced import _array, packed_order, pieces
from corvane.llm.shared import local_path, shared_dir, small_batches, written
from corvane.llm.words import _tables, combine, mix, word_hashes

_GRAM = 8


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of ``width``."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _segments(h: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(text, key, hash of all words, first window, windows) of the segments of texts in one run of hashes."""
    if len(h) < least:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z.astype(np.uint64), z, z
    g = h
    for s in (1, 2, 4):
        g = combine(g[:-s], g[s:])
    key = _slide(g, least - _GRAM + 1)
    at = np.arange(len(key))
    text = np.searchsorted(first, at, side="right") - 1
    ok = at + least <= first[text + 1]
    edge = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])]
    begin = np.flatnonzero(edge & ok)
    end = np.flatnonzero(ok & np.r_[edge[1:], True] | ok & ~np.r_[ok[1:], False]) + 1
    up, down = _tables(len(h) + 1)
    with np.errstate(over="ignore"):
        total = np.r_[np.uint64(0), np.cumsum(mix(h) * up[: len(h)], dtype=np.uint64)]
        whole = mix((total[end + least - 1] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return text[begin], key[begin], whole, begin - first[text[begin]], end - begin


class _Words:
    """The words of a shard's segments, in a file once there are more than ``room``."""

    def __init__(self, room: int, base: str):
        self.room, self.base, self.folder, self.file = room, base, None, None
        self.held: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.n = 0

    def add(self, words: np.ndarray) -> None:
        self.held.append(words)
        self.sizes.append(len(words))
        self.n += len(words) + 1
        if self.n > self.room and self.file is None:
            os.makedirs(folder := f"{local_path(self.base)}/suffixes-{uuid.uuid4().hex}")
            self.folder, self.file = folder, open(f"{folder}/words", "wb")
        if self.file and len(self.held) > 256:
            self._write()

    def _write(self) -> None:
        for w in self.held:
            w.tofile(self.file)
        self.held = []

    def text(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The segments' words as one text of ranks, each segment ended by a symbol of its own, the last by 0; the segments' sizes and first places."""
        sizes = np.array(self.sizes, np.int64)
        if self.file:
            self._write()
            self.file.close()
            words = np.asarray(np.memmap(f"{self.folder}/words", np.uint32, "r"))
        else:
            words = np.concatenate(self.held)
            self.held = []
        kinds = np.zeros(0, np.uint32)
        for s in pieces(len(words)):
            kinds = np.union1d(kinds, words[s])
        n, starts = len(sizes), np.cumsum(sizes + 1) - sizes - 1
        text = _array(self.folder, "text", self.n, np.int32 if n + len(kinds) < 1 << 31 else np.int64)
        first = np.cumsum(sizes) - sizes
        for s in pieces(len(words)):
            at = np.arange(s.start, s.stop)
            owner = np.searchsorted(first, at, side="right") - 1
            text[at + owner] = np.searchsorted(kinds, words[s]) + n
        for s in pieces(n):
            text[starts[s] + sizes[s]] = np.arange(n - 1 - s.start, n - 1 - s.stop, -1)
        return text, sizes, starts

    def close(self) -> None:
        if self.file:
            self.file.close()
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


def _marked(order: np.ndarray, starts: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int, folder: str | None) -> np.ndarray:
    """Of every place whether its suffix shares ``least`` symbols with one of another document; a group of such suffixes may go on from piece to piece."""
    groups = sum(int(((order[s] & 63) < least).sum()) for s in pieces(len(order)))
    low, high = _array(folder, "group-low", groups, np.int64), _array(folder, "group-high", groups, np.int64)
    done = 0
    for s in pieces(len(order)):
        seg = np.searchsorted(starts, order[s] >> 6, side="right") - 1
        head = (order[s] & 63) < least
        begin = np.flatnonzero(head)
        if not len(begin) or begin[0]:  # the group before goes on
            stop = begin[0] if len(begin) else len(head)
            low[done - 1], high[done - 1] = min(low[done - 1], lo[seg[:stop]].min()), max(high[done - 1], hi[seg[:stop]].max())
        if len(begin):
            low[done : done + len(begin)], high[done : done + len(begin)] = np.minimum.reduceat(lo[seg], begin), np.maximum.reduceat(hi[seg], begin)
            done += len(begin)
    mark = _array(folder, "marks", len(order), np.uint8)
    for s in pieces(len(mark)):
        mark[s] = 0
    done = 0
    for s in pieces(len(order)):
        group = done - 1 + np.cumsum((order[s] & 63) < least)
        mark[(order[s] >> 6)[low[group] != high[group]]] = 1
        done = int(group[-1]) + 1
    return mark


def _repeats(least: int, room: int, base: str):
    """For the segments of a shard: (key, whole, first window, windows) of the runs that other documents have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: dict[str, list] = {c: [] for c in ("v", "sh", "lo", "hi", "len")}
        words = _Words(room, base)
        try:
            for b in batches:
                for c in cols:
                    cols[c].append(b[c].to_numpy())
                for x in b["words"]:
                    words.add(np.frombuffer(x.as_buffer(), np.uint32))
            if not words.sizes:
                return
            v, sh, lo, hi, owned = (np.concatenate(cols[c]) for c in cols)
            text, sizes, starts = words.text()
            order = packed_order(text, least, room, words.folder)
            mark = _marked(order, starts, lo, hi, least, words.folder)
            n, i = len(sizes), 0
            while i < n:  # whole segments at a time
                j = max(i + 1, int(np.searchsorted(starts, starts[i] + induced._STEP)))
                size = sizes[i:j] + 1
                owner = np.repeat(np.arange(i, j), size)
                inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
                hit = (mark[starts[i] : starts[i] + len(owner)] != 0) & (inside < owned[owner])
                new = np.r_[True, owner[1:] != owner[:-1]]
                edge = np.flatnonzero(hit & (new | np.r_[True, ~hit[:-1]]))
                stop = np.flatnonzero(hit & (np.r_[new[1:], True] | np.r_[~hit[1:], True])) + 1
                s = owner[edge]
                yield pa.RecordBatch.from_pydict({"v": pa.array(v[s]), "sh": pa.array(sh[s]), "at": pa.array(inside[edge].astype(np.int32)), "n": pa.array((stop - edge).astype(np.int32))})
                i = j
        finally:
            words.close()

    return run


def repeated_passages(docs: DataFrame, least: int = 50, shard_words: int = 1 << 21, room: int = 1 << 23, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``start``, ``n_words``): passages of at least ``least`` words (9 to 62) that another document has too.

    Exact: a word is in a passage if it is in a window of ``least`` words that occurs in two documents. Words are folded in case and
    stripped of punctuation, ``start`` counts them from 0. Windows that overlap or touch are one passage. ``shard_words``: words that a
    shard is meant to have (a key is never divided); ``room``: suffixes held in memory, beyond that all that is as long as the shard is in files.

    Null ids, null texts and texts of fewer than ``least`` words have none. Rows of one id are one document, what they alone repeat
    is not reported; a passage is then given by its place in either row. No rows: no rows. Other columns aren't looked at. Ids are integers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lean = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), text_col).alias("rk"), F.col(text_col).alias("text")).filter("id is not null and text is not null")

    def cut(batches):
        for b in batches:
            ids, rks = b["id"].to_numpy(), b["rk"].to_numpy()
            for i, _, h, first in word_hashes(b["text"], punctuation=False):
                text, key, whole, at, n = _segments(h, first, least)
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[text + i]), "rk": pa.array(rks[text + i]), "v": pa.array(key.astype(np.int64)), "sh": pa.array(whole.astype(np.int64)), "a": pa.array(at.astype(np.int32)), "len": pa.array(n.astype(np.int32))})

    rows = lean.mapInArrow(cut, "id long, rk long, v long, sh long, a int, len int")
    by_key = Window.partitionBy("v")
    segs = rows.withColumns({"__lo": F.min("id").over(by_key), "__hi": F.max("id").over(by_key)}).filter("__lo < __hi").drop("__lo", "__hi")
    segs = written(segs, "segments")
    kinds = segs.groupBy("v", "sh").agg(F.min(F.struct("rk", "a", "len")).alias("one"), F.min("id").alias("lo"), F.max("id").alias("hi")).withColumn("kinds", F.count("*").over(by_key))
    kinds = written(kinds, "segment-kinds")
    alone = kinds.filter("kinds = 1").select("v", "sh", F.lit(0).alias("at"), F.col("one.len").alias("n"))  # its only segment is that of two documents
    sort = kinds.filter("kinds > 1").select("v", "sh", "lo", "hi", "one.rk", "one.a", "one.len")
    total = sort.agg(F.sum(F.col("len").cast("long") + least)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_words))
    wanted = sort.groupBy("rk").agg(F.collect_list(F.struct("v", "sh", "lo", "hi", "a", "len")).alias("segs"))

    def take(batches):
        for b in batches:
            segs = b["segs"].to_pylist()
            for i, j, h, first in word_hashes(b["text"], punctuation=False):
                out = [(s["v"], s["sh"], s["lo"], s["hi"], s["len"], (h[(p := first[r - i] + s["a"]) : p + s["len"] + least - 1] >> np.uint64(32)).astype(np.uint32).tobytes()) for r in range(i, j) for s in segs[r]]
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_pydict({**{c: pa.array(x, pa.int64()) for c, x in zip(("v", "sh", "lo", "hi"), cols)}, "len": pa.array(cols[4], pa.int32()), "words": pa.array(cols[5], pa.binary())})

    held = lean.join(wanted, "rk").select("text", "segs").mapInArrow(take, "v long, sh long, lo long, hi long, len int, words binary")
    base = shared_dir(spark)  # only a shard beyond room needs it to be a mounted folder
    flags = held.repartition(shards, "v").mapInArrow(_repeats(least, room, base), "v long, sh long, at int, n int")
    flags = written(flags.unionByName(alone), "repeats")
    runs = segs.join(flags, ["v", "sh"]).select("id", (F.col("a") + F.col("at")).alias("p"), (F.col("a") + F.col("at") + F.col("n") + (least - 1)).alias("e"))
    order = Window.partitionBy("id").orderBy("p", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.withColumn("new", F.when(F.col("p") <= before, 0).otherwise(1)).withColumn("k", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("id", "k").agg(F.min("p").alias("start"), F.max("e").alias("e")).select(F.col("id").alias(id_col), "start", (F.col("e") - F.col("start")).alias("n_words"))


def op9_repeated_passages(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents; see :func:`repeated_passages` for nulls, short texts and repeated rows."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
