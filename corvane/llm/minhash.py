"""MinHash near-duplicates by a chosen-path set-similarity join (operator 7).

After Christiani and Pagh (2017) and the CPSJoin of Christiani, Pagh and
Sivertsen (2018). A document is the set of its word shingles, sketched by
``WIDTH`` minwise values. A tree starts with all documents in one node. At a node
a few of the sketch positions are chosen at random, the same for all documents
there, and for each chosen one the node branches by the value at that position:
similar documents stay together with a probability of their similarity at every
branch. Small nodes are compared exhaustively. In a larger one a few pivots are compared with all; where they leave
only few documents outside its largest group, these are compared with all, and otherwise it branches on: documents so
alike that no branch parts them are thus connected at once. Independent
trees are repeated until a pair at the threshold is met with the target recall.

A document can work out its own path, so a level costs one count of node sizes
over (node, document) pairs of 16 bytes. To the nodes that are compared go only sketches
cut to a byte a value (Li and Koenig 2010), 128 bytes a document. Pairs that these
leave in doubt are confirmed by the exact Jaccard coefficient.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.shared import small_batches, written
from corvane.llm.words import combine, mix, word_hashes

WIDTH = 128
_ALL_PAIRS, _ROWS_HELD = 24, 1 << 15
_PIVOTS, _CHUNKS, _BLOCK, _IDS = 64, 4, 512, 1 << 20
_EMPTY = np.uint64(0x5DEECE66D)


def _seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt) * np.uint64(0x1000003D))


def _wholes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each text's words."""
    n = np.diff(first)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(int(n.max(initial=0)) + 1, np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)
        place = np.arange(len(h)) - np.repeat(first[:-1], n)
        total = np.r_[np.uint64(0), np.cumsum(mix(h ^ up[place]), dtype=np.uint64)]
        return mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64))


def _shingles(h: np.ndarray, first: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and how many each text has."""
    sh = h
    for k in range(1, shingle):
        sh = combine(sh[:-1], h[k:]) if len(sh) > 1 else sh[:0]
    ok = np.ones(len(sh), bool)  # shingles within one text
    for b in first[1:-1]:
        ok[max(0, b - shingle + 1) : b] = False
    return sh[ok], np.maximum(np.diff(first) - shingle + 1, 0)


def sketches(col: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past-the-end row, sketch of each row (uint32), hash of each row's words)."""
    seeds = _seeds(WIDTH, 1)
    for i, j, h, first in word_hashes(col, punctuation=False):
        whole = _wholes(h, first)
        sh, per = _shingles(h, first, shingle)
        sig = np.empty((len(per), WIDTH), np.uint32)
        full = per > 0
        sig[~full] = (mix(whole[~full] ^ _EMPTY)[:, None] ^ seeds[None, :] >> np.uint64(7)).astype(np.uint32)  # too short: equal only to itself
        if full.any():
            start = np.r_[0, np.cumsum(per[full])[:-1]]
            low = (sh ^ sh >> np.uint64(32)).astype(np.uint32)
            odd = (seeds | np.uint64(1)).astype(np.uint32)
            for k in range(WIDTH):
                with np.errstate(over="ignore"):
                    x = (low ^ np.uint32(seeds[k] >> np.uint64(33))) * odd[k]
                    x ^= x >> np.uint32(15)
                    x *= np.uint32(0x2C1B3C6D)
                    x ^= x >> np.uint32(13)
                sig[full, k] = np.minimum.reduceat(x, start)
        yield i, j, sig, whole


def _stack(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, WIDTH)


def _agreements(sigs: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """In how many of the WIDTH bytes each column agrees with ``sig``; a byte holds the sum."""
    return np.add.reduce((sigs == sig[:, None]).view(np.uint8), axis=0, dtype=np.uint8)


def _alike(ids: np.ndarray, sig: np.ndarray, bounds: np.ndarray, need: int, sure: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges within the runs of rows between ``bounds``, ids rising in each: all pairs of a small run that agree in ``need`` values, and whether
    in ``sure``; of a large one the sure ones that connect it the same, and of the others those they don't connect."""
    size = np.diff(bounds)
    small = np.flatnonzero((size > 1) & (size <= _ALL_PAIRS))
    left, right = [], []
    for n in np.unique(size[small]):  # all pairs of all runs of one size at once
        i, j = np.triu_indices(n, 1)
        first = bounds[small[size[small] == n]]
        left.append((first[:, None] + i).ravel())
        right.append((first[:, None] + j).ravel())
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    same = np.concatenate([np.add.reduce((sig[i[s : s + 8192]] == sig[j[s : s + 8192]]).T.copy().view(np.uint8), axis=0, dtype=np.uint8) for s in range(0, len(i), 8192)]) if len(i) else np.zeros(0, np.uint8)
    hit = (same >= need) & (ids[i] != ids[j])
    a, b, safe = [ids[i[hit]]], [ids[j[hit]]], [same[hit] >= sure]
    for r in np.flatnonzero(size > _ALL_PAIRS):
        own, table = ids[bounds[r] : bounds[r + 1]], np.ascontiguousarray(sig[bounds[r] : bounds[r + 1]].T)
        group = np.arange(len(own))
        for i in range(len(own) - 1):  # a pair already connected needs no comparison
            apart = group[i + 1 :] != group[i]
            n = np.count_nonzero(apart)
            if not n:
                continue
            todo = np.flatnonzero(apart) + i + 1 if 4 * n < len(apart) else np.arange(i + 1, len(own))
            same = _agreements(table[:, todo] if len(todo) < len(apart) else table[:, i + 1 :], table[:, i])
            hit = todo[(same >= sure) & apart[todo - i - 1]]
            if len(hit):
                met, at = np.unique(group[hit], return_index=True)  # one edge to each group met
                a.append(np.full(len(at), own[i]))
                b.append(own[hit[at]])
                safe.append(np.ones(len(at), bool))
                group[np.isin(group, met)] = group[i]
            hit = todo[(same >= need) & (same < sure)]
            hit = hit[group[hit] != group[i]]
            a.append(np.full(len(hit), own[i]))
            b.append(own[hit])
            safe.append(np.zeros(len(hit), bool))
    return np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64), np.concatenate(safe)


def _branches(node: np.ndarray, sig: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) of every branch: the positions are chosen by the node alone."""
    with np.errstate(over="ignore"):
        draw = mix(node[:, None] + np.arange(WIDTH, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    row, at = np.nonzero(draw < np.uint64(chance * 2**64))
    return row, combine(draw[row, at], sig[row, at].astype(np.uint64))


def trees_for(recall: float, threshold: float, rate: float, depth: int = 2) -> int:
    """Trees after which a pair at the threshold has been together at ``depth`` with the target recall (a branching process with Poisson offspring of mean ``rate * threshold``)."""
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(rate * threshold * (lost - 1))
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def near_duplicate_edges(sketched: DataFrame, threshold: float, recall: float, rate: float, small: int, max_depth: int) -> DataFrame:
    """(a, b, sure) of sketched rows (id, sig, low: a byte of each value): pairs that by the sketches may have a similarity of ``threshold`` and, with those they
    imply, connect what the trees brought together. The others, not ``sure``, are nearer to the threshold than the sketches can tell."""
    spark = sketched.sparkSession
    trees = trees_for(recall, threshold, rate, max_depth + 2)
    chance = rate / WIDTH
    roots = _seeds(trees, 77)

    def first(batches):  # two levels at once: with one alone, nodes of common shingles grow with the corpus
        for b in batches:
            sig = _stack(b["sig"].to_pylist())
            ids = b["id"].to_numpy()
            for r in roots:
                row, child = _branches(np.full(len(b), r), sig, chance)
                deep, child = _branches(child, sig[row], chance)
                yield pa.RecordBatch.from_arrays([pa.array(child.astype(np.int64)), pa.array(ids[row[deep]])], names=["node", "id"])

    def deeper(batches):  # by a byte of each value, which is at hand here
        for b in batches:
            sig = np.frombuffer(b"".join(b["low"].to_pylist()), np.uint8).reshape(-1, WIDTH)
            row, child = _branches(b["node"].to_numpy().astype(np.uint64), sig, chance)
            yield pa.RecordBatch.from_arrays([pa.array(child.astype(np.int64)), pa.array(b["id"].to_numpy()[row])], names=["node", "id"])

    error = math.sqrt(threshold * (1 - threshold) / WIDTH)
    by_chance = lambda t: math.ceil((t + (1 - t) / 256) * WIDTH)  # noqa: E731  unequal values agree in a byte by chance
    need = max(1, by_chance(threshold - 2 * error))
    sure = by_chance(threshold + 4 * error) if threshold + 4 * error <= 1 else WIDTH + 1

    def compare(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def edges(last: bool):
            """Pairs of the nodes that are whole, and the rows of the last one, which may go on."""
            table = pa.Table.from_batches(held)
            keys = [table[c].to_numpy() for c in ("node", "x", "y")]
            begin = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
            stop = table.num_rows if last else int(begin[-1])
            begin = begin[begin < stop]
            ids = table["id"].to_numpy()[:stop]
            sig = np.frombuffer(b"".join(table["low"].slice(0, stop).to_pylist()), np.uint8).reshape(-1, WIDTH)
            out = _alike(ids, sig, np.r_[begin, stop], need, sure)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["a", "b", "sure"]), table.slice(stop).to_batches()

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= _ROWS_HELD:
                out, held = edges(False)
                rest = sum(x.num_rows for x in held)
                rows = 0 if rest < _ROWS_HELD else -rest  # a node larger than that is looked at again when it has doubled
                yield out
        if held:
            yield edges(True)[0]

    def compared(rows: DataFrame) -> DataFrame:
        """Edges within each (node, x, y) of rows with sketches."""
        ordered = rows.select("node", "x", "y", "id", "low").repartition("node", "x", "y").sortWithinPartitions("node", "x", "y", "id")
        return ordered.mapInArrow(compare, "a long, b long, sure boolean")

    zero = F.lit(0)
    low = sketched.select("id", "low")
    out: list[DataFrame] = []
    leaves: DataFrame | None = None
    at = sketched.mapInArrow(first, "node long, id long")
    for depth in range(max_depth + 1):
        level = written(at, "paths")
        kept = level.join(level.groupBy("node").count().filter("count > 1"), "node")
        few = kept.filter(F.col("count") <= small).select("node", "id")
        leaves = few if leaves is None else leaves.unionByName(few)
        large = kept.filter(F.col("count") > small)
        if large.isEmpty():
            break
        # blocks of a large node by a hash of the id: no task sees a whole node
        large = large.withColumn("nb", F.ceil(F.col("count") / F.lit(small)).cast("int")).join(low, "id")
        large = written(large.withColumn("y", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).select("node", "nb", "y", "id", "low"), "large-nodes")
        nth = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64(F.col("id"), F.lit(3)), "id"))
        pivots = large.withColumn("nth", nth).filter(F.col("nth") <= _PIVOTS)  # every task keeps that many before the shuffle
        spread = pivots.select("node", F.explode(F.sequence(zero, F.col("nb") - 1)).alias("y"), zero.alias("kind"), "id", "low")
        both = spread.unionByName(large.select("node", "y", F.lit(1).alias("kind"), "id", "low")).repartition("node", "y").sortWithinPartitions("node", "y", "kind", "id")
        joined = written(both.mapInArrow(_to_pivots(sure), "node long, id long, to long"), "to-pivots")
        out.append(joined.filter("to <> id").select(F.col("id").alias("a"), F.col("to").alias("b"), F.lit(True).alias("sure")))
        main = joined.filter("to is not null").groupBy("node", "to").count().groupBy("node").agg(F.max_by("to", F.struct("count", "to")).alias("main"))
        rest = joined.join(main, "node", "left").filter("main is null or to is null or to <> main").select("node", "id").distinct()
        rest = written(rest.join(large, ["node", "id"]), "rest-of-nodes")
        chunks = rest.groupBy("node").agg(F.count("*").alias("n"))
        chunks = written(chunks.select("node", F.ceil(F.col("n") / F.lit(small)).cast("int").alias("nr")), "rest-sizes")  # a row a large node
        done = chunks if depth == max_depth else chunks.filter(F.col("nr") <= _CHUNKS)
        rest = rest.join(done, "node").withColumn("x", F.pmod(F.xxhash64(F.col("id"), F.lit(5)), F.col("nr")).cast("int"))
        left = rest.select("node", "x", F.explode(F.sequence(zero, F.col("nb") - 1)).alias("y"), F.col("y").alias("own"), "id", "low").filter("y <> own").drop("own")
        right = large.join(done, "node").select("node", F.explode(F.sequence(zero, F.col("nr") - 1)).alias("x"), "y", "id", "low")
        out.append(compared(left.unionByName(right)))
        at = large.join(chunks.filter(F.col("nr") > _CHUNKS), "node").select("node", "id", "low").mapInArrow(deeper, "node long, id long")
    out.append(compared(leaves.select("node", zero.alias("x"), zero.alias("y"), "id").join(low, "id")))
    return reduce(DataFrame.unionByName, out).distinct()


def _to_pivots(sure: int):
    """For rows (node, y, kind, id, low), pivots (kind 0) first: (node, id, to), where ``to`` is the least pivot of a group of pivots that
    the document surely belongs to, one row for each such group; null where there is none. Pivots that are surely alike are one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot, sigs, group, closed = None, [], [], None, False
        for b in batches:
            node, y, kind, ids = (b[c].to_numpy() for c in ("node", "y", "kind", "id"))
            sig = np.frombuffer(b"".join(b["low"].to_pylist()), np.uint8).reshape(-1, WIDTH)
            cut = np.flatnonzero((node[1:] != node[:-1]) | (y[1:] != y[:-1]) | (kind[1:] != kind[:-1])) + 1
            rows = []
            for s, e in zip(np.r_[0, cut], np.r_[cut, len(node)]) if len(node) else ():
                if key != (node[s], y[s]) or closed and not kind[s]:
                    key, pivot, sigs, closed = (node[s], y[s]), [], [], False
                if not kind[s]:
                    pivot.append(ids[s:e])
                    sigs.append(sig[s:e])
                    continue
                if not closed:
                    closed, p, table = True, np.concatenate(pivot), np.ascontiguousarray(np.concatenate(sigs).T)
                    group = p.copy()
                    for i in range(len(p)):
                        met = np.unique(group[_agreements(table, table[:, i]) >= sure])
                        if len(met):
                            group[np.isin(group, np.r_[met, group[i]])] = min(met.min(), group[i])
                for i in range(s, e):
                    to = np.unique(group[_agreements(table, sig[i]) >= sure])
                    rows += [(node[s], ids[i], t) for t in to.tolist()] or [(node[s], ids[i], None)]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "id", "to"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, group) of all ids in ``edges`` (a, b): group is the least id of the connected component.

    Alternating large-star and small-star steps (Kiveris et al. 2014); each step is a written table.
    """
    spark = edges.sparkSession
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        low = F.least(F.col("a"), F.min("b").over(Window.partitionBy("a")))
        large = both(now).withColumn("m", low).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        nxt = written(small, "edges")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = nxt
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("id"), F.col("b").alias("group")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("group"))).distinct()


def _ids(ids: DataFrame) -> DataFrame:
    """Ids to join with wide rows: at most _IDS of them are broadcast, so that the rows stay where they are; more are shuffled with the rows."""
    return F.broadcast(ids) if ids.limit(_IDS + 1).count() <= _IDS else ids


def _confirmed(pairs: DataFrame, lean: DataFrame, heads: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets of shingles have a Jaccard coefficient of ``threshold`` at least."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")

    def sets(batches):
        for b in batches:
            for i, j, h, first in word_hashes(b["text"], punctuation=False):
                sh, per = _shingles(h, first, shingle)
                own = [np.unique(x).tobytes() for x in np.split(sh, np.cumsum(per)[:-1])]
                yield pa.RecordBatch.from_arrays([b["id"].slice(i, j - i), pa.array(_wholes(h, first).astype(np.int64)), pa.array(own, pa.binary())], names=["id", "whole", "set"])

    def alike(batches):
        """Sets of a block of a group of pairs come first, then its pairs."""
        key, sets = None, {}
        for b in batches:
            out = []
            for *now, kind, x, y, data in zip(*(b[c].to_pylist() for c in ("group", "x", "y", "kind", "a", "b", "set"))):
                if now != key:
                    key, sets = now, {}
                if not kind:
                    sets[x] = np.frombuffer(data, np.uint64)
                elif x in sets and y in sets:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if both and both >= threshold * (len(sets[x]) + len(sets[y]) - both):
                        out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    held = lean.join(_ids(wanted), "id", "left_semi").mapInArrow(sets, "id long, whole long, set binary")
    held = written(held.join(heads, ["id", "whole"], "left_semi").dropDuplicates(["id"]).select("id", "set"), "sets")  # of an id's rows the one that was sketched
    # a set goes once to each block of its group of pairs, not with every pair
    groups = components(pairs)
    size = groups.groupBy("group").agg(F.ceil(F.count("*") / F.lit(_BLOCK)).alias("nb"))
    at = written(groups.join(size, "group").select("id", "group", F.pmod(F.xxhash64("id"), F.col("nb")).alias("sub")), "places")
    side = lambda c: at.select(F.col("id").alias(c), F.col("group").alias("group"), F.col("sub").alias(f"s{c}"))
    placed = pairs.join(side("a"), "a").join(side("b").drop("group"), "b").select("group", F.least("sa", "sb").alias("x"), F.greatest("sa", "sb").alias("y"), "a", "b")
    placed = written(placed, "placed-pairs")
    needed = placed.select("group", "x", "y", F.explode(F.array("a", "b")).alias("id")).distinct().join(held, "id")
    none = F.lit(None)
    both = needed.select("group", "x", "y", F.lit(0).alias("kind"), F.col("id").alias("a"), none.cast("long").alias("b"), "set")
    both = both.unionByName(placed.select("group", "x", "y", F.lit(1).alias("kind"), "a", "b", none.cast("binary").alias("set")))
    return both.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "kind").mapInArrow(alike, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = 0.5, shingle: int = 2, recall: float = 0.95, rate: float = 3.0, small: int = 4096, max_depth: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``group_id``, ``n_links`` and ``keep`` of every document that has a near duplicate.

    Similarity is the Jaccard coefficient of the sets of ``shingle``-word shingles, words folded in case and stripped of
    punctuation: estimated by 128 minwise values and, within -2 to +4 standard errors of the threshold, confirmed by the sets themselves. Copies (equal words) are grouped before the join and always found.
    A group is a connected component; ``group_id`` is its least id, the one with ``keep``. ``n_links``: links of the document's text to different
    texts that connect the group; a pair that others connect already isn't looked at. Copies have the links of their text, 0 if the group has no other.

    Null ids and null texts take no part. Texts without words are copies of each other. Texts shorter than a shingle
    are only copies. Ids are integers. Rows of one id are one document: repeated ones count once, and of different texts that
    whose words have the least hash. No rows: no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lean = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")

    def sketch(batches):
        for b in batches:
            for i, j, sig, whole in sketches(b["text"], shingle):
                yield pa.RecordBatch.from_arrays([b["id"].slice(i, j - i), pa.array(whole.astype(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())], names=["id", "whole", "sig", "low"])

    all_ = written(lean.mapInArrow(sketch, "id long, whole long, sig binary, low binary"), "sketches")
    several = all_.groupBy("id").agg(F.min("whole").alias("chosen"), F.max("whole").alias("other"), F.count("*").alias("rows")).filter("rows > 1")
    several = written(several, "repeated-ids")
    if not several.isEmpty():  # one row, and one text, an id
        again = all_.join(_ids(several.select("id")), "id", "left_semi").join(several, "id").filter("whole = chosen").dropDuplicates(["id"])
        all_ = written(all_.join(_ids(several.select("id")), "id", "left_anti").unionByName(again.select(*all_.columns)), "sketches")
    heads = written(all_.groupBy("whole").agg(F.min("id").alias("head"), F.count("*").alias("n")).filter("n > 1"), "copies")
    copies = written(all_.select("id", "whole").join(heads, "whole").filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")), "copies")
    one = written(all_.join(_ids(copies.select(F.col("b").alias("id"))), "id", "left_anti"), "heads")
    edges = written(near_duplicate_edges(one.select("id", "sig", "low"), threshold, recall, rate, small, max_depth), "alike")
    sure = copies.unionByName(edges.filter("sure").select("a", "b"))
    near = edges.filter("not sure").select("a", "b").distinct()
    if not near.isEmpty():  # those that the sure ones connect needn't be looked at
        at = written(components(sure), "groups")
        side = lambda c: at.select(F.col("id").alias(c), F.col("group").alias(f"g{c}"))
        near = near.join(side("a"), "a", "left").join(side("b"), "b", "left").filter("coalesce(ga, a) <> coalesce(gb, b)").select("a", "b")
        sure = sure.unionByName(_confirmed(written(near, "unsure"), lean, one.select("id", "whole"), threshold, shingle))
    sure = written(sure, "links")
    groups = components(sure)
    texts = copies.select(F.col("b").alias("id"), F.col("a").alias("text_id"))  # copies, and whose text they have
    links = sure.join(copies, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("text_id")).groupBy("text_id").agg(F.count("*").alias("n"))
    out = groups.join(texts, "id", "left").withColumn("text_id", F.coalesce("text_id", "id")).join(links, "text_id", "left")
    return out.select(F.col("id").alias(id_col), F.col("group").alias("group_id"), F.coalesce("n", F.lit(0)).alias("n_links"), (F.col("id") == F.col("group")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """``docs`` less every near duplicate but one of each group, the one of the least id. Rows that take no part stay; of rows repeated entirely each stays."""
    gone = near_duplicates(docs, id_col=id_col, **kw).filter("not keep").select(F.col(id_col).alias("__gone"))
    gone = written(gone, "duplicates")
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Groups of near duplicates of all documents; see :func:`near_duplicates` for nulls, empty texts and repeated rows."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
