"""Exact top-k search by a vector-approximation file (operator 1).

After Weber, Schek and Blott (1998). Every vector is kept a second time as one
cell number of a byte for each dimension, with its distance from the centre of
its cell. The approximations, a quarter of the exact bytes, are scanned: by the triangle
inequality a vector is no nearer than its cell's centre less that distance and no
farther than the two added. The kth least upper bound that a task has met so far settles which vectors can
still be among the k; exact vectors are then read in the order of their lower
bounds, twice as many in each round, until the kth exact distance is below every bound that is left.

The scan is a Cartesian product of two tables of blocks, each task one pair of
partitions read from the shared folder: nothing is shuffled or broadcast there. A task sends on hardly more than k rows for a
query, whatever it scans. Only these (query, candidate, bounds) rows are shuffled, and exact vectors to the
candidates that are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.shared import written

_LEVELS = 256


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, one for each id, v an array of float."""
    v = F.col(vec_col).cast("array<float>")
    ok = v.isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0)
    ok = ok & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > F.lit(1e18).cast("float")))
    rows = vectors.filter(ok).select(F.col(id_col).alias("id"), v.alias("v"))
    rows = written(rows.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (common["d"] if common else 0))


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), np.float32).reshape(len(col), -1)


def _ranges(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value in each dimension."""

    def run(batches):
        low = high = None
        for b in batches:
            if len(b):
                m = _matrix(b["v"])
                low = m.min(0) if low is None else np.minimum(low, m.min(0))
                high = m.max(0) if high is None else np.maximum(high, m.max(0))
        if low is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(low)), pa.int32()), "lo": pa.array(low, pa.float32()), "hi": pa.array(high, pa.float32())})

    got = rows.select("v").mapInArrow(run, "i int, lo float, hi float").groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("i").collect()  # one row a dimension
    return np.array([r["lo"] for r in got], np.float64), np.array([r["hi"] for r in got], np.float64)


def _blocks(rows: DataFrame, low: np.ndarray, high: np.ndarray, block: int, exact: bool) -> DataFrame:
    """Blocks of at most ``block`` vectors: ids, and exact values or (cells, distances from the centres)."""
    step = np.maximum((high - low) / _LEVELS, 1e-30)

    def pack(ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        if exact:
            data, rest = m.tobytes(), b""
        else:
            cells = np.clip(np.floor((m - low) / step), 0, _LEVELS - 1).astype(np.uint8)
            centre = low + (cells + 0.5) * step
            far = np.nextafter(np.sqrt(((m - centre) ** 2).sum(1)).astype(np.float32) * np.float32(1 + 1e-6), np.float32(np.inf))
            data, rest = cells.tobytes(), far.tobytes()
        return pa.RecordBatch.from_pydict({"ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([data], pa.binary()), "far": pa.array([rest], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ms, n = [], [], 0
        for b in batches:
            if not len(b):
                continue
            ids.append(b["id"].to_numpy(zero_copy_only=False).astype(np.int64))
            ms.append(_matrix(b["v"]))
            n += len(b)
            if n >= block:
                i, m = np.concatenate(ids), np.concatenate(ms)
                whole = n - n % block
                for s in range(0, whole, block):
                    yield pack(i[s : s + block], m[s : s + block])
                ids, ms, n = [i[whole:]], [m[whole:]], n - whole
        if n:
            yield pack(np.concatenate(ids), np.concatenate(ms))

    return rows.mapInArrow(run, "ids binary, data binary, far binary")


def _bounded(low: np.ndarray, high: np.ndarray, k: int, rows_at_once: int):
    """For the pairs of blocks of a task: (query, candidate, lower and upper bound of the distance) of what can be among the k nearest of what the task has scanned."""
    step = np.maximum((high - low) / _LEVELS, 1e-30)
    dim = len(low)

    class Queries:
        """A block of queries, the k least upper bounds of each, and the candidates so far."""

        def __init__(self, ids: bytes, data: bytes):
            self.key = ids
            self.ids, m = np.frombuffer(ids, np.int64), np.frombuffer(data, np.float32).reshape(-1, dim)
            self.wide, self.m2 = np.hstack([m, np.ones((len(m), 1), np.float32)]), np.einsum("ij,ij->i", m, m)
            self.least = np.full((len(m), k), np.inf, np.float32)
            self.held: list[tuple[np.ndarray, ...]] = []

        def scan(self, vid: np.ndarray, centres: np.ndarray, most: float, far: np.ndarray) -> None:
            wide_far = far.max(initial=0)
            for s in range(0, len(self.ids), rows_at_once):
                m2, kth = self.m2[s : s + rows_at_once], self.least[s : s + rows_at_once, -1]
                d = self.wide[s : s + rows_at_once] @ centres.T  # squared distance less that of the query's length
                slack = np.float32(2.5e-7 * (dim + 4)) * (m2 + most)  # rounding of the products
                if d.shape[1] > k + 1 and not np.isfinite(kth).all():  # one of the k + 1 may be the query itself
                    kth = np.minimum(kth, np.sqrt(np.maximum(np.partition(d, k, axis=1)[:, k] + m2, 0) + slack) + wide_far)
                r, c = np.nonzero(d <= ((kth + wide_far) ** 2 + slack - m2)[:, None])
                square = d[r, c] + m2[r]
                lo = np.maximum(np.sqrt(np.maximum(square - slack[r], 0)) - far[c], 0)
                up = np.sqrt(np.maximum(square, 0) + slack[r]) + far[c]
                ok = (lo <= kth[r]) & (self.ids[s + r] != vid[c])
                r, lo, up, x = r[ok] + s, lo[ok], up[ok], vid[c[ok]]
                self.held.append((r, x, lo, up))
                row = np.r_[r, np.repeat(np.arange(s, s + len(m2)), k)]  # the k least of old and new
                value = np.r_[up, self.least[s : s + len(m2)].ravel()]
                o = np.lexsort((value, row))
                row, value = row[o], value[o]
                first = np.searchsorted(row, np.arange(s, s + len(m2)))
                self.least[s : s + len(m2)] = value[first[:, None] + np.arange(k)]
            if sum(len(x[0]) for x in self.held) > 1 << 20:
                self.prune()

        def prune(self) -> tuple[np.ndarray, ...]:
            r, x, lo, up = (np.concatenate(c) for c in zip(*self.held))
            ok = lo <= self.least[r, -1]
            self.held = [(r[ok], x[ok], lo[ok], up[ok])]
            return self.held[0]

        def rows(self) -> pa.RecordBatch:
            r, x, lo, up = self.prune()
            return pa.RecordBatch.from_pydict({"q": pa.array(self.ids[r]), "x": pa.array(x), "lo": pa.array(lo, pa.float32()), "up": pa.array(up, pa.float32())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Queries | None = None
        blocks: dict[bytes, tuple] = {}
        for b in batches:
            for qi, qd, vi, vd, vf in zip(*(b[c].to_pylist() for c in ("qids", "qdata", "ids", "data", "far"))):
                if now is None or now.key != qi:
                    if now is not None:
                        yield now.rows()
                    now = Queries(qi, qd)
                if vi not in blocks:
                    blocks.clear()
                    centre = (low + (np.frombuffer(vd, np.uint8).reshape(-1, dim) + 0.5) * step).astype(np.float32)
                    c2 = np.einsum("ij,ij->i", centre, centre)
                    blocks[vi] = np.frombuffer(vi, np.int64), np.hstack([-2 * centre, c2[:, None]]), c2.max(initial=0), np.frombuffer(vf, np.float32)
                now.scan(*blocks[vi])
        if now is not None:
            yield now.rows()

    return run


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = 2048, block: int = 16384, rows_at_once: int = 128) -> DataFrame:
    """``query_id``, ``neighbor_id``, ``rank``, ``distance``: the ``k`` nearest others of every query, exact, by Euclidean distance.

    ``queries``: rows of the same two columns, None for all ``vectors``; a vector of the query's own id isn't its neighbour.
    Equal distances are ranked by id. Fewer than ``k`` others: all of them. Left out on both sides: null ids, null or empty vectors,
    vectors with a null, NaN or infinite value (beyond 1e18), and vectors not of the most frequent length of ``vectors``. An id that occurs
    more than once counts once, with the least of its vectors. Ids are integers. No rows on either side: no rows. Other columns aren't looked at.
    ``block``, ``query_block`` and ``rows_at_once`` bound memory, nothing else.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vec_col).withColumn("id", F.col("id").cast("long")), "vectors")
    low, high = _ranges(rows)
    asked = rows
    if queries is not None:
        asked = usable(queries, id_col, vec_col).withColumn("id", F.col("id").cast("long")).filter(F.size("v") == len(low))
        asked = written(asked, "queries")
    schema = "q long, x long, lo float, up float"
    if not len(low):
        return spark.createDataFrame([], "query_id long, neighbor_id long, rank int, distance double")
    va = written(_blocks(rows.repartition("id"), low, high, block, False), "va-file")
    parts = max(1, min(asked.count() // query_block, 4 * spark.sparkContext.defaultParallelism))
    blocked = written(_blocks(asked.repartition(parts, "id"), low, high, query_block, True).select(F.col("ids").alias("qids"), F.col("data").alias("qdata")), "va-queries")
    bounds = blocked.hint("shuffle_replicate_nl").crossJoin(va).mapInArrow(_bounded(low, high, k, rows_at_once), schema)
    by_q = Window.partitionBy("q")
    nth = F.row_number().over(by_q.orderBy("up", "x"))
    bounds = bounds.withColumn("n", nth).withColumn("kth", F.min(F.when(F.col("n") == k, F.col("up"))).over(by_q))
    ranked = bounds.filter("kth is null or lo <= kth").withColumn("n", F.row_number().over(by_q.orderBy("lo", "x"))).select("q", "x", "lo", "n")
    ranked = written(ranked, "va-candidates")

    def exact(pairs: DataFrame) -> DataFrame:
        with_q = pairs.join(asked.select(F.col("id").alias("q"), F.col("v").alias("vq")), "q")
        both = with_q.join(rows.select(F.col("id").alias("x"), F.col("v").alias("vx")), "x")
        square = F.aggregate(F.zip_with("vq", "vx", lambda a, b: a.cast("double") - b.cast("double")), F.lit(0.0), lambda s, t: s + t * t)
        return both.select("q", "x", F.sqrt(square).alias("distance"))

    best, done, upto = None, 0, k
    pairs = ranked.filter(F.col("n") <= k).select("q", "x")
    while True:  # as many rounds as doublings of k up to the most candidates that a query has
        read = exact(pairs) if best is None else best.select("q", "x", "distance").unionByName(exact(pairs))
        rank = F.row_number().over(by_q.orderBy("distance", "x"))
        best = written(read.withColumn("rank", rank).filter(F.col("rank") <= k), "va-best")
        kth = best.groupBy("q").agg(F.when(F.count("*") == k, F.max("distance")).alias("most"))
        done, upto = upto, 2 * upto
        left = ranked.filter(F.col("n") > done).join(kth, "q", "left").filter("most is null or lo <= most")
        left = written(left.select("q", "x", "lo", "n"), "va-left")
        if left.isEmpty():
            break
        ranked, pairs = left, left.filter(F.col("n") <= upto).select("q", "x")
    return best.select(F.col("q").alias("query_id"), F.col("x").alias("neighbor_id"), "rank", "distance")


def op1_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of every embedding whose id is divisible by 50, among all; see :func:`top_k` for what is left out."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0")).withColumn("distance", F.round("distance", 6))


OP1_SQL = """
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT a.id AS q, b.id AS x, list_distance(a.e, b.e) AS distance FROM v a, v b WHERE a.id % 50 = 0 AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, x) AS rank FROM d)
SELECT q AS query_id, x AS neighbor_id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM r WHERE rank <= 10
"""
