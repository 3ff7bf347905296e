"""Exact nearest neighbours by cosine distance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.vector import cosine_distance, norm
from corvane.workspace import staged


def _checked(k: int) -> int:
    if k < 1:
        raise ValueError(f"top_k must be at least 1, not {k}")
    return k


def knn(vectors: DataFrame, query: Sequence[float], k: int = 10, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """``vectors`` of the ``k`` least distances to ``query`` with ``distance`` and ``rank``; ties by id. Null and zero vectors are left out.

    Every partition keeps its own k (TakeOrderedAndProject); k rows are ranked.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    length = sum(float(x) ** 2 for x in query) ** 0.5
    near = vectors.withColumn("distance", cosine_distance(F.col(vec_col), q, norm_b=F.lit(length))).filter("distance is not null")
    near = near.orderBy("distance", id_col).limit(_checked(k))
    return near.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)))


def knn_filtered(vectors: DataFrame, query: Sequence[float], k: int, condition: Column | None, id_col: str = "id", vec_col: str = "embedding", prefilter: bool = False) -> DataFrame:
    """As :func:`knn`, of rows that meet ``condition``: three times ``k`` are fetched and then filtered, so fewer than ``k`` may be left.

    ``prefilter``: filter first, and fetch ``k``.
    """
    if condition is None:
        return knn(vectors, query, k, id_col, vec_col)
    if prefilter:
        return knn(vectors.filter(condition), query, k, id_col, vec_col)
    near = knn(vectors, query, 3 * _checked(k), id_col, vec_col).filter(condition)
    return near.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col))).filter(F.col("rank") <= k)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks (ids, data, dim) of at most ``size`` vectors (id, v) of one length, as doubles; null and zero vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def packed(dim: int) -> pa.RecordBatch:
            ids, vs = zip(*held.pop(dim))
            return pa.RecordBatch.from_pydict({"ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "data": pa.array([np.stack(vs).tobytes()], pa.binary()), "dim": pa.array([dim], pa.int32())})

        for b in batches:
            flat, ends = b["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(b["n"].to_numpy())
            for i, v in zip(b["id"].to_pylist(), np.split(flat, ends[:-1]) if len(ends) else ()):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == size:
                    yield packed(len(v))
        for dim in list(held):
            yield packed(dim)

    length = norm(F.col("v"))
    good = rows.filter((length > 0) & ~F.isnan(length) & ~F.exists("v", lambda x: x.isNull()))
    return good.select("id", F.col("v").cast("array<double>").alias("v"), F.size("v").alias("n")).mapInArrow(run, "ids binary, data binary, dim int")


class _Nearest:
    """The ``k`` nearest of a block of queries, as blocks of vectors come by."""

    def __init__(self, ids: bytes, data: bytes, dim: int, k: int):
        self.key, self.k = (ids, dim), k
        self.ids, self.q = np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, dim)
        self.size = np.sqrt(np.einsum("ij,ij->i", self.q, self.q))
        self.row, self.id, self.far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.kth = np.full(len(self.ids), np.inf)

    def scan(self, ids: np.ndarray, v: np.ndarray, size: np.ndarray, at_once: int = 256) -> None:
        unit = (v / size[:, None]).T
        found = [(self.row, self.id, self.far)]
        for s in range(0, len(self.ids), at_once):
            d = 1 - (self.q[s : s + at_once] / self.size[s : s + at_once, None]) @ unit
            most = self.kth[s : s + at_once]
            if d.shape[1] > self.k:
                most = np.minimum(most, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
            r, c = np.nonzero(d <= most[:, None] + 1e-12)  # again, one by one: equal vectors get equal distances
            r += s
            found.append((r, ids[c], 1 - np.einsum("ij,ij->i", self.q[r], v[c]) / (self.size[r] * size[c])))
        row, id_, far = (np.concatenate(x) for x in zip(*found))
        o = np.lexsort((id_, far, row))
        row, id_, far = row[o], id_[o], far[o]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep = nth < self.k
        self.row, self.id, self.far = row[keep], id_[keep], far[keep]
        last = nth[keep] == self.k - 1
        self.kth[self.row[last]] = self.far[last]

    def rows(self, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.id), pa.array(self.far)], names=names)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vec_col: str = "embedding", query_id: str = "query_id", query_vec: str = "query_embedding", block: int = 8192, query_block: int = 1024) -> DataFrame:
    """(``query_id``, ``id_col``, ``distance``, ``rank``) of the ``k`` nearest for every row of ``queries``; ids are integers, ties by id.

    Blocks of queries meet blocks of vectors: a matrix product each. A task keeps its own k for each query, whatever it has scanned, and only
    these are shuffled. Vectors of another length than the query's, null and zero ones have no distance and are left out.
    """
    spark = vectors.sparkSession
    v = staged(_blocks(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")), block), "knn-vectors")
    asked = _blocks(queries.select(F.col(query_id).cast("long").alias("id"), F.col(query_vec).alias("v")), query_block)
    q = staged(asked.select(F.col("ids").alias("qids"), F.col("data").alias("qdata"), F.col("dim").alias("qdim")), "knn-queries")
    q = q.coalesce(4 * spark.sparkContext.defaultParallelism)
    k, names = _checked(k), [query_id, id_col, "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Nearest | None = None
        last: tuple = (None,)
        for b in batches:
            for qids, qdata, qdim, ids, data, dim in zip(*(b[c].to_pylist() for c in ("qids", "qdata", "qdim", "ids", "data", "dim"))):
                if qdim != dim:
                    continue
                if now is None or now.key != (qids, qdim):
                    if now is not None:
                        yield now.rows(names)
                    now = _Nearest(qids, qdata, qdim, k)
                if last[0] != ids:
                    m = np.frombuffer(data, np.float64).reshape(-1, dim)
                    last = (ids, np.frombuffer(ids, np.int64), m, np.sqrt(np.einsum("ij,ij->i", m, m)))
                now.scan(*last[1:])
        if now is not None:
            yield now.rows(names)

    near = q.hint("shuffle_replicate_nl").crossJoin(v).mapInArrow(run, f"`{query_id}` long, `{id_col}` long, distance double")
    order = Window.partitionBy(query_id).orderBy("distance", id_col)
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
