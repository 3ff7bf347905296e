"""Vector, full-text and hybrid search over chunks, with one re-ranking formula."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import scoring
from corvane.functions.scoring import Weights
from corvane.functions.vector import semantic_score
from corvane.operators import bm25
from corvane.operators.bm25 import TextIndex
from corvane.operators.fusion import reciprocal_rank_fusion
from corvane.operators.knn import knn_filtered

log = logging.getLogger(__name__)

RESULT = (
    "id long, file_path string, chunk_text string, chunk_index int, semantic_score double, importance double, temporal_decay double, "
    "hybrid_score double, memory_type string, tags array<string>, last_accessed timestamp, fts_score double, rrf_score double"
)
_FLOOR = 1e-9


class SearchMode(str, Enum):
    VECTOR_ONLY = "vector_only"
    FTS_ONLY = "fts_only"
    HYBRID = "hybrid"

    @classmethod
    def of(cls, name: str | SearchMode) -> SearchMode:
        """The mode of this name; an unknown one is hybrid, with a warning."""
        try:
            return cls(name)
        except ValueError:
            log.warning("unknown search mode %r: hybrid is used", name)
            return cls.HYBRID


def pool_size(top_k: int) -> int:
    """Candidates that each list gives to re-ranking."""
    if top_k < 1:
        raise ValueError(f"top_k must be at least 1, not {top_k}")
    return min(3 * top_k, 100)


def metadata_filter(conditions: dict | None) -> Column | None:
    """All of ``conditions``, null equal to null."""
    out = None
    for name, value in (conditions or {}).items():
        literal = F.array(*map(F.lit, value)) if isinstance(value, (list, tuple)) else F.lit(value)
        out = F.col(name).eqNullSafe(literal) if out is None else out & F.col(name).eqNullSafe(literal)
    return out


@dataclass
class HybridSearch:
    """Search over ``chunks`` (one row an id, with the metadata), ``vectors`` (id, embedding) and a text index, which searches by vector alone do without.

    The candidate lists have at most 100 rows: the windows over them aren't partitioned.
    """

    chunks: DataFrame
    vectors: DataFrame
    index: TextIndex | None
    weights: Weights = field(default_factory=Weights)
    decay_rate: float = 0.05
    rrf_k: int = 60

    def search(self, query: str, vector: Sequence[float] | None = None, top_k: int = 10, memory_type: str | None = None, min_score: float = 0.0, mode: str | SearchMode = SearchMode.HYBRID, as_of: dt.datetime | None = None) -> DataFrame:
        """The ``top_k`` best chunks with their scores, best first. A blank query finds nothing.

        ``vector``: the query's embedding; without one, hybrid search ranks by text alone and vector search finds nothing.
        ``memory_type``: of vector candidates before they are ranked, of others after; fewer than ``top_k`` may be left.
        ``as_of``: the time that decay counts to, now if None.
        """
        pool_size(top_k)
        spark = self.chunks.sparkSession
        mode = SearchMode.of(mode)
        if not query.strip() or mode is SearchMode.VECTOR_ONLY and vector is None:
            return spark.createDataFrame([], RESULT)
        find = {SearchMode.VECTOR_ONLY: self._vector, SearchMode.FTS_ONLY: self._text, SearchMode.HYBRID: self._hybrid}[mode]
        found, place = find(query, vector, top_k, memory_type)
        scored = self._scored(found, as_of).filter(F.col("hybrid_score") >= min_score)
        if mode is SearchMode.HYBRID:  # the first of the fused list are chosen, and only then ordered by score
            scored = scored.orderBy(place).limit(top_k)
        names = [f.split()[0] for f in RESULT.split(", ")]
        return scored.orderBy(F.desc("hybrid_score"), place).limit(top_k).select(*names)

    def _near(self, vector: Sequence[float], k: int, memory_type: str | None) -> DataFrame:
        kind = metadata_filter({"memory_type": memory_type} if memory_type else None)
        source = self.vectors if kind is None else self.vectors.join(self.chunks.select("id", "memory_type"), "id")
        return knn_filtered(source, vector, k, kind).select("id", "distance", F.col("rank").alias("vec_rank"))

    def _matching(self, query: str, k: int) -> DataFrame:
        hits = bm25.search(self.index, query, k)
        best = F.greatest(F.max("bm25_score").over(Window.partitionBy()), F.lit(_FLOOR))
        return hits.select("id", (F.col("bm25_score") / best).alias("fts"), F.col("rank").alias("fts_rank"))

    def _typed(self, found: DataFrame, memory_type: str | None) -> DataFrame:
        rows = self.chunks.join(F.broadcast(found), "id")  # at most twice 100 rows
        return rows.filter(F.col("memory_type").eqNullSafe(memory_type)) if memory_type else rows

    def _vector(self, query: str, vector, top_k: int, memory_type: str | None) -> tuple[DataFrame, str]:
        near = self._near(vector, pool_size(top_k), memory_type)
        rows = self._typed(near, None).withColumns({"fts_score": F.lit(0.0), "rrf_score": F.lit(0.0)})
        return rows.withColumn("relevance", semantic_score(F.col("distance"))), "vec_rank"

    def _text(self, query: str, vector, top_k: int, memory_type: str | None) -> tuple[DataFrame, str]:
        rows = self._typed(self._matching(query, pool_size(top_k)), memory_type)
        rows = rows.withColumns({"distance": F.lit(None).cast("double"), "fts_score": F.col("fts"), "rrf_score": F.lit(0.0)})
        return rows.withColumn("relevance", F.col("fts")), "fts_rank"

    def _hybrid(self, query: str, vector, top_k: int, memory_type: str | None) -> tuple[DataFrame, str]:
        k = pool_size(top_k)
        hits = self._matching(query, k)
        lists = hits.select("id", F.lit(1).alias("list_id"), F.col("fts_rank").alias("rank"), F.lit(None).cast("double").alias("distance"), "fts")
        if vector is not None:
            near = self._near(vector, k, memory_type)
            lists = lists.unionByName(near.select("id", F.lit(0).alias("list_id"), F.col("vec_rank").alias("rank"), "distance", F.lit(None).cast("double").alias("fts")))
        carry = (F.max("distance").alias("distance"), F.coalesce(F.max("fts"), F.lit(0.0)).alias("fts_score"))
        fused = reciprocal_rank_fusion(lists.withColumnRenamed("id", "doc_id"), self.rrf_k, carry=carry)
        best = F.greatest(F.max("rrf").over(Window.partitionBy()), F.lit(_FLOOR))
        fused = fused.select(F.col("doc_id").alias("id"), (F.col("rrf") / best).alias("rrf_score"), "fused_rank", "distance", "fts_score")
        return self._typed(fused, memory_type).withColumn("relevance", F.col("rrf_score")), "fused_rank"

    def _scored(self, rows: DataFrame, as_of: dt.datetime | None) -> DataFrame:
        now = F.lit(as_of or dt.datetime.now(dt.timezone.utc)).cast("timestamp")
        rows = rows.withColumns(
            {
                "semantic_score": semantic_score(F.col("distance")),
                "importance": scoring.importance(F.col("importance")),
                "temporal_decay": scoring.temporal_decay(F.col("last_accessed"), now, self.decay_rate),
                "tags": F.coalesce(F.col("tags"), F.array().cast("array<string>")),
            }
        )
        return rows.withColumn("hybrid_score", scoring.hybrid_score(F.col("relevance"), F.col("importance"), F.col("temporal_decay"), self.weights))
