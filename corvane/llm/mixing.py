"""Mixing sources to target weights (operator 5).

Every document gets a hash-random key for each epoch. Within a source the keys
are cut into ranges; token sums of the ranges and a running total over them say
in which range the source's budget ends, and only that range is sorted and
summed row by row. The cut is thus one (key, id) bound and a number of tokens
for each source, and choosing documents is a filter over the table: no text is
ever shuffled. Only what grows with the number of sources and ranges is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.shared import without, written

#: A token is a run of characters other than ASCII white space.
TOKEN = r"[^ \t\n\x0B\f\r]+"
_NULL = "\x00null"


def n_tokens(text: Column) -> Column:
    """Tokens of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def _key(seed: int, epoch: Column, id_: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), epoch.cast("string"), F.lit("|"), F.coalesce(id_.cast("string"), F.lit(""))))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, total_tokens: int | None = None, seed: int = 17, rows_per_range: int = 50_000, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Documents of the mixture: the columns of ``docs`` with ``epoch``, ``n_tokens`` and ``take_tokens``.

    ``weights``: share of each source, normalised to 1; None gives every source the same share. Sources that it
    doesn't name get nothing. ``total_tokens``: size of the mixture; None: as many tokens as ``docs`` has.
    A source's budget is floor(total * share). It is met exactly: as many whole epochs as fit, then, in the order
    of that epoch's random keys, documents until the budget ends; of the last of these ``take_tokens`` says how
    many of its tokens belong to the mixture. Texts are returned whole.

    Null text or a text without tokens: never chosen. Null source: a source of its own (key None in ``weights``).
    Null id: allowed; such rows share one key. Rows repeated entirely count each for itself, the budget is met all
    the same; which of equal rows comes first makes no difference. No rows: no rows. Columns of ``docs`` named as an
    output column are replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, "epoch", "n_tokens", "take_tokens")
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(_NULL))
    base = docs.withColumns({"n_tokens": n_tokens(F.col(text_col)), "__source": source}).filter("n_tokens > 0")
    lean = written(base.select(F.col(id_col).alias("__id"), "__source", "n_tokens"), "mix-tokens")
    stats = lean.groupBy("__source").agg(F.sum("n_tokens").alias("__all"), F.count("*").alias("__rows"))
    if weights is None:
        stats = stats.withColumn("__w", F.lit(1.0))
    else:
        pairs = [(_NULL if k is None else k, float(v)) for k, v in weights.items() if v > 0]
        stats = stats.join(spark.createDataFrame(pairs, "__source string, __w double"), "__source")
    whole = Window.partitionBy()
    total = F.lit(total_tokens).cast("bigint") if total_tokens is not None else F.sum("__all").over(whole)
    if total_tokens is None and weights is not None:
        total = F.lit(lean.agg(F.sum("n_tokens")).first()[0] or 0).cast("bigint")
    plan = stats.withColumn("__budget", F.floor(total * F.col("__w") / F.sum("__w").over(whole)).cast("bigint")).select(
        "__source", "__rows", F.expr("__budget div __all").alias("__full"), F.expr("__budget % __all").alias("__rest")
    )
    plan = written(plan, "mix-plan")  # one row a source
    # where in the key order of the last, partial epoch each source ends
    part = lean.join(plan.filter("__rest > 0"), "__source").withColumn("__key", _key(seed, F.col("__full"), F.col("__id")))
    ranges = F.ceil(F.col("__rows") / F.lit(rows_per_range))
    part = part.withColumn("__range", F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * ranges).cast("int"))
    sums = part.groupBy("__source", "__range", "__rest").agg(F.sum("n_tokens").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy("__source").orderBy("__range"))
    last = sums.withColumn("__upto", upto).filter("__upto >= __rest and __upto - __n < __rest").select("__source", "__range", (F.col("__rest") - F.col("__upto") + F.col("__n")).alias("__left"))
    inside = part.join(last, ["__source", "__range"])
    order = Window.partitionBy("__source").orderBy("__key", F.col("__id").asc_nulls_first(), "n_tokens")
    run = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = inside.withColumn("__run", run).filter("__run >= __left and __run - n_tokens < __left").groupBy("__source").agg(
        F.min(F.struct("__key", F.col("__id"), F.col("n_tokens"))).alias("__cut")
    )
    # tokens left for the rows equal to the bound: one row, or the copies of a repeated row
    cut_row = F.struct("__key", F.col("__id"), F.col("n_tokens"))
    before = F.coalesce(F.sum(F.when(cut_row < F.col("__cut"), F.col("n_tokens"))), F.lit(0))
    cut = inside.join(cut, "__source").groupBy("__source", "__cut", "__left").agg(before.alias("__before")).select("__source", "__cut", (F.col("__left") - F.col("__before")).alias("__at_cut"))
    bound = written(plan.join(cut, "__source", "left"), "mix-bounds")

    # the table is read once more for all epochs, the copies of a row being made of one count of its tokens
    cols = [F.col(f"`{c}`") for c in docs.columns]
    key = _key(seed, F.col("__full"), F.col(id_col))
    row = F.struct(key.alias("__key"), F.col(id_col).alias("__id"), F.col("n_tokens"))
    epochs = F.when(F.col("__full") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("__full") - 1)).otherwise(F.array().cast("array<bigint>"))
    epochs = F.when((F.col("__rest") > 0) & (row < F.col("__cut")), F.concat(epochs, F.array("__full"))).otherwise(epochs)
    taken = base.join(bound, "__source").select(*cols, F.explode(epochs).alias("epoch"), "n_tokens", F.col("n_tokens").alias("take_tokens"))
    # and once for the rows at a bound, of which only those of its key have their tokens counted
    near = docs.withColumn("__source", source).join(bound.filter("__rest > 0"), "__source").filter(key == F.col("__cut.__key"))
    near = near.withColumn("n_tokens", n_tokens(F.col(text_col))).filter(row == F.col("__cut"))
    nth = F.row_number().over(Window.partitionBy("__source").orderBy("n_tokens"))
    at = near.withColumn("take_tokens", F.least(F.col("n_tokens"), F.col("__at_cut") - (nth - 1) * F.col("n_tokens")).cast("bigint")).filter("take_tokens > 0")
    return taken.unionByName(at.select(*cols, F.col("__full").alias("epoch"), "n_tokens", "take_tokens"))


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Equal shares for all sources, as many tokens as the corpus has: the hot source is cut, the others repeat."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "source", "epoch", "n_tokens", "take_tokens")


OP5_SQL = r"""
WITH tok AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS n FROM documents
), docs AS (SELECT * FROM tok WHERE n > 0),
per AS (SELECT source, sum(n) AS t FROM docs GROUP BY source),
plan AS (
  SELECT source, t, CAST(floor((SELECT sum(t) FROM per) * 1.0::DOUBLE / (SELECT count(*) FROM per)) AS BIGINT) AS budget FROM per
), p2 AS (SELECT source, budget // t AS e, budget % t AS rest FROM plan),
whole AS (
  SELECT d.doc_id, d.source, CAST(g.e AS BIGINT) AS epoch, d.n AS n_tokens, d.n AS take_tokens
  FROM docs d JOIN p2 ON p2.source IS NOT DISTINCT FROM d.source, LATERAL (SELECT unnest(range(0, CAST(p2.e AS BIGINT))) AS e) g
), part AS (
  SELECT d.doc_id, d.source, p2.e AS epoch, d.n AS n_tokens, p2.rest,
    sum(d.n) OVER (PARTITION BY d.source ORDER BY md5('17|' || p2.e::BIGINT::VARCHAR || '|' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.n
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.n AS before
  FROM docs d JOIN p2 ON p2.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, source, epoch, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(take_tokens AS BIGINT) AS take_tokens FROM whole
UNION ALL
SELECT doc_id, source, CAST(epoch AS BIGINT), CAST(n_tokens AS BIGINT), CAST(least(n_tokens, rest - before) AS BIGINT) FROM part WHERE before < rest
"""
