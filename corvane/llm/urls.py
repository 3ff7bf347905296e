"""URL filters by a tree of path templates (operator 8).

Each host's paths form a tree of segments. Segments that are numbers, hashes or
dates are typed at once. From the root down, the rare values of a segment that takes many
values become a wildcard, but for those whose labels differ from the others'. From the leaves up, sibling branches that are
statistically alike, in their labels and in what lies below them, are merged. Every
template that is left gets a purity: the share of good pages among its labelled
ones, smoothed towards its host and the host towards all. Pages of impure
templates are rejected.

All of it is done on a table of distinct typed paths with counts; each level of
the tree costs one aggregate and one join there. Only the first and last step see the pages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.shared import without, written

WILD = "*"
_TYPES = (
    (r"^[0-9]+$", "{num}"),
    (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}"),
    (r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "{uuid}"),
    (r"^(?=.*[0-9])[0-9a-f]{8,}$", "{hex}"),
)


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and a leading "www."; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def typed_path(url: Column, max_depth: int) -> Column:
    """Segments of the path in lower case, typed; those beyond ``max_depth`` are one segment together, joined by %2f."""
    path = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    parts = F.when(F.size(parts) > max_depth, F.concat(F.slice(parts, 1, max_depth - 1), F.array(F.array_join(F.slice(parts, F.lit(max_depth), F.size(parts)), "%2f")))).otherwise(parts)

    def kind(s: Column) -> Column:
        out = s
        for pattern, name in reversed(_TYPES):
            out = F.when(s.rlike(pattern), F.lit(name)).otherwise(out)
        return out

    return F.transform(parts, kind)


def _branch(d: int) -> dict[str, Column]:
    """Parent, child and what lies below the child, at depth ``d``."""
    below = F.slice("segs", d + 2, F.greatest(F.size("segs") - d - 1, F.lit(0)))
    return {"parent": F.array_join(F.slice("segs", 1, d), "/"), "child": F.get("segs", F.lit(d)), "below": F.array_join(below, "/")}


def _replaced(paths: DataFrame, d: int, new: DataFrame) -> DataFrame:
    """``paths`` with segment ``d`` named anew where (host, parent, child) is in ``new``."""
    at = paths.withColumns({k: v for k, v in _branch(d).items() if k != "below"})
    hit = at.join(new.select("host", "parent", "child", "to"), ["host", "parent", "child"], "left")
    segs = F.when(F.col("to").isNotNull(), F.concat(F.slice("segs", 1, d), F.array("to"), F.slice("segs", d + 2, F.greatest(F.size("segs") - d - 1, F.lit(0))))).otherwise(F.col("segs"))
    return written(hit.select("host", "typed", segs.alias("segs"), "n", "labelled", "bad"), "paths")


def _rare_children(paths: DataFrame, d: int, max_children: int, min_share: float, z: float) -> DataFrame:
    """Rare children of parents of many, and the wildcard they become; those stay whose rate of bad labels differs from that of the rest of the parent."""
    children = paths.filter(F.size("segs") > d).withColumns(_branch(d)).groupBy("host", "parent", "child").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")))
    parents = children.groupBy("host", "parent").agg(F.count("*").alias("many"), F.sum("n").alias("all"), F.sum("labelled").alias("pl"), F.sum("bad").alias("pb")).filter(F.col("many") > max_children)
    rare = children.filter(~F.col("child").startswith("{")).join(parents, ["host", "parent"]).filter(F.col("n") < F.col("all") * min_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [not differ(n, bad, pl - n, pb - bad, z) for n, bad, pl, pb in zip(*(b[c].to_pylist() for c in ("labelled", "bad", "pl", "pb")))]
            yield b.select(["host", "parent", "child"]).filter(pa.array(keep, pa.bool_()))

    alike = rare.select("host", "parent", "child", "labelled", "bad", "pl", "pb").mapInArrow(run, "host string, parent string, child string")
    return alike.withColumn("to", F.lit(WILD))


def differ(n: int, bad: int, m: int, worse: int, z: float) -> bool:
    """Whether ``bad`` of ``n`` labels and ``worse`` of ``m`` differ beyond ``z`` standard errors: few expected ones by the hypergeometric tail, as rare as that."""
    if not n or not m:
        return False
    total, hits = n + m, bad + worse
    gap, pool = bad / n - worse / m, hits / total
    if min(n, m) * pool * (1 - pool) > 5:
        return abs(gap) > z * math.sqrt(pool * (1 - pool) * (1 / n + 1 / m))
    if gap < 0:  # the same by the good ones
        bad, hits = n - bad, total - hits
    ways = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    tail = 0.0
    for x in range(bad, min(n, hits) + 1):
        term = math.exp(ways(n, x) + ways(m, hits - x) - ways(total, hits))
        tail += term
        if term < 1e-9 * tail:
            break
    return 2 * tail < math.erfc(z / math.sqrt(2))


def _parts(z: float):
    """Rows (host, parent, shape, child, labelled, bad), the best labelled of a shape first, with ``part``: the group of the nearest rate that
    a child doesn't differ from, by all labels of the group, or one of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kin, groups = None, []
        for b in batches:
            part = []
            for *key, n, bad in zip(*(b[c].to_pylist() for c in ("host", "parent", "shape", "labelled", "bad"))):
                if key != kin:
                    kin, groups = key, []
                near = sorted(range(len(groups)), key=lambda g: abs(bad / n - groups[g][1] / groups[g][0]))
                at = next((g for g in near if not differ(n, bad, *groups[g], z)), len(groups))
                if at == len(groups):
                    groups.append((0, 0))
                groups[at] = (groups[at][0] + n, groups[at][1] + bad)
                part.append(at)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("host", "parent", "shape", "child")), pa.array(part, pa.int32())], names=["host", "parent", "shape", "child", "part"])

    return run


def _alike_children(paths: DataFrame, d: int, z: float, max_distance: float) -> DataFrame:
    """Siblings to be merged, and the wildcard they become. Alike are those whose rates of bad labels don't differ by more than ``z`` standard
    errors from that of their group, and below all of which the same template has a share of 1 - ``max_distance``: their distributions are then no
    farther apart than that in total variation. Siblings without labels join the group of their shape where there is one, otherwise each other."""
    leaves = paths.filter(F.size("segs") > d).withColumns(_branch(d)).filter(~F.col("child").startswith("{"))
    sub = leaves.groupBy("host", "parent", "child", "below").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")))
    children = sub.groupBy("host", "parent", "child").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")), F.max(F.struct("n", "below")).alias("most"))
    parents = children.groupBy("host", "parent").agg(F.count("*").alias("many"), F.max((F.col("child") == WILD).cast("int")).alias("wild")).filter("many > 1")
    children = children.filter(F.col("most.n") >= F.col("n") * (1 - max_distance)).join(parents, ["host", "parent"])
    children = written(children.select("host", "parent", F.col("most.below").alias("shape"), "child", "labelled", "bad", "wild"), "siblings")
    kin = ["host", "parent", "shape"]
    known = children.filter("labelled > 0").drop("wild").repartition(*kin).sortWithinPartitions(*kin, F.desc("labelled"), "child")
    parts = known.mapInArrow(_parts(z), "host string, parent string, shape string, child string, part int")
    last = F.coalesce(F.max("part").over(Window.partitionBy(*kin)), F.lit(0))
    children = children.join(parts, [*kin, "child"], "left").withColumn("last", last).withColumn("part", F.coalesce("part", F.when(F.col("last") > 0, F.col("last") + 1).otherwise(0)))
    members = children.withColumn("size", F.count("*").over(Window.partitionBy("host", "parent", "shape", "part"))).filter("size > 1")
    place = F.dense_rank().over(Window.partitionBy("host", "parent").orderBy("shape", "part"))
    members = members.withColumn("has", F.max((F.col("child") == WILD).cast("int")).over(Window.partitionBy("host", "parent", "shape", "part")))
    number = place + F.when((F.col("wild") == 1) & (F.col("has") == 0), 1).otherwise(0)  # another branch may be the wildcard already
    to = F.when((F.col("has") == 1) | (number == 1), F.lit(WILD)).otherwise(F.concat(F.lit(WILD), number.cast("string")))
    return members.select("host", "parent", "child", to.alias("to"))


def path_templates(pages: DataFrame, labels: DataFrame, max_children: int = 32, min_share: float = 0.02, z: float = 2.58, max_distance: float = 0.5, strength: float = 10.0, min_purity: float = 0.5, max_depth: int = 16, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``pages`` with ``host``, ``template``, ``template_pages``, ``template_labelled``, ``purity`` and ``rejected``.

    ``labels``: (``label_id``, ``label_col``) with 1 for good and 0 for bad pages; a page with both is bad. ``purity`` is
    (good + strength * host's purity) / (labelled + strength), the host's smoothed likewise towards that of all pages. ``rejected``:
    purity under ``min_purity``. A template is the host and its path's segments: literal, typed such as {num}, or a
    wildcard: ``*``, and ``*2`` and so on where a parent has more than one group of merged branches.

    Null urls and those without a host have null results and aren't rejected. Null labels or label ids count for nothing; pages with
    a null id are unlabelled. Repeated pages count each. A path without segments is the template "host/". Without any
    label every purity is 1. No rows: no rows. Columns of ``pages`` named as an output are replaced.
    """
    pages = without(pages, "host", "template", "template_pages", "template_labelled", "purity", "rejected")
    mark = labels.filter(F.col(label_id).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("__label_id")).agg(F.max((F.col(label_col) == 0).cast("int")).alias("__bad"))
    keyed = pages.withColumns({"__host": host_of(F.col(url_col)), "__typed": F.array_join(typed_path(F.col(url_col), max_depth), "/")})
    lean = keyed.filter("__host is not null").select(F.col("__host").alias("host"), F.col("__typed").alias("typed"), F.col(id_col).alias("__id"))
    counts = lean.join(mark, F.col("__id") == F.col("__label_id"), "left").groupBy("host", "typed").agg(F.count("*").alias("n"), F.count("__bad").alias("labelled"), F.coalesce(F.sum("__bad"), F.lit(0)).alias("bad"))
    segs = F.filter(F.split("typed", "/"), lambda s: s != "")
    paths = written(counts.select("host", "typed", segs.alias("segs"), "n", "labelled", "bad"), "paths")
    depth = paths.agg(F.max(F.size("segs"))).first()[0] or 0
    for d in range(depth):
        paths = _replaced(paths, d, _rare_children(paths, d, max_children, min_share, z))
    for d in reversed(range(depth)):
        paths = _replaced(paths, d, _alike_children(paths, d, z, max_distance))
    paths = paths.withColumn("template", F.concat_ws("/", "host", F.array_join("segs", "/")))
    whole = F.broadcast(paths.agg((1 - F.sum("bad") / F.greatest(F.sum("labelled"), F.lit(1))).alias("p0")))  # one row
    smooth = lambda good, of, prior: (good + strength * F.col(prior)) / (of + strength)
    hosts = paths.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb")).crossJoin(whole).select("host", smooth(F.col("hl") - F.col("hb"), F.col("hl"), "p0").alias("ph"))
    stats = paths.groupBy("host", "template").agg(F.sum("n").alias("template_pages"), F.sum("labelled").alias("template_labelled"), F.sum("bad").alias("tb")).join(hosts, "host")
    stats = stats.withColumn("purity", smooth(F.col("template_labelled") - F.col("tb"), F.col("template_labelled"), "ph"))
    by_path = paths.select("host", "typed", "template").join(stats.drop("host", "tb", "ph"), "template").withColumnsRenamed({"host": "__h", "typed": "__t"})
    out = keyed.join(by_path, (F.col("__host") == F.col("__h")) & (F.col("__typed") == F.col("__t")), "left")
    rejected = F.coalesce(F.col("purity") < min_purity, F.lit(False))
    return out.select(*[F.col(f"`{c}`") for c in pages.columns], F.col("__host").alias("host"), "template", "template_pages", "template_labelled", "purity", rejected.alias("rejected"))


def op8_url_templates(spark, sf_dir: str) -> DataFrame:
    """Templates of all pages, with quality labels; a template is rejected that is mostly bad."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return path_templates(pages.select("page_id", "url"), labels).withColumn("purity", F.round("purity", 6))
