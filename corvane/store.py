"""Chunks, vectors and the text index as segments of Parquet files.

A change writes what it adds as a new segment and what it deletes as a bitmap of ids, and then puts the next
manifest in place: a reader sees one version or the other, a job that dies leaves the old one, and of two writers the
later one fails instead of undoing the other's work. Small segments are merged once many have gathered, so
that a row is written again a logarithmic number of times. The folder must be mounted on every machine.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import content_hash
from corvane.operators.bm25 import TextIndex, in_runs, lengths_of, postings_of, search
from corvane.operators.knn import knn_filtered
from corvane.plans.search import metadata_filter
from corvane.workspace import workspace

CHUNKS = (
    "id long, file_path string, chunk_index int, content_hash string, chunk_text string, importance double, memory_type string, "
    "last_accessed timestamp, access_count int, tags array<string>, created_at timestamp, updated_at timestamp"
)
VECTORS = "id long, embedding array<float>"
POSTINGS = "term string, id long, tf long, positions array<int>"
LENGTHS = "id long, dl int"
ACCESS = "id long, at timestamp"
TABLES = {"chunks": CHUNKS, "vectors": VECTORS, "postings": POSTINGS, "lengths": LENGTHS}
TOKENIZER_VERSION = 3
#: Segments, or lists of deleted ids, that may gather before they are merged.
FAN = 8
#: Ids of 16 bits share a bitmap, ``words`` of 64 ids each; as many bitmaps are broadcast (32 MB), more are shuffled.
MARKS, MOST_BLOCKS = "block long, words array<long>, at long", 4096


def bitmaps(ids: DataFrame, *keys: str) -> DataFrame:
    """(block, words, keys) of the ids in ``ids`` (id, keys)."""
    word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").bitwiseAND(63).cast("int"))).alias("bits")
    words = ids.groupBy(F.shiftright("id", 16).alias("block"), *keys, F.shiftright("id", 6).bitwiseAND(1023).cast("int").alias("word")).agg(word)
    return _packed(words, *keys)


def _packed(words: DataFrame, *keys: str) -> DataFrame:
    held = words.groupBy("block", *keys).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return held.select("block", F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words"), *keys)


def marked(words: Column) -> Column:
    """Whether the bit of ``id`` is set in the bitmap of its block."""
    word = F.element_at(words, (F.shiftright("id", 6).bitwiseAND(1023) + 1).cast("int"))
    return F.call_function("shiftright", word, F.col("id").bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def _of_block(rows: DataFrame, maps: DataFrame, how: str, n: int) -> DataFrame:
    return rows.withColumn("block", F.shiftright("id", 16)).join(F.broadcast(maps) if n <= MOST_BLOCKS else maps, "block", how)


def among(rows: DataFrame, maps: DataFrame, n: int) -> DataFrame:
    """``rows`` whose id is in ``maps`` (block, words), ``n`` bitmaps: the rows stay where they are."""
    return _of_block(rows, maps.select("block", "words"), "inner", n).filter(marked(F.col("words"))).select(*rows.columns)


class ChunkStore:
    """A store in ``path``, a folder that all machines have; None makes one in the shared folder that :meth:`close` deletes."""

    def __init__(self, spark: SparkSession, path: str | Path | None = None, dimension: int = 384):
        self.spark = spark
        self._own = path is None
        if path is None:
            path = f"{workspace(spark)}/store-{uuid.uuid4().hex[:12]}".removeprefix("file:")
            if "://" in path:
                raise ValueError(f"{path}: a store needs a folder that is mounted on every machine")
        self.path = Path(path).absolute()
        self.dimension = dimension
        self._scratch = f"tmp-{uuid.uuid4().hex[:12]}"
        self.ensure_tables()

    # the manifest

    def _versions(self) -> list[int]:
        return sorted(int(p.stem.split("-")[1]) for p in self.path.glob("manifest-*.json"))

    @property
    def _manifest(self) -> dict:
        return json.loads((self.path / f"manifest-{self._versions()[-1]:012d}.json").read_text())

    def _put(self, manifest: dict) -> bool:
        """Make this the next version; False if another writer has made it."""
        tmp = self.path / f".manifest-{uuid.uuid4().hex}"
        tmp.write_text(json.dumps(manifest))
        try:
            os.link(tmp, self.path / f"manifest-{manifest['version']:012d}.json")  # fails where it exists
            return True
        except FileExistsError:
            return False
        finally:
            tmp.unlink()

    def ensure_tables(self) -> None:
        """Make the store if it isn't there; rebuild the text index if an older tokenizer made it."""
        self.path.mkdir(parents=True, exist_ok=True)
        if not self._versions():
            self._put({"version": 1, "next_id": 1, "dimension": self.dimension, "tokenizer": TOKENIZER_VERSION, "segments": [], "deleted": [], "rows": 0, "tokens": 0})
        elif self._manifest["tokenizer"] < TOKENIZER_VERSION:
            self.rebuild_text_index()

    def _table(self, name: str, segments: list[dict] | None = None, manifest: dict | None = None) -> DataFrame:
        """The living rows of all segments, or of some: those whose id no later change deleted."""
        now = manifest or self._manifest
        segments = now["segments"] if segments is None else segments
        schema = T.StructType.fromDDL(TABLES[name]) if hasattr(T.StructType, "fromDDL") else self.spark.createDataFrame([], TABLES[name]).schema
        if not segments:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{name}/seq={g['seq']}/part={g['part']}" for g in segments]
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("seq", T.LongType()), T.StructField("part", T.StringType())])).option("basePath", f"{self.path}/{name}").parquet(*paths)
        if now["deleted"]:
            maps = self._marks(now["deleted"]).groupBy("block").agg(F.collect_list(F.struct("at", "words")).alias("gone"))
            rows = _of_block(rows, maps, "left", sum(g.get("blocks", 0) for g in now["deleted"]))
            rows = rows.filter(F.col("gone").isNull() | ~F.exists("gone", lambda g: (g["at"] > F.col("seq")) & marked(g["words"])))
        return rows.select(*schema.names)

    def _marks(self, lists: list[dict]) -> DataFrame:
        """(block, words, at) of lists of deleted ids: rows of segments older than ``at`` are gone. Lists without ``blocks`` are an older layout's, of ids."""
        read = lambda some, schema: self.spark.read.schema(schema).parquet(*(f"{self.path}/deleted/{g['part']}" for g in some))
        new, old = [g for g in lists if "blocks" in g], [g for g in lists if "blocks" not in g]
        parts = [read(new, MARKS)] * bool(new) + [bitmaps(read(old, "id long, at long"), "at")] * bool(old)
        return reduce(DataFrame.unionByName, parts)

    def _merged_marks(self, lists: list[dict], segments: list[dict]) -> DataFrame:
        """The same for ``segments``: one bitmap for all times that no segment lies between."""
        times = F.array(*(F.lit(g["seq"]).cast("long") for g in segments))
        at = F.array_max(F.filter(times, lambda x: x < F.col("at"))) + 1
        words = self._marks(lists).select("block", F.posexplode("words").alias("word", "bits"), at.alias("at")).filter("at is not null and bits <> 0")
        return _packed(words.groupBy("block", "at", "word").agg(F.bit_or("bits").alias("bits")), "at").select("block", "words", "at")

    def _commit(self, old: dict, insert: dict[str, DataFrame] | None = None, delete: DataFrame | None = None, segments: list[dict] | None = None, deleted: list[dict] | None = None, **manifest) -> None:
        """The next version after ``old``: a segment more, a list of deleted ids more, or other lists of both."""
        seq, part = old["version"] + 1, uuid.uuid4().hex[:12]
        segments, deleted = list(old["segments"] if segments is None else segments), list(old["deleted"] if deleted is None else deleted)
        rows, tokens = old["rows"], old["tokens"]
        if delete is not None:
            bitmaps(delete.select("id")).withColumn("at", F.lit(seq).cast("long")).write.parquet(f"{self.path}/deleted/{part}")
            maps = self.spark.read.schema(MARKS).parquet(f"{self.path}/deleted/{part}")
            blocks = maps.count()
            lost = among(self._table("lengths", manifest=old), maps, blocks).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
            if lost["n"]:
                deleted.append({"part": part, "blocks": blocks})
                rows, tokens = rows - lost["n"], tokens - lost["dl"]
        if insert is not None:
            at = manifest.pop("at", seq)
            for name, out in insert.items():
                out = out.select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in TABLES[name].split(", ")))
                out.write.option("compression", "zstd").parquet(f"{self.path}/{name}/seq={at}/part={part}")
            size = self.spark.read.schema(LENGTHS).parquet(f"{self.path}/lengths/seq={at}/part={part}").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
            if size["n"]:
                segments.append({"seq": at, "part": part, "rows": size["n"]})
            if manifest.pop("counted", True):
                rows, tokens = rows + size["n"], tokens + size["dl"]
        new = old | {"version": seq, "segments": segments, "deleted": deleted, "rows": rows, "tokens": tokens} | manifest
        if not self._put(new):
            raise RuntimeError(f"{self.path}: another writer has changed the store")
        self._clean(old)

    def _clean(self, old: dict) -> None:
        """Delete what neither the present version nor the one before, whose readers go on, refers to."""
        for v in self._versions():
            if v < old["version"]:
                (self.path / f"manifest-{v:012d}.json").unlink(missing_ok=True)
        dropped = {(g["seq"], g["part"]) for g in old.get("dropped", [])}
        for seq, part in dropped:
            for name in TABLES:
                shutil.rmtree(self.path / name / f"seq={seq}" / f"part={part}", ignore_errors=True)
        for part in old.get("undeleted", []):
            shutil.rmtree(self.path / "deleted" / part, ignore_errors=True)

    def compact(self, force: bool = False) -> None:
        """Merge the last segments where many have gathered: as many as are together smaller than the one before them, all if ``force``."""
        now = self._manifest
        segments = now["segments"]
        if not force and len(segments) < FAN and len(now["deleted"]) < FAN:
            return
        first = len(segments) - 1
        while first > 0 and (force or sum(g["rows"] for g in segments[first:]) * 2 > segments[first - 1]["rows"]):
            first -= 1
        first = max(first, 0)
        merged, deleted = segments[first:], now["deleted"]
        insert = {name: self._table(name, merged, now) for name in TABLES} if merged else None
        if insert:
            insert["postings"] = in_runs(insert["postings"])
        if not first:
            kept, gone = [], deleted  # nothing is left that a list could delete from
        elif len(deleted) >= FAN:
            part = uuid.uuid4().hex[:12]
            self._merged_marks(deleted, segments[:first]).write.parquet(f"{self.path}/deleted/{part}")
            kept, gone = [{"part": part, "blocks": self.spark.read.schema(MARKS).parquet(f"{self.path}/deleted/{part}").count()}], deleted
        else:
            kept, gone = deleted, []
        at = max((g["seq"] for g in merged), default=now["version"] + 1)
        self._commit(now, insert, segments=segments[:first], deleted=kept, at=at, counted=False, dropped=merged, undeleted=[g["part"] for g in gone])

    def _changed(self, old: dict, insert: dict[str, DataFrame] | None = None, delete: DataFrame | None = None, **manifest) -> None:
        try:
            self._commit(old, insert, delete, dropped=[], undeleted=[], **manifest)
        finally:
            shutil.rmtree(self.path / self._scratch, ignore_errors=True)
        self.compact()

    # reading

    def chunks(self) -> DataFrame:
        """All rows, their access counts up to date."""
        rows, log = self._table("chunks"), self.path / "access"
        if not log.exists():
            return rows
        seen = self.spark.read.schema(ACCESS).parquet(str(log)).groupBy("id").agg(F.count("*").cast("int").alias("n"), F.max("at").alias("at"))
        out = rows.join(seen, "id", "left").withColumns({"access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("n", F.lit(0)), "last_accessed": F.greatest("last_accessed", "at")})
        return out.select(*rows.columns)

    def vectors(self) -> DataFrame:
        return self._table("vectors")

    def text_index(self) -> TextIndex:
        """The text index; rows and mean length are kept with the manifest."""
        now = self._manifest
        return TextIndex(self._table("postings", manifest=now), self._table("lengths", manifest=now), (now["rows"], now["tokens"]))

    def count(self) -> int:
        return self._table("chunks").count()

    def get_meta(self, id_: int) -> dict | None:
        row = self.chunks().filter(F.col("id") == int(id_)).first()
        return row.asDict() if row else None

    def hashes_for_file(self, file_path: str) -> dict[int, str]:
        """Hash by chunk index; of a repeated index, that of the greatest id."""
        rows = self._table("chunks").filter(F.col("file_path") == file_path).groupBy("chunk_index").agg(F.max_by("content_hash", "id").alias("h"))
        return {r["chunk_index"]: r["h"] for r in rows.collect()}  # one file

    def search_similar(self, query: Sequence[float], k: int = 10) -> DataFrame:
        return knn_filtered(self.vectors(), query, k, None)

    def search(self, query: Sequence[float], top_k: int = 10, filter_metadata: dict | None = None, prefilter: bool = False) -> DataFrame:
        """Nearest rows with their metadata; see :func:`corvane.operators.knn.knn_filtered`."""
        rows = self.vectors().join(self.chunks(), "id") if filter_metadata else self.vectors()
        near = knn_filtered(rows, query, top_k, metadata_filter(filter_metadata), prefilter=prefilter)
        return near if filter_metadata else self.chunks().join(F.broadcast(near), "id").orderBy("rank")

    def search_fts(self, query: str, top_k: int = 10) -> DataFrame:
        return search(self.text_index(), query, top_k)

    # writing

    def _staged(self, rows: DataFrame) -> DataFrame:
        """``rows`` worked out once, for all that a change writes."""
        tmp = f"{self.path}/{self._scratch}/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(tmp)
        return self.spark.read.schema(rows.schema).parquet(tmp)

    def _numbered(self, rows: DataFrame, order: tuple[str, ...], start: int) -> DataFrame:
        """``rows`` with ``id`` from ``start`` in this order, shuffled and written once: a row's place in its range is written with it, and the ranges' sizes are added when it is read."""
        staged = self._staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
        staged = staged.withColumns({"__part": F.shiftright("__at", 33), "__nth": F.col("__at").bitwiseAND((1 << 33) - 1)})
        before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = staged.groupBy("__part").agg(F.count("*").alias("n")).select("__part", before.alias("__before"))  # a row a partition
        counted = self.spark.createDataFrame(offsets.collect(), offsets.schema)
        return staged.join(F.broadcast(counted), "__part").withColumn("id", F.lit(start) + F.col("__before") + F.col("__nth")).drop("__part", "__before", "__at", "__nth")

    def apply(self, insert: DataFrame | None = None, delete: DataFrame | None = None) -> int:
        """Delete the rows of ``delete`` (id) and append those of ``insert``, as one version; the number appended.

        ``insert``: embedding, file_path and chunk_text; chunk_index, content_hash, importance, memory_type and tags if they differ from 0, the text's
        hash, 0.5, "semantic" and none. Only what changes is written.
        """
        old = self._manifest
        n, start, add = 0, old["next_id"], None
        if insert is not None:
            now = F.current_timestamp()
            have = {c.lower() for c in insert.columns}
            default = lambda name, value: F.coalesce(F.col(name), value) if name in have else value
            rows = insert.select(
                "embedding", default("file_path", F.lit("")).alias("file_path"), default("chunk_index", F.lit(0)).alias("chunk_index"), F.coalesce("chunk_text", F.lit("")).alias("chunk_text"),
                default("content_hash", content_hash(F.coalesce("chunk_text", F.lit("")))).alias("content_hash"), default("importance", F.lit(0.5)).alias("importance"), default("memory_type", F.lit("semantic")).alias("memory_type"),
                default("tags", F.array().cast("array<string>")).alias("tags"), F.lit(None).cast("timestamp").alias("last_accessed"), F.lit(0).alias("access_count"), now.alias("created_at"), now.alias("updated_at"),
            )
            rows = self._numbered(rows, ("file_path", "chunk_index"), start)
            n = rows.count()
            if n:
                add = {"chunks": rows.drop("embedding"), "vectors": rows.select("id", "embedding"), "postings": postings_of(rows), "lengths": lengths_of(rows)}
        gone = None if delete is None else self._staged(delete.select("id").distinct())
        if gone is not None and gone.isEmpty():
            gone = None
        if add is not None or gone is not None:
            self._changed(old, add, gone, next_id=start + n)
        else:
            shutil.rmtree(self.path / self._scratch, ignore_errors=True)
        return n

    def add(self, records: DataFrame) -> int:
        return self.apply(insert=records)

    def insert_embedding(self, embedding: Sequence[float], file_path: str, chunk_index: int, chunk_text: str, hash_value: str = "", importance: float = 0.5, memory_type: str = "semantic", tags: Sequence[str] = ()) -> int:
        """One row; its id."""
        id_ = self._manifest["next_id"]
        row = (list(map(float, embedding)), file_path, chunk_index, chunk_text, hash_value or None, importance, memory_type, list(tags or ()))
        self.apply(self.spark.createDataFrame([row], "embedding array<float>, file_path string, chunk_index int, chunk_text string, content_hash string, importance double, memory_type string, tags array<string>"))
        return id_

    def delete(self, ids: Sequence[int | str]) -> None:
        self.apply(delete=self.spark.createDataFrame([(int(i),) for i in ids], "id long"))

    def delete_by_file(self, file_path: str) -> int:
        gone = self._table("chunks").filter(F.col("file_path") == file_path).select("id")
        n = gone.count()
        if n:
            self.apply(delete=gone)
        return n

    def clear(self) -> None:
        old = self._manifest
        self._commit(old, segments=[], deleted=[], rows=0, tokens=0, dropped=old["segments"], undeleted=[g["part"] for g in old["deleted"]])

    def update(self, updates: DataFrame) -> None:
        """Rows (id, embedding, chunk_text, content_hash) in place of those of their ids. An empty or null text keeps the old text; the hash is that
        given, else that of a new text, else the old one. Unknown ids do nothing; of an id given twice the greatest row counts."""
        cols = [F.col(c).alias(f"__{c}") if c in updates.columns else F.lit(None).cast("string").alias(f"__{c}") for c in ("chunk_text", "content_hash")]
        new = updates.select("id", F.col("embedding").alias("__embedding"), *cols).groupBy("id").agg(F.max(F.struct("__embedding", "__chunk_text", "__content_hash")).alias("u")).select("id", "u.*")
        text, given = F.nullif(F.col("__chunk_text"), F.lit("")), F.nullif(F.col("__content_hash"), F.lit(""))
        new = self._staged(new.filter(F.col("__embedding").isNotNull() | text.isNotNull() | given.isNotNull()))
        old = self._manifest
        ids = self._staged(bitmaps(new.select("id")))
        blocks = ids.count()
        chunks = among(self._table("chunks", manifest=old), ids, blocks).join(new, "id").withColumns({"content_hash": F.coalesce(given, content_hash(text), F.col("content_hash")), "chunk_text": F.coalesce(text, F.col("chunk_text")), "updated_at": F.current_timestamp()})
        vectors = among(self._table("vectors", manifest=old), ids, blocks).join(new.select("id", "__embedding"), "id").select("id", F.coalesce("__embedding", "embedding").alias("embedding"))
        rows = self._staged(chunks.drop("__embedding", "__chunk_text", "__content_hash"))
        self._changed(old, {"chunks": rows, "vectors": vectors, "postings": postings_of(rows), "lengths": lengths_of(rows)}, rows.select("id"))

    def record_access(self, ids: DataFrame) -> None:
        """One access for every row of ``ids`` (id), appended to a log that reading sums up."""
        ids.select("id", F.current_timestamp().alias("at")).write.mode("append").parquet(str(self.path / "access"))

    def backfill_text_index(self, force: bool = False) -> bool:
        """Index the text of all rows anew where the index is empty, or in any case; whether it was done."""
        if not force and not self._table("lengths").isEmpty():
            return False
        self.rebuild_text_index()
        return True

    def rebuild_text_index(self) -> None:
        """All rows as one segment, their text tokenised again."""
        old = self._manifest
        chunks = self._table("chunks", manifest=old)
        insert = {"chunks": chunks, "vectors": self._table("vectors", manifest=old), "postings": postings_of(chunks), "lengths": lengths_of(chunks)}
        self._commit(old | {"rows": 0, "tokens": 0}, insert, segments=[], deleted=[], dropped=old["segments"], undeleted=[g["part"] for g in old["deleted"]], tokenizer=TOKENIZER_VERSION)

    def counts(self) -> DataFrame:
        """One row: chunks, vectors and indexed rows, which must be equal, and distinct files."""
        parts = [
            self._table("chunks").agg(F.count("*").alias("chunks"), F.count_distinct("file_path").alias("files")),
            self.vectors().agg(F.count("*").alias("vectors")),
            self._table("lengths").agg(F.count("*").alias("indexed")),
        ]
        return reduce(lambda a, b: a.crossJoin(b), parts)

    def close(self) -> None:
        if self._own:
            shutil.rmtree(self.path, ignore_errors=True)
