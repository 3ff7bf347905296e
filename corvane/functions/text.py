"""Text functions: hashing, frontmatter, chunks, tokens, Chinese, Japanese and Korean segmentation."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from importlib.util import find_spec

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Python's ``str.strip`` removes; Java's ``\s`` lacks the information separators.
_BLANK = r"[\s\x1c-\x1f\x85]"
_FENCE = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
CHUNK_SIZE, OVERLAP = 1600, 320
CJK = r"[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯\x{20000}-\x{2a6df}]"
_CJK_RUN = re.compile("[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯\U00020000-\U0002a6df]+")


def strip(text: Column) -> Column:
    """Without white space at both ends, as Unicode defines it."""
    return F.regexp_replace(text, rf"(?U)\A{_BLANK}+|{_BLANK}+\z", "")


def unified_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def frontmatter(text: Column) -> Column:
    """The block between the fences at the start; null where there is none. The closing fence must end with a newline."""
    return F.when(text.rlike(_FENCE), F.regexp_extract(text, _FENCE, 1))


def body(text: Column) -> Column:
    """``text`` without its frontmatter."""
    return F.when(text.rlike(_FENCE), F.substring(text, F.length(F.regexp_extract(text, _FENCE, 0)) + 1, F.length(text))).otherwise(text)


# types as objects: strings can't be parsed where a Python worker imports this module
META = T.StructType([T.StructField("importance", T.DoubleType()), T.StructField("memory_type", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


def meta_of(block: str | None) -> tuple:
    import yaml

    try:
        got = yaml.safe_load(block) if block else {}
    except yaml.YAMLError:
        got = {}
    if not isinstance(got, dict):
        got = {}
    tags = got.get("tags") or []
    tags = [str(t) for t in tags] if isinstance(tags, list) else [str(tags)]
    try:
        return float(got.get("importance", 0.5)), str(got.get("type", "semantic")), tags, None
    except (TypeError, ValueError) as e:
        return None, str(got.get("type", "semantic")), tags, str(e)


@F.pandas_udf(META)
def parse_meta(block: pd.Series) -> pd.DataFrame:
    """Importance, type and tags of frontmatter blocks. What isn't YAML or isn't a mapping counts as empty; an importance that isn't a number gives ``error``."""
    return pd.DataFrame([meta_of(b) for b in block], columns=["importance", "memory_type", "tags", "error"])


def preview(text: Column, size: int = 200) -> Column:
    """The first ``size`` characters, with an ellipsis where more follow."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def iso_timestamp(text: Column) -> Column:
    """A time of ISO text, with or without a zone; null for what isn't one."""
    return F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}([T ]|\s*$)"), text.try_cast("timestamp"))


def json_of_tags(tags: Column) -> Column:
    """Tags as a JSON list; the empty list for null."""
    return F.to_json(F.coalesce(tags, F.array().cast("array<string>")))


def tags_of_json(text: Column) -> Column:
    """The list in a JSON text; no tags for null and for what isn't a JSON list."""
    return F.coalesce(F.from_json(text, T.ArrayType(T.StringType())), F.array().cast("array<string>"))


def chunks_of(text: str | None, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[str]:
    """Runs of whole paragraphs of at most ``size`` characters, each beginning with the last ones of the run before, of at most ``overlap``.

    Separators aren't counted. A longer paragraph is a chunk of its own, and a text of at most ``size`` is one chunk.
    """
    if not text or not text.strip():
        return []
    if len(text) <= size:
        return [text.strip()]
    out: list[str] = []
    held: list[str] = []
    total = 0
    for part in filter(None, (p.strip() for p in text.split("\n\n"))):
        if held and total + len(part) > size:
            out.append("\n\n".join(held))
            first, total = len(held), 0
            while first and total + len(held[first - 1]) <= overlap:
                first -= 1
                total += len(held[first])
            held = held[first:]
        held.append(part)
        total += len(part)
    return [*out, "\n\n".join(held)] if held else out


def in_batches(rows: Iterable[tuple], schema: pa.Schema, text: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """``rows`` as batches of about ``most`` characters or bytes of their column ``text``."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[text] or ()) + 64
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def chunked(rows: DataFrame, id_col: str, text: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(``id_col``, chunk_index, chunk_text) of the chunks of every row's text. A worker holds one batch and the chunks of a few texts."""
    out = T.StructType([rows.schema[id_col], T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([b.schema.field(0), ("chunk_index", pa.int32()), ("chunk_text", pa.string())])
            yield from in_batches(((k.as_py(), i, c) for k, t in zip(b[0], b[1]) for i, c in enumerate(chunks_of(t.as_py(), size, overlap))), schema, 2)

    return rows.select(id_col, text.alias("__text")).mapInArrow(run, out)


def _folds() -> tuple[str, str]:
    """Letters with one diacritic, and what remains without it."""
    pairs = []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            base, mark = (chr(int(p, 16)) for p in parts)
            if unicodedata.combining(mark) and base.isascii() and base.isalpha():
                pairs.append((chr(code), base.lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _folds()


def tokens(text: Column) -> Column:
    """Search tokens: runs of letters and digits, case folded, single diacritics removed."""
    folded = F.lower(F.translate(text, _FROM, _TO))
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}\p{Co}]+"), 0)


def segmenter() -> Callable[[str], list[str]]:
    """Words of a run of Chinese, Japanese or Korean characters: by dictionary where a segmenter is installed, else single characters."""
    try:
        import rjieba
    except ImportError:
        return list
    return lambda run: rjieba.cut(run, False)


def segment(text: str | None, cut: Callable[[str], list[str]] | None = None) -> str | None:
    """``text`` with blanks between the words of its Chinese, Japanese or Korean runs."""
    if text is None:
        return None
    cut = cut or segmenter()
    return _CJK_RUN.sub(lambda m: " ".join(cut(m[0])), text)


@F.pandas_udf(T.StringType())
def _segmented(text: pd.Series) -> pd.Series:
    cut = segmenter()
    return text.map(lambda t: segment(t, cut))


def cjk_segmented(text: Column) -> Column:
    """:func:`segment` of a column. Without a dictionary segmenter that is a blank between any two such characters, and no text leaves the JVM."""
    if find_spec("rjieba") is None:
        return F.regexp_replace(text, f"(?<={CJK})(?={CJK})", " ")
    needs = F.coalesce(text.rlike(CJK), F.lit(False))
    return F.when(needs, _segmented(F.when(needs, text))).otherwise(text)
