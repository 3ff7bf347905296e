"""Secret scans by structural confirmation (operator 2).

A pattern only proposes a candidate. It is reported when its structure holds:
base64 or hex that decodes, DER lengths that nest exactly, an OpenSSH container
whose length-prefixed fields fill it, a signed token whose header and claims are
JSON objects, a checksum that agrees. What a candidate decodes to is scanned
again, so that a key wrapped in base64 is found too, however often it is wrapped: every wrapping is
a quarter shorter, which bounds the work. All patterns take time in proportion to the text.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import small_batches, without

#: What every candidate contains; evaluated inside the JVM so that Python sees only texts with a candidate.
PREFILTER = (
    r"A[KS]IA[A-Z2-7]{16}|eyJ[A-Za-z0-9_-]{8}|-----BEGIN|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-\d|"
    r"(?i:passw|pwd|secret|token|api_?-?key|access_?-?key|auth)[A-Za-z_-]{0,40}[\"']?[ \t]{0,20}[:=]|[A-Za-z0-9+/_-]{40}"
)
_PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40})PRIVATE KEY-----")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_AWS = re.compile(r"(?<![A-Za-z0-9])(A[KS]IA)([A-Z2-7]{16})(?![A-Za-z0-9])")
_GIT = re.compile(r"(?<![A-Za-z0-9_])(gh[pousr])_([A-Za-z0-9]{36})(?![A-Za-z0-9_])")
_SLACK = re.compile(r"(?<![A-Za-z0-9])xox[abprs]-(\d{9,13})-(\d{9,13})-(?:\d{9,13}-)?([A-Za-z0-9]{24,34})(?![A-Za-z0-9])")
_KEYED = re.compile(r"(?i)(?:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[A-Za-z_-]{0,40}[\"']?[ \t]{0,20}[:=][ \t]{0,20}[\"']?([A-Za-z0-9+/_=-]{16,})")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: What may lie between two lines of one wrapped candidate: a line end, written out or escaped, and marks of quotation or continuation.
_WRAP = re.compile(r"[\"']?(?:\r?\n|(?:\\r)?\\n|\r)[ \t>#*|]{0,8}(?://[ \t]{1,4})?[\"']?")
_ESCAPED = re.compile(r"\\r?\\n|\\n|\r\n?")
_PREFIX = re.compile(r"(?m)^(?:[ \t>#*|\"']|//[ \t]|\+[ \t]){1,12}|[\"'][ \t]{0,4}\+?[ \t]{0,4}$|[ \t\\]{1,6}$")
_HEX = re.compile(r"[0-9a-fA-F]+")
_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _b64(s: str) -> bytes | None:
    s = re.sub(r"\s+", "", s).rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        raw = base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    # the bits beyond the last byte must be zero, as every encoder leaves them
    return raw if base64.b64encode(raw).decode().rstrip("=") == s else None


def _der(raw: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, first and past-the-end byte of the value at ``at``."""
    if at + 2 > end:
        return None
    tag, n, at = raw[at], raw[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or raw[at] == 0:
            return None
        n, at = int.from_bytes(raw[at : at + k], "big"), at + k
    return (tag, at, at + n) if at + n <= end else None


def _der_sequence(raw: bytes) -> list[tuple[int, int, int]] | None:
    top = _der(raw, 0, len(raw))
    if not top or top[0] != 0x30 or top[2] != len(raw):
        return None
    out, at = [], top[1]
    while at < top[2]:
        item = _der(raw, at, top[2])
        if not item:
            return None
        out.append(item)
        at = item[2]
    return out


def key_encoding(raw: bytes) -> str | None:
    """The kind of private key that these bytes encode, if every length in them agrees."""
    if raw.startswith(b"openssh-key-v1\0"):
        at, fields = 15, []
        for _ in range(3):
            if at + 4 > len(raw):
                return None
            n = int.from_bytes(raw[at : at + 4], "big")
            fields.append(raw[at + 4 : at + 4 + n])
            at += 4 + n
        if at + 4 > len(raw) or not fields[0].isascii():
            return None
        for _ in range(int.from_bytes(raw[at : at + 4], "big") + 1):
            at += 4
            if at + 4 > len(raw):
                return None
            at += int.from_bytes(raw[at : at + 4], "big")
        return "openssh" if at + 4 == len(raw) else None
    items = _der_sequence(raw)
    if not items:
        return None
    tags = [t for t, _, _ in items]
    value = lambda i: raw[items[i][1] : items[i][2]]
    if len(items) >= 9 and all(t == 2 for t in tags[:9]) and value(0) in (b"\0", b"\1"):
        return "pkcs1"
    if len(items) >= 3 and tags[:3] == [2, 0x30, 4] and _der(raw, items[1][1], items[1][2]):
        return "pkcs8" if _der(raw, items[1][1], items[1][2])[0] == 6 else None
    if len(items) >= 2 and tags[0] == 2 and value(0) == b"\1" and tags[1] == 4 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "sec1" if items[1][2] - items[1][1] in (20, 24, 28, 32, 48, 66) else None
    if len(items) == 6 and all(t == 2 for t in tags) and value(0) == b"\0":
        return "dsa"
    if len(items) == 2 and tags == [0x30, 4] and (inner := _der(raw, items[0][1], items[0][2])) and inner[0] == 6:
        return "pkcs8_encrypted"
    return None


def _entropy(s: bytes | str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _random(raw: bytes, chars: str) -> bool:
    """Whether this looks drawn at random: enough kinds of characters, few printable bytes, no counting."""
    steps = Counter((b - a) & 255 for a, b in zip(raw, raw[1:]))
    return len(raw) >= 8 and _entropy(chars) >= 2.5 and (not steps or steps.most_common(1)[0][1] <= len(raw) // 2)


def _jwt(head: str, body: str, sign: str) -> bool:
    try:
        h, b = (json.loads(_b64(x) or b"") for x in (head, body))
    except (ValueError, UnicodeDecodeError):
        return False
    return isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(b, dict) and (h["alg"].lower() == "none" if not sign else len(_b64(sign) or b"") >= 16)


def _checksum(body: str) -> bool:
    n, out = zlib.crc32(body[:30].encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = _B62[r] + out
    return out.rjust(6, "0") == body[30:]


def _pem_blocks(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, label, body) of every BEGIN mark and the END mark of its label that is next, with no other BEGIN between."""
    begin = None
    for m in _PEM.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin is not None:
            if m[2] == begin[2]:
                yield begin.start(), m.end(), m[2], text[begin.end() : m.start()]
            begin = None


def _armoured(body: str, encrypted: bool) -> bool:
    """Whether the body of a key between its marks decodes to one: lines may be escaped, quoted or end in carriage returns, and headers come first."""
    body = _ESCAPED.sub("\n", body)
    body = _PREFIX.sub("", body)
    if "Proc-Type" in body:
        body = body.rpartition("\n\n")[2]
    raw = _b64(body)
    return bool(raw) and (encrypted and len(raw) >= 64 or key_encoding(raw) is not None)


def _candidates(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of the base64 and hex alphabets: lines of one length, and a last one that isn't longer, are one candidate."""
    m = _RUN.search(text)
    while m:
        lines = [m.span()]
        size = len(m[0])
        while lines[-1][1] - lines[-1][0] == size and (gap := _WRAP.match(text, lines[-1][1])) and (more := _LINE.match(text, gap.end())) and len(more[0]) <= size:
            lines.append(more.span())
        yield lines
        m = _RUN.search(text, lines[-1][1])


def _decoded(s: str) -> bytes | None:
    return binascii.unhexlify(s) if len(s) % 2 == 0 and _HEX.fullmatch(s) else _b64(s)


def _kind(s: str) -> str | None:
    """What a run of the alphabet is once decoded."""
    raw = _decoded(s)
    if not raw:
        return None
    if key_encoding(raw):
        return "private_key"
    try:
        inner = raw.decode("utf-8")
    except UnicodeDecodeError:
        inner = raw.decode("latin-1")
    return "encoded_secret" if find_secrets(inner) else None


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets in ``text``, in order, none overlapping another."""
    found: list[tuple[int, int, str]] = []
    for s, e, label, body in _pem_blocks(text):
        if _armoured(body, "ENCRYPTED" in label or "ENCRYPTED" in body):
            found.append((s, e, "private_key"))
    for m in _JWT.finditer(text):
        if _jwt(*m.groups()):
            found.append((*m.span(), "signed_token"))
    for m in _AWS.finditer(text):
        if len(base64.b32decode(m[2])) == 10 and _entropy(m[2]) >= 2.25:
            found.append((*m.span(), "aws_access_key"))
    for m in _GIT.finditer(text):
        if _checksum(m[2]):
            found.append((*m.span(), "github_token"))
    for m in _SLACK.finditer(text):
        if _entropy(m[3]) >= 3:
            found.append((*m.span(), "slack_token"))
    for lines in _candidates(text):
        kind = _kind("".join(text[s:e] for s, e in lines))
        if kind:
            found.append((lines[0][0], lines[-1][1], kind))
        elif len(lines) > 1:  # they may be of one length by chance
            found += [(s, e, k) for s, e in lines if e - s >= 40 and (k := _kind(text[s:e]))]
    for m in _KEYED.finditer(text):
        s = m[1]
        if _HEX.fullmatch(s):
            raw = binascii.unhexlify(s) if len(s) % 2 == 0 else None
        else:
            raw = _b64(s) if re.search(r"\d", s) and re.search(r"[a-z]", s) and re.search(r"[A-Z]", s) else None
        if raw and _random(raw, s):
            found.append((*m.span(1), "keyed_secret"))
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of all texts: ``id_col``, start, length (characters), kind, sha256 of the secret; never the secret itself.

    Null and empty texts have none. Rows with a null id are reported under a null id; repeated rows are reported each.
    Other columns of ``docs`` are not looked at. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(PREFILTER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, s, e - s, k, hashlib.sha256(t[s:e].encode()).hexdigest()) for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist()) for s, e, k in find_secrets(t)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b["id"].type, pa.int32(), pa.int32(), pa.string(), pa.string()))], names=[id_col, "start", "length", "kind", "sha256"])

    return lean.mapInArrow(run, f"`{id_col}` {kind}, start int, length int, kind string, sha256 string")


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced by ``[kind]``, and ``chars_col``, where there is one, set to the new length.

    Rows without a secret, null and empty texts among them, come back as they are. All other columns are kept.
    """
    small_batches(docs.sparkSession)
    docs = without(docs, "__candidate")
    schema = docs.schema
    flagged = docs.withColumn("__candidate", F.coalesce(F.col(text_col).rlike(PREFILTER), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            at, flag = names.index(text_col), b.column(len(names) - 1)
            cols = list(b.columns)[:-1]
            hit = {}
            for i in flag.to_numpy(zero_copy_only=False).nonzero()[0].tolist():
                t = cols[at][i].as_py()
                found = find_secrets(t)
                for s, e, k in reversed(found):
                    t = f"{t[:s]}[{k}]{t[e:]}"
                if found:
                    hit[i] = t
            if hit:
                texts = cols[at].to_pylist()
                for i, t in hit.items():
                    texts[i] = t
                cols[at] = pa.array(texts, cols[at].type)
                if chars_col in names:
                    n = cols[c := names.index(chars_col)].to_pylist()
                    for i, t in hit.items():
                        n[i] = len(t)
                    cols[c] = pa.array(n, cols[c].type)
            yield pa.RecordBatch.from_arrays(cols, names=names[:-1])

    return flagged.mapInArrow(run, schema)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents; see :func:`scan_secrets` for nulls, empty texts and repeated rows."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
