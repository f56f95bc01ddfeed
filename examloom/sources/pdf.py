"""PDF files: which there are, how many pages each has, and why one can't be read."""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_A_PDF, ENCRYPTED = "not-a-pdf", "encrypted"
#: File and folder names of answer keys, and of mark schemes.
KEY_NAME = r"(^|[-_ ])(key|keys|answers?|answer[-_ ]?key)\.pdf$"
MARK_SCHEME = r"(?i)(^|[-_ ])ms([-_ ])"
KEY_FOLDER = r"^(keys|answers)$"
#: The 32 bytes that fill up a short password, as the format's standard gives them.
PADDING = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")
_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")


class _Unreadable(Exception):
    pass


def _dictionary(raw: bytes, at: int) -> bytes:
    """The text of the dictionary that starts at or behind ``at``, inner ones included."""
    start = raw.find(b"<<", at)
    depth, i = 0, start
    while start >= 0:
        low = [p for p in (raw.find(b"<<", i), raw.find(b">>", i)) if p >= 0]
        if not low:
            break
        i = min(low) + 2
        depth += 1 if raw[i - 2 : i] == b"<<" else -1
        if depth == 0:
            return raw[start:i]
    raise _Unreadable


def _reference(text: bytes, name: bytes) -> int | None:
    m = re.search(rb"/" + name + rb"\s+(\d+)\s+\d+\s+R\b", text)
    return int(m[1]) if m else None


def _number(text: bytes, name: bytes) -> int | None:
    m = re.search(rb"/" + name + rb"\s+(-?\d+)\b(?!\s+\d+\s+R)", text)
    return int(m[1]) if m else None


def _stream(raw: bytes, at: int, head: bytes) -> bytes:
    """The bytes of the stream behind a dictionary, unpacked."""
    start = raw.find(b"stream", at + len(head))
    if start < 0:
        raise _Unreadable
    start += 6 + (2 if raw[start + 6 : start + 8] == b"\r\n" else 1)
    end = raw.find(b"endstream", start)
    length = _number(head, b"Length")
    body = raw[start : start + length] if length is not None else raw[start : end if end >= 0 else len(raw)]
    if b"/FlateDecode" in head:
        try:
            body = zlib.decompressobj().decompress(body)
        except zlib.error:
            raise _Unreadable from None
    width = _number(head, b"Columns") if (_number(head, b"Predictor") or 1) >= 10 else None
    if width:
        rows, above = [], bytes(width)
        for i in range(0, len(body), width + 1):
            kind, row = body[i], body[i + 1 : i + 1 + width]
            if kind == 2:
                row = bytes((a + b) & 255 for a, b in zip(row, above, strict=False))
            elif kind != 0:
                raise _Unreadable
            rows.append(row)
            above = row
        body = b"".join(rows)
    return body


class _Pdf:
    """Where a file's objects are, by its cross-reference tables and streams, the newest first."""

    def __init__(self, raw: bytes):
        self.raw, self.offsets, self.packed, self.trailer = raw, {}, {}, b""
        found = re.findall(rb"startxref\s+(\d+)", raw)
        seen: set[int] = set()
        at = int(found[-1]) if found else None
        while at is not None and at not in seen and at < len(raw):
            seen.add(at)
            at = self._table(at) if raw[at : at + 4] == b"xref" else self._cross_stream(at)
        if not self.trailer:
            raise _Unreadable

    def _table(self, at: int) -> int | None:
        end = self.raw.find(b"trailer", at)
        if end < 0:
            raise _Unreadable
        fields = self.raw[at + 4 : end].split()
        i = 0
        while i + 1 < len(fields):
            first, n = int(fields[i]), int(fields[i + 1])
            for k in range(n):
                offset, _, kind = fields[i + 2 + 3 * k : i + 5 + 3 * k]
                if kind == b"n":
                    self.offsets.setdefault(first + k, int(offset))
            i += 2 + 3 * n
        head = _dictionary(self.raw, end)
        self.trailer = self.trailer or head
        hybrid = _number(head, b"XRefStm")
        if hybrid is not None:
            self._cross_stream(hybrid)
        return _number(head, b"Prev")

    def _cross_stream(self, at: int) -> int | None:
        if not _OBJECT.match(self.raw, at):
            raise _Unreadable
        head = _dictionary(self.raw, at)
        body = _stream(self.raw, self.raw.find(head, at), head)
        widths = [int(x) for x in re.search(rb"/W\s*\[([\d\s]+)\]", head)[1].split()]
        index = re.search(rb"/Index\s*\[([\d\s]+)\]", head)
        index = [int(x) for x in index[1].split()] if index else [0, _number(head, b"Size") or 0]
        place = 0
        for first, n in zip(index[::2], index[1::2], strict=True):
            for k in range(n):
                parts = []
                for w in widths:
                    parts.append(int.from_bytes(body[place : place + w], "big") if w else None)
                    place += w
                kind = 1 if parts[0] is None else parts[0]
                if kind == 1:
                    self.offsets.setdefault(first + k, parts[1])
                elif kind == 2 and first + k not in self.offsets:
                    self.packed.setdefault(first + k, parts[1])
        self.trailer = self.trailer or head
        return _number(head, b"Prev")

    def object(self, n: int) -> bytes:
        """The text of an object's dictionary."""
        if n in self.offsets:
            m = _OBJECT.match(self.raw, self.offsets[n])
            if not m or int(m[1]) != n:
                raise _Unreadable
            return _dictionary(self.raw, m.end())
        if n in self.packed and self.packed[n] in self.offsets:
            at = self.offsets[self.packed[n]]
            head = _dictionary(self.raw, at)
            body = _stream(self.raw, self.raw.find(head, at), head)
            first, count = _number(head, b"First") or 0, _number(head, b"N") or 0
            pairs = [int(x) for x in body[:first].split()[: 2 * count]]
            places = dict(zip(pairs[::2], pairs[1::2], strict=True))
            if n in places:
                return _dictionary(body, first + places[n])
        raise _Unreadable

    def pages(self) -> int:
        root = _reference(self.trailer, b"Root")
        tree = _reference(self.object(root), b"Pages") if root is not None else None
        if tree is None:
            raise _Unreadable
        count = _number(self.object(tree), b"Count")
        return count if count is not None and count >= 0 else self._leaves(tree, set())

    def _leaves(self, n: int, seen: set[int]) -> int:
        """Pages below a node without a count."""
        if n in seen:
            raise _Unreadable
        seen.add(n)
        text = self.object(n)
        kids = re.search(rb"/Kids\s*\[(.*?)\]", text, re.S)
        return 1 if not kids else sum(self._leaves(int(k), seen) for k in re.findall(rb"(\d+)\s+\d+\s+R\b", kids[1]))

    def needs_password(self) -> bool:
        """Whether the empty password doesn't open an encrypted file. Newer schemes than RC4 keys from MD5 count as closed."""
        n = _reference(self.trailer, b"Encrypt")
        text = self.object(n) if n is not None else _dictionary(self.trailer, self.trailer.find(b"/Encrypt")) if b"/Encrypt" in self.trailer else None
        if text is None:
            return False
        revision, bits = _number(text, b"R") or 0, _number(text, b"Length") or 40
        owner, user, ident = _string(text, b"O"), _string(text, b"U"), _string(self.trailer, b"ID")
        if revision not in (2, 3, 4) or owner is None or user is None:
            return True
        size = 5 if revision == 2 else bits // 8
        key = hashlib.md5(PADDING + owner[:32] + ((_number(text, b"P") or 0) & 0xFFFFFFFF).to_bytes(4, "little") + (ident or b"")).digest()
        if revision == 2:
            return _rc4(key[:size], PADDING) != user[:32]
        for _ in range(50):
            key = hashlib.md5(key[:size]).digest()
        check = hashlib.md5(PADDING + (ident or b"")).digest()
        for i in range(20):
            check = _rc4(bytes(b ^ i for b in key[:size]), check)
        return check != user[:16]


def _string(text: bytes, name: bytes) -> bytes | None:
    """A hexadecimal string (the first of an array), the only form that is looked for."""
    m = re.search(rb"/" + name + rb"\s*\[?\s*<([0-9A-Fa-f\s]*)>", text)
    return bytes.fromhex(m[1].decode()) if m else None


def _rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for b in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(b ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def page_count(raw: bytes) -> tuple[int | None, str | None]:
    """(pages, None), or (None, why the bytes can't be read)."""
    try:
        if b"%PDF-" not in raw[:1024]:
            return None, NOT_A_PDF
        pdf = _Pdf(raw)
        if pdf.needs_password():
            return None, ENCRYPTED
        return pdf.pages(), None
    except (_Unreadable, ValueError, TypeError, IndexError, RecursionError):
        return None, NOT_A_PDF


@F.arrow_udf(T.StructType([T.StructField("pages", T.IntegerType()), T.StructField("error", T.StringType())]))
def _info(content: pa.Array) -> pa.Array:
    found = [page_count(x.as_py() or b"") for x in content]
    return pa.StructArray.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([e for _, e in found], pa.string())], names=["pages", "error"])


def pdf_info(files: DataFrame) -> DataFrame:
    """``files`` (content) with pages, and error: null, ``not-a-pdf`` or ``encrypted`` (a password is needed). A null or broken file is not a PDF, and never fails a task."""
    return files.withColumn("_i", _info(F.col("content"))).withColumns({"pages": F.col("_i.pages"), "error": F.col("_i.error")}).drop("_i")


def is_key(name: Column, parent: Column) -> Column:
    """Whether a PDF is an answer key, by its own name or its folder's."""
    return F.lower(name).rlike(KEY_NAME) | F.lower(name).rlike(MARK_SCHEME) | F.lower(parent).rlike(KEY_FOLDER)


def question_paper(name: Column) -> Column:
    """The name of the question paper that a mark scheme is of."""
    return F.regexp_replace(name, MARK_SCHEME, "$1qp$2")


def with_keys(files: DataFrame) -> DataFrame:
    """``files`` (path below the searched folder) with name, parent and is_key: those named .pdf in the folder itself or one below."""
    parts = F.split("path", "/")
    found = files.withColumn("name", F.element_at(parts, -1)).withColumn("parent", F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).otherwise(""))
    return found.filter(F.lower("name").endswith(".pdf") & (F.size(parts) <= 2)).withColumn("is_key", is_key(F.col("name"), F.col("parent")))


def discovered(spark: SparkSession, folder: str) -> DataFrame:
    """Path (below the folder), name, parent, size, is_key, pages and error of the PDFs in a folder and one below. Contents are read where they are judged and go no further."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.lit(spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/")
    path = F.regexp_replace("path", r"^[a-z0-9+.-]+:(//[^/]*)?", "")
    below = f.select(F.expr("1").alias("_"), F.substring(path, F.length(root) + 1, F.length(path)).alias("path"), F.col("length").alias("size"), "content").drop("_")
    return pdf_info(with_keys(below)).drop("content")
