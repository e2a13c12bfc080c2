"""PDF documents: magic, metadata and positioned text of uncomplicated files, by a Python data source.

The reader follows the page objects of files with plain cross-reference tables or object streams, inflates content streams and interprets
the text operators. Encrypted files, exotic encodings and pages without a text layer give an error row or no fragments; OCR needs programs
that are not part of this library. Limits keep a bad file from taking a task down.
"""

from __future__ import annotations

import glob
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that a stream may inflate to, characters of a page, pages of a document.
MOST_STREAM, MOST_TEXT, MOST_PAGES = 64 << 20, 16 << 20, 3000
SCHEMA = "doc_id string, physical_page int, fragment_id string, sequence bigint, text string, x_pos double, y_pos double, width double, height double, font_size double, redaction_masked boolean, error string"
_TYPES = tuple({"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]] for x in SCHEMA.split(", "))

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^()\\]|\((?:\\.|[^()\\])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]<>()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([nrtbf()\\]|[0-7]{1,3})", lambda m: _ESCAPES.get(m[1], bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _times(m: tuple, n: tuple) -> tuple:
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def _width(text: str, size: float) -> float:
    each = sum(0.33 if c.isspace() else 0.28 if c in "ilIj.,:;!'|" else 0.82 if c in "MWmw@%" else 0.54 for c in text)
    return max(0.2 * size, size * each)


def fragments(content: bytes) -> Iterator[tuple[str, float, float, float, float]]:
    """Text, x, y, width and font size of each shown string of a content stream (operators q Q cm BT Tf Tm Td TD TL Ts T* Tj TJ ' ")."""
    unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm, stack, tm, line = unit, [], unit, unit
    size, leading, rise = 10.0, 0.0, 0.0
    args: list = []
    array: list | None = None

    def show(parts: list) -> Iterator[tuple]:
        nonlocal tm
        at = _times((1, 0, 0, 1, 0, rise), _times(tm, ctm))
        text, moved = "", 0.0
        for p in parts:
            if isinstance(p, str):
                text += p
                moved += _width(p, size) if p else 0.0
            else:
                moved -= p / 1000 * size
                if p < -180 and text and not text.endswith(" "):
                    text += " "
        scale = abs(at[0]) or abs(at[1]) or 1.0
        tm = _times((1, 0, 0, 1, moved, 0), tm)
        if text.strip():
            yield text, at[4], at[5], moved * scale, size * (abs(at[3]) or scale)

    def down(x: float, y: float) -> None:
        nonlocal tm, line
        line = tm = _times((1, 0, 0, 1, x, y), line)

    for m in _TOKEN.finditer(content):
        t = m.group()
        if t == b"[":
            array = []
        elif t == b"]":
            args.append(array or [])
            array = None
        elif t[:1] in b"(<":
            (args if array is None else array).append(_string(t))
        elif t[:1] == b"/":
            args.append(t)
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            (args if array is None else array).append(float(t))
        else:
            n = [a for a in args if isinstance(a, float)]
            if t == b"q":
                stack.append(ctm)
            elif t == b"Q" and stack:
                ctm = stack.pop()
            elif t == b"cm" and len(n) >= 6:
                ctm = _times(tuple(n[-6:]), ctm)
            elif t == b"BT":
                tm = line = unit
            elif t == b"Tf" and n:
                size = n[-1]
            elif t == b"Tm" and len(n) >= 6:
                tm = line = tuple(n[-6:])
            elif t in (b"Td", b"TD") and len(n) >= 2:
                leading = -n[-1] if t == b"TD" else leading
                down(n[-2], n[-1])
            elif t == b"TL" and n:
                leading = n[-1]
            elif t == b"Ts" and n:
                rise = n[-1]
            elif t == b"T*":
                down(0, -leading)
            elif t in (b"Tj", b"TJ", b"'", b'"') and args:
                if t in (b"'", b'"'):
                    down(0, -leading)
                yield from show(args[-1] if isinstance(args[-1], list) else [args[-1]])
            args = []


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(n): body for n, _, body in _OBJECT.findall(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body and (s := _stream(body)) is not None:
            count, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"N", b"First"))
            heads = list(map(int, s[:first].split()))[: 2 * count]
            for n, at, end in zip(heads[::2], heads[1::2], [*heads[3::2], len(s) - first], strict=False):
                found.setdefault(n, s[first + at : first + end])
    return found


def _stream(body: bytes) -> bytes | None:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not m:
        return None
    if b"/FlateDecode" not in body:
        return m[1][:MOST_STREAM]
    try:
        return zlib.decompressobj().decompress(m[1], MOST_STREAM)
    except zlib.error:
        return None


def pages(data: bytes) -> Iterator[bytes]:
    """Content streams of a file's pages, in the page tree's order."""
    found = _objects(data)
    refs = lambda body, key: [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", (re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body) or [b"", b""])[1])]
    root = next((n for n, b in found.items() if re.search(rb"/Type\s*/Catalog", b)), None)
    todo = refs(found[root], b"Pages") if root is not None else [n for n, b in found.items() if re.search(rb"/Type\s*/Page\b", b)]
    seen: set[int] = set()
    while todo:
        n = todo.pop(0)
        body = found.get(n, b"")
        if n in seen:
            continue
        seen.add(n)
        if re.search(rb"/Type\s*/Pages\b", body):
            todo = refs(body, b"Kids") + todo
        elif body:
            yield b"\n".join(s for c in refs(body, b"Contents") if (s := _stream(found.get(c, b""))) is not None)


def metadata(data: bytes) -> dict[str, str]:
    """The text fields of a file's information dictionary, without NULs and blanks at the ends; empty ones are left out."""
    found = _objects(data)
    m = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", data)
    body = found.get(int(m[1]), b"") if m else b""
    pairs = re.findall(rb"/(\w+)\s*(\((?:\\.|[^()\\])*\)|<[0-9A-Fa-f\s]*>)", body)
    return {k.decode(): v for k, raw in pairs if (v := _string(raw).replace("\0", "").strip())}


def _records(path: str, data: bytes) -> Iterator[tuple]:
    """The rows of SCHEMA of one file."""
    error = None if data[:1024].find(b"%PDF-") >= 0 else "not_a_pdf"
    if error is None and re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        error = "encrypted"
    if error:
        yield (path, None, None, None, None, None, None, None, None, None, None, error)
        return
    for number, content in enumerate(pages(data), 1):
        if number > MOST_PAGES:
            yield (path, number, None, None, None, None, None, None, None, None, None, "too_many_pages")
            return
        size = 0
        for k, (text, x, y, w, s) in enumerate(fragments(content)):
            size += len(text)
            if size > MOST_TEXT:
                break
            yield (path, number, f"p{number}_f{k}", k, text, x, y, w, s, s, False, None)


def fragments_of(files: DataFrame) -> DataFrame:
    """SCHEMA of files (doc_id, content). A file without pages, and each page without text, has a row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out = list(_whole(doc, data.as_py()))
                for k in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 10_000], strict=True), _TYPES, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return files.select("doc_id", "content").mapInArrow(run, SCHEMA)


def _whole(path: str, data: bytes) -> Iterator[tuple]:
    """_records, and an error row where a file has no pages or a page no text."""
    seen, failed = set(), False
    for r in _records(path, data):
        seen.add(r[1])
        failed |= r[-1] is not None
        yield r
    if failed:
        return
    count = sum(1 for _ in pages(data))
    for number in [n for n in range(1, count + 1) if n not in seen] or ([None] if not count else []):
        yield (path, number, *[None] * 9, "no_text_layer" if number else "no_pages")


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in sorted(glob.glob(self.path))] or [_File("")]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        path = part.value
        if not path:
            return
        with open(path, "rb") as f:
            data = f.read()
        yield from _records(path, data)


class PdfSource(DataSource):
    """``spark.read.format("pdf_fragments").load(glob)``: a row for each positioned string, or one with an error for each file that can't be read."""

    @classmethod
    def name(cls) -> str:
        return "pdf_fragments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfSource)
