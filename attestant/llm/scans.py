"""Noise of scanned pages: running headers, page numbers, words broken over rows and misread letters.

Every word of all rows is counted, apart in scanned and in clean rows. A word that clean rows lack is compared with frequent words by
anagram hashes: the letters' class values add up, whatever their order, so one letter read as another of its class makes no difference and
a pair read as one letter makes a known one. Words whose hashes meet by such a difference are joined in SQL, checked letter by letter, and
the correction that is most frequent and changes least is taken.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestant.llm.common import per_batch
from attestant.sources.tables import cut_lineage

#: A misread word occurs in clean rows less than this share of what its count in scans lets expect; a correction occurs this many times as often, and so often at least.
CLEAN_SHARE, TIMES, LEAST = 0.15, 4, 5
#: At most so many frequent words are sent to every task, to skip words that need no look.
COMMON = 20_000

# Letters that scans take for one another, a class each.
CLASSES = ("aoec0", "trf", "li1|!íì", "hb8ß6", "un", "yv", "s5", "gq9", "z2", "kx")
# Pairs of letters that look like one, in both directions.
PAIRS = {"rn": "m", "in": "m", "cl": "d", "li": "h", "vv": "w", "ll": "u", "ii": "u", "lc": "k", "ri": "n", "fi": "ﬁ", "fl": "ﬂ"}
#: Capital letters taken for one another whose small forms are in different classes.
SINGLES = (("f", "e"), ("c", "g"), ("b", "e"), ("p", "r"))
BREAKS = "-‐‑¬\xad"

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_NUMBER = re.compile(r"(?i)^\W*(?:(?:p[a-z0-9]{2,3}|s[e3][il1]te|pag[il1]na|стр\w*|صفحة|पृष्ठ)\.?\s*)?[\doOlIiSBsb|]{1,6}(?:\s*(?:of|ot|0f|/|von|de|di|van|из)\s*[\doOlIiSB|]{1,6})?\W*$")
_BROKEN = re.compile(rf"([^\W\d_]+)\s?[{BREAKS}]\s*$")
_HEAD = re.compile(r"^\W*([^\W_]+)")
_MIXED = re.compile(r"^(?=.*[^\W\d_].*[^\W\d_])(?!\d+(?:st|nd|rd|th)$)[^\W\d_]*[0158][^\W\d_]+(?:[0158][^\W\d_]*)?$|^[^\W\d_]{3,}[0158]$")

_LONE_L = re.compile(r"(?<!\S)l(?=\s|$)")  # a capital I standing alone, read as a small l

_CLASS = {c: k[0] for k in CLASSES for c in k}
_CLASS_PAIRS = tuple({("".join(_CLASS.get(c, c) for c in pair), _CLASS.get(one, one)) for pair, one in PAIRS.items() if one.isascii()})


@lru_cache(maxsize=200_000)
def letters(word: str) -> str:
    """Lower-case letters without marks, ligatures undone."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


_MODULUS = 1 << 61


@lru_cache(maxsize=1024)
def _value(c: str) -> int:
    return zlib.crc32(c.encode()) * 2_654_435_761 % (1 << 52)


def anagram(word: str) -> int:
    """Sum of the values of a word's letter classes, by a modulus that keeps it in 64 bits for words of any length."""
    return sum(_value(_CLASS.get(c, c)) for c in letters(word)) % _MODULUS


def differences(word: str) -> list[int]:
    """Hashes of the words that this one may be misread from: no pair, one pair, or two pairs of letters taken for one or the reverse."""
    w = letters(word)
    steps = []
    classes = "".join(_CLASS.get(c, c) for c in w)
    for pair, one in _CLASS_PAIRS:
        change = sum(map(_value, pair)) - _value(one)
        steps += [-change] * min(2, classes.count(pair)) + [change] * min(2, classes.count(one))
    for x, y in SINGLES:
        change = _value(_CLASS.get(x, x)) - _value(_CLASS.get(y, y))
        steps += [-change] * (x in w) + [change] * (y in w)
    base = anagram(word)
    return sorted({base, *((base + a) % _MODULUS for a in steps), *((base + a + b) % _MODULUS for a, b in combinations(steps, 2))})


@lru_cache(maxsize=400_000)
def misread_as(word: str, right: str) -> int | None:
    """Number of misread places if ``word`` can be ``right`` misread, else null."""
    a, b = letters(word), letters(right)
    x, y = ("".join(_CLASS.get(c, c) for c in w) for w in (a, b))
    best: dict[tuple[int, int], int] = {(0, 0): 0}
    for i in range(len(a) + 1):
        for j in range(max(0, i - 3), min(len(b), i + 3) + 1):
            n = best.get((i, j))
            if n is None:
                continue
            if i < len(a) and j < len(b) and (a[i] == b[j] or _CLASS.get(a[i], a[i]) == _CLASS.get(b[j], b[j])):
                _set(best, (i + 1, j + 1), n + (a[i] != b[j]))
            if i < len(a) and j < len(b) and ((a[i], b[j]) in SINGLES or (b[j], a[i]) in SINGLES):
                _set(best, (i + 1, j + 1), n + 1)
            # a pair taken for one letter, and each of them perhaps for another of its class
            for pair, one in _CLASS_PAIRS:
                if j < len(b) and x[i : i + 2] == pair and y[j] == one:
                    _set(best, (i + 2, j + 1), n + 1)
                if i < len(a) and y[j : j + 2] == pair and x[i] == one:
                    _set(best, (i + 1, j + 2), n + 1)
    n = best.get((len(a), len(b)))
    if n is None:
        return None
    marks = word.lower() != a or right.lower() != b
    return n + (1 if n == 0 and marks and word.lower() != right.lower() else 0)


def _set(best: dict, key: tuple[int, int], n: int) -> None:
    if n < best.get(key, 1 << 30):
        best[key] = n


def word_counts(rows: DataFrame) -> DataFrame:
    """word (lower case), scanned, clean: counts in the texts of scanned and other rows, added up in each batch before they are shuffled."""

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            counts = (Counter(), Counter())
            for text, scanned in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[scanned].update(WORD.findall(text.lower()))
            words = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], ["word", "scanned", "clean"])

        return step

    counted = per_batch(rows.filter("text is not null").select("text", (F.coalesce("source", F.lit("")) == "ocr").alias("ocr")), make, "word string, scanned long, clean long")
    return counted.groupBy("word").agg(F.sum("scanned").alias("scanned"), F.sum("clean").alias("clean"))


def corrections(counts: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """word, right: the correction of each misread word. ``also`` has further words to look at (joined halves), with count ``scanned``.

    Of equally good corrections the first in the alphabet is taken.
    """
    total = counts.agg(F.sum("scanned").alias("s"), F.sum("clean").alias("c")).first()
    expect = (total["c"] or 0) / max(1, total["s"] or 0)
    seen = counts if also is None else counts.unionByName(also.select("word", "scanned", F.lit(0).cast("long").alias("clean"))).groupBy("word").agg(F.sum("scanned").alias("scanned"), F.sum("clean").alias("clean"))
    # without clean rows the counts alone decide
    doubtful = seen.filter((F.col("scanned") > 0) & (F.col("clean") < CLEAN_SHARE * expect * F.col("scanned")) | (F.lit(expect == 0) & (F.col("scanned") > 0)))
    frequent = counts.filter(F.col("scanned") + F.col("clean") >= LEAST).select("word", (F.col("scanned") + F.col("clean")).alias("n"), ((F.col("clean") >= CLEAN_SHARE * expect * F.col("scanned")) | F.lit(expect == 0)).alias("sound")).filter("sound")

    def hashed(wide: bool):
        def make():
            def step(b: pa.RecordBatch) -> pa.RecordBatch:
                words = b.column(0).to_pylist()
                values = [differences(w) if wide else [anagram(w)] for w in words]
                return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(values, pa.list_(pa.int64()))], ["word", "n", "hashes"])

            return step

        return make

    rare = per_batch(doubtful.select("word", F.col("scanned").alias("n")), hashed(True), "word string, n long, hashes array<long>").select("word", "n", F.explode("hashes").alias("h"))
    known = per_batch(frequent.select("word", "n"), hashed(False), "word string, n long, hashes array<long>").select(F.col("word").alias("right"), F.col("n").alias("m"), F.explode("hashes").alias("h"))
    met = rare.join(known.hint("merge"), "h").filter((F.col("word") != F.col("right")) & (F.col("m") >= TIMES * F.col("n"))).select("word", "right", "m").distinct()

    def check():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            n = [misread_as(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int32())], ["word", "right", "m", "changes"])

        return step

    checked = per_batch(met, check, "word string, right string, m long, changes int").filter("changes is not null")
    # a change more must be made up for by eight times the frequency
    merit = F.log2(F.col("m").cast("double")) - 3 * F.col("changes")
    return checked.groupBy("word").agg(F.min(F.struct((-merit).alias("r"), F.col("right"))).alias("best")).select("word", F.col("best.right").alias("right"))


_ROW = pa.struct([("id", pa.string()), ("noise", pa.list_(pa.string())), ("words", pa.list_(pa.string())), ("joined", pa.string()), ("cut", pa.int32()), ("next_id", pa.string())])
_PAGE = pa.schema([("doc_id", pa.string()), ("page", pa.int32()), ("rows", pa.list_(_ROW)), ("tail_id", pa.string()), ("tail", pa.string()), ("head_id", pa.string()), ("head", pa.string())])
_PAGE_DDL = "doc_id string, page int, rows array<struct<id:string,noise:array<string>,words:array<string>,joined:string,cut:int,next_id:string>>, tail_id string, tail string, head_id string, head string"


def _page(doc: str, page: int, records: list[tuple], common: frozenset[str]) -> tuple | None:
    rows: dict[str, tuple] = {}
    spoken: set[str] = set()
    for r in records:
        if r[0] == 0:
            old = rows.get(r[2])
            if old is None or (r[3] or 0) > (old[3] or 0):
                rows[r[2]] = r
        else:
            spoken.add(r[2])
    if not rows:
        return None
    ordered = sorted(rows.values(), key=lambda r: (r[1] is None, r[1], r[2] or ""))
    testimony = [r for r in ordered if r[2] in spoken and r[5] not in ("examination_heading", "parenthetical")]
    out, tail, head = [], (None, None), (None, None)
    if testimony:
        m = _HEAD.match(testimony[0][4] or "")
        head = (testimony[0][2], m[1] if m else None)
    broken: dict[str, tuple[str, str | None, str | None]] = {}
    skip_first: set[str] = set()
    for a, b in zip(testimony, [*testimony[1:], None], strict=False):
        m = _BROKEN.search(a[4] or "")
        if m:
            if b is None:
                tail = (a[2], m[1])
                broken[a[2]] = (m[1], None, None)
            elif (h := _HEAD.match(b[4] or "")) and h[1][0].islower() | h[1][0].isdigit() and not _marked(b[4]):
                broken[a[2]] = (m[1], h[1], b[2])
                skip_first.add(b[2])
    last = len(ordered) - 1
    for k, r in enumerate(ordered):
        text, rid = r[4] or "", r[2]
        noise: list[str] = []
        if rid not in spoken:
            edge = k <= 1 or k >= last - 1
            if edge and text.strip():
                noise.append("page_number" if _NUMBER.match(text) else "header")
            if noise:
                out.append((rid, noise, None, None, None, None))
            continue
        words = WORD.findall(text.lower())
        joined = cut = nxt = None
        if rid in broken:
            part, rest, nxt = broken[rid]
            words = words[:-1]
            if rest is not None:
                noise.append("hyphen")
                joined, cut = (part + rest).lower(), len(part)
        if rid in skip_first and words:
            words = words[1:]
        if _LONE_L.search(text) or "ﬁ" in text or "ﬂ" in text or any(_MIXED.match(w) for w in words):
            noise.append("misread")
        doubtful = sorted({w for w in words if w not in common})
        if noise or doubtful:
            out.append((rid, noise, doubtful, joined, cut, nxt))
    names = _ROW.names
    return (doc, page, [dict(zip(names, r, strict=True)) for r in out], tail[0], tail[1], head[0], head[1])


_MARKED = re.compile(r"^\s*(?:Q|A|QUESTION|ANSWER)\b\s*[.:]|^\s*[QA]\s{2,}|^[^:]{2,40}:\s")


def _marked(text: str) -> bool:
    return bool(_MARKED.match(text))


def pages(rows: DataFrame, lines: DataFrame, common: list[str]) -> DataFrame:
    """One record for each page with scanned rows: what noise each row has of itself, its doubtful words, and how it hangs together with the next page.

    Rows delivered twice count once. Rows without a line are page furniture: at the page's edge they are headers or page numbers.
    """
    frequent = frozenset(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PAGE.types, strict=True)], schema=_PAGE)

        def flush() -> None:
            if held and held[0][0] == 0 and (p := _page(*key, held, frequent)):
                out.append(p)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:2] != key:
                    flush()
                    key, held = r[:2], []
                held.append(r[2:])
            if len(out) > 500:
                yield made()
                out = []
        flush()
        if out:
            yield made()

    none = lambda kind: F.lit(None).cast(kind)
    a = rows.filter("source = 'ocr'").select("doc_id", F.col("physical_page").alias("page"), F.lit(0).alias("what"), F.col("row_index").alias("row"), "id", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("at"), "text", "event_kind")
    b = lines.select("doc_id", F.col("physical_page").alias("page"), F.lit(1).alias("what"), none("int").alias("row"), F.col("source_row_id").alias("id"), none("long").alias("at"), none("string").alias("text"), none("string").alias("event_kind"))
    both = a.unionByName(b).filter("doc_id is not null and page is not null and id is not null")
    return both.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "what").mapInArrow(run, _PAGE_DDL)


def common_words(counts: DataFrame) -> list[str]:
    """The most frequent words that clean rows have as well, at most COMMON. Words rarer than one in 20 * COMMON are left out before anything is sorted."""
    total = counts.agg(F.sum("scanned").alias("s"), F.sum("clean").alias("c")).first()
    expect = (total["c"] or 0) / max(1, total["s"] or 0)
    if not expect:
        return []
    sound = counts.filter((F.col("clean") >= CLEAN_SHARE * expect * F.col("scanned")) & (F.col("clean") * (20 * COMMON) >= (total["c"] or 0)))
    return [r["word"] for r in sound.orderBy(F.desc("clean"), "word").limit(COMMON).select("word").collect()]


def examined(rows: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(noise, misread words, hyphens): (doc_id, id, noise), (doc_id, id, word, right), (doc_id, id, next_id, joined, right, cut)."""
    counts = cut_lineage(word_counts(rows))
    paged = cut_lineage(pages(rows, lines, common_words(counts)))
    inner = paged.select("doc_id", F.explode("rows").alias("r")).select("doc_id", "r.*")
    order = W.partitionBy("doc_id").orderBy("page")
    over = paged.filter("head_id is not null").select("doc_id", "tail_id", "tail", F.lead("head_id").over(order).alias("next_id"), F.lead("head").over(order).alias("next"))
    over = over.filter("tail_id is not null and next is not null").filter(F.col("next").rlike(r"^[\p{Ll}\p{Lo}0-9]"))
    heads = over.select("doc_id", F.col("next_id").alias("id"), F.lower("next").alias("word"))
    over = over.select("doc_id", F.col("tail_id").alias("id"), F.lower(F.concat("tail", "next")).alias("joined"), F.length("tail").alias("cut"), "next_id")
    hyphens = cut_lineage(inner.filter("joined is not null").select("doc_id", "id", "joined", "cut", "next_id").unionByName(over))
    right = cut_lineage(corrections(counts, hyphens.groupBy(F.col("joined").alias("word")).agg(F.count("*").alias("scanned"))))
    # the second half of a word broken over a page break is no word of its own
    misread = inner.select("doc_id", "id", F.explode("words").alias("word")).join(right.hint("merge"), "word").join(heads.hint("merge"), ["doc_id", "id", "word"], "left_anti")
    hyphened = hyphens.join(right.withColumnRenamed("word", "joined").hint("merge"), "joined", "left")
    noise = inner.select("doc_id", "id", F.explode("noise").alias("noise")).unionByName(over.select("doc_id", "id", F.lit("hyphen").alias("noise")))
    return noise, misread, hyphened


def _half(hyphened: DataFrame) -> DataFrame:
    """The rows of a broken word's misread letters: the half that differs from the correction's, before or after the break."""
    right, cut = F.col("right"), F.col("cut")
    apart = F.length(right) - F.length("joined")
    first = F.substring("joined", F.lit(1), cut) != F.substring(right, F.lit(1), cut)
    # with as many letters the halves can be compared; else the half whose own letters no longer fit
    second = F.substring("joined", cut + 1, F.lit(100)) != F.substring(right, cut + 1 + apart, F.lit(100))
    both = hyphened.filter("right is not null")
    return both.filter(first).select("doc_id", "id").unionByName(both.filter(second).select("doc_id", F.col("next_id").alias("id")))


def findings(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, row_id, noise ('header', 'page_number', 'hyphen', 'misread') of scanned rows."""
    noise, misread, hyphened = examined(rows, lines)
    words = misread.select("doc_id", "id").unionByName(_half(hyphened)).withColumn("noise", F.lit("misread"))
    return noise.unionByName(words).select("doc_id", F.col("id").alias("row_id"), "noise").distinct()


def paragraphs(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page, paragraph_no, text: the scanned rows of a page as continuous paragraphs, repaired.

    Headers and page numbers are left out, broken words joined, misread words put right; a paragraph begins at a question or answer mark or
    a speaker's label. A word broken over a page break is joined on the page where it begins.
    """
    noise, misread, hyphened = examined(rows, lines)
    edges = noise.filter(F.col("noise").isin("header", "page_number")).select("doc_id", "id").distinct()
    fixes = misread.groupBy("doc_id", "id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "right")))).alias("fixes"))
    starts = hyphened.groupBy("doc_id", "id").agg(F.first(F.struct(F.coalesce("right", "joined").alias("whole"), F.lit(True).alias("is"))).alias("start"))
    ends = hyphened.groupBy("doc_id", F.col("next_id").alias("id")).agg(F.lit(True).alias("drop_first"))
    once = rows.filter("source = 'ocr'").groupBy("doc_id", "id").agg(F.max_by(F.struct("physical_page", "row_index", "text"), F.coalesce(F.col("ingested_at").cast("timestamp"), F.lit(0).cast("timestamp"))).alias("r"))
    full = once.join(edges, ["doc_id", "id"], "left_anti").join(fixes, ["doc_id", "id"], "left").join(starts, ["doc_id", "id"], "left").join(ends, ["doc_id", "id"], "left")
    pieces = full.select("doc_id", F.col("r.physical_page").alias("page"), F.struct(F.col("r.row_index").alias("row"), F.col("r.text").alias("text"), F.col("fixes"), F.col("start.whole").alias("whole"), F.coalesce("drop_first", F.lit(False)).alias("drop_first")).alias("p"))
    grouped = pieces.groupBy("doc_id", "page").agg(F.collect_list("p").alias("rows"))

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc, page, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                made: list[str] = []
                for p in sorted(parts, key=lambda p: (p["row"] is None, p["row"])):
                    text = repaired(p["text"] or "", dict(p["fixes"] or ()), p["whole"], p["drop_first"])
                    if text:
                        if made and not _marked(p["text"] or ""):
                            made[-1] += " " + text
                        else:
                            made.append(text)
                out += [(doc, page, i + 1, t) for i, t in enumerate(made)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["doc_id", "page", "paragraph_no", "text"])

        return step

    return per_batch(grouped, make, "doc_id string, page int, paragraph_no int, text string")


def repaired(text: str, fixes: dict[str, str], whole: str | None, drop_first: bool) -> str:
    """A row's text with misread words replaced, its broken last word whole, and its first word left out if the row before has it."""
    if drop_first:
        text = re.sub(r"^\W*[^\W_]+", "", text, count=1)

    def put(m: re.Match) -> str:
        r = fixes.get(m.group().lower())
        if r is None:
            return m.group()
        return r.upper() if m.group().isupper() and len(r) > 1 else r.capitalize() if m.group()[:1].isupper() else r

    text = WORD.sub(put, text)
    if whole:
        text = _BROKEN.sub(whole, text)
    return text.strip()
