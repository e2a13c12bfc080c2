"""Evaluation texts that leaked into a corpus.

The items' normalised n-grams make a hash set that goes to every task; every window of every page is looked up in it. Scans break words and
misread letters, so the tokens of the windows are letters: case, punctuation, line and word breaks fall away, and letters that scans take
for one another are one token. Every hit is verified: from it the item and the page are compared word by word to both sides, and the
consecutive words that are the same but for misread letters are counted. Pages are read column by column, whatever order their lines are stored in.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestant.llm.common import chunks, per_batch, unmerged

#: Letters in a window, consecutive words that make a leak, characters of items looked for in one pass, and pixels between columns.
WINDOW, LEAST_WORDS, PASS_CHARS, COLUMN_GAP = 16, 18, 5_000_000, 60

# Letters that scans take for one another (one token each), and pairs taken for one letter.
CLASSES = ("aoec0", "trf", "li1|!j", "hb8ß6", "un", "yv", "s5", "gq9", "z2", "kx")
PAIRS = (("ii", "h"), ("rn", "m"), ("in", "m"), ("al", "d"), ("vv", "w"))

_TOP = 0x2000


def _table() -> np.ndarray:
    """Token of each code point below _TOP; 0: none. Marks are dropped, capitals are small letters."""
    table = np.zeros(_TOP, np.uint8)
    first = {c: k[0] for k in CLASSES for c in k}
    codes: dict[str, int] = {}
    for p in range(33, _TOP):
        base = unicodedata.normalize("NFKD", chr(p).lower())[:1]
        if base.isalnum() or base in "|!":
            if base in "|!" and chr(p) in "|!":
                continue  # as marks they are dropped, as letters they would be rare
            base = first.get(base, base)
            table[p] = codes.setdefault(base, 1 + len(codes) % 250)
    return table


_TOKENS = _table()
_CODE = lambda c: _TOKENS[ord(c)]
_LIGATURES = {"ﬁ": "fi", "ﬂ": "fl"}
_POWERS = (np.uint64(0x9E3779B97F4A7C15), *(np.uint64(pow(0x9E3779B97F4A7C15, 2**k, 1 << 64)) for k in range(1, 4)))


def tokens(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letter tokens of a text and the position of each in it."""
    for a, b in _LIGATURES.items():
        if a in text:
            text = text.replace(a, b)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    codes = _TOKENS[np.minimum(points, _TOP - 1)]
    where = np.flatnonzero(codes)
    return _paired(codes[where], where)


def _paired(codes: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that look like one letter become it; of a run of one letter all do."""
    for pair, one in PAIRS:
        a, b = _CODE(pair[0]), _CODE(pair[1])
        hit = (codes[:-1] == a) & (codes[1:] == b)
        if hit.any():
            codes = codes.copy()
            keep = np.ones(len(codes), bool)
            keep[1:][hit] = False
            start = hit.copy()
            if a == b:
                start[1:] &= ~hit[:-1]
            codes[:-1][start] = _CODE(one)
            codes, where = codes[keep], where[keep]
    return codes, where


def windows(codes: np.ndarray) -> np.ndarray:
    """Hash of each window of WINDOW tokens, by doubling."""
    h = codes.astype(np.uint64) + np.uint64(1)
    width = 1
    for p in _POWERS:
        if len(h) <= width:
            return np.zeros(0, np.uint64)
        h = h[:-width] * p + h[width:]
        width *= 2
    return h


class Index:
    """Windows of the items: sorted hashes with their places, and a table of bits for the first look."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.texts = [" ".join((t or "").split()) for _, t in items]
        hashes, owner, place = [], [], []
        self.codes, self.words = [], []
        for k, t in enumerate(self.texts):
            codes, where = tokens(t)
            # the token range of each word: of a pair over a word break the token belongs to the word it begins in
            starts = np.array([m.start() for m in re.finditer(r"\S+", t)], np.int64)
            ends = np.array([m.end() for m in re.finditer(r"\S+", t)], np.int64)
            spans = np.stack([np.searchsorted(where, starts), np.searchsorted(where, ends)], 1) if len(starts) else np.zeros((0, 2), np.int64)
            self.codes.append(codes)
            self.words.append(spans[spans[:, 1] > spans[:, 0]])
            h = windows(codes)
            hashes.append(h)
            owner.append(np.full(len(h), k, np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        # tokens of the words and their first tokens; and the words from the right, turned round
        self.forward = [([c[a:z].tobytes() for a, z in w], w[:, 0].tolist()) for c, w in zip(self.codes, self.words, strict=True)]
        self.backward = [[x[::-1] for x in reversed(f)] for f, _ in self.forward]
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owner = (np.concatenate(owner) if owner else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.hashes >> np.uint64(42)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Positions of windows whose hash is in the set."""
        maybe = np.flatnonzero(self.bits[h >> np.uint64(42)])
        if not len(maybe) or not len(self.hashes):
            return maybe[:0]
        at = np.searchsorted(self.hashes, h[maybe])
        return maybe[self.hashes[np.minimum(at, len(self.hashes) - 1)] == h[maybe]]

    def leaks(self, codes: np.ndarray, h: np.ndarray, hits: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int, int, int]]:
        """(item, words, first token, token after) for each passage of an item that has enough of its consecutive words."""
        lo, hi = np.searchsorted(self.hashes, h[hits], "left"), np.searchsorted(self.hashes, h[hits], "right")
        count = hi - lo
        doc_at = np.repeat(hits, count)
        which = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        owner, place = self.owner[which], self.place[which]
        # runs of windows of one item on one diagonal are seeds
        diagonal = doc_at - place
        order = np.lexsort((doc_at, diagonal, owner))
        owner, place, doc_at, diagonal = owner[order], place[order], doc_at[order], diagonal[order]
        firsts = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(diagonal) != 0) | (np.diff(doc_at) > 1)]))
        lasts = np.concatenate([firsts[1:], [len(owner)]]) - 1
        seeds: dict[int, list[tuple[int, int, int]]] = {}
        for k, a, x, b in zip(owner[firsts].tolist(), place[firsts].tolist(), doc_at[firsts].tolist(), (place[lasts] + WINDOW).tolist(), strict=True):
            seeds.setdefault(k, []).append((a, x, b))
        page = codes.tobytes()
        page_back = page[::-1]
        return [(k, *p) for k, found in seeds.items() if self.forward[k][0] for p in self._passages(page, page_back, k, sorted(found), least)]

    def _passages(self, page: bytes, page_back: bytes, k: int, seeds: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
        """(words, first token, token after) of every run of at least ``least`` consecutive words of the item, each stretch of the page once.

        From the first word of each seed (place in the item, in the page, end in the item) on the item and the page are compared word by word,
        to the right and to the left; the first word that is not the same, but for misread letters, ends the run.
        """
        words, starts = self.forward[k]
        words_back = self.backward[k]
        total = len(words)
        found: list[tuple[int, int, int]] = []
        reached: list[tuple[int, int, int, int]] = []  # words and tokens of the runs so far
        for a, x, b in seeds:
            lo = bisect.bisect_left(starts, a)
            # the first word within the seed, or the one the seed lies in
            if lo == total or starts[lo] >= b:
                lo -= 1
            start = x + starts[lo] - a
            if lo < 0 or start < 0 or any(f <= lo < z and p <= start < q for f, z, p, q in reached):
                continue
            after, y = _extended(page, words, lo, start)
            before, back = _extended(page_back, words_back, total - lo, len(page) - start)
            first = len(page) - back
            reached.append((lo - before, lo + after, first, y))
            if before + after >= least:
                found.append((before + after, first, y))
        # a passage within a longer one (of words the item has twice) tells nothing more
        kept: list[tuple[int, int, int]] = []
        for p in sorted(found, key=lambda p: (p[1], -p[2], -p[0])):
            if not kept or p[2] > kept[-1][2]:
                kept.append(p)
            elif p[0] > kept[-1][0]:
                kept[-1] = (p[0], *kept[-1][1:])
        return kept


def _extended(page: bytes, words: list[bytes], first: int, start: int) -> tuple[int, int]:
    """How many words of an item from the ``first`` on follow one another in the page from ``start`` on, and the token after the last.

    A word may be a token longer or shorter in the page, so several positions may follow it; all are tried, that with the fewest wrong
    tokens counts. A word that stands there to the letter, and the next word behind it, leave no choice.
    """
    k, last = first, len(words)
    states = {start: 0}
    while k < last:
        want = words[k]
        n = len(want)
        after: dict[int, int] = {}
        for at, cost in states.items():
            exact = page.startswith(want, at)
            if exact and k + 1 < last and page.startswith(words[k + 1], at + n):
                after[at + n] = min(cost, after.get(at + n, cost))
                continue
            for m in (n, n + 1, n - 1) if n > 3 else (n,):
                wrong = _wrong(want, page[at : at + m]) if at + m <= len(page) else None
                if wrong is not None and cost + wrong < after.get(at + m, 1 << 30):
                    after[at + m] = cost + wrong
        if not after:
            break
        states, k = after, k + 1
    return k - first, min(states, key=lambda p: (states[p], p))


def _wrong(want: bytes, have: bytes) -> int | None:
    """How many tokens are wrong where two words are the same but for misread letters, one in five or six; null for different words.

    Of words a token apart all other tokens must be the same.
    """
    if want == have:
        return 0
    n, m = len(want), len(have)
    if n == m:
        wrong = sum(map(int.__ne__, want, have))
        return wrong if n > 2 and wrong <= max(1, n // 5) else None
    long, short = (want, have) if n > m else (have, want)
    if len(long) - len(short) != 1:
        return None
    k = next((i for i, c in enumerate(short) if c != long[i]), len(short))
    return 1 if long[k + 1 :] == short[k:] else None


def reading_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Order of lines column by column: columns by their left edges, lines by their tops."""
    by_x = np.argsort(x, kind="stable")
    column = np.empty(len(x), np.int64)
    column[by_x] = np.r_[0, np.cumsum(np.diff(x[by_x]) > COLUMN_GAP)] if len(x) else []
    return np.lexsort((y, column))


def in_columns(text: str, line_no: list, x: list, y: list) -> str:
    """The text's lines in reading order; as they are where a line has no box."""
    lines = text.split("\n")
    if len(lines) < 3 or len(x) != len(lines):
        return text
    order = np.lexsort((np.arange(len(line_no)), np.array(line_no)))
    left, top = np.array(x)[order], np.array(y)[order]
    if not (np.diff(left) < -COLUMN_GAP).any():  # columns come one after another
        return text
    return "\n".join(lines[k] for k in reading_order(left, top))


def boxed(documents: DataFrame) -> DataFrame:
    """doc_id, text and the lines' numbers, left edges and tops, each an array."""
    return documents.select("doc_id", "text", F.col("line_boxes.line_no").alias("no"), F.col("line_boxes.x_left").alias("x"), F.col("line_boxes.y_top").alias("y"))


def passages(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, words, text (in reading order), first, after (characters of the passage in it) of each passage of each leaked item in each page.

    Null and empty texts leak nothing. Pages scanned again count each. Items are looked for in passes of PASS_CHARS characters, so what is
    sent to the tasks is bounded; each pass reads the corpus once.
    """
    sizes = items.filter("text is not null").select("item_id", F.length("text").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // PASS_CHARS))
    out = None
    for part in range(parts):
        chosen = items.filter("text is not null") if parts == 1 else items.filter("text is not null").filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        found = _passages(documents, [(r["item_id"], r["text"]) for r in chosen.select("item_id", "text").distinct().orderBy("item_id", "text").collect()])
        out = found if out is None else out.unionByName(found)
    return out


def _passages(documents: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(items)

    def make():
        index = Index(sent.value)

        def step(b: pa.RecordBatch) -> pa.RecordBatch | None:
            texts = ordered_texts(b)
            for a, z in _LIGATURES.items():  # same length, so that positions hold
                texts = [t.replace(a, z[0]) if a in t else t for t in texts]
            out = [(k, index.ids[item], n, texts[k], first, after) for lo, up in chunks(texts) for k, item, n, first, after in _in_chunk(index, texts[lo:up], lo)]
            if not out:
                return None
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()), strict=True))], ["doc_id", "item_id", "words", "text", "first", "after"])

        return step

    return per_batch(boxed(documents.filter("text is not null")), make, "doc_id long, item_id long, words int, text string, first int, after int")


def _in_chunk(index: Index, texts: list[str], base: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, words, first, after) for the leaks in some texts: one run over all of them, windows over a text's end cut out."""
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    codes, where = tokens("\n".join(texts))
    h = windows(codes)
    hits = index.hits(h)
    doc = np.searchsorted(starts, where[hits], "right") - 1
    same = where[hits + WINDOW - 1] < starts[doc + 1]
    hits, doc = hits[same], doc[same]
    bounds = np.searchsorted(where, starts)
    for k in np.unique(doc):
        lo, up = bounds[k], bounds[k + 1]
        for item, n, x, y in index.leaks(codes[lo:up], h[lo:up], hits[doc == k] - lo):
            last = min(lo + y, up) - 1
            after, stop = int(where[last] - starts[k]) + 1, int(where[last + 1] - starts[k]) if last + 1 < up else len(texts[k])
            while after < stop and _CODE(min(texts[k][after], chr(_TOP - 1))):  # of letters taken for one the last ones have no token
                after += 1
            yield base + int(k), item, n, int(where[lo + x] - starts[k]), after


def ordered_texts(b: pa.RecordBatch) -> list[str]:
    """The texts of a batch of ``boxed`` pages in reading order; null ones as empty ones."""
    texts = [t or "" for t in b.column(1).to_pylist()]
    boxes = [b.column(i) for i in (2, 3, 4)]
    for k in scattered(boxes[1]):
        if all(c[k].is_valid for c in boxes):
            texts[k] = in_columns(texts[k], *(c[k].as_py() for c in boxes))
    return [unmerged(t) if "   " in t else t for t in texts]


def scattered(x: pa.Array) -> np.ndarray:
    """Rows of a list column of left edges that jump back from column to column."""
    flat = x.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    back = np.zeros(len(flat), bool)
    back[1:] = np.diff(flat) < -COLUMN_GAP
    back[offsets[:-1][offsets[:-1] < len(flat)]] = False
    return np.flatnonzero(np.add.reduceat(np.r_[back, False], offsets[:-1]) * (np.diff(offsets) > 0)) if len(offsets) > 1 else np.zeros(0, np.int64)


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, words: pages with enough consecutive words of an item, and how many at most."""
    return passages(documents, items).groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def cleaned(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text of the pages that leaked, without the leaked passages; other pages are as they were and not listed."""
    spans = passages(documents, items).groupBy("doc_id").agg(F.first("text").alias("text"), F.array_sort(F.collect_set(F.struct("first", "after"))).alias("spans"))

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out, at = [], 0
                for s in spans:
                    if s["first"] > at:
                        out.append(t[at : s["first"]])
                    at = max(at, s["after"])
                texts.append("".join([*out, t[at:]]))
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

        return step

    return per_batch(spans, make, "doc_id long, text string")
