"""Text quality of pages: statistics, and what kind of text a page mainly is.

Each line is prose, list, table or junk: hidden states of a Markov model whose signs are statistics of the line (digits, symbols, marks at
its beginning, gaps and figures, common words, likelihood of its letter pairs). The model is trained here, on a bounded sample of pages,
from rules of thumb by repeated labelling; the labels' shares make the page's kind. Statistics are taken for all lines of a batch at once.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestant.llm.common import chunks, per_batch, unmerged
from attestant.llm.leaks import boxed, ordered_texts

STATES = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)
#: Pages the states of the model are fitted to, and common words it knows, at most; letter pairs are counted over all pages.
SAMPLE, WORDS = 3000, 100_000

_TOP = 0x2100
LETTER, DIGIT, SPACE, LINE, POINT, MARK, OTHER = 1, 2, 3, 4, 5, 6, 7
# Marks of ordinary text, and signs that begin an entry of a list.
_POINTS = ".,;:!?'\"’‘“”„«»()-‐‑–—…­¬¿¡/&£$€½¼¾"
_ENTRY = "*•—–-·+▪►"
_VOWELS = frozenset("aeiouyàâäáãåæéèêëíìîïóòôöõøœúùûüýаеиоуыэюя")


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind, letter, entry = np.full(_TOP, OTHER, np.uint8), np.zeros(_TOP, np.uint8), np.zeros(_TOP, bool)
    for p in range(_TOP):
        c = chr(p)
        if c == "\n":
            kind[p] = LINE
        elif c.isspace():
            kind[p] = SPACE
        elif c.isalpha():
            kind[p] = LETTER
            base = unicodedata.normalize("NFKD", c.lower())[:1]
            letter[p] = 1 + ord(base) - 97 if "a" <= base <= "z" else 27
        elif c.isdigit():
            kind[p] = DIGIT
        elif c in _POINTS:
            kind[p] = POINT
        entry[p] = c in _ENTRY
    return kind, letter, entry


_KIND, _LETTERS, _STARTS = _tables()
N_PAIRS = 28 * 28
#: Bins of each sign of a line.
BINS = (6, 6, 5, 6, 6, 7, 5)


def word_hash(word: str) -> int:
    """Hash of a word's lower-case letters, as line_signs makes it."""
    h, power = 0, 1
    for c in word.lower():
        h = (h + (ord(c) + 1) * power) & ((1 << 64) - 1)
        power = power * 1_000_003 & ((1 << 64) - 1)
    return h


_POWERS = np.array([pow(1_000_003, i, 1 << 64) for i in range(64)], np.uint64)
_LOWER = np.array([ord(chr(p).lower()) if len(chr(p).lower()) == 1 else p for p in range(_TOP)], np.uint32)


class Lines:
    """Statistics of the lines of some texts."""

    def __init__(self, texts: list[str], common: np.ndarray):
        points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
        safe = np.minimum(points, _TOP - 1)
        kind = _KIND[safe]
        kind[points >= _TOP] = LETTER  # further scripts
        ends = np.flatnonzero(kind == LINE)
        starts = np.r_[0, ends[:-1] + 1]
        add = lambda mask: np.add.reduceat(mask.astype(np.int32), starts)
        self.per_text = np.array([t.count("\n") + 1 for t in texts])
        self.letters, self.digits, spaces, self.points, self.others = (add(kind == k) for k in (LETTER, DIGIT, SPACE, POINT, OTHER))
        self.length = ends - starts
        self.solid = np.maximum(1, self.length - spaces)
        self.blank = self.length == spaces
        is_letter = kind == LETTER
        before = np.r_[False, is_letter[:-1]]
        word_at = np.flatnonzero(is_letter & ~before)
        word_end = np.flatnonzero(~is_letter & before)
        self.word_line = np.searchsorted(ends, word_at)
        self.word_length = word_end[: len(word_at)] - word_at
        n = len(starts)
        self.words = np.bincount(self.word_line, minlength=n)
        # hashes of words
        hashes = np.zeros(len(word_at), np.uint64)
        for i in range(int(min(24, self.word_length.max(initial=0)))):
            long = np.flatnonzero(self.word_length > i)
            c = points[word_at[long] + i]
            low = np.where(c < _TOP, _LOWER[np.minimum(c, _TOP - 1)], c).astype(np.uint64)
            hashes[long] += (low + np.uint64(1)) * _POWERS[i]
        self.common_word = np.isin(hashes, common) if len(common) else np.zeros(len(word_at), bool)
        self.common = np.bincount(self.word_line, self.common_word, n)
        self.short = np.bincount(self.word_line, self.word_length == 1, n)
        figure = (kind == DIGIT) & ~np.r_[False, (kind == DIGIT)[:-1]]
        self.figures = add(figure)
        gap = (kind == SPACE) & np.r_[False, (kind == SPACE)[:-1]] & ~np.r_[False, False, (kind == SPACE)[:-2]]
        self.gaps = add(gap)
        # dots leading to a figure or word: three or more points in a row
        dot = points == 46
        self.leaders = add(dot & np.r_[False, dot[:-1]] & np.r_[False, False, dot[:-2]])
        first = np.minimum(starts + np.minimum(1, np.maximum(0, self.length - 1)) * (kind[starts] == SPACE), len(points) - 1)
        follows = np.minimum(first + 1, len(points) - 1)
        marked = _STARTS[safe[first]] & (kind[follows] == SPACE)
        # a figure, a point and a space
        number = kind[first] == DIGIT
        p1, p2, p3 = (np.minimum(first + i, len(points) - 1) for i in (1, 2, 3))
        stop = lambda p: (points[p] == 46) | (points[p] == 41)
        numbered = number & (stop(p1) & (kind[p2] == SPACE) | (kind[p1] == DIGIT) & stop(p2) & (kind[p3] == SPACE) | (kind[p1] == DIGIT) & (kind[p2] == DIGIT) & stop(p3))
        self.entry = np.where(marked, 1, np.where(numbered, 2, 0))
        last = np.maximum(starts, ends - 1)
        self.stopped = np.isin(points[last], np.array([ord(c) for c in ".!?;:,"], np.uint32)) & ~self.blank
        pair = np.r_[_LETTERS[safe[:-1]].astype(np.int32) * 28 + _LETTERS[safe[1:]], 0]
        self.pair, self.in_word, self.starts, self.n = pair, is_letter & np.r_[is_letter[1:], False], starts, n

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair[self.in_word], minlength=N_PAIRS)

    def signs(self, pair_logs: np.ndarray) -> np.ndarray:
        """The bins of each line's signs (lines, len(BINS))."""
        logs = np.add.reduceat(np.where(self.in_word, pair_logs[self.pair], 0.0), self.starts)
        pairs = np.maximum(1, np.add.reduceat(self.in_word.astype(np.int32), self.starts))
        words = np.maximum(1, self.words)
        likely = np.where(self.words > 0, logs / pairs, -9.0)
        return np.stack(
            [
                np.digitize(self.digits / self.solid, [0.001, 0.1, 0.25, 0.45, 0.7]),
                np.digitize(self.others / self.solid, [0.001, 0.04, 0.1, 0.2, 0.4]),
                np.where(self.leaders > 0, 3, np.where(self.entry > 0, self.entry, np.where(self.others + self.points > self.letters, 4, 0))),
                np.minimum(5, np.where(self.figures >= 2, 2 + np.minimum(2, self.gaps), np.minimum(1, self.gaps)) + (self.figures >= 4)),
                np.where(self.words == 0, 0, 1 + np.digitize(self.common / words, [0.001, 0.15, 0.3, 0.5])),
                np.where(self.words == 0, 0, 1 + np.digitize(likely, [-4.6, -4.0, -3.5, -3.1, -2.8])),
                np.where(self.words == 0, 0, 1 + np.digitize(self.short / words, [0.001, 0.25, 0.5])),
            ],
            1,
        )

    def by_rule(self, signs: np.ndarray) -> np.ndarray:
        """First labels, by rules of thumb."""
        junk = (signs[:, 1] >= 3) | (signs[:, 5] == 1) & (self.letters > 3) | (self.letters == 0) & (self.digits == 0) | (signs[:, 2] == 4) & (self.digits == 0)
        table = (self.digits / self.solid > 0.25) & (self.figures >= 2)
        entry = (self.entry > 0) & (self.figures <= 2) | (self.leaders > 0)
        return np.where(junk, JUNK, np.where(table, TABLE, np.where(entry, LIST, PROSE)))


class Model:
    """Hidden Markov model of lines: log probabilities of bins, transitions and first states."""

    def __init__(self, pair_logs: np.ndarray, emission: list[np.ndarray], transition: np.ndarray, first: np.ndarray, common: np.ndarray):
        self.pair_logs, self.emission, self.transition, self.first, self.common = pair_logs, emission, transition, first, common

    def label(self, lines: Lines) -> np.ndarray:
        """The likeliest states of all lines (Viterbi), texts of about the same number of lines together."""
        signs = lines.signs(self.pair_logs)
        scores = sum(self.emission[j][signs[:, j]] for j in range(len(BINS)))
        scores[lines.blank] = 0.0  # says nothing
        offsets = np.r_[0, np.cumsum(lines.per_text)]
        out = np.zeros(lines.n, np.int8)
        order = np.argsort(lines.per_text, kind="stable")
        at = 0
        while at < len(order):
            longest = max(8, int(1.3 * lines.per_text[order[at]]))
            to = at + int(np.searchsorted(lines.per_text[order[at : at + 4096]], longest, "right"))
            part = order[at : max(to, at + 1)]
            at += len(part)
            out_part(scores, offsets[part], lines.per_text[part], self.transition, self.first, out)
        return out


def out_part(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, transition: np.ndarray, first: np.ndarray, out: np.ndarray) -> None:
    """Viterbi over sequences that begin at ``starts``; the states go to ``out``."""
    n, top = len(starts), int(lengths.max())
    best = first + scores[starts]
    back = np.zeros((top, n, len(first)), np.int8)
    final = best.copy()
    for t in range(1, top):
        live = lengths > t
        step = best[:, :, None] + transition[None]
        back[t] = step.argmax(1)
        best = step.max(1) + scores[np.where(live, starts + t, starts)]
        final[live] = best[live]
    state = final.argmax(1)
    for t in range(top - 1, -1, -1):
        live = lengths > t
        out[(starts + t)[live]] = state[live]
        ahead = back[t][np.arange(n), state] if t else state
        state = np.where(live, ahead, state)


def train(texts: list[str], common: list[str], turns: int = 4, counts: np.ndarray | None = None) -> Model:
    """Fits the model: rules label the lines first, then counts and labels follow from one another. ``counts`` are the letter pairs of the corpus, by default of the texts."""
    hashes = np.unique(np.array([word_hash(w) for w in common if w], np.uint64))
    texts = [unmerged(t) for t in texts if t] or ["a"]
    lines = Lines(texts, hashes)
    rows = (lines.pair_counts() if counts is None else counts).reshape(28, 28) + 0.5
    pair_logs = np.log(rows / rows.sum(1, keepdims=True)).ravel()
    signs = lines.signs(pair_logs)
    labels = lines.by_rule(signs)
    offsets = np.r_[0, np.cumsum(lines.per_text)]
    model = None
    for _ in range(turns):
        emission = []
        seen = ~lines.blank
        for j, bins in enumerate(BINS):
            c = np.full((bins, 4), 1.0)
            np.add.at(c, (signs[seen, j], labels[seen]), 1.0)
            emission.append(np.log(c / c.sum(0)))
        inner = np.ones(lines.n, bool)
        inner[offsets[:-1]] = False
        moves = np.full((4, 4), 1.0)
        here = np.flatnonzero(inner)
        np.add.at(moves, (labels[here - 1], labels[here]), 1.0)
        begin = np.bincount(labels[offsets[:-1]], minlength=4) + 1.0
        model = Model(pair_logs, emission, np.log(moves / moves.sum(1, keepdims=True)), np.log(begin / begin.sum()), hashes)
        labels = model.label(lines)
    return model


def letter_pairs(texts: list[str]) -> np.ndarray:
    """How often each letter follows each other one within the words of some texts."""
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
    safe = np.minimum(points, _TOP - 1)
    is_letter = (_KIND[safe] == LETTER) | (points >= _TOP)
    both = is_letter[:-1] & is_letter[1:]
    letter = _LETTERS[safe]
    return np.bincount(letter[:-1][both].astype(np.int32) * 28 + letter[1:][both], minlength=N_PAIRS)


def pair_counts(documents: DataFrame) -> np.ndarray:
    """How often each letter follows each other one in the texts of all pages, added up in each batch before the counts are shuffled."""

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch | None:
            texts = [t for t in b.column(0).to_pylist() if t]
            if not texts:
                return None
            n = sum(letter_pairs(texts[a:z]) for a, z in chunks(texts))
            at = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["pair", "n"])

        return step

    out = np.zeros(N_PAIRS)
    for r in per_batch(documents.select("text").filter("text is not null"), make, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out


def fit(documents: DataFrame, common_words: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on at most ``sample`` pages, those with the least hashes; hashes beyond twice the share they need are left out in the scan, so little is sorted."""
    share = min(1.0, 2 * sample / max(1, documents.count()))
    h = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 53) - 1))
    drawn = documents.filter("text is not null").select("text", h.alias("h")).filter(F.col("h") <= int(share * (1 << 53)))
    texts = [r["text"] for r in drawn.orderBy("h", "text").limit(sample).collect()]
    words = common_words.filter("word is not null").groupBy("word").agg(F.min("freq_rank").alias("r")).orderBy(F.col("r").asc_nulls_last(), "word").limit(WORDS)
    return train(texts, [r["word"] for r in words.collect()], counts=pair_counts(documents))


_COLUMNS = ("doc_id long", "words long", "mean_word_length double", "symbol_ratio double", "stopped_lines double", "common_words double", "prose double", "list double", "table double", "junk double")


def statistics(documents: DataFrame, common_words: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each page: words, mean word length, share of symbols among characters, of lines ending in punctuation, of common words, and of
    characters in lines of each kind.

    Null and empty texts have 0 words and all shares 0. Blank lines don't count. Lines are taken column by column.
    """
    model = model or fit(documents, common_words)
    parts = (model.pair_logs, model.emission, model.transition, model.first, model.common)

    def make():
        own = Model(*parts)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = ordered_texts(b)
            blocks = [_measured(texts[a:z], own) for a, z in chunks(texts)]
            cols = [np.concatenate([x[i] for x in blocks]) for i in range(len(_COLUMNS) - 1)]
            return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in cols)], [c.split()[0] for c in _COLUMNS])

        return step

    return per_batch(boxed(documents), make, ", ".join(_COLUMNS))


def _measured(texts: list[str], model: Model) -> list[np.ndarray]:
    lines = Lines(texts, model.common)
    labels = model.label(lines)
    first = np.r_[0, np.cumsum(lines.per_text)[:-1]]
    total = lambda x: np.add.reduceat(x, first)
    words = total(lines.words)
    some = np.maximum(1, words)
    solid = np.maximum(1, total(np.where(lines.blank, 0, lines.solid)))
    full = (~lines.blank).astype(np.int64)
    kinds = [total(np.where(lines.blank | (labels != k), 0, 1)) / np.maximum(1, total(full)) for k in range(4)]
    lengths = np.bincount(np.searchsorted(np.cumsum(lines.per_text), lines.word_line, "right"), lines.word_length, len(texts))
    return [words.astype(np.int64), lengths / some, total(lines.others + lines.points) / solid, total(lines.stopped.astype(np.int64)) / np.maximum(1, total(full)), total(lines.common) / some, *kinds]


def kinds(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, kind ('list', 'table', 'junk') of the pages that are mainly not prose: at most half of their lines are, and the commonest other kind counts.

    Of equal shares the first of junk, table, list counts. Pages without text have no kind.
    """
    shares = statistics(documents, common_words)
    best = F.greatest("list", "table", "junk")
    kind = F.when(F.col("junk") == best, "junk").when(F.col("table") == best, "table").otherwise("list")
    return shares.filter((F.col("prose") <= 0.5) & (best > 0)).select("doc_id", kind.alias("kind"))
