"""Languages of transcripts, pages and mixed segments by a linear-chain conditional random field over words.

The model is trained here: on a bounded sample of rows of transcripts whose hint names a language, each hint's language with at most
``ROWS_PER_LANGUAGE`` rows. Words are described by affixes, letter n-grams, script and the lexicon of common words; label transitions are
learned from rows that are spliced together. Forward-backward gives each word the probability of each language.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestant.llm.common import TESTIMONY, per_batch
from attestant.llm.encoding import restore

#: Bounds of the training sample: rows and transcripts per language, languages (there are 184 two-letter codes) and common words of each; and the buckets of features.
ROWS_PER_LANGUAGE, TRANSCRIPTS_PER_LANGUAGE, LANGUAGES, WORDS_PER_LANGUAGE, BUCKETS = 1200, 300, 200, 2000, 1 << 16

# Two-letter codes with the other spellings of each language, of ISO 639-2 and in English.
CODES = {
    "en": "eng english", "es": "spa spanish castilian español", "de": "deu ger german deutsch", "fr": "fra fre french français", "pt": "por portuguese português", "it": "ita italian italiano",
    "nl": "nld dut dutch nederlands", "ru": "rus russian русский", "hi": "hin hindi", "ar": "ara arabic", "zh": "zho chi chinese", "ja": "jpn japanese", "ko": "kor korean", "pl": "pol polish",
    "uk": "ukr ukrainian", "cs": "ces cze czech", "sv": "swe swedish", "da": "dan danish", "nb": "nob norwegian", "no": "nor", "fi": "fin finnish", "el": "ell gre greek", "he": "heb hebrew",
    "tr": "tur turkish", "vi": "vie vietnamese", "ro": "ron rum romanian", "hu": "hun hungarian", "ca": "cat catalan", "bn": "ben bengali", "ur": "urd urdu", "fa": "fas per persian",
}
_SPELLINGS = {s: code for code, others in CODES.items() for s in [code, *others.split()]}


def code_of(column):
    """The two-letter code a hint's code means, whatever its spelling; null for none or undetermined, as typed for unknown ones."""
    first = F.regexp_extract(F.lower(F.trim(column)), r"^(\p{L}*)", 1)
    table = F.create_map(*[F.lit(x) for pair in _SPELLINGS.items() for x in pair])
    return F.when(column.isNull() | (F.trim(column) == "") | (first == "und"), None).otherwise(F.coalesce(table[first], first))


WORD = re.compile(r"[^\W\d_]+(?:[’'ऀ-ःऺ-ॏ][^\W\d_ऀ-ःऺ-ॏ]*|[ऀ-ःऺ-ॏ])*")
_MAIL = re.compile(r"\S*@\S*|\S+ at (?:\S+ dot )+\w+")
_MARK = re.compile(r"^\s*(?:[\[({<]?\d[\d:.,ms]*[\])}>]?\s+)?(?:(?:Q|A|QUESTION|ANSWER)\s*[.:]?\s+|[^:]{2,60}?(?:\s?:| [-–—])\s+)?")


def spoken(text: str) -> str:
    """A row's text without time mark and label; damaged characters restored first."""
    if not text.isascii():
        text = restore(text)
    if "@" in text or " dot " in text:
        text = _MAIL.sub(" ", text)
    return text[_MARK.match(text).end() :]


def script(text: str) -> str:
    """The script most letters of a text are in."""
    letters = [c for c in text if c.isalpha()]
    if not letters or text.isascii():
        return "LATIN"
    names = [unicodedata.name(c, "?").split(" ")[0] for c in letters]
    return max(sorted(set(names)), key=names.count)


def features(word: str, lexicon: dict[str, list[str]]) -> list[int]:
    """Buckets of a word's features: itself, affixes, letter n-grams, script, languages that have it among their common words."""
    w = word.lower()
    p = f"^{w}$"
    named = ["w" + w, "s" + (unicodedata.name(w[0], "?").split(" ")[0] if w else "?"), *(f"p{w[:n]}" for n in (1, 2, 3)), *(f"e{w[-n:]}" for n in (1, 2, 3, 4))]
    named += [f"n{p[i : i + n]}" for n in (2, 3, 4) for i in range(len(p) - n + 1)]
    named += [f"l{x}" for x in lexicon.get(w, ())]
    return [zlib.crc32(x.encode()) % BUCKETS for x in named]


@dataclass
class Model:
    """Languages, weights of feature buckets, transition scores."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, list[str]]
    known: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    def ids(self, words: list[str]) -> list[int]:
        """Row numbers of the words in ``scores``, which grows with new words."""
        known, fresh = self.known, []
        out = []
        for w in words:
            k = known.get(w)
            if k is None:
                k = known[w] = len(known)
                fresh.append(w)
            out.append(k)
        if fresh:
            new = np.stack([self.weights[features(w, self.lexicon)].sum(0) for w in fresh])
            if self.scores is None:
                self.scores = new
            else:
                self.scores = np.concatenate([self.scores, new])
        return out

    def forget(self, most: int = 200_000) -> None:
        """Drops the kept scores once there are too many words, so that memory stays bounded."""
        if len(self.known) > most:
            self.known, self.scores = {}, None

    def marginals(self, rows: list[list[str]]) -> np.ndarray:
        """Probabilities (row, position, language) by forward-backward; positions beyond a row's end are 0."""
        length = max(map(len, rows), default=0)
        ids = np.zeros((len(rows), length), np.int64)
        there = np.zeros((len(rows), length), bool)
        for i, r in enumerate(rows):
            ids[i, : len(r)] = self.ids(r)
            there[i, : len(r)] = True
        if not length:
            return np.zeros((len(rows), 0, len(self.languages)))
        e = self.scores[ids]
        return forward_backward(np.exp(e - e.max(-1, keepdims=True)), np.exp(self.transitions), there)[0]


def forward_backward(e: np.ndarray, t: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (n, time, k) and expected transitions (k, k) of padded sequences with emission factors e and transition factors t."""
    n, length, k = e.shape
    a, b = np.zeros_like(e), np.ones_like(e)
    a[:, 0] = e[:, 0] / e[:, 0].sum(-1, keepdims=True)
    for i in range(1, length):
        x = (a[:, i - 1] @ t) * e[:, i]
        a[:, i] = np.where(there[:, i, None], x / np.maximum(x.sum(-1, keepdims=True), 1e-300), a[:, i - 1])
    for i in range(length - 2, -1, -1):
        x = (e[:, i + 1] * b[:, i + 1]) @ t.T
        b[:, i] = np.where(there[:, i + 1, None], x / np.maximum(x.sum(-1, keepdims=True), 1e-300), 1.0)
    m = a * b
    m /= np.maximum(m.sum(-1, keepdims=True), 1e-300)
    moves = np.zeros((k, k))
    for i in range(1, length):
        x = a[:, i - 1, :, None] * t[None] * (e[:, i] * b[:, i])[:, None, :]
        x /= np.maximum(x.sum((1, 2), keepdims=True), 1e-300)
        moves += x[there[:, i]].sum(0)
    return m * there[..., None], moves


def cleaned(sample: list[tuple[str, str]], turns: int = 3) -> list[tuple[str, str]]:
    """The sample with its labels set right: hints are often wrong, but no two languages share their wrong hints' words.

    Words' frequencies under each label (multinomial, smoothed) relabel the rows, and are counted again, a few times over.
    """
    if not sample:
        return []
    languages = sorted({x for _, x in sample})
    at = {x: i for i, x in enumerate(languages)}
    vocab: dict[str, int] = {}
    rows = [[vocab.setdefault(w.lower(), len(vocab)) for w in WORD.findall(spoken(t))] if t else [] for t, _ in sample]
    labels = np.array([at[x] for _, x in sample])
    scripts = np.array([script(spoken(t)) if t else "" for t, _ in sample])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.array([w for r in rows for w in r], np.int64)
    for _ in range(turns):
        counts = np.full((len(vocab), len(languages)), 0.05)
        np.add.at(counts, (flat, labels[owner]), 1.0)
        logs = np.log(counts / counts.sum(0))
        scores = np.stack([np.bincount(owner, logs[flat, j], len(rows)) for j in range(len(languages))], 1)
        likeliest = scores.argmax(1)
        for j in range(len(languages)):  # a language is written in one script
            own = scripts[likeliest == j]
            if len(own):
                kinds, n = np.unique(own, return_counts=True)
                scores[scripts != kinds[n.argmax()], j] = -1e9
        labels = np.where([bool(r) for r in rows], scores.argmax(1), labels)
    return [(t, languages[x]) for (t, _), x in zip(sample, labels, strict=True)]


def train(sample: list[tuple[str, str]], common: list[tuple[str, str]], rounds: int = 40, seed: int = 7) -> Model:
    """Fits the field to (text, language) rows by gradient ascent on the likelihood, with rows of two languages spliced among them."""
    rng = np.random.default_rng(seed)
    languages = sorted({x for _, x in sample})
    at = {x: i for i, x in enumerate(languages)}
    lexicon: dict[str, list[str]] = {}
    for lang, word in common:
        if lang and word:
            lexicon.setdefault(word.lower(), []).append(lang)
    rows = [(WORD.findall(spoken(t)), at[x]) for t, x in sample if t]
    rows = [(w, x) for w, x in rows if w]
    if not rows:
        return Model(languages, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros((len(languages), len(languages))), lexicon)
    order = rng.permutation(len(rows))
    spliced = [(w, [x] * len(w)) for w, x in rows[-1:]] if len(rows) == 1 else []
    for i, j in zip(order[::2], order[1::2], strict=False):
        (a, x), (b, y) = rows[i], rows[j]
        if rng.random() < 0.3:
            spliced.append((a + b, [x] * len(a) + [y] * len(b)))
        else:
            spliced += [(a, [x] * len(a)), (b, [y] * len(b))]
    vocab: dict[str, int] = {}
    parts = []  # padded sequences, those of about the same length together
    spliced.sort(key=lambda s: len(s[0]))
    for first in range(0, len(spliced), 2048):
        some = spliced[first : first + 2048]
        ids, gold, there = (np.zeros((len(some), max(len(w) for w, _ in some)), d) for d in (np.int32, np.int32, bool))
        for i, (w, x) in enumerate(some):
            ids[i, : len(w)] = [vocab.setdefault(v, len(vocab)) for v in w]
            gold[i, : len(w)], there[i, : len(w)] = x, True
        parts.append((ids, gold, there))
    feats = [np.unique(features(w, lexicon)) for w in vocab]
    flat = np.concatenate(feats) if feats else np.zeros(0, np.int64)
    used, flat = np.unique(flat, return_inverse=True)
    starts = np.cumsum([0, *map(len, feats)])[:-1]
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    k = len(languages)
    weights, trans = np.zeros((len(used), k)), np.zeros((k, k))
    count_gold, moves_gold = np.zeros((len(vocab), k)), np.zeros((k, k))
    for ids, gold, there in parts:
        np.add.at(count_gold, (ids[there], gold[there]), 1.0)
        both = there[:, 1:] & there[:, :-1]
        np.add.at(moves_gold, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(trans), np.zeros_like(trans)]
    n_words = max(1, sum(there.sum() for _, _, there in parts))
    order = np.argsort(flat, kind="stable")
    flat_sorted, owner_sorted = flat[order], owner[order]
    bounds = np.flatnonzero(np.r_[True, flat_sorted[1:] != flat_sorted[:-1]]) if len(flat) else np.zeros(0, np.int64)
    for step in range(1, rounds + 1):
        scores = np.add.reduceat(weights[flat], starts, axis=0)
        factors = np.exp(scores - scores.max(-1, keepdims=True))
        count, moves = np.zeros((len(vocab), k)), np.zeros((k, k))
        for ids, _, there in parts:
            m, own = forward_backward(factors[ids], np.exp(trans), there)
            moves += own
            count += np.stack([np.bincount(ids[there], m[there][:, j], len(vocab)) for j in range(k)], 1)
        grad_words = (count_gold - count) / n_words
        grads = [np.add.reduceat(grad_words[owner_sorted], bounds, axis=0) - 1e-7 * weights, (moves_gold - moves) / n_words - 1e-5 * trans]
        for x, g, s, v in ((weights, grads[0], state[0], state[1]), (trans, grads[1], state[2], state[3])):
            s += 0.1 * (g - s)
            v += 0.01 * (g * g - v)
            x += 0.15 * (s / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    full = np.zeros((BUCKETS, k))
    full[used] = weights
    return Model(languages, full.astype(np.float32), trans, lexicon)


def sample_rows(rows: DataFrame, contexts: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` rows (text, language) of each hinted language, and of the ``LANGUAGES`` commonest languages: a sample by hash.

    Transcripts are drawn first, from the small table of contexts; their ids, LANGUAGES * TRANSCRIPTS_PER_LANGUAGE at most, go to every task,
    so the rows are read once and not shuffled. The limit of each language is taken before the shuffle.
    """
    hinted = contexts.select("doc_id", code_of(F.col("language_hint.code")).alias("lang")).filter("lang is not null")
    common = [r["lang"] for r in hinted.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    drawn = hinted.filter(F.col("lang").isin(common)).withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).filter(F.col("n") <= TRANSCRIPTS_PER_LANGUAGE).select("doc_id", "lang")
    usable = rows.filter("disposition = 'dialogue' and event_kind in ('question_marker', 'answer_marker', 'text', 'speaker_anchor') and length(text) between 20 and 400")
    usable = usable.select("doc_id", "text", F.xxhash64("doc_id", "id").alias("h")).join(F.broadcast(drawn), "doc_id")
    ranked = usable.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).filter(F.col("n") <= per_language)
    return [(r["text"], r["lang"]) for r in ranked.select("text", "lang", "h").collect()]


def row_languages(rows: DataFrame, model: Model) -> DataFrame:
    """For each row with words: doc_id, id, physical_page, and the expected letters of each language, in the order of model.languages."""
    weights = (model.languages, model.weights, model.transitions, model.lexicon)

    def make():
        own = Model(*weights)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            own.forget()
            words = [WORD.findall(spoken(t)) if t else [] for t in b.column(4).to_pylist()]
            keep = [i for i, w in enumerate(words) if w]
            out = np.zeros((len(keep), len(own.languages)), np.float32)
            # rows of about the same length together: little padding
            by_length = sorted(range(len(keep)), key=lambda i: len(words[keep[i]]))
            at = 0
            while at < len(by_length):
                part = [by_length[at]]
                at += 1
                while at < len(by_length) and len(part) < 2048 and len(words[keep[by_length[at]]]) <= 1.3 * len(words[keep[part[0]]]) + 2 and len(part) * len(words[keep[by_length[at]]]) < 40_000:
                    part.append(by_length[at])
                    at += 1
                m = own.marginals([words[keep[i]] for i in part])
                letters = np.zeros(m.shape[:2])
                for j, i in enumerate(part):
                    letters[j, : len(words[keep[i]])] = [len(w) for w in words[keep[i]]]
                out[part] = np.einsum("nt,ntk->nk", letters, m)
            take = pa.array(keep, pa.int64())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))
            return pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(4)), flat], ["doc_id", "id", "physical_page", "at", "letters"])

        return step

    # A row delivered twice is counted once: of the rows of a key the one delivered last.
    rows = rows.filter("text is not null and disposition <> 'page_furniture'").select("doc_id", "id", "physical_page", F.coalesce("ingested_at", F.lit(0).cast("timestamp")).alias("at"), "text")
    return per_batch(rows, make, "doc_id string, id string, physical_page int, at timestamp, letters array<float>")


def page_letters(rows: DataFrame, lines: DataFrame, model: Model) -> DataFrame:
    """doc_id, physical_page, lang, letters of testimony; headings, parentheticals, furniture and rows without a line don't count."""
    once = row_languages(rows, model).groupBy("doc_id", "id").agg(F.max_by(F.struct("physical_page", "letters"), "at").alias("r"))
    testimony = lines.filter(F.col("kind").isin(*TESTIMONY, "unknown")).select("doc_id", F.col("source_row_id").alias("id"))
    found = once.join(testimony, ["doc_id", "id"], "left_semi").select("doc_id", F.col("r.physical_page").alias("physical_page"), "r.letters")
    summed = found.groupBy("doc_id", "physical_page").agg(*[F.sum(F.col("letters")[i].cast("double")).alias(f"s{i}") for i in range(len(model.languages))])
    pairs = F.array(*[F.struct(F.lit(x).alias("lang"), F.col(f"s{i}").alias("letters")) for i, x in enumerate(model.languages)])
    return summed.select("doc_id", "physical_page", F.inline(F.filter(pairs, lambda p: p["letters"] > 0.5)))


def fit(rows: DataFrame, contexts: DataFrame, common_words: DataFrame) -> Model:
    """Trains on hinted rows; without any on the common words alone, and without these the only language is 'und'."""
    sample = cleaned(sample_rows(rows, contexts))
    rank = W.partitionBy("lang").orderBy(F.col("freq_rank").asc_nulls_last(), "word")
    ranked = common_words.filter("lang is not null and word is not null").withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= WORDS_PER_LANGUAGE)
    common = [(r["lang"], r["word"]) for r in ranked.orderBy("lang", "n").limit(LANGUAGES * WORDS_PER_LANGUAGE).collect()]
    return train(sample or [(w, x) for x, w in common if x and w] or [("", "und")], common)


def languages(rows: DataFrame, lines: DataFrame, contexts: DataFrame, common_words: DataFrame) -> DataFrame:
    """Per transcript (physical_page 0) and page: doc_id, physical_page, lang_code, confidence (share of the letters), letters.

    Transcripts without testimony have no row; of languages with equal letters the first in the alphabet counts.
    """
    letters = page_letters(rows, lines, fit(rows, contexts, common_words))
    levels = letters.select("doc_id", F.explode(F.array(F.lit(0), F.col("physical_page"))).alias("physical_page"), "lang", "letters")
    summed = levels.groupBy("doc_id", "physical_page", "lang").agg(F.sum("letters").alias("letters"))
    return summed.groupBy("doc_id", "physical_page").agg(F.min_by("lang", F.struct(-F.col("letters"), F.col("lang"))).alias("lang_code"), (F.max("letters") / F.sum("letters")).alias("confidence"), F.sum("letters").alias("letters"))


def corrections(rows: DataFrame, lines: DataFrame, contexts: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, physical_page, lang_code, confidence where the hint is missing or wrong (page 0) or more than half a page is in another language."""
    found = languages(rows, lines, contexts, common_words)
    main = found.filter("physical_page = 0").select("doc_id", F.col("lang_code").alias("main"))
    hints = contexts.groupBy("doc_id").agg(F.first(code_of(F.col("language_hint.code")), ignorenulls=True).alias("hint"))
    both = found.join(main, "doc_id").join(hints, "doc_id", "left")
    # Few letters prove little: the share they need falls from nine tenths to the half that pages of a few lines need.
    needed = 0.5 + 0.4 * F.exp(-F.col("letters") / 40)
    wrong = (F.col("physical_page") == 0) & (F.col("hint").isNull() | (F.col("hint") != F.col("main")))
    other = (F.col("physical_page") > 0) & (F.col("lang_code") != F.col("main")) & (F.col("confidence") > needed)
    return both.filter((F.col("lang_code") != "und") & (wrong | other)).select("doc_id", "physical_page", "lang_code", "confidence")
