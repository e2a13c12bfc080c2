"""Text decoded with the wrong character encoding: found and restored span by span.

For every character of a repertoire and every wrong decoding (UTF-8 bytes read in a one-byte encoding, once or twice over; bytes of one
one-byte encoding read in another) the garbled sequence is worked out beforehand. One Aho-Corasick automaton matches all sequences. A
sequence of one character may be right text, so it counts only where such a character can't rightly stand, or in words that no Latin
language has. Only matched spans are replaced, so correct text beside them stays as it is.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestant.llm.common import per_batch

# One-byte encodings that UTF-8 bytes are commonly read in.
READ_AS = ("latin-1", "cp1252", "cp1250", "iso8859-2", "cp1251", "cp437", "cp850", "cp852", "mac_roman", "iso8859-15", "cp1254", "koi8-r", "cp866")
LOST = "�"


def repertoire() -> str:
    """The characters text may hold: letters of European, Cyrillic, Greek, Hebrew, Arabic and Devanagari script, punctuation and signs."""
    blocks = ((0xA0, 0x180), (0x391, 0x3CA), (0x400, 0x460), (0x5D0, 0x5EB), (0x60C, 0x670), (0x900, 0x970), (0x2010, 0x2027), (0x2030, 0x203B))
    return "".join(chr(c) for a, z in blocks for c in range(a, z)) + "€™−≈≤≥←→•ﬁﬂ№"


@cache
def _bytes(encoding: str) -> dict[int, str]:
    """The 256 characters of an encoding; bytes it leaves out stand for the control character of their number."""
    table = {}
    for b in range(256):
        try:
            table[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            table[b] = chr(b)
    return table


def misread(text: str, encoding: str) -> str:
    """UTF-8 text as it looks when read in a one-byte encoding."""
    table = _bytes(encoding)
    return "".join(table[b] for b in text.encode())


def _weak(garbled: str, encoding: str) -> bool:
    """Whether a sequence may also be right text: only letters and dashes, of one case pattern that words have."""
    if encoding in ("cp1251", "koi8-r", "cp866"):
        return all("Ѐ" <= c <= "ӿ" for c in garbled) or not any(c.isalpha() and c > "Ѐ" for c in garbled)
    if garbled[0] in "ÃÂĂ":  # capitals that hardly ever stand before a letter with a mark
        return False
    return garbled[0] in "–—“”‘’" or all(c.isalpha() for c in garbled) and (len(garbled) == 2 and garbled[1].islower() and garbled[1] not in "ƒš")


@cache
def sequences() -> dict[str, dict[str, tuple[str, bool]]]:
    """Garbled sequence -> by wrong encoding (two for text decoded wrongly twice) the character, and whether it counts only beside another one."""
    out: dict[str, dict[str, tuple[str, bool]]] = {}
    for c in repertoire():
        for e in READ_AS:
            once = misread(c, e)
            ways = [(e, once)]
            if e in ("latin-1", "cp1252", "cp1250"):
                ways += [(f"{e} {e}", misread(once, e)), (f"{e} cp1252", misread(once, "cp1252"))]
            for way, g in ways:
                if len(g) > 1 and g != c:
                    out.setdefault(g, {}).setdefault(way, (c, _weak(g, e)))
        lost = c.encode()  # bytes of which one was lost on the way
        for e in ("latin-1", "cp1252"):
            if len(lost) == 2 and 0x80 <= lost[1] < 0xC0:
                out.setdefault(_bytes(e)[lost[0]] + LOST, {}).setdefault(e, (LOST, False))
    return out


# One-byte encodings of Latin script that are read in one another, commonest first, and encodings of other scripts with the
# commonest letters of the languages written in them.
LATIN = ("cp1252", "cp850", "mac_roman", "cp437", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp852")
SCRIPTS = {"cp1251": "оеаинтсрвл", "koi8-r": "оеаинтсрвл", "iso8859-5": "оеаинтсрвл", "cp866": "оеаинтсрвл", "cp1256": "اليمنرتبوه", "cp1253": "αοιετσνηυρ", "cp1255": "יוהלאתמרבש"}
# Small letters with marks of the languages written in Latin script, the commonest first.
MARKED = "éäüèàáíóöñúçêßâôûîëïãõåøæœąęłśżčšžřěůőűýğış"


@cache
def singles() -> dict[str, dict[tuple[str, str], str]]:
    """Garbled character -> by (right encoding, wrong encoding) the character whose byte was read wrongly."""
    pairs = [(x, y) for x in LATIN for y in LATIN if x != y] + [(x, y) for x in SCRIPTS for y in ("cp1252", "latin-1")] + [("cp1251", "koi8-r"), ("koi8-r", "cp1251")]
    out: dict[str, dict[tuple[str, str], str]] = {}
    for right, wrong in pairs:
        for byte in range(0x80, 0x100):
            was, seen = _bytes(right)[byte], _bytes(wrong)[byte]
            if was != seen:
                out.setdefault(seen, {})[right, wrong] = was
    return out


@cache
def automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for g, ways in singles().items():
        auto.add_word(g, (1, ways))
    for g, ways in sequences().items():
        auto.add_word(g, (len(g), ways))
    auto.make_automaton()
    return auto


def _hits(text: str) -> tuple[list[tuple[int, int, str, bool]], dict[int, dict[tuple[str, str], str]]]:
    """Longest sequences from the left, and single characters by position.

    Where a sequence may come from several encodings, that counts which explains most of the text's.
    """
    found, alone = [], {}
    for end, (n, ways) in automaton().iter_long(text):
        if n == 1:
            alone[end] = ways
        else:
            found.append((end + 1 - n, end + 1, ways))
    votes = Counter(w for _, _, ways in found for w in ways)
    rank = lambda w: (votes[w[0]], -READ_AS.index(w[0].split(" ")[0]))
    return [(a, b, max(ways.items(), key=rank)[1][0], all(weak for _, weak in ways.values())) for a, b, ways in found], alone


_LONE = re.compile(r"[\x80-\x9f]")
# A lone lead byte whose continuation was a space or a control character that has been dropped.
_HALF = re.compile(r"[ÃÂĂ](?=[\s.,;:?!]|$)|(?<=[a-zà-ÿ])[ÃÂĂ√├┬](?=[a-z ]|$)|â(?=[A-Z€™œ])")
# Signs that may follow a word rightly, and break signs and ligatures of scans.
_AFTER_WORD = "’‘”“»«›‹…–—®™©ªº°²³¹´§†‡•·‰€¢£¥\xa0\xad¬"
_BREAKS = "\xad¬ﬀﬁﬂﬃﬄ"


def _strange(text: str, k: int) -> bool:
    """Whether a character can't rightly stand where it does: a sign or foreign letter between small letters or, of a few, at a word's end; a capital after small letters; control characters anywhere."""
    c = text[k]
    before, after = text[k - 1 : k] if k else "", text[k + 1 : k + 2]
    if "\x80" <= c <= "\x9f":
        return True
    if c in _BREAKS or not ("a" <= before <= "z"):
        return False
    if "a" <= after <= "z":
        return c not in "’‘\xa0·…–—" and (not c.isalpha() or c.isupper() or c > "ʯ" or c in "ªµº")
    if after.isalpha() or after.isdigit() or not text[max(0, k - 2) : k].islower() or k < 2:
        return False
    return c.isupper() and c.isalpha() or not c.isalpha() and not c.isdigit() and c not in _AFTER_WORD and not c.isspace()


def _latin(text: str, alone: dict[int, dict[tuple[str, str], str]]) -> list[tuple[int, int, str]]:
    """Spans of single characters that can't rightly stand where they do, with what they were by the pair of encodings that makes most of them common letters."""
    at = [k for k in alone if _strange(text, k)]
    votes: Counter = Counter()
    for k in at:
        for pair, was in alone[k].items():
            if was in MARKED and pair[0] in LATIN:
                votes[pair] += 2 - MARKED.index(was) / len(MARKED)
    best = max(votes, key=lambda p: (votes[p], -LATIN.index(p[0]), -LATIN.index(p[1])), default=None)
    return [(k, k + 1, was if (was := alone[k].get(best, LOST)) in MARKED else LOST) for k in at]


def _runs(text: str, alone: dict[int, dict[tuple[str, str], str]], fits) -> list[tuple[int, int]]:
    """Stretches of single characters that ``fits``, without a letter of the alphabet beside them."""
    out: list[list[int]] = []
    for k in sorted(alone):
        if fits(text[k]):
            if out and out[-1][1] == k:
                out[-1][1] = k + 1
            else:
                out.append([k, k + 1])
    plain = lambda c: c.isascii() and c.isalpha()
    return [(a, z) for a, z in out if not (a and plain(text[a - 1])) and not (z < len(text) and plain(text[z]))]


def _likely(words: list[str], common: str) -> float:
    """Share of common letters among the letters of words of a script; 0 if they are not written like words."""
    t = " ".join(words)
    letters = [c for c in t if c.isalpha()]
    if len(letters) < 0.8 * len(t.replace(" ", "")) or any(a.islower() and z.isupper() for a, z in zip(t, t[1:], strict=False)):
        return 0.0
    return sum(c.lower() in common for c in letters) / max(1, len(letters))


# Cyrillic letters of one encoding read in another: capitals and small letters are turned round.
_TURNED = re.compile(r"(?<![\w])[а-я][А-Я]{2,}(?![\w])|(?<![\w])[А-Я]?[а-я]+[А-Я]{2,}[а-яА-Я]*(?![\w])")


def _other_script(text: str, alone: dict[int, dict[tuple[str, str], str]]) -> list[tuple[int, int, str]]:
    """Spans of one-byte text of another script: stretches of single characters, by the pair of encodings whose letters are the likeliest.

    Three letters with marks in a row, which no Latin word has, or turned Cyrillic ones give rise to it; the words between belong to them.
    """
    marked = _runs(text, alone, lambda c: "¡" <= c <= "ÿ" and c not in "×÷")
    turned = _TURNED.search(text) is not None
    if any(z - a >= 3 for a, z in marked):
        spans_, wrongs, least = marked, ("cp1252", "latin-1"), 0.25
    elif turned:
        spans_, wrongs, least = _runs(text, alone, lambda c: "А" <= c <= "я" or c in "Ёё"), ("koi8-r", "cp1251"), 0.0
    else:
        return []
    best, most, restored = None, least, []
    for right, common in SCRIPTS.items():
        for wrong in wrongs:
            words = ["".join(alone[k].get((right, wrong), "\x00") for k in range(a, z)) for a, z in spans_]
            if (share := _likely(words, common)) > most:
                best, most, restored = right, share, words
    if best:
        return [(a, z, w.replace("\x00", LOST)) for (a, z), w in zip(spans_, restored, strict=True)]
    return [(*m.span(), LOST) for m in _TURNED.finditer(text)] if turned and wrongs[0] == "koi8-r" else []


def spans(text: str) -> list[tuple[int, int, str]]:
    """Damaged spans (start, end, original), in order; the original is U+FFFD where it can't be restored."""
    hits, alone = _hits(text)
    sure = sum(not weak for *_, weak in hits)
    out = []
    for i, (a, b, c, weak) in enumerate(hits):
        beside = i and hits[i - 1][1] == a or i + 1 < len(hits) and hits[i + 1][0] == b
        if not weak or beside or sure >= 2:
            out.append((a, b, c))
    taken = {k for a, b, _ in out for k in range(a, b)}
    # the characters of sequences that don't count are looked at one by one
    for a, b, *_ in hits:
        if a not in taken:
            alone |= {k: singles()[text[k]] for k in range(a, b) if text[k] in singles()}
    if not out and (other := _other_script(text, alone)):
        return other
    out += [x for x in _latin(text, alone) if x[0] not in taken]
    taken |= {a for a, _, _ in out}
    for pattern in (_LONE, _HALF):
        for m in pattern.finditer(text):
            if m.start() not in taken:
                out.append((m.start(), m.end(), LOST))
                taken.add(m.start())
    for k, c in enumerate(text):
        if c == LOST and k not in taken:
            out.append((k, k + 1, LOST))
    return sorted(out)


def restore(text: str) -> str:
    """The text with every damaged span replaced by what it was, where that is known; lost characters stay U+FFFD."""
    out, at = [], 0
    for a, b, c in spans(text):
        if a >= at:
            out += [text[at:a], c]
            at = b
    return "".join([*out, text[at:]])


def repair(rows: DataFrame) -> DataFrame:
    """Rows (rec_table, doc_id, rec_id, text) whose text is damaged: with restored_text and the count of spans that stay lost.

    Null, empty and plain ASCII texts can't be damaged and are skipped before Python sees them. Equal rows give equal rows.
    """

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            keep, fixed, lost = [], [], []
            for k, t in enumerate(b.column(3).to_pylist()):
                if t and (found := spans(t)):
                    keep.append(k)
                    fixed.append(restore(t))
                    lost.append(sum(c == LOST for _, _, c in found))
            take = pa.array(keep, pa.int64())
            return pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(4)), pa.array(fixed, pa.string()), pa.array(lost, pa.int32())], ["rec_table", "doc_id", "rec_id", "text", "restored_text", "lost"])

        return step

    damaged = rows.select("rec_table", "doc_id", "rec_id", "text").filter(F.col("text").rlike(r"[^\x00-\x7F]"))
    return per_batch(damaged, make, "rec_table string, doc_id string, rec_id string, text string, restored_text string, lost int")


def whole(raw: str = "raw_text", text: str = "text"):
    """raw_text, and text too where raw_text doesn't hold it."""
    r, t = F.coalesce(F.col(raw), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return F.when(r.endswith(t), r).otherwise(F.concat(r, F.lit("\n"), t))


def damaged_records(rows: DataFrame, fragments: DataFrame) -> DataFrame:
    """Damaged records of canonical_rows and fragments, as ``repair`` gives them."""
    a = rows.select(F.lit("canonical_rows").alias("rec_table"), "doc_id", F.col("id").alias("rec_id"), whole().alias("text"))
    b = fragments.select(F.lit("fragments").alias("rec_table"), "doc_id", F.col("fragment_id").alias("rec_id"), "text")
    return repair(a.unionByName(b))
