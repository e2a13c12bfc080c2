"""Variant spellings of the names of people and organisations, linked within a matter.

Spellings are parsed into given names, initials and a main name. The main names of a matter are compared where their MinHash signatures
over padded q-grams collide in a band; the number of bands follows from the collision curve and the recall wanted. One edit or exchange in
a short name leaves fewer q-grams than that, so names also collide where they are alike but for a letter or have the same letters. Colliding spellings
that Monge-Elkan similarity finds the same form the edges of a graph that star clustering covers: the commonest spelling of a neighbourhood is the centre.
Within a star, the different ways to write the whole name are verified by Monge-Elkan similarity and clustered in stars again.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestant.llm.common import per_batch
from attestant.llm.pii import NICKNAMES, ORG_END, given_names, role_form, _like_role, _TRADES
from attestant.sources.tables import cut_lineage

#: Hashes in a band, similarity from which pairs must be found, and the share of them that must be.
ROWS, SIMILARITY, RECALL = 3, 0.5, 0.98
#: Monge-Elkan similarity from which two ways to write given names are one person's.
SAME_GIVEN = 0.82

# Short forms and other forms of given names, each with the full name.
_SHORTS = {
    full: shorts
    for full, shorts in {
        "william": "bill will billy liam", "robert": "rob bob bobby bert", "charles": "chuck charlie", "lawrence": "larry lars", "stephen": "steve steven stefan", "raymond": "ray", "samuel": "sam sammy", "barbara": "barb babs barbie",
        "rebecca": "becky becca", "nicholas": "nick nicky klaus", "matthew": "matt", "daniel": "dan danny", "benjamin": "ben benny benji", "kenneth": "ken kenny", "deborah": "deb debbie", "frederick": "fred freddy freddie", "gabriel": "gabe",
        "abigail": "abby gail", "jonathan": "jon johnny nathan", "josephine": "josie jo", "katherine": "kit kate kathy katie kat catherine", "elizabeth": "liz beth betsy betty lizzie eliza", "patricia": "pat patty trish tricia", "victoria": "tori vicky vicki",
        "anthony": "tony", "jennifer": "jen jenny", "richard": "rich dick rick ricky", "margaret": "meg maggie peggy marge", "philip": "phil pip", "gregory": "greg", "leonard": "len lenny leo", "theodore": "ted teddy theo", "thomas": "tom tommy",
        "edward": "ed eddie ted ned", "walter": "walt wally", "susan": "sue susie suzy", "dorothy": "dot dolly dottie", "ignacio": "nacho", "michael": "mike mick mickey", "christopher": "chris kit topher", "alexander": "alex sandy sasha al xander", "temperance": "tempe",
        "roswitha": "rosi", "yevgenia": "zhenya", "ludmila": "mila lyuda", "isolde": "izzy", "bertrand": "bert", "evander": "van", "bronwen": "bron", "marisol": "mari",
    }.items()
}
#: Short form -> the full names it may stand for.
SHORT = {short: frozenset(full for full, shorts in _SHORTS.items() if short in shorts.split()) for shorts in _SHORTS.values() for short in shorts.split()}


def full_forms(word: str) -> frozenset[str]:
    return SHORT.get(word) or frozenset((word,))


# Abbreviations in names of organisations.
ABBREVIATED = {"frt": "freight", "stg": "storage", "stor": "storage", "ins": "insurance", "sup": "supply", "pumpworks": "pump works", "gaslight": "gas light", "ptnrs": "partners", "mfg": "manufacturing", "intl": "international", "svc": "services", "bros": "brothers"}
TITLES = {"mr": "mr", "mrs": "ms", "ms": "ms", "miss": "ms", "dr": "dr", "prof": "prof", "hon": "hon", "judge": "hon"}

_EXTRA = re.compile(r"(?i)\s*(?:<[^>]*>?|\([^)]*\d[^)]*\)?|,? tel\.? .*$| of \d.*$)")
_MAILBOX = re.compile(r"<\s*([^@\s>]+)\s*(?:@| at )")
_ESQ = re.compile(r"(?i),?\s*\b(?:esq|jr|sr|md|phd)\b\.?")
_FOLD = str.maketrans({"ø": "o", "æ": "ae", "ð": "d", "þ": "th", "ß": "ss", "ł": "l", "đ": "d", "œ": "oe"})
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_VOID = re.compile(r"redact|\bname\b|█|■")


def fold(text: str) -> str:
    """Lower case without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().translate(_FOLD)) if not unicodedata.combining(c))


def bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands needed so that a pair of this similarity collides in one with this probability: 1 - (1 - s^r)^b >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def grams(word: str, q: int = 2) -> set[str]:
    """q-grams of a word padded at both ends."""
    p = "^" * (q - 1) + word + "$" * (q - 1)
    return {p[i : i + q] for i in range(len(p) - q + 1)}


@lru_cache(maxsize=1)
def _mixers(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 61, (2, n), dtype=np.uint64) | np.uint64(1)


def signature(word: str, n_bands: int, rows: int = ROWS) -> list[int]:
    """A band hash for each band of the word's MinHash signature."""
    mix = _mixers(n_bands * rows)
    x = np.array([zlib.crc32(g.encode()) for g in grams(word)], np.uint64)[:, None]
    mins = ((x * mix[0] + mix[1]) >> np.uint64(17)).min(0).reshape(n_bands, rows)
    return [int(v) for v in (mins * np.array([1, 1_000_003, 998_244_353], np.uint64)[:rows]).sum(1).astype(np.int64)]


def edit_keys(word: str) -> list[int]:
    """Hashes of which two words share one if they lie one edit, or one exchange of letters, apart: the word, the word without each of its letters, its sorted letters."""
    keys = {word, *(word[:i] + word[i + 1 :] for i in range(len(word))), " " + "".join(sorted(word))}
    return sorted(zlib.crc32(k.encode()) << 31 | zlib.crc32(k[::-1].encode()) >> 1 for k in keys)


@lru_cache(maxsize=100_000)
def closeness(a: str, b: str) -> float:
    """1 - edits / length, neighbours exchanged being one edit."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    rows = [list(range(m + 1))]
    for i in range(1, n + 1):
        row = [i]
        for j in range(1, m + 1):
            cost = min(rows[i - 1][j] + 1, row[j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, rows[i - 2][j - 2] + 1)
            row.append(cost)
        rows.append(row)
    return 1 - rows[n][m] / max(n, m, 1)


def word_similarity(a: str, b: str) -> float:
    """Similarity of two given names or initials: a short form is its full name, an initial any name it begins."""
    if len(a) == 1 or len(b) == 1:
        return 1.0 if a[0] == b[0] or any(x[0] == y[0] for x in full_forms(a) for y in full_forms(b)) else 0.0
    return max(closeness(a, b), 1.0 if full_forms(a) & full_forms(b) else 0.0)


def monge_elkan(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Mean over the words of the shorter list of the best similarity in the other; 0 for an empty one."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    return sum(max(word_similarity(x, y) for y in b) for x in a) / len(a)


class Parser:
    """Parses spellings; ``given`` are the given names known."""

    def __init__(self, given: list[str]):
        self.given = frozenset(fold(g) for g in given) | frozenset(NICKNAMES) | frozenset(SHORT) | frozenset(_SHORTS)
        self._near: dict[str, float] = {}

    def given_like(self, word: str) -> float:
        """How near a word is to a known given name."""
        if word in self.given:
            return 1.0
        if word not in self._near:
            if len(self._near) > 200_000:
                self._near.clear()
            self._near[word] = max((closeness(word, g) for g in self.given if abs(len(g) - len(word)) < 3 and (g[0] == word[0] or g[-1] == word[-1])), default=0.0)
        return self._near[word]

    def parse(self, spelling: str) -> tuple[str, str, tuple[str, ...], str, str] | None:
        """(kind 'person' or 'org', main name, given names and initials, title, trade), or null if the spelling names nobody."""
        if not spelling or _VOID.search(spelling.lower()):
            return None
        text = _ESQ.sub("", _EXTRA.sub("", spelling)).strip(" ,.")
        counsel = re.match(r"(?i)counsel for\s+(?:the\s+)?", text)
        text = text[counsel.end() :] if counsel else text
        low = fold(text).replace("&", " and ")
        words = [w for w in _WORDS.findall(low) if w not in ("and", "the")]
        words = [y for w in words for y in ABBREVIATED.get(w, w).split()]
        trade = sorted({w for w in words if w in _TRADES} | {w for w in words if len(w) > 4 and w not in _TRADES and self._trade_like(w)})
        if counsel or trade or any(w in ORG_END for w in words[1:]):
            core = [w for w in words if w not in _TRADES and w not in ORG_END and not self._trade_like(w)]
            main = max(core, key=len, default="")
            return ("org", main, (), "", " ".join(sorted({_TRADE_FORM.get(t, t) for t in trade}))) if main else None
        if _like_role(role_form(text)) or text.lower().startswith("the "):
            return None
        title = ""
        if words and words[0] in TITLES:
            title, words = TITLES[words[0]], words[1:]
        # letters with a point are initials
        named = [w for w in words if len(w) > 1]
        initials = [w for w in words if len(w) == 1]
        if not named:
            return None
        if len(named) == 1:
            return ("person", named[0], tuple(initials[:1]) or self._of_mail(spelling, named[0]), title, "")
        if "," in text:
            head = [w for w in _WORDS.findall(fold(text.split(",")[0])) if len(w) > 1 and w not in TITLES]
            main = head[-1] if head else named[0]
            rest = [w for w in named if w != main]
        else:
            likes = [self.given_like(w) for w in named]
            if likes[0] >= likes[-1] or likes[0] > 0.75:
                main, rest = named[-1], named[:-1]
            else:
                main, rest = named[0], named[1:]
        return ("person", main, tuple(rest[:1]) or tuple(initials[:1]), title, "")

    def _of_mail(self, spelling: str, main: str) -> tuple[str, ...]:
        """The given name or initial that an address beside a bare surname tells: given.main, main_g, gmain or given and a number."""
        m = _MAILBOX.search(spelling.lower())
        if not m:
            return ()
        box = m[1].split("+")[0]
        dotted, under, numbered = re.fullmatch(r"([a-z]+)\.([a-z]+)", box), re.fullmatch(r"([a-z]+)_([a-z])", box), re.fullmatch(r"([a-z]+)\d+", box)
        if dotted and closeness(dotted[2], main) > 0.6:
            return (dotted[1],)
        if under and closeness(under[1], main) > 0.6:
            return (under[2],)
        if numbered and numbered[1] in self.given:
            return (numbered[1],)
        return (box[0],) if box.isalpha() and closeness(box[1:], main) > 0.6 else ()

    @lru_cache(maxsize=50_000)  # noqa: B019
    def _trade_like(self, word: str) -> bool:
        return word in _TRADES or len(word) > 4 and any(abs(len(t) - len(word)) < 2 and closeness(word, t) >= 0.8 for t in _TRADES if len(t) > 4)


_TRADE_FORM = {"works": "works", "stor": "storage"}
_PARSED = "participant_key long, matter_id string, kind string, mains array<string>, given array<string>, titles array<string>, trade string"


def parsed(participants: DataFrame, given: list[str]) -> DataFrame:
    """One row for each participant_key that names somebody: its main names, commonest first, given names and initials, titles, trade.

    Rows repeated exactly count once. Null names and labels are skipped; redacted and role-only participants have no row.
    """

    def make():
        parser = Parser(given)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for key, matter, canonical, display, observed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                votes: dict[tuple[str, str], float] = {}
                givens: dict[str, float] = {}
                titles, trades = set(), {}
                for spelling, weight in [(canonical, 1.5), (display, 1.0), *[(o, 1.0) for o in set(observed or ())]]:
                    p = parser.parse(spelling) if spelling else None
                    if p:
                        votes[p[:2]] = votes.get(p[:2], 0) + weight
                        for g in p[2]:
                            givens[g] = givens.get(g, 0) + weight * (1 if len(g) > 1 else 0.01)
                        if p[3] and spelling != canonical:
                            titles.add(p[3])
                        if p[4]:
                            trades[p[4]] = trades.get(p[4], 0) + weight
                if votes:
                    kinds = {k: sum(v for (x, _), v in votes.items() if x == k) for k in ("person", "org")}
                    kind = "org" if kinds["org"] > 0 and trades or kinds["org"] >= kinds["person"] else "person"
                    mains = [m for (k, m), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])) if k == kind]
                    order = sorted(givens, key=lambda g: (-givens[g], g)) if kind == "person" else []
                    out.append((key, matter, kind, mains, order, sorted(titles), max(trades, key=lambda t: (trades[t], t)) if trades and kind == "org" else ""))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            types = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in _PARSED.split(", ")])

        return step

    once = participants.filter("participant_key is not null and matter_id is not null").groupBy("participant_key", "matter_id").agg(F.first("canonical_name", ignorenulls=True).alias("canonical_name"), F.first("display_label", ignorenulls=True).alias("display_label"), F.first("observed_labels", ignorenulls=True).alias("observed_labels"))
    return per_batch(once, make, _PARSED)


def same_spelling(a: str, b: str) -> bool:
    """Whether two spellings are one main name: Monge-Elkan similarity of their words, one edit or exchange apart at most. Short names must be equal but for one edit."""
    x, y = tuple(a.split()), tuple(b.split())
    longest, shortest = max(len(a), len(b)), min(len(a), len(b))
    if shortest < 4 or sorted(a) == sorted(b) and shortest < 5:
        return False
    return min(monge_elkan(x, y), monge_elkan(y, x)) > 1 - 1.5 / longest


def spelling_pairs(spellings: DataFrame) -> DataFrame:
    """Pairs (matter_id, kind, a, b), both ways, of spellings whose bands or edit keys collide and whose Monge-Elkan similarity says that they are one name."""
    n = bands()
    spark = spellings.sparkSession
    # a written table of spellings is one small file: its signatures are worked out by all tasks, each spelling always by the same one
    spread = spellings.select("matter_id", "kind", "main").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "matter_id", "main")

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            signs = pa.array([signature(w, n) + edit_keys(w) for w in b.column(2).to_pylist()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([*b.columns[:3], signs], ["matter_id", "kind", "main", "bands"])

        return step

    signed = per_batch(spread, make, "matter_id string, kind string, main string, bands array<long>")
    keyed = signed.select("matter_id", "kind", "main", F.posexplode("bands").alias("band", "hash")).withColumn("band", F.least("band", F.lit(n)))
    left, right = keyed.withColumnRenamed("main", "a"), keyed.withColumnRenamed("main", "b")
    # one edit or exchange makes two Levenshtein edits at most, and a main name is one word: what lies further apart can't be the same
    near = (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein(F.col("a"), F.col("b"), 2) >= 0)
    # a spelling has some fifty keys, which size estimates don't know: merged, not broadcast
    met = left.join(right.hint("merge"), ["matter_id", "kind", "band", "hash"]).filter(F.col("a") < F.col("b")).filter(near).select("matter_id", "kind", "a", "b").distinct()

    def check():
        def step(b: pa.RecordBatch) -> pa.RecordBatch | None:
            keep = pa.array([same_spelling(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
            return b.filter(keep)

        return step

    pairs = cut_lineage(per_batch(met, check, "matter_id string, kind string, a string, b string"))
    return pairs.unionByName(pairs.select("matter_id", "kind", F.col("b").alias("a"), F.col("a").alias("b")))


def stars(spellings: DataFrame, edges: DataFrame) -> DataFrame:
    """Star cover: (matter_id, kind, main, centre). A spelling heavier than all its free neighbours becomes a centre and takes them; then again for the rest.

    spellings has ``weight``; ties go to the first in the alphabet. Every round takes at least the heaviest free spelling, so it ends.
    """
    keys = ["matter_id", "kind"]
    rank = lambda w, m: F.struct(F.col(w).alias("w"), F.col(m).alias("m"))
    free = spellings.select(*keys, "main", "weight")
    edges = cut_lineage(edges.join(free.withColumnRenamed("main", "a").withColumnRenamed("weight", "wa").hint("merge"), [*keys, "a"]).join(free.withColumnRenamed("main", "b").withColumnRenamed("weight", "wb").hint("merge"), [*keys, "b"]))
    # spellings without a neighbour are centres of their own
    lone = free.join(edges.select(*keys, F.col("a").alias("main")).distinct().hint("merge"), [*keys, "main"], "left_anti").select(*keys, "main", F.col("main").alias("centre"))
    done = [lone]
    while True:
        best = edges.groupBy(*keys, "a", "wa").agg(F.max(rank("wb", "b")).alias("top"))
        centres = best.filter(rank("wa", "a") > F.col("top")).select(*keys, F.col("a").alias("centre"))
        taken = edges.join(centres.withColumnRenamed("centre", "b").hint("merge"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("main")).agg(F.max(rank("wb", "b")).alias("c")).select(*keys, "main", F.col("c.m").alias("centre"))
        covered = cut_lineage(taken.unionByName(centres.select(*keys, F.col("centre").alias("main"), "centre")))
        gone = covered.select(*keys, "main")
        # edges of spellings still free, and whether the neighbour is
        rest = cut_lineage(edges.join(gone.withColumnRenamed("main", "a").hint("merge"), [*keys, "a"], "left_anti").join(gone.select(*keys, F.col("main").alias("b"), F.lit(True).alias("gone")).hint("merge"), [*keys, "b"], "left"))
        inner = rest.filter("gone is null").drop("gone")
        # who lost all neighbours is a centre of its own
        done += [covered, rest.groupBy(*keys, F.col("a").alias("main")).agg(F.count_if(F.col("gone").isNull()).alias("n")).filter("n = 0").select(*keys, "main", F.col("main").alias("centre"))]
        if inner.isEmpty():
            break
        if len(done) > 8:  # the plan stays small, however many rounds there are
            done = [cut_lineage(reduce(DataFrame.unionByName, done))]
        edges = inner
    return reduce(DataFrame.unionByName, done)


def split_star(ways: list[dict]) -> list[int]:
    """Splits the ways to write names of one main name into persons or organisations: the number of each way's star.

    A way has ``way`` (a text that identifies it), given (list), titles (list), trade, weight. Ways with a given name are compared by
    Monge-Elkan similarity, heaviest first; ways with only an initial join the star it fits, ways with neither the only star, else the one that
    shares their title and is largest. The ways of a main name are few, however many participants write it so.
    """
    order = sorted(range(len(ways)), key=lambda i: (-ways[i]["weight"], ways[i]["way"]))
    full = [tuple(g for g in w["given"] or () if len(g) > 1) for w in ways]
    first = [next((g[0] for g in w["given"] or ()), "") for w in ways]
    centres: list[int] = []
    titles: list[set] = []
    weights: list[float] = []
    star: dict[int, int] = {}

    def put(i: int, c: int) -> None:
        if c == len(centres):
            centres.append(i)
            titles.append(set())
            weights.append(0.0)
        star[i] = c
        titles[c] |= set(ways[i]["titles"] or ())
        weights[c] += ways[i]["weight"]

    for i in order:
        trade = ways[i]["trade"]
        if trade:
            scores, least = [closeness(trade, ways[c]["trade"]) if ways[c]["trade"] else 0.0 for c in centres], 0.85
        elif full[i]:
            scores, least = [monge_elkan(full[i][:1], full[c]) for c in centres], SAME_GIVEN if len(full[i][0]) > 5 else 0.75
        else:
            continue
        best = max(range(len(centres)), key=lambda c: (scores[c], weights[c]), default=None)
        put(i, best if best is not None and scores[best] >= least else len(centres))
    named = len(centres)
    for with_initial in (True, False):
        for i in order:
            if i not in star and bool(first[i]) == with_initial:
                fits = [c for c, k in enumerate(centres) if not first[i] or (first[k] or first[i]) == first[i] or any(x[0] == first[i] for x in full_forms(full[k][0] if full[k] else " "))]
                own = set(ways[i]["titles"] or ())
                put(i, max(fits, key=lambda c: (bool(own & titles[c]), c < named, weights[c], -c), default=len(centres)))
    return [star[i] for i in range(len(ways))]


def _split():
    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for matter, kind, centre, ways in zip(*(c.to_pylist() for c in b.columns), strict=True):
            out += [(matter, kind, centre, w["way"], k) for w, k in zip(ways, split_star(ways), strict=True)]
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["matter_id", "kind", "centre", "way", "star"])

    return step


def linked(participants: DataFrame) -> DataFrame:
    """participant_key, matter_id, kind, entity: the entity each named participant is, unique within its matter."""
    rec = cut_lineage(parsed(participants, given_names(participants)))
    spellings = cut_lineage(rec.select("matter_id", "kind", F.explode("mains").alias("main")).groupBy("matter_id", "kind", "main").agg(F.count("*").alias("weight")))
    star = cut_lineage(stars(spellings, spelling_pairs(spellings)))
    star = star.join(spellings.hint("merge"), ["matter_id", "kind", "main"])
    heavy = star.groupBy("matter_id", "kind", "centre").agg(F.sum("weight").alias("size"))
    of_key = (
        rec.select("participant_key", "matter_id", "kind", F.posexplode("mains").alias("pos", "main"))
        .join(star.join(heavy.hint("merge"), ["matter_id", "kind", "centre"]).select("matter_id", "kind", "main", "centre", "size").hint("merge"), ["matter_id", "kind", "main"])
        .groupBy("participant_key", "matter_id", "kind")
        .agg(F.max_by("centre", F.struct("size", -F.col("pos"))).alias("centre"))
    )
    written = cut_lineage(rec.select("participant_key", "given", "titles", "trade").join(of_key.hint("merge"), "participant_key"))
    way = F.to_json(F.struct("given", "titles", "trade"))
    ways = written.groupBy("matter_id", "kind", "centre", way.alias("way")).agg(F.count("*").cast("double").alias("weight"), F.first("given").alias("given"), F.first("titles").alias("titles"), F.first("trade").alias("trade"))
    groups = ways.groupBy("matter_id", "kind", "centre").agg(F.collect_list(F.struct("way", "given", "titles", "trade", "weight")).alias("ways"))
    split = per_batch(groups, _split, "matter_id string, kind string, centre string, way string, star int")
    keyed = written.withColumn("way", way).join(split.hint("merge"), ["matter_id", "kind", "centre", "way"])
    return keyed.select("participant_key", "matter_id", "kind", F.concat_ws(":", "kind", "centre", "star").alias("entity"))


def pairs(participants: DataFrame) -> DataFrame:
    """key_a < key_b of one matter that are one entity. Fewer than two named participants: no rows."""
    one = cut_lineage(linked(participants).select("matter_id", "entity", "participant_key"))
    a, b = one.withColumnRenamed("participant_key", "key_a"), one.withColumnRenamed("participant_key", "key_b")
    return a.join(b.hint("merge"), ["matter_id", "entity"]).filter("key_a < key_b").select("key_a", "key_b")
