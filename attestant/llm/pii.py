"""Personal information in free text: found by anchor expansion, replaced by typed placeholders.

An Aho-Corasick automaton runs once over the joined texts of an Arrow batch and finds anchors with their places: at-signs, spoken "dot",
digits, number words, titles, label marks and given names. From each anchor a deterministic parser of its kind expands the span to both
sides, within the words the kind can reach, and checks its boundaries, and of account numbers the check digits. What no anchor lies in is
never parsed.
"""

from __future__ import annotations

import bisect
import re
import unicodedata

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestant.llm.common import per_batch

KINDS = ("email", "phone", "id_number", "address", "name")

# Words that mark identifiers which are no personal ones.
OTHER_NUMBERS = "invoice serial docket part exhibit bates page route case lot model order item ticket volume".split()
# Number words a telephone number is spoken in.
DIGIT_WORDS = "zero oh one two three four five six seven eight nine cero uno dos tres cuatro cinco seis siete ocho nueve zéro un deux trois quatre cinq sept huit neuf null eins zwei drei vier fünf sechs sieben acht neun".split()
# Last words of a street's name, and words that stand before one.
STREET_END = "street st road rd avenue ave boulevard blvd lane ln drive dr court ct terrace row way place pl square sq highway hwy parkway pkwy circle crescent close".split()
STREET_START = "calle avenida avda plaza paseo camino carrera rue avenue boulevard quai chemin place allée impasse via viale piazza corso rua travessa largo улица ул переулок проспект شارع".split()
STREET_TAIL = "straße strasse gasse weg platz allee straat laan gracht plein kade".split()
# Labels that name a role.
ROLES = "q a question answer witness thewitness court thecourt reporter thereporter courtreporter thecourtreporter videographer thevideographer interpreter theinterpreter interviewer interviewee deponent thedeponent examiner judge thejudge clerk theclerk bailiff thebailiff counsel unknown speaker unidentified unidentifiedspeaker operator theoperator".split()
# Last words of an organisation's name, among them abbreviations.
ORG_END = "company co corp corporation inc incorporated ltd limited llc llp plc partners ptnrs gmbh ag sa group holdings bank clinic association trust".split()
HONORIFICS = "mr mrs ms miss dr prof sir judge hon messrs herr frau m mme mlle sr sra señor señora".split()

UP = "A-ZÀ-ÖØ-ÞŁŚŠŽĆČĐ"
WORD = rf"[{UP}][^\W\d_]*(?:['’\-][^\W\d_]+)*"
EMAIL = re.compile(r"[\w.+\-]+ ?@ ?[\w\-]+(?:(?:\.[\w\-])*(?: ?\. ?[\w\-]{2,}))+|[\w.+\-]+ at [\w\-]+(?: (?:dot|punto|point|punkt) [\w\-]+)+|[\w.+\-]+ ?[(\[](?:at|AT)[)\]] ?[\w\-]+(?:\.[\w\-]{2,})+")
_D = "(?:" + "|".join(DIGIT_WORDS) + ")"
SPOKEN = re.compile(rf"(?i)\b{_D}(?:[ ,\-]+{_D}){{5,}}\b")
PHONE = re.compile(
    r"(?<![\w\-./@])(?:\(\d{3}\) ?\d{3}[-. ]\d{4}|(?:\+?1[-. ])?\d{3}[-.]\d{3}[-.]\d{4}|\+1 ?\d{3} \d{3} \d{4}|1 \d{3} \d{3} \d{4}|\d{3} \d{7}|\d{3} \d{3} \d{4}|\d{3}[-.]\d{4}|(?:\+|00)\d{1,3}(?:[-. ]?\d{1,5}){3,7})(?:,? ?(?:ext|x)\.? ?\d{1,5})?(?![\w\-@]|\.\d)"
)
ID = re.compile(
    r"(?<![\w\-./@+])(?:\d{3}[- ]\d{2}[- ]\d{4}|(?:DL )?\d[A-Z]-\d{7}|X\d{7}|\d{8}[A-Z]|[XYZ]\d{7}[A-Z]|[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|[12]\d{12,14}|\d{9}|[CFGHJKLMNPRTVWXYZ][0-9CFGHJKLMNPRTVWXYZ]{8}|\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2}|\d{3}\.\d{3}\.\d{3}-\d{2}|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z])(?![\w\-@])"
)
NEAR_OTHER = re.compile(r"(?i)\b(?:" + "|".join(OTHER_NUMBERS) + r")(?: (?:number|no\.?|is|was))*[ #:]*$")
ADDRESS = re.compile(
    rf"(?<![\w\-])\d{{1,5}}[A-Za-z]? (?:[NSEW]\.? )?(?:{WORD}\.? ){{1,4}}(?i:{'|'.join(STREET_END)})\b"
    rf"|\b(?i:{'|'.join(STREET_START)})\b\.? (?:(?:de|del|des|du|da|do|della|dei|la|las|los|le|les|el|l’|d’|san|santa|{WORD}) ?){{1,6}},? (?i:n[úuº°]?m?e?r?o?\.? ?)?\d{{1,5}}\b"
    rf"|\b\d{{1,5}}(?: ?(?:bis|ter))?,? (?i:{'|'.join(STREET_START)})\b (?:(?:de|du|des|la|le|les|l’|d’|aux?) ?)*{WORD}"
    rf"|\b(?:Am|Im|An der|An den|An dem|Auf der|Auf dem|In der|Zum|Zur|Hinter der|Unter den) (?:{WORD} ?){{1,3}}\d{{1,4}} ?[a-z]?\b"
    rf"|\b(?:{WORD}[ \-])*{WORD}?(?i:{'|'.join(STREET_TAIL)}) \d{{1,4}}[a-z]?\b"
)
LABEL = re.compile(r"^[\s\[({<]*(?:\d[\d:.,ms]*[\])}>]*\s+(?:-->\s*\S+\s+)?)?(?:(?:BY|By|Q\.|Q:|Q  )\s+)?([^:]{1,60}?)\s*(?::| [-–—])(?=\s|$)")
# Titles that a name follows in running text.
TITLES = "mr mrs ms miss dr prof messrs herr frau mme señor señora sr sra".split()
TITLED = re.compile(rf"\b(?:(?i:{'|'.join(TITLES)})\b\.?) (?:[{UP}]\.? ?){{0,2}}({WORD})")
_TOKEN = re.compile(r"[^\W\d_]+")
_READ_AS_DIGIT = str.maketrans("OolISB", "001158")
_NUMERIC = re.compile(r"(?<![A-Za-z])(?=[A-Za-z]{0,2}\d)[\dOolISB]{2,}(?![A-Za-z])|(?<=[\d.\-])[OolISB](?=[\d.\-])")


def plain(word: str) -> str:
    """Lower-case letters without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if c.isalpha())


_SHAPE = str.maketrans("0158vwj", "oisbuul")


def role_form(label: str) -> str:
    """A label's letters, with the digits that scans put in their place read as letters."""
    return re.sub("[^a-z]", "", label.lower().replace("vv", "w").translate(str.maketrans("0158", "olsb")))


def _like_role(form: str) -> bool:
    if form in _ROLE_FORMS:
        return True
    # one misread letter in a longer role word, two in a very long one
    return len(form) >= 6 and any(len(r) == len(form) and sum(a != b for a, b in zip(r, form, strict=True)) <= 1 + (len(r) >= 9) for r in _LONG_ROLES)


_ROLE_FORMS = frozenset(role_form(r) for r in ROLES)
_LONG_ROLES = tuple(r for r in _ROLE_FORMS if len(r) >= 6)


def is_person_label(label: str) -> bool:
    """Whether a speaker label names a person, not a role or an organisation."""
    low = label.strip().lower()
    if not any(c.isalpha() for c in low) or "redacted" in low or "█" in low:
        return False
    words = _TOKEN.findall(low)
    if not words or len(words) > 6 or words[0] in ("counsel", "attorney", "for", "the", "exhibit", "page", "volume", "matter", "in", "re"):
        return False
    if any(w in ORG_END for w in words[1:]) or _like_role(role_form(label)):
        return False
    if words[0] in HONORIFICS:
        return len(words) > 1
    return any(len(w) > 2 for w in words)


# Kinds of anchors, as bits, and the words a span of a kind may reach to the left and right of its anchor.
AT, SAID, DIGIT, TITLE, GIVEN, LABELLED = 1, 2, 4, 8, 16, 32
REACH = {AT: (6, 6), SAID: (8, 8), DIGIT: (12, 9), TITLE: (1, 5), GIVEN: (3, 4)}
Anchor = tuple[int, int, int]


def luhn(digits: str) -> bool:
    """Whether a card number's check digit is right."""
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an international account number's check digits are right."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


# Account numbers, which only their check digits tell from other long numbers.
CARD = re.compile(r"(?<![\w\-./@+])\d(?:[ \-]?\d){12,18}(?![\w\-@])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")


def _is_account(m: re.Match) -> bool:
    text = re.sub(r"[ \-]", "", m.group())
    return luhn(text) and len(set(text)) > 1 if m.re is CARD else mod97(text)


def windows(text: str, anchors: list[Anchor], kind: int) -> list[tuple[int, int, list[int]]]:
    """Stretches of text that spans of a kind can lie in: around each of its anchors as many words as the kind reaches; overlapping ones are one."""
    left, right = REACH[kind]
    out: list[tuple[int, int, list[int]]] = []
    for a, b, bits in anchors:
        if not bits & kind:
            continue
        if out and b <= out[-1][1] and a - out[-1][2][-1] <= 2:
            out[-1][2].append(a)  # within a run of anchors only its ends are expanded
            lo = out[-1][0]
        else:
            lo = a
            for _ in range(left):
                lo = text.rfind(" ", 0, max(0, lo))
                if lo < 0:
                    break
            lo += 1
        hi = b
        for _ in range(right):
            hi = text.find(" ", hi + 1)
            if hi < 0:
                hi = len(text)
                break
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]), out[-1][2] if out[-1][2][-1] == a else [*out[-1][2], a])
        else:
            out.append((lo, hi, [a]))
    return out


def _holds(at: list[int], start: int, end: int) -> bool:
    """Whether an anchor lies in a span."""
    k = bisect.bisect_left(at, start)
    return k < len(at) and at[k] < end or any(start - 12 < x < end for x in at[max(0, k - 2) : k])


def _any_bits(anchors: list[Anchor]) -> int:
    bits = 0
    for *_, b in anchors:
        bits |= b
    return bits


class Finder:
    """Finds the spans of personal information in texts. ``given``: given names in lower case."""

    def __init__(self, given: list[str]):
        self.given = frozenset(given)
        words: dict[str, int] = {}
        add = lambda word, kind: words.update({word: words.get(word, 0) | kind})
        for g in self.given:
            add(g, GIVEN)
        for h in TITLES:
            for end in (" ", ". "):
                add(h + end, TITLE)
        for w in ("@", " dot ", " punto ", " point ", " punkt ", "(at)", "[at]"):
            add(w, AT)
        for w in DIGIT_WORDS:  # a number is spoken in six or more, so one of them has another after it
            for end in " ,-":
                add(w + end, SAID)
        for d in "0123456789":
            add(d, DIGIT)
        for m in (":", " - ", " – ", " — "):
            add(m, LABELLED)
        self.auto = ahocorasick.Automaton()
        for w, bits in words.items():
            self.auto.add_word(w, (len(w), bits))
        self.auto.make_automaton()

    def anchors(self, texts: list[str]) -> dict[int, list[Anchor]]:
        """The anchors (start, end, kinds) of each text that has any, in order."""
        starts, at = [], 0
        for t in texts:
            starts.append(at)
            at += len(t) + 1
        found: dict[int, list[Anchor]] = {}
        where, k, first, last = bisect.bisect_right, -1, 0, -1
        # small letters of the same length keep the places
        for end, (n, bits) in self.auto.iter("\n".join(texts).lower() if all(len(t) == len(t.lower()) for t in texts) else "\n".join(t if len(t) != len(t.lower()) else t.lower() for t in texts)):
            if end >= last:
                k = where(starts, end) - 1
                first, last = starts[k], starts[k + 1] if k + 1 < len(starts) else at
            found.setdefault(k, []).append((end + 1 - n - first, end + 1 - first, bits))
        for own in found.values():
            own.sort()
        return found

    def spans(self, text: str, anchors: list[Anchor], kinds: int = 63) -> list[tuple[int, int, str]]:
        """Spans (start, end, kind), in order, of one text whose anchors are known."""
        out: list[tuple[int, int, str]] = []
        work = text
        bits = kinds & _any_bits(anchors)

        def take(a: int, b: int, kind: str) -> None:
            nonlocal work
            out.append((a, b, kind))
            work = work[:a] + "\x00" * (b - a) + work[b:]

        for pattern, bit, kind in ((EMAIL, AT, "email"), (SPOKEN, SAID, "phone")):
            if bits & bit:
                for lo, hi, at in windows(text, anchors, bit):
                    for m in pattern.finditer(work, lo, hi):
                        if _holds(at, m.start(), m.end()):
                            take(*m.span(), kind)
        if bits & DIGIT:
            for lo, hi, at in windows(text, anchors, DIGIT):
                numbers = _NUMERIC.sub(lambda m: m.group().translate(_READ_AS_DIGIT), work[lo:hi])
                for pattern, kind in ((ADDRESS, "address"), (IBAN, "id_number"), (CARD, "id_number"), (ID, "id_number"), (PHONE, "phone")):
                    for m in pattern.finditer(numbers):
                        a, b = m.span()
                        if not _holds(at, lo + a, lo + b) or pattern in (CARD, IBAN) and not _is_account(m):
                            continue
                        if kind == "address" or not NEAR_OTHER.search(numbers[:a]):
                            take(lo + a, lo + b, kind)
                            numbers = numbers[:a] + "\x00" * (b - a) + numbers[b:]
        label_end = 0
        if bits & LABELLED and (m := LABEL.match(work)) and is_person_label(m.group(1)) and self._label_like(m.group(1), text[m.end(1) : m.end(1) + 200].strip()):
            take(*m.span(1), "name")
            label_end = m.end()
        if bits & TITLE:
            for lo, hi, _ in windows(text, anchors, TITLE):
                for m in TITLED.finditer(work, lo, hi):
                    if m.start() >= label_end and m.group(1).lower() not in ORG_END:
                        take(*m.span(), "name")
        if bits & GIVEN:
            for lo, hi, _ in windows(text, anchors, GIVEN):
                out += [(lo + a, lo + b, "name") for a, b in self._named(work[lo:hi])]
        return sorted(set(out))

    def _label_like(self, label: str, rest: str) -> bool:
        """Whether what stands before a colon or dash is written like a label; before a dash, which headings and asides have as well, only names of few words are."""
        words = _TOKEN.findall(label)
        small = sum(w[0].islower() for w in words)
        if rest[:1] == ":":
            return small <= len(words) // 3
        says = rest[1:].split()
        return rest[:1] != "—" and small == 0 and len(words) <= 4 and label.strip()[-1:] != "," and (len(says) > 1 or says != [] and says[0][-1] in ".?!,")

    def _named(self, text: str) -> list[tuple[int, int]]:
        """Given names that a capitalised surname follows, with initials between or not."""
        found = []
        for m in _NAME_LIKE.finditer(text):
            words = [w for w in _TOKEN.findall(m.group()) if len(w) > 1]
            for i, w in enumerate(words):
                if w.lower() in self.given and (i + 1 < len(words) or i and words[i - 1].lower() not in _NO_SURNAME):
                    nxt = words[i + 1].lower() if i + 1 < len(words) else words[i - 1].lower()
                    if nxt not in _NO_SURNAME and not any(x.lower() in ORG_END or x.lower() in STREET_END for x in words[i + 1 :]):
                        found.append(m.span())
                        break
        return found


_NAME_LIKE = re.compile(rf"(?<![\w@.])(?:{WORD}(?: (?:[{UP}]\. ?)*|\.? ?, ?(?=[{UP}])|  ?)){{1,3}}{WORD}")
_NO_SURNAME = frozenset("the i a you he she we they it is was were did do does has had have what when where who why how that this and or may june march tuesday route exhibit page".split())

# How a further datum is joined to a name.
_EXTRA = re.compile(r"(?i)\s*(?:<.*?>|\(.*?\)|,? tel\.? .*$| of \d.*$|,? esq\.?)")


def name_in_field(text: str, given: frozenset[str] = frozenset()) -> bool:
    """Whether a name field holds a person's name: what is left without contact data is no organisation, role or redaction."""
    rest = _EXTRA.sub("", text).strip(" ,")
    low = rest.lower()
    words = _TOKEN.findall(low)
    if not words or "redacted" in low or "█" in low or "&" in low:
        return False
    if re.search(r"\((?:%s)\.?\)" % "|".join(ORG_END), text.lower()) or any(w in ORG_END for w in words[1:]):
        return False
    if any(w in _TRADES for w in words):
        return False
    if words[0] == "the" or words[0] == "counsel" or _like_role(role_form(rest)):
        return False
    return any(len(w) > 1 and w not in HONORIFICS for w in words)


# Words of trade in names of organisations.
_TRADES = frozenset("freight storage quarry brokers mills works supply insurance marine grain paper pump pumpworks gaslight tool die gas light cold frt stg ins sup stor services shipping logistics".split())


def given_names(participants: DataFrame, share: float = 0.0005, least: int = 3) -> list[str]:
    """Given names that at least this share of the named participants bear: at most 2 / share of them, whatever the table's size.

    A word is a given name if it stands twice as often in a given name's place (first, or after a comma) as in a surname's.
    """
    name = F.regexp_replace("canonical_name", r"(?i)\s*(<.*|\(.*|,? tel\.? .*| of \d.*|,? esq\.?.*)$", "")
    name = F.trim(F.regexp_replace(name, r"(?i)^(mr|mrs|ms|dr|miss|prof)\.? ", ""))
    named = participants.filter("canonical_name is not null").select(F.lower(name).alias("n"))
    org = r"\b(" + "|".join([*ORG_END, *sorted(_TRADES)]) + r")\b|redacted|^the "
    words = F.regexp_extract_all(F.col("n"), F.lit(r"(\p{L}{3,})"), F.lit(1))
    both = named.filter(~F.col("n").rlike(org)).withColumn("w", words).filter(F.size("w") >= 2)
    comma = F.col("n").contains(",")
    first, last = F.element_at("w", 1), F.element_at("w", -1)
    seen = both.select(F.when(comma, last).otherwise(first).alias("given"), F.when(comma, first).otherwise(last).alias("main"))
    places = seen.select(F.explode(F.array(F.struct(F.col("given").alias("g"), F.lit(1).alias("as_given")), F.struct(F.col("main").alias("g"), F.lit(0).alias("as_given")))).alias("p")).select("p.*")
    total = participants.filter("canonical_name is not null").count()
    counts = places.groupBy("g").agg(F.sum("as_given").alias("c"), F.count("*").alias("n")).filter((F.col("c") >= max(least, share * total)) & (F.col("c") > 2 * (F.col("n") - F.col("c"))))
    return sorted(r["g"] for r in counts.collect() if r["g"] not in _NO_SURNAME)


# Short forms of common given names.
NICKNAMES = "bill will rob bob chuck charlie larry steve ray sam barb becky nick matt dan danny ben ken deb debbie fred gabe abby jon johnny josie kit kate kathy liz beth betsy pat patty tori vicky tony jenny jen rick rich dick meg maggie peggy phil greg len lenny ted teddy tom tommy ed eddie walt wally sue susie dolly dot nacho bert inge zoli mike mick jo josé inés chris alex sasha al billy bobby gabby".split()


def _finder(given: list[str]):
    return Finder(sorted(set(given) | set(NICKNAMES)))


def find_in_rows(rows: DataFrame, given: list[str]) -> DataFrame:
    """Rows (doc_id, rec_id, text) with personal information: doc_id, rec_id, spans, redacted text.

    Null and empty texts and texts without any give no row. A row delivered twice gives two equal rows.
    """

    def make():
        finder = _finder(given)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in b.column(2).to_pylist()]
            keep, spans, redacted = [], [], []
            for k, own in finder.anchors(texts).items():
                found = finder.spans(texts[k], own)
                if found:
                    keep.append(k)
                    spans.append([{"first": a, "after": z, "pii_type": kind} for a, z, kind in found])
                    redacted.append(replace(texts[k], found))
            take = pa.array(keep, pa.int64())
            return pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(spans, _SPANS), pa.array(redacted, pa.string())], ["doc_id", "rec_id", "spans", "redacted_text"])

        return step

    return per_batch(rows.select("doc_id", "rec_id", "text").filter("text is not null"), make, "doc_id string, rec_id string, spans array<struct<first:int,after:int,pii_type:string>>, redacted_text string")


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("pii_type", pa.string())]))


def replace(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with [EMAIL], [PHONE], ... in place of each span; of spans that overlap the first counts."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]])


def find_in_names(names: DataFrame) -> DataFrame:
    """Name fields (doc_id, rec_id, text): as find_in_rows; the name itself is what is left of the field."""

    def make():
        finder = Finder([])

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in b.column(2).to_pylist()]
            keep, spans, redacted = [], [], []
            anchors = finder.anchors(texts)
            for k, t in enumerate(texts):
                found = finder.spans(t, anchors.get(k, []), AT | SAID | DIGIT)
                if name_in_field(t):  # the field itself is the cue of a name
                    m = re.match(r".*?(?=\s*(?:<|\(|,? tel\.? | of \d|$))", t)
                    if m and m.group().strip():
                        found = sorted([(0, m.end(), "name"), *[s for s in found if s[0] >= m.end()]])
                if found:
                    keep.append(k)
                    spans.append([{"first": a, "after": z, "pii_type": kind} for a, z, kind in found])
                    redacted.append(replace(t, found))
            take = pa.array(keep, pa.int64())
            return pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(spans, _SPANS), pa.array(redacted, pa.string())], ["doc_id", "rec_id", "spans", "redacted_text"])

        return step

    return per_batch(names.select("doc_id", "rec_id", "text").filter("text is not null"), make, "doc_id string, rec_id string, spans array<struct<first:int,after:int,pii_type:string>>, redacted_text string")


def redact(rows: DataFrame, participants: DataFrame) -> DataFrame:
    """rec_table, doc_id, rec_id, spans, redacted_text of every testimony row and participant with personal information."""
    given = given_names(participants)
    a = find_in_rows(rows.select("doc_id", F.col("id").alias("rec_id"), "text"), given).withColumn("rec_table", F.lit("canonical_rows"))
    b = find_in_names(participants.select("doc_id", F.col("id").alias("rec_id"), F.col("canonical_name").alias("text"))).withColumn("rec_table", F.lit("participants"))
    return a.unionByName(b)
