"""Marks of transcript lines: printed numbers, question and answer marks, labels, redactions, headings.

All are column expressions. Patterns avoid look-around, so that the same text serves other SQL engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestant.functions.text import WS, ascii_lower, ascii_upper, label_id, left_trimmed, let, trimmed, word_count

#: Greatest printed line number of a transcript profile, and in page features and plain text rows.
MAX_LINE, MAX_LEADING = 100, 50

# What may follow a printed line number.
NUMBERED = r"^([0-9]{1,5})($|[\s\p{Z}:]|[QA][.:])"
NUMBERED_BODY = r"^[0-9]+:*[\s\p{Z}]*"
PAGE_MARK = r"^PAGE [\s\p{Z}]*\+?([0-9]+)$"
# Marks of questions and answers in the order they are tried: kind, style, pattern, priority, expression.
MARKERS = (
    ("question", "dot", "Q.", 1, r"^Q\.($|[\s\p{Z}])"), ("answer", "dot", "A.", 1, r"^A\.($|[\s\p{Z}])"), ("question", "bare_uppercase", "Q", 2, r"^Q($|[\s\p{Z}])"), ("answer", "bare_uppercase", "A", 2, r"^A($|[\s\p{Z}])"),
    ("question", "colon", "Q:", 3, r"^Q:($|[\s\p{Z}])"), ("answer", "colon", "A:", 3, r"^A:($|[\s\p{Z}])"), ("question", "word", "QUESTION:", 4, r"(?i)^QUESTION:"), ("answer", "word", "ANSWER:", 4, r"(?i)^ANSWER:"),
    ("question", "word", "QUESTION.", 4, r"(?i)^QUESTION\."), ("answer", "word", "ANSWER.", 4, r"(?i)^ANSWER\."),
)
MARKER_STRIP = r"^(?:[QA][.:]?|(?i:QUESTION|ANSWER)[:.])[\s\p{Z}]*"
# Words of redaction, of roles and of structure.
REDACTED = r"(?i)\[REDACTED\]|NAME REDACTED|REDACTED NAME|NAME WITHHELD|\[SEALED\]|^REDACTED$|^SEALED$|[█■▇].*[█■▇].*[█■▇]|^[Xx*_]{4,}$"
REDACTION = r"(?i)\[REDACTED\]|\[NAME REDACTED\]|\[REDACTED NAME\]|NAME REDACTED|NAME WITHHELD|DOJ REDACTION|\[SEALED\]|[█■▇].*[█■▇].*[█■▇]"
PURE_REDACTION = r"(?i)^(?:\[REDACTED\]|\[NAME REDACTED\]|\[REDACTED NAME\]|\[NAME WITHHELD\]|\[SEALED\]|REDACTED|SEALED|NAME WITHHELD)$|^[█■▇Xx*_]{3,}$"
WITNESS_WORDS = ("THE WITNESS", "WITNESS", "THE DEPONENT", "DEPONENT")
HONORIFIC = r"^(?:MR\. |MR |MS\. |MS |MRS\. |MRS |MISS |CHAIRMAN |CHAIRWOMAN |CONGRESSMAN |CONGRESSWOMAN |REPRESENTATIVE |SENATOR |GOVERNOR |DR\. |DR )"
ATTORNEY = r"^(?:MR\. |MR |MS\. |MS |MRS\. |MRS |MISS |ATTORNEY |ATTY\. |ATTY |COUNSEL |ESQ\. )|COUNSEL FOR "
JUDGE = r"^(?:THE COURT$|JUDGE |HON\. |HONORABLE )"
STRUCTURAL = r"^(?:Q|A|QUESTION|ANSWER|APPEARANCES|PRESENT|INTERVIEW OF|DEPOSITION OF|CASE NO|CASE NO\.|DATE|TIME|NOTE|NOTES|EXHIBITS|INDEX)$|^(?:FOR |BY |CERTIFICATE|EXAMINATION|IN THE )"
TITLED = r"^((?i:MR\. |MR |MS\. |MS |MRS\. |MRS |MISS |CHAIRMAN |CHAIRWOMAN |CONGRESSMAN |CONGRESSWOMAN |REPRESENTATIVE |SENATOR |GOVERNOR |DR\. |DR |JUDGE |JUSTICE |THE WITNESS )(?:(?:[^.]*[\s\p{Z}])?[^\s\p{Z}.]\.[\s\p{Z}]*)*[^.]*[^\s\p{Z}.][^\s\p{Z}.])\.(.*)$"
TITLED_LABEL = r"^[^\s\p{Z}]+(?:[\s\p{Z}]+(?:\p{Lu}[^\s\p{Z}]*|de|van|von|der|den|la|del))+$"
NAME_CHARS = r"^[\p{L}\p{M}\s\p{Z}.'’\-]+$"
INTRODUCED = r"(?i)^(?:HAVING BEEN|BEING FIRST|CALLED AS A WITNESS)"
OBJECTION = r"(?i)^objection|^object |^i object| object to "
EXAMINATION = ("EXAMINATION", "DIRECT EXAMINATION", "CROSS-EXAMINATION", "CROSS EXAMINATION", "REDIRECT EXAMINATION", "RE-DIRECT EXAMINATION", "RECROSS EXAMINATION", "RE-CROSS EXAMINATION", "FURTHER EXAMINATION")
HEADINGS = ("APPEARANCES", "INDEX", "PROCEEDINGS", "CERTIFICATE", "CERTIFICATION", "ERRATA", "SIGNATURE", "STIPULATIONS", "CONTENTS")
EXHIBIT = r"(?i)exhibit"
EXHIBIT_ACT = r"(?i)marked|received|identified|admitted"


def numbered(c: Column, most: int = MAX_LINE) -> Column:
    """struct(number, body) of a line; without a printed number in 1..most the number is null and the body the line."""
    n = F.regexp_extract(c, NUMBERED, 1).try_cast("int")
    fits = c.rlike(NUMBERED) & (n >= 1) & (n <= most)
    return F.struct(F.when(fits, n).alias("number"), F.when(fits, F.regexp_replace(c, NUMBERED_BODY, "")).otherwise(c).alias("body"))


def leading_number(c: Column) -> Column:
    """A first word that is a number in 1..50, else null."""
    n = F.regexp_extract(c, r"^[\s\p{Z}]*([0-9]{1,5})($|[\s\p{Z}])", 1).try_cast("int")
    return F.when((n >= 1) & (n <= MAX_LEADING), n)


def without_leading_digits(c: Column) -> Column:
    """A trimmed line without digits before it that say 1..50, even where a letter follows them."""
    n = F.regexp_extract(c, r"^[\s\p{Z}]*([0-9]{1,5})", 1).try_cast("int")
    bare = F.when((n >= 1) & (n <= MAX_LEADING), F.regexp_replace(c, r"^[\s\p{Z}]*[0-9]+[\s\p{Z}]*", "")).otherwise(c)
    return F.when(c.rlike(r"^[\s\p{Z}]*[0-9]"), bare).otherwise(c)


def page_mark(c: Column) -> Column:
    """the number of a PAGE line, else null."""
    return F.when(ascii_upper(trimmed(c)).rlike(PAGE_MARK), F.regexp_extract(ascii_upper(trimmed(c)), PAGE_MARK, 1)).try_cast("int")


def pure_number(c: Column) -> Column:
    """a line of at most seven digits and nothing else."""
    return F.when(trimmed(c).rlike(r"^[0-9]{1,7}$"), trimmed(c)).try_cast("int")


def marker(c: Column) -> Column:
    """struct(kind, style, pattern, priority, rest) of the question or answer mark a line begins with, else null."""
    return let(left_trimmed(c), _marker)


def _marker(text: Column) -> Column:
    which = None
    for i, (_, _, _, _, expression) in enumerate(MARKERS):
        which = F.when(text.rlike(expression), i) if which is None else which.when(text.rlike(expression), i)
    table = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("style"), F.lit(p).alias("pattern"), F.lit(n).alias("priority")) for k, s, p, n, _ in MARKERS])
    found = lambda i: F.when(i.isNotNull(), let(F.element_at(table, i + 1), lambda m: F.struct(m["kind"].alias("kind"), m["style"].alias("style"), m["pattern"].alias("pattern"), m["priority"].alias("priority"), F.regexp_replace(text, MARKER_STRIP, "").alias("rest"))))
    return F.when(text.rlike(r"^(?:[QA]|(?i:QUESTION|ANSWER)[:.])"), let(which, found))


def is_redacted(c: Column) -> Column:
    """whether a label is redacted."""
    return F.coalesce(trimmed(c).rlike(REDACTED), F.lit(False))


def has_redaction(c: Column) -> Column:
    return F.coalesce(c.rlike(REDACTION), F.lit(False))


def is_redaction(c: Column) -> Column:
    """whether a line is nothing but a redaction mark."""
    return F.coalesce(trimmed(F.regexp_replace(trimmed(c), r"^:+|:+$", "")).rlike(PURE_REDACTION), F.lit(False))


def label_role(c: Column) -> Column:
    """the role a label speaks of: 'unknown' for honorifics and redactions, null where it speaks of none."""
    return let(trimmed(c), _label_role)


def _label_role(c: Column) -> Column:
    return F.when(c.rlike(REDACTED), "unknown").otherwise(let(ascii_upper(c), _role_word))


def _role_word(u: Column) -> Column:
    return (
        F.when(F.lit(False), "unknown").when(u.isin(*WITNESS_WORDS), "witness").when(u.contains("INTERPRETER"), "interpreter")
        .when(u.isin("THE REPORTER", "REPORTER") | u.contains("COURT REPORTER") | u.contains("STENOGRAPHER"), "court_reporter").when(u.contains("VIDEOGRAPHER") | (u == "VIDEO OPERATOR"), "videographer")
        .when(u.rlike(JUDGE), "judge").when(u.rlike(HONORIFIC), "unknown").when(u.rlike(ATTORNEY), "attorney")
    )


def colon_label(c: Column) -> Column:
    """struct(label, rest) of a line with a speaker's label before its first colon, else null."""
    return let(trimmed(c), lambda text: F.when(text.contains(":"), let(trimmed(F.regexp_extract(text, r"(?s)^([^:]*):", 1)), lambda label: F.when(_is_label(label), F.struct(label.alias("label"), trimmed(F.regexp_replace(text, r"(?s)^[^:]*:", "")).alias("rest"))))))


def _is_label(label: Column) -> Column:
    generic = label.rlike(NAME_CHARS) & label.rlike(r"\p{L}") & ~label.rlike(r"\p{Ll}|[ªº]") & word_count(label).between(1, 6)
    return (label != "") & (F.octet_length(label) <= 80) & ~ascii_upper(label).rlike(STRUCTURAL) & (generic | label_role(label).isNotNull())


def titled_label(c: Column) -> Column:
    """struct(label, rest) of a line that begins with a title, a name and a full stop, else null."""
    fits = lambda label: (F.octet_length(label) <= 80) & label.rlike(NAME_CHARS) & label.rlike(TITLED_LABEL) & word_count(label).between(2, 6)
    made = lambda text: let(trimmed(F.regexp_extract(text, "(?s)" + TITLED, 1)), lambda label: F.when(fits(label), F.struct(label.alias("label"), trimmed(F.regexp_extract(text, "(?s)" + TITLED, 2)).alias("rest"))))
    return let(trimmed(c), lambda text: F.when(text.rlike("(?s)" + TITLED), made(text)))


def speaker_label(c: Column) -> Column:
    """A colon label, else a titled one."""
    return let(c, lambda x: F.coalesce(colon_label(x), titled_label(x)))


def introduced(c: Column) -> Column:
    """the name of a witness a line introduces, else null."""
    sworn = lambda t: t.contains(",") & trimmed(F.regexp_replace(t, r"(?s)^[^,]*,", "")).rlike(INTRODUCED)
    name = lambda t: trimmed(F.when(t.rlike("(?i)^(?:WITNESS|DEPONENT): "), F.regexp_replace(t, r"(?s)^[^:]*:", "")).when(sworn(t), F.regexp_extract(t, r"(?s)^([^,]*),", 1)))
    return let(let(trimmed(c), name), lambda n: F.when(n.rlike(NAME_CHARS) & word_count(n).between(2, 6), n))


def by_label(c: Column) -> Column:
    """F16: the label of a BY heading, else null: redacted, known, or in capitals."""
    label = lambda t: F.when(t.rlike("(?i)^BY .*:$"), trimmed(F.regexp_replace(F.regexp_replace(t, r"(?i)^BY ", ""), r":+$", "")))
    return let(let(trimmed(c), label), lambda n: F.when((n != "") & let(F.regexp_replace(n, r"[^\p{L}]", ""), lambda letters: _heads(n, letters)), n))


def _heads(label: Column, letters: Column) -> Column:
    ratio = F.char_length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) / F.greatest(F.lit(1), F.char_length(letters))
    generic = word_count(label).between(1, 7) & (F.char_length(letters) >= 2) & (ratio >= 0.8) & ~label.isin("Q", "A", "QUESTION", "ANSWER")
    bare = word_count(label).between(1, 5) & label.rlike("[A-Za-z]") & label.rlike(r"^[A-Z0-9\s\p{Z}.'\-]+$")
    return generic | bare | label_role(label).isNotNull()


def is_objection(c: Column) -> Column:
    """F17."""
    return F.coalesce(trimmed(c).rlike(OBJECTION), F.lit(False))


def opens_parenthetical(c: Column) -> Column:
    """F18."""
    t = trimmed(c)
    return F.coalesce(t.startswith("(") | (t.startswith("[") & ~is_redaction(t)) | t.startswith("---"), F.lit(False))


def closes_parenthetical(c: Column) -> Column:
    t = trimmed(c)
    return F.coalesce(t.startswith("---") | t.endswith(")") | t.endswith("]"), F.lit(False))


def is_exhibit(c: Column) -> Column:
    return F.coalesce(c.rlike(EXHIBIT) & c.rlike(EXHIBIT_ACT), F.lit(False))


def is_examination(c: Column) -> Column:
    """F19."""
    return F.coalesce(ascii_upper(trimmed(c)).isin(*EXAMINATION), F.lit(False))


def is_heading(c: Column) -> Column:
    return F.coalesce(ascii_upper(trimmed(c)).isin(*HEADINGS), F.lit(False))


def is_anchor(c: Column) -> Column:
    """Whether testimony may begin at a line: a label, a mark or a BY heading."""
    return F.coalesce(let(c, lambda x: x.rlike(r"(?i)^[\s\p{Z}]*BY ") | marker(x).isNotNull() | speaker_label(x).isNotNull()), F.lit(False))


def bare_name(c: Column, *dropped: str) -> Column:
    """A label's words without punctuation and honorifics, in capitals."""
    words = F.split(trimmed(F.regexp_replace(c, r"[^\p{L}\p{N}\s\p{Z}]", " ")), rf"{WS}+")
    return ascii_upper(F.array_join(F.filter(words, lambda w: ~ascii_upper(w).isin(*dropped)), " "))


def labels_match(a: Column, b: Column) -> Column:
    """whether two labels are probably one person's: equal without titles, or one within the other."""
    x, y = (bare_name(c, "MR", "MS", "MRS", "MISS", "DR", "HON", "THE", "WITNESS") for c in (a, b))
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def speaker_of_label(c: Column) -> Column:
    """a speaker struct for a label that no participant bears; redacted ones have no id."""
    hidden = is_redacted(c)
    return F.struct(F.when(~hidden, label_id(c)).alias("participant_id"), trimmed(c).alias("label"), F.coalesce(label_role(c), F.lit("unknown")).alias("speaker_role"), hidden.alias("redacted"))


def opening_word(c: Column) -> Column:
    return F.regexp_extract(ascii_lower(c), r"^(\S+)", 1)
