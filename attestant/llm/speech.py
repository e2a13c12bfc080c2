"""Speech transcripts made into clean, ordered speaker turns.

The segments of a page are put in order by precedence constraints: dialogue order (row numbers), timing (time marks) and cues (a segment that
goes on with the sentence before it, a mark before the speech it stands for). Constraints are taken by weight, one that closes a cycle is
dropped, and the rest is sorted topologically: a time outweighs a row number, a cue with the row number outweighs a time. Then spans of time
marks, fillers and sounds are taken out, labels become persons, and rows of one person are merged. Pages are small; a transcript of any
length is chained page by page.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestant.llm.common import TESTIMONY
from attestant.sources.tables import cut_lineage

# Interjections that are no words, and words that are fillers only when set off by a comma or dash.
INTERJECTIONS = "uh uhm um erm umm hmm hm mm mmm mhm mm-hmm uh-huh äh ähm öh öhm euh heu ehm uhh"
SET_OFF = "um er ah eh este ben hein bah o sea ben nou ehm dunque allora cioè tipo né ну э эээ как бы मतलब अच्छा यानी يعني طيب"
PHRASES = ("you know", "i mean", "sort of", "kind of", "o sea", "как бы", "was weiß ich", "ik bedoel", "quer dizer", "tu sais", "vous savez")
# Beginnings of parentheticals that are no sounds but events of the proceeding.
PROCEEDINGS = "discussion recess exhibit document the whereupon off reporter redacted name witness at time deposition counsel record proceedings lunch break pause-in"

TIME = re.compile(
    r"^\s*(?:[A-Z][^:\[({<]{1,40}(?::| -)\s+)?(?P<m>\[\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d+)?\]|\(\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d+)?\)|\{\d{1,3}[.:]\d\d(?:[.:]\d\d)?\}|<\d+(?:\.\d+)?>|<\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d+)?>"
    r"|\d{1,2}:\d\d:\d\d(?:[.,]\d+)?(?:\s*-->\s*\d{1,2}:\d\d:\d\d(?:[.,]\d+)?)?|(?:\d{1,2}h)?\d{1,3}m\d\ds)(?=\s|$)\s*"
)
SOUND = re.compile(r"\(\([^()]*\)\)|\([^\W\d_][^()]*\)|\[[^\W\d_][^\[\]]*\]|\{[^\W\d_][^{}]*\}|<[^\W\d_][^<>]*>|\*[^\W\d_][^*]*\*|♪[^♪]*♪?")
_INNER = re.compile(r"^\W*(\w+)")
_ALTERNATIVES = "|".join(re.escape(x) for x in sorted(set(INTERJECTIONS.split()), key=len, reverse=True))
_PAUSED = "|".join(re.escape(x) for x in sorted({*SET_OFF.split(), *PHRASES} - {"o", "sea", "как", "бы"}, key=len, reverse=True))
FILLER = re.compile(rf"(?i)(?<![\w'’\-])(?:(?<!as )(?<!as  )(?:{_PAUSED})\s?(?:,|--|—|\.\.\.|…)(?:\s?(?:{_ALTERNATIVES})\b,?)?|(?:{_ALTERNATIVES})(?![\w'’\-])\s?(?:,|--|—|\.\.\.|…)|(?:uh|uhm|mm-hmm|hmm|mmm|ähm|äh|euh)(?![\w'’\-])(?!\s*[.?!]?\s*$))\s*")
LABEL = re.compile(r"^\s*([^:]{1,60}?)\s*(?::| [-–—])(?=\s|$)\s*")

#: Weights of precedence constraints; a cue adds to the dialogue order it agrees with.
DIALOGUE, TIMING, CUE = 1.0, 2.0, 1.5
#: Seconds that time marks of unlike forms may differ by where they mean the same moment.
UNIT = 1.0
HOUR = 3600


def seconds(mark: str) -> float | None:
    """A time mark as seconds; of a range its start. Null if it can't be read."""
    m = re.match(r"^\D*(?:(\d+)h)?(\d+)m(\d+)s", mark)
    if m:
        return int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3])
    first = mark.split("-->")[0]
    parts = [float(x) for x in re.findall(r"\d+(?:\.\d+)?", first.replace(",", "."))] if ":" in first else []
    if not parts:
        n = re.findall(r"\d+(?:\.\d+)?", first)
        if not n:
            return None
        if first.strip().startswith("{"):
            a, _, b = n[0].partition(".")
            return int(a) * 60 + int(b or 0)
        return float(n[0])
    total = 0.0
    for x in parts:
        total = total * 60 + x
    return total


def aligned(times: list[float | None], hourless: list[bool]) -> list[float | None]:
    """Times with the hour that marks without one leave out: that which brings them nearest to the median of the others."""
    whole = sorted(t for t, h in zip(times, hourless, strict=True) if t is not None and not h)
    about = whole[len(whole) // 2] if whole else next((t for t in times if t is not None), 0.0)
    return [about + (t - about + HOUR / 2) % HOUR - HOUR / 2 if t is not None and h else t for t, h in zip(times, hourless, strict=True)]


def constraints(segments: list[tuple]) -> list[tuple[float, int, int]]:
    """(weight, before, after) between positions of segments (row number, seconds, has label, text).

    Dialogue order links each row number with the next, timing each mark with the next one more than UNIT later.
    """
    numbered = sorted((s[0], i) for i, s in enumerate(segments) if s[0] is not None)
    text = lambda i: segments[i][3] if len(segments[i]) > 3 else None

    def goes_on(a: int, b: int) -> bool:
        if text(a) is None or text(b) is None or segments[b][2]:
            return False
        if not text(a):  # nothing but a mark: it stands for what follows
            return segments[a][1] is not None
        return text(b)[:1].islower() and text(a)[-1:] not in ".?!"

    edges, head, tail = [], list(range(len(segments))), list(range(len(segments)))
    for (n, a), (m, b) in zip(numbered, numbered[1:], strict=False):
        if n < m:
            cue = goes_on(a, b)
            edges.append((DIALOGUE + CUE * cue, a, b))
            if cue:
                head[b] = head[a]
    for _, i in reversed(numbered):
        tail[head[i]] = max(tail[head[i]], i, key=lambda k: -1 if segments[k][0] is None else segments[k][0])
    edges += [(CUE, i - 1, i) for i in range(1, len(segments)) if not segments[i][2] and segments[i][0] is None]
    timed = sorted((s[1], i) for i, s in enumerate(segments) if s[1] is not None)
    later = 0
    for t, i in timed:
        while later < len(timed) and timed[later][0] <= t + UNIT:
            later += 1
        if later < len(timed):
            j = timed[later][1]
            # what goes on with a segment shares its time
            edges.append((TIMING, i, j) if head[i] == head[j] else (TIMING, tail[head[i]], head[j]))
    return edges


def order(segments: list[tuple]) -> list[int]:
    """Positions of the segments (row number, seconds, has label, text) in order: the weightier of conflicting constraints are kept.

    What the kept constraints leave open goes by row number, then by position. Constraints are added one by one to an order that is kept
    topological: only the segments between the two ends of one that does not fit are looked at.
    """
    n = len(segments)
    key = sorted(range(n), key=lambda i: (segments[i][0] is None, segments[i][0] or 0, i))
    at = [0] * n
    for k, i in enumerate(key):
        at[i] = k
    rank = list(at)
    edges = constraints(segments)
    if all(at[a] < at[b] for _, a, b in edges):
        return key  # no constraint speaks against the row numbers
    after: list[list[int]] = [[] for _ in range(n)]
    before: list[list[int]] = [[] for _ in range(n)]

    def within(start: int, links: list[list[int]], low: int, high: int) -> list[int]:
        seen, todo = {start}, [start]
        while todo:
            for y in links[todo.pop()]:
                if y not in seen and low <= at[y] <= high:
                    seen.add(y)
                    todo.append(y)
        return sorted(seen, key=at.__getitem__)

    for _, a, b in sorted(edges, key=lambda e: (-e[0], rank[e[1]], rank[e[2]])):
        if at[a] > at[b]:
            behind = within(b, after, at[b], at[a])
            if a in behind:
                continue  # it would close a cycle of weightier constraints
            moved = within(a, before, at[b], at[a]) + behind
            for i, k in zip(moved, sorted(at[i] for i in moved), strict=True):
                at[i] = k
        after[a].append(b)
        before[b].append(a)
    waits = [len(x) for x in before]
    ready = [(rank[i], i) for i in range(n) if not waits[i]]
    heapq.heapify(ready)
    out = []
    while ready:
        a = heapq.heappop(ready)[1]
        out.append(a)
        for b in after[a]:
            waits[b] -= 1
            if not waits[b]:
                heapq.heappush(ready, (rank[b], b))
    return out


def _sound(span: str) -> bool:
    m = _INNER.match(span)
    return bool(m) and m[1].lower() not in _PROCEEDINGS and not (span[0] == "(" and span[1] != "(" and span.rstrip(")").endswith("."))


_PROCEEDINGS = frozenset(PROCEEDINGS.split())


def clean(text: str) -> tuple[str, float | None, bool, bool, bool, bool]:
    """Clean text, seconds of the time mark, and whether the text had a time mark, a filler, a sound, and a mark of minutes that leaves out the hour."""
    mark = TIME.match(text)
    time = None
    if mark:
        time = seconds(mark["m"])
        text = text[: mark.start("m")] + text[mark.end() :]
    sound = False
    if text and any(c in text for c in "([{<*♪"):

        def cut(m: re.Match) -> str:
            nonlocal sound
            if _sound(m.group()):
                sound = True
                return ""
            return m.group()

        text = SOUND.sub(cut, text)
    text, fillers = FILLER.subn("", text)
    return " ".join(text.split()), time, bool(mark), fillers > 0, sound, bool(mark) and mark["m"][0] == "{"


_OUT = pa.schema(
    [("doc_id", pa.string()), ("page", pa.int32()), ("place", pa.int32()), ("id", pa.string()), ("spoken", pa.bool_()), ("kind", pa.string()), ("participant", pa.string()), ("label", pa.string()), ("text", pa.string()), ("seconds", pa.float64()), ("timestamp", pa.bool_()), ("filler", pa.bool_()), ("sound", pa.bool_())]
)
OUT = "doc_id string, page int, place int, id string, spoken boolean, kind string, participant string, label string, text string, seconds double, timestamp boolean, filler boolean, sound boolean"


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Orders and cleans the rows page by page; rows come sorted by doc_id and page. A page is at most as large as its sheet."""
    held: list[tuple] = []
    out: list[tuple] = []

    def flush() -> None:
        cleaned = [clean(r[4] or "") for r in held]
        times = aligned([c[1] for c in cleaned], [c[5] for c in cleaned])
        for place, i in enumerate(order([(r[3], t, bool(r[7]) or bool(LABEL.match(c[0])), c[0]) for r, c, t in zip(held, cleaned, times, strict=True)])):
            doc, page, rid, _, _, kind, participant, label = held[i]
            text, _, ts, filler, sound, _ = cleaned[i]
            time = times[i]
            labelled = LABEL.match(text)
            said = text[labelled.end() :] if labelled and label else text
            out.append((doc, page, place, rid, kind is not None and (not sound or bool(said)), kind, participant, label, said, time, ts, filler, sound))

    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[-1][:2] != r[:2]:
                flush()
                held = []
            held.append(r)
        if len(out) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OUT.types, strict=True)], schema=_OUT)
            out = []
    if held:
        flush()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OUT.types, strict=True)], schema=_OUT)


def segments(rows: DataFrame, lines: DataFrame, contexts: DataFrame) -> DataFrame:
    """Ordered, cleaned segments of interviews. Rows delivered twice count once; texts that are null are empty segments; a row without a number has that of its id."""
    chosen = contexts.filter("document_type = 'interview'").select("doc_id").distinct()
    own = rows.select("doc_id", "id", "physical_page", "row_index", "text", "event_kind", "speaker_anchor_label", "speaker_participant_id", F.coalesce("ingested_at", F.lit(0).cast("timestamp")).alias("at")).join(chosen, "doc_id", "left_semi")
    once = own.groupBy("doc_id", "id").agg(F.max_by(F.struct("physical_page", "row_index", "text", "speaker_anchor_label", "speaker_participant_id"), "at").alias("r"))
    line = lines.filter(F.col("kind").isin(*TESTIMONY, "unknown")).select("doc_id", F.col("source_row_id").alias("id"), "kind", "speaker").dropDuplicates(["doc_id", "id"])
    # both sides grow with the rows, so neither is broadcast; they are grouped by the key already
    both = once.join(line.hint("merge"), ["doc_id", "id"], "left").select(
        "doc_id", F.col("r.physical_page").alias("page"), "id", F.coalesce("r.row_index", F.regexp_extract("id", r"_r(\d{1,9})$", 1).try_cast("int") - 1).alias("row"), F.col("r.text").alias("text"), "kind", F.coalesce("r.speaker_participant_id", "speaker.participant_id").alias("participant"), F.coalesce("r.speaker_anchor_label", "speaker.label").alias("label")
    )
    return both.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "row", "id").mapInArrow(_pages, OUT)


def speakers(segmented: DataFrame, participants: DataFrame) -> DataFrame:
    """Segments with ``person``: the participant of the row's id or label, else the label's letters; null where the row names nobody."""
    labels = participants.filter("id is not null").select("doc_id", F.col("id").alias("known"), F.explode(F.array_union(F.coalesce("observed_labels", F.array().cast("array<string>")), F.array("display_label"))).alias("label")).filter("label is not null")
    one = labels.groupBy("doc_id", "label").agg(F.min("known").alias("known"))
    letters = F.regexp_replace(F.lower("label"), r"^(mr|mrs|ms|dr|miss)\b\.?|[^\p{L}]", "")
    return segmented.join(one.hint("merge"), ["doc_id", "label"], "left").withColumn("person", F.coalesce("participant", "known", letters)).drop("known")


def with_turns(spoken: DataFrame) -> DataFrame:
    """Segments of speech with ``turn_no``, counted from 1, and ``opens``: whether another person than that of the segment before speaks.

    ``spoken`` is read twice: page by page, each page giving its first and last person and the turns that open within it, and again to meet
    what the pages before it come to.
    """
    at = F.when(F.col("person").isNotNull(), F.col("place"))
    page = W.partitionBy("doc_id", "page").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    before, person = F.last("person", ignorenulls=True).over(page), F.col("person")
    # the first person of a page opens a turn unless it is the last one of the pages before
    placed = spoken.withColumn("before", before).withColumn("n", F.count("*").over(page)).withColumn("inner", F.coalesce(person != F.col("before"), F.lit(False)).cast("int")).withColumn("leads", (person.isNotNull() & F.col("before").isNull()).cast("int"))
    sums = placed.groupBy("doc_id", "page").agg(F.max_by("person", at).alias("end"), F.min_by("person", at).alias("start"), F.sum("inner").alias("inner"), F.max(((F.col("n") == 0) & person.isNull()).cast("int")).alias("vague"))
    pages = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.withColumn("carried", F.last("end", ignorenulls=True).over(pages)).withColumn("earlier", F.count("*").over(pages))
    start = F.col("start")
    # what a page adds: its inner openings, its first person if new, and the transcript's first segment where that names nobody
    new = (start.isNotNull() & (F.col("carried").isNull() | (F.col("carried") != start))).cast("int")
    added = carried.withColumn("new", new).withColumn("base", F.coalesce(F.sum(F.col("inner") + F.col("new") + F.when(F.col("earlier") == 0, F.col("vague")).otherwise(0)).over(pages), F.lit(0)))
    joined = placed.join(added.select("doc_id", "page", "earlier", "new", "base").hint("merge"), ["doc_id", "page"])
    first = (F.col("n") == 0) & (F.col("earlier") == 0)
    opens = first | (F.col("inner") + F.col("leads") * F.col("new") > 0)
    upto = W.partitionBy("doc_id", "page").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    return joined.withColumn("opens", opens).withColumn("turn_no", F.col("base") + F.sum(F.col("opens").cast("int")).over(upto)).drop("before", "n", "inner", "leads", "earlier", "new", "base")


def segmented(rows: DataFrame, lines: DataFrame, contexts: DataFrame, participants: DataFrame) -> DataFrame:
    """The segments with their persons, written once."""
    return cut_lineage(speakers(segments(rows, lines, contexts), participants))


def findings(rows: DataFrame, lines: DataFrame, contexts: DataFrame, participants: DataFrame) -> DataFrame:
    """doc_id, row_id, finding: 'timestamp', 'filler', 'sound' and 'turn'."""
    all_ = segmented(rows, lines, contexts, participants)
    marks = all_.select("doc_id", F.col("id").alias("row_id"), F.explode(F.filter(F.array(*[F.when(F.col(k), k) for k in ("timestamp", "filler", "sound")]), lambda x: x.isNotNull())).alias("finding"))
    spoken = all_.filter("spoken").select("doc_id", "page", "place", "id", "person")
    return marks.unionByName(with_turns(spoken).filter("opens").select("doc_id", F.col("id").alias("row_id"), F.lit("turn").alias("finding")))


def speaker_turns(rows: DataFrame, lines: DataFrame, contexts: DataFrame, participants: DataFrame) -> DataFrame:
    """Clean turns of interviews: doc_id, turn_no, person, label, seconds (of the first mark), text."""
    spoken = segmented(rows, lines, contexts, participants).filter("spoken").select("doc_id", "page", "place", "person", "label", "seconds", "text")
    at = F.struct("page", "place")
    # a page's part of a turn first, so that a turn of many pages meets as few rows
    parts = with_turns(spoken).groupBy("doc_id", "turn_no", "page").agg(
        F.min_by("person", F.when(F.col("person").isNotNull(), at)).alias("person"), F.min_by("label", F.when(F.col("label").isNotNull(), at)).alias("label"), F.min_by("seconds", F.when(F.col("seconds").isNotNull(), at)).alias("seconds"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("page"))).alias(c)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), " ").alias("text")
    return parts.groupBy("doc_id", "turn_no").agg(first("person"), first("label"), first("seconds"), whole)
