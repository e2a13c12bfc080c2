"""Conversations rebuilt from message rows, and what is wrong with them.

Rows become turns. For every reply the question turns before it are candidate parents, scored by time (question turns between, and whether
they are of the same channel), mentions of the other speaker and shared words; the likeliest parent wins, and the links form one tree per question. Rows, lines and page frames meet
once, page by page; a page is at most a sheet's rows. Pages are chained by running sums, so no task ever holds a whole transcript's rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestant.llm.common import TESTIMONY
from attestant.sources.tables import cut_lineage

#: What a mention of the other speaker and shared words gain at most, and what a reply over one more question costs: either alone is
#: no ground to pass over a question of another channel (another speaker's), both together are. A question of the same speaker closes
#: that speaker's earlier ones, so passing over it, or over one whose speaker is not known, costs more than can be gained.
MENTION, SHARED, CROSSING, CLOSED = 0.9, 0.9, 1.0, 2.0
#: Question turns back that a reply may reach. One further back could not win, as the latest question costs nothing.
REACH = math.ceil((MENTION + SHARED) / CROSSING)

_LONG_WORD = re.compile(r"[^\W_]{4,}")
# Last words of labels that name a role, not a person.
_ROLES = frozenset("witness court reporter videographer interpreter interviewer interviewee deponent examiner judge clerk bailiff counsel speaker operator question answer plaintiff defendant defence defense unknown redacted".split())
_SURNAME = re.compile(r"([^\W\d_]{4,})[.,]?\s*(?:[^\W\d_]\.)?\s*$")
_TURN = pa.struct([("local", pa.int32()), ("questions", pa.int32()), ("kind", pa.string()), ("forced", pa.bool_()), ("row", pa.int32()), ("label", pa.string()), ("participant", pa.string()), ("role", pa.string()), ("name", pa.int32()), ("words", pa.list_(pa.int32())), ("text", pa.string())])
_PAGE = pa.schema([("doc_id", pa.string()), ("page", pa.int32()), ("delivered", pa.bool_()), ("holes", pa.bool_()), ("absent", pa.bool_()), ("said", pa.bool_()), ("framed", pa.bool_()), ("runs_in", pa.string()), ("runs_out", pa.string()), ("turns", pa.list_(_TURN))])
_PAGE_DDL = "doc_id string, page int, delivered boolean, holes boolean, absent boolean, said boolean, framed boolean, runs_in string, runs_out string, turns array<struct<local:int,questions:int,kind:string,forced:boolean,row:int,label:string,participant:string,role:string,name:int,words:array<int>,text:string>>"


def _hash(word: str) -> int:
    return zlib.crc32(word.encode()) - (1 << 31)


def _page(doc: str, number: int, records: list[tuple], with_text: bool) -> tuple:
    """One page's record. records: (what, row, id, at, text, event_kind, label, participant, kind, role, row_ids, runs_in, runs_out)."""
    rows: dict[str, tuple] = {}
    lines: dict[str, tuple] = {}
    frame = None
    for r in records:
        if r[0] == 0:
            old = rows.get(r[2])
            if old is None or (r[3] or 0) > (old[3] or 0):
                rows[r[2]] = r
        elif r[0] == 1:
            lines.setdefault(r[2], r)
        elif frame is None:
            frame = r
    numbers = {r[1] for r in rows.values() if r[1] is not None}
    holes = bool(rows) and (not numbers or min(numbers) != 0 or len(numbers) <= max(numbers))
    absent = bool(frame and rows and any(i not in rows for i in frame[10] or ()))
    turns: list[list] = []
    questions, said, last = 0, False, None
    for r in sorted(rows.values(), key=lambda r: (r[1] is None, r[1], r[2] or "")):
        line = lines.get(r[2])
        if not line:
            continue
        kind, text = line[8], r[4] or ""
        label, participant = r[6] or line[6], line[7] or r[7]
        role = line[9] if line[9] != "unknown" else None
        if kind != "unknown":
            said = said or bool(text.strip())
            marked = kind == "question" and r[5] == "question_marker"
            if last is None or marked or kind != last[0] or (kind != "question" and participant and last[1] and participant != last[1]):
                if turns and kind == "question":
                    questions += 1
                turns.append([len(turns), questions, kind, marked, r[1], None, None, None, None, set(), []])
            last = (kind, participant)
        elif not turns:
            turns.append([0, 0, "unknown", False, r[1], None, None, None, None, set(), []])
            last = None
        t = turns[-1]
        t[5], t[6], t[7] = t[5] or label, t[6] or participant, t[7] or role
        t[9].update(map(_hash, _LONG_WORD.findall(text.lower())))
        t[10].append(text)
    for t in turns:
        m = _SURNAME.search((t[5] or "").lower())
        m = m if m and m[1] not in _ROLES else None
        t[8], t[9], t[10] = _hash(m[1]) if m else None, sorted(t[9]), " ".join(t[10]) if with_text else None
    names = _TURN.names
    return (doc, number, bool(rows), holes, absent, said, frame is not None, frame[11] if frame else None, frame[12] if frame else None, [dict(zip(names, t, strict=True)) for t in turns])


def _mapper(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PAGE.types, strict=True)], schema=_PAGE)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:2] != key:
                    if held:
                        out.append(_page(*key, held, with_text))
                    key, held = r[:2], []
                held.append(r[2:])
            if len(out) > 500:
                yield made()
                out = []
        if held:
            out.append(_page(*key, held, with_text))
        if out:
            yield made()

    return run


def pages(rows: DataFrame, lines: DataFrame, frames: DataFrame, with_text: bool = False) -> DataFrame:
    """One record for each page: whether it was delivered whole, whether testimony with text stands on it, its links and its turns.

    Rows delivered twice count once, those delivered last. Rows of unknown kind go on with the turn they stand in; headings,
    parentheticals and furniture have no turn. Rows without a page or id are left out.
    """
    none = lambda kind: F.lit(None).cast(kind)
    a = rows.select("doc_id", F.col("physical_page").alias("page"), F.lit(0).alias("what"), F.col("row_index").alias("row"), "id", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("at"), "text", "event_kind", F.col("speaker_anchor_label").alias("label"), F.col("speaker_participant_id").alias("participant"), none("string").alias("kind"), none("string").alias("role"), none("array<string>").alias("row_ids"), none("string").alias("runs_in"), none("string").alias("runs_out"))
    b = lines.filter(F.col("kind").isin(*TESTIMONY, "unknown")).select(
        "doc_id", F.col("physical_page").alias("page"), F.lit(1).alias("what"), F.col("row_index").alias("row"), F.col("source_row_id").alias("id"), none("long").alias("at"), none("string").alias("text"), none("string").alias("event_kind"), F.col("speaker.label").alias("label"), F.col("speaker.participant_id").alias("participant"), "kind", F.col("speaker.speaker_role").alias("role"),
        none("array<string>").alias("row_ids"), none("string").alias("runs_in"), none("string").alias("runs_out"),
    )
    c = frames.select(
        "doc_id", F.col("physical_page").alias("page"), F.lit(2).alias("what"), none("int").alias("row"), none("string").alias("id"), none("long").alias("at"), none("string").alias("text"), none("string").alias("event_kind"), none("string").alias("label"), none("string").alias("participant"), none("string").alias("kind"), none("string").alias("role"), "row_ids",
        F.col("continuity_in.utterance_id").alias("runs_in"), F.col("continuity_out.utterance_id").alias("runs_out"),
    )
    keyed = a.unionByName(b).unionByName(c).filter("doc_id is not null and page is not null and (what = 2 or id is not null)")
    return keyed.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page").mapInArrow(_mapper(with_text), _PAGE_DDL)


def turns(paged: DataFrame) -> DataFrame:
    """Turns over page breaks: doc_id, turn_no, question_no, kind, label, participant, role, name, words, text.

    A question turn starts at a question row with a mark of its own or after a row of another kind; other turns start where kind or speaker
    changes. Both are counted from 1; what stands before the first question has question_no 0.
    """
    known = F.filter("turns", lambda t: t["kind"] != "unknown")
    short = paged.select("doc_id", "page", F.try_element_at(F.transform(known, lambda t: F.struct(t["kind"].alias("kind"), t["participant"].alias("participant"), t["forced"].alias("forced"))), F.lit(1)).alias("first"), F.try_element_at(F.transform(known, lambda t: F.struct(t["kind"].alias("kind"), t["participant"].alias("participant"))), F.lit(-1)).alias("end"), F.size("turns").alias("n"), F.coalesce(F.try_element_at("turns", F.lit(-1))["questions"], F.lit(0)).alias("q"), (F.try_element_at("turns", F.lit(1))["kind"] == "unknown").alias("vague"))
    before = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    chained = short.withColumn("prior", F.last("end", ignorenulls=True).over(before))
    first, prior = F.col("first"), F.col("prior")
    differs = prior.isNull() | (prior["kind"] != first["kind"]) | ((first["kind"] != "question") & first["participant"].isNotNull() & prior["participant"].isNotNull() & (first["participant"] != prior["participant"]))
    # a page that starts with rows of unknown kind has its first known turn as its second one, counted as opened
    opens = F.coalesce(F.when(F.col("vague"), F.lit(False)).otherwise(first["forced"] | differs), F.lit(False))
    joined = F.coalesce(F.col("vague") & first.isNotNull() & ~(first["forced"] | differs), F.lit(False))  # its second turn goes on with the prior page's
    opened = chained.withColumn("opens", opens.cast("int")).withColumn("joined", joined.cast("int")).withColumn("q_first", (opens & (first["kind"] == "question")).cast("int"))
    q_joined = F.col("joined") * (first["kind"] == "question").cast("int")
    total_t = F.greatest(F.col("n") - 1, F.lit(0)) + F.col("opens") - F.col("joined")
    total_q = F.col("q") + F.coalesce("q_first", F.lit(0)) - F.coalesce(q_joined, F.lit(0))
    summed = opened.withColumn("tt", F.when(F.col("n") > 0, total_t).otherwise(0)).withColumn("qq", F.when(F.col("n") > 0, total_q).otherwise(0)).withColumn("qj", F.coalesce(q_joined, F.lit(0)))
    offsets = summed.select("doc_id", "page", "opens", "joined", "qj", F.coalesce("q_first", F.lit(0)).alias("q_first"), F.coalesce(F.sum("tt").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("qq").over(before), F.lit(0)).alias("q0"))
    placed = paged.select("doc_id", "page", F.explode("turns").alias("t")).join(offsets, ["doc_id", "page"])
    later = (F.col("t.local") > 0).cast("int")
    numbered = placed.select(
        "doc_id", "page", "t.*", F.greatest(F.lit(1).cast("long"), F.col("t0") + F.col("t.local") + F.col("opens") - later * F.col("joined")).alias("turn_no"), (F.col("q0") + F.col("t.questions") + F.col("q_first") - later * F.col("qj")).alias("question_no")
    )
    at = F.struct("page", "local")
    first_of = lambda c, when: F.min_by(c, F.when(when, at))
    return numbered.groupBy("doc_id", "turn_no").agg(
        F.max("question_no").alias("question_no"), F.coalesce(first_of("kind", F.col("kind") != "unknown"), F.lit("unknown")).alias("kind"), first_of("label", F.col("label").isNotNull()).alias("label"), first_of("participant", F.col("participant").isNotNull()).alias("participant"),
        first_of("role", F.col("role").isNotNull()).alias("role"), first_of("name", F.col("name").isNotNull()).alias("name"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "local", "text"))), lambda x: x["text"]), " ").alias("text"),
    )


def reply_links(turned: DataFrame) -> DataFrame:
    """doc_id, turn_no, kind, parent (turn_no of the likeliest question turn), score: of every turn that isn't a question and has one before it.

    Of equally likely parents the latest counts. A question turn is passed over where the reply is that to an earlier one by both signs: it
    mentions that speaker, or is mentioned there, and has its words.
    """
    questions = turned.filter("kind = 'question'").select("doc_id", "question_no", F.col("turn_no").alias("parent"), F.col("words").alias("asked"), F.col("name").alias("asker"), F.col("participant").alias("channel"))
    first = F.greatest(F.lit(1).cast("long"), F.col("question_no") - (REACH - 1))
    replies = turned.filter("kind <> 'question' and question_no > 0").select("doc_id", "turn_no", "kind", "words", F.col("name").alias("replier"), F.explode(F.sequence(first, F.col("question_no"))).alias("question_no"))
    pairs = replies.join(questions, ["doc_id", "question_no"])
    mention = F.coalesce(F.array_contains("words", F.col("asker")), F.lit(False)) | F.coalesce(F.array_contains("asked", F.col("replier")), F.lit(False))
    shared = F.size(F.array_intersect("words", "asked")) / F.greatest(F.lit(1), F.least(F.size("words"), F.size("asked")))
    gain = MENTION * mention.cast("double") + SHARED * shared
    # of each reply the REACH candidates at most, the latest first
    met = pairs.groupBy("doc_id", "turn_no", "kind").agg(F.reverse(F.array_sort(F.collect_list(F.struct("question_no", "channel", "parent", gain.alias("gain"))))).alias("c"))

    def scored(x, i):
        closed = F.exists(F.slice("c", F.lit(1), i), lambda y: F.coalesce(y["channel"] == x["channel"], F.lit(True)))
        return F.struct((x["gain"] - CROSSING * i - F.when(closed, CLOSED).otherwise(0.0)).alias("score"), x["parent"].alias("parent"))

    return met.select("doc_id", "turn_no", "kind", F.array_max(F.transform("c", scored)).alias("best")).select("doc_id", "turn_no", "kind", "best.parent", "best.score")


def broken(paged: DataFrame, contexts: DataFrame) -> DataFrame:
    """doc_id of transcripts with an absent page, an absent row, or page links that don't meet."""
    whole = contexts.groupBy("doc_id").agg(F.max("page_count").alias("page_count"))
    delivered = paged.groupBy("doc_id").agg(F.sum(F.col("delivered").cast("int")).alias("n"), F.max(F.col("holes") | F.col("absent")).alias("torn"))
    lacking = whole.join(delivered, "doc_id").filter((F.col("n") < F.col("page_count")) | F.col("torn")).select("doc_id")
    order = W.partitionBy("doc_id").orderBy("page")
    links = paged.filter("framed").select("doc_id", "page", "runs_out", F.lead("page").over(order).alias("following"), F.lead("runs_in").over(order).alias("runs_in"))
    apart = links.filter((F.col("following") == F.col("page") + 1) & ~F.col("runs_out").eqNullSafe(F.col("runs_in"))).select("doc_id")
    return lacking.unionByName(apart).distinct()


def defects_of(paged: DataFrame, turned: DataFrame, contexts: DataFrame) -> DataFrame:
    full = paged.filter("said").select("doc_id").distinct()
    empty = contexts.select("doc_id").distinct().join(full, "doc_id", "left_anti").select("doc_id", F.lit("empty").alias("defect"))
    cut = broken(paged, contexts).join(full, "doc_id", "left_semi").select("doc_id", F.lit("broken").alias("defect"))
    answered = reply_links(turned).filter("kind = 'answer'").select("doc_id", F.col("parent").alias("turn_no")).distinct()
    silent = turned.filter("kind = 'question'").select("doc_id", "turn_no").join(answered, ["doc_id", "turn_no"], "left_anti").select("doc_id").distinct()
    return empty.unionByName(cut).unionByName(silent.join(full, "doc_id", "left_semi").select("doc_id", F.lit("no_reply").alias("defect")))


def defects(rows: DataFrame, lines: DataFrame, contexts: DataFrame, frames: DataFrame) -> DataFrame:
    """doc_id, defect ('empty', 'broken', 'no_reply'); an empty transcript has no other defect. No transcripts: no rows."""
    paged = cut_lineage(pages(rows, lines, frames))
    return defects_of(paged, cut_lineage(turns(paged)), contexts)


def conversations(rows: DataFrame, lines: DataFrame, contexts: DataFrame, frames: DataFrame) -> DataFrame:
    """The turns of transcripts without defect: doc_id, turn_no, parent, role, label, participant, text; parent null for questions and what stands before them."""
    paged = cut_lineage(pages(rows, lines, frames, with_text=True))
    turned = cut_lineage(turns(paged))
    good = contexts.select("doc_id").distinct().join(defects_of(paged, turned, contexts), "doc_id", "left_anti")
    linked = turned.join(reply_links(turned).select("doc_id", "turn_no", "parent"), ["doc_id", "turn_no"], "left").join(good, "doc_id", "left_semi")
    by_kind = F.when(F.col("kind") == "question", "examiner").when(F.col("kind") == "answer", "witness").when(F.col("kind") == "objection", "attorney").otherwise("speaker")
    return linked.select("doc_id", "turn_no", "parent", F.coalesce("role", by_kind).alias("role"), "label", "participant", "text")

