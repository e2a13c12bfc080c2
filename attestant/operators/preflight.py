"""What a document is learned to look like before its lines are classified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestant.functions.marks import (
    MARKERS, bare_name, by_label, colon_label, has_redaction, introduced, is_objection, is_redacted, label_role, labels_match, marker, speaker_label, titled_label,
)
from attestant.functions.text import WS, ascii_lower, ascii_upper, canonical_label, lines_of, shortened, trimmed, upper_median, word_count
from attestant.operators.inventory import is_header
from attestant.operators.scan import running
from attestant.operators.sections import FAMILY, REFERENCE

# Roles in the order in which the last of equal votes counts, with the beginnings of their participants' ids.
ROLES = (("attorney", "attorney"), ("witness", "witness"), ("interpreter", "interpreter"), ("court_reporter", "reporter"), ("judge", "judge"), ("videographer", "videographer"))
GENERIC = ("THE WITNESS", "WITNESS", "THE DEPONENT", "DEPONENT", "THE REPORTER", "REPORTER", "THE INTERPRETER", "INTERPRETER", "THE COURT")
SUBJECT = ("INTERVIEW OF:", "INTERVIEW OF", "DEPOSITION OF:", "DEPOSITION OF", "WITNESS:")
#: Redaction candidates kept of a document, in page order.
MOST_CANDIDATES = 750


def marker_dictionary(spark: SparkSession) -> DataFrame:
    """the marks every document is tried for: kind, style, pattern, priority, place."""
    return spark.createDataFrame([(k, s, p, n, i) for i, (k, s, p, n, _) in enumerate(MARKERS)], "kind string, style string, pattern string, priority int, place int")


def testimony_lines(lines: DataFrame, contexts: DataFrame) -> DataFrame:
    """Lines of testimony pages with their page's label and whether they are its header."""
    said = lines.filter("section = 'transcript'").join(contexts.select("doc_id", "physical_page", "transcript_page"), ["doc_id", "physical_page"], "left")
    return said.withColumn("header", is_header(F.col("body"), F.col("transcript_page"), F.col("line_index")))


def marker_rules(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, kind, style, pattern, priority, observations for each mark of the dictionary; labelled lines teach nothing."""
    m = marker(F.col("body"))
    seen = lines.filter("section = 'transcript'").filter(speaker_label(F.col("body")).isNull()).select("doc_id", m.alias("m")).filter("m is not null").groupBy("doc_id", F.col("m.kind").alias("kind"), F.col("m.style").alias("style"), F.col("m.pattern").alias("pattern")).count()
    entries = [F.struct(F.lit(k).alias("kind"), F.lit(s).alias("style"), F.lit(p).alias("pattern"), F.lit(n).alias("priority"), F.lit(i).alias("place")) for i, (k, s, p, n, _) in enumerate(MARKERS)]
    all_ = documents.select("doc_id").distinct().select("doc_id", F.inline(F.array(*entries)))
    return all_.join(seen, ["doc_id", "kind", "style", "pattern"], "left").select("doc_id", "kind", "style", "pattern", "priority", F.coalesce("count", F.lit(0)).alias("observations"), "place")


def dominant_markers(rules: DataFrame) -> DataFrame:
    """doc_id, question, answer: the mark most seen, of equal ones that of the higher rank; both null unless both kinds were seen."""
    best = lambda k: F.max_by("pattern", F.when((F.col("kind") == k) & (F.col("observations") > 0), F.struct("observations", -F.col("priority"), F.col("place"))))
    found = rules.groupBy("doc_id").agg(best("question").alias("q"), best("answer").alias("a"))
    both = F.col("q").isNotNull() & F.col("a").isNotNull()
    return found.select("doc_id", F.when(both, F.col("q")).alias("question"), F.when(both, F.col("a")).alias("answer"))


def titled_style(lines: DataFrame) -> DataFrame:
    """P20: doc_id, titled: whether any testimony line has a titled label."""
    return lines.filter("section = 'transcript'").groupBy("doc_id").agg(F.coalesce(F.max(titled_label(F.col("body")).isNotNull()), F.lit(False)).alias("titled"))


def observations(said: DataFrame, keep=lambda df: df) -> DataFrame:
    """One row for each line that tells of a participant: doc_id, physical_page, line_index, label, canonical, role, observation.

    ``keep`` writes what is read more than once. An unmarked question is remembered: an unmarked line of another label without a role after it is an answer, until an answer is seen.
    """
    titled = titled_style(said)
    body = F.col("body")
    base = said.filter((F.col("body") != "") & ~F.col("header")).join(titled, "doc_id").select(
        "doc_id", "physical_page", "line_index", introduced(body).alias("intro"), by_label(body).alias("by"), F.when(F.col("titled"), speaker_label(body)).otherwise(colon_label(body)).alias("l")
    )
    known = base.filter("intro is not null or by is not null or l is not null")
    label = F.coalesce("intro", "by", "l.label")
    rest = F.col("l.rest")
    told = known.withColumn("label", label).withColumn("plain", F.col("intro").isNull() & F.col("by").isNull()).withColumn("mark", F.when(F.col("plain"), marker(rest)["kind"])).filter(F.col("intro").isNotNull() | ~is_redacted(F.col("label")))
    told = told.withColumn("canonical", canonical_label(F.col("label"))).withColumn("own", label_role(F.col("label"))).withColumn("objects", F.col("plain") & is_objection(rest)).withColumn("asks", F.col("plain") & F.col("mark").isNull() & ~F.col("objects") & trimmed(rest).endswith("?"))
    told = keep(told)  # few lines have a label; what follows reads them several times
    # what is remembered: the label of the last unmarked question, forgotten at an answer; answers by memory forget it, too, but follow only from earlier events
    set_ = F.when(F.col("asks"), F.struct(F.col("canonical").alias("who"))).when(F.col("mark") == "answer", F.struct(F.lit(None).cast("string").alias("who")))
    memory = running(told.withColumn("event", set_), ["line_index"], lasts={"last_event": F.col("event")})
    may = F.col("plain") & F.col("mark").isNull() & F.col("own").isNull() & ~F.col("objects") & ~F.col("asks") & (F.col("last_event.who") != F.col("canonical"))
    # of the lines that may answer one question only the first does
    events = running(memory.withColumn("may", F.coalesce(may, F.lit(False))), ["line_index"], sums={"n_event": F.col("event").isNotNull().cast("long")})
    first = F.row_number().over(W.partitionBy("doc_id", "n_event", "may").orderBy("physical_page", "line_index"))
    answers = F.col("may") & (first == 1)
    observation = F.when(F.col("intro").isNotNull(), "statement").when(F.col("by").isNotNull(), "question").when(F.col("mark") == "question", "question").when(F.col("mark") == "answer", "answer").when(F.col("objects"), "objection").when(F.col("asks"), "question").when(answers, "answer").otherwise("statement")
    role = F.when(F.col("intro").isNotNull(), "witness").when(F.col("by").isNotNull(), F.coalesce("own", F.lit("unknown"))).when(F.col("mark") == "question", "attorney").when(F.col("mark") == "answer", "witness").when(F.col("objects"), "attorney").otherwise(F.coalesce("own", F.lit("unknown")))
    return events.select("doc_id", "physical_page", "line_index", "label", "canonical", role.alias("speaker_role"), observation.alias("observation"))


def participants(seen: DataFrame) -> DataFrame:
    """A row for each label of a document: id, display_label, canonical_name, observed_labels, speaker_role, role_confidence and counts.

    The role is the one most voted for, of equal ones the later in ROLES; ids count up in each role in the order the labels were first seen.
    """
    votes = [F.sum((F.col("speaker_role") == r).cast("int")).alias(f"v_{r}") for r, _ in ROLES]
    kinds = [F.sum((F.col("observation") == k).cast("int")).alias(f"{k}_observations") for k in ("question", "answer", "objection", "statement")]
    who = seen.groupBy("doc_id", "canonical").agg(F.min(F.struct("physical_page", "line_index")).alias("first_seen"), F.array_sort(F.collect_set(trimmed(F.col("label")))).alias("observed_labels"), F.count("*").alias("observations"), *votes, *kinds)
    top = F.greatest(*[F.struct(F.col(f"v_{r}").alias("v"), F.lit(i).alias("i"), F.lit(r).alias("r"), F.lit(p).alias("p")) for i, (r, p) in enumerate(ROLES)])
    total = sum((F.col(f"v_{r}") for r, _ in ROLES), F.lit(0))
    voted = who.withColumn("top", top).withColumn("speaker_role", F.when(F.col("top.v") > 0, F.col("top.r")).otherwise("unknown")).withColumn("role_confidence", F.when(F.col("top.v") > 0, F.col("top.v") / total).otherwise(0.3)).withColumn("prefix", F.when(F.col("top.v") > 0, F.col("top.p")).otherwise("speaker"))
    number = F.row_number().over(W.partitionBy("doc_id", "speaker_role").orderBy("first_seen"))
    named = voted.withColumn("id", F.concat_ws("_", "prefix", number.cast("string"))).withColumn("display_label", F.element_at("observed_labels", 1))
    generic = ascii_upper(trimmed(F.col("display_label"))).isin(*GENERIC) | is_redacted(F.col("display_label"))
    return named.select("doc_id", "id", "display_label", F.when(~generic & (F.col("speaker_role") != "unknown"), trimmed(F.col("display_label"))).alias("canonical_name"), "observed_labels", "canonical", "first_seen", "speaker_role", "role_confidence", F.lit(False).alias("redacted"), "observations", "question_observations", "answer_observations", "objection_observations", "statement_observations")


def front_lines(pages: DataFrame, most: int, family_only: bool = False) -> DataFrame:
    """Lines of the first ``most`` pages that belong to the transcript or, unless family_only, are unknown: doc_id, place, line."""
    kinds = FAMILY if family_only else (*FAMILY, "unknown")
    if family_only:
        ranked = pages.filter(F.col("section").isin(*kinds)).withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("physical_page"))).filter(F.col("n") <= most)
    else:
        ranked = pages.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("physical_page"))).filter(F.col("n") <= most).filter(F.col("section").isin(*kinds))
    return ranked.filter("text is not null").select("doc_id", "physical_page", F.posexplode(lines_of(F.col("text"))).alias("line_index", "line")).withColumn("line", trimmed(F.col("line")))


def named_subject(pages: DataFrame) -> DataFrame:
    """doc_id, subject: the first name after a word of SUBJECT on the first twelve pages."""
    lines = front_lines(pages, 12)
    after = lambda p: F.when(F.instr("upper", p) > 0, F.struct(trimmed(F.regexp_replace(trimmed(F.substring("line", F.instr("upper", p) + len(p), F.lit(1 << 20))), r"^:+|:+$", "")).alias("c")))
    lines = lines.withColumn("upper", ascii_upper(F.col("line")))
    found = lines.withColumn("c", F.filter(F.array(*[after(p) for p in SUBJECT]), lambda t: t.isNotNull() & (F.octet_length(t["c"]) >= 2))).filter(F.size("c") > 0).withColumn("subject", canonical_label(F.col("c")[0]["c"]))
    return found.groupBy("doc_id").agg(F.min_by("subject", F.struct("physical_page", "line_index")).alias("subject"))


def front_names(pages: DataFrame, people: DataFrame) -> DataFrame:
    """P10: doc_id, id, front_name: the first line in capitals of the first sixteen pages, of two to five words, that ends in the label's last name."""
    surname = F.element_at(F.split(bare_name(F.col("display_label"), "MR", "MS", "MRS", "MISS", "DR", "HON", "CHAIRMAN"), " "), -1)
    wanted = people.select("doc_id", "id", surname.alias("surname")).filter(F.octet_length("surname") >= 3)
    lines = front_lines(pages, 16).withColumn("line", trimmed(F.regexp_replace("line", r"^[0-9]+", ""))).filter(speaker_label(F.col("line")).isNull())
    head = trimmed(F.regexp_extract("line", r"^([^,]*)", 1))
    last = F.regexp_replace(F.element_at(F.split("head", rf"{WS}+"), -1), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    heads = lines.withColumn("head", head).filter(~F.col("head").rlike(r"\p{Ll}") & word_count(F.col("head")).between(2, 5)).withColumn("surname", ascii_upper(last))
    return wanted.join(heads, ["doc_id", "surname"]).groupBy("doc_id", "id").agg(F.min_by("head", F.struct("physical_page", "line_index")).alias("front_name"))


def front_roles(pages: DataFrame, people: DataFrame) -> DataFrame:
    """doc_id, id and whether a line "name, role" of the front matter names the label's surname with a word of counsel, law enforcement or government."""
    lines = front_lines(pages, 12, family_only=True).withColumn("line", ascii_upper(F.col("line"))).filter(F.col("line").contains(","))
    name, role = F.regexp_extract("line", r"^([^,]*),", 1), F.regexp_replace("line", r"^[^,]*,", "")
    told = lines.select("doc_id", F.regexp_replace(F.element_at(F.split(trimmed(name), rf"{WS}+"), -1), r"^\.+|\.+$", "").alias("surname"), role.rlike("COUNSEL|ATTORNEY|ESQ").alias("counsel"), role.rlike("FBI|SPECIAL AGENT|MARSHAL|LAW ENFORCEMENT").alias("law"), role.rlike(r"ATTORNEY GENERAL|DEPARTMENT OF JUSTICE|U\.S\. ATTORNEY").alias("government"))
    surname = F.regexp_replace(F.element_at(F.split(ascii_upper(trimmed(F.col("display_label"))), rf"{WS}+"), -1), r"^\.+|\.+$", "")
    wanted = people.select("doc_id", "id", surname.alias("surname")).filter(F.octet_length("surname") >= 2)
    return wanted.join(told, ["doc_id", "surname"]).groupBy("doc_id", "id").agg(F.max("counsel").alias("counsel"), F.max("law").alias("law"), F.max("government").alias("government"))


def functions_of(people: DataFrame, pages: DataFrame, types: DataFrame) -> DataFrame:
    """Participants with participant_function and function_confidence, and roles and names as the front matter sets them."""
    tops = people.groupBy("doc_id").agg(F.max_by(F.struct("id", "question_observations"), F.struct("question_observations", "first_seen")).alias("q"), F.max_by(F.struct("id", "answer_observations"), F.struct("answer_observations", "first_seen")).alias("a"))
    joined = people.join(tops, "doc_id", "left").join(named_subject(pages), "doc_id", "left").join(front_roles(pages, people), ["doc_id", "id"], "left").join(front_names(pages, people), ["doc_id", "id"], "left").join(types.select("doc_id", "document_type"), "doc_id", "left")
    subject = F.coalesce(labels_match(F.col("subject"), ascii_upper(F.col("display_label"))), F.lit(False))
    counsel, law, government = (F.coalesce(c, F.lit(False)) for c in ("counsel", "law", "government"))
    interview = F.col("document_type") == "interview"
    asks = (F.col("q.id") == F.col("id")) & (F.col("q.question_observations") > 0)
    answers = (F.col("a.id") == F.col("id")) & (F.col("a.answer_observations") > 0)
    role = F.when(subject, "witness").when((F.col("speaker_role") == "unknown") & (counsel | government), "attorney").otherwise(F.col("speaker_role"))
    sure = F.when(subject, 0.98).when((F.col("speaker_role") == "unknown") & (counsel | government), 0.95).otherwise(F.col("role_confidence"))
    told = joined.withColumn("is_subject", subject).withColumn("new_role", role).withColumn("new_confidence", sure)
    r = F.col("new_role")
    cut = lambda f, c: F.struct(F.lit(f).alias("f"), F.lit(c).alias("c"))
    made = (
        F.when(F.col("is_subject"), F.when(interview, cut("interviewee", 1.0)).when(F.col("document_type").isin("deposition", "examination"), cut("witness", 1.0)).otherwise(cut("witness", 0.9)))
        .when(r == "interpreter", cut("interpreter", 1.0)).when(r == "court_reporter", cut("court_reporter", 1.0)).when(r == "judge", cut("judge", 1.0)).when(r == "videographer", cut("videographer", 1.0))
        .when(law, cut("law_enforcement", 0.95)).when(asks & interview, cut("interviewer", 0.95)).when(government, cut("government_counsel", 0.92)).when(counsel, cut("counsel", 0.92))
        .when(r == "attorney", cut("counsel", 0.78)).when((r == "witness") | answers, F.when(interview, cut("interviewee", 0.88)).otherwise(cut("witness", 0.88))).otherwise(cut("unknown", 0.3))
    )
    named = F.when(F.col("is_subject"), F.col("subject")).when(F.col("front_name").isNotNull(), F.col("front_name")).when(F.col("canonical_name").isNull() & (F.col("made.f") != "unknown"), F.col("display_label")).otherwise(F.col("canonical_name"))
    out = told.withColumn("made", made).withColumn("canonical_name", named)
    return out.select(*[c for c in people.columns if c not in ("speaker_role", "role_confidence")], F.col("new_role").alias("speaker_role"), F.col("new_confidence").alias("role_confidence"), F.col("made.f").alias("participant_function"), F.col("made.c").alias("function_confidence"))


def speaker_struct(role: Column | None = None) -> Column:
    """a participant as a speaker; the role follows from the function where it is unknown."""
    by_function = F.when(F.col("participant_function").isin("witness", "interviewee"), "witness").when(F.col("participant_function").isin("counsel", "government_counsel"), "attorney").when(F.col("participant_function").isin("interpreter", "court_reporter", "judge", "videographer"), F.col("participant_function")).otherwise("unknown")
    known = F.when(F.col("speaker_role") != "unknown", F.col("speaker_role")).otherwise(by_function)
    return F.struct(F.col("id").alias("participant_id"), F.col("display_label").alias("label"), (known if role is None else role).alias("speaker_role"), F.col("redacted").alias("redacted"))


def primaries(people: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_id, primary_questioner, primary_witness, witnesses (how many have that role); the last of equal ones counts."""
    attorney, witness = F.col("speaker_role") == "attorney", (F.col("speaker_role") == "witness") | F.col("participant_function").isin("witness", "interviewee")
    said = people.withColumn("s", speaker_struct()).withColumn("w", speaker_struct(F.lit("witness")))
    best = said.groupBy("doc_id").agg(
        F.max_by(F.struct("s", "question_observations"), F.when(attorney, F.struct("question_observations", "observations", "first_seen"))).alias("q"), F.sum(attorney.cast("int")).alias("attorneys"),
        F.max_by("w", F.when(witness, F.struct("answer_observations", "observations", "first_seen"))).alias("w"), F.sum((F.col("speaker_role") == "witness").cast("int")).alias("witnesses"),
    )
    answered = rules.groupBy("doc_id").agg(F.sum(F.when(F.col("kind") == "answer", F.col("observations")).otherwise(0)).alias("n"))
    anyone = F.struct(F.lit("witness_1").alias("participant_id"), F.lit("THE WITNESS").alias("label"), F.lit("witness").alias("speaker_role"), F.lit(False).alias("redacted"))
    return answered.join(best, "doc_id", "left").select("doc_id", F.when((F.col("q.question_observations") > 0) | (F.col("attorneys") <= 1), F.col("q.s")).alias("primary_questioner"), F.coalesce("w", F.when(F.col("n") > 0, anyone)).alias("primary_witness"), F.coalesce("witnesses", F.lit(0)).alias("witnesses"))


def layout_summary(pages: DataFrame) -> DataFrame:
    """Counts of pages by section for each document; pages may have the layout's columns, which then count too."""
    names = (*FAMILY, *REFERENCE, "unknown")
    extra = [F.count_if(F.col(c)).alias(f"{n}_pages") for c, n in (("positioned_text_available", "positioned_text"), ("used_positioned_reconstruction", "positioned_reconstructed"), ("requires_ocr", "ocr_required")) if c in pages.columns]
    if "likely_line_number_column_x" in pages.columns:
        extra.append(upper_median(F.when(F.col("section") == "transcript", F.col("likely_line_number_column_x"))).alias("likely_line_number_column_x"))
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), *[F.count_if(F.col("section") == n).alias(f"{n}_pages") for n in names], F.count_if(F.col("section").isin(*REFERENCE)).alias("reference_only_pages"), *extra)


def line_range(said: DataFrame) -> DataFrame:
    """doc_id, typical_line_min, typical_line_max: the commonest least and greatest number of a page, of equally common ones the least and the greatest."""
    numbers = said.filter("number is not null and not header").groupBy("doc_id", "physical_page").agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
    low = numbers.groupBy("doc_id", "lo").count().groupBy("doc_id").agg(F.max_by("lo", F.struct("count", -F.col("lo"))).alias("typical_line_min"))
    high = numbers.groupBy("doc_id", "hi").count().groupBy("doc_id").agg(F.max_by("hi", F.struct("count", "hi")).alias("typical_line_max"))
    return low.join(high, "doc_id")


def gaps(said: DataFrame, contexts: DataFrame) -> DataFrame:
    """doc_id, gap_kind, physical_page, transcript_page, first_missing, last_missing: labels and numbers that were passed over."""
    labels = contexts.filter("section = 'transcript'").withColumn("n", F.col("transcript_page").try_cast("int")).filter("n is not null").withColumn("p", F.lag("n").over(W.partitionBy("doc_id").orderBy("physical_page")))
    by_page = labels.filter("n > p + 1").select("doc_id", F.lit("missing_transcript_pages").alias("gap_kind"), "physical_page", "transcript_page", (F.col("p") + 1).alias("first_missing"), (F.col("n") - 1).alias("last_missing"))
    numbers = said.filter("number is not null and not header").select("doc_id", "physical_page", "transcript_page", "number").distinct().withColumn("p", F.lag("number").over(W.partitionBy("doc_id", "physical_page").orderBy("number")))
    by_line = numbers.filter("number > p + 1").select("doc_id", F.lit("missing_lines").alias("gap_kind"), "physical_page", "transcript_page", (F.col("p") + 1).alias("first_missing"), (F.col("number") - 1).alias("last_missing"))
    return by_page.unionByName(by_line)


def completeness(said: DataFrame, contexts: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, source_completeness: distinct numbers seen over those the page and line ranges lead one to expect; 0.5 where unknown."""
    labels = contexts.filter("section = 'transcript'").groupBy("doc_id").agg((F.max(F.col("transcript_page").try_cast("long")) - F.min(F.col("transcript_page").try_cast("long")) + 1).alias("span"))
    seen = said.filter("number is not null and not header").select("doc_id", "physical_page", "number").distinct().groupBy("doc_id").agg(F.count("*").alias("n"))
    all_ = contexts.select("doc_id").distinct().join(labels, "doc_id", "left").join(seen, "doc_id", "left").join(ranges, "doc_id", "left")
    lines = F.col("typical_line_max") - F.col("typical_line_min") + 1
    return all_.select("doc_id", F.coalesce(F.when(lines >= 1, F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / (F.col("span") * lines))), F.lit(0.5)).alias("source_completeness"))


def redaction_candidates(pages: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """doc_id, physical_page, signal, confidence, rect, note: redaction annotations, dark overlays and rectangles, and marked lines, each distinct line of a page once.

    At most ``most`` of a document, in page order: the operator's own bound. Pages may lack the columns annotations and filled_rectangles.
    """
    out = []
    none = F.lit(None).cast("array<double>")
    if "annotations" in pages.columns:
        a = pages.select("doc_id", "physical_page", F.posexplode("annotations").alias("i", "x")).filter("x.is_explicit_redaction or x.is_dark_overlay_candidate")
        out.append(a.select("doc_id", "physical_page", F.lit(0).alias("rank"), "i", F.when(F.col("x.is_explicit_redaction"), "pdf_redact_annotation").otherwise("dark_annotation_candidate").alias("signal"), F.when(F.col("x.is_explicit_redaction"), "high").otherwise("medium").alias("confidence"), F.col("x.rect").alias("rect"), F.lit("").alias("note")))
    if "filled_rectangles" in pages.columns:
        r = pages.select("doc_id", "physical_page", F.posexplode("filled_rectangles").alias("i", "x")).filter("x.possible_redaction")
        out.append(r.select("doc_id", "physical_page", F.lit(1).alias("rank"), "i", F.lit("dark_filled_rectangle_candidate").alias("signal"), F.lit("low").alias("confidence"), F.col("x.rect").alias("rect"), F.lit("").alias("note")))
    texts = F.concat(lines_of(F.coalesce("text", F.lit(""))), lines_of(F.coalesce("raw_text", F.lit("")))) if "raw_text" in pages.columns else lines_of(F.coalesce("text", F.lit("")))
    told = pages.select("doc_id", "physical_page", F.posexplode(texts).alias("i", "line")).filter(has_redaction(F.col("line")))
    once = told.groupBy("doc_id", "physical_page", ascii_upper(trimmed(F.col("line"))).alias("k")).agg(F.min(F.struct("i", "line")).alias("m"))
    out.append(once.select("doc_id", "physical_page", F.lit(2).alias("rank"), F.col("m.i").alias("i"), F.lit("textual_redaction_marker").alias("signal"), F.lit("high").alias("confidence"), none.alias("rect"), shortened(trimmed(F.col("m.line")), 140).alias("note")))
    both = out[0]
    for o in out[1:]:
        both = both.unionByName(o)
    return both.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("physical_page", "rank", "i"))).filter(F.col("n") <= most).select("doc_id", "physical_page", "signal", "confidence", "rect", "note")


def redaction_summary(pages: DataFrame) -> DataFrame:
    """doc_id and counts of redaction signals, and whether someone must look at the pages."""
    found = redaction_candidates(pages, 1 << 30).groupBy("doc_id").agg(*[F.count_if(F.col("signal") == s).alias(n) for s, n in (("pdf_redact_annotation", "explicit_redaction_annotations"), ("dark_annotation_candidate", "dark_annotation_candidates"), ("dark_filled_rectangle_candidate", "dark_filled_rectangle_candidates"), ("textual_redaction_marker", "textual_redaction_markers"))])
    images = pages.groupBy("doc_id").agg(F.count_if(F.coalesce(F.col("image_count"), F.lit(0)) > 0).alias("pages_with_images") if "image_count" in pages.columns else F.lit(0).cast("long").alias("pages_with_images"))
    both = images.join(found, "doc_id", "left").fillna(0)
    return both.withColumn("requires_visual_confirmation", (F.col("dark_annotation_candidates") > 0) | (F.col("dark_filled_rectangle_candidates") > 0) | (F.col("pages_with_images") > 0))


def fingerprint(lines: DataFrame, rules: DataFrame, contexts: DataFrame) -> DataFrame:
    """doc_id and the conventions of the document's testimony lines."""
    said = lines.filter("section = 'transcript'").select("doc_id", colon_label(F.col("body")).alias("c"), titled_label(F.col("body")).isNotNull().alias("t"), by_label(F.col("body")).isNotNull().alias("b"))
    seen = said.groupBy("doc_id").agg(F.count_if(F.col("c").isNotNull() & (F.col("c.rest") != "")).alias("colons"), F.count_if("t").alias("titles"), F.coalesce(F.bool_or("b"), F.lit(False)).alias("examination_heading_style_detected"), F.coalesce(F.bool_or(is_redacted(F.col("c.label")) & F.col("c").isNotNull()), F.lit(False)).alias("redacted_speaker_labels_detected"))
    labels = contexts.groupBy("doc_id").agg(F.count_if((F.col("section") == "transcript") & F.col("transcript_page").isNotNull()).alias("transcript_page_labels_detected"))
    both = labels.join(seen, "doc_id", "left").join(dominant_markers(rules), "doc_id", "left").fillna(0, ["colons", "titles"]).fillna(False, ["examination_heading_style_detected", "redacted_speaker_labels_detected"])
    return both.select("doc_id", F.col("question").alias("dominant_question_marker"), F.col("answer").alias("dominant_answer_marker"), ((F.col("colons") >= 2) | (F.col("titles") >= 1)).alias("speaker_prefixed_dialogue"), (F.col("colons") >= 2).alias("colon_speaker_prefixed_dialogue"), (F.col("titles") >= 1).alias("titled_speaker_prefixed_dialogue"), "examination_heading_style_detected", "redacted_speaker_labels_detected", "transcript_page_labels_detected")


def language_hint(pages: DataFrame) -> DataFrame:
    """doc_id, code, confidence, dominant_script by counts of letters and six words, over the first 20 pages and 80,000 characters: the operator's own sample."""
    first = pages.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("physical_page"))).filter("n <= 20")
    joined = first.groupBy("doc_id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("physical_page", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n"), 1, 80_000).alias("s"))
    n = lambda p: F.regexp_count("s", F.lit(p))
    counted = joined.select("doc_id", "s", n(r"[A-Za-z\x{00C0}-\x{024F}]").alias("latin"), n(r"[\x{0900}-\x{097F}]").alias("devanagari"), n(r"[\x{0600}-\x{06FF}]").alias("arabic"), n(r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]").alias("cjk"), n(r"\p{L}").alias("letters"))
    hits = sum((ascii_lower(F.col("s")).contains(w).cast("int") for w in (" the ", " and ", " you ", " of ", " to ", " that ")), F.lit(0))
    best = F.greatest(*[F.struct(F.col(k).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(("latin", "devanagari", "arabic", "cjk"))])
    english = (F.floor(F.col("latin") * 100 / F.greatest(F.lit(1), F.col("letters"))) >= 80) & (hits >= 4)
    return counted.select("doc_id", F.when(F.col("letters") == 0, "und").when(english, "en").otherwise("und").alias("code"), F.when(F.col("letters") == 0, 0.1).when(english, 0.92).when(best["n"] > 0, 0.65).otherwise(0.1).alias("confidence"), F.when(F.col("letters") == 0, "unknown").when(english, "latin").otherwise(best["k"]).alias("dominant_script"))


def document_types(pages: DataFrame, rules: DataFrame, people: DataFrame) -> DataFrame:
    """doc_id, document_type by words of the first 4 and 16 pages and how much of a dialogue was seen."""
    ranked = pages.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("physical_page"))).filter("n <= 16").select("doc_id", "n", ascii_lower(F.coalesce("text", F.lit(""))).alias("t"))
    has = lambda w, most=16: F.coalesce(F.bool_or(F.col("t").contains(w) & (F.col("n") <= most)), F.lit(False))
    told = ranked.groupBy("doc_id").agg(*[has(w, m).alias(k) for k, w, m in (("h_iv", "interview of", 4), ("h_ti", "transcribed interview", 4), ("h_dep", "deposition of", 4), ("dep", "deposition", 16), ("depo", "deponent", 16), ("arb", "arbitration", 16), ("arbr", "arbitrator", 16), ("hear", "hearing", 16), ("tt", "trial transcript", 16), ("tp", "trial proceedings", 16), ("court", "the court", 16), ("iv", "interview", 16), ("ex", "examination", 16))])
    signals = rules.groupBy("doc_id").agg(F.sum("observations").alias("m")).join(people.groupBy("doc_id").agg(F.sum("observations").alias("p")), "doc_id", "left").select("doc_id", (F.coalesce("m", F.lit(0)) + F.coalesce("p", F.lit(0))).alias("signals"))
    kind = (
        F.when(F.col("h_iv") | F.col("h_ti"), "interview").when(F.col("h_dep"), "deposition").when(F.col("dep") | F.col("depo"), "deposition").when(F.col("arb") | F.col("arbr"), "arbitration").when(F.col("hear"), "hearing")
        .when(F.col("tt") | F.col("tp") | (F.col("court") & (F.col("signals") >= 4)), "trial_transcript").when(F.col("iv"), "interview").when(F.col("ex") & (F.col("signals") >= 4), "examination").when(F.col("signals") >= 8, "other_transcript").otherwise("unknown")
    )
    return told.join(signals, "doc_id", "left").fillna(0, ["signals"]).select("doc_id", kind.alias("document_type"))


def confidences(people: DataFrame, rules: DataFrame, prints: DataFrame, contexts: DataFrame) -> DataFrame:
    """doc_id, participant_confidence, marker_confidence, page_confidence, format_confidence."""
    roles = people.groupBy("doc_id").agg(F.avg((F.col("speaker_role") != "unknown").cast("double")).alias("share"))
    marks = rules.groupBy("doc_id").agg(F.sum(F.when(F.col("kind") == "question", F.col("observations")).otherwise(0)).alias("q"), F.sum(F.when(F.col("kind") == "answer", F.col("observations")).otherwise(0)).alias("a"))
    labelled = contexts.filter("section = 'transcript'").groupBy("doc_id").agg(F.avg(F.col("transcript_page").isNotNull().cast("double")).alias("pc"))
    both = marks.join(roles, "doc_id", "left").join(prints.select("doc_id", "speaker_prefixed_dialogue"), "doc_id", "left").join(labelled, "doc_id", "left")
    total = F.col("q") + F.col("a")
    person = F.coalesce("share", F.when(total >= 20, 0.6).otherwise(0.3))
    mark = F.when((total >= 40) & (F.col("q") > 0) & (F.col("a") > 0), 1.0).when(total >= 8, 0.82).when(total > 0, 0.6).when(F.col("speaker_prefixed_dialogue"), 0.82).otherwise(0.35)
    page = F.coalesce("pc", F.lit(0.0))
    return both.select("doc_id", person.alias("participant_confidence"), mark.alias("marker_confidence"), page.alias("page_confidence"), (0.3 * person + 0.3 * page + 0.4 * mark).alias("format_confidence"))


def router_flags(confidence: DataFrame, languages: DataFrame, types: DataFrame, layout: DataFrame, redactions: DataFrame) -> DataFrame:
    """doc_id, router_recommended: whether a document should be looked at by other means."""
    both = confidence.join(languages.select("doc_id", "code"), "doc_id", "left").join(types, "doc_id", "left").join(layout, "doc_id", "left").join(redactions.select("doc_id", "requires_visual_confirmation"), "doc_id", "left")
    ocr = F.coalesce(F.col("ocr_required_pages"), F.lit(0)) > 0 if "ocr_required_pages" in layout.columns else F.lit(False)
    return both.select("doc_id", ((F.col("format_confidence") < 0.78) | (F.coalesce("code", F.lit("und")) == "und") | (F.coalesce("document_type", F.lit("unknown")) == "unknown") | ocr | (F.coalesce("unknown_pages", F.lit(0)) > 3) | F.coalesce("requires_visual_confirmation", F.lit(False))).alias("router_recommended"))
