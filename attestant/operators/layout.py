"""Positioned text: boxes, words, rows, gutters, masks.

Fragments: doc_id, physical_page, fragment_id, x_pos, y_pos (greater is higher), width, height, font_size, text, sequence, redaction_masked.
Groups are pages, at most a sheet's fragments; nothing spans pages but the look at neighbouring gutters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestant.functions.marks import leading_number
from attestant.functions.text import squeezed, trimmed, upper_median
from attestant.operators.sections import share_of_successors

#: Tolerances of rows: share of the median font size and its bounds.
ROW_SHARE, LEAST_TOLERANCE, MOST_TOLERANCE, NO_SIZE = 0.18, 0.65, 3.0, 1.5
PAGE = ("doc_id", "physical_page")


def overlap_share(a: Column, b: Column) -> Column:
    """Shared area of two boxes [left, top, right, bottom] over the first one's; 0 for an empty first one."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = (a[2] - a[0]) * (a[3] - a[1])
    return F.when(area > 0, width * height / area).otherwise(0.0)


def union_boxes(c: Column) -> Column:
    """The box around a group's boxes: an aggregate."""
    return F.array(F.min(c[0]), F.min(c[1]), F.max(c[2]), F.max(c[3]))


def is_dark(components: Column, black: float = 0.75, colour: float = 0.35) -> Column:
    """Whether a grey, RGB or CMYK colour is dark; CMYK by its black, the others at most ``colour``."""
    low = F.forall(components, lambda x: x <= 0.12)
    return F.when(F.size(components).isin(1, 3), low).when(F.size(components) == 4, (components[3] >= black) & F.forall(F.slice(components, 1, 3), lambda x: x <= colour)).otherwise(False)


def rectangle_signals(rectangles: DataFrame, most: int = 250) -> DataFrame:
    """Filled rectangles (rect x, y, w, h; color_components; place) of at least 2 by 2, at most ``most`` a page, with is_dark and possible_redaction."""
    w, h = F.col("rect")[2], F.col("rect")[3]
    kept = rectangles.filter((w >= 2) & (h >= 2)).withColumn("n", F.row_number().over(W.partitionBy(*PAGE).orderBy("place"))).filter(F.col("n") <= most).drop("n")
    return kept.withColumn("is_dark", is_dark(F.col("color_components"))).withColumn("possible_redaction", F.col("is_dark") & w.between(18, 520) & h.between(4, 36))


def annotation_signals(annotations: DataFrame) -> DataFrame:
    """Annotations with is_explicit_redaction and is_dark_overlay_candidate."""
    kind = F.lower("subtype")
    return annotations.withColumn("is_explicit_redaction", kind == "redact").withColumn("is_dark_overlay_candidate", kind.isin("square", "highlight", "polygon", "redact") & is_dark(F.col("color_components")))


def estimated_width(text: Column, size: Column) -> Column:
    """Width of a text by kinds of letters, in the font's size; at least a fifth of it."""
    kinds = (F.regexp_count(text, F.lit(r"[\s\p{Z}]")), 0.33), (F.regexp_count(text, F.lit(r"[ilIj.,:;!'|]")), 0.28), (F.regexp_count(text, F.lit("[MWmw@%]")), 0.82)
    known = sum((n for n, _ in kinds), F.lit(0))
    return F.greatest(0.2 * size, size * (sum((n * w for n, w in kinds), F.lit(0.0)) + 0.54 * (F.char_length(text) - known)))


def affine(m: Column, x: Column, y: Column) -> Column:
    """A point under a matrix [a, b, c, d, e, f]."""
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def combined(m: Column, n: Column) -> Column:
    """The matrix that does m, then n."""
    return F.array(m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def needs_ocr(clean: Column, images: Column, bad: Column, image_share: Column, tilted: Column, glyphs: Column) -> Column:
    """Whether a page's own text won't do: almost none beside images, too many bad or tilted glyphs, or a page that is mostly an image."""
    return ((clean < 30) & images) | (bad > F.greatest(F.lit(5.0), 0.03 * glyphs)) | ((image_share > 0.35) & (clean < 500)) | (tilted > F.greatest(F.lit(5.0), 0.25 * glyphs))


def row_tolerance(fragments: DataFrame) -> DataFrame:
    """doc_id, physical_page, tolerance."""
    size = F.when((F.col("font_size") > 0.1) & ~F.isnan("font_size"), F.col("font_size"))
    median = upper_median(size)
    return fragments.groupBy(*PAGE).agg(F.coalesce(F.greatest(F.lit(LEAST_TOLERANCE), F.least(F.lit(MOST_TOLERANCE), ROW_SHARE * median)), F.lit(NO_SIZE)).alias("tolerance"))


def masked(fragments: DataFrame, masks: DataFrame, margin: float = 1.5) -> DataFrame:
    """Fragments whose middle lies in a mask of their page, at the base line or at 35 % of their height. masks: doc_id, physical_page, rect [left, low, right, high].

    An equal join on the page, then the test; a page's masks are few.
    """
    x = F.col("x_pos") + F.col("width") / 2
    hit = lambda y: (x >= F.col("rect")[0] - margin) & (x <= F.col("rect")[2] + margin) & (y >= F.col("rect")[1] - margin) & (y <= F.col("rect")[3] + margin)
    found = fragments.join(masks, list(PAGE)).filter(hit(F.col("y_pos")) | hit(F.col("y_pos") + 0.35 * F.coalesce("font_size", "height"))).select(*PAGE, "fragment_id").distinct().withColumn("hidden", F.lit(True))
    both = fragments.join(found, [*PAGE, "fragment_id"], "left")
    return both.withColumn("redaction_masked", F.coalesce("hidden", "redaction_masked", F.lit(False))).withColumn("text", F.when(F.col("hidden"), "[REDACTED]").otherwise(F.col("text"))).drop("hidden")


def by_page(frame: DataFrame, columns: list[str], fold, schema: str) -> DataFrame:
    """Maps each page's rows (of ``columns`` after the page's key) by ``fold``, which gives tuples; pages come one after another, each whole."""
    types = [f.dataType for f in _schema_of(schema).fields]
    arrow = [_ARROW[t.simpleString()] for t in types]
    names = [f.name for f in _schema_of(schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], names)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:2] != key:
                    if held:
                        out += [(*key, *x) for x in fold(held)]
                    key, held = r[:2], []
                held.append(r[2:])
            if len(out) > 5000:
                yield made()
                out = []
        if held:
            out += [(*key, *x) for x in fold(held)]
        if out:
            yield made()

    return frame.select(*PAGE, *columns).repartition(*PAGE).sortWithinPartitions(*PAGE).mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}


def _schema_of(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def _words(glyphs: list[tuple]) -> list[tuple]:
    """L02 for one page's glyphs (text, x, y, width, height, size, sequence): (line_no, word_no, text, x_pos, right_x, y_pos)."""
    full = sorted(g[4] for g in glyphs if g[0] and g[0].strip() and g[4] is not None)
    middle = (full[(len(full) - 1) // 2] + full[len(full) // 2]) / 2 if full else 0.0
    tolerance = max(0.8, min(3.0, 0.24 * middle))
    lines: list[tuple[float, list]] = []
    for g in sorted((g for g in glyphs if g[0] and g[1] is not None and g[2] is not None), key=lambda g: (-g[2], g[1], g[6] or 0)):
        near = [(abs(g[2] - y), k) for k, (y, _) in enumerate(lines[-5:], max(0, len(lines) - 5)) if abs(g[2] - y) <= tolerance]
        if near:
            lines[min(near)[1]][1].append(g)
        else:
            lines.append((g[2], [g]))
    out = []
    for n, (y, own) in enumerate(lines, 1):
        found: list[list[tuple]] = [[]]
        for g in sorted(own, key=lambda g: g[1]):
            last = found[-1][-1] if found[-1] else None
            if g[0].isspace():
                found.append([])
            elif last is None:
                found[-1].append(g)
            elif g[1] - (last[1] + (last[3] or 0.0)) > max(0.7, 0.22 * (10.0 if g[5] is None else g[5])):
                found.append([g])
            elif not (g[0] == last[0] and abs(g[1] - last[1]) < 0.15 and abs(g[2] - last[2]) < 0.15):
                found[-1].append(g)
        for k, w in enumerate((w for w in found if w), 1):
            out.append((n, k, "".join(g[0] for g in w), min(g[1] for g in w), max(g[1] + (g[3] or 0.0) for g in w), y))
    return out


def words(glyphs: DataFrame) -> DataFrame:
    """Glyphs (text, x_pos, y_pos, width, height, font_size, sequence) into words: doc_id, physical_page, line_no, word_no, text, x_pos, right_x, y_pos.

    A glyph goes to the nearest of the last five base lines within 0.24 of the page's median height (0.8 to 3), else it begins one; blanks
    and gaps of more than 0.22 of the size (0.7 at least) part words; a glyph printed twice on a spot counts once. Glyphs without a place are left out.
    """
    return by_page(glyphs, ["text", "x_pos", "y_pos", "width", "height", "font_size", "sequence"], _words, "doc_id string, physical_page int, line_no int, word_no int, text string, x_pos double, right_x double, y_pos double")


def _columns(pieces: list[tuple]) -> list[tuple]:
    """L04 for one page's numbers (number, right edge, height on the page, fragment_id): (column_no, fragment_id)."""
    columns: list[list[tuple]] = []
    for p in sorted(pieces, key=lambda p: (p[1], -p[2], p[3])):
        if columns:
            edges = [x[1] for x in columns[-1]]  # in order, as they were added
            if abs(p[1] - (edges[(len(edges) - 1) // 2] + edges[len(edges) // 2]) / 2) <= 7:
                columns[-1].append(p)
                continue
        columns.append([p])
    out = []
    for k, own in enumerate(columns, 1):
        own.sort(key=lambda p: -p[2])
        numbers = [p[0] for p in own]
        steps = sum(0 < b - a <= 3 or b <= 3 and a >= 8 for a, b in zip(numbers, numbers[1:], strict=False))
        if len(set(numbers)) >= 4 and steps / max(1, len(numbers) - 1) >= 0.65 and max(numbers) - min(numbers) >= 3:
            out += [(k, p[3]) for p in own]
    return out


def gutter_columns(pieces: DataFrame) -> DataFrame:
    """doc_id, physical_page, column_no, fragment_id of the numbers 1..100 that stand in a column of printed line numbers.

    Numbers are clustered by right edges at most 7 from a cluster's median; a column has four different ones over three apart, of which 65 %
    grow by at most three or begin anew.
    """
    number = trimmed(F.col("text"))
    numbers = pieces.filter(number.rlike("^[0-9]{1,3}$") & F.col("x_pos").isNotNull() & F.col("y_pos").isNotNull()).withColumn("number", number.cast("int")).withColumn("edge", F.col("x_pos") + F.coalesce("width", F.lit(0.0))).filter("number between 1 and 100")
    return by_page(numbers, ["number", "edge", "y_pos", "fragment_id"], _columns, "doc_id string, physical_page int, column_no int, fragment_id string")


def masked_by_overlap(pieces: DataFrame, masks: DataFrame, least: float = 0.25) -> DataFrame:
    """Pieces of whose box more than ``least`` lies in a mask are left out, and each mask is a word [REDACTED]: doc_id, physical_page, text, x_pos, y_pos, width, height, masked.

    masks: doc_id, physical_page, rect [left, low, right, high]. An equal join on the page; a page's masks are few.
    """
    box = F.array("x_pos", "y_pos", F.col("x_pos") + F.col("width"), F.col("y_pos") + F.col("height"))
    given = masks.groupBy(*PAGE).agg(F.collect_set("rect").alias("rects"))
    kept = pieces.join(given, list(PAGE), "left").filter(~F.coalesce(F.exists("rects", lambda m: overlap_share(box, m) > least), F.lit(False))).select(*PAGE, "text", "x_pos", "y_pos", "width", "height", F.lit(False).alias("masked"))
    r = F.col("rect")
    hidden = masks.select(*PAGE, "rect").distinct().select(*PAGE, F.lit("[REDACTED]").alias("text"), r[0].alias("x_pos"), r[1].alias("y_pos"), (r[2] - r[0]).alias("width"), (r[3] - r[1]).alias("height"), F.lit(True).alias("masked"))
    return kept.unionByName(hidden)


def anchored_rows(pieces: DataFrame) -> DataFrame:
    """Pieces with row_no: sorted by their middle, a piece joins the row before it if it is near that row's first piece.

    The tolerance is 0.3 of the page's median size, 1 to 3.5. A fold over the page's pieces, since each is measured against an anchor.
    """
    middle = F.col("y_pos") + F.col("height") / 2
    sized = pieces.groupBy(*PAGE).agg(F.greatest(F.lit(1.0), F.least(F.lit(3.5), 0.3 * F.median("font_size"))).alias("tol"), F.array_sort(F.collect_list(F.struct((-middle).alias("m"), "x_pos", "sequence", "fragment_id"))).alias("ps"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("n"), F.array().cast("array<struct<fragment_id:string,row_no:int>>").alias("done"))

    def step(acc: Column, p: Column) -> Column:
        joins = F.coalesce(F.abs(p["m"] - acc["anchor"]) <= F.col("tol"), F.lit(False))
        n = F.when(joins, acc["n"]).otherwise(acc["n"] + 1)
        return F.struct(F.when(joins, acc["anchor"]).otherwise(p["m"]).alias("anchor"), n.alias("n"), F.array_append(acc["done"], F.struct(p["fragment_id"].alias("fragment_id"), n.alias("row_no"))).alias("done"))

    return sized.select(*PAGE, F.inline(F.aggregate("ps", start, step, lambda acc: acc["done"])))


_ROWS = pa.schema([("doc_id", pa.string()), ("physical_page", pa.int32()), ("fragment_id", pa.string()), ("row_no", pa.int32()), ("place", pa.int32())])


def visual_rows(fragments: DataFrame) -> DataFrame:
    """doc_id, physical_page, fragment_id, row_no, place: rows by nearest mean height, which moves with each fragment it takes.

    Fragments without a height are left out. The mean moves with every step, so a page's fragments are folded one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def rows() -> list[tuple]:
            tolerance = held[0][5]
            groups: list[list] = []
            for r in sorted(held, key=lambda r: (-r[3], r[2] if r[2] is not None else 0.0, r[4] or 0)):
                near = min((g for g in groups if abs(g[0] - r[3]) <= tolerance), key=lambda g: abs(g[0] - r[3]), default=None)
                if near is None:
                    groups.append([r[3], [r]])
                else:
                    near[1].append(r)
                    near[0] = sum(x[3] for x in near[1]) / len(near[1])
            out = []
            for n, (_, own) in enumerate(sorted(groups, key=lambda g: -g[0])):
                out += [(*key, r[1], n, i) for i, r in enumerate(sorted(own, key=lambda r: (r[2] if r[2] is not None else 0.0, r[4] or 0)))]
            return out

        for b in batches:
            made: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:2] != key:
                    if held:
                        made += rows()
                    key, held = r[:2], []
                held.append((None, *r[2:]))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), _ROWS.types, strict=True)], schema=_ROWS)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows(), strict=True), _ROWS.types, strict=True)], schema=_ROWS)

    told = fragments.filter("y_pos is not null").join(row_tolerance(fragments).hint("merge"), list(PAGE)).select(*PAGE, "fragment_id", "x_pos", "y_pos", "sequence", "tolerance")
    return told.repartition(*PAGE).sortWithinPartitions(*PAGE).mapInArrow(run, "doc_id string, physical_page int, fragment_id string, row_no int, place int")


def joined_text(fragments: Column) -> Column:
    """A row's text from its fragments in order (text, x_pos, width, font_size, redaction_masked).

    A blank stands where the gap is more than a tenth of the size, or between two words that don't overlap by three tenths; none before
    closing punctuation; masks beside each other count once.
    """
    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("double").alias("right"), F.lit(10.0).alias("size"), F.lit(False).alias("word"), F.lit(False).alias("masked"))

    def step(acc: Column, f: Column) -> Column:
        text, size = trimmed(f["text"]), F.greatest(F.lit(1.0), F.coalesce(f["font_size"], F.lit(10.0)))
        gap = f["x_pos"] - acc["right"]
        space = acc["right"].isNotNull() & ((gap > 0.1 * acc["size"]) | (acc["word"] & text.rlike(r"^[\p{L}\p{N}]") & (gap > -0.3 * acc["size"]))) & ~text.rlike(r"^[.,;:?!)\]}]")
        skip = (text == "") | (f["redaction_masked"] & acc["masked"])
        nxt = F.struct(F.concat(acc["out"], F.when(F.coalesce(space, F.lit(False)), " ").otherwise(""), text).alias("out"), (f["x_pos"] + f["width"]).alias("right"), size.alias("size"), text.rlike(r"[\p{L}\p{N}]$").alias("word"), F.coalesce(f["redaction_masked"], F.lit(False)).alias("masked"))
        return F.when(F.coalesce(skip, F.lit(False)), acc).otherwise(nxt)

    return squeezed(F.aggregate(fragments, start, step, lambda acc: acc["out"]))


def row_texts(fragments: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, physical_page, row_no, text, left_x, line_number of the visual rows."""
    own = rows.hint("merge").join(fragments, [*PAGE, "fragment_id"]).select(*PAGE, "row_no", F.struct("place", "text", "x_pos", "width", "font_size", F.coalesce("redaction_masked", F.lit(False)).alias("redaction_masked")).alias("f"))
    grouped = own.groupBy(*PAGE, "row_no").agg(F.array_sort(F.collect_list("f")).alias("fs")).withColumn("text", joined_text(F.col("fs"))).filter("text <> ''")
    return grouped.select(*PAGE, "row_no", "text", F.element_at("fs", 1)["x_pos"].alias("left_x"), leading_number(F.col("text")).alias("line_number"))


def gutters(texts: DataFrame) -> DataFrame:
    """doc_id, physical_page, gutter_x: the middle left edge of rows that begin with numbers, where these are a printed column.

    Five numbers or more, beginning by 6, over 5 apart, of which 62 % grow by at most 4.
    """
    numbered = texts.filter("line_number is not null").groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line_number"))), lambda x: x["line_number"]).alias("ns"), upper_median(F.col("left_x")).alias("x"))
    sound = (F.size("ns") >= 5) & (F.array_min("ns") <= 6) & (F.array_max("ns") - F.array_min("ns") >= 5) & (share_of_successors(F.col("ns"), 4) >= 0.62)
    return numbered.select(*PAGE, F.when(sound, F.col("x")).alias("gutter_x"), F.when(F.size("ns") >= 4, F.col("x")).alias("likely_x"), share_of_successors(F.col("ns"), 4).alias("tolerant_sequence"), F.size("ns").alias("numbered_rows"))


def number_columns(fragments: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns of lone numbers 1..50 within 12 of a number's left edge: doc_id, physical_page, x, score; the best of a page counts.

    Scored by sequence .55, coverage .20, nearness to an edge .15 and range .10; numbers of a page are few, so each is tried as a seed.
    """
    placed = rows.join(fragments, [*PAGE, "fragment_id"])
    extent = placed.groupBy(*PAGE).agg(F.min("x_pos").alias("lo"), F.max(F.col("x_pos") + F.greatest(F.lit(0.0), F.col("width"))).alias("hi"), F.countDistinct("row_no").alias("rows"))
    lone = placed.filter(trimmed(F.col("text")).rlike("^[0-9]{1,2}$")).select(*PAGE, "row_no", "x_pos", trimmed(F.col("text")).cast("int").alias("n")).filter("n between 1 and 50")
    near = lone.select(*PAGE, F.col("x_pos").alias("seed")).distinct().join(lone, list(PAGE)).filter(F.abs(F.col("x_pos") - F.col("seed")) <= 12)
    first = near.groupBy(*PAGE, "seed", "row_no").agg(F.min_by(F.struct("n", "x_pos"), "x_pos").alias("c"))
    columns = first.groupBy(*PAGE, "seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "c.n"))), lambda x: x["n"]).alias("ns"), upper_median(F.col("c.x_pos")).alias("x"))
    spread = F.array_max("ns") - F.array_min("ns")
    sequence = share_of_successors(F.col("ns"), 4)
    sound = (F.size(F.array_distinct("ns")) >= 5) & (F.array_min("ns") <= 6) & (spread >= 5) & (sequence >= 0.62)
    scored = columns.filter(sound).join(extent, list(PAGE))
    width = F.greatest(F.lit(1.0), F.col("hi") - F.col("lo"))
    edge = F.greatest(F.lit(0.0), 1 - F.least(F.abs(F.col("x") - F.col("lo")), F.abs(F.col("hi") - F.col("x"))) / (width / 2))
    score = 0.55 * sequence + 0.2 * F.least(F.lit(1.0), F.size("ns") / F.col("rows")) + 0.15 * edge + 0.1 * F.least(F.lit(1.0), spread / 20)
    return scored.withColumn("score", score).groupBy(*PAGE).agg(F.max_by("x", F.struct("score", -F.col("seed"))).alias("x"), F.max("score").alias("score"))


def inherited_gutters(pages: DataFrame) -> DataFrame:
    """Pages (numbered_rows, column_count, first_x, first_is_number, gutter_x) with the gutter of their neighbours where they have too few numbers.

    The median of pages within two that have eight numbered rows and one column, if the page's first number stands within 8 of it.
    """
    around = W.partitionBy("doc_id").orderBy("physical_page").rangeBetween(-2, 2)
    strong = F.when((F.col("numbered_rows") >= 8) & (F.coalesce("column_count", F.lit(1)) == 1), F.col("gutter_x"))
    told = pages.withColumn("near", F.collect_list(strong).over(around))
    middle = F.try_element_at(F.array_sort("near"), (F.size("near") / 2).cast("int") + 1)
    adopts = (F.coalesce("numbered_rows", F.lit(0)) < 8) & F.col("first_is_number") & (F.abs(F.col("first_x") - middle) <= 8)
    return told.withColumn("gutter_x", F.when(F.coalesce(adopts, F.lit(False)), middle).otherwise(F.col("gutter_x"))).drop("near")


def two_columns(texts: DataFrame, fragments: DataFrame, rows: DataFrame, gap_share: float = 0.08, least: int = 4) -> DataFrame:
    """doc_id, physical_page, split_x: where at least ``least`` rows have text on both sides of a gap as wide as ``gap_share`` of the page.

    The split is the middle of the commonest such gap, by tens of a point.
    """
    placed = rows.hint("merge").join(fragments, [*PAGE, "fragment_id"])
    extent = placed.groupBy(*PAGE).agg((F.max(F.col("x_pos") + F.col("width")) - F.min("x_pos")).alias("w"))
    order = W.partitionBy(*PAGE, "row_no").orderBy("x_pos")
    gaps = placed.withColumn("left", F.lag(F.col("x_pos") + F.col("width")).over(order)).filter("left is not null").join(extent.hint("merge"), list(PAGE)).filter(F.col("x_pos") - F.col("left") >= gap_share * F.col("w"))
    cut = gaps.withColumn("bin", F.floor((F.col("x_pos") + F.col("left")) / 20)).groupBy(*PAGE, "bin").agg(F.countDistinct("row_no").alias("n"), F.avg((F.col("x_pos") + F.col("left")) / 2).alias("split_x")).filter(F.col("n") >= least)
    return cut.groupBy(*PAGE).agg(F.max_by("split_x", F.struct("n", -F.col("bin"))).alias("split_x"))


def reading_order(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows (row_no, left_x) with pane and reading_no: left pane first, each from top to bottom."""
    told = rows.join(splits.hint("merge"), list(PAGE), "left").withColumn("pane", F.when(F.col("left_x") >= F.col("split_x"), 1).otherwise(0))
    return told.withColumn("reading_no", F.row_number().over(W.partitionBy(*PAGE).orderBy("pane", "row_no"))).drop("split_x")


def reconstruction_confidence(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, physical_page, reconstruction_confidence: share of the page's letters found again .6, rows .2, rows with text .2."""
    letters = lambda c: F.char_length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    found = texts.groupBy(*PAGE).agg(F.sum(letters(F.col("text"))).alias("n"), F.count("*").alias("rows"), F.avg((trimmed(F.col("text")) != "").cast("double")).alias("full"))
    both = found.join(pages.select(*PAGE, letters(F.coalesce("text", F.lit(""))).alias("m")).hint("merge"), list(PAGE), "left")
    cover = F.when(F.coalesce("m", F.lit(0)) == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("n") / F.col("m")))
    return both.select(*PAGE, F.when(F.col("n") > 0, F.least(F.lit(1.0), 0.6 * cover + 0.2 * F.least(F.lit(1.0), F.col("rows") / 8) + 0.2 * F.col("full"))).otherwise(0.0).alias("reconstruction_confidence"))
