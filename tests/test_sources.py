"""Text files, pages, PDF fragments, the stream."""

import zlib

from attestant.operators import layout
from attestant.sources import pdf, text
from attestant.streaming import ingest


def _files(spark, **contents):
    return spark.createDataFrame([(n, n.replace("__", "."), bytearray(b), "") for n, b in contents.items()], "doc_id string, filename string, content binary, source_sha256 string")


def test_decoding(spark):
    got = {r["doc_id"]: (r["text"], r["error"]) for r in text.decoded(_files(spark, a__txt="héllo".encode(), b__txt=b"\xef\xbb\xbfbom", c__txt="wide".encode("utf-16"), d__txt="big".encode("utf-16-be").join([b"\xfe\xff", b""]), e__txt=b"\xff\xfeodd", f__txt=b"bad \xc3", g__pdf=b"no pdf", h__doc=b"x", i__TXT=b"")).collect()}
    assert got["a__txt"] == ("héllo", None) and got["b__txt"] == ("bom", None) and got["c__txt"] == ("wide", None) and got["d__txt"] == ("big", None)
    assert got["e__txt"][1] == got["f__txt"][1] == "invalid_encoding" and got["g__pdf"][1] == "not_a_pdf" and got["h__doc"][1] == "unsupported_file_type" and got["i__TXT"] == ("", None)


def test_too_large_files_have_an_error_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "MAX_BYTES", 10)
    (tmp_path / "a.txt").write_bytes(b"short")
    (tmp_path / "b.txt").write_bytes(b"longer than that")
    got = {r["filename"]: (r["text"], r["error"], r["length"]) for r in text.decoded(text.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": ("short", None, 5), "b.txt": (None, "file_too_large", 16)}


def test_page_lines_in_any_form(spark):
    docs = [("x", "cover\n\n  page  +12 \t\na\n\nPAGE 3\nb\n\n"), ("y", "PAGE 1"), ("z", "a PAGE 1\nPAGE x\n")]
    got = sorted(tuple(r) for r in text.pages_of(spark.createDataFrame(docs, "doc_id string, text string")).collect())
    assert got == [("x", 1, "cover\n"), ("x", 2, "  page  +12 \t\na\n"), ("x", 3, "PAGE 3\nb\n"), ("y", 1, "PAGE 1"), ("z", 1, "a PAGE 1\nPAGE x")]


def test_pages(spark):
    docs = [("feed", "one\fsecond\n\f\f\n"), ("marks", "\n\nPAGE 7\na\nb\nPAGE 8\nc"), ("intro", "cover\nPAGE 1\nx"), ("plain", "a\nb"), ("null", None), ("blank", "")]
    got = {}
    for r in text.pages_of(spark.createDataFrame(docs, "doc_id string, text string")).orderBy("doc_id", "physical_page").collect():
        got.setdefault(r["doc_id"], []).append((r["physical_page"], r["text"]))
    assert got == {"feed": [(1, "one"), (2, "second\n"), (3, "")], "marks": [(1, "PAGE 7\na\nb"), (2, "PAGE 8\nc")], "intro": [(1, "cover"), (2, "PAGE 1\nx")], "plain": [(1, "a\nb")]}


def test_lone_numbers_join(spark):
    df = spark.createDataFrame([(["12", "Q. When?", "13", "14", "x", "15Q. Where?", "51", "y", "7"],)], "lines array<string>")
    assert df.select(text.joined_numbers(df.lines).alias("l")).first()["l"] == ["12 Q. When?", "13 14", "x", "15 Q. Where?", "51", "y", "7"]


def _pdf(*contents):
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(contents)))
    out = [b"%PDF-1.4", b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", f"2 0 obj << /Type /Pages /Kids [{kids}] >> endobj".encode(), b"3 0 obj << /Title (A \\(b\\)) /Author () >> endobj"]
    for i, c in enumerate(contents):
        z = zlib.compress(c)
        out += [f"{10 + 2 * i} 0 obj << /Type /Page /Contents {11 + 2 * i} 0 R >> endobj".encode(), f"{11 + 2 * i} 0 obj << /Filter /FlateDecode >> stream\n".encode() + z + b"\nendstream endobj"]
    return b"\n".join([*out, b"trailer << /Root 1 0 R /Info 3 0 R >>"])


def _lines(*rows):
    return b"BT /F1 12 Tf " + b" ".join(f"1 0 0 1 {x} {y} Tm ({t}) Tj".encode() for x, y, t in rows) + b" ET"


def test_pdf_fragments_to_rows(spark, tmp_path):
    rows = [(72, 700 - 18 * i, str(i + 1)) for i in range(8)] + [(100, 700 - 18 * i, f"{'Q' if i % 2 == 0 else 'A'}. Line {i + 1}") for i in range(8)]
    (tmp_path / "a.pdf").write_bytes(_pdf(_lines(*rows), _lines((72, 500, "x"))))
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    pdf.register(spark)
    got = spark.read.format("pdf_fragments").load(f"{tmp_path}/*.pdf").cache()
    assert [r["error"] for r in got.filter("error is not null").collect()] == ["not_a_pdf"]
    pieces = got.filter("error is null")
    texts = layout.row_texts(pieces, layout.visual_rows(pieces)).filter("physical_page = 1").orderBy("row_no").collect()
    assert [(t["line_number"], t["text"]) for t in texts] == [(i + 1, f"{i + 1} {'Q' if i % 2 == 0 else 'A'}. Line {i + 1}") for i in range(8)]
    assert layout.gutters(layout.row_texts(pieces, layout.visual_rows(pieces))).filter("gutter_x = 72").count() == 1
    assert pdf.metadata(_pdf(b"")) == {"Title": "A (b)"}


def test_text_operators():
    got = [(t, round(x), round(y)) for t, x, y, *_ in pdf.fragments(b"q 2 0 0 2 10 20 cm BT /F 10 Tf 5 TL 1 0 0 1 3 4 Tm (a) Tj T* (b) ' 2 -3 Td [(c) -300 (d)] TJ ET Q BT (e) Tj ET")]
    assert got == [("a", 16, 28), ("b", 16, 8), ("c d", 20, 2), ("e", 0, 0)]


def test_file_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/t.txt").write_text("PAGE 1\n1 Q. Where?\n2 A. There.\n3 Q. Who?\n4 A. I.\n")
    (tmp_path / "in/u.txt").write_bytes(b"\xff\xfex")
    ingest.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/exchanges").count() == 2 and spark.read.parquet(f"{tmp_path}/out/errors").count() == 1


def test_pdf_files_in_the_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(_pdf(_lines((72, 700, "1"), (100, 700, "Q. Where were you?"), (72, 682, "2"), (100, 682, "A. In the yard."))))
    (tmp_path / "in/b.pdf").write_bytes(_pdf(_lines((72, 700, "1"), (100, 700, "Q. Who was there?"), (72, 682, "2"), (100, 682, "A. Nobody.")), b""))
    (tmp_path / "in/c.pdf").write_bytes(b"%PDF-1.4 and nothing")
    (tmp_path / "in/t.txt").write_text("1 Q. When?\n2 A. Then.\n")
    ingest.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    lines = {(r["doc_id"][-5:], r["text"]) for r in spark.read.parquet(f"{tmp_path}/out/lines").collect()}
    assert lines >= {("a.pdf", "Where were you?"), ("a.pdf", "In the yard."), ("b.pdf", "Who was there?"), ("t.txt", "Then.")}
    assert {d for d, _ in lines} == {"a.pdf", "b.pdf", "t.txt"}
    assert {(r["filename"], r["error"]) for r in spark.read.parquet(f"{tmp_path}/out/errors").collect()} == {("b.pdf", "no_text_layer"), ("c.pdf", "no_pages")}


def test_pdf_to_transcript(spark, tmp_path):
    from attestant.plans.positioned import pages_of_fragments
    from attestant.plans.transcript import Transcripts

    rows = [(72, 700, "1"), (100, 700, "Q. Where were you?"), (72, 682, "2"), (100, 682, "A. In the yard."), (72, 664, "3"), (100, 664, "Q. With whom?"), (72, 646, "4"), (100, 646, "A. Nobody.")]
    (tmp_path / "a.pdf").write_bytes(_pdf(_lines(*rows)))
    pdf.register(spark)
    pages = pages_of_fragments(spark.read.format("pdf_fragments").load(f"{tmp_path}/*.pdf").filter("error is null"))
    assert pages.first()["text"].split("\n")[1] == "2 A. In the yard." and pages.first()["column_count"] == 1
    assert [r["kind"] for r in Transcripts(pages).blocks.orderBy("block_no").collect()] == ["question", "answer", "question", "answer"]


def test_repeated_top_margin_is_furniture_and_formats_are_told(spark):
    from attestant.plans.transcript import Transcripts

    pages = spark.createDataFrame([("d", p, f"Smith v. Jones\n1 Q. Where were you on day {p}?\n2 A. Here.", "pdf", "transcript") for p in (1, 2, 3)], "doc_id string, physical_page int, text string, kind string, section string")
    boxes = spark.createDataFrame([("d", p, k, [72.0, 30.0 + 30 * k, 300.0, 40.0 + 30 * k]) for p in (1, 2, 3) for k in range(3)], "doc_id string, physical_page int, row_index int, bbox array<double>")
    t = Transcripts(pages, boxes=boxes)
    assert {r["disposition"] for r in t.source_rows.filter("row_index = 0").collect()} == {"page_furniture"} and t.lines.count() == 6
    assert Transcripts(pages).lines.count() == 9
    told = t.format_prints.first()
    assert (told["dominant_question_marker"], told["dominant_answer_marker"], told["speaker_prefixed_dialogue"]) == ("Q.", "A.", False)
    assert t.format_confidence.first()["marker_confidence"] == 0.6 and t.router.first()["router_recommended"]


def test_unreadable_glyphs_and_two_columns_are_told(spark):
    from attestant.plans.positioned import pages_of_fragments

    ddl = "doc_id string, physical_page int, fragment_id string, sequence long, text string, x_pos double, y_pos double, width double, height double, font_size double, redaction_masked boolean"
    bad = [("d", 1, f"a{k}", k, "(cid:7)(cid:9) x", 72.0, 700.0 - 20 * k, 90.0, 12.0, 12.0, False) for k in range(4)]
    two = [("d", 2, f"{c}{k}", 2 * k + c, "words stand here", 72.0 + 260 * c, 700.0 - 20 * k, 90.0, 12.0, 12.0, False) for k in range(5) for c in (0, 1)]
    got = {r["physical_page"]: (r["requires_ocr"], r["reading_order_uncertain"], r["column_count"]) for r in pages_of_fragments(spark.createDataFrame(bad + two, ddl)).collect()}
    assert got[1][0] and not got[2][0] and not got[1][1]


def test_positioned_pages_fold_rows_once_and_broadcast_nothing(spark, monkeypatch):
    from attestant.plans import positioned

    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(positioned, "cut_lineage", lambda df, cut=positioned.cut_lineage: plans.append(plan(df)) or cut(df))
    ddl = "doc_id string, physical_page int, fragment_id string, sequence long, text string, x_pos double, y_pos double, width double, height double, font_size double, redaction_masked boolean"
    pieces = [("d", p, f"{c}{k}", 2 * k + c, f"{'left right'.split()[c]} {k}", 72.0 + 260 * c, 700.0 - 20 * k, 90.0, 12.0, 12.0, False) for p in (1, 2) for k in range(5) for c in (0, 1)]
    texts = spark.createDataFrame([("d", 1, "left 0")], "doc_id string, physical_page int, text string")
    made = positioned.pages_of_fragments(spark.createDataFrame(pieces, ddl), texts=texts)
    plans.append(plan(made))
    assert not any("Broadcast" in p for p in plans)
    assert sum("aggregate(fs" in p for p in plans) == 1 and "aggregate(fs" not in plans[-1]
    rebuilt = "\n".join(f"left {k} right {k}" for k in range(5))
    assert [(r["physical_page"], r["text"], r["fragment_count"]) for r in made.orderBy("physical_page").collect()] == [(1, rebuilt, 10), (2, rebuilt, 10)]

def test_bare_mark_needs_a_gap(spark):
    from attestant.plans.transcript import Transcripts

    pages = spark.createDataFrame([("d", 1, "1 Q. Where?\n2 A. Here.\n3 A product.\n4 A     Yes.", "pdf", "transcript")], "doc_id string, physical_page int, text string, kind string, section string")
    ddl = "doc_id string, physical_page int, row_index int, sequence long, text string, x_pos double, width double, font_size double"
    pieces = [("d", 1, 2, 0, "A", 72.0, 7.0, 12.0), ("d", 1, 2, 1, "product.", 82.0, 40.0, 12.0), ("d", 1, 3, 0, "A", 72.0, 7.0, 12.0), ("d", 1, 3, 1, "Yes.", 100.0, 20.0, 12.0)]
    lines = Transcripts(pages, fragments=spark.createDataFrame(pieces, ddl)).lines.orderBy("row_index").collect()
    assert [(r["text"], r["starts_new_block"]) for r in lines] == [("Where?", True), ("Here.", True), ("A product.", False), ("Yes.", True)]
