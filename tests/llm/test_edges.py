"""Every query over empty tables, over rows of nulls, over repeated rows and over tables with further columns."""

import pytest
from tables import SCHEMAS, row, transcript, write

from attestant.llm import queries as Q

QUERIES = Q.queries()


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"))


@pytest.fixture(scope="module")
def nulls(spark, tmp_path_factory):
    """One row of nothing but nulls, and rows with keys but nothing else; further columns with clashing names."""
    rows = {name: [{}, {"doc_id": 1 if name == "documents" else "d", "id": "p1_r1", "source_row_id": "p1_r1", "fragment_id": "f", "participant_key": 1, "item_id": 1, "physical_page": 1, "kind": "answer", "source": "ocr"}] * 2 for name in SCHEMAS}
    return write(spark, tmp_path_factory.mktemp("nulls"), extra=True, **rows)


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    """Very long and empty texts, all rows twice."""
    text = "Q. " + "word " * 30_000 + "a@b.example (555) 555-0100 Ã© " + "x" * 20_000
    rows, lines = transcript(row("d", 1, 0, text, "question", event_kind="question_marker", source="ocr"), row("d", 1, 1, "", "answer", source="ocr"))
    docs = [{"doc_id": 1, "text": text, "source": "s"}, {"doc_id": 2, "text": "", "source": "s"}, {"doc_id": 3, "text": "\n\n\n", "source": "s"}]
    return write(spark, tmp_path_factory.mktemp("long"), canonical_rows=rows * 2, transcript_lines=lines * 2, doc_context=[{"doc_id": "d", "document_type": "interview", "page_count": 1}] * 2, documents=docs * 2, eval_items=[{"item_id": 1, "text": "word " * 40}] * 2, mix_targets=[{"source": "s", "target_share": 1.0, "max_repeats": 2}])


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables_give_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", QUERIES)
def test_nulls_and_clashing_columns(spark, nulls, name):
    QUERIES[name](spark, nulls).collect()


@pytest.mark.parametrize("name", [n for n in QUERIES if n.endswith("_found") or n in ("p7_paragraphs", "p9_mixture", "p10_statistics")])
def test_long_and_repeated(spark, long, name):
    found = QUERIES[name](spark, long).collect()
    if name.endswith("_found"):
        assert len(found) == len(set(map(str, found)))
