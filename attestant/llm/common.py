"""What the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TESTIMONY = ("question", "answer", "objection", "speaker_statement")


def per_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Maps Arrow batches; ``make`` runs once a task and returns the function of a batch, so models are unpacked once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            out = step(b)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def distinct_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each (doc_id, id) of canonical_rows, whose rows may be delivered twice: equal but for ingested_at.

    Of rows that differ the one delivered last counts. Null keys are kept as one row each key value.
    """
    rest = [c for c in columns if c not in ("doc_id", "id")]
    return rows.groupBy("doc_id", "id").agg(F.max_by(F.struct(*rest), F.coalesce(F.col("ingested_at"), F.lit(0).cast("timestamp"))).alias("r")).select("doc_id", "id", *[F.col("r")[c].alias(c) for c in rest])


def chunks(texts: list[str], most: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters together, so that arrays over their characters stay small; one long text is a range of its own."""
    first = size = 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > most:
            yield first, k
            first, size = k, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


_ACROSS = re.compile(r"(?<=\S) {3}(?=\S)")


def unmerged(text: str) -> str:
    """A page whose lines were read across its columns, three blanks between two columns' pieces, as one column after the other.

    Other texts stay as they are: fewer than three in ten lines have two pieces, or the pieces are as short as a table's entries.
    """
    if "   " not in text:
        return text
    lines = [_ACROSS.split(x) for x in text.split("\n")]
    pieces = [p for x in lines if len(x) > 1 for p in x]
    if sum(len(x) > 1 for x in lines) < 0.3 * len(lines) or sorted(sum(c.isalpha() for c in p) for p in pieces)[len(pieces) // 2] < 12:
        return text
    return "\n".join(x[k] for k in range(max(map(len, lines))) for x in lines if k < len(x))
