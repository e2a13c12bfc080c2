"""Where results go: one JSON text for each document, or Parquet for each relation."""

from __future__ import annotations

from attestant.plans.transcript import Transcripts

RELATIONS = ("source_rows", "lines", "blocks", "exchanges", "edges", "participants", "utterances", "page_frames", "issues", "gate", "confidence")


def write_relations(parsed: Transcripts, folder: str, mode: str = "errorifexists", names: tuple[str, ...] = RELATIONS) -> None:
    """Each relation as Parquet under its name."""
    for name in names:
        getattr(parsed, name).write.mode(mode).parquet(f"{folder}/{name}")


def write_json(parsed: Transcripts, folder: str, mode: str = "errorifexists") -> None:
    """A line of JSON for each document, with nulls written out."""
    parsed.document_json().select("json").write.mode(mode).text(folder)
