"""Plain text documents: bytes, decoding, pages, rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestant.functions.marks import leading_number
from attestant.functions.text import lines_of, trimmed

PAGE_LINE = r"(?i)^PAGE [\s\p{Z}]*\+?[0-9]+$"
BLANK = r"(?:[^\S\n]|\p{Z})*"
#: Largest file taken, as a guard of the reader.
MAX_BYTES = 50 * 1024 * 1024


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), filename, length, content, source_sha256 of each file; of a file over MAX_BYTES the content is not read, and null.

    Content is taken in a scan of its own, whose filter on the length spares reading what is too large.
    """
    files = spark.read.format("binaryFile").load(path)
    named = lambda df: df.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content", F.sha2("content", 256).alias("source_sha256"))
    large = files.filter(F.col("length") > MAX_BYTES).select("path", "length").withColumn("content", F.lit(None).cast("binary"))
    return named(files.filter(F.col("length") <= MAX_BYTES)).unionByName(named(large))


def decoded(files: DataFrame) -> DataFrame:
    """Adds kind, text and error. UTF-16 by its byte order mark, else UTF-8, checked; an odd, invalid or too large file (null content) has an error and no text."""
    head2, head3 = F.hex(F.substring("content", 1, 2)), F.hex(F.substring("content", 1, 3))
    odd = F.octet_length("content") % 2 == 1
    utf16 = head2.isin("FFFE", "FEFF")
    body8 = F.when(head3 == "EFBBBF", F.expr("substring(content, 4)")).otherwise(F.col("content"))
    text = F.when(utf16 & odd, None).when(head2 == "FFFE", F.decode(F.expr("substring(content, 3)"), "UTF-16LE")).when(head2 == "FEFF", F.decode(F.expr("substring(content, 3)"), "UTF-16BE")).when(F.is_valid_utf8(body8.cast("string")), body8.cast("string"))
    ending = F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1))
    kind = F.when(ending == "txt", "text").when(ending == "pdf", "pdf")
    is_pdf = F.hex(F.substring("content", 1, 5)) == "255044462D"
    error = F.when(F.col("content").isNull(), "file_too_large").when(kind.isNull(), "unsupported_file_type").when((kind == "text") & text.isNull(), "invalid_encoding").when((kind == "pdf") & ~is_pdf, "not_a_pdf")
    return files.withColumn("kind", kind).withColumn("error", error).withColumn("text", F.when((kind == "text") & error.isNull(), text))


def joined_numbers(lines: Column) -> Column:
    """A line that is only a number 1..50 joins the line after it, which then joins nothing; 12Q. becomes 12 Q.

    One pass of replacements from the left over the lines as one text, so the work grows with the text only.
    """
    spaced = F.transform(lines, lambda x: F.regexp_replace(x, r"^([0-9]{1,2})([QA][.:])", "$1 $2"))
    blank = r"(?:[^\S\n]|\p{Z})*"
    joined = F.regexp_replace(F.array_join(spaced, "\n"), rf"(?md)^{blank}([1-9]|[1-4][0-9]|50){blank}\n{blank}([^\n]*?){blank}$", "$1 $2")
    return F.when(F.size(lines) == 0, lines).otherwise(F.split(joined, "\n"))


def pages_of(documents: DataFrame) -> DataFrame:
    """doc_id, physical_page (from 1), text of documents (doc_id, text).

    With form feeds each part is a page, but for one blank last part. Without, a page begins at each PAGE line, which belongs to it; blank
    lines before the first page are skipped. A text without any such line is one page. Null texts have no page.
    """
    fed = documents.filter(F.col("text").contains("\f")).select("doc_id", F.split("text", "\f").alias("parts"))
    fed = fed.withColumn("parts", F.when(trimmed(F.element_at("parts", -1)) == "", F.slice("parts", 1, F.size("parts") - 1)).otherwise(F.col("parts")))
    by_feed = fed.select("doc_id", F.posexplode("parts").alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("physical_page"), "text")
    # a page's text is cut out of the document's: where the PAGE lines stand is told by the parts between them, so no line is a row of its own
    plain = documents.filter(F.col("text").isNotNull() & ~F.col("text").contains("\f")).select("doc_id", F.array_join(lines_of(F.col("text")), "\n").alias("t"), (F.size(lines_of(F.col("text"))) > 0).alias("any"))
    cut = F.regexp_replace("t", rf"(?imd)(^{BLANK}PAGE [\s\p{{Z}}&&[^\n]]*\+?[0-9]+{BLANK}$)", "\f$1")
    pieces = F.split(cut, "\f")
    inner = F.transform(pieces, lambda x, i: F.when(i < F.size(pieces) - 1, F.regexp_replace(x, r"\n\z", "")).otherwise(x))
    parts = F.transform(inner, lambda x, i: F.when(i == 0, F.regexp_replace(x, rf"\A(?:{BLANK}\n)+", "")).otherwise(x))
    whole = plain.select("doc_id", "any", F.split(cut, "\f")[0].alias("lead"), parts.alias("parts"))
    # what stands before the first PAGE line is a page only where it is not blank
    kept = F.filter("parts", lambda x, i: (i > 0) | (trimmed(F.col("lead")) != ""))
    by_mark = whole.filter("any").select("doc_id", F.posexplode(kept).alias("i", "text")).select("doc_id", (F.col("i") + 1).cast("int").alias("physical_page"), "text")
    return by_feed.unionByName(by_mark)


def rows_of(pages: DataFrame) -> DataFrame:
    """doc_id, physical_page, row_index (from 0), row_id, raw_text, leading_number of each line that isn't blank."""
    lines = F.filter(lines_of(F.col("text")), lambda x: trimmed(x) != "")
    return pages.filter("text is not null").select("doc_id", "physical_page", F.posexplode(lines).alias("row_index", "raw_text")).select("doc_id", "physical_page", "row_index", F.format_string("p%d_r%d", F.col("physical_page"), F.col("row_index") + 1).alias("row_id"), trimmed(F.col("raw_text")).alias("raw_text"), leading_number(F.col("raw_text")).alias("leading_number"))
