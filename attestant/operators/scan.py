"""Running values over the rows of a document without a task per document: page by page, the pages chained by their sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(df: DataFrame, order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, doc: str = "doc_id", page: str = "physical_page") -> DataFrame:
    """Adds to each row of a document: for ``sums`` the sum up to it, for ``lasts`` the last value that isn't null before it.

    ``order`` sorts the rows of a page and must be unique there. A page's rows meet in one task, and so do the sums of a document's pages,
    so a document of any number of rows is spread over its pages. Rows without a page come first in their document.
    """
    sums, lasts = sums or {}, lasts or {}
    names = {**{k: f"__{k}" for k in sums}, **{k: f"__{k}" for k in lasts}}
    marked = df.select("*", *[c.alias(names[k]) for k, c in {**sums, **lasts}.items()])
    local = W.partitionBy(doc, page).orderBy(*order)
    upto, earlier = local.rowsBetween(W.unboundedPreceding, 0), local.rowsBetween(W.unboundedPreceding, -1)
    at = F.struct(*order)
    ends = marked.groupBy(doc, page).agg(
        *[F.sum(names[k]).alias(f"{names[k]}_p") for k in sums],
        *[F.max_by(names[k], F.when(F.col(names[k]).isNotNull(), at)).alias(f"{names[k]}_p") for k in lasts],
    )
    pages = W.partitionBy(doc).orderBy(page).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(F.col(doc).alias("__doc"), F.col(page).alias("__page"), *[F.coalesce(F.sum(f"{names[k]}_p").over(pages), F.lit(0)).alias(f"{names[k]}_c") for k in sums], *[F.last(f"{names[k]}_p", ignorenulls=True).over(pages).alias(f"{names[k]}_c") for k in lasts])
    both = marked.select("*", *[F.sum(names[k]).over(upto).alias(f"{names[k]}_l") for k in sums], *[F.last(names[k], ignorenulls=True).over(earlier).alias(f"{names[k]}_l") for k in lasts]).join(carried, F.col(doc).eqNullSafe(F.col("__doc")) & F.col(page).eqNullSafe(F.col("__page")))
    return both.select(*df.columns, *[(F.col(f"{names[k]}_l") + F.col(f"{names[k]}_c")).alias(k) for k in sums], *[F.coalesce(f"{names[k]}_l", f"{names[k]}_c").alias(k) for k in lasts])
