"""Uploaded documents from their page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.functions.scalars import has_suffix

SECTION = 1_024  # pages joined to one text before the document is put together


def documents_from_pages(pages: DataFrame, section: int = SECTION) -> DataFrame:
    """Page texts in page order, each followed by a line end; only files named ``*.pdf`` are taken.

    Pages are first joined by sections of consecutive page numbers, so the pages of a very long document
    spread over many tasks and only its section texts meet at the end.
    """
    taken = pages.filter(has_suffix(F.col("filename"), ".pdf"))
    part = F.floor(F.col("page_no") / section)
    line = F.struct("page_no", F.concat(F.col("text"), F.lit("\n")).alias("text"))
    sections = taken.groupBy("doc_id", part.alias("part")).agg(_glued(line))
    return sections.groupBy("doc_id").agg(_glued(F.struct("part", "text")))


def _glued(entry):
    return F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"]), "").alias("text")
