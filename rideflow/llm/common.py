"""Shared pieces: the white space of all word definitions, folds, size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType

# The six characters of [\x20\x09-\x0D]; bytes.split() cuts at exactly these.
WHITE = " \t\n\x0b\x0c\r"
# Ids (at most 16 bytes a row, some 64 in a hash table) that may be sent to every executor.
IDS_TO_BROADCAST = 1_000_000


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``, a null text as the empty one; other columns can't clash."""
    return docs.select(
        docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")
    )


def words(text: Column) -> Column:
    """Maximal runs of characters outside ``WHITE``, in order."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def in_fold(id_col: Column, folds: int) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id is in no fold."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def small_side(ids: DataFrame, limit: int = IDS_TO_BROADCAST) -> DataFrame:
    """``ids`` marked for broadcast if at most ``limit`` rows of it exist, else as it is.

    The count is taken here; a larger table is joined by shuffling, with the same result.
    """
    assert all(isinstance(f.dataType, (LongType, IntegerType)) for f in ids.schema)
    return F.broadcast(ids) if ids.count() <= limit else ids
