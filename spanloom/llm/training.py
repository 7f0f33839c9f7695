"""Bounded, fixed samples of labelled documents for the models that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_order


def held_out(id_col: Column, fold: tuple[int, int] = (3, 1)) -> Column:
    """True for ids whose crc32 (of the decimal text) leaves ``fold[1]`` modulo ``fold[0]``: never trained on. A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % fold[0] == fold[1]


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", fold: tuple[int, int] = (3, 1)) -> DataFrame:
    """``id, label, text`` of at most ``rows`` labelled documents, chosen by a hash of the id from those that ``fold`` does not hold out.

    The chosen labels (at most ``rows`` of a few bytes) are broadcast, so documents are only scanned.
    """
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), fold))
    chosen = chosen.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).orderBy(hash_order("id"), "id", "label").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "id")
