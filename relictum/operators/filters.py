"""Row filters on alignments, and the choices within a read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNMAPPED, PAIRED = 4, 1
#: Quality-check failed, duplicate, supplementary.
FAILED = 512 | 1024 | 2048


@dataclass(frozen=True)
class AlignmentFilter:
    """Bounds on alignments; None is off. Comparisons with a missing edit distance let the row pass."""

    min_length: int | None = None
    max_dust: int | None = None
    min_edit: int | None = None
    max_edit: int | None = None
    min_ani: float | None = None
    max_ani: float | None = None
    min_mapq: int | None = None
    discard: int | None = None
    no_failed: bool = True

    def __post_init__(self):
        for name, low, high in (("max_dust", 0, 100), ("min_ani", 0, 1), ("max_ani", 0, 1), ("min_mapq", 0, 255)):
            value = getattr(self, name)
            if value is not None and not low <= value <= high:
                raise ValueError(f"{name} must lie in {low}..{high}")
        for low, high in (("min_edit", "max_edit"), ("min_ani", "max_ani")):
            if None not in (getattr(self, low), getattr(self, high)) and getattr(self, low) > getattr(self, high):
                raise ValueError(f"{low} is larger than {high}")
        if self.min_length is not None and self.min_length < 0 or any((getattr(self, x) or 0) < 0 for x in ("min_edit", "max_edit")):
            raise ValueError("bounds must not be negative")

    def column(self, length: Column | None = None, dust: Column | None = None) -> Column:
        length = F.length("seq") if length is None else length
        nm = F.col("nm")
        out = F.col("flag").bitwiseAND(UNMAPPED) == 0
        if self.no_failed:
            out &= F.col("flag").bitwiseAND(FAILED) == 0
        if self.min_length is not None:
            out &= length >= self.min_length
        if self.min_mapq is not None:
            out &= F.col("mapq") >= self.min_mapq
        if self.discard is not None:
            out &= F.col("flag").bitwiseAND(self.discard) == 0
        if self.min_edit is not None:
            out &= nm.isNull() | (nm >= self.min_edit)
        if self.max_edit is not None:
            out &= nm.isNull() | (nm <= self.max_edit)
        same = 1 - nm / length
        if self.min_ani is not None:
            out &= nm.isNull() | (same >= self.min_ani)
        if self.max_ani is not None:
            out &= nm.isNull() | (same <= self.max_ani)
        if self.max_dust is not None:
            out &= F.floor((F.col("dust") if dust is None else dust) + 0.5) <= self.max_dust
        return out


def best_as(rows: DataFrame, read: str = "qname", score: str = "as_score") -> DataFrame:
    """The rows of a read with its highest score, ties kept. A missing score is an error."""
    own = F.when(F.col(score).isNull(), F.raise_error(F.lit("alignment without score")).cast(rows.schema[score].dataType)).otherwise(F.col(score))
    return rows.withColumn("best_", F.max(own).over(Window.partitionBy(read))).where(F.col(score) == F.col("best_")).drop("best_")


def first_reads(rows: DataFrame, n: int, read: str = "qname", order: str = "aln_idx") -> DataFrame:
    """All rows of the first n reads, by the place of a read's first row. A top-n of reads, then a join with n rows."""
    first = rows.groupBy(read).agg(F.min(order).alias("first_")).orderBy("first_", read).limit(n)
    return rows.join(first.select(read), read, "left_semi")


def first_row(rows: DataFrame, columns: list[str], read: str = "qname", order: str = "aln_idx") -> DataFrame:
    """Of each read, the given columns of its first row."""
    return rows.groupBy(read).agg(F.min_by(F.struct(*columns), F.col(order)).alias("x")).select(read, *[f"x.{c}" for c in columns])
