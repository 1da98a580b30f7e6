"""Decoding of per-position evidence strings into base counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.text import col, count_of

BASES = ("A", "C", "G", "T")


def counted_symbols(pile: Column | str) -> Column:
    """The evidence string without read starts, indels and the characters they own, whatever their length.

    The string is cut before every mark (``^``, ``+``, ``-``) and the pieces are folded from left to right. A read start
    owns the next character, an indel as many as its number says (or what is left); owned characters may
    reach over later pieces, whose marks then open nothing. A string without an indel mark has read starts only, and one
    replacement takes these out from left to right.
    """
    raw = col(pile)

    def rest(piece: Column, skip: Column) -> Column:
        return F.struct(
            F.substring(piece, skip.cast("int") + 1, F.length(piece)).alias("kept"),
            F.greatest(skip - F.length(piece), F.lit(0)).cast("bigint").alias("skip"),
        )

    def step(acc: Column, piece: Column) -> Column:
        digits = F.regexp_extract(piece, "^[+-]([0-9]*)", 1)
        length = F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))
        opens = acc["skip"] == 0
        owned = (
            F.when(~opens, acc["skip"])
            .when(F.startswith(piece, F.lit("^")), F.lit(2).cast("bigint"))
            .when(F.startswith(piece, F.lit("+")) | F.startswith(piece, F.lit("-")), length + F.length(digits) + 1)
            .otherwise(F.lit(0).cast("bigint"))
        )
        after = rest(piece, F.least(owned, F.lit((1 << 31) - 2).cast("bigint")))
        return F.struct(F.concat(acc["kept"], after["kept"]).alias("kept"), after["skip"].alias("skip"))

    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("bigint").alias("skip"))
    folded = F.aggregate(F.split(raw, r"(?=[\^+-])"), start, step, lambda acc: acc["kept"])
    return F.when(F.contains(raw, F.lit("+")) | F.contains(raw, F.lit("-")), folded).otherwise(F.regexp_replace(raw, r"(?s)\^.?", ""))


def base_counts(df: DataFrame, ref: str, symbols: str) -> DataFrame:
    """Add n_A, n_C, n_G, n_T, n_other: counted bases; '.' and ',' count as the reference base.

    A reference base outside ACGT is counted under ``n_other``.
    """
    shared = df.withColumns({"_upper": F.upper(symbols), "_ref": F.upper(ref)}).withColumn(
        "_as_ref", count_of(F.col("_upper"), ".,")
    )
    zero = F.lit(0).cast("bigint")
    counts = {
        f"n_{base}": count_of(F.col("_upper"), base) + F.when(F.col("_ref") == base, F.col("_as_ref")).otherwise(zero)
        for base in BASES
    }
    counts["n_other"] = F.when(F.col("_ref").isin(*BASES), zero).otherwise(F.col("_as_ref"))
    return shared.withColumns(counts).drop("_upper", "_ref", "_as_ref")


def second_largest(*counts: Column) -> Column:
    """Second largest of at least two counts in one row."""
    return F.get(F.sort_array(F.array(*counts), asc=False), F.lit(1))
