"""Cleaning of sequence tables, and aligning them with identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import checks
from helixframe.functions.alphabet import CLEANABLE
from helixframe.functions.sequence import checked

#: What table readers elsewhere take for a missing value (fixed values).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def preprocess(
    seqs: DataFrame, to_upper: bool = True, replace_t_with_u: bool = True, valid_alphabet: str = CLEANABLE, strict: bool = False
) -> DataFrame:
    """``seqs`` with ``seq`` stripped, upper-cased and written with U, without the rows that have other letters.

    ``strict`` makes such a row an error, which names it, when the plan runs.  Empty sequences
    stay, null ones go (an error if ``strict``).  N is in the default alphabet
    though the features refuse it.
    """
    s = F.regexp_replace(F.col("seq").cast("string"), r"^\s+|\s+$", "")
    s = F.upper(s) if to_upper else s
    s = F.translate(s, "T", "U") if replace_t_with_u else s
    rows = seqs.withColumn("seq", s)
    bad = F.col("seq").isNull() | (F.translate("seq", valid_alphabet, "") != "")
    if strict:
        whose = F.concat(F.lit(" in "), F.coalesce(F.col("sample_id").cast("string"), F.lit("null"))) if "sample_id" in seqs.columns else F.lit("")
        return rows.withColumn("seq", F.when(bad, F.raise_error(F.concat(F.lit("letters outside the alphabet"), whose, F.lit(": "), F.coalesce("seq", F.lit("null"))))).otherwise(F.col("seq")))
    return rows.where(~bad)


def dropped_count(before: DataFrame, **options) -> int:
    """How many rows ``preprocess`` leaves out."""
    return before.count() - preprocess(before, **options).count()


def clean_sequences(seqs: DataFrame) -> DataFrame:
    """``seqs`` with ``seq`` as RNA; letters outside the alphabet are an error when the plan runs."""
    checks.columns(seqs, "seq")
    return seqs.withColumn("seq", checked("seq"))


def na_to_null(df: DataFrame) -> DataFrame:
    """String columns with the usual tokens for missing values as nulls."""
    return df.select(*[F.when(~F.col(f"`{n}`").isin(*NA_TOKENS), F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes])


def zip_ids(seqs: DataFrame, ids: DataFrame) -> DataFrame:
    """(sample_id, seq): ``ids(pos, sample_id)`` and ``seqs(pos, seq)`` side by side; unequal numbers are an error when the plan runs."""
    both = seqs.select("pos", "seq", F.lit(1).alias("_s")).join(ids.select("pos", "sample_id", F.lit(1).alias("_i")), "pos", "full")
    unequal = F.col("_s").isNull() | F.col("_i").isNull()
    return both.select("pos", F.when(unequal, F.raise_error(F.lit("as many ids as sequences are needed"))).otherwise(F.col("sample_id")).alias("sample_id"), "seq")
