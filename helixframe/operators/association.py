"""Association matrices as long rows ``(lnc, disease, value)``."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import checks

_JUNK = re.compile(r"^(unnamed.*|_c\d+)$", re.IGNORECASE)


def drop_junk(df: DataFrame) -> DataFrame:
    """Without the columns that readers make up for empty headers."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not _JUNK.match(c)])


def is_positive(value: Column) -> Column:
    """1 where a number is above zero, else 0; null and NaN are 0."""
    v = value.cast("double")
    return F.when((v > 0) & ~F.isnan(v), 1).otherwise(0)


def from_wide(raw: DataFrame, id_col: str = "ID", seq_col: str = "seqs") -> DataFrame:
    """(lnc, disease, value) of a table with one column per disease besides ``id_col`` and ``seq_col``."""
    df = drop_junk(raw)
    checks.columns(df, id_col, seq_col)
    diseases = [c for c in df.columns if c not in (id_col, seq_col)]
    if not diseases:
        return df.select(F.col(f"`{id_col}`").cast("string").alias("lnc"), F.lit("").alias("disease"), F.lit(0.0).alias("value")).limit(0)
    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("lnc"), *[F.col(f"`{c}`").cast("double").alias(c) for c in diseases])
    return rows.unpivot(["lnc"], [F.col(f"`{c}`") for c in diseases], "disease", "value")


def from_matrix(matrix: DataFrame, label: str | None = None) -> DataFrame:
    """(lnc, disease, value) of a labelled matrix: the first column, or ``label``, names the rows."""
    label = label or matrix.columns[0]
    diseases = [c for c in matrix.columns if c != label]
    rows = matrix.select(F.col(f"`{label}`").cast("string").alias("lnc"), *[F.col(f"`{c}`").cast("double").alias(c) for c in diseases])
    return rows.unpivot(["lnc"], [F.col(f"`{c}`") for c in diseases], "disease", "value")


def from_arrays(rows: DataFrame, order: str = "pos", values: str = "values") -> DataFrame:
    """(lnc, disease, value) of unlabelled rows (position from 0, array); labels are L1.. and D1..."""
    cells = rows.select(F.concat(F.lit("L"), F.col(order) + 1).alias("lnc"), F.posexplode(values).alias("j", "value"))
    return cells.select("lnc", F.concat(F.lit("D"), F.col("j") + 1).alias("disease"), F.col("value").cast("double").alias("value"))


def from_pairs(raw: DataFrame, lnc_col: str = "ID", dis_col: str = "Disease Name", valid_ids: DataFrame | None = None) -> DataFrame:
    """(lnc, disease, value = 1) of a table of pairs, each pair once.

    With ``valid_ids(lnc)``, only pairs whose identifier is among them, upper
    and lower case alike, stay.
    """
    df = drop_junk(raw)
    checks.columns(df, lnc_col, dis_col)
    pairs = df.select(F.col(f"`{lnc_col}`").cast("string").alias("lnc"), F.col(f"`{dis_col}`").cast("string").alias("disease")).na.drop("any").distinct()
    if valid_ids is not None:
        known = valid_ids.select(F.upper(F.col("lnc").cast("string")).alias("_known")).distinct()
        pairs = pairs.join(known, F.upper("lnc") == F.col("_known"), "left_semi")
    return pairs.withColumn("value", F.lit(1))


def merge_or(*parts: DataFrame | None) -> DataFrame:
    """(lnc, disease, value in 0, 1): 1 where any part has a positive value; repeated cells are merged too."""
    given = [p for p in parts if p is not None]
    if not given:
        raise ValueError("no association table given")
    union = None
    for p in given:
        rows = p.select("lnc", "disease", is_positive(F.col("value")).alias("value"))
        union = rows if union is None else union.unionByName(rows)
    return union.groupBy("lnc", "disease").agg(F.max("value").alias("value"))


def choose_y(from_sequences: DataFrame, from_pair_file: DataFrame | None = None, merge: bool = False) -> DataFrame:
    """The labels to use: the pair file's alone, both merged, or the sequence table's where there is no pair file."""
    if from_pair_file is None:
        return merge_or(from_sequences)
    return merge_or(from_sequences, from_pair_file) if merge else merge_or(from_pair_file)


def full_grid(y: DataFrame) -> DataFrame:
    """(lnc, disease, value) for every lnc and every disease of y, 0 where y has no cell."""
    lncs, diseases = y.select("lnc").distinct(), y.select("disease").distinct()
    return lncs.crossJoin(diseases).join(y, ["lnc", "disease"], "left").select("lnc", "disease", F.coalesce("value", F.lit(0)).alias("value"))


def to_wide(y: DataFrame, diseases: Sequence[str] | None = None) -> DataFrame:
    """A row per lnc and a column per disease, 0 where there is no association, columns sorted.

    Giving ``diseases`` spares the job that looks them up.
    """
    names = list(diseases) if diseases is not None else sorted(r[0] for r in y.select("disease").distinct().where("disease is not null").collect())
    return y.groupBy("lnc").pivot("disease", names).agg(F.max("value")).na.fill(0)


def sequences_table(raw: DataFrame, id_col: str = "ID", seq_col: str = "seqs") -> DataFrame:
    """(id, seq) of a raw table, rows with a null in either left out."""
    df = drop_junk(raw)
    checks.columns(df, id_col, seq_col)
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{seq_col}`").alias("seq")).na.drop("any")
