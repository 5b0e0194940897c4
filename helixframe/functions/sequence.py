"""Column expressions on RNA sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions.alphabet import NUCLEOTIDES, overlaps_itself

ColumnLike = Column | str


def _column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_rna(seq: ColumnLike) -> Column:
    """Upper case, T as U."""
    return F.translate(F.upper(_column(seq)), "T", "U")


def checked(seq: ColumnLike) -> Column:
    """``to_rna``, and an error when the plan runs if a sequence is null or has other letters than A, C, G, U.

    The check is part of the value, so it goes wherever the value is used.
    """
    rna = to_rna(seq)
    bad = F.array_join(F.array_sort(F.array_distinct(F.split(F.translate(rna, NUCLEOTIDES, ""), ""))), "")
    return (
        F.when(_column(seq).isNull(), F.raise_error(F.lit("null sequence")))
        .when(rna.rlike(f"[^{NUCLEOTIDES}]"), F.raise_error(F.concat(F.lit("letters outside ACGU: "), bad)))
        .otherwise(rna)
    )


def reverse_complement(seq: ColumnLike) -> Column:
    return F.reverse(F.translate(_column(seq), "ACGU", "UGCA"))


def windows(seq: ColumnLike, k: int) -> Column:
    """All overlapping words of length ``k``; no words where the sequence is shorter.

    One pass with a look-ahead: taking substrings by position would walk the
    sequence from its start for each.
    """
    return F.regexp_extract_all(_column(seq), F.lit(f"(?=(.{{{k}}}))"), 1)


def count_word(seq: ColumnLike, word: str) -> Column:
    """Overlapping occurrences of ``word``, without leaving the row or building its windows.

    Occurrences of a word without a border cannot overlap, so removing them
    counts them; others are counted by a look-ahead.
    """
    s = _column(seq)
    if overlaps_itself(word):
        return F.regexp_count(s, F.lit(f"(?={word})")).cast("double")
    return ((F.length(s) - F.length(F.replace(s, F.lit(word), F.lit("")))) / len(word)).cast("double")


def count_gapped(seq: ColumnLike, first: str, gap: int, second: str) -> Column:
    """Occurrences of ``first``, then ``gap`` letters, then ``second``, overlaps included."""
    if gap == 0:
        return count_word(seq, first + second)
    return F.regexp_count(_column(seq), F.lit(f"(?={first}.{{{gap}}}{second})")).cast("double")


def per_window(count: Column, total: Column, normalize: bool) -> Column:
    """``count``, or its share of ``total`` windows; zero where there are none."""
    if not normalize:
        return count
    return F.when(total > 0, count / total).otherwise(F.lit(0.0))


def chunks(seq: ColumnLike, window: int, stride: int) -> Column:
    """Windows of ``window`` letters every ``stride``; a rest shorter than a window is left out.

    A sequence no longer than the window, or a window or stride below one,
    gives the sequence itself.
    """
    s = _column(seq)
    if window <= 0 or stride <= 0:
        return F.array(s)

    def cut(text: Column) -> Column:
        last = F.greatest(F.lit(0), F.length(text) - window)
        return F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda i: F.substring(text, i + 1, F.lit(window)))

    # Bound as a lambda's argument, the sequence's expression is evaluated once and not for every chunk.
    return F.get(F.transform(F.array(s), cut), 0)
