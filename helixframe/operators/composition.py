"""Composition features of sequences: ids 1, 2 and 7 to 12.

Every operator takes ``seqs(sample_id, seq)`` and returns one row per sequence.
All are projections: no shuffle, nothing but built-in functions, and they work
on streams.  ``return_format`` is "dataframe" (a column per feature) or
"matrix" (one array column, labels in the column's metadata).  For words too
long for a column each, ``kmer_long`` returns the words that occur, one row per
word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import checks
from helixframe.functions.alphabet import DINUCLEOTIDES, NUCLEOTIDES, canonical_words, reverse_complement, words
from helixframe.functions.sequence import checked, count_gapped, count_word, per_window, windows

FORMATS = ("dataframe", "matrix")


def cleaned(seqs: DataFrame) -> DataFrame:
    checks.columns(seqs, "sample_id", "seq")
    return seqs.select("sample_id", checked("seq").alias("seq"))


def shaped(rows: DataFrame, features: Sequence[tuple[str, Column]], return_format: str) -> DataFrame:
    checks.one_of("return_format", return_format, FORMATS)
    if return_format == "dataframe":
        return rows.select("sample_id", *[c.cast("double").alias(n) for n, c in features])
    values = F.array(*[c.cast("double") for _, c in features]) if features else F.array().cast("array<double>")
    return rows.select("sample_id", values.alias("features", metadata={"labels": [n for n, _ in features]}))


def _count_windows(seqs: DataFrame, k: int, counts: Sequence[tuple[str, Column]], normalize: bool, return_format: str) -> DataFrame:
    total = F.length("seq") - (k - 1)
    return shaped(cleaned(seqs), [(n, per_window(c, total, normalize)) for n, c in counts], return_format)


def kmer(seqs: DataFrame, k: int, normalize: bool = True, return_format: str = "dataframe") -> DataFrame:
    """Id 1: the share, or number, of each word of length ``k``."""
    checks.at_least("k", k, 1)
    return _count_windows(seqs, k, [(w, count_word("seq", w)) for w in words(k)], normalize, return_format)


def canonical_kmer(seqs: DataFrame, k: int, normalize: bool = True, return_format: str = "dataframe") -> DataFrame:
    """Id 2: as id 1, a word and its reverse complement counted as one."""
    checks.at_least("k", k, 1)
    counts = []
    for w in canonical_words(k):
        other = reverse_complement(w)
        counts.append((w, count_word("seq", w) if other == w else count_word("seq", w) + count_word("seq", other)))
    return _count_windows(seqs, k, counts, normalize, return_format)


def kmer_long(seqs: DataFrame, k: int, normalize: bool = True) -> DataFrame:
    """Id 1 for any ``k``: (sample_id, kmer, value) of the words that occur.

    Counted within each task before the shuffle, so what moves is a sequence's
    distinct words.  Rows that share a sample_id are counted together.
    """
    checks.at_least("k", k, 1)
    found = cleaned(seqs).select("sample_id", F.greatest(F.length("seq") - (k - 1), F.lit(0)).alias("w"), F.explode(windows("seq", k)).alias("kmer"))
    counts = found.groupBy("sample_id", "kmer", "w").agg(F.count("*").cast("double").alias("value"))
    value = F.col("value") / F.col("w") if normalize else F.col("value")
    return counts.select("sample_id", "kmer", value.alias("value"))


def mono_composition(seqs: DataFrame, normalize: bool = True, return_format: str = "dataframe") -> DataFrame:
    """Id 7."""
    return kmer(seqs, 1, normalize, return_format)


def di_composition(seqs: DataFrame, normalize: bool = True, return_format: str = "dataframe") -> DataFrame:
    """Id 8."""
    return kmer(seqs, 2, normalize, return_format)


def tri_composition(seqs: DataFrame, normalize: bool = True, return_format: str = "dataframe") -> DataFrame:
    """Id 9."""
    return kmer(seqs, 3, normalize, return_format)


def zcurve(seqs: DataFrame, normalize: bool = True, return_format: str = "dataframe") -> DataFrame:
    """Id 10: purine against pyrimidine, amino against keto, weak against strong bonds."""
    rows = cleaned(seqs).select("sample_id", F.length("seq").alias("n"), *[count_word("seq", x).alias(x) for x in NUCLEOTIDES])
    a, c, g, u = (F.col(x) for x in NUCLEOTIDES)
    axes = (("ZC_x", (a + g) - (c + u)), ("ZC_y", (a + c) - (g + u)), ("ZC_z", (a + u) - (c + g)))
    return shaped(rows, [(n, per_window(v, F.col("n"), normalize)) for n, v in axes], return_format)


def _gapped(seqs: DataFrame, seconds: Sequence[str], gap: int, normalize: bool, return_format: str) -> DataFrame:
    checks.at_least("k_gap", gap, 0)
    counts = [(f"{a}_{b}_gap{gap}", count_gapped("seq", a, gap, b)) for a in NUCLEOTIDES for b in seconds]
    return _count_windows(seqs, gap + 1 + len(seconds[0]), counts, normalize, return_format)


def mono_mono_gap(seqs: DataFrame, k_gap: int, normalize: bool = True, return_format: str = "dataframe") -> DataFrame:
    """Id 11: pairs of letters with ``k_gap`` letters between them."""
    return _gapped(seqs, list(NUCLEOTIDES), k_gap, normalize, return_format)


def mono_di_gap(seqs: DataFrame, k_gap: int, normalize: bool = True, return_format: str = "dataframe") -> DataFrame:
    """Id 12: a letter and a dinucleotide with ``k_gap`` letters between them."""
    return _gapped(seqs, list(DINUCLEOTIDES), k_gap, normalize, return_format)
