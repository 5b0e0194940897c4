"""The RNA alphabet and the column labels that follow from it."""

from __future__ import annotations

from itertools import product

NUCLEOTIDES = "ACGU"
#: Letters that cleaning lets through: the alphabet and N for an unknown base.
CLEANABLE = "ACGUN"
DINUCLEOTIDES = tuple(map("".join, product(NUCLEOTIDES, repeat=2)))


def words(k: int) -> list[str]:
    """All words of length ``k``, in alphabetical order."""
    return ["".join(w) for w in product(NUCLEOTIDES, repeat=k)]


def reverse_complement(word: str) -> str:
    return word.translate(str.maketrans("ACGU", "UGCA"))[::-1]


def canonical_words(k: int) -> list[str]:
    """The smaller of each word and its reverse complement, in alphabetical order."""
    return [w for w in words(k) if w <= reverse_complement(w)]


def overlaps_itself(word: str) -> bool:
    """Whether two occurrences of the word can share letters."""
    return any(word.startswith(word[i:]) for i in range(1, len(word)))
