"""Quality rules combined by weak supervision, in DataFrame functions only.

Each rule looks at counts of a text and votes good, bad or abstains.  The
accuracies of the rules and the share of good documents are not given:
expectation-maximisation estimates, from how the votes agree, that share and
each rule's chance of voting good, where it votes, on good and on bad documents.
A document is kept when its posterior probability of being good reaches
``threshold``, so one bad vote of a weak rule may be outvoted; two base limits
drop it outright, and the estimation leaves such documents out.

The votes of a document are one of 3**rules patterns, so the estimation reads a
table of counts by pattern whose size does not depend on the corpus; the
iterations run on the driver over that table.

The counts work on one row at a time, without exploding words.  Repeated
three-word windows are found by sorting 64-bit numbers that hold a window's hash
above its position; windows whose hashes meet are compared word by word, and where
hashes of different windows meet the windows themselves are sorted.

Edge cases: bytes that are not UTF-8 count as U+FFFD.  A null text has no words; a text without words fails the base
limits.  Repeated rows repeat.  An empty table gives no rows.  Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import settle, text_or_empty

SPACE_CHARS = "\t\n\x0b\f\r "
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STOPS = ".!?:;"
USUAL = "abcdefghijklmnopqrstuvwxyz "
MIN_WORDS = 50
GOOD, NONE, BAD = 1, 0, -1
#: Bits above the position that a window's hash does without.
SPARE_BITS = 0


def with_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each text of ``docs(doc_id, text)``.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word, equal to an earlier line), n_repeat_words (words in three-word
    windows found twice or more), n_lines (lines with a word), n_symbol_lines
    (of these, lines with a symbol), n_upper (A-Z) and n_stops (``. ! ? : ;``).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    spaced = F.translate("text", SPACE_CHARS, " " * len(SPACE_CHARS))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    # What is counted are few of the characters: without the usual ones, the counts run over a short string.
    number = lambda chars: (F.length("rare") - F.length(F.translate("rare", chars, ""))).cast("long")
    rows = rows.select("doc_id", "text", F.split(spaced, " ", -1).alias("parts"), lines.alias("lines"), F.translate("text", USUAL, "").alias("rare"))
    rows = rows.select(
        "doc_id",
        F.array_remove("parts", "").alias("words"),
        (F.length("text") - F.size("parts") + 1).cast("long").alias("word_chars"),
        number(SYMBOLS).alias("n_symbols"),
        number(UPPER).alias("n_upper"),
        number(STOPS).alias("n_stops"),
        "lines",
    )
    n = F.size("words")
    # Windows 0 .. n-3 as (hash, position) packed into one long: positions take the low bits.
    bits = F.ceil(F.log2(F.greatest(n, F.lit(2)) + F.lit(1))).cast("int") + SPARE_BITS
    windows = F.when(
        n >= 4,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.expr("0L")
                .bitwiseOR(F.call_function("shiftleft", F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)), F.col("bits")))
                .bitwiseOR(i.cast("long")),
            )
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("bits", bits).withColumn("sorted", windows)
    rows = rows.select(
        "doc_id",
        "words",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_upper",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("n_symbols") > 0, F.size(F.filter("lines", lambda x: F.length(F.translate(x, SYMBOLS, "")) < F.length(x)))).otherwise(0).cast("long").alias("n_symbol_lines"),
        "n_stops",
        "sorted",
        "bits",
    )
    mask = F.call_function("shiftleft", F.expr("1L"), F.col("bits")) - 1
    # Neighbours whose hashes agree are few; only these are looked up and compared word by word.
    agree = lambda i: F.call_function("shiftright", F.get("sorted", i).bitwiseXOR(F.get("sorted", i + 1)), F.col("bits")) == 0
    rows = rows.withColumn(
        "twins",
        F.when(F.size("sorted") >= 2, F.filter(F.sequence(F.lit(0), F.size("sorted") - 2), agree)).otherwise(F.array().cast("array<int>")),
    )
    start = lambda i: F.get("sorted", i).bitwiseAND(mask).cast("int")
    word = lambda i, k: F.get("words", start(i) + k)
    same = lambda i: (word(i, 0) == word(i + 1, 0)) & (word(i, 1) == word(i + 1, 1)) & (word(i, 2) == word(i + 1, 2))
    quick = F.flatten(F.transform("twins", lambda i: F.array(start(i), start(i + 1))))
    window = lambda i: F.struct(F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("w"), i.alias("i"))
    whole = F.sort_array(F.transform(F.sequence(F.lit(0), F.size("words") - 3), window))
    pair = lambda s, i: F.when(F.get(s, i)["w"] == F.get(s, i + 1)["w"], F.array(F.get(s, i)["i"], F.get(s, i + 1)["i"])).otherwise(F.array().cast("array<int>"))
    sure = F.get(F.transform(F.array(whole), lambda s: F.flatten(F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda i: pair(s, i)))), 0)
    found = F.when(F.exists("twins", lambda i: ~same(i)), sure).otherwise(quick)
    rows = rows.withColumn("starts", F.sort_array(F.array_distinct(found)))
    covered = F.aggregate(
        F.transform("starts", lambda v, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - v, F.lit(3))).cast("long")),
        F.expr("0L"),
        lambda a, x: a + x,
    )
    return rows.withColumn("n_repeat_words", covered).drop("words", "sorted", "twins", "starts", "bits")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)


def rule_votes() -> dict[str, Column]:
    """The rules: each votes on ratios of the counts.

    A rule votes good in the range that running text keeps to, bad far outside
    of it, and abstains between them or where it has too little to go by.
    """
    per_word = lambda c: F.col(c) / F.greatest("n_words", F.lit(1))
    per_line = lambda c: F.col(c) / F.greatest("n_lines", F.lit(1))
    per_char = lambda c: F.col(c) / F.greatest("word_chars", F.lit(1))
    mean, stops, some = per_word("word_chars"), per_word("n_stops"), F.col("n_words") > 0
    return {
        "length": _vote(F.col("n_words") >= 100, F.col("n_words") < MIN_WORDS),
        "word_length": _vote(mean.between(3.0, 7.0), (mean < 2.5) | (mean > 12.0)),
        "symbols": _vote(some & (per_word("n_symbols") < 0.05), per_word("n_symbols") > 0.25),
        "symbol_density": _vote(some & (per_char("n_symbols") < 0.01), per_char("n_symbols") > 0.04),
        "symbol_lines": _vote((F.col("n_lines") >= 2) & (per_line("n_symbol_lines") < 0.2), (per_line("n_symbol_lines") > 0.5) & (per_word("n_symbols") > 0.05)),
        "capitals": _vote(per_char("n_upper").between(0.001, 0.1), per_char("n_upper") > 0.4),
        "duplicate_lines": _vote((F.col("n_lines") >= 3) & (per_line("n_dup_lines") < 0.05), (per_line("n_dup_lines") > 0.3) & (F.col("n_dup_lines") >= 2)),
        "repeated_windows": _vote((F.col("n_words") >= 30) & (per_word("n_repeat_words") < 0.1), per_word("n_repeat_words") > 0.35),
        "sentences": _vote(stops.between(0.02, 0.35), (F.col("n_words") >= 30) & ((stops < 0.002) | (stops > 0.8))),
    }


def estimate(
    patterns: Sequence[tuple[tuple[int, ...], int]], share: float = 0.9, strength: float = 10.0, rounds: int = 500, tolerance: float = 1e-9
) -> tuple[float, list[dict[int, float]]]:
    """(log-odds of good, per rule the log-odds that each vote adds), by expectation-maximisation.

    Starts from rules that are right four times in five.  The share of good
    documents starts at ``share``, which weighs as much as ``strength``
    documents; every vote keeps some smoothing mass; a rule whose votes fall
    below chance counts as chance, which keeps the classes from changing places;
    whether a rule abstains says nothing.
    """
    if not patterns:
        return 0.0, []
    n_rules = len(patterns[0][0])
    total = float(sum(n for _, n in patterns))
    odds = [{GOOD: math.log(4.0), NONE: 0.0, BAD: -math.log(4.0)} for _ in range(n_rules)]
    prior, previous = math.log(share / (1 - share)), None
    for _ in range(rounds):
        seen = [[{GOOD: 0.8, BAD: 0.2}, {GOOD: 0.2, BAD: 0.8}] for _ in range(n_rules)]  # on good, on bad documents
        good = 0.0
        for votes, n in sorted(patterns):
            score = prior + sum(odds[j][v] for j, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, score))))
            good += n * p
            for j, v in enumerate(votes):
                if v != NONE:
                    seen[j][0][v] += n * p
                    seen[j][1][v] += n * (1 - p)
        for j, (on_good, on_bad) in enumerate(seen):
            right, wrong = on_good[GOOD] / (on_good[GOOD] + on_good[BAD]), on_bad[GOOD] / (on_bad[GOOD] + on_bad[BAD])
            better = right > wrong
            odds[j] = {GOOD: math.log(right / wrong) if better else 0.0, NONE: 0.0, BAD: math.log((1 - right) / (1 - wrong)) if better else 0.0}
        prior = math.log((good + strength * share) / (total - good + strength * (1 - share)))
        if previous is not None and abs(good - previous) <= tolerance * total:
            break
        previous = good
    return prior, odds


def judge(docs: DataFrame, threshold: float = 0.5, share: float = 0.9) -> DataFrame:
    """One row per row of ``docs``: the counts, each rule's vote, posterior, base_failed and kept."""
    rules = rule_votes()
    names = [f"vote_{r}" for r in rules]
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    votes = {f"vote_{r}": c.cast("int") for r, c in rules.items()}
    counted = settle(with_counts(docs).withColumns(votes | {"base_failed": base}))
    # 3 ** len(rules) rows at most; documents that the base limits drop would stand for a class of their own.
    patterns = counted.where("not base_failed").groupBy(*names).count().collect()
    prior, odds = estimate([(tuple(r[n] for n in names), r["count"]) for r in patterns], share)
    score = F.lit(prior)
    for name, by in zip(names, odds, strict=False):
        score = score + F.when(F.col(name) == GOOD, F.lit(by[GOOD])).when(F.col(name) == BAD, F.lit(by[BAD])).otherwise(F.lit(0.0))
    return counted.withColumn("posterior", 1 / (1 + F.exp(-score))).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
