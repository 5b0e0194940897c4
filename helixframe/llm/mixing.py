"""Mixing sources to target weights with a low-discrepancy schedule.

Every source is laid out as one stream of words: its documents in an order
given by a hash, cut into blocks of equal token counts.  Slot ``t`` of the
schedule belongs to the source in whose cumulative-weight interval the point
``frac(shift + t * golden ratio)`` falls; the slot's rank among its source's
slots says which block it takes, and ranks beyond the last block start the
stream again.  The points are exact 64-bit integers, so they do not lose
precision far out.  A source's slots return after one of three gaps, and the
slot of any rank has a closed form (a floor sum), so each stretch of a source's
slots is generated by itself, from that source's row alone, without a shuffle of
slots or a running count.  Sources are rows of a table, however many they are:
the driver holds a few sums for each weight.

Targets share ``share`` times all words by weight; a target stops at
``max_repeats`` times its source's words and what is over is shared again.  A
source's last slot takes the words that are left to its target, so the words
taken equal the target but for rounding to a whole word.

Edge cases: bytes that are not UTF-8 count as U+FFFD.  A null source is a source of its own, after all others.  A null
text, an empty one or one of white space has size 0 and is never taken.
Repeated rows are laid out, and counted, once each.  Rows without an identifier
are told apart by their text.  An empty table gives no
rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import WORD, look_up, row_key, row_name, settle, shuffle_partitions, text_or_empty

#: Odd integer next to 2**64 / golden ratio: the Weyl step of the schedule.
GOLDEN_STEP = 0x9E3779B97F4A7C15
_TURN = 1 << 64
#: Slots of a source that one stretch generates, and documents that one slice of a source should hold.
STRETCH = 1 << 18
ROWS_PER_SLICE = 200_000


def floor_sum(n: int, m: int, a: int, b: int) -> int:
    """The sum of floor((a * i + b) / m) for 0 <= i < n."""
    total = 0
    while True:
        total += (n - 1) * n // 2 * (a // m) + n * (b // m)
        a, b = a % m, b % m
        top = a * n + b
        if top < m:
            return total
        n, b = divmod(top, m)
        m, a = a, m


def slots_before(t: int, low: int, high: int, shift: int) -> int:
    """Of slots 0 .. t-1, those whose point lies in [low, high)."""
    if t == 0:
        return 0
    below = lambda x: floor_sum(t, _TURN, GOLDEN_STEP, shift) - floor_sum(t, _TURN, GOLDEN_STEP, shift + _TURN - x) + t
    return below(high) - below(low)


def first_hit(low: int, high: int, step: int = GOLDEN_STEP) -> int:
    """The least t >= 0 with ``low <= t * step mod 2**64 <= high``, for an odd step."""

    def solve(a: int, m: int, l: int, r: int) -> int:  # noqa: E741
        if l == 0:
            return 0
        if 2 * a > m:
            a, l, r = m - a, m - r, m - l  # noqa: E741
        t = -(-l // a)
        if t * a <= r:
            return t
        turns = solve(-m % a, a, l % a, r % a)
        return -(-(l + m * turns) // a)

    return solve(step, _TURN, low, high)


def slots_of(low: int, high: int, shift: int, first: int, count: int) -> np.ndarray:
    """The slots of ranks ``first`` to ``first + count - 1`` among those whose point lies in [low, high).

    A point x beyond ``low`` comes back into the interval after ``up`` slots
    where that leaves it inside, else after ``down``, else after both.
    """
    size = high - low
    if size >= _TURN:
        return np.arange(first, first + count, dtype=np.int64)
    if first:
        a, b = 0, (first + 200) * _TURN // size + 200
        while a < b:
            middle = (a + b) // 2
            a, b = (a, middle) if slots_before(middle + 1, low, high, shift) > first else (middle + 1, b)
    else:
        start = (low - shift) % _TURN
        a = 0 if start + size > _TURN else first_hit(start, start + size - 1)
    up, down = first_hit(1, size - 1), first_hit(1, size - 1, _TURN - GOLDEN_STEP)
    right, left = up * GOLDEN_STEP % _TURN, -down * GOLDEN_STEP % _TURN
    x, slots = (shift + a * GOLDEN_STEP) % _TURN - low, []
    for _ in range(count):
        slots.append(a)
        if x + right < size:
            x, a = x + right, a + up
        elif x >= left:
            x, a = x - left, a + down
        else:
            x, a = x + right - left, a + up + down
    return np.array(slots, dtype=np.int64)


_SLOTS = "slot long, source_index long, block long, epoch long, room long"


def _stretches(shift: int, block: int):
    """The slots of rows (source_index, before, slots, total, blocks, last, stretch)."""

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                low, high = (_TURN * n // r["total"] for n in (r["before"], r["before"] + r["slots"]))
                first = r["stretch"] * STRETCH
                rank = np.arange(first, min(r["slots"], first + STRETCH), dtype=np.int64)
                slot = slots_of(low, high, shift, first, len(rank))
                room = np.where(rank == r["slots"] - 1, r["last"], block)
                values = (slot, np.full(len(rank), r["source_index"]), rank % r["blocks"], rank // r["blocks"], room)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], [f.split()[0] for f in _SLOTS.split(", ")])

    return generate


def _running(table: DataFrame, value: Column) -> Column:
    """``value`` summed over the rows of ``table(part, at)`` before each one, parts in order; one row a part moves."""
    parts = table.groupBy("part").agg(F.sum(value).alias("sum")).collect()  # as many as the table has partitions
    sums, total = [], 0
    for r in sorted(parts, key=lambda r: r["part"]):
        sums += [F.lit(r["part"]), F.lit(total).cast("long")]
        total += r["sum"]
    within = F.sum(value).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.element_at(F.create_map(*sums), F.col("part")) if sums else F.lit(0).cast("long")
    return ahead + F.coalesce(within, F.lit(0))


def source_table(sized: DataFrame, weights: Sequence[float], share: float, max_repeats: float, block: int) -> DataFrame:
    """A row for each source of ``sized(source, key, size)``.

    Columns: source_index (by code point, null last), source, key, n (its
    documents), source_size, target, and its part in the schedule: words to take,
    blocks, slots, before (slots of earlier sources), last (words that its last
    slot may take).
    """
    by_name = F.col("source").asc_nulls_last()
    totals = sized.groupBy("source", "key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    dealt = totals.repartitionByRange(by_name).sortWithinPartitions(by_name)
    dealt = settle(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    indexed = settle(dealt.select("*", _running(dealt, F.lit(1)).alias("source_index")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_index") % len(weights) + 1).cast("int"))
    indexed = indexed.withColumn("weight", weight)

    # A target is its weight's share of what is left, or stops; the level rises until no further source stops.
    most = F.lit(float(max_repeats)) * F.col("source_size")
    all_words, level, stopped = indexed.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > most
        sums = indexed.groupBy("weight").agg(F.count_if(full).alias("full"), F.count_if(~full).alias("open"), F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("words")).collect()
        now, room = sum(r["full"] for r in sums), sum(r["weight"] * r["open"] for r in sorted(sums, key=lambda r: r["weight"]))
        if now == stopped or not room:
            break
        stopped, level = now, (share * all_words - max_repeats * sum(r["words"] for r in sums)) / room
    full = F.col("weight") * F.lit(level) > most
    words = F.col("source_size")
    rows = indexed.withColumn("target", F.when(full, most).otherwise(F.col("weight") * F.lit(level)))
    rows = rows.withColumn("take", F.least(F.floor(F.col("target") + 0.5), F.floor(most)))
    rows = rows.withColumn("blocks", F.ceil(words / block)).withColumn("rest", F.when(words > 0, F.col("take") % words).otherwise(0))
    turns = F.when(words > 0, F.floor((F.col("take") - F.col("rest")) / words)).otherwise(0)
    rows = rows.withColumn("slots", turns * F.col("blocks") + F.ceil(F.col("rest") / block))
    rows = settle(rows.withColumn("last", F.when(F.col("rest") > 0, (F.col("rest") - 1) % block + 1).otherwise(block)))
    return settle(
        rows.select("source_index", "source", "key", "n", "source_size", "target", "take", "blocks", "slots", _running(rows, F.col("slots")).alias("before"), "last")
    )


@dataclass(frozen=True)
class Mixture:
    """documents: a row each, with its source's columns and its place; sources: ``source_table``; takes: what each slot takes."""

    documents: DataFrame
    sources: DataFrame
    takes: DataFrame


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_repeats: float = 2.0,
    block_words: int = 256,
    seed: int = 7,
) -> Mixture:
    """The schedule for ``docs(doc_id, source, text)``.

    ``weights`` repeat over the sources in code-point order, null last.
    ``takes`` has a row for each part of a document that a slot takes: slot,
    epoch, source_index, doc_id, place (words before the document in its
    source's stream), start and length (words, within the document).  Ordered
    by slot it is the mixed stream.
    """
    spark = docs.sparkSession
    source = F.col("source").cast("string")
    sized = settle(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            source.alias("source"),
            F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"),
            F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
            row_key().alias("row_key"),
        )
    )
    sources = source_table(sized, weights, share, max_repeats, block_words)
    total_slots, largest, n_sources = sources.agg(F.sum("slots"), F.max("n"), F.count("*")).first()
    slices = max(shuffle_partitions(spark), -(-(largest or 0) // ROWS_PER_SLICE))
    known = sources.select("key", "source_index", "source_size", "target")
    indexed = look_up(sized, known, ["key"], counts=sources.select("key", F.col("n").alias("_n")), bound=n_sources).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "row_key"))
    indexed = indexed.withColumn("_slice", F.pmod("_h", F.lit(slices)))
    ahead = indexed.groupBy("source_index", "_slice").agg(F.sum("size").alias("_n"))
    over = Window.partitionBy("source_index").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.select("source_index", "_slice", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("source_index", "_slice").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = indexed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ahead, ["source_index", "_slice"])
    place = (F.col("_ahead") + F.col("_in")).alias("place")
    documents = settle(placed.select("doc_id", "size", "source_index", "source", "source_size", "target", "row_key", place))

    b = F.lit(block_words)
    end = F.col("place") + F.col("size")
    pieces = (
        documents.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("place") / b), F.floor((end - 1) / b))))
        .select(
            "doc_id",
            "source_index",
            "place",
            "block",
            F.greatest(F.lit(0), F.col("block") * b - F.col("place")).alias("start"),
            F.greatest(F.lit(0), F.col("place") - F.col("block") * b).alias("inset"),
            (F.least(end, (F.col("block") + 1) * b) - F.greatest("place", F.col("block") * b)).alias("words"),
        )
    )
    shift = (seed * GOLDEN_STEP) % _TURN
    due = sources.where("slots > 0").select(
        "source_index", "before", "slots", F.lit(total_slots or 0).cast("long").alias("total"), "blocks", "last",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / STRETCH))).alias("stretch"),
    )
    slots = due.repartition("source_index", "stretch").mapInArrow(_stretches(shift, block_words), _SLOTS)
    # The planner takes the slots for as few as the stretches they come from, so it must be told to shuffle both sides.
    takes = (
        pieces.join(slots.hint("merge"), ["source_index", "block"])
        .withColumn("length", F.least("words", F.col("room") - F.col("inset")))
        .where("length > 0")
        .select("slot", "epoch", "source_index", "doc_id", "place", "start", "length")
    )
    return Mixture(documents, sources, takes)


def taken_words(mixture: Mixture) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), source, place, row_key."""
    known = ("size", "source_size", "target", "source", "row_key")
    taken = lambda of: of.select("source_index", "place", "doc_id", *known, F.lit(0).cast("long").alias("length"))
    some = taken(mixture.documents.where("size > 0"))
    parts = mixture.takes.select("source_index", "place", "doc_id", *[F.lit(None).cast(t).alias(c) for c, t in some.dtypes if c in known], "length")
    sums = some.unionByName(parts).groupBy("source_index", "place", "doc_id").agg(*[F.max(c).alias(c) for c in known], F.sum("length").alias("taken"))
    none = taken(mixture.documents.where("size = 0")).withColumnRenamed("length", "taken")
    return sums.unionByName(none).select("doc_id", "size", "source_size", "target", "taken", "source", "place", "row_key")


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes its words, to the nearest whole number of times.

    A source's slots take whole documents but for the one at which its target
    is reached, so the words of these rows stay within half a document of each
    source's target.  Rows that repeat identifier, text and source, or have no
    identifier and the same text, share what is taken of them evenly.
    """
    name = lambda doc_id, key, source: F.concat_ws(":", row_name(doc_id, key), F.xxhash64(source).cast("string"))
    known = F.col("source").cast("string")
    taken = taken_words(mix(docs, **parameters)).select(name(F.col("doc_id"), F.col("row_key"), known).alias("_name"), "size", "taken")
    share = F.floor(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1)) + 0.5).cast("int")
    times = settle(taken.groupBy("_name").agg(share.alias("_times"), F.count("*").alias("_n")))
    rows = docs.select(F.struct("*").alias("_row"), name(F.col("doc_id").cast("long"), row_key(), known).alias("_name"))
    copies = look_up(rows, times.where("_times > 0").select("_name", "_times"), ["_name"], counts=times.select("_name", "_n"))
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
