"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans.lineage import settle, shared_folder  # noqa: F401

#: One run of white space, and one word, as the contracts define them.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(column: str = "text") -> Column:
    """The text, empty where it is null; bytes that are not UTF-8 become U+FFFD, so that Python can read every text."""
    return F.coalesce(F.make_valid_utf8(F.col(column).cast("string")), F.lit(""))


def row_key() -> Column:
    """A long that tells rows of (doc_id, text) apart; equal rows share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_or_empty())


def row_name(doc_id: Column, key: Column) -> Column:
    """Identifier, if any, and ``row_key`` as one value to join on, the same for equal rows only."""
    return F.concat_ws(":", doc_id.cast("string"), key.cast("string"))


#: Keys that ``look_up`` sends to all tasks: no more than this, whatever the tables' sizes.
HOT_KEYS = 1000


#: Rows of a few numbers each that are broadcast whole, when a count has shown that there are no more.
BROADCAST_ROWS = 100_000
#: Rows of a few numbers each that make a task worth its start.
TASK_ROWS = 50_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has at most ``rows`` short rows, in as many partitions as these are worth."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def look_up(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None, bound: int | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has each key of ``on`` once, without gathering a frequent key's rows.

    A table of a few numbers a row, for which ``bound`` says that it has at most
    ``BROADCAST_ROWS`` rows, is broadcast.  Of any other one the ``HOT_KEYS``
    keys with the most rows are, and their rows dealt out evenly; any other key
    has less than a thousandth of the rows.  ``counts`` may give the keys'
    numbers of rows, or bounds on them, as ``_n``.  ``how`` is inner or left.
    ``table`` is read more than once, so it should be settled.
    """
    if bound is not None and bound <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), on, how).select(*rows.columns, *[c for c in table.columns if c not in on])
    values = [c for c in table.columns if c not in on]
    if counts is None:
        counts = rows.groupBy(*on).agg(F.count("*").alias("_n"))
    top = counts.where("_n >= 32").orderBy(F.desc("_n"), *on).limit(HOT_KEYS).select(*on)
    hot = table.join(F.broadcast(top), on).select(*[F.col(c).alias(f"_on_{c}") for c in on], F.struct(F.lit(True), *values).alias("_hot"))
    same = [F.col(c) == F.col(f"_on_{c}") for c in on]
    marked = rows.join(F.broadcast(hot), same, "left").select(*rows.columns, "_hot")
    # A frequent key's rows have found their match: a salt that the table lacks spreads them.
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(8191)) + 1)
    cold = table.select(*[F.col(c).alias(f"_on_{c}") for c in on], F.lit(0).cast("long").alias("_of"), F.struct(F.lit(True), *values).alias("_cold"))
    joined = marked.withColumn("_salt", salt.cast("long")).join(cold, [*same, F.col("_salt") == F.col("_of")], "left")
    joined = joined.withColumn("_got", F.coalesce("_hot", "_cold"))
    if how == "inner":
        joined = joined.where("_got is not null")
    return joined.select(*rows.columns, *[F.col("_got")[c].alias(c) for c in values])


def hash_share(column: str, seed: int = 0) -> Column:
    """A long in [0, 2**32) that depends on the column's value and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << 32))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the identifier's decimal text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def labelled_rows(labels: DataFrame, label: str, fold: Column, limit: int, seed: int = 11) -> DataFrame:
    """At most about ``limit`` identifiers with a 0/1 label, outside the held-out fold.

    Rows that repeat an identifier count once, with the label that most of
    them carry (1 on a tie); rows with a null identifier or label are left
    out.  When there are more than ``limit``, a share chosen by a hash of the
    identifier stays, so reruns choose the same rows.
    """
    rows = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & fold)
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )
    total = rows.count()
    if total > limit:
        rows = rows.where(hash_share("doc_id", seed) < int((1 << 32) * limit / total))
    return rows


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, fold: Column, limit: int) -> DataFrame:
    """(doc_id, text, label) of the documents that ``labelled_rows`` names, one row an identifier.

    Where rows of ``docs`` repeat an identifier, the text whose hash is least
    stands for them, so no number of repeats makes the sample larger.
    """
    rows = F.broadcast(labelled_rows(labels, label, fold, limit).select(F.col("doc_id").alias("_id"), "label"))  # about limit rows
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(rows, F.col("doc_id") == F.col("_id"))
    return chosen.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))


#: Rows whose texts a Python worker holds as strings at a time.
ROWS_AT_ONCE = 512


def texts_of(column: pa.Array) -> list[str]:
    """A column's texts, as ``text_or_empty`` would give them."""
    raw = column.cast(pa.binary()).to_pylist()
    return ["" if t is None else t.decode("utf-8", "replace") for t in raw]


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that few texts are Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def partial_sums(table: np.ndarray, slices: int = 32) -> Iterator[pa.RecordBatch]:
    """A task's table of numbers as rows (slice, part) for ``summed``."""
    parts = [p.tobytes() for p in np.split(table.ravel(), slices)]
    yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array(parts, pa.binary())], ["slice", "part"])


def summed(partials: DataFrame, kind: type) -> np.ndarray:
    """The sum of the tables that tasks sent by ``partial_sums``, added up on the executors slice by slice."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p, dtype=kind).astype(np.float64) for p in table.column("part").to_pylist())
        return pa.table({"slice": table.column("slice").slice(0, 1).cast(pa.int32()), "part": pa.array([total.astype(kind).tobytes()], pa.binary())})

    rows = partials.groupBy("slice").applyInArrow(add, "slice int, part binary").collect()
    rows.sort(key=lambda r: r["slice"])
    return np.concatenate([np.frombuffer(r["part"], dtype=kind) for r in rows]) if rows else np.empty(0, dtype=kind)
