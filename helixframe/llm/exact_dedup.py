"""Exact deduplication by content sort.

Texts are equal when they are identical after each run of white space becomes
one space.  Rows are range-partitioned by sampled splitters and sorted within
each partition by the whole normalised text and the identifier, with Spark's
spilling sort, so equal texts are neighbours.  One pass per partition compares
each normalised text in full with the one before it.  The splitter key is a
text's first ``HEAD_CHARS`` characters, its digest and the identifier: of
bounded length, so what the driver samples does not grow with the texts, and
with the identifier in it, so a text that fills a third of the table is spread
over many partitions.

Only the texts with the least and the greatest splitter key of a partition can
go on in another one.  Each partition names these two with their texts; those
that are equal in full are one group.

Edge cases: a null text counts as empty and equals other empty texts; bytes that
are not UTF-8 count as U+FFFD.  A null identifier ranks after every other one.
Of rows that repeat identifier and text, one stays.  An empty table gives no
rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import SPACES, look_up, settle, text_or_empty

#: Characters of the normalised text in the splitter key.
HEAD_CHARS = 32

_SCHEMA = "doc_id long, text_sha256 string, run long, first boolean, local_keep long, local_size long, end_text string"
#: A run's number holds the task's partition above this many bits.
_COUNTER_BITS = 33
#: Rows that one output batch collects.
_ROWS_OUT = 1 << 16
#: Runs that go on in other partitions, two a partition at most and a few numbers each: so many are broadcast.
_BROADCAST_ROWS = 100_000


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours; of an open run, only copied identifiers and one text are held."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << _COUNTER_BITS
    held: list[pa.Array] = []
    body, digest = None, None
    ends: dict[str, tuple] = {}
    out: list[pa.RecordBatch] = []
    waiting = 0

    def close() -> None:
        """The open run as rows, and as an end of the partition if none lies further out."""
        nonlocal number, waiting
        ids, key = pa.concat_arrays(held), (body[:HEAD_CHARS], digest)
        keep, n = ids[0].as_py(), len(ids)
        if not ends or key < ends["least"][0]:
            ends["least"] = (key, number, keep, n, body)
        if "most" not in ends or key > ends["most"][0]:
            ends["most"] = (key, number, keep, n, body)
        first = np.zeros(n, dtype=bool)
        first[0] = True
        one = lambda value, kind: pa.repeat(pa.scalar(value, kind), n)
        values = [ids, one(digest, pa.string()), one(number, pa.int64()), pa.array(first), one(keep, pa.int64()), one(n, pa.int64()), one(None, pa.string())]
        out.append(pa.RecordBatch.from_arrays(values, _NAMES))
        number, waiting = number + 1, waiting + n

    def flushed() -> pa.RecordBatch:
        nonlocal waiting
        made = pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        out.clear()
        waiting = 0
        return made

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, texts, digests = batch.column("doc_id"), batch.column("norm"), batch.column("text_sha256")
        differs = np.ones(n, dtype=bool)
        differs[0] = body is None or body != texts[0].as_py()
        if n > 1:
            differs[1:] = pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(differs).tolist()
        # Taken, not sliced: a slice would keep the whole batch with its texts.
        copied = lambda a, b: ids.take(pa.array(np.arange(a, b)))
        if not cuts or cuts[0] > 0:
            held.append(copied(0, cuts[0] if cuts else n))
        for i, at in enumerate(cuts):
            if held:
                close()
            body, digest, held = texts[at].as_py(), digests[at].as_py(), [copied(at, cuts[i + 1] if i + 1 < len(cuts) else n)]
            if waiting >= _ROWS_OUT:
                yield flushed()
    if held:
        close()
        named = {e[1]: e for e in ends.values()}.values()
        columns = zip(*[(None, key[1], run, False, keep, size, text) for key, run, keep, size, text in named], strict=True)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
        out.append(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES))
        yield flushed()


_NAMES = [field.split()[0] for field in _SCHEMA.split(", ")]


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = F.regexp_replace(text_or_empty(), SPACES, " ")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm")).withColumns(
        {
            "head": F.substring("norm", 1, HEAD_CHARS),
            "text_sha256": F.sha2(F.col("norm"), 256),
        }
    )
    order = F.col("doc_id").asc_nulls_last()
    dealt = keyed.repartitionByRange("head", "text_sha256", order).sortWithinPartitions("norm", order)
    made = settle(dealt.select("doc_id", "text_sha256", "norm").mapInArrow(_neighbours, _SCHEMA))

    ends = made.where("end_text is not null").groupBy("end_text")
    ends = ends.agg(F.sum("local_size").alias("size"), F.min_by("local_keep", "run").alias("keep"), F.min("run").alias("start"), F.collect_list("run").alias("runs"))
    longer = settle(ends.where(F.size("runs") > 1).select(F.explode("runs").alias("run"), "size", "keep", "start"))
    rows = made.where("end_text is null")
    if longer.count() <= _BROADCAST_ROWS:
        rows = rows.join(F.broadcast(longer), "run", "left")
    else:
        rows = look_up(rows, longer, ["run"], "left")
    return rows.select(
        "doc_id",
        F.when(F.col("start").isNull(), F.col("local_keep")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", "local_size").alias("group_size"),
        (F.col("first") & (F.col("start").isNull() | (F.col("start") == F.col("run")))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns."""
    name = lambda doc_id, sha: F.concat_ws(":", doc_id.cast("string"), sha)
    kept = exact_groups(docs).where("kept").select(name(F.col("doc_id"), F.col("text_sha256")).alias("_name"))
    own = F.sha2(F.regexp_replace(text_or_empty(), SPACES, " "), 256)
    rows = docs.select(F.struct("*").alias("_row"), name(F.col("doc_id").cast("long"), own).alias("_name"))
    # Rows that repeat identifier and text share a name; the join's partitioning serves to drop them, too.
    return rows.join(kept, "_name", "left_semi").dropDuplicates(["_name"]).select("_row.*")
