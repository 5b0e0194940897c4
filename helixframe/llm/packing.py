"""Packing by power-of-two decomposition.

Every document is cut into pieces whose lengths are the binary digits of its
token count (as many whole ``max_length`` pieces as fit, then one piece per set
bit of the rest, longest first).  A piece is a sequence by itself: none crosses
a document, and none needs padding because its length is a power of two.
Pieces of one length form a bucket; a batch drawn from one bucket is
rectangular, and ``write_buckets`` lays a folder out per bucket.

Each document is cut where it is read: nothing is shuffled, and numbers are
given out per task, so the operator's cost is the tokenizer's.

Edge cases: bytes that are not UTF-8 count as U+FFFD.  A null or empty text is the end-of-document id alone, one piece of
length 1.  Repeated rows are packed once each.  An empty table gives no rows.
Extra columns are ignored.  Special-token strings inside a text are read as the
tokenizer reads them by default.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import in_slices, text_or_empty

#: A sequence's number holds the task's partition above this many bits.
COUNTER_BITS = 33


@lru_cache(maxsize=4)
def _encoder(vocabulary: str, ranks: str | None):
    """encode(text) -> uint32 ids, built once per Python worker.

    ``vocabulary`` is a tokenizers JSON file.  ``ranks`` may name the same
    vocabulary as a rank file; tiktoken then does the ordinary texts several
    times as fast, and texts that hold a special token's string, which the two
    libraries treat differently, still go through ``vocabulary``.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def plain(text: str) -> np.ndarray:
        return np.asarray(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    if ranks is None:
        return plain

    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return plain(text)
        return quick.encode_to_numpy(text).astype(np.uint32, copy=False)

    return encode


def piece_lengths(tokens: int, max_length: int) -> list[int]:
    """Lengths of the pieces of a document of ``tokens`` ids, in order."""
    whole, rest = divmod(tokens, max_length)
    return [max_length] * whole + [1 << b for b in range(max_length.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(vocabulary: str, ranks: str | None, max_length: int, end_id: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = _encoder(vocabulary, ranks), TaskContext.get()
        number = (context.partitionId() if context else 0) << COUNTER_BITS
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "sequence_id", "offset"] + ["input_ids"] * with_ids
        for batch in in_slices(batches):
            owners, starts, lengths, sums, totals, ids = [], [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tokens = np.append(encode(text), np.uint32(end_id)).astype("<u4", copy=False)
                view, at = memoryview(tokens.tobytes()), 0
                for length in piece_lengths(len(tokens), max_length):
                    owners.append(doc_id)
                    starts.append(at)
                    lengths.append(length)
                    sums.append(zlib.crc32(view[4 * at : 4 * (at + length)]))
                    totals.append(len(tokens))
                    if with_ids:
                        ids.append(tokens[at : at + length].astype(np.int32))
                    at += length
            sizes = np.array(lengths, dtype=np.int64)
            buckets = np.log2(np.maximum(sizes, 1)).round().astype(np.int64)
            numbers = number + np.arange(len(sizes), dtype=np.int64)
            number += len(sizes)
            columns = [pa.array(x, pa.int64()) for x in (owners, starts, sizes, sums, totals, buckets, numbers, np.zeros(len(sizes), dtype=np.int64))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)

    return cut


def pack_power_of_two(
    docs: DataFrame,
    vocabulary: str,
    ranks: str | None = None,
    max_length: int = 1024,
    end_id: int = 0,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, bucket (log2 of the
    length), sequence_id, offset (0: a sequence is one piece) and, if
    ``with_ids``, input_ids.  A sequence's number is its task's partition and a
    running count, unique whichever attempt of the task is kept.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "sequence_id", "offset")
    fields = [T.StructField(n, T.LongType()) for n in names]
    fields += [T.StructField("input_ids", T.ArrayType(T.IntegerType()))] * with_ids
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(_pieces(vocabulary, ranks, max_length, end_id, with_ids), T.StructType(fields))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per bucket under ``path``; every file in it holds sequences of one length."""
    packed.write.mode("overwrite").partitionBy("bucket").parquet(path)
