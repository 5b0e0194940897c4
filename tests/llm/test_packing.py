import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import texts_of
from tokenizers import Tokenizer

from helixframe.llm import packing

VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pack(df, **kw):
    return packing.pack_power_of_two(df, VOCABULARY, RANKS, **kw)


def test_lengths():
    assert packing.piece_lengths(2048 + 5, 1024) == [1024, 1024, 4, 1]
    for n in range(1, 3000, 7):
        got = packing.piece_lengths(n, 1024)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 1024 for x in got)


@pytest.mark.parametrize("which", ["docs", "edge", "clashing"])
def test_round_trip(request, which):
    df = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = pack(df).collect()
    want = Counter((i, tuple([*tokenizer.encode(t, add_special_tokens=False).ids, 0])) for i, t in texts_of(df))
    pieces = defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["input_ids"]) == 1 << r["bucket"] <= 1024 and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["input_ids"], dtype="<u4").tobytes())
        pieces[r["doc_id"], r["start"]].append(tuple(r["input_ids"]))
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for (doc_id, ids), copies in want.items():
        at = 0
        for n in packing.piece_lengths(len(ids), 1024):
            assert pieces[doc_id, at].count(ids[at : at + n]) >= copies
            at += n
    assert sum(map(len, pieces.values())) == sum(len(packing.piece_lengths(len(ids), 1024)) * n for (_, ids), n in want.items())


def test_same_ids_with_and_without_ranks(edge):
    cut = lambda ranks: sorted(map(str, packing.pack_power_of_two(edge, VOCABULARY, ranks).drop("sequence_id").collect()))
    assert cut(RANKS) == cut(None)


def test_empty_table_and_parameters(edge):
    assert pack(edge.limit(0)).collect() == []
    with pytest.raises(ValueError):
        pack(edge, max_length=1000)


def test_buckets_on_disk(spark, edge, tmp_path):
    packing.write_buckets(pack(edge), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("length <> pow(2, bucket)").count() == 0 and back.count() == pack(edge).count()
