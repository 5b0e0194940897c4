import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from helixframe.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_floor_sum_and_slots():
    for n, m, a, b in ((10, 7, 3, 2), (1, 5, 0, 4), (100, 1 << 64, mixing.GOLDEN_STEP, 12345), (57, 13, 40, 99)):
        assert mixing.floor_sum(n, m, a, b) == sum((a * i + b) // m for i in range(n))
    low, high, shift = 1 << 61, 1 << 63, 987654321 << 20
    points = [(shift + t * mixing.GOLDEN_STEP) % (1 << 64) for t in range(500)]
    for t in (0, 1, 17, 500):
        assert mixing.slots_before(t, low, high, shift) == sum(low <= p < high for p in points[:t])
    assert mixing.slots_before(500, 0, 1 << 64, shift) == 500


def slow_targets(sizes, weights, share, most):
    """Targets by weight, stopped at ``most`` times a size, the excess shared again by weight."""
    left, open_, targets = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        for i in full or open_:
            targets[i] = float(most * sizes[i]) if full else unit * weights[i]
        if not full:
            break
        left -= sum(targets[i] for i in full)
        open_ -= full
    return targets


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000], [0, 0], [], [1, 1000, 3, 3000, 0, 7, 90, 20, 5, 600] * 20])
def test_sources(spark, sizes):
    rows = [(f"s{i:04}", f"=s{i:04}", n) for i, n in enumerate(sizes)]
    got = sorted(mixing.source_table(spark.createDataFrame(rows, "source string, key string, size long"), (3, 1, 2), 1.5, 2, 16).collect(), key=lambda r: r["source_index"])
    assert [(r["source_index"], r["source"], r["source_size"]) for r in got] == [(i, s, n) for i, (s, _, n) in enumerate(rows)]
    want = slow_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5, 2)
    assert [r["target"] for r in got] == pytest.approx(want)
    run = 0
    for r, t in zip(got, want, strict=True):
        take = min(math.floor(t + 0.5), 2 * r["source_size"])
        turns, rest = divmod(take, r["source_size"]) if r["source_size"] else (0, 0)
        blocks = -(-r["source_size"] // 16)
        assert (r["take"], r["blocks"], r["slots"], r["before"]) == (take, blocks, turns * blocks + -(-rest // 16), run)
        assert r["last"] == ((rest - 1) % 16 + 1 if rest else 16)
        run += r["slots"]


def test_more_sources_than_documents_have_words(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('s', id) as source", "repeat('w ', cast(id % 5 as int)) as text")
    rows = mixing.taken_words(mixing.mix(docs)).collect()
    want = slow_targets([int(r) % 5 for r in sorted(map(str, range(3000)))], [(3, 1, 2)[i % 3] for i in range(3000)], 1.5, 2)
    got = sorted((r["source"], r["target"], r["taken"]) for r in rows)
    assert [t for _, t, _ in got] == pytest.approx(want) and all(abs(t - n) <= 0.5 for _, t, n in got)


@pytest.mark.parametrize("low, high", [(0, 1 << 64), (0, 1 << 63), (1 << 60, (1 << 60) + (1 << 58)), ((1 << 64) - (1 << 57), 1 << 64), (123456789 << 32, (123456789 << 32) + (1 << 55))])
def test_slots_equal_the_slow_schedule(low, high):
    shift = (7 * mixing.GOLDEN_STEP) % (1 << 64)
    want = [t for t in range(200_000) if low <= (shift + t * mixing.GOLDEN_STEP) % (1 << 64) < high]
    assert len(want) > 60
    for first, count in ((0, 1), (0, 60), (1, 20), (37, 23)):
        assert mixing.slots_of(low, high, shift, first, count).tolist() == want[first : first + count]
    assert mixing.slots_of(low, high, shift, 0, len(want)).tolist() == want


def test_stretches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(mixing, "STRETCH", 64)
    rows = [(0, 0, 150, 63, 8), (1, 150, 5, 3, 16), (2, 155, 300, 40, 16)]
    due = [dict(zip(("source_index", "before", "slots", "blocks", "last"), r, strict=True)) | {"total": 455, "stretch": k} for r in rows for k in range(-(-r[2] // 64))]
    got = [tuple(r.values()) for b in mixing._stretches(99, 16)(iter([pa.RecordBatch.from_pylist(due)])) for r in b.to_pylist()]
    for i, before, slots, blocks, last in rows:
        low, high = ((1 << 64) * n // 455 for n in (before, before + slots))
        hits = [t for t in range(2000) if low <= (99 + t * mixing.GOLDEN_STEP) % (1 << 64) < high][:slots]
        want = [(t, i, k % blocks, k // blocks, last if k == slots - 1 else 16) for k, t in enumerate(hits)]
        assert sorted(r for r in got if r[1] == i) == want
    assert len({r[0] for r in got}) == 455


@pytest.mark.parametrize("which", ["docs", "edge", "clashing"])
@pytest.mark.parametrize("block", [256, 7])
def test_words_taken(request, which, block):
    df = request.getfixturevalue(which)
    given = df.select("doc_id", "source", "text").collect()
    sizes = defaultdict(int)
    for r in given:
        sizes[r["source"]] += words(r["text"])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, slow_targets([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2), strict=True))
    mixture = mixing.mix(df, block_words=block)
    rows = mixing.taken_words(mixture).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], words(r["text"])) for r in given)
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in order)
    again = mixing.taken_words(mixing.mix(df, block_words=block)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    takes = mixture.takes.collect()
    in_slot = Counter()
    for r in takes:
        in_slot[r["slot"]] += r["length"]
        assert 0 <= r["start"] and r["length"] > 0
    assert max(in_slot.values(), default=0) <= block and len({r["source_index"] for r in takes if r["slot"] == 0}) <= 1


def test_sources_alternate_evenly(docs):
    mixture = mixing.mix(docs, block_words=16)
    rows = sorted({(r["slot"], r["source_index"]) for r in mixture.takes.select("slot", "source_index").collect()})
    share = Counter(s for _, s in rows)
    seen = Counter()
    for n, (_, s) in enumerate(rows, 1):
        seen[s] += 1
        assert abs(seen[s] - n * share[s] / len(rows)) < 5 + 2 * math.log(len(rows))


@pytest.mark.parametrize("which", ["docs", "edge", "clashing"])
def test_mixed_documents(request, which):
    df = request.getfixturevalue(which)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    name = lambda r: (r["doc_id"], r["source"], words(r["text"]))
    given, taken, total = Counter(map(name, df.collect())), Counter(), Counter()
    for r in mixing.taken_words(mixing.mix(df)).collect():
        key = (r["doc_id"], r["source"], r["size"])
        taken[key] += r["taken"]
        total[key] += r["size"]
    want = {k: n * int(np.floor(taken[k] / max(total[k], 1) + 0.5)) for k, n in given.items()}
    assert Counter(map(name, mixed.collect())) == Counter({k: n for k, n in want.items() if n})
    if which != "docs":
        assert any(r["doc_id"] is None for r in mixed.collect())


def test_mix_of_no_rows(docs):
    assert mixing.mixed_documents(docs.limit(0)).collect() == [] and mixing.taken_words(mixing.mix(docs.limit(0))).collect() == []
