import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from conftest import texts_of

from helixframe.llm import exact_dedup, graph, simhash


def groups_by_text(df):
    groups = defaultdict(list)
    for i, t in texts_of(df):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    return groups


@pytest.mark.parametrize("which", ["docs", "edge", "clashing"])
def test_exact_groups(request, which):
    df = request.getfixturevalue(which)
    groups = groups_by_text(df)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    want = sorted(((i, least(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids), key=str)
    rows = exact_dedup.exact_groups(df).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str) == want
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    left = exact_dedup.drop_exact_copies(df)
    assert left.columns == df.columns
    assert sorted((re.sub(r"[\x20\x09-\x0D]+", " ", t), str(i)) for i, t in texts_of(left)) == sorted((t, str(least(ids))) for t, ids in groups.items())


def test_a_group_over_many_partitions(spark):
    rows = [(i, "the same text") for i in range(3000)] + [(3000 + i, f"other {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = exact_dedup.exact_groups(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    same = [r for r in got if r["doc_id"] < 3000]
    assert {(r["keep_id"], r["group_size"]) for r in same} == {(0, 3000)}
    assert sum(r["kept"] for r in same) == 1 and sum(r["kept"] for r in got) == 201


def test_empty_tables(edge):
    none = edge.limit(0)
    assert exact_dedup.exact_groups(none).collect() == [] and exact_dedup.drop_exact_copies(none).collect() == []
    assert simhash.near_duplicates(none).collect() == [] and simhash.keep_one_of_each(none).collect() == []


def slow_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, distance=2):
    """prints: (doc_id, print); the smallest identifier that links reach."""
    parent = {i: i for i, _ in prints}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in prints:
        for b, y in prints:
            if (x ^ y).bit_count() <= distance and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i, _ in prints}


@pytest.mark.parametrize("which", ["docs", "edge", "clashing"])
def test_fingerprints_and_components(request, which):
    df = request.getfixturevalue(which)
    prints = [(i, slow_print(t)) for i, t in texts_of(df)]
    rows = simhash.near_duplicates(df).collect()
    assert sorted(((r["doc_id"], r["fingerprint"]) for r in rows), key=str) == sorted(((i, f"{p:016x}") for i, p in prints), key=str)
    want = slow_components([(i, p) for i, p in prints if i is not None])
    assert all(r["component_id"] == want[r["doc_id"]] for r in rows if r["doc_id"] is not None)


@pytest.mark.parametrize("group_rows", [4096, 3])
@pytest.mark.parametrize("distance", [1, 2])
def test_links_are_exact_with_crowded_keys_too(spark, group_rows, distance):
    rng = random.Random(group_rows)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1, 1 << 63}
    rows = [(i, p - (1 << 64) * (p >> 63)) for i, p in enumerate(sorted(prints))]
    nodes = spark.createDataFrame(rows, "node long, print long")
    links = simhash.links_within(nodes, distance, group_rows=group_rows)
    found = {r["node"]: r["component"] for r in graph.components(links).collect()}
    want = slow_components([(i, p % (1 << 64)) for i, p in rows], distance)
    assert {i: found.get(i, i) for i, _ in rows} == want


def test_links_stay_fewer_than_rows_in_a_dense_group():
    rng = np.random.default_rng(1)
    dense = np.full((500, 1), 12345, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 20, (500, 1)).astype(np.uint64))
    assert len(simhash.linked_members(dense, 2)) == 499
    for size in (20, 500):
        links = simhash._links_of(np.arange(size), dense[:size], np.array([0, size]), 2)
        assert len(links) == size - 1


@pytest.mark.parametrize("tail", [0, 40, graph.TAIL_EDGES])
def test_components_of_chains_and_stars(spark, tail):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(7, 7), (None, 3), (161, 160)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long"), tail=tail).collect()}
    assert got == {i: 100 for i in range(100, 162)} | {i: 5 for i in [5, *range(200, 260)]}


def test_labels_that_one_task_finds():
    rng = np.random.default_rng(3)
    for n, m in ((2, 1), (50, 30), (400, 380), (400, 2000)):
        a, b = rng.integers(0, n, m) * 7 - 90, rng.integers(0, n, m) * 7 - 90
        nodes, labels = graph.joined_labels(a, b)
        least = {int(v): int(v) for v in nodes}
        while any(least[x] != least[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                least[x] = least[y] = min(least[x], least[y])
        assert dict(zip(nodes.tolist(), labels.tolist(), strict=True)) == least
    chain = rng.permutation(5000)
    assert (graph.joined_labels(chain[:-1], chain[1:])[1] == 0).all()


@pytest.mark.parametrize("which", ["edge", "clashing"])
def test_one_row_of_each_component_stays(request, which):
    df = request.getfixturevalue(which)
    component = {}
    for r in simhash.near_duplicates(df, **simhash.SIMILAR).collect():
        component[r["fingerprint"]] = r["component_id"]
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    whole = set(map(str, df.collect()))
    assert all(str(r) in whole for r in rows)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted({str(c) for c in component.values()})
    assert any(r["doc_id"] is None for r in rows)


def test_rows_without_identifier_meet_others(spark):
    same = " ".join(f"word{i}" for i in range(60))
    rows = [(None, same), (7, same), (None, "alone"), (None, "alone"), (3, "b"), (3, "c"), (3, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one_of_each(df).collect()), key=str)
    assert len(got) == 3 and (7, same) in got and (None, "alone") in got and sum(i == 3 for i, _ in got) == 1


WORDS = [f"w{i}" for i in range(4000)]


def near_copy(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = rng.choice(WORDS)
    return out


@pytest.mark.parametrize("group_rows", [4096, 8])
def test_similar_texts_meet_and_others_do_not(spark, group_rows):
    rng = random.Random(9)
    rows, partner, n = [], {}, 0
    for _ in range(60):
        base = rng.choices(WORDS, k=rng.randint(120, 400))
        for text in (base, near_copy(rng, base, max(1, len(base) // 100))):
            rows.append((n, " ".join(text)))
            partner[n] = n - n % 2
            n += 1
    crowd = rng.choices(WORDS, k=200)
    for _ in range(80):
        rows.append((n, " ".join(near_copy(rng, crowd, 2))))
        partner[n] = 120
        n += 1
    passage = " ".join(rng.choices(WORDS, k=60))
    for _ in range(40):
        rows.append((n, passage + " " + " ".join(rng.choices(WORDS, k=300))))
        partner[n] = n
        n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, **simhash.SIMILAR, group_rows=group_rows).collect()}
    assert got == partner
    kept = simhash.keep_one_of_each(df, group_rows=group_rows)
    assert {r["doc_id"] for r in kept.collect()} == set(partner.values()) and kept.columns == df.columns


def test_chance_company_in_a_block_ends(spark):
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, (20, 8), dtype=np.uint64)
    prints[:, 0] ^= (prints[:, 0] ^ np.uint64(7)) & np.uint64(0xFFFF)
    prints[1] = prints[0] ^ np.array([0, 1, 0, 0, 0, 0, 0, 0], dtype=np.uint64)
    nodes = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(prints)], "node long, print binary")
    links = simhash.links_by_block(nodes, 8, 32, 88, group_rows=8)
    assert {tuple(sorted(r)) for r in links.collect()} == {(0, 1)}


def wide_nodes(spark, prints):
    return spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(prints)], "node long, print binary")


def slow_wide_components(prints, max_distance):
    """Components of the pairs that share one of 32 blocks and lie within the distance."""
    label = list(range(len(prints)))
    blocks = prints.view(np.uint16)
    for i in range(len(prints)):
        for j in range(i):
            if (blocks[i] == blocks[j]).any() and int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= max_distance and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return dict(enumerate(label))


@pytest.mark.parametrize("seed", range(3))
def test_no_link_of_a_crowded_key_is_lost_to_another_or_to_a_representative(spark, seed):
    rng, random_ = random.Random(seed), np.random.default_rng(seed)
    rows = []
    for _ in range(12):  # chains whose ends are too far apart: a~b share one crowded block, b~c another
        b = random_.integers(0, 1 << 63, 8, dtype=np.uint64)
        b.view(np.uint16)[:2] = 7, 9
        a, c = b.copy(), b.copy()
        for other, block in ((a, 0), (c, 1)):
            for i in range(32):
                if i != block:
                    other.view(np.uint16)[i] ^= np.uint16(sum(1 << x for x in rng.sample(range(16), 2)))
        rows += [a, b, c]
    for value, block in ((7, 0), (9, 1)):  # company by chance
        for _ in range(30):
            alone = random_.integers(0, 1 << 63, 8, dtype=np.uint64)
            alone.view(np.uint16)[block] = value
            rows.append(alone)
    prints = np.array(rows)
    links = simhash.links_by_block(wide_nodes(spark, prints), 8, 32, 88, group_rows=8)
    found = {r["node"]: r["component"] for r in graph.components(links).collect()}
    want = slow_wide_components(prints, 88)
    assert len(set(want.values())) == 12 + 60
    assert {i: found.get(i, i) for i in want} == want


def test_pairs_whose_one_common_block_is_crowded_and_the_last(spark):
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 256, (80, 64), dtype=np.uint8)
    others = [i for i in range(64) if i not in (15, 47)]  # block 47 is bytes 15 and 47
    for i in range(1, 40, 2):  # 62 bits apart, and no other block in common
        prints[i] = prints[i - 1]
        prints[i, others] ^= np.uint8(1) << rng.integers(0, 8, 62).astype(np.uint8)
    prints[:, [15, 47]] = 7
    links = simhash.links_by_block(wide_nodes(spark, prints.view(np.uint64)), 8, 32, 88, group_rows=8, strided=16)
    assert {tuple(sorted(r)) for r in links.collect()} == {(i - 1, i) for i in range(1, 40, 2)}


def test_rows_without_identifier_link_and_bridge(spark):
    base = 0x0123456789ABCDEF
    bridge = [(5, base), (None, base ^ 3), (9, base ^ 15), (None, ~base), (None, ~base ^ 1)]
    text = {p: i for i, (_, p) in enumerate(bridge)}
    made = spark.createDataFrame(bridge, "doc_id long, print long")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(simhash, "fingerprints", lambda *_: made)
        got = {text[int(r["fingerprint"], 16) - (1 << 64) * (int(r["fingerprint"], 16) >> 63)]: r["component_id"] for r in simhash.near_duplicates(made).collect()}
    assert got == {0: 5, 1: 5, 2: 5, 3: None, 4: None}


def test_near_copies_without_identifier_leave_one(spark):
    rng = random.Random(11)
    one, two = (rng.choices(WORDS, k=300) for _ in range(2))
    rows = [(None, " ".join(near_copy(rng, one, 2))) for _ in range(4)] + [(None, " ".join(near_copy(rng, two, 2))) for _ in range(3)] + [(8, " ".join(two))]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["8", "None"]


def wide_chain(rng, length, bits):
    """Prints of which neighbours differ in so many bits, all outside block 0, in which they agree; others are further apart."""
    rows = [rng.integers(0, 256, 64, dtype=np.uint8)]
    for i in range(length - 1):
        flips = np.zeros(512, dtype=np.uint8)
        flips[16 + (np.arange(bits) * 7 + i * 97) % 496] = 1
        rows.append(rows[-1] ^ np.packbits(flips, bitorder="little"))
    return np.array(rows).view(np.uint64)


@pytest.mark.parametrize("group_rows", [64, 4096])
def test_a_chain_in_one_crowded_block_stays_whole(spark, group_rows):
    prints = wide_chain(np.random.default_rng(6), 200, 62)
    links = simhash.links_by_block(wide_nodes(spark, prints), 8, 32, 88, group_rows=group_rows)
    found = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert found == dict.fromkeys(range(200), 0)


@pytest.mark.parametrize("group_rows", [64, 4096])
def test_links_of_many_near_copies_are_about_as_many_as_the_copies(spark, group_rows):
    rng = np.random.default_rng(7)
    flips = np.packbits(rng.random((2000, 512)) < 0.05, axis=1, bitorder="little")
    prints = np.ascontiguousarray(flips ^ rng.integers(0, 256, 64, dtype=np.uint8)).view(np.uint64)
    links = simhash.links_by_block(wide_nodes(spark, prints), 8, 32, 88, group_rows=group_rows, strided=16).collect()
    assert len(links) <= 2 * len(prints)
    label = list(range(len(prints)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        label[max(top(a), top(b))] = min(top(a), top(b))
    assert {top(i) for i in range(len(prints))} == {0}


def test_wider_blocks_find_as_many_pairs():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 256, (4000, 64), dtype=np.uint8)
    b = a ^ np.packbits(rng.random((4000, 512)) < 0.15, axis=1, bitorder="little")
    shared = {}
    for texts in (1, 1 << 30, 1 << 36):
        places = simhash.blocks_for(texts, 8, 32, 16)
        numbers = list(range(len(places)))
        x, y = (simhash._keys_of([p.tobytes() for p in side], places, numbers, len(places)) for side in (a, b))
        shared[len(places[0])] = float((x == y).any(axis=1).mean())
    assert set(shared) == {16, 21, 27} and min(shared.values()) > 0.93 and max(shared.values()) - min(shared.values()) < 0.03


def test_what_a_run_holds_does_not_grow_with_its_texts():
    import pyarrow as pa

    def batches(text):
        for at in range(0, 2000, 100):
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + 100)), pa.array([text] * 100), pa.array(["x"] * 100)], ["doc_id", "norm", "text_sha256"])

    def most(text):
        pool, least = pa.total_allocated_bytes(), []
        source = batches(text)

        def watched():
            for b in source:
                yield b
                least.append(pa.total_allocated_bytes() - pool - b.nbytes)

        rows = pa.Table.from_batches(list(exact_dedup._neighbours(watched())))
        assert rows.num_rows == 2001 and rows["local_size"].to_pylist()[:2000] == [2000] * 2000
        return max(least)

    assert most("x" * 20000) < most("x") + 3_000_000


def test_texts_that_are_not_utf8(spark):
    df = spark.sql("select * from values (1, cast(unhex('61FF62') as string)), (2, cast(unhex('61FE62') as string)), (3, cast(unhex('C3A9') as string)) as t(doc_id, text)")
    assert {(r["doc_id"], r["keep_id"]) for r in exact_dedup.exact_groups(df).collect()} == {(1, 1), (2, 1), (3, 3)}
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(df).collect()}
    assert got == {1: f"{slow_print('a\ufffdb'):016x}", 2: f"{slow_print('a\ufffdb'):016x}", 3: f"{slow_print('é'):016x}"}
