"""Near-duplicate detection with SimHash fingerprints and pigeonhole blocks.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word
shingles.  It is split into blocks; two fingerprints that differ in at most
``max_distance`` bits agree on all but that many blocks, so they share a key
made of any ``len(blocks) - max_distance`` agreeing blocks.  Fingerprints are
dealt by key, compared within a key, and linked where the Hamming distance
allows.  Equal fingerprints are one node throughout, however many rows have
them.

Within a key no list of pairs is made: a search visits the key's members, and
each member it reaches gives one link.  A key with more than ``group_rows``
members never meets in one task: there each member gives the fingerprints one
bit away from its own, outside the shared blocks, and members that meet on one
of those are at most two bits apart.  At most 65 fingerprints can meet on one,
so these groups are small by construction, and the result is the same.

Edge cases: bytes that are not UTF-8 count as U+FFFD.  A null or empty text, or one of white space, has fingerprint zero
and is linked like any other.  A text of fewer words than a shingle is one
shingle.  Rows with a null identifier are linked like others; a component
that holds no identifier at all has a null one.  Repeated rows repeat in the
result.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import TASK_ROWS, few, in_slices, look_up, row_key, row_name, settle, text_or_empty
from helixframe.llm.graph import components

#: Members of a key that one task compares; larger keys take the other way.
GROUP_ROWS = 4096
_CHUNK = 1 << 16


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased text, repeats included."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(found)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    if len(found) < words:
        return np.array([digest(line, seed)], dtype=np.uint64)
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())], dtype=np.uint64)


def majority_bits(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """The fingerprint as ``lanes`` unsigned 64-bit integers.

    Lane 0 takes the hashes as they are; further lanes remix them with odd
    multipliers, which gives wider fingerprints from one hash per shingle.
    """
    out = np.zeros(lanes, dtype=np.uint64)
    if not len(hashes):
        return out
    for lane in range(lanes):
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), _CHUNK):
            part = hashes[at : at + _CHUNK]
            if lane:
                part = (part ^ (part >> np.uint64(29))) * np.uint64((0x9E3779B97F4A7C15 * (2 * lane + 1)) % (1 << 64) | 1)
                part = (part ^ (part >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                part ^= part >> np.uint64(31)
            counts += np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
                axis=0, dtype=np.int32
            )
        out[lane] = np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def _fingerprints(words: int, lanes: int, distinct: bool):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts = batch.column("text").to_pylist()
            hashes = (shingle_hashes(t, words) for t in texts)
            prints = [majority_bits(np.unique(h) if distinct else h, lanes) for h in hashes]
            if lanes == 1:
                column = pa.array(np.concatenate(prints).view(np.int64) if prints else np.empty(0, np.int64))
            else:
                column = pa.array([p.tobytes() for p in prints], pa.binary())
            passed = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in passed), column], [*passed, "print"])

    return make


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, distinct: bool = False, with_key: bool = False) -> DataFrame:
    """(doc_id, print) of ``docs(doc_id, text)``; print is a long, or binary where it has more than 64 bits.

    ``distinct`` counts a shingle that repeats in a text once; ``with_key``
    puts ``row_key`` between the two columns.
    """
    keys = [row_key().alias("row_key")] * with_key
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, text_or_empty().alias("text"))
    kind = "long" if lanes == 1 else "binary"
    return source.mapInArrow(_fingerprints(words, lanes, distinct), f"doc_id long, {'row_key long, ' * with_key}print {kind}")


def linked_members(prints: np.ndarray, max_distance: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the graph that links rows of ``prints`` at ``max_distance`` or less.

    Each row that a search reaches leaves the list of rows still to reach, so
    a dense group costs about one scan, and links are fewer than rows.  Rows of
    one label count as linked already: they are reached together, by one link.
    """
    links: list[tuple[int, int]] = []
    rest = np.arange(len(prints))
    if labels is None:
        labels = rest
    while len(rest):
        own = labels[rest] == labels[rest[0]]
        frontier, rest = rest[own].tolist(), rest[~own]
        while frontier and len(rest):
            i = frontier.pop()
            close = np.bitwise_count(prints[rest] ^ prints[i]).sum(axis=1, dtype=np.int32) <= max_distance
            if close.any():
                met, first = np.unique(labels[rest[close]], return_index=True)
                links += [(i, int(j)) for j in rest[close][first]]
                reached = np.isin(labels[rest], met)
                frontier += rest[reached].tolist()
                rest = rest[~reached]
    return links


def forest(pairs: np.ndarray) -> np.ndarray:
    """The pairs that join what earlier pairs had not joined yet."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    kept = []
    for a, b in pairs.tolist():
        i, j = top(a), top(b)
        if i != j:
            parent[max(i, j)] = min(i, j)
            kept.append((a, b))
    return np.array(kept, dtype=np.int64).reshape(-1, 2)


#: Up to this many members, a key's members are compared by offset in one sweep over all keys of a batch.
_SWEEP = 32


def _links_of(nodes: np.ndarray, prints: np.ndarray, cuts: np.ndarray, max_distance: int) -> np.ndarray:
    """A spanning forest of the links within each run ``cuts[i]:cuts[i+1]`` of rows; rows of one node are linked already."""
    sizes = np.diff(cuts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    small = np.repeat((sizes > 1) & (sizes <= _SWEEP), sizes)
    rows = np.flatnonzero(small)
    g, found = group[rows], []
    for step in range(1, int(min(_SWEEP, sizes.max(initial=0)))):
        left = np.flatnonzero(g[:-step] == g[step:])
        if not len(left):
            break
        a, b = rows[left], rows[left + step]
        apart = nodes[a] != nodes[b]
        a, b = a[apart], b[apart]
        close = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int32) <= max_distance
        found.append(np.stack([nodes[a[close]], nodes[b[close]]], axis=1))
    for i in np.flatnonzero(sizes > _SWEEP).tolist():
        own = slice(cuts[i], cuts[i + 1])
        links = linked_members(prints[own], max_distance, nodes[own])
        found.append(nodes[own][np.array(links, dtype=np.int64).reshape(-1, 2)])
    return forest(np.concatenate(found)) if found else np.empty((0, 2), dtype=np.int64)


def _within_keys(max_distance: int, lanes: int):
    """Links within each key of batches sorted by key; a key that may go on in the next batch is held back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys, nodes, prints):
            cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            both = _links_of(nodes, prints, cuts, max_distance)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            raw = batch.column("print")
            if lanes == 1:
                prints = raw.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
            else:
                prints = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint64).reshape(-1, lanes)
            last = int(np.searchsorted(keys, keys[-1]))
            if last or not held or held[-1][0][-1] != keys[0]:
                parts = [*held, (keys[:last], nodes[:last], prints[:last])]
                joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
                if len(joined[0]):
                    yield out(*joined)
                held = []
            held.append((keys[last:], nodes[last:], prints[last:]))
        if held:
            yield out(*[np.concatenate(x) for x in zip(*held, strict=True)])

    return work


def block_keys(column: str, bits: int, blocks: int, agreeing: int):
    """An array of longs: for each choice of ``agreeing`` blocks of a long, the choice's number over their bits."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), agreeing)):
        key, width = F.lit(0).cast("long"), 0
        for i in chosen:
            size = edges[i + 1] - edges[i]
            part = F.shiftrightunsigned(F.col(column), edges[i]).bitwiseAND(F.lit((1 << size) - 1))
            key = key.bitwiseOR(F.shiftleft(part, width))
            width += size
        if width > 58:
            raise ValueError("the agreeing blocks must leave room for the number of the choice")
        keys.append(key.bitwiseOR(F.lit(number << width)))
    return F.array(*keys)


def _free_bits(bits: int, blocks: int, agreeing: int) -> list[list[int]]:
    """For each choice of blocks, the bits outside them."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    return [[b for i in range(blocks) if i not in chosen for b in range(edges[i], edges[i + 1])] for chosen in combinations(range(blocks), agreeing)]


def links_within(nodes: DataFrame, max_distance: int = 2, blocks: int = 4, group_rows: int = GROUP_ROWS, texts: int | None = None) -> DataFrame:
    """Links (a, b) that connect whatever ``nodes(node, print)`` lie within ``max_distance`` bits, prints distinct.

    ``texts``, where given, is their number; tables are then written in as few files as it asks for.

    Exact: the links' components are those of all pairs within the distance.
    """
    if max_distance not in (1, 2):
        raise ValueError("64-bit prints are linked at a distance of 1 or 2")
    agreeing = blocks - max_distance
    choices = F.posexplode(block_keys("print", 64, blocks, agreeing)).alias("choice", "key")
    keyed = nodes.select("node", "print", choices)
    hot = keyed.groupBy("key").count().where(F.col("count") > group_rows).select("key")
    hot = settle(hot if texts is None else few(hot, texts * math.comb(blocks, agreeing)))
    n_hot = hot.count()
    if not n_hot:
        usual, crowded = keyed, None
    else:
        hot = F.broadcast(hot) if n_hot <= 100_000 else hot
        usual, crowded = keyed.join(hot, "key", "left_anti"), keyed.join(hot, "key", "left_semi")
    dealt = usual.select("key", "node", "print").repartition("key").sortWithinPartitions("key")
    links = dealt.mapInArrow(_within_keys(max_distance, 1), "a long, b long")
    if crowded is None:
        return links
    flips = F.array(
        *[F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) * (b == 63)).cast("long") for b in free]) for free in _free_bits(64, blocks, agreeing)]
    )
    spots = F.explode(F.transform(F.element_at(flips, F.col("choice") + 1), lambda f: F.col("print").bitwiseXOR(f)))
    near = crowded.select("node", "print", spots.alias("spot")).distinct()
    # Two members that meet are at most two bits apart, and one bit if one of them owns the spot.
    owner = F.min("node") if max_distance == 2 else F.min(F.when(F.col("print") == F.col("spot"), F.col("node")))
    met = near.groupBy("spot").agg(owner.alias("a"), F.collect_set("node").alias("members")).where(F.size("members") > 1)
    return links.unionByName(met.select("a", F.explode("members").alias("b")).where("a <> b"))


def block_bits(lanes: int, width: int, count: int) -> np.ndarray:
    """The bits of each of ``count`` blocks, ``width`` a block, as rows of positions in the print.

    Blocks are runs of the bits in order, then runs of the bytes of both halves
    in turn, then runs of the bits in steps of further odd numbers.
    """
    bits, rows, split = 64 * lanes, [], 0
    while len(rows) < count:
        if split == 0:
            order = np.arange(bits)
        elif split == 1:
            order = np.arange(bits).reshape(2, -1, 8).transpose(1, 0, 2).ravel()
        else:
            order = np.arange(bits) * (74 * split + 1) % bits
        rows += [order[at : at + width] for at in range(0, bits - width + 1, width)]
        split += 1
    return np.array(rows[:count])


def _keys_of(prints: list[bytes], places: np.ndarray, numbers: list[int], total: int) -> np.ndarray:
    """A row of keys for each print: a block's bits, and its number among ``total``."""
    bits = np.unpackbits(np.frombuffer(b"".join(prints), dtype=np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    keys = np.zeros((len(prints), len(numbers)), dtype=np.int64)
    for at in range(places.shape[1]):
        keys |= bits[:, places[numbers, at]].astype(np.int64) << at
    return keys * total + np.array(numbers)


#: Prints whose keys are in memory at a time.
_PRINTS = 2048
#: Prints that make a task worth its start, where each is dealt by many blocks.
_TASK_PRINTS = 4096


def _worth(df: DataFrame, texts: int) -> DataFrame:
    """``df``, which has a print of each of ``texts`` at most, in as many partitions as dealing them is worth."""
    return df.coalesce(max(1, -(-texts // _TASK_PRINTS)))


def _deal(places: np.ndarray, numbers: list[int], counts: bool):
    """Each print once for each of the blocks ``numbers``, or the blocks' keys with their numbers of prints alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PRINTS):
                part = batch.slice(at, _PRINTS)
                keys = _keys_of(part.column("print").to_pylist(), places, numbers, len(places))
                if counts:
                    key, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])
                    continue
                rows = pa.array(np.repeat(np.arange(part.num_rows), len(numbers)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column("node").take(rows), part.column("print").take(rows)], ["key", "node", "print"])

    return work


def _rounds(count: int) -> list[list[int]]:
    """The blocks in rounds: two, some more, and the rest, which then find most of their members connected."""
    cuts = sorted({0, min(2, count), min(12, count), count})
    return [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


class _Blocks:
    """Components of ``nodes(node, print)`` that grow as links are found; see ``links_by_block``."""

    def __init__(self, nodes: DataFrame, lanes: int, places: np.ndarray, max_distance: int, group_rows: int, texts: int) -> None:
        self.state, self.texts = nodes.select("node", "print", F.col("node").alias("component")), texts
        self.lanes, self.places, self.max_distance, self.group_rows = lanes, places, max_distance, group_rows
        self.links: list[DataFrame] = []

    def keyed(self, numbers: list[int]) -> DataFrame:
        return self.state.select(F.col("component").alias("node"), "print").mapInArrow(_deal(self.places, numbers, False), "key long, node long, print binary")

    def crowded(self, numbers: list[int]) -> DataFrame | None:
        """(key, members) of the keys with more than ``group_rows`` prints."""
        counts = self.state.select("print").mapInArrow(_deal(self.places, numbers, True), "key long, n long")
        crowded = counts.groupBy("key").agg(F.sum("n").alias("members")).where(F.col("members") > self.group_rows)
        found = settle(few(crowded, self.texts * len(numbers)))
        return None if found.isEmpty() else found

    def link(self, keyed: DataFrame) -> None:
        """Compare ``keyed(key, node, print)`` within keys and join what is linked."""
        dealt = keyed.select("key", "node", "print").repartition("key").sortWithinPartitions("key")
        # Compared by all tasks, written by few: links of what was not connected yet are short rows, and not many.
        links = dealt.mapInArrow(_within_keys(self.max_distance, self.lanes), "a long, b long")
        links = settle(links.repartition(max(1, -(-self.texts // TASK_ROWS))))
        self.links.append(links)
        found = components(links, smallest=False).select(F.col("node").alias("component"), F.col("component").alias("_new"))
        if n := found.count():
            moved = look_up(self.state, found, ["component"], "left", bound=n)
            self.state = settle(_worth(moved.select("node", "print", F.coalesce("_new", "component").alias("component")), self.texts))

    def run(self) -> None:
        total, full = len(self.places), []
        for numbers in _rounds(total):
            keyed, hot = self.keyed(numbers), self.crowded(numbers)
            if hot is not None:
                full.append(hot)
                part = F.pmod(F.xxhash64("node", "print"), F.ceil(F.col("members") / F.lit(self.group_rows / 2)))
                keyed = look_up(keyed, hot, ["key"], "left", counts=hot.select("key", F.col("members").alias("_n")))
                keyed = keyed.withColumn("key", F.when(F.col("members").isNull(), F.col("key")).otherwise(F.xxhash64("key", part)))
            self.link(keyed)
        if full:
            hot = full[0]
            for more in full[1:]:
                hot = hot.unionByName(more)
            numbers = sorted(r[0] for r in hot.select(F.pmod("key", F.lit(total)).cast("int")).distinct().collect())
            crowded = look_up(self.keyed(numbers), hot, ["key"], counts=hot.select("key", F.col("members").alias("_n")))
            self.link(_part_pairs(settle(crowded.select("key", "node", "print")), self.group_rows / 2))


def _places(lanes: int, blocks: int, strided: int) -> np.ndarray:
    width = 64 * lanes // blocks
    if width * blocks != 64 * lanes or width + (blocks + strided).bit_length() > 62:
        raise ValueError("blocks must divide the print, and a block and its number must fit 62 bits")
    return block_bits(lanes, width, blocks + strided)


def links_by_block(nodes: DataFrame, lanes: int, blocks: int, max_distance: int, group_rows: int = GROUP_ROWS, strided: int = 0) -> DataFrame:
    """Links (a, b) that connect the wide ``nodes(node, print)``, prints distinct, that share a block and lie within the distance.

    At a distance as wide as a Jaccard similarity of 0.8 asks for, blocks that
    catch every pair would be a few bits long and useless; these are longer and
    many, and a pair needs one of them in common.  ``strided`` blocks of
    further splits (see ``block_bits``) give a pair that much more chance to.

    Blocks are taken in rounds.  After each, what is linked becomes one
    component, and from then on a key links components and not prints, so the
    links of a dense group are about as many as its members, however many
    blocks they share.  Every pair within a key is compared, but for those that
    are connected already: a key with more than ``group_rows`` members is dealt
    out at random in parts of half that size, and after the last round its
    parts meet two at a time, unless one component fills both.  So the result
    does not depend on ``group_rows``.
    """
    nodes = settle(nodes.select("node", "print"))
    found = _Blocks(nodes, lanes, _places(lanes, blocks, strided), max_distance, group_rows, nodes.count())
    found.run()
    links = found.links[0]
    for more in found.links[1:]:
        links = links.unionByName(more)
    return links


def _part_pairs(named: DataFrame, rows: float) -> DataFrame:
    """``named(key, node, print)``, node being a component, in parts of about ``rows``, once for each two parts of a key that are to meet.

    A component that fills a part has parts of its own, which need not meet
    each other; all other members of a key share the rest.
    """
    sizes = named.groupBy("key", "node").agg(F.count("*").alias("n"))
    owner = F.when(F.col("n") >= rows, F.col("node")).alias("owner")
    owners = sizes.groupBy("key", owner).agg(F.ceil(F.sum("n") / F.lit(rows)).alias("parts"), F.sum("n").alias("n"))
    of_key = Window.partitionBy("key")
    owners = settle(owners.select("key", "owner", "parts", "n", F.sum("parts").over(of_key).alias("total"), F.sum("parts").over(of_key.orderBy("owner")).alias("end")))
    names = ("parts", "total", "end")
    own = owners.where("owner is not null").select("key", F.col("owner").alias("node"), *names, F.col("n").alias("_n"))
    rest = owners.where("owner is null").select("key", *[F.col(c).alias(f"rest_{c}") for c in names], F.col("n").alias("_n"))
    dealt = look_up(named, own.drop("_n"), ["key", "node"], "left", counts=own.select("key", "node", "_n"))
    dealt = look_up(dealt, rest.drop("_n"), ["key"], "left", counts=rest.select("key", "_n"))
    parts, total, end = (F.coalesce(c, f"rest_{c}") for c in names)
    dealt = dealt.select("key", "node", "print", F.col("parts").isNotNull().alias("owned"), total.alias("total"), end.alias("end"), (end - parts).alias("first"))
    dealt = dealt.withColumn("part", F.col("first") + F.pmod(F.xxhash64(F.lit(1), "key", "print"), F.col("end") - F.col("first")))
    meets = lambda p: (p != F.col("part")) & (~F.col("owned") | (p < F.col("first")) | (p >= F.col("end")))
    met = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("total") - 1), meets)).alias("other")
    pairs = dealt.select("key", "part", "node", "print", met)
    return pairs.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "node", "print")


#: Members that a block's keys should have on average, at most: a corpus beyond that takes wider blocks.
MEMBERS = 512
#: Chance that two prints at a similarity of 0.8 agree in a bit, less a little for the bits that blocks of many splits share.
AGREE = 0.835


def blocks_for(texts: int, lanes: int, blocks: int, strided: int, members: int = MEMBERS) -> np.ndarray:
    """Blocks for so many texts: a bit wider each time the texts double beyond what the given ones hold, and as many more
    as keep a similar pair's chance to share one."""
    places = _places(lanes, blocks, strided)
    width = max(places.shape[1], math.ceil(math.log2(max(texts, 1) / members)))
    return block_bits(lanes, width, math.ceil(len(places) * AGREE ** (places.shape[1] - width)))


def near_duplicates(
    docs: DataFrame,
    words: int = 3,
    max_distance: int = 2,
    blocks: int = 4,
    lanes: int = 1,
    distinct: bool = False,
    group_rows: int = GROUP_ROWS,
    strided: int = 0,
    with_key: bool = False,
    members: int = MEMBERS,
) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, fingerprint (16 hex digits a lane), component_id.

    With one lane the links are exact at ``max_distance``; with more, see
    ``links_by_block``.  ``with_key`` adds ``row_key`` and ``group``, which
    tells components apart also where they hold no identifier.
    """
    prints = settle(fingerprints(docs, words, lanes, distinct, with_key))
    # Nodes are numbers of their own, so rows without an identifier link like others.
    firsts = prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("_n"))
    nodes = settle(_worth(firsts, prints.count()).withColumn("node", F.monotonically_increasing_id()))
    texts = nodes.count()
    if lanes == 1:
        links, known = links_within(nodes.select("node", "print"), max_distance, blocks, group_rows, texts), None
        links = links.repartition(max(1, -(-texts // TASK_ROWS)))
    else:
        found = _Blocks(nodes.select("node", "print"), lanes, blocks_for(texts, lanes, blocks, strided, members), max_distance, group_rows, texts)
        found.run()
        links = found.state.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        known = found.state.where("node <> component").select("node", F.col("component").alias("group"))
        known = known.unionByName(known.select(F.col("group").alias("node"), "group").distinct())
    # An identifier that several fingerprints share links them.
    shared = nodes.where("first is not null").groupBy("first").agg(F.min("node").alias("a"), F.count("*").alias("_n")).where("_n > 1")
    if not shared.isEmpty():
        shared = settle(few(shared, texts))
        again = look_up(nodes.select("first", F.col("node").alias("b")), shared.select("first", "a"), ["first"], counts=shared.select("first", "_n"))
        links, known = links.unionByName(again.select("a", "b")), None
    if known is None:
        known = components(links, smallest=False).withColumnRenamed("component", "group")
    joined = settle(few(nodes.join(known, "node", "left"), texts))
    # Fingerprints alone in their component, the most of them, need no label from elsewhere.
    grouped = joined.where("group is not null").groupBy("group").agg(F.min("first").alias("label"), F.count("*").alias("_members"))
    groups = settle(few(grouped, texts))
    many = groups.select("group", F.col("_members").alias("_n"))
    owners = look_up(joined, groups.select("group", "label"), ["group"], "left", counts=many, bound=groups.count())
    owners = settle(few(owners.select("print", F.coalesce("group", "node").alias("group"), F.coalesce("label", "first").alias("component_id"), "_n"), texts))
    rows = look_up(prints, owners.drop("_n"), ["print"], counts=owners.select("print", "_n"))
    shown = F.lower(F.lpad(F.hex("print"), 16, "0")) if lanes == 1 else F.lower(F.hex("print"))
    return rows.select("doc_id", shown.alias("fingerprint"), "component_id", *["row_key", "group"] * with_key)


#: Fingerprints for a Jaccard similarity of 0.8 on five-word shingles.  Two such texts' shingle vectors have a cosine
#: of 0.89 and differ in 15 % of the bits, 78 of 512 with a standard deviation of 8; texts that share little differ
#: in 40 % and more.  The second split reuses the first one's bytes, so the 48 blocks are not independent: with independent
#: bits, simulated, a pair at exactly 0.8 shares no block in 4.4 % of cases and exceeds 88 bits in 9.1 %, together 12 %
#: missed; at 0.82 it is 2.5 and 2.8, together 4.9 %; at 0.85 0.8 and 0.2, together 1.0 %.
SIMILAR = {"words": 5, "lanes": 8, "blocks": 32, "strided": 16, "max_distance": 88, "distinct": True}


def keep_one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: the one with the smallest identifier.

    Where rows with that identifier differ in text, one of them stays.  Rows
    without an identifier go where their component has one; of a component
    of such rows only, one row stays.
    """
    found = near_duplicates(docs, **{**SIMILAR, **parameters}, with_key=True)
    firsts = found.where("component_id is null or doc_id = component_id").groupBy("group", "component_id").agg(F.min("row_key").alias("row_key"))
    kept = firsts.select(row_name(F.col("component_id"), F.col("row_key")).alias("_name"))
    rows = docs.select(F.struct("*").alias("_row"), row_name(F.col("doc_id").cast("long"), row_key()).alias("_name"))
    # Rows that repeat share a name; the join's partitioning serves to drop them, too.
    return rows.join(kept, "_name", "left_semi").dropDuplicates(["_name"]).select("_row.*")
