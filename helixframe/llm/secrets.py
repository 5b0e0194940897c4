"""Secret scan: fixed patterns, and a battery of randomness tests for the rest.

Three patterns find the usual secrets (``assign``, ``access``, ``hex``).  Every
other unbroken token of ``MIN_TOKEN`` characters or more is a hypothesis "this
is ordinary text".  Its encoding (hex, base32, base36, base64) is inferred from
its characters, and

* a chi-squared test of uniformity over that alphabet, a runs test on its
  character classes and a lag-1 serial-correlation test ask whether it could be
  random; a token that fails any of them (Bonferroni at ``FIT_LEVEL``) is text;
* the same three statistics are set against ordinary text: the corpus's own
  pairs of neighbouring characters, counted over all documents, say for each
  encoding how often symbols repeat, how often the class changes and how
  neighbours correlate, and so how likely text of this very length is to come
  so close to random.  Fisher's rule combines the three probabilities.

The Benjamini-Hochberg procedure then controls the false discoveries over the
whole table, separately for each stratum of lengths, because short tokens carry
little evidence.  Its p-values go into fixed bins (rounded up, so it errs on the
side of fewer spans); the table of bins has a fixed size whatever the corpus.

Positions count code points, ends are exclusive.  Edge cases: a null text is
empty; a text without spans has the digest of the empty string.  Tokens of one
character class only (words, numbers) count as hypotheses with probability one.
Spans of the battery that overlap a pattern's span are left out: the pattern's
stay.  Repeated rows repeat.  An empty table gives no rows.  Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import in_slices, settle, text_or_empty

KINDS = ("assign", "access", "hex", "random")
MIN_TOKEN = 16
FIT_LEVEL = 0.001
STRATA = (16, 24, 32, 48, 64)
#: Bins of -log10 p, BIN wide; the last one is open.
BIN, BINS = 0.25, 161

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_HINTS = ("passw", "secret", "token", "api")
#: A run that fails for its length gives no shorter match inside it, so the lengths can stand in the patterns.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_TOKEN = re.compile(rf"(?<![\w+/-])[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}+={{0,2}}+(?!\w)")
_ONE_CLASS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("hex", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_RANKS = [(name, {c: i for i, c in enumerate(letters)}) for name, letters in _ALPHABETS]
_KINDS = [["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in letters] for _, letters in _ALPHABETS]
#: Chance that neighbouring random symbols are of different classes.
_EVEN = [1 - sum((kinds.count(k) / len(kinds)) ** 2 for k in set(kinds)) for kinds in _KINDS]


def _upper(z: float) -> float:
    """P(standard normal > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three patterns, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def infer_encoding(token: str) -> tuple[str, dict[str, int]] | None:
    """The smallest alphabet that holds every character of the token (padding aside)."""
    body = set(token.rstrip("="))
    return next(((name, ranks) for name, ranks in _RANKS if body <= ranks.keys()), None)


@dataclass(frozen=True)
class TextModel:
    """An encoding's symbols in ordinary text: sums of squares and cubes of their shares, changes of class, correlation of neighbours."""

    squares: float
    cubes: float
    change: float
    serial: float


def _classes(letters: str) -> np.ndarray:
    return np.array([0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in letters])


def text_models(pairs: np.ndarray) -> list[TextModel | None]:
    """For each of ``_ALPHABETS`` what ``pairs``, counts of neighbouring ASCII characters, say; None without any."""
    out = []
    for _, letters in _ALPHABETS:
        at = np.array([ord(c) for c in letters])
        own = pairs[np.ix_(at, at)].astype(np.float64)
        total = own.sum()
        if not total:
            out.append(None)
            continue
        own /= total
        share, kind, x = (own.sum(axis=0) + own.sum(axis=1)) / 2, _classes(letters), np.arange(len(letters)) / len(letters)
        centre = share @ x
        spread = share @ (x - centre) ** 2
        serial = (x - centre) @ own @ (x - centre) / spread if spread else 0.0
        out.append(TextModel(float(share @ share), float((share**3).sum()), float(own[kind[:, None] != kind[None, :]].sum()), float(serial)))
    return out


def _as_close(value: float, mean: float, sd: float, random: float) -> float:
    """P(text's statistic is at ``value`` or beyond, towards what is expected of random symbols)."""
    return _upper((value - mean if random > mean else mean - value) / max(sd, 1e-9))


def statistics(token: str) -> tuple[int, int, float, float, float, float] | None:
    """(alphabet, length, collisions, changes of class, serial correlation, probability of the worst statistic if random)."""
    body = token.rstrip("=")
    n, own = len(body), set(body)
    number = next((i for i, (_, ranks) in enumerate(_RANKS) if own <= ranks.keys()), None)
    if number is None or n < 2:
        return None
    ranks, kinds = _RANKS[number][1], _KINDS[number]
    size = len(ranks)
    x = [ranks[c] for c in body]
    counts: dict[int, int] = {}
    for v in x:
        counts[v] = counts.get(v, 0) + 1
    squares = sum(c * c for c in counts.values())
    chi, df = size * squares / n - n, size - 1
    p_chi = _upper(((max(chi, 0.0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))

    kind = [kinds[v] for v in x]
    changes = sum(a != b for a, b in zip(kind, kind[1:], strict=False))
    even = _EVEN[number]
    p_runs = 2 * _upper(abs(changes - (n - 1) * even) / math.sqrt((n - 1) * even * (1 - even)))

    centre = sum(x) / n
    spread = sum((v - centre) ** 2 for v in x)
    serial = sum((a - centre) * (b - centre) for a, b in zip(x, x[1:], strict=False)) / spread if spread else 1.0
    p_serial = 2 * _upper(abs(serial + 1 / n) * math.sqrt(n))
    return number, n, (squares - n) / 2, float(changes), serial, min(1.0, 3 * min(p_chi, p_runs, p_serial))


def text_probability(number: int, n: int, collisions: float, changes: float, serial: float, model: TextModel | None) -> float:
    """Probability that ordinary text of ``n`` symbols of an encoding comes as close to random; 1 where there is no such text."""
    if model is None:
        return 1.0
    size, pairs, steps = len(_RANKS[number][1]), n * (n - 1) / 2, n - 1
    # Pairs that share a symbol are not independent: the second term is what they add.
    sd = math.sqrt(max(pairs * model.squares * (1 - model.squares) + n * (n - 1) * (n - 2) * max(model.cubes - model.squares**2, 0.0), 0.25))
    p_even = _as_close(collisions + (0.5 if model.squares > 1 / size else -0.5), pairs * model.squares, sd, pairs / size)
    even = _EVEN[number]
    q, c = changes / steps, min(max(model.change, 0.5 / steps), 1 - 0.5 / steps)
    if (q <= c) == (even > c) or q == c:
        p_runs = 1.0
    else:  # Chernoff's bound on the binomial's tail
        gain = (q * math.log(q / c) if q else 0.0) + ((1 - q) * math.log((1 - q) / (1 - c)) if q < 1 else 0.0)
        p_runs = math.exp(-steps * gain)
    p_serial = _as_close(serial, model.serial - 1 / n, 1 / math.sqrt(n), -1 / n)
    both = -sum(math.log(max(p, 1e-300)) for p in (p_even, p_runs, p_serial))
    return min(1.0, math.exp(-both) * (1 + both + both * both / 2))


def _stratum(length: int) -> int:
    return sum(length >= s for s in STRATA) - 1


def hypotheses(text: str, taken: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, stratum, statistics or None) of every token that no base span overlaps; None is text for certain."""
    out = []
    at = 0
    ends = sorted((s, e) for s, _, e in taken)
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while at < len(ends) and ends[at][1] <= start:
            at += 1
        if any(s < end and e > start for s, e in ends[at : at + 4]):
            continue
        token = m.group()
        found = None if _ONE_CLASS.fullmatch(token) else statistics(token)
        out.append((start, end, _stratum(end - start), found if found and found[-1] >= FIT_LEVEL else None))
    return out


def pair_counts(text: str) -> np.ndarray:
    """How often each ASCII character follows each other one; all other characters count as code 0."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(codes < 128, codes, 0)
    return np.bincount(codes[:-1] * 128 + codes[1:], minlength=128 * 128) if len(codes) > 1 else np.zeros(128 * 128, dtype=np.int64)


_TEST = "start:int,kind:int,end:int,stratum:int,number:int,length:int,collisions:double,changes:double,serial:double"
_SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, "
    f"tests array<struct<{_TEST}>>, words array<long>, pairs binary"
)
_PLACE = [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]
_TEST_TYPE = pa.struct([*_PLACE, *[(n, pa.int32()) for n in ("stratum", "number", "length")], *[(n, pa.float64()) for n in ("collisions", "changes", "serial")]])
#: Characters whose pairs one count takes at a time.
_PAIRS_AT_ONCE = 1 << 22


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text; the last row of all holds the task's counts of pairs and no text."""
    total = np.zeros(128 * 128, dtype=np.int64)
    names = [f.split()[0] for f in _SCHEMA.replace("struct<" + _TEST, "").replace("struct<start:int,kind:int,end:int", "").split(", ")]
    for batch in in_slices(batches):
        counts, shas, base, tests, plain = ([], [], []), [], [], [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            for kind in range(3):
                counts[kind].append(sum(k == kind for _, k, _ in spans))
            shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest())
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            row, open_ = [0] * len(STRATA), []
            for s, e, t, found in hypotheses(text, spans):
                if found is None:
                    row[t] += 1
                else:
                    open_.append(dict(zip(_TEST_TYPE.names, (s, 3, e, t, *found[:-1]), strict=True)))
            tests.append(open_)
            plain.append(row)
            for at in range(0, len(text), _PAIRS_AT_ONCE):
                total += pair_counts(text[at : at + _PAIRS_AT_ONCE + 1])
        values = [
            batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(base, pa.list_(pa.struct(_PLACE))),
            pa.array(tests, pa.list_(_TEST_TYPE)), pa.array(plain, pa.list_(pa.int64())), pa.nulls(batch.num_rows, pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(values, names)
    kinds = (pa.int64(), *[pa.int64()] * 3, pa.string(), pa.list_(pa.struct(_PLACE)), pa.list_(_TEST_TYPE), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.array([total.tobytes()], pa.binary())], names)


def _judged(models: list[TextModel | None]):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for tests in batch.column("tests").to_pylist():
                p = [text_probability(t["number"], t["length"], t["collisions"], t["changes"], t["serial"], models[t["number"]]) for t in tests]
                made.append([min(BINS - 1, int(-math.log10(max(x, 1e-300)) / BIN)) for x in p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.int32()))], [*batch.schema.names, "bins"])

    return judge


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(p, dtype=np.int64) for p in table.column("pairs").to_pylist())
    return pa.table({"pairs": pa.array([total.tobytes()], pa.binary())})


def text_pairs(counts: DataFrame) -> np.ndarray:
    """The sum of the tasks' ``counts(pairs)``, added up on the executors in a few tasks first."""
    some = counts.withColumn("slice", F.pmod(F.monotonically_increasing_id(), F.lit(16))).groupBy("slice").applyInArrow(_add, "pairs binary").collect()
    return sum((np.frombuffer(r["pairs"], dtype=np.int64) for r in some), np.zeros(128 * 128, dtype=np.int64)).reshape(128, 128)


def discovery_bins(histogram: dict[tuple[int, int], int], level: float) -> list[int]:
    """For each stratum the least bin that Benjamini-Hochberg accepts at ``level``, BINS if none."""
    out = []
    for stratum in range(len(STRATA)):
        row = [histogram.get((stratum, b), 0) for b in range(BINS)]
        total, kept, least = sum(row), 0, BINS
        for b in range(BINS - 1, 0, -1):
            kept += row[b]
            if row[b] and total * 10 ** (-BIN * b) <= level * kept:
                least = b
        out.append(least)
    return out


def find_secrets(docs: DataFrame, level: float = 0.01) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``.

    Columns: doc_id, n_assign, n_access, n_hex, n_random, base_sha256 (of the
    pattern spans as ``kind:start:end``), spans (all spans in that form) and
    found (the same as an array of structs).
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    made = settle(source.mapInArrow(_scan, _SCHEMA))
    models = text_models(text_pairs(made.where("pairs is not null").select("pairs")))
    rows = made.where("pairs is null").drop("pairs")
    scanned = settle(rows.mapInArrow(_judged(models), T.StructType([*rows.schema.fields, T.StructField("bins", T.ArrayType(T.IntegerType()))])))
    both = F.explode(F.arrays_zip(F.col("tests").stratum.alias("stratum"), F.col("bins").alias("bin")))
    ruled = scanned.select(both.alias("t")).groupBy("t.stratum", "t.bin").count().collect()
    histogram = {(r["stratum"], r["bin"]): r["count"] for r in ruled}
    plain = scanned.agg(*[F.sum(F.col("words")[i]).alias(f"w{i}") for i in range(len(STRATA))]).first()
    for i in range(len(STRATA)):
        histogram[i, 0] = histogram.get((i, 0), 0) + (plain[i] or 0)
    least = F.array(*[F.lit(b) for b in discovery_bins(histogram, level)])
    random = F.transform(
        F.filter("tests", lambda t, i: F.col("bins")[i] >= least[t["stratum"]]),
        lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")),
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform("found", lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")))
    return (
        scanned.withColumn("random", random)
        .withColumn("found", F.array_sort(F.concat("base", "random")))
        .select(
            "doc_id",
            "n_assign",
            "n_access",
            "n_hex",
            F.size("random").cast("long").alias("n_random"),
            "base_sha256",
            F.array_join(spans, ",").alias("spans"),
            "found",
        )
    )
