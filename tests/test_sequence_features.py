import math
import random
from collections import Counter
from itertools import product

import pytest

from helixframe.functions.alphabet import DINUCLEOTIDES, canonical_words, reverse_complement, words
from helixframe.operators import cleaning, composition, correlation

PROPS = {d: (0.25 * "ACGU".index(d[0]), 0.5 * "ACGU".index(d[1])) for d in DINUCLEOTIDES}
PARTIAL = {d: v for d, v in PROPS.items() if d not in ("GG", "CA")}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ["", "A", "AU", "AUG", "AUGC", "AAAAAA", "AUGCUUAGC", "GGCAGGCA"] + ["".join(rng.choices("ACGU", k=n)) for n in (7, 20, 61)]


@pytest.fixture(scope="module")
def seqs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "sample_id long, seq string")


def rows(df):
    return {r["sample_id"]: {k: v for k, v in r.asDict().items() if k != "sample_id"} for r in df.collect()}


def close(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12), k


def counted(text, units, labels, width, normalize):
    c, w = Counter(units), len(text) - width + 1
    return {x: (c[x] / w if w > 0 else 0.0) if normalize else float(c[x]) for x in labels}


@pytest.mark.parametrize("k", [1, 2, 3])
@pytest.mark.parametrize("normalize", [True, False])
def test_kmer(seqs, texts, k, normalize):
    got = rows(composition.kmer(seqs, k, normalize))
    for i, t in enumerate(texts):
        close(got[i], counted(t, [t[j : j + k] for j in range(len(t) - k + 1)], words(k), k, normalize))


@pytest.mark.parametrize("k", [1, 2, 3])
def test_canonical_kmer(seqs, texts, k):
    got = rows(composition.canonical_kmer(seqs, k))
    for i, t in enumerate(texts):
        units = [min(t[j : j + k], reverse_complement(t[j : j + k])) for j in range(len(t) - k + 1)]
        close(got[i], counted(t, units, canonical_words(k), k, True))


def test_labels():
    assert [len(words(k)) for k in (1, 2, 3)] == [4, 16, 64]
    assert canonical_words(2) == ["AA", "AC", "AG", "AU", "CA", "CC", "CG", "GA", "GC", "UA"]
    assert len(canonical_words(3)) == 32


@pytest.mark.parametrize("gap", [0, 1, 2])
def test_gaps(seqs, texts, gap):
    one, two = rows(composition.mono_mono_gap(seqs, gap)), rows(composition.mono_di_gap(seqs, gap))
    for i, t in enumerate(texts):
        pairs = [f"{t[j]}_{t[j + gap + 1]}_gap{gap}" for j in range(max(len(t) - gap - 1, 0))]
        close(one[i], counted(t, pairs, [f"{a}_{b}_gap{gap}" for a, b in product("ACGU", repeat=2)], gap + 2, True))
        triples = [f"{t[j]}_{t[j + gap + 1 : j + gap + 3]}_gap{gap}" for j in range(max(len(t) - gap - 2, 0))]
        close(two[i], counted(t, triples, [f"{a}_{d}_gap{gap}" for a in "ACGU" for d in DINUCLEOTIDES], gap + 3, True))


def test_zcurve(seqs, texts):
    got = rows(composition.zcurve(seqs))
    assert got[texts.index("AUGCUUAGC")] == pytest.approx({"ZC_x": -1 / 9, "ZC_y": -1 / 9, "ZC_z": 1 / 9})
    assert all(-1 <= v <= 1 for r in got.values() for v in r.values())
    assert got[0] == {"ZC_x": 0.0, "ZC_y": 0.0, "ZC_z": 0.0}


def test_kmer_long_agrees_with_wide(seqs):
    wide = rows(composition.kmer(seqs, 2))
    for r in composition.kmer_long(seqs, 2).collect():
        assert wide[r["sample_id"]][r["kmer"]] == pytest.approx(r["value"])


def test_matrix_format_keeps_labels(seqs, texts):
    df = composition.kmer(seqs, 1, return_format="matrix")
    assert df.schema["features"].metadata["labels"] == ["A", "C", "G", "U"]
    assert len(df.first()["features"]) == 4


def tracks(t, props):
    return [props[t[i : i + 2]] for i in range(len(t) - 1) if t[i : i + 2] in props]


@pytest.mark.parametrize("props", [PROPS, PARTIAL])
def test_pse_dnc(seqs, texts, props):
    got = rows(correlation.pse_dnc(seqs, props, 2, 0.5))
    for i, t in enumerate(texts):
        v, want = tracks(t, props), {}
        theta = [sum(sum(a * b for a, b in zip(v[j], v[j + lag], strict=True)) for j in range(len(v) - lag)) / (len(v) - lag) if len(v) > lag else 0.0 for lag in (1, 2)]
        scale = 1 + 0.5 * sum(theta)
        c = Counter(t[j : j + 2] for j in range(len(t) - 1))
        for d in DINUCLEOTIDES:
            want[d] = c[d] / (len(t) - 1) / scale if len(t) >= 2 else 0.0
        for n, x in enumerate(theta, 1):
            want[f"theta_{n}"] = 0.5 * x / scale if len(t) >= 2 else 0.0
        close(got[i], want)


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("props", [PROPS, PARTIAL])
def test_covariances(seqs, texts, props, exact):
    got = rows(correlation.auto_cross_covariance(seqs, props, 2, exact_sums=exact))
    auto = correlation.auto_covariance(seqs, props, 2).columns
    cross = correlation.cross_covariance(seqs, props, 2).columns
    assert list(next(iter(got.values()))) == auto[1:] + cross[1:]
    for i, t in enumerate(texts):
        v = tracks(t, props)
        n, want = len(v), {}
        mean = [sum(x[m] for x in v) / n if n else 0.0 for m in (0, 1)]
        for a, b in ((0, 0), (1, 1), (0, 1), (1, 0)):
            for lag in (1, 2):
                name = f"AUTO_p{a}_lag{lag}" if a == b else f"CROSS_p{a}_p{b}_lag{lag}"
                want[name] = sum((v[j][a] - mean[a]) * (v[j + lag][b] - mean[b]) for j in range(n - lag)) / (n - lag) if n > lag else 0.0
        close(got[i], want)


def test_letters_outside_the_alphabet_are_an_error(spark):
    bad = spark.createDataFrame([(1, "AUGN")], "sample_id long, seq string")
    with pytest.raises(Exception, match="letters outside ACGU: N"):
        composition.kmer(bad, 1).collect()
    with pytest.raises(Exception, match="null sequence"):
        composition.zcurve(spark.createDataFrame([(1, None)], "sample_id long, seq string")).collect()


@pytest.mark.parametrize("call", [lambda s: composition.kmer(s, 0), lambda s: composition.kmer(s, True), lambda s: composition.mono_mono_gap(s, -1), lambda s: correlation.pse_dnc(s, {}, 1), lambda s: correlation.pse_dnc(s, {"AX": [1]}, 1), lambda s: correlation.auto_covariance(s, {"AA": [1], "AC": [1, 2]}, 1), lambda s: correlation.pse_dnc(s, PROPS, 1, 2.0), lambda s: composition.kmer(s, 1, return_format="x")])
def test_parameters_are_checked_at_once(seqs, call):
    with pytest.raises(ValueError):
        call(seqs)


def test_preprocess(spark):
    raw = spark.createDataFrame([(0, " augt "), (1, "AXG"), (2, "AUGN"), (3, ""), (4, None), (5, "\tAC\n")], "sample_id long, seq string")
    assert {r[0]: r[1] for r in cleaning.preprocess(raw).collect()} == {0: "AUGU", 2: "AUGN", 3: "", 5: "AC"}
    assert cleaning.dropped_count(raw) == 2
    assert {r[0] for r in cleaning.preprocess(raw, to_upper=False).collect()} == {2, 3, 5}
    assert {r[0] for r in cleaning.preprocess(raw, replace_t_with_u=False).collect()} == {2, 3, 5}
    with pytest.raises(Exception, match="outside the alphabet"):
        cleaning.preprocess(raw, strict=True).collect()


def test_zip_ids(spark):
    seqs = spark.createDataFrame([(0, "A"), (1, "C")], "pos long, seq string")
    ids = spark.createDataFrame([(0, "x"), (1, "y")], "pos long, sample_id string")
    assert {(r["sample_id"], r["seq"]) for r in cleaning.zip_ids(seqs, ids).collect()} == {("x", "A"), ("y", "C")}
    with pytest.raises(Exception, match="as many ids"):
        cleaning.zip_ids(seqs, ids.limit(1)).collect()


def test_finite(seqs):
    for r in rows(correlation.pse_dnc(seqs, PROPS, 3)).values():
        assert all(math.isfinite(v) for v in r.values())
