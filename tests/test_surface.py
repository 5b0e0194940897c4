import json
import sys
from contextlib import nullcontext
from types import SimpleNamespace

import numpy as np
import pytest

from helixframe import cli
from helixframe.operators import embedding
from helixframe.plans import registry
from helixframe.sources import readers, sinks
from helixframe.streaming import sequences as streams


def test_chunks(spark):
    seqs = spark.createDataFrame([(1, "A" * 1500), (2, "C" * 1536), (3, ""), (4, "AC")], "sample_id long, seq string")
    got = {}
    for r in embedding.chunk_table(seqs, 1024, 512).collect():
        got.setdefault(r["sample_id"], []).append(len(r["seq"]))
    assert got == {1: [1024], 2: [1024, 1024], 3: [0], 4: [2]}
    assert embedding.chunk_table(seqs, 0, 1).count() == 4


def test_encoders(spark):
    texts = ["ACGU", "GGU", "T", "acgt" * 30]
    seqs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "sample_id string, seq string")
    encode = embedding.toy_encoder()
    vectors = [encode([t.upper().replace("T", "U")])[0] for t in texts]
    whole = {r[0]: r[1] for r in embedding.sequence_embeddings(seqs, "toy", 2).collect()}
    flat = {r[0]: r[1] for r in embedding.flat_token_embeddings(seqs, "toy").collect()}
    for i, v in enumerate(vectors):
        assert np.allclose(whole[str(i)], v.mean(axis=0)) and np.allclose(flat[str(i)], v.ravel())
    assert embedding.token_embeddings(seqs, "toy").count() == sum(map(len, vectors))
    for agg in ("mean", "max"):
        got = {r[0]: r[1] for r in embedding.chunked_embeddings(seqs, "toy", 50, 25, agg).collect()}
        parts = [encode([texts[3].upper().replace("T", "U")[s : s + 50]])[0].mean(axis=0) for s in (0, 25, 50)]
        assert np.allclose(got["3"], getattr(np, agg)(parts, axis=0))
    with pytest.raises(ValueError, match="no encoder"):
        embedding.sequence_embeddings(seqs, "missing")


def test_columns_and_layers_of_encoders(spark):
    seqs = spark.createDataFrame([("a", "acgtn"), ("b", "G")], "sample_id string, seq string")
    wide = embedding.sequence_embeddings(seqs, "toy", return_format="dataframe")
    assert wide.columns == ["sample_id", "f0", "f1", "f2"]
    assert {r[0]: list(r[1:]) for r in wide.collect()} == {r[0]: r[1] for r in embedding.sequence_embeddings(seqs, "toy").collect()}
    assert embedding.token_embeddings(seqs, "toy", return_format="dataframe").columns == ["sample_id", "token_index", "f0", "f1", "f2"]
    assert embedding.chunked_embeddings(seqs, "toy", return_format="dataframe").columns == wide.columns

    def layered(layer=0):
        return lambda batch: [np.full((len(s), 1), float(layer)) for s in batch]

    embedding.register_encoder("layered", layered)
    assert [r["features"] for r in embedding.token_embeddings(seqs.limit(1), "layered", layer=2).collect()] == [[2.0]] * 5
    with pytest.raises(ValueError, match="hidden_size"):
        embedding.sequence_embeddings(seqs, "layered", return_format="dataframe")
    with pytest.raises(ValueError, match="return_format"):
        embedding.sequence_embeddings(seqs, "toy", return_format="rows")


def test_pretrained_encoder(monkeypatch):
    """With stand-ins for torch and transformers, which are not here: masked tokens, layers, device and number type."""

    class Tensor:
        def __init__(self, values):
            self.values = np.asarray(values)

        def to(self, device):
            assert device == "cpu"
            return self

        float = cpu = lambda self: self

        def numpy(self):
            return self.values

    class Network:
        def to(self, device):
            return self

        def eval(self):
            return self

        def __call__(self, input_ids, attention_mask, output_hidden_states):
            layers = [Tensor(input_ids.values[..., None] * np.array([1.0, n])) for n in range(3)]
            return SimpleNamespace(last_hidden_state=layers[-1], hidden_states=layers if output_hidden_states else None)

    def tokenizer(batch, return_tensors, padding, truncation):
        longest = max(map(len, batch))
        ids = [[ord(c) for c in s] + [0] * (longest - len(s)) for s in batch]
        return {"input_ids": Tensor(ids), "attention_mask": Tensor(np.array(ids) > 0)}

    asked = {}
    load = lambda name, torch_dtype: asked.update(name=name, dtype=torch_dtype) or Network()
    torch = SimpleNamespace(cuda=SimpleNamespace(is_available=lambda: False), float32="f32", no_grad=nullcontext)
    transformers = SimpleNamespace(
        AutoTokenizer=SimpleNamespace(from_pretrained=lambda name: tokenizer), AutoModel=SimpleNamespace(from_pretrained=load)
    )
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "transformers", transformers)
    last = embedding._factory("hf:some/model", None)()
    assert asked == {"name": "some/model", "dtype": "f32"}
    assert [v.tolist() for v in last(["AC", "G"])] == [[[65, 130], [67, 134]], [[71, 142]]]
    assert [v.tolist() for v in embedding._factory("hf:some/model", 1)()(["AC", "G"])] == [[[65, 65], [67, 67]], [[71, 71]]]


def test_registry(spark):
    assert registry.list_domains() == ["cross", "disease", "nn", "rna"]
    assert sorted(registry.domain("RNA")) == list(range(1, 13))
    assert registry.has_method("disease", 14) and not registry.has_method("rna", 13)
    assert "10: z-curve" in registry.describe("rna")
    seqs = spark.createDataFrame([("a", "ACGU")], "sample_id string, seq string")
    assert registry.run("rna", 1, seqs, k=1).first()["A"] == 0.25
    assert registry.run("nn", 100, seqs, encoder="toy").count() == 1
    with pytest.raises(ValueError):
        registry.run("rna", 99, seqs)
    with pytest.raises(ValueError):
        registry.domain("x")


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "s.txt").write_text(" ACGU\n\n\tggu \n")
    (tmp_path / "ids.txt").write_text("x\ny\n")
    (tmp_path / "e.csv").write_text("Child,PARENT,note\nA,R,1\nB,R,2\n")
    (tmp_path / "t.tsv").write_text("Disease\tTerm\nd1\tA\nd1\tB\n\tA\nd2\tNA\n")
    (tmp_path / "m.csv").write_text(",D1,D2\nL1,1,0\nL2,NA,2\n")
    assert [(r["pos"], r["seq"]) for r in readers.read_sequences_text(spark, str(tmp_path / "s.txt")).orderBy("pos").collect()] == [(0, "ACGU"), (1, "ggu")]
    assert readers.read_lines(spark, None) is None
    assert {tuple(r) for r in readers.read_edges(spark, str(tmp_path / "e.csv")).collect()} == {("A", "R"), ("B", "R")}
    terms = readers.read_disease_terms(spark, str(tmp_path / "t.tsv"))
    assert {r["disease"]: r["terms"] for r in readers.group_terms(terms).collect()} == {"d1": ["A", "B"], "d2": []}
    cells = {(r["lnc"], r["disease"]): r["value"] for r in readers.read_matrix(spark, str(tmp_path / "m.csv")).collect()}
    assert cells == {("L1", "D1"): 1.0, ("L1", "D2"): 0.0, ("L2", "D1"): None, ("L2", "D2"): 2.0}
    df = spark.createDataFrame([("a", 1.0, 2.0)], "sample_id string, f0 double, f1 double")
    with np.load(sinks.save_npz(df, str(tmp_path / "out"))) as z:
        assert z["columns"].tolist() == ["f0", "f1"] and z["values"].tolist() == [[1.0, 2.0]]
    for form in ("parquet", "json", "orc"):
        sinks.save_table(df, str(tmp_path / form), form)
        assert spark.read.format(form).load(str(tmp_path / form)).count() == 1
    with pytest.raises(ValueError):
        (tmp_path / "none.txt").write_text("\n")
        readers.read_sequences_text(spark, str(tmp_path / "none.txt"))


def test_command_line(spark, tmp_path, capsys):
    cli.main(["rna", "--list"])
    assert "1: kmer" in capsys.readouterr().out
    (tmp_path / "s.csv").write_text("id,seq\na,ACGT\nb,AXG\n")
    (tmp_path / "p.json").write_text(json.dumps({"AC": [1.0], "CG": [2.0], "GU": [3.0]}))
    (tmp_path / "e.csv").write_text("child,parent\nA,R\nB,R\n")
    (tmp_path / "m.csv").write_text("x,D1,D2\nL1,1,0\nL2,0,1\n")
    (tmp_path / "d.csv").write_text("x,D1,D2\nD1,1,0.5\nD2,0.5,1\n")
    (tmp_path / "t.csv").write_text("disease,term\nd1,A\nd2,B\n")
    at = lambda n: str(tmp_path / n)
    read = lambda n: spark.read.option("header", True).csv(at(n))
    cli.main(["rna", "--method", "1", "--k", "1", "--seqs_csv", at("s.csv"), "--save_clean", at("clean"), "-o", at("k1")], spark)
    assert [tuple(r) for r in read("k1").collect()] == [("a", "0.25", "0.25", "0.25", "0.25")] and read("clean").count() == 1
    cli.main(["rna", "--method", "4", "--L", "1", "--props", at("p.json"), "--seqs_csv", at("s.csv"), "-o", at("dac.npz")], spark)
    assert np.load(at("dac.npz"))["columns"].tolist() == ["AUTO_p0_lag1"]
    cli.main(["disease", "--edges", at("e.csv"), "--term_a", "A", "--term_b", "B", "-o", at("s13")], spark)
    assert float(read("s13").first()["sim"]) == pytest.approx(1.6 / 3.6)
    cli.main(["disease", "--method", "14", "--edges", at("e.csv"), "--disease_terms", at("t.csv"), "-o", at("s14")], spark)
    assert read("s14").count() == 4
    cli.main(["disease", "--method", "15", "--Y", at("m.csv"), "--disease_sim", at("d.csv"), "-o", at("s15")], spark)
    assert {(r["lnc1"], r["lnc2"]): float(r["value"]) for r in read("s15").collect()}["L1", "L2"] == 0.5
    for method in ("16", "17"):
        cli.main(["cross", "--method", method, "--matrix", at("m.csv"), "-o", at(f"c{method}")], spark)
        assert read(f"c{method}_lnc").count() == (4 if method == "16" else 2)
    (tmp_path / "raw.csv").write_text("ID,seqs,d1,\na,ACG,1,9\nb,,0,9\n")
    (tmp_path / "pairs.csv").write_text("ID,Disease Name\nA,d2\nz,d3\n")
    cli.main(["prepare", "--raw_sequences_csv", at("raw.csv"), "--raw_pairs_csv", at("pairs.csv"), "--merge_pairs", "--out_dir", at("out")], spark)
    assert read("out/sequences.csv").count() == 1
    assert {tuple(r) for r in read("out/Y.csv").select("lnc", "d1", "d2").collect()} == {("a", "1", "0"), ("b", "0", "0"), ("A", "0", "1")}
    with pytest.raises(SystemExit):
        cli.main(["rna", "--method", "1"], spark)


def test_stream_gives_the_batch_result(spark, tmp_path):
    seqs = spark.createDataFrame([("a", "ACGU"), ("b", "augg"), ("c", "xx")], "sample_id string, seq string")
    seqs.write.parquet(str(tmp_path / "in"))
    stream = streams.feature_stream(streams.read_stream(spark, str(tmp_path / "in")), 1, k=2)
    streams.write_features(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    batch = streams.feature_stream(seqs, 1, k=2)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))
