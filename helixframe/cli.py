"""Command line: python -m helixframe {rna,disease,cross,prepare} ..."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import association, cleaning, kernels, similarity
from helixframe.plans import registry
from helixframe.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixframe")
    sub = top.add_subparsers(dest="command", required=True)

    rna = sub.add_parser("rna", help="sequence features")
    rna.add_argument("--list", action="store_true")
    rna.add_argument("--method", type=int, default=1)
    source = rna.add_mutually_exclusive_group()
    source.add_argument("--seqs", help="text file, one sequence per line")
    source.add_argument("--seqs_csv", help="CSV with columns id, seq")
    rna.add_argument("--sample_ids", help="text file, one id per line, with --seqs")
    for name in ("k", "lam", "L", "k_gap"):
        rna.add_argument(f"--{name}", type=int)
    rna.add_argument("--weight", type=float)
    rna.add_argument("--props", help="JSON file: dinucleotide to list of numbers")
    rna.add_argument("--normalize", type=lambda s: s.lower() != "false", default=True)
    rna.add_argument("--return_format", choices=["matrix", "dataframe"], default="dataframe")
    rna.add_argument("--no_upper", action="store_true")
    rna.add_argument("--keep_t", action="store_true")
    rna.add_argument("--strict", action="store_true")
    rna.add_argument("--save_clean")
    rna.add_argument("-o", "--output")

    disease = sub.add_parser("disease", help="ontology similarity")
    disease.add_argument("--list", action="store_true")
    disease.add_argument("--method", type=int, default=13)
    for name in ("edges", "term_a", "term_b", "disease_terms", "Y", "disease_sim"):
        disease.add_argument(f"--{name}")
    disease.add_argument("--edge_weight", type=float, default=0.8)
    disease.add_argument("--threshold", type=float, default=0.0)
    disease.add_argument("-o", "--output")

    cross = sub.add_parser("cross", help="kernels and factors")
    cross.add_argument("--list", action="store_true")
    cross.add_argument("--method", type=int, choices=[16, 17])
    cross.add_argument("--matrix")
    cross.add_argument("--k", type=int, default=64)
    cross.add_argument("-o", "--output")

    prepare = sub.add_parser("prepare", help="raw tables to sequences and associations")
    prepare.add_argument("--raw_sequences_csv", required=True)
    prepare.add_argument("--raw_pairs_csv")
    prepare.add_argument("--out_dir", default="Data/processed")
    prepare.add_argument("--id_col", default="ID")
    prepare.add_argument("--seq_col", default="seqs")
    prepare.add_argument("--lnc_col", default="ID")
    prepare.add_argument("--dis_col", default="Disease Name")
    prepare.add_argument("--merge_pairs", action="store_true")
    return top


def _give(df: DataFrame, output: str | None) -> None:
    if output is None:
        print("\t".join(df.columns))
        for row in df.toLocalIterator():  # all rows, a partition at a time
            print("\t".join(map(str, row)))
    elif output.endswith(".npz"):
        sinks.save_npz(df, output, df.columns[0])
    else:
        sinks.save_table(df, output, "parquet" if output.endswith(".parquet") else "csv")


def _rna(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.seqs_csv:
        seqs = readers.read_sequences(spark, a.seqs_csv)
    elif a.seqs:
        lines = readers.read_sequences_text(spark, a.seqs)
        ids = readers.read_lines(spark, a.sample_ids, "sample_id")
        seqs = cleaning.zip_ids(lines, ids) if ids is not None else lines.withColumn("sample_id", F.concat(F.lit("s"), "pos"))
    else:
        raise SystemExit("rna needs --seqs or --seqs_csv")
    raw, options = seqs.select("sample_id", "seq"), {"to_upper": not a.no_upper, "replace_t_with_u": not a.keep_t}
    if not a.strict and (dropped := cleaning.dropped_count(raw, **options)):
        print(f"warning: {dropped} sequences with letters outside the alphabet are left out", file=sys.stderr)
    seqs = cleaning.preprocess(raw, **options, strict=a.strict)
    if a.save_clean:
        sinks.save_clean(seqs, a.save_clean)
    props = None
    if a.props:
        props = json.loads("\n".join(r[0] for r in spark.read.text(a.props).collect()))
    given = {"k": a.k, "lam": a.lam, "w": a.weight, "L": a.L, "k_gap": a.k_gap, "props": props, "normalize": a.normalize, "return_format": a.return_format}
    _give(registry.run("rna", a.method, seqs, **registry.accepted("rna", a.method, given)), a.output)


def _needed(a: argparse.Namespace, *names: str) -> None:
    missing = [n for n in names if not getattr(a, n)]
    if missing:
        raise SystemExit(f"{a.command} --method {a.method} needs " + ", ".join(f"--{n}" for n in missing))


def _disease(spark: SparkSession, a: argparse.Namespace) -> None:
    registry.ensure_methods("disease", [a.method])
    if a.method == 13:
        _needed(a, "edges", "term_a", "term_b")
        value = similarity.pair_similarity(readers.read_edges(spark, a.edges), a.term_a, a.term_b, a.edge_weight)
        _give(spark.createDataFrame([(a.term_a, a.term_b, value)], "term1 string, term2 string, sim double"), a.output)
    elif a.method == 14:
        _needed(a, "edges", "disease_terms")
        values = similarity.ancestor_values(readers.read_edges(spark, a.edges), a.edge_weight)
        terms = readers.read_disease_terms(spark, a.disease_terms)
        _give(similarity.disease_similarity(terms.select("disease").distinct(), terms, values), a.output)
    else:
        _needed(a, "Y", "disease_sim")
        y = readers.read_matrix(spark, a.Y)
        sim = readers.read_matrix(spark, a.disease_sim).toDF("disease1", "disease2", "value")
        _give(similarity.functional_similarity(y, y.select("lnc").distinct(), sim, a.threshold), a.output)


def _cross(spark: SparkSession, a: argparse.Namespace) -> None:
    if not a.method:
        raise SystemExit("cross needs --method")
    _needed(a, "matrix")
    y = readers.read_matrix(spark, a.matrix)
    lncs, diseases = y.select("lnc").distinct(), y.select("disease").distinct()
    if a.method == 16:
        parts = kernels.interaction_profiles(y, lncs, diseases)
    else:
        parts = kernels.svd_features(y, lncs, sorted(r[0] for r in diseases.collect()), a.k)
    for df, side in zip(parts, ("lnc", "disease"), strict=True):
        _give(df, f"{a.output}_{side}" if a.output else None)


def _prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    raw = readers.read_any(spark, a.raw_sequences_csv)
    sinks.save_table(association.sequences_table(raw, a.id_col, a.seq_col), f"{a.out_dir}/sequences.csv")
    labels = association.from_wide(raw, a.id_col, a.seq_col)
    pairs = None
    if a.raw_pairs_csv:
        pairs = association.from_pairs(readers.read_any(spark, a.raw_pairs_csv), a.lnc_col, a.dis_col, labels.select("lnc").distinct())
    sinks.save_table(association.to_wide(association.choose_y(labels, pairs, a.merge_pairs)), f"{a.out_dir}/Y.csv")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if getattr(a, "list", False):
        print(registry.describe(a.command))
        return
    spark = spark or SparkSession.builder.appName("helixframe").getOrCreate()
    {"rna": _rna, "disease": _disease, "cross": _cross, "prepare": _prepare}[a.command](spark, a)
