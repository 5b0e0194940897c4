import zlib

import duckdb
import numpy as np

import corpus_pipeline
from helixframe.llm import queries


def test_stages_and_run(spark, sf_dir, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "pack"]
    given = {r["doc_id"]: r for r in docs.collect()}
    frame, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf_dir)
        assert frame.columns == docs.columns
        rows = frame.collect()
        assert all(given[r["doc_id"]] == r for r in rows)
        sizes.append(len({r["doc_id"] for r in rows}))
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] and sizes[0] < len(given)
    kept = {r["doc_id"] for r in frame.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in out} == kept
    assert all(zlib.crc32(np.array(r["input_ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in out)


def test_queries_and_sql(spark, sf_dir):
    found = queries.queries()
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in found} and "pipeline" in found
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = found[name](spark, sf_dir), c.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.select(*columns).fetchall())


def test_contract_columns(spark, sf_dir):
    wanted = {
        "op1": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op2": "doc_id held_out score predicted",
        "op3": "page_id host path rule verdict",
        "op5": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op6": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op7": "doc_id fingerprint component_id",
        "op8": "doc_id keep_id group_size kept text_sha256",
        "op9": "doc_id held_out score predicted",
        "op10": "doc_id size source_size target taken",
    }
    longs = "doc_id page_id start length ids_crc32 doc_tokens sequence_id offset n_assign n_access n_hex n_words word_chars n_symbols n_dup_lines n_repeat_words component_id keep_id group_size size source_size taken".split()
    kinds = dict.fromkeys(longs, "bigint") | dict.fromkeys(("held_out", "base_failed", "kept"), "boolean") | {"score": "double", "target": "double", "predicted": "int"}
    for name, query in queries.queries().items():
        if (op := name.split("_")[0]) in wanted:
            types = dict(query(spark, sf_dir).dtypes)
            for column in wanted[op].split():
                assert types[column] == kinds.get(column, "string"), (name, column)
