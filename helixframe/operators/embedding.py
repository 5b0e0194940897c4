"""Sequence embeddings: ids 100, 101, 103, 104, 130 and 131.

An encoder turns a batch of sequences into a list of 2-D arrays, one vector per
token.  Factories are registered by name; the factory runs once in each Python
worker, so a model is loaded where it is used and kept.  "hf:" and a model's
name stands for ``pretrained_encoder`` without registration.  Vectors of tokens
are averaged beside the encoder, so that one vector a row leaves the worker;
chunking and pooling of chunks are built-in functions.

``return_format`` is "matrix" (an array column, features) or "dataframe"
(columns f0, f1, ...; the encoder must be registered with its ``hidden_size``,
as a plan's columns are fixed before it runs).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import checks
from helixframe.functions.sequence import chunks, to_rna

Encoder = Callable[[Sequence[str]], Sequence[np.ndarray]]
_FACTORIES: dict[str, Callable[..., Encoder]] = {}
_SIZES: dict[str, int] = {}
_LOADED: dict[tuple[str, int | None], Encoder] = {}
FORMATS = ("matrix", "dataframe")
_VALUES = {"A": 1.0, "C": 2.0, "G": 3.0, "U": 4.0}


def register_encoder(name: str, factory: Callable[..., Encoder], hidden_size: int | None = None) -> None:
    """Make ``factory`` available as ``name``; it must be importable, or picklable, on the workers.

    An encoder with several layers is made by ``factory(layer=...)`` where a
    layer is asked for.
    """
    _FACTORIES[name] = factory
    _SIZES.pop(name, None)
    if hidden_size is not None:
        checks.at_least("hidden_size", hidden_size, 1)
        _SIZES[name] = hidden_size


def pretrained_encoder(model: str, device: str | None = None, dtype: str | None = None, layer: int | None = None) -> Encoder:
    """An encoder from a pretrained transformer, by the model's name or folder.

    Needs torch and transformers on the workers.  ``device`` is a GPU where
    there is one, ``dtype`` float16 on a GPU and float32 elsewhere.  Tokens
    are those that the attention mask counts; ``layer`` takes a hidden layer
    instead of the last one's output.
    """
    import torch
    import transformers

    device = device or ("cuda" if torch.cuda.is_available() else "cpu")
    dtype = dtype or ("float32" if device == "cpu" else "float16")
    tokenizer = transformers.AutoTokenizer.from_pretrained(model)
    network = transformers.AutoModel.from_pretrained(model, torch_dtype=getattr(torch, dtype)).to(device).eval()

    def encode(batch: Sequence[str]) -> list[np.ndarray]:
        inputs = {k: v.to(device) for k, v in tokenizer(list(batch), return_tensors="pt", padding=True, truncation=True).items()}
        with torch.no_grad():
            made = network(**inputs, output_hidden_states=layer is not None)
        vectors = made.last_hidden_state if layer is None else made.hidden_states[layer]
        mask = inputs["attention_mask"].cpu().numpy().astype(bool)
        return [v[m] for v, m in zip(vectors.float().cpu().numpy(), mask, strict=True)]

    return encode


def _factory(name: str, layer: int | None) -> Callable[[], Encoder]:
    factory = _FACTORIES.get(name)
    if factory is None and name.startswith("hf:"):
        factory = partial(pretrained_encoder, name.removeprefix("hf:"))
    if factory is None:
        raise ValueError(f"no encoder {name!r}; known: {', '.join(sorted(_FACTORIES))}, or hf: and a model's name")
    return factory if layer is None else partial(factory, layer=layer)


def toy_encoder() -> Encoder:
    """A deterministic encoder: per letter its number, its square and its position's parity."""

    def encode(batch: Sequence[str]) -> list[np.ndarray]:
        return [np.array([(_VALUES.get(c, 0.0), _VALUES.get(c, 0.0) ** 2, float(i % 2)) for i, c in enumerate(s)]).reshape(-1, 3) for s in batch]

    return encode


register_encoder("toy", toy_encoder, 3)


def _runner(name: str, batch_size: int, layer: int | None, made: Callable[[np.ndarray], Any], kind: pa.DataType):
    factory = _factory(name, layer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (name, layer) not in _LOADED:
            _LOADED[name, layer] = factory()
        encode = _LOADED[name, layer]
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                vectors = [made(np.asarray(m, dtype=np.float64)) for m in encode(part.column("seq").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("sample_id"), part.column("piece"), pa.array(vectors, kind)], ["sample_id", "piece", "vectors"])

    return run


def _mean(tokens: np.ndarray) -> np.ndarray | None:
    return tokens.mean(axis=0) if len(tokens) else None


def _rows(pieces: DataFrame, batch_size: int) -> DataFrame:
    checks.at_least("batch_size", batch_size, 1)
    return pieces.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("piece").cast("long").alias("piece"), "seq")


def _means(pieces: DataFrame, encoder: str, batch_size: int) -> DataFrame:
    """(sample_id, piece, vectors): the mean of a piece's token vectors, null without tokens."""
    run = _runner(encoder, batch_size, None, _mean, pa.list_(pa.float64()))
    return _rows(pieces, batch_size).mapInArrow(run, "sample_id string, piece long, vectors array<double>")


def _tokens(pieces: DataFrame, encoder: str, batch_size: int, layer: int | None) -> DataFrame:
    """(sample_id, piece, vectors): all token vectors of a piece."""
    run = _runner(encoder, batch_size, layer, np.ndarray.tolist, pa.list_(pa.list_(pa.float64())))
    return _rows(pieces, batch_size).mapInArrow(run, "sample_id string, piece long, vectors array<array<double>>")


def _shaped(rows: DataFrame, encoder: str, return_format: str) -> DataFrame:
    """``rows`` with their array, features, as it is or as columns f0, f1, ..."""
    checks.one_of("return_format", return_format, FORMATS)
    if return_format == "matrix":
        return rows
    if encoder not in _SIZES:
        raise ValueError(f"columns f0, f1, ... need the hidden_size of encoder {encoder!r}; register it with one")
    kept = [c for c in rows.columns if c != "features"]
    return rows.select(*kept, *[F.get("features", i).alias(f"f{i}") for i in range(_SIZES[encoder])])


def _whole(seqs: DataFrame) -> DataFrame:
    checks.columns(seqs, "sample_id", "seq")
    return seqs.select("sample_id", F.lit(0).alias("piece"), to_rna("seq").alias("seq"))


def sequence_embeddings(seqs: DataFrame, encoder: str, batch_size: int = 16, return_format: str = "matrix") -> DataFrame:
    """Ids 100 and 103: (sample_id, features), the mean of a sequence's token vectors."""
    return _shaped(_means(_whole(seqs), encoder, batch_size).select("sample_id", F.col("vectors").alias("features")), encoder, return_format)


def token_embeddings(seqs: DataFrame, encoder: str, batch_size: int = 8, layer: int | None = None, return_format: str = "matrix") -> DataFrame:
    """Ids 101 and 104: (sample_id, token_index, features), a row per token; ``layer`` takes a hidden layer's vectors."""
    made = _tokens(_whole(seqs), encoder, batch_size, layer)
    return _shaped(made.select("sample_id", F.posexplode("vectors").alias("token_index", "features")), encoder, return_format)


def flat_token_embeddings(seqs: DataFrame, encoder: str, batch_size: int = 8, layer: int | None = None) -> DataFrame:
    """Ids 101 and 104 as matrix: (sample_id, features), a sequence's token vectors one after the other."""
    made = _tokens(_whole(seqs), encoder, batch_size, layer)
    return made.select("sample_id", F.flatten("vectors").alias("features"))


def chunk_table(seqs: DataFrame, window: int = 1024, stride: int = 512) -> DataFrame:
    """(sample_id, piece, seq): the chunks that ids 130 and 131 embed."""
    checks.columns(seqs, "sample_id", "seq")
    return seqs.select("sample_id", F.posexplode(chunks(to_rna("seq"), window, stride)).alias("piece", "seq"))


def pool_vectors(vectors: DataFrame, how: str = "mean", key: str = "sample_id", column: str = "features") -> DataFrame:
    """(key, features): elementwise mean or maximum of each key's vectors.

    By key and dimension, so that it is partially aggregated and no key's
    vectors meet in one task.
    """
    checks.one_of("how", how, ("mean", "max"))
    cells = vectors.select(key, F.posexplode(column).alias("dim", "x"))
    merged = cells.groupBy(key, "dim").agg((F.avg if how == "mean" else F.max)(F.col("x").cast("double")).alias("x"))
    return merged.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias("features"))


def chunked_embeddings(
    seqs: DataFrame, encoder: str, window: int = 1024, stride: int = 512, agg: str = "mean", batch_size: int = 8, return_format: str = "matrix"
) -> DataFrame:
    """Ids 130 and 131: (sample_id, features), chunks embedded each and pooled; any ``agg`` but "mean" takes the maximum."""
    by_chunk = _means(chunk_table(seqs, window, stride), encoder, batch_size).select("sample_id", F.col("vectors").alias("features"))
    return _shaped(pool_vectors(by_chunk, "mean" if agg == "mean" else "max"), encoder, return_format)
