"""Sequence features of streams.

The features of ids 1 to 12 depend on one row each, so the operators accept a
streaming DataFrame as they are; this adds the source and sink around them.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from helixframe.operators.cleaning import preprocess
from helixframe.plans import registry

SCHEMA = "sample_id string, seq string"


def read_stream(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A stream of (sample_id, seq) from the files that appear in a folder."""
    return spark.readStream.schema(SCHEMA).format(form).load(path)


def feature_stream(seqs: DataFrame, number: int, **parameters: Any) -> DataFrame:
    """Cleaned sequences through one of the operators 1 to 12; rows with other letters are left out."""
    return registry.run("rna", number, preprocess(seqs, valid_alphabet="ACGU"), **parameters)


def write_features(features: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append features as Parquet, each input row exactly once, until all that is there has been read."""
    return features.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
