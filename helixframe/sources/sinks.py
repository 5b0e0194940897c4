"""Writers of results.  Tables are written by the executors; only ``save_npz`` brings a matrix to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_table(df: DataFrame, path: str, form: str = "csv") -> None:
    """``df`` as a folder of CSV (with header), Parquet, ORC or JSON files; array columns become text in CSV."""
    if form == "csv":
        df.select(*[F.to_json(n).alias(n) if t.startswith("array") else F.col(f"`{n}`") for n, t in df.dtypes]).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(form).save(path)


def save_npz(df: DataFrame, path: str, ids: str = "sample_id") -> str:
    """Columns, identifiers and values of a wide numeric table in one ``.npz`` file; the path written."""
    path = path if path.endswith(".npz") else f"{path}.npz"
    frame = df.toPandas()
    values = [c for c in frame.columns if c != ids]
    if len(values) == 1 and len(frame) and isinstance(frame[values[0]].iloc[0], (list, np.ndarray)):
        matrix = np.array(frame[values[0]].tolist())
        values = list(df.schema[values[0]].metadata.get("labels", [f"f{i}" for i in range(matrix.shape[1])]))
    else:
        matrix = frame[values].to_numpy()
    np.savez(path, columns=np.array(values), values=matrix, **({ids: frame[ids].to_numpy(dtype=str)} if ids in frame else {}))
    return path


def save_clean(seqs: DataFrame, path: str) -> None:
    """Cleaned sequences as CSV with columns ``id`` and ``seq``."""
    save_table(seqs.select(F.col("sample_id").alias("id"), "seq"), path)


def square(pairs: DataFrame, row: str, column: str, value: str = "value") -> DataFrame:
    """A labelled similarity or kernel as a wide table, a column per identifier, sorted."""
    names = sorted(r[0] for r in pairs.select(column).distinct().collect())
    return pairs.groupBy(row).pivot(column, names).agg(F.first(value)).orderBy(row)
