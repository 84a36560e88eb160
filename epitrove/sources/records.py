"""Text files as records that know their place: file, split and row within the split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

_PLACED = "file string, split long, row long, value string"


def _rows_in_split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Count rows per split. A task reads its splits one after the other, in file order."""
    current, seen = None, 0
    for batch in batches:
        if batch.empty:
            continue
        file, split = batch["file"].to_numpy(), batch["split"].to_numpy()
        starts = np.ones(len(batch), dtype=bool)
        starts[1:] = (file[1:] != file[:-1]) | (split[1:] != split[:-1])
        if (file[0], split[0]) == current:
            starts[0] = False
        at = np.arange(len(batch))
        last_start = np.maximum.accumulate(np.where(starts, at, -1))
        row = np.where(last_start < 0, at + seen, at - last_start)
        current, seen = (file[-1], split[-1]), int(row[-1]) + 1
        yield batch.assign(row=row)


def placed_records(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """Records of all files below ``path`` with their place.

    Large files are split among tasks, so a record's number in its file is not known here; the
    order of the records of a file is that of (split, row).
    """
    records = spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.lit(0).cast("long").alias("row"),
        "value",
    )
    return records.mapInPandas(_rows_in_split, _PLACED)
