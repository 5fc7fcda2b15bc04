"""Result sinks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_lines(result: DataFrame, key: str, value: str, missing: float | None = None) -> DataFrame:
    """``vid-value`` with six decimals; ``missing`` stands for null."""
    v = F.col(value).cast("double") if missing is None else F.coalesce(F.col(value).cast("double"), F.lit(missing))
    return result.select(F.format_string("%d-%.6f", F.col(key), v).alias("value"))


def write_text(result: DataFrame, path: str, key: str, value: str, *, missing: float | None = None) -> None:
    """A folder of text files, written by the cluster."""
    text_lines(result.orderBy(key), key, value, missing).write.mode("overwrite").text(path)


def write_report(result: DataFrame, path: str, key: str, value: str, elapsed_ms: float, *, missing: float | None = None) -> None:
    """One local file for small results: the elapsed time, then a line a vertex."""
    with Path(path).open("w") as f:
        f.write(f"Elapsed time: {elapsed_ms:.0f} ms\n")
        for row in text_lines(result.orderBy(key), key, value, missing).toLocalIterator():
            f.write(row["value"] + "\n")


def write_parquet(result: DataFrame, path: str) -> None:
    result.write.mode("overwrite").parquet(path)
