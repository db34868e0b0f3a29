"""Writers for the output forms: quoted CSV, JSON lines, plain text, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV with a header, all fields quoted, quotes doubled, lines ended by CR LF."""
    df.write.mode("overwrite").options(header="true", quoteAll="true", escape='"', lineSep="\r\n").csv(folder)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def write_text(df: DataFrame, column: str, folder: str) -> None:
    df.select(column).write.mode("overwrite").text(folder)


def append_log(df: DataFrame, folder: str) -> None:
    """Append-only: rows that are written stay."""
    df.write.mode("append").parquet(folder)
