"""Sinks: files, keyed upserts, and the INSERT INTO sugar."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import latest


def file_sink(df: DataFrame, path: str, fmt: str = "ndjson") -> None:
    """Appends rows as CSV (with a header) or as one JSON document per line."""
    if fmt == "csv":
        df.write.mode("append").option("header", True).csv(path)
    elif fmt == "ndjson":
        df.write.mode("append").option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(fmt)


def upsert_writer(keys: list[str], apply: Callable[[DataFrame, DataFrame, int], None], arrival: str = "_arrival") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hands (upserts, deletes, epoch) to apply, from the last delta of each key; rows that lack a key are skipped."""

    def write(batch: DataFrame, epoch: int) -> None:
        whole = batch.filter(" and ".join(f"`{k}` is not null" for k in keys))
        last = latest.latest_by(whole, keys, arrival)
        apply(last.filter("_weight > 0").drop("_weight", arrival), last.filter("_weight <= 0").select(*keys), epoch)

    return write


def fan_out(*writers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One batch to several sinks, computed once."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            for w in writers:
                w(batch, epoch)
        finally:
            batch.unpersist()

    return write


def split_insert(text: str) -> tuple[str | None, str]:
    """(sink name or None, the statement) of INSERT INTO name SELECT ..."""
    m = re.match(r"\s*INSERT\s+INTO\s+([A-Za-z_]\w*)\s+(?=SELECT\b|WITH\b)", text, re.IGNORECASE)
    return (m[1], text[m.end() :]) if m else (None, text)


def metrics(df: DataFrame, name: str) -> DataFrame:
    """df whose progress reports carry rows_out and the latest event time under `name`."""
    return df.observe(name, F.count(F.lit(1)).alias("rows_out"), *([F.max("_ts").alias("latest_ts")] if "_ts" in df.columns else []))
