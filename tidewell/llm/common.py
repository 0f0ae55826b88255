"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(name: str) -> Column:
    """The column of that very name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores after it until df has no such column in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The session's folder that all executors share, under spark.checkpoint.dir.

    A session without that setting must be local; a cluster's executors share no temporary folder.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidewell-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and cut from its lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: an expression inside a lambda is computed anew for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def prefix_sums(numbers: Column, block: int = 256) -> Column:
    """array<long>: for each element the sum of those before it. Arrays grow by copying, so that is done in blocks."""
    none = F.array().cast("array<bigint>")

    def running(a: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(a, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")), step)

    def whole(a: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int"))
        return let(F.transform(cuts, lambda i: running(F.slice(a, i * block + 1, block))), lambda parts: let(
            running(F.transform(parts, lambda x: x["at"]))["out"], lambda base: F.flatten(F.zip_with(parts, base, lambda x, b: F.transform(x["out"], lambda v: v + b)))))

    return let(numbers, lambda a: F.when(F.size(a) <= block, running(a)["out"]).otherwise(whole(a)))


def ascii_lower(text: Column) -> Column:
    """text with A-Z only in lower case; the fast built-in serves texts that are ASCII throughout."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def content_key(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns' values: a 128-bit identity that is cheap to shuffle.

    A null hashes differently from an empty string.
    """
    marked = [c for x in columns for c in (x, x.isNull())]
    return [F.xxhash64(*marked), F.xxhash64(F.lit("second"), *marked)]


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod `mod` equals `remainder`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == remainder
