"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import math
import os
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the text contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by a path that only Spark needs to be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(df: DataFrame) -> str:
    """The checkpoint folder: the session's spark.checkpoint.dir. Only where that is unset and all tasks run in the
    driver's own process (tests) is a local one made; a cluster without the setting is an error."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), f"echotrace-{os.getpid()}"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and read it from there, so that a lost executor
    costs no recomputation of what came before."""
    _folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like cut, as a Parquet table in the checkpoint folder: for tables of many rows, which take less room in columns."""
    path = f"{_folder(df)}/table-{uuid.uuid4()}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of what cut() or stored() has replaced and nothing refers to any more.

    Its cleaner acts when the driver's JVM collects garbage, which an idle driver may not do for long. What a
    finished query holds is given up by one collection, and what its plan held by a second."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until df has no such column in any case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(value: Column) -> Column:
    """A-Z to a-z, every other character as it is; lower() is used where it means the same."""
    return F.when(F.octet_length(value) == F.char_length(value), F.lower(value)).otherwise(F.translate(value, UPPER, LOWER))


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    """How many parts of about per_part rows each hold rows."""
    return max(least, math.ceil(rows / per_part))


def matched(rows: DataFrame, found: DataFrame, keys: list[str], count: str, hot_keys: int = 1000) -> DataFrame:
    """The inner join of rows with found, which has one row a key and says in count how many rows it is for.

    The hot_keys keys of most rows are broadcast, so that their rows do not meet in one task.
    """
    hot = F.broadcast(found.orderBy(F.desc(count), *keys).limit(hot_keys))
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(found, keys))
