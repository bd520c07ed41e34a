"""Tables by path: CSV, gzipped CSV and Parquet, by extension; required columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The spellings of a missing value in CSV.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header, quoted fields over several lines, and every spelling of a missing value as null."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema=schema, inferSchema=schema is None)
    strings = {c: F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")) for c, t in df.dtypes if t == "string"}
    return df.withColumns(strings) if strings else df


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet if the path says so, else CSV (gzip by extension; such a file is read in one task, so it is dealt out)."""
    if path.lower().endswith(".parquet"):
        return spark.read.parquet(path)
    df = read_csv(spark, path, schema)
    return df.repartition(spark.sparkContext.defaultParallelism) if path.lower().endswith(".gz") else df


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    if path.lower().endswith(".parquet"):
        df.write.mode(mode).parquet(path)
    else:
        df.write.mode(mode).csv(path, header=True, quote='"', escape='"', compression="gzip" if path.lower().endswith(".gz") else None)


def write_both(df: DataFrame, base: str, mode: str = "overwrite") -> None:
    """base.csv and base.parquet, computed once."""
    df = df.persist()
    try:
        write_table(df, f"{base}.csv", mode)
        write_table(df, f"{base}.parquet", mode)
    finally:
        df.unpersist()


def require_columns(df: DataFrame, names: list[str]) -> dict[str, str]:
    """Each name with the column that has it in any case; raises if one is missing."""
    have = {c.lower(): c for c in df.columns}
    for n in names:
        if n.lower() not in have:
            raise ValueError(f"missing required column {n!r}")
    return {n: have[n.lower()] for n in names}


def first_of(df: DataFrame, names: list[str]) -> str:
    """The first of these columns that df has; raises if it has none."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of the columns {names} is there")


def column(df: DataFrame, name: str) -> Column:
    return df[f"`{name}`"]


def require_path(spark: SparkSession, path: str) -> None:
    """Raises FileNotFoundError if nothing is at path, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)


def require_unique(df: DataFrame, key: str) -> None:
    """Raises if a value of key is on several rows."""
    twice = df.groupBy(key).count().where("count > 1").select(key).take(1)
    if twice:
        raise ValueError(f"{key} {twice[0][0]!r} is not unique")


def mirrored_base(path: str) -> str:
    """cleaned_data/<what follows the first data/>/<stem>_norm."""
    from pathlib import PurePosixPath

    parts = PurePosixPath(path).parts
    tail = PurePosixPath(*parts[parts.index("data") + 1 :]) if "data" in parts else PurePosixPath(PurePosixPath(path).name)
    return str(PurePosixPath("cleaned_data") / tail.parent / f"{tail.stem}_norm")
