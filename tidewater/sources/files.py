"""Reading and writing series: CSV files named by symbol, Parquet tables."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is null everywhere: NaN in float columns becomes null."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns))


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of paths that exist, on any file system Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths_with = ((p, jvm.org.apache.hadoop.fs.Path(p)) for p in paths)
    return [p for p, at in paths_with if at.getFileSystem(conf).globStatus(at)]


def read_raw_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header row; types are inferred if no schema is given, which costs a pass."""
    reader = spark.read.option("header", True)
    return nan_to_null((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path))


def csv_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files of paths that exist: globs are matched, folders listed; names that begin with _ or . are no data."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    waiting, found = [], []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        waiting += at.getFileSystem(conf).globStatus(at) or []
    while waiting:
        status = waiting.pop()
        at = status.getPath()
        if status.isDirectory():
            waiting += [s for s in at.getFileSystem(conf).listStatus(at) if s.getPath().getName()[0] not in "_."]
        else:
            found.append(at.toString())
    return sorted(set(found))


def header_of(spark: SparkSession, path: str) -> tuple[str, ...] | None:
    """The column names in a CSV file's first line, unpacked where the file is; None if it is empty."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    stream = at.getFileSystem(conf).open(at)
    lines = None
    try:
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        first = lines.readLine()
    finally:
        (lines or stream).close()
    if not first:
        return None
    names = tuple(next(csv.reader([first.lstrip("\ufeff")])))
    if len(set(names)) < len(names):
        raise ValueError(f"{path} names a column twice: {names}")
    return names


def headers(spark: SparkSession, files: list[str], threads: int = 16) -> dict[tuple[str, ...], list[str]]:
    """The files of each header. One line of each is read, many at a time, as a schema is; empty files are left out."""
    with ThreadPoolExecutor(threads) as pool:
        named = zip(pool.map(lambda f: header_of(spark, f), files), files, strict=True)
        groups: dict[tuple[str, ...], list[str]] = {}
        for names, file in named:
            if names is not None:
                groups.setdefault(names, []).append(file)
    return groups


#: Types that values are tried as, in this order.
TRIED = ("bigint", "double", "boolean", "timestamp_ntz")


def inferred(df: DataFrame) -> dict[str, str]:
    """The first of TRIED that all known values of each text column have, else string: one pass over all files, so they agree."""
    names = df.columns
    fits = [F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull()).alias(f"{i}_{t}") for i, c in enumerate(names) for t in TRIED]
    misses = df.agg(*fits, *(F.count(f"`{c}`").alias(f"{i}_n") for i, c in enumerate(names))).first()
    return {c: next((t for t in TRIED if misses[f"{i}_{t}"] == 0), "string") if misses[f"{i}_n"] else "string" for i, c in enumerate(names)}


def read_by_header(spark: SparkSession, paths: list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV files whose columns differ in order or number, each read by its own header, as one table.

    Files of one header are read together; groups are united by name, and a column that a file
    lacks is null there. schema: the columns wanted and their types, others aren't read; without
    one the columns are those of all headers, by first appearance, and types are inferred over
    all files in one pass. file is each row's file.
    """
    groups = headers(spark, csv_files(spark, paths))
    if not groups and schema is None:
        raise ValueError(f"no file of {paths} has a header")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    wanted = schema.fieldNames() if schema else list(dict.fromkeys(c for names in groups for c in names))
    parts = []
    for names, files in groups.items():
        # A value is read as its type where one is known; enforceSchema off: Spark checks each file's header against the names.
        kinds = T.StructType([T.StructField(c, schema[c].dataType if schema and c in wanted else T.StringType()) for c in names])
        part = spark.read.option("header", True).option("enforceSchema", False).schema(kinds).csv(files)
        missing = {c: F.lit(None).cast(schema[c].dataType if schema else "string") for c in wanted if c not in names}
        parts.append(part.withColumns(missing).select(*(F.col(f"`{c}`") for c in wanted), F.input_file_name().alias("file")))
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("file", T.StringType())]))
    df = reduce(DataFrame.unionByName, parts)
    if schema is None:
        kinds = inferred(df.drop("file"))
        df = df.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in wanted), "file")
    return nan_to_null(df)


def read_series_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType | str | None = None, time: str = "time") -> DataFrame:
    """All files as one long table, each by its own header: symbol is a file's name up to its first underscore, time is parsed.

    A folder of part files, as Spark writes, counts as one file of the folder's name. Absent paths
    are skipped; if none exists it is an error. See read_by_header for columns and types.
    """
    found = present(spark, [paths] if isinstance(paths, str) else paths)
    if not found:
        raise FileNotFoundError(f"none of {paths} exists")
    steps = F.split("file", "/")
    name = F.when(F.element_at(steps, -1).startswith("part-"), F.element_at(steps, -2)).otherwise(F.element_at(steps, -1))
    df = read_by_header(spark, found, schema).withColumn("symbol", F.split(name, "_")[0]).drop("file")
    if not isinstance(df.schema[time].dataType, (T.TimestampNTZType, T.TimestampType)):
        df = df.withColumn(time, F.to_timestamp_ntz(F.col(time).cast("string")))
    return df.select("symbol", time, *(c for c in df.columns if c not in ("symbol", time)))


def write_csv(df: DataFrame, path: str, by_symbol: bool = False) -> None:
    """CSV with a header, a folder of files; with by_symbol a folder for each symbol."""
    writer = nan_to_null(df).write.mode("overwrite").option("header", True)
    (writer.partitionBy("symbol") if by_symbol else writer).csv(path)


def write_indexed_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """write_csv with a leading index column 0, 1, 2 ... in the stated order. For summary tables: the index is made in one task."""
    from pyspark.sql import Window

    index = (F.row_number().over(Window.orderBy(*order)) - 1).alias("index")
    write_csv(df.select(index, *df.columns), path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(folder).rstrip('/')}/{name}.parquet")
