"""The packet table on disk: a folder of parquet files, partitioned by day."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wirelake.errors import one_of
from wirelake.functions.scalars import epoch_to_timestamp, format_bytes, micros_to_timestamp
from wirelake.schema import PACKET_SCHEMA

# Codecs the writer takes. brotli and lzo are known names without a codec in a stock Spark.
CODECS = ("snappy", "none", "uncompressed", "gzip", "lz4", "lz4_raw", "zstd")


def normalise(df: DataFrame, strict: bool = False) -> DataFrame:
    """Bring packet columns of another writer to the types of `PACKET_SCHEMA`; other columns stay as they are.

    Epoch numbers and zoned timestamps become TIMESTAMP_NTZ (UTC). Integer columns keep their width unless
    `strict`, because a cast would keep filters on them from reaching the parquet scan.
    """
    wanted = {f.name: f.dataType for f in PACKET_SCHEMA}
    columns = []
    for field in df.schema:
        have, want = field.dataType, wanted.get(field.name)
        column = F.col(f"`{field.name}`")
        same_kind = isinstance(have, T.IntegralType) and isinstance(want, T.IntegralType)
        if want is None or have == want or (same_kind and not strict):
            columns.append(column)
        elif isinstance(want, T.TimestampNTZType) and isinstance(have, T.NumericType):
            columns.append(epoch_to_timestamp(column).alias(field.name))
        elif isinstance(want, T.TimestampNTZType) and isinstance(have, T.TimestampType):
            columns.append(micros_to_timestamp(F.unix_micros(column)).alias(field.name))
        elif isinstance(want, (T.ArrayType, T.MapType)) or isinstance(have, (T.ArrayType, T.MapType, T.StructType)):
            columns.append(F.to_json(column).alias(field.name) if isinstance(want, T.StringType) else column)
        else:
            columns.append(column.try_cast(want).alias(field.name))
    return df.select(*columns)


def load_packets(spark: SparkSession, path: str) -> DataFrame:
    """Read packet parquet of any origin: columns of all files are merged, types normalised.

    A missing path raises AnalysisException (PATH_NOT_FOUND), a corrupt file a SparkException.
    """
    return normalise(spark.read.option("mergeSchema", True).parquet(path))


def load_landed(spark: SparkSession, path: str) -> DataFrame:
    """Read a table written by `save_packets`: fixed schema, so no footer is read before the query runs.

    Columns a file lacks are null. Filters on event_date prune folders.
    """
    return spark.read.schema(PACKET_SCHEMA).parquet(path)


def land_columns(df: DataFrame) -> DataFrame:
    """The frame as it is stored: normalised types, plus the partition column."""
    df = normalise(df, strict=True)
    if "timestamp" in df.columns and "event_date" not in df.columns:
        df = df.withColumn("event_date", F.to_date("timestamp"))
    return df


def _write(df: DataFrame, path: str, compression: str, mode: str, rebalance: bool) -> None:
    one_of("compression", compression, CODECS)
    df = land_columns(df)
    dated = "event_date" in df.columns
    if rebalance and dated:
        # Files of an even size per day; a day that is much larger than others is split again at run time.
        df = df.hint("rebalance", "event_date")
    writer = df.write.mode(mode).option("compression", compression)
    (writer.partitionBy("event_date") if dated else writer).parquet(path)


def save_packets(df: DataFrame, path: str, compression: str = "snappy", rebalance: bool = True) -> None:
    """Overwrite the packet table at `path`."""
    _write(df, path, compression, "overwrite", rebalance)


#: Columns by which a host is looked for.
ADDRESSES = ("IP_src", "IP_dst", "IPv6_src", "IPv6_dst")


def _place(df: DataFrame, bits: int = 6) -> Column:
    """A packet's place on a Z-curve over (hash of the source, hash of the destination): 4^bits cells."""
    ends = [F.coalesce(*[F.col(c) for c in ADDRESSES if c.endswith(end) and c in df.columns], F.lit("")) for end in ("_src", "_dst")]
    hashes = [F.pmod(F.xxhash64(e), F.lit(1 << bits)) for e in ends]
    return sum((F.call_function("shiftright", h, F.lit(i)).bitwiseAND(F.lit(1)) * (1 << (2 * i + k))
                for k, h in enumerate(hashes) for i in range(bits)), F.lit(0).cast("bigint"))


def save_clustered(df: DataFrame, path: str, compression: str = "snappy", group_bytes: int = 16 << 20) -> None:
    """Overwrite the packet table at `path` in a layout for looking up hosts.

    Inside a day, packets are range-partitioned and sorted along a Z-curve over both hosts (and then by time, which splits
    a busy pair), in row groups of `group_bytes`. A host's packets lie in about a square root of all cells, and the
    dictionaries and bloom filters of the address columns let a scan pass over the other row groups. All four address
    columns are written, null where `df` lacks them: a test of either address reaches the files only if they have both.
    """
    one_of("compression", compression, CODECS)
    df = land_columns(df)
    df = df.withColumns({c: F.lit(None).cast("string") for c in ADDRESSES if c not in df.columns})
    keys = [c for c in ("event_date",) if c in df.columns] + ["_place"] + [c for c in ("timestamp",) if c in df.columns]
    ordered = df.withColumn("_place", _place(df)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_place")
    writer = ordered.write.mode("overwrite").option("compression", compression).option("parquet.block.size", group_bytes)
    for column in ADDRESSES:
        if column in df.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    (writer.partitionBy("event_date") if "event_date" in df.columns else writer).parquet(path)


def append_packets(df: DataFrame, path: str, compression: str = "snappy", rebalance: bool = True) -> None:
    """Add packets to the table. Only new files are written; columns may differ from those already there."""
    _write(df, path, compression, "append", rebalance)


def concat_packets(*frames: DataFrame) -> DataFrame:
    """Union of frames with different columns; what a frame lacks is null."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def save_to_parquet(df: DataFrame, folder: str, name: str = "packets", compression: str = "snappy") -> str:
    """Write to `<folder>/<name>_<epoch>.parquet` and return that path."""
    path = f"{folder.rstrip('/')}/{name}_{int(time.time())}.parquet"
    save_packets(df, path, compression)
    return path


def get_schema(spark: SparkSession, path: str) -> DataFrame:
    """(column, type) of the table, from footers only."""
    schema = spark.read.parquet(path).schema
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema], "column string, type string")


def get_file_info(spark: SparkSession, path: str) -> DataFrame:
    """One row: path, name, number of part files, size, number of columns and the schema text.

    Sizes come from the file listing (the content column of the source is pruned), so no packet is read.
    """
    schema = spark.read.parquet(path).schema
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.parquet").load(path))
    return (
        files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"))
        .select(F.lit(path).alias("path"), F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("name"), "files",
                "size_bytes", (F.col("size_bytes") / F.lit(1024.0 * 1024.0)).alias("size_mb"),
                format_bytes(F.col("size_bytes")).alias("size_formatted"),
                F.lit(len(schema)).alias("columns"), F.lit(schema.simpleString()).alias("schema"))
    )


def validate_parquet(spark: SparkSession, path: str) -> bool:
    """True when every footer below `path` can be read (they are read by a distributed job). Never raises."""
    try:
        return len(spark.read.option("mergeSchema", True).parquet(path).schema) > 0
    except AnalysisException:
        return False
    except PySparkException as error:
        return "CANNOT_MERGE_SCHEMAS" in str(error)  # all were readable, they only disagree
    except Exception:
        return False
