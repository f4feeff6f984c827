"""What several operators share: columns added through Arrow batches, folded letters, held-out rows, scratch tables."""

from __future__ import annotations

import ctypes
import gc
import unicodedata
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wirelake.session import scratch_path

#: Bytes that separate words: exactly those that bytes.split() takes.
SPACE = " \t\n\x0b\x0c\r"
#: Characters of text that a task works on at once, whatever the number of documents in an Arrow batch.
SLICE = 2_000_000


def without(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of `df` that no name of `names` would hide, whatever their case."""
    hidden = {x.lower() for x in names}
    return [x for x in df.columns if x.lower() not in hidden]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def slices(texts: list[str | None], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that together hold about `limit` characters; a longer text is a range of its own."""
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text or "") + 1
        if held >= limit:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def release_memory() -> None:
    """Gives free memory of a Python worker back to the system: the worker stays for other stages, which need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def add_columns(df: DataFrame, column: str, fields: list[T.StructField], make: Callable[[], Callable]) -> DataFrame:
    """`df` with columns computed from the texts in `column`; a column of `df` with such a name is replaced.

    `make` runs once in each task and returns a function from a list of texts (None for null) to one list or array
    for each field.
    """
    keep = without(df, [f.name for f in fields])
    at = keep.index(column) if column in keep and df.schema[column].dataType == T.StringType() else len(keep)
    given = df.select(*[quoted(x).alias(f"c{i}") for i, x in enumerate(keep)],
                      *[quoted(column).cast("string").alias("text")] * (at == len(keep)))
    schema = T.StructType([T.StructField(f"c{i}", df.schema[x].dataType) for i, x in enumerate(keep)]
                          + [T.StructField(f"o{i}", f.dataType) for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            texts = batch.column(at)
            for begin, end in slices(texts.to_pylist()):
                made = compute(texts.slice(begin, end - begin).to_pylist())
                kept = [batch.column(i).slice(begin, end - begin) for i in range(len(keep))]
                arrays = kept + [pa.array(v, type=arrow_type(f.dataType)) for v, f in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        del compute
        release_memory()

    out = given.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(keep)],
                      *[F.col(f"o{i}").alias(f.name) for i, f in enumerate(fields)])


def arrow_type(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
            "boolean": pa.bool_(), "binary": pa.binary()}[kind.simpleString()]


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
                                "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}[kind])


def bucket_of(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo `n`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(quoted(id_col).cast("string"), F.lit("")).cast("binary")) % n


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared scratch folder: computed once, safe against lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table of `written` that nothing reads any more."""
    spark = df.sparkSession
    for file in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends with a zero before them): each value as seven bits a byte, the highest bit set on all but its last."""
    values = values.astype(np.uint64)
    length = 1 + sum((values >= np.uint64(1 << 7 * k)).astype(np.int64) for k in range(1, 5))
    ends = np.concatenate([[0], np.cumsum(length)])
    out = np.zeros(int(ends[-1]), np.uint8)
    for k in range(5):
        here = np.flatnonzero(length > k)
        if len(here):
            more = (length[here] > k + 1).astype(np.uint8) << 7
            out[ends[here] + k] = (values[here] >> np.uint64(7 * k)).astype(np.uint8) & 127 | more
    return out, ends


def unpacked(raw: np.ndarray) -> np.ndarray:
    """The values of packed()."""
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    begins = np.concatenate([[0], ends[:-1] + 1])
    shift = np.arange(len(raw)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * shift, begins)


def folded_letter(ch: str, look_alike: dict[str, str]) -> str:
    """One character as matching sees it: a lower-case letter, or a space for whatever is none."""
    ch = look_alike.get(ch, ch)
    low = unicodedata.normalize("NFKC", ch).lower()
    low = look_alike.get(low, low)
    return low if low and low.isalpha() else " "


class Fold(dict):
    """A table for str.translate that works out characters as they come."""

    def __init__(self, look_alike: dict[str, str]):
        self.look_alike = look_alike

    def __missing__(self, code: int) -> str:
        self[code] = made = folded_letter(chr(code), self.look_alike)
        return made


def ridge_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic model by Newton's method; the first column is the constant and is hardly held back."""
    beta, hold = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    hold[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - hold * beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(bend, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta
