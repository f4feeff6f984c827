"""Exact top-k by inner product: vectors by descending length, rotated partial sums, Cauchy-Schwarz bounds.

Vectors are turned by an orthonormal basis in which the first coordinates hold most of their squares. Blocks of
candidates are visited by descending length. A query whose k-th score so far is above its length times the block's is
done with the block unread; else the first coordinates give a partial product, and the lengths of what is left bound
the rest. Only pairs whose bound reaches the k-th score are worked out, in whole numbers, so results are exact.

Queries and candidates are blocks of rows. Candidates are striped over chunks; a task has one block of queries and one
chunk, whose blocks stream by one at a time, and gives k rows for each query, which are merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wirelake.llm.common import quoted, written

BLOCK = 2048
QUERY_BLOCK = 1024
CHUNK_BLOCKS = 8
LEADING = 16
SAMPLE = 10_000
_EXACT = float(1 << 53)


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(id, vec, norm): floor(scale x) of every component, for vectors that are not null and hold finite numbers only."""
    x = quoted(vec_col)
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    rows = vectors.where(quoted(id_col).isNotNull() & fine).select(
        quoted(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("vec"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)))


def basis(rows: DataFrame, dims: int, sample: int = SAMPLE) -> np.ndarray:
    """Orthonormal columns, those with the largest share of the squares first, from at most `sample` rows.

    Any orthonormal basis gives right results; this one only makes the bounds tight.
    """
    n = max(1, rows.count())
    share = min(1.0, 0.9 * sample / n)
    part = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("vec").limit(sample).toArrow()
    x = padded(part.column("vec").to_pylist(), dims)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    _, turned = np.linalg.eigh((x / np.maximum(length, 1e-300)).T @ (x / np.maximum(length, 1e-300)))
    return turned[:, ::-1]


def padded(vectors: Sequence[list[float]], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _blocks(rows: DataFrame, size: int, dims: int) -> DataFrame:
    """(block, ids, vecs): rows by descending length, `size` to a block; bytes of int64 and double.

    Rows are numbered inside their range of lengths; with the counts of the ranges that gives each its place among
    all, so blocks are full however many partitions there are.
    """
    ordered = rows.repartitionByRange(F.desc("norm"), F.xxhash64("id")).sortWithinPartitions(F.desc("norm"), "id")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), *batch.columns],
                                             names=["part", "at", "id", "vec"])
            at += n

    numbered = written(ordered.select("id", "vec").mapInArrow(number, "part int, at bigint, id bigint, vec array<double>"), "numbered")
    before = numbered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.expr(
        "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    place = (F.col("before") + F.col("at")).alias("place")
    placed = numbered.join(F.broadcast(before), "part").select("id", "vec", place)  # one row per partition
    placed = placed.withColumn("block", F.floor(F.col("place") / size).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if at is not None and row[0] != at:
                    yield block(at, held)
                    held = []
                at = row[0]
                held.append(row[1:])
        if held:
            yield block(at, held)

    def block(at: int, held: list[tuple]) -> pa.RecordBatch:
        ids, vecs = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]),
                                           pa.array([padded(vecs, dims).tobytes()])], names=["block", "ids", "vecs"])

    packed = placed.repartition("block").sortWithinPartitions("block", "place").select("block", "id", "vec") \
        .mapInArrow(pack, "block int, ids binary, vecs binary")
    return written(packed, "blocks")


class Best:
    """The k best candidates of each query of a block so far: higher score first, then smaller id."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.vecs, self.turn, self.k = ids, vecs, turn, k
        self.norm = np.linalg.norm(vecs, axis=1)
        self.lead = vecs @ turn[:, :LEADING]
        self.rest = np.sqrt(np.maximum(self.norm ** 2 - (self.lead ** 2).sum(1), 0))
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        norm = np.linalg.norm(vecs, axis=1)
        slack = 1 + 1e-9 * self.norm * norm.max(initial=0)  # rounding of the bounds
        open_ = np.flatnonzero(self.norm * norm.max(initial=0) + slack >= self.least)
        if not len(open_):
            return
        lead = vecs @ self.turn[:, :LEADING]
        rest = np.sqrt(np.maximum(norm ** 2 - (lead ** 2).sum(1), 0))
        bound = self.lead[open_] @ lead.T + np.outer(self.rest[open_], rest) + slack[open_, None]
        may = (bound >= self.least[open_, None]) & (ids[None, :] != self.ids[open_, None])
        columns = np.flatnonzero(may.any(0))
        if not len(columns):
            return
        columns = columns[np.argsort(ids[columns], kind="stable")]
        score = np.where(may[:, columns], self.products(open_, vecs[columns]), -np.inf)
        enough = np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k] if score.shape[1] > self.k else -np.inf
        least = np.maximum(self.least[open_], enough)
        # Of those that tie with the last place, the k with the smallest ids are enough.
        tie = (score == least[:, None]) & (score > -np.inf)
        r, c = np.nonzero((score > least[:, None]) | tie & (np.cumsum(tie, axis=1) <= self.k))
        self.merge(open_[r], ids[columns][c], score[r, c])

    def products(self, rows: np.ndarray, vecs: np.ndarray) -> np.ndarray:
        """Inner products of whole numbers; exact in doubles as long as no product of lengths passes 2^53."""
        if self.norm[rows].max() * np.linalg.norm(vecs, axis=1).max() >= _EXACT:
            raise OverflowError("inner products beyond 2^53 are not supported")
        return self.vecs[rows] @ vecs.T

    def merge(self, row: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        row, id_, score = (np.concatenate(x) for x in ((self.row, row), (self.id, id_), (self.score, score)))
        order = np.lexsort((id_, -score, row))
        row, id_, score = row[order], id_[order], score[order]
        begin = np.searchsorted(row, row)
        kept = np.arange(len(row)) - begin < self.k
        self.row, self.id, self.score = row[kept], id_[kept], score[kept]
        n = np.bincount(self.row, minlength=len(self.ids))
        last = np.cumsum(n) - 1
        full = n >= self.k
        self.least[full] = self.score[last[full]]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k best other rows.

    Components are floor(scale x); a score is the inner product, a whole number; ties go to the smaller id. Rows
    with an id that is null, or a vector that is null or holds null, NaN or infinite components, take no part. Vectors
    of different length compare as if filled up with zeros; an empty vector scores zero. Rows that share the id of a
    query are that query's own and no candidates; repeated query rows are answered each for itself. Fewer candidates
    than k give all of them; an empty table gives no row. Only the two named columns are read, so no other can clash.
    Lengths whose product passes 2^53 raise an error.
    """
    spark = vectors.sparkSession
    rows = written(whole_vectors(vectors, id_col, vec_col, scale), "vectors")
    dims = rows.agg(F.max(F.size("vec"))).head()[0] or 0
    if not dims:
        dims = 1
    shipped = spark.sparkContext.broadcast(basis(rows, dims))
    candidates = _blocks(rows, BLOCK, dims)
    queries = _blocks(rows.where(F.col("id") % every == 0), QUERY_BLOCK, dims)
    n_blocks, n_queries = candidates.count(), queries.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chunks = -(-n_blocks // CHUNK_BLOCKS)
    asked = queries.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select(
        F.col("block").alias("asked"), F.col("chunk").cast("int"), F.lit(-1).cast("int").alias("turn"), "ids", "vecs")
    offered = candidates.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))).select(
        F.col("asked").cast("int"), (F.col("block") % chunks).cast("int").alias("chunk"), F.col("block").alias("turn"), "ids", "vecs")
    met = asked.unionByName(offered).repartition(min(10_000, 4 * chunks * n_queries), "asked", "chunk") \
        .sortWithinPartitions("asked", "chunk", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = None, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(len(best.row), at, np.int32)), pa.array(best.row.astype(np.int32)), pa.array(best.ids[best.row]),
                pa.array(best.id), pa.array(best.score.astype(np.int64))], names=["asked", "row", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                asked_at, _, turn, ids, vecs = (batch.column(j)[i].as_py() for j in range(5))
                ids, vecs = np.frombuffer(ids, np.int64), np.frombuffer(vecs).reshape(-1, dims)
                if turn < 0:
                    if best is not None:
                        yield result()
                    best, at = Best(ids, vecs, shipped.value, k), asked_at
                else:
                    best.add(ids, vecs)
        if best is not None:
            yield result()

    found = met.mapInArrow(run, "asked int, row int, query_id bigint, vec_id bigint, score bigint")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by asked, row order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
