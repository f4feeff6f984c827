"""Near duplicates of a wanted Jaccard similarity of shingle sets: complete candidates, then verification of every link.

Sets of similarity 0.8 share a shingle among the first fifth of each, in whatever order all shingles are put (prefix
filtering); here rare ones come first. So keys are the shingles of prefixes, and no pair is missed. Documents with equal
sets are one node; all other links are verified on the sets themselves, and groups are the components of verified links.

SimHash comes first: the classes of operator 3, over fingerprints of the same shingles, are checked set by set, together
with the few buckets of each set that most of its keys fall into. Then come all keys, whose sets are compared where nothing
has joined them yet. Sets that meet go together to the task that compares
them, by bitmaps and then whole, and what leaves it is one row for each set that found another: no table of pairs is made,
so rows grow with the sets and not with the square of a family. Keys under which the same sets meet are one bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wirelake.llm.common import discard, packed, quoted, release_memory, unpacked, written
from wirelake.llm.encoding import parts
from wirelake.llm.simhash import RADIUS, SEED, class_ids, components, fingerprint, shingle_hashes

_COUNTERS = 1 << 20
#: Sets of one bucket that a piece of work pairs with as many others, and members that they may have together.
BLOCK = 1024
BLOCK_MEMBERS = 2_000_000
#: Bytes that comparing bitmaps, or columns of members, takes at once.
WORK = 1 << 24
#: Buckets of a set that are tried before all others.
MAIN = 3
BROADCAST_ROWS = 1_000_000
#: Rows of buckets, of some thirty bytes each, up to which they are broadcast.
BROADCAST_LINKS = 500_000


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The different shingle hashes of a text in ascending order; none for a text without words."""
    return np.unique(shingle_hashes(text, shingle))


def set_name(hashes: np.ndarray) -> int:
    """XXH64 of a set of shingle hashes, as a signed integer: equal for equal sets."""
    from xxhash import xxh64_intdigest

    value = xxh64_intdigest(hashes.tobytes(), SEED)
    return value - (1 << 64) if value >> 63 else value


def prefix_length(size: int, similarity: float) -> int:
    """Members of a set, first in any one order of all shingles, of which a set that similar has one among its own first."""
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


#: Bytes kept of a hash in a stored set: equal ones within a pair of sets are taken as equal shingles.
_KEPT = 6


def stored_set(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEPT].tobytes()


def similar_sets(p: bytes, q: bytes, similarity: float) -> bool:
    """Whether two stored sets have at least that Jaccard similarity."""
    sets = []
    for value in (p, q):
        wide = np.zeros((len(value) // _KEPT, 8), np.uint8)
        wide[:, :_KEPT] = np.frombuffer(value, np.uint8).reshape(-1, _KEPT)
        sets.append(wide.view("<u8").ravel())
    both = len(np.intersect1d(*sets, assume_unique=True))
    return both >= similarity * (len(sets[0]) + len(sets[1]) - both) - 1e-9


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for the lower bits of each hash; four to eight bits a member, 64 at least, a power of two of them."""
    size = 1 << max(6, (4 * len(hashes)).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_similar(p: bytes, m: int, q: bytes, n: int, similarity: float) -> bool:
    """False only if bitmaps of sets of m and n members show that they share too few."""
    size = min(len(p), len(q))
    # As if made with as many bits: the halves of a bitmap lie over each other.
    folded = [np.bitwise_or.reduce(np.frombuffer(value, np.uint8).reshape(-1, size)) for value in (p, q)]
    met = int(np.bitwise_count(folded[0] & folded[1]).sum())
    most = met + min(k - int(np.bitwise_count(f).sum()) for k, f in zip((m, n), folded))
    return most >= similarity * (m + n - most) - 1e-9


def _counters(counted: DataFrame) -> np.ndarray:
    """Occurrences of shingles by the upper 20 bits of their hash, from (part, counts) of all tasks. They only order the
    shingles of a set, rare ones first: any order finds the same pairs, this one by fewer candidates."""
    part = _COUNTERS >> 8

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[i] = held.get(i, 0) + unpacked(np.frombuffer(x, np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())],
                                         names=["part", "counts"])

    out = np.zeros(_COUNTERS, np.int64)
    for r in counted.repartition("part").mapInArrow(add, "part bigint, counts binary").collect():
        out[r["part"] * part:(r["part"] + 1) * part] = np.frombuffer(r["counts"], np.int64)
    return out


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(columns, begins, lengths) of whole runs of equal values in the first `width` columns, which the rows are sorted by."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        own = own if held is None else [np.concatenate(x) for x in zip(held, own)]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in own[:width]])) + 1
        end = int(new[-1]) if len(new) else 0
        held = [c[end:] for c in own]
        if end:
            begin = np.concatenate([[0], new[:-1]])
            yield [c[:end] for c in own], begin, np.diff(np.append(begin, end))
    if held is not None:
        yield held, np.zeros(1, np.int64), np.array([len(held[0])])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, check, text) of all documents."""
    return docs.select(_mark(id_col, text_col).alias("mark"), quoted(text_col).cast("string").alias("text")).select("mark.*", "text")


def named_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, check, name, simhash) of all documents, and rows (id: part, counts) with the counters of each task, as one table.

    simhash is the fingerprint of operator 3, over shingles of `shingle` words."""
    part = _COUNTERS >> 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(_COUNTERS, np.int64)
        kinds, names = [pa.int64()] * 4 + [pa.binary()], ["id", "check", "name", "simhash", "counts"]
        for batch in batches:
            made, prints = [], []
            for text in batch.column(2):
                every = shingle_hashes(text.as_py(), shingle)
                hashes = np.unique(every)
                made.append(set_name(hashes))
                prints.append(fingerprint(every))
                np.add.at(held, (hashes >> np.uint64(44)).astype(np.int64), 1)
            rows = [batch.column(0), batch.column(1), pa.array(made, pa.int64()), pa.array(prints, pa.int64()), pa.nulls(len(made), pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, names=names)
        counts = [packed(held[i:i + part])[0].tobytes() for i in range(0, _COUNTERS, part)]
        none = [0] * len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((range(len(counts)), none, none, none, counts), kinds)], names=names)
        release_memory()

    return written(_texts(docs, id_col, text_col).mapInArrow(run, "id bigint, check bigint, name bigint, simhash bigint, counts binary"), "names")


def _of_nodes(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Rows of (id, check, name, ...) of the documents that stand for their set: the first of equal ones, or the only one."""
    hint = first.select(F.col("name").alias("same"), F.col("first.id").alias("first_id"), F.col("first.check").alias("first_check"))
    return rows.join(hint, F.col("name") == F.col("same"), "left") \
        .where("first_id is null or (id = first_id and check = first_check)").select(*[c for c in rows.columns if c not in ("id", "check")])


def _bucket_names(names: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A number for each run of set names, whatever their order; equal numbers of different runs only make one larger bucket."""
    x = (names.view(np.uint64) ^ (names.view(np.uint64) >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (np.bitwise_xor.reduceat(x ^ (x >> np.uint64(31)), begin) + n.astype(np.uint64)).view(np.int64)


def shared_keys(docs: DataFrame, first: DataFrame, counters: np.ndarray, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(bucket, name, keys): the sets whose prefixes share a shingle, two or more to a bucket, and by how many shingles.

    Every two sets of that similarity share such a key: this is complete, not by chance. Keys of the same sets are one bucket.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(counters)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = shipped.value
        for batch in batches:
            for begin, stop in parts(batch.column(2)):
                part = batch.slice(begin, stop - begin)
                names, chosen = [], []
                for text in part.column(2):
                    h = shingle_set(text.as_py(), shingle)
                    names.append(set_name(h))
                    order = np.argsort(counters[(h >> np.uint64(44)).astype(np.int64)], kind="stable")
                    chosen.append(h[order[:prefix_length(len(h), similarity)]])
                n = np.fromiter(map(len, chosen), np.int64, len(chosen))
                if not n.sum():
                    continue
                at = np.repeat(np.arange(len(n)), n)
                marks = [part.column(i).take(pa.array(at)) for i in (0, 1)]
                columns = [*marks, pa.array(np.array(names, np.int64)[at]), pa.array(np.concatenate(chosen).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "check", "name", "key"])
        release_memory()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, name), _, _ in _runs(batches, 1):
            # Rows equal in id and text are one document.
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
            key, name = key[once], name[once]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.append(begin, len(key)))
            more = np.repeat(n > 1, n)
            bucket = np.repeat(_bucket_names(name, begin, n), n)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[more]), pa.array(name[more])], names=["bucket", "name"])

    made = _texts(docs, id_col, text_col).mapInArrow(emit, "id bigint, check bigint, name bigint, key bigint")
    keys = _of_nodes(made, first).select("key", "name")
    return keys.repartition("key").sortWithinPartitions("key", "name").mapInArrow(met, "bucket bigint, name bigint") \
        .groupBy("bucket", "name").agg(F.count("*").alias("keys"))


def main_buckets(met: DataFrame) -> DataFrame:
    """(bucket, name): for each set the buckets that most of its keys fall into, where close copies are together.

    They come before the rest only to join groups early; which buckets do has no bearing on the result.
    """
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("keys"), "bucket"))
    return met.withColumn("place", place).where(F.col("place") <= MAIN).select("bucket", "name")


def simhash_buckets(printed: DataFrame, wanted: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(bucket, name): the sets of each class of operator 3, of those named in `wanted`.

    A class is what fingerprints of at most `radius` differing bits reach, its number the smallest fingerprint.
    """
    classes = class_ids(printed.select(F.col("simhash").alias("id"), "simhash"), radius)
    sets = printed.select("name", "simhash").distinct().join(wanted, "name", "left_semi")
    return sets.join(classes, "simhash").select(F.col("component_id").alias("bucket"), "name").distinct()


def class_links(printed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links from the set of smallest name in each class to all others there; `classes` as of `simhash.classes`."""
    marked = classes.select(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), "check", "class")
    named = written(printed.select("id", "check", "name").join(marked, ["id", "check"]).select("class", "name").distinct(), "classes")
    lowest = named.groupBy("class").agg(F.min("name").alias("a"), F.max("name").alias("last")).where("a < last").select("class", "a")
    return named.join(lowest, "class").where("a < name").select("a", F.col("name").alias("b")).distinct()


def stored_sets(docs: DataFrame, first: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(name, n, bits, hashes) of the sets named in `wanted`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in parts(batch.column(2)):
                part = batch.slice(begin, stop - begin)
                made = [shingle_set(text.as_py(), shingle) for text in part.column(2)]
                columns = [part.column(0), part.column(1), pa.array(list(map(set_name, made)), pa.int64()), pa.array(list(map(len, made)), pa.int32()),
                           pa.array(list(map(bitmap, made)), pa.binary()), pa.array(list(map(stored_set, made)), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "check", "name", "n", "bits", "hashes"])
        release_memory()

    made = _texts(docs, id_col, text_col).mapInArrow(run, "id bigint, check bigint, name bigint, n int, bits binary, hashes binary")
    return _of_nodes(made.join(wanted, "name", "left_semi"), first)


def _labels(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric table the first row that it reaches over true cells."""
    label = np.full(len(near), -1)
    for i in range(len(near)):
        if label[i] < 0:
            label[i] = i
            edge = np.array([i])
            while len(edge):
                edge = np.flatnonzero(near[edge].any(0) & (label < 0))
                label[edge] = i
    return label


def open_table(bits: list[bytes], size: np.ndarray, similarity: float) -> np.ndarray:
    """`may_be_similar` of every two sets, as a table."""
    width = np.fromiter(map(len, bits), np.int64, len(bits))
    out = np.zeros((len(bits), len(bits)), bool)
    kinds = np.unique(width)
    table = {w: np.frombuffer(b"".join(bits[i] for i in np.flatnonzero(width == w)), np.uint64).reshape(-1, w // 8) for w in kinds.tolist()}
    for w in kinds.tolist():
        for v in kinds[kinds >= w].tolist():
            if np.minimum(size[width == w].max(), size[width == v].max()) < similarity * size[width == v].min() - 1e-9:
                continue  # too different in size, all of them
            i, j = np.flatnonzero(width == w), np.flatnonzero(width == v)
            p, q = table[w], np.bitwise_or.reduce(table[v].reshape(len(j), -1, w // 8), axis=1)
            left, right = (size[x] - np.bitwise_count(y).sum(1, dtype=np.int64) for x, y in ((i, p), (j, q)))
            step = max(1, WORK // (w * len(j)))
            for at in range(0, len(i), step):
                a = slice(at, at + step)
                met = np.bitwise_count(p[a, None] & q[None]).sum(2, dtype=np.int64)
                most = met + np.minimum(left[a, None], right[None])
                good = most * (1 + similarity) >= similarity * (size[i[a], None] + size[j][None]) - 1e-9
                out[np.ix_(i[a], j)] = good
                out[np.ix_(j, i[a])] = good.T
    return out


def similar_table(stored: list[bytes], similarity: float) -> np.ndarray:
    """`similar_sets` of every two stored sets, as a table."""
    n = np.fromiter(map(len, stored), np.int64, len(stored)) // _KEPT
    wide = np.zeros((n.sum(), 8), np.uint8)
    wide[:, :_KEPT] = np.frombuffer(b"".join(stored), np.uint8).reshape(-1, _KEPT)
    _, member, times = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
    # Members of a single set are shared by none; the others are columns.
    shared = times > 1
    row, column = np.repeat(np.arange(len(n)), n)[shared[member]], (np.cumsum(shared) - 1)[member[shared[member]]]
    by_column = np.argsort(column, kind="stable")
    row, column = row[by_column], column[by_column]
    both, step = np.zeros((len(n), len(n)), np.float32), max(1, WORK // (4 * len(n)))
    for at in range(0, int(shared.sum()), step):
        b, e = np.searchsorted(column, (at, at + step))
        ones = np.zeros((len(n), step), np.float32)
        ones[row[b:e], column[b:e] - at] = 1
        both += ones @ ones.T
    return both.astype(np.float64) * (1 + similarity) >= similarity * (n[:, None] + n[None]) - 1e-9


def pieces(buckets: DataFrame, similarity: float) -> DataFrame:
    """(bucket, x, y, own, name, group) from (bucket, name, n, group): buckets of sets of different groups, with `n` members each.

    The sets of a large bucket are dealt into blocks, and each pair of blocks is a piece of work of its own.
    """
    mixed = buckets.groupBy("bucket").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("sets"), F.sum("n").alias("members")) \
        .where("low < high").select("bucket", F.ceil(F.greatest(F.col("sets") / BLOCK, F.col("members") / BLOCK_MEMBERS)).alias("blocks"))
    return buckets.join(mixed, "bucket").withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))) \
        .select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "name", "group")


def open_buckets(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(bucket, name) from `pieces`: smaller buckets, of what bitmaps do not rule out.

    Every two sets of different groups of a piece are together in one of these, unless bitmaps or sizes show that they are
    not similar.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, x, y, own, name, group, size, bits), begin, n in _runs(batches, 3):
            found, lengths = [], []
            for b, e in zip(begin.tolist(), (begin + n).tolist()):
                p = slice(b, e)
                if e - b == 2:
                    test = group[b] != group[b + 1] and (x[b] == y[b] or own[b] != own[b + 1]) \
                        and may_be_similar(bits[b], int(size[b]), bits[b + 1], int(size[b + 1]), similarity)
                    near = np.array([[False, test], [test, False]])
                else:
                    near = open_table(bits[p].tolist(), size[p].astype(np.int64), similarity) & (group[p][:, None] != group[p][None])
                    # From equal blocks each pair, from different ones those across.
                    near &= (x[b] == y[b]) | (own[p][:, None] != own[p][None])
                label = _labels(near)
                order = np.argsort(label, kind="stable")
                _, many = np.unique(label, return_counts=True)
                kept = np.repeat(many > 1, many)
                found.append(name[p][order][kept])
                lengths.append(many[many > 1])
            found, lengths = np.concatenate(found), np.concatenate(lengths)
            if len(found):
                bucket = np.repeat(_bucket_names(found, np.cumsum(lengths) - lengths, lengths), lengths)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(found)], names=["bucket", "name"])

    together = _with_sets(rows, sets, "n", "bits").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return together.mapInArrow(run, "bucket bigint, name bigint").distinct()


def verified(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) from (bucket, name): links that join what verified links join, fewer than the sets of a bucket.

    Verified links are all those in a bucket whose sets have at least that Jaccard similarity.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, name, hashes), begin, n in _runs(batches, 1):
            left, right = [], []
            for b, e in zip(begin.tolist(), (begin + n).tolist()):
                if e - b == 2:
                    label = np.array([0, 0 if similar_sets(hashes[b], hashes[b + 1], similarity) else 1])
                else:
                    label = _labels(similar_table(hashes[b:e].tolist(), similarity))
                linked = np.flatnonzero(label != np.arange(e - b))
                left.append(name[b + label[linked]])
                right.append(name[b + linked])
            a, b = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    together = _with_sets(rows, sets, "hashes").repartition("bucket").sortWithinPartitions("bucket")
    return together.mapInArrow(run, "a bigint, b bigint").distinct()


def _with_sets(rows: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """`rows` with columns of the sets that they name. Rows of a table, if few, are broadcast to the sets, so only what goes
    with a row is shuffled; else the sets are, those that a row names."""
    own = sets.select("name", *columns)
    if rows.count() <= BROADCAST_LINKS:
        return own.join(F.broadcast(rows), "name").select(*rows.columns, *columns)
    return rows.join(own.join(rows.select("name").distinct(), "name", "left_semi"), "name").select(*rows.columns, *columns)


def _links(buckets: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): verified links between sets of different groups of the buckets (bucket, name, group), see `verified`."""
    sized = buckets.join(sets.select("name", "n"), "name")
    rows = written(pieces(sized, similarity), "pieces")
    return written(verified(written(open_buckets(rows, sets, similarity), "open"), sets, similarity), "similar")


def _mark(id_col: str, text_col: str) -> Column:
    """Names a document by its id and text; rows equal in both are one document."""
    return F.struct(F.coalesce(quoted(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
                    F.xxhash64(quoted(id_col).cast("long"), quoted(text_col)).alias("check"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8,
           classes: DataFrame | None = None) -> DataFrame:
    """(mark, group): for each document (see `_mark`) the number of its group of near duplicates.

    Texts are near duplicates if their sets of shingles of `shingle` words (the whole text, if it is shorter) have at
    least that Jaccard similarity, directly or through others. All such pairs are found and no others, up to equal
    64-bit hashes of different shingles or sets. Null texts and texts without words are copies of each other.
    With `classes` (of `simhash.classes`) documents of one class are near duplicates too, whatever that similarity.
    """
    table = named_sets(docs, id_col, text_col, shingle)
    printed = table.where("counts is null").select("id", "check", "name", "simhash")
    # One document stands for all of an equal set; the others are those with another mark.
    mark = F.struct("id", "check")
    first = printed.groupBy("name").agg(F.min(mark).alias("first"), F.max(mark).alias("last")).where("first < last").select("name", "first")
    first = _small(written(first, "first"))
    counters = _counters(table.where("counts is not null").select(F.col("id").alias("part"), "counts"))
    # Rows equal in id and text are one document; only where there are such rows is a shuffle spent on it.
    once = printed.groupBy("id", "check").count().where("count > 1").isEmpty()
    met = written(shared_keys(docs, first, counters, id_col, text_col, shingle, similarity), "met")
    wanted = _small(written(met.select("name").distinct(), "wanted"))
    sets = stored_sets(docs, first, wanted, id_col, text_col, shingle)
    sets = written(sets if once else sets.dropDuplicates(["name"]), "sets")
    # Sets that meet under no key are not similar, whatever their fingerprints.
    near = simhash_buckets(printed, wanted).unionByName(main_buckets(met)).distinct()
    same = _links(near.withColumn("group", F.col("name")), sets, similarity)
    if classes is not None:
        same = same.unionByName(written(class_links(printed, classes), "linked"))
    roots = written(components(same), "components")
    rest = met.join(roots, F.col("name") == F.col("node"), "left").select("bucket", "name", F.coalesce("root", "name").alias("group"))
    roots = written(components(same.unionByName(_links(rest, sets, similarity))), "components")
    discard(sets)
    return printed.select(mark.alias("mark"), "name").join(roots, F.col("name") == F.col("node"), "left") \
        .select("mark", F.coalesce("root", "name").alias("group"))


def _small(df: DataFrame) -> DataFrame:
    """`df`, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8,
                  classes: DataFrame | None = None) -> DataFrame:
    """One row of each group of near duplicates (see `groups`): that with the smallest id (null before all; of equal ids, one).

    All columns of `docs` stay as they are; an empty table gives an empty one.
    """
    chosen = groups(docs, id_col, text_col, shingle, similarity, classes).groupBy("group").agg(F.min("mark").alias("mark")) \
        .select(F.col("mark.id").alias("key id"), F.col("mark.check").alias("key check"))
    rows = docs.select(*[quoted(x).alias(f"c{i}") for i, x in enumerate(docs.columns)], _mark(id_col, text_col).alias("mark"))
    rows = rows.select("*", F.col("mark.id").alias("key id"), F.col("mark.check").alias("key check")).drop("mark")
    # Rows equal in id and text are one document; both steps need the rows of a key together, so they share a shuffle.
    kept = rows.join(chosen, ["key id", "key check"]).dropDuplicates(["key id", "key check"])
    return kept.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(docs.columns)])
