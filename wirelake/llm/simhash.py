"""SimHash near-duplicates through Golay codes.

The 64 bits of a fingerprint are cut into three segments of 22, 21 and 21 bits, each read as a 23-bit word. The binary
Golay code is perfect: every word lies within three bits of one codeword. Two words that differ in two bits or fewer
have a codeword within four bits of both (take the word between them), so a word is filed under the indices of all
codewords within four bits: one or six of them.

If two fingerprints differ in two bits at most, some segment is equal in both, and the next segment differs in two
bits at most. So they meet under (segment, its bits, an index of the next segment), 33 to 34 bits of key. Different
fingerprints that meet are compared, and those within the bound are linked. Equal fingerprints are one row throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wirelake.llm.common import add_columns, field, quoted, without, written

SEED = 42
RADIUS = 2
_WIDTHS = (22, 21, 21)
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR = 0xC75


# ---- fingerprints

def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of the shingles of k words, repeats included; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - k + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:n - 1].tolist()]
    stops = (ends[min(k, len(words)) - 1:] - 1).tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for none. As a signed 64-bit integer."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes)).view(">i8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """`docs` with simhash (long): the fingerprint of each whole text, zero for texts without words."""
    return add_columns(docs, text_col, [field("simhash", "long")],
                       lambda: lambda texts: ([fingerprint(shingle_hashes(t, shingle)) for t in texts],))


# ---- Golay code

_TABLES: dict[str, np.ndarray] = {}


def _golay() -> dict[str, np.ndarray]:
    """syndrome: by 23-bit word its remainder; leader: by remainder the pattern of up to three wrong bits; near: by
    remainder the patterns of four bits (up to five) that also lead to a codeword; index: a codeword's upper 12 bits."""
    if _TABLES:
        return _TABLES
    powers = []
    value = 1
    for _ in range(23):
        powers.append(value)
        value <<= 1
        if value & 0x800:
            value ^= _GENERATOR
    parts = []
    for low, high in ((0, 12), (12, 23)):
        made = np.zeros(1 << (high - low), np.uint16)
        for b in range(high - low):
            made[1 << b:2 << b] = made[:1 << b] ^ powers[low + b]
        parts.append(made)
    leader = np.zeros(2048, np.uint32)
    near = np.zeros((2048, 5), np.uint32)
    found = np.zeros(2048, int)
    bit = [1 << i for i in range(23)]
    for i in range(23):
        leader[powers[i]] = bit[i]
        for j in range(i):
            leader[powers[i] ^ powers[j]] = bit[i] | bit[j]
            for k in range(j):
                three = powers[i] ^ powers[j] ^ powers[k]
                leader[three] = bit[i] | bit[j] | bit[k]
                for m in range(k):
                    s = three ^ powers[m]
                    near[s, found[s]] = bit[i] | bit[j] | bit[k] | bit[m]
                    found[s] += 1
    _TABLES.update(low=parts[0], high=parts[1], leader=leader, near=near, found=found)
    return _TABLES


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in `words`, index of a codeword within four bits), 12 bits each."""
    t = _golay()
    words = words.astype(np.uint32)
    s = t["low"][words & 0xFFF] ^ t["high"][words >> 12]
    at = np.arange(len(words))
    where, code = [at], [words ^ t["leader"][s]]
    for j in range(5):
        more = t["found"][s] > j
        where.append(at[more])
        code.append(words[more] ^ t["near"][s[more], j])
    # Systematic: a codeword is known by its upper 12 bits.
    return np.concatenate(where), np.concatenate(code) >> 11


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in `prints`, key): each key is two bits of segment number, the segment's bits and an index of the next."""
    unsigned = prints.view(np.uint64)
    cut = []
    low = 64
    for width in _WIDTHS:
        low -= width
        cut.append((unsigned >> np.uint64(low)) & np.uint64((1 << width) - 1))
    where, keys = [], []
    for i in range(3):
        at, index = codeword_indices(cut[(i + 1) % 3])
        where.append(at)
        keys.append(np.uint64(i) << np.uint64(40) | cut[i][at] << np.uint64(12) | index.astype(np.uint64))
    return np.concatenate(where), np.concatenate(keys).view(np.int64)


# ---- links

def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def links_in_bucket(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what the bucket connects: a forest over its fingerprints, fewer than there are of them."""
    n, parent = len(prints), list(range(len(prints)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for i in range(n - 1):
        for j in np.flatnonzero(_distances(prints[i + 1:], prints[i]) <= radius) + i + 1:
            a, b = root(i), root(int(j))
            if a != b:
                parent[b] = a
                out.append((int(prints[i]), int(prints[j])))
    return out


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal keys of sorted (key, print) rows; a run is held from batch to batch."""
    held_key, held_print = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def bucket_links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        left, right = [], []
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, int)
        size = np.diff(edge)
        for length in (2, 3):  # most buckets: every pair at once
            first = edge[:-1][size == length]
            for i in range(length):
                for j in range(i + 1, length):
                    a, b = prints[first + i], prints[first + j]
                    near = _distances(a, b) <= radius
                    left.append(a[near])
                    right.append(b[near])
        for begin, length in zip(edge[:-1][size > 3], size[size > 3]):
            found = links_in_bucket(prints[begin:begin + length], radius)
            if found:
                pairs = np.array(found, np.uint64)
                left.append(pairs[:, 0])
                right.append(pairs[:, 1])
        if not left:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
        a, b = np.concatenate(left), np.concatenate(right)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in np.ascontiguousarray(pairs)], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([held_key, batch.column(0).to_numpy()])
        prints = np.concatenate([held_print, batch.column(1).to_numpy().view(np.uint64)])
        if not len(keys):
            continue
        begin = int(np.searchsorted(keys, keys[-1]))
        held_key, held_print = keys[begin:], prints[begin:]
        if begin:
            yield bucket_links(keys[:begin], prints[:begin])
    yield bucket_links(held_key, held_print)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between different fingerprints of `prints` (one column, simhash, no repeats).

    Every two fingerprints that differ in `radius` bits or fewer are connected by links, directly or through others
    of their bucket; a bucket gives fewer links than it has members. A task holds the distinct fingerprints of one
    bucket, eight bytes each: those that share 21 or more bits and lie around one codeword.
    """
    if radius > 2:
        raise ValueError("three segments and indices within four bits cover two differing bits")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for i in range(0, len(own), 1 << 15):
                part = np.ascontiguousarray(own[i:i + (1 << 15)])
                at, keys = keys_of(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[at])], names=["key", "simhash"])

    met = prints.mapInArrow(emit, "key bigint, simhash bigint").repartition("key").sortWithinPartitions("key", "simhash")
    return met.mapInArrow(lambda b: _links(b, radius), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of `edges` (a, b) the smallest node it can reach.

    Hook and shortcut: each round a node takes the smallest root among its neighbours' and then its root's root.
    Rounds are tables in the shared folder, so no lineage grows and lost executors cost one round at most.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    roots = written(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.least("a", "b").alias("root")), "roots")
    while True:
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("near"))
        hooked = roots.join(near, roots["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("low"))
        # A root hears of lower roots from all nodes that hang on it.
        better = hooked.where("low < root").groupBy(F.col("root").alias("was")).agg(F.min("low").alias("now"))
        jumped = hooked.join(better, hooked["root"] == better["was"], "left").select(
            "node", "root", F.least("low", F.coalesce("now", "low")).alias("low"))
        step = written(jumped, "roots")
        if step.where("low < root").isEmpty():
            return step.select("node", F.col("low").alias("root"))
        up = step.select(F.col("node").alias("up"), F.col("low").alias("upper"))
        roots = written(step.join(up, step["low"] == up["up"], "left").select(
            "node", F.coalesce("upper", "low").alias("root")), "roots")


def _prints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, simhash, check) of all documents, as a table; check is a hash of id and text."""
    return written(with_fingerprints(docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
                                     .withColumn("check", F.xxhash64("id", "text")), "text", shingle).select("id", "simhash", "check"), "prints")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(members, classes): `docs` with simhash and component_id, and (simhash, component_id) by distinct fingerprint.

    component_id is the smallest id of the documents reachable over links of at most `radius` differing bits; null
    ids count for nothing unless a component has no other. Null and empty texts have fingerprint zero and are linked
    like any other. A column of such a name is replaced; equal rows stay as many as they are; an empty table gives
    an empty one.
    """
    keep = without(docs, ["simhash", "component_id"])
    printed = _prints(docs, id_col, text_col, shingle)
    classes = class_ids(printed, radius)
    if [x.lower() for x in keep] == [id_col.lower()]:
        return printed.join(classes, "simhash").select(F.col("id").alias(id_col), "simhash", "component_id"), classes
    by_row = printed.join(classes, "simhash").groupBy("id", "check").agg(
        F.first("simhash").alias("simhash"), F.first("component_id").alias("component_id"))
    rows = docs.select(*[quoted(x).alias(f"c{i}") for i, x in enumerate(keep)], quoted(id_col).cast("long").alias("own id"),
                       F.xxhash64(quoted(id_col).cast("long"), quoted(text_col)).alias("own check"))
    return rows.join(by_row, F.col("own id").eqNullSafe(F.col("id")) & (F.col("own check") == F.col("check"))) \
        .select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(keep)], "simhash", "component_id"), classes


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(id, check, class) of all documents, rows equal in id and text once: those that `near_duplicates` gives one
    component_id have one class, which is its smallest fingerprint and so never null."""
    printed = _prints(docs, id_col, text_col, shingle)
    of = class_ids(printed.select(F.col("simhash").alias("id"), "simhash"), radius)
    return printed.join(of, "simhash").select("id", "check", F.col("component_id").alias("class")).distinct()


def class_ids(printed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(simhash, component_id) from (id, simhash)."""
    distinct = written(printed.groupBy("simhash").agg(F.min("id").alias("first_id")), "distinct")
    roots = components(links(distinct.select("simhash"), radius))
    rooted = distinct.join(roots, distinct["simhash"] == roots["node"], "left") \
        .select("simhash", "first_id", F.coalesce("root", "simhash").alias("root"))
    lowest = rooted.where("root <> simhash or first_id is not null").groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(lowest, "root", "left").select("simhash", "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id (of equal ids, the first by text)."""
    printed = _prints(docs, id_col, text_col, shingle)
    classes = class_ids(printed, radius)
    marked = printed.join(classes, "simhash")
    chosen = marked.groupBy(F.coalesce("component_id", "simhash").alias("group"), F.col("component_id").isNull().alias("none")) \
        .agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "check")).alias("best")).select("best.id", "best.check")
    chosen = chosen.select(_no_null("id").alias("key id"), F.col("check").alias("key check"))
    rows = docs.select(*[quoted(x).alias(f"c{i}") for i, x in enumerate(docs.columns)], _no_null(id_col).alias("key id"),
                       F.xxhash64(quoted(id_col).cast("long"), quoted(text_col)).alias("key check"))
    # Rows equal in id and text are one document; both steps need the rows of a key together, so they share a shuffle.
    kept = rows.join(chosen, ["key id", "key check"]).dropDuplicates(["key id", "key check"])
    return kept.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(docs.columns)])


def _no_null(name: str):
    return F.coalesce(quoted(name).cast("long"), F.lit(-(1 << 63)))
