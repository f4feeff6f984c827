"""Benchmark decontamination by a distributed positional inverted index.

The words of the documents are numbered through a segment, a bounded number of whole documents of one task, and each
word's places are stored with it as a posting list. Segments are independent, so a word in a third of all documents is
many lists of bounded length. Test items are inverted too: each of their words has a list of (item, place). A join by
word brings both lists together, grouped by segment and by block of items, and there the lists of a window are
intersected, shifted by the words' offsets, beginning with its rarest word.

A window's anchor is its rarest word in the segment. From each occurrence of an anchor the item is followed to both
sides as far as the lists go on holding its words, at most a window's length: that finds every window with this anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wirelake.llm.common import packed, quoted, unpacked, written
from wirelake.llm.encoding import bytes_of, parts

WINDOW = 10
#: Words of a segment, which is whole documents: a longer document is a segment of its own.
SEGMENT = 6_000_000
#: Words of the test items of a block.
BLOCK = 1_000_000
#: Occurrences of anchors that are followed at once.
CANDIDATES = 1 << 20
#: Bytes of inverted items up to which they are broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 32_000_000
#: Rows of the index in an Arrow batch.
ROWS = 1 << 15
#: The term of the row that describes a segment's documents, or a block's items; no word is empty.
ABOUT = ""

_INDEX = "segment bigint, term string, n bigint, body binary"
#: By byte: A-Z folded to a-z, a space for all that separates words.
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], np.uint8)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts as a string array, number of words of each text): A-Z folded, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`."""
    raw, edges = bytes_of(texts)
    folded = _FOLD[raw]
    kept = folded != 0x20
    begins = kept.copy()
    begins[1:] &= ~kept[:-1]
    first = edges[:-1][edges[:-1] < edges[1:]]
    begins[first] = kept[first]
    where = np.flatnonzero(begins)
    before = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])
    ends = np.append(before[where], before[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(where), [None, pa.py_buffer(ends), pa.py_buffer(folded[kept])])
    return words, np.diff(np.searchsorted(where, edges))


# ---- posting lists

def _segment_rows(number: int, words: list[pa.Array], lengths: np.ndarray, ids: list[int | None]) -> Iterator[pa.RecordBatch]:
    """The rows of a segment: its documents, then each word with its places. Between documents one place is empty."""
    names = ["segment", "term", "n", "body"]
    about = b"".join([np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], "u1").tobytes(), lengths.astype("<i8").tobytes()])
    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ABOUT]), pa.array([len(ids)]), pa.array([about], pa.binary())], names=names)
    coded = pa.concat_arrays(words).dictionary_encode()
    terms, own = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    if not len(own):
        return
    places = np.arange(len(own)) + np.repeat(np.arange(len(lengths)), lengths)
    keys = np.sort(own << 32 | places)
    own, places = keys >> 32, keys & 0xFFFFFFFF
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    gaps = np.diff(places, prepend=0)
    gaps[first] = places[first]
    raw, ends = packed(gaps)
    n = np.diff(np.append(first, len(own)))
    edges = np.append(ends[first], len(raw)).astype(np.int32)
    bodies = pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(edges), pa.py_buffer(raw)])
    for i in range(0, len(terms), ROWS):
        m = min(ROWS, len(terms) - i)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), terms.slice(i, m), pa.array(n[i:i + m]), bodies.slice(i, m)], names=names)


@dataclass
class Index:
    """A table of (segment, term, n, body): the packed places of each word of a segment, n of them; the row of the
    empty term has ids and lengths of the segment's n documents."""

    table: DataFrame


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> Index:
    """The positional index of all words of all documents, as a table in the shared folder.

    Null and empty texts are documents without words; ids may be null or repeated, each row is a document. Texts are
    taken whole; only the two named columns are read. An empty table gives an empty index.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        words, lengths, ids, held = [], [], [], 0
        for batch in batches:
            for begin, stop in parts(batch.column(1)):
                own, counts = words_of(batch.column(1).slice(begin, stop - begin))
                words.append(own)
                lengths.append(counts)
                ids += batch.column(0).slice(begin, stop - begin).to_pylist()
                held += len(own)
                if held >= segment:
                    yield from _segment_rows(number, words, np.concatenate(lengths), ids)
                    words, lengths, ids, held, number = [], [], [], 0, number + 1
        if ids:
            yield from _segment_rows(number, words, np.concatenate(lengths), ids)

    given = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    return Index(written(given.mapInArrow(run, _INDEX), "postings"))


# ---- test items

def inverted(items: DataFrame, id_col: str, text_col: str, block: int) -> tuple[DataFrame, int]:
    """((block, term, places), number of blocks): for each word of a block's items the packed (item, place) numbers;
    under the empty term the items' ids and lengths. Blocks have about `block` words; items without words are left out."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = words_of(batch.column(1))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "words"]).filter(pa.array(counts > 0))

    given = items.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    cut = written(given.mapInArrow(split, "id bigint, words array<string>"), "items")
    total = cut.agg(F.sum(F.size("words"))).head()[0] or 0
    blocks = max(1, -(-total // block))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("id", "words"), F.lit(blocks))).unionByName(
        items.sparkSession.range(blocks).select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<string>").alias("words"),
                                                F.col("id").alias("block")))  # so that no block is without rows

    def invert(rows: pa.Table) -> pa.Table:
        rows = rows.filter(pc.is_valid(rows["words"])).combine_chunks()
        ids = rows["id"].to_pylist()
        lists = rows["words"].combine_chunks() if len(ids) else pa.array([], pa.list_(pa.string()))
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        own = coded.indices.to_numpy().astype(np.int64)
        order = np.argsort(own, kind="stable")
        item = np.repeat(np.arange(len(ids)), lengths)
        place = np.arange(len(own)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        raw, ends = packed(np.stack([item[order], place[order]], 1).ravel())
        edges = ends[2 * np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(coded.dictionary)))])].astype(int).tolist()
        about = b"".join([np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], "u1").tobytes(), lengths.astype("<i8").tobytes()])
        bodies = [about] + [raw[a:b].tobytes() for a, b in zip(edges, edges[1:])]
        return pa.table({"term": pa.array([ABOUT] + coded.dictionary.to_pylist(), pa.string()), "places": pa.array(bodies, pa.binary())})

    def of_block(key: tuple, rows: pa.Table) -> pa.Table:
        out = invert(rows)
        return out.add_column(0, "block", pa.array(np.full(len(out), key[0].as_py()), pa.int64()))

    return written(dealt.groupBy("block").applyInArrow(of_block, "block bigint, term string, places binary"), "inverted"), blocks


def _about(raw: bytes) -> tuple[list[int | None], np.ndarray]:
    """(ids, lengths) of a row of the empty term."""
    n = len(raw) // 17
    ids, null = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n)
    return [None if z else i for i, z in zip(ids.tolist(), null.tolist())], np.frombuffer(raw, "<i8", n, 9 * n)


class Lists:
    """The posting lists of one segment for the words of one block of items."""

    def __init__(self, rows: pa.Table):
        terms = rows["term"].to_pylist()
        at = terms.index(ABOUT)
        bodies, places = rows["body"].to_pylist(), rows["places"].to_pylist()
        self.doc_ids, self.doc_words = _about(bodies[at])
        self.item_ids, self.item_words = _about(places[at])
        self.doc_begins = np.cumsum(self.doc_words + 1) - self.doc_words - 1
        self.item_begins = np.cumsum(self.item_words) - self.item_words
        others = [i for i in range(len(terms)) if i != at]
        #: Occurrences of each term, and all of them as term << 32 | place, ascending.
        self.n = np.array([rows["n"][i].as_py() for i in others], np.int64)
        gaps = unpacked(np.frombuffer(b"".join([bodies[i] for i in others]), np.uint8))
        sums = np.cumsum(gaps)
        first = np.cumsum(self.n) - self.n
        base = sums[first] - gaps[first] if len(others) else sums
        self.first = first
        self.keys = np.repeat(np.arange(len(others), dtype=np.int64), self.n) << 32 | sums - np.repeat(base, self.n)
        #: The term at each place of the items laid end to end; -1 for words that the segment has not.
        self.item_terms = np.full(int(self.item_words.sum()), -1, np.int64)
        for t, i in enumerate(others):
            pairs = unpacked(np.frombuffer(places[i], np.uint8)).reshape(-1, 2)
            self.item_terms[self.item_begins[pairs[:, 0]] + pairs[:, 1]] = t
        self.item_of = np.repeat(np.arange(len(self.item_ids)), self.item_words)

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each term stands at each place: intersection of shifted lists by search."""
        wanted = term << 32 | place
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (term >= 0) & (place >= 0) & (self.keys[at] == wanted)

    def next_place(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place of a term at or after a place; a huge number if there is none."""
        at = np.searchsorted(self.keys, term << 32 | place)
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (found >> 32 == term), found & 0xFFFFFFFF, 1 << 40)

    def last_place(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The last place of a term at or before a place; a very negative number if there is none."""
        at = np.searchsorted(self.keys, term << 32 | np.maximum(place, 0), "right") - 1
        found = self.keys[np.maximum(at, 0)]
        return np.where((place >= 0) & (at >= 0) & (found >> 32 == term), found & 0xFFFFFFFF, -(1 << 40))

    def anchors(self, window: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(places in the items, window lengths): the rarest word of each window that the segment has all words of;
        without `window`, of each item."""
        n_of = np.where(self.item_terms >= 0, self.n[self.item_terms], 0) if len(self.n) else np.zeros(len(self.item_terms), np.int64)
        if window is None:
            begin, width = self.item_begins, self.item_words
        else:
            width_of = np.minimum(self.item_words, window)
            many = self.item_words - width_of + 1
            begin = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.item_begins, many)
            width = np.repeat(width_of, many)
        out, widths = [], []
        for w in np.unique(width).tolist():
            own = begin[width == w]
            for i in range(0, len(own), max(1, CANDIDATES // w)):
                stretch = own[i:i + max(1, CANDIDATES // w), None] + np.arange(w)
                least = n_of[stretch].argmin(1)
                at = stretch[np.arange(len(stretch)), least]
                out.append(np.unique(at[n_of[at] > 0]))
                widths.append(np.full(len(out[-1]), w))
        return (np.concatenate(out), np.concatenate(widths)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def occurrences(self, window: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in the items, window length, place in the segment) of anchors, a bounded number at a time."""
        at, width = self.anchors(window)
        n = self.n[self.item_terms[at]] if len(at) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        for begin in range(0, int(n.sum()), CANDIDATES):
            k = np.arange(begin, min(begin + CANDIDATES, int(ends[-1])))
            a = np.searchsorted(ends, k, "right")
            place = self.keys[self.first[self.item_terms[at[a]]] + k - (ends[a] - n[a])] & 0xFFFFFFFF
            yield at[a], width[a], place

    def phrases(self, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, begin, end): stretches of the segment in which windows of an item stand, each around one anchor."""
        for at, width, place in self.occurrences(window):
            item = self.item_of[at]
            low, high = self.item_begins[item], self.item_begins[item] + self.item_words[item]
            reach = []
            for step in (1, -1):
                run = np.zeros(len(at), np.int64)
                alive = np.arange(len(at)) if step > 0 else np.flatnonzero(reach[0] < width)
                for k in range(1, int(width.max(initial=1))):
                    to = at[alive] + step * k
                    alive = alive[(to >= low[alive]) & (to < high[alive]) & (k < width[alive])]
                    alive = alive[self.holds(self.item_terms[at[alive] + step * k], place[alive] + step * k)]
                    if not len(alive):
                        break
                    run[alive] = k
                reach.append(run)
            hit = np.flatnonzero(reach[0] + reach[1] + 1 >= width)
            yield item[hit], place[hit] - reach[1][hit], place[hit] + reach[0][hit] + 1

    def near(self, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, begin, end): the tightest stretches around each anchor that hold an item's words in order, with at most
        `slop` other words between them."""
        for at, _, place in self.occurrences(None):
            item = self.item_of[at]
            low, high = self.item_begins[item], self.item_begins[item] + self.item_words[item]
            begin, end = place.copy(), place.copy()
            alive = np.arange(len(at))
            for step, edge, find in ((1, end, self.next_place), (-1, begin, self.last_place)):
                k = 0
                moving = alive
                while len(moving):
                    k += 1
                    to = at[moving] + step * k
                    moving = moving[(to >= low[moving]) & (to < high[moving])]
                    edge[moving] = find(self.item_terms[at[moving] + step * k], edge[moving] + step)
                    moving = moving[end[moving] - begin[moving] < self.item_words[item[moving]] + slop]
            good = (end - begin + 1 <= self.item_words[item] + slop) & (begin >= 0)
            good &= self.doc_of(np.maximum(begin, 0)) == self.doc_of(np.minimum(end, 1 << 39))
            yield item[good], begin[good], end[good] + 1

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_begins, place, "right") - 1


def _asked(index: Index, items: DataFrame, id_col: str, text_col: str, block: int, work: Callable[[Lists], pa.Table], schema: str) -> tuple[DataFrame, int]:
    """work() on the lists of each segment and block; rows have segment and block before the columns of `schema`."""
    terms, blocks = inverted(items, id_col, text_col, block)
    size = terms.agg(F.sum(F.octet_length("term") + F.octet_length("places") + 32)).head()[0]
    terms = F.broadcast(terms) if size <= BROADCAST_BYTES else terms
    met = index.table.join(terms, "term").select("segment", "block", "term", "n", "body", "places")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        out = work(Lists(rows))
        for i, (name, value) in enumerate(zip(("segment", "block"), key)):
            out = out.add_column(i, name, pa.array(np.full(len(out), value.as_py()), pa.int64()))
        return out

    return met.groupBy("segment", "block").applyInArrow(run, f"segment bigint, block bigint, {schema}"), blocks


_FOUND = "doc bigint, doc_id bigint, n_words bigint, hits array<struct<begin: bigint, end: bigint>>, items array<bigint>"


def matches(index: Index, items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document of the index: segment, doc (its number there), doc_id, n_words, hits and items.

    hits: stretches of word numbers (begin, end after the last), apart and ascending, in which windows of the items
    stand; items: the ids of those items, each once. A window is `window` consecutive words of an item; an item of
    fewer words, but not none, is one window. Items with a null id count as items of that id, items of equal ids as
    one; null and empty items have no window; without items no document has hits.
    """
    def work(lists: Lists) -> pa.Table:
        item, begin, end = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 3, *lists.phrases(window)))
        doc = lists.doc_of(begin)
        n = len(lists.doc_ids)
        order = np.lexsort((begin, doc))
        d, b, e = doc[order], begin[order], end[order]
        # Stretches of a document that touch are one; places of documents lie apart, so one running maximum serves all.
        reach = np.maximum.accumulate(e) if len(e) else e
        new = np.flatnonzero(np.concatenate([[True], b[1:] > reach[:-1]])) if len(b) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(b)) - 1 if len(new) else new
        hits = pa.StructArray.from_arrays([pa.array(b[new] - lists.doc_begins[d[new]]), pa.array(reach[last] - lists.doc_begins[d[new]])], ["begin", "end"])
        hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(d[new], np.arange(n + 1)).astype(np.int32)), hits)
        pairs = np.unique(doc * max(1, len(lists.item_ids)) + item)
        of, which = np.divmod(pairs, max(1, len(lists.item_ids)))
        named = pa.array(lists.item_ids, pa.int64()).take(pa.array(which))
        named = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), named)
        return pa.table({"doc": pa.array(np.arange(n)), "doc_id": pa.array(lists.doc_ids, pa.int64()), "n_words": pa.array(lists.doc_words.astype(np.int64)),
                         "hits": hits, "items": named})

    found, blocks = _asked(index, items, id_col, text_col, block, work, _FOUND)
    if blocks == 1:
        return found.select("segment", "doc", "doc_id", "n_words", "hits", F.array_distinct("items").alias("items"))
    merged = found.groupBy("segment", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return merged.withColumn("hits", F.expr(
        "aggregate(array_sort(hits), cast(array() as array<struct<begin: bigint, end: bigint>>), (all, x) -> "
        "if(size(all) > 0 and element_at(all, -1).end >= x.begin, concat(slice(all, 1, size(all) - 1), "
        "array(struct(element_at(all, -1).begin as begin, greatest(element_at(all, -1).end, x.end) as end))), concat(all, array(x))))")) \
        .select("segment", "doc", "doc_id", "n_words", "hits", "items")


def near(index: Index, items: DataFrame, slop: int, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Proximity matches (doc_id, item_id, begin, end): stretches of words of a document that hold all words of an item in
    order with at most `slop` others between them, the tightest around each occurrence of the item's rarest word.

    With slop 0 these are the exact matches of whole items. Items of no words match nowhere; ids may be null.
    """
    def work(lists: Lists) -> pa.Table:
        item, begin, end = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 3, *lists.near(slop)))
        doc = lists.doc_of(begin)
        take = lambda values, at: pa.array(values, pa.int64()).take(pa.array(at))
        return pa.table({"doc": pa.array(doc), "doc_id": take(lists.doc_ids, doc), "item_id": take(lists.item_ids, item),
                         "begin": pa.array(begin - lists.doc_begins[doc]), "end": pa.array(end - lists.doc_begins[doc])})

    found, _ = _asked(index, items, id_col, text_col, block, work, "doc bigint, doc_id bigint, item_id bigint, begin bigint, end bigint")
    return found.select("doc_id", "item_id", "begin", "end")


def summary(found: DataFrame) -> DataFrame:
    """Rows of matches() as doc_id, n_words, n_hit (words in hits), n_items, items_sha256 (of the ids as text, sorted and
    joined by commas; a null id is empty text) and contaminated."""
    names = F.array_sort(F.transform("items", lambda x: F.coalesce(x.cast("string"), F.lit(""))))
    n_hit = F.expr("aggregate(hits, 0L, (n, x) -> n + x.end - x.begin)")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", share: float = 0.0) -> DataFrame:
    """`docs` without documents more than `share` of whose words lie in hits; rows of a null id stay, equal ids share a fate."""
    hit = F.expr("aggregate(hits, 0L, (n, x) -> n + x.end - x.begin)")
    bad = found.where((hit > share * F.col("n_words")) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("bad id")).distinct()
    return docs.join(bad, quoted(id_col).cast("long") == bad["bad id"], "left_anti")
