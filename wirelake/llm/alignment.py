"""Alignment of the tokens of two vocabularies over the same text, with corpus-wide counts of linked ids.

Both vocabularies cut text where white space begins, so the alignment of a chunk (white space and what follows it) is
worked out once and a text's alignment is that of its chunks, one after the other.

Two tokens are linked if their bytes overlap. Where a token of A stands for exactly the bytes of one of B, the pair is
known beforehand: an array gives for each id of A the id of B of the same bytes, and such one-to-one groups are counted
in a vector as long as the vocabulary. Only the links of other groups are counted as pairs and shuffled.

A part is a bounded stretch of whole documents of one task. It is stored as one row: figures of its documents, their
chunks as numbers, and the links of each different chunk as places in the part's list of different pairs. That list is
joined with the counts of the whole corpus, and the part's documents are summed up from it; no text is read twice.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wirelake.llm.common import packed, quoted, unpacked, written
from wirelake.llm.encoding import Encoder, Memory, byte_signs, cut, parts

#: Bytes of text of a part; a longer text is a part of its own.
PART = 4_000_000
#: Chunks of a generation that a worker remembers (see encoding.Memory).
REMEMBERED = 100_000
#: Chunks aligned at once.
BATCH = 20_000
#: Marks, in the id of B of a link, a one-to-one group of the same bytes.
_EXACT = np.uint32(1 << 31)
_SPACE = "▁"

_PARTS = ("part bigint, doc_ids array<bigint>, figures binary, hashes array<string>, groups array<string>, n_chunks binary, chunks binary, "
          "n_links binary, links binary, pair_a array<int>, pair_b array<int>, pair_n array<bigint>, exact_a array<int>, exact_n array<bigint>")


def bytes_of_a(path: str) -> list[bytes]:
    """Bytes of each token of a byte-level vocabulary, by id."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    back = {sign: b for b, sign in byte_signs().items()}
    out: dict[int, bytes] = {i: bytes(back[c] for c in token) for token, i in model["model"]["vocab"].items() if all(c in back for c in token)}
    out |= {t["id"]: t["content"].encode() for t in model["added_tokens"]}
    return [out.get(i, b"") for i in range(max(out) + 1)]


def bytes_of_b(model) -> list[bytes]:
    """Bytes of each piece, by id: the low line as a space, byte pieces as their byte."""
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(_SPACE, " ").encode()
            for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]


def same_bytes(a: list[bytes], b: list[bytes], ordinary: list[bool]) -> np.ndarray:
    """For each id of A the id of B of the same bytes (a piece that is no byte or sign of control first), or -1."""
    known: dict[bytes, int] = {}
    for wanted in (True, False):
        for i, x in enumerate(b):
            if ordinary[i] == wanted and x:
                known.setdefault(x, i)
    return np.array([known.get(x, -1) if x else -1 for x in a], np.int64)


class Aligner:
    """Alignment of chunks; one for each worker."""

    def __init__(self, path_a: str, path_b: str, remembered: int = REMEMBERED):
        import sentencepiece

        self.a = Encoder(path_a, ordinary=True, signs=False, remembered=0)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        own_a, own_b = bytes_of_a(path_a), bytes_of_b(self.b)
        normal = [not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)) for i in range(len(own_b))]
        self.same = same_bytes(own_a, own_b, normal)
        self.len_a, self.len_b = (np.array([len(x) for x in own], np.int64) for own in (own_a, own_b))
        self.pieces = pa.array(own_b, pa.large_binary())
        self.space = self.b.piece_to_id(_SPACE)
        written_as = [self.b.id_to_piece(i) for i, x in enumerate(normal) if x]
        #: Whether no piece goes on over the beginning of a chunk.
        self.cuts = not any(_SPACE in p.lstrip(_SPACE) or "\n" in p and len(p) > 1 for p in written_as)
        #: An id with what follows it in the text of groups: for A a comma or a bar, for B a comma or a semicolon.
        self.signs = pa.array([f"{i}{s}" for own, signs in ((own_a, ",|"), (own_b, ",;")) for s in signs for i in range(len(own))], pa.large_string())
        self.memory = Memory(self.aligned, remembered)

    def ids_of_b(self, chunks: list[bytes]) -> list[list[int]]:
        """B puts a space before what it is given: the chunk's own, or one that is taken away again."""
        led = [c[:1] == b" " for c in chunks]
        made = self.b.encode([c[1:].decode() if own else c.decode() for c, own in zip(chunks, led)], num_threads=1)
        return [(ids if ids else [self.space]) if own else ids[1:] if ids and ids[0] == self.space else [] for ids, own in zip(made, led)]

    def aligned(self, chunks: list[bytes]) -> list[tuple[bytes, bytes, int, int, int]]:
        """(text of groups, links, tokens of A, of B, groups) of each chunk; -1 tokens where bytes differ."""
        out = []
        for i in range(0, len(chunks), BATCH):
            out += self._aligned(chunks[i:i + BATCH])
        return out

    def _aligned(self, chunks: list[bytes]) -> list[tuple[bytes, bytes, int, int, int]]:
        coded = self.a.made(chunks)
        n_a = np.fromiter(map(len, coded), np.int64, len(chunks)) // 4
        a = np.frombuffer(b"".join(coded), "<u4").astype(np.int64)
        lists = self.ids_of_b(chunks)
        n_b = np.fromiter(map(len, lists), np.int64, len(chunks))
        b = np.fromiter(chain.from_iterable(lists), np.int64, int(n_b.sum()))
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        sums = lambda lengths, ids, stops: np.diff(np.concatenate([[0], np.cumsum(lengths[ids])])[np.concatenate([[0], stops])])
        good = (sums(self.len_a, a, stop_a) == size) & (sums(self.len_b, b, stop_b) == size)
        if good.all():
            joined, whole = self.pieces.take(pa.array(b)), b"".join(chunks)
            read = joined.buffers()[2].to_pybytes()[:len(whole)] if len(whole) else b""
            if read != whole:
                edges = np.concatenate([[0], np.cumsum(size)]).tolist()
                good = np.array([read[x:y] == c for x, y, c in zip(edges, edges[1:], chunks)])
        if not good.all():
            if len(chunks) == 1:
                return [(b"", b"", -1, -1, -1)]
            half = len(chunks) // 2  # those whose bytes differ are found by halves, the others go on together
            if (~good).sum() > 50:
                return self._aligned(chunks[:half]) + self._aligned(chunks[half:])
            rest = iter(self._aligned([c for c, g in zip(chunks, good) if g]) if good.any() else [])
            return [next(rest) if g else (b"", b"", -1, -1, -1) for g in good]
        ends_a, ends_b, ends = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]), np.cumsum(size)
        # Between two neighbouring ends lies one token of each: every overlap of two tokens is one such stretch.
        stretches = np.unique(np.concatenate([ends_a, ends_b]))
        at_a, at_b = np.searchsorted(ends_a, stretches), np.searchsorted(ends_b, stretches)
        both = (ends_a[at_a] == stretches) & (ends_b[at_b] == stretches)
        common = stretches[both]
        one = both & np.concatenate([[True], both[:-1]])
        links = np.empty((len(stretches), 2), "<u4")
        links[:, 0], links[:, 1] = a[at_a], b[at_b]
        links[one & (self.same[a[at_a]] == b[at_b]), 1] |= _EXACT
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        sign = np.concatenate([a + len(self.len_a) * (common[group_a] == ends_a),
                               2 * len(self.len_a) + b + len(self.len_b) * (common[group_b] == ends_b)])
        text = self.signs.take(pa.array(sign[order]))
        text_ends = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)[np.concatenate([[0], stop_a + stop_b])].tolist()
        link_ends = (8 * np.concatenate([[0], np.searchsorted(stretches, ends, "right")])).tolist()
        groups = np.diff(np.concatenate([[0], np.searchsorted(common, ends, "right")])).tolist()
        raw, raw_links = text.buffers()[2].to_pybytes(), links.tobytes()
        return [(raw[t:u], raw_links[x:y], p, q, g) for t, u, x, y, p, q, g in zip(
            text_ends, text_ends[1:], link_ends, link_ends[1:], n_a.tolist(), n_b.tolist(), groups)]

    def part(self, number: int, ids: list[int | None], texts: pa.Array, with_groups: bool) -> pa.RecordBatch:
        """The row of a part."""
        texts = pc.fill_null(texts, "")
        empty = pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
        spaced = pc.binary_join_element_wise(pa.scalar(""), texts, " ")
        if self.cuts:
            chunks, counts = cut(spaced, self.a.strings, signs=False)
        else:
            chunks, counts = spaced.cast(pa.binary()), np.ones(len(texts), np.int64)
        coded = chunks.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        values = self.memory.values(coded.dictionary.to_pylist())
        figures = np.array([v[2:] for v in values], np.int64).reshape(-1, 3)
        edges = np.concatenate([[0], np.cumsum(counts)])
        per_doc = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[codes])])[edges])
        good = (per_doc(figures[:, 0] < 0) == 0) & ~empty
        shown = pa.array([v[0] for v in values], pa.large_binary()).take(coded.indices)
        view = memoryview(shown.buffers()[2]) if shown.buffers()[2] is not None else memoryview(b"")
        text_ends = np.frombuffer(shown.buffers()[1], np.int64, len(shown) + 1)[edges].tolist()
        named = [view[x:y - 1] if g else None for x, y, g in zip(text_ends, text_ends[1:], good.tolist())]
        hashes = ["" if v is None else hashlib.sha256(v).hexdigest() for v in named]
        groups = ["" if v is None else str(v, "ascii") for v in named] if with_groups else []
        # Links of the different chunks, the pairs that they are of, and how often good documents hold them.
        links = np.frombuffer(b"".join([v[1] for v in values]), "<u4").reshape(-1, 2)
        n_links = np.fromiter((len(v[1]) // 8 for v in values), np.int64, len(values))
        weight = np.repeat(np.bincount(codes[np.repeat(good, counts)], minlength=len(values)), n_links)
        exact = links[:, 1] >= _EXACT
        vector = np.bincount(links[exact, 0], weight[exact], len(self.len_a)).astype(np.int64)
        pairs, place = np.unique(links[:, 0].astype(np.int64) << 32 | links[:, 1] & ~_EXACT, return_inverse=True)
        times = np.bincount(place[~exact], weight[~exact], len(pairs)).astype(np.int64)
        sums = [np.where(good, per_doc(x), 0) for x in (figures[:, 0], figures[:, 1], figures[:, 2], n_links)]
        seen = np.flatnonzero(vector)
        row = [number, ids, np.stack([*sums, good], 1).astype("<i8").tobytes(), hashes, groups, packed(counts)[0].tobytes(), packed(codes)[0].tobytes(),
               packed(n_links)[0].tobytes(), packed(place)[0].tobytes(), (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), times,
               seen.astype(np.int32), vector[seen]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.binary()] * 4,
                 pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in _PARTS.split(", ")])


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


@dataclass
class Alignment:
    """`parts` is the table of parts; `counts` is the table (a, b, n, best) of all linked pairs of ids: how many links
    of the corpus hold it, and whether that is the most for this id of B (ties included)."""

    parts: DataFrame
    counts: DataFrame

    def documents(self) -> DataFrame:
        """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is `best`), count_sum (of
        the counts of all its links), groups_sha256 and groups (null unless asked for)."""
        pairs = self.parts.select("part", F.posexplode(F.arrays_zip("pair_a", "pair_b")).alias("place", "pair")) \
            .select("part", "place", F.col("pair.pair_a").alias("a"), F.col("pair.pair_b").alias("b"))
        known = pairs.join(self.counts, ["a", "b"]).select("part", "place", "n", "best")
        rows = self.parts.select(F.col("part").alias("of_part"), "doc_ids", "figures", "hashes", "groups", "n_chunks", "chunks", "n_links", "links")
        schema = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, "
                  "groups string")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            _ALIGNERS.clear()  # what a worker remembers of chunks is not needed from here on
            row = {name: left[name][0] for name in left.column_names}
            read = lambda name: np.frombuffer(row[name].as_buffer(), np.uint8)
            figures = np.frombuffer(row["figures"].as_buffer(), "<i8").reshape(-1, 5)
            good = figures[:, 4] == 1
            links, n_links, codes = unpacked(read("links")), unpacked(read("n_links")), unpacked(read("chunks"))
            place = right["place"].to_numpy()
            most = int(max(place.max(initial=-1), links.max(initial=-1))) + 1
            n, best = np.zeros(most, np.int64), np.zeros(most, np.int64)
            n[place], best[place] = right["n"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
            stops = np.concatenate([[0], np.cumsum(n_links)])
            edges = np.concatenate([[0], np.cumsum(unpacked(read("n_chunks")))])
            sums = []
            for values in (best, n):
                of_chunk = np.diff(np.concatenate([[0], np.cumsum(values[links])])[stops])
                sums.append(np.where(good, np.diff(np.concatenate([[0], np.cumsum(of_chunk[codes])])[edges]), 0))
            groups = row["groups"].values if len(row["groups"].values) else pa.nulls(len(good), pa.string())
            return pa.table([row["doc_ids"].values, *[pa.array(figures[:, i]) for i in range(4)], *map(pa.array, sums), row["hashes"].values, groups],
                            names=[x.split()[0] for x in schema.split(", ")])

        return rows.groupBy("of_part").cogroup(known.groupBy("part")).applyInArrow(run, schema)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", part: int = PART,
          with_groups: bool = False) -> Alignment:
    """Aligns the tokens of a byte-level vocabulary A (a file of the tokenizers library) over a space and the text with those of
    a sentencepiece model B over the text, which puts the space before it itself. Strings of special tokens are plain text.

    Groups are the least stretches at whose ends tokens of both end; `a1,a2|b1;a3|b2` is their text. Null and empty texts,
    and those whose tokens do not give back the bytes (as B knows no low line U+2581), have no tokens: zeros and an empty
    text. Ids may be null or repeated, each row is a document; texts are taken whole, only the two named columns are
    read; an empty table gives empty results.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 24
        ids, texts, held = [], [], 0
        for batch in batches:
            for begin, stop in parts(batch.column(1), part):
                own = batch.column(1).slice(begin, stop - begin)
                ids += batch.column(0).slice(begin, stop - begin).to_pylist()
                texts.append(own)
                held += pc.sum(pc.binary_length(own)).as_py() or 0
                if held >= part:
                    yield model.part(number, ids, pa.concat_arrays(texts), with_groups)
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield model.part(number, ids, pa.concat_arrays(texts), with_groups)

    given = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    made = written(given.mapInArrow(run, _PARTS), "parts")
    irregular = made.select(F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("x")) \
        .select(F.col("x.pair_a").alias("a"), F.col("x.pair_b").alias("b"), F.col("x.pair_n").alias("n")) \
        .where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("n"))
    exact = made.select(F.explode(F.arrays_zip("exact_a", "exact_n")).alias("x")) \
        .select(F.col("x.exact_a").alias("a"), F.col("x.exact_n").alias("n")).groupBy("a").agg(F.sum("n").alias("n"))
    counts = written(irregular.unionByName(_with_same(exact, path_a, path_b)).groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return Alignment(made, written(counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "counts"))


def _with_same(exact: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, n) as (a, b, n), b being the id of the same bytes: at most as many rows as the vocabulary has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = aligner(path_a, path_b).same.astype(np.int32)
        for batch in batches:
            a = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same[a]), batch.column(1)], names=["a", "b", "n"])

    return exact.mapInArrow(run, "a int, b int, n bigint")
