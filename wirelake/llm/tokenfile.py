"""Token files: independent zstandard frames, a directory of documents and a trailing seek table with checksums.

A file is zstandard frames of whole documents, then a skippable frame with the directory of documents, then the seek
table of the public seekable format: for each frame its compressed size, its decompressed size and a checksum (the low
32 bits of XXH64 of the decompressed bytes), the number of frames, a descriptor byte and the closing magic number. A reader takes
the tail of the file, looks a document up and decompresses only its frame. Plain zstandard tools read the frames too.

Tasks write files of their own under names of partition and number: first under a name of the attempt, then moved, so a
task that runs twice leaves one file of equal content.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wirelake.llm.common import quoted, written
from wirelake.llm.encoding import encoder, parts
from wirelake.session import scratch_path

END_ID = 2
FRAME_IDS = 1 << 16
FILE_IDS = 1 << 25
#: Fixed values of the seekable zstandard format.
SKIPPABLE_SEEK, SKIPPABLE_DIRECTORY, SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
_CHECKSUMS = 0x80
_FOOTER = struct.Struct("<IBI")
_SHAPE = struct.Struct("<IIB")  # documents, bytes of the packed directory, bytes of an id
_MANIFEST = "part int, number int, path string, n_docs bigint, n_tokens bigint"


def checksum(raw: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(raw) & 0xFFFFFFFF


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class Writer:
    """One token file; documents go in by add(), close() writes directory and seek table."""

    def __init__(self, out, width: int = 2, level: int = 1):
        import zstandard

        self.out, self.width, self.packer = out, width, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, bool, int, int]] = []  # id, whether it is null, frame, ids
        self.held: list[bytes] = []
        self.n_held = self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """`ids`: little-endian unsigned 32-bit integers."""
        n = len(ids) // 4
        if self.n_held and self.n_held + n > FRAME_IDS:
            self.flush()
        self.docs.append((doc_id or 0, doc_id is None, len(self.frames), n))
        if self.width == 2:
            wide = np.frombuffer(ids, "<u4")
            ids = wide.astype("<u2").tobytes()
        self.held.append(ids)
        self.n_held += n
        self.n_ids += n

    def flush(self) -> None:
        if not self.n_held:
            return
        raw = b"".join(self.held)
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), checksum(raw)))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        self.flush()
        columns = [np.array([d[i] for d in self.docs], t).tobytes() for i, t in enumerate(("<i8", "u1", "<u4", "<u8"))]
        packed = self.packer.compress(b"".join(columns))
        body = packed + _SHAPE.pack(len(self.docs), len(packed), self.width)
        self.out.write(struct.pack("<II", SKIPPABLE_DIRECTORY, len(body)) + body)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + _FOOTER.pack(len(self.frames), _CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


@dataclass
class Document:
    doc_id: int | None
    ids: np.ndarray


class Reader:
    """A token file opened by its tail; frames are decompressed and checked as they are asked for."""

    def __init__(self, file):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor()
        size = file.size()
        n, flags, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != SEEK_MAGIC or not flags & _CHECKSUMS:
            raise ValueError("not a token file")
        begin = size - _FOOTER.size - 12 * n
        self.frames = np.frombuffer(self._at(begin, 12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        docs, packed, self.width = _SHAPE.unpack(self._at(begin - 8 - _SHAPE.size, _SHAPE.size))
        raw = self.unpack.decompress(self._at(begin - 8 - _SHAPE.size - packed, packed), max_output_size=21 * docs + 1)
        cut = np.cumsum([0, 8 * docs, docs, 4 * docs, 8 * docs])
        self.doc_ids, null, self.frame, self.length = (
            np.frombuffer(raw[a:b], t) for a, b, t in zip(cut, cut[1:], ("<i8", "u1", "<u4", "<u8")))
        self.null = null.astype(bool)
        self.length = self.length.astype(np.int64)
        before = np.cumsum(self.length) - self.length
        first = np.searchsorted(self.frame, self.frame)  # documents of a frame follow each other
        self.offset = before - before[first] if docs else before

    def _at(self, begin: int, n: int) -> bytes:
        self.file.seek(begin)
        return self.file.read(n)

    def frame_bytes(self, k: int) -> bytes:
        packed, size, check = map(int, self.frames[k])
        raw = self.unpack.decompress(self._at(int(self.starts[k]), packed), max_output_size=size)
        if checksum(raw) != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def read(self, rows: Iterable[int] | None = None) -> Iterator[Document]:
        """The documents in the given rows of the directory (ascending), or all; each frame needed is read once."""
        at, raw = -1, b""
        for i in range(len(self.doc_ids)) if rows is None else rows:
            if self.frame[i] != at:
                at, raw = int(self.frame[i]), self.frame_bytes(int(self.frame[i]))
            ids = np.frombuffer(raw, f"<u{self.width}", int(self.length[i]), int(self.offset[i]) * self.width)
            yield Document(None if self.null[i] else int(self.doc_ids[i]), ids)

    def find(self, doc_id: int) -> np.ndarray:
        """Rows of the directory with that id."""
        return np.flatnonzero((self.doc_ids == doc_id) & ~self.null)


def write_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                end_id: int = END_ID) -> DataFrame:
    """Token files of all documents, ascending by id (null first) over files in the order (part, number).

    Returns the manifest: part, number, path, n_docs, n_tokens. `tokenizer` is the path of a byte-level vocabulary.
    `folder` must be one that all executors share. Each text is encoded whole and ends with `end_id`; a null text
    counts as empty; rows with equal ids follow each other in an order of their own. No document, however long, is
    split over files; an empty table gives no file.
    """
    given = docs.select(quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = given.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, store = encoder(tokenizer), TaskContext.get().partitionId(), None
        width = 2 if model.joined.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        number, writer = 0, None

        def finish() -> pa.RecordBatch:
            nonlocal writer, number
            writer.close()
            writer.out.close()
            path = f"part-{part:06d}-{number:04d}.tok"
            store.move(temporary, f"{base}/{path}")
            row = [[part], [number], [f"{folder}/{path}"], [len(writer.docs)], [writer.n_ids]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            writer, number = None, number + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)],
                                              names=["part", "number", "path", "n_docs", "n_tokens"])

        for batch in batches:
            if store is None and batch.num_rows:
                store, base = file_system(folder)
                store.create_dir(base, recursive=True)
            keys = batch.column(0).to_pylist()
            for begin, stop in parts(batch.column(1)):
                for key, ids in zip(keys[begin:stop], model.encode(batch.column(1).slice(begin, stop - begin))):
                    if writer is None:
                        temporary = f"{base}/.{uuid.uuid4().hex}"
                        writer = Writer(store.open_output_stream(temporary), width)
                    writer.add(key, ids + end)
                    if writer.n_ids >= FILE_IDS:
                        yield finish()
        if writer is not None:
            yield finish()

    return written(ordered.select("id", "text").mapInArrow(run, _MANIFEST), "manifest")


def read_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every document of the files, read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    and, with `with_ids`, ids (little-endian unsigned 32-bit integers).

    Frames are checked as they are read; a damaged one raises. Ids may be null or repeated, every document is a row;
    a document without ids of its own has the end id alone; a long one is decompressed frame by frame, its ids are one
    value. A manifest without files gives no row. Only the columns of write_files are read."""
    files = manifest.withColumn("before", F.expr(
        "coalesce(sum(n_tokens) over (order by part, number rows between unbounded preceding and 1 preceding), 0)"))
    n = max(1, manifest.count())
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, base = file_system(path)
                with store.open_input_file(base) as file:
                    out: list[tuple] = []
                    held = 0
                    for doc in Reader(file).read():
                        raw = doc.ids.astype("<u4").tobytes()
                        out.append((doc.doc_id, start, len(doc.ids), zlib.crc32(raw), raw))
                        start += len(doc.ids)
                        held += len(raw) * with_ids
                        if len(out) >= 10_000 or held > 1 << 26:
                            yield rows(out)
                            out, held = [], 0
                    if out:
                        yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=names[:len(kinds)])

    return files.select("path", "before").repartition(min(n, 10_000)).mapInArrow(run, schema)


def read_documents(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the wanted documents only: files are asked for their directories, and only frames that hold
    a wanted document are decompressed. Unknown ids give no row."""
    wanted = sorted(set(doc_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, base = file_system(path)
                with store.open_input_file(base) as file:
                    reader = Reader(file)
                    at = np.flatnonzero(np.isin(reader.doc_ids, wanted) & ~reader.null)
                    found = [(d.doc_id, d.ids.tolist()) for d in reader.read(at)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), (pa.int64(), pa.list_(pa.int64())))],
                                                     names=["doc_id", "ids"])

    n = max(1, manifest.count())
    return manifest.select("path").repartition(min(n, 10_000)).mapInArrow(run, "doc_id bigint, ids array<bigint>")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents written to token files in the shared scratch folder and read back, without their ids."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_files(write_files(docs, folder, tokenizer, id_col, text_col), with_ids=False)
