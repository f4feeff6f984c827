"""Packing by power-of-two decomposition: a document's ids are cut into pieces of 4096 and of the binary digits of the rest.

Every piece is a sequence of its own, so none crosses documents and none needs padding; pieces of equal length make up
a bucket from which batches are drawn. The work is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wirelake.llm.common import quoted
from wirelake.llm.encoding import encoder, parts

LONGEST = 4096
END_ID = 2
_PIECES = {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint",
           "sequence_id": "bigint", "offset": "bigint", "bucket": "int"}


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths that add up to n: `longest` as often as it fits, then the powers of two of the rest, descending."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
         longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length)
    and, with `with_ids`, ids (little-endian unsigned 32-bit integers).

    `tokenizer` is the path of a vocabulary; strings of its special tokens in a text become those tokens, as in the
    library. A null or empty text is the end id alone, a very long one many pieces; a null id stays null. Repeated rows
    and ties of ids are packed each for itself, an empty table gives an empty one, and only the two named columns are
    read, so no name of another can clash. sequence_id is unique: partition of the input times 2^40 plus a running
    number, so a task that runs again numbers its pieces alike.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    end = end_id.to_bytes(4, "little")
    names = list(_PIECES) + ["ids"] * with_ids
    schema = ", ".join(f"{k} {v}" for k, v in _PIECES.items()) + ", ids binary" * with_ids
    arrow = {"bigint": pa.int64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sequence = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for begin, stop in parts(batch.column(1)):
                out: list[tuple] = []
                for key, ids in zip(keys[begin:stop], model.encode(batch.column(1).slice(begin, stop - begin))):
                    ids += end
                    n, start = len(ids) // 4, 0
                    for length in piece_lengths(n, longest):
                        piece = ids[4 * start:4 * (start + length)]
                        out.append((key, start, length, zlib.crc32(piece), n, sequence, 0, length.bit_length() - 1, piece))
                        start, sequence = start + length, sequence + 1
                kinds = [arrow[v] for v in _PIECES.values()] + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t, _ in zip(zip(*out), kinds, names)], names=names)

    return docs.select(quoted(id_col).cast("long"), quoted(text_col).cast("string")).mapInArrow(run, schema)
