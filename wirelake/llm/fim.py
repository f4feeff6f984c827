"""Fill-in-middle transformation on piece tables.

A document is a list of descriptors (buffer, begin, end) over two immutable buffers: its text and the sentinels. Cutting
splits a descriptor in two, arranging permutes descriptors and puts in those of sentinels, and restoring finds the
sentinels in an output, makes descriptors over it and applies the inverse permutation. No text is copied until an output
is written; hashes are fed descriptor by descriptor.

One pass over the documents, without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from wirelake.llm.common import quoted, without
from wirelake.llm.encoding import parts

TEXT, SENTINELS = 0, 1
PREFIX, MIDDLE, SUFFIX = 0, 1, 2
#: Units that a text may be cut into: matched from left to right, over code points.
UNITS = {"lines": "[^\n]*\n|[^\n]+", "words": r"\s*\S+|\s+", "characters": "(?s:.)"}
#: Parts in the order of the output, by form.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}


@dataclass(frozen=True)
class Piece:
    """A stretch of bytes of one of the two buffers."""

    buffer: int
    begin: int
    end: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        """Two pieces, the first of `at` bytes."""
        return Piece(self.buffer, self.begin, self.begin + at), Piece(self.buffer, self.begin + at, self.end)


@dataclass(frozen=True)
class Rules:
    """How texts are cut and arranged. `rate` and `spm_rate` are percentages; the seed names the random choices."""

    seed: int = 7
    rate: int = 100
    spm_rate: int = 50
    unit: str = "lines"
    prefix: str = "<P>"
    middle: str = "<M>"
    suffix: str = "<S>"

    def __post_init__(self):
        if self.unit not in UNITS:
            raise ValueError(f"unit must be one of {', '.join(UNITS)}")
        if not all(self.strings) or len(set(self.strings)) < 3:
            raise ValueError("sentinels must be three different strings")
        for a in self.strings:
            for b in self.strings:
                if any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))) or a != b and a in b:
                    raise ValueError("no sentinel may begin with what one ends with, nor hold another")

    @property
    def strings(self) -> tuple[str, str, str]:
        """Sentinels by part."""
        return self.prefix, self.middle, self.suffix

    def numbers(self, doc_id: int | None) -> list[int]:
        """Four numbers of 32 bits; a null id counts as an empty one."""
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


class PieceTable:
    """Descriptors over a text and the sentinels."""

    def __init__(self, text: bytes, sentinels: bytes, pieces: list[Piece] | None = None):
        self.buffers = (text, sentinels)
        self.pieces = [Piece(TEXT, 0, len(text))] if pieces is None else pieces

    def cut(self, at: int) -> None:
        """Splits the first descriptor that byte `at` of the present content lies in or follows; a part may be empty."""
        for i, piece in enumerate(self.pieces):
            if at <= piece.end - piece.begin:
                self.pieces[i:i + 1] = piece.cut(at)
                return
            at -= piece.end - piece.begin
        raise IndexError("beyond the end")

    def chunks(self) -> Iterator[memoryview]:
        views = [memoryview(b) for b in self.buffers]
        for piece in self.pieces:
            yield views[piece.buffer][piece.begin:piece.end]

    def content(self) -> bytes:
        return b"".join(self.chunks())

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for chunk in self.chunks():
            digest.update(chunk)
        return digest.hexdigest()


class Transformer:
    """Texts to outputs and back under some rules."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.marks = [s.encode() for s in rules.strings]
        self.sentinels = b"".join(self.marks)
        begins = np.cumsum([0, *map(len, self.marks)]).tolist()
        self.mark_pieces = [Piece(SENTINELS, a, b) for a, b in zip(begins, begins[1:])]
        self.unit = re.compile(UNITS[rules.unit])

    def cuts(self, text: bytes, one: int, two: int) -> tuple[int, int, int]:
        """(number of units, byte at which the prefix ends, byte at which the middle ends)."""
        if self.rules.unit == "lines":
            newlines = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x0A) + 1
            ends = newlines if text[-1:] in (b"\n", b"") else np.append(newlines, len(text))
        else:
            ends = np.cumsum([len(u.encode()) for u in self.unit.findall(text.decode())], dtype=np.int64)
        n = len(ends)
        low, high = sorted((one % (n + 1), two % (n + 1)))
        return n, int(ends[low - 1]) if low else 0, int(ends[high - 1]) if high else 0

    def arrange(self, doc_id: int | None, text: bytes) -> tuple[int, str, PieceTable, tuple[int, int] | None]:
        """(number of units, form, piece table of the output, characters of prefix and middle or None if plain)."""
        one, two, three, four = self.rules.numbers(doc_id)
        n, first, second = self.cuts(text, one, two)
        table = PieceTable(text, self.sentinels)
        if not text or any(m in text for m in self.marks) or three % 100 >= self.rules.rate:
            return n, "plain", table, None
        form = "spm" if four % 100 < self.rules.spm_rate else "psm"
        table.cut(first)
        table.cut(second)
        split = table.pieces
        lengths = tuple(len(str(memoryview(text)[p.begin:p.end], "utf-8")) for p in split[:2])
        table.pieces = [x for part in ORDERS[form] for x in (self.mark_pieces[part], split[part])]
        return n, form, table, lengths

    def restore(self, output: bytes, form: str) -> PieceTable:
        """The piece table, over an output, of the text that it was made of."""
        if form == "plain":
            return PieceTable(output, self.sentinels)
        order = ORDERS[form]
        at = [output.index(self.marks[part]) for part in order]
        begins = [a + len(self.marks[part]) for a, part in zip(at, order)]
        found = dict(zip(order, (Piece(TEXT, b, e) for b, e in zip(begins, [*at[1:], len(output)]))))
        return PieceTable(output, self.sentinels, [found[part] for part in (PREFIX, MIDDLE, SUFFIX)])


def _run(df: DataFrame, keep: list[str], inputs: list[tuple[str, str]], fields: dict[str, T.DataType], make) -> DataFrame:
    """`keep` columns of `df` and those of `fields`, which make() works out from the input columns (name, type)."""
    given = df.select(*[quoted(x).alias(f"c{i}") for i, x in enumerate(keep)],
                      *[quoted(x).cast(kind).alias(f"i{i}") for i, (x, kind) in enumerate(inputs)])
    schema = T.StructType([T.StructField(f"c{i}", df.schema[x].dataType) for i, x in enumerate(keep)]
                          + [T.StructField(f"o{i}", kind) for i, kind in enumerate(fields.values())])
    arrow = {"bigint": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for begin, stop in parts(batch.column(batch.num_columns - 1)):  # the last input is the long one
                part = batch.slice(begin, stop - begin)
                rows = [work(*x) for x in zip(*[part.column(len(keep) + i).to_pylist() for i in range(len(inputs))])]
                made = [pa.array(v, arrow[k.simpleString()]) for v, k in zip(zip(*rows), fields.values())]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + made, names=schema.names)

    out = given.mapInArrow(run, schema)
    return out.select(*[quoted(f"c{i}").alias(x) for i, x in enumerate(keep)],
                      *[quoted(f"o{i}").alias(x) for i, x in enumerate(fields)])


def transform(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = True,
              digests: bool = False) -> DataFrame:
    """`docs` without its text, with n (units of the text), form (plain, psm or spm), prefix_chars and middle_chars (code
    points; null if plain), with `with_text` output, and with `digests` output_sha256 and restored_sha256 (of the text
    rebuilt from output and form).

    A null text counts as empty and is plain, as is a text that holds a sentinel; a null id has the random choices of an
    empty one. Equal ids make equal choices, repeated rows stay as many as they are. Texts are taken whole, however
    long. Columns of `docs` with a name of the result are replaced; an empty table gives an empty one.
    """
    fields: dict[str, T.DataType] = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType()}
    fields |= {"output": T.StringType()} if with_text else {}
    fields |= {"output_sha256": T.StringType(), "restored_sha256": T.StringType()} if digests else {}

    def make():
        transformer = Transformer(rules)

        def work(doc_id, text):
            n, form, table, lengths = transformer.arrange(doc_id, (text or "").encode())
            row = [n, form, *(lengths or (None, None))]
            output = table.content()
            row += [output.decode()] if with_text else []
            row += [table.sha256(), transformer.restore(output, form).sha256()] if digests else []
            return row

        return work

    return _run(docs, without(docs, [*fields, text_col]), [(id_col, "long"), (text_col, "string")], fields, make)


def restore(made: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """Rows of transform() with the text they were made of in place of output, form, n, prefix_chars and middle_chars.

    A null output stays a null text, a null form counts as plain.
    """
    def make():
        transformer = Transformer(rules)
        return lambda form, output: (None if output is None else transformer.restore(output.encode(), form or "plain").content().decode(),)

    gone = ["n", "form", "prefix_chars", "middle_chars", "output", text_col]
    return _run(made, without(made, gone), [("form", "string"), ("output", "string")], {text_col: T.StringType()}, make)
