"""Token ids of whole texts by the tokenizers library, encoding each different chunk of a task's texts once.

The vocabularies split text before any merge where white space begins, and between a letter and a sign of punctuation, so
chunks cut there give the ids of the whole text. Chunks begin at a space or a newline after a character that is no white
space, and at ASCII punctuation after a Latin letter. A text with characters that libraries may not class alike as white
space, or with the string of a special token, is one chunk.

Cutting and counting work on the bytes of an Arrow array; Python sees each different chunk of a slice once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks of a generation. The present generation and the one before are remembered; what is forgotten changes no result.
REMEMBERED = 200_000
#: Bytes beyond which a chunk is not remembered.
LONG = 256
#: Chunks encoded in one call.
BATCH = 200
#: Bytes of text that a task works on at once; a longer text is worked on alone.
SLICE = 8_000_000

#: By byte: 1 for what a chunk may begin with, 2 for other white space, 4 for what may be part of odd white space.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x0A]] = 1
_KIND[[0x09, 0x0B, 0x0C, 0x0D]] = 2
_KIND[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = 4
#: ASCII punctuation and letters; a word of Latin letters, which no vocabulary splits.
_SIGN, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_SIGN[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_LETTER[[b for b in range(0x80) if chr(b).isalpha()]] = True
#: In UTF-8: separators U+001C to U+001F, U+0085, U+180E, and white space beyond ASCII.
_ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")


def parts(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that together hold about `limit` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    begin = 0
    while begin < len(ends):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + limit, "right")))
        yield begin, stop
        begin = stop


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of their ends with a zero before them) of a string array; null is empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[edges[0]:edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
    return raw, edges - edges[0]


def cut(texts: pa.Array, strings: list[str], signs: bool = True) -> tuple[pa.Array, np.ndarray]:
    """(chunks of all texts as binary array, chunks of each text); a text with one of `strings` is one chunk.

    Without `signs`, chunks begin at white space only.
    """
    raw, edges = bytes_of(texts)
    if not len(raw):
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    kind = _KIND[raw]
    begins = kind == 1
    begins[1:] &= (kind[:-1] == 0) | (kind[:-1] == 4)
    if signs:
        at = np.flatnonzero(_SIGN[raw[1:]] & (_LETTER[raw[:-1]] | (raw[:-1] >= 0x80)))
        before, lead = raw[at], raw[np.maximum(at - 1, 0)]
        # Of characters beyond ASCII, only U+00C0 to U+00FF without the two signs among them count as letters.
        begins[at[_LETTER[before] | ((lead == 0xC3) & (before != 0x97) & (before != 0xB7))] + 1] = True
    begins[edges[:-1][edges[:-1] < edges[1:]]] = True
    odd: list[int] = []
    if (kind == 4).any():
        odd += [m.start() for m in _ODD.finditer(raw)]
    small = raw.tobytes().lower() if strings else b""
    for string in strings:
        wanted, at = string.lower().encode(), -1
        while (at := small.find(wanted, at + 1)) >= 0:
            odd.append(at)
    for i in set((np.searchsorted(edges, odd, "right") - 1).tolist()):
        begins[edges[i] + 1:edges[i + 1]] = False
    where = np.flatnonzero(begins)
    ends = np.append(where, len(raw)).astype(np.int32)
    chunks = pa.Array.from_buffers(pa.binary(), len(where), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    return chunks, np.diff(np.searchsorted(where, edges))


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies: itself if visible in Latin-1, else one from U+0100 on."""
    out, hidden = {}, 0
    for b in range(256):
        visible = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD
        out[b] = chr(b if visible else 0x100 + hidden)
        hidden += not visible
    return out


class Memory:
    """Values by chunk, worked out once; two generations are kept, so that common chunks stay and rare ones go."""

    def __init__(self, make: Callable[[list[bytes]], list], size: int = REMEMBERED):
        self.make, self.size = make, size
        self.now: dict[bytes, object] = {}
        self.before: dict[bytes, object] = {}

    def values(self, chunks: list[bytes]) -> list:
        """The values of different chunks."""
        out = list(map(self.now.get, chunks))
        missing = [i for i, v in enumerate(out) if v is None]
        new = []
        for i in missing:
            value = self.before.get(chunks[i])
            if value is None:
                new.append(i)
            else:
                self.now[chunks[i]] = out[i] = value
        if new:
            for i, value in zip(new, self.make([chunks[i] for i in new]), strict=True):
                out[i] = value
                if len(chunks[i]) <= LONG:
                    self.now[chunks[i]] = value
        if len(self.now) > self.size:
            self.before, self.now = self.now, {}
        return out


class Encoder:
    """encode(texts): for each text of a string array its ids as little-endian unsigned 32-bit integers.

    They are the ids of the library's encode(text, add_special_tokens=False). With `ordinary`, strings of special
    tokens in a text are ordinary text; else, as in the library, they are those tokens.

    New chunks are encoded many at a time in one text, with a special token of the vocabulary between them: the
    library cuts texts there before all else.
    """

    def __init__(self, path: str, ordinary: bool = False, signs: bool = True, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path, self.ordinary = path, ordinary
        self.joined = Tokenizer.from_file(path)
        specials = {i: t.content for i, t in self.joined.get_added_tokens_decoder().items()}
        self.mark = max(specials)
        self.between = specials[self.mark]
        self.strings = list(specials.values())
        self.single = Tokenizer.from_file(path)
        normal, split = self.joined.normalizer, self.joined.pre_tokenizer
        self.keeps_space = len(split.pre_tokenize_str(" a")[0][0]) == 2
        self.lowers = normal is not None and normal.normalize_str("A") == "a"
        self.single.normalizer = self.single.pre_tokenizer = None
        self.signs_of = byte_signs() | {0: self.between}
        self.signs, self.memory = signs, Memory(self.made, remembered)

    @cached_property
    def alone(self):
        """The plain tokenizer, for the few chunks that are not encoded together."""
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(self.path)
        model.encode_special_tokens = self.ordinary
        return model

    def encode(self, texts: pa.Array) -> list[bytes]:
        chunks, counts = cut(texts, self.strings, self.signs)
        coded = chunks.dictionary_encode()
        values = pa.array(self.memory.values(coded.dictionary.to_pylist()), pa.large_binary())
        taken = values.take(coded.indices)
        _, offsets, data = taken.buffers()
        ends = np.frombuffer(offsets, np.int64, len(taken) + 1, 8 * taken.offset) if len(taken) else np.zeros(1, np.int64)
        edges = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        view = memoryview(data) if data is not None else memoryview(b"")
        return [bytes(view[a:b]) for a, b in zip(edges, edges[1:])]

    def made(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk."""
        out: list[bytes | None] = [None] * len(chunks)
        words, together = [], []
        for i, chunk in enumerate(chunks):
            if _WORD.fullmatch(chunk):
                words.append(i)
            elif len(chunk) > LONG or b"<" in chunk and any(s.lower().encode() in chunk.lower() for s in self.strings):
                out[i] = np.array(self.alone.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            else:
                together.append(i)
        for model, those, text_of in ((self.single, words, self.as_words), (self.joined, together, self.as_texts)):
            for begin in range(0, len(those), BATCH):
                part = those[begin:begin + BATCH]
                ids = np.array(model.encode_batch_fast([text_of([chunks[i] for i in part])], add_special_tokens=False)[0].ids, "<u4")
                at = (np.flatnonzero(ids == self.mark) * 4).tolist()
                raw = ids.tobytes()
                for i, a, b in zip(part, [0, *(x + 4 for x in at)], [*at, len(raw)], strict=True):
                    out[i] = raw[a:b]
        return out

    def as_texts(self, chunks: list[bytes]) -> str:
        return self.between.join([c.decode() for c in chunks])

    def as_words(self, chunks: list[bytes]) -> str:
        """Words of Latin letters as the library has them after normalising and splitting: signs that stand for bytes."""
        text = b"\0".join(chunks if self.keeps_space else [c.lstrip() for c in chunks]).decode()
        return (text.lower() if self.lowers else text).encode().decode("latin-1").translate(self.signs_of)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, ordinary: bool = False) -> Encoder:
    """One encoder for each Python worker, shared by the tasks it runs."""
    if (path, ordinary) not in _ENCODERS:
        _ENCODERS[path, ordinary] = Encoder(path, ordinary)
    return _ENCODERS[path, ordinary]
