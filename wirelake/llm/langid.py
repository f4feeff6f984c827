"""Language ID by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A text is its words, lower-cased, with all but letters as breaks; a word's characters and its end are predicted from
up to three characters before them in the word. Grams are counted over all training documents and all are kept. Those of
all languages share one sorted array of hashes for each order, with a row of log probabilities (a column per language), so
one binary search scores a gram in every language. The language with the lowest cross-entropy a character wins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wirelake.llm.common import add_columns, field, quoted, ridge_logistic, slices, written

ORDER = 4
#: Characters of text whose words are counted at once.
COUNTED = 4_000_000
#: Rows of the pooled limits that are blended into those of each language.
POOLED_ROWS = 20
UNKNOWN = "und"
_BREAK = 32


#: Ideographs from here on are too many for a number of 16 bits each and share numbers by their remainder.
_RARE = 0x20000


def letter_table() -> np.ndarray:
    """By code point: the number of its lower-case letter, or a break. Letters are numbered in order, each for itself up to
    U+1FFFF; of a lower case of several characters (one letter has one) the first counts."""
    made = np.full(0x110000, _BREAK, np.uint16)
    codes = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    low = np.array([ord(chr(c).lower()[0]) for c in codes])
    kinds, at = np.unique(low[low < _RARE], return_inverse=True)
    made[codes[low < _RARE]] = _BREAK + 1 + at
    room = 0xFFFF - _BREAK - 1 - len(kinds)
    made[codes[low >= _RARE]] = _BREAK + 1 + len(kinds) + low[low >= _RARE] % room
    return made


_TABLE: list[np.ndarray] = []


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, packed gram of four characters) for every character and word end of the words.

    16 bits for each character, the oldest in the highest place; context stops at the beginning of the word.
    """
    if not _TABLE:
        _TABLE.append(letter_table())
    joined = b" ".join(words).decode("utf-8") + " "
    raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    number = np.cumsum(raw == _BREAK) - (raw == _BREAK)
    chars = _TABLE[0][raw]
    # One break between stretches of letters, none before the first of the whole.
    keep = (chars != _BREAK) | np.concatenate([[False], chars[:-1] != _BREAK])
    chars, number = chars[keep].astype(np.uint64), number[keep]
    c1, c2, c3 = (np.concatenate([np.full(k, _BREAK, np.uint64), chars[:-k]])[:len(chars)] for k in (1, 2, 3))
    c2 = np.where(c1 == _BREAK, np.uint64(_BREAK), c2)
    c3 = np.where(c2 == _BREAK, np.uint64(_BREAK), c3)
    return number, c3 << np.uint64(48) | c2 << np.uint64(32) | c1 << np.uint64(16) | chars


def count_grams(train: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text); counted within tasks before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(1).to_pylist(), COUNTED):
                part = batch.slice(begin, end - begin)
                found: dict[str, Counter] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found.setdefault(lang, Counter()).update(text.encode().split())
                for lang, words in found.items():
                    number, packed = grams(list(words))
                    kinds, at = np.unique(packed, return_inverse=True)
                    n = np.bincount(at, np.fromiter(words.values(), np.float64, len(words))[number]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds)), pa.array(kinds.view(np.int64)), pa.array(n)],
                                                     names=["lang", "gram", "n"])

    return train.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """langs; for each order 1 to 4 the sorted grams (packed, shorter ones in the low places) and their log
    probabilities by language; for each context length 1 to 3 the sorted contexts and log back-off weights."""

    langs: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backs: list[np.ndarray]
    calibration: tuple[float, float] = (0.0, 3.0)
    limits: np.ndarray | None = None  # highest cross-entropy accepted, by language and length class

    def log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        """Natural logs, one row for each gram and one column for each language."""
        out = np.zeros((len(packed), len(self.langs)), np.float32)
        todo, carried = np.arange(len(packed)), None
        for order in range(ORDER, 0, -1):
            gram = packed[todo] & np.uint64((1 << 16 * order) - 1)
            keys = self.keys[order - 1]
            at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            hit = keys[at] == gram
            own = self.logs[order - 1][at[hit]]
            out[todo[hit]] = own if carried is None else own + carried[hit]
            todo, gram = todo[~hit], gram[~hit]
            if not len(todo):
                break
            carried = np.zeros((len(todo), len(self.langs)), np.float32) if carried is None else carried[~hit]
            if order > 1:
                known = self.contexts[order - 2]
                context = gram >> np.uint64(16)
                at = np.minimum(np.searchsorted(known, context), len(known) - 1)
                carried = carried + np.where((known[at] == context)[:, None], self.backs[order - 2][at], np.float32(0))
            else:
                out[todo] = carried + np.float32(np.log(1e-6))
        return out


def estimate(names: np.ndarray, packed: np.ndarray, n: np.ndarray) -> Model:
    """A model from the language, the packed gram and the count of each kept gram."""
    langs = sorted(set(names))
    column = {x: i for i, x in enumerate(langs)}
    lang = np.array([column[x] for x in names])
    packed, n = np.ascontiguousarray(packed, np.int64).view(np.uint64), n.astype(np.float64)
    keys, logs, contexts, backs = [], [], [], []
    tables = []
    for order in range(ORDER, 0, -1):  # counts: true ones at the top, numbers of different left neighbours below
        kinds, at = np.unique(packed, return_inverse=True)
        count = np.zeros((len(kinds), len(langs)))
        np.add.at(count, (at, lang), n)
        tables.append((kinds, count))
        pairs = np.unique(np.stack([packed & np.uint64((1 << 16 * (order - 1)) - 1), packed, lang.astype(np.uint64)]), axis=1)
        packed, lang, n = pairs[0], pairs[2].astype(np.int64), np.ones(pairs.shape[1])
    lower = None
    for order, (kinds, count) in zip(range(1, ORDER + 1), reversed(tables)):
        ones, twos = (count == 1).sum(0), (count == 2).sum(0)
        discount = np.clip(ones / np.maximum(1, ones + 2 * twos), 0.1, 0.95)
        context, at = np.unique(kinds >> np.uint64(16), return_inverse=True)
        total = np.zeros((len(context), len(langs)))
        types = np.zeros_like(total)
        np.add.at(total, at, count)
        np.add.at(types, at, count > 0)
        back = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
        if lower is None:  # over the characters of all languages, with room for others
            shorter = np.full(count.shape, 1.0 / (len(kinds) + 1))
        else:
            low_kinds, low = lower
            shorter = low[np.searchsorted(low_kinds, kinds & np.uint64((1 << 16 * (order - 1)) - 1))]
        p = np.maximum(count - discount, 0) / np.maximum(total[at], 1) + back[at] * shorter
        lower = kinds, p
        keys.append(kinds)
        logs.append(np.log(p).astype(np.float32))
        if order > 1:
            contexts.append(context)
            backs.append(np.log(back).astype(np.float32))
    return Model(langs, keys, logs, contexts, backs)


class Scorer:
    """Cross-entropies of texts, with the log probabilities of words remembered (forgotten all at once when full)."""

    REMEMBERED = 300_000

    def __init__(self, model: Model):
        self.model, self.row = model, {}
        self.values = np.zeros((0, len(model.langs) + 1), np.float32)  # a word's logs, then its characters

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy in nats a character by language, number of characters) for each text."""
        counted = [Counter((t or "").encode().split()) for t in texts]
        new = list(set().union(*counted).difference(self.row))
        if len(self.row) + len(new) > self.REMEMBERED:
            self.row, self.values = {}, self.values[:0]
            new = list(set().union(*counted))
        if new:
            base, made = len(self.row), np.zeros((len(new), self.values.shape[1]), np.float32)
            number, packed = grams(new)
            logs = self.model.log_probabilities(packed)
            for j in range(logs.shape[1]):
                made[:, j] = np.bincount(number, logs[:, j], len(new))
            made[:, -1] = np.bincount(number, minlength=len(new))
            self.row |= {w: base + i for i, w in enumerate(new)}
            self.values = np.concatenate([self.values, made])
        out = np.zeros((len(texts), self.values.shape[1]))
        for i, words in enumerate(counted):
            if words:
                at = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
                out[i] = np.fromiter(words.values(), np.float64, len(words)) @ self.values[at]
        n = out[:, -1]
        return -out[:, :-1] / np.maximum(n, 1)[:, None], n


def _length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(int), 19)


def _margin(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How far the second-best language is behind, in units that a longer text makes surer."""
    if h.shape[1] < 2:
        return np.sqrt(n)
    two = np.partition(h, 1, axis=1)[:, :2]
    return (two[:, 1] - two[:, 0]) * np.sqrt(n)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", among: Column | None = None) -> Model | None:
    """A model from all rows with a text and a language (and `among`, if given); None if there is none.

    Grams are counted over all those rows and none is cut, so discounts and back-off weights are those of the whole table;
    the driver and every executor hold all different grams. Calibration and limits of rejection
    are fitted on all of those rows.
    """
    train = docs if among is None else docs.where(among)
    train = train.select(quoted(id_col).alias("id"), quoted(lang_col).cast("string").alias("lang"), quoted(text_col).cast("string").alias("text")) \
        .where("lang is not null and text is not null")
    rows = count_grams(train.select("lang", "text")).toArrow()
    if not rows.num_rows:
        return None
    model = estimate(*(rows.column(x).to_numpy() for x in ("lang", "gram", "n")))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shipped.value)

        def compute(texts):
            h, n = scorer.entropies(texts)
            best = h.argmin(1)
            return [scorer.model.langs[i] for i in best], h.min(1), _margin(h, n), n

        return compute

    seen = written(
        add_columns(train.select("lang", "text"), "text", [field("best", "string"), field("h", "double"), field("margin", "double"),
                                                           field("n", "double")], make).where("n > 0")
        .select("lang", "best", "h", "margin", "n"), "entropies")
    fitted = seen.groupBy((F.col("lang") == F.col("best")).cast("double").alias("right"),
                          (F.round(F.least("margin", F.lit(200.0)) * 10) / 10).alias("margin")).agg(F.count("*").alias("k")).collect()
    if fitted:
        weight = np.array([r["k"] for r in fitted], float)
        x = np.array([[1.0, r["margin"]] for r in fitted])
        a, b = ridge_logistic(x, np.array([r["right"] for r in fitted]), weight, 0.01)
        model.calibration = float(a), max(1e-3, float(b))
    model.limits = rejection_limits(seen, model.langs)
    shipped.unpersist()
    return model


def rejection_limits(seen: DataFrame, langs: list[str]) -> np.ndarray:
    """Highest cross-entropy accepted, by language and length class, from all rows of `seen` (lang, best, h, n).

    Rows of their language only. Centre and spread of a language are blended with those of all languages together,
    which weigh as much as `POOLED_ROWS` rows, so a rare language has limits too and nothing changes at a given size.
    """
    right = seen.where("lang = best").withColumn("class", F.least(F.floor(F.log2("n")), F.lit(19)).cast("int"))
    centres = {r["best"]: r for r in right.groupBy("best").agg(F.expr("percentile_approx(h, 0.5, 10000)").alias("centre"), F.count("*").alias("k")).collect()}
    if not centres:
        return np.full((len(langs), 20), np.inf)
    centred = F.create_map(*[x for lang, r in centres.items() for x in (F.lit(lang), F.lit(r["centre"]))])
    squares = {r["best"]: r["s"] for r in right.groupBy("best").agg(F.sum(F.pow(F.col("h") - F.element_at(centred, F.col("best")), F.lit(2)) * F.col("n")).alias("s")).collect()}
    upper = {(r["best"], r["class"]): r["q"] for r in right.groupBy("best", "class").agg(F.expr("percentile_approx(h, 0.999, 10000)").alias("q")).collect()}
    rows = sum(r["k"] for r in centres.values())
    all_centre, all_square = sum(r["k"] * r["centre"] for r in centres.values()) / rows, sum(squares.values()) / rows
    limits = np.zeros((len(langs), 20))
    for i, lang in enumerate(langs):
        k, own = (centres[lang]["k"], centres[lang]["centre"]) if lang in centres else (0, 0.0)
        centre = (k * own + POOLED_ROWS * all_centre) / (k + POOLED_ROWS)
        spread = np.sqrt((squares.get(lang, 0.0) + POOLED_ROWS * all_square) / (k + POOLED_ROWS))
        # Eight deviations at the shortest length of the class, and half above the usual entropy at any length.
        limits[i] = np.maximum(centre * 1.5, centre + 8 * spread / np.sqrt(2.0 ** np.arange(20)))
        for c in range(20):
            limits[i, c] = max(limits[i, c], 1.1 * upper.get((lang, c), 0.0))
    return limits


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred, lang_score (0 to 1, the calibrated chance of being right), cross_entropy and lang_rejected.

    lang_pred is `und`, with score 0, where the text is null or has no letter, or where nothing was learned; such
    texts are rejected, as are those whose cross-entropy is beyond what their language's training texts of that
    length show. Ties go to the language first by code point. Columns of such names are replaced; equal texts get
    equal results; an empty table gives an empty one.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        if shipped.value is None:
            return lambda texts: ([UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts))
        scorer = Scorer(shipped.value)
        m = scorer.model
        a, b = m.calibration

        def compute(texts):
            h, n = scorer.entropies(texts)
            best, low = h.argmin(1), h.min(1)
            score = 1 / (1 + np.exp(-np.clip(a + b * _margin(h, n), -30, 30)))
            refused = low > m.limits[best, _length_class(n)]
            none = n == 0
            return ([UNKNOWN if x else m.langs[i] for x, i in zip(none, best)], np.where(none, 0.0, score),
                    [None if x else float(v) for x, v in zip(none, low)], refused | none)

        return compute

    return add_columns(docs, text_col, [field("lang_pred", "string"), field("lang_score", "double"), field("cross_entropy", "double"),
                                        field("lang_rejected", "boolean")], make)
