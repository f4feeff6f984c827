"""Toxicity by a weighted lexicon: folded text, one Aho-Corasick pass, weights by length, exception phrases.

Folding makes letters of homoglyphs and of digits and signs that stand for letters, and spaces of all else that is
no letter. Lexicon entries are beginnings of words, found in labelled texts by their lift; exception phrases are pairs
of neighbouring words around an entry that occur in harmless texts, and take back the entry's weight. Scores are
calibrated by a logistic model on labelled texts that the lexicon was not drawn from.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field as default

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wirelake.llm.common import Fold, add_columns, field, quoted, ridge_logistic

#: Characters that are used in place of a Latin letter.
LOOK_ALIKE = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": " ",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m",
    "т": "t", "н": "h", "в": "b", "А": "a", "В": "b", "Е": "e", "К": "k", "М": "m", "Н": "h", "О": "o", "Р": "p", "С": "c",
    "Т": "t", "Х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
#: Labelled rows of each class that the lexicon and the calibration are fitted on, at most.
SAMPLE = 10_000
SHORTEST, LONGEST = 3, 10
THRESHOLD = 0.7


@dataclass(frozen=True)
class Lexicon:
    """Weights of word beginnings, exception phrases ("word word") and the calibration (constant, slopes)."""

    weights: dict[str, float] = default(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    calibration: tuple[float, float, float] = (-3.0, 1.0, 1.0)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.fold, self.lexicon = Fold(LOOK_ALIKE), lexicon
        self.automaton = ahocorasick.Automaton()
        for stem, weight in lexicon.weights.items():
            self.automaton.add_word(" " + stem, (len(stem) + 1, weight))
        self.automaton.make_automaton()

    def folded(self, text: str) -> str:
        return " " + text.translate(self.fold) + " "

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(start of the word, weight) for every entry that begins a word."""
        if not self.lexicon.weights:
            return []
        return [(end - n + 2, w) for end, (n, w) in self.automaton.iter(folded)]

    def phrases(self, folded: str, start: int) -> list[str]:
        """The word at `start` with the word before it and with the one after it."""
        end = folded.index(" ", start)
        word, out = folded[start:end], []
        last = start - 1
        while last > 0 and folded[last] == " ":
            last -= 1
        if last > 0:
            out.append(f"{folded[folded.rfind(' ', 0, last) + 1:last + 1]} {word}")
        while end < len(folded) and folded[end] == " ":
            end += 1
        if end < len(folded):
            out.append(f"{word} {folded[end:folded.index(' ', end)]}")
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        """(log of 1 + weight, log of 1 + weight in 100 words) of a whole text."""
        if not text:
            return 0.0, 0.0
        folded = self.folded(text)
        hits = self.hits(folded)
        if not hits:
            return 0.0, 0.0
        except_ = self.lexicon.exceptions
        total = sum(w for at, w in hits if not except_ or not except_.intersection(self.phrases(folded, at)))
        return math.log1p(total), math.log1p(100 * total / max(1, len(folded.split())))


def _sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, rows: int, among: Column | None) -> DataFrame:
    """(text, y, weight, part): at most `rows` labelled documents of each class, chosen by a hash of their id."""
    known = labels.select(quoted(id_col).cast("long").alias("doc_id"), quoted(label).cast("int").alias("y")) \
        .where("doc_id is not null and y in (0, 1)")
    if among is not None:
        known = known.where(among)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("turn", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, 0.95 * rows / max(1, n)) for y, n in counts.items()}
    bound = F.lit(0)
    weight = F.lit(1.0)
    for y, s in share.items():
        bound = F.when(F.col("y") == y, F.lit(int(s * 1_000_000))).otherwise(bound)
        weight = F.when(F.col("y") == y, F.lit(1 / s)).otherwise(weight)
    chosen = known.where(F.col("turn") < bound).select("doc_id", "y", weight.alias("weight"), (F.col("turn") % 10).alias("part"))
    text = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return text.join(F.broadcast(chosen), "doc_id").select("text", "y", "weight", "part")  # at most 2 x rows rows


def _count(sample: DataFrame, features) -> DataFrame:
    """(feature, toxic, clean): documents of each class that have it; counted within tasks before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = features()
        for batch in batches:
            found = Counter(), Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[y].update(of(text or ""))
            names = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[1][x] for x in names], pa.int64()),
                                              pa.array([found[0][x] for x in names], pa.int64())], names=["feature", "toxic", "clean"])

    return sample.select("text", "y").mapInArrow(run, "feature string, toxic bigint, clean bigint") \
        .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _beginnings():
    fold = Fold(LOOK_ALIKE)

    def of(text: str) -> set[str]:
        return {w[:n] for w in set(text.translate(fold).split()) for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}

    return of


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          among: Column | None = None, rows: int = SAMPLE) -> Lexicon:
    """A lexicon from the documents whose id `labels` marks 1 or 0 in the column `label`.

    `among` is a condition on doc_id that says which labels may be used. At most `rows` labelled documents of each
    class are read, chosen by a hash of their id; seven tenths give the lexicon, the rest the calibration. Labels
    that are null, other than 0 or 1, or for unknown ids are left out; a document labelled twice counts as toxic if
    any label says so. Without toxic labels the lexicon is empty and every score is near zero.
    """
    sample = _sample(docs, labels, label, id_col, text_col, rows, among).persist()
    try:
        fit = sample.where("part < 7")
        n = {r["y"]: r["n"] for r in fit.groupBy("y").agg(F.count("*").alias("n")).collect()}
        toxic, clean = n.get(1, 0), n.get(0, 0)
        if not toxic or not clean:
            return Lexicon()
        share = toxic / (toxic + clean)
        counted = _count(fit, _beginnings).where("toxic >= 3")
        # Deviance of the split from the classes' shares; entries must stand out among all that are tried.
        part = lambda x, p: f"case when {x} > 0 then {x} * ln({x} / (({p}) * (toxic + clean))) else 0 end"
        counted = counted.withColumn("stands_out", F.expr(f"{part('toxic', share)} + {part('clean', 1 - share)}")) \
            .withColumn("weight", F.expr(f"ln((toxic + 0.5) / {toxic + 1}) - ln((clean + 0.5) / {clean + 1})"))
        tried = max(1, counted.count())
        top = counted.where((F.col("weight") > 2.0) & (F.col("stands_out") > math.log(tried) + 3)) \
            .collect()  # three toxic rows of the sample each
        weights: dict[str, float] = {}
        for r in sorted(top, key=lambda r: (len(r["feature"]), r["feature"])):
            x = r["feature"]
            if not any(weights.get(x[:k], -9.0) >= r["weight"] - 0.7 for k in range(SHORTEST, len(x))):
                weights[x] = r["weight"]
        if not weights:
            return Lexicon()
        draft = Lexicon(weights)

        def neighbours():
            matcher = Matcher(draft)

            def of(text: str) -> set[str]:
                folded = matcher.folded(text)
                return {p for at, _ in matcher.hits(folded) for p in matcher.phrases(folded, at)}

            return of

        harmless = _count(fit, neighbours).where(
            f"clean >= 5 and ln((toxic + 0.5) / {toxic + 1}) - ln((clean + 0.5) / {clean + 1}) < -1.0")
        exceptions = frozenset(r["feature"] for r in harmless.collect())
        known = Lexicon(weights, exceptions)
        rest = add_columns(sample.where("part >= 7"), "text", [field("whole", "double"), field("dense", "double")],
                           lambda: _pairs(Matcher(known))).select("whole", "dense", "y", "weight").collect()
        if {r["y"] for r in rest} != {0, 1}:
            return known
        x = np.array([[1.0, r["whole"], r["dense"]] for r in rest])
        beta = ridge_logistic(x, np.array([r["y"] for r in rest], float), np.array([r["weight"] for r in rest]), 0.1)
        return Lexicon(weights, exceptions, tuple(map(float, beta)))
    finally:
        sample.unpersist()


def _pairs(matcher: Matcher):
    return lambda texts: list(zip(*map(matcher.features, texts)))


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with toxicity (0 to 1) and toxic (whether it reaches the threshold).

    Whole texts are read. Null and empty texts score as texts without a hit. Columns of such names are replaced; equal
    texts score alike; an empty table gives an empty one.
    """
    a, b, c = lexicon.calibration

    def make():
        matcher = Matcher(lexicon)

        def compute(texts):
            made = [1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y)))) for x, y in map(matcher.features, texts)]
            return made, [p >= threshold for p in made]

        return compute

    return add_columns(docs, text_col, [field("toxicity", "double"), field("toxic", "boolean")], make)
