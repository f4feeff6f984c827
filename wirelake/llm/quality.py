"""Quality rules as a ledger of bits: each rule is evaluated once, its failure is a bit, its measurement a column.

A policy is a mask of bits with a name and a version. Applying one, or asking what each rule of it rejects alone, reads
the ledger only: bitwise operations on a column, and aggregation over the different bit patterns.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from wirelake.llm.common import SPACE, add_columns, field

WINDOW = 8
_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def repeat_words(words: list[bytes], codes: np.ndarray | None = None) -> int:
    """Words that lie in a window of 8 words found twice or more; overlapping windows count a word once."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if codes is None:
        codes = np.fromiter(map(hash, words), np.int64, len(words))
    rolled = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + codes[j:j + n].astype(np.uint64)
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    # Equal hashes are looked at as words, so the count is exact.
    found = {int(i): b" ".join(words[i:i + WINDOW]) for i in np.flatnonzero(hit)}
    times = Counter(found.values())
    cover = np.zeros(len(words) + 1, np.int32)
    for i, window in found.items():
        if times[window] > 1:
            cover[i] += 1
            cover[i + WINDOW] -= 1
    return int((np.cumsum(cover) > 0).sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """Measurements of one text in the order of the ledger's columns; a null text has none of anything."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()
    seen: set[str] = set()
    repeated = lines = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            lines += 1
            repeated += line in seen
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, "#*$%&|<>")), repeated,
            repeat_words(words), lines)


@dataclass(frozen=True)
class Rule:
    """A document fails where `fails` is true; the rule's place in the list is its bit."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("many_repeats", "100 * n_repeat_words > 30 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("many_dup_lines", "2 * n_dup_lines > n_lines"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        at = {r.name: i for i, r in enumerate(rules)}
        return sum(1 << at[x] for x in self.rules)


BASE = Policy("base", 1, ("few_words", "many_repeats"))
POLICY = Policy("default", 1, tuple(r.name for r in RULES))


def ledger(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with the measurements and `failed_rules`, a long with a bit for each rule.

    Whole texts are read once. Null and empty texts measure zero and so fail the rule on few words; columns of such
    names are replaced; an empty table gives an empty one.
    """
    names = _MEASURES + ["failed_rules"]
    measured = add_columns(docs, text_col, [field(x, "long") for x in _MEASURES],
                           lambda: lambda texts: list(zip(*map(measure_text, texts))))
    bits = "0L" + "".join(f" + case when {r.fails} then {1 << i}L else 0L end" for i, r in enumerate(rules))
    return measured.drop("failed_rules").withColumn(names[-1], F.expr(bits))


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a row of a ledger breaks no rule of the policy."""
    return F.col("failed_rules").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablation(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(policy, version, rule, failed, failed_alone, kept_without): by rule of the policy, the documents that break it,
    those that break no other rule of it, and those kept if it were left out. Ledger rows are counted by bit pattern
    before they are looked at, so the work after one aggregation does not grow with the documents."""
    patterns = rows.groupBy(F.col("failed_rules").bitwiseAND(F.lit(policy.mask(rules)).cast("long")).alias("bits")) \
        .agg(F.count("*").alias("n"))
    at = {r.name: i for i, r in enumerate(rules)}
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(1 << at[x]).cast("long").alias("bit"))
                               for x in policy.rules])).alias("r")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias
    spread = patterns.select("bits", "n", each).select("bits", "n", "r.rule", "r.bit")
    return spread.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0)("failed"), total(F.col("bits") == F.col("bit"))("failed_alone"),
        total((F.col("bits") == 0) | (F.col("bits") == F.col("bit")))("kept_without")).select(
        F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "rule", "failed", "failed_alone", "kept_without")
