"""Fill-in-middle: piece tables, round trips, and the arrangement against plain string work."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from wirelake.llm import fim


def plain(doc_id, text, unit="[^\n]*\n|[^\n]+", seed=7, spm=50, rate=100):
    """(n, form, prefix, middle, output) by string work alone."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall(unit, text)
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


TEXTS = ["", "one", "a\nb", "a\nb\n", "\n\n", "é\n\U0001f600x\n", "<P", "x<S>", "<<P\n>S>\nM>", "<\nP><", "nul\x00\nline\r\n", "<S\n<M\n<P"] + \
    ["\n".join("w" * (i % 7) for i in range(k)) for k in (2, 30, 3000)]


@pytest.mark.parametrize("unit", ["lines", "words", "characters"])
def test_outputs_and_restored_texts(unit):
    rules = fim.Rules(seed=11, rate=90, spm_rate=30, unit=unit)
    work = fim.Transformer(rules)
    forms = set()
    for i, text in enumerate(TEXTS * 8):
        want = plain(i, text, fim.UNITS[unit], 11, 30, 90)
        n, form, table, lengths = work.arrange(i, text.encode())
        output = table.content()
        assert (n, form, *(lengths or (None, None)), output.decode()) == want
        assert table.sha256() == sha(want[4]) and work.restore(output, form).content().decode() == text
        forms.add(form)
    assert forms == {"plain", "spm", "psm"}


def test_a_cut_splits_a_descriptor_and_copies_nothing():
    table = fim.PieceTable(b"abcdef", b"")
    for at in (2, 2, 6, 0):
        table.cut(at)
    assert table.content() == b"abcdef" and [p.end - p.begin for p in table.pieces] == [0, 2, 0, 4, 0]
    with pytest.raises(IndexError):
        table.cut(7)


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<S>"), ("", "a", "b"), ("ab", "ba", "c"), ("abc", "b", "x"), ("aXa", "b", "c")])
def test_sentinels_that_could_not_be_told_apart_are_refused(marks):
    with pytest.raises(ValueError):
        fim.Rules(prefix=marks[0], middle=marks[1], suffix=marks[2])


def test_odd_rows_and_clashing_names(spark, odd, odd_rows, none):
    docs = odd.withColumn("form", F.lit("old")).withColumn("Output", F.lit("old")).withColumn("i0", F.lit(3))
    made = fim.transform(docs, digests=True)
    assert made.columns == [c for c in docs.columns if c not in ("text", "form", "Output")] + [
        "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"]
    key = lambda x: tuple((v is None, v) for v in x)
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["output_sha256"], r["restored_sha256"])
                  for r in made.collect()), key=key)
    want = sorted(((r[0], *plain(r[0], r[1] or ""), sha(plain(r[0], r[1] or "")[4]), sha(r[1] or "")) for r in odd_rows), key=key)
    assert got == want
    back = fim.restore(made)
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=key) == sorted(((r[0], r[1] or "") for r in odd_rows), key=key)
    assert back.columns == [c for c in made.columns if c not in ("n", "form", "prefix_chars", "middle_chars", "output")] + ["text"]
    assert fim.transform(none).count() == 0 and fim.restore(fim.transform(none)).count() == 0
