"""The positional index against brute force: phrases, proximity, blocks, segments and odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from wirelake.llm import decontamination as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    """Rows of summary() as tuples."""
    grams = {}
    for item_id, text in items:
        ws = words(text)
        k = min(len(ws), window)
        for p in range(len(ws) - k + 1 if k else 0):
            grams.setdefault(tuple(ws[p:p + k]), set()).add(item_id)
    sizes = {len(g) for g in grams}
    out = []
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for k in sizes:
            for p in range(len(ws) - k + 1):
                if (who := grams.get(tuple(ws[p:p + k]))) is not None:
                    hit |= set(range(p, p + k))
                    found |= who
        names = ",".join(sorted("" if i is None else str(i) for i in found))
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    """Few words, so that windows overlap, repeat and nearly match; items that occur whole, in part, twice, or not."""
    rnd = random.Random(17)
    vocab = ["a", "b", "c", "Dd", "é", "x1", "the"]
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choices(vocab, k=n))
    docs = [(i, text(rnd.randint(0, 120))) for i in range(150)]
    items = [(i, text(rnd.randint(1, 25))) for i in range(25)]
    for i, (k, item) in enumerate(items):
        docs.append((1000 + i, text(20) + " " + item + "! " + text(5) + " " + item))
        docs.append((2000 + i, " ".join(words(item)[2:14])))
    docs += [(3000, None), (3001, ""), (3002, " ... "), (None, items[0][1]), (7, docs[0][1]), (7, docs[0][1]), (3003, (items[3][1] + " zz ") * 500)]
    docs += [(3100 + i, items[1][1] + " same") for i in range(60)]
    items += [(900, None), (901, ""), (902, "--"), (None, "a b c dd a b"), (3, text(12)), (903, "absent words only"), (904, "a absent b"), (905, "dd")]
    return docs, items


@pytest.fixture(scope="module")
def frames(spark, corpus):
    docs, items = corpus
    return (spark.createDataFrame([(*r, "old", 1) for r in docs], "doc_id long, text string, term string, segment int").repartition(4),
            spark.createDataFrame([(*r, "old") for r in items], "item_id long, text string, block string"))


@pytest.mark.parametrize("segment,block,window", [(dc.SEGMENT, dc.BLOCK, 10), (300, dc.BLOCK, 10), (300, 40, 10), (dc.SEGMENT, 100, 4)])
def test_phrases_against_brute_force(frames, corpus, segment, block, window):
    index = dc.build(frames[0], segment=segment)
    found = dc.matches(index, frames[1], window, block=block)
    assert tuples(dc.summary(found)) == brute(*corpus, window)
    for r in found.collect():
        assert all(x["begin"] < x["end"] for x in r["hits"]) and all(x["end"] < y["begin"] for x, y in zip(r["hits"], r["hits"][1:]))


def test_the_shuffled_join_gives_the_same(frames, corpus, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(dc, "CANDIDATES", 100)
    assert tuples(dc.summary(dc.matches(dc.build(frames[0]), frames[1]))) == brute(*corpus)


def test_proximity(spark):
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choices("pqrstuvw", k=60))) for i in range(40)]
    items = [(0, "p q r"), (1, "s s t"), (2, "v"), (3, "p zz")]
    index = dc.build(spark.createDataFrame(docs, "doc_id long, text string"), segment=500)
    ask = spark.createDataFrame(items, "item_id long, text string")

    def spans(ws, item, slop):
        """All (begin, end) of in-order matches that are tightest at both ends."""
        out = set()
        for b in range(len(ws)):
            at = b
            if ws[b] != item[0]:
                continue
            for w in item[1:]:
                at = next((k for k in range(at + 1, len(ws)) if ws[k] == w), None)
                if at is None:
                    break
            if at is not None and at - b + 1 <= len(item) + slop:
                out.add((b, at + 1))
        return out

    for slop in (0, 1, 4):
        got = {}
        for r in dc.near(index, ask, slop).collect():
            got.setdefault((r["doc_id"], r["item_id"]), set()).add((r["begin"], r["end"]))
        for d, text in docs:
            for i, item in items:
                want, have = spans(text.split(), item.split(), slop), got.get((d, i), set())
                assert bool(want) == bool(have)
                for b, e in have:  # in order, within the slop
                    ws, k = text.split()[b:e], 0
                    for w in ws:
                        k += k < len(item.split()) and w == item.split()[k]
                    assert k == len(item.split()) and e - b <= len(item.split()) + slop
                if slop == 0:
                    assert want == have


def test_posting_lists_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, (1 << 28) - 1, 1 << 28, (1 << 35) - 1])
    raw, ends = dc.packed(values)
    assert dc.unpacked(raw).tolist() == values.tolist() and np.diff(ends).tolist() == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert len(dc.unpacked(dc.packed(values[:0])[0])) == 0


def test_words_of_texts():
    texts = ["", None, "A-b", " x", "y ", "Ünï ÀZ09_", "a\x00b\x7fc", "é"]
    own, counts = dc.words_of(pa.array(["skip"] + texts).slice(1))
    assert own.to_pylist() == [w for t in texts for w in words(t)] and counts.tolist() == [len(words(t)) for t in texts]


def test_odd_rows_and_empty_tables(spark, odd, odd_rows, none):
    items = spark.createDataFrame([(1, odd_rows[90][1]), (2, "one")], "item_id long, text string")
    index = dc.build(odd, segment=50)
    found = dc.matches(index, items)
    assert tuples(dc.summary(found)) == brute([r[:2] for r in odd_rows], [(1, odd_rows[90][1]), (2, "one")])
    kept = dc.clean(odd, found)
    bad = {r[0] for r in brute([r[:2] for r in odd_rows], [(1, odd_rows[90][1]), (2, "one")]) if r[5] and r[0] is not None}
    assert kept.columns == odd.columns and sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(repr(r[0]) for r in odd_rows if r[0] not in bad)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert not dc.matches(index, nothing).where("size(hits) > 0 or size(items) > 0").count()
    assert dc.matches(index, nothing).count() == len(odd_rows) and dc.near(index, nothing, 2).count() == 0
    empty = dc.build(none)
    assert dc.matches(empty, items).count() == 0 and dc.near(empty, items, 2).count() == 0
