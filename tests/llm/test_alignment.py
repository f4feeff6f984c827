"""Alignment of two vocabularies against brute force over whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wirelake.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b, alignment.bytes_of_a(A), alignment.bytes_of_b(b)


def aligned(models, text):
    """(ids of A, ids of B, groups, links) over the whole text, or None."""
    a, b, bytes_a, bytes_b = models
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    whole = (" " + text).encode()
    if b"".join(bytes_a[i] for i in ids_a) != whole or b"".join(bytes_b[i] for i in ids_b) != whole:
        return None
    spans = []
    for ids, own in ((ids_a, bytes_a), (ids_b, bytes_b)):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(own[i])))
            at += len(own[i])
        spans.append(out)
    of_byte = [[(i, s) for i, s, e in own for _ in range(s, e)] for own in spans]  # the token that each byte lies in
    links = [(a[0], b[0]) for a, b in dict.fromkeys(zip(*of_byte))]
    common = {e for _, _, e in spans[0]} & {e for _, _, e in spans[1]}
    groups, held = [], ([], [])
    ends = [{e: i for i, _, e in own} for own in spans]
    for at in range(1, len(whole) + 1):
        for own, end in zip(held, ends):
            own += [str(end.get(at))] * (at in end)
        if at in common:
            groups.append("|".join(map(",".join, held)))
            held = ([], [])
    return ids_a, ids_b, groups, links


def brute(models, texts):
    """Rows of documents() by place of the text."""
    made = [aligned(models, t) for t in texts]
    n = Counter(x for m in made if m for x in m[3])
    most = Counter()
    for (_, b), k in n.items():
        most[b] = max(most[b], k)
    out = []
    for m in made:
        if m is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            ids_a, ids_b, groups, links = m
            out.append((len(ids_a), len(ids_b), len(groups), len(links), sum(n[x] == most[x[1]] for x in links), sum(n[x] for x in links),
                        hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, n


TEXTS = ["a", " a", "a ", "  a  b  ", "\n", " ", "   ", "a\n\nb", "x\r\ny;\r", "tab\there", "the \u2581 low line", "<s> a </s><unk>", "a <|endoftext|> b<0x0A>", "caf\u00e9 e\u0301",
         "日本語 テスト", "\U0001f600\U0001f600", "a\u00a0b\u3000 c", "nul\x00 x", "it's we'll", "\u180e x\x1c y", "....... ,,, !!!", "1234567 89", "\n \n x", "Größe über",
         "ARM \u2028 line", " \r", "\r\n"]


def test_whole_texts_against_brute_force(spark, models):
    rnd = random.Random(8)
    pieces = [c for t in TEXTS for c in t] + [" the", " of", "ing", "\n", " ", "."] * 20
    texts = TEXTS + [None, ""] + ["".join(rnd.choices(pieces, k=rnd.randint(1, 80))) for _ in range(250)] + TEXTS[:9]
    want, pairs = brute(models, texts)
    docs = spark.createDataFrame([(i, t, "old", 3) for i, t in enumerate(texts)], "doc_id long, text string, part string, a int").repartition(3)
    made = alignment.align(docs, A, B, part=700, with_groups=True)
    rows = {r["doc_id"]: r for r in made.documents().collect()}
    assert len(rows) == len(texts) and made.parts.count() > 6
    for i, w in enumerate(want):
        assert tuple(rows[i])[1:8] == w, texts[i]
        assert hashlib.sha256(rows[i]["groups"].encode()).hexdigest() == w[6] or (w[6], rows[i]["groups"]) == ("", "")
    counts = made.counts.collect()
    assert {(r["a"], r["b"]): r["n"] for r in counts} == dict(pairs)
    most = Counter()
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    assert all(r["best"] == (r["n"] == most[r["b"]]) for r in counts)


def test_one_to_one_groups_do_not_enter_the_pairs():
    model = alignment.Aligner(A, B)
    row = model.part(0, [1, 2], pa.array(["the of the", "the\u00e9"]), False)
    exact = dict(zip(row.column("exact_a")[0].as_py(), row.column("exact_n")[0].as_py()))
    the, of = (model.a.joined.encode(x, add_special_tokens=False).ids[0] for x in (" the", " of"))
    assert exact[the] == 3 and exact[of] == 1
    pairs = zip(row.column("pair_a")[0].as_py(), row.column("pair_b")[0].as_py(), row.column("pair_n")[0].as_py())
    assert all(n == 0 or model.same[a] != b or n for a, b, n in pairs) and model.same[the] == model.b.piece_to_id("\u2581the")


def test_odd_rows_and_empty_tables(spark, models, odd, odd_rows, none):
    want, _ = brute(models, [r[1] for r in odd_rows])
    got = [tuple(r)[:8] for r in alignment.align(odd, A, B).documents().collect()]
    assert Counter(got) == Counter((r[0], *w) for r, w in zip(odd_rows, want))
    empty = alignment.align(none, A, B)
    assert empty.documents().count() == 0 and empty.counts.count() == 0
