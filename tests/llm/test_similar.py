"""Near duplicates of a wanted similarity: planted copies, and the parts against brute force."""

import random

import numpy as np

import corpus_pipeline
from tests.llm import brute
from wirelake.llm import similar


def test_planted_copies_go_and_clean_documents_stay(spark):
    rnd = random.Random(5)
    vocab = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(2000)]
    line = lambda n: rnd.choices(vocab, k=n)
    shared = line(60)
    rows, copies = [], set()
    for i in range(150):
        text = line(200)
        if i % 3 == 0:
            text[50:110] = shared  # a passage of many documents makes no copies of them
        rows.append((i, " ".join(text)))
        for k in range(3):
            near = list(text)
            for _ in range(k):
                near[rnd.randrange(200)] = rnd.choice(vocab)
            rows.append((1000 + 3 * i + k, " ".join(near)))
            copies.add(1000 + 3 * i + k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in similar.first_of_each(docs).collect()}
    assert set(range(150)) <= kept and len(kept & copies) <= 0.02 * len(copies)
    assert not [i for i in kept & copies if (i - 1000) % 3 == 0]  # exact copies


def test_odd_rows(odd, odd_rows, none):
    kept = similar.first_of_each(odd).collect()
    texts = [r["text"] for r in kept]
    assert len(set(texts)) == len(texts) and sum(not brute.words(t) for t in texts) == 1
    assert {tuple(brute.words((r[1] or "").lower())) for r in odd_rows} >= {tuple(brute.words((t or "").lower())) for t in texts}
    assert similar.first_of_each(odd).columns == odd.columns and similar.first_of_each(none).count() == 0


def _jaccard(x, y):
    p, q = ({tuple(t.lower().split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (x, y))
    return len(p & q) / len(p | q)


def _brute_groups(texts, similarity=0.8):
    parent = list(range(len(texts)))
    root = lambda i: i if parent[i] == i else root(parent[i])
    for i in range(len(texts)):
        for j in range(i):
            if _jaccard(texts[i], texts[j]) >= similarity:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def _edited(rnd, words, n):
    words = list(words)
    for i in rnd.sample(range(len(words)), n):
        words[i] = f"new{rnd.random()}"
    return words


def _same_partition(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["mark"]["id"]: r["group"] for r in similar.groups(docs).collect()}
    want = _brute_groups(texts)
    assert len(got) == len(texts)
    assert len({(got[i], want[i]) for i in got}) == len(set(got.values())) == len(set(want))


def test_partners_inside_a_family_of_siblings_are_found(spark):
    rnd = random.Random(23)
    base = [f"w{rnd.random()}" for _ in range(200)]
    family = [_edited(rnd, base, 5) for _ in range(60)]  # about 0.65 to each other
    _same_partition(spark, [" ".join(x) for x in family] + [" ".join(_edited(rnd, x, 4)) for x in family[:30]])


def test_the_shuffled_way_finds_the_same(spark, monkeypatch):
    rnd = random.Random(41)
    base = [f"w{rnd.random()}" for _ in range(120)]
    family = [_edited(rnd, base, 4) for _ in range(25)]
    monkeypatch.setattr(similar, "BROADCAST_LINKS", 0)
    monkeypatch.setattr(similar, "BROADCAST_ROWS", 0)
    _same_partition(spark, [" ".join(x) for x in family] + [" ".join(_edited(rnd, x, 2)) for x in family[:12]] + [" ".join(base)] * 3)


def test_prefixes_of_similar_sets_meet_and_less_similar_sets_fail():
    rnd = np.random.RandomState(31)
    for _ in range(3000):
        n = rnd.randint(1, 60)
        both = rnd.choice(10_000, n + 30, replace=False).astype(np.uint64)
        p, q = np.sort(both[:n]), np.sort(np.concatenate([both[rnd.randint(0, n // 5 + 1):n], both[n:n + rnd.randint(0, n // 5 + 1)]]))
        order, share = rnd.permutation(10_000), len(np.intersect1d(p, q)) / len(np.union1d(p, q))
        first = lambda s: set(s[np.argsort(order[s.astype(int)])][:similar.prefix_length(len(s), 0.8)].tolist())
        assert similar.similar_sets(similar.stored_set(p), similar.stored_set(q), 0.8) == (share >= 0.8 - 1e-9) and (share < 0.8 - 1e-9 or first(p) & first(q))


def test_bitmaps_rule_out_no_similar_sets():
    rnd, ruled_out = np.random.RandomState(5), 0
    for i in range(3000):
        n, m = rnd.randint(1, 400), rnd.randint(1, 400)
        shared = rnd.randint(0, min(n, m) + 1) if i % 2 else int(min(n, m) * 0.9)
        fresh = lambda k: rnd.randint(0, 1 << 62, k).astype(np.uint64)
        both = fresh(shared)
        p, q = np.unique(np.concatenate([both, fresh(n - shared)])), np.unique(np.concatenate([both, fresh(m - shared)]))
        similar_ = similar.similar_sets(similar.stored_set(p), similar.stored_set(q), 0.8)
        left = similar.may_be_similar(similar.bitmap(p), len(p), similar.bitmap(q), len(q), 0.8)
        assert left or not similar_
        ruled_out += not left
    assert ruled_out > 1000
    empty = np.zeros(0, np.uint64)
    assert similar.may_be_similar(similar.bitmap(empty), 0, similar.bitmap(empty), 0, 0.8) and not similar.may_be_similar(
        similar.bitmap(empty), 0, similar.bitmap(p), len(p), 0.8)


def test_tables_of_a_bucket_agree_with_pairs():
    rnd = np.random.RandomState(7)
    sets = [np.unique(rnd.randint(0, 1 << 62, rnd.randint(1, 300)).astype(np.uint64)) for _ in range(12)]
    for p in list(sets):
        n = len(p)
        # Parts of a set, of exactly that similarity where its size is a multiple of five.
        sets += [p[:n - n // 5], np.sort(np.concatenate([p[n // 9:], rnd.randint(0, 1 << 62, n // 9).astype(np.uint64)]))]
    sets += [np.arange(5 * k, dtype=np.uint64) << np.uint64(20) for k in range(1, 40)] + [np.arange(4 * k, dtype=np.uint64) << np.uint64(20) for k in range(1, 40)]
    bits, stored, n = [similar.bitmap(x) for x in sets], [similar.stored_set(x) for x in sets], np.array(list(map(len, sets)))
    for similarity in (0.5, 0.8):
        open_, same = similar.open_table(bits, n, similarity), similar.similar_table(stored, similarity)
        for i in range(len(sets)):
            for j in range(len(sets)):
                if i != j:
                    assert same[i, j] == similar.similar_sets(stored[i], stored[j], similarity), (i, j)
                    assert open_[i, j] or not same[i, j]


def test_a_family_makes_rows_by_its_size_and_not_by_its_square(spark, monkeypatch):
    rnd, rows, written = random.Random(3), {}, similar.written

    def counted(df, name):
        out = written(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(similar, "written", counted)
    base = [f"w{rnd.random()}" for _ in range(40)]
    family = [" ".join(_edited(rnd, base, 1)) for _ in range(300)]  # 0.6 to each other, or near copies
    _same_partition(spark, family)
    assert max(rows.values()) <= 10 * len(family), rows


def test_classes_of_simhash_are_candidates(spark):
    far = 15 << 40
    texts = spark.createDataFrame([(i, x) for i, x in enumerate([1, 7, 6, far, far + 3, 1])], "name long, simhash long")
    wanted = spark.createDataFrame([(i,) for i in range(5)], "name long")
    got = {tuple(r) for r in similar.simhash_buckets(texts, wanted).select("bucket", "name").collect()}
    assert got == {(1, 0), (1, 1), (1, 2), (far, 3), (far, 4)}


def test_classes_of_operator_3_and_similar_sets_make_one_group(spark):
    """The stage of the pipeline against brute force over both kinds of links, chains of both among them."""
    rnd = random.Random(11)
    rows, base = [], [f"w{rnd.random()}" for _ in range(200)]
    fresh = lambda n: [f"w{rnd.random()}" for _ in range(n)]
    texts = [" ".join(_edited(rnd, base, rnd.randint(2, 6))) for _ in range(40)] + [" ".join(fresh(50)) for _ in range(10)]
    # Fingerprints count repeats, sets of shingles don't.
    texts += [" ".join(base[:20] * 6 + fresh(rnd.randint(5, 12))) for _ in range(30)]
    texts += [texts[i] + f" {rnd.random()}" for i in range(0, 80, 7)] + [None, "", texts[3], texts[3].upper()]
    rows = [(None if i == 5 else i // 2 * 2, x) for i, x in enumerate(texts)] + [(6, texts[6])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = list(dict.fromkeys(rows))
    parent = list(range(len(order)))
    root = lambda i: i if parent[i] == i else root(parent[i])
    prints = [brute.fingerprint(t, 3) for _, t in order]
    only = 0
    for i in range(len(order)):
        for j in range(i):
            near = (prints[i] ^ prints[j]).bit_count() <= 2
            alike = _jaccard(order[i][1] or "", order[j][1] or "") >= 0.8
            only += near and not alike
            if near or alike:
                parent[root(i)] = root(j)
    assert only > 3
    first = {}
    for i, (k, _) in enumerate(order):
        k = -1 if k is None else k
        first[root(i)] = min(first.get(root(i), k), k)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept) == sorted(first.values())
