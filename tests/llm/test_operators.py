"""Each operator against a brute-force version, a round trip or held-out accuracy, on odd and on empty tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from wirelake.llm import langid, mixing, packing, quality, sharding, simhash, tokenfile, topk, toxicity, wordpiece

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- sharding

def test_shards_are_near_equal_and_slots_gapless(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    rows = sharding.with_slots(sharding.assign_shards(docs, 8).drop("text"), ["doc_id"]).collect()
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(load.values()) / 8
    assert len(rows) == 20_000 and all(0.98 * mean < x < 1.02 * mean for x in load.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sum(r["shard"] != r["home_shard"] for r in rows) < 0.25 * len(rows)  # most keys stay at home


def test_an_overflowing_cell_goes_clockwise_to_the_first_shard_with_room(spark):
    sizes = [(c, 1 + c % 7) for c in range(64)]
    shards, nodes, cells = 4, 8, 64
    placed = {r["cell"]: r for r in sharding.place_cells(spark.createDataFrame(sizes, "cell long, size long"), shards, nodes, cells, 0.02).collect()}
    ring = spark.range(1).select(sharding.ring(shards, nodes, cells).alias("r")).head()["r"]
    turn = {r["cell"]: r["t"] for r in spark.createDataFrame(sizes, "cell long, size long").select(
        "cell", F.xxhash64(F.lit("order"), "cell").alias("t")).collect()}
    bound, load = -(-sum(s for _, s in sizes) * 1.02 // shards), [0] * shards
    for cell, size in sorted(sizes, key=lambda x: (-x[1], turn[x[0]])):
        first = sum(x["cell"] < cell for x in ring)
        walk = [x["shard"] for x in ring[first:] + ring[:first]]
        shard = next((s for s in walk if load[s] + size <= bound), min(range(shards), key=lambda s: load[s]))
        load[shard] += size
        assert placed[cell]["shard"] == shard and placed[cell]["home"] == walk[0]


def moved(spark, docs, cells=4096):
    """(loads over their mean with 24 and 25 shards, share of bytes that move, share that moves between old shards)."""
    placed = [{r["doc_id"]: (r["shard"], r["size"]) for r in sharding.assign_shards(docs, n, cells=cells).collect()} for n in (24, 25)]
    loads = []
    for n, rows in zip((24, 25), placed):
        load = Counter()
        for shard, size in rows.values():
            load[shard] += size
        loads.append([load[s] / (sum(load.values()) / n) for s in range(n)])
    total = sum(size for _, size in placed[0].values())
    away = [(placed[1][i][0], size) for i, (shard, size) in placed[0].items() if placed[1][i][0] != shard]
    return loads, sum(s for _, s in away) / total, sum(s for to, s in away if to != 24) / total


def test_one_more_shard_moves_little_and_no_shard_is_over_the_bound(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.pmod(F.xxhash64("id"), F.lit(700))).cast("int")).alias("text"))
    loads, away, between = moved(spark, docs)
    assert all(0.98 < x <= 1 + sharding.SLACK + 1e-5 for load in loads for x in load)
    assert away < 0.10 and between < 0.05  # the new shard's share is 4 %


def test_slots_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "t", i, "r", 5, "old") for i in range(50)], "doc_id long, text string, part long, rank string, before int, Slot string")
    made = sharding.with_slots(sharding.assign_shards(docs, 3), ["doc_id"])
    assert {"part", "rank", "before", "slot"} <= set(made.columns) and "Slot" not in made.columns
    assert sorted((r["part"], r["rank"], r["before"]) for r in made.collect()) == [(i, "r", 5) for i in range(50)]


def test_sharding_odd_rows(odd, odd_rows, none):
    made = sharding.assign_shards(odd, 3)
    assert made.count() == len(odd_rows) and {"shard", "size", "score"} <= set(made.columns) and "Size" not in made.columns
    want = Counter((r[0], len((r[1] or "").encode()) + 8) for r in odd_rows)
    assert Counter((r["doc_id"], r["size"]) for r in made.collect()) == want
    assert sharding.with_slots(sharding.assign_shards(none, 3), ["doc_id"]).count() == 0


# ---- toxicity

def planted(spark):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(3, 8))) for _ in range(200)]
    docs, labels = [], []
    for i in range(1200):
        ws = [rnd.choice(vocab) for _ in range(rnd.randint(5, 80))]
        bad = i % 4 == 0
        if bad:
            ws.insert(rnd.randint(0, len(ws)), rnd.choice(["vilexy", "VILEXY,", "v1lexy", "vіlexyness", "grubkin"]))
        elif i % 4 == 1:
            ws[1:1] = ["harmless", "grubkin"]
        docs.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_held_out(spark):
    docs, labels, truth = planted(spark)
    lexicon = toxicity.learn(docs, labels, among=F.col("doc_id") % 3 != 1)
    assert "harmless grubkin" in lexicon.exceptions or not any("grubkin".startswith(x) for x in lexicon.weights)
    rows = [r for r in toxicity.score(docs, lexicon).collect() if r["doc_id"] % 3 == 1]
    wrong = [r for r in rows if r["toxic"] != bool(truth[r["doc_id"]])]
    missed = [r for r in wrong if truth[r["doc_id"]] and "grubkin" not in r["text"]]
    assert not missed and len(wrong) < 0.08 * len(rows)
    assert not [r for r in wrong if not truth[r["doc_id"]]]


def test_toxicity_odd_rows(spark, odd, odd_rows, none):
    lexicon = toxicity.Lexicon({"abc": 3.0})
    rows = toxicity.score(odd, lexicon).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["toxicity"] <= 1 for r in rows) and rows[0]["score"] == "old"
    assert toxicity.score(none, lexicon).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(odd, nothing) == toxicity.Lexicon()
    strange = spark.createDataFrame([(None, 1), (1, None), (2, 5), (3, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.learn(odd, strange).weights == {}


def test_neighbours_of_any_length_make_phrases():
    long = "a" * 500
    m = toxicity.Matcher(toxicity.Lexicon({"moron": 2.0}, frozenset([f"{long} moron", f"moron {long}"])))
    assert m.features(f"{long}{' .' * 200} moron")[0] == 0 and m.features(f"moron{'!' * 300}{long}")[0] == 0
    assert m.features("moron")[0] > 0 and m.phrases(m.folded("moron"), 1) == [] and m.phrases(m.folded("x moron"), 3) == ["x moron"]


def test_matching_ignores_what_does_not_begin_a_word():
    m = toxicity.Matcher(toxicity.Lexicon({"moron": 2.0}))
    assert m.features("oxymoron MORONIC")[0] == m.features("moron oxymoron")[0] > 0
    assert m.features("m0r0n... 'mоrоn'")[0] > m.features("moron x")[0]


# ---- SimHash

def test_words_within_two_bits_share_a_codeword():
    rnd = np.random.RandomState(1)
    a = rnd.randint(0, 1 << 23, 3000)
    flips = np.array([1 << rnd.randint(23) | (1 << rnd.randint(23) if rnd.rand() < .5 else 0) for _ in a])
    mine, theirs = defaultdict(set), defaultdict(set)
    for words, found in ((a, mine), (a ^ flips, theirs)):
        at, index = simhash.codeword_indices(words)
        for i, x in zip(at.tolist(), index.tolist()):
            found[i].add(x)
    assert all(mine[i] & theirs[i] for i in range(len(a)))
    assert {len(x) for x in mine.values()} == {1, 6}


@pytest.mark.parametrize("shingle", [3, 5])
def test_components_against_brute_force(odd, odd_rows, shingle):
    rows, _ = simhash.near_duplicates(odd, shingle=shingle)
    prints = [(r[0], brute.fingerprint(r[1], shingle)) for r in odd_rows]
    want = Counter((i, f, c) for (i, f), c in zip(prints, brute.component_ids(prints, 2)))
    assert Counter((r["doc_id"], r["simhash"] % (1 << 64), r["component_id"]) for r in rows.collect()) == want


def test_links_of_planted_fingerprints(spark):
    rnd = random.Random(5)
    prints = set()
    for _ in range(40):  # chains and dense balls
        x = rnd.getrandbits(64)
        for _ in range(30):
            prints.add(x)
            y = x ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))
            x = y if rnd.random() < .5 else x
            prints.add(y)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    rows = spark.createDataFrame([(i, s[0]) for i, s in enumerate(signed)], "id long, simhash long")
    got = {r["simhash"] % (1 << 64): r["component_id"] for r in simhash.class_ids(rows).collect()}
    want = brute.component_ids(list(enumerate(prints)), 2)
    assert [got[p] for p in prints] == want


def test_one_of_each_group_stays(odd, odd_rows, none):
    kept = simhash.first_of_each(odd, shingle=3)
    prints = [(r[0], brute.fingerprint(r[1], 3)) for r in odd_rows]
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute.component_ids(prints, 2)))
    assert simhash.first_of_each(none).count() == 0 and simhash.near_duplicates(none)[0].count() == 0


def test_simhash_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(i, "a b c d", "x", 7, "r") for i in range(3)], "doc_id long, text string, id string, `check` int, `own id` string")
    rows = simhash.near_duplicates(docs)[0].collect()
    assert len(rows) == 3 and {(r["id"], r["check"], r["own id"], r["component_id"]) for r in rows} == {("x", 7, "r", 0)}


# ---- language ID

def test_language_held_out(spark):
    rnd = random.Random(11)
    kinds = {"aa": ["than", "ing", "wer", "sho"], "bb": ["leux", "tion", "éau", "que"], "cc": ["schö", "ung", "keit", "ver"]}
    rows = [(i, " ".join("".join(rnd.choices(kinds[x], k=rnd.randint(1, 3))) for _ in range(rnd.randint(3, 50))), x)
            for i in range(600) for x in [rnd.choice(list(kinds))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, among=F.col("doc_id") % 5 != 0)
    made = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(made[i]["lang_pred"] == x and not made[i]["lang_rejected"] for i, _, x in rows if i % 5 == 0)
    strange = spark.createDataFrame([(1, "zqxj wwwkk ppqz jjxx qqqq " * 20), (2, "12 34"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(strange, model).collect()}
    assert all(r["lang_rejected"] for r in got.values()) and [got[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3
    assert got[1]["lang_pred"] != "und" and all(0 <= r["lang_score"] <= 1 for r in got.values())


def test_gram_counts_and_probabilities(spark):
    docs = spark.createDataFrame([("x", "Abab, ab1ab"), ("x", "ab"), ("y", "ba")], "lang string, text string")
    got = {(r["lang"], r["gram"]): r["n"] for r in langid.count_grams(docs).collect()}
    want, number = Counter(), langid.letter_table().tolist()
    for lang, words in (("x", ["abab", "ab", "ab", "ab"]), ("y", ["ba"])):
        for w in words:
            padded = "   " + w + " "
            for i in range(3, len(padded)):
                want[lang, sum(number[ord(c)] << 16 * (3 - j) for j, c in enumerate(padded[i - 3:i + 1]))] += 1
    assert got == dict(want)
    model = langid.estimate(*map(np.array, zip(*[(lang, gram, n) for (lang, gram), n in got.items()])))
    # Probabilities after one context add up to one over the characters that can follow, the unseen ones included.
    context = sum(number[ord(c)] << 16 * (2 - j) for j, c in enumerate("  a"))
    follow = np.array([context << 16 | number[ord(c)] for c in "ab "], np.uint64)
    total = np.exp(model.log_probabilities(follow)).sum(0)
    assert (total > 0.7).all() and (total <= 1 + 1e-6).all()


def test_letters_beyond_the_first_plane_are_told_apart(spark):
    table = langid.letter_table()
    for begin, end in ((0x1E900, 0x1E922), (0x104B0, 0x104D4), (0x10330, 0x1034B), (0x13000, 0x13430)):
        letters = [c for c in range(begin, end) if chr(c).isalpha()]
        assert len(set(table[letters].tolist())) == len(letters) and 32 not in table[letters]
    assert table[0x1E900] == table[0x1E922] and table[ord("İ")] == table[ord("i")] and table[0x20000] != 32
    rnd = random.Random(5)
    rows = [(i, " ".join("".join(chr(rnd.randrange(*span)) for _ in range(5)) for _ in range(20)), name)
            for i in range(60) for name, span in (((("adlam", (0x1E922, 0x1E944))), ("osage", (0x104D8, 0x104FC)))[i % 2],)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.learn(docs)).collect()}
    assert made == {i: x for i, _, x in rows}


def test_language_model_keeps_every_gram(spark):
    rnd = random.Random(29)
    rows = [("x" if i % 2 else "y", " ".join(chr(rnd.randrange(0x4E00, 0x9FA0)) * rnd.randint(1, 2) + chr(rnd.randrange(0x4E00, 0x9FA0))
                                             for _ in range(14_000))) for i in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("monotonically_increasing_id() as doc_id", "*").repartition(4)
    counts = langid.count_grams(docs.select("lang", "text"))
    assert counts.count() > 1_000_000
    model = langid.learn(docs)
    assert len(model.keys[3]) == counts.select("gram").distinct().count()


def test_a_rare_language_has_limits_too(spark):
    rows = [("x", "x", 1.0 + 0.001 * (i % 7), 400.0) for i in range(2000)] + [("y", "y", 1.1, 400.0)] * 3 + [("x", "x", 9.0, 400.0)]
    limits = langid.rejection_limits(spark.createDataFrame(rows, "lang string, best string, h double, n double"), ["x", "y", "z"])
    assert np.isfinite(limits).all() and (limits[1:, 8] < 3).all()
    assert limits[0, 8] < 9  # one junk row does not set the limit


def test_language_odd_rows(odd, odd_rows, none):
    model = langid.learn(odd)
    rows = langid.predict(odd, model).collect()
    assert len(rows) == len(odd_rows) and {r["lang_pred"] for r in rows} <= {"en", "fr", "und"}
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in rows)
    assert langid.learn(none) is None and langid.predict(none, None).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}


# ---- mixing

def test_repeated_rows_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", 7) for i in range(9)], "doc_id long, text string, source string, copy int")
    rows = mixing.repeated(mixing.mix(docs))
    assert rows.count() == 9 and {r["copy"] for r in rows.collect()} == {7}


def test_mix_meets_targets(odd, odd_rows, none):
    rows = mixing.mix(odd).collect()
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += len(brute.words(r[1]))
    want, taken = brute.targets(sizes), Counter()
    for r in rows:
        assert r["size"] == len(brute.words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(rows) == len(odd_rows) and all(abs(taken[s] - want[s]) <= 5 for s in sizes)
    assert tuples(mixing.mix(odd.repartition(3))) == tuples(mixing.mix(odd))
    assert mixing.mix(none).count() == 0 and mixing.repeated(mixing.mix(none)).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 100}, {"a": 1, "b": 1000, "c": 5}, {"a": 0, "b": 7}, {"a": 0}, {None: 9, "b": 300, "c": 2, "d": 40}])
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = brute.targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_repeated_rows_follow_the_mix(odd):
    mixed = mixing.mix(odd)
    want = Counter()
    for r in mixed.collect():
        want[r["doc_id"]] += int(r["taken"] / r["size"] + 0.5) if r["size"] else 1
    got = Counter(r["doc_id"] for r in mixing.repeated(mixed).collect())
    assert got == Counter({k: v for k, v in want.items() if v})


# ---- token counts

def test_automaton_against_greedy_matching():
    rnd = random.Random(2)
    for _ in range(60):
        vocabulary = {bytes(rnd.choices(b"abc", k=rnd.randint(1, 5))) for _ in range(rnd.randint(1, 12))}
        automaton = wordpiece.Automaton(sorted(vocabulary))
        for _ in range(60):
            word = bytes(rnd.choices(b"abc", k=rnd.randint(0, 12)))
            assert automaton.count(word) == brute.greedy(word, vocabulary), (word, vocabulary)


def test_token_counts_odd_rows(odd, odd_rows, none):
    rows = wordpiece.token_counts(odd, BYTES).collect()
    vocabulary = set(wordpiece.byte_vocabulary(BYTES))
    want = Counter((r[0], len(brute.words(r[1])), sum(brute.greedy(b" " + w.encode(), vocabulary) for w in brute.words(r[1])), 0)
                   for r in odd_rows)
    assert Counter((r["doc_id"], r["n_words"], r["n_tokens"], r["n_unknown"]) for r in rows) == want
    assert wordpiece.token_counts(none, BYTES).count() == 0


# ---- token files

def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, odd, odd_rows, none, tmp_path):
    folder = str(tmp_path / "tokens")
    manifest = tokenfile.write_files(odd, folder, BYTES)
    rows = tokenfile.read_files(manifest).collect()
    want = Counter((r[0], tuple(ids_of(BYTES, r[1]))) for r in odd_rows)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == want
    rows.sort(key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in rows)
    some = tokenfile.read_documents(manifest, [305, 5, 99999]).collect()
    assert sorted(r["doc_id"] for r in some) == [5, 305]
    assert tokenfile.read_files(tokenfile.write_files(none, str(tmp_path / "none"), BYTES)).count() == 0


def test_a_reader_decompresses_only_what_is_asked_and_sees_damage(tmp_path):
    import pyarrow.fs as fs
    import zstandard

    path, ids = str(tmp_path / "one.tok"), [np.arange(i, i + 30_000, dtype="<u4") % 60_000 for i in range(12)]
    local = fs.LocalFileSystem()
    with local.open_output_stream(path) as out:
        writer = tokenfile.Writer(out)
        for i, x in enumerate(ids):
            writer.add(i * 10, x.tobytes())
        writer.close()
    with local.open_input_file(path) as file:
        reader, read = tokenfile.Reader(file), []
        plain, reader.frame_bytes = reader.frame_bytes, lambda k: read.append(k) or plain(k)
        assert [d.ids.tolist() for d in reader.read(reader.find(70))] == [ids[7].tolist()] and len(read) == 1
        assert [d.doc_id for d in reader.read()] == [10 * i for i in range(12)]
    raw = bytearray((tmp_path / "one.tok").read_bytes())
    frames = zstandard.ZstdDecompressor().stream_reader(bytes(raw), read_across_frames=True).read()
    assert frames == b"".join(x.astype("<u2").tobytes() for x in ids)
    raw[reader.starts[1] + 200] ^= 255
    (tmp_path / "one.tok").write_bytes(raw)
    with local.open_input_file(path) as file:
        with pytest.raises(Exception):
            list(tokenfile.Reader(file).read())


TEXTS = ["a  b\n\n c", " lead", "trail \n", "don't  STOP", "x\u3000y", "a\x1cb\x1d c", "\u0301a e\u0301", "\n", "３ ½", "İstanbul ς Σ", "Été, ça! ÿ× ÷.",
         "a <|endoftext|> b", "a<|startoftext|> b <|ENDOFTEXT|>", "we'll 'tis l'été\u0301.", "\u201cquoted\u201d, \u00ab x \u00bb!", "tab\t.\r\n x\x00y \x00",
         "word" * 100 + " " + "!" * 300, "a\u00a0.b \u2009c", "é.\u0338=\u0338", "日本語 text。x", "Ǆungla ﬁ"]


@pytest.mark.parametrize("ordinary", [False, True])
@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunks_give_the_ids_of_the_whole(path, ordinary):
    from wirelake.llm.encoding import Encoder

    rnd = random.Random(4)
    pieces = [c for t in TEXTS for c in t] + [" ", " ", "\n", "the", " of", "'s", "É", "<|endoftext|>", "<|"]
    texts = TEXTS + [None, ""] + ["".join(rnd.choices(pieces, k=rnd.randint(1, 60))) for _ in range(1500)]
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = ordinary
    model = Encoder(path, ordinary, remembered=50)
    for begin in range(0, len(texts), 400):
        got = model.encode(pa.array(["x"] + texts[begin:begin + 400], pa.string()).slice(1))
        for text, ids in zip(texts[begin:begin + 400], got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


# ---- quality rules

def test_ledger_against_brute_force(odd, odd_rows, none):
    rows = quality.ledger(odd).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        text = r["text"] or ""
        ws, lines = brute.words(text), [x for x in text.split("\n") if brute.words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), brute.repeat_words(text))
        assert bool(r["failed_rules"] & 3) == (len(ws) < 20 or 100 * r["n_repeat_words"] > 30 * len(ws))
    assert quality.ledger(none).count() == 0


def test_repeats_against_brute_force():
    rnd = random.Random(4)
    for _ in range(300):
        text = " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40)))
        assert quality.repeat_words(text.encode().split()) == brute.repeat_words(text)


def test_ablation(odd):
    rows = quality.ledger(odd).persist()
    bits = [r["failed_rules"] for r in rows.collect()]
    at = {r.name: i for i, r in enumerate(quality.RULES)}
    mask = quality.BASE.mask()
    for r in quality.ablation(rows, quality.BASE).collect():
        bit = 1 << at[r["rule"]]
        assert r["failed"] == sum(bool(b & bit) for b in bits)
        assert r["failed_alone"] == sum(b & mask == bit for b in bits)
        assert r["kept_without"] == sum(b & mask & ~bit == 0 for b in bits)
    rows.unpersist()


# ---- top-k

@pytest.mark.parametrize("n,dims,k", [(300, 5, 20), (9, 3, 20), (200, 40, 4)])
def test_top_k_against_brute_force(spark, monkeypatch, n, dims, k):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "CHUNK_BLOCKS", 2)
    rnd = random.Random(n)
    rows = [(i, [float(rnd.choice([-1, -.5, 0, .25, 1.5]) * (i % 9)) for _ in range(dims)]) for i in range(n)]
    rows += [(1000, None), (1020, [None] * dims), (1040, [float("nan")] * dims), (1060, [float("inf")] + [0.0] * (dims - 1)), (None, [1.0] * dims),
             (1080, []), (1100, [2.0]), (3, [1.0] * dims)]
    got = topk.top_k(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string"), k, 20)
    assert sorted(map(tuple, got.collect())) == brute.top_k(rows, k, 20)


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert topk.top_k(spark.createDataFrame([(1, [1.0]), (2, [1.0])], "vec_id long, embedding array<float>")).count() == 0


# ---- packing

def test_piece_lengths():
    assert packing.piece_lengths(2 * 4096 + 5) == [4096, 4096, 4, 1] and packing.piece_lengths(0) == []
    for n in range(1, 9000, 37):
        got = packing.piece_lengths(n)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 4096 for x in got)


def test_pieces_make_up_documents(odd, odd_rows, none):
    rows = packing.pack(odd, WORDS, longest=64).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    docs, own = defaultdict(list), []
    for r in sorted(rows, key=lambda r: r["sequence_id"]):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] == 1 << r["bucket"] <= 64 and crc(ids) == r["ids_crc32"] and r["offset"] == 0
        if r["start"] == 0:
            own.append((r["doc_id"], []))
        assert len(own[-1][1]) == r["start"]
        own[-1][1].extend(ids)
    assert Counter((i, tuple(x)) for i, x in own) == Counter((r[0], tuple(ids_of(WORDS, r[1]))) for r in odd_rows)
    assert packing.pack(none, WORDS).count() == 0
