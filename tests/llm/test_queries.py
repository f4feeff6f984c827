"""The registered queries over the smallest tables: contract columns, oracles, and the pipeline stage by stage."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.oracle_check import compare, connect
from wirelake.llm import alignment
from wirelake.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op2_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op3_simhash": {"doc_id", "fingerprint", "component_id"},
    "op4_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op5_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op6_token_counts": {"doc_id", "n_words", "n_tokens"},
    "op7_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op8_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op9_exact_top_k": {"query_id", "rank", "vec_id", "score"},
    "op10_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op11_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op12_fill_in_middle": {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"},
    "op13_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
}


@pytest.fixture(scope="module")
def documents(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet").collect()


@pytest.mark.parametrize("name", [n for n in COLUMNS if n not in ORACLES])
def test_contract(spark, small_dir, documents, name):
    rows = QUERIES[name](spark, small_dir)
    assert COLUMNS[name] <= set(rows.columns)
    assert {r["doc_id"] for r in rows.select("doc_id").collect()} == {r["doc_id"] for r in documents}


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, small_dir, name):
    ok, message, n, _ = compare(spark, connect(small_dir), small_dir, QUERIES[name], ORACLES[name])
    assert ok and n and COLUMNS[name] <= set(QUERIES[name](spark, small_dir).columns), message


def ids_of(path, text):
    model = Tokenizer.from_file(public_tokenizers.path(path))
    return [np.array(x.ids + [2], "<u4").tobytes() for x in model.encode_batch([t or "" for t in text], add_special_tokens=False)]


def test_shards(spark, small_dir, documents):
    rows = QUERIES["op1_sharding"](spark, small_dir).collect()
    text = lambda r: (r["text"] or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r["doc_id"], len(text(r)) + 8, zlib.crc32(text(r))) for r in documents)
    slots, load = defaultdict(list), Counter()
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean, largest = sum(load.values()) / 24, max(r["size"] for r in rows)
    assert max(load.values()) <= mean * 1.0006 + largest


def test_mixed_sizes_and_targets(spark, small_dir, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op5_mixing"](spark, small_dir).collect()}
    size = {r["doc_id"]: len(brute.words(r["text"])) for r in documents}
    whole = Counter()
    for r in documents:
        whole[r["source"]] += size[r["doc_id"]]
    want, taken = brute.targets(whole), Counter()
    for r in documents:
        got = rows[r["doc_id"]]
        assert (got["size"], got["source_size"]) == (size[r["doc_id"]], whole[r["source"]]) and abs(got["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= got["taken"] <= 3 * got["size"]
        taken[r["source"]] += got["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in whole)


def test_token_counts(spark, small_dir, documents):
    from wirelake.llm import wordpiece

    vocabulary = set(wordpiece.byte_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    rows = {r["doc_id"]: r for r in QUERIES["op6_token_counts"](spark, small_dir).collect()}
    for r in documents[:60]:
        ws = brute.words(r["text"])
        assert (rows[r["doc_id"]]["n_words"], rows[r["doc_id"]]["n_tokens"]) == (len(ws), sum(brute.greedy(b" " + w.encode(), vocabulary) for w in ws))


def test_token_files_of_the_plain_library(spark, small_dir, documents):
    rows = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op7_token_files"](spark, small_dir).collect()}
    start = 0
    docs = sorted(documents, key=lambda r: r["doc_id"])
    for r, ids in zip(docs, ids_of("byte_bpe_50k.json", [r["text"] for r in docs])):
        assert rows[r["doc_id"]] == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_packed_pieces_of_the_plain_library(spark, small_dir, documents):
    pieces, sequences = defaultdict(list), Counter()
    for r in QUERIES["op10_packing"](spark, small_dir).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]] += 1
        assert r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096
    assert set(sequences.values()) == {1}
    for r, ids in zip(documents, ids_of("word_bpe_49k.json", [r["text"] for r in documents])):
        at = 0
        for start, length, crc, total in sorted(pieces[r["doc_id"]]):
            assert (start, total, crc) == (at, len(ids) // 4, zlib.crc32(ids[4 * at:4 * (at + length)]))
            at += length
        assert at == len(ids) // 4


def test_alignment(spark, small_dir, documents):
    from tests.llm import test_alignment

    a, b = Tokenizer.from_file(test_alignment.A), sentencepiece.SentencePieceProcessor(model_file=test_alignment.B)
    a.encode_special_tokens = True
    models = a, b, alignment.bytes_of_a(test_alignment.A), alignment.bytes_of_b(b)
    want, _ = test_alignment.brute(models, [r["text"] for r in documents])
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_alignment"](spark, small_dir).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(documents, want)}


def test_toxicity_of_held_out_rows(spark, small_dir, documents):
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect() if r["toxic"] is not None}
    rows = QUERIES["op2_toxicity"](spark, small_dir).collect()
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    kept = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) == 0]
    assert kept and sum(r["predicted"] for r in kept) <= 0.02 * len(kept)


def test_simhash_components(spark, small_dir, documents):
    prints = [(r["doc_id"], brute.fingerprint(r["text"], 3)) for r in documents]
    want = {i: (f"{f:016x}", c) for (i, f), c in zip(prints, brute.component_ids(prints, 2))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash"](spark, small_dir).collect()}
    assert got == want


@pytest.mark.parametrize("name,modulus,rest", [("op2_toxicity", 3, 1), ("op4_language_id", 5, 0)])
def test_held_out_rows(spark, small_dir, name, modulus, rest):
    for r in QUERIES[name](spark, small_dir).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) and 0 <= r["score"] <= 1


def test_language_accuracy(spark, small_dir, documents):
    truth = {r["doc_id"]: r["lang"] for r in documents}
    rows = [r for r in QUERIES["op4_language_id"](spark, small_dir).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_sharding_is_native(spark, small_dir):
    plan = QUERIES["op1_sharding"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop") if x in plan]


ODD = "doc_id long, text string, lang string, source string, n_chars long, toxic string, key string"


def test_pipeline_stages(spark, tmp_path):
    """Odd rows through all stages: toxic, foreign and duplicate texts go, the rest stays and is packed whole."""
    rnd = random.Random(9)
    syllables = {"en": ["the", "an", "ing", "sh", "er", "on"], "fr": ["eau", "que", "la", "ment", "oi", "tion"]}
    text = lambda x, n: " ".join("".join(rnd.choices(syllables[x], k=2)) for _ in range(n))
    rows, labels = [], []
    for i in range(500):
        x = "en" if i % 3 else "fr"
        bad = i % 5 == 0
        rows.append((i, text(x, 30) + (" scumbag" if bad else ""), x, f"s{i % 4}", 1, "old", "old"))
        labels.append((i, int(bad), 1))
    rows += [(600 + i, rows[1][1], "en", "s1", 1, None, None) for i in range(20)]
    rows += [(700, None, None, None, None, None, None), (701, "", "en", "s1", 0, None, None), (702, "zxqj kkwv zzqx " * 30, None, "s2", 5, None, None),
             (None, text("en", 30), "en", None, None, None, None)]
    docs = spark.createDataFrame(rows, ODD)
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    given, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, given, str(tmp_path))
        made.write.parquet(str(tmp_path / name))
        given = spark.read.parquet(str(tmp_path / name))
        seen[name] = given
        if name != "packing":
            assert given.columns == docs.columns
    ids = lambda name: {r["doc_id"] for r in seen[name].select("doc_id").collect()}
    assert ids("toxicity") == {r[0] for r in rows if "scumbag" not in (r[1] or "")}
    assert ids("toxicity") - ids("language_id") == {700, 701, 702}
    assert ids("language_id") - ids("near_duplicates") == set(range(600, 620))
    assert ids("mixing") <= ids("near_duplicates") and ids("packing") == ids("mixing")
    words = Counter(r["source"] for r in seen["near_duplicates"].collect() for _ in brute.words(r["text"]))
    want, got = brute.targets(words), Counter(r["source"] for r in seen["mixing"].collect() for _ in brute.words(r["text"]))
    assert all(abs(got[s] - want[s]) <= 31 for s in words)
    assert seen["packing"].agg(F.sum("length")).head()[0] == sum(
        r["n"] for r in seen["packing"].where("start = 0").select(F.col("doc_tokens").alias("n")).collect())


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], ODD).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
