"""The registered queries on whole small tables against plain Python versions."""

import glob
import math
import os
import zlib

import pytest

from hopflux.llm import language_model, packing, sharding, toxicity
from hopflux.llm.queries import QUERIES, tokenizer_path
from tests.llm import brute

SF = os.environ.get("HOPFLUX_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not glob.glob(f"{SF}/documents.parquet"), reason="no test tables")


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*c).collect()]
    return {"documents": read("documents", "doc_id", "text"), "benchmark": read("benchmark", "item_id", "text"), "labels": read("labels", "doc_id", "toxic")}


def run(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


def test_near_dedup(spark, tables):
    rows = run(spark, "op1_minhash_near_dedup")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got == brute.near_duplicates(tables["documents"])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_packing(spark, tables):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = run(spark, "op2_packing")
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for i, text in tables["documents"]:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        start = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == start and r["offset"] == 0 and r["doc_tokens"] == len(ids)
            assert r["length"] == 1 << r["bucket"] <= 2048
            part = ids[start : start + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            start += r["length"]
        assert start == len(ids)


@pytest.mark.parametrize("text", ["", " ", "a b　c", "it's WE'LL 12345\r\n\t x", "<|endoftext|>", "a <|endoftext|>  b<|endoftext|><|endoftext|>c <|endoftext", "\U0001f600é‍中文 9²", "\x00\x7f" * 3])
def test_fast_tokenizer_gives_the_same_ids(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    assert list(packing.encoder(tokenizer_path())(text)) == tok.encode(text, add_special_tokens=False).ids
    tok.encode_special_tokens = True
    assert list(packing.encoder(tokenizer_path(), plain_text=True)(text)) == tok.encode(text, add_special_tokens=False).ids


def test_licenses(spark, tables):
    got = {r["doc_id"]: r for r in run(spark, "op3_license_scan")}
    for i, text in tables["documents"]:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licenses(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_line_dedup_leaves_no_long_repeat(spark, tables):
    from hopflux.llm.line_dedup import dedup_lines

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = sorted(tables["documents"])
    after = sorted((r.doc_id, r.text) for r in dedup_lines(docs).collect())
    assert brute.repeated_left(before, 40) and not brute.repeated_left(after, 40)
    words = lambda rows: {x for _, t in rows for x in t.split()}
    assert words(before) == words(after)  # what goes still stands elsewhere
    changed = {i for (i, a), (_, b) in zip(before, after) if a != b}
    assert changed <= brute.repeated_left(before, 30, overlap=True)


def test_line_dedup_query(spark, tables):
    """The query's spans are cut from the texts as they stand, and its counts and checksums are those of what is left."""
    from hopflux.llm.line_dedup import without

    texts = dict(tables["documents"])
    rows = run(spark, "op4_line_dedup")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and any(r["cut_words"] for r in rows)
    for r in rows:
        spans = [tuple(map(int, x.split("-"))) for x in r["cut_spans"].split(",") if x]
        data = (texts[r["doc_id"]] or "").encode()
        assert all(a < b for a, b in spans) and all(b < c for (_, b), (c, _) in zip(spans, spans[1:])) and r["cut_words"] == sum(b - a for a, b in spans)
        words = brute.plain_words(texts[r["doc_id"]])
        left = [w for i, w in enumerate(words) if not any(a <= i < b for a, b in spans)]
        kept = without(data, spans) if spans else data
        assert brute.plain_words(kept.decode()) == left and zlib.crc32(kept) == r["kept_crc32"]


def test_toxicity(spark, tables):
    rows = run(spark, "op5_toxicity")
    assert len(rows) == len(tables["documents"])
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)


def test_toxicity_scores_are_those_of_the_formula(spark, tables):
    """Every score from weights and factors by the sum over pairs, term by term."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    place = {int(s): i for i, s in enumerate(model.slots)}
    for i, text in tables["documents"]:
        at = sorted({place[s] for s in toxicity._terms((text or "").encode(), model.bits).tolist() if s in place})
        z = model.bias + sum(model.weights[a] for a in at) + sum(float(model.factors[a] @ model.factors[b]) for n, a in enumerate(at) for b in at[n + 1 :])
        assert math.isclose(got[i], 1 / (1 + math.exp(-max(-500, min(500, z)))), rel_tol=1e-6, abs_tol=1e-12)


def test_toxicity_ranks_held_out_rows(spark):
    big = "/root/testdata/sf0.1"
    if not glob.glob(f"{big}/labels.parquet"):
        pytest.skip("no larger tables")
    rows = QUERIES["op5_toxicity"](spark, big).join(spark.read.parquet(f"{big}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert auc > 0.9 and sum(r.predicted for r in rows if r.toxic) >= 0.9 * len(pos) and sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(neg)


def test_fingerprints(spark, tables):
    want = brute.edits(tables["documents"])
    rows = run(spark, "op6_document_fingerprints")
    assert len(rows) == len(want)
    prints = {}
    for r in rows:
        n, sha, edited, after = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert math.isclose(r["near_edited"], edited) and math.isclose(r["near_next"], after)
        prints[r["doc_id"]] = r["fingerprint"]
    texts = {}
    for i, t in tables["documents"]:
        texts.setdefault(t, set()).add(prints[i])
    assert all(len(x) == 1 for x in texts.values())


def test_sharding(spark, tables):
    rows = run(spark, "op7_sharding")
    texts = dict(tables["documents"])
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots = {}
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key") and 0 <= r["shard"] < 8
        assert r["grown_shard"] in (r["shard"], 8)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_decontamination(spark, tables):
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in run(spark, "op9_benchmark_decontamination")}
    want = brute.contamination(tables["documents"], tables["benchmark"])
    assert got == want and any(x[-1] for x in want.values())


def test_language_model(spark, tables):
    got = {r["doc_id"]: r for r in run(spark, "op10_lm_scoring")}
    base, score = brute.base_scores(tables["documents"]), brute.automaton_scores(tables["documents"], language_model.CONTEXTS)
    assert len(got) == len(base)
    for i, want in base.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:4]
        assert math.isclose(r["base_score"], want[4], rel_tol=1e-9) and math.isclose(r["score"], score[i], rel_tol=1e-9)


def test_rendezvous_moves_little(spark):
    keys = spark.range(4000).selectExpr("cast(id as string) as k")
    from pyspark.sql import functions as F

    rows = keys.select(sharding.rendezvous(F.col("k"), {0: 1.0, 1: 3.0}).alias("a"), sharding.rendezvous(F.col("k"), {0: 1.0, 1: 3.0, 2: 1.0}).alias("b")).collect()
    assert all(r.b in (r.a, 2) for r in rows)
    assert 0.7 < sum(r.a for r in rows) / len(rows) < 0.8 and 0.15 < sum(r.b == 2 for r in rows) / len(rows) < 0.25
