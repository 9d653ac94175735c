import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from filecensus.llm import decontaminate, quality
from filecensus.llm.shared import documents
from tests.llm import brute

SF = "/root/testdata/sf0.001"
CONTRACTS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op3_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op4_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op6_decontamination": ["doc_id", "item_id"],
    "op7_token_counts": ["doc_id", "n_words", "n_tokens"],
    "op8_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op9_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op10_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
}


def table(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'")


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract_columns_and_rows(spark, name):
    found = contract.queries()[name](spark, SF)
    assert [c for c in found.columns if c in CONTRACTS[name]] == CONTRACTS[name]
    if name != "op6_decontamination":
        assert found.count() == len(table("documents").project("doc_id").fetchall())


def test_mix_matches_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duck.sql(contract.oracle_sql()["op9_mixing"])
    names = want.columns
    got = contract.queries()["op9_mixing"](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_digests(spark):
    docs = table("documents").project("doc_id, text").fetchall()
    found = {r.doc_id: r for r in contract.queries()["op2_secret_scan"](spark, SF).collect()}
    for i, t in docs:
        spans = brute.secret_spans(t)
        assert found[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(found[i].spans.split(","))
    want = dict(zip([i for i, _ in docs], brute.repeated(docs, 200), strict=True))
    got = {r.doc_id: tuple(r)[1:] for r in contract.queries()["op10_suffix_array_dedup"](spark, SF).collect()}
    assert got == want


def test_pipeline_against_brute_force(spark):
    rows = {r[0]: r for r in table("documents").fetchall()}
    kept = {r.doc_id for r in quality.assess(documents(spark, SF)).where("kept").collect()}
    good = [(i, rows[i][1]) for i in sorted(kept)]
    first = {c for _, c in brute.jaccard_components(good)}
    clean = documents(spark, SF).where("doc_id IN (" + ",".join(map(str, first)) + ")")
    leaked = {r.doc_id for r in decontaminate.leaks(clean, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in found} == first - leaked and len(found) == len(first - leaked)
    targets, sizes = brute.mixed([(r.source, r["size"]) for r in found])
    for r in found:
        assert not brute.secret_spans(r.text.replace("[SECRET]", " "))
        assert r["size"] == len(brute.words(r.text)) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, targets[r.source])
    for source in sizes:
        assert abs(sum(r.taken for r in found if r.source == source) - targets[source]) <= 1


def test_stages_keep_the_columns(spark):
    docs = documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
