"""The corpus builder: what isn't borne out by a source is no item; digests, settings and views of items."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tideline.sources import corpus
from tideline.sources.records import Rejected

SEEDS = [
    (1, "s1", "Sleep", "Adults sleep.", "sleep", ["Adults  SLEEP seven", "hours"]), (2, "s1", "Steps", "Walk more.", "steps", ["walk"]), (3, "s2", "Rest", "Take a rest.", "sleep", ["rest"]),
    (4, "none", "Lost", "No source.", "sleep", ["x"]), (5, "s1", "sleep", " adults  sleep.", "steps", []), (6, "s1", "Two", "Another.", "steps", None),
]
SOURCES = [("s1", "fetched", "https://one", "One", "All adults sleep seven\nhours a night."), ("s2", "unavailable", "https://two", "Two", None)]


@pytest.fixture(scope="module")
def tables(spark):
    return (
        spark.createDataFrame(SEEDS, "place int, source_key string, title string, content string, domain string, anchors array<string>"),
        spark.createDataFrame(SOURCES, "source_key string, status string, source_url string, publisher string, text string"),
    )


def test_items_are_borne_out(spark, tables):
    quotas = spark.createDataFrame([("sleep", 3), ("steps", 2), ("other", 1)], "domain string, n long")
    found = {(r["rule"], r["key"]) for r in corpus.violations(*tables, quotas).collect()}
    assert found == {("anchor", "2"), ("anchor", "5"), ("anchor", "6"), ("source", "3"), ("source", "4"), ("quota", "steps"), ("quota", "other")}
    items = {r["id"]: r.asDict() for r in corpus.items(*tables).collect()}
    assert list(items) == ["K001"] and items["K001"]["source_locator"] == "text anchors: Adults  SLEEP seven | hours"
    digest = items["K001"].pop("item_sha256")
    assert digest == hashlib.sha256(json.dumps(items["K001"], sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def test_contexts_surround_anchors(spark, tables):
    got = {(r["place"], r["anchor"]): r["context"] for r in corpus.review_contexts(*tables, before=4, after=9).collect()}
    assert got == {(1, "Adults  SLEEP seven"): None, (1, "hours"): "ven hours a n"}


def test_a_run_names_its_corpus(spark, tables):
    items = corpus.items(*tables)
    digest = corpus.corpus_digest(items)
    assert digest == corpus.corpus_digest(items.repartition(3)) != corpus.corpus_digest(items.limit(0))
    manifest = spark.createDataFrame([(digest,)], "corpus_sha256 string")
    corpus.same_corpus(items, manifest)
    with pytest.raises(Rejected, match="corpus"):
        corpus.same_corpus(items.limit(0), manifest)


def test_settings_are_frozen():
    assert corpus.settings({})["top_k"] == 20 and corpus.settings({"query_max_tokens": 9})["query_max_tokens"] == 9
    for bad in ({"top_k": 10}, {"rrf_k": 1}, {"indexed_fields": ["title"]}, {"bm25": {"k1": 0, "b": 0.5}}, {"bm25": {"k1": 1, "b": 1.5}}):
        with pytest.raises(Rejected):
            corpus.settings(bad)


def test_views_show_allowed_fields_only(spark):
    audits = spark.createDataFrame([("K1", "SUPPORTED", False, [("c1", "text", "secret")], None, "hidden")], "id string, core_claim_support string, source_scope_disputed boolean, conditions array<struct<condition_id: string, original_text: string, note: string>>, validation_errors array<string>, label string")
    knowledge = spark.createDataFrame([("K1", "Title", "draft")], "id string, title string, status string")
    row = corpus.claim_view(audits, knowledge, "id", ["title"], F.col("conditions"), ["condition_id", "original_text"]).first().asDict(True)
    assert row == {"id": "K1", "title": "Title", "core_claim_support": "SUPPORTED", "source_scope_disputed": False, "conditions": [{"condition_id": "c1", "original_text": "text"}], "validation_errors": []}
