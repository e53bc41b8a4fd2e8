"""The pipeline, stage by stage, against brute force."""

from __future__ import annotations

from collections import Counter

import pytest
from llm import brute

import corpus_pipeline as pipeline

SMALL_SF = "/root/testdata/sf0.001"


def table(df):
    return [tuple(r) for r in df.collect()]


def test_stages_in_order(spark, small):
    docs = small("documents")
    benchmark = [tuple(r) for r in small("benchmark").select("item_id", "text").collect()]
    names = docs.columns
    at = {n: names.index(n) for n in names}
    before = table(docs)

    good = pipeline.STAGES[0][1](spark, docs, SMALL_SF)
    assert good.columns == names
    kept = table(good)
    assert set(kept) <= set(before)
    labels = {r["doc_id"]: r["quality"] for r in small("labels").collect()}
    judged = [(labels[r[at["doc_id"]]], r in kept) for r in before if r[at["doc_id"]] in labels]
    assert sum(bool(q) == k for q, k in judged) >= 0.97 * len(judged)

    single = pipeline.STAGES[1][1](spark, good, SMALL_SF)
    groups = brute.join([(r[at["doc_id"]], r[at["text"]]) for r in kept], 5, 8, 10)
    want = {d for d, n, c in groups if n == 0 or d == c}
    assert single.columns == names and sorted(r[at["doc_id"]] for r in table(single)) == sorted(want)
    kept = table(single)

    clean = pipeline.STAGES[2][1](spark, single, SMALL_SF)
    judged = brute.contamination([(r[at["doc_id"]], r[at["text"]]) for r in kept], benchmark)
    assert clean.columns == names
    assert sorted(r[at["doc_id"]] for r in table(clean)) == sorted(r[0] for r in judged if not r[-1])
    kept = table(clean)

    mixed = pipeline.STAGES[3][1](spark, clean, SMALL_SF)
    copies = Counter(table(mixed))
    assert mixed.columns == names and set(copies) <= set(kept) and max(copies.values()) <= 2
    words = sum(len(brute.words(r[at["text"]])) * n for r, n in copies.items())
    assert words == pytest.approx(1.5 * sum(len(brute.words(r[at["text"]])) for r in kept), rel=0.05)

    sharded = pipeline.STAGES[4][1](spark, mixed, SMALL_SF).collect()
    assert Counter(tuple(r[n] for n in names) for r in sharded) == copies
    assert sorted((r["slot"] * 8 + r["shard"]) for r in sharded) == list(range(len(sharded)))


def test_run_repeats(spark):
    first, again = (sorted(table(pipeline.run(spark, SMALL_SF)), key=repr) for _ in range(2))
    assert first == again and first


@pytest.mark.parametrize("name,function", pipeline.STAGES)
def test_odd_and_empty_tables(spark, odd_documents, no_documents, name, function):
    assert function(spark, no_documents, SMALL_SF).count() == 0
    out = function(spark, odd_documents, SMALL_SF)
    assert set(odd_documents.columns) <= set(out.columns)
    out.collect()


def test_one_of_each_group_of_odd_rows(spark, odd_documents):
    got = pipeline.keep_one_of_each_group(spark, odd_documents, SMALL_SF).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    groups = brute.join(rows, 5, 8, 10)
    wordless = Counter((d, t) for d, t in rows if not brute.words(t))
    assert Counter((r["doc_id"], r["text"]) for r in got if not brute.words(r["text"])) == wordless
    # A component whose smallest doc_id lies in several rows keeps one of them.
    components = {c for _, n, c in groups if n}
    assert sorted(r["doc_id"] for r in got if brute.words(r["text"])) == sorted(components)


#: Names that operators use for their own columns.
CLASHES = ("_text", "_words", "_lines", "_chars", "_n", "_score", "_stats", "_hash", "_range", "_step", "_at", "_first", "_place",
           "_copies", "_offset", "_total", "_row", "_rows", "_salt", "row_key", "row_number", "shard", "slot", "total_rows", "hit")


@pytest.mark.parametrize("name,function", pipeline.STAGES)
def test_columns_of_any_name(spark, odd_documents, name, function):
    """Every stage keeps other columns; sharding replaces the three it makes."""
    plain = function(spark, odd_documents, SMALL_SF)
    docs = odd_documents.selectExpr("*", *[f"u as `{c}`" for c in CLASHES])
    out = function(spark, docs, SMALL_SF)
    made = ("row_number", "shard", "slot") if name == "sharding" else ()
    kept = [c for c in CLASHES if c not in made]
    assert sorted(out.columns) == sorted([*odd_documents.columns, *CLASHES])
    got = out.collect()
    assert all(r[c] == r["u"] for r in got for c in kept)
    names = odd_documents.columns
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(tuple(r[n] for n in names) for r in plain.collect())
