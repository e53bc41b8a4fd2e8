"""Operators that give a value a row: against brute force, SQL or held-out labels."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from llm import brute
from pyspark.sql import functions as F

from worklens.llm import boilerplate, language_model, mixing, quality, sharding, token_counts, vector_search
from worklens.llm.rows import number_rows

SMALL_SF = "/root/testdata/sf0.001"
MIDDLE_SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def columns(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


@pytest.fixture(params=["odd", "small", "none"])
def documents(request, odd_documents, no_documents, small):
    return {"odd": odd_documents, "none": no_documents, "small": small("documents")}[request.param]


# Quality.

def test_quality_on_held_out_labels(spark):
    scored = quality.op1_quality(spark, MIDDLE_SF).join(spark.read.parquet(f"{MIDDLE_SF}/labels.parquet"), "doc_id")
    held = scored.filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert held > 0.97


def test_quality_learns_only_outside_the_held_out_fold(spark, small):
    documents, labels = small("documents"), small("labels")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(documents, labels) == quality.fit(documents, flipped)


def test_quality_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(0, 101)] + [(None, 1, 0), (3, None, 0), (4, 7, 0)],
                                   "doc_id long, quality int, toxic int")
    none = labels.filter("false")
    report = quality.quality_report(odd_documents, labels).collect()
    assert len(report) == odd_documents.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in report)
    assert {r["score"] for r in quality.quality_report(odd_documents, none).collect()} == {0.5}
    assert quality.quality_report(no_documents, labels).count() == 0
    one_class = quality.quality_report(odd_documents, labels.filter("quality = 1")).collect()
    assert {r["predicted"] for r in one_class} == {1}


def test_quality_rules_are_the_paths_of_the_trees():
    printed = """RandomForestClassificationModel: uid=x, numTrees=2
  Tree 0 (weight 1.0):
    If (feature 0 <= 1.5)
     If (feature 1 <= -2.0E-5)
      Predict: 1.0
     Else (feature 1 > -2.0E-5)
      Predict: 0.0
    Else (feature 0 > 1.5)
     Predict: 0.0
  Tree 1 (weight 1.0):
    Predict: 1.0"""
    a, b = ("words", False, 1.5), ("words", True, 1.5)
    assert quality.tree_paths(printed, ["words", "upper"]) == {
        (a,), (b,), (("upper", False, -2e-5), a), (("upper", True, -2e-5), a)}
    assert quality.Rule((("upper", True, -2e-5), a)).holds() == "_stats.upper > -2e-05D AND _stats.words <= 1.5D"


# Sharding.

def test_permutation_and_its_inverse():
    for n in (1, 2, 3, 7, 8, 1000, 4097):
        x = sharding.permute(np.arange(n), n)
        assert sorted(x.tolist()) == list(range(n))
        assert sharding.permute(x, n, back=True).tolist() == list(range(n))
    assert sharding.permute(np.arange(100), 100, seed=1).tolist() != sharding.permute(np.arange(100), 100, seed=2).tolist()


def test_sharding(documents):
    got = sharding.shard_report(documents).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()))
                   for r in documents.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert sharding.row_at(r["shard"], r["slot"], len(got)) == r["row_number"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(8))


def test_sharding_does_not_depend_on_the_layout(odd_documents):
    assert rows(sharding.shard_report(odd_documents)) == rows(sharding.shard_report(odd_documents.repartition(7, "text")))


def test_row_numbers_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a")] * 25_000 + [(2, None)], "x int, y string")
    got = number_rows(df).collect()
    assert sorted(r["row_number"] for r in got) == list(range(25_001))
    assert {r["total_rows"] for r in got} == {25_001}


# Mixing.

def targets(sizes):
    """Water filling by bisection over the common level."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total = 1.5 * sum(sizes.values())
    low, high = 0.0, 2.0 * max(sizes.values(), default=0) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sizes[s], weight[s] * level) for s in sizes) < total else (low, level)
    return {s: min(2 * sizes[s], weight[s] * high) for s in sizes}


def test_mixing(documents):
    source = {(d, t): s for d, t, s in columns(documents, "doc_id", "text", "source")}
    got = mixing.mixing_report(documents).collect()
    docs = documents.collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r["doc_id"], len(brute.words(r["text"]))) for r in docs)
    sizes = defaultdict(int)
    for r in docs:
        sizes[r["source"]] += len(brute.words(r["text"]))
    want = targets(sizes)
    by_id = {(d, len(brute.words(t))): s for (d, t), s in source.items()}
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        s = by_id[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-6, abs_tol=1e-6)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1.5 * most[s]
    assert rows(mixing.mixing_report(documents)) == rows(mixing.mixing_report(documents.repartition(5)))


def selection(docs, target):
    """[(size, u)] of a source -> copies of each, by Pareto order sampling in plain Python."""
    low, high = 0.0, 4.0
    for _ in range(300):
        level = (low + high) / 2
        low, high = (level, high) if sum(s * min(2, level * s**0.5) for s, _ in docs) < target else (low, level)
    expected = [min(2.0, high * s**0.5) for s, _ in docs]
    # sizes at the bound are full whatever the last digits of the level say
    expected = [2.0 if e > 2 - 1e-9 else e for e in expected]
    copies = [int(e) for e in expected]
    rest = target - sum(c * s for c, (s, _) in zip(copies, docs))
    ranked = defaultdict(list)
    for i, (e, (s, u)) in enumerate(zip(expected, docs)):
        if (f := e - int(e)) > 1e-12:
            ranked[round(u / (1 - u) * (1 - f) / f, 9)].append(i)
    words = 0
    for _, group in sorted(ranked.items()):
        more = sum(docs[i][0] for i in group)
        if words >= rest or words + more - rest > rest - words:
            break
        words += more
        for i in group:
            copies[i] += 1
    return copies


def test_mixing_takes_what_pareto_sampling_takes(spark):
    docs = spark.read.parquet(f"{MIDDLE_SF}/documents.parquet")
    sized = mixing.sized_documents(docs).select("doc_id", "key", "size", "u").cache()
    got = {r["doc_id"]: (r["key"], r["size"], r["u"], r["copies"], r["target"])
           for r in mixing.apply_plan(sized, mixing.mixing_plan(sized.select("key", "size", "u"))).collect()}
    by_source = defaultdict(list)
    for d, (key, *_) in sorted(got.items()):
        by_source[key].append(d)
    beside = 0
    for own in by_source.values():
        own = [d for d in own if got[d][1] > 0]
        assert [got[d][3] for d in own] == selection([got[d][1:3] for d in own], got[own[0]][4])
        # Odds matter inside a source: what is sampled is not just what has the smallest u.
        took = [d for d in own if got[d][3] > 0]
        left = [d for d in own if not got[d][3]]
        beside += bool(left) and max(got[d][2] for d in took) > min(got[d][2] for d in left)
    assert beside > len(by_source) / 2


def test_larger_documents_are_likelier_and_none_passes_its_bound(spark):
    sized = spark.range(30_000).select(F.lit("1s").alias("key"), (F.col("id") % 3 * 40 + 10).alias("size"), mixing.uniform("id").alias("u"))
    sizes = sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"))
    for target in (300_000.0, 1_100_000.0, 2_999_000.0, 3_000_000.0):
        targets = spark.createDataFrame([("1s", target)], "key string, target double")
        level = mixing.source_levels(sizes, targets).first()
        want = {s: min(2.0, level["level"] * s**0.5) for s in (10, 50, 90)}
        assert sum(10_000 * s * e for s, e in want.items()) == pytest.approx(target, rel=1e-9)
        assert level["rest"] == pytest.approx(sum(10_000 * s * (e % 1) for s, e in want.items() if e < 2 - 1e-9), rel=1e-6, abs=1)


def test_mixed_documents_keep_their_columns(odd_documents):
    mixed = mixing.mix_documents(odd_documents)
    assert mixed.columns == odd_documents.columns
    copies = Counter(tuple(r) for r in mixed.collect())
    there = Counter(tuple(r) for r in odd_documents.collect())
    assert all(n <= 2 * there[r] for r, n in copies.items())


# Token counts.

@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    return public_tokenizers.path(token_counts.TOKENIZER)


def test_token_counts(documents, spark, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    extra = spark.createDataFrame([(900, "a<|endoftext|>b"), (901, "naïve 你好 \r\n")], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(extra)
    want = sorted(((d, len((t or "").encode()), n := len(model.encode(t or "", add_special_tokens=False).ids), n > 512)
                   for d, t in columns(docs, "doc_id", "text")), key=repr)
    assert rows(token_counts.token_report(docs, str(tmp_path / "cache"), tokenizer)) == want


def test_token_cache_encodes_only_distinct_misses(spark, tokenizer, tmp_path):
    cache = str(tmp_path / "cache")
    first = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None)], "doc_id long, text string")
    token_counts.token_report(first, cache, tokenizer).collect()
    assert spark.read.parquet(cache).count() == 2
    more = first.union(spark.createDataFrame([(4, "three"), (5, "")], first.schema))
    assert token_counts.token_report(more, cache, tokenizer).count() == 5
    assert spark.read.parquet(cache).count() == 3
    # Stored counts are used as they are.
    spark.read.parquet(cache).withColumn("n_tokens", F.col("n_tokens") + 100).write.parquet(str(tmp_path / "other"))
    assert min(r["n_tokens"] for r in token_counts.token_report(first, str(tmp_path / "other"), tokenizer).collect()) >= 100


# Line dedup.

def duck(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return sorted(con.execute(sql).fetchall(), key=repr)


def test_line_dedup_equals_sql(spark):
    want = duck(boilerplate.ORACLE, pages=f"{MIDDLE_SF}/pages.parquet")
    assert rows(boilerplate.op8_line_dedup(spark, MIDDLE_SF)) == want


def test_line_dedup_odd_pages(spark, tmp_path):
    menu = "<ul><li>Home</li><li> About&nbsp;us </li></ul>"
    pages = [(i, f"http://Site.example/{i}", f"{menu}<p>text {i}</p><p>twice</p><p>twice</p>", "h", 1) for i in range(6)]
    pages += [(10, "http://lone.example/", menu, "h", 1), (11, None, menu, "h", 1), (12, "http://site.example/x", None, "h", 1),
              (13, "not a url", "", "h", 1), (None, "http://site.example/y", "a<br>b", None, None), (0, *pages[0][1:])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string, kept int")
    df.write.parquet(str(tmp_path / "pages"))
    got = rows(boilerplate.line_report(df))
    assert got == duck(boilerplate.ORACLE, pages=f"{tmp_path}/pages/*.parquet")
    dropped = {r[0]: (r[2], r[3]) for r in got}
    assert dropped[1] == (5, 4) and dropped[10] == (2, 0) and dropped[11] == (2, 0) and dropped[12] == (0, 0)
    assert boilerplate.drop_boilerplate(df).columns == [*df.columns, "_host", "_lines", "_kept"]
    assert boilerplate.line_report(df.filter("false")).count() == 0


# Language model.

def compare_scores(df, docs):
    got, want = rows(df), brute.language_model(docs, language_model.MIX)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    # Filters never lose a pair, and tell of a few that are not there.
    assert all(g[6] >= w[6] - 1e-6 for g, w in zip(got, want))
    assert sum(g[6] - w[6] for g, w in zip(got, want)) <= 0.01 * abs(sum(w[6] for w in want))


def test_language_model(documents):
    docs = columns(documents, "doc_id", "text")
    df = language_model.score_documents(documents)
    compare_scores(df, docs) if docs else rows(df) == []


@pytest.mark.parametrize("which", ["odd", "small"])
def test_language_model_with_filters_that_are_not_broadcast(which, odd_documents, small):
    documents = {"odd": odd_documents, "small": small("documents")}[which]
    whole, parts = (rows(language_model.score_documents(documents, n)) for n in (1 << 26, 0))
    assert whole == parts


def test_filter_holds_every_level():
    keys = np.arange(1, 4001, dtype=np.uint64) * np.uint64(977)
    counts = np.arange(1, 4001)
    n_items, bits = language_model.build_filter(keys, counts)
    found = language_model.LogFrequencyFilter([(0, len(bits))], bits, 1).levels(keys)
    exact = np.floor(np.log2(counts)).astype(int) + 1
    assert n_items == exact.sum()
    assert (found >= exact).all() and (found == exact).mean() > 0.95
    others = np.arange(1, 4001, dtype=np.uint64) * np.uint64(977) + np.uint64(5)
    assert (language_model.LogFrequencyFilter([(0, len(bits))], bits, 1).levels(others) > 0).mean() < 0.03


# Vector search.

def test_vector_search_equals_sql_and_brute_force(spark):
    got = rows(vector_search.op10_vector_search(spark, SMALL_SF))
    assert got == duck(vector_search.ORACLE, embeddings=f"{SMALL_SF}/embeddings.parquet")
    vectors = columns(spark.read.parquet(f"{SMALL_SF}/embeddings.parquet"), "vec_id", "embedding")
    assert sorted(got) == brute.top_k(vectors, 50, 5)


def test_vector_search_odd_rows(spark, monkeypatch):
    draw = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in draw.normal(size=6)]) for i in range(230)]
    vectors += [(i, [1.0] * 6) for i in range(230, 260)] + [(300, None), (350, [1.0, None, 2.0]), (400, [float("nan")] * 6),
                                                           (450, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in vectors], "vec_id long, embedding array<float>, score int, v int")
    exact = columns(df, "vec_id", "embedding")
    want = brute.top_k(exact, 50, 5)
    assert sorted(rows(vector_search.search_report(df))) == want
    monkeypatch.setattr(vector_search, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 2)
    assert sorted(rows(vector_search.search_report(df))) == want
    assert vector_search.search_report(df.filter("false")).count() == 0
    assert vector_search.search_report(df.filter("vec_id = 50")).count() == 0


def test_large_products_do_not_round():
    big = np.array([[2.0**40, 1.0], [2.0**40, 0.0]])
    assert vector_search.exact_scores(big, np.array([2.0**20, 1.0])).tolist() == [2**60 + 1, 2**60]
