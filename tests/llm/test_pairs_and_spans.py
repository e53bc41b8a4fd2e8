"""N-gram join, substring dedup and decontamination against brute force."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from llm import brute

from worklens.llm import decontamination, ngram_join, substring_dedup
from worklens.llm.components import components
from worklens.llm.fm_index import FMIndex
from worklens.llm.units import arrow_table, pack, pack_bits, unpack, unpack_bits


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(params=["odd", "small", "none"])
def documents(request, odd_documents, no_documents, small):
    return {"odd": odd_documents, "none": no_documents, "small": small("documents")}[request.param]


def test_ngram_join(documents):
    rule = ngram_join.Rule(3, 90, 100)
    assert rows(ngram_join.join_report(documents, rule)) == brute.join(pairs(documents), rule.words, rule.num, rule.den)


@pytest.mark.parametrize("rule", [ngram_join.Rule(5, 8, 10), ngram_join.Rule(2, 1, 2)])
def test_ngram_join_of_other_rules(odd_documents, rule):
    documents = odd_documents
    assert rows(ngram_join.join_report(documents, rule)) == brute.join(pairs(documents), rule.words, rule.num, rule.den)


def test_ngram_join_with_long_lists_only(odd_documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG", 1)
    rule = ngram_join.Rule(3, 90, 100)
    assert rows(ngram_join.join_report(odd_documents, rule)) == brute.join(pairs(odd_documents), 3, 90, 100)


def test_divide_skip_equals_counting():
    draw = np.random.default_rng(3)
    rule = ngram_join.Rule(3, 6, 10)
    base = draw.choice(200, 40, replace=False)
    sets = [np.unique(np.concatenate([draw.choice(base, 30), draw.choice(400, k)])).astype(np.uint64)
            for k in draw.integers(1, 20, 60)]
    lists = ngram_join.InvertedLists(list(range(60)), sets, rule)
    for own in sets:
        common = np.array([len(np.intersect1d(own, s)) for s in sets])
        want = np.flatnonzero(rule.links(common, len(own), lists.sizes))
        assert lists.query(own).tolist() == want.tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 90, 90: 90, 95: 90}


def test_substring_dedup(documents):
    assert rows(substring_dedup.repeat_report(documents)) == brute.repeats(pairs(documents))


def test_substring_dedup_keeps_text_and_spans(odd_documents):
    for r in substring_dedup.remove_repeats(odd_documents).collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert len(r["kept"].encode().split()) == r["n_words"] - r["n_removed"]


def test_decontamination(documents, spark, small):
    own = [t for _, t in pairs(documents) if t]
    if "u" in documents.columns and own:
        items = [(1, own[-1][:400]), (1, own[0]), (2, "two words"), (None, own[12]), (3, ""), (4, None), (5, "nowhere"),
                 (6, own[12])]
        benchmark = spark.createDataFrame(items, "item_id long, text string")
    else:
        benchmark = small("benchmark")
        items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    want = brute.contamination(pairs(documents), items)
    assert rows(decontamination.contamination_report(documents, benchmark)) == want


def test_decontamination_in_blocks_and_shards(small, monkeypatch):
    documents, benchmark = small("documents"), small("benchmark")
    want = rows(decontamination.contamination_report(documents, benchmark))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 500)
    assert rows(decontamination.contamination_report(documents, benchmark)) == want


def test_decontamination_without_benchmark(odd_documents, spark):
    found = decontamination.contamination_report(odd_documents, spark.createDataFrame([], "item_id long, text string"))
    assert found.filter("n_hit > 0 or contaminated").count() == 0


def test_fm_index_finds_every_occurrence():
    draw = np.random.default_rng(1)
    for _ in range(40):
        text = np.concatenate([np.append(draw.integers(1, 4, draw.integers(1, 60)), 0) for _ in range(draw.integers(1, 6))])
        index = FMIndex(text, 4)
        phrases, lengths = draw.integers(1, 4, (10, 5)), draw.integers(1, 6, 10)
        for phrase, n, low, high in zip(phrases, lengths, *index.search(phrases, lengths)):
            want = [i for i in range(len(text) - n + 1) if (text[i:i + n] == phrase[:n]).all()]
            assert sorted(index.locate(np.arange(low, high)).tolist()) == want


def test_packing_round_trip():
    draw = np.random.default_rng(2)
    for size in (0, 1, 1000):
        x = np.sort(draw.integers(0, 2**63, size).astype(np.uint64))
        assert unpack(pack(x, rising=True), rising=True).tolist() == x.tolist()
        assert unpack(pack(x[::-1])).tolist() == x[::-1].tolist()
        bits = x % np.uint64(3) == 0
        assert unpack_bits(pack_bits(bits)).tolist() == bits.tolist()


def test_ngram_join_of_a_large_group_over_many_units(spark):
    """Near copies of one text and of copies of it, more than there are units, whose links form long chains."""
    draw = np.random.default_rng(7)
    words = [f"w{i}" for i in draw.integers(0, 500, 60)]
    docs = []
    for i in range(150):
        if i % 30 == 0:
            words = [*words[6:], *[f"n{i}-{j}" for j in range(6)]]
        near = list(words)
        near[draw.integers(60)] = f"e{i}"
        docs.append((i, " ".join(near)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = rows(ngram_join.join_report(spark.createDataFrame(docs, "doc_id long, text string"), ngram_join.Rule(2, 8, 10)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute.join(docs, 2, 8, 10)


def brute_routes(entries, everywhere_from):
    """(unit, entry, target unit) of the last turn for entries {unit: [(token, label)]}."""
    out = set()
    for u, own in entries.items():
        for i, (token, label) in enumerate(own):
            held = {v: {x for t, x in other if t == token} for v, other in entries.items()}
            held = {v: found for v, found in held.items() if found}
            if len(set.union(*held.values())) == 1:
                continue
            if len(held) > everywhere_from:
                out.add((u, i, ngram_join.EVERYWHERE))
            else:
                out |= {(u, i, v) for v, found in held.items() if v > u and found != {label}}
    return out


@pytest.mark.parametrize("long, portion", [(256, 1 << 20), (256, 3), (4, 50), (1, 1)])
def test_routes_of_the_last_turn(monkeypatch, long, portion):
    monkeypatch.setattr(ngram_join, "LONG", long)
    monkeypatch.setattr(ngram_join, "PORTION", portion)
    draw = np.random.default_rng(long + portion)
    entries = {u: sorted({(int(t), int(x)) for t, x in zip(draw.integers(0, 12, 9), draw.integers(-2, 2, 9))})
               for u in (5, 0, 3, 7, 1, 2)}
    bucket = arrow_table([(9, u, pack(np.array([t for t, _ in own]), rising=True),
                           pack(np.array([x for _, x in own], np.int64).view(np.uint64))) for u, own in entries.items()],
                         ngram_join.ENTRIES)
    got, mixed = set(), {}
    for row in ngram_join.find_routes(2, True)(bucket).to_pylist():
        assert row["p"] == 9
        got |= set(zip([row["u"]] * 99, unpack(row["entry"], rising=True).tolist(), unpack(row["target"]).tolist()))
        mixed[row["u"]] = unpack_bits(row["mixed"]).tolist()
    assert got == brute_routes(entries, long)
    labels = {t: {x for own in entries.values() for s, x in own if s == t} for t in range(12)}
    want = {u: [len(labels[t]) > 1 for t, _ in own] for u, own in entries.items()}
    assert mixed == {u: bits for u, bits in want.items() if any(bits)}


def python_lines(function, *args):
    """The function's result and the number of lines of Python that it ran."""
    lines = 0

    def count(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return count

    sys.settrace(count)
    try:
        return function(*args), lines
    finally:
        sys.settrace(None)


@pytest.mark.parametrize("long", [256, 2])
def test_the_last_turn_does_not_visit_tokens_or_routes_in_python(monkeypatch, long):
    """Ten times the tokens and routes take no more lines of Python; ``ship`` sends what counting finds."""
    monkeypatch.setattr(ngram_join, "LONG", long)
    rule, ran = ngram_join.Rule(3, 90, 100), []
    for size in (40, 400):
        draw = np.random.default_rng(size)
        base = np.unique(draw.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
        rows = []
        for i in range(12):
            # Half of the sets share the base but for a few; the others half of it.
            common = base[draw.random(len(base)) < (0.97 if i % 2 else 0.5)]
            own = np.unique(np.concatenate([common, draw.integers(0, 2**63, 2 if i % 2 else size).astype(np.uint64)]))
            rows.append((i % 4, i, len(own), pack(own[:1], rising=True), pack(own, rising=True), i))
        units = [arrow_table([r for r in rows if r[0] == u], f"{ngram_join.OPEN}, label long") for u in range(4)]
        sent = pa.concat_tables([ngram_join.send_entries(4, True)(unit) for unit in units])
        buckets = [sent.filter(pc.equal(sent.column("p"), p)) for p in range(4)]
        found = [python_lines(ngram_join.find_routes(2, True), bucket) for bucket in buckets]
        routes = pa.concat_tables([r for r, _ in found])
        shipped = [python_lines(ngram_join.ship(rule, 4, True), unit, routes.filter(pc.equal(routes.column("u"), u)))
                   for u, unit in enumerate(units)]
        ran.append(sum(n for _, n in found + shipped))
        got = {(v, label) for r, _ in shipped for v, labels in zip(r.column("v").to_pylist(), r.column("labels").to_pylist())
               for label in unpack(labels).tolist()}
        sets = [set((unpack(r[4], rising=True) >> np.uint64(24)).tolist()) for r in rows]
        held = [set().union(*(s for s, r in zip(sets, rows) if r[0] == u)) for u in range(4)]
        crowded = {t for t in set().union(*sets) if sum(t in h for h in held) > long}
        want = set()
        for (u, i, n, *_), own in zip(rows, sets):
            least = rule.least(n)
            for v in range(u + 1, 4):
                times, many = len((own & held[v]) - crowded), len(own & crowded)
                if many >= least or (times and times + many >= least):
                    want.add((v, i))
        assert got == want and got
    assert ran[1] < 1.5 * ran[0]
