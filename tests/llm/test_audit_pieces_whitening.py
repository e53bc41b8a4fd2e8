"""Whitening, filter audit and pieces: against brute force, SQL and the library."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from llm import brute

from worklens.llm import filter_audit, pieces, whitening

SMALL_SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(params=["odd", "small", "none"])
def documents(request, odd_documents, no_documents, small):
    return {"odd": odd_documents, "none": no_documents, "small": small("documents")}[request.param]


# Whitening.

def usable(vectors):
    kept = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) and abs(c) <= 2**40 for c in v)]
    lengths = Counter(len(v) for _, v in kept)
    width = max(lengths, key=lambda d: (lengths[d], d), default=0)
    return [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in kept if len(v) == width]


def check_whitening(spark, vectors):
    found = whitening.whitening_report(spark.createDataFrame(vectors, "vec_id long, embedding array<double>, x int, index string")).collect()
    used = usable([v[:2] for v in vectors])
    fit = sorted({x for _, x in used})
    if not fit:
        assert not found
        return found
    n, d = len(fit), len(fit[0])
    k, sums = min(16, d), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    covariance = centred.T @ centred / n
    values = np.linalg.eigvalsh(covariance)[::-1]
    assert len(found) == len(used) * k
    deviations = Counter((i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in used)
    assert Counter((r["vec_id"], r["deviation"]) for r in found if r["component"] == 1) == deviations
    assert {r["n"] for r in found} == {n} and len({r["identity_error"] for r in found}) == 1
    for r in found:
        e = values[r["component"] - 1]
        assert r["explained"] is None or abs(r["explained"] - e / values.sum()) <= 1e-9
        assert (r["whitened"] is None) == (e <= 1e-12 * values[0])
    if n > 1:
        assert found[0]["identity_error"] < 1e-6
    # Whitened values of distinct vectors have the identity as covariance, so squared lengths follow from V alone.
    steep = values > 1e-12 * values[0]
    if k == d and steep.any():
        inverse = np.linalg.pinv(covariance, rcond=1e-12, hermitian=True)
        want = Counter((i, round(float(np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ inverse
                                       @ np.array([(n * a - s) / n for a, s in zip(x, sums)])), 4)) for i, x in used)
        lengths = defaultdict(float)
        for i, r in enumerate(sorted(found, key=lambda r: (repr(r["vec_id"]), r["component"]))):
            if len(want) == len(used):
                lengths[r["vec_id"]] += (r["whitened"] or 0.0) ** 2
        for (i, length) in want if len(want) == len({i for i, _ in used}) == len(used) else ():
            assert lengths[i] == pytest.approx(length, abs=1e-3)
    return found


def test_whitening_of_the_small_table(spark, small):
    vectors = [(r["vec_id"], [float(c) for c in r["embedding"]], 1, "a") for r in small("embeddings").collect()]
    check_whitening(spark, vectors)


def test_whitening_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 3)
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 21)
    draw = np.random.default_rng(4)
    mixed = draw.normal(size=(300, 8)) @ draw.normal(size=(8, 8))
    check_whitening(spark, [(i, [float(c) for c in v], 1, "a") for i, v in enumerate(mixed)])


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    draw = np.random.default_rng(5)
    good = [(i, [float(c) for c in draw.normal(size=4)], 1, "a") for i in range(40)]
    odd = [(100, None, 1, "a"), (101, [1.0, None, 2.0, 3.0], 1, "a"), (102, [1.0, nan, 2.0, 3.0], 1, "a"), (103, [inf, 1.0, 2.0, 3.0], 1, "a"),
           (104, [], 1, "a"), (105, [1.0, 2.0], None, None), (106, [1e300, 0.0, 0.0, 0.0], 1, "a"), (None, good[0][1], 1, "a"), good[1], good[1]]
    assert {r["vec_id"] for r in check_whitening(spark, good + odd)} == {None, *range(40)}
    check_whitening(spark, [])
    check_whitening(spark, odd[:5])
    flat = check_whitening(spark, [(i, [0.5, 0.25], 1, "a") for i in range(5)])
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in flat} == {(None, None, None, 0)}
    line = check_whitening(spark, [(i, [float(i), 2.0 * i, 0.0], 1, "a") for i in range(9)])
    assert {r["component"] for r in line if r["whitened"] is not None} == {1}
    far = whitening.whitening_report(spark.createDataFrame([(1, [1e9]), (2, [-1e9])], "vec_id long, embedding array<double>"))
    assert {r["deviation"] for r in far.collect()} == {None}


# Filter audit.

def brute_audit(documents, labels):
    smallest, good, toxic = {}, set(), set()
    for doc_id, text, _ in documents:
        if doc_id is not None:
            smallest[text or ""] = min(smallest.get(text or "", doc_id), doc_id)
    for doc_id, quality, bad in labels:
        good |= {doc_id} if quality == 1 and doc_id is not None else set()
        toxic |= {doc_id} if bad == 1 and doc_id is not None else set()
    fails, parts = [], set()
    for doc_id, text, source in documents:
        t = text or ""
        w = brute.words(t)
        parts.add(source or "")
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
               "D": bool(re.search(r"[#$%&*|]", t)), "E": doc_id is not None and smallest[t] < doc_id}
        fails.append((source or "", {f for f in bad if bad[f]}, doc_id in good, doc_id in toxic))
    out, shapley = [], Counter()
    for part in parts:
        own = [f[1:] for f in fails if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                failing = [x for x in own if f in x[0]]
                shapley[part, f] += len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone),
                            sum(len(x[0]) == 1 for x in failing), sum(x[1] for x in gone), sum(x[2] for x in gone)))
    return sorted(((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out), key=repr)


@pytest.fixture(scope="session")
def odd_labels(spark):
    marks = [(d, d % 2, int(d % 5 == 0)) for d in range(0, 101, 2)] + [(None, 1, 1), (3, None, 1), (4, 7, 0), (6, 1, 1), (6, 0, 0)]
    return spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_filter_audit(documents, odd_labels):
    found = rows(filter_audit.audit(filter_audit.combinations(documents, odd_labels)))
    docs = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    assert found == brute_audit(docs, [tuple(r) for r in odd_labels.collect()])
    assert len(found) == 600 * len({s or "" for _, _, s in docs})


def test_filter_audit_without_labels_and_with_hot_copies(spark, odd_labels):
    texts = ["same text " * 30] * 400 + ["other"] * 200 + [f"w{i} $" for i in range(60)]
    docs = spark.createDataFrame([(i % 350, t, "s", i) for i, t in enumerate(texts)], "doc_id long, text string, source string, bits int")
    found = rows(filter_audit.audit(filter_audit.combinations(docs, odd_labels.filter("false"))))
    assert found == brute_audit([(i % 350, t, "s") for i, t in enumerate(texts)], [])


def test_filter_audit_equals_its_sql(spark):
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL_SF}/{name}.parquet'")
    want = db.execute(filter_audit.ORACLE)
    names = [c[0] for c in want.description]
    found = filter_audit.op12_filter_audit(spark, SMALL_SF).select(*names)
    assert rows(found) == sorted(want.fetchall(), key=repr)


# Pieces.

@pytest.fixture(scope="session")
def model():
    import public_tokenizers

    return public_tokenizers.path(pieces.MODEL)


@pytest.fixture(scope="session")
def vocabulary(model):
    return pieces.Vocabulary(pieces.model_bytes(model))


def digests(lib, text):
    ids = lib.encode(text or "", add_bos=True, add_eos=True)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(lib.decode(ids).encode()).hexdigest())


@pytest.mark.parametrize("check", ["segments", "texts"])
def test_pieces(documents, model, vocabulary, check):
    want = sorted(((r["doc_id"], *digests(vocabulary.library, r["text"])) for r in documents.collect()), key=repr)
    assert rows(pieces.piece_report(documents, model, check)) == want


def test_pieces_keep_other_columns(odd_documents, model):
    clash = odd_documents.selectExpr("*", "u as _row", "u as _text", "map('k', u) as _ids", "1 as _decoded")
    found = pieces.encode_texts(clash, model)
    assert rows(found.select("_row.*")) == rows(clash.drop("text"))


@pytest.mark.parametrize("short", [0, 10**9])
def test_agenda_equals_the_library(vocabulary, monkeypatch, short):
    monkeypatch.setattr(pieces, "SHORT", short)
    draw = random.Random(3)
    odd = ["", " ", "  " * 37, "\x00", "▁a", "<s>", "<0x41>", "a\r\nb", "a" * 3000, "\U0001F600 ☃é", "     ▁▁  x   "]
    odd += ["".join(draw.choice(" abcdeinrthou\n▁éß☃1") for _ in range(draw.randint(0, 150))) for _ in range(500)]
    for text in odd:
        ids = vocabulary.encode(text)
        vocabulary.check_text(text, ids, vocabulary.decode(ids))


def test_decoding_of_any_ids(vocabulary):
    draw = random.Random(4)
    for _ in range(2000):
        ids = [draw.choice([draw.randrange(300), draw.randrange(vocabulary.library.get_piece_size())]) for _ in range(draw.randint(0, 9))]
        assert vocabulary.decode(ids) == vocabulary.library.decode(ids)


def test_a_wrong_id_fails_the_job(vocabulary):
    with pytest.raises(ValueError, match="the library"):
        vocabulary.check_segments(["▁a"], [[5]])
    with pytest.raises(ValueError, match="differ"):
        vocabulary.check_text("a", [1, 5, 2], "a")


def test_long_texts(spark, model, vocabulary, odd_labels):
    """Texts of megabytes: one of many words, one without any space."""
    texts = ["lorem ipsum dolor 123 " * 100_000, "abcdefghij" * 100_000]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert rows(pieces.piece_report(docs, model)) == sorted(((i, *digests(vocabulary.library, t)) for i, t in enumerate(texts)), key=repr)
    assert rows(filter_audit.audit(filter_audit.combinations(docs, odd_labels))) == brute_audit(
        list(zip(range(2), texts, "ss")), [tuple(r) for r in odd_labels.collect()])
