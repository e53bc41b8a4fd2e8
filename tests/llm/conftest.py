from __future__ import annotations

import random

import pytest

SMALL_SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, u string, class string, size string"


def odd_texts():
    """Texts that exercise ties, copies, near copies, shared passages and odd content."""
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "ñu", "Ünd", "A1", "x_y", "a\x00b", "z z"]

    def some(n):
        return [draw.choice(vocabulary) for _ in range(n)]

    base, passage = some(120), some(45)
    texts = [None, "", "   \n\t ", "one", "One", "two words", "a b c", " ".join(["spam"] * 90)]
    texts += [" ".join(base)] * 3 + [" ".join(base).upper(), "  ".join(base) + "\n"]
    for _ in range(12):
        near = list(base)
        for _ in range(draw.randint(1, 3)):
            near[draw.randrange(len(near))] = f"edit{draw.randrange(999)}"
        texts.append(" ".join(near))
    texts += [" ".join(some(draw.randint(5, 60)) + passage + some(draw.randint(0, 60))) for _ in range(10)]
    texts += [" ".join(some(draw.randint(1, 200))) for _ in range(20)]
    texts += [" ".join(passage[:20]), " ".join(passage[:19]), " ".join(passage + passage), " ".join(some(6000))]
    return texts


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with NULL and repeated doc_ids, repeated rows, NULL sources, and columns that clash with the operators'."""
    texts = odd_texts()
    rows = [(i * 7 % 101, t, "en", f"s{i % 4}" if i % 5 else None, None, "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, texts[20], None, None, None, None, None, None),
             (None, texts[30], None, "s1", None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd_documents(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"{SMALL_SF}/{name}.parquet")
