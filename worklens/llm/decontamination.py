"""Benchmark decontamination with an FM-index per training shard.

Words are runs of letters and digits, A-Z lower-cased, where every non-ASCII
byte counts as a letter. A benchmark item's phrases are its windows of
``WINDOW`` words, or the whole item where it has fewer words.

A shard is a run of consecutive documents of at most ``SHARD_BYTES`` (a longer
text is a shard of its own), formed where the documents are read: nothing is
shuffled. In a shard, a word that no phrase holds can be in no match, so the
index covers the maximal runs of phrase words that are long enough for the
shortest phrase; backward search finds each phrase's interval, sampled suffix
positions give its places, and the words inside are merged to removal spans.
A document is contaminated if a hit lies in it and 20 * hit words reach its
words.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` of text (an item
that is longer is a block of its own), each broadcast on its own; a shard is
indexed and searched once a block, so memory does not depend on the
benchmark's size.

NULL texts have no words. Rows that share an item_id are one item; an item
without id counts under the empty name. Equal documents are judged alike.
Without documents the result is empty, without benchmark nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from worklens.llm.common import table
from worklens.llm.fm_index import FMIndex

WINDOW = 13
LEAST_SHARE = 20
SHARD_BYTES = 16 << 20
BLOCK_BYTES = 8 << 20
#: Everything but letters, digits and non-ASCII bytes becomes a space, A-Z lower case.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20
                for b in range(256))
FOUND = ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
         "items array<string>, spans array<struct<start:int,end:int>>")


def letter_words(text: bytes | None) -> list[bytes]:
    return text.translate(LETTERS).split() if text else []


class Phrases:
    """The phrases of a block of benchmark items, as rows of word numbers."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            for at in range(max(1, len(ids) - WINDOW + 1)):
                owners.setdefault(tuple(ids[at:at + WINDOW]), set()).add(item)
        owners.pop((), None)
        self.owners = list(owners.values())
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.rows = np.zeros((len(owners), WINDOW), np.int64)
        for row, phrase in zip(self.rows, owners):
            row[: len(phrase)] = phrase


class Shard:
    """The words of consecutive documents and what was found in them."""

    def __init__(self, texts: list[bytes | None]):
        self.words = [letter_words(t) for t in texts]
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.hit = np.zeros(int(self.length.sum()) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in texts]

    def search(self, phrases: Phrases) -> None:
        if not len(phrases.rows) or not self.length.sum():
            return
        number = phrases.number.get
        ids = np.concatenate([np.fromiter((number(w, 0) for w in words), np.int64, len(words)) for words in self.words])
        of = np.repeat(np.arange(len(self.words)), self.length)
        # Maximal runs of phrase words inside one document.
        known = ids > 0
        begins = known.copy()
        begins[1:] &= ~known[:-1] | (of[1:] != of[:-1])
        ends = known.copy()
        ends[:-1] &= ~known[1:] | (of[1:] != of[:-1])
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        long = last - first + 1 >= phrases.lengths.min()
        first, size = first[long], (last - first + 1)[long]
        if not len(first):
            return
        # The runs, each closed by a 0, and the word each place of them is.
        offset = np.cumsum(size + 1) - (size + 1)
        place = np.arange(int((size + 1).sum())) - np.repeat(offset, size + 1) + np.repeat(first, size + 1)
        text = np.append(ids, 0)[place]
        text[offset + size] = 0
        index = FMIndex(text, len(phrases.number) + 1)
        low, high = index.search(phrases.rows, phrases.lengths)
        found = np.flatnonzero(high > low)
        times = (high - low)[found]
        rows = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[found], times)
        phrase = np.repeat(found, times)
        at = place[index.locate(rows)]
        np.add.at(self.hit, at, 1)
        np.add.at(self.hit, at + phrases.lengths[phrase], -1)
        for doc, p in np.unique(np.stack([of[at], phrase], 1), axis=0):
            self.items[doc] |= phrases.owners[p]

    def results(self) -> Iterator[tuple]:
        inside = np.cumsum(self.hit)[:-1] > 0
        for begin, length, items in zip(self.start, self.length, self.items):
            hit = inside[begin:begin + length]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2)
            n_hit, names = int(hit.sum()), sorted(items)
            yield (int(length), n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(),
                   n_hit > 0 and LEAST_SHARE * n_hit >= length, names, [{"start": int(a), "end": int(b)} for a, b in edges])


def shards(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    part, size = [], 0
    for text in texts:
        length = len(text or b"")
        if part and size + length > SHARD_BYTES:
            yield part
            part, size = [], 0
        part.append(text)
        size += length
    if part:
        yield part


def benchmark_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with their words, in blocks; the driver holds one block at a time.

    The words of an item are its own; rows that share an item_id stay apart,
    so no window spans two rows.
    """
    block, size = [], 0
    items = benchmark.filter("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text")
    for item, text in items.toLocalIterator():
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item, letter_words(text.encode())))
        size += len(text)
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(_row struct with a field text) -> _row and what was found in its text."""
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(block) for block in benchmark_blocks(benchmark)]
    out = StructType([docs.schema["_row"], *StructType.fromDDL(FOUND).fields])
    names = [f.name for f in out.fields]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        held: dict[int, Phrases] = {}

        def phrases(i: int) -> Phrases:
            if i not in held:
                held.clear()
                held[i] = Phrases(blocks[i].value)
                # A broadcast keeps what it has loaded; one block at a time is the bound.
                vars(blocks[i]).pop("_value", None)
            return held[i]

        for batch in batches:
            texts = batch.column("_row").field("text").cast(pa.binary()).to_pylist()
            done = 0
            for part in shards(texts):
                shard = Shard(part)
                for i in range(len(blocks)):
                    shard.search(phrases(i))
                columns = list(zip(*shard.results()))
                rows = batch.column("_row").slice(done, len(part))
                done += len(part)
                arrays = [pa.array(c, schema.field(n).type) for c, n in zip(columns, names[1:])]
                yield pa.RecordBatch.from_arrays([rows.cast(schema.field("_row").type), *arrays], names)

    return docs.select("_row").mapInArrow(search, out)


def as_rows(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("_row"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = decontaminate(as_rows(docs, ["doc_id", "text"]), benchmark)
    return found.select("_row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
