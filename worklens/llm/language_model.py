"""Language-model scores from a log-frequency Bloom filter.

Tokens are the lower-cased words of a text and one end token. The corpus is
every training document; it gives exact counts of tokens and quantised counts
of token pairs (a text's first token is paired with the end token).

A pair that occurs c times is stored as the items (pair, 1) .. (pair, q) with
q = 1 + floor(log2 c), and its count is read back by probing level after level
until a probe misses: 2^(q-1). Pairs are dealt to buckets by hash; each bucket
has a filter of its own, sized to ``BITS`` bits an item, so the false-positive
rate does not depend on the size of the corpus. Scores interpolate the stored
pair frequency with the token's add-one probability:

    P(w | v) = MIX * min(c(v w), c(v)) / c(v) + (1 - MIX) * (c(w) + 1) / (N + V + 1)

Filters of up to ``BROADCAST_BYTES`` together are broadcast to the workers, and
every unit probes them there. Larger ones stay where they are, one row a
bucket: the units send their distinct pairs to the buckets, which probe and
answer. Both ways probe the same bits and give the same scores, and the work
of either is in proportion to the text.

Counts travel once a unit and token (see units), so a word in every text makes
no hot bucket. NULL texts have the end token alone, NULL doc_ids are training
documents, repeated rows count as often as they are there, an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm.common import WordArrays, mix64, raw_texts, shuffle_partitions, stage, table, words_of
from worklens.llm.units import NO_ID, arrow_table, bucket_slices, by_unit, ids_of, ordered, pack, unpack

MIX = 0.4
BITS, PROBES_PER_ITEM = 10, 5
BROADCAST_BYTES = 128 << 20
PAIR_KEY_BITS = 44
FOLDS, HELD_OUT_FOLD = 7, 2
#: The end token; no word holds white space.
END = b"\n"

SENT = "p int, u int, hashes binary, counts binary, keys binary, pair_counts binary"
LEARNED = "u int, p int, counts binary, n_tokens long, n_words long, n_pairs long, n_items long, bits binary"
PROBES = "p int, u int, keys binary"
ANSWERS = "u int, p int, counts binary, levels binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT_FOLD


class UnitTokens:
    """A unit's tokens, with its vocabulary in the order in which it is sent to buckets."""

    def __init__(self, unit: pa.Table, buckets: int):
        unit = ordered(unit)
        self.u = unit.column("u")[0].as_py()
        self.ids = [None if i == NO_ID else int(i) for i in ids_of(unit)]
        self.held_out = np.array([is_held_out(i) for i in self.ids])
        self.tokens = WordArrays([*words_of(t), END] for t in raw_texts(unit))
        self.of = self.tokens.at()
        self.buckets = np.uint64(buckets)
        h = self.tokens.hashes
        self.order = np.lexsort((h // self.buckets, h % self.buckets))
        self.sorted_hashes = h[self.order]
        self.slices = bucket_slices(self.sorted_hashes % self.buckets, buckets)

    def previous(self) -> np.ndarray:
        """The token before each token; the end token before a first one."""
        ids = self.tokens.ids
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[self.tokens.start] = self.tokens.words.index(END)
        return before

    def pair_hashes(self) -> np.ndarray:
        h = mix64(self.tokens.hashes)
        return mix64(h[self.previous()] * np.uint64(0x9E3779B97F4A7C15) + h[self.tokens.ids])


def pair_keys(hashes: np.ndarray, buckets: np.uint64) -> np.ndarray:
    """Bucket and key of each pair in one number that sorts by bucket."""
    return ((hashes % buckets) << np.uint64(PAIR_KEY_BITS)) | ((hashes // buckets) & np.uint64((1 << PAIR_KEY_BITS) - 1))


def send_counts(buckets: int) -> Callable:
    """Per bucket: the unit's tokens, and its training pairs, with their training counts."""

    def send(unit: pa.Table) -> pa.Table:
        own = UnitTokens(unit, buckets)
        training = ~own.held_out[own.of]
        counts = np.bincount(own.tokens.ids[training], minlength=len(own.tokens.words))[own.order]
        keys, pair_counts = np.unique(pair_keys(own.pair_hashes()[training], own.buckets), return_counts=True)
        short = keys & np.uint64((1 << PAIR_KEY_BITS) - 1)
        rows = [
            (p, own.u, pack(own.sorted_hashes[at] // own.buckets, rising=True), pack(counts[at]),
             pack(short[pairs], rising=True), pack(pair_counts[pairs]))
            for p, (at, pairs) in enumerate(zip(own.slices, bucket_slices(keys >> np.uint64(PAIR_KEY_BITS), buckets)))
            if at.stop > at.start or pairs.stop > pairs.start
        ]
        return arrow_table(rows, SENT)

    return send


def learn(bucket: pa.Table) -> pa.Table:
    """Each unit's tokens with their counts in all units; totals and filter in the bucket's first row."""
    hashes = [unpack(x, rising=True) for x in bucket.column("hashes").to_pylist()]
    total, number = summed(hashes, bucket.column("counts").to_pylist())[1:]
    answers = np.split(total[number], np.cumsum([len(h) for h in hashes])[:-1])
    keys, pair_counts, _ = summed([unpack(x, rising=True) for x in bucket.column("keys").to_pylist()],
                                  bucket.column("pair_counts").to_pylist())
    n_items, bits = build_filter(keys, pair_counts)
    totals = (int(total.sum()), int((total > 0).sum()), len(keys), n_items, bits if n_items else None)
    nothing = (0, 0, 0, 0, None)
    rows = [(u, p, pack(answer), *(nothing if i else totals)) for i, (u, p, answer) in
            enumerate(zip(bucket.column("u").to_pylist(), bucket.column("p").to_pylist(), answers))]
    return arrow_table(rows, LEARNED)


def summed(keys: list[np.ndarray], packed_counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed counts, and the distinct key's number for each key."""
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, number, np.concatenate([unpack(x) for x in packed_counts]).astype(np.int64))
    return distinct, total, number


def probe_places(keys: np.ndarray, level: int, probe: int, size: np.ndarray | np.uint64) -> np.ndarray:
    return mix64(keys + np.uint64((0x9E3779B97F4A7C15 * (level * PROBES_PER_ITEM + probe + 1)) & (2**64 - 1))) % size


def build_filter(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """Number of items, and the bits of a filter of the pairs' quantised counts."""
    levels = 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)
    n_items = int(levels.sum())
    size = np.uint64(max(1, -(-n_items * BITS // 64)) * 64)
    bits = np.zeros(int(size), bool)
    for level in range(int(levels.max(initial=0))):
        stored = keys[levels > level]
        for probe in range(PROBES_PER_ITEM):
            bits[probe_places(stored, level, probe, size)] = True
    return n_items, np.packbits(bits, bitorder="little").tobytes()


class LogFrequencyFilter:
    """Filters of some buckets side by side: (bucket, bytes) each, and their bytes in that order."""

    def __init__(self, sizes: list[tuple[int, int]], content: bytes, buckets: int):
        self.size, self.offset = np.zeros(buckets, np.uint64), np.zeros(buckets, np.uint64)
        at = 0
        for p, size in sizes:
            self.size[p], self.offset[p] = size * 8, at * 8
            at += size
        self.bytes = np.frombuffer(content, np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """How many levels of each pair key are stored; 0 for pairs that are not."""
        found = np.zeros(len(keys), np.uint8)
        buckets = (keys >> np.uint64(PAIR_KEY_BITS)).astype(np.int64)
        size, offset = self.size[buckets], self.offset[buckets]
        short = keys & np.uint64((1 << PAIR_KEY_BITS) - 1)
        left, level = np.flatnonzero(size > 0), 0
        while len(left) and level < 63:
            for probe in range(PROBES_PER_ITEM):
                place = offset[left] + probe_places(short[left], level, probe, size[left])
                hit = (self.bytes[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
                left = left[hit == 1]
            level += 1
            found[left] = level
        return found


def send_probes(buckets: int) -> Callable:
    """A unit's distinct pairs, of all its texts, to the buckets of their filters."""

    def send(unit: pa.Table) -> pa.Table:
        own = UnitTokens(unit, buckets)
        keys = np.unique(pair_keys(own.pair_hashes(), own.buckets))
        short = keys & np.uint64((1 << PAIR_KEY_BITS) - 1)
        slices = bucket_slices(keys >> np.uint64(PAIR_KEY_BITS), buckets)
        return arrow_table([(p, own.u, pack(short[at], rising=True)) for p, at in enumerate(slices) if at.stop > at.start],
                           PROBES)

    return send


def answer_probes(probes: pa.Table, filters: pa.Table) -> pa.Table:
    """Probes a bucket's filter for every unit."""
    if not probes.num_rows:
        return arrow_table([], ANSWERS)
    parts = filters.column("bits").to_pylist()
    stored = LogFrequencyFilter([(0, len(x)) for x in parts], b"".join(parts), 1)
    return arrow_table([(u, p, None, pack(stored.levels(unpack(keys, rising=True)))) for p, u, keys in
                        zip(*(probes.column(n).to_pylist() for n in ("p", "u", "keys")))], ANSWERS)


def score_units(buckets: int, n_tokens: int, n_words: int, broadcast=None) -> Callable:
    """Scores of a unit's texts from the answers to its tokens, and to its pairs unless the filters are broadcast."""

    def score(unit: pa.Table, answers: pa.Table) -> pa.Table:
        if not unit.num_rows:
            return arrow_table([], SCORES)
        own = UnitTokens(unit, buckets)
        told = list(zip(*(answers.column(n).to_pylist() for n in ("p", "counts", "levels"))))
        counted = {p: c for p, c, _ in told if c is not None}
        counts = np.zeros(len(own.tokens.words), np.int64)
        for p, at in enumerate(own.slices):
            if at.stop > at.start:
                counts[own.order[at]] = unpack(counted[p])
        keys, number = np.unique(pair_keys(own.pair_hashes(), own.buckets), return_inverse=True)
        if broadcast is not None:
            levels = LogFrequencyFilter(*broadcast.value, buckets).levels(keys).astype(np.int64)
        else:
            probed = {p: x for p, _, x in told if x is not None}
            levels = np.concatenate([unpack(probed[p]) for p in sorted(probed)]).astype(np.int64)
        seen = np.where(levels > 0, np.int64(1) << np.maximum(levels - 1, 0), 0)[number]
        base = (counts + 1) / (n_tokens + n_words + 1)
        ids, context = own.tokens.ids, counts[own.previous()]
        ratio = np.minimum(seen, context) / np.maximum(context, 1)
        p = np.where(context > 0, MIX * ratio + (1 - MIX) * base[ids], base[ids])

        def by_doc(values: np.ndarray) -> list:
            return np.bincount(own.of, weights=values, minlength=len(own.ids)).tolist()

        known = [int(k) for k in by_doc((counts > 0)[ids])]
        return arrow_table(list(zip(own.ids, own.held_out.tolist(), own.tokens.length.tolist(), known,
                                    by_doc(np.log10(base)[ids]), by_doc(np.log10(p)))), SCORES)

    return score


def score_documents(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    units = by_unit(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"])
    learned = stage(units.groupBy("u").applyInArrow(send_counts(n), SENT).groupBy("p").applyInArrow(learn, LEARNED),
                    "language-model")
    answers = learned.select("u", "p", "counts", F.lit(None).cast("binary").alias("levels"))
    filters = learned.filter("bits is not null").select("p", "bits")
    totals = learned.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_tokens", "n_words")],
                         F.coalesce(F.sum(F.octet_length("bits")), F.lit(0)).alias("n_bytes")).first()
    broadcast = None
    if totals["n_bytes"] <= broadcast_bytes:
        parts = [(r["p"], bytes(r["bits"])) for r in filters.toLocalIterator()]
        broadcast = spark.sparkContext.broadcast(([(p, len(x)) for p, x in parts], b"".join(x for _, x in parts)))
        del parts
    else:
        probes = units.groupBy("u").applyInArrow(send_probes(n), PROBES)
        answers = answers.unionByName(
            probes.groupBy("p").cogroup(filters.groupBy("p")).applyInArrow(answer_probes, ANSWERS))
    scored = units.groupBy("u").cogroup(answers.groupBy("u")).applyInArrow(
        score_units(n, totals["n_tokens"], totals["n_words"], broadcast), SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known",
                         F.lit(totals["n_tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
