"""Substring dedup with fixed-block anchors.

A window is ``WINDOW`` consecutive words of one document. Each word covered by
a window whose word sequence also starts earlier (smaller doc_id, or smaller
start in the same document) is removed; windows are judged on the input.

Every document's text is cut into reference blocks of ``BLOCK`` words, without
overlap; as BLOCK is half of WINDOW, every window holds a whole block.

1. Units send the hashes of their blocks and of the rolling window of BLOCK
   words at every position to buckets. A block is an anchor if its words occur
   again anywhere; the bucket answers which ones are.
2. Only windows around an anchor can repeat. Units extend their anchors to
   these windows and send each distinct one, with its first place in the unit,
   to the bucket of its hash; the bucket finds the first place of all.
3. Units remove the windows that are not first. Runs of such windows are the
   maximal repeats, which come out as word spans.

A passage that a third of all documents share is one entry a unit. Block
hashes are short, since a false anchor costs time only; windows are compared
by 80 bits.

NULL texts have no words. Rows that share a doc_id are one document laid over
itself: a window is earlier only where its start is smaller. Rows without
doc_id come last. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm.common import WordArrays, raw_texts, shuffle_partitions, table
from worklens.llm.units import (
    arrow_table, bucket_slices, by_unit, ids_of, ordered, pack, pack_bits, unpack, unpack_bits,
)

WINDOW = 20
BLOCK = 10
BLOCK_KEY_BITS = 32

SENT = "p int, u int, keys binary, flags binary"
MASKS = "u int, p int, mask binary"
WINDOWS = "p int, u int, keys binary, more binary, docs binary, starts binary, places binary"
PLACES = "u int, places binary"
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_sha256 string, kept string"


class UnitWords:
    """The words of a unit, its reference blocks and its rolling block keys."""

    def __init__(self, unit: pa.Table, buckets: int):
        unit = ordered(unit)
        self.u = unit.column("u")[0].as_py()
        self.ids = ids_of(unit)
        self.no_id = unit.column("doc_id").is_null().to_numpy()
        self.words = WordArrays((text or b"").split() for text in raw_texts(unit))
        self.of = self.words.at()
        self.room = self.words.room()
        self.index = np.arange(len(self.of)) - self.words.start[self.of]
        self.buckets = buckets

    def block_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct rolling keys sorted by bucket; the key's number at each place; the places."""
        places = np.flatnonzero((self.room >= BLOCK) & (self.words.length[self.of] >= WINDOW))
        hashes = self.words.windows(BLOCK)[places]
        n = np.uint64(self.buckets)
        keys = ((hashes % n) << np.uint64(BLOCK_KEY_BITS)) | ((hashes // n) & np.uint64((1 << BLOCK_KEY_BITS) - 1))
        distinct, number = np.unique(keys, return_inverse=True)
        return distinct, number, places


def send_blocks(buckets: int):
    def send(unit: pa.Table) -> pa.Table:
        words = UnitWords(unit, buckets)
        keys, number, places = words.block_keys()
        often = np.bincount(number, minlength=len(keys)) > 1
        reference = np.zeros(len(keys), bool)
        reference[number[words.index[places] % BLOCK == 0]] = True
        rows = [
            (p, words.u, pack(keys[at] & np.uint64((1 << BLOCK_KEY_BITS) - 1), rising=True),
             pack_bits(np.concatenate([often[at], reference[at]])))
            for p, at in enumerate(bucket_slices(keys >> np.uint64(BLOCK_KEY_BITS), buckets)) if at.stop > at.start
        ]
        return arrow_table(rows, SENT)

    return send


def find_anchors(bucket: pa.Table) -> pa.Table:
    """Of each unit's keys: is it a reference block somewhere, and there more than once?"""
    keys = [unpack(x, rising=True) for x in bucket.column("keys").to_pylist()]
    flags = [unpack_bits(x).reshape(2, -1) for x in bucket.column("flags").to_pylist()]
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    often, reference = np.concatenate(flags, axis=1)
    times = np.bincount(number, weights=1 + often, minlength=len(distinct))
    is_reference = np.bincount(number, weights=reference, minlength=len(distinct)) > 0
    anchor = ((times > 1) & is_reference)[number]
    ends = np.cumsum([len(k) for k in keys])
    rows = [(u, p, pack_bits(anchor[end - len(k):end])) for u, p, k, end in
            zip(bucket.column("u").to_pylist(), bucket.column("p").to_pylist(), keys, ends)]
    return arrow_table(rows, MASKS)


def send_windows(buckets: int):
    def send(unit: pa.Table, masks: pa.Table) -> pa.Table:
        if not unit.num_rows or not masks.num_rows:
            return arrow_table([], WINDOWS)
        words = UnitWords(unit, buckets)
        keys, number, places = words.block_keys()
        anchor = np.zeros(len(keys), bool)
        answers = dict(zip(masks.column("p").to_pylist(), masks.column("mask").to_pylist()))
        for p, at in enumerate(bucket_slices(keys >> np.uint64(BLOCK_KEY_BITS), buckets)):
            if at.stop > at.start:
                anchor[at] = unpack_bits(answers[p])
        # Windows that hold an anchor: from WINDOW - BLOCK words before it on.
        anchored = places[anchor[number] & (words.index[places] % BLOCK == 0)]
        first = np.maximum(anchored - (WINDOW - BLOCK), words.words.start[words.of[anchored]])
        around = np.zeros(len(words.of) + 1, np.int64)
        np.add.at(around, first, 1)
        np.add.at(around, anchored + 1, -1)
        starts = np.flatnonzero((np.cumsum(around)[:-1] > 0) & (words.room >= WINDOW))
        hashes, more = (words.words.windows(WINDOW, seed)[starts] for seed in (1, 2))
        more &= np.uint64(0xFFFF)
        n = np.uint64(buckets)
        order = np.lexsort((words.index[starts], words.ids[words.of[starts]], more, hashes // n, hashes % n))
        starts, hashes, more = starts[order], hashes[order], more[order]
        new = np.ones(len(starts), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (more[1:] != more[:-1])
        starts, hashes, more = starts[new], hashes[new], more[new]
        docs, index = words.ids[words.of[starts]], words.index[starts]
        rows = [
            (p, words.u, pack(hashes[at] // n, rising=True), pack(more[at]), pack(docs[at]), pack(index[at]), pack(starts[at]))
            for p, at in enumerate(bucket_slices(hashes % n, buckets)) if at.stop > at.start
        ]
        return arrow_table(rows, WINDOWS)

    return send


def find_first(bucket: pa.Table) -> pa.Table:
    """The places of each unit's windows that start earlier elsewhere."""
    keys = [unpack(x, rising=True) for x in bucket.column("keys").to_pylist()]
    more, docs, starts, places = (
        np.concatenate([unpack(x) for x in bucket.column(name).to_pylist()]) for name in ("more", "docs", "starts", "places"))
    unit = np.repeat(np.array(bucket.column("u").to_pylist()), [len(k) for k in keys])
    order = np.lexsort((starts, docs, more, np.concatenate(keys)))
    key, more, docs, starts, places, unit = (x[order] for x in (np.concatenate(keys), more, docs, starts, places, unit))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (docs != docs[first]) | (starts != starts[first])
    rows = [(int(u), pack(np.sort(places[later & (unit == u)]), rising=True)) for u in np.unique(unit[later])]
    return arrow_table(rows, PLACES)


def remove(keep_text: bool):
    def cut(unit: pa.Table, answers: pa.Table) -> pa.Table:
        if not unit.num_rows:
            return arrow_table([], RESULT)
        words = UnitWords(unit, 1)
        starts = np.flatnonzero(words.room >= WINDOW)
        hashes = words.words.windows(WINDOW, 1)[starts]
        # Repeats inside the unit: all but its first place, equal places excepted.
        order = np.lexsort((words.index[starts], words.ids[words.of[starts]], hashes))
        starts, hashes = starts[order], hashes[order]
        new = np.ones(len(starts), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        first = starts[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(starts) else starts
        docs, index = words.ids[words.of], words.index
        later = (docs[starts] != docs[first]) | (index[starts] != index[first])
        repeat = np.zeros(len(words.of) + 1, np.int64)
        removed = np.zeros(len(words.of), bool)
        removed[starts[later]] = True
        told = [unpack(x, rising=True).astype(np.int64) for x in answers.column("places").to_pylist()]
        if told:
            # The unit's first place of a window that starts earlier elsewhere,
            # and any other row of the same document at the same start.
            removed[np.concatenate(told)] = True
            removed[starts] |= removed[first]
        at = np.flatnonzero(removed)
        np.add.at(repeat, at, 1)
        np.add.at(repeat, at + WINDOW, -1)
        gone = np.cumsum(repeat)[:-1] > 0
        rows = []
        lists = raw_texts(ordered(unit))
        for i, (begin, length) in enumerate(zip(words.words.start, words.words.length)):
            out = gone[begin:begin + length]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
            kept = b" ".join(w for w, g in zip((lists[i] or b"").split(), out) if not g) if out.any() else b" ".join((lists[i] or b"").split())
            rows.append((None if words.no_id[i] else int(words.ids[i]), int(length), int(out.sum()),
                         [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)],
                         hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
        return arrow_table(rows, RESULT)

    return cut


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_removed, spans of removed words, kept_sha256 and kept text."""
    n = shuffle_partitions(docs.sparkSession)
    units = by_unit(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"])
    anchors = units.groupBy("u").applyInArrow(send_blocks(n), SENT).groupBy("p").applyInArrow(find_anchors, MASKS)
    windows = units.groupBy("u").cogroup(anchors.groupBy("u")).applyInArrow(send_windows(n), WINDOWS)
    later = windows.groupBy("p").applyInArrow(find_first, PLACES)
    return units.groupBy("u").cogroup(later.groupBy("u")).applyInArrow(remove(keep_text), RESULT)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


def repeat_report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
