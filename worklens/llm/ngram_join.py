"""N-gram Jaccard self-join by T-occurrence search, and its components.

A document is the set of its distinct n-word shingles (the whole sequence
where it has fewer words; nothing without words). Two documents link when
``DEN * |x & y| >= NUM * |x | y|``. The result is each document's class of
equal sets, and the classes' connected components under links.

Equal sets are one class, represented by one document. For the classes:

1. Of a set of n shingles, in the order of their hashes, only the first
   e + t matter to find partners (e = n - ceil(n NUM / DEN), t about a tenth
   of n): linked sets share at least t of them. Inverted lists over these
   tokens tell which tokens occur in two sets at all; only sets with t such
   tokens can have partners, and only their whole sets are kept.
2. Inside a unit, DivideSkip answers each set's T-occurrence query exactly:
   the longest inverted lists are set aside, the short ones are merged and
   counted, and sets that reach T less the number of long lists are probed in
   the long lists by binary search.
3. Between units the same idea routes sets: the lists of a token's units are
   merged and counted a target unit, lists of more than ``LONG`` units are set
   aside and only lower the threshold; a set travels to a unit where t of its
   tokens may occur (in the last turn, where ceil(n NUM / DEN) of all its
   shingles may), and is searched there as in 2.

A unit's search gives every class the smallest class of its component inside
the unit as its label. Tokens all of whose sets already share a label need no
search: so the first turns between units route each set only towards one unit
of the token's smallest label, while that finds links, and the last turn, which
is exhaustive, finds the sets of a large group of near copies mostly connected.
What a task finds between units it reduces to a forest over labels, so a turn
yields at most one edge a label and task, never the pairs; the turn's components
are those of that small table, and the labels follow. After the second turn only
sets stay in the search that share enough tokens with another label. All state between rounds
is written to shared storage, and deleted once the next is.

Short documents keep their order of words in the single shingle. Equal rows
and equal texts are one class; NULL and wordless texts have set size 0, link
with nothing and are their own component. Rows without doc_id can link; a
component without any doc_id has NULL as its id.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm.common import WORD_PATTERN, Scratch, WordArrays, mix64, raw_texts, shuffle_partitions, stage, table, words_of
from worklens.llm.components import components
from worklens.llm.units import arrow_table, bucket_slices, pack, pack_bits, unpack, unpack_bits
from worklens.plans.distributed import join_spreading_key

#: Inverted lists of more units than this are long: set aside, not merged.
LONG = 256
#: Turns between units before the exhaustive one, at most (any number is exact).
TURNS = 5
#: DivideSkip's weight of the long lists' number (a tuning constant; any value is exact).
SKIP = 0.01
TOKEN_BITS = 40
#: Routes expanded at a time.
PORTION = 1 << 20

SETS = "row_key long, doc_id long, class long, n long, tokens binary"
SENT = "p int, u int, keys binary, flags binary"
MASKS = "u int, p int, mask binary"
CANDIDATES = "u int, class long"
WHOLE = "class long, n long, hashes binary"
LABELS = "class long, label long"
EDGES = "a long, b long"
ENTRIES = "p int, u int, keys binary, labels binary"
ROUTES = "u int, p int, entry binary, target binary, mixed binary"
OPEN = "u int, class long, n long, tokens binary, hashes binary"
SHIPPED = "v int, labels binary, sizes binary, hashes binary"
EVERYWHERE = (1 << 31) - 1


@dataclasses.dataclass(frozen=True)
class Rule:
    """Shingle length, and the similarity num/den from which sets link."""

    words: int = 5
    num: int = 8
    den: int = 10

    def least(self, n):
        """Shingles a linked set shares with one of n, at least: ceil(n num / den)."""
        return -(-n * self.num // self.den)

    def share(self, n):
        """Prefix tokens that a set of n shares with a linked one of its size, at least."""
        return 1 + n // 10

    def threshold(self, n):
        """Prefix tokens that a set of n shares with any linked one, at least."""
        return self.share(self.least(n))

    def prefix(self, n):
        return np.minimum(n, n - self.least(n) + self.share(n))

    def links(self, common, n, m):
        return self.den * common >= self.num * (n + m - common)


def shingle_sets(lists: Iterator[list[bytes]], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each word list."""
    arrays = WordArrays(lists)
    hashes = arrays.windows(words, seed=words)
    out = []
    for start, length in zip(arrays.start, arrays.length):
        if length >= words:
            out.append(np.unique(hashes[start:start + length - words + 1]))
        elif length:
            short = arrays.hashes[arrays.ids[start:start + length]] * np.uint64(2 * words + 1)
            out.append(mix64(np.array([hash_sequence(short)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def hash_sequence(hashes: np.ndarray) -> int:
    total = len(hashes)
    for h in hashes.tolist():
        total = (total * 0xD1342543DE82EF95 + h) % 2**64
    return total


def class_of(hashes: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    folded = mix64(hashes + np.uint64(0x632BE59BD9B4E019))
    pair = np.array([folded.sum(dtype=np.uint64), np.bitwise_xor.reduce(folded, initial=np.uint64(len(hashes)))], np.uint64)
    return int(mix64(mix64(pair[:1]) + pair[1:]).view(np.int64)[0])


def describe(rule: Rule) -> Callable:
    """mapInArrow: (row_key, doc_id, text) -> class, set size and the prefix's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch):
                keys, ids = part.column("row_key").to_pylist(), part.column("doc_id").to_pylist()
                rows = []
                for key, doc_id, own in zip(keys, ids, shingle_sets((words_of(t) for t in raw_texts(part)), rule.words)):
                    prefix = own[: rule.prefix(len(own))] >> np.uint64(64 - TOKEN_BITS)
                    rows.append((key, doc_id, class_of(own) if len(own) else None, len(own), pack(prefix, rising=True)))
                yield from arrow_table(rows, SETS).to_batches()

    return run


def whole_sets(rule: Rule) -> Callable:
    """mapInArrow: text -> class and all its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch):
                own = shingle_sets((words_of(t) for t in raw_texts(part)), rule.words)
                yield from arrow_table([(class_of(s), len(s), pack(s, rising=True)) for s in own if len(s)], WHOLE).to_batches()

    return run


def _portions(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of text bytes (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in portions(sizes, most):
        yield batch.slice(a, b - a)


def portions(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to about ``most`` (or of one item)."""
    edges = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1, [len(sizes)]]))
    return pairwise(edges.tolist())


def expand(first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, x) for each x of the ``number[i]`` integers from ``first[i]`` on."""
    of = np.repeat(np.arange(len(number)), number)
    return of, np.arange(len(of)) + np.repeat(first - np.cumsum(number) + number, number)


# Tokens that occur in two sets.

def _tokens(unit: pa.Table, whole: bool = False) -> tuple[pa.Table, list[np.ndarray]]:
    """A unit by class, and the tokens of each set: those of its prefix or (``whole``) of all its shingles."""
    unit = unit.sort_by("class")
    if whole:
        return unit, [unpack(h, rising=True) >> np.uint64(64 - TOKEN_BITS) for h in unit.column("hashes").to_pylist()]
    return unit, [unpack(t, rising=True) for t in unit.column("tokens").to_pylist()]


def _by_bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Tokens as numbers that sort by bucket."""
    n = np.uint64(buckets)
    return ((tokens % n) << np.uint64(TOKEN_BITS)) | (tokens // n)


def send_tokens(buckets: int) -> Callable:
    def send(unit: pa.Table) -> pa.Table:
        u = unit.column("u")[0].as_py()
        keys, times = np.unique(_by_bucket(np.concatenate(_tokens(unit)[1]), buckets), return_counts=True)
        short = keys & np.uint64((1 << TOKEN_BITS) - 1)
        return arrow_table([(p, u, pack(short[at], rising=True), pack_bits(times[at] > 1))
                            for p, at in enumerate(bucket_slices(keys >> np.uint64(TOKEN_BITS), buckets))
                            if at.stop > at.start], SENT)

    return send


def find_shared(bucket: pa.Table) -> pa.Table:
    keys = [unpack(k, rising=True) for k in bucket.column("keys").to_pylist()]
    often = np.concatenate([unpack_bits(f) for f in bucket.column("flags").to_pylist()])
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    shared = (np.bincount(number, weights=1 + often, minlength=len(distinct)) > 1)[number]
    parts = np.split(shared, np.cumsum([len(k) for k in keys])[:-1])
    return arrow_table([(u, p, pack_bits(s)) for u, p, s in
                        zip(bucket.column("u").to_pylist(), bucket.column("p").to_pylist(), parts)], MASKS)


def find_candidates(rule: Rule, buckets: int) -> Callable:
    """Classes with as many shared tokens as any partner would have."""

    def find(unit: pa.Table, masks: pa.Table) -> pa.Table:
        if not unit.num_rows:
            return arrow_table([], CANDIDATES)
        unit, tokens = _tokens(unit)
        keyed = [_by_bucket(t, buckets) for t in tokens]
        keys = np.unique(np.concatenate(keyed))
        shared = np.zeros(len(keys), bool)
        answers = dict(zip(masks.column("p").to_pylist(), masks.column("mask").to_pylist()))
        for p, at in enumerate(bucket_slices(keys >> np.uint64(TOKEN_BITS), buckets)):
            if at.stop > at.start:
                shared[at] = unpack_bits(answers[p])
        u = unit.column("u")[0].as_py()
        return arrow_table([(u, c) for c, n, k in zip(unit.column("class").to_pylist(), unit.column("n").to_pylist(), keyed)
                            if shared[np.searchsorted(keys, k)].sum() >= rule.threshold(n)], CANDIDATES)

    return find


# Search.

class InvertedLists:
    """Inverted lists over the sets of a unit, with T-occurrence queries."""

    def __init__(self, classes: list[int], sets: list[np.ndarray], rule: Rule):
        self.classes, self.sets, self.rule = classes, sets, rule
        self.sizes = np.array([len(s) for s in sets], np.int64)
        shingles = np.concatenate(sets)
        self.shingles, number = np.unique(shingles, return_inverse=True)
        order = np.argsort(number, kind="stable")
        self.postings = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.edges = np.searchsorted(number[order], np.arange(len(self.shingles) + 1))

    def query(self, own: np.ndarray) -> np.ndarray:
        """Numbers of the sets that link with ``own``."""
        n = len(own)
        at = np.searchsorted(self.shingles, own)
        at[at == len(self.shingles)] = 0
        at = at[self.shingles[at] == own]
        least = int(self.rule.least(n))
        if len(at) < least:
            return np.empty(0, np.int64)
        length = self.edges[at + 1] - self.edges[at]
        at, length = (x[np.argsort(length, kind="stable")] for x in (at, length))
        n_long = min(least - 1, int(least / (SKIP * np.log2(max(2, int(length[-1]))) + 1)))
        short, long = at[: len(at) - n_long], at[len(at) - n_long:]
        # Merge the short lists and count.
        sizes = length[: len(short)]
        merged = self.postings[np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.edges[short], sizes)]
        found, times = np.unique(merged, return_counts=True)
        fits = (times >= least - n_long) & (self.sizes[found] >= least) & (self.rule.least(self.sizes[found]) <= n)
        found, times = found[fits], times[fits]
        # Probe the long lists by binary search: each of them for all sets, or
        # all of them in each set's sorted shingles, whichever is fewer probes.
        if len(found) < len(long):
            wanted = np.sort(self.shingles[long])
            for i, j in enumerate(found):
                there = self.sets[j]
                times[i] += (there[np.minimum(np.searchsorted(there, wanted), len(there) - 1)] == wanted).sum()
        else:
            for i in long:
                entries = self.postings[self.edges[i]:self.edges[i + 1]]
                times += entries[np.minimum(np.searchsorted(entries, found), len(entries) - 1)] == found
        return found[self.rule.links(times, n, self.sizes[found])]


class Forest:
    """Merging of components inside one task."""

    def __init__(self, labels: list[int]):
        self.up = {x: x for x in labels}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int, edge: tuple[int, int]) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append(edge)


def _sets(rows: pa.Table, names: tuple[str, str] = ("class", "hashes")) -> tuple[list[int], list[np.ndarray]]:
    rows = rows.sort_by(names[0])
    return rows.column(names[0]).to_pylist(), [unpack(h, rising=True) for h in rows.column(names[1]).to_pylist()]


def link_inside(rule: Rule) -> Callable:
    """The label of each class of a unit: the smallest class it is linked with inside the unit."""

    def link(unit: pa.Table) -> pa.Table:
        classes, sets = _sets(unit)
        lists, forest = InvertedLists(classes, sets, rule), Forest(classes)
        for i, own in enumerate(sets):
            for j in lists.query(own):
                forest.join(classes[i], classes[j], (classes[i], classes[j]))
        return arrow_table([(c, forest.root(c)) for c in classes], LABELS)

    return link


# Routes between units.

def _entries(unit: pa.Table, buckets: int, whole: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], pa.Table, list[slice]]:
    """Distinct (token, label) of a unit sorted by bucket, those of each set, the sorted unit and the buckets' slices."""
    unit, tokens = _tokens(unit, whole)
    labels = unit.column("label").to_numpy()
    keys = _by_bucket(np.concatenate(tokens), buckets)
    of = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    names = np.unique(labels)
    label = np.searchsorted(names, labels)[of]
    order = np.lexsort((label, keys))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (label[order][1:] != label[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    keys, entry_labels = keys[order][new], names[label[order][new]]
    return (keys, entry_labels, np.split(number, np.cumsum([len(t) for t in tokens])[:-1]), unit,
            bucket_slices(keys >> np.uint64(TOKEN_BITS), buckets))


def send_entries(buckets: int, whole: bool) -> Callable:
    def send(unit: pa.Table) -> pa.Table:
        keys, labels, _, unit, slices = _entries(unit, buckets, whole)
        u = unit.column("u")[0].as_py()
        return arrow_table([(p, u, pack(keys[at] & np.uint64((1 << TOKEN_BITS) - 1), rising=True), pack(labels[at].view(np.uint64)))
                            for p, at in enumerate(slices) if at.stop > at.start], ENTRIES)

    return send


def find_routes(turn: int, everywhere: bool) -> Callable:
    """For each entry the units to which its sets may have to travel.

    Towards one unit of the token's smallest label, another one each turn, or
    (``everywhere``) to all later units that hold the token under another label.
    Every unit learns besides which of its entries' tokens have several labels.
    """

    def find(bucket: pa.Table) -> pa.Table:
        parts = [unpack(k, rising=True) for k in bucket.column("keys").to_pylist()]
        sizes = np.array([len(k) for k in parts])
        keys = np.concatenate(parts)
        labels = np.concatenate([unpack(x) for x in bucket.column("labels").to_pylist()]).view(np.int64)
        unit = np.repeat(np.array(bucket.column("u").to_pylist()), sizes)
        order = np.lexsort((mix64(unit + 1000003 * (turn + 1)), labels, keys))
        keys, labels, unit = keys[order], labels[order], unit[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = np.flatnonzero(new)
        end = np.append(first[1:], len(keys))
        token = np.cumsum(new) - 1
        several = (labels[first] != labels[end - 1])[token]
        if not everywhere:
            # The first entry of a token has its smallest label.
            of = first[token]
            go = np.flatnonzero((labels != labels[of]) & (unit != unit[of]))
            target = unit[of][go]
        else:
            open_ = np.flatnonzero(several)
            go, target = _later_units(token[open_], labels[open_], unit[open_])
            go = open_[go]
        # Back to the order in which the units sent their entries.
        bits = np.empty(len(order), bool)
        bits[order] = several
        go = order[go]
        rising = np.argsort(go, kind="stable")
        go, target = go[rising], target[rising]
        start = np.cumsum(sizes) - sizes
        p, rows = bucket.column("p")[0].as_py(), []
        for u, a, n, b, e in zip(bucket.column("u").to_pylist(), start, sizes, np.searchsorted(go, start),
                                 np.searchsorted(go, start + sizes)):
            if bits[a:a + n].any():
                rows.append((u, p, pack(go[b:e] - a, rising=True), pack(target[b:e]), pack_bits(bits[a:a + n])))
        return arrow_table(rows, ROUTES)

    return find


def _later_units(token: np.ndarray, labels: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, unit) for entries of tokens and later units that hold the token under another label."""
    order = np.lexsort((labels, unit, token))
    token, labels, unit = token[order], labels[order], unit[order]
    # One place for each unit of a token, with its smallest and largest label.
    new = np.ones(len(order), bool)
    new[1:] = (token[1:] != token[:-1]) | (unit[1:] != unit[:-1])
    first, place = np.flatnonzero(new), np.cumsum(new) - 1
    at, low, high = unit[first], labels[first], labels[np.append(first[1:], len(order))[: len(first)] - 1]
    begin, end = (np.searchsorted(token[first], token, side=side) for side in ("left", "right"))
    long = end - begin > LONG
    found = [(order[long], np.full(long.sum(), EVERYWHERE))]
    number = np.where(long, 0, end - place - 1)
    for a, b in portions(number, PORTION):
        entry, later = expand(place[a:b] + 1, number[a:b])
        fits = (low[later] != labels[a:b][entry]) | (high[later] != labels[a:b][entry])
        found.append((order[a:b][entry[fits]], at[later[fits]]))
    return tuple(np.concatenate(x) for x in zip(*found))


def keep_open(rule: Rule, buckets: int) -> Callable:
    """The sets that may still find a set of another label, with their tokens of several labels.

    Sets that link share the threshold's number of tokens, all of which have
    both sets' labels; labels only ever become one.
    """

    def keep(unit: pa.Table, routes: pa.Table) -> pa.Table:
        if not unit.num_rows or not routes.num_rows:
            return arrow_table([], OPEN)
        keys, _, of_set, unit, slices = _entries(unit, buckets, whole=False)
        several = np.zeros(len(keys), bool)
        for p, bits in zip(routes.column("p").to_pylist(), routes.column("mixed").to_pylist()):
            several[slices[p]] = unpack_bits(bits)
        rows = []
        for u, c, n, tokens, hashes, numbers in zip(*(unit.column(x).to_pylist() for x in ("u", "class", "n", "tokens", "hashes")), of_set):
            left = several[numbers]
            if left.sum() >= rule.threshold(n):
                rows.append((u, c, n, pack(unpack(tokens, rising=True)[left], rising=True), hashes))
        return arrow_table(rows, OPEN)

    return keep


def ship(rule: Rule, buckets: int, whole: bool) -> Callable:
    """The sets that travel, packed by target unit: where as many of their tokens may occur as they share with any partner."""

    def run(unit: pa.Table, routes: pa.Table) -> pa.Table:
        if not unit.num_rows or not routes.num_rows:
            return arrow_table([], SHIPPED)
        _, _, of_set, unit, slices = _entries(unit, buckets, whole)
        u = unit.column("u")[0].as_py()
        entry = np.concatenate([unpack(e, rising=True).astype(np.int64) + slices[p].start for e, p in
                                zip(routes.column("entry").to_pylist(), routes.column("p").to_pylist())])
        target = np.concatenate([unpack(t).astype(np.int64) for t in routes.column("target").to_pylist()])
        order = np.argsort(entry, kind="stable")
        # (EVERYWHERE is counted after all units.)
        entry, target = entry[order], np.minimum(target[order], buckets)
        low, high = (np.searchsorted(entry, np.arange(slices[-1].stop), side=side) for side in ("left", "right"))
        n = unit.column("n").to_numpy()
        least = rule.least(n) if whole else rule.threshold(n)
        goes: dict[int, list[int]] = {}
        for a, b in portions(np.array([buckets + (high[e] - low[e]).sum() for e in of_set]), PORTION):
            own = np.concatenate(of_set[a:b])
            of = np.repeat(np.arange(b - a), [len(e) for e in of_set[a:b]])
            i, at = expand(low[own], (high - low)[own])
            times = np.bincount(of[i] * (buckets + 1) + target[at], minlength=(b - a) * (buckets + 1)).reshape(b - a, -1)
            times, long = times[:, :buckets], times[:, buckets:]
            enough = least[a:b, None]
            fits = ((times > 0) & (times + long >= enough)) | ((long >= enough) & (np.arange(buckets) > u))
            for v, i in zip(*(x.tolist() for x in np.nonzero(fits.T))):
                goes.setdefault(v, []).append(a + i)
        labels, hashes = unit.column("label").to_pylist(), unit.column("hashes").to_pylist()
        return arrow_table([(v, pack(np.array([labels[i] for i in own], np.int64).view(np.uint64)),
                             pack(np.array([len(hashes[i]) for i in own])), b"".join(hashes[i] for i in own))
                            for v, own in goes.items()], SHIPPED)

    return run


def link_shipped(rule: Rule) -> Callable:
    """Links between a unit's sets and those that came, as a forest over labels."""

    def link(unit: pa.Table, shipped: pa.Table) -> pa.Table:
        if not unit.num_rows or not shipped.num_rows:
            return arrow_table([], EDGES)
        label = dict(zip(unit.column("class").to_pylist(), unit.column("label").to_pylist()))
        classes, sets = _sets(unit)
        own_label = np.array([label[c] for c in classes])
        lists, forest = InvertedLists(classes, sets, rule), Forest(own_label.tolist())
        for names, sizes, hashes in zip(*(shipped.column(n).to_pylist() for n in ("labels", "sizes", "hashes"))):
            at = 0
            for name, size in zip(unpack(names).view(np.int64).tolist(), unpack(sizes).tolist()):
                forest.up.setdefault(name, name)
                for other in np.unique(own_label[lists.query(unpack(hashes[at:at + size], rising=True))]).tolist():
                    forest.join(name, other, (name, other))
                at += size
        return arrow_table(forest.edges, EDGES)

    return link


def relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """(class, label) after the labels that ``found`` links have become one."""
    merged = components(found, "ngram").select(F.col("node").alias("label"), "component")
    return join_spreading_key(labels, merged, "label", ["class"]).select(
        "class", F.coalesce("component", "label").alias("label"))


def link_classes(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Documents (row_key, doc_id, text) -> (row_key, doc_id, class, n) and (class, component) of linked classes."""
    spark = docs.sparkSession
    n, scratch = shuffle_partitions(spark), Scratch(spark)
    described = scratch.stage(docs.select("row_key", "doc_id", "text").mapInArrow(describe(rule), SETS), "ngram-sets")
    known = described.filter("class is not null")
    unit = F.pmod(F.xxhash64("class"), F.lit(n)).cast("int")
    classes = known.groupBy("class").agg(F.min("row_key").alias("row_key"), F.first("n").alias("n"),
                                         F.first("tokens").alias("tokens")).withColumn("u", unit)
    classes = scratch.stage(classes, "ngram-classes")
    units = classes.select("u", "class", "n", "tokens")
    masks = units.groupBy("u").applyInArrow(send_tokens(n), SENT).groupBy("p").applyInArrow(find_shared, MASKS)
    candidates = scratch.stage(
        units.groupBy("u").cogroup(masks.groupBy("u")).applyInArrow(find_candidates(rule, n), CANDIDATES)
        .select("class").join(classes, "class"), "ngram-candidates")
    whole = (
        docs.select("row_key", "text").join(candidates.select("row_key"), "row_key")
        .mapInArrow(whole_sets(rule), WHOLE).groupBy("class").agg(F.first("hashes").alias("hashes"))
    )
    sets = scratch.stage(candidates.drop("row_key").join(whole, "class"), "ngram-candidate-sets")

    labels = scratch.stage(sets.groupBy("u").applyInArrow(link_inside(rule), LABELS), "ngram-labels")
    first = 0
    for turn in range(TURNS + 1):
        labelled = scratch.stage(sets.join(labels, "class").select("u", "class", "n", "tokens", "hashes", "label"),
                                 "ngram-labelled")
        everywhere = turn == TURNS or (turn > 0 and last * 10 <= first)
        # Of what is left for the last turn, every shingle counts: a common passage then sends no set anywhere.
        entries = labelled.select("u", "class", "hashes" if everywhere else "tokens", "label")
        routes = scratch.stage(entries.groupBy("u").applyInArrow(send_entries(n, everywhere), ENTRIES)
                               .groupBy("p").applyInArrow(find_routes(turn, everywhere), ROUTES), "ngram-routes")
        shipped = labelled.groupBy("u").cogroup(routes.groupBy("u")).applyInArrow(ship(rule, n, everywhere), SHIPPED)
        found = scratch.stage(labelled.groupBy("u").cogroup(shipped.groupBy("v")).applyInArrow(link_shipped(rule), EDGES),
                              "ngram-found")
        if turn and not everywhere:
            # (In the first turn every unit has labels of its own, and next to no set is done.)
            before, sets = sets, scratch.stage(labelled.groupBy("u").cogroup(routes.groupBy("u")).applyInArrow(
                keep_open(rule, n), OPEN), "ngram-open")
            scratch.drop(before)
        scratch.drop(labelled, routes)
        last = found.count()
        if last:
            before, labels = labels, scratch.stage(relabelled(labels, found), "ngram-labels")
            scratch.drop(before)
        scratch.drop(found)
        if everywhere:
            break
        first = first or last
    members = stage(described.drop("tokens"), "ngram-members")
    scratch.drop(described, classes, candidates, sets)
    return members, labels.withColumnRenamed("label", "component")


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def with_key(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").withColumn("row_key", row_key())


def join_report(docs: DataFrame, rule: Rule) -> DataFrame:
    members, linked = link_classes(with_key(docs), rule)
    named = members.join(linked, "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = named.filter("class is not null").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    return named.join(smallest, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"))


def one_of_each_group(docs: DataFrame, rule: Rule) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (rows without one come last).

    Documents without words stay as they are.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    keyed = rows.select("_row", F.col("_row.doc_id").cast("long").alias("doc_id"), F.col("_row.text").alias("text"))
    keyed = keyed.withColumn("row_key", row_key())
    members, linked = link_classes(keyed.drop("_row"), rule)
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_key")
    kept = (
        members.filter("class is not null").join(linked, "class", "left")
        .groupBy(F.coalesce("component", "class").alias("component")).agg(F.min(order).alias("kept"))
        .select("kept.row_key", "kept.without", F.coalesce("kept.doc_id", F.lit(0).cast("long")).alias("id"))
    )
    worded = F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False))
    held = keyed.filter(worded).select("_row", "row_key", F.col("doc_id").isNull().alias("without"),
                                       F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"))
    # Equal rows meet in the join's shuffle already; one of them stays.
    one = held.join(kept, ["row_key", "without", "id"]).dropDuplicates(["row_key", "without", "id"])
    return one.select("_row.*").unionByName(keyed.filter(~worded).select("_row.*"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_report(table(spark, sf_dir, "documents"), Rule(words=3, num=90, den=100))
