"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A text becomes symbols, one a character, with spaces as the space mark and one
mark in front. An agenda holds the adjacent pairs of symbols whose
concatenation is a piece, ordered by score (the highest first, then the
leftmost); the best pair is merged and its new neighbours enter the agenda,
until no pair is left. Characters without a piece become their byte pieces.

No piece of such a vocabulary holds a space mark behind another character
(checked when it is loaded; else a whole text is one segment), so no merge ever
crosses the front of a run of marks. Texts are therefore cut there, and each
distinct segment goes through the agenda once while it is remembered. Every
distinct segment's ids are compared with the sentencepiece library's in the
same Arrow batch (``check="texts"`` compares every whole text and its decoded
form instead); a difference fails the job, so a vocabulary of another kind
cannot give wrong ids silently.

``encode_texts`` maps Arrow batches without any shuffle. The vocabulary file
travels to the tasks as bytes, at most ``MAX_MODEL_BYTES``; a worker remembers
twice ``REMEMBERED`` segments of at most ``REMEMBERED_LENGTH`` characters and
forgets those not met for longest. It holds ``SLICE`` rows of a batch as Python strings
at a time.

Whole texts of any length are encoded. NULL and empty texts have no ids but
begin and end and decode to the empty text. Other columns are kept whatever
their name and type; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from worklens.llm.common import table

MODEL = "piece_bpe_32k.model"
MAX_MODEL_BYTES = 64 << 20
SLICE = 512
REMEMBERED, REMEMBERED_LENGTH = 500_000, 64
#: Segments that are compared with the library's ids at once.
CHECKED = 128
#: Runs of at most so many characters keep their agenda as a list, longer ones as a heap.
SHORT = 48
#: Agenda order of a pair that is no piece.
NO_PIECE = float("inf")
MARK = "▁"
#: What the library shows for the id of an unknown piece.
UNKNOWN = " ⁇ ".encode()


class Vocabulary:
    """Pieces, scores and byte pieces of one model file, and the library's processor for it."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(lib.get_piece_size())
        names = [lib.id_to_piece(i) for i in every]
        plain = [i for i in every if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        by_byte = {names[i]: i for i in every if lib.is_byte(i)}
        self.byte_ids = [by_byte.get(f"<0x{b:02X}>") for b in range(256)]
        if None in self.byte_ids:
            raise ValueError("the vocabulary has no byte pieces; characters without a piece need them")
        self.ids = {names[i]: i for i in plain}
        #: Agenda order of each piece: a smaller number is merged earlier.
        self.order = {names[i]: -lib.get_score(i) for i in plain}
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.cut = not any(MARK in n.lstrip(MARK) for n in self.ids)
        self.surface = [names[i].replace(MARK, " ").encode() for i in every]
        for i in every:
            if lib.is_control(i):
                self.surface[i] = b""
            elif lib.is_unknown(i):
                self.surface[i] = UNKNOWN
        for b, i in enumerate(self.byte_ids):
            self.surface[i] = bytes([b])
        self.bytes, self.controls = set(self.byte_ids), {i for i in every if lib.is_control(i)}
        self.marked = {i for n, i in self.ids.items() if n.startswith(MARK)}

    def merged(self, symbols: str) -> list[str]:
        """The pieces that the agenda of adjacent pairs leaves of a run of characters."""
        return self._merged_short(symbols) if len(symbols) <= SHORT else self._merged_long(symbols)

    def _merged_short(self, symbols: str) -> list[str]:
        """The agenda as a list in text order: of few pairs, the first best one is found soonest by looking at all."""
        order, none = self.order.get, NO_PIECE
        parts = list(symbols)
        agenda = [order(a + b, none) for a, b in zip(parts, parts[1:])]
        while agenda and (best := min(agenda)) < none:
            i = agenda.index(best)
            parts[i] = merged = parts[i] + parts.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = order(parts[i - 1] + merged, none)
            if i < len(agenda):
                agenda[i] = order(merged + parts[i + 1], none)
        return parts

    def _merged_long(self, symbols: str) -> list[str]:
        """The agenda as a heap: n symbols take n log n steps."""
        order = self.order
        n = len(symbols)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            if (o := order.get(symbols[i:i + 2])) is not None:
                agenda.append((o, i, i + 2))
        heapq.heapify(agenda)
        while agenda:
            _, left, stop = heapq.heappop(agenda)
            right = after[left]
            # A pair counts only while both its symbols are as they were when it was added.
            if end[left] < 0 or right >= n or end[right] != stop or end[left] != right:
                continue
            onward = after[right]
            end[left], after[left], end[right] = stop, onward, -1
            if onward < n:
                before[onward] = left
                if (o := order.get(symbols[left:end[onward]])) is not None:
                    heapq.heappush(agenda, (o, left, end[onward]))
            if (back := before[left]) >= 0 and (o := order.get(symbols[back:stop])) is not None:
                heapq.heappush(agenda, (o, back, stop))
        pieces, i = [], 0
        while i < n:
            pieces.append(symbols[i:end[i]])
            i = after[i]
        return pieces

    def segment_ids(self, segment: str) -> list[int]:
        """Ids of a run of characters in which spaces are marks."""
        pieces, ids = self.merged(segment), self.ids
        try:
            return [ids[p] for p in pieces]
        except KeyError:
            return [i for p in pieces for i in ([ids[p]] if p in ids else [self.byte_ids[b] for b in p.encode()])]

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return SEGMENT.findall(marked) if self.cut else [marked]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, with begin and end."""
        return [self.begin, *(i for s in self.segments(text) for i in self.segment_ids(s)), self.end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become spaces, the mark in front and control pieces go, bytes become characters."""
        surface = self.surface
        out = b"".join([surface[i] for i in ids])
        first = next((i for i in ids if i not in self.controls), None)
        if first in self.marked:
            out = out[1:]
        try:
            return out.decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids, first)

    def _decode_broken(self, ids: list[int], first: int | None) -> str:
        """As ``decode`` where byte pieces make no whole characters: each such byte becomes U+FFFD."""
        parts, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.bytes:
                run += self.surface[i]
                continue
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        parts.append(bytes(run[at:at + size]).decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    parts.append("�")
                    at += 1
            run.clear()
            if i is not None:
                parts.append(self.surface[i].decode())
        out = "".join(parts)
        return out[1:] if first in self.marked else out

    def check_segments(self, segments: list[str], ids: list[list[int]]) -> None:
        """Compare ids of segments with the library's: ``CHECKED`` of them as one text, behind a one-letter word.

        Segments of marks alone, which only end a text, end one here too.
        """
        pairs = list(zip(segments, ids))
        runs = [[pair] for pair in pairs if pair[0].endswith(MARK)]
        whole = [pair for pair in pairs if not pair[0].endswith(MARK)]
        runs += [whole[at:at + CHECKED] for at in range(0, len(whole), CHECKED)]
        lead = self.library.encode("a")
        for run in runs:
            own = [*lead, *chain.from_iterable(i for _, i in run)]
            text = "".join(s for s, _ in run)
            theirs = self.library.encode("a" + text.replace(MARK, " "))
            if own != theirs:
                raise ValueError(f"{text[:80]!r}: the agenda's {len(own)} ids differ from the library's {len(theirs)}")

    def check_text(self, text: str, ids: list[int], decoded: str) -> None:
        if self.library.encode(text, add_bos=True, add_eos=True) != ids or self.library.decode(ids) != decoded:
            raise ValueError(f"{text[:80]!r}: ids or decoded text differ from the library's")


SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")


class Memory(dict):
    """Segment -> its ids as little-endian unsigned 32-bit integers, kept between a worker's batches.

    What was used since the last ``REMEMBERED`` segments came in is here; the
    generation before is kept besides, and what is met again returns from it.
    """

    def __init__(self, vocabulary: Vocabulary, check: bool):
        super().__init__()
        self.vocabulary, self.check = vocabulary, check
        self.before: dict[str, bytes] = {}

    def learn(self, segments: set[str]) -> dict[str, bytes]:
        """Ids of all the segments; those not remembered go through the agenda and are checked together."""
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()
        unknown = segments.difference(self)
        again = unknown & self.before.keys()
        self.update((s, self.before[s]) for s in again)
        new = list(unknown - again)
        ids = [self.vocabulary.segment_ids(s) for s in new]
        if self.check and new and self.vocabulary.cut:
            self.vocabulary.check_segments(new, ids)
        packed = [np.array(i, "<u4").tobytes() for i in ids]
        long = {s: p for s, p in zip(new, packed) if len(s) > REMEMBERED_LENGTH}
        self.update((s, p) for s, p in zip(new, packed) if len(s) <= REMEMBERED_LENGTH)
        return long


_workers: dict[tuple[int, bool], Memory] = {}


def _memory(model: bytes, check: bool) -> Memory:
    """The worker's memory of one vocabulary; another vocabulary replaces it."""
    key = (hash(model), check)
    if key not in _workers:
        _workers.clear()
        _workers[key] = Memory(Vocabulary(model), check)
    return _workers[key]


def encoder(model: bytes, check: str):
    """mapInArrow function: (_row, _text) -> (_row, _ids, _decoded)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = None
        for whole in batches:
            memory = memory or _memory(model, check == "segments")
            vocabulary = memory.vocabulary
            begin, end = (np.array([i], "<u4").tobytes() for i in (vocabulary.begin, vocabulary.end))
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = [t or "" for t in batch.column("_text").to_pylist()]
                cut = [vocabulary.segments(t) for t in texts]
                long = memory.learn(set().union(*cut))
                packed, decoded = [], []
                for text, segments in zip(texts, cut):
                    known = map(memory.__getitem__, segments) if not long else [long.get(s) or memory[s] for s in segments]
                    packed.append(begin + b"".join(known) + end)
                    ids = np.frombuffer(packed[-1], "<u4").tolist()
                    decoded.append(vocabulary.decode(ids))
                    if check == "texts" or check == "segments" and not vocabulary.cut:
                        vocabulary.check_text(text, ids, decoded[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row"), pa.array(packed, pa.binary()), pa.array(decoded, pa.string())],
                    ["_row", "_ids", "_decoded"])

    return encode


def model_bytes(path: str) -> bytes:
    if (size := os.path.getsize(path)) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} has {size} bytes; the tasks get at most {MAX_MODEL_BYTES}")
    with open(path, "rb") as file:
        return file.read()


def encode_texts(docs: DataFrame, model: str, text: str = "text", check: str = "segments") -> DataFrame:
    """Every row of ``docs`` but its text as ``_row``, with ``_ids`` (begin and end included, packed as little-endian
    unsigned 32-bit integers) and ``_decoded`` (the text these ids decode to). ``check`` is "segments" or "texts"."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others).alias("_row"), F.col(f"`{text}`").alias("_text"))
    out = StructType([rows.schema["_row"], StructField("_ids", BinaryType()), StructField("_decoded", StringType())])
    return rows.mapInArrow(encoder(model_bytes(model), check), out)


def op13_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(MODEL)
    return piece_report(table(spark, sf_dir, "documents"), model)


def piece_report(docs: DataFrame, model: str, check: str = "segments") -> DataFrame:
    encoded = encode_texts(docs.select("doc_id", "text"), model, check=check)
    return encoded.select(
        "_row.doc_id", (F.octet_length("_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("_ids", 256).alias("ids_sha256"), F.sha2(F.col("_decoded").cast("binary"), 256).alias("decoded_sha256"))
