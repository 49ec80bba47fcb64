"""Byte-level BPE as a streaming transducer with bounded lookahead.

Text comes in slices. A regular run (letters, digits, other signs, white space) is cut off as soon as
no later character can change it; a run longer than a slice is passed on piece by piece. Within a run
the bytes go through ``MergeList.feed``: tokens are emitted once they end at least ``lookahead`` bytes
before the end of what has been read, since by then no later byte can change them. So neither a long
text nor a long run is ever held as a whole, but for its ids. Every text takes this one way; the ids of short
runs are remembered, as they recur. ``ByteDecoder`` is the inverse state machine.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countlake.session import spread

TOKENIZERS = "/opt/tokenizers"
#: Characters of a slice of text.
SLICE = 4096
#: Bytes of the parts in which a run is fed; runs of one part are remembered.
SHORT = 512
REMEMBERED = 400_000
#: Fixed values of the public vocabulary: what makes a run, and which bytes stand for themselves.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [(33, 126), (161, 172), (174, 255)]
CLASSES = [r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]", r"\s"]
#: The longest alternative that a later character can still complete: an apostrophe and two letters.
TAIL = 3


def byte_symbols() -> dict[str, int]:
    """The byte that each symbol of the vocabulary's spelling stands for."""
    own = [b for lo, hi in PRINTABLE for b in range(lo, hi + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeList:
    """Vocabulary and ranked merges of a byte-level BPE."""

    def __init__(self, source: str | bytes):
        """source: the path of a vocabulary file, or its content."""
        model = json.loads(Path(source).read_bytes() if isinstance(source, str) else source)["model"]
        symbol, vocab = byte_symbols(), model["vocab"]
        spell = lambda t: bytes(symbol[c] for c in t)
        self.bytes_of: dict[int, bytes] = {i: spell(t) for t, i in vocab.items() if all(c in symbol for c in t)}
        self.byte_id = [0] * 256
        for c, b in symbol.items():
            self.byte_id[b] = vocab[c]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault((vocab[a], vocab[b]), (r, vocab[a + b]))
        self.lookahead = self._sufficient_lookahead()

    def _sufficient_lookahead(self) -> int:
        """Bytes after a token within which everything lies that can decide whether it is formed.

        A merge (a, b) can be prevented only by a merge of smaller rank that takes the right edge of
        b, or of a part of b while b is being built; that merge in turn only by one of still smaller
        rank at its right edge, and so on. Ranks fall strictly, so the chains are finite; reach[t] is the
        furthest any chain of merges seen so far reaches beyond the right edge of t. One pass in
        order of rank extends all chains.
        """
        reach: dict[int, int] = {}
        built: dict[int, int] = {}  # reach of the chains that can disturb a token's own building
        longest = 0
        for (a, b), (_, made) in self.rank.items():
            length = len(self.bytes_of[b])
            # what can disturb b up to this rank: its own building, or a merge that takes b away
            edge = max(reach.get(b, 0), built.get(b, 0))
            built[made] = max(built.get(made, 0), edge)
            reach[a] = max(reach.get(a, 0), length + edge)
            longest = max(longest, length + edge)
        return longest

    def merge(self, data: bytes) -> list[int]:
        """Token ids of a whole run of bytes: the lowest-ranked pair, leftmost first, until none is left."""
        ids, rank = [self.byte_id[b] for b in data], self.rank
        if len(ids) < 2:
            return ids
        if len(ids) <= 24:
            while len(ids) > 1:
                best = min(((rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank), default=None)
                if best is None:
                    break
                i = best[1]
                ids[i : i + 2] = [rank[ids[i], ids[i + 1]][1]]
            return ids
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(rank[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or (ids[i], ids[j]) != p:
                continue
            ids[i], alive[j] = rank[p][1], False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := (ids[x], ids[y])) in rank:
                    heapq.heappush(heap, (rank[q][0], x, q))
        return [t for t, a in zip(ids, alive) if a]

    def feed(self, parts: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one run that comes in parts, in memory bounded by a part and the lookahead."""
        held = b""
        for part in parts:
            held += part
            if len(held) <= 2 * self.lookahead + SHORT:
                continue
            stable, end = len(held) - self.lookahead, 0
            for t in self.merge(held):
                size = len(self.bytes_of[t])
                if end + size > stable:
                    break
                end += size
                yield t
            held = held[end:]
        yield from self.merge(held)


class Encoder:
    """Texts to ids; remembers the ids of short runs."""

    def __init__(self, source: str | bytes):
        self.merges = MergeList(source)
        self.runs = regex.compile(RUNS)
        self.classes = [regex.compile(f"{c}*+") for c in CLASSES]
        merges = self.merges

        class Memory(dict):
            def __missing__(self, run: str) -> list[int]:
                data = run.encode("utf-8")
                ids = list(merges.feed(data[i : i + SHORT] for i in range(0, len(data), SHORT)))
                if len(data) <= SHORT:
                    if len(self) >= REMEMBERED:
                        self.clear()
                    self[run] = ids
                return ids

        self.memory = Memory()

    def encode(self, text: str) -> list[int]:
        return list(self.encode_into(text, array("i")))

    def encode_into(self, text: str, out: array) -> array:
        """Appends the ids of a text to out, four bytes each."""
        for part in self.stream(text[i : i + SLICE] for i in range(0, len(text), SLICE)):
            out.extend(part)
        return out

    def stream(self, slices: Iterable[str]) -> Iterator[list[int]]:
        """Ids of one text that comes in slices, as lists; they join to the ids of the whole text."""
        source, held = iter(slices), ""
        for piece in source:
            held += piece
            at = 0
            for m in self.runs.finditer(held):
                if m.end() > len(held) - TAIL:
                    break
                yield self.memory[m.group()]
                at = m.end()
            held = held[at:]
            if len(held) > SLICE:
                # one run fills what is held: pass its parts on until it ends
                yield from ([t] for t in self.merges.feed(self._long_run(held, source)))
                held = self.rest
        for run in self.runs.findall(held):
            yield self.memory[run]

    def _long_run(self, held: str, source: Iterator[str]) -> Iterator[bytes]:
        start = 1 if held[0] == " " and not held[1].isspace() else 0
        kind = next(c for c in self.classes if c.match(held, start).end() > start)
        end = kind.match(held, start).end()
        space = kind is self.classes[3]
        while end == len(held):
            # the last white space may belong to the next run
            cut = end - 1 if space else end
            yield held[:cut].encode("utf-8")
            held = held[cut:]
            piece = next(source, None)
            if piece is None:
                break
            held += piece
            end = kind.match(held).end()
        if end == len(held):
            yield held.encode("utf-8")
            self.rest = ""
            return
        cut = end - 1 if space else end
        yield held[:cut].encode("utf-8")
        self.rest = held[cut:]


class ByteDecoder:
    """Ids to text, one id at a time: text comes out as soon as its bytes are complete."""

    def __init__(self, merges: MergeList):
        self.bytes_of = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, token: int) -> str:
        return self.state.decode(self.bytes_of[token])

    def end(self) -> str:
        return self.state.decode(b"", True)


_kept: dict[bytes, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    key = hashlib.blake2b(model).digest()
    if key not in _kept:
        _kept[key] = Encoder(model)
    return _kept[key]


def encode_texts(documents: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every text exactly as stored, without special tokens.

    Empty and null texts give an empty list. One row comes out for every row that goes in, so repeated
    rows stay repeated and null ids stay; other columns are ignored. There is no shuffle, unless
    the table has fewer parts than there are cores. The vocabulary (one file, bounded) is read by the driver and shipped.
    """
    carried = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(carried.value)
        for batch in batches:
            ids, ends = array("i"), [0]
            for text in batch.column(1):  # one text at a time
                value = text.as_py()
                if value:
                    encoder.encode_into(value, ids)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(doc_id, text): the texts back from their ids; a null list gives a null text."""
    carried = encoded.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _encoder(carried.value).merges
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                decoder = ByteDecoder(merges)
                texts.append(None if ids is None else "".join(map(decoder.push, ids)) + decoder.end())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
