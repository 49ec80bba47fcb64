"""Evaluation passages inside documents, by latent semantic retrieval and an exact alignment.

1. Items are cut into passages of PASSAGE words; words are weighted by inverse document frequency
   over all documents. A randomised SVD of the passage matrix (sums of partial products over the
   passages' partitions) gives the latent space.
2. Documents are cut into words once: a written table holds them as 64-bit keys, which every block of items reads. Each
   document is looked at in windows of WINDOW words. Windows whose weight lies too little in the
   items' vocabulary cannot reach the cosine (Cauchy-Schwarz), and windows without a single answer word
   cannot pass the last step; the others are compared with all passages in the latent space.
3. A candidate is aligned word by word with the item: the longest common subsequence with gap costs.
   Interruptions and altered words are allowed for; of each aligned passage the answers, that is numbers and
   words few items have, must agree, which a similar statement about something else does not.

Sentences of an item without any answer word (procedural formulas) do not count as its passages. A document
that repeats other sentences of the item does not make a sentence's words common, so a leak hides no item
however often it occurs; a formula, which comes without the rest of the item, stays one.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countlake.session import cut, spread

PASSAGE, PASSAGE_STEP = 24, 8
WINDOW, WINDOW_STEP = 32, 16
RANK, OVERSAMPLE, POWER_ROUNDS = 512, 32, 2
#: Passages multiplied at once.
CHUNK = 256
#: Least latent cosine of a candidate window.
CANDIDATE = 0.22
MIN_WORDS, MIN_SHARE = 14, 0.25
#: Agreeing words of a stretch that may be joined with another one, however far from it.
JOINED_WORDS = 6
#: Of an aligned passage at least these shares of all words and of the answer words must agree.
AGREE, ANSWERS = 0.75, 0.6
#: A word is an answer if it has a digit, or if at most this share of the items (or ANSWER_ITEMS) and
#: this share of the documents (or ANSWER_DOCUMENTS) have it.
ANSWER_SHARE, ANSWER_ITEMS = 0.01, 2
ANSWER_DOCUMENT_SHARE, ANSWER_DOCUMENTS = 0.003, 4
#: Successive words by which a document is seen to repeat a sentence of an item.
GRAM = 4
#: Items handled at once; their table is checked and worked off in blocks of this many. The driver holds the basis of one
#: block: words of its items (some 30,000) times RANK + OVERSAMPLE numbers, about 130 MB, two or three times over.
ITEM_BLOCK = 2000
#: Costs of the alignment in units of one agreeing word.
ALTERED, INTERRUPTED, PER_WORD, SKIPPED = -0.6, -1.2, -0.03, -1.2

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = str.maketrans(
    "аеорсхуіјѕкмтвнАВЕКМНОРСТХУІЅЈοανρικΑΒΕΗΙΚΜΝΟΡΤΧΥΖıԁԛԝһӏ",
    "aeopcxyijskmtbhABEKMHOPCTXYISJoavpikABEHIKMNOPTXYZidqwhl",
)
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿︀-️]")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_BREAK = re.compile(r"(\w)[-‐‑][ \t]*(?:\r\n|\r|\n)\s*(\w)")
_APOSTROPHE = re.compile(r"(?<=\w)['’ʼ‘`´](?=\w)")
_THOUSANDS = re.compile(r"(?<=\d)[\s.,]{1,2}(?=\d{3}(?!\d))")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[str]:
    """Words in a form that letter case, accents, punctuation, spacing, line breaks, markup and
    look-alike characters do not change."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = unicodedata.normalize("NFKD", text)
        text = _MARKS.sub("", text).translate(LOOK_ALIKES)
    text = _BREAK.sub(r"\1\2", text)
    text = _APOSTROPHE.sub("", text.casefold())
    return _WORD.findall(_THOUSANDS.sub("", text))


class _Keys(dict):
    """64-bit keys of words; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
        return got


_keys = _Keys()


def keys_of(words: Iterable[str]) -> np.ndarray:
    return np.fromiter((_keys[w] for w in words), np.int64)


def align(item: np.ndarray, text: np.ndarray) -> list[tuple[int, int, bool]]:
    """Best local alignment of two sequences of word numbers: (item position, text position, agree).

    Item numbers are >= 0; any other number in the text agrees with nothing. Words may be altered in place,
    words may be set into the text, and parts of the item may be skipped, each at its cost.
    """
    n, m = len(item), len(text)
    idx = np.arange(m + 1)
    score = np.zeros((n + 1, m + 1), np.float32)
    reach = np.zeros((n + 1, m + 1), np.float32)
    from_i, from_j = np.zeros((n + 1, m + 1), np.int32), np.zeros((n + 1, m + 1), np.int32)
    skip, skip_i = np.full(m + 1, -1e9, np.float32), np.zeros(m + 1, np.int32)
    for i in range(1, n + 1):
        h = np.zeros(m + 1, np.float32)
        h[1:] = reach[i - 1, :-1] + np.where(text == item[i - 1], 1.0, ALTERED)
        np.maximum(h, 0, out=h)
        score[i] = h
        stay = h >= skip + PER_WORD
        skip, skip_i = np.where(stay, h, skip + PER_WORD), np.where(stay, i, skip_i)
        left = np.where(skip_i == i, skip, skip + SKIPPED)
        run = np.maximum.accumulate(left - PER_WORD * idx)
        arg = np.maximum.accumulate(np.where(left - PER_WORD * idx >= run, idx, 0))
        gap = run + PER_WORD * idx + INTERRUPTED
        use = gap > left
        reach[i] = np.where(use, gap, left)
        from_j[i], from_i[i] = np.where(use, arg, idx), np.where(use, skip_i[arg], skip_i)
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    path = []
    while i > 0 and j > 0 and score[i, j] > 0:
        path.append((int(i) - 1, int(j) - 1, bool(text[j - 1] == item[i - 1])))
        if reach[i - 1, j - 1] <= 0:
            break
        i, j = from_i[i - 1, j - 1], from_j[i - 1, j - 1]
    return path[::-1]


def passages_found(path: list[tuple[int, int, bool]], answer: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(words, agreeing, first and last place in the item, first and last in the text) of the stretches of
    an alignment that hold up.

    An alignment is cut where item words are skipped; altered words at the ends of a stretch are
    trimmed. A stretch holds up if enough of its words and of its answers agree, and it has an answer.
    """
    parts, part = [], []
    for step in path:
        if part and step[0] != part[-1][0] + 1:
            parts.append(part)
            part = []
        part.append(step)
    parts.append(part)
    out = []
    for part in parts:
        agree = [k for k, s in enumerate(part) if s[2]]
        if not agree:
            continue
        part = part[agree[0] : agree[-1] + 1]
        same, asked = sum(s[2] for s in part), [s for s in part if answer[s[0]]]
        right = sum(s[2] for s in asked)
        if asked and same >= AGREE * len(part) and right >= ANSWERS * len(asked):
            out.append((len(part), same, part[0][0], part[-1][0], part[0][1], part[-1][1]))
    return sorted(out, reverse=True)


def _moved(stretches: list[tuple], i: int, j: int) -> list[tuple]:
    return [(n, same, a + i, b + i, c + j, d + j) for n, same, a, b, c, d in stretches]


def best_two(item: np.ndarray, answer: np.ndarray, text: np.ndarray, need: float) -> tuple[int, list[tuple]]:
    """(words of the two best stretches of the best alignment, all stretches that may be joined).

    If need is not reached, what lies before the alignment in both and what lies after it is aligned as well:
    a gap that is too dear for one alignment may part two passages.
    """
    path = align(item, text)
    held = passages_found(path, answer)
    words = sum(x[0] for x in held[:2])
    held = [x for x in held if x[1] >= JOINED_WORDS]
    if held and words < need:
        (i, j, _), (i2, j2, _) = path[0], path[-1]
        more = _moved(passages_found(align(item[i2 + 1 :], text[j2 + 1 :]), answer[i2 + 1 :]), i2 + 1, j2 + 1)
        more += passages_found(align(item[:i], text[:j]), answer[:i])
        held = held + [x for x in more if x[1] >= JOINED_WORDS]
    return words, held


def joined(stretches: list[tuple]) -> int:
    """Words of the two stretches that are in order in item and text and have most words."""
    return max((a[0] + b[0] for a in stretches for b in stretches if a[3] < b[2] and a[5] < b[4]), default=0)


@dataclass
class ItemIndex:
    """A block of items, ready for search; it is what the tasks receive."""

    ids: list[int]
    words: list
    answers: list[np.ndarray]
    sizes: list[int]
    vocab: dict[str, int]
    idf: np.ndarray | None = None
    unknown: float = 0.0
    project: np.ndarray | None = None
    latent: np.ndarray | None = None
    owner: np.ndarray | None = None
    asked: np.ndarray | None = None
    sorted_keys: np.ndarray | None = None
    sorted_at: np.ndarray | None = None

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> ItemIndex:
        """The items with their sentences; ``settle`` has to follow."""
        out = cls([], [], [], [], {})
        for item_id, text in rows:
            sentences = [words_of(s) for s in _SENTENCE.split(text)]
            if any(sentences):
                out.ids.append(item_id)
                out.sizes.append(sum(map(len, sentences)))
                out.words.append([np.array([out.vocab.setdefault(w, len(out.vocab)) for w in ws], np.int32) for ws in sentences if ws])
        keys = keys_of(out.vocab)
        out.sorted_at = np.argsort(keys, kind="stable")
        out.sorted_keys = keys[out.sorted_at]
        return out

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Word numbers of keys, -1 for words no item has."""
        if not len(self.sorted_keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.sorted_keys, keys), len(self.sorted_keys) - 1)
        return np.where(self.sorted_keys[at] == keys, self.sorted_at[at], -1)

    def settle(self, df: np.ndarray, own: np.ndarray, total: int, item_share: dict[str, int], items: int) -> ItemIndex:
        """Weights and answer words from the counts over all documents and items; drops plain sentences.

        own: of the documents of df, those that have the word from a leaked item.
        """
        self.idf = np.log((total + 1) / (df + 1)) + 0.1
        # a word no item has is as rare as an average one that items have
        self.unknown = float(np.average(self.idf, weights=df + 1))
        rare, few = max(ANSWER_ITEMS, ANSWER_SHARE * items), max(ANSWER_DOCUMENTS, ANSWER_DOCUMENT_SHARE * total)
        self.asked = np.array([any(c.isdigit() for c in w) or (item_share.get(w, 0) <= rare and df[i] - own[i] <= few) for w, i in self.vocab.items()], bool)
        kept = [[s for s in sentences if self.asked[s].any()] for sentences in self.words]
        use = [k for k, sentences in enumerate(kept) if sentences]
        self.ids, self.sizes = [self.ids[k] for k in use], [self.sizes[k] for k in use]
        self.words = [np.concatenate(kept[k]) for k in use]
        self.answers = [self.asked[ws] for ws in self.words]
        return self

    def passages(self) -> list[tuple[int, np.ndarray]]:
        out = []
        for k, ws in enumerate(self.words):
            starts = range(0, max(1, len(ws) - PASSAGE + PASSAGE_STEP), PASSAGE_STEP)
            out += [(k, ws[s : s + PASSAGE]) for s in starts]
        return out

    def weights(self, ws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words of a passage and their normalised weights."""
        w, n = np.unique(ws, return_counts=True)
        x = (1 + np.log(n)) * self.idf[w]
        return w, x / max(np.sqrt((x * x).sum()), 1e-12)

    def candidates(self, ids: np.ndarray, idf: np.ndarray) -> dict[int, list[int]]:
        """Items with a window of the text at or above the candidate cosine: item -> window starts."""
        n = len(ids)
        starts = np.arange(0, max(1, n - WINDOW + WINDOW_STEP), WINDOW_STEP)
        energy = np.r_[0, np.cumsum(idf * idf)]
        inside = np.r_[0, np.cumsum(np.where(ids >= 0, idf * idf, 0))]
        ends = np.minimum(starts + WINDOW, n)
        share = (inside[ends] - inside[starts]) / np.maximum(energy[ends] - energy[starts], 1e-12)
        answers = np.r_[0, np.cumsum((ids >= 0) & self.asked[ids])]
        # repeated words weigh a little more than counted here: a margin of two covers it; and a
        # window without any answer word cannot hold a passage that the answer check accepts
        todo = np.nonzero((share >= CANDIDATE**2 / 2) & (answers[ends] > answers[starts]))[0]
        if not len(todo):
            return {}
        rows, norms = np.zeros((len(todo), self.project.shape[1]), np.float32), np.zeros(len(todo))
        for r, t in enumerate(todo):
            part, weight = ids[starts[t] : ends[t]], idf[starts[t] : ends[t]]
            known = part >= 0
            w, c = np.unique(part[known], return_counts=True)
            x = (1 + np.log(c)) * self.idf[w]
            rows[r] = x.astype(np.float32) @ self.project[w]
            norms[r] = np.sqrt((x * x).sum() + (weight[~known] ** 2).sum())
        cos = (rows @ self.latent.T) / np.maximum(norms, 1e-12)[:, None]
        found: dict[int, list[int]] = {}
        for r, p in zip(*np.nonzero(cos >= CANDIDATE)):
            found.setdefault(int(self.owner[p]), []).append(int(starts[todo[r]]))
        return found

    def leaked(self, text: str) -> list[tuple[int, int]]:
        """(item_id, words held) of the items the text holds enough of."""
        return self.leaked_keys(keys_of(words_of(text)))

    def leaked_keys(self, keys: np.ndarray) -> list[tuple[int, int]]:
        """The same for the keys of a text's words."""
        if len(keys) < MIN_WORDS:
            return []
        ids = self.numbers(keys).astype(np.int32)
        idf = np.where(ids >= 0, self.idf[ids], self.unknown)
        out = []
        for k, hits in self.candidates(ids, idf).items():
            item, answer = self.words[k], self.answers[k]
            # the parts of the text around the candidate windows, far ones apart
            spans: list[list[int]] = []
            for s in sorted(set(hits)):
                lo, hi = max(0, s - len(item) - 80), min(len(ids), s + WINDOW + len(item) + 80)
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            best, need, held = 0, max(MIN_WORDS, MIN_SHARE * self.sizes[k]), set()
            # a passage too short for a candidate window is looked for in the whole text once another is found
            for around in (spans, [[0, len(ids)]]):
                for lo, hi in around:
                    for a in range(lo, hi, 3000):
                        part = ids[a : min(hi, a + 4000)]
                        # cheap bound: a stretch has an answer
                        if not np.isin(item[answer], part).any():
                            continue
                        words, more = best_two(item, answer, part, need)
                        best = max(best, words)
                        held.update(_moved(more, 0, a))
                best = max(best, joined(list(held)))
                if best >= need or not held or spans == [[0, len(ids)]]:
                    break
            if best >= need:
                out.append((self.ids[k], best))
        return out


class Repeats:
    """Finds the words of a document that a leaked item explains."""

    def __init__(self, words: list[list[np.ndarray]]):
        self.sentences = [s for ws in words for s in ws]
        self.item = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
        start = np.r_[0, np.cumsum([len(s) for s in self.sentences])]
        self.sentence_at = np.repeat(np.arange(len(self.sentences)), np.diff(start))
        keys = [self._grams(s) for s in self.sentences]
        at = np.concatenate([start[k] + np.arange(len(g)) for k, g in enumerate(keys)]) if keys else np.zeros(0, np.int64)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order]

    @staticmethod
    def _grams(ids: np.ndarray) -> np.ndarray:
        n = max(0, len(ids) - GRAM + 1)
        key = np.zeros(n, np.uint64)
        for i in range(GRAM):
            key = key * np.uint64(0x9E3779B97F4A7C15) + (ids[i : i + n].astype(np.int64) + 2).astype(np.uint64)
        return key

    def explained(self, ids: np.ndarray) -> np.ndarray:
        """Words of the sentences whose item the document repeats, by MIN_WORDS words of its other sentences."""
        grams = np.unique(self._grams(ids))
        lo, hi = np.searchsorted(self.keys, grams), np.searchsorted(self.keys, grams, "right")
        at = np.concatenate([self.at[a:b] for a, b in zip(lo[hi > lo], hi[hi > lo])] or [np.zeros(0, np.int64)])
        held = np.unique(at[:, None] + np.arange(GRAM))  # places of item words
        if len(held) < MIN_WORDS:
            return np.zeros(0, np.int64)
        per_sentence = np.bincount(self.sentence_at[held], minlength=len(self.sentences))
        per_item = np.bincount(self.item, weights=per_sentence)
        leaked = np.nonzero(per_item[self.item] - per_sentence >= MIN_WORDS)[0]
        return np.unique(np.concatenate([self.sentences[k] for k in leaked])) if len(leaked) else np.zeros(0, np.int64)


def word_table(rows: DataFrame, id_column: str) -> DataFrame:
    """(id, words): the words of each text, in order, as 64-bit keys; a written table, so no text is cut up twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [keys_of(words_of(t)) if t else np.zeros(0, np.int64) for t in batch.column(1).to_pylist()]
            ends = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "words"])

    texts = rows.where(f"{id_column} is not null and text is not null").select(F.col(id_column).cast("long").alias("id"), "text")
    return cut(spread(texts).mapInArrow(run, "id long, words array<bigint>"), "leak-words")


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    flat, ends = np.asarray(column.values), np.asarray(column.offsets)
    for a, b in zip(ends, ends[1:]):
        yield flat[a:b]


def _document_frequencies(words: DataFrame, index: ItemIndex) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents that have each word of the vocabulary, those of them that a leaked item explains, and
    documents with text, over all rows."""
    size, repeats = len(index.vocab), Repeats(index.words)
    known = index  # before settle it holds words and keys only

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, own, total = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for keys in _lists(batch.column(0)):
                total += 1
                ids = known.numbers(keys)
                has = np.unique(ids[ids >= 0])
                n[has] += 1
                own[np.intersect1d(has, repeats.explained(ids), assume_unique=True)] += 1
        n[-1] = total
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(own[at])], names=["word", "n", "own"])

    parts = words.select("words").mapInArrow(count, "word long, n long, own long")
    df, own = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    for r in parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("own").alias("own")).collect():  # at most one row per word of the block
        df[r.word], own[r.word] = r.n, r.own
    return df[:-1], own[:-1], int(df[-1])


def _item_shares(item_words: DataFrame, index: ItemIndex) -> dict[str, int]:
    """Items (of all) that have each word of the block."""
    spark = item_words.sparkSession
    vocab = list(index.vocab)
    mine = spark.createDataFrame(pa.table({"key": pa.array(keys_of(vocab)), "word": pa.array(vocab)}))
    rows = item_words.join(mine, "key").select("word", "n").collect()  # at most one row per word of the block
    return {r.word: r.n for r in rows}


def _passage_table(spark, index: ItemIndex) -> tuple[DataFrame, list]:
    passages = index.passages()
    weighted = [index.weights(ws) for _, ws in passages]
    rows = [(i, w.tolist(), x.tolist()) for i, (w, x) in enumerate(weighted)]
    return spark.createDataFrame(rows, "passage long, words array<int>, weights array<double>").repartition(4, "passage"), passages


def randomised_svd(passages: DataFrame, width: int, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """width x rank: the leading right singular vectors of the sparse passage matrix.

    Every round sends the current basis to the tasks, sums A'(A Q) over the passages' partitions and
    orthonormalises the width x (rank + OVERSAMPLE) result; the last round's Gram matrix rotates it.
    """
    rank = min(rank, width)
    basis = np.random.default_rng(seed).standard_normal((width, min(width, rank + OVERSAMPLE))).astype(np.float32)

    def product(q: np.ndarray, gram: bool) -> np.ndarray:
        shape = (q.shape[1], q.shape[1]) if gram else q.shape

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape, np.float64)
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    words, weights = (batch.column(c).slice(at, CHUNK) for c in ("words", "weights"))
                    dense = np.zeros((len(words), width), np.float32)
                    dense[np.repeat(np.arange(len(words)), np.asarray(words.value_lengths())), np.asarray(words.flatten())] = np.asarray(weights.flatten())
                    y = dense @ q
                    out += (y if gram else dense).T @ y
            yield pa.RecordBatch.from_arrays([pa.array([out.astype(np.float32).tobytes()], pa.binary())], names=["sum"])

        total = np.zeros(shape)
        for r in passages.mapInArrow(part, "sum binary").toLocalIterator():  # one partial sum at a time, of few partitions
            total += np.frombuffer(r["sum"], np.float32).reshape(shape)
        return total

    for _ in range(POWER_ROUNDS):
        basis = np.linalg.qr(product(basis, False))[0].astype(np.float32)
    values, turn = np.linalg.eigh(product(basis, True))
    return (basis @ turn[:, ::-1][:, :rank]).astype(np.float32)


def leaked_items(documents: DataFrame, items: DataFrame, block: int = ITEM_BLOCK, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, words): documents that hold enough of an item, and how many of its words.

    words counts the best two stretches in order, wherever in the text they are. Null ids and texts and empty texts match
    nothing; repeated rows give one row; other columns are ignored. Items are worked off in blocks (a bounded number of items against all documents), so the tasks' copy is bounded.
    """
    spark = documents.sparkSession
    its = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates(["item_id", "text"])
    n = its.count()
    blocks = max(1, math.ceil(n / block))
    its = its.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    words = spread(word_table(documents, "doc_id"))
    item_words = word_table(its, "item_id").select(F.explode(F.array_distinct("words")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    out = None
    for b in range(blocks):
        rows = [(r.item_id, r.text) for r in its.where(F.col("block") == b).orderBy("item_id", "text").collect()]
        index = ItemIndex.of(rows)
        if not index.ids:
            continue
        index.settle(*_document_frequencies(words, index), _item_shares(item_words, index), n)
        if not index.ids:
            continue
        passages, listed = _passage_table(spark, index)
        index.project = randomised_svd(passages, len(index.vocab), rank)
        index.owner = np.array([k for k, _ in listed])
        latent = np.stack([x.astype(np.float32) @ index.project[w] for w, x in (index.weights(ws) for _, ws in listed)])
        index.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        carried = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], carried=carried) -> Iterator[pa.RecordBatch]:
            index = carried.value
            for batch in batches:
                got = [(d, i, w) for d, keys in zip(batch.column(0).to_pylist(), _lists(batch.column(1))) for i, w in index.leaked_keys(keys)]
                cols = list(zip(*got)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "words"])

        found = words.select("id", "words").mapInArrow(search, "doc_id long, item_id long, words long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, words long")
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
