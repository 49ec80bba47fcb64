"""The transducer against the public library that defines the ids."""

import random

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from countlake.llm import tokenizer as tk

PATH = f"{tk.TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return tk.Encoder(PATH)


def texts(data):
    return [t for t in pq.read_table(f"{data}/documents.parquet")["text"].to_pylist() if t]


def test_documents(library, encoder, data):
    assert all(encoder.encode(t) == library(t) for t in texts(data))


ODD = ["", " ", "\n\n \t x", "it's 'll 'RE can't've", "<|endoftext|>", "​­ é \U0001f9d1‍\U0001f680", "a" * 3000, "ab" * 2000 + " " * 700 + "c", "1" * 999, "!?" * 900, "\r\n" * 500 + "é", "　  x", "١٢ 中文", "x" * 70000]


@pytest.mark.parametrize("text", ODD)
def test_odd(library, encoder, text):
    assert encoder.encode(text) == library(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_any_text(library, encoder, text):
    assert encoder.encode(text) == library(text)


@pytest.mark.parametrize("size", [40, 333, 5000])
def test_slices_do_not_matter(library, encoder, data, size, monkeypatch):
    monkeypatch.setattr(tk, "SLICE", size)
    monkeypatch.setattr(tk, "SHORT", 16)
    letters = "".join(c for t in texts(data)[:40] for c in t if c.isalpha())[:9000]
    pick = random.Random(size)
    many = ["".join(pick.choice(letters) for _ in range(1500)) for _ in range(8)]
    for text in [*texts(data)[:25], letters, *ODD[:-1], *many]:
        encoder.memory.clear()
        assert [i for part in encoder.stream(text[i : i + size] for i in range(0, len(text), size)) for i in part] == library(text)


def test_window_is_bounded(encoder):
    """What is held of an endless run does not grow, and tokens come out on the way."""
    seen = {"held": 0, "given": 0}
    merge = encoder.merges.merge

    def watch(data):
        seen["held"] = max(seen["held"], len(data))
        return merge(data)

    encoder.merges.merge = watch

    def endless():
        for _ in range(400):
            yield b"antidisestablishment" * 20

    first = None
    for _ in encoder.merges.feed(endless()):
        seen["given"] += 1
        first = first or seen["held"]
    encoder.merges.merge = merge
    assert seen["held"] <= 3 * encoder.merges.lookahead + tk.SHORT + 400 and first <= 2 * encoder.merges.lookahead + tk.SHORT + 400 and 0 < encoder.merges.lookahead < 2000


def test_decoder_round_trip(encoder, data):
    for t in [*texts(data)[:40], *ODD]:
        d = tk.ByteDecoder(encoder.merges)
        assert "".join(map(d.push, encoder.encode(t))) + d.end() == t


def test_operator(spark, library):
    rows = [(1, "Hello world", [7], "x"), (2, "", None, None), (3, None, None, None), (1, "Hello world", [7], "x"), (None, "a", None, None), (4, "é" * 9000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, lang string")
    got = tk.encode_texts(df)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    have = sorted((r.doc_id or -1, r.ids) for r in got.collect())
    assert have == sorted((r[0] or -1, library(r[1]) if r[1] else []) for r in rows)
    back = {r.doc_id: r.text for r in tk.decode_ids(got).collect()}
    assert back[4] == "é" * 9000 and back[3] == ""
    assert tk.encode_texts(df.limit(0)).count() == 0


def test_every_text_goes_through_the_transducer(library, data, monkeypatch):
    monkeypatch.setattr(tk, "SLICE", 64)
    encoder, fed, streamed = tk.Encoder(PATH), [], []
    feed, stream = encoder.merges.feed, encoder.stream
    encoder.merges.feed = lambda parts: fed.append(1) or feed(parts)
    encoder.stream = lambda slices: streamed.append(1) or stream(slices)
    many = texts(data)
    assert all(encoder.encode(t) == library(t) for t in many)
    # each text is streamed, and each run that is remembered was fed once
    assert len(streamed) == len(many) and len(fed) >= len(encoder.memory) > 0


def test_memory_of_a_long_text():
    """Beside the text and its ids (four bytes each) only a slice is held."""
    import tracemalloc

    encoder = tk.Encoder(PATH)
    encoder.encode("words and words of a speech. ")
    text = "words and words of a speech. " * 40_000 + "x" * 300_000
    tracemalloc.start()
    ids = encoder.encode_into(text, tk.array("i"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * 4 * len(ids) + 200 * tk.SLICE
