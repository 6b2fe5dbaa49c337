"""Ids, Huffman files and packing against the tokenizers library and exact round trips."""

import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm import tokens
from lodestar.llm.huffman import canonical_codes, code_lengths, decode, decoding_table, pack_bits, read_encoded, write_encoded
from lodestar.llm.packing import packed, sequences
from lodestar.llm.queries import tokenizer_path
from lodestar.llm.store import Scratch
from lodestar.llm.tokens import Encoder, encoder

END = 2


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def library(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [END]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbB'sStTdDmM .,;!?éÉ́İΣσKßẞ \u0085\x1c\x1f 中²½1239\n\t<|>-_힣가\U0001f600̸ǅª\x01", max_size=30))
def test_word_table_equals_library(text):
    e = encoder(tokenizer_path())
    assert e.exact_pieces
    assert e.text(text) == e.whole(text)


def test_new_words_take_few_calls():
    """Thousands of new words must not mean a call for each: these were most of the time of op2 and op5."""
    text, calls = " ".join(f"{a}{b}q{c}{'.,!'[c == 'b']}" for a in "abcdefghij" for b in "klmnopqrst" for c in "abcdefghijklmnopqrst"), []
    e = Encoder(tokenizer_path())
    sys.setprofile(lambda frame, event, arg: calls.append(1) if event in ("call", "c_call") else None)
    try:
        got = e.text(text)
    finally:
        sys.setprofile(None)
    assert got == e.whole(text)
    assert len(text.split()) == 2000 and len(calls) < 1000


def test_columns_equal_library_when_the_table_starts_afresh(monkeypatch):
    for name, value in (("TABLE_ENTRIES", 40), ("LONGEST_KEPT", 6), ("PIECES", 7)):
        monkeypatch.setattr(tokens, name, value)
    e = Encoder(tokenizer_path())
    end = np.array([END], e.dtype).tobytes()
    assert e.texts(pa.array([], pa.string()), end).to_pylist() == []
    for k in range(30):
        texts = [None, "", " \t", f"w{k}x, rare{k}é!! don't: «{k}»… 中{k}, Straße_{k}", f"<|endoftext|> {k}", "a</w>b </w>", f"longer-than-kept-{k} " * 3]
        assert e.texts(pa.array(texts, pa.string()), end).to_pylist() == [e.whole(t or "") + end for t in texts]
        assert len(e.known) <= 40
    assert e.texts(pa.array(["left out", "a b!", "c"])[1:], end).to_pylist() == [e.whole(t) + end for t in ("a b!", "c")]


def test_marks_are_composed_before_lower_case():
    e = Encoder(tokenizer_path())
    text = "T\u0308a H\u0331. E\u0301t W\u030a"  # t with these marks is one character, T is not
    assert e.text(text) == e.whole(text)


def test_added_tokens_in_texts():
    e = Encoder(tokenizer_path())
    text = "ab <|endoftext|> c<|startoftext|>d"
    assert e.text(text) == e.whole(text)


def test_other_tokenizers_take_the_library(tokenizer):
    import public_tokenizers

    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not e.exact_pieces
    assert e.text("Hello,  World") == e.whole("Hello,  World")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300), st.integers(9, 18))
def test_codes_are_prefix_free_and_limited(counts, bits):
    lengths = code_lengths(np.array(counts), bits)
    used = np.flatnonzero(counts)
    assert (lengths[np.array(counts) == 0] == 0).all() and (lengths[used] > 0).all()
    assert lengths.max(initial=0) <= bits
    assert sum(2.0 ** -float(x) for x in lengths[used]) <= 1


def test_limited_code_is_optimal_where_the_limit_is_loose():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    import heapq

    heap, cost = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((code_lengths(counts, 18).astype(int) * counts).sum()) == cost
    assert code_lengths(counts, 3).max() == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=2000), st.sampled_from([1, 7, 256]))
def test_round_trip_from_checkpoints(ids, every):
    ids = np.array(ids)
    lengths = code_lengths(np.bincount(ids, minlength=41))
    payload, at = pack_bits(canonical_codes(lengths)[ids], lengths[ids].astype(np.int64))
    starts = at[::every]
    counts = np.minimum(every, len(ids) - every * np.arange(len(starts)))
    table, width = decoding_table(lengths)
    assert (decode(payload, starts, counts, table, width) == ids).all()


def test_huffman_files_round_trip(spark, docs, tokenizer):
    path = Scratch(spark, "test").path
    write_encoded(docs, path, tokenizer)
    got = sorted(read_encoded(spark, path).collect(), key=lambda r: r["start"])
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    at = 0
    for g, r in zip(got, order, strict=True):
        ids = library(tokenizer, r["text"])
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r["doc_id"], at, len(ids), crc(ids))
        assert np.frombuffer(g["ids"], "<u4").tolist() == ids
        at += len(ids)


def test_huffman_empty_table(spark, docs, tokenizer):
    path = Scratch(spark, "test").path
    write_encoded(docs.limit(0), path, tokenizer)
    assert read_encoded(spark, path).collect() == []


@pytest.mark.parametrize("window", [16, 4096])
def test_packing_covers_every_id_once(docs, tokenizer, window):
    pieces = packed(docs, tokenizer, window=window)
    got = pieces.collect()
    want = sorted(crc(library(tokenizer, r["text"])) for r in docs.select("text").collect())
    by_sequence = {}
    for p in got:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        assert len(p["ids"]) == 2 * p["length"] and p["ids_crc32"] == crc(np.frombuffer(p["ids"], "<u2"))
    last = max(by_sequence)
    assert sorted(by_sequence) == list(range(last + 1))
    stream = []
    for s in range(last + 1):
        at = 0
        for p in sorted(by_sequence[s], key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
            stream.append(p)
        assert at == window or s == last
    docs_seen, held = [], []
    for p in stream:
        assert p["start"] == sum(len(x) // 2 for x in held)
        held.append(p["ids"])
        if p["start"] + p["length"] == p["doc_tokens"]:
            docs_seen.append(crc(np.frombuffer(b"".join(held), "<u2")))
            held = []
    assert held == [] and sorted(docs_seen) == want
    whole = {r["sequence_id"]: r["ids"] for r in sequences(pieces).collect()}
    assert all(whole[s] == b"".join(p["ids"] for p in sorted(by_sequence[s], key=lambda p: p["offset"])) for s in by_sequence)


def test_packing_empty_table(docs, tokenizer):
    assert packed(docs.limit(0), tokenizer).collect() == []
