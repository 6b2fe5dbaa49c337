"""Token ids of whole texts, by the ``tokenizers`` library.

The library's BPE model costs microseconds for a word it has not met and most
words of a corpus repeat, so ids are kept for words without the symbols they end
in, looked up for the distinct words of a batch and found for the pieces of
those that are new. Arrow splits, numbers and joins words a batch at a time,
without a step of Python for each. That is exact for tokenizers whose pre-tokenizer drops white space
and never looks past it; any other tokenizer file, and any text or word outside
the characters for which the split is certain, takes the library's own
``encode``.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.store import batch

# The normalizer and pre-tokenizer for which pieces of words are exact.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: First byte of the characters from U+0240 on. Words with one of them go to the library whole (combining marks start at U+0300).
_UNSAFE_FROM = 0xC9
#: Symbols below those characters: neither letters nor numbers nor white space.
_SYMBOLS = "".join(c for c in map(chr, range(0x240)) if unicodedata.category(c)[0] not in "LNZ" and not c.isspace())
#: White space to Python but not to the tokenizer's patterns. Texts with these, or with the one letter that lower-cases to two characters, go whole.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Entries of the table; beyond that the half that was met in most batches stays.
TABLE_ENTRIES = 600_000
#: Longer entries (in bytes) are not kept.
LONGEST_KEPT = 48
#: Pieces that go to the library at once.
PIECES = 8192


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte that byte-level BPE vocabularies use."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(0x100 + n) for n, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


class Encoder:
    """``texts(column)``: for each text its ids as little-endian bytes of ``dtype``."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        self.exact_pieces = self._pieces_are_exact(spec)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.odd = (*self.added, *_SEPARATORS, "İ")
        # The model alone, for pieces spelled in the letters of its vocabulary and parted by spaces.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = "".join(" " if b == ord(" ") else x for b, x in enumerate(_byte_letters()))
        self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        if self.exact_pieces:
            suffix = spec["model"]["end_of_word_suffix"]
            self.last[[k for t, k in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.known = pa.array([], pa.large_string())
        self.known_ids = pa.array([], pa.large_binary())
        self.met = np.zeros(0, dtype=np.int32)

    @staticmethod
    def _pieces_are_exact(spec: dict) -> bool:
        model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        steps = pre.get("pretokenizers", [])
        suffix, vocabulary = model.get("end_of_word_suffix"), model.get("vocab", {})
        return (
            model.get("type") == "BPE"
            and not model.get("dropout")
            and not model.get("ignore_merges")
            and not model.get("continuing_subword_prefix")
            # Any piece has ids, and only its last one ends in the suffix: no piece has both the suffix's letter and its marks.
            and suffix == "</w>"
            and all(x in vocabulary and x + suffix in vocabulary for x in _byte_letters())
            and [n["type"] for n in norm.get("normalizers", [])] == _NORMALIZERS
            and norm["normalizers"][1].get("pattern") == {"Regex": r"\s+"}
            and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0].get("pattern") == {"Regex": _PATTERN}
            and steps[0].get("behavior") == "Removed"
            and bool(steps[0].get("invert"))
            and not steps[1].get("add_prefix_space")
            and steps[1].get("use_regex") is False
        )

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _pieces(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of distinct pieces, by the library's model."""
        found = []
        for at in range(0, len(pieces), PIECES):
            spelled = " ".join(pieces[at : at + PIECES].to_pylist()).encode().decode("latin-1").translate(self.letters)
            found.append(np.array(self.merges.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, dtype=self.dtype))
        ids = np.concatenate([np.zeros(0, dtype=self.dtype), *found])
        ends = np.zeros(len(pieces) + 1, dtype=np.int64)
        # An empty piece has no ids, and so no last one.
        ends[1 + np.flatnonzero(_lengths(pieces))] = np.flatnonzero(self.last[ids]) + 1
        return _cut(np.maximum.accumulate(ends) * self.dtype.itemsize, ids.tobytes())

    def _new(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of words that aren't known: those of their pieces."""
        alone = {k: self.whole(words[k].as_py()) for k in np.flatnonzero(_unsafe(words)).tolist()}
        words = _emptied(words, alone)
        mixed = pc.invert(pc.utf8_is_alpha(words))
        spaced = pc.replace_substring_regex(words.filter(mixed), pattern=f"({_PATTERN})", replacement=r"\1 ")
        return _joined(pc.split_pattern(pc.replace_with_mask(words, mixed, spaced), " "), self._pieces, alone)

    def _words(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of distinct words, by the table as far as they are known.

        The library composes marks, then lower-cases letter by letter, as Arrow
        does; words that may have marks keep their capitals. A word counts as
        two: itself without the symbols it ends in, and these. What stays ends
        in a letter or a number, so no piece has parts of both.
        """
        words = pc.if_else(pa.array(_unsafe(words)), words, pc.utf8_lower(words))
        bare = np.where(_unsafe(words), _lengths(words), _lengths(pc.utf8_rtrim(words, _SYMBOLS)))
        offsets = np.empty(2 * len(words) + 1, dtype=np.int64)
        offsets[::2] = _offsets(words)
        offsets[1::2] = offsets[:-1:2] + bare
        halves = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), words.buffers()[2] or pa.py_buffer(b""))
        n = len(self.known)
        both = pa.concat_arrays([self.known, halves]).dictionary_encode()
        listed, ids, places = both.dictionary, self.known_ids, both.indices[n:]
        if len(listed) > n:
            ids = pa.concat_arrays([ids, self._new(listed[n:])])
        found = ids.take(places)
        met = np.zeros(len(listed), dtype=np.int32)
        met[places.to_numpy()] = 1
        met[:n] += self.met
        self._keep(listed, ids, met)
        return _cut(_offsets(found)[::2], found.buffers()[2])

    def _keep(self, listed: pa.LargeStringArray, ids: pa.LargeBinaryArray, met: np.ndarray) -> None:
        stays = _lengths(listed) <= LONGEST_KEPT
        if stays.sum() > TABLE_ENTRIES:
            stays[np.argsort(np.where(stays, -met, 1), kind="stable")[TABLE_ENTRIES // 2 :]] = False
            met = met // 2
        if not stays.all():
            chosen = pa.array(np.flatnonzero(stays))
            listed, ids, met = listed.take(chosen), ids.take(chosen), met[stays]
        self.known, self.known_ids, self.met = listed, ids, met

    def _goes_whole(self, text: str) -> bool:
        return not self.exact_pieces or any(x in text for x in self.odd)

    def texts(self, column: pa.Array, end: bytes = b"") -> pa.LargeBinaryArray:
        """For each text its ids and then ``end``. A null text counts as empty."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        data = (column.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        alone = {}
        if not self.exact_pieces or any(x.encode() in data for x in self.odd):
            alone = {k: self.whole(t) for k, t in enumerate(column.to_pylist()) if self._goes_whole(t)}
        return _joined(pc.utf8_split_whitespace(_emptied(column, alone)), self._words, alone, end)

    def text(self, text: str) -> bytes:
        return self.texts(pa.array([text], pa.large_string()))[0].as_py()


def _offsets(strings: pa.Array) -> np.ndarray:
    """Where large strings begin and end in their buffer."""
    return np.frombuffer(strings.buffers()[1], dtype=np.int64)[strings.offset :][: len(strings) + 1] if len(strings) else np.zeros(1, dtype=np.int64)


def _lengths(strings: pa.LargeStringArray) -> np.ndarray:
    """Bytes of each string."""
    return pc.binary_length(strings).to_numpy(zero_copy_only=False)


def _unsafe(words: pa.LargeStringArray) -> np.ndarray:
    """Which of the words have a character from U+0240 on."""
    offsets, found = _offsets(words), np.zeros(len(words), dtype=bool)
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    found[np.searchsorted(offsets, offsets[0] + np.flatnonzero(data >= _UNSAFE_FROM), side="right") - 1] = True
    return found


def _cut(offsets: np.ndarray, data: pa.Buffer | bytes | None) -> pa.LargeBinaryArray:
    """The parts of ``data`` between ``offsets``."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(data or b"")])


def _emptied(strings: pa.LargeStringArray, at: dict[int, bytes]) -> pa.LargeStringArray:
    """``strings`` with empty ones at the positions ``at``."""
    if not at:
        return strings
    kept = np.ones(len(strings), dtype=bool)
    kept[list(at)] = False
    return pc.if_else(pa.array(kept), strings, pa.scalar("", pa.large_string()))


def _joined(parts: pa.ListArray, ids_of, alone: dict[int, bytes], end: bytes = b"") -> pa.LargeBinaryArray:
    """For each list of strings their ids one after the other and then ``end``.

    ``ids_of`` gives the ids of distinct strings; ``alone`` has the ids of rows
    that go whole, by position, whose lists have no ids.
    """
    seen, at = parts.values.dictionary_encode(), parts.offsets.to_numpy()
    table = pa.concat_arrays([ids_of(seen.dictionary), pa.array([end, *(x + end for x in alone.values())], pa.large_binary())])
    last = np.full(len(parts), len(seen.dictionary))
    last[list(alone)] = len(seen.dictionary) + 1 + np.arange(len(alone))
    made = table.take(pa.array(np.insert(seen.indices.to_numpy(), at[1:], last)))
    return _cut(_offsets(made)[at + np.arange(len(at))], made.buffers()[2])


def id_type(vocabulary: int) -> np.dtype:
    """The narrowest little-endian type for ids below ``vocabulary``."""
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; its word table lives as long as the worker."""
    return Encoder(path)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``part, local_start, doc_id, n_tokens, ids``.

    ``ids`` are the text's ids and then ``end_id``, as little-endian bytes of
    ``id_type``. ``part`` is the task that made the row and ``local_start`` the
    number of ids before the row in that task. Both only mean something once
    the rows are stored: write the frame to scratch before it is used, so that
    all readers see one numbering. A null text counts as empty; other columns
    of ``docs`` are not read; an empty table gives no rows.
    """
    id_field = docs.schema[id_col].dataType
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def encode(batches):
        enc, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for b in batches:
            ids = enc.texts(b.column(1), end)
            n = pc.binary_length(ids).to_numpy() // enc.dtype.itemsize
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            schema = pa.schema([("part", pa.int32()), ("local_start", pa.int64()), ("doc_id", b.schema.field(0).type), ("n_tokens", pa.int64()), ("ids", pa.binary())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), b.column(0), pa.array(n), ids.cast(pa.binary())], schema=schema)
        # Workers are kept for later stages; what batches took would stay with them.
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(encode, f"part int, local_start bigint, doc_id {id_field.simpleString()}, n_tokens bigint, ids binary")


def part_starts(stored: DataFrame, length: str = "n_tokens") -> dict[int, int]:
    """First pass of the prefix sum: the ids before each ``part``.

    One total for each task that wrote the table comes to the driver, so its
    size goes by the number of tasks and not by the rows.
    """
    totals = sorted((r[0], r[1]) for r in stored.groupBy("part").agg(F.sum(length)).collect())
    starts, at = {}, 0
    for part, total in totals:
        starts[part] = at
        at += total
    return starts


__all__ = ["Encoder", "batch", "encoder", "id_type", "part_starts", "tokenized", "vocabulary_size"]
