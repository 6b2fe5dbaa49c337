"""Language identification with Bloom filters whose slots are language bitmasks.

One Bloom filter for each language, bit-sliced: slot ``i`` of all filters is one
integer with a bit for each language (beyond 64 languages, one of several integers). The conjunction of an n-gram's slots is
then the set of languages that contain it. A text's n-grams give a popcount for
each language; as a filter also answers yes by chance, with a rate known from
its fill, the count is corrected before the languages are compared.

The filters are fitted on a sample of labelled rows of at most about
``ROWS_PER_LANGUAGE`` for each language (all of them where there are fewer); the
sample goes by a hash of the row's id. Prediction reads every text whole and
nothing but the text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.store import batch, rows

#: Bound of the fitted sample.
ROWS_PER_LANGUAGE = 4000
#: Slots of the filters and slots of an n-gram.
SLOTS, HASHES = 1 << 19, 3
#: Lengths of n-grams; the ends may lie on a word's border.
LENGTHS = (3, 4)
#: An n-gram belongs to a language if it has this count in its sample, and this share of its rate where it is most frequent.
LEAST_COUNT, LEAST_SHARE = 3, 0.1
#: Code points worked off at once.
STEP = 400_000
#: Languages of a mask.
WORD = 64

UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _code_points(text: str) -> np.ndarray:
    """Lower-case code points with 0 for what isn't a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(_letters()[points], points, 0)


def _grams(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams whose inner part has only letters, and the places of their second code points."""
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inner = points[1 : 1 + size] != 0
    for k in range(2, n - 1):
        inner &= points[k : k + size] != 0
    at = np.flatnonzero(inner)
    h = np.full(len(at), n, dtype=np.uint64)
    for k in range(n):
        h = (h ^ points[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h, at + 1


def _slots(h: np.ndarray) -> list[np.ndarray]:
    """The slots of n-gram hashes: disjoint bits of a remixed hash."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mask = np.uint64(SLOTS - 1)
    return [(h >> np.uint64(44 - 20 * k) & mask).astype(np.int64) if k < 2 else ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40) & mask).astype(np.int64) for k in range(HASHES)]


def _segments(texts: list[str | None]):
    """The texts' code points, one after the other with borders between them, in steps of bounded size: points, text indexes."""
    held, size = [], 0
    for k, t in enumerate(texts):
        if not t:
            continue
        points = np.concatenate([[0], _code_points(t), [0]])
        for at in range(0, max(1, len(points) - 2), STEP):
            # The overlap lets each n-gram begin in exactly one segment.
            piece = points[at : at + STEP + max(LENGTHS) - 1]
            if size + len(piece) > STEP and held:
                yield _joined(held)
                held, size = [], 0
            held.append((k, piece, min(STEP, len(points) - at)))
            size += len(piece)
    if held:
        yield _joined(held)


def _joined(held):
    gap = np.zeros(max(LENGTHS), dtype=np.int64)
    points = np.concatenate([x for _, p, _ in held for x in (p, gap)])
    owner = np.concatenate([np.full(len(p) + len(gap), k) for k, p, _ in held])
    starts = np.concatenate([np.concatenate([np.arange(len(p)) < n, np.zeros(len(gap), bool)]) for _, p, n in held])
    return points, owner, starts


@dataclass(frozen=True)
class Filters:
    """Fitted filters: the languages in order of their bits, the slots (a row for every ``WORD`` languages), the false-positive rate of each language."""

    languages: tuple[str, ...]
    slots: np.ndarray
    rates: np.ndarray

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the n-grams found in each language, and all its n-grams."""
        found = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        for points, owner, starts in _segments(texts):
            for n in LENGTHS:
                h, at = _grams(points, n)
                keep = starts[at - 1]
                h, who = h[keep], owner[at[keep]]
                total += np.bincount(who, minlength=len(texts))
                places = _slots(h)
                for word, slots in enumerate(self.slots):
                    mask = slots[places[0]]
                    for x in places[1:]:
                        mask &= slots[x]
                    for k in range(min(WORD, len(self.languages) - WORD * word)):
                        found[:, WORD * word + k] += np.bincount(who[(mask >> np.uint64(k) & np.uint64(1)).astype(bool)], minlength=len(texts))
        return found, total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; the score is the share of its n-grams that are the language's."""
        found, total = self.counts(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        n = np.maximum(total, 1)[:, None]
        share = np.clip((found / n - self.rates) / (1 - self.rates), 0, 1)
        best = share.argmax(axis=1)
        letters = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
        return names, [float(share[k, b]) if ok else 0.0 for k, (b, ok) in enumerate(zip(best, letters, strict=True))]


def fit(labelled: DataFrame, key: Column, text: Column, lang: Column, rows_per_language: int = ROWS_PER_LANGUAGE) -> Filters:
    """Filters from labelled rows; rows without a label or text take no part.

    A row is in the sample if a hash of ``key`` is low enough for its
    language's share, so that the sample is the same in every run.
    """
    source = labelled.select(key.cast("string").alias("key"), text.cast("string").alias("text"), lang.alias("lang")).where("lang is not null and text is not null and key is not null")
    sizes = {r["lang"]: r["n"] for r in source.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    languages = tuple(sizes)
    if not languages:
        return Filters((), np.zeros((0, SLOTS), np.uint64), np.zeros(0))
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, rows_per_language / n))) for x, n in sizes.items()])
    sample = source.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share * (1 << 30)).select("text", "lang")

    def count(batches):
        for b in rows(batches, 256):
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            number = np.array([languages.index(x) for x in langs])
            for points, owner, starts in _segments(texts):
                for n in LENGTHS:
                    h, at = _grams(points, n)
                    keep = starts[at - 1]
                    h, who = h[keep], number[owner[at[keep]]]
                    for k in np.unique(who):
                        grams, times = np.unique(h[who == k], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.full(len(grams), k, np.int32)), pa.array(times)], names=["gram", "lang", "n"])

    counted = sample.mapInArrow(count, "gram bigint, lang int, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    by_gram = counted.groupBy("gram").agg(*[F.sum(F.when(F.col("lang") == k, F.col("n"))).alias(f"n{k}") for k in range(len(languages))])
    scratch = _stored(labelled.sparkSession, by_gram)
    totals = scratch.agg(*[F.sum(f"n{k}").cast("double").alias(f"t{k}") for k in range(len(languages))]).first()
    rates = [F.coalesce(F.col(f"n{k}") / F.lit(totals[k] or 1.0), F.lit(0.0)) for k in range(len(languages))]
    top = F.greatest(*rates, F.lit(0.0))
    words = [F.lit(0).cast("bigint") for _ in range(0, len(languages), WORD)]
    for k, r in enumerate(rates):
        bit = F.when((F.col(f"n{k}") >= LEAST_COUNT) & (r >= LEAST_SHARE * top), F.lit(_signed(1 << k % WORD))).otherwise(F.lit(0)).cast("bigint")
        words[k // WORD] = words[k // WORD].bitwiseOR(bit)

    def spread(batches):
        for b in batches:
            at = np.concatenate(_slots(b.column(0).to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.tile(c.to_numpy(), HASHES)) for c in b.columns[1:])], names=["slot", *b.schema.names[1:]])

    names = [f"m{w}" for w in range(len(words))]
    masks = scratch.select("gram", *[m.alias(n) for m, n in zip(words, names, strict=True)]).where(" or ".join(f"{n} <> 0" for n in names))
    filled = masks.mapInArrow(spread, ", ".join(["slot bigint", *(f"{n} bigint" for n in names)])).groupBy("slot").agg(*[F.bit_or(n).alias(n) for n in names])
    slots = np.zeros((len(names), SLOTS), dtype=np.uint64)
    got = filled.toArrow()  # at most SLOTS rows
    for w, n in enumerate(names):
        slots[w, got.column("slot").to_numpy()] = got.column(n).to_numpy().view(np.uint64)
    fill = np.array([(slots[k // WORD] >> np.uint64(k % WORD) & np.uint64(1)).mean() for k in range(len(languages))])
    return Filters(languages, slots, np.minimum(fill**HASHES, 0.99))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    from lodestar.llm.store import Scratch

    return Scratch(spark, "langid").write(df, "grams")


def held_out(id_col: Column) -> Column:
    """True for the quarter of ids, by their checksum, that fitting never sees; false for null ids."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identified(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` after its own columns, from ``text_col`` alone.

    Null texts and texts without a letter get ``und`` and score 0. Ties go to
    the language first in code-point order. Rows are kept as they are, in
    particular repeated ones; columns of ``docs`` called ``lang_pred`` or
    ``score`` are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # its size is that of the slots

    def predict(batches):
        for b in rows(batches, 256):
            names, scores = shared.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.mapInArrow(predict, schema)


def fit_documents(docs: DataFrame) -> Filters:
    """``fit`` on the rows of a documents table that aren't held out."""
    learn = docs.where(~held_out(F.col("doc_id")))
    return fit(learn, F.col("doc_id"), F.col("text"), F.col("lang"))


__all__ = ["Filters", "batch", "fit", "fit_documents", "held_out", "identified"]
