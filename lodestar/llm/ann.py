"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

A table hashes a unit vector to the cells of ``functions`` random projections,
each cut into slots of one width at a random offset; Gaussian projections are
2-stable, so that close vectors share cells. A query visits, besides its own
bucket, those whose slots differ by one, in the order of the squared distances
to the slots' borders that it would have to cross, which is the order of the
chance to find a near vector there. Candidates of all tables are merged and
ranked by the exact cosine of the original vectors.

Most queries of clustered vectors need few buckets. How likely a vector is in the
buckets visited depends on its cosine alone, whatever the data, so a first round
of few buckets settles the queries whose k-th cosine is above the one at which
that is likely enough; the others go on with all buckets.

Buckets are dealt to shards, and a query is sent once to each shard with the
buckets that it wants to see there. A bucket with a large part of the vectors
is dealt to several shards by a hash of the vector. A shard's queries go by its
vectors in groups.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.neighbours import Best, dimension, distinct_vectors, merged, nearest_ids, ranked, vectors_of, walked
from lodestar.llm.store import Scratch, partitions, rows

#: Vectors in a shard, tables counted, on average.
SHARD = 20_000
#: Queries of a shard that are worked off at once.
GROUP = 1000
#: The chance to have found a neighbour from which a query needs no more buckets.
ENOUGH = 0.95


@dataclass(frozen=True)
class Settings:
    """``tables`` of ``functions`` projections with slots of ``width``; ``probes`` buckets for each table, ``first`` of them in the first round."""

    tables: int = 20
    functions: int = 14
    width: float = 2.5
    probes: int = 300
    first: int = 30
    seed: int = 7

    @staticmethod
    def for_size(n: int) -> Settings:
        """Settings for ``n`` vectors: one more function for each factor of eight beyond 20,000.

        The more vectors there are the closer are a query's nearest, and the
        more functions tell these from the others. The README has recall and
        the share of vectors visited up to a million.
        """
        more = max(0, int(np.ceil(np.log2(max(n, 1) / 20_000) / 3)))
        return Settings(functions=14 + more)


class Hashing:
    """The projections of all tables, and bucket keys: linear in the slots, so that a probe's key is a sum."""

    def __init__(self, settings: Settings, d: int):
        rng = np.random.default_rng(settings.seed)
        self.s = settings
        self.projections = rng.normal(size=(settings.tables, d, settings.functions))
        self.offsets = rng.uniform(0, settings.width, size=(settings.tables, settings.functions))
        self.factors = rng.integers(1, 1 << 63, size=(settings.tables, settings.functions), dtype=np.uint64) | np.uint64(1)
        self.stems = rng.integers(0, 1 << 63, size=settings.tables, dtype=np.uint64)

    def places(self, unit: np.ndarray, table: int) -> np.ndarray:
        return (unit @ self.projections[table] + self.offsets[table]) / self.s.width

    def keys(self, unit: np.ndarray, table: int) -> np.ndarray:
        slots = np.floor(self.places(unit, table)).astype(np.int64).astype(np.uint64)
        return (slots * self.factors[table]).sum(axis=1, dtype=np.uint64) + self.stems[table]

    def probes(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Keys of the buckets to visit, best first.

        Coordinates are added one by one, and only the best sums so far are
        kept; as staying in the slot costs nothing that loses none of the best.
        """
        places = self.places(unit, table)
        inside = places - np.floor(places)
        keys = self.keys(unit, table)[:, None]
        costs = np.zeros((len(unit), 1))
        for j in range(self.s.functions):
            f = self.factors[table, j]
            step = np.array([0, 1, -1], dtype=np.int64).astype(np.uint64) * f
            cost = np.stack([np.zeros(len(unit)), (1 - inside[:, j]) ** 2, inside[:, j] ** 2], axis=1)
            costs = (costs[:, :, None] + cost[:, None, :]).reshape(len(unit), -1)
            keys = (keys[:, :, None] + step).reshape(len(unit), -1)
            if costs.shape[1] > self.s.probes:
                best = np.argpartition(costs, self.s.probes - 1, axis=1)[:, : self.s.probes]
                costs, keys = np.take_along_axis(costs, best, 1), np.take_along_axis(keys, best, 1)
        return np.take_along_axis(keys, np.argsort(costs, axis=1, kind="stable"), 1)


def settled_from(settings: Settings, d: int) -> float:
    """The least of some cosines at which a vector is in the first round's buckets with the chance ``ENOUGH``; 2 if there is none.

    Measured on random pairs of that cosine: projections on Gaussian vectors
    depend on the angle of a pair alone.
    """
    hashing = Hashing(replace(settings, probes=settings.first), d)
    rng = np.random.default_rng(settings.seed + 1)
    q, other = (m / _lengths(m)[:, None] for m in rng.normal(size=(2, 300, d)))
    across = other - (other * q).sum(axis=1, keepdims=True) * q
    across /= np.maximum(_lengths(across), 1e-300)[:, None]
    visited = [np.sort(hashing.probes(q, t), axis=1) for t in range(settings.tables)]
    for cosine in np.arange(0.4, 1.0, 0.025):
        near = cosine * q + np.sqrt(1 - cosine**2) * across
        found = np.zeros(len(q), bool)
        for t, buckets in enumerate(visited):
            found |= (buckets == hashing.keys(near, t)[:, None]).any(axis=1)
        if found.mean() >= ENOUGH:
            return float(cosine)
    return 2.0


def _shard(keys: np.ndarray, chunk: np.ndarray | int, shards: int) -> np.ndarray:
    h = (keys ^ (np.asarray(chunk).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to between 0.5 and 1: exact, and squares stay in range."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def _vectors(raw: list[bytes], dtype: str) -> np.ndarray:
    return scaled(np.frombuffer(b"".join(raw), dtype=dtype).reshape(len(raw), -1).astype(np.float64))


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def _units(raw: list[bytes], dtype: str) -> np.ndarray:
    m = _vectors(raw, dtype)
    return m / _lengths(m)[:, None]


def cosines(candidates: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision, each from its pair of scaled vectors alone."""
    return (candidates * query).sum(axis=1) / (_lengths(candidates) * np.sqrt((query * query).sum()))


def _coded(dtype: str):
    def coded(m: np.ndarray):
        kept = (m + 0.0).astype(dtype)
        return kept, (kept != 0).any(axis=1)

    return coded


@dataclass(frozen=True)
class _Shard:
    """Vectors in order of their smallest id, and places among them in order of bucket key."""

    vectors: np.ndarray
    units: np.ndarray
    ids: list[list[int]]
    keys: np.ndarray
    places: np.ndarray


def _prepared(dtype: str):
    """A shard from its members."""

    def prepare(members: pa.Table) -> _Shard:
        rep, ids = members["rep"].to_numpy(), members["ids"].to_pylist()
        # A vector that is in several of the shard's buckets has several rows; its first stands for it.
        _, first, same = np.unique(rep, return_index=True, return_inverse=True)
        order = np.argsort([ids[k][0] for k in first], kind="stable")
        place = np.empty(len(first), np.int64)
        place[order] = np.arange(len(first))
        first = first[order]
        m = _vectors(members["vec"].take(first).to_pylist(), dtype)
        keys = members["key"].to_numpy().view(np.uint64)
        by = np.argsort(keys, kind="stable")
        return _Shard(m, m / _lengths(m)[:, None], [ids[k] for k in first], keys[by], place[same][by])

    return prepare


def _search(dtype: str, keep: int):
    """The search of one shard for queries ``query, vec, keys`` (null: all members)."""

    def run(shard: _Shard, queries: pa.Table) -> list[tuple[int, list[dict]]]:
        asked, out = _vectors(queries["vec"].to_pylist(), dtype), []
        for query, q, wants in zip(queries["query"].to_pylist(), asked, queries["keys"], strict=True):
            if not wants.is_valid:
                at = np.arange(len(shard.vectors))
            else:
                want = wants.values.to_numpy().view(np.uint64)
                lo, hi = np.searchsorted(shard.keys, want, "left"), np.searchsorted(shard.keys, want, "right")
                full = hi > lo
                seen = np.zeros(len(shard.vectors), bool)
                for a, b in zip(lo[full].tolist(), hi[full].tolist(), strict=True):
                    seen[shard.places[a:b]] = True
                at = np.flatnonzero(seen)
            if not len(at):
                continue
            near = shard.units[at] @ (q / np.sqrt((q * q).sum()))
            if len(at) > 4 * keep:  # the exact measure for those that rounding could leave among the best
                at = at[near >= np.partition(near, len(near) - keep)[len(near) - keep] - 1e-9]
            best = Best(1, keep)
            best.add(0, at, cosines(shard.vectors[at], q))
            out.append((query, nearest_ids(best.lists[0], shard.ids, keep)))
        return out

    return run


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, settings: Settings | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found for each row whose id is divisible by ``every``: ``query_id, rank, vec_id, score``.

    All rows are indexed; all but the query's own are candidates. Ties go to
    the smaller id. A query whose buckets hold fewer than ``k`` others is
    compared with all rows, in blocks.

    Vectors that are null, zero, not of the table's usual length or hold null
    or non-finite components take no part, nor do null ids; finite components
    of any size do. Repeated rows count
    once. Other columns are not read, and an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    element = vectors.schema[vec_col].dataType.elementType.simpleString()
    dtype, keep = "<f4" if element == "float" else "<f8", k + 1
    d = dimension(vectors, vec_col)
    kept = scratch.write(vectors_of(vectors, id_col, vec_col, d, _coded(dtype)), "vectors")
    distinct = distinct_vectors(kept, every, keep, scratch)
    n = distinct.count()
    settings = settings or Settings.for_size(n)
    hashing = Hashing(settings, max(d, 1))
    shards = max(1, -(-n * settings.tables // SHARD))

    def bucket(batches):
        for b in rows(batches, 4096):
            unit = _units(b.column(0).to_pylist(), dtype)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([hashing.keys(unit, t) for t in range(settings.tables)]).view(np.int64))], names=["key"])

    # Buckets of more than half a shard, of which there are at most two for each shard, or a thousand.
    most = max(SHARD // 2, n * settings.tables // 1000)
    sizes = distinct.select("vec").mapInArrow(bucket, "key bigint").groupBy("key").count().where(F.col("count") > most)
    hot = {r["key"] & (1 << 64) - 1: -(-r["count"] // (SHARD // 2)) for r in sizes.collect()}

    def chunks_of(keys: np.ndarray) -> np.ndarray:
        return np.array([hot.get(x, 1) for x in keys.tolist()]) if hot else np.ones(len(keys), np.int64)

    def deal(batches):
        for b in rows(batches, 4096):
            unit = _units(b.column(1).to_pylist(), dtype)
            rep = b.column(0).to_numpy()
            for t in range(settings.tables):
                keys = hashing.keys(unit, t)
                chunk = (rep * 0x9E3779B1 >> 7) % chunks_of(keys)
                yield pa.RecordBatch.from_arrays([pa.array(_shard(keys, chunk, shards)), pa.array(keys.view(np.int64)), *b.columns], names=["part", "key", "rep", "vec", "ids"])

    def ask(probes: int):
        probing = Hashing(replace(settings, probes=probes), max(d, 1))

        def run(batches):
            for b in rows(batches, 64):
                vec = b.column(1).to_pylist()
                unit = _units(vec, dtype)
                wanted = np.concatenate([probing.probes(unit, t) for t in range(settings.tables)], axis=1)
                out: tuple[list, list, list, list] = ([], [], [], [])
                for rep, v, keys in zip(b.column(0).to_pylist(), vec, wanted, strict=True):
                    chunks = chunks_of(keys)
                    keys = np.repeat(keys, chunks)
                    shard = _shard(keys, np.arange(len(keys)) - np.repeat(np.cumsum(chunks) - chunks, chunks), shards)
                    order = np.argsort(shard, kind="stable")
                    to, starts = np.unique(shard[order], return_index=True)
                    for s, part in zip(to.tolist(), np.split(keys[order].view(np.int64), starts[1:]), strict=True):
                        for o, x in zip(out, (s, rep, v, part), strict=True):
                            o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["part", "query", "vec", "keys"])

        return run

    asked = distinct.where("asked").select("rep", "vec")
    members = distinct.select("rep", "vec", "ids").mapInArrow(deal, "part int, key bigint, rep bigint, vec binary, ids array<bigint>")
    search = lambda m, q: walked(m, q, _prepared(dtype), _search(dtype, keep), GROUP, pa.float64(), max(shards, partitions(spark)))
    visit = lambda reps, probes: search(members, reps.mapInArrow(ask(probes), "part int, query bigint, vec binary, keys array<bigint>"))
    near = scratch.write(merged(visit(asked, min(settings.first, settings.probes)), keep), "first")
    enough = settled_from(settings, max(d, 1))
    settled = near.where((F.size("near") == keep) & (-F.element_at("near", -1)["far"] >= enough))
    rest = scratch.write(asked.join(settled.select(F.col("query").alias("rep")), "rep", "left_anti"), "rest")
    found = near
    if settings.probes > settings.first and not rest.isEmpty():
        found = scratch.write(settled.union(merged(visit(rest, settings.probes), keep)), "found")
    near = found

    # Queries that found fewer ids than there are, or than are asked for.
    there = distinct.select(F.size("ids").alias("n")).groupBy().agg(F.sum("n")).first()[0] or 0
    full = near.where(F.size("near") >= min(keep, there)).select("query")
    short = scratch.write(asked.withColumnRenamed("rep", "query").join(full, "query", "left_anti"), "short")
    if not short.isEmpty():
        part = F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("part")
        everything = distinct.select(part, F.lit(0).cast("bigint").alias("key"), "rep", "vec", "ids")
        asking = short.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("part"), "query", "vec", F.lit(None).cast("array<bigint>").alias("keys"))
        near = merged(found.union(search(everything, asking)), keep)
    return ranked(kept, distinct, near, every, k, scratch)
