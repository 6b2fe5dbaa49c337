"""What both vector searches share: distinct vectors before, the walk over parts of the data, ranked neighbours after.

A search works on distinct vectors, each with the few smallest ids that carry
it. That is exact: of many copies of a vector only the ``k + 1`` smallest ids
can be among the ``k`` nearest of any query. Copies never meet in pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.store import Scratch

#: Distinct vectors that a task holds before it sends them on.
HELD = 20_000


def dimension(vectors: DataFrame, vec_col: str) -> int:
    """The most frequent length of vectors, the larger of equally frequent ones; 0 for an empty table."""
    sizes = vectors.select(F.size(F.col(f"`{vec_col}`")).alias("d")).where("d > 0").groupBy("d").count()
    top = sizes.orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return top["d"] if top else 0


def matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are vectors of ``d`` finite numbers: their places and, as doubles, the vectors."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = pc.list_flatten(column)
    numbers = pc.cast(values, pa.float64()).to_numpy(zero_copy_only=False)
    good = lengths == d
    bad = np.repeat(np.arange(len(lengths)), lengths)[~np.isfinite(numbers)]
    good[bad] = False
    return np.flatnonzero(good), numbers[np.repeat(good, lengths)].reshape(-1, max(d, 1))


def vectors_of(vectors: DataFrame, id_col: str, vec_col: str, d: int, coded: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Rows ``vec_id, vec`` of the vectors that take part; ``coded`` gives a matrix's form to keep and which of its rows take part."""
    source = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vec_col}`").alias("vec")).where("vec_id is not null")

    def run(batches):
        for b in batches:
            at, m = matrix(b.column(1), d)
            kept, good = coded(m)
            ids = b.column(0).to_numpy(zero_copy_only=False)[at][good]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r.tobytes() for r in kept[good]], pa.binary())], names=["vec_id", "vec"])

    return source.mapInArrow(run, "vec_id bigint, vec binary")


def distinct_vectors(rows: DataFrame, every: int, keep: int, scratch: Scratch) -> DataFrame:
    """Stored ``rep, vec, ids, asked``: the distinct vectors, numbered, with their ``keep`` smallest ids.

    ``asked`` tells whether an id that is divisible by ``every`` has the
    vector. A partition is reduced before the shuffle, so a vector that many
    rows share sends a few ids for each partition, or for each ``HELD`` vectors
    of a partition.
    """

    def reduced_batch(by: dict[bytes, tuple[list[int], bool]]):
        ids = [sorted(x)[:keep] for x, _ in by.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(by), pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array([a for _, a in by.values()], pa.bool_())], names=["vec", "ids", "asked"])

    def reduce(batches):
        by: dict[bytes, tuple[list[int], bool]] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, asked = by.get(v, ((), False))
                if i not in ids:
                    ids = [*ids, i] if len(ids) < 2 * keep else sorted([*ids, i])[:keep]
                by[v] = (ids, asked or i % every == 0)
                if len(by) >= HELD:
                    yield reduced_batch(by)
                    by = {}
        if by:
            yield reduced_batch(by)

    reduced = rows.mapInArrow(reduce, "vec binary, ids array<bigint>, asked boolean")
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    grouped = reduced.groupBy("vec").agg(smallest.alias("ids"), F.bool_or("asked").alias("asked"))
    return scratch.write(grouped.select(F.monotonically_increasing_id().alias("rep"), "vec", "ids", "asked"), "distinct")


def walked(members: DataFrame, queries: DataFrame, prepare: Callable[[pa.Table], object], search: Callable[[object, pa.Table], list[tuple[int, list[dict]]]], group: int, far: pa.DataType, tasks: int) -> DataFrame:
    """``query, near`` of the search of each part's members for its queries.

    ``members`` are rows ``part, key, rep, vec, ids`` and ``queries`` rows
    ``part, query, vec, keys``. A part's rows come to its task in order, the
    members first: these are held, a number that the caller bounds, and its
    queries go by in groups of ``group``, however many there are.
    """
    data = members.select("part", F.lit(0).cast("tinyint").alias("side"), "key", "rep", "vec", "ids")
    asking = queries.select("part", F.lit(1).cast("tinyint").alias("side"), F.lit(0).cast("bigint").alias("key"), F.col("query").alias("rep"), "vec", F.col("keys").alias("ids"))
    found = pa.schema([("query", pa.int64()), ("near", pa.list_(pa.struct([("far", far), ("vec_id", pa.int64())])))])

    def run(batches):
        part, held, index, waiting = None, [], None, []

        def answers(index, waiting):
            out = search(index, pa.Table.from_batches(waiting).select([3, 4, 5]).rename_columns(["query", "vec", "keys"]))
            return pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], pa.int64()), pa.array([n for _, n in out], found.field(1).type)], schema=found)

        for b in batches:
            parts, sides = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(parts) != 0) | (np.diff(sides) != 0)) + 1).tolist(), b.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                piece = b.slice(start, end - start)
                if parts[start] != part:
                    if waiting:
                        yield answers(index, waiting)
                    part, held, index, waiting = parts[start], [], None, []
                if sides[start] == 0:
                    held.append(piece)
                    continue
                if not held:
                    continue
                if index is None:
                    index = prepare(pa.Table.from_batches(held))
                for at in range(0, piece.num_rows, group):
                    waiting.append(piece.slice(at, group))
                    if sum(w.num_rows for w in waiting) >= group:
                        yield answers(index, waiting)
                        waiting = []
        if waiting:
            yield answers(index, waiting)

    kind = {pa.float64(): "double", pa.int64(): "bigint"}[far]
    dealt = data.unionByName(asking).repartition(tasks, "part").sortWithinPartitions("part", "side")
    return dealt.mapInArrow(run, f"query bigint, near array<struct<far:{kind},vec_id:bigint>>")


def nearest_ids(found: list[tuple], ids: list[list[int]], keep: int) -> list[dict]:
    """The best ``keep`` ids of found vectors ``(-score, place)``, each of which stands for several ids."""
    every = sorted((far, i) for far, place in found for i in ids[place])
    return [{"far": far, "vec_id": i} for far, i in every[:keep]]


def merged(found: DataFrame, keep: int) -> DataFrame:
    """``query, near`` with the best ``keep`` of what each part of the search has found for a query.

    A part sends one row for a query, with the few that it could contribute.
    """
    near = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, keep)
    return found.groupBy("query").agg(near.alias("near"))


def ranked(rows: DataFrame, distinct: DataFrame, near: DataFrame, every: int, k: int, scratch: Scratch) -> DataFrame:
    """``query_id, rank, vec_id, score`` from ``query`` (a rep) and ``near``."""
    by_vector = scratch.write(near.join(distinct.select("rep", "vec"), F.col("query") == F.col("rep")).select(F.col("vec").alias("of_vec"), "near"), "near")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).distinct()
    joined = asked.join(by_vector, F.col("vec") == F.col("of_vec"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    each = joined.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("place", "x"))
    return each.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id", _plus(-F.col("x.far")).alias("score"))


def _plus(score: Column) -> Column:
    """Zero without a sign."""
    return score + F.lit(0)


class Best:
    """The best few of each query: scores descending, then places ascending (places are in order of smallest id)."""

    def __init__(self, queries: int, keep: int):
        self.keep = keep
        self.lists: list[list[tuple]] = [[] for _ in range(queries)]

    def worst(self, q: int) -> float:
        found = self.lists[q]
        return -found[-1][0] if len(found) == self.keep else -np.inf

    def add(self, q: int, places: np.ndarray, scores: np.ndarray) -> None:
        least = self.worst(q)
        ok = scores >= least
        places, scores = places[ok], scores[ok]
        if len(scores) > 4 * self.keep:
            cut = np.partition(scores, len(scores) - self.keep)[len(scores) - self.keep]
            ok = scores >= cut
            places, scores = places[ok], scores[ok]
            if len(scores) > 4 * self.keep:  # many of one score: the smallest places of each
                by = np.lexsort((places, -scores))[: self.keep]
                places, scores = places[by], scores[by]
        if len(scores):
            self.lists[q] = sorted({*self.lists[q], *zip((-scores).tolist(), places.tolist(), strict=True)})[: self.keep]
