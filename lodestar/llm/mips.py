"""Exact top-k inner products by dual-tree search on cover trees.

Distinct vectors are dealt to blocks, and the queries go by each block in
groups; each pair of a block and a group indexes both in cover trees and
descends them together. For
a query node with centre ``q``, covering radius ``a`` and a data node with
centre ``r``, radius ``b``, no product exceeds ``q.r + a|r| + b|q| + ab``; the
pair is pruned if that is less than the worst k-th best score among the query
node's queries. Each pair of block and group sends the best few of each query
on, and these merge into the result.

Components are whole numbers of any size that a double can hold. Trees and
bounds are of doubles, scaled by powers of two; scores are exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.neighbours import Best, dimension, distinct_vectors, merged, nearest_ids, ranked, vectors_of, walked
from lodestar.llm.store import Scratch, partitions

#: Vectors of a block, on average, and queries of a group.
BLOCK, GROUP = 4096, 2048
#: A node's radius in terms of its parent's.
SHRINK = 0.5
#: Points below which a node isn't divided, and points compared at once.
LEAF, TILE = 24, 2048
#: The largest score that 64 bits hold with either sign.
MOST = (1 << 63) - 1


@dataclass(slots=True)
class Node:
    """A ball around the point ``centre`` that covers all points below: those of its children and its own."""

    centre: int
    radius: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)
    #: All points below.
    below: np.ndarray | None = None


def cover_tree(m: np.ndarray) -> Node:
    """A cover tree over the rows of ``m``.

    A node's points lie within its radius; its children's centres are points of
    it, further apart than the children's scale, and every point goes to the
    first centre within that scale. Children of few points stay with the node
    as points, so that they can be compared at once.
    """

    def distances(centre: int, at: np.ndarray) -> np.ndarray:
        diff = m[at] - m[centre]
        return np.sqrt(np.einsum("ij,ij->i", diff, diff))

    everything = np.arange(len(m))
    far = distances(0, everything)
    root = Node(0, float(far.max(initial=0.0)), everything[:0], below=everything)
    stack = [(root, everything, far, root.radius)]
    while stack:
        node, at, far, scale = stack.pop()
        scale *= SHRINK
        if len(at) <= LEAF or node.radius == 0.0:
            node.points = at
            continue
        left, far_left, own = at, far, []
        centre = node.centre
        while len(left):
            near = far_left <= scale
            taken, far_taken = left[near], far_left[near]
            left = left[~near]
            if len(taken) > LEAF:
                child = Node(centre, float(far_taken.max()), at[:0], below=taken)
                node.children.append(child)
                stack.append((child, taken, far_taken, scale))
            else:
                own.append(taken)
            if len(left):
                centre = int(left[0])
                far_left = distances(centre, left)
        node.points = np.concatenate(own) if own else at[:0]
    return root


class Products:
    """Exact inner products of whole-numbered rows, as 64-bit integers.

    Rows are doubles or integers without a fraction. Products are made as
    doubles where no sum can exceed 2**53, else modulo 2**64. Where a product
    may not fit 64 bits an estimate with a bound of its error tells whether it
    does; where that is in doubt the product is made of Python's integers.
    One that doesn't fit becomes ``MOST`` with its sign, or is an error if ``strict``.
    """

    def __init__(self, data: np.ndarray, queries: np.ndarray, strict: bool):
        self.data, self.queries, self.strict = data, queries, strict
        most = [float(np.abs(m).max(initial=0)) for m in (data, queries)]
        with np.errstate(over="ignore"):
            size = most[0] * most[1] * data.shape[1]
        self.small, self.wide = size < 2.0**53, not size < 2.0**62
        if self.small:
            self.whole = [m.astype(np.float64) for m in (data, queries)]
        else:
            self.whole = [_modulo(m) for m in (data, queries)]
        if self.wide:
            # Estimates are made of rows scaled by powers of two of their own.
            both = [m.astype(np.float64) for m in (data, queries)]
            self.powers = [np.frexp(np.abs(m).max(axis=1, initial=0.0))[1] for m in both]
            self.estimates = [np.ldexp(m, -e[:, None]) for m, e in zip(both, self.powers, strict=True)]
            self.error = 4e-16 * (data.shape[1] + 4) * data.shape[1]

    def of(self, asks: np.ndarray, tile: np.ndarray) -> np.ndarray:
        """Products of some queries with some rows of data."""
        with np.errstate(over="ignore"):
            exact = self.whole[1][asks] @ self.whole[0][tile].T
        if self.small:
            return exact
        exact = exact.view(np.int64)
        if not self.wide:
            return exact
        power = self.powers[1][asks][:, None] + self.powers[0][tile][None, :] - 63
        with np.errstate(over="ignore"):
            high, doubt = np.ldexp(self.estimates[1][asks] @ self.estimates[0][tile].T, power), np.ldexp(self.error, power)
        with np.errstate(invalid="ignore"):
            fits, above, below = np.abs(high) + doubt < 1, high - doubt >= 1, high + doubt <= -1
        for i, j in np.argwhere(~(fits | above | below)).tolist():
            true = sum(int(x) * int(y) for x, y in zip(self.queries[asks[i]].tolist(), self.data[tile[j]].tolist(), strict=True))
            fits[i, j], above[i, j], below[i, j] = abs(true) <= MOST, true > MOST, true < -MOST
        if self.strict and not fits.all():
            raise ValueError("an inner product doesn't fit 64 bits")
        return np.where(above, MOST, np.where(below, -MOST, np.maximum(exact, -MOST)))


def _modulo(m: np.ndarray) -> np.ndarray:
    """Whole numbers modulo 2**64."""
    if m.dtype.kind in "iu":
        return m.astype(np.uint64)
    size = np.fmod(np.abs(m), 2.0**64).astype(np.uint64)
    return np.where(m < 0, np.uint64(0) - size, size)


def dual_tree(data: np.ndarray, queries: np.ndarray, keep: int, strict: bool = True) -> list[list[tuple]]:
    """For each query its ``keep`` best ``(-score, row of data)``, ties to the earlier row.

    Scores are exact for rows of whole numbers. One that doesn't fit 64 bits is
    an error, or if not ``strict`` counts as the nearest number that does.
    """
    best = Best(len(queries), keep)
    if not len(data) or not len(queries):
        return best.lists
    products = Products(data, queries, strict)
    powers = [int(np.frexp(np.abs(m.astype(np.float64)).max(initial=0.0))[1]) for m in (data, queries)]
    df, qf = (np.ldexp(m.astype(np.float64), -e) for m, e in zip((data, queries), powers, strict=True))
    unit = -sum(powers)  # a score times two to this power is in the units of the bounds
    lengths = np.sqrt((df**2).sum(axis=1))
    tree, asking = cover_tree(df), cover_tree(qf)
    # The bounds are rounded, so they get a margin.
    slack = 1e-9 * data.shape[1]

    def bound(node: Node, centres: np.ndarray, radii: np.ndarray | float) -> np.ndarray:
        c = qf[node.centre]
        return df[centres] @ c + node.radius * lengths[centres] + radii * np.sqrt(c @ c) + node.radius * radii + slack

    def worst(asks: np.ndarray) -> float:
        return float(np.ldexp(float(min(best.worst(x) for x in asks.tolist())), unit))

    def compare(asks: np.ndarray, node: Node, points: np.ndarray) -> None:
        """Score the queries ``asks`` of a node against points, in tiles, best bound first."""
        if not len(asks) or not len(points):
            return
        high = bound(node, points, 0.0)
        order = np.argsort(-high, kind="stable")
        points, high = points[order], high[order]
        for at in range(0, len(points), TILE):
            tile = points[at : at + TILE][high[at : at + TILE] >= worst(asks)]
            if not len(tile):
                return
            scores = products.of(asks, tile)
            for n, x in enumerate(asks.tolist()):
                best.add(x, tile, scores[n])

    def below_points(node: Node) -> Node:
        """A node's own points as a node without children."""
        return Node(node.centre, node.radius, node.points, below=node.points)

    stack = [(asking, tree)]
    while stack:
        a, r = stack.pop()
        if not len(a.below) or bound(a, np.array([r.centre]), r.radius)[0] < worst(a.below):
            continue
        if a.children and a.radius >= r.radius or a.children and not r.children:
            stack += [(c, r) for c in reversed(a.children)]
            if len(a.points):
                stack.append((below_points(a), r))
            continue
        compare(a.below, a, r.points)
        if r.children:
            high = bound(a, np.array([c.centre for c in r.children]), np.array([c.radius for c in r.children]))
            stack += [(a, r.children[k]) for k in np.argsort(high, kind="stable").tolist()]
    return best.lists


def _whole(scale: float):
    """``floor(scale * x)`` as doubles; what isn't finite then takes no part."""

    def coded(m: np.ndarray):
        with np.errstate(over="ignore"):
            whole = np.floor(scale * m) + 0.0
        good = np.isfinite(whole).all(axis=1)
        return np.where(good[:, None], whole, 0.0).astype("<f8"), good

    return coded


@dataclass(frozen=True)
class _Block:
    """Vectors in order of their smallest id."""

    vectors: np.ndarray
    ids: list[list[int]]


def _rows(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def _prepared(members: pa.Table) -> _Block:
    ids = members["ids"].to_pylist()
    order = sorted(range(len(ids)), key=lambda k: ids[k][0])
    return _Block(_rows(members["vec"].take(np.array(order)).to_pylist()), [ids[k] for k in order])


def _search(keep: int):
    def run(block: _Block, queries: pa.Table) -> list[tuple[int, list[dict]]]:
        asked = _rows(queries["vec"].to_pylist())
        lists = dual_tree(block.vectors, asked, keep, strict=False)
        return [(query, nearest_ids([(int(far), place) for far, place in found], block.ids, keep)) for query, found in zip(queries["query"].to_pylist(), lists, strict=True)]

    return run


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` highest inner products for each row whose id is divisible by ``every``: ``query_id, rank, vec_id, score``.

    Components count as ``floor(scale * x)``. All rows but the query's own are
    candidates; ties go to the smaller id; a query with fewer candidates gets
    all. Components may have any size, and scores are exact; one beyond 64 bits
    counts as the nearest number of 64 bits. Vectors that are null, not of the
    table's usual length, hold null or non-finite components or components that
    aren't finite after scaling take no part, nor do null ids. Repeated rows
    count once. Other columns are not read, and an empty table gives an empty
    result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "mips")
    d = dimension(vectors, vec_col)
    kept = scratch.write(vectors_of(vectors, id_col, vec_col, d, _whole(scale)), "vectors")
    distinct = distinct_vectors(kept, every, k + 1, scratch)
    n = distinct.count()
    # Blocks of a fixed size, but where that leaves cores without work.
    blocks = max(1, -(-n // BLOCK), min(-(-n // 1024), partitions(spark)))
    part = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("part")
    members = distinct.select(part, F.lit(0).cast("bigint").alias("key"), "rep", "vec", "ids")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part")
    queries = distinct.where("asked").select(every_block, F.col("rep").alias("query"), "vec", F.lit(None).cast("array<bigint>").alias("keys"))
    found = walked(members, queries, _prepared, _search(k + 1), GROUP, pa.int64(), max(blocks, partitions(spark)))
    return ranked(kept, distinct, merged(found, k + 1), every, k, scratch)
