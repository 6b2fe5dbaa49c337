"""SimHash near-duplicates, found by fuzzy hashing with the Golay code.

Fingerprints that differ in at most two of 64 bits are linked. The 64 bits are
three segments. Of the ordered pairs (first, second), (second, third), (third,
first) one always has no error in its first and at most one in its second
segment, however two errors fall. So the exact first segment joins with a fuzzy
key of the second: the perfect [23, 12, 7] Golay code maps every word to the
index of the codeword near it, and of two words that differ in one bit, the
index of one is among the indices of the other and its neighbours. A
fingerprint gets three keys as one side of the join and about fifteen as the
other, and every candidate is verified.

A bucket's links are reduced to a spanning forest where it is read, so nothing
grows with the square of a group. Components are found by alternating stars.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.store import Scratch, rows

SEED = 42
SHINGLE = 3
MOST_BITS = 2
#: Bits of the three segments, from the lowest.
SEGMENTS = (22, 21, 21)
#: Rows of a bucket up to which its task links them itself.
BUCKET_ROWS = 20_000
#: A bucket with a larger share of all rows than this is linked without a shuffle on its key.
BUSY_SHARE = 1 / 1000
#: Edges up to which a round of stars is worked off by one task, without a shuffle.
FEW_EDGES = 100_000
#: Generator polynomial of the Golay code.
_GENERATOR, _CHECK_BITS, _WORD_BITS = 0xC75, 11, 23

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _hashes(text: str | None) -> list[int]:
    """XXH64 of the word shingles of a text, lower-cased in A-Z, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    h = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return [h(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
    return [h(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for a text without words."""
    hashes = np.array(_hashes(text), dtype="<u8")
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed 64-bit integer; a null text has no words."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in rows(batches, 512):
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return source.mapInArrow(run, f"doc_id {kind}, fp bigint")


@lru_cache(maxsize=1)
def _golay() -> tuple[list[np.ndarray], np.ndarray]:
    """Syndromes of each byte of a word; the error pattern of each syndrome (up to three bits: the code is perfect)."""

    def remainder(word: int) -> int:
        for bit in range(_WORD_BITS - 1, _CHECK_BITS - 1, -1):
            if word >> bit & 1:
                word ^= _GENERATOR << (bit - _CHECK_BITS)
        return word

    of_bytes = [np.array([remainder(b << shift) if b << shift < 1 << _WORD_BITS else 0 for b in range(256)]) for shift in (0, 8, 16)]
    errors = np.zeros(1 << _CHECK_BITS, dtype=np.int64)
    for weight in range(4):
        for bits in combinations(range(_WORD_BITS), weight):
            pattern = sum(1 << b for b in bits)
            errors[remainder(pattern)] = pattern
    return of_bytes, errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    (low, mid, high), errors = _golay()
    return (words ^ errors[low[words & 255] ^ mid[words >> 8 & 255] ^ high[words >> 16]]) >> _CHECK_BITS


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    u, out, at = fp.view(np.uint64), [], 0
    for bits in SEGMENTS:
        out.append((u >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64))
        at += bits
    return out


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join keys of distinct fingerprints: key, place of the fingerprint, whether it is a key of the searching side."""
    parts, keys, places, searching = _segments(fp), [], [], []
    n = np.arange(len(fp))
    for k, exact in enumerate(parts):
        j = (k + 1) % len(parts)
        fuzzy = parts[j]
        stem = (k << 34 | exact << 12).astype(np.int64)
        flips = np.array([0, *(1 << b for b in range(SEGMENTS[j]))])
        near = np.sort(codeword_index(fuzzy[:, None] ^ flips[None, :]), axis=1)
        new = np.concatenate([np.ones((len(fp), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
        who, at = np.nonzero(new)
        keys += [stem | codeword_index(fuzzy), stem[who] | near[who, at]]
        places += [n, who]
        searching += [np.zeros(len(fp), bool), np.ones(len(who), bool)]
    return np.concatenate(keys), np.concatenate(places), np.concatenate(searching)


def _forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges from each linked fingerprint to the smallest of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := root(x)) != x]


def _bucket_links(fp: np.ndarray, searching: np.ndarray) -> list[tuple[int, int]]:
    index, query = np.unique(fp[~searching]), np.unique(fp[searching])
    links: list[tuple[int, int]] = []
    for at in range(0, len(query), 512):
        some = query[at : at + 512]
        far = np.bitwise_count((some[:, None] ^ index[None, :]).view(np.uint64))
        q, i = np.nonzero((far <= MOST_BITS) & (far > 0))
        if len(q):
            links += _forest(list(zip(some[q].tolist(), index[i].tolist(), strict=True)))
    return _forest(links) if links else []


def _links_of_sorted(batches, most: int | None = None):
    """Verified links of rows in order of key; for a bucket over ``most`` (``BUCKET_ROWS``) rows its fingerprints alone, once each side."""
    most = BUCKET_ROWS if most is None else most
    held: list[tuple[np.ndarray, np.ndarray]] = []
    key, size, hot = None, 0, False

    def close():
        nonlocal held, size, hot
        out = []
        if hot:
            out = [(x, None) for f, _ in held for x in np.unique(f).tolist()]
        elif size > 1:
            f = np.concatenate([f for f, _ in held])
            if f.min() != f.max():
                out = _bucket_links(f, np.concatenate([s for _, s in held]))
        held, size, hot = [], 0, False
        return out

    def made(pairs):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])

    for b in batches:
        keys, fp, searching = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(keys)]
        alike = np.minimum.reduceat(fp, starts) == np.maximum.reduceat(fp, starts) if len(keys) else []
        out: list = []
        for n, (s, e) in enumerate(zip(starts, ends, strict=True)):
            if s == e:
                continue
            if keys[s] != key:
                out += close()
                key = keys[s]
                if alike[n] and e < len(keys):  # a fingerprint that is alone in its bucket
                    continue
            held.append((fp[s:e], searching[s:e]))
            size += e - s
            if size > most:
                hot = True
                out += [(x, None) for f, _ in held for x in np.unique(f).tolist()]
                held = []
        if out:
            yield made(out)
    if last := close():
        yield made(last)


def _ball_links(hot: DataFrame) -> DataFrame:
    """Links among the fingerprints of overfull buckets.

    Two fingerprints at distance two or less have a common word at distance one
    or less from both, and all fingerprints around such a word, 65 at most, are
    linked with each other. So each word's fingerprints link to their smallest.
    """
    ball = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))
    words = hot.select(F.col("a").alias("fp")).distinct().select("fp", F.explode(ball).alias("word"))
    least = words.groupBy("word").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    return words.join(least, "word").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def busy_keys(distinct: DataFrame) -> np.ndarray:
    """Keys of all buckets that have over ``BUCKET_ROWS`` rows and ``BUSY_SHARE`` of them; at most 2 / ``BUSY_SHARE``.

    Each batch sends the keys with at least half that share of its rows. A key
    can have at most half its rows in batches that don't send it, so a
    sum of half the share of all rows finds every such key.
    """

    def often(batches):
        for b in rows(batches, 20_000):
            k, n = np.unique(bucket_keys(b.column(0).to_numpy())[0], return_counts=True)
            most = n >= max(2, n.sum() * BUSY_SHARE / 2)
            # The key -1 stands for all rows.
            yield pa.RecordBatch.from_arrays([pa.array([-1, *k[most].tolist()]), pa.array([int(n.sum()), *n[most].tolist()])], names=["key", "n"])

    sums = distinct.select("fp").mapInArrow(often, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    total = sums.where("key = -1").first()
    if total is None:
        return np.array([], np.int64)
    least = max(BUCKET_ROWS / 2, total["n"] * BUSY_SHARE / 2)
    return np.array(sorted(r["key"] for r in sums.where((F.col("key") >= 0) & (F.col("n") >= least)).collect()), np.int64)


def links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges ``a, b`` that join the linked fingerprints of ``distinct`` (column ``fp``) into their components.

    All links between different fingerprints are kept as connections; pairs
    that other edges connect already are left out. Fingerprints of busy buckets
    are told before the shuffle and linked by their neighbouring words, whose
    groups have 65 members at most; any other bucket that turns out
    overfull in its task joins them.
    """
    busy, most = busy_keys(distinct), BUCKET_ROWS

    def key(batches):
        for b in rows(batches, 20_000):
            fp = b.column(0).to_numpy()
            k, at, searching = bucket_keys(fp)
            calm = ~np.isin(k, busy)
            yield pa.RecordBatch.from_arrays([pa.array(k[calm]), pa.array(fp[at][calm]), pa.array(searching[calm])], names=["key", "fp", "searching"])

    def in_busy(batches):
        for b in rows(batches, 20_000):
            fp = b.column(0).to_numpy()
            k, at, _ = bucket_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(fp[at[np.isin(k, busy)]]))], names=["a"])

    keyed = distinct.select("fp").mapInArrow(key, "key bigint, fp bigint, searching boolean")
    found = keyed.repartition(_partitions(distinct), "key").sortWithinPartitions("key").mapInArrow(lambda batches: _links_of_sorted(batches, most), "a bigint, b bigint")
    stored = scratch.write(found, "links")
    edges, hot = stored.where("b is not null"), stored.where("b is null").select("a")
    if len(busy):
        hot = hot.union(distinct.select("fp").mapInArrow(in_busy, "a bigint"))
    return edges if hot.isEmpty() else edges.union(_ball_links(hot))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``), the root being the least node of its component.

    Alternating large and small stars: each round links a node's neighbours to
    the least of them, until every edge leads to a root. A round's edges are
    written down, so the lineage stays short and nothing comes to the driver
    but a count and a checksum.
    """

    def star(e: DataFrame, large: bool, few: bool) -> DataFrame:
        together = (lambda df: df.coalesce(1)) if few else (lambda df: df)
        if large:
            near = together(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        else:
            near = together(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        if not few:  # as a stored table on one side, so that Spark can split a centre with many edges on the other
            least = scratch.write(least, f"least-{turn}-{large}")
        joined = near.join(least, "a")
        moved = joined.where("b > a") if large else joined
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(least.select("a", F.col("m").alias("b")))
        return together(out.where("a <> b")).distinct()

    edges = scratch.write(edges.where("a <> b").distinct(), "edges0")
    now, check, turn = (edges.count(), None), None, 0
    while now[0] and now != check:
        check, few, turn = now, now[0] <= FEW_EDGES, turn + 1
        edges = scratch.write(star(star(edges, True, few), False, few), f"edges{turn}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        for name in (f"edges{turn - 1}", f"least-{turn}-True", f"least-{turn}-False"):
            scratch.drop(name)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _grouped(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The stored rows ``doc_id, fp`` and for each fingerprint ``label_fp, root, component_id``."""
    rows_ = scratch.write(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = scratch.write(rows_.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    nodes = scratch.write(components(links(distinct, scratch), scratch), "nodes")
    named = nodes.join(distinct, nodes["node"] == distinct["fp"]).select("fp", "root", "least")
    # Also stored, as one root may have a large part of all fingerprints.
    roots = scratch.write(named.groupBy("root").agg(F.min("least").alias("component")), "roots")
    of_nodes = named.join(roots, "root").select(F.col("fp").alias("node_fp"), "root", "component")
    # Written down so that joins with rows have a plain shuffle on either side, whose hot keys Spark can split.
    joined = distinct.join(of_nodes, F.col("fp") == F.col("node_fp"), "left")
    return rows_, scratch.write(joined.select(F.col("fp").alias("label_fp"), F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component_id")), "labels")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id that links lead to, the row's own
    included; null only if all rows of the component have a null id. Null and
    empty texts have fingerprint zero and are linked like any other. Repeated
    rows come out as often as they occur; other columns are not read; an empty
    table gives an empty result.
    """
    rows_, labels = _grouped(docs, id_col, text_col, Scratch(docs.sparkSession, "simhash"))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows_.join(labels, F.col("fp") == F.col("label_fp")).select("doc_id", shown, "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: that of its smallest id.

    Of several rows of the component with that id one stays; an id that is
    repeated with different texts stays once for each component whose smallest
    it is. Rows with a null id stay only if
    no row of their component has an id, and then one of them does.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    rows_, labels = _grouped(docs, id_col, text_col, scratch)
    joined = rows_.join(labels, F.col("fp") == F.col("label_fp"))
    # The rows that go are the fewer; as a stored table their size is known when the join is planned.
    gone = scratch.write(joined.where("doc_id <> component_id").select(F.col("doc_id").alias("_lodestar_gone")).distinct(), "gone")
    own = F.col(f"`{id_col}`")
    kept = docs.where(own.isNotNull()).join(gone, own == F.col("_lodestar_gone"), "left_anti")
    winners = joined.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("root").alias("first"), F.max("root").alias("last"))
    # Ids that stay for one text and go, or stay once more, for another.
    also_gone = winners.join(gone, F.col("doc_id") == F.col("_lodestar_gone"), "left_semi")
    clashing = scratch.write(winners.where("first <> last").unionByName(also_gone).select(F.col("doc_id").alias("_lodestar_clash")).distinct(), "clashing")
    if not clashing.isEmpty():
        kept = kept.join(clashing, own == F.col("_lodestar_clash"), "left_anti")
    if not winners.where("n > 1").isEmpty():
        kept = kept.dropDuplicates([id_col])
    if not clashing.isEmpty():
        kept = kept.unionByName(_by_text(docs.join(clashing, own == F.col("_lodestar_clash"), "left_semi"), labels, id_col, text_col))
    if not rows_.where("doc_id is null").isEmpty():
        kept = kept.unionByName(_nameless(docs.where(own.isNull()), labels.where("component_id is null"), text_col))
    return kept


def _by_text(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of rows with ids that are repeated, one for each component whose smallest id is theirs."""
    text = F.col(f"`{text_col}`")
    of_text = fingerprints(docs.select(text.alias("doc_id"), text.alias("text"))).distinct().join(labels, F.col("fp") == F.col("label_fp"))
    of_text = of_text.select(F.col("doc_id").alias("_lodestar_text"), F.col("root").alias("_lodestar_root"), F.col("component_id").alias("_lodestar_component"))
    found = docs.join(of_text, text.eqNullSafe(F.col("_lodestar_text")) & (F.col(f"`{id_col}`") == F.col("_lodestar_component")))
    return found.dropDuplicates([id_col, "_lodestar_root"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def _nameless(docs: DataFrame, labels: DataFrame, text_col: str) -> DataFrame:
    """Of rows without an id, one for each component in which no row has one."""
    text = F.col(f"`{text_col}`")
    of_text = fingerprints(docs.select(text.alias("doc_id"), text.alias("text"))).distinct().join(labels, F.col("fp") == F.col("label_fp"))
    chosen = of_text.groupBy("root").agg(F.min("doc_id").alias("_lodestar_chosen")).select("_lodestar_chosen")
    return docs.join(chosen, text.eqNullSafe(F.col("_lodestar_chosen")), "left_semi").dropDuplicates([text_col])


__all__ = ["components", "deduplicated", "fingerprint", "fingerprints", "linked", "links"]
