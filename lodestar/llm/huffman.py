"""Token ids in canonical length-limited Huffman code.

One code for the whole corpus, made from global counts. The stream of ids in
ascending document order is cut into independent blocks of whole documents;
within a block the bit offset of every ``CHECKPOINT``-th id is stored, so that
decoding is a table look-up that advances all checkpoints of many blocks in
step, and any part of a block can be read without what comes before it.

The file format is a folder of two Parquet tables, which any file system that
Spark knows can hold and whose writers commit whole tasks or nothing:

``code``    token_id, bits (the length of its code; codes follow canonically)
``blocks``  part, before (ids of the part before the block), doc_ids, lengths, checkpoints, payload
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.packing import crc32_of
from lodestar.llm.store import Scratch, batch, partitions, rows
from lodestar.llm.tokens import id_type, part_starts, tokenized, vocabulary_size

#: Longest code in bits; raised only for vocabularies that need more.
MAX_BITS = 18
#: Ids between checkpoints.
CHECKPOINT = 256
#: Ids in a block, unless one document has more.
BLOCK = 1 << 16


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol in an optimal prefix code of at most ``max_bits``; 0 for count 0.

    Package-merge: a symbol's length is the number of levels whose cheapest
    packages contain it. A lone symbol gets one bit.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    max_bits = max(max_bits, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    # A level is the sorted list of single symbols (their rank) and of packages (-1); only how many of the
    # cheapest entries are symbols matters for counting, as symbols are taken in order of rank.
    levels, packages = [], np.zeros(0)
    for _ in range(max_bits):
        merged = np.concatenate([weight, packages])
        by = np.argsort(merged, kind="stable")
        levels.append(by < n)
        merged = merged[by]
        half = len(merged) // 2
        packages = merged[: 2 * half : 2] + merged[1 : 2 * half : 2]
    take, bits = 2 * n - 2, np.zeros(n, dtype=np.uint8)
    for single in reversed(levels):
        symbols = int(single[:take].sum())
        bits[:symbols] += 1
        take = 2 * (take - symbols)
    lengths[order] = bits
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol, as right-aligned integers."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code, last = 0, 0
    for symbol in np.lexsort((np.arange(len(lengths)), lengths)):
        bits = int(lengths[symbol])
        if bits:
            code <<= bits - last
            codes[symbol], last = code, bits
            code += 1
    return codes


def pack_bits(codes: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes one after the other, and the bit offset of each."""
    ends = np.cumsum(bits, dtype=np.int64)
    at = ends - bits
    if not len(bits):
        return b"", at
    word, shift = at >> 5, (64 - (at & 31) - bits).astype(np.uint64)
    value = codes << shift
    words = np.zeros(int(ends[-1] - 1 >> 5) + 2, dtype=np.uint32)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[starts]] |= np.bitwise_or.reduceat((value >> np.uint64(32)).astype(np.uint32), starts)
    words[word[starts] + 1] |= np.bitwise_or.reduceat(value.astype(np.uint32), starts)
    return words.astype(">u4").tobytes()[: int(ends[-1] + 7) // 8], at


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For every string of ``width`` bits ``symbol << 5 | bits`` of the code it begins with; the width."""
    width = max(1, int(lengths.max(initial=1)))
    codes, used = canonical_codes(lengths), np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    spans = np.int64(1) << (width - lengths[used].astype(np.int64))
    table = np.zeros(1 << width, dtype=np.int64)
    filled = np.repeat((used.astype(np.int64) << 5) | lengths[used], spans)
    assert not len(used) or int(codes[used[0]]) == 0
    table[: len(filled)] = filled
    return table, width


def decode(payload: bytes, starts: np.ndarray, counts: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """The ids of all checkpoint intervals of ``payload``, in order; ``starts`` are bit offsets."""
    data = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8)
    # The 32 bits from each byte on; a code of up to 25 bits lies within them wherever it begins.
    quads = data[:-3].astype(np.uint32) << 24
    quads |= data[1:-2].astype(np.uint32) << 16
    quads |= data[2:-1].astype(np.uint32) << 8
    quads |= data[3:]
    out = np.zeros((int(counts.max(initial=0)), len(starts)), dtype=np.uint32)
    at, live = starts.astype(np.int64), np.arange(len(starts))
    mask = (1 << width) - 1
    for step in range(len(out)):
        live = live[counts[live] > step] if step and (counts[live] <= step).any() else live
        here = at[live]
        found = table[(quads[here >> 3] >> (32 - width - (here & 7)).astype(np.uint32)).astype(np.int64) & mask]
        out[step, live] = found >> 5
        at[live] = here + (found & 31)
    steps = np.arange(len(out))[:, None] < counts[None, :]
    return out.T[steps.T]


@lru_cache(maxsize=2)
def _table_of(packed_lengths: bytes) -> tuple[np.ndarray, int]:
    return decoding_table(np.frombuffer(packed_lengths, dtype=np.uint8))


def id_counts(stored: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in a stored table of ``ids``; at most a row for each id comes to the driver."""
    dtype = id_type(vocabulary)

    def count(batches):
        total = np.zeros(vocabulary, dtype=np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=dtype), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["token_id", "n"])

    counted = stored.select("ids").mapInArrow(count, "token_id bigint, n bigint").groupBy("token_id").agg(F.sum("n"))
    counts = np.zeros(vocabulary, dtype=np.int64)
    for token, n in counted.collect():
        counts[token] = n
    return counts


def write_encoded(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, in ascending id order, to ``path``.

    Documents are tokenized once and stored; counts of all ids make the code;
    a range partitioning of the stored ids by document id puts the stream in
    order. A null text is an empty document with its end id. Null document ids
    come first, rows with one id are ordered by a hash of their ids and may lie
    in several partitions, other columns
    are ignored, an empty table gives files without blocks.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "huffman")
    vocabulary = max(vocabulary_size(tokenizer), end_id + 1)
    stored = scratch.write(tokenized(docs, tokenizer, end_id, id_col, text_col), "ids")
    counts = id_counts(stored, vocabulary)
    lengths = code_lengths(counts)
    codes, dtype = canonical_codes(lengths), id_type(vocabulary)
    used = np.flatnonzero(lengths)
    book = pa.table({"token_id": pa.array(used, pa.int64()), "bits": pa.array(lengths[used].astype(np.int32))})
    spark.createDataFrame(book.to_pandas(), "token_id bigint, bits int").coalesce(1).write.mode("overwrite").parquet(f"{path}/code")

    def encode(batches):
        part, before = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush(id_type_):
            nonlocal before, held, size
            ids = np.frombuffer(b"".join(x for _, x in held), dtype=dtype)
            payload, at = pack_bits(codes[ids], lengths[ids].astype(np.int64))
            schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(id_type_)), ("lengths", pa.list_(pa.int64())), ("checkpoints", pa.list_(pa.int64())), ("payload", pa.binary())])
            n = [len(x) // dtype.itemsize for _, x in held]
            made = batch(schema, [part], [before], [[d for d, _ in held]], [n], [at[::CHECKPOINT].tolist()], [payload])
            before, held, size = before + len(ids), [], 0
            return made

        kind = None
        for b in rows(batches, 256):
            kind = b.schema.field(0).type
            for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = len(ids) // dtype.itemsize
                if held and size + n > BLOCK:
                    yield flush(kind)
                held.append((doc, ids))
                size += n
        if held:
            yield flush(kind)

    kind = stored.schema["doc_id"].dataType.simpleString()
    # The row's number in the stored table parts rows that are alike, so that an id with many rows can be cut anywhere.
    order = ["doc_id", "hash", "row"]
    ordered = stored.select("doc_id", "ids", F.xxhash64("ids").alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = ordered.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    ordered.mapInArrow(encode, f"part int, before bigint, doc_ids array<{kind}>, lengths array<bigint>, checkpoints array<bigint>, payload binary").write.mode("overwrite").parquet(f"{path}/blocks")
    scratch.drop("ids")


def read_encoded(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of files that ``write_encoded`` made.

    Columns: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids`` (little-endian 32-bit; null without ``with_ids``) and
    ``ids_crc32``. Blocks are decoded independently of each other.
    """
    book = spark.read.parquet(f"{path}/code").collect()
    lengths = np.zeros(max((r["token_id"] for r in book), default=0) + 1, dtype=np.uint8)
    for r in book:
        lengths[r["token_id"]] = r["bits"]
    packed_lengths = lengths.tobytes()
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = blocks.select("part", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    starts = part_starts(sizes, "n")

    def unpack(batches):
        table, width = _table_of(packed_lengths)
        for b in rows(batches, 16):
            doc_ids, sizes_, checks, payloads, block_starts, parts = (b.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 5))
            totals = np.array([sum(x) for x in sizes_], dtype=np.int64)
            base = np.cumsum([0] + [8 * len(p) for p in payloads])
            at = np.concatenate([np.array(c, dtype=np.int64) + base[k] for k, c in enumerate(checks)])
            counts = np.concatenate([np.minimum(CHECKPOINT, t - CHECKPOINT * np.arange(len(c))) for t, c in zip(totals, checks, strict=True)])
            ids = decode(b"".join(payloads), at, counts, table, width).astype("<u4")
            n = np.concatenate([np.array(x, dtype=np.int64) for x in sizes_])
            ends = np.cumsum(n)
            first = np.repeat(np.cumsum(totals) - totals, [len(x) for x in sizes_])
            place = np.repeat([starts[p] + s for p, s in zip(parts, block_starts, strict=True)], [len(x) for x in sizes_])
            texts = [ids[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            schema = pa.schema([("doc_id", b.schema.field(0).type.value_type), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])
            yield batch(schema, [d for x in doc_ids for d in x], place + ends - n - first, n, texts if with_ids else [None] * len(n), [crc32_of(x, np.dtype("<u4")) for x in texts])

    columns = blocks.select("doc_ids", "lengths", "checkpoints", "payload", "before", "part")
    return columns.mapInArrow(unpack, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary, ids_crc32 bigint")
