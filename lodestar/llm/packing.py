"""Packing: concatenate all documents and cut the stream into fixed windows.

Pass one tokenizes and stores the ids with their position inside the task.
The tasks' totals, summed in order, give each task's place in the global
stream; pass two adds that place to every document's position and cuts at the
multiples of the window. Nothing is shuffled: a document's windows follow from
its global start alone, and a window's pieces can lie in several tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.store import Scratch, batch, rows
from lodestar.llm.tokens import id_type, part_starts, tokenized, vocabulary_size

SEQUENCE = 4096


def packed(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of the packed stream, one row each.

    Columns: ``doc_id``, ``start`` (ids of its document before it), ``length``,
    ``ids`` (little-endian bytes of ``id_type``; null without ``with_ids``),
    ``ids_crc32`` (of the ids as unsigned 32-bit integers), ``doc_tokens``,
    ``sequence_id``, ``offset`` (its place in that sequence) and ``boundary``:
    true where the window's edge cut the document, so that the piece continues
    in the neighbouring sequence.

    Every sequence but the last is full. A null text is an empty document, which
    still has its end id. Repeated rows are packed as often as they occur, null
    ids are carried through, other columns are ignored and an empty table gives
    no pieces. The order of the stream is that of the scan.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    stored = scratch.write(tokenized(docs, tokenizer, end_id, id_col, text_col), "ids")
    starts = part_starts(stored)
    dtype = id_type(vocabulary_size(tokenizer))
    id_kind = stored.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        width = dtype.itemsize
        for b in rows(batches, 512):
            out = [[] for _ in range(9)]
            part, local, n = (b.column(k).to_numpy() for k in (0, 1, 3))
            docs_, ids = b.column(2).to_pylist(), b.column(4).to_pylist()
            for k in range(b.num_rows):
                first = starts[int(part[k])] + int(local[k])
                end, at = first + int(n[k]), first
                while at < end:
                    to = min(end, (at // window + 1) * window)
                    boundary = (at > first) or (to < end)
                    piece = ids[k][(at - first) * width : (to - first) * width]
                    for o, x in zip(out, (docs_[k], at - first, to - at, piece if with_ids else None, crc32_of(piece, dtype), int(n[k]), at // window, at % window, boundary), strict=True):
                        o.append(x)
                    at = to
            schema = pa.schema([("doc_id", b.schema.field(2).type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("boundary", pa.bool_())])
            yield batch(schema, *out)

    return stored.select("part", "local_start", "doc_id", "n_tokens", "ids").mapInArrow(
        cut, f"doc_id {id_kind}, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, boundary boolean"
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id, length, ids``.

    A sequence has at most a window of ids, so each group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"),
    )


def crc32_of(ids: bytes, dtype: np.dtype) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.frombuffer(ids, dtype=dtype).astype("<u4").tobytes())
