"""Token ids and their packing into fixed rows: best-fit decreasing over a segment tree of free capacities."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Tokens of a packed row.
ROW_TOKENS = 2048
#: Tokens that a task gathers before it packs them; bounds its memory.
BLOCK_TOKENS = 2_000_000

PACKED = (
    "ids binary, cu_seqlens array<int>, resets array<int>, n_tokens int, "
    "segments array<struct<id:bigint, part:int, parts:int, start:int, length:int>>"
)
_SEGMENT = pa.struct(
    [("id", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("start", pa.int32()), ("length", pa.int32())]
)
_PACKED = pa.schema(
    [
        ("ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("resets", pa.list_(pa.int32())),
        ("n_tokens", pa.int32()),
        ("segments", pa.list_(_SEGMENT)),
    ]
)


class FreeSpace:
    """Open rows by free capacity; a segment tree finds the smallest capacity that is enough."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, row: int, free: int) -> None:
        self.rows[free].append(row)
        self._count(free, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The row with the least free capacity of at least ``size``, and that capacity; it is taken out."""
        node, tree, width = size + self.width, self.tree, self.width
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < width:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        free = node - width
        row = self.rows[free].pop()
        self._count(free, -1)
        return row, free

    def _count(self, free: int, by: int) -> None:
        node = free + self.width
        while node:
            self.tree[node] += by
            node >>= 1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of item numbers: each item, longest first, goes where it leaves the least room."""
    free, rows = FreeSpace(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = free.take(lengths[item])
        if found is None:
            found = len(rows), capacity
            rows.append([])
        row, room = found
        rows[row].append(item)
        if room > lengths[item]:
            free.add(row, room - lengths[item])
    return rows


class TextIds:
    """Ids of whole texts by a rank file: the encoder cuts a text into matches of ``pattern`` and encodes each by itself."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()


def token_ids(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``ids`` (little-endian unsigned 32-bit, binary) of each row; null and empty texts have none.

    ``ranks`` is the content of a rank file, whose size its vocabulary bounds.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = TextIds(shared.value, pattern)
        for texts in batches:
            yield pa.array([ids(t.as_py()) if t.is_valid else b"" for t in texts], pa.binary())

    to_ids = F.arrow_udf(encode, BinaryType())
    return docs.select(F.col(id_col).cast("long").alias("id"), to_ids(F.col(text_col)).alias("ids"))


def pack(tokens: DataFrame, row_tokens: int = ROW_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Packed rows from ``id`` and ``ids`` (binary of 32-bit ids).

    A document longer than a row is split into whole rows and a rest, nothing
    is cut off. Each task packs blocks of ``block_tokens`` of its own
    documents, so ids do not move between executors and memory is bounded;
    only the last rows of a block stay partly empty. A packed row has ``ids``
    (padded with 0 to ``row_tokens``), ``cu_seqlens`` (0, then the end of each
    segment), ``resets`` (where position ids start again from 0), ``n_tokens``
    and its ``segments``: document, part of how many, start and length.
    Documents without tokens, null ids columns included, appear in no row;
    null document ids are kept as null. Repeated ids are packed as they come.
    """

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0
        for batch in batches:
            for key, ids in zip(batch.column(0), batch.column(1)):
                if ids.is_valid and len(values := np.frombuffer(ids.as_buffer(), dtype="<u4")):
                    block.append((key.as_py(), values))
                    held += len(values)
                    if held >= block_tokens:
                        yield from _packed(block, row_tokens)
                        block, held = [], 0
        if block:
            yield from _packed(block, row_tokens)

    return tokens.select("id", "ids").mapInArrow(pack_rows, PACKED)


def _packed(block: list[tuple], capacity: int) -> Iterator[pa.RecordBatch]:
    pieces = []
    for key, ids in block:
        parts = -(-len(ids) // capacity)
        pieces += [(key, k, parts, ids[k * capacity : (k + 1) * capacity]) for k in range(parts)]
    rows = best_fit_decreasing([len(p[3]) for p in pieces], capacity)
    for first in range(0, len(rows), 512):
        columns: list[list] = [[], [], [], [], []]
        for row in rows[first : first + 512]:
            matrix, ends, segments = np.zeros(capacity, dtype="<u4"), [0], []
            for item in row:
                key, part, parts, ids = pieces[item]
                start = ends[-1]
                matrix[start : start + len(ids)] = ids
                ends.append(start + len(ids))
                segments.append({"id": key, "part": part, "parts": parts, "start": start, "length": len(ids)})
            for column, value in zip(columns, (matrix.tobytes(), ends, ends[:-1], ends[-1], segments)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED)], schema=_PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet: ``ids`` of all rows of a file form its id matrix."""
    packed.write.mode("overwrite").parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """``id`` and ``ids`` of each document again, from its parts in order.

    Documents without tokens are not in packed rows and do not come back;
    null or repeated ids cannot be told apart here and are joined up by part.
    """
    each = packed.select("ids", F.explode("segments").alias("s")).select(
        F.col("s.id").alias("id"),
        F.col("s.part").alias("part"),
        F.expr("substring(ids, 4 * s.start + 1, 4 * s.length)").alias("piece"),
    )
    parts = F.array_sort(F.collect_list(F.struct("part", "piece")))
    joined = F.aggregate(parts, F.lit("").cast("binary"), lambda all_, p: F.concat(all_, p["piece"]))
    return each.groupBy("id").agg(joined.alias("ids"))
