"""Byte-level BPE by recursive SQL inside each partition."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Distinct words of one recursive query, and words whose ids a task remembers.
QUERY_WORDS = 10_000
MEMORY_WORDS = 300_000
#: Tokens of one decoding query, and characters of texts handled at once.
QUERY_TOKENS = 200_000
GROUP_CHARS = 2_000_000
#: Words of more bytes are contracted by a heap: the recursion costs rows times steps.
RECURSION_BYTES = 64

#: Each row is a token of a word with its right neighbour; ``b`` packs rank and place of the word's
#: leftmost pair of least rank, ``gone`` is the place that pair's right half gives up. A step writes the
#: merged token at ``b``, links it past ``gone`` and looks for the next pair; words without one are done.
#: Ordered aggregation then lists a word's ids and puts the bytes of these ids together again.
ENCODE = """
WITH RECURSIVE part(w, pos, tok, npos, ntok, b, gone) AS (
    SELECT s.w, s.pos, s.tok, s.npos, s.ntok, best.b, best.gone
    FROM start s LEFT JOIN (
        SELECT w, min((rank::BIGINT << 32) | pos) AS b, arg_min(npos, (rank::BIGINT << 32) | pos) AS gone
        FROM start JOIN merges ON l = tok AND r = ntok GROUP BY w
    ) best USING (w)
    UNION ALL (
        WITH open_words AS (SELECT * FROM part WHERE b IS NOT NULL),
        rest AS (SELECT w, npos AS rest_pos, ntok AS rest_tok FROM open_words WHERE pos = gone),
        moved AS (
            SELECT o.w, o.pos,
                CASE WHEN o.pos = b & 4294967295 THEN (b >> 32)::INT ELSE tok END AS tok,
                CASE WHEN o.pos = b & 4294967295 THEN rest_pos ELSE npos END AS npos,
                CASE WHEN o.pos = b & 4294967295 THEN rest_tok
                     WHEN npos = b & 4294967295 THEN (b >> 32)::INT ELSE ntok END AS ntok
            FROM open_words o JOIN rest USING (w) WHERE o.pos <> gone
        ),
        best AS (
            SELECT w, min((rank::BIGINT << 32) | pos) AS b, arg_min(npos, (rank::BIGINT << 32) | pos) AS gone
            FROM moved JOIN merges ON l = tok AND r = ntok GROUP BY w
        )
        SELECT m.w, m.pos, m.tok, m.npos, m.ntok, best.b, best.gone FROM moved m LEFT JOIN best USING (w)
    )
)
SELECT w, list(tok ORDER BY pos) AS ids, string_agg(piece, '' ORDER BY pos) AS bytes
FROM part JOIN pieces USING (tok) WHERE b IS NULL GROUP BY w ORDER BY w
"""

DECODE = """
SELECT d, string_agg(piece, '' ORDER BY pos) AS bytes FROM tokens JOIN pieces USING (tok) GROUP BY d ORDER BY d
"""


class Codec:
    """Encoder and decoder over a rank file, in a private in-memory database of bounded size.

    ``ranks`` is the content of the file: base64 of a token's bytes and its
    rank, which is its id. The merge table holds every pair of tokens whose
    bytes together are a token. Distinct words are encoded and their ids
    decoded once. Their ids are remembered, and what they decode to where that
    is not the word itself. When the younger half of the memory is full, it
    takes the place of the older half, except for the words just met, which
    stay in both; so frequent words are not learnt again.
    """

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.token_bytes = {rank: token for token, rank in self.ranks.items()}
        self.split = splitter(pattern)
        self.known: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        merges = [
            (a, b, rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (a := self.ranks.get(token[:cut])) is not None and (b := self.ranks.get(token[cut:])) is not None
        ]
        left, right, rank = (pa.array(x, pa.int32()) for x in (zip(*merges) if merges else ([], [], [])))
        pieces = {"tok": pa.array(self.ranks.values(), pa.int32()), "piece": [t.decode("latin-1") for t in self.ranks]}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        self._table("merges", pa.table({"l": left, "r": right, "rank": rank}))
        self._table("pieces", pa.table(pieces))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.sql(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of each text as little-endian unsigned 32-bit integers, and the bytes that these ids decode to."""
        split, known = [self.split(t) for t in texts], self.known
        words = set().union(*split)
        missing = words - known.keys()
        recalled, odd = missing & self.older[0].keys(), self.older[1]
        again = {w: self.older[0][w] for w in recalled}, {w: odd[w] for w in recalled & odd.keys()}
        if 2 * (len(known) + len(missing)) > MEMORY_WORDS:
            self.older = known, self.odd
            kept = words & known.keys()
            self.odd = {w: self.odd[w] for w in kept & self.odd.keys()}
            self.known = known = {w: known[w] for w in kept}
        known.update(again[0])
        self.odd.update(again[1])
        self._learn(missing - recalled)
        ids = [b"".join([known[w] for w in own]) for own in split]
        if not self.odd:
            return ids, ["".join(own).encode() for own in split]
        return ids, [b"".join([self.odd.get(w) or w.encode() for w in own]) for own in split]

    def _remember(self, word: str, ids: bytes, decoded: bytes) -> None:
        self.known[word] = ids
        if decoded != word.encode():
            self.odd[word] = decoded

    def _learn(self, words: set[str]) -> None:
        """Ids of new words, and the bytes those ids decode to; equal words share the work."""
        parts = []
        for word in words:
            raw = word.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self._remember(word, whole.to_bytes(4, "little"), self.token_bytes[whole])
            elif len(raw) > RECURSION_BYTES:
                ids = np.array(self._long(raw), "<u4").tobytes()
                self._remember(word, ids, self.decode([ids])[0])
            else:
                parts.append((word, raw))
        for first in range(0, len(parts), QUERY_WORDS):
            self._contract(parts[first : first + QUERY_WORDS])

    def _contract(self, parts: list[tuple[str, bytes]]) -> None:
        lengths = np.array([len(raw) for _, raw in parts])
        tok = self.byte_ids[np.frombuffer(b"".join(raw for _, raw in parts), np.uint8)]
        ends = np.cumsum(lengths)
        last = np.zeros(len(tok), bool)
        last[ends - 1] = True
        pos = (np.arange(len(tok)) - np.repeat(ends - lengths, lengths)).astype(np.int32)
        rows = {
            "w": np.repeat(np.arange(len(parts), dtype=np.int32), lengths),
            "pos": pos,
            "tok": tok,
            "npos": pa.array(pos + 1, pa.int32(), mask=last),
            "ntok": pa.array(np.roll(tok, -1), pa.int32(), mask=last),
        }
        self.db.register("start", pa.table(rows))
        found = self.db.sql(ENCODE).to_arrow_table().combine_chunks()
        self.db.unregister("start")
        ids = found["ids"].chunk(0)
        flat, at = ids.values.to_numpy().astype("<u4").tobytes(), (ids.offsets.to_numpy() * 4).tolist()
        decoded = [text.encode("latin-1") for text in found["bytes"].to_pylist()]
        for (word, _), a, b, own in zip(parts, at, at[1:], decoded):
            self._remember(word, flat[a:b], own)

    def _long(self, raw: bytes) -> list[int]:
        """The same contraction by a heap of pairs over linked places."""
        tokens = [raw[i : i + 1] for i in range(len(raw))]
        after, before = [*range(1, len(raw)), -1], [*range(-1, len(raw) - 1)]
        heap: list[tuple[int, int, bytes, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (rank := self.ranks.get(tokens[i] + tokens[j])) is not None:
                heapq.heappush(heap, (rank, i, tokens[i], tokens[j]))

        for i in range(len(raw)):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != left or j < 0 or tokens[j] != right:
                continue
            tokens[i], tokens[j] = left + right, b""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [self.ranks[t] for t in tokens if t]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence, by aggregation in token order; a single id is looked up."""
        result = [self.token_bytes[int.from_bytes(own, "little")] if len(own) == 4 else b"" for own in ids]
        places = [i for i, own in enumerate(ids) if len(own) > 4]
        for i, text in zip(places, self._decode_all([ids[i] for i in places])):
            result[i] = text
        return result

    def _decode_all(self, ids: list[bytes]) -> list[bytes]:
        result, group, held = [], [], 0
        for own in ids:
            group.append(np.frombuffer(own, "<u4"))
            held += len(group[-1])
            if held >= QUERY_TOKENS:
                result += self._decode(group)
                group, held = [], 0
        return result + self._decode(group)

    def _decode(self, group: list[np.ndarray]) -> list[bytes]:
        result = [b""] * len(group)
        lengths = np.array([len(g) for g in group], np.int64)
        if not lengths.sum():
            return result
        rows = {
            "d": np.repeat(np.arange(len(group), dtype=np.int32), lengths),
            "pos": np.arange(lengths.sum()),
            "tok": np.concatenate(group).astype(np.int32),
        }
        self.db.register("tokens", pa.table(rows))
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("tokens")
        for d, text in zip(found["d"].to_pylist(), found["bytes"].to_pylist()):
            result[d] = text.encode("latin-1")
        return result


#: Latin-1 characters that the two pattern dialects class differently: numbers that are no digits, and separators.
_APART = "²³¹¼½¾\x1c\x1d\x1e\x1f"


def splitter(pattern: str):
    """Matches of ``pattern``; its letter and number classes in Latin-1 texts are put in the faster dialect."""
    whole = regex.compile(pattern).findall
    plain = pattern.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    if "\\p" in plain:
        return whole
    quick = re.compile(plain).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole(text)
        return whole(text) if any(c in text for c in _APART) else quick(text)

    return split


def token_rows(ranks: bytes, pattern: str, spark) -> object:
    """A function over batches whose last column is the text: it gives way to ``ids`` (binary of 32-bit ids) and ``decoded``.

    Rows leave in groups of about ``GROUP_CHARS`` characters, so a task holds the result of a group and not of a batch.
    """
    shared = spark.sparkContext.broadcast(ranks)

    def encode_decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern)

        def coded(batch: pa.RecordBatch, first: int, texts: list[str]) -> pa.RecordBatch:
            kept = batch.slice(first, len(texts)).columns[:-1]
            found = [pa.array(x, pa.binary()) for x in codec.encode(texts)]
            return pa.RecordBatch.from_arrays([*kept, *found], names=[*batch.schema.names[:-1], "ids", "decoded"])

        for batch in batches:
            group, size, first = [], 0, 0
            for text in batch.column(batch.num_columns - 1):
                group.append(text.as_py() or "")
                size += len(group[-1])
                if size >= GROUP_CHARS:
                    yield coded(batch, first, group)
                    first += len(group)
                    group, size = [], 0
            if group:
                yield coded(batch, first, group)

    return encode_decode


def tokenize(docs: DataFrame, ranks: bytes, pattern: str, keep: list, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of each row with ``ids`` and ``decoded``.

    Each match of ``pattern`` is encoded by itself, without special tokens;
    null and empty texts give empty binaries. Repeated rows come back alike.
    The vocabulary bounds the broadcast rank file. No shuffle.
    """
    rows = docs.select(*keep, F.col(text_col).alias("found_text"))
    schema = StructType([*rows.schema.fields[:-1], StructField("ids", BinaryType()), StructField("decoded", BinaryType())])
    return rows.mapInArrow(token_rows(ranks, pattern, docs.sparkSession), schema)


def decode_ids(tokens: DataFrame, ranks: bytes, pattern: str, keep: list, ids_col: str = "ids") -> DataFrame:
    """Columns ``keep`` of each row with ``decoded``, the bytes of its ids; null ids decode to nothing."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(shared.value, pattern)
        for ids in batches:
            yield pa.array(codec.decode([i or b"" for i in ids.to_pylist()]), pa.binary())

    return tokens.select(*keep, F.arrow_udf(decode, BinaryType())(F.col(ids_col)).alias("decoded"))
