"""Fill-in-middle: texts cut between lines and put together in another order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tallyforge.llm.common import own_name

#: Marks of prefix, suffix and middle. Each begins with a character that it holds nowhere else, so none arises at a seam.
MARKS = ("<P>", "<S>", "<M>")
#: Characters of a text whose line ends are looked for at once.
BLOCK_CHARS = 1 << 20


class ArrayContainer:
    """Offsets as they are."""

    def __init__(self, low: np.ndarray):
        self.low = low

    @staticmethod
    def bytes(low: np.ndarray) -> int:
        return 2 * len(low)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """A bit for each of 65,536 offsets, with the bits before each word of 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    @staticmethod
    def bytes(low: np.ndarray) -> int:
        return 1 << 13

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        bits = int(self.words[word])
        for _ in range(k - int(self.before[word])):
            bits &= bits - 1
        return 64 * word + (bits & -bits).bit_length() - 1


class RunContainer:
    """Starts of runs of adjacent offsets, with the offsets before each run."""

    def __init__(self, low: np.ndarray):
        first = _run_starts(low)
        self.start, self.before = low[first], first

    @staticmethod
    def bytes(low: np.ndarray) -> int:
        return 4 * len(_run_starts(low))

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.start[run]) + k - int(self.before[run])


def _run_starts(low: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(low.astype(np.int64)) != 1) + 1])


class BoundarySet:
    """Ascending distinct offsets, in a container for each 65,536 of them that is the smallest of its kinds."""

    KINDS = (ArrayContainer, RunContainer, BitmapContainer)

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        first = np.concatenate([[0], np.flatnonzero(np.diff(high)) + 1]) if len(offsets) else np.zeros(0, np.int64)
        self.high, self.before, self.size = high[first], first, len(offsets)
        parts = np.split((offsets & 0xFFFF).astype(np.uint16), first[1:]) if len(offsets) else []
        self.containers = [min(self.KINDS, key=lambda kind: kind.bytes(part))(part) for part in parts]

    def select(self, k: int) -> int:
        """The k-th offset, from 0: the container by offsets before it, then the place inside."""
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return (int(self.high[at]) << 16) | self.containers[at].select(k - int(self.before[at]))


def boundaries(text: str) -> BoundarySet:
    """Code points before each line, and in the whole text: lines end behind a line end or with the text."""
    found = [np.zeros(1, np.int64)]
    for first in range(0, len(text), BLOCK_CHARS):
        points = np.frombuffer(text[first : first + BLOCK_CHARS].encode("utf-32-le"), "<u4")
        found.append(np.flatnonzero(points == 10) + (first + 1))
    if text and text[-1] != "\n":
        found.append(np.array([len(text)]))
    return BoundarySet(np.concatenate(found))


def _cuts(texts: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    rows = []
    for text, a, b in zip(texts.to_pylist(), one.to_pylist(), other.to_pylist()):
        places = boundaries(text)
        n = places.size - 1
        a, b = sorted((a % (n + 1), b % (n + 1)))
        rows.append((n, places.select(a), places.select(b)))
    return pa.StructArray.from_arrays(
        [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], names=["n", "first", "second"]
    )


def cut_columns(text: Column, one: Column, other: Column) -> Column:
    """A struct of the lines ``n`` and the code points up to the lesser and the greater of two drawn line numbers."""

    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _cuts(*batch)

    kind = StructType().add("n", LongType()).add("first", LongType()).add("second", LongType())
    return F.arrow_udf(cut, kind)(text, one, other)


def fill_in_middle(
    docs: DataFrame,
    keep: list,
    seed: int = 7,
    rate: int = 100,
    suffix_first: int = 50,
    marks: tuple[str, str, str] = MARKS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Columns ``keep`` of each row with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    A text of ``n`` lines is cut behind two numbers of lines that are drawn
    from the digest of seed and id; so are the share in per cent that is cut
    at all (``rate``) and that gets its suffix first (``suffix_first``, form
    "spm", otherwise "psm"). Only offsets come back from Python; texts are
    cut and joined where they are, without a shuffle.

    Null texts are empty. Texts that are empty, hold a mark or are not drawn
    stay as they are (form "plain", null lengths). Rows without an id are
    drawn alike, as are rows that repeat one. New columns whose names ``keep``
    has already get underscores behind. An empty table gives no rows.
    """
    kept = docs.select(*keep).columns
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    given = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.struct(*keep).alias("kept"), given.alias("text"), cut_columns(given, drawn[0], drawn[1]).alias("cut"),
        F.array(*drawn[2:]).alias("drawn"),
    )
    text, first, second = F.col("text"), F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    held = sum((F.contains(text, F.lit(m)).cast("int") for m in marks), F.lit(0)) > 0
    plain = (text == "") | held | (F.get("drawn", F.lit(0)) % 100 >= rate)
    form = F.when(plain, "plain").when(F.get("drawn", F.lit(1)) % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    pre, suf, mid = (F.lit(m) for m in marks)
    prefix, middle = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first)
    suffix = F.substring(text, second + 1, F.length(text))
    output = (
        F.when(F.col("form") == "psm", F.concat(pre, prefix, suf, suffix, mid, middle))
        .when(F.col("form") == "spm", F.concat(suf, suffix, pre, prefix, mid, middle))
        .otherwise(text)
    )
    whole = F.col("form") == "plain"
    found = {
        "n": F.col("cut.n"),
        "form": F.col("form"),
        "prefix_chars": F.when(~whole, F.col("cut.first")),
        "middle_chars": F.when(~whole, F.col("cut.second") - F.col("cut.first")),
        "output": output,
    }
    return rows.select(*[F.col(f"kept.`{c}`") for c in kept], *[c.alias(own_name(kept, name)) for name, c in found.items()])


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text before ``fill_in_middle``. A cut text holds no mark of its own, so it falls into its parts at the marks."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks))
    one, two, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one)).otherwise(output)
