"""Language identification by unigram pieces, with all segmentations of a word summed."""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from tallyforge.llm.common import settle

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: Bytes after which a pass brings its chances back near one, and bytes of words of one length that go together.
RESCALE = 8
GROUP_BYTES = 400_000
#: Bound of the training sample: documents, shared out evenly among the languages and taken in the order of the
#: hashes of id and text; a language gets at least ``LEAST_DOCS``.
SAMPLE_DOCS = 3_000
LEAST_DOCS = 64
EM_ROUNDS = 2
#: Mass added to every piece of every language, relative to one expected piece.
SMOOTHING = 0.02
#: Words whose scores a task remembers.
MEMORY_WORDS = 400_000


class Pieces:
    """A fixed byte-level vocabulary as a trie in arrays.

    ``child`` finds the node behind ``256 * node + byte``; ``piece[node]`` is
    the number of the piece that ends there, or -1. All single bytes are
    pieces, so every text has a segmentation.
    """

    def __init__(self, ranks: bytes):
        pieces = [base64.b64decode(line.split()[0]) for line in ranks.splitlines()]
        usable = [p for p in pieces if len(p) == 1 or _is_word_part(p)]
        self.size, self.longest = len(usable), max(map(len, usable))
        nodes: dict[int, int] = {}
        ends = {}
        for number, piece in enumerate(usable):
            node = 0
            for byte in piece:
                node = nodes.setdefault(node * 256 + byte, len(nodes) + 1)
            ends[node] = number
        keys = np.fromiter(nodes, np.int64, len(nodes))
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.fromiter(nodes.values(), np.int64, len(nodes))[order]
        self.piece = np.full(len(nodes) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next nodes, -1 where there is none."""
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nodes[at], -1)

    def spans(self, words: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """All pieces in words of one length, by start: (start, end, which words, which pieces)."""
        letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1).astype(np.int64)
        for start in range(letters.shape[1]):
            which, node = np.arange(len(words)), np.zeros(len(words), np.int64)
            for end in range(start, letters.shape[1]):
                node = self.child(node, letters[which, end])
                going = node >= 0
                which, node = which[going], node[going]
                if not len(which):
                    break
                found = self.piece[node]
                is_piece = found >= 0
                if is_piece.any():
                    yield start, end + 1, which[is_piece], found[is_piece]


def _is_word_part(piece: bytes) -> bool:
    """Lower-case letters, maybe behind one space; parts of characters count as letters."""
    text = piece.removeprefix(b" ").decode("utf-8", "ignore")
    return (not text or (text.isalpha() and text == text.lower())) and not piece[1:].count(b" ")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return LETTERS.findall(text.lower()) if text else []


@dataclass
class Model:
    """Languages, their priors, and ``chance[piece, language]`` over a piece vocabulary."""

    languages: list[str]
    prior: np.ndarray
    chance: np.ndarray

    def parts(self) -> tuple:
        """Plain values, which a broadcast can carry."""
        return self.languages, self.prior, self.chance

    def log_likelihood(self, pieces: Pieces, words: list[str]) -> np.ndarray:
        """log P(word | language) for each word: a forward pass sums over all segmentations."""
        total = np.zeros((len(words), len(self.languages)))
        for owner, texts in _by_length(words):
            alpha, scale = _forward(pieces, lambda which, found: self.chance[found], texts, len(self.languages))
            total[owner] = np.log(alpha[:, -1]) + scale[:, -1]
        return total


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """A space and the word in UTF-8, with words of equal length together, and the numbers of the words."""
    by: dict[int, tuple[list, list]] = {}
    for number, word in enumerate(words):
        text = b" " + word.encode()
        owners, texts = by.setdefault(len(text), ([], []))
        owners.append(number)
        texts.append(text)
    for length, (owners, texts) in by.items():
        step = max(1, GROUP_BYTES // length)
        for first in range(0, len(texts), step):
            yield np.array(owners[first : first + step]), texts[first : first + step]


def _forward(pieces: Pieces, chance_of, texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """``alpha[text, position, column]``, the chance of a text's first bytes over all segmentations, and ``scale``.

    The chance is alpha times e to the power of scale. Every few bytes alpha
    is brought back near one, so texts of any length neither vanish nor
    overflow; a piece reaches over ``pieces.longest`` bytes at most.
    """
    n = len(texts[0])
    alpha, scale, last = np.zeros((len(texts), n + 1, width)), np.zeros((len(texts), n + 1, width)), 0
    alpha[:, 0] = 1.0
    for start, end, which, found in pieces.spans(texts):
        if start >= last + RESCALE:
            last = start
            now = alpha[:, start].copy()
            now[now == 0.0] = 1.0
            alpha[:, start : start + pieces.longest] /= now[:, None]
            scale[:, start:] += np.log(now)[:, None]
        alpha[which, end] += alpha[which, start] * chance_of(which, found)
    return alpha, scale


def expected_pieces(
    pieces: Pieces, chance: np.ndarray, words: list[str], language: np.ndarray, count: np.ndarray
) -> np.ndarray:
    """Expected piece counts over all segmentations (forward and backward), each word in its language."""
    result, table = np.zeros_like(chance), chance.T
    for owner, texts in _by_length(words):
        own, n = language[owner], len(texts[0])
        alpha, scale = _forward(pieces, lambda which, found, own=own: table[own[which], found][:, None], texts, 1)
        alpha, scale = alpha[:, :, 0], scale[:, :, 0]
        # Backward, each position has a scale of its own: beta times e to the power of behind. Every byte is a piece,
        # so every position begins spans.
        beta, behind, at = np.zeros_like(alpha), np.zeros_like(alpha), n
        beta[:, -1] = 1.0
        spans = list(pieces.spans(texts))
        for start, end, which, found in reversed(spans):
            if start != at:
                behind[:, at] += np.log(beta[:, at])
                beta[:, at] = 1.0
                behind[:, start], at = behind[:, at], start
            beta[which, start] += beta[which, end] * table[own[which], found] * np.exp(behind[which, end] - behind[which, start])
        whole = np.log(alpha[:, -1]) + scale[:, -1]
        for start, end, which, found in spans:
            share = alpha[which, start] * table[own[which], found] * beta[which, end]
            share = share * np.exp(scale[which, start] + behind[which, end] - whole[which])
            np.add.at(result, (found, own[which]), share * count[owner][which])
    return result


def _normalised(counts: np.ndarray) -> np.ndarray:
    smoothed = counts + SMOOTHING
    return smoothed / smoothed.sum(axis=0)


def train(
    docs: DataFrame, ranks: bytes, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Model:
    """Piece chances per language by expectation maximisation over the words of ``docs``.

    Rows without a language or text are left out. The languages and their
    priors are counted over all other rows; the sample is bounded by
    ``SAMPLE_DOCS`` and ``LEAST_DOCS`` documents of each language. Its words are
    counted by language where they are, expectations are summed by Spark, and
    the driver sees tables of pieces by language only. Without a labelled row
    the model knows no language.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    by_lang = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(by_lang)
    if not languages:
        return Model([], np.zeros(0), np.zeros((0, 0)))
    bound = max(SAMPLE_DOCS // len(languages), LEAST_DOCS)
    # Only rows under a threshold of their language are ranked: about twice as many as are wanted. Equal rows are one.
    span = 1 << 40
    limits = [F.lit(x) for lang, n in by_lang.items() for x in (lang, min(span, span * 2 * bound // n))]
    keyed = known.withColumn("key", F.xxhash64("id", "text"))
    keyed = keyed.where(F.pmod("key", F.lit(span)) < F.create_map(*limits)[F.col("lang")])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(span)), "key"))
    chosen = keyed.select("lang", "key").distinct().withColumn("place", place).where(F.col("place") <= bound)
    sample = keyed.join(F.broadcast(chosen.select("lang", "key")), ["lang", "key"])
    sample = sample.groupBy("lang", "key").agg(F.first("text").alias("text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(*(column.to_pylist() for column in batch.columns)):
                seen.setdefault(lang, Counter()).update(words_of(text))
        for lang, own in seen.items():
            words, counts = list(own), list(own.values())
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang] * len(words), "word": words, "n": pa.array(counts, pa.int64())}
            )

    counted = sample.select("lang", "text").mapInArrow(count_words, "lang string, word string, n bigint")
    words = settle(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    documents = np.array([by_lang[lang] for lang in languages], dtype=float)
    pieces = Pieces(ranks)
    model = Model(languages, documents / documents.sum(), np.full((pieces.size, len(languages)), 1.0 / pieces.size))
    shared = spark.sparkContext.broadcast(ranks)
    for _ in range(EM_ROUNDS):
        now = spark.sparkContext.broadcast(model.parts())

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            pieces, model = Pieces(shared.value), Model(*now.value)
            place = {lang: i for i, lang in enumerate(model.languages)}
            total = np.zeros_like(model.chance)
            for batch in batches:
                lang, word, n = (column.to_pylist() for column in batch.columns)
                total += expected_pieces(
                    pieces, model.chance, word, np.array([place[x] for x in lang], dtype=int), np.array(n, dtype=float)
                )
            piece, language = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"piece": piece, "language": language, "n": total[piece, language]})

        expected = words.mapInArrow(expect, "piece bigint, language bigint, n double")
        table = expected.groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(model.chance)
        counts[table["piece"].to_numpy(int), table["language"].to_numpy(int)] = table["n"]
        model = Model(languages, model.prior, _normalised(counts))
    return model


class Scorer:
    """Scores texts with a model and remembers words; the memory is emptied when it is full."""

    def __init__(self, model: Model, ranks: bytes):
        self.model, self.pieces = model, Pieces(ranks)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages)))

    def _learn(self, words: set[str]) -> None:
        if len(self.place) + len(words) > MEMORY_WORDS:
            self._forget()
        fresh = [w for w in words if w not in self.place]
        start = len(self.place)
        self.place.update(zip(fresh, range(start, start + len(fresh))))
        while len(self.scores) < len(self.place):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[start : start + len(fresh)] = self.model.log_likelihood(self.pieces, fresh)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [words_of(t) for t in texts]
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        missing = {w for words in split for w in words if w not in self.place}
        if missing:
            if len(self.place) + len(missing) > MEMORY_WORDS:
                missing = {w for words in split for w in words}
            self._learn(missing)
        return [self._decide(words) for words in split]

    def _decide(self, words: list[str]) -> tuple[str, float]:
        if not words:
            return UNKNOWN, 0.0
        place = self.place
        total = np.log(self.model.prior) + self.scores[[place[w] for w in words]].sum(axis=0)
        best = int(total.argmax())
        return self.model.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def predictions(model: Model, ranks: bytes, spark) -> object:
    """A column function from text to ``lang_pred`` and ``score``."""
    shared, known = spark.sparkContext.broadcast(ranks), spark.sparkContext.broadcast(model.parts())

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(Model(*known.value), shared.value)
        for texts in batches:
            found, group, size = [], [], 0
            for text in texts.to_pylist():
                group.append(text)
                size += len(text or "")
                if size > 4_000_000:
                    found += scorer(group)
                    group, size = [], 0
            found += scorer(group)
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["lang_pred", "score"],
            )

    return F.arrow_udf(predict, StructType().add("lang_pred", StringType()).add("score", DoubleType()))


def identify(docs: DataFrame, model: Model, ranks: bytes, keep: list, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of each row with ``lang_pred`` and ``score``, the posterior of the predicted language.

    Null texts and texts without a letter are ``und`` with score 0, as all are
    when the model knows no language. Ties go to the language first in order.
    Repeated rows are predicted alike; no shuffle.
    """
    kept = docs.select(*keep).columns
    found = predictions(model, ranks, docs.sparkSession)(F.col(text_col)).alias("found_language")
    return docs.select(*keep, found).select(*[f"`{c}`" for c in kept], "found_language.*")
