"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructType

from tallyforge.llm.common import own_name

SYMBOLS = b"#*$%&|<>"
DIGITS = b"0123456789"
CLOSERS = b".!?"
WHITE = " \t\n\x0b\x0c\r"

#: Base rules: fewer words fail, and so does a larger share (percent) of words in repeated windows.
MIN_WORDS = 50
MAX_REPEATED = 50
#: Share of the words in content lines from which a document is kept.
MIN_CONTENT = 0.5
#: Bounds of the training sample: labelled documents, lines of a chain, chains of a document.
SAMPLE_DOCS = 1_500
CHAIN_LINES = 32
CHAINS_PER_DOC = 2

FEATURES = ("bias", "symbols", "digits", "closed", "short", "duplicate", "repeated", "bars", "long_words")

BOILERPLATE, CONTENT = 0, 1


@dataclass
class LineModel:
    """Weights of the two labels: ``emit[label, feature]``, ``step[from, to]`` and ``start[label]``."""

    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Labels of the best path (Viterbi); ties go to content."""
        if not len(features):
            return np.zeros(0, dtype=np.int8)
        scores = (features @ self.emit.T).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        b, c = scores[0][0] + self.start[0], scores[0][1] + self.start[1]
        back = []
        for e0, e1 in scores[1:]:
            from_b, from_c = b + s00, c + s10
            to_b, to_c = b + s01, c + s11
            back.append((from_c >= from_b, to_c >= to_b))
            b, c = max(from_b, from_c) + e0, max(to_b, to_c) + e1
        path = [int(c >= b)]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return np.array(path[::-1], dtype=np.int8)


def measure(text: str | None) -> tuple[dict, np.ndarray, np.ndarray]:
    """Base counts of a text, one feature row per line that has a word, and the words of those lines."""
    raw = [] if not text else text.encode("utf-8", "surrogatepass").split(b"\n")
    split = [line.split() for line in raw]
    kept = [(line, words) for line, words in zip(raw, split) if words]
    words = [w for _, own in kept for w in own]
    repeated = repeated_words(words)
    sums = np.concatenate(([0], np.cumsum(repeated)))
    seen: set[bytes] = set()
    rows, sizes, n_symbols, n_dup, at = [], [], 0, 0, 0
    for line, own in kept:
        n, duplicate = len(own), line in seen
        seen.add(line)
        symbols = len(line) - len(line.translate(None, SYMBOLS))
        digits = len(line) - len(line.translate(None, DIGITS))
        rows.append(
            (
                1.0,
                min(1.0, symbols / n),
                min(1.0, digits / n),
                float(own[-1][-1:] in (b".", b"!", b"?")),
                float(n < 5),
                float(duplicate),
                (sums[at + n] - sums[at]) / n,
                min(1.0, 4 * line.count(b"|") / n),
                float(max(map(len, own)) > 60),
            )
        )
        sizes.append(n)
        n_symbols += symbols
        n_dup += duplicate
        at += n
    counts = {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, WHITE)) if text else 0,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup,
        "n_repeat_words": int(sums[-1]),
    }
    return counts, np.array(rows, dtype=float).reshape(-1, len(FEATURES)), np.array(sizes, dtype=np.int64)


def repeated_words(words: list[bytes], window: int = 3) -> np.ndarray:
    """True for every word inside a window of three words that occurs twice or more in the text."""
    covered = np.zeros(len(words), dtype=bool)
    if len(words) <= window:
        return covered
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    size = len(numbers)
    keys = ids[: len(ids) - window + 1]
    for k in range(1, window):
        _, keys = np.unique(keys * size + ids[k : len(ids) - window + 1 + k], return_inverse=True)
    twice = (np.bincount(keys) > 1)[keys]
    for k in range(window):
        covered[k : len(covered) - window + 1 + k] |= twice
    return covered


def fit(chains: list[np.ndarray], labels: list[np.ndarray], rounds: int = 100, ridge: float = 1e-3) -> LineModel:
    """Maximum likelihood by full-batch gradient ascent; forward and backward run over all chains at once."""
    model = LineModel(np.zeros((2, len(FEATURES))), np.zeros((2, 2)), np.zeros(2))
    if not chains:
        model.emit[CONTENT, 0] = 1.0
        return model
    length = max(map(len, chains))
    x = np.zeros((len(chains), length, len(FEATURES)))
    y = np.zeros((len(chains), length), dtype=int)
    on = np.zeros((len(chains), length), dtype=bool)
    for i, (chain, label) in enumerate(zip(chains, labels)):
        x[i, : len(chain)], y[i, : len(chain)], on[i, : len(chain)] = chain, label, True
    pairs = on[:, 1:]
    one = np.eye(2)[y] * on[..., None]
    true_emit = np.einsum("itl,itf->lf", one, x)
    true_step = np.einsum("ita,itb,it->ab", one[:, :-1], one[:, 1:], pairs)
    params = [model.emit, model.step, model.start]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for round_ in range(1, rounds + 1):
        emit = x @ model.emit.T
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0] + model.start
        for t in range(1, length):
            moved = np.logaddexp.reduce(forward[:, t - 1, :, None] + model.step, axis=1) + emit[:, t]
            forward[:, t] = np.where(on[:, t, None], moved, forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            ahead = np.logaddexp.reduce(model.step + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(on[:, t + 1, None], ahead, 0.0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        each = np.exp(forward + backward - total[:, None, None]) * on[..., None]
        both = np.exp(
            forward[:, :-1, :, None]
            + model.step
            + (emit + backward)[:, 1:, None, :]
            - total[:, None, None, None]
        )
        scale = 1.0 / on.sum()
        slopes = (
            scale * (true_emit - np.einsum("itl,itf->lf", each, x)) - ridge * model.emit,
            scale * (true_step - np.einsum("itab,it->ab", both, pairs)) - ridge * model.step,
            scale * (one[:, 0] - each[:, 0]).sum(axis=0) - ridge * model.start,
        )
        for p, slope, (mean, square) in zip(params, slopes, moments):
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope**2 - square)
            p += 0.2 * (mean / (1 - 0.9**round_)) / (np.sqrt(square / (1 - 0.99**round_)) + 1e-9)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineModel:
    """A model from documents labelled by ``quality`` in ``labels``, whose lines take the document's label.

    The sample is bounded: the ``SAMPLE_DOCS`` labelled ids that come first by
    hash, and of each ``CHAINS_PER_DOC`` chains of ``CHAIN_LINES`` lines,
    chosen by hash over the whole text. Only feature rows reach the driver. Without labels every line is
    taken as content.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("good")).where(
        "id IS NOT NULL AND good IS NOT NULL"
    )
    chosen = known.groupBy("id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = sample.select("good", _chain_features("text").alias("rows"), "id").toPandas()
    rows = rows.sort_values("id", kind="stable")
    chains, marks = [], []
    for good, flat in zip(rows["good"], rows["rows"]):
        values = np.asarray(flat, dtype=float).reshape(-1, len(FEATURES))
        for start in range(0, len(values), CHAIN_LINES):
            part = values[start : start + CHAIN_LINES]
            chains.append(part)
            marks.append(np.full(len(part), CONTENT if good else BOILERPLATE))
    return fit(chains, marks)


@F.arrow_udf(ArrayType(DoubleType()))
def _chain_features(texts: pa.Array) -> pa.Array:
    return pa.array([_chosen_chains(t.as_py() or "").ravel() for t in texts], pa.list_(pa.float64()))


def _chosen_chains(text: str) -> np.ndarray:
    """Feature rows of the chosen chains in their order; only the last chain of a text may be short."""
    rows, own = measure(text)[1], zlib.crc32(text.encode())
    starts = sorted(range(0, len(rows), CHAIN_LINES), key=lambda start: (zlib.crc32(b"%d" % start, own), start))
    return np.concatenate([rows[:0], *[rows[start : start + CHAIN_LINES] for start in sorted(starts[:CHAINS_PER_DOC])]])


COLUMNS = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(),
    "content_share": pa.float64(),
    "kept": pa.bool_(),
}
_VERDICT = StructType()
for _name, _kind in COLUMNS.items():
    _VERDICT.add(_name, from_arrow_type(_kind))


def judge(text: str | None, model: LineModel) -> dict:
    """All columns of the verdict for one text."""
    counts, features, sizes = measure(text)
    n = counts["n_words"]
    failed = n < MIN_WORDS or 100 * counts["n_repeat_words"] > MAX_REPEATED * n
    share = float(sizes[model.decode(features) == CONTENT].sum() / n) if n else 0.0
    return counts | {"base_failed": failed, "content_share": share, "kept": not failed and share >= MIN_CONTENT}


def verdicts(model: LineModel):
    """A column function from text to the struct of the verdict."""

    @F.arrow_udf(_VERDICT)
    def of(texts: pa.Array) -> pa.Array:
        found = [judge(t.as_py(), model) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([f[c] for f in found], kind) for c, kind in COLUMNS.items()], names=list(COLUMNS)
        )

    return of


def quality_rules(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, base counts, ``base_failed``, ``content_share`` and ``kept``.

    Null, empty and wordless texts have no words and fail. Repeated ids and
    texts are judged row by row; other columns are not touched. No shuffle.
    """
    return docs.select(id_col, verdicts(model)(F.col(text_col)).alias("verdict")).select(id_col, "verdict.*")


def keep_good(docs: DataFrame, model: LineModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the verdict keeps, columns as they came."""
    name = own_name(docs.columns, "verdict")
    return docs.withColumn(name, verdicts(model)(F.col(text_col))).where(F.col(name)["kept"]).drop(name)
