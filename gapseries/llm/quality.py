"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features are cut into bins by quantiles of the training rows; every tree grows
leaf by leaf from histograms of gradients; the trees are flattened into arrays
that numpy traverses for a whole batch at once.

The model is fitted on at most ``sample_rows`` labelled documents, those with
the smallest hash of their id (a documented bound); every document is scored.

Cases: null, empty and very long texts have statistics like any other; a
document labelled several times counts by the mean of its labels, one labelled
null does not; without labels, or with labels of one class, the score is the
base rate (0.5 without any); repeated rows score alike; an empty table gives no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapseries.llm.common import free_name, id_hash, share, shared, text_batches, text_rows

# ----------------------------------------------------------------- features ---
# Byte classes counted for every text.
CLASSES = ("other", "lower", "upper", "digit", "space", "newline", "comma", "stop", "exclaim",
           "pipe", "symbol", "quote", "bracket", "dash", "lead", "tail")
_CLASS = np.zeros(256, dtype=np.uint8)
for _name, _bytes in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)),
                      ("space", b" \t\r\v\f"), ("newline", b"\n"), ("comma", b",;:"), ("stop", b"."),
                      ("exclaim", b"!?"), ("pipe", b"|"), ("symbol", b"#$%&*+=<>@^~\\/`_"),
                      ("quote", b"'\""), ("bracket", b"()[]{}"), ("dash", b"-"),
                      ("lead", range(192, 256)), ("tail", range(128, 192))):
    _CLASS[list(_bytes)] = CLASSES.index(_name)
FEATURES = (*[f"{c}_share" for c in CLASSES], "log_bytes", "log_words", "word_length", "word_length_sd",
            "longest_word", "distinct_words", "top_word", "capitalised", "all_capitals", "log_lines",
            "line_length", "line_length_sd", "repeated_lines", "short_words")


def statistics(text: bytes | None) -> np.ndarray:
    """The statistics of one text, over all of it."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    n = len(text)
    raw = np.frombuffer(text, dtype=np.uint8)
    out[:16] = np.bincount(_CLASS[raw], minlength=16) / n
    words = text.split()
    lines = text.split(b"\n")
    out[16], out[17], out[25] = np.log1p(n), np.log1p(len(words)), np.log1p(len(lines))
    size = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    out[26], out[27] = size.mean(), size.std()
    out[28] = 1 - len(set(lines)) / len(lines)
    if words:
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out[18], out[19], out[20] = size.mean(), size.std(), size.max()
        seen: dict[bytes, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        out[21], out[22] = len(seen) / len(words), max(seen.values()) / len(words)
        out[23] = sum(map(bytes.istitle, words)) / len(words)
        out[24] = sum(map(bytes.isupper, words)) / len(words)
        out[29] = (size <= 2).mean()
    return out


def with_statistics(docs: DataFrame, text_col: str, keep: list[str], name: str = "features") -> DataFrame:
    rows, at = text_rows(docs, keep, text_col)

    def run(batches):
        for batch, texts in text_batches(batches, at):
            stats = [statistics(t.as_py()) for t in texts]
            flat = pa.array(np.concatenate(stats) if stats else np.empty(0))
            offsets = pa.array(np.arange(len(stats) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.ListArray.from_arrays(offsets, flat)],
                                             names=[*keep, name])

    return rows.mapInArrow(run, docs.select(*keep).schema.add(name, T.ArrayType(T.DoubleType())))


# -------------------------------------------------------------------- model ---
@dataclass
class Forest:
    """Trees flattened into arrays: node i of any tree tests feature[i] <= threshold[i]."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of features; all trees and rows step down together."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), _sigmoid(self.base))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[row, self.feature[at]] <= self.threshold[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        return _sigmoid(self.base + self.value[at].sum(axis=1))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, leaves: int = 12, rate: float = 0.1,
        bins: int = 64, least_rows: int = 10, l2: float = 1.0, max_depth: int = 6) -> Forest:
    """Boost trees on the logistic loss; ``y`` is 0 or 1 (or a mean of labels)."""
    empty = np.empty(0, dtype=np.int64)
    rate_1 = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(rate_1 / (1 - rate_1)))
    nodes = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def node(value: float) -> int:
        at = len(nodes["value"])  # a leaf leads to itself
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", at), ("right", at), ("value", value)):
            nodes[k].append(v)
        return at

    if len(y) >= 2 * least_rows and 0 < y.mean() < 1:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        offset = np.arange(x.shape[1]) * bins
        raw = np.full(len(y), base)

        def best_split(rows, g, h):
            """(gain, feature, bin) of a leaf from its histograms."""
            place = (binned[rows] + offset).ravel()
            size = x.shape[1] * bins
            hist = [np.bincount(place, np.repeat(v, x.shape[1]), size).reshape(-1, bins).cumsum(axis=1)
                    for v in (g[rows], h[rows], np.ones(len(rows)))]
            total = [v[:, -1:] for v in hist]
            gl, hl, nl = hist
            gr, hr, nr = (t - v for t, v in zip(total, hist))
            gain = gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - total[0] ** 2 / (total[1] + l2)
            gain[(nl < least_rows) | (nr < least_rows)] = -np.inf
            f, b = divmod(int(np.argmax(gain)), bins)
            return float(gain[f, b]), f, b

        for _ in range(trees):
            p = _sigmoid(raw)
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            root = node(0.0)
            roots.append(root)
            open_leaves = [(*best_split(np.arange(len(y)), g, h), 0, root, np.arange(len(y)))]
            closed = []
            while open_leaves:
                open_leaves.sort(key=lambda s: s[0])
                gain, f, b, depth, at, rows = open_leaves.pop()
                if gain <= 1e-6 or depth >= max_depth or len(open_leaves) + len(closed) + 2 > leaves:
                    closed.append((at, rows))
                    continue
                goes_left = binned[rows, f] <= b
                nodes["feature"][at], nodes["threshold"][at] = f, cuts[f][b]
                for side, part in (("left", rows[goes_left]), ("right", rows[~goes_left])):
                    nodes[side][at] = child = node(0.0)
                    open_leaves.append((*best_split(part, g, h), depth + 1, child, part))
            for at, rows in closed:
                nodes["value"][at] = float(-rate * g[rows].sum() / (h[rows].sum() + l2))
                raw[rows] += nodes["value"][at]
    arrays = {k: np.array(v) for k, v in nodes.items()}
    return Forest(base, np.array(roots, dtype=np.int64) if roots else empty, arrays["feature"].astype(np.int64),
                  arrays["threshold"].astype(float), arrays["left"].astype(np.int64),
                  arrays["right"].astype(np.int64), arrays["value"].astype(float), max_depth)


# --------------------------------------------------------------------- jobs ---
def train(docs: DataFrame, labels: DataFrame, is_training: Column, *, label_col: str = "quality",
          id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000, seed: int = 42) -> Forest:
    """Fit on at most ``sample_rows`` labelled ids for which ``is_training`` (a column of labels) holds."""
    known = (labels.where(is_training & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("_key")).agg(F.avg(F.col(label_col).cast("double")).alias("_label"))
             .orderBy(id_hash(seed, F.col("_key")), "_key").limit(sample_rows))
    # At most sample_rows rows of two numbers: bounded by the parameter.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        F.broadcast(known), F.col("_id") == F.col("_key"))
    got = with_statistics(rows, "_text", ["_id", "_label"]).groupBy("_id").agg(
        F.first("_label").alias("_label"), F.min("features").alias("features")).orderBy("_id").collect()
    x = np.array([r.features for r in got]).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r._label for r in got], dtype=float))


def score(docs: DataFrame, forest: Forest, *, text_col: str = "text", threshold: float = 0.3,
          keep: list[str] | None = None) -> DataFrame:
    """Add score and predicted (1 if score >= threshold); carry ``keep`` (default: all columns).

    Added columns get a leading underscore where the input has the name.
    """
    keep = list(docs.columns) if keep is None else list(keep)
    names = [free_name(n, keep) for n in ("score", "predicted")]
    rows, at = text_rows(docs, keep, text_col)
    held = share(docs.sparkSession, forest)

    def run(batches):
        model = shared(held)
        for batch, texts in text_batches(batches, at):
            stats = [statistics(t.as_py()) for t in texts]
            p = model.score(np.array(stats).reshape(len(stats), len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                names=[*keep, *names])

    return rows.mapInArrow(run, docs.select(*keep).schema.add(names[0], "double").add(names[1], "integer"))
