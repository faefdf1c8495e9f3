"""Language identification by multilingual mixture inference.

A text is a mixture of languages: each n-gram is drawn from one of them.
Expectation-maximisation estimates the proportions from the languages' n-gram
likelihoods, and the set of languages grows as long as the likelihood gains
more than a penalty.  The n-gram counts are taken over all training rows.

Cases: a null text, or one without a letter, is ``und`` with score 0 and no
languages; rows without a language are not learned from; without any training
row every text is ``und``; ties between languages go to the first by name;
repeated rows are predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapseries.llm.common import free_name, text_batches, text_rows

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
UNDETERMINED = "und"

# Byte to byte: ASCII letters in lower case, bytes of other characters as they
# are, everything else a space.
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    if _ASCII_LETTER.search(text):
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def grams(text: bytes) -> np.ndarray:
    """Hashed byte 4-grams of a text padded with spaces, without runs of spaces."""
    raw = np.frombuffer(b"  " + text + b"  ", dtype=np.uint8)
    b = _FOLD[raw].astype(np.uint32)
    keep = np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]
    b = b[keep]
    if len(b) < 4:
        b = np.r_[b, np.full(4 - len(b), 32, dtype=np.uint32)]
    word = b[:-3] | (b[1:-2] << 8) | (b[2:-1] << 16) | (b[3:] << 24)
    return ((word * np.uint32(2654435769)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def train(docs: DataFrame, is_training: Column, *, text_col: str = "text", lang_col: str = "lang",
          smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their gram probabilities (BUCKETS x languages).

    Every task sums the grams of its rows by language; the sums are added up
    by Spark.  The driver holds one number for each language and bucket.
    """
    rows = docs.where(is_training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py()
                if has_letter(text):
                    own = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                    own += np.bincount(grams(text), minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])],
                names=["lang", "bucket", "n"])

    table = (rows.mapInArrow(count, "lang string, bucket int, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))).toPandas()
    langs = sorted(table["lang"].unique())
    counts = np.zeros((BUCKETS, len(langs)))
    if langs:
        column = {name: i for i, name in enumerate(langs)}
        counts[table["bucket"].to_numpy(), table["lang"].map(column).to_numpy()] = table["n"].to_numpy()
    return langs, (counts + smoothing) / (counts.sum(axis=0) + smoothing * BUCKETS)


def _em(p: np.ndarray, weight: np.ndarray, start: np.ndarray, steps: int, tol: float):
    """Mixture proportions of the columns of ``p`` and the log-likelihood."""
    pi, n = start, weight.sum()
    for _ in range(steps):
        mix = p @ pi
        new = pi * ((weight / mix) @ p) / n
        moved = np.abs(new - pi).max()
        pi = new
        if moved < tol:
            break
    return pi, float(weight @ np.log(p @ pi))


def infer(text: bytes, probs: np.ndarray, *, penalty: float = 3.0, steps: int = 30, tol: float = 1e-3):
    """(language indexes, proportions) of a text, the largest first.

    Starts from the best single language and adds the one of steepest ascent
    while the log-likelihood gains over ``penalty * log(n + 1)``.  Overlapping
    grams repeat each other's evidence, so counts are divided by the gram's
    length.  The likelihood is concave, so the slope towards a language bounds
    what adding it can gain; slopes below the penalty need no EM.
    """
    bucket, count = np.unique(grams(text), return_counts=True)
    p, weight = probs[bucket], count / 4.0
    n = weight.sum()
    cost = penalty * np.log(n + 1)
    alone = weight @ np.log(p)
    chosen = [int(np.argmax(alone))]
    pi, best = np.ones(1), float(alone[chosen[0]])
    while len(chosen) < p.shape[1]:
        slope = (weight / (p[:, chosen] @ pi)) @ p - n
        slope[chosen] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= cost:
            break
        start = np.r_[pi * 0.8, 0.2]
        more, ll = _em(p[:, [*chosen, j]], weight, start, steps, tol)
        if ll - best <= cost:
            break
        chosen, pi, best = [*chosen, j], more, ll
    order = np.lexsort((chosen, -pi))
    return np.array(chosen)[order], pi[order]


def predict(docs: DataFrame, langs: list[str], probs: np.ndarray, *, text_col: str = "text",
            keep: list[str] | None = None, penalty: float = 3.0) -> DataFrame:
    """Add lang_pred, score (its proportion), languages and proportions; carry ``keep`` (all).

    Added columns get a leading underscore where the input has the name.
    """
    keep = list(docs.columns) if keep is None else list(keep)
    names = [free_name(n, keep) for n in ("lang_pred", "score", "languages", "proportions")]
    rows, at = text_rows(docs, keep, text_col)
    model = docs.sparkSession.sparkContext.broadcast((langs, probs))

    def run(batches):
        names_of, table = model.value
        for batch, texts in text_batches(batches, at):
            top, score, sets, shares = [], [], [], []
            for t in texts:
                text = t.as_py()
                if not names_of or not text or not has_letter(text):
                    which, pi = [], []
                else:
                    which, pi = infer(text, table, penalty=penalty)
                top.append(names_of[which[0]] if len(which) else UNDETERMINED)
                score.append(min(1.0, float(pi[0])) if len(which) else 0.0)
                sets.append([names_of[i] for i in which])
                shares.append([float(x) for x in pi])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(top, pa.string()), pa.array(score, pa.float64()),
                 pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                names=[*keep, *names])

    schema = (docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")
              .add(names[2], T.ArrayType(T.StringType()))
              .add(names[3], T.ArrayType(T.DoubleType())))
    return rows.mapInArrow(run, schema)
