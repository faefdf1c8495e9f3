"""Deterministic sampling, balancing and splitting by key hash.

``rand``-based sampling depends on partition layout (the same seed gives other
rows after a repartition), so every choice here ranks keys by an md5-derived
32-bit hash instead.  Exact quotas ("keep the m smallest hashes") are found
without a global sort: one small aggregate counts keys per hash bucket (the
top ``bits`` bits), whole buckets below the cut are kept by a per-row
predicate, and only the one boundary bucket is ranked (AQE broadcasts it when
it is small).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapseries.functions.columns import key_hash, key_unit
from gapseries.operators._util import null_safe_join as _null_safe_join

_H, _B = "_hash", "_bucket"


def keep_smallest_by_hash(df: DataFrame, keys: Sequence[str], quota: int | Mapping,
                          seed: int | str = 0, label: str | None = None,
                          bits: int = 16) -> DataFrame:
    """Rows of the ``quota`` distinct keys with the smallest key hash.

    With ``label``, ``quota`` maps each label value to its own quota (labels
    absent from the mapping keep everything).  Ties on the hash are broken by
    the key columns, ascending.  Exact, deterministic and independent of
    partitioning.  The input is read by the bucket-count job and twice by the
    result (boundary bucket and rows): checkpoint an expensive input first.
    """
    if not 1 <= bits <= 24:
        raise ValueError("bits must be in 1..24")
    grp = [label] if label else []
    key_cols = list(dict.fromkeys(list(keys) + grp))
    hashed = df.withColumn(_H, key_hash(keys, seed)).withColumn(_B, F.shiftright(F.col(_H), 32 - bits))
    series = hashed.select(*key_cols, _H, _B).distinct()
    rows = series.groupBy(*grp, _B).agg(F.count(F.lit(1)).alias("n")).collect()

    per_label: dict = {}
    for r in rows:
        per_label.setdefault(r[label] if label else None, []).append((r[_B], r["n"]))
    quotas = quota if isinstance(quota, Mapping) else {None: quota}

    keep_expr = F.lit(False)
    boundary_parts: list[DataFrame] = []
    labels = set(per_label) | ({k for k in quotas} if label else set())
    for lab in labels:
        buckets = sorted(per_label.get(lab, []))
        total = sum(n for _, n in buckets)
        m = quotas.get(lab, total) if label else quotas[None]
        is_lab = F.col(label).eqNullSafe(F.lit(lab)) if label else F.lit(True)
        if m >= total:
            keep_expr = keep_expr | is_lab
            continue
        if m <= 0:
            continue
        cum = 0
        for b, n in buckets:
            if cum + n >= m:
                cut, rest = b, m - cum
                break
            cum += n
        w = Window.partitionBy(_B).orderBy(F.col(_H), *[F.col(k) for k in keys])
        part = (series.where(is_lab & (F.col(_B) == cut))
                .withColumn("_rank", F.row_number().over(w))
                .where(F.col("_rank") <= rest).select(*key_cols))
        boundary_parts.append(part)
        keep_expr = keep_expr | (is_lab & ((F.col(_B) < cut) | ((F.col(_B) == cut) & F.col("_in"))))

    if boundary_parts:
        boundary = boundary_parts[0]
        for p in boundary_parts[1:]:
            boundary = boundary.unionByName(p)
        boundary = boundary.withColumn("_in", F.lit(True))
        hashed = _null_safe_join(hashed, boundary, key_cols, "left")
        hashed = hashed.withColumn("_in", F.coalesce(F.col("_in"), F.lit(False)))
    else:
        hashed = hashed.withColumn("_in", F.lit(False))
    return hashed.where(keep_expr).drop(_H, _B, "_in")


def class_counts(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Number of distinct series per class: (label, n_series)."""
    return (df.select(*dict.fromkeys(list(keys) + [label])).distinct()
            .groupBy(label).agg(F.count(F.lit(1)).alias("n_series")))


def balance_classes(df: DataFrame, keys: Sequence[str], label: str,
                    classes: Sequence | None = None, method: str = "hash",
                    seed: int | str = 0, bits: int = 16) -> DataFrame:
    """Reduce every class to the size of the smallest, counted in series.

    ``classes`` names the classes that must be present; a missing one counts
    as empty, which empties the result (there is nothing to balance against).
    ``method="hash"`` keeps exactly that many series per class, chosen by key
    hash; ``"bernoulli"`` keeps each series of a larger class with probability
    n_min/n_class (approximate counts, as the original procedure): those whose
    hashed key falls below it, so the choice is the same for any layout.
    """
    counts = {r[label]: r["n_series"] for r in class_counts(df, keys, label).collect()}
    for c in classes or []:
        counts.setdefault(c, 0)
    if not counts:
        return df
    n_min = min(counts.values())
    if method == "hash":
        return keep_smallest_by_hash(df, keys, {c: n_min for c in counts}, seed, label, bits)
    if method == "bernoulli":
        chance = F.lit(0.0)
        for c, n in counts.items():
            chance = F.when(F.col(label).eqNullSafe(F.lit(c)), F.lit(n_min / n if n else 0.0)).otherwise(chance)
        return df.where(key_unit(list(dict.fromkeys(list(keys) + [label])), f"bernoulli:{seed}") < chance)
    raise ValueError("method must be 'hash' or 'bernoulli'")


def split_column(keys: Sequence[str], ratio: float = 0.7, seed: int | str = 74565,
                 names: tuple[str, str] = ("train", "test")):
    """'train' when the key hash falls below ``ratio``, else 'test'."""
    return F.when(key_unit(keys, seed) < F.lit(ratio), F.lit(names[0])).otherwise(F.lit(names[1]))


def split_series(df: DataFrame, keys: Sequence[str], ratio: float = 0.7,
                 seed: int | str = 74565, out: str = "split") -> DataFrame:
    """Train/test split by series key: stable under repartitioning, no sort."""
    return df.withColumn(out, split_column(keys, ratio, seed))


def split_rows(df: DataFrame, keys: Sequence[str], validation_ratio: float = 0.2,
               seed: int | str = 0, out: str = "split") -> DataFrame:
    """Training/validation split: ``validation_ratio`` of keys go to 'validation'."""
    return df.withColumn(out, F.when(key_unit(keys, seed) < F.lit(validation_ratio),
                                     F.lit("validation")).otherwise(F.lit("train")))


def sample_series(df: DataFrame, keys: Sequence[str], n: int, seed: int | str = 0) -> DataFrame:
    """Rows of ``n`` series chosen by key hash (for display)."""
    return keep_smallest_by_hash(df, keys, n, seed)
