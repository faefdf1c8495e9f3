"""Column expressions: scalar helpers and hashing."""

from gapseries.functions.columns import (  # noqa: F401
    binary_label, code_category, epoch_days, indicator, key_hash, key_unit,
    uncertainty_band,
)
