"""Column roles: every operator takes column names, none are hard-coded."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Roles:
    """Names of the columns that play each role in an event table.

    ``subject``, ``unit`` and ``tie`` are optional.  ``tie`` orders points that
    share an instant so results never depend on arrival order.
    """

    entity: str = "HADM_ID"
    item: str = "ITEMID"
    time: str = "CHARTTIME"
    value: str = "VALUENUM"
    subject: str | None = "SUBJECT_ID"
    unit: str | None = "VALUEUOM"
    tie: str | None = "ROW_ID"
    category: str = "ICD9_CATEGORY"

    def with_(self, **kw) -> "Roles":
        return replace(self, **kw)

    @property
    def series_key(self) -> list[str]:
        """Key of one series: entity, item, subject, unit, class label."""
        return [c for c in (self.entity, self.item, self.subject, self.unit, self.category) if c]

    @property
    def split_key(self) -> list[str]:
        """Key the train/test split hashes (entity, item, unit)."""
        return [c for c in (self.entity, self.item, self.unit) if c]
