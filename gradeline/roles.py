"""Column roles: operators take these names as parameters instead of fixed field names."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    country: str = "country"
    respondent: str = "respondent_id"
    school: str = "school_id"
    booklet: str = "booklet_id"
    sex: str = "sex"
    item: str = "item_id"
    answer: str = "answer"
    key: str = "key"
    scores: tuple[str, ...] = ("pv1", "pv2", "pv3", "pv4", "pv5")
    female: int = 1
    male: int = 2


DEFAULT_ROLES = Roles()
