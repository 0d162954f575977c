"""Row predicates and ordered rule chains (3.x, 12.17-12.22)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields that a query identifier may name.
IDENTIFIER_FIELDS = ("equipment_model", "alarm_code", "sop_code", "part_number", "product_name", "document_type")
#: Thresholds of alias scores and of sufficient evidence.
CONFIRMED, CANDIDATE, SUFFICIENT = 0.75, 0.60, 0.75


def structured(identifiers: dict[str, list], fields=IDENTIFIER_FIELDS, rename: dict[str, str] | None = None) -> Column:
    """IN within a field, AND across fields (3.4); an unknown field is an error, no field holds for all rows."""
    unknown = set(identifiers) - set(fields)
    if unknown:
        raise ValueError(f"unknown identifier fields: {sorted(unknown)}")
    parts = [F.col((rename or {}).get(k, k)).isin(list(v)) for k, v in identifiers.items() if v]
    return F.coalesce(reduce(Column.__and__, parts, F.lit(True)), F.lit(False))


def managed(*, document=None, version=None, enabled: bool | None = None, index_min: int | None = None, index_max: int | None = None, names: dict[str, str]) -> Column:
    """Optional equality on document and version, tri-state enabled, half-open index range (3.3, 7.9)."""
    parts = [F.col(names[k]) == v for k, v in (("document", document), ("version", version), ("enabled", enabled)) if v is not None]
    parts += [F.col(names["index"]) >= index_min] if index_min is not None else []
    parts += [F.col(names["index"]) < index_max] if index_max is not None else []
    return reduce(Column.__and__, parts, F.lit(True))


def can_read(visibility: Column, owner: Column, role: Column, user) -> Column:
    """Owner, public, or shared with a role (3.10)."""
    return F.coalesce((owner == user) | (visibility == "public") | ((visibility == "shared") & role.isNotNull()), F.lit(False))


def can_write(owner: Column, role: Column, user) -> Column:
    return F.coalesce((owner == user) | role.isin("editor", "admin"), F.lit(False))


def score_band(score: Column) -> Column:
    """confirmed, candidate or none (3.12)."""
    return F.when(score > CONFIRMED, "confirmed").when(score > CANDIDATE, "candidate").otherwise("none")


def sufficient(success: Column, candidates: Column, reranked: Column, top: Column, answerable: Column) -> Column:
    """Whether an observation can be answered from (3.14)."""
    return F.coalesce(success & (candidates > 0) & (reranked > 0) & (top >= SUFFICIENT) & answerable, F.lit(False))


def completed(status: Column, index_status: Column, deleted_at: Column) -> Column:
    """Completed, indexed and not deleted (3.15)."""
    return (status == "completed") & (index_status == "completed") & (F.coalesce(deleted_at, F.lit("")) == "")


def codes(rules: list[tuple[Column, str]]) -> Column:
    """The codes of all rules that hold, in order (3.18, 3.25, 12.17)."""
    return F.array_compact(F.array(*(F.when(rule, F.lit(code)) for rule, code in rules)))


def first_code(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The code of the first rule that holds (3.22, 12.20, 12.21)."""
    out = F.lit(otherwise)
    for rule, code in reversed(rules):
        out = F.when(rule, F.lit(code)).otherwise(out)
    return out


def contaminated(text: Column, banned: list[str]) -> Column:
    """The banned tokens that a text holds, case aside (3.20)."""
    return F.filter(F.array(*(F.lit(t.lower()) for t in banned)), lambda t: F.contains(F.lower(text), t))


def json_keys(payload: Column, banned: list[str]) -> Column:
    """Banned keys at any depth of a JSON text, sorted and distinct (3.21)."""
    return F.array_sort(F.array_intersect(F.regexp_extract_all(payload, F.lit(r'"([^"\\]+)"\s*:'), F.lit(1)), F.array(*map(F.lit, banned))))


def branch_words(text: Column, signals: list[str], markers: list[str]) -> Column:
    """Two or more distinct signal words, one of them a branch marker (3.19)."""
    lowered = F.lower(text)
    return (F.size(F.filter(F.array(*map(F.lit, signals)), lambda w: F.contains(lowered, w))) >= 2) & F.exists(F.array(*map(F.lit, markers)), lambda w: F.contains(lowered, w))
