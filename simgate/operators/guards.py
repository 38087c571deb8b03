"""Integrity checks that stop a run: typed errors from small aggregates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GuardError(ValueError):
    """A constraint on inputs, splits or artifacts does not hold."""


def require(ok: bool, message: str) -> None:
    if not ok:
        raise GuardError(message)


def equal_version(found: int, wanted: int, what: str) -> None:
    require(found == wanted, f"{what} has format version {found}, this code reads {wanted}")


def one_of(value: str, allowed: Iterable[str], what: str) -> None:
    allowed = tuple(allowed)
    require(value in allowed, f"{what} must be one of {allowed}, not {value!r}")


def fraction(value: float, what: str) -> None:
    require(0.0 <= value <= 1.0, f"{what} must lie between 0 and 1, not {value}")


def counts_fit(total: int, reference: int, calibration: int, test: int) -> None:
    """Asked-for role sizes must be possible; the reference set needs one at least."""
    require(min(reference, calibration, test) >= 0, "role sizes must not be negative")
    require(reference >= 1, "the reference set needs at least one member")
    asked = reference + calibration + test
    require(asked <= total, f"roles ask for {asked} of {total} positives")


def disjoint(roles: DataFrame, key: str = "name") -> None:
    """No name of a group twice in a role, nor in two roles of a dataset."""
    keys = [c for c in ("dataset", "group") if c in roles.columns] + [key]
    bad = roles.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("role").alias("roles")).where("n > 1").orderBy(*keys)
    rows = bad.limit(5).collect()
    require(not rows, "names stand more than once: " + ", ".join("/".join(str(r[c]) for c in keys if r[c] is not None) + f" ({r['roles']} roles)" for r in rows))


def all_present(wanted: DataFrame, have: DataFrame, key: str | list[str], what: str) -> None:
    """Every wanted key (of one column or several, which are never null) must be in ``have``; names the first five that aren't."""
    keys = [key] if isinstance(key, str) else key
    missing = wanted.select(*keys).distinct().join(have.select(*keys).distinct(), keys, "left_anti")
    n = missing.count()
    if n:
        first = ", ".join("/".join(str(x) for x in r if x != "") for r in missing.orderBy(*keys).limit(5).collect())
        raise GuardError(f"{n} names are missing from {what}: {first}")


def same_rows(a: DataFrame, b: DataFrame, what: str) -> None:
    require(a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), f"{what} differ")


def not_empty(df: DataFrame, what: str) -> None:
    require(not df.isEmpty(), f"{what} is empty")


def same_variant(a: dict, b: dict, what: str) -> None:
    """Model and detector settings must be equal; settings of a detector that is off do not count."""
    key = lambda v: (v["model_id"], v["detect"], v.get("margin") if v["detect"] else None, v.get("min_confidence") if v["detect"] else None)
    require(key(a) == key(b), f"{what} were made with different settings: {key(a)} and {key(b)}")


def unique(df: DataFrame, key: str, what: str) -> None:
    rows = df.groupBy(key).count().where("count > 1").limit(5).collect()
    require(not rows, f"{what}: {key} repeats: " + ", ".join(str(r[key]) for r in rows))


def exclusive(options: dict[str, object], with_: str) -> None:
    """Options that must not be given together with another; 0 counts as given."""
    given = [k for k, v in options.items() if v is not None and v is not False]
    require(not given, f"{with_} cannot be combined with {', '.join(given)}")
