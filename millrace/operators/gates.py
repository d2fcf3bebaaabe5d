"""Gates: checks of configurations, lineage, joins and shares that stop a run, each before or after an expensive step."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A gate that doesn't hold."""


def shares(config: Mapping[str, float], names: Iterable[str] | None = None, what: str = "shares") -> None:
    """Shares are of the names expected, none negative, and sum to one."""
    if names is not None and set(config) != set(names):
        raise GateError(f"{what} must be of {sorted(names)}, not {sorted(config)}")
    if any(v < 0 for v in config.values()) or abs(sum(config.values()) - 1) > 1e-9:
        raise GateError(f"{what} must sum to 1, not {sum(config.values())}")


def lineage(report: Mapping, output: str, checked_at_least: int) -> None:
    """An input's report names that input, and its guard knew at least so many tasks."""
    if report.get("output") != output:
        raise GateError(f"the report is of {report.get('output')}, not of {output}")
    if report.get("tasks", 0) < checked_at_least:
        raise GateError(f"the guard knew {report.get('tasks', 0)} tasks of {checked_at_least}")


def disjoint(a: DataFrame, b: DataFrame, on: str) -> None:
    """No value of a column stands on both sides."""
    both = a.select(on).intersect(b.select(on)).limit(5).collect()
    if both:
        raise GateError(f"{on} on both sides: {', '.join(str(r[0]) for r in both)}")


def required_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """An inner join in which each left row must have a partner."""
    missing = left.join(right, on, "left_anti").select(on).limit(5).collect()
    if missing:
        raise GateError(f"no partner for {', '.join(str(r[0]) for r in missing)}")
    return left.join(right, on)


def drop_share(total: int, removed: int, most: float) -> float:
    """The share removed, which must not exceed the most allowed."""
    share = removed / total if total else 0.0
    if share > most:
        raise GateError(f"{removed} of {total} rows would go, over {most:.0%}")
    return share


def canary(step: Callable[[DataFrame], DataFrame], row: DataFrame, expected: list[tuple]) -> None:
    """A step on rows whose result is known, before it runs over all of them."""
    got = sorted(tuple(r) for r in step(row).collect())
    if got != sorted(expected):
        raise GateError(f"the canary came back as {got}")


def signature(config: Mapping) -> str:
    """A digest of the arguments of a run: a resumed run must have the same."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def same_run(state: Mapping, config: Mapping) -> None:
    """Recovery state is only taken up by a run with the same arguments."""
    if state.get("signature") != signature(config):
        raise GateError("the saved state is of a run with other arguments")


def missing_fields(df: DataFrame, *names: str) -> DataFrame:
    """df with `reason`: invalid_record where a required field is null."""
    bad = F.lit(False)
    for n in names:
        bad = bad | F.col(n).isNull()
    return df.withColumn("reason", F.when(bad, "invalid_record"))
