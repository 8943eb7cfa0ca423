"""Row predicates on scopes and on the two time axes. Intervals are half-open, null bounds are open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import SCOPE


def scope_read(scope: dict[str, str | None]) -> Column:
    """A read sees its space and every narrower scope: equality on the ids that are set."""
    given = [F.col(k) == v for k, v in scope.items() if v is not None and k in SCOPE]
    return reduce(lambda a, b: a & b, given, F.lit(True))


def scope_exact(scope: dict[str, str | None]) -> Column:
    """A write touches its exact scope: null-safe equality on all six ids."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(scope.get(k))) for k in SCOPE])


def same_scope(left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in SCOPE])


def valid_at(at: int | Column | None, start: Column | str = "valid_from_ms", end: Column | str = "valid_to_ms") -> Column:
    """No time given is no filter."""
    if at is None:
        return F.lit(True)
    a, b = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    at = F.lit(at) if isinstance(at, int) else at
    return (a.isNull() | (a <= at)) & (b.isNull() | (at < b))


def recorded_at(tt: int | Column | None) -> Column:
    """Visible at a transaction time; none given is what nothing has superseded."""
    if tt is None:
        return F.col("superseded_at_ms").isNull()
    tt = F.lit(tt) if isinstance(tt, int) else tt
    return (F.col("recorded_at_ms") <= tt) & (F.col("superseded_at_ms").isNull() | (tt < F.col("superseded_at_ms")))


def effective_start() -> Column:
    return F.coalesce("valid_from_ms", "observed_at_ms")


def state_visible(valid: int | None = None, tt: int | None = None) -> Column:
    """Without a valid time a state must be open-ended (claims and traces have no such rule)."""
    if valid is None:
        return recorded_at(tt) & F.col("valid_to_ms").isNull()
    return recorded_at(tt) & valid_at(valid, effective_start(), "valid_to_ms")


def trace_visible(valid: int | None = None, tt: int | None = None) -> Column:
    return recorded_at(tt) & valid_at(valid, effective_start(), "valid_to_ms")


def history_visible(valid: int | None = None, tt: int | None = None) -> Column:
    """Versions begun by then, ended ones included."""
    return recorded_at(tt) & (F.lit(True) if valid is None else effective_start() <= valid)


def span_active(at: int | None = None) -> Column:
    return (F.col("status") == "active") & valid_at(at)


def rule_in_force(at: int | None) -> Column:
    return valid_at(at)


def rule_bound(at: int | None) -> Column:
    return rule_in_force(at) & (F.col("trigger_binding_status") == "bound") & (F.col("target_binding_status") == "bound")


def correction_active(at: int | None = None) -> Column:
    out = F.col("status") == "active"
    return out if at is None else out & (F.col("effective_at_ms") <= at)


def settled(df: DataFrame) -> DataFrame:
    """df computed once, for plans that read it often: checkpointed where the session has a folder for that."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()
