"""Upserts, conditional updates and deletes as DataFrames: the new state is a query over the old one and the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.operators.relational import latest_per


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``old`` with those of ``new`` over them by key; nulls in ``new`` leave the old value.

    If ``new`` may repeat a key, ``order`` names the column whose largest value wins. A key in neither order nor
    repeated stays one row; both sides are exchanged once by key.
    """
    if order:
        new = latest_per(new, keys, F.desc(order))
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, *(F.col(c).alias(f"__o_{c}") for c in values))
    n = new.select(*keys, *(F.col(c).alias(f"__n_{c}") for c in values if c in new.columns))
    out = o.join(n, keys, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"__n_{c}"), F.col(f"__o_{c}")) if c in new.columns else F.col(f"__o_{c}")
    return out.select(*keys, *(pick(c).alias(c) for c in values)).select(*old.columns)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks (get or create)."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Columns take new values where the condition holds; null counts as not."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


# Which status of a patch may follow which.
PATCH_MOVES = {
    "approve": (("proposed", "validated", "validation_failed"), "approved"),
    "reject": (("proposed", "validated", "validation_failed", "approved"), "rejected"),
    "apply": (("approved",), "applied"),
}


def move(status: Column, action: Column, moves: dict[str, tuple[tuple[str, ...], str]]) -> Column:
    """The status after an action; an action that its status does not allow changes nothing."""
    out = None
    for name, (allowed, to) in moves.items():
        hit = (action == name) & status.isin(*allowed)
        out = F.when(hit, to) if out is None else out.when(hit, to)
    return out.otherwise(status)


def cascade_delete(root: DataFrame, gone: DataFrame, key: str, *levels: tuple[str, DataFrame, str, str]) -> dict[str, DataFrame]:
    """What is left of each table when rows of ``root`` go: levels are (name, table, foreign key, own key), top down."""
    left = {"root": root.join(gone.select(key), key, "left_anti")}
    dead = gone.select(F.col(key).alias("__k"))
    for name, table, foreign, own in levels:
        left[name] = table.join(dead, table[foreign] == dead["__k"], "left_anti")
        dead = table.join(dead, table[foreign] == dead["__k"], "left_semi").select(F.col(own).alias("__k")).distinct()
    return left


def older_than(df: DataFrame, ts: str, now: Column, minutes: int) -> DataFrame:
    """Retention: the rows to delete."""
    return df.where(F.col(ts) < now - F.make_dt_interval(mins=F.lit(minutes)))


def pull_request_status(merged: Column, state: Column, draft: Column) -> Column:
    """merged before closed before draft before open."""
    return F.when(merged, "merged").when(state == "closed", "closed").when(draft, "draft").otherwise("open")


def add_missing_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Additive schema change: absent columns appear as nulls, present ones stay."""
    return df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})


def append(rows: DataFrame, path: str, **values: Column) -> None:
    """Appends rows to a Parquet table, with computed columns such as an id or a time; a failed write leaves no rows."""
    rows.withColumns(values).write.mode("append").parquet(path)
