"""References to records that do not exist, were deleted or came later.

A reference is checked against one summary row per parent key.  Children of
orphaned records are orphaned in turn: a fixpoint of semi-joins down the
foreign keys, each round driven only by the records found in the last one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.durable import cut
from millrace.functions.keys import id_key


@dataclass(frozen=True)
class Table:
    """A table of the graph.  deleted: whether a record is deleted for good;
    deleted_at, available_at: times from which it is gone or there; time: when
    a record of this table was written, which its references are held against
    (nulls: never, always, unknown)."""

    df: DataFrame
    deleted: Column | None = None
    deleted_at: Column | None = None
    available_at: Column | None = None
    time: Column | None = None


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    key: str


def _or_null(c: Column | None, kind: str) -> Column:
    return c.cast(kind) if c is not None else F.lit(None).cast(kind)


def check_references(child: DataFrame, ref: Column, time: Column, parent: Table, key: str) -> DataFrame:
    """child with ref_key (the reference as it compares) and reason: absent,
    deleted, late, or null where the reference is null, blank or sound.

    A parent key that occurs in several versions is sound if any version is; of
    the reasons of several versions deleted comes before late.  The parent is
    reduced to its distinct versions per key before the join, so repeated
    parent rows never multiply child rows.  A null time is never late.
    """
    versions = (
        parent.df.select(
            id_key(F.col(key)).alias("__key"),
            F.struct(
                F.coalesce(_or_null(parent.deleted, "boolean"), F.lit(False)).alias("gone"),
                _or_null(parent.deleted_at, "timestamp").alias("gone_at"),
                _or_null(parent.available_at, "timestamp").alias("since"),
            ).alias("v"),
        )
        .filter(F.col("__key").isNotNull())
        .groupBy("__key")
        .agg(F.collect_set("v").alias("__versions"))
    )
    now = time.cast("timestamp")
    gone = lambda v: v["gone"] | F.coalesce(v["gone_at"] <= F.col("__time"), F.lit(False))
    late = lambda v: F.coalesce(v["since"] > F.col("__time"), F.lit(False))
    joined = child.withColumns({"__ref": id_key(ref), "__time": now}).join(versions, F.col("__ref") == F.col("__key"), "left")
    v = F.col("__versions")
    reason = (
        F.when(F.col("__ref").isNull(), None)
        .when(v.isNull(), "absent")
        .when(F.exists(v, lambda x: ~gone(x) & ~late(x)), None)
        .when(F.exists(v, gone), "deleted")
        .otherwise("late")
    )
    return joined.withColumns({"ref_key": F.col("__ref"), "reason": reason}).drop("__ref", "__time", "__key", "__versions")


def find_orphans(tables: Mapping[str, Table], keys: Sequence[ForeignKey], identity: Mapping[str, Sequence[str]], max_rounds: int | None = None) -> DataFrame:
    """All orphaned references: table, record (its identity columns as an
    array), time, ref_field, ref_table, ref_key, reason, kind (direct or
    inherited), depth.

    A reference is direct if its own target is absent, deleted or late, and
    inherited (reason parent) if the target is a record of which some reference
    is orphaned.  One row per distinct record and reference; repeated records
    count once.  Cycles end because a reference is reported once, at its
    smallest depth.  Rounds run over the keys whose parent has references of its
    own; their sound references are computed once.  Null and blank references
    are not references.  Column
    names of the tables cannot clash with those of the result: only the
    identity, key and time columns are carried.
    """
    refs: list[tuple[ForeignKey, DataFrame]] = []
    direct = []
    for fk in keys:
        t = tables[fk.child]
        own = sorted({k.key for k in keys if k.parent == fk.child})
        base = t.df.select(
            F.array(*[id_key(F.col(c)) for c in identity[fk.child]]).alias("record"),
            _or_null(t.time, "timestamp").alias("time"),
            F.col(fk.column).alias("__value"),
            *[id_key(F.col(c)).alias(f"__own_{c}") for c in own],
        ).distinct()
        checked = check_references(base, F.col("__value"), F.col("time"), tables[fk.parent], fk.key).filter(F.col("ref_key").isNotNull())
        shape = checked.select(F.lit(fk.child).alias("table"), "record", "time", F.lit(fk.column).alias("ref_field"), F.lit(fk.parent).alias("ref_table"), "ref_key", "reason", *[f"__own_{c}" for c in own]).distinct()
        refs.append((fk, shape))
        direct.append(_pad(shape.filter(F.col("reason").isNotNull()), keys))
    found = direct[0]
    for d in direct[1:]:
        found = found.unionByName(d)
    found = found.withColumns({"kind": F.lit("direct"), "depth": F.lit(0)})
    out = [n for n in found.columns if not n.startswith("__own_")]
    children = {fk.child for fk in keys}
    sound = [(fk, cut(shape.filter(F.col("reason").isNull()))) for fk, shape in refs if fk.parent in children]
    frontier = found = cut(found) if sound else found
    depth = 0
    while sound and (max_rounds is None or depth < max_rounds):
        depth += 1
        new = None
        for fk, shape in sound:
            bad = frontier.filter((F.col("table") == fk.parent) & F.col(f"__own_{fk.key}").isNotNull()).select(F.col(f"__own_{fk.key}").alias("ref_key")).distinct()
            hit = _pad(shape.join(bad, "ref_key", "left_semi"), keys)
            new = hit if new is None else new.unionByName(hit)
        new = new.withColumns({"reason": F.lit("parent"), "kind": F.lit("inherited"), "depth": F.lit(depth)})
        new = cut(new.join(found.select("table", "record", "ref_field", "ref_key"), ["table", "record", "ref_field", "ref_key"], "left_anti"))
        if new.isEmpty():
            break
        frontier = new
        found = cut(found.unionByName(new))
    return found.select(*out)


def _pad(df: DataFrame, keys: Sequence[ForeignKey]) -> DataFrame:
    want = [f"__own_{c}" for c in sorted({k.key for k in keys})]
    return df.withColumns({c: F.lit(None).cast("string") for c in want if c not in df.columns})


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphaned references per referenced table and month of writing: n_direct,
    n_inherited.  A record without a time stands under a null month."""
    return (
        found.groupBy("ref_table", F.date_format("time", "yyyy-MM").alias("month"))
        .agg(F.sum((F.col("kind") == "direct").cast("long")).alias("n_direct"), F.sum((F.col("kind") == "inherited").cast("long")).alias("n_inherited"))
    )
