"""Records that differ only in layout, collapsed into one each.

A record is a tree: a root over an unordered node of text lines and an
unordered node of child rows.  Leaves are normalised and hashed, unordered
nodes hash the sorted distinct digests of their children, and records are
grouped by root digest.  Groups are then confirmed on the normalised
structures themselves, so a collision of digests never joins two records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.durable import cut

#: The line separators of text, and what layout may change beside
#: letter case: white space, controls and zero-width marks, punctuation.
BREAKS = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
LAYOUT = r"[\p{P}\p{Z}\p{Cc}\u200b\u2060\ufeff]+"
LAYOUT_IN_LINE = r"[\p{P}\p{Z}\p{Cc}\u200b\u2060\ufeff&&[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]]+"

#: A record with more distinct children than this is hashed and compared in
#: SLOTS parts by child digest, so no task holds all of its children.
WIDE = 100_000
SLOTS = 1024


def fold(text: Column) -> Column:
    """Text without letter case; upper before lower unites spellings such as
    sharp s and ss.  The replacement between them (of the capital sharp s) also
    keeps the optimizer from dropping the inner one."""
    return F.lower(F.replace(F.upper(text), F.lit("\u1e9e"), F.lit("SS")))


def flat(text: Column) -> Column:
    """Text without layout: no white space, punctuation or letter case."""
    return fold(F.regexp_replace(text, LAYOUT, ""))


def flat_lines(text: Column) -> Column:
    """The sorted distinct normalised lines of a text that aren't empty; a null
    text has none."""
    lines = F.split(fold(F.regexp_replace(F.coalesce(text, F.lit("")), LAYOUT_IN_LINE, "")), BREAKS)
    return F.array_sort(F.array_distinct(F.filter(lines, lambda x: x != "")))


def _digest(*values: Column) -> Column:
    """128 bits as a struct of two longs."""
    return F.struct(F.xxhash64(F.lit(0), *values).alias("x"), F.xxhash64(F.lit(1), *values).alias("y"))


def _node(children: Column) -> Column:
    return _digest(F.array_sort(children))


def _child_nodes(leaves: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, node) from (id, leaf); rows: (id) of the same records, which tells
    the wide ones before anything is gathered."""
    many = cut(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WIDE).select("id"))
    if many.isEmpty():
        return leaves.groupBy("id").agg(F.collect_set("leaf").alias("c")).select("id", _node(F.col("c")).alias("node"), F.lit(False).alias("wide"))
    few = leaves.join(many, "id", "left_anti")
    lots = cut(leaves.join(many, "id", "left_semi").distinct())  # keyed by child too, hence without skew
    wide = lots.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WIDE).select("id")
    few = few.unionByName(lots.join(wide, "id", "left_anti"))
    narrow = few.groupBy("id").agg(F.collect_set("leaf").alias("c")).select("id", _node(F.col("c")).alias("node"), F.lit(False).alias("wide"))
    parts = lots.join(wide, "id", "left_semi").groupBy("id", F.pmod(F.col("leaf.x"), F.lit(SLOTS)).alias("slot")).agg(F.collect_set("leaf").alias("c"))
    parts = parts.groupBy("id").agg(F.collect_list(F.struct("slot", _node(F.col("c")).alias("d"))).alias("c"))
    return narrow.unionByName(parts.select("id", _node(F.col("c")).alias("node"), F.lit(True).alias("wide")))


def collapse_layout(records: DataFrame, id_column: str, text: str, children: DataFrame, child_id: str, child_kind: str, child_text: str) -> DataFrame:
    """(id, representative, n_copies) of every record.

    Records are copies if they agree in the set of normalised lines of text and
    in the set of (kind, normalised text) of their children; layout is white
    space, punctuation of any script, letter case, empty and repeated lines and
    the order of lines and children.  The representative is the smallest id of
    its copies.  A null text is an empty one, a record without children has the
    empty set, and records without any content are copies of each other.
    Children of unknown records and null ids are left out, repeated rows count
    once, and child kinds compare without case and surrounding space.  Extra
    columns are ignored.
    """
    base = records.select(F.col(id_column).cast("string").alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull())
    kids = children.select(F.col(child_id).cast("string").alias("id"), F.coalesce(F.lower(F.trim(child_kind)), F.lit("")).alias("kind"), flat(F.col(child_text)).alias("line"))
    kids = kids.filter(F.col("id").isNotNull() & (F.col("line") != ""))
    leaves = kids.select("id", _digest(F.col("kind"), F.col("line")).alias("leaf"))
    nodes = _child_nodes(leaves, children.select(F.col(child_id).cast("string").alias("id")).filter(F.col("id").isNotNull()))
    own = base.select("id", _node(F.transform(flat_lines(F.col("text")), lambda s: _digest(s))).alias("lines"))
    own = own.groupBy("id").agg(F.min("lines").alias("lines"))
    empty = _node(F.array().cast("array<struct<x:bigint,y:bigint>>"))
    rooted = cut(own.join(nodes, "id", "left").select("id", _digest(F.col("lines"), F.coalesce("node", empty)).alias("root"), F.coalesce("wide", F.lit(False)).alias("wide")))

    groups = rooted.groupBy("root").agg(F.min("id").alias("representative"), F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1")
    members = cut(rooted.join(groups, "root").select("id", "root", "wide", "representative", "n_copies"))
    parts = _structures(members, base, kids)
    per = parts.groupBy("root", "slot").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("n"), F.max("n_copies").alias("all"))
    broken = cut(per.filter((F.col("lo") != F.col("hi")) | (F.col("n") != F.col("all"))).select("root").distinct())
    if not broken.isEmpty():
        members = _regroup(members, broken, parts)
    return rooted.select("id").join(members.select("id", "representative", "n_copies"), "id", "left").select(
        F.col("id").alias(id_column), F.coalesce("representative", "id").alias("representative"), F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies")
    )


def _structures(members: DataFrame, base: DataFrame, kids: DataFrame) -> DataFrame:
    """Normalised content of the records of groups: (root, id, n_copies, slot,
    part).  Slot -1 holds the text lines; the children stand in slot 0, or by
    digest in slots from 1 for wide records."""
    key = members.select("id", "root", "wide", "n_copies")
    lines = base.join(key, "id").select("root", "id", "n_copies", F.lit(-1).cast("bigint").alias("slot"), F.transform(flat_lines(F.col("text")), lambda s: F.struct(F.lit("").alias("kind"), s.alias("line"))).alias("part"))
    lines = lines.groupBy("root", "id", "n_copies", "slot").agg(F.min("part").alias("part"))
    slot = F.when(F.col("wide"), F.pmod(_digest(F.col("kind"), F.col("line"))["x"], F.lit(SLOTS)) + 1).otherwise(0).cast("bigint")
    rows = kids.join(key, "id").groupBy("root", "id", "n_copies", slot.alias("slot")).agg(F.array_sort(F.collect_set(F.struct("kind", "line"))).alias("part"))
    return lines.unionByName(rows)


def _regroup(members: DataFrame, broken: DataFrame, parts: DataFrame) -> DataFrame:
    """Groups whose digests collided, grouped anew by a digest of another kind
    over their structures (SHA-256 of each part)."""
    bad = members.join(broken, "root", "left_semi")
    shape = F.sha2(F.to_json(F.struct("part")), 256)
    full = parts.join(broken, "root", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("slot", shape.alias("h")))).alias("full"))
    again = bad.drop("representative", "n_copies").join(full, "id")
    groups = again.groupBy("root", "full").agg(F.min("id").alias("representative"), F.count(F.lit(1)).alias("n_copies"))
    fixed = again.join(groups, ["root", "full"]).select("id", "root", "wide", "representative", "n_copies")
    return members.join(broken, "root", "left_anti").unionByName(fixed)
