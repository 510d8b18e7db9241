"""Missing values filled from records of the same group and time.

Numbers: a mixed model, value = mean + sum of crossed random effects (group,
period, ...), each effect shrunk by residual variance over effect variance.
It is fitted on sufficient statistics per combination of levels, so the data
is aggregated once whatever the number of fields and rounds.
Categories: a multinomial model, log-linear in the same effects, fitted on the
counts per combination of levels with effects shrunk towards zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.durable import cut
from millrace.functions.keys import fresh


def _same(x: Column) -> Column:
    return x


@dataclass(frozen=True)
class NumericField:
    """A column to fill.

    low, high: limits of possible values as columns (a null limit does not
    bind); slack: tolerance above high.  forward takes a value to the scale of
    the model and may give null where it has none, backward takes a prediction
    back.  default: the fill where the table has no valid value at all.
    """

    name: str
    low: Column
    high: Column
    slack: float = 0.0
    forward: Callable[[Column], Column] = _same
    backward: Callable[[Column], Column] = _same
    default: float = 0.0


def is_missing(field: NumericField) -> Column:
    """Null, not a number, infinite, or outside the limits of the field."""
    x = F.col(field.name).cast("double")
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf"))) | (x < field.low) | (x > field.high + F.lit(field.slack))
    return x.isNull() | F.coalesce(bad, F.lit(False))


def _variances(cells: DataFrame, n: str, s: str, q: str, factors: Sequence[str]) -> tuple[float | None, list[float]]:
    """Mean, and per factor the shrinkage (residual over effect variance;
    infinite where the factor explains nothing), by moments."""
    t = cells.agg(
        F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(q).alias("q"),
        F.sum(F.when(F.col(n) > 0, F.col(q) - F.col(s) * F.col(s) / F.col(n))).alias("within"),
        F.sum((F.col(n) > 0).cast("long")).alias("k"),
    ).first()
    if not t["n"]:
        return None, [float("inf")] * len(factors)
    mean = t["s"] / t["n"]
    total = max(t["q"] - t["s"] * mean, 0.0)
    free = t["n"] - t["k"]
    noise = max(t["within"] / free, 0.0) if free > 0 else total / t["n"]
    shrink = []
    for f in factors:
        per = cells.groupBy(f).agg(F.sum(n).alias("m"), F.sum(s).alias("t")).filter(F.col("m") > 0)
        g = per.agg(F.sum(F.col("m") * (F.col("t") / F.col("m") - F.lit(mean)) ** 2).alias("b"), F.sum(F.col("m").cast("double") ** 2).alias("mm"), F.count(F.lit(1)).alias("g")).first()
        spread = t["n"] - g["mm"] / t["n"]
        effect = (g["b"] - (g["g"] - 1) * noise) / spread if spread > 0 else 0.0
        shrink.append(noise / effect if effect > 1e-12 else float("inf"))
    return mean, shrink


def fill_numeric(df: DataFrame, fields: Sequence[NumericField], factors: Sequence[str], rounds: int = 3, suffix: str = "_filled") -> DataFrame:
    """df with every missing value of the fields predicted, and per field a
    boolean column <name><suffix> that is true where the value was filled.

    Present values stay as they are.  Factor levels may be null: null is a
    level of its own.  A level without any valid value has effect zero, so a
    group that lacks the field wholly is filled from its period and the mean.
    Predictions are clipped to the limits of the field; a missing limit does
    not clip.  A table without a valid value is filled with the field's
    default.  Columns named like a mark keep their name; the mark then gets a
    number appended.  Repeated rows are filled alike.  An empty table stays
    empty.
    """
    factors = list(factors)
    names = df.columns
    keys: list[str] = []
    work = df
    for f in factors:
        keys.append(fresh(names + keys, f"__level_{f}"))
        work = work.withColumn(keys[-1], F.coalesce(F.col(f).cast("string"), F.lit("\u0000")))
    stats, valid = [], []
    for i, field in enumerate(fields):
        y = F.when(~is_missing(field), field.forward(F.col(field.name).cast("double")))
        y = F.when(~F.isnan(y) & (F.abs(y) != F.lit(float("inf"))), y)
        valid.append(y)
        stats += [F.count(y).alias(f"n{i}"), F.coalesce(F.sum(y), F.lit(0.0)).alias(f"s{i}"), F.coalesce(F.sum(y * y), F.lit(0.0)).alias(f"q{i}")]
    cells = cut(work.groupBy(*keys).agg(*stats))
    fits = [_variances(cells, f"n{i}", f"s{i}", f"q{i}", keys) for i in range(len(fields))]

    effects: dict[str, DataFrame] = {}
    for _ in range(max(1, rounds) if len(keys) > 1 else min(1, len(keys))):
        for k, key in enumerate(keys):
            rest = cells
            for other in keys:
                if other != key and other in effects:
                    rest = rest.join(effects[other], other, "left")
            sums = []
            for i in range(len(fields)):
                mean, shrink = fits[i]
                taken = F.lit(mean or 0.0)
                for other in keys:
                    if other != key and other in effects:
                        taken = taken + F.col(f"{other}:{i}")
                left = F.sum(F.col(f"s{i}") - F.col(f"n{i}") * taken)
                n = F.sum(f"n{i}").cast("double")
                sums.append((F.lit(0.0) if shrink[k] == float("inf") else F.when(n > 0, left / (n + F.lit(shrink[k]))).otherwise(0.0)).alias(f"{key}:{i}"))
            effects[key] = cut(rest.groupBy(key).agg(*sums))

    out = work
    for key in keys:
        out = out.join(effects[key], key, "left")
    columns = [F.col(c) for c in names]
    marks = []
    for i, field in enumerate(fields):
        mean, _ = fits[i]
        if mean is None:
            guess = F.lit(field.default)
        else:
            guess = F.lit(mean)
            for key in keys:
                guess = guess + F.col(f"{key}:{i}")
            guess = field.backward(guess)
        guess = F.coalesce(F.nanvl(guess, F.lit(field.default)), F.lit(field.default))
        limit = F.greatest(F.least(guess, field.high), field.low)
        missing = is_missing(field)
        at = next(j for j, c in enumerate(names) if c.lower() == field.name.lower())
        columns[at] = F.when(missing, limit).otherwise(F.col(field.name).cast("double")).alias(names[at])
        marks.append(missing.alias(fresh(names + [f.name + suffix for f in fields[:i]], field.name + suffix)))
    return out.select(*columns, *marks)


#: Most categories of a column: each level of a factor holds a number for each.
MOST_CATEGORIES = 2_000


def fill_category(df: DataFrame, name: str, factors: Sequence[str], strength: float = 1.0, rounds: int = 6, suffix: str = "_filled") -> DataFrame:
    """df with every null or blank value of a text column replaced by the
    likeliest category, and a mark <name><suffix>.

    The model is multinomial: the log odds of a category are its overall log
    share plus one effect per factor level, each effect drawn to zero with
    precision strength.  It is fitted jointly, by damped Newton steps for one
    factor after the other, on the counts per combination of levels, so
    correlated factors don't count twice.  Categories compare without case and
    surrounding space and are filled in that form; present values stay as they
    are.  Levels may be null, and a level without a present value has no
    effect.  Ties (to 6 places) go to the smaller category.  Without any present
    value the column stays null and is still marked.  More than MOST_CATEGORIES
    categories are an error.
    """
    from millrace.functions.keys import id_key

    names, keys, work = df.columns, [], df
    for f in factors:
        keys.append(fresh(names + keys, f"__level_{f}"))
        work = work.withColumn(keys[-1], F.coalesce(F.col(f).cast("string"), F.lit("\u0000")))
    cat, mark = fresh(names + keys, "__category"), fresh(names, name + suffix)
    work = work.withColumn(cat, id_key(F.col(name)))
    counts = cut(work.filter(F.col(cat).isNotNull()).groupBy(*keys, cat).agg(F.count(F.lit(1)).alias("n")))
    shares = [(r[cat], r["n"]) for r in counts.groupBy(cat).agg(F.sum("n").alias("n")).orderBy(cat).limit(MOST_CATEGORIES + 1).collect()]
    if len(shares) > MOST_CATEGORIES:
        raise ValueError(f"{name} has more than {MOST_CATEGORIES} categories")
    if not shares:
        return work.select(*names, F.col(cat).isNull().alias(mark))
    kinds = F.array(*[F.lit(c) for c, _ in shares])
    whole = sum(n for _, n in shares)
    base = F.array(*[F.lit(math.log(n / whole)) for _, n in shares])
    zero = F.array_repeat(F.lit(0.0), len(shares))
    places = counts.select(*keys, F.array_position(kinds, F.col(cat)).alias("place"), "n").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("by"))
    cells = places.select(*keys, F.transform(F.sequence(F.lit(1), F.lit(len(shares))), lambda k: F.coalesce(F.try_element_at("by", k.cast("bigint")), F.lit(0)).cast("double")).alias("own"))
    cells = cut(cells)
    effects: dict[str, DataFrame] = {}

    def odds(rows: DataFrame) -> tuple[DataFrame, Column]:
        total = base
        for key in keys:
            if key in effects:
                rows = rows.join(effects[key].select(key, F.col("effect").alias(f"{key}:e")), key, "left")
                total = F.zip_with(total, F.coalesce(F.col(f"{key}:e"), zero), lambda a, b: a + b)
        return rows, total

    for _ in range(rounds if len(keys) > 1 else 2 * rounds):
        for key in keys:
            rows, total = odds(cells)
            rows = rows.withColumn("eta", total)
            rows = rows.withColumn("e", F.transform("eta", lambda x: F.exp(x)))
            rows = rows.withColumn("m", F.aggregate("own", F.lit(0.0), lambda a, x: a + x) / F.aggregate("e", F.lit(0.0), lambda a, x: a + x)).withColumn("t", F.aggregate("own", F.lit(0.0), lambda a, x: a + x))
            flat = rows.select(key, "m", "t", F.posexplode(F.arrays_zip("own", "e")).alias("c", "x")).select(key, "c", F.col("x.own").alias("own"), (F.col("m") * F.col("x.e")).alias("fit"), "t")
            bend = lambda x: F.sum(F.col(x) * (1 - F.col(x) / F.nullif(F.col("t"), F.lit(0.0))))
            sums = flat.groupBy(key, "c").agg(F.sum(F.col("own") - F.col("fit")).alias("g"), F.greatest(bend("own"), bend("fit")).alias("h"))
            if key in effects:
                sums = sums.join(effects[key].select(key, F.posexplode("effect").alias("c", "u")), [key, "c"])
            else:
                sums = sums.withColumn("u", F.lit(0.0))
            step = (F.col("g") - F.lit(strength) * F.col("u")) / (2 * F.coalesce("h", F.lit(0.0)) + F.lit(strength))  # twice, as all categories move at once
            new = F.col("u") + F.greatest(F.lit(-3.0), F.least(F.lit(3.0), step))  # so exp can't overflow
            effects[key] = cut(sums.select(key, F.struct("c", new.alias("u")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x")).select(key, F.col("x.u").alias("effect")))

    rows, total = odds(work.filter(F.col(cat).isNull()).select(*keys).distinct())
    ranked = F.transform(F.arrays_zip(total.alias("s"), kinds.alias("c")), lambda x: F.struct((-F.round(x["s"], 6)).alias("s"), x["c"].alias("c")))
    best = rows.select(*keys, F.array_min(ranked)["c"].alias("__best"))
    joined = work.join(best, keys, "left") if keys else work.crossJoin(F.broadcast(best))
    columns = [(F.when(F.col(cat).isNull(), F.col("__best")).otherwise(F.col(c)).alias(c) if c.lower() == name.lower() else F.col(c)) for c in names]
    return joined.select(*columns, F.col(cat).isNull().alias(mark))
