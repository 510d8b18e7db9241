"""A sample that stays the same across runs and as records are added."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import id_key

ROUNDS = 6
HALF = 1 << 32


def _word(hex8: Column) -> Column:
    return F.conv(hex8, 16, 10).cast("bigint")


def permuted(number_hex: Column, tweak: Column, seed: str) -> Column:
    """The permuted 64-bit identifier as a struct of two 32-bit halves, l and r.

    A balanced Feistel network is a bijection of the domain whatever its round
    function, so different numbers never collide under the same tweak.  The
    round function is the first 32 bits of SHA-256 over seed, round, tweak and
    half.  The rounds run as a fold, since unrolled they would be inlined into
    each other.
    """
    digits = F.lpad(F.lower(number_hex), 16, "0")
    start = F.struct(_word(F.substring(digits, 1, 8)).alias("l"), _word(F.substring(digits, 9, 8)).alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        mix = _word(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), i, tweak, acc["r"].cast("string")), 256), 1, 8))
        return F.struct(acc["r"].alias("l"), acc["l"].bitwiseXOR(mix).alias("r"))

    return F.aggregate(F.array(*[F.lit(str(i)) for i in range(ROUNDS)]), start, turn)


def stable_sample(df: DataFrame, id_column: str, rate: float, seed: str = "millrace") -> DataFrame:
    """The distinct sampled identifiers of df, in the form in which they compare.

    An identifier is project:hex with at most 16 hex digits; the hex part is
    its number in the fixed domain of 64-bit numbers, the project the tweak of
    the permutation.  It is selected if its permuted number lies under rate x
    2^64.  The choice depends on the identifier and the seed alone: not on
    other rows, their order, number or partitioning, so rows added later never
    displace a selected one, and a larger rate keeps all of a smaller one.
    Identifiers of any other form get the first 64 bits of their SHA-256 as
    number (collisions are then possible and only mean a common fate).  Null
    and blank identifiers are left out; repeated rows count once; rate 0 takes
    none and rate 1 all.  An empty table gives an empty sample.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie between 0 and 1")
    bound = int(Fraction(str(rate)) * (1 << 64))
    high, low = divmod(bound, HALF)
    ids = df.select(id_key(F.col(id_column)).alias(id_column)).filter(F.col(id_column).isNotNull())
    digits = F.regexp_extract(id_column, r"^[^:]+:([0-9a-f]{1,16})$", 1)
    plain = digits != ""
    number = F.when(plain, digits).otherwise(F.substring(F.sha2(F.col(id_column), 256), 1, 16))
    tweak = F.when(plain, F.substring_index(id_column, ":", 1)).otherwise("")
    out = ids.select(id_column, permuted(number, tweak, seed).alias("__p"))
    under = (F.col("__p.l") < F.lit(high)) | ((F.col("__p.l") == F.lit(high)) & (F.col("__p.r") < F.lit(low)))
    return out.filter(under).select(id_column).distinct()
