"""Groups that hold more rows than a task should get."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.naming import quoted
from weft.plans.stage import counts_of, release, written

#: Rows of a table of heavy groups: small enough to broadcast whatever the size of the data.
MOST = 100_000


def heavy_groups(counts: DataFrame, keys: list[str], least: int, most: int = MOST) -> DataFrame | None:
    """The columns of counts, `parts` and `nr` for the groups with n >= least, as a written table; None if there are none.

    parts cuts a group into pieces of about `least` rows, an absolute bound; nr is a number of the group. The
    table has at most `most` rows, the largest groups (ties by key), so it can be broadcast; nothing is collected.
    Only if more than `most` groups reach `least` do some stay whole, and such a group has less than 1 / most of all rows.
    """
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), *(quoted(k) for k in keys)).limit(most)
    top = top.withColumn("parts", F.ceil(F.col("n") / least)).withColumn("nr", F.monotonically_increasing_id())
    heavy = written(top, "heavy", groups=F.lit(1), parts=F.col("parts"))
    if counts_of(heavy)["groups"]:
        return heavy
    release(heavy)
    return None


def part_of(heavy: DataFrame | None) -> int:
    """How many parts the groups of heavy_groups() have in all."""
    return counts_of(heavy)["parts"] if heavy is not None else 0


def _joined(rows: DataFrame, heavy: DataFrame, keys: list[str], how: str, *carried: str) -> DataFrame:
    """rows joined to a broadcast of heavy; null keys are keys."""
    own = heavy.select(*(F.col(quoted(k)).alias(f"__{i}") for i, k in enumerate(keys)), *carried)
    same = reduce(lambda a, b: a & b, (F.col(quoted(k)).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)))
    out = rows.join(F.broadcast(own), same, how)
    return out.drop(*(f"__{i}" for i in range(len(keys)))) if how == "inner" else out


def without(rows: DataFrame, heavy: DataFrame | None, keys: list[str]) -> DataFrame:
    """rows of groups that are not heavy; not shuffled."""
    return rows if heavy is None else _joined(rows, heavy, keys, "left_anti")


def salted(rows: DataFrame, heavy: DataFrame, keys: list[str], *carried: str, by: Column | None = None) -> DataFrame:
    """rows of heavy groups with these columns of heavy and `salt`, below the group's parts; not shuffled.

    The salt comes from the hash `by`, or from the place of the row in its partition, which spreads equal rows too.
    """
    mine = _joined(rows, heavy, keys, "inner", "parts", *carried)
    place = F.monotonically_increasing_id() if by is None else by
    return mine.withColumn("salt", F.pmod(place, F.col("parts")).cast("int")).drop("parts")


def copied(other: DataFrame, heavy: DataFrame, keys: list[str]) -> DataFrame:
    """The other side of a join with salted(): its rows of heavy groups, once for each salt."""
    mine = _joined(other, heavy, keys, "inner", "parts")
    return mine.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))).drop("parts")
