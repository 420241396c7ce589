"""Multi-scale sampling: a pyramid of three-way means over running sums, descended level by level.

Level 0 has the running sums of the weights. Each level above has the means of every
full three entries of the one below, and the total as its last entry. The first entry of
a level that reaches a number lies, one level down, among five entries: means of
ascending values bound it from both sides. So a draw goes down by one join per level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumivox.lineage import cut

#: Entries that one mean is taken of, and levels of a stored pyramid.
FAN, LEVELS = 3, 10
#: Nodes of a level, at most, that are sent to every task (about 100 bytes each).
SENT_NODES = 50_000


@dataclass
class Level:
    """Entries (j, v) of one level, ``n`` of them, ascending in v; the last is the total."""

    rows: DataFrame
    n: int

    def above(self) -> Level:
        full = self.n // FAN
        mean = F.greatest(F.min("v"), F.least(F.max("v"), F.sum("v") / F.lit(float(FAN))))  # a mean that rounding takes past its entries would mislead the search
        means = self.rows.groupBy(F.floor(F.col("j") / FAN).alias("j")).agg(mean.alias("v"), F.count("*").alias("n")).where(F.col("n") == FAN)
        last = self.rows.where(F.col("j") == self.n - 1).select(F.lit(full).cast("long").alias("j"), "v")
        return Level(cut(means.select("j", "v").unionByName(last)), full + 1)


def build(sums: DataFrame, levels: int | None = None) -> list[Level]:
    """Levels over running sums (j from 0 without gaps, v): as many as given, or until one entry is left. No rows give one empty level."""
    first = cut(sums.select(F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")))
    out = [Level(first, first.count())]
    while (len(out) < levels) if levels else (out[-1].n > 1):
        out.append(out[-1].above())
    return out


def stored(levels: list[Level]) -> DataFrame:
    """(level, j, v) of all levels."""
    rows = [x.rows.select(F.lit(i).alias("level"), "j", "v") for i, x in enumerate(levels)]
    for more in rows[1:]:
        rows[0] = rows[0].unionByName(more)
    return rows[0]


def families(level: Level) -> DataFrame:
    """(j, kids): for every entry above, the entries of this level (at most five, as c and v) that the search may end in."""
    low, high = F.ceil((F.col("j") - (FAN - 1)) / FAN), F.floor((F.col("j") + FAN - 1) / FAN)
    met = level.rows.select(F.explode(F.sequence(F.greatest(low, F.lit(0)), high)).alias("parent"), F.col("j").alias("c"), "v")
    found = met.groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("kids"))
    return found.select(F.col("parent").alias("j"), "kids")


def reached(kids: Column, u: Column) -> Column:
    """The first of the kids whose value is at least u."""
    return F.array_min(F.transform(F.filter(kids, lambda x: x["v"] >= u), lambda x: x["c"]))


def descend(draws: DataFrame, levels: list[Level], u: str = "u") -> DataFrame:
    """Draws with ``j``, the first entry of level 0 that is at least ``u``, and ``steps``.

    Steps are counted as by a search that starts at each level below the middle of the
    entry found above, and goes on entry by entry. Draws beyond the total are left out.
    The levels must end in one entry.
    """
    if levels[-1].n > 1:
        raise ValueError("the pyramid must end in one entry")
    if not levels[0].n:
        return draws.where("false").select("*", F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("steps"))
    found = draws.withColumn("j", F.lit(0).cast("long")).withColumn("steps", F.lit(0).cast("long"))
    for level in reversed(levels[:-1]):
        kids = families(level)
        found = found.join(F.broadcast(kids) if level.n <= SENT_NODES else kids, "j")
        first = F.least(F.col("j") * FAN + FAN // 2, F.lit(level.n - 1))
        found = found.withColumn("at", reached(F.col("kids"), F.col(u))).where("at IS NOT NULL")
        steps = F.when(F.col("at") > first, F.col("at") - first).otherwise(first - F.col("at") + 1)
        found = found.withColumn("steps", F.col("steps") + steps).withColumn("j", F.col("at")).drop("at", "kids")
    return found if len(levels) > 1 else found.join(levels[0].rows, "j").where(F.col("v") >= F.col(u)).drop("v")
