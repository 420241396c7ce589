"""Greedy matching without replacement, in rounds.

In order, each point takes the nearest one that is left. As rounds: all points ask
for the nearest that no earlier point holds; of those that ask for the same one the
earliest holds it, and who is turned away, or loses what it held, asks again. As the
points on the other side all prefer the earlier asker, what is held in the end is what
the greedy order gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumivox.lineage import cut


def greedy_pairs(distances: DataFrame, group: str, most_rounds: int | None = None) -> DataFrame:
    """(group, i, j, dist) from (group, i, j, dist): each i in order takes the nearest j left, of a tie the least.

    Rows with a missing number don't count; points without a partner left have no row.
    Groups are matched side by side; only points that are turned away go into
    the next round. Rounds end when nobody asks any more.
    """
    wishes = cut(distances.select(group, "i", "j", "dist").dropna())
    held = wishes.where("false")
    asking = wishes.select(group, "i").distinct()
    rounds = 0
    while True:
        taken = held.select(group, "j", F.col("i").alias("holder"))
        open_wishes = wishes.join(asking, [group, "i"]).join(taken, [group, "j"], "left").where("holder IS NULL OR i < holder")
        best = open_wishes.groupBy(group, "i").agg(F.min(F.struct("dist", "j")).alias("w")).select(group, "i", "w.j", "w.dist")
        claims = held.select(group, "i", "j", "dist").unionByName(best)
        first = claims.withColumn("first", F.min("i").over(Window.partitionBy(group, "j")))
        decided = cut(first)
        held = decided.where("i = first").select(group, "i", "j", "dist")
        asking = decided.where("i <> first").select(group, "i").distinct()
        rounds += 1
        if asking.isEmpty():
            return held
        if most_rounds is not None and rounds >= most_rounds:
            raise RuntimeError(f"not matched within {most_rounds} rounds")
