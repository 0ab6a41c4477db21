"""Style inheritance as expressions and a recursive query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.storage import stored


def toggled(chain: Column) -> Column:
    """A toggle along styles from the root to the leaf: on flips what is under it, off and absent do nothing."""
    return F.aggregate(chain, F.lit(None).cast("boolean"), lambda acc, x: F.when(F.coalesce(x, F.lit(False)), ~F.coalesce(acc, F.lit(False))).otherwise(acc))


def last_given(chain: Column) -> Column:
    """The last value of a chain that is not null."""
    return F.element_at(F.concat(F.array(F.lit(None)).cast("array<string>"), F.filter(chain, lambda x: x.isNotNull())), -1)


def style_chains(styles: DataFrame) -> DataFrame:
    """style, depth, ancestor, ended for ``styles`` (style, based_on): the walk ends at the root, a missing style or a cycle.

    ended: Root, BrokenStyleReference, StyleInheritanceCycle, or null on the way. A style has one row
    in ``styles``. Each round is one equi-join that adds to a path the path of its next style, so a
    table of any size is walked in as many rounds as the depth of its deepest chain has binary digits.
    """
    ended = F.when(F.col("based_on").isNull(), "Root").when(F.col("based_on") == F.col("style"), "StyleInheritanceCycle")
    paths = stored(styles.select("style", F.array("style").alias("path"), F.col("based_on").alias("next"), ended.alias("ended")), "style-paths")
    while not paths.where("ended is null").isEmpty():
        known = paths.select(F.col("style").alias("known"), F.col("path").alias("more"), F.col("next").alias("beyond"), F.col("ended").alias("end"))
        joined = paths.where("ended is null").join(known, F.col("next") == F.col("known"), "left")
        # The first style ahead that the path has already closes a cycle.
        joined = joined.withColumn("met", F.get(F.array_intersect(F.concat("more", F.array("beyond")), "path"), F.lit(0)))
        more = F.when(F.col("met").isNull(), F.col("more")).otherwise(F.expr("slice(more, 1, if(array_contains(more, met), cast(array_position(more, met) as int) - 1, size(more)))"))
        ended = F.when(F.col("known").isNull(), "BrokenStyleReference").when(F.col("met").isNotNull(), "StyleInheritanceCycle").otherwise(F.col("end"))
        longer = joined.select(
            "style",
            F.when(F.col("known").isNull(), F.col("path")).otherwise(F.concat("path", more)).alias("path"),
            F.when(F.col("known").isNull(), F.col("next")).otherwise(F.coalesce("met", "beyond")).alias("next"),
            ended.alias("ended"),
        )
        paths = stored(paths.where("ended is not null").unionByName(longer), "style-paths")
    steps = paths.select("style", F.posexplode("path").alias("depth", "ancestor"), (F.size("path") - 1).alias("last"), "ended")
    return steps.select("style", "depth", "ancestor", F.when(F.col("depth") == F.col("last"), F.col("ended")).alias("ended"))
