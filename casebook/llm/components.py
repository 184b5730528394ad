"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.session import written

MAX_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in `links` (a, b); component is the smallest id reachable.

    Each round gives every id the smallest label among itself and its neighbours,
    then follows labels once more (label of the label), so chains shorten by a
    power; it ends when no label changes. Labels are minima, so they combine before
    the shuffle, and every round is a written table.
    """
    both = written(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "links",
    )
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), "labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("low"))
        # A label's own label: the id that gives its name to the component has a row, as it is an end of a link.
        jumped = written(
            hooked.alias("x")
            .join(labels.selectExpr("id low", "component further"), "low", "left")
            .select("id", "component", F.least("low", F.coalesce("further", "low")).alias("next")),
            "labels",
        )
        changed = jumped.where("next <> component").limit(1).count()
        labels = jumped.selectExpr("id", "next component")
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {MAX_ROUNDS} rounds")
