"""Connected components of a table of links: smallest labels pass along links, and labels jump to
the labels of their labels, until none changes. Every step is a join of written tables or a minimum
with partial aggregation, so that a hub's links are split over tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def roots(close: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix of links: the smallest index of each one's component."""
    n = len(close)
    root = np.arange(n)
    while True:
        heard = [np.where(close[i : i + 512], root[None, :], n).min(1, initial=n) for i in range(0, n, 512)]
        told = np.minimum(root, np.concatenate(heard or [root]))
        told = told[told]
        if (told == root).all():
            return root
        root = told


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (id, component_id) of every id in a link; component_id: the smallest id reachable."""
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other"))
    both = written(both.unionByName(both.select(F.col("other").alias("id"), F.col("id").alias("other"))).where("id <> other").distinct(), "links", let_go=False)
    labels = written(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("label")), "labels", let_go=False)
    while True:
        heard = both.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("heard"))
        told = written(
            labels.join(heard, "id", "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("heard", "label")).alias("label")),
            "told", let_go=False,
        )
        dropped(labels)
        if told.where("label <> was").isEmpty():
            dropped(both)
            return told.select("id", F.col("label").alias("component_id"))
        at = told.select(F.col("id").alias("label"), F.col("label").alias("next"))
        labels = written(told.select("id", "label").join(at, "label").select("id", F.least("label", "next").alias("label")), "labels", let_go=False)
        dropped(told)
