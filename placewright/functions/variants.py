"""Walking nested values of any depth."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

STEP = 8  # levels that are opened in one pass over the records


def every_node(rows: DataFrame, key: str, first: str, children) -> DataFrame:
    """All nodes below the nodes in array column `first`, these included: rows (key, n).

    `children` gives the array of nodes one level below a node. Each pass opens STEP levels inside
    the row; what is still open then goes into the next pass, until no node has any children.
    """
    found = []
    rows = rows.select(key, F.col(first).alias("l0"))
    while True:
        for level in range(STEP):
            rows = rows.withColumn(f"l{level + 1}", F.flatten(F.transform(f"l{level}", children)))
        # The last level is the next pass's first.
        opened = F.concat(*[F.col(f"l{level}") for level in range(STEP)])
        found.append(rows.select(key, F.explode(opened).alias("n")))
        rows = settle(rows.where(F.size(f"l{STEP}") > 0).select(key, F.col(f"l{STEP}").alias("l0")), "open")
        if not rows.head(1):
            return reduce(DataFrame.unionByName, found)
