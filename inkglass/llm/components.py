"""Connected components of links, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkglass.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id that links reach) of every id in links (a, b).

    Each round takes the smallest label among neighbours and then the label's own label, and is
    written to the shared folder. Ids without links get no row; null ends are ignored."""
    both = links.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.x", "e.y").distinct()
    edges = cut(both, "edges")
    now = cut(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("component")), "labels")
    while True:
        seen = edges.join(now, edges["y"] == now["id"]).groupBy("x").agg(F.min("component").alias("m"))
        nearer = now.join(seen, now["id"] == seen["x"]).select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        up = now.select(F.col("id").alias("at"), F.col("component").alias("up"))
        stepped = nearer.join(up, F.col("component") == F.col("at"), "left").select("id", "old", F.least("component", F.coalesce("up", "component")).alias("component"))
        after = cut(stepped, "labels")
        now = after.select("id", "component")
        if after.where("component != old").isEmpty():
            return now
