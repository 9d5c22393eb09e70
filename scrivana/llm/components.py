"""Connected components by star contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivana.llm.common import discard, materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of an edge, component being the least node that it reaches.

    Alternates large-star and small-star (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014) until the edges are stars. A node's least neighbour is a partial aggregate joined
    back to its edges, so a node with a third of all edges is pre-aggregated and its join can be split
    by adaptive execution. Nulls and self loops name no link. Long chains take O(log n) rounds.
    Raises if max_rounds pass without an end (no partial answer is returned).
    """
    given = getattr(edges, "_scrivana_path", None)
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    links = None if given else materialise(e, "links")  # read for loops and edges alike; what makes the links may be costly
    e = e if given else links
    loops = e.where(F.col("u") == F.col("v")).select(F.col("u").alias("node")).distinct()
    e = e.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialise(e, "edges")
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = materialise(small.where(F.col("u") != F.col("v")).distinct(), "stars")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e)
        e = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select("v").union(loops.select(F.col("node").alias("v"))).distinct()
    roots = roots.join(e.select(F.col("u").alias("v")), "v", "left_anti")
    out = materialise(members.union(roots.select("v", F.col("v").alias("component"))).toDF("node", "component"), "components")
    discard(e, *([links] if links is not None else []))
    return out
