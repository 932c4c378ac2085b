"""Positions on paths that are given by their edges alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .storage import Tables


def path_positions(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, path, pos) of all vertices(id): the start of each one's path and its distance from there.

    Every vertex may have one in-edge and one out-edge at most. By pointer doubling: a vertex knows one before
    it and how far that is, and takes over what that one knows, so the distance it has covered doubles each round, and
    a path of n vertices takes log2(n) of them. Vertices that have reached their start take part no more, so no round
    joins many rows with one. A cycle is an error, and so is a vertex with two edges on one side.
    """
    with Tables(edges.sparkSession) as tables:
        ends = edges.select("src", "dst")
        sides = [F.struct(F.col(end).alias("id"), F.lit(end).alias("side")) for end in ("src", "dst")]
        sides = ends.select(F.explode(F.array(*sides)).alias("side"))
        forked = sides.groupBy("side").agg(F.count("*").alias("n")).where("n > 1")
        if forked.limit(1).count():
            raise ValueError("a vertex of a path has at most one edge on either side")
        before = ends.select(F.col("dst").alias("id"), F.col("src").alias("path"))
        state = vertices.select("id").distinct().join(before.hint("merge"), "id", "left")
        # `found` is true once `path` is the start
        state = state.select(
            "id",
            F.coalesce("path", "id").alias("path"),
            F.when(F.col("path").isNull(), 0).otherwise(1).cast("long").alias("pos"),
            F.col("path").isNull().alias("found"),
        )
        state = tables.write(state, "path-state")
        while True:
            known = state.select(
                F.col("id").alias("path"),
                F.col("path").alias("next"),
                F.col("pos").alias("more"),
                F.col("found").alias("start"),
            )
            moved = state.where(~F.col("found")).join(known.hint("merge"), "path", "left")
            moved = moved.select(
                "id",
                F.coalesce("next", "path").alias("path"),
                (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"),
                F.coalesce("start", F.lit(True)).alias("found"),
            )
            seen = Observation()
            both = state.where("found").unionByName(moved)
            open_rows = F.coalesce(F.sum(F.when(F.col("found"), 0).otherwise(1)), F.lit(0))
            far = F.coalesce(F.max("pos"), F.lit(0)).alias("far")
            watched = both.observe(seen, open_rows.alias("open"), far, F.count("*").alias("n"))
            state = tables.write(watched, "path-state")
            now = seen.get
            if not now["open"]:
                break
            if now["far"] > now["n"]:
                raise ValueError("the edges hold a cycle")
        tables.keep("path-state")
        return state.select("id", "path", "pos")
