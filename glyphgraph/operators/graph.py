"""A directed property multigraph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookup import BROADCAST_BYTES, fits_broadcast, lookup_join
from .merging import concat_sorted
from .storage import materialize, meeting_in_place

# Places on a path that share a LONG of bits, as a power of two.
_STRETCH_BITS = 6
# The stretch of places that are NULL, which no place is in.
_NO_STRETCH = -(1 << 63)


@dataclass(frozen=True)
class Graph:
    """vertices(id, ...attributes) with one row per id, and edges(src, dst, ...attributes).

    Ids may be of any comparable type, also a struct.
    """

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def build(vertices: DataFrame, edges: DataFrame) -> Graph:
        """Graph of any two tables.

        Parallel edges are kept. An endpoint that the vertex table lacks gets NULL attributes. Of
        several rows with one id the smallest is kept. One shuffle does both.
        """
        attributes = [c for c in vertices.columns if c != "id"]
        row = F.struct(*attributes)
        kind = vertices.select(row.alias("row")).schema["row"].dataType
        known = vertices.select("id", row.alias("row"))
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        # `row` is NULL for a mere endpoint and min() passes over it
        merged = (
            known.unionByName(ends.withColumn("row", F.lit(None).cast(kind)))
            .groupBy("id")
            .agg(F.min("row").alias("row"))
        )
        return Graph(merged.select("id", *[F.col("row")[a].alias(a) for a in attributes]), edges)

    @property
    def vertex_attributes(self) -> list[str]:
        return [c for c in self.vertices.columns if c != "id"]

    @property
    def edge_attributes(self) -> list[str]:
        return [c for c in self.edges.columns if c not in ("src", "dst")]

    def persist(self) -> Graph:
        return Graph(self.vertices.persist(), self.edges.persist())

    def unpersist(self) -> Graph:
        return Graph(self.vertices.unpersist(), self.edges.unpersist())

    # attributes

    def map_vertices(self, **attributes: Column) -> Graph:
        """Replace the vertex attributes by the given ones."""
        named = [value.alias(name) for name, value in attributes.items()]
        return Graph(self.vertices.select("id", *named), self.edges)

    def map_edges(self, **attributes: Column) -> Graph:
        """Replace the edge attributes by the given ones."""
        named = [value.alias(name) for name, value in attributes.items()]
        return Graph(self.vertices, self.edges.select("src", "dst", *named))

    def join_vertices(self, table: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES) -> Graph:
        """Take attribute values from `table`(id, ...) for the vertices it has a row for, one at most."""
        changed = [c for c in table.columns if c != "id"]
        renamed = table.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in changed])
        values = [
            F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
            if c in changed
            else F.col(c)
            for c in self.vertex_attributes
        ]
        joined = lookup_join(self.vertices, renamed, "id", broadcast_bytes=broadcast_bytes)
        return Graph(joined.select("id", *values), self.edges)

    # structure

    def reverse(self) -> Graph:
        swapped = self.edges.select(
            F.col("dst").alias("src"), F.col("src").alias("dst"), *self.edge_attributes
        )
        return Graph(self.vertices, swapped)

    def out_degrees(self) -> DataFrame:
        """(id, degree) of the vertices with at least one out-edge."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))

    def in_degrees(self) -> DataFrame:
        """(id, degree) of the vertices with at least one in-edge."""
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))

    def sources(self) -> DataFrame:
        """Vertices without in-edge; a written table where ids are places, see `_without_places`."""
        return self._without(self.edges.select(F.col("dst").alias("id")))

    def sinks(self) -> DataFrame:
        """Vertices without out-edge; a written table where ids are places."""
        return self._without(self.edges.select(F.col("src").alias("id")))

    def _without(self, ids: DataFrame) -> DataFrame:
        kind = self.vertices.schema["id"].dataType
        if _is_place(kind) and ids.schema["id"].dataType.simpleString() == kind.simpleString():
            return self._without_places(ids, kind.fieldNames())
        return self._without_any(ids)

    def _without_any(self, ids: DataFrame) -> DataFrame:
        # made distinct on the map side first, so a vertex with very many edges sends one row per task
        return self.vertices.join(ids.distinct().hint("merge"), "id", "left_anti")

    def _without_places(self, ids: DataFrame, fields: list[str]) -> DataFrame:
        """The same for ids that are places on a path, the last field being the place.

        The ids of 64 places in a row are the bits of one LONG, so what moves are the 64th part of their rows at
        most. Vertices that were dealt out by their path stay where they are; for that the join runs here.
        """
        paths = [f"_path{i}" for i in range(len(fields) - 1)]
        parts = [F.col("id")[field].alias(name) for field, name in zip(fields, (*paths, "_place"), strict=True)]
        attributes = self.vertex_attributes

        def with_bits(rows: DataFrame, *others: str) -> DataFrame:
            # taken apart in a step of its own, which lets Spark see by what the rows were dealt out
            place, low = F.col("_place"), F.lit((1 << _STRETCH_BITS) - 1)
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.coalesce(place.bitwiseAND(low), F.lit(0)).cast("int"))
            stretch = F.coalesce(F.shiftright(place, _STRETCH_BITS), F.lit(_NO_STRETCH).cast("long"))
            return rows.select(*parts, *others).select(*paths, "_place", *others, stretch.alias("_stretch"), bit.alias("_bit"))

        known = F.lit(True)
        for field in fields[:-1]:
            known = known & F.col("id")[field].isNotNull()
        taken = with_bits(ids.where(known)).groupBy(*paths, "_stretch").agg(F.bit_or("_bit").alias("_taken"))
        met = with_bits(self.vertices.where(known), *attributes).join(taken.hint("shuffle_hash"), [*paths, "_stretch"], "left")
        free = F.col("_taken").isNull() | (F.col("_taken").bitwiseAND(F.col("_bit")) == 0)
        again = F.struct(*[F.col(name).alias(field) for field, name in zip(fields, (*paths, "_place"), strict=True)])
        # a path without a name equals no other as a key of a join, but does as part of an id
        rest = Graph(self.vertices.where(~known), self.edges)._without_any(ids.where(~known))
        left = met.where(free).select(again.alias("id"), *attributes).unionByName(rest)
        with meeting_in_place(left.sparkSession):
            return materialize(left, "vertices-left")

    def members(self, ids: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """Vertices whose id is in `ids`(id)."""
        wanted = ids.select("id").distinct()
        small = fits_broadcast(wanted, broadcast_bytes)
        return self.vertices.join(
            F.broadcast(wanted) if small else wanted.hint("merge"), "id", "left_semi"
        )

    # messages

    def end_attributes(self, end: str) -> DataFrame:
        """The vertex table keyed by one end of an edge: (src, src_name, ...) or (dst, dst_name, ...)."""
        return self.vertices.select(
            F.col("id").alias(end),
            *[F.col(a).alias(f"{end}_{a}") for a in self.vertex_attributes],
        )

    def triplets(
        self,
        *,
        ends: tuple[str, ...] = ("src", "dst"),
        broadcast_bytes: int = BROADCAST_BYTES,
        small: bool | None = None,
    ) -> DataFrame:
        """Edges with the attributes of their ends as src_<attribute> and dst_<attribute>.

        Name in `ends` only the ends whose attributes are needed: each one costs a join.
        """
        if small is None and ends:
            small = fits_broadcast(self.vertices, broadcast_bytes)
        rows = self.edges
        for end in ends:
            rows = lookup_join(rows, self.end_attributes(end), end, small=small)
        return rows

    def aggregate_messages(
        self,
        *aggregates: Column,
        to_dst: Column | None = None,
        to_src: Column | None = None,
        ends: tuple[str, ...] = (),
        broadcast_bytes: int = BROADCAST_BYTES,
    ) -> DataFrame:
        """Send a message along every edge and combine those that meet: (id, ...aggregates).

        A message is a column over `triplets(ends=ends)`; NULL sends none. `aggregates` are aggregate
        columns over the column `msg`.
        """
        return combine_messages(
            self.triplets(ends=ends, broadcast_bytes=broadcast_bytes), to_dst, to_src, *aggregates
        )

    def concat_messages(
        self,
        separator: str,
        *,
        to_dst: Column | None = None,
        to_src: Column | None = None,
        ends: tuple[str, ...] = (),
        name: str = "msg",
        broadcast_bytes: int = BROADCAST_BYTES,
    ) -> DataFrame:
        """Send strings along every edge and join those that meet, in order: (id, name).

        For vertices that get any number of messages: none of them is gathered in one task.
        """
        sent = messages(self.triplets(ends=ends, broadcast_bytes=broadcast_bytes), to_dst, to_src)
        return concat_sorted(sent, "id", "msg", separator).withColumnRenamed("msg", name)


def _is_place(kind: T.DataType) -> bool:
    """Whether ids of a type are places on paths: a struct that ends with a LONG."""
    return isinstance(kind, T.StructType) and len(kind) > 1 and isinstance(kind[len(kind) - 1].dataType, T.LongType)


def messages(triplets: DataFrame, to_dst: Column | None, to_src: Column | None) -> DataFrame:
    """The messages that `triplets` send: (id, msg), `id` being the vertex that a message goes to."""
    sent = []
    if to_dst is not None:
        sent.append(F.struct(F.col("dst").alias("id"), to_dst.alias("msg")))
    if to_src is not None:
        sent.append(F.struct(F.col("src").alias("id"), to_src.alias("msg")))
    if len(sent) == 1:
        rows = triplets.select(sent[0].alias("m")).select("m.id", "m.msg")
    else:
        rows = triplets.select(F.explode(F.array(*sent)).alias("m")).select("m.id", "m.msg")
    return rows.where(F.col("msg").isNotNull())


def combine_messages(
    triplets: DataFrame, to_dst: Column | None, to_src: Column | None, *aggregates: Column
) -> DataFrame:
    """Messages of `triplets` grouped by the vertex they go to."""
    return messages(triplets, to_dst, to_src).groupBy("id").agg(*aggregates)
