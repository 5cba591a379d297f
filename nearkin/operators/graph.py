"""Connected components and maximal cliques of a relatedness graph.

Edges are rows ``(i, j)`` of integer vertex ids, in either orientation, repeats allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearkin.session import discard, materialize

# Cliques handed over together.
CLIQUE_ROWS = 10_000
# Entries of neighbourhoods that one search for cliques takes whole.
SPLIT_ENTRIES = 500_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("i", "j").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j")))


def component_roots(edges: DataFrame) -> DataFrame:
    """``(vertex, root)`` for every vertex with an edge; ``root`` is its smallest member.

    Alternating large-star and small-star rounds: each vertex hands its smallest neighbour to
    the others, which shrinks the depth of every component by a constant factor per round.
    Minima are partial aggregates, so a hub's edges are reduced where they lie, and each round
    ends in a written table that carries no lineage.
    """
    loopless = edges.where("i <> j").select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"))
    stars = materialize(loopless.distinct(), "components")
    while True:
        # Large star: neighbours above a vertex move to the smallest of its neighbourhood. Minima are
        # written, so that the join with them is one of plain tables and a hub's edges can be split.
        around = _both_ways(stars)
        lowest = materialize(_smallest(around), "components-low")
        down = around.where("j > i").join(lowest, "i").select(F.col("j").alias("i"), F.col("low").alias("j"))
        down = materialize(down, "components-down")
        discard(stars, lowest)
        # Small star: the vertex itself and its neighbours below do the same.
        lowest = materialize(_smallest(down), "components-low")
        below = down.join(lowest, "i").select(F.col("j").alias("i"), F.col("low").alias("j"))
        moved = below.union(lowest.select("i", "low")).where("i <> j").distinct()
        moved = materialize(moved, "components")
        discard(down, lowest)
        stars = moved
        # Done when every component is a star: one parent each, and no parent has a parent.
        parents = stars.groupBy("i").agg(F.count(F.lit(1)).alias("parents"))
        also_parent = stars.select(F.col("j").alias("i"), F.lit(True).alias("is_parent")).distinct()
        if parents.join(also_parent, "i", "left").where("parents > 1 or is_parent").isEmpty():
            break
    roots = stars.select(F.col("i").alias("vertex"), F.col("j").alias("root"))
    return roots.union(stars.select(F.col("j").alias("vertex"), F.col("j").alias("root")).distinct())


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("i").agg(F.least(F.min("j"), F.col("i")).alias("low"))


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(vertex, component)`` for all vertices, isolated ones included.

    Components are numbered 1, 2, ... in order of their smallest vertex.
    """
    roots = component_roots(edges)
    labelled = materialize(
        vertices.select(F.col(vertices.columns[0]).alias("vertex"))
        .join(roots, "vertex", "left")
        .select("vertex", F.coalesce("root", "vertex").alias("root")),
        "labels",
    )
    numbered = number_in_order(labelled.where("vertex = root").select("root"), "root", "component")
    return labelled.join(numbered, "root").select("vertex", "component")


def number_in_order(df: DataFrame, value: str, name: str) -> DataFrame:
    """Number distinct values 1, 2, ... in their order without one global sort.

    Rows are dealt out by range, numbered inside each range and shifted by the number of rows in the
    ranges below. Ranges come from a sample of the values, so they are even however sparse these are.
    """
    ranged = df.select(value).repartitionByRange(value).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "numbering")
    below = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    # One row per range.
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(below), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(value))
    return ranged.withColumn("_inside", inside).join(offsets, "_range").select(
        value, (F.col("_offset") + F.col("_inside")).cast("int").alias(name)
    )


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from the endpoint of lower degree to the other.

    ``i``/``j`` become structs (degree, vertex). In this order a vertex has at most
    ``sqrt(2 * edges)`` successors, so a hub never owns a large group.
    """
    both = _both_ways(edges.where("i <> j")).distinct()
    degree = both.groupBy("i").agg(F.count(F.lit(1)).alias("deg"))
    ends = degree.select(F.col("i").alias("v"), F.struct("deg", F.col("i").alias("v")).alias("r"))
    return (
        both.where("i < j")
        .join(ends.select(F.col("v").alias("i"), F.col("r").alias("ri")), "i")
        .join(ends.select(F.col("v").alias("j"), F.col("r").alias("rj")), "j")
        .select(F.least("ri", "rj").alias("i"), F.greatest("ri", "rj").alias("j"))
    )


def _neighbourhoods(edges: DataFrame) -> DataFrame:
    """``(root, vertex, near)`` for each edge from ``root`` to a later ``vertex``: the common neighbours after both.

    The successors of a vertex are one row, at most ``sqrt(2 * edges)`` long, and common neighbours are
    intersections of two such rows: no pair of successors is ever a row of its own.
    """
    ranked = F.sort_array(F.collect_list("j"))
    after = edges.groupBy("i").agg(F.transform(ranked, lambda r: r["v"].cast("bigint")).alias("after"))
    after = materialize(after.select(F.col("i.v").cast("bigint").alias("root"), "after"), "successors")
    spread = after.select("root", "after", F.posexplode("after").alias("at", "vertex"))
    rest = F.slice("after", F.col("at") + 2, F.size("after"))
    other = after.select(F.col("root").alias("vertex"), F.col("after").alias("others"))
    # Plain tables on both sides, so that the rows of a vertex with many predecessors can be split.
    wedges = materialize(spread.select("root", "vertex", rest.alias("rest")), "wedges")
    near = F.coalesce(F.array_intersect("rest", "others"), F.array().cast("array<bigint>"))
    around = wedges.join(other, "vertex", "left").select("root", "vertex", near.alias("near"))
    around = materialize(around, "around")
    discard(after, wedges)
    return around


def _units(around: DataFrame, split: int) -> DataFrame:
    """``(root, second, vertex, near)``: what a search for the cliques above ``root`` (and ``second``) has to know.

    Rows with a ``vertex`` are candidates and those of their neighbours that come after them. Rows
    without one are the neighbourhoods of vertices that come earlier and may extend what is found; earlier
    vertices with the same neighbourhood are one row. A root with more than ``split`` entries is handed
    out as one unit for each second member, with an empty row to say that the unit exists.
    """
    nobody = F.lit(None).cast("bigint")
    before = around.where(F.size("near") > 0).select(F.col("vertex").alias("root"), nobody.alias("vertex"), "near").distinct()
    rows = materialize(around.union(before), "neighbourhoods")
    discard(around)
    large = rows.groupBy("root").agg(F.sum(F.size("near")).alias("entries")).where(F.col("entries") > split).select("root")
    whole = rows.join(large, "root", "left_anti").select("root", nobody.alias("second"), "vertex", "near")
    rows = rows.join(large, "root", "left_semi")
    inside = rows.where("vertex is not null")
    # Later common neighbours of root and second are candidates, each with its own later neighbours.
    reached = inside.select("root", F.col("vertex").alias("second"), F.explode("near").alias("vertex"))
    candidates = reached.join(inside, ["root", "vertex"]).select("root", "second", "vertex", "near")
    # Whoever comes before second and is its neighbour may extend what is found.
    earlier = rows.select("root", F.explode("near").alias("second"), nobody.alias("vertex"), "near")
    itself = inside.select("root", F.col("vertex").alias("second"), nobody.alias("vertex"), F.lit(None).cast("array<bigint>").alias("near"))
    return whole.union(candidates).union(earlier).union(itself)


def _places(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _cliques_at(base: list[int], vertices: list[int], near: list, earlier: list) -> Iterator[list[int]]:
    """Maximal cliques made of ``base`` and some ``vertices``, by branching with a pivot.

    Sets of candidates are bits of one integer. An earlier vertex is known by its neighbours among the
    candidates alone; one that has none left matters only where no candidate is left either.
    """
    place = {v: n for n, v in enumerate(vertices)}
    beside = [0] * len(vertices)
    for n, others in enumerate(near):
        for w in others:
            m = place.get(w)
            if m is not None:
                beside[n] |= 1 << m
                beside[m] |= 1 << n
    barred = {sum(1 << place[w] for w in set(others) if w in place) for others in earlier}
    stack = [(base, (1 << len(vertices)) - 1, barred)]
    while stack:
        chosen, open_, barred = stack.pop()
        if not open_:
            if not barred:
                yield sorted(chosen)
            continue
        pivot = max((beside[n] for n in _places(open_)), key=lambda b: (b & open_).bit_count())
        if barred:
            pivot = max(pivot, max(barred, key=lambda b: (b & open_).bit_count()), key=lambda b: (b & open_).bit_count())
        for n in _places(open_ & ~pivot):
            inside = open_ & beside[n]
            met = {b & inside for b in barred if b >> n & 1}
            if inside:
                met.discard(0)
            stack.append((chosen + [vertices[n]], inside, met))
            open_ ^= 1 << n
            barred = barred | {beside[n]}


def _local_cliques(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cliques of a partition sorted by unit; a unit's rows may go on in the next batch."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("root", "second", "vertex", "near")))

    out: list[list[int]] = []
    for (root, second), unit in groupby(rows(), key=itemgetter(0, 1)):
        vertices, near, earlier = [], [], []
        for _, _, vertex, others in unit:
            if vertex is not None:
                vertices.append(vertex)
                near.append(others)
            elif others is not None:
                earlier.append(others)
        for clique in _cliques_at([root] if second is None else [root, second], vertices, near, earlier):
            out.append(clique)
            if len(out) == CLIQUE_ROWS:
                yield pa.record_batch([pa.array(out, pa.list_(pa.int64()))], ["clique"])
                out = []
    yield pa.record_batch([pa.array(out, pa.list_(pa.int64()))], ["clique"])


def maximal_cliques(edges: DataFrame, split: int = SPLIT_ENTRIES) -> DataFrame:
    """All maximal cliques of two or more vertices, as sorted arrays.

    Every clique is found at its lowest member in degree order, among that member's successors;
    those are bounded by the orientation, not by component size. Earlier vertices travel along as what
    they are next to, so that nothing found has to be taken back. A root with more than ``split``
    entries is searched by as many tasks as it has successors.
    """
    units = _units(_neighbourhoods(_oriented(edges)), split)
    # One call for a partition, not one for every root. Searching is not in proportion to bytes: a fixed
    # number of partitions is not merged by their size.
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = units.repartition(tasks, "root", "second").sortWithinPartitions("root", "second")
    return local.mapInArrow(_local_cliques, "clique array<bigint>")
