"""Hash trees over a table: a root for each source, one over the sources, and a proof for each row.

A row's leaf is the hash of its fields. Leaves of one source, in order, are hashed by three until one
node is left, and so are the sources' roots. Ranks come from a range partitioning and the counts of
its parts, so a source may hold any share of the rows. Then bundles of 3**7 neighbouring nodes climb
seven levels at once: inside a bundle, ``lag`` and ``lead`` by fixed offsets (1 and 2 nodes of the level)
are masked by a node's slot in its run of three and the run's length and give its siblings, and the
first child's row hashes the parent. A bundle's root is a node of the next table, of 3**7 times fewer
rows; the siblings found there are joined back by bundle. No window is larger than a bundle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearkin.session import discard, materialize

ARITY = 3
# Levels inside a window of 3**7 nodes.
LEVELS = 7
WIDTH = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(*[field(f) for f in fields])


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the rank inside the tree from 0 on, and ``n``, the tree's size.

    Rows are sorted over all tasks; a part's place inside its tree is the sum of the parts before it,
    one small row for each part and tree.
    """
    placed = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.select(*rows.columns, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    placed = materialize(placed, "merkle-placed")
    parts = placed.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy(tree)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        tree, "_part", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_size").over(whole).alias("n")
    )
    return placed.join(parts, [tree, "_part"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def climb(nodes: DataFrame) -> DataFrame:
    """One table of nodes (``tree, pos, n, hash``) with each one's siblings on the way to its bundle's root.

    Adds ``bundle``, ``path`` (for each level climbed, the siblings left and right of the way, as bytes)
    and, on a bundle's first row, ``top``, the bundle's root. A tree of one node climbs nothing.
    """
    nodes = nodes.withColumn("bundle", F.floor(F.col("pos") / WIDTH))
    kept = nodes.columns
    window = Window.partitionBy("tree", "bundle").orderBy("pos")
    nodes, empty = nodes.withColumn("_node", F.col("hash")), F.lit("")
    for level in range(LEVELS):
        step = ARITY**level
        slot = F.floor(F.col("pos") / step) % ARITY
        run = F.least(F.lit(ARITY), F.ceil(F.col("n") / step) - F.floor(F.col("pos") / step) + slot)
        moved = {name: go("_node", by * step).over(window) for name, go, by in (("_l1", F.lag, 1), ("_l2", F.lag, 2), ("_r1", F.lead, 1), ("_r2", F.lead, 2))}
        nodes = nodes.withColumns(moved)
        left = F.concat(F.when(slot == 2, F.col("_l2")).otherwise(empty), F.when(slot >= 1, F.col("_l1")).otherwise(empty))
        right = F.concat(F.when(slot + 1 < run, F.col("_r1")).otherwise(empty), F.when(slot + 2 < run, F.col("_r2")).otherwise(empty))
        climbing, first = F.col("n") > step, F.col("pos") % (ARITY * step) == 0
        siblings = F.struct(F.unhex(left).alias("left"), F.unhex(right).alias("right"))
        parent = F.when(climbing, digest(F.col("_node"), right)).otherwise(F.col("_node"))
        nodes = nodes.withColumns({f"_s{level}": F.when(climbing & (F.col("pos") % step == 0), siblings), "_node": F.when(first, parent)})
        nodes = nodes.drop(*moved)
    # A node's siblings stand on its first row; the rows below it take them from there.
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.array(*[F.last(f"_s{level}", ignorenulls=True).over(so_far) for level in range(LEVELS)])
    return nodes.select(*kept, F.filter(carried, lambda s: s.isNotNull()).alias("path"), F.col("_node").alias("top"))


def forest(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of nodes from the given ones up, each with its paths, and each tree's root (``tree, hash``)."""
    tables = []
    while True:
        table = materialize(climb(nodes), "merkle-nodes")
        tables.append(table)
        tops = table.where(F.col("pos") % WIDTH == 0)
        nodes = tops.select("tree", F.col("bundle").alias("pos"), F.ceil(F.col("n") / WIDTH).alias("n"), F.col("top").alias("hash"))
        if (table.agg(F.max("n")).first()[0] or 0) <= WIDTH:
            return tables, nodes.select("tree", "hash")


def way_up(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest table's rows with ``path`` going on to the end of ``above``'s (one row for each ``tree``)."""
    extra = [c for c in above.columns if c not in ("tree", "path")]
    above = above.withColumn("bundle", F.lit(0).cast("bigint"))
    for table in reversed(tables):
        upper = above.withColumnRenamed("path", "_path")
        joined = table.join(upper, ["tree", "bundle"])
        own = [c for c in table.columns if c not in ("bundle", "path", "top", "n", "hash")]
        above = joined.select(*own, "hash", F.concat("path", "_path").alias("path"), *extra)
        if table is not tables[0]:
            above = above.withColumnRenamed("pos", "bundle").drop("hash")
    return above


def fold(path: Column, start: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda at, s: digest(F.lower(F.hex(s["left"])), at, F.lower(F.hex(s["right"]))))


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``doc_id, leaf, path, subroot, root, proof, folded_root, verified`` for every row of ``docs``.

    ``tampered`` is the text as it is checked against the manifest (by default the text itself). Leaves
    go up by ``doc_id`` (null first), equal ids by leaf; sources by UTF-8 bytes (null first). Identical
    rows are leaves of their own, with proofs of their own. A lone row is its source's root, a lone
    source's root is hashed no further. Null fields have a mark of their own, so an empty text differs
    from none; an empty table gives no rows; columns other than ``fields`` are ignored.
    """
    columns = {name: F.col(f"`{name}`") for name in fields}
    checked = {**columns, "text": columns["text"] if tampered is None else tampered}
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))
    leaves = docs.select(
        tree.alias("tree"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf(list(columns.values())).alias("hash"),
        leaf(list(checked.values())).alias("found"),
        F.monotonically_increasing_id().alias("_row"),
    )
    leaves = materialize(leaves, "merkle-leaves")
    placed = ranked(leaves, "tree", ["doc_id", "hash", "_row"]).drop("_row")
    tables, subroots = forest(placed)
    subroots = materialize(subroots, "merkle-subroots")
    sources = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "hash"), "tree", ["source"])
    upper, roots = forest(sources)
    tops = way_up(upper, roots.select("tree", F.col("hash").alias("root"), F.array().cast(upper[0].schema["path"].dataType).alias("path")))
    above = tops.select(F.col("source").alias("tree"), F.col("hash").alias("subroot"), "root", "path")
    rows = way_up(tables, materialize(above, "merkle-sources"))
    discard(leaves, subroots)
    proof = F.lower(F.array_join(F.transform("path", lambda s: F.concat(F.hex(s["left"]), F.hex(s["right"]))), ""))
    folded = rows.select(
        "doc_id", F.col("hash").alias("leaf"), "path", "subroot", "root", F.sha2(proof.cast("binary"), 256).alias("proof"), fold(F.col("path"), F.col("found")).alias("folded_root")
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
