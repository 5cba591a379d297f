"""Candidate pairs for a thresholded string join, found through equi-joins on derived keys.

All functions take *units*, one row per string to be joined::

    u      identity, comparable and unique
    sample name of the collection the string belongs to
    seq    the string,  len  its length

and return candidate pairs ``(a, b)``, possibly with repeats, that contain every pair whose
distance is at most ``k``. Three kinds of keys are used:

* **signature** -- chunks of a string of which all but ``k`` survive ``k`` edits. Only the rarest
  few chunks of each string produce candidates, so a chunk shared by most of the data is
  skipped as long as the string has ``k + 1`` rarer ones.
* **segments** -- exactly ``k + 1`` pieces, at least one of which survives. For strings with too
  few chunks for a signature, and for joins asked for without a chunk length.
* **deletions** -- what is left of a string after up to ``k`` deletions; strings within ``k`` edits
  share one. Very selective but only affordable for short strings or tiny ``k``, where they
  also take over the frequent chunks that a signature cannot avoid.

Keys are 64-bit hashes: a collision can only add a candidate, which verification removes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearkin.functions.encode import SKETCH, equal_chunks, lmer_set, lmers, piece_keys, piece_probes, piece_probes_in_order
from nearkin.session import materialize

# Most deletion keys one string may produce.
MAX_DELETION_KEYS = 256
# Where only related pairs are asked for, a chunk held by more units than this is avoided if it can
# be: see signature joins below.
FREQUENT_KEY = 1000
# Most units of a key on one side of a cell: a cell compares at most KEY_BLOCK**2 pairs, however hot the
# key. Units are dealt by hash, so blocks are planned smaller by a margin that chance does not use up.
KEY_BLOCK = 10_000
MARGIN = 0.9
# Columns of a prefix; ``pos`` only where places count, sketches only where related pairs alone are wanted.
PREFIX = ("u", "sample", "len", *SKETCH, "key", "freq", "pos")
# Pairs for each string that pieces may propose before signatures are considered.
FEW_PAIRS = 100
# Pairs that one task judges where keys meet, and most of such tasks.
TASK_PAIRS, MOST_TASKS = 10_000_000, 2000
# Chunks are not made shorter than this to get around frequent ones.
MIN_CHUNK = 4


@dataclass(frozen=True)
class Scope:
    """Which units may pair up: all, only those of one sample, or only those of different ones."""

    kind: str  # "all", "within" or "across"

    @property
    def keys(self) -> list[str]:
        return ["sample"] if self.kind == "within" else []

    def allows(self) -> Column:
        if self.kind == "across":
            return F.col("x.sample") != F.col("y.sample")
        if self.kind == "within":
            return F.col("x.sample") == F.col("y.sample")
        return F.lit(True)


def longest_for_deletions(k: int) -> int:
    """Length up to which all deletion keys of a string stay within the limit."""
    length = 0
    while length < MAX_DELETION_KEYS and sum(comb(length + 1, d) for d in range(k + 1)) <= MAX_DELETION_KEYS:
        length += 1
    return length


def ordered(pairs: DataFrame) -> DataFrame:
    """Smaller identity first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _near(left: Column, right: Column, k: int) -> Column:
    return F.abs(left - right) <= k


def _carried(units: DataFrame) -> list[str]:
    """What key rows know of their unit."""
    return [c for c in ("u", "sample", "len", *SKETCH) if c in units.columns]


def _alike(units: DataFrame, k: int) -> Column:
    """False only if sketches, where there are some, tell that the distance is above ``k``: an edit turns four bits at most."""
    if SKETCH[0] not in units.columns:
        return F.lit(True)
    turned = (F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in SKETCH)
    return reduce(lambda left, right: left + right, turned) <= 4 * k


def _written(keys: DataFrame) -> DataFrame:
    return keys if hasattr(keys, "written_to") else materialize(keys, "keys")


def hot_keys(x: DataFrame, y: DataFrame) -> DataFrame:
    """``key, rows, columns`` for keys that too many units of either side hold, among those both sides have.

    Counts are partial aggregates, so a key held by most units costs one row per task.
    """
    planned = max(1, int(KEY_BLOCK * MARGIN))
    count = lambda keys, name: keys.groupBy("key").agg(F.count(F.lit(1)).alias(name))
    held = count(x, "rows").withColumn("columns", F.col("rows")) if x is y else count(x, "rows").join(count(y, "columns"), "key")
    hot = held.where((F.col("rows") > KEY_BLOCK) | (F.col("columns") > KEY_BLOCK))
    blocks = lambda c: F.ceil(F.col(c) / planned).cast("int").alias(c)
    return materialize(hot.select("key", blocks("rows"), blocks("columns")), "hot-keys")


def in_cells(x: DataFrame, y: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the ``cell`` of the key's grid that a row takes part in.

    A hot key is a grid of ``rows`` by ``columns`` cells. A unit of ``x`` belongs to one row, by
    hash, and goes to all its cells; a unit of ``y`` belongs to one column. Each pair of units thus
    meets in exactly one cell. Other keys are a single cell.
    """

    def dealt(keys: DataFrame, own: str, other: str, cell) -> DataFrame:
        joined = keys.join(hot, "key", "left")
        mine, others = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        place = F.pmod(F.xxhash64("u"), mine).cast("int")
        cells = F.transform(F.sequence(F.lit(0), others - 1), lambda o: cell(place, o))
        return joined.withColumn("cell", F.explode(cells)).drop("rows", "columns")

    columns = F.coalesce("columns", F.lit(1)).cast("bigint")
    return (
        dealt(x, "rows", "columns", lambda row, column: row * columns + column),
        dealt(y, "columns", "rows", lambda column, row: row * columns + column),
    )


def _meet(x: DataFrame, y: DataFrame, condition: Column, scope: Scope, most: int | None = None, tasks: int = 0) -> DataFrame:
    """Join two key tables on ``key`` (and the sample inside samples).

    The tables are written once, counted, and keys with more than ``KEY_BLOCK`` units on a side are
    dealt into a grid of cells, so no task takes on all pairs of a hot key. ``most`` is an upper bound
    of the units per key on both sides, if one is known. Key tables come from exploded strings,
    whose size Spark does not see, so neither side is left to be broadcast. With ``tasks`` the
    condition tells which pairs are related; their copies come along, and the join is spread over so many tasks.
    """
    on = F.col("x.key") == F.col("y.key")
    if most is None or most > KEY_BLOCK:
        same = x is y
        x = _written(x)
        y = x if same else _written(y)
        hot = hot_keys(x, y)
        if not hot.isEmpty():
            x, y = in_cells(x, y, hot)
            on = on & (F.col("x.cell") == F.col("y.cell"))
    if tasks:
        # Judging is what takes time, and rows are few and small: tasks are planned by pairs, not by bytes.
        parts = [*scope.keys, *(c for c in ("key", "cell") if c in x.columns)]
        x, y = x.repartition(tasks, *parts), y.repartition(tasks, *parts)
    joined = x.alias("x").join(y.hint("merge").alias("y"), on & scope.allows() & condition)
    if tasks:
        return _judged(joined)
    return joined.select(F.col("x.u").alias("a"), F.col("y.u").alias("b"))


def _written_prefix(prefix: DataFrame) -> tuple[DataFrame, int]:
    """A prefix written once, and the number of holders of its most frequent token."""
    # A unit that holds a token twice needs it once.
    columns = [c for c in PREFIX if c in prefix.columns]
    written = materialize(prefix.select(*columns).dropDuplicates([c for c in ("u", "key", "pos") if c in columns]), "prefix")
    return written, written.agg(F.max("freq")).first()[0] or 0


# -- deletion keys ---------------------------------------------------------------------------


def mask_count(length: int, k: int) -> int:
    return sum(comb(length, d) for d in range(k + 1))


def short_hamming_pairs(units: DataFrame, k: int, length: int, scope: Scope) -> DataFrame:
    """``(a, b, n_a, n_b)``: all pairs within ``k`` of strings of one ``length``, each pair once, judged where they meet.

    A string makes one row for each set of up to ``k`` places: these places' symbols, and the rest as key.
    A pair is related if it meets at the set of exactly the places where it differs, and nowhere else.
    """

    def row(number: int, places: tuple[int, ...]) -> Column:
        bounds = [-1, *places, length]
        rest = [F.substring("core", i + 2, j - i - 1) for i, j in zip(bounds, bounds[1:]) if j - i > 1]
        symbols = [F.substring("core", p + 1, 1) for p in places] + [F.lit(None).cast("string")] * (k - len(places))
        return F.struct(F.lit(number).alias("mask"), F.concat(F.lit(""), *rest).alias("rest"), *[g.alias(f"g{i}") for i, g in enumerate(symbols)])

    masks = [places for d in range(k + 1) for places in combinations(range(length), d)]
    rows = units.select("u", "sample", "n", F.explode(F.array(*[row(i, m) for i, m in enumerate(masks)])).alias("row"))
    rows = rows.select("u", "sample", "n", "row.*")
    met = (F.col("x.mask") == F.col("y.mask")) & (F.col("x.rest") == F.col("y.rest")) & scope.allows() & (F.col("x.u") < F.col("y.u"))
    for i in range(k):
        met = met & (F.col(f"x.g{i}").isNull() | (F.col(f"x.g{i}") != F.col(f"y.g{i}")))
    return _judged(rows.alias("x").join(rows.hint("merge").alias("y"), met))


def short_edit_pairs(units: DataFrame, k: int, scope: Scope) -> DataFrame:
    """``(a, b, n_a, n_b)``: all pairs within ``k`` edits, each pair once, judged where their deletions meet.

    Different strings one edit apart have exactly one text in common, equal ones are taken at their whole text.
    Beyond one edit a pair may meet at several texts, and its repeats are dropped after it was judged.
    """
    rows = units.select("u", "sample", "n", "core", F.explode(_deletions(F.col("core"), k)).alias("key"))
    same = F.col("x.core") == F.col("y.core")
    related = F.when(same, F.col("x.key") == F.col("x.core")).otherwise(F.levenshtein("x.core", "y.core", k) >= 0)
    met = (F.col("x.key") == F.col("y.key")) & scope.allows() & (F.col("x.u") < F.col("y.u")) & related
    pairs = _judged(rows.alias("x").join(rows.hint("merge").alias("y"), met))
    return pairs if k < 2 else pairs.dropDuplicates(["a", "b"])


def _judged(met: DataFrame) -> DataFrame:
    return met.select(F.col("x.u").alias("a"), F.col("y.u").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))


def _deletions(seq: Column, k: int) -> Column:
    """The text and what is left of it after up to ``k`` deletions."""
    variants = F.array(seq)
    every = variants
    for _ in range(k):
        def shorter(s: Column) -> Column:
            n = F.length(s)
            drop = lambda p: F.concat(F.substring(s, F.lit(1), p - 1), F.substring(s, p + 1, n))
            return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), drop)).otherwise(F.array().cast("array<string>"))

        variants = F.array_distinct(F.flatten(F.transform(variants, shorter)))
        every = F.concat(every, variants)
    return F.array_distinct(every)


def _deletion_keys(seq: Column, k: int) -> Column:
    return F.array_distinct(F.transform(_deletions(seq, k), lambda s: F.xxhash64(s)))


def deletion_pairs(
    units: DataFrame, k: int, scope: Scope, below: int | None = None, only: DataFrame | None = None
) -> DataFrame:
    """Pairs meeting on a deletion key.

    Without ``only``: pairs whose longer string is short enough, and shorter than ``below`` if
    that is given. With ``only``: pairs having a unit listed there on one side, the partner
    being up to ``k`` longer.
    """
    limit = longest_for_deletions(k)
    if below is not None:
        limit = min(limit, below - 1)

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.select(*_carried(rows), F.explode(_deletion_keys(F.col("seq"), k)).alias("key"))

    apart = _near(F.col("x.len"), F.col("y.len"), k) & _alike(units, k)
    if only is None:
        keys = keyed(units.where(F.col("len") <= limit))
        return _meet(keys, keys, apart & (F.col("x.u") < F.col("y.u")), scope)
    mine = keyed(units.where(F.col("len") <= limit).join(only, "u", "left_semi"))
    theirs = keyed(units.where(F.col("len") <= limit + k))
    return ordered(_meet(mine, theirs, apart & (F.col("x.u") != F.col("y.u")), scope))


# -- segment keys ----------------------------------------------------------------------------


def _proposed(x: DataFrame, y: DataFrame) -> tuple[int, int]:
    """How many pairs two written key tables propose, and the most units that hold a key of both."""
    count = lambda keys, name: keys.groupBy("key").agg(F.count(F.lit(1)).alias(name))
    held = count(x, "rows").join(count(y, "columns"), "key")
    found = held.agg(F.sum(F.col("rows") * F.col("columns").cast("double")), F.max(F.greatest("rows", "columns"))).first()
    return int(found[0] or 0), found[1] or 0


def segment_pairs(units: DataFrame, k: int, scope: Scope, shifts: bool, below: int | None = None) -> DataFrame:
    probes, cut = _segment_keys(units, k, shifts, max(longest_for_deletions(k), k), below)
    return _segments_met(units, k, scope, probes, cut, None)


def _segments_met(units: DataFrame, k: int, scope: Scope, probes: DataFrame, cut: DataFrame, most: int | None) -> DataFrame:
    shorter = (F.col("x.len") < F.col("y.len")) | (
        (F.col("x.len") == F.col("y.len")) & (F.col("x.u") < F.col("y.u"))
    )
    return ordered(_meet(probes, cut, shorter & _alike(units, k), scope, most))


def _segments_judged(units: DataFrame, k: int, scope: Scope, probes: DataFrame, cut: DataFrame, most: int | None, tasks: int) -> DataFrame:
    """``(a, b, n_a, n_b)``: all pairs within ``k`` that share a piece, each once: judged where the first one they share meets."""
    shorter = (F.col("x.len") < F.col("y.len")) | ((F.col("x.len") == F.col("y.len")) & (F.col("x.u") < F.col("y.u")))
    met = (F.coalesce(F.array_contains("x.earlier", F.col(f"y.piece{m}")), F.lit(False)) for m in range(k))
    first = ~reduce(lambda left, right: left | right, met, F.lit(False))
    related = F.levenshtein("x.seq", "y.seq", k) >= 0
    pairs = _meet(probes, cut, shorter & _alike(units, k) & first & related, scope, most, tasks)
    swap = F.col("a") > F.col("b")
    turned = lambda one, other: F.when(swap, F.col(other)).otherwise(F.col(one))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), turned("n_a", "n_b").alias("n_a"), turned("n_b", "n_a").alias("n_b"))


def related_edit_pairs(units: DataFrame, k: int, l: int, scope: Scope, shortest: int, frequent: int, rows: int, judged: bool = False) -> DataFrame:
    """Pairs whose longer string has more than ``k`` chunks of length ``l``, by pieces or by signature.

    ``judged``: strings are short enough to travel with their keys; pairs found by pieces are then judged where they
    meet and come as ``(a, b, n_a, n_b)``, so that only related ones leave the join.

    Each string makes a few pieces but as many l-mers as symbols, so pieces are tried first; where they
    propose many pairs, as parts shared by most strings do, signatures are used if these propose fewer.
    """
    probes, cut = _segment_keys(units, k, True, l * (k + 1) - 1, None, judged)
    cut = materialize(cut, "keys")
    # Most places where a string looks for a piece of another one hold none.
    probes = materialize(probes.join(cut.select("key").distinct(), "key", "left_semi"), "keys")
    proposed, most = _proposed(probes, cut)
    if proposed > FEW_PAIRS * rows:
        prefix = _written_prefix(_edit_prefix(units, k, l, scope, None))
        if (prefix[0].agg(F.sum("freq")).first()[0] or 0) < proposed:
            return signature_edit_pairs(units, k, l, scope, shortest, frequent, prefix)
    if judged:
        tasks = max(units.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, proposed // TASK_PAIRS))
        return _segments_judged(units, k, scope, probes, cut, most, tasks)
    return _segments_met(units, k, scope, probes, cut, most)


def _segment_keys(
    units: DataFrame, k: int, shifts: bool, limit: int, below: int | None, judged: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Pairs meeting on a piece of the longer string, beyond the reach of deletion keys.

    The longer string is cut; the other one looks for piece ``m`` where ``m`` earlier edits can
    have moved it from the left and ``k - m`` later ones from the right. ``shifts=False`` looks
    at the piece's own place only, which is enough for Hamming distance. The longer string has more
    than ``limit`` symbols, and fewer than ``below``, if that is given. ``judged``: keys carry their string and the keys of earlier pieces.
    """
    longer = units.where(F.col("len") > limit)
    partners = units.where(F.col("len") > limit - k)
    if below is not None:
        longer, partners = longer.where(F.col("len") < below), partners.where(F.col("len") < below)
    if judged:
        known = [*_carried(units), "seq", "n"]
        cut = longer.select(*known, piece_keys("seq", k).alias("pieces")).select(*known, "pieces", F.posexplode("pieces").alias("m", "key"))
        earlier = (F.when(F.col("m") > m, F.get("pieces", F.lit(m))).alias(f"piece{m}") for m in range(k))
        probes = partners.select(*known, F.explode(piece_probes_in_order("seq", k, limit)).alias("row"))
        return probes.select(*known, "row.key", "row.earlier"), cut.select(*known, "key", *earlier)
    cut = longer.select(*_carried(units), F.explode(piece_keys("seq", k)).alias("key"))
    probes = partners.select(*_carried(units), F.explode(piece_probes("seq", k, limit, shifts)).alias("key"))
    return probes, cut


def tiny_pairs(units: DataFrame, k: int, scope: Scope) -> DataFrame:
    """Pairs of strings no longer than ``k`` that deletion keys do not reach.

    Any two such strings are within ``k``, so every pair of them belongs to the result. Rows are
    dealt into blocks and blocks meet blocks, which spreads that output over many tasks.
    """
    blocks = 32
    rows = units.where(F.col("len") <= k).withColumn("block", F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    x = rows.select("u", "sample", "len", F.explode(F.transform(others, lambda o: F.col("block") * blocks + o)).alias("key"))
    y = rows.select("u", "sample", "len", F.explode(F.transform(others, lambda o: o * blocks + F.col("block"))).alias("key"))
    reach = longest_for_deletions(k)
    beyond = F.greatest(F.col("x.len"), F.col("y.len")) > reach
    return _meet(x, y, beyond & (F.col("x.u") < F.col("y.u")), scope)


def parameter_free_pairs(
    units: DataFrame, k: int, scope: Scope, shifts: bool, shortest: int, longest: int, below: int | None = None
) -> DataFrame:
    """Candidates that need no chunk length, for strings of ``shortest`` to ``longest`` symbols.

    ``below`` leaves out pairs whose longer string has at least that many.
    """
    reach = longest_for_deletions(k)
    parts = [deletion_pairs(units, k, scope, below)] if shortest <= reach else []
    if longest > max(reach, k) and (below is None or below > max(reach, k) + 1):
        parts.append(segment_pairs(units, k, scope, shifts, below))
    if shortest <= k and k > reach and longest > reach:
        parts.append(tiny_pairs(units, k, scope))
    return reduce(DataFrame.union, parts)


# -- signature keys --------------------------------------------------------------------------


def _with_frequencies(tokens: DataFrame, postings: DataFrame, scope: Scope) -> DataFrame:
    """Attach how many units hold each token; tokens nobody else holds drop out.

    Counting is a partial aggregate, so a token held by most units costs one row per task.
    """
    counted = postings.groupBy(*scope.keys, "key").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    return tokens.join(counted, scope.keys + ["key"])


def _prefix(tokens: DataFrame, hits: Column) -> DataFrame:
    """The rarest tokens of each unit, just enough that every qualifying partner shares one.

    One window group is one string's tokens. Units with fewer than ``hits`` shared tokens have
    no partner and disappear.
    """
    by_rarity = Window.partitionBy("u").orderBy("freq", "key")
    ranked = tokens.withColumn("rank", F.row_number().over(by_rarity))
    ranked = ranked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("u")))
    return ranked.where((F.col("n") >= hits) & (F.col("rank") <= F.col("n") - hits + 1))


def _split_frequent(prefix: DataFrame, most: int, k: int, frequent: int, shortest: int) -> tuple[DataFrame, DataFrame | None]:
    """Take frequent tokens away from strings that deletion keys can serve instead.

    Returns the remaining prefix and the units that lost a token, if any did.
    """
    reach = longest_for_deletions(k)
    if shortest > reach or most <= frequent:
        return prefix, None
    moved = (F.col("freq") > frequent) & (F.col("len") <= reach)
    return prefix.where(~moved), prefix.where(moved).select("u").distinct()


def signature_edit_pairs(
    units: DataFrame, k: int, l: int, scope: Scope, shortest: int, frequent: int | None = None, written: tuple[DataFrame, int] | None = None
) -> DataFrame:
    """Pairs ``(probe, partner)`` whose longer string has more than ``k`` chunks of length ``l``.

    The longer string (the first one on equal length) probes with its fixed-position chunks;
    the partner may hold them at any position. Without ``frequent`` every pair sharing enough
    chunks is among the candidates. With it only related pairs are sure to be: chunks have to be found
    within ``k`` places of their own, as ``k`` edits move them no further, and tokens held by more
    units than that are avoided, by deletion keys or finer chunks, where these propose fewer pairs.
    ``written`` is the prefix, if it is there already, and the holders of its most frequent token.
    """
    first = (F.col("x.len") > F.col("y.len")) | (
        (F.col("x.len") == F.col("y.len")) & (F.col("x.u") < F.col("y.u"))
    )
    condition = first & _near(F.col("x.len"), F.col("y.len"), k) & _alike(units, k)
    if written is None:
        prefix = _edit_prefix(units, k, l, scope, None)
        written = _written_prefix(prefix.drop("pos") if frequent is None else prefix)
    prefix, most = written
    if frequent is None:
        return _meet(prefix, _postings(units, l), condition, scope, most)
    prefix, moved = _split_frequent(prefix, most, k, frequent, shortest)
    parts = [] if moved is None else [deletion_pairs(units, k, scope, only=moved)]
    while True:
        finer = _finer_prefix(units, k, l, scope, prefix, frequent) if most > frequent else None
        kept = prefix if finer is None else prefix.where(F.col("freq") <= frequent)
        parts.append(_meet(_reach(kept, k), _places(units, l, k), condition, scope, most))
        if finer is None:
            return reduce(DataFrame.union, parts)
        prefix, l = finer, l // 2
        most = prefix.agg(F.max("freq")).first()[0] or 0


def _postings(units: DataFrame, l: int) -> DataFrame:
    keys = F.transform(lmer_set("seq", l), lambda s: F.xxhash64(s))
    return units.select(*_carried(units), F.explode(keys).alias("key"))


def _places(units: DataFrame, l: int, k: int) -> DataFrame:
    """Postings with the band of ``2 k + 1`` places an l-mer lies in, once for each band."""
    keys = F.transform(lmers("seq", l), lambda s, p: F.xxhash64(F.xxhash64(s), F.floor(p / (2 * k + 1))))
    return units.select(*_carried(units), F.explode(F.array_distinct(keys)).alias("key"))


def _reach(prefix: DataFrame, k: int) -> DataFrame:
    """A prefix with the bands, two at most, that a chunk moved by up to ``k`` places may lie in."""
    band = lambda place: F.floor(place / (2 * k + 1))
    bands = F.explode(F.sequence(band(F.col("pos") - k), band(F.col("pos") + k)))
    return prefix.withColumn("band", bands).select(*_carried(prefix), F.xxhash64("key", "band").alias("key"))


def _edit_prefix(units: DataFrame, k: int, l: int, scope: Scope, only: DataFrame | None) -> DataFrame:
    """Rarest chunks of the strings that have enough of them, or of those listed in ``only``."""
    probing = units.where(F.col("len") >= l * (k + 1))
    if only is not None:
        probing = probing.join(only, "u", "left_semi")
    n_chunks = F.floor(F.col("len") / l).cast("int")
    probes = probing.select(
        *_carried(units), n_chunks.alias("chunks"), F.posexplode(equal_chunks("seq", l)).alias("pos", "chunk")
    )
    # A text that fills m chunks of the probe stays m rows: hits are counted per chunk.
    probes = probes.select(*_carried(units), "chunks", (F.col("pos") * l).alias("pos"), F.xxhash64("chunk").alias("key"))
    return _prefix(_with_frequencies(probes, _postings(units, l), scope), F.col("chunks") - k)


def _finer_prefix(
    units: DataFrame, k: int, l: int, scope: Scope, prefix: DataFrame, frequent: int
) -> DataFrame | None:
    """Prefixes of half-length chunks for the strings still holding a frequent chunk.

    Half the length means twice the chunks but no more of them lost to ``k`` edits, so a string
    whose popular part covers many chunks gets enough rare ones beside it. Any chunk length
    is complete for the probing string; the finer one is taken if it proposes fewer pairs.
    """
    heavy = prefix.where(F.col("freq") > frequent)
    if l // 2 < MIN_CHUNK or heavy.isEmpty():
        return None
    listed = materialize(heavy.select("u").distinct(), "heavy")
    finer = _edit_prefix(units, k, l // 2, scope, listed)
    finer = materialize(finer.select(*[c for c in PREFIX if c in finer.columns]), "prefix")
    proposed = lambda rows: rows.agg(F.sum("freq")).first()[0] or 0
    return finer if proposed(finer) < proposed(heavy) else None


def signature_hamming_pairs(
    units: DataFrame,
    k: int,
    chunks: Column,
    hits: Column,
    scope: Scope,
    shortest: int,
    long_from: int = 0,
    frequent: int | None = None,
    l: int | None = None,
) -> DataFrame:
    """Pairs sharing enough equal chunks at equal positions.

    ``chunks`` is the array of fixed-position chunks, ``hits`` the number a partner has to share,
    ``long_from`` the least length of the longer string. ``l`` is the chunk length, if there is
    one; strings holding a frequent chunk can then use finer chunks.
    Rarity is one order over all tokens, so the rarest shared token lies in the prefix of both
    sides and only prefixes are shuffled for the join.
    """
    tokens = units.select(*_carried(units), hits.alias("hits"), F.posexplode(chunks).alias("pos", "chunk"))
    tokens = tokens.select(*_carried(units), "hits", F.xxhash64("pos", "chunk").alias("key"))
    prefix, most = _written_prefix(_prefix(_with_frequencies(tokens, tokens, scope), F.col("hits")))
    near = _near(F.col("x.len"), F.col("y.len"), k) & _alike(units, k)
    long_enough = F.greatest(F.col("x.len"), F.col("y.len")) >= long_from
    parts = []
    if frequent is not None and most > frequent:
        prefix, moved = _split_frequent(prefix, most, k, frequent, shortest)
        parts += [] if moved is None else [deletion_pairs(units, k, scope, only=moved)]
        finer = None if l is None else _finer_prefix(units, k, l, scope, prefix, frequent)
        if finer is not None:
            # Both strings of a pair hold the frequent chunk, so the longer one is listed and probes.
            first = (F.col("x.len") > F.col("y.len")) | (
                (F.col("x.len") == F.col("y.len")) & (F.col("x.u") < F.col("y.u"))
            )
            parts.append(_meet(finer, _postings(units, l // 2), first & near, scope))
            prefix = prefix.where(F.col("freq") <= frequent)
    parts.append(_meet(prefix, prefix, near & long_enough & (F.col("x.u") < F.col("y.u")), scope, most))
    return reduce(DataFrame.union, parts)
