"""The thresholded similarity join: candidates, verification, edge list, run metrics."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.functions.distance import bounded_levenshtein, packed_hamming_bounded
from nearkin.functions.encode import DEFAULT_ALPHABET, PACKINGS, SKETCH, chunks_at, equal_chunks, packed_words, packing_of, sketch
from nearkin.operators.profile import entropy, entropy_chunks, profile
from nearkin.plans import candidates as cand
from nearkin.session import materialize

# Members of one group of copies that are expanded together.
COPY_BLOCK = 2000
# Symbols of a partition of distinct strings.
PARTITION_SYMBOLS = 1 << 26
# Length up to which strings are looked at for a start and an end that all have, and distances are measured in the JVM.
SHORT = 256


@dataclass(frozen=True)
class Stats:
    """One row of facts about the input; decides which kinds of keys a join needs."""

    rows: int
    symbols: int
    shortest: int
    longest: int
    packing: str
    # Symbols that all strings start and end with, if none is longer than ``SHORT``.
    start: int = 0
    end: int = 0


@dataclass(frozen=True)
class SimilarityJoin:
    """All pairs of strings within ``k``.

    ``metric`` is ``"edit"`` or ``"hamming"`` (the shorter string counts as padded). ``scope`` is
    ``"all"`` for one collection, ``"within"`` for a self-join inside each sample and
    ``"across"`` for pairs from different samples.

    ``l`` asks for signature filtering with chunks of that length, ``chunks`` (Hamming only) for
    that many entropy-balanced chunks. With neither, candidates come from parameter-free keys.
    The result is the same in all cases. ``strict`` reproduces the habit of reporting nothing
    when fewer than two chunks are guaranteed to survive.

    Identical strings of a sample are joined once; results carry their numbers of copies.
    ``collapse=False`` joins every row on its own.
    """

    df: DataFrame
    k: int
    metric: str = "edit"
    scope: str = "all"
    l: int | None = None
    chunks: int | None = None
    id: str = "seq_id"
    seq: str = "seq"
    sample: str | None = None
    alphabet: str = DEFAULT_ALPHABET
    collapse: bool = True
    strict: bool = False
    frequent: int = cand.FREQUENT_KEY

    def __post_init__(self) -> None:
        if self.k < 0:
            raise ValueError("threshold must not be negative")
        if self.metric not in ("edit", "hamming") or self.scope not in ("all", "within", "across"):
            raise ValueError("unknown metric or scope")
        if self.l is not None and self.l < 1 or self.chunks is not None and self.chunks < 1:
            raise ValueError("chunk length and chunk count must be positive")
        if self.chunks is not None and (self.metric != "hamming" or self.l is not None):
            raise ValueError("a chunk count is for Hamming joins without a chunk length")
        if (self.scope == "all") != (self.sample is None):
            raise ValueError("a sample column goes with the scopes 'within' and 'across'")

    # -- input -------------------------------------------------------------------------------

    @cached_property
    def stats(self) -> Stats:
        n = F.length(self.seq)
        row = self.df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count(self.seq).alias("strings"),
            F.sum(n).alias("symbols"),
            F.min(n).alias("shortest"),
            F.max(n).alias("longest"),
            F.max(packing_of(self.seq)).alias("packing"),
            *[f(F.substring(s, 1, SHORT)).alias(f.__name__ + at) for f in (F.min, F.max) for at, s in (("_start", F.col(self.seq)), ("_end", F.reverse(F.substring(self.seq, -SHORT, SHORT))))],
        ).first()
        if row.rows != row.strings:
            raise ValueError("strings must not be null")
        start = end = 0
        if 0 < (row.longest or 0) <= SHORT:
            start = len(os.path.commonprefix([row.min_start, row.max_start]))
            end = min(row.shortest - start, len(os.path.commonprefix([row.min_end, row.max_end])))
        return Stats(row.rows, row.symbols or 0, row.shortest or 0, row.longest or 0, list(PACKINGS)[row.packing or 0], start, end)

    @cached_property
    def _short(self) -> bool:
        """Whether few enough keys tell all pairs apart by themselves, so that pairs are judged where they meet.

        Symbols that all strings start and end with take no part. Keys then have few holders, copies being one.
        """
        s = self.stats
        if not self.collapse or self.strict or s.longest > SHORT:
            return False
        length = s.longest - s.start - s.end
        if self.metric == "edit":
            return length <= cand.longest_for_deletions(self.k)
        return s.shortest == s.longest and cand.mask_count(length, self.k) <= cand.MAX_DELETION_KEYS

    @property
    def _rows(self) -> DataFrame:
        name = F.lit("") if self.sample is None else F.col(self.sample)
        return self.df.select(name.alias("sample"), F.col(self.id).alias("id"), F.col(self.seq).alias("seq"))

    @cached_property
    def units(self) -> DataFrame:
        """``(u, sample, id, n, seq, len)``, sketches and, where pairs of them are compared, packed words: the strings to join, written once."""
        if self.collapse:
            grouped = self._rows.groupBy("sample", "seq").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        else:
            grouped = self._rows.withColumn("n", F.lit(1).cast("bigint"))
        # Partitions of bounded size, and at least one per core: keys and distances are worth it.
        cores = self.df.sparkSession.sparkContext.defaultParallelism
        grouped = grouped.repartition(max(cores, self.stats.symbols // PARTITION_SYMBOLS))
        identity = F.col("id") if self.sample is None else F.struct("sample", "id")
        sketched = [] if self._short else [sketch("seq").alias("sketch")]
        grouped = grouped.select("*", *sketched)
        words = [packed_words("seq", self.stats.packing).alias("words")] if self._packed else []
        return materialize(
            grouped.select(
                identity.alias("u"),
                "sample",
                "id",
                "n",
                "seq",
                F.length("seq").alias("len"),
                *words,
                *[F.get("sketch", F.lit(i)).alias(c) for i, c in enumerate(SKETCH) if sketched],
            ),
            "units",
        )

    @property
    def _packed(self) -> bool:
        """Whether all pairs have their Hamming distance taken; else the few that need words pack them."""
        return self.metric == "hamming" or self.stats.packing == "dna"

    @cached_property
    def chunk_ends(self) -> list[int]:
        """Ends of the entropy-balanced chunks, one per chunk."""
        ent = entropy(profile(self.df, self.seq, [], self.alphabet))
        return [r.end for r in entropy_chunks(ent, self.chunks).orderBy("chunk").collect()]

    # -- candidates --------------------------------------------------------------------------

    def _chunks(self, seq: Column | str) -> Column:
        if self.chunks is not None:
            return chunks_at(seq, F.array(*[F.lit(e) for e in self.chunk_ends]))
        return equal_chunks(seq, self.l)

    def _hits_needed(self, length: Column | str) -> Column:
        """Chunks of a string that survive ``k`` edits."""
        if self.chunks is not None:
            return F.lit(self.chunks - self.k)
        length = F.col(length) if isinstance(length, str) else length
        return F.floor(length / self.l).cast("int") - self.k

    def candidates(self, complete: bool = True) -> DataFrame:
        """Distinct ``(a, b)`` with ``a < b``, a superset of the result.

        ``complete``: with a signature, all pairs that share enough chunks are among them.
        Otherwise only the related ones are sure to be, which lets frequent chunks be avoided.
        """
        return self._distinct(self._parts(complete))

    @staticmethod
    def _distinct(parts: list[DataFrame]) -> DataFrame:
        return cand.ordered(reduce(DataFrame.union, parts)).repartition("a", "b").distinct()

    def _parts(self, complete: bool, judged: bool = False) -> list[DataFrame]:
        """Tables of pairs that are the candidates together; with ``judged``, some may be of related pairs with copies."""
        frequent = None if complete else self.frequent
        s, k, scope = self.stats, self.k, cand.Scope(self.scope)
        shifts = self.metric == "edit"
        # Sketches rule out pairs that are not related.
        units = self.units.drop(*SKETCH) if complete else self.units
        if self.chunks is not None:
            long_from = 0 if self.chunks > k else s.longest + 1
        elif self.l is not None:
            long_from = self.l * (k + 1)
        else:
            long_from = s.longest + 1
        parts = []
        if long_from <= s.longest:
            if self.metric == "edit" and not complete:
                parts.append(cand.related_edit_pairs(units, k, self.l, scope, s.shortest, frequent, s.rows, judged))
            elif self.metric == "edit":
                parts.append(cand.signature_edit_pairs(units, k, self.l, scope, s.shortest, frequent))
            else:
                parts.append(
                    cand.signature_hamming_pairs(
                        units, k, self._chunks("seq"), self._hits_needed("len"), scope, s.shortest, long_from, frequent, self.l
                    )
                )
        if s.shortest < long_from:
            below = long_from if long_from <= s.longest else None
            parts.append(cand.parameter_free_pairs(units, k, scope, shifts, s.shortest, s.longest, below))
        return parts

    def compared(self, complete: bool = True) -> DataFrame:
        """Candidates with both strings attached and judged.

        Adds ``near`` (Hamming distance within ``k``), ``enough`` (the pair shares the chunks
        that survive ``k`` edits; true without a signature), ``hits`` (how many chunks of the
        longer string it shares) and ``related``. Columns not asked for are not computed.
        """
        return self._compared(self.candidates(complete), complete)

    def _compared(self, pairs: DataFrame, complete: bool) -> DataFrame:
        units = self.units
        if not complete and self.stats.longest > SHORT:
            # Long strings are moved only where a pair needs them.
            pairs = materialize(pairs, "candidates")
            ends = materialize(pairs.select(F.col("a").alias("u")).union(pairs.select(F.col("b").alias("u"))).distinct(), "ends")
            units = materialize(units.join(ends, "u", "left_semi"), "needed")
        if not self._packed:
            units = units.withColumn("words", packed_words("seq", self.stats.packing))
        side = lambda c: units.select(
            F.col("u").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("sample", "id", "n", "seq", "len", "words")]
        )
        pairs = pairs.join(side("a"), "a").join(side("b"), "b")
        near = packed_hamming_bounded("words_a", "words_b", self.k, self.stats.packing) >= 0
        b_probes = F.col("len_b") > F.col("len_a")
        probe = F.when(b_probes, F.col("seq_b")).otherwise(F.col("seq_a"))
        partner = F.when(b_probes, F.col("seq_a")).otherwise(F.col("seq_b"))
        needed, hits, enough = F.lit(0), F.lit(None).cast("int"), F.lit(True)
        if self._signed:
            needed = self._hits_needed(F.greatest("len_a", "len_b"))
            if self.metric == "edit":
                shared = F.filter(self._chunks(probe), lambda c: F.contains(partner, c))
            else:
                shared = F.filter(F.zip_with(self._chunks(probe), self._chunks(partner), lambda p, q: p == q), lambda x: x)
            hits = F.size(shared)
            # k differing symbols touch at most k chunks, so near pairs need no counting.
            enough = F.when(near | (needed <= 0), True).otherwise(hits >= needed)
        related = near
        if self.metric == "edit":
            # Pairs within ``k`` share enough chunks, so the distance alone decides. Where symbols pack
            # well, or Hamming distance is asked for anyway, pairs that it accepts are not measured.
            close = near if complete or self.stats.packing == "dna" else F.lit(False)
            far = lambda c: F.when(~close, F.col(c))
            if self.stats.longest <= SHORT:
                distance = F.levenshtein(far("seq_a"), far("seq_b"), self.k)
            else:
                distance = bounded_levenshtein(far("seq_a"), far("seq_b"), self.k)
            related = close | (F.coalesce(distance, F.lit(-1)) != -1)
        if self.strict and self._signed:
            related = related & (needed > 1)
        return pairs.select("*", near.alias("near"), enough.alias("enough"), hits.alias("hits"), related.alias("related"))

    @property
    def _signed(self) -> bool:
        return self.l is not None or self.chunks is not None

    @cached_property
    def judged(self) -> DataFrame:
        """The outcome of every comparison, written once for :meth:`metrics` and :meth:`edges` after it."""
        names = ["a", "b", "n_a", "n_b", "near", "enough", "related"]
        return materialize(self.compared().select(*names), "judged")

    @cached_property
    def _related(self) -> DataFrame:
        """Related pairs with their copies, written once; of all comparisons if these are there already."""
        names = ["a", "b", "n_a", "n_b"]
        if "judged" in self.__dict__:
            return self.judged.where("related").select(*names)
        return materialize(self._found(), "related")

    def _found(self) -> DataFrame:
        """Related pairs ``(a, b, n_a, n_b)``."""
        if not self._short:
            names = ["a", "b", "n_a", "n_b"]
            parts = self._parts(False, self.metric == "edit" and not self.strict and self.stats.longest <= SHORT)
            found = [p for p in parts if p.columns == names]
            rest = [p for p in parts if p.columns != names]
            if rest:
                found.append(self._compared(self._distinct(rest), False).where("related").select(*names))
            return reduce(DataFrame.union, found)
        s, scope = self.stats, cand.Scope(self.scope)
        core = F.substring("seq", s.start + 1, F.length("seq") - s.start - s.end) if s.start or s.end else F.col("seq")
        units = self.units.select("u", "sample", "n", core.alias("core"))
        if self.metric == "edit":
            return cand.short_edit_pairs(units, self.k, scope)
        return cand.short_hamming_pairs(units, self.k, s.longest - s.start - s.end, scope)

    # -- results -----------------------------------------------------------------------------

    def pairs(self) -> DataFrame:
        """Related pairs of distinct strings.

        ``i``/``j`` are the smallest ids of the two strings, ``n_i``/``n_j`` their copies. The
        ``n`` copies of one string are related to each other as well; listing those pairs is
        left to :meth:`edges`.
        """
        names = {
            "all": [],
            "within": [F.col("a.sample").alias("sample")],
            "across": [F.col("a.sample").alias("sample1"), F.col("b.sample").alias("sample2")],
        }[self.scope]
        own = lambda c: F.col(f"{c}.id") if self.sample else F.col(c)
        return self._found().select(
            *names, own("a").alias("i"), own("b").alias("j"), F.col("n_a").alias("n_i"), F.col("n_b").alias("n_j")
        )

    def edges(self) -> DataFrame:
        """The full edge list over rows, copies included: ``(i, j)`` plus the sample columns.

        Groups of copies are cut into blocks and each pair of blocks is expanded on its own, so
        even one string owning most rows is written out by many tasks. Where the figures of
        :meth:`metrics` are wanted too, ask for them first: both then come from the same comparisons.
        """
        pairs = self._related
        single = self._name_edges(pairs.where("n_a = 1 and n_b = 1").select(self._row("a"), self._row("b")))
        if not self.collapse:
            return single
        pairs = pairs.where("n_a > 1 or n_b > 1")
        if self.scope != "across":
            pairs = pairs.union(self.units.where("n > 1").select("u", "u", "n", "n"))
        blocks = lambda n: F.ceil(F.col(n) / COPY_BLOCK).cast("int")
        spread = pairs.select("a", "b", blocks("n_a").alias("of_a"), blocks("n_b").alias("of_b"))
        spread = spread.withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("of_a") - 1)))
        spread = spread.withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("of_b") - 1)))
        spread = spread.drop("of_a", "of_b")
        member = self._rows.join(self.units.select("sample", "seq", "u", "n"), ["sample", "seq"])
        member = member.select("u", "id", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / COPY_BLOCK)).cast("int").alias("block"))
        key = ["a", "b", "block_a", "block_b"]
        one = lambda c: spread.join(
            member.select(F.col("u").alias(c), F.col("block").alias(f"block_{c}"), F.col("id").alias(f"id_{c}")), [c, f"block_{c}"]
        )
        rows = one("a").join(one("b"), key).where((F.col("a") != F.col("b")) | (F.col("id_a") < F.col("id_b")))
        name = lambda c: F.col(f"{c}.sample") if self.sample else F.lit("")
        copied = rows.select(
            F.struct(name("a").alias("sample"), F.col("id_a").alias("id")).alias("a"),
            F.struct(name("b").alias("sample"), F.col("id_b").alias("id")).alias("b"),
        )
        return single.union(self._name_edges(copied))

    def _row(self, c: str) -> Column:
        whole = F.col(c) if self.sample else F.struct(F.lit("").alias("sample"), F.col(c).alias("id"))
        return whole.alias(c)

    def _name_edges(self, rows: DataFrame) -> DataFrame:
        low, high = F.least("a", "b"), F.greatest("a", "b")
        ends = rows.select(low.alias("a"), high.alias("b"))
        names = {
            "all": [],
            "within": [F.col("a.sample").alias("sample")],
            "across": [F.col("a.sample").alias("sample1"), F.col("b.sample").alias("sample2")],
        }[self.scope]
        return ends.select(*names, F.col("a.id").alias("i"), F.col("b.id").alias("j"))

    def metrics(self) -> DataFrame:
        """One row of run figures, counted over rows (copies weigh in).

        ``comparisons``: pairs that share enough chunks; ``passed_hamming``: those accepted by
        Hamming distance alone; ``edit_comparisons``: the rest; ``related_pairs``. Without a
        signature every candidate is a comparison.
        """
        pairs = self.judged
        weight = F.col("n_a") * F.col("n_b")
        figures = pairs.select(
            F.when(F.col("enough"), weight).otherwise(0).alias("comparisons"),
            F.when(F.col("near"), weight).otherwise(0).alias("passed_hamming"),
            F.when(F.col("related"), weight).otherwise(0).alias("related_pairs"),
        )
        if self.scope != "across":
            same = (F.col("n") * (F.col("n") - 1) / 2).cast("bigint")
            figures = figures.union(self.units.where("n > 1").select(same, same, same))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
        summed = figures.agg(total("comparisons"), total("passed_hamming"), total("related_pairs"))
        return summed.select(
            "comparisons", "passed_hamming", (F.col("comparisons") - F.col("passed_hamming")).alias("edit_comparisons"), "related_pairs"
        )


def filtered_sample_pairs(df: DataFrame, sample: str, seq: str, l: int, k: int) -> DataFrame:
    """How many sample pairs the coincidence filter lets through and how many it stops."""
    from nearkin.operators.index import related_samples

    kept = related_samples(df, sample, seq, l, k).agg(F.count(F.lit(1)).alias("kept"))
    n = df.select(sample).distinct().agg(F.count(F.lit(1)).alias("samples"))
    pairs = (F.col("samples") * (F.col("samples") - 1) / 2).cast("bigint")
    on = F.lit(1).alias("one")
    return kept.select("kept", on).join(n.select("samples", on), "one").select(
        pairs.alias("executed"), (pairs - F.col("kept")).alias("filtered")
    )
