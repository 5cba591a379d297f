
from __future__ import annotations

import importlib
import os
import uuid
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.functions import distance as dist
from nearkin.functions import encode as enc
from nearkin.operators import graph, index, lookup, profile, qgram
from nearkin.plans.join import SimilarityJoin, filtered_sample_pairs
from nearkin.session import shared_dir
from nearkin.sources import fasta
from nearkin.sources.tables import read_table

SMOKE_DIR = "/root/testdata/sf0.001"

Query = Callable[[SparkSession, str], DataFrame]


def _optional(module: str) -> ModuleType | None:
    """A module of the document operators, or None in a copy of the package without them."""
    try:
        return importlib.import_module(module)
    except ModuleNotFoundError as missing:
        if missing.name not in ("nearkin.llm", "nearkin.llm.queries", "corpus_pipeline"):
            raise
        return None


llm = _optional("nearkin.llm.queries")
pipeline = _optional("corpus_pipeline") if llm else None

# Reads derived from a table's key: 64 letters, in families of ten consecutive keys. Member m of
# a family differs from the family's sequence by a substitution (m odd), by a letter dropped and
# one appended (m even), or by a dropped letter only (m divisible by 3).
_DIGITS = "'0123456789abcdef', 'ACGTACGTACGTACGT'"


def _read_sql(key: str, div: str, text: str) -> str:
    family = f"cast({key} {div} 10 as {text})"
    whole = f"translate(md5({family}) || md5({family} || 'x'), {_DIGITS})"
    m = f"cast({key} % 10 as int)"
    left, right = f"substr({whole}, 1, 6 * {m})", f"substr({whole}, 6 * {m} + 2)"
    return (
        f"case when {m} = 0 then {whole} when {m} % 3 = 0 then {left} || {right} "
        f"when {m} % 2 = 1 then {left} || 'A' || {right} else {left} || {right} || 'A' end"
    )


READS = f"reads as (select p_partkey as id, p_brand as sample, {_read_sql('p_partkey', '//', 'varchar')} as seq from part)"
NAMES = "names as (select c_custkey as id, c_mktsegment as sample, c_name as seq from customer)"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, os.path.join(sf, f"{name}.parquet"))


def reads(spark: SparkSession, sf: str) -> DataFrame:
    read = F.expr(_read_sql("p_partkey", "div", "string"))
    return _table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("sample"), read.alias("seq"))


def names(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "customer").selectExpr("c_custkey as id", "c_mktsegment as sample", "c_name as seq")


# -- joins ---------------------------------------------------------------------------------------


def _join(source, k: int, metric: str, **options) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return SimilarityJoin(source(spark, sf), k, metric, id="id", **options).pairs()

    return run


def _urls(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").selectExpr("page_id as id", "url as seq")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").selectExpr("doc_id as id", "text as seq")


def _pairs_sql(source: str, table: str, k: int, metric: str, scope: str = "all") -> str:
    """All pairs by comparing everything, on distinct strings with their copies."""
    by = {"all": "", "within": "sample, ", "across": "sample, "}[scope]
    names_ = {"all": "", "within": "x.sample as sample, ", "across": "x.sample as sample1, y.sample as sample2, "}[scope]
    where = {"all": "x.id < y.id", "within": "x.sample = y.sample and x.id < y.id", "across": "x.sample < y.sample"}[scope]
    if metric == "edit":
        # The length test only spares DuckDB hopeless comparisons.
        near = f"abs(length(x.seq) - length(y.seq)) <= {k} and levenshtein(x.seq, y.seq) <= {k}"
    else:
        width = "greatest(length(x.seq), length(y.seq))::int"
        near = f"hamming(rpad(x.seq, {width}, '%'), rpad(y.seq, {width}, '%')) <= {k}"
    return (
        f"with {source}, u as (select {by}seq, min(id) as id, count(*) as n from {table} group by {by}seq) "
        f"select {names_}x.id as i, y.id as j, x.n as n_i, y.n as n_j from u x join u y on {where} and {near}"
    )


# DuckDB's edit distance counts bytes: each letter outside ASCII becomes one unused code.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_CODES = " || ".join(f"chr({c})" for c in range(1, len(_LETTERS) + 2) if c != 10)
# Of nine pieces of the longer text one is left whole by eight edits.
_DOCUMENTS_SQL = f"""
with u as (select min(doc_id) as id, count(*) as n, translate(text, '{_LETTERS}', {_CODES}) as seq from documents group by text),
p as (select x.id as i, y.id as j, x.n as n_i, y.n as n_j, case when length(x.seq) < length(y.seq) then y.seq else x.seq end as a,
  case when length(x.seq) < length(y.seq) then x.seq else y.seq end as b from u x join u y on x.id < y.id and abs(length(x.seq) - length(y.seq)) <= 8)
select i, j, n_i, n_j from p where case when
  {' or '.join(f"contains(b, substr(a, 1 + length(a) * {m} // 9, length(a) * {m + 1} // 9 - length(a) * {m} // 9))" for m in range(9))}
  then levenshtein(a, b) <= 8 else false end
"""


def _signature(spark: SparkSession, sf: str, metric: str) -> DataFrame:
    join = SimilarityJoin(reads(spark, sf), 3, metric, l=12, id="id", collapse=False)
    return join.compared().where("enough").selectExpr("id_a as i", "id_b as j", "hits")


_LONGER_FIRST = "(length(x.seq) > length(y.seq) or (length(x.seq) = length(y.seq) and x.id < y.id)) and abs(length(x.seq) - length(y.seq)) <= 3"
_CHUNKS = (
    "chunks as (select id, sample, pos, substr(seq, pos * 12 + 1, 12) as chunk "
    "from (select *, unnest(range(0, length(seq) // 12)) as pos from reads))"
)
_LMERS = "lmers as (select distinct id, sample, substr(seq, p, 12) as lmer from (select *, unnest(range(1, length(seq) - 10)) as p from reads))"
_HITS = {
    "edit": "select c.id as a, m.id as b, count(*) as hits from chunks c join lmers m on c.chunk = m.lmer group by all",
    "hamming": "select c.id as a, m.id as b, count(*) as hits from chunks c join chunks m on c.chunk = m.chunk and c.pos = m.pos group by all",
}


def _signature_sql(metric: str, source: str = READS) -> str:
    return (
        f"with {source}, {_CHUNKS}, {_LMERS}, h as ({_HITS[metric]}) "
        "select least(x.id, y.id) as i, greatest(x.id, y.id) as j, h.hits from h join reads x on x.id = h.a "
        f"join reads y on y.id = h.b where {_LONGER_FIRST} and h.hits >= length(x.seq) // 12 - 3"
    )


# The reads behind one chunk that all of them share.
_MOTIF = "ACGTACGTACGT"
HOT_READS = f"plain as (select * from ({READS.removeprefix('reads as (')}), reads as (select id, sample, '{_MOTIF}' || seq as seq from plain)"


def hot_chunk_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = reads(spark, sf).withColumn("seq", F.concat(F.lit(_MOTIF), "seq"))
    join = SimilarityJoin(rows, 3, "edit", l=12, id="id", collapse=False)
    return join.compared().where("enough").selectExpr("id_a as i", "id_b as j", "hits")


def join_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return SimilarityJoin(reads(spark, sf), 3, "edit", l=12, id="id", collapse=False).metrics()


_METRICS_SQL = (
    f"with {READS}, {_CHUNKS}, {_LMERS}, h as ({_HITS['edit']}), c as (select "
    "hamming(rpad(x.seq, 64, '%'), rpad(y.seq, 64, '%')) <= 3 as near, levenshtein(x.seq, y.seq) <= 3 as related "
    f"from h join reads x on x.id = h.a join reads y on y.id = h.b where {_LONGER_FIRST} and h.hits >= length(x.seq) // 12 - 3) "
    "select count(*) as comparisons, count(*) filter (near) as passed_hamming, "
    "count(*) filter (not near) as edit_comparisons, count(*) filter (related) as related_pairs from c"
)


def edge_list(spark: SparkSession, sf: str) -> DataFrame:
    """The reads' edge list, copies included, written as text and read back."""
    edges = SimilarityJoin(reads(spark, sf), 3, "edit", l=12, id="id").edges()
    out = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    fasta.write_pairs(edges, out)
    return spark.read.text(out).select(F.col("value").alias("line"))


# -- signature pieces ------------------------------------------------------------------------------


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    rows = reads(spark, sf)
    probes = index.chunk_rows(rows, enc.equal_chunks("seq", 12), ["id"]).withColumnRenamed("chunk", "lmer")
    return index.ranked_chunks(probes, index.lmer_frequency(rows, "seq", 12), "id", ["lmer"])


_RANKED = (
    f"with {READS}, {_CHUNKS}, {_LMERS}, f as (select lmer, count(*) as freq from lmers group by lmer), "
    "r as (select c.id, c.pos, c.chunk as lmer, f.freq, row_number() over (partition by c.id order by f.freq, c.pos) as rank, "
    "count(*) over (partition by c.id) as n from chunks c join f on f.lmer = c.chunk) "
)


def prefix_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf).select("id", "pos", "lmer", "freq", "rank")


def prefix_filter(spark: SparkSession, sf: str) -> DataFrame:
    return index.rarest_chunks(_ranked(spark, sf), "id", F.lit(2)).select("id", "pos", "lmer", "n")


def prefix_rank_two_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier names' chunks, ranked by how many customer names contain them."""
    probes = index.chunk_rows(_table(spark, sf, "supplier"), enc.equal_chunks("s_name", 3), ["s_suppkey"])
    freq = index.lmer_frequency(_table(spark, sf, "customer"), "c_name", 3)
    ranked = index.ranked_chunks(probes.withColumnRenamed("chunk", "lmer"), freq, "s_suppkey", ["lmer"])
    return ranked.select("s_suppkey", "pos", "lmer", "freq", "rank")


def sample_coincidences(spark: SparkSession, sf: str) -> DataFrame:
    return index.sample_coincidences(reads(spark, sf), "sample", "seq", 12)


def coincidence_filter(spark: SparkSession, sf: str) -> DataFrame:
    return index.related_samples(reads(spark, sf), "sample", "seq", 12, 3)


def coincidence_counters(spark: SparkSession, sf: str) -> DataFrame:
    return filtered_sample_pairs(reads(spark, sf), "sample", "seq", 12, 3)


_COINCIDE = (
    f"with {READS}, {_CHUNKS}, {_LMERS}, k as (select c.sample as sample1, m.sample as sample2, count(distinct c.pos) as coincidences "
    "from (select distinct sample, pos, chunk from chunks) c join (select distinct sample, lmer from lmers) m "
    "on m.lmer = c.chunk and c.sample < m.sample group by all), "
    "kept as (select k.* from k join (select sample, max(length(seq)) // 12 as c from reads group by sample) s "
    "on s.sample = k.sample1 where k.coincidences >= s.c - 3) "
)


# -- l-mers and chunks -------------------------------------------------------------------------------


def lmers(spark: SparkSession, sf: str) -> DataFrame:
    return index.lmer_rows(_table(spark, sf, "pages"), "url", 8, ["page_id"])


def lmer_index(spark: SparkSession, sf: str) -> DataFrame:
    return index.lmer_index(_table(spark, sf, "pages"), "html", 16, ["page_id"])


def distinct_lmers(spark: SparkSession, sf: str) -> DataFrame:
    return index.distinct_lmers(_table(spark, sf, "documents"), "text", 4, ["lang"])


def lmer_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return index.lmer_frequency(_table(spark, sf, "conversations"), "text", 6)


def lmer_codes(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.posexplode(enc.lmer_codes("seq", 11)).alias("pos", "code")
    return reads(spark, sf).select("id", codes)


def equal_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return index.chunk_rows(_table(spark, sf, "documents"), enc.equal_chunks("text", 50), ["doc_id"])


def positional_index(spark: SparkSession, sf: str) -> DataFrame:
    return index.positional_index(names(spark, sf), enc.equal_chunks("seq", 3), ["sample"])


def position_sets(spark: SparkSession, sf: str) -> DataFrame:
    return index.position_sets(names(spark, sf), enc.equal_chunks("seq", 3), ["sample"])


def index_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return index.index_metadata(reads(spark, sf), "seq", 12, ["sample"])


def _cut_sql(table: str, key: str, text: str, size: int, step: int, value: str) -> str:
    last = f"length({text}) // {size}" if step > 1 else f"length({text}) - {size - 1}"
    return (
        f"select {key}, pos, substr({text}, pos * {step} + 1, {size}) as {value} "
        f"from (select *, unnest(range(0, {last})) as pos from {table})"
    )


# -- profiles ----------------------------------------------------------------------------------------


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.profile(reads(spark, sf), "seq", ["sample"])


def position_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(spark, sf).select("sample", "pos", "sym", F.round("freq", 9).alias("freq"))


def position_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return profile.entropy(_profile(spark, sf), ["sample"]).select("sample", "pos", F.round("entropy", 6).alias("entropy"))


def total_entropy(spark: SparkSession, sf: str) -> DataFrame:
    total = profile.total_entropy(profile.entropy(_profile(spark, sf), ["sample"]), ["sample"])
    return total.select("sample", F.round("total_entropy", 6).alias("total_entropy"))


def entropy_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return profile.entropy_chunks(profile.entropy(_profile(spark, sf), ["sample"]), 6, ["sample"])


def major_allele(spark: SparkSession, sf: str) -> DataFrame:
    return profile.major_allele(_profile(spark, sf), ["sample"])


def consensus(spark: SparkSession, sf: str) -> DataFrame:
    return profile.consensus(reads(spark, sf), "seq", ["sample"])


def profile_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Consensus of customer names over digits: ``$`` where a position never holds one."""
    digits = "0123456789"
    return profile.profile_consensus(profile.profile(names(spark, sf), "seq", ["sample"], digits), ["sample"], digits)


def max_length(spark: SparkSession, sf: str) -> DataFrame:
    return profile.max_length(_table(spark, sf, "documents"), "text", ["lang"])


_COUNTS = (
    "cells as (select sample, pos, substr(seq, pos + 1, 1) as sym from (select *, unnest(range(0, length(seq))) as pos from {t})), "
    "totals as (select sample, count(*) as total, max(length(seq)) as width from {t} group by sample), "
    "grid as (select t.sample, t.total, p.pos, d.digit, substr('{a}', d.digit + 1, 1) as sym from totals t, "
    "(select unnest(range(0, (select max(width) from totals))) as pos) p, (select unnest(range(0, {n})) as digit) d where p.pos < t.width), "
    "prof as (select g.sample, g.pos, g.digit::int as digit, g.sym, any_value(g.total) as total, count(c.sym) as cnt, "
    "count(c.sym) / any_value(g.total) as freq "
    "from grid g left join cells c on c.sample = g.sample and c.pos = g.pos and c.sym = g.sym group by all), "
    "ent as (select sample, pos, sum(case when freq < 0.000001 then 0 else -freq * ln(freq) end) as entropy from prof group by all), "
    "major as (select sample, pos, case when max(freq) < 0.001 then -1 else arg_max(digit, cnt * 1000 - digit) end as major from prof group by all)"
)
_READ_PROFILE = f"with {READS}, " + _COUNTS.format(t="reads", a="ACGT", n=4)
_NAME_PROFILE = f"with {NAMES}, " + _COUNTS.format(t="names", a="0123456789", n=10)

_ENTROPY_CHUNKS_SQL = _READ_PROFILE.replace("with ", "with recursive ", 1) + (
    ", h as (select sample, list(entropy order by pos) as e, sum(entropy) as total from ent group by sample), "
    "run as (select sample, e, 0 as stop, 0 as start, 0.0::double as filled, total / 6 as target, 5 as remaining, []::int[] as ends from h "
    "union all select sample, e, case when take then stop + 1 else stop end, case when take then start else stop end, "
    "case when take then filled + e[stop + 1] else 0 end, "
    "case when not take and stop - start = 32 then target + (target - filled) / remaining else target end, "
    "case when take then remaining else remaining - 1 end, case when take then ends else list_append(ends, stop - 1) end "
    "from (select *, stop < len(e) and stop - start < 32 and (e[stop + 1] < 0.000001 or "
    "abs(filled - target + e[stop + 1]) < abs(filled - target)) as take from run where remaining > 0)), "
    "done as (select sample, list_append(ends, len(e)::int - 1) as ends from run where remaining = 0) "
    "select sample, cast(i - 1 as int) as chunk, ends[i] as \"end\" from (select *, unnest(range(1, 7)) as i from done)"
)


# -- scalar functions ----------------------------------------------------------------------------------


def pad(spark: SparkSession, sf: str) -> DataFrame:
    """Part names padded to the longest name."""
    part = _table(spark, sf, "part").select("p_partkey", "p_name", F.lit(1).alias("one"))
    longest = part.groupBy("one").agg(F.max(F.length("p_name")).alias("width"))
    return part.join(longest, "one").select("p_partkey", enc.pad_right("p_name", F.col("width")).alias("padded"))


def letter_digit(spark: SparkSession, sf: str) -> DataFrame:
    letters = _table(spark, sf, "pages").select("page_id", F.posexplode(F.split("url", "")).alias("pos", "letter"))
    return letters.select("page_id", "pos", enc.letter_to_digit("letter", "abcdefghijklmnopqrstuvwxyz").alias("digit"))


def digit_letter(spark: SparkSession, sf: str) -> DataFrame:
    items = _table(spark, sf, "lineitem")
    return items.select("l_orderkey", "l_linenumber", enc.digit_to_letter(F.col("l_linenumber") - 2).alias("letter"))


def reverse_read(spark: SparkSession, sf: str) -> DataFrame:
    return reads(spark, sf).select("id", F.reverse("seq").alias("seq"))


def union_concat(spark: SparkSession, sf: str) -> DataFrame:
    """Two collections concatenated into one sample."""
    customers = _table(spark, sf, "customer").selectExpr("0 as file", "c_custkey as id", "c_name as seq")
    return customers.union(_table(spark, sf, "supplier").selectExpr("1 as file", "s_suppkey as id", "s_name as seq"))


def _neighbours(table: str, key: str, text: str, value: Callable, name: str) -> Query:
    """A measure between the strings of consecutive keys."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _table(spark, sf, table)
        here = rows.select(F.col(key), F.col(text).alias("x"))
        there = rows.select((F.col(key) - 1).alias(key), F.col(text).alias("y"))
        return here.join(there, key).select(key, value("x", "y").alias(name))

    return run


def _neighbours_sql(table: str, key: str, text: str, value: str, name: str) -> str:
    return f"select {key}, {value} as {name} from (select a.{key}, a.{text} as x, b.{text} as y from {table} a join {table} b on b.{key} = a.{key} + 1)"


_WIDTH = "greatest(length(x), length(y))::int"
_PADDED = f"hamming(rpad(x, {_WIDTH}, '%'), rpad(y, {_WIDTH}, '%'))"


# -- q-grams, graph, lookup, FASTA -------------------------------------------------------------------------


def qgram_profile(spark: SparkSession, sf: str) -> DataFrame:
    return qgram.qgram_profile(_table(spark, sf, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("key"), "text"), "key", "text").select(
        "key.conv_id", "key.turn", "gram", "cnt"
    )


def qgram_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Shared 3-grams of each document and the next one, over whole texts."""
    docs = _table(spark, sf, "documents")
    pairs = docs.select(F.col("doc_id").alias("x"), (F.col("doc_id") + 1).alias("y"))
    pairs = pairs.join(docs.select(F.col("doc_id").alias("y")), "y", "left_semi").select("x", "y")
    return qgram.text_similarity(pairs, "x", "y", docs, "doc_id", "text")


_GRAMS = (
    "select {k}, substr(t, p, 3) as gram, count(*) as cnt from (select *, unnest(range(1, length(t) - 1)) as p "
    "from (select {k}, regexp_replace(text, '\\s+', ' ', 'g') as t from {t})) group by all"
)


def components(spark: SparkSession, sf: str) -> DataFrame:
    rows = reads(spark, sf)
    edges = SimilarityJoin(rows, 3, "edit", l=12, id="id", collapse=False).edges()
    return graph.connected_components(rows.select("id"), edges)


def cliques(spark: SparkSession, sf: str) -> DataFrame:
    """Maximal sets of customer names that differ pairwise in one place."""
    edges = SimilarityJoin(names(spark, sf), 1, "hamming", l=2, id="id").edges()
    return graph.maximal_cliques(edges).select(F.array_join("clique", " ").alias("clique"))


def floor_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Where 25 falls among the distinct line quantities of each order."""
    return lookup.floor_index_by(_table(spark, sf, "lineitem"), "l_orderkey", "l_quantity", F.lit(25))


def floor_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's next lower balance among the suppliers of the nation."""
    left = _table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    right = _table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), "s_acctbal")
    return lookup.floor_join(left, right, ["nation"], "c_acctbal", "s_acctbal").select("c_custkey", "floor")


def index_and_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """l-mers with their frequencies, and each sample's consensus with its length."""
    frequencies, called = profile.index_and_consensus(reads(spark, sf), "seq", 12, ["sample"])
    whole = called.select("sample", F.col("consensus").alias("value"), F.length("consensus").cast("bigint").alias("n"))
    return frequencies.select("sample", F.col("lmer").alias("value"), F.col("freq").alias("n")).unionByName(whole)


def fasta_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Reads written as FASTA in key order and read back as one sample."""
    ordered = reads(spark, sf).repartitionByRange("id").sortWithinPartitions("id")
    out = f"{shared_dir(spark)}/reads-{uuid.uuid4().hex}"
    fasta.write_fasta(ordered, out, "id", "seq")
    return fasta.read_fasta(spark, out).select("seq_id", "header", "seq")


def fasta_reverse(spark: SparkSession, sf: str) -> DataFrame:
    """The same file read backwards, symbol by symbol."""
    out = f"{shared_dir(spark)}/reads-{uuid.uuid4().hex}"
    fasta.write_fasta(reads(spark, sf).repartitionByRange("id").sortWithinPartitions("id"), out, "id", "seq")
    return fasta.read_fasta(spark, out, reverse=True).select("seq_id", "header", "seq")


def fasta_blank_separated(spark: SparkSession, sf: str) -> DataFrame:
    """Reads written without headers, in lines of 20 letters and blank lines between them, and read back by lines."""
    lines = F.concat(F.regexp_replace("seq", "(.{20})(?=.)", "$1\n"), F.lit("\n"))
    out = f"{shared_dir(spark)}/reads-{uuid.uuid4().hex}"
    reads(spark, sf).repartitionByRange("id").sortWithinPartitions("id").select(lines).write.text(out)
    return fasta.read_fasta(spark, out, cut="line").select("seq_id", "header", "seq")


def fasta_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Reads written to a folder per brand and read back as one sample per folder."""
    brand = F.regexp_replace("sample", "[^0-9]", "")
    lines = reads(spark, sf).select("id", brand.alias("brand"), F.concat(F.lit(">"), "id", F.lit("\n"), "seq").alias("value"))
    out = f"{shared_dir(spark)}/folders-{uuid.uuid4().hex}"
    lines.repartition("brand").sortWithinPartitions("brand", "id").select("brand", "value").write.partitionBy("brand").text(out)
    return fasta.read_fasta(spark, out, layout="folder").select("sample", "seq_id", "header", "seq")


def pair_sink_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The edge list across samples, written over an earlier one and read back."""
    edges = SimilarityJoin(reads(spark, sf), 3, "edit", scope="across", l=12, id="id", sample="sample").edges()
    out = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    fasta.write_pairs(edges.withColumn("j", F.col("j") + 1), out)
    fasta.write_pairs(edges, out)
    return spark.read.text(out).select("sample1", "sample2", F.col("value").alias("line"))


# -- contract ------------------------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Edit-distance self-join of the reads derived from the parts table."""
    return queries()["edit_self_join"](spark, SMOKE_DIR)


def queries() -> dict[str, Query]:
    added = llm.queries() if llm else {}
    if pipeline:
        added["pipeline"] = pipeline.run
    return added | {
        "edit_self_join": _join(reads, 3, "edit", l=12),
        "hamming_self_join": _join(names, 1, "hamming", l=2),
        "hamming_entropy_join": _join(reads, 3, "hamming", chunks=6),
        "edit_within_samples": _join(reads, 3, "edit", l=12, scope="within", sample="sample"),
        "edit_cross_join": _join(reads, 3, "edit", l=12, scope="across", sample="sample"),
        "hamming_cross_join": _join(names, 1, "hamming", l=2, scope="across", sample="sample"),
        "brute_edit_self_join": _join(names, 1, "edit"),
        "brute_hamming_self_join": _join(names, 2, "hamming"),
        "brute_edit_cross_join": _join(names, 1, "edit", scope="across", sample="sample"),
        "brute_hamming_cross_join": _join(reads, 3, "hamming", scope="across", sample="sample"),
        "url_edit_join": _join(_urls, 4, "edit", l=5),
        "document_edit_join": _join(_texts, 8, "edit", l=64),
        "signature_candidates": lambda spark, sf: _signature(spark, sf, "edit"),
        "signature_hamming_candidates": lambda spark, sf: _signature(spark, sf, "hamming"),
        "hot_chunk_join": hot_chunk_join,
        "join_metrics": join_metrics,
        "edge_list": edge_list,
        "prefix_rank": prefix_rank,
        "prefix_filter": prefix_filter,
        "prefix_rank_two_samples": prefix_rank_two_samples,
        "sample_coincidences": sample_coincidences,
        "coincidence_filter": coincidence_filter,
        "coincidence_counters": coincidence_counters,
        "lmers": lmers,
        "lmer_index": lmer_index,
        "distinct_lmers": distinct_lmers,
        "lmer_frequency": lmer_frequency,
        "lmer_codes": lmer_codes,
        "equal_chunks": equal_chunks,
        "positional_index": positional_index,
        "position_sets": position_sets,
        "index_metadata": index_metadata,
        "position_profile": position_profile,
        "position_entropy": position_entropy,
        "total_entropy": total_entropy,
        "entropy_chunks": entropy_chunks,
        "major_allele": major_allele,
        "consensus": consensus,
        "profile_consensus": profile_consensus,
        "max_length": max_length,
        "pad": pad,
        "letter_digit": letter_digit,
        "digit_letter": digit_letter,
        "reverse_read": reverse_read,
        "union_concat": union_concat,
        "hamming": _neighbours("customer", "c_custkey", "c_name", dist.hamming, "d"),
        "hamming_bounded": _neighbours("supplier", "s_suppkey", "s_name", lambda x, y: dist.hamming_bounded(x, y, 1), "d"),
        "padded_hamming": _neighbours("pages", "page_id", "url", dist.padded_hamming, "d"),
        "levenshtein": _neighbours("pages", "page_id", "url", dist.levenshtein, "d"),
        "levenshtein_bounded": _neighbours("part", "p_partkey", "p_name", lambda x, y: dist.levenshtein_bounded(x, y, 4), "d"),
        "qgram_profile": qgram_profile,
        "qgram_similarity": qgram_similarity,
        "components": components,
        "cliques": cliques,
        "floor_lookup": floor_lookup,
        "floor_join": floor_join,
        "index_and_consensus": index_and_consensus,
        "fasta_blank_separated": fasta_blank_separated,
        "fasta_folders": fasta_folders,
        "fasta_reverse": fasta_reverse,
        "fasta_round_trip": fasta_round_trip,
        "pair_sink_samples": pair_sink_samples,
    }


def oracle_sql() -> dict[str, str]:
    added = llm.oracle_sql() if llm else {}
    if pipeline and pipeline.ORACLE_SQL:
        added["pipeline"] = pipeline.ORACLE_SQL
    return added | {
        "edit_self_join": _pairs_sql(READS, "reads", 3, "edit"),
        "hamming_self_join": _pairs_sql(NAMES, "names", 1, "hamming"),
        "hamming_entropy_join": _pairs_sql(READS, "reads", 3, "hamming"),
        "edit_within_samples": _pairs_sql(READS, "reads", 3, "edit", "within"),
        "edit_cross_join": _pairs_sql(READS, "reads", 3, "edit", "across"),
        "hamming_cross_join": _pairs_sql(NAMES, "names", 1, "hamming", "across"),
        "brute_edit_self_join": _pairs_sql(NAMES, "names", 1, "edit"),
        "brute_hamming_self_join": _pairs_sql(NAMES, "names", 2, "hamming"),
        "brute_edit_cross_join": _pairs_sql(NAMES, "names", 1, "edit", "across"),
        "brute_hamming_cross_join": _pairs_sql(READS, "reads", 3, "hamming", "across"),
        "url_edit_join": _pairs_sql("urls as (select page_id as id, url as seq from pages)", "urls", 4, "edit"),
        "signature_candidates": _signature_sql("edit"),
        "signature_hamming_candidates": _signature_sql("hamming"),
        "hot_chunk_join": _signature_sql("edit", HOT_READS),
        "join_metrics": _METRICS_SQL,
        "edge_list": f"with {READS} select x.id || ' ' || y.id as line from reads x join reads y on x.id < y.id and levenshtein(x.seq, y.seq) <= 3",
        "prefix_rank": _RANKED + "select id, pos, lmer, freq, rank from r",
        "prefix_filter": _RANKED + "select id, pos, lmer, n from r where rank <= n - 2 + 1",
        "prefix_rank_two_samples": (
            f"with c as ({_cut_sql('supplier', 's_suppkey', 's_name', 3, 3, 'lmer')}), f as (select lmer, count(*) as freq from "
            f"(select distinct c_custkey, lmer from ({_cut_sql('customer', 'c_custkey', 'c_name', 3, 1, 'lmer')})) group by lmer) "
            "select s_suppkey, pos, lmer, freq, row_number() over (partition by s_suppkey order by freq, pos) as rank from c join f using (lmer)"
        ),
        "sample_coincidences": _COINCIDE + "select * from k",
        "coincidence_filter": _COINCIDE + "select * from kept",
        "coincidence_counters": _COINCIDE
        + "select n * (n - 1) // 2 as executed, n * (n - 1) // 2 - (select count(*) from kept) as filtered from (select count(distinct sample) as n from reads)",
        "lmers": _cut_sql("pages", "page_id", "url", 8, 1, "lmer"),
        "lmer_index": f"select distinct page_id, lmer from ({_cut_sql('pages', 'page_id', 'html', 16, 1, 'lmer')})",
        "distinct_lmers": f"select distinct lang, lmer from ({_cut_sql('documents', 'lang', 'text', 4, 1, 'lmer')})",
        "lmer_frequency": (
            "select lmer, count(*) as freq from (select distinct conv_id, turn, substr(text, p, 6) as lmer from "
            "(select *, unnest(range(1, length(text) - 4)) as p from conversations)) group by lmer"
        ),
        "lmer_codes": (
            f"with {READS} select id, pos, cast(list_sum(list_transform(range(0, 11), lambda i: "
            "(instr('ACGT', substr(seq, pos + 1 + i, 1)) - 1) * (1::bigint << (2 * (10 - i))))) as bigint) as code "
            "from (select *, unnest(range(0, length(seq) - 10)) as pos from reads)"
        ),
        "equal_chunks": _cut_sql("documents", "doc_id", "text", 50, 50, "chunk"),
        "positional_index": f"with {NAMES} select sample, pos, chunk, count(*) as freq from ({_cut_sql('names', 'sample', 'seq', 3, 3, 'chunk')}) group by all",
        "position_sets": f"with {NAMES} select distinct sample, pos, chunk from ({_cut_sql('names', 'sample', 'seq', 3, 3, 'chunk')})",
        "index_metadata": (
            f"with {READS} select sample, count(*) as sequences, max(length(seq)) as sequences_length, "
            "max(length(seq)) // 12 as chunks_count from reads group by sample"
        ),
        "position_profile": _READ_PROFILE + " select sample, pos, sym, round(freq, 9) as freq from prof",
        "position_entropy": _READ_PROFILE + " select sample, pos, round(entropy, 6) as entropy from ent",
        "total_entropy": _READ_PROFILE + " select sample, round(sum(entropy), 6) as total_entropy from ent group by sample",
        "entropy_chunks": _ENTROPY_CHUNKS_SQL,
        "major_allele": _READ_PROFILE + " select sample, pos, major from major",
        "consensus": _READ_PROFILE + " select sample, string_agg(substr('ACGT', major + 1, 1), '' order by pos) as consensus from major group by sample",
        "profile_consensus": _NAME_PROFILE
        + " select sample, string_agg(case when major < 0 then '$' else substr('0123456789', major + 1, 1) end, '' order by pos) as consensus from major group by sample",
        "max_length": "select lang, max(length(text)) as max_length from documents group by lang",
        "pad": "select p_partkey, rpad(p_name, (select max(length(p_name)) from part)::int, '%') as padded from part",
        "letter_digit": (
            "select page_id, pos, instr('abcdefghijklmnopqrstuvwxyz', substr(url, pos + 1, 1)) - 1 as digit "
            "from (select *, unnest(range(0, length(url))) as pos from pages)"
        ),
        "digit_letter": (
            "select l_orderkey, l_linenumber, case when l_linenumber between 2 and 6 then substr('ACGT-', l_linenumber - 1, 1) else '_' end as letter from lineitem"
        ),
        "reverse_read": f"with {READS} select id, reverse(seq) as seq from reads",
        "union_concat": "select 0 as file, c_custkey as id, c_name as seq from customer union all select 1, s_suppkey, s_name from supplier",
        "hamming": _neighbours_sql("customer", "c_custkey", "c_name", "hamming(x, y)", "d"),
        "hamming_bounded": _neighbours_sql("supplier", "s_suppkey", "s_name", "case when hamming(x, y) <= 1 then hamming(x, y) else -1 end", "d"),
        "padded_hamming": _neighbours_sql("pages", "page_id", "url", _PADDED, "d"),
        "levenshtein": _neighbours_sql("pages", "page_id", "url", "levenshtein(x, y)", "d"),
        "levenshtein_bounded": _neighbours_sql("part", "p_partkey", "p_name", "case when levenshtein(x, y) <= 4 then levenshtein(x, y) else -1 end", "d"),
        "qgram_profile": _GRAMS.format(k="conv_id, turn", t="conversations"),
        "qgram_similarity": (
            f"with g as ({_GRAMS.format(k='doc_id', t='documents')}), p as (select a.doc_id as x, b.doc_id as y from documents a join documents b on b.doc_id = a.doc_id + 1), "
            "s as (select a.doc_id as x, sum(least(a.cnt, b.cnt)) as s from g a join g b on b.doc_id = a.doc_id + 1 and a.gram = b.gram group by all) "
            "select p.x, p.y, coalesce(s.s, 0)::int as similarity from p left join s using (x)"
        ),
        "components": (
            f"with recursive {READS}, half as materialized (select x.id as i, y.id as j from reads x join reads y on x.id < y.id and levenshtein(x.seq, y.seq) <= 3), "
            "e as materialized (select i, j from half union all select j, i from half), "
            "r as (select id as vertex, id as seen from reads union select r.vertex, e.j from r join e on e.i = r.seen) "
            "select vertex, dense_rank() over (order by root) as component from (select vertex, min(seen) as root from r group by vertex)"
        ),
        # Strings pairwise one substitution apart all differ in the same place.
        "cliques": (
            "select string_agg(c_custkey, ' ' order by c_custkey) as clique from "
            "(select c_custkey, p, substr(c_name, 1, p - 1) || '?' || substr(c_name, p + 1) as masked "
            "from (select *, unnest(range(1, length(c_name) + 1)) as p from customer)) group by p, masked having count(*) > 1"
        ),
        "floor_join": (
            "select c_custkey, max(s_acctbal) as floor from customer left join supplier on s_nationkey = c_nationkey and s_acctbal <= c_acctbal group by c_custkey"
        ),
        "index_and_consensus": (
            _READ_PROFILE + " select sample, lmer as value, count(*) as n from (select distinct sample, id, substr(seq, pos + 1, 12) as lmer "
            "from (select *, unnest(range(0, length(seq) - 11)) as pos from reads)) group by all union all "
            "select sample, string_agg(substr('ACGT', major + 1, 1), '' order by pos), count(*) from major group by sample"
        ),
        "floor_lookup": (
            "select l_orderkey, greatest(count(*) filter (l_quantity <= 25) - 1, 0)::int as floor_index "
            "from (select distinct l_orderkey, l_quantity from lineitem) group by l_orderkey"
        ),
        "document_edit_join": _DOCUMENTS_SQL,
        "fasta_blank_separated": f"with {READS} select row_number() over (order by id) - 1 as seq_id, cast(null as varchar) as header, seq from reads",
        "fasta_folders": (
            f"with {READS} select 'brand=' || regexp_replace(sample, '[^0-9]', '', 'g') as sample, "
            "row_number() over (partition by sample order by id) - 1 as seq_id, cast(id as varchar) as header, seq from reads"
        ),
        "fasta_reverse": f"with {READS} select row_number() over (order by id) - 1 as seq_id, cast(id as varchar) as header, reverse(seq) as seq from reads",
        "pair_sink_samples": (
            f"with {READS} select x.sample as sample1, y.sample as sample2, x.id || ' ' || y.id as line from reads x join reads y "
            "on x.sample < y.sample and abs(length(x.seq) - length(y.seq)) <= 3 and levenshtein(x.seq, y.seq) <= 3"
        ),
        "fasta_round_trip": f"with {READS} select row_number() over (order by id) - 1 as seq_id, cast(id as varchar) as header, seq from reads",
    }
