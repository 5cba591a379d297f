"""URL filter: host and path rules first, then a path-template tree per host.

The tree is built level by level over counts of distinct ``(host, path)``. At each node of a host's
tree the next segment is kept if it is frequent there or its labels differ from its siblings'; other
segments become a wildcard by shape (number, hexadecimal, date, word, mixed). Kept branches are then
merged by labelled purity: no two branches of a class differ significantly. The templates
at the end are rejected if their purity, smoothed towards the overall one, is low.

All steps are grouped counts and joins of counts; a host with a third of all pages is reduced
before the shuffle, and no step gathers a host's paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.session import discard, materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Segments looked at one by one; what follows is one wildcard where no page of the node is labelled.
DEPTH = 8
# A segment is kept if it has so many pages and so large a share of its node.
MIN_PAGES = 5
MIN_SHARE = 0.01
# Standard errors by which a branch must differ from its siblings to count as different.
APART = 2.5
# Labelled pages that the overall purity counts for in a template, and the purity to pass.
PRIOR = 10.0
PURITY = 0.5


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the path, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = rule.fits(host, path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _shape(segment: Column) -> Column:
    return (
        F.when(segment.rlike(r"\A[0-9]+\z"), "{number}")
        .when(segment.rlike(r"\A[0-9]{4}-[0-9]{2}(-[0-9]{2})?\z"), "{date}")
        .when(segment.rlike(r"\A[0-9a-fA-F-]{8,}\z"), "{hex}")
        .when(segment.rlike(r"\A[0-9]+\.[A-Za-z0-9]+\z"), F.concat(F.lit("{number}"), F.regexp_extract(segment, r"(\.[A-Za-z0-9]+)\z", 1)))
        .when(segment.rlike(r"\A\p{L}+\z"), "{word}")
        .otherwise("{mixed}")
    )


def _apart(labelled: Column, good: Column, other: Column, other_good: Column, base: float) -> Column:
    """Two-proportion test; null if one side has no label."""
    pooled = (good + other_good + PRIOR * base) / (labelled + other + PRIOR)
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), labelled) + F.try_divide(F.lit(1), other)))
    return F.abs(F.try_divide(good, labelled) - F.try_divide(other_good, other)) > APART * error


def _classes(kept: DataFrame, base: float) -> DataFrame:
    """``host, template, segment, name``: a node's labelled branches by purity, cut where one differs from any of its class."""
    member = "struct<purity:double,labelled:bigint,good:bigint,segment:string>"
    branches = F.array_sort(F.collect_list(F.struct((F.col("good") / F.col("labelled")).alias("purity"), "labelled", "good", "segment")))
    start = F.struct(F.lit(0).alias("rank"), F.array().cast(f"array<{member}>").alias("members"), F.array().cast("array<struct<segment:string,rank:int>>").alias("done"))

    def step(state: Column, x: Column) -> Column:
        cut = F.exists(state["members"], lambda m: F.coalesce(_apart(x["labelled"], x["good"], m["labelled"], m["good"], base), F.lit(False)))
        rank = state["rank"] + cut.cast("int")
        members = F.when(cut, F.array(x)).otherwise(F.concat(state["members"], F.array(x)))
        done = F.concat(state["done"], F.array(F.struct(x["segment"].alias("segment"), rank.alias("rank"))))
        return F.struct(rank.alias("rank"), members.alias("members"), done.alias("done"))

    nodes = kept.where("labelled > 0").groupBy("host", "template").agg(branches.alias("branches"))
    ranked = nodes.select("host", "template", F.aggregate("branches", start, step).alias("r"))
    rows = ranked.select("host", "template", F.col("r.rank").alias("top"), F.explode("r.done").alias("d"))
    rank, top = F.col("d.rank"), F.col("top")
    between = F.concat(F.lit("{branch "), rank.cast("string"), F.lit("}"))
    name = F.when(top == 0, "{branch}").when(rank == 0, "{poorer}").when(rank == top, "{purer}").otherwise(between)
    return rows.select("host", "template", F.col("d.segment").alias("segment"), name.alias("class"))


def _grow(paths: DataFrame, level: int, base: float) -> DataFrame:
    """Extend ``template`` by the segment of this level."""
    ended = F.size("segments") <= level
    going = paths.where(~ended).withColumn("segment", F.get("segments", F.lit(level)))
    node = ["host", "template"]
    branch = going.groupBy(*node, "segment").agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "good")])
    branch = materialize(branch, "url-branches")
    # Written, so that the join is one of plain tables and a node of many branches can be split.
    whole = materialize(branch.groupBy(*node).agg(*[F.sum(c).alias(f"all_{c}") for c in ("pages", "labelled", "good")]), "url-nodes")
    frequent = (F.col("pages") >= MIN_PAGES) & (F.col("pages") >= MIN_SHARE * F.col("all_pages"))
    rest, rest_good = F.col("all_labelled") - F.col("labelled"), F.col("all_good") - F.col("good")
    # A small share of the node is enough if the labels say that the branch is another kind.
    differs = (F.col("labelled") >= MIN_PAGES) & _apart(F.col("labelled"), F.col("good"), rest, rest_good, base)
    kept = frequent | F.coalesce(differs, F.lit(False))
    facts = materialize(branch.join(whole, node).withColumn("kept", kept), "url-facts")
    classes = materialize(_classes(facts.where("kept"), base), "url-classes")
    name = F.when(F.col("kept"), F.coalesce("class", F.lit("{branch}"))).otherwise(_shape(F.col("segment")))
    if level >= DEPTH:
        name = F.when(F.col("all_labelled") > 0, name).otherwise("{rest}")
    names = facts.join(classes, [*node, "segment"], "left").select(*node, "segment", name.alias("name"))
    grown = going.join(names, [*node, "segment"]).withColumn("template", F.concat("template", F.lit("/"), "name"))
    # What follows the wildcard for the rest is part of it.
    grown = grown.withColumn("segments", F.when(F.col("name") == "{rest}", F.slice("segments", 1, level + 1)).otherwise(F.col("segments")))
    return grown.select(*paths.columns).unionByName(paths.where(ended))


def templates(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``host, path, template`` for every distinct host and path, and the templates' judgement.

    ``urls`` has ``host, path, label`` (1 good, 0 bad, null unknown). The second table has ``host,
    template, pages, labelled, purity, rejected``.
    """
    counts = urls.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("pages"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).cast("bigint").alias("good")
    )
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    paths = materialize(counts.withColumn("segments", segments).withColumn("template", F.lit("")), "url-paths")
    facts = paths.agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"), F.max(F.size("segments")).alias("depth"), F.max(F.when(F.col("labelled") > 0, F.size("segments"))).alias("known")).first()
    base = (facts["good"] or 0) / facts["labelled"] if facts["labelled"] else 1.0
    for level in range(min(facts["depth"] or 0, max(facts["known"] or 0, DEPTH) + 1)):
        grown = materialize(_grow(paths, level, base), "url-paths")
        discard(paths)
        paths = grown
    total = paths.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "good")])
    purity = (F.col("good") + PRIOR * base) / (F.col("labelled") + PRIOR)
    judged = total.select("host", "template", "pages", "labelled", purity.alias("purity"), (purity < PURITY).alias("rejected"))
    return paths.select("host", "path", "template"), materialize(judged, "url-templates")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row of ``pages``.

    ``labels`` has ``page_id`` and ``label`` (1 good, 0 bad; of several the least counts). The longest
    fitting rule decides, else the template: ``block`` if it is rejected. A url that is null or has no
    ``://`` has an empty host and path, a template of its own kind. Repeated rows are judged alike;
    a null ``page_id`` is passed on and has no label; an empty table gives no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(F.col("page_id").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = materialize(rows, "url-rows")
    known = labels.where("label is not null").groupBy("page_id").agg(F.min("label").alias("label"))
    paths, judged = templates(rows.join(known, "page_id", "left").select("host", "path", "label"))
    found = paths.join(judged, ["host", "template"]).select("host", "path", "template", "purity", "rejected")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("rejected"), "block").otherwise("allow")
    return rows.join(found, ["host", "path"]).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity")
