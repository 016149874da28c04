"""URL filters: rules first, then a tree of path templates per host.

Pages that a rule decides are labelled by it. All paths of a host form a tree of
segments. Segments that vary are generalised to ``*``: those that look generated,
and rare ones below a node with many children. Siblings whose labels do not
differ significantly are merged, and a template is rejected if the smoothed share
of blocked pages among its labelled ones reaches a threshold; the share is drawn
towards that of the host, and the host's towards that of all pages. A page that no
rule fits gets its template's verdict.

The tree is built on one row per host and generalised path, aggregated on the map
side first; pages only come back for a join on that key, which adaptive execution
splits where one template has most of the pages.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmesh.llm.columns import ascii_lower
from driftmesh.storage import materialize

#: (verdict, host and path beginning)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in small letters and path; both empty for null and for no ``://``."""
    whole = F.coalesce(url, F.lit(""))
    pattern = "://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(whole, pattern, 1)), F.regexp_extract(whole, pattern, 2)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def path_shape(path: Column) -> Column:
    """The path's segments, with those that look generated as ``*``."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/+")
    ending = r"(\.[A-Za-z]{2,5})?$"
    odd = lambda s: F.when(s.rlike(r"[0-9]") | (F.char_length(s) > 24), F.concat(F.lit("*"), F.regexp_extract(s, ending, 1))).otherwise(s)
    return F.transform(parts, odd)


def _steps(tree: DataFrame, *counts: str) -> DataFrame:
    """A row per segment of ``way``: id, host, node, pos, child and the counts.

    node stands for all segments before: sums of hashes of the segments with their
    places, which one pass over a way gives, however long it is. Only segments from
    ``begin`` on are returned.
    """
    steps = tree.select("id", "host", "begin", *counts, F.posexplode("way").alias("pos", "child"))
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # 40 bits each, so that the sums of eight million segments fit
    hashes = [F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "pos", "child"), 24)).over(before) for seed in (1, 2)]
    node = F.struct(*[F.coalesce(h, F.lit(0)).alias(f"h{k}") for k, h in enumerate(hashes)])
    return steps.withColumn("node", node).filter(F.col("pos") >= F.col("begin")).drop("begin")


def _renamed(tree: DataFrame, choose: Callable[[DataFrame], tuple[DataFrame, DataFrame]], counts: Sequence[str], name: str) -> DataFrame:
    """``tree`` (id, host, way and others) after segments of its ways were renamed from the root on.

    ``choose`` gets the children of all nodes (host, pos, node, child and sums of the
    counts), and returns the nodes that rename children and the new names, of children
    that get one. A renaming joins what is below, so the first such node of each way
    is worked off, all in one round, and then the next. What is above it never changes
    again, so this is the same as going down level by level, but levels without such a
    node take no round, and a way without one is done.
    """
    key = ["host", "pos", "node"]
    made, done = tree.withColumn("begin", F.lit(0)), []
    while True:
        steps = _steps(made, *counts)
        children = steps.groupBy(*key, "child").agg(*[F.sum(c).alias(c) for c in counts])
        nodes, names = choose(children)
        met = steps.join(nodes.select(*key), key).groupBy("id").agg(F.min_by(F.struct(*key, "child"), "pos").alias("met"))
        named = met.select("id", "met.*").join(names.select(*key, "child", "new"), [*key, "child"], "left").select("id", "pos", "new")
        joined = made.join(named, "id", "left")
        way = F.transform("way", lambda s, i: F.when((i == F.col("pos")) & F.col("new").isNotNull(), F.col("new")).otherwise(s))
        joined = joined.withColumn("way", way).withColumn("begin", F.col("pos") + 1).drop("pos", "new")
        joined = materialize(joined, name)
        done.append(joined.filter("begin is null").drop("begin"))
        made = joined.filter("begin < size(way)")
        # nothing follows the last segment
        done.append(joined.filter("begin >= size(way)").drop("begin"))
        if made.isEmpty():
            return reduce(DataFrame.unionByName, done)


def generalise(leaves: DataFrame, max_children: int, min_share: float) -> DataFrame:
    """``leaves`` (host, shape, counts) with column template: rare children become ``*``.

    From the root on, a child of a node with more than ``max_children`` children
    stays itself only if it has ``min_share`` of the node's pages.
    """

    def rare(children: DataFrame) -> tuple[DataFrame, DataFrame]:
        # summed before they meet, so that a node with very many children is no single task's
        nodes = children.groupBy("host", "pos", "node").agg(F.count("*").alias("children"), F.sum("n").alias("total")).filter(F.col("children") > max_children)
        fan = children.join(nodes, ["host", "pos", "node"]).filter(F.col("n") < min_share * F.col("total"))
        return nodes, fan.withColumn("new", F.lit("*"))

    tree = materialize(leaves.withColumn("way", F.col("shape")).withColumn("id", F.monotonically_increasing_id()), "template-leaves")
    return _renamed(tree, rare, ["n"], "templates").drop("id").withColumnRenamed("way", "template")


def merged_branches(templates: DataFrame, z: float) -> DataFrame:
    """``templates`` with branch: what stands for the merged branches on their path.

    The children of a node are ordered by their share of blocked pages; a child joins
    the one before if the two shares differ by fewer than ``z`` standard errors, and
    what is below both is treated as one from there on. Children without a labelled page
    form a branch of their own. Nodes with one child, and those without any labelled
    page below, whose templates get their host's share in any case, stay as they are.
    """

    def alike(children: DataFrame) -> tuple[DataFrame, DataFrame]:
        children = children.withColumn("l", F.col("blocked") + F.col("allowed"))
        nodes = children.groupBy("host", "pos", "node").agg(F.count("*").alias("children"), F.sum("l").alias("below")).filter("children > 1 and below > 0")
        fan = children.join(nodes.select("host", "pos", "node"), ["host", "pos", "node"]).withColumnRenamed("blocked", "b")
        order = Window.partitionBy("host", "pos", "node").orderBy((F.col("b") / F.nullif("l", F.lit(0))).asc_nulls_last(), "child")
        b0, l0 = F.lag("b").over(order), F.lag("l").over(order)
        pooled = (F.col("b") + b0 + 1) / (F.col("l") + l0 + 2)
        both = (F.col("l") > 0) & (l0 > 0)
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "l") + F.try_divide(F.lit(1), l0)))
        same = F.when(both, F.try_divide("b", "l") - F.try_divide(b0, l0) < F.lit(z) * error).otherwise((F.col("l") == 0) & (l0 == 0))
        marked = fan.withColumn("first", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
        return nodes, marked.withColumn("new", F.sum("first").over(order).cast("string"))

    tree = materialize(templates.withColumn("way", F.col("template")).withColumn("id", F.monotonically_increasing_id()), "branch-templates")
    return _renamed(tree, alike, ["blocked", "allowed"], "branches").drop("id").withColumnRenamed("way", "branch")


def template_verdicts(leaves: DataFrame, max_children: int = 16, min_share: float = 0.05, z: float = 1.64, prior: float = 4.0, threshold: float = 0.6) -> DataFrame:
    """host, shape, template, purity, verdict for rows (host, shape, n, blocked, allowed)."""
    counts = [F.sum(c).alias(c) for c in ("n", "blocked", "allowed")]
    tree = materialize(generalise(leaves, max_children, min_share), "template-tree")
    templates = merged_branches(tree.groupBy("host", "template").agg(*counts), z)
    templates = materialize(templates.withColumn("labelled", F.col("blocked") + F.col("allowed")), "branched")
    branches = templates.groupBy("host", "branch").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    hosts = templates.groupBy("host").agg(F.sum("blocked").alias("hb"), F.sum("labelled").alias("hl"))
    overall = templates.agg(F.coalesce(F.try_divide(F.sum("blocked"), F.sum("labelled")), F.lit(0.0)).alias("all"))
    host_share = (F.col("hb") + F.lit(prior) * F.col("all")) / (F.col("hl") + F.lit(prior))
    # one row: the share of blocked pages among all labelled ones
    hosts = hosts.join(F.broadcast(overall)).select("host", host_share.alias("host_share"))
    purity = (F.col("b") + F.lit(prior) * F.col("host_share")) / (F.col("l") + F.lit(prior))
    judged = templates.join(branches, ["host", "branch"]).join(hosts, "host").select("host", "template", purity.alias("purity"))
    return tree.join(judged, ["host", "template"]).select("host", "shape", "template", "purity", F.when(F.col("purity") >= threshold, "block").otherwise("allow").alias("verdict"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", **settings: float) -> DataFrame:
    """One row per row of ``pages``: id, url, host, path, rule, template, purity, verdict.

    Null URLs and those without ``://`` have an empty host and path; they form a
    host like any other. rule is null where none fits; of the rules that fit, the
    longest decides. Null ids and repeated rows stay, and each row counts. Paths are read
    whole; rounds follow the nodes on a way at which segments are generalised or branches
    are compared, one below another, and not the levels between. Of siblings with
    equal shares of blocked pages the one first by name comes first; such siblings are
    always alike, so the order does not change what is merged.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("match", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("shape", path_shape(F.col("path")))
    ruled = F.col("match.verdict")
    leaves = parsed.groupBy("host", "shape").agg(
        F.count("*").alias("n"),
        F.count(F.when(ruled == "block", 1)).alias("blocked"),
        F.count(F.when(ruled == "allow", 1)).alias("allowed"),
    )
    verdicts = materialize(template_verdicts(materialize(leaves, "url-leaves"), **settings), "url-verdicts")
    verdicts = verdicts.select("host", "shape", "purity", F.array_join("template", "/").alias("template"), F.col("verdict").alias("learned"))
    judged = parsed.join(verdicts, ["host", "shape"])
    return judged.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path", F.col("match.rule").alias("rule"), "template", "purity", F.coalesce(ruled, "learned").alias("verdict")
    )
