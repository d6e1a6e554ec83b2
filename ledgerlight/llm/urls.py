"""URL filter: curated rules first, then a tree of path templates per host.

Path segments that vary (they hold digits or hexadecimal tokens) become wildcards at once, so the tree is built over
templates, not pages: pages are summed to (host, template) before anything else, and a host with a third of all pages
is a few partial sums.  Level by level, nodes with many small literal children replace those by a wildcard.  Then every
node of the tree, at any depth, is compared with its parent: branches whose share of bad labels differs from the parent's
by chance at most (a test of proportions) are merged with their siblings and judged by the parent; any other branch has its
own purity, the share of good labels smoothed towards the parent's.  A template is rejected if the purity of its last node
is too low.  Labels belong to pages by id.

Defined cases: a null url, or one without `://`, has empty host and path and the template of its own empty path;
repeated rows count as often as they occur; a null page_id has no label; without labels nothing is rejected; empty
tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import lower_ascii
from ledgerlight.session import written

# (host, path, verdict); a rule is named by host and path together.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

FANOUT = 32
SMALL_SHARE = 0.05
Z = 1.96
SMOOTHING = 8.0
PURITY = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, "(?s)^.*?://(.*)$", 1), F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for owner, prefix, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == owner) | host.endswith("." + owner)) & path.startswith(prefix)
        name, verdict = F.when(fits, owner + prefix).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def template(path: Column) -> Column:
    """All segments of the path, with variable ones as wildcards; a file extension stays."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(parts, lambda s: F.when(s.rlike("[0-9]") | s.rlike("^[0-9a-fA-F]{16,}$"), F.concat(F.lit("*"), F.regexp_extract(s, "([.][A-Za-z]+)$", 1))).otherwise(s))


def generalised(trees: DataFrame) -> DataFrame:
    """Wildcards for the small literal children of nodes with many: rows (host, first, template, pages, good, bad)."""
    trees = written(trees, "url-trees")
    # Only levels where some host has many different segments can have a node with many children.
    segments = trees.select("host", F.posexplode("template").alias("at", "child")).groupBy("host", "at").agg(F.count_distinct("child").alias("many"))
    for level in sorted(r["at"] + 1 for r in segments.where(F.col("many") > FANOUT).select("at").distinct().collect()):
        # A node is a host and the template above this level.
        above, child = F.slice("template", 1, level - 1), F.get("template", F.lit(level - 1))
        rows = trees.withColumns({"above": above, "child": child})
        children = rows.where("child is not null").groupBy("host", "above", "child").agg(F.sum("pages").alias("n"))
        nodes = children.groupBy("host", "above").agg(F.count("*").alias("many"), F.sum("n").alias("all")).where(F.col("many") > FANOUT)
        small = children.join(nodes, ["host", "above"]).where(F.col("n") < F.col("all") * SMALL_SHARE).select("host", "above", "child", F.lit("*").alias("wild"))
        rows = rows.join(small, ["host", "above", "child"], "left")
        below = F.slice("template", F.lit(level + 1), F.greatest(F.size("template") - level, F.lit(0)))
        changed = F.when(F.col("wild").isNotNull(), F.concat(above, F.array("wild"), below)).otherwise(F.col("template"))
        trees = written(rows.select("host", "first", changed.alias("template"), "pages", "good", "bad"), "url-trees")
    return trees


def node_key(depth: Column) -> Column:
    """A name of the node *depth* segments below the host; segments hold no slash."""
    return F.md5(F.array_join(F.slice("template", F.lit(1), depth), "/"))


def purity(path: Column, usual: Column) -> Column:
    """Smoothed share of good labels at the end of a path of nodes (good, bad), from the host down.

    A node whose share differs from its parent's by chance at most is merged with its siblings: it takes their parent's
    purity.  Any other has its own, smoothed towards the parent's.
    """
    start = F.struct(usual.cast("double").alias("p"), F.lit(None).cast("double").alias("share"))

    def down(above: Column, node: Column) -> Column:
        n = node["good"] + node["bad"]
        bad = node["bad"] / F.greatest(n, F.lit(1))
        share = F.coalesce(above["share"], 1 - above["p"])
        similar = (n == 0) | (F.abs(bad - share) <= Z * F.sqrt(share * (1 - share) / F.greatest(n, F.lit(1))))
        own = (node["good"] + SMOOTHING * above["p"]) / (n + SMOOTHING)
        return F.struct(F.when(similar, above["p"]).otherwise(own).alias("p"), F.when(n == 0, share).otherwise(bad).cast("double").alias("share"))

    return F.aggregate(path, start, down, lambda end: end["p"])


def judged_templates(pages: DataFrame) -> DataFrame:
    """(host, first, learned) of every template as found, from rows (host, first, good, bad)."""
    trees = generalised(pages.groupBy("host", "first").agg(F.count("*").alias("pages"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
                        .withColumn("template", F.col("first")))
    own = written(trees.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-templates")
    # The tree: every template lies on the nodes of all its beginnings, the host first.
    on = own.select("host", "template", "good", "bad", F.explode(F.sequence(F.lit(0), F.size("template"))).alias("depth"))
    on = on.select("host", "template", "good", "bad", "depth", node_key(F.col("depth")).alias("node"))
    nodes = on.groupBy("host", "depth", "node").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    paths = on.join(nodes, ["host", "depth", "node"]).groupBy("host", "template").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("depth", F.col("all_good").alias("good"), F.col("all_bad").alias("bad")))), lambda x: F.struct(x["good"], x["bad"])).alias("path"))
    # Two numbers: the labels of all pages.
    everywhere = own.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    labels = (everywhere.good or 0) + (everywhere.bad or 0)
    usual = everywhere.good / labels if labels else 1.0
    verdicts = paths.select("host", "template", F.when(purity(F.col("path"), F.lit(float(usual))) < PURITY, "block").otherwise("allow").alias("learned"))
    return trees.join(verdicts, ["host", "template"]).select("host", "first", "learned")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per page."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("first", template(F.col("path")))
    good = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = rows.join(good, rows["page_id"] == good["doc_id"], "left").select(
        "host", "first", F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0)).alias("good"), F.coalesce((F.col("quality") == 0).cast("long"), F.lit(0)).alias("bad"))
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    return rows.join(judged_templates(labelled), ["host", "first"]).select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(says, "learned").alias("verdict"))
