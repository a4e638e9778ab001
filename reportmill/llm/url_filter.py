"""URL filters: explicit host and path rules, then a tree of path templates per host.

Below each host, paths are read segment by segment. Numbers and hex ids are wildcards by their
shape. Any other segment stands for itself as long as its share of the pages at its place in the
tree is, with confidence, no less than that of a site's section; the rest of a place is one
wildcard. Sibling branches whose shares of bad labels a two-sample test can't tell apart are
merged, at the leaves and at every node above. A branch's share is smoothed towards its parent's,
and a template with bad labels of its own is rejected when its smoothed share reaches a limit.
SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: (verdict, host and path): a rule fits its host, all subdomains, and paths that start so.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least share of a place's pages that a section has, and standard errors of confidence in it. So
#: a place has fewer than 1 / SECTION branches, however many segments stand there.
SECTION, SURE = 0.02, 1.645
#: Labels that a parent's share counts for.
PRIOR = 2.0
#: Bad share from which a template is rejected.
LIMIT = 0.5
#: Standard errors by which the shares of two siblings must differ to stay apart.
APART = 2.0


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) struct of the longest rule that fits, else null; ties: as listed."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{start}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _shape(segment: Column) -> Column:
    """A segment with numbers and hex ids as wildcards."""
    ided = F.regexp_replace(segment, r"(?i)^(?=[0-9a-f-]*[0-9])[0-9a-f]{6,}(?:-[0-9a-f]+)*+(?=\.|\z)", "*")
    return F.regexp_replace(ided, "[0-9]++", "*")


def segments(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), _shape)


def least_share(own: Column, of: Column, sure: float = SURE) -> Column:
    """Lower bound of a share by Wilson's interval."""
    p, z = own / of, sure * sure
    return (p + z / (2 * of) - sure * F.sqrt(p * (1 - p) / of + z / (4 * of * of))) / (1 + z / of)


def _common(one: Column, other: Column) -> Column:
    """How many first elements two arrays share."""
    step = lambda acc, x: F.struct((acc["n"] + (acc["on"] & x["a"].eqNullSafe(x["b"])).cast("int")).alias("n"), (acc["on"] & x["a"].eqNullSafe(x["b"])).alias("on"))
    pairs = F.zip_with(one, other, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), step)["n"]


def templates(rows: DataFrame, section: float = SECTION) -> DataFrame:
    """(host, raw, pages, ...) rows of distinct shaped paths -> the same with array ``template``.

    Place by place, until every path has ended or is the only one at its place, whose rest then
    stands for itself as one segment, so no path is cut. Segments that all paths of a place share
    are taken at once, however many: the rounds are the branchings that lie above each other, not
    the levels. A path that ends has "" as its last segment. Each round is written before the next.
    """
    done = None
    now = cut(rows.withColumn("template", F.array().cast("array<string>")))
    place = ["host", "template"]
    while True:
        # of what is left of the paths, the first and last in order share what all between them share
        at = F.size("template")
        left = F.slice("raw", at + 1, F.greatest(F.size("raw") - at, F.lit(0)))
        sizes = now.groupBy(*place).agg(F.sum("pages").alias("of"), F.count(F.lit(1)).alias("ways"), _common(F.min(left), F.max(left)).alias("shared"))
        here = now.join(sizes, place)
        level = at + F.when(F.col("ways") == 1, 0).otherwise(F.col("shared"))
        here = here.withColumn("level", level).withColumn("segment", F.coalesce(F.get("raw", F.col("level")), F.lit("")))
        here = cut(here)
        own = here.groupBy(*place, "segment").agg(F.sum("pages").alias("own"))
        moved = here.join(own, [*place, "segment"])
        chain = F.slice("raw", F.size("template") + 1, F.col("level") - F.size("template"))
        chain = F.transform(chain, lambda x: F.when(least_share(F.col("of"), F.col("of")) >= section, x).otherwise("*"))
        rest = F.array_join(F.slice("raw", F.col("level") + 1, F.greatest(F.size("raw") - F.col("level"), F.lit(0))), "/")
        literal = (F.col("segment") == "") | (least_share(F.col("own"), F.col("of")) >= section)
        step = F.when(F.col("ways") == 1, rest).when(literal, F.col("segment")).otherwise("*")
        over = (F.col("ways") == 1) | (F.col("segment") == "")
        moved = cut(moved.select(*rows.columns, F.concat("template", chain, F.array(step)).alias("template"), over.alias("over")))
        ended = moved.filter("over").drop("over")
        done = ended if done is None else done.unionByName(ended)
        now = moved.filter("not over").drop("over")
        if now.isEmpty():
            return done


def shown(template: Column) -> Column:
    """A template as text; a last "" (a path that ends) is not shown, but for the root."""
    return F.concat(F.lit("/"), F.array_join(F.filter(template, lambda s: s != ""), "/"))


def _merged(nodes: DataFrame, apart: float) -> DataFrame:
    """(host, node, n, bad) -> (host, node, n, bad) with the counts of all siblings merged with it.

    Siblings with labels stand in order of their shares; a neighbour joins unless the pooled
    two-sample test tells both shares apart. Siblings are few at any place.
    """
    parent = F.slice("node", F.lit(1), F.size("node") - 1)
    siblings = nodes.filter("n > 0").withColumn("parent", parent)
    order = Window.partitionBy("host", "parent").orderBy(F.col("bad") / F.col("n"), "n", "node")
    n, bad, m, worse = F.lag("n").over(order), F.lag("bad").over(order), F.col("n"), F.col("bad")
    pooled = (bad + worse) / (n + m)
    differs = F.abs(worse / m - bad / n) > apart * F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    chained = siblings.withColumn("group", F.sum(F.coalesce(differs, F.lit(True)).cast("int")).over(order))
    together = Window.partitionBy("host", "parent", "group")
    return chained.select("host", "node", F.sum("n").over(together).alias("n"), F.sum("bad").over(together).alias("bad"))


def learn(pages: DataFrame, prior: float = PRIOR, apart: float = APART) -> DataFrame:
    """(host, path, bad) rows, bad 1, 0 or null -> (host, raw, template, share, known, bad_labels) per shaped path.

    Pages and labels meet pre-aggregated per host and shaped path. ``share`` goes down from the
    whole table's over the host's and every node's, each smoothed towards the one above; ``known``
    and ``bad_labels`` are the labels of the template and of the siblings merged with it.
    """
    shaped = pages.withColumn("raw", segments(F.col("path")))
    counts = shaped.groupBy("host", "raw").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = cut(templates(cut(counts)))
    all_n, all_bad = tree.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    leaves = tree.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    nodes = leaves.select("host", "template", "n", "bad", F.explode(F.sequence(F.lit(0), F.size("template"))).alias("depth"))
    nodes = nodes.withColumn("node", F.slice("template", F.lit(1), F.col("depth")))
    sums = nodes.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    merged = _merged(sums.filter(F.size("node") > 0), apart).unionByName(sums.filter((F.size("node") == 0) & (F.col("n") > 0)))
    on_path = nodes.select("host", "template", "depth", "node").join(merged, ["host", "node"], "left").na.fill(0, ["n", "bad"])
    paths = on_path.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("depth", "n", "bad"))).alias("steps"))
    base = F.lit(all_bad / all_n if all_n else 0.0)
    share = F.aggregate("steps", base, lambda above, x: (x["bad"] + prior * above) / (x["n"] + prior))
    last = F.element_at("steps", -1)
    judged = paths.select("host", "template", share.alias("share"), last["n"].alias("known"), last["bad"].alias("bad_labels"))
    return tree.select("host", "raw", "template").join(judged, ["host", "template"])


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", bad: Column | None = None, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """(key, host, path, rule, verdict, template, bad_share) of every row.

    ``bad`` is 1 or 0 where a page is labelled, else null. URLs that are null or have no
    "://" have empty host and path and are judged as such. A rule decides where one fits;
    elsewhere the page's template does, blocked if it or a sibling merged with it has a bad label
    and its smoothed share reaches ``limit``; templates without labels are allowed. Null keys,
    repeated rows and ties keep their rows, further columns are left out. Pages meet their templates
    by host and shaped path, pre-aggregated; the join splits hot paths at run time.
    """
    label = F.lit(None).cast("int") if bad is None else bad.cast("int")
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), label.alias("bad"))
    known = learn(rows.select("host", "path", "bad"))
    judged = rows.withColumn("raw", segments(F.col("path"))).join(known, ["host", "raw"])
    rule = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when((F.col("bad_labels") > 0) & (F.col("share") >= limit), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        F.col("key").alias(key), "host", "path", rule["rule"].alias("rule"), F.coalesce(rule["verdict"], learned).alias("verdict"), shown(F.col("template")).alias("template"), F.col("share").alias("bad_share")
    )
