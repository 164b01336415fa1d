"""URL filters by a path-template tree, with DataFrame functions only.

1. Pages are summed by host and path; a path is the list of its segments, all of them.
2. Top-down, level by level, a node of a host's tree is variable if its different children are many (``VARIABLE_CHILDREN``) and
   hardly repeat (``VARIABLE_RATIO`` of its pages). The children's runs of digits become ``#`` then; if what is left is as varied
   still, the children become ``*``. Nothing but this variety makes a wildcard; few children stay literal.
3. Siblings whose labelled shares do not differ from that of their other siblings beyond chance (a z test of two shares) are
   merged: they are judged on their pooled counts. A branch that differs stands by itself. Leaves are merged first, then inner
   branches level by level up to the host, by the sums of all below them; inner branches that differ are compared once more with
   those that differ the same way. Leaves that fall together so are pooled if they pass the same test.
4. A template is rejected if its purity, the share of its labelled pages that are bad, smoothed by ``WEIGHT`` pages of the
   corpus-wide share, has ``LIFT`` times the odds of that share. A template without a bad page is not rejected, nor
   is any if all labelled pages are bad: none stands out.
5. Explicit rules on host and path come before the tree; the longest that fits wins.

Null urls and urls without ``://`` have an empty host and path and are judged like the pages of any other host, a label of
theirs included. Repeated rows get equal verdicts. The rounds of 2 and 3 are the levels at which a host has segments enough to
make a node variable, or to branch: a common beginning of any length costs none. A host may hold any share of the pages: sums combine before they are
shuffled, and pages meet their template's one row in a join that can split them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Children from which a node may be variable, and the least ratio of its different children to its pages then.
VARIABLE_CHILDREN, VARIABLE_RATIO = 12, 0.3
#: Limit of z for merging siblings, pages that smooth a purity, and how many times the corpus-wide odds reject.
Z_LIMIT, WEIGHT, LIFT = 1.96, 10.0, 2.0
#: Beginning of the segment of merged siblings: no segment of a path has a slash.
MERGED = "/*"


@dataclass(frozen=True)
class Rule:
    """Holds for a host and its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @staticmethod
    def parse(verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return Rule(verdict, host.lower(), slash + path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def segments(path: Column) -> Column:
    return F.array_remove(F.split(path, "/"), "")


def templates(pages: DataFrame) -> DataFrame:
    """pages: host, path, bad (1, 0 or null). Returns host, segs, n, labelled, bad."""
    return pages.groupBy("host", segments(F.col("path")).alias("segs")).agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))


def levels(found: DataFrame, column: str, least: int, inner: bool = False) -> list[int]:
    """The levels, from 1, at which a host has ``least`` different segments: at others no node has as many children. With ``inner``
    the last segment of a path does not count. One pass, however long a path is; a number for each level comes back."""
    segs = F.slice(column, 1, F.greatest(F.size(column) - 1, F.lit(0))) if inner else F.col(column)
    each = found.select("host", F.posexplode(segs).alias("level", "seg")).groupBy("host", "level", "seg").agg(F.count("*").alias("n"))
    kinds = each.groupBy("host", "level").agg(F.count("*").alias("kinds")).where(F.col("kinds") >= least)
    return sorted(r["level"] + 1 for r in kinds.select("level").distinct().collect())


def generalised(found: DataFrame) -> DataFrame:
    """Adds t, the segments with those of variable nodes made wildcards, level by level. A level uses its rows twice, so they are
    checkpointed: the plan would double with each level. The variable nodes are too: a node with most of the pages meets its one
    row in a join that can split it."""
    out = found.withColumn("t", F.col("segs"))
    for level in levels(out, "segs", VARIABLE_CHILDREN):
        node = out.select("*", F.slice("t", 1, level - 1).alias("up"), F.get("t", F.lit(level - 1)).alias("seg"))
        children = node.where("seg is not null").groupBy("host", "up", "seg").agg(F.sum("n").alias("n"))
        shapes = children.groupBy("host", "up", F.regexp_replace("seg", "[0-9]+", "#").alias("shape")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
        nodes = shapes.groupBy("host", "up").agg(F.sum("kinds").alias("kinds"), F.count("*").alias("shapes"), F.sum("n").alias("n"))
        varied = lambda kinds: (F.col(kinds) >= VARIABLE_CHILDREN) & (F.col(kinds) >= VARIABLE_RATIO * F.col("n"))
        variable = checkpointed(nodes.where(varied("kinds")).select("host", "up", varied("shapes").alias("any")))
        wild = F.when(F.col("any"), F.lit("*")).otherwise(F.regexp_replace("seg", "[0-9]+", "#"))
        node = node.join(variable, ["host", "up"], "left").withColumn("wild", F.when(F.col("any").isNotNull(), wild))
        t = F.transform("t", lambda s, i: F.when((i == level - 1) & F.col("wild").isNotNull(), F.col("wild")).otherwise(s))
        out = checkpointed(node.select(*found.columns, t.alias("t")))
    return out


def alike(labelled: Column, bad: Column, all_labelled: Column, all_bad: Column) -> Column:
    """Whether a branch's labelled share does not differ beyond chance from that of the rest of its family; all_labelled and all_bad
    are the family's sums, the branch's own among them."""
    pooled, rest = F.try_divide(all_bad, all_labelled), all_labelled - labelled
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), labelled) + F.try_divide(F.lit(1.0), rest)))
    return F.coalesce(F.abs(F.try_divide(F.try_divide(bad, labelled) - F.try_divide(all_bad - bad, rest), spread)) < Z_LIMIT, F.lit(True))


def merged_leaves(by: DataFrame) -> DataFrame:
    """by: host, t, labelled, bad. Adds m, t with the last segment of leaves alike MERGED."""
    by = by.withColumn("up", F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0)))).withColumn("depth", F.size("t"))
    family = by.groupBy("host", "up", "depth").agg(F.sum("labelled").alias("fl"), F.sum("bad").alias("fb"))
    by = by.join(family, ["host", "up", "depth"])
    same = alike(F.col("labelled"), F.col("bad"), F.col("fl"), F.col("fb")) & (F.col("depth") > 0)
    return checkpointed(by.select("host", "t", "labelled", "bad", F.when(same, F.concat("up", F.array(F.lit(MERGED)))).otherwise(F.col("t")).alias("m")))


def merged_branches(by: DataFrame, level: int) -> DataFrame:
    """Makes the segment at ``level`` MERGED where two inner branches or more are alike, and pools the leaves that then have one
    template where they are alike too. The rest keep what they had."""
    sums = [F.sum("labelled").alias("l"), F.sum("bad").alias("b")]
    inner = by.where(F.size("m") > level)
    node = [F.slice("m", 1, level - 1).alias("up"), F.get("m", F.lit(level - 1)).alias("seg")]
    nodes = inner.groupBy("host", *node).agg(*sums)
    family = nodes.groupBy("host", "up").agg(F.count("*").alias("kinds"), F.sum("l").alias("fl"), F.sum("b").alias("fb")).where("kinds > 1")
    # those that differ are compared with each other again, the ones above their family's share and the ones below it
    side = F.when(alike(F.col("l"), F.col("b"), F.col("fl"), F.col("fb")), F.lit(0.0)).otherwise(F.signum(F.try_divide("b", "l") - F.try_divide("fb", "fl")))
    tested = checkpointed(nodes.join(family, ["host", "up"]).select("host", "up", "seg", "l", "b", side.alias("side")))
    group = tested.groupBy("host", "up", "side").agg(F.sum("l").alias("fl"), F.sum("b").alias("fb"))
    like = tested.join(group, ["host", "up", "side"]).where((F.col("side") == 0) | alike(F.col("l"), F.col("b"), F.col("fl"), F.col("fb")))
    several = like.groupBy("host", "up", "side").agg(F.count("*").alias("kinds")).where("kinds > 1").select("host", "up", "side")
    chosen = like.join(several, ["host", "up", "side"]).select("host", "up", "seg", F.concat(F.lit(MERGED), F.when(F.col("side") > 0, "+").when(F.col("side") < 0, "-").otherwise("")).alias("_as"))
    # the templates, one row for each m, with what they would become
    made = F.transform("m", lambda s, i: F.when(i == level - 1, F.col("_as")).otherwise(s))
    new = checkpointed(inner.groupBy("host", "m").agg(*sums).select("*", *node).join(chosen, ["host", "up", "seg"]).select("host", "m", made.alias("new"), "l", "b"))
    pool = new.groupBy("host", "new").agg(F.sum("l").alias("fl"), F.sum("b").alias("fb"))
    moved = new.join(pool, ["host", "new"]).where(alike(F.col("l"), F.col("b"), F.col("fl"), F.col("fb"))).select("host", "m", "new")
    return checkpointed(by.join(moved, ["host", "m"], "left").withColumn("m", F.coalesce("new", "m")).drop("new"))


def judged(found: DataFrame) -> DataFrame:
    """found: as ``generalised`` has it. Returns host, segs, template, purity, rejected."""
    total = found.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).select(F.coalesce(F.try_divide("b", "l"), F.lit(0.0)).alias("prior"))
    by = merged_leaves(found.groupBy("host", "t").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
    for level in reversed(levels(by, "m", 2, inner=True)):
        by = merged_branches(by, level)
    pools = by.groupBy("host", "m").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).crossJoin(F.broadcast(total))
    pools = pools.withColumn("purity", (F.col("bad") + WEIGHT * F.col("prior")) / (F.col("labelled") + WEIGHT))
    odds = lambda p: F.try_divide(p, 1 - p)
    high = F.coalesce(odds(F.col("purity")) >= LIFT * odds(F.col("prior")), F.lit(False)) & (F.col("bad") > 0)
    name = F.concat(F.lit("/"), F.array_join(F.transform("m", lambda s: F.when(s.startswith(MERGED), F.lit("*")).otherwise(s)), "/"))
    pools = pools.select("host", "m", name.alias("template"), "purity", high.alias("rejected"))
    return found.select("host", "segs", "t").join(by.select("host", "t", "m").join(pools, ["host", "m"]), ["host", "t"]).drop("t", "m")


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits: its text and verdict, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[Rule], *, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, template, purity for each row of ``pages``.

    labels: key and bad (1 or 0) of labelled pages, one row each; pages without one do not count for a purity.
    """
    host, path = host_and_path(F.col(url))
    base = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    marks = labels.groupBy(F.col(key).alias("_label_key")).agg(F.max("bad").alias("bad"))
    marked = base.join(marks, F.col("_key") == F.col("_label_key"), "left")
    tree = judged(generalised(checkpointed(templates(marked))))
    seen = base.withColumn("segs", segments(F.col("path"))).join(tree, ["host", "segs"], "left")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when(F.coalesce("rejected", F.lit(False)), "block").otherwise("allow")
    return seen.select(F.col("_key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity")
