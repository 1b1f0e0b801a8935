"""URL filtering: fixed host and path rules, then a tree of path templates per host.

The segments of a url's path are the branches of its host's tree. From the root
down, as deep as paths go, variable segments are generalised into a wildcard:
those that hold a digit, and those of which too few urls are labelled to tell
them apart. The other children of a node are put in the order of their labelled
shares; neighbours whose shares do not differ (a two-proportion z-test) are
merged, and so are the trees below them. The labels are the rules' own verdicts.
A template whose smoothed share of allowed rows is under a threshold is blocked;
the longest rule that fits always comes first.

In a template, a segment is `=` and its text, `*` for the wildcard or `~` and a
number for merged branches, so a literal `*` or `~` meets none of these.

A null url, or one without `://`, has an empty host and path and meets no rule.
Repeated rows count and are judged each. Very long paths have as many levels as
segments. Ties: children of equal counts are one in all that follows. An empty
table gives an empty result. Extra columns are kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A child of a node with fewer labelled rows is not told apart from others of the kind.
FEW = 5
#: Two shares within this many standard errors are alike.
ALIKE = 1.96
#: Rows of either label that the smoothing adds, and the least share of allowed rows.
ADDED, LEAST = 1.0, 0.25


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, LOWER), F.regexp_extract(u, pattern, 2)


def first_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest (verdict, rule) that fits; a rule is a host and a path such as `com/en/`."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def template(path: Column) -> Column:
    return F.transform(F.split(F.ltrim(path, F.lit("/")), "/"), lambda s: F.when(s.rlike("[0-9]"), "*").otherwise(F.concat(F.lit("="), s)))


def merged(kid: DataFrame) -> DataFrame:
    """kid: host, node, seg, g, b (labelled rows). Adds `new`, the branch that the child belongs to.

    A node's children are taken by their different counts, of which there are far fewer than children.
    """
    own = (F.col("seg") != "*") & (F.col("g") + F.col("b") >= FEW)
    kind = kid.where(own).groupBy("host", "node", "g", "b").agg(F.count("*").alias("kids"))
    w = Window.partitionBy("host", "node").orderBy(F.col("g") / (F.col("g") + F.col("b")), "g", "b")
    kind = kind.withColumns({"pg": F.lag("g").over(w), "pb": F.lag("b").over(w)})
    n, pn = F.col("g") + F.col("b"), F.col("pg") + F.col("pb")
    pooled = (F.col("g") + F.col("pg")) / (n + pn)
    apart = F.abs(F.col("g") / n - F.col("pg") / pn) > ALIKE * F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / pn))
    kind = kind.withColumn("k", F.count_if(F.col("pg").isNotNull() & apart).over(w))
    kind = kind.withColumn("alike", F.sum("kids").over(Window.partitionBy("host", "node", "k"))).withColumn("own", F.lit(True))
    kid = kid.withColumn("own", own).join(kind.select("host", "node", "g", "b", "own", "k", "alike"), ["host", "node", "g", "b", "own"], "left")
    new = F.when(F.col("k").isNull(), "*").when(F.col("alike") == 1, F.col("seg")).otherwise(F.concat(F.lit("~"), F.col("k").cast("string")))
    return kid.select("host", "node", "seg", new.alias("new"))


def grow(counts: DataFrame) -> DataFrame:
    """counts: host, segs, good, bad. Adds `node`, the generalised template of each row."""
    t = counts.withColumn("node", F.lit(""))
    levels = counts.agg(F.max(F.size("segs"))).first()[0] or 0
    for d in range(levels):
        t = t.withColumn("seg", F.get("segs", F.lit(d)))
        kid = t.where("seg is not null").groupBy("host", "node", "seg").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
        t = t.join(merged(kid), ["host", "node", "seg"], "left").withColumn("node", F.when(F.col("seg").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), "new"))).drop("seg", "new")
        t = materialise(t) if d % 3 == 2 else t  # else each level's plan holds those before it twice
    return t


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, template and the template's smoothed share of allowed rows."""
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", first_rule(F.col("host"), F.col("path"), rules)).withColumn("segs", template(F.col("path")))
    counts = rows.groupBy("host", "segs").agg(F.count_if(F.col("hit.verdict") == "allow").cast("double").alias("good"), F.count_if(F.col("hit.verdict") == "block").cast("double").alias("bad"))
    t = grow(materialise(counts))
    share = (F.sum("good") + ADDED) / (F.sum("good") + F.sum("bad") + 2 * ADDED)
    t = materialise(t)
    purity = t.groupBy("host", "node").agg(share.alias("purity"))
    judged = t.select("host", "segs", "node").join(purity, ["host", "node"])
    verdict = F.coalesce("hit.verdict", F.when(F.col("purity") < LEAST, "block").otherwise("allow"))
    return rows.join(judged, ["host", "segs"], "left").select(id_col, "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), F.col("node").alias("template"), "purity")
