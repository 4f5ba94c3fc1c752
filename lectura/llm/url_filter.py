"""URL filters: rules first, then templates of paths learnt per host. DataFrame functions only.

Every host has a tree of path templates. Segments that are numbers or ids become wildcards at once. Level by level, down to
the last segment, a child keeps a branch of its own only if the share of bad labels there differs from its siblings'; the
others merge into a wildcard, *. Of those that differ, the ones that are alike merge again: all that are worse than their
siblings into *+, all better ones into *-, but for those that differ even there. A template is rejected when its smoothed share of bad labels exceeds the threshold.

A null url, or one without ://, has an empty host and path and is judged with the template of both. Pages without label count
as pages, not as labels; repeated labels of a page count once (bad wins). Repeated rows are judged alike, an empty table
gives no row, and no other columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import lower_ascii, written

#: (verdict, rule): the rule's host, then its path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict. Rules are a short list of literals."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, p = r[: r.index("/")], r[r.index("/") :]
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The segments of a path, numbers and ids as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    own = lambda s: F.when(s.rlike(r"^[*{\\\\]"), F.concat(F.lit("\\"), s)).otherwise(s)  # noqa: E731  what looks like a wildcard
    shape = lambda s: F.when(s.rlike(r"^[0-9]+$"), "{n}").when(s.rlike(r"^[0-9a-fA-F-]{8,}$") & s.rlike("[0-9]"), "{id}").otherwise(own(s))
    return F.transform(parts, shape)


def unlike(labelled: Column, bad: Column, all_labelled: Column, all_bad: Column, z: float) -> tuple[Column, Column]:
    """Whether a branch's share of bad labels differs from that of the rest of all, and whether it is higher.

    Both shares are drawn to that of all by one label, as the variance has it: a branch without labels differs from nothing.
    """
    rest, rest_bad = all_labelled - labelled, all_bad - bad
    share = (all_bad + 1) / (all_labelled + 2)
    gap = (bad + share) / (labelled + 1) - (rest_bad + share) / (rest + 1)
    return F.abs(gap) > z * F.sqrt(share * (1 - share) * (1 / (labelled + 1) + 1 / (rest + 1))), gap > 0


def path_templates(paths: DataFrame, z: float) -> DataFrame:
    """paths (host, segs, n, labelled, bad) with the template each falls under.

    A level costs aggregations that combine before they shuffle and joins on (host, template, segment); a hot host is many keys.
    A path alone under its template meets no siblings further down, so it ends there with the rest of its segments.
    """
    left, done, level = paths.withColumn("template", F.lit("")), [], 0
    while True:
        here = left.withColumn("seg", F.coalesce(F.get("segs", F.lit(level)), F.lit("")))
        children = here.groupBy("host", "template", "seg").agg(F.count("*").alias("paths"), *(F.sum(c).alias(c) for c in ("n", "labelled", "bad")))
        parents = children.groupBy("host", "template").agg(*(F.sum(c).alias(f"all_{c}") for c in ("paths", "n", "labelled", "bad")))
        differs, worse = unlike(F.col("labelled"), F.col("bad"), F.col("all_labelled"), F.col("all_bad"), z)
        fixed = (F.col("seg") == "") | F.startswith("seg", F.lit("{")) | (F.col("n") == F.col("all_n"))
        sort = F.when(fixed, "fixed").when(~differs, "*").when(worse, "*+").otherwise("*-")
        sorted_ = children.join(parents, ["host", "template"]).withColumn("sort", sort)
        peers = sorted_.filter("sort in ('*+', '*-')").groupBy("host", "template", "sort").agg(F.count("*").alias("peers"), *(F.sum(c).alias(f"peer_{c}") for c in ("labelled", "bad")))
        apart, _ = unlike(F.col("labelled"), F.col("bad"), F.col("peer_labelled"), F.col("peer_bad"), z)
        own = (F.col("sort") == "fixed") | F.coalesce((F.col("peers") == 1) | apart, F.lit(False))
        branch = sorted_.join(peers, ["host", "template", "sort"], "left").select("host", "template", "seg", F.when(own, F.col("seg")).otherwise(F.col("sort")).alias("branch"), (F.col("all_paths") == 1).alias("alone"))
        joined = here.join(branch, ["host", "template", "seg"])
        ahead = F.array_join(F.transform(F.slice("segs", F.lit(level + 1), F.size("segs")), lambda s: F.concat(F.lit("/"), s)), "")
        template = F.when(F.col("branch") == "", F.col("template")).when(F.col("alone"), F.concat("template", ahead)).otherwise(F.concat("template", F.lit("/"), "branch"))
        ends = (F.col("branch") == "") | F.col("alone")
        moved = written(joined.select("host", "segs", "n", "labelled", "bad", template.alias("template"), ends.alias("ends")))
        done.append(moved.filter("ends").drop("ends"))
        left, level = moved.filter("not ends").drop("ends"), level + 1
        if not left.limit(1).count():
            return reduce(DataFrame.unionByName, done)


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, z: float = 2.0, prior: float = 10.0, reject_above: float = 0.6) -> DataFrame:
    """page_id, host, path, rule, verdict, template, badness for every row of pages; labels are (page_id, bad) of some pages."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = labels.filter(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    keyed = urls.withColumn("segs", segments(F.col("path")))
    paths = written(
        keyed.join(known, "page_id", "left").groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    templated = path_templates(paths, z)
    total = templated.agg(F.sum("bad"), F.sum("labelled")).first()
    base = (total[0] or 0) / (total[1] or 1)
    of_template = templated.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    badness = (F.col("bad") + prior * base) / (F.col("labelled") + prior)
    verdicts = templated.select("host", "segs", "template").join(of_template, ["host", "template"]).select("host", "segs", "template", badness.alias("badness"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (
        keyed.join(verdicts, ["host", "segs"], "left")
        .withColumn("rule", rule)
        .withColumn("verdict", F.coalesce(verdict, F.when(F.col("badness") > reject_above, "block").otherwise("allow")))
        .select("page_id", "host", "path", "rule", "verdict", "template", "badness")
    )
