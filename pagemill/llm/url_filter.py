"""URL filtering by rules, and beyond them by a tree of path templates for each host.

Segments become branches of their host's tree. A segment made of digits or of hexadecimal
characters is a wildcard by its shape; of the others, one that has under `least_share` of
its node's URLs is generalised to "*", so a node has at most 1 / least_share + 1 branches.
Branches whose shares of bad labels do not differ significantly are merged. A template is
rejected if its share of bad labels, smoothed towards its host's and the host's towards all
labels', is `reject_at` or more.

Defined results: a null URL, or one without "://", has empty host and path and is judged
like any other; paths of any depth are followed, as long as two different ones share a node;
repeated rows count and come back as often as they stand; without labels nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.runtime import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. Rules are
    ("allow" or "block", "host/path")."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(action)).otherwise(verdict)
    return text, verdict


def segments(path: Column) -> Column:
    """The path's segments, of which digits and hexadecimal names are wildcards already."""
    parts = F.filter(F.split(path, "/"), lambda part: part != "")
    shape = lambda part: F.when(part.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$"), F.regexp_replace(part, "[0-9]+", "{n}")).when(
        part.rlike("^[0-9a-f]{8,}$"), F.lit("{h}")).otherwise(part)
    return F.transform(parts, shape)


def templates(urls: DataFrame, least_share: float = 0.05, level: float = 1.96) -> DataFrame:
    """Rows (host, parts, template, n, bad, good) of distinct segment lists, from rows (host, path,
    bad), bad being 1, 0 or null. One level of the tree at a time, until no node holds two lists
    any more: a list alone in its node is literal to its end. Nothing but sums by branch is
    shuffled."""
    listed = urls.select("host", segments(F.col("path")).alias("parts"), "bad")
    count = lambda value: F.coalesce(F.sum((F.col("bad") == value).cast("long")), F.lit(0))
    groups = listed.groupBy("host", "parts").agg(F.count(F.lit(1)).alias("n"), count(1).alias("bad"), count(0).alias("good"))
    groups, done, depth = materialize(groups.withColumn("template", F.lit("")), "url-groups"), [], 0
    columns = ["host", "parts", "template", "n", "bad", "good"]
    while True:
        size = groups.groupBy("host", "template").agg(F.count(F.lit(1)).alias("lists"))
        groups = groups.join(size, ["host", "template"])
        rest = F.slice("parts", depth + 1, F.greatest(F.size("parts") - depth, F.lit(0)))
        ended = (F.col("lists") == 1) | (F.size("parts") <= depth)
        whole = F.when(F.size(rest) > 0, F.concat(F.col("template"), F.lit("/"), F.array_join(rest, "/"))).otherwise(F.col("template"))
        marked = materialize(groups.select("host", "parts", "n", "bad", "good", F.when(ended, whole).otherwise(F.col("template")).alias("template"), ended.alias("ended")), "url-level")
        done.append(marked.where("ended").select(columns))
        # Lists that end in a node still count among its URLs.
        if marked.where("NOT ended").isEmpty():
            break
        groups = _next_level(marked, depth, least_share, level).where("NOT ended").select(columns)
        depth += 1
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def _next_level(groups: DataFrame, depth: int, least_share: float, level: float) -> DataFrame:
    """`groups` with the branch of their segment at `depth` added to their templates."""
    groups = groups.withColumn("s", F.when(~F.col("ended"), F.get("parts", F.lit(depth))).otherwise(""))
    sums = groups.groupBy("host", "template", "s").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    totals = sums.groupBy("host", "template").agg(F.sum("n").alias("total"))
    literal = sums.join(totals, ["host", "template"]).where(F.col("n") >= least_share * F.col("total")).where("s <> ''")
    literal = literal.withColumn("seen", F.col("bad") + F.col("good")).withColumn("rate", F.col("bad") / F.greatest("seen", F.lit(1)))
    # Branches in order of their rate: a new group starts where the step is significant.
    node = Window.partitionBy("host", "template").orderBy((F.col("seen") == 0), "rate", "s")
    last = lambda c: F.lag(c).over(node)
    pooled = (F.col("bad") + last("bad")) / (F.col("seen") + last("seen"))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("seen") + 1 / last("seen")))
    same = (F.col("seen") == 0) & (last("seen") == 0) | (F.col("seen") > 0) & (last("seen") > 0) & (
        (F.col("rate") - last("rate")) <= level * spread)
    literal = literal.withColumn("step", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    literal = literal.withColumn("group", F.sum("step").over(node))
    whole = Window.partitionBy("host", "template", "group")
    branch = F.array_join(F.sort_array(F.collect_list("s").over(whole)), "|")
    branches = literal.select("host", "template", "s", branch.alias("branch"))
    joined = groups.join(branches, ["host", "template", "s"], "left")
    step = F.when(F.col("s") == "", "").otherwise(F.concat(F.lit("/"), F.coalesce("branch", F.lit("*"))))
    return joined.withColumn("template", F.concat("template", step)).drop("branch", "s")


def verdicts(grouped: DataFrame, strength: float = 2.0, reject_at: float = 0.8) -> DataFrame:
    """Rows (host, template, purity, rejected) from templates()."""
    sums = grouped.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    labels = (sums["bad"] or 0) + (sums["good"] or 0)
    everywhere = (sums["bad"] or 0) / labels if labels else 0.0
    by = lambda *keys: grouped.groupBy(*keys).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rate = lambda prior: (F.col("bad") + strength * prior) / (F.col("bad") + F.col("good") + strength)
    hosts = by("host").select("host", rate(F.lit(everywhere)).alias("host_rate"))
    found = by("host", "template").join(hosts, "host").withColumn("purity", rate(F.col("host_rate")))
    return found.select("host", "template", "purity", (F.col("purity") >= reject_at).alias("rejected"))


def judge(
    pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", **options,
) -> DataFrame:
    """Rows (id, host, path, rule, verdict, template). URLs that a rule decides are labels for the
    templates; `labels` (url, bad) adds others."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    rows = materialize(rows.select("id", "host", "path", rule.alias("rule"), ruled.alias("ruled")), "urls")
    known = rows.select("host", "path", F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int")).alias("bad"))
    if labels is not None:
        known = known.unionByName(labels.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("bad").cast("int").alias("bad")))
    grouped = materialize(templates(known, **options), "url-templates")
    by_group = grouped.select("host", "parts", "template").join(verdicts(grouped), ["host", "template"])
    listed = rows.withColumn("parts", segments(F.col("path")))
    verdict = F.coalesce("ruled", F.when(F.col("rejected"), "block").otherwise("allow"))
    return listed.join(by_group, ["host", "parts"], "left").select("id", "host", "path", "rule", verdict.alias("verdict"), "template")
