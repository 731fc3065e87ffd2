"""URL filters: rules on host and path, and trust and distrust propagated over the link graph of hosts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazzo.plans.durable import discard, materialize

from .common import ascii_lower

#: (verdict, rule) pairs of the registered query.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a string, or null.  A rule is a host (with all subdomains) and a path's start."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, rest = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


#: Absolute or protocol-relative link targets; group 1 is the host.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: links between different hosts, counted over pages.  Relative links stay on their host."""
    link = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    link = link.select(F.col("host").alias("src"), ascii_lower(F.col("to")).alias("dst"))
    return link.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-9) -> DataFrame:
    """``(host, kind, value)``: personalised PageRank of ``seeds(host, kind, value)``.

    ``trust`` flows along the links, ``distrust`` against them; each kind's seed values sum to 1.  What reaches a host
    without onward links returns to the seeds.  Hosts that nothing reaches have no row.  Rounds go on until less than
    ``tolerance`` is left to move: each moves at most ``damping`` of what the one before did, so they end.
    """
    ends = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.lit("trust").alias("kind"), "n").union(
        edges.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit("distrust").alias("kind"), "n")
    )
    # sums are written, so that the join can split the links of a host that very many link to
    sums = materialize(ends.groupBy("host", "kind").agg(F.sum("n").alias("all")), "degrees")
    flow = materialize(ends.join(sums, ["host", "kind"]).select("host", "kind", "to", (F.col("n") / F.col("all")).alias("w")), "flow")
    discard(sums)
    seeds = materialize(seeds, "seeds")
    if flow.limit(1).count() == 0:
        return seeds
    # what returns to the seeds is a multiple of them, so the ranks are the sum of all walks, scaled to 1
    walks, step = [seeds], seeds
    while True:
        step = materialize(step.join(flow, ["host", "kind"]).groupBy(F.col("to").alias("host"), "kind").agg((damping * F.sum(F.col("value") * F.col("w"))).alias("value")), "walk")
        left = step.agg(F.sum("value")).first()[0] or 0.0
        walks.append(step)
        if len(walks) == 12 or left * damping / (1 - damping) < tolerance:
            total = materialize(reduce(DataFrame.union, walks).groupBy("host", "kind").agg(F.sum("value").alias("value")), "rank")
            for cut in walks[:-1]:
                discard(cut)
            walks = [total]
        if left * damping / (1 - damping) < tolerance:
            break
    all_of = {r.kind: r.v for r in total.groupBy("kind").agg(F.sum("value").alias("v")).collect()}  # two rows
    scale = F.lit(1.0)
    for kind, v in all_of.items():
        scale = F.when(F.col("kind") == kind, 1.0 / v).otherwise(scale)
    discard(flow)
    return total.withColumn("value", F.col("value") * scale)


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]] = RULES,
    seed_share: float = 0.5,
    ratio: float = 1.0,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` of every page.

    A rule that fits decides (the longest; of equally long ones the last in string order).  Other pages take their
    host's verdict: ``block`` where distrust exceeds ``ratio`` times trust, else ``allow``.  Seeds are hosts of which
    at least ``seed_share`` of the pages fall to allowing (trust) or blocking (distrust) rules, weighted alike.

    A null url, or one without ``://``, has an empty host, no rule and no score, and is allowed.  Null html has no
    links.  Repeated pages are judged each and count as pages each.  Extra columns are ignored; no pages, no rows.
    Rules are configuration: they become one expression, so keep them to some hundreds.
    """
    parsed = pages.select(
        F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), F.col(html).alias("html")
    ).select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "html")
    verdicts = dict((r, v) for v, r in rules)
    verdict = F.lit(None).cast("string")
    for r, v in verdicts.items():
        verdict = F.when(F.col("rule") == r, F.lit(v)).otherwise(verdict)
    ruled = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("ruled", verdict)
    share = ruled.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("ruled") == "allow", 1)).alias("na"), F.count(F.when(F.col("ruled") == "block", 1)).alias("nb"),
    )
    share = share.select("host", (F.col("na") / F.col("n")).alias("a"), (F.col("nb") / F.col("n")).alias("b"))
    picked = share.select("host", F.lit("trust").alias("kind"), F.col("a").alias("s")).union(share.select("host", F.lit("distrust"), "b")).where(F.col("s") >= seed_share)
    picked = materialize(picked.select("host", "kind"), "picked")
    n = {r.kind: r.n for r in picked.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # two rows
    each = F.when(F.col("kind") == "trust", 1.0 / max(1, n.get("trust", 0))).otherwise(1.0 / max(1, n.get("distrust", 0)))
    score = propagate(host_edges(parsed.select("host", "html")), picked.select("host", "kind", each.alias("value")))
    score = score.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("value"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("value"))).alias("distrust")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    by_host = F.when(zero(F.col("distrust")) > ratio * zero(F.col("trust")), "block").otherwise("allow")
    return (
        ruled.drop("html")
        .join(score, "host", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), zero(F.col("trust")).alias("trust"), zero(F.col("distrust")).alias("distrust"))
    )
