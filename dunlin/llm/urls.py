"""URL filters: host and path rules, then trust and distrust over the link graph of hosts.

Main path: DataFrame functions only. A url's host is what stands after the first `://` up to
`/`, `?`, `#` or the end, with A-Z lower-cased; its path goes on up to `?`, `#` or the end. A null
url, or one without `://`, has an empty host and path and fits no rule.

Where no rule fits, personalised PageRank over host edges decides: trust flows along links from
hosts with allowed pages, distrust flows against links from hosts with blocked pages, and a host
whose distrust share is at least `threshold` is blocked; all others, unknown hosts too, are allowed.
Rounds go on until every host that can be reached has its score up to `TOLERANCE` of itself, so the
verdict depends neither on a host's size nor on its distance; only the scores shown are rounded.
Each page row gives one result row; repeated ids stay.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunlin.llm.common import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
#: Rounds that the SQL of oracles.op7 writes out; the operator itself has no such limit.
ROUNDS = 5
#: What a host's score may lack at the end, and a share the threshold, as a part of itself.
TOLERANCE = 1e-6
THRESHOLD = 0.5
#: An absolute link of an HTML attribute; its first group is the host.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    def text(self) -> str:
        return self.host + self.path


#: The rules in force.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def host_of(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)).otherwise("")


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def by_rules(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null if none does."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text()), r.text())):
        hit = fits(r, host, path)
        name, verdict = F.when(hit, r.text()).otherwise(name), F.when(hit, r.verdict).otherwise(verdict)
    return name, verdict


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank (host, score) along weighted edges (src, dst, share) from seeds (host, seed).

    Each round passes on only what the last one brought (step); what a host may still get is taken to
    fall by the damping each round.
    """
    first = F.lit(1 - damping) * F.col("seed")
    state = materialize(seeds.select("host", first.alias("score"), first.alias("step")), "rank")
    while True:
        flow = edges.join(state.where("step > 0"), edges.src == state.host).groupBy("dst").agg(F.sum(F.col("share") * F.col("step")).alias("flow"))
        parts = flow.select(F.col("dst").alias("host"), F.lit(0.0).alias("score"), (F.lit(damping) * F.col("flow")).alias("step"))
        parts = parts.union(state.select("host", "score", F.lit(0.0).alias("step")))
        nxt = materialize(parts.groupBy("host").agg((F.sum("score") + F.sum("step")).alias("score"), F.sum("step").alias("step")), "rank")
        discard(state)
        state = nxt
        if state.where(F.col("step") * damping > F.lit(tolerance * (1 - damping)) * F.col("score")).isEmpty():
            return state.select("host", "score")


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, id_col: str = "page_id") -> DataFrame:
    """page id, host, path, rule, verdict, trust and distrust of every page."""
    own = pages.select(F.col(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = by_rules(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": name, "ruled": verdict})

    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> '' and src <> dst")
    pairs = materialize(links.groupBy("src", "dst").agg(F.count("*").alias("n")), "links")
    out = pairs.groupBy("src").agg(F.sum("n").alias("total"))
    along = pairs.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share"))
    along = materialize(along, "along")
    into = pairs.groupBy("dst").agg(F.sum("n").alias("total"))
    against = pairs.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("total")).alias("share"))
    against = materialize(against, "against")

    hosts = own.where("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("trusted"), F.avg(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("blocked")
    )
    hosts = materialize(hosts, "hosts")
    trust = propagate(along, hosts.where("trusted > 0").select("host", F.col("trusted").alias("seed")))
    distrust = propagate(against, hosts.where("blocked > 0").select("host", F.col("blocked").alias("seed")))
    scores = hosts.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left").na.fill(0.0)
    judged = own.join(scores, "host", "left")
    bad = F.col("distrust") >= F.lit(threshold * (1 - TOLERANCE)) * (F.col("trust") + F.col("distrust"))
    by_graph = F.when((F.col("distrust") > 0) & bad, "block").otherwise("allow")
    return judged.select(id_col, "host", "path", "rule", F.coalesce("ruled", by_graph).alias("verdict"), *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("trust", "distrust")))
