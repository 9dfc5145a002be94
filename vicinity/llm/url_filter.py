"""URL verdicts from host rules and, where no rule fits, from the link graph (DataFrame functions only).

Trust flows from trusted seed hosts along links (personalised PageRank); distrust flows from
blocked seed hosts against links, so that hosts which link to blocked ones are distrusted. A host is
blocked if its distrust exceeds its trust times ``ratio``. Seeds are hosts most of whose pages,
among those that a rule judges, are allowed or blocked.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is
allowed; hosts that no seed reaches are allowed; pages that share a url get the same verdict; a null
html has no links; links of a host to itself carry nothing; a null page_id is returned as it is and rows that repeat are
each judged and each count. Extra columns are ignored. In the graph a host has neither user nor port. What a host
without links receives goes no further, and after ``rounds`` rounds at most damping ^ rounds of a seed's mass (4 %) is still
on its way.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rules become literals in the plan; more than this many belong in a table.
MAX_RULES = 1000

#: (action, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

_LINK = r"""(?i)(?:^|[\s"'/])href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3))
    host = _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def node_of(host: Column) -> Column:
    """The host of the link graph: without user and port."""
    return F.regexp_replace(host, r"^[^@]*@|:[0-9]*$", "")


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; nulls if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    name = action = None
    for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, action)


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int, damping: float) -> DataFrame:
    """Personalised PageRank: (host, seed) and edges (src, dst, share) give (host, score)."""
    score = seeds.select("host", (F.col("seed") * (1 - damping)).alias("score"))
    for k in range(rounds):
        flow = edges.join(score, edges["src"] == score["host"]).groupBy(F.col("dst").alias("host")).agg(
            (F.sum(F.col("share") * F.col("score")) * damping).alias("score")
        )
        score = (
            flow.unionByName(seeds.select("host", (F.col("seed") * (1 - damping)).alias("score")))
            .groupBy("host").agg(F.sum("score").alias("score"))
        )
        if k % 4 == 3:
            score = materialize(score, "rank")
    return score


def url_verdicts(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, rounds: int = 20, damping: float = 0.85, ratio: float = 1.0
) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url, html)."""
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "html", host.alias("host"), path.alias("path")).withColumn("node", node_of(F.col("host")))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "action": action})

    hosts = materialize(
        judged.where("node <> ''").groupBy(F.col("node").alias("host")).agg(
            F.count_if(F.col("action") == "allow").alias("allowed"), F.count_if(F.col("action") == "block").alias("blocked")
        ),
        "hosts",
    )
    links = (
        judged.where("node <> ''")
        .select(F.col("node").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst"))
        .withColumn("dst", node_of(_lower(F.col("dst"))))
        .where("src <> dst AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    )
    links = materialize(links, "links")
    trusted = hosts.where("allowed > blocked").select("host", F.lit(1.0).alias("seed"))
    blocked = hosts.where("blocked > allowed").select("host", F.lit(1.0).alias("seed"))
    if links.isEmpty():
        rounds = 0
    out_sum = links.groupBy("src").agg(F.sum("n").alias("total"))
    in_sum = links.groupBy("dst").agg(F.sum("n").alias("total"))
    forward = links.join(out_sum, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share"))
    backward = links.join(in_sum, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("total")).alias("share"))
    if rounds:
        forward, backward = materialize(forward, "forward"), materialize(backward, "backward")
    trust = propagate(trusted, forward, rounds, damping).withColumnRenamed("score", "trust")
    distrust = propagate(blocked, backward, rounds, damping).withColumnRenamed("score", "distrust")
    distrusted = materialize(
        distrust.join(trust, "host", "left")
        .where(F.col("distrust") > F.coalesce("trust", F.lit(0.0)) * ratio)
        .select("host", F.lit("block").alias("by_graph")),
        "host-verdicts",
    )
    return judged.select("page_id", "host", "path", "rule", "action", "node").join(distrusted.withColumnRenamed("host", "node"), "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("action", "by_graph", F.lit("allow")).alias("verdict")
    )


def sql(rules: Sequence[tuple[str, str, str]] = RULES, rounds: int = 20, damping: float = 0.85, ratio: float = 1.0) -> str:
    """The same for DuckDB."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2]))
    case = lambda i: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, act)[i]}'" for act, h, p in ordered
    ) + " END"
    low = lambda x: f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    node = lambda x: f"regexp_replace({x}, '^[^@]*@|:[0-9]*$', '', 'g')"
    steps = []
    for name, edges, seeds in (("t", "forward", "trusted"), ("d", "backward", "distrusted")):
        steps.append(f"{name}0 AS (SELECT host, {1 - damping!r}::DOUBLE AS score FROM {seeds})")
        for k in range(rounds):
            steps.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT e.dst AS host, e.share * s.score * {damping!r}::DOUBLE AS score "
                f"FROM {edges} e JOIN {name}{k} s ON e.src = s.host UNION ALL SELECT host, score FROM {name}0) GROUP BY host)"
            )
    return rf"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h0 AS (SELECT page_id, html, coalesce({low("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
h AS (SELECT *, {node('host')} AS node FROM h0),
j AS (SELECT *, {case(0)} AS rule, {case(1)} AS act FROM h),
hosts AS (SELECT node AS host, count(*) FILTER (act = 'allow') AS a, count(*) FILTER (act = 'block') AS b FROM j WHERE node <> '' GROUP BY node),
raw AS (SELECT node AS src, {node(low("x"))} AS dst
        FROM (SELECT node, unnest(regexp_extract_all(html, '(?:^|[\s"''/])href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1, 'i')) AS x FROM j WHERE node <> '')),
links AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM raw WHERE src <> dst AND dst <> '' GROUP BY ALL),
forward AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM links),
backward AS MATERIALIZED (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS share FROM links),
trusted AS (SELECT host FROM hosts WHERE a > b), distrusted AS (SELECT host FROM hosts WHERE b > a),
{", ".join(steps)},
bad AS (SELECT d.host FROM d{rounds} d LEFT JOIN t{rounds} t USING (host) WHERE d.score > coalesce(t.score, 0) * {ratio!r}::DOUBLE)
SELECT page_id, host, path, rule, coalesce(act, CASE WHEN node IN (SELECT host FROM bad) THEN 'block' END, 'allow') AS verdict FROM j
"""
