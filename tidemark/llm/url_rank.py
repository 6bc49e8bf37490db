"""URL verdicts: prefix rules, and for the rest trust and distrust propagated over the graph of hosts.

DataFrame functions only. Rule-judged pages make a host a seed: its share of allowed pages is its trust, its share of
blocked pages its distrust. Trust flows along links (personalised PageRank); distrust flows against them, from a blocked
host to the hosts that link to it. A host whose distrust exceeds its trust by ``threshold`` is blocked.

Null urls and urls without ``://`` have an empty host and path and are judged like any other host. Null html has no
links; links of a host to itself do not count. Repeated rows are judged one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, sized, stage

#: Fixed values: (verdict, host suffix, path prefix) of the list in force.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Rules are a fixed list in the plan; a longer one is refused.
MAX_RULES = 500
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Hosts of absolute and scheme-relative links.
_LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*(?:https?:)?//([^/\"'?#\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def _first_rule(rules: list[tuple[str, str, str]], host: Column, path: Column, verdict: bool) -> Column:
    """The longest rule that fits (its text, or its verdict); of equally long ones the first in order of text."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are held in a plan")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    out = reduce(lambda c, r: c.when(fits(r[1], r[2]), r[0] if verdict else r[1] + r[2]), ordered, F)
    return out.otherwise(None) if ordered else F.lit(None).cast("string")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], *, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and rule_verdict (null where no rule fits)."""
    out = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    return out.withColumn("rule", _first_rule(rules, F.col("host"), F.col("path"), False)).withColumn("rule_verdict", _first_rule(rules, F.col("host"), F.col("path"), True))


def host_links(pages: DataFrame, *, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, weight): for each host its links to other hosts, as shares that sum to 1 over the host's links."""
    found = pages.select(F.col(host).alias("src"), F.explode(F.expr(f"regexp_extract_all({html}, r'{_sql(_LINK)}', 1)")).alias("dst"))
    counts = found.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).filter("src != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = counts.groupBy("src").agg(F.sum("n").alias("total")).withColumnRenamed("src", "_src")
    return counts.join(total, F.col("src") == F.col("_src")).select("src", "dst", (F.col("n") / F.col("total")).alias("weight"))


def _sql(pattern: str) -> str:
    return pattern.replace("'", r"\x27")


def _spread(scores: DataFrame, links: DataFrame, source: str, target: str, damping: float) -> DataFrame:
    """One step: what each host keeps of its seed, and what links bring it from the present scores (rows per host add up)."""
    moved = links.join(sized(scores.select(F.col("host").alias("_host"), "score")), F.col(source) == F.col("_host"))
    return moved.select(F.col(target).alias("host"), (F.col("score") * F.col("weight") * damping).alias("score"))


def host_scores(hosts: DataFrame, links: DataFrame, *, damping: float = 0.85, rounds: int = 12) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` steps; hosts: (host, trust_seed, distrust_seed).

    Each step is a join of the links with the hosts' scores on the host and a sum; a host's links are at most one row for
    each other host, as they are counted before. Scores are sent to all tasks while they are few; of more, a hub's links are split among
    tasks by the adaptive join. The scores are written to the shared folder at each step. A step moves ``damping`` of what the one
    before moved, so 12 of them leave 14 % of a seed's reach out, and what they leave out is what is farthest from it. Without
    links the scores are the seeds' and no step is run."""
    links = stage(links, "links")
    seeds = hosts.select("host", F.col("trust_seed").alias("trust"), F.col("distrust_seed").alias("distrust"))
    if links.limit(1).count() == 0:
        return seeds
    out_weight = links.groupBy("dst").agg(F.sum("weight").alias("total")).withColumnRenamed("dst", "_dst")
    back = stage(links.join(out_weight, F.col("dst") == F.col("_dst")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("total")).alias("weight")), "backlinks")
    sides = []
    for name, over in (("trust", links), ("distrust", back)):
        seed = seeds.select("host", F.col(name).alias("score")).filter("score > 0")
        now = seed
        for _ in range(rounds):
            now = stage(seed.unionByName(_spread(now, over, "src", "dst", damping)).groupBy("host").agg(F.sum("score").alias("score")), name)
        sides.append(now.withColumnRenamed("score", name))
    return sides[0].join(sides[1], "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, *, page_id: str = "page_id", url: str = "url", html: str = "html",
             threshold: float = 0.25, damping: float = 0.85, rounds: int = 12) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages``."""
    base = judged(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")), rules)
    hosts = base.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("rule_verdict") == "allow").alias("a"), F.count_if(F.col("rule_verdict") == "block").alias("b"))
    hosts = hosts.select("host", (F.col("a") / F.col("n")).alias("trust_seed"), (F.col("b") / F.col("n")).alias("distrust_seed"))
    scores = host_scores(stage(hosts, "hosts"), host_links(base), damping=damping, rounds=rounds).withColumnRenamed("host", "_host")
    scores = sized(stage(scores, "scores"))  # so that a host with a third of all pages loads no task
    out = base.drop("html").join(scores, F.col("host") == F.col("_host"), "left")
    by_host = F.when(F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)) > threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_host).alias("verdict"), "trust", "distrust")


def report(pages: DataFrame) -> DataFrame:
    return verdicts(pages).select("page_id", "host", "path", "rule", "verdict")


def oracle_sql(threshold: float = 0.25, damping: float = 0.85, rounds: int = 12) -> str:
    """The same rows in DuckDB: the steps unrolled into common table expressions."""
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    case = lambda verdict: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v if verdict else h + p}'" for v, h, p in ordered) + " END"
    out = [
        r"u AS (SELECT page_id, coalesce(html, '') AS html, translate(regexp_extract(coalesce(url, ''), '^(.*?)://([^/?#]*)([^?#]*)', 2, 's'), '" + UPPER + "', '" + LOWER + r"') AS host, regexp_extract(coalesce(url, ''), '^(.*?)://([^/?#]*)([^?#]*)', 3, 's') AS path FROM pages)",
        f"j AS (SELECT *, {case(False)} AS rule, {case(True)} AS rv FROM u)",
        "h AS (SELECT host, count(*) FILTER (WHERE rv = 'allow') / count(*) AS t, count(*) FILTER (WHERE rv = 'block') / count(*) AS d FROM j GROUP BY host)",
        r"e AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*[\x22\x27]?\s*(?:https?:)?//([^/\x22\x27?#\s>]+)', 1, 'i')), '" + UPPER + "', '" + LOWER + "') AS dst FROM j)",
        "c AS (SELECT src, dst, count(*) AS n FROM e WHERE src <> '' AND src <> dst GROUP BY src, dst)",
        "l AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM c)",
        "b AS (SELECT dst AS src, src AS dst, weight / sum(weight) OVER (PARTITION BY dst) AS weight FROM l)",
    ]
    for name, over in (("t", "l"), ("d", "b")):
        out.append(f"{name}0 AS (SELECT host, {name} AS s FROM h WHERE {name} > 0)")
        for i in range(1, rounds + 1):
            out.append(f"{name}{i} AS (SELECT host, sum(s) AS s FROM (SELECT * FROM {name}0 UNION ALL SELECT x.dst, p.s * x.weight * {damping} FROM {over} x JOIN {name}{i - 1} p ON p.host = x.src) GROUP BY host)")
    return "WITH " + ",\n".join(out) + (
        f"\nSELECT page_id, j.host, path, rule, coalesce(rv, CASE WHEN coalesce(d{rounds}.s, 0) - coalesce(t{rounds}.s, 0) > {threshold} THEN 'block' ELSE 'allow' END) AS verdict"
        f" FROM j LEFT JOIN t{rounds} ON t{rounds}.host = j.host LEFT JOIN d{rounds} ON d{rounds}.host = j.host")
