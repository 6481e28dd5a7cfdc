"""URL verdicts by rules and, where no rule fits, by propagation over the host graph.

Rules name a host with its subdomains and a path prefix. Hosts with allowed pages are
trusted seeds, hosts with blocked pages are distrusted ones. Trust follows links,
distrust follows them backwards (who links to a bad host is suspect), both as
personalised PageRank over weighted host edges. A host is blocked where its distrust
exceeds its trust by more than a margin.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.llm.shared import rows_of, shared_folder, stored

DAMPING = 0.85
TOLERANCE = 1e-5  # far under MARGIN * (1 - DAMPING)
ROUNDS_PER_TABLE = 3
MARGIN = 0.5
DIGITS = 9


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def host(url: Column) -> Column:
    """From after the first :// up to a slash, question mark, hash or the end."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(lower_ascii(raw), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def matched(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between hosts from (host, html) rows.

    Links are the absolute and protocol-relative href values. A host below another one
    that has pages (blog.a.example below a.example) is linked with it both ways.
    """
    to = F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""), F.lit(1)))
    links = pages.where("html is not null and host <> ''").select(F.col("host").alias("src"), to.alias("dst"))
    links = links.select("src", lower_ascii(F.col("dst")).alias("dst")).where("src <> dst")
    links = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.where("host <> ''").select("host").distinct()
    above = hosts.select("host", F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("up"))
    near = above.join(hosts.select(F.col("host").alias("up")), "up").select(F.col("host").alias("src"), F.col("up").alias("dst"))
    both = near.unionAll(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    return links.unionAll(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(hosts: DataFrame, edges: DataFrame, folder: str, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from hosts with seed weights `good` and `bad`.

    Scores are personalised PageRank times the number of seeds' weight, so that a lone
    seed without links has 1 - damping. Each round passes on only what the round before
    added to a host (hosts to which nothing was added send nothing), and rounds go on
    until no host gains `tolerance` or more. What is passed on shrinks by the damping in
    every round, so they end. Both directions run in one pass: a row of an edge carries
    trust forwards and distrust backwards. Every third round is a written table.
    """
    out_of = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("in"))
    shares = edges.join(out_of, "src").join(into, "dst").select(
        "src", "dst", (F.col("weight") / F.col("out")).alias("forth"), (F.col("weight") / F.col("in")).alias("back")
    )
    # one row for each way a score can move: from, to, share of trust, share of distrust
    ways = shares.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("forth").alias("t"), F.lit(0.0).alias("d")).unionAll(
        shares.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("t"), F.col("back").alias("d"))
    )
    ways = stored(ways.groupBy("a", "b").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), f"{folder}/ways")
    nodes = hosts.select("host", "good", "bad").unionAll(
        edges.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("good"), F.lit(0.0).alias("bad"))
    )
    nodes = nodes.groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    trust, distrust = F.lit(1 - damping) * F.col("good"), F.lit(1 - damping) * F.col("bad")
    added = [trust.alias("more_trust"), distrust.alias("more_distrust")]
    scores = stored(nodes.select("host", trust.alias("trust"), distrust.alias("distrust"), *added), f"{folder}/scores-0")
    step, largest = 0, tolerance
    while largest >= tolerance:
        step += 1
        moved = ways.join(scores.where("more_trust > 0 or more_distrust > 0"), F.col("a") == F.col("host")).select(
            F.col("b").alias("host"),
            (F.lit(damping) * F.col("t") * F.col("more_trust")).alias("trust"),
            (F.lit(damping) * F.col("d") * F.col("more_distrust")).alias("distrust"),
        )
        before = scores.select("host", "trust", "distrust", F.lit(0.0).alias("more_trust"), F.lit(0.0).alias("more_distrust"))
        scores = before.unionAll(moved.select("*", "trust", "distrust")).groupBy("host")
        scores = scores.agg(*[F.sum(c).alias(c) for c in ("trust", "distrust", "more_trust", "more_distrust")])
        if step % ROUNDS_PER_TABLE == 0:
            scores = stored(scores, f"{folder}/scores-{step}")
            largest = scores.agg(F.max(F.greatest("more_trust", "more_distrust"))).first()[0] or 0.0
    return scores.select("host", "trust", "distrust")


def judge(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    margin: float = MARGIN,
    folder: str | None = None,
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, trust, distrust.

    The longest fitting rule decides. Without one, the host's scores do: block where
    distrust exceeds trust by more than `margin` times what a host of one seed weight
    keeps, else allow. A seed's weight is the share of a host's pages that rules allow
    or block. Null urls and those without :// have empty host and path, no rule, no
    scores and are allowed; null pages link to nothing. Rows may repeat, each counting
    as a page; columns other than the three are ignored.
    """
    folder = folder or shared_folder(pages.sparkSession)
    rows = rows_of(pages, id=id_col, url=url_col, html=html_col).select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "html")
    rows = rows.withColumn("rule", matched(rules, F.col("host"), F.col("path")))
    allowed, blocked = F.col("rule.verdict") == "allow", F.col("rule.verdict") == "block"
    hosts = rows.where("host <> ''").groupBy("host").agg(
        F.avg(F.when(allowed, 1.0).otherwise(0.0)).alias("good"), F.avg(F.when(blocked, 1.0).otherwise(0.0)).alias("bad")
    )
    edges = stored(host_edges(rows.select("host", "html")), f"{folder}/edges")
    hosts = stored(hosts, f"{folder}/hosts")
    scores = propagate(hosts, edges, folder).select("host", F.round("trust", DIGITS).alias("trust"), F.round("distrust", DIGITS).alias("distrust"))
    suspect = F.col("distrust") - F.col("trust") > margin * (1 - DAMPING)
    out = rows.drop("html").join(scores, "host", "left")
    return out.select(
        "id",
        "host",
        "path",
        F.col("rule.rule").alias("rule"),
        F.coalesce("rule.verdict", F.when(suspect, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
