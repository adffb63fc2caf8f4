"""URL filters by link-graph propagation, with DataFrame functions only.

Rules come first: a rule names a host and a path prefix, fits the host and all its subdomains, and the longest fitting
rule decides.  Urls without a rule are judged by their host.  A host is a trusted seed if more than half of
its pages are allowed by rule, a blocked seed if more than half are blocked.  Trust spreads along links
as a personalised PageRank that restarts at the trusted seeds; distrust spreads against the links
from the blocked seeds, so that a host linking to blocked ones is distrusted.  Both run in the same
iteration, as one table of (kind, host, score), until the L1 change of a round is below EPSILON for both and no host is newly
reached; what scores still lack is then at most 0.85 / 0.15 times that.  A host is blocked where its distrust exceeds `ratio` times its trust.
Mass that reaches a host without links in its direction ends there.

Host edges are the distinct pairs (page's host, link's host) of href links with a host, absolute (http://host/) or without the scheme (//host/); links inside a host say nothing
about other hosts and are left out.  Comments and scripts are no links.

Nulls, ties and odd rows: a null url or one without "://" has an empty host and path, no rule, and is allowed; null html has no
links; repeated pages count as often as they stand; ports and user names stay part of the host, as given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: L1 change of a round below which scores have converged.
EPSILON = 1e-6
#: A link with a host: href is an attribute of its own (not data-href), its value quoted or not.
_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]*)"""
#: Links of one host that meet its score in one task.
HUB_LINKS = 1 << 17
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits.  For a rule list that fits in a plan."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct (src, dst) of different hosts."""
    bare = F.regexp_replace(F.col(html_col), r"(?is)<!--.*?-->|<script\b.*?</script>", "")
    links = F.explode(F.regexp_extract_all(bare, F.lit(_HREF), 1))
    pairs = pages.select(host_of(F.col(url_col)).alias("src"), links.alias("link")).select("src", host_of(F.regexp_replace("link", "^//", "http://")).alias("dst"))
    return pairs.filter((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")).distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, every: int = 4, epsilon: float = EPSILON) -> DataFrame:
    """(kind, host, score) from edges (src, dst) and seeds (kind, host, score); kind "distrust" runs against the links.

    rounds None: until both kinds have converged and no host is newly reached, looked at in every `every`th round.
    """
    way = edges.select(F.lit("trust").alias("kind"), "src", "dst").union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src")))
    degree = way.groupBy("kind", F.col("src").alias("host")).agg(F.count("*").alias("degree"))
    # a hub's links are dealt to parts, each of which meets a copy of its score
    degree = materialise(degree.withColumn("parts", F.ceil(F.col("degree") / HUB_LINKS)), "host-degrees")
    part = F.pmod(F.xxhash64("dst"), F.col("parts"))
    way = materialise(way.withColumnRenamed("src", "host").join(degree, ["kind", "host"]).select("kind", "host", "dst", "degree", part.alias("part")), "host-edges")
    hubs = degree.filter("parts > 1").select("kind", "host", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts") - 1)).alias("part"))
    hubs = None if hubs.isEmpty() else hubs
    restart = seeds.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))
    if way.isEmpty():
        return restart
    score, i = seeds, 0
    while i != rounds:
        i += 1
        spread = score.withColumn("part", F.lit(0).cast("long"))
        if hubs is not None:
            spread = spread.unionByName(score.join(hubs, ["kind", "host"]))
        moved = way.join(spread, ["kind", "host", "part"]).select("kind", F.col("dst").alias("host"), (F.col("score") / F.col("degree") * damping).alias("score"))
        parts, old = moved.union(restart), F.lit(None).cast("double").alias("old")
        if i % every and i != rounds:
            score = parts.groupBy("kind", "host").agg(F.sum("score").alias("score"))
            continue
        # a host once reached is reached in every later round, so the old scores add no rows
        both = parts.select("*", old).union(score.select("kind", "host", F.lit(0.0), F.col("score")))
        both = materialise(both.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("old").alias("old")), "host-scores")
        score = both.drop("old")
        if rounds is None:
            last = both.groupBy("kind").agg(F.sum(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0)))).alias("change"), F.count_if(F.col("old").isNull()).alias("new")).collect()
            if all(r.change < epsilon and not r.new for r in last):
                break
    return score


def judge(pages: DataFrame, rules=RULES, ratio: float = 1.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the host's trust and distrust."""
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    split = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = split.select(id_col, "host", "path", name.alias("rule"), verdict.alias("ruled"))
    hosts = ruled.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    seeds = hosts.select("host", F.when(2 * F.col("allowed") > F.col("n"), "trust").when(2 * F.col("blocked") > F.col("n"), "distrust").alias("kind")).filter("kind is not null")
    totals = seeds.groupBy("kind").agg(F.count("*").alias("total"))
    seeds = materialise(seeds.join(totals, "kind").select("kind", "host", (1 / F.col("total")).alias("score")), "seeds")
    scores = propagate(host_edges(pages, url_col, html_col), seeds)
    wide = scores.groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("score"))), F.lit(0.0)).alias("trust"), F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("score"))), F.lit(0.0)).alias("distrust"))
    out = ruled.join(materialise(wide, "host-trust"), "host", "left")
    method = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return out.select(id_col, "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


_WORDS = f"translate(coalesce(regexp_extract({{}}, '{_URL[4:]}', 1, 's'), ''), '{_UPPER}', '{_LOWER}')"
#: By ROUNDS rounds instead of a test of convergence; what scores still lack then is under 1e-10.
ROUNDS = 150
ORACLE = f"""
WITH RECURSIVE p AS (SELECT page_id, html, {_WORDS.format('url')} AS host, coalesce(regexp_extract(url, '{_URL[4:]}', 2, 's'), '') AS path FROM pages),
ruled AS MATERIALIZED (SELECT *, CASE {' '.join(f"WHEN (host = '{r[: r.index('/')]}' OR ends_with(host, '.{r[: r.index('/')]}')) AND starts_with(path, '{r[r.index('/') :]}') THEN '{r}'" for r, _ in sorted(RULES, key=lambda x: -len(x[0])))} END AS rule FROM p),
said AS MATERIALIZED (SELECT *, CASE {' '.join(f"WHEN rule = '{r}' THEN '{says}'" for r, says in RULES)} END AS ruled FROM ruled),
hosts AS (SELECT host, CASE WHEN 2 * count(*) FILTER (ruled = 'allow') > count(*) THEN 'trust' WHEN 2 * count(*) FILTER (ruled = 'block') > count(*) THEN 'distrust' END AS kind FROM said WHERE host <> '' GROUP BY host),
seeds AS MATERIALIZED (SELECT kind, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS score FROM hosts WHERE kind IS NOT NULL),
l AS (SELECT host AS src, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->|<script\\b.*?</script>', '', 'gis'), '{_HREF[5:].replace("'", "''")}', 1, 'is')) AS link FROM p),
e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, {_WORDS.format("regexp_replace(link, '^//', 'http://')")} AS dst FROM l) WHERE src <> dst AND src <> '' AND dst <> ''),
way AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY kind, src) AS degree FROM (SELECT 'trust' AS kind, src, dst FROM e UNION ALL SELECT 'distrust', dst, src FROM e)),
r(i, kind, host, score) AS (SELECT 0, kind, host, score FROM seeds UNION ALL
  SELECT i, kind, host, sum(score) FROM (SELECT r.i + 1 AS i, r.kind, dst AS host, 0.85 * r.score / degree AS score FROM r JOIN way ON way.kind = r.kind AND way.src = r.host WHERE r.i < {ROUNDS}
    UNION ALL SELECT n.i + 1, seeds.kind, seeds.host, 0.15 * seeds.score FROM seeds, (SELECT DISTINCT i FROM r WHERE i < {ROUNDS}) n) GROUP BY i, kind, host),
wide AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM r WHERE i = {ROUNDS} GROUP BY host)
SELECT page_id, said.host, path, rule, coalesce(ruled, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict FROM said LEFT JOIN wide ON wide.host = said.host
"""
