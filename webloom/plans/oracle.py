"""DuckDB SQL for the queries of the catalogue, by definitions other than the operators' own wherever there are some."""

from __future__ import annotations

from .catalogue import ROBOTS, THROUGHPUT


def _edges(key: str, least: int) -> str:
    return f"""e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT {key} AS src, lead({key}) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {key}) AS dst
      FROM lineitem WHERE l_quantity >= {least}) WHERE dst IS NOT NULL),
    v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e),
    deg AS MATERIALIZED (SELECT id, coalesce(i.n, 0)::BIGINT AS in_deg, coalesce(o.n, 0)::BIGINT AS out_deg FROM v
      LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) i ON i.dst = id LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) o ON o.src = id)"""


DENSE, SPARSE, SUPP = _edges("l_partkey", 40), _edges("l_partkey", 45), _edges("l_suppkey", 47)
#: All pairs (s, d, k) by recursion; needs v and e.
PAIRS = """p(s, d, k) USING KEY (s, d) AS (SELECT id, id, 0 FROM v UNION
      SELECT p.s, e.dst, p.k + 1 FROM p JOIN e ON e.src = p.d LEFT JOIN recurring.p AS r ON r.s = p.s AND r.d = e.dst WHERE r.s IS NULL)"""
SCC = "scc AS MATERIALIZED (SELECT a.s AS id, min(a.d) AS comp FROM p a JOIN p b ON a.s = b.d AND a.d = b.s GROUP BY a.s)"
WCC = """w(id, comp) USING KEY (id) AS (SELECT id, id FROM v UNION
      SELECT r.id, min(w.comp) FROM w JOIN (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e) u ON u.a = w.id JOIN recurring.w AS r ON r.id = u.b WHERE w.comp < r.comp GROUP BY r.id)"""
PER_VERTEX = "bv AS MATERIALIZED (SELECT s AS id, coalesce(avg(k) FILTER (k > 0), -1.0) AS avg_dist, CASE WHEN max(k) > 0 THEN max(k) ELSE -1 END AS ecc FROM p GROUP BY s)"


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + " "


def _rec(*parts: str) -> str:
    return _with(*parts, recursive=True)


# ------------------------------------------------------------------------- pages

_HREFS = r"""h AS (SELECT page_id, url, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->|<script\b.*?</script>', '', 'gis'), '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1, 'is')) AS href,
       generate_subscripts(regexp_extract_all(regexp_replace(html, '<!--.*?-->|<script\b.*?</script>', '', 'gis'), '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1, 'is'), 1)::INTEGER - 1 AS pos FROM pages),
    links AS (SELECT * FROM h WHERE trim(href) <> '')"""
_HOST = r"lower(regexp_extract({}, '^[A-Za-z]+://([^/:?#]+)', 1))"
_PAGE = r"rtrim(regexp_replace(url, '#.*$', ''), '/')"
_LINK = r"rtrim(lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1)) || href, '/')"


def _host(column: str) -> str:
    return _HOST.format(column)


# ----------------------------------------------------------------------- pagerank


def _rank_steps(dampings: list[float], steps: int) -> str:
    """CTEs x0 .. x_steps (d, id, x), one after the other."""
    parts = [
        "n AS (SELECT count(*)::DOUBLE AS n FROM v)",
        "ds(d) AS (VALUES " + ", ".join(f"({d}::DOUBLE)" for d in dampings) + ")",
        "x0 AS MATERIALIZED (SELECT d, id, out_deg, 1.0::DOUBLE / n AS x FROM deg, ds, n)",
    ]
    for i in range(1, steps + 1):
        b = f"x{i - 1}"
        parts.append(
            f"x{i} AS MATERIALIZED (SELECT a.d, a.id, a.out_deg, (1 - a.d) / n + a.d * (coalesce(g.got, 0) + l.loose / n) AS x FROM {b} a CROSS JOIN n "
            f"JOIN (SELECT d, coalesce(sum(x) FILTER (out_deg = 0), 0) AS loose FROM {b} GROUP BY d) l ON l.d = a.d "
            f"LEFT JOIN (SELECT s.d, e.dst, sum(s.x / s.out_deg) AS got FROM {b} s JOIN e ON e.src = s.id GROUP BY s.d, e.dst) g ON g.d = a.d AND g.dst = a.id)"
        )
    parts.append("t AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT a.d, {i} AS iter, sum(abs(a.x - b.x)) AS l1, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS l2, max(abs(a.x - b.x)) AS linf FROM x{i} a JOIN x{i - 1} b ON a.d = b.d AND a.id = b.id GROUP BY a.d" for i in range(1, steps + 1)) + ")")
    parts.append("xs AS (" + " UNION ALL ".join(f"SELECT {i} AS iter, d, id, x FROM x{i}" for i in range(1, steps + 1)) + ")")
    parts.append("ended AS (SELECT d, coalesce(min(iter) FILTER (l1 < 1e-6), max(iter)) AS last FROM t GROUP BY d)")
    return ", ".join(parts)


_RANK = _with(DENSE, _rank_steps([0.85], 45), "sc AS (SELECT id, x FROM xs JOIN ended USING (d) WHERE iter = last)")

# --------------------------------------------------------------------- robustness


def _robust(strategy: str) -> str:
    order = "in_deg DESC, id" if strategy == "attack" else "md5('42:' || id::VARCHAR), id"
    return _rec(
        SPARSE.replace("e AS MATERIALIZED", "e0 AS MATERIALIZED").replace("FROM e ", "FROM e0 ").replace("FROM e)", "FROM e0)").replace("v AS MATERIALIZED", "v0 AS MATERIALIZED").replace("FROM v\n", "FROM v0\n"),
        "n AS (SELECT count(*) AS n FROM v0)",
        "f(sc, fraction) AS (VALUES (0, 0.01::DOUBLE), (1, 0.02), (2, 0.05), (3, 0.1), (4, 0.2), (5, 0.3), (6, 0.5))",
        "sc AS (SELECT sc, fraction, floor(n * fraction)::BIGINT AS removed FROM f, n)",
        f"rk AS (SELECT id, row_number() OVER (ORDER BY {order}) AS r FROM deg)",
        "v AS MATERIALIZED (SELECT sc, sc * 1000000000000 + id AS id FROM rk, sc WHERE r > removed)",
        "e AS MATERIALIZED (SELECT sc, sc * 1000000000000 + src AS src, sc * 1000000000000 + dst AS dst FROM e0, sc WHERE sc * 1000000000000 + src IN (SELECT id FROM v) AND sc * 1000000000000 + dst IN (SELECT id FROM v))",
        WCC, PAIRS, SCC,
        "ws AS (SELECT id // 1000000000000 AS sc, comp, count(*) AS size FROM w GROUP BY ALL)",
        "lw AS (SELECT sc, max(size) AS largest_wcc, arg_max(comp, (size, -comp)) AS comp FROM ws GROUP BY sc)",
        "ls AS (SELECT sc, max(size) AS largest_scc FROM (SELECT id // 1000000000000 AS sc, comp, count(*) AS size FROM scc GROUP BY ALL) GROUP BY sc)",
        "bv AS (SELECT s // 1000000000000 AS sc, s, avg(k) FILTER (k > 0) AS a, max(k) AS m FROM p WHERE s IN (SELECT id FROM w JOIN lw USING (comp)) GROUP BY ALL)",
        "far AS (SELECT sc, coalesce(avg(a), 0) AS avg_distance, max(m) AS diameter FROM bv GROUP BY sc)",
        "ad AS (SELECT v.sc, v.id, (SELECT count(*) FROM e WHERE dst = v.id) AS i, (SELECT count(*) FROM e WHERE src = v.id) AS o FROM v)",
        "dg AS (SELECT sc, avg(i) AS avg_in, max(i) AS max_in, avg(o) AS avg_out, max(o) AS max_out FROM ad GROUP BY sc)",
    ) + f"""SELECT '{strategy}' AS strategy, fraction, removed, largest_wcc, largest_scc, round(largest_wcc / n, 6) AS rel_wcc, round(largest_scc / n, 6) AS rel_scc,
      round(avg_distance, 6) AS avg_distance, diameter, round(avg_in, 6) AS avg_in, max_in, round(avg_out, 6) AS avg_out, max_out
      FROM sc CROSS JOIN n JOIN lw USING (sc) JOIN ls USING (sc) JOIN far USING (sc) JOIN dg USING (sc)"""  # fmt: skip


_ADJ = "adj AS MATERIALIZED (SELECT src AS a, dst AS b FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst)"
#: Articulation by definition: without x, some two of its neighbours are no longer connected.
_ART = _rec(
    SPARSE, _ADJ,
    """q(x, id, c) USING KEY (x, id) AS (SELECT a, b, b FROM adj UNION
      SELECT q.x, u.b, min(q.c) FROM q JOIN adj u ON u.a = q.id AND u.b <> q.x LEFT JOIN recurring.q AS r ON r.x = q.x AND r.id = u.b WHERE r.c IS NULL OR q.c < r.c GROUP BY q.x, u.b)""",
) + "SELECT q.x AS id FROM q JOIN adj ON adj.a = q.x AND adj.b = q.id GROUP BY q.x HAVING count(DISTINCT q.c) > 1"
#: Bridge by definition: without u - v, v is not reached from u.
_BRIDGE = _rec(
    SPARSE, _ADJ,
    """q(u, v, id) AS (SELECT a, b, a FROM adj WHERE a < b UNION
      SELECT q.u, q.v, x.b FROM q JOIN adj x ON x.a = q.id AND NOT (x.a = q.u AND x.b = q.v) AND NOT (x.a = q.v AND x.b = q.u))""",
) + "SELECT a AS u, b AS v FROM adj WHERE a < b AND NOT EXISTS (SELECT 1 FROM q WHERE q.u = a AND q.v = b AND q.id = b)"
#: Shortest path counts level by level, then pair dependencies by the path-count formula.
_BETWEEN = _rec(
    SPARSE, PAIRS,
    "pm AS MATERIALIZED (SELECT * FROM p)",
    """sg(s, v, k, sigma) AS (SELECT id, id, 0, 1.0::DOUBLE FROM v UNION ALL
      SELECT s, v, k, sum(sigma) FROM (SELECT g.s, e.dst AS v, g.k + 1 AS k, g.sigma FROM sg g JOIN e ON e.src = g.v JOIN pm ON pm.s = g.s AND pm.d = e.dst AND pm.k = g.k + 1) GROUP BY s, v, k)""",
    "sm AS MATERIALIZED (SELECT * FROM sg)",
    "dep AS (SELECT a.v AS id, sum(a.sigma * b.sigma / c.sigma) AS score FROM sm a JOIN sm b ON b.s = a.v JOIN sm c ON c.s = a.s AND c.v = b.v AND c.k = a.k + b.k WHERE a.s <> a.v AND b.v <> a.v GROUP BY a.v)",
) + "SELECT id, round(coalesce(score, 0), 6) AS score FROM v LEFT JOIN dep USING (id)"


def _hist(ctes: str, table: str, column: str) -> str:
    return ctes + f"SELECT {column} AS value, count(*) AS n FROM {table} GROUP BY {column}"


def _ccdf(column: str) -> str:
    return f"cc AS (SELECT k, ln(k) AS x, ln((SELECT count(*) FROM deg WHERE {column} >= k)::DOUBLE / (SELECT count(*) FROM deg)) AS y FROM (SELECT DISTINCT {column} AS k FROM deg WHERE {column} > 0))"


def _ols(column: str) -> str:
    return _with(DENSE, _ccdf(column)) + "SELECT round(1 - regr_slope(y, x), 6) AS gamma, round(regr_r2(y, x), 6) AS r2, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM cc HAVING var_pop(x) > 0 AND var_pop(y) > 0"


def _mle(column: str) -> str:
    return _with(
        DENSE,
        f"r AS (SELECT m.x_min, d.{column}::DOUBLE AS x, row_number() OVER (PARTITION BY x_min ORDER BY d.{column}) AS i, count(*) OVER (PARTITION BY x_min) AS n FROM (SELECT DISTINCT {column} AS x_min FROM deg WHERE {column} > 0) m JOIN deg d ON d.{column} >= m.x_min)",
        "g AS (SELECT x_min, n, sum(ln(x / x_min)) AS s FROM r WHERE n >= 50 GROUP BY x_min, n)",
        "k AS (SELECT x_min, r.n, CASE WHEN s > 0 THEN 1 + r.n / s ELSE 'inf'::DOUBLE END AS gamma, max(abs(i / r.n - CASE WHEN s > 0 THEN 1 - pow(x / x_min, 1 - (1 + r.n / s)) ELSE 0 END)) AS ks FROM r JOIN g USING (x_min) GROUP BY x_min, r.n, s)",
    ) + "SELECT round(gamma, 6) AS gamma, round(ks, 6) AS ks, x_min::DOUBLE AS x_min, n AS n_tail FROM k ORDER BY round(k.ks, 12), x_min LIMIT 1"


_BOW = _rec(DENSE, PAIRS, SCC,
    "core AS MATERIALIZED (SELECT id FROM scc WHERE comp = (SELECT comp FROM scc GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1))",
    "o AS (SELECT DISTINCT d AS id FROM p WHERE s IN (SELECT id FROM core))", "i AS (SELECT DISTINCT s AS id FROM p WHERE d IN (SELECT id FROM core))",
    "bt AS (SELECT id, CASE WHEN id IN (SELECT id FROM core) THEN 'CORE' WHEN id IN (SELECT id FROM o) THEN 'OUT' WHEN id IN (SELECT id FROM i) THEN 'IN' ELSE 'TENDRILS' END AS region FROM v)")
_S_PAIRS = _rec(SPARSE, PAIRS, PER_VERTEX)
_S_WCC, _D_SCC = _rec(SPARSE, WCC), _rec(DENSE, PAIRS, SCC)
_DEG = _with(DENSE)
#: Links among out-neighbours by list intersection.
_CLUS = _with(SUPP, "nb AS (SELECT src AS id, list(dst) AS l FROM e GROUP BY src)",
    "cl AS (SELECT d.id, out_deg AS degree, CASE WHEN out_deg < 2 THEN -1.0 ELSE coalesce((SELECT sum(len(list_intersect(b.l, a.l))) FROM nb b WHERE list_contains(a.l, b.id)), 0)::DOUBLE / (out_deg * (out_deg - 1)) END AS c FROM deg d LEFT JOIN nb a ON a.id = d.id)",
    "cd AS (SELECT degree AS k, avg(c) AS avg_c FROM cl WHERE c <> -1 GROUP BY degree)")
_ROBOT_LINES = ROBOTS.replace("'", "''")
_RULES = f"""hosts AS (SELECT DISTINCT {_host('url')} AS host FROM pages), ln AS (SELECT host, unnest(string_split('{_ROBOT_LINES}', chr(10))) AS line FROM hosts),
    rules AS (SELECT host, CASE WHEN starts_with(line, 'Allow') THEN 'allow' ELSE 'disallow' END AS kind, trim(CASE WHEN starts_with(line, 'Allow') THEN substr(line, 7) ELSE substr(line, 10) END) AS path FROM ln WHERE starts_with(line, 'Allow') OR starts_with(line, 'Disallow'))"""
_REACH = "src3 AS (SELECT id FROM v ORDER BY id LIMIT 3), "

ORACLE_SQL = {
    "link_extract": f"WITH {_HREFS} SELECT url, pos, href FROM links",
    "link_extract_html": f"WITH {_HREFS} SELECT page_id, count(*) AS n_links, count(DISTINCT {_LINK}) AS n_distinct FROM links GROUP BY page_id",
    "url_normalize": f"WITH {_HREFS} SELECT DISTINCT {_PAGE} AS page, {_LINK} AS link FROM links",
    "url_normalize_udf": f"WITH {_HREFS} SELECT DISTINCT {_PAGE} AS page, {_LINK} AS link FROM links",
    "url_host_counts": f"SELECT {_host('url')} AS host, count(*) AS n FROM pages GROUP BY 1",
    "url_shorten": r"SELECT page_id, CASE WHEN length(b) > 30 THEN b[:29] || '…' ELSE b END AS short FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '/$', '') AS b FROM pages)",
    "same_host_links": f"WITH {_HREFS} SELECT {_host('url')} AS host, count(*) AS links, count(DISTINCT {_LINK}) AS targets FROM links WHERE {_host(_LINK)} = {_host('url')} GROUP BY 1",
    "robots_rules": f"WITH {_RULES} SELECT host, kind, path FROM rules",
    "robots_allowed": f"""WITH {_RULES}, pg AS (SELECT page_id, {_host('url')} AS host, regexp_extract(regexp_replace(url, '#.*$', ''), '^[a-z]+://[^/?]+(.*)$', 1) AS path FROM pages),
      m AS (SELECT page_id, kind, regexp_matches(lower(pg.path), '^' || replace(replace(lower(rules.path), '.', '\\.'), '*', '.*')) AS fits FROM pg JOIN rules USING (host))
      SELECT page_id, NOT bool_or(fits AND kind = 'disallow') OR bool_or(fits AND kind = 'allow') AS allowed FROM m GROUP BY page_id""",
    "page_graph_edges": f"WITH {_HREFS}, pu AS (SELECT row_number() OVER (ORDER BY u) - 1 AS id, u FROM (SELECT DISTINCT {_PAGE} AS u FROM links)) SELECT DISTINCT a.id AS src, b.id AS dst FROM (SELECT {_PAGE} AS f, {_LINK} AS t FROM links) x JOIN pu a ON a.u = f JOIN pu b ON b.u = t",
    "host_path_edges": f"WITH {_HREFS} SELECT DISTINCT {_host('url')} AS src, href AS dst FROM links",
    "crawl_bfs": _rec(DENSE, PAIRS) + "SELECT d AS id, k AS level FROM p WHERE s = (SELECT min(id) FROM v) ORDER BY k, d LIMIT 500",
    "crawl_all": _rec(DENSE, PAIRS) + "SELECT d AS id, k AS level FROM p WHERE s = (SELECT min(id) FROM v)",
    "politeness_schedule": f"SELECT page_id, 0.5::DOUBLE * (row_number() OVER (PARTITION BY {_host('url')} ORDER BY page_id) - 1) AS start_s FROM pages",
    "graph_edges": _DEG + "SELECT src, dst FROM e",
    "graph_stats": _DEG + """SELECT count(*) AS v, sum(out_deg)::BIGINT AS e, sum(in_deg)::BIGINT AS in_sum, max(in_deg) AS max_in, max(out_deg) AS max_out, arg_max(id::VARCHAR, (in_deg, -id)) AS max_in_url,
      arg_max(id::VARCHAR, (out_deg, -id)) AS max_out_url, count(*) FILTER (out_deg = 0) AS dangling, round(sum(out_deg) / count(*), 9) AS avg_degree, round(sum(out_deg)::DOUBLE / (count(*) * (count(*) - 1)), 9) AS density FROM deg""",
    "dangling": _DEG + "SELECT id FROM deg WHERE out_deg = 0",
    "degree_table": _DEG + "SELECT id, in_deg, out_deg FROM deg",
    "out_degree_hist": _hist(_DEG, "deg", "out_deg"),
    "in_degree_hist": _hist(_DEG, "deg", "in_deg"),
    "degree_loglog_in": _DEG + "SELECT round(log10(in_deg), 6) AS log_k, round(log10(count(*)), 6) AS log_n FROM deg WHERE in_deg > 0 GROUP BY in_deg",
    "degree_loglog_out": _DEG + "SELECT round(log10(out_deg), 6) AS log_k, round(log10(count(*)), 6) AS log_n FROM deg WHERE out_deg > 0 GROUP BY out_deg",
    "powerlaw_ccdf_in": _with(DENSE, _ccdf("in_deg")) + "SELECT k, round(x, 6) AS log_k, round(y, 6) AS log_ccdf FROM cc",
    "powerlaw_ols_in": _ols("in_deg"),
    "powerlaw_ols_out": _ols("out_deg"),
    "powerlaw_mle_in": _mle("in_deg"),
    "powerlaw_mle_out": _mle("out_deg"),
    "wcc_labels": _S_WCC + "SELECT id, comp FROM w",
    "wcc_sizes": _S_WCC + "SELECT comp, count(*) AS size FROM w GROUP BY comp",
    "wcc_summary": _S_WCC + "SELECT count(*) AS n_components, max(size) AS largest, arg_max(comp, (size, -comp)) AS largest_comp FROM (SELECT comp, count(*) AS size FROM w GROUP BY comp)",
    "scc_labels": _D_SCC + "SELECT id, comp FROM scc",
    "scc_sizes": _D_SCC + "SELECT comp, count(*) AS size FROM scc GROUP BY comp",
    "scc_summary": _rec(SPARSE, PAIRS, SCC) + "SELECT count(*) AS n_components, max(size) AS largest, arg_max(comp, (size, -comp)) AS largest_comp FROM (SELECT comp, count(*) AS size FROM scc GROUP BY comp)",
    "condensation_nodes": _D_SCC + "SELECT DISTINCT comp FROM scc",
    "condensation_edges": _D_SCC + "SELECT DISTINCT a.comp AS src_comp, b.comp AS dst_comp FROM e JOIN scc a ON a.id = src JOIN scc b ON b.id = dst WHERE a.comp <> b.comp",
    "reach_forward": _rec(SPARSE, PAIRS) + "SELECT DISTINCT d AS id FROM p WHERE s IN (SELECT id FROM v ORDER BY id LIMIT 3)",
    "reach_backward": _rec(SPARSE, PAIRS) + "SELECT DISTINCT s AS id FROM p WHERE d IN (SELECT id FROM v ORDER BY id LIMIT 3)",
    "reach_core_forward": _BOW + "SELECT id FROM o",
    "reach_core_backward": _BOW + "SELECT id FROM i",
    "bowtie": _BOW + "SELECT id, region FROM bt",
    "bowtie_counts": _BOW + "SELECT region, count(*) AS n FROM bt GROUP BY region",
    "bfs_single_source": _rec(SPARSE, PAIRS, "one AS MATERIALIZED (SELECT d, k FROM p WHERE s = (SELECT min(id) FROM v))") + "SELECT v.id, coalesce(o.k, -1) AS dist, (SELECT min(e.src) FROM e JOIN one f ON f.d = e.src WHERE e.dst = v.id AND f.k = o.k - 1) AS parent FROM v LEFT JOIN one o ON o.d = v.id",
    "bfs_vertex": _S_PAIRS + "SELECT id, round(avg_dist, 6) AS avg_dist, ecc FROM bv",
    "bfs_summary": _S_PAIRS + """SELECT coalesce(max(ecc) FILTER (ecc > 0), 0) AS diameter, coalesce(min(ecc) FILTER (ecc > 0), -1) AS radius, round(avg(avg_dist) FILTER (avg_dist >= 0), 6) AS avg_distance, (SELECT count(*) FROM p WHERE k > 0) AS reachable_pairs,
      round(avg(avg_dist) FILTER (avg_dist >= 0) / ln(greatest(count(*), 2)), 6) AS ratio_ln, round(avg(avg_dist) FILTER (avg_dist >= 0) / log2(greatest(count(*), 2)), 6) AS ratio_log2 FROM bv""",
    "pair_distance_hist": _S_PAIRS + "SELECT k AS distance, count(*) AS pairs FROM p WHERE k > 0 GROUP BY k",
    "eccentricity_hist": _hist(_S_PAIRS, "bv", "ecc"),
    "distance_decay_fit": _S_PAIRS + "SELECT round(regr_slope(y, k), 6) AS slope, round(regr_intercept(y, k), 6) AS intercept, round(regr_r2(y, k), 6) AS r2 FROM (SELECT k, log10(count(*)) AS y FROM p WHERE k > 0 GROUP BY k)",
    "betweenness": _BETWEEN,
    "clustering_local": _CLUS + "SELECT id, degree, round(c, 6) AS c FROM cl",
    "clustering_global": _with(SUPP, "t AS (SELECT a.src AS v, a.dst AS n, b.dst AS m FROM e a JOIN e b ON a.src = b.src AND a.dst < b.dst)") + "SELECT count(*) FILTER (EXISTS (SELECT 1 FROM e WHERE e.src = t.n AND e.dst = t.m)) AS closed, count(*) AS triplets, round(count(*) FILTER (EXISTS (SELECT 1 FROM e WHERE e.src = t.n AND e.dst = t.m)) / count(*), 6) AS global_c FROM t",
    "clustering_by_degree": _CLUS + "SELECT k, round(avg_c, 6) AS avg_c FROM cd",
    "clustering_fit": _CLUS + "SELECT round(regr_slope(log10(avg_c), log10(k)), 6) AS slope, round(regr_intercept(log10(avg_c), log10(k)), 6) AS intercept FROM cd WHERE k > 0 AND avg_c > 0",
    "clustering_hist": _CLUS + "SELECT b.bin, count(cl.id) AS n FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN cl ON c >= 0 AND least(floor(c / 0.1::DOUBLE), 9) = b.bin GROUP BY b.bin",
    "pagerank_scores": _RANK + "SELECT id, round(x, 9) AS score FROM sc",
    "pagerank_top20": _RANK + "SELECT row_number() OVER (ORDER BY round(x, 12) DESC, id) AS rank, id, round(x, 9) AS score FROM sc ORDER BY rank LIMIT 20",
    "pagerank_trace": _RANK + "SELECT t.d, iter, round(l1, 9) AS l1, round(l2, 9) AS l2, round(linf, 9) AS linf FROM t JOIN ended ON t.d = ended.d WHERE iter <= last",
    "pagerank_sweep": _with(DENSE, _rank_steps([1.0, 0.99, 0.95, 0.9, 0.85, 0.7, 0.5], 60), "u AS (SELECT d, iter, unnest(['l1', 'l2', 'linf']) AS norm, unnest([l1, l2, linf]) AS err FROM t)")
    + "SELECT u.d, norm, coalesce(min(iter) FILTER (err < 1e-6), max(iter)) AS iterations, min(iter) FILTER (err < 1e-6) IS NOT NULL AS converged FROM u GROUP BY u.d, norm",
    "pagerank_rank_fit": _RANK + "SELECT round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept FROM (SELECT log10(row_number() OVER (ORDER BY x DESC)) AS x, log10(x) AS y FROM sc WHERE x > 0)",
    "articulation_points": _ART,
    "bridges": _BRIDGE,
    "removal_order_attack": _DEG + "SELECT id, row_number() OVER (ORDER BY in_deg DESC, id) AS rank FROM deg",
    "removal_order_random": _DEG + "SELECT id, row_number() OVER (ORDER BY md5('42:' || id::VARCHAR), id) AS rank FROM deg",
    "active_degrees": _with(DENSE, "ac AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY in_deg DESC, id) AS r, count(*) OVER () AS n FROM deg) WHERE r > n // 10)", "ae AS (SELECT * FROM e WHERE src IN (SELECT id FROM ac) AND dst IN (SELECT id FROM ac))") + "SELECT id, (SELECT count(*) FROM ae WHERE dst = id) AS in_deg, (SELECT count(*) FROM ae WHERE src = id) AS out_deg FROM ac",
    "robustness_attack": _robust("attack"),
    "robustness_random": _robust("random"),
    "speedup_series": "SELECT threads, throughput, round(throughput / first_value(throughput) OVER (ORDER BY threads), 6) AS speedup FROM (VALUES " + ", ".join(f"({a}, {b}::DOUBLE)" for a, b in THROUGHPUT) + ") t(threads, throughput)",
}


# ----------------------------------------------------------------------- analyses


def _tidy(part: str, sql: str, key: str = "NULL", x: str = "NULL", y: str = "NULL", places: int = 6) -> str:
    return f"SELECT '{part}' AS part, ({key})::VARCHAR AS key, round(({x})::DOUBLE, {places}) AS x, round(({y})::DOUBLE, {places}) AS y FROM ({sql})"


def _facts(part: str, sql: str, *columns: str, places: int = 6) -> str:
    names, values = ", ".join(f"'{c}'" for c in columns), ", ".join(f"{c}::DOUBLE" for c in columns)
    return f"SELECT '{part}' AS part, unnest([{names}]) AS key, NULL::DOUBLE AS x, round(unnest([{values}]), {places}) AS y FROM ({sql})"


def _all(*parts: str) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


def _fits(column: str, name: str) -> list[str]:
    o = ORACLE_SQL
    points = _with(DENSE, _ccdf(column)) + "SELECT k, x AS log_k, y AS log_ccdf FROM cc"
    exact = _with(DENSE, _ccdf(column)) + "SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM cc HAVING var_pop(x) > 0 AND var_pop(y) > 0"
    mle = _mle(column).replace("round(gamma, 6) AS gamma, round(ks, 6) AS ks", "gamma, ks")
    cdf = f"WITH m AS ({mle}), {DENSE.replace('e AS', 'e2 AS').replace('FROM e', 'FROM e2')} SELECT {column} AS value, (SELECT count(*) FROM deg b WHERE b.{column} >= x_min AND b.{column} <= a.{column}) / n_tail AS empirical, 1 - pow({column} / x_min, 1 - gamma) AS fitted FROM (SELECT DISTINCT {column} FROM deg) a, m WHERE {column} >= x_min"
    return [
        _facts(f"{name}_ols", o[f"powerlaw_ols_{name}"], "gamma", "r2", "slope", "intercept"), _tidy(f"{name}_ols_points", points, x="log_k", y="log_ccdf"), _tidy(f"{name}_ols_line", f"SELECT log_k, slope * log_k + intercept AS v FROM ({points}), ({exact})", x="log_k", y="v"),
        _facts(f"{name}_mle", o[f"powerlaw_mle_{name}"], "gamma", "x_min", "ks", "n_tail"), _tidy(f"{name}_mle_empirical", cdf, x="value", y="empirical"), _tidy(f"{name}_mle_fitted", cdf, x="value", y="fitted"),
    ]


def _components(kind: str) -> str:
    return _all(_facts("report", f"SELECT count(*) AS n_components, max(size) AS largest FROM ({ORACLE_SQL[kind]})", "n_components", "largest"), _tidy("sizes", f"SELECT size, count(*) AS n FROM ({ORACLE_SQL[kind]}) GROUP BY size", x="size", y="n"))


def _analyses() -> dict[str, str]:
    o = ORACLE_SQL
    raw_decay = _S_PAIRS + "SELECT regr_slope(y, k) AS slope, regr_intercept(y, k) AS intercept FROM (SELECT k, log10(count(*)) AS y FROM p WHERE k > 0 GROUP BY k)"
    raw_ck = _CLUS + "SELECT log10(k) AS x, log10(avg_c) AS y FROM cd WHERE k > 0 AND avg_c > 0"
    ck_fit = f"SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM ({raw_ck})"
    ranks = _RANK + "SELECT log10(row_number() OVER (ORDER BY x DESC, id)) AS x, log10(x) AS y FROM sc WHERE x > 0"
    rank_fit = f"SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM ({ranks})"
    errors = _RANK + "SELECT iter, norm, err FROM (SELECT iter, unnest(['l1', 'l2', 'linf']) AS norm, unnest([l1, l2, linf]) AS err FROM t) u WHERE iter <= (SELECT min(w.iter) FROM (SELECT iter, unnest(['l1', 'l2', 'linf']) AS norm, unnest([l1, l2, linf]) AS err FROM t) w WHERE w.norm = u.norm AND w.err < 1e-6)"
    top = _RANK + "SELECT row_number() OVER (ORDER BY round(x, 12) DESC, id) AS rank, id, x FROM sc ORDER BY rank LIMIT 20"
    robust = ["removed", "largest_wcc", "largest_scc", "rel_wcc", "rel_scc", "avg_distance", "diameter", "avg_in", "max_in", "avg_out", "max_out"]
    return {
        "run_power_law_fits": _all(*_fits("in_deg", "in"), *_fits("out_deg", "out")),
        "run_basic_statistics": _all(
            _facts("stats", o["graph_stats"].replace("sum(in_deg)::BIGINT AS in_sum", "sum(in_deg)::BIGINT AS in_sum, sum(out_deg)::BIGINT AS out_sum"), "v", "e", "in_sum", "out_sum", "avg_degree", "density", "dangling", places=9),
            _tidy("largest_in", o["graph_stats"], "max_in_url", y="max_in"), _tidy("largest_out", o["graph_stats"], "max_out_url", y="max_out"), _tidy("dangling_pages", o["dangling"], "id", x="id"),
            *[_tidy(f"{n}_degree", o[f"{n}_degree_hist"], x="value", y="n") for n in ("out", "in")], *[_tidy(f"{n}_degree_loglog", o[f"degree_loglog_{n}"], x="log_k", y="log_n") for n in ("out", "in")],
            *_fits("in_deg", "in"), *_fits("out_deg", "out"),
        ),
        "run_scc_analysis": _components("scc_sizes"),
        "run_wcc_analysis": _components("wcc_sizes"),
        "run_bow_tie_analysis": _all(_tidy("report", f"SELECT r.region, coalesce(n, 0) AS n FROM (VALUES ('CORE'), ('IN'), ('OUT'), ('TENDRILS')) r(region) LEFT JOIN ({o['bowtie_counts']}) c ON c.region = r.region", "region", y="n"), _tidy("out_pages", f"SELECT id FROM ({o['bowtie']}) WHERE region = 'OUT'", "id", x="id")),
        "build_condensation": _all(_facts("report", f"SELECT (SELECT count(*) FROM ({o['condensation_nodes']})) AS dag_nodes, (SELECT count(*) FROM ({o['condensation_edges']})) AS dag_edges", "dag_nodes", "dag_edges"), _tidy("dag_edges", o["condensation_edges"], x="src_comp", y="dst_comp")),
        "run_bfs_analysis": _all(
            _facts("report", o["bfs_summary"], "avg_distance", "diameter", "radius", "reachable_pairs", "ratio_ln", "ratio_log2"), _facts("report", o["distance_decay_fit"], "slope", "r2"),
            _tidy("first_avg_distance", o["bfs_vertex"] + " ORDER BY id LIMIT 10", x="id", y="avg_dist"), _tidy("first_eccentricity", o["bfs_vertex"] + " ORDER BY id LIMIT 10", x="id", y="ecc"),
            _tidy("eccentricity", o["eccentricity_hist"], x="value", y="n"), _tidy("pair_distance", o["pair_distance_hist"], x="distance", y="pairs"),
            _tidy("pair_distance_fitted", f"SELECT distance, pow(10, slope * distance + intercept) AS v FROM ({o['pair_distance_hist']}), ({raw_decay})", x="distance", y="v", places=3),
        ),
        "run_clustering_analysis": _all(
            _facts("report", f"SELECT global_c, slope, pow(10, intercept) AS coefficient FROM ({o['clustering_global']}), ({ck_fit})", "global_c", "slope", "coefficient"), _tidy("local", o["clustering_hist"], x="bin", y="n"),
            _tidy("by_degree_loglog", raw_ck, x="x", y="y"), _tidy("by_degree_line", f"SELECT x, slope * x + intercept AS v FROM ({raw_ck}), ({ck_fit})", x="x", y="v"),
        ),
        "run_page_rank_analysis": _all(
            _tidy("report", f"SELECT max(iter) AS n FROM ({errors}) WHERE norm = 'l1'", "'iterations'", y="n"), _facts("report", rank_fit, "slope", places=4),
            _tidy("iterations", o["pagerank_sweep"], "norm", "d", "iterations"), _tidy("iterations_log", o["pagerank_sweep"], "norm", "d", "log10(iterations)"),
            _tidy("ranks_loglog", ranks, x="x", y="y"), _tidy("ranks_line", f"SELECT x, slope * x + intercept AS v FROM (SELECT unnest([min(x), max(x)]) AS x FROM ({ranks})), ({rank_fit})", x="x", y="v", places=4),
            _tidy("convergence", errors, "norm", "iter", "log10(greatest(err, 1e-15))", 4), _tidy("top", top, "id", "rank", "x * 1e6", 3),
        ),
        "run_connectivity_analysis": _all(
            _facts("report", f"SELECT (SELECT count(*) FROM ({o['articulation_points']})) AS articulation_points, (SELECT count(*) FROM ({o['bridges']})) AS bridges", "articulation_points", "bridges"),
            _tidy("first_points", f"SELECT id FROM ({o['articulation_points']}) ORDER BY id LIMIT 10", x="id"), _tidy("first_bridges", f"SELECT u, v FROM ({o['bridges']}) ORDER BY u, v LIMIT 10", x="u", y="v"),
        ),
        "run_robustness_analysis": _all(*[_tidy(f"{s}_{c}", o[f"robustness_{s}"], f"'{s}'", "fraction", c) for s in ("random", "attack") for c in robust]),
    }


ORACLE_SQL |= _analyses()
#: The crawl by its definition: pages that may be fetched, breadth first from the one with most links.
_SITE = _rec(
    DENSE,
    "ok AS MATERIALIZED (SELECT id FROM v WHERE id % 10 NOT IN (3, 5, 7))",
    "seed AS (SELECT id FROM ok JOIN deg USING (id) ORDER BY out_deg DESC, id LIMIT 1)",
    """c(id, level) USING KEY (id) AS (SELECT id, 0 FROM seed UNION
      SELECT DISTINCT e.dst, c.level + 1 FROM c JOIN e ON e.src = c.id JOIN ok ON ok.id = e.dst LEFT JOIN recurring.c AS r ON r.id = e.dst WHERE r.id IS NULL)""",
    "site AS MATERIALIZED (SELECT id, level, 'http://site/p/' || id AS url FROM c ORDER BY level, url LIMIT 500)",
)
ORACLE_SQL |= {
    "site_crawl": _SITE + "SELECT url AS Url, level FROM site",
    "site_outlinks": _SITE + "SELECT url AS Url, 'http://site/p/' || dst AS link FROM site JOIN e ON e.src = site.id",
    "site_graph_edges": _SITE.rstrip() + ", n AS (SELECT id, row_number() OVER (ORDER BY url) - 1 AS i FROM site) SELECT a.i AS src, b.i AS dst FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst",
}
