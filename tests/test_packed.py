"""What runs in tasks on a graph of arrays: equal to definitions and to the joins, in jobs that don't grow with the rounds."""

import random
import uuid

import numpy as np
import pytest

from webloom import packed, series, service
from webloom.operators import pagerank, robustness

from .test_graph import graph, rows

FIELDS = ("largest_wcc", "largest_scc", "avg_distance", "diameter", "avg_in", "max_in", "avg_out", "max_out")


def jobs_of(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def some_edges(n, m, seed):
    r = random.Random(seed)
    return sorted({(r.randrange(n) * 3, r.randrange(n) * 3) for _ in range(m)} | {(3 * n, 3 * n)})


def reached(edges, v):
    dist, front, k = {v: 0}, {v}, 0
    while front:
        k += 1
        front = {b for a, b in edges if a in front} - set(dist)
        dist |= dict.fromkeys(front, k)
    return dist


def by_definition(edges, order, removed):
    """FIELDS of what is left without the first vertices of the order."""
    here = set(order[removed:])
    edges = [e for e in edges if here.issuperset(e)]
    near = {v: set(reached(edges + [(b, a) for a, b in edges], v)) for v in here}
    dist = {v: reached(edges, v) for v in here}
    strong = {v: {w for w in dist[v] if v in dist[w]} for v in here}
    wcc = max(map(len, near.values()))
    inside = next(near[v] for v in sorted(here) if len(near[v]) == wcc)
    means = [sum(d.values()) / (len(d) - 1) for v, d in dist.items() if v in inside and len(d) > 1]
    ins, outs = ([sum(e[i] == v for e in edges) for v in here] for i in (1, 0))
    return (wcc, max(map(len, strong.values())), sum(means) / len(means) if means else 0, max(max(dist[v].values()) for v in inside), sum(ins) / len(ins), max(ins), sum(outs) / len(outs), max(outs))


def check_robustness(spark, strategy, limit, monkeypatch):
    monkeypatch.setattr(packed, "LIMIT", limit)
    monkeypatch.setattr(packed, "PAIRS", 40)
    edges = some_edges(24, 34, 3)
    g = graph(spark, edges)
    order = [i for i, _ in sorted(rows(robustness.removal_order(g, strategy)), key=lambda x: x[1])]
    fractions = (0.05, 0.3) if limit < 0 else (0.05, 0.2, 0.1, 0.5, 0.9)
    got = robustness.simulate(g, strategy, fractions).collect()
    assert sorted(r.fraction for r in got) == sorted(fractions)
    for r in got:
        assert [round(r[f], 9) for f in FIELDS] == [round(x, 9) for x in by_definition(edges, order, r.removed)]


@pytest.mark.parametrize("limit", [packed.LIMIT, -1])
def test_attack_by_definition(spark, limit, monkeypatch):
    check_robustness(spark, "attack", limit, monkeypatch)


def test_attack_on_a_chain_takes_no_jobs_a_round(spark):
    g = graph(spark, [(i, i + 1) for i in range(60)])
    got, jobs = jobs_of(spark, lambda: robustness.simulate(g, "attack", (0.0, 0.5)).collect())
    # in-degree 1 but for vertex 0: attack takes 1, 2, ... and leaves 0 and a chain
    assert {r.removed: (r.largest_wcc, r.diameter, r.largest_scc) for r in got} == {0: (61, 60, 1), 30: (30, 29, 1)}
    assert jobs < 60


@pytest.mark.parametrize("seed", range(6))
def test_components_of_arrays(spark, seed):
    n = 40
    edges = np.array(sorted({(a // 3, b // 3) for a, b in some_edges(n - 1, 30 + 10 * seed, seed)}))
    pairs = [tuple(e) for e in edges.tolist()]
    weak, strong = packed.weak(n, edges[:, 0], edges[:, 1]), packed.strong(n, edges[:, 0], edges[:, 1])
    dist = [reached(pairs, v) for v in range(n)]
    both = pairs + [(b, a) for a, b in pairs]
    assert weak.tolist() == [min(reached(both, v)) for v in range(n)]
    assert [{w for w in range(n) if strong[w] == strong[v]} for v in range(n)] == [{w for w in dist[v] if v in dist[w]} for v in range(n)]


def test_a_long_cycle_is_one_component():
    n = 20000
    at = np.arange(n)
    assert len(set(packed.strong(n, at, (at + 1) % n))) == 1 and set(packed.weak(n, at, (at + 1) % n)) == {0}
    assert len(set(packed.strong(n, at[:-1], at[1:]))) == n


def test_null_or_large_graphs_take_the_joins(spark, monkeypatch):
    g = graph(spark, [(0, 1), (1, 2)])
    assert packed.of(g).value.first.tolist() == [0, 1, 2, 2]
    holes = spark.createDataFrame([(0, 1), (None, 1)], "src long, dst long")
    assert packed.of(type(g)(g.vertices, holes)) is None
    monkeypatch.setattr(packed, "LIMIT", 4)
    assert packed.of(type(g)(g.vertices, g.edges)) is None


def rank_by_definition(edges, d, norm, epsilon, most):
    ids = sorted({x for e in edges for x in e})
    outs = {v: [b for a, b in edges if a == v] for v in ids}
    x, trace = dict.fromkeys(ids, 1 / len(ids)), []
    while len(trace) < most:
        loose = sum(x[v] for v in ids if not outs[v])
        new = {v: (1 - d + d * loose) / len(ids) for v in ids}
        for v in ids:
            for b in outs[v]:
                new[b] += d * x[v] / len(outs[v])
        step = [abs(new[v] - x[v]) for v in ids]
        x = new
        trace.append((sum(step), sum(s * s for s in step) ** 0.5, max(step)))
        if trace[-1][("l1", "l2", "linf").index(norm)] < epsilon:
            break
    return x, trace


@pytest.mark.parametrize("limit,norm", [(packed.LIMIT, "l1"), (packed.LIMIT, "linf"), (-1, "l1")])
def test_rank_by_definition(spark, limit, norm, monkeypatch):
    monkeypatch.setattr(packed, "LIMIT", limit)
    edges = some_edges(20, 40, 7) + [(1000, 1002), (1002, 1000)]
    run = pagerank.pagerank(graph(spark, edges), (1.0, 0.85, 0.5), norm, 1e-3, 9)
    assert [t[:2] for t in run.trace] == sorted((t[:2] for t in run.trace), key=lambda t: (t[1], -t[0]))
    for d in (1.0, 0.85, 0.5):
        x, trace = rank_by_definition(edges, d, norm, 1e-3, 9)
        one = pagerank.only(run, d)
        assert [(i, round(a, 12)) for i, a in rows(one.scores.select("id", "score"))] == [(i, round(a, 12)) for i, a in sorted(x.items())]
        assert [(t[1], *[round(a, 12) for a in t[2:]]) for t in one.trace] == [(i, *[round(a, 12) for a in t]) for i, t in enumerate(trace, 1)]


def test_rank_analysis_takes_no_jobs_a_step(spark):
    # two weights that swap, so that d = 1.0 goes on to the last step
    g = graph(spark, [(0, 1), (0, 2), (1, 0), (2, 0)])
    many, jobs = jobs_of(spark, lambda: pagerank.pagerank(g, pagerank.DAMPINGS, max_iter=None))
    assert sum(t[0] == 1.0 for t in many.trace) == pagerank.ENDLESS and jobs < 20
    g.kept["sweep"] = many
    parts, more = jobs_of(spark, lambda: {k: rows(v) for k, v in service.page_rank_analysis(g, 2).items()})
    assert parts["report"][0] == ("iterations", None, float(sum(t[0] == 0.85 for t in many.trace))) and more < 100


def test_random_by_definition(spark, monkeypatch):
    check_robustness(spark, "random", packed.LIMIT, monkeypatch)


def test_random_on_a_chain_takes_no_jobs_a_round(spark):
    g = graph(spark, [(i, i + 1) for i in range(60)])
    got, jobs = jobs_of(spark, lambda: robustness.simulate(g, "random", (0.0,)).collect())
    # L reached vertices are (L + 1) / 2 away on average, for L = 1 to 60
    assert (got[0].largest_wcc, got[0].largest_scc, got[0].diameter, got[0].avg_distance) == (61, 1, 60, 15.75) and jobs < 60


def test_robustness_analysis_reads_kept_rows(spark):
    g = graph(spark, [(i, i + 1) for i in range(40)])
    parts, jobs = jobs_of(spark, lambda: service.robustness_analysis(g))
    assert jobs < 100
    got, more = jobs_of(spark, lambda: rows(series.together(parts)))
    assert len(got) == 22 * 7 and more < 30
    assert all("MapInArrow" not in df._jdf.queryExecution().toString() for df in parts.values())
