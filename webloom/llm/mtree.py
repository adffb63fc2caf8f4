"""Exact top-k search with M-trees, searched best first.

Inner products become distances by one more component: with M the largest squared norm of all vectors, x' = (x, sqrt(M - |x|^2))
and q' = (q, 0), |q' - x'|^2 = |q|^2 + M - 2 q.x, so the largest inner products are the nearest
neighbours in a metric space.

The vectors are dealt to the nearest of some sampled pivots, and a pivot's vectors to shards of about SHARD_ROWS.  Each shard is bulk-loaded once
into an M-tree whose nodes are pages: a routing object, a covering radius, the distance to the parent's routing object, and either child
pages or entries with their distances to the page's routing object.  The pages are written to the shared folder.

Queries travel in blocks of about BLOCK_ROWS near one pivot.  A block first searches a shard of its own pivot; the k-th best scores found there are
limits, and it then goes to the shards of only those pivots whose covering radius lets them hold something as good.  In a
shard, a queue holds pages by the least distance that they can have for any query of the block.  A page is left out for a query, without
computing its distance, where |d(q, parent) - d(page, parent)| - radius is beyond the query's limit; a leaf's entries likewise,
by their stored distances.  What bounds can't rule out is computed for all waiting queries in one matrix product, so that where nothing can be pruned
(random directions in many dimensions) the search costs no more than the products.  Bounds carry a margin for rounding; scores are exact.

Nulls, ties and odd rows: vectors that are null, or hold null or non-finite components, take no part; neither do rows with a null id.  Ties
go to the smaller id.  Rows that share an id are all candidates and all queries, each query row with k results of its own; only rows with the
query's own id are left out.  Shorter vectors count as filled up with zeros to the longest one's length.  Components beyond the
range of a long stand at its ends, and so do scores.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import limit_arrow_batches, materialise

SHARD_ROWS = 16_384
BLOCK_ROWS = 512
#: Blocks that meet a shard in one task.
GROUP_BLOCKS = 64
#: Pivots are broadcast: at most so many, and at most so many numbers in them.
MAX_PIVOTS, PIVOT_CELLS = 4_096, 1 << 20
#: Numbers in a shard; longer vectors make smaller shards.
SHARD_CELLS = 1 << 22
PAGE = 128
FANOUT = 16
MARGIN = 1e-6
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """x' of each vector."""
    x = vectors.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0.0))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))


class Tree:
    """Pages as arrays.  Children of a page stand side by side, and so do the entries of a leaf, nearest to its routing object first."""

    def __init__(self, ids, vectors, top, routing, radius, to_parent, first, size, leaf, far):
        self.ids, self.vectors, self.top, self.routing, self.radius, self.to_parent = ids, vectors, top, routing, radius, to_parent
        self.first, self.size, self.leaf, self.far = first, size, leaf, far
        # float64 holds integers up to 2**53
        self.largest = float(np.abs(vectors.astype(np.float64)).max()) if vectors.size else 0.0
        self.numbers = vectors.astype(np.float64)

    @classmethod
    def load(cls, ids: np.ndarray, vectors: np.ndarray, top: float) -> Tree:
        """Bulk-load: sample routing objects, give each row to the nearest, go on in each part."""
        rng = np.random.default_rng(1)
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        points = lifted(vectors, top)
        todo, to_parent = [(np.arange(len(ids)), points.mean(axis=0))] if len(ids) else [], [0.0]
        routing, radius, first, size, leaf, perm, fars, at = [], [], [], [], [], [], [], 0
        while len(routing) < len(todo):
            rows, centre = todo[len(routing)]
            todo[len(routing)] = None
            far = np.sqrt(((points[rows] - centre) ** 2).sum(axis=1))
            routing.append(centre)
            radius.append(far.max())
            leaf.append(len(rows) <= PAGE or far.max() == 0)
            by = np.argsort(far, kind="stable")
            if leaf[-1]:
                first.append(at)
                size.append(len(rows))
                perm.append(rows[by])
                fars.append(far[by])
                at += len(rows)
                continue
            nearest = distances(points[rows], points[rng.choice(rows, FANOUT, replace=False)]).argmin(axis=1)
            parts = [p for p in (rows[nearest == i] for i in range(FANOUT)) if len(p)]
            if len(parts) == 1:  # all as near to one: halve by distance, so that loading ends
                parts = [rows[by[: len(by) // 2]], rows[by[len(by) // 2 :]]]
            first.append(len(todo))
            size.append(len(parts))
            for p in parts:
                todo.append((p, points[p].mean(axis=0)))
                to_parent.append(float(np.sqrt(((todo[-1][1] - centre) ** 2).sum())))
        perm = np.concatenate(perm) if perm else np.zeros(0, np.int64)
        dim = vectors.shape[1] + 1
        return cls(ids[perm], vectors[perm], top, np.array(routing).reshape(-1, dim), np.array(radius), np.array(to_parent[: len(routing)]), np.array(first, np.int64), np.array(size, np.int64), np.array(leaf, bool), np.concatenate(fars) if fars else np.zeros(0))

    def scores(self, a: int, b: int, queries: np.ndarray, numbers: np.ndarray, largest: float) -> np.ndarray:
        """Inner products of each query with entries a to b."""
        if self.vectors.shape[1] * self.largest * largest < 2.0**53:
            return (numbers @ self.numbers[a:b].T).astype(np.int64)
        exact = queries.astype(object) @ self.vectors[a:b].astype(object).T
        return np.clip(exact, LEAST, MOST).astype(np.int64)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and ids of each query's k best, best first (LEAST and MOST where there are fewer), and how many distances were computed.

        floor: scores under it aren't wanted.
        """
        n = len(queries)
        score, who = np.full((n, k), LEAST), np.full((n, k), MOST)
        floor = np.full(n, LEAST) if floor is None else floor
        numbers = queries.astype(np.float64)
        largest, base = float(np.abs(numbers).max()) if numbers.size else 0.0, (numbers * numbers).sum(axis=1) + self.top
        points, computed = np.concatenate([numbers, np.zeros((n, 1))], axis=1), 0
        worst = np.maximum(score[:, -1], floor)

        def limit_of(rows):
            far = np.sqrt(np.maximum(base[rows] - 2.0 * worst[rows], 0.0)) + MARGIN * np.sqrt(base[rows]) + MARGIN
            return np.where(worst[rows] == LEAST, np.inf, far)

        limit = limit_of(slice(None))
        queue: list[tuple[float, int]] = []
        low, dist = {}, {}
        if len(self.ids) and n and k:
            dist[0] = distances(points, self.routing[:1])[:, 0]
            low[0], computed = dist[0] - self.radius[0], n
            queue = [(float(low[0].min()), 0)]
        while queue:
            _, page = heapq.heappop(queue)
            waiting = np.flatnonzero(low.pop(page) <= limit)
            d = dist.pop(page)[waiting]
            if not len(waiting):
                continue
            a, many = int(self.first[page]), int(self.size[page])
            if not self.leaf[page]:
                kids = np.arange(a, a + many)
                may = np.abs(d[:, None] - self.to_parent[kids]) - self.radius[kids] <= limit[waiting][:, None]
                kids = kids[may.any(axis=0)]
                some = may.any(axis=1)
                waiting, may = waiting[some], may[np.ix_(some, may.any(axis=0))]
                to = distances(points[waiting], self.routing[kids])
                computed += to.size
                for j, kid in enumerate(kids.tolist()):
                    dist[kid], low[kid] = np.zeros(n), np.full(n, np.inf)
                    dist[kid][waiting] = to[:, j]
                    low[kid][waiting] = np.where(may[:, j], to[:, j] - self.radius[kid], np.inf)
                    least = float(low[kid].min())
                    heapq.heappush(queue, (least, kid))
                continue
            far = self.far[a : a + many]
            begin, end = np.searchsorted(far, d - limit[waiting]), np.searchsorted(far, d + limit[waiting], side="right")
            some = begin < end
            if not some.any():
                continue
            waiting, begin, end = waiting[some], int(begin[some].min()), int(end[some].max())
            found = self.scores(a + begin, a + end, queries[waiting], numbers[waiting], largest)
            computed += found.size
            ids = self.ids[a + begin : a + end]
            q, e = np.nonzero((found >= worst[waiting][:, None]) & (ids != own[waiting][:, None]))
            if not len(q):
                continue
            rows, place = np.unique(q, return_inverse=True)
            into = waiting[rows]
            every = (np.concatenate([place, np.repeat(np.arange(len(rows)), k)]), np.concatenate([found[q, e], score[into].reshape(-1)]), np.concatenate([ids[e], who[into].reshape(-1)]))
            # descending scores: ~s is -s - 1, which never overflows
            by = np.lexsort((every[2], ~every[1], every[0]))
            edge = np.searchsorted(every[0][by], np.arange(len(rows)))
            best = by[edge[:, None] + np.arange(k)]
            score[into], who[into] = every[1][best], every[2][best]
            worst[into] = np.maximum(score[into, -1], floor[into])
            limit[into] = limit_of(into)
        return score, who, computed


# ------------------------------------------------------------------------------ Spark


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows, short ones filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = flat
    return out


def _near(pivots: np.ndarray, top: float, dim: int):
    """Each vector with its nearest pivot, the distance to it, and itself packed."""
    schema = pa.schema([("pivot", pa.int64()), ("far", pa.float64()), ("id", pa.int64()), ("v", pa.binary())])

    def run(batches):
        to = lifted(pivots, top)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                vectors = _matrix(part.column(1), dim)
                d = distances(lifted(vectors, top), to)
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * dim), len(vectors), [None, pa.py_buffer(np.ascontiguousarray(vectors))])
                yield pa.RecordBatch.from_arrays([pa.array(d.argmin(axis=1)), pa.array(d.min(axis=1)), part.column(0), flat.cast(pa.binary())], schema=schema)

    return run


def _unpacked(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), dim)


_PAGES = ("ids", "vectors", "routing", "radius", "to_parent", "first", "size", "leaf", "far")
_KINDS = (np.int64, np.int64, np.float64, np.float64, np.float64, np.int64, np.int64, bool, np.float64)


def _loaded(dim: int, top: float):
    """A shard's vectors as the pages of its tree, packed."""
    schema = pa.schema([("shard", pa.int64()), *[(name, pa.binary()) for name in _PAGES]])

    def run(table: pa.Table) -> pa.Table:
        tree = Tree.load(table.column("id").to_numpy(), _unpacked(table.column("v"), dim), top)
        return pa.Table.from_arrays([pa.array([table.column("shard")[0].as_py()], pa.int64()), *[pa.array([np.ascontiguousarray(getattr(tree, name)).tobytes()], pa.binary()) for name in _PAGES]], schema=schema)

    return run


def _packed(dim: int):
    """A block of queries as one row."""
    schema = pa.schema([("block", pa.int64()), ("pivot", pa.int64()), ("q_ids", pa.binary()), ("q_vectors", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([table.column("block")[:1].combine_chunks(), table.column("pivot")[:1].combine_chunks(), pa.array([table.column("id").to_numpy().tobytes()], pa.binary()), pa.array([_unpacked(table.column("v"), dim).tobytes()], pa.binary())], schema=schema)

    return run


def _search(dim: int, top: float, k: int):
    """What the blocks that meet a shard find in it: a row for each block, matrices of scores and ids."""
    schema = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("q_ids", pa.binary()), ("scores", pa.binary()), ("who", pa.binary()), ("computed", pa.int64())])

    def run(pages: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if pages.num_rows and asked.num_rows:
            parts = [np.frombuffer(pages.column(name)[0].as_py(), kind) for name, kind in zip(_PAGES, _KINDS, strict=True)]
            parts[1], parts[2] = parts[1].reshape(len(parts[0]), dim), parts[2].reshape(-1, dim + 1)
            tree = Tree(parts[0], parts[1], top, *parts[2:])
            for block, shard, q_ids, q_vectors, floor in zip(*[asked.column(c).to_pylist() for c in ("block", "shard", "q_ids", "q_vectors", "floor")], strict=True):
                ids = np.frombuffer(q_ids, np.int64)
                score, who, computed = tree.search(np.frombuffer(q_vectors, np.int64).reshape(len(ids), dim), ids, k, None if floor is None else np.frombuffer(floor, np.int64))
                out.append((block, shard, q_ids, score.tobytes(), who.tobytes(), computed))
        return pa.Table.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def _routed(pivots: np.ndarray, radius: np.ndarray, parts: np.ndarray, top: float, dim: int, k: int):
    """Blocks with the k-th best scores of their first search, once for each further shard that may hold something as good."""
    schema = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("q_ids", pa.binary()), ("q_vectors", pa.binary()), ("floor", pa.binary())])

    def run(batches):
        to = lifted(pivots, top)
        for batch in batches:
            for block, home, q_ids, q_vectors, scores in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids = np.frombuffer(q_ids, np.int64)
                q = np.frombuffer(q_vectors, np.int64).reshape(len(ids), dim).astype(np.float64)
                floor = np.ascontiguousarray(np.frombuffer(scores, np.int64).reshape(len(ids), k)[:, -1])
                base = (q * q).sum(axis=1) + top
                limit = np.where(floor == LEAST, np.inf, np.sqrt(np.maximum(base - 2.0 * floor, 0.0)) + MARGIN * np.sqrt(base) + MARGIN)
                far = distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), to)
                for pivot in np.flatnonzero((far - radius <= limit[:, None]).any(axis=0)).tolist():
                    shards = [s for s in ((pivot << 32) + i for i in range(int(parts[pivot]))) if s != home]
                    for a in range(0, len(shards), 64):
                        own = shards[a : a + 64]
                        yield pa.RecordBatch.from_arrays([pa.array([x] * len(own) if f.name != "shard" else own, f.type) for x, f in zip((block, None, q_ids, q_vectors, floor.tobytes()), schema, strict=True)], schema=schema)

    return run


def _rows(k: int):
    schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        for batch in batches:
            for block, q_ids, scores, who in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids, score, found = np.frombuffer(q_ids, np.int64), np.frombuffer(scores, np.int64), np.frombuffer(who, np.int64)
                at = np.flatnonzero((score != LEAST) | (found != MOST))
                yield pa.RecordBatch.from_arrays([pa.array((block << 32) + at // k), pa.array(ids[at // k]), pa.array(found[at]), pa.array(score[at])], schema=schema)

    return run


def _met(trees: DataFrame, asked: DataFrame, groups: int, dim: int, top: float, k: int) -> DataFrame:
    """Trees and query blocks by shard, GROUP_BLOCKS blocks to a task."""
    asked = asked.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    spread = trees.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>"))) if groups > 1 else trees.withColumn("group", F.lit(0).cast("long"))
    return spread.groupBy("shard", "group").cogroup(asked.groupBy("shard", "group")).applyInArrow(_search(dim, top, k), "block long, shard long, q_ids binary, scores binary, who binary, computed long")


def searched(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame | None:
    """What each block found in each shard it met, packed, with the number of distances computed; None without vectors or queries."""
    spark = vectors.sparkSession
    limit_arrow_batches(spark)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, dim, top = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    if not n:
        return None
    dim = max(1, dim)
    rows = max(1, min(SHARD_ROWS, SHARD_CELLS // dim))
    wanted = max(1, min(MAX_PIVOTS, PIVOT_CELLS // dim, math.ceil(n / rows)))
    sampled = vectors.orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").toArrow()
    pivots = np.unique(_matrix(sampled.column("v"), dim), axis=0)
    kind = "pivot long, far double, id long, v binary"
    placed = materialise(vectors.select("id", "v").mapInArrow(_near(pivots, top, dim), kind), "mtree-placed")
    # a row for each pivot
    radius, parts = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        radius[r.pivot], parts[r.pivot] = r.far * (1 + MARGIN) + MARGIN, math.ceil(r.n / rows)
    ways = spark.createDataFrame([(i, int(p)) for i, p in enumerate(parts)], "pivot long, parts long")
    sharded = placed.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(ways), "pivot")
    shard = F.shiftleft("pivot", 32) + F.pmod(F.xxhash64("row"), F.col("parts"))
    trees = materialise(sharded.select(shard.alias("shard"), "id", "v").groupBy("shard").applyInArrow(_loaded(dim, top), "shard long, " + ", ".join(f"{name} binary" for name in _PAGES)), "mtree-pages")

    near = materialise(queries.select("id", "v").mapInArrow(_near(pivots, top, dim), kind), "mtree-asked")
    counts, at, starts = {r.pivot: r.n for r in near.groupBy("pivot").agg(F.count("*").alias("n")).collect()}, 0, []
    if not counts:
        return None
    for pivot, many in sorted(counts.items()):
        starts.append((pivot, at, math.ceil(many / BLOCK_ROWS)))
        at += starts[-1][2]
    begin = spark.createDataFrame(starts, "pivot long, begin long, many long")
    own = near.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(begin), "pivot")
    own = own.select((F.col("begin") + F.pmod(F.xxhash64("row"), F.col("many"))).alias("block"), "pivot", "id", "v")
    blocks = materialise(own.groupBy("block").applyInArrow(_packed(dim), "block long, pivot long, q_ids binary, q_vectors binary"), "mtree-queries")

    groups = math.ceil(at / GROUP_BLOCKS)
    home = F.shiftleft("pivot", 32) + F.pmod(F.col("block"), F.col("parts"))
    asked = blocks.join(F.broadcast(ways), "pivot").select("block", home.alias("shard"), "q_ids", "q_vectors", F.lit(None).cast("binary").alias("floor"))
    first = materialise(_met(trees, asked, groups, dim, top, k), "mtree-found")
    known = blocks.select("block", "q_vectors").join(first.select("block", "shard", "q_ids", "scores"), "block").select("block", "shard", "q_ids", "q_vectors", "scores")
    further = known.mapInArrow(_routed(pivots, radius, parts, top, dim, k), "block long, shard long, q_ids binary, q_vectors binary, floor binary")
    return first.union(materialise(_met(trees, further, groups, dim, top, k), "mtree-found"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) from vectors (id, v array<long>) and queries (id, v)."""
    found = searched(vectors, queries, k)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = found.select("block", "q_ids", "scores", "who").mapInArrow(_rows(k), "row long, query_id long, vec_id long, score long")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): floor(64 * component) of the vectors that take part."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = table.filter(F.col(id_col).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    return good.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * 64)).alias("v"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    table = quantised(read(spark, sf_dir, "embeddings"))
    return top_k(table, table.filter(F.col("id") % 20 == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
