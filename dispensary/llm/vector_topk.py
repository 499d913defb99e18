"""Exact top-k by inner product: ball-tree branch and bound per shard, under a shared k-th score.

The space is cut into regions by a ball tree over a bounded sample; every vector is put into a region, and large
regions are dealt out over several shards.  An upper bound on the score of a query q in a ball with centre c and
radius r is q.c + |q| r.  Each query first searches the region with the highest bound, which gives a k-th score; it
then goes only to the regions whose bound reaches that score.  A shard's own vectors form a ball tree.  A query
goes down it from the root, at every node first into the child with the higher bound, and leaves out a node whose
bound is under its k-th score so far, which starts from the shared one; queries that go the same way go together.
The sample shapes the regions; it never decides which vectors are searched.

A region's vectors are sent once for each block of the queries that visit it, a query once for each shard of a region
that it visits.  Both numbers follow the work that the bounds leave to do, not the size of the table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispensary.llm._spark import checkpointed

#: Rows of the sample that shapes the regions, most regions, vectors in a shard, queries in a block, vectors in a leaf.
SAMPLE, REGIONS, SHARD, BLOCK, LEAF = 4096, 256, 8192, 16384, 256
#: Queries that a leaf scores at a time.
SCORED = 4096


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int, *more: str) -> DataFrame:
    """(id, vec) and `more` columns, with floor(scale * x); without vectors that are null or hold null or non-finite components."""
    x = F.col(vec_col).cast("array<double>")
    df = df.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), *more).filter(F.col("id").isNotNull() & F.col("x").isNotNull())
    x = F.col("x")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.filter(F.coalesce(sound, F.lit(False))).select("id", F.transform("x", lambda v: F.floor(v * scale)).alias("vec"), *more)


def matrix(column, width: int = 0) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.diff(np.asarray(column.offsets)).astype(np.int64)
    width = max(width, int(n.max(initial=0)))
    flat = np.asarray(column.flatten())
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), flat.dtype)
    out[np.arange(width) < n[:, None]] = flat
    return out


def split_balls(x: np.ndarray, most: int, leaves: int) -> list[np.ndarray]:
    """Row numbers of up to `leaves` balls: the largest is halved along its widest direction until all hold `most`."""
    parts, done = [np.arange(len(x))], []
    while parts and len(parts) + len(done) < leaves:
        i = max(range(len(parts)), key=lambda k: len(parts[k]))
        rows = parts.pop(i)
        if len(rows) <= most:
            parts.append(rows)
            break
        own = x[rows]
        a = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
        b = own[np.argmax(((own - a) ** 2).sum(axis=1))]
        along = own @ (b - a)
        if along.max() == along.min():  # all alike
            done.append(rows)
            continue
        half = np.argsort(along, kind="stable")
        parts += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
    return parts + done


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if top < 2**63:
        return q @ v.T
    return (q.astype(object) @ v.astype(object).T).astype(np.int64)


class Ball:
    """A node of a ball tree: centre, radius, and two children or the rows of a leaf."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, leaf: int):
        self.centre = x[rows].mean(axis=0)
        self.radius = float(np.sqrt(((x[rows] - self.centre) ** 2).sum(axis=1).max()))
        halves = split_balls(x[rows], leaf, 2)
        self.rows = rows if len(halves) < 2 else None
        self.children = [] if len(halves) < 2 else [Ball(x, rows[h], leaf) for h in halves]


def search(vec_ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector id, score) of each query's k best; scores under `floor` may be left out."""
    low, none = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    scores, ids = np.full((len(queries), k), low), np.full((len(queries), k), none)
    exact, q = vectors.astype(np.float64), queries.astype(np.float64)
    norms, longest = np.sqrt((q**2).sum(axis=1)), np.sqrt((exact**2).sum(axis=1).max())
    kth = floor.astype(np.float64)

    def bound(node: Ball, rows: np.ndarray) -> np.ndarray:
        out = q[rows] @ node.centre + norms[rows] * node.radius
        return out + 1e-9 * (np.abs(out) + norms[rows] * longest) + 1e-6

    def scan(node: Ball, rows: np.ndarray) -> None:
        found = products(queries[rows], vectors[node.rows])
        own = np.broadcast_to(vec_ids[node.rows], found.shape)
        found = np.where(own == query_ids[rows][:, None], low, found)
        s, d = np.concatenate([scores[rows], found], axis=1), np.concatenate([ids[rows], np.where(found == low, none, own)], axis=1)
        best = np.lexsort((d, ~s), axis=1)[:, :k]  # ~s sorts in falling order of s
        scores[rows], ids[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(d, best, 1)
        kth[rows] = np.maximum(kth[rows], np.where(scores[rows, -1] == low, -np.inf, scores[rows, -1].astype(np.float64)))

    def visit(node: Ball, rows: np.ndarray, bounds: np.ndarray) -> None:
        rows = rows[bounds >= kth[rows]]
        if not len(rows):
            return
        if node.rows is not None:
            for i in range(0, len(rows), SCORED):
                scan(node, rows[i : i + SCORED])
            return
        a, b = node.children
        at_a, at_b = bound(a, rows), bound(b, rows)
        first = at_a >= at_b
        for child, at, who in ((a, at_a, first), (b, at_b, first), (b, at_b, ~first), (a, at_a, ~first)):
            visit(child, rows[who], at[who])

    root, everyone = Ball(exact, np.arange(len(exact)), leaf), np.arange(len(queries))
    visit(root, everyone, bound(root, everyone))
    row, column = np.nonzero(scores > low)
    return row, ids[row, column], scores[row, column]


def exact_top_k(df: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, regions: int = REGIONS, shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query(id column) holds for, its k best other rows.

    Components become floor(scale * x); the score is the integer inner product, ties go to the smaller id.  Vectors
    that are null or hold null or non-finite components take no part, nor do rows without an id; shorter vectors, empty
    ones included, count as filled up with zeros.  Rows that share an id are separate candidates, and separate queries
    give one list; a query never meets rows of its own id.  An empty table gives an empty result; other columns,
    whatever their names, are ignored.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, id_col, vec_col, scale)
    drawn = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    if not drawn.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    drawn = matrix(drawn.column("vec")).astype(np.float64)
    total = vectors.count()
    leaves = split_balls(drawn, 1, min(regions, max(1, math.ceil(total / shard))))
    centres = np.array([drawn[x].mean(axis=0) for x in leaves])  # at most `regions` rows

    def place(batches):
        for b in batches:
            x = matrix(b.column("vec"), centres.shape[1]).astype(np.float64)
            c = np.pad(centres, ((0, 0), (0, x.shape[1] - centres.shape[1])))
            far = np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)))
            region = far.argmin(axis=1)
            exact = np.sqrt(((x - c[region]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(region.astype(np.int32)), pa.array(exact)], names=["id", "vec", "region", "far"])

    placed = vectors.mapInArrow(place, "id long, vec array<long>, region int, far double")
    stats = placed.groupBy("region").agg(F.max("far").alias("radius"), F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v))).alias("norm")).collect()  # one row a region
    radius = np.full(len(centres), -np.inf)
    norm, parts = np.zeros(len(centres)), {}
    for r in stats:
        radius[r.region], norm[r.region], parts[r.region] = r.radius, r.norm, max(1, math.ceil(r.n / shard))
    queries = vectors.filter(is_query(F.col("id"))).dropDuplicates(["id"])

    def bounds(q: np.ndarray) -> np.ndarray:
        c = np.pad(centres, ((0, 0), (0, max(0, q.shape[1] - centres.shape[1]))))
        size = np.sqrt((q**2).sum(axis=1))[:, None]
        out = np.full((len(q), len(c)), -np.inf)
        live = np.isfinite(radius)
        out[:, live] = q @ c[live].T + size * radius[live]
        out[:, live] += 1e-9 * (np.abs(out[:, live]) + size * norm[live]) + 1e-6
        return out

    def visits(first: bool):
        """Which (region, part) a query goes to: the best region, or all others that may hold a better score."""

        def each(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                ub = bounds(matrix(b.column("vec"), centres.shape[1]).astype(np.float64))
                best = ub.argmax(axis=1)
                if first:
                    go = np.zeros(ub.shape, bool)
                    go[np.arange(len(best)), best] = True
                else:
                    go = ub >= np.array(b.column("kth")).astype(np.float64)[:, None]
                    go[np.arange(len(best)), best] = False
                go &= np.isfinite(ub)
                row, region = np.nonzero(go)
                n = np.array([parts.get(x, 0) for x in region.tolist()], np.int64)
                row, region = np.repeat(row, n), np.repeat(region, n)
                part = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n, n)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("vec").take(at), b.column("kth").take(at), pa.array(region.astype(np.int32)), pa.array(part.astype(np.int32))], names=["id", "vec", "kth", "region", "part"])

        return each

    cut = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    shards = placed.withColumn("part", F.pmod(F.xxhash64("id"), cut[F.col("region")]).cast("int"))
    keys = ("region", "part", "block")

    def run(asked: DataFrame, first: bool) -> DataFrame:
        sent = asked.mapInArrow(visits(first), "id long, vec array<long>, kth long, region int, part int")
        # a region that is visited is sent once for each block of its queries
        blocks = {r.region: math.ceil(r["count"] / block) for r in sent.filter("part = 0").groupBy("region").count().collect()}  # one row a region
        if not blocks:
            return spark.createDataFrame([], "query_id long, vec_id long, score long")
        of_region = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])[F.col("region")]
        visited = shards.filter(of_region.isNotNull()).withColumn("block", F.explode(F.sequence(F.lit(0), of_region - 1))).select(*keys, "id", "vec")
        sent = sent.select("region", "part", F.pmod(F.xxhash64("id"), of_region).cast("int").alias("block"), "id", "vec", "kth")

        def each(left: pa.Table, right: pa.Table) -> pa.Table:
            empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
            if not left.num_rows or not right.num_rows:
                return empty
            v, q = matrix(left.column("vec")), matrix(right.column("vec"))
            width = max(v.shape[1], q.shape[1])
            v, q = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (v, q))
            ids = np.array(right.column("id"))
            row, vec, score = search(np.array(left.column("id")), v, ids, q, np.array(right.column("kth")), k, leaf)
            return pa.table({"query_id": ids[row], "vec_id": vec, "score": score})

        return visited.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(each, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    least = F.lit(-(1 << 63))
    nearest = checkpointed(run(queries.select("id", "vec", least.alias("kth")), True))
    # the k-th score of the first region bounds what the others must reach; fewer than k rows there bound nothing
    kth = nearest.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    shared = checkpointed(queries.join(kth, "id", "left").select("id", "vec", F.coalesce("kth", least).alias("kth")))
    found = nearest.unionByName(run(shared, False))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
