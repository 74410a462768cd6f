"""Exact top-k inner products by best-first search in M-trees.

Vectors become integers, floor(scale * x). With one more component that fills every vector up to the largest norm, the
order of inner products is the order of Euclidean distances (d^2 = |q|^2 + M^2 - 2 ip), a metric, in which the tree
prunes. Bounds are floating-point distances with a margin above rounding; ranks come from the exact integers.

The upper levels are routing objects: up to PIVOTS of them, chosen from a bounded sample by splitting it again and again
between two rows far apart; every row is indexed, under its nearest one. A region with more than page_rows(n) rows is cut
into pages by distance to its routing object (shells between its percentiles), each with the least and largest of these
stored parent distances; what lies at one distance, such as copies of a point, is dealt evenly over pages of one shell.
A page's M-tree is built once and stored: leaf nodes of LEAF entries around a routing object, with covering radius and
stored distances of the entries to it, and inner nodes of FAN nodes likewise. A query first searches the pages of its
own region whose shell its own distance falls in, which bounds its k-th distance; it then visits only the pages that
the triangle inequality cannot rule out by their stored distances. Queries of one region go together in blocks of
QUERIES, so a page is read once for each block of queries that lie near each other and need it.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; shorter vectors count
as padded with zeros; equal scores go to the smaller id; of a query id that comes in several rows the smallest vector
is searched; rows that share the query's id are not its neighbours; a query with no other row has no result rows; an empty
table has none; other columns are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import read, staged

PIVOTS, SAMPLE, LEAF, FAN, QUERIES = 1024, 32768, 64, 16, 1024
#: Most shells of a region; a score below all.
SHELLS, LEAST = 64, -(1 << 63)


def page_rows(n: int) -> int:
    return max(512, min(16384, n // 16))


class MTree:
    """Bulk-loaded over augmented vectors (rows of x, float64, exact integers apart from the last component)."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        order = np.arange(len(x))
        leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]] = []  # members, distances to centre, centre, radius
        todo = [order]
        while todo:
            part = todo.pop()
            c = x[part[0]]
            d = np.sqrt(((x[part] - c) ** 2).sum(axis=1))
            if len(part) > LEAF and d.max() > 0:
                far = x[part[d.argmax()]]
                d2 = np.sqrt(((x[part] - far) ** 2).sum(axis=1))
                rank = np.argsort(d - d2, kind="stable")
                todo += [part[rank[: len(part) // 2]], part[rank[len(part) // 2 :]]]
            else:
                leaves.append((part, d, c, float(d.max(initial=0.0))))
        self.levels: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]] = [leaves]
        while len(self.levels[-1]) > FAN:
            below, up = self.levels[-1], []
            for i in range(0, len(below), FAN):  # halving keeps neighbours together in this order
                at = np.arange(i, min(i + FAN, len(below)))
                c = below[i][2]
                d = np.array([np.sqrt(((below[j][2] - c) ** 2).sum()) for j in at])
                up.append((at, d, c, float(max(d[k] + below[j][3] for k, j in enumerate(at)))))
            self.levels.append(up)
        self.centres = [np.stack([n[2] for n in level]) if level else np.empty((0, x.shape[1])) for level in self.levels]
        self.radii = [np.array([n[3] for n in level]) for level in self.levels]

    def search(self, q: np.ndarray, scores, k: int, best: list[tuple[int, int]], own: int, ids: np.ndarray, limit: float, floor: int) -> float:
        """Adds to best, a heap of (score, -id) of size k, and returns the bound on the k-th distance. scores(members):
        exact integer scores; limit, floor: distance that must not be exceeded and score that must be reached, from elsewhere."""
        top = len(self.levels) - 1
        d = np.sqrt(((self.centres[top] - q) ** 2).sum(axis=1)) if len(self.levels[top]) else np.empty(0)
        heap = [(max(0.0, d[i] - self.radii[top][i]), top, i, d[i]) for i in range(len(d))]
        heapq.heapify(heap)
        while heap:
            low, level, i, dc = heapq.heappop(heap)
            if low > limit:
                break
            at, dist, _, _ = self.levels[level][i]
            if level:
                r = self.radii[level - 1][at]
                at = at[np.abs(dc - dist) - r <= limit]  # stored distances rule nodes out before theirs are computed
                dn = np.sqrt(((self.centres[level - 1][at] - q) ** 2).sum(axis=1))
                for j, x, y in zip(at, dn, np.maximum(dn - self.radii[level - 1][at], 0), strict=True):
                    if y <= limit:
                        heapq.heappush(heap, (float(y), level - 1, int(j), float(x)))
                continue
            at = at[np.abs(dc - dist) <= limit]
            if not len(at):
                continue
            s = scores(at)
            keep = s >= (max(floor, best[0][0]) if len(best) == k else floor)  # ties with the k-th stay in, the smaller id may win
            at, s = at[keep], s[keep]
            for j, v in zip(ids[at].tolist(), s.tolist(), strict=True):
                if j == own:
                    continue
                item = (v, -j)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                limit = min(limit, bound(self.total, best[0][0]))
        return limit

    total = 0.0


def bound(total: float, score: int) -> float:
    """Distance at a score, with a margin above rounding. total: |q|^2 + M^2."""
    d = max(0.0, total - 2.0 * score)
    return float(np.sqrt(d)) * (1 + 1e-9) + 1e-4


def _augmented(v: np.ndarray, most: int) -> np.ndarray:
    rest = most - (v.astype(object) ** 2).sum(axis=1) if most > 2**62 else most - (v * v).sum(axis=1)
    return np.concatenate([v.astype(np.float64), np.sqrt(np.maximum(rest.astype(np.float64), 0))[:, None]], axis=1)


def routing_objects(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` rows: the sample is halved between two rows far apart, the largest part next, and each part gives the row
    that is nearest to its mean."""
    parts = [(-len(sample), 0, np.arange(len(sample)))]
    done, n = [], 1
    while parts and len(parts) + len(done) < most:
        _, _, part = heapq.heappop(parts)
        x = sample[part]
        a = x[((x - x[0]) ** 2).sum(axis=1).argmax()]
        da = ((x - a) ** 2).sum(axis=1)
        if len(part) < 2 or da.max() == 0:
            done.append(part)
            continue
        rank = np.argsort(da - ((x - x[da.argmax()]) ** 2).sum(axis=1), kind="stable")
        for half in (part[rank[: len(part) // 2]], part[rank[len(part) // 2 :]]):
            heapq.heappush(parts, (-len(half), n, half))
            n += 1
    done += [p for _, _, p in parts]
    return np.stack([sample[p[((sample[p] - sample[p].mean(axis=0)) ** 2).sum(axis=1).argmin()]] for p in done])


def _place(pivots: np.ndarray, most: int):
    square = (pivots**2).sum(axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _augmented(np.stack(pdf["v"].to_numpy()).astype(np.int64), most)
            at = (square[None, :] - 2 * (x @ pivots.T)).argmin(axis=1).astype(np.int32)  # any choice is right, the nearest is best
            yield pdf.assign(pivot=at, dist=np.sqrt(((x - pivots[at]) ** 2).sum(axis=1)))

    return run


def _build(most: int):
    def run(key: tuple, page: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(page["v"].to_numpy()).astype(np.int64)
        tree = MTree(_augmented(v, most))
        tree.x = None  # the integers are enough
        return pd.DataFrame([(*key, float(page["dist"].min()), float(page["dist"].max()), pickle.dumps((tree, v, page["vec_id"].to_numpy())))], columns=["pivot", "shell", "part", "low", "high", "tree"])

    return run


def _search(k: int, most: int):
    """Rows: a page's tree and the queries of a block that are to search it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob, asked in zip(pdf["tree"], pdf["asked"], strict=True):
                tree, v, ids = pickle.loads(blob)
                out: list[tuple[int, int, int]] = []
                for a in asked:
                    q = np.asarray(a["v"], np.int64)
                    tree.total = float((q * q).sum()) + float(most)
                    best: list[tuple[int, int]] = []
                    tree.search(np.append(q.astype(np.float64), 0.0), lambda at, q=q, v=v: v[at] @ q, k, best, a["query_id"], ids, a["limit"], a["floor"])
                    out += [(a["query_id"], -j, s) for s, j in best]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)").cast("int")).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024) -> DataFrame:
    """vectors (vec_id long, embedding array) and a condition that marks the queries -> query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    x = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("vec_id").isNotNull())
    x = x.where(F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf"))))
    x = x.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda e: F.floor(e.cast("double") * float(scale))).alias("v"))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e * e)
    facts = x.agg(F.max(F.size("v")), F.max(norm), F.count("*")).first()
    dims, most, n = int(facts[0] or 0), int(facts[1] or 0), int(facts[2])
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    x = x.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v")))) if dims else x
    some = x.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(min(SAMPLE, max(64, n // 4))).toPandas()  # bounded
    sample = _augmented(np.stack(some["v"].to_numpy()).astype(np.int64), most)
    centres = routing_objects(sample, max(1, min(PIVOTS, -(-2 * n // page_rows(n)))))
    placed = staged(x.mapInPandas(_place(centres, most), "vec_id long, v array<long>, pivot int, dist double"), "mtree-rows")

    cells = placed.groupBy("pivot").agg(F.count("*").alias("rows"), F.percentile_approx("dist", F.lit([i / SHELLS for i in range(1, SHELLS)])).alias("cuts"))
    size = F.lit(page_rows(n))
    # as many shells as pages, SHELLS at most: every step-th percentile is a cut
    cells = cells.withColumn("step", F.greatest(F.lit(1), F.floor(F.lit(SHELLS) * size / F.col("rows")).cast("int")))
    cells = cells.withColumn("cuts", F.array_distinct(F.filter(F.transform("cuts", lambda c, i: F.when(F.pmod(i + 1, F.col("step")) == 0, c)), lambda c: c.isNotNull())))
    shelled = placed.join(F.broadcast(cells.select("pivot", "cuts")), "pivot")  # at most PIVOTS rows
    shelled = shelled.withColumn("shell", F.size(F.filter("cuts", lambda c: c < F.col("dist")))).drop("cuts")
    parts = shelled.groupBy("pivot", "shell").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    shelled = shelled.join(F.broadcast(parts), ["pivot", "shell"])  # at most PIVOTS * SHELLS rows
    shelled = shelled.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts")).cast("int"))  # of a written table: the same on a retry
    pages = shelled.select("pivot", "shell", "part", "vec_id", "v", "dist").groupBy("pivot", "shell", "part").applyInPandas(_build(most), "pivot int, shell int, part int, low double, high double, tree binary")
    pages = staged(pages, "mtree-pages")

    queries = placed.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min(F.struct("v", "pivot", "dist")).alias("q")).select(F.col("vec_id").alias("query_id"), "q.v", "q.pivot", "q.dist")
    counts = queries.groupBy("pivot").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    queries = queries.join(F.broadcast(counts), "pivot").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumnRenamed("pivot", "home").drop("blocks")
    queries = staged(queries, "mtree-queries")
    slim = pages.select("pivot", "shell", "part", "low", "high")  # a row for each page

    def searched(asked: DataFrame) -> DataFrame:
        """asked: query_id, v, home, block, limit, floor, pivot, shell, part. Each page meets each block that asks for it once."""
        grouped = asked.groupBy("pivot", "shell", "part", "home", "block").agg(F.collect_list(F.struct("query_id", "v", "limit", "floor")).alias("asked"))  # about QUERIES at most
        return pages.join(grouped, ["pivot", "shell", "part"]).select("tree", "asked").mapInPandas(_search(k, most), "query_id long, vec_id long, score long")

    far = 4.0 * float(most) ** 0.5 + 1
    own = (F.col("home") == F.col("pivot")) & (F.col("low") <= F.col("dist")) & (F.col("dist") <= F.col("high"))
    near = staged(queries.join(slim, own).withColumn("limit", F.lit(far)).withColumn("floor", F.lit(LEAST).cast("long")), "mtree-near")
    first = staged(_best(searched(near), k).drop("rank"), "mtree-first")
    kth = first.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("s"))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The regions that a query's bound reaches into, by distance to their routing object."""
        for pdf in batches:
            out = []
            for qid, v, home, block, c, s, reach in zip(pdf["query_id"], pdf["v"], pdf["home"], pdf["block"], pdf["c"], pdf["s"], pdf["reach"], strict=True):
                q = np.append(np.asarray(v, np.float64), 0.0)
                limit = bound(float(q @ q) + most, int(s)) if c == k else far
                d = np.sqrt(((centres - q) ** 2).sum(axis=1))
                wide = np.full(len(centres), -np.inf)
                wide[[r["pivot"] for r in reach]] = [r["high"] for r in reach]
                floor = int(s) if c == k else LEAST
                out += [(qid, v, home, block, limit, floor, int(p), float(d[p])) for p in np.flatnonzero(d - wide <= limit)]
            kinds = {"query_id": "int64", "home": "int32", "block": "int32", "limit": "float64", "floor": "int64", "pivot": "int32", "d": "float64"}
            yield pd.DataFrame(out, columns=["query_id", "v", "home", "block", "limit", "floor", "pivot", "d"]).astype(kinds)

    reach = slim.groupBy("pivot").agg(F.max("high").alias("high")).agg(F.collect_list(F.struct("pivot", "high")).alias("reach"))  # at most PIVOTS entries
    more = queries.join(kth, "query_id", "left").fillna(0, ["c", "s"]).crossJoin(F.broadcast(reach))  # one row
    more = more.mapInPandas(visits, "query_id long, v array<long>, home int, block int, limit double, floor long, pivot int, d double")
    met = more.join(slim, "pivot").where((F.col("d") - F.col("limit") <= F.col("high")) & (F.col("d") + F.col("limit") >= F.col("low")))
    done = near.select("query_id", "pivot", "shell", "part")
    rest = searched(staged(met.join(done, ["query_id", "pivot", "shell", "part"], "left_anti"), "mtree-visits"))
    return _best(first.union(rest), k).select("query_id", "rank", "vec_id", "score")


def op8_mtree_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 100 == 0, 10)
