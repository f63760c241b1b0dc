"""Exact top-k search by inner product, with cover trees over data and queries descended together.

Vectors are cut into regions around centres (chosen far apart from a bounded sample), and large regions into blocks. Each
block of data and each block of queries gets its cover tree once (equal vectors are one point with their ids); trees are
stored, with a centre and a radius a block. For a query node of centre q and radius r and a data node of centre p and radius
s, no inner product below them exceeds <q, p> + |q| s + |p| r + r s. A block of queries first descends with the block of
data whose bound is greatest; that gives its worst kth score, and only the blocks of data whose bound reaches it follow.
Within two blocks, a pair of nodes is pruned once its bound is less than the worst kth score in the query node's group. The
best k of all pairs of blocks are merged by query. The query set is stated, and meets the rows block by block.

Vectors that are null, or hold null or non-finite components, take no part; neither do null ids. Vectors are compared with
those of their own length alone. Ties go to the smaller id. A query never finds its own id; fewer candidates than k give
fewer rows. Repeated ids are repeated candidates, and rows that repeat are dealt to blocks one by one. Queries of one id share its k
rows, which are the best for any of its vectors. An empty table gives no rows. Only named columns are read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows in a block of data and in one of queries, points in a leaf at most, and points that one matrix product takes.
DATA_BLOCK, QUERY_BLOCK, LEAF, PRODUCT = 16384, 4096, 16, 1024
#: Children from which on a node's scale shrinks by less than a half.
CHILDREN = 64
#: Rows of which centres of regions are chosen, and most centres a length.
SAMPLE, CENTRES = 4096, 256


class Tree:
    """A cover tree as arrays: nodes in the order of their levels, the children of each one after the other.

    A node's points are `order[start:end]`; all lie within `radius` of its centre, which is one of them.
    """

    def __init__(self, x: np.ndarray, leaf: int):
        self.x, self.order, sq = x, np.arange(len(x)), (x**2).sum(axis=1)
        start, end, centre, radius, first, kids = [0], [len(x)], [0], [], [], []
        far = lambda own, c: np.sqrt(np.maximum(sq[own] + sq[c] - 2 * (x[own] @ x[c]), 0))
        near = [far(self.order, 0)]  # distances of a node's points to its centre, in their order
        scale, at = [float(near[0].max())], 0
        while at < len(start):
            own, d = self.order[start[at] : end[at]], near[at]
            near[at] = None
            radius.append(float(d.max()))
            first.append(len(start))
            kids.append(0)
            if len(own) > leaf and radius[at] > 0:
                s = scale[at] / 2
                while s >= radius[at]:
                    s /= 2
                split = self._split(own, d, centre[at], s, far, min(CHILDREN, len(own) // 4))
                if split is None:  # a base below 2: the centre covers half of the points
                    s = max(s, float(np.median(d)))
                    s = float(d[d < radius[at]].max()) if s >= radius[at] else s
                    split = self._split(own, d, centre[at], s, far, len(own))
                centres, belongs, best = split
                by = belongs.argsort(kind="stable")
                self.order[start[at] : end[at]] = own[by]
                bounds = np.searchsorted(belongs[by], np.arange(len(centres) + 1))
                for k, c in enumerate(centres):
                    if bounds[k] < bounds[k + 1]:
                        start.append(start[at] + int(bounds[k]))
                        end.append(start[at] + int(bounds[k + 1]))
                        centre.append(int(c))
                        near.append(best[by][bounds[k] : bounds[k + 1]])
                        scale.append(s)
                        kids[at] += 1
            at += 1
        self.start, self.end, self.first, self.kids = (np.array(v) for v in (start, end, first, kids))
        self.middle, self.radius = np.array(centre), np.array(radius)
        self.centre = x[self.middle]
        self.norm = np.sqrt((self.centre**2).sum(axis=1))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "centre"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.centre = self.x[self.middle]

    @staticmethod
    def _split(own: np.ndarray, d: np.ndarray, centre: int, s: float, far, most: int):
        """Centres farther apart than `s` that cover points within it, the nearest of them for each point, and its distance; none if they would be more than `most`."""
        centres, belongs, best = [centre], np.zeros(len(own), np.int64), d.copy()
        while best.max() > s:
            if len(centres) == most:
                return None
            c = own[best.argmax()]  # the farthest point: separated from all others
            each = far(own, c)
            if len(centres) == 1 and most < len(own) and max((d <= s).sum(), (each <= s).sum()) * most < len(own):
                return None  # neither of two distant points covers its share
            closer = each < best
            belongs[closer], best[closer] = len(centres), each[closer]
            centres.append(c)
        return centres, belongs, best

    def children(self, nodes: np.ndarray) -> np.ndarray:
        """The children of nodes that have some."""
        many = self.kids[nodes]
        return np.repeat(self.first[nodes] - (np.cumsum(many) - many), many) + np.arange(many.sum())

    def points(self, nodes: np.ndarray) -> np.ndarray:
        many = self.end[nodes] - self.start[nodes]
        return self.order[np.repeat(self.start[nodes] - (np.cumsum(many) - many), many) + np.arange(many.sum())]


@dataclass
class Node:
    """One node of a tree."""

    tree: Tree
    k: int = 0

    @property
    def centre(self) -> np.ndarray:
        return self.tree.centre[self.k]

    @property
    def radius(self) -> float:
        return float(self.tree.radius[self.k])

    @property
    def points(self) -> np.ndarray:
        return self.tree.points(np.array([self.k]))

    @property
    def children(self) -> list[Node]:
        return [Node(self.tree, k) for k in self.tree.children(np.array([self.k])).tolist()] if self.tree.kids[self.k] else []

    @property
    def depth(self) -> int:
        return 1 + max((c.depth for c in self.children), default=0)


def cover_tree(x: np.ndarray) -> Node:
    """The root of a cover tree over distinct points. A node's children are farther apart than its next scale and cover its
    points within it. Scales halve, or shrink by less where that would give more than CHILDREN children, or fewer than four points a child, as nearly equidistant points do: then the
    centre covers half of its node, so the tree stays deep. Radii are the true ones."""
    return Node(Tree(x, LEAF))


def distinct_points(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct vectors; their ids, ascending per vector, with where each vector's begin and how many they are."""
    order = np.lexsort((ids, *x.T[::-1])) if len(x) else np.zeros(0, np.int64)
    ids, x = ids[order], x[order]
    new = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(axis=1))) if len(x) else np.zeros(0, np.int64)
    return x[new], (ids, new, np.diff(np.append(new, len(x))))


class Best:
    """The k best (score, id) of each query, in order; scores of -inf where there are fewer."""

    def __init__(self, queries: int, k: int, floor: float = -np.inf):
        self.k, self.floor = k, floor
        self.scores, self.ids = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def worst(self, own: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[own, -1], self.floor)

    def offer(self, own: np.ndarray, own_ids: np.ndarray, scores: np.ndarray, points: np.ndarray, held: tuple) -> None:
        """Scores of queries (rows) and points (columns). Of equal vectors, only the first k + 1 ids can matter."""
        k = self.k
        least = self.worst(own)
        if scores.shape[1] > k + 1:
            least = np.maximum(least, np.partition(scores, -k - 1, axis=1)[:, -k - 1])  # one more: a query may meet itself
        row, col = np.nonzero(scores >= least[:, None])
        if not len(row):
            return
        ids, begin, counts = held
        many = np.minimum(counts[points[col]], k + 1)
        place = np.repeat(begin[points[col]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        row, value, ids = np.repeat(row, many), np.repeat(scores[row, col], many), ids[place]
        other = ids != own_ids[row]
        row = np.concatenate([np.repeat(np.arange(len(own)), k), row[other]])
        value, ids = np.concatenate([self.scores[own].ravel(), value[other]]), np.concatenate([self.ids[own].ravel(), ids[other]])
        order = np.lexsort((ids, -value, row))
        row, value, ids = row[order], value[order], ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        self.scores[own], self.ids[own] = value[keep].reshape(len(own), k), ids[keep].reshape(len(own), k)


def block_tree(ids: np.ndarray, x: np.ndarray, query: bool) -> tuple:
    """A block's points, their ids and cover tree. Queries of one id and vector are one; rows of data that share a vector are one point."""
    if query:
        once = np.unique(np.column_stack([ids, x]), axis=0)
        root = cover_tree(once[:, 1:].astype(np.float64))
        return root.tree.x, once[:, 0], root
    points, held = distinct_points(ids, x)
    root = cover_tree(points.astype(np.float64))
    return root.tree.x, held, root


def dual_search(asked: tuple, data: tuple, k: int, floor: float = -np.inf, seen: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    """(query id, id, score) of the k best of each query of a block within a block of data, of those that reach `floor`.

    Both trees are descended together. What becomes of pairs is added to `seen`: pairs of nodes `bounded`, of those `pruned`, and
    pairs of points `scored`, of `all`.
    """
    (q, query_ids, q_root), (points, held, d_root) = asked, data
    qt, dt = q_root.tree, d_root.tree
    best, seen = Best(len(q), k, floor), {} if seen is None else seen

    def count(name: str, n: int) -> None:
        seen[name] = seen.get(name, 0) + int(n)

    def bounds(node: int, others: np.ndarray) -> np.ndarray:
        r, s = qt.radius[node], dt.radius[others]
        return dt.centre[others] @ qt.centre[node] + qt.norm[node] * s + dt.norm[others] * r + r * s + 1e-6

    def reaching(node: int, own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of data nodes, those that may hold one of the k best of a group of queries, and their bounds."""
        b = bounds(node, others)
        keep = b >= best.worst(own).min()
        count("bounded", len(keep))
        count("pruned", len(keep) - keep.sum())
        return others[keep], b[keep]

    def score(own: np.ndarray, leaves: np.ndarray) -> None:
        found = dt.points(leaves)
        count("scored", len(own) * len(found))
        best.offer(own, query_ids[own], q[own] @ points[found].T, found, held)

    def leaf(node: int, others: np.ndarray) -> None:
        """A group of queries: first the smallest node of more than k points where the greatest bounds lead, for a worst kth score; then all that still reaches it, by descending bound."""
        own = qt.points(np.array([node]))
        others, b = reaching(node, own, others)
        if not len(others):
            return
        lead = int(others[b.argmax()])
        while dt.kids[lead]:
            below = dt.children(np.array([lead]))
            nearest = int(below[bounds(node, below).argmax()])
            if dt.end[nearest] - dt.start[nearest] <= k:
                break
            lead = nearest
        score(own, np.array([lead]))
        others, b = reaching(node, own, others)
        while (inner := dt.kids[others] > 0).any():
            below, c = reaching(node, own, dt.children(others[inner]))
            others, b = np.concatenate([others[~inner], below]), np.concatenate([b[~inner], c])
        order = (-b).argsort(kind="stable")
        others, b = others[order], b[order]
        rest = (dt.start[others] < dt.start[lead]) | (dt.start[others] >= dt.end[lead])
        others, b = others[rest], b[rest]
        sizes = np.cumsum(dt.end[others] - dt.start[others])
        at = 0
        while at < len(others):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PRODUCT, "right")))
            worst = best.worst(own).min()
            end = min(end, at + int((b[at:end] >= worst).sum()))  # bounds descend
            if end == at:
                count("pruned", len(others) - at)
                return
            score(own, others[at:end])
            at = end

    count("all", len(q) * len(points))
    todo = [(0, np.zeros(1, np.int64))]
    while todo:
        node, others = todo.pop()
        if not qt.kids[node]:
            leaf(node, others)
            continue
        wide = (dt.kids[others] > 0) & (dt.radius[others] > qt.radius[node])
        wider = np.concatenate([others[~wide], dt.children(others[wide])])
        for child in qt.children(np.array([node])).tolist():
            keep, _ = reaching(child, qt.points(np.array([child])), wider)
            if len(keep):
                todo.append((child, keep))
    row, col = np.nonzero(np.isfinite(best.scores))
    return list(zip(query_ids[row].tolist(), best.ids[row, col].tolist(), best.scores[row, col].astype(np.int64).tolist()))


def centres_of(rows: DataFrame) -> dict[int, np.ndarray]:
    """Centres of regions by length of vector: far apart among the SAMPLE rows of least hash, about one a block of data, CENTRES at most."""
    some = rows.select("x", F.xxhash64("i").alias("h"), "i").orderBy("h", "i").limit(SAMPLE).select("x").toArrow().column("x").to_pylist()
    n = {r["w"]: r["count"] for r in rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count")).limit(SAMPLE).collect()}
    out = {}
    for w in sorted({len(v) for v in some}):
        x = np.array([v for v in some if len(v) == w], np.float64)
        found, near = [0], ((x - x[0]) ** 2).sum(axis=1)
        while len(found) < min(CENTRES, -(-n.get(w, 1) // DATA_BLOCK)) and near.max() > 0:
            found.append(int(near.argmax()))
            near = np.minimum(near, ((x - x[found[-1]]) ** 2).sum(axis=1))
        out[w] = x[found]
    return out


def blocks_of(rows: DataFrame) -> DataFrame:
    """Blocks with their trees, stored: q (of queries), w (length of vectors), block, centre, radius, tree."""
    centres = rows.sparkSession.sparkContext.broadcast(centres_of(rows))

    def place(batches):
        for batch in batches:
            column = batch.column("x")
            sizes, values = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
            starts, region = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int32)
            for w in np.unique(sizes).tolist():
                if len(near := centres.value.get(w, ())) > 1:
                    own = np.flatnonzero(sizes == w)
                    x = values[starts[own][:, None] + np.arange(w)].astype(np.float64)
                    region[own] = ((near**2).sum(axis=1) - 2 * x @ near.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("i"), column, batch.column("q"), pa.array(sizes.astype(np.int32)), pa.array(region), batch.column("salt")], names=["i", "x", "q", "w", "region", "salt"])

    placed = rows.mapInArrow(place, "i long, x array<long>, q boolean, w int, region int, salt long")
    asked = placed.where("q").select("i", "x", "w", "region", F.lit(True).alias("of")).distinct().withColumn("salt", F.lit(0).cast("bigint"))
    sides = placed.select("i", "x", "w", "region", F.lit(False).alias("of"), "salt").unionByName(asked)
    sizes = sides.groupBy("of", "w", "region").agg(F.count("*").alias("n"))
    cuts = F.ceil(F.col("n") / F.when(F.col("of"), QUERY_BLOCK).otherwise(DATA_BLOCK))
    dealt = sides.join(sizes, ["of", "w", "region"]).select("i", "x", "of", "w", "region", F.pmod(F.xxhash64("i", "x", "salt"), cuts).alias("cut"))

    def plant(table: pa.Table) -> pa.Table:
        ids, column = table.column("i").to_numpy(), table.column("x").combine_chunks()
        x = column.flatten().to_numpy().reshape(len(ids), -1)
        of, w, region, cut = (table.column(c)[0].as_py() for c in ("of", "w", "region", "cut"))
        tree = block_tree(ids, x, of)
        node = tree[2]
        return pa.table({"q": [of], "w": pa.array([w], pa.int32()), "block": [f"{region}.{cut}"], "centre": pa.array([node.centre.tolist()], pa.list_(pa.float64())), "radius": [node.radius], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return common.stored(dealt.groupBy("of", "w", "region", "cut").applyInArrow(plant, "q boolean, w int, block string, centre array<double>, radius double, tree binary"))


def searched(pairs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The k best of each query within each pair of blocks (w, qb, db, floor): w, qb, query_id, i, score."""
    asked = pairs.join(blocks.where("q").select("w", F.col("block").alias("qb"), F.col("tree").alias("asked")), ["w", "qb"])
    held = blocks.where("not q").select(F.col("w").alias("dw"), F.col("block").alias("db"), F.col("tree").alias("data"))
    wanted = pairs.select(F.col("w").alias("dw"), F.col("db"), F.col("qb").alias("of"))
    data = wanted.join(held, ["dw", "db"]).select(F.col("dw"), F.col("of"), F.col("db").alias("d"), "data")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            found = []
        else:
            floor = a.column("floor")[0].as_py()
            found = dual_search(pickle.loads(a.column("asked")[0].as_py()), pickle.loads(b.column("data")[0].as_py()), k, -np.inf if floor is None else floor)
        query_id, i, score = zip(*found) if found else ((), (), ())
        w, qb = (a.column(c)[0].as_py() if found else None for c in ("w", "qb"))
        return pa.table({"w": pa.array([w] * len(i), pa.int32()), "qb": pa.array([qb] * len(i), pa.string()), "query_id": pa.array(query_id, pa.int64()), "i": pa.array(i, pa.int64()), "score": pa.array(score, pa.int64())})

    return asked.groupBy("w", "qb", "db").cogroup(data.groupBy("dw", "of", "d")).applyInArrow(run, "w int, qb string, query_id long, i long, score long")


def search(df: DataFrame, is_query: Column, k: int, id_col: str, vector: Column) -> DataFrame:
    """The k best rows for each query: query_id, rank, <id_col>, score. `vector` is an array of whole numbers."""
    common.session(df.sparkSession)
    rows = df.select(df[id_col].cast("long").alias("i"), vector.cast("array<long>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("salt")).where("i is not null and size(x) > 0")
    blocks = blocks_of(rows)
    q, d = (blocks.where(F.col("q") == of).select("w", F.col("block").alias(name + "b"), F.col("centre").alias(name + "c"), F.col("radius").alias(name + "r")) for of, name in ((True, "q"), (False, "d")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    bound = dot("qc", "dc") + norm("qc") * F.col("dr") + norm("dc") * F.col("qr") + F.col("qr") * F.col("dr") + 1e-6
    pairs = common.checkpointed(q.join(d, "w").select("w", "qb", "db", bound.alias("bound")))  # summaries of blocks, not rows
    best = pairs.groupBy("w", "qb").agg(F.max_by("db", F.struct("bound", "db")).alias("db"))
    first = common.checkpointed(searched(best.withColumn("floor", F.lit(None).cast("double")), blocks, k))
    kth = first.groupBy("w", "qb", "query_id").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    floor = kth.groupBy("w", "qb").agg(F.min(F.when(F.col("n") == k, F.col("s").cast("double")).otherwise(float("-inf"))).alias("floor"))
    rest = pairs.join(best, ["w", "qb", "db"], "left_anti").join(floor, ["w", "qb"], "left")
    rest = rest.where("floor is null or bound >= floor").select("w", "qb", "db", "floor")
    found = first.unionByName(searched(rest, blocks, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "i")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("i").alias(id_col), "score")


def quantised(vector: Column, steps: int = 64) -> Column:
    """floor(steps * x) of each component as a whole number; null if the vector holds null or non-finite components."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(steps).cast("double") * x.cast("double")).cast("long"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & sound, whole)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over the whole `embeddings`."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, F.pmod(F.col("vec_id"), F.lit(20)) == 0, 20, "vec_id", quantised(F.col("embedding")))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.x, d.x) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
