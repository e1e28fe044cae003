"""Nearest neighbours by inner product: a forest of random-projection trees.

* Equal vectors form one class with its smallest ids (as many as a result needs), so
  a vector that a third of all rows share is one point of the index and is expanded
  at the end.
* Trees are fitted on at most ``SAMPLE`` vectors: each node splits at the median of a
  projection on the difference of two random points. Vectors get one more component
  that makes their norms equal, so that the largest inner product is the nearest point.
  All vectors are then routed to their leaf in every tree.
* A query walks all trees through one shared priority queue, ordered by the squared
  distances to the hyperplanes crossed so far, until the leaves it has taken hold
  a share of as many entries as there are vectors (a vector has one entry for each
  tree); the share falls as vectors grow in number, see ``visited_share``.
* Candidates, the vectors of those leaves, are ranked exactly in double precision.
  Queries meet the index in blocks; each block gives its best of every query, and
  those are ranked once more.

The test vectors are mostly uniform on the sphere, where no index can prune much: for a
recall of 0.97 a query scores 77 % of 2 000 vectors, 60 % of 10 000 and 46 % of 51 000.

Defined results: vectors that are null, zero, or hold null or non-finite components
take no part, nor do those of another length than most have; equal scores go to the
smaller id; a null id takes no part. Rows that repeat id and vector are one row. Rows of
one id and different vectors are queries of their own, told apart by ``query_tag``, and
each other's candidates. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import buckets_for, materialize, shuffle_width

NEIGHBOURS = 20
TREES = 16
SAMPLE = 20_000
#: Vectors in a leaf, about, and sample points in it at least.
LEAF, LEAF_SAMPLE = 64, 12
#: Index entries a query's leaves hold together, over the number of vectors, at ``VISITED_ROWS`` vectors; it falls with the fourth root of their number.
VISITED, VISITED_ROWS = 1.5, 2_000
#: Vectors and queries that meet in one task, about.
BLOCK_ROWS = 4096
SEED = 20_240


def visited_share(n: int) -> float:
    """Entries that a query's leaves hold, over ``n`` vectors: the measured recall stays near 0.97 from 2 000 to 51 000 vectors."""
    return VISITED * (VISITED_ROWS / n) ** 0.25


class Forest(NamedTuple):
    """Nodes of all trees: a hyperplane and two children; children below zero are leaves (-1 - leaf), which are numbered through all trees."""

    normal: object
    offset: object
    child: object
    roots: tuple[int, ...]
    leaves: int
    norm: float

    def lift(self, x):
        """Vectors with the component that makes all norms equal."""
        import numpy as np

        return np.hstack([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))[:, None]])

    def route(self, x):
        """The leaf of each vector in each tree."""
        import numpy as np

        x, out = self.lift(x), np.empty((len(x), len(self.roots)), dtype=np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root, dtype=np.int64)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                right = np.einsum("ij,ij->i", x[inner], self.normal[node]) > self.offset[node]
                at[inner] = self.child[node, right.astype(np.int64)]
            out[:, t] = -1 - at
        return out

    def search(self, x, sizes, entries: float):
        """For each query a mask of leaves: those with the least crossed distance in all trees, until they hold ``entries``."""
        import numpy as np

        margins = np.hstack([x, np.zeros((len(x), 1))]) @ self.normal.T - self.offset
        mask, child, sizes = np.zeros((len(x), self.leaves), dtype=bool), self.child.tolist(), sizes.tolist()
        for q, margin in enumerate(margins.tolist()):
            queue = [(0.0, root) for root in self.roots]
            taken, own = 0, []
            while queue and taken < entries:
                crossed, node = heapq.heappop(queue)
                while node >= 0:
                    m = margin[node]
                    near, far = child[node] if m <= 0 else child[node][::-1]
                    heapq.heappush(queue, (crossed + m * m, far))
                    node = near
                own.append(-1 - node)
                taken += sizes[-1 - node]
            mask[q, own] = True
        return mask


def fit_forest(x, norm: float, trees: int, leaf: int, seed: int = SEED) -> Forest:
    """A forest over sample vectors ``x`` with leaves of at most ``leaf`` of them."""
    import numpy as np

    rng = np.random.default_rng(seed)
    lifted = np.hstack([x, np.sqrt(np.maximum(norm**2 - (x * x).sum(axis=1), 0))[:, None]])
    normal, offset, child, leaves = [], [], [], 0

    def grow(rows):
        nonlocal leaves
        if len(rows) > leaf:
            for _ in range(5):
                a, b = rng.choice(len(rows), 2, replace=False)
                v = lifted[rows[a]] - lifted[rows[b]]
                size = np.linalg.norm(v)
                if size > 0:
                    p = lifted[rows] @ (v / size)
                    cut = float(np.median(p))
                    below = p <= cut
                    if 0 < below.sum() < len(rows):
                        node = len(child)
                        normal.append(v / size)
                        offset.append(cut)
                        child.append(None)
                        child[node] = (grow(rows[below]), grow(rows[~below]))
                        return node
        leaves += 1
        return -leaves

    roots = tuple(grow(np.arange(len(lifted))) for _ in range(trees))
    width = lifted.shape[1]
    return Forest(np.array(normal).reshape(-1, width), np.array(offset), np.array(child, dtype=np.int64).reshape(-1, 2), roots, leaves, norm)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and v (array of double) of vectors that take part."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    length = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (length[0].n if length else 0))


def nearest(vectors: DataFrame, is_query, k: int = NEIGHBOURS, trees: int = TREES, visited: float | None = None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows found for each row that ``is_query`` (a Column over vec_id) holds for, and ``query_tag``, a hash of the query's vector. ``visited`` replaces ``visited_share``."""
    import numpy as np

    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_column, vector_column).dropDuplicates(["vec_id", "v"]), "vectors")
    first = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k + 1)  # Spark cuts to k + 1 before the shuffle, too
    classes = materialize(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "classes")
    n, norm = classes.agg(F.count("*"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c * c)))).first()
    out = "query_id long, rank int, vec_id long, score double, query_tag long"
    if not n:
        return spark.createDataFrame([], out)
    chosen = classes.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).collect()  # at most SAMPLE vectors
    sample = np.array([r.v for r in chosen], dtype=np.float64)
    leaf = max(LEAF_SAMPLE, int(LEAF * len(sample) / n))
    spread = spark.sparkContext.broadcast(fit_forest(sample, float(norm), trees, leaf))  # at most trees * SAMPLE / LEAF_SAMPLE nodes

    def routed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            v = np.array(batch.column("v").to_pylist(), dtype=np.float64)
            leaves = spread.value.route(v)
            yield pa.RecordBatch.from_arrays([batch.column("ids"), batch.column("v"), pa.array(list(leaves), type=pa.list_(pa.int32()))], names=["ids", "v", "leaves"])

    index = materialize(classes.mapInArrow(routed, "ids array<long>, v array<double>, leaves array<int>"), "index")
    counts = index.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect()  # one row for each leaf of the forest
    sizes = np.zeros(spread.value.leaves, dtype=np.int64)
    for r in counts:
        sizes[r.leaf] = r.n

    def searched(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                mask = spread.value.search(np.array(part.column("v").to_pylist(), dtype=np.float64), sizes, (visited or visited_share(n)) * n)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array([np.packbits(m).tobytes() for m in mask], type=pa.binary())], names=["vec_id", "v", "mask"])

    # blocks of bounded rows on either side, whatever the number of partitions
    blocks = buckets_for(n, BLOCK_ROWS)
    chosen = rows.filter(is_query)
    query_blocks = buckets_for(chosen.count(), BLOCK_ROWS)
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    asked = chosen.repartition(shuffle_width(spark)).mapInArrow(searched, "vec_id long, v array<double>, mask binary")
    asked = asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("query_tag"), "v", "mask", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<int>").alias("leaves"))
    nothing = F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("long").alias("query_tag"), "v", F.lit(None).cast("binary").alias("mask"), "ids", "leaves"
    dealt = index.select(*nothing, F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("block"))
    dealt = dealt.withColumn("query_block", each(query_blocks))
    asked = asked.withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
    dealt = dealt.unionByName(asked.withColumn("block", each(blocks)))

    def ranked(table):
        import pyarrow as pa

        is_query = np.asarray(table.column("query_id").is_valid())
        q, x = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))
        made = lambda columns: pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "query_tag", "vec_id", "score"])
        if not q.num_rows or not x.num_rows:
            return made([[]] * 4)
        vectors = np.array(x.column("v").to_pylist(), dtype=np.float64)
        leaves, ids = np.array(x.column("leaves").to_pylist()), x.column("ids").to_pylist()
        least = np.array([i[0] for i in ids])
        found: tuple[list, ...] = ([], [], [], [])
        for at in range(0, q.num_rows, 128):
            part = q.slice(at, 128)
            asked = np.array(part.column("v").to_pylist(), dtype=np.float64)
            masks = np.unpackbits(np.array([np.frombuffer(m, dtype=np.uint8) for m in part.column("mask").to_pylist()]), axis=1).astype(bool)
            for query_id, tag, query, mask in zip(part.column("query_id").to_pylist(), part.column("query_tag").to_pylist(), asked, masks):
                candidates = np.flatnonzero(mask[leaves].any(axis=1))
                score = vectors[candidates] @ query
                if len(score) > k + 1:
                    bound = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                    candidates = candidates[score >= bound - 1e-12 * (1 + abs(bound))]
                score = (vectors[candidates] * query).sum(axis=1)
                best, order = [], np.lexsort((least[candidates], -score))
                for i in order.tolist():
                    if len(best) >= k and -score[i] > best[-1][0]:
                        break
                    own = np.array_equal(vectors[candidates[i]], query)
                    members = [m for m in ids[candidates[i]] if not own or m != query_id]
                    best = sorted(best + [(-score[i], m) for m in members[:k]])[:k]
                for s, m in best:
                    for column, value in zip(found, (query_id, tag, m, -s)):
                        column.append(value)
        return made(found)

    best = dealt.groupBy("query_block", "block").applyInArrow(ranked, "query_id long, query_tag long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query_tag").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_tag")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``embeddings``."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
