"""Exact top-k search by inner product with a KD-tree for each shard.

Vectors are dealt into cells by the first median splits of a tree that is fitted on about SAMPLE vectors; every vector is put
into its cell, and a cell of many vectors into several shards by a hash. A shard's own tree splits the widest coordinate at the
median until leaves hold LEAF vectors, and keeps every leaf's tight bounding box. No inner product of a query with a vector in
a box can exceed the sum, over the coordinates, of the larger product with the box's two sides. Each query visits the leaves in
the order of this bound, best first, and stops when the bound falls below its k-th best score so far.

Queries travel in blocks. Each block first searches one shard of its own cell. The k-th scores found there are held against the
boxes of all shards, and only the queries whose bound reaches their k-th score go on to a shard.

Score ties go to the smaller id; a query's own row is no candidate, other rows with its id are. A row with a null id is a candidate
that comes last among equal scores (2**63 - 1 stands for it, and comes back as null). Vectors that are null, empty or
hold null or non-finite components take no part, nor do those with a component that 64 bits cannot hold once scaled. Vectors of
different length are not compared. Scores are exact up to 2**62; beyond, they stay at that. Rows that repeat an id count each; a repeated query is
answered for each of its rows. A long vector makes its shard as much larger. Empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinegrid.llm.common import cut, in_tasks, table

SHARD_ROWS, BLOCK_ROWS, LEAF = 8192, 512, 256
#: Vectors that the cells are fitted on, about, and cells at most.
SAMPLE, CELLS = 20_000, 1024
#: Boxes of shards that a block of queries is held against at a time, and bytes of boxes that are sent to every executor.
BOXES, SENT_BYTES = 4096, 16 << 20
NONE, NO_ID = -(1 << 62), (1 << 63) - 1


def whole_numbers(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and v, the components as floor(scale * x); rows that take no part are left out."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    fits = F.forall(x, lambda e: F.abs(F.lit(scale) * e) < float(1 << 62))
    whole = F.transform(x, lambda e: F.floor(F.lit(scale) * e))
    return vectors.where(x.isNotNull() & (F.size(x) > 0) & finite & fits).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.int64).reshape(len(column), -1)


def build_tree(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by leaf, first row of each leaf, and the leaves' lower and upper sides."""
    waiting, leaves = [np.argsort(ids, kind="stable")], []
    while waiting:
        rows = waiting.pop()
        if len(rows) <= leaf:
            leaves.append(rows)
            continue
        own = points[rows]
        widest = int(np.argmax(own.max(0) - own.min(0)))
        halves = np.argpartition(own[:, widest], len(rows) // 2)
        waiting += [rows[halves[len(rows) // 2 :]], rows[halves[: len(rows) // 2]]]
    firsts = np.cumsum([0, *(len(x) for x in leaves)])
    low = np.stack([points[x].min(0) for x in leaves])
    high = np.stack([points[x].max(0) for x in leaves])
    return np.concatenate(leaves), firsts, low, high


def best_columns(score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k best: the larger score, then the smaller rank. Scores of NONE come last."""
    if score.shape[1] <= k:
        return np.broadcast_to(np.arange(score.shape[1]), score.shape)
    shift = int(rank.max(initial=1)).bit_length()
    if np.abs(np.where(score == NONE, 0, score)).max(initial=0) < 1 << (61 - shift):
        mixed = np.where(score == NONE, NONE, (score << shift) - rank)
        return np.argpartition(-mixed, k - 1, axis=1)[:, :k]
    return np.lexsort((rank, -score), axis=1)[:, :k]


class Tree:
    def __init__(self, rows: np.ndarray, ids: np.ndarray, points: np.ndarray, firsts: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.rows, self.ids, self.whole, self.firsts = rows, ids, points, firsts
        self.order = np.lexsort((rows, ids))  # rank: the place in the order of ids
        self.rank = np.empty(len(ids), np.int64)
        self.rank[self.order] = np.arange(len(ids))
        self.most = int(max(abs(int(points.min(initial=0))), abs(int(points.max(initial=0)))))
        self.points, self.low, self.high = (x.astype(np.float64) for x in (points, low, high))

    def search(self, rows: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of each query's k best at or above its floor."""
        largest = queries.shape[1] * self.most * int(max(abs(int(queries.min(initial=0))), abs(int(queries.max(initial=0)))))
        exact = largest < 1 << 52  # doubles hold every inner product
        q = queries.astype(np.float64)
        bound = upper_bounds(q, self.low, self.high)
        order = np.argsort(-bound, axis=1, kind="stable")
        best, at_rank = np.full((len(q), k), NONE, np.int64), np.zeros((len(q), k), np.int64)
        kth = floor.astype(np.float64)
        for visit in range(order.shape[1]):
            leaf_of = order[:, visit]
            active = np.flatnonzero(bound[np.arange(len(q)), leaf_of] >= kth)
            if not len(active):
                break
            active = active[np.argsort(leaf_of[active], kind="stable")]
            for group in np.split(active, np.flatnonzero(np.diff(leaf_of[active])) + 1):
                at = slice(self.firsts[leaf := leaf_of[group[0]]], self.firsts[leaf + 1])
                if exact:
                    score = (q[group] @ self.points[at].T).astype(np.int64)
                elif largest < 1 << 62:
                    score = queries[group] @ self.whole[at].T
                else:  # Python's integers have no bound
                    score = queries[group].astype(object) @ self.whole[at].astype(object).T
                    score = np.clip(score, NONE + 1, -NONE).astype(np.int64)
                score[self.rows[at][None, :] == rows[group][:, None]] = NONE
                pool = np.concatenate([best[group], score], axis=1)
                ranks = np.concatenate([at_rank[group], np.broadcast_to(self.rank[at], score.shape)], axis=1)
                pick = best_columns(pool, ranks, k)
                best[group], at_rank[group] = np.take_along_axis(pool, pick, 1), np.take_along_axis(ranks, pick, 1)
                worst = best[group].min(axis=1)
                kth[group] = np.maximum(kth[group], np.where(worst > NONE, below(worst), -np.inf))
        row, col = np.nonzero((best > NONE) & (best >= kth[:, None]))
        return row, self.ids[self.order[at_rank[row, col]]], best[row, col]


def below(score: np.ndarray) -> np.ndarray:
    """The scores as doubles that are not above them."""
    near = score.astype(np.float64)
    return np.where(np.abs(near) < 2.0**53, near, np.nextafter(near, -np.inf))


def upper_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and box, no less than any inner product of the two."""
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    slack = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T
    return np.where(slack < 2.0**52, bound, bound + slack * 1e-9)


class Cells:
    """The first splits of the tree, by length of vector: (coordinate, value, cell or next split at or below it, above it)."""

    def __init__(self, sample: list, cells: dict[int, int]):
        self.splits: dict[int, list] = {}
        held = defaultdict(list)
        for v in sample:
            held[len(v)].append(v)
        for dim, own in held.items():
            points = np.array(own, np.int64)
            splits, waiting, made = [], [(np.arange(len(points)), -1, 0)], 1
            while waiting and made < cells.get(dim, 1):
                rows, parent, side = waiting.pop(0)
                spread = points[rows].max(0) - points[rows].min(0)
                axis = int(np.argmax(spread))
                value = int(np.sort(points[rows, axis])[(len(rows) - 1) // 2])
                under = points[rows, axis] <= value
                if len(rows) < 2 or under.all():
                    continue
                if parent >= 0:
                    splits[parent][2 + side] = len(splits)
                waiting += [(rows[under], len(splits), 0), (rows[~under], len(splits), 1)]
                splits.append([axis, value, -1, -1])
                made += 1
            self.splits[dim] = splits

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point: twice the last split it comes to, and the side."""
        splits = self.splits.get(points.shape[1])
        if not splits:
            return np.zeros(len(points), np.int32)
        axis, value, *ways = np.array(splits, np.int64).T
        at, cell = np.zeros(len(points), np.int64), np.full(len(points), -1, np.int64)
        while (open_ := np.flatnonzero(cell < 0)).size:
            here = at[open_]
            side = (points[open_, axis[here]] > value[here]).astype(np.int64)
            then = np.where(side == 1, ways[1][here], ways[0][here])
            cell[open_] = np.where(then < 0, 2 * here + side, -1)
            at[open_] = np.maximum(then, 0)
        return cell.astype(np.int32)


def _with_cells(vectors: DataFrame, cells: Cells) -> DataFrame:
    """row, vec_id, v, dim, asks with the cell of each."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            cell = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                cell[own] = cells.of(_matrix(batch.column(2).take(pa.array(own))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return in_tasks(vectors, place, "row long, vec_id long, v array<long>, dim int, asks boolean, cell int")


_TREE = pa.schema([*((n, pa.int32()) for n in ("dim", "cell", "sub")), *((n, pa.binary()) for n in ("rows", "ids", "points", "firsts", "low", "high", "box"))])


def _tree_rows(shards: DataFrame) -> DataFrame:
    """A row for each shard: its tree as bytes, and its box."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        ids, own = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy()
        points = _matrix(rows.column("v").combine_chunks())
        order, firsts, low, high = build_tree(ids, points)
        held = (own[order], ids[order], points[order], firsts.astype(np.int64), low, high, np.stack([low.min(0), high.max(0)]))
        return pa.table([*([k.as_py()] for k in key), *([x.tobytes()] for x in held)], schema=_TREE)

    return shards.groupBy("dim", "cell", "sub").applyInArrow(build, "dim int, cell int, sub int, rows binary, ids binary, points binary, firsts binary, low binary, high binary, box binary")


def _block_rows(queries: DataFrame) -> DataFrame:
    """A row for each block of queries of one cell: rows, ids and vectors as bytes."""
    schema = pa.schema([*((n, pa.int32()) for n in ("dim", "cell", "block")), *((n, pa.binary()) for n in ("rows", "ids", "points"))])

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        held = (rows.column("row").to_numpy(), rows.column("vec_id").to_numpy(), _matrix(rows.column("v").combine_chunks()))
        return pa.table([*([k.as_py()] for k in key), *([x.tobytes()] for x in held)], schema=schema)

    return queries.groupBy("dim", "cell", "block").applyInArrow(build, "dim int, cell int, block int, rows binary, ids binary, points binary")


ANSWER = "row long, query_id long, vec_id long, score long"


def _search(trees: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Answers of blocks of queries (dim, cell, sub, rows, ids, points, floor) in the shard each is dealt to. A shard's tree comes before its blocks."""
    empty = F.lit(None).cast("binary")
    both = trees.select("dim", "cell", "sub", F.lit(0).alias("kind"), "rows", "ids", "points", "firsts", "low", "high", empty.alias("floor")).unionByName(
        asked.select("dim", "cell", "sub", F.lit(1).alias("kind"), "rows", "ids", "points", empty.alias("firsts"), empty.alias("low"), empty.alias("high"), "floor")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, shard = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                dim, cell, sub, kind, rows, ids, points, firsts, low, high, floor = (batch.column(c)[n].as_py() for c in range(11))
                rows, ids, points = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(points, np.int64).reshape(-1, dim)
                if not kind:
                    low, high = (np.frombuffer(x, np.int64).reshape(-1, dim) for x in (low, high))
                    tree, shard = Tree(rows, ids, points, np.frombuffer(firsts, np.int64), low, high), (dim, cell, sub)
                elif shard == (dim, cell, sub):
                    found, vec, score = tree.search(rows, points, k, np.frombuffer(floor, np.float64) if floor else np.full(len(ids), -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[found], ids[found], vec, score)], ["row", "query_id", "vec_id", "score"])

    return in_tasks(both.repartition("dim", "cell", "sub").sortWithinPartitions("dim", "cell", "sub", "kind"), run, ANSWER)


def _reached(blocks: DataFrame, boxes: DataFrame, sent_bytes: int) -> DataFrame:
    """The queries that have to go on, in blocks for one shard each: those whose bound reaches their floor. boxes: dim, chunk, and a chunk's shards and boxes as bytes."""
    schema = pa.schema([*((n, pa.int32()) for n in ("dim", "cell", "sub")), *((n, pa.binary()) for n in ("rows", "ids", "points", "floor"))])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                dim, rows, ids, points, floor, home, shards, sides = (batch.column(c)[n].as_py() for c in range(8))
                rows, ids, floor, points = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(floor, np.float64), np.frombuffer(points, np.int64).reshape(-1, dim)
                box = np.stack([np.frombuffer(b, np.int64).reshape(2, dim) for b in sides]).astype(np.float64)
                go = upper_bounds(points.astype(np.float64), box[:, 0], box[:, 1]) >= floor[:, None]
                made = []
                for s, shard in enumerate(shards):
                    at = np.flatnonzero(go[:, s])
                    if len(at) and (shard["cell"], shard["sub"]) != (home["cell"], home["sub"]):
                        made.append((dim, shard["cell"], shard["sub"], *(x[at].tobytes() for x in (rows, ids, points, floor))))
                yield pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], f.type) for c, f in enumerate(schema)], schema=schema)

    # all blocks have one length of vector as a rule, so small boxes go to every executor, and others to each of the parts that the blocks are dealt into
    size = boxes.agg(F.sum(F.aggregate("sides", F.lit(0).cast("long"), lambda n, b: n + F.octet_length(b)))).first()[0] or 0
    if size <= sent_bytes:
        both = blocks.join(F.broadcast(boxes), "dim")
    else:
        parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = blocks.withColumn("part", F.pmod(F.xxhash64("dim", "cell", "block"), F.lit(parts)).cast("int"))
        both = dealt.join(boxes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["dim", "part"])
    both = both.select("dim", "rows", "ids", "points", "floor", F.struct("cell", "sub").alias("home"), "shards", "sides")
    return in_tasks(both, route, "dim int, cell int, sub int, rows binary, ids binary, points binary, floor binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, sample: int = SAMPLE, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row of vectors (vec_id, v) that is_query holds for, against all other rows."""
    vectors = cut(vectors.select(F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "v", F.size("v").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks")), "vectors")
    n = vectors.count()
    chosen = vectors.where(F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1 << 30)) < F.lit(min(1.0, sample / max(1, n)) * (1 << 30))).select("v", "dim").limit(2 * sample).collect()
    counts = defaultdict(int)
    for r in chosen:
        counts[r.dim] += 1
    cells = Cells([r.v for r in chosen], {d: min(CELLS, int(c / max(1, len(chosen)) * n / shard_rows) + 1, c // 8) for d, c in counts.items()})
    placed = cut(_with_cells(vectors, cells), "placed")
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("subs"), F.greatest(F.lit(1), F.ceil(F.count_if("asks") / block_rows)).cast("int").alias("blocks"))
    dealt = placed.join(cut(sizes, "sizes"), ["dim", "cell"])
    shards = dealt.withColumn("sub", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int"))
    trees = cut(_tree_rows(shards.select("dim", "cell", "sub", "row", "vec_id", "v")), "trees")
    asked = dealt.where("asks").withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).cast("int"))
    blocks = _block_rows(asked.select("dim", "cell", "block", "row", "vec_id", "v")).join(sizes, ["dim", "cell"])
    blocks = cut(blocks.withColumn("sub", F.pmod("block", "subs")).drop("subs", "blocks"), "blocks")
    first = cut(_search(trees, blocks.withColumn("floor", F.lit(None).cast("binary")), k), "first")

    kth = first.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).join(asked.select("row", "dim", "cell", "block"), "row")

    def floors(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The k-th score of each query of a block at home, in the order of the block's rows."""
        rows = np.frombuffer(left.column("rows")[0].as_py(), np.int64)
        own, score = right.column("row").to_numpy(), right.column("kth").to_numpy()
        order = np.argsort(own)
        at = np.searchsorted(own[order], rows)
        held = np.flatnonzero(at < len(own))
        held = held[own[order][at[held]] == rows[held]]
        level = np.full(len(rows), -np.inf)
        level[held] = below(score[order][at[held]])
        return left.append_column("floor", pa.array([level.tobytes()], pa.binary()))

    level = cut(blocks.groupBy("dim", "cell", "block").cogroup(kth.groupBy("dim", "cell", "block")).applyInArrow(floors, "dim int, cell int, block int, rows binary, ids binary, points binary, sub int, floor binary"), "floors")
    boxes = trees.select("dim", F.struct("cell", "sub").alias("shard"), "box").withColumn("chunk", F.pmod(F.xxhash64("shard"), F.lit(max(1, n // shard_rows // BOXES))))
    boxes = boxes.groupBy("dim", "chunk").agg(F.collect_list(F.struct("shard", "box")).alias("b")).select("dim", F.col("b.shard").alias("shards"), F.col("b.box").alias("sides"))
    answers = first.unionByName(_search(trees, _reached(level, cut(boxes, "boxes"), sent_bytes), k))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    vec_id = F.when(F.col("vec_id") != NO_ID, F.col("vec_id"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", vec_id.alias("vec_id"), "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(whole_numbers(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


QUERIES = {"op3_topk": op3_topk}

ORACLE_SQL = {
    "op3_topk": """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.w::DOUBLE[], c.w::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.w) = len(c.w)),
k AS (SELECT *, row_number() OVER (PARTITION BY s.r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20""",
}
