"""Nearest neighbours by inner product with a hierarchical k-means tree.

Vectors get one more component, so that all have the greatest norm and the nearest in
Euclidean distance is the one of largest inner product. The tree is fitted on a bounded
sample; every vector is dealt to a leaf. A query visits leaves best bin first: a priority
queue holds the nodes by the distance to their centres, and the nearest is opened or, if a
leaf, visited. The number of visits is widened on a second sample until its recall reaches the
calibrated level: the centres lie nearer to the vectors they were fitted on than to others. The answer comes from the visited leaves alone; they are scanned exactly,
in double precision.

Leaves that lie next to one another in the tree stand in one block of bounded size, and a
leaf full of copies in several; a query goes once to each block that holds leaves it visits.
Its k best among sampled candidates of its first leaves put a floor under its k nearest, so
that blocks give back little else; they are candidates of visited leaves themselves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors the tree is fitted on, at most, and their bytes; as many, drawn anew, calibrate the visits.
SAMPLE, SAMPLE_BYTES = 32_768, 32 << 20
#: Children of a node; rows that a leaf is planned for; the most leaves.
BRANCH, LEAF_ROWS, MOST_LEAVES = 8, 64, 4_096
#: Sampled candidates of a query's first leaves that give its floor.
FLOOR_ROWS = 1_024
#: Sampled queries and the recall they must reach for the visits to suffice.
CALIBRATION, RECALL = 256, 0.94
#: Candidates of a block, at least and, where there are many blocks, at most; queries of a block; queries that are multiplied at once.
BLOCK, LARGE_BLOCK, QUERY_BLOCK, AT_ONCE = 2_048, 8_192, 16_384, 512
#: Blocks from which on they are made larger, so that queries go to fewer of them.
MANY_BLOCKS = 64
#: Queries whose lists of leaves are spelt out at once; elsewhere a query has a bit for each leaf.
SPELT = 64
#: Pairs found in a block, beyond which only each query's k nearest so far are kept.
PENDING = 1 << 18


class Tree:
    """Centres by node; a node's children are nodes; a node without children is a leaf."""

    def __init__(self, vectors: np.ndarray, leaves: int):
        self.centres, self.children, self.leaf = [vectors.mean(axis=0) if len(vectors) else np.zeros(vectors.shape[1])], [[]], []
        random = np.random.default_rng(0)
        pending = [(-len(vectors), 0, np.arange(len(vectors)))]
        count = 1
        while count < leaves and pending and -pending[0][0] > 2 * BRANCH:
            _, node, members = heapq.heappop(pending)
            centres, near = _k_means(vectors[members], min(BRANCH, leaves - count + 1), random)
            if len(centres) < 2:
                continue
            for k, centre in enumerate(centres):
                self.children[node].append(len(self.centres))
                heapq.heappush(pending, (-int((near == k).sum()), len(self.centres), members[near == k]))
                self.centres.append(centre)
                self.children.append([])
            count += len(centres) - 1
        self.centres = np.array(self.centres, dtype=np.float32)
        self.leaf = [k for k, c in enumerate(self.children) if not c]

    def deal(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest centre, level by level."""
        node = np.zeros(len(vectors), dtype=np.int64)
        open_rows = np.arange(len(vectors))
        while len(open_rows):
            for k in np.unique(node[open_rows]):
                if self.children[k]:
                    rows = open_rows[node[open_rows] == k]
                    node[rows] = np.array(self.children[k])[_distances(vectors[rows], self.centres[self.children[k]]).argmin(axis=1)]
            open_rows = open_rows[[bool(self.children[k]) for k in node[open_rows]]]
        return node

    def away(self, queries: np.ndarray) -> np.ndarray:
        """Each query's distance to each node's centre, less what all have in common."""
        return _distances(queries, self.centres)

    def best_bins(self, away: list[float]) -> Iterator[int]:
        """Leaves, the most promising first, for a query's distances to the nodes."""
        children, queue = self.children, [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not children[node]:
                yield node
            for child in children[node]:
                heapq.heappush(queue, (away[child], child))

    def in_order(self) -> list[int]:
        """Leaves so that those of one branch follow one another."""
        out, stack = [], [0]
        while stack:
            node = stack.pop()
            stack.extend(reversed(self.children[node]))
            if not self.children[node]:
                out.append(node)
        return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b**2).sum(axis=1) - 2 * (a @ b.T)


def _k_means(vectors: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    distinct = np.unique(vectors, axis=0)
    centres = distinct[random.permutation(len(distinct))[:k]]
    near = _distances(vectors, centres).argmin(axis=1)
    for _ in range(rounds):
        used = np.unique(near)
        centres = np.array([vectors[near == c].mean(axis=0) for c in used])
        near = _distances(vectors, centres).argmin(axis=1)
    used = np.unique(near)
    return centres[used], np.searchsorted(used, near)


def _matrix(column: pa.Array, dims: int, kind=np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dims)


def _lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    extra = np.sqrt(np.maximum(most * most - (vectors**2).sum(axis=1), 0))
    return np.hstack([vectors, extra[:, None]]).astype(np.float32)


def visits_needed(tree: Tree, sample: np.ndarray, k: int, recall: float = RECALL) -> int:
    """Leaves to visit so that sampled queries find `recall` of their k nearest in the sample."""
    n = len(sample)
    if n <= 1:
        return 1
    leaf, queries = tree.deal(sample), np.arange(0, n, max(1, n // CALIBRATION))[:CALIBRATION]
    products = sample[queries, :-1].astype(np.float64) @ sample[:, :-1].astype(np.float64).T
    products[np.arange(len(queries)), queries] = -np.inf
    nearest = np.argsort(-products, axis=1)[:, : min(k, n - 1)]
    place = []
    asked = sample[queries].copy()
    asked[:, -1] = 0
    for away, near in zip(tree.away(asked), nearest):
        order = {node: i for i, node in enumerate(tree.best_bins(away.tolist()))}
        place += [order[node] for node in leaf[near]]
    place = np.sort(np.array(place))
    visits = 1
    while (place < visits).mean() < recall:
        visits = max(visits + 1, visits * 5 // 4)
    return min(visits, len(tree.leaf))


class Seeds:
    """Sampled candidates by leaf, for the floors."""

    def __init__(self, tree: Tree, sample: np.ndarray, ids: np.ndarray, points: np.ndarray):
        leaf = tree.deal(sample)
        order = np.argsort(leaf, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.bounds = np.searchsorted(leaf[order], np.arange(len(tree.children) + 1))

    def floor(self, asked: int, query: np.ndarray, leaves: np.ndarray, k: int) -> float:
        """A bound that k candidates of the leaves reach, the query's own row apart; -inf if too few are sampled."""
        size = self.bounds[leaves + 1] - self.bounds[leaves]
        leaves = leaves[: int(np.searchsorted(np.cumsum(size), FLOOR_ROWS)) + 1]
        rows = np.concatenate([np.arange(self.bounds[n], self.bounds[n + 1]) for n in leaves]) if len(leaves) else np.zeros(0, int)
        rows = rows[self.ids[rows] != asked]
        if len(rows) < k:
            return -np.inf
        products = self.points[rows] @ query
        least = float(np.partition(products, len(rows) - k)[len(rows) - k])
        return least - 1e-9 * (1 + abs(least))  # covers the rounding


def _scanned(ids: np.ndarray, points: np.ndarray, asked: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, id, inner product) of what may be among each query's k nearest of a leaf; ids ascend."""
    products = queries @ points.T
    products[ids[None, :] == asked[:, None]] = -np.inf
    if len(ids) > k + 8:
        # shares of the greatest product, to nine digits; the place breaks ties below them
        top = np.where(np.isfinite(products), np.abs(products), 0).max(axis=1, keepdims=True)
        key = np.round(products / np.where(top > 0, top, 1), 9) - np.arange(len(ids)) * 1e-13
        place = np.argpartition(-key, k + 7, axis=1)[:, : k + 8]
        row, column = np.repeat(np.arange(len(asked)), k + 8), place.ravel()
        kept = np.isfinite(products[row, column]) & (products[row, column] >= floor[row])
        row, column = row[kept], column[kept]
    else:
        row, column = np.nonzero(np.isfinite(products) & (products >= floor[:, None]))
    # row by row in one order, so that equal vectors have equal scores
    return row, ids[column], (points[column] * queries[row]).sum(axis=1)


def _block(left: pa.Table, right: pa.Table, dims: int, k: int) -> pa.Table:
    """(query_id, vec_id, score) of each query's k nearest among the leaves of a block that it visits, ties to the smaller id."""
    order = np.lexsort((left["vec_id"].to_numpy(), left["leaf"].to_numpy()))
    leaf, ids, points = left["leaf"].to_numpy()[order], left["vec_id"].to_numpy()[order], _matrix(left["embedding"], dims)[order]
    asked, queries, floor = right["query_id"].to_numpy(), _matrix(right["query"], dims), right["floor"].to_numpy()
    listed = right["leaves"].combine_chunks()
    visited, by = listed.flatten().to_numpy(), np.repeat(np.arange(len(listed)), listed.value_lengths().to_numpy())
    sorted_ = np.argsort(visited, kind="stable")
    visited, by = visited[sorted_], by[sorted_]
    parts, pending = [], 0
    for n in np.unique(leaf):
        a, b = np.searchsorted(leaf, [n, n + 1])
        who = by[slice(*np.searchsorted(visited, [n, n + 1]))]
        at_once = max(1, min(AT_ONCE, AT_ONCE * BLOCK // (b - a)))
        for at in range(0, len(who), at_once):
            some = who[at : at + at_once]
            row, vec, score = _scanned(ids[a:b], points[a:b], asked[some], queries[some], floor[some], k)
            parts.append((some[row], vec, score))
            pending += len(row)
            if pending > PENDING:
                parts, pending = [_best(parts, k)], 0
    row, vec, score = _best(parts, k)
    return pa.table([pa.array(asked[row]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])


def _best(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, id, score) of the k nearest of each query, ties to the smaller id."""
    row, vec, score = map(np.concatenate, zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
    order = np.lexsort((vec, -score, row))
    row, vec, score = row[order], vec[order], score[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[best], vec[best], score[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL) -> DataFrame:
    """The k nearest found of each query among `vectors`: (query_id, rank, vec_id, score).

    Both need vec_id and embedding; other columns are ignored. Nearness is the inner product
    in double precision on the original vectors; ties go to the smaller vec_id. A vector
    with the query's vec_id is never its neighbour. Vectors that are null or zero, that hold
    a null or non-finite component, whose length isn't the commonest, or whose id is null
    take no part. Of rows that repeat an id the one of the greatest vector, component by
    component, counts, as a candidate and as a query. A query gets all candidates if there
    are fewer than k; an empty table gives an empty table.
    """

    def sound(df: DataFrame) -> DataFrame:
        fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).where(
            F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda x: x != 0)
        )

    every, asked = sound(vectors), sound(queries)
    spark = every.sparkSession
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    shapes = every.groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most"))
    shape = shapes.orderBy(F.col("n").desc(), "dims").first()
    result = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], result)
    kind = dict(every.dtypes)["embedding"]
    dims, most, n = shape["dims"], float(shape["most"]), shape["n"]
    every, asked = (df.where(F.size("embedding") == dims).groupBy("vec_id").agg(F.max("embedding").alias("embedding")) for df in (every, asked))
    size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
    picked = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).toArrow()
    points = _matrix(picked.column(1), dims)
    sample = _lifted(points, most)
    tree = Tree(sample, int(min(MOST_LEAVES, max(1, n // LEAF_ROWS))))
    again = every.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(size).toArrow()  # holds fitted vectors by their share of all
    visits = visits_needed(tree, _lifted(_matrix(again.column(1), dims), most), k, recall)
    shared = spark.sparkContext.broadcast((tree, Seeds(tree, sample, picked.column(0).to_numpy(), points)))  # at most MOST_LEAVES * 8 / 7 centres, and the sample

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value[0].deal(_lifted(_matrix(batch.column(1), dims), most))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["leaf", "vec_id", "embedding"])

    dealt = cut(every.mapInArrow(deal, f"leaf long, vec_id long, embedding {kind}"))
    held = {r["leaf"]: r["count"] for r in dealt.groupBy("leaf").count().collect()}  # one row per leaf
    in_order = np.array(tree.in_order())

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, seeds = shared.value
        bit = np.zeros(len(tree.children), np.int64)
        bit[in_order] = np.arange(len(in_order))
        for batch in batches:
            for at in range(0, batch.num_rows, SPELT):
                part = batch.slice(at, SPELT)
                own = _matrix(part.column(1), dims)
                away = tree.away(np.hstack([own, np.zeros((len(own), 1))]).astype(np.float32))
                floors, marks = [], np.zeros((len(own), len(in_order)), bool)
                for i, (q, query, distances) in enumerate(zip(part.column(0).to_pylist(), own, away)):
                    reach, seen = 0, []
                    for node in tree.best_bins(distances.tolist()):
                        if len(seen) >= visits and reach > k:
                            break
                        seen.append(node)
                        reach += held.get(node, 0)
                    marks[i, bit[seen]] = True
                    floors.append(seeds.floor(q, query, np.array(seen), k))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(floors, pa.float64()), pa.array([m.tobytes() for m in np.packbits(marks, axis=1)], pa.binary())], names=["query_id", "query", "floor", "marks"])

    def visits_of(marks: pa.Array) -> np.ndarray:
        """Query by leaf in the tree's order: whether it is visited."""
        bits = np.frombuffer(b"".join(marks.to_pylist()), np.uint8).reshape(len(marks), -1)
        return np.unpackbits(bits, axis=1, count=len(in_order)).view(bool)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(in_order), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SPELT):
                n += visits_of(batch.column(0).slice(at, SPELT)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(in_order[n > 0]), pa.array(n[n > 0])], names=["leaf", "n"])

    visiting = cut(asked.mapInArrow(visit, f"query_id long, query {kind}, floor double, marks binary"))
    asking = {r["leaf"]: r["n"] for r in visiting.select("marks").mapInArrow(tally, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()}  # one row per leaf
    where = _blocks(tree.in_order(), held, asking, visiting.count(), max(BLOCK, min(LARGE_BLOCK, n // MANY_BLOCKS)))
    placed = F.broadcast(spark.createDataFrame([(n, *w) for n, w in where.items()], "leaf long, first long, parts int, queues int"))  # one row per leaf
    candidates = dealt.join(placed, "leaf").select(
        (F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("queues") - 1)).alias("queue"), "leaf", "vec_id", "embedding"
    )

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts, queues = (np.zeros(len(shared.value[0].children), np.int64) for _ in range(3))
        for n, w in where.items():
            first[n], parts[n], queues[n] = w
        for batch in batches:
            for at in range(0, batch.num_rows, SPELT):
                yield sent(batch.slice(at, SPELT), first, parts, queues)

    def sent(batch: pa.RecordBatch, first: np.ndarray, parts: np.ndarray, queues: np.ndarray) -> pa.RecordBatch:
        """Each query once for every block with leaves that it visits, and these leaves."""
        row, place = np.nonzero(visits_of(batch.column(3)))
        leaf = in_order[place]
        row, leaf = row[parts[leaf] > 0], leaf[parts[leaf] > 0]
        times = parts[leaf]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row, leaf = np.repeat(row, times), np.repeat(leaf, times)
        block = first[leaf] + nth
        order = np.lexsort((block, row))
        row, leaf, block = row[order], leaf[order], block[order]
        new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])))) if len(row) else np.zeros(0, int)
        taken = batch.take(pa.array(row[new]))
        mixed = (taken.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        queue = (mixed % np.maximum(queues[leaf[new]], 1).astype(np.uint64)).astype(np.int32)
        together = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)), pa.int32()), pa.array(leaf))
        return pa.RecordBatch.from_arrays([pa.array(block[new]), pa.array(queue), *taken.columns[:3], together], names=["block", "queue", "query_id", "query", "floor", "leaves"])

    questions = visiting.mapInArrow(go, f"block long, queue int, query_id long, query {kind}, floor double, leaves array<long>")

    def scan(_, left: pa.Table, right: pa.Table) -> pa.Table:
        return _block(left, right, dims, k)

    keys = ["block", "queue"]
    found = candidates.groupBy(*keys).cogroup(questions.groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(leaves: list[int], held: dict[int, int], asking: dict[int, int], queries: int, most: int) -> dict[int, tuple[int, int, int]]:
    """(first block, blocks, queues of queries) of each leaf that is visited: small leaves share a block with their neighbours."""
    out, shared, filled, block = {}, [], 0, 0

    def close():
        nonlocal shared, filled, block
        asks = min(queries, sum(asking[n] for n in shared))  # a query comes once, however many of the leaves it visits
        for n in shared:
            out[n] = block, 1, -(-asks // QUERY_BLOCK)
        block, shared, filled = block + bool(shared), [], 0

    for n in leaves:
        if not held.get(n) or not asking.get(n):
            continue
        parts = -(-held[n] // most)
        if parts > 1:
            close()
            out[n] = block, parts, -(-asking[n] // QUERY_BLOCK)
            block += parts
            continue
        if filled + held[n] > most:
            close()
        shared.append(n)
        filled += held[n]
    close()
    return out
