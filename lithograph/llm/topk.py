"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers, floor(1024 * x). PIVOTS far-apart rows of a bounded sample cut the space into cells; the rows of a
cell are dealt into blocks of about `block` rows, and so are the stated queries (vec_id divisible by `every`). Each block is
indexed once, by a cover tree: a child keeps what lies within its parent's scale / BASE of its centre, siblings' centres
lie further apart than that, and a node of at most LEAF rows is a leaf. A block's rows stand in the order of its tree, so
that a node is a run of rows with a centre and a covering radius.

Search: a query node and a data node can score at most

    <q, p> + |q| r_p + |p| r_q + r_q r_p

over centres q, p with covering radii r_q, r_p. The pair is pruned once that is below the worst kth score among the queries
of its node. Blocks are the upper nodes of the two trees:

1. Every query block is searched in the one data block that promises most, which gives each query a kth score.
2. Every pair of blocks whose bound reaches the worst of these is searched, by equal keys: a data block travels once and
   meets the query blocks in one task. The kth scores of step 1 go with the queries, and rise as the search goes on.

Inside a pair of blocks the query tree is walked down with the list of data nodes that it cannot exclude; bounds of a list
are one matrix product. At a leaf the data leaves are scanned by falling bound until it is below the worst kth score.

Where distances are all alike, as in many nearly isotropic dimensions, cover trees have single rows as children and
nothing is pruned: the search is exact and goes by blocks, but visits all.

Defined cases: rows without vec_id, with a null vector, or with null or non-finite components take no part; short vectors
count as if filled with zeros; of query rows with one vec_id the least vector counts, and rows of the query's own vec_id
are no candidates; other repeated rows are candidates each; scores must fit a long (products of larger ones wrap); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithograph.session import materialize

LEAF = 32
BASE = 1.5
PIVOTS, SAMPLE = 64, 2048
FOUND = "query_id long, vec_id long, score long"
NODE = np.dtype([("low", "<i4"), ("high", "<i4"), ("centre", "<i4"), ("child", "<i4"), ("children", "<i4"), ("radius", "<f8")])


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, nodes) of a cover tree over points (float); children of a node follow each other."""
    squares = np.einsum("ij,ij->i", points, points)
    middle = points - points.mean(axis=0)
    order: list[np.ndarray] = []
    nodes = [(0, len(points), 0, 0, 0, 0.0)]
    todo = [(0, int(np.argmin(np.einsum("ij,ij->i", middle, middle))), np.arange(len(points)))]
    place = np.zeros(len(points), dtype=np.int64)
    while todo:
        at, centre, rows = todo.pop()
        gap = points[rows] - points[centre]
        dist = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        radius, low = float(dist.max(initial=0.0)), nodes[at][0]
        place[rows] = np.arange(low, low + len(rows))
        nodes[at] = (low, low + len(rows), centre, 0, 0, radius * (1 + 1e-9))
        if len(rows) <= LEAF or radius == 0:
            continue
        scale = radius / BASE
        near = dist <= scale
        groups, rest = [(centre, rows[near])], rows[~near]
        held, square = points[rest], squares[rest]
        live = np.ones(len(rest), dtype=bool)
        while len(rest):
            first = int(np.argmax(live))
            d2 = square - 2 * (held @ held[first]) + square[first]
            near = live & (d2 <= scale * scale)
            near[first] = True
            groups.append((int(rest[first]), rest[near]))
            live &= ~near
            if 2 * live.sum() < len(rest):
                rest, held, square = rest[live], held[live], square[live]
                live = np.ones(len(rest), dtype=bool)
        start = len(nodes)
        nodes[at] = (*nodes[at][:3], start, len(groups), nodes[at][5])
        for centre, members in groups:
            nodes.append((low, low + len(members), centre, 0, 0, 0.0))
            todo.append((len(nodes) - 1, centre, members))
            low += len(members)
    order = np.argsort(place)
    made = np.array(nodes, dtype=NODE)
    made["centre"] = place[made["centre"]]
    return order, made


@dataclass
class Block:
    """Rows in the order of their tree."""

    ids: np.ndarray
    rows: np.ndarray
    nodes: np.ndarray

    def __post_init__(self):
        self.points = self.rows.astype(np.float64)
        self.centres = self.points[self.nodes["centre"]]
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.centres, self.centres))


def make_block(ids: np.ndarray, rows: np.ndarray) -> Block:
    order, nodes = cover_tree(rows.astype(np.float64))
    return Block(ids[order], rows[order], nodes)


def bounds(centre: np.ndarray, norm: float, radius: float, centres: np.ndarray, norms: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """What a row within radius of centre can score at most with one within radii of centres."""
    value = centres @ centre + norm * radii + norms * radius + radius * radii
    return value + 1e-9 * np.abs(value) + 1e-6


class Search:
    """The k best of each query among the data blocks it meets; counts how many row pairs it scans."""

    def __init__(self, queries: Block, k: int, worst: np.ndarray | None = None):
        self.queries, self.k, self.scanned, self.pruned = queries, k, 0, 0
        self.worst = np.full(len(queries.ids), -np.inf) if worst is None else worst.copy()
        self.best: list[list[tuple[int, int]]] = [[] for _ in queries.ids]

    def meet(self, data: Block) -> None:
        most = max(np.abs(self.queries.points).max(initial=0.0), np.abs(data.points).max(initial=0.0))
        self.data, self.exact = data, most * most * max(1, data.points.shape[1]) < 2.0**52  # else products are taken in integers
        self.visit(0, np.zeros(1, dtype=np.int64))

    def visit(self, node: int, others: np.ndarray) -> None:
        q, d = self.queries, self.data
        low, high, _, child, children, radius = q.nodes[node]
        upper = bounds(q.centres[node], q.norms[node], radius, d.centres[others], d.norms[others], d.nodes["radius"][others])
        near = upper >= self.worst[low:high].min()
        self.pruned += int((~near).sum())
        others, upper = others[near], upper[near]
        if not len(others):
            return
        inner = d.nodes["children"][others] > 0
        # the side of the larger radius is split, a leaf never is
        split = inner & ((children == 0) | (d.nodes["radius"][others] > radius))
        if children == 0 and not split.any():
            return self.scan(low, high, others, upper)
        first, many = d.nodes["child"][others[split]], d.nodes["children"][others[split]]
        below = np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        others = np.concatenate([others[~split], below])
        if children == 0:
            return self.visit(node, others)
        for x in range(child, child + children):
            self.visit(x, others)

    def scan(self, low: int, high: int, others: np.ndarray, upper: np.ndarray) -> None:
        """Scores of query rows low .. high with the rows of data leaves, by falling bound."""
        falling = np.argsort(-upper, kind="stable")
        others, upper = others[falling], upper[falling]
        sizes = (self.data.nodes["high"] - self.data.nodes["low"])[others]
        at, total = 0, np.cumsum(sizes)
        while at < len(others):
            if upper[at] < self.worst[low:high].min():
                self.pruned += len(others) - at
                return
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 8 * LEAF)))
            starts, n = self.data.nodes["low"][others[at:to]], sizes[at:to]
            self.score(low, high, np.repeat(starts - np.cumsum(n) + n, n) + np.arange(int(n.sum())))
            at = to

    def score(self, low: int, high: int, rows: np.ndarray) -> None:
        q, d = self.queries, self.data
        self.scanned += (high - low) * len(rows)
        scores = q.points[low:high] @ d.points[rows].T if self.exact else q.rows[low:high] @ d.rows[rows].T
        hits = (scores >= self.worst[low:high, None]) & (q.ids[low:high, None] != d.ids[rows][None, :])
        for i in np.flatnonzero(hits.any(axis=1)).tolist():
            cols = np.flatnonzero(hits[i])
            row, ids = scores[i, cols].astype(np.int64), d.ids[rows[cols]]
            cut = np.lexsort((ids, -row))[: self.k]
            held = self.best[low + i] = sorted([*self.best[low + i], *zip((-row[cut]).tolist(), ids[cut].tolist(), strict=True)])[: self.k]
            if len(held) == self.k:
                self.worst[low + i] = max(self.worst[low + i], -held[-1][0])

    def rows(self) -> list[tuple[int, int, int]]:
        """(query id, id, score), by falling score and rising id."""
        return [(int(i), v, -s) for i, held in zip(self.queries.ids, self.best, strict=True) for s, v in held]


BLOCKS = "block long, n int, ids binary, vectors binary, nodes binary, centre binary, radius double"


def far_apart(points: np.ndarray, count: int) -> np.ndarray:
    """Rows of points, each the furthest from those before it."""
    picked, dist = [0], np.full(len(points), np.inf)
    while len(picked) < min(count, len(points)):
        gap = points - points[picked[-1]]
        dist = np.minimum(dist, np.einsum("ij,ij->i", gap, gap))
        picked.append(int(dist.argmax()))
        if not dist.max():
            break
    return points[picked]


def _matrix(lists: pa.ListArray, wide: int) -> np.ndarray:
    """Rows of lists, filled with zeros."""
    flat, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    out = np.zeros((len(lists), wide), dtype=np.int64)
    sizes = np.diff(cuts)
    at = np.arange(cuts[0], cuts[-1]) - np.repeat(cuts[:-1], sizes)
    out[np.repeat(np.arange(len(lists)), sizes), at] = flat[cuts[0] : cuts[-1]]
    return out


def _cells(pivots: np.ndarray):
    """Adds the number of the nearest pivot."""

    def run(batches):
        squares = np.einsum("ij,ij->i", pivots, pivots)
        for batch in batches:
            points = _matrix(batch.column("v"), pivots.shape[1]).astype(np.float64)
            cell = (squares[None, :] - 2 * (points @ pivots.T)).argmin(axis=1) if len(points) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    return run


def _index(wide: int):
    def run(key, table):
        table = table.combine_chunks()
        ids, rows = table.column("vec_id").to_numpy(), _matrix(table.column("v").chunk(0), wide)
        made, small = make_block(ids, rows), np.abs(rows).max(initial=0) < 1 << 31
        columns = [key[0].as_py(), len(ids), made.ids.tobytes(), made.rows.astype("<i4" if small else "<i8").tobytes(), made.nodes.tobytes(), made.centres[0].tobytes(), float(made.nodes["radius"][0])]
        return pa.table([pa.array([c], t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.float64()), strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    return run


def _unblock(row: dict) -> Block:
    small = len(row["vectors"]) == row["n"] * len(row["centre"]) // 2  # four bytes a component; a centre has eight
    rows = np.frombuffer(row["vectors"], dtype="<i4" if small else "<i8").astype(np.int64).reshape(row["n"], -1)
    return Block(np.frombuffer(row["ids"], dtype=np.int64), rows, np.frombuffer(row["nodes"], dtype=NODE))


def blocks_of(rows: DataFrame, size: int, wide: int, name: str) -> DataFrame:
    """Rows (vec_id, v, cell) as indexed blocks of one cell each, of about size rows."""
    counts = rows.groupBy("cell").count().collect()  # one row per cell
    parts = F.create_map(*(F.lit(x) for r in counts for x in (r["cell"], max(1, -(-r["count"] // size))))) if counts else F.create_map(F.lit(0), F.lit(1))
    block = F.col("cell").cast("long") * F.lit(1 << 40) + F.pmod(F.monotonically_increasing_id(), F.element_at(parts, F.col("cell")))
    return materialize(rows.withColumn("block", block).groupBy("block").applyInArrow(_index(wide), BLOCKS), name)


def _pack_summaries(batches):
    """Centres and radii of blocks, 1024 to a row."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            packed = [np.array(part.column("block").to_pylist(), dtype=np.int64).tobytes(), b"".join(part.column("centre").to_pylist()), np.array(part.column("radius").to_pylist()).tobytes()]
            packed.append(np.array(part.column("worst").to_pylist(), dtype=np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], ["blocks", "centres", "radii", "worst"])


def _pair_blocks(only_best: bool):
    """(query block, data block, bound) of pairs that can hold a result; or of each query block's best in a pair of rows."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, radii, q_ids, q_radii, worst = (np.frombuffer(row[c], dtype=t) for c, t in (("blocks", "<i8"), ("radii", "<f8"), ("q_blocks", "<i8"), ("q_radii", "<f8"), ("q_worst", "<f8")))
                centres, q_centres = (np.frombuffer(row[c]).reshape(n, -1) for c, n in (("centres", len(ids)), ("q_centres", len(q_ids))))
                norms = np.sqrt(np.einsum("ij,ij->i", centres, centres))
                for i in range(len(q_ids)):
                    upper = bounds(q_centres[i], float(np.sqrt(q_centres[i] @ q_centres[i])), q_radii[i], centres, norms, radii)
                    at = np.array([upper.argmax()]) if only_best else np.flatnonzero(upper >= worst[i])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q_ids[i])), pa.array(ids[at]), pa.array(upper[at])], ["q", "block", "bound"])

    return run


def block_pairs(data: DataFrame, queries: DataFrame, only_best: bool, shares: int = 64) -> DataFrame:
    """q, block, bound; queries hold `worst`, the least kth score of their rows. Blocks meet by packed summaries, in shares."""
    summary = "blocks binary, centres binary, radii binary, worst binary"
    left = data.select("block", "centre", "radius", F.lit(0.0).alias("worst")).mapInArrow(_pack_summaries, summary).withColumn("share", F.pmod(F.xxhash64("blocks"), F.lit(shares)).cast("int"))
    right = queries.select("block", "centre", "radius", "worst").mapInArrow(_pack_summaries, summary).select(*(F.col(c).alias(f"q_{c}") for c in ("blocks", "centres", "radii", "worst")))
    met = left.join(right.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))), "share").drop("share", "worst")
    return met.mapInArrow(_pair_blocks(only_best), "q long, block long, bound double")


def _search_pairs(k: int):
    """From rows by data block, the block's own first: the best of each query block that meets it."""

    def run(batches):
        data, now = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["q"] is None:
                    data, now = _unblock(row), row["block"]
                    continue
                assert row["block"] == now
                worst = np.frombuffer(row["worst"]) if row["worst"] else None
                search = Search(_unblock(row), k, worst)
                search.meet(data)
                found = search.rows()
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    return run


def search_pairs(data: DataFrame, queries: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """FOUND for the pairs (q, block) of blocks; queries hold kth, the kth scores of their rows (or null)."""
    body = ("n", "ids", "vectors", "nodes", "centre")
    asked = pairs.select("q", "block").join(queries.select(F.col("block").alias("q"), *body, "kth"), "q").select("block", "q", *body, F.col("kth").alias("worst"))
    own = data.select("block", F.lit(None).cast("long").alias("q"), *body, F.lit(None).cast("binary").alias("worst")).join(pairs.select("block").distinct(), "block", "left_semi")
    return own.union(asked).repartition("block").sortWithinPartitions("block", "q").mapInArrow(_search_pairs(k), FOUND)


def _with_worst(k: int):
    """Adds to a query block the kth scores of its rows (minus infinity without k results), and the least of them."""

    def run(key, left, right):
        block = left.to_pylist()[0]
        ids = np.frombuffer(block["ids"], dtype=np.int64)
        kth = dict(zip(right.column("query_id").to_pylist(), right.column("kth").to_pylist(), strict=True))
        worst = np.array([kth.get(i, -np.inf) for i in ids.tolist()], dtype=np.float64)
        return left.append_column("kth", pa.array([worst.tobytes()], pa.binary())).append_column("worst", pa.array([float(worst.min(initial=np.inf))]))

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, block: int = 4096, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score for the k best candidates of every row whose vec_id is divisible by `every`."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("long")).alias("v"))
    wide = max(1, int(rows.agg(F.max(F.size("v"))).first()[0] or 1))
    sample = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow().column("v").combine_chunks()  # the pivots' sample is bounded
    points = _matrix(sample if isinstance(sample, pa.ListArray) else sample.chunk(0), wide).astype(np.float64) if len(sample) else np.zeros((1, wide))
    dealt = rows.mapInArrow(_cells(far_apart(points, PIVOTS)), "vec_id long, v array<long>, cell int")
    asked = materialize(dealt.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by(F.struct("v", "cell"), "v").alias("x")).select("vec_id", "x.v", "x.cell"), "topk-queries")

    data, queries = blocks_of(dealt, block, wide, "topk-data"), blocks_of(asked, query_block, wide, "topk-asked")
    no_worst = queries.withColumn("worst", F.lit(float("-inf"))).withColumn("kth", F.lit(None).cast("binary"))
    home = block_pairs(data, no_worst, True).groupBy("q").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    home = materialize(home, "topk-home")
    first = materialize(search_pairs(data, no_worst, home, k), "topk-found")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("kth")).filter(F.col("n") >= k)
    owner = asked.select("vec_id").join(kth, F.col("vec_id") == F.col("query_id"))
    # a query's block is where its id stands; ids travel with their block number only
    home_ids = queries.select("block", "ids").mapInArrow(_block_ids, "block long, query_id long")
    seeded = queries.groupBy("block").cogroup(home_ids.join(owner.select("query_id", "kth"), "query_id").groupBy("block")).applyInArrow(_with_worst(k), f"{BLOCKS}, kth binary, worst double")
    seeded = materialize(seeded, "topk-seeded")
    pairs = block_pairs(data, seeded, False).join(home, ["q", "block"], "left_anti")
    found = first.union(search_pairs(data, seeded, materialize(pairs, "topk-pairs"), k))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _block_ids(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["block"])), pa.array(ids)], ["block", "query_id"])


def op1_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, p.vec_id, list_dot_product(q.v, p.v)::BIGINT AS score
  FROM v q JOIN v p ON q.vec_id <> p.vec_id
  WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
