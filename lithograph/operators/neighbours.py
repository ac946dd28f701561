"""Nearest neighbours: exactly by pairs of blocks, by random projections, or by descent along neighbours of neighbours.

Rows are packed into blocks of vectors; what meets is blocks or lists, and distances are taken by NumPy for many rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lithograph.operators.pca import as_matrix
from lithograph.operators.sampling import dense_index
from lithograph.session import discard, materialize

BLOCK_ROWS, MOST_BLOCK_ROWS, BLOCK_NUMBERS = 2048, 16384, 1 << 21  # rows of a block of few and of many rows, and numbers of one
SHARE, KNN_SHARE = 32, 16  # blocks that rows beyond the least size are dealt to; fewer where each block sends k rows for each row to each pair
MOST_PARTS = 2048  # that pairs of blocks are dealt to
TILE_ROWS, TILE_COLS = 512, 4096  # of distances that are looked at together
MANY = 16  # times as many candidates as are asked for: then distances are taken in double precision
PRODUCTS = 200  # distances by products of matrices that take the time of one by descent: 34 s for all pairs of 102,564 rows, 24 s for 34.5 million by descent over 51,282
WORTH = 1 << 27  # distances that descent may take at any rate before all pairs are compared instead
SPARE = 0.2  # of what recall may lack, so that a measured share holds for all rows
PAIRS = "id long, neighbour long, distance double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, up to rounding."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


class Screen:
    """Squared distances of all rows of a and b, a tile at a time and roughly, with what they may be off by: what is near by them is then measured exactly.

    One product of matrices gives them, in single precision where that is of use. Rows are moved so that b's mean is at 0.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        centre = b.mean(axis=0) if len(b) else 0.0
        a, b = a - centre, b - centre
        self.aa, self.bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        self.left = np.concatenate([-2 * a, self.aa[:, None], np.ones((len(a), 1))], axis=1)
        self.right = np.concatenate([b, np.ones((len(b), 1)), self.bb[:, None]], axis=1)
        most = max(self.aa.max(initial=0), self.bb.max(initial=0))
        self.single = a.shape[1] <= 1024 and 1e-12 < most < 1e18
        if self.single:
            self.left32, self.right32 = self.left.astype(np.float32), self.right.astype(np.float32)

    def cols(self) -> Iterator[slice]:
        return (slice(at, at + TILE_COLS) for at in range(0, len(self.right), TILE_COLS))

    def tile(self, rows: slice, cols: slice, single: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(distances, slack of each row): rounding of a sum of products of numbers that are themselves rounded."""
        single = single and self.single
        left, right = (self.left32, self.right32) if single else (self.left, self.right)
        slack = (left.shape[1] + 4) * (2.0**-23 if single else 2.0**-52) * (self.aa[rows] + self.bb[cols].max())
        return left[rows] @ right[cols].T, slack


def within(d: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where finite numbers of d do not exceed the bound of their row."""
    most = np.finfo(d.dtype).max
    bound = np.nextafter(np.minimum(bound, most / 2).astype(d.dtype), most, dtype=d.dtype)
    return np.divmod(np.flatnonzero(d <= bound[:, None]), d.shape[1])


def places_of(ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with ids[i] = others[j], in the order of i."""
    order = np.argsort(others, kind="stable")
    first, last = (np.searchsorted(others, ids, side, sorter=order) for side in ("left", "right"))
    i = np.repeat(np.arange(len(ids)), last - first)
    return i, order[np.arange(len(i)) - np.repeat(np.cumsum(last - first) - last, last - first)]


def _kth_at_most(d: np.ndarray, k: int) -> np.ndarray:
    """A bound of the kth least number of each row: the kth least of the least of groups."""
    groups = min(d.shape[1], max(4 * k, 128))
    least = d[:, : d.shape[1] // groups * groups].reshape(len(d), -1, groups).min(axis=1)
    return np.partition(least, k - 1, axis=1)[:, k - 1].astype(np.float64) if k <= groups else np.full(len(d), np.inf)


def rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Distances to so many digits, halves up; those too large for that stay as they are."""
    if digits is None:
        return x
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = x * 10.0**digits
        whole = np.floor(scaled)
        whole += scaled - whole >= 0.5
    return np.where(np.isfinite(scaled), whole / 10.0**digits, x)


def nearest(ids: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, k: int, reach: np.ndarray | None = None, digits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, distance) of the k nearest other rows to each row, ties to the smaller id; distances of those are exact.

    With reach, of those that are no farther than each row's reach. With digits, distances are rounded first, so that rounding makes ties.
    """
    unit = 0.0 if digits is None else 10.0**-digits
    found = []
    screen, (own, same) = Screen(a, b), places_of(ids, others)
    for at in range(0, len(ids), TILE_ROWS) if k > 0 else ():
        rows = slice(at, min(at + TILE_ROWS, len(ids)))
        bound = np.full(rows.stop - at, np.inf) if reach is None else reach[rows] ** 2 * (1 + 1e-9)
        held = []
        for cols in screen.cols():
            for single in (True, False):
                d, slack = screen.tile(rows, cols, single)
                mine = slice(*np.searchsorted(own, [rows.start, rows.stop]))
                here = (same[mine] >= cols.start) & (same[mine] < cols.stop)
                d[own[mine][here] - at, same[mine][here] - cols.start] = np.inf
                least = np.minimum(bound, _kth_at_most(d, k) + slack)
                i, j = within(d, (np.sqrt(np.maximum(least, 0)) + unit) ** 2 * (1 + 1e-15) + slack if unit else least + slack)
                if len(i) <= MANY * k * len(d) or not screen.single:  # else rounding hides which are near
                    break
            bound = least
            held.append((i, j + cols.start))
        i, j = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        exact = rounded(np.sqrt(((a[at + i] - b[j]) ** 2).sum(axis=1)), digits)
        if reach is not None:
            near = exact <= reach[at + i] * (1 + 1e-12)
            i, j, exact = i[near], j[near], exact[near]
        order = np.lexsort((others[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
        found.append((ids[at + i[keep]], others[j[keep]], exact[keep]))
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else empty


def packed_blocks(df: DataFrame, col: str, block_rows: int | None = None, by: str = "xxhash64(id)", share: int = SHARE) -> tuple[DataFrame, int]:
    """(block, ids, vectors): about block_rows rows to a block, vectors end to end; and the number of blocks.

    By default blocks grow with the rows up to a bound, since what pairs of blocks shuffle is the square of their number times their size.
    """
    rows = df.select("id", F.col(col).cast("array<double>").alias("v"))
    n, wide = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if block_rows is None:
        block_rows = min(max(BLOCK_ROWS, n // share), MOST_BLOCK_ROWS, max(1, BLOCK_NUMBERS // max(1, wide or 1)))
    blocks, most = max(1, -(-n // block_rows)), block_rows + block_rows // 4  # blocks dealt by a hash are not all of one size
    dealt = rows.withColumn("block", F.pmod(F.expr(by), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            vectors, ids, own = as_matrix(batch.column("v")), batch.column("id").to_numpy(), batch.column("block").to_numpy()
            for b in np.unique(own):
                held.setdefault(int(b), []).append((ids[own == b], vectors[own == b]))
        for b, parts in held.items():
            ids, vectors = (np.concatenate(x) for x in zip(*parts))
            for at in range(0, len(ids), most):  # ids that repeat may fill a block more than once
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([ids[at : at + most]], pa.list_(pa.int64())), pa.array([vectors[at : at + most].ravel()], pa.list_(pa.float64()))], ["block", "ids", "vectors"])

    return materialize(dealt.filter("v IS NOT NULL").mapInArrow(pack, "block int, ids array<long>, vectors array<double>"), "blocks"), blocks


def unpacked(batch: pa.RecordBatch, ids: str, vectors: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i, v in zip(batch.column(ids), batch.column(vectors), strict=True):
        numbers = i.values.to_numpy()
        yield numbers, v.values.to_numpy().reshape(len(numbers), -1)


def block_pairs(blocks: DataFrame, count: int) -> DataFrame:
    """(ids, vectors, ids2, vectors2) for every pair of blocks, each unordered pair once (a block with itself as well).

    Pairs are dealt out by themselves: a join by one block would give one task all pairs of a block. Each block goes once to each of its pairs.
    """
    left = blocks.withColumn("other", F.explode(F.sequence("block", F.lit(count - 1))))
    right = blocks.select(F.col("block").alias("other"), F.col("ids").alias("ids2"), F.col("vectors").alias("vectors2")).withColumn("block", F.explode(F.sequence(F.lit(0), "other")))
    parts = min(max(1, count * (count + 1) // 2), MOST_PARTS)
    met = left.repartition(parts, "block", "other").join(right.repartition(parts, "block", "other").hint("merge"), ["block", "other"])
    return met.select("ids", "vectors", "ids2", "vectors2", (F.col("block") == F.col("other")).alias("same"))


def every_pair(left: DataFrame, lefts: int, right: DataFrame, rights: int) -> DataFrame:
    """(ids, vectors, ids2, vectors2) for every block of one table with every one of another, dealt out as block_pairs does.

    The join is by merging: a table that is sent out anew for each block it meets is many times larger than Spark takes it to be, and no broadcast.
    """
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(rights - 1))))
    right = right.select(F.col("block").alias("other"), F.col("ids").alias("ids2"), F.col("vectors").alias("vectors2")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(lefts - 1))))
    parts = min(max(1, lefts * rights), MOST_PARTS)
    met = left.repartition(parts, "block", "other").join(right.repartition(parts, "block", "other").hint("merge"), ["block", "other"])
    return met.select("ids", "vectors", "ids2", "vectors2")


def exact_pairs(df: DataFrame, col: str, k: int, block_rows: int | None = None, reach: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """Candidates for the k nearest: the k nearest within each pair of blocks. The work is the square of the rows.

    reach (id, reach) names distances that the kth nearest is known not to exceed, so that few pairs beyond the k nearest come out. With digits
    distances are rounded, here and in reach.
    """
    bounded = reach is not None

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (i, a), (j, b), same in zip(unpacked(batch, "ids", "vectors"), unpacked(batch, "ids2", "vectors2"), batch.column("same").to_pylist()):
                far, far2 = (a[:, -1], b[:, -1]) if bounded else (None, None)
                a, b = (a[:, :-1], b[:, :-1]) if bounded else (a, b)
                for found in [nearest(i, a, j, b, k, far, digits)] if same else [nearest(i, a, j, b, k, far, digits), nearest(j, b, i, a, k, far2, digits)]:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["id", "neighbour", "distance"])

    if bounded:
        known = df.select("id", F.col(col).cast("array<double>").alias("v")).join(reach, "id", "left")
        df, col = known.select("id", F.concat("v", F.array(F.coalesce("reach", F.lit(float("inf"))))).alias("v")), "v"
    blocks, count = packed_blocks(df, col, block_rows, share=KNN_SHARE)
    return block_pairs(blocks, count).mapInArrow(meet, PAIRS).repartition("id").distinct() if count else df.sparkSession.createDataFrame([], PAIRS)


def recall_of(found: DataFrame, df: DataFrame, col: str, k: int, rows: int = 1000, digits: int | None = None) -> float:
    """The share of the k nearest of some rows, drawn by a hash of their id, that is in found (id, neighbour), by comparing those with all rows."""
    every = df.select("id", F.col(col).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    wide = every.agg(F.max(F.size("v"))).first()[0] or 1
    drawn = every.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(min(rows, max(1, BLOCK_NUMBERS // wide))).collect()  # BLOCK_NUMBERS numbers at most
    if not drawn:
        return 1.0
    ids, v = np.array([r["id"] for r in drawn]), np.array([r["v"] for r in drawn], dtype=float)
    sent = df.sparkSession.sparkContext.broadcast((ids, v))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in nearest(*sent.value, batch.column("id").to_numpy(), as_matrix(batch.column("v")), k, digits=digits)], ["id", "neighbour", "distance"])

    right = materialize(best_of(every.mapInArrow(meet, PAIRS), k).select("id", "neighbour"), "drawn-nearest")
    all_, there = right.count(), right.join(found.select("id", "neighbour").distinct(), ["id", "neighbour"], "left_semi").count()
    return there / all_ if all_ else 1.0


def pairs_within(df: DataFrame, col: str, radius: float, block_rows: int | None = None) -> DataFrame:
    """All ordered pairs of different rows within radius."""

    def near(i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(i), 512):
            part = a[at : at + 512]
            slack = 1e-9 * ((part * part).sum(axis=1) + (b * b).sum(axis=1).max())
            p, q = np.nonzero(distances(part, b) <= (radius * radius + slack)[:, None])
            exact = np.sqrt(((part[p] - b[q]) ** 2).sum(axis=1))
            keep = (exact <= radius) & (i[at + p] != j[q])
            yield pa.RecordBatch.from_arrays([pa.array(i[at + p[keep]]), pa.array(j[q[keep]]), pa.array(exact[keep])], ["id", "neighbour", "distance"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (i, a), (j, b), same in zip(unpacked(batch, "ids", "vectors"), unpacked(batch, "ids2", "vectors2"), batch.column("same").to_pylist()):
                yield from near(i, a, j, b)
                if not same:
                    yield from near(j, b, i, a)

    blocks, count = packed_blocks(df, col, block_rows)
    return block_pairs(blocks, count).mapInArrow(meet, PAIRS).distinct()


def lsh_pairs(df: DataFrame, col: str, radius: float, bucket: float, tables: int, seed: int) -> DataFrame:
    """Ordered pairs of different rows within radius that share a bucket of random projections."""
    rows = df.select("id", array_to_vector(F.transform(col, lambda x: x.cast("double"))).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(rows)
    pairs = model.approxSimilarityJoin(rows, rows, radius, distCol="distance")
    return pairs.select(F.col("datasetA.id").alias("id"), F.col("datasetB.id").alias("neighbour"), "distance").filter("id <> neighbour")


def best_of(pairs: DataFrame, k: int) -> DataFrame:
    """pairs with rank, the k least of each id; Spark keeps the best k of each task before it shuffles."""
    best = Window.partitionBy("id").orderBy("distance", "neighbour")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _start(rows: DataFrame, size: int, block_rows: int, tables: int, seed: int) -> DataFrame:
    """First lists: the nearest rows within stretches of block_rows along the order of a random projection, for several projections."""
    d = rows.agg(F.max(F.size("v"))).first()[0]
    rng = np.random.default_rng(seed)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v in unpacked(batch, "ids", "vectors"):
                v = v.astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in nearest(ids, v, ids, v, size)], ["id", "neighbour", "distance"])

    found = rows.sparkSession.createDataFrame([], PAIRS)
    for _ in range(tables):
        placed = dense_index(rows.withColumn("along", _projected(rows, rng.normal(size=d))), "along", "id").withColumn("stretch", F.floor(F.col("idx") / block_rows))
        packed = placed.groupBy("stretch").agg(F.collect_list(F.struct("id", "v")).alias("m"))  # block_rows rows at most
        found = found.unionByName(packed.select(F.col("m.id").alias("ids"), F.flatten("m.v").alias("vectors")).mapInArrow(meet, PAIRS))
    return best_of(found.distinct(), size).select("id", "neighbour", "distance", F.lit(True).alias("fresh"))


def _projected(rows: DataFrame, direction: np.ndarray) -> Column:
    sent = rows.sparkSession.sparkContext.broadcast(direction)

    @F.arrow_udf("double")
    def along(lists: pa.Array) -> pa.Array:
        return pa.array(as_matrix(lists).astype(np.float64) @ sent.value if len(lists) else np.zeros(0))

    return along("v")


def _joined_lists(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """Pairs that some centre's members make: of the distances below a member's worst one so far, the `keep` least."""
    for batch in batches:
        out = ([], [], [])
        for members in batch.column("m"):
            m = members.values
            ids, worst, fresh = (m.field(c).to_numpy(zero_copy_only=False) for c in ("member", "worst", "fresh"))
            v = as_matrix(m.field("v")).astype(np.float64)
            d = np.sqrt(distances(v, v))
            d[~(fresh[:, None] | fresh[None, :]) | (ids[:, None] == ids[None, :])] = np.inf
            d[d > worst[:, None] * (1 + 1e-9)] = np.inf
            best = np.argpartition(d, min(keep, len(ids)) - 1, axis=1)[:, :keep] if len(ids) > keep else np.broadcast_to(np.arange(len(ids)), d.shape)
            i, j = np.repeat(np.arange(len(ids)), best.shape[1]), best.ravel()
            there = np.isfinite(d[i, j])
            i, j = i[there], j[there]
            out[0].append(ids[i])
            out[1].append(ids[j])
            out[2].append(np.sqrt(((v[i] - v[j]) ** 2).sum(axis=1)))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["id", "neighbour", "distance"])


def descend(df: DataFrame, col: str = "embedding", size: int = 40, sample: int = 20, block_rows: int = 128, tables: int = 3, rounds: int = 12, settled: float = 0.002, seed: int = 42, worth: int | None = None) -> tuple[DataFrame, list[dict]]:
    """(id, neighbour, distance) with lists of `size` near rows, and what each round did: distances taken and entries changed.

    Neighbour descent. In a round each row introduces to each other: up to `sample` entries of its list that are new and as many old ones, and
    as many rows of each kind that have it in their lists. Whoever is nearer than the worst of a list enters it. Lists
    and introductions are bounded, also around rows that very many others are near to; a row's vector goes to as many
    places as introduce it, in single precision where it is stored so. Rounds end when fewer than `settled` of all entries change; with worth, none begins once
    that many distances are taken, or as many as take the time of all pairs, whichever is more. Ids are taken to be unique.
    """
    stored = "array<float>" if df.schema[col].dataType == ArrayType(FloatType()) else "array<double>"
    rows = materialize(df.select("id", F.col(col).cast(stored).alias("v")).filter("v IS NOT NULL"), "descent-rows")
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], PAIRS), []
    lists = written = materialize(_start(rows, size, block_rows, tables, seed), "descent-lists")
    done = [{"distances": tables * n * min(block_rows, n), "changed": lists.count()}]
    for turn in range(rounds):
        if worth is not None and sum(d["distances"] for d in done) >= max(worth, n * n // PRODUCTS):
            break
        coin = F.xxhash64("id", "neighbour", F.lit(seed + turn))
        own = Window.partitionBy("id", "fresh").orderBy(coin, "neighbour")
        chosen = materialize(lists.withColumn("r", F.row_number().over(own)).filter(F.col("r") <= sample).select("id", "neighbour", "fresh"), "descent-chosen")
        back = Window.partitionBy("neighbour", "fresh").orderBy(coin, "id")
        reverse = chosen.withColumn("r", F.row_number().over(back)).filter(F.col("r") <= sample)
        met = chosen.select(F.col("id").alias("centre"), F.col("neighbour").alias("member"), "fresh").unionByName(reverse.select(F.col("neighbour").alias("centre"), F.col("id").alias("member"), "fresh"))
        met = materialize(met.groupBy("centre", "member").agg(F.max("fresh").alias("fresh")), "descent-met")
        worst = lists.groupBy("id").agg(F.when(F.count("*") >= size, F.max("distance")).otherwise(float("inf")).alias("worst"))
        told = rows.join(worst, "id").select(F.col("id").alias("member"), "v", "worst")
        groups = met.join(told, "member").groupBy("centre").agg(F.collect_list(F.struct("member", "worst", "fresh", "v")).alias("m"))  # 4 * sample members at most
        new = groups.select("m").mapInArrow(lambda batches: _joined_lists(batches, size), PAIRS)
        said = chosen.withColumn("said", F.lit(True))  # what was introduced is old from now on
        old = lists.join(said, ["id", "neighbour", "fresh"], "left").select("id", "neighbour", "distance", (F.col("fresh") & F.col("said").isNull()).alias("fresh"), F.lit(False).alias("new"))
        both = old.unionByName(new.select("id", "neighbour", "distance", F.lit(True).alias("fresh"), F.lit(True).alias("new")))
        one = both.groupBy("id", "neighbour").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"), F.min("new").alias("new"))
        sizes = met.groupBy("centre").agg(F.count_if("fresh").alias("f"), F.count("*").alias("m"))
        pairs = (F.col("m") * (F.col("m") - 1) - (F.col("m") - F.col("f")) * (F.col("m") - F.col("f") - 1)) / 2  # old ones have met before
        taken = sizes.agg(F.sum(pairs)).first()[0]
        now = materialize(best_of(one, size).drop("rank"), "descent-lists")
        done.append({"distances": int(taken or 0), "changed": now.filter("new").count()})
        for table in (chosen, met, written):
            discard(table)
        lists, written = now.drop("new"), now
        if done[-1]["changed"] <= settled * n * size:
            break
    return lists.select(*(c.split()[0] for c in PAIRS.split(", "))), done


def knn_edges(df: DataFrame, k: int, mode: str = "exact", col: str = "embedding", block_rows: int | None = None, bucket: float = 1.0, tables: int = 5, radius: float = 2.0, seed: int = 42, recall: float = 0.9, digits: int | None = None, **descent) -> DataFrame:
    """id, neighbour, distance, rank of the k nearest neighbours (ties to the smaller id; with digits, by distances rounded to so many).

    exact compares all pairs, block by block; descent finds nearly all of them in work about in proportion to the rows (see descend); lsh
    joins by random projections within `radius`, and may miss some. What descent finds is measured on rows drawn by a hash; where that is not
    `recall` with some to spare, as on very many nearly isotropic vectors, its lists bound a pass over all pairs that finds the rest. Descent is given
    up for that pass once it has taken about as long as the pass will, but not before WORTH distances.
    """
    if mode not in ("exact", "descent", "lsh"):
        raise ValueError(f"mode is exact, descent or lsh, not {mode!r}")
    near = F.col("distance") if digits is None else F.round("distance", digits)
    if mode == "lsh":
        return best_of(lsh_pairs(df, col, radius, bucket, tables, seed).withColumn("distance", near), k)
    if mode == "descent":
        found = materialize(best_of(descend(df, col, seed=seed, **({"size": max(40, 4 * k), "worth": WORTH} | descent))[0].withColumn("distance", near), k), "descended")
        if recall_of(found, df, col, k, digits=digits) >= recall + SPARE * (1 - recall):
            return found
        reach = found.groupBy("id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("reach"))
        return best_of(exact_pairs(df, col, k, block_rows, reach, digits), k)
    return best_of(exact_pairs(df, col, k, block_rows, digits=digits), k)
