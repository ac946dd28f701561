"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: XXH64 (seed 42) of every 3-word shingle of the lower-cased text, repeats included; a bit is set if more
than half the hashes set it. Two fingerprints link at three or fewer differing bits; a document's component is the
smallest doc_id that links reach.

Search: documents of one fingerprint are one node (an aggregation with partial sums, so that a group of copies never
meets in a task). The 64 bits fall into five blocks; three differing bits leave at least two blocks equal, so each
fingerprint goes under ten keys, one for each pair of blocks, and linked ones share at least one. Keys with a single
fingerprint are dropped. A key with more than `chunk` fingerprints is cut into chunks by hash and searched by pairs of
chunks, so that no task ever holds more than two chunks. Inside a group the index sorts fingerprints by Gray rank,
joins runs of them into nodes, factors the bits that all below a node share into the node, and walks down with the
differences added up so far, dropping a node with all below it once they exceed three. A group returns a spanning forest
of its links, not all pairs; components come from repeated minima over the links.

The pipeline's stage looks for another likeness (keep_one with a similarity): 5-word shingles with a Jaccard similarity of 0.8
lie about 10 bits apart by calculation, and some much more, which no keys of blocks of 64 bits can find. There texts that share one of
BANDS minhash bands are compared by their exact sets of shingles: all with the least of their band first, then, in bands
that this has not joined, all outside the largest component with all.

Defined cases: a null text has no words, and no words give fingerprint zero, which links like any other; one or two
words are hashed as one sequence; repeated rows give repeated rows; rows without doc_id link no others and take the
component of their fingerprint (null if all in it have none); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lithograph.llm.text import text_batches
from lithograph.operators.graph import connected_components
from lithograph.session import materialize

BITS = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
FAN = 16
BANDS, HASHES_IN_BAND = 24, 5  # two sets of similarity 0.8 share no band once in 14,000 pairs
_ODD = np.uint64(0x9E3779B97F4A7C15)
_DRAWN = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * HASHES_IN_BAND), dtype=np.uint64)
_MASKS, _FACTORS = _DRAWN[0] << np.uint64(1), _DRAWN[1] << np.uint64(1) | np.uint64(1)
TID = "xxhash64(text IS NULL, text)"
SIEVE = 1 << 26


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles, as an unsigned 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = zip(starts, ends[width - 1 :], strict=False) if len(words) >= width else [(0, len(line))]
    hashes = np.array([xxh64_intdigest(line[a:b], seed) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for part, texts in text_batches(batches):
        prints = np.array([fingerprint(t or b"") for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tid"), pa.array(prints)], ["doc_id", "tid", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tid (a hash of the text) and fp (the fingerprint's 64 bits as a signed long)."""
    return docs.select("doc_id", F.expr(TID).alias("tid"), "text").mapInArrow(_fingerprints, "doc_id long, tid long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the order in which neighbours differ by one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over codes sorted by Gray rank; a node holds the bits that all codes below it share."""

    def __init__(self, codes: np.ndarray, fan: int = FAN):
        self.codes, self.fan = codes, fan
        low, high = [codes], [codes]
        while len(low[-1]) > fan:
            cuts = np.arange(0, len(low[-1]), fan)
            low.append(np.bitwise_and.reduceat(low[-1], cuts))
            high.append(np.bitwise_or.reduceat(high[-1], cuts))
        shared = [~(a ^ b) for a, b in zip(low, high, strict=True)]
        # what a node adds: the bits it shares that its parent does not
        self.adds = [s & ~np.repeat(up, fan)[: len(s)] for s, up in zip(shared, shared[1:], strict=False)] + [shared[-1]]
        self.value = low

    def near(self, first: int, last: int, most: int = BITS) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) with first <= i < last, i < j, at most `most` bits apart."""
        top = len(self.value) - 1
        i = np.repeat(np.arange(first, last), len(self.value[top]))
        node = np.tile(np.arange(len(self.value[top])), last - first)
        apart = np.zeros(len(i), dtype=np.uint8)
        for level in range(top, -1, -1):
            apart = apart + np.bitwise_count((self.codes[i] ^ self.value[level][node]) & self.adds[level][node])
            keep = (apart <= most) & ((node + 1) * self.fan**level > i + 1)
            i, node, apart = i[keep], node[keep], apart[keep]
            if level:
                below = np.arange(self.fan)
                node = (node[:, None] * self.fan + below).ravel()
                i, apart = np.repeat(i, self.fan), np.repeat(apart, self.fan)
                there = node < len(self.value[level - 1])
                i, node, apart = i[there], node[there], apart[there]
        return i, node


def group_links(codes: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct codes, as pairs of ids."""
    n = len(codes)
    if n == 2:
        return [(int(ids[0]), int(ids[1]))] if int(codes[0] ^ codes[1]).bit_count() <= BITS else []
    order = np.argsort(gray_rank(codes), kind="stable")
    codes, ids = codes[order], ids[order]
    index, label = GrayIndex(codes), np.arange(n)
    for first in range(0, n, 256):
        i, j = index.near(first, min(n, first + 256))
        while len(i):
            least = np.minimum(label[i], label[j])
            np.minimum.at(label, label[i], least)
            np.minimum.at(label, label[j], least)
            while (label[label] != label).any():
                label = label[label]
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
    return [(int(ids[k]), int(ids[label[k]])) for k in np.flatnonzero(label != np.arange(n))]


def _search(batches, search=None):
    """Links in each run of rows with the same (key, first, second); a run may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    search = search or (lambda rows: group_links(rows.column("fp").to_numpy().view(np.uint64), rows.column("rep").to_numpy()))

    def links(rows: pa.Table):
        k = np.stack([rows.column(c).to_numpy() for c in ("key", "c1", "c2")])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1), rows.num_rows]
        found = [x for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1 for x in search(rows.slice(a, b - a))]
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in ("key", "c1", "c2")])
        change = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0))
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("key", "c1", "c2")):
            yield links(pa.Table.from_batches(held))
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            yield links(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield links(pa.Table.from_batches(held))


def links(nodes: DataFrame, chunk: int = 1000) -> DataFrame:
    """Edges (a, b) that join the same nodes as all links do, for nodes of distinct fp with id rep."""
    bits = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1)) for at, n in BLOCKS]
    keys = [F.lit(c << 26).bitwiseOR(F.shiftleft(bits[x], 13)).bitwiseOR(bits[y]) for c, (x, y) in enumerate(combinations(range(len(BLOCKS)), 2))]
    rows = nodes.select("fp", "rep", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").count().filter("count > 1").withColumn("chunks", F.ceil(F.col("count") / chunk))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    dealt = rows.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"), "fp", "rep")
    return dealt.repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2").mapInArrow(_search, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp, component_id."""
    rows = materialize(fingerprints(docs), "simhash")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    found = connected_components(links(nodes.filter("rep IS NOT NULL")))
    classes = nodes.join(found, nodes["rep"] == found["id"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def sieve(tids: DataFrame) -> Column:
    """Whether the tid of a row's text may be one of tids: never false for one of them, and for n of them true for about n / SIEVE others.

    It is a bitmap of SIEVE bits (8 MB) over the low bits of tids, built by one aggregation and sent to all tasks; its size is the
    same at every number of rows. It only spares rows a shuffle: whoever uses it joins the rows it lets pass with tids,
    so that more tids than bits cost shuffle, not rows.
    """
    place = f"tid & {SIEVE - 1}L"
    words = tids.select(F.expr(f"({place}) DIV 64").alias("word"), F.expr(f"shiftleft(1L, cast(({place}) % 64 AS int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(SIEVE // 64, dtype=np.uint64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)

    @F.pandas_udf("boolean")
    def may_hold(tid: pd.Series) -> pd.Series:
        at = tid.to_numpy().view(np.uint64) & np.uint64(SIEVE - 1)
        return pd.Series((bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1)

    return may_hold(F.expr(TID))


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Different shingles of a text's lower-cased words as 64-bit hashes, in order; fewer words make one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    each = np.array([xxh64_intdigest(w, 42) for w in words], dtype=np.uint64)
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for at in range(width):
        out = (out ^ each[at : at + len(out)]) * _ODD
        out ^= out >> np.uint64(32)
    return np.unique(out)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key per band: of HASHES_IN_BAND minima of the shingles under multiplicative hashes."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, ((shingles[at : at + 1024, None] ^ _MASKS) * _FACTORS).min(axis=0))
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, -1).T:
        out = (out ^ column) * _ODD
        out ^= out >> np.uint64(32)
    return out


def similar_links(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sets have at least the similarity (Jaccard; empty sets are equal)."""
    sizes = np.array([len(x) for x in sets])
    open_, found = np.arange(len(ids)), []
    front: list[int] = []
    while len(open_):
        if not front:
            front, open_ = [int(open_[0])], open_[1:]
        at = front.pop()
        near = open_[np.minimum(sizes[open_], sizes[at]) >= similarity * np.maximum(sizes[open_], sizes[at])]
        if not len(near):
            continue
        joint = np.concatenate([sets[j] for j in near])
        own = sets[at]
        if len(own):
            place = np.minimum(np.searchsorted(own, joint), len(own) - 1)
            both = np.add.reduceat((own[place] == joint).astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
            near = near[both >= similarity * (sizes[at] + sizes[near] - both)]
        found += [(int(ids[at]), int(ids[j])) for j in near]
        front += near.tolist()
        open_ = np.setdiff1d(open_, near, assume_unique=True)
    return found


def _similar_classes(docs: DataFrame, width: int, similarity: float, chunk: int = 200) -> DataFrame:
    """doc_id, tid, component_id for the rows with doc_id; links are the pairs of texts that share a band and have the similarity."""

    def keys(batches):
        for part, texts in text_batches(batches):
            found = [band_keys(shingle_set(t or b"", width)).view(np.int64) for t in texts]
            flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tid"), lists], ["doc_id", "tid", "keys"])

    def sets(batches):
        for part, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([part.column("tid"), pa.array([shingle_set(t or b"", width).tobytes() for t in texts], pa.binary())], ["tid", "shingles"])

    def forest(rows):
        return similar_links(rows.column("tid").to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in rows.column("shingles").to_pylist()], similarity)

    def search(groups: DataFrame) -> DataFrame:
        rows = texts.join(materialize(groups, "near-groups").hint("merge"), "tid").repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2")
        return rows.select("key", "c1", "c2", "tid", "shingles").mapInArrow(lambda batches: _search(batches, forest), "a long, b long")

    held = docs.filter("doc_id IS NOT NULL").select("doc_id", F.expr(TID).alias("tid"), "text")
    rows = materialize(held.mapInArrow(keys, "doc_id long, tid long, keys array<long>"), "near-keys")
    nodes = rows.groupBy("tid").agg(F.first("keys").alias("keys")).select("tid", F.explode("keys").alias("key"))
    sizes = nodes.groupBy("key").agg(F.count("*").alias("n"), F.min("tid").alias("lead"), F.expr("bit_xor(xxhash64(tid))").alias("members")).filter("n > 1")
    sizes = sizes.groupBy("n", "lead", "members").agg(F.min("key").alias("key"))  # bands with the same texts count once
    shared = materialize(nodes.join(sizes.drop("members"), "key"), "near-shared")
    tids = materialize(shared.select("tid").distinct(), "near-tids")
    each = held.filter(sieve(tids)).groupBy("tid").agg(F.first("text").alias("text"))  # before the join, as one text may be that of very many rows
    wanted = each.join(tids.hint("merge"), "tid")
    texts = materialize(wanted.mapInArrow(sets, "tid long, shingles binary"), "near-sets")

    # first each text meets the least of its band; of very many, in chunks
    star = shared.filter("tid <> lead").select(F.col("lead").alias("key"), "tid").distinct()
    parts = star.groupBy("key").agg(F.ceil(F.count("*") / chunk).alias("parts"))
    dealt = star.join(parts, "key").select("key", F.pmod(F.xxhash64("tid"), "parts").alias("c1"), F.lit(0).cast("long").alias("c2"), "tid")
    leads = parts.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("c1"), F.lit(0).cast("long").alias("c2"), F.col("key").alias("tid"))
    first = materialize(search(dealt.union(leads)), "near-links")

    # then, in bands not yet joined, all that is outside the largest component meets all
    component = connected_components(first).withColumnRenamed("id", "tid")
    known = materialize(shared.filter("n > 2").join(component, "tid", "left").select("key", "tid", F.coalesce("component", "tid").alias("component")), "near-known")
    counts = known.groupBy("key", "component").count().groupBy("key").agg(F.sum("count").alias("n"), F.max("count").alias("most"), F.max_by("component", F.struct("count", "component")).alias("largest"))
    whole = F.col("n") <= chunk
    ranks = counts.filter("most < n").select("key", F.when(~whole, F.col("largest")).alias("largest"), F.when(whole, 1).otherwise(F.ceil((F.col("n") - F.col("most")) / chunk)).alias("outer"), F.when(whole, 0).otherwise(F.ceil(F.col("most") / chunk)).alias("inner"))
    inside = F.coalesce(F.col("component") == F.col("largest"), F.lit(False))
    spread = F.xxhash64("tid")
    own = F.when(inside, F.col("outer") + F.expr("pmod(xxhash64(tid), greatest(inner, 1))")).otherwise(F.pmod(spread, F.col("outer")))
    meets = F.when(inside, F.col("outer")).otherwise(F.col("outer") + F.col("inner"))
    rest = known.join(ranks, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), meets - 1)))
    second = materialize(search(rest.select("key", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"), "tid")), "near-links")
    found = connected_components(first.union(second)).withColumnRenamed("id", "tid")
    return rows.select("doc_id", "tid").join(found, "tid", "left").select("doc_id", "tid", F.coalesce("component", "tid").alias("component_id"))


def _print_classes(docs: DataFrame) -> DataFrame:
    """doc_id, tid, component_id for the rows with doc_id; a component is that of fingerprints, whatever ids texts share."""
    rows = materialize(fingerprints(docs.filter("doc_id IS NOT NULL")), "simhash")
    nodes = materialize(rows.select("fp").distinct().withColumn("rep", F.col("fp")), "simhash-nodes")
    found = connected_components(links(nodes)).withColumnRenamed("id", "fp")
    return rows.join(found, "fp", "left").select("doc_id", "tid", F.coalesce("component", "fp").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 3, similarity: float | None = None) -> DataFrame:
    """docs' own columns, for the text of the smallest (doc_id, hash of text) in each component; rows without doc_id stay.

    Without a similarity the components are op4's; with one, two texts link if their shingles of width words have it (Jaccard).
    Rows that share a doc_id but not a text are documents of their own. Of rows with the same doc_id and text the one
    whose columns come first as JSON stays. The documents that go are far fewer than those that stay, so it is their ids
    that docs are joined with. The joins with texts merge at every size, as those ids grow with the documents; rows that
    the sieve of the ids rules out take no part in them.
    """
    found = materialize((_print_classes(docs) if similarity is None else _similar_classes(docs, width, similarity)).groupBy("doc_id", "tid", "component_id").count(), "simhash-classes")
    least = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "tid")).alias("least"))
    gone = found.join(least, "component_id").filter("doc_id <> least.doc_id OR tid <> least.tid OR count > 1")
    gone = materialize(gone.select("doc_id", "tid", F.expr("doc_id = least.doc_id AND tid = least.tid").alias("stays")), "simhash-gone")
    may_go = sieve(gone)
    some = docs.filter(may_go)
    out = some.join(gone.hint("merge"), (some["doc_id"] == gone["doc_id"]) & (F.expr(TID) == gone["tid"]), "left_anti").select(*docs.columns)
    out = docs.filter(~may_go).union(out)
    again = materialize(gone.filter("stays").select(F.col("doc_id").alias("same_id"), F.col("tid").alias("same_tid")), "simhash-again")
    if not again.take(1):
        return out
    rows = some.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("same_id"), F.expr(TID).alias("same_tid"))
    first = rows.join(again.hint("merge"), ["same_id", "same_tid"], "left_semi").groupBy("same_id", "same_tid").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return out.union(first.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns)))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
