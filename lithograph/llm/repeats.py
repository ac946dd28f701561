"""Removal of repeated passages: longest-previous-factor arrays over the suffixes that can have an earlier copy.

A byte goes if a string of `length` bytes over it also starts earlier (smaller doc_id, or same document and earlier
start). Which strings have an earlier copy is read off the suffix order: of the suffixes that stand earlier in the corpus,
the nearest before and the nearest behind in suffix order share most with a suffix; what they share, capped at `length`, is
its longest previous factor, and one of full length is an earlier copy. Sorting all suffixes of a corpus would
move many times its size, so two steps come first that lose nothing:

1. Anchors. Every window of `length` bytes picks the least hash among its GRAM-byte strings (leftmost among equals).
   Equal windows pick equal strings at the same offset, so windows can only be equal within one anchor hash. Windows of
   a document that follow each other and pick the same anchor make one context: about one row for 27 bytes of text.
2. Equal contexts are collapsed onto the first one, in each task and then for each hash; all windows of the later ones
   have an earlier copy. Hashes left with a single context have nothing to compare.

What is left, contexts that share an anchor but differ around it, is sent with its bytes to one place per hash, where the
suffixes of its windows are sorted eight bytes at a time; previous and next smaller positions in that order give the
array of longest previous factors. Positions of removed windows
go back to their documents by doc_id.

Skew: rows are packed into one row per (task, bucket of hashes). A hash with very many different contexts (more than
`hot` in a task or over all) is taken apart: its windows travel as contexts of their own under a hash of the whole window,
equal ones are collapsed in the task first, and so no bucket holds more than one row per task for any key.

Equality of contexts is judged by the hash of the anchor and 96 bits of XXH3 over all bytes; the rest compares bytes.

Defined cases: a null text is empty; a text shorter than `length` loses nothing; rows of the same
doc_id and text count as one document; different texts under one doc_id, or under none, are documents of their own, in
the order of a hash of the text; a null doc_id comes first in order; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh3_128_digest

from lithograph.llm.text import from_planes, planes, text_batches
from lithograph.operators.sampling import dense_index
from lithograph.session import materialize

LENGTH, GRAM = 100, 48
SPAN = LENGTH - GRAM + 1  # grams in a window
CHUNK = 1 << 20
HOT = 256
REMOVED, CONTEXT, WINDOWS, MARK = 0, 1, 2, 3
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_LOW = np.uint64(CHUNK - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M[4]
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position; data must be contiguous uint8."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)) * _M[0]
    eight ^= eight >> np.uint64(32)
    two = eight[:-8] * _M[1] + eight[8:]
    two ^= two >> np.uint64(29)
    four = two[:-16] * _M[2] + two[16:]
    four ^= four >> np.uint64(31)
    return _mix(four[:-16] * _M[3] + two[32:])


def contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, two parts of a digest, piece, low, last) of each context in the pieces data[starts:ends], at most CHUNK bytes.

    low and last are the first and the last window start, from the beginning of the piece.
    """
    long_ = ends - starts >= LENGTH
    if not long_.any():
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.uint32, np.int64, np.int32, np.uint8))
    grams = gram_hashes(data)
    key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = np.minimum(key[: len(key) - (SPAN - width)], key[SPAN - width :])
    anchor = (key & _LOW).astype(np.int64)
    edge = np.zeros(len(anchor) + 1, dtype=np.int8)
    np.add.at(edge, starts[long_], 1)
    np.add.at(edge, ends[long_] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    picked = anchor[at]
    first = np.flatnonzero(np.concatenate([[True], (picked[1:] != picked[:-1]) | (at[1:] != at[:-1] + 1)]))
    low, last, anchor = at[first], at[np.concatenate([first[1:], [len(at)]]) - 1], picked[first]
    view = memoryview(data)
    digest = np.frombuffer(b"".join([xxh3_128_digest(view[a:b]) for a, b in zip(low.tolist(), (last + LENGTH).tolist(), strict=True)]), dtype="<u8").reshape(-1, 2)
    whole, more = digest[:, 0].copy(), digest[:, 1].astype(np.uint32)
    piece = np.searchsorted(starts, low, side="right") - 1
    # least hashes are small, so they are mixed again before buckets are cut by their upper bits
    return _mix(grams[anchor]), whole, more, piece, (low - starts[piece]).astype(np.int32), (last - low).astype(np.uint8)


def suffix_order(data: np.ndarray, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The suffixes data[starts[i]:] in the order of their first LENGTH bytes, equal ones by place.

    They are sorted by big-endian words of eight bytes; a suffix whose rank no other shares is done.
    """
    rank, live = np.zeros(len(starts), dtype=np.int64), np.arange(len(starts))
    words = np.ndarray((max(0, len(data) - 7),), ">u8", data, 0, (1,))
    for at in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        if not len(live):
            break
        word = words[starts[live] + at].astype(np.uint64)
        order = np.lexsort((word, rank[live]))
        live, word = live[order], word[order]
        group = rank[live]
        new = np.concatenate([[True], group[1:] != group[:-1]])
        first = new | np.concatenate([[True], word[1:] != word[:-1]])
        begin = np.flatnonzero(first)
        inside = np.arange(len(live)) - np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))
        rank[live] = group + inside[begin][np.cumsum(first) - 1]  # a rank is how many suffixes come before
        live = live[~(first & np.concatenate([first[1:], [True]]))]
    return np.lexsort((places, rank))


def smaller_before(places: np.ndarray) -> np.ndarray:
    """For each place the nearest before it in the array that is smaller, as an index; -1 if there is none."""
    found = np.arange(len(places)) - 1
    open_ = np.flatnonzero(found >= 0)
    while len(open_):
        open_ = open_[places[found[open_]] >= places[open_]]
        found[open_] = found[found[open_]]  # all between are no smaller than what is passed over
        open_ = open_[found[open_] >= 0]
    return found


def shared_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of their first LENGTH bytes the suffixes at a and b share."""
    words = np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))
    out, live = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    for at in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        apart = words[a[live] + at] ^ words[b[live] + at]
        lowest = apart & (~apart + np.uint64(1))
        out[live] = at + np.where(apart == 0, 8, np.bitwise_count(lowest - np.uint64(1)) // 8)
        live = live[apart == 0]
    return out


def previous_factors(data: np.ndarray, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix data[starts[i]:], capped at LENGTH: what it shares with one at a smaller
    place. places orders the suffixes by where they stand in the corpus; rows of one document may stand at one place."""
    order = suffix_order(data, starts, places)
    at, place = starts[order], places[order]
    longest = np.zeros(len(order), dtype=np.int64)
    for near in (smaller_before(place), len(order) - 1 - smaller_before(place[::-1])[::-1]):
        some = np.flatnonzero((near >= 0) & (near < len(order)))
        longest[some] = np.maximum(longest[some], shared_bytes(data, at[some], at[near[some]]))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = longest
    return out


def buckets_of(spark) -> int:
    """A power of two, several buckets for each shuffle partition."""
    return 1 << max(8, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


PACKED = "bucket int, n_rows int, packed binary"
PLACES = "k long, kind int, low int, last int, h long"
_FIELDS = (("h", "<u8"), ("c", "<u8"), ("d", "<u4"), ("k", "<i8"), ("low", "<i4"), ("last", "<i4"), ("kind", "u1"))


def _pack(rows: dict[str, np.ndarray], buckets: int, tails: tuple[np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
    """Rows by bucket of h, each bucket as one binary of columns; tails: (bytes, ends) of a byte string for each row."""
    bucket = (rows["h"] >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1], [True]])) if len(order) else np.zeros(1, dtype=int)
    blobs = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        take = order[a:b]
        parts = [planes(rows[name][take].astype(kind)) for name, kind in _FIELDS]
        if tails:
            data, ends = tails
            parts += [data[(ends[i - 1] if i else 0) : ends[i]] for i in take.tolist()]
        blobs.append(zstandard.compress(b"".join(parts), 1))
    return pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts[:-1]], pa.int32()), pa.array(np.diff(cuts), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "n_rows", "packed"])


def _unpack(n_rows: int, packed: bytes) -> tuple[dict[str, np.ndarray], bytes]:
    rows, at, packed = {}, 0, zstandard.decompress(packed)
    for name, kind in _FIELDS:
        rows[name] = from_planes(packed, kind, n_rows, at)
        at += rows[name].nbytes
    return rows, packed[at:]


def _by_bucket(batches):
    """(rows, tail bytes) of each bucket, from batches sorted by bucket."""
    held, now = [], None
    join = lambda: ({name: np.concatenate([r[name] for r, _ in held]) for name, _ in _FIELDS}, b"".join(t for _, t in held))
    for batch in batches:
        for bucket, n, packed in zip(batch.column("bucket").to_pylist(), batch.column("n_rows").to_pylist(), batch.column("packed"), strict=True):
            if held and bucket != now:
                yield join()
                held = []
            now = bucket
            held.append(_unpack(n, packed.as_py()))
    if held:
        yield join()


def _collapse(rows: dict[str, np.ndarray], hot: int = HOT) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Contexts with the later of equal ones marked as removed; and how many different contexts the hash of each has."""
    order = np.lexsort((rows["low"], rows["k"], rows["d"], rows["c"], rows["h"]))
    rows = {name: x[order] for name, x in rows.items()}
    h, c, d = rows["h"], rows["c"], rows["d"]
    new_h = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, dtype=bool)
    new_c = new_h | np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])]) if len(h) else new_h
    lead = np.maximum.accumulate(np.where(new_c, np.arange(len(h)), 0)) if len(h) else order
    later = (rows["k"] != rows["k"][lead]) | (rows["low"] != rows["low"][lead])
    rows["kind"] = np.where(~new_c & later, REMOVED, CONTEXT).astype(np.uint8)
    group = np.cumsum(new_h) - 1
    return rows, np.bincount(group, weights=new_c).astype(np.int64)[group] if len(h) else order


def _contexts_of_task(buckets: int):
    def run(batches):
        pieces: list[tuple[int, int, bytes]] = []
        size, held, count = 0, [], 0

        def cut():
            ends = np.cumsum([len(b) for _, _, b in pieces])
            data = np.frombuffer(b"".join(b for _, _, b in pieces), dtype=np.uint8)
            h, c, d, piece, low, last = contexts(data, ends - np.array([len(b) for _, _, b in pieces]), ends)
            k, offset = np.array([p[0] for p in pieces], dtype=np.int64)[piece], np.array([p[1] for p in pieces], dtype=np.int64)[piece]
            held.append({"h": h, "c": c, "d": d, "k": k, "low": low + offset, "last": low + offset + last, "kind": np.full(len(h), CONTEXT, dtype=np.uint8)})
            return len(h)

        def flush():
            rows, different = _collapse({name: np.concatenate([x[name] for x in held]) for name, _ in _FIELDS})
            many = (different > HOT) & (rows["kind"] == CONTEXT)
            rows["kind"][many] = WINDOWS
            marks = np.unique(rows["h"][many])
            for name, kind in _FIELDS:
                rows[name] = np.concatenate([rows[name], marks if name == "h" else np.full(len(marks), MARK if name == "kind" else 0, dtype=kind)])
            return _pack(rows, buckets)

        for part, texts in text_batches(batches, 64):
            for k, text in zip(part.column("k").to_pylist(), texts, strict=True):
                for at in range(0, max(1, len(text or b"") - LENGTH + 1), CHUNK - LENGTH + 1):
                    piece = (text or b"")[at : at + CHUNK]
                    if len(piece) < LENGTH:
                        continue
                    if size + len(piece) > CHUNK:
                        count += cut()
                        pieces, size = [], 0
                    pieces.append((k, at, piece))
                    size += len(piece)
            if count > 300_000:
                yield flush()
                held, count = [], 0
        if pieces:
            cut()
        if held:
            yield flush()

    return run


def _places(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rows["k"]), pa.array(rows["kind"].astype(np.int32)), pa.array(rows["low"].astype(np.int32)), pa.array(rows["last"].astype(np.int32)), pa.array(rows["h"].view(np.int64))],
        ["k", "kind", "low", "last", "h"],
    )


def _compare_contexts(batches):
    """Of each bucket: what is removed, and which contexts must be compared byte by byte, whole or window by window."""
    for rows, _ in _by_bucket(batches):
        known = (rows["kind"] == REMOVED) | (rows["kind"] == WINDOWS)
        marks = np.unique(rows["h"][rows["kind"] == MARK])
        yield _places({name: x[known] for name, x in rows.items()})
        rest, different = _collapse({name: x[rows["kind"] == CONTEXT] for name, x in rows.items()})
        marked = np.isin(rest["h"], marks)
        here = rest["kind"] == CONTEXT
        rest["kind"][here & (marked | (different > HOT))] = WINDOWS
        keep = ~here | marked | (different > 1)
        yield _places({name: x[keep] for name, x in rest.items()})


def window_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the LENGTH bytes from each position."""
    g = gram_hashes(data)
    n = len(data) - LENGTH + 1
    return _mix(g[:n] * _M[1] + g[SPAN // 2 : SPAN // 2 + n] * _M[2] + g[LENGTH - GRAM :][:n] * _M[3])


def merge_ranges(low: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of starts, joined where they touch or overlap."""
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(last[order])
    cut = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1] + 1])) if len(low) else np.zeros(0, dtype=int)
    return low[cut], reach[np.concatenate([cut[1:] - 1, [len(low) - 1]])] if len(cut) else reach


def _fetch_bytes(buckets: int):
    """The bytes of contexts that must be compared, by bucket; removed ranges travel along, joined."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            rows = {"h": np.array([x[0] for x in held], dtype=np.uint64), "k": np.array([x[1] for x in held], dtype=np.int64)}
            rows |= {n: np.array([x[i] for x in held], dtype=np.int32) for n, i in (("low", 2), ("last", 3), ("kind", 4))}
            rows |= {"c": np.zeros(len(held), dtype=np.uint64), "d": np.zeros(len(held), dtype=np.uint32)}
            single = np.flatnonzero(rows["kind"] == WINDOWS)
            order = single[np.lexsort((rows["low"][single], rows["k"][single], rows["h"][single]))]
            again = np.concatenate([[False], rows["h"][order][1:] == rows["h"][order][:-1]]) if len(order) else np.zeros(0, dtype=bool)
            lead = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))] if len(order) else order
            later = again & ((rows["k"][order] != rows["k"][lead]) | (rows["low"][order] != rows["low"][lead]))
            for i in np.flatnonzero(later).tolist():
                later[i] = held[order[i]][5] == held[lead[i]][5]  # by all bytes, whatever the hash says
            rows["kind"][order] = np.where(later, REMOVED, CONTEXT)
            tails = [b"" if rows["kind"][i] == REMOVED else x[5] for i, x in enumerate(held)]
            return _pack(rows, buckets, (b"".join(tails), np.cumsum([len(t) for t in tails])))

        for batch in batches:
            lists = batch.column("places")
            cuts, flat = lists.offsets.to_numpy(), lists.values
            fields = {n: flat.field(n).to_numpy() for n in ("kind", "low", "last", "h")}
            for i, (k, text) in enumerate(zip(batch.column("k").to_pylist(), batch.column("text").cast(pa.binary()), strict=True)):
                text = text.as_py() or b""
                kind, low, last, h = (fields[n][cuts[i] : cuts[i + 1]] for n in ("kind", "low", "last", "h"))
                inside = last + LENGTH <= len(text)
                kind, low, last, h = kind[inside], low[inside], last[inside], h[inside].view(np.uint64)
                near = int(_mix(np.array([k], dtype=np.int64).view(np.uint64))[0])
                held += [(near, k, int(a), int(b), REMOVED, b"") for a, b in zip(*merge_ranges(low[kind == REMOVED], last[kind == REMOVED]), strict=True)]
                for a, b, key in zip(low[kind == CONTEXT].tolist(), last[kind == CONTEXT].tolist(), h[kind == CONTEXT].tolist(), strict=True):
                    held.append((key, k, a, b, CONTEXT, text[a : b + LENGTH]))
                    size += b - a + LENGTH + 100
                for a, b in zip(*merge_ranges(low[kind == WINDOWS], last[kind == WINDOWS]), strict=True):
                    for j, key in enumerate(window_hashes(np.frombuffer(text[a : b + LENGTH], dtype=np.uint8)).tolist()):
                        held.append((key, k, int(a) + j, int(a) + j, WINDOWS, text[a + j : a + j + LENGTH]))
                    size += int(b - a + 1) * (LENGTH + 100)
                if size > 1 << 24:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _compare_bytes(batches):
    """Ranges of removed window starts, from the previous factors of each bucket's windows."""
    for rows, tail in _by_bucket(batches):
        done = rows["kind"] == REMOVED
        out = [(rows["k"][done], rows["low"][done], rows["last"][done])]
        k, low, last = (rows[n][~done].astype(np.int64) for n in ("k", "low", "last"))
        if len(k):
            sizes = last - low + 1
            where = np.concatenate([[0], np.cumsum(sizes + LENGTH - 1)[:-1]])
            owner = np.repeat(np.arange(len(k)), sizes)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.lexsort((low[owner] + inner, k[owner]))
            step = np.concatenate([[False], (k[owner][order][1:] != k[owner][order][:-1]) | ((low[owner] + inner)[order][1:] != (low[owner] + inner)[order][:-1])])
            places = np.empty(len(order), dtype=np.int64)
            places[order] = np.cumsum(step)
            gone = np.flatnonzero(previous_factors(np.frombuffer(tail, dtype=np.uint8), where[owner] + inner, places) >= LENGTH)
            cut = np.flatnonzero(np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | (owner[gone][1:] != owner[gone][:-1])])) if len(gone) else gone
            a, b = gone[cut], gone[np.concatenate([cut[1:] - 1, [len(gone) - 1]])] if len(gone) else gone
            out.append((k[owner[a]], low[owner[a]] + inner[a], low[owner[b]] + inner[b]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out]).astype(t)) for i, t in enumerate((np.int64, np.int32, np.int32))], ["k", "low", "last"])


def removed_ranges(docs: DataFrame) -> DataFrame:
    """(k, ranges): for each document key, the ranges [low, last] of window starts that have an earlier copy.

    docs: (k, text) and what else the caller joins ranges with, so that both joins can share one shuffle of it.
    """
    buckets = buckets_of(docs.sparkSession)
    packed = docs.select("k", "text").mapInArrow(_contexts_of_task(buckets), PACKED).repartition("bucket").sortWithinPartitions("bucket")
    places = packed.mapInArrow(_compare_contexts, PLACES).groupBy("k").agg(F.collect_list(F.struct("kind", "low", "last", "h")).alias("places"))
    fetched = docs.join(places, "k").mapInArrow(_fetch_bytes(buckets), PACKED).repartition("bucket").sortWithinPartitions("bucket")
    return fetched.mapInArrow(_compare_bytes, "k long, low int, last int").groupBy("k").agg(F.collect_list(F.struct("low", "last")).alias("ranges"))


def keep_mask(size: int, low: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of size bytes stay, given ranges of removed window starts."""
    inside = low + LENGTH <= size
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, low[inside], 1)
    np.add.at(edge, np.minimum(last[inside].astype(np.int64) + LENGTH, size), -1)
    return np.cumsum(edge[:-1]) == 0


def _apply(batches):
    """Adds n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay, without broken characters)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            lists = batch.column("ranges")
            out = []
            for text, ranges in zip(batch.column("text").cast(pa.binary()), lists, strict=True):
                text, removed, spans = text.as_py() or b"", 0, 0
                n = len(text)
                if ranges.is_valid:
                    flat = ranges.values
                    stay = keep_mask(n, flat.field("low").to_numpy(), flat.field("last").to_numpy())
                    removed = int(n - stay.sum())
                    spans = int((~stay & np.concatenate([[True], stay[:-1]])).sum()) if n else 0
                    text = np.frombuffer(text, dtype=np.uint8)[stay].tobytes()
                out.append((n, removed, spans, hashlib.sha256(text).hexdigest(), text.decode("utf-8", "ignore")))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            rest = [c for c in batch.schema.names if c not in ("text", "ranges")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *columns], [*rest, *names])


_ADDED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs with a document key k, the (k, text) to look for repeats in); docs: held and text, held with doc_id.

    k is the doc_id where all rows have one of their own. Otherwise it is the place among the different (doc_id, text),
    by doc_id and a hash of the text, so that texts under one id or none are documents of their own, and equal ones are one.
    """
    doc_id = F.col("held.doc_id").cast("long")
    ids = docs.groupBy(doc_id.alias("id")).agg(F.count("*").alias("n"))
    if not ids.filter("id IS NULL OR n > 1").take(1):
        own = docs.withColumn("k", F.coalesce(doc_id, F.lit(0)))  # never null, so that both joins ask for the same shuffle
        return own, own
    named = docs.withColumn("id", doc_id).withColumn("tid", F.expr("xxhash64(text IS NULL, text)"))
    order = F.struct(F.col("id").isNotNull().alias("there"), F.coalesce("id", F.lit(0)).alias("id"), "tid")
    places = materialize(dense_index(named.select(order.alias("place")).distinct(), "place"), "repeats-keys")
    places = places.select(F.col("place.there").alias("there"), F.col("place.id").alias("at"), F.col("place.tid").alias("tid"), F.col("idx").cast("long").alias("k"))
    joined = named.withColumn("there", F.col("id").isNotNull()).withColumn("at", F.coalesce("id", F.lit(0))).join(places, ["there", "at", "tid"])
    out = materialize(joined.select("held", "text", "k"), "repeats-docs")
    return out, out.groupBy("k").agg(F.first("text").alias("text"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    keyed, texts = _keyed(docs.select(F.struct("doc_id").alias("held"), "text"))
    joined = keyed.join(removed_ranges(texts), "k", "left").select("held", "text", "ranges")
    out = joined.mapInArrow(_apply, StructType([keyed.schema["held"], *StructType.fromDDL(_ADDED).fields]))
    return out.select(F.col("held.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs' own columns with repeats cut out of text (n_chars follows); documents of which nothing stays are left out."""
    held, texts = _keyed(docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("held"), "text"))
    joined = held.join(removed_ranges(texts), "k", "left").select("held", "text", "ranges")
    out = joined.mapInArrow(_apply, StructType([held.schema["held"], *StructType.fromDDL(_ADDED).fields])).filter("n_removed = 0 OR kept <> ''")
    value = {c: F.col(f"held.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("kept")}
    if "n_chars" in value:
        value["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(value["n_chars"])
    return out.select(*[value[c].alias(c) for c in docs.columns])


def op10_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# all windows of 100 bytes by their hash, in place of the suffix order
OP10_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
 p AS (SELECT doc_id, c, substr(h, 2 * c + 1, 710) AS part FROM (SELECT doc_id, h, unnest(range(0, n, 256)) AS c FROM n)),
 w AS (SELECT doc_id, c + j AS s, md5(substr(part, 2 * j + 1, 200)) AS v FROM (SELECT doc_id, c, part, unnest(range(least(256, length(part) // 2 - 99))) AS j FROM p)),
 r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY v ORDER BY doc_id, s) AS nth FROM w) WHERE nth > 1),
 i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM r)),
 x AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, run),
 k AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM x UNION ALL SELECT n.doc_id, coalesce(max(x.b), 0), max(n.n) FROM n LEFT JOIN x USING (doc_id) GROUP BY n.doc_id),
 t AS (SELECT k.doc_id, string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (b - a))::BIGINT), '' ORDER BY a) AS kept FROM k JOIN n USING (doc_id) GROUP BY k.doc_id)
 SELECT n.doc_id, n.n::BIGINT AS n_bytes, (n.n - length(kept) // 2)::BIGINT AS n_removed, (SELECT count(*) FROM x WHERE x.doc_id = n.doc_id) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM n JOIN t USING (doc_id)"""
