"""Language-model scores by prediction by partial matching, with word unigrams beside it.

The model is a trie of byte contexts up to ORDER bytes, learned from the training documents (those whose CRC-32 of the id
as text leaves another remainder than 2 by 7). A text is its lower-cased words (A-Z) joined by single spaces, and one END.
To code a symbol, the longest known context predicts it by its count, or escapes; the escape counts for the number of the
context's different symbols (method C). Symbols that an escaped context holds are excluded from the shorter one. What a
symbol that no context holds costs ends in a uniform choice among the symbols never seen. No string is pruned, however rare:
the trie grows with the corpus and is never in one place.

How it is laid out. A string is ORDER symbols and the one they predict, in one number of 54 bits; counts of shorter
strings are sums over longer ones. What a symbol costs depends on its string alone, so each different string of the
corpus is costed once, and blocks of documents ask for the strings they hold:

1. Tasks deal their documents into blocks of about BLOCK bytes and write, with the documents, each block's different words
   and strings with their training counts, compressed, by a hash of the word or of the string's context (`bucket`).
2. Buckets add up the counts of all blocks. Words are answered to the blocks at once.
3. Strings are sorted by the last three symbols of their context. Together with the (joined) counts of their last two, and
   those of the last one, which are few (257 * 257 at most) and sent to all tasks, that is all their costs depend on; a
   group of one such context is bounded by the alphabet. Because the symbols of a context are among those of its suffix,
   what an escape excludes depends on the context escaped from alone.
4. Costs go to the buckets, and from there to the blocks that asked; a block scores its documents by lookup.

Defined cases: a null or empty text is one END; a null doc_id counts as an empty id; without training documents words get
probability 1 (the smoothing over no token) and symbols the uniform one; repeated rows are scored and counted each; an
empty table gives no rows; extra columns are ignored. Blocks follow the rows as they are read, so that neither missing
nor repeated ids nor copies make a large one; a text longer than BLOCK is a block of its own.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.llm.text import from_planes, planes, text_batches
from lithograph.session import materialize

ORDER = 5
END = 256
SYMBOLS = 257
SHIFT = np.uint64(9)  # bits of a symbol
CHUNK = 1 << 21
BLOCK = 1 << 24
GROUP = 200_000  # strings costed at once, and the rest of their context
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def plain(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def _keys(stream: np.ndarray) -> np.ndarray:
    """Each symbol of a stream with the ORDER before it in one number."""
    key = stream.copy()
    for back in range(1, ORDER + 1):
        key[back:] |= stream[:-back] << (SHIFT * np.uint64(back))
    return key


def gram_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of the texts and their ENDs: its ORDER symbols before it and itself in one number; and its text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    stream = np.full(int(sizes.sum()) + (ORDER + 1) * len(texts), END, dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    first = np.cumsum(sizes + ORDER + 1) - sizes - 1  # place of each text's first symbol
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1) + first[owner]
    is_end = np.zeros(len(owner), dtype=bool)
    is_end[np.cumsum(sizes + 1) - 1] = True
    stream[place[~is_end]] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    return _keys(stream)[place], owner


def keyed(texts: list[bytes], size: int | None = None):
    """(keys, owner) as of gram_keys, in parts of about size symbols; a long text goes in pieces."""
    size = size or CHUNK
    held: list[int] = []
    total = 0
    for i, text in enumerate(texts):
        if len(text) > size:
            for at in range(0, len(text) + 1, size):
                body = np.frombuffer(text[max(0, at - ORDER) : at + size], dtype=np.uint8).astype(np.uint64)
                before = np.full(max(0, ORDER - at), END, dtype=np.uint64)
                stream = np.concatenate([before, body, np.full(int(at + size > len(text)), END, dtype=np.uint64)])
                yield _keys(stream)[ORDER:], np.full(len(stream) - ORDER, i)
            continue
        held.append(i)
        total += len(text) + ORDER
        if total > size:
            keys, owner = gram_keys([texts[j] for j in held])
            yield keys, np.array(held)[owner]
            held, total = [], 0
    if held:
        keys, owner = gram_keys([texts[j] for j in held])
        yield keys, np.array(held)[owner]


def count_keys(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and how often each occurs."""
    if counts is not None:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    else:
        keys = np.sort(keys)
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    many = np.diff(np.append(cut, len(keys))) if counts is None else np.add.reduceat(counts, cut) if len(cut) else counts
    return keys[cut], many


def _low(order: int) -> np.uint64:
    return np.uint64((1 << (9 * (order + 1))) - 1)


class Table:
    """Keys to places 0 .. n - 1, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.place = np.full(1 << bits, _EMPTY), np.full(1 << bits, -1, dtype=np.int32)
        open_, at = np.arange(len(keys)), self.slots(keys)
        while len(open_):
            free = self.keys[at] == _EMPTY
            self.place[at[free]] = open_[free]
            won = free & (self.place[at] == open_)
            self.keys[at[won]] = keys[open_[won]]
            open_, at = open_[~won], (at[~won] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if it is not there."""
        at = self.slots(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.place[at], -1)
        open_ = np.flatnonzero((seen != keys) & (seen != _EMPTY))
        while len(open_):
            at = (at[open_] + 1) & self.mask if len(at) != len(open_) else (at + 1) & self.mask
            seen = self.keys[at]
            hit = seen == keys[open_]
            out[open_[hit]] = self.place[at[hit]]
            going = ~hit & (seen != _EMPTY)
            open_, at = open_[going], at[going]
        return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each string's context; buckets is a power of two."""
    return (((keys >> SHIFT) * _SPREAD) >> np.uint64(65 - buckets.bit_length())).astype(np.int32)


def buckets_for(spark) -> int:
    """A power of two, a few buckets for each shuffle partition."""
    return 1 << max(4, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def pack(numbers: np.ndarray) -> bytes:
    return zstandard.compress(planes(numbers), 1)


def unpack(packed: bytes, kind: type) -> np.ndarray:
    data = zstandard.decompress(packed)
    return from_planes(data, kind, len(data) // np.dtype(kind).itemsize)


def pack_keys(keys: np.ndarray) -> bytes:
    """Keys in order, as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, np.uint64), dtype=np.uint64)


def held_out() -> Column:
    """Whether a document is held out of training."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


_BLOCKS = pa.schema(
    [("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary()), ("block", pa.int64()), ("bucket", pa.int32())]
    + [(name, pa.binary()) for name in ("words", "word_counts", "grams", "gram_counts")]
)
BLOCKS = "doc_ids array<long>, held_out array<boolean>, sizes array<long>, texts binary, block long, bucket int, words binary, word_counts binary, grams binary, gram_counts binary"


def requests(block: int, texts: list[tuple[bytes, bool]], buckets: int) -> pa.RecordBatch:
    """The different words and strings of a block's (text, held_out), with their counts in training texts, by bucket."""
    counts: Counter[bytes] = Counter()
    both: tuple[list[bytes], list[bytes]] = ([], [])
    for text, held in texts:
        words = text.lower().split()
        if held:
            for w in words:
                counts.setdefault(w, 0)
        else:
            counts.update(words)
        both[held].append(b" ".join(words))
    keys, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    for held, plains in enumerate(both):
        for part, _ in keyed(plains):
            more, times = count_keys(part)
            keys, n = count_keys(np.concatenate([keys, more]), np.concatenate([n, times * (1 - held)]))
    words = sorted(counts)
    times = np.fromiter(map(counts.__getitem__, words), dtype=np.uint32, count=len(words))
    of_word = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)) & np.uint32(buckets - 1)
    of_key = bucket_of(keys, buckets)
    by_word, by_key = np.argsort(of_word, kind="stable"), np.argsort(of_key, kind="stable")
    cut_word, cut_key = (np.searchsorted(x, np.arange(buckets + 1)) for x in (of_word[by_word], of_key[by_key]))
    keys, n, times, rows = keys[by_key], n[by_key].astype(np.uint32), times[by_word], []
    words = [words[i] for i in by_word.tolist()]
    for b in range(buckets):
        w, k = slice(cut_word[b], cut_word[b + 1]), slice(cut_key[b], cut_key[b + 1])
        if w.start < w.stop or k.start < k.stop:
            rows.append((b, zstandard.compress(b" ".join(words[w]), 1), pack(times[w]), pack_keys(keys[k]), pack(n[k])))
    packed = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (f.type for f in list(_BLOCKS)[5:]), strict=True)]
    return pa.RecordBatch.from_arrays([pa.nulls(len(rows), f.type) for f in list(_BLOCKS)[:4]] + [pa.array([block] * len(rows), pa.int64()), *packed], schema=_BLOCKS)


def _documents(block: int, rows: pa.RecordBatch) -> pa.RecordBatch:
    """Documents of a block as one row."""
    texts = [t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()]
    columns = [rows.column("doc_id").to_pylist(), rows.column("held_out").to_pylist(), list(map(len, texts)), zstandard.compress(b"".join(texts), 1), block, *[None] * 5]
    return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, _BLOCKS, strict=True)], schema=_BLOCKS)


def _cut_blocks(buckets: int, size: int):
    """Documents with their block, and between them what each block asks for."""

    def run(batches):
        block, used, texts = TaskContext.get().partitionId() << 32, 0, []
        for part, found in text_batches(batches):
            first, held = 0, part.column("held_out").to_pylist()
            for i, text in enumerate(found):
                texts.append((text or b"", held[i]))
                used += len(text or b"")
                if used >= size:
                    yield _documents(block, part.slice(first, i + 1 - first))
                    yield requests(block, texts, buckets)
                    block, used, texts, first = block + 1, 0, [], i + 1
            if first < part.num_rows:
                yield _documents(block, part.slice(first))
        if texts:
            yield requests(block, texts, buckets)

    return run


def _by_bucket(batches):
    """Lists of the rows of each bucket, from batches sorted by bucket."""
    held, now = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["bucket"] != now:
                yield held
                held = []
            now = row["bucket"]
            held.append(row)
    if held:
        yield held


ANSWERS = "block long, words binary, word_counts binary, n long, v long"


def _count_words(batches):
    """Training counts of the words that each block asked for; and of each bucket their sum and how many are above zero."""
    for rows in _by_bucket(batches):
        total: dict[bytes, int] = {}
        asked = [(r["block"], r["words"], zstandard.decompress(r["words"]).split(), unpack(r["word_counts"], np.uint32).tolist()) for r in rows]
        for _, _, words, counts in asked:
            for w, c in zip(words, counts, strict=True):
                total[w] = total.get(w, 0) + c
        found = [pack(np.fromiter(map(total.__getitem__, words), dtype=np.int64, count=len(words))) for _, _, words, _ in asked]
        none = [None] * len(asked)
        columns = [[a[0] for a in asked] + [None], [a[1] for a in asked] + [None], [*found, None], [*none, sum(total.values())], [*none, sum(c > 0 for c in total.values())]]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["block", "words", "word_counts", "n", "v"])


def _count_strings(batches):
    """(key, n) of each bucket's strings."""
    for rows in _by_bucket(batches):
        keys, counts = count_keys(np.concatenate([unpack_keys(r["grams"]) for r in rows]), np.concatenate([unpack(r["gram_counts"], np.uint32).astype(np.int64) for r in rows]))
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000].view(np.int64)), pa.array(counts[at : at + 100_000])], ["key", "n"])


def low(order: int) -> int:
    """A mask of the last symbols of a string: `order` of context and the one they predict."""
    return (1 << (9 * (order + 1))) - 1


def symbol_costs(n: list[np.ndarray], total: list[np.ndarray], kinds: list[np.ndarray], held: list[np.ndarray]) -> np.ndarray:
    """log10 probability of the symbol of each string, given by order of context: how often context and symbol occur, how
    often the context does and with how many symbols, and how often those follow the context without its first symbol."""
    cost = np.zeros(len(n[0]))
    open_, fresh = np.ones(len(cost), dtype=bool), np.ones(len(cost), dtype=bool)
    for order in range(ORDER, -1, -1):
        left, escape = total[order], kinds[order]
        if order < ORDER:  # without the symbols of the context escaped from
            left = np.where(fresh, left, left - held[order + 1])
            escape = np.where(fresh, escape, escape - kinds[order + 1])
        usable, seen = open_ & (escape > 0), n[order] > 0
        hit, miss = usable & seen, usable & ~seen
        cost[hit] += np.log10(n[order][hit] / (left[hit] + escape[hit]))
        cost[miss] += np.log10(escape[miss] / (left[miss] + escape[miss]))
        open_ &= ~hit
        fresh &= total[order] == 0
    cost[open_] -= np.log10(np.maximum(1, SYMBOLS - kinds[0][open_]))
    return cost


def string_costs(keys: np.ndarray, counts: np.ndarray, two: list[np.ndarray], one: np.ndarray) -> np.ndarray:
    """log10 probability of the last symbol of each string; all strings with the last three symbols of a context are there.

    two: for each string n, total, kinds and held (as of symbol_costs) at order 2; one: counts of pairs, 257 x 257.
    """
    n, total, kinds, held = ([None] * (ORDER + 1) for _ in range(4))
    n[2], total[2], kinds[2], held[2] = two
    for order in range(ORDER, 2, -1):
        grams, at = np.unique(keys & np.uint64(low(order)), return_inverse=True)
        many = np.bincount(at, counts, len(grams))
        n[order] = many[at]
        first = np.zeros(len(grams), dtype=np.int64)
        first[at] = np.arange(len(keys))
        below = grams & np.uint64(low(order - 1))
        if order > 3:
            shorter, place = np.unique(keys & np.uint64(low(order - 1)), return_inverse=True)
            shorter_many = np.bincount(place, counts, len(shorter))[np.searchsorted(shorter, below)]
        else:
            shorter_many = two[0][first]
        contexts, of = np.unique(grams >> SHIFT, return_inverse=True)
        per = [np.bincount(of, x, len(contexts)) for x in (many, many > 0, np.where(many > 0, shorter_many, 0))]
        total[order], kinds[order], held[order] = (x[of][at] for x in per)
    last, symbol = ((keys >> SHIFT) & np.uint64(511)).astype(np.int64), (keys & np.uint64(511)).astype(np.int64)
    zero = one.sum(axis=0)
    n[1], n[0] = one[last, symbol], zero[symbol]
    total[1], kinds[1], held[1] = one.sum(axis=1)[last], (one > 0).sum(axis=1)[last], ((one > 0) @ zero)[last]
    total[0], kinds[0], held[0] = (np.full(len(keys), float(x)) for x in (zero.sum(), (zero > 0).sum(), 0))
    return symbol_costs(n, total, kinds, held)


COSTS = "bucket int, block long, grams binary, costs binary"


def _cost_strings(one, buckets: int):
    """Costs of strings by bucket, from rows sorted by the last three symbols of their context."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        count = 0

        def costs(rows: pa.Table) -> pa.RecordBatch:
            keys, counts, *two = (rows.column(c).to_numpy() for c in ("key", "n", "n2", "t2", "k2", "h2"))
            keys = keys.view(np.uint64)
            found, bucket = string_costs(keys, counts, two, one.value).astype(np.float32), bucket_of(keys, buckets)
            order = np.lexsort((keys, bucket))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = [(b, order[x:y]) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if x < y]
            columns = [pa.array([b for b, _ in out], pa.int32()), pa.nulls(len(out), pa.int64())]
            columns += [pa.array([pack_keys(keys[x]) for _, x in out], pa.binary()), pa.array([pack(found[x]) for _, x in out], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "block", "grams", "costs"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count > GROUP:
                rows = pa.Table.from_batches(held)
                group = rows.column("c3").to_numpy()
                cut = int(np.searchsorted(group, group[-1]))
                if cut:
                    yield costs(rows.slice(0, cut))
                    held, count = rows.slice(cut).to_batches(), rows.num_rows - cut
        if held:
            yield costs(pa.Table.from_batches(held))

    return run


def _answer_strings(batches):
    """The costs of the strings that each block asked for; rows without a block hold the bucket's costs and come first."""
    for rows in _by_bucket(batches):
        known = [r for r in rows if r["block"] is None]
        keys, costs = np.concatenate([unpack_keys(r["grams"]) for r in known]), np.concatenate([unpack(r["costs"], np.float32) for r in known])
        order = np.argsort(keys)
        keys, costs = keys[order], costs[order]
        asked = [(r["block"], r["grams"]) for r in rows if r["block"] is not None]
        found = [pack(costs[np.searchsorted(keys, unpack_keys(grams))]) for _, grams in asked]
        columns = [pa.array([b for b, _ in asked], pa.int64()), pa.array([g for _, g in asked], pa.binary()), pa.array(found, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["block", "grams", "costs"])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_block(total: int, kinds: int, ends: int):
    base = math.log10(total + kinds + 1)

    def score(key, left, right):
        cost, seen, keys, costs = {}, set(), [], []
        for words, counts, grams, found in zip(*(right.column(c) for c in ("words", "word_counts", "grams", "costs")), strict=True):
            if words.is_valid:
                named, known = zstandard.decompress(words.as_py()).split(), unpack(counts.as_py(), np.int64)
                cost.update(zip(named, (np.log10(known + 1.0) - base).tolist(), strict=True))
                seen.update(w for w, c in zip(named, known.tolist(), strict=True) if c)
            if grams.is_valid:
                keys.append(unpack_keys(grams.as_py()))
                costs.append(unpack(found.as_py(), np.float32))
        table, costs, end = Table(np.concatenate(keys)), np.concatenate(costs), math.log10(ends + 1) - base
        doc_ids, held, n_tokens, n_known, base_score, score = [], [], [], [], [], []
        for row in left.select(["doc_ids", "held_out", "sizes", "texts"]).to_pylist():
            doc_ids += row["doc_ids"]
            held += row["held_out"]
            ends_at, whole, plains = list(accumulate(row["sizes"])), zstandard.decompress(row["texts"]), []
            for at, size in zip(ends_at, row["sizes"], strict=True):
                words = whole[at - size : at].lower().split()
                n_tokens.append(len(words) + 1)
                n_known.append(sum(map(seen.__contains__, words)) + (ends > 0))
                base_score.append(math.fsum(map(cost.__getitem__, words)) + end)
                plains.append(b" ".join(words))
            sums = np.zeros(len(plains))
            for part, owner in keyed(plains):
                sums += np.bincount(owner, costs[table.find(part)], len(plains))
            score += sums.tolist()
        columns = (doc_ids, held, n_tokens, n_known, [total] * len(doc_ids), base_score, score)
        kinds_ = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds_, strict=True)], names=[c.split()[0] for c in SCORES.split(", ")])

    return score


def score_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: the columns of SCORES; learns from docs itself."""
    spark = docs.sparkSession
    buckets = buckets_for(spark)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    blocks = materialize(rows.mapInArrow(_cut_blocks(buckets, block), BLOCKS), "ppm-blocks")
    texts, asked = blocks.filter("bucket IS NULL"), blocks.filter("bucket IS NOT NULL")
    by_bucket = lambda df, *then: df.repartition("bucket").sortWithinPartitions("bucket", *then)

    words = materialize(by_bucket(asked.select("bucket", "block", "words", "word_counts")).mapInArrow(_count_words, ANSWERS), "ppm-words")
    sums = words.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    ends = texts.agg(F.sum(F.size(F.filter("held_out", lambda x: ~x)))).first()[0] or 0
    total, kinds = (int(sums["n"] or 0) + ends, int(sums["v"] or 0) + (ends > 0))

    strings = materialize(by_bucket(asked.select("bucket", "grams", "gram_counts")).mapInArrow(_count_strings, "key long, n long"), "ppm-strings")
    mask = lambda order, key="key": F.col(key).bitwiseAND(F.lit(low(order)))
    pairs = strings.groupBy(mask(1).alias("g1")).agg(F.sum("n").alias("n1"))
    found = pairs.toArrow()  # 257 * 257 rows at most
    one, g1 = np.zeros((SYMBOLS, SYMBOLS)), found.column("g1").to_numpy()
    one[g1 >> 9, g1 & 511] = found.column("n1").to_numpy()
    triples = strings.groupBy(mask(2).alias("g2")).agg(F.sum("n").alias("n2"))
    known = triples.join(pairs, mask(1, "g2") == F.col("g1")).withColumn("c2", F.shiftright("g2", 9))
    context = known.groupBy("c2").agg(F.sum("n2").alias("t2"), F.count_if(F.col("n2") > 0).alias("k2"), F.sum(F.when(F.col("n2") > 0, F.col("n1")).otherwise(0)).alias("h2"))
    two = known.join(context, "c2").select("g2", *(F.col(c).cast("double").alias(c) for c in ("n2", "t2", "k2", "h2")))
    rows = strings.join(two, mask(2) == F.col("g2")).select(F.shiftright(mask(3), 9).alias("c3"), "key", "n", "n2", "t2", "k2", "h2")
    costed = rows.repartition("c3").sortWithinPartitions("c3").mapInArrow(_cost_strings(spark.sparkContext.broadcast(one), buckets), COSTS)
    met = by_bucket(costed.union(asked.select("bucket", "block", "grams", F.lit(None).cast("binary").alias("costs"))), "block")
    strung = met.mapInArrow(_answer_strings, "block long, grams binary, costs binary")

    none = F.lit(None).cast("binary")
    answers = words.filter("block IS NOT NULL").select("block", "words", "word_counts", none.alias("grams"), none.alias("costs"))
    answers = answers.union(strung.select("block", none.alias("words"), none.alias("word_counts"), "grams", "costs"))
    scored = texts.select("doc_ids", "held_out", "sizes", "texts", "block").groupBy("block").cogroup(answers.groupBy("block"))
    return scored.applyInArrow(_score_block(total, kinds, ends), SCORES)


def op5_language_model(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
