"""Periodic runs of words by recompression, and texts with their runs collapsed to one period.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) of at least max(6, 4 q) words
that no neighbouring word extends. Collapsing drops every word that some run holds after its first q words.

Recompression turns the words into a run-length grammar, level by level: block compression makes one symbol of each block
of equal symbols; pair compression parts the symbols in two sets, and makes one symbol of every neighbouring pair with its
first in one set and its second in the other. Symbols that occur once cannot be part of anything repeated, so neighbours
among them make one block too. Equal stretches get equal symbols but for a few at their ends, at every level: the longest
common extension of two places climbs while symbols agree and descends where they differ, a few symbols on each level.

Candidates come from a harmonic grid: a run of period q has at least max(6, 4 q) - q places in a row whose word is also q
further on, so one of them is a multiple of that step. For each period the places on its grid are tried, n log n / 3 in all; where the
words agree, extensions both ways give the whole stretch exactly. A stretch found under several periods has the least.

Scale: a map over rows, nothing is shuffled. The grammar is built for some hundred texts at a time, held apart by symbols that occur
once; a longer text is taken alone, in memory of a few dozen bytes a word, and its candidates by pieces.

Defined cases: a null or empty text has no words, no runs and the empty text; repeated rows give repeated rows; an
empty table gives none; extra columns are ignored. In the query, a row without doc_id is taken as it stands, without a planted period.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.llm.text import WORD, text_batches

LEAST_WORDS = 6
LEAST_PERIODS = 4
GROUP_WORDS = 1 << 18
QUERIES_AT_ONCE = 1 << 20
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


@dataclass
class Level:
    """Symbols of one level; symbol i stands for bounds[i] .. bounds[i + 1] of the level below, blocks tells which step made it."""

    names: np.ndarray
    bounds: np.ndarray
    blocks: bool


def _renamed(names: np.ndarray, starts: np.ndarray, merged: np.ndarray, by: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
    """Names of new symbols: that of their first symbol or, where merged, a fresh one for each different value of by."""
    new = names[starts]
    if len(by):
        codes = pd.factorize(by)[0]
        new[merged] = fresh + codes
        fresh += int(codes.max()) + 1
    return new, fresh


def compress_blocks(names: np.ndarray, fresh: int) -> tuple[Level, int]:
    """Each block of equal symbols, and each stretch of symbols that occur once, as one symbol."""
    once = np.bincount(names, minlength=fresh)[names] == 1
    split = (names[1:] != names[:-1]) & ~(once[1:] & once[:-1])
    starts = np.concatenate([[0], np.flatnonzero(split) + 1])
    bounds = np.append(starts, len(names))
    length = np.diff(bounds)
    merged = (length > 1) & ~once[starts]
    new, fresh = _renamed(names, starts, merged, names[starts[merged]] * (len(names) + 1) + length[merged], fresh)
    return Level(new, bounds, True), fresh


def compress_pairs(names: np.ndarray, fresh: int, turn: int) -> tuple[Level, int]:
    """Neighbouring symbols of different sets, in the order of the sets that makes more pairs, as one symbol."""
    mixed = (names.astype(np.uint64) + np.uint64(turn * 7919 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    side = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63) == 1
    rises, falls = ~side[:-1] & side[1:], side[:-1] & ~side[1:]
    firsts = np.flatnonzero(rises if np.count_nonzero(rises) >= np.count_nonzero(falls) else falls)
    is_start = np.ones(len(names), dtype=bool)
    is_start[firsts + 1] = False
    starts = np.flatnonzero(is_start)
    merged = np.zeros(len(names), dtype=bool)
    merged[firsts] = True
    new, fresh = _renamed(names, starts, merged[starts], names[firsts] * fresh + names[firsts + 1], fresh)
    return Level(new, np.append(starts, len(names)), False), fresh


def build_grammar(words: np.ndarray) -> list[Level]:
    """Levels from the words up to a single symbol; words are numbers from 0, and the first and the last occur once."""
    fresh = int(words.max()) + 1
    levels = [Level(words, np.zeros(0, dtype=np.int64), False)]
    turn = 0
    while len(levels[-1].names) > 1:
        level, fresh = compress_blocks(levels[-1].names, fresh)
        levels.append(level)
        if len(level.names) > 1:
            turn += 1
            level, fresh = compress_pairs(level.names, fresh, turn)
            levels.append(level)
    return levels


def mirrored(levels: list[Level]) -> list[Level]:
    """The grammar read from the end; the rules of a symbol's ends are the same both ways."""
    below = [levels[0], *levels]
    return [Level(level.names[::-1], len(under.names) - level.bounds[::-1], level.blocks) for under, level in zip(below, levels)]


def _parents(bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, at, side="right") - 1


def common_extensions(levels: list[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of words that agree from each place x on and from y on (x is not y)."""
    a, b = x.copy(), y.copy()
    stopped = np.full(len(x), len(levels) - 1)
    live = np.arange(len(x))
    for low, (level, above) in enumerate(zip(levels, levels[1:])):  # up, as long as symbols agree
        at, bt = a[live], b[live]
        same = level.names[at] == level.names[bt]
        stopped[live[~same]] = low
        live, at, bt = live[same], at[same], bt[same]
        if not len(live):
            break
        pa_, pb = _parents(above.bounds, at), _parents(above.bounds, bt)
        inside = (above.bounds[pa_] != at) | (above.bounds[pb] != bt)
        left_a, left_b = above.bounds[pa_ + 1] - at, above.bounds[pb + 1] - bt
        step = np.where(inside, np.minimum(left_a, left_b) if above.blocks else 1, 0)
        at, bt = at + step, bt + step
        pa_, pb = pa_ + (step == left_a), pb + (step == left_b)
        level_with = (above.bounds[pa_] == at) & (above.bounds[pb] == bt)
        a[live], b[live] = np.where(level_with, pa_, at), np.where(level_with, pb, bt)
        stopped[live[~level_with]] = low
        live = live[level_with]
    for low in range(int(stopped.max(initial=0)), -1, -1):  # down, where they differ
        level, above = levels[low], levels[low + 1] if low + 1 < len(levels) else None
        here = np.flatnonzero(stopped >= low)
        moving = here
        while len(moving := moving[level.names[a[moving]] == level.names[b[moving]]]):
            if above is not None and above.blocks:
                at, bt = a[moving], b[moving]
                step = np.minimum(above.bounds[_parents(above.bounds, at) + 1] - at, above.bounds[_parents(above.bounds, bt) + 1] - bt)
            else:
                step = 1
            a[moving] += step
            b[moving] += step
        if low:
            a[here], b[here] = level.bounds[a[here]], level.bounds[b[here]]
    return a - x


def _grid(first: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of all candidates, by pieces; first and sizes are where each text starts and its number of words."""
    periods = np.where(sizes >= LEAST_WORDS, np.maximum(sizes // LEAST_PERIODS, 1), 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(LEAST_WORDS, LEAST_PERIODS * period) - period
    tries = -((period - sizes[text]) // step)
    piece = np.cumsum(tries) // QUERIES_AT_ONCE
    for lo, hi in zip(begin := np.flatnonzero(np.diff(piece, prepend=-1)), [*begin[1:], len(piece)]):
        n = tries[lo:hi]
        which = np.repeat(np.arange(lo, hi), n)
        turn = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        yield first[text[which]] + turn * step[which], period[which]


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The runs of each text, given as numbers of its words: rows (start, length, period) by start, then period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    fresh = 1 + max((int(t.max()) for t in texts if len(t)), default=0)
    apart = np.arange(fresh, fresh + len(texts) + 1)
    joined = np.concatenate([*(x for t, mark in zip(texts, apart) for x in ([mark], t)), apart[-1:]]).astype(np.int64)
    first = np.cumsum(sizes + 1) - sizes
    levels = build_grammar(joined)
    back = mirrored(levels)
    found = [np.zeros((0, 3), dtype=np.int64)]
    for place, period in _grid(first, sizes):
        agree = joined[place] == joined[place + period]
        x, period = place[agree], period[agree]
        start = x - common_extensions(back, len(joined) - x, len(joined) - x - period)
        end = x + period + common_extensions(levels, x, x + period)
        enough = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        found.append(np.stack([start, end - start, period], axis=1)[enough])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh_stretch = np.ones(len(runs), dtype=bool)
    fresh_stretch[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[fresh_stretch]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    text = np.searchsorted(first, runs[:, 0], side="right") - 1
    runs[:, 0] -= first[text]
    return np.split(runs, np.searchsorted(text, np.arange(1, len(texts))))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """True for words that no run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:-1] == 0


def _groups(texts: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    """Texts in groups of about GROUP_WORDS words."""
    group, held = [], 0
    for words in texts:
        if group and held + len(words) > GROUP_WORDS:
            yield group
            group, held = [], 0
        group.append(words)
        held += len(words)
    if group:
        yield group


def _numbers(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Words as numbers, the same for the same word."""
    flat = pa.array([w for words in texts for w in words], pa.binary())
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    return np.split(codes, np.cumsum([len(words) for words in texts])[:-1])


def _scan(batches):
    for part, raw in text_batches(batches):
        n_words, found, collapsed = [], [], []
        for group in _groups([(t or b"").split() for t in raw]):
            for words, runs in zip(group, find_runs(_numbers(group)), strict=True):
                n_words.append(len(words))
                found.append(runs)
                collapsed.append(b" ".join(np.array(words, dtype=object)[kept_words(len(words), runs)] if len(runs) else words))
        rows = np.concatenate(found)
        structs = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["start", "length", "period"])
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(offsets, structs), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
        )


def collapse_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period) and collapsed, its kept words joined by a space."""
    return docs.select("doc_id", "text").mapInArrow(_scan, RUNS)


def planted(doc_id: Column, words: Column) -> Column:
    """The words of a document in which a tenth of all documents repeat a stretch from some word on, as the query has it."""
    n = F.size(words).cast("long")
    g = F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 10)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    cycle = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, 10)), F.lit(1), (n - a).cast("int"))  # n - a is below 10 p
    return F.concat(F.slice(words, F.lit(1), a.cast("int")), tail)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    text = F.when(chosen & F.col("text").rlike(WORD), F.array_join(planted(F.col("doc_id"), words), " ")).otherwise(F.col("text"))
    runs = collapse_runs(docs.select("doc_id", text.alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listing = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return runs.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"),
        F.sha2(listing, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select("doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
