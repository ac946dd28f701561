"""Sharding, periodic runs and the filter audit against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lithograph.llm import filter_audit, periodic_runs, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, shard string, slot int, part string, mask int, tag long, rows int, runs string, size int, draw int, digest string, key string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4, "z", 5, 6, "d", "k") for r in rows], DOCS).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(50)] + ["É", "日本", "A", "Zed", "#tag"]
    out = []
    for i in range(120):
        text = " ".join(rng.choices(vocabulary[: rng.choice([3, 10, 55])], k=rng.randrange(0, 160)))
        out.append((i, rng.choice([text, text.upper(), text + " #"]), rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "é", None])))
    out += [(i, out[3][1], "en", "s1") for i in range(120, 170)]  # a text that many share
    out += [(None, out[4][1], "fr", "s2")] * 40 + [(None, "t", "fr", "s2")] * 3 + [(3, out[3][1], "en", "s1")] * 30  # no id, repeated rows
    out += [(200, None, None, None), (201, "", "en", "s1"), (202, " \n\t\x0b ", "en", "s1"), (203, "a b " * 4000, "en", "s3"), (204, "nbsp is no space", "en", "s3")]
    return out


# --- sharding


def counted(frame, *columns):
    return collections.Counter(tuple(r) for r in frame.select(*columns).collect())


@pytest.mark.parametrize("chunk", [4, 1 << 16])
def test_shards_hold_every_row_and_every_source_in_its_share(spark, rows, chunk, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", chunk)
    places = sharding.shard_places(frame(spark, rows), shards=7)
    got = places.collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted(r.position for r in got) == list(range(len(rows)))
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and sorted(by_shard) == list(range(7))
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    sizes = collections.Counter(r.stratum for r in got)
    for (stratum, _), n in collections.Counter((r.stratum, r.shard) for r in got).items():
        assert abs(n - sizes[stratum] / 7) <= 2
    assert counted(places, "stratum") == collections.Counter({("" if s is None else "s" + s,): n for s, n in collections.Counter(x[3] for x in rows).items()})


def test_shards_do_not_depend_on_partitions_but_on_the_seed(spark, rows):
    columns = ("doc_id", "size", "text_crc32", "shard", "slot")
    first = counted(sharding.shard_places(frame(spark, rows, 2), 7), *columns)
    assert first == counted(sharding.shard_places(frame(spark, rows, 5), 7), *columns)
    assert first != counted(sharding.shard_places(frame(spark, rows, 5), 7, seed=1), *columns)


def test_positions_are_the_order_of_fractional_ranks(spark, rows):
    got = sharding.shard_places(frame(spark, rows), 5).orderBy("position").collect()
    sizes = collections.Counter(r.stratum for r in got)
    seen, order = collections.Counter(), []
    for r in got:
        order.append(((2 * seen[r.stratum] + 1) / (2 * sizes[r.stratum]), r.stratum))
        seen[r.stratum] += 1
    assert order == sorted(order)


def test_few_rows_and_none(spark):
    few = sharding.shard_places(frame(spark, [(1, "a", None, None), (1, "a", None, None)]), 24).collect()
    assert len({r.shard for r in few}) == 2 and {r.slot for r in few} == {0}
    assert sharding.shard_places(frame(spark, []), 24).count() == 0


def test_written_shards_keep_texts_and_columns(spark, rows, tmp_path):
    docs = frame(spark, rows)
    sharding.write_shards(docs, str(tmp_path / "out"), 7, file_rows=20)
    written = sharding.write_shards(docs, str(tmp_path / "out"), 7, file_rows=20)  # a second run takes the first one's place
    assert set(written.columns) == set(docs.columns)
    assert counted(written, "doc_id", "text", "source", "size", "key") == counted(docs, "doc_id", "text", "source", "size", "key")
    placed = written.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("bytes"), "shard", "slot")
    assert counted(placed, *placed.columns) == counted(sharding.shard_places(docs, 7), "doc_id", "size", "shard", "slot")
    for file in {r[0] for r in written.select(F.input_file_name()).collect()}:
        slots = [r.slot for r in spark.read.parquet(file).collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots)))


# --- periodic runs


def slow_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng, n, k):
    t = [rng.randrange(k) for _ in range(n)]
    if n > 20 and rng.random() < 0.8:
        p, a = rng.randrange(1, max(2, n // 5)), rng.randrange(0, n // 2)
        for i in range(a, min(n, a + p * rng.randrange(4, 9))):
            t[i] = t[a + (i - a) % p]
    return (t[: n // 8] * 9)[:n] if n > 100 and rng.random() < 0.5 else t


def test_runs_against_all_periods():
    rng = random.Random(3)
    for _ in range(250):
        texts = [repetitive(rng, rng.choice([0, 1, 5, 6, 7, 20, 60, 200]), rng.choice([1, 2, 3, 5, 30])) for _ in range(rng.randrange(1, 6))]
        got = periodic_runs.find_runs([np.array(t, dtype=np.int64) for t in texts])
        assert [[tuple(r) for r in x.tolist()] for x in got] == [slow_runs(t) for t in texts]


def test_runs_of_a_long_text_by_pieces(monkeypatch):
    monkeypatch.setattr(periodic_runs, "QUERIES_AT_ONCE", 1000)
    rng = random.Random(4)
    t = [rng.randrange(40) for _ in range(3000)] + list(range(100, 700)) * 5 + [7] * 4000 + [1, 2] * 900
    assert [tuple(r) for r in periodic_runs.find_runs([np.array(t)])[0].tolist()] == slow_runs(t)


def test_extensions_are_exact_both_ways():
    rng = random.Random(5)
    for n, k in ((300, 2), (500, 4), (400, 1), (800, 60)):
        words = np.array([k, *repetitive(rng, n, k), k + 1])
        levels = periodic_runs.build_grammar(words)
        assert len(levels[-1].names) == 1
        x, y = np.array(sorted({tuple(sorted(rng.sample(range(1, n + 1), 2))) for _ in range(400)})).T
        there, back = periodic_runs.common_extensions(levels, x, y), periodic_runs.common_extensions(periodic_runs.mirrored(levels), len(words) - x, len(words) - y)
        for i, j, f, b in zip(x, y, there, back):
            assert f == next(m for m in itertools.count() if words[i + m] != words[j + m])
            assert b == next(m for m in itertools.count() if words[i - 1 - m] != words[j - 1 - m])


def test_grammar_spells_the_text():
    rng = random.Random(6)
    words = np.array([9, *repetitive(rng, 500, 5), 10])
    levels = periodic_runs.build_grammar(words)
    spelled = {}
    for level, under in zip(levels[1:], levels):
        for i, name in enumerate(level.names):
            parts = tuple(under.names[level.bounds[i] : level.bounds[i + 1]])
            assert spelled.setdefault((id(level), name), parts) == parts
        assert level.bounds[0] == 0 and level.bounds[-1] == len(under.names) and (np.diff(level.bounds) > 0).all()


@pytest.mark.parametrize("group", [1, 1 << 18])
def test_run_query_against_plain_python(spark, rows, group, tmp_path, monkeypatch):
    monkeypatch.setattr(periodic_runs, "GROUP_WORDS", group)
    more = rows + [(300 + i, " ".join(f"u{j}" for j in range(i)), "en", "s1") for i in range(60)]
    frame(spark, more).write.parquet(str(tmp_path / "documents.parquet"))
    got = counted(periodic_runs.op12_periodic_runs(spark, str(tmp_path)), "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    want = collections.Counter()
    for i, t, *_ in more:
        w = WORD.findall(t or "")
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs = slow_runs(w)
        kept = [x for j, x in enumerate(w) if not any(s + q <= j < s + length for s, length, q in runs)]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[i, len(runs), *numbers, hashlib.sha256("".join(f"{s},{n_},{q}\n" for s, n_, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    assert got == want
    assert sum(n for (_, n_runs, *_), n in want.items() if n_runs) > 20


def test_no_texts_no_runs(spark):
    assert periodic_runs.collapse_runs(frame(spark, [])).count() == 0


# --- filter audit


def slow_audit(rows, good, toxic):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, lang, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        docs.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order):
                here = collections.Counter()
                for lang, fails, is_good, is_toxic in docs:
                    if lang != part:
                        continue
                    gone = any(fails[y] for y in order[:step])
                    here["kept"] += not gone and not fails[x]
                    here["removed"] += not gone and fails[x]
                    here["redundant"] += gone and fails[x]
                    here["unique"] += fails[x] and sum(fails.values()) == 1
                    here["good"] += not gone and fails[x] and is_good
                    here["toxic"] += not gone and fails[x] and is_toxic
                shapley[x] += here["removed"]
                out[part, "".join(order), step + 1] = [here[k] for k in ("kept", "removed", "redundant", "unique", "good", "toxic")]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_all_orders(spark, rows):
    said = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 210, 2)] + [(4, 1, 1), (6, None, None), (None, 1, 1)]
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int")
    good, toxic = ({i for i, *x in said if i is not None and x[k] == 1} for k in (0, 1))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit_filters(frame(spark, rows), labels).collect()}
    assert got == slow_audit(rows, good, toxic)
    assert len(got) == 600 * 4


def test_audit_of_nothing(spark):
    assert filter_audit.audit_filters(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 255, 256, 2**40])
def test_wide_fields_do_not_overflow(n):
    width = n.bit_length()
    for mask in range(32):
        once = filter_audit.unpack(filter_audit.wide_integer(mask, width), width)
        assert filter_audit.unpack(filter_audit.wide_integer(mask, width) * n, width) == [n * x for x in once]


@pytest.mark.parametrize("module, query, sql", [(sharding, "op11_sharding", "OP11_SQL"), (filter_audit, "op13_filter_audit", "OP13_SQL")])
def test_against_sql(spark, rows, module, query, sql, tmp_path):
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = getattr(module, query)(spark, str(tmp_path))
    want = con.execute(getattr(module, sql))
    names = [d[0] for d in want.description]
    assert collections.Counter(tuple(r[c] for c in names) for r in got.collect()) == collections.Counter(want.fetchall())
