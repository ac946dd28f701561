"""Derived tables: a catalogue, chips, tiles, labels and more, as SQL over the given tables.

The same SQL serves Spark and DuckDB; only functions on arrays are spelled for each.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Name to SQL. MAP(list, x, expr), AT(list, n) and LIST(..) are spelled by dialect.
FIXTURES = {
    "catalog": """SELECT concat('C-', cast(o_orderkey AS varchar(20))) AS crater_id, cast((o_orderkey * 37) % 18000 AS double) / 100 - 90 AS lat,
        cast((o_custkey * 97 + o_orderkey) % 36000 AS double) / 100 AS lon, cast(o_orderkey % 2000 + 50 AS double) / 100 AS diam_km FROM orders""",
    "ids": "SELECT concat('C-', cast(c_custkey AS varchar(20))) AS crater_id FROM customer",
    "chips": "SELECT vec_id AS id, 1 AS c, 8 AS h, 8 AS w, MAP(embedding, x, cast(floor((cast(x AS double) + 1) * 127.5) AS int)) AS px FROM embeddings",
    "tiles": "SELECT cast(floor(id / 20.0) AS bigint) AS tile_row, cast(id % 20 AS bigint) AS tile_col, px FROM chips",
    "geo": """SELECT cast(-80000 AS double) AS x0, cast(40000 AS double) AS y0, cast(1000 AS double) AS xres, cast(80000 AS double) / cast((max(tile_row) + 1) * 8 AS double) AS yres,
        cast(160 AS bigint) AS width, cast((max(tile_row) + 1) * 8 AS bigint) AS height, 8 AS tile FROM tiles""",
    "windows": """SELECT vec_id AS id, cast((vec_id * 13) % 190 AS bigint) AS r0, cast((vec_id * 7) % 150 AS bigint) AS c0, cast(10 AS bigint) AS h, cast(10 AS bigint) AS w
        FROM embeddings""",
    "latents": "SELECT vec_id AS id, embedding FROM embeddings",
    "states": "SELECT vec_id AS id, cast(label % 4 + 1 AS int) AS state FROM embeddings",
    "assignments": "SELECT vec_id AS id, cast(CASE WHEN vec_id % 10 < 7 THEN (label % 4 + 2) % 4 ELSE vec_id % 4 END AS int) AS pred FROM embeddings",
    "coords": "SELECT vec_id AS id, round(cast(AT(embedding, 1) AS double), 6) AS x1, round(cast(AT(embedding, 2) AS double), 6) AS x2 FROM embeddings",
    "truth": "SELECT s.id, s.state AS gt, a.pred, k.x1, k.x2 FROM states s JOIN assignments a ON s.id = a.id JOIN coords k ON s.id = k.id",
    "pairs": "SELECT concat('p', cast(l.id AS varchar(20))) AS name, l.px AS a, CASE WHEN l.id % 5 = 0 THEN l.px ELSE r.px END AS b FROM chips l JOIN chips r ON r.id = l.id + 1",
    "files": "SELECT concat('/in/img', cast(vec_id AS varchar(20)), '_', cast(label % 4 + 1 AS varchar(20)), '.png') AS path FROM embeddings",
    "history": """SELECT cast(event_id % 25 AS int) AS epoch, CASE WHEN event_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, cast(value AS double) AS batch_loss,
        cast(1 + user_id % 64 AS bigint) AS batch_n FROM events""",
    "scores": " UNION ALL ".join(f"SELECT vec_id AS row_id, {k} AS cluster, cast(AT(embedding, {k}) AS double) AS score FROM embeddings" for k in range(1, 5)),
    "scores2": " UNION ALL ".join(f"SELECT vec_id AS row_id, {k} AS cluster, cast(AT(embedding, {k + 4}) AS double) AS score FROM embeddings" for k in range(1, 5)),
    "targets": "SELECT row_id, cluster, score, cast((row_id + cluster) % 4 AS double) / 6 AS target FROM scores",
    "mask": "SELECT vec_id AS id, LIST(" + ", ".join(f"CASE WHEN (vec_id + {k}) % 4 <> 0 THEN 1 ELSE 0 END" for k in range(4)) + ") AS mask FROM embeddings",
    "probs": "SELECT row_id AS id, LIST(cast(0.25 + (row_id % 4) / 16.0 AS double), cast(0.25 - (row_id % 4) / 16.0 AS double), cast(0.5 AS double)) AS prob FROM scores WHERE cluster = 1",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _needs(sql: str) -> list[str]:
    return [n for n in FIXTURES if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]


def _call(sql: str, name: str) -> tuple[int, int, list[str]] | None:
    """Start, end and arguments of the last call of name (so that inner calls come first)."""
    at = max((m.start() for m in re.finditer(rf"\b{name}\(", sql)), default=-1)
    if at < 0:
        return None
    depth, start, args = 0, at + len(name) + 1, []
    for i in range(start, len(sql)):
        if sql[i] in "([":
            depth += 1
        elif sql[i] in ")]" and depth:
            depth -= 1
        elif sql[i] == ")":
            return at, i + 1, [*args, sql[start:i].strip()]
        elif sql[i] == "," and not depth:
            args.append(sql[start:i].strip())
            start = i + 1
    raise ValueError(f"{name}( does not close")


def spell(sql: str, dialect: str) -> str:
    """sql with MAP, AT and LIST, and CSV and MICRO (a list as text; in millionths), spelled for spark or duckdb."""
    duck = dialect == "duckdb"
    forms = {
        "MICRO": lambda x: f"CSV(MAP({x}, e, cast(round(e * 1000000) AS bigint)))",
        "CSV": lambda x: f"array_to_string({x}, ',')" if duck else f"array_join({x}, ',')",
        "MAP": lambda x, v, e: f"list_transform({x}, lambda {v}: {e})" if duck else f"transform({x}, {v} -> {e})",
        "AT": lambda x, n: f"{x}[{n}]" if duck else f"element_at({x}, {n})",
        "LIST": lambda *x: f"{'list_value' if duck else 'array'}({', '.join(x)})",
    }
    for name, form in forms.items():
        while found := _call(sql, name):
            start, end, args = found
            sql = sql[:start] + form(*args) + sql[end:]
    return sql


def with_fixtures(sql: str) -> str:
    """DuckDB SQL: the query behind the WITH clause of the fixtures it reads, directly or not."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _needs(text):
            if name not in order:
                visit(FIXTURES[name])
                order.append(name)

    visit(sql)
    sql = spell(sql, "duckdb")
    if not order:
        return sql
    heads = ", ".join(f"{n} AS ({spell(FIXTURES[n], 'duckdb')})" for n in order)
    return f"WITH {heads}, {sql.strip()[5:]}" if sql.strip().upper().startswith("WITH ") else f"WITH {heads} {sql}"


class Fixtures:
    """The derived tables of a folder, as DataFrames by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in FIXTURES:
            raise AttributeError(name)
        sql = spell(FIXTURES[name], "spark")
        found = {n: getattr(self, n) for n in _needs(FIXTURES[name])} | {t: self.table(t) for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql)}
        sql = re.sub(r"\b(FROM|JOIN)\s+(\w+)(\s+(?!ON\b|WHERE\b|JOIN\b|UNION\b)(\w+))?", lambda m: f"{m[1]} {{{m[2]}}} AS {m[4] or m[2]}", sql)
        return self.spark.sql(sql, **found)
