"""Compare a Spark result with DuckDB's rows for the same SQL."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sql: str, sf_dir: str, **tables) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        if t in tables:
            con.register(t, tables[t])
        else:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = con.sql(sql)
    return sorted(out.columns), rows_of(out.columns, out.fetchall())


def same(df, sql: str, sf_dir: str, **tables) -> None:
    names, want = duck(sql, sf_dir, **tables)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == names
    assert len(got) == len(want), (len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, bad[:3]
