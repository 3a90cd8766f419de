"""Compare registered queries with their SQL: python tests/parity.py SF [name-prefix ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, run, sql):
    """Return None when the rows agree, else a short account of the difference."""
    df = run(spark, sf_dir)
    got_cols, got = normalise(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    res = con.execute(sql)
    want_cols, want = normalise([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3] if len(got) < 200000 else []
        only_want = [r for r in want if r not in set(got)][:3] if len(want) < 200000 else []
        return f"rows {len(got)} vs {len(want)}; only spark {only_got}; only sql {only_want}"[:1500]
    return None if got else "no rows"


def main(argv):
    from lamina.catalog import ORACLES, QUERIES
    from lamina.session import local_session

    sf_dir = f"/root/testdata/sf{argv[0]}"
    wanted = argv[1:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, run, ORACLES.get(name))
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
