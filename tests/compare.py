"""Run registered queries next to their SQL checks: ``python -m tests.compare [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
KINDS = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "integer": "int", "hugeint": "huge",
         "double": "float", "float": "float", "string": "text", "varchar": "text", "date": "date", "boolean": "bool"}


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def kind(name: str) -> str:
    name = name.lower()
    return KINDS.get(name, KINDS.get(name.split("(")[0], name))


def differences(df, con, sql) -> list[str]:
    """Empty when both sides agree in names, type kinds and values."""
    got_names, got = table(df.collect(), df.columns)
    rel = con.sql(sql)
    want_names, want = table(rel.fetchall(), rel.columns)
    out = []
    if got_names != want_names:
        return [f"columns {got_names} != {want_names}"]
    mine = {n: kind(t) for n, t in df.dtypes}
    theirs = {n: kind(str(t)) for n, t in zip(rel.columns, rel.types)}
    out += [f"type of {n}: {mine[n]} != {theirs[n]}" for n in got_names if mine[n] != theirs[n]]
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        a, b = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        out.append(f"values; only here {a}; only there {b}")
    elif not got:
        out.append("EMPTY")
    return out


def main() -> int:
    from carefold.plans.registry import all_oracles, all_queries
    from carefold.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad, oracles = connect(folder), 0, all_oracles()
    for name, fn in all_queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                diff = differences(df, con, oracles[name])
            else:
                n = len(df.collect())
                diff = [] if n else ["EMPTY"]
        except Exception as e:  # report and go on with the next query
            diff = [f"{type(e).__name__}: {str(e)[:600]}"]
            if wanted:
                traceback.print_exc()
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name:28s} {time.time() - t0:6.2f}s {'' if name in oracles else '(no SQL) '}{'; '.join(diff)}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
