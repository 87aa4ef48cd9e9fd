"""Runs registered queries next to their SQL and reports differences."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def engine(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, bool) or value is None:
        return value
    return value if isinstance(value, (int, str)) else str(value)


def _ordered(names, rows):
    places = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(_plain(r[i]) for i in places) for r in rows]
    return sorted(names), sorted(table, key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r))


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def type_differences(frame, con, sql: str) -> list[str]:
    """Columns whose type differs between the engines."""
    spark_types = dict(frame.dtypes)
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    return [f"{n}: {spark_types.get(n)} / {t}" for n, t, *_ in described if TYPES.get(str(t)) != spark_types.get(n)]


def same_number(a, b) -> bool:
    return isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and float(a) == float(b)


def differences(spark_rows, spark_names, con, sql: str, show: int = 5) -> list[str]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    a_names, a = _ordered(spark_names, spark_rows)
    b_names, b = _ordered(names, cursor.fetchall())
    if a_names != b_names:
        return [f"columns {a_names} / {b_names}"]
    if len(a) != len(b):
        return [f"rows {len(a)} / {len(b)}"]
    off = [
        f"{x} / {y}" for x, y in zip(a, b) if any(p != q and not same_number(p, q) for p, q in zip(x, y))
    ]
    return off[:show]


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tallylens.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    con, sql = engine(sf_dir), entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            frame = run(spark, sf_dir)
            rows = frame.collect()
            found = differences(rows, frame.columns, con, sql[name]) if name in sql else None
            if name in sql:
                print("      types:", types) if (types := type_differences(frame, con, sql[name])) else None
        except Exception as error:  # noqa: BLE001
            found, rows = [f"{type(error).__name__}: {str(error)[:600]}"], []
        bad += bool(found)
        print(f"{name:24s} {time.time() - start:6.2f}s rows={len(rows):6d}",
              "no sql" if found is None else "ok" if not found else "DIFFERS", flush=True)
        for line in found or []:
            print("     ", line[:600], flush=True)
    print("unregistered sql:", sorted(set(sql) - set(entry.queries())), "failures:", bad)
