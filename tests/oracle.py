"""Runs a registered query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return "~nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.6g}"
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}={_plain(v)}" for k, v in sorted(value.items())) + "}"
    if hasattr(value, "asDict"):
        return "{" + ",".join(f"{k}={_plain(v)}" for k, v in sorted(value.asDict().items())) + "}"
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return str(value)


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, sf_dir):
    """(ok, message, seconds in Spark)."""
    from rxatlas.plans.catalog import ORACLES, QUERIES

    started = time.time()
    frame = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    seconds = time.time() - started
    columns, got = normalised(frame.columns, rows)
    if name not in ORACLES:
        return None, f"{len(rows)} rows, no SQL", seconds
    result = con.execute(ORACLES[name])
    expected_columns, expected = normalised([d[0] for d in result.description], result.fetchall())
    if columns != expected_columns:
        return False, f"columns {columns} != {expected_columns}", seconds
    if got == expected:
        return True, f"{len(got)} rows", seconds
    extra = [r for r in got if r not in set(expected)][:2]
    lost = [r for r in expected if r not in set(got)][:2]
    return False, f"{len(got)} vs {len(expected)} rows\n   spark only {extra}\n   sql only   {lost}", seconds


def main():
    sys.path.insert(0, str(ROOT))
    from rxatlas.plans import catalog
    from rxatlas.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    catalog.load()
    spark = local_session(int(__import__("os").environ.get("CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in catalog.QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, message, seconds = compare(spark, con, name, sf_dir)
        except Exception as exc:  # report and go on
            ok, message, seconds = False, f"{type(exc).__name__}: {str(exc)[:900]}", 0.0
        bad += ok is False
        print({True: "ok  ", False: "FAIL", None: "rows"}[ok], f"{seconds:6.2f}s", name, message, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
