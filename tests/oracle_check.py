"""Compare a registered query with its SQL, row by row and type by type."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def differences(con, sql: str, df) -> list[str]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    theirs_rows = cursor.fetchall()
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != kinds[name]:
            out.append(f"type of {name}: {kind} != {kinds[name]}")
    order = sorted(names)
    ours = sorted(tuple(_cell(r[c]) for c in order) for r in df.collect())
    index = [names.index(c) for c in order]
    theirs = sorted(tuple(_cell(r[i]) for i in index) for r in theirs_rows)
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} != {len(theirs)}")
    if ours != theirs:
        mine, other = set(ours) - set(theirs), set(theirs) - set(ours)
        out.append(f"{len(mine)} rows only here, e.g. {list(zip(order, sorted(mine)[0])) if mine else None}; "
                   f"{len(other)} only there, e.g. {list(zip(order, sorted(other)[0])) if other else None}")
    return out
