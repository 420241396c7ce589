"""Registered queries and, beside each, DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The adapters of ``lumivox.grid`` as common table expressions.
SHARED = {
    "pixel": "pixel AS (SELECT vec_id AS image_id, CAST((p - 1) // 8 AS INTEGER) AS y, CAST((p - 1) % 8 AS INTEGER) AS x, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(p))",
    "voxel": (
        "voxel AS (SELECT vec_id // 8 AS volume_id, CAST(vec_id % 8 AS INTEGER) AS z, CAST((p - 1) // 8 AS INTEGER) AS y, CAST((p - 1) % 8 AS INTEGER) AS x, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(p))"
    ),
    "pair": "pair AS (SELECT a.image_id, a.y, a.x, a.v AS v1, b.v AS v2 FROM pixel a JOIN pixel b ON b.image_id = a.image_id + 1 AND a.y = b.y AND a.x = b.x)",
    "vpair": "vpair AS (SELECT a.volume_id, a.z, a.y, a.x, a.v AS v1, b.v AS v2 FROM voxel a JOIN voxel b ON b.volume_id = a.volume_id + 1 AND a.z = b.z AND a.y = b.y AND a.x = b.x)",
    "lor": (
        "ends AS (SELECT o_orderkey AS lor_id, CAST(o_orderkey % 32 AS INTEGER) AS x1, CAST(o_custkey % 32 AS INTEGER) AS y1, CAST((o_orderkey * 3 + o_custkey) % 8 AS INTEGER) AS z1, "
        "CAST((o_orderkey * 7 + 11) % 32 AS INTEGER) AS x2, CAST((o_custkey * 5 + 3) % 32 AS INTEGER) AS y2, CAST((o_orderkey + o_custkey * 3 + 1) % 8 AS INTEGER) AS z2 FROM orders), "
        "lor AS (SELECT *, greatest(abs(x2 - x1), abs(y2 - y1), abs(z2 - z1)) AS len FROM ends)"
    ),
    "ray": (
        "ray AS (SELECT lor_id, CAST((z1 + floor(n * (z2 - z1) / len)) * 1024 + (y1 + floor(n * (y2 - y1) / len)) * 32 + x1 + floor(n * (x2 - x1) / len) AS INTEGER) AS vox "
        "FROM (SELECT *, unnest(range(0, len)) AS n FROM lor))"
    ),
    "event": "event AS (SELECT o_orderkey AS lor_id, CAST(o_orderkey % 638 AS INTEGER) AS c1, CAST(o_custkey % 28 AS INTEGER) AS d1, CAST((o_orderkey * 7 + 11) % 638 AS INTEGER) AS c2, CAST((o_custkey * 5 + 3) % 28 AS INTEGER) AS d2 FROM orders)",
}


def shared(*names: str) -> str:
    return "WITH " + ", ".join(SHARED[n] for n in names) + " "


def query(sql: str | None = None, *ctes: str, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function; ``ctes`` name the shared tables its SQL begins with."""

    def register(f: Query) -> Query:
        own = name or f.__name__
        QUERIES[own] = f
        if sql:
            ORACLE_SQL[own] = shared(*ctes) + sql if ctes else sql
        return f

    return register


for _module in ("images", "volumes", "spectra", "detectors", "reconstruction", "matrices", "curves", "systems", "files", "traversal", "registration", "features"):
    import_module(f"{__name__}.{_module}")
