"""Leaves of JSON documents, and values picked by key."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAF = "array<struct<path:string,key:string,value:string>>"
_LEAF = pa.list_(pa.struct([("path", pa.string()), ("key", pa.string()), ("value", pa.string())]))


def _walk(value, path: str, key: str, out: list[dict]) -> None:
    stack = [(value, path, key)]
    while stack:
        v, p, k = stack.pop()
        if isinstance(v, dict):
            stack += [(x, f"{p}.{name}", str(name)) for name, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(x, f"{p}[{i}]", k) for i, x in reversed(list(enumerate(v)))]
        elif v is not None:
            out.append({"path": p, "key": k, "value": v if isinstance(v, str) else json.dumps(v)})


def leaves(column: Column | str) -> Column:
    """Scalars of a JSON document in document order, with path and key; none for NULL or bad JSON."""

    @F.arrow_udf(LEAF)
    def run(values: pa.Array) -> pa.Array:
        def of(x: str | None) -> list[dict]:
            out: list[dict] = []
            try:
                _walk(json.loads(x), "$", "", out) if x else None
            except (ValueError, RecursionError):
                return []
            return out

        return pa.array([of(x) for x in values.to_pylist()], _LEAF)

    return run(F.col(column) if isinstance(column, str) else column)


def pick(found: Column, names: list[str]) -> Column:
    """The longest value under any of the names, letters and digits of keys compared without case."""
    plain = lambda k: F.lower(F.regexp_replace(k, "[^A-Za-z0-9]", ""))
    wanted = [n.lower().replace("_", "") for n in names]
    hits = F.filter(found, lambda x: plain(x["key"]).isin(*wanted))
    return F.aggregate(hits, F.lit(None).cast("string"), lambda best, x: F.when(best.isNull() | (F.length(x["value"]) > F.length(best)), x["value"]).otherwise(best))
