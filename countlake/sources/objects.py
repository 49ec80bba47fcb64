"""Nested objects as a table of nodes, with VARIANT values: groups, arrays and attributes of a tree.

A node is (path, kind, value): kind "group", "data" (arrays, with dtype and shape) or "attr" (text, numbers,
truth values). ``merge`` is an upsert by path: what the new tree does not name survives.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SELF = "."
_NODE = "path string, kind string, body string"


def _walk(obj, path: str):
    if isinstance(obj, dict):
        yield path, "group", None
        for k, v in obj.items():
            yield from _walk(v, path if k == SELF else f"{path.rstrip('/')}/{k}")
    elif isinstance(obj, np.ndarray):
        yield path, "data", json.dumps({"dtype": obj.dtype.str if obj.dtype.names is None else obj.dtype.descr, "shape": list(obj.shape), "values": obj.reshape(-1).tolist()})
    elif isinstance(obj, np.dtype):
        yield path, "dtype", json.dumps(obj.descr)
    elif isinstance(obj, (str, bool, int, float, np.integer, np.floating, np.bool_)):
        yield path, "attr", json.dumps(obj.item() if hasattr(obj, "item") else obj)
    else:
        raise TypeError(f"{path}: {type(obj).__name__} cannot be stored")


def to_nodes(spark: SparkSession, obj: dict, root: str = "/") -> DataFrame:
    """(path, kind, value VARIANT) of a nested dict of arrays, types and scalars."""
    rows = spark.createDataFrame(list(_walk(obj, root)), _NODE)
    return rows.select("path", "kind", F.parse_json("body").alias("value"))


def merge(old: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """old with the nodes of new put in or in their place; without overwrite a common leaf is an error."""
    if not overwrite:
        twice = old.where("kind <> 'group'").join(new.where("kind <> 'group'").select("path"), "path", "left_semi").first()
        if twice is not None:
            raise FileExistsError(twice.path)
    key = new.select("path", "kind")
    return old.join(key, ["path", "kind"], "left_anti").unionByName(new)


def to_object(nodes: DataFrame) -> dict:
    """The nested dict of a (small) node table; a group that holds only "." collapses to it."""
    out: dict = {}
    leaves = []
    for r in nodes.select("path", "kind", F.to_json("value").alias("body")).orderBy("path").collect():
        parts = [p for p in r.path.split("/") if p]
        if r.kind == "group":
            at = out
            for p in parts:
                at = at.setdefault(p, {})
        else:
            leaves.append((parts, r.kind, json.loads(r.body)))
    for parts, kind, body in leaves:
        if kind == "data":
            dtype = np.dtype([tuple(d) for d in body["dtype"]]) if isinstance(body["dtype"], list) else np.dtype(body["dtype"])
            values = [tuple(v) for v in body["values"]] if dtype.names else body["values"]
            body = np.array(values, dtype).reshape(body["shape"])
        elif kind == "dtype":
            body = np.dtype([tuple(d) for d in body])
        at = out
        for p in parts[:-1]:
            at = at.setdefault(p, {})
        if parts and isinstance(at.get(parts[-1]), dict):
            at[parts[-1]][SELF] = body
        elif parts:
            at[parts[-1]] = body
        else:
            at[SELF] = body
    return out


def write_object(spark: SparkSession, path: str, obj: dict, overwrite: bool = False) -> None:
    """Store a tree as a Parquet table of nodes; an existing one is merged into."""
    new = to_nodes(spark, obj)
    if Path(path).exists():
        kept = merge(read_nodes(spark, path), new, overwrite).select("path", "kind", F.to_json("value").alias("body")).collect()
        new = spark.createDataFrame(kept, _NODE).select("path", "kind", F.parse_json("body").alias("value"))
    new.select("path", "kind", F.to_json("value").alias("body")).coalesce(1).write.mode("overwrite").parquet(str(path))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(str(path)).select("path", "kind", F.parse_json("body").alias("value"))


def read_object(spark: SparkSession, path: str) -> dict:
    return to_object(read_nodes(spark, path))
