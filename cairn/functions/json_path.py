"""JSON values as VARIANT: absent paths (missing) and JSON nulls are different things."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at(v: Column, path: str, kind: str = "variant") -> Column:
    """The value at a path such as $.a.b[0]; null where the path is absent or the value isn't of the kind."""
    return F.try_variant_get(v, path, kind)


def is_missing(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant").isNull()


def is_json_null(v: Column, path: str) -> Column:
    return F.coalesce(F.is_variant_null(F.try_variant_get(v, path, "variant")), F.lit(False))


def kind_of(v: Column, path: str) -> Column:
    """The kind of the value at a path: VOID for null, BIGINT, DECIMAL(...), DOUBLE, STRING, BOOLEAN, OBJECT<...>, ARRAY<...>."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def each(df: DataFrame, v: str, path: str, name: str) -> DataFrame:
    """One row per element of the array at the path, as `name`; rows without an array there vanish."""
    node = F.try_variant_get(F.col(v), path, "variant")
    rows = df.withColumn("_node", node).filter(F.schema_of_variant("_node").startswith("ARRAY"))
    elements = F.transform(F.try_variant_get(F.col("_node"), "$", "array<variant>"), lambda x: x)
    return rows.withColumn(name, F.explode(elements)).drop("_node")


def expanded(df: DataFrame, v: str, steps: list, name: str) -> DataFrame:
    """The nodes at a path, one a row, as `name`. A step is "*" for all elements of an array, a whole number for one, or a member's name: in any case as text, exactly as a tuple of one text. Where a step finds nothing the row vanishes."""
    rows = df.withColumn(name, F.col(v))
    for step in steps:
        if step == "*":
            rows = each(rows, name, "$", name)
            continue
        node = F.col(name)
        if isinstance(step, int):
            found = F.try_variant_get(node, f"$[{step}]", "variant")
        else:
            found = member(node, step[0], any_case=False) if isinstance(step, tuple) else member(node, step)
        rows = rows.withColumn(name, found).filter(F.col(name).isNotNull())
    return rows


def column_of(v: Column, name: str) -> Column:
    """A column of the row that a node makes: an object's member in any case, an array's k-th element as _k, and a lone value as _1."""
    kind = F.schema_of_variant(v)
    k = int(name[1:]) if name[:1] == "_" and name[1:].isdigit() and name[1] != "0" else 0
    element = F.try_variant_get(v, f"$[{k - 1}]", "variant") if k else F.lit(None).cast("variant")
    alone = v if k == 1 else F.lit(None).cast("variant")
    return F.when(kind.startswith("OBJECT"), member(v, name)).when(kind.startswith("ARRAY"), element).otherwise(alone)


def member(v: Column, name: str, any_case: bool = True) -> Column:
    """A member of an object by name; of several that differ in case alone, the first in order of keys."""
    if not any_case:
        return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(name))
    hits = F.filter(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.lower(e["key"]) == name.lower())
    return F.get(hits, F.lit(0))["value"]
