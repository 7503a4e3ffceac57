"""Tag search and tag conditions over objects with a map of tags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Predicates of one search at most, and the letters that keys and values may have.
MOST = 16
COMPONENT = r"^[A-Za-z0-9 +\-./:=_]*$"


@dataclass(frozen=True)
class Tag:
    """key op value; op is one of = <> > >= < <=. Values compare as texts."""

    key: str
    op: str
    value: str

    def __post_init__(self):
        if self.op not in ("=", "<>", ">", ">=", "<", "<="):
            raise ValueError(f"no such comparison: {self.op}")
        if not 1 <= len(self.key) <= 128 or len(self.value) > 256:
            raise ValueError("a key has 1 to 128 characters, a value 256 at most")


def compared(x: Column, op: str, value: str) -> Column:
    v = F.lit(value)
    return {"=": x == v, "<>": x != v, ">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v}[op]


def condition(tag: Tag, tags: Column) -> Column:
    """False where the key is absent, also for <>."""
    return F.coalesce(compared(F.try_element_at(tags, F.lit(tag.key)), tag.op, tag.value), F.lit(False))


def valid_component(x: Column, least: int, most: int) -> Column:
    return x.rlike(COMPONENT) & F.char_length(x).between(least, most)


def find(blobs: DataFrame, tags: list[Tag], container: str | None = None) -> DataFrame:
    """Current objects with all the tags: container, name and the queried tags alone, in order of container and name."""
    lows = [t.key for t in tags if t.op in (">", ">=")]
    highs = [t.key for t in tags if t.op in ("<", "<=")]
    if not 1 <= len(tags) <= MOST or len(lows) > len(set(lows)) or len(highs) > len(set(highs)):
        raise ValueError("1 to 16 tags, with one lower and one upper bound a key at most")
    own = blobs.filter("is_current and not is_deleted and snapshot is null")
    own = own.filter(F.col("container") == container) if container is not None else own
    for t in tags:
        own = own.filter(compared(F.try_element_at("tags", F.lit(t.key)), t.op, t.value))
    keys = sorted({t.key for t in tags})
    return own.select("container", "name", F.map_filter("tags", lambda k, v: k.isin(keys)).alias("tags")).orderBy("container", "name")


def found_after(found: DataFrame, container: str, name: str, size: int) -> DataFrame:
    """A page of find(): what comes after (container, name) in its order."""
    later = (F.col("container") > container) | ((F.col("container") == container) & (F.col("name") > name))
    return found.filter(later).orderBy("container", "name").limit(size)


def find_in_index(blobs: DataFrame, index: DataFrame, tags: list[Tag]) -> DataFrame:
    """The same search by semi joins with an index table (container, name, tag_key, tag_value)."""
    own = blobs.filter("is_current and not is_deleted and snapshot is null")
    for t in tags:
        hits = index.filter((F.col("tag_key") == t.key) & compared(F.col("tag_value"), t.op, t.value))
        own = own.join(hits, ["container", "name"], "left_semi")
    return own


def index_of(blobs: DataFrame) -> DataFrame:
    return blobs.select("container", "name", F.explode("tags").alias("tag_key", "tag_value"))


def index_faults(blobs: DataFrame, index: DataFrame) -> DataFrame:
    """What the index lacks or has too much: container, name, tag_key, tag_value, fault."""
    want, have = index_of(blobs), index.select("container", "name", "tag_key", "tag_value")
    return want.exceptAll(have).withColumn("fault", F.lit("missing")).unionByName(have.exceptAll(want).withColumn("fault", F.lit("surplus")))
