"""Ordered listings of objects with keyset pages, delimiter roll-up and directory mode."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 5000


def page_size(asked: int | None) -> int:
    return min(max(asked or PAGE, 1), PAGE)


def rank(snapshots: bool) -> Column:
    current = 4 if snapshots else 0
    return F.when(F.col("is_current"), current).when(F.col("version_id").isNotNull(), 1).when(F.col("snapshot").isNull(), 2).otherwise(3)


def visible(snapshots: bool = False, versions: bool = False, deleted: bool = False) -> Column:
    """Which generations a listing includes, besides the current ones."""
    if versions:
        p = F.lit(True) if snapshots else F.col("snapshot").isNull()
    else:
        p = F.col("is_current") | F.col("snapshot").isNotNull() if snapshots else F.col("is_current")
    return p if deleted else p & ~F.col("is_deleted")


def visible_in_directories(snapshots: bool = False, deleted: bool = False, show_only: str | None = None) -> Column:
    """The same where names form directories; show_only is None, deleted, files or directories."""
    active = (F.col("is_current") | F.col("snapshot").isNotNull() if snapshots else F.col("is_current")) & ~F.col("is_deleted")
    gone = F.col("is_deleted") if snapshots else F.col("is_deleted") & F.col("snapshot").isNull()
    p = gone if show_only == "deleted" else active | gone if deleted else active
    return {"files": p & ~F.coalesce("is_directory", F.lit(False)), "directories": p & F.coalesce("is_directory", F.lit(False))}.get(show_only, p)


def sort_name(name: Column, recursive: bool) -> Column:
    """In directory mode a slash sorts before all else."""
    return F.replace(name, F.lit("/"), F.lit("\0")) if recursive else name


def uncommitted(blobs: DataFrame, staged: DataFrame) -> DataFrame:
    """Names that have staged blocks and no live current object."""
    live = blobs.filter("is_current and not is_deleted")
    return staged.select("container", F.col("blob_name").alias("name")).distinct().join(live, ["container", "name"], "left_anti")


def eligible(
    blobs: DataFrame, container: str, prefix: str = "", start_from: str = "", end_before: str = "", snapshots: bool = False, versions: bool = False,
    deleted: bool = False, staged: DataFrame | None = None, recursive: bool = False,
) -> DataFrame:
    """name, version_id, snapshot, generation_id, rank, is_uncommitted, is_directory of what the listing may show. Filters on container and name reach the scan."""

    def bounded(df: DataFrame) -> DataFrame:
        df = df.filter((F.col("container") == container) & F.col("name").startswith(prefix))
        if start_from:
            df = df.filter(sort_name(F.col("name"), recursive) >= sort_name(F.lit(start_from), recursive))
        if end_before:
            df = df.filter(sort_name(F.col("name"), recursive) < sort_name(F.lit(end_before), recursive))
        return df

    own = bounded(blobs).filter(visible(snapshots, versions, deleted))
    out = own.select("name", "version_id", "snapshot", "generation_id", rank(snapshots).alias("rank"), F.lit(0).alias("is_uncommitted"), F.col("is_directory").cast("int").alias("is_directory"))
    if staged is None:
        return out
    none = F.lit(None).cast("string")
    more = bounded(uncommitted(blobs, staged)).select("name", none.alias("version_id"), none.alias("snapshot"), F.lit("").alias("generation_id"), F.lit(-1).alias("rank"), F.lit(1).alias("is_uncommitted"), F.lit(0).alias("is_directory"))
    return out.unionByName(more)


def rolled_up(rows: DataFrame, prefix: str, delimiter: str, directories: bool = False) -> DataFrame:
    """Rows with entry_name and entry_type: 0 for a common prefix, once each, and 1 for an object."""
    n = len(prefix)
    at = F.instr(F.substring("name", n + 1, 2**31 - 1), F.lit(delimiter))
    marked = rows.withColumn("_at", at)
    is_prefix = (F.col("_at") > 0) | (F.col("is_directory") == 1) if directories else F.col("_at") > 0
    whole = F.when(F.col("_at") == 0, F.concat("name", F.lit("/"))).otherwise(F.substring("name", F.lit(1), n + F.col("_at") + len(delimiter) - 1))
    none = F.lit(None).cast("string")
    prefixes = marked.filter(is_prefix).select(whole.alias("entry_name")).distinct()
    prefixes = prefixes.select(
        "entry_name", F.lit(0).alias("entry_type"), F.lit(-1).alias("rank"), none.alias("version_id"), none.alias("snapshot"), F.lit("").alias("generation_id"),
        F.lit(0).alias("is_uncommitted"), F.lit(int(directories)).alias("is_directory"),
    )
    return prefixes.unionByName(entries(marked.filter(~is_prefix)))


def directory_properties(rolled: DataFrame, blobs: DataFrame, container: str, data: Column) -> DataFrame:
    """The common prefixes of rolled_up(), with the data of the directory each stands for, null where there is none: `data` is a column of blobs, the greatest counts."""
    live = blobs.filter((F.col("container") == container) & F.col("is_current") & ~F.col("is_deleted") & F.coalesce("is_directory", F.lit(False)))
    own = live.groupBy(F.concat("name", F.lit("/")).alias("entry_name")).agg(F.max(data).alias("data"))
    return rolled.filter("entry_type = 0").join(own, "entry_name", "left")


def stale_blocks(staged: DataFrame, cutoff: Column, most: int) -> DataFrame:
    """The oldest staged blocks from before the cutoff, up to `most` of them in order: a bounded step of their expiry."""
    return staged.filter(F.col("created_at") < cutoff).orderBy("created_at", "container", "blob_name", "block_id").limit(most)


def entries(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("name").alias("entry_name"), F.lit(1).alias("entry_type"), "rank", "version_id", "snapshot", "generation_id", "is_uncommitted", "is_directory")


def order(recursive: bool = False) -> list[Column]:
    return [
        sort_name(F.col("entry_name"), recursive), F.col("entry_type"), F.col("rank"),
        F.when(F.col("rank") == 1, F.col("version_id")).desc_nulls_last(), F.when(F.col("rank") == 3, F.col("snapshot")).asc_nulls_first(), F.col("generation_id"),
    ]


def after(cursor: dict, recursive: bool = False) -> Column:
    """What comes after the entry `cursor`; with name_complete after all entries of its name."""
    name, own = sort_name(F.col("entry_name"), recursive), sort_name(F.lit(cursor["entry_name"]), recursive)
    if cursor.get("name_complete"):
        return name > own
    r, g = cursor["rank"], F.col("generation_id") > cursor["generation_id"]
    if r == 1:
        later = (F.col("version_id") < cursor["version_id"]) | ((F.col("version_id") == cursor["version_id"]) & g)
    elif r == 3:
        later = (F.col("snapshot") > cursor["snapshot"]) | ((F.col("snapshot") == cursor["snapshot"]) & g)
    else:
        later = g
    same_type = F.lit(cursor["entry_type"] == 1) & (F.col("entry_type") == 1) & ((F.col("rank") > r) | ((F.col("rank") == r) & later))
    return (name > own) | ((name == own) & ((F.col("entry_type") > cursor["entry_type"]) | same_type))


def page(rows: DataFrame, size: int | None = None, cursor: dict | None = None, recursive: bool = False) -> DataFrame:
    """The next entries in order; one more than the page has tells whether there are more."""
    rows = rows.filter(after(cursor, recursive)) if cursor else rows
    return rows.orderBy(*order(recursive)).limit(page_size(size))


def marker(cursor: dict, shape: dict) -> str:
    """An opaque marker of a cursor that is good for listings of the same shape alone."""
    scope = hashlib.sha256(json.dumps(shape, sort_keys=True).encode()).digest()[:12]
    return ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps(cursor, sort_keys=True).encode(), scope))


def cursor_of(text: str, shape: dict) -> dict:
    said, _, _ = text.partition(".")
    cursor = json.loads(base64.urlsafe_b64decode(said + "=" * (-len(said) % 4)))
    if marker(cursor, shape) != text:
        raise ValueError("the marker belongs to another listing")
    return cursor


def containers(df: DataFrame, prefix: str = "", after_name: str = "", size: int | None = None) -> DataFrame:
    own = df.filter(F.col("name").startswith(prefix) & ~F.col("deleted"))
    own = own.filter(F.col("name") > after_name) if after_name else own
    return own.orderBy("name").limit(page_size(size) + 1)


def family(blobs: DataFrame, container: str, name: str) -> DataFrame:
    """All generations of one object: the current one first, then the newest."""
    own = blobs.filter((F.col("container") == container) & (F.col("name") == name))
    return own.orderBy(F.desc("is_current"), F.desc_nulls_last("last_modified"), "generation_id")


def site_pages(requests: DataFrame, objects: DataFrame, index: str | None = None, default: str | None = None, error: str | None = None) -> DataFrame:
    """path, name, status of requests (path) to a site: the object itself or a folder's index page, else the default page, else the error page with 404; without any, name is null."""
    folder = (F.col("path") == "") | F.col("path").endswith("/")
    own = F.when(folder & F.lit(bool(index)), F.concat("path", F.lit(index or ""))).otherwise(F.col("path"))
    choices = [F.struct(own.alias("name"), F.lit(0).alias("rank"), F.lit(200).alias("status"))]
    choices += [F.struct(F.lit(n.lstrip("/")).alias("name"), F.lit(k).alias("rank"), F.lit(code).alias("status")) for k, n, code in ((1, default, 200), (2, error, 404)) if n]
    tried = requests.select("path").distinct().select("path", F.explode(F.array(*choices)).alias("c")).select("path", "c.*")
    hits = tried.join(objects.select("name").distinct(), "name").groupBy("path").agg(F.min_by(F.struct("name", "status"), "rank").alias("hit"))
    return requests.join(hits, "path", "left").select("path", F.col("hit.name").alias("name"), F.coalesce(F.col("hit.status"), F.lit(404)).alias("status"))
