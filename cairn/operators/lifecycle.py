"""What is due: purges, expiry, tiers, leases, copies, replication; and access rights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Objects of at most this length stay hot.
SMALL = 128 * 1024


def purge_due(now: Column, days: int) -> Column:
    """Soft-deleted and past the recorded end of retention, or else `days` after deletion."""
    until = F.coalesce("delete_retention_until", F.col("deleted_at") + F.make_dt_interval(F.lit(days)))
    return F.col("is_deleted") & F.coalesce(until <= now, F.lit(False))


def expired(now: Column) -> Column:
    """Current objects past their expiry that neither a legal hold nor an immutability period keeps."""
    kept = F.col("has_legal_hold") | F.coalesce(F.col("immutability_until") > now, F.lit(False))
    return F.col("is_current") & F.col("snapshot").isNull() & F.coalesce(F.col("expires_at") <= now, F.lit(False)) & ~kept


def log_expired(now: Column, days: int | None) -> Column:
    """Log objects past the retention of logs; none where it is off."""
    return F.lit(False) if days is None else F.coalesce(F.col("created_at") + F.make_dt_interval(F.lit(days)) <= now, F.lit(False))


def container_purge_due(now: Column, days: int) -> Column:
    until = F.coalesce("delete_retention_until", F.col("deleted_at") + F.make_dt_interval(F.lit(days)))
    return F.col("deleted_at").isNotNull() & F.coalesce(until <= now, F.lit(False))


def copy_state(now: Column) -> Column:
    """What a pending copy has become by now: it fails if it expires before it is ready."""
    late = (F.col("copy_expires_at") <= now) & F.coalesce(F.col("copy_ready_at") > F.col("copy_expires_at"), F.lit(True))
    ready = F.coalesce(F.col("copy_ready_at") <= now, F.lit(False))
    due = F.when(F.coalesce(late, F.lit(False)), "failed").when(ready, "success").otherwise("pending")
    return F.when(F.col("copy_status") == "pending", due).otherwise(F.col("copy_status"))


def tier_after_rehydration(now: Column) -> Column:
    """The tier of an archived object by now: the one it is brought back to, once that is complete and no copy is pending."""
    to = F.regexp_extract("archive_status", "^rehydrate-pending-to-(hot|cool|cold|smart)$", 1)
    done = F.coalesce((F.col("rehydrate_complete_at") <= now) & (to != "") & ~F.coalesce(F.col("copy_status") == "pending", F.lit(False)), F.lit(False))
    return F.when(done, F.initcap(to)).otherwise(F.col("access_tier"))


def smart_tier(now: Column) -> Column:
    """Hot, Cool after 30 days without access, Cold after 90."""
    idle = F.unix_micros(now) - F.unix_micros(F.coalesce("smart_tier_last_accessed_at", "access_tier_changed_at", "created_at"))
    day = 86_400_000_000
    return F.when(F.col("length") <= SMALL, "Hot").when(idle >= 90 * day, "Cold").when(idle >= 30 * day, "Cool").otherwise("Hot")


def lease_state(now: Column) -> Column:
    over = lambda c: F.coalesce(F.col(c) <= now, F.lit(False))
    return F.when((F.col("lease_state") == "Breaking") & over("lease_break_ends_at"), "Broken").when((F.col("lease_state") == "Leased") & over("lease_expires_at"), "Expired").otherwise(F.col("lease_state"))


def delete_targets(blobs: DataFrame, option: str | None = None) -> DataFrame:
    """What a deletion takes: the base alone, with its snapshots (include) or those alone (only). A base with snapshots needs an option."""
    snapshot = F.col("snapshot").isNotNull()
    return blobs.filter({None: ~snapshot, "include": F.lit(True), "only": snapshot}[option])


def has_descendants(blobs: DataFrame, directories: DataFrame) -> DataFrame:
    """Directories (container, name) with a live entry below: an equi join on each entry's ancestors."""
    parts = F.split("name", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    live = blobs.filter("is_current and not is_deleted and instr(name, '/') > 0")
    ancestors = live.select("container", F.explode(above).alias("name")).distinct()
    return directories.join(ancestors, ["container", "name"], "left_semi")


def missing_ancestors(names: DataFrame, directories: DataFrame) -> DataFrame:
    """container, name of the directories that entries lie in but that aren't there."""
    parts = F.split("name", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    need = names.filter(F.instr("name", "/") > 0).select("container", F.explode(above).alias("name")).distinct()
    return need.join(directories, ["container", "name"], "left_anti")


def replication_matches(blobs: DataFrame, rules: DataFrame) -> DataFrame:
    """container, name, rule_id of block blobs and the rules (rule_id, container, prefixes, since) they come under. Rules are configuration; the join is by container, so their number doesn't multiply all objects."""
    own = blobs.filter("not is_deleted and snapshot is null")
    r = rules.select("rule_id", F.col("container").alias("_c"), "prefixes", "since")
    hit = (F.size("prefixes") == 0) | F.exists("prefixes", lambda p: F.col("name").startswith(p))
    return own.join(r, own.container == F.col("_c")).filter(hit & F.coalesce(F.col("created_at") >= F.col("since"), F.lit(True))).select("container", "name", "rule_id")


def _bits(p: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.substring(p, i + 1, 1) == c, v).otherwise(0) for i, (c, v) in enumerate((("r", 4), ("w", 2), ("x", 1)))])


def _entries(acl: Column) -> Column:
    return F.transform(F.filter(F.split(acl, ","), lambda e: ~e.startswith("default:")), lambda e: F.split(e, ":"))


def _of(entries: Column, kind: str, name: Column) -> Column:
    """The bits of the entry of a kind and name; null if there is none."""
    own = F.filter(entries, lambda e: (e[0] == kind) & (F.lower(e[1]) == F.lower(name)))
    return F.when(F.size(own) > 0, _bits(F.get(own, F.lit(0))[2]))


def allows(acl: Column, owner: Column, owning_group: Column, who: Column, groups: Column, permission: str) -> Column:
    """POSIX order: the owner, a named user within the mask, any group that grants it within the mask, then others."""
    need = {"r": 4, "w": 2, "x": 1}[permission]
    own = _entries(acl)
    mask = F.coalesce(_of(own, "mask", F.lit("")), F.lit(7))
    has = lambda b: b.bitwiseAND(need) == need
    member = lambda g: F.exists(groups, lambda x: F.lower(x) == F.lower(g))
    named = _of(own, "user", who)
    by_group = member(owning_group) & has(_of(own, "group", F.lit("")).bitwiseAND(mask))
    by_named = F.exists(F.filter(own, lambda e: (e[0] == "group") & (e[1] != "")), lambda e: member(e[1]) & has(_bits(e[2]).bitwiseAND(mask)))
    return F.when(F.lower(who) == F.lower(owner), has(_of(own, "user", F.lit("")))).when(named.isNotNull() & (who != ""), has(named.bitwiseAND(mask))).when(by_group | by_named, True).otherwise(has(_of(own, "other", F.lit(""))))


def mode(acl: Column, sticky: bool = False) -> Column:
    own = _entries(acl)
    mask = F.coalesce(_of(own, "mask", F.lit("")), F.lit(7))
    said = lambda b: F.concat(*[F.when(b.bitwiseAND(v) != 0, c).otherwise("-") for c, v in (("r", 4), ("w", 2), ("x", 1))])
    text = F.concat(said(_of(own, "user", F.lit(""))), said(_of(own, "group", F.lit("")).bitwiseAND(mask)), said(_of(own, "other", F.lit(""))))
    return F.concat(F.substring(text, 1, 8), F.when(text.endswith("x"), "t").otherwise("T")) if sticky else text


def inherited(acl: Column, is_directory: Column) -> Column:
    """A child's rights from its parent's default entries, which a directory keeps as defaults too; null without any."""
    defaults = F.filter(F.split(acl, ","), lambda e: e.startswith("default:"))
    access = F.array_join(F.transform(defaults, lambda e: F.substring(e, 9, 2**31 - 1)), ",")
    return F.when(F.size(defaults) > 0, F.when(is_directory, F.concat(access, F.lit(","), F.array_join(defaults, ","))).otherwise(access))
