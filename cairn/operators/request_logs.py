"""Request logs: parsing and writing records, naming operations, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import chain_text

#: The fields of a record in order; version 2.0 has the second group too.
FIELDS = (
    "version started_at operation request_status status_code e2e_ms server_ms auth_type requester_account owner_account service request_url object_key "
    "request_id operation_count requester_ip request_version request_header_size request_packet_size response_header_size response_packet_size "
    "request_content_length request_md5 server_md5 etag last_modified conditions user_agent referrer client_request_id"
).split()
MORE_FIELDS = "user_object_id tenant_id application_id audience issuer user_principal_name reserved_1 reserved_2".split()
QUOTED = {"request_url", "object_key", "request_md5", "server_md5", "etag", "conditions", "user_agent", "referrer", "client_request_id", *MORE_FIELDS[:6]}
NUMBERS = {"status_code", "e2e_ms", "server_ms", "request_header_size", "request_packet_size", "response_header_size", "response_packet_size", "request_content_length"}

#: Operation by resource kind, methods and comp parameter.
OPERATIONS = {
    ("service", "GET", "list"): "ListContainers", ("service", "GET", "properties"): "GetBlobServiceProperties", ("service", "PUT", "properties"): "SetBlobServiceProperties",
    ("service", "GET", "stats"): "GetBlobServiceStats", ("service", "GET", "blobs"): "FindBlobsByTags", ("service", "POST", "batch"): "BlobBatch",
    ("service", "POST", "userdelegationkey"): "GetUserDelegationKey",
    ("container", "PUT", ""): "CreateContainer", ("container", "DELETE", ""): "DeleteContainer", ("container", "GET HEAD", ""): "GetContainerProperties",
    ("container", "GET", "list"): "ListBlobs", ("container", "GET HEAD", "metadata"): "GetContainerMetadata", ("container", "PUT", "metadata"): "SetContainerMetadata",
    ("container", "GET HEAD", "acl"): "GetContainerACL", ("container", "PUT", "acl"): "SetContainerACL", ("container", "PUT", "undelete"): "RestoreContainer",
    ("container", "PUT", "rename"): "RenameContainer", ("container", "GET", "blobs"): "FindBlobsByTags", ("container", "POST", "batch"): "BlobBatch",
    ("blob", "PUT", ""): "PutBlob", ("blob", "GET", ""): "GetBlob", ("blob", "HEAD", ""): "GetBlobProperties", ("blob", "DELETE", ""): "DeleteBlob",
    ("blob", "PUT", "block"): "PutBlock", ("blob", "PUT", "blocklist"): "PutBlockList", ("blob", "GET", "blocklist"): "GetBlockList", ("blob", "PUT", "appendblock"): "AppendBlock",
    ("blob", "PUT", "page"): "PutPage", ("blob", "GET", "pagelist"): "GetPageRanges", ("blob", "PUT", "incrementalcopy"): "IncrementalCopyBlob", ("blob", "PUT", "undelete"): "UndeleteBlob",
    ("blob", "POST", "query"): "QueryBlobContents", ("blob", "PUT", "immutabilitypolicies"): "SetBlobImmutabilityPolicy", ("blob", "DELETE", "immutabilitypolicies"): "DeleteBlobImmutabilityPolicy",
    ("blob", "PUT", "legalhold"): "SetBlobLegalHold", ("blob", "PUT", "copy"): "AbortCopyBlob", ("blob", "GET HEAD", "metadata"): "GetBlobMetadata",
    ("blob", "PUT", "metadata"): "SetBlobMetadata", ("blob", "GET", "tags"): "GetBlobTags", ("blob", "PUT", "tags"): "SetBlobTags",
    ("blob", "PUT", "properties"): "SetBlobProperties", ("blob", "PUT", "snapshot"): "SnapshotBlob", ("blob", "PUT", "seal"): "SealBlob", ("blob", "PUT", "tier"): "SetBlobTier",
    ("blob", "PUT", "expiry"): "SetBlobExpiry",
}
#: Operations that another name takes the place of where a source to copy is given.
COPIES = {"PutBlob": "CopyBlob", "PutBlock": "PutBlockFromURL", "AppendBlock": "AppendBlockFromURL", "PutPage": "PutPageFromURL"}


#: Actions on a lease; the operation is Action + resource + Lease.
LEASE_ACTIONS = {"acquire": "Acquire", "renew": "Renew", "change": "Change", "release": "Release", "break": "Break"}


def category(method: Column) -> Column:
    return F.when(method.isin("GET", "HEAD", "OPTIONS"), "read").when(method == "DELETE", "delete").otherwise("write")


def operation(kind: Column, method: Column, comp: Column, copies: Column, lease_action: Column | None = None, account: Column | None = None) -> Column:
    """The operation's name, by a map that is part of the plan. lease_action names what is done with a lease; account tells requests for the account's information."""
    names = {f"{k}/{m}/{c}": name for (k, methods, c), name in OPERATIONS.items() for m in methods.split()}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    other = F.create_map(*[F.lit(x) for pair in COPIES.items() for x in pair])
    name = F.coalesce(F.try_element_at(table, F.concat_ws("/", kind, method, F.lower(F.coalesce(comp, F.lit(""))))), F.lit("Unknown"))
    actions = F.create_map(*[F.lit(x) for pair in LEASE_ACTIONS.items() for x in pair])
    resource = F.initcap(kind)
    action = F.try_element_at(actions, F.lower(F.coalesce(F.lit(None).cast("string") if lease_action is None else lease_action, F.lit(""))))
    lease = F.when(action.isNull(), F.concat(F.lit("Lease"), resource)).otherwise(F.concat(action, resource, F.lit("Lease")))
    leased = kind.isin("container", "blob") & (method == "PUT") & (F.lower(comp) == "lease")
    out = F.when(method == "OPTIONS", "PreflightBlobRequest").when(F.lit(False) if account is None else F.coalesce(account, F.lit(False)), "GetAccountInformation")
    return out.when(kind == "website", "GetBlob").when(F.coalesce(leased, F.lit(False)), lease).when((kind == "blob") & copies, F.coalesce(F.try_element_at(other, name), name)).otherwise(name)


def logged(auth: Column, status: Column) -> Column:
    """Anonymous requests are logged only if they succeed, aren't modified, or fail in the service."""
    return (auth != "anonymous") | status.between(200, 299) | (status == 304) | (status >= 500)


def record_line(df: DataFrame, version: str = "1.0") -> Column:
    """The fields of df (named as FIELDS; absent ones are empty) as one line."""
    out = []
    for name in FIELDS + (MORE_FIELDS if version == "2.0" else []):
        if name == "version":
            c = F.lit(version)
        elif name not in df.columns:
            c = F.lit({"service": "blob", "operation_count": "0"}.get(name, ""))
        elif name == "started_at":
            c = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'")
        else:
            c = chain_text(F.col(name)) if name in QUOTED else F.coalesce(F.col(name).cast("string"), F.lit(""))
        out.append(c)
    return F.concat_ws(";", *out)


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Log lines as columns; a semicolon within quotes belongs to its field. Lines of other versions or widths are dropped into `fault`."""
    fields = F.regexp_extract_all(value, F.lit(r'(?:^|;)("[^"]*"|[^;]*)'), F.lit(1))
    rows = lines.select(fields.alias("_f"), F.col(value).alias("_line"))
    names = FIELDS + MORE_FIELDS
    width = F.when(F.col("_f")[0] == "2.0", len(names)).when(F.col("_f")[0] == "1.0", len(FIELDS))
    out = []
    for k, name in enumerate(names):
        c = F.get("_f", F.lit(k))
        if name in QUOTED:
            c = F.regexp_replace(c, '^"|"$', "")
            for symbol, code in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("&", "&amp;")):
                c = F.replace(c, F.lit(code), F.lit(symbol))
        elif name in NUMBERS:
            c = c.try_cast("bigint")
        elif name == "started_at":
            c = c.try_cast("timestamp")
        out.append(c.alias(name))
    fault = F.when(F.coalesce(F.size("_f") != width, F.lit(True)), F.col("_line"))
    return rows.select(*out, fault.alias("fault"))


def counters(df: DataFrame, by: list[str]) -> DataFrame:
    """requests, failures (status 500 and up) and their milliseconds."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status_code") >= 500).alias("failures"), F.sum("e2e_ms").alias("e2e_ms"))
