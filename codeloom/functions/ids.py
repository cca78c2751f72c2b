"""Identity and hash expressions; all stay within Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def hyphened(digest: Column) -> Column:
    """The first 32 hex digits laid out 8-4-4-4-12."""
    return F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def entity_id(name: Column, kind: Column, line: Column, column: Column, digest: Column, qualified: Column, signature: Column, path: Column | None = None) -> Column:
    """Deterministic id; with `path`, byte-identical copies of a file keep separate ids."""
    parts = [name, kind, line.cast("string"), column.cast("string"), digest, F.when(qualified != name, qualified), F.when(F.length(signature) > 0, F.substring(F.sha2(signature, 256), 1, 8))]
    return hyphened(F.sha2(F.concat_ws(":", *([path] if path is not None else []), *parts), 256))


def is_entity_id(value: Column) -> Column:
    return value.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def raw_id(*parts: Column) -> Column:
    return F.concat_ws("::", *(p.cast("string") for p in parts))


def point_id(entity: Column) -> Column:
    """Unsigned 64-bit number of the first 8 bytes of SHA-256, as decimal(20,0)."""
    return F.conv(F.substring(F.sha2(entity, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def embedding_key(model: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", model, text), 256), 1, 32)


def query_key(**fields: Column) -> Column:
    body = F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))
    return F.substring(F.sha2(body, 256), 1, 16)


def location_id(path: Column, line: Column, column: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"), column.cast("string"))
