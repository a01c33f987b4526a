"""Identifier expressions: name-based ids, time-ordered ids and hashes, without Python code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace all event and posting ids are derived from.
ID_NAMESPACE = "8ba6b5dc-1c1c-5d29-9b0e-43c4d2c3a9f1"


def uuid5(name: Column, namespace: str = ID_NAMESPACE) -> Column:
    """Version 5 UUID of ``name``: SHA-1 of namespace and name with the marker bits set."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.element_at(
        F.array(*[F.lit(c) for c in "89ab"]),
        (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"),
    )
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def deterministic_event_id(project: Column, idempotency_key: Column) -> Column:
    """The same project and key always give the same event id, so retries collapse."""
    return uuid5(F.concat(project, F.lit("\0"), idempotency_key))


def deterministic_posting_id(event_id: Column, position: Column) -> Column:
    return uuid5(F.concat(event_id, F.lit("\0posting:"), position.cast("string")))


def uuid7_time(identifier: Column) -> Column:
    """Creation time held in the first 48 bits of a version 7 UUID."""
    digits = F.substring(F.replace(identifier, F.lit("-"), F.lit("")), 1, 12)
    return F.timestamp_millis(F.conv(digits, 16, 10).cast("bigint"))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)
