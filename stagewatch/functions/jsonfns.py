"""JSON encode/decode."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode(cols: Sequence[str]) -> Column:
    """Columns -> one JSON object text."""
    return F.to_json(F.struct(*[F.col(c) for c in cols]))


def decode(text: Column | str, schema: T.StructType | str) -> Column:
    """JSON text -> struct by a known schema (malformed text gives NULL fields)."""
    return F.from_json(F.col(text) if isinstance(text, str) else text, schema)


def field(text: Column | str, name: str, type_name: str = "string") -> Column:
    """One field of schemaless JSON text, found at query time (VARIANT)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.try_variant_get(F.try_parse_json(t), f"$.{name}", type_name)


def _members(schema: str) -> list[tuple[str, str]]:
    """(name, type) of the members of ``OBJECT<a: BIGINT, b: ARRAY<STRING>>``; of another type none."""
    if not schema.startswith("OBJECT<"):
        return []
    out, depth, quoted, at = [], 0, False, 7
    for i, c in enumerate(schema[7:], 7):
        quoted ^= c == "`"
        if quoted:
            continue
        depth += (c in "<(") - (c in ">)")
        if (c == "," and depth == 0) or (c == ">" and depth == -1):
            m = re.match(r"\s*(?:`((?:[^`]|``)*)`|([^:]*?)):\s*(.*)", schema[at:i], re.S)
            if m:
                out.append(((m[1] or "").replace("``", "`") or m[2] or "", m[3].strip()))
            at = i + 1
    return out


def discover_fields(df: DataFrame, text: str) -> list[tuple[str, str]]:
    """the top-level fields of all messages of the column ``text`` and their types, by name, nothing being known.

    One aggregate over the whole column, combined map side; only the type comes to the driver. Texts
    that are no JSON do not count, nor do fields that are always null. A field of differing types, an object
    or an array has the type ``variant``."""
    found = df.select(F.schema_of_variant_agg(F.try_parse_json(F.col(text)))).first()[0]
    plain = {"BIGINT": "bigint", "STRING": "string", "BOOLEAN": "boolean", "DOUBLE": "double", "DATE": "date", "TIMESTAMP": "timestamp",
             "TIMESTAMP_NTZ": "timestamp_ntz", "FLOAT": "float", "BINARY": "binary"}
    out = []
    for name, kind in _members(found or ""):
        if kind != "VOID":
            out.append((name, kind.lower() if kind.startswith("DECIMAL") else plain.get(kind, "variant")))
    return sorted(out)


def project_fields(df: DataFrame, text: str, fields: Sequence[tuple[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and one typed column per discovered field; ``variant`` fields as JSON text. A message
    without the field, or that is no JSON, has NULL there."""
    v = F.try_parse_json(F.col(text))

    def path(name: str) -> str:
        quote = '"' if "'" in name else "'"
        if quote in name:
            raise ValueError(f"no path reaches the field {name}: it holds both kinds of quotes")
        return f"$[{quote}{name}{quote}]"

    cols = [F.to_json(F.try_variant_get("_v", path(n), "variant")).alias(n) if t == "variant"
            else F.try_variant_get("_v", path(n), t).alias(n) for n, t in fields]
    return df.select(*keep, v.alias("_v")).select(*keep, *cols)
