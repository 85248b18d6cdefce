"""Deterministic keys: hashes that equal on every run and every cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idempotency_key(user: Column, transaction: Column, session: Column) -> Column:
    """sha256 of ``user:transaction:session``."""
    return F.sha2(F.concat_ws(":", user.cast("string"), transaction.cast("string"), session.cast("string")), 256)


def graph_node_id(patient: Column, kind: Column, value: Column) -> Column:
    """First 16 hex digits of sha256 of ``patient:kind:value`` with the value in lower case."""
    return F.substring(F.sha2(F.concat_ws(":", patient.cast("string"), kind, F.lower(value)), 256), 1, 16)


def point_id(text: Column) -> Column:
    """63-bit number from the first 8 bytes of md5."""
    number = F.conv(F.substring(F.md5(text), 1, 16), 16, 10).cast("decimal(20,0)")
    return (number % F.lit("9223372036854775808").cast("decimal(20,0)")).cast("bigint")


def anonymous_id(value: Column, salt: str) -> Column:
    """``[ID:...]`` with 12 hex digits of sha256 over value and salt."""
    return F.concat(F.lit("[ID:"), F.substring(F.sha2(F.concat(value, F.lit(salt)), 256), 1, 12), F.lit("]"))


def _escaped(text: Column) -> Column:
    """A JSON string in ASCII, as a quoted Column."""
    quoted = F.to_json(text.cast("variant"))
    unit = lambda code: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))

    def one(char: Column) -> Column:
        code = F.ascii(char)
        high = F.lit(0xD800) + F.floor((code - 0x10000) / 1024).cast("int")
        return F.when(code < 128, char).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(F.lit(0xDC00) + (code - 0x10000) % 1024)))

    return F.when(quoted.rlike("[^\\x00-\\x7F]"), F.array_join(F.transform(F.split(quoted, ""), one), "")).otherwise(quoted)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def canonical_json(value: Column, depth: int = 6) -> Column:
    """One text for every spelling of a JSON value (a variant column), by built-ins alone.

    Object keys are sorted, strings trimmed, fractions rounded to four places, and lists of plain values sorted by their
    text. Objects and lists become the same kind of entries, so each level holds the next one once and the expression
    grows with ``depth`` in proportion; deeper values keep their own spelling.
    """
    return _bound(value, lambda v: _canonical(v, depth))


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"(?U)^\s+|\s+$", "")


def _canonical(value: Column, depth: int) -> Column:
    kind = F.schema_of_variant(value)
    fraction = F.round(value.cast("double"), 4).cast("string")
    plain = F.when(kind == "STRING", _escaped(_trimmed(value))).when(kind.rlike("^(DECIMAL\\(\\d+,[^0]|DOUBLE|FLOAT)"), fraction).otherwise(F.to_json(value))
    if not depth:
        return plain
    is_object = kind.startswith("OBJECT")
    fields = _bound(value.try_cast("map<string,variant>"), lambda held: F.transform(
        F.array_sort(F.map_keys(held)), lambda k: F.struct(k.alias("name"), F.element_at(held, k).alias("value"), F.lit(0).alias("place")),
    ))
    items = F.transform(value.try_cast("array<variant>"), lambda x, i: F.struct(F.lit(None).cast("string").alias("name"), x.alias("value"), i.cast("int").alias("place")))

    def spell(entry: Column) -> Column:
        own = F.schema_of_variant(entry["value"])
        order = F.when(own == "BOOLEAN", F.initcap(entry["value"].cast("string"))).when(own == "STRING", _trimmed(entry["value"]))
        return _bound(_canonical(entry["value"], depth - 1), lambda made: F.struct(
            F.coalesce(order, made).alias("by"), entry["place"].alias("place"), own.rlike("^(OBJECT|ARRAY|VOID)").alias("nested"),
            F.coalesce(F.concat(_escaped(entry["name"]), F.lit(": "), made), made).alias("made"),
        ))

    def joined(held: Column) -> Column:
        in_order = F.when(is_object | F.exists(held, lambda x: x["nested"]), held).otherwise(F.array_sort(held))
        body = F.array_join(F.transform(in_order, lambda x: x["made"]), ", ")
        return F.concat(F.when(is_object, "{").otherwise("["), body, F.when(is_object, "}").otherwise("]"))

    held = _bound(F.transform(F.when(is_object, fields).otherwise(items), spell), joined)
    return F.when(kind.rlike("^(OBJECT|ARRAY)"), held).otherwise(plain)


def call_fingerprint(tool: Column, args_json: Column) -> Column:
    """sha256 of tool and canonical arguments; missing ones are an empty object, broken JSON counts as it stands."""
    text = F.when(F.coalesce(args_json, F.lit("")) == "", "{}").otherwise(args_json)
    return F.sha2(F.concat(tool, F.lit(":"), F.coalesce(canonical_json(F.try_parse_json(text)), text)), 256)


def content_hash(**parts: Column) -> Column:
    """sha256 of a JSON object with sorted keys built from the named columns."""
    body = F.to_json(F.struct(*[parts[name].alias(name) for name in sorted(parts)]))
    return F.sha2(body, 256)
