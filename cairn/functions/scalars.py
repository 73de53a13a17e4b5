"""Scalar functions, as Columns, and their parsers for the driver."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.operators.filters import json_path


def base64_of(c: Column) -> Column:
    """X1"""
    return F.base64(c)


def canonical_address(c: Column) -> Column:
    """0x and 64 lower-case hex digits, from a hex text with or without 0x."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.regexp_replace(c, "^0[xX]", "")), 64, "0"))


def bytes_to_base64(json: Column, pointer: str) -> Column:
    """The array of bytes at a JSON pointer as base64; null if it isn't one."""
    numbers = F.from_json(F.get_json_object(json, json_path(pointer)), "array<int>")
    whole = F.size(numbers) > 0
    good = F.forall(numbers, lambda x: x.isNotNull() & (x >= 0) & (x <= 255))
    return F.when(whole & good, F.base64(F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 2, "0")), ""))))


#: A string; what may be an array of bytes; anything up to the next of these; the begin of another array.
_JSON_PARTS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|\[[\s\d,]*\]|[^"\[]++|\['


def byte_arrays_to_base64(json: Column) -> Column:
    """A JSON text in which every array of whole numbers from 0 to 255, at any depth, is its base64 text; an empty one is "".

    All else stays to the last character. Inside such an array there is no other, so that one pass over the text is enough.
    """
    numbers = lambda x: F.filter(F.transform(F.split(F.regexp_replace(x, r"[\[\]\s]", ""), ","), lambda n: n), lambda n: n != "")
    whole = lambda x: F.forall(numbers(x), lambda n: (F.length(n) <= 3) & (n.try_cast("int") <= 255))
    coded = lambda x: F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(numbers(x), lambda n: F.lpad(F.hex(n.cast("long")), 2, "0")), ""))), "[\r\n]", "")
    part = lambda x: F.when(x.startswith("[") & x.endswith("]") & whole(x), F.concat(F.lit('"'), coded(x), F.lit('"'))).otherwise(x)
    return F.array_join(F.transform(F.regexp_extract_all(json, F.lit(_JSON_PARTS), F.lit(0)), part), "")


def json_pointer(json: Column, pointer: str) -> Column:
    """X4"""
    return F.get_json_object(json, json_path(pointer))


def struct_tag(c: Column) -> dict[str, Column]:
    """Package, module, name and parameters of pkg::module::Name<T, ..>; empty where the text is none."""
    pattern = r"(?s)^([^:<]+)::([^:<]+)::([^:<]+)(?:<(.*)>)?$"
    return {n: F.regexp_extract(c, pattern, i) for i, n in enumerate(("package", "module", "name", "parameters"), 1)}


def ms_to_timestamp(c: Column) -> Column:
    """X6"""
    return F.timestamp_millis(c)


MISSING, UNCLOSED, DEPTH = "missing field", "unclosed brace", "too deep"


def render_template(template: Column, fields: Column, most_depth: int = 10) -> Column:
    """A struct of text and error for a template with {a.b} over a JSON text; \\{ and \\} are braces.

    A field that is missing, an object or an array makes an error, as does a path of more than most_depth names or
    an unclosed brace.
    """
    tokens = F.regexp_extract_all(template, F.lit(r"(\\[{}]|\{[^{}]*\}|[^\\{}]+|[\\{}])"), F.lit(1))

    def step(acc: Column, token: Column) -> Column:
        name = F.substr(token, F.lit(2), F.length(token) - 2)
        value = F.call_function("get_json_object", fields, F.concat(F.lit("$."), name))
        bad = F.when(F.size(F.split(name, r"\.")) > most_depth, DEPTH).when(value.isNull() | value.rlike(r"^[\[{]"), F.concat(F.lit(MISSING + " "), name))
        field = F.length(token) > 1
        text = F.when(token.isin("\\{", "\\}"), F.substr(token, F.lit(2), F.lit(1))).when(token.startswith("{") & field, F.coalesce(value, F.lit(""))).otherwise(token)
        error = F.when(token.startswith("{") & field, bad).when(token.isin("{", "}"), UNCLOSED)
        return F.struct(F.concat(acc["text"], text).alias("text"), F.coalesce(acc["error"], error).alias("error"))

    zero = F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("error"))
    done = F.aggregate(tokens, zero, step)
    return F.struct(F.when(done["error"].isNull(), done["text"]).alias("text"), done["error"].alias("error"))


_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}


def relative_time(text: str, now: int) -> int:
    """Unix seconds of "now", "now-1h", "now-30m 10s" or an absolute UTC time like "2024-01-01 00:00:00"."""
    text = text.strip()
    if text == "now":
        return now
    if text.startswith("now-"):
        parts = re.findall(r"(\d+)\s*([smhdw])", text[4:])
        if not parts or re.sub(r"\d+\s*[smhdw]\s*", "", text[4:]):
            raise ValueError(f"not a time: {text!r}")
        return now - sum(int(n) * _UNITS[u] for n, u in parts)
    return int(datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp())


def power(x: Column, n) -> Column:
    """X to the power of n, as a double."""
    return F.pow(x.cast("double"), F.lit(n) if not isinstance(n, Column) else n)


def rounded(x: Column) -> Column:
    """The nearest integer, halves away from zero."""
    return F.round(x).cast("long")


def root(x: Column) -> Column:
    """The square root; null below zero."""
    return F.when(x >= 0, F.sqrt(x.cast("double")))


def checked_add(a: Column, b: Column) -> Column:
    """X11: raises on overflow in ANSI mode."""
    return a + b


def saturating_sub(a: Column, b: Column) -> Column:
    """X11: 0 at least."""
    return F.greatest(a - b, F.lit(0))


def basis_points(x: Column, rate: Column) -> Column:
    """(x * rate + 5000) / 10000 in wide integers, which rounds half up."""
    return F.floor((x.cast("decimal(20,0)") * rate.cast("decimal(10,0)") + 5000) / 10_000).cast("decimal(38,0)")


def file_number(path: Column) -> Column:
    """The number that a file's name starts with."""
    return F.regexp_extract(path, r"([0-9]+)\.[^/]*$", 1).try_cast("long")


def path_epoch(path: Column) -> Column:
    """N of epoch_n or epoch=n in a path."""
    return F.regexp_extract(path, r"epoch[_=]([0-9]+)", 1).try_cast("long")


def log_time(line: Column) -> Column:
    """Milliseconds of the leading 24 characters, as UTC."""
    return F.unix_millis(F.to_timestamp(F.substring(line, 1, 24)))
