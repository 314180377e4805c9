"""Log text: tokens, severities and JSON payloads, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity names and their numbers, and the keys of a payload that are read.
SEVERITIES = {"DEBUG": 1, "INFO": 2, "INFORMATION": 2, "WARN": 3, "WARNING": 3, "ERROR": 4, "FATAL": 5, "CRITICAL": 5}
NAMES = {1: "DEBUG", 2: "INFO", 3: "WARN", 4: "ERROR", 5: "FATAL"}
SEVERITY_KEYS = ("level", "severity", "status")
BODY_KEYS = ("message", "msg", "body")


def once(value: Column, body) -> Column:
    """body(value) with `value` worked out once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits of two bytes or more, each once, in order of appearance."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda t: F.octet_length(t) >= 2))


def parse_severity(text: Column) -> Column:
    """1 to 5; unknown and null names are INFO."""
    out = F.lit(2)
    for name, number in SEVERITIES.items():
        out = F.when(F.upper(text) == name, number).otherwise(out)
    return out


def severity_to_string(number: Column) -> Column:
    out = F.lit("INFO")
    for n, name in NAMES.items():
        out = F.when(number == n, name).otherwise(out)
    return out


def parse_log_payload(raw: Column) -> Column:
    """struct(body, severity, attributes) of a payload.

    Of a JSON object the first string among SEVERITY_KEYS is the severity and the first among BODY_KEYS the body; what
    is left becomes JSON with sorted keys. Without a body, and for anything else, the body is the payload itself."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT"), F.lit(False))
    members = F.when(is_object, F.from_json(raw, "map<string,variant>"))

    def first(m: Column, keys: tuple[str, ...]) -> Column:
        """The first of `keys` whose member is a string."""
        return F.coalesce(*[F.when(F.coalesce(F.schema_of_variant(F.try_element_at(m, F.lit(k))) == "STRING", F.lit(False)), F.lit(k)) for k in keys])

    def shaped(m: Column, sev_key: Column, body_key: Column) -> Column:
        text = lambda key: F.try_variant_get(F.try_element_at(m, key), "$", "string")

        def whole_or_parts(body: Column) -> Column:
            whole = F.coalesce(body, F.lit("")) == ""
            rest = F.map_filter(m, lambda k, v: ~k.eqNullSafe(sev_key) & ~k.eqNullSafe(body_key))
            ordered = F.map_from_entries(F.array_sort(F.map_entries(rest), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
            attributes = once(rest, lambda r: F.when(F.size(r) <= 0, "").otherwise(F.to_json(ordered)))
            return F.struct(
                F.when(whole, raw).otherwise(body).alias("body"),
                severity_to_string(parse_severity(text(sev_key))).alias("severity"),
                F.coalesce(F.when(whole, "").otherwise(attributes), F.lit("")).alias("attributes"),
            )

        return once(text(body_key), whole_or_parts)

    keyed = lambda m: once(F.struct(first(m, SEVERITY_KEYS).alias("s"), first(m, BODY_KEYS).alias("b")), lambda k: shaped(m, k["s"], k["b"]))
    # Most payloads are objects or plain text; the text is parsed for the first only.
    plain = F.struct(raw.alias("body"), F.lit("INFO").alias("severity"), F.lit("").alias("attributes"))
    return F.when(F.coalesce(F.startswith(F.ltrim(raw), F.lit("{")), F.lit(False)), once(members, keyed)).otherwise(plain)
