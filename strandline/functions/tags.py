"""Tag text of metric points as maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tags_to_map(tags: Column) -> Column:
    """`k=v,k=v` (blanks and double quotes trimmed, braces around all allowed) as a map; the last of equal keys wins,
    pieces without `=` are dropped. A JSON object is read as such."""
    bare = F.regexp_replace(F.trim(tags), r"^\{|\}$", "")
    pieces = F.filter(F.split(bare, ","), lambda p: F.contains(p, F.lit("=")))
    clean = lambda c: F.regexp_replace(c, r'^[\s"]+|[\s"]+$', "")
    entries = F.transform(pieces, lambda p: F.struct(clean(F.substring_index(p, "=", 1)).alias("key"), clean(F.regexp_replace(p, r"^[^=]*=", "")).alias("value")))
    # The last entry of a key, found without a map: equal keys would need a session setting.
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["key"] == e["key"]))
    as_json = F.from_json(tags, "map<string,string>")
    return F.when(F.trim(tags).rlike(r'^\{\s*"[^"]*"\s*:'), as_json).otherwise(F.map_from_entries(last))


def has_tags(tag_map: Column, wanted: dict[str, str]) -> Column:
    """All wanted pairs are there; an absent key equals nothing, an empty value only itself."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & F.coalesce(F.try_element_at(tag_map, F.lit(k)) == v, F.lit(False))
    return out
