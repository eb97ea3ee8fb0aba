"""JSON building and checking helpers.

Building: card objects in the reference are serialised from sorted maps, so
``obj`` emits struct fields in alphabetical key order; ``to_json`` then
writes exactly that order and omits null fields.  Arrays whose elements have
different shapes use ``union_obj``: every element carries the same
alphabetical field list and the fields it lacks are null (so omitted).

Checking: typed access goes through VARIANT, whose ``schema_of_variant``
tells a JSON string from a number (``from_json`` would coerce ``5`` to
``"5"``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings.functions.text import let


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def obj(**fields) -> Column:
    """Struct with keys in alphabetical order (serialises like a sorted map)."""
    parts = []
    for k in sorted(fields):
        parts += [F.lit(k), _lit(fields[k])]
    return F.named_struct(*parts)


def union_obj(shape: dict[str, str], **fields) -> Column:
    """Struct over the full ``shape`` (key -> DDL type), absent keys null."""
    unknown = set(fields) - set(shape)
    if unknown:
        raise KeyError(f"keys not in shape: {sorted(unknown)}")
    parts = []
    for k in sorted(shape):
        v = _lit(fields[k]) if k in fields else F.lit(None)
        parts += [F.lit(k), v.cast(shape[k])]
    return F.named_struct(*parts)


def vtype(v) -> Column:
    """VARIANT type name of a value; SQL NULL for a missing path."""
    v = F.col(v) if isinstance(v, str) else v
    return F.schema_of_variant(v)


def vfield(v, path: str) -> Column:
    """Sub-value at a JSON path as VARIANT (null when absent)."""
    v = F.col(v) if isinstance(v, str) else v
    return F.try_variant_get(v, path, "variant")


def is_vtype(v, *types: str) -> Column:
    """True when the value exists and has one of the given variant types."""
    return F.coalesce(vtype(v).isin(*types), F.lit(False))


def is_vstring(v) -> Column:
    return is_vtype(v, "STRING")


def is_vint(v) -> Column:
    """JSON integer (serde's i32/i64/u64 accept only integer literals)."""
    return is_vtype(v, "BIGINT")


def is_vnumber(v) -> Column:
    t = vtype(v)
    return F.coalesce(t.isin("BIGINT", "DOUBLE") | t.startswith("DECIMAL"),
                      F.lit(False))


def is_vobject(v) -> Column:
    return F.coalesce(vtype(v).startswith("OBJECT"), F.lit(False))


def is_varray(v) -> Column:
    return F.coalesce(vtype(v).startswith("ARRAY"), F.lit(False))


def is_vnull_or_absent(v) -> Column:
    """Absent path or JSON null: what serde maps to ``None`` for Option."""
    return F.coalesce(vtype(v) == "VOID", F.lit(True))


#: a string, a bracket or separator, or any other run (number, literal, garbage)
JSON_TOKEN = r'"(?:[^"\\]|\\.)*+"|[{}\[\]:,]|[^\s{}\[\]:,"]+|"'
JSON_KEY = r'^("(?:[^"\\]|\\.)*+"):'


def last_members(text: Column) -> Column:
    """An object's text with only the last member of each repeated key, null
    for anything else: how a dynamic JSON value reads repeated keys.

    One pass over the tokens cuts the object into its members; members keep
    their text, so what is wrong inside them stays wrong.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("member"), F.array().cast("array<string>").alias("members"),
                     F.lit(True).alias("ok"))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
        outer = ((s["depth"] == 0) & (t == "{")) | ((depth == 0) & (t == "}"))
        ends = ((s["depth"] == 1) & (t == ",")) | ((depth == 0) & (t == "}"))
        ok = s["ok"] & ((s["depth"] > 0) | ((t == "{") & (F.size(s["members"]) == 0) & (s["member"] == "")))
        return F.struct(depth.alias("depth"), F.when(ends, "").when(outer, s["member"]).otherwise(F.concat(s["member"], t)).alias("member"),
                        F.when(ends, F.concat(s["members"], F.array(s["member"]))).otherwise(s["members"]).alias("members"), ok.alias("ok"))

    def key(member: Column) -> Column:
        return F.get(F.from_json(F.concat(F.lit("["), F.regexp_extract(member, JSON_KEY, 1), F.lit("]")), "array<string>"), F.lit(0))

    def kept(members: Column) -> Column:
        named = F.transform(members, lambda m: F.struct(key(m).alias("k"), m.alias("m")))
        return let(named, lambda all_: F.transform(
            F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, i + 2, F.greatest(F.size(all_) - i - 1, F.lit(0))), lambda y: y["k"] == x["k"])),
            lambda x: x["m"]))

    folded = F.aggregate(F.regexp_extract_all(text, F.lit(JSON_TOKEN), 0), start, step)
    return let(folded, lambda f: F.when(f["ok"] & (f["depth"] == 0) & (F.size(f["members"]) > 0),
                                        F.concat(F.lit("{"), F.array_join(kept(f["members"]), ","), F.lit("}"))))
