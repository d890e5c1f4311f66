"""Feeds whose records change their shape: JSON kept as VARIANT, fields taken by path, and a report of what differs.

No schema is fixed while reading, so a number as text, a list where an object was, or a new field neither fails nor empties a batch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines with their record as VARIANT (``v``), null where a line is not JSON."""
    return lines.withColumn("v", F.expr(f"try_parse_json({value})"))


def _is_object() -> Column:
    return F.expr("schema_of_variant(v)").startswith("OBJECT")


def unreadable(records: DataFrame, value: str = "value") -> DataFrame:
    """Lines that are no JSON objects, as quarantine."""
    return records.filter(F.col("v").isNull() | ~_is_object()).select(value)


def at(path: str, kind: str = "string", v: str = "v") -> Column:
    """The value at a dotted path as ``kind``: numbers as text, whole numbers with a fraction and the first of a list instead of one object are met.
    What cannot be read is null."""
    steps = path.split(".")
    places = ["$." + ".".join(steps)]
    if len(steps) > 1:
        places.append(f"$.{steps[0]}[0]." + ".".join(steps[1:]))
    else:
        places.append(f"$.{steps[0]}[0]")

    def one(place: str) -> Column:
        text = F.expr(f"try_variant_get({v}, '{place}', 'string')")
        if kind == "string":
            # a list or an object has no text of its own
            return F.when(~F.coalesce(F.expr(f"schema_of_variant(try_variant_get({v}, '{place}', 'variant'))"), F.lit("")).rlike("^(ARRAY|OBJECT)"), text)
        number = F.trim(text)
        if kind == "bigint":
            return F.coalesce(number.try_cast("bigint"), F.try_to_number(F.regexp_replace(number, "[, ]", ""), F.lit("9" * 18)).cast("bigint"), number.try_cast("double").try_cast("bigint"))
        return number.try_cast(kind)

    return F.coalesce(*[one(p) for p in places])


def shaped(records: DataFrame, fields: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Records as nested columns with the given paths and kinds, as the normalisers take them."""
    plain = [at(p, k).alias(p) for p, k in fields.items() if "." not in p]
    groups: dict[str, list[Column]] = {}
    for path, kind in fields.items():
        head, _, rest = path.partition(".")
        if rest:
            if "." in rest:
                raise ValueError(f"only one level below a record: {path!r}")
            groups.setdefault(head, []).append(at(path, kind).alias(rest))
    return records.filter(_is_object()).select(*keep, *plain, *[F.struct(*c).alias(h) for h, c in groups.items()])


def whole_schema(records: DataFrame) -> DataFrame:
    """One row: the schema that holds all records."""
    return records.filter(_is_object()).agg(F.expr("schema_of_variant_agg(v)").alias("schema"))


#: Families of types that a kind is met with.
_MEETS = {"string": "STRING", "bigint": "BIGINT", "double": "DOUBLE|DECIMAL.*|BIGINT", "boolean": "BOOLEAN"}


def drift(records: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """(path, seen, records, status): the types that occur at each field of the records, against the kinds that are expected.

    Status is ``expected``, ``other type`` or ``new``; null values say nothing. Fields of an object that is expected to have some are looked
    through one level down, also where it comes as a list; then the object's own row says ``other type``.
    """
    heads = {p.partition(".")[0] for p in fields if "." in p}
    objects = records.filter(_is_object())
    first = objects.select(F.explode(F.expr("cast(v as map<string, variant>)")).alias("path", "item"))
    seen = F.expr("regexp_replace(schema_of_variant(item), '<.*', '')")
    top = first.select("path", "item", seen.alias("seen"))
    below = top.filter(F.col("path").isin(*heads)) if heads else top.limit(0)
    inner = below.withColumn("item", F.coalesce(F.expr("try_variant_get(item, '$', 'map<string, variant>')"), F.expr("try_variant_get(item, '$[0]', 'map<string, variant>')")))
    nested = inner.select("path", F.explode("item").alias("name", "item")).select(F.concat("path", F.lit("."), "name").alias("path"), seen.alias("seen"))
    kinds = {**{h: "OBJECT" for h in heads}, **{p: _MEETS[k] for p, k in fields.items()}}
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("path"))
    status = F.when(wanted.isNull(), "new").when(F.regexp_like("seen", F.concat(F.lit("^("), wanted, F.lit(")$"))), "expected").otherwise("other type")
    every = top.select("path", "seen").union(nested).filter(F.col("seen") != "VOID")
    return every.groupBy("path", "seen").agg(F.count("*").alias("records")).withColumn("status", status)
