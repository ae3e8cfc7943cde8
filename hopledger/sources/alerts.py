"""Alert batches as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRING_MAP = "map<string,string>"


def parse_alerts(bodies: DataFrame, column: str = "value") -> DataFrame:
    """Each element of a JSON array of alerts as a row; the element is kept as text in ``raw``.

    Missing labels or annotations are empty maps. Labels that are no string map are null. Bodies that
    are no array of objects give no row here; ``rejected_bodies`` has them.
    """
    raw = bodies.filter(_is_alert_array(column)).select(F.explode(F.from_json(column, "array<string>")).alias("raw"))
    empty = F.expr("map()").cast(STRING_MAP)

    def string_map(field: str) -> Column:
        text = F.get_json_object("raw", f"$.{field}")
        return F.when(text.isNull(), empty).otherwise(F.from_json(text, STRING_MAP))

    return raw.select(
        string_map("labels").alias("labels"), string_map("annotations").alias("annotations"),
        F.get_json_object("raw", "$.startsAt").alias("starts_at"),
        F.get_json_object("raw", "$.endsAt").alias("ends_at"), "raw",
    )


def _is_alert_array(column: str) -> Column:
    """Whether the text is a JSON array of objects only; an empty one counts."""
    whole = F.try_parse_json(column)
    kinds = F.transform(F.from_json(column, "array<string>"), lambda e: F.coalesce(F.schema_of_variant(F.try_parse_json(e)), F.lit("")))
    array = F.coalesce(F.schema_of_variant(whole).startswith("ARRAY"), F.lit(False))
    return array & F.coalesce(F.forall(kinds, lambda k: k.startswith("OBJECT")), F.lit(False))


def rejected_bodies(bodies: DataFrame, column: str = "value") -> DataFrame:
    """The bodies that cannot be read as alerts, with the reason."""
    reason = F.when(F.col(column).isNull(), "empty").when(F.try_parse_json(column).isNull(), "malformed").otherwise("not an array of alerts")
    return bodies.filter(~_is_alert_array(column)).withColumn("reason", reason)


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    wrapped = F.to_json(F.struct(text.alias("a")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def render_alerts(enriched: DataFrame) -> DataFrame:
    """K3: alerts as JSON text in ``value``, keys in order, fields other than the two maps as they came."""
    texts = F.from_json("raw", STRING_MAP)
    kinds = F.from_json("raw", "map<string,variant>")

    def untouched(key: Column) -> Column:
        is_text = F.schema_of_variant(F.try_element_at(kinds, key)) == "STRING"
        value = F.try_element_at(texts, key)
        return F.when(is_text, _quoted(value)).otherwise(F.coalesce(value, F.lit("null")))

    def member(key: Column) -> Column:
        value = (
            F.when(key == "labels", F.to_json("labels"))
            .when(key == "annotations", F.to_json("annotations"))
            .otherwise(untouched(key))
        )
        return F.concat(_quoted(key), F.lit(":"), value)

    keys = F.array_union(
        F.json_object_keys("raw"),
        F.when(F.size("annotations") > 0, F.array(F.lit("annotations"))).otherwise(F.expr("array()")),
    )
    members = F.transform(F.array_sort(keys), member)
    return enriched.select(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")).alias("value"))
