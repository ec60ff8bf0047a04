"""Template definitions as tables: load, upsert, nested view, instruction text, look-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldmill import constants as K


def _default(c, fallback):
    return F.coalesce(F.nullif(c, F.lit("")), fallback)


def template_fields(definitions: DataFrame, order_by: str) -> DataFrame:
    """Template definitions (nested, schema ``TEMPLATE_FILE``) -> one row per field.

    ``order_by`` names the column that orders templates (the file name). Missing parts take their
    defaults: label = key, type = string, required = false.
    """
    flat = definitions.select(
        F.col(order_by).alias("template_order"), F.col("key").alias("template_key"),
        _default(F.col("name"), F.col("key")).alias("name"),
        _default(F.col("industry"), F.lit("general")).alias("industry"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("template_aliases"),
        F.posexplode_outer("fields").alias("order", "_f"))
    return flat.select(
        "template_order", "template_key", "name", "industry", "description", "template_aliases",
        "order", F.col("_f.key").alias("field_key"),
        _default(F.col("_f.label"), F.col("_f.key")).alias("label"),
        _default(F.col("_f.data_type"), F.lit("string")).alias("data_type"),
        F.coalesce("_f.required", F.lit(False)).alias("required"),
        F.coalesce("_f.aliases", F.array().cast("array<string>")).alias("aliases"),
        F.col("_f.validation").alias("rules"))


def upsert_template_fields(stored: DataFrame, loaded: DataFrame) -> DataFrame:
    """Loaded rows replace stored rows with the same (template, field); other rows are kept."""
    keys = ["template_key", "field_key"]
    rest = [c for c in stored.columns if c not in keys]
    new = loaded.select(*keys, F.struct(*rest).alias("_new"))
    old = stored.select(*keys, F.struct(*rest).alias("_old"))
    kept = F.coalesce("_new", "_old")
    return (old.join(new, keys, "full_outer")
            .select(*keys, *[kept[c].alias(c) for c in rest],
                    F.when(F.col("_old").isNull(), "inserted").when(
                        F.col("_new").isNull(), "kept").otherwise("updated").alias("outcome")))


def nested_templates(fields: DataFrame) -> DataFrame:
    """One row per template with its ordered field list (bounded by the template's size)."""
    item = F.struct("order", "field_key", "label", "data_type", "required", "aliases", "rules")
    return (fields.groupBy("template_key")
            .agg(F.max("name").alias("name"), F.max("industry").alias("industry"),
                 F.max("description").alias("description"),
                 F.array_sort(F.collect_list(F.when(F.col("field_key").isNotNull(), item)))
                 .alias("fields")))


def contract_text(fields: DataFrame) -> DataFrame:
    """Instruction text of each template for whoever fills it in."""
    rules = F.to_json("rules")
    line = F.concat(
        F.lit("- "), F.col("field_key"), F.lit(" ("), F.col("data_type"), F.lit(", "),
        F.when(F.col("required"), "required").otherwise("optional"), F.lit("): "), F.col("label"),
        F.lit("."), F.when(F.size("aliases") > 0, F.concat(
            F.lit(" Aliases: "), F.array_join("aliases", ", "), F.lit("."))).otherwise(""),
        F.when(F.coalesce(rules, F.lit("{}")) != "{}", F.concat(
            F.lit(" Validation: "), rules, F.lit("."))).otherwise(""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("order", line.alias("line")))),
                        lambda x: x["line"])
    head = F.concat(F.lit("Template extraction mode: "), F.max("name"), F.lit(" ("),
                    F.col("template_key"), F.lit(")."))
    return fields.groupBy("template_key").agg(F.array_join(F.concat(
        F.array(head, F.lit(K.CONTRACT_HEAD)), lines, F.array(F.lit(K.CONTRACT_TAIL))),
        "\n").alias("contract"))


def attach_definition(fields: DataFrame, definitions: DataFrame) -> DataFrame:
    """Adds definition_id by (template_key, standard_field_key); no match leaves NULL."""
    small = definitions.select("template_key", F.col("field_key").alias("standard_field_key"),
                               "definition_id")
    return fields.join(small, ["template_key", "standard_field_key"], "left")
