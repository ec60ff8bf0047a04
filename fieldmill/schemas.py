"""Types shared by the operators, written as DDL strings Spark parses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RULES = ("struct<min:double,max:double,min_length:int,pattern:string,currencies:array<string>,"
         "allowed:array<string>,require_currency_symbol:boolean,formats:array<string>>")
SOURCE = ("struct<line:int,start:int,end:int,json_path:string,row:bigint,column:string>")
# One extracted field on its way to the field table.
FIELD = (f"struct<field_name:string,value:string,confidence:double,snippet:string,"
         f"reasoning:string,auto_accept:boolean,standard_field_key:string,template_key:string,"
         f"data_type:string,required:boolean,rules:{RULES},source:{SOURCE}>")
FIELD_COLUMNS = ["field_name", "value", "confidence", "snippet", "reasoning", "auto_accept",
                 "standard_field_key", "template_key", "data_type", "required", "rules", "source"]
TEMPLATE_FILE = (
    "key string, name string, industry string, description string, aliases array<string>, "
    "fields array<struct<key:string,label:string,data_type:string,required:boolean,"
    f"aliases:array<string>,validation:{RULES}>>")
TEMPLATE_FIELD = (f"struct<order:int,field_key:string,label:string,data_type:string,"
                  f"required:boolean,aliases:array<string>,rules:{RULES}>")


def field(name, value, confidence, snippet, reasoning, auto_accept=False, source=None) -> Column:
    """One field struct with the template columns still empty."""
    def as_column(x):
        return x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_column(name).cast("string").alias("field_name"),
        as_column(value).cast("string").alias("value"),
        as_column(confidence).cast("double").alias("confidence"),
        as_column(snippet).cast("string").alias("snippet"),
        as_column(reasoning).cast("string").alias("reasoning"),
        as_column(auto_accept).cast("boolean").alias("auto_accept"),
        F.lit(None).cast("string").alias("standard_field_key"),
        F.lit(None).cast("string").alias("template_key"),
        F.lit(None).cast("string").alias("data_type"),
        F.lit(False).alias("required"),
        F.lit(None).cast(RULES).alias("rules"),
        (F.lit(None) if source is None else source).cast(SOURCE).alias("source"),
    )


def source_span(line=None, start=None, end=None, json_path=None, row=None, column=None) -> Column:
    """Where a value came from; parts that do not apply stay NULL."""
    def part(x, kind):
        return (F.lit(None) if x is None else x).cast(kind)
    return F.struct(
        part(line, "int").alias("line"), part(start, "int").alias("start"),
        part(end, "int").alias("end"), part(json_path, "string").alias("json_path"),
        part(row, "bigint").alias("row"), part(column, "string").alias("column"))
