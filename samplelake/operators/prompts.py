"""Prompts: response format, metadata prompt, file context."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplelake.fields import Group

JSON_TYPES = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}


def response_format(group: Group) -> str:
    """A JSON schema of the reply, a constant of the group."""
    properties = {}
    for f in group.fields:
        rule = {"type": JSON_TYPES.get(f.type, "string")}
        if f.description:
            rule["description"] = f.description
        if f.options:
            rule["enum"] = list(f.options)
        properties[f.name] = rule
    schema = {"type": "object", "properties": properties, "required": list(properties)}
    return json.dumps(schema, ensure_ascii=False, indent=1) + "\n"


def metadata_prompt(context: Column, group: Group) -> Column:
    return F.concat_ws(
        "\n",
        F.lit("Read the attributes of a biological sample and fill in the form below."),
        F.lit("ATTRIBUTES"),
        context,
        F.lit("FORM"),
        F.lit(response_format(group)),
        F.lit("Use null for what the attributes do not say. First give your reasons in at most 50 words, "
              "then one fenced json block that is valid JSON without comments."),
    )


def build_prompts(context: DataFrame, group: Group, model: str = "") -> DataFrame:
    """``prompt_key, file, sample, group_id, prompt``; equal prompts to one model share a key."""
    return context.withColumn("prompt", metadata_prompt(F.col("context"), group)).select(
        F.sha2(F.concat_ws("\n", F.lit(model), F.col("prompt")), 256).alias("prompt_key"),
        "file",
        "sample",
        F.lit(group.group_id).alias("group_id"),
        "prompt",
    )


def file_context(supp: DataFrame) -> DataFrame:
    """``sample, context``: a sample's files by name, numbered, each with its peek.

    ``supp`` holds ``sample, name, lines, total``; a peek has at most ten short lines.
    """
    peek = F.concat_ws(
        "\n", F.array_join("lines", "\n"), F.concat(F.lit("[Total "), F.col("total").cast("string"), F.lit(" lines]"))
    )
    files = F.array_sort(F.collect_list(F.struct("name", peek.alias("peek"))))
    parts = F.transform(
        files,
        lambda f, i: F.concat(
            F.lit("File "), (i + 1).cast("string"), F.lit(": `"), f["name"], F.lit("`\n```\n"), f["peek"], F.lit("\n```")
        ),
    )
    return supp.groupBy("sample").agg(F.array_join(parts, "\n").alias("context"))

