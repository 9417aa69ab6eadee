"""Column expressions over nested pipeline strings.

A pipeline is written ``Outer(Inner(data, Inner.p=v), Outer.q=w)``: the
innermost step runs first. Step names are the identifiers before ``(``;
parameters are ``Algo.param=value`` items.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the nested pipeline notation. Step names may hold hyphens;
# a parameter may carry its step's name; a value in round brackets is one value.
STEP_PATTERN = r"([A-Za-z][\w\-]*)\("
TUPLE_PATTERN = r"=\(([^()]*)\)"
PARAM_PATTERN = r"(?:([A-Za-z][\w\-]*)\.)?([A-Za-z_]\w*)=(\x01[^\x02]*\x02|[^,\x01]+)"
# Preprocessing step names dropped before characterization.
PREPROCESSING_STEPS = ["ord-enc", "oh-enc", "imputation"]


def _masked(pipeline: Column | str) -> Column:
    """The text with the brackets of tuple values marked, so that others are steps' own."""
    p = F.col(pipeline) if isinstance(pipeline, str) else pipeline
    return F.regexp_replace(p, TUPLE_PATTERN, "=\x01$1\x02")


def step_names(pipeline: Column | str) -> Column:
    """Algorithms in execution order (innermost first)."""
    return F.reverse(F.regexp_extract_all(_masked(pipeline), F.lit(STEP_PATTERN), 1))


def param_items(pipeline: Column | str) -> Column:
    """Array of structs (step_no, algorithm, param, value), innermost step first.

    A step's parameters stand before the bracket that closes it, so the text
    between the n-th and the next closing bracket has those of step n. Without a
    prefix a parameter belongs to that step.
    """
    names = step_names(pipeline)

    def of_step(text: Column, i: Column) -> Column:
        prefixes, params, values = (F.regexp_extract_all(text, F.lit(PARAM_PATTERN), k) for k in (1, 2, 3))
        zipped = F.arrays_zip(prefixes.alias("prefix"), params.alias("param"), values.alias("value"))
        return F.transform(zipped, lambda x: F.struct(
            i.cast("long").alias("step_no"), F.when(x["prefix"] != "", x["prefix"]).otherwise(F.get(names, i)).alias("algorithm"),
            x["param"].alias("param"), F.translate(F.trim(x["value"]), "\x01\x02", "()").alias("value")))

    return F.flatten(F.transform(F.split(_masked(pipeline), r"\)"), of_step))


def bucket_of(pipeline_id: Column | str, buckets: int = 1000) -> Column:
    """Storage bucket of a pipeline id: ``(200003 * id + 200131) mod buckets``."""
    i = F.col(pipeline_id) if isinstance(pipeline_id, str) else pipeline_id
    # The bucket hash constants.
    return F.pmod(F.lit(200003) * i + F.lit(200131), F.lit(buckets))
