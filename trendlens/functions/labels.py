"""Label expressions (B10, B13, B14) as built-in string functions.  Labels of interaction
terms (B12) come from the design itself, see ``operators.interact.design``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_label(parameter: Column, level: Column, feature: Column) -> Column:
    """``Col = Value`` for one-hot features (from lineage), the
    parameter name for numerics, ``Intercept`` kept."""
    return (F.when(feature == F.lit("Intercept"), F.lit("Intercept"))
             .when(level.isNotNull(), F.concat(parameter, F.lit(" = "), level))
             .otherwise(parameter))


def display_name(name: Column) -> Column:
    """``:`` -> `` × ``, ``_`` -> space, title case."""
    return F.initcap(F.regexp_replace(F.regexp_replace(name, ":", " × "), "_", " "))


def parameter_of(feature: Column, params: Sequence[str]) -> Column:
    """B10 compat form (for result tables without lineage): the first
    parameter (list order) that is a substring of the feature name."""
    out = F.lit(None).cast("string")
    for p in reversed(list(params)):
        out = F.when(F.instr(feature, F.lit(p)) > 0, F.lit(p)).otherwise(out)
    return out
