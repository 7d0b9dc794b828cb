"""One entry for each thing that is done to a folder of layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinotable.operators.rewrite import frozen, injected
from kinotable.operators.rules import freeze_checks, layer_checks, layer_coverage, verdict
from kinotable.sources.containers import packages


def _packed(layers: DataFrame) -> DataFrame:
    rows = layers.select(F.col("path").alias("package"), F.lit(0).alias("place"), F.col("path").alias("name"), F.encode("text", "UTF-8").alias("data"))
    return packages(rows)


#: What each mode makes of layers (path, text).
MODES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "diagnose": layer_checks,
    "coverage": layer_coverage,
    "fix": frozen,
    "inject": injected,
    "export": _packed,
    "verify": lambda layers: verdict(freeze_checks(layers, frozen(layers))),
}


def run(mode: str, layers: DataFrame) -> DataFrame:
    """The result of a mode; an unknown mode, or layers without path and text, raise an error."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}; there are {', '.join(sorted(MODES))}")
    if missing := {"path", "text"} - set(layers.columns):
        raise ValueError(f"layers have no {', '.join(sorted(missing))}")
    return MODES[mode](layers)
