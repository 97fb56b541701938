"""Chains of processors that are fitted on a training window and applied later."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .normalize import PROCESSORS, apply_robust, fit_robust

#: Classes that study documents name, by what they do here.
FITTED, FILL, DROP_LABEL, RANK = "RobustZScoreNorm", "Fillna", "DropnaLabel", "CSRankNorm"

Step = Callable[[DataFrame], DataFrame]


def fit_chain(specs: Sequence[Mapping[str, Any]], train: DataFrame, features: Sequence[str], label: str) -> Step:
    """A function that applies the specs ({"class", "kwargs"}) in order. RobustZScoreNorm learns medians and deviations from the training
    window as the specs before it leave it; Fillna fills missing features (fill_value, 0); DropnaLabel drops rows without a label;
    CSRankNorm ranks within dates; any other class is one of normalize.PROCESSORS. kwargs.fields_group is feature or label."""
    steps: list[Step] = []

    def so_far(df: DataFrame) -> DataFrame:
        for step in steps:
            df = step(df)
        return df

    for spec in specs:
        kwargs = dict(spec.get("kwargs") or {})
        group = kwargs.pop("fields_group", "feature")
        if group not in ("feature", "label"):
            raise ValueError(f"{group!r} is no group of fields")
        columns = list(features) if group == "feature" else [label]
        steps.append(_step(spec["class"], kwargs, columns, label, so_far(train)))
    done = list(steps)

    def apply(df: DataFrame) -> DataFrame:
        for step in done:
            df = step(df)
        return df

    return apply


def _step(kind: str, kwargs: dict[str, Any], columns: list[str], label: str, train: DataFrame) -> Step:
    if kind == FITTED:
        clip = kwargs.pop("clip_outlier", True)
        fitted = fit_robust(train, columns)
        return lambda df: apply_robust(df, fitted, columns, limit=3.0 if clip else float("inf"))
    if kind == FILL:
        value = float(kwargs.pop("fill_value", 0.0))
        return lambda df: df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(value)) for c in columns})
    if kind == DROP_LABEL:
        return lambda df: df.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    name = "cs_rank" if kind == RANK else kind
    if name not in PROCESSORS:
        raise KeyError(f"unknown processor {kind!r}; known: {', '.join((FITTED, FILL, DROP_LABEL, RANK, *sorted(PROCESSORS)))}")

    def normalized(df: DataFrame) -> DataFrame:
        for c in columns:
            df = PROCESSORS[name](df, c, c, **kwargs)
        return df

    return normalized
