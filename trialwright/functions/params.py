"""Column functions on parameters, scores and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAM_MAP = "map<string,double>"

# Values a parameter has when a search leaves it at the trainer's default (fixed values).
DEFAULT_PARAMS = {"alpha": 0.0, "colsample_bytree": 1.0, "lambda": 1.0,
                  "min_child_weight": 1.0, "subsample": 1.0}


def parse_params(text) -> Column:
    """Parameter text to ``map<string,double>``.

    Reads ``{'alpha': 0.8}`` and ``OrderedDict([('alpha', 0.8)])``; text that is neither gives NULL.
    """
    text = F.col(text) if isinstance(text, str) else text
    pairs = F.regexp_extract(text, r"^OrderedDict\(\[(.*)\]\)$", 1)
    as_json = F.concat(F.lit("{"), F.regexp_replace(pairs, r"\('([^']+)', ([^()]*)\)", "'$1': $2"), F.lit("}"))
    body = F.when(text.startswith("OrderedDict("), as_json).otherwise(text)
    return F.from_json(body, PARAM_MAP, {"allowSingleQuotes": "true"})


def params_to_columns(df: DataFrame, names: Sequence[str], params: str = "params", prefix: str = "param_") -> DataFrame:
    return df.select("*", *[F.col(params)[n].alias(prefix + n) for n in names])


def columns_to_params(names: Sequence[str], prefix: str = "param_") -> Column:
    """Map of the given parameter columns without the NULL ones."""
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(prefix + n).cast("double").alias("value"))
                        for n in names])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def fill_params_const(df: DataFrame, constants: Mapping[str, Mapping[str, float]], experiment: str = "experiment",
                      prefix: str = "param_", overwrite: bool = True) -> DataFrame:
    """Set parameter columns to a constant per experiment; ``overwrite=False`` only fills NULLs."""
    targets = sorted({p for values in constants.values() for p in values})
    filled = {}
    for p in targets:
        name = prefix + p
        current = F.col(name) if name in df.columns else F.lit(None).cast("double")
        value = None
        for exp, values in constants.items():
            if p in values:
                new = F.lit(float(values[p]))
                new = new if overwrite else F.coalesce(current, new)
                hit = F.col(experiment) == exp
                value = F.when(hit, new) if value is None else value.when(hit, new)
        filled[name] = value.otherwise(current)
    return df.withColumns(filled)


def round_to_int(col) -> Column:
    """Half-even rounding of a continuous proposal to an integer."""
    return F.bround(col).cast("int")


def nan_replacement(score, value: float = -999.0) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return F.coalesce(F.nanvl(score, F.lit(None).cast("double")), F.lit(float(value)))


def nan_to_null(score) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return F.nanvl(score, F.lit(None).cast("double"))


def loss(r2) -> Column:
    return 1 - (F.col(r2) if isinstance(r2, str) else r2)


def quantise_param(value, volume: float) -> Column:
    """Effective number of rows or columns behind a fraction."""
    return F.bround((F.col(value) if isinstance(value, str) else value) * volume)


def format_label(experiment="experiment", run="run") -> Column:
    return F.concat_ws(" ", F.col(experiment), F.col(run).cast("bigint").cast("string"), F.lit("run"))
