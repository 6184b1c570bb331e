"""Explicit schemas.  Readers never infer types."""

from __future__ import annotations

from pyspark.sql import types as T


def _double(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


TIMES = ["mean_fit_time", "std_fit_time", "mean_score_time", "std_score_time"]
_TAIL = [
    T.StructField("rank_test_score", T.LongType()),
    T.StructField("iter_num", T.LongType()),
    T.StructField("experiment_name", T.StringType()),
    T.StructField("run_number", T.LongType()),
]
_PARAMS = [T.StructField("params", T.StringType())]


def _splits(k: int) -> list[str]:
    return [f"split{i}_test_score" for i in range(k)]


# Header layouts of recorded trial logs, column order included (fixed values).
TRIAL_LAYOUTS = {
    "random_all": T.StructType(
        _double(*TIMES, "param_alpha", "param_colsample_bytree", "param_lambda", "param_max_depth", "param_min_child_weight", "param_subsample")
        + _PARAMS + _double(*_splits(5), "mean_test_score", "std_test_score") + [_TAIL[0], _TAIL[3], _TAIL[2]]
    ),
    "random_stage_1": T.StructType(
        _double(*TIMES, "param_max_depth", "param_min_child_weight") + _PARAMS
        + _double(*_splits(5), "mean_test_score", "std_test_score") + [_TAIL[0], _TAIL[2], _TAIL[3]]
    ),
    "random_stages_2_3": T.StructType(
        _double(*TIMES, "param_alpha", "param_lambda") + _PARAMS
        + _double(*_splits(5), "mean_test_score", "std_test_score") + _TAIL
        + _double("param_colsample_bytree", "param_subsample")
    ),
    "random_stage_3": T.StructType(
        _double(*TIMES, "param_colsample_bytree", "param_subsample") + _PARAMS
        + _double(*_splits(3), "mean_test_score", "std_test_score") + _TAIL
    ),
    "bayes_stage_3": T.StructType(
        _double(*_splits(3), "mean_test_score", "std_test_score")
        + [T.StructField("rank_test_score", T.LongType())]
        + _double(*TIMES, "param_colsample_bytree", "param_subsample") + _PARAMS + _TAIL[1:]
    ),
    "default": T.StructType(
        _double(*TIMES) + [T.StructField("param_max_depth", T.LongType())] + _PARAMS
        + _double(*_splits(5), "mean_test_score", "std_test_score")
        + [_TAIL[0], _TAIL[2]]
    ),
    "default_3_folds": T.StructType(
        _double(*TIMES) + [T.StructField("param_max_depth", T.LongType())] + _PARAMS
        + _double(*_splits(3), "mean_test_score", "std_test_score")
        + [_TAIL[0], _TAIL[2]]
    ),
}

SUMMARY = T.StructType([T.StructField("method", T.StringType())] + _double("mean", "std"))

STEP = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("iter", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("ts", T.TimestampType()),
])

METRIC = T.StructType([
    T.StructField("trial_id", T.LongType()),
    T.StructField("fold", T.IntegerType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("isTest", T.BooleanType()),
])

SPACE = T.StructType([
    T.StructField("param", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("lo", T.DoubleType()),
    T.StructField("hi", T.DoubleType()),
    T.StructField("values", T.ArrayType(T.DoubleType())),
    T.StructField("stage", T.IntegerType()),
])

IRIS = T.StructType(
    _double("sepal length", "sepal width", "petal length", "petal width")
    + [T.StructField("class", T.StringType())]
)

# Column names of the headerless comment-volume table (fixed values; the families are generated).
WEEKDAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
COMMENT_VOLUME_NAMES = (
    ["page_likes_num", "page_checkins", "page_talking_about", "page_cat", "page_statistics"]
    + [f"page_statistics_{i}" for i in range(1, 25)]
    + ["comments_num_before_base_time", "comments_num_in_last_24_hours",
       "comments_num_in_last_48_to_24_hours", "comments_num_in_first_24_hours",
       "comments_difference_in_last_two_days", "base_time", "character_num_in_post",
       "share_num", "post_promotion", "h_local"]
    + [f"post_published_weekday_{d}" for d in WEEKDAYS]
    + [f"base_datetime_weekday_{d}" for d in WEEKDAYS]
    + ["target"]
)
