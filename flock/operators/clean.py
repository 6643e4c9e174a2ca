"""Numeric views, cleaning, recoding and model inputs.

Order and meaning of the steps follow the reference script (SURVEY S22-S27):
outlier value sets come from the *raw* columns and are tested against the
*mutated* columns; exclusion is by value, never by bounds, and
null values survive it.  ``mode="literal"`` keeps the reference's imputation
slip (days-to-activate and transaction counts replaced by the age);
``mode="fixed"`` keeps each column's own value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import recode_exact, recode_first_match
from ..session import materialize
from .profile import exclude_sets, gather, hist_columns, keep_numeric, outlier_values

# Fixed values (reference): code -> label replacements, applied in this order.
MARITAL_RECODE = [("143", "Married"), ("144", "Single"), ("675", "Unknown"), ("1792", "Unknown"),
                  ("1886", "Unknown"), ("676", "Unknown"), ("3471", "Unknown"), ("2198", "Unknown")]
MARITAL_RECODE_V1 = MARITAL_RECODE[:7]
GENDER_RECODE = [("0", "Unknown"), ("1", "Male"), ("2", "Female")]
LABEL_RECODE = [("1", "LeaveTheChurch"), ("0", "StayAtChurch")]

# Columns of the person table that the reference holds as factors (not numeric).
FACTOR_COLUMNS = {"person_type", "gender", "marital_status_value_id", "age_classification",
                  "is_imported", "month_first_attendance", "month_last_attendance"}
DATE_COLUMNS = ["activation_date", "person_created_date", "first_attendance_date", "last_attendance",
                "first_attendance", "first_gift", "last_gift"]
NEXT_STEP_DROPPED = ["baptism", "commit_to_christ", "im_new", "prayer_request", "renew_commit_to_christ",
                     "three_month_tithe_challenge"]

# The outlier sets the script computes, column by column (S23: the four
# overwrites of one name all hold the months-between-check-ins set).
OUTLIER_COLUMNS = ["age", "people_in_family", "time_to_activate", "days_to_first_attendance",
                   "months_between_first_and_last_attendance", "total_check_ins"]
LABEL = "two_months_without_activity"


def recode(df: DataFrame, col: str, mapping, mode: str = "first_match") -> DataFrame:
    """L4: code -> label.  ``first_match`` replaces the first occurrence inside
    the text, step by step in the given order (``str_replace``, S26);
    ``exact`` maps whole values."""
    if mode == "exact":
        return df.withColumn(col, recode_exact(F.col(col), dict(mapping)))
    expr = F.col(col).cast("string")
    for pat, rep in mapping:
        expr = recode_first_match(expr, pat, rep)
    return df.withColumn(col, expr)


def raw_outliers(people: DataFrame, cols=OUTLIER_COLUMNS, coef: float = 1.5) -> DataFrame:
    """(key, value) outlier sets of the raw columns, all columns in one pass."""
    return outlier_values(gather(people, list(cols)), coef, few_keys=True)


def numeric_distributions(people: DataFrame, bins: int = 30) -> DataFrame:
    """L2: drop ids / next steps / days-to-first, age NA -> 0, numeric columns
    only, days-to-activate > 0, raw-outlier exclusion, gather, 30 bins per key."""
    out = raw_outliers(people)
    df = people.drop("id", *NEXT_STEP_DROPPED, "days_to_first_attendance").withColumn(
        "age", F.coalesce(F.col("age"), F.lit(0)))
    df = keep_numeric(df, exclude=FACTOR_COLUMNS).where(F.col("time_to_activate") > 0)
    df = exclude_sets(df, out, ["age", "people_in_family", "time_to_activate",
                                "months_between_first_and_last_attendance", "total_check_ins"])
    df = materialize(df)  # read twice: ranges, then bins
    return hist_columns(df, df.columns, bins)


def clean_people(people: DataFrame, mode: str = "literal", keep_serving: bool = False) -> DataFrame:
    """L3: the cleaned person table of the v2 script (``id`` kept as the row
    key for splitting; it is never a feature)."""
    out = raw_outliers(people)
    df = people.drop(*NEXT_STEP_DROPPED, *DATE_COLUMNS, "month_first_attendance",
                     "month_last_attendance", "person_type")
    age = F.coalesce(F.col("age"), F.lit(0))
    df = df.withColumn("age", age)
    if mode == "literal":      # S24: present values replaced by the age
        tta = F.when(F.col("time_to_activate").isNull(), 10000).otherwise(F.col("age"))
        ntx = F.when(F.col("number_of_transactions").isNull(), 0).otherwise(F.col("age"))
    elif mode == "fixed":
        tta = F.coalesce(F.col("time_to_activate"), F.lit(10000))
        ntx = F.coalesce(F.col("number_of_transactions"), F.lit(0))
    else:
        raise ValueError(f"mode must be 'literal' or 'fixed', not {mode!r}")
    df = df.withColumn("time_to_activate", tta.cast("int")).withColumn("number_of_transactions", ntx.cast("long"))
    df = exclude_sets(df, out, ["age", "people_in_family", "time_to_activate", "total_check_ins",
                                "months_between_first_and_last_attendance", "days_to_first_attendance"])
    df = recode(df, LABEL, LABEL_RECODE)
    df = recode(df, "marital_status_value_id", MARITAL_RECODE)
    serving = F.when(F.coalesce(F.col("serving_groups"), F.lit(0)) > 0, 1).otherwise(0)
    df = df.withColumn("is_serving", serving) if keep_serving else df
    df = df.drop("serving_groups")  # S25: made 0/1 and dropped at once
    return recode(df, "gender", GENDER_RECODE)


def clean_people_v1(people: DataFrame) -> DataFrame:
    """The first notebook's cleaning: keeps days-to-activate > 0 only, no
    imputation of it, four outlier sets, seven marital codes."""
    out = raw_outliers(people)
    df = people.drop(*NEXT_STEP_DROPPED, *DATE_COLUMNS, "month_first_attendance", "month_last_attendance")
    df = df.withColumn("age", F.coalesce(F.col("age"), F.lit(0))).where(F.col("time_to_activate") > 0)
    df = exclude_sets(df, out, ["age", "people_in_family", "time_to_activate",
                                "months_between_first_and_last_attendance"])
    df = recode(df, LABEL, LABEL_RECODE)
    return recode(df, "marital_status_value_id", MARITAL_RECODE_V1)


def model2_dataset(clean: DataFrame, gender: str = "null") -> DataFrame:
    """Adults and children only, numeric codes, label 1 = stays.

    Factor columns become R level indexes (1-based, alphabetical over the
    levels present in ``clean``); ``gender="null"`` reproduces ``as.numeric``
    of the recoded text (all missing, S27), ``gender="code"`` maps the labels
    back to 0/1/2."""
    df = clean.drop("marital_status_value_id")
    age_levels = _levels(clean, "age_classification")
    imp_levels = _levels(clean, "is_imported")
    df = df.where(F.col("age_classification").isin(1, 2))
    df = df.join(age_levels, "age_classification").drop("age_classification") \
        .withColumnRenamed("_level", "age_classification")
    df = df.join(imp_levels, "is_imported").drop("is_imported").withColumnRenamed("_level", "is_imported")
    if gender == "null":
        g = F.lit(None).cast("double")
    else:
        g = recode_exact(F.col("gender"), {v: k for k, v in GENDER_RECODE}).try_cast("double")
    label = F.when(F.col(LABEL) == "StayAtChurch", 1.0).otherwise(0.0)
    return df.withColumn("gender", g).withColumn(LABEL, label)


def model2_dataset_v1(clean: DataFrame, person_type: int = 1) -> DataFrame:
    """L10 of the first notebook: people of ``person_type``, adults and children, label 1 = stays.

    ``clean``: the result of ``clean_people_v1``.  Gender, age class and the import flag become level indexes
    (1-based, alphabetical over the levels of ``clean``, taken before any row is left out); a null stays null."""
    df = clean.where((F.col("person_type") == person_type) & F.col("age_classification").isin(1, 2))
    df = df.drop("person_type", "marital_status_value_id")
    for col in ("gender", "age_classification", "is_imported"):
        df = df.join(_levels(clean, col), col, "left").drop(col).withColumnRenamed("_level", col)
    return df.withColumn(LABEL, F.when(F.col(LABEL) == "StayAtChurch", 1.0).otherwise(0.0))


def _levels(df: DataFrame, col: str) -> DataFrame:
    """Level index of a factor (1-based, alphabetical).  The level table has one
    row per distinct value; it is joined back by value."""
    from pyspark.sql import Window
    lv = df.select(col).where(F.col(col).isNotNull()).distinct()
    return lv.select(col, F.row_number().over(Window.orderBy(F.col(col).cast("string")))
                     .cast("double").alias("_level"))


def simplify_people(people: DataFrame, keep_id: bool = False) -> DataFrame:
    """Clustering input: ids and dates dropped, age NA -> 0,
    days-to-activate NA -> 1000 (numeric columns only, S34).  ``keep_id``
    carries the row key along (never used as a feature)."""
    df = people.drop(*DATE_COLUMNS) if keep_id else people.drop("id", *DATE_COLUMNS)
    df = df.withColumn("age", F.coalesce(F.col("age"), F.lit(0))).withColumn(
        "time_to_activate", F.coalesce(F.col("time_to_activate"), F.lit(1000)))
    return keep_numeric(df)


def null_sentinel(df: DataFrame, sentinel: str = "NULL") -> DataFrame:
    """A2: the text sentinel becomes a real null in every string column."""
    from pyspark.sql.types import StringType
    return df.select(*[F.when(F.col(f.name) == sentinel, F.lit(None)).otherwise(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema.fields])
