"""Registered queries: profiling, cleaning, recoding, splitting, reports
(D12, D16-D22, L1-L5, L8, L10, L20 check, L21, L24, B15, A2, A10/F3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import r_integer, r_numeric
from ..operators import clean as cl
from ..operators import profile as pr
from ..operators.people import FEATURE_COLUMNS
from ..operators.report import classification_report, confusion_counts
from ..operators.sampling import stratified_split
from ..session import materialize
from ..sources.fixtures import table
from . import sqltext as q
from .q_metrics import FEATURES_SQL, _people, _retention
from .q_people import RETENTION_SQL
from .registry import register

# R-numeric columns left after the L2 drops (people order); factors excluded.
L2_COLUMNS = ["total_check_ins", "time_to_activate", "months_between_first_and_last_attendance", "age",
              "people_in_family", "number_of_transactions", "months_between_first_and_last_giving",
              "serving_groups", "serving_interest", "highest_streak", "lco_percentage",
              "two_months_without_activity"]
# Every numeric column of the person table, with and without the row key.
NUMERIC_COLUMNS = [c for c in FEATURE_COLUMNS if c not in cl.DATE_COLUMNS]
SIMPLE_COLUMNS = [c for c in NUMERIC_COLUMNS if c != "id"]
LEVEL_COLUMNS = ["person_type", "gender", "marital_status_value_id", "age_classification", "is_imported",
                 "month_first_attendance", "month_last_attendance"]


# ---- SQL builders (oracle side) -------------------------------------------------

def gather_sql(src: str, cols, value_expr=lambda c: c) -> str:
    return "\n  UNION ALL ".join(
        f"SELECT '{c}' AS key, CAST({value_expr(c)} AS DOUBLE) AS value FROM {src}" for c in cols)


def fivenum_sql(long: str) -> str:
    d4 = "floor((n + 3) / 2.0) / 2.0"
    return f"""
fr AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY value) AS rn,
              count(*) OVER (PARTITION BY key) AS n FROM {long} WHERE value IS NOT NULL),
fn AS (SELECT key, min(value) AS min,
              avg(CASE WHEN rn IN (floor({d4}), ceil({d4})) THEN value END) AS lower_hinge,
              avg(CASE WHEN rn IN (floor((n + 1) / 2.0), ceil((n + 1) / 2.0)) THEN value END) AS median,
              avg(CASE WHEN rn IN (n + 1 - ceil({d4}), n + 1 - floor({d4})) THEN value END) AS upper_hinge,
              max(value) AS max, max(n) AS n
       FROM fr GROUP BY key)"""


def outliers_sql(long: str) -> str:
    return fivenum_sql(long) + f""",
outl AS (SELECT DISTINCT r.key, r.value FROM {long} r JOIN fn ON fn.key = r.key
         WHERE r.value < fn.lower_hinge - 1.5 * (fn.upper_hinge - fn.lower_hinge)
            OR r.value > fn.upper_hinge + 1.5 * (fn.upper_hinge - fn.lower_hinge))"""


def not_outlier(col: str, expr: str | None = None) -> str:
    return (f"NOT EXISTS (SELECT 1 FROM outl o WHERE o.key = '{col}' "
            f"AND o.value = CAST({expr or col} AS DOUBLE))")


def first_match_sql(expr: str, mapping) -> str:
    for pat, rep in mapping:
        expr = f"regexp_replace({expr}, '{pat}', '{rep}')"
    return expr


RAW_SQL = f"raw AS ({gather_sql('features', cl.OUTLIER_COLUMNS)})"
OUTLIER_SQL = f"{FEATURES_SQL},\n{RAW_SQL},\n{outliers_sql('raw').strip()}"

CLEAN_SELECT = {
    "literal": ("CAST(CASE WHEN time_to_activate IS NULL THEN 10000 ELSE coalesce(age, 0) END AS INTEGER)",
                "CAST(CASE WHEN number_of_transactions IS NULL THEN 0 ELSE coalesce(age, 0) END AS BIGINT)"),
    "fixed": ("CAST(coalesce(time_to_activate, 10000) AS INTEGER)",
              "CAST(coalesce(number_of_transactions, 0) AS BIGINT)"),
}


def clean_sql(mode: str, keep_serving: bool = False) -> str:
    tta, ntx = CLEAN_SELECT[mode]
    serving = (",\n         CASE WHEN coalesce(serving_groups, 0) > 0 THEN 1 ELSE 0 END AS is_serving"
               if keep_serving else "")
    cols = ["total_check_ins", "time_to_activate", "age", "people_in_family",
            "months_between_first_and_last_attendance", "days_to_first_attendance"]
    return f"""
c1 AS (SELECT id, total_check_ins, {tta} AS time_to_activate, is_imported, days_to_first_attendance,
              months_between_first_and_last_attendance, gender, coalesce(age, 0) AS age,
              marital_status_value_id, age_classification, people_in_family, {ntx} AS number_of_transactions,
              months_between_first_and_last_giving, serving_groups, serving_interest, highest_streak,
              lco_percentage, two_months_without_activity
       FROM features),
c2 AS (SELECT * FROM c1 WHERE {' AND '.join(not_outlier(c) for c in cols)}),
clean AS (
  SELECT id, total_check_ins, time_to_activate, is_imported, days_to_first_attendance,
         months_between_first_and_last_attendance,
         {first_match_sql('CAST(gender AS VARCHAR)', cl.GENDER_RECODE)} AS gender, age,
         {first_match_sql('CAST(marital_status_value_id AS VARCHAR)', cl.MARITAL_RECODE)}
           AS marital_status_value_id,
         age_classification, people_in_family, number_of_transactions, months_between_first_and_last_giving,
         serving_interest, highest_streak, lco_percentage,
         {first_match_sql('CAST(two_months_without_activity AS VARCHAR)', cl.LABEL_RECODE)}
           AS two_months_without_activity{serving}
  FROM c2)"""


CLEAN_LITERAL_SQL = f"{OUTLIER_SQL},\n{clean_sql('literal').strip()}"


def _people_shared(spark, sf_dir):
    """The person table checkpointed once for pipelines that read it more than
    once (outlier sets + the filtered rows): cuts the 15-join lineage."""
    return materialize(_people(spark, sf_dir))


def _clean(spark, sf_dir, mode="literal", keep_serving=False, shared=False):
    c = cl.clean_people(_people_shared(spark, sf_dir), mode, keep_serving)
    return materialize(c) if shared else c


# ---- gather, histograms, hinges, outliers -------------------------------------------

@register("keep_numeric_long", sql=q.with_adapter(FEATURES_SQL, select=f"""
SELECT key, value FROM (
  {gather_sql('features', ['id'] + L2_COLUMNS)}) g"""))
def keep_numeric_long(spark, sf_dir):
    """Numeric (non-factor) columns gathered to (key, value), nulls kept."""
    people = _people(spark, sf_dir)
    num = pr.keep_numeric(people, exclude=cl.FACTOR_COLUMNS | {"days_to_first_attendance"}
                          | set(cl.NEXT_STEP_DROPPED))
    return pr.gather(num)


@register("fivenum", sql=q.with_adapter(OUTLIER_SQL, select="SELECT * FROM fn"))
def fivenum(spark, sf_dir):
    """Tukey five numbers of the outlier-tested columns."""
    return pr.fivenum(pr.gather(_people(spark, sf_dir), cl.OUTLIER_COLUMNS), few_keys=True)


@register("outlier_values", sql=q.with_adapter(OUTLIER_SQL, select="SELECT * FROM outl"))
def outlier_values(spark, sf_dir):
    """L1: boxplot outlier value sets (coef 1.5) per column."""
    return cl.raw_outliers(_people(spark, sf_dir))


@register("exclude_outliers", sql=q.with_adapter(OUTLIER_SQL, select=f"""
SELECT id, {', '.join(cl.OUTLIER_COLUMNS)} FROM features
WHERE {' AND '.join(not_outlier(c) for c in cl.OUTLIER_COLUMNS)}"""))
def exclude_outliers(spark, sf_dir):
    """Null-keeping value-set exclusion of every outlier column."""
    people = _people_shared(spark, sf_dir)
    return pr.exclude_sets(people.select("id", *cl.OUTLIER_COLUMNS), cl.raw_outliers(people), cl.OUTLIER_COLUMNS)


L2_FILTERED = f"""
l2 AS (SELECT {', '.join('coalesce(age, 0) AS age' if c == 'age' else c for c in L2_COLUMNS)}
       FROM features
       WHERE time_to_activate > 0 AND {not_outlier('age', 'coalesce(age, 0)')}
         AND {not_outlier('people_in_family')} AND {not_outlier('time_to_activate')}
         AND {not_outlier('months_between_first_and_last_attendance')} AND {not_outlier('total_check_ins')}),
g2 AS ({gather_sql('l2', L2_COLUMNS)}),
w2 AS (SELECT key, value,
              (max(value) OVER (PARTITION BY key) - min(value) OVER (PARTITION BY key)) / 29 AS w
       FROM g2 WHERE value IS NOT NULL)"""


@register("hist30_by_key", sql=q.with_adapter(OUTLIER_SQL, L2_FILTERED, select="""
SELECT key, CASE WHEN w > 0 THEN CAST(ceil((value - w / 2) / w) AS BIGINT) * w ELSE value END AS bin, count(*) AS count
FROM w2 GROUP BY 1, 2"""))
def hist30_by_key(spark, sf_dir):
    """Numeric distributions after cleaning, 30 bins per column."""
    return cl.numeric_distributions(_people_shared(spark, sf_dir))


# ---- profile ------------------------------------------------------------------------

@register("profile_numeric", sql=q.with_adapter(FEATURES_SQL, f"pl AS ({gather_sql('features', NUMERIC_COLUMNS)})",
                                                select="""
SELECT key, min(value) AS min, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
       round(avg(value), 9) AS mean, quantile_cont(value, 0.75) AS q3, max(value) AS max,
       CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls
FROM pl GROUP BY key"""))
def profile_numeric(spark, sf_dir):
    """summary() of all numeric columns: min, quartiles, median, mean, max, NA
    count.  The mean is rounded to 9 decimals: its last bits follow the order of the sum."""
    p = pr.profile_numeric(_people(spark, sf_dir))
    return p.withColumn("mean", F.round("mean", 9))


PROFILE_DATES_SQL = "\n  UNION ALL ".join(
    f"SELECT '{c}' AS key, epoch(CAST({c} AS TIMESTAMP)) AS s FROM features" for c in cl.DATE_COLUMNS)


@register("profile_dates", sql=q.with_adapter(FEATURES_SQL, f"pd AS ({PROFILE_DATES_SQL})", select="SELECT key, " + ", ".join(
    f"make_timestamp(CAST(floor({e}) AS BIGINT) * 1000000) AS {name}" for name, e in (
        ("min", "min(s)"), ("q1", "quantile_cont(s, 0.25)"), ("median", "quantile_cont(s, 0.5)"), ("mean", "avg(s)"),
        ("q3", "quantile_cont(s, 0.75)"), ("max", "max(s)"))) + """,
       CAST(sum(CASE WHEN s IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls
FROM pd GROUP BY key"""))
def profile_dates(spark, sf_dir):
    """summary() of the date columns."""
    return pr.profile_dates(_people(spark, sf_dir))


@register("profile_levels", sql=q.with_adapter(FEATURES_SQL, select="\nUNION ALL ".join(
    f"SELECT '{c}' AS key, CAST({c} AS VARCHAR) AS level, count(*) AS count FROM features GROUP BY 2"
    for c in LEVEL_COLUMNS)))
def profile_levels(spark, sf_dir):
    """Level counts of the factor columns."""
    return pr.profile_levels(_people(spark, sf_dir), LEVEL_COLUMNS)


MISSING_PATTERN_SQL = (
    "SELECT " + " || ".join(f"(CASE WHEN {c} IS NULL THEN '0' ELSE '1' END)" for c in FEATURE_COLUMNS)
    + " AS pattern,\n       CAST(" + " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in FEATURE_COLUMNS)
    + " AS INTEGER) AS missing_vars, count(*) AS rows\nFROM features GROUP BY 1, 2")


@register("missing_patterns", sql=q.with_adapter(FEATURES_SQL, select=MISSING_PATTERN_SQL))
def missing_patterns(spark, sf_dir):
    """Md.pattern of the person table."""
    return pr.missing_patterns(_people(spark, sf_dir))


# ---- recode, clean, model input -------------------------------------------------------

@register("recode_first", sql=q.with_adapter(FEATURES_SQL, select=f"""
SELECT id, {first_match_sql('CAST(marital_status_value_id AS VARCHAR)', cl.MARITAL_RECODE)}
  AS marital_status_value_id FROM features"""))
def recode_first(spark, sf_dir):
    """First-match sequential recode (str_replace)."""
    return cl.recode(_people(spark, sf_dir).select("id", "marital_status_value_id"),
                     "marital_status_value_id", cl.MARITAL_RECODE)


@register("recode_exact", sql=q.with_adapter(FEATURES_SQL, select="""
SELECT id, CASE CAST(marital_status_value_id AS VARCHAR) """ + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in cl.MARITAL_RECODE) + """
  ELSE CAST(marital_status_value_id AS VARCHAR) END AS marital_status_value_id FROM features"""))
def recode_exact(spark, sf_dir):
    """L4 exact mode: whole-value lookup."""
    return cl.recode(_people(spark, sf_dir).select("id", "marital_status_value_id"),
                     "marital_status_value_id", cl.MARITAL_RECODE, mode="exact")


@register("clean_people_literal", sql=q.with_adapter(CLEAN_LITERAL_SQL, select="SELECT * FROM clean"))
def clean_people_literal(spark, sf_dir):
    """L3: cleaned person table, the script's literal steps."""
    return _clean(spark, sf_dir)


@register("clean_people_fixed", sql=q.with_adapter(OUTLIER_SQL, clean_sql("fixed", keep_serving=True),
                                                   select="SELECT * FROM clean"))
def clean_people_fixed(spark, sf_dir):
    """L3 mode fixed: own values imputed, serving flag kept."""
    return _clean(spark, sf_dir, "fixed", keep_serving=True)


CLEAN_V1_SQL = f"""
SELECT id, person_type, total_check_ins, time_to_activate, is_imported, days_to_first_attendance,
       months_between_first_and_last_attendance, gender, coalesce(age, 0) AS age,
       {first_match_sql('CAST(marital_status_value_id AS VARCHAR)', cl.MARITAL_RECODE_V1)}
         AS marital_status_value_id,
       age_classification, people_in_family, number_of_transactions, months_between_first_and_last_giving,
       serving_groups, serving_interest, highest_streak, lco_percentage,
       {first_match_sql('CAST(two_months_without_activity AS VARCHAR)', cl.LABEL_RECODE)}
         AS two_months_without_activity
FROM features
WHERE time_to_activate > 0 AND {not_outlier('age', 'coalesce(age, 0)')} AND {not_outlier('people_in_family')}
  AND {not_outlier('time_to_activate')} AND {not_outlier('months_between_first_and_last_attendance')}"""


@register("clean_people_v1", sql=q.with_adapter(OUTLIER_SQL, select=CLEAN_V1_SQL))
def clean_people_v1(spark, sf_dir):
    """The first notebook's cleaning."""
    return cl.clean_people_v1(_people_shared(spark, sf_dir))


@register("model2_dataset_v1", sql=q.with_adapter(OUTLIER_SQL, f"clean AS ({CLEAN_V1_SQL})", select="""
SELECT c.* EXCLUDE (person_type, marital_status_value_id)
       REPLACE (g.lvl AS gender, a.lvl AS age_classification, m.lvl AS is_imported,
                CASE WHEN two_months_without_activity = 'StayAtChurch' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS two_months_without_activity)
FROM clean c""" + "".join(f"""
LEFT JOIN (SELECT {col} AS v, CAST(dense_rank() OVER (ORDER BY CAST({col} AS VARCHAR)) AS DOUBLE) AS lvl
           FROM clean WHERE {col} IS NOT NULL GROUP BY {col}) {t} ON {t}.v = c.{col}"""
    for t, col in (("g", "gender"), ("a", "age_classification"), ("m", "is_imported"))) + """
WHERE person_type = 1 AND c.age_classification IN (1, 2)"""))
def model2_dataset_v1(spark, sf_dir):
    """L10 of the first notebook: one person type, gender as level index."""
    return cl.model2_dataset_v1(materialize(cl.clean_people_v1(_people_shared(spark, sf_dir))))


MODEL2_SQL = """
lv_age AS (SELECT age_classification,
                  CAST(row_number() OVER (ORDER BY CAST(age_classification AS VARCHAR)) AS DOUBLE) AS lvl
           FROM (SELECT DISTINCT age_classification FROM clean WHERE age_classification IS NOT NULL) x),
lv_imp AS (SELECT is_imported, CAST(row_number() OVER (ORDER BY CAST(is_imported AS VARCHAR)) AS DOUBLE) AS lvl
           FROM (SELECT DISTINCT is_imported FROM clean WHERE is_imported IS NOT NULL) x),
model2 AS (
  SELECT c.id, c.total_check_ins, c.time_to_activate, li.lvl AS is_imported, c.days_to_first_attendance,
         c.months_between_first_and_last_attendance, CAST(NULL AS DOUBLE) AS gender, c.age,
         la.lvl AS age_classification, c.people_in_family, c.number_of_transactions,
         c.months_between_first_and_last_giving, c.serving_interest, c.highest_streak, c.lco_percentage,
         CAST(CASE WHEN c.two_months_without_activity = 'StayAtChurch' THEN 1 ELSE 0 END AS DOUBLE)
           AS two_months_without_activity
  FROM clean c JOIN lv_age la ON la.age_classification = c.age_classification
       JOIN lv_imp li ON li.is_imported = c.is_imported
  WHERE c.age_classification IN (1, 2))"""


@register("model2_dataset", sql=q.with_adapter(CLEAN_LITERAL_SQL, MODEL2_SQL, select="SELECT * FROM model2"))
def model2_dataset(spark, sf_dir):
    """Boosted-tree input (adults/children, level codes, label 1 = stays)."""
    return cl.model2_dataset(_clean(spark, sf_dir, shared=True))


@register("simplify_people", sql=q.with_adapter(FEATURES_SQL, select="""
SELECT * EXCLUDE (id, activation_date, person_created_date, first_attendance_date, last_attendance,
                  first_attendance, first_gift, last_gift)
         REPLACE (coalesce(age, 0) AS age, coalesce(time_to_activate, 1000) AS time_to_activate)
FROM features"""))
def simplify_people(spark, sf_dir):
    """Clustering input (dates dropped, NA imputed)."""
    return cl.simplify_people(_people(spark, sf_dir))


# ---- split and reports --------------------------------------------------------------

@register("stratified_split", sql=q.with_adapter(CLEAN_LITERAL_SQL, select="""
SELECT id, two_months_without_activity,
       CASE WHEN row_number() OVER (PARTITION BY two_months_without_activity
                                    ORDER BY md5(concat('987:', CAST(id AS VARCHAR))), id)
                 <= floor(0.8 * count(*) OVER (PARTITION BY two_months_without_activity))
            THEN 'train' ELSE 'test' END AS split
FROM clean"""))
def stratified_split_q(spark, sf_dir):
    """Exact 80/20 split per label, seed 987."""
    c = _clean(spark, sf_dir, shared=True).select("id", cl.LABEL)
    return stratified_split(c, cl.LABEL, 0.8, 987)


LABELS_CM = "SELECT quality AS actual, toxic AS predicted FROM labels"


@register("confusion_counts", sql=f"""
SELECT actual, predicted, count(*) AS n FROM ({LABELS_CM}) t GROUP BY 1, 2""")
def confusion_counts_q(spark, sf_dir):
    """Two-way count of (actual, predicted) over the labels table."""
    return confusion_counts(table(spark, sf_dir, "labels"), "quality", "toxic")


@register("classification_report", sql=f"""
WITH c AS (
  SELECT CAST(sum(CASE WHEN actual = 0 AND predicted = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
         CAST(sum(CASE WHEN actual <> 0 AND predicted = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
         CAST(sum(CASE WHEN actual = 0 AND predicted <> 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
         CAST(sum(CASE WHEN actual <> 0 AND predicted <> 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn
  FROM ({LABELS_CM}) t),
d AS (SELECT *, tp + fp + fn + tn AS n FROM c),
e AS (SELECT *, (tp + tn) / NULLIF(n, 0) AS acc,
             ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / NULLIF(n * n, 0) AS pe,
             tp / NULLIF(tp + fn, 0) AS sens, tn / NULLIF(tn + fp, 0) AS spec FROM d)
SELECT CAST(n AS BIGINT) AS n, acc AS accuracy, (acc - pe) / NULLIF(1 - pe, 0) AS kappa, sens AS sensitivity,
       spec AS specificity, tp / NULLIF(tp + fp, 0) AS ppv, tn / NULLIF(tn + fn, 0) AS npv,
       (tp + fn) / NULLIF(n, 0) AS prevalence, tp / NULLIF(n, 0) AS detection_rate,
       (tp + fp) / NULLIF(n, 0) AS detection_prevalence, (sens + spec) / 2 AS balanced_accuracy,
       greatest(tp + fn, fp + tn) / NULLIF(n, 0) AS no_information_rate
FROM e""")
def classification_report_q(spark, sf_dir):
    """Confusion-matrix statistics (positive class = first level, 0)."""
    return classification_report(table(spark, sf_dir, "labels"), "quality", "toxic", positive=0)


@register("correlation_matrix", sql=q.with_adapter(FEATURES_SQL, f"""
s AS (SELECT * REPLACE (coalesce(age, 0) AS age, coalesce(time_to_activate, 1000) AS time_to_activate)
      FROM features),
f AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in SIMPLE_COLUMNS)} FROM s),
w AS (SELECT """ + ",\n".join(
    f"round(covar_samp({a}, {b}) / NULLIF(stddev_samp({a}) * stddev_samp({b}), 0), 9) AS \"{a}|{b}\""
    for i, a in enumerate(SIMPLE_COLUMNS) for b in SIMPLE_COLUMNS[i + 1:]) + """ FROM f),
lg AS (SELECT pair, corr FROM w UNPIVOT INCLUDE NULLS (corr FOR pair IN (COLUMNS(*))))""", select="""
SELECT split_part(pair, '|', 1) AS col_a, split_part(pair, '|', 2) AS col_b, corr FROM lg"""))
def correlation_matrix(spark, sf_dir):
    """L20 check: pairwise correlations of all numeric columns (null beside a
    constant one), rounded to 9 decimals as the last bits follow the order of the sums."""
    s = cl.simplify_people(_people(spark, sf_dir))
    return pr.correlation_matrix(s, SIMPLE_COLUMNS).withColumn("corr", F.round("corr", 9))


KDE_SQL = """
v AS (SELECT 'retention_days' AS key, CAST(retention_days AS DOUBLE) AS value FROM retention
      WHERE retention_days < 60),
st AS (SELECT key, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd, count(*) AS n,
              quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY key),
p AS (SELECT key, lo, hi, n,
             0.9 * (CASE WHEN least(sd, (q3 - q1) / 1.34) > 0 THEN least(sd, (q3 - q1) / 1.34)
                         WHEN sd > 0 THEN sd ELSE 1.0 END) * pow(n, -0.2) AS bw FROM st),
c AS (SELECT key, value, count(*) AS cnt FROM v GROUP BY 1, 2),
g AS (SELECT p.*, CAST(i AS INTEGER) AS i, lo + (hi - lo) * i / 511 AS x FROM p, range(0, 512) t(i))"""


@register("kde", sql=q.with_adapter(RETENTION_SQL, KDE_SQL, select="""
SELECT g.key, g.i, g.x,
       round(sum(c.cnt * exp(-0.5 * ((g.x - c.value) / g.bw) * ((g.x - c.value) / g.bw)))
             / 2.5066282746310002 / (g.n * g.bw), 9) AS density
FROM g JOIN c ON c.key = g.key GROUP BY g.key, g.i, g.x, g.n, g.bw"""))
def kde(spark, sf_dir):
    """Gaussian KDE (512 points, nrd0 bandwidth) of days to return < 60."""
    r = _retention(spark, sf_dir).where(F.col("retention_days") < 60)
    d = pr.kde(pr.gather(r, ["retention_days"]))
    return d.withColumn("density", F.round("density", 9))


@register("kde_binned", sql=q.with_adapter(RETENTION_SQL, KDE_SQL + """,
b AS (SELECT p.*, value, coalesce((value - lo) / nullif((hi - lo) / 511, 0), 0) AS pos FROM v JOIN p USING (key)),
l AS (SELECT key, pos, least(floor(pos), 510) AS j FROM b),
w AS (SELECT key, j, sum(w) AS w FROM (SELECT key, j, 1 - (pos - j) AS w FROM l UNION ALL SELECT key, j + 1, pos - j FROM l) GROUP BY key, j)""", select="""
SELECT g.key, g.i, round(g.x, 9) AS x,
       round(coalesce(sum(w.w * exp(-0.5 * pow((g.i - w.j) * (hi - lo) / 511 / g.bw, 2))
                          ) FILTER (abs(g.i - w.j) <= least(ceil(coalesce(8 * g.bw / nullif((hi - lo) / 511, 0), 512)), 512)), 0)
             / 2.5066282746310002 / (g.n * g.bw), 9) AS density
FROM g JOIN w ON w.key = g.key GROUP BY g.key, g.i, g.x, g.n, g.bw"""))
def kde_binned(spark, sf_dir):
    """The same density by linear binning on the grid."""
    r = _retention(spark, sf_dir).where(F.col("retention_days") < 60)
    d = pr.kde_binned(pr.gather(r, ["retention_days"]))
    return d.withColumn("density", F.round("density", 9)).withColumn("x", F.round("x", 9))


NUMBER_TEXTS = {"plain": "CAST(c_acctbal AS STRING)", "signed": "concat('-', substr(c_name, 10), '.75')", "blanks": "concat('  ', substr(c_name, 10), ' ')",
                "exponent": "concat(substr(c_name, 10), 'e4')", "letter": "concat(substr(c_name, 10), 'f')", "words": "c_mktsegment", "missing": "CAST(NULL AS STRING)"}


@register("text_numbers", sql="WITH t AS (" + "\nUNION ALL ".join(
    f"SELECT c_custkey, '{k}' AS key, {e} AS text FROM customer" for k, e in NUMBER_TEXTS.items()) + r"""),
n AS (SELECT c_custkey, key, CASE WHEN regexp_full_match(trim(text), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
      THEN TRY_CAST(trim(text) AS DOUBLE) END AS as_numeric FROM t)
SELECT c_custkey, key, as_numeric, TRY_CAST(trunc(as_numeric) AS INTEGER) AS as_integer FROM n""")
def text_numbers(spark, sf_dir):
    """Text as number and as integer, texts that are none of them as null."""
    pairs = ", ".join(f"'{k}', {e}" for k, e in NUMBER_TEXTS.items())
    t = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"stack({len(NUMBER_TEXTS)}, {pairs}) AS (key, text)")
    return t.select("c_custkey", "key", r_numeric("text").alias("as_numeric"), r_integer("text").alias("as_integer"))


@register("top_rows", sql=q.with_adapter(FEATURES_SQL, select="""
SELECT id, total_check_ins, first_attendance FROM features ORDER BY id LIMIT 6"""))
def top_rows(spark, sf_dir):
    """head(6) of the person table in id order (the limit is the feature)."""
    return _people(spark, sf_dir).select("id", "total_check_ins", "first_attendance").orderBy("id").limit(6)


@register("null_sentinel", sql="""
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS event_type,
       CASE WHEN props = 'error' THEN NULL ELSE props END AS props
FROM events""")
def null_sentinel_q(spark, sf_dir):
    """A2: a whole-table text sentinel read as null (here 'error' marks a missing type)."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return cl.null_sentinel(e, "error")


@register("null_totals", sql=q.with_adapter(FEATURES_SQL, select="\nUNION ALL ".join(
    f"SELECT '{c}' AS key, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls FROM features"
    for c in FEATURE_COLUMNS)))
def null_totals(spark, sf_dir):
    """D21 margin: missing values per column of the person table (one pass)."""
    return pr.null_totals(_people(spark, sf_dir))
