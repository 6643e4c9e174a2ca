"""The person-level feature table and its parts.

Scale notes:
* check-ins and gifts are aggregated per alias *before* the join with the
  primary alias (alias -> person is one-to-one for primary aliases), so the
  join sees one row per alias instead of one per event; Catalyst does not push
  aggregates below joins by itself;
* family size is counted once per family group and then looked up, instead
  of joining every attending person with every member of the family (a family
  group holding a third of all members would otherwise fan out);
* the feature table stands on one layout (``person_activity``): check-ins, gifts
  and requests meet the alias map once and reach the person in one exchange, in
  which the streak windows and the final joins stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date, day_diff, lit_date, month_diff, week_start
from ..session import materialize
from .identity import primary_alias
from .streaks import attended_weeks, longest_runs, streaks

# Fixed values (reference): connection opportunity id -> output column, in the
# order of the reference's PIVOT list.
NEXT_STEP_COLUMNS = {
    4: "three_month_tithe_challenge",
    11: "commit_to_christ",
    13: "im_new",
    24: "prayer_request",
    25: "renew_commit_to_christ",
    26: "serving_interest",
    7: "baptism",
}
SERVING_PURPOSE = 184
SMALL_GROUP_PURPOSE = 157176
DEFAULT_MARITAL_STATUS = 675
CHURN_MONTHS = 2

FEATURE_COLUMNS = [
    "id", "person_type", "total_check_ins", "activation_date", "time_to_activate", "is_imported",
    "person_created_date", "first_attendance_date", "days_to_first_attendance", "month_first_attendance",
    "month_last_attendance", "last_attendance", "first_attendance", "months_between_first_and_last_attendance",
    "gender", "age", "marital_status_value_id", "age_classification", "people_in_family",
    "number_of_transactions", "first_gift", "last_gift", "months_between_first_and_last_giving",
    "serving_groups", *NEXT_STEP_COLUMNS.values(), "highest_streak", "lco_percentage",
    "two_months_without_activity",
]


def person_attendance(attendance: DataFrame, person_alias: DataFrame, person: DataFrame) -> DataFrame:
    """K6: first/last check-in and check-in count per person, primary alias only."""
    per_alias = attendance.where(F.col("did_attend") == 1).groupBy("person_alias_id").agg(
        F.min("start_ts").alias("first_attendance"),
        F.max("start_ts").alias("last_attendance"),
        F.count(F.lit(1)).alias("total_check_ins"))
    pa = primary_alias(person_alias, person)
    return pa.join(per_alias, pa.alias_id == per_alias.person_alias_id).select(
        F.col("person_id").alias("id"), "first_attendance", "last_attendance", "total_check_ins")


def _restrict(df: DataFrame, person_att: DataFrame | None, col: str) -> DataFrame:
    """Keep rows of attending people only (the reference's CTEs join the
    attendance table); ``None`` leaves the restriction to the caller's final
    left join, which saves one shuffle per part."""
    if person_att is None:
        return df
    return df.join(person_att.select(F.col("id").alias(col)), col, "left_semi")


def family_sizes(persons: DataFrame, group: DataFrame, group_member: DataFrame) -> DataFrame:
    """``(group_id, people_in_family)`` for the family groups that ``persons``
    (id, primary_family_id) point at: one distinct count per family group."""
    fam_groups = persons.select(F.col("primary_family_id").alias("group_id")).distinct().join(
        group.select(F.col("id").alias("group_id")), "group_id", "left_semi")
    return (group_member.join(fam_groups, "group_id", "left_semi")
            .groupBy("group_id").agg(F.count_distinct("person_id").alias("people_in_family")))


def family_size(person_att: DataFrame, person: DataFrame, group: DataFrame,
                group_member: DataFrame) -> DataFrame:
    """K8: distinct members of each attending person's primary family group."""
    fam = person_att.select("id").join(person.select("id", "primary_family_id"), "id")
    sizes = family_sizes(fam, group, group_member)
    return fam.join(sizes, fam.primary_family_id == sizes.group_id).select("id", "people_in_family")


def person_giving(gift: DataFrame, person_alias: DataFrame, person: DataFrame,
                  person_att: DataFrame | None) -> DataFrame:
    """K9: gift count, first and last gift via the primary alias (of attending
    people when ``person_att`` is given)."""
    per_alias = gift.groupBy("person_alias_id").agg(
        F.count("id").alias("number_of_transactions"),
        F.min("created_ts").alias("first_gift"),
        F.max("created_ts").alias("last_gift"))
    pa = _restrict(primary_alias(person_alias, person), person_att, "person_id")
    return pa.join(per_alias, pa.alias_id == per_alias.person_alias_id).select(
        F.col("person_id").alias("id"), "number_of_transactions", "first_gift", "last_gift")


def group_count(person_att: DataFrame | None, group_member: DataFrame, group: DataFrame,
                group_type: DataFrame, purpose: int, name: str) -> DataFrame:
    """Distinct groups of a purpose per (attending) person."""
    types = group_type.where(F.col("purpose_value_id") == purpose).select(F.col("id").alias("group_type_id"))
    gids = group.join(types, "group_type_id", "left_semi").select(F.col("id").alias("group_id"))
    members = _restrict(group_member.join(gids, "group_id", "left_semi"), person_att, "person_id")
    return members.groupBy(F.col("person_id").alias("id")).agg(F.count_distinct("group_id").alias(name))


def serving_groups(person_att, group_member, group, group_type, purpose=SERVING_PURPOSE):
    return group_count(person_att, group_member, group, group_type, purpose, "serving_groups")


def small_groups(person_att, group_member, group, group_type, purpose=SMALL_GROUP_PURPOSE):
    return group_count(person_att, group_member, group, group_type, purpose, "small_group_count")


def next_steps_long(connection_request: DataFrame, person_alias: DataFrame, person_att: DataFrame | None,
                    connection_opportunity: DataFrame, opportunities=tuple(NEXT_STEP_COLUMNS)) -> DataFrame:
    """K12 (long): request count per ((attending) person, opportunity).

    Requests are counted per (alias, opportunity) before the alias join and the
    per-alias counts summed per person."""
    opp = list(opportunities)
    valid = connection_opportunity.where(F.col("id").isin(opp)).select(F.col("id").alias("opportunity_id"))
    per_alias = (connection_request.where(F.col("opportunity_id").isin(opp))
                 .join(valid, "opportunity_id", "left_semi")
                 .groupBy("person_alias_id", "opportunity_id").agg(F.count("id").alias("n")))
    alias = person_alias.select(F.col("id").alias("person_alias_id"), F.col("person_id").alias("id"))
    return (_restrict(per_alias.join(alias, "person_alias_id"), person_att, "id")
            .groupBy("id", F.col("opportunity_id").alias("connection_opportunity"))
            .agg(F.sum("n").cast("long").alias("next_step_count")))


def next_steps(long: DataFrame, opportunities=tuple(NEXT_STEP_COLUMNS)) -> DataFrame:
    """PIVOT MAX over the fixed opportunity list -> ``opp_<id>`` columns."""
    opp = list(opportunities)
    wide = long.groupBy("id").pivot("connection_opportunity", opp).agg(F.max("next_step_count"))
    return wide.select("id", *[F.col(str(o)).alias(f"opp_{o}") for o in opp])


def activation_date(first_attendance, first_gift):
    """The earlier of both, null unless both exist (never ``least``
    alone: it skips nulls)."""
    both = first_attendance.isNotNull() & first_gift.isNotNull()
    return F.when(both, F.least(first_attendance, first_gift))


def activation(person: DataFrame, person_att: DataFrame, giving: DataFrame) -> DataFrame:
    """Activation per person (all people; null when one side is missing)."""
    j = person.select("id", "created_ts").join(person_att, "id", "left").join(giving, "id", "left")
    return j.select("id", "created_ts", "first_attendance", "first_gift",
                    activation_date(F.col("first_attendance"), F.col("first_gift")).alias("activation_date"))


def churn_flag(last_attendance, as_of, months: int = CHURN_MONTHS):
    """More than ``months`` month boundaries since the last check-in."""
    return F.when(month_diff(last_attendance, lit_date(as_of)) > months, 1).otherwise(0)


def churn_label(df: DataFrame, as_of, months: int = CHURN_MONTHS) -> DataFrame:
    return df.withColumn("two_months_without_activity", churn_flag(F.col("last_attendance"), as_of, months))


class PersonParts:
    """The shared intermediate tables of one feature build (built lazily).

    ``restrict=True`` gives each part exactly as the reference's CTE (attending
    people only).  The feature table uses ``restrict=False``: its final left
    join from the attendance table does that filtering, so each part skips a
    semi join and the attendance aggregate has a single reader.  ``shared=True``
    materializes the person-attendance table for callers that read it several
    times (the restricted parts each semi-join it)."""

    def __init__(self, d, restrict: bool = True, shared: bool = False):
        self.d = d
        self.restrict = restrict
        self.shared = shared
        self._cache = {}

    def _get(self, key, fn):
        if key not in self._cache:
            self._cache[key] = fn()
        return self._cache[key]

    @property
    def attendance(self):
        d = self.d

        def build():
            pa = person_attendance(d["attendance"], d["person_alias"], d["person"])
            if self.shared:
                pa = materialize(pa)
            return pa
        return self._get("pa", build)

    @property
    def _att(self):
        return self.attendance if self.restrict else None

    @property
    def giving(self):
        d = self.d
        return self._get("pg", lambda: person_giving(d["gift"], d["person_alias"], d["person"], self._att))

    @property
    def family(self):
        d = self.d
        return self._get("pf", lambda: family_size(self.attendance, d["person"], d["group"], d["group_member"]))

    @property
    def serving(self):
        d = self.d
        return self._get("sg", lambda: serving_groups(self._att, d["group_member"], d["group"],
                                                      d["group_type"]))

    @property
    def next_steps_long(self):
        d = self.d
        return self._get("nsl", lambda: next_steps_long(d["connection_request"], d["person_alias"],
                                                        self._att, d["connection_opportunity"]))

    @property
    def next_steps(self):
        return self._get("ns", lambda: next_steps(self.next_steps_long))

    @property
    def streaks(self):
        d = self.d
        return self._get("st", lambda: streaks(attended_weeks(
            d["attendance"], d["person_alias"], d["person"], d["attendance_occurrence"], d["group"])))


#: Places (service groups) that may be broadcast.
BROADCAST_PLACES = 1_000_000


def places(d) -> DataFrame:
    """(group_id, is_online) of the groups that occurrences point at, written; with a broadcast hint while
    their counted rows are few."""
    used = d["attendance_occurrence"].select("group_id").where(F.col("group_id").isNotNull()).distinct()
    campus = d["group"].select(F.col("id").alias("group_id"), "campus_id")
    out = materialize(used.join(campus, "group_id").select(
        "group_id", F.when(F.col("campus_id") == 30, 1).otherwise(0).alias("is_online")))
    return F.broadcast(out) if out.count() <= BROADCAST_PLACES else out


def alias_activity(d, with_weeks: bool) -> DataFrame:
    """One row per alias with everything that happened under it: check-ins (first, last, number and, on
    request, the distinct weeks and online flags, at most a calendar of them), gifts and next-step requests.

    Each fact table is reduced per alias on its own, and the alias map is read once.  An occurrence id is
    unique, as its table's key."""
    attended = d["attendance"].where(F.col("did_attend") == 1).select("person_alias_id", "occurrence_id", "start_ts")
    weeks = []
    if with_weeks:
        occurrence = d["attendance_occurrence"].select(F.col("id").alias("occurrence_id"), "group_id")
        attended = attended.join(occurrence, "occurrence_id", "left").join(places(d), "group_id", "left")
        visit = F.struct(week_start("start_ts", "SAT").alias("period_start"), "is_online")
        weeks = [F.collect_set(F.when(F.col("is_online").isNotNull(), visit)).alias("weeks")]
    check_ins = attended.groupBy(F.col("person_alias_id").alias("a1")).agg(
        F.min("start_ts").alias("first_attendance"), F.max("start_ts").alias("last_attendance"),
        F.count(F.lit(1)).alias("total_check_ins"), *weeks)
    gifts = d["gift"].groupBy(F.col("person_alias_id").alias("a2")).agg(
        F.count("id").alias("number_of_transactions"), F.min("created_ts").alias("first_gift"),
        F.max("created_ts").alias("last_gift"))
    is_k = {k: F.col("opportunity_id") == k for k in NEXT_STEP_COLUMNS}
    # one row tells which of the opportunities exist
    known = d["connection_opportunity"].agg(*[F.max(F.col("id") == k).alias(f"known_{k}") for k in NEXT_STEP_COLUMNS])
    requests = (d["connection_request"].where(F.col("opportunity_id").isin(*NEXT_STEP_COLUMNS))
                .groupBy(F.col("person_alias_id").alias("a3"))
                .agg(*[F.count(F.when(c, 1)).alias(f"rows_{k}") for k, c in is_k.items()],
                     *[F.count(F.when(c, F.col("id"))).alias(f"n_{k}") for k, c in is_k.items()])
                .crossJoin(F.broadcast(known))
                .select("a3", *[F.when(F.col(f"known_{k}") & (F.col(f"rows_{k}") > 0), F.col(f"n_{k}")).alias(f"opp_{k}")
                                for k in NEXT_STEP_COLUMNS]))
    alias = d["person_alias"].select("id", "person_id", (F.col("person_id") == F.col("alias_person_id")).alias("own"))
    return (alias.join(check_ins, F.col("id") == F.col("a1"), "left").join(gifts, F.col("id") == F.col("a2"), "left")
            .join(requests, F.col("id") == F.col("a3"), "left").withColumnRenamed("id", "alias_id").drop("a1", "a2", "a3"))


def person_activity(d, with_weeks: bool) -> DataFrame:
    """One row per person with check-ins under the primary alias.

    Check-ins and gifts are those of the primary alias (the smallest of a person's own, S11), next steps and
    weeks those of all aliases.  One exchange by person brings them all together."""
    facts = ["first_attendance", "last_attendance", "total_check_ins", "number_of_transactions", "first_gift", "last_gift"]
    weeks = [F.array_distinct(F.flatten(F.collect_list("weeks"))).alias("weeks")] if with_weeks else []
    per = alias_activity(d, with_weeks).where(F.col("person_id").isNotNull()).groupBy(F.col("person_id").alias("id")).agg(
        F.min(F.when(F.col("own"), F.struct("alias_id", *facts))).alias("primary"),
        *[F.sum(f"opp_{k}").cast("long").alias(f"opp_{k}") for k in NEXT_STEP_COLUMNS], *weeks)
    return per.where(F.col("primary.total_check_ins") > 0).select(
        "id", *[F.col(f"primary.{c}").alias(c) for c in facts], *[f"opp_{k}" for k in NEXT_STEP_COLUMNS], *(["weeks"] if with_weeks else []))


def with_streaks(activity: DataFrame) -> DataFrame:
    """``activity`` with ``weeks`` turned into highest_streak and lco_percentage.

    Weeks become rows where the person already is; the person's other columns ride on the first of them, and
    one grouping on the same key puts the row together again: no exchange, no second reading."""
    rest = [c for c in activity.columns if c not in ("id", "weeks")]
    rows = activity.select("id", F.struct(*rest).alias("_rest"), F.posexplode_outer("weeks").alias("_at", "_w"))
    first = F.coalesce(F.col("_at"), F.lit(0)) == 0
    rows = rows.select("id", F.col("_w.period_start").alias("period_start"), F.col("_w.is_online").alias("is_online"),
                       F.when(first, F.col("_rest")).alias("_rest"))
    out = longest_runs(rows, F.first("_rest", ignorenulls=True).alias("_rest"), counts=F.col("period_start").isNotNull())
    return out.select("id", "_rest.*", "highest_streak", "lco_percentage")


def _feature_base(d, streaks_too: bool) -> DataFrame:
    """What happened, who it happened to, and the group counts, by person id."""
    activity = person_activity(d, streaks_too)
    activity = with_streaks(activity) if streaks_too else activity
    # members once: family sizes and serving groups are counted from the same exchange of distinct pairs (the
    # serving groups come by an inner join on their unique id; a semi join would be pushed below the exchange)
    members = d["group_member"].where(F.col("person_id").isNotNull() & F.col("group_id").isNotNull()).select("group_id", "person_id").distinct()
    sizes = (members.groupBy("group_id").agg(F.count(F.lit(1)).alias("people_in_family"))
             .join(d["group"].select(F.col("id").alias("group_id")), "group_id", "left_semi"))
    # people without a family get a key of their own each, so they do not all meet in one task
    person = d["person"].withColumn("_family", F.coalesce("primary_family_id", -F.col("id")))
    person = person.join(sizes, (F.col("_family") == F.col("group_id")) & F.col("primary_family_id").isNotNull(), "left")
    types = d["group_type"].where(F.col("purpose_value_id") == SERVING_PURPOSE).select(F.col("id").alias("group_type_id"))
    serving = d["group"].join(types, "group_type_id", "left_semi").select(F.col("id").alias("group_id"))
    served = members.join(serving, "group_id").groupBy(F.col("person_id").alias("id")).agg(F.count(F.lit(1)).alias("serving_groups"))
    return activity.join(person.drop("group_id", "_family"), "id").join(served, "id", "left")


def person_features(d, as_of) -> DataFrame:
    """One row per attending person, 34 columns (reference v2)."""
    j = _feature_base(d, streaks_too=True)
    act = activation_date(F.col("first_attendance"), F.col("first_gift"))
    c = F.col
    cols = [
        c("id"),
        c("record_type_id").alias("person_type"),
        F.coalesce(c("total_check_ins"), F.lit(0)).alias("total_check_ins"),
        as_date(act).alias("activation_date"),
        day_diff(c("created_ts"), act).alias("time_to_activate"),
        F.when(c("foreign_id").isNull(), 0).otherwise(1).alias("is_imported"),
        as_date("created_ts").alias("person_created_date"),
        as_date("first_attendance").alias("first_attendance_date"),
        day_diff(c("created_ts"), c("first_attendance")).alias("days_to_first_attendance"),
        F.month("first_attendance").alias("month_first_attendance"),
        F.month("last_attendance").alias("month_last_attendance"),
        c("last_attendance"),
        c("first_attendance"),
        month_diff(c("first_attendance"), c("last_attendance")).alias("months_between_first_and_last_attendance"),
        F.coalesce(c("gender"), F.lit(0)).alias("gender"),
        (F.year(lit_date(as_of)) - c("birth_year")).alias("age"),
        F.coalesce(c("marital_status_id"), F.lit(DEFAULT_MARITAL_STATUS)).alias("marital_status_value_id"),
        c("age_classification"),
        F.coalesce(c("people_in_family"), F.lit(0)).alias("people_in_family"),
        c("number_of_transactions"),
        c("first_gift"),
        c("last_gift"),
        F.coalesce(month_diff(c("first_gift"), c("last_gift")), F.lit(0)).alias(
            "months_between_first_and_last_giving"),
        c("serving_groups"),
        *[F.coalesce(c(f"opp_{k}"), F.lit(0)).alias(v) for k, v in NEXT_STEP_COLUMNS.items()],
        F.coalesce(c("highest_streak"), F.lit(0)).alias("highest_streak"),
        F.coalesce(c("lco_percentage"), F.lit(0).cast("decimal(19,2)")).alias("lco_percentage"),
        churn_flag(c("last_attendance"), as_of).alias("two_months_without_activity"),
    ]
    return j.select(*cols)


def person_features_v1(d, as_of) -> DataFrame:
    """The first script's 23-column table (no null defaults, no streak
    or activation)."""
    j = _feature_base(d, streaks_too=False)
    c = F.col
    return j.select(
        c("id"), c("total_check_ins"),
        F.month("first_attendance").alias("month_first_attendance"),
        F.month("last_attendance").alias("month_last_attendance"),
        c("last_attendance"), c("first_attendance"),
        month_diff(c("first_attendance"), c("last_attendance")).alias("months_between_first_and_last_attendance"),
        c("gender"), (F.year(lit_date(as_of)) - c("birth_year")).alias("age"),
        c("marital_status_id").alias("marital_status_value_id"), c("age_classification"),
        c("people_in_family"), c("number_of_transactions"),
        month_diff(c("first_gift"), c("last_gift")).alias("months_between_first_and_last_giving"),
        c("serving_groups"),
        *[c(f"opp_{k}").alias(v) for k, v in NEXT_STEP_COLUMNS.items()],
        churn_flag(c("last_attendance"), as_of).alias("two_months_without_activity"),
    )


def retention_days(person: DataFrame, attendance: DataFrame, person_alias: DataFrame) -> DataFrame:
    """Days from account creation to the first attended check-in on a
    later day, through any alias.  Check-ins are first reduced to distinct
    (alias, day) pairs; the first later day per person is a grouped min."""
    days = attendance.where(F.col("did_attend") == 1).select(
        "person_alias_id", as_date("start_ts").alias("day")).distinct()
    alias = person_alias.select(F.col("id").alias("person_alias_id"), F.col("person_id").alias("id"))
    created = person.select("id", as_date("created_ts").alias("person_created_date"))
    later = (days.join(alias, "person_alias_id").join(created, "id")
             .where(F.col("day") > F.col("person_created_date")))
    first = later.groupBy("id", "person_created_date").agg(F.min("day").alias("first_return"))
    return first.select("id", "person_created_date",
                        F.datediff("first_return", "person_created_date").alias("retention_days"))
