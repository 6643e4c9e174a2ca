"""The person table's layout by its plan and on awkward rows; owned intermediate tables."""

import datetime as dt
import os

from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from flock.operators import people as pp
from flock.operators.streaks import attended_weeks, streaks
from flock.session import ensure_checkpoint_dir, intermediates, materialize, release
from flock.sources.fixtures import load_domain


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_person_table_exchanges(spark):
    """Half of the 43 shuffle stages of the first build, the written places included."""
    d = load_domain(spark, SF_SMALL)
    exchanges = _plan(pp.person_features(d, "2001-08-01")).count("Exchange hashpartitioning")
    places = d["attendance_occurrence"].select("group_id").distinct().join(d["group"].withColumnRenamed("id", "group_id"), "group_id")
    assert exchanges + _plan(places).count("Exchange hashpartitioning") <= 21


def test_streak_columns_need_no_exchange_of_their_own(spark):
    d = load_domain(spark, SF_SMALL)
    with_, without = (_plan(pp.person_activity(d, w)) for w in (True, False))
    ridden = _plan(pp.with_streaks(pp.person_activity(d, True)))
    assert ridden.count("Exchange hashpartitioning") == with_.count("Exchange hashpartitioning")
    assert with_.count("Exchange hashpartitioning") <= without.count("Exchange hashpartitioning") + 2  # occurrences


def test_streaks_ride_as_the_plain_operator_counts_them(spark):
    d = load_domain(spark, SF_MID)
    plain = {r.id: (r.highest_streak, r.lco_percentage) for r in streaks(attended_weeks(
        d["attendance"], d["person_alias"], d["person"], d["attendance_occurrence"], d["group"])).collect()}
    activity = pp.person_activity(d, True)
    rows = pp.with_streaks(activity).collect()
    assert len(rows) == activity.count() > 1000
    assert {r.id: (r.highest_streak, r.lco_percentage) for r in rows if r.highest_streak is not None} == {
        k: v for k, v in plain.items() if k in {r.id for r in rows}}


def _tiny(spark):
    t = dt.datetime
    rows = {
        "attendance": ([(1, 10, 100, t(2020, 1, 1), 1), (2, 10, 101, t(2020, 1, 8), 1), (3, 11, None, t(2020, 1, 15), 1), (4, 20, 999, t(2020, 2, 1), 1),
                        (5, 30, 100, t(2020, 2, 1), 0), (6, 40, 102, t(2020, 3, 1), 1), (7, 99, 100, t(2020, 3, 1), 1)],
                       "id long, person_alias_id long, occurrence_id long, start_ts timestamp_ntz, did_attend int"),
        "attendance_occurrence": ([(100, 7), (101, 8), (102, None)], "id long, group_id long"),
        "group": ([(7, None, 30), (8, None, 1), (50, 500, None), (60, None, None)], "id long, group_type_id long, campus_id int"),
        "group_type": ([(500, 184), (501, 184)], "id long, purpose_value_id int"),
        "group_member": ([(50, 1), (50, 1), (60, 1), (60, 2), (60, 2), (60, None), (None, 1)], "group_id long, person_id long"),
        "person_alias": ([(10, 1, 1), (11, 1, 11), (20, 2, 2), (30, 3, 3), (40, 4, 4), (41, None, 41), (42, 9, 9)], "id long, person_id long, alias_person_id long"),
        "gift": ([(1, 10, t(2020, 5, 1)), (2, 11, t(2020, 6, 1)), (3, 20, t(2020, 7, 1))], "id long, person_alias_id long, created_ts timestamp_ntz"),
        "connection_request": ([(1, 10, 13), (2, 11, 13), (3, 20, 26), (4, 20, 555), (None, 20, 7)], "id long, person_alias_id long, opportunity_id int"),
        "connection_opportunity": ([(13,), (7,)], "id int"),
        "person": ([(i, t(2019, 1, 1), None, 1, 1, 1990, None, 1, f) for i, f in ((1, 60), (2, None), (3, 60), (4, 77), (5, None))],
                   "id long, created_ts timestamp_ntz, foreign_id long, record_type_id int, gender int, birth_year int, marital_status_id int, "
                   "age_classification int, primary_family_id long")}
    return {k: spark.createDataFrame(*v) for k, v in rows.items()}


def test_awkward_people(spark):
    got = {r.id: r for r in pp.person_features(_tiny(spark), "2020-08-01").collect()}
    assert set(got) == {1, 2, 4}  # person 3 only has a visit not attended
    a, b, c = got[1], got[2], got[4]
    assert (a.total_check_ins, a.number_of_transactions, a.im_new, a.people_in_family, a.serving_groups) == (2, 1, 2, 2, 1)
    assert (b.total_check_ins, b.im_new, b.serving_interest, b.baptism, b.people_in_family, b.serving_groups) == (1, 0, 0, 0, 0, None)
    # weeks count only where occurrence and group exist
    assert (a.highest_streak, float(a.lco_percentage)) == (1, 50.0) and (b.highest_streak, c.highest_streak, float(c.lco_percentage)) == (0, 0, 0.0)
    v1 = {r.id: r for r in pp.person_features_v1(_tiny(spark), "2020-08-01").collect()}
    assert set(v1) == {1, 2, 4} and (v1[1].im_new, v1[2].baptism, v1[2].im_new, v1[2].serving_interest) == (2, 0, None, None)


def _tables(spark):
    root = f"{ensure_checkpoint_dir(spark)}/tables".removeprefix("file:")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_a_scope_leaves_nothing_but_what_it_keeps(spark):
    before = _tables(spark)
    with intermediates() as outer:
        a = materialize(spark.range(5))
        with intermediates() as inner:
            b, c = materialize(a.where("id > 1")), materialize(a.where("id > 2"))
            assert len(_tables(spark) - before) == 3
            release(c, a.limit(1))  # the second is no table of its own
            assert len(_tables(spark) - before) == 2
            kept = inner.keep(b)
        assert kept.count() == 3 and len(_tables(spark) - before) == 2
        result = outer.keep(materialize(kept.agg(F.sum("id").alias("s"))))
    assert result.first().s == 9 and len(_tables(spark) - before) == 1
    release(result)
    assert _tables(spark) == before


def test_a_scope_is_emptied_after_an_error_and_holds_a_whole_build(spark):
    before = _tables(spark)
    try:
        with intermediates():
            materialize(spark.range(3))
            raise KeyError
    except KeyError:
        pass
    assert _tables(spark) == before
    with intermediates():
        assert pp.person_features(load_domain(spark, SF_SMALL), "2001-08-01").count() > 0
        assert _tables(spark) != before
    assert _tables(spark) == before
