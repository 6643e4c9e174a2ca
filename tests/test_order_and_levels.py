"""Row order of the account statistics, and level indexes of the first notebook's model input."""

from conftest import SF_SMALL
from flock.operators.clean import model2_dataset_v1
from flock.plans.registry import queries


def test_account_stats_come_newest_first(spark):
    rows = queries()["account_stats"](spark, SF_SMALL).select("mo", "week_number", "total_new_check_ins").collect()
    known = [r.mo for r in rows if r.total_new_check_ins is not None]
    assert len(set(known)) > 1 and known == sorted(known, reverse=True)
    assert [r.total_new_check_ins is None for r in rows] == sorted(r.total_new_check_ins is None for r in rows)


def test_level_indexes_keep_null_and_count_every_level(spark):
    columns = ["id", "person_type", "gender", "age_classification", "is_imported", "marital_status_value_id", "two_months_without_activity"]
    clean = spark.createDataFrame([
        (1, 1, "2", 1, True, "x", "StayAtChurch"), (2, 1, None, 2, False, "x", "LeaveChurch"), (3, 2, "0", 1, True, "x", "StayAtChurch"),
        (4, 1, "1", 3, False, "x", "StayAtChurch"), (5, None, "1", 1, None, "x", "StayAtChurch"), (6, 1, "1", 2, None, None, None)],
        "id int, person_type int, gender string, age_classification int, is_imported boolean, marital_status_value_id string, two_months_without_activity string")
    assert clean.columns == columns
    got = model2_dataset_v1(clean)
    assert sorted(got.columns) == sorted(c for c in columns if c not in ("person_type", "marital_status_value_id"))
    rows = {r.id: (r.gender, r.age_classification, r.is_imported, r.two_months_without_activity) for r in got.collect()}
    assert rows == {1: (3.0, 1.0, 2.0, 1.0), 2: (None, 2.0, 1.0, 0.0), 6: (2.0, 2.0, None, 0.0)}
