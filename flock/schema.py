"""Declared schemas of the domain tables (never inferred at read time)."""

from pyspark.sql.types import (
    DateType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


PERSON = _s(("id", LongType()), ("created_ts", TimestampNTZType()), ("foreign_id", LongType()),
            ("record_type_id", IntegerType()), ("gender", IntegerType()), ("birth_year", IntegerType()),
            ("marital_status_id", IntegerType()), ("age_classification", IntegerType()),
            ("primary_family_id", LongType()))
PERSON_ALIAS = _s(("id", LongType()), ("person_id", LongType()), ("alias_person_id", LongType()))
ATTENDANCE = _s(("id", LongType()), ("person_alias_id", LongType()), ("occurrence_id", LongType()),
                ("start_ts", TimestampNTZType()), ("did_attend", IntegerType()))
ATTENDANCE_OCCURRENCE = _s(("id", LongType()), ("group_id", LongType()))
GROUP = _s(("id", LongType()), ("group_type_id", LongType()), ("campus_id", IntegerType()))
GROUP_TYPE = _s(("id", LongType()), ("purpose_value_id", IntegerType()))
GROUP_MEMBER = _s(("group_id", LongType()), ("person_id", LongType()))
GIFT = _s(("id", LongType()), ("person_alias_id", LongType()), ("created_ts", TimestampNTZType()))
CONNECTION_REQUEST = _s(("id", LongType()), ("person_alias_id", LongType()), ("opportunity_id", IntegerType()))
CONNECTION_OPPORTUNITY = _s(("id", IntegerType()))
RETENTION = _s(("person_created_date", DateType()), ("retention_days", IntegerType()))
UNPIVOT_EXTRACT = _s(("mo", DateType()), ("type", StringType()), ("number", LongType()))

DOMAIN = {
    "person": PERSON,
    "person_alias": PERSON_ALIAS,
    "attendance": ATTENDANCE,
    "attendance_occurrence": ATTENDANCE_OCCURRENCE,
    "group": GROUP,
    "group_type": GROUP_TYPE,
    "group_member": GROUP_MEMBER,
    "gift": GIFT,
    "connection_request": CONNECTION_REQUEST,
    "connection_opportunity": CONNECTION_OPPORTUNITY,
}
