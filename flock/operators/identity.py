"""Person id -> primary alias id.

The reference calls a scalar SQL function per row inside a join condition
(``TOP 1`` alias whose PersonId and AliasPersonId both equal the person).
Here it is one aggregate, joined like any dimension: the lookup becomes a
hash/sort-merge join instead of a per-row probe.  ``TOP 1`` without an order
is made deterministic with ``min(id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def primary_alias(person_alias: DataFrame, person: DataFrame | None = None) -> DataFrame:
    """``(person_id, alias_id)``, one row per person that has a primary alias."""
    pa = (person_alias.where(F.col("person_id") == F.col("alias_person_id"))
          .groupBy("person_id").agg(F.min("id").alias("alias_id")))
    if person is not None:
        pa = pa.join(person.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    return pa


def alias_to_person(person_alias: DataFrame) -> DataFrame:
    """``(alias_id, person_id)`` for every alias (the any-alias mapping)."""
    return person_alias.select(F.col("id").alias("alias_id"), "person_id")
