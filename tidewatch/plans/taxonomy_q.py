"""Registered taxonomy queries (S-21, J-06 as of the row's time).

The releases are derived from the investigations: each month's release lists the techniques seen in the month before.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import taxonomy as TX
from tidewatch.plans.oracle_roles import with_roles
from tidewatch.plans.registry import register
from tidewatch.sources import tables as TB


def _cited(spark, sf):
    return TB.investigations(spark, sf).select("investigation_id", "created_at", F.explode("atlas_techniques").alias("technique_id"))


def releases(spark, sf):
    month = F.add_months(F.trunc("created_at", "month"), 1)
    return _cited(spark, sf).select(F.lit("atlas").alias("framework"), F.date_format(month, "yyyy-MM").alias("version"),
                                    month.cast("timestamp_ntz").alias("released_at"), "technique_id").distinct()


RELEASES_SQL = """
, cited AS (SELECT investigation_id, created_at, unnest(atlas_techniques) AS technique_id FROM investigations)
, rel AS (SELECT DISTINCT date_trunc('month', created_at) + INTERVAL 1 MONTH AS released, technique_id FROM cited)
, rs AS (SELECT released, ROW_NUMBER() OVER (ORDER BY released) AS nth, LEAD(released) OVER (ORDER BY released) AS next_at FROM (SELECT DISTINCT released FROM rel))
"""


def _s21(spark, sf):
    d = TX.dimension(releases(spark, sf))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return d.select("technique_id", day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to"), "since", "until")


register("s21_taxonomy_dimension", with_roles(RELEASES_SQL + """
, h AS (SELECT technique_id, rs.released, nth, next_at, nth - ROW_NUMBER() OVER (PARTITION BY technique_id ORDER BY nth) AS run FROM rel JOIN rs USING (released))
SELECT technique_id, strftime(MIN(released), '%Y-%m-%d') AS valid_from, strftime(arg_max(CASE WHEN next_at IS NULL THEN NULL ELSE next_at END, nth), '%Y-%m-%d') AS valid_to,
       strftime(MIN(released), '%Y-%m') AS since, strftime(MAX(released), '%Y-%m') AS until
FROM (SELECT h.*, MAX(nth) OVER (PARTITION BY technique_id, run) AS last FROM h) GROUP BY technique_id, run
""".replace("arg_max(CASE WHEN next_at IS NULL THEN NULL ELSE next_at END, nth)", "MAX(CASE WHEN nth = last THEN next_at END)"), "investigations"))(_s21)


def _j06_as_of(spark, sf):
    """Citations by version in force and whether the technique was part of it."""
    r = releases(spark, sf).checkpoint()
    rows = TX.as_of(_cited(spark, sf), "created_at", "technique_id", TX.dimension(r))
    return TX.with_version(rows, "created_at", r).groupBy("taxonomy", "known").agg(F.count(F.lit(1)).alias("citations"))


register("j06_taxonomy_as_of", with_roles(RELEASES_SQL + """
, v AS (SELECT c.*, (SELECT MAX(released) FROM rs WHERE released <= c.created_at) AS released FROM cited c)
SELECT CASE WHEN v.released IS NULL THEN '' ELSE 'atlas-' || strftime(v.released, '%Y-%m') END AS taxonomy, rel.technique_id IS NOT NULL AS known, CAST(COUNT(*) AS BIGINT) AS citations
FROM v LEFT JOIN rel ON rel.released = v.released AND rel.technique_id = v.technique_id GROUP BY 1, 2
""", "investigations"))(_j06_as_of)
