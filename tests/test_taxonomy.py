"""The taxonomy as a versioned dimension."""

import datetime as dt

from tidewatch.operators import taxonomy as TX
from tidewatch.operators import text as T

D = dt.datetime


def _releases(spark):
    rows = [("attack", "15", D(2023, 1, 1), x) for x in ("T1", "T2")] + [("attack", "16", D(2024, 1, 1), x) for x in ("T1", "T3")]
    rows += [("attack", "16.1", D(2024, 6, 1), x) for x in ("T1", "T2", "T3", "T3", None)] + [("atlas", "4", D(2023, 7, 1), "A1"), ("atlas", "4", D(2023, 7, 1), "T3")]
    return spark.createDataFrame(rows, "framework string, version string, released_at timestamp_ntz, technique_id string")


def test_intervals_and_versions(spark):
    r = _releases(spark)
    got = {(x.framework, x.technique_id, x.since, x.until, x.valid_from, x.valid_to) for x in TX.dimension(r).collect()}
    assert got == {("attack", "T1", "15", "16.1", D(2023, 1, 1), None), ("attack", "T2", "15", "15", D(2023, 1, 1), D(2024, 1, 1)),
                   ("attack", "T2", "16.1", "16.1", D(2024, 6, 1), None), ("attack", "T3", "16", "16.1", D(2024, 1, 1), None),
                   ("atlas", "A1", "4", "4", D(2023, 7, 1), None), ("atlas", "T3", "4", "4", D(2023, 7, 1), None)}
    v = sorted((x.valid_from, x.valid_to, x.taxonomy) for x in TX.versions(r).collect())
    assert [x[2] for x in v] == ["attack-15", "atlas-4+attack-15", "atlas-4+attack-16", "atlas-4+attack-16.1"] and v[-1][1] is None
    assert {x.technique_id for x in TX.known_at(TX.dimension(r), "2024-02-01 00:00:00").collect()} == {"T1", "T3", "A1"}


def test_an_old_alert_meets_the_taxonomy_of_its_day(spark):
    r = _releases(spark)
    rows = spark.createDataFrame([(i, t, at) for i, (t, at) in enumerate([("T2", D(2023, 12, 31)), ("T2", D(2024, 1, 1)), ("T2", D(2024, 7, 1)), ("T3", D(2023, 8, 1)),
                                                                          ("T1", D(2022, 1, 1)), (None, D(2024, 1, 1)), ("T1", None), ("T2", D(2024, 7, 1))])],
                                 "id int, technique string, at timestamp_ntz")
    got = {x.id: (x.known, x.since, x.framework, x.taxonomy) for x in TX.with_version(TX.as_of(rows, "at", "technique", TX.dimension(r)), "at", r).collect()}
    assert got == {0: (True, "15", "attack", "atlas-4+attack-15"), 1: (False, None, None, "atlas-4+attack-16"), 2: (True, "16.1", "attack", "atlas-4+attack-16.1"),
                   3: (True, "4", "atlas", "atlas-4+attack-15"), 4: (False, None, None, ""), 5: (False, None, None, "atlas-4+attack-16"), 6: (False, None, None, ""),
                   7: (True, "16.1", "attack", "atlas-4+attack-16.1")}


def test_a_large_taxonomy_is_joined(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["uses T1059 and T9999.001.", "T9999.001 T8888", None, "none", "T1059", "T8888 again T8888"] * 3)]
    df = spark.createDataFrame(rows, "id int, report string")
    known = spark.createDataFrame([("T1059",), (None,)], "technique_id string")
    want = sorted(map(str, T.quarantine_techniques(df, "report", known).collect()))
    monkeypatch.setattr(T, "MAX_KNOWN_IDS", 0)
    assert sorted(map(str, T.quarantine_techniques(df, "report", known).collect())) == want and "T9999.001" in want[0]


def test_zones(spark):
    a = spark.createDataFrame([("a", "Zone0_Safety"), ("b", "nowhere"), ("c", None)], "asset string, zone string")
    assert {r.asset: r.consequence for r in TX.zone_consequences(a, TX.zone_table(spark)).collect()} == {"a": "safety_life", "b": "data_loss", "c": "data_loss"}
