"""Rule cases restated from the reference's unit tests, as raw rows that
aggregate to the reference's mocked inputs (clock 2025-06-15T12:00:00)."""

import datetime as dt

import pytest
from pyspark.sql import Row

from tidewatch.operators import rules as R

NOW = dt.datetime(2025, 6, 15, 12, 0, 0)


def _audit(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, ts timestamp_ntz, user_id string, action string, "
                                       "target_resource string")


def _rows_user(user, n, targets, start, span, action="deltaTableWrite"):
    out = []
    for i in range(n):
        out.append(("default", start + dt.timedelta(seconds=(span.total_seconds() * i / max(n, 1))), user, action,
                    f"t{i % targets}"))
    return out


def test_d01_cases(spark):
    cur0 = NOW - dt.timedelta(hours=23)
    base0 = NOW - dt.timedelta(days=29, hours=23)
    span_c, span_b = dt.timedelta(hours=22), dt.timedelta(days=28)
    rows = []
    rows += _rows_user("alice", 200, 2, cur0, span_c) + _rows_user("alice", 300, 2, base0, span_b)
    rows += _rows_user("bob", 10, 10, cur0, span_c) + _rows_user("bob", 150, 1, base0, span_b)
    rows += _rows_user("charlie", 60, 1, cur0, span_c) + _rows_user("charlie", 1650, 1, base0, span_b)
    rows += _rows_user("dave", 5, 1, cur0, span_c) + _rows_user("dave", 150, 1, base0, span_b)
    rows += _rows_user("eve", 4, 1, cur0, span_c)
    out = {r.user_id: r for r in R.training_data_poisoning(_audit(spark, rows), NOW).collect()}
    assert set(out) == {"alice", "bob", "charlie", "eve"}
    assert out["alice"].deviation_factor == pytest.approx(20.0)
    assert out["bob"].distinct_tables == 10 and out["bob"].deviation_factor == pytest.approx(2.0)
    assert out["eve"].deviation_factor == pytest.approx(4.0)
    assert out["alice"].confidence == pytest.approx(0.95)
    assert out["eve"].confidence == pytest.approx(0.7)


def test_d01_bob_fires_on_distinct_targets(spark):
    rows = _rows_user("bob", 10, 10, NOW - dt.timedelta(hours=5), dt.timedelta(hours=4))
    rows += _rows_user("bob", 300, 1, NOW - dt.timedelta(days=20), dt.timedelta(days=10))
    out = R.training_data_poisoning(_audit(spark, rows), NOW).collect()
    assert len(out) == 1 and out[0].distinct_tables == 10 and out[0].deviation_factor == pytest.approx(1.0)


def test_d01_tenants_do_not_mix(spark):
    rows = [("t1", NOW - dt.timedelta(hours=1), "u", "notebookRun", "x")] * 4
    rows += [("t2", NOW - dt.timedelta(days=3), "u", "notebookRun", "x")] * 300
    out = {r.tenant_id: r for r in R.training_data_poisoning(_audit(spark, rows), NOW).collect()}
    assert set(out) == {"t1"} and out["t1"].baseline_avg == 0


def _inference(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, ts timestamp_ntz, edge_node_id string, "
                                       "confidence_score double, inference_latency_ms double, "
                                       "physics_check_result string")


def test_d04_zscore_and_skip_without_baseline(spark):
    rows = []
    for i in range(40):  # baseline mean .9, sample sd .1 (alternating .8/1.0)
        rows.append(("default", NOW - dt.timedelta(days=3, minutes=i), "n1", 0.8 if i % 2 else 1.0, 80.0, "pass"))
    rows.append(("default", NOW - dt.timedelta(minutes=10), "n1", 0.3, 100.0, "pass"))
    rows.append(("default", NOW - dt.timedelta(minutes=10), "n2", 0.1, 100.0, "fail"))  # no baseline: skipped
    out = R.adversarial_evasion(_inference(spark, rows), NOW).collect()
    assert [r.edge_node_id for r in out] == ["n1"]
    assert out[0].z_score == pytest.approx(-0.6 / 0.10127393670836667, rel=1e-6)
    assert out[0].confidence == pytest.approx(0.95)


def _oracle(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, ts timestamp_ntz, edge_node_id string, check_result string, "
                                       "latency_ms double, error_state string")


@pytest.mark.parametrize("checks,errors,timeouts,fails,maxlat,fires", [
    (20, 5, 0, 2, 500, True), (20, 0, 3, 0, 500, True), (15, 0, 0, 9, 200, True),
    (20, 0, 0, 0, 15000, True), (50, 1, 0, 2, 200, False)])
def test_d05_cases(spark, checks, errors, timeouts, fails, maxlat, fires):
    rows = []
    for i in range(checks):
        lat = 12000.0 if i < timeouts else (float(maxlat) if i == checks - 1 else 100.0)
        rows.append(("default", NOW - dt.timedelta(minutes=5), "n1", "fail" if i < fails else "pass", lat,
                     "E" if i < errors else None))
    out = R.oracle_dos(_oracle(spark, rows), NOW).collect()
    assert (len(out) == 1) == fires
    if fires:
        assert out[0].confidence == pytest.approx(0.9)


def test_d06_supply_chain(spark):
    reg = spark.createDataFrame([
        ("default", NOW - dt.timedelta(hours=1), "u1", "stage_transition", "m", "1", "Production", ""),
        ("default", NOW - dt.timedelta(hours=1), "u2", "stage_transition", "m", "2", "Production", None),
        ("default", NOW - dt.timedelta(hours=1), "u3", "stage_transition", "m", "3", "Production", "boss"),
    ], "tenant_id string, ts timestamp_ntz, user_id string, action string, model_name string, model_version string, "
       "stage string, approved_by string")
    ci = spark.createDataFrame([
        ("default", NOW - dt.timedelta(hours=2), "p1", "c1", "requests==2.0", 0, "dev"),
        ("default", NOW - dt.timedelta(hours=2), "p2", "c2", "requests==2.0", 5, "dev"),
    ], "tenant_id string, ts timestamp_ntz, pipeline_id string, commit_hash string, dependency_changes string, "
       "tests_passed int, deployer string")
    out = R.supply_chain(reg, ci, NOW).collect()
    assert sorted(r.finding for r in out) == ["dependency", "promotion", "promotion"]


def test_d08_alert_flood(spark):
    def inv(n_cur, n_base):
        rows = [(NOW - dt.timedelta(hours=1),)] * n_cur + [(NOW - dt.timedelta(days=3),)] * n_base
        return spark.createDataFrame(rows, "created_at timestamp_ntz")
    # baseline 7 days = 28 six-hour slots; 280 rows -> 10 per slot
    assert R.alert_flood(inv(100, 280), NOW).collect()[0].spike_ratio == pytest.approx(10.0)
    assert R.alert_flood(inv(20, 280), NOW).count() == 0
    assert R.alert_flood(inv(6, 0), NOW).collect()[0].spike_ratio == pytest.approx(6.0)


def test_d09_violation_floor_and_trust(spark):
    rows = [("default", NOW - dt.timedelta(hours=5, minutes=i), "n1", 10, 100.0 + (i % 2) * 40, 0, "ok")
            for i in range(30)]
    rows.append(("default", NOW - dt.timedelta(minutes=3), "n1", 10, 110.0, 3, "ok"))
    df = spark.createDataFrame(rows, "tenant_id string, ts timestamp_ntz, edge_node_id string, sensor_count int, "
                                     "data_points_received double, protocol_violations int, connection_state string")
    out = R.sensor_spoofing(df, NOW).collect()
    assert len(out) == 1
    assert out[0].confidence == pytest.approx(0.7) and out[0].telemetry_trust_level == "untrusted"


def test_d10_mtls_and_no_baseline(spark):
    rows = [("default", NOW - dt.timedelta(hours=1), "p1", "acme", 100.0, False),
            ("default", NOW - dt.timedelta(hours=1), "p2", "beta", 100.0, True)]
    df = spark.createDataFrame(rows, "tenant_id string, ts timestamp_ntz, partner_id string, partner_name string, "
                                     "payload_size double, mtls_verified boolean")
    out = R.partner_compromise(df, NOW).collect()
    assert [(r.partner_id, r.volume_deviation) for r in out] == [("p1", 0.0)]


def test_d11_edge_and_run_all(spark):
    rows = [("default", NOW - dt.timedelta(minutes=2), "n1", "fail", "ok", 0.2, 0.3),
            ("default", NOW - dt.timedelta(minutes=2), "n2", "pass", "ok", 0.99, 0.3),
            ("default", NOW - dt.timedelta(minutes=2), "n3", "pass", "ok", 0.2, 0.3)]
    df = spark.createDataFrame(rows, "tenant_id string, ts timestamp_ntz, edge_node_id string, boot_attestation string, "
                                     "disk_integrity string, cpu_utilisation double, memory_utilisation double")
    out = {r.edge_node_id: r for r in R.edge_compromise(df, NOW).collect()}
    assert set(out) == {"n1", "n2"}
    assert out["n1"].confidence == pytest.approx(0.595)
    det = R.run_all({"D-11": lambda: R.edge_compromise(df, NOW)}, NOW)
    assert det.columns == R.DETECTION_COLUMNS
    ev = {r.entity_id: r.evidence for r in det.collect()}
    assert ev["n1"] == {"edge_node_id": "n1", "boot_attestation": "fail"}
    assert set(ev["n2"]) == {"edge_node_id", "cpu_utilisation"}
    alerts = R.detections_to_alerts(det).collect()
    assert all(a.severity == "critical" and a.techniques == ["AML.T0040", "T1195.002"] for a in alerts)


def test_run_all_isolates_a_broken_rule(spark):
    rows = [Row(tenant_id="default", ts=NOW - dt.timedelta(minutes=2), edge_node_id="n1", boot_attestation="fail",
                disk_integrity="ok", cpu_utilisation=0.1, memory_utilisation=0.1)]
    df = spark.createDataFrame(rows)
    broken = spark.createDataFrame([Row(x=1)])
    rules = {"D-11": lambda: R.edge_compromise(df, NOW), "D-05": lambda: R.oracle_dos(broken, NOW),
             "D-01": lambda: R.training_data_poisoning(spark.table("no_such_table"), NOW)}
    det = R.run_all(rules, NOW)
    assert det.count() == 1
    status = {r.rule_id: (r.ok, r.error) for r in R.rule_status(spark, rules, NOW).collect()}
    assert sorted(ok for ok, _ in status.values()) == [False, False, True]
    assert all((error is None) == ok for ok, error in status.values())
    audit = R.detection_audit(det).collect()
    assert [(a.event_type, a.tenant_id, a.entity_id) for a in audit] == [("atlas.detection_fired", "default", "n1")]


def test_run_all_raises_what_is_not_a_missing_input(spark):
    def bug():
        raise KeyError("a fault in the code")
    with pytest.raises(KeyError):
        R.run_all({"D-11": bug}, NOW)


def test_insider_resource_access_ilike_any_and_thresholds(spark):
    import datetime as _dt
    now = _dt.datetime(2024, 1, 31)
    rows = [("a", "u1", now - _dt.timedelta(hours=h), f"s3://Model-Weights/run-{h}", "10.0.0.1") for h in range(1, 5)]
    rows += [("a", "u1", now - _dt.timedelta(hours=2), "notebooks/x", "10.0.0.1")]           # not suspicious
    rows += [("a", "u2", now - _dt.timedelta(hours=3), "training-data/a", "10.0.0.2")]
    rows += [("a", "u2", now - _dt.timedelta(days=d), "training-data/a", "10.0.0.2") for d in range(2, 29)]
    # Another tenant's user of the same id keeps a baseline of its own.
    rows += [("b", "u1", now - _dt.timedelta(hours=3), "training-data/a", "10.0.0.3")]
    rows += [("b", "u1", now - _dt.timedelta(days=d), "training-data/a", "10.0.0.3") for d in range(2, 29)]
    log = spark.createDataFrame(rows, "tenant_id string, user_id string, ts timestamp_ntz, target_resource string, source_ip string")
    out = {(r["tenant_id"], r["user_id"]): r for r in R.insider_resource_access(log, now).collect()}
    # u1: 4 distinct suspicious resources (> 3) and no baseline -> deviation 999, confidence capped
    assert set(out) == {("a", "u1")}
    u1 = out["a", "u1"]
    assert u1["access_count"] == 4 and u1["distinct_resources"] == 4
    assert u1["deviation_factor"] == 999.0 and u1["confidence"] == 0.95
