"""The investigations' event log: folding, refused events, re-opening, case facts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewatch.operators import investigations as IV

T0 = dt.datetime(2024, 1, 1)
CASE = ("investigation_id string, tenant_id string, opened_at timestamp_ntz, fp_pattern string, fp_confidence double, confidence double, "
        "all_untrusted boolean, needs_approval boolean, shadow boolean")


def _states(df):
    return {r.investigation_id: r for r in IV.current_states(df).collect()}


def test_pipeline_branches_decisions_and_reopening(spark):
    cases = spark.createDataFrame([("fp", "t", T0, "p1", 0.95, 0.5, True, True, True), ("untrusted", "t", T0, None, None, 0.5, True, True, True),
                                   ("approval", "t", T0, None, None, 0.5, False, True, True), ("shadow", "t", T0, None, None, 0.9, False, False, True),
                                   ("plain", "t", T0, None, None, 0.9, None, None, None)], CASE)
    log = IV.pipeline_events(cases)
    s = _states(IV.fold(log))
    assert {k: v.state for k, v in s.items()} == {"fp": "closed", "untrusted": "awaiting_human", "approval": "awaiting_human", "shadow": "awaiting_human", "plain": "closed"}
    assert all(v.refused == 0 for v in s.values())
    actions = {r.investigation_id: r.action for r in log.where("to_state = 'awaiting_human'").collect()}
    assert actions == {"untrusted": "force_human_review", "approval": "request_approval", "shadow": "shadow_decision_logged"}
    day = T0 + dt.timedelta(days=1)
    said = spark.createDataFrame([("fp", "t", day, True), ("untrusted", "t", day, True), ("approval", "t", day, False), ("shadow", "t", day, None), ("plain", "t", day, False)],
                                 "investigation_id string, tenant_id string, at timestamp_ntz, approved boolean")
    both = log.unionByName(IV.decision_events(said))
    s = _states(IV.fold(both))
    assert (s["fp"].state, s["fp"].refused) == ("closed", 2) and (s["plain"].refused, s["approval"].state, s["untrusted"].state) == (1, "closed", "closed")
    again = IV.reopen_events(log, spark.createDataFrame([("p1",), ("p1",)], "pattern_id string"), F.lit(day + dt.timedelta(days=1)).cast("timestamp_ntz"))
    s = _states(IV.fold(both.unionByName(again)))
    assert (s["fp"].state, s["fp"].reopened, s["plain"].reopened) == ("received", 1, 0)


def test_fold_equals_a_plain_loop_in_any_order(spark):
    rng = random.Random(6)
    rows = [(rng.choice("abcd"), "t", T0 + dt.timedelta(seconds=rng.randint(0, 50)), rng.randint(0, 2), rng.choice(IV.STATES), f"g{i}", "x", None, None) for i in range(400)]
    rows += [(k, "t", T0 - dt.timedelta(days=1), 0, "received", "g", "x", None, None) for k in "abcd"]
    df = spark.createDataFrame(rows, "investigation_id string, tenant_id string, at timestamp_ntz, seq int, to_state string, agent string, action string, confidence double, pattern_id string")
    got = sorted((r.investigation_id, r.at, r.seq, r.agent, r.from_state, r.applied) for r in IV.fold(df.repartition(5)).collect())
    want, state = [], {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[3], r[5])):
        now = state.get(r[0], "")
        ok = r[4] in IV.ALLOWED[now]
        want.append((r[0], r[2], r[3], r[5], now, ok))
        state[r[0]] = r[4] if ok else now
    assert got == sorted(want)
    assert {k: v.state for k, v in _states(IV.fold(df)).items()} == state


def test_case_facts(spark):
    states = spark.createDataFrame([("a", "t", "closed"), ("b", "t", "closed")], "investigation_id string, tenant_id string, state string")
    ents = spark.createDataFrame([("a", "host1"), ("a", "host1"), ("a", "10.0.0.1")], "investigation_id string, value string")
    iocs = spark.createDataFrame([("a", "ip", "10.0.0.1")], "investigation_id string, type string, value string")
    tech = spark.createDataFrame([("a", "T1")], "investigation_id string, technique_id string")
    sim = spark.createDataFrame([("a", f"i{i}", "title", i) for i in range(9)], "investigation_id string, incident_id string, title string, rank int")
    got = {r.investigation_id: r for r in IV.case_facts(states, ents, iocs, tech, sim).collect()}
    assert got["a"].entities == ["10.0.0.1", "host1"] and [x.incident_id for x in got["a"].similar_incidents] == [f"i{i}" for i in range(5)]
    assert got["b"].entities == [] and got["a"].token_estimate > got["b"].token_estimate > 0


def test_similar_cases_come_from_one_sort(spark):
    """A-34: the five cases before each of its tenant and title, without a join; a null title or tenant has none, a null id counts as a case."""
    from tidewatch.plans import investigations_q as IQ
    rows = [(f"i{i}", "t", "A" if i % 3 else "B", T0 + dt.timedelta(days=i // 2)) for i in range(20)]
    rows += [("n1", "t", None, T0), ("n2", "t", None, T0), ("n3", None, "A", T0), ("n4", None, "A", T0), (None, "t", "B", T0 + dt.timedelta(days=3))]
    c = spark.createDataFrame(rows, "investigation_id string, tenant_id string, alert_title string, opened_at timestamp_ntz")
    got = IQ._similar(c)
    want = set()
    for k in "AB":
        ids = [r[0] for r in sorted((r for r in rows if r[1] == "t" and r[2] == k), key=lambda r: (r[3], r[0] is not None, r[0] or ""))]
        want |= {(x, ids[n - i], k, i) for n, x in enumerate(ids) for i in range(1, 6) if n >= i}
    assert {(r.investigation_id, r.incident_id, r.title, r["rank"]) for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_fold_hands_other_columns_through_unread(spark):
    """X-05: cases that go on over several batches, unknown and null states; the columns do not become Python values."""
    rows = [("a", "t", T0 + dt.timedelta(seconds=i), i, s, "g", "x", None, None) for i, s in enumerate(["received", None, "odd", "", "parsing", "parsing", "closed", "received"])]
    rows += [("b", "t", T0, 0, "parsing", "g", "x", 0.5, "p"), ("b", "t", T0, 1, "received", "g", "x", 0.5, "p")]
    df = spark.createDataFrame(rows, "investigation_id string, tenant_id string, at timestamp_ntz, seq int, to_state string, agent string, action string, confidence double, pattern_id string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        folded = IV.fold(df)
        got = {(r.investigation_id, r.seq): (r.from_state, r.applied, r.confidence, r.at) for r in folded.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    a = [("", True), ("received", False), ("received", False), ("received", False), ("received", True), ("parsing", False), ("parsing", True), ("closed", True)]
    assert [got["a", i][:2] for i in range(8)] == a and got["a", 3][3] == T0 + dt.timedelta(seconds=3)
    assert got["b", 0] == ("", False, 0.5, T0) and got["b", 1][:2] == ("", True)
    assert "MapInArrow" in folded._jdf.queryExecution().executedPlan().toString()
