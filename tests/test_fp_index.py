"""J-08's literal index against every pattern tried on every alert."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import fp as FP

PATTERN_SCHEMA = ("tenant_id string, pattern_id string, status string, alert_name_regex string, scope_rule_family string, scope_tenant_id string, "
                  "scope_asset_class string, entity_patterns array<struct<type:string,value_regex:string,value_cidr:string>>")
ALERT_SCHEMA = "alert_id string, tenant_id string, alert_title string, entities map<string,array<string>>, rule_family string, asset_class string"


@pytest.mark.parametrize("pattern, want", [
    ("Port scan", ["port scan"]), ("abc.*def", ["abc", "def"]), ("ab(cd)ef", ["abcdef"]), ("ab(?:cd)?ef", ["ab", "ef"]), ("abc|abd", ["ab"]),
    ("x|y", []), ("a+bc", ["a", "bc"]), ("(?:foo){2}bar", ["foo", "bar"]), ("(?=abc)abc", ["abc"]), ("(?!abc)x", ["x"]), (r"\d+ hosts", [" hosts"]),
    ("a[bc]d", ["a", "d"]), ("[a]b", ["ab"]), ("^Start$", ["start"]), ("(?x) a b", []), ("(", []), (r"\p{L}+x", []), ("Überfall", ["berfall"]), (None, []), ("", []),
    (r"\Qa.b\E", []), (r"a\.b", ["a.b"]), ("a{0,3}bc", ["bc"]), ("(?i)Abc", ["abc"]), (r"(a)\1b", ["a", "b"])])
def test_required_literals(pattern, want):
    assert FP.required_literals(pattern) == want


def test_a_match_holds_every_literal():
    rng, parts = random.Random(1), ["ab", "c", "(de)?", "[fg]", "x|y", "(?:hi)+", "k*", r"\d", ".", "S"]
    for _ in range(2000):
        p = "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
        m = re.compile(p, re.I)
        for _ in range(10):
            t = "".join(rng.choice("abcdefghikxysS1") for _ in range(rng.randint(0, 12)))
            if m.search(t):
                assert all(x in t.lower() for x in FP.required_literals(p)), (p, t)


def _patterns(spark, rows):
    return spark.createDataFrame([(t, f"p{i:03}", s, r, "", "", a, e) for i, (t, s, r, a, e) in enumerate(rows)], PATTERN_SCHEMA)


def _tables(spark, seed):
    rng = random.Random(seed)
    words = ["Port", "scan", "LOGIN", "failed", "Überfall", "Kiosk", "mass", "disk", "full", "a", "xy"]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(40)] + ["Kıosk", "Kiosk full", "maſs disk", "DİSK full", None, ""]
    regexes = [rng.choice(["", ".*"]) + rng.choice(words) + rng.choice(["", ".*", " scan", "|login", "(?: full)?", "+", r"\s\w+", "("]) for _ in range(60)]
    regexes += [None, "", ".*", "x", "[pP]ort", "(?x) port", "DISK full", "mass", "kiosk"]
    pats = [(rng.choice("ab"), rng.choice(["approved", "active", "active", "shadow"]), r, rng.choice(["", "", "server"]),
             rng.choice([None, [], [("ip", None, "10.0.0.0/8")], [("host", "h1", None), ("ip", None, "bad")]])) for r in regexes]
    alerts = [(f"a{i}", rng.choice("abc"), rng.choice(titles), {"ips": [rng.choice(["10.1.2.3", "192.168.0.1"])], "hosts": [rng.choice(["h1", "h2"])]},
               "f", rng.choice(["server", "laptop"])) for i in range(500)]
    return spark.createDataFrame(alerts, ALERT_SCHEMA), _patterns(spark, pats)


@pytest.mark.parametrize("seed", [1, 2])
def test_index_equals_all_pairs(spark, seed):
    alerts, patterns = _tables(spark, seed)
    for t in (0.9, 0.7, 0.75):
        got = sorted(map(tuple, FP.match_fp_patterns(alerts, patterns, threshold=t).collect()))
        # A column threshold takes the path without an index.
        want = sorted(map(tuple, FP.match_fp_patterns(alerts, patterns, threshold=F.lit(t)).collect()))
        assert got == want and len(got) > 20


def test_folded_letters_and_separate_paths(spark):
    alerts, patterns = _tables(spark, 3)
    p = FP.prepare_patterns(_patterns(spark, [("a", "active", r, "", None) for r in ("kiosk", "mass", "disk", "(", "x", "never seen")]))
    titles = spark.createDataFrame([("a", t) for t in ("Kıosk", "KIOSK", "maſs", "DİSK", "xylo", "other")], "tenant_id string, title string")
    c = FP.title_candidates(titles, p).collect()
    assert {(r.pattern_id, r.title) for r in c if r.indexed} == {("p000", "Kıosk"), ("p000", "KIOSK"), ("p001", "maſs"), ("p002", "DİSK")}
    assert {(r.pattern_id, r.title) for r in c if not r.indexed} == {("p004", t) for t in ("Kıosk", "KIOSK", "maſs", "DİSK", "xylo", "other")}
    r = FP.candidate_report(alerts, patterns).collect()
    assert all(x.indexed_pairs + x.unindexed_pairs < x.all_pairs and x.matches <= x.indexed_pairs + x.unindexed_pairs for x in r) and r
