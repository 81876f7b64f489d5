"""Structured entity parsing (T-01/T-03) and source adapter contract cases (S-01..S-05)."""

import json

from tidewatch.operators.entities import parse_entities_df
from tidewatch.sources import adapters as AD


def _parse(spark, raw, payload=None):
    df = spark.createDataFrame([(raw, payload)], "e string, p string")
    return parse_entities_df(df, "e", "p", "r").collect()[0].r


def test_structured_entities(spark):
    ents = [{"$id": "1", "Type": "account", "Name": "jsmith", "UPNSuffix": "example.com"},
            {"$id": "2", "Type": "file", "Name": "a.exe", "FileHashes": [{"Algorithm": "SHA256", "Value": "B" * 64}]},
            {"$id": "3", "Type": "process", "ProcessId": "42", "ImageFile": {"$ref": "2"}},
            {"$id": "4", "Type": "ip", "Address": "10.0.0.1"}, {"$id": "5", "Type": "ip", "Address": "300.0.0.1"},
            {"$id": "6", "Type": "Bogus"}]
    r = _parse(spark, json.dumps(ents))
    got = [(e.entity_type, e.primary_value) for e in r.entities]
    assert got == [("account", "jsmith@example.com"), ("file", "a.exe"), ("filehash", "b" * 64),
                   ("process", "a.exe"), ("ip", "10.0.0.1")]
    assert r.raw_iocs == ["jsmith@example.com", "b" * 64, "10.0.0.1"]
    assert r.parse_errors == ["Invalid IP address: 300.0.0.1", "Unknown entity type: Bogus"]


def test_fallback_order(spark):
    assert [e.primary_value for e in _parse(spark, "", '{"x": "seen 8.8.4.4"}').entities] == ["8.8.4.4"]
    r = _parse(spark, "broken [ 1.1.1.1")
    assert r.parse_errors == ["entities_raw JSON error"] and r.raw_iocs == ["1.1.1.1"]
    assert _parse(spark, '{"Type": "ip"}').parse_errors == ["entities_raw is not a JSON array"]


def test_sentinel_contract(spark):
    raw = json.dumps({"SystemAlertId": "abc", "TimeGenerated": "2024-01-01T00:00:00Z", "AlertName": "Brute force",
                      "Severity": "High", "Tactics": "CredentialAccess, InitialAccess", "Techniques": "T1110",
                      "ProductName": "Sentinel", "TenantId": "t1"})
    hb = json.dumps({"AlertName": " Health Check ", "Severity": "Low"})
    df = spark.createDataFrame([(raw,), (hb,)], "raw string")
    out = AD.sentinel_to_canonical(df).collect()
    assert len(out) == 1
    a = out[0]
    assert (a.alert_id, a.severity, a.tactics, a.techniques, a.entities_raw) == \
        ("abc", "high", ["CredentialAccess", "InitialAccess"], ["T1110"], "[]")


def test_splunk_contract(spark):
    raw = json.dumps({"event_id": "n1", "_time": "1704067200", "search_name": "Excessive logins", "urgency": "info",
                      "annotations": {"mitre_attack": {"mitre_tactic": "a, b", "mitre_technique_id": ["T1", " T2"]}},
                      "src": "1.1.1.1", "src_ip": "1.1.1.1", "user": "bob"})
    health = json.dumps({"search_name": "Health - indexer", "_time": "2024-01-01T00:00:00Z"})
    out = AD.splunk_to_canonical(spark.createDataFrame([(raw,), (health,)], "raw string")).collect()
    assert len(out) == 1
    a = out[0]
    assert (a.timestamp, a.severity, a.tactics, a.techniques) == \
        ("2024-01-01T00:00:00+00:00", "informational", ["a", "b"], ["T1", "T2"])
    assert [e["Type"] for e in json.loads(a.entities_raw)] == ["ip", "account"]


def test_firewall_normalise(spark):
    rows = [("2024-01-01T00:00:00", "10.0.0.5", "1234", "8.8.8.8", None, "tcp", "Reject",
             "cat=a;cat=b app=web", None, None, "v")]
    df = spark.createDataFrame(rows, "TimeGenerated string, SourceIP string, SourcePort string, DestinationIP string, "
                                     "DestinationPort string, Protocol string, DeviceAction string, "
                                     "AdditionalExtensions string, DeviceEventClassID string, ApplicationProtocol string, "
                                     "DeviceVendor string")
    r = AD.normalise_network(df).collect()[0]
    assert (r.action, r.direction, r.threat_name, r.application, r.protocol, r.destination_port) == \
        ("deny", "outbound", "b", "web", "TCP", 0)
