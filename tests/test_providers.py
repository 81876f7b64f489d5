"""P-22: capabilities, health and fallbacks."""

from tidewatch.operators import gates as GT


def test_first_capable_healthy_fallback(spark):
    routed = spark.createDataFrame([("d1", "tier_1", "investigation", "base=tier_1"), ("d1", "tier_1", "new_task", "base=tier_1"), ("d2", "tier_1", "investigation", "base=tier_1"),
                                    ("d1", "tier_2", "agent_red_team", "base=tier_2"), ("d3", "tier_1", "investigation", "base=tier_1"), ("d1", "tier_9", "x", "r")],
                                   "bucket string, tier string, task_type string, reason string")
    providers = spark.createDataFrame([("tier_1", 0, "a", 50_000, True, False), ("tier_1", 1, "b", 200_000, False, False), ("tier_1", 2, "c", 100_000, True, False),
                                       ("tier_1", 3, "d", 200_000, True, True), ("tier_2", 0, "a", 200_000, True, False), ("tier_2", 1, "c", 100_000, True, False)], GT.PROVIDER_SCHEMA)
    health = spark.createDataFrame([("d1", "a", False), ("d3", "a", False), ("d3", "c", False), ("d3", "c", True)], "bucket string, provider string, available boolean")
    got = {(r.bucket, r.tier, r.task_type): r for r in GT.assign_providers(routed, providers, GT.task_capabilities(spark), health, "bucket").collect()}
    one = got["d1", "tier_1", "investigation"]  # b has no tool use; c is the first that fits
    assert (one.provider, one.is_fallback, one.fallbacks, one.primary_capable) == ("c", True, ["d"], False)
    assert one.reason == "base=tier_1; primary_unavailable→fallback(c)"
    assert got["d1", "tier_1", "new_task"].provider == "b"  # nothing is asked of an unknown task
    two = got["d2", "tier_1", "investigation"]
    assert (two.provider, two.is_fallback, two.fallbacks, two.reason, two.unserved) == ("a", False, ["c", "d"], "base=tier_1", False)
    assert got["d3", "tier_1", "investigation"].provider == "d"
    none = got["d1", "tier_2", "agent_red_team"]  # the only fallback is too small
    assert (none.provider, none.unserved, none.fallbacks, none.is_fallback) == ("a", True, [], False)
    assert got["d1", "tier_9", "x"].provider is None and len(got) == 6
