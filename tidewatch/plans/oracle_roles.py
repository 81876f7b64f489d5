"""DuckDB twins of the role views in ``tidewatch.sources.tables``.

``with_roles(sql, 'audit_log', ...)`` prefixes the query with the needed
``WITH`` definitions; the query body may add its own CTEs after a comma
by starting with ``, name AS (...)``.
"""

from __future__ import annotations

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
NODE = "'node-' || CAST(user_id % 20 AS VARCHAR)"

ROLE_SQL = {
    "audit_log": f"""
        SELECT 'default' AS tenant_id, ts, CAST(user_id AS VARCHAR) AS user_id, event_type AS action,
               CAST({K} AS VARCHAR) AS target_resource,
               '10.0.' || CAST(user_id % 250 AS VARCHAR) || '.' || CAST({K} % 250 AS VARCHAR) AS source_ip
        FROM events""",
    "query_log": f"""
        SELECT 'default' AS tenant_id, ts, CAST(user_id AS VARCHAR) AS user_id,
               CAST({K} AS VARCHAR) AS session_id, value AS token_count,
               (event_type = 'error') AS safety_filter_triggered
        FROM events""",
    "api_log": f"""
        SELECT 'default' AS tenant_id, ts, CAST(user_id AS VARCHAR) AS caller_identity,
               '/v1/' || ['predict', 'forecast', 'inference', 'nl-query', 'status'][{K} % 5 + 1] || '/' || CAST({K} AS VARCHAR)
                 AS endpoint, event_type AS method
        FROM events""",
    "inference_log": f"""
        SELECT 'default' AS tenant_id, ts, {NODE} AS edge_node_id,
               1.0 - value / 500.0 AS confidence_score, value * 4.0 AS inference_latency_ms,
               CASE WHEN event_type = 'error' THEN 'fail' ELSE 'pass' END AS physics_check_result
        FROM events""",
    "oracle_log": f"""
        SELECT 'default' AS tenant_id, ts, {NODE} AS edge_node_id,
               CASE WHEN event_type = 'error' THEN 'fail' ELSE 'pass' END AS check_result,
               value * 25.0 AS latency_ms,
               CASE WHEN event_type = 'error' THEN 'E' || CAST({K} AS VARCHAR) END AS error_state
        FROM events""",
    "sensor_log": f"""
        SELECT 'default' AS tenant_id, ts, {NODE} AS edge_node_id,
               10 + {K} % 8 AS sensor_count, value AS data_points_received,
               CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS protocol_violations,
               CASE WHEN event_type = 'signup' THEN 'reconnecting' ELSE 'connected' END AS connection_state
        FROM events""",
    "edge_telemetry": f"""
        SELECT 'default' AS tenant_id, ts, {NODE} AS edge_node_id,
               CASE WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'signup' THEN NULL
                    ELSE 'pass' END AS boot_attestation,
               CASE WHEN event_type = 'purchase' AND {K} % 10 = 0 THEN 'fail' ELSE 'ok' END AS disk_integrity,
               value / 480.0 AS cpu_utilisation, {K} / 100.0 AS memory_utilisation
        FROM events""",
    "partner_log": """
        SELECT 'default' AS tenant_id, ts, 'p' || CAST(user_id % 15 AS VARCHAR) AS partner_id,
               'partner-' || CAST(user_id % 15 AS VARCHAR) AS partner_name, value AS payload_size,
               (event_type <> 'error') AS mtls_verified
        FROM events""",
    "resource_access_log": f"""
        SELECT 'default' AS tenant_id, ts, CAST(user_id AS VARCHAR) AS user_id,
               ['model-weights', 'training-data', 'notebooks', 'model-registry', 'dashboards', 'hyperparameters',
                'jobs', 'architecture-docs', 'clusters', 'model-config'][(({K} % 10) + 10) % 10 + 1] || '/' || CAST({K} AS VARCHAR)
                 AS target_resource,
               '10.0.' || CAST(user_id % 250 AS VARCHAR) || '.' || CAST({K} % 250 AS VARCHAR) AS source_ip
        FROM events""",
    "partner_traffic": f"""
        SELECT 'default' AS tenant_id, ts, 'p' || CAST(user_id % 15 AS VARCHAR) AS partner_id,
               'partner-' || CAST(user_id % 15 AS VARCHAR) AS partner_name,
               CASE WHEN {K} % 2 = 0 THEN 'inbound' ELSE 'outbound' END AS direction,
               'dt-' || CAST({K} % 6 AS VARCHAR) AS data_type, value AS payload_size,
               CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' THEN 404 ELSE 200 END AS response_code,
               (event_type <> 'error') AS mtls_verified
        FROM events""",
    "model_registry": f"""
        SELECT 'default' AS tenant_id, ts, CAST(user_id AS VARCHAR) AS user_id,
               CASE WHEN event_type = 'purchase' THEN 'stage_transition' ELSE 'register' END AS action,
               'model-' || CAST({K} % 10 AS VARCHAR) AS model_name, CAST({K} AS VARCHAR) AS model_version,
               CASE WHEN {K} % 3 = 0 THEN 'Production' ELSE 'Staging' END AS stage,
               CASE WHEN {K} % 4 = 0 THEN NULL WHEN {K} % 4 = 1 THEN ''
                    ELSE 'approver-' || CAST(user_id AS VARCHAR) END AS approved_by
        FROM events""",
    "cicd_audit": f"""
        SELECT 'default' AS tenant_id, ts, 'pipe-' || CAST({K} % 12 AS VARCHAR) AS pipeline_id,
               CAST(event_id AS VARCHAR) AS commit_hash,
               CASE WHEN event_type = 'signup' THEN 'dep-' || CAST({K} AS VARCHAR)
                    WHEN event_type = 'click' THEN '' END AS dependency_changes,
               CASE WHEN value < 100 THEN 0 ELSE 1 END AS tests_passed,
               CAST(user_id AS VARCHAR) AS deployer
        FROM events""",
    "investigations": """
        SELECT CAST(o_orderkey AS VARCHAR) AS investigation_id, 'alert-' || CAST(o_orderkey AS VARCHAR) AS alert_id,
               't' || CAST(o_custkey % 4 AS VARCHAR) AS tenant_id,
               CASE WHEN o_orderstatus = 'F' THEN 'closed'
                    WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN 'awaiting_human'
                    WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 1 THEN 'enriching'
                    WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 2 THEN 'reasoning'
                    WHEN o_orderstatus = 'O' THEN 'received'
                    WHEN o_orderkey % 2 = 0 THEN 'responding' ELSE 'failed' END AS state,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
                    WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'low'
                    ELSE 'informational' END AS severity,
               CASE WHEN o_orderstatus <> 'F' THEN '' WHEN o_orderkey % 3 = 0 THEN 'false_positive'
                    WHEN o_orderkey % 3 = 1 THEN 'true_positive' ELSE 'benign' END AS classification,
               'Suspicious sign-in pattern ' || CAST(o_custkey % 40 AS VARCHAR) AS alert_title,
               (o_orderkey % 100) / 100.0 AS confidence,
               o_totalprice / 100000.0 AS total_cost_usd,
               o_orderdate AS created_at,
               o_orderdate + to_hours(CAST(o_orderkey % 72 AS BIGINT)) AS updated_at,
               ['AML.T00' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0')] AS atlas_techniques,
               'asset-' || CAST(o_custkey % 100 + 1 AS VARCHAR) AS asset_id,
               '10.' || CAST(o_custkey % 256 AS VARCHAR) || '.' || CAST(o_orderkey % 256 AS VARCHAR) || '.7' AS src_ip,
               'family-' || CAST(o_custkey % 7 AS VARCHAR) AS rule_family,
               CASE o_custkey % 3 WHEN 0 THEN 'server' WHEN 1 THEN 'workstation' ELSE 'ot_device' END AS asset_class
        FROM orders""",
    "decision_log": """
        SELECT 't' || CAST(l_orderkey % 4 AS VARCHAR) AS tenant_id, 'family-' || CAST(l_orderkey % 7 AS VARCHAR) AS rule_family,
               CAST(l_orderkey AS VARCHAR) AS investigation_id, 'fp-' || CAST(l_orderkey % 60 AS VARCHAR) AS pattern_id,
               CASE WHEN l_linenumber % 2 = 1 THEN 'shadow' ELSE 'analyst' END AS type,
               CASE WHEN l_returnflag = 'R' THEN 'true_positive' ELSE 'false_positive' END AS decision,
               l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) AS ts
        FROM lineitem""",
    "closures": """
        SELECT CAST(doc_id AS VARCHAR) AS alert_id, source AS rule_family, lang AS severity,
               CASE WHEN n_chars > 5000 THEN 'high' ELSE 'low' END AS asset_criticality,
               quality = 1 AS auto_closed, toxic = 0 AS truly_fp, 'fp-' || CAST(doc_id % 60 AS VARCHAR) AS pattern_id,
               TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(doc_id % 90 AS BIGINT)) AS pattern_created_at
        FROM labels JOIN documents USING (doc_id)""",
    "findings": """
        SELECT l_orderkey * 10 + l_linenumber AS finding_id,
               CASE WHEN l_linenumber = 7 THEN 'qualys' WHEN l_linenumber % 4 = 0 THEN 'wiz'
                    WHEN l_linenumber % 4 = 1 THEN 'snyk' WHEN l_linenumber % 4 = 2 THEN 'garak'
                    ELSE 'art' END AS source_tool,
               'Exposure ' || CAST(l_partkey % 997 AS VARCHAR) AS title,
               'asset-' || CAST(l_suppkey AS VARCHAR) AS asset_id,
               CASE WHEN l_discount >= 0.08 THEN 'CRITICAL' WHEN l_discount >= 0.05 THEN 'HIGH'
                    WHEN l_discount >= 0.02 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
               CASE l_partkey % 5 WHEN 0 THEN 'edge' WHEN 1 THEN 'orbital' WHEN 2 THEN 'demo'
                    WHEN 3 THEN 'public' ELSE 's3' END AS resource_type,
               CASE l_partkey % 6 WHEN 0 THEN 'torch' WHEN 1 THEN 'onnxruntime-gpu' WHEN 2 THEN 'lodash'
                    WHEN 3 THEN 'requests' ELSE 'numpy' END AS package_name,
               'pip' AS package_manager, l_quantity / 5.0 AS exploitability_score,
               CASE l_partkey % 8 WHEN 0 THEN 'escalation' WHEN 1 THEN 'tool_use' WHEN 2 THEN 'prompt_injection'
                    WHEN 3 THEN 'extraction' WHEN 4 THEN 'exfiltration' WHEN 5 THEN 'jailbreak'
                    WHEN 6 THEN 'encoding' ELSE 'other' END AS probe_type,
               CASE l_partkey % 5 WHEN 0 THEN 'poisoning' WHEN 1 THEN 'evasion' WHEN 2 THEN 'extraction'
                    WHEN 3 THEN 'inference' ELSE 'other' END AS attack_type,
               l_discount * 10 AS success_rate,
               CASE l_suppkey % 4 WHEN 0 THEN 'Zone0_Safety' WHEN 1 THEN 'Zone1_EdgeInference'
                    WHEN 2 THEN 'Zone2_SCADA' ELSE 'Zone3_Enterprise' END AS deployment_zone,
               l_shipdate AS detected_at, 't' || CAST(l_orderkey % 4 AS VARCHAR) AS tenant_id
        FROM lineitem""",
    "call_log": """
        SELECT l_shipdate AS created_at, 't' || CAST(l_orderkey % 4 AS VARCHAR) AS tenant_id,
               CAST(l_orderkey AS VARCHAR) AS investigation_id,
               'model-' || CAST(l_suppkey % 4 AS VARCHAR) AS model_id,
               CASE l_suppkey % 4 WHEN 0 THEN 'tier0' WHEN 1 THEN 'tier1' WHEN 2 THEN 'tier1_plus'
                    ELSE 'tier2' END AS model_tier,
               'task-' || CAST(l_linenumber AS VARCHAR) AS task_type,
               CAST(l_quantity * 100 AS BIGINT) AS input_tokens,
               CAST(ROUND(l_tax * 10000) AS BIGINT) AS output_tokens,
               l_extendedprice / 10000.0 AS cost_usd, l_quantity * 37.0 AS latency_ms,
               CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'success' END AS status,
               1.0 - l_discount * 5 AS confidence
        FROM lineitem""",
}
ROLE_SQL["investigations"] = (
    "SELECT *, json_object('severity', severity, 'classification', classification, 'alert_title', alert_title, "
    "'confidence', confidence) AS graph_state FROM (" + ROLE_SQL["investigations"] + ")")


def with_roles(body: str, *roles: str) -> str:
    """``WITH role AS (...), ... <body>``; ``body`` may begin with ``, cte AS (..)``."""
    ctes = ",\n".join(f"{r} AS ({ROLE_SQL[r]})" for r in roles)
    body = body.strip()
    if body.startswith(","):
        return f"WITH {ctes}{body}"
    return f"WITH {ctes}\n{body}"
