"""Named queries over the driver's tables (``queries()``/``oracle_sql()``)."""

from tidewatch.plans import (audit_q, exposure_q, fp_q, reports_q, retrieval_q, rules_q,  # noqa: F401
                             enrich_q, extended_q, gates_q, investigations_q, pipeline_q, sequences_q, sources_q, taxonomy_q, text_q)
from tidewatch.plans.registry import HEADLINE, ORACLES, QUERIES  # noqa: F401
