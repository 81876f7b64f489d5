"""X-05 / X-06 / A-34: investigations as an append-only event log, and the states folded from it.

``pipeline_events`` turns one row of joined facts per case (FP match, trust of its detections, approval need, shadow mode) into
the events that the pipeline appends; human decisions (``decision_events``) and re-openings of closures by a revoked pattern
(``reopen_events``) are appended by others and later. Nobody reads a state to write an event: ``fold`` runs through each case's events
in order, applies those that its state allows and marks the others, as when a decision comes in for a case that awaits
none. Rows are streamed in order with one state, so a case of any length costs no memory; cases are dealt by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import ship_package

# Fixed values (must equal the reference): the states, and which follows which.
STATES = ("received", "parsing", "enriching", "reasoning", "awaiting_human", "responding", "closed", "failed")
ALLOWED = {
    "": ("received",),
    "received": ("parsing", "failed"),
    "parsing": ("enriching", "closed", "failed"),
    "enriching": ("reasoning", "failed"),
    "reasoning": ("awaiting_human", "responding", "failed"),
    "awaiting_human": ("responding", "closed", "awaiting_human", "failed"),
    "responding": ("closed", "failed"),
    "closed": ("received",),
    "failed": ("received",),
}
EVENT = "struct<to_state:string,agent:string,action:string,confidence:double,pattern_id:string>"
LOG_COLS = ["investigation_id", "tenant_id", "at", "seq", "to_state", "agent", "action", "confidence", "pattern_id"]


def _event(to_state: str, agent: str, action: str, confidence: Column | None = None, pattern: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(to_state).alias("to_state"), F.lit(agent).alias("agent"), F.lit(action).alias("action"),
                    (none if confidence is None else confidence).cast("double").alias("confidence"),
                    (none if pattern is None else pattern).cast("string").alias("pattern_id")).cast(EVENT)


def pipeline_events(cases: DataFrame) -> DataFrame:
    """The events of each case (investigation_id, tenant_id, opened_at, fp_pattern, fp_confidence, confidence, all_untrusted, needs_approval,
    shadow): parse, FP short-circuit before any enrichment, enrich, reason, trust gate, approval, shadow branch, response. An event's time is
    its place after ``opened_at`` in seconds."""
    conf = F.col("confidence")
    start = [_event("received", "graph", "open"), _event("parsing", "ioc_extractor", "start_ioc_extraction")]
    short = F.array(*start, _event("closed", "fp_short_circuit", "auto_close_fp", F.col("fp_confidence"), F.col("fp_pattern")))
    reasoned = F.array(*start, _event("enriching", "graph", "start_enrichment"), _event("reasoning", "reasoning_agent", "start_reasoning", conf))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    end = (F.when(yes("all_untrusted"), F.array(_event("awaiting_human", "orchestrator", "force_human_review", conf)))
           .when(yes("needs_approval"), F.array(_event("awaiting_human", "reasoning_agent", "request_approval", conf)))
           .when(yes("shadow"), F.array(_event("awaiting_human", "orchestrator", "shadow_decision_logged", conf)))
           .otherwise(F.array(_event("responding", "response_agent", "start_response", conf), _event("closed", "response_agent", "execute_actions", conf))))
    events = F.when(F.col("fp_pattern").isNotNull(), short).otherwise(F.concat(reasoned, end))
    log = cases.select("investigation_id", "tenant_id", "opened_at", F.posexplode(events).alias("seq", "e"))
    return log.select("investigation_id", "tenant_id", (F.col("opened_at") + F.make_interval(secs=F.col("seq"))).alias("at"), "seq", "e.*")


def decision_events(decisions: DataFrame) -> DataFrame:
    """Human decisions (investigation_id, tenant_id, at, approved): granted goes on to the response, rejected closes; null is none."""
    yes = F.array(_event("responding", "human", "approval_granted"), _event("closed", "response_agent", "execute_actions"))
    no = F.array(_event("closed", "human", "approval_rejected"))
    d = decisions.where(F.col("approved").isNotNull())
    log = d.select("investigation_id", "tenant_id", "at", F.posexplode(F.when(F.col("approved"), yes).otherwise(no)).alias("seq", "e"))
    return log.select("investigation_id", "tenant_id", (F.col("at") + F.make_interval(secs=F.col("seq"))).alias("at"), "seq", "e.*")


def reopen_events(log: DataFrame, revoked: DataFrame, at: Column) -> DataFrame:
    """P-33 as events: each case that a revoked pattern (pattern_id) closed goes back to received at ``at``."""
    hit = (log.where((F.col("action") == "auto_close_fp")).join(revoked.select("pattern_id").distinct(), "pattern_id", "left_semi")
           .select("investigation_id", "tenant_id", "pattern_id").distinct())
    e = hit.select("investigation_id", "tenant_id", at.alias("at"), F.lit(0).alias("seq"),
                   _event("received", "fp_governance", "reopen", None, F.col("pattern_id")).alias("e"))
    return e.select("investigation_id", "tenant_id", "at", "seq", "e.*")


def fold(log: DataFrame) -> DataFrame:
    """The log in order with ``from_state`` (the case's state before the event) and ``applied``: whether that state allows the event. Events of
    one time go by ``seq``, then by name."""
    spark = log.sparkSession
    ship_package(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (log.select(*LOG_COLS).where(F.col("investigation_id").isNotNull()).repartition(n, "investigation_id")
            .sortWithinPartitions("investigation_id", "at", "seq", "agent", "action"))
    schema = T.StructType([*rows.schema.fields, T.StructField("from_state", T.StringType()), T.StructField("applied", T.BooleanType())])

    code = {s: i for i, s in enumerate(STATES, 1)}  # 0: no state yet; -1: a name that is none of them
    allowed = [{code[to] for to in ALLOWED[s]} for s in ("", *STATES)]
    names = pa.array(["", *STATES])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Only the case's number within the batch and the state's code become Python values; the other columns pass as they are.
        case, state = None, 0
        for batch in it:
            ids = batch.column("investigation_id")
            to = pc.fill_null(pc.index_in(batch.column("to_state"), names), -1).to_pylist()
            new = [ids[0].as_py() != case, *pc.not_equal(ids[1:], ids[:-1]).to_pylist()] if len(ids) else []
            before, applied = [], []
            for first, t in zip(new, to):
                if first:
                    state = 0
                before.append(state)
                ok = t in allowed[state]
                applied.append(ok)
                if ok:
                    state = t
            case = ids[-1].as_py() if len(ids) else case
            from_state = names.take(pa.array(before, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, from_state, pa.array(applied, pa.bool_())], [*batch.schema.names, "from_state", "applied"])

    return rows.mapInArrow(run, schema)


def current_states(folded: DataFrame) -> DataFrame:
    """One row per case: its state, since when, events applied and refused, and how often it was opened again."""
    done = F.col("applied")
    last = F.max_by(F.struct("to_state", "at"), F.when(done, F.struct("at", "seq", "agent", "action")))
    g = folded.groupBy("investigation_id", "tenant_id").agg(last.alias("l"), F.count_if(done).alias("events"), F.count_if(~done).alias("refused"),
                                                            F.count_if(done & (F.col("to_state") == "received") & (F.col("from_state") != "")).alias("reopened"))
    return g.select("investigation_id", "tenant_id", F.col("l.to_state").alias("state"), F.col("l.at").alias("since"), "events", "refused", "reopened")


CHARS_PER_TOKEN, SIMILAR = 4, 5


def case_facts(states: DataFrame, entities: DataFrame, iocs: DataFrame, techniques: DataFrame, similar: DataFrame) -> DataFrame:
    """A-34: the facts of each case handed to reasoning: entity values (investigation_id, value), IOC hits (investigation_id, type, value),
    techniques (investigation_id, technique_id), its first ``SIMILAR`` similar incidents (investigation_id, incident_id, title, rank) and the token
    estimate of their JSON. Lists are of one case, sorted and distinct."""
    def lists(df, cols, name):
        v = F.col(cols[0]) if len(cols) == 1 else F.struct(*cols)
        return df.groupBy("investigation_id").agg(F.array_sort(F.collect_set(v)).alias(name))
    top = similar.withColumn("_r", F.row_number().over(Window.partitionBy("investigation_id").orderBy("rank", "incident_id"))).where(F.col("_r") <= SIMILAR)
    j = states.select("investigation_id", "tenant_id", "state")
    for df, cols, name in ((entities, ["value"], "entities"), (iocs, ["type", "value"], "iocs"), (techniques, ["technique_id"], "techniques"),
                           (top, ["incident_id", "title"], "similar_incidents")):
        j = j.join(lists(df, cols, name), "investigation_id", "left")
    j = j.select("investigation_id", "tenant_id", "state", *[F.coalesce(c, F.array().cast(j.schema[c].dataType)).alias(c) for c in
                                                             ("entities", "iocs", "techniques", "similar_incidents")])
    facts = F.to_json(F.struct("entities", "iocs", "techniques", "similar_incidents"))
    return j.withColumn("token_estimate", F.floor(F.length(facts) / CHARS_PER_TOKEN).cast("bigint"))
