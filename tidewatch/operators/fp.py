"""False-positive pattern lifecycle: candidates, matching, kill switches, evaluation,
drift, sampling, shadow/canary agreement and governance (A-24..A-31, J-08..J-11,
W-05, W-06, P-31..P-36).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from re import _parser as _regex_parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import address_key, col_type, network_range, shift, stable_order_key, time_lit
from tidewatch.session import checkpoint_dir, ship_package

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference)
# ---------------------------------------------------------------------------
MIN_INVESTIGATIONS_FOR_FP = 3
MIN_INVESTIGATIONS_FOR_PLAYBOOK = 2
CANDIDATE_LOOKBACK_DAYS = 30
FP_CONFIDENCE_THRESHOLD = 0.90
ELEVATED_THRESHOLD = 0.95
MATCHABLE_STATUSES = ("approved", "active")
PRECISION_TARGET, RECALL_TARGET, FNR_CEILING = 0.98, 0.95, 0.005
THRESHOLD_STEP, THRESHOLD_CAP = 0.02, 0.99
DRIFT_WEIGHTS = {"source": 0.4, "technique": 0.35, "entity": 0.25}
DRIFT_THRESHOLD = 0.3
MIN_PER_STRATUM = 30
NOVEL_DAYS = 30
CANARY_MIN_DECISIONS, CANARY_MAX_DISAGREEMENT = 50, 0.05
DONE_STATUSES = ("expired", "revoked", "deprecated")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# A-30 / A-31 candidates
# ---------------------------------------------------------------------------

def fp_candidates(inv: DataFrame, now, *, lookback_days: int = CANDIDATE_LOOKBACK_DAYS,
                  min_members: int = MIN_INVESTIGATIONS_FOR_FP, title_chars: int | None = None) -> DataFrame:
    """A-30: closed false positives of the lookback, grouped by tenant and title; a row for each member
    of a group with ``min_members`` or more: (tenant_id, group_key, investigation_count, investigation_id).

    ``title_chars`` groups by a title prefix instead (the reference's form: 50). The counts are
    partial aggregates joined back by the group, so no group is collected."""
    dt = col_type(inv, "updated_at")
    title = F.substring("alert_title", 1, title_chars) if title_chars else F.col("alert_title")
    base = (inv.where((F.col("state") == "closed") & (F.col("updated_at") >= time_lit(shift(now, days=lookback_days), dt))
                      & (F.col("updated_at") < time_lit(now, dt)) & (F.col("classification") == "false_positive"))
            .select("tenant_id", F.coalesce(title, F.lit("unknown")).alias("group_key"), "investigation_id"))
    counts = (base.groupBy("tenant_id", "group_key").agg(F.count(F.lit(1)).alias("investigation_count"))
              .where(F.col("investigation_count") >= min_members))
    return base.join(counts, ["tenant_id", "group_key"])


def playbook_candidates(inv: DataFrame, now, *, lookback_days: int = CANDIDATE_LOOKBACK_DAYS,
                        min_members: int = MIN_INVESTIGATIONS_FOR_PLAYBOOK) -> DataFrame:
    """A-31: closed, not false positive, grouped by tenant and first technique; >= 2 members."""
    dt = col_type(inv, "updated_at")
    base = (inv.where((F.col("state") == "closed") & (F.col("updated_at") >= time_lit(shift(now, days=lookback_days), dt))
                      & (F.col("updated_at") < time_lit(now, dt)) & (F.col("classification") != "false_positive"))
            .select("tenant_id", F.coalesce(F.element_at("atlas_techniques", 1), F.lit("unknown")).alias("technique"),
                    "investigation_id"))
    return (base.groupBy("tenant_id", "technique").agg(F.count(F.lit(1)).alias("investigation_count"))
            .where(F.col("investigation_count") >= min_members))


# ---------------------------------------------------------------------------
# J-08 / J-09 / T-18 / P-31 matching
# ---------------------------------------------------------------------------

#: Case-insensitive beyond ASCII, with Unicode classes, as the reference's language matches.
RE_FLAGS = "(?iuU)"


def valid_regex(pattern: Column) -> Column:
    """Java ``Pattern.compile`` on the executors; NULL pattern text or a compile error -> false."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def anchored_match(text: Column, pattern: Column) -> Column:
    """``re.match(p, text, IGNORECASE)``: anchored at the start only; invalid pattern -> no match."""
    safe = F.when(valid_regex(pattern), pattern).otherwise(F.lit("(?!)"))
    return F.coalesce(F.regexp_like(F.coalesce(text, F.lit("")), F.concat(F.lit(RE_FLAGS + "^(?:"), safe, F.lit(")"))),
                      F.lit(False))


def scope_matches(pattern_family: Column, pattern_tenant: Column, pattern_asset: Column,
                  family: Column, tenant: Column, asset_class: Column) -> Column:
    """P-31: empty scope = global, otherwise equality, on three dimensions."""
    def ok(s, v):
        return F.coalesce(s, F.lit("")).eqNullSafe("") | (s == v)
    return ok(pattern_family, family) & ok(pattern_tenant, tenant) & ok(pattern_asset, asset_class)


def prepare_patterns(patterns: DataFrame) -> DataFrame:
    """Validate and anchor every regex ONCE per pattern row (the small side), and turn networks
    into address ranges, so the per-(alert, pattern) work is a plain match and two comparisons.
    A malformed regex or network matches nothing."""
    def anchor(r):
        ok = (F.coalesce(r, F.lit("")) != "") & valid_regex(r)
        return F.when(ok, F.concat(F.lit(RE_FLAGS + "^(?:"), r, F.lit(")")))

    def check(ep):
        net = network_range(ep["value_cidr"])
        return F.struct(ep["type"].alias("type"), anchor(ep["value_regex"]).alias("re"), net["lo"].alias("lo"), net["hi"].alias("hi"))
    eps = F.coalesce("entity_patterns", F.array().cast("array<struct<type:string,value_regex:string,value_cidr:string>>"))
    return patterns.withColumn("title_re", anchor(F.col("alert_name_regex"))).withColumn("entity_checks", F.transform(eps, check))


def parse_entities(entities: Column) -> Column:
    """MAP<type, ARRAY<value>> -> MAP<type, ARRAY<STRUCT<v, ip>>> with the address parsed once."""
    return F.transform_values(entities, lambda k, arr: F.transform(
        arr, lambda v: F.struct(v.alias("v"), address_key(v).alias("ip"))))


def entity_score(checks: Column, entities: Column) -> Column:
    """Share of entity patterns matched by at least one entity value of the pattern's type
    (anchored regex, or an IPv4/IPv6 address in the network). ``entities`` comes from ``parse_entities``."""
    def hit(ep):
        vals = F.coalesce(entities[F.concat(ep["type"], F.lit("s"))], entities[ep["type"]],
                          F.array().cast("array<struct<v:string,ip:string>>"))

        def one(e):
            by_re = ep["re"].isNotNull() & F.coalesce(F.regexp_like(e["v"], ep["re"]), F.lit(False))
            by_cidr = ep["lo"].isNotNull() & F.coalesce((e["ip"] >= ep["lo"]) & (e["ip"] <= ep["hi"]), F.lit(False))
            return by_re | by_cidr
        return F.exists(vals, one)
    n = F.size(checks)
    return F.when(n > 0, F.aggregate(checks, F.lit(0), lambda acc, ep: acc + F.when(hit(ep), 1).otherwise(0)) / n) \
        .otherwise(F.lit(0.0))


def kill_switch_filter(alerts: DataFrame, kills: DataFrame, dims: Mapping[str, str]) -> DataFrame:
    """J-09: drop alerts where any dimension value is switched off.

    ``kills`` has (dimension, value, active); ``dims`` maps dimension -> alert column. One
    anti-join per dimension against its few switches: Spark broadcasts them by its own size check, so
    the alerts are not shuffled.
    """
    active = kills.where(F.col("active")).select("dimension", "value")
    out = alerts
    for d, c in dims.items():
        off = active.where(F.col("dimension") == d).select(F.col("value").alias("_off"))
        out = out.join(off, F.col(c).cast("string") == F.col("_off"), "left_anti")
    return out


def required_literals(pattern: str | None) -> list[str]:
    """Texts, in lower case, that every match of a regex holds: runs of plain ASCII characters on its one path, outside
    alternatives, options and look-arounds. Empty for what another dialect's parser does not read, or reads in another mode."""
    try:
        tree = _regex_parser.parse(pattern or "", re.IGNORECASE)
    except (re.error, RecursionError, OverflowError):
        return []
    if tree.state.flags & re.VERBOSE:
        return []
    runs, run = [], []

    def walk(items):
        for op, arg in items:
            op = str(op)
            if op == "LITERAL" and 32 <= arg < 127:
                run.append(chr(arg))
            elif op == "SUBPATTERN" and not arg[1] & re.VERBOSE and not arg[2]:
                walk(arg[3])
            elif op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
                end()
                walk(arg[2])
                end()
            elif op != "AT":
                end()

    def end():
        if run:
            runs.append("".join(run).lower())
            run.clear()

    walk(tree)
    end()
    return runs


#: Characters beyond ASCII that a case-insensitive match takes for an ASCII letter, and that letter.
FOLDED = ("\u0130\u0131\u017f\u212a", "iisk")
GRAM = 3


def folded(text: Column) -> Column:
    return F.lower(F.translate(text, *FOLDED))


def grams(text: Column) -> Column:
    """The distinct trigrams of a text."""
    n = F.length(text)
    return F.when(n >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), n - (GRAM - 1)), lambda i: text.substr(i, F.lit(GRAM)))))


def _literals_of(patterns: DataFrame) -> DataFrame:
    """``literals``: the texts of ``GRAM`` characters or more that a pattern's title must hold. Patterns are the small side."""
    ship_package(patterns.sparkSession)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(literals=[[x for x in required_literals(r) if len(x) >= GRAM] for r in pdf["alert_name_regex"]])
    keep = patterns.select("tenant_id", "pattern_id", "alert_name_regex").where("alert_name_regex is not null").distinct()
    return keep.mapInPandas(run, "tenant_id string, pattern_id string, alert_name_regex string, literals array<string>")


def title_candidates(titles: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pairs (tenant_id, title, pattern_id, title_re, indexed) that could match. ``titles``: distinct (tenant_id, title);
    ``patterns`` come from ``prepare_patterns``.

    A pattern with a literal is looked up in the trigram index of its tenant's titles by the rarest trigram of its longest
    literal: one key a pattern, and none if a trigram of it occurs in no title. Patterns without a literal of three
    characters meet all titles of their tenant (``indexed`` false); a malformed regex meets none."""
    lit = _literals_of(patterns).select("tenant_id", "pattern_id", "alert_name_regex", "literals")
    p = (patterns.where(F.col("title_re").isNotNull()).select("tenant_id", "pattern_id", "alert_name_regex", "title_re")
         .join(lit, ["tenant_id", "pattern_id", "alert_name_regex"]))
    longest = F.element_at(F.array_sort("literals", lambda x, y: F.length(x) - F.length(y)), -1)
    index = titles.select("tenant_id", "title", F.explode(grams(folded(F.col("title")))).alias("gram"))
    keys = p.where(F.size("literals") > 0).select("tenant_id", "pattern_id", "title_re", "literals", F.explode(grams(longest)).alias("gram"))
    held = index.join(keys.select("tenant_id", "gram").distinct(), ["tenant_id", "gram"], "left_semi").groupBy("tenant_id", "gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = (keys.join(held, ["tenant_id", "gram"], "left").groupBy("tenant_id", "pattern_id", "title_re", "literals")
              .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("k")).where("k.df > 0")
              .select("tenant_id", "pattern_id", "title_re", "literals", F.col("k.gram").alias("gram")))
    found = (index.join(rarest, ["tenant_id", "gram"]).where(F.forall("literals", lambda x: F.contains(folded(F.col("title")), x)))
             .select("tenant_id", "title", "pattern_id", "title_re", F.lit(True).alias("indexed")))
    rest = titles.join(p.where(F.size("literals") == 0).select("tenant_id", "pattern_id", "title_re"), "tenant_id")
    return found.unionByName(rest.select("tenant_id", "title", "pattern_id", "title_re", F.lit(False).alias("indexed")))


def _matchable(patterns: DataFrame, killed_patterns: DataFrame | None) -> DataFrame:
    p = patterns.where(F.col("status").isin(*MATCHABLE_STATUSES))
    if killed_patterns is not None:
        p = p.join(killed_patterns.select("pattern_id"), "pattern_id", "left_anti")
    return prepare_patterns(p)


def candidate_report(alerts: DataFrame, patterns: DataFrame) -> DataFrame:
    """J-08's work per tenant: titles, patterns, all their pairs, the pairs that reach a regex (by the index, and without a literal) and those that match."""
    p = _matchable(patterns, None).where(F.col("title_re").isNotNull())
    titles = alerts.select("tenant_id", F.coalesce("alert_title", F.lit("")).alias("title")).distinct()
    c = title_candidates(titles, p).groupBy("tenant_id").agg(
        F.count_if("indexed").alias("indexed_pairs"), F.count_if(~F.col("indexed")).alias("unindexed_pairs"),
        F.count_if(F.regexp_like("title", F.col("title_re"))).alias("matches"))
    n = titles.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("titles"))
    m = p.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("patterns"))
    out = n.join(m, "tenant_id").join(c, "tenant_id", "left").fillna(0, ["indexed_pairs", "unindexed_pairs", "matches"])
    return out.select("tenant_id", "titles", "patterns", (F.col("titles") * F.col("patterns")).alias("all_pairs"), "indexed_pairs", "unindexed_pairs", "matches")


def match_fp_patterns(alerts: DataFrame, patterns: DataFrame, *, threshold: float | Column = FP_CONFIDENCE_THRESHOLD,
                      killed_patterns: DataFrame | None = None) -> DataFrame:
    """J-08: best matching approved/active pattern per alert (confidence >= threshold).

    Patterns are tenant-scoped. Confidence is the title's score, or with entity checks its mean with theirs; both are at
    most 1, so a threshold above 0.5 needs the title to match: the tenants' distinct titles are matched through a trigram
    index (``title_candidates``), and only the alerts of a matched title meet its patterns, whose entity checks run
    on them. With a lower or a column threshold every alert meets the patterns of its tenant.
    Ties: highest confidence, then lowest pattern_id (Q13). Threshold comparison is >= (Q14).
    """
    checkpoint_dir(alerts.sparkSession)
    p = _matchable(patterns, killed_patterns).checkpoint()  # the small side, read several times
    scopes = ["scope_rule_family", "scope_tenant_id", "scope_asset_class"]
    title = F.coalesce("alert_title", F.lit(""))
    a = alerts.select("alert_id", "tenant_id", title.alias("title"), "entities", "rule_family", "asset_class")
    if not isinstance(threshold, Column) and threshold > 0.5:
        hits = (title_candidates(a.select("tenant_id", "title").distinct(), p).where(F.regexp_like("title", F.col("title_re")))
                .select("tenant_id", "title", "pattern_id", "title_re")).checkpoint()
        own = p.select("tenant_id", "pattern_id", "title_re", "entity_checks", *scopes)
        # Addresses are parsed once an alert, and only where its title matched.
        a = a.join(hits.select("tenant_id", "title").distinct(), ["tenant_id", "title"], "left_semi").withColumn("entities", parse_entities(F.col("entities")))
        # By merge: alerts with their maps look small enough to send to every task, and would pass through the driver.
        j = a.hint("merge").join(hits.join(own, ["tenant_id", "pattern_id", "title_re"]), ["tenant_id", "title"]).withColumn("_title", F.lit(1.0))
    else:
        a = a.withColumn("entities", parse_entities(F.col("entities")))
        j = a.join(p.select("tenant_id", "pattern_id", "title_re", "entity_checks", *scopes), "tenant_id")
        j = j.withColumn("_title", F.when(F.coalesce(F.regexp_like("title", F.col("title_re")), F.lit(False)), 1.0).otherwise(0.0))
    j = j.where(scope_matches(F.col("scope_rule_family"), F.col("scope_tenant_id"), F.col("scope_asset_class"),
                              F.col("rule_family"), F.col("tenant_id"), F.col("asset_class")))
    conf = F.when(F.size("entity_checks") == 0, F.col("_title")) \
        .otherwise((F.col("_title") + entity_score(F.col("entity_checks"), F.col("entities"))) / 2)
    scored = j.select("alert_id", "tenant_id", "pattern_id", conf.alias("confidence")) \
        .where(F.col("confidence") >= (threshold if isinstance(threshold, Column) else F.lit(threshold)))
    best = scored.groupBy("alert_id", "tenant_id").agg(
        F.min(F.struct((-F.col("confidence")).alias("nc"), F.col("pattern_id").alias("pid"))).alias("b"))
    return best.select("alert_id", "tenant_id", F.col("b.pid").alias("pattern_id"),
                       (-F.col("b.nc")).alias("confidence"))


# ---------------------------------------------------------------------------
# A-24 / A-29 evaluation, J-10 escalated closures
# ---------------------------------------------------------------------------

def evaluate_closures(closures: DataFrame, family: str = "rule_family") -> DataFrame:
    """A-24: per family TP/FP/FN counts, precision, recall, FNR (empty denominators 1, 1, 0).

    ``closures`` has boolean ``auto_closed`` and ``truly_fp``.
    """
    g = closures.groupBy(family).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("auto_closed") & F.col("truly_fp")).alias("true_positives"),
        F.count_if(F.col("auto_closed") & ~F.col("truly_fp")).alias("false_positives"),
        F.count_if(~F.col("auto_closed") & F.col("truly_fp")).alias("false_negatives"))
    tp, fp_, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return g.select("*", F.when(tp + fp_ > 0, tp / (tp + fp_)).otherwise(1.0).alias("precision"),
                    F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0).alias("recall"),
                    F.when(tp + fn > 0, fn / (fn + tp)).otherwise(0.0).alias("fnr"))


def autonomy_threshold(evaluation: DataFrame, current: float = FP_CONFIDENCE_THRESHOLD) -> DataFrame:
    """A-29: +0.02 per violated target (precision < .98, FNR > .005), capped at .99."""
    bump = (F.when(F.col("precision") < PRECISION_TARGET, THRESHOLD_STEP).otherwise(0.0)
            + F.when(F.col("fnr") > FNR_CEILING, THRESHOLD_STEP).otherwise(0.0))
    return evaluation.withColumn("reduce_autonomy", bump > 0) \
        .withColumn("threshold", F.least(F.lit(THRESHOLD_CAP), F.lit(current) + bump))


def escalated_closures(closures: DataFrame, escalations: DataFrame, key: str = "alert_id") -> DataFrame:
    """J-10: auto-closed alerts that another source later escalated (semi-join) -> flagged for review."""
    return (closures.join(escalations.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")
            .withColumn("fn_flagged", F.lit(True)).withColumn("review_status", F.lit("pending_review")))


# ---------------------------------------------------------------------------
# A-27 / A-28 drift
# ---------------------------------------------------------------------------

def js_divergence(counts: DataFrame, key: str, current: str = "current", baseline: str = "baseline") -> DataFrame:
    """A-27: Jensen-Shannon divergence (log2, clamped 0..1, no keys -> 0) of two count columns.

    The totals are a one-row aggregate crossed onto the keys (a proven single row).
    """
    tot = counts.agg(F.sum(current).alias("_ta"), F.sum(baseline).alias("_tb"), F.count(F.lit(1)).alias("_k"))
    j = counts.crossJoin(F.broadcast(tot))
    ta = F.when(F.col("_ta") > 0, F.col("_ta")).otherwise(F.lit(1))
    tb = F.when(F.col("_tb") > 0, F.col("_tb")).otherwise(F.lit(1))
    p, q = F.col(current) / ta, F.col(baseline) / tb
    m = (p + q) / 2

    def kl(x):
        return F.when((x > 0) & (m > 0), x * F.log2(x / m)).otherwise(F.lit(0.0))
    s = j.agg(F.sum(0.5 * kl(p) + 0.5 * kl(q)).alias("jsd"))
    return s.select(F.least(F.greatest(F.coalesce(F.col("jsd"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("jsd"))


def window_counts(df: DataFrame, key: Column, ts: str, now, window_days: int = 7, baseline_days: int = 30) -> DataFrame:
    """Counts per key in the current window and the preceding baseline, one scan."""
    dt = col_type(df, ts)
    cur_start = shift(now, days=window_days)
    base_start = shift(cur_start, days=baseline_days)
    cur = F.col(ts) >= time_lit(cur_start, dt)
    return (df.where((F.col(ts) >= time_lit(base_start, dt)) & (F.col(ts) < time_lit(now, dt)))
            .groupBy(key.alias("key")).agg(F.count_if(cur).alias("current"), F.count_if(~cur).alias("baseline")))


def overall_drift(source: DataFrame, technique: DataFrame, entity: DataFrame,
                  threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """A-28: weighted drift of three JSD rows, flag, and the FP threshold it implies."""
    j = (source.select(F.col("jsd").alias("source_drift"))
         .crossJoin(technique.select(F.col("jsd").alias("technique_drift")))
         .crossJoin(entity.select(F.col("jsd").alias("entity_drift"))))
    overall = (F.lit(DRIFT_WEIGHTS["source"]) * F.col("source_drift")
               + F.lit(DRIFT_WEIGHTS["technique"]) * F.col("technique_drift")
               + F.lit(DRIFT_WEIGHTS["entity"]) * F.col("entity_drift"))
    return (j.withColumn("overall_drift", overall).withColumn("threshold_exceeded", F.col("overall_drift") > threshold)
            .withColumn("fp_threshold", F.when(F.col("threshold_exceeded"), ELEVATED_THRESHOLD)
                        .otherwise(FP_CONFIDENCE_THRESHOLD)))


# ---------------------------------------------------------------------------
# W-05 / W-06 sampling, P-42 novelty
# ---------------------------------------------------------------------------

def stratified_sample(closures: DataFrame, now, *, strata: Sequence[str] = ("rule_family", "severity",
                                                                            "asset_criticality"),
                      min_per_stratum: int = MIN_PER_STRATUM, quota_col: str | None = None, max_quota: int | None = None,
                      seed: int = 42, id_col: str = "alert_id", novel_days: int = NOVEL_DAYS) -> DataFrame:
    """W-05: every closure of a novel pattern (< 30 days old) plus non-novel ones, in a repeatable
    hash order, up to ``min_per_stratum - novel`` per stratum (Q17: no random sampling).

    ``quota_col`` gives the quota per row instead (W-06), at most ``max_quota``. Novel rows are counted, not ranked; of
    the others only the first ``max_quota`` of a stratum can be taken, so each task keeps that many before
    the shuffle (window group limit) and no task sees a whole stratum.
    """
    dt = col_type(closures, "pattern_created_at")
    novel = F.coalesce(F.col("pattern_created_at") > time_lit(shift(now, days=novel_days), dt), F.lit(False))
    most = max_quota or min_per_stratum
    c = closures.withColumn("is_novel", novel)
    counts = c.groupBy(*[F.col(s).alias(f"_{s}") for s in strata]).agg(F.count_if("is_novel").alias("n_novel"))
    same = reduce(lambda x, y: x & y, [F.col(s).eqNullSafe(F.col(f"_{s}")) for s in strata])
    w = Window.partitionBy(*strata).orderBy(stable_order_key(seed, F.col(id_col)), F.col(id_col))
    rest = c.where(~F.col("is_novel")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    quota = F.col(quota_col) if quota_col else F.lit(min_per_stratum)
    filled = rest.join(counts, same).where(F.col("_r") <= F.greatest(F.lit(0), quota - F.col("n_novel"))).drop("_r")
    out = c.where("is_novel").join(counts, same).unionByName(filled)
    return out.drop(*[f"_{s}" for s in strata])


def family_drift(counts: DataFrame, by: str, current: str = "current", baseline: str = "baseline",
                 threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """W-06 input: A-27's divergence computed per ``by`` group (e.g. rule family) and whether it
    exceeds the drift threshold. Totals are one row per group, joined back on the group key."""
    tot = counts.groupBy(by).agg(F.sum(current).alias("_ta"), F.sum(baseline).alias("_tb"))
    j = counts.join(tot, by)
    ta = F.when(F.col("_ta") > 0, F.col("_ta")).otherwise(F.lit(1))
    tb = F.when(F.col("_tb") > 0, F.col("_tb")).otherwise(F.lit(1))
    p, q = F.col(current) / ta, F.col(baseline) / tb
    m = (p + q) / 2

    def kl(x):
        return F.when((x > 0) & (m > 0), x * F.log2(x / m)).otherwise(F.lit(0.0))
    s = j.groupBy(by).agg(F.sum(0.5 * kl(p) + 0.5 * kl(q)).alias("jsd"))
    s = s.withColumn("jsd", F.least(F.greatest(F.coalesce(F.col("jsd"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    return s.withColumn("drifted", F.col("jsd") > threshold)


def drift_quota(families: DataFrame, affected: DataFrame, base: int = MIN_PER_STRATUM, factor: int = 2) -> DataFrame:
    """W-06: sample quota per family, doubled for families the drift check flagged."""
    a = affected.select(F.col("rule_family"), F.lit(True).alias("_aff")).distinct()
    return families.join(a, "rule_family", "left").select(
        "*", F.when(F.coalesce("_aff", F.lit(False)), base * factor).otherwise(base).alias("quota")).drop("_aff")


# ---------------------------------------------------------------------------
# J-11 / A-25 / A-26 shadow and canary agreement, P-34, P-35
# ---------------------------------------------------------------------------

def shadow_pairs(decisions: DataFrame) -> DataFrame:
    """J-11: last shadow and last analyst decision per investigation (max_by ts), inner-joined."""
    last = (decisions.groupBy("tenant_id", "rule_family", "investigation_id", "type")
            .agg(F.max_by("decision", F.struct("ts", "decision")).alias("decision"), F.max("ts").alias("ts")))
    s = last.where(F.col("type") == "shadow").select("tenant_id", "rule_family", "investigation_id",
                                                     F.col("decision").alias("shadow_decision"), F.col("ts").alias("shadow_ts"))
    a = last.where(F.col("type") == "analyst").select("tenant_id", "rule_family", "investigation_id",
                                                      F.col("decision").alias("analyst_decision"), F.col("ts").alias("analyst_ts"))
    return s.join(a, ["tenant_id", "rule_family", "investigation_id"])


def agreement_rate(pairs: DataFrame, now, window_days: int = 14, keys: Sequence[str] = ("tenant_id", "rule_family")) -> DataFrame:
    """A-26: agreement per tenant/family over pairs whose shadow decision falls in the window."""
    dt = col_type(pairs, "shadow_ts")
    p = pairs.where((F.col("shadow_ts") >= time_lit(shift(now, days=window_days), dt)) & (F.col("shadow_ts") < time_lit(now, dt)))
    return p.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"),
                                F.avg((F.col("shadow_decision") == F.col("analyst_decision")).cast("double")).alias("agreement_rate"))


def canary_agreement(pairs: DataFrame, pattern_col: str = "pattern_id", *, min_decisions: int = CANARY_MIN_DECISIONS,
                     max_disagreement: float = CANARY_MAX_DISAGREEMENT) -> DataFrame:
    """A-25: per pattern total/agree/disagree/rate and the promotion verdict."""
    g = pairs.groupBy(pattern_col).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("shadow_decision") == F.col("analyst_decision")).alias("agree"))
    g = g.withColumn("disagree", F.col("total") - F.col("agree")) \
        .withColumn("disagreement_rate", F.when(F.col("total") > 0, F.col("disagree") / F.col("total")).otherwise(0.0))
    return g.withColumn("promote", (F.col("total") >= min_decisions) & (F.col("disagreement_rate") <= max_disagreement))


def canary_decision(slices: DataFrame, evaluation: DataFrame, now, *, min_age_days: int = 7) -> DataFrame:
    """P-34/J-19: slice ⟕ evaluation (defaults precision 1, missed 0) -> rollback / promote / continue."""
    e = evaluation.select("slice_id", "precision", "missed")
    j = slices.join(e, "slice_id", "left").withColumn("precision", F.coalesce("precision", F.lit(1.0))) \
        .withColumn("missed", F.coalesce("missed", F.lit(0)))
    dt = col_type(slices, "created_at")
    old_enough = F.col("created_at") <= time_lit(shift(now, days=min_age_days), dt)
    return j.withColumn("decision", F.when((F.col("missed") > 0) | (F.col("precision") < 0.95), "rollback")
                        .when(old_enough & (F.col("precision") >= PRECISION_TARGET), "promote").otherwise("continue"))


def go_live_unmet(metrics: DataFrame, *, min_agreement: float = 0.95, min_decisions: int = 100,
                  min_window_days: int = 14, max_fnr: float = FNR_CEILING) -> DataFrame:
    """P-35: list of unmet go-live criteria per row (Q16: the window length is checked too)."""
    reasons = F.array_compact(F.array(
        F.when(F.col("agreement_rate") < min_agreement, F.lit(f"agreement_rate < {min_agreement}")),
        F.when(F.col("pairs") < min_decisions, F.lit(f"decisions < {min_decisions}")),
        F.when(F.col("window_days") < min_window_days, F.lit(f"window_days < {min_window_days}")),
        F.when(F.col("fnr") > max_fnr, F.lit(f"fnr > {max_fnr}"))))
    return metrics.withColumn("unmet", reasons).withColumn("ready", F.size("unmet") == 0)


# ---------------------------------------------------------------------------
# P-32 / P-33 governance
# ---------------------------------------------------------------------------

def expired_patterns(patterns: DataFrame, now) -> DataFrame:
    """P-32: past expiry and not already expired/revoked/deprecated."""
    dt = col_type(patterns, "expiry_date")
    return patterns.where((F.col("expiry_date") < time_lit(now, dt)) & ~F.col("status").isin(*DONE_STATUSES))


EXPIRY_DAYS = 90


def pattern_status_from_events(events: DataFrame, now) -> DataFrame:
    """P-32: fold governance events (pattern_id, event in approve/reaffirm/revoke, actor, ts) into a status.

    Approved at the first approval by a second, distinct approver; valid for 90 days from then or from the
    latest reaffirmation after it (which also revives an expired pattern); revoked for good by a revocation. A
    pattern's approvers are collected (a handful of people), its events are not.
    """
    dt = col_type(events, "ts")
    firsts = events.where(F.col("event") == "approve").groupBy("pattern_id", "actor").agg(F.min("ts").alias("at"))
    approved = firsts.groupBy("pattern_id").agg(F.array_sort(F.collect_list(F.struct("at", "actor"))).alias("a")).select(
        "pattern_id", F.size("a").alias("approvers"), F.get("a", F.lit(1))["at"].alias("approved_at"))
    j = events.select("pattern_id", "event", "ts").join(approved, "pattern_id", "left")
    g = j.groupBy("pattern_id").agg(
        F.coalesce(F.max("approvers"), F.lit(0)).alias("approvers"), F.max("approved_at").alias("approved_at"),
        F.max(F.when((F.col("event") == "reaffirm") & (F.col("ts") >= F.col("approved_at")), F.col("ts"))).alias("reaffirmed_at"),
        F.max(F.when(F.col("event") == "revoke", F.col("ts"))).alias("revoked_at"))
    expiry = F.greatest("approved_at", "reaffirmed_at") + F.make_interval(days=F.lit(EXPIRY_DAYS))
    g = g.withColumn("expiry_date", F.when(F.col("approved_at").isNotNull(), expiry))
    return g.withColumn("status", F.when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("approvers") == 0, "draft")
                        .when(F.col("approved_at").isNull(), "pending_review")
                        .when(F.col("expiry_date") < time_lit(now, dt), "expired").otherwise("approved"))


def closed_by_pattern(investigations: DataFrame, revoked: DataFrame) -> DataFrame:
    """P-33: investigations auto-closed by a revoked pattern (decision chain exploded, semi-join),
    returned re-opened for re-investigation."""
    steps = investigations.select("investigation_id", F.explode("decision_chain").alias("d")) \
        .where(F.col("d.action") == "auto_close_fp").select("investigation_id", F.col("d.pattern_id").alias("pattern_id"))
    hit = steps.join(revoked.select("pattern_id"), "pattern_id", "left_semi").select("investigation_id").distinct()
    return investigations.join(hit, "investigation_id", "left_semi") \
        .withColumn("state", F.lit("received")).withColumn("reopened", F.lit(True))


def days_until_expiry(expiry: Column, now) -> Column:
    """P-17: max(0, days to expiry)."""
    return F.greatest(F.lit(0), F.datediff(expiry.cast("date"), F.lit(str(now)[:10]).cast("date")))


def pattern_summary(patterns: DataFrame, now) -> DataFrame:
    """A-33 (with P-17): total, active, pending approval and active patterns expiring within 14 days."""
    days = days_until_expiry(F.col("expiry_date"), now)
    return patterns.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "active").alias("active"),
                        F.count_if(F.col("status") == "pending_approval").alias("pending"),
                        F.count_if((F.col("status") == "active") & days.isNotNull() & (days <= 14)).alias("expiring_soon"))


def canary_cycle_summary(decisions: DataFrame) -> DataFrame:
    """A-37: slices evaluated, promotions and rollbacks of one evaluation cycle."""
    return decisions.agg(F.count(F.lit(1)).alias("slices_evaluated"),
                         F.count_if(F.col("decision") == "promote").alias("promotions"),
                         F.count_if(F.col("decision") == "rollback").alias("rollbacks"))


def shadow_summary(pairs: DataFrame) -> DataFrame:
    """A-32 (shadow part): decisions paired, agreements and the overall agreement rate."""
    return pairs.agg(F.count(F.lit(1)).alias("pairs"),
                     F.count_if(F.col("shadow_decision") == F.col("analyst_decision")).alias("agreements"),
                     F.count_distinct("tenant_id").alias("tenants")) \
        .withColumn("agreement_rate", F.when(F.col("pairs") > 0, F.col("agreements") / F.col("pairs")))


def shadow_active(items: DataFrame, config: DataFrame) -> DataFrame:
    """P-36: shadow mode applies to a (tenant, family) when the tenant has it enabled and its
    family list is empty (= all families) or contains the family."""
    c = config.select("tenant_id", F.col("shadow_enabled"), F.coalesce("shadow_families", F.array()).alias("_fams"))
    j = items.join(c, "tenant_id", "left")
    on = F.coalesce(F.col("shadow_enabled"), F.lit(False)) & (
        (F.size("_fams") == 0) | F.array_contains("_fams", F.col("rule_family")))
    return j.withColumn("shadow_active", F.coalesce(on, F.lit(False))).drop("shadow_enabled", "_fams")
