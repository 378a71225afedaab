"""The maintenance run: ordered steps, each a registered query written as a table.

A step that fails is logged and the run goes on; a finished step isn't run again when the
run is resumed.  The log is a table beside the results.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from heronlake.plans import registry

#: The order of a full run: ingest, link, group, score, clean, report.
STEPS = (
    "ingest_new_urls", "channel_ingest", "post_conversion", "content_heuristics", "candidate_pool", "content_signature_groups", "duplicate_keepers", "centroid_mean", "match_decisions", "orphan_best_match",
    "same_event_pairs", "event_components", "recount_with_zero", "story_metadata", "story_coverage_split", "blindspot_articles", "blindspot_outlets", "dispute_score", "trending_topk", "homepage_ids",
    "hourly_update_signal", "snapshot_update_signal", "consensus", "source_trust", "unrelated_articles", "reassignments", "silence_detection", "coordination_pairs", "digest_gates", "absence_detection",
    "lifecycle_states", "demote_quiet", "retention_audit", "retention_keep_set", "cost_summary", "egress_pareto", "run_baseline", "health_overview", "canary_incident_sync",
)
LOG = "step string, status string, seconds double, error string"


def run(spark: SparkSession, sf_dir: str, out: str, steps: tuple[str, ...] = STEPS, done: set[str] = frozenset()) -> DataFrame:
    """Run *steps* but those *done*; results go to ``out/<step>``.  Returns the log."""
    known, log = registry.queries(), []
    for step in steps:
        if step in done:
            log.append((step, "skipped", 0.0, None))
            continue
        began = time.time()
        try:
            known[step](spark, sf_dir).write.mode("overwrite").parquet(f"{out}/{step}")
            log.append((step, "ok", time.time() - began, None))
        except Exception as e:  # noqa: BLE001 - a run survives a failing step
            log.append((step, "failed", time.time() - began, str(e)[:500]))
    return spark.createDataFrame(log, LOG)
