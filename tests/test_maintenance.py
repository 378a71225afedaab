from heronlake.plans import maintenance, registry


def test_run_logs_and_goes_on(spark, tmp_path):
    out = f"file://{tmp_path}/run"
    log = {r.step: r for r in maintenance.run(spark, "/root/testdata/sf0.001", out, ("story_metadata", "no such step", "consensus", "cost_summary"), {"cost_summary"}).collect()}
    assert [log[s].status for s in ("story_metadata", "no such step", "consensus", "cost_summary")] == ["ok", "failed", "ok", "skipped"]
    assert spark.read.parquet(f"{out}/story_metadata").count() == 10


def test_steps_are_registered():
    assert set(maintenance.STEPS) <= set(registry.queries())
