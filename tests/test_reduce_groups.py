"""Distinct values by key reach the grouped reducer once each."""

from millrace.operators import jobs
from millrace.plans import queries


def test_groups_hold_each_value_once(spark, tmp_path, monkeypatch):
    rows = [(1, "view")] * 500 + [(1, "click"), (2, None), (None, "view"), (None, "view")]
    spark.createDataFrame(rows, "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    seen, reduce_groups = [], jobs.reduce_groups
    monkeypatch.setattr(jobs, "reduce_groups", lambda pairs, *rest: seen.append(pairs.count()) or reduce_groups(pairs, *rest))
    out = queries.QUERIES["e2_reduce_groups"](spark, str(tmp_path)).collect()
    assert {(r.key, r.kinds) for r in out} == {(1, 2), (2, 0), (None, 1)} and len(out) == 3
    assert seen == [4]
