"""The classification's plan."""

from __future__ import annotations

from coffer import registry


def test_catalogue_is_sent_and_not_the_texts(spark):
    """The driver holds what is broadcast: the catalogue, never the merchants' texts."""
    frame = registry.QUERIES["cls_classify"](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().sparkPlan().toString()
    join = next(line for line in plan.splitlines() if "Join [word#" in line)
    assert "BroadcastHashJoin" in join and "BuildRight" in join
