from __future__ import annotations

import pytest

from quayside.session import scratch_path
from quayside.sources import ledger_table
from quayside.streaming import tail
from tests.test_sources import event_batch


def test_follower_takes_each_event_once_and_stops_at_a_hole(spark):
    base = scratch_path(spark, "tail")
    path, target, position = f"{base}/ledger", f"{base}/seen", f"{base}/position"
    ledger_table.create(spark, path)

    def follow():
        query = tail.follow(spark, path, target, position)
        query.awaitTermination(120)

    def seen():
        return sorted((r.scope, r.sequence, r.event_type) for r in tail.seen_events(spark, target).collect())

    ledger_table.append(spark, path, event_batch(spark, [(0, "a", "n", "X", "{}"), (1, "b", "n", "X", "{}")]), "at")
    follow()
    assert seen() == [("a", 1, "X"), ("b", 1, "X")]
    ledger_table.append(spark, path, event_batch(spark, [(0, "a", "n", "Y", "{}")]), "at")
    follow()
    follow()
    assert seen() == [("a", 1, "X"), ("a", 2, "Y"), ("b", 1, "X")]
    hole = event_batch(spark, [(0, "a", "n", "Z", "{}")]).drop("at").selectExpr("*", "9L AS sequence", "'00' AS shard", "'event' AS kind")
    hole.write.partitionBy("shard", "kind").mode("append").parquet(path)
    with pytest.raises(Exception, match="continue"):
        follow()
    assert len(seen()) == 3
