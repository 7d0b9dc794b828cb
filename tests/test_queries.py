import os

import pytest
from compare import both

from kinotable import registry as queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_agrees_with_its_sql(spark, name):
    got, want = both(spark, SF, queries.QUERIES[name], queries.ORACLES[name])
    assert got == want
    assert want or name == "slow_transitions"


def test_a_day_of_exactly_the_limit_is_no_zero_frame(spark, tmp_path):
    days = [(1, 1, 20.0), (1, 2, 19.99), (1, 3, 20.01), (2, 1, 20.0), (3, None, 5.0), *[(3, d, 1.0) for d in range(1, 13)]]
    rows = [(n, None if d is None else f"2024-01-{d:02} 01:00:00", u, v) for n, (u, d, v) in enumerate(days)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "value").coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "events.parquet")
    got, want = both(spark, str(tmp_path), queries.QUERIES["zero_frames"], queries.ORACLES["zero_frames"])
    assert got == want and len(want) == 2
