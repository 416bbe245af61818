"""Every registered query is listed with its SQL, and cheap ones agree with it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from footfall.registry.base import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
QUICK = ["A5_gps", "B6_topic_choice", "C9_planar_speeds", "D2_moving_median", "E3_speed_tracking_score", "F6_euler_zyx",
         "G7_plane_fit_slope", "H9_quadratic_fit", "I10_box_statistics", "J10_difference_histogram"]


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders", "customer", "nation", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_matches_sql_on_long_recordings(spark, tmp_path, direction):
    """Samples thirty days apart meet ticks exactly, and some times have two samples: both sides take the same one."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * REPLACE (event_id + k * 1000000 AS event_id, ts + to_days(CAST(30 * (k % 6) AS INTEGER)) AS ts, value + k AS value)
        FROM '/root/testdata/sf0.01/events.parquet', range(8) r(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * EXCLUDE (k) FROM '{tmp_path}/events.parquet'")
    df = entry.queries()[f"C3_asof_{direction}"](spark, str(tmp_path)).select("mission", "i", "t", "v")
    want = con.execute(f"SELECT mission, i, t, v FROM ({entry.oracle_sql()[f'C3_asof_{direction}']})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_robot_summary_matches_sql_at_half_a_unit(spark, tmp_path):
    """These recordings have figures at just half a unit, or a mean bearing at a right angle: both sides round and turn them alike."""
    con = duckdb.connect()
    odd = [(100001, 4, 92), (100001, 1, 1427), (1000000, 5, 816), (100003, 4, 1239), (100003, 1, 478)]
    con.execute(f"""COPY (SELECT event_id + s * k AS event_id, ts, user_id + 10000 * k AS user_id, event_type, value, props
        FROM '/root/testdata/sf0.1/events.parquet' JOIN (VALUES {", ".join(map(str, odd))}) v(s, k, u) ON user_id = u) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = entry.queries()["H13_robot_summary"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()['H13_robot_summary']})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
