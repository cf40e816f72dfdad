"""Results to the last digit, as the SQL gives them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from beatlake.functions import scalars as C
from beatlake.operators import quality as Q
from beatlake.plans import registry


def test_shares_are_printed_halves_to_even(spark):
    q = spark.createDataFrame([(0.0625, 0.1875, 0.3125)], "frac_flatline double, frac_noiseburst double, frac_clipping double").withColumn("win_std_median", F.lit(1.0))
    r = Q.classify_recordings(q).first()
    assert r["quality_reason"] == "clipping share 0.312"
    r = Q.classify_recordings(q, clip=0.5).first()
    assert r["quality_reason"] == "flatline share 0.062; noise share 0.188; clipping share 0.312"


def test_scaled_round_as_sql(spark):
    x = spark.createDataFrame([(303981303.655,), (108129943.77499999,), (-0.125,), (None,)], "x double")
    assert [r[0] for r in x.select(C.scaled_round(F.col("x"), 2)).collect()] == [303981303.65, 108129943.78, -0.13, None]


@pytest.fixture
def halves(spark, tmp_path):
    """Two users of sf0.1 whose mean differences end in a half of the last digit kept: 303981303.655 and 108129943.775 ms, which doubles hold as a bit less and SQL rounds down and up."""
    spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("user_id in (218, 936)").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")

    def both(name, column):
        got = {r["user_id"]: r[column] for r in registry.queries()[name](spark, str(tmp_path)).collect()}
        return got, dict(con.execute(f"SELECT user_id, {column} FROM ({registry.oracle_sql()[name]})").fetchall())

    return both


def test_rr_delta_search_rounds_as_its_sql(halves):
    got, want = halves("rr_delta_search", "mae_ms")
    assert got == want == {218: 303981303.65, 936: 108129943.78}


def test_compare_versions_rounds_as_its_sql(halves):
    got, want = halves("compare_versions", "rr_mae_ms")
    assert got == want and got[218] == 303981303.65


def test_snr_without_signal_is_minus_infinity(spark):
    x = spark.createDataFrame([(0.0, 3.0), (30.0, 3.0), (3.0, 0.0), (None, 3.0)], "s double, n double")
    assert [r[0] for r in x.select(C.snr_db(F.col("s"), F.col("n"))).collect()] == [float("-inf"), 10.0, float("inf"), None]
