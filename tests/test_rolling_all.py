from tables import assert_equal_to_sql, needs_tables

from chronoloom import timeseries_queries as queries


@needs_tables
def test_every_day_of_every_series_has_all_averages(spark):
    """Against SQL without the start of 29 days in."""
    sql = queries._ROLLED + """
        SELECT series_id, day_no, total_7, n_7, total_7 / 7 AS per_day_7, total_30, n_30, total_30 / 30 AS per_day_30,
          CASE WHEN n_7 > 0 THEN round(total_7 / n_7, 6) END AS mean_7, CASE WHEN n_30 > 0 THEN round(total_30 / n_30, 6) END AS mean_30
        FROM rolled"""
    assert_equal_to_sql(spark, queries.QUERIES["p1_rolling_all"], sql)
