from hydrorisk.operators.spi import fit_spi, transform_spi
from hydrorisk.operators.windows import antecedent_rain, over_rows
from hydrorisk.schemas import RAIN
from hydrorisk.session import shared_path
from hydrorisk.sources.bucketed import attach_bucketed, exchanges, write_bucketed


def test_windows_fit_and_join_by_division_without_a_shuffle(spark, panel_df):
    path = shared_path(spark, "t-buckets")
    stored = write_bucketed(panel_df, "t_bucketed_panel", path, 8)
    try:
        windowed = over_rows(stored, antecedent_rain, back=6)
        plain = over_rows(panel_df, antecedent_rain, back=6)
        assert exchanges(plain) == 1 and exchanges(windowed) == 0
        assert windowed.exceptAll(plain).count() == 0 and windowed.count() == panel_df.count()
        assert exchanges(fit_spi(stored, [RAIN])) == 0
        # Where the fit is too large to broadcast, its rows go to the buckets; the panel stays.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        scored = transform_spi(stored, fit_spi(stored, [RAIN]), {RAIN: "spi"})
        whole = transform_spi(panel_df, fit_spi(panel_df, [RAIN]), {RAIN: "spi"})
        assert exchanges(scored) == 1 and exchanges(whole) == 3
        assert scored.count() == whole.count()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE t_bucketed_panel")
        again = attach_bucketed(spark, "t_bucketed_panel", path, panel_df.schema, 8)
        assert exchanges(over_rows(again, antecedent_rain, back=6)) == 0
        assert again.exceptAll(panel_df).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS t_bucketed_panel")
