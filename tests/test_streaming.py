"""Observations that arrive in files, with a late revision, end in the panel once."""

from tests.conftest import d
from tidewatch.config import SeriesMeta
from tidewatch.operators.panel import daily_panel
from tidewatch.streaming.ingest import append_calendar, stream_observations


def test_files_are_appended_once(spark, tmp_path):
    metas = {"a": SeriesMeta("a", "v", "A", "M", "r", 10)}
    (tmp_path / "in").mkdir()

    def run():
        q = append_calendar(stream_observations(spark, str(tmp_path / "in")), metas, str(tmp_path / "cal"), str(tmp_path / "log"))
        assert q.awaitTermination(120) and q.exception() is None

    (tmp_path / "in" / "1.csv").write_text("series,ref_period,vintage_date,value\na,2020-01-01,2020-02-10,1.0\n")
    run()
    run()
    (tmp_path / "in" / "2.csv").write_text("series,ref_period,vintage_date,value\na,2020-01-01,2020-03-10,1.5\na,2020-02-01,2020-03-10,.\n")
    run()
    cal = spark.read.parquet(str(tmp_path / "cal")).select("series", "ref_period", "vintage_date", "value", "available_date")
    assert cal.count() == 3
    days = {r["as_of_date"]: (r["value"], r["ref_period"]) for r in daily_panel(cal, "2020-02-09", "2020-03-10").collect()}
    assert days[d("2020-02-09")] == (None, None) and days[d("2020-02-10")][0] == 1.5 and days[d("2020-03-10")] == (1.5, d("2020-02-01"))
