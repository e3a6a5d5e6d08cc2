"""The command-line runner lists, shows and writes reports."""

from cartwheel.__main__ import main
from cartwheel.plans.catalog import REPORTS


def test_list(capsys):
    main(["list"])
    assert capsys.readouterr().out.split() == list(REPORTS)


def test_write_reports(spark, tmp_path):
    out = str(tmp_path / "out")
    main(["write", "--path", "/root/testdata/sf0.001", "--out", out, "s03_gsearch_cvr", "s87_quarter_volume"])
    got = spark.read.parquet(f"{out}/s87_quarter_volume.parquet")
    assert got.columns == ["yr", "quat", "sessions", "orders"] and got.count() > 0
    assert spark.read.parquet(f"{out}/s03_gsearch_cvr.parquet").count() == 1
