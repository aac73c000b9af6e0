import json
import random

import pytest

from panelwright import cli
from panelwright.sources import files


def test_csv_round_trip_and_bom(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbffirm,x\nA,1\n")
    df = files.read_table(spark, f"file://{tmp_path}/a.csv")
    assert df.columns == ["firm", "x"] and df.count() == 1
    files.write_table(df, f"file://{tmp_path}/b.parquet")
    files.write_table(df, f"file://{tmp_path}/c.csv", single_file=True)
    assert files.read_table(spark, f"file://{tmp_path}/b.parquet").count() == 1 and files.read_table(spark, f"file://{tmp_path}/c.csv").columns == ["firm", "x"]
    with pytest.raises(ValueError, match="CSV or Parquet"):
        files.read_table(spark, "x.xlsx")
    with pytest.raises(ValueError, match="missing columns"):
        files.read_projected(spark, f"file://{tmp_path}/a.csv", {"nope": "n"})
    assert files.read_projected(spark, f"file://{tmp_path}/a.csv", {"x": "n"}).columns == ["n"]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert files.read_json_lines(spark, f"file://{tmp_path}/l.jsonl", "a int").count() == 2
    mark = files.fingerprint(spark, f"file://{tmp_path}/a.csv").first()
    assert mark["header_sha256"] == files.header_hash(["firm", "x"]) and mark["size"] > 0


def test_ledger(tmp_path, monkeypatch):
    (tmp_path / "x.csv").write_text("a")
    ledger = files.PathLedger({"roots": {"data": {"default": str(tmp_path), "env": "SOME_ROOT"}}, "entries": {"k": {"root": "data", "path": "x.csv", "desc": "d"}, "n": {"root": "data", "path": "no", "desc": "e"}}})
    assert ledger.data_path("k").endswith("x.csv") and ledger.describe("k") == "d" and ledger.list_keys() == ["k", "n"]
    assert [s[:4] for s in ledger.status()] == ["[OK]", "[--]"]
    with pytest.raises(KeyError):
        ledger.data_path("zz")
    with pytest.raises(FileNotFoundError):
        ledger.data_path("n")
    monkeypatch.setenv("SOME_ROOT", "/else")
    assert ledger.data_path("k", must_exist=False) == "/else/x.csv"


def test_specs_command(capsys):
    assert cli.main(["specs", "--json"]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 10
    with pytest.raises(SystemExit):
        cli.main(["fit", "--input", "a.csv", "--output", "b.csv", "--spec", "nope"])


def test_prepare_and_fit(spark, tmp_path):
    rows = [("A", 2020, 100.0, 80.0), ("A", 2021, 110.0, 100.0)]
    spark.createDataFrame(rows, "firm string, fiscal_year int, assets double, sales double").write.parquet(f"file://{tmp_path}/in.parquet")
    assert cli.main(["prepare", "--input", f"file://{tmp_path}/in.parquet", "--output", f"file://{tmp_path}/out.parquet"], spark) == 0
    assert files.read_table(spark, f"file://{tmp_path}/out.parquet").filter("ie_sales_growth = 0.25").count() == 1
    rng = random.Random(1)
    rows = [("JP", f, y, rng.random(), rng.random(), 1 + rng.random()) for f in range(10) for y in (2020, 2021, 2022)]
    cols = "nation string, firm int, fiscal_year int, ie_inv_bh_fixed_assets double, ie_cash_flow_net_capital double, ie_tobin_q_lag double"
    spark.createDataFrame(rows, cols).write.parquet(f"file://{tmp_path}/m.parquet")
    args = ["fit", "--input", f"file://{tmp_path}/m.parquet", "--output", f"file://{tmp_path}/f.csv", "--spec", "bh2006", "--country-col", "nation"]
    assert cli.main(args, spark) == 0
    d = files.read_table(spark, f"file://{tmp_path}/f.diagnostics.csv").first()
    assert d["status"] == "estimated" and d["residual_df"] >= 1 and files.read_table(spark, f"file://{tmp_path}/f.coefficients.csv").count() == 2
