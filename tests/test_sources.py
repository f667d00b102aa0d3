import os

from cohortia.sources import readers, sinks


def test_read_transactions_csv(spark, tmp_path):
    p = tmp_path / "tx.csv"
    p.write_text("id_customer,date,gross_sales,net_sales,PL_gross_sales,number_item_PL,"
                 "number_items_other,store_type\n"
                 "1,2020-01-02,10.0,9.0,\"3,5\",2,x,A\n"
                 "2,2020-01-03,5.0,5.0,0,,1,B\n")
    df = readers.read_transactions(spark, str(p)).orderBy("id_customer").collect()
    assert df[0]["PL_gross_sales"] == 3.5 and df[0]["number_items_other"] is None
    assert str(df[0]["date"]) == "2020-01-02" and df[1]["number_item_PL"] is None


def test_weekly_date_pattern(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text("WEEKSTARTINGSELLOUT,VALUESALESBRAND\n03.01.22,10.5\n")
    r = readers.read_weekly(spark, str(p), schema="WEEKSTARTINGSELLOUT string, VALUESALESBRAND double")
    assert str(r.first()["WEEKSTARTINGSELLOUT"]) == "2022-01-03"


def test_sinks_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    sinks.write_report({"one": df, "two": df}, str(tmp_path / "rep"))
    assert sorted(os.listdir(tmp_path / "rep")) == ["one", "two"]
    sinks.write_table(df, str(tmp_path / "csv"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    sinks.export_model(df, str(tmp_path / "model"))
    assert spark.read.json(str(tmp_path / "model")).count() == 1
