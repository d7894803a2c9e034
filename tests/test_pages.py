"""Each report page gives all its tables, and they hold together."""

import pytest
from pyspark.sql import functions as F

from tests.demo import demo_customers
from tidemark.operators import learning, sales
from tidemark.plans import pages
from tidemark.sources.tables import sales_lines, ticks
from tidemark.staging import delete_folder, drop_staged, new_path, stage


def test_sales_pages(spark, small):
    lines = sales.filter_sales(sales_lines(spark, small), "1996-01-01", "1999-12-31", ["ASIA", "EUROPE"])
    lines = lines.persist()
    overview = pages.sales_overview(lines)
    total = overview["kpis"].first()["revenue"]
    for name, column in (("regions", "total"), ("categories", "total"), ("segments", "total"), ("trend", "sales")):
        assert overview[name].agg(F.sum(column)).first()[0] == pytest.approx(total)
    assert pages.sales_places(lines)["top_states"].count() == 10
    assert pages.sales_customers(lines)["kpis"].first()["customers"] > 0
    outlook = pages.sales_outlook(lines, 60)
    assert outlook["forecast"].count() == 60 and outlook["summary"].count() == 1
    lines.unpersist()


def test_market_page(spark, small):
    page = pages.market_page(ticks(spark, small), "4h", ("purchase", "view"))
    counts = {name: df.count() for name, df in page.items()}
    assert counts["kpis"] == 5 and counts["forecast"] == 35 and counts["correlation"] == 4
    assert counts["bars"] == counts["normalized"] and all(counts.values())
    with pytest.raises(ValueError):
        pages.market_page(ticks(spark, small), "4h", ("purchase", "view"), vol_window=61)


def test_churn_page(spark):
    demo = demo_customers(spark, 400)
    assert pages.data_page(demo)["duplicates"].first()[0] == 0
    model = learning.train_churn_model(demo, "Churn", "customerID", "forest", trees=8)
    page = pages.churn_page(model)
    assert all(df.columns for df in page.values())
    assert page["risk_distribution"].agg(F.sum("customers")).first()[0] == 400
    assert page["insights"].count() == 4 and page["summary"].count() == 4 and page["drivers"].count() == 1


def test_folders_are_deleted_on_request(spark):
    path = new_path(spark, "gone")
    spark.range(3).write.parquet(path)
    delete_folder(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)
    assert callable(drop_staged) and stage(spark.range(2)).count() == 2


def test_from_csv_files_to_pages(spark, tmp_path):
    """The whole way from text files: a sales table, and a customer table without ids and with a yes/no target."""
    from tidemark.operators import cleaning
    from tidemark.sources import files

    sales_csv = tmp_path / "sales.csv"
    sales_csv.write_text(
        "Row ID,Order ID,Order Date,Ship Date,Ship Mode,Customer ID,Customer Name,Segment,State,Region,Category,Sub-Category,Product Name,Sales\n"
        "1,CA-1,08/11/2017,11/11/2017,Second Class,C1,Ann,Consumer,Texas,South,Paper,Books,Pad,10.5\n"
        "2,CA-2,09/12/2018,12/12/2018,First Class,C1,Ann,Consumer,Ohio,East,Paper,Books,Pen,20\n"
    )
    lines = files.load_sales(spark, str(sales_csv), ["dd/MM/yyyy"])
    page = pages.sales_overview(lines)
    assert tuple(page["kpis"].first())[:2] == (30.5, 2) and page["growth"].first()["year"] == 2018
    assert {r["state_code"] for r in pages.sales_places(lines)["states"].collect()} == {"TX", "OH"}

    demo = demo_customers(spark, 300).drop("customerID")
    named = demo.withColumn("Churn", F.when(F.col("Churn") == 1, "Yes").otherwise("No")).withColumnRenamed("tenure", "Tenure Months")
    files.write_csv(named, str(tmp_path / "customers"))
    table = files.read_customers_csv(spark, str(tmp_path / "customers"))
    target = cleaning.infer_target_column(table)
    assert target == "Churn" and cleaning.validate_dataset(table, target).count() == 0
    model = learning.train_churn_model(table, target, choice="forest", trees=4)
    names = {r["feature"] for r in model.prep.names().collect()}
    assert "row_id" not in names and {"Tenure_Months", "Contract_One year"} <= names
    assert pages.churn_page(model)["kpis"].first()["customers"] == 300
