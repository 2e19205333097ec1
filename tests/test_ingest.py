"""CSV dialects, file matching and the whole batch run."""

import datetime as dt

import pytest

from bazaarlens.plans import pipeline
from bazaarlens.sources import csv_files as ingest
from bazaarlens.sources.specs import SPECS

CSV = {
    "customers_dataset": "customer_id,customer_unique_id,customer_city,customer_state,customer_zip_code_prefix\nc1,u1,sao paulo,sp,01000\nc2,u2,,rj,x\n",
    "orders_dataset": "pedido_id,customer_id,order_status,order_purchase_timestamp,order_delivered_customer_date,order_estimated_delivery_date\n"
    "o1,c1,delivered,2017-01-01 10:00:00,2017-01-10 10:00:00,2017-01-05 00:00:00\n"
    "o2,c1,delivered,2017-01-02 10:00:00,2017-01-31 10:00:00,2017-02-05 00:00:00\n"
    "o3,c2,delivered,2017-01-03 10:00:00,not a date,2017-02-05 00:00:00\n",
    "order_items_dataset": "order_id;order_item_id;product_id;seller_id;shipping_limit_date;preco;valor_frete\n"
    "o1;1;p1;s1;2017-01-02;10.5;1\no2;1;p1;s1;2017-01-02;abc;1\no2;2;p2;s2;2017-01-02;20;\n",
    "order_reviews_dataset": 'review_id,order_id,review_score,review_comment,review_creation_date\nr1,o1,2,"two\nlines, ""quoted""",2017-01-12\nr2,o2,5,fine,01/13/2017\n',
    "products_dataset": "product_id,product_category_name\np1,beleza_saude\np2,NA\n",
    "sellers_dataset": "seller_id,seller_city,seller_state\ns1,SÃO PAULO,sp\ns2,mogi,sp\n",
    "product_category_name_translation": "product_category_name,product_category_name_english\nbeleza_saude,health_beauty\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, body in CSV.items():
        encoding = {"sellers_dataset": "latin-1", "product_category_name_translation": "utf-8-sig"}.get(name, "utf-8")
        (tmp_path / f"{name}.csv").write_bytes(body.encode(encoding))
    return tmp_path


def test_file_matching():
    paths = ["/d/orders.csv", "/d/orders_old.csv", "/d/order_items.csv", "/d/order_reviews.csv", "/d/Order-Payments.csv",
             "/d/product_category_name_translation.csv", "/d/products.csv", "/d/customers.csv"]
    found = ingest.assign_files(paths)
    assert found["orders"] == "/d/orders.csv" and found["order_payments"] == "/d/Order-Payments.csv"
    assert found["products"] == "/d/products.csv" and "sellers" not in found
    assert found["translation"].endswith("translation.csv")


def test_profiles(spark, folder):
    profile = lambda name: ingest.profile_file(spark, f"{folder}/{name}.csv")
    assert profile("order_items_dataset") == ingest.FileProfile("UTF-8", ";", False)
    assert profile("sellers_dataset").encoding == "ISO-8859-1"
    assert profile("order_reviews_dataset").multiline and not profile("orders_dataset").multiline


def test_load(spark, folder, caplog):
    loaded = ingest.load_folder(spark, str(folder))
    assert "geolocation" not in loaded and "order_payments" in caplog.text
    orders = {r["order_id"]: r for r in loaded["orders"].data.collect()}
    assert orders["o1"]["order_delivered_customer_date"] == dt.datetime(2017, 1, 10, 10)
    assert orders["o3"]["order_delivered_customer_date"] is None
    items = loaded["order_items"].data.orderBy("order_id", "order_item_id").collect()
    assert [r["price"] for r in items] == [10.5, None, 20.0] and items[2]["freight_value"] is None
    reviews = loaded["order_reviews"].data.orderBy("review_id").collect()
    assert reviews[0]["review_comment"] == 'two\nlines, "quoted"'
    assert reviews[1]["review_creation_date"] == dt.datetime(2017, 1, 13)
    assert loaded["products"].data.orderBy("product_id").collect()[1]["product_category_name"] is None
    assert loaded["sellers"].data.orderBy("seller_id").first()["seller_city"] == "SÃO PAULO"
    assert loaded["translation"].data.columns == ["product_category_name", "product_category_name_english"]
    assert loaded["customers"].data.orderBy("customer_id").collect()[1]["customer_zip_code_prefix"] is None
    summary = {r["table_name"]: r for r in ingest.load_summary(spark, loaded).collect()}
    assert summary["order_items"]["rows"] == 3 and summary["order_items"]["delimiter"] == ";"


def test_missing_parts(spark, folder, tmp_path_factory):
    other = tmp_path_factory.mktemp("partial")
    (other / "orders.csv").write_text("order_id\n1\n")
    with pytest.raises(FileNotFoundError, match="customers"):
        ingest.load_folder(spark, str(other))
    with pytest.raises(ValueError, match="customer_id"):
        ingest.load_table(spark, SPECS["orders"], str(other / "orders.csv"))
    with pytest.raises(FileNotFoundError):
        ingest.find_folder(spark, str(other))
    (other / "data").mkdir()
    (other / "data" / "x.csv").write_text("a\n")
    assert ingest.find_folder(spark, str(other)).endswith("/data")


def test_alias_rules(spark):
    df = spark.createDataFrame([("1", "2", "3")], "`Preço ` string, preco string, price string")
    with pytest.raises(Exception):
        df.toDF("a", "b")
    renamed = ingest.rename_headers(df.select("preco"), SPECS["order_items"])
    assert renamed.columns == ["price"]
    both = ingest.rename_headers(df.select("preco", "price"), SPECS["order_items"])
    assert both.columns == ["preco", "price"]  # the canonical name wins


def test_batch_run(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    model = pipeline.run(spark, str(folder), str(out))
    read = lambda name: spark.read.option("header", True).csv(f"{out}/tables/{name}")
    month = read("monthly_business_metrics").collect()
    assert [(r["ano_mes"], float(r["receita_mensal"]), r["pedidos_mensais"]) for r in month] == [("2017-01", 30.5, "2")]
    assert list(read("monthly_business_metrics").columns)[:3] == ["ano_mes", "receita_mensal", "pedidos_mensais"]
    categories = {r["product_category_final"]: float(r["item_revenue"]) for r in read("concentracao_receita_categoria").collect()}
    assert categories == {"health_beauty": 10.5, "unknown": 20.0}
    assert {r["customer_city"] for r in read("concentracao_receita_cidade").collect()} == {"Sao Paulo"}
    assert spark.read.parquet(f"{out}/load_summary").count() == 7
    assert model.order_base.inputFiles()  # later queries read the written copy
