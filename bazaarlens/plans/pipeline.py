"""The batch run: CSV folder -> model -> published tables.

    python -m bazaarlens.plans.pipeline --input DIR --output DIR [--start 2017-01-01 --end 2018-08-31]

Shared tables are written once and every result reads those copies, so the fact
joins run a single time and a lost executor costs at most one result.
"""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from bazaarlens.plans import growth, monthly, report, repurchase, seller_risk, strategic
from bazaarlens.plans.model import Model
from bazaarlens.session import build_session
from bazaarlens.settings import Settings
from bazaarlens.sinks.tables import write_csv, write_parquet
from bazaarlens.sources.csv_files import load_folder, load_summary

# Derived tables kept as files, in order of dependence.
KEPT = ("order_base", "seller_order_core", "customer_month", "seller_month")

# Names of the published tables.
RESULTS: dict[str, Callable[[Model], DataFrame]] = {
    "monthly_business_metrics": report.monthly_business_output,
    "concentracao_receita_cidade": growth.concentration_city,
    "concentracao_receita_seller": growth.concentration_seller,
    "concentracao_receita_categoria": growth.concentration_category,
    "receita_por_estado": growth.concentration_state,
    "seller_risk_ranking": seller_risk.seller_risk,
    "customer_repurchase_analysis": repurchase.monthly_repurchase,
    "customer_summary_repurchase": repurchase.customer_summary,
    "categorias_recompra": repurchase.repurchase_categories,
    "strategic_seller_definition": strategic.seller_performance,
    "strategic_seller_monthly_analysis": strategic.strategic_monthly,
    "candlestick_mensal": monthly.monthly_ohlc,
    "top_sellers_detratores": report.top_detractors_text,
    "resumo_executivo": report.kpi_text,
}


def keep(model: Model, folder: str) -> Model:
    """Write the shared tables under ``folder``; the returned model reads them."""
    for name in KEPT:
        path = f"{folder.rstrip('/')}/{name}"
        frame = getattr(model, name)
        frame.write.mode("overwrite").parquet(path)
        model = model.storing(name, model.spark.read.schema(frame.schema).parquet(path))
    return model


def publish(model: Model, folder: str, results: dict[str, Callable[[Model], DataFrame]] | None = None) -> None:
    for name, build in (RESULTS if results is None else results).items():
        write_csv(build(model), f"{folder.rstrip('/')}/{name}")


def run(spark: SparkSession, source: str, target: str, settings: Settings = Settings()) -> Model:
    loaded = load_folder(spark, source)
    model = keep(Model({name: table.data for name, table in loaded.items()}, settings), f"{target}/model")
    publish(model, f"{target}/tables")
    write_parquet(load_summary(spark, loaded), f"{target}/load_summary")
    return model


def main() -> None:
    parser = argparse.ArgumentParser(description="Build the marketplace tables from a folder of CSV files.")
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--start", type=dt.date.fromisoformat)
    parser.add_argument("--end", type=dt.date.fromisoformat)
    args = parser.parse_args()
    settings = Settings()
    if args.start:
        settings = replace(settings, start_date=args.start)
    if args.end:
        settings = replace(settings, end_date=args.end)
    run(build_session(), args.input, args.output, settings)


if __name__ == "__main__":
    main()
