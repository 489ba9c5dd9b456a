"""python -m tidewatch sync|run|evaluate|compare: the steps of a run over files."""

from __future__ import annotations

import argparse
from dataclasses import replace
from datetime import date

from tidewatch.config import ARConfig, RollingConfig, load_series_meta
from tidewatch.operators.evaluation import compare_files, evaluate_files
from tidewatch.plans.engine import Nowcaster
from tidewatch.session import get_session
from tidewatch.sources.http import sync_all
from tidewatch.sources.observations import load_all_raw_series


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="tidewatch", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    sync = commands.add_parser("sync", help="fetch the configured series to CSV files")
    run = commands.add_parser("run", help="files to dataset, predictions, evaluations and nowcasts")
    for p in (sync, run):
        p.add_argument("--config", required=True)
        p.add_argument("--data", required=True)
    sync.add_argument("--only", nargs="*", help="names of series")
    run.add_argument("--target", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--start", default="1980-01-01")
    run.add_argument("--end", default=str(date.today()))
    run.add_argument("--test-start", help="first day of out-of-sample predictions")
    run.add_argument("--window-years", type=int)
    run.add_argument("--min-quarters", type=int, help="least quarters of a baseline's history")
    run.add_argument("--strict", action="store_true", help="no value before its vintage")
    evaluate = commands.add_parser("evaluate", help="metrics of daily predictions")
    evaluate.add_argument("predictions")
    evaluate.add_argument("out")
    commands.add_parser("compare", help="all evaluations below a folder").add_argument("folder")
    a = top.parse_args(args)
    spark = get_session()
    if a.command == "sync":
        done = sync_all(spark, load_series_meta(a.config), a.data, only=a.only)
    elif a.command == "run":
        metas = load_series_meta(a.config)
        given = {k: v for k, v in (("test_start", a.test_start), ("window_years", a.window_years)) if v is not None}
        ar = replace(ARConfig(**given), **({"min_train_quarters": a.min_quarters} if a.min_quarters is not None else {}))
        done = Nowcaster(load_all_raw_series(spark, metas, a.data), metas, a.target, a.start, a.end, RollingConfig(**given), ar, a.strict).save(a.out)
    elif a.command == "evaluate":
        done = evaluate_files(spark, a.predictions, a.out)
    else:
        compare_files(spark, a.folder)
        done = {"model_compare": f"{a.folder}/model_compare.csv"}
    for name, path in done.items():
        print(f"{name}: {path}")


if __name__ == "__main__":
    main()
