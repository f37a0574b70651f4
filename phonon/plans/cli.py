"""Command line: train a model from a feature table, score a CSV with it.

    python -m phonon.plans.cli train --features-table T --target thermal_conductivity \\
        --key formula --model M --element-table E --stat-props size,price \\
        --orbital-cols s=s_valence,p=p_valence
    python -m phonon.plans.cli score --model M --input in.csv --output out_dir \\
        --schema "formula string, temperature double, space_group int" [--raw-target]

Training keeps beside the model its feature list (A9) and, when given, the
element-property table with the names needed to featurise. Scoring reads them
back: it validates the CSV, featurises its formulas with that table, aligns
the columns to the feature list (missing columns 0), predicts with the saved
pipeline (imputer included), brings the prediction back from log1p unless
``--raw-target`` and writes CSV. The session comes from spark-submit (or a
local one when run directly).
"""

from __future__ import annotations

import argparse
import os


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="phonon")
    sub = ap.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("train", help="fit on a stored feature table and save the pipeline")
    t.add_argument("--features-table", required=True)
    t.add_argument("--target", default="thermal_conductivity")
    t.add_argument("--key", default="formula")
    t.add_argument("--model", required=True)
    t.add_argument("--iterations", type=int, default=100, help="boosting rounds")
    t.add_argument("--element-table", help="Parquet table keyed by element symbol (column element)")
    t.add_argument("--stat-props", default="", help="its properties to average, comma-separated")
    t.add_argument("--orbital-cols", default="", help="valence counts, as s=col,p=col,...")
    s = sub.add_parser("score", help="score a CSV with a saved pipeline")
    s.add_argument("--model", required=True)
    s.add_argument("--input", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--schema", required=True, help="DDL schema of the CSV")
    s.add_argument("--raw-target", action="store_true", help="model predicts the raw target")
    return ap


def train(spark, args) -> None:
    from ..operators.train import boosted_trees
    from ..sources.tables import save_column_list
    from .featurize import run_pipeline
    feats = spark.read.parquet(args.features_table)
    _, metrics, cols = run_pipeline(feats, args.target, args.key, args.model,
                                    trainer=boosted_trees(args.iterations))
    save_column_list(spark, cols, os.path.join(args.model, "feature_list"))
    if args.element_table:
        spark.read.parquet(args.element_table).write.mode("overwrite").parquet(
            os.path.join(args.model, "element_table"))
        save_column_list(spark, args.stat_props.split(","), os.path.join(args.model, "stat_props"))
        save_column_list(spark, [p for p in args.orbital_cols.split(",") if p],
                         os.path.join(args.model, "orbital_cols"))
    metrics.show()


def score(spark, args) -> None:
    from ..sources.tables import _exists, load_column_list
    from .featurize import featurize, score_csv
    cols = load_column_list(spark, os.path.join(args.model, "feature_list"))
    elements = os.path.join(args.model, "element_table")
    featurize_fn = None
    if _exists(spark, elements):
        table = spark.read.parquet(elements)
        stats = load_column_list(spark, os.path.join(args.model, "stat_props"))
        orbitals = dict(p.split("=") for p in load_column_list(
            spark, os.path.join(args.model, "orbital_cols")))

        def featurize_fn(df):
            return featurize(df, table, stats, orbitals)
    elif any(c.startswith("MagpieData_") for c in cols):
        raise ValueError("the model uses composition features, but no element table was stored with it")
    score_csv(spark, args.model, args.input, args.schema, cols, args.output,
              featurize_fn=featurize_fn, required=["formula"], raw_target=args.raw_target)


def main(argv=None) -> None:
    args = parser().parse_args(argv)
    from ..session import get_spark
    spark = get_spark()
    {"train": train, "score": score}[args.cmd](spark, args)


if __name__ == "__main__":
    main()
