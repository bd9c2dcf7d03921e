"""Headless scoring: spark-submit with --input, --model, --output and --training."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from opinara.plans.score import score_job


def main() -> None:
    parser = argparse.ArgumentParser(prog="opinara", description="Score customer reviews.")
    parser.add_argument("--input", required=True, help="review CSV file or folder")
    parser.add_argument("--model", required=True, help="folder of the saved model")
    parser.add_argument("--output", required=True, help="folder for the scored reviews")
    parser.add_argument("--training", help="folder of training CSV files")
    parser.add_argument(
        "--single-line", action="store_true", help="no quoted line breaks: read files in splits"
    )
    parser.add_argument("--fill-ids", action="store_true", help="make ids where they are missing")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("opinara").getOrCreate()
    accuracy = score_job(
        spark, args.input, args.model, args.output, args.training, not args.single_line,
        args.fill_ids,
    )
    if accuracy is not None:
        print(f"trained a new model, accuracy {accuracy:.4f}")


if __name__ == "__main__":
    main()
