"""Configuration and question files (YAML), and the append-only journal."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from sparkloom.operators.ontology import Ontology


def load_config(path: str) -> dict:
    """Nested settings as they stand; a missing key is the reader's KeyError."""
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def load_ontology(path: str) -> Ontology:
    return Ontology.parse(Path(path).read_text(encoding="utf-8"))


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """``q_id, question, expect, why`` from a list of questions."""
    rows = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    rows = rows["questions"] if isinstance(rows, dict) else rows
    return spark.createDataFrame(
        [(i, r["q"], r.get("expect"), r.get("why")) for i, r in enumerate(rows)], "q_id int, question string, expect string, why string"
    )


def journal(spark: SparkSession, folder: str, message: str) -> None:
    """One more line, stamped; nothing is ever rewritten."""
    stamp = dt.datetime.now().isoformat(timespec="seconds")
    spark.createDataFrame([(f"- {stamp} {message}",)], "value string").coalesce(1).write.mode("append").text(f"{folder}/log")


def read_journal(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(f"{folder}/log")
