"""Hand-written facts: YAML on the driver to a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "site string, id string, question string, answer string, page string"


def load(spark: SparkSession, path: str) -> DataFrame:
    """The ``facts`` of a YAML mapping; ValueError for anything else."""
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f)
    except OSError as e:
        raise ValueError(f"facts file {path} cannot be read: {e}") from e
    except yaml.YAMLError as e:
        raise ValueError(f"facts file {path} is not valid YAML: {e}") from e
    if not isinstance(data, dict):
        raise ValueError(f"facts file {path} must be a mapping with a 'facts' key")
    rows = []
    for f in data.get("facts") or []:
        if not isinstance(f, dict) or not isinstance(f.get("question"), str) or not isinstance(f.get("answer"), str):
            raise ValueError(f"facts file {path}: every fact needs a question and an answer")
        rows.append((data.get("site"), f.get("id"), f["question"], f["answer"], f.get("page")))
    return spark.createDataFrame(rows, SCHEMA)
