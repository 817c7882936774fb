"""Tools as sources: any command that reads a diff and prints findings, run once per case inside the tasks."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMEOUT = 60
RUN = "case_id string, stdout string, stderr string, returncode int, error string"


def command_for(template: list[str], context: str | None) -> list[str]:
    """``{context}`` in an argument is the case's context, or nothing; arguments that are left empty are dropped."""
    filled = [a.replace("{context}", context or "") for a in template]
    return [a for a, t in zip(filled, template, strict=True) if a or t == ""]


def run_tool(cases: DataFrame, template: list[str], timeout: int = TIMEOUT) -> DataFrame:
    """cases (case_id, diff, context) to RUN; a tool that fails or hangs gives an error row, not a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for case_id, diff, context in batch.itertuples(index=False, name=None):
                try:
                    done = subprocess.run(command_for(template, context), input=diff or "", capture_output=True, text=True, timeout=timeout)
                    rows.append((case_id, done.stdout, done.stderr, done.returncode, None))
                except (OSError, subprocess.TimeoutExpired) as e:
                    rows.append((case_id, "", "", None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["case_id", "stdout", "stderr", "returncode", "error"]).astype({"returncode": "Int32"})

    return cases.select("case_id", "diff", F.col("context").cast("string").alias("context")).mapInPandas(run, RUN)


def run_function(cases: DataFrame, tool, schema: str = "case_id string, name string, file string, line int, kind string, message string") -> DataFrame:
    """cases (case_id, diff) through a Python function from a diff to rows (name, file, line, kind, message)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            yield pd.DataFrame([(c, *row) for c, d in batch.itertuples(index=False, name=None) for row in tool(d or "")], columns=names)

    return cases.select("case_id", "diff").mapInPandas(run, schema)
