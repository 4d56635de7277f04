"""Rules of outside programs: the paths of files go through a process in batches, each with a time limit.

A program reads one JSON object (config, files) and writes a list of violations (Rule, Path, Message; lower case too). It
sees one batch of files at a time, so it can only judge files one by one. What fails is a violation, not an error.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Seconds for a batch, and files of a batch.
SECONDS, BATCH_FILES = 30.0, 1000
FAILED = "Plugin execution failed: "
SCHEMA = "rule string, path string, message string"


def asked(rule: str, command: list[str], config: dict, files: list[str], seconds: float) -> list[tuple[str, str, str]]:
    """The violations that the program reports of these files; a row at "." if it fails, hangs or answers something else."""
    try:
        done = subprocess.run(command, input=json.dumps({"config": config, "files": files}).encode(), capture_output=True, timeout=seconds, check=False)
        if done.returncode:
            raise ValueError(f"exit status {done.returncode} (stderr: {done.stderr.decode(errors='replace').strip()[-500:]})")
        rows = [{k.lower(): v for k, v in x.items()} for x in json.loads(done.stdout) or []]
        return [(str(x.get("rule") or rule), str(x.get("path", ".")), str(x.get("message", ""))) for x in rows]
    except (OSError, subprocess.SubprocessError, ValueError, TypeError, AttributeError) as e:
        return [(rule, ".", f"{FAILED}{e}")]


def external_rule(files: DataFrame, rule: str, command: list[str], config: dict | None = None, seconds: float = SECONDS, batch_files: int = BATCH_FILES) -> DataFrame:
    """rule, path, message of a program that is run once for each batch of files, on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_files):
                found = asked(rule, command, config or {}, batch.column(0).slice(at, batch_files).to_pylist(), seconds)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found)], names=["rule", "path", "message"])

    return files.where("not is_dir").select("path").mapInArrow(run, SCHEMA).distinct()
