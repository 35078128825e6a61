"""The external aligner as a source: FASTA records in, AIRR lines or reads out.

Each partition is one run of the program on that partition's records, so the
alignment is as parallel as the input is partitioned. Its output is passed on as it
is read from the file, some thousand lines at a time.
"""

from __future__ import annotations

import itertools
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cdrforge.sources.airr import REQUIRED, normalise, require_columns

_LINES = 10_000


def command(program: str, query: str, output: str, threads: int = 1) -> list[str]:
    """Arguments of a run against the V, D and J databases of a tree."""
    return [program, *(x for s in "VDJ" for x in (f"-germline_db_{s}", f"database/my_seq_{s}")), "-organism", "human", "-domain_system", "imgt", "-query", query, "-outfmt", "19", "-out", output, "-auxiliary_data", "optional_file/human_gl.aux", "-num_threads", str(threads)]


def align(records: DataFrame, root: str, program: str = "bin/igblastn", threads: int = 1) -> DataFrame:
    """Output lines as ``value``, each run's own header line first; the tree must be on every executor.

    A run's files stand in the executor's scratch folder and go with the task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not (Path(root) / program).exists():
            raise FileNotFoundError(f"aligner not found at {root}/{program}")
        with tempfile.TemporaryDirectory() as folder:
            query, output = Path(folder, "q.fasta"), Path(folder, "out.tsv")
            with query.open("w") as f:
                for b in batches:
                    f.writelines(f">{h}\n{s}\n" for h, s in zip(b["header"], b["sequence"], strict=True))
            if query.stat().st_size:
                subprocess.run(command(str(Path(root) / program), str(query), str(output), threads), cwd=root, check=True)
                with output.open() as f:
                    while some := [x.rstrip("\n") for x in itertools.islice(f, _LINES)]:
                        yield pd.DataFrame({"value": some})

    return records.select("header", "sequence").mapInPandas(run, "value string")


def aligned_reads(records: DataFrame, root: str, program: str = "bin/igblastn", threads: int = 1) -> DataFrame:
    """Reads of the aligner's output, in the order of partitions and lines; every run names its columns itself."""
    kind = ", ".join(f"{c} string" for c in REQUIRED)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: list[int] | None = None
        for b in batches:
            lines = [x.split("\t") for x in b["value"]]
            if at is None and lines:
                names = lines.pop(0)
                require_columns(names, f"the output of {program}")
                at = [names.index(c) for c in REQUIRED]
            if lines:
                yield pd.DataFrame([[x[k] or None for k in at] for x in lines], columns=list(REQUIRED))

    parsed = align(records, root, program, threads).mapInPandas(parse, kind)
    return normalise(parsed, F.monotonically_increasing_id())
