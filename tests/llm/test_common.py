"""Tables that operators write between stages."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from factloom.llm.common import cut

SCRIPT = """
import sys
from pyspark.sql import SparkSession
from factloom.llm.common import cut

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1] + "/shared").getOrCreate()
rows = spark.range(0, 1000, 1, 5)
rows.write.parquet("file://" + sys.argv[1] + "/plain")
assert sorted(r.id for r in cut(rows, "stage").collect()) == list(range(1000))
"""


def test_cut_starts_one_process_a_file(tmp_path):
    """Hadoop starts chmod for each file it writes: for a table of 5 parts and its mark that makes 6, without checksum files."""
    shim, log = tmp_path / "bin" / "chmod", tmp_path / "log"
    shim.parent.mkdir()
    shim.write_text(f'#!/bin/sh\necho "$@" >> {log}\nexec {shutil.which("chmod")} "$@"\n')
    shim.chmod(0o755)
    env = os.environ | {"PATH": f"{shim.parent}:{os.environ['PATH']}"}
    subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], env=env, check=True, timeout=300)
    files = [x.split()[1] for x in log.read_text().splitlines() if x.startswith("0644 ")]
    assert sum("/plain/" in x for x in files) == 12  # as the plain writer does, so the shim is seen to work
    assert sum("/shared/factloom-" in x for x in files) == 6


def test_cut_tells_damaged_files(spark):
    back = cut(spark.range(0, 100_000, 1, 1).selectExpr("xxhash64(id) AS h"), "damaged")
    [path] = [Path(x.removeprefix("file://")) for x in back.inputFiles()]
    held = bytearray(path.read_bytes())
    held[len(held) // 2] ^= 1
    path.write_bytes(held)
    with pytest.raises(Exception, match="(?i)checksum|CRC"):
        back.selectExpr("sum(h % 1000)").collect()
