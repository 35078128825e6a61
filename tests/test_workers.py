import platform
import subprocess
import sys

import pytest

#: What a process holds after a task over 8 MB of text beyond what it held before, in MB.
TASK = """
import re
import numpy as np, pyarrow as pa
from cdrforge.llm import near_dup, quality_rules

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

text = "\\n".join(" ".join(f"w{k}_{i}" for i in range(12)) for k in range(60))
rows = pa.RecordBatch.from_pydict({"id": list(range(2400)), "h": list(range(2400)), "text": [f"{text} {k}" for k in range(2400)]})
assert sum(map(len, rows.column("text").to_pylist())) > 8e6
small = rows.slice(0, 2)
run = {"quality": quality_rules._apply(quality_rules.ALL_CONTENT, 0.5, ["id"], "text", True, False), "near": near_dup._sketches(5, 48)}[NAME]
list(run(iter([small])))
np.ones(3_000_000)  # after an array of that size glibc keeps up to twice as much
pa.default_memory_pool().release_unused()
before = held()
n = sum(b.num_rows for b in run(iter([rows])))
assert n == 2400
print(round(held() - before))
"""


@pytest.mark.skipif(platform.libc_ver()[0] != "glibc", reason="only glibc can be told to give memory back")
@pytest.mark.parametrize("name", ["quality", "near"])
def test_a_worker_holds_little_after_a_task(name):
    got = subprocess.run([sys.executable, "-c", f"NAME = {name!r}\n{TASK}"], capture_output=True, text=True, check=True)
    assert float(got.stdout) < 12, got.stdout
