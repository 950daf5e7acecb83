"""A Python worker lives on between tasks and steps: a task must not leave freed memory held."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

PROBE = """
import random, sys
sys.path.insert(0, {root!r})
import pyarrow as pa
from slotledger.llm import ngram_join
from slotledger.llm.workers import release

def rss():
    for line in open("/proc/self/status"):
        if line.startswith("VmRSS"):
            return int(line.split()[1]) / 1024

rng = random.Random(1)
vocab = [f"w{{i}}" for i in range(5000)]
texts = [" ".join(rng.choice(vocab) for _ in range(400)) for _ in range(20000)]
batch = pa.RecordBatch.from_pydict(
    {{"doc_id": list(range(len(texts))), "address": [str(i) for i in range(len(texts))],
      "tie": list(range(len(texts))), "text": texts}}
)
del texts
release()
for out in ngram_join._shapes(5)(iter([batch])):  # as Spark does: each batch sent, then dropped
    out.nbytes
    del out
after_task = rss()
release()
print(after_task - rss())
"""


def test_a_shingle_task_gives_back_what_it_freed():
    done = subprocess.run(
        [sys.executable, "-c", PROBE.format(root=str(ROOT))], capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr
    assert float(done.stdout.split()[-1]) < 10  # MB a later release would still free
