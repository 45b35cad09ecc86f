"""Workers stay between tasks: what a task has freed must not stay with them."""

import subprocess
import sys
from pathlib import Path

RUN = """
import random, re, sys
import numpy as np, pandas as pd, pyarrow as pa
import pyspark.worker, public_tokenizers
from keystrata.llm import classifier, common, packing, similar

def mb():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

class Task:
    get = partitionId = staticmethod(lambda: 0)

def frames(n=6):
    for k in range(n):
        rng = random.Random(k)
        texts = [" ".join("%x" % rng.getrandbits(24) for _ in range(150)) for _ in range(500)]
        yield pd.DataFrame({"doc_id": range(500), "text": texts})

Task.get = staticmethod(lambda: Task)
packing.TaskContext = Task
path = public_tokenizers.path("word_bpe_49k.json")
model = classifier.Model(np.zeros(1 << 18), np.zeros(1 << 18), 0.0, 1.0, 0.0)
began, after = mb(), []
for run in (lambda: classifier._keep(map(pa.RecordBatch.from_pandas, frames()), model, 0.3), lambda: packing._pack_partition(frames(), path, 4096, 64), lambda: similar._survey(frames(1), 5)):
    for _ in run():
        pass
    after.append(mb() - began)
print(*after, "tokenizer" in vars(packing._word_ids(path)))
"""


def test_worker_gives_memory_back():
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", RUN], cwd=root, env={"PYTHONPATH": f"{root}:{':'.join(sys.path)}", "OMP_NUM_THREADS": "1"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    *after, tokenizer = done.stdout.split()
    # what the packing knew has gone with its tokenizer
    assert tokenizer == "False"
    assert float(after[2]) < 48, after
