"""What the driver's Python keeps of bounded work that it does itself."""

import subprocess
import sys

HELD = """
import re
import numpy as np
import pyarrow
from tessera.llm import op5_bpe_lexicon, op10_secret_crf

def mb():
    said = open("/proc/self/status").read()
    return [int(re.search(k + r":\\s+(\\d+)", said)[1]) / 1024 for k in ("RssAnon", "VmHWM")]

small = op10_secret_crf.trained(16, 1)
op10_secret_crf.trained.cache_clear()
held, before = mb()
op10_secret_crf.trained()
after, peak = mb()
print(after - held, peak - before)
"""


def test_training_leaves_nothing_behind():
    run = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True)
    left, most = map(float, run.stdout.split()[-2:])
    assert left < 25 and most < 75, (left, most)
