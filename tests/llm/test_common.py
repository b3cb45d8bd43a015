import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

from graphloom.llm import bpe, common, decontam, pii, quality_model, simhash

_CODE = """
import re
from graphloom.llm.common import lean

def held():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024

pins = []

def run(batches):
    for batch in batches:
        blocks = [bytes([65]) * 100_000 for _ in range(2000)]
        pins.append(bytearray(100_000))  # what lives on behind the freed blocks
        yield len(blocks)

before = held()
assert list(lean(run)(range(2))) == [2000, 2000]
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="reads /proc")
def test_a_lean_pass_gives_its_memory_back():
    root = str(Path(common.__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", _CODE], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root}, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 60  # MB, of 190 that were held at once


def test_passes_of_the_pipeline_are_lean():
    for module in (bpe, decontam, pii, quality_model, simhash):
        calls = re.findall(r"mapInArrow\(([^,]*),", Path(module.__file__).read_text())
        assert calls and all(c.startswith("lean(") for c in calls), module
