import re
from pathlib import Path

import numpy as np
import pytest

from fleetlens.llm import memory


def _held():
    return sum(map(int, re.findall(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="needs Linux")
def test_freed_arrays_are_given_back():
    def run(batches):
        for n in batches:
            parts = [np.ones(1 << 17) for _ in range(n)]  # 1 MB each, below the threshold
            pin = np.ones(64)
            del parts
            yield pin

    before = _held()
    kept = list(memory.sparing(run)(iter([100, 100])))
    assert len(kept) == 2
    assert _held() - before < 50
