"""The registered queries import without the packages that only the training-text operators need."""

import subprocess
import sys

import pytest

BLOCKED = """
import sys
sys.modules["{name}"] = None
import __spark_entry__
assert "e7_cumulative_payload" in __spark_entry__.queries() and not any(n.startswith("op1_") for n in __spark_entry__.queries())
"""


@pytest.mark.parametrize("name", ["touchline.llm", "corpus_pipeline", "tokenizers", "xxhash", "ahocorasick"])
def test_entry_survives_what_is_missing(name):
    subprocess.run([sys.executable, "-c", BLOCKED.format(name=name)], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
