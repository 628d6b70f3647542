"""The core does without the operators for training data."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "quirework").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"(from|import)\s+\S*\bllm\b", p.read_text()), p


def test_every_query_has_a_name_of_its_own():
    import __spark_entry__ as entry

    names = [k for m in entry._modules() for k in m.QUERIES]
    assert len(names) == len(set(names)) and set(entry.oracle_sql()) <= set(names)
