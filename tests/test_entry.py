"""The contract's entry points, with and without the training-data subpackage."""

import importlib
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def test_queries_without_the_subpackage(monkeypatch):
    """Where it can't be imported, for want of itself or of a library, the others are still there."""
    import __spark_entry__

    every = set(__spark_entry__.queries())
    for gone in ("tramline.llm", "corpus_pipeline"):
        with monkeypatch.context() as m:
            m.setitem(sys.modules, gone, None)
            entry = importlib.reload(__spark_entry__)
            some = set(entry.queries())
            assert some and not any(n.startswith("op") and n[2:3].isdigit() for n in some) and "pipeline" not in some
            assert some <= every and set(entry.oracle_sql()) <= some
    assert set(importlib.reload(__spark_entry__).queries()) == every


def test_every_oracle_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
