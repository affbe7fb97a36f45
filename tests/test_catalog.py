import importlib.util

import __spark_entry__


def test_registry():
    names = __spark_entry__.queries()
    assert "budget_recall_pair_rarity" in names and len(names) > 90
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    if importlib.util.find_spec("logweir.llm") is None:
        assert not any(n.startswith("op") for n in names)
