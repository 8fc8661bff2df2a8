import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from differential import connect, same  # noqa: E402

from tallyloom.llm import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name], connect(sf_dir))


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2] / "tallyloom"
    assert not [f for f in root.rglob("*.py") if "llm" not in f.parts and ".llm" in f.read_text()]
