"""Test files of one name in two folders are modules of their own."""

from collections import Counter
from pathlib import Path


def test_every_test_file_has_a_module_name_of_its_own():
    here = Path(__file__).parent
    names = Counter(".".join([f.parent.name] * (f.parent / "__init__.py").exists() + [f.stem]) for f in here.rglob("test_*.py"))
    assert max(names.values()) == 1, names
