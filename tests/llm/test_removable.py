import pathlib
import re


def test_nothing_else_imports_this_subpackage():
    root = pathlib.Path(__file__).parents[2] / "graphloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s+.*\bllm\b", p.read_text(), re.M), p
