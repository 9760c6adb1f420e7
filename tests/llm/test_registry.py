import re

import __spark_entry__ as entry


def test_one_query_for_each_operator_and_the_pipeline():
    names = entry.queries()
    numbers = sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14)) and "pipeline" in names
    assert {"op1_decontaminate", "op2_chat_format", "op3_secret_scan", "op8_warc", "op11_spelling",
            "op12_license_scan", "op13_centroids"} <= set(entry.oracle_sql())


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(entry.__file__).parent / "riskframe"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "riskframe.llm" not in f.read_text() and "corpus_pipeline" not in f.read_text(), f
