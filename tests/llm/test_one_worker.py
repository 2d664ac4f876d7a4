"""The pipeline's stage of suffix-array dedup runs one Python function a task."""

import re

from atollkit.llm.suffix_dedup import deduplicated_documents


def test_text_is_made_where_its_bytes_are(spark):
    """A second function in the same task took a Python worker of its own, and an executor kept both for all later stages."""
    line = "Grüße aus dem Tal, in dem jeder Text dieselbe lange Zeile mit Ü führt. "
    rows = [(1, "a", line + "eins", 0), (2, "b", "zwei " + line[:-1] + "ß", 0), (3, None, None, None)]
    out = deduplicated_documents(spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and not re.search("ArrowEvalPython|BatchEvalPython", plan)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "source", "text", "n_chars"]
    assert got[1].text == line + "eins" and got[1].n_chars == len(got[1].text) and got[3].text == "" and got[3].source is None
    assert got[2].text.startswith("zwei ") and len(got[2].text) < 20 and got[2].n_chars == len(got[2].text)
