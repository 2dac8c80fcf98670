"""The near-copies stage shuffles its texts once for the semi-join and the window over repeated rows, and keeps whole rows."""

import re

from oddsmith.llm import jaccard

TEXT = "a text of some eight words or more that is kept as it stands here"


def test_one_shuffle_of_texts(spark):
    rows = [(1, TEXT, "x"), (1, TEXT, "y"), (2, TEXT, "z"), (None, "other words that no one else has written down so far", "n"), (None, "other words that no one else has written down so far", "m"), (0, None, "e"), (None, None, "f"), (0, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    out = jaccard.keep_one(docs)
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]", plan)
    assert sum(bool(re.search(r"\btext#", x)) for x in moved) == 1
    got = out.collect()
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, TEXT), (None, rows[3][1]), (0, None), (None, None), (0, "")], key=repr)
    assert all((r.doc_id, r.text, r["a.b"]) in rows for r in got)
