"""Purpose files, the fields that fill gaps, the gate and the scores."""

import pytest

from cairnlake.operators import purpose

FULL = """---
scope: team:backend
keywords: [ui-design, 12, ""]
excluded_topics: "poems, "
nominate_threshold: "0.4"
---

 Ship small services.
"""


def read(spark, *texts):
    files = spark.createDataFrame([(i, "o", t) for i, t in enumerate(texts)], "pool long, owner string, value string")
    return purpose.parsed(files)


def rows_of(df):
    return {r.pool: (r.scope, r.keywords, r.excluded_topics, r.intent_body, r.threshold) for r in df.collect()}


def test_files(spark):
    got = rows_of(read(spark, FULL, "no header\n", None, "---\n- a list\n---\nbody", "---\nscope: [broken\n---\nbody", FULL.replace("\n", "\r\n"), "---\nscope: 2024-13-45\n---\n", "--- not a header"))
    assert got[0] == got[5] == ("team:backend", ["ui-design", "12"], ["poems"], "Ship small services.", 0.4)
    assert got[1] == ("", [], [], "no header", 0.6) and got[2] == ("", [], [], "", 0.6)
    assert got[3] == got[4] == ("", [], [], "body", 0.6)
    assert got[6] == ("", [], [], "", 0.6) and got[7] == ("", [], [], "--- not a header", 0.6)


def test_project_over_global(spark):
    common = "---\nscope: all\nkeywords: k\nnominate_threshold: 0.3\n---\nshared"
    project = read(spark, FULL, None, "---\nexcluded_topics: x\n---\n")
    got = rows_of(purpose.merged(project, read(spark, common), "owner"))
    assert got[0] == ("team:backend", ["ui-design", "12"], ["poems"], "Ship small services.", 0.4)
    assert got[1] == ("all", ["k"], [], "shared", 0.3) and got[2] == ("all", ["k"], ["x"], "shared", 0.3)
    alone = purpose.merged(project, read(spark, common).where("false"), "owner")
    assert rows_of(alone) == rows_of(project)


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (1, 0, "a design for the ui", None), (2, 0, "Ship it", None), (3, 0, "ship small things", None), (4, 0, " ", None), (5, 0, None, None),
        (6, 0, "unrelated", [1.0, 0.1]), (7, 0, "ui design", [0.0, 1.0]), (8, 0, "ui design", [1.0, 0.0, 0.0]), (9, 0, "ui design", []), (10, 1, "", None), (11, None, "x", None), (12, 7, "x", None), (13, 0, "ui design", [0.0, 0.0]),
    ]
    return spark.createDataFrame(rows, "id long, pool long, content string, embedding array<double>")


def test_gate(spark, records):
    pools = read(spark, FULL, "").drop("owner")
    with_vector = pools.join(spark.createDataFrame([(0, [1.0, 0.0])], "pool long, purpose_vector array<double>"), "pool", "left")
    got = {r.id: (r.nominated, r.decided_by) for r in purpose.nominations(records, with_vector).collect()}
    words = {1: True, 2: False, 3: True, 4: False, 5: False, 8: True, 9: True}
    assert {i: got[i] for i in words} == {i: (v, "words") for i, v in words.items()}
    assert got[6] == (True, "vector") and got[7] == (False, "vector") and got[13] == (False, "vector")
    assert got[10] == got[11] == got[12] == (True, "open")
    plain = {r.id: r.nominated for r in purpose.nominations(records.drop("embedding"), pools, threshold=0.9).collect()}
    assert plain[3] is False and plain[7] is True and len(plain) == 13
    assert purpose.nominations(records.where("false"), pools).collect() == [] and purpose.nominations(records, pools.where("false")).where("not nominated").count() == 0


def test_scores(spark):
    rows = spark.createDataFrame([(1, 0, "Poems of ui design", 10.0), (2, 0, "UI design", 10.0), (3, 0, "ui", 10.0), (4, 0, None, 10.0), (5, 9, "poems", 10.0), (6, 0, "poems", None)], "id long, pool long, content string, points double")
    got = {r.id: r.points for r in purpose.adjusted(rows, read(spark, FULL).drop("owner"), "points").collect()}
    assert got == {1: 3.0, 2: 12.0, 3: 10.0, 4: 10.0, 5: 10.0, 6: None}


def test_purposes_after_other_word_functions(spark):
    """Functions that were used before in the session must not travel with those of phrases; missing texts have no words."""
    from pyspark import cloudpickle
    from pyspark.sql import functions as F

    from cairnlake.functions import udfs

    texts = spark.createDataFrame([("b a",), (None,), ("",)] + [(f"x{i}",) for i in range(300)], "t string")
    got = [r[0] for r in texts.coalesce(1).select(udfs.unicode_tokens(F.col("t"))).collect()]
    assert got == [["a", "b"], [], []] + [[f"x{i}"] for i in range(300)]
    cloudpickle.dumps(purpose._phrases.func)
    pools = read(spark, FULL).selectExpr("'p' AS pool", "scope", "keywords", "excluded_topics", "intent_body", "threshold")
    records = spark.createDataFrame([("UI design, 12", "p", 10.0), ("poems", "p", 10.0), ("poems", None, 10.0)], "content string, pool string, points double")
    assert [r.points for r in purpose.adjusted(records, pools, "points").collect()] == pytest.approx([12.0, 3.0, 10.0])
