"""The pipeline against a version by hand: which documents each stage must keep, and what the mix then takes."""

import random
from collections import Counter

import corpus_pipeline
from cairnlake.llm import mixing

from .test_operators import brute_components, prose

DE, EN = "und der die nicht ein ich schön über straße haus kind".split(), "the and of with that this from have which house child".split()


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    say = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "s", "en", "er"]) + str(rng.randint(0, 99)) for _ in range(n))
    item = prose(777, 30)
    rows = [(i, say(*((DE, 60) if i % 3 == 0 else (EN, 60))), "de" if i % 3 == 0 else "en", f"s{i % 4}") for i in range(120)]
    rows += [(200, "123 456 !!", "en", "s0"), (201, None, None, "s1"), (202, "", "en", None)]  # no letter
    rows += [(300 + i, rows[i][1] + (" more" if i % 2 else ""), rows[i][2], "s2") for i in range(20)]  # copies
    rows += [(400, say(EN, 80) + " " + item + " " + say(EN, 40), "en", "s1")]  # holds a benchmark item
    rows += [(500, say(EN, 30) + " mail a.b@c.example.org " + say(EN, 30), "en", "s3")]  # personal data
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    spoken = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    low = brute_components([(r[0], r[1]) for r in spoken], 5, 80)
    left = [r for r in spoken if low[r[0]] == r[0] and item not in r[1]]
    left = [(i, t.replace("a.b@c.example.org", "<EMAIL>"), lang, s) for i, t, lang, s in left]
    assert {400, 201, 300, 301}.isdisjoint(r[0] for r in left) and 500 in {r[0] for r in left}
    taken = mixing.mix(spark.createDataFrame(left, "doc_id long, text string, lang string, source string")).collect()
    want = Counter({r.doc_id: r.taken // r.size for r in taken if r.taken})

    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in out) == want
    texts = {i: (t, len(t)) for i, t, _, _ in left}
    assert all((r.text, r.n_chars) == texts[r.doc_id] and r.copies == want[r.doc_id] for r in out)


def test_stages_keep_the_columns_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns, name
        assert out.collect() == []
