from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import privacy, score, text, udfs

NOW = datetime(2024, 2, 1)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


STEMS = {
    "running": "run", "ran": "run", "creation": "create", "action": "act" + "", "confusion": "confu", "happiness": "happi", "development": "develop", "quickly": "quick",
    "making": "make", "stopping": "stop", "played": "play", "stopped": "stop", "studied": "study", "faster": "fast", "bigger": "big", "fastest": "fast", "flies": "fly", "matches": "match",
    "boxes": "box", "cats": "cat", "glass": "glass", "the": "the", "ther": "ther", "goes": "go", "notes": "note", "being": "be",
}


def test_stems_agree(spark):
    words = [*STEMS, "x", "sing", "need", "king", "ties", "aneaing", "uses", "passes", "version", "division", "occasion", "nation", "station", "ment", "cement", "best", "tests", "ly", "fly", "red", "shed", "her", "otter"]
    df = spark.createDataFrame([(w,) for w in words], ["w"]).select("w", text.stem(F.col("w")).alias("s"))
    got = {r.w: r.s for r in df.collect()}
    assert got == {w: text.stem_word(w) for w in words}
    for w in ("running", "ran", "creation", "happiness", "development", "quickly", "making", "stopping", "stopped", "studied", "faster", "fastest", "flies", "matches", "boxes", "cats", "glass", "the", "being"):
        assert got[w] == STEMS[w]


def test_query_terms():
    assert text.query_terms("How do I use the Git rebase git? 数据库 与 数据库") == (["use", "git", "rebase"], ["数据库", "与"])
    assert text.query_terms("") == ([], [])


def test_word_boundaries(spark):
    for t, hit in (("use git now", True), ("digit", False), ("使用git进行", True), ("git_x", False), ("GIT!", True)):
        assert one(spark, text.has_word(F.col("t"), "git"), t=t) is hit


def test_bigrams_and_mixed_tokens(spark):
    t = "数据库 running the 库 tests"
    assert one(spark, text.cjk_bigrams(F.col("t")), t=t) == ["数据", "据库", "库"]
    assert one(spark, text.mixed_tokens(F.col("t")), t=t) == ["数据", "据库", "库", "run", "test"] == text.literal_tokens(t)
    assert one(spark, text.token_hits(F.col("t"), ["run", "run", "数据", "test", "none"]), t=t) == 4


def test_estimates(spark):
    assert one(spark, text.estimate_tokens(F.col("t")), t="数据库abcd") == 3
    assert one(spark, text.estimate_tokens(F.lit(""))) == 0 and one(spark, text.estimate_prompt_tokens(F.lit(""))) == 0
    assert one(spark, text.estimate_prompt_tokens(F.lit("abc"))) == 1 and one(spark, text.estimate_prompt_tokens(F.lit("abcd"))) == 2


def test_truncation(spark):
    assert one(spark, text.truncate_sentence(F.lit("short"), 10)) == "short"
    assert one(spark, text.truncate_sentence(F.lit("abcdef. ghijkl"), 10)) == "abcdef."
    assert one(spark, text.truncate_sentence(F.lit("abcdefghijklm"), 10)) == "abcdefghij..."
    assert one(spark, text.truncate_sentence(F.lit("ab. cdefghijklm"), 10)) == "ab. cdefgh..."
    assert one(spark, text.truncate_lines(F.lit("a\nb\nc"), 2)) == "a\nb\n..."
    assert one(spark, text.snippet(F.lit("short"))) == "shor..." and one(spark, text.snippet(F.lit("0123456789abcdef"))) == "01234567...cdef"


def test_entities_tools_versions(spark):
    t = 'Use `git rebase` with "main branch" in MyClass via config.yaml and 2.0'
    assert one(spark, text.entities(F.col("t")), t=t) == ["MyClass", "config.yaml", "git rebase", "main branch"]
    assert one(spark, text.known_tools(F.lit("Docker and git; digit"))) == ["docker", "git"]
    got = one(spark, text.versions(F.lit("react@18.2.0 and react 17, step 3, python 3.11")))
    assert [(r.tool, r.ver) for r in got] == [("react", "18.2.0"), ("python", "3.11")]
    assert one(spark, text.version_conflict(F.lit("use react 17"), F.lit("use react 18"))) is True
    assert one(spark, text.version_conflict(F.lit("use react 17"), F.lit("use vue 18"))) is False


def test_negations_and_antonyms(spark):
    assert one(spark, text.count_negations(F.lit("Do not, never! avoid don't. 请勿使用 ok"))) == 5
    assert one(spark, text.opposing(text.bare_words(F.lit("Never enable it.")), text.bare_words(F.lit("always disable")))) == "never vs always"
    assert one(spark, text.opposing(text.bare_words(F.lit("a")), text.bare_words(F.lit("b")))) is None


def test_merge_sentences(spark):
    assert one(spark, text.merge_sentences(F.lit("A one. B two."), F.lit("b TWO. C three."))) == "A one B two C three"
    assert one(spark, text.merge_sentences(F.lit(" "), F.lit(" x. "))) == "x."


def test_slug_and_markdown(spark):
    assert one(spark, text.slug(F.lit(" Foo_Bar: Baz! "))) == "foo-bar-baz" and one(spark, text.slug(F.lit("!!"))) == "untitled" and one(spark, text.slug(F.lit("数据 库"))) == "数据-库"
    assert one(spark, text.escape_markdown(F.lit("a*b_[c]\n `d`"))) == r"a\*b\_\[c\] \`d\`"


def test_code_heavy(spark):
    code = "import os\ndef f():\n    return {}\nx = 1"
    assert one(spark, text.code_heavy(F.lit(code))) is True
    assert one(spark, text.code_heavy(F.lit("plain words here\nmore plain words\nand more of them"))) is False and one(spark, text.code_heavy(F.lit("x = {}"))) is False


SECRETS = [
    ("Bear" + "er eyJ" + "abc.def.ghi", "<BEARER_TOKEN>"), ("eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12, "<JWT>"), ("sk-" + "ant-" + "x" * 24, "<ANTHROPIC_KEY>"),
    ("sk-" + "proj-" + "y" * 24, "<OPENAI_KEY>"), ("gsk" + "_" + "z" * 24, "<GROQ_KEY>"), ("gh" + "p_" + "q" * 24, "<GITHUB_TOKEN>"), ("AK" + "IA" + "A" * 16, "<AWS_KEY>"),
    ("secret_key = " + "k" * 40, "secret_key = <AWS_SECRET>"), ("postgres://u:p@h/db", "postgres://<REDACTED>:<REDACTED>@h/db"), ("redis://:p@h", "redis://<REDACTED>:<REDACTED>@h"),
    ("api_key=abc", "api_key=<REDACTED>"), ("password: hunter", "password: <REDACTED>"), ("a.b@c.org", "<EMAIL>"), ("+1 5551234567", "<PHONE>"), ("1234 5678 1234 5678", "<CREDIT_CARD>"),
    ("123-45-6789", "<SSN>"), ("C:" + chr(92) + "Users" + chr(92) + "me", "<USER_PATH>"), ("/home/me/x", "<USER_PATH>/x"), ('token = "abc"', 'token = "abc"'), ("clean text", "clean text"),
]


@pytest.mark.parametrize("secret,clean", SECRETS)
def test_redaction(spark, secret, clean):
    assert one(spark, privacy.redact(F.col("t")), t=f"x {secret} y") == f"x {clean} y"


def test_team_and_custom_redaction(spark):
    t = "at 10.1.2.3 and http://internal.corp/x in /home/me/projects/y zz-9"
    assert one(spark, privacy.redact_team(F.col("t"), ["zz-[0-9]", "(bad"]), t=t) == "at [INTERNAL_IP] and [INTERNAL_URL] in [PROJECT_PATH] <REDACTED>"
    assert one(spark, privacy.fully_redacted(F.lit("<EMAIL> [INTERNAL_IP] "))) is True and one(spark, privacy.fully_redacted(F.lit("x <EMAIL>"))) is False
    df = privacy.redaction_counts(spark.createDataFrame([("a@b.org c@d.org",)], ["t"]), "t").first()
    assert df.n_email == 2 and df.clean == "<EMAIL> <EMAIL>"


def test_decay(spark):
    def weight(days, recalls):
        return one(spark, score.decay_weight(F.col("c"), F.col("r"), F.lit(NOW)), c=NOW - timedelta(days=days), r=recalls)

    assert weight(400, 15) == 1.0 and weight(7, 0) == 1.0 and weight(-3, 0) == 1.0
    assert weight(30, 0) == pytest.approx(0.5) and weight(30, 5) == pytest.approx(0.75) and weight(60, 14) == pytest.approx(0.6)
    assert one(spark, score.decay_status(F.lit(NOW - timedelta(days=300)), F.lit(0), F.lit(NOW))) == "archived"


def test_recency_boundaries(spark):
    for days, factor in ((0, 1.2), (7, 1.2), (7.001, 1.0), (-5, 1.2)):
        assert one(spark, score.recency(F.lit(NOW - timedelta(days=days)), F.lit(NOW))) == factor
    assert one(spark, score.recency(F.lit(None).cast("timestamp"), F.lit(NOW))) == 1.0


def test_cosines(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, score.cosine(v(1, 0), v(1, 1))) == pytest.approx(0.7071, abs=1e-4) and one(spark, score.cosine(v(0, 0), v(1, 1))) == 0 and one(spark, score.cosine(v(1), v(1, 1))) == 0
    assert one(spark, score.short_cosine(v(1, 0, 9), v(1, 0))) == 1.0 and one(spark, score.short_cosine(v(1, 0), v(-1, 0))) == 0.0
    pooled = one(spark, score.mean_pool(F.array(v(1, 0), v(0, 1), v(9, 9)), F.array(F.lit(1), F.lit(1), F.lit(0))))
    assert pooled == pytest.approx([2**-0.5, 2**-0.5])


def test_sets_and_triage(spark):
    a = lambda *x: F.array(*[F.lit(i) for i in x])
    assert one(spark, score.jaccard(a("x", "y"), a("y", "z"))) == pytest.approx(1 / 3) and one(spark, score.drift(a("x", "y"), a("y"))) == 0.5
    assert one(spark, score.conflict_confidence(F.lit(0.7), F.lit("contradiction"))) == 0.665
    assert [one(spark, score.triage(F.lit(c))) for c in (0.9, 0.85, 0.6, 0.4)] == ["supersede", "supersede", "review", "mark"]
    assert one(spark, score.governance_tier(F.lit(95.0), a("Security"))) == "curator_required" and one(spark, score.governance_tier(F.lit(90.0), a("x"))) == "auto_approve"
    assert one(spark, score.effective_score(F.lit(98.0), F.lit(5), F.lit(1))) == 100.0 and [one(spark, score.trust_score(F.lit(s))) for s in ("verified", "stale", "unverifiable")] == [1.0, 0.3, 0.7]
    assert one(spark, score.vector_score(F.lit(-0.5))) == 0.25 and one(spark, score.vector_score(F.lit(1.5))) == 1.0
    assert score.blend_weights(True) == (0.6, 0.4) and score.blend_weights(False) == (1.0, 0.0)
    assert one(spark, score.purpose_adjusted(F.lit(10.0), a("a", "b"), [["a", "b"]], [["a"]])) == 3.0 and one(spark, score.purpose_adjusted(F.lit(10.0), a("a"), [["a", "b"]], [["a"]])) == 12.0


def test_python_functions(spark):
    assert one(spark, udfs.unicode_tokens(F.col("t")), t="Ｆｏｏ bar BAR") == ["bar", "foo"]
    assert one(spark, udfs.yaml_fields(F.col("t")), t="a: 1\nb: x") == {"a": "1", "b": "x"} and one(spark, udfs.yaml_fields(F.col("t")), t="a: [") == {}
    assert "-x" in one(spark, udfs.review_diff(F.lit("x"), F.lit("y")))


def test_corrections_at_word_borders_of_all_letters(spark):
    """The operator and its SQL agree beside letters outside ASCII; missing texts are no corrections."""
    import duckdb

    from cairnlake.operators import mine
    from cairnlake.plans import sqltext

    texts = ["no élan", "éno way", "no", "no, we", "ünwrong", "wrongé", "wrong", "that's not it", "don't", "don'té", "NO then", "piano x", "sorry, I meant", None, "no ", "a\nno\nb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = [r[0] for r in df.orderBy("i").select(mine.is_correction(F.col("t"))).collect()]
    assert got == [True, False, False, True, False, False, True, True, True, False, True, False, True, False, False, True]
    assert got == [duckdb.execute(f"SELECT {sqltext.is_correction('?::VARCHAR')}", [t]).fetchall()[0][0] for t in texts]
