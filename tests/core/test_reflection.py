"""A model's part in mining: hybrid and llm mode over tables of replies."""

import json

import pytest

from cairnlake.operators import mine

TURNS = "conv_id long, turn_offset long, user_message string, assistant_message string"
REPLIES = "conv_id long, turn_offset long, reply string"
KEY = "ghp_" + "a" * 24
CONFIG = "set the config option in settings.yaml to true and always use the environment variable for it"


def reply(**fields):
    return json.dumps({"should_record": True} | fields)


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(1, 0, "how", CONFIG), (2, 0, "how", CONFIG), (3, 0, "hello", "good day to you"), (4, 0, "hello", "my key is " + KEY), (5, 0, "hello", ""), (6, 0, "how", CONFIG), (7, 0, "hello", "fine")]
    return spark.createDataFrame(rows, TURNS)


@pytest.fixture(scope="module")
def replies(spark):
    rows = [
        (1, 0, reply(section="tools", knowledge_type="trick", instructivity_score=90, summary="unused")),
        (2, 0, None),
        (3, 0, "```json\n" + reply(instructivity_score="12") + "\n```"),
        (4, 0, reply(section="Poems", instructivity_score="none")),
        (5, 0, json.dumps({"should_record": False})),
        (6, 0, "no json"),
        (6, 0, None),
        (7, 0, reply(summary="a", instructivity_score=10)),
        (7, 0, reply(summary="b", instructivity_score=500)),
        (99, 0, reply(summary="of no turn")),
    ]
    return spark.createDataFrame(rows, REPLIES)


def found(df):
    return {(r.conv_id, r.pattern_type): r for r in df.collect()}


def test_hybrid(turns, replies):
    rules, got = found(mine.reflect(turns)), found(mine.reflect_with(turns, replies))
    assert set(rules) == {(i, "config_change") for i in (1, 2, 6)} and set(got) == set(rules) | {(4, "llm_evaluated"), (7, "llm_evaluated")}
    one, was = got[1, "config_change"], rules[1, "config_change"]
    assert (one.section, one.knowledge_type, one.content) == ("tools", "trick", was.content)
    assert one.instructivity_score == (90 + was.instructivity_score) / 2
    assert got[2, "config_change"] == rules[2, "config_change"] and got[6, "config_change"] == rules[6, "config_change"]
    four = got[4, "llm_evaluated"]
    assert (four.section, four.knowledge_type, four.instructivity_score, four.role) == ("general", "knowledge", 50.0, "assistant") and KEY not in four.content
    assert (got[7, "llm_evaluated"].content, got[7, "llm_evaluated"].instructivity_score) == ("b", 100.0)


def test_llm_mode_falls_back_where_no_reply_came(turns, replies):
    rules, got = found(mine.reflect(turns)), found(mine.reflect_with(turns, replies, "llm"))
    assert set(got) == {(1, "llm_evaluated"), (2, "config_change"), (4, "llm_evaluated"), (7, "llm_evaluated")}
    assert got[2, "config_change"] == rules[2, "config_change"] and got[1, "llm_evaluated"].content == "unused"


def test_own_words_are_redacted(spark, turns, replies):
    own = [(1, 0, "config_change", json.dumps({"content": "", "distilled_rule": "use " + KEY})), (2, 0, "config_change", "broken"), (7, 0, "llm_evaluated", None)]
    got = found(mine.reflect_with(turns, replies, distilled=spark.createDataFrame(own, "conv_id long, turn_offset long, pattern_type string, reply string")))
    assert got[1, "config_change"].content.startswith("use ") and KEY not in got[1, "config_change"].content
    assert got[2, "config_change"].content.startswith("Config: ") and got[7, "llm_evaluated"].content == "b"


def test_sanitised(spark):
    rows = spark.createDataFrame([(1, "use " + KEY), (2, None), (3, "room 12 of house 34"), (4, "")], "id long, content string")
    assert {r.id: r.content for r in mine.sanitised(rows, ["room [0-9]+", "("]).collect()} == {1: "use <GITHUB_TOKEN>", 3: "<REDACTED> of house 34", 4: ""}


def test_empty_tables_and_modes(spark, turns, replies):
    none, silent = spark.createDataFrame([], TURNS), spark.createDataFrame([], REPLIES)
    assert mine.reflect_with(none, replies).collect() == [] and mine.reflect_with(none, silent, "llm").collect() == []
    for mode in ("hybrid", "llm"):
        assert found(mine.reflect_with(turns, silent, mode)) == found(mine.reflect(turns))
    with pytest.raises(ValueError):
        mine.reflect_with(turns, replies, "both")
