"""Quality rules: measures by hand, the cascade against every rule on every text, and awkward tables."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnlake.llm import rules

SCHEMA = "doc_id long, text string, source string"


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    full = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": sum(x in full[:i] for i, x in enumerate(full)),
        "n_repeat_words": len(covered), "n_lines": len(full), "n_ends": len(re.findall(r"[.!?]", text)), "n_digits": len(re.findall(r"[0-9]", text)), "n_capitals": len(re.findall(r"[A-Z]", text)),
    }


def verdict(text):
    found = by_hand(text)
    return not any(rule.rejects(*(found[m] for m in rule.reads)) for rule in rules.RULES)


def texts():
    rng = random.Random(4)
    words = "one two Three öne 日本 naïve end. stop! what? 42 $5 #tag a|b <p> THE".split()
    made = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 4, 5, 9, 10, 11, 60, 300)]
    made += ["\n".join(rng.choice(made[:8]) for _ in range(12)), "a b c d e " * 9, "A b c d e a b c d e", "x\n x\nx\n\n\n x", " \t\r\n\v\f", "\n", "word word " * 12, "same line here.\n" * 3 + "other words in a line. " * 4]
    prose = [" ".join("".join(rng.choices("abcdefgh", k=5)) + ("." if rng.random() < 0.1 else "") for _ in range(400)) for _ in range(4)]
    return made + prose + [None, prose[0] + "\n" + prose[0], " ".join(prose) * 3, "y" * 3_000_000, "Y" * 3_000_000]


def test_measures_by_hand(spark):
    rows = [(i, t, "a") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in rules.judge(df, measures=tuple(rules.MEASURES)).collect()}
    kept = {r.doc_id for r in rules.keep(df).collect()}
    for i, text, _ in rows:
        assert {m: got[i][m] for m in rules.MEASURES} == by_hand(text), repr(text)[:80]
        assert got[i].kept == (i in kept) == verdict(text), repr(text)[:80]
    assert any(r.kept for r in got.values()) and not all(r.kept for r in got.values())


def test_long_words_keep_their_case():
    hasher = rules.CasedHasher()
    low, high = "y" * 3_000_000, "Y" * 3_000_000
    five = lambda a, b: " ".join([a, "p", "q", "r", "s", "t", b, "p", "q", "r", "s"])
    n = rules.repeat_words(rules.Texts(pa.array([five(low, high), five(low, low)]), hasher))
    assert n.tolist() == [0, 10]


def test_order_by_rejections_a_second():
    """The best rate first; a measure that is known costs nothing; what earlier rules reject no longer counts."""
    one = rules.Rule("one", ("n_words",), lambda n: n < 1)
    two = rules.Rule("two", ("n_repeat_words",), lambda n: n > 1)
    three = rules.Rule("three", ("n_lines",), lambda n: n > 1)
    seconds = {"words": 1.0, "n_words": 0.1, "n_repeat_words": 5.0, "lines": 2.0, "n_lines": 0.1}
    names = lambda *args, **kw: [r.name for r in rules.ordered((one, two, three), *args, **kw)]
    assert names(seconds, {frozenset({"two"}): 9, frozenset({"three"}): 1, frozenset(): 90}) == ["two", "three", "one"]
    assert names(seconds, {frozenset({"two"}): 9, frozenset({"three", "two"}): 8, frozenset({"one"}): 1, frozenset(): 90})[0] == "three"
    assert names(seconds, {frozenset({"two"}): 9, frozenset({"one"}): 1}, known=("n_words",))[0] == "one"


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 0, 2)])
def test_any_order_gives_one_verdict_and_takes_less(order):
    """Later rules see only what earlier ones left: their measure is taken for fewer texts."""
    column = pa.array([t or "" for t in texts()[:-2]])
    picked = [(rules.RULES[0], rules.RULES[1], rules.RULES[3])[i] for i in order]
    seen = []
    last = rules.Rule("last", ("n_ends",), lambda n: seen.append(len(n)) or n < 0)
    kept = rules.cascade(rules.Texts(column, rules.CasedHasher()), [*picked, last])
    expected = [not any(r.rejects(*(by_hand(t)[m] for m in r.reads)) for r in picked) for t in column.to_pylist()]
    assert kept.tolist() == expected and seen == [sum(expected)]


def test_awkward_tables(spark):
    rows = [(1, "a good sentence of plain words, long enough to be kept.", None), (1, "a good sentence of plain words, long enough to be kept.", None), (None, None, None), (None, "short", "a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("kept", "n_words", "id", "measure")})
    got = [(r.doc_id, r.n_words, r.kept) for r in rules.judge(df, measures=("n_words",)).collect()]
    assert sorted(got, key=str) == [(1, 11, True), (1, 11, True), (None, 0, False), (None, 1, False)]
    out = rules.keep(df)
    assert out.columns == df.columns and [(r.doc_id, r.kept) for r in out.collect()] == [(1, "clash")] * 2
    empty = spark.createDataFrame([], SCHEMA)
    assert rules.judge(empty, measures=rules.BASE).collect() == [] and rules.keep(empty).collect() == []
