"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it. Rules read measures of whole texts (words, characters, lines, repeated windows), which are
worked out for an Arrow batch at once and shared between rules. Cost (processor seconds a measure takes) and selectivity
(which rules reject which documents) are estimated on a sample; then the rule with most rejections per second goes first, next the
best among what it leaves, counting only measures that are not known by then. A measure is taken only
for documents that no earlier rule rejected. The order decides what a document costs, never whether it is kept.

The sample is ``sampled`` rows in expectation (all of a smaller table); it serves the order alone, and only counts by set of rejecting rules
come to the driver. Defined results: null counts as the empty text, which has no words and fails; words of 64-bit hashes stand for
words when windows are compared; lines are compared as they are; rows that share an id are judged each; repeated rows and ties get
equal results; an empty table gives an empty result. Extra columns are not read by ``judge`` and kept by ``keep``.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, U64, WordHasher, mix64, seeded, slices

#: Rows on which costs and selectivities are estimated.
SAMPLED = 2000
WINDOW = 5
BLANKS = "\x20\t\n\v\f\r"
# Characters that count as symbols, and marks that end a sentence.
SYMBOLS, ENDS = b"#*$%&|<>", b".!?"


class CasedHasher(WordHasher):
    """Word hashes in which upper and lower case differ."""

    def __init__(self) -> None:
        super().__init__()
        self.value = seeded(256, 11) | U64(1)

    def of_spans(self, data, starts, ends):
        out = super().of_spans(data, starts, ends)
        for i in np.flatnonzero(ends - starts > CHUNK):
            out[i] = int.from_bytes(hashlib.blake2b(bytes(data[starts[i] : ends[i]]), digest_size=8).digest(), "little")
        return out


class Texts:
    """A batch of texts with what is known of them: parts (arrays over the whole batch) and measures (one number a text)."""

    def __init__(self, column: pa.Array, hasher: CasedHasher, known: dict | None = None) -> None:
        self.column = column.fill_null("") if column.null_count else column
        self.hasher = hasher
        self.known: dict = dict(known or {})
        self.seconds: dict[str, float] = {}
        self.inner = 0.0

    def __getitem__(self, name: str):
        """A part or measure, worked out when first asked for; ``seconds`` has its own time, without that of parts it needs."""
        if name not in self.known:
            outer, self.inner, began = self.inner, 0.0, time.process_time()
            self.known[name] = (PARTS.get(name) or MEASURES[name])(self)
            took = time.process_time() - began
            self.seconds[name], self.inner = took - self.inner, outer + took
        return self.known[name]

    def take(self, rows: np.ndarray) -> Texts:
        return Texts(self.column.take(pa.array(rows)), self.hasher, {name: value[rows] for name, value in self.known.items() if name in MEASURES})

    def count(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        run = np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])
        off = self["bounds"]
        return run[off[1:]] - run[off[:-1]]

    def bytes_in(self, low: int, high: int) -> np.ndarray:
        data = self["words"][0]
        return self.count((data >= low) & (data <= high))


def bounds(t: Texts) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pa.compute.binary_length(t.column).to_numpy(zero_copy_only=False).astype(np.int64))])


def lines(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that are equal to an earlier line of their text."""
    n, again = np.zeros(len(t.column), np.int64), np.zeros(len(t.column), np.int64)
    for i, text in enumerate(t.column.to_pylist()):
        full = [line for line in text.split("\n") if line.strip(BLANKS)]
        n[i], again[i] = len(full), len(full) - len(set(full))
    return n, again


def repeat_words(t: Texts) -> np.ndarray:
    """Words that stand in a window which their text has twice or more."""
    data, starts, ends, first = t["words"]
    n = len(starts) - WINDOW + 1
    if n < 1:
        return np.zeros(len(t.column), np.int64)
    words = t.hasher.of_spans(data, starts, ends)
    owner = np.repeat(np.arange(len(t.column)), np.diff(first))
    inside = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    with np.errstate(over="ignore"):
        key = mix64(owner[inside].astype(U64) + U64(1))
        for j, factor in enumerate(seeded(WINDOW, 5) | U64(1)):
            key += words[inside + j] * factor
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    repeated = inside[times[which] > 1]
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, repeated, 1)
    np.add.at(edge, repeated + WINDOW, -1)
    run = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return run[first[1:]] - run[first[:-1]]


#: Arrays that several measures share.
PARTS: dict[str, Callable] = {
    "bounds": bounds,
    "words": lambda t: t.hasher.spans(t.column),
    "lines": lines,
}
#: Numbers of a text, and the parts they need.
MEASURES: dict[str, Callable] = {
    "n_words": lambda t: np.diff(t["words"][3]),
    "word_chars": lambda t: t.count(t.hasher.word[t["words"][0]] & ((t["words"][0] & 0xC0) != 0x80)),
    "n_symbols": lambda t: t.count(np.isin(t["words"][0], np.frombuffer(SYMBOLS, np.uint8))),
    "n_ends": lambda t: t.count(np.isin(t["words"][0], np.frombuffer(ENDS, np.uint8))),
    "n_digits": lambda t: t.bytes_in(48, 57),
    "n_capitals": lambda t: t.bytes_in(65, 90),
    "n_lines": lambda t: t["lines"][0],
    "n_dup_lines": lambda t: t["lines"][1],
    "n_repeat_words": repeat_words,
}
NEEDS = {
    "n_words": ("words",), "word_chars": ("words", "bounds"), "n_symbols": ("words", "bounds"), "n_ends": ("words", "bounds"), "n_digits": ("words", "bounds"),
    "n_capitals": ("words", "bounds"), "n_lines": ("lines",), "n_dup_lines": ("lines",), "n_repeat_words": ("words",),
}


class Rule(NamedTuple):
    """Rejects documents by measures: ``rejects`` takes them in the order of ``reads``, as arrays or columns."""

    name: str
    reads: tuple[str, ...]
    rejects: Callable


#: Limits follow published heuristics for web text, wide enough for short documents; the first two are the base rules.
RULES = (
    Rule("few words", ("n_words",), lambda words: words < 10),
    Rule("repeated windows", ("n_words", "n_repeat_words"), lambda words, repeated: 100 * repeated > 20 * words),
    Rule("word length", ("n_words", "word_chars"), lambda words, chars: (chars < 3 * words) | (chars > 10 * words)),
    Rule("symbols", ("n_words", "n_symbols"), lambda words, symbols: 10 * symbols > words),
    Rule("repeated lines", ("n_lines", "n_dup_lines"), lambda lines, again: 100 * again > 40 * lines),
    Rule("capitals", ("word_chars", "n_capitals"), lambda chars, capitals: 100 * capitals > 40 * chars),
    Rule("digits", ("word_chars", "n_digits"), lambda chars, digits: 100 * digits > 50 * chars),
    Rule("no sentences", ("n_words", "n_ends"), lambda words, ends: 200 * ends < words),
    Rule("all sentences", ("n_words", "n_ends"), lambda words, ends: 100 * ends > 60 * words),
)


def wanted(names: Iterable[str]) -> set[str]:
    """Measures and the parts under them."""
    names = set(names)
    return names | {part for name in names for part in NEEDS[name]}


def estimate(docs: DataFrame, rules: tuple[Rule, ...], id_free_text: str, sampled: int = SAMPLED) -> tuple[dict[str, float], dict[frozenset, int]]:
    """Seconds a measure or part, and how many sampled documents each set of rules rejects."""
    rows = docs.count()
    part = docs.select(F.col(id_free_text).alias("text"))
    part = part.sample(sampled / rows, 1) if rows > sampled else part

    def run(batches):
        hasher = CasedHasher()
        for batch in batches:
            for piece in slices(batch):
                texts = Texts(piece.column("text"), hasher)
                rejected = [np.asarray(rule.rejects(*(texts[m] for m in rule.reads)), bool) for rule in rules]
                masks, counts = np.unique(sum((r.astype(np.int64) << i for i, r in enumerate(rejected)), np.zeros(piece.num_rows, np.int64)), return_counts=True)
                yield pa.RecordBatch.from_pydict({"mask": masks, "n": counts, "seconds": [json.dumps(texts.seconds)] + [None] * (len(masks) - 1)})

    measured = part.mapInArrow(run, "mask bigint, n bigint, seconds string")
    table = measured.select("mask", "n", F.from_json("seconds", "map<string,double>").alias("seconds"))
    by_mask = table.groupBy("mask").agg(F.sum("n").alias("n"))
    by_name = table.select(F.explode("seconds").alias("name", "s")).groupBy("name").agg(F.sum("s").alias("s"))
    found = by_mask.select("mask", "n", F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("s"))
    found = found.unionByName(by_name.select(F.lit(None).cast("bigint").alias("mask"), F.lit(None).cast("bigint").alias("n"), "name", "s")).collect()
    names = [rule.name for rule in rules]
    rejected = {frozenset(x for i, x in enumerate(names) if r.mask >> i & 1): r.n for r in found if r.name is None}
    return {r.name: r.s for r in found if r.name is not None}, rejected


def ordered(rules: tuple[Rule, ...], seconds: dict[str, float], rejected: dict[frozenset, int], known: Iterable[str] = ()) -> list[Rule]:
    """Rules by rejections per second, each judged on what those before it leave; ``known``: measures that are taken anyway."""
    have, left, order = wanted(known), dict(rejected), []
    rest = list(rules)
    while rest:
        alive = sum(left.values())

        def worth(rule: Rule) -> float:
            cost = sum(seconds.get(name, 0.0) for name in wanted(rule.reads) - have)
            hits = sum(n for names, n in left.items() if rule.name in names)
            return (hits / max(alive, 1)) / max(cost, 1e-9)

        best = max(rest, key=worth)  # the first of equals
        rest.remove(best)
        order.append(best)
        have |= wanted(best.reads)
        left = {names: n for names, n in left.items() if best.name not in names}
    return order


def cascade(texts: Texts, order: list[Rule]) -> np.ndarray:
    """Whether each text is kept; a rule sees only texts that every rule before it let through."""
    kept = np.zeros(len(texts.column), bool)
    rows = np.arange(len(kept))
    for rule in order:
        through = ~np.asarray(rule.rejects(*(texts[m] for m in rule.reads)), bool)
        if not through.all():
            rows = rows[through]
            if not len(rows):
                return kept
            texts = texts.take(np.flatnonzero(through))
    kept[rows] = True
    return kept


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, measures: tuple[str, ...] = (), sampled: int = SAMPLED) -> DataFrame:
    """(id, measures..., kept) of each row; ``measures`` are taken for every text, rejected or not."""
    base = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    order = ordered(rules, *estimate(base, rules, "text", sampled), known=measures)

    def run(batches):
        hasher = CasedHasher()
        for batch in batches:
            for piece in slices(batch):
                texts = Texts(piece.column("text"), hasher)
                columns = [pa.array(texts[m], pa.int64()) for m in measures]
                yield pa.RecordBatch.from_arrays([piece.column("id"), *columns, pa.array(cascade(texts, order))], names=["id", *measures, "kept"])

    schema = base.select("id").schema
    for m in measures:
        schema = schema.add(m, "long")
    return base.mapInArrow(run, schema.add("kept", "boolean")).withColumnRenamed("id", id_col)


def keep(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sampled: int = SAMPLED) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    order = ordered(rules, *estimate(docs, rules, text_col, sampled))

    def run(batches):
        hasher = CasedHasher()
        for batch in batches:
            for piece in slices(batch, text_col):
                yield piece.filter(pa.array(cascade(Texts(piece.column(text_col), hasher), order)))

    return docs.mapInArrow(run, docs.schema)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract: the base measures of every text, the base rules' verdict and that of all rules."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), measures=BASE)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", *BASE, failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"))


#: Every measure by patterns and lists, every rule on every document.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
v AS (SELECT rid, i, struct_pack(a := word, b := lead(word, 1) OVER o, c := lead(word, 2) OVER o, d := lead(word, 3) OVER o, e := lead(word, 4) OVER o) AS win, lead(word, 4) OVER o IS NOT NULL AS full_win FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM v WHERE full_win QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
rw AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, 5) t(k) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT d.rid, d.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(ls) AS n_lines, length(regexp_replace(text, '[^.!?]', '', 'g')) AS n_ends, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
  FROM d JOIN w ON d.rid = w.rid JOIN l ON d.rid = l.rid LEFT JOIN rw ON d.rid = rw.rid),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 40 * n_lines OR 100 * n_capitals > 40 * word_chars
    OR 100 * n_digits > 50 * word_chars OR 200 * n_ends < n_words OR 100 * n_ends > 60 * n_words) AS kept
FROM b
"""
