"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: its share, by weight, of all words, but ``most`` times its own
words at most; what stops there is shared again by weight. Within a source a document's expected
copies grow with the bit length of its size (longer documents are likelier), scaled so that
expected words equal the target and no document expects more than ``most`` copies. The whole part of
the expectation is certain. For the rest, documents are ranked by their random odds divided by their
inclusion odds (Pareto order sampling), and a prefix of the ranking is taken whose words come nearest
to what remains of the target: a sample of fixed size, in words, with unequal probabilities.

The ranking is cut in two steps, so that no source is sorted in one task: words are summed in CELLS
cells of the ranking variable, and only the cell in which a source's target is reached is ordered.

Random numbers come from a hash of seed and id: reruns agree. Defined results: null text has size 0
and takes 0 words; the null source is a source of its own and comes last; ties of the ranking variable go
by id, then size; a table without words takes nothing; repeated rows are separate documents (with the
same random number). An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bits of a size; 0 for an empty text.
BITS = "CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) END"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
CELLS = 4096


def mix_steps(docs: str, size: str, bits: str, uniform: str, most: int = 3) -> list[tuple[str, str]]:
    """The operator as named SQL steps that Spark and DuckDB share; the arguments are the parts that they spell differently."""
    cycle = f"CASE {' '.join(f'WHEN (nth - 1) % {len(WEIGHTS)} = {k} THEN {w}' for k, w in enumerate(WEIGHTS))} END"
    return [
        (
            "sized",
            f"""SELECT doc_id, source, coalesce(source, '') AS skey, source IS NULL AS snull, CAST({size} AS BIGINT) AS size FROM {docs}""",
        ),
        (
            "graded",
            f"""SELECT *, {bits} AS bits, {uniform} AS u FROM sized""",
        ),
        (
            "classes",
            f"""SELECT skey, snull, bits, CAST(sum(size) AS BIGINT) AS words FROM graded GROUP BY skey, snull, bits""",
        ),
        (
            "sources",
            f"""SELECT skey, snull, CAST(sum(words) AS BIGINT) AS source_size FROM classes GROUP BY skey, snull""",
        ),
        (
            "numbered",
            f"""SELECT *, row_number() OVER (ORDER BY snull, skey) AS nth FROM sources""",
        ),
        (
            "weighed",
            f"""SELECT *, {cycle} AS weight FROM numbered""",
        ),
        (
            "filling",
            f"""SELECT *,
    CAST(sum(source_size) OVER () AS BIGINT) AS whole,
    coalesce(CAST(sum({most} * source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS stopped,
    CAST(sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open_weight
  FROM weighed""",
        ),
        (
            "leveled",
            f"""SELECT *, CAST(whole - stopped AS DOUBLE) / open_weight AS level FROM filling""",
        ),
        (
            "level",
            f"""SELECT max(CASE WHEN level * weight <= {most} * source_size THEN level END) AS level FROM leveled""",
        ),
        (
            "targets",
            f"""SELECT skey, snull, source_size, least(CAST({most} * source_size AS DOUBLE), (SELECT level FROM level) * weight) AS target FROM leveled""",
        ),
        (
            "ratios",
            f"""SELECT c.skey, c.snull, c.bits, c.words, t.target,
    coalesce(CAST(sum(c.words) OVER (PARTITION BY c.skey, c.snull ORDER BY c.bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS above,
    CAST(sum(c.words * (8 + c.bits)) OVER (PARTITION BY c.skey, c.snull ORDER BY c.bits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS pull
  FROM classes c JOIN targets t ON c.skey = t.skey AND c.snull = t.snull WHERE c.words > 0""",
        ),
        (
            "scaled",
            f"""SELECT skey, snull, max(CASE WHEN (target - {most} * above) / pull * (8 + bits) <= {most} THEN (target - {most} * above) / pull END) AS scale FROM ratios GROUP BY skey, snull""",
        ),
        (
            "copied",
            f"""SELECT c.skey, c.snull, c.bits, least(CAST({most} AS DOUBLE), coalesce(s.scale * (8 + c.bits), CAST({most} AS DOUBLE))) AS copies, c.words
  FROM classes c JOIN scaled s ON c.skey = s.skey AND c.snull = s.snull WHERE c.words > 0""",
        ),
        (
            "rates",
            f"""SELECT skey, snull, bits, CAST(floor(copies + 1e-9) AS BIGINT) AS certain, greatest(copies - floor(copies + 1e-9), 0) AS chance, words FROM copied""",
        ),
        (
            "rests",
            f"""SELECT r.skey, r.snull, max(t.target) - CAST(sum(r.certain * r.words) AS BIGINT) AS rest
  FROM rates r JOIN targets t ON r.skey = t.skey AND r.snull = t.snull GROUP BY r.skey, r.snull""",
        ),
        (
            "plans",
            f"""SELECT r.skey, r.snull, r.bits, r.certain, r.chance, q.rest FROM rates r JOIN rests q ON r.skey = q.skey AND r.snull = q.snull""",
        ),
        (
            "ranked",
            f"""SELECT g.doc_id, g.skey, g.snull, g.size, g.u, p.certain, p.chance, p.rest,
    CASE WHEN p.chance > 1e-9 THEN (g.u * (1 - p.chance)) / (g.u * (1 - p.chance) + (1 - g.u) * p.chance) END AS rank_at
  FROM graded g JOIN plans p ON g.skey = p.skey AND g.snull = p.snull AND g.bits = p.bits""",
        ),
        (
            "celled",
            f"""SELECT *, CAST(floor(rank_at * {CELLS}) AS BIGINT) AS cell FROM ranked WHERE rank_at IS NOT NULL""",
        ),
        (
            "cells",
            f"""SELECT skey, snull, cell, CAST(sum(size) AS BIGINT) AS words, max(rest) AS rest FROM celled GROUP BY skey, snull, cell""",
        ),
        (
            "reached",
            f"""SELECT *, CAST(sum(words) OVER (PARTITION BY skey, snull ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - words AS before FROM cells""",
        ),
        (
            "marks",
            f"""SELECT skey, snull, cell AS edge, before FROM reached WHERE before < rest AND before + words >= rest""",
        ),
        (
            "edges",
            f"""SELECT c.doc_id, c.size, c.rest, m.before + CAST(sum(c.size) OVER (PARTITION BY c.skey, c.snull ORDER BY c.rank_at, c.doc_id, c.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - c.size AS before, c.skey, c.snull, c.certain
  FROM celled c JOIN marks m ON c.skey = m.skey AND c.snull = m.snull AND c.cell = m.edge""",
        ),
        (
            "picks",
            f"""SELECT doc_id, skey, snull, size, certain,
    CASE WHEN before < rest AND (before + size <= rest OR before + size - rest <= rest - before) THEN 1 ELSE 0 END AS extra
  FROM edges
  UNION ALL
  SELECT c.doc_id, c.skey, c.snull, c.size, c.certain, CASE WHEN CASE WHEN m.edge IS NULL THEN c.rest > 0 ELSE c.cell < m.edge END THEN 1 ELSE 0 END AS extra
  FROM celled c LEFT JOIN marks m ON c.skey = m.skey AND c.snull = m.snull WHERE m.edge IS NULL OR c.cell <> m.edge
  UNION ALL
  SELECT doc_id, skey, snull, size, certain, 0 AS extra FROM ranked WHERE rank_at IS NULL
  UNION ALL
  SELECT g.doc_id, g.skey, g.snull, g.size, CAST(0 AS BIGINT) AS certain, 0 AS extra FROM graded g WHERE g.size = 0""",
        ),
        (
            "mixed",
            f"""SELECT p.doc_id, p.size, t.source_size, t.target, CAST(p.size * least(p.certain + p.extra, {most}) AS BIGINT) AS taken
FROM picks p JOIN targets t ON p.skey = t.skey AND p.snull = t.snull""",
        ),
    ]


def mix_sql(*args) -> str:
    """All steps as one statement."""
    steps = mix_steps(*args)
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in steps[:-1]) + " " + steps[-1][1]


#: Tables that Spark writes between steps, so that no plan repeats the steps before: small ones by source and bit length or by
#: source, and the ranked documents (without their texts), which three later steps read.
WRITTEN = ("classes", "targets", "plans", "ranked", "marks")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, seed: int = 7, uniform: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target (of its source), taken (words the mix takes of it) of each row.

    ``uniform``: SQL for the random number of a row over its ``doc_id``; the hash of seed and id if none is given."""
    base = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), docs[text_col].alias("text"))
    sized = base.selectExpr("doc_id", "source", r"coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0) AS n")
    made = {"mix_input": materialize(sized, "sizes")}
    for name, sql in mix_steps("mix_input", "n", BITS, uniform or spark_uniform(seed), most):
        # tables of earlier steps are handed over as DataFrames: no view of the session is made or hidden
        used = {t for t in re.findall(r"\b(?:FROM|JOIN) (\w+)", sql) if t in made}
        braced = re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql)
        df = docs.sparkSession.sql(braced, **{t: made[t] for t in used})
        made[name] = materialize(df, name) if name in WRITTEN else df
    return made["mixed"]


def spark_uniform(seed: int, of: str = "doc_id") -> str:
    """In (0, 1), from 52 bits of a hash of seed and id."""
    return f"(CAST(conv(substring(md5(concat('{seed}:', coalesce(CAST({of} AS STRING), ''))), 1, 13), 16, 10) AS BIGINT) + 0.5D) / 4503599627370496D"


def duckdb_uniform(seed: int) -> str:
    return f"(CAST('0x' || substring(md5(concat('{seed}:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE"


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as the mix takes it, with ``copies``, ``taken`` and ``copy`` (from 1).

    Columns of docs with these names give way. If ids repeat, rows are numbered in a table of their own first, and the mix is taken
    of numbered rows: rows that share an id have one random number, and ties of the ranking go by a hash of the text, then by number."""
    id_col, text_col, seed = options.pop("id_col", "doc_id"), options.get("text_col", "text"), options.get("seed", 7)
    docs = docs.drop("copies", "taken", "copy")
    key = F.col(id_col)
    if not docs.groupBy(key).count().where("count > 1").isEmpty():
        docs = materialize(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "numbered")
        key = F.struct(key.alias("id"), F.xxhash64(text_col).alias("text"), "_mix_row")
        options["uniform"] = spark_uniform(seed, "doc_id.id")
    keyed = docs.withColumn("_mix_key", key)
    found = mix(keyed, id_col="_mix_key", **options).where("taken > 0").selectExpr("doc_id AS _mix_id", "taken", "CAST(taken / size AS INT) AS copies")
    joined = keyed.join(materialize(found, "mix"), F.col("_mix_key").eqNullSafe(F.col("_mix_id")))
    return joined.drop("_mix_id", "_mix_key", "_mix_row").selectExpr("*", "explode(sequence(1, copies)) AS copy")


def op4_source_mix(spark, sf_dir: str) -> DataFrame:
    """Contract: weights 5, 2, 1 over the sources, targets at most 3 times a source's size."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = mix_sql(
    "(SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n FROM documents)",
    "n",
    BITS,
    duckdb_uniform(7),
)
