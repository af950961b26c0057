"""Source verification: anchors against files, with reuse of recent results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import VERIFICATION
from ..functions import score


def check(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """(id, verified_status): the first anchor (by pos) that fails decides; a file that is missing or outside of the
    root cannot be verified, a text that is not in its file or does not fit its hash is stale.

    anchors: id, pos, file_path, anchor_text, anchor_hash. files: file_path, content. Anchors of records without
    any are not in ``anchors``; ``with_trust`` calls those not_applicable."""
    rows = anchors.join(files, "file_path", "left")
    outside = F.col("file_path").rlike(r"^/|^[A-Za-z]:|(^|[\\/])\.\.([\\/]|$)")
    stale = (F.instr("content", F.col("anchor_text")) == 0) | (F.sha2("anchor_text", 256) != F.col("anchor_hash"))
    one = F.when(outside | F.col("content").isNull(), "unverifiable").when(stale, "stale").otherwise("verified")
    bad = F.min(F.when(one != "verified", F.struct("pos", one.alias("s"))))
    return rows.groupBy("id").agg(F.coalesce(bad["s"], F.lit("verified")).alias("verified_status"))


def within_ttl(verified_at: Column, status: Column, now: Column, ttl: float = VERIFICATION.ttl_seconds) -> Column:
    if ttl <= 0:
        return F.lit(False)
    return verified_at.isNotNull() & status.isNotNull() & ((F.unix_micros(now) - F.unix_micros(verified_at)) / F.lit(1e6) < ttl)


def with_trust(df: DataFrame, checked: DataFrame, now: Column, ttl: float = VERIFICATION.ttl_seconds) -> DataFrame:
    """df (id, verified_at, verified_status) with fresh states where they have run out, and trust scores."""
    fresh = checked.withColumnRenamed("verified_status", "_fresh")
    keep = within_ttl(F.col("verified_at"), F.col("verified_status"), now, ttl)
    status = F.when(keep, F.col("verified_status")).otherwise(F.coalesce("_fresh", F.lit("not_applicable")))
    out = df.join(fresh, "id", "left").withColumn("_s", status).withColumn("verified_at", F.when(keep, F.col("verified_at")).otherwise(now))
    out = out.withColumn("verified_status", F.col("_s")).drop("_s", "_fresh")
    return out.withColumn("trust_score", F.when(F.col("verified_status") != "not_applicable", score.trust_score(F.col("verified_status"))))


# Extensions of source files, and heads of definitions.
EXTENSIONS = ("go", "java", "js", "json", "jsx", "md", "py", "rb", "rs", "toml", "ts", "tsx", "yaml", "yml")
PATH = r"(?U)((?:[A-Za-z]:[\\/])?(?:[\w.\-]+[\\/])+[\w.\-]+\.(?:" + "|".join(EXTENSIONS) + "))"
HEADS = ("fn", "def", "function", "class")
MOST, LEAST = 200, 20


def paths(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PATH), 1))


def code_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)```[^\n]*\n(.*?)```"), 1)


def symbols(text: Column) -> Column:
    """Definition heads (``def name``) and identifiers in backticks, each once."""
    headed = lambda h: F.transform(F.regexp_extract_all(text, F.lit(rf"\b{h}\s+([A-Za-z_][A-Za-z0-9_]*)"), 1), lambda n: F.concat(F.lit(h + " "), n))
    found = [headed(h) for h in HEADS]
    found.append(F.regexp_extract_all(text, F.lit("`([A-Za-z_][A-Za-z0-9_]{2,})`"), 1))
    return F.array_distinct(F.concat(*found))


def window(text: Column) -> Column:
    """At most 200 characters, cut at the last line end past the twentieth."""
    head = F.substring(text, 1, MOST)
    at = F.length(head) - F.instr(F.reverse(head), "\n")
    cut = F.when((F.instr(F.reverse(head), "\n") > 0) & (at > LEAST), F.substr(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= MOST, text).otherwise(cut)


def symbol_window(file_text: Column, symbol: Column) -> Column:
    """The line of a symbol's first place, one line before and four after; null if it is not there."""
    lines = F.split(file_text, r"\r\n|\r|\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, symbol)), True)
    first = F.greatest(at - 1, F.lit(1))
    return F.when((at > 0) & (symbol != ""), window(F.array_join(F.slice(lines, first.cast("int"), (at + 5 - first).cast("int")), "\n")))


def extract_anchors(df: DataFrame, files: DataFrame, id_col: str, text: str = "content") -> DataFrame:
    """(id, file_path, anchor_text, anchor_hash): for each file that the text names, its first code block that the
    file holds and the surroundings of each symbol of the text; windows of 20 characters or more, each once."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("t"), F.explode(paths(F.col(text))).alias("file_path")).join(files.withColumnRenamed("content", "_file"), "file_path")
    blocks = F.transform(code_blocks(F.col("t")), lambda b: window(F.regexp_replace(b, r"(?U)^\s+|\s+$", "")))
    held = F.slice(F.filter(blocks, lambda b: (b != "") & F.contains(F.col("_file"), b)), 1, 1)
    around = F.transform(symbols(F.col("t")), lambda s: symbol_window(F.col("_file"), s))
    out = rows.select("id", "file_path", F.explode(F.concat(held, F.array_compact(around))).alias("a")).select("id", "file_path", F.substring("a", 1, MOST).alias("anchor_text"))
    return out.where(F.length("anchor_text") >= LEAST).distinct().withColumn("anchor_hash", F.sha2("anchor_text", 256))
