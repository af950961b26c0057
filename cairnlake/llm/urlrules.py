"""URL filters: host and path rules, and pattern rules that are indexed by their rarest literal token.

A pattern rule is a regular expression over the whole url (letter case ignored). The tokens ([a-z0-9]+)
that every match must contain are its literals, and the rule is filed under the one that the fewest
urls hold. A url's own tokens fetch its candidate rules, and only those run their expressions. A rule
is only filed under a token that stands free (bounded by other characters) in each of its matches;
a rule that has no such token is tried on every url. ``read_rules`` takes rules from host lists and filter lists.

Defined results: a null url, or one without ``://``, has empty host and path, fits no host rule and is allowed
unless a pattern rule fits (these do not apply to null); of several pattern rules that fit, blocking ones win over
others, then the first; repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The contract's rules, (verdict, host, path).
HOST_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Pattern rules, (verdict, pattern). Block wins over allow among pattern rules.
PATTERN_RULES = (
    ("block", r"://([^/?#]*\.)?cheap-pills\."),
    ("block", r"://([^/?#]*\.)?casino-win\."),
    ("block", r"://([^/?#]*\.)?free-bets\."),
    ("block", r"://([^/?#]*\.)?spam-farm\."),
    ("block", r"://([^/?#]*\.)?ads-track\."),
    ("block", r"[/.-]casino[/.-]"),
    ("block", r"[/.-](porn|xxx|escort)[/.-]"),
    ("block", r"[?&]affid=[0-9]+"),
)


def literals(pattern: str) -> list[str]:
    """Tokens that stand free in every match: runs of letters and digits outside of groups, classes and escapes,
    with a fixed non-token character (or a class without letters and digits) on both sides."""
    parts: list[tuple[str, str]] = []  # kind: c literal, b boundary (never a letter or digit), x anything
    depth = i = 0
    if "|" in re.sub(r"\\.|\[[^\]]*\]|\([^()]*\)", "", pattern):
        return []
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1 : i + 2]
            kind = ("x", "") if nxt.isalnum() else ("b", nxt)
            i += 2
        elif ch == "[":
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            kind = ("x", "") if body.startswith("^") or re.search(r"[A-Za-z0-9\\]", body) else ("b", body)
            i = end + 1
        elif ch in "()":
            depth += 1 if ch == "(" else -1
            kind = ("x", "")
            i += 1
        elif ch in ".^$":
            kind = ("x", "")
            i += 1
        else:
            kind = ("c", ch.lower()) if ch.isalnum() else ("b", ch)
            i += 1
        optional = i < len(pattern) and pattern[i] in "?*+{"
        if optional:
            many = pattern[i] == "+"
            i = pattern.index("}", i) + 1 if pattern[i] == "{" else i + 1
            kind = ("b", kind[1]) if many and kind[0] == "b" else ("x", "")
        parts.append(kind if depth == 0 else ("x", ""))
    found, run, free = [], "", False
    for kind, ch in [*parts, ("x", "")]:
        if kind == "c":
            run += ch
            continue
        if run and free and kind == "b":
            found.append(run)
        run, free = "", kind == "b"
    return found


def filter_pattern(rule: str) -> tuple[str, list[str]]:
    """The regular expression of a filter-list rule and its free tokens.

    ``||`` stands for a host or one above it, ``|`` at an end for that end of the url, ``^`` for a separator or the end, ``*`` for anything."""
    host, begin, end = rule.startswith("||"), rule.startswith("|"), rule.endswith("|")
    body = rule.lstrip("|")[: -1 if end else None]
    parts = {"*": ".*", "^": r"(?:[^a-zA-Z0-9_.%-]|$)"}
    pattern = "".join(parts.get(ch) or re.escape(ch) for ch in body)
    pattern = (r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*\.)?" if host else "^" if begin else "") + pattern + ("$" if end else "")
    tokens = []
    for m in re.finditer("[a-z0-9]+", body.lower()):
        left = begin if m.start() == 0 else body[m.start() - 1] != "*"
        right = end if m.end() == len(body) else body[m.end()] != "*"
        if left and right:
            tokens.append(m.group())
    return pattern, tokens


def read_rules(lines: Iterable[str], verdict: str = "block") -> list[tuple[str, str, list[str]]]:
    """(verdict, pattern, tokens) of the rules of a host list or a filter list, for ``filter_urls``.

    Lines: ``host`` or ``0.0.0.0 host`` (the host and all below it), ``/expression/``, or a filter; ``@@`` before a rule
    allows what it fits. Comments (``!``, ``#``), list headers, rules on parts of a page (``##``) and rules with options
    (``$``), which ask for more than a url, are left out."""
    rules = []
    for line in (x.strip() for x in lines):
        if not line or line[0] in "!#[" or "##" in line or "#@#" in line:
            continue
        allow = line.startswith("@@")
        body = line[2:] if allow else re.sub(r"^(?:0\.0\.0\.0|127\.0\.0\.1|::1?)\s+(\S+).*$", r"\1", line)
        if len(body) > 2 and body[0] == "/" and body[-1] == "/":
            pattern, tokens = body[1:-1], literals(body[1:-1])
        elif "$" in body:
            continue
        elif re.fullmatch(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", body):
            pattern, tokens = filter_pattern(f"||{body}^")
        else:
            pattern, tokens = filter_pattern(body)
        if pattern:
            rules.append(("allow" if allow else verdict, pattern, tokens))
    return rules


def split_url(df: DataFrame, url_col: str) -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring({url_col}, instr({url_col}, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumns({"host": lower, "path": path})


def token_frequencies(df: DataFrame, url_col: str, tokens: Sequence[str]) -> dict[str, int]:
    """In how many urls each of the rules' tokens stands; as many rows as the rules have tokens come back."""
    if not tokens:
        return {}
    words = df.select(F.explode(F.array_distinct(F.split(F.lower(url_col), "[^a-z0-9]+"))).alias("token"))
    rows = words.where(F.col("token").isin(*tokens)).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def judge(rules: Sequence[tuple], index: dict[str, list[int]], always: Sequence[int]):
    def run(batches):
        compiled: dict[int, re.Pattern] = {}  # only rules that are fetched are ever compiled

        def fits(i: int, url: str) -> bool:
            if i not in compiled:
                compiled[i] = re.compile(rules[i][1], re.IGNORECASE | re.ASCII)
            return bool(compiled[i].search(url))

        token = re.compile(r"[a-z0-9]+")
        for batch in batches:
            out = []
            for url in batch.column(0).to_pylist():
                hit = None
                if url is not None:
                    wanted = set(always)
                    for t in set(token.findall(url.lower())):
                        wanted.update(index.get(t, ()))
                    wanted = sorted(wanted, key=lambda i: (rules[i][0] != "block", i))
                    hit = next((i for i in wanted if fits(i, url)), None)
                out.append(hit)
            blocked = [i is not None and rules[i][0] == "block" for i in out]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.int32()), pa.array(blocked, pa.bool_())], names=[*batch.schema.names[1:], "pattern_rule", "blocked"])

    return run


def filter_urls(pages: DataFrame, host_rules: Sequence = HOST_RULES, pattern_rules: Sequence = PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (host rule that fits, longest first, else null), verdict, pattern (index of the pattern rule that decided, else null).

    pattern_rules: (verdict, pattern) or (verdict, pattern, tokens) as from ``read_rules``. The rules are the caller's
    configuration; they are sent to the executors with the code.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    keys = {i: rule[2] if len(rule) > 2 else literals(rule[1]) for i, rule in enumerate(pattern_rules)}
    counts = token_frequencies(base, "url", sorted({t for ts in keys.values() for t in ts}))
    index: dict[str, list[int]] = {}
    for i, ts in keys.items():
        if ts:
            index.setdefault(min(ts, key=lambda t: (counts.get(t, 0), t)), []).append(i)
    always = [i for i, ts in keys.items() if not ts]
    split = split_url(base, "url").select("url", "page_id", "host", "path")
    judged = split.mapInArrow(judge(list(pattern_rules), index, always), "page_id long, host string, path string, pattern_rule int, blocked boolean")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(host_rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    other = F.when(F.col("blocked"), "block").otherwise("allow")
    pattern = F.when(rule.isNull(), F.col("pattern_rule"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, other).alias("verdict"), pattern.alias("pattern_rule"))


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    """Contract: the four host rules; other urls are judged by the pattern rules."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle() -> str:
    cases = sorted(HOST_RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in cases]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, cases))
    verdict = " ".join(f"WHEN {f} THEN '{w}'" for f, (w, _, _) in zip(fits, cases))
    order = [i for i, (w, _) in enumerate(PATTERN_RULES) if w == "block"] + [i for i, (w, _) in enumerate(PATTERN_RULES) if w != "block"]
    pattern = " ".join(f"WHEN regexp_matches(url, '(?i){PATTERN_RULES[i][1]}') THEN {i}" for i in order)
    blocks = ", ".join(str(i) for i, (w, _) in enumerate(PATTERN_RULES) if w == "block")
    return f"""
WITH rests AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
), judged AS (
  SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} END AS own, CAST(CASE {pattern} END AS INTEGER) AS hit FROM cut
)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN hit IN ({blocks}) THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN rule IS NULL THEN hit END AS pattern_rule FROM judged
"""
