"""DuckDB SQL for text functions, for the oracles."""

from __future__ import annotations

from ..functions import text


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def is_correction(column: str) -> str:
    """RE2 knows word borders of ASCII only; these are those of all letters, as the operator and Python's ``re`` take them."""
    word, space = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}", r"[\s\x0b\x{85}\p{Z}]"
    whole = rf"(?:actually|correction|wrong|mistake|that'?s{space}+(?:not|wrong|incorrect)|don'?t|not{space}+that|oops|sorry,?{space}+(?:i{space}+)?meant)(?:$|[^{word}])"
    pattern = rf"(?i)(?:^|[^{word}])(?:no,?{space}+[{word}]|{whole})"
    return f"coalesce(regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}'), false)"


def stem(w: str) -> str:
    cut = lambda n: f"left({w}, length({w}) - {n})"
    single = lambda s: f"CASE WHEN length({s}) >= 2 AND right({s}, 1) = left(right({s}, 2), 1) THEN left({s}, length({s}) - 1) ELSE {s} END"
    ing, ed = cut(3), cut(2)
    rules = {
        ("tion", 6): f"CASE WHEN left(right({w}, 5), 1) = 'a' THEN {cut(4)} || 'te' ELSE {cut(3)} END",
        ("sion", 6): f"CASE WHEN left(right({w}, 5), 1) = 'u' THEN {cut(4)} || 'de' ELSE {cut(3)} END",
        ("ness", 6): cut(4), ("ment", 6): cut(4), ("ly", 5): cut(2),
        ("ing", 5): f"CASE WHEN length({ing}) >= 2 AND right({ing}, 1) = left(right({ing}, 2), 1) THEN {cut(4)} WHEN regexp_matches({ing}, '[aeiou][^aeiou]$') THEN {ing} || 'e' ELSE {ing} END",
        ("ed", 5): f"CASE WHEN length({ed}) >= 2 AND right({ed}, 1) = left(right({ed}, 2), 1) THEN {cut(3)} WHEN {w} LIKE '%ied' THEN {cut(3)} || 'y' ELSE {ed} END",
        ("er", 5): single(cut(2)), ("est", 6): single(cut(3)), ("ies", 5): f"{cut(3)} || 'y'",
        ("es", 4): f"CASE WHEN regexp_matches({w}, '(sh|ch|x|z|s)es$') THEN {cut(2)} ELSE {cut(1)} END",
    }
    cases = " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) >= {n} THEN {body}" for (s, n), body in rules.items())
    forms = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.IRREGULAR.items()) + "}"
    return f"coalesce({forms}[{w}], CASE WHEN length({w}) <= 3 THEN {w} {cases} WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN {cut(1)} ELSE {w} END)"


def english_words(column: str) -> str:
    """Distinct lower-case words of letters without stop words."""
    return f"list_filter(list_distinct(regexp_extract_all(lower({column}), '[a-z]+')), lambda w: NOT list_contains({_list(sorted(text.TOKEN_STOPWORDS))}, w))"


def word_set(column: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({column}), '\\s+'), lambda w: w <> ''))"


def flat_list(values) -> str:
    return _list(values)


def sentence_cut(part: str, column: str, cut: str, most: int = 500) -> str:
    """WITH parts: the rows of ``part`` with ``column`` cut as ``cut``, after the last separator past the middle of its first ``most`` characters."""
    seps = [("'. '", 2), ("'。'", 1), ("chr(10)", 1), ("'; '", 2), ("', '", 2)]
    ends = ", ".join(f"CASE WHEN strpos(reverse(head), reverse({s})) > 0 THEN length(head) - strpos(reverse(head), reverse({s})) - {n - 1} END AS at{i}" for i, (s, n) in enumerate(seps))
    cases = " ".join(f"WHEN at{i} > {most / 2} THEN rtrim(left(head, at{i} + {n}), ' ' || chr(9) || chr(10) || chr(13))" for i, (_, n) in enumerate(seps))
    return f"""{part}_h AS (SELECT *, left({column}, {most}) AS head FROM {part}), {part}_e AS (SELECT *, {ends} FROM {part}_h),
{part}_cut AS (SELECT *, CASE WHEN length({column}) <= {most} THEN {column} {cases} ELSE rtrim(head, ' ' || chr(9) || chr(10) || chr(13)) || '...' END AS {cut} FROM {part}_e)"""


def entities(column: str) -> str:
    """Sorted quoted, CamelCase and dotted names, the first ten, joined by |."""
    grabs = [f"regexp_extract_all({column}, '{p}', 1)" for p in ("`([^`]+)`", '"([^"]{2,30})"', r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b")]
    dotted = f"list_filter(regexp_extract_all({column}, '([0-9A-Za-z_-]+\\.[0-9A-Za-z_.]*[0-9A-Za-z_])', 1), lambda m: NOT regexp_matches(m, '^[0-9-]'))"
    return f"array_to_string(list_slice(list_sort(list_distinct(list_concat(list_concat({grabs[0]}, {grabs[1]}), list_concat({grabs[2]}, {dotted})))), 1, 10), '|')"


def tools(column: str) -> str:
    """Sorted known tools among the words, joined by commas."""
    return f"array_to_string(list_sort(list_filter({_list(text.KNOWN_TOOLS)}, lambda t: list_contains(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]+'), t))), ',')"
