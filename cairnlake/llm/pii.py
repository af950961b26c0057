"""Personal data: base patterns, and more spans by weak supervision.

Base spans are what four fixed patterns find; they are always reported. Candidates for more spans come from
looser patterns (spelled-out addresses, national phone and identity numbers, bank accounts, credentials).
Labelers vote on every candidate and base span for, against, or not at all: regular expressions for strict
form, gazetteers (key words in several languages, known prefixes), checks of digits and variety, and the
context around the span. Expectation-maximisation over the vote patterns of the whole corpus estimates
each labeler's reliability and the share of true spans; a logistic span classifier is fitted to the resulting
probabilities, and candidates that it accepts are added where they overlap no base span.

Only counts of vote patterns leave the executors: at most kinds * 3 ** labelers * buckets of them, whatever the size
of the corpus. Defined results: null counts as the empty text (no spans); rows are judged each, so repeated rows get
equal results; without candidates nothing is added; an empty table gives an empty result. Extra columns are kept by
``redact`` and not read by ``find``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BASE = ("email", "ip", "card", "phone")
#: Kinds of spans in the order in which spans with the same start are listed.
KINDS = (*BASE, "national_id", "account", "secret")

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Looser patterns for candidates.
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({]\s?(?:at|AT|@)\s?[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({]\s?(?:dot|DOT|\.)\s?[\])}]) ?[A-Za-z0-9-]{2,63}){1,4}")
_NATIONAL = re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-]|\.[0-9])")
_IDENTITY = re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]|\.[0-9])")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ASSIGNED = re.compile(r"(?<![A-Za-z])(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"'<>]{6,200})", re.I)
_PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{12,20}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:gh[pousr]_|sk_live_|xox[abp]-)[A-Za-z0-9-]{16,80}")
_QUICK = {"secret": re.compile(r"AKIA|ASIA|gh[pousr]_|sk_live_|xox[abp]-|[=:]\s{0,3}[\"']?[^\s\"'<>]{6}"), "email": re.compile(r"[\[({]\s?(?:at|AT|@)\s?[\])}]")}

#: Key words that stand before personal data. A gazetteer, fixed values.
WORDS = frozenset(
    "account adresse auth call card carte cell contact correo cuenta customer dial email e-mail fax gsm iban id identity karte key konto kontakt mail mobil mobile móvil nummer number numéro password passwd phone pwd rufnummer secret social ssn tarjeta teléfono telefon téléphone tel token user".split()
)
#: Strict forms by kind.
STRICT = {
    "email": re.compile(r"[a-z0-9][\w.+-]*@(?:[a-z0-9-]+\.)+[a-z]{2,10}$|.*[\[({] ?at ?[\])}].*[\[({] ?dot ?[\])}]", re.I),
    "ip": re.compile(r"(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"),
    "card": re.compile(r"[3-6][0-9]{3}(?:[ -]?[0-9]{4}){3}$|3[47][0-9]{13}$"),
    "phone": re.compile(r"(?:\+[1-9][0-9]{0,2}[ -])?\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-][0-9]{4}$|\+[1-9]"),
    "national_id": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"),
    "account": re.compile(r"[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?$|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"),
    "secret": re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}$|[0-9a-f]{16,}$|(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=-]{16,}$"),
}
LABELERS = ("strict", "key_word", "prefix", "digits", "variety", "table")
ACCEPT = 0.9


def emails(text: str) -> list[tuple[int, int]]:
    """The base pattern's leftmost non-overlapping matches, found from each @ so that long runs cost no more than once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        hit = _DOMAIN.match(text, at + 1) if begin < at else None
        if hit:
            out.append((begin, hit.end()))
            last = hit.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = digits_of(m.group()) if m.end() - m.start() >= 14 else ""
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(digits_of(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the looser patterns that overlap no base span and no earlier (or longer) candidate."""
    found = []
    if _QUICK["email"].search(text):
        found += [(m.start(), 0, m.end()) for m in _SPELLED.finditer(text)]
    if _DIGIT.search(text):
        found += [(m.start(), 3, m.end()) for m in _NATIONAL.finditer(text)]
        found += [(m.start(), 4, m.end()) for m in _IDENTITY.finditer(text)]
        found += [(m.start(), 5, m.end()) for m in _ACCOUNT.finditer(text)]
    if _QUICK["secret"].search(text):
        found += [(m.start(1), 6, m.end(1)) for m in _ASSIGNED.finditer(text)]
        found += [(m.start(), 6, m.end()) for m in _PREFIXED.finditer(text)]
    out, last, k = [], 0, 0
    for a, kind, b in sorted(found, key=lambda s: (s[0], -s[2], s[1])):
        while k < len(base) and base[k][2] <= a:
            k += 1
        if a >= last and not any(x < b and a < y for x, _, y in base[max(0, k - 4) : k + 8]):
            out.append((a, kind, b))
            last = b
    return out


def votes(text: str, a: int, kind: int, b: int) -> tuple[int, ...]:
    """One vote of each of LABELERS: 1 for, -1 against, 0 none."""
    span, name = text[a:b], KINDS[kind]
    before = text[max(0, a - 40) : a]
    strict = 1 if STRICT[name].match(span) else -1
    near = {w.strip(".,:;=()[]\"'").lower() for w in before.split()[-4:]}
    near |= {w for x in near for w in re.split(r"[=:\"]", x)}
    key_word = 1 if near & WORDS else 0
    prefix = 1 if _PREFIXED.match(span) or name == "email" and re.search(r"[. ](com|org|net|de|fr|es|io|edu)\b", span) else 0
    d = digits_of(span)
    if name == "card":
        digits = 1 if luhn(d) else -1
    elif name == "account":
        plain = span.replace(" ", "")
        digits = 1 if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
    elif name == "phone":
        digits = 1 if 10 <= len(d) <= 15 else -1
    elif name == "secret":
        digits = 1 if 3 <= len(d) < len(span) else -1 if not d else 0
    else:
        digits = 0
    kinds = len(set(span.lower()))
    variety = -1 if kinds <= 3 else 1 if kinds >= min(8, len(span) * 0.5) else 0
    around = text[max(0, a - 12) : a] + text[b : b + 12]
    table = -1 if around.count("|") > 1 or len(digits_of(around)) > 12 else 0
    return strict, key_word, prefix, digits, variety, table


def buckets(text: str, a: int, kind: int, b: int) -> tuple[int, int]:
    """Length and share of digits of a span, coarsely."""
    n, d = b - a, sum("0" <= c <= "9" for c in text[a:b])
    return min(3, n // 12), min(3, 4 * d // n)


def pattern_counts(batches):
    """Counts of (kind, is base, votes, buckets) of the batches of a task."""
    seen: Counter = Counter()
    for part in (part for batch in batches for part in slices(batch)):
        for text in part.column(0).to_pylist():
            if not text:
                continue
            base = base_spans(text)
            for is_base, spans in ((1, base), (0, candidates(text, base))):
                for a, kind, b in spans:
                    seen[(kind, is_base, *votes(text, a, kind, b), *buckets(text, a, kind, b))] += 1
    rows = sorted(seen.items())
    yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, k)) for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["pattern", "n"])


def reliabilities(v: np.ndarray, n: np.ndarray, base: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation over vote patterns: each labeler's odds of voting -1, 0, 1 for false and true
    spans (labelers, 2, 3), the share of true spans, and each pattern's probability. Base spans count as true."""
    L = v.shape[1]
    p = np.where(base > 0, 1.0, np.clip(0.5 + 0.2 * v.sum(axis=1), 0.05, 0.95))
    share, odds = 0.5, np.zeros((L, 2, 3))
    for _ in range(rounds):
        for k, w in enumerate((n * (1 - p), n * p)):
            for vote in (-1, 0, 1):
                # the prior says that labelers are better than chance
                prior = 2.0 if (vote == 1) == (k == 1) and vote else 0.5
                odds[:, k, vote + 1] = ((v == vote) * w[:, None]).sum(axis=0) + prior
            odds[:, k] /= odds[:, k].sum(axis=1, keepdims=True)
        share = float(((n * p).sum() + 1) / (n.sum() + 2))
        logs = np.log(odds)
        at = np.arange(L)
        score = np.log(share / (1 - share)) + (logs[at, 1, v + 1] - logs[at, 0, v + 1]).sum(axis=1)
        fresh = np.where(base > 0, 1.0, 1 / (1 + np.exp(-np.clip(score, -30, 30))))
        if np.abs(fresh - p).max() < 1e-9:
            p = fresh
            break
        p = fresh
    return odds, share, p


def span_features(keys: np.ndarray) -> np.ndarray:
    """Features of the span classifier: kind, votes for and against, buckets. keys: rows of a pattern."""
    kind, v, bk = keys[:, 0], keys[:, 2 : 2 + len(LABELERS)], keys[:, 2 + len(LABELERS) :]
    hot = lambda x, m: np.eye(m)[x]
    return np.hstack([np.ones((len(keys), 1)), hot(kind, len(KINDS)), v == 1, v == -1, hot(bk[:, 0], 4), hot(bk[:, 1], 4)]).astype(float)


def learn(texts: DataFrame) -> dict | None:
    """Reliabilities and the span classifier from the vote patterns of all texts."""
    rows = texts.select("text").mapInArrow(pattern_counts, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return fit([(tuple(map(int, r["pattern"].split(","))), r["n"]) for r in rows])


def fit(rows: list[tuple[tuple[int, ...], int]]) -> dict | None:
    """The model for counted patterns (kind, is base, votes, buckets)."""
    if not rows:
        return None
    rows = sorted(rows)
    keys, n = np.array([k for k, _ in rows]), np.array([c for _, c in rows], float)
    odds, share, p = reliabilities(keys[:, 2 : 2 + len(LABELERS)], n, keys[:, 1])
    x = span_features(keys)
    w = np.zeros(x.shape[1])
    weight = n / n.sum() * min(n.sum(), 1e6)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (q - p)) + 1.0 * w
        H = (x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + np.eye(len(w))
        move = np.linalg.solve(H, g)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return {"weights": w, "odds": odds, "share": share}


def all_spans(text: str, model: dict | None) -> tuple[list, list]:
    """(base spans, base and added spans), each (start, kind index, end) in order."""
    base = base_spans(text)
    more = candidates(text, base) if model is not None else []
    if more:
        keys = np.array([(k, 0, *votes(text, a, k, b), *buckets(text, a, k, b)) for a, k, b in more])
        p = 1 / (1 + np.exp(-np.clip(span_features(keys) @ model["weights"], -30, 30)))
        more = [s for s, q in zip(more, p) if q >= ACCEPT]
    return base, sorted(base + more)


def listed(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def finder(model: dict | None):
    def run(batches):
        for part in (part for batch in batches for part in slices(batch)):
            counts, digest, text_spans = [], [], []
            for text in part.column(1).to_pylist():
                base, whole = all_spans(text or "", model)
                counts.append([sum(k == i for _, k, _ in base) for i in range(len(BASE))])
                digest.append(hashlib.sha256(listed(base).encode()).hexdigest())
                text_spans.append(listed(whole))
            c = np.array(counts, np.int64).reshape(-1, len(BASE))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c[:, i]) for i in range(len(BASE))), pa.array(digest, pa.string()), pa.array(text_spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    return run


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of base spans by kind, the digest of the base spans, and all spans, of each row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = learn(texts)
    return texts.mapInArrow(finder(model), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str | None, model: dict | None) -> str | None:
    if not text:
        return text
    out, last = [], 0
    for a, k, b in all_spans(text, model)[1]:
        if b <= last:
            continue
        out += [text[last : max(a, last)], f"<{KINDS[k].upper()}>"]
        last = b
    return "".join([*out, text[last:]])


def redactor(model: dict | None, at: int, name: str):
    def run(batches):
        for part in (part for batch in batches for part in slices(batch, name)):
            texts = [redacted(t, model) for t in part.column(at).to_pylist()]
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return run


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; all other columns stay as they are."""
    model = learn(docs.select(F.col(text_col).alias("text")))
    return docs.mapInArrow(redactor(model, docs.columns.index(text_col), text_col), docs.schema)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Contract: base patterns and digest; added spans in ``spans``."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
