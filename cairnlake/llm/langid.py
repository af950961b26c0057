"""Language identification in two steps: the language family, then the language within it.

Texts are described by hashed byte bigrams and trigrams of their lower-cased letters (square roots of their
shares, so that each text has length one). One linear support vector machine for each family, against
all others, gives the family; within a family each two languages have a machine of their own, and their
calibrated votes are averaged. Machines are fitted with a squared hinge loss and calibrated to probabilities.

The machines are learned from a bounded sample: ``most_rows`` rows at most, dealt evenly over the languages (the
``most_rows / 4`` most frequent ones) by a hash of id and text, and never more than that, also if rows repeat. Descriptions
and predictions cover every whole text; a row's margin is summed in a fixed order, so that equal texts get equal scores
wherever they stand. Defined results: null texts and texts
without a letter are ``und`` with score 0; so are all if nothing can be learned; a language that no family lists is
a family of its own; a sole family or language has probability 1; repeated rows and ties get equal results; an
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Language families by ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi".split(),
    "romance": "ca co es fr gl it la oc pt ro sc".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "baltic": "lt lv".split(),
    "uralic": "et fi hu".split(),
    "celtic": "br cy ga gd gv kw".split(),
    "turkic": "az kk ky tk tr tt uz".split(),
    "indic": "as bn gu hi mr ne pa sd si ur".split(),
    "iranian": "fa ku ps tg".split(),
    "semitic": "am ar he mt".split(),
    "dravidian": "kn ml ta te".split(),
    "austronesian": "id jv mg ms su tl".split(),
}
UND = "und"
TRIGRAMS, BIGRAMS = 2048, 512
DIMS = TRIGRAMS + BIGRAMS
#: Texts that are described at a time; bounds the scratch arrays, not the texts.
ROWS = 512

#: ASCII bytes other than letters become spaces.
_KEEP = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def family_of(lang: str) -> str:
    base = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, langs in FAMILIES.items() if base in langs), f"own:{lang}")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def describe(texts: list) -> np.ndarray:
    """One row of DIMS a text."""
    parts = [b" ".join((t or "").lower().encode("utf-8", "replace").translate(_KEEP).split()) for t in texts]
    sizes = np.array([len(p) + 2 for p in parts], np.int64)
    data = np.frombuffer(b"".join(b" %b " % p for p in parts), np.uint8).astype(np.uint32)
    n = len(parts)
    doc = np.repeat(np.arange(n, dtype=np.int64), sizes)
    out = np.zeros((n, DIMS), np.float32)
    for width, size, begin in ((3, TRIGRAMS, 0), (2, BIGRAMS, TRIGRAMS)):
        if len(data) < width:
            continue
        m = len(data) - width + 1
        key = np.zeros(m, np.uint32)
        for j in range(width):
            key = (key ^ data[j : j + m]) * np.uint32(0x9E3779B1)
            key ^= key >> np.uint32(15)
        key = (key * np.uint32(0x85EBCA6B)) >> np.uint32(32 - size.bit_length() + 1)
        inside = doc[:m] == doc[width - 1 :]
        counts = np.bincount((doc[:m] * size + key)[inside], minlength=n * size).reshape(n, size)
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        out[:, begin : begin + size] = np.sqrt(counts / total * 0.5)
    return out


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 200) -> np.ndarray:
    """Weights (last one: bias) of a linear machine with squared hinge loss, and its two calibration values.

    y: 1 or -1; both classes weigh alike. Accelerated gradient steps of a fixed size.
    """
    c = (np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost * 20).astype(np.float32)
    y = y.astype(np.float32)
    step = 1 / (1 + 2 * 2 * float(c.sum()))
    w, ahead, bias, bias_ahead, t = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0, 1.0
    for _ in range(rounds):
        pull = c * y * np.maximum(0, 1 - y * (x @ ahead + np.float32(bias_ahead)))
        fresh = ahead - np.float32(step) * (ahead - 2 * (pull @ x))
        fresh_bias = bias_ahead - step * (bias_ahead - 2 * float(pull.sum()))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = fresh + np.float32((t - 1) / after) * (fresh - w)
        bias_ahead = fresh_bias + (t - 1) / after * (fresh_bias - bias)
        w, bias, t = fresh, fresh_bias, after
    margin = (x @ w).astype(np.float64) + bias
    hi, lo = ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2)
    goal = np.where(y > 0, hi, lo)
    a, b = 2.0, 0.0
    for _ in range(50):  # Newton steps for the calibration
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-6)
        g = np.array([(margin * (p - goal)).sum() + 1e-3 * (a - 2), (p - goal).sum()])
        H = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(H, g), -1, 1)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return np.concatenate([w.astype(np.float64), [bias, max(a, 1e-3), b]])


def fit(x: np.ndarray, langs: list[str]) -> dict:
    labels = sorted(set(langs))
    names = sorted({family_of(v) for v in labels})
    own = np.array(langs)
    kin = np.array([family_of(v) for v in langs])
    families = [fit_machine(x, np.where(kin == f, 1.0, -1.0)) for f in names] if len(names) > 1 else []
    members = {f: [v for v in labels if family_of(v) == f] for f in names}
    pairs = {}
    for f, vs in members.items():
        for i, a in enumerate(vs):
            for b in vs[i + 1 :]:
                rows = (own == a) | (own == b)
                pairs[a, b] = fit_machine(x[rows], np.where(own[rows] == a, 1.0, -1.0))
    return {"names": names, "families": families, "members": members, "pairs": pairs}


def odds(x: np.ndarray, machine: np.ndarray) -> np.ndarray:
    margin = np.einsum("ij,j->i", x, machine[:-3].astype(np.float32)).astype(np.float64) + machine[-3]
    return 1 / (1 + np.exp(-np.clip(machine[-2] * margin + machine[-1], -30, 30)))


def predict(model: dict | None, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(x)
    langs, scores = np.full(n, UND, object), np.zeros(n)
    if model is None or not n:
        return langs, scores
    if model["families"]:
        p = np.column_stack([odds(x, m) for m in model["families"]])
        p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-12)
    else:
        p = np.ones((n, 1))
    family, sure = p.argmax(axis=1), p.max(axis=1)
    for k, name in enumerate(model["names"]):
        rows = np.flatnonzero(family == k)
        vs = model["members"][name]
        votes = np.zeros((len(rows), len(vs)))
        for (a, b), machine in model["pairs"].items():
            if a in vs and b in vs and len(rows):
                q = odds(x[rows], machine)
                votes[:, vs.index(a)] += q
                votes[:, vs.index(b)] += 1 - q
        votes = votes / (len(vs) * (len(vs) - 1) / 2) if len(vs) > 1 else votes + 1
        # a language can have 2 / m of the votes of m languages at most
        best = votes.argmax(axis=1) if len(rows) else np.zeros(0, int)
        langs[rows] = np.array(vs, object)[best]
        top = votes.max(axis=1) * max(1.0, len(vs) / 2) if len(rows) else np.zeros(0)
        scores[rows] = np.clip(sure[rows] * top, 0, 1)
    return langs, scores


def pieces(batches, text: str):
    """Cuts batches by text bytes and by ROWS."""
    for batch in batches:
        for part in slices(batch, text):
            for i in range(0, part.num_rows, ROWS):
                yield part.slice(i, ROWS)


def described(batches):
    for part in pieces(batches, "text"):
        x = describe(part.column(1).to_pylist()).astype(np.float16)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "lang", "x"])


def predictor(model: dict | None):
    def run(batches):
        for part in pieces(batches, "text"):
            texts = part.column(1).to_pylist()
            langs, scores = predict(model, describe(texts))
            for i, text in enumerate(texts):
                if not has_letter(text):
                    langs[i], scores[i] = UND, 0.0
            yield pa.RecordBatch.from_arrays([*part.columns[:1], *part.columns[2:], pa.array(langs.tolist(), pa.string()), pa.array(scores, pa.float64())], names=["id", *part.schema.names[2:], "lang_pred", "score"])

    return run


def learn(rows: DataFrame, most_rows: int = 4000) -> dict | None:
    """Fits the machines. rows: id, text, lang, without what may not be learned from."""
    rows = rows.where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_rows // 4).collect()}
    if not counts:
        return None
    share = most_rows // len(counts)
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, min(1.0, share / n)).otherwise(rate)
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(draw < rate).select("id", "text", "lang").mapInArrow(described, "id long, lang string, x binary")
    # the bound holds whatever repeats; rows that tie here are equal
    sample = sample.orderBy(F.xxhash64("id", "lang", "x"), "id", "lang", "x").limit(most_rows).toPandas()
    if not len(sample):
        return None
    sample = sample.sort_values(["id", "lang", "x"], kind="stable")
    langs = sample["lang"].tolist()
    packed = b"".join(sample.pop("x"))
    x = np.frombuffer(packed, np.float16).reshape(len(langs), DIMS).astype(np.float32)
    del sample, packed
    return fit(x, langs)


def identify(docs: DataFrame, train: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out=None, most_rows: int = 4000) -> DataFrame:
    """id, held_out, lang_pred, score of each row of docs.

    train: rows with languages to learn from (docs, if none). held_out: a function of an id column that marks
    rows not to learn from.
    """
    held = held_out or (lambda c: F.lit(False))
    pick = lambda df, *more: df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *more)
    known = pick(train if train is not None else docs, F.col(lang_col).alias("lang")).where(~held(F.col("id")))
    model = learn(known, most_rows)
    out = pick(docs).mapInArrow(predictor(model), "id long, lang_pred string, score double")
    return out.select(F.col("id").alias("doc_id"), F.coalesce(held(F.col("id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def held_out_third(c):
    return F.crc32(c.cast("string")) % 3 == 1


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract: rows whose crc32(doc_id as text) leaves 1 when divided by 3 are held out."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out=held_out_third)


def sieve(model: dict | None, at: int, name: str, least: float):
    def run(batches):
        for part in pieces(batches, name):
            texts = part.column(at).to_pylist()
            langs, scores = predict(model, describe(texts))
            keep = [has_letter(t) and lang != UND and score >= least for t, lang, score in zip(texts, langs, scores)]
            yield part.filter(pa.array(keep, pa.bool_()))

    return run


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out=None, most_rows: int = 4000, least_score: float = 0.4) -> DataFrame:
    """The rows of docs, with all their columns, whose language is found with ``least_score`` or more.

    If nothing can be learned, all rows with a letter are kept.
    """
    held = held_out or (lambda c: F.lit(False))
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(~held(F.col("id")))
    model = learn(known, most_rows)
    if model is None:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    return docs.mapInArrow(sieve(model, docs.columns.index(text_col), text_col, least_score), docs.schema)
