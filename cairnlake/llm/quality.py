"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted cyclically over the features, add up to one lookup table a feature; the pairs whose
joint table takes most of what is left then get two-dimensional tables the same way. A document is scored by
adding one entry of each table: features are binned and looked up for a whole batch at once.

Labels are learned from a bounded sample of labelled rows (``most_rows``: of the ids with the smallest hash, and never
more rows than that, also if rows repeat); features and scores cover every whole text. Defined results: null counts as the empty text, which is
scored like any other; without any labelled row every score is 0.5; rows that share an id are scored each;
an id with several labels counts with the smallest; repeated rows and ties give equal scores; an
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, slices
from .neardup import shingle_sets

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "letters", "upper", "digits", "symbols", "stops", "shouts", "bars",
    "line_rate", "line_words", "other_script", "distinct_words", "repeated_fives", "repeated_lines", "short_words", "long_words", "odd_ends", "capitals",
)
BINS, PAIR_BINS = 32, 8

# Byte classes. Fixed values.
LETTER, UPPER, DIGIT, SYMBOL, STOP, SHOUT, BAR, LINE, HIGH = (np.zeros(256, bool) for _ in range(9))
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
UPPER[65:91] = True
DIGIT[48:58] = True
SYMBOL[list(b"#$%&*+<=>@[\\]^_`{}~")] = True
STOP[list(b".?")] = True
SHOUT[list(b"!")] = True
BAR[list(b"|")] = True
LINE[list(b"\n")] = True
HIGH[128:] = True


def features(hasher: WordHasher, column: pa.Array) -> np.ndarray:
    """One row of FEATURES a text."""
    n = len(column)
    data, starts, ends, first = hasher.spans(column)
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(sizes)])

    def total(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (run[off[1:]] - run[off[:-1]]).astype(float)

    def words_with(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (run[first[1:]] - run[first[:-1]]).astype(float)

    words = np.diff(first).astype(float)
    length = (ends - starts).astype(np.int64)
    b, w = np.maximum(sizes, 1), np.maximum(words, 1)
    letters = total(LETTER[data])
    lines = total(LINE[data])
    distinct = np.diff(shingle_sets(hasher, column, 1)[1])
    fives = np.diff(shingle_sets(hasher, column, 5)[1])
    repeated = np.zeros(n)
    for i, text in enumerate(column.to_pylist()):
        if text and "\n" in text:
            own = text.split("\n")
            repeated[i] = 1 - len(set(own)) / len(own)
    last = data[ends - 1] if len(ends) else data[:0]
    head = data[starts] if len(starts) else data[:0]
    upper = total(UPPER[data])
    return np.column_stack(
        [
            np.log1p(sizes), np.log1p(words), words_with_sum(length, first) / w, letters / b, upper / np.maximum(letters, 1),
            total(DIGIT[data]) / b, total(SYMBOL[data]) / b, total(STOP[data]) / w, total(SHOUT[data]) / w, total(BAR[data]) / w,
            lines / w, words / (lines + 1), total(HIGH[data]) / b, distinct / w, 1 - fives / np.maximum(np.maximum(words - 4, 1), fives),
            repeated, words_with(length <= 2) / w, words_with(length > 12) / w, words_with(SYMBOL[last]) / w, words_with(UPPER[head]) / w,
        ]
    )


def words_with_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values)])
    return (run[first[1:]] - run[first[:-1]]).astype(float)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]) if len(x) else np.zeros((0, len(cuts)), np.int64)


def line_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values by bin of a tree of at most ``leaves`` leaves over one feature's gradient and hessian sums."""
    edges = [0, len(g)]
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)
    while len(edges) <= leaves:
        best, cut = 1e-9, None
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                if gain.max() > best:
                    best, cut = float(gain.max()), int(at[gain.argmax()])
        if cut is None:
            break
        edges = sorted([*edges, cut])
    out = np.zeros(len(g))
    for a, b in zip(edges[:-1], edges[1:]):
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + ridge)
    return out


def cross_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Values by cell of the best tree that cuts one feature and then the other (four leaves), and its gain."""
    pad = lambda m: np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    G, H = pad(g), pad(h)
    a, b = G.shape[0] - 1, G.shape[1] - 1
    i, j = np.meshgrid(np.arange(1, a), np.arange(1, b), indexing="ij")
    quads = lambda M: (M[i, j], M[i, b] - M[i, j], M[a, j] - M[i, j], M[a, b] - M[i, b] - M[a, j] + M[i, j])
    gs, hs = quads(G), quads(H)
    gain = sum(x * x / (y + ridge) for x, y in zip(gs, hs))
    k = int(gain.argmax())
    r, c = i.ravel()[k], j.ravel()[k]
    out = np.zeros_like(g)
    for (rows, cols), x, y in zip(((slice(0, r), slice(0, c)), (slice(0, r), slice(c, b)), (slice(r, a), slice(0, c)), (slice(r, a), slice(c, b))), gs, hs):
        out[rows, cols] = x.ravel()[k] / (y.ravel()[k] + ridge)
    return out, float(gain.ravel()[k] - G[a, b] ** 2 / (H[a, b] + ridge))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pairs: int = 10, pair_rounds: int = 60, rate: float = 0.1, ridge: float = 5.0) -> dict:
    """Lookup tables for log-odds of label 1."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    z = binned(x, cuts)
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    tables = [np.zeros(len(c) + 1) for c in cuts]
    f = np.full(len(y), base)
    for _ in range(rounds):
        for k, table in enumerate(tables):
            p = 1 / (1 + np.exp(-f))
            g = np.bincount(z[:, k], y - p, len(table))
            h = np.bincount(z[:, k], p * (1 - p), len(table))
            step = rate * line_tree(g, h, 3, ridge)
            table += step
            f += step[z[:, k]]
    coarse = [np.unique(c[:: max(1, len(c) // (PAIR_BINS - 1))]) for c in cuts]
    zc = binned(x, coarse)

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        a, b = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(zc[:, i] * b + zc[:, j], v, a * b).reshape(a, b)

    p = 1 / (1 + np.exp(-f))
    able = [k for k, c in enumerate(coarse) if len(c)]
    found = [(cross_tree(sums(i, j, y - p), sums(i, j, p * (1 - p)), ridge)[1], i, j) for a, i in enumerate(able) for j in able[a + 1 :]]
    chosen = [(i, j) for _, i, j in sorted(found, key=lambda t: (-t[0], t[1:]))[:pairs]]
    grids = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in chosen]
    for _ in range(pair_rounds):
        for (i, j), grid in zip(chosen, grids):
            p = 1 / (1 + np.exp(-f))
            step = rate * cross_tree(sums(i, j, y - p), sums(i, j, p * (1 - p)), ridge)[0]
            grid += step
            f += step[zc[:, i], zc[:, j]]
    return {"base": base, "cuts": cuts, "tables": tables, "coarse": coarse, "pairs": chosen, "grids": grids}


def predict(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    z, zc = binned(x, model["cuts"]), binned(x, model["coarse"])
    f = np.full(len(x), model["base"])
    for k, table in enumerate(model["tables"]):
        f += table[z[:, k]]
    for (i, j), grid in zip(model["pairs"], model["grids"]):
        f += grid[zc[:, i], zc[:, j]]
    return 1 / (1 + np.exp(-f))


def measured(batches):
    hasher = WordHasher()
    for batch in batches:
        for part in slices(batch):
            x = features(hasher, part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "label", "x"])


def scorer(model: dict | None):
    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(predict(model, features(hasher, part.column(1))))], names=["id", "score"])

    return run


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> dict | None:
    """Fits the model. docs: id, text. labels: id, label (0 or 1), already without what may not be learned from."""
    sample = labels.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.min("label").cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    rows = docs.join(F.broadcast(sample), "id").select("id", "text", "label").mapInArrow(measured, "id long, label int, x array<double>")
    rows = rows.orderBy(F.xxhash64("id", "x"), "id", "x", "label").limit(most_rows).toPandas()
    if not len(rows):
        return None
    x = np.array(rows["x"].tolist())
    order = np.lexsort([*x.T, rows["id"].to_numpy()])
    return fit(x[order], rows["label"].to_numpy()[order].astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out=None, most_rows: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """id, held_out, score, predicted for each row of docs. held_out: a function of an id column that marks rows not to learn from."""
    held = held_out or (lambda c: F.lit(False))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")).where(~held(F.col("id")))
    model = learn(texts, known, most_rows)
    out = texts.mapInArrow(scorer(model), "id long, score double")
    return out.select(F.col("id").alias("doc_id"), F.coalesce(held(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Contract: rows whose crc32(doc_id as text) is divisible by 5 are held out; label 1 from a score of 0.3."""
    held = lambda c: F.crc32(c.cast("string")) % 5 == 0
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=held)
