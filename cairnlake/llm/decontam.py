"""Benchmark decontamination by latent semantic retrieval.

1. Words are hashed to BUCKETS buckets. The document frequencies of the benchmark's buckets are counted over all
   documents, outside of runs of items' words (contamination does not lower the weights), and give TF-IDF weights.
2. Words of little weight count as none, where an item keeps enough others. The benchmark's items are cut into passages
   about as long as themselves (WINDOWS), a third of that apart, and dealt into parts of PART items of a kind
   (items of light words, such as those that stand in many documents, apart from others). A randomised
   singular value decomposition of a part's TF-IDF matrix (a random range, sharpened by power steps, and the decomposition
   of the rows in it) gives the leading latent directions: the fewest that hold ENERGY of the matrix, and RANK at
   most. Directions that no passage of the part has cannot raise a cosine with one, so the
   corpus needs no directions of its own, and parts keep the directions few for large benchmarks.
3. Every document is cut into passages of the same length and projected; benchmark passages with a cosine
   of COSINE or more are candidates. So are items of which RUN words in a row stand in the text, whatever they weigh.
4. Candidates around which fewer than PARAPHRASE of the item's words stand go. The others are confirmed on words: the longest
   common subsequence of the item and the text around the passage must hold STRONG of the item's words, or PARAPHRASE
   of them if it also holds the item's answer (the rarest words of its last sentence).

The benchmark is sent to executors in blocks of about ``block_items`` items and ``block_bytes`` of their text, so what is
broadcast is bounded.

Defined results: null, empty or word-less items and texts match nothing; items of fewer than MIN_WORDS words need all of
their words in a row; repeated rows match each; rows with a null id are judged too and keep the null
id; empty tables give an empty result. Extra columns are not read by ``find``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, WordHasher, slices

BUCKETS = 1 << 18
#: Words of a passage, by the least words of an item: passages are about as long as the items they are compared with.
WINDOWS = ((32, 48), (12, 24), (0, 12))
#: Items whose directions are found together, and the most directions of them.
PART = RANK = 256
#: Share of the squared singular values that the kept directions hold.
ENERGY = 0.9
#: So many of an item's words in a row make a candidate, whatever they weigh.
RUN = 4
#: Words whose IDF is below it (in more than a fifth of all documents) weigh nothing, if at least KEEP of each item's
#: distinct words that they stand in weigh more. FLOOR is the least weight of a word that counts.
LEAST_IDF, KEEP, FLOOR = 1.6, 0.4, 0.2
COSINE = 0.45
STRONG, PARAPHRASE = 0.8, 0.6
MIN_WORDS = 8
#: Words beside a passage, over the item's own length on each side, that are compared with the item.
MARGIN = 16

U64 = np.uint64
_WORD = re.compile(WORD)
_EDGE = ".,;:!?\"'()[]{}<>*%&$#|-_"
_AT_EDGE = np.isin(np.arange(256), np.frombuffer(_EDGE.encode(), np.uint8))


def normal_words(text: str | None) -> list[str]:
    """Lower-cased words without punctuation at their ends."""
    return [w for w in (x.strip(_EDGE) for x in _WORD.findall((text or "").lower())) if w]


def hashed(hasher: WordHasher, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every normal word of the texts, and n + 1 offsets."""
    data, starts, ends, first = hasher.spans(pa.compute.utf8_lower(column))
    left = np.flatnonzero(_AT_EDGE[data[starts]])
    while len(left):
        starts[left] += 1
        left = left[starts[left] < ends[left]]
        left = left[_AT_EDGE[data[starts[left]]]]
    right = np.flatnonzero((starts < ends) & _AT_EDGE[data[ends - 1]])
    while len(right):
        ends[right] -= 1
        right = right[_AT_EDGE[data[ends[right] - 1]]]
    words = starts < ends
    return hasher.of_spans(data, starts[words], ends[words]), np.concatenate([[0], np.cumsum(words)])[first]


def bucket(h: np.ndarray) -> np.ndarray:
    return (h & U64(BUCKETS - 1)).astype(np.int64)


class Runs:
    """Runs of RUN words of items (of all words of items that are shorter than MIN_WORDS), found in texts by their hashes."""

    def __init__(self, items: list[np.ndarray]) -> None:
        """items: word hashes of each."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, h in enumerate(items):
            n = RUN if len(h) >= MIN_WORDS else len(h)
            for i, g in enumerate(self.grams(h, n).tolist() if n else []):
                found.setdefault(n, []).append((g, k, i))
        self.tables = []
        for n, rows in sorted(found.items()):
            rows.sort()
            g = np.array([r[0] for r in rows], U64)
            keys, begin = np.unique(g, return_index=True)
            self.tables.append((n, keys, np.append(begin, len(rows)), np.array([r[1:] for r in rows], np.int64)))

    @staticmethod
    def grams(h: np.ndarray, n: int) -> np.ndarray:
        count = max(0, len(h) - n + 1)
        out = h[:count]
        for i in range(1, n):
            out = out * U64(0x9E3779B97F4A7C15) + h[i : i + count]
        return out

    def places(self, h: np.ndarray, first: np.ndarray):
        """(n, first words of runs in the texts, run of each, begin of each run's rows, rows (item, word)) for every length n."""
        end = np.repeat(first[1:], np.diff(first))
        for n, keys, begin, rows in self.tables:
            maybe = np.zeros(1 << 22, bool)
            maybe[(keys >> U64(42)).astype(np.int64)] = True
            g = self.grams(h, n)
            at = np.flatnonzero(maybe[(g >> U64(42)).astype(np.int64)])
            at = at[at + n <= end[at]]
            key = np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)
            same = keys[key] == g[at]
            yield n, at[same], key[same], begin, rows

    def candidates(self, h: np.ndarray, first: np.ndarray):
        """(text, first word, end, item, -1, word at which the item would begin) of the runs that stand in texts."""
        for n, at, key, begin, rows in self.places(h, first):
            size = begin[key + 1] - begin[key]
            row = np.repeat(begin[key] - np.cumsum(size) + size, size) + np.arange(size.sum())
            at = np.repeat(at, size)
            item, word = rows[row].T
            yield np.searchsorted(first, at, side="right") - 1, at, at + n, item, np.full(len(at), -1.0), at - word


def bounds(count: int, window: int) -> list[tuple[int, int]]:
    """Passages of a text of ``count`` words, a third of the window apart; the last one ends with the text."""
    third = window // 3
    return [(a, min(a + window, count)) for a in range(0, max(count - window + third, 1), third)] if count else []


def placed(vocabulary: np.ndarray) -> np.ndarray:
    """Place of every bucket in the vocabulary, or -1."""
    place = np.full(BUCKETS, -1, np.int32)
    place[vocabulary] = np.arange(len(vocabulary))
    return place


def weights(idf: np.ndarray, items: list[np.ndarray]) -> np.ndarray:
    """IDF with light words at 0, but for those of items that would keep too little. items: vocabulary places of each."""
    idf = np.maximum(idf, FLOOR)
    light = idf < LEAST_IDF
    needed = [np.unique(i) for i in items if len(i)]
    spare = [i for i in needed if (~light[i]).mean() < KEEP]
    if spare:
        light[np.concatenate(spare)] = False
    return np.where(light, 0.0, idf)


def frequency_counter(vocabulary: np.ndarray, items: list[np.ndarray]):
    """In how many of a task's documents each bucket of the vocabulary stands, outside of runs of the items' words.

    What the benchmark has put into documents says nothing about how frequent its words are. items: word hashes of each."""
    runs = Runs([h for h in items if len(h) >= MIN_WORDS])

    def run(batches):
        hasher = WordHasher()
        place = placed(vocabulary)
        total, docs = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for part in slices(batch):
                h, first = hashed(hasher, part.column(0))
                docs += part.num_rows
                at = place[bucket(h)]
                for n, start, *_ in runs.places(h, first):
                    for i in range(n):
                        at[start + i] = -1
                doc = np.repeat(np.arange(part.num_rows), np.diff(first))
                mine = at >= 0
                total += np.bincount(np.unique(doc[mine] * len(vocabulary) + at[mine]) % len(vocabulary), minlength=len(vocabulary))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], docs))], names=["place", "n"])

    return run


def latent_basis(rows: np.ndarray, rank: int, power: int = 3, energy: float = ENERGY) -> np.ndarray:
    """Leading right singular vectors of the rows, as columns: random range, power steps, decomposition of the rows in that range.

    As many as hold ``energy`` of the squared norm of all rows, ``rank`` at most."""
    rank = min(rank, *rows.shape)
    basis = np.linalg.qr(np.random.default_rng(17).standard_normal((rows.shape[1], rank)))[0]
    for _ in range(power):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, values, turned = np.linalg.svd(rows @ basis, full_matrices=False)
    held = np.cumsum(values**2)
    kept = 1 + int(np.searchsorted(held, energy * (rows**2).sum() * (1 - 1e-12)))
    return basis @ turned[:kept].T


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two word-id arrays."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        grown = np.where(b == x, row[:-1] + 1, row[1:])
        row[1:] = np.maximum.accumulate(grown)
    return int(row[-1])


class Items:
    """Benchmark items with passages of one length, and their latent directions."""

    def __init__(self, places: list[int], hashes: list[np.ndarray], vocabulary: np.ndarray, idf: np.ndarray, rank: int, window: int) -> None:
        """places: of the items in the block. vocabulary: buckets of the block's items, with the weights idf."""
        self.third = window // 3
        buckets = [bucket(h) for h in hashes]
        self.vocabulary = np.unique(np.concatenate(buckets))
        mine = idf[np.searchsorted(vocabulary, self.vocabulary)]
        at = [np.searchsorted(self.vocabulary, x) for x in buckets]
        self.idf = weights(mine, at)
        cut = [(k, x[p:q]) for k, x in zip(places, at) for p, q in bounds(len(x), window)]
        self.owner = np.array([k for k, _ in cut], np.int64)
        rows = np.array([np.bincount(x, self.idf[x], len(self.idf)) for _, x in cut])
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
        basis = latent_basis(rows, rank)
        vectors = rows @ basis
        self.vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        self.weighted = (self.idf[:, None] * basis).astype(np.float32)

    def candidates(self, at: np.ndarray, first: np.ndarray):
        """(text, first word, end, item, cosine, 0) of passages near an item; at: places in the vocabulary of the texts' words."""
        third = self.third
        count = np.diff(first)
        parts = -(-count // third)
        base = np.concatenate([[0], np.cumsum(parts)])
        text = np.repeat(np.arange(len(count)), parts)
        begin = first[text] + (np.arange(base[-1]) - base[text]) * third
        heavy = np.flatnonzero((at >= 0) & (self.idf[at] > 0))
        upto = np.searchsorted(heavy, np.append(begin, first[-1]))
        step = max(1, (1 << 15) // third)
        for lo in range(0, base[-1], step):
            hi = min(lo + step, base[-1])
            far = min(hi + 2, base[-1])
            sums = np.zeros((far - lo + 2, self.weighted.shape[1]), np.float32)
            full = lo + np.flatnonzero(upto[lo:far] < upto[lo + 1 : far + 1])
            if not len(full):
                continue
            sums[full - lo] = np.add.reduceat(self.weighted[at[heavy[upto[lo] : upto[far]]]], upto[full] - upto[lo], axis=0)
            # a passage is three parts of one text; shorter texts are one passage
            start = np.arange(lo, hi)
            start = start[(start + 2 < base[text[start] + 1]) | (start == base[text[start]])]
            last = np.minimum(start + 3, base[text[start] + 1])
            v = sums[start - lo] + np.where((start + 1 < last)[:, None], sums[start - lo + 1], 0) + np.where((start + 2 < last)[:, None], sums[start - lo + 2], 0)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            c = v @ self.vectors.T
            r, q = np.nonzero(c >= COSINE)
            yield text[start[r]], begin[start[r]], np.minimum(begin[start[r]] + 3 * third, first[text[start[r]] + 1]), self.owner[q], c[r, q], np.zeros(len(r), np.int64)


class Block:
    """A block of benchmark items as the executors use it."""

    def __init__(self, rows: list[tuple[int, str]], vocabulary: np.ndarray, hashes: list[np.ndarray], idf: np.ndarray, rank: int) -> None:
        self.ids = [i for i, _ in rows]
        self.words = [normal_words(t) for _, t in rows]
        self.hashes = hashes
        self.runs = Runs(hashes)
        self.vocabulary, self.idf = vocabulary, np.maximum(idf, FLOOR)
        self.first = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
        self.at = np.searchsorted(vocabulary, bucket(np.concatenate(hashes)))
        outside = float(np.median(self.idf))
        weight = {w: self.idf[k] for ws, h in zip(self.words, hashes) for w, k in zip(ws, np.searchsorted(vocabulary, bucket(h)))}
        last = [normal_words(re.split(r"(?<=[.!?])\s+", (t or "").strip())[-1]) for _, t in rows]
        self.answers = [set(sorted(set(ws), key=lambda w: (-weight.get(w, outside), w))[:3]) for ws in last]
        self.usual = float(np.median([np.median(self.weight(h)) for h in hashes if len(h)]))
        kinds: dict = {}
        for k, h in enumerate(hashes):
            if len(h) >= MIN_WORDS:
                kinds.setdefault(self.kind(h), []).append(k)
        self.parts = []
        for kind, mine in sorted(kinds.items()):
            for lo in range(0, len(mine), PART):
                some = mine[lo : lo + PART]
                self.parts.append(Items(some, [hashes[k] for k in some], vocabulary, idf, rank, kind[0]))

    def weight(self, h: np.ndarray) -> np.ndarray:
        """Weights of an item's distinct words."""
        return self.idf[np.searchsorted(self.vocabulary, np.unique(bucket(h)))]

    def kind(self, h: np.ndarray) -> tuple[int, bool]:
        """Items of one kind are searched together: those with passages of about the same length, and of like weights.

        Words of an item that stands in many documents weigh little; beside items of rare words, these would decide."""
        w = self.weight(h)
        light = np.median(w) < self.usual / 2 or (w >= LEAST_IDF).mean() < KEEP
        return next(m for n, m in WINDOWS if len(h) >= n), bool(light)

    def likely(self, at: np.ndarray, first: np.ndarray, doc: np.ndarray, x: np.ndarray, y: np.ndarray, item: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of the candidates (sorted by text, item, place) that overlap and hold enough of the item's words to be confirmed."""
        if not len(doc):
            return []
        sizes = np.diff(self.first)
        p, q = np.maximum(first[doc], x - sizes[item] - MARGIN), np.minimum(first[doc + 1], y + sizes[item] + MARGIN)
        other = np.append(True, (np.diff(doc) != 0) | (np.diff(item) != 0))
        far = (len(at) + 1) * np.cumsum(other)
        end = np.maximum.accumulate(far + q)
        begin = np.flatnonzero(other | np.append(True, (far + p)[1:] > end[:-1]))
        after = np.append(begin[1:], len(doc))
        lo, hi = p[begin], (end - far)[after - 1]
        known = np.flatnonzero(at >= 0)
        keys = np.sort(at[known].astype(np.int64) * len(at) + known)
        enough = np.zeros(len(begin), bool)
        for i in range(0, len(begin), 1 << 15):
            some = slice(i, i + (1 << 15))
            k = item[begin[some]]
            n = sizes[k]
            span = np.repeat(np.arange(len(k)), n)
            word = self.at[np.arange(len(span)) + np.repeat(self.first[k] - np.cumsum(n) + n, n)] * len(at)
            there = np.append(keys, np.iinfo(np.int64).max)[np.searchsorted(keys, word + lo[some][span])] < word + hi[some][span]
            enough[some] = np.bincount(span, there, len(k)) >= PARAPHRASE * n - 1e-9
        return list(zip(begin[enough].tolist(), after[enough].tolist()))

    def cosine(self, item: np.ndarray, text: np.ndarray) -> float:
        """TF-IDF cosine of an item and words of a text, by the item's words."""
        u, n = np.unique(bucket(item), return_counts=True)
        w = self.idf[np.searchsorted(self.vocabulary, u)] ** 2
        m = np.array([(bucket(text) == x).sum() for x in u])
        return float((w * n * m).sum() / max(np.sqrt((w * n * n).sum() * (w * m * m).sum()), 1e-12))


def confirm(item: list[str], answer: set[str], around: list[str]) -> tuple[float, bool]:
    """(share of the item's words in the longest common subsequence, whether the item is in the words around)."""
    if len(item) < MIN_WORDS:
        n = len(item)
        whole = any(around[i : i + n] == item for i in range(len(around) - n + 1))
        return (1.0 if whole else 0.0), whole
    there = set(around)
    if sum(w in there for w in item) < PARAPHRASE * len(item):
        return 0.0, False
    ids = {w: i for i, w in enumerate(set(item))}
    a = np.array([ids[w] for w in item])
    b = np.array([ids.get(w, -1) for w in around], np.int64)
    b = b[b >= 0]
    share = lcs(a, b) / len(a)
    return share, share >= STRONG or share >= PARAPHRASE and answer <= there


def searcher(block: Block):
    """(id, item, cosine, share) for every document and item that it holds, the best passage of each."""

    def run(batches):
        hasher = WordHasher()
        places = [placed(p.vocabulary) for p in block.parts]
        place_of = placed(block.vocabulary)
        for batch in batches:
            for part in slices(batch, most=1 << 18):
                h, first = hashed(hasher, part.column(1))
                if not len(h):
                    continue
                b = bucket(h)
                found = [f for p, place in zip(block.parts, places) for f in p.candidates(place[b], first)] + list(block.runs.candidates(h, first))
                doc, x, y, item, cosine, lead = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 6
                order = np.lexsort((y, x, item, doc))
                doc, x, y, item, cosine, lead = (c[order] for c in (doc, x, y, item, cosine, lead))
                ids, texts = part.column(0), part.column(1)
                out, cache = {}, (None, [])
                for lo, hi in block.likely(place_of[b], first, doc, x, y, item):
                    d, k = int(doc[lo]), int(item[lo])
                    size, base = len(block.words[k]), int(first[d])
                    spans: list[list[int]] = []
                    for p, q in zip(x[lo:hi].tolist(), y[lo:hi].tolist()):
                        p, q = max(0, p - base - size - MARGIN), q - base + size + MARGIN
                        if spans and p <= spans[-1][1] and q - spans[-1][0] <= 6 * (WINDOWS[0][1] + size):
                            spans[-1][1] = max(q, spans[-1][1])
                        else:
                            spans.append([p, q])
                    if cache[0] != d:
                        cache = (d, normal_words(texts[d].as_py()))
                    share, holds = max((confirm(block.words[k], block.answers[k], cache[1][p:q]) for p, q in spans), key=lambda s: (s[1], s[0]))
                    if holds:
                        near = float(np.max(cosine[lo:hi]))
                        if near < 0:  # found by runs only
                            near = max(block.cosine(block.hashes[k], h[max(base, z) : min(z + size, int(first[d + 1]))]) for z in set(lead[lo:hi].tolist()))
                        best = out.get((d, k), (0.0, 0.0))
                        out[d, k] = (max(best[0], near), max(best[1], share))
                out = [(ids[d].as_py(), block.ids[k], c, share) for (d, k), (c, share) in out.items()]
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())], names=["doc_id", "item_id", "cosine", "lcs_share"])

    return run


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_items: int = 5000, rank: int = RANK, block_bytes: int = 1 << 23) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share) for every document that holds a benchmark item."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").rlike(WORD))
    out = spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs_share double")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(-(-size["n"] // block_items), -(-size["b"] // block_bytes))
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        rows = sorted(((r["item_id"], r["text"]) for r in mine.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        packed = packed_block(texts, rows, rank)
        if packed is not None:
            out = out.unionByName(texts.mapInArrow(searcher(packed), "doc_id long, item_id long, cosine double, lcs_share double"))
    return out


def packed_block(texts: DataFrame, rows: list[tuple[int, str]], rank: int) -> Block | None:
    """The search index of one block of benchmark items; document frequencies are counted over all texts."""
    hashes, vocabulary = item_hashes(rows)
    if not len(vocabulary):
        return None
    counted = texts.select("text").mapInArrow(frequency_counter(vocabulary, hashes), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(vocabulary) + 1)
    for r in counted:
        df[r["place"]] = r["n"]
    return Block(rows, vocabulary, hashes, np.log((df[-1] + 1) / (df[:-1] + 1)), rank)


def item_hashes(rows: list[tuple[int, str]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Word hashes of every item, and the buckets of all."""
    h, first = hashed(WordHasher(), pa.array([" ".join(normal_words(t)) for _, t in rows], pa.large_string()))
    return [h[x:y] for x, y in zip(first[:-1], first[1:])], np.unique(bucket(h))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item. Each row is judged by its own text, whatever other rows share its id or have none."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    bad = find(docs.select(key.alias("_cairnlake_key"), F.col(text_col).alias("text")), benchmark, "_cairnlake_key", "text")
    bad = bad.select(F.col("doc_id").alias("_cairnlake_bad")).distinct()
    return docs.withColumn("_cairnlake_key", key).join(bad, F.col("_cairnlake_key") == F.col("_cairnlake_bad"), "left_anti").select(docs.columns)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) that matches, over all documents."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
