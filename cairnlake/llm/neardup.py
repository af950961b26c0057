"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming join.

A document's set holds its distinct word shingles (the whole word sequence if it has fewer words
than a shingle). A signature has ``PARTS`` chunks of ``WIDTH`` b-bit MinHash values. Two signatures that
differ in fewer than ``2 * PARTS`` values must agree in some chunk up to one value (pigeonhole), so
each signature is indexed under every chunk with each one of its values left out. Documents that
share an index key are candidates; candidates are confirmed by the Jaccard similarity of the full sets.

Rows with equal sets are one class, whatever their ids, and only classes are compared. No group is expanded into
pairs: in each key group all members are compared with the one that meets most others; only members that are still
in different components after that are compared with each other, inside blocks bounded in rows and in shingles, by
their signatures and then their full sets; of these comparisons only links that join two components leave the task.
Joins on keys that many rows may share have plain tables on both sides, so that the optimiser can split them; the text
of a class that meets many others goes to as many blocks as its pairs fill.

Defined results: null or word-less texts have an empty set and link with nothing; rows with a null
id keep a null component and are kept; rows that share an id are rows of their own, each with the component of its
text; repeated rows and ties resolve to the smallest id; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, WordHasher, materialize, mix64, release, seeded, slices

PARTS, WIDTH = 8, 4
VALUES = PARTS * WIDTH
#: Differing signature values (of VALUES) beyond which a pair left over in a key group is no candidate.
#: Pairs up to 2 * PARTS - 1 are guaranteed to share a key; at similarity 0.8 more than 17 has odds of 6e-6.
MOST_ERRORS = 17
#: The same for the 2-bit digest that travels with the keys; odds of 6e-6 at similarity 0.8.
MOST_DIGEST_ERRORS = 15
#: Members of a key group that are compared in one block.
BLOCK = 1024
#: The same where their texts are held, and the shingles that these may have.
TEXT_BLOCK, SHINGLE_BLOCK = 512, 1 << 19
#: Members of a key group whose pairs with its head are confirmed from one copy of the head's text.
SALT = 512
#: Edges of a graph that are one file of about a megabyte, read by one task; larger graphs are shuffled.
FEW_EDGES = 1 << 16
#: Least similarity for which MOST_ERRORS and MOST_DIGEST_ERRORS hold.
LEAST_PERCENT = 80

U64 = np.uint64
SKETCH = "id long, body long, n_shingles long, h1 long, h2 long, digest long, sig binary"


def shingle_sets(hasher: WordHasher, column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and n + 1 offsets into them."""
    words, first = hasher.hashes(column)
    n = len(first) - 1
    count = np.diff(first)
    with np.errstate(over="ignore"):
        salt = seeded(k, 23) | U64(1)
        doc = np.repeat(np.arange(n), count)
        if len(words) >= k:
            s = np.zeros(len(words) - k + 1, U64)
            for j in range(k):
                s += words[j : len(words) - k + 1 + j] * salt[j]
            inside = doc[: len(s)] == doc[k - 1 :]
            s, owner = mix64(s[inside]), doc[: len(s)][inside]
        else:
            s, owner = np.zeros(0, U64), np.zeros(0, np.int64)
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            extra = np.zeros(len(few), U64)
            for j in range(k - 1):
                has = count[few] > j
                extra[has] += words[first[few[has]] + j] * salt[j]
            extra = mix64(extra + count[few].astype(U64) * U64(0xD6E8FEB86659FD93))
            s, owner = np.concatenate([s, extra]), np.concatenate([owner, few])
            order = np.argsort(owner, kind="stable")
            s, owner = s[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            s[a:b].sort()
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[fresh], owner[fresh]
    return s, np.searchsorted(owner, np.arange(n + 1))


def signatures(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """VALUES 16-bit MinHash values for each non-empty set."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), VALUES), np.uint16)
    if len(full):
        at = bounds[:-1][full]
        with np.errstate(over="ignore"):
            for v, (a, b) in enumerate(zip(seeded(VALUES, 31) | U64(1), seeded(VALUES, 37))):
                least = np.minimum.reduceat((s ^ b) * a, at)
                out[full, v] = (mix64(least) & U64(0xFFFF)).astype(np.uint16)
    return out


def sketcher(k: int):
    def sketch(batches):
        hasher = WordHasher()
        for batch in batches:
            for part in slices(batch):
                s, bounds = shingle_sets(hasher, part.column(1), k)
                sizes = np.diff(bounds)
                sig = signatures(s, bounds)
                full = np.flatnonzero(sizes)
                h = np.zeros((2, len(sizes)), U64)
                digest = np.zeros(len(sizes), U64)
                with np.errstate(over="ignore"):
                    if len(full):
                        h[0, full] = np.add.reduceat(mix64(s ^ U64(0xA5A5A5A5A5A5A5A5)), bounds[:-1][full])
                        h[1, full] = np.add.reduceat(mix64(s * U64(0x9FB21C651E98DF25)), bounds[:-1][full])
                    for v in range(VALUES):
                        digest |= (sig[:, v].astype(U64) & U64(3)) << U64(2 * v)
                whole = [row.tobytes() for row in sig]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sizes.astype(np.int64)), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), pa.array(digest.view(np.int64)), pa.array(whole, pa.binary())],
                    names=["id", "body", "n_shingles", "h1", "h2", "digest", "sig"],
                )

    return sketch


def index_keys(batches):
    """(key, slot, id, n, digest): each chunk of the signature with each one of its values left out."""
    salt = seeded(PARTS * WIDTH, 41)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(n, VALUES).astype(U64)
        for c in range(PARTS):
            chunk = sig[:, c * WIDTH : (c + 1) * WIDTH]
            for out in range(WIDTH):
                key = np.full(n, salt[c * WIDTH + out], U64)
                with np.errstate(over="ignore"):
                    for j in range(WIDTH):
                        if j != out:
                            key = mix64(key * U64(0x9E3779B97F4A7C15) + chunk[:, j])
                slot = pa.array(np.full(n, c * WIDTH + out, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), slot, batch.column(0), batch.column(1), batch.column(2)], names=["key", "slot", "id", "n", "digest"])


def shared_share(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union; empty sets have not."""
    if not len(x) or not len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm(k: int, percent: int):
    """Keeps the pairs (u, v, a_text, b_text) whose full sets are alike. A text on the left repeats in runs."""

    def check(batches):
        hasher = WordHasher()
        for batch in batches:
            for some in slices(batch, "a_text"):
                for part in slices(some, "b_text"):
                    u = part.column(0).to_numpy()
                    fresh = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
                    which = np.zeros(len(u), np.int64)
                    which[fresh[1:]] = 1
                    which = np.cumsum(which)
                    a, ab = shingle_sets(hasher, part.column(2).take(pa.array(fresh)), k)
                    b, bb = shingle_sets(hasher, part.column(3), k)
                    good = [shared_share(a[ab[w] : ab[w + 1]], b[bb[i] : bb[i + 1]], percent) for i, w in enumerate(which.tolist())]
                    keep = pa.array(good, pa.bool_())
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["u", "v"])

    return check


def partners(group: pa.Table, percent: int):
    """For each row of a block pair of a key group, the rows that it has to be compared with: near in size and
    signature, in another component, and meeting in this key first. Rows are sorted by size of the set."""
    ids, comp, n, side = (group.column(c).to_numpy() for c in ("id", "comp", "n", "side"))
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(len(ids), VALUES)
    slot = group.column("slot")[0].as_py()
    for i in np.flatnonzero(side <= 1).tolist():
        j1 = int(np.searchsorted(n, n[i] * 100 / percent, side="right"))
        j0 = int(np.searchsorted(n, n[i] * percent / 100, side="left")) if side[i] == 1 else i + 1
        if j1 <= j0:
            continue
        far = comp[j0:j1] != comp[i]
        if side[i] == 1:
            far &= side[j0:j1] == 2
        near = np.flatnonzero(far) + j0
        wrong = sig[near] != sig[i]
        good = wrong.sum(axis=1) <= MOST_ERRORS
        near, wrong = near[good], wrong[good].reshape(-1, PARTS, WIDTH)
        if not len(near):
            continue
        # a pair belongs to the first key that it shares: the first chunk with one error at most
        errors = wrong.sum(axis=2)
        part = (errors <= 1).argmax(axis=1)
        at = np.arange(len(near))
        place = np.where(errors[at, part] == 0, 0, wrong[at, part].argmax(axis=1))
        near = near[part * WIDTH + place == slot]
        if len(near):
            yield i, near


def with_partners(percent: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("n")
        taking = np.zeros(group.num_rows, bool)
        for i, near in partners(group, percent):
            taking[i] = True
            taking[near] = True
        return group.filter(pa.array(taking)).select(["key", "id"])

    return run


def leftover_links(k: int, percent: int):
    """Links between components of a block pair of a key group, confirmed on full sets; one for each two
    components that it joins, however many pairs there are."""
    tools: list[WordHasher] = []  # made once a task; its tables take longer than most groups

    def run(group: pa.Table) -> pa.Table:
        if not tools:
            tools.append(WordHasher())
        group = group.sort_by("n")
        ids = group.column("id").to_numpy()
        hasher, hashes, sizes = tools[0], [], []
        for part in group.select(["text"]).to_batches(max_chunksize=64):
            for some in slices(part):
                sets, bounds = shingle_sets(hasher, some.column(0), k)
                hashes.append(sets)
                sizes.append(np.diff(bounds))
        size = np.concatenate(sizes)
        begin = np.cumsum(size) - size
        # shingles as small numbers, so that those of one row can be looked up in a table
        kinds, shingle = np.unique(np.concatenate(hashes), return_inverse=True)
        mine = np.zeros(len(kinds), bool)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        comp = group.column("comp").to_pylist()
        us, vs = [], []
        for i, near in partners(group, percent):
            near = near[size[near] > 0]
            if not size[i] or not len(near):
                continue
            own = shingle[begin[i] : begin[i] + size[i]]
            mine[own] = True
            at = np.cumsum(size[near]) - size[near]
            both = np.add.reduceat(mine[shingle[np.repeat(begin[near] - at, size[near]) + np.arange(size[near].sum())]], at, dtype=np.int64)
            mine[own] = False
            for j in near[100 * both >= percent * (size[i] + size[near] - both)].tolist():
                a, b = find(comp[i]), find(comp[j])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    us.append(min(ids[i], ids[j]))
                    vs.append(max(ids[i], ids[j]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def block_pairs(rows: DataFrame, block: int, shingles: int) -> DataFrame:
    """Deals each key group into blocks of about ``block`` rows and ``shingles`` shingles (n), and copies each row to the
    pairs of blocks (x, y) that it has to be in; side is 0 if both ends are one block, 1 or 2 for the two blocks of a pair.

    In a group of several blocks, rows of its largest component have blocks of their own, which meet those of the other rows
    but not each other: a few strangers in a large group cost as many copies of it as they fill blocks."""
    by_comp = rows.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    whole = by_comp.groupBy("key").agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.max(F.struct("c", "w", "comp")).alias("main"))
    one = (F.col("c") <= block) & (F.col("w") <= shingles)
    blocks = lambda c, w: F.greatest(F.lit(1), F.ceil(c / block), F.ceil(w / shingles)).cast("int")
    sizes = whole.select(
        "key",
        F.when(~one, F.col("main.comp")).alias("main"),
        F.when(one, 1).otherwise(blocks(F.col("c") - F.col("main.c"), F.col("w") - F.col("main.w"))).alias("blocks"),
        F.when(one, 0).otherwise(blocks(F.col("main.c"), F.col("main.w"))).alias("mains"),
    )
    dealt = rows.join(materialize(sizes, "blocks"), "key")
    is_main = F.coalesce(F.col("comp") == F.col("main"), F.lit(False))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.when(is_main, F.col("mains")).otherwise(F.col("blocks"))).cast("int"))
    others, mains = F.sequence(F.lit(0), F.col("blocks") - 1), F.filter(F.sequence(F.lit(0), F.greatest(F.col("mains") - 1, F.lit(0))), lambda m: m < F.col("mains"))
    place = lambda x, y, side: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))
    with_others = F.transform(others, lambda o: place(F.least(F.col("block"), o), F.greatest(F.col("block"), o), F.when(o == F.col("block"), 0).when(o > F.col("block"), 1).otherwise(2)))
    with_mains = F.transform(mains, lambda m: place(F.col("block"), F.col("blocks") + m, F.lit(1)))
    of_main = F.transform(others, lambda o: place(o, F.col("blocks") + F.col("block"), F.lit(2)))
    spread = F.when(is_main, of_main).otherwise(F.concat(with_others, with_mains))
    return dealt.select(*rows.columns, F.explode(spread).alias("p")).select(*rows.columns, "p.x", "p.y", "p.side")


def are_stars(edges: DataFrame) -> bool:
    """Whether in edges (u, v), u < v, no id is on both sides and every v has one u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(0).alias("v")), F.struct(F.col("v").alias("id"), F.lit(1).alias("v")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.v").alias("tips"), F.min("e.v").alias("least")).where("tips > 1 or (tips = 1 and least = 0)").isEmpty()


def sized(edges: DataFrame, few: int) -> DataFrame:
    """Written edges, as one partition if there are few: their turns then need no shuffles, each of which costs the driver
    as many tasks as there are shuffle partitions, however small the graph is."""
    return edges.coalesce(1) if edges.count() <= few else edges


def components(edges: DataFrame, most_rounds: int | None = None, few: int = FEW_EDGES) -> DataFrame:
    """(id, comp) for every id of edges (u, v): the smallest id reachable, by alternating star contraction until all are stars.

    With a limit of rounds, running out of it is an error."""
    edges = sized(materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "edges"), few)
    for done in count():
        if are_stars(edges):
            break
        if done == most_rounds:
            raise RuntimeError(f"components still change after {most_rounds} rounds")
        turned = F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
        both = edges.select(F.explode(F.array(F.struct("u", "v"), turned)).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        fresh = large.join(small, "a").select(F.col("m").alias("u"), F.explode(F.array("a", "b")).alias("v")).where("u < v").distinct()
        after = sized(materialize(fresh, "edges"), few)
        release(edges)
        edges = after
    out = materialize(edges.select(F.col("v").alias("id"), F.col("u").alias("comp")).unionByName(edges.select(F.col("u").alias("id"), F.col("u").alias("comp")).distinct()), "components")
    release(edges)
    return out


def bodies(texts: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of the wanted classes: the text of the row that stands for each. Rows repeat, so one of them is taken."""
    rows = classes.select(F.col("cls").alias("id"), F.col("row.id").alias("row_id"), F.col("row.body").alias("body")).join(wanted, "id", "left_semi")
    found = texts.join(rows, (F.col("row_id") == texts["doc"]) & (rows["body"] == texts["body"])).select(rows["id"], "text")
    return materialize(found.groupBy("id").agg(F.min("text").alias("text")), "bodies")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v) of the pairs (head, id, members) that are alike; texts: id, text."""
    salted = pairs.select("head", "id", F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / SALT)).cast("int").alias("salt"))
    a = salted.select("head", "salt").distinct().join(texts.select(F.col("id").alias("head"), F.col("text").alias("a_text")), "head")
    b = salted.join(texts.withColumnRenamed("text", "b_text"), "id")
    both = b.join(a, ["head", "salt"]).select(F.col("head").alias("u"), F.col("id").alias("v"), "a_text", "b_text")
    return both.mapInArrow(confirm(k, percent), "u long, v long")


def linked(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows: id, body, n_shingles, h1, h2 of each row; classes: h1, h2, comp, component_id, row of each class of equal sets).

    body is a hash of the text, so (id, body) names a row's text; row is the first (id, body) of the class."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"links are guaranteed from a similarity of {LEAST_PERCENT} percent on")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("body"))
    rows = materialize(texts.mapInArrow(sketcher(shingle_words), SKETCH), "sketch")
    classes = rows.where("n_shingles > 0 and id is not null").groupBy("h1", "h2")
    classes = classes.agg(F.min(F.struct("id", "body")).alias("row"), F.min("n_shingles").cast("int").alias("n"), F.min("digest").alias("digest"), F.min("sig").alias("sig"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    keys = classes.select("cls", "n", "digest", "sig").mapInArrow(index_keys, "key long, slot int, id long, n int, digest long")
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "keys")
    groups = materialize(keys.join(shared, "key").select("key", "slot", "members", "id", "n", "digest"), "groups")
    # the head of a key group is the member that meets most others over all its keys: of copies with edits, the original
    degree = groups.groupBy("id").agg(F.sum("members").alias("degree"))
    heads = groups.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"), "id", "n", "digest")).alias("head"))
    heads = materialize(heads, "heads")
    members = groups.join(heads, "key").where(F.col("id") != F.col("head.id"))

    x = F.col("digest").bitwiseXOR(F.col("head.digest"))
    differ = F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    alike = (F.least("n", "head.n") * 100 >= F.greatest("n", "head.n") * percent) & (differ <= MOST_DIGEST_ERRORS)
    stars = materialize(members.where(alike).groupBy(F.col("head.id").alias("head"), "id").agg(F.max("members").alias("members")), "stars")
    star_texts = bodies(texts, classes, stars.select(F.explode(F.array("head", "id")).alias("id")).distinct())
    edges = materialize(verified(stars, star_texts, shingle_words, percent), "links")
    release(stars)
    release(star_texts)
    comps = components(edges)

    # what the stars leave open: members other than the head that are in different components
    rest = members.where("members > 2").select("key", "slot", "id", "n").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    open_keys = materialize(rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"), "open-keys")
    rest = rest.join(open_keys, "key", "left_semi").join(classes.select(F.col("cls").alias("id"), "sig"), "id")
    rest = materialize(rest, "open")
    taking = block_pairs(rest, BLOCK, BLOCK * SHINGLE_BLOCK).groupBy("key", "x", "y").applyInArrow(with_partners(percent), "key long, id long").distinct()
    taking = materialize(taking, "taking")
    if not taking.isEmpty():
        rest_texts = bodies(texts, classes, taking.select("id").distinct())
        full = materialize(rest.join(taking, ["key", "id"], "left_semi"), "full")
        late = block_pairs(full, TEXT_BLOCK, SHINGLE_BLOCK).join(rest_texts, "id").groupBy("key", "x", "y").applyInArrow(leftover_links(shingle_words, percent), "u long, v long")
        late = materialize(late.distinct(), "late-links")
        release(rest_texts)
        release(full)
        known = comps
        comps = components(known.select(F.col("comp").alias("u"), F.col("id").alias("v")).unionByName(late))
        release(known)
        release(late)
    for table in (shared, groups, heads, edges, open_keys, rest, taking):
        release(table)

    settled = classes.select("h1", "h2", "row", F.col("cls").alias("id")).join(comps, "id", "left").select("h1", "h2", "row", F.coalesce("comp", "id").alias("comp"))
    settled = materialize(settled, "settled")
    first = materialize(settled.groupBy("comp").agg(F.min("row").alias("first")), "first")
    found = materialize(settled.join(first, "comp").select("h1", "h2", "row", "comp", "first"), "found")
    for table in (classes, comps, settled, first):
        release(table)
    return rows, found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id linked to it), kept (id is that smallest id).

    shingle_words: words in a shingle. percent: Jaccard similarity, in hundredths (80 or more), at which documents link.
    """
    rows, found = linked(docs, id_col, text_col, shingle_words, percent)
    able = F.coalesce((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.lit(False))
    some = rows.where(able).join(found, ["h1", "h2"]).select("id", "n_shingles", F.col("first.id").alias("component_id"))
    none = rows.where(~able).select("id", "n_shingles", F.col("id").alias("component_id"))
    return some.unionByName(none).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near-duplicates: of each group one row stays, one with the smallest id.

    Rows without words and rows with a null id stay. Rows are judged by id and text: of two texts under one id each has its own group."""
    _, found = linked(docs, id_col, text_col, shingle_words, percent)
    stay = found.select("first").distinct().select(F.col("first.id").alias("_cairnlake_id"), F.col("first.body").alias("_cairnlake_body"))
    body, own = F.xxhash64(F.col(text_col)), F.col(id_col).cast("long")
    able = F.coalesce(F.col(id_col).isNotNull() & F.col(text_col).rlike(WORD), F.lit(False))
    marked = docs.where(able).withColumn("_cairnlake_own", body)
    kept = marked.join(stay, (own == F.col("_cairnlake_id")) & (F.col("_cairnlake_own") == F.col("_cairnlake_body")), "left_semi")
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    once = Window.partitionBy(id_col, "_cairnlake_own").orderBy(F.xxhash64(*plain))
    kept = kept.withColumn("_cairnlake_nth", F.row_number().over(once)).where("_cairnlake_nth = 1").select(docs.columns)
    return kept.unionByName(docs.where(~able))


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract: four-word shingles, 80 percent."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=4, percent=80)
