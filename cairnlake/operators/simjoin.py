"""Exact set-similarity joins by prefix filtering, and ordered greedy suppression over their pairs.

Tokens are ordered with frequent ones last, by a table of bounded size from a bounded sample (any order gives the same result). Two sets with a Jaccard
similarity of t or more share one of their first n - ceil(t * n) + 1 tokens, their heads, and the more of these the nearer their sizes are. Heads are dealt into
blocks, as 32 bits a token; a task holds two blocks, counts the tokens that two heads share and keeps pairs with enough of them whose signatures are near
enough, so meetings of single tokens never leave a task. Full sets move only for rows of such pairs, to the tasks of their pairs, and decide there. A side of few rows goes
to every task instead, where one scan of the other side compares full sets. Rows with equal sets are one representative
in the join, so copies are not compared with each other.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Cells of the table of token frequencies (a byte each), and the rows that it is counted over, in expectation.
CELLS, SAMPLED = 1 << 20, 20_000
#: Tokens of a block of heads and of full sets, blocks at least if there are many rows, and the rows of a block that is worth it.
HEADS, SETS, LEAST_BLOCKS, FEW = 24 << 20, 8 << 20, 4, 2048
#: Pairs of a task that compares full sets, on average at most, and the rows of a cluster that stay in one block.
PAIRS, CLUSTER = 1 << 17, 256
#: Rows and tokens of a side that goes to every task.
SMALL_ROWS, SMALL_TOKENS = 5000, 1 << 20
#: Bytes of distinct tokens in a file of sets.
DICTIONARY = 1 << 25
#: Bits of the table of rows that have candidates, and rows whose full sets are compared at once.
WANTED, COMPARED = 1 << 22, 1024
#: How many times as many tokens as the rows have their pairs must have, for tokens to be numbered.
NUMBERED = 4
#: Tokens of heads that are looked up at once, meetings that are counted at once, and pairs whose signatures are compared at once.
LOOKED_UP, GATHERED, TESTED = 1 << 18, 1 << 20, 1 << 14
#: Bits of a row's signature: each token sets one, so a bit that only one of two rows has is a token that only this one has.
SIGNED = 1024
#: Rounds of joins before ``suppress`` walks what is left by components, and the pairs that a component may have for that.
FAST_ROUNDS, WALK_PAIRS = 4, 1_000_000


def token_set(tokens: Column, group: str | None) -> Column:
    """Sorted hashes of distinct tokens; those of different groups differ, so rows of different groups never share one."""
    grp = F.coalesce(group, F.lit("")) if group else F.lit("")
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t, grp))))


def token_classes(rows: DataFrame) -> np.ndarray:
    """How frequent tokens are, by the last bits of their hashes: an eighth of a power of two a class."""
    bits = F.col("tok").bitwiseAND(F.lit(CELLS - 1)).cast("int")
    share = min(1.0, SAMPLED / max(1, rows.select(F.lit(1)).count()))
    sample = rows.select("toks") if share == 1 else rows.where(F.rand(5) < share).select("toks")
    counted = sample.select(F.explode("toks").alias("tok")).groupBy(bits.alias("cell")).agg(F.count("*").alias("n"))
    out = np.zeros(CELLS, np.uint8)
    found = counted.toArrow()  # one number a cell at most
    out[found.column("cell").to_numpy()] = np.minimum(255, 8 + 8 * np.log2(found.column("n").to_numpy()))
    return out


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def signatures(flat: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    bits = np.zeros((n, SIGNED), bool)
    bits[row, (flat >> 32) & (SIGNED - 1)] = True
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * (SIGNED // 8)).astype(np.int32)), pa.py_buffer(np.packbits(bits, axis=1).tobytes())])


def heads(rows: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """(keys, n, head, sig): the sizes of sets, the first tokens of each in the common order, 32 bits of them, and signatures."""
    rarity = token_classes(rows)

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column("toks").offsets.to_numpy()).astype(np.int64)
            ends = np.cumsum(sizes)
            done = 0
            while done < batch.num_rows:  # pieces of a quarter million tokens bound the scratch arrays
                to = min(done + 4096, max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + (1 << 18), side="right"))))
                piece, n = batch.slice(done, to - done), sizes[done:to]
                flat = piece.column("toks").flatten().to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                sig = signatures(flat, row, len(n))
                flat = flat[np.lexsort((flat, rarity[flat & (CELLS - 1)], row))]
                place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                length = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
                head = (flat[place < length[row]] & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([*[piece.column(k) for k in keys], pa.array(n, pa.int32()), lists(head, length), sig], names=[*keys, "n", "head", "sig"])
                done = to

    kinds = dict(rows.dtypes)
    return rows.select(*keys, "toks").where(F.size("toks") > 0).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n int, head array<int>, sig binary")


def pair_place(x: Column, y: Column) -> Column:
    """Number of the task of two blocks."""
    high = F.greatest(x, y)
    return ((high * (high + 1) / 2).cast("int") + F.least(x, y)).cast("int")


def met(home: dict, guest: dict, same: bool, threshold: float, able):
    """Places (home, guest) of rows whose heads share as many tokens as the similarity asks for. Both in order of size: n, head (tokens), first (n + 1 offsets).

    Each pair is found from the smaller row's side, so that side is listed by its shorter beginning; of the same block the earlier row is the smaller one."""
    for h, g in led(home, guest, same, False, threshold):
        some = able(h, g)
        yield h[some], g[some]
    if not same:
        for g, h in led(guest, home, False, True, threshold):
            some = able(h, g)
            yield h[some], g[some]


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of runs that begin at start."""
    ends = np.cumsum(length)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if n < 1 << 31 and (not len(start) or int(start.max()) + n < 1 << 31) else np.int64
    out = np.arange(n, dtype=kind)
    out += np.repeat((start - ends + length).astype(kind), length)
    return out


def led(small: dict, large: dict, same: bool, less: bool, threshold: float):
    """Places (small, large) of rows, the first not larger than the second (with ``less``, smaller), that share enough tokens early.

    Sets of m <= n tokens with a similarity of t share a = t / (1 + t) * (m + n) tokens or more, and the first c of these stand among the first m - a + c and
    n - a + c. So a token counts only at such places, and rows of other sizes or places are not gathered. c is as large as the heads allow, up to a part of m:
    more tokens to share rule more pairs out, but stand later, where tokens are frequent."""
    share, low = threshold / (1 + threshold), np.uint64(0xFFFFFFFF)
    m, sizes = small["n"].astype(np.int64), large["n"].astype(np.int64)
    if not len(m) or not len(sizes):
        return
    part = 1 + np.floor(share * m / 4).astype(np.int64)
    length = np.minimum(np.diff(small["first"]), np.maximum(1, m - np.ceil(2 * share * m - 1e-9).astype(np.int64) + part))
    keys = small["head"][spread(small["first"][:-1], length)].astype(np.uint64)
    keys <<= np.uint64(32)
    keys |= np.repeat(np.arange(len(m), dtype=np.uint32), length)
    keys.sort()
    rows = (keys & low).astype(np.int32)
    least = np.searchsorted(m, threshold * sizes - 1e-9)
    end = np.minimum(np.searchsorted(m, sizes, side="left" if less else "right"), np.arange(len(sizes)) if same else len(m))
    upto = np.searchsorted(m, np.arange(m[-1] + 2), side="right")  # rows by size
    before = lambda size: upto[np.clip(np.floor(size), 0, m[-1]).astype(np.int64)]
    whole = np.ceil(threshold * sizes - 1e-9)
    # for each row of large, up to which row of small fewer tokens than those of a level are enough
    levels = np.array([1, 2, 3, 5, 9])
    steps = np.stack([before(np.maximum(4 * (c - 1) / share, (c - 2 + whole) / share - sizes) + 1e-6) for c in levels[1:]], axis=1)
    first, lo = large["first"], 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + LOOKED_UP, side="right")) - 1)
        k = np.diff(first[lo : hi + 1])
        border = np.append(0, np.cumsum(k))
        own = np.repeat(np.arange(lo, hi), k)
        # a place counts if it is under n - share * (m + n) + part
        place = np.arange(len(own)) - np.repeat(border[:-1], k)
        top = np.minimum(end[own], before(((1 - share) * sizes[own] - place + 1e-6) / (0.75 * share)))
        token = (large["head"][first[lo] : first[hi]].astype(np.uint64) << np.uint64(32)) | np.arange(len(own), dtype=np.uint64)
        token.sort()  # neighbours are looked up after each other
        order = (token & low).astype(np.int64)
        token &= ~low
        begin, length = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
        begin[order] = np.searchsorted(keys, token | least[own[order]].astype(np.uint64))
        length[order] = np.searchsorted(keys, token | top[order].astype(np.uint64))
        length = np.maximum(0, length - begin)
        total = np.append(0, np.cumsum(length))[border]
        g = lo
        while g < hi:
            to = max(g + 1, lo + int(np.searchsorted(total, total[g - lo] + GATHERED, side="right")) - 1)
            s, n = (x[border[g - lo] : border[to - lo]] for x in (begin, length))
            base = np.arange(to - g) * len(m)
            kind = np.uint32 if (to - g) * len(m) < 1 << 32 else np.int64
            pair = rows[spread(s, n)].astype(kind)
            pair += np.repeat(base.astype(kind), np.diff(total[g - lo : to - lo + 1]))
            pair, shared = tallied(pair, (to - g) * len(m))
            edges = np.maximum.accumulate(np.column_stack([base, base[:, None] + steps[g:to], base + len(m)]), axis=1).ravel()
            # a first look by levels, as most pairs share very few tokens
            some = np.flatnonzero(shared >= np.repeat(np.tile(np.append(levels, 1), to - g), np.diff(np.append(np.searchsorted(pair, edges.astype(kind)), len(pair)))))
            pair, shared = pair[some].astype(np.int64), shared[some]
            row, mine = pair % len(m), g + pair // len(m)
            need = np.minimum(part[row], np.ceil(share * (m[row] + sizes[mine]) - 1e-9) - whole[mine] + 1)
            some = np.flatnonzero(shared >= np.maximum(1, need))
            for piece in range(0, len(some), TESTED):
                yield row[some[piece : piece + TESTED]], mine[some[piece : piece + TESTED]]
            g = to
        lo = hi


def tallied(values: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values below ``cells``, sorted, and how often they occur: by cells if many are met, by sorting otherwise."""
    if cells <= 4 * len(values):
        counts = np.bincount(values)
        found = np.flatnonzero(counts)
        return found.astype(values.dtype), counts[found]
    values.sort()
    edge = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[edge], np.diff(np.append(edge, len(values)))


def candidates(compact: DataFrame, threshold: float, flag: str | None = None, differ: bool = False) -> DataFrame:
    """(a, b, na, nb), each pair once, that the heads allow. compact: id, n, head, sig[, flag]. Pairs with the flag on both rows are not compared;
    with ``differ`` those whose flags differ are, and a is the one with it not set."""
    compact = written(compact)
    size = compact.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("head")), F.lit(0)).alias("tokens")).first()
    blocks = max(-(-size["tokens"] // HEADS), min(LEAST_BLOCKS, -(-size["n"] // FEW)), 1)
    kind = dict(compact.dtypes)["id"]
    dealt = compact.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("place", pair_place(F.col("blk"), F.col("_with")))

    def run(batches):
        parts: dict[int, list] = {}
        place = None
        for batch in batches:
            blk, place = batch.column("blk").to_numpy(), batch.column("place")[0].as_py() if batch.num_rows else place
            for b in np.unique(blk):
                mine = batch.filter(pa.array(blk == b))
                head = mine.column("head")
                # copies, so that no batch is held as a whole
                parts.setdefault(int(b), []).append((mine.column("id"), mine.column("n").to_numpy(), head.flatten().to_numpy().view(np.uint32).copy(), np.diff(head.offsets.to_numpy()), np.frombuffer(b"".join(mine.column("sig").to_pylist()), np.uint64).reshape(-1, SIGNED // 64), mine.column("flag").to_numpy(zero_copy_only=False)))
        high = int((np.sqrt(8 * place + 1) - 1) // 2) if place is not None else 0
        same = place is not None and place - high * (high + 1) // 2 == high
        if place is None or len(parts) < (1 if same else 2):
            return
        sides = []
        for b in sorted(parts):
            pieces = parts.pop(b)
            ids, n, length, sig, flags = (pa.concat_arrays([p[0] for p in pieces]), *(np.concatenate([p[k] for p in pieces]) for k in (1, 3, 4, 5)))
            order = np.argsort(n, kind="stable")
            first, took = np.cumsum(length, dtype=np.int64) - length, length[order]
            head = np.concatenate([p[2] for p in pieces])
            del pieces
            head = head[spread(first[order], took)]
            sides.append({"id": ids.take(pa.array(order)), "n": n[order], "head": head, "first": np.append(0, np.cumsum(took, dtype=np.int64)), "sig": sig[order], "flag": flags[order].astype(bool)})
            del ids, n, length, sig, flags
        home, guest = sides[0], sides[-1]

        def able(h: np.ndarray, g: np.ndarray) -> np.ndarray:
            meet = (home["flag"][h] != guest["flag"][g]) if differ else ~(home["flag"][h] & guest["flag"][g])
            mine, theirs, n, m = home["sig"][h], guest["sig"][g], home["n"][h], guest["n"][g]
            most = np.minimum(n - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64), m - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64))
            return meet & (most >= np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9))

        for h, g in met(home, guest, same, threshold, able):
            if not len(h):
                continue
            x, y, nx, ny = home["id"].take(pa.array(h)), guest["id"].take(pa.array(g)), home["n"][h], guest["n"][g]
            yield pa.RecordBatch.from_arrays([x, y, pa.array(nx, pa.int32()), pa.array(ny, pa.int32()), pa.array(guest["flag"][g])], names=["a", "b", "na", "nb", "flag"])

    dealt = dealt.select("id", "n", "head", "sig", (F.coalesce(flag, F.lit(False)) if flag else F.lit(False)).alias("flag"), "blk", "place")
    tasks = blocks * (blocks + 1) // 2
    found = dealt.repartitionById(tasks, "place").mapInArrow(run, f"a {kind}, b {kind}, na int, nb int, flag boolean")
    turn = ~F.col("flag") if differ else F.col("a") > F.col("b")
    swapped = [F.when(turn, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"))]
    return written(found.select(*swapped))


def confirmed(cands: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) of candidates that reach the threshold. sets: id, toks (sorted) of all rows, of which those without a candidate do not move.

    Pairs go to tasks by the smallest ids beside their rows, so pairs of one cluster meet in few tasks; rows of a large cluster are dealt over several
    blocks. Blocks are at least as many as the pairs ask for."""
    kind = dict(cands.dtypes)["a"]
    ends = cands.select("a", "b", "na").unionByName(cands.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na")))
    near = written(ends.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label"), F.first("na").alias("n")))
    size = near.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    asked = cands.count()
    blocks = max(-(-size["tokens"] // SETS), min(LEAST_BLOCKS, -(-size["n"] // FEW)), int(np.ceil(np.sqrt(2 * asked / PAIRS))), 1)
    bit = F.pmod(F.xxhash64("id"), F.lit(WANTED)).cast("int")
    wanted = np.zeros(WANTED, bool)
    wanted[near.select(bit.alias("bit")).distinct().toArrow().column("bit").to_numpy()] = True
    names = sets.select("id", "toks").schema

    def kept(batches):
        for batch in batches:
            yield batch.filter(pa.array(wanted[batch.column("bit").to_numpy()])).select(["id", "toks"])

    large = near.groupBy("label").agg(F.count("*").alias("k")).where(F.col("k") > CLUSTER)
    cut = F.pmod(F.xxhash64(F.lit(5), "id"), F.ceil(F.coalesce("k", F.lit(1)) / CLUSTER))
    blk = near.join(large, "label", "left").select("id", F.pmod(F.xxhash64("label", cut), F.lit(blocks)).cast("int").alias("blk"))
    placed = cands.select("a", "b").join(blk.withColumnRenamed("id", "a").withColumnRenamed("blk", "x"), "a").join(blk.withColumnRenamed("id", "b").withColumnRenamed("blk", "y"), "b")
    placed = written(placed.select("a", "b", pair_place(F.col("x"), F.col("y")).alias("place")))
    goes = placed.select(F.explode(F.array("a", "b")).alias("id"), "place").distinct()
    rows = sets.select("id", "toks").withColumn("bit", bit).mapInArrow(kept, names).join(goes, "id")
    none = F.lit(None)
    both = rows.select("place", "id", "toks", none.cast(kind).alias("other")).unionByName(placed.select("place", F.col("a").alias("id"), none.cast("array<bigint>").alias("toks"), F.col("b").alias("other")))

    def run(batches):
        tokens, ids, asked = [], [], []
        for batch in batches:
            row = batch.column("toks").is_valid()
            mine, pairs = batch.filter(row), batch.filter(batch.column("toks").is_null())
            ids.append(mine.column("id"))
            tokens.append((mine.column("toks").flatten().to_numpy(), np.diff(mine.column("toks").offsets.to_numpy())))
            asked.append(pairs.select(["id", "other"]))
        if not ids:
            return
        ids = pa.concat_arrays(ids)
        flat, length = (np.concatenate(c) for c in zip(*tokens))
        first = np.concatenate([[0], np.cumsum(length)])
        asked = pa.Table.from_batches(asked)
        if not asked.num_rows:
            return
        place = lambda c: pa.compute.index_in(asked.column(c).combine_chunks(), ids).to_numpy(zero_copy_only=False).astype(np.int64)
        a, b = place("id"), place("other")
        order = np.argsort(a, kind="stable")
        border = np.flatnonzero(np.r_[True, np.diff(a[order]) != 0, True])
        # many pairs of the rows: tokens are numbered once, and a row is a table of those that it has
        marks = None
        if length[b].sum(dtype=np.int64) > NUMBERED * len(flat):
            flat, marks = numbered(flat)
        for lo, hi in zip(border[:-1], border[1:]):
            some = order[lo:hi]
            mine = flat[first[a[some[0]]] : first[a[some[0]] + 1]]
            if marks is not None:
                marks[mine] = True
            for at in range(0, len(some), COMPARED):
                part = some[at : at + COMPARED]
                k = length[b[part]].astype(np.int64)
                theirs = flat[spread(first[b[part]], k)]
                there = marks[theirs] if marks is not None else mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                common = np.add.reduceat(there.astype(np.int64), np.cumsum(k) - k)
                sim = common / (len(mine) + k - common)
                hit = sim >= threshold
                if hit.any():
                    taken = asked.take(pa.array(part[hit])).combine_chunks()
                    yield pa.RecordBatch.from_arrays([taken.column("id").combine_chunks(), taken.column("other").combine_chunks(), pa.array(sim[hit])], names=["a", "b", "sim"])
            if marks is not None:
                marks[mine] = False

    tasks = blocks * (blocks + 1) // 2
    return both.repartitionById(tasks, "place").mapInArrow(run, f"a {kind}, b {kind}, sim double")


def numbered(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens as numbers from 0, and a table of that many marks."""
    known = np.unique(flat)
    out = np.empty(len(flat), np.int32)
    for lo in range(0, len(flat), 1 << 20):
        out[lo : lo + (1 << 20)] = np.searchsorted(known, flat[lo : lo + (1 << 20)])
    return out, np.zeros(len(known), bool)


def similar_pairs(sets: DataFrame, compact: DataFrame, threshold: float, flag: str | None = None, differ: bool = False) -> DataFrame:
    """(a, b, sim), a < b, of all representatives with sim >= threshold. sets: id, toks; compact: the ``heads`` of representatives.

    Rows that both have the flag are not compared. With ``differ``, rows of two sides are: a without the flag, b with it (a < b is not asked for)."""
    return confirmed(candidates(compact, threshold, flag, differ), sets, threshold)


def hashes(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"h1": F.xxhash64("toks"), "h2": F.xxhash64(F.lit(7), "toks")})


def self_join(df: DataFrame, tokens: Column, threshold: float, id_col: str, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives, members): pairs a, b, sim; members id, rep. Members of one rep have similarity 1.

    A representative is the smallest id with the same set (and group), found from hashes alone."""
    rows = written(df.select(F.col(id_col).alias("id"), token_set(tokens, group).alias("toks")), DICTIONARY)
    compact = written(heads(hashes(rows), threshold, ["id", "h1", "h2"]))
    narrow = compact.select("id", "h1", "h2")
    members = written(narrow.join(narrow.groupBy("h1", "h2").agg(F.min("id").alias("rep")), ["h1", "h2"]).select("id", "rep"))
    first = members.where("id = rep").select("id")
    reps = compact.join(first, "id", "left_semi").dropDuplicates(["id"]).select("id", "n", "head", "sig")
    return similar_pairs(rows, reps, threshold), members


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of representatives as pairs of their members (a < b)."""
    m = members.withColumnRenamed("rep", "r")
    out = pairs.join(m.select(F.col("r").alias("a"), F.col("id").alias("x")), "a").join(m.select(F.col("r").alias("b"), F.col("id").alias("y")), "b")
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sim")


def counted(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of representatives with ``n``, how many pairs of members ``expand`` makes of each."""
    sizes = members.groupBy("rep").agg(F.count("*").alias("k"))
    both = pairs.join(sizes.select(F.col("rep").alias("a"), F.col("k").alias("_ka")), "a").join(sizes.select(F.col("rep").alias("b"), F.col("k").alias("_kb")), "b")
    return both.withColumn("n", F.col("_ka") * F.col("_kb")).drop("_ka", "_kb")


def scanned(left: DataFrame, items: list, threshold: float, kind: str) -> DataFrame:
    """(a, b, sim) of left rows (id, toks) and items (id, toks) by one scan: every row meets every item that shares a token."""
    ids = [r["id"] for r in items]
    size = np.array([len(r["toks"]) for r in items], np.int64)
    flat = np.array([t for r in items for t in r["toks"]], np.int64)
    order = np.argsort(flat, kind="stable")
    item = np.repeat(np.arange(len(items)), size)[order]
    token, begin = np.unique(flat[order], return_index=True)
    begin = np.append(begin, len(flat))

    def run(batches):
        names = pa.array(ids)
        step = max(1, (1 << 20) // len(ids))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                n = np.diff(part.column("toks").offsets.to_numpy()).astype(np.int64)
                mine = part.column("toks").flatten().to_numpy()
                at = np.minimum(np.searchsorted(token, mine), len(token) - 1)
                known = np.flatnonzero(token[at] == mine)
                row = np.repeat(np.arange(len(n)), n)[known]
                s, k = begin[at[known]], begin[at[known] + 1] - begin[at[known]]
                where = np.repeat(s - np.cumsum(k) + k, k) + np.arange(k.sum())
                common = np.bincount(np.repeat(row, k) * len(ids) + item[where], minlength=len(n) * len(ids)).reshape(len(n), len(ids))
                i, j = np.nonzero(common)
                sim = common[i, j] / (n[i] + size[j] - common[i, j])
                hit = sim >= threshold
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(i[hit])), names.take(pa.array(j[hit])), pa.array(sim[hit])], names=["a", "b", "sim"])

    return left.select("id", "toks").where(F.size("toks") > 0).mapInArrow(run, f"a {dict(left.dtypes)['id']}, b {kind}, sim double")


def between(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim), a of left and b of right, with sim >= threshold; both: id, toks (sorted). A right side of few rows is held against one scan of the left."""
    full = right.where(F.size("toks") > 0)
    kind = dict(right.dtypes)["id"]
    short = full.select("id", F.size("toks").alias("n")).limit(SMALL_ROWS + 1).agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    if not short["rows"]:
        return left.sparkSession.createDataFrame([], f"a {dict(left.dtypes)['id']}, b {kind}, sim double")
    if short["rows"] <= SMALL_ROWS and short["tokens"] <= SMALL_TOKENS:
        return scanned(left, full.collect(), threshold, kind)
    return wide(left, full, threshold)


def wide(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``between`` of two large sides. Equal sets of a side are one row of the join."""
    # ids are texts that begin with a letter of the side
    side = lambda df, flag: df.select(F.concat(F.lit("r" if flag else "l"), F.col("id").cast("string")).alias("id"), "toks", F.lit(flag).alias("side"))
    rows = written(side(left, False).unionByName(side(right, True)), DICTIONARY)
    compact = written(heads(hashes(rows), threshold, ["id", "side", "h1", "h2"]))
    narrow = compact.select("id", "side", "h1", "h2")
    members = written(narrow.join(narrow.groupBy("side", "h1", "h2").agg(F.min("id").alias("rep")), ["side", "h1", "h2"]).select("id", "rep"))
    reps = compact.join(members.where("id = rep").select("id"), "id", "left_semi").dropDuplicates(["id"]).select("id", "n", "head", "sig", "side")
    pairs = similar_pairs(rows, reps, threshold, "side", differ=True)
    out = pairs.join(members.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b")
    back = lambda c, df: F.substring(c, 2, 1 << 30).cast(dict(df.dtypes)["id"])
    return out.select(back("x", left).alias("a"), back("y", right).alias("b"), "sim")


def best_match(left: DataFrame, left_tokens: Column, left_id: str, right: DataFrame, right_tokens: Column, right_id: str, threshold: float, group: str | None = None) -> DataFrame:
    """(left id, right id, sim): the most similar right row of each left row, ties to the smaller id."""
    lefts = left.select(F.col(left_id).alias("id"), token_set(left_tokens, group).alias("toks"))
    rights = right.select(F.col(right_id).alias("id"), token_set(right_tokens, group).alias("toks"))
    best = between(lefts, rights, threshold).groupBy("a").agg(F.min(F.struct((-F.col("sim")).alias("m"), "b")).alias("x"))
    return best.select(F.col("a").alias("left_id"), F.col("x.b").alias("right_id"), (-F.col("x.m")).alias("sim"))


def walked(pairs: DataFrame) -> DataFrame:
    """(id, state), kept or gone, by a walk in order of rank over each component. pairs: comp, lo, hi, rlo, rhi; a component fits a task."""

    def walk(group: pa.Table) -> pa.Table:
        rank: dict = {}
        better: dict = {}
        for lo, hi, rlo, rhi in zip(*(group.column(c).to_pylist() for c in ("lo", "hi", "rlo", "rhi"))):
            rank[lo], rank[hi] = rlo, rhi
            better.setdefault(hi, []).append(lo)
        state: dict = {}
        for x in sorted(rank, key=rank.get):
            state[x] = "gone" if any(state.get(y) == "kept" for y in better.get(x, ())) else "kept"
        return pa.table({"id": pa.array(list(state), group.schema.field("lo").type), "state": pa.array(list(state.values()), pa.string())})

    return pairs.groupBy("comp").applyInArrow(walk, f"id {dict(pairs.dtypes)['lo']}, state string")


def suppress(rows: DataFrame, pairs: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, rank, kept): a row is kept if no kept row of smaller rank conflicts with it, or if it is forced.

    rows: id, rank, forced. pairs: a, b (any order). Only rows that have a pair take part: in each round,
    rows without an undecided smaller neighbour are kept, and their larger neighbours go. After FAST_ROUNDS, what is left
    (long chains) is walked by connected components, each in one task; rounds go on for components of more than WALK_PAIRS
    pairs until all rows are decided. With a limit of rounds, running out of it is an error."""
    from .graph import connected

    r = rows.select("id", "rank", F.coalesce("forced", F.lit(False)).alias("forced"))
    p = pairs.select("a", "b").join(r.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(r.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b").where("a <> b")
    first = F.col("ra") < F.col("rb")
    side = lambda a, b, name: F.when(first, F.col(a)).otherwise(F.col(b)).alias(name)
    p = written(p.select(side("a", "b", "lo"), side("b", "a", "hi"), side("ra", "rb", "rlo"), side("rb", "ra", "rhi")).distinct())
    ends = p.select(F.explode(F.array("lo", "hi")).alias("id")).distinct()
    state = written(ends.join(r, "id").select("id", F.when(F.col("forced"), "new").otherwise("open").alias("state"), "forced"))
    for done in count():
        if done == rounds:
            raise RuntimeError(f"rows are still undecided after {rounds} rounds")
        # larger neighbours of rows kept in the last round go, unless they are forced
        news = state.where("state = 'new'").select(F.col("id").alias("lo"))
        gone = p.join(news, "lo").select(F.col("hi").alias("id")).distinct().withColumn("_gone", F.lit(True))
        state = state.join(gone, "id", "left").select("id", F.when((F.col("state") == "open") & F.col("_gone"), "gone").when(F.col("state") == "new", "kept").otherwise(F.col("state")).alias("state"), "forced")
        if done == FAST_ROUNDS:
            state = written(state)
            still = state.where("state = 'open'").select("id")
            left = written(p.join(still.withColumnRenamed("id", "lo"), "lo", "left_semi").join(still.withColumnRenamed("id", "hi"), "hi", "left_semi"))
            comps = written(connected(left.select(F.col("lo").alias("u"), F.col("hi").alias("v"))))
            left = left.join(comps.withColumnRenamed("id", "lo"), "lo")
            small = left.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") <= WALK_PAIRS).select("comp")
            solved = walked(left.join(small, "comp", "left_semi")).withColumnRenamed("state", "_walked")
            state = state.join(solved, "id", "left").select("id", F.coalesce("_walked", "state").alias("state"), "forced")
        still = state.where("state = 'open'").select(F.col("id").alias("lo"))
        blocked = p.join(still, "lo").select(F.col("hi").alias("id")).distinct().withColumn("_blocked", F.lit(True))
        state = written(state.join(blocked, "id", "left").select("id", F.when((F.col("state") == "open") & F.col("_blocked").isNull(), "new").otherwise(F.col("state")).alias("state"), "forced"))
        if state.where("state = 'new'").isEmpty():
            break
    return r.join(state.select("id", "state"), "id", "left").select("id", "rank", F.coalesce(F.col("state") != "gone", F.lit(True)).alias("kept"))
