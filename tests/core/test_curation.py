"""Cosine joins against all pairs, curation by vectors and words, conflicts against the greedy loop, merges of many candidates."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake import memory
from cairnlake.functions import text
from cairnlake.operators import cosjoin, curate

NOW = datetime(2024, 2, 1)
ROW = "id long, content string, scope string, embedding array<double>"


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or not any(a) or not any(b):
        return 0.0
    return max(-1.0, min(1.0, float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))))


def jaccard(a, b):
    a, b = set((a or "").lower().split()), set((b or "").lower().split())
    return len(a & b) / len(a | b) if a and b else 0.0


def near(x, y):
    return cosine(x[3], y[3]) if x[3] is not None and y[3] is not None else jaccard(x[1], y[1])


def vectors(rng, n, dims, middles, spread):
    m = rng.normal(size=(middles, dims))
    return m[rng.integers(0, middles, n)] + rng.normal(size=(n, dims)) * spread


@pytest.mark.parametrize(("middles", "spread", "threshold"), [(12, 0.15, 0.9), (12, 0.5, 0.7), (300, 1.0, 0.45), (5, 0.02, 0.999)])
def test_cosine_pairs_are_exact(spark, monkeypatch, middles, spread, threshold):
    """Clustered and loose vectors, two groups, two lengths, many cells and blocks."""
    monkeypatch.setattr(cosjoin, "BLOCK", 40)
    monkeypatch.setattr(cosjoin, "VISITORS", 2)
    rng = np.random.default_rng(middles)
    rows = [(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(vectors(rng, 500, 16, middles, spread))]
    rows += [(500 + i, "a", v.tolist()) for i, v in enumerate(vectors(rng, 60, 5, 3, spread))]
    rows += [(600, "a", None), (601, "a", [0.0] * 16), (602, "a", []), (603, "a", [float("nan")] * 16), (604, None, rows[0][2]), (605, None, rows[0][2])]
    df = spark.createDataFrame(rows, "id long, grp string, v array<double>").repartition(4)
    got = {(r.a, r.b): r.sim for r in cosjoin.cosine_pairs(df, threshold).collect()}
    expected = {(a[0], b[0]): cosine(a[2], b[2]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[1] == b[1] and cosine(a[2], b[2]) >= threshold and a[0] != 603 and b[0] != 603}
    assert set(got) == set(expected) and len(expected) > 3
    assert all(abs(got[p] - s) < 1e-9 for p, s in expected.items())


def test_cosine_join_compares_few_pairs(spark, monkeypatch):
    """Of clustered vectors few pairs come together; of loose ones the bound over leading directions rules most out."""
    monkeypatch.setattr(cosjoin, "BLOCK", 100)
    rng = np.random.default_rng(1)
    n = 1200
    for middles, spread, threshold, share in ((30, 0.1, 0.9, 0.06), (n, 0.0, 0.9, 0.05)):
        df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(vectors(rng, n, 64, middles, spread))], "id long, grp string, v array<double>")
        assert cosjoin.cosine_pairs(df, threshold, counted=True).first().n_compared < share * n * (n - 1) / 2
    with pytest.raises(ValueError):
        cosjoin.cosine_pairs(df, 0.0)
    assert cosjoin.cosine_pairs(df.limit(0), 0.5).collect() == []


def test_cosines_of_a_task_need_bounded_memory():
    """All pairs of a full task reach the threshold: scratch arrays stay far below a row of each side for every pair."""
    import tracemalloc

    rng = np.random.default_rng(2)
    v = rng.normal(size=(6000, 64)) * 0.1 + np.eye(64)[0] * 3
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tracemalloc.start()
    found = sum(len(piece[0]) for piece in cosjoin.compared(v[:500], v, 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 500 * 6000 and peak < 100e6  # every pair's rows at once would be 3 GB
    few = [p for p in cosjoin.compared(v[:500], -v, 0.5)]
    assert not sum(len(p[0]) for p in few)


def mixed_rows(seed, n=120):
    """Near copies by words, by vector and by both; rows without one or the other."""
    rng = random.Random(seed)
    nrng = np.random.default_rng(seed)
    v = vectors(nrng, n, 8, 10, 0.15)
    words = [f"w{i}" for i in range(40)] + ["not", "always", "never"]
    rows = []
    for i in range(n):
        base = rows[rng.randrange(len(rows))][1] if rows and rng.random() < 0.6 else None
        content = " ".join(w if rng.random() > 0.12 else rng.choice(words) for w in base.split()) if base else " ".join(rng.choice(words) for _ in range(rng.randint(4, 14)))
        rows.append((i, content, rng.choice(["global", "project:x"]), v[i].tolist() if rng.random() < 0.5 else None))
    rows += [(n + 1, rows[3][1], "global", rows[3][3]), (n + 2, rows[3][1].upper(), "global", rows[3][3]), (n + 3, "", "global", None), (n + 4, None, "global", [0.0] * 8), (n + 5, None, "global", [0.0] * 8), (n + 6, rows[5][1], None, None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_curation_by_vectors_or_words(spark, seed):
    rows = mixed_rows(seed)
    df = spark.createDataFrame(rows, ROW)
    for threshold in (0.6, 0.9):
        got = {r.cand_id: (r.action, r.target_id) for r in curate.curate_in_order(df, "id", threshold, "scope", "embedding").collect()}
        for i, x in enumerate(rows):
            if not (x[1] or "").strip():
                assert got[x[0]] == ("skip", None)
                continue
            found = [(-near(x, y), y[0]) for y in rows[:i] if (y[2] or "") == (x[2] or "") and (y[1] or "").strip() and near(x, y) >= threshold - 1e-12]
            best = min((round(s, 9), k) for s, k in found) if found else None
            assert got[x[0]] == (("merge", best[1]) if best else ("add", None)), (x, found)


def walk(rows, like, similarity=0.9, redundant=0.95, low=0.5, high=0.8):
    """The loop over ordered pairs: roles and conflicts."""
    taken, conflicts = {}, set()
    for i, x in enumerate(rows):
        if x[0] in taken:
            continue
        for y in rows[i + 1 :]:
            if y[0] in taken:
                continue
            s = like(x, y)
            if s >= similarity:
                taken[y[0]] = (x[0], "redundant" if s >= redundant else "member")
            if low <= s < high:
                conflicts |= {(x[0], y[0], kind) for kind in kinds(x[1] or "", y[1] or "")}
    return {x[0]: taken.get(x[0], (x[0], "kept")) for x in rows}, conflicts


def kinds(a, b):
    a, b = ([w.rstrip(text.PUNCTUATION) for w in t.lower().split()] for t in (a, b))
    if any(w in text.NEGATIONS for w in a) != any(w in text.NEGATIONS for w in b):
        yield "negation"
    if any((p in a and q in b) or (q in a and p in b) for p, q in text.ANTONYMS):
        yield "contradiction"


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_conflicts_of_a_consolidation_follow_the_walk(spark, seed):
    rows = mixed_rows(seed)
    df = spark.createDataFrame(rows, ROW)
    met = 0
    for vector_col, like in ((None, lambda x, y: jaccard(x[1], y[1])), ("embedding", near)):
        roles, found = curate.consolidation(df, "id", similarity=0.7, low=0.3, high=0.6, vector_col=vector_col)
        expected_roles, expected = walk(rows, like, 0.7, 0.95, 0.3, 0.6)
        got = {r.id: (r.seed, r.role) for r in roles.collect()}
        assert all(got.get(i, (i, "kept")) == role for i, role in expected_roles.items())
        conflicts = [(r.a, r.b, r.kind) for r in found.collect()]
        assert len(conflicts) == len(set(conflicts)) and set(conflicts) == expected
        met += len(expected)
    assert met > 20


def test_every_candidate_of_a_record_is_merged(spark, tmp_path):
    m = memory.Memory(spark, str(tmp_path / "store"))
    base = " ".join(f"w{i}" for i in range(19))
    schema = "content string, scope string, tags array<string>, instructivity_score double"
    m.add_records(spark.createDataFrame([(base + " end", "global", ["base"], 50.0)], schema), NOW)
    three = [(" ".join([f"w{i}" for i in range(19) if i != n] + ["end", f"x{n}"]), "global", [f"t{n}", "all"], 40.0 + 10 * n) for n in range(3)]
    plan = m.add_records(spark.createDataFrame(three, schema), NOW)
    assert [r.action for r in plan.collect()] == ["merge"] * 3
    record = m.get_all().collect()
    assert len(record) == 1 and set(record[0].tags) == {"base", "t0", "t1", "t2", "all"}
    assert (record[0].content, record[0].instructivity_score) == (three[2][0], 60.0)


def test_merges_fold_in_order(spark):
    """As folding keep_best over the candidates one by one."""
    rng = random.Random(8)
    text_of = lambda: rng.choice(["", "  ", "aa", "bbb", "cccc", "dd"])
    tags = lambda: rng.sample("abcdef", rng.randint(0, 3))
    old = [(f"r{i}", text_of(), rng.choice([1.0, 2.0, 3.0, None]), tags()) for i in range(12)]
    cands = [(f"c{i:03d}", text_of(), rng.choice([1.0, 2.0, 3.0]), tags()) for i in range(60)]
    hits = [(c[0], f"r{rng.randrange(10)}") for c in cands]
    made = lambda rows, key: spark.createDataFrame(rows, f"{key} string, content string, score double, tags array<string>")
    out = curate.merged_into(made(old, "target_id"), made(cands, "cand_id"), spark.createDataFrame(hits, "cand_id string, target_id string"))
    got = {r.target_id: (r.content, r.instructivity_score, r.tags) for r in out.collect()}
    expected = {}
    for key, content, points, own in old:
        state = (content, points or 0.0, list(dict.fromkeys(own)))
        mine = sorted(c for c, t in hits if t == key)
        for c in (next(x for x in cands if x[0] == k) for k in mine):
            full, theirs = bool(state[0].strip()), bool(c[1].strip())
            takes = theirs if full != theirs else (c[2], len(c[1])) > (state[1], len(state[0]))
            both = c[3] + state[2] if takes else state[2] + c[3]
            state = ((c[1], c[2]) if takes else state[:2]) + (list(dict.fromkeys(both)),)
        if mine:
            expected[key] = state
    assert got == expected


def test_hybrid_classes_do_not_expand_copies(spark):
    """Hundreds of equal rows are one representative."""
    rows = [(i, "same words here", "global", [1.0, 2.0]) for i in range(300)] + [(300, "same words here", "global", None)]
    pairs, members = cosjoin.hybrid_pairs(spark.createDataFrame(rows, ROW), text.word_set(F.col("content")), 0.9, "id", "scope")
    assert [(r.a, r.b, r.sim) for r in pairs.collect()] == [(0, 300, 1.0)] and members.where("rep = 0").count() == 300
