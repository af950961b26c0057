import json
import math
import os
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake import memory
from cairnlake.__main__ import main
from cairnlake.functions import privacy, text
from cairnlake.operators import aggregates, curate, federate, graph, llmio, mine, search, simjoin, team, topics, verify
from cairnlake.sources import store
from cairnlake.sources.scratch import written
from cairnlake.streaming import idle, inbox

NOW = datetime(2024, 2, 1)
def at():
    return F.lit(NOW).cast("timestamp")


def jac(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(80):
        base = rows[rng.randrange(len(rows))][1].split() if rows and rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 14))]
        base = [w if rng.random() > 0.08 else rng.choice(words) for w in base]
        rows.append((i, " ".join(base), rng.choice(["global", "project:x"])))
    return rows + [(80, "", "global"), (81, None, "global"), (82, "W1  w2", "global"), (83, "w2 w1", "global")]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 0.95, 1.0])
def test_similarity_join_is_exact(spark, corpus, threshold):
    df = spark.createDataFrame(corpus, "id long, content string, scope string")
    pairs, members = simjoin.self_join(df, text.word_set(F.coalesce("content", F.lit(""))), threshold, "id", "scope")
    rep = {r.id: r.rep for r in members.collect()}
    got = {(r.a, r.b): r.sim for r in simjoin.expand(pairs, members).collect()}
    for i, x, s in corpus:
        for j, y, t in corpus:
            if i < j and s == t:
                sim = jac(x or "", y or "")
                if sim == 1.0:
                    assert rep[i] == rep[j]
                elif sim >= threshold:
                    assert got.pop((i, j)) == pytest.approx(sim)
    assert not got


def walk(rows, near, forced=()):
    """The ordered walk by the book: ids in order, a row goes if a kept one conflicts with it."""
    kept = []
    for i in rows:
        if i in forced or not any(near(k, i) for k in kept):
            kept.append(i)
    return kept


def test_suppression_follows_the_walk(spark):
    rng = random.Random(3)
    for trial in range(4):
        n = 30
        pairs = {(a, b) for a in range(n) for b in range(a) if rng.random() < 0.12}
        rank = list(range(n))
        rng.shuffle(rank)
        forced = set(rng.sample(range(n), 3))
        order = sorted(range(n), key=lambda i: rank[i])
        want = walk(order, lambda a, b: (a, b) in pairs or (b, a) in pairs, forced)
        rows = spark.createDataFrame([(i, rank[i], i in forced) for i in range(n)], "id long, rank int, forced boolean")
        got = simjoin.suppress(rows, spark.createDataFrame(list(pairs), "a long, b long"))
        assert {r.id for r in got.where("kept").collect()} == set(want)


def test_consolidation_follows_the_walk(spark, corpus):
    rows = [(i, t) for i, t, _ in corpus if t]
    got = {r.id: (r.seed, r.role) for r in curate.consolidate(spark.createDataFrame(rows, "id long, content string"), "id", 0.7, 0.9).collect()}
    grouped, want, compared = {}, {}, 0
    for i, x in rows:
        if i in grouped:
            continue
        want[i] = (i, "kept")
        for j, y in rows:
            if j > i and j not in grouped:
                compared += 1
                sim = jac(x, y)
                if sim >= 0.7:
                    grouped[j] = i
                    want[j] = (i, "redundant" if sim >= 0.9 else "member")
    assert got == want
    roles = spark.createDataFrame([(i, s, r) for i, (s, r) in got.items()], "id long, seed long, role string")
    assert curate.pairs_compared(spark.createDataFrame([(i,) for i, _ in rows], "id long"), roles).first()[0] == compared


def test_curate(spark):
    cands = spark.createDataFrame([(1, "a b c d e f g h i j", "global"), (2, "new thing", "global"), (3, " ", "global"), (4, "a b c d e f g h i j", "other")], "cand_id long, content string, scope string")
    have = spark.createDataFrame([(10, "a b c d e f g h i j k", "global"), (11, "a b c d e f g h i j", "global")], "bullet_key long, content string, scope string")
    assert {r.cand_id: (r.action, r.target_id) for r in curate.curate(cands, have).collect()} == {1: ("merge", 11), 2: ("add", None), 3: ("skip", None), 4: ("add", None)}


def test_conflicts(spark):
    rows = [(1, "always use tabs in this project for code", "g"), (2, "never use tabs in this project for code", "g"), (3, "always use tabs in this project for code", "h"), (4, "set react 17 in the web app config file", "g"), (5, "set react 18 in the web app config file", "g")]
    got = {(r.a, r.b): r.reason for r in curate.conflicts(spark.createDataFrame(rows, "id long, content string, scope string"), "id").collect()}
    assert got == {(1, 2): "opposing_pair", (4, 5): "version_conflict"}


def test_bullet_conflicts(spark):
    df = spark.createDataFrame([("do not enable it", "always enable it"), ("use x", "avoid x.")], "a string, b string").select(curate.bullet_conflicts(F.col("a"), F.col("b")).alias("c"))
    assert [r.c for r in df.collect()] == [["negation"], ["negation", "contradiction"]]


def test_merges(spark):
    cols = "pair_id int, c_content string, e_content string, c_score double, e_score double, e_recall int, c_tools array<string>, e_tools array<string>, c_entities array<string>, e_entities array<string>, c_tags array<string>, e_tags array<string>"
    rows = [(1, "new", "old", 60.0, 50.0, 3, ["a"], ["b"], [], [], ["x"], ["y", "x"]), (2, "new", "older", 50.0, 50.0, 1, [], [], [], [], [], []), (3, " ", "old", 99.0, 1.0, 0, [], [], [], [], [], [])]
    got = {r.pair_id: r for r in curate.merged(spark.createDataFrame(rows, cols)).collect()}
    assert (got[1].content, got[1].tags, got[1].related_tools if "related_tools" in got[1] else got[1].tools) == ("new", ["x", "y"], ["a", "b"])
    assert got[2].content == "older" and got[3].content == "old" and got[1].recall_count == 3


def test_lineage(spark):
    recs = spark.createDataFrame([("a", 1, NOW, None, None), ("b", 5, NOW, None, None), ("c", 5, NOW + timedelta(1), None, None), ("d", 9, NOW, NOW, None)], "id string, recall_count long, created_at timestamp, deleted_at timestamp, superseded_by string")
    groups = spark.createDataFrame([("g", i) for i in "abcd"], "grp string, id string")
    won = curate.winners(groups, recs)
    assert won.collect()[0].winner == "c"
    out = {r.id: r for r in curate.executed(recs, won, groups, recs.where("id = 'a'"), at()).collect()}
    assert out["c"].deleted_at is None and out["b"].superseded_by == "c" and out["b"].deleted_at == NOW


def test_graph_operators(spark):
    log = spark.createDataFrame([(s, i) for s, ids in enumerate(["ab", "ab", "abc"]) for i in ids], "s int, id string")
    e = {(r.from_id, r.to_id): round(r.weight, 6) for r in graph.co_recall(log, ["s"], "id").collect()}
    assert e[("a", "b")] == e[("b", "a")] == 0.3 and e[("a", "c")] == 0.1 and len(e) == 6
    src = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 1), ("c", 2)], "id string, key int")
    assert {(r.from_id, r.to_id): r.weight for r in graph.derived_from(src, 0.6).collect()} == {("a", "b"): 1.0, ("b", "a"): 1.0}
    edges = spark.createDataFrame([("a", "b", 0.7), ("b", "a", 0.9), ("a", "a", 1.0), ("a", "c", 0.5)], "from_id string, to_id string, weight double")
    assert [(r.u, r.v, r.weight) for r in graph.adjacency(edges, 0.6).collect()] == [("a", "b", 0.9)]
    assert {r.id: r.degree for r in graph.degrees(edges).collect()} == {"a": 5, "b": 2, "c": 1}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    assert {r.comp for r in graph.connected(chain).collect()} == {0, 100} and graph.connected(chain).count() == 43


def test_louvain(spark):
    clique = lambda ids: [(a, b, 1.0) for a in ids for b in ids if a < b]
    rows = clique([1, 2, 3]) + clique([4, 5, 6]) + [(3, 4, 0.1)] + clique([10, 11])
    c = graph.louvain(spark.createDataFrame(rows, "u long, v long, weight double"))
    assert {r.id: r.community for r in c.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 10: 10, 11: 10}
    assert sorted(r.members for r in graph.clusters(c).collect()) == [[1, 2, 3], [4, 5, 6]]
    assert aggregates.cluster_weight(c, spark.createDataFrame(rows, "u long, v long, weight double")).where("community = 1").first().weight == 3.0
    assert graph.louvain(spark.createDataFrame([], "u long, v long, weight double")).collect() == []


def test_vector_blocks_agree(spark):
    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)], "vec_id long, embedding array<double>")
    a = {(r.u, r.v): round(r.weight, 9) for r in graph.vector_adjacency(v, 0.5).collect()}
    assert a and a == {(r.u, r.v): round(r.weight, 9) for r in graph.vector_adjacency(v, 0.5, block=7).collect()}


def test_communities_of_vectors_need_no_table_of_edges(spark, monkeypatch):
    """Lists of neighbours come from the tasks that find the edges; communities are those of the edges."""
    rng = random.Random(3)
    middles = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = [(7 * i, [x + rng.gauss(0, 0.5) for x in middles[i % 9]]) for i in range(260)] + [(5001, [0.0] * 6), (5002, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    pairs = lambda c: {(r.id, r.community) for r in c.collect()}
    want = pairs(graph.louvain(graph.vector_adjacency(v, 0.6, block=64)))
    assert pairs(graph.vector_communities(v, 0.6, block=64)) == want and len({c for _, c in want}) > 2
    short = v.withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert dict(graph.block_pairs(short, "vec_id", "embedding", 64).dtypes)["v"] == "array<float>"  # half as much to move
    wide = short.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert graph.vector_adjacency(short, 0.6, block=64).exceptAll(graph.vector_adjacency(wide, 0.6, block=64)).count() == 0
    twice = v.unionByName(v.limit(5))
    assert pairs(graph.vector_communities(twice, 0.6, block=64, few=0)) == pairs(graph.louvain(graph.vector_adjacency(twice, 0.6, block=64)))

    def written(df, *_):
        raise AssertionError("a table was written")

    monkeypatch.setattr(graph, "written", written)
    monkeypatch.setattr(graph, "PACKED", 500)
    assert pairs(graph.vector_communities(v, 0.6, block=64, few=0)) == want


def test_search_rules(spark):
    rows = [("1", "git rebase tips", "global", NOW, 1.0), ("2", "git rebase tips", "p", NOW, 1.0), ("3", "git", "q", NOW, 1.0), ("4", "git merge", "global", NOW - timedelta(30), 0.5), ("5", "nothing", "global", NOW, 1.0)]
    e = F.array().cast("array<string>")
    df = spark.createDataFrame(rows, "bullet_id string, content string, scope string, created_at timestamp, decay_weight double").select("*", e.alias("related_tools"), e.alias("key_entities"), e.alias("tags"))
    got = search.search(df, "git rebase", at(), "p").collect()
    assert [r.bullet_id for r in got] == ["2", "1", "4", "5"] and got[0].final_score == 1.0 and got[0].raw > 1.0 and got[3].final_score == 0.0
    assert [r.bullet_id for r in search.search(df, "git rebase", at(), "p", budget=1).collect()] == ["2"]
    sem = spark.createDataFrame([("5", 1.0)], "bullet_id string, similarity double")
    assert search.scored(df, "zzz", at(), None, sem).where("bullet_id = '5'").first().raw == pytest.approx(0.4 * 1.2)
    box = spark.createDataFrame([("i", "git now", "pending"), ("j", "git", "consumed")], "id string, content string, status string")
    assert [r.bullet_id for r in search.provisional(df.where("false").select("bullet_id", "content", F.lit(0.0).alias("final_score"), F.lit(0.0).alias("raw")), box, "git").collect()] == ["i"]
    assert "<memories>" in search.render(search.search(df, "git", at()), "xml").first().context


def test_topic_first(spark):
    e = F.array().cast("array<string>")
    df = spark.createDataFrame([("1", "docker compose setup", "global", NOW, 1.0), ("2", "other", "global", NOW, 1.0)], "bullet_id string, content string, scope string, created_at timestamp, decay_weight double").select("*", e.alias("related_tools"), e.alias("key_entities"), e.alias("tags"))
    pages = spark.createDataFrame([("p", "docker compose network volume setup", "image", ["1"])], "id string, title string, summary string, bullet_ids array<string>")
    got = search.topic_first(pages, df, "docker compose network volume setup", at())
    assert [r.bullet_id for r in got.collect()] == ["p", "1"] and search.topic_first(pages, df, "zzz", at()) is None


def test_team_operators(spark):
    t = spark.createDataFrame([("a", "x", 0.9, "team", "mandatory", "verified"), ("b", "y", 0.5, "local", "suggestion", "local_authored"), ("c", "z", 0.4, "team", "mandatory", "external"), ("d", "z", 0.4, "team", "mandatory", "verified")], "id string, content string, score double, source string, enforcement string, provenance string")
    over = spark.createDataFrame([("d", "why", NOW + timedelta(1), 1), ("a", "old", NOW - timedelta(1), 1)], "id string, reason string, expires timestamp, seq int")
    got = {r.id: (r.is_mandatory, r.boosted) for r in team.boosted(t, team.active_overrides(over, at())).collect()}
    assert got == {"a": (True, 999.0), "b": (False, 0.75), "c": (False, 0.4), "d": (False, 0.4)}
    e = F.array().cast("array<string>")
    rows = spark.createDataFrame([("a", "one two", "team", 0.9, False, ["rust"], [], None), ("b", "one two", "local", 0.8, False, [], [], "d"), ("c", "other", "team", 0.7, False, ["go"], ["rust"], None), ("d", "gone", "team", 0.6, False, [], [], None), ("e", "one two", "team", 0.5, True, [], [], None)], "id string, content string, source string, boosted double, is_mandatory boolean, tags array<string>, incompatible_tags array<string>, supersedes string")
    assert [r.id for r in federate.shadow_merge(rows).collect()] == ["a", "e"]
    assert e is not None
    feed = spark.createDataFrame([("a", NOW, "tombstone"), ("b", NOW, "approved")], "id string, updated_at timestamp, status string")
    now_rows = team.apply_changes(spark.createDataFrame([("a", "1"), ("c", "3")], "id string, content string"), feed, spark.createDataFrame([("b", "2")], "id string, content string"))
    assert {r.id for r in now_rows.collect()} == {"b", "c"}
    v = team.votes(spark.createDataFrame([("a", 0, 0)], "team_id string, upvotes int, downvotes int"), spark.createDataFrame([("a", True), ("a", False)], "team_id string, up boolean")).first()
    assert (v.upvotes, v.downvotes) == (5, 10)
    assert spark.range(1).select(team.needs_full_sync(F.lit(NOW - timedelta(91)).cast("timestamp"), at()).alias("x"), team.needs_full_sync(F.lit(NOW).cast("timestamp"), at()).alias("y")).first() == (True, False)


def test_verification(spark):
    files = spark.createDataFrame([("a.py", "def f(): return 1")], "file_path string, content string")
    rows = [("ok", 0, "a.py", "def f()", None), ("stale", 0, "a.py", "def g()", None), ("none", 0, "b.py", "x", None), ("out", 0, "../a.py", "x", None), ("two", 0, "a.py", "def f()", None), ("two", 1, "b.py", "x", None), ("bad", 0, "a.py", "def f()", "00")]
    a = spark.createDataFrame(rows, "id string, pos int, file_path string, anchor_text string, h string").withColumn("anchor_hash", F.coalesce("h", F.sha2("anchor_text", 256)))
    checked = verify.check(a, files)
    assert {r.id: r.verified_status for r in checked.collect()} == {"ok": "verified", "stale": "stale", "none": "unverifiable", "out": "unverifiable", "two": "unverifiable", "bad": "stale"}
    rec = spark.createDataFrame([("ok", NOW - timedelta(seconds=30), "stale"), ("stale", NOW - timedelta(seconds=90), "verified"), ("free", None, None)], "id string, verified_at timestamp, verified_status string")
    got = {r.id: (r.verified_status, r.trust_score) for r in verify.with_trust(rec, checked, at()).collect()}
    assert got == {"ok": ("stale", 0.3), "stale": ("stale", 0.3), "free": ("not_applicable", None)}


def test_anchor_extraction(spark):
    body = "import os\n\ndef target(a):\n    x = a + 1\n    return x\n\nprint(1)\n"
    files = spark.createDataFrame([("src/m.py", body)], "file_path string, content string")
    said = "look at src/m.py and `target`:\n```python\ndef target(a):\n    x = a + 1\n```\nplus def target here and gone/n.py"
    got = verify.extract_anchors(spark.createDataFrame([(1, said)], "id long, content string"), files, "id").collect()
    assert {r.file_path for r in got} == {"src/m.py"} and all(r.anchor_text in body and len(r.anchor_text) >= 20 for r in got)
    assert "def target(a):\n    x = a + 1" in {r.anchor_text for r in got}


def test_mining(spark):
    long = "You should use the flag and run it again with care."
    rows = [("c", 0, "the build error fails with module foo", "Please wait."), ("c", 1, "module foo build again", "It works now, done."), ("c", 2, "how to pip install requests", long), ("c", 3, "module foo build third time", long), ("d", 0, "def f():\n    x = {}\n    return x", "import os\nx = 1;\ny = 2;")]
    got = {(r.conv_id, r.turn_offset, r.pattern_type): r for r in mine.detect(spark.createDataFrame(rows, "conv_id string, turn_offset long, user_message string, assistant_message string")).collect()}
    assert set(got) == {("c", 1, "retry_success"), ("c", 2, "new_tool"), ("c", 3, "repetitive_op")}
    assert got["c", 3, "repetitive_op"].confidence == pytest.approx(0.7) and got["c", 2, "new_tool"].content.startswith("Tool: pip install requests\n")
    out = mine.reflect(spark.createDataFrame([("c", 0, "error: token=abc123 fails", long)], "conv_id string, turn_offset long, user_message string, assistant_message string")).collect()
    assert len(out) == 1 and "abc123" not in out[0].content and out[0].role == "assistant" and out[0].section == "commands"


def test_packing(spark):
    rng = random.Random(2)
    tokens = [rng.randint(1, 60) for _ in range(50)]
    want, size, used, batch = [], 0, 0, 0
    for t in tokens:
        if size and (size >= 4 or used + t > 100):
            batch, size, used = batch + 1, 0, 0
        want.append(batch)
        size, used = size + 1, used + t
    df = spark.createDataFrame([("q", i, t) for i, t in enumerate(tokens)], "conv_id string, turn long, tokens int")
    assert [r.batch for r in mine.pack(df, 4, 100).orderBy("turn").collect()] == want


def test_packing_many_queues(spark):
    """Queues of any key, the missing one included, start at batch 0; a queue longer than an Arrow batch goes on where it was."""
    rows = [(k, i, 10) for k, n in (("a", 25_000), ("b", 3), (None, 2)) for i in range(n)] + [("c", 0, 500), ("c", 1, None)]
    got = mine.pack(spark.createDataFrame(rows, "conv_id string, turn long, tokens int"), 4, 100).collect()
    assert all(r.batch == r.turn // 4 for r in got if r.conv_id != "c") and len(got) == len(rows)
    assert sorted((r.turn, r.batch) for r in got if r.conv_id == "c") == [(0, 0), (1, 1)] and sum(r.conv_id is None for r in got) == 2
    assert mine.pack(spark.createDataFrame([], "conv_id string, turn long, tokens int")).collect() == []


def test_topics(spark):
    c = spark.createDataFrame([(1, [1, 2]), (2, [3])], "cluster_id long, members array<long>")
    rec = spark.createDataFrame([(1, "Use docker. Then more"), (2, "b"), (3, "Use docker. Else")], "id long, content string")
    pages = topics.summarise(c, rec).collect()
    assert sorted(p.title for p in pages) == ["Use docker", "Use docker"] and len({p.slug for p in pages}) == 2
    old = spark.createDataFrame([("p", ["1", "2", "9"], "h")], "id string, bullet_ids array<string>, source_hash string")
    fresh = spark.createDataFrame([("n", ["1", "2"], "g"), ("m", ["7"], "k")], "id string, bullet_ids array<string>, source_hash string")
    got = {(r.id, r.action) for r in topics.run(fresh, old).collect()}
    assert got == {("p", "regenerate"), ("m", "create")} and topics.orphans(old, topics.run(fresh, old)).collect() == []


def test_sources(spark, tmp_path):
    p = tmp_path / "playbook.jsonl"
    p.write_text("\n".join([json.dumps({"_header": True, "model": "m", "dim": 3}), json.dumps({"content": "c", "knowledge_type": "Knowledge", "tags": ["a"], "odd": 1}), "{broken", "", json.dumps({"section": "s"})]))
    r = store.read_playbook(spark, str(p)).collect()
    assert len(r) == 1 and r[0].knowledge_type == "knowledge" and r[0].extra["odd"] == "1" and r[0].incompatible_tags == []
    q = tmp_path / "inbox.jsonl"
    q.write_text(json.dumps({"id": "1", "content": "x", "status": "pending"}) + "\n{bad\n")
    assert [x.id for x in store.read_inbox(spark, str(q)).collect()] == ["1"]
    assert store.scope_name(None) == "global" and store.scope_name("project:a") == "project:a"
    with pytest.raises(ValueError):
        store.scope_name("project:")
    assert llmio.parsed(spark.createDataFrame([('```json\n{"a": 1}\n```',), ("no",)], ["r"]), "r", "a int").select("a").collect() == [(1,), (None,)]
    old = spark.createDataFrame([("a", 0.95)], "id string, weight double")
    assert {x.id: round(x.weight, 6) for x in store.increment(old, spark.createDataFrame([("a",), ("b",)], "id string"), ["id"], 0.1).collect()} == {"a": 1.0, "b": 0.1}


def test_queue_states(spark):
    df = spark.createDataFrame([("1", "pending", NOW, None), ("2", "in_progress", NOW, None), ("3", "consumed", NOW, NOW - timedelta(8))], "id string, status string, timestamp timestamp, consumed_at timestamp")
    ids = df.select("id")
    assert {r.id: r.status for r in inbox.moved(df, ids, "consumed", at()).collect()} == {"1": "pending", "2": "consumed", "3": "consumed"}
    assert {r.id: r.status for r in inbox.recovered(inbox.pruned(df, at())).collect()} == {"1": "pending", "2": "pending"}


def test_streams(spark, tmp_path):
    src, out, ck = tmp_path / "in", tmp_path / "table", tmp_path / "ck"
    src.mkdir()
    feed = "id string, updated_at timestamp, status string, content string"
    for i, rows in enumerate([[("a", 1, "approved", "1"), ("b", 1, "approved", "1")], [("a", 2, "approved", "2"), ("b", 2, "tombstone", None)]]):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"id": k, "updated_at": f"2024-01-0{t} 00:00:00", "status": s, "content": c}) for k, t, s, c in rows))
        inbox.sync(spark.readStream.schema(feed).json(str(src)), str(out), str(ck)).awaitTermination()
    rows = spark.read.parquet(f"{out}/v={inbox.current_version(spark, str(out))}").collect()
    assert [(r.id, r.content) for r in rows] == [("a", "2")]


def test_batch_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join([json.dumps({"id": str(i), "conversation_id": "c", "status": "pending", "timestamp": f"2024-01-01T00:00:{i:02d}"}) for i in range(7)] + ["{bad"]))
    q = inbox.batches(inbox.inbox_stream(spark, str(src)), least=3, most=4, hours=1).writeStream.format("memory").queryName("batch_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:  # a query with timers has always another batch to run, so it does not end by itself
        for _ in range(60):
            if spark.sql("select * from batch_out").count() == 2:
                break
            time.sleep(1)
    finally:
        q.stop()
    got = spark.sql("select * from batch_out").collect()
    assert sorted(len(r.ids) for r in got) == [3, 4] and {r.reason for r in got} == {"count"}


def test_vault_stream(spark, tmp_path):
    src = tmp_path / "vault"
    src.mkdir()
    (src / "x.md").write_text("---\ntitle: T\n---\nBody")
    q = inbox.vault_stream(spark, str(src)).writeStream.format("memory").queryName("vault_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.sql("select header, body from vault_out").first()
    assert (r.header, r.body) == ("title: T", "Body")


def test_memory(spark, tmp_path):
    m = memory.Memory(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("use git rebase to keep history clean", "global"), ("mail me at a.b@c.org about docker", "project:x"), ("use git rebase to keep history clean", "global"), (" ", "global")], "content string, scope string")
    plan = m.add_records(rows, NOW)
    assert sorted(r.action for r in plan.collect()) == ["add", "add"] and m.get_all().count() == 2
    assert m.get_all(scope="project:x").first().content == "mail me at <EMAIL> about docker"
    assert [r.action for r in m.add_records(rows.limit(1), NOW).collect()] == ["merge"] and m.get_all().count() == 2
    hit = m.search("git rebase", now=NOW).first()
    assert hit.content.startswith("use git") and m.search("docker", scope="project:x", now=NOW).first().scope == "project:x"
    m.reinforce(spark.createDataFrame([(hit.bullet_id, NOW)], "bullet_id string, ts timestamp"))
    assert m.get(hit.bullet_id).first().recall_count == 1
    m.update(hit.bullet_id, "use git merge", NOW)
    assert [r.event for r in m.history(hit.bullet_id).collect()][-1] == "update" and m.get(hit.bullet_id).first().content == "use git merge"
    assert m.status().where("section is null and knowledge_type is null").first().n == 2
    m.record_co_recall(spark.createDataFrame([(1, r.bullet_id) for r in m.get_all().collect()], "s int, bullet_id string"), ["s"], NOW)
    assert m.table("edges").count() == 2 and m.search_graph("git", now=NOW).count() == 2
    assert {r.outcome for r in m.run_decay_sweep(NOW + timedelta(60)).collect()} == {"updated"}
    m.export(str(tmp_path / "out"))
    other = memory.Memory(spark, str(tmp_path / "other"))
    assert sorted(r.action for r in other.import_data(str(tmp_path / "out")).collect()) == ["add", "add"]
    m.soft_delete(m.get(hit.bullet_id))
    assert m.get_all().count() == 1
    m.purge_soft_deleted()
    m.delete_all()
    assert m.table("records").count() == 0


def test_memory_consolidates(spark, tmp_path):
    m = memory.Memory(spark, str(tmp_path / "s"))
    base = " ".join(f"w{i}" for i in range(30))
    m.write("records", spark.createDataFrame([(i, t, "global", n) for i, t, n in (("a", base, 1), ("b", base + " x y", 5), ("c", base, 0), ("d", "other", 0))], "bullet_id string, content string, scope string, recall_count long").select(*[F.col(f.name) if f.name in ("bullet_id", "content", "scope", "recall_count") else F.lit(None).cast(f.dataType).alias(f.name) for f in m.table("records").schema]))
    assert {r.id: r.role for r in m.consolidate_run(now=NOW).collect()} == {"a": "kept", "b": "member", "c": "redundant", "d": "kept"}
    assert {r.bullet_id for r in m.get_all().collect()} == {"b", "d"} and m.get("a").first().superseded_by == "b"


def test_command_line(spark, tmp_path, capsys):
    s = str(tmp_path / "s")
    main([s, "learn", "use pytest fixtures"], spark)
    assert main([s, "search", "pytest"], spark).first().content == "use pytest fixtures"
    assert main([s, "list"], spark).count() == 1 and main([s, "status"], spark).count() == 3
    main([s, "forget", main([s, "list"], spark).first().bullet_id], spark)
    assert main([s, "list"], spark).count() == 0


def test_suppression_leaves_no_row_undecided(spark):
    """In a chain every other row is kept; a limit of rounds that is too low is an error, not a result."""
    rows = spark.createDataFrame([(i, i, False) for i in range(9)], "id long, rank long, forced boolean")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(8)], "a long, b long")
    assert {r.id for r in simjoin.suppress(rows, pairs).collect() if r.kept} == {0, 2, 4, 6, 8}
    with pytest.raises(RuntimeError):
        simjoin.suppress(rows, pairs, rounds=2)


def test_connected_rows_are_settled_or_an_error(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r.comp for r in graph.connected(pairs).collect()} == {0}
    with pytest.raises(RuntimeError):
        graph.connected(pairs, rounds=1)


def test_long_chains_are_walked(spark):
    """A chain of 2000 links, given out of order, and a star, decided as the walk in order of rank decides them."""
    n = 2000
    order = list(range(n))
    random.Random(1).shuffle(order)
    rank = {x: i for i, x in enumerate(order)}
    chain = [(i, i + 1) for i in range(n - 1)] + [(i, i + 1) for i in range(5000, 7000)] + [(9000, 9000 + i) for i in range(1, 50)]
    ids = sorted({x for e in chain for x in e})
    rank = {x: rank.get(x, x) for x in ids}
    near = {}
    for a, b in chain:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    kept = set()
    for x in sorted(ids, key=rank.get):
        if not any(y in kept for y in near[x] if rank[y] < rank[x]):
            kept.add(x)
    rows = spark.createDataFrame([(x, rank[x], False) for x in ids], "id long, rank long, forced boolean")
    got = simjoin.suppress(rows, spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.id for r in got if r.kept} == kept and len(got) == len(ids)


def modularity(edges, home):
    whole = 2 * sum(w for _, _, w in edges)
    load = {}
    for a, b, w in edges:
        for x in (a, b):
            load[home[x]] = load.get(home[x], 0.0) + w
    return sum(2 * w / whole for a, b, w in edges if home[a] == home[b]) - sum((x / whole) ** 2 for x in load.values())


def moved_in_turns(edges, hashes, passes=20, tolerance=1e-7):
    """Communities by the rule that graph.louvain states, node after node over dictionaries."""
    unit = [(a, b, round(w * graph.UNITS)) for a, b, w in edges]
    near = {}
    for a, b, w in unit:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    degree = {x: sum(w for _, w in ys) for x, ys in near.items()}
    whole, home = float(sum(degree.values())), {x: x for x in near}
    for turn in range(passes):
        begin = dict(home)
        for c in range(graph.CLASSES):
            load, goals = {}, {}
            for x, h in home.items():
                load[h] = load.get(h, 0) + degree[x]
            for x in near:
                if (hashes[x] >> (2 * turn)) & (graph.CLASSES - 1) == c:
                    pull = {home[x]: 0}
                    for y, w in near[x]:
                        pull[home[y]] = pull.get(home[y], 0) + w
                    gains = {h: math.floor((float(p) - float(load[h] - degree[x] * (h == home[x])) * float(degree[x]) / whole) / (tolerance * graph.UNITS) + 0.5) for h, p in pull.items()}
                    goal = min(gains, key=lambda h: (-gains[h], h))
                    if gains[goal] > max(gains[home[x]], 0):
                        goals[x] = goal
            home |= goals
        if home == begin:
            break
    least = {}
    for x, h in home.items():
        least[h] = min(x, least.get(h, x))
    return {x: least[h] for x, h in home.items()}


def communities_of(spark, edges):
    return {r.id: r.community for r in graph.louvain(spark.createDataFrame(edges, "u long, v long, weight double")).collect()}


def test_communities(spark):
    """Two cliques and a bridge are two communities; no single move improves a result of random edges."""
    n = 60
    cliques = [(o + i, o + j, 1.0) for o in (0, n) for i in range(n) for j in range(i + 1, n)] + [(n - 1, n, 0.1)]
    assert communities_of(spark, cliques) == {i: 0 if i < n else n for i in range(2 * n)}
    rng = random.Random(4)
    edges = sorted({(a, b) for a, b in ((rng.randrange(24), rng.randrange(24)) for _ in range(70)) if a < b})
    edges = [(a, b, round(rng.random() + 0.1, 3)) for a, b in edges]
    home = communities_of(spark, edges)
    assert all(home[c] == c and min(x for x in home if home[x] == c) == c for c in home.values())
    best = modularity(edges, home)
    assert [x for x in home for c in set(home.values()) if modularity(edges, home | {x: c}) > best + 1e-6] == []


def test_communities_do_not_depend_on_size(spark, monkeypatch):
    """Arrays, joins and a plain walk in the stated order agree: ties, cliques, hubs, several components, doubled and void pairs."""
    monkeypatch.setattr(graph, "CLASSES", 4)
    rng = random.Random(9)
    pairs = {(a, b) for a, b in ((rng.randrange(90), rng.randrange(90)) for _ in range(200)) if a < b}
    pairs |= {(100 + i, 100 + j) for i in range(12) for j in range(i + 1, 12)} | {(100, 120 + i) for i in range(25)} | {(200 + i, 201 + i) for i in range(9)}
    edges = sorted((a, b, 1.0 if a > 150 else rng.choice([0.3, 0.5, rng.random() + 0.05])) for a, b in pairs)
    hashes = {r.id: r.h for r in spark.range(300).select("id", F.xxhash64("id").alias("h")).collect()}
    want = moved_in_turns(edges, hashes)
    dirty = edges + [(b, a, w / 2) for a, b, w in edges[:20]] + [(5, 5, 1.0), (None, 3, 1.0), (1, 2, None)]
    assert communities_of(spark, dirty) == want
    monkeypatch.setattr(graph, "WALK_EDGES", 60)
    assert communities_of(spark, dirty) == want and 1 < len(set(want.values())) < len(want)


def test_communities_over_lists_of_neighbours(spark, monkeypatch):
    """Large components move over lists in many tasks, if their nodes are few enough, else by joins; both as over arrays."""
    monkeypatch.setattr(graph, "CLASSES", 4)
    rng = random.Random(4)
    pairs = {(rng.randrange(60), 60 + rng.randrange(60)) for _ in range(300)} | {(0, 200 + i) for i in range(40)} | {(300 + i, 301 + i) for i in range(30)} | {(400, 401)}
    edges = [(a, b, rng.choice([0.25, 0.5, 1.0])) for a, b in sorted(pairs)]
    want = communities_of(spark, edges)
    monkeypatch.setattr(graph, "WALK_EDGES", 20)
    monkeypatch.setattr(graph, "NEIGHBOURS", 3)
    monkeypatch.setattr(graph, "STARRED", 5)
    used = []
    for name in ("listed_moves", "joined_moves"):
        monkeypatch.setattr(graph, name, lambda *a, f=getattr(graph, name), name=name: used.append(name) or f(*a))
    assert communities_of(spark, edges) == want and used == ["listed_moves"]
    monkeypatch.setattr(graph, "STATE_NODES", 100)
    assert communities_of(spark, edges) == want and used == ["listed_moves", "joined_moves"]


def test_stars_of_a_task():
    rng = np.random.default_rng(3)
    u, v = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    low, tip = graph.stars(np.minimum(u, v), np.maximum(u, v))
    comp = {x: x for x in [*u.tolist(), *v.tolist()]}
    for _ in comp:
        for a, b in zip(u.tolist(), v.tolist()):
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert dict(zip(tip.tolist(), low.tolist())) == {x: c for x, c in comp.items() if x != c}


def test_two_large_cliques(spark):
    n = 500
    rows = spark.range(n).select(F.col("id").alias("a")).join(spark.range(n).select(F.col("id").alias("b")), F.col("a") < F.col("b"))
    two = rows.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(rows.select((F.col("a") + n).alias("u"), (F.col("b") + n).alias("v"))).withColumn("weight", F.lit(1.0))
    began = time.time()
    got = graph.louvain(two).groupBy("community").count().collect()
    assert {(r.community, r["count"]) for r in got} == {(0, n), (n, n)} and time.time() - began < 60


def test_summaries_read_past_blank_members(spark):
    records = spark.createDataFrame([(i, "" if 0 < i < 650 else f"word{i} more") for i in range(900)], "id long, content string")
    pages = topics.summarise(spark.createDataFrame([(0, list(range(900)))], "cluster_id long, members array<long>"), records).collect()
    words = [w for i in [0, *range(650, 900)] for w in (f"word{i}", "more")]
    assert pages[0].summary.split() == words[:200] and pages[0].title == "word0 more"


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """A copy without the two folders, with and without the pipeline's file, imports and lists the other queries."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    copy = tmp_path / "copy"
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    shutil.rmtree(copy / "cairnlake" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    for leave in (True, False):
        if not leave:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)


def test_compared_pairs_over_many_ranges(spark):
    """Positions hold across ranges: seeds are all even ids, each odd id has the seed before it."""
    n = 3000
    rows = spark.range(n).select(F.col("id"))
    roles = spark.range(n).select("id", (F.col("id") - F.col("id") % 2).alias("seed"), F.when(F.col("id") % 2 == 0, "kept").otherwise("member").alias("role"))
    want = sum(sum(1 for j in range(i + 1, n) if j % 2 == 0 or j - 1 >= i) for i in range(0, n, 2)) if n <= 400 else None
    closed = sum((n - i - 1) for i in range(0, n, 2))  # a later row has no seed, or its seed is not before i
    assert curate.pairs_compared(rows, roles).first()[0] == closed and want in (None, closed)
    assert curate.pairs_compared(rows.limit(0), roles.limit(0)).first()[0] is None


def test_own_rules_and_strategies(spark):
    turns = spark.createDataFrame([("c", 0, "please remember: tabs", "noted")], "conv_id string, turn_offset long, user_message string, assistant_message string")
    own = {"remember": (F.contains("low", F.lit("remember")), F.col("user_message"), F.lit(0.9))}
    assert [(r.pattern_type, r.confidence) for r in mine.detect(turns, own_rules=own).collect()] == [("remember", 0.9)]
    curate.STRATEGIES["candidate"] = lambda: (F.col("c_content"), F.col("c_score"), F.lit(True))
    try:
        cols = "pair_id long, c_content string, e_content string, c_score double, e_score double, e_recall long, " + ", ".join(f"{p}_{k} array<string>" for p in "ce" for k in ("tools", "entities", "tags"))
        pairs = spark.createDataFrame([(1, "new", "a longer old text", 1.0, 9.0, 2, ["a"], [], [], ["b"], [], [])], cols)
        assert curate.merged(pairs, "candidate").first().content == "new" and curate.merged(pairs, "unknown").first().content == "a longer old text"
        assert curate.merged(pairs, "candidate").first()["tools"] == ["a", "b"]
    finally:
        del curate.STRATEGIES["candidate"]


def test_nominations(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "bullet_id string")
    r = team.nomination_summary(ids("a", "b", "c", "d"), ids("a", "z"), ids("y"), ids("b")).first()
    assert (r.total_candidates, r.nominated_count, r.ignored_count, r.pending_count) == (4, 2, 1, 2)
    none = ids().select("bullet_id")
    assert tuple(team.nomination_summary(none, none, none, none).first()) == (0, 0, 0, 0)


def test_reviewed_edits_fail_closed(spark):
    rows = [(1, "plain", "plain"), (2, "plain", "write to me@corp.example"), (3, "x", "<EMAIL> [REDACTED_TOKEN]"), (4, "x", None), (5, "x", " "), (6, "me@corp.example", "fine")]
    got = {r.id: r for r in privacy.finalized(privacy.rescanned(spark.createDataFrame(rows, "id long, a string, b string"), "a", "b")).collect()}
    assert set(got) == {1, 2, 6} and not got[1].was_modified and got[2].was_modified and got[6].was_modified
    assert "me@corp.example" not in got[2].clean


def test_outbox(spark, tmp_path):
    path = str(tmp_path / "outbox")
    rows = spark.createDataFrame([("b1", "up"), ("b2", "down")], "bullet_id string, vote string")
    store.append_outbox(store.ballots(rows, at()), path)
    store.append_outbox(store.nominations(rows.select("bullet_id", F.lit("t").alias("content")), at(), "urgent"), path)
    store.append_outbox(store.corrections(rows.select(F.col("bullet_id").alias("origin_id"), F.lit("n").alias("content")).limit(1), at()), path)
    store.append_outbox(store.deviations(rows.select("bullet_id", F.lit("r").alias("reason")).limit(1), at()), path)
    got = store.read_outbox(spark, path).collect()
    assert sorted((r.kind, r.target) for r in got) == [("nominate", "b1"), ("nominate", "b2"), ("override-deviation", "b1"), ("supersede", "b1"), ("vote", "b1"), ("vote", "b2")]
    assert {json.loads(r.body)["vote"] for r in got if r.kind == "vote"} == {"up", "down"} and {r.priority for r in got if r.kind == "nominate"} == {"urgent"}
    with pytest.raises(ValueError):
        store.nominations(rows, at(), "later")
    with pytest.raises(Exception, match="no such vote"):
        store.ballots(rows.withColumn("vote", F.lit("maybe")), at()).collect()


def test_idle_gate(spark):
    seen = lambda *rows: spark.createDataFrame(list(rows), "last_activity timestamp, ended_at timestamp")
    ago = lambda s: NOW - timedelta(seconds=s)
    due = lambda df, last=None: idle.due(df, at(), F.lit(last).cast("timestamp") if last else None).first().due
    assert due(seen()) and due(seen((ago(180), ago(180)))) and due(seen((ago(900), ago(900))), ago(1800))
    assert not due(seen((ago(179), ago(179)))) and not due(seen((ago(900), None))) and not due(seen((ago(900), ago(900))), ago(1799))


def test_upkeep_goes_on_after_a_failed_step():
    def fails():
        raise OSError("no")

    out = idle.run_once([("a", fails, False), ("b", lambda: 2, True), ("c", fails, True), ("d", lambda: 4, False)])
    assert isinstance(out["a"], OSError) and out["b"] == 2 and isinstance(out["c"], OSError) and "d" not in out


def test_stored_pages(spark):
    fields = "id string, title string, summary string, bullet_ids array<string>, source_hash string"
    fresh = lambda *rows: spark.createDataFrame([(i, t, "", b, h) for i, t, b, h in rows], fields)
    day = lambda n: F.lit(NOW + timedelta(n)).cast("timestamp")
    a = [str(i) for i in range(10)]
    one = written(topics.refreshed(spark.createDataFrame([], topics.PAGE), fresh(("topic_00000001", "Docker", a, "h1"), ("topic_00000002", "Gone", ["x"], "h2")), day(0)))
    two = {r.id: r for r in topics.refreshed(one, fresh(("topic_00000003", "Docker two", a[:7], "h3"), ("topic_00000004", "Docker", ["y", "z"], "h4")), day(1)).collect()}
    assert set(two) == {"topic_00000001", "topic_00000004"}  # drifted: anew under its id; no cluster keeps the second page
    assert (two["topic_00000001"].slug, two["topic_00000001"].created_at, two["topic_00000001"].updated_at) == ("docker-two", NOW, NOW + timedelta(1))
    same = topics.refreshed(one, fresh(("topic_00000009", "Docker", a, "h1")), day(2)).collect()
    assert [(r.id, r.updated_at) for r in same] == [("topic_00000001", NOW)]
    clash = {r.id: r.slug for r in topics.upserted(one, fresh(("topic_00000007", "Docker", ["q"], "h7")), day(1)).collect()}
    assert clash["topic_00000001"] == "docker" and clash["topic_00000007"] == "docker-00000007"
    assert topics.page(one, "docker", "slug").first().id == "topic_00000001"


def test_upkeep(spark, tmp_path):
    m = memory.Memory(spark, str(tmp_path / "s"))
    m.add_records(spark.createDataFrame([(f"w{i} alpha beta gamma{i}", "global") for i in range(4)], "content string, scope string"), NOW)
    ids = sorted(r.bullet_id for r in m.get_all().collect())
    edges = spark.createDataFrame([(a, b, 1.0) for a in ids for b in ids if a < b], "from_id string, to_id string, weight double")
    out = m.upkeep(edges=edges, log_path=str(tmp_path / "log"), now=NOW)
    assert set(out) == {"consolidate", "topics"}
    pages = m.pages().collect()
    assert [sorted(p.bullet_ids) for p in pages] == [ids] and m.table("history").count() == 4
    text_of = "\n".join(r.value for r in spark.read.text(str(tmp_path / "log")).collect())
    assert "2024-02-01T00:00:00Z consolidate" in text_of and "merged: 0 groups (0 bullets -> 0)" in text_of
    m.delete_page(pages[0].id)
    assert m.pages().count() == 0
