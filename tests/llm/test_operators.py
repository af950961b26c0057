"""Small tables with every awkward row, and brute-force versions of what SQL cannot express."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnlake.llm import decontam, htmltext, langid, mixing, neardup, pii, quality, tokens, topk, urlrules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns that clash with results."""
    long = prose(99, 40_000)
    base = prose(1)
    rows = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, base.upper(), "de", None), (3, base.replace("alpha", "x", 1), None, "b"),
        (4, None, "en", "b"), (5, "", None, None), (6, " \t\n", "fr", "c"), (7, long, "en", "c"), (8, long + " end", "en", "c"),
        (9, "one two", "fr", "a"), (10, "ONE  two", "fr", "a"), (11, "12345 67 !!", "en", "b"), (12, prose(5), "de", "b"), (12, prose(5), "de", "b"), (None, prose(6), "en", "a"),
    ]
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("score", "id", "kept", "taken", "copies", "copy", "size", "spans", "n_tokens", "held_out", "rank", "label")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    low = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if i != j and a and b and 100 * len(a & b) >= percent * len(a | b):
                    m = min(low[i], low[j])
                    if low[i] != m or low[j] != m:
                        low[i] = low[j] = m
                        changed = True
    return low


def test_near_duplicates_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(3)
    for c in range(40):  # copies with edits of one original: many are alike only through others
        w = prose(1000).split()
        for _ in range(c // 6):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        rows.append((100 + c, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (4, 5):
        low = brute_components(rows, k, 80)
        got = neardup.near_duplicates(df, shingle_words=k).collect()
        assert len(got) == len(rows)
        sizes = {}
        for i, t in rows:
            sizes.setdefault(i, set()).add(len(shingles(t, k)))
        for r in got:
            assert r.n_shingles in sizes[r.doc_id]
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.component_id, r.kept) == (low[r.doc_id], low[r.doc_id] == r.doc_id)


def test_near_duplicate_blocks(spark, monkeypatch):
    """Key groups that are cut into several blocks find the same links."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "TEXT_BLOCK", 3)
    monkeypatch.setattr(neardup, "SALT", 5)
    rng = random.Random(5)
    rows = []
    for c in range(60):
        w = prose(2000, 80).split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        rows.append((c, " ".join(w)))
    low = brute_components(rows, 4, 80)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=4).collect()
    assert {r.doc_id: r.component_id for r in got} == low


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one id with different texts are rows of their own: links of each text are kept, and no text is lost."""
    a, b, c = prose(11), prose(12), prose(13)
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (3, c), (None, a), (None, b), (4, None), (4, ""), (5, c), (5, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect() if r.doc_id is not None)
    n = len(shingles(a, 5))
    assert got == [(1, n, 1, True), (1, n, 1, True), (2, n + 1, 1, False), (3, n, 3, True), (3, n + 1, 1, False), (4, 0, 4, True), (4, 0, 4, True), (5, n, 3, False), (5, n, 3, False)]
    out = sorted(map(str, neardup.dedup(df).collect()))
    assert out == sorted(map(str, spark.createDataFrame([(1, a), (1, b), (3, c), (None, a), (None, b), (4, None), (4, "")], "doc_id long, text string").collect()))
    with pytest.raises(ValueError):
        neardup.near_duplicates(df, percent=60)


def test_dedup_keeps_one(spark, docs, empty):
    out = neardup.dedup(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == [(False, i) for i in (0, 4, 5, 6, 7, 9, 11, 12)] + [(True, None)]
    assert neardup.near_duplicates(empty).collect() == [] and neardup.dedup(empty).collect() == []


def test_token_counts(docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.default_model())
    texts = sorted(((r.doc_id is None, r.doc_id), len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect())
    for cut in (16, 16_384):
        got = sorted(((r.doc_id is None, r.doc_id), r.n_bytes, r.n_tokens) for r in tokens.token_counts(docs, cut_chars=cut, batch_bytes=100).collect())
        assert got == texts
    assert all(r.over_limit == (r.n_tokens > 4096) for r in tokens.token_counts(docs).collect())
    assert tokens.token_counts(empty).collect() == []


def test_token_cuts_are_safe():
    tool = tokens.PieceCounter(tokens.default_model())
    assert tool.safe
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "ab", " ", "  ", "▁", "é", "\n", "😀", "the", ".", "<s>"]) for _ in range(rng.randint(0, 60)))
        parts = tokens.cut(text, 5)
        assert " ".join(parts) == text
        assert sum(tool.count(parts)) == tool.count([text])[0]


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(size(r.text) for r in rows)
    own = {}
    for r in rows:
        own[r.source] = own.get(r.source, 0) + size(r.text)
    names = sorted(s for s in own if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    stopped, left = set(), float(total)
    while True:  # the excess is shared again until no target is above three times its source
        open_w = sum(weight[s] for s in names if s not in stopped)
        over = [s for s in names if s not in stopped and left * weight[s] / open_w > 3 * own[s]]
        if not over:
            break
        stopped |= set(over)
        left = total - sum(3 * own[s] for s in stopped)
    targets = sorted(3.0 * own[s] if s in stopped else left * weight[s] / open_w for s in names)
    assert sorted({r.target for r in got}) == pytest.approx(targets)
    assert all(0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).collect() == []
    out = mixing.mixed_documents(docs)
    assert sum(1 for _ in out.collect()) == sum(r.taken // r.size for r in got if r.size)
    assert mixing.mixed_documents(empty).collect() == []


def test_mixing_leaves_the_callers_views(spark, docs):
    spark.range(3).createOrReplaceTempView("sources")
    views = {t.name for t in spark.catalog.listTables()}
    assert mixing.mix(docs).count() == docs.count()
    assert {t.name for t in spark.catalog.listTables()} == views and spark.table("sources").count() == 3
    spark.catalog.dropTempView("sources")


def test_mixing_meets_targets(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(d).groupBy("target", "source_size").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.target) <= max(r.m, 0.05 * r.target) for r in rows)


def test_pareto_odds_follow_inclusion(spark):
    """Longer documents of a source are taken more often than short ones."""
    rows = [(i, " ".join(["w"] * (2 if i % 2 else 200)), "a") for i in range(400)] + [(1000, " ".join(["w"] * 9000), "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id < 1000").groupBy("size").agg(F.avg(F.col("taken") / F.col("size")).alias("r")).orderBy("size").collect()
    assert got[0].r < got[1].r


def test_language_id(spark, empty):
    de, fr, en = "und der die nicht ein ich schön über straße", "le la les une été où français très vous", "the and of with that this from have which"
    rng = random.Random(2)
    rows = []
    for i in range(300):
        name, words = [("de", de), ("fr", fr), ("en", en)][i % 3]
        rows.append((i, " ".join(rng.choices(words.split(), k=rng.randint(3, 30))), name))
    rows += [(900, None, "en"), (901, "", None), (902, "123 !? 4", "de"), (903, " ".join(de.split() * 5000), None), (904, "the of", None), (904, "the of", None), (None, "und nicht", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit(9))
    got = langid.identify(df, held_out=langid.held_out_third)
    rows_got = got.collect()
    assert len(rows_got) == len(rows)
    by = {}
    for r in rows_got:
        by.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert by[900][0].lang_pred == by[901][0].lang_pred == by[902][0].lang_pred == "und"
    assert by[903][0].lang_pred == "de" and by[904][0] == by[904][1] and by[904][0].lang_pred == "en"
    held = [(r.lang_pred, rows[r.doc_id][2]) for r in rows_got if r.held_out and r.doc_id < 300]
    assert np.mean([a == b for a, b in held]) > 0.97
    same = spark.createDataFrame([(7, texts, "de") for texts in ["und der die", "the of"] * 700], "doc_id long, text string, lang string")
    assert all(len({r.score for r in langid.identify(same).collect() if r.lang_pred == lang}) == 1 for lang in ("de",))
    assert langid.identify(same, train=df).select("lang_pred", "score").distinct().count() == 2
    assert langid.identify(empty).collect() == [] and langid.keep_identified(empty).collect() == []
    kept = langid.keep_identified(df, held_out=langid.held_out_third)
    assert kept.columns == df.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() >= 300
    nothing = spark.createDataFrame([(1, "the of", None)], "doc_id long, text string, lang string")
    assert langid.identify(nothing).first().lang_pred == "und" and langid.keep_identified(nothing).count() == 1


def test_samples_are_bounded_in_rows(spark, monkeypatch):
    """Rows of one id are all or none of a hash's choice, but no more than the bound is fetched."""
    seen = []
    monkeypatch.setattr(langid, "fit", lambda x, langs: seen.append(len(langs)))
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)))
    rows = spark.createDataFrame([(5, "the of", "en")] * 3000 + [(6, "und der", "de")] * 40, "id long, text string, lang string")
    langid.learn(rows, most_rows=400)
    quality.learn(rows, spark.createDataFrame([(5, 1), (6, 0)], "id long, label int"), most_rows=300)
    assert 0 < seen[0] <= 400 and 0 < seen[1] <= 300


def test_margins_do_not_depend_on_the_place():
    rng = np.random.default_rng(3)
    x, w = rng.random((700, langid.DIMS)).astype(np.float32), np.append(rng.normal(size=langid.DIMS), [0.1, 2.0, 0.0])
    whole = langid.odds(x, w)
    for i in (0, 1, 5, 333, 699):
        assert langid.odds(x[i : i + 1], w)[0] == langid.odds(x[i:][:7], w)[0] == whole[i]


def test_language_families_come_first():
    assert langid.family_of("de") == langid.family_of("en") != langid.family_of("fr") == langid.family_of("es")
    model = langid.fit(langid.describe(["und der", "the of", "le la", "el los"] * 5), ["de", "en", "fr", "es"] * 5)
    assert model["names"] == ["germanic", "romance"] and set(model["pairs"]) == {("de", "en"), ("es", "fr")}


def test_quality(spark, docs, empty):
    rng = random.Random(4)
    good = [(i, prose(i, rng.randint(5, 60)) + ".", 1) for i in range(200)]
    bad = [(200 + i, " ".join(w + "%%%" for w in prose(i, rng.randint(5, 60)).upper().split()), 0) for i in range(200)]
    d = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(None, 1), (3, None), (5, 1)], "doc_id long, quality int")
    held = lambda c: F.crc32(c.cast("string")) % 5 == 0
    out = quality.score_quality(d, labels, held_out=held).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in out)
    assert np.mean([r.predicted == int(r.doc_id < 200) for r in out if r.held_out]) > 0.97
    odd = quality.score_quality(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert all(r.score == 0.5 for r in quality.score_quality(docs, labels.where("false")).collect())
    assert quality.score_quality(empty, labels).collect() == []


def test_quality_tables_add_up():
    """The score is a sum of one entry of each table."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model["pairs"] and np.mean((quality.predict(model, x) > 0.5) == y) > 0.9
    z, zc = quality.binned(x[:1], model["cuts"])[0], quality.binned(x[:1], model["coarse"])[0]
    total = model["base"] + sum(t[z[k]] for k, t in enumerate(model["tables"])) + sum(g[zc[i], zc[j]] for (i, j), g in zip(model["pairs"], model["grids"]))
    assert quality.predict(model, x[:1])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def brute_spans(t):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in email.finditer(t)] if "@" in t else []
    out += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in card.finditer(t) if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out)


def test_pii_base_against_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("a1.@-+ 25()%é\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t)


def test_pii_adds_and_redacts(spark, docs, empty):
    card = "4" + "0" * 14 + "2"  # passes the check digit
    texts = ["mail a.b@c.example.org now", f"pay {card} soon", "reach me at jo (at) foo (dot) com", "password=" + "abc123def456ghi789", "1.2.3.4 and 1.2.3.400", None, "", "x" * 300_000, "call +1 (555) 123-4567 please", "nothing", "mail a.b@c.example.org or 10.0.0.1, " * 8000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = {r.doc_id: r for r in pii.find(df).collect()}
    for i, t in enumerate(texts):
        base = brute_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(b[1] == n for b in base) for n in range(4)]
        assert set(filter(None, pii.listed(base).split(","))) <= set(got[i].spans.split(","))
    assert got[2].spans == "email:12:33" and got[3].spans.startswith("secret:9:") and got[9].spans == ""
    red = {r.doc_id: r for r in pii.redact(df).collect()}
    assert red[0].text == "mail <EMAIL> now" and red[1].text == "pay <CARD> soon" and red[5].text is None and red[0].spans == "clash"
    assert len(pii.find(docs).collect()) == docs.count() and pii.find(empty).collect() == []


def test_pii_labelers_are_weighed():
    """A labeler that votes against what all others hold is found unreliable."""
    rng = np.random.default_rng(0)
    truth = rng.random(2000) < 0.4
    v = np.stack([np.where(rng.random(2000) < acc, truth, ~truth) for acc in (0.95, 0.9, 0.85, 0.9, 0.5)], axis=1) * 2 - 1
    rows, n = np.unique(v, axis=0, return_counts=True)
    odds, share, p = pii.reliabilities(rows, n.astype(float), np.zeros(len(rows)))
    right = (odds[:, 1, 2] + odds[:, 0, 0]) / 2
    assert right[:4].min() > 0.8 and right[4] < 0.6 and abs(share - 0.4) < 0.05


def test_decontamination(spark, docs, empty):
    items = [(i, prose(500 + i, n)) for i, n in enumerate((40, 20, 60, 3, 30))] + [(5, None), (6, ""), (7, "!!!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [prose(1, 300) + " " + items[0][1] + " " + prose(2, 200), items[1][1].upper(), "a, " + items[2][1].replace(" ", "  "), "so " + items[3][1] + " end", prose(7, 500), None, "", " ".join(w for i, w in enumerate(items[4][1].split()) if i % 6), prose(8, 30_000) + " " + items[1][1]]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, items[0][1]), (0, texts[0])], "doc_id long, text string").withColumn("cosine", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in decontam.find(df, bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (7, 4), (8, 1), (None, 0)}
    assert {(r.doc_id, r.item_id) for r in decontam.find(df, bench, block_items=2).collect()} == got
    kept = decontam.clean(df, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6] and kept.columns == df.columns
    twins = spark.createDataFrame([(None, items[0][1]), (None, prose(8, 90)), (1, items[1][1]), (1, prose(9, 90)), (2, None), (None, None)], "doc_id long, text string")
    left = sorted(map(str, decontam.clean(twins, bench).collect()))
    assert left == sorted(map(str, twins.where("text is null or not text in ('%s', '%s')" % (items[0][1], items[1][1])).collect())) and len(left) == 4
    assert {(r.doc_id, r.item_id) for r in decontam.find(df, bench, block_bytes=300).collect()} == got
    assert decontam.find(empty, bench).collect() == [] and decontam.find(docs, bench.where("false")).collect() == []
    assert decontam.clean(docs, bench.where("item_id > 4")).count() == docs.count()


def test_components_are_settled_or_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r.comp for r in neardup.components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        neardup.components(edges, most_rounds=1)


def skewed(rng, n, words=4000):
    return [f"w{int(words ** rng.random())}x" for _ in range(n)]


def test_few_edges_need_few_tasks(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)]
    edges = spark.createDataFrame(chain, "u long, v long")
    found, tasks = {}, {}
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    for few in (neardup.FEW_EDGES, 0):
        spark.sparkContext.setJobGroup(f"few-{few}", "components")
        found[few] = sorted(map(tuple, neardup.components(edges, few=few).collect()))
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(f"few-{few}") for s in tracker.getJobInfo(j).stageIds}
        tasks[few] = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    spark.sparkContext.setJobGroup("", "")
    for k, v in before.items():
        spark.conf.set(k, v)
    want = [(i, 0) for i in range(41)] + [(i, 100) for i in range(100, 140)]
    assert found == {neardup.FEW_EDGES: want, 0: want}
    # the first distinct() is dealt out, later turns are not
    assert tasks[neardup.FEW_EDGES] < tasks[0] / 3, tasks


def test_latent_directions_are_reduced():
    """The directions hold the leading singular vectors of the rows, and fewer than there are rows."""
    rng = np.random.default_rng(5)
    rows = np.abs(rng.standard_normal((60, 8)) @ rng.standard_normal((8, 300))) + 0.05 * rng.random((60, 300))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    basis = decontam.latent_basis(rows, 256)
    values = np.linalg.svd(rows, compute_uv=False)
    need = 1 + int((np.cumsum(values**2) < decontam.ENERGY * (values**2).sum()).sum())
    assert basis.shape == (300, need) and need < 60
    assert np.allclose(basis.T @ basis, np.eye(need)) and np.allclose(np.linalg.norm(rows @ basis, axis=0), values[:need])
    hashes = [rng.integers(0, 400, 30).astype(np.uint64) for _ in range(50)]
    vocabulary = np.unique(decontam.bucket(np.concatenate(hashes)))
    items = decontam.Items(list(range(50)), hashes, vocabulary, np.full(len(vocabulary), 5.0), decontam.RANK, 24)
    assert items.vectors.shape[1] < items.vectors.shape[0]


def test_decontamination_with_a_large_benchmark(spark):
    """Short items are found although all words around them are words of other items: verbatim, and with a stranger after every third word."""
    rng = random.Random(3)
    texts = [skewed(rng, 150) for _ in range(300)]
    items = [(i, skewed(rng, 15 + i % 9)) for i in range(60)]
    snippets = [(100 + i, t[a : a + n]) for i in range(1500) for t, a, n in [(rng.choice(texts), rng.randint(0, 90), rng.randint(15, 59))]]
    planted = [t[:70] + (w if i % 2 else [x for j, y in enumerate(w) for x in ([y, f"odd{j}"] if j % 3 == 2 else [y])]) + t[70:] for (i, w), t in zip(items, texts)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(planted + texts[60:])], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items + snippets], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find(df, bench).collect()}
    assert {(i, i) for i in range(60)} <= got
    assert all(decontam.confirm(items[k][1], set(), planted[d] if d < 60 else texts[d])[0] >= decontam.PARAPHRASE for d, k in got if k < 100)


@pytest.mark.parametrize("apart", [0, 3])
def test_decontamination_of_an_item_in_a_third_of_the_documents(spark, apart):
    """A hot item is found in every document although rare words of other items surround it, verbatim or with a stranger after every third word."""
    rng = random.Random(4)
    hot = [f"hot{i}" for i in range(20)]
    there = [x for j, y in enumerate(hot) for x in ([y, f"odd{j}"] if apart and j % apart == apart - 1 else [y])]
    texts = [[f"r{i}q{j}" for j in range(120)] for i in range(90)]
    bench = [(0, hot)] + [(1 + 2 * i + k, t[a : a + 20]) for i, t in enumerate(texts) for k, a in enumerate((41, 63))]
    df = spark.createDataFrame([(i, " ".join(t[:60] + (there if i < 30 else []) + t[60:])) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find(df, spark.createDataFrame([(i, " ".join(w)) for i, w in bench], "item_id long, text string")).collect()}
    assert {d for d, k in got if k == 0} == set(range(30))
    hashes, vocabulary = decontam.item_hashes([(i, " ".join(w)) for i, w in bench])
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(hot)])], names=["text"])
    counted = next(decontam.frequency_counter(vocabulary, hashes)([batch]))
    assert counted.to_pydict() == {"place": [-1], "n": [1]}


def test_decontamination_words_are_those_of_the_index(spark):
    """Words lose their ends and capitals the same way on both sides, and short items need all of their words in a row."""
    odd = "Ñadobo. -bar (Éa) x -- y!\x0bz .q"
    h, first = decontam.hashed(decontam.WordHasher(), pa.array([odd, None, "..."]))
    plain, _ = decontam.hashed(decontam.WordHasher(), pa.array([" ".join(decontam.normal_words(odd))]))
    assert h.tolist() == plain.tolist() and first.tolist() == [0, 7, 7, 7]
    bench = spark.createDataFrame([(1, "alpha"), (2, "beta gamma"), (3, "one two three four five six seven")], "item_id long, text string")
    df = spark.createDataFrame([(1, "so ALPHA."), (2, "gamma beta"), (3, "beta, gamma"), (4, "one two three four five six"), (5, "0 one two three four five six seven")], "doc_id long, text string")
    got = decontam.find(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 2), (5, 3)} and min(r.cosine for r in got) > 0.99


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [[rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontam.lcs(np.array(a, np.int64), np.array(b, np.int64)) == t[-1][-1]


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://a.example.NET/en/1", "http://a.net", "http://a.net?x/", "https://b.example.com/de/5#t", "http://x.org/fr/1", "http://x.org/en/1", "http://www.cheap-pills.example.com/x", "http://cheap-pillsx.org/", "http://u:p@h.net:80/", "http://x.org/casino/", "http://x.org/?affid=12", "http://x.org/a/xxx/b", "http://example.net/EN/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urlrules.filter_urls(df).collect()}
    assert (got[0].host, got[0].path, got[0].verdict) == ("", "", "allow") and got[2].host == ""
    assert got[3].rule == "example.net/en/" and got[3].verdict == "allow" and got[3].host == "a.example.net"
    assert got[4].rule is None and got[5].path == "" and got[6].rule == "example.com/de/" and got[6].verdict == "block"
    assert got[7].rule == "org/fr/" and got[8].rule is None and got[8].verdict == "allow"
    assert [got[i].verdict for i in (9, 10, 12, 13, 14)] == ["block", "allow", "block", "block", "block"]
    assert got[11].rule is None and got[15].rule == "net/"
    for i, u in enumerate(urls):  # the index never loses a rule that matches
        want = [k for k, (_, p) in enumerate(urlrules.PATTERN_RULES) if u is not None and re.search(p, u, re.I | re.A)]
        assert got[i].rule is not None or got[i].pattern_rule == (want[0] if want else None)
    assert urlrules.filter_urls(df.where("false")).collect() == []


def test_url_rule_lists():
    lines = ["! note", "[Adblock]", "# hosts", "0.0.0.0 ads.example.org  # why", "127.0.0.1 track.example", "bad.example", "||evil.test^", "|http://start.test/", "/banner/*/img.", "end.swf|", "@@||good.evil.test^", r"/[/.]pop[0-9]+\./", "x##.ad", "||opt.test^$script", ""]
    rules = urlrules.read_rules(lines)
    assert [r[0] for r in rules] == ["block"] * 6 + ["block"] + ["allow"] + ["block"]
    fit = lambda i, url: bool(re.search(rules[i][1], url, re.I | re.A))
    assert fit(0, "http://a.ads.example.org/x") and not fit(0, "http://bads.example.org/") and not fit(0, "http://ads.example.org.net/") and fit(0, "https://ADS.example.org:80")
    assert fit(3, "http://evil.test") and fit(7, "http://x.good.evil.test/") and not fit(3, "http://evil.testing/") and not fit(3, "http://x.org/?u=evil.test")
    assert fit(4, "http://start.test/a") and not fit(4, "http://x.org/http://start.test/") and fit(5, "http://x.org/banner/9/img.png") and fit(6, "http://x.org/end.swf") and not fit(6, "http://x.org/end.swf?")
    assert rules[3][2] == ["evil", "test"] and rules[5][2] == ["banner", "img"] and rules[6][2] == ["swf"] and rules[8][2] == []


def test_ten_thousand_url_rules(spark):
    """The index finds what running all rules finds, with tokens that many rules share, equal rules and rules of both verdicts."""
    rng = random.Random(6)
    word = lambda: rng.choice(["ad", "ads", "track", "www", "img", "com", "net"] + [f"w{rng.randint(0, 400)}" for _ in range(4)])
    make = (
        lambda: f"{word()}.{word()}.com", lambda: f"||{word()}.{word()}^", lambda: f"/{word()}/{word()}-", lambda: f"@@||{word()}.{word()}^", lambda: f"/{word()}*{word()}/", lambda: f"-{word()}.", lambda: f"||{word()}.net/{word()}|",
    )
    lines = [rng.choice(make)() for _ in range(10_000)]
    rules = urlrules.read_rules(lines + lines[:50]) + [("block", r"[/.-]w77[/.-]")]
    urls = [f"http://{word()}.{word()}.{rng.choice(['com', 'net', 'W7'])}/{word()}/{word()}-{word()}.x{rng.choice(['', '?q=' + word()])}" for _ in range(150)] + ["http://a.b/", "w77", None, "http://-w77-"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in urlrules.filter_urls(df, (), rules).collect()}
    compiled = [re.compile(r[1], re.I | re.A) for r in rules]
    for i, u in enumerate(urls):
        hits = [k for k, c in enumerate(compiled) if u is not None and c.search(u)]
        best = min(hits, key=lambda k: (rules[k][0] != "block", k), default=None)
        assert (got[i].pattern_rule, got[i].verdict) == (best, "allow" if best is None else rules[best][0])
    assert sum(r.pattern_rule is not None for r in got.values()) > 50
    assert sum(not (r[2] if len(r) > 2 else urlrules.literals(r[1])) for r in rules) < 2500


def test_url_literals():
    assert urlrules.literals(r"/foo/") == ["foo"] and urlrules.literals(r"foo") == [] and urlrules.literals(r"/a|/b/") == []
    assert urlrules.literals(r"/x?foo/") == [] and urlrules.literals(r"[/.-]casino[/.-]") == ["casino"]


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(40)]
    rows += [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (420, [0.0] * 8), (440, [1.0, -1.0]), (440, [1.0, -1.0]), (20, [-1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    good = [(i, np.pad(np.floor(64 * np.array(v)).astype(int), (0, 8 - len(v)))) for i, v in rows if i is not None and i not in (400, 401, 402, 403)]
    want = []
    for i, q in good:
        if i % 20 == 0:
            best = sorted(((-int(q @ v), j) for j, v in good if j != i))[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    for candidates, queries in ((8192, 8192), (50, 7)):
        monkeypatch.setattr(topk, "CANDIDATES", candidates)
        monkeypatch.setattr(topk, "QUERIES", queries)
        got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_topk(df).collect()]
        assert sorted(got) == sorted(want)
    assert topk.exact_topk(df.where("false")).collect() == []


def test_topk_of_huge_components(spark):
    """Scores beyond float64 are exact; beyond a long they end at its limits."""
    rows = [(0, [3e14, 1.0]), (1, [1.0, 5.0]), (2, [1.0, 6.0]), (3, [-1.0, 0.0]), (4, [3e17, 0.0]), (5, [-1e300, 0.0])]
    got = [(r.vec_id, r.score) for r in topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    big = 64 * int(3e14)
    limits = lambda x: max(min(x, (1 << 63) - 1), -(1 << 63))
    assert got == [(4, limits(big * big * 10)), (2, limits(big * 64 + 64 * 384)), (1, limits(big * 64 + 64 * 320)), (3, limits(-big * 64)), (5, limits(-(1 << 63) * big))]


def test_topk_stops_early_and_is_exact():
    rng = np.random.default_rng(2)
    block = np.floor(rng.normal(size=(3000, 4)) * 64)
    ids = np.arange(3000)
    for q in block[:20]:
        (got, score), = topk.threshold_topk(ids, block, np.array([-1]), q[None], 5)
        order = np.lexsort((ids, -(block @ q)))[:5]
        assert got.tolist() == order.tolist() and score.tolist() == (block @ q)[order].tolist()
        (above, _), = topk.threshold_topk(ids, block, np.array([-1]), q[None], 5, np.array([int(score[2])]))
        assert above.tolist()[:3] == got.tolist()[:3]


def test_html(spark):
    pages = {
        0: (None, ""), 1: ("", ""), 2: ("plain &lt; text", "plain < text"),
        3: ("<html><body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>One&nbsp;two &amp; three<br>four<p><b>Five</b>six</article><footer>F</footer>", "Title One two & three four Fivesix"),
        4: ("<div class='ad'>Buy</div><div><p>Real text, with commas, and length.</p></div><script>var a='<p>no</p>'</script><div class=comments><p>Reader said</div>", "Real text, with commas, and length."),
        5: ("<article><p>cut <b>here</b> and <a hre", "cut here and"),
        6: ("<main><section><p>First part, long enough.</p></section><section><p>Second part, long enough.</p></section></main><aside>Side</aside>", "First part, long enough. Second part, long enough."),
        7: ("<p>" + "word " * 50_000 + "</p>", ("word " * 50_000).strip()), 8: ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"), 9: ("<" * 2000 + "x", "<" * 1999), 10: ("<form><input>f</form><!-- c -->", ""),
    }
    df = spark.createDataFrame([(i, f"u{i}", h) for i, (h, _) in pages.items()], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    for r in htmltext.main_texts(df).collect():
        assert (r.text, r.n_chars, r.url) == (pages[r.page_id][1], len(pages[r.page_id][1]), f"u{r.page_id}")
    assert htmltext.main_texts(df.where("false")).collect() == []


def test_html_never_fails():
    rng = random.Random(7)
    bits = ["<p>", "</p>", "<b>", "</b>", "<div>", "</div>", "<li>", "<td>", "</table>", "<article>", "</article>", "a, b", "&amp;", "<", ">", '"', "<a href='", "<!--", "-->", "<script>", "</script>", "<br/>", "\x00", "é"]
    for _ in range(3000):
        text = htmltext.main_text("".join(rng.choice(bits) for _ in range(rng.randint(0, 40))))
        assert text == " ".join(text.split())


def test_html_time_grows_with_the_page():
    """Unclosed tags and end tags without a start do not make a page slow."""
    for page in ("<i>" * 100_000 + "</b>" * 100_000 + "text", "<span>" * 100_000 + "<h1>" * 50_000 + "text", "<b>" * 50_000 + "a<p>" * 50_000 + "text"):
        began = time.process_time()
        assert htmltext.main_text(page).endswith("text")
        assert time.process_time() - began < 5


def test_html_keeps_the_article():
    """Words in other attributes hide nothing, a class that names the article outweighs one beside it, captions stay."""
    body = "<p>The whole article, with commas, is here.</p>"
    assert htmltext.main_text('<p title="the hidden valley" data-x="display:none">text here</p>') == "text here"
    assert htmltext.main_text(f'<div class="article-content share">{body}</div><div>short.</div>') == "The whole article, with commas, is here."
    assert htmltext.main_text(f'<article>{body}<div class="article-comments"><p>Reader, said, much, more, than, that.</p></div></article>') == "The whole article, with commas, is here."
    assert htmltext.main_text(f"<article>{body}<figure><img src=x><figcaption>A caption</figcaption></figure></article>") == "The whole article, with commas, is here. A caption"
    for gone in ("hidden", 'HIDDEN=""', "aria-hidden=true", 'style="color:red; display : none"', "class=cookie-notice"):
        assert htmltext.main_text(f"<article>{body}<div {gone}>gone</div></article>") == "The whole article, with commas, is here."


def test_deep_pages():
    assert htmltext.main_text("<div>" * 20_000 + "deep text" + "</div>" * 20_000) == "deep text"


def test_mixed_documents_take_what_the_mix_takes(spark):
    """Rows that share an id: the cut falls inside them, and each row counts by itself."""
    words = lambda n: " ".join(["w"] * n)
    rows = [(None, words(100), "a")] * 400 + [(i, words(50 + i % 30), "b") for i in range(180)] + [(7, words(60), "b"), (7, words(60) + " x", "b"), (8, None, "a"), (8, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix(df).collect()
    out = mixing.mixed_documents(df)
    assert out.columns == ["doc_id", "text", "source", "taken", "copies", "copy"]
    got = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    for source in "ab":
        taken = sum(r.taken for r, row in zip(plan, plan) if (r.source_size == 40000) == (source == "a") and r.size)
        target = next(r.target for r in plan if (r.source_size == 40000) == (source == "a") and r.size)
        assert abs(got[source] - target) <= 100 and abs(taken - target) <= 100
    again = mixing.mixed_documents(df)
    key = lambda r: (r.doc_id is None, r.doc_id, r.text, r.copies, r.copy)
    assert sorted(map(key, out.collect())) == sorted(map(key, again.collect()))
    assert mixing.mixed_documents(df.limit(0)).collect() == []
