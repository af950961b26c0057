"""An inverted index over records, and searches of a whole table of queries with it.

A block holds records of one scope, month and range of weight. For every term, a posting row has a block and the records of the block that
hold the term; rows are sorted by term in their files, so readers skip row groups. Words are indexed as they stand: stems of queries are
expanded over the table of distinct terms, so a word is posted once for exact and fuzzy matches.

A search first joins the queries' terms with the postings' (term, block) columns alone: the terms that a block holds, with its largest
weight and latest time, bound the score of every record in it. The best blocks of each query are scored, which gives a k-th score to
beat; only blocks whose bound reaches it are read further. Results are those of scanning every record for every query.

Updates add a generation: postings and records of what changed. The latest generation of a record counts, older postings of it
are left out when records are looked up; ``build`` into a new folder makes one generation again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import RETRIEVAL
from ..functions import score, text
from ..sources.scratch import written

#: Records of a block; ranges of weight; blocks of each query that are scored to begin with; keys over which one query's rows are dealt.
BLOCK, LEVELS, FIRST, SALTS = 256, 8, 4, 16
#: Pairs of a query and a block whose hits one task adds up, so that its memory does not grow with the table.
PAIRS = 64
#: Rows of a small table (terms of all queries, kinds of blocks) that is broadcast; a larger one is joined.
SMALL = 100_000
RECORD = ("bullet_id", "content", "scope", "decay_weight", "created_at", "related_tools", "key_entities", "tags")
#: Letters that match an ASCII letter when case is ignored: long s, dotless i, dotted I, Kelvin sign.
FOLDED, FOLDS = "ſıİK", "siik"


def _strings(c: Column | str) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def terms(content: Column, tools: Column, entities: Column, tags: Column) -> Column:
    """Distinct terms of a record, by kind: w words, x words of a text with folded letters (exact matches only), p letter runs inside
    words, q words with an apostrophe, c and u CJK pairs and characters, t, e and g tools, entities and tags."""
    content = F.coalesce(content, F.lit(""))
    odd = content.rlike(f"[{FOLDED}]")
    plain = F.lower(F.translate(content, FOLDED, FOLDS))
    words = F.array_distinct(F.regexp_extract_all(plain, F.lit("([a-z0-9_]+)"), 1))
    pieces = F.array_distinct(F.regexp_extract_all(F.lower(content), F.lit("([a-z]+)"), 1))
    joined = F.regexp_extract_all(plain, F.lit("(?<![a-z0-9_])(?=([a-z0-9_]+'[a-z]+(?![a-z0-9_])))"), 1)
    named = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(kind), v))
    return F.array_distinct(
        F.concat(
            F.when(odd, named("x:", words)).otherwise(named("w:", words)),
            named("p:", F.when(odd, pieces).otherwise(F.array_except(pieces, words))),
            F.when(F.contains(plain, F.lit("'")), named("q:", joined)).otherwise(F.array().cast("array<string>")),
            named("c:", text.cjk_bigrams(content)),
            named("u:", F.regexp_extract_all(content, F.lit(f"({text.CJK_JAVA})"), 1)),
            *[named(kind, F.transform(F.filter(_strings(values), lambda v: v.isNotNull()), lambda v: F.lower(v))) for kind, values in (("t:", tools), ("e:", entities), ("g:", tags))],
        )
    )


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcasting, if it is small enough."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _write(records: DataFrame, path: str, generation: int) -> None:
    r = records.select(*RECORD).withColumn("decay_weight", score.clamp(F.col("decay_weight")))  # a weight that is not known counts in full
    key = [F.coalesce("scope", F.lit("")), F.date_format("created_at", "yyyy-MM"), F.floor(F.col("decay_weight") * LEVELS)]
    r = r.withColumn("_key", F.concat_ws("|", *[k.cast("string") for k in key]))
    subs = r.groupBy("_key").agg(F.ceil(F.count("*") / BLOCK).alias("_subs"))
    r = r.join(small(written(subs)), "_key").withColumn("block", F.concat_ws("|", F.lit(generation), "_key", F.pmod(F.xxhash64("bullet_id"), F.col("_subs"))))
    docs = r.select("bullet_id", "scope", "decay_weight", "created_at", "block", F.lit(generation).alias("generation"), F.lit(False).alias("deleted"))
    docs.write.mode("append").parquet(f"{path}/docs")
    r.groupBy("block").agg(F.max("decay_weight").alias("most_weight"), F.max("created_at").alias("latest"), F.collect_set("scope").alias("scopes")).write.mode("append").parquet(f"{path}/blocks")
    # texts move once; grouping by block and term needs no other shuffle
    texts = r.select("block", "bullet_id", "content", "related_tools", "key_entities", "tags").repartition("block")
    held = terms(F.col("content"), F.col("related_tools"), F.col("key_entities"), F.col("tags"))
    posted = texts.select("block", "bullet_id", F.explode(held).alias("term")).groupBy("block", "term").agg(F.collect_list("bullet_id").alias("ids"))
    posted.sortWithinPartitions("term").write.mode("append").parquet(f"{path}/postings")
    seen = F.substring("term", F.lit(3), F.length("term"))
    fresh = records.sparkSession.read.parquet(f"{path}/postings").where(F.startswith("block", F.lit(f"{generation}|"))).select("term").distinct()
    known = fresh.select("term", F.substring("term", 1, 1).alias("kind"), seen.alias("value"))
    letters = known["kind"].isin("w", "p") & known["value"].rlike("^[a-z]+$") & ~known["value"].isin(*sorted(text.TOKEN_STOPWORDS))
    known.withColumn("stem", F.when(letters, text.stem(F.col("value")))).write.mode("append").parquet(f"{path}/vocabulary")


def build(records: DataFrame, path: str) -> None:
    """Writes an index of records (RECORD columns) into a new folder."""
    _write(records, path, 0)


def update(spark: SparkSession, path: str, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
    """Adds a generation: changed or new records, and ids (bullet_id) of records that are gone."""
    generation = spark.read.parquet(f"{path}/docs").agg(F.max("generation")).first()[0] + 1
    if deleted is not None:
        none = F.lit(None)
        gone = deleted.select("bullet_id", none.cast("string").alias("scope"), none.cast("double").alias("decay_weight"), none.cast("timestamp").alias("created_at"), none.cast("string").alias("block"), F.lit(generation).alias("generation"), F.lit(True).alias("deleted"))
        gone.write.mode("append").parquet(f"{path}/docs")
    if changed is not None:
        _write(changed, path, generation)


def live(spark: SparkSession, path: str) -> DataFrame:
    """The indexed records (without texts) in their latest generation."""
    docs = spark.read.parquet(f"{path}/docs")
    last = docs.groupBy("bullet_id").agg(F.max(F.struct("generation", "deleted", "scope", "decay_weight", "created_at", "block")).alias("d"))
    return last.select("bullet_id", "d.*").where("not deleted")


def query_terms(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(query_id, part, slot, weight, n, term): what each query looks for. A slot counts once a record, whichever of its terms is found;
    n is the number of the query's tokens. queries: query_id, query."""
    q = F.coalesce("query", F.lit(""))
    named = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(kind), v))
    words = text.query_words(q)
    tokens = text.mixed_tokens(q)
    base = written(queries.select("query_id", words.alias("words"), tokens.alias("tokens"), text.metadata_words(q).alias("meta"), text.cjk_runs(q).alias("runs")))
    # runs of three or more characters are found by their pairs first, see ``long_runs``
    short = F.filter("runs", lambda r: F.length(r) < 3)
    run_terms = F.transform(short, lambda r: F.concat(F.when(F.length(r) == 1, "u:").otherwise("c:"), r))
    word_terms = F.flatten(F.transform("words", lambda w: F.when(F.contains(w, F.lit("'")), F.array(F.concat(F.lit("q:"), w))).otherwise(F.array(F.concat(F.lit("w:"), w), F.concat(F.lit("x:"), w)))))
    exact = base.select("query_id", F.explode(F.concat(word_terms, run_terms)).alias("term")).withColumn("slot", F.substring("term", F.lit(3), F.length("term")))
    exact = exact.select("query_id", F.lit("exact").alias("part"), "slot", F.lit(1).alias("weight"), F.lit(1).alias("n"), "term")
    counted = base.select("query_id", F.size("tokens").alias("n"), F.explode("tokens").alias("slot")).groupBy("query_id", "n", "slot").agg(F.count("*").cast("int").alias("weight"))
    vocabulary = spark.read.parquet(f"{path}/vocabulary")
    stems = vocabulary.where("stem is not null").select(F.col("stem").alias("slot"), "term").distinct()
    by_stem = counted.where(F.col("slot").rlike("^[a-z]")).join(stems, "slot")
    by_pair = counted.where(~F.col("slot").rlike("^[a-z]")).withColumn("term", F.concat(F.lit("c:"), "slot"))
    fuzzy = by_stem.unionByName(by_pair).select("query_id", F.lit("fuzzy").alias("part"), "slot", "weight", "n", "term")
    meta = base.select("query_id", F.explode(F.array_distinct("meta")).alias("token"))
    heads = vocabulary.where("kind in ('t', 'e')").select("kind", "term", F.explode(F.sequence(F.lit(1), F.length("value"))).alias("i"), "value").select("kind", "term", F.substring("value", F.lit(1), F.col("i")).alias("token")).distinct()
    whole = vocabulary.where("kind = 'g'").select("kind", "term", F.col("value").alias("token")).distinct()
    tags = meta.join(heads.unionByName(whole), "token").select("query_id", F.lit("meta").alias("part"), F.col("kind").alias("slot"), F.when(F.col("kind") == "t", 4).otherwise(3).alias("weight"), F.lit(1).alias("n"), "term").distinct()
    return exact.unionByName(fuzzy).unionByName(tags)


def points(hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys and keyword_score from hits (keys, part, slot, weight, n), each slot once, as ``search.scored`` adds them up."""
    once = hits.groupBy(*keys, "part", "slot").agg(F.max("weight").alias("weight"), F.max("n").alias("n"))
    part = lambda name, value: F.coalesce(F.sum(F.when(F.col("part") == name, value)), F.lit(0))
    out = once.groupBy(*keys).agg(part("exact", F.lit(1)).alias("exact"), part("fuzzy", F.col("weight")).alias("fuzzy"), F.max(F.when(F.col("part") == "fuzzy", F.col("n"))).alias("n"), part("meta", F.col("weight")).alias("meta"))
    share = F.least(F.coalesce(F.col("fuzzy") / F.col("n").cast("double") * RETRIEVAL.fuzzy_most, F.lit(0.0)), F.lit(RETRIEVAL.fuzzy_most))
    return out.withColumn("keyword_score", F.col("exact") * F.lit(RETRIEVAL.exact_hit) + share + F.least(F.lit(10.0), F.col("meta").cast("double"))).drop("exact", "fuzzy", "n", "meta")


def _raw(keyword: Column, weight: Column, created: Column, boost: Column, now: Column) -> Column:
    return score.composite(keyword, F.lit(0.0), weight, score.recency(created, now), boost, False)


def long_runs(queries: DataFrame, records: DataFrame, path: str) -> DataFrame:
    """Hits (query_id, bullet_id, part, slot, weight, n) of CJK runs of three or more characters: records that hold all pairs of a run are
    looked into. They are looked up for all blocks, as they are few."""
    spark = queries.sparkSession
    runs = queries.select("query_id", F.explode(text.cjk_runs(F.coalesce("query", F.lit("")))).alias("slot")).where(F.length("slot") >= 3)
    pairs = runs.select("query_id", "slot", F.explode(F.array_distinct(text.cjk_bigrams(F.col("slot")))).alias("pair")).withColumn("term", F.concat(F.lit("c:"), "pair"))
    need = pairs.groupBy("query_id", "slot").agg(F.count("*").alias("need"))
    posted = spark.read.parquet(f"{path}/postings").where("term >= 'c:' and term < 'c;'").select("term", F.explode("ids").alias("bullet_id"))
    able = pairs.join(posted, "term").groupBy("query_id", "slot", "bullet_id").agg(F.countDistinct("term").alias("have")).join(need, ["query_id", "slot"]).where("have = need")
    found = able.join(records.select("bullet_id", "content"), "bullet_id").where(F.contains("content", F.col("slot")))
    return found.select("query_id", "bullet_id", F.lit("exact").alias("part"), "slot", F.lit(1).alias("weight"), F.lit(1).alias("n"))


def best(rows: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows of each query; a query's rows are dealt over SALTS keys first."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "query_id"]), F.lit(SALTS)))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    few = salted.withColumn("_n", rank("query_id", "_salt")).where(F.col("_n") <= k)
    return few.withColumn("_n", rank("query_id")).where(F.col("_n") <= k).withColumnRenamed("_n", "rank").drop("_salt")


def postings_of(wanted: DataFrame, path: str) -> DataFrame:
    """Posting rows of the terms that some query looks for; others do not move."""
    return wanted.sparkSession.read.parquet(f"{path}/postings").join(small(wanted.select("term").distinct()), "term", "left_semi")


def bounds(wanted: DataFrame, path: str, now: Column, scope: str | None) -> DataFrame:
    """(query_id, block, bound): no record of the block scores more for the query. Only the narrow columns of the postings are read."""
    spark = wanted.sparkSession
    blocks = spark.read.parquet(f"{path}/blocks")
    if scope:
        blocks = blocks.where(F.array_contains("scopes", scope) | F.array_contains("scopes", "global"))
    boost = F.when(F.array_contains("scopes", scope), RETRIEVAL.scope_factor).otherwise(1.0) if scope else F.lit(1.0)
    held = postings_of(wanted, path).select("block", "term")
    top = points(wanted.join(held, "term"), ["query_id", "block"]).join(blocks, "block")
    return top.select("query_id", "block", (_raw(F.col("keyword_score"), F.col("most_weight"), F.col("latest"), boost, now) * (1 + 1e-12)).alias("bound"))


def dealt_hits(wanted: DataFrame, chosen: DataFrame, extra: DataFrame, path: str) -> DataFrame:
    """Hits (query_id, bullet_id, block, part, slot, weight, n) in the chosen blocks. Those of a query in a block meet in one task, about PAIRS of
    such pairs in each: postings move before they are taken apart, and ``points`` needs no other shuffle."""
    postings = postings_of(wanted, path)
    met = wanted.join(chosen.select("query_id", "block"), "query_id").join(postings, ["block", "term"]).select("query_id", "ids", "block", "part", "slot", "weight", "n")
    blocks = live(wanted.sparkSession, path).select("bullet_id", "block")
    more = extra.join(blocks, "bullet_id").join(chosen.select("query_id", "block"), ["query_id", "block"], "left_semi").withColumn("ids", F.array("bullet_id"))
    tasks = max(1, -(-chosen.count() // PAIRS))
    dealt = met.unionByName(more.select(met.columns)).repartition(tasks, "query_id", "block")
    return dealt.select("query_id", F.explode("ids").alias("bullet_id"), "block", "part", "slot", "weight", "n")


def scored(wanted: DataFrame, chosen: DataFrame, extra: DataFrame, path: str, now: Column, scope: str | None) -> DataFrame:
    """(query_id, bullet_id, keyword_score, raw) of live records in the chosen blocks. extra: hits found elsewhere."""
    spark = wanted.sparkSession
    hits = dealt_hits(wanted, chosen, extra, path)
    docs = live(spark, path)
    rows = points(hits, ["query_id", "bullet_id", "block"]).join(docs, ["bullet_id", "block"])
    if scope:
        rows = rows.where(F.col("scope").isin(scope, "global"))
    return rows.select("query_id", "bullet_id", "keyword_score", _raw(F.col("keyword_score"), F.col("decay_weight"), F.col("created_at"), score.scope_boost(F.col("scope"), scope), now).alias("raw")).where("raw > 0")


def chosen_blocks(wanted: DataFrame, extra: DataFrame, path: str, now: Column, scope: str | None, k: int) -> tuple[DataFrame, DataFrame]:
    """((query_id, block, bound) of all blocks with a term, those of them that must be read)."""
    docs = live(wanted.sparkSession, path)
    every = bounds(wanted, path, now, scope)
    # a long run's hits raise a block's bound to the most that keywords give
    raised = extra.join(docs, "bullet_id").select("query_id", "block", (_raw(F.lit(RETRIEVAL.most_keyword_score), F.lit(1.0), now, F.lit(RETRIEVAL.scope_factor), now) * (1 + 1e-12)).alias("bound")).distinct()
    every = written(every.unionByName(raised).groupBy("query_id", "block").agg(F.max("bound").alias("bound")))
    first = written(best(every, [F.desc("bound"), "block"], FIRST))
    tried = scored(wanted, first, extra, path, now, scope)
    kth = best(tried, [F.desc("raw"), "bullet_id"], k).where(F.col("rank") == k).select("query_id", F.col("raw").alias("least"))
    return every, written(every.join(kth, "query_id", "left").where("least is null or bound >= least").select("query_id", "block", "bound"))


def search_table(queries: DataFrame, records: DataFrame, path: str, now: Column, scope: str | None = None, k: int = 20) -> DataFrame:
    """(query_id, rank, bullet_id, keyword_score, raw, final_score): the best k records of each query with a score over 0, ties to the smaller id.

    records: the indexed records; only those that hold all pairs of a long CJK run are read."""
    spark = queries.sparkSession
    wanted = written(query_terms(spark, path, queries))
    extra = written(long_runs(queries, records, path))
    _, chosen = chosen_blocks(wanted, extra, path, now, scope, k)
    out = best(scored(wanted, chosen, extra, path, now, scope), [F.desc("raw"), "bullet_id"], k)
    return out.select("query_id", "rank", "bullet_id", "keyword_score", "raw", score.clamp(F.col("raw")).alias("final_score"))
