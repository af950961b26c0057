"""Curation: merge or add candidates, detect conflicts, consolidate the corpus, record what superseded what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CURATION
from ..functions import score, text
from ..sources.scratch import written
from . import cosjoin, simjoin


def curate(candidates: DataFrame, existing: DataFrame, threshold: float = CURATION.similarity) -> DataFrame:
    """(cand_id, action, target_id, sim): skip blanks, merge into the most similar record of the scope, else add.

    candidates: cand_id, content, scope. existing: bullet_key (ordered), content, scope."""
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    best = simjoin.best_match(candidates.where(~blank), text.word_set(F.col("content")), "cand_id", existing, text.word_set(F.col("content")), "bullet_key", threshold, "scope")
    out = candidates.join(best, candidates["cand_id"] == best["left_id"], "left")
    action = F.when(blank, "skip").when(F.col("right_id").isNotNull(), "merge").otherwise("add")
    return out.select("cand_id", action.alias("action"), F.col("right_id").alias("target_id"), "sim")


def curate_in_order(records: DataFrame, id_col: str, threshold: float = CURATION.similarity, group: str | None = "scope", vector_col: str | None = None) -> DataFrame:
    """(cand_id, action, target_id, sim): every record as a candidate against all records of smaller id in its scope.

    Similarity is the cosine where both rows have a vector, that of their words otherwise; blank contents are skipped, and are no targets."""
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    pairs, members = near_pairs(records.where(~blank), id_col, threshold, group, vector_col)
    best = cosjoin.nearest_earlier(pairs, members)
    out = records.select(F.col(id_col).alias("cand_id"), blank.alias("_blank")).join(best, F.col("cand_id") == F.col("id"), "left")
    action = F.when(F.col("_blank"), "skip").when(F.col("target").isNotNull(), "merge").otherwise("add")
    return out.select("cand_id", action.alias("action"), F.col("target").alias("target_id"), "sim")


def contradiction(a: Column, b: Column, negations=text.DETECT_NEGATIONS, opposites=text.OPPOSITES) -> Column:
    """opposing_pair, negation_asymmetry or version_conflict, the first that holds, else null."""
    return contradicting(contradiction_marks(a, negations, opposites), contradiction_marks(b, negations, opposites), opposites)


def contradiction_marks(content: Column, negations=text.DETECT_NEGATIONS, opposites=text.OPPOSITES) -> Column:
    """All that ``contradiction`` needs of a text: its words of opposites, whether it negates, the versions that it names."""
    words = text.word_set(content)
    negative = F.arrays_overlap(words, F.array(*[F.lit(n) for n in negations])) | content.rlike("|".join(text.DETECT_CJK_NEGATIONS))
    return F.struct(only(words, opposites).alias("words"), negative.alias("negative"), text.versions(content).alias("versions"))


def only(words: Column, pairs) -> Column:
    """The words that stand in pairs of opposites."""
    return F.array_intersect(words, F.array(*[F.lit(w) for pair in pairs for w in pair]))


def contradicting(a: Column, b: Column, opposites=text.OPPOSITES) -> Column:
    """``contradiction`` from the marks of two texts."""
    return (
        F.when(text.opposing(a["words"], b["words"], opposites).isNotNull(), "opposing_pair")
        .when(a["negative"] != b["negative"], "negation_asymmetry")
        .when(text.versions_differ(a["versions"], b["versions"]), "version_conflict")
    )


def conflicts(df: DataFrame, id_col: str, low: float = CURATION.conflict_low, high: float = CURATION.conflict_high, negations=text.DETECT_NEGATIONS, opposites=text.OPPOSITES) -> DataFrame:
    """(a, b, sim, reason) of records of one scope that are about the same and contradict each other. df: id, content, scope.

    Marks of texts meet the pairs, not the texts."""
    pairs, members = simjoin.self_join(df, text.word_set(F.col("content")), low, id_col, "scope")
    marks = df.select(F.col(id_col).alias("id"), contradiction_marks(F.col("content"), negations, opposites).alias("marks"))
    marked = written(members.join(marks, "id"))
    side = lambda rep, own, mark: marked.select(F.col("rep").alias(rep), F.col("id").alias(own), F.col("marks").alias(mark))
    both = pairs.where(F.col("sim") <= high).join(side("a", "x", "ma"), "a").join(side("b", "y", "mb"), "b")
    both = both.withColumn("reason", contradicting(F.col("ma"), F.col("mb"), opposites)).where("reason is not null")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sim", "reason")


def anchor_mismatches(anchors: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b): one verified, one stale record whose anchors are in the same file and overlap (letter case counts).

    anchors: id, verified_status, file_path, anchor_text."""
    words = F.filter(F.split("anchor_text", r"(?U)\s+"), lambda w: w != "")
    rows = anchors.where("file_path <> ''").select("id", "verified_status", simjoin.token_set(words, "file_path").alias("toks"))
    side = lambda status: rows.where(F.col("verified_status") == status).select("id", "toks")
    hit = simjoin.between(side("verified"), side("stale"), least)
    return hit.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_pairs(df: DataFrame, id_col: str, low: float, group: str | None = None, vector_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives, members) of records similar at ``low``: by vectors where both have one, by words otherwise."""
    words = text.word_set(F.col("content"))
    if vector_col is None:
        return simjoin.self_join(df, words, low, id_col, group)
    return cosjoin.hybrid_pairs(df, words, low, id_col, group, vector_col)


def grouped(pairs: DataFrame, members: DataFrame, redundant: float) -> DataFrame:
    """(id, rep, seed, role) of an ordered walk over pairs (a, b, sim) of representatives: seeds are kept, the rows near them follow."""
    reps = members.where("id = rep").select("id", F.col("id").alias("rank"), F.lit(False).alias("forced"))
    kept = written(simjoin.suppress(reps, pairs))
    alive = kept.where("kept").select(F.col("id").alias("a"))
    lead = pairs.join(alive, "a").groupBy(F.col("b").alias("id")).agg(F.min(F.struct("a", "sim")).alias("x"))
    of_rep = kept.join(lead, "id", "left").select(F.col("id").alias("rep"), "kept", F.when(~F.col("kept"), F.col("x.a")).alias("seed"), F.col("x.sim").alias("sim"))
    rows = members.join(of_rep, "rep")
    copy = F.col("kept") & (F.col("id") != F.col("rep"))
    # a copy of a seed is redundant to it; a copy of a member may meet an earlier kept row just as its representative does
    seed = F.when(copy, F.col("rep")).otherwise(F.col("seed"))
    role = F.when(copy, "redundant").when(F.col("kept"), "kept").when(F.col("sim") >= redundant, "redundant").otherwise("member")
    return rows.select("id", "rep", F.coalesce(seed, F.col("id")).alias("seed"), role.alias("role"))


def consolidate(df: DataFrame, id_col: str, similarity: float = CURATION.similarity, redundant: float = CURATION.redundant, vector_col: str | None = None) -> DataFrame:
    """(id, seed, role): seeds are kept; a row near a kept row of smaller id is a member, or redundant if nearer still.

    Similarity is that of the word sets; with ``vector_col``, the cosine where both rows have a vector. Equal rows collapse first: of a
    class only the smallest id can be a seed, and the rest follow it."""
    pairs, members = near_pairs(df, id_col, similarity, None, vector_col)
    return grouped(written(pairs), members, redundant).select("id", "seed", "role")


def consolidation(df: DataFrame, id_col: str, similarity: float = CURATION.similarity, redundant: float = CURATION.redundant, low: float = CURATION.conflict_low, high: float = CURATION.conflict_high, vector_col: str | None = None, negations=text.NEGATIONS, antonyms=text.ANTONYMS) -> tuple[DataFrame, DataFrame]:
    """(roles, conflicts) of one consolidation: roles as ``consolidate``; conflicts (a, b, sim, kind) as the walk meets them.

    The walk compares a seed i with every later row that no seed before i has taken; of those with a similarity in
    [low, high) it reports contradictions. That is an interval condition on the two tables: i is a seed, i < j, and the seed of j does not
    stand before i. One join finds the pairs for both. Both ends of a conflict are named once each kind."""
    pairs, members = near_pairs(df, id_col, min(low, similarity), None, vector_col)
    pairs = written(pairs)
    roles = written(grouped(pairs.where(F.col("sim") >= similarity), members, redundant))
    # texts of one class differ in their words' order only, but negations and antonyms are those of the words: the representatives' will do
    marks = df.select(F.col(id_col).alias("id"), bullet_marks(F.coalesce("content", F.lit("")), negations, antonyms).alias("marks"))
    marks = written(marks.join(members.where("id = rep").select("id"), "id", "left_semi"))
    mid = pairs.where((F.col("sim") >= low) & (F.col("sim") < high))
    # representatives of both orders: a seed is the representative of its class, its partner any member of the other
    either = mid.unionByName(mid.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    side = lambda rep, mark: marks.select(F.col("id").alias(rep), F.col("marks").alias(mark))
    seeds = roles.where("role = 'kept'").select(F.col("id").alias("a")).join(side("a", "ma"), "a")
    later = roles.select(F.col("rep").alias("b"), F.col("id").alias("j"), "seed").join(side("b", "mb"), "b")
    met = either.join(seeds, "a").join(later, "b").where("a < j and seed >= a")
    found = met.select("a", F.col("j").alias("b"), "sim", F.explode(marked_conflicts(F.col("ma"), F.col("mb"), antonyms)).alias("kind"))
    return roles.select("id", "seed", "role"), found


def bullet_conflicts(a: Column, b: Column, negations=text.NEGATIONS, antonyms=text.ANTONYMS) -> Column:
    """Kinds of conflict between two texts: negation in one only, antonyms."""
    return marked_conflicts(bullet_marks(a, negations, antonyms), bullet_marks(b, negations, antonyms), antonyms)


def bullet_marks(content: Column, negations=text.NEGATIONS, antonyms=text.ANTONYMS) -> Column:
    """All that ``bullet_conflicts`` needs of a text: its antonyms, and whether it negates."""
    return F.struct(only(text.bare_words(content), antonyms).alias("words"), (text.count_negations(content, negations) > 0).alias("negative"))


def marked_conflicts(a: Column, b: Column, antonyms=text.ANTONYMS) -> Column:
    """``bullet_conflicts`` from the marks of two texts."""
    pair = text.opposing(a["words"], b["words"], antonyms)
    return F.array_compact(F.array(F.when(a["negative"] != b["negative"], "negation"), F.when(pair.isNotNull(), "contradiction")))


def triaged(df: DataFrame) -> DataFrame:
    """Conflicts (a, b, sim, kind) with confidence and what is done with them."""
    out = df.withColumn("confidence", score.conflict_confidence(F.col("sim"), F.col("kind")))
    return out.withColumn("action", score.triage(F.col("confidence")))


def of_kind(df: DataFrame, kind: str) -> DataFrame:
    """Conflicts of which the kind or the reason is the given one."""
    return df.where((F.col("kind") == kind) | (F.col("reason") == kind))


def with_conflicts(records: DataFrame, found: DataFrame, id_col: str = "id") -> DataFrame:
    """records with the ids of what they conflict with appended to ``conflict_with``, each once. found: a, b."""
    ends = found.select(F.col("a").alias(id_col), F.col("b").cast("string").alias("_other")).unionByName(found.select(F.col("b").alias(id_col), F.col("a").cast("string").alias("_other")))
    more = ends.groupBy(id_col).agg(F.array_sort(F.collect_set("_other")).alias("_others"))
    return records.join(more, id_col, "left").withColumn("conflict_with", union_lists(F.col("conflict_with"), F.col("_others"))).drop("_others")


def winners(groups: DataFrame, records: DataFrame) -> DataFrame:
    """(grp, winner): most recalls, then latest, then smallest id, among live members. groups: grp, id. records: id, recall_count, created_at, deleted_at."""
    w = Window.partitionBy("grp").orderBy(F.desc("recall_count"), F.desc("created_at"), "id")
    live = groups.join(records.where("deleted_at is null"), "id")
    return live.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("grp", F.col("id").alias("winner"))


def supersede_edges(groups: DataFrame, won: DataFrame) -> DataFrame:
    """(from_id, to_id): the winner supersedes the other members of its group."""
    return groups.join(won, "grp").where("winner <> id").select(F.col("winner").alias("from_id"), F.col("id").alias("to_id"))


def executed(records: DataFrame, won: DataFrame, groups: DataFrame, redundant: DataFrame, now: Column) -> DataFrame:
    """Records after merges: losers and redundant rows are soft-deleted, losers name what superseded them."""
    lost = supersede_edges(groups, won).select(F.col("to_id").alias("id"), F.col("from_id").alias("_by"))
    out = records.join(lost, "id", "left").join(redundant.select("id", F.lit(True).alias("_red")), "id", "left")
    gone = F.col("_by").isNotNull() | F.coalesce("_red", F.lit(False))
    return out.withColumn("deleted_at", F.coalesce("deleted_at", F.when(gone, now))).withColumn("superseded_by", F.coalesce("superseded_by", F.col("_by").cast("string"))).drop("_by", "_red")


def union_lists(a: Column, b: Column) -> Column:
    return F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


def keep_best() -> tuple[Column, Column, Column]:
    """The higher score, then the longer text, then the existing one; a blank text never wins."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    c, e = F.col("c_content"), F.col("e_content")
    cs, es = F.col("c_score"), F.coalesce("e_score", F.lit(0.0))
    takes = F.when(blank(c) & ~blank(e), False).when(blank(e) & ~blank(c), True).otherwise((cs > es) | ((cs == es) & (F.length(c) > F.length(e))))
    return F.when(takes, c).otherwise(e), F.when(takes, cs).otherwise(es), takes


def merge_content() -> tuple[Column, Column, Column]:
    """Both texts' sentences, once each, with the higher score."""
    return text.merge_sentences(F.col("e_content"), F.col("c_content")), F.greatest(F.col("c_score"), F.coalesce("e_score", F.lit(0.0))), F.lit(False)


#: Name -> strategy: (content, score, whether the candidate's lists come first) over the columns of ``merged``. Callers may add theirs.
STRATEGIES = {"keep_best": keep_best, "merge_content": merge_content}


def merged(pairs: DataFrame, strategy: str = "keep_best") -> DataFrame:
    """Candidate (c_*) and existing (e_*) columns as one record: content, instructivity_score, recall_count, lists.

    A strategy that is not known merges as keep_best does."""
    content, points, first = STRATEGIES.get(strategy, keep_best)()
    lists = [F.when(first, union_lists(F.col(f"c_{k}"), F.col(f"e_{k}"))).otherwise(union_lists(F.col(f"e_{k}"), F.col(f"c_{k}"))).alias(k) for k in ("tools", "entities", "tags")]
    return pairs.select("pair_id", content.alias("content"), points.alias("instructivity_score"), F.col("e_recall").alias("recall_count"), *lists)


def merged_into(existing: DataFrame, candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """(target_id, content, instructivity_score, tags) of records after every candidate that hits them, one after the other by
    candidate id, as keep_best merges.

    existing: target_id, content, score, tags. candidates: cand_id, content, score, tags. hits: cand_id, target_id.

    Each merge keeps the better text, so the last one has the best of all: the higher score, then the longer text, then the record's
    own or the earliest, blank texts last. Of the lists, those of candidates that took over stand first, latest before, then the record's
    own, then the others' in order; so no target's candidates meet in one row."""
    none = F.array().cast("array<string>")
    row = lambda df, nth: df.select("target_id", nth.alias("nth"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("tags", none).alias("tags"))
    mine = existing.join(hits.select("target_id").distinct(), "target_id", "left_semi")
    rows = row(mine, F.lit(None).cast(candidates.schema["cand_id"].dataType)).unionByName(row(hits.join(candidates, "cand_id"), F.col("cand_id")))
    worth = F.struct((F.trim("content") != "").alias("full"), "score", F.length("content").alias("n"))
    turn = Window.partitionBy("target_id").orderBy(F.col("nth").asc_nulls_first())
    earlier = turn.rowsBetween(Window.unboundedPreceding, -1)
    rows = written(rows.withColumn("worth", worth).withColumn("turn", F.row_number().over(turn)).withColumn("takes", F.coalesce(F.col("worth") > F.max("worth").over(earlier), F.lit(False))))
    # what takes over last is the best; a record that nothing takes over from is its own best
    best = rows.where(F.col("takes") | F.col("nth").isNull()).groupBy("target_id").agg(F.max_by(F.struct("content", "score"), F.struct(F.col("nth").isNotNull().alias("m"), "nth")).alias("x"))
    # places of lists: takers before all (latest first), then the record, then the others
    place = F.when(F.col("takes"), 0).when(F.col("nth").isNull(), 1).otherwise(2)
    tags = rows.select("target_id", place.alias("place"), F.when(F.col("takes"), -F.col("turn")).otherwise(F.col("turn")).alias("at"), F.posexplode("tags").alias("pos", "tag"))
    first = tags.groupBy("target_id", "tag").agg(F.min(F.struct("place", "at", "pos")).alias("x"))
    lists = first.groupBy("target_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "tag"))), lambda t: t["tag"]).alias("tags"))
    out = best.join(lists, "target_id", "left")
    return out.select("target_id", F.col("x.content").alias("content"), F.col("x.score").alias("instructivity_score"), F.coalesce("tags", none).alias("tags"))


def merge_sources(a: Column, b: Column, cap: int = 50) -> Column:
    """Source structs once a (conversation_id, turn_offset), by time; beyond the cap the earliest and the latest half stay."""
    both = F.concat(a, b)
    key = lambda s: F.struct(s["conversation_id"], s["turn_offset"])
    keys = F.transform(both, key)
    once = F.filter(both, lambda s, i: F.array_position(keys, key(s)) == i + 1)
    timed = F.array_sort(once, lambda x, y: F.when(x["timestamp"] < y["timestamp"], -1).when(x["timestamp"] > y["timestamp"], 1).otherwise(0))
    half = cap // 2
    return F.when(F.size(timed) > cap, F.concat(F.slice(timed, 1, half), F.slice(timed, -half, half))).otherwise(timed)


def pairs_compared(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """One row: how many pairs the ordered walk of ``consolidate`` looks at: for each seed i, the later rows that have
    no seed or whose seed is not before i.

    Rows that no seed takes meet all seeds before them; a row with a seed meets those up to its seed. Both are counts
    of seeds by position, so positions suffice: rows: id; roles: id, seed, role. Rows without words are their own seeds.
    Ids are dealt by ranges: seeds are counted by range first, then within each range, so no task sorts all ids."""
    full = rows.join(roles, "id", "left").select("id", F.when(F.col("role").isin("member", "redundant"), F.col("seed")).alias("seed"))
    full = written(full.repartitionByRange("id").withColumn("part", F.spark_partition_id())).withColumn("is_seed", F.when(F.col("seed").isNull(), 1).otherwise(0))
    earlier = lambda w: F.coalesce(F.sum("is_seed").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a range: this window sorts no more rows than there are tasks
    ranges = full.groupBy("part").agg(F.sum("is_seed").alias("is_seed")).select("part", earlier(Window.orderBy("part")).alias("base"))
    ranked = full.withColumn("inside", earlier(Window.partitionBy("part").orderBy("id"))).join(ranges, "part").withColumn("before", F.col("base") + F.col("inside"))
    upto = ranked.where("seed is null").select(F.col("id").alias("seed"), (F.col("before") + 1).alias("upto"))
    met = ranked.join(upto, "seed", "left").select(F.coalesce("upto", "before").alias("n"))
    return met.agg(F.sum("n").cast("long").alias("pairs_compared"))


def execution_report(groups: DataFrame, won: DataFrame, redundant: DataFrame, found: DataFrame, seconds: float) -> DataFrame:
    """One row: what a consolidation did. groups: grp, id; won: grp, winner; redundant: id; found: conflicts with action."""
    n = lambda action: F.sum(F.when(F.col("action") == action, 1).otherwise(0))
    acts = found.agg(*[F.coalesce(n(a), F.lit(0)).cast("long").alias(name) for a, name in (("supersede", "auto_supersede"), ("review", "queued_for_review"), ("mark", "marked_conflict"))])
    counts = [won.agg(F.count("*").alias("merged_groups")), groups.agg(F.count("*").alias("merged_bullets")), redundant.agg(F.count("*").alias("soft_deleted")), acts]
    out = counts[0]
    for one_row in counts[1:]:
        out = out.crossJoin(one_row)  # one row each
    return out.withColumn("seconds", F.lit(float(seconds)))
