"""Upkeep of indexes, logs and queues: merges, gates, routing and the states that follow from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The grades of sources that are carried on.
GRADED = ("A", "B", "C")


def apply_upsert(index: DataFrame, manifest: DataFrame, current: DataFrame) -> DataFrame:
    """An index (path, content) after maintenance: rows of unchanged paths stay, those of changed and
    vanished ones go, and the contents of new and changed ones come in. ``manifest`` and ``current`` have path
    and digest, ``current`` content too. A null digest counts as changed."""
    same = current.join(manifest.select("path", F.col("digest").alias("old")), "path", "left").withColumn("same", F.coalesce(F.col("old") == F.col("digest"), F.lit(False)))
    kept = index.join(same.where("same").select("path"), "path", "left_semi").select("path", "content", F.lit("kept").alias("origin"))
    return kept.unionByName(same.where("not same").select("path", "content", F.lit("written").alias("origin")))


def fresh(index: DataFrame, current: DataFrame) -> DataFrame:
    """``index`` (path, digest) with usable: whether the file still is what was indexed. A file that is gone isn't."""
    now = current.select("path", F.col("digest").alias("now"))
    return index.join(now, "path", "left").withColumn("usable", F.coalesce(F.col("now") == F.col("digest"), F.lit(False))).drop("now")


def max_merge(stored: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage never falls and attempts add up: ``stored`` has coverage and attempts by ``keys``, each row of ``seen`` is one attempt."""
    every = stored.select(*keys, "coverage", "attempts").unionByName(seen.select(*keys, "coverage", F.lit(1).cast("long").alias("attempts")))
    return every.groupBy(*keys).agg(F.max("coverage").alias("coverage"), F.sum("attempts").alias("attempts"))


def latest_upsert(stored: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the one of the highest ``order``, of ``new`` among equals."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("r")).select(key, "r.*")


def unlinked(amplified: DataFrame, supports: DataFrame) -> DataFrame:
    """Graded evidence that was found for a claim (claim_id, evidence_id, grade, relevance) and isn't linked to it yet."""
    open_ = amplified.where(F.col("grade").isin(*GRADED) & (F.col("relevance") != "irrelevant"))
    linked = supports.select(F.col("target_claim").alias("claim_id"), "evidence_id").distinct()
    return open_.join(linked, ["claim_id", "evidence_id"], "left_anti")


def backlog(mined: DataFrame, processed: DataFrame) -> DataFrame:
    """Mined sources (source, unresolved) that left claims unresolved and weren't processed since."""
    return mined.where("unresolved > 0").join(processed.select("source").distinct(), "source", "left_anti")


def register(found: DataFrame, known: DataFrame) -> DataFrame:
    """Verified sources (id, doi, grade) that become evidence: those with a DOI, not rejected and not known;
    grades other than A and B are C."""
    good = found.where("doi is not null and coalesce(grade, '') <> 'REJECTED'").join(known.select("id"), "id", "left_anti")
    return good.withColumn("grade", F.when(F.col("grade").isin("A", "B"), F.col("grade")).otherwise("C"))


def agreement(n_sources: Column, n_with: Column, n_values: Column) -> Column:
    """What several sources say of one identifier: their number, how many have one, and how many differ."""
    return F.when(n_with == 0, "no_doi_from_any").when(n_with == 1, "single_source").when((n_values == 1) & (n_with == n_sources), "unanimous").when(n_values == 1, "agreed").otherwise("disagreement")


def recent(runs: DataFrame, key: str, cycle: str, good: Column, last: int = 5) -> DataFrame:
    """Runs and successes of the last ``last`` cycles up to each row's, the penalty for running often, and whether to stop:
    six runs or more without a success."""
    w = W.partitionBy(key).orderBy(cycle).rangeBetween(-(last - 1), 0)
    out = runs.withColumn("runs", F.count(F.lit(1)).over(w)).withColumn("successes", F.count_if(good).over(w))
    out = out.withColumn("penalty", F.least(F.lit(1.0), (F.col("runs") - 1) / 2.0))
    return out.withColumn("stop", (F.col("runs") >= 6) & (F.col("successes") == 0))


def safety(reachability: Column, red: Column, stop: Column) -> Column:
    """The reasons not to go on, as one text."""
    reasons = F.array_compact(F.array(F.when(reachability < 0.80, "reachability"), F.when(red, "red"), F.when(stop, "no_success")))
    return F.array_join(reasons, ",")


def node_faults(layer: Column, parent: Column, parent_known: Column, edge: Column, differs: Column) -> Column:
    """Why a new node can't be taken in, as one text: rules of layer, parent, edge and difference."""
    rules = F.array(
        F.when(~F.coalesce(layer.isin("foundation", "science", "universe", "practice"), F.lit(False)), "layer"),
        F.when(parent.isNull(), "no_parent").when(~F.coalesce(parent_known, F.lit(False)), "unknown_parent"),
        F.when(edge.isNull(), "no_edge"),
        F.when(F.coalesce(F.length(differs), F.lit(0)) < 10, "indistinct"),
    )
    return F.array_join(F.array_compact(rules), ",")


def shape_ok(candidates: Column, sources: Column, allowed: Column) -> Column:
    """One to eight candidates, none empty, with no source but the allowed ones. Nulls fail."""
    named = F.forall(candidates, lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False)))
    return F.coalesce(F.size(candidates).between(1, 8) & named & (F.size(F.array_except(sources, allowed)) == 0), F.lit(False))


def relevance(claim: Column, text: Column) -> Column:
    """How much of a claim its source's text has: the share of its words of four letters or more, repeats counted."""
    words = F.regexp_extract_all(F.lower(claim), F.lit(r"[a-z]{4,}"), F.lit(0))
    found = F.size(F.filter(words, lambda w: F.contains(F.lower(text), w))) / F.size(words)
    return F.when(F.size(words) == 0, "unknown").when(found >= 0.4, "likely").when(found >= 0.2, "possible").otherwise("unlikely")


def state_of(log: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The state that a log of changes leaves each key in, and how often it changed."""
    w = W.partitionBy(key).orderBy(*order)
    moved = log.withColumn("_moved", (~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("int"))
    return moved.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"), F.sum("_moved").alias("changes"))


def reusable(wanted: DataFrame, known: DataFrame, digests: list[str], key: str) -> DataFrame:
    """``wanted`` with reuse: whether a known check of the same key has the same digests, all of them."""
    had = known.select(key, *digests).distinct().withColumn("_had", F.lit(True))
    return wanted.join(had, [key, *digests], "left").withColumn("reuse", F.coalesce("_had", F.lit(False))).drop("_had")


def admitted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which each of the columns says something: nulls and blanks keep a row out."""
    for c in columns:
        rows = rows.where(F.length(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) > 0)
    return rows
