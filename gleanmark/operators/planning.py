"""Questions, scopes, topics and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanmark.operators.matching import hits

#: Edge types in the order in which they are tried, and what stands for all others.
EDGE_TYPES = ("ABSTRACTS_FROM", "DERIVES_FROM", "FORMALIZED_BY", "HAS_SCOPED_INSTANCE", "COMPLEMENTS")


def in_scope(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, claim_id) for which every group of the claim's terms has one that the query contains.

    ``rules`` is a table (claim_id, group, term); full-width letters count as plain ones, and an empty term is contained in nothing."""
    plain = F.lower(F.translate("query", "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))))
    told = rules.select("claim_id", "group", F.lower("term").alias("pattern"))
    met = hits(queries, "query_id", plain, told).join(told, "pattern").select("query_id", "claim_id", "group").distinct()
    needed = rules.groupBy("claim_id").agg(F.count_distinct("group").alias("needed"))
    return met.groupBy("query_id", "claim_id").agg(F.count(F.lit(1)).alias("n")).join(needed, "claim_id").where("n = needed").select("query_id", "claim_id")


def answer(allowed: DataFrame, chosen: DataFrame) -> DataFrame:
    """What may be answered: status and the ids of the claims, sorted. ``allowed`` and ``chosen`` are (query_id,
    claim_id). A choice outside what is allowed spoils the whole answer."""
    may = allowed.groupBy("query_id").agg(F.collect_set("claim_id").alias("may"))
    picked = chosen.groupBy("query_id").agg(F.collect_set("claim_id").alias("picked"))
    both = may.join(picked, "query_id", "full")
    bad = F.size(F.array_except("picked", F.coalesce("may", F.array().cast("array<string>")))) > 0
    status = F.when(F.col("may").isNull(), "nothing_in_scope").when(F.col("picked").isNull(), "nothing_chosen").when(bad, "outside_scope").otherwise("answered")
    return both.select("query_id", status.alias("status"), F.when(status == "answered", F.array_join(F.sort_array("picked"), ",")).alias("claims"))


def edge_type(raw: Column) -> Column:
    """A known edge type for a free wording: itself, or the first that contains it or is contained in it."""
    plain = F.replace(F.upper(F.trim(raw)), F.lit(" "), F.lit("_"))
    known = F.array(*map(F.lit, EDGE_TYPES))
    close = F.filter(known, lambda k: k.contains(plain) | plain.contains(k))
    return F.when(F.array_contains(known, plain), plain).otherwise(F.coalesce(F.get(close, 0), F.lit(EDGE_TYPES[-1])))


def lattice(cards: DataFrame, single: tuple[str, ...], double: tuple[str, ...]) -> DataFrame:
    """Questions on each card (id, title) and on each unordered pair of cards: id_a, id_b, question, each once."""
    one = cards.select(F.col("id").alias("id_a"), F.lit(None).cast("string").alias("id_b"), F.explode(F.array(*[F.replace(F.lit(t), F.lit("{a}"), F.col("title")) for t in single])).alias("question"))
    b = cards.select(F.col("id").alias("id_b"), F.col("title").alias("other"))
    # A pair for each two cards is what is asked for; the cards are a catalogue, not a corpus.
    pairs = cards.join(b, F.col("id") < F.col("id_b"))
    two = pairs.select(F.col("id").alias("id_a"), "id_b", F.explode(F.array(*[F.replace(F.replace(F.lit(t), F.lit("{a}"), F.col("title")), F.lit("{b}"), F.col("other")) for t in double])).alias("question"))
    return one.unionByName(two).dropDuplicates(["question"])


def plan(gaps: DataFrame, most: int) -> DataFrame:
    """The first gap of each card by origin, kind and time, ``most`` of them, with the plan's id: a digest of its gaps."""
    first = gaps.withColumn("_r", F.row_number().over(W.partitionBy("card").orderBy("origin_rank", "kind_rank", "created", "gap_id"))).where("_r = 1").drop("_r")
    best = first.orderBy("origin_rank", "kind_rank", "created", "gap_id").limit(most)
    every = F.array_join(F.sort_array(F.collect_list("gap_id").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))), ",")
    return best.withColumn("plan_id", F.concat(F.lit("P-"), F.substring(F.sha2(every, 256), 1, 16)))


def live_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are live, with shortened labels: what a viewer shows."""
    from gleanmark.functions.text import shorten

    live = nodes.where("status <> 'superseded'").groupBy("id").agg(F.max_by("title", "revision").alias("title"))
    for end in ("from", "to"):
        edges = edges.join(live.select(F.col("id").alias(f"{end}_node"), shorten(F.col("title"), 12).alias(f"{end}_label")), f"{end}_node")
    return edges.select("edge_id", "type", "from_node", "to_node", "from_label", "to_label")


def coverage(questions: DataFrame, cards: DataFrame) -> DataFrame:
    """How ready the cards of each question (id, card_id: a row for each expected card) are: ``cards`` (card_id, status, sourced). id and result: gap where
    a card is missing or without sources, else accepted_ready, revision_required, deferred or draft_only."""
    met = questions.join(cards, "card_id", "left")
    told = met.groupBy("id").agg(F.bool_or(F.col("status").isNull() | ~F.coalesce("sourced", F.lit(False))).alias("gap"), F.array_sort(F.collect_set("status")).alias("s"))
    has = lambda x: F.array_contains("s", x)
    result = F.when(F.col("gap"), "gap").when(F.col("s") == F.array(F.lit("accepted")), "accepted_ready").when(has("revise"), "revision_required").when(has("defer"), "deferred").otherwise("draft_only")
    return told.select("id", result.alias("result"), F.array_join("s", ",").alias("statuses"))


def claim_audit(claims: DataFrame) -> DataFrame:
    """Which cards are ready for review, from their claims (card_id, claim_id, type, disposition): card_id, derived, supported, unresolved and hypotheses (ids in
    order) and review_ready: there are derived claims, all of them supported."""
    derived, good = F.col("type") == "lecture_derived", F.coalesce(F.col("disposition") == "supported_by_search_excerpt", F.lit(False))
    listed = lambda when: F.array_join(F.array_sort(F.collect_list(F.when(when, F.col("claim_id")))), ",")
    told = claims.groupBy("card_id").agg(F.count_if(derived).alias("derived"), F.count_if(derived & good).alias("supported"), listed(derived & ~good).alias("unresolved"), listed(F.col("type") == "application_hypothesis").alias("hypotheses"))
    return told.withColumn("review_ready", (F.col("derived") > 0) & (F.col("derived") == F.col("supported")))


def expansion(seeds: DataFrame, used: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """Seeds (domain, alignment, bridges: array) that may be grown into, the best first by score: those of domains not ``used`` (domain) that have ``least``
    bridges among ``nodes`` (id). domain, bridge_count, score."""
    free = seeds.join(used.select("domain"), "domain", "left_anti").select("domain", "alignment", F.explode("bridges").alias("id"))
    met = free.join(nodes.select("id").distinct(), "id", "left_semi").groupBy("domain", "alignment").agg(F.count(F.lit(1)).alias("bridge_count")).where(F.col("bridge_count") >= least)
    strength = F.least(F.col("bridge_count") / 3.0, F.lit(1.0))
    return met.select("domain", "bridge_count", F.round(0.45 * F.col("alignment") + 0.35 * strength + 0.20 * 0.7, 6).alias("score"))


def topics(nodes: DataFrame, templates: dict[str, str], most: int) -> DataFrame:
    """What to ask next: of the nodes (id, title, score, least_covered: facets joined by commas), the best first, a question for each facet in turn, by its
    template ({concept} is the title; an unknown facet takes the first). place (from 1), id, facet and query, ``most`` at most."""
    facets = nodes.where("least_covered <> ''").select("id", "title", "score", F.posexplode(F.split("least_covered", ",")).alias("turn", "facet"))
    best = facets.orderBy(F.desc("score"), "id", "turn").limit(most)
    texts = F.create_map(*[F.lit(x) for pair in templates.items() for x in pair])
    query = F.replace(F.coalesce(texts[F.col("facet")], F.lit(next(iter(templates.values())))), F.lit("{concept}"), F.coalesce("title", F.lit("")))
    return best.select(F.row_number().over(W.orderBy(F.desc("score"), "id", "turn")).alias("place"), "id", "facet", query.alias("query"))
