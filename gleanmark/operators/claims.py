"""Claim mining: keyword de-duplication and attribution by inverted keyword lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanmark.functions.text import keywords
from gleanmark.operators.graph import stored, width

#: Similarity limits of verdicts, and the least attribution.
IDENTICAL, SIMILAR, ATTRIBUTED = 0.70, 0.45, 0.35


def keyed(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, n, k): a row for each keyword of each text, with the number of the text's keywords."""
    return df.select(F.col(key), keywords(text).alias("ks")).select(key, F.size("ks").alias("n"), F.explode("ks").alias("k"))


def overlaps(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that share a keyword, each of them: a, b, n_a, n_b and shared. One side must be few."""
    x = left.select(a, F.col("n").alias("n_a"), "k")
    y = right.select(b, F.col("n").alias("n_b"), "k")
    return x.join(y, "k").groupBy(a, b, "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"))


def verdict(similarity: Column) -> Column:
    return F.when(similarity >= IDENTICAL, "identical").when(similarity >= SIMILAR, "similar").otherwise("new")


def keyword_sets(df: DataFrame, key: str, text: Column) -> DataFrame:
    """key and ks, the keywords of each text in order."""
    return df.select(F.col(key), F.array_sort(keywords(text)).alias("ks"))


#: Rows of a block of sketches, about; words (of 64 bits) of the shortest and of the longest sketch, as powers of 2.
TILE, SHORTEST, LONGEST = 4096, 3, 9
#: Claims and nodes of a block whose words are counted; claims of it that are counted at once, and words for which that is a product of matrices.
CLAIMS, NODES, STEP, DENSE = 1 << 12, 1 << 13, 128, 512
#: Keys up to which those of pairs go to every task.
FEW = 1 << 18


def _sketched(rows: DataFrame, key: str) -> DataFrame:
    """``key``, n, g and sketch of each set (key, ks): its size, twice the logarithm of it, and the parity of its words' hashes at each of some four
    bits a word. A sketch folds to any shorter one, and two sketches differ in no more bits than their sets in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = batch.column(3)
                sizes = np.diff(lists.offsets.to_numpy())
                hashes = lists.flatten().to_numpy().view(np.uint64)
                words = 1 << np.clip(np.ceil((batch.column(2).to_numpy() + 1) / 2).astype(np.int64) - 4, SHORTEST, LONGEST)
                starts = 64 * (np.cumsum(words) - words)
                places = np.repeat(starts, sizes) + (hashes & np.repeat(64 * words - 1, sizes).astype(np.uint64)).astype(np.int64)
                packed = np.packbits((np.bincount(places, minlength=64 * words.sum()) & 1).astype(np.uint8), bitorder="little").tobytes()
                told = [packed[s // 8 : s // 8 + 8 * w] for s, w in zip(starts.tolist(), words.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(told, pa.binary())], names=[key, "n", "g", "sketch"])

    hashed = rows.where(F.size("ks") > 0).select(key, F.size("ks").alias("n"), F.floor(2 * F.log2(F.size("ks"))).cast("int").alias("g"), F.transform("ks", lambda k: F.xxhash64(k)).alias("h"))
    return hashed.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, n int, g int, sketch binary")


def _folded(table: pa.Table, words: int) -> np.ndarray:
    """The sketches of a block, which are of one length, each folded to so many words: an array of words by rows."""
    whole = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(table.num_rows, -1, words)
    return np.ascontiguousarray(np.bitwise_xor.reduce(whole, axis=1).T)


def _near(a: str, b: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Pairs of two blocks whose sketches differ in so few bits that 29 times their sets' difference can be 11 times their sizes or less. Sketches
    folded to half their length are held against each other first; that leaves few of the others."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words = min(len(table["sketch"][0].as_py()) for table in (left, right)) // 8
        mine, other = _folded(left, words), _folded(right, words)
        half = max(words // 2, 1)
        short, far = (x[:half] ^ x[half:] if half < words else x for x in (mine, other))
        n_a, n_b = left["n"].to_numpy().astype(np.int32), right["n"].to_numpy().astype(np.int32)
        mixed, count = np.empty_like(far), np.empty(far.shape, np.uint8)
        differ, room = np.empty(len(n_b), np.int32), 11 * n_b
        at_a, at_b = [], []
        for i, n in enumerate(n_a.tolist()):
            np.bitwise_xor(far, short[:, i : i + 1], out=mixed)
            np.bitwise_count(mixed, out=count)
            np.add.reduce(count, axis=0, dtype=np.int32, out=differ)
            np.multiply(differ, 29, out=differ)
            np.subtract(differ, room, out=differ)
            found = np.flatnonzero(differ <= 11 * n)
            if len(found):
                m = n_b[found]
                found = found[20 * np.minimum(m, n) >= 9 * np.maximum(m, n)]
                whole = np.bitwise_count(other[:, found] ^ mine[:, i : i + 1]).sum(axis=0, dtype=np.int32)
                found = found[29 * whole <= 11 * (n_b[found] + n)].astype(np.int32)
                at_a.append(np.full(len(found), i, np.int32))
                at_b.append(found)
        none = [np.zeros(0, np.int32)]
        return pa.table({a: left[a].take(pa.array(np.concatenate(at_a or none))), b: right[b].take(pa.array(np.concatenate(at_b or none)))})

    return run


def _blocks(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` stored as blocks: ``by`` and one array of the other columns. Each goes into one file, in as many tasks as hold some blocks each."""
    others = [c for c in rows.columns if c not in by]
    dealt = rows.repartition(width(rows.sparkSession, rows.count()), *by)
    return stored(dealt.groupBy(*by).agg(F.collect_list(F.struct(*others)).alias(name)))


#: Rows that a Python worker is handed at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _met(left: DataFrame, right: DataFrame, fits: Column, run: Callable[[pa.Table, pa.Table], pa.Table], kinds: str) -> DataFrame:
    """What ``run`` makes of all pairs of a block of ``left`` (x) and one of ``right`` (y) that ``fits``, stored.

    The pairs are a plain product: each task reads some blocks of either side where they are stored, so that nothing is shuffled or written for a pair,
    and its memory doesn't grow with the number of blocks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (pa.Table.from_batches([pa.RecordBatch.from_struct_array(column.slice(i, 1).flatten())]) for column in batch.columns)
                yield from run(x, y).to_batches()

    spark = left.sparkSession
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "1")
    try:
        return stored(left.join(right.hint("shuffle_replicate_nl"), fits).select("x", "y").mapInArrow(each, kinds))
    finally:
        spark.conf.set(BATCH, before)


def similar(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of ``left`` (a, ks) and ``right`` (b, ks) with a Jaccard similarity of at least 0.45: a, b, similarity.

    At so low a limit the rarest words that two sets must share are half of all, and candidates by word are more than there are pairs. So
    blocks of short sketches meet, only of sizes that fit together, and sets are compared for the pairs whose sketches let them pass, which are all
    that are similar and few others. What is shuffled are sketches, once, and the sets of those pairs."""
    sets_a, sets_b = (stored(rows.select(key, "ks")) for rows, key in ((left, a), (right, b)))

    def blocks(sets: DataFrame, key: str, g: str, name: str) -> DataFrame:
        rows = stored(_sketched(sets, key))
        many = {r["g"]: -(-r["count"] // TILE) for r in rows.groupBy("g").count().collect()}
        # One number for each power of the root of 2: into how many blocks the sets of that size go.
        told = F.create_map(*[F.lit(x) for pair in (many or {0: 1}).items() for x in pair])
        slices = F.pmod(F.xxhash64(key), told[F.col("g")].cast("long"))
        return _blocks(rows.withColumn("s", slices).withColumnRenamed("g", g), [g, "s"], name).drop("s")

    x, y = blocks(sets_a, a, "g_a", "x"), blocks(sets_b, b, "g_b", "y")
    kinds = f"{a} {dict(left.dtypes)[a]}, {b} {dict(right.dtypes)[b]}"
    pairs = _met(x, y, F.abs(F.col("g_a") - F.col("g_b")) <= 3, _near(a, b), kinds)

    def asked(sets: DataFrame, key: str) -> DataFrame:
        """The sets of the pairs; few pairs spare the others the shuffle of the join."""
        some = stored(pairs.select(key).distinct())
        return sets.join(F.broadcast(some), key, "left_semi") if some.count() <= FEW else sets

    both = pairs.join(asked(sets_a, a).withColumnRenamed("ks", "ks_a"), a).join(asked(sets_b, b).withColumnRenamed("ks", "ks_b"), b)
    shared = F.size(F.array_intersect("ks_a", "ks_b"))
    return both.select(a, b, (shared / (F.size("ks_a") + F.size("ks_b") - shared)).alias("similarity")).where(F.col("similarity") >= SIMILAR)


def _best(pairs: DataFrame) -> DataFrame:
    """The most similar match of each claim, equals by match_id."""
    best = pairs.groupBy("claim_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "match_id")).alias("r"))
    return best.select("claim_id", "r.match_id", (-F.col("r.s")).alias("similarity"))


def _told(new: DataFrame, best: DataFrame) -> DataFrame:
    out = new.select("claim_id").join(best, "claim_id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    return out.select("claim_id", "match_id", F.round("similarity", 6).alias("similarity"), verdict(F.col("similarity")).alias("verdict"))


def duplicates(new: DataFrame, known: DataFrame) -> DataFrame:
    """The most similar known claim of each new one (claim_id, statement in both): Jaccard similarity of keywords,
    equals by claim_id. A claim that resembles none by 0.45 is new, with no match and similarity 0."""
    told = lambda df, name: keyword_sets(df.withColumnRenamed("claim_id", name), name, F.col("statement"))
    return _told(new, _best(similar(told(new, "claim_id"), told(known, "match_id"), "claim_id", "match_id")))


def registered(new: DataFrame, known: DataFrame, eligible: Column | None = None) -> DataFrame:
    """The verdicts of ``duplicates`` as if the new claims (claim_id, place, statement) came one by one, in order of place (unique), and each that
    isn't identical to a claim before it, and is ``eligible``, were known to those after it: claim_id, match_id, similarity, verdict.

    Whether a claim is accepted hangs on the accepted ones before it, so that claims are settled in rounds: one all
    of whose identical forerunners are refused is accepted, one with an accepted forerunner is refused. Claims with equal
    keyword sets are settled as one, at the place of the first that is eligible, until they are told their matches.
    """
    may = new.select("claim_id", "place", (F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))).alias("may"))
    sets = keyword_sets(new, "claim_id", F.col("statement")).where(F.size("ks") > 0).join(may, "claim_id")
    sets = stored(sets.select("claim_id", "place", "ks", F.when(F.col("may"), F.struct("place", "claim_id")).alias("first")))
    groups = stored(sets.groupBy("ks").agg(F.min("claim_id").alias("sid"), F.min("first").alias("first")).select("sid", "ks", F.col("first.place").alias("own"), F.col("first.claim_id").alias("lead")))
    members = stored(sets.join(groups, "ks").select("claim_id", "place", "sid", "own", "lead"))
    outer = stored(similar(groups.select("sid", "ks"), keyword_sets(known.withColumnRenamed("claim_id", "match_id"), "match_id", F.col("statement")), "sid", "match_id"))
    inner = similar(groups.select("sid", "ks"), groups.select(F.col("sid").alias("other"), "ks"), "sid", "other").where("sid <> other")
    live = groups.where("own is not null")
    inner = stored(inner.join(groups.select("sid", "own"), "sid").join(live.select(F.col("sid").alias("other"), F.col("own").alias("before"), F.col("lead").alias("match_id")), "other"))
    settled = stored(outer.where(F.col("similarity") >= IDENTICAL).select("sid").distinct().withColumn("accepted", F.lit(False)))
    # Claims that wait for an identical one before them; all others are accepted.
    waits = stored(inner.where((F.col("similarity") >= IDENTICAL) & (F.col("before") < F.col("own"))).select("sid", "other").join(settled, "sid", "left_anti"))
    free = live.select("sid").join(settled, "sid", "left_anti").join(waits.select("sid"), "sid", "left_anti")
    settled = stored(settled.unionByName(free.withColumn("accepted", F.lit(True))))
    while waits.take(1):
        met = waits.join(settled.withColumnRenamed("sid", "other"), "other", "left")
        now = met.groupBy("sid").agg(F.max(F.coalesce("accepted", F.lit(False))).alias("met"), F.count_if(F.col("accepted").isNull()).alias("open"))
        fresh = stored(now.where("met or open = 0").select("sid", (~F.col("met")).alias("accepted")))
        settled = stored(settled.unionByName(fresh))
        waits = stored(waits.join(fresh, "sid", "left_anti"))
    taken = settled.where("accepted").select("sid")
    same = members.where("place > own").join(taken, "sid").select("claim_id", F.col("lead").alias("match_id"), F.lit(1.0).alias("similarity"))
    # A later copy may have nearer ones before it than the first had.
    near = inner.drop("own").join(taken.withColumnRenamed("sid", "other"), "other").join(members.select("claim_id", "place", "sid"), "sid").where("before < place").select("claim_id", "match_id", "similarity")
    far = outer.join(members, "sid").select("claim_id", "match_id", "similarity")
    return _told(new, _best(same.unionByName(near).unionByName(far)))


def node_keywords(nodes: DataFrame, statements: DataFrame, synonyms: DataFrame) -> DataFrame:
    """id and ks: the keywords of each node's (id, title, type) title, type and statements (id, statement), with the ``synonyms`` (term, words: array) of its
    title and of the runs of Han characters in all of them, so that claims in another language meet it."""
    han = lambda text: F.regexp_extract_all(text, F.lit("[\\x{4e00}-\\x{9fff}]{2,}"), F.lit(0))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = nodes.select("id", F.concat(keywords(text("title")), keywords(text("type"))).alias("k"), F.array_append(han(text("title")), text("title")).alias("t"))
    said = statements.join(nodes.select("id"), "id", "left_semi").select("id", keywords(text("statement")).alias("k"), han(text("statement")).alias("t"))
    every = stored(own.unionByName(said))
    more = every.select("id", F.explode(F.array_distinct("t")).alias("term")).distinct().join(synonyms, "term").select("id", F.explode("words").alias("k"))
    plain = every.select("id", F.explode("k").alias("k")).unionByName(more).distinct()
    return plain.groupBy("id").agg(F.array_sort(F.collect_list("k")).alias("ks"))


def _covering(left: pa.Table, right: pa.Table) -> pa.Table:
    """The best node of a block for each claim of another (claim_id, n, h) by the larger coverage: claim_id, id, shared and n_b. Words are counted for all
    pairs: those that many of the nodes have by a product of matrices, the others by lists of the nodes that have each."""
    at, nodes, common = [], [], []
    right = right.take(pa.compute.sort_indices(right["id"]))
    lists = right["h"].combine_chunks()
    flat = lists.flatten().to_numpy()
    by_word = np.argsort(flat, kind="stable")
    rows = np.repeat(np.arange(right.num_rows, dtype=np.int32), np.diff(lists.offsets.to_numpy()))[by_word]
    words, starts = np.unique(flat[by_word], return_index=True)
    ends = np.append(starts[1:], len(flat))
    sizes = right["n"].to_numpy().astype(np.float64)
    frequent = np.argsort(starts - ends, kind="stable")[:DENSE]
    frequent = frequent[(ends - starts)[frequent] * 32 > right.num_rows]
    column = np.full(len(words) + 1, -1, np.int32)
    column[frequent] = np.arange(len(frequent), dtype=np.int32)
    theirs = np.zeros((len(frequent), right.num_rows), np.float32)
    for i, w in enumerate(frequent.tolist()):
        theirs[i, rows[starts[w] : ends[w]]] = 1
    mine = left["h"].combine_chunks()
    every, offsets = mine.flatten().to_numpy(), mine.offsets.to_numpy() - mine.offsets[0].as_py()
    places = np.searchsorted(words, every)
    places[places == len(words)] = 0
    met = words[places] == every
    counts = left["n"].to_numpy()
    for first in range(0, left.num_rows, STEP):
        some = range(first, min(first + STEP, left.num_rows))
        own = [places[offsets[i] : offsets[i + 1]][met[offsets[i] : offsets[i + 1]]] for i in some]
        has = np.zeros((len(own), len(frequent)), np.float32)
        for row, held in zip(has, own, strict=True):
            row[column[held][column[held] >= 0]] = 1
        shared = has @ theirs
        for row, held in zip(shared, own, strict=True):
            rare = held[column[held] < 0]
            if len(rare):
                row += np.bincount(np.concatenate([rows[starts[w] : ends[w]] for w in rare.tolist()]), minlength=len(row))
        # The first of the largest is the least id.
        best = np.argmax(shared / np.minimum(sizes, counts[first : first + len(own), None]), axis=1)
        most = shared[np.arange(len(own)), best].astype(np.int64)
        there = np.flatnonzero(most)
        at.append(first + there)
        nodes.append(best[there])
        common.append(most[there])
    at, nodes, common = (pa.array(np.concatenate(x or [np.zeros(0, np.int64)])) for x in (at, nodes, common))
    return pa.table({"claim_id": left["claim_id"].take(at), "id": right["id"].take(nodes), "shared": common, "n_b": right["n"].take(nodes)})


def attributed(claims: DataFrame, nodes: DataFrame, least: float = ATTRIBUTED) -> DataFrame:
    """The node (of ``nodes``: id, ks) that suits each claim (claim_id, ks, subject_ks) best, where its score is ``least`` or more: claim_id, node_id, score. The score is
    the largest of both coverages, their mean, and 1.5 times the share of the subject's keywords; equals go by id.

    Subjects are settled first, once for each different one: what gives more than 1 is beyond any coverage. The other claims meet all nodes in blocks, that hand on
    one node for each claim; the mean is never above the larger coverage. Words are compared by 64-bit hashes there."""
    empty = F.array().cast("array<string>")
    every = claims.select("claim_id", F.array_union("ks", F.coalesce("subject_ks", empty)).alias("ks"), F.array_sort(F.array_distinct(F.coalesce("subject_ks", empty))).alias("ss")).where(F.size("ks") > 0)
    every, nodes = stored(every), stored(nodes.where(F.size("ks") > 0).select("id", "ks"))
    subjects = every.where(F.size("ss") > 0).select("ss").distinct().select("ss", F.explode("ss").alias("k"))
    shares = subjects.join(nodes.select("id", F.explode("ks").alias("k")), "k").groupBy("ss", "id").agg((1.5 * F.count(F.lit(1)) / F.size("ss")).alias("score"))
    top = stored(shares.groupBy("ss").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("r")))
    told = every.join(top, "ss", "left").select("claim_id", "ks", F.col("r.id").alias("id"), (-F.col("r.s")).alias("score"))
    told = stored(told)
    hashes = F.transform("ks", lambda k: F.xxhash64(k)).alias("h")
    open_ = told.where("score is null or score <= 1").select("claim_id", F.size("ks").alias("n"), hashes)
    slice_ = lambda rows, key, most: F.pmod(F.xxhash64(key), F.lit(max(1, -(-rows.count() // most)))).alias("s")
    x = _blocks(open_.select(slice_(open_, "claim_id", CLAIMS), "claim_id", "n", "h"), ["s"], "x").drop("s")
    y = _blocks(nodes.select(slice_(nodes, "id", NODES), "id", F.size("ks").alias("n"), hashes), ["s"], "y").drop("s")
    kinds = f"claim_id {dict(claims.dtypes)['claim_id']}, id {dict(nodes.dtypes)['id']}, shared long, n_b int"
    met = _met(x, y, F.lit(True), _covering, kinds).join(told.select("claim_id", F.size("ks").alias("n_a")), "claim_id")
    covered = met.select("claim_id", "id", F.greatest(F.col("shared") / F.col("n_a"), F.col("shared") / F.col("n_b")).alias("score"))
    found = told.where("id is not null").select("claim_id", "id", "score").unionByName(covered)
    best = found.where(F.col("score") >= least).groupBy("claim_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("r"))
    return best.select("claim_id", F.col("r.id").alias("node_id"), (-F.col("r.s")).alias("score"))


#: What kind of claim each type of statement becomes; all others are empirical.
KINDS = {"empirical": "empirical", "theoretical": "theorem", "methodological": "empirical", "definitional": "definition"}


def mined(found: DataFrame, known: DataFrame, nodes: DataFrame) -> DataFrame:
    """What becomes of each statement that was found: ``found`` (evidence_id, index, place, text, subjects, claim_type, confidence, attribution, review_required; place is the order
    of all) against ``known`` claims (claim_id, statement) and ``nodes`` (id, ks). claim_id, action, match_id, similarity, node_id and kind.

    What waits for a review, or is background, is deferred; a blank text is left out. Then, in this order, a claim identical to one before it
    is a duplicate, one that suits no node is unresolved, one whose id is known already_exists, and the others are new and
    known to those that follow. Guesses become hypotheses."""
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    rows = found.withColumn("claim_id", F.concat(F.col("evidence_id"), F.lit("#mined-"), F.col("index").cast("string"))).withColumn("statement", text)
    waits = F.coalesce(F.col("review_required"), F.lit(False)) | F.coalesce(F.col("attribution") == "background", F.lit(False))
    rows = stored(rows.where(waits | (F.coalesce("statement", F.lit("")) != "")).withColumn("waits", waits))
    live = rows.where("not waits")
    subjects = F.array_distinct(F.flatten(F.transform(F.coalesce("subjects", F.array().cast("array<string>")), lambda s: keywords(F.coalesce(s, F.lit(""))))))
    at = stored(attributed(live.select("claim_id", keywords(F.col("statement")).alias("ks"), subjects.alias("subject_ks")), nodes))
    there = known.select("claim_id", F.lit(True).alias("there"))
    asked = stored(live.join(at.select("claim_id", "node_id"), "claim_id", "left").join(there, "claim_id", "left").select("claim_id", "place", "statement", "node_id", F.coalesce("there", F.lit(False)).alias("there"), "claim_type", "confidence", "attribution"))
    told = registered(asked, known, F.col("node_id").isNotNull() & ~F.col("there"))
    action = F.when(F.col("verdict") == "identical", "duplicate").when(F.col("node_id").isNull(), "unresolved").when(F.col("there"), "already_exists").otherwise("new")
    guess = F.coalesce(F.col("confidence") == "speculative", F.lit(False)) | F.coalesce(F.col("attribution") == "hypothesis", F.lit(False))
    kind = F.when(guess, "application_hypothesis").otherwise(F.coalesce(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.coalesce("claim_type", F.lit(""))], F.lit("empirical")))
    done = asked.join(told, "claim_id").withColumn("action", action).select("claim_id", "action", "match_id", "similarity", F.when(F.col("action") == "new", F.col("node_id")).alias("node_id"), F.when(F.col("action") == "new", kind).alias("kind"))
    later = rows.where("waits").select("claim_id", F.lit("deferred").alias("action"), *[F.lit(None).cast(t).alias(c) for c, t in (("match_id", "string"), ("similarity", "double"), ("node_id", "string"), ("kind", "string"))])
    return done.unionByName(later)


def attribution(claims: DataFrame, statements: DataFrame) -> DataFrame:
    """The node that suits each claim (claim_id, statement) best among the nodes of ``statements`` (id, statement,
    many rows a node): the largest of both coverages and their mean; under 0.35 none."""
    words = statements.select("id", F.explode(keywords(F.col("statement"))).alias("k")).distinct()
    nodes = words.join(words.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n")), "id")
    pairs = overlaps(keyed(claims, "claim_id", F.col("statement")), nodes, "claim_id", "id")
    there, back = F.col("shared") / F.col("n_a"), F.col("shared") / F.col("n_b")
    pairs = pairs.withColumn("score", F.greatest(there, back, (there + back) / 2))
    best = pairs.withColumn("_r", F.row_number().over(W.partitionBy("claim_id").orderBy(F.desc("score"), "id"))).where("_r = 1")
    return best.select("claim_id", F.when(F.col("score") >= ATTRIBUTED, F.col("id")).alias("node_id"), F.round("score", 6).alias("score"))
