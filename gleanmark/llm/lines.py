"""Line de-duplication by an exact set-similarity join, with DataFrame functions only.

A line is the set of its words. Its words stand in one global order, rarest first. The join's keys are
neighbours in that order: a word that only one of two lines has parts at most two pairs of
neighbours in its own line and one in the other, so that two lines with a Jaccard similarity of at least 4/5
share a pair among the first two fifths of the pairs (and one) of each. Pairs of words, unlike
words, stay rare when the vocabulary is used up. What shares a pair passes a length and a positional
filter and is verified on whole sets. A line goes if any earlier line is that similar.

Rarity is counted over all different lines, in 2 ** 17 cells of the words' hashes; what shares a cell counts
as one. The order is the same for all lines whatever the counts, and only the number of candidates depends
on them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanmark.llm.common import WORD, discard, few, fresh, materialise, numbered

CELL_BITS = 17
#: Pairs of words of which the rarer one stands in more lines have their groups salted. Groups of other
#: pairs can't have more members than that.
HOT = 4096
#: Copies of a line up to which no salt deals them out.
COPIES = 64
#: Members up to which all lines of a group meet, if one that no other has settled finds another that fits; those of larger
#: groups also need their first common word.
SMALL = 1024
#: Parts of 64 bits of the maps by which the members of a group are held against each other.
MAPS = 4
#: Members of a group of which each is held against all before it at once; in larger ones each is held against the
#: earliest and the WHOLE - 1 before it first.
WHOLE = 16
#: Members of a group up to which one that fits no other goes no further.
MIDDLE = 128


def _words(line: Column) -> Column:
    """The different words of a line; runs of white space leave empty ones, which aren't words."""
    odd = F.lit(False)
    for space in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(space))
    parts = F.when(odd, F.split(line, r"[\x20\x09-\x0D]+")).otherwise(F.split(line, " "))
    return F.array_except(parts, F.array(F.lit("")))


def _lines(docs: DataFrame) -> DataFrame:
    """uid, d (doc_id), line_no, line and its name (n1, n2) of all lines with words; a null text has none."""
    lines = docs.select("uid", "d", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(WORD))
    return lines.select("*", F.xxhash64("line").alias("n1"), F.xxhash64(F.lit(1), "line").alias("n2"))


def _classes(lines: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Each different line with words once: cid (a number), first place (d, line_no, uid), n and c, hashes of its words;
    then the places of all lines that aren't the first of theirs, and the stored tables that both are read from.

    A line may stand in a third of all documents. The copies of the 2 ** 14 most frequent ones, which are all that can have
    more than that part of the lines, are dealt out by a salt and the first of all salts told afterwards.
    """
    often = lines.groupBy("n1").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > COPIES).orderBy(F.desc("k"), "n1").limit(1 << 14)
    often = materialise(often.select("n1", F.lit(64).alias("salts")), "often")
    rows = lines.select("n1", "n2", "uid", "d", "line_no", F.transform(_words(F.col("line")), lambda w: F.hash(w)).alias("c"))
    rows = rows.join(F.broadcast(often), "n1", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("uid"), F.col("salts")) + 1, F.lit(0)).cast("int"))
    place = F.struct("d", "line_no", "uid")
    by = W.partitionBy("n1", "n2", "salt").orderBy("d", "line_no", "uid")
    rows = rows.withColumn("opens", F.lag("uid").over(by).isNull())
    own = lambda x, when: F.when(when, F.col(x)).alias(x)
    hot = F.col("opens") & (F.col("salt") > 0)
    rows = rows.select(F.monotonically_increasing_id().alias("cid"), own("n1", hot), own("n2", hot), "uid", "d", "line_no", own("c", F.col("opens")), "opens", hot.alias("hot"))
    stored = materialise(rows, "classes", compression="zstd")
    heads = stored.where("hot").groupBy("n1", "n2").agg(F.min(place).alias("f"))
    some = materialise(stored.where("hot").join(heads, ["n1", "n2"]).withColumn("opens", place == F.col("f")).drop("f"), "copies")
    every = stored.where("not hot").unionByName(some)
    classes = every.where("opens").select("cid", "d", "line_no", "uid", F.size("c").alias("n"), "c")
    return classes, every.where("not opens").select("uid", "d", "line_no"), [stored, some, often]


def _map(part: int, parts: int) -> Column:
    """64 bits of the map of a line's words (c): those of one of 4 parts. Each word turns one bit round: two maps
    differ in no more bits than the lines do in words."""
    turn = lambda m, h: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h))
    return F.aggregate("c", F.lit(0).cast("long"), lambda m, h: F.when(h.bitwiseAND(F.lit(64 * (parts - 1))) == 64 * part, turn(m, h)).otherwise(m))


def levels(classes: DataFrame) -> DataFrame:
    """One row with one array: for each cell 8 times the binary logarithm of its words' count, rounded down,
    times 2 ** 32. It has 2 ** 17 places whatever the input."""
    cells = classes.select(F.explode("c").alias("h")).groupBy(F.shiftrightunsigned("h", 32 - CELL_BITS).alias("cell")).agg(F.count(F.lit(1)).alias("k"))
    every = classes.sparkSession.range(1 << CELL_BITS).select(F.col("id").cast("int").alias("cell"))
    told = every.join(cells, "cell", "left").select(F.struct("cell", F.floor(8 * F.log2(F.coalesce("k", F.lit(1)))).cast("long").alias("level")).alias("x"))
    return materialise(told.agg(F.array_sort(F.collect_list("x")).alias("x")).select(F.transform("x", lambda e: F.shiftleft(e.level, 32)).alias("level")), "levels")


#: Bits of a line's map, and of its numbers beside it: more words, and places, aren't told apart by the filters.
MAP_BITS, BITS = 44, 10
MOST = (1 << BITS) - 1


def _ordered() -> Column:
    """The words of a line (c) in the order by rarity, as numbers, where ``level`` is at hand."""
    return F.sort_array(F.transform("c", lambda h: F.get("level", F.shiftrightunsigned(h, 32 - CELL_BITS)) + h))


def _posts(classes: DataFrame, level: DataFrame) -> DataFrame:
    """cid, key (two neighbours in the order), hot (whether many lines may have them) and told: the number of the line's words, the pair's place and a map of 44 bits, in which each word turns one bit round."""
    folded = F.aggregate("c", F.lit(0).cast("long"), lambda m, h: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(MAP_BITS)))))
    keyed = classes.withColumn("level", level.scalar()).select("cid", "n", folded.alias("map"), _ordered().alias("k"))
    # Of two lines with n and m words, o of them common, one has n - o others, which part two pairs each, and the
    # other m - o, which part one each: at most 2n/5. A single word has an absent neighbour.
    prefix = F.floor(F.col("n") * 2 / 5).cast("int") + 1
    pairs = keyed.select("cid", "n", "map", F.posexplode(F.arrays_zip(F.slice("k", 1, prefix).alias("a"), F.slice("k", 2, prefix).alias("b"))).alias("p", "pair"))
    rare = F.shiftright(F.col("pair.a") + (1 << 31), 32).cast("int")
    told = F.shiftleft("map", 2 * BITS).bitwiseOR(F.shiftleft(F.least("n", F.lit(MOST)).cast("long"), BITS)).bitwiseOR(F.least("p", F.lit(MOST)).cast("long"))
    return pairs.select("cid", F.xxhash64("pair.a", "pair.b").alias("key"), told.alias("told"), (rare >= 8 * (HOT.bit_length() - 1)).alias("hot"))


def _fits(ours: Column | str, theirs: Column | str) -> Column:
    """Length, positional and map filters for lines whose first common pair is the one told of in both.
    Of the common words before it no two are neighbours in both lines, so that another word
    stands between any two: they are at most a third of the words before it in both."""
    ours, theirs = (F.col(x) if isinstance(x, str) else x for x in (ours, theirs))
    n, m = (F.shiftright(x, BITS).bitwiseAND(F.lit(MOST)) for x in (ours, theirs))
    p, q = (x.bitwiseAND(F.lit(MOST)) for x in (ours, theirs))
    length = 5 * F.least(n, m) >= 4 * F.greatest(n, m)
    place = 3 * (p + q + 3 * F.least(n - p, m - q)) >= 4 * (n + m)
    apart = F.bit_count(F.shiftrightunsigned(ours.bitwiseXOR(theirs), 2 * BITS))
    return (F.greatest(n, m) == MOST) | (length & place & (9 * apart <= n + m))


def _held(posts: DataFrame, *order: str) -> DataFrame:
    """``posts`` with earlier: of some before each in its group, in that order, the cids of those that fit."""
    before = F.collect_list(F.struct("cid", "told")).over(W.partitionBy("key").orderBy(*order).rowsBetween(1 - WHOLE, -1)).alias("before")
    return posts.select("*", before).withColumn("earlier", F.transform(F.filter("before", lambda x: _fits(F.col("told"), x.told)), lambda x: x.cid)).drop("before")


def _grouped(parts: DataFrame) -> DataFrame:
    """Of ``parts`` (key, base, cid, told), where base is null, those that share their key: with earlier, the cids of those before that fit, in small groups, and with
    told in large ones, where of up to MIDDLE lines those go that fit no other. Where base isn't null all are handed on, with told."""
    near = parts.withColumn("members", F.count(F.lit(1)).over(W.partitionBy("key"))).where("members > 1 or base is not null")
    middle = F.col("base").isNull() & (F.col("members") > WHOLE) & (F.col("members") <= MIDDLE)
    near = near.withColumn("all", F.collect_list(F.when(middle, F.struct("cid", "told"))).over(W.partitionBy("key")))
    met = ~middle | F.exists("all", lambda x: (x.cid != F.col("cid")) & _fits(F.col("told"), x.told))
    large = (F.col("members") > WHOLE) | F.col("base").isNotNull()
    near = _held(near.where(met).drop("all"), "cid")
    near = near.select("key", "base", "cid", F.when(large, F.col("told")).alias("told"), "members", F.when(~large & (F.size("earlier") > 0), F.col("earlier")).alias("earlier"))
    return near.where("told is not null or earlier is not null")


def _shared(posts: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Pairs (a, b) of lines that share a key and fit: all of small groups, of large ones those of a line with the earliest and some before it.
    Then the posts of large groups: key, cid, d, told, members (their number) and first (whether they are
    the earliest). And the stored tables that both are read from.

    Only keys whose rarer word is frequent can have very large groups. These are dealt out by a salt, and what is left of them
    is counted by key: but for the 2 ** 14 largest groups of more than HOT lines, of which no other has that part of the lines, they are put together
    again. The largest are told the earliest of all salts afterwards.
    """
    # A salted key stands for a group's part; base is the group's own.
    salted = lambda key: F.xxhash64(key, F.pmod(F.xxhash64("cid"), F.lit(64)))
    hot = F.when(F.col("hot"), F.col("key"))
    near = materialise(_grouped(posts.select(F.when(F.col("hot"), salted("key")).otherwise(F.col("key")).alias("key"), hot.alias("base"), "cid", "told")), "shared")
    apart = near.where("base is not null").select(F.col("base").alias("key"), "cid", "told")
    often = apart.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT).orderBy(F.desc("k"), "key").limit(1 << 14)
    often = materialise(often.select("key", F.col("key").alias("base")), "largest")
    apart = apart.join(F.broadcast(often), "key", "left").select(F.when(F.col("base").isNull(), F.col("key")).otherwise(salted("key")).alias("key"), "base", "cid", "told")
    again = materialise(_grouped(apart), "again")
    stored, near = [near, often, again], near.where("base is null").unionByName(again)
    pairs = near.where("earlier is not null").select(F.col("cid").alias("a"), F.explode("earlier").alias("b"))
    # The others are told their line's place.
    big = near.where("told is not null").drop("earlier")
    big = big.join(few(classes.select("cid", "d"), big, "cid").hint("merge"), "cid")
    by = W.partitionBy("key")
    head = F.min(F.struct("d", "cid", "told")).over(by).alias("h")
    big = materialise(_held(big.select("key", "base", "cid", "d", "told", "members", head), "d", "cid"), "large")
    tops = big.where("base is not null").groupBy("key", "base").agg(F.first("h").alias("h"), F.first("members").alias("members"))
    whole = tops.groupBy("base").agg(F.min("h").alias("h"), F.sum("members").alias("members")).where("members > 1")
    told = big.where("base is not null").drop("h", "members").join(tops.select("key", "base").join(whole, "base").drop("base"), "key")
    told = told.withColumn("key", F.col("base"))
    every = big.where("base is null").unionByName(told).drop("base")
    first = F.col("cid") == F.col("h.cid")
    hub = F.when(~first & _fits("told", "h.told"), F.array("h.cid")).otherwise(F.array().cast("array<bigint>"))
    star = every.select(F.col("cid").alias("a"), F.explode(F.array_union("earlier", hub)).alias("b"))
    return pairs.unionByName(star), every.select("key", "cid", "d", "told", "members", first.alias("first")), [*stored, big]


def _similar(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b) those whose sets may have a Jaccard similarity of 4/5 or more: (a, b, sure), a the later one.
    Words are told apart by 32 bits, in a multiset, so that no similar pair is lost. A pair is sure if it would be
    similar with two common words less, so that a wrong one would need three words of it to share their bits with others."""
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    asked = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    asked = materialise(asked, "asked")
    sets = few(classes.select("cid", "n", "c", F.struct("d", "line_no", "uid").alias("f")), asked, "cid").join(asked.hint("merge"), "cid", "left_semi")
    sets = materialise(sets, "sets")
    a, b = (sets.select(F.col("cid").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "c", "f")]) for x in "ab")
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    # What one line has twice of a hash, of two of its words, array_intersect counts once.
    twice = F.least(F.col("na") - F.size(F.array_distinct("ca")), F.col("nb") - F.size(F.array_distinct("cb")))
    common = F.size(F.array_intersect("ca", "cb")) + twice
    late = F.col("fa") > F.col("fb")
    least = 4 * (F.col("na") + F.col("nb"))
    both = both.withColumn("common", common).where(9 * F.col("common") >= least).withColumn("sure", 9 * (F.col("common") - 2) >= least)
    found = both.select("sure", F.when(late, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(late, F.col("b")).otherwise(F.col("a")).alias("b"))
    found = materialise(found, "similar")
    discard(pairs, asked, sets)
    return found


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose sets of words, taken from the texts, have a Jaccard similarity of 4/5 or more."""
    asked = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    asked = classes.select("cid", "uid", "line_no").join(asked.hint("merge"), "cid").groupBy("uid").agg(F.collect_list(F.struct("line_no", "cid")).alias("asked"))
    asked = materialise(asked, "asked")
    some = few(docs.select("uid", "text"), asked, "uid").join(asked.hint("merge"), "uid")
    words = some.select(F.split("text", "\n").alias("lines"), F.explode("asked").alias("x")).select("x.cid", _words(F.get("lines", F.col("x.line_no"))).alias("w"))
    words = materialise(words, "words")
    both = pairs.join(words.select(F.col("cid").alias("a"), F.col("w").alias("wa")), "a").join(words.select(F.col("cid").alias("b"), F.col("w").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    return both.where(9 * common >= 4 * (F.size("wa") + F.size("wb"))).select("a", "b")


def _gone(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """cid of the classes that resemble an earlier one."""
    level = levels(classes)
    # Every line is held against a few others of its groups first; what this settles asks no more.
    star, shared, stored = _shared(_posts(classes, level), classes)
    found = _similar(star, classes)
    # The others meet the earlier lines of their groups, in large ones those that have their first common word with them as well. Of n words a fifth
    # at most are a line's own, so that it is one of the first n/5 (and one), and not behind the pair that is the group's key.
    rest = shared.where(~F.col("first") & (F.col("members") > 2)).select("key", "cid", "d", "told", "members")
    settled = found.select(F.col("a").alias("cid")).distinct().hint("merge")
    left = materialise(rest.join(settled.withColumn("settled", F.lit(True)), "cid", "left"), "members")
    # Groups in which all are settled ask nothing, nor do those of up to SMALL lines in which no other line fits one that isn't.
    # Lines of one document aren't in order by their numbers.
    earlier = (F.struct("b.d", "b.cid") < F.struct("a.d", "a.cid")) | (F.col("a.d").eqNullSafe(F.col("b.d")) & F.col("b.settled"))
    asks = left.where("settled is null")
    small = F.col("members") <= SMALL
    near = (F.col("a.key") == F.col("b.key")) & earlier & _fits("a.told", "b.told")
    some = asks.where(small).alias("a").join(left.where(small).alias("b").hint("merge"), near, "left_semi")
    keys = some.select("key").union(asks.where(~small).select("key")).distinct()
    rest = asked = materialise(left.join(keys.hint("merge"), "key", "left_semi"), "asked")
    maps = few(classes, rest.select("cid"), "cid").withColumn("level", level.scalar())
    maps = maps.select("cid", F.col("n").alias("words"), *[_map(i, MAPS).alias(f"m{i}") for i in range(MAPS)], F.slice(_ordered(), F.lit(1), F.floor(F.col("n") * 2 / 5).cast("int") + 1).alias("order"))
    rest = rest.join(maps.hint("merge"), "cid").withColumn("lead", F.slice("order", F.lit(1), F.floor(F.col("words") / 5).cast("int") + 1))
    p = F.col("told").bitwiseAND(F.lit(MOST)).cast("int")
    front = F.when(p == MOST, F.col("lead")).otherwise(F.slice("lead", F.lit(1), p + 1))
    front = F.when(F.col("members") > SMALL, front).otherwise(F.array(F.lit(0).cast("long")))
    prev = F.when((p > 0) & (p < MOST), F.get("order", p - 1)).alias("prev")
    held = ["cid", "d", "told", "words", *[f"m{i}" for i in range(MAPS)], "settled"]
    rest = rest.select(*held, prev, "key", F.when(F.col("members") > SMALL, F.col("lead")).alias("lead"), F.posexplode(front).alias("k", "word"))
    rest = materialise(rest.select(*held, "prev", F.slice("lead", F.lit(1), F.col("k")).alias("before"), "k", F.xxhash64("key", "word").alias("key")), "rest")
    discard(level, *stored, left, asked)
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"a.m{i}").bitwiseXOR(F.col(f"b.m{i}"))) for i in range(MAPS)])
    both = F.col("a.words") + F.col("b.words")
    begin = 9 * F.least(F.col("a.words") - F.col("a.k"), F.col("b.words") - F.col("b.k")) >= 4 * both
    fits = begin & _fits("a.told", "b.told") & (9 * apart <= both)
    # A pair that also has the word before the key in common meets in the group of that word, and one with a common
    # word before this one meets by that: there, and not here.
    again = F.coalesce(F.col("a.prev") == F.col("b.prev"), F.lit(False)) | F.coalesce(F.arrays_overlap("a.before", "b.before"), F.lit(False))
    meet = rest.where("settled is null").alias("a").join(rest.alias("b").hint("merge"), "key").where(earlier & fits & ~again)
    more = _similar(meet.select(F.col("a.cid").alias("a"), F.col("b.cid").alias("b")), classes)
    discard(rest)
    found = found.unionByName(more)
    sure = found.where("sure").select("a").distinct()
    doubtful = materialise(found.where("not sure").select("a", "b").distinct().join(sure.hint("merge"), "a", "left_anti"), "doubtful")
    return sure.union(_verified(doubtful, classes, docs).select("a")).distinct().withColumnRenamed("a", "cid")


def _removals(docs: DataFrame, row: str) -> DataFrame:
    """As ``removals``, of documents whose rows ``row`` numbers."""
    docs = docs.select(F.col(row).alias("uid"), F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text"))
    classes, copies, _ = _classes(_lines(docs))
    # A line that opens its class stays unless the class resembles an earlier one; all others go.
    again = materialise(_gone(docs, classes), "gone")
    gone = few(classes.select("cid", "uid", "d", "line_no"), again, "cid").join(again.hint("merge"), "cid", "left_semi")
    return copies.unionByName(gone.drop("cid")).select("uid", F.col("d").alias("doc_id"), "line_no")


def removals(docs: DataFrame) -> DataFrame:
    """The lines of ``docs`` (doc_id, text) that an earlier line resembles: uid, doc_id, line_no.

    Lines are parts of a text between line feeds, numbered from 0, and follow each other by doc_id (null
    first), number, then, in rows that repeat a doc_id, by the row's place. A line without words
    is never removed. Words are compared as they stand. An empty table gives no rows. Other columns
    aren't read. Lines are taken for equal by 128 bits, and for similar by their words.
    """
    return _removals(numbered(docs.select("doc_id", "text")), "uid")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines of ``removals``, in the same columns; n_chars, where there is
    one, is counted anew. A document that loses all its lines with words goes; one that loses none stays as it
    is, also without text. Columns other than doc_id, text and n_chars are handed on."""
    row, lost = (fresh(docs, x) for x in ("row", "lost"))
    stored = numbered(docs, row)
    gone = _removals(stored, row).groupBy(F.col("uid").alias(row)).agg(F.collect_set("line_no").alias(lost))
    out = stored.join(gone, row, "left")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(~F.array_contains(lost, i), x))
    kept = F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
    out = out.withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(kept))
    out = out.where(F.col(lost).isNull() | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


#: All pairs of different lines that share a word; for small tables.
ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS s FROM l),
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min((coalesce(doc_id, -9223372036854775808), line_no))) AS id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
w AS (SELECT id, n, unnest(s) AS word FROM c),
p AS (SELECT a.id, a.n + b.n AS size, count(*) AS common FROM w a JOIN w b ON a.word = b.word AND b.id < a.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n + b.n),
g AS (SELECT DISTINCT id FROM p WHERE 9 * common >= 4 * size),
f AS (SELECT doc_id, line_no, s, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, line_no) AS place FROM s WHERE len(s) > 0)
SELECT f.doc_id, CAST(f.line_no AS INT) AS line_no FROM f JOIN c ON c.s = f.s LEFT JOIN g ON g.id = c.id WHERE f.place > 1 OR g.id IS NOT NULL
"""
