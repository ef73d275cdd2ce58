"""Each operator against brute force on small tables with nulls, ties, repeats and clashing columns."""

import base64
import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleanmark.llm import bitslice, common, langid, lines, mixing, neardup, packing, passages, sstable, warc, weakrules
from gleanmark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid string, n string, rank int"
WORD = r"[^\x20\x09-\x0D]+"


def split(text):
    return re.findall(WORD, text or "")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    vocabulary = ["".join(x) for x in itertools.product("bdfgklmn", "aeiou", "rstvz", "ao")]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    base = [say(60) for _ in range(12)]
    out = []
    for i, text in enumerate(base):
        out.append((i, text + ".", "en" if i % 2 else "de", ["a", "b", None][i % 3], len(text)))
    near = base[0].split()
    near[30] = "changed"
    passage = say(55)
    out += [
        (20, " ".join(near) + ".", "en", "a", 1),
        (21, base[1] + ".", None, "b", 1),
        (21, base[1] + ".", None, "b", 1),
        (22, None, "en", "a", 1),
        (23, "", "en", "b", 1),
        (24, " \t\n ", None, None, 1),
        (25, "one two", "en", "a", 1),
        (26, "ONE two", "en", "a", 1),
        (27, say(40) + " " + passage, "en", "c", 1),
        (28, say(33) + "\n" + passage + " " + say(21), "de", "c", 1),
        (29, "\n".join([base[2], "short line here", base[3], "short line here", ""]), "en", "a", 1),
        (30, say(9000), "en", "a", 1),
        (31, "x" * 70_000, "de", "b", 1),
        (None, say(25), "en", None, None),
        (33, " ".join(["again and again the same eight words here"] * 9), "en", "a", 1),
        (34, f"<|endoftext|> hi <|startoftext|>{say(22)}<|ENDOFTEXT|>", "en", "a", 1),
    ]
    return [(*r, "u", "n", 7) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, DOCS).repartition(3, "source").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -5")


def test_packing_is_a_partition_of_all_tokens(docs, none, rows):
    got = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), 0, 2048, per_block=16).collect()
    tool, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), collections.Counter()
    for doc, text, *_ in rows:
        ids = np.array([*tool.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        n = max(1, -(-len(ids) // 2048))
        cuts = [0, *[len(ids) - 2048 * k for k in range(n - 1, -1, -1)]] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r.length for r in got) // 2048)
    assert len(bins) <= least + 2
    assert packing.pack_documents(none, P.path("byte_bpe_50k.json"), 0).count() == 0


def test_genetic_packing_never_loses_items():
    rng = np.random.default_rng(1)
    lengths = rng.integers(300, 1100, 120).tolist()
    people = packing.evolve(lengths, 2048, [], rng, 4, 6)
    first = packing.Packing(lengths, 2048)
    first.best_fit(sorted(range(120), key=lambda i: -lengths[i]))
    assert len(people[0].bins) <= len(first.bins)
    for p in people:
        assert sorted(i for b in p.bins for i in b) == list(range(120))
        assert all(sum(lengths[i] for i in b) <= 2048 for b in p.bins)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 0.3, (90, 7)).tolist()
    vectors[3], vectors[4] = vectors[5], vectors[5]
    table = [(i, v) for i, v in enumerate(vectors)] + [(100, None), (120, [None] * 7), (140, [float("nan")] * 7), (160, [1.0, 2.0]), (None, vectors[0]), (40, vectors[40])]
    got = bitslice.top_k(spark.createDataFrame(table, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 6)
    use = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in table if i is not None and v and len(v) == 7 and v[0] is not None and np.isfinite(v).all()]
    want = []
    for q, qv in use:
        if q % 20 == 0:
            want += [(q, r + 1, *x) for r, x in enumerate(sorted(((c, int(qv @ cv)) for c, cv in use if c != q), key=lambda x: (-x[1], x[0]))[:6])]
    # Query 40 stands twice: its rows are queries of one id, and share six ranks.
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect() if r.query_id != 40)
    assert got == sorted(w for w in want if w[0] != 40)
    assert bitslice.top_k(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_top_k_over_many_tiles(spark, monkeypatch):
    for name, value in (("ROWS", 16), ("QUERIES", 3), ("BLOCKS", 2), ("SETS", 2)):
        monkeypatch.setattr(bitslice, name, value)
    rng = np.random.default_rng(6)
    v = rng.integers(-3, 4, (150, 3))
    table = spark.createDataFrame([(i, (x / 64).tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, block int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in bitslice.top_k(table, F.col("vec_id") % 5 == 0, 7).collect())
    assert got == [(q, k + 1, c, s) for q in range(0, 150, 5) for k, (s, c) in enumerate(sorted(((int(v[q] @ v[c]), c) for c in range(150) if c != q), key=lambda x: (-x[0], x[1]))[:7])]


def test_archive_round_trip(spark, tmp_path):
    table = [(1, "http://a", "same"), (5, "http://b", "same"), (3, None, "same"), (4, "http://c\r\nX: y", "ü"), (6, "u", None), (7, "u", ""), (None, "n", "alone")]
    pages = spark.createDataFrame(table, "page_id long, url string, html string").withColumn("response", F.lit(1))
    archive = warc.write(pages)
    got = {r.page_id: r for r in warc.read(spark, archive).collect()}
    for page, _, html in table:
        same = [p for p, _, h in table if (h or "") == (html or "") and p is not None]
        raw = (html or "").encode()
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        revisit = page is not None and page != max(same)
        assert (r.record_type, r.refers_to) == (("revisit", max(same)) if revisit else ("response", None))
    records = {r.page_id: bytes(r.record) for r in warc.reconstruct(spark, archive).collect()}
    assert records[5].endswith(b"\r\n\r\nsame\r\n\r\n") and b"WARC-Refers-To: <urn:page:5>" in records[1] and records[1].endswith(b"\r\n\r\n\r\n\r\n")
    assert b"\r\nX: y" not in records[4]
    assert sum(r.records for r in warc.export(spark, archive, str(tmp_path / "out")).collect()) == len(table)
    assert {r.record_type for r in warc.read(spark, warc.write(pages, least_bytes=3)).where("payload_bytes < 3").collect()} == {"response"}
    assert warc.read(spark, warc.write(pages.where("page_id > 99"))).count() == 0


def test_shards_round_trip_and_lookup(spark, docs, none, rows):
    folder, manifest = sstable.write(docs, P.path("word_bpe_49k.json"), 1, rows_per_range=7, shard_bytes=20_000, block_bytes=300)
    got = sstable.read(spark, folder, manifest).orderBy("start").collect()
    tool = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = sorted((r[0] is not None, r[0] or 0, [*tool.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows)
    assert [(r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in got] == want
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    found = sstable.lookup(spark, folder, manifest, spark.createDataFrame([(3,), (21,), (999,)], "doc_id long")).collect()
    assert sorted(r.doc_id for r in found) == [3, 21, 21]
    assert sstable.read(spark, *sstable.write(none, P.path("word_bpe_49k.json"), 1)).count() == 0


def test_mixing_meets_its_targets(docs, none, rows):
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len(split(text))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.remove(s)
    wanted = sorted(target.values())
    assert sorted({round(r.target, 6) for r in got}) == sorted({round(t, 6) for t in wanted})
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[round(r.target, 6)] += r.taken
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))
    assert all(abs(t - v) <= 600 for t, v in taken.items())
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, got))
    assert mixing.mixed(docs).columns == docs.columns and mixing.mix(none).count() == 0


def test_passages_find_what_repeats(docs, none, rows):
    got = passages.repeats(docs).collect()
    told = {r.doc_id for r in got}
    grams = collections.defaultdict(set)
    for i, (doc, text, *_) in enumerate(rows):
        w = [x.lower() for x in split(text)]
        for k in range(len(w) - 50):
            grams[tuple(w[k : k + 51])].add(i)
    want = {rows[i][0] for v in grams.values() if len(v) > 1 for i in v}
    assert want <= told and {27, 28} <= told
    assert told - want <= {0, 20}  # the near copy, by its line
    by_doc = {r.doc_id: split(t[1]) for r in got for t in rows if t[0] == r.doc_id}
    assert all(0 <= r.start < r.stop <= len(by_doc[r.doc_id]) and r.stop - r.start > 50 for r in got)
    assert any(r.removed for r in got) and passages.repeats(none).count() == 0


def test_near_copies_are_found_over_wrapped_lines(spark):
    rng = np.random.default_rng(22)
    say = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage = say(80)
    wrap = lambda w, n=16: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    changed = passage.copy()
    changed[40] = "other"
    texts = [wrap(say(48)) + "\n" + wrap(passage) + "\n" + wrap(say(30)), wrap(say(32)) + "\n" + wrap(changed), wrap(say(90)), None, "", "\n\n", " ".join(say(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = passages.repeats(docs).collect()
    assert {r.doc_id for r in got} == {0, 1} and {r.kind for r in got} == {"line"}
    assert all(48 <= r.start < r.stop <= 128 for r in got if r.doc_id == 0) and all(32 <= r.start < r.stop <= 112 for r in got if r.doc_id == 1)


@pytest.mark.parametrize("hot", [1000, 2])
def test_passages_between_documents_in_the_middle(spark, monkeypatch, hot):
    monkeypatch.setattr(passages, "HOT", hot)
    rng = np.random.default_rng(21)
    say = lambda n: " ".join(f"q{x}" for x in rng.integers(0, 10**9, n))
    p, q = say(60).split(), say(90).split()
    cut = lambda x, a, b: " ".join(x[a:b])
    excerpts = lambda x: " ".join(say(7) + " " + cut(x, a, a + 40) for a in range(0, len(x) - 30, 10))
    texts = [
        excerpts(p) + " " + excerpts(q),
        say(11) + " " + cut(p, 0, 60) + " " + say(13),
        cut(q, 0, 70) + " " + say(40) + " " + cut(q, 20, 90),
        say(5) + " " + cut(p, 0, 60),
        say(20) + " " + cut(q, 0, 90) + " " + say(9) + " " + cut(p, 4, 57),
        excerpts(q) + " " + excerpts(p),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    first, want, got = {}, collections.defaultdict(set), collections.defaultdict(set)
    grams = [[tuple(t.split()[k : k + 51]) for k in range(len(t.split()) - 50)] for t in texts]
    for d, gs in enumerate(grams):
        for g in gs:
            first.setdefault(g, set()).add(d)
    for d, gs in enumerate(grams):
        for k, g in enumerate(gs):
            if len(first[g]) > 1:
                want[d, min(first[g]) < d].update(range(k, k + 51))
    found = [r for r in passages.repeats(docs).collect() if r.kind == "run"]
    for r in found:
        got[r.doc_id, r.removed].update(range(r.start, r.stop))
    assert got == want and {d for d, _ in want} == {1, 2, 3, 4}
    assert len({r.cluster for r in found}) == 2


def brute_links(rows, num, den):
    sets = []
    for _, text, *_ in rows:
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in split(text)]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            parent[find(b)] = find(a)
    least = {}
    for i, r in enumerate(rows):
        key = float("inf") if r[0] is None else r[0]
        least[find(i)] = min(least.get(find(i), key), key)
    return [(r[0], len(sets[i]), None if least[find(i)] == float("inf") else least[find(i)]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("bands", [None, (13, 3)])
def test_near_duplicates(docs, none, rows, bands):
    got = neardup.link(docs, (80, 100), small=1, bands=bands).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute_links(rows, 80, 100), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert neardup.link(none).count() == 0


def test_near_duplicate_families_meet_in_blocks(spark):
    rng = np.random.default_rng(9)
    base = rng.choice([f"v{i}" for i in range(900)], 200)
    rows = []
    for i in range(70):
        text = base.copy()
        at = rng.integers(0, 200, int(rng.integers(1, 9)))
        text[at] = [f"n{i}x{k}" for k in range(len(at))]
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for kin in (16_384, 4):
        got = {r.doc_id: r.component_id for r in neardup.link(docs, (85, 100), small=4, block=16, most_kin=kin).collect()}
        assert got == {d: c for d, _, c in brute_links(rows, 85, 100)}


def test_near_dedup_keeps_one_of_each(docs):
    kept = neardup.dedup(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(21) == 0 and ids.count(1) == 1 and ids.count(0) == 1 and 20 not in ids and 22 in ids


def test_near_dedup_keeps_unlike_rows_of_one_id(spark):
    say = lambda k: " ".join(f"t{k}x{i}" for i in range(40))
    rows = [(None, say(0)), (None, say(1)), (None, say(1) + " more"), (7, say(2)), (7, say(3)), (None, say(3)), (8, say(4)), (7, say(4)), (None, None), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = [tuple(r) for r in neardup.dedup(docs).collect()]
    assert sorted(kept, key=str) == sorted((rows[i] for i in (0, 1, 3, 4, 7, 8, 9)), key=str)


def brute_lines(rows):
    every = []
    for place, (doc, text, *_) in enumerate(rows):
        for k, line in enumerate(text.split("\n") if text is not None else []):
            if split(line):
                every.append(((doc is not None, doc or 0, k, place), frozenset(split(line))))
    every.sort(key=lambda x: x[0])
    out = []
    for i, (at, s) in enumerate(every):
        if any(9 * len(s & t) >= 4 * (len(s) + len(t)) for _, t in every[:i]):
            out.append((at[1] if at[0] else None, at[2]))
    return out


def test_line_dedup(docs, none, rows, monkeypatch):
    for hot in (64, 1):
        monkeypatch.setattr(lines, "HOT", hot)
        got = sorted((str(r.doc_id), r.line_no) for r in lines.removals(docs).collect())
        assert got == sorted((str(d), k) for d, k in brute_lines(rows))
    assert lines.removals(none).count() == 0
    out = lines.dedup(docs)
    assert out.columns == docs.columns
    text = {r.doc_id: r.text for r in out.collect() if r.doc_id != 21}
    assert text[29] == "short line here\n" and 20 not in text and text[22] is None


def test_quality_rules(docs, none, rows):
    got = collections.defaultdict(list)
    for r in weakrules.judge(docs).collect():
        got[r.doc_id].append(r)
    for doc, text, *_ in rows:
        w = split(text)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        mark = [0] * len(w)
        for i in range(len(w) - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                mark[i : i + 8] = [1] * 8
        some = [x for x in (text or "").split("\n") if split(x)]
        r = got[doc][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(some) - len(set(some)), sum(mark))
        assert r.base_failed == (len(w) < 20 or 100 * sum(mark) > 30 * len(w)) and not (r.kept and r.base_failed)
    kept = weakrules.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(12))
    assert weakrules.judge(none).count() == 0 and weakrules.judge(docs, rules=[]).count() == len(rows)


def test_votes_learn_a_kind_of_junk_that_breaks_one_rule():
    patterns = {(1, 1, 1): 900, (1, 1, 0): 60, (1, -1, 1): 40, (0, 0, 1): 5}
    model = weakrules.fit(patterns, 3)
    assert model.log_odds((1, 1, 1)) > 0 > model.log_odds((1, 1, 0)) and model.log_odds((0, 0, 1)) < 0


def test_votes_equal_a_direct_expectation_maximisation():
    rng = np.random.default_rng(4)
    truth = rng.random(400) < 0.7
    cast = np.where(rng.random((400, 4)) < 0.15, -1, np.where(truth[:, None], rng.random((400, 4)) < 0.97, rng.random((400, 4)) < 0.4)).astype(int)
    model = weakrules.fit(dict(collections.Counter(map(tuple, cast.tolist()))), 4, rounds=30)
    # The same, document by document: beliefs are documents seen before, firm * 400 good ones and loose * 400 bad ones.
    voting = np.clip((cast >= 0).mean(axis=0), 1e-3, 1 - 1e-3)
    start = lambda off: np.stack([(1 - off) * voting, off * voting, 1 - voting], axis=1)
    at, prior = np.select([cast == 1, cast == 0], [0, 1], 2), 0.8
    good, bad = start(0.001), start(0.3)
    first_good, first_bad = good, bad
    for _ in range(30):
        like = lambda t: np.prod(t[np.arange(4), at], axis=1)
        sure = prior * like(good) / (prior * like(good) + (1 - prior) * like(bad))
        count = lambda w: np.stack([(w[:, None] * (at == k)).sum(axis=0) for k in range(3)], axis=1)
        good, bad = (count(sure) + 400 * first_good) / (sure.sum() + 400), (count(1 - sure) + 2 * first_bad) / ((1 - sure).sum() + 2)
        prior = (sure.sum() + 2 * 0.8) / 402
    assert abs(model.prior - prior) < 1e-6
    assert all(abs(model.bad[j][v] - bad[j][k]) < 1e-6 and abs(model.good[j][v] - good[j][k]) < 1e-6 for j in range(4) for k, v in enumerate((1, 0, -1)))


def test_language_kernel_equals_brute_force(spark):
    text = {"x": ["aba cab", "baa ab", "cab aa b"], "y": ["zzy yzz", "xyz zy", "Zy, xx"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in text.items() for t in ts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), landmarks=2)

    def parts(t):
        t = "".join(c.lower() if c.isascii() and c.isalpha() else " " for c in t)
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    draw = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[2], draw[r[0]]))
    marks = [parts(r[1]) for lang in "xy" for r in [o for o in order if o[2] == lang][:2]]
    known = set().union(*marks)
    kernel = lambda a, b: len(a & b) / (max(len(a & known), 1) * max(len(b), 1)) ** 0.5
    k = np.array([[kernel(parts(r[1]), m) for m in marks] for r in order])
    between = np.array([[kernel(a, b) for b in marks] for a in marks])
    goal = np.array([[1.0 if r[2] == lang else -1.0 for lang in "xy"] for r in order])
    weights = np.linalg.solve(k.T @ k + 1e-3 * 6 * between + 1e-8 * 6 * np.eye(4), k.T @ goal)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", "zz y", "ca zb", "Abba", "q"])], "doc_id long, text string")
    for r in langid.predict(asked, model).join(asked, "doc_id").collect():
        value = np.array([kernel(parts(r.text), m) for m in marks]) @ weights
        odds = np.exp(4 * (value - value.max()))
        assert r.lang_pred == "xy"[int(value.argmax())] and abs(r.score - (odds / odds.sum()).max()) < 1e-3


def test_language_model(spark, docs, none, sf):
    told = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(told, ~langid.held_out(), per_language=40, landmarks=12)
    got = langid.predict(told, model).withColumn("held_out", langid.held_out()).join(told.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = langid.predict(spark.createDataFrame([(1, None), (2, ""), (3, "12 ?!"), (4, "das ist der")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in sorted(odd)][:3] == ["und"] * 3
    assert langid.fit(none, F.lit(True)) is None and langid.predict(docs, None).where("lang_pred <> 'und'").count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {v for k, v in got.items() if k <= 40} == {0} and got[129] == 100 and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_row_numbers_hold_whatever_the_splits(spark, tmp_path, monkeypatch, rows):
    path = str(tmp_path / "documents.parquet")
    more = [*rows, *[(100 + i, f"{rows[i % 12][1]} {i}", "en", "a", 1, "u", "n", 7) for i in range(24)]]
    spark.createDataFrame(more, DOCS).repartition(16).write.parquet(path)
    docs = spark.read.parquet(path)
    runs = {
        "link": lambda: neardup.link(docs).drop("component", "uid"),
        "lines": lambda: lines.removals(docs).drop("uid"),
        "keep": lambda: weakrules.keep(docs),
        "near": lambda: neardup.dedup(docs),
        "dedup": lambda: lines.dedup(docs),
        "mixed": lambda: mixing.mixed(docs),
    }
    want = {k: sorted(map(str, f().collect())) for k, f in runs.items()}
    turn = itertools.cycle(("4", "64"))
    write = common.materialise

    def other(df, *args, **kwargs):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", next(turn))
        return write(df, *args, **kwargs)

    for module in (common, neardup, lines, mixing, weakrules):
        monkeypatch.setattr(module, "materialise", other)
    try:
        assert {k: sorted(map(str, f().collect())) for k, f in runs.items()} == want
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
