"""SimHash links, cross-tokenizer alignment and periodic runs against brute force."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from gleanmark.llm import crosstok, periodic, queries, simhash

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, print string, key int, uid long, n_a string"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [a + b + c for a in "bdfgl" for b in "aeio" for c in "rstn"]
    say = lambda n: " ".join(rng.choices(words, k=n))
    base = [say(80) for _ in range(8)]
    texts = [*base, *base[:3], base[4].upper(), base[5] + " more", None, "", " \t\n", "one", "One  two", "one two"]
    texts += ["a  b \n\n c", " lead", "tail ", "\n x", "a\r\nb\tc <|endoftext|> <s> </s>", "é  b \n c ½ ﬁ", "x\x1c y", "　 a 中文 字 😀a", "x" * 9000, "\n"]
    texts += ["ab " * 40, "a b a b a b a b a b", "x x x x x", "x x x x x x", "p q r s " * 3 + "t", "\n".join(["the same line again"] * 9), say(6000)]
    ids = [*range(10, 10 + len(texts) - 3), None, None, 11]
    return [(i, t, "en", "s", 1, "p", 1, 2, "n") for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def simhash_of(text, size=3):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in split(text)]
    size = min(size, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i : i + size]).encode(), seed=42).intdigest() for i in range(len(words) - size + 1)] if words else []
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(points, radius):
    """The least point that each can reach, by all pairs."""
    points = np.array(sorted(points), np.uint64)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
    label = np.arange(len(points))
    while True:
        then = np.array([label[row].min() for row in near])
        if (then == label).all():
            return {int(p): int(points[i]) for p, i in zip(points, label, strict=True)}
        label = then


def test_simhash_components_equal_all_pairs(spark, folder, docs, rows):
    got = queries.QUERIES["op11_simhash_near_dedup"](spark, folder)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    marks = [simhash_of(r[1]) for r in rows]
    root = classes(set(marks), 2)
    least = {}
    for (doc, *_), mark in zip(rows, marks, strict=True):
        least.setdefault(root[mark], []).append(doc)
    want = collections.Counter((doc, f"{mark:016x}", min((x for x in least[root[mark]] if x is not None), default=None)) for (doc, *_), mark in zip(rows, marks, strict=True))
    assert collections.Counter(map(tuple, got.collect())) == want
    assert simhash.link(docs.where("doc_id = -1")).count() == 0
    # The fingerprint's hash is the one that Spark has as well.
    assert spark.sql("select xxhash64('a b c')").first()[0] == np.uint64(xxhash.xxh64_intdigest(b"a b c", 42)).astype(np.int64)


@pytest.mark.parametrize("shard", [3, 8, 1 << 13])
def test_near_links_lose_no_pair_however_shards_are_split(spark, shard):
    rng = np.random.default_rng(shard)
    points = set(map(int, rng.integers(0, 2**64, 60, dtype=np.uint64)))
    points |= {p ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for p in list(points)[:30]}
    center = int(rng.integers(0, 2**64, dtype=np.uint64))  # a family that shares most of its bits
    points |= {center ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (60, 3))} | {0, 1, 2**64 - 1}
    signed = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in points] + [(None,)], "print long")
    links = [(a % 2**64, b % 2**64) for a, b in simhash.near_links(signed, 2, shard).collect()]
    assert all((a ^ b).bit_count() <= 128 for a, b in links)
    want = classes(points, 2)
    assert all(want[a] == want[b] for a, b in links)
    label = {p: p for p in points}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        label[max(find(a), find(b))] = min(find(a), find(b))
    assert {p: find(p) for p in points} == want


def test_tree_follows_edges_to_all_within_the_radius():
    rng = np.random.default_rng(1)
    points = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
    points = np.unique(np.concatenate([points, points[:99] ^ np.uint64(5)]))
    tree = simhash.Tree(points, *simhash.Tree.edges(points))
    for radius in (0, 1, 2, 20):
        asked, found = tree.near(points, radius)
        want = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= radius)
        assert sorted(zip(asked.tolist(), found.tolist(), strict=True)) == sorted(zip(want[0].tolist(), want[1].tolist(), strict=True))
    assert len(simhash.Tree.edges(points[:1])[0]) == 1


def groups_of(text, a, bytes_a, b):
    """Groups of both id lists over the whole text, by comparing all ends."""
    if not text:
        return []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ends = []
    for tokens in ([bytes_a[i] for i in ids_a], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]):
        if b"".join(tokens) != (" " + text).encode():
            return []
        ends.append(np.cumsum([len(t) for t in tokens]).tolist())
    out, i, j = [], 0, 0
    for p, end in enumerate(ends[0], 1):
        if end in ends[1]:
            q = ends[1].index(end) + 1
            out.append((ids_a[i:p], ids_b[j:q]))
            i, j = p, q
    return out


@pytest.fixture(scope="module")
def tools():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True

    # Characters from 256 on stand for the bytes that don't print.
    printable = [x for x in range(256) if 33 <= x < 127 or 161 <= x < 173 or x >= 174]
    hidden = [x for x in range(256) if x not in printable]
    table = {**{chr(x): x for x in printable}, **{chr(256 + i): x for i, x in enumerate(hidden)}}
    told = {i: bytes(table.get(c, 63) for c in token) for token, i in a.get_vocab().items()}
    return a, told, b


@pytest.mark.parametrize("most", [crosstok.BROADCAST, 40, 0])
def test_alignment_equals_whole_texts(spark, folder, docs, rows, tools, most):
    if most == crosstok.BROADCAST:
        got = queries.QUERIES["op12_cross_tokenizer_alignment"](spark, folder)
    else:
        got = crosstok.align(docs, A, B, shown=lambda g: F.when(g == "", "").otherwise(F.sha2(g, 256)), most=most).withColumnRenamed("groups", "groups_sha256")
    told = [groups_of(r[1], *tools) for r in rows]
    links = [collections.Counter((x, y) for a, b in own for x in a for y in b) for own in told]
    count = collections.Counter(pair for own in links for pair in own)
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    want = collections.Counter()
    for (doc, *_), own, met in zip(rows, told, links, strict=True):
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in own)
        digest = hashlib.sha256(shown.encode()).hexdigest() if own else ""
        best_links = sum(n for (x, y), n in met.items() if count[x, y] == best[x])
        want[doc, sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), sum(met.values()), best_links, sum(n * count[p] for p, n in met.items()), digest] += 1
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == columns and dict(got.dtypes)["doc_id"] == "bigint"
    assert collections.Counter(map(tuple, got.collect())) == want
    assert sum(1 for own in told if not own) >= 2 and crosstok.align(docs.where("doc_id = -1"), A, B).count() == 0


def test_a_worker_that_forgets_pieces_tells_the_same(rows, monkeypatch):
    texts = [r[1] for r in rows]
    every = crosstok.Aligner(A, B).documents(texts)
    monkeypatch.setattr(crosstok, "KNOWN", 8)
    tool = crosstok.Aligner(A, B)
    for i, text in enumerate(texts):
        sizes, shown, links, times = tool.documents([text])
        assert sizes[0].tolist() == every[0][i].tolist() and shown[0] == every[1][i]
        assert links[0].tolist() == every[2][i].tolist() and times[0].tolist() == every[3][i].tolist()
    assert len(tool.shown) < len(every[1]) * 200


def runs_of(words, least, times):
    """Maximal runs by comparing every word with the one a period later."""
    out, n = set(), len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q) and not any(all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.add((i, length, q))
            i = j + 1
    return sorted(out)


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 4)):
            letters = "abc"[: rng.randint(1, 3)]
            words = rng.choices(letters, k=rng.randint(0, 50))
            part = rng.choices(letters, k=rng.randint(1, 6))
            texts.append(words[:9] + (part * 40)[: rng.randint(0, 40)] + words[9:])
        for least, times in ((6, 4), (2, 2), (6, 2), (1, 3)):
            got, _ = periodic._runs([" ".join(w).encode() for w in texts], least, times)
            assert got == [runs_of(w, least, times) for w in texts]


def test_periodic_query_equals_brute_force(spark, folder, docs, rows):
    got = queries.QUERIES["op13_periodic_runs"](spark, folder)
    want, planted = collections.Counter(), 0
    for doc, text, *_ in rows:
        words = split(text)
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        runs = runs_of(words, 6, 4) if n < 1000 else []
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        shown = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in drop)
        want[doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(shown), digest(kept)] += 1
    assert planted >= 2 and got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == want
    assert periodic.repeats(docs.where("doc_id = -1")).count() == 0
    some = periodic.repeats(docs.where("text like 'ab ab%'")).first()
    assert some.runs[0].asDict() == {"start": 0, "length": 40, "period": 1} and some.collapsed == "ab"
