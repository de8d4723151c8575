"""The Merkle manifest, byte-level encoding and periodic runs against plain models."""

import base64
import hashlib
import random
import re
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
from oracle import DATA, assert_same
from pyspark.sql import functions as F

from talewind.llm import byte_bpe, merkle_manifest, periodic_runs
from talewind.llm.queries import QUERIES, SQL, repeating

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(doc_id, text, lang, source, n_chars):
    return sha(*map(field, (doc_id, source, lang, n_chars, text)))


def levels(nodes, fanout):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def siblings(tree, i, fanout):
    out = []
    for nodes in tree[:-1]:
        first = i // fanout * fanout
        out.append((nodes[first:i], nodes[i + 1 : first + fanout]))
        i //= fanout
    return out


def expected_manifest(rows, fanout=2):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[lang] = levels([leaf_of(*r) for r in by_lang[lang]], fanout)
    top = levels([trees[x][-1][0] for x in langs], fanout) if langs else []
    out = []
    for k, lang in enumerate(langs):
        for i, r in enumerate(by_lang[lang]):
            path = siblings(trees[lang], i, fanout) + siblings(top, k, fanout)
            changed = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf_of(*r[:4], r[4] + 1) if changed else leaf_of(*r)
            for before, after in path:
                node = sha(*before, node, *after)
            out.append((r[0], leaf_of(*r), trees[lang][-1][0], top[-1][0], sha(*[x for b, a in path for x in b + a]), node, node == top[-1][0]))
    return sorted(out, key=repr)


def got_manifest(docs, fanout=2):
    n_chars = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    proved = merkle_manifest.manifest(docs, {"n_chars": n_chars}, fanout)
    root = merkle_manifest.folded(F.col("now"), F.col("path"))
    rows = proved.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("path")), root, root == F.col("root"))
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def corpus(sizes):
    rows, n = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            rows.append((n * 7 % 1009, None if n % 5 == 0 else f"täxt {n % 11}", lang, None if n % 3 else "s", None if n % 4 == 0 else n))
            n += 1
    random.Random(4).shuffle(rows)
    return rows


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_equals_its_model(spark, monkeypatch, fanout):
    monkeypatch.setattr(merkle_manifest, "LEVELS", 2)  # several rounds
    rows = corpus({None: 1, "": 2, "b": 33, "é": 17, "a": 64, "zz": 5}) + [(None, "x", "b", None, 1), (None, None, None, None, None), (8, "same", "b", "s", 3), (8, "same", "b", "s", 3), (8, "other", "b", "s", 3)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("node", F.lit(1)).withColumn("path", F.lit("p"))
    assert got_manifest(docs, fanout) == expected_manifest(rows, fanout)


def test_manifest_of_little(spark):
    one = [(5, "", None, None, None)]
    assert got_manifest(spark.createDataFrame(one, DOCS)) == expected_manifest(one)
    assert got_manifest(spark.createDataFrame([], DOCS)) == []
    with pytest.raises(ValueError):
        merkle_manifest.manifest(spark.createDataFrame(one, DOCS), fanout=1)


def test_manifest_query(spark):
    got = QUERIES["op11_merkle_manifest"](spark, DATA)
    assert_same(got, SQL["op11_merkle_manifest"])
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected_manifest([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])


@pytest.mark.parametrize("file", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_encoding_equals_tiktoken(file):
    raw = open(public_tokenizers.path(file), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    whole = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    mine, draw = byte_bpe.vocabulary(raw), random.Random(5)
    parts = ["a", "b", "the", "ing", "é", "漢", "😀", " ", "\n", "'s", "23", "--", "̀", "qz", "AA", "e", "<|endoftext|>"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(1, 40))) for _ in range(3000)]
    texts += ["".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(160, 0x2FF), draw.randrange(0x4E00, 0x9FFF)])) for _ in range(30)) for _ in range(500)]
    texts += ["".join(draw.choices("abcdeinorst", k=3000)), "a" * 4000, "-=" * 2000, " " * 3000]
    for t in texts:
        got = mine[t]
        assert array("I", got).tolist() == whole.encode_ordinary(t), t
        assert byte_bpe.decode(got, byte_bpe.known_tokens(raw)).decode() == t


def test_encoding_of_odd_texts(spark):
    texts = [None, "", "same", "same", "x" * 100_000, "naïve  \n\n <|endoftext|> don't"]
    docs = spark.createDataFrame(list(enumerate(texts)), "ids_ long, text string").withColumn("n", F.lit(1))
    rows = byte_bpe.encode(docs)
    got = [(bytes(r.ids), bytes(r.d).decode()) for r in rows.withColumn("d", byte_bpe.decoded(rows)).orderBy("ids_").collect()]
    assert [d for _, d in got] == [t or "" for t in texts]
    assert got[0][0] == got[1][0] == b"" and got[2] == got[3]
    assert byte_bpe.encode(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(docs.withColumn("ids", F.lit(1)))


def test_encoding_query(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        ids = known.encode_ordinary(r.text or "")
        expected[r.doc_id] = (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op12_byte_bpe"](spark, DATA).collect()}
    assert got == expected


def plain_runs(words):
    """All runs by trying every lag and letting each stretch grow."""
    out, seen = [], set()
    for lag in range(1, len(words) // 4 + 1):
        i = 0
        while i + lag < len(words):
            j = i
            while j + lag < len(words) and words[j] == words[j + lag]:
                j += 1
            if j + lag - i >= max(6, 4 * lag) and (i, j + lag) not in seen:
                seen.add((i, j + lag))
                out.append((i, j + lag - i, lag))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def least_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def test_runs_equal_their_definition():
    draw = random.Random(1)
    for _ in range(400):
        w = draw.choices("abcde"[: draw.choice([1, 2, 3, 5])], k=draw.randrange(40))
        if w:
            a = draw.randrange(len(w))
            p = 1 + (len(w) - a) // (3 + draw.randrange(8))
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
        expected = []
        for s in range(len(w)):
            for e in range(s + 6, len(w) + 1):
                q = least_period(w[s:e])
                if e - s >= 4 * q and not (s and w[s - 1] == w[s - 1 + q]) and not (e < len(w) and w[e] == w[e - q]):
                    expected.append((s, e - s, q))
        assert periodic_runs.runs(w) == plain_runs(w) == sorted(expected, key=lambda r: (r[0], r[2])), w


def test_long_texts_skip_no_lag(monkeypatch):
    draw = random.Random(2)
    monkeypatch.setattr(periodic_runs, "THIN", 8)
    for _ in range(1500):
        w = []
        while len(w) < 150:
            unit = draw.choices("ab", k=draw.randrange(1, 6)) * draw.randrange(2, 7)
            if draw.random() < 0.4:
                unit = (unit[: draw.randrange(1, len(unit) + 1)] + ["x"] * draw.randrange(2)) * draw.randrange(2, 6)
            w += unit
        monkeypatch.setattr(periodic_runs, "LONG", 0)
        thin = periodic_runs.runs(w)
        monkeypatch.setattr(periodic_runs, "LONG", 1 << 30)
        assert thin == periodic_runs.runs(w), w


def expected_rows(rows):
    out = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if runs else None
        out[doc_id] = (len(runs), *best, milli, sha(*[f"{s},{k},{q}\n" for s, k, q in runs]), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def test_runs_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, DATA).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    assert got == expected_rows(map(tuple, docs))
    assert sum(r[0] > 0 for r in got.values()) > 20


def test_runs_of_odd_texts(spark):
    rows = [(None, "a " * 8), (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "x y " * 30_000), (6, "a b c a b c a b c a b c a"), (7, "a b c a b c a b c a b c a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("g", F.lit(1)).withColumn("words", F.lit("w"))
    found = {r.doc_id: r.periodic for r in periodic_runs.find_runs(docs).collect()}
    assert [tuple(x) for x in found[None].runs] == [(0, 8, 1)] and found[None].collapsed == "a"
    assert [found[i].collapsed for i in (1, 2, 3, 4)] == ["", "", "", "one"] and not any(found[i].runs for i in (1, 2, 3, 4))
    assert [tuple(x) for x in found[5].runs] == [(0, 60_000, 2)] and found[5].collapsed == "x y"
    assert found[6] == found[7] and found[6].collapsed == "a b c"
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
    assert {r.doc_id: r.text for r in repeating(docs).collect() if r.doc_id != 5}[7] == rows[7][1]
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs.withColumn("periodic", F.lit(1)))
