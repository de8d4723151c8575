"""Scores, packing, mixing, sharding and chat: brute force, round trips and held-out accuracy."""

import itertools
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from talewind.llm import best_fit_pack, chat_format, kd_shards, pareto_mix, piece_lm, toxicity
from talewind.llm.common import held_out
from talewind.llm.queries import QUERIES, conversation_digest

DOCS = "doc_id long, text string, lang string, source string, size long, score double, bin int"
ODD = [None, "", " \n", "12 34", "wort " * 50_000, "same text here", "same text here"]


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1, 0.5, 2) for i, t, lang, source in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_frame(spark, [(i, t, "en" if i % 2 else None, None if i % 3 else "a") for i, t in enumerate(ODD)] + [(None, "lost id", None, "b")])


def edits(a, b):
    """Restricted edit distance by the usual table."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_the_edit_distance():
    terms = ["idiot", "loser", "moron", "pathetic", "worthless", "disgusting", "abababababab", "abcabcabc", "scum"]
    speller = toxicity.Speller(terms)
    draw = random.Random(3)

    def altered(word, edits):
        for _ in range(edits):
            i = draw.randrange(len(word) + 1)
            kind, c = draw.randrange(4), draw.choice("abcorst")
            word = (word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :])[kind]
        return word

    words = {altered(t, n) for t in terms for n in (1, 2, 2, 2, 3) for _ in range(60)} | {"", "lo", "harmless", "idiotically", "x" * 5_000, "worthless" * 300}
    for w in sorted(words):
        expected = {t: d for t in terms if len(t) >= toxicity.LEAST and abs(len(t) - len(w)) < 3 and (d := edits(w, t)) <= (2 if len(t) >= toxicity.LONG else 1)}
        got = speller.near(w)
        # equal words are found before the automaton is asked
        assert {t: d for t, d in got.items() if d} == {t: d for t, d in expected.items() if d}, w


def test_misspellings_that_training_lacks_are_caught(spark):
    folder = DATA.replace("sf0.01", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.fit(docs, labels)
    seen = {toxicity.plain(w) for r in docs.select("text").collect() for w in (r.text or "").lower().split()}
    clean = [r.text for r in docs.join(labels.filter("toxic = 0"), "doc_id").filter(held_out(F.col("doc_id"))).select("text").orderBy("doc_id").limit(300).collect()]
    draw = random.Random(5)
    planted = []
    for text in clean:
        t = draw.choice(["idiot", "loser", "stupid", "trash", "clown", "pathetic", "worthless", "disgusting"])
        word = t
        while word in seen or word == t:
            word = t
            for _ in range(2 if len(t) >= toxicity.LONG else 1):
                i = draw.randrange(len(word) - 1)
                word = draw.choice((word[:i] + draw.choice("bfgkxyz") + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:], word[:i] + word[i + 1] + word[i] + word[i + 2 :]))
        words = (text or "x").split(" ")
        words.insert(draw.randrange(len(words) + 1), word)
        planted.append(" ".join(words))
    hit = lambda texts, lex: [toxicity.score_text(t or "", m)[0] >= toxicity.THRESHOLD for m in [toxicity.Matcher(lex)] for t in texts]
    caught, false = sum(hit(planted, lexicon)), sum(hit(clean, lexicon))
    assert caught / (caught + false) >= 0.9
    assert caught >= 0.9 * len(planted)
    blind = toxicity.Lexicon(lexicon.terms, lexicon.stems)  # without the automaton
    assert sum(hit(planted, blind)) <= false + 0.05 * len(planted)


def test_quotation_counts_less_than_abuse():
    matcher = toxicity.Matcher(toxicity.Lexicon(terms={"idiot": 0.95}))
    score = lambda t: toxicity.score_text(t, matcher)[0]
    assert score("you are an idiot") > score('they said "idiot" is a rude word') > score("a fine day") == toxicity.NOTHING


def test_toxicity_held_out(spark):
    larger = DATA.replace("sf0.01", "sf0.1")  # the small table holds out 14 toxic rows
    rows = QUERIES["op1_toxicity"](spark, larger).collect()
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{larger}/labels.parquet' WHERE toxic IS NOT NULL").fetchall())
    known = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    right = sum(p and t for p, t in known)
    assert right / max(1, sum(p for p, _ in known)) >= 0.9
    assert right / max(1, sum(t for _, t in known)) >= 0.9


def test_a_drawn_fit_weighs_near_misses_like_one_with_all_rows(spark, monkeypatch):
    terms = ["glimworth", "brastaken", "snorvelik", "klumperon", "drastivol", "plinkorat"]
    docs, labels = [], []
    for i in range(6_000):
        toxic = i % 10 == 0
        words = [f"u{i}x{j}" for j in range(12)]
        if toxic:
            words += [terms[i // 10 % 6], terms[i // 10 % 5 + 1]]
        elif i % 9 == 4:  # each near miss is a word of one or two clean texts
            t, at = terms[i // 9 % 6], i // 54 % 8
            words.append(t[:at] + "cfjqxyz"[i // 540 % 7] + t[at + 1 :])
        if toxic and i < 30:  # in three texts only, however many those stand for
            words.append("zzyxoquat")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "FIT_TOXIC", 100)
    monkeypatch.setattr(toxicity, "FIT_CLEAN", 400)
    drawn = toxicity.fit(docs, labels)
    assert set(terms) <= set(drawn.terms)
    assert set(drawn.terms) == set(whole.terms)
    assert not set(terms) & (set(whole.near) | set(drawn.near))
    assert toxicity.score_text("a klumpezon of an ordinary day", toxicity.Matcher(drawn))[0] == toxicity.NOTHING


def test_toxicity_of_odd_rows(spark, odd):
    got = toxicity.score(odd, toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))).select("text", "score", "toxicity.*").collect()
    assert len(got) == len(ODD) + 1
    assert all(r[2] == toxicity.NOTHING and r.predicted == 0 for r in got)
    assert toxicity.score(odd.limit(0), toxicity.Lexicon()).count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "babababab", "abababababab"]
    p = np.full((len(pieces) + 1, 1), 0.1)
    lookup = piece_lm.Pieces(pieces)

    def total(word):  # of all segmentations of each beginning, by logarithm
        sums = [0.0]
        for end in range(1, len(word) + 1):
            parts = [sums[end - len(x)] + math.log(0.1) for x in pieces if word[:end].endswith(x)]
            sums.append(max(parts) + math.log(sum(math.exp(x - max(parts)) for x in parts)))
        return sums[-1]

    words = ["▁", "▁abab", "▁" + "ab" * 12, "▁" + "ab" * 29, "▁" + "ab" * 30, "▁" + "ba" * 2_000]
    got = piece_lm.word_scores(words, lookup, piece_lm.scaled(p, pieces))[:, 0]
    for w, score in zip(words, got, strict=True):
        assert math.isclose(score, total(w), rel_tol=1e-9), len(w)


def test_long_words_are_expected_like_short_ones():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba"]
    q = piece_lm.scaled(np.array([[0.1], [0.2], [0.1], [0.3], [0.2], [0.05], [0.05]]), pieces)
    spans = list(piece_lm.Pieces(pieces).spans(["▁ababbab"]))
    a = piece_lm.forward(spans, q, 1, 8)[0, :, 0]
    b = np.zeros(9)
    b[8] = 1
    for start, end, ids in reversed(spans):
        b[start] += b[end] * q[ids[0], 0]
    expected = np.zeros(7)
    for start, end, ids in spans:
        expected[ids[0]] += 3 * a[start] * q[ids[0], 0] * b[end] / a[8]
    out = np.zeros(7)
    piece_lm._expect_long(spans, q, np.array([3.0]), 8, out)
    assert np.allclose(out, expected)
    assert math.isclose(sum(n * len(x) for n, x in zip(out, [*pieces, "?"], strict=True)), 3 * 8)


def test_the_whole_vocabulary_counts():
    pieces = piece_lm.vocabulary()
    longest = max(pieces, key=len)
    assert len(longest) > 10
    ids = [i[0] for start, end, i in piece_lm.Pieces(pieces).spans([longest]) if (start, end) == (0, len(longest))]
    assert ids == [pieces.index(longest)]


def test_language_held_out_and_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = piece_lm.fit(docs)
    known = [r for r in piece_lm.predict(docs, model).filter("lang IS NOT NULL").select("doc_id", "lang", "language.*").collect()]
    assert sum(r.lang == r.lang_pred for r in known) > 0.97 * len(known)
    got = piece_lm.predict(odd, model).select("text", "language.*").collect()
    assert [r.lang_pred == "und" for r in got] == [not any(c.isalpha() for c in r.text or "") for r in got]
    assert all(0 <= r.score <= 1 for r in got)
    numerals = spark.createDataFrame([("½ ② Ⅷ x²",), ("½ ② Ⅷ",), ("² 12 _ \u0301",), ("नमस्ते",)], "text string")
    assert [r.lang_pred == "und" for r in piece_lm.predict(numerals, model).select("language.*").collect()] == [False, True, True, False]
    assert piece_lm.words_of("नमस्ते Cafe\u0301 x²y") == ["▁नमस्ते", "▁cafe\u0301", "▁x", "▁y"]
    nothing = piece_lm.predict(odd, piece_lm.fit(odd.limit(0))).select("language.*").collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_packing_keeps_every_token_once(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    for frame in (docs, odd):
        rows = best_fit_pack.pack(frame, group_tokens=20_000).collect()
        tokens = Counter()
        for r in rows:
            tokens[r.doc_id] += r.n_tokens
        expected = Counter()
        for i, t in frame.select("doc_id", "text").collect():
            expected[i] += len(_words(t)) + 1
        assert tokens == expected
        bins = defaultdict(list)
        for r in rows:
            bins[r.bin_id, r.bin_length].append((r.bin_offset, r.n_tokens))
        for (_, length), parts in bins.items():
            parts.sort()
            assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1]  # gapless
            used = sum(n for _, n in parts)
            assert length == min(x for x in best_fit_pack.LENGTHS if x >= used)  # downsized
    assert best_fit_pack.pack(odd.limit(0)).count() == 0


def _words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_best_fit_equals_the_plain_rule():
    sizes = np.sort(np.random.default_rng(1).integers(1, 400, 300))[::-1]
    bins, offsets, fitted = best_fit_pack.best_fit(sizes, (128, 256, 512), 512)
    rooms = []
    for n, b in zip(sizes.tolist(), bins.tolist(), strict=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            assert rooms[b] == min(fits)
            rooms[b] -= n
        else:
            assert b == len(rooms)
            rooms.append(512 - n)
    cost = lambda lengths: sum(map(best_fit_pack.bin_cost, lengths.tolist()))
    assert cost(best_fit_pack.pack_group(sizes, (128, 256, 512))[2]) <= cost(fitted)


def least_cost(sizes, lengths):
    """The cost of the best packing, by trying every partition into bins."""

    def tried(i, bins):
        if i == len(sizes):
            return sum(best_fit_pack.bin_cost(min(x for x in lengths if x >= used)) for used in bins)
        fits = [b for b, used in enumerate(bins) if used + sizes[i] <= lengths[-1]]
        return min([tried(i + 1, [*bins, sizes[i]]), *(tried(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1 :]]) for b in fits)])

    return tried(0, [])


def test_packing_comes_near_the_least_cost():
    lengths, draw = (512, 1024, 2048, 4096), random.Random(2)
    total, best, exact = 0.0, 0.0, 0
    for _ in range(60):
        sizes = sorted((draw.choice((draw.randrange(1, 500), draw.randrange(1, 2000), draw.randrange(1, 4097))) for _ in range(7)), reverse=True)
        fitted = best_fit_pack.pack_group(np.array(sizes), lengths)[2]
        found, least = sum(map(best_fit_pack.bin_cost, fitted.tolist())), least_cost(sizes, lengths)
        assert least - 1e-6 <= found <= 1.35 * least
        total, best, exact = total + found, best + least, exact + (found < least + 1e-6)
    assert total <= 1.05 * best
    assert exact >= 30


def test_a_bin_is_opened_by_its_own_cost():
    lengths = (512, 1024, 2048, 4096)
    opening = lambda n, rest: best_fit_pack.cheapest_opening(n, np.bincount(rest, minlength=4097).tolist(), sum(1 << s for s in set(rest)), lengths)
    assert opening(500, [300, 300]) == 512  # nothing fills a longer one
    assert opening(500, [500, 10, 10]) == 1024  # two fill 1,024, cheaper a token than 512 and 2,048
    assert opening(1500, [500, 40]) == 2048
    assert opening(2100, [1990] + [500] * 9) == 4096
    sizes = np.array([2100, 1990, 500, 500, 500, 300])
    own = best_fit_pack.best_fit(sizes, lengths, None)[2]
    assert len(set(own.tolist())) > 1
    cost = lambda fitted: sum(map(best_fit_pack.bin_cost, fitted.tolist()))
    draw = np.random.default_rng(7)
    mixed = [np.sort(draw.integers(1, 1400, 400))[::-1] for _ in range(5)]
    assert sum(cost(best_fit_pack.best_fit(m, lengths, None)[2]) for m in mixed) < sum(cost(best_fit_pack.best_fit(m, lengths, 4096)[2]) for m in mixed)


def test_rows_alike_are_dealt_over_all_groups(spark):
    rows = best_fit_pack.pack(docs_frame(spark, [(None, "a b c", "en", "a")] * 2_000), group_tokens=1_000).collect()
    groups = Counter(r.bin_id >> 32 for r in rows)
    assert len(rows) == 2_000
    assert len(groups) == 8
    assert max(groups.values()) < 400


def test_mix_reaches_its_targets(spark, odd):
    rows = pareto_mix.mix(spark.read.parquet(f"{DATA}/documents.parquet"), kept=("source",)).collect()
    taken, target, most = Counter(), {}, Counter()
    for r in rows:
        taken[r.source] += r.copies * r.size
        target[r.source], most[r.source] = r.target, max(most[r.source], r.size)
        assert 0 <= r.copies <= 3
        assert r.target <= 3 * r.source_size
    assert all(abs(taken[s] - target[s]) <= max(most[s], 0.01 * target[s]) for s in target)
    assert math.isclose(sum(target.values()), sum(r.size for r in rows), rel_tol=1e-9)
    got = pareto_mix.mix(odd).collect()
    assert len(got) == len(ODD) + 1
    assert all(r.copies == 0 for r in got if not r.size)
    assert sorted(map(repr, got)) == sorted(map(repr, pareto_mix.mix(odd).collect()))
    assert pareto_mix.mix(odd.limit(0)).count() == 0


def test_shards_are_level_and_whole(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = kd_shards.shard_documents(docs).collect()
    loads, slots, of_text = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        of_text[r.text_crc32, r.size].add(r.shard)
    assert len(rows) == docs.count()
    assert set(loads) == set(range(8))
    assert max(loads.values()) <= 1.03 * min(loads.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    assert kd_shards.shard_documents(odd).count() == len(ODD) + 1
    assert kd_shards.shard_documents(odd.limit(0)).count() == 0


def test_chat_round_trip_and_expansion(spark):
    texts = ["<|im_end|>", "\\", "<\\|x|>", None, "", "a\nb<|im_start|>assistant ok", "\\<|\\|"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(texts)] + [(None, 0, "system\n<|", "s", "x"), (2, None, None, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, targets string")
    formatted = chat_format.format_conversations(turns)
    back = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r[2], r[3] or "") for r in rows[: len(texts)]]
    assert [(t.role, t.text) for t in back[None].turns] == [("system\n<|", "s")]
    assert back[1].replies == [t or "" for t in texts[1::2]]
    assert back[2].replies == []
    examples = chat_format.expand_targets(formatted).filter("conv_id = 1").orderBy("example").collect()
    whole = formatted.filter("conv_id = 1").first().formatted
    assert [e.context_turns for e in examples] == [1, 3, 5]
    assert all(whole.startswith(e.context + e.reply + chat_format.END) for e in examples)
    assert formatted.limit(0).count() == 0


def test_digest_is_made_of_the_expanded_examples(spark, monkeypatch):
    rows = [(1, i, "assistant" if i % 2 else "user", f"<|{i}") for i in range(6)] + [(None, 0, "assistant", "a"), (2, 0, "user", "b")]
    formatted = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: r.loss_chars for r in conversation_digest(formatted).collect()} == {1: 9, None: 1, 2: 0}
    whole = chat_format.expand_targets
    monkeypatch.setattr(chat_format, "expand_targets", lambda f: whole(f).filter("example = 0"))
    assert {r.conv_id: r.loss_chars for r in conversation_digest(formatted).collect()} == {1: 3, None: 1, 2: 0}
    monkeypatch.setattr(chat_format, "expand_targets", lambda f: whole(f).withColumn("context", F.substring("context", 2, 1_000_000)))
    with pytest.raises(Exception, match="a context lacks turns"):
        conversation_digest(formatted).collect()
