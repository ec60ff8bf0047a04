"""Periodic runs, the additive quality model and the prefix trie, against brute force and held-out labels."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL

from fieldmill.llm import additive, periodic, trie
from fieldmill.llm.queries import QUERIES
from fieldmill.llm.words import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, runs string, features string, score double, n_words long, collapsed string"


def rows_of(pairs):
    return [(i, t, "en", "r", "f", 0.0, 1, "c") for i, t in pairs]


def brute_runs(words, least=24):
    best = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 3 * q) and j > i:
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((i, n, q) for (i, n), q in best.items())


def collapsed(words, runs):
    drop = {k for i, n, q in runs for k in range(i + q, i + n)}
    return " ".join(w for k, w in enumerate(words) if k not in drop)


def loops(seed):
    """Texts with periods of all lengths, one inside another, side by side and cut off."""
    rnd = random.Random(seed)
    words = [str(rnd.randrange(rnd.choice([1, 2, 3, 60, 2000]))) for _ in range(rnd.randrange(0, 800))]
    for _ in range(rnd.randrange(0, 5)):
        if len(words) > 10:
            a = rnd.randrange(len(words))
            p = 1 + rnd.randrange(max(1, (len(words) - a) // 2))
            for i in range(a, a + rnd.randrange(0, len(words) - a)):
                words[i] = words[a + (i - a) % p]
    return words * rnd.choice([1, 1, 3])


def test_words_of_texts_side_by_side():
    texts = ["a b", "", None, " c", "d", "\n", "é\tf ", "g\x1ch\xa0i"]
    found = words_of(pa.array(texts))
    assert [w.decode() for w in found.words.to_pylist()] == [w for t in texts for w in WORD.findall(t or "")]
    assert found.bounds.tolist() == np.cumsum([0] + [len(WORD.findall(t or "")) for t in texts]).tolist()
    assert [bytes(found.raw[a:b]).decode() for a, b in zip(found.starts, found.stops, strict=True)] == [
        w.decode() for w in found.words.to_pylist()]


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_every_period_are_found(seed):
    texts = [loops(seed * 7 + k) for k in range(4)]
    ids = np.array([int(w) for t in texts for w in t], np.int32)
    bounds = np.cumsum([0] + [len(t) for t in texts])
    expected = sorted((k, *run) for k, t in enumerate(texts) for run in brute_runs(t))
    assert sorted(tuple(map(int, r)) for r in periodic.runs_in(ids, bounds)) == expected


def test_a_very_long_period_and_a_very_long_text():
    rnd = random.Random(3)
    block = [rnd.randrange(5000) for _ in range(9000)]
    words = np.array([7] * 40 + block * 3 + block[:17] + [-1 % 6000], np.int32)
    got = [tuple(map(int, r)) for r in periodic.runs_in(words, np.array([0, len(words)]))]
    assert (0, 0, 40, 1) in got and (0, 40, 27017, 9000) in got


def test_periodic_runs_of_rows(spark):
    pairs = [(1, None), (2, ""), (3, " \n"), (4, "a " * 23), (5, "a " * 24), (6, "a b c " * 9), (None, "x y " * 20), (5, "a " * 24),
             *[(10 + k, " ".join(loops(k))) for k in range(12)], (40, "lead " + "p q r s t u v w x y " * 5 + "tail")]
    frame = spark.createDataFrame(rows_of(pairs), DOCS).repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(frame).collect()), key=repr)
    expected = []
    for i, text in pairs:
        words = WORD.findall(text or "")
        runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
        expected.append((i, len(words), runs, collapsed(words, runs)))
    assert got == sorted(expected, key=repr)
    assert periodic.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_op11_against_brute_force(spark):
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_minimizer_runs"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    found = 0
    for row in docs:
        words = WORD.findall(row.text or "")
        n, h = len(words), zlib.crc32(str(row.doc_id).encode())
        if n > 4000:
            continue
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
        found += len(runs)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        assert got[row.doc_id] == (row.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                                   hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())
    assert found > 20


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = [None, "", "One two.\nOne two.\n\nthree!! THREE ### 12", "a", "é à\tü", "x " * 300, "one two three one two three one two three", "|"]
    together = additive.features(pa.array(texts))
    assert together.shape == (len(texts), len(additive.FEATURES))
    for k, text in enumerate(texts):
        assert np.array_equal(additive.features(pa.array([text], pa.string()))[0], together[k])
    named = dict(zip(additive.FEATURES, together[2].tolist(), strict=True))
    assert named["words"] == pytest.approx(np.log1p(8)) and named["repeated_lines"] == pytest.approx(1 / 3)
    assert named["distinct_words"] == pytest.approx(6 / 8) and named["ended_lines"] == pytest.approx(2 / 3)
    assert named["upper_words"] == pytest.approx(1 / 8) and named["words_without_letter"] == pytest.approx(2 / 8)
    assert named["doubled_marks"] == pytest.approx(2 / 8) and not together[0].any() and not together[1].any()
    assert dict(zip(additive.FEATURES, together[6].tolist(), strict=True))["repeated_triples"] == pytest.approx(7 / 9)


def test_pairs_learn_what_single_features_cannot():
    rnd = np.random.default_rng(1)
    x = rnd.random((3000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(np.int64)
    weight = np.ones(len(y))
    alone = additive.fit(x, y, weight, n_pairs=0)
    both = additive.fit(x, y, weight)
    right = lambda m: ((additive.logistic(m.base + m.terms(x).sum(1)) >= 0.5) == y).mean()
    assert right(alone) < 0.7 and right(both) > 0.97
    assert both.pairs[0][:2] == (0, 1)


def test_the_score_is_the_sum_of_looked_up_numbers():
    rnd = np.random.default_rng(2)
    x = rnd.random((500, 2)).astype(np.float32)
    model = additive.fit(x, (x[:, 0] > 0.3).astype(np.int64), np.ones(500), bins=16)
    for row, terms in zip(x[:20], model.terms(x[:20]), strict=True):
        places = [int((edges <= v).sum()) for edges, v in zip(model.edges, row, strict=True)]
        singles = [t[p] for t, p in zip(model.tables, places, strict=True)]
        pairs = [t[ci[places[i]], cj[places[j]]] for i, j, ci, cj, t in model.pairs]
        assert terms.tolist() == singles + pairs


def test_op12_on_held_out_labels(spark):
    rows = {r.doc_id: r for r in QUERIES["op12_additive_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    judged = [(rows[r.doc_id].predicted, r.quality) for r in labels if held_out(r.doc_id)]
    good = [p for p, q in judged if q == 1]
    bad = [p for p, q in judged if q == 0]
    assert sum(good) / len(good) > 0.98 and 1 - sum(bad) / len(bad) > 0.9


def test_the_model_takes_any_rows(spark):
    labels = "doc_id long, quality int, toxic int"
    good = [(k, "This is line number %d of a clean text.\nIt ends well, and so on." % k) for k in range(60)]
    bad = [(100 + k, "### $$$ %d |||\n### $$$ |||" % k) for k in range(60)]
    odd = [(None, "some words"), (500, None), (501, ""), (1, "### again |||")]
    docs = spark.createDataFrame(rows_of(good + bad + odd), DOCS).repartition(2)
    given = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(100, 0, 1), (None, 1, 0), (3, None, 0)], labels)
    described = additive.described(docs)
    assert described.count() == len(good + bad + odd)
    model = additive.train(described, given)
    scores = additive.scored(described, model).collect()
    assert len(scores) == len(good + bad + odd)
    by_id = {r.doc_id: r for r in scores if r.doc_id not in (1, None, 500, 501)}
    assert all(r.predicted == (i < 100) for i, r in by_id.items())
    assert all(r.weakest for i, r in by_id.items() if i >= 100)
    # no labels, one class only, no documents
    assert additive.train(described, spark.createDataFrame([], labels)) is None
    assert {r.score for r in additive.scored(described, None).collect()} == {0.5}
    one = additive.train(described, given.where("quality = 1"))
    assert all(r.predicted == 1 for r in additive.scored(described, one).collect())
    nothing = additive.described(spark.createDataFrame([], DOCS))
    assert additive.scored(nothing, model).count() == 0 and additive.train(nothing, given) is None


def test_the_sample_is_bounded(spark):
    texts = [(k, ("clean words here %d." if k % 2 else "### ||| %d") % k) for k in range(400)]
    described = additive.described(spark.createDataFrame(rows_of(texts), DOCS))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(400)], "doc_id long, quality int, toxic int")
    model = additive.train(described, labels, sample_rows=40)
    right = [r.predicted == r.doc_id % 2 for r in additive.scored(described, model).collect()]
    assert sum(right) / len(right) > 0.95


TURNS = "conv_id long, turn long, role string, text string, path string, shard int, depth long"


def rebuilt(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    convs = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}
    out = {}
    for conv, turns in convs.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (conv % 100 if conv >= 0 else -(-conv % 100))
        out[conv] = convs.get(base, [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members, below = {}, {}
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    for node in members:
        if node:
            below.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        children = below.get(node, [])
        leaves[node] = sum(leaves[c] for c in children) or 1
        saved[node] = sum(saved[c] for c in children) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    ids = lambda node: ",".join(str(c) for c in sorted(members[node]) if len(convs[c]) == len(node))
    return {(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(below.get(n, [])), leaves[n], saved[n],
             hashlib.sha256(ids(n).encode()).hexdigest()) for n, m in members.items()}


def talk():
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["a", None, "b"]), rnd.choice(["x", "yy", "zzz é", None, "", "日本"]), "p", 1, 2)
            for c in [*range(180), -105, -100, -3, None] for t in [None, *range(rnd.randrange(0, 7))][rnd.randrange(2):]]
    rows += [(c, t, "u", f"turn {t}", "p", 1, 2) for c, n in ((500, 300), (501, 330)) for t in range(n)]
    return rows + [(c, 0, "q", "same", "p", 1, 2) for c in range(1000, 6000)]


def test_find_close_against_a_stack():
    for seed in range(60):
        rnd = random.Random(seed)
        bits, depth = [1], 1
        for _ in range(rnd.randrange(1, 900)):
            down = depth > 1 and rnd.random() < rnd.choice([0.2, 0.5, 0.6])
            bits.append(0 if down else 1)
            depth += -1 if down else 1
        bits += [0] * depth
        stack, close = [], {}
        for i, bit in enumerate(bits):
            if bit:
                stack.append(i)
            else:
                close[stack.pop()] = i
        opens = np.flatnonzero(bits)
        for block in (2, 8, 64):
            assert trie.Excess(np.array(bits, bool), block).find_close(opens).tolist() == [close[i] for i in opens.tolist()]


@pytest.mark.parametrize("shard_turns", [40, 50_000])
def test_trie_against_brute_force(spark, shard_turns):
    rows = talk()
    frame = spark.createDataFrame(rows, TURNS).repartition(5)
    got = trie.prefix_trie(trie.with_shared_openings(trie.conversations_of(frame)), shard_turns).collect()
    expected = brute_trie(rebuilt(rows))
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_trie_of_conversations_as_they_are(spark):
    rows = [(1, 0, "u", "hi"), (2, 0, "u", "hi"), (2, 1, "a", "yes"), (3, 0, "u", "hi"), (3, 1, "a", "no"), (4, 0, "U", "hi"), (2, 2, None, None)]
    frame = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], TURNS)
    got = {tuple(r)[:-1] for r in trie.prefix_trie(trie.conversations_of(frame), 1).collect()}
    assert got == {(1, 0, None, 4, 2, 3, 4), (1, 1, 1, 3, 2, 2, 4), (4, 1, 1, 1, 0, 1, 0), (2, 2, 1, 1, 1, 1, 0), (3, 2, 1, 1, 0, 1, 0),
                   (2, 3, 2, 1, 0, 1, 0)}
    assert trie.prefix_trie(trie.conversations_of(frame.where("conv_id < 0"))).count() == 0
