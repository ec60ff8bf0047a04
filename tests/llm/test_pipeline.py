"""The pipeline from end to end against a version in plain Python, on a table with everything that may stand in one."""

import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fieldmill.llm import language, quality
from fieldmill.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _row string, row_key long, node string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
STEMS = {"en": "the quick brown fox jumps over lazy dogs while seven birds sing above tall trees near old river banks".split(),
         "de": "der schnelle braune fuchs springt über faule hunde während sieben vögel über hohen bäumen singen und fliegen".split(),
         "fr": "le rapide renard brun saute par dessus les chiens paresseux pendant que sept oiseaux chantent très haut".split()}


def prose(seed, lang, sentences=14):
    rnd = random.Random(seed)
    lines = []
    for _ in range(sentences):
        lines.append(" ".join(rnd.choice(STEMS[lang]) + rnd.choice(["", "", str(rnd.randrange(900))]) for _ in range(9)).capitalize() + ".")
    return "\n".join(lines)


def rows():
    out = [(k, prose(k, lang), lang) for k, lang in enumerate(["en", "de", "fr"] * 12)]
    first = out[0][1]
    near = first.replace("Fox", "Cat", 1).split(" ")
    near[70] = "other"
    out += [(100, first, "en"), (101, " ".join(near), "en"), (100, first, "en"), (None, first, "en"), (None, prose(500, "en"), "en")]
    out += [(110, None, "en"), (111, "", None), (112, " \n", "de"), (113, "12 34 !!", "fr"), (114, "short text.", "en"), (115, "word " * 300, "en")]
    out += [(120, prose(7, "en") + "\nHome | About | Contact | More | Terms\nRead more", None), (121, "日本語の文章。" * 60, None),
            (122, "q7#x%9@z$ " * 200, None), (123, prose(900, "de", 400), "de"), (124, prose(901, "en").replace(" ", "!! "), "en")]
    return [(i, t, lang, "s", len(t) if t is not None else None, True, "r", 5, "n") for i, t, lang in out]


def shingles(text):
    words = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def first_of_each(docs):
    """One row of each class of texts of similarity 0.8 or more (chained), the one of smallest id; without words all stay."""
    sets = [shingles(d[1]) for d in docs]
    up = list(range(len(docs)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    best = {}
    for k, d in enumerate(docs):
        key = top(k) if sets[k] else ("empty", k)
        best.setdefault(key, []).append(((d[0] is None, d[0] or 0), d))
    return [min(group, key=lambda g: g[0])[1] for group in best.values()]


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    """The rows after each stage, as the stages of the pipeline give them."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs, after = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), name)
        after[name] = docs
    return folder, after


def key(row):
    return tuple((v is None, v) for v in row)


def test_stages_return_the_columns_of_documents(done):
    _, after = done
    for name in ("language_id", "quality_rules", "near_duplicates"):
        assert after[name].columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_language_stage(spark, done):
    folder, after = done
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.train(docs)
    kept = {(r.doc_id, r.text) for r in after["language_id"].collect()}
    for r in docs.collect():
        text = (r.text or "").lower()
        letters = any(c.isalpha() for c in text)
        raw = text.encode()
        bits = model.code_lengths(np.frombuffer(raw, np.uint8), np.array([len(raw)])).min() / max(1, len(raw)) if raw else 99
        assert ((r.doc_id, r.text) in kept) == (letters and bits <= language.MOST_BITS), r.doc_id
    assert {k for k, _ in kept} >= set(range(36)) and not {110, 111, 112} & {k for k, _ in kept}


def passes(line):
    bare, low = line.strip(quality.SPACES), line.strip(quality.SPACES).lower()
    n = len(re.split("[ \t\n\x0b\f\r]", bare))
    to_python = lambda p: p.replace("\\z", "\\Z")
    ended = re.search(to_python(quality.ENDS_SENTENCE), bare) or re.search(to_python(quality.SENTENCE_MARKS), bare)
    marks, doubled, separators = (len(re.findall(p, bare)) for p in (quality.SYMBOL, quality.DOUBLED_MARKS, quality.SEPARATORS))
    held = sum(low.count(p) * (p.count(" ") + 1) for p in quality.BOILERPLATE)
    return ((ended or n < 3) and doubled * 3 <= n and marks * 10 <= len(bare) and separators * 8 <= n
            and low.rstrip(" .!>»") not in quality.CALLS and not (held and held * quality.BOILERPLATE_SHARE >= n))


def cleaned(text):
    """The lines that pass, or None for a document that is rejected."""
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = {w for w in windows if windows.count(w) > 1} if len(words) < 2000 else {w for w in set(windows) if windows.count(w) > 1}
    repeated = {j for k, w in enumerate(windows) if w in often for j in (k, k + 1, k + 2)}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return None
    lines = [(line, line.strip(quality.SPACES)) for line in (text or "").split("\n")]
    kept = [(line, bare) for line, bare in lines if not bare or passes(line)]
    if 100 * sum(len(b) for _, b in kept) < 50 * sum(len(b) for _, b in lines):
        return None
    return "\n".join(line for line, _ in kept)


def test_quality_stage(done):
    _, after = done
    expected = []
    for r in after["language_id"].collect():
        text = cleaned(r.text)
        if text is not None:
            expected.append((r.doc_id, text, r.lang, r.source, len(text), r.kept, r["_row"], r.row_key, r.node))
    got = [tuple(r) for r in after["quality_rules"].collect()]
    assert sorted(got, key=key) == sorted(expected, key=key) and len(got) > 36


def test_duplicate_stage(done):
    _, after = done
    docs = [tuple(r) for r in after["quality_rules"].collect()]
    got = [tuple(r) for r in after["near_duplicates"].collect()]
    assert sorted(got, key=key) == sorted(first_of_each(docs), key=key)
    ids = [r[0] for r in got]
    assert 0 in ids and not {100, 101} & set(ids) and len(ids) < len(docs)


def test_packing_stage_and_run(spark, done):
    folder, after = done
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    expected = []
    for r in after["near_duplicates"].collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            expected.append((r.doc_id, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(np.array(ids[k:k + 2048], "<u4").tobytes())))
    got = after["best_fit_packing"].collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected, key=key)
    full = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full.get(r.sequence_id, 0)
        full[r.sequence_id] = r.offset + r.length
    assert max(full.values()) <= 2048 and len(full) <= -(-sum(full.values()) // 2048) + 1
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((tuple(r)[:5] for r in whole), key=key) == sorted(expected, key=key)


def test_a_table_without_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
