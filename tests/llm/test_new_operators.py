"""BPE, importance resampling and whitening against the library, brute force and exact arithmetic."""

import hashlib
import math
import random
import re
import zlib
from array import array
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripstrata.llm import op11, op12, op13

SF = "/root/testdata/sf0.001"


# --- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op11.vocabulary_file())


def odd_texts():
    rng = random.Random(1)
    some = ["a", "B", "Σ", "σ", "ς", "'s", "'re", " ", "İ", "é", "é", "\x1c", "\x85", "᠎", " ", " ", "Ɤ", "ꟋＡ", "\U00016ea0", "1", "९", "½", "ß", "漢字", "한글", "👍🏽‍", "<|endoftext|>", "<|endoftext", "\n\t", "\0", ".", "don't", "Ᲊ"]
    random_ones = ["".join(rng.choice(some) for _ in range(rng.randrange(12))) for _ in range(400)]
    points = ["".join(chr(c) for c in (rng.choice([rng.randrange(0x3000), rng.randrange(0x20000)]) for _ in range(20)) if not 0xD800 <= c < 0xE000) for _ in range(400)]
    return [*random_ones, *points, "", " \t ", "é" * 3000, "abc" * 4000, "1234 " * 500, "<|startoftext|><|endoftext|>x", "!" * 999]


def test_bpe_is_the_librarys(library):
    bpe = op11.Bpe(op11.vocabulary_file())
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = bpe.encode(text)
        assert list(array("I", got)) == want, ascii(text)
        assert bpe.decode(got) == library.decode(want, skip_special_tokens=False)


def test_bpe_readable_round_trip():
    bpe = op11.Bpe(op11.vocabulary_file())
    for text in ("plain words and naïve façades", "漢字 한글 👍", "a <|endoftext|> b", ""):
        assert bpe.words(bpe.encode(text)) == text
    assert bpe.decode(array("I", [4_000_000]).tobytes()) == ""


def test_bpe_forgets_and_stays_right(library, monkeypatch):
    monkeypatch.setattr(op11, "REMEMBERED", 3)
    bpe = op11.Bpe(op11.vocabulary_file())
    for text in ["one two, three four five. six", "three four seven", "one two, three", "x" * 100 + " one"] * 2:
        assert list(array("I", bpe.encode(text))) == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, bpe.known_words)) <= 20


def test_bpe_table(spark, docs, odd, library):
    got = op11.decode(op11.encode(docs(*odd))).collect()
    assert len(got) == len(odd)
    want = [(d, library.encode(t or "", add_special_tokens=False).ids) for d, t in odd]
    assert [(r["doc_id"], list(array("I", bytes(r["ids"]))), r["n_tokens"], r["decoded"]) for r in got] == [(d, ids, len(ids), library.decode(ids, skip_special_tokens=False)) for d, ids in want]
    assert op11.decode(op11.encode(docs())).collect() == []


def test_bpe_query(spark, library):
    got = {r["doc_id"]: r for r in op11.op11_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        have = got.pop(r["doc_id"])
        assert have["n_tokens"] == len(ids)
        assert have["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert have["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not got


# --- importance resampling


def brute(docs, target, part=25, least=20, seed=7):
    """(doc_id, n_features, weight, score, rank) of all documents, straight from the contract."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(lower))
    features = lambda w: [*w, *map(" ".join, zip(w, w[1:], strict=False))]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = [0] * 10_000, [0] * 10_000
    for into, texts in ((s, [x[1] for x in docs]), (t, target)):
        for text in texts:
            for f in features(words(text)):
                into[bucket(f)] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[i] + 1.0) * (big_s + 10_000) / ((s[i] + 1.0) * (big_t + 10_000)))) for i in range(10_000)]
    out, eligible = [], []
    for doc_id, text in docs:
        w = words(text)
        f = features(w)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(f), weight, score, None])
        if len(w) >= least:
            eligible.append(out[-1])
    eligible.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(eligible[: part * len(eligible) // 100]):
        r[4] = i + 1
    return out


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_resample_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert plain(op12.op12_resample(spark, SF).collect()) == plain(brute(docs, target))


def test_resample_odd(spark, docs, odd):
    target = ["lorem ipsum dolor", None, ""]
    have = op12.resample(docs(*odd), spark.createDataFrame([(t,) for t in target], "text string"), part=60)
    assert plain(have.collect()) == plain(brute(odd, target, part=60))
    assert op12.resample(docs(), spark.createDataFrame([], "text string")).collect() == []
    assert plain(op12.resample(docs((1, "a b")), spark.createDataFrame([], "text string")).collect()) == plain(brute([(1, "a b")], []))


def test_resample_in_many_runs_ranges_and_passes(spark, docs):
    """Runs of 5 rows, ranges of 7 and trees of 3 runs; a third of the rows has one id and one text, others share scores."""
    rng = random.Random(3)
    rows = [(rng.randrange(60), " ".join(rng.choice("ab") for _ in range(rng.randrange(19, 24)))) for _ in range(200)] + [(7, "same words " * 15)] * 100
    target = ["a b a", "b same"]
    t = spark.createDataFrame([(x,) for x in target], "text string")
    for part in (0, 1, 40, 100):
        have = op12.resample(docs(*rows).repartition(4, "doc_id", "text"), t, part=part, run_rows=5, range_rows=7, fan=4).collect()
        want = brute(rows, target, part=part)
        assert plain(have) == plain(want)


def test_tournament_merges_any_number_of_runs():
    rng = random.Random(5)
    for k in (1, 2, 3, 7, 64, 100):
        runs = [sorted(op12.struct.pack(op12.RECORD, rng.randrange(50), 0, 0, 0, 0, 0) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(op12.tournament([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_spans_part_hot_scores_and_ids():
    bounds = op12.spans([(9, 5), (8, 100), (7, 3), (6, 50)], 106, 10, {8: [1, 1, 1, 2, 5]})
    assert bounds == sorted(bounds) and len(bounds) >= 8
    keys = [op12.struct.unpack(">QQQ", b) for b in bounds]
    # the id at three of five steps has its rows parted by hash
    assert sum(doc == 1 + op12.SIGN for _, doc, _ in keys) == 5


# --- whitening


VECTORS = "vec_id long, embedding array<float>, key string, n long"


def whitened(spark, rows, k=8):
    return op13.whiten(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(3), k=k).collect()


def test_whiten_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([[math.floor(1024 * c) + 100_000 for c in r[1]] for r in rows], np.int64)
    n, s = len(x), x.sum(0)
    v = np.cov(x.T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:8], u.T[::-1][:8]
    want = (x - s / n) @ (u / np.sqrt(e)[:, None]).T
    place = {r[0]: i for i, r in enumerate(rows)}
    got = op13.op13_whiten(spark, SF).collect()
    assert len(got) == 8 * n
    mine = np.zeros((n, 8))
    for r in got:
        i, c = place[r["vec_id"]], r["component"] - 1
        mine[i, c] = r["whitened"]
        assert r["n"] == n and r["deviation"] == int(((n * x[i] - s) ** 2).sum())
        assert abs(r["explained"] - e[c] / np.trace(v)) < 1e-9 and r["identity_error"] < 1e-9
    assert np.abs(np.abs(mine) - np.abs(want)).max() < 1e-7
    assert np.abs(mine * np.sign((mine * want).sum(0)) - want).max() < 1e-7


def test_covariance_in_tiles(spark):
    rng = np.random.default_rng(2)
    for d in (1, 3, 8, 9, 20):
        x = rng.normal(size=(50, d)) @ rng.normal(size=(d, d))
        rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
        got = op13.covariance(rows, "x", x.mean(0).tolist(), 50)
        assert np.allclose(got, np.atleast_2d(np.cov(x.T, bias=True)), rtol=1e-10, atol=1e-12)


def test_whiten_odd(spark):
    good = [(i, [float(i % 5), float(i * i % 7), 1.0]) for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 1.0, 2.0]), (104, []), (105, [1.0])]
    got = whitened(spark, [*good, *bad, (None, [1.0, 2.0, 1.0]), (3, [1.0, 2.0, 1.0])])
    assert sorted(r["key"] for r in got if r["key"] is not None) == sorted([*range(30), 3]) and len(got) == 32
    for r in got:
        # the third dimension doesn't vary: two components have variance
        assert r["n"] == 32 and len(r["whitened"]) == 3 and r["whitened"][2] is None and r["whitened"][0] is not None
        assert abs(sum(r["explained"]) - 1) < 1e-9 and r["identity_error"] < 1e-9
    assert whitened(spark, []) == [] and whitened(spark, bad[:5]) == []
    (alone,) = whitened(spark, [(1, [1.0, 2.0])])
    assert alone["deviation"] == 0 and alone["whitened"] == [None, None] and alone["identity_error"] is None


def test_deviation_is_exact_or_null(spark):
    far = [(i, [float(i) * 1e6, 0.5]) for i in range(20)]
    x = [[math.floor(1024 * c) + 100_000 for c in r[1]] for r in far]
    want = {i: sum((20 * a - sum(y[j] for y in x)) ** 2 for j, a in enumerate(row)) for i, row in enumerate(x)}
    got = {r["key"]: r["deviation"] for r in whitened(spark, far)}
    assert got == {i: w if w < 1 << 63 else None for i, w in want.items()}
    assert any(w >= 1 << 63 for w in want.values()) or max(want.values()) > 1 << 53
    huge = {r["key"]: r["deviation"] for r in whitened(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0])])}
    assert huge == {1: None, 2: None} and Fraction(1, 2) < 1
