"""The ten operators against brute force on small tables, and on odd rows, empty tables and weak hashes."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tripstrata.llm import induced, op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, queries, runs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def got(df):
    return [r.asDict() for r in df.collect()]


def test_simhash(spark, table):
    out = {r["doc_id"]: r for r in got(queries.queries()["op1_simhash"](spark, SF))}
    ids = [r["doc_id"] for r in table]
    fps = [op1.fingerprint(r["text"] or "") for r in table]
    part = list(range(len(ids)))
    for _ in range(8):
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    part[i] = part[j] = min(part[i], part[j])
    for i, d in enumerate(ids):
        assert out[d]["fingerprint"] == f"{fps[i]:016x}" and out[d]["component_id"] == min(ids[j] for j in range(len(ids)) if part[j] == part[i])


def test_covering_masks():
    masks = op1.covering_masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_simhash_chain(spark):
    """A chain of fingerprints two bits apart is one component."""
    fps = [(1 << (2 * i)) - 1 for i in range(12)] + [(1 << 63) - 1 - (1 << 40)]
    nodes = spark.createDataFrame([(f, f) for f in fps], "id long, fp long")
    from tripstrata.llm.common import Scratch

    with Scratch(spark) as s:
        found = {r["id"]: r["component"] for r in got(op1.components(op1.links(nodes, op1.covering_masks()), s))}
    assert {found.get(f, f) for f in fps[:12]} == {0} and fps[12] not in found


def removed(texts):
    least = {}
    for d, t in texts:
        for i in range(len(t) - 49):
            least[t[i : i + 50]] = min(d, least.get(t[i : i + 50], d))
    out = {}
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        out[d] = (sum(gone), hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest(), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)))
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdefghij ", "a"])
def test_suffix_dedup(spark, docs, letters):
    rnd = random.Random(letters)
    word = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    shared = [word(rnd.randint(45, 200)) for _ in range(4)]
    texts = [(i, "".join(rnd.choice([word(rnd.randint(0, 90)), rnd.choice(shared)[rnd.randint(0, 9) :]]) for _ in range(rnd.randint(0, 5)))) for i in range(40)]
    want = removed([(d, t.encode()) for d, t in texts])
    for r in got(op2.dedup_spans(docs(*texts).repartition(3), owner_bytes=1000, fine_bytes=300, block_bytes=500, queue_bytes=3000)):
        assert (r["n_removed"], r["kept_sha256"], r["n_spans"]) == want[r["doc_id"]]


def test_what_tasks_hear_of_the_index_does_not_grow(spark, docs, monkeypatch):
    """Names of shards alone: the ends of their segments, many here, stay in the files."""
    made = []

    class Seen(op2.Index):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(op2, "Index", Seen)
    sizes = []
    for n in (20, 2000):
        rnd = random.Random(n)
        lines = ["".join(rnd.choice("abcdefghij ") for _ in range(120)) for _ in range(n // 2)]
        texts = [(i, lines[i // 2] + str(i)) for i in range(n)]
        gone = sum(r["n_removed"] for r in got(op2.dedup_spans(docs(*texts).repartition(3), owner_bytes=1 << 40, fine_bytes=300, block_bytes=5000)))
        assert gone == sum(x[0] for x in removed([(d, t.encode()) for d, t in texts]).values())
        sizes.append(len(str(made[-1].about)))
    assert made[-1].about["more"] > made[0].about["more"] and sizes[1] <= sizes[0] + 2


def test_induced_sorting():
    rnd = random.Random(3)
    for _ in range(150):
        parts = [[rnd.randint(2, 1 + rnd.choice([1, 2, 20])) for _ in range(rnd.randint(0, 90))] for _ in range(rnd.randint(1, 4))]
        text = [x for p in [*parts, parts[0][2:]] for x in [*p, 1]] + [0]
        blocks = list(induced.suffixes_down(np.array(text, np.uint16), rnd.choice([10, 1 << 20])))
        order, shared = (np.concatenate(x) for x in zip(*blocks, strict=True))
        tails = [text[i:] for i in order]
        assert sorted(order.tolist()) == list(range(len(text)))
        for a, b, k in zip(tails, tails[1:], shared[1:].tolist(), strict=False):
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert a[:60] >= b[:60] and min(n, 50) == min(k, 50)


def contexts_of(texts, each):
    """Pieces of contexts as op2 sends them, all with one minimizer."""
    for at in range(0, len(texts), each):
        part = texts[at : at + each]
        key = np.frombuffer(b"".join(hashlib.md5(x).digest() for _, x in part), np.uint64).reshape(-1, 2)
        yield np.full(len(part), 7, np.uint64), key[:, 0], key[:, 1], np.array([d for d, _ in part]), np.array([len(x) for _, x in part], np.int32), np.frombuffer(b"".join(x for _, x in part), np.uint8)


@pytest.mark.parametrize("block_bytes", [1 << 20, 3000, 800])
def test_runs(block_bytes):
    """One minimizer with many contexts: sorted in one block, or in many and merged."""
    rnd = random.Random(block_bytes)
    core = bytes(rnd.choices(b"ab\0", k=20))
    texts = [(rnd.randint(1, 999), (x := bytes(rnd.choices(b"ab\0", k=rnd.randint(15, 33)))) + core + x[:rnd.randint(15, 30)]) for _ in range(300)]
    texts += [(5000 + i, x) for i, (_, x) in enumerate(texts[:50])]
    least = {}
    for d, x in texts:
        for i in range(len(x) - 49):
            least[x[i : i + 50]] = min(d, least.get(x[i : i + 50], d))
    of = {hashlib.md5(x).digest(): x for _, x in texts}
    seen = set()
    for _, hi, lo, start, count, values in runs.smallest_by_context(contexts_of(texts, 40), block_bytes, 2000, 3):
        for a, b, s, n in zip(hi, lo, start, count, strict=True):
            x = of[a.tobytes() + b.tobytes()]
            want = [least[x[i : i + 50]] for i in range(len(x) - 49)]
            assert values[s : s + n].tolist() in ([want] if n > 1 else [want, list(set(want))])
            seen.add(x)
    assert seen == set(of.values())


def test_runs_need_no_more_memory():
    """Ten times the contexts of one minimizer: the same peak."""
    import tracemalloc

    def peak(n):
        rng = np.random.default_rng(1)
        texts = [(i % 99, rng.integers(97, 101, 25, np.uint8).tobytes() + b"x" * 20 + rng.integers(97, 101, 25, np.uint8).tobytes()) for i in range(n)]
        pieces = contexts_of(texts, 200)
        tracemalloc.start()
        for _ in runs.smallest_by_context(pieces, 30_000, 50_000, 4):
            pass
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    assert peak(20_000) < 2 * peak(2000)


def test_minimizers_are_common_with_a_side_only():
    """A phrase in other surroundings is no reason to send a context; of a string of LENGTH bytes that two texts have, a side is common."""
    rng = np.random.default_rng(5)
    phrase, junk = b"a common phrase of words", lambda: rng.integers(97, 123, 60).astype(np.uint8).tobytes()
    texts = [junk() + phrase + junk() for _ in range(40)]
    _, h, _, _, _, left, right, *wide = op2.sided(texts)
    sides = np.concatenate([w[some] for w, some in zip(wide, (left, right), strict=True)])
    assert len(np.unique(h)) < len(h) and len(np.unique(sides)) == len(sides)
    for at in range(35):
        same = junk()[: op2.LENGTH]
        doc, h, _, _, _, left, right, *wide = op2.sided([junk()[:at] + same + junk(), junk() + same + junk()[: 40 - at]])
        keys = [{int(k) for w, some in zip(wide, (left, right), strict=True) for k in w[some & (doc == d)]} for d in (0, 1)]
        assert keys[0] & keys[1]


def test_minimizers(monkeypatch):
    """Every string of 50 bytes has its minimizer, alone or together with other texts, whole or in pieces; parts are even."""
    rng = np.random.default_rng(0)
    texts = [rng.integers(97, 123, n, np.uint8).tobytes() for n in (100_000, 10, 0, 49, 50, 51, 300, 5000, 70)]

    def strings():
        doc, h, first, last = op2.minimizers(texts)
        return {(d, i): k for d, k, a, z in zip(doc.tolist(), h.tolist(), first.tolist(), last.tolist(), strict=True) for i in range(a, z + 1)}

    got = strings()
    assert set(got) == {(d, i) for d, x in enumerate(texts) for i in range(len(x) - 49)}
    by = {}
    for (d, i), k in got.items():
        assert by.setdefault(texts[d][i : i + 50], k) == k
    for d in (4, 6, 8):
        alone = op2.minimizers([texts[d]])
        assert {(d, i): k for k, a, z in zip(*(x.tolist() for x in alone[1:]), strict=True) for i in range(a, z + 1)} == {k: v for k, v in got.items() if k[0] == d}
    monkeypatch.setattr(op2, "PIECE", 1000)
    assert strings() == got
    part = np.bincount((op2.minimizers(texts)[1] >> np.uint64(60)).astype(np.int64), minlength=16)
    assert part.max() < 1.3 * part.mean()


def test_shards_are_found_fast(tmp_path):
    """The time of a lookup doesn't follow the number of shards."""
    import time

    def seconds(bits):
        model = op2.Index(str(tmp_path), {"bits": bits, "more": 0, "common": {i: "m" for i in range(0, 1 << bits, 2)}})
        (tmp_path / "m.hash").write_bytes(np.array([5], np.uint64).tobytes())
        hashes = np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64)
        began = time.time()
        op2.known(model, hashes)
        return time.time() - began

    seconds(8)
    assert seconds(16) < 1.0


def test_lm(spark, table):
    rows = {r["doc_id"]: r for r in got(queries.queries()["op3_lm_score"](spark, SF))}
    count, pair = collections.Counter(), collections.Counter()
    for r in table:
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            w = [*(r["text"] or "").encode().lower().split(), 0]
            count.update(w)
            pair.update(zip([1, *w], w, strict=False))
    n, v = sum(count.values()), len(count)
    context, more = collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
    for (a, b), k in pair.items():
        context[a][0] += k
        context[a][min(k, 3)] += 1
        more[b] += 1
    of = lambda c: [0, *op3.discounts([sum(x == i for x in c.values()) for i in (1, 2, 3, 4)])]
    high, low = of(pair), of(more)
    rest = sum(low[min(x, 3)] for x in more.values())
    for r in table[:60]:
        w, score = [*(r["text"] or "").encode().lower().split(), 0], 0.0
        for a, b in zip([1, *w], w, strict=False):
            q = context.get(a)
            lower = (more[b] - low[min(more[b], 3)] + rest / (v + 1)) / len(pair)
            k = pair.get((a, b), 0)
            score += math.log10((k - high[min(k, 3)]) / q[0] + sum(high[i] * q[i] for i in (1, 2, 3)) / q[0] * lower if q else lower)
        x = rows[r["doc_id"]]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(w), sum(t in count for t in w), n)
        assert x["base_score"] == pytest.approx(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in w)) and x["score"] == pytest.approx(score, rel=1e-5)
    held = [x for x in rows.values() if x["held_out"]]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held)


def test_language(spark):
    df = queries.queries()["op4_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    r = df.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r["right"] > 0.97 and r["low"] >= 0 and r["high"] <= 1


def test_ftrl():
    """One step after the other, coordinate by coordinate."""
    rng = np.random.default_rng(0)
    learner, z, n = op4.Ftrl(2), collections.defaultdict(float), collections.defaultdict(float)

    def weight(i, c):
        x = z[i, c]
        return 0.0 if abs(x) <= op4.L1 else (math.copysign(op4.L1, x) - x) / ((op4.BETA + math.sqrt(n[i, c])) / op4.ALPHA + op4.L2)

    for _ in range(30):
        at, x, y = np.sort(rng.choice(6, 3, replace=False)), rng.normal(0, 1, 3), int(rng.integers(0, 2))
        learner.learn(at, x, y)
        w = {(i, c): weight(i, c) for i in at.tolist() for c in (0, 1)}
        e = [math.exp(sum(w[i, c] * v for i, v in zip(at.tolist(), x.tolist(), strict=True))) for c in (0, 1)]
        for c in (0, 1):
            for i, v in zip(at.tolist(), x.tolist(), strict=True):
                g = (e[c] / sum(e) - (c == y)) * v
                z[i, c] += g - (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / op4.ALPHA * w[i, c]
                n[i, c] += g * g
    assert learner.weights(np.arange(6)) == pytest.approx(np.array([[weight(i, c) for c in (0, 1)] for i in range(6)]))


def test_language_by_hand(spark, docs):
    """IDF, weights and calibrated scores of a small corpus, worked out text by text; ties and repeated rows learn alike."""
    rows = [(i, ("der Hund und die Katze " if i % 2 else "the dog and the cat ") * (1 + i % 3), "de" if i % 2 else "en") for i in range(40)]
    rows += [(None, "das ist gut", "de")] * 3 + [(50, None, "en"), (51, "..", "en"), (52, "the dog", None)]
    out = got(op4.identify(docs(*rows).repartition(3), sample=20))
    again = got(op4.identify(docs(*rows[::-1]).repartition(5), sample=20))
    key = lambda o: sorted((str(x["doc"]["doc_id"]), str(x["doc"]["text"]), x["lang_pred"], round(x["score"], 12)) for x in o)
    assert key(out) == key(again)
    model = op4.train(docs(*rows))
    learned = [(d, t) for d, t, lang in rows if t is not None and lang and zlib.crc32(str("" if d is None else d).encode()) % 4 != 2]
    grams = lambda t: collections.Counter(g for n in (1, 2, 3) for g in (t.lower()[i : i + n] for i in range(len(t) - n + 1)))
    for g in ("h", "de", "dog"):
        at = op4.counts(g)[0]
        place = [i for i in at.tolist() if i not in {j for x in (g[:-1], g[1:]) for j in op4.counts(x)[0].tolist()}] if len(g) > 1 else at.tolist()
        n = sum(g in grams(t) for _, t in learned)
        assert model.idf[place[0]] == pytest.approx(math.log((1 + len(learned)) / (1 + n)) + 1, rel=1e-6)
    for x in out:
        t = x["doc"]["text"]
        assert (x["lang_pred"] == "und") == (not re.search("[a-z]", t or "")) and 0 <= x["score"] <= 1
        if t and "Hund" in t:
            assert x["lang_pred"] == "de"


def test_temperature():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 4000)
    scores = rng.normal(0, 1, (4000, 3)) + 1.2 * np.eye(3)[y]
    assert op4.temperature(scores * 5, y) == pytest.approx(5 * op4.temperature(scores, y), rel=0.05)


def test_personal_data(spark, table):
    pattern = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {"email": lambda x: True, "ip": lambda x: all(int(p) <= 255 for p in x.split(".")), "card": lambda x: 16 <= len(op5.digits_of(x)) <= 19 and op5.luhn(op5.digits_of(x)), "phone": lambda x: 8 <= len(op5.digits_of(x)) <= 15}
    texts = {r["doc_id"]: r["text"] or "" for r in table}
    odd = ["a@b.c_d@e.f g@@h.i", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111-1111 1111 4111111111111112", "+1 (555) 123-4567+44 20 7946 0958", "x@y.z@w.v.", "+1-", "a@b @c.d"]
    for text in [*texts.values(), *odd]:
        assert {k: [m.span() for m in re.finditer(p, text) if ok[k](m.group())] for k, p in pattern.items()} == op5.base_spans(text)
    for r in got(queries.queries()["op5_personal_data"](spark, SF)):
        base = [(k, *x) for k, xs in op5.base_spans(texts[r["doc_id"]]).items() for x in xs]
        assert r["base_sha256"] == hashlib.sha256(op5.joined(base).encode()).hexdigest() and set(op5.joined(base).split(",")) - {""} <= set(r["spans"].split(","))


def test_weak_spans(spark, docs):
    rows = [(i, f"please call phone (716) 555-{1000 + i} now") for i in range(60)] + [(100 + i, f"version 555-123-{4000 + i} of page") for i in range(60)]
    out = {r["doc_id"]: r["spans"] for r in got(op5.find_personal_data(docs(*rows)))}
    assert out[0] == "phone:18:32" and out[100] == ""


@pytest.mark.parametrize("text", ["jane at example (dot) com", "jane at example[dot]com", "jane(at)example dot com"])
def test_written_address(text):
    assert op5.candidates(text) == [("email", 0, len(text))]


@pytest.mark.parametrize(("text", "span"), [("my name is Anja Probst.", (11, 22)), ("ask Robert Mills about it", (4, 16)), ("call Dr Osei now", (8, 12))])
def test_proposed_names(text, span):
    assert ("name", *span) in op5.candidates(text)


def test_em_finds_the_likelihood_maximum():
    """No small move of the labelers' rates makes the counted votes more probable."""
    rng = np.random.default_rng(2)
    rates = np.array([[[0.7, 0.2, 0.1], [0.1, 0.3, 0.6]], [[0.6, 0.3, 0.1], [0.2, 0.2, 0.6]], [[0.5, 0.4, 0.1], [0.1, 0.4, 0.5]]])
    truth = rng.random(4000) < 0.4
    votes = np.stack([[(1, 0, -1)[rng.choice(3, p=r[0 if t else 1])] for t in truth] for r in rates], 1)
    counts = collections.Counter(("phone", tuple(v)) for v in votes.tolist())
    p = op5.reliabilities(counts)
    assert np.mean([(p["phone", tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), truth, strict=True)]) > 0.85

    def objective(share, rate):
        fits = lambda v, t: math.prod(rate[j][t][1 - x] for j, x in enumerate(v))
        likely = sum(n * math.log(share * fits(v, 0) + (1 - share) * fits(v, 1)) for (_, v), n in counts.items())
        return likely + sum(2 * c * math.log(rate[j][t][k]) for j in range(3) for t in (0, 1) for k, c in enumerate([(2.0, 1.0, 0.5), (0.5, 1.0, 2.0)][t]))

    n = sum(counts.values())
    share = sum(k * p[x] for x, k in counts.items()) / n
    rate = []
    for j in range(3):
        sums = [[sum(k * (p[x] if t == 0 else 1 - p[x]) for x, k in counts.items() if x[1][j] == s) + 2 * c for s, c in zip((1, 0, -1), [(2.0, 1.0, 0.5), (0.5, 1.0, 2.0)][t], strict=True)] for t in (0, 1)]
        rate.append([[x / sum(r) for x in r] for r in sums])
    best = objective(share, rate)
    for j in range(3):
        for t in (0, 1):
            for k in range(3):
                for d in (-0.03, 0.03):
                    moved = [[list(r) for r in x] for x in rate]
                    moved[j][t][k] += d
                    moved[j][t] = [x / sum(moved[j][t]) for x in moved[j][t]]
                    assert objective(share, moved) < best + 0.05


def test_many_spans_take_linear_time():
    import time

    def seconds(n):
        text = "a@b.co (716) 555-1234 , " * n
        began = time.time()
        starts, ends = op5.united([x for xs in op5.base_spans(text).values() for x in xs])
        assert len(starts) == n and len(op5.candidates(text)) == n
        return time.time() - began

    seconds(100)
    assert seconds(16_000) < 12 * max(seconds(4000), 0.02)


def test_many_zeros():
    text = f"1.2.3.{'0' * 5000}4"
    assert op5.base_spans(text)["ip"] == [(0, len(text))]


def test_reliabilities():
    p = op5.reliabilities({("phone", (1, 0, 1, 0, 0)): 50, ("phone", (-1, 0, 0, -1, 0)): 80, ("phone", (1, 0, 0, 0, 0)): 20})
    assert p["phone", (1, 0, 1, 0, 0)] > 0.9 and p["phone", (-1, 0, 0, -1, 0)] < 0.1


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(spark, docs, odd, bits):
    rows = [*odd, (20, "x y"), (21, "xy "), (22, " x\ty\n\n"), (23, "x\xa0y"), *((30 + i, f"t{i % 9}") for i in range(40))]
    out = got(op6.exact_dedup(docs(*rows).repartition(4), bits=bits, capacity=4, chunk_bytes=200))
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0))
    assert len(out) == len(rows) and sum(r["kept"] for r in out) == len(groups)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in out:
        best = min(by_sha[r["text_sha256"]])
        assert r["group_size"] == len(by_sha[r["text_sha256"]]) and r["keep_id"] == (None if best[1] else best[2])


def test_extendible_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64) << np.uint64(1))
    buckets = op6.split_buckets(keys, 64)
    assert sorted(np.concatenate([b[2] for b in buckets]).tolist()) == list(range(len(keys)))
    for prefix, depth, at in buckets:
        assert len(at) <= 64 and (not depth or (keys[at] >> np.uint64(64 - depth) == np.uint64(prefix >> (64 - depth))).all())
    assert len(op6.split_buckets(np.full(100, 7, np.uint64), 8)) == 1


def test_index_is_probed(spark, docs):
    """Keys are found through the directory: with a wrong one they aren't."""
    from tripstrata.llm.common import Scratch

    texts = [f"text {i % 700}" for i in range(1000)]
    with Scratch(spark) as s:
        index = op6.build_index(docs(*enumerate(texts)).select("text").repartition(3), s, 64, 16)
        keys = np.array([op6.hash_key(x.encode().translate(None, op6.SPACE)) for x in texts], np.uint64)
        assert index.has_company(keys).tolist() == [i % 700 < 300 for i in range(1000)]
        name = index.about["tables"][0][0]
        index.maps[f"{name}.directory"] = np.roll(index.array(f"{name}.directory", "<i8"), 8)
        with pytest.raises(LookupError):
            index.has_company(keys)


def test_toxicity(spark):
    d = "/root/testdata/sf0.01"
    labels = {x["doc_id"]: x["toxic"] for x in pq.read_table(f"{d}/labels.parquet").to_pylist()}
    got_ = {x["doc_id"]: x for x in got(queries.queries()["op7_toxicity"](spark, d))}
    bad = [got_[k]["severity"] for k, v in labels.items() if v == 1]
    good = [got_[k]["severity"] for k, v in labels.items() if v == 0]
    assert np.mean(bad) > 5 * np.mean(good) and np.mean([s > 0.5 for s in good]) < 0.02


def test_toxicity_held_out(spark):
    """Labels that the model has not seen, and grades from other folds."""
    d = "/root/testdata/sf0.1"
    rows = pq.read_table(f"{d}/labels.parquet").to_pylist()
    seen = [(x["doc_id"], x["toxic"]) for x in rows if x["doc_id"] % 2]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    held = spark.createDataFrame([(x["doc_id"], x["toxic"]) for x in rows if x["doc_id"] % 2 == 0], "doc_id long, label int")
    out = op7.severity(docs, spark.createDataFrame(seen, "doc_id long, grade int")).join(held, "doc_id").groupBy("label").agg(F.avg(F.col("toxic").cast("int")).alias("toxic"), F.avg("severity").alias("severity"))
    by = {r["label"]: r for r in out.collect()}
    assert by[1]["toxic"] > 0.8 and by[0]["toxic"] < 0.05 and by[1]["severity"] > 5 * by[0]["severity"]


def test_cross_grades():
    """A row's own label doesn't grade it: a feature that only one toxic row has gives it the least grade."""
    rng = np.random.default_rng(1)
    toxic = (np.arange(400) % 4 == 0).astype(int)
    data = [([0], [float(x)]) for x in np.where(toxic, rng.uniform(1, 4, 400), rng.uniform(0, 1, 400))]
    data[8] = ([1], [5.0])
    grade = op7.cross_graded(data, toxic, 2)
    assert (grade[toxic == 0] == 0).all() and grade[8] == 1 and set(grade[toxic == 1]) == {1, 2, 3}
    scores = np.array([x[1][0] for x in data])
    assert scores[grade == 3].min() > scores[(grade == 1) & (np.arange(400) != 8)].max()


def test_cumulative_link():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 4, 600)
    w, bounds = op7.fit([([0, 1], [float(g + rng.normal(0, 0.4)), 1.0]) for g in grade], grade, 2, 4)
    assert (np.diff(bounds) > 0).all() and w[0] > 1


@pytest.mark.parametrize("slice_bytes", [1 << 30, 800])
def test_shards(spark, docs, odd, slice_bytes):
    rows = [*odd, *((100 + i, "same text") for i in range(300)), *((500 + i, "z" * (i % 97)) for i in range(300))]
    out = got(op8.histogram_shards(docs(*rows).repartition(5), 6, slice_bytes=slice_bytes))
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows)
    texts = collections.Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == texts
    total, most = sum(r["size"] for r in out), max(r["size"] for r in out)
    for k in range(6):
        mine = [r for r in out if r["shard"] == k]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 6) <= most + total * 0.001


def test_packing(spark, docs, odd):
    file = op9.tokenizer_file()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    rnd = random.Random(5)
    rows = [*odd, *((100 + i, "".join(rnd.choice("abcXYZ's 'Re \t.,!|²ºßİɏÉ9<|>\xa0\x85αΣ中") for _ in range(rnd.randint(0, 300)))) for i in range(60)), (300, "<|endoftext|> x")]
    out = got(op9.pack(docs(*rows).repartition(3)))
    want = {}
    for d, x in rows:
        want.setdefault(d, []).append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4"))
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        pieces[r["row"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert len(pieces) == len(rows)
    for ps in pieces.values():
        ps.sort(key=lambda r: r["start"])
        assert any(ps[0]["doc_tokens"] == len(ids) and [(p["start"], p["length"], p["ids_crc32"]) for p in ps] == [(i, min(2048, len(ids) - i), zlib.crc32(ids[i : i + 2048].tobytes())) for i in range(0, len(ids), 2048)] for ids in want[ps[0]["doc_id"]])
    for ps in seqs.values():
        ps.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in ps] == np.cumsum([0, *(p["length"] for p in ps)])[:-1].tolist() and sum(p["length"] for p in ps) <= 2048
    assert sorted(seqs) == list(range(len(seqs)))


def test_shortest_pack_first():
    rnd = random.Random(2)
    histogram = {n: rnd.randint(1, 60) for n in range(1, 2049, 3)}
    patterns = op9.shortest_pack_first(histogram)
    used = collections.Counter()
    for n, lengths in patterns:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += n
    assert used == histogram and sum(n for n, _ in patterns) < 1.03 * sum(k * v for k, v in histogram.items()) / 2048 + 1


@pytest.mark.parametrize("hot", [150, 600, 40])
def test_hot_length(hot):
    """Pieces of one length share packs."""
    lengths = np.clip(np.random.default_rng(4).lognormal(5, 1, 30_000).astype(int), 1, 2048)
    lengths[:10_000] = hot
    histogram = collections.Counter(lengths.tolist())
    patterns = op9.shortest_pack_first(histogram)
    used = collections.Counter()
    for n, ks in patterns:
        assert sum(ks) <= 2048
        for x in ks:
            used[x] += n
    assert used == histogram and sum(n for n, _ in patterns) < 1.02 * lengths.sum() / 2048 + 1
    assert sum(n for n, _ in op9.shortest_pack_first({300: 20})) == 4


def windows(words):
    n = min(len(words), 13)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def test_decontamination(spark, docs):
    rnd = random.Random(9)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    vocabulary = "alpha Beta gamma élan ΑΣ ÉTÉ x1".split()
    some = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(1, some(30)), (2, some(5)), (3, "beta"), (10, some(13)), (11, None), (12, "..."), (None, some(14)), (2, "unique words here twice"), (13, items_text := some(20))]
    rows = [(i, some(rnd.randint(0, 60)) + ", " + (rnd.choice(items)[1] or "") + ". " + some(rnd.randint(0, 10))) for i in range(40)] + [(50, None), (51, ""), (52, items_text), (52, items_text), (None, items_text.upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got(op10.decontaminate(docs(*rows), bench)))
    want = collections.Counter()
    for d, t in rows:
        w, hit, ids = words(t), set(), set()
        for item, x in items:
            for win in windows(words(x)):
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit |= set(range(i, i + len(win)))
                        ids |= {str(item)} - {"None"}
        want[d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    assert out == want


OPERATORS = {
    "simhash": op1.simhash_components, "suffix": op2.dedup_spans, "lm": op3.score_texts, "language": op4.identify, "pii": op5.find_personal_data, "exact": op6.exact_dedup,
    "toxicity": lambda d: op7.severity(d, d.sparkSession.createDataFrame([], "doc_id long, grade int")), "shards": op8.histogram_shards, "pack": op9.pack,
    "decontaminate": lambda d: op10.decontaminate(d, d.sparkSession.createDataFrame([], "item_id long, text string")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_and_odd(docs, odd, name):
    assert OPERATORS[name](docs()).collect() == []
    out = [r.asDict(recursive=True) for r in OPERATORS[name](docs(*odd)).collect()]
    assert len(out) >= len(odd) if name == "pack" else len(out) == len(odd)
    ids = [(r["doc"] if name == "language" else r)["doc_id"] for r in out]
    if name != "pack":
        assert collections.Counter(ids) == collections.Counter(d for d, _ in odd)
    by = collections.defaultdict(list)
    for d, r in zip(ids, out, strict=True):
        by[d].append({k: v for k, v in r.items() if k not in ("row", "doc")})
    # repeated rows get equal results, null and empty texts too
    if name in ("suffix", "lm", "language", "pii", "toxicity"):
        alike = lambda r: {k: v for k, v in r.items() if k not in ("doc_id", "held_out")}
        assert by[4][0] == by[4][1] and alike(by[1][0]) == alike(by[2][0])
    sizes = {d: len(t.encode()) for d, t in odd if t is not None}
    if name == "suffix":
        want = removed([(i, t.encode()) for i, t in sizes_of(odd)])
        assert all((r["n_bytes"], r["n_removed"]) == (sizes.get(d, 0), want[d][0]) for d in (1, 2, 3, 7, 8, 9, 10) for r in by[d])
    if name == "lm":
        assert by[1][0]["n_tokens"] == by[2][0]["n_tokens"] == by[3][0]["n_tokens"] == 1 and by[7][0]["n_tokens"] == 40_001
    if name == "language":
        assert [by[d][0]["lang_pred"] for d in (1, 2, 3, 9)] == ["und"] * 4
    if name == "pii":
        assert by[10][0]["spans"] == "email:0:5,phone:6:23" and by[1][0]["spans"] == by[2][0]["spans"] == "" and by[9][0]["n_card"] == 0


def sizes_of(odd):
    return [(d, t or "") for d, t in odd if d is not None and d != 4]
