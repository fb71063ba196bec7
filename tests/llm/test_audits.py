"""The filter audit, subword toxicity and periodic runs."""

import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pytest

from bandsift.llm import audit, runs, toxicity
from bandsift.llm.common import ready

MORE = "n_words int, held_out string, mask int, part string"


def frame(spark, rows, more=MORE):
    """rows: (doc_id, text, source); other columns have names that the operators use."""
    return ready(spark).createDataFrame([(i, t, s, 5, "x", 6, "p") for i, t, s in rows], f"doc_id long, text string, source string, {more}")


def marks(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, n string")


# Filter audit


def test_intervals_cover_the_orders_of_each_removal():
    orders = ["".join(p) for p in permutations("ABCDE")]
    assert orders == sorted(orders) == audit.ORDERS
    for mask in range(32):
        want = set()
        for rank, order in enumerate(orders):
            hit = [s for s, x in enumerate(order, 1) if mask >> "ABCDE".index(x) & 1]
            if hit:
                want.add((hit[0], rank))
        got = [(s, r) for s, low, high in audit.intervals(mask) for r in range(low, high)]
        assert len(got) == len(set(got)) and set(got) == want


def replayed(rows, labels):
    """Each order over each document, one by one."""
    out = {}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    failing = []
    for i, t, s in rows:
        t = t or ""
        words = [w for w in t.encode().split()]
        bad = set()
        bad |= {"A"} if len(words) < 200 else set()
        bad |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        bad |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        bad |= {"D"} if set(t) & set("#$%&*|") else set()
        bad |= {"E"} if i is not None and i > first[t] else set()
        own = [x for x in labels if x[0] == i and i is not None]
        failing.append((s or "", bad, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    for part in {f[0] for f in failing}:
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [f for f in failing if f[0] == part]
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                fails = [f for f in failing if f[0] == part and x in f[1]]
                total[x] += len(gone)
                alone = sum(f[1] == {x} for f in fails)
                out[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), alone, sum(f[2] for f in gone), sum(f[3] for f in gone), x]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = total[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_replays_every_order(spark):
    pick = random.Random(3)
    long = " ".join(f"w{i}" for i in range(220))
    texts = [None, "", "short", "SHORT AND LOUD", "a b #", long, long + " |", long.upper(), "same " * 300, "same " * 300 + "$", "é" * 50 + "AB", "x\x00y\x1fz"]
    rows = [(pick.randrange(25), pick.choice(texts), pick.choice(["s", "t", None, ""])) for _ in range(120)]
    rows += [(None, "short", "s"), (None, long, "u"), *[(7, "short", "t")] * 9]
    labels = [(i, pick.choice([0, 1, None]), pick.choice([0, 1, None])) for i in range(20)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    got = audit.audit(frame(spark, rows), marks(spark, labels))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == replayed(rows, labels)
    assert got.count() == 4 * 600
    assert audit.audit(frame(spark, []), marks(spark, labels)).collect() == []
    assert audit.audit(frame(spark, rows[:5]), marks(spark, [])).agg({"good_lost": "sum"}).first()[0] == 0


# Toxicity

INSULTS = ["grunzwolf", "schlumpert", "knatterbock", "blubberhans"]


def invented(pick, n, toxic):
    words = ["".join(pick.choice("aeioulnrst") for _ in range(pick.randrange(2, 8))) for _ in range(n)]
    for _ in range(3 if toxic else 0):
        words.insert(pick.randrange(len(words) + 1), pick.choice(INSULTS))
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    pick = random.Random(8)
    return toxicity.fit([(i % 3 == 0, invented(pick, pick.randrange(5, 200), i % 3 == 0)) for i in range(900)])


def test_toxicity_holds_on_new_texts_and_misspellings(model):
    weight, bias = model
    own, pick = toxicity.Weights(weight), random.Random(9)
    of = lambda t: toxicity.score(t, own, bias) >= 0.3
    assert np.mean([of(invented(pick, 150, True)) for _ in range(100)]) > 0.95
    assert np.mean([of(invented(pick, 150, False)) for _ in range(100)]) < 0.05
    long = invented(pick, 20_000, False)
    assert of(long[:70_000] + " grunzwolf schlumpert " + long[70_000:])
    misspelt = ["grunzwollf", "schlummpert", "knaterbock", "blubberhanns"]
    clean = [own[w] for w in toxicity.words_of(invented(pick, 2000, False))]
    assert all(own[w] > np.quantile(clean, 0.99) for w in misspelt)


def test_windows_and_means_by_brute_force():
    for n in (0, 1, 11, 12, 13, 24, 25):
        at = toxicity.windows(n)
        covered = {i for a in at for i in range(a, min(a + toxicity.WINDOW, n))}
        assert covered == set(range(n)) and (n == 0) == (len(at) == 0)
    pick = np.random.default_rng(1)
    index, sizes = pick.integers(0, 7, 20), np.array([5, 1, 14])
    own, values = toxicity.Ragged(index, sizes, 8), pick.standard_normal((8, 3)).astype(np.float32)
    parts = np.split(index, np.cumsum(sizes)[:-1])
    assert np.allclose(own.mean(values), [values[p].mean(axis=0) for p in parts], atol=1e-5)
    grad, want = pick.standard_normal((3, 3)).astype(np.float32), np.zeros((8, 3))
    for g, p in zip(grad, parts, strict=True):
        for i in p:
            want[i] += g / len(p)
    assert np.allclose(own.back(grad), want, atol=1e-5)
    held = [np.array([0, 2]), np.array([1]), np.array([2])]
    flat, of_word = np.array([1, 2, 1, 3, 3, 9]), np.array([2, 1, 3])
    counts = toxicity.document_counts(held, flat, of_word)
    assert counts[[1, 2, 3, 9]].tolist() == [2, 1, 2, 2] and counts.sum() == 7


def test_toxicity_rows_and_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 30)
    pick = random.Random(5)
    rows = [(i, invented(pick, 30, i % 2 == 0), "s") for i in range(80)]
    rows += [(80, None, None), (80, "", "s"), (81, "...", "s"), (None, INSULTS[0], "s"), (4, rows[4][1], "s"), (82, "x" * 100_000, "s"), (83, "y " * 60_000 + INSULTS[1], "s")]
    labels = [(i, 1, int(i % 2 == 0)) for i in range(70)] + [(2, None, None), (None, 1, 1), (200, 1, 1)]
    got = toxicity.toxicity(frame(spark, rows), marks(spark, labels), 4, 2)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert sorted((r[0] is None, r[0] or 0) for r in found) == sorted((i is None, i or 0) for i, *_ in rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    by = {r.doc_id: r.predicted for r in found}
    assert np.mean([by[i] == (i % 2 == 0) for i in range(80)]) > 0.9 and by[83] == 1 and by[80] == 0
    chosen = toxicity.sample(frame(spark, rows), marks(spark, labels), 4, 2)
    assert sorted(t for _, t in chosen) == sorted(t for i, t, _ in rows[:70] if zlib.crc32(str(i).encode()) % 4 != 2)
    assert toxicity.toxicity(frame(spark, rows[:9]), marks(spark, []), 4, 2).filter("predicted = 1").count() == 0
    assert toxicity.toxicity(frame(spark, []), marks(spark, labels), 4, 2).collect() == []


def test_labels_of_left_out_rows_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 5)
    pick = random.Random(6)
    df = frame(spark, [(i, invented(pick, 20, i % 2 == 0), "s") for i in range(60)])
    labels = [(i, 1, int(i % 2 == 0)) for i in range(60)]
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    one, two = (toxicity.toxicity(df, marks(spark, x), 4, 2).orderBy("doc_id").collect() for x in (labels, turned))
    assert one == two


# Periodic runs


def brute(x):
    """Every lag, every stretch of matches, every smaller period."""
    out = set()
    for q in range(1, len(x) // 2 + 1):
        i = q
        while i < len(x):
            a = i
            while i < len(x) and x[i] == x[i - q]:
                i += 1
            own = x[a - q : i]
            if i - a + q >= max(12, 2 * q) and not any(own[d:] == own[:-d] for d in range(1, q)):
                out.add((a - q, i - a + q, q))
            i += 1
    return out


def sequences(pick):
    for _ in range(400):
        letters, n = pick.choice([1, 2, 3, 6]), pick.choice([11, 12, 13, 40, 120, 260])
        kind = pick.randrange(4)
        if kind == 0:
            x = [pick.randrange(letters) for _ in range(n)]
        elif kind == 1:
            x = []
            while len(x) < n:
                x += [pick.randrange(letters) for _ in range(pick.randrange(1, 30))] * pick.randrange(1, 5)
                if pick.random() < 0.3:
                    x += x[-pick.randrange(1, len(x) + 1) :]
        elif kind == 2:
            a, b = [0], [0, 1]
            while len(b) < n:
                a, b = b, b + a
            x = b[:n]
        else:
            x = ([0] * pick.randrange(1, 40) + [1] * pick.randrange(1, 4)) * 8
        for _ in range(pick.choice([0, 0, 1, 3])):
            x[pick.randrange(len(x))] = pick.randrange(3)
        yield x[:400]


def test_runs_by_brute_force():
    for x in sequences(random.Random(11)):
        got = runs.runs(np.array(x, np.int32))
        assert len(got) == len(set(got)) and set(got) == brute(x), x


def test_runs_of_long_texts_take_linear_time():
    assert runs.runs(np.zeros(200_000, np.int32)) == [(0, 200_000, 1)]
    blocks = runs.runs(np.array(([0] * 500 + [1]) * 60, np.int32))
    assert len(blocks) == 61 and (0, 501 * 60, 501) in blocks


def expected(doc_id, text):
    words = (text or "").split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = sorted(brute(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(kept))


def test_runs_of_documents(spark):
    pick = random.Random(2)
    rows = [(i, " ".join(pick.choice("abc") for _ in range(pick.randrange(0, 120))), "s") for i in range(150)]
    rows += [(None, "a b " * 20, None), (5, None, "s"), (6, "", "s"), (7, " \n\t ", "s"), (8, "x " * 300, "s"), (8, "x " * 300, "s"), (9, "é è é è " * 9, "s")]
    got = [tuple(r) for r in query(runs.periodic_runs(frame(spark, rows), altered=True)).collect()]
    want = [expected(i, t.replace(" ", "_") if t else t) for i, t, _ in rows]
    order = lambda r: repr(r)
    got = [r if r[0] != 9 else r[:-1] for r in got]
    want = [r if r[0] != 9 else r[:-1] for r in want]
    assert sorted(got, key=order) == sorted(want, key=order)
    assert query(runs.periodic_runs(frame(spark, []))).collect() == []
    plain = {r.doc_id: r.n_runs for r in runs.periodic_runs(frame(spark, rows[-3:])).collect()}
    assert plain == {8: 1, 9: 1}


def query(found):
    from pyspark.sql import functions as F

    return found.select(*(c for c in found.columns if c != "collapsed"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
