"""Dedup operators against brute force on small tables."""

import random

import numpy as np
import pytest
import zstandard

from bandsift.llm import bloom, lines, nearcopies, sais, simhash, suffix
from bandsift.llm.common import ready
from bandsift.llm.components import components, forest


def frame(spark, rows):
    return ready(spark).createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_lines int, _doc string")


def test_suffix_arrays(monkeypatch):
    rnd = np.random.default_rng(1)
    for trial in range(300):
        letters = int(rnd.integers(1, 6))
        t = np.concatenate([rnd.integers(1, letters + 1, int(rnd.integers(0, 70))), [0]])
        if trial % 4 == 0:
            t[: len(t) // 2] = np.minimum(t[: len(t) // 2], 1)
            t[-1] = 0
            t[:-1] = np.maximum(t[:-1], 1)
        monkeypatch.setattr(sais, "LETTERS", int(rnd.choice([2, 8, 1024])))
        assert sais.suffix_array(t, int(t.max()) + 1).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_common_prefixes():
    data = np.frombuffer(b"banana bandana banana", np.uint8)
    sa = sais.suffix_array(np.concatenate([data.astype(np.int64) + 1, [0]]), 257)[1:]
    got = sais.permuted_common_prefixes(data, sa, 5)
    raw = data.tobytes()
    for a, b in zip(sa[:-1], sa[1:], strict=True):
        n = 0
        while n < 5 and raw[a + n : a + n + 1] == raw[b + n : b + n + 1] != b"":
            n += 1
        assert got[b] == n


def removed(rows, length):
    out = []
    data = [(i, (t or "").encode()) for i, t in rows]
    last = float("inf")
    starts = {}
    for i, b in data:
        for k in range(len(b) - length + 1):
            own = b[k : k + length]
            starts[own] = min(starts.get(own, last), last if i is None else i)
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if starts[b[k : k + length]] < (last if i is None else i):
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def test_suffix_dedup(spark):
    rnd = random.Random(2)
    passage = [" ".join(rnd.choice(["alpha", "bé", "gamma", "dd"]) for _ in range(20)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "short"), (None, passage[0]), (None, passage[0]), (9, passage[0]), (9, passage[0]), (4, "a" * 200), (5, "a" * 170)]
    for i in range(10, 70):
        rows.append((i, "".join(rnd.choice(passage)[rnd.randint(0, 40) :] if rnd.random() < 0.5 else str(rnd.random()) for _ in range(rnd.randint(0, 7)))))
    df = frame(spark, rows).repartition(4)
    for block, array in ((1 << 20, 1 << 20), (500, 300)):
        got = suffix.remove_repeats(df, 50, block=block, array=array).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=repr) == removed(rows, 50)
    assert suffix.remove_repeats(frame(spark, []), 50).collect() == []


@pytest.mark.parametrize("between", ["\0", "\x01", "\0\0\0", "é\0"])
def test_characters_that_might_be_taken_for_borders(spark, between):
    rows = [(6, "a" * 60 + between + "b" * 60), (7, "a" * 55), (8, "a" * 55 + between + "\0\0" + "b" * 55), (9, "a" * 48 + between), (10, between * 70), (11, between * 60)]
    got = suffix.remove_repeats(frame(spark, rows), 50).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=repr) == removed(rows, 50)


def test_segments_longer_than_an_array(spark):
    long = "".join(random.Random(9).choice("abcdef") for _ in range(90))
    rows = [(i, f"{long[i:]}{c * 900}{i}") for i, c in enumerate("-- -=-=ab")]
    sent = [bytes([65 + i]) * 400 for i in range(3)]
    head = [np.array([3], "<i8").tobytes(), np.arange(3, dtype="<u4").tobytes(), np.arange(3, dtype="<i8").tobytes(), np.full(3, 400, "<u4").tobytes()]
    data = head[0] + zstandard.compress(b"".join(head[1:] + sent), 1)
    segments = ready(spark).createDataFrame([("p", 0, 1, 0, data)], "path string, at long, size long, shard int, data binary")
    assert len(suffix.owners_found(segments, 1, 50, 100).collect()) == 1
    got = suffix.remove_repeats(frame(spark, rows), 50, array=300).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=repr) == removed(rows, 50)


def test_hot_anchors_are_split(spark, monkeypatch):
    rnd = random.Random(5)
    phrase, ends = "one phrase in every document", ["".join(rnd.choice("abcd") for _ in range(30)) for _ in range(12)]
    rows = [(i, " ".join(f"{rnd.choice(ends)} {phrase} {rnd.choice(ends)}" for _ in range(3))) for i in range(60)]
    sizes, was = [], suffix.owners_found

    def seen(segments, *args):
        for r in segments.filter("shard is not null").collect():
            n = int(np.frombuffer(r["data"], "<i8", 1)[0])
            raw = zstandard.decompress(r["data"][8:])
            at = np.frombuffer(raw, "<u4", n)
            for a in np.unique(at):
                sizes.append(int(np.frombuffer(raw, "<u4", n, 12 * n)[at == a].sum()))
        return was(segments, *args)

    monkeypatch.setattr(suffix, "owners_found", seen)
    got = suffix.remove_repeats(frame(spark, rows), 50, array=2000).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=repr) == removed(rows, 50)
    assert max(sizes) <= 2000


def test_line_dedup(spark):
    long = "A line that is certainly long enough to count at all"
    rows = [(i, f"x{i}\n  {long.upper() if i % 2 else long}\t\nend") for i in range(6)]
    rows += [(None, long), (7, None), (8, ""), (9, f"{long}\n{long}"), (9, long), (10, "short\nshort")]
    got = lines.without_repeated_lines(frame(spark, rows), bits=1 << 12)
    assert got.columns == ["doc_id", "text", "n_lines", "_doc", "n_lines_", "n_dropped"]
    by = sorted(((r["doc_id"], r["text"], r["n_lines_"], r["n_dropped"]) for r in got.collect()), key=repr)
    want = [(i, f"x{i}\nend", 3, 1) for i in range(6)]
    want += [(None, "", 1, 1), (7, None, 1, 0), (8, "", 1, 0), (9, f"{long}\n{long}", 2, 0), (9, long, 1, 0), (10, "short\nshort", 2, 0)]
    assert by == sorted(want, key=repr)
    assert lines.without_repeated_lines(frame(spark, []), bits=1 << 12).collect() == []


def test_a_document_counts_once_however_many_rows_it_has(spark):
    line = "a line that is long enough to be counted at all"
    rows = [(1, line)] * 5 + [(2, line)] + [(None, line)] * 3
    got = lines.without_repeated_lines(frame(spark, rows), bits=1 << 12)
    assert got.agg({"n_dropped": "sum"}).first()[0] == 0
    got = lines.without_repeated_lines(frame(spark, [*rows, (3, line), (4, line)]), bits=1 << 12).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in got) == [(0, 1)] * 3 + [(1, 1)] * 5 + [(2, 1), (3, 1), (4, 0)]


def test_filter_pairs_merge():
    rnd = np.random.default_rng(3)
    low = rnd.integers(-(2**62), 2**62, 400)
    one, two = lines.Pair(1 << 12), lines.Pair(1 << 12)
    one.add(low[:300])
    two.add(low[250:])
    merged = (one.once & two.once) | one.twice | two.twice
    assert bloom.holds(merged, low[250:300]).all() and not bloom.holds(one.twice, low[:250]).all()
    parts = {(i, twice): lines._unpacked(data, few, 1 << 10) for i, twice, few, data in two.slices(1 << 10)}
    assert (np.packbits(np.concatenate([parts[i, False] for i in range(4)])) == two.once).all()


def test_golay_keys_miss_nothing():
    rnd = np.random.default_rng(4)
    a = rnd.integers(0, 2**64, 800, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for bit in rnd.choice(64, int(rnd.integers(0, 5)), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    found = []
    for own in (a, b):
        by = [set() for _ in own]
        for key, at in zip(*(x.tolist() for x in simhash.keys(own)), strict=True):
            by[at].add(key)
        found.append(by)
    assert len(np.unique(simhash.decoder())) == 4096
    assert all(x & y for x, y in zip(*found, strict=True))


def test_simhash_groups(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [rnd.choice(words) for _ in range(400)]
    rows = [(1, None), (2, ""), (3, "One two"), (4, "one  TWO"), (None, "one two"), (50, " ".join(base)), (50, " ".join(base))]
    for i in range(5, 40):
        own = list(base)
        for _ in range(rnd.randint(0, 6)):
            own[rnd.randrange(400)] = rnd.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(rnd.choice(words) for _ in range(30))) for i in range(60, 90)]
    fp = [simhash.fingerprint(t or "", 4) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    want = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if root[k] == root[i] and d is not None]
        want.append((doc_id, min(ids) if ids else None))
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_groups(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.near_groups(frame(spark, [])).collect() == []


def test_long_runs_connect():
    rnd = np.random.default_rng(6)
    f = np.unique(np.uint64(5) ^ (rnd.integers(0, 2**12, 600, dtype=np.uint64) << np.uint64(20)))
    a, b = simhash.links(np.zeros(len(f), np.uint64), f, 4)
    assert (np.bitwise_count(a ^ b) <= 4).all()
    assert len(forest(a.view(np.int64), b.view(np.int64))) == len(f) - 1


def test_components(spark):
    links = [(1, 2), (2, 3), (7, 3), (10, 11), (12, 11), (5, 5), (20, 1)] + [(i, i + 1) for i in range(100, 130)]
    got = {r["node"]: r["component"] for r in components(ready(spark).createDataFrame(links, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 7: 1, 20: 1, 10: 10, 11: 10, 12: 10, **{i: 100 for i in range(100, 131)}}
    assert got == want


@pytest.mark.parametrize("changed,same", [(3, True), (120, False)])
def test_near_copies(spark, changed, same):
    rnd = random.Random(changed)
    words = [f"w{i}" for i in range(900)]
    base = [rnd.choice(words) for _ in range(300)]
    own = list(base)
    for k in rnd.sample(range(300), changed):
        own[k] = "new"
    rows = [(4, " ".join(base)), (2, " ".join(own)), (9, " ".join(base)), (4, " ".join(base)), (11, None), (12, ""), (None, "without id")]
    rows += [(i, " ".join(rnd.choice(words) for _ in range(80))) for i in range(20, 30)]
    got = nearcopies.one_of_each(frame(spark, rows))
    ids = sorted((r["doc_id"] for r in got.collect()), key=repr)
    assert ids == sorted([2, *([] if same else [4]), 11, None, *range(20, 30)], key=repr)
    assert got.columns == ["doc_id", "text", "n_lines", "_doc"]


def test_near_copies_on_both_sides_of_the_threshold(spark):
    rnd = random.Random(8)
    rows, want = [], {}
    for k in range(120):
        # The second text goes on where the first ends: 4/5 of all shingles are shared, or one less.
        n, near = 9 * rnd.randint(5, 60), k % 2 == 0
        extra = 2 * n // 9
        words = [f"k{k}w{i}" for i in range(n + extra)]
        first, second = words[:n], words[extra // 2 :][: n + (0 if near else 1)]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (first, second))
        rows += [(2 * k, " ".join(first)), (2 * k + 1, " ".join(second))]
        alike = len(a & b) / len(a | b) >= 0.8
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k + (not alike)}
    # Shared runs of exactly 0.8 and just below.
    for k, parts in ((1000, 44), (1002, 43)):
        words = [f"e{k}w{i}" for i in range(60)]
        rows += [(k, " ".join(words[:49])), (k + 1, " ".join(words[49 - parts : 49] + words[49 : 49 + (49 - parts)]))]
        want |= {k: k, k + 1: k + (parts - 4 < 0.8 * (90 - parts + 4))}
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(frame(spark, rows)).collect()}
    assert got == want and want[1001] == 1000 and want[1003] == 1003
    assert nearcopies.near_copies(frame(spark, [])).collect() == []


def test_filter_loses_nothing(spark):
    rnd = np.random.default_rng(5)
    inside, outside = (rnd.integers(-(1 << 63), 1 << 63, 5000) for _ in range(2))
    df = ready(spark).createDataFrame([(int(x),) for x in inside] + [(None,)], "number long")
    for bits in (bloom.bits_for(5000), bloom.LEAST_BITS, 1 << 23):
        held = bloom.held_filter(df, bits)
        assert len(held) * 8 == bits and bloom.holds(held, inside).all()
        assert bits == bloom.LEAST_BITS or bloom.holds(held, outside).mean() < 0.01
    assert not bloom.holds(bloom.held_filter(df.limit(0), 1 << 16), inside).any()
    rows = spark.createDataFrame([(int(x), int(y)) for x, y in zip(inside, outside, strict=True)], "_number long, b long")
    maybe, no = bloom.split_by(rows, [rows["_number"], rows["b"]], held)
    assert maybe.count() == 5000 and no.count() == 0 and maybe.columns == ["_number", "b"]
    maybe, no = bloom.split_by(rows, [rows["b"]], held)
    assert maybe.count() + no.count() == 5000 and maybe.count() < 50


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_by_brute_force(rows):
    """Components of documents at 0.8 or more, by all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                root[max(top(i), top(j))] = min(top(i), top(j))
    ids = {}
    for i, (d, _) in enumerate(rows):
        own = ids.setdefault(top(i), [])
        if d is not None:
            own.append(d)
    return sorted(((d, min(ids[top(i)], default=None)) for i, (d, _) in enumerate(rows)), key=repr)


def test_near_copies_by_brute_force(spark):
    """Chains of copies, a large group, templates that are loosely alike, repeated ids, clashing columns."""
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        own = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        for _ in range(rnd.randint(1, 25)):
            rows.append((rnd.randrange(1000), " ".join(own)))
            for _ in range(rnd.randint(0, 2)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
    template = [rnd.choice(words) for _ in range(60)]
    for _ in range(40):
        rows.append((rnd.randrange(1000), " ".join([*template, *(rnd.choice(words) for _ in range(rnd.randint(5, 40)))])))
    rows += [(None, rows[0][1]), (None, rows[5][1]), (None, None), (None, ""), (5000, "  "), (5001, "lone text"), (rows[3][0], rows[3][1])]
    df = ready(spark).createDataFrame([(i, t, 1, 2, "x", "y") for i, t in rows], "doc_id long, text string, _own int, _number long, hash string, vertex string")
    got = nearcopies.near_copies(df).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr) == near_by_brute_force(rows)
    stay = nearcopies.one_of_each(df)
    assert stay.columns == df.columns
    named = {c for _, c in near_by_brute_force(rows) if c is not None}
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(named)


def test_golay_keys_link_near_copies(spark, monkeypatch):
    """No key of prints is there: what is found comes from the Golay keys of fingerprints, checked exactly."""
    monkeypatch.setattr(nearcopies, "keys", lambda own, n: np.zeros(0, np.uint64))
    rnd = random.Random(21)
    rows, want = [], {}
    for k in range(0, 60, 3):
        own = [f"w{rnd.randrange(5000)}" for _ in range(400)]
        # One shingle differs; the third is far from both.
        rows += [(k, " ".join(own)), (k + 1, " ".join([*own[:-1], "other"])), (k + 2, " ".join(own[::-1]))]
        near = (simhash.majority(nearcopies.shingles(rows[-3][1], 5)) ^ simhash.majority(nearcopies.shingles(rows[-2][1], 5))).bit_count() <= 4
        want |= {k: k, k + 1: k + (not near), k + 2: k + 2}
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(frame(spark, rows)).collect()}
    assert sum(want[k + 1] == k for k in range(0, 60, 3)) >= 18
    assert got == want


def test_one_fingerprint_of_many_sets(spark):
    own = ready(spark).createDataFrame([(5, 3, 9), (2, 4, 9), (7, 1, 8), (7, 1, 8), (1, 0, 0), (40, 9, -1)], "vertex long, size long, fp long")
    links = [(r["a"], r["b"]) for r in nearcopies.golay_links(own).collect()]
    assert components_of(links) == {2: 2, 5: 2, 7: 2}


def components_of(links):
    root = {}
    for a, b in links:
        x, y = root.get(a, a), root.get(b, b)
        root |= {n: min(x, y) for n in {a, b} | {n for n, r in root.items() if r in (x, y)}}
    return root


def test_blocks_are_compressed_hard():
    """Files and segments of blocks are most of what stands on disk."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("aeinrst") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    lines_ = [" ".join(rnd.choice(words) for _ in range(12)) for _ in range(2000)]
    found = ["\n".join(f"{rnd.choice(lines_)} {rnd.choice(words)}" for _ in range(40)).encode() for _ in range(200)]
    packed = suffix.Block.of(list(range(200)), found).packed()
    assert len(packed) < 0.92 * len(zstandard.compress(zstandard.decompress(packed), 1))
