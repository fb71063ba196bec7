"""Byte-level BPE, token files and packing against the libraries and small brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from bandsift.llm import bpe, eliasfano, packing, tokenfile
from bandsift.llm.chunks import chunks
from bandsift.llm.common import ready, shared_folder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "a", "word", "The", "'s", "'", "'re", "é", "́", "12", "!", "|", "\x1c", " ", "\xa0", "漢", "Σ", "\r\n", "\t", "😀", "<|endoftext|>"]


def texts(n=250, seed=1):
    rnd = random.Random(seed)
    return [None, "", "x" * 300, " " * 120, "\n\n", "ab " * 60] + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def frame(spark, rows):
    # Columns whose names the operators use themselves.
    return ready(spark).createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, ids string")


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(32, 16), (17, 9)])
def test_stitched_chunks_equal_whole_texts(spark, tik, chunk, overlap):
    rows = [(i % 240, t) for i, t in enumerate(texts())]
    got = bpe.encode(frame(spark, rows), RANKS, public_tokenizers.PATTERN, chunk, overlap).collect()
    want = sorted((i, tuple(tik.encode_ordinary(t or ""))) for i, t in rows)
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in got) == want


def test_round_trip(spark, tik):
    rows = list(enumerate(texts(60, seed=2)))
    got = {r["doc_id"]: r for r in bpe.round_trip(frame(spark, rows), RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        ids = tik.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("path,lead", [(BYTES, True), (WORDS, False)])
def test_chunks_equal_whole_texts(path, lead):
    own = [t or "" for t in texts(600, seed=3)]
    encoder = chunks(path, lead)
    want = encoder.tokenizer.encode_batch(own, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(own)] == [e.ids for e in want]


@pytest.mark.parametrize("path,lead", [(BYTES, True), (WORDS, False)])
def test_words_with_marks_and_line_ends_come_from_the_model(path, lead, monkeypatch):
    """Only runs of marks, the line end and odd chunks go through the whole tokenizer."""
    text = "Start " + "\n".join(f"Wörd{'abcdefghij'[i % 10]}{'xyz'[i % 3]}{m} next(-- {'pqrst'[i % 5]}line" for i, m in enumerate([".", "!!", "$$$", ",&&&", ""] * 40))
    odd = "it's a.b\n\nx O'Neil's!! \n!! x_y__ ΑΣ\nΣ! e\ńa 5\n5!! <|endoftext|>\nA a\r\nb _\n_ '!\n's ....."
    encoder = chunks.__globals__["Chunks"](path, lead)
    wholes, whole = [], encoder.whole
    want = [whole(text), whole(odd)]
    monkeypatch.setattr(encoder, "whole", lambda x: wholes.append(x) or whole(x))
    assert encoder.encode([text])[0] == want[0]
    assert len(wholes) <= 8
    assert encoder.encode([odd])[0] == want[1]


@pytest.mark.parametrize("path,lead", [(BYTES, True), (WORDS, False)])
def test_a_chunk_is_looked_up_once_in_a_batch(path, lead):
    looked = []

    class Counting(chunks.__globals__["Chunks"]):
        def __getitem__(self, chunk):
            looked.append(chunk)
            return super().__getitem__(chunk)

    own = ["", "First the same wörds! ", "Start\nthe same wörds! " * 30 + "end", "two  spaces", "\nthe end", "x", "the same wörds! " * 40]
    encoder = Counting(path, lead)
    want = [encoder.whole(t) for t in own]
    assert encoder.encode(own) == want
    assert len(looked) == len(set(looked)) < 12
    assert encoder.encode([]) == [] and encoder.encode([""] * 3) == [b""] * 3


@pytest.mark.parametrize("path,lead", [(BYTES, True), (WORDS, False)])
def test_a_full_dictionary_forgets_only_what_was_not_met(path, lead, monkeypatch):
    encoder = chunks.__globals__["Chunks"](path, lead)
    monkeypatch.setitem(chunks.__globals__, "REMEMBERED", 40)
    learnt, word = [], encoder.word
    monkeypatch.setattr(encoder, "word", lambda chunk, *a: learnt.append(chunk) or word(chunk, *a))
    for i in range(50):
        text = "x frequent " + " ".join("rare" + "abcdefghij"[i % 10] + "abcdefghij"[i // 10] + c for c in "klmnopq")
        assert encoder.encode([text]) == [encoder.whole(text)]
    assert learnt.count("frequent") == 1
    assert len(encoder) + len(encoder.older) <= 80


@pytest.mark.parametrize("path,lead", [(BYTES, True), (WORDS, False)])
def test_a_word_is_learnt_once_whatever_marks_follow(path, lead, monkeypatch):
    encoder = chunks.__globals__["Chunks"](path, lead)
    learnt, word = [], encoder.word
    monkeypatch.setattr(encoder, "word", lambda chunk, *a: learnt.append(chunk) or word(chunk, *a))
    text = "x " + " ".join(w + m for m in ["", ",", ".", "!!", "--", ")...", ",", ""] for w in ("wordily", "würfelé"))
    assert encoder.encode([text, text + "?"]) == [encoder.whole(text), encoder.whole(text + "?")]
    assert sorted(c.rstrip(".,!-)?") for c in learnt if c != "x") == ["wordily", "würfelé"]


@pytest.mark.parametrize("path,lead", [(BYTES, True), (WORDS, False)])
def test_marks_after_any_letter(path, lead):
    """Some letters end in a mark once lowered or composed, and that one belongs to the marks after it."""
    ends = ["a", "Z", "é", "ß", "ÿ", "Ÿ", "İ", "ı", "ŉ", "ſ", "Σ", "ς", "\u0958", "\ufb1d", "\u212a", "e\u0301", "漢", "ª", "5", "_", "'s", "'", "\u00d7"]
    own = [f"The fir{e}{m} nex{e}{m}\nlin{e}{m} {m} en{e}{m}" for e in ends for m in ("", ",", "!?", "...-", ".....", "'", "',", "<|")]
    encoder = chunks.__globals__["Chunks"](path, lead)
    assert encoder.encode(own) == [encoder.whole(t) for t in own]


def test_elias_fano():
    rnd = random.Random(4)
    for n in (0, 1, 2, 255, 256, 257, 3000):
        values = np.array(sorted(rnd.choice([rnd.randrange(1 << 40), rnd.randrange(50)]) for _ in range(n)), np.uint64)
        data = eliasfano.encode(values)
        own = eliasfano.EliasFano(b"ab" + data, 2)
        assert own.values().tolist() == values.tolist() and own.end == len(data) + 2
        assert [own.select(i) for i in range(n)] == values.tolist()
        for _ in range(20):
            a, b = sorted((rnd.randint(0, n), rnd.randint(0, n)))
            assert own.between(a, b).tolist() == values[a:b].tolist()
    dense = eliasfano.encode(np.arange(0, 2_000_000, 20, dtype=np.uint64))
    assert len(dense) < 100_000  # 6.4 bits a value, where a table takes 64


def test_token_files(spark):
    rows = [(i * 3, t) for i, t in enumerate(texts(150, seed=5))] + [(None, "no id"), (6, "same id")]
    docs = frame(spark, rows)
    manifest = tokenfile.write_token_files(docs, shared_folder(spark, "tokens"), BYTES, 2, 50257)
    read = tokenfile.read_token_files(manifest).collect()
    encoder = Tokenizer.from_file(BYTES)
    encoder.encode_special_tokens = True
    want = Counter((i, tuple([*encoder.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in read) == want
    at = 0
    for r in sorted(read, key=lambda r: r["start"]):
        assert r["start"] == at
        at += len(r["ids"]) // 4
    order = [r["doc_id"] for r in sorted(read, key=lambda r: r["start"])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    spread = tokenfile.read_token_files(manifest, tasks=3)
    assert spread.rdd.getNumPartitions() == 3 and sorted(map(repr, spread.collect())) == sorted(map(repr, read))
    row = manifest.orderBy("start").first()
    file = tokenfile.TokenFile(row["path"])
    first = sorted(read, key=lambda r: r["start"])[:4]
    for i, r in enumerate(first):
        assert file.doc_id(i) == r["doc_id"]
        assert file.read(*file.span(i)).tolist() == np.frombuffer(r["ids"], "<u4").tolist()


def test_token_files_in_small_steps(spark, monkeypatch):
    rows = [(None, "no id")] * 5 + [(i, "some words " * (i % 7)) for i in range(60)]
    for docs, ids in ((1, 1), (3, 10), (7, 1 << 20)):
        monkeypatch.setattr(tokenfile, "STEP_DOCS", docs)
        monkeypatch.setattr(tokenfile, "STEP_IDS", ids)
        got = tokenfile.token_file_digests(spark, frame(spark, rows), BYTES, 2, 50257).orderBy("start").collect()
        at = 0
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
        encoder = Tokenizer.from_file(BYTES)
        want = Counter((i, zlib.crc32(np.array([*encoder.encode(t).ids, 2], "<u4").tobytes())) for i, t in rows)
        assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want


def fewest(items, room):
    best, items = len(items), sorted(items, reverse=True)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= room and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_reduction_loses_no_optimum():
    rnd = random.Random(6)
    for _ in range(250):
        room = rnd.choice([10, 20, 37])
        items = [rnd.randint(rnd.choice([1, room // 4]), room) for _ in range(rnd.randint(0, 10))]
        left = packing.Counts(dict(Counter(items)), room)
        fixed = packing.reduce(left, room)
        rest = [s for s in left.sizes for _ in range(left.n[s])]
        assert sum(n for _, n in fixed) + fewest(rest, room) == fewest(items, room)
        packed = Counter()
        for own, n in packing.plan(dict(Counter(items)), room):
            assert sum(own) <= room
            packed.update({s: own.count(s) * n for s in set(own)})
        assert packed == Counter(items)


def test_packing(spark):
    rows = list(enumerate(texts(300, seed=7))) + [(3, "twice"), (3, "twice"), (None, "no id"), (999, "long " * 700)]
    docs = frame(spark, rows).repartition(5)
    pieces = packing.token_pieces(docs, WORDS, 0, 64)
    got = packing.pack(pieces, 64).collect()
    encoder = Tokenizer.from_file(WORDS)
    encoder.encode_special_tokens = True
    want = Counter()
    for i, t in rows:
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 64)):
            own = ids[a : a + 64]
            want[(i, k, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    lengths = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.sequences(pieces.filter("doc_id is not null and doc_id <> 3"), packing.pack(pieces, 64)).collect()}
    assert all(n <= 64 for n in lengths.values())


@pytest.mark.parametrize("run", [lambda d: bpe.round_trip(d, RANKS, public_tokenizers.PATTERN), lambda d: packing.packed_documents(d, WORDS, 0, 2048), lambda d: tokenfile.token_file_digests(d.sparkSession, d, BYTES, 2, 50257)])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).collect() == []


def test_workers_forget_what_a_task_did_not_use():
    from bandsift.llm.common import MEMO, give_back

    MEMO.clear()
    MEMO.of(("a",), list)
    MEMO.of(("b",), list)
    give_back()
    assert ("a",) in MEMO and ("b",) in MEMO
    MEMO.of(("b",), list)
    give_back()
    assert ("a",) not in MEMO and ("b",) in MEMO
