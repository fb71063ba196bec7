"""Language-model scores: marginal likelihood over a lattice of subwords, words and lines.

A text is a row of words (runs without ASCII white space, A-Z lower-cased) and one end. A word's
probability sums over all its segmentations: into one piece, the word itself, weighted by how often
training texts hold it, less a discount; and into the pieces of a public subword vocabulary (with
single bytes as a last resort), whose scores are how often the vocabulary's own segmentation of the
training words uses them. The discounts weigh the second kind. Forward recursion in log space adds up
all paths through a word. Likewise a line of several words is one piece, if training texts repeat
it, or its words; how much mass repeated lines get follows from the share of lines seen once.

Scan tasks number the units (words, lines) of the texts they see in dictionaries of bounded size, and
write texts as unit numbers beside the dictionaries. Dictionaries go out by hash shards of units;
what is known of each unit comes back to each dictionary. No text moves, and no unit's occurrences
meet anywhere: a unit counts once a dictionary.

Edge cases: a null or empty text is its end only; a null doc_id counts as the empty string; repeated
rows are separate texts; with no training text, words have their subword probability only; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandsift.llm.common import MEMO, batches, cut_lineage, give_back, packed, texts, unpacked

#: Units and words after which a dictionary is closed.
UNITS, WORDS = 300_000, 4_000_000

#: What is taken from each word's count for the words that training texts lack.
DISCOUNT = 0.75

#: Units that no word can be: the end of a text, and the first byte of lines.
END, LINE = b"\t", b"\n"

NONE = 0xFFFFFFFF


def units(text: str) -> tuple[list[bytes], list[tuple[bytes | None, int]]]:
    """Words of a text and the end; for each line with words, its unit (if several) and how many."""
    words: list[bytes] = []
    lines: list[tuple[bytes | None, int]] = []
    for line in text.encode().lower().split(b"\n"):
        own = line.split()
        if own:
            words += own
            lines.append((LINE + xxhash.xxh3_128_hexdigest(b" ".join(own)).encode() if len(own) > 1 else None, len(own)))
    words.append(END)
    return words, lines


def tallied(docs: DataFrame, shards: int, modulus: int, left_out: int) -> DataFrame:
    """Two kinds of rows: texts as unit numbers (shard null), and dictionaries cut by shard.

    block tells dictionaries apart. tokens: unit numbers; lines: (unit number or NONE, words).
    names: units of a shard, joined by spaces; counts: in training texts; places: their numbers. All but
    lines are compressed.
    """

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        known: dict[bytes, int] = {}
        counts: Counter[int] = Counter()
        seen = 0

        def close() -> Iterator[pa.RecordBatch]:
            by_shard: dict[int, tuple[list[bytes], list[int]]] = {}
            for unit, place in known.items():
                own = by_shard.setdefault(zlib.crc32(unit) % shards, ([], []))
                own[0].append(unit)
                own[1].append(place)
            for shard, (names, places) in by_shard.items():
                own = np.array([counts[p] for p in places], "<u4").tobytes()
                row = [block, shard, None, None, None, None, packed(b" ".join(names)), packed(own), packed(np.array(places, "<u4").tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TALLY.types, strict=True)], schema=_TALLY)

        block = part << 32
        for batch in batches(it):
            cols: list[list] = [[] for _ in _TALLY]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                held = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == left_out
                words, lines = units(text)
                places = [known.setdefault(w, len(known)) for w in words]
                rows = [(NONE if u is None else known.setdefault(u, len(known)), n) for u, n in lines]
                if not held:
                    counts.update(places)
                    counts.update(u for u, _ in rows if u != NONE)
                row = [block, None, doc_id, held, packed(np.array(places, "<u4").tobytes()), np.array(rows, "<u4").tobytes(), None, None, None]
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
                seen += len(words)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TALLY.types, strict=True)], schema=_TALLY)
            if len(known) > UNITS or seen > WORDS:
                yield from close()
                made += 1
                block, seen = part << 32 | made, 0
                known.clear()
                counts.clear()
        yield from close()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "block long, shard int, doc_id long, held boolean, tokens binary, lines binary, names binary, counts binary, places binary"
    return cut_lineage(own.mapInArrow(scan, schema))


_TALLY = pa.schema(
    [("block", pa.int64()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("held", pa.bool_())]
    + [(c, pa.binary()) for c in ("tokens", "lines", "names", "counts", "places")]
)


class Pieces:
    """Pieces of a subword vocabulary with log probabilities, and the forward recursion over them."""

    def __init__(self, vocabulary: str, counts: dict[int, float], stops: float):
        own = subwords(vocabulary)
        total = sum(counts.values()) + stops + 0.1 * (own.get_piece_size() + 1)
        self.stop = math.log((stops + 0.1) / total)
        self.pieces: dict[str, float] = {}
        self.bytes = [0.0] * 256
        for i in range(own.get_piece_size()):
            score = math.log((counts.get(i, 0) + 0.1) / total)
            if own.is_byte(i):
                self.bytes[int(own.id_to_piece(i)[3:5], 16)] = score
            elif not (own.is_control(i) or own.is_unknown(i)):
                self.pieces[own.id_to_piece(i)] = score
        self.longest = max(map(len, self.pieces), default=1)

    def log_probability(self, word: str) -> float:
        """log of the sum, over all segmentations of the word, of the product of their pieces."""
        text = "▁" + word
        n, pieces = len(text), self.pieces
        ahead: list[float | None] = [None] * (n + 1)
        ahead[0] = 0.0
        for i in range(n):
            here = ahead[i]
            steps = [(j, pieces[p]) for j in range(i + 1, min(n, i + self.longest) + 1) if (p := text[i:j]) in pieces]
            steps.append((i + 1, sum(self.bytes[b] for b in text[i].encode())))
            for j, score in steps:
                new, old = here + score, ahead[j]
                if old is None:
                    ahead[j] = new
                elif new > old:
                    ahead[j] = new + math.log1p(math.exp(old - new))
                else:
                    ahead[j] = old + math.log1p(math.exp(new - old))
        return ahead[n] + self.stop


def subwords(path: str) -> sentencepiece.SentencePieceProcessor:
    return MEMO.of(("subwords", path), lambda: sentencepiece.SentencePieceProcessor(model_file=path))


def _totals(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, bytes, bytes]], dict[bytes, int]]]:
    """For each shard of a partition: its dictionaries (block, packed units, places), and counts of its units.

    Units of one dictionary at a time are unpacked; at the end the worker gives its memory back.
    """
    held: dict[int, list[tuple[int, bytes, bytes, bytes]]] = {}
    for batch in it:
        for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "names", "counts", "places")), strict=True):
            held.setdefault(shard, []).append(tuple(row))
    try:
        for shard in list(held):
            asked, total = [], {}
            for block, names, counts, places in held.pop(shard):
                for unit, n in zip(unpacked(names).split(b" "), np.frombuffer(unpacked(counts), "<u4").tolist(), strict=True):
                    total[unit] = total.get(unit, 0) + n
                asked.append((block, names, places))
            yield asked, total
            del asked, total
    finally:
        give_back()


def trained(dictionaries: DataFrame, shards: int, vocabulary: str) -> tuple[dict[str, int], dict[int, float]]:
    """Counts over all training texts (a few numbers), and how often words use each subword piece.

    Each distinct word counts once for the pieces: they stand for words that are rare or new.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = subwords(vocabulary)
        sums, pieces = Counter(), Counter()
        for _, total in _totals(it):
            words = []
            for unit, n in total.items():
                if n and unit[:1] == LINE:
                    sums["lines"] += n
                    sums["lines_once"] += n == 1
                elif n:
                    sums["tokens"] += n
                    sums["types"] += 1
                    if unit != END:
                        words.append(unit.decode())
            for at in range(0, len(words), 10_000):
                for ids in own.encode(words[at : at + 10_000], num_threads=1):
                    pieces.update(ids)
        rows = [(k, None, v) for k, v in sums.items()] + [(None, k, v) for k, v in pieces.items()]
        kinds, ids, values = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(ids, pa.int32()), pa.array(values, pa.int64())], names=["kind", "piece", "n"])

    parts = dictionaries.select("shard", "block", "names", "counts", "places").repartition(shards, "shard").mapInArrow(run, "kind string, piece int, n long")
    # As many rows as the vocabulary has pieces, and four.
    rows = parts.groupBy("kind", "piece").agg(F.sum("n").alias("n")).collect()
    return {r["kind"]: r["n"] for r in rows if r["kind"]}, {r["piece"]: r["n"] for r in rows if r["kind"] is None}


def answers(dictionaries: DataFrame, shards: int, sums: dict[str, int], counts: dict[int, float], vocabulary: str) -> DataFrame:
    """(block, places, counts, scores): for the units of each dictionary, count and log probability."""
    tokens, types, lines = sums.get("tokens", 0), sums.get("types", 0), sums.get("lines", 0)
    repeated = 1 - max(sums.get("lines_once", 0), 1) / lines if lines else 0.0
    known = dictionaries.sparkSession.sparkContext.broadcast(counts)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for asked, total in _totals(it):
            model = model or Pieces(vocabulary, known.value, types)
            score: dict[bytes, float] = {}
            for unit, n in total.items():
                if unit[:1] == LINE:
                    score[unit] = math.log(repeated * n / lines) if n and repeated else -math.inf
                    continue
                own = max(n - DISCOUNT, 0) / tokens if tokens else 0.0
                if unit == END:
                    score[unit] = math.log(own or 1 / (tokens + types + 1))
                    continue
                rest = model.log_probability(unit.decode()) + (math.log(DISCOUNT * types / tokens) if tokens else 0.0)
                score[unit] = float(np.logaddexp(math.log(own), rest)) if own else rest
            for block, names_, places in asked:
                names = unpacked(names_).split(b" ")
                row = [[block], [places], [packed(np.array([total[u] for u in names], "<i8").tobytes())], [packed(np.array([score[u] for u in names], "<f8").tobytes())]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _ANSWER.types, strict=True)], schema=_ANSWER)

    own = dictionaries.select("shard", "block", "names", "counts", "places").repartition(shards, "shard")
    return own.mapInArrow(run, "block long, places binary, counts binary, scores binary")


_ANSWER = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("places", "counts", "scores"))])


def scores(docs: DataFrame, vocabulary: str, modulus: int = 7, left_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Runs jobs when called.

    Texts train the model unless crc32 of their doc_id, as text, leaves `left_out` divided by `modulus`.
    """
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = tallied(docs, shards, modulus, left_out)
    dictionaries = table.filter("shard is not null")
    sums, pieces = trained(dictionaries, shards, vocabulary)
    found = answers(dictionaries, shards, sums, pieces, vocabulary)
    tokens, types, lines = sums.get("tokens", 0), sums.get("types", 0), sums.get("lines", 0)
    once = max(sums.get("lines_once", 0), 1) / lines if lines else 1.0

    def score(rows: pa.Table, answer: pa.Table) -> pa.Table:
        places = np.concatenate([np.frombuffer(unpacked(x), "<u4") for x in answer.column("places").to_pylist()])
        count, value = np.zeros(len(places), np.int64), np.zeros(len(places))
        count[places] = np.concatenate([np.frombuffer(unpacked(x), "<i8") for x in answer.column("counts").to_pylist()])
        value[places] = np.concatenate([np.frombuffer(unpacked(x), "<f8") for x in answer.column("scores").to_pylist()])
        base = np.log10((count + 1) / (tokens + types + 1))
        out: list[list] = [[] for _ in range(4)]
        for own, by_line in zip(rows.column("tokens").to_pylist(), rows.column("lines").to_pylist(), strict=True):
            at = np.frombuffer(unpacked(own), "<u4")
            unit, n = np.frombuffer(by_line, "<u4").reshape(-1, 2).T.astype(np.int64)
            total = value[at[-1]]
            if len(n):
                split = np.add.reduceat(value[at[:-1]], np.concatenate([[0], np.cumsum(n)[:-1]]))
                several = unit != NONE
                whole = np.where(several, value[np.where(several, unit, 0)], -np.inf)
                total += np.where(several, np.logaddexp(whole, split + math.log(once)), split).sum()
            for col, v in zip(out, (len(at), int((count[at] > 0).sum()), float(base[at].sum()), float(total / math.log(10))), strict=True):
                col.append(v)
        n = len(out[0])
        del places, count, value, base
        give_back()
        cols = [rows.column("doc_id"), rows.column("held"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array([tokens] * n, pa.int64()), *(pa.array(x, pa.float64()) for x in out[2:])]
        return pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = table.filter("shard is null").select("block", "doc_id", "held", "tokens", "lines")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, schema)
