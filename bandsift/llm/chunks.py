"""Token ids of whole texts from a tokenizer library, learning each space-delimited chunk once.

A text is cut before each space or line end that follows a character which is not white space. Both
public pre-tokenisers always end a piece there, so ids of the chunks, in order, are the ids of the text.
Natural text repeats its chunks, and its words more than these: the chunks of a batch are parted from the
marks after them and looked up once each, most of them in a bounded dictionary, and Arrow puts their ids
together again.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from bandsift.llm.common import MEMO

#: Chunks remembered in a worker; beyond that it forgets those that it hasn't met for longest.
REMEMBERED = 600_000

#: Marks that may end a chunk of letters; both pre-tokenisers end a piece before a run of them.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Chunks that Arrow parts from their marks: those that end in a letter which no vocabulary's normaliser turns
#: into anything but one letter (so not the Turkish capital I with a dot, nor letters that NFC takes apart).
MARKED = f"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f][{re.escape(MARKS)}]{{1,4}}$"
BEFORE_MARKS = f"(?s)^.*[^{re.escape(MARKS)}]"

#: White space besides a space and a line end.
OTHER_SPACE = "[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


#: Byte-level vocabularies write each byte as a printable letter: itself, or the next one from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = dict(zip(sorted(set(range(256)) - set(_PRINTED)), map(chr, range(256, 512)), strict=False))
LETTERS = "".join(BYTE_LETTERS.get(i, chr(i)) for i in range(256))
SPACE = BYTE_LETTERS[32]

#: Where cuts before white space are not sure: it is not single spaces and line ends, or stands at the start.
UNSURE = f"\\A[ \n]|[ \n][ \n]|{OTHER_SPACE}"


class Chunks(dict):
    """chunk (without its space) -> ids as little-endian unsigned 32-bit integers; learnt when asked for.

    lead: whether white space before a chunk yields ids.
    """

    def __init__(self, path: str, lead: bool):
        super().__init__()
        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.lead = lead
        self.model = self.tokenizer.model
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.line_end = self.whole("\n")

    def __reduce__(self):
        # A copied tokenizer would forget its settings.
        return Chunks, (self.path, self.lead)

    def word(self, chunk: str, space: str) -> bytes | None:
        """Ids of a chunk of letters, at most a few marks after them, straight from the model; else None."""
        stem, marks = chunk, ""
        if not chunk.isalpha():
            stem = chunk.rstrip(MARKS)
            marks = chunk[len(stem) :]
            if not stem.isalpha() or len(marks) > 4:
                return None
        if len(stem) > 200:
            return None
        if not self.lead:
            if not stem.isascii() and ("\u03a3" in stem or not unicodedata.is_normalized("NFC", stem)):
                return None
            stem = stem.lower()
            if not stem.isalpha():
                return None
        if not stem.isascii():
            stem = codecs.charmap_decode(stem.encode(), "strict", LETTERS)[0]
        ids = array("I", [t.id for t in self.model.tokenize(space + stem)]).tobytes()
        return ids + self.after(marks) if marks else ids

    def after(self, marks: str) -> bytes:
        """Ids of marks that follow a letter."""
        if marks not in self.marks:
            self.marks[marks] = self.whole(marks) if marks else b""
        return self.marks[marks]

    def bare(self, chunk: str) -> bytes:
        """Ids of a chunk that follows no space, at most a line end before it."""
        begins = self.lead and chunk[:1] == "\n"
        ids = self.word(chunk[1:] if begins else chunk, "")
        if ids is None:
            return self.whole(chunk)
        return self.line_end + ids if begins else ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            if not self.lead or chunk[:1] == "\n":
                ids = self.bare(chunk)
            else:
                ids = self.word(chunk, SPACE)
                ids = self.whole(" " + chunk) if ids is None else ids
        if len(chunk) <= 200:
            self[chunk] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the same as encoding each text whole."""
        if len(self) + len(self.marks) > REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
            self.marks.clear()
        if not self.lead:
            # Where white space yields no ids, line ends go as well as spaces do.
            return self.joined([text.replace("\n", " ") for text in texts])
        unsure = pc.match_substring_regex(pa.array(texts, pa.large_string()), UNSURE).to_pylist()
        heads, rests = [], []
        for text, careful_cuts in zip(texts, unsure, strict=True):
            if careful_cuts:
                heads.append(b"".join(map(self.whole, careful(text))))
                rests.append(None)
                continue
            first, space, rest = text.replace("\n", " \n").partition(" ")
            heads.append(self.bare(first))
            rests.append(rest if space else None)
        return [head + rest for head, rest in zip(heads, self.joined(rests), strict=True)]

    def joined(self, texts: list[str | None]) -> list[bytes]:
        """Ids of the chunks of each text, cut at its spaces (a null has none); a chunk is looked up once."""
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        found = cut.flatten().dictionary_encode()
        if not len(found):
            return [b""] * len(texts)
        marked = pc.match_substring_regex(found.dictionary, MARKED)
        stems = pc.if_else(marked, pc.utf8_rtrim(found.dictionary, characters=MARKS), found.dictionary)
        marks = pc.replace_substring_regex(pc.if_else(marked, found.dictionary, ""), BEFORE_MARKS, "")
        known = pc.binary_join_element_wise(each(stems, self.__getitem__), each(marks, self.after), pa.scalar(b"", pa.large_binary()))
        ids = known.take(found.indices)
        _, ends, data = ids.buffers()
        places = np.frombuffer(ends, np.int64)[np.asarray(cut.offsets)].tolist()
        view = memoryview(data or b"")
        return [bytes(view[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]


def each(strings: pa.Array, ids) -> pa.Array:
    """Ids of each string, asked for once."""
    found = strings.dictionary_encode()
    return pa.array(list(map(ids, found.dictionary.to_numpy(zero_copy_only=False))), pa.large_binary()).take(found.indices)


def careful(text: str, least: int = 2000) -> list[str]:
    """Any text, cut before spaces that follow no white space, about every so many characters."""
    out, start = [], 0
    for m in re.finditer(r"(?<=\S) ", text):
        if m.start() - start >= least:
            out.append(text[start : m.start()])
            start = m.start()
    return [*out, text[start:]]


def chunks(path: str, lead: bool) -> Chunks:
    """The worker's encoder for a vocabulary file."""
    return MEMO.of(("chunks", path, lead), lambda: Chunks(path, lead))
