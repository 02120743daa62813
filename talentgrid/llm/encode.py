"""Token ids of whole texts by the tokenizers library, one chunk of texts at a time.

Both vocabularies split a text at single white spaces before their merges.  A text is tiled
into *units*, each a word with the white space before it, so ids of a text are the ids of its
units in order.  The distinct units of a chunk are found by Arrow's dictionary, encoded once by
the library and gathered for all texts with array indices.  A unit of letters, and at most one
punctuation mark behind them, goes straight to the library's merge model; any other unit is
encoded by the library whole.  A text with runs of white space, or white space at its ends, is
encoded whole.

Defined results: ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``.  A
vocabulary's control strings (such as ``<|endoftext|>``) inside a text thus become their control
ids; with ``control=False`` they are ordinary text.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from . import words as W

#: Most units kept per worker; beyond, the cache starts anew.
CACHE_UNITS = 400_000
#: Bytes of text encoded at once; longer chunks repeat more of their units.
CHUNK_BYTES = 4 << 20
#: Letters whose lower case and composed form are one letter each.
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿŒœ]+")
#: Marks that are one part of a text when they follow letters and stand before white space.
MARKS = tuple(".,;:!?")

_encoders: dict[tuple[str, bool, bool], Encoder] = {}


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        out.setdefault(b, chr(0x100 + len(out) - len(plain)))
    return [out[b] for b in range(256)]


class Encoder:
    """``encode`` gives the ids of a chunk of texts as one array of ``kind``.

    ``spaced``: white space is part of the ids (byte-level vocabularies); otherwise the
    vocabulary drops it, lower-cases letters and marks the ends of words.
    """

    def __init__(self, path: str, spaced: bool, control: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not control
        self.model = self.tokenizer.model
        self.spaced = spaced
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.units: dict[str, bytes | None] = {}
        self.most = CACHE_UNITS
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.space = self.letters[0x20]
        self.marks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """Ids of one text by a plain call of the library."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, lead: str, word: str) -> bytes:
        """Ids of letters, after a space or not, by the library's merges."""
        if not self.spaced:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        if self.spaced and lead == " ":
            word = self.space + word
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def _learn(self, new: list[str]) -> None:
        """Put the ids of new units into the cache; null for a unit that is not safe by itself."""
        cache, hard = self.units, []
        for u in new:
            lead, core = (u[0], u[1:]) if u[:1] in (" ", "\n") else ("", u)
            word, mark = (core[:-1], core[-1]) if core[-1:] in MARKS else (core, "")
            if not ((word.isascii() and word.isalpha()) or LETTERS.fullmatch(word)):
                if not core or core[0].isspace() or core[-1].isspace():
                    cache[u] = None
                else:
                    hard.append(u)
                continue
            ids = (mark and cache.get(lead + word)) or self._word(lead, word)
            if lead == "\n" and self.spaced and not (mark and lead + word in cache):
                ids = self._mark("\n") + ids
            cache[u] = ids + self._mark(mark) if mark else ids
        if hard:
            texts = hard if self.spaced else [u.lstrip(" \n") for u in hard]
            for u, e in zip(hard, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                cache[u] = array(self.code, e.ids).tobytes()

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self.whole(mark)
        return self.marks[mark]

    def encode(self, raw: np.ndarray, off: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a chunk (its bytes and offsets), and where each text's ids begin.

        ``end_id`` is put behind each text's ids.
        """
        n = len(off) - 1
        _, ends, first = W.spans(raw, off, W.NON_SPACE)
        # units tile each text; white space behind the last word makes one more unit
        edge = np.zeros(len(raw) + 1, bool)
        edge[ends] = edge[off[1:]] = True
        edge[0] = False
        stops = np.flatnonzero(edge)
        first = np.searchsorted(stops, off, "right")
        at = np.concatenate(([0], stops)).astype(np.int32)
        units = pa.StringArray.from_buffers(len(stops), pa.py_buffer(at.tobytes()), pa.py_buffer(raw.tobytes())).dictionary_encode()
        codes = units.indices.to_numpy()
        names = units.dictionary.to_pylist()
        cache = self.units
        missing = [u for u in names if u not in cache]
        if missing:
            if len(cache) + len(missing) > self.most:
                cache.clear()
                missing = names
            self._learn(missing)
        found = [cache[u] for u in names]
        bad = np.fromiter((f is None for f in found), bool, len(found))
        again: set[int] = set()
        if bad.any():  # their texts are encoded whole
            again = set(np.unique(np.searchsorted(first, np.flatnonzero(bad[codes]), "right") - 1).tolist())
            found = [f or b"" for f in found]
        wholes = {d: self.whole(raw[off[d] : off[d + 1]].tobytes().decode()) for d in sorted(again)}
        parts = [*found, *wholes.values(), np.array([] if end_id is None else [end_id], self.kind).tobytes()]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.kind.itemsize
        begin = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(parts), self.kind)
        # the parts of each text in order: its units, or one part for the whole text, then the end
        count = np.diff(first)
        owner = np.repeat(np.arange(n), count)
        keep = np.ones(len(codes), bool)
        docs = np.array(list(wholes), np.int64)
        if len(docs):
            keep = ~np.isin(owner, docs)
            count = count.copy()
            count[docs] = 1
        head = np.concatenate(([0], np.cumsum(count + 1)))
        part = np.empty(int(head[-1]), np.int64)
        part[(head[owner] + np.arange(len(codes)) - first[owner])[keep]] = codes[keep]
        part[head[docs]] = len(found) + np.arange(len(docs))
        part[head[1:] - 1] = len(parts) - 1
        width = size[part]
        total = np.concatenate(([0], np.cumsum(width)))
        ids = flat[np.repeat(begin[part] - total[:-1], width) + np.arange(int(total[-1]))]
        return ids, total[head]


def encoder(path: str, spaced: bool, control: bool = True, most: int = CACHE_UNITS) -> Encoder:
    """One encoder per worker process, file and kind; it keeps ``most`` units from now on."""
    key = (path, spaced, control)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    _encoders[key].most = most
    return _encoders[key]
