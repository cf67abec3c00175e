"""Token ids of many texts at once, equal to those of the tokenizers library.

A byte-level tokenizer cuts a text into pieces by one fixed pattern and encodes each piece by
itself. Here the cuts are found for a whole batch with arrays, equal pieces are grouped, and the
library encodes each new piece once; a bounded cache keeps pieces for later batches. A tokenizer
with other parts (normalizer, other pattern) or a text that holds an added token goes to the
library as it is.
"""

import functools
import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from threatloom.llm.common import slices

# Characters of one step, and pieces that a worker remembers: both bound memory only.
STEP_CHARS = 1 << 21
CACHE_PIECES = 400_000
# Characters of a tokenizer file that may be sent to the executors.
MAX_SOURCE = 64 << 20

LETTER, NUMBER, OTHER, SPACE, UNASSIGNED = range(5)


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point, as the pattern's ``\\p{L}``, ``\\p{N}``, ``\\s`` and the rest."""
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(i))
        if c[0] in "LN":
            kinds[i] = LETTER if c[0] == "L" else NUMBER
        elif c == "Cn":
            kinds[i] = UNASSIGNED
    for lo, hi in ((0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        kinds[lo : hi + 1] = SPACE
    return kinds


def piece_starts(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks where pieces of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` begin.

    ``chars`` holds the code points of texts one after the other, ``first`` marks their first ones.
    """
    n = len(chars)
    kind = char_classes()[chars]
    space = kind == SPACE
    after_blank = np.zeros(n, bool)
    after_blank[1:] = chars[:-1] == 0x20
    same = np.zeros(n, bool)
    same[1:] = kind[1:] == kind[:-1]
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    before_word = np.zeros(n, bool)
    before_word[:-1] = ~space[1:]
    before_word &= ~last
    # a word character begins a piece unless it goes on or has a blank before it; white space
    # begins one at the start of its run and, before a word, at the run's last character
    starts = first | np.where(space, ~same | before_word, ~same & ~after_blank)
    marks = np.flatnonzero((chars == 0x27) & starts)
    if len(marks):
        text = lambda at: np.where(at < n, chars[np.minimum(at, n - 1)], 0)
        inside = lambda at: (at < n) & ~first[np.minimum(at, n - 1)]
        a, b = text(marks + 1), text(marks + 2)
        one = inside(marks + 1) & np.isin(a, [ord(c) for c in "stmd"])
        pair = np.zeros(len(marks), bool)
        for x, y in ("re", "ve", "ll"):
            pair |= (a == ord(x)) & (b == ord(y))
        pair &= inside(marks + 1) & inside(marks + 2)
        for some, size in ((marks[one], 2), (marks[pair], 3)):
            starts[some + 1] = False
            after = some + size
            after = after[after < n]
            starts[after[kind[after] == LETTER]] = True
    return starts


class Encoder:
    """Ids of texts by the tokenizer given as the JSON of its file."""

    def __init__(self, source: str):
        self.tokenizer = Tokenizer.from_str(source)
        spec = json.loads(source)
        pre = spec.get("pre_tokenizer") or {}
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.by_piece = byte_level and not spec.get("normalizer") and not spec.get("truncation")
        self.added = [t["content"].encode() for t in spec.get("added_tokens", []) if t["content"]]
        breaks = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_break = breaks[0] if len(breaks) == 1 else None
        self.young, self.old = Pieces(CACHE_PIECES), Pieces(0)

    def encode(self, texts: list) -> tuple:
        """(ids of all texts one after the other as uint32, number of ids of each text)."""
        plain = [self.by_piece and not any(a in text for a in self.added) for text in texts]
        if all(plain):
            return self._by_piece(texts)
        ids, n = self._by_piece([t for t, p in zip(texts, plain) if p])
        pieces = iter(np.split(ids, np.cumsum(n)[:-1]))
        parts = [next(pieces) if p else self._alone(t) for t, p in zip(texts, plain)]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _alone(self, text):
        return np.array(self.tokenizer.encode(text.decode(errors="replace"), add_special_tokens=False).ids, np.uint32)

    def _by_piece(self, texts):
        whole = b"".join(texts)  # Spark strings are UTF-8
        if not whole:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        raw = np.frombuffer(whole, np.uint8)
        heads = np.flatnonzero((raw & 0xC0) != 0x80)  # first byte of each character
        chars = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
        if (char_classes()[chars] == UNASSIGNED).any():  # the library may know newer characters
            own = [self._alone(t) for t in texts]
            return np.concatenate(own), np.array([len(x) for x in own])
        ends = np.cumsum([len(t) for t in texts])
        first = np.zeros(len(chars), bool)
        begins = np.searchsorted(heads, np.concatenate([[0], ends[:-1]]))
        first[begins[begins < len(chars)]] = True
        cuts = heads[piece_starts(chars, first)]
        offsets = np.append(cuts, len(whole)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(whole)])
        grouped = pc.dictionary_encode(pieces)
        out, n = self._known(grouped.dictionary.to_pylist()).gather(grouped.indices.to_numpy())
        place = np.cumsum(n) - n
        upto = np.append(place, len(out))[np.searchsorted(cuts, np.concatenate([[0], ends]))]
        return out, np.diff(upto)

    def _known(self, pieces):
        """A view of the cache in which piece i of ``pieces`` has number i.

        Two generations are kept: when the young one is full it becomes the old one, and what is still
        used comes over from there, so frequent pieces are not encoded again.
        """
        missing = [p for p in pieces if p not in self.young.known]
        if len(self.young.known) + len(missing) > self.young.room:
            self.young, self.old, missing = Pieces(max(CACHE_PIECES, len(pieces))), self.young, pieces
        kept = [p for p in missing if p in self.old.known]
        if kept:
            ids, n = self.old.view(kept).gather(np.arange(len(kept)))
            self.young.learn(kept, ids, np.cumsum(n) - n, np.cumsum(n))
        new = [p for p in missing if p not in self.old.known]
        blank = {p for p in new if (p[-1] <= 0x20 or p[-1] >= 0x80) and p.decode().isspace()}
        words = [p for p in new if p not in blank] if self.line_break is not None else []
        for p in blank if self.line_break is not None else new:
            self._learn_alone(p)
        # a line break is a piece of its own between two words, so many words go in one text
        for lo in range(0, len(words), 2000):
            some = words[lo : lo + 2000]
            text = b"\n".join(some).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == self.line_break)
            if len(at) == len(some) - 1:
                self.young.learn(some, ids, np.append(0, at + 1), np.append(at, len(ids)))
            else:
                for p in some:
                    self._learn_alone(p)
        return self.young.view(pieces)

    def _learn_alone(self, piece):
        ids = self._alone(piece)
        self.young.learn([piece], ids, np.array([0]), np.array([len(ids)]))


class Pieces:
    """Ids of up to ``room`` pieces: number of each piece, and where its ids stand in one array."""

    def __init__(self, room):
        self.room, self.known, self.flat, self.used = room, {}, np.zeros(1 << 10, np.uint32), 0
        self.start, self.size = np.zeros(room, np.int64), np.zeros(room, np.int64)

    def learn(self, pieces, ids, begins, ends):
        first, used = len(self.known), self.used
        if used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(ids), len(self.flat)), np.uint32)])
        self.flat[used : used + len(ids)] = ids
        self.used += len(ids)
        self.start[first : first + len(pieces)] = begins + used
        self.size[first : first + len(pieces)] = ends - begins
        self.known.update(zip(pieces, range(first, first + len(pieces))))

    def view(self, pieces):
        number = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        some = Pieces(0)
        some.flat, some.start, some.size = self.flat, self.start[number], self.size[number]
        return some

    def gather(self, numbers):
        """(ids of these pieces one after the other, number of ids of each)."""
        n = self.size[numbers]
        place = np.cumsum(n) - n
        return self.flat[np.repeat(self.start[numbers] - place, n) + np.arange(int(n.sum()))], n


@functools.lru_cache(maxsize=2)
def encoder(source: str) -> Encoder:
    """One encoder a worker and tokenizer."""
    return Encoder(source)


def encoded_batches(source: str, texts: list):
    """(first row, rows, ids, counts) for runs of ``texts`` of bounded size."""
    enc = encoder(source)
    for lo, hi in slices([len(t) for t in texts], STEP_CHARS):
        ids, counts = enc.encode(texts[lo:hi])
        yield lo, hi, ids, counts


def tokenizer_source(path: str) -> str:
    """JSON of a tokenizer file. A vocabulary is a small fixed file; larger ones are refused."""
    with open(path, encoding="utf-8") as f:
        source = f.read(MAX_SOURCE + 1)
    if len(source) > MAX_SOURCE:
        raise ValueError(f"{path} is larger than {MAX_SOURCE} characters")
    return source
