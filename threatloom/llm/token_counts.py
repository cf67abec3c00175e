"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie; each node has a failure link to the node that is reached once the pieces
that are certain there have been cut off, and the number of these pieces (the popped tokens) is
computed beforehand. A word is read once, one step a byte, and only counts are added: no piece is built.
The result is the length of the greedy longest-match-first cut.

Defined results: words are runs without white space; a word that cannot be cut into pieces is one
unknown token; a null or empty text has none; repeated rows are counted one by one; an empty table
gives no rows; other columns are not read.
"""

import functools
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from threatloom.llm.common import spaced_words, text_rows, texts_of
from threatloom.llm.tokens import tokenizer_source

# Words whose counts a worker remembers.
CACHE_WORDS = 500_000


class PieceAutomaton:
    """Greedy word-piece lengths over byte strings.

    ``first`` are the pieces that may begin a word, ``inner`` those that may follow. An empty piece in ``first`` counts
    as a piece before a word that begins with no other one.
    """

    def __init__(self, first, inner):
        # nodes 0 and 1 are the roots before and after the first piece
        self.step, self.fail, self.popped = [{}, {}], [-1, -1], [0, 0]
        accepts = [False, False]
        parents = []
        for root, pieces in ((0, first), (1, inner)):
            for piece in pieces:
                node = root
                for byte in piece:
                    if byte not in self.step[node]:
                        self.step[node][byte] = len(self.step)
                        self.step.append({})
                        accepts.append(False)
                        parents.append((node, byte))
                    node = self.step[node][byte]
                if piece:
                    accepts[node] = True
        self.fail += [-1] * len(parents)
        self.popped += [0] * len(parents)
        if b"" in first:
            # a word may begin with a piece without bytes of it (the bare blank): what follows is cut as inner pieces
            self.fail[0], self.popped[0] = 1, 1
        level = [0, 1]
        while level:
            below = []
            for node in level:
                for byte, child in self.step[node].items():
                    below.append(child)
                    if accepts[child]:
                        self.fail[child], self.popped[child] = 1, 1
                        continue
                    at, count = self.fail[node], self.popped[node]
                    while at >= 0 and byte not in self.step[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.popped[child] = self.step[at][byte], count
            level = below

    def count(self, word: bytes) -> int:
        """Number of pieces; 0 if the word cannot be cut."""
        step, fail, popped = self.step, self.fail, self.popped
        node, count = 0, 0
        for byte in word:
            while (after := step[node].get(byte)) is None:
                count += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = after
        while node > 1:
            count += popped[node]
            node = fail[node]
        return count if node == 1 else 0


def byte_of_character() -> dict:
    """Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others for 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + i)] = b
    return out


def pieces_of_vocabulary(source: str) -> tuple:
    """(first, inner) pieces of a byte-level vocabulary file: those with a blank in front begin words, the bare blank as an empty piece."""
    to_byte, first, inner = byte_of_character(), [], []
    spec = json.loads(source)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    for piece in spec["model"]["vocab"]:
        if piece not in special:
            raw = bytes(to_byte[c] for c in piece)
            if raw[:1] == b" ":
                first.append(raw[1:])
            else:
                inner.append(raw)
    return first, inner


@functools.lru_cache(maxsize=2)
def automaton(source: str) -> tuple:
    """The automaton of a vocabulary file and a cache of word counts, once a worker."""
    return PieceAutomaton(*pieces_of_vocabulary(source)), {}


def count_pieces(docs: DataFrame, vocabulary_path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_words, n_pieces, n_unknown) of each document; an unknown word adds one piece."""
    source = docs.sparkSession.sparkContext.broadcast(tokenizer_source(vocabulary_path))

    def run(batches):
        machine, known = automaton(source.value)
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                words = spaced_words(text)
                new = {w for w in words if w not in known}
                if len(known) + len(new) > CACHE_WORDS:
                    known.clear()
                    new = set(words)
                for w in new:
                    known[w] = machine.count(w)
                counts = list(map(known.__getitem__, words))
                unknown = counts.count(0)
                rows.append((len(words), sum(counts) + unknown, unknown))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_words", "n_pieces", "n_unknown"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_pieces", "n_unknown")])
    return text_rows(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
