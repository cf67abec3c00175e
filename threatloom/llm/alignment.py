"""Alignment of two tokenizers over a corpus, each distinct text once.

Documents are shuffled by their full text, so that copies become one text with a multiplicity. A text is cut by
a byte-level tokenizer (A) and a piece tokenizer (B) into tokens that cover the same bytes. Every run of bytes
between two neighbouring token ends, of either, is one link: the A and the B token it lies in overlap. Ends that both
have cut the tokens into groups.

Texts of a task are gathered into blocks of a bounded number of links. A block numbers its distinct (A id, B id) pairs
and gives each the sum of the multiplicities of its texts that hold it; Spark adds these up by pair over all blocks,
finds each A id's highest count and sends (number, count, highest) back to the block, where the texts' measures
are sums over their links. So a pair is shuffled once a block and not once a text. Measures join the
documents by the SHA-256 of the text.

Defined results: a null or empty text, and one that a tokenizer does not give back byte for byte (with a blank in front),
has no tokens: its measures are 0 and ``groups_sha256`` is ''. Special tokens' names inside texts are ordinary text.
Repeated rows count as documents of their own and are all returned; a null id stays null; an empty table
gives no rows; other columns are not read.
"""

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from threatloom.llm.common import materialized, slices, texts_of
from threatloom.llm.tokens import MAX_SOURCE, Encoder, Pieces, tokenizer_source

# Bytes of text cut at once and links of a block: both bound memory only. Pieces that a worker remembers.
STEP_BYTES, BLOCK_LINKS, CACHE_PIECES = 1 << 20, 1 << 21, 200_000
BLANK = "▁"


def byte_of_character() -> dict:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenBytes:
    """Bytes of every id of a vocabulary in one array."""

    def __init__(self, tokens: list):
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def of(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        place = np.cumsum(n) - n
        return self.flat[np.repeat(self.start[ids] - place, n) + np.arange(int(n.sum()))]


class LevelEncoder(Encoder):
    """Ids of a byte-level tokenizer that takes special tokens' names as ordinary text."""

    def __init__(self, source: str):
        super().__init__(source)
        self.added = []
        self.tokenizer.encode_special_tokens = True
        vocabulary, value = json.loads(source)["model"]["vocab"], byte_of_character()
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        self.bytes = TokenBytes(tokens)


class PieceEncoder:
    """Ids of a piece tokenizer for texts with a blank in front.

    If no piece has a blank after another character, no piece crosses from a character to a blank, so texts are cut
    there and every distinct part is encoded by the library once; other models encode whole texts.
    """

    def __init__(self, model: bytes):
        self.model = SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_part = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.bytes = TokenBytes([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)])
        self.cache = Pieces(CACHE_PIECES)

    def encode(self, texts: list) -> tuple:
        """(ids of all texts one after the other, number of ids of each text); each text begins with a blank."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.by_part:
            ids = self.model.encode([t[1:].decode() for t in texts], num_threads=1)
            return np.concatenate([np.array(i, np.uint32) for i in ids]), np.array([len(i) for i in ids], np.int64)
        whole = b"".join(texts)
        raw = np.frombuffer(whole, np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        starts = np.zeros(len(raw), bool)
        starts[1:] = (raw[1:] == 0x20) & (raw[:-1] != 0x20)
        starts[np.concatenate([[0], ends[:-1]])] = True
        cuts = np.flatnonzero(starts)
        offsets = np.append(cuts, len(whole)).astype(np.int32)
        parts = pc.dictionary_encode(pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(whole)]))
        distinct = parts.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.cache.known]
        if len(self.cache.known) + len(new) > self.cache.room:
            self.cache, new = Pieces(max(CACHE_PIECES, len(distinct))), distinct
        found = self.model.encode([p[1:].decode() for p in new], num_threads=1) if new else []
        # a lone blank is the model's own; the library gives nothing for an empty text
        found = [i or [self.model.piece_to_id(BLANK)] for i in found]
        if found:
            upto = np.cumsum([len(i) for i in found])
            self.cache.learn(new, np.concatenate([np.array(i, np.uint32) for i in found]), np.append(0, upto[:-1]), upto)
        out, n = self.cache.view(distinct).gather(parts.indices.to_numpy())
        place = np.append(np.cumsum(n) - n, len(out))
        bounds = place[np.searchsorted(cuts, np.concatenate([[0], ends]))]
        return out, np.diff(bounds)


@functools.lru_cache(maxsize=1)
def encoders(source: str, model: bytes) -> tuple:
    """One pair of encoders a worker."""
    return LevelEncoder(source), PieceEncoder(model)


@functools.lru_cache(maxsize=1)
def id_texts(n_a: int, n_b: int) -> tuple:
    """Each id as decimal text with what follows it: inside a group and at its end."""
    a = np.array([f"{i}{c}" for c in ",|" for i in range(n_a)], object)
    b = np.array([f"{i}{c}" for c in ",;" for i in range(n_b)], object)
    return a, b


class Aligned:
    """Tokens, groups and links of some texts (each with a blank in front), as arrays over all of them.

    ``n_a``, ``n_b`` and ``n_groups`` have one entry a text (0 for texts without tokens); ``a`` and ``b`` are
    the ids of the links of all texts in order, ``owner`` the texts they belong to.
    """

    def __init__(self, texts: list, level: LevelEncoder, piece: PieceEncoder):
        (self.ids_a, n_a), (self.ids_b, n_b) = level.encode(texts), piece.encode(texts)
        ends_a, ends_b, size = self._same(texts, level, n_a, piece, n_b)
        upto = np.cumsum(size)
        last = np.isin(ends_a, ends_b, assume_unique=True)
        self.end_a, self.end_b = last, np.isin(ends_b, ends_a, assume_unique=True)
        text_of = lambda ends: np.searchsorted(upto, ends, side="right")
        count = lambda owner: np.bincount(owner, minlength=len(texts)).astype(np.int64)
        self.owner_a, self.owner_b = text_of(ends_a), text_of(ends_b)
        self.n_a, self.n_b, self.n_groups = count(self.owner_a), count(self.owner_b), count(self.owner_a[last])
        cuts = np.union1d(ends_a, ends_b)
        self.owner = text_of(cuts)
        self.a, self.b = self.ids_a[np.searchsorted(ends_a, cuts)], self.ids_b[np.searchsorted(ends_b, cuts)]
        self.vocabulary = len(level.bytes.size), len(piece.bytes.size)

    def _same(self, texts, level, n_a, piece, n_b):
        """Ends of the tokens as byte offsets; tokens of texts that are not given back go."""
        sizes = np.array([len(t) for t in texts], np.int64)
        good = sizes > 1
        for ids, n, encoder in ((self.ids_a, n_a, level), (self.ids_b, n_b, piece)):
            length = np.concatenate([[0], np.cumsum(encoder.bytes.size[ids])])
            bounds = length[np.concatenate([[0], np.cumsum(n)])]
            good &= np.diff(bounds) == sizes
            joined = encoder.bytes.of(ids).tobytes()
            for i in np.flatnonzero(good):
                good[i] = joined[bounds[i] : bounds[i + 1]] == texts[i]
        keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
        self.ids_a, self.ids_b = self.ids_a[keep_a], self.ids_b[keep_b]
        return np.cumsum(level.bytes.size[self.ids_a]) - 1, np.cumsum(piece.bytes.size[self.ids_b]) - 1, np.where(good, sizes, 0)

    def groups(self) -> list:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``."""
        text_a, text_b = id_texts(*self.vocabulary)
        # place of a token: all tokens of earlier groups, then A's of its own, then B's
        in_a, in_b = np.cumsum(self.end_a) - self.end_a, np.cumsum(self.end_b) - self.end_b
        first_b = np.searchsorted(in_b, np.arange(in_b[-1] + 1 if len(in_b) else 0))
        upto_a = np.searchsorted(in_a, np.arange(len(first_b)), side="right")
        out = np.empty(len(in_a) + len(in_b), object)
        out[np.arange(len(in_a)) + first_b[in_a]] = text_a[self.ids_a + self.end_a * np.int64(self.vocabulary[0])]
        out[np.arange(len(in_b)) + upto_a[in_b]] = text_b[self.ids_b + self.end_b * np.int64(self.vocabulary[1])]
        bounds, flat = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist(), out.tolist()
        return ["".join(flat[lo:hi])[:-1] for lo, hi in zip(bounds[:-1], bounds[1:])]


def distinct_texts(docs: DataFrame, text_col="text") -> DataFrame:
    """(digest, text, copies): each text once, null as empty; the shuffle is by the full text."""
    text = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    rows = docs.select(text.alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return rows.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text", "copies")


MEASURES = "block long, digest binary, n_a long, n_b long, n_groups long, n_links long, groups string, numbers binary, times binary, number int, pair long, weight long"


def align_blocks(texts: DataFrame, source: str, model: bytes, hashed: bool) -> DataFrame:
    """Rows of texts (``digest`` set) and of their blocks' pairs (``pair`` set), see ``MEASURES``."""
    schema = T._parse_datatype_string(MEASURES)
    arrow = {"binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def batch_of(n, **columns):
        full = [columns.get(f.name, pa.nulls(n, arrow[f.dataType.simpleString()])) for f in schema]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, arrow[f.dataType.simpleString()]) for f, c in zip(schema, full)], names=schema.names)

    def block(number, some):
        """One block of texts: pairs get numbers by their order."""
        codes = np.concatenate([np.concatenate([pairs for pairs, *_ in some]), np.zeros(0, np.int64)])
        distinct = np.unique(codes)
        weight = np.zeros(len(distinct), np.int64)
        numbers = []
        for pairs, copies, *_ in some:
            at = np.searchsorted(distinct, pairs)
            weight[at] += copies
            numbers.append(np.diff(at, prepend=0).astype(np.uint32).tobytes())
        columns = dict(zip(("digest", "n_a", "n_b", "n_groups", "n_links", "groups", "times"), zip(*(s[2:] for s in some))))
        n = len(some)
        yield batch_of(n, block=np.full(n, number), numbers=numbers, **{k: list(v) for k, v in columns.items()})
        for lo in range(0, len(distinct), 1 << 16):
            own = distinct[lo : lo + (1 << 16)]
            yield batch_of(len(own), block=np.full(len(own), number), number=np.arange(lo, lo + len(own), dtype=np.int32), pair=own, weight=weight[lo : lo + (1 << 16)])

    def run(batches):
        level, piece = encoders(source, model)
        number, some, links = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            digests, copies = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = [b" " + t for t in texts_of(batch)]
            for lo, hi in slices([len(t) for t in texts], STEP_BYTES):
                al = Aligned(texts[lo:hi], level, piece)
                n_links = np.bincount(al.owner, minlength=hi - lo)
                groups = [(hashlib.sha256(g.encode()).hexdigest() if g else "") if hashed else g for g in al.groups()]
                code = al.a.astype(np.int64) << 32 | al.b.astype(np.int64)
                at = np.concatenate([[0], np.cumsum(n_links)])
                for i in range(hi - lo):
                    pairs, times = np.unique(code[at[i] : at[i + 1]], return_counts=True)
                    some.append((pairs, copies[lo + i], digests[lo + i], al.n_a[i], al.n_b[i], al.n_groups[i], n_links[i], groups[i], times.astype(np.uint32).tobytes()))
                    links += int(n_links[i]) + 1
                    if links >= BLOCK_LINKS:
                        yield from block(number, some)
                        number, some, links = number + 1, [], 0
        if some:
            yield from block(number, some)

    return texts.mapInArrow(run, schema)


def corpus_pairs(blocks: DataFrame) -> DataFrame:
    """(a_id, b_id, pair, documents, best): documents that hold a pair linked, and whether that is its A id's highest."""
    counted = blocks.where("pair is not null").groupBy("pair").agg(F.sum("weight").alias("documents"))
    counted = materialized(counted.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b_id"), "pair", "documents"))
    # one row an A id: as many as the vocabulary has, so the broadcast has a bound
    highest = counted.groupBy("a_id").agg(F.max("documents").alias("highest"))
    return counted.join(F.broadcast(highest), "a_id").select("a_id", "b_id", "pair", "documents", (F.col("documents") == F.col("highest")).alias("best"))


def text_measures(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(digest, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each distinct text."""
    back = blocks.where("pair is not null").select(F.col("block").alias("home"), "number", "pair")
    back = back.join(pairs.select("pair", "documents", "best"), "pair").select("home", "number", "documents", "best")
    texts = blocks.where("digest is not null").select("block", "digest", "n_a", "n_b", "n_groups", "n_links", "groups", "numbers", "times")

    def run(texts, pairs):
        documents, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        number = pairs.column("number").to_numpy()
        documents[number] = pairs.column("documents").to_numpy()
        best[number] = pairs.column("best").to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for numbers, times in zip(texts.column("numbers").to_pylist(), texts.column("times").to_pylist()):
            at, times = np.cumsum(np.frombuffer(numbers, np.uint32), dtype=np.int64), np.frombuffer(times, np.uint32).astype(np.int64)
            n_best.append(int(best[at] @ times))
            count_sum.append(int(documents[at] @ times))
        out = texts.select(["digest", "n_a", "n_b", "n_groups", "n_links", "groups"])
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    schema = "digest binary, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    return texts.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(run, schema)


def model_bytes(path: str) -> bytes:
    """A piece tokenizer's file. A vocabulary is a small fixed file; larger ones are refused."""
    with open(path, "rb") as f:
        model = f.read(MAX_SOURCE + 1)
    if len(model) > MAX_SOURCE:
        raise ValueError(f"{path} is larger than {MAX_SOURCE} bytes")
    return model


def align(docs: DataFrame, level_path: str, piece_path: str, id_col="doc_id", text_col="text", hashed=False) -> tuple:
    """(measures of each document, corpus-wide pairs).

    Measures are (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups); ``groups`` is the alignment as text, or
    its SHA-256 if ``hashed``. Pairs are (a_id, b_id, documents, best).
    """
    made = align_blocks(distinct_texts(docs, text_col), tokenizer_source(level_path), model_bytes(piece_path), hashed)
    blocks = materialized(made)
    pairs = materialized(corpus_pairs(blocks))
    measures = materialized(text_measures(blocks, pairs))
    text = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    rows = docs.select(docs[id_col].alias("id"), F.unhex(F.sha2(text, 256)).alias("digest")).join(measures, "digest")
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    return rows.select(F.col("id").alias(id_col), *columns), pairs.drop("pair")
