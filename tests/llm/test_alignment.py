"""Alignment of two tokenizers against a plain pairwise run with the libraries."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from threatloom.llm import alignment

LEVEL, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

# characters of byte-level vocabularies, built the other way round than in the code under test
TO_BYTE, at = {}, 256
for byte in range(256):
    if 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or byte >= 0xAE:
        TO_BYTE[chr(byte)] = byte
    else:
        TO_BYTE[chr(at)], at = byte, at + 1


def plain_tokens(texts):
    level = Tokenizer.from_file(LEVEL)
    level.encode_special_tokens = True
    piece = SentencePieceProcessor(model_file=PIECE)
    for text in texts:
        a = level.encode(" " + text, add_special_tokens=False).ids if text else []
        b = piece.encode(text) if text else []
        bytes_a = [bytes(TO_BYTE[c] for c in level.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if piece.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, piece.id_to_piece(i)) for i in b)]
        whole = (" " + text).encode() if text else b""
        yield ([], []) if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole else (list(zip(a, bytes_a)), list(zip(b, bytes_b)))


def spans(tokens):
    out, at = [], 0
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def plain_alignment(rows):
    """All overlapping pairs by comparing every A token with every B token of a group."""
    per, count = [], Counter()
    for (key, text), (a, b) in zip(rows, plain_tokens([t or "" for _, t in rows])):
        a, b = spans(a), spans(b)
        both = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, links, low = [], [], 0
        ia = ib = 0
        for high in both:
            ga, gb = [], []
            while ia < len(a) and a[ia][2] <= high:
                ga.append(a[ia])
                ia += 1
            while ib < len(b) and b[ib][2] <= high:
                gb.append(b[ib])
                ib += 1
            groups.append(",".join(str(x[0]) for x in ga) + "|" + ",".join(str(x[0]) for x in gb))
            links += [(x[0], y[0]) for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
        per.append((key, len(a), len(b), groups, links))
        count.update(set(links))
    top = {}
    for (a, _), c in count.items():
        top[a] = max(top.get(a, 0), c)
    out = []
    for key, n_a, n_b, groups, links in per:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((key, n_a, n_b, len(groups), len(links), sum(count[l] == top[l[0]] for l in links), sum(count[l] for l in links), digest))
    return sorted(out, key=repr), count, top


def check(spark, df, rows):
    got, pairs = alignment.align(df, LEVEL, PIECE, hashed=True)
    want, count, top = plain_alignment(rows)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sorted(map(tuple, pairs.collect())) == sorted((a, b, c, c == top[a]) for (a, b), c in count.items())


def test_given_table(spark, documents, texts):
    check(spark, documents, list(texts.items()))


ODD = ["  two  blanks ", " ", "\n\n", "tab\there", "a▁b", "<|endoftext|> and <s> </s> <unk>", "\x00zero", "日本語 \U0001F600 é ﬁ", "x" * 5000, "a\r\n b", " nbsp", "\U0001fae8 newer", "don't  'll"]


@pytest.mark.parametrize("block_links", [1 << 21, 50])
def test_edges(spark, edge_docs, no_docs, monkeypatch, block_links):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", block_links)
    check(spark, edge_docs, [(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    rows = list(enumerate(ODD)) + [(100 + i, t) for i, t in enumerate(ODD[:5] * 3)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)
    for made in alignment.align(no_docs, LEVEL, PIECE):
        assert made.collect() == []


def test_groups_as_text(spark):
    got, pairs = alignment.align(spark.createDataFrame([(1, "tokenizers differ"), (2, None)], "doc_id long, text string"), LEVEL, PIECE)
    groups = {r["doc_id"]: r["groups"] for r in got.collect()}
    (a, b), = plain_tokens(["tokenizers differ"])
    assert groups[2] == ""
    assert [int(i) for g in groups[1].split(";") for i in g.split("|")[0].split(",")] == [i for i, _ in a]
    assert [int(i) for g in groups[1].split(";") for i in g.split("|")[1].split(",")] == [i for i, _ in b]


def test_parts_are_encoded_like_whole_texts(texts):
    with open(PIECE, "rb") as f:
        own = alignment.PieceEncoder(f.read())
    assert own.by_part
    some = [" " + t for t in [*texts.values(), *ODD] if t]
    ids, n = own.encode([t.encode() for t in some])
    library = SentencePieceProcessor(model_file=PIECE).encode([t[1:] for t in some])
    assert n.tolist() == [len(i) for i in library] and ids.tolist() == [i for x in library for i in x]
