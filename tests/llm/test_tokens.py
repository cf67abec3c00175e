"""Token ids of batches against the library, packing, and the token store."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from threatloom.llm import packing, token_store
from threatloom.llm.common import new_folder
from threatloom.llm.tokens import Encoder, tokenizer_source

PARTS = ["'s", "'t", "'re", "'ll", "'", "''", " ", "  ", "\n", "\t", "a", "b", "é", "日", "1", "²", "!", ".", "\xa0", " ", "\x85", "'S", "'ve", "'d", "\r\n", "\U0001F600", "́", "_", "\x00", "\x1c", "​", "<|endoftext|>", "Ᲊ"]


@pytest.fixture(scope="module")
def library(tokenizer):
    return Tokenizer.from_file(tokenizer)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(numbers):
    return zlib.crc32(np.array(numbers, "<u4").tobytes())


def test_batches_equal_the_library(tokenizer, library, texts):
    pick = random.Random(1)
    some = ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 30))) for _ in range(4000)] + list(texts.values())[:60]
    flat, counts = Encoder(tokenizer_source(tokenizer)).encode([t.encode() for t in some])
    got = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    assert got == [ids(library, t) for t in some]


def test_first_fit_decreasing_equals_the_plain_loop():
    draw = np.random.default_rng(3)
    for n in (1, 2, 7, 300):
        sizes = draw.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room, want = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            at = next((b for b, free in enumerate(room) if free >= sizes[i]), None)
            if at is None:
                room.append(100)
                at = len(room) - 1
            want[i] = (at, 100 - room[at])
            room[at] -= sizes[i]
        assert [(b, o) for b, o in zip(bins, offsets)] == [want[i] for i in range(n)]


def check_packing(rows, token_lists, capacity=1024):
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"], r["doc_tokens"]].append(r)
    for pieces in sequences.values():
        upto = 0
        for offset, length in sorted(pieces):
            assert offset == upto and length > 0
            upto += length
        assert upto <= capacity
    want = defaultdict(int)
    for key, tokens in token_lists:
        want[key, len(tokens)] += 1
        for r in documents[key, len(tokens)]:
            assert r["ids_crc32"] == crc(tokens[r["start"] : r["start"] + r["length"]])
    for (key, n), times in want.items():
        spans = sorted((r["start"], r["length"]) for r in documents[key, n])
        assert sum(x for _, x in spans) == n * times
        assert sorted(set(spans)) == [(s, min(capacity, n - s)) for s in range(0, n, capacity)]
    assert len(documents) == len(want)
    return sequences


def test_packing_holds_every_token_once(documents, texts, tokenizer, library):
    rows = packing.pack_documents(documents, tokenizer, group_docs=80).collect()
    sequences = check_packing(rows, [(k, ids(library, t) + [0]) for k, t in texts.items()])
    total = sum(r["length"] for r in rows)
    assert total / (1024 * len(sequences)) > 0.95


def test_packing_edges(edge_docs, no_docs, tokenizer, library):
    rows = packing.pack_documents(edge_docs, tokenizer).collect()
    check_packing(rows, [(r["doc_id"], ids(library, r["text"]) + [0]) for r in edge_docs.collect()])
    assert packing.pack_documents(no_docs, tokenizer).collect() == []


def expected_store(library, rows, end=2):
    start, out = 0, []
    for key, text in rows:
        tokens = ids(library, text) + [end]
        out.append((key, start, len(tokens), crc(tokens)))
        start += len(tokens)
    return out


def test_store_round_trip(spark, documents, texts, tokenizer, library):
    folder = new_folder(spark, "store")
    token_store.write_token_store(documents, folder, tokenizer)
    got = sorted(tuple(r) for r in token_store.read_token_store(spark, folder).collect())
    assert got == expected_store(library, sorted(texts.items()))
    some = sorted(texts)[5:50:11]
    read = {r["id"]: r["tokens"] for r in token_store.read_documents(spark, folder, some).collect()}
    assert read == {k: ids(library, texts[k]) + [2] for k in some}
    assert spark.read.parquet(f"{folder}/dictionary").first()["sha256"] == spark.read.parquet(f"{folder}/chunks").first()["dictionary_sha256"]


def test_store_edges(spark, edge_docs, no_docs, tokenizer, library):
    folder = new_folder(spark, "store")
    token_store.write_token_store(edge_docs, folder, tokenizer)
    got = token_store.read_token_store(spark, folder).orderBy("start").collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in edge_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [tuple(r) for r in got] == expected_store(library, rows)
    folder = new_folder(spark, "store")
    token_store.write_token_store(no_docs, folder, tokenizer)
    assert token_store.read_token_store(spark, folder).collect() == []


def test_a_store_refuses_another_dictionary(spark, documents, tokenizer):
    folder = new_folder(spark, "store")
    token_store.write_token_store(documents, folder, tokenizer)
    spark.createDataFrame([(bytearray(b"other"), "0", "<u2", 2)], "data binary, sha256 string, width string, end_id long").write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(Exception, match="do not belong together"):
        token_store.read_token_store(spark, folder).collect()
