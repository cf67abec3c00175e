"""The pipeline and its queries."""

import glob
import os

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from oracle_check import rows_of
from test_scans import near_copies, plain_contamination, plain_measures
from test_simhash import similarity
from test_tokens import check_packing, ids
from threatloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_queries_cover_the_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_one_after_the_other(spark, documents, texts, tokenizer):
    """Each stage against a plain run on its own input."""
    from threatloom.llm.common import new_folder

    bench = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        folder = new_folder(spark, "stage")
        stage(spark, docs, FOLDER).write.parquet(folder)
        docs = spark.read.parquet(folder)
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else docs.collect())
        if name != "packing":
            assert docs.columns == documents.columns
            assert docs.where("n_chars <> length(text)").count() == 0
    clean, single, safe, hidden, pieces = seen
    for key, text in texts.items():
        n, *_, repeated = plain_measures(text)
        if n < 10 or 100 * repeated > 20 * n:
            assert key not in clean
        elif key in clean:
            assert set(clean[key].split("\n")) <= set(text.split("\n"))
    assert len(clean) > 0.5 * len(texts)
    keys = sorted(single)
    near = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if similarity(single[a], single[b]) >= 0.85]
    assert not near and len(set(single.values())) == len(single)
    for key in set(clean) - set(single):
        assert any(similarity(clean[key], clean[k]) >= 0.6 for k in clean if k != key)
    leaked = {r[0] for r in plain_contamination(list(single.items()), bench) if r[5]}
    assert set(safe) == set(single) - leaked
    assert set(hidden) == set(safe)
    for key, text in hidden.items():
        assert (text == safe[key]) == ("[secret]" not in text)
    library = Tokenizer.from_file(tokenizer)
    check_packing(pieces, [(k, ids(library, t) + [0]) for k, t in hidden.items()])


def test_pipeline_edges(spark, plain_docs):
    for docs in (plain_docs, plain_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            if name != "packing":
                assert out.columns == plain_docs.columns
                docs = spark.createDataFrame(out.collect(), plain_docs.schema)
        out.collect()


def test_one_of_a_group_of_near_copies_comes_through(spark):
    """A hot host with a group of near copies: the first two stages keep exactly one of them and all others."""
    rows = near_copies(60, "hot", 1000)
    rows += [(i, "\n".join(" ".join(f"w{i}x{j}y{k}" for k in range(9)) for j in range(4)), "hot" if i % 3 else None, 0) for i in range(90)]
    docs = spark.createDataFrame([(k, t, "en", h, len(t)) for k, t, h, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
    assert sorted(r["doc_id"] for r in docs.collect()) == [*range(90), 1000]
