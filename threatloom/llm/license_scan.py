"""License scan by diagonal voting.

All rolling word k-grams of a text are hashed and joined to the places where they stand in license
templates. A vote lies on the diagonal (place in the text - place in the template); votes are
added up by diagonal, neighbouring diagonals are merged (inserted or missing words move a match by a
few), and a merged span is verified: its words, compared as text, must cover enough of the template.
A template with fewer words than ``k`` is one gram, so a short phrase is found exactly.

The bit table that tells which grams are worth sending to the join has a bounded size.

Defined results: a null text has no words; overlapping and repeated places all count; repeated
documents are answered row by row; an empty table gives no rows; other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.common import alnum_words, materialized, text_rows, texts_of
from threatloom.llm.decontam import bit_table, shingles_of, wanted_places, word_hash
from threatloom.operators.pairs import broadcast_if_small

# Phrases that always count, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public license notices, for labels with a version or variant.
NOTICES = {
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-3.0-or-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-4.0": "licensed under cc by 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-nd-4.0": "licensed under cc by nd 4 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights-reserved": "all rights reserved",
}


def license_templates(spark: SparkSession) -> DataFrame:
    """(label, text, exact): the phrases and notices above. An exact one must stand word by word."""
    rows = [(label, text, True) for text, label in PHRASES.items()] + [(label, text, False) for label, text in NOTICES.items()]
    return spark.createDataFrame(rows, "label string, text string, exact boolean")


def template_grams(templates: DataFrame, k: int) -> DataFrame:
    """(template, label, exact, n, g, pos, gram): every gram of every template, with its words."""

    def run(batches):
        for batch in batches:
            out = []
            for label, text, exact in zip(batch.column(1).to_pylist(), texts_of(batch), batch.column(2).to_pylist()):
                words = alnum_words(text)
                size = min(k, len(words))
                if size:
                    grams = shingles_of(word_hash(words), size).view(np.int64).tolist()
                    out += [{"label": label, "exact": exact, "n": len(words), "size": size, "g": g, "pos": i, "gram": b" ".join(words[i : i + size]).decode(), "template": b" ".join(words).decode()} for i, g in enumerate(grams)]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([("template", pa.string()), ("label", pa.string()), ("exact", pa.bool_()), ("n", pa.int32()), ("size", pa.int32()), ("g", pa.int64()), ("pos", pa.int32()), ("gram", pa.string())])
    source = templates.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), "label", "exact")
    return source.mapInArrow(run, "template string, label string, exact boolean, n int, size int, g long, pos int, gram string")


def license_spans(docs: DataFrame, templates: DataFrame = None, id_col="doc_id", text_col="text", k=4, slack=3, share=0.8) -> tuple:
    """(row, id, n_words) of all documents, and their verified spans.

    Spans: (row, label, template, exact, first, end, votes, score), words from 0, end exclusive. Diagonals at
    most ``slack`` words apart are merged; ``score`` is the share of the template's words that are covered. Copies in
    a row are matches of their own; a merged group that grows beyond twice a template is cut, and its parts may overlap.
    """
    spark = docs.sparkSession
    grams = materialized(template_grams(license_templates(spark) if templates is None else templates, k))
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())
    table = spark.sparkContext.broadcast(bit_table(grams.select("g")))

    def run(batches):
        bits = table.value
        for batch in batches:
            n_words, places = [], []
            for text in texts_of(batch):
                words = alnum_words(text)
                n_words.append(len(words))
                own = []
                for size, (at, hashes) in wanted_places(bits, words, sizes).items():
                    for p, g in zip(at.tolist(), hashes.view(np.int64).tolist()):
                        own.append({"g": g, "p": p, "gram": b" ".join(words[p : p + size]).decode()})
                places.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(places, arrow)], names=["id", "n_words", "places"])

    arrow = pa.list_(pa.struct([("g", pa.int64()), ("p", pa.int32()), ("gram", pa.string())]))
    place = T.StructType([T.StructField("g", T.LongType()), T.StructField("p", T.IntegerType()), T.StructField("gram", T.StringType())])
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(place))])
    found = materialized(text_rows(docs, id_col, text_col).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    places = found.where(F.size("places") > 0).select("row", F.explode("places").alias("x")).select("row", "x.*")
    votes = places.join(broadcast_if_small(grams.withColumnRenamed("gram", "text")), "g").where("gram = text")
    key = ["row", "label", "template", "exact", "n", "size"]
    diagonals = votes.withColumn("diagonal", F.col("p") - F.col("pos")).groupBy(*key, "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.min("p").alias("first"), (F.max("p") + F.col("size")).alias("end"), F.collect_set("pos").alias("places")
    )
    # the next copy of a template stands its length or more away, so diagonals that far apart are never one match
    near = F.when(F.col("exact"), 0).otherwise(F.least(F.lit(slack), F.col("n") - 1))
    in_order = Window.partitionBy(*key).orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(in_order) <= near, 0).otherwise(1)
    merged = diagonals.withColumn("apart", apart).withColumn("match", F.sum("apart").over(in_order))
    whole = Window.partitionBy(*key, "match")
    drift = F.col("diagonal") - F.min("diagonal").over(whole)
    long = F.max("diagonal").over(whole) - F.min("diagonal").over(whole) > F.col("n")
    # a group that drifts over more than a template is cut at every template's length, on two grids half of that apart
    cut = lambda shift: F.struct(F.lit(shift).alias("grid"), F.floor((drift + shift * F.ceil(F.col("n") / 2)) / F.col("n")).alias("part"))
    merged = merged.withColumn("cuts", F.when(long, F.array(cut(0), cut(1))).otherwise(F.array(F.struct(F.lit(0).alias("grid"), F.lit(0).cast("long").alias("part")))))
    spans = merged.withColumn("cut", F.explode("cuts")).groupBy(*key, "match", "cut").agg(
        F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("end").alias("end"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("size") - 1)))))
    spans = spans.withColumn("score", covered / F.col("n")).where((F.col("score") >= F.when(F.col("exact"), 1.0).otherwise(share)))
    spans = spans.dropDuplicates([*key, "first", "end"])
    return found.select("row", "id", "n_words"), spans.select("row", "label", "template", "exact", "first", "end", "votes", "score")


def scan_licenses(docs: DataFrame, templates: DataFrame = None, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each document."""
    rows, spans = license_spans(docs, templates, id_col, text_col, **options)
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.collect_list(c))), ",")
    base = F.when(F.col("exact"), F.col("first"))
    of_row = spans.groupBy("row").agg(
        F.count(base).alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        names(F.when(F.col("exact"), F.col("label"))).alias("base_labels"),
        names("label").alias("labels"),
        F.max("score").alias("score"),
    )
    joined = rows.join(of_row, "row", "left").drop("row").withColumnRenamed("id", id_col)
    return joined.fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0})
