"""License scans by diagonal voting.

Every rolling two-word hash of every text is joined, in Spark, with the positions of the templates' two-word hashes. A
hit votes for a diagonal: place in the text less place in the template. Votes are summed by document, template and
diagonal; diagonals next to each other are merged, so that a few words more or less do no harm; the spans found are
verified word by word against the template.

Phrases must stand whole: all their hashes on one diagonal. Notices, longer texts, must be covered to ``COVER``. Words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Null counts as empty; a text without hits has
counts 0, no places, empty labels and score 0. Rows are told apart by their place, so repeated rows count by themselves.
The templates have a fixed size, whatever the data, and are broadcast.
"""
from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbstream.llm.common import bloom_of, input_rows, record, stage
from curbstream.llm.words import word_slices

#: Phrases of the base labels.
BASE = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]
#: Further phrases, and notices of which most words must stand.
PHRASES = [("cc-by-nc", "cc by nc"), ("cc-by-sa", "cc by sa"), ("cc-by-nd", "cc by nd"), ("cc0", "cc0 1 0"), ("lgpl", "gnu lesser general public license"), ("agpl", "gnu affero general public license"), ("mpl", "mozilla public license"), ("bsd", "bsd license"), ("bsd", "3 clause bsd"), ("epl", "eclipse public license"), ("isc", "isc license"), ("unlicense", "the unlicense"), ("public-domain", "public domain dedication"), ("all-rights-reserved", "all rights reserved")]
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
]
COVER, NEAR, LEAST_VOTES = 0.8, 4, 3

BETWEEN = np.zeros(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):  # A-Z are lower-cased first
    BETWEEN[_lo : _hi + 1] = True
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text: str) -> list[str]:
    return [w.translate(_UPPER) for w in _WORD.findall(text)]


def pair_hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]]:
    """Per slice: document, place and hash of every two consecutive words; first document, and each document's words."""
    for lo, _, w in word_slices(column, space=BETWEEN):
        g, at = w.windows(w.hashes(5, lower=True), 2)
        doc = w.docs(at)
        yield lo + doc, at - w.first[doc], g.view(np.int64), lo, w.counts


def templates() -> list[tuple[int, str, str, list[str]]]:
    """Number, kind, label and words of each template."""
    kinds = [("base", BASE), ("phrase", PHRASES), ("notice", NOTICES)]
    return [(i, kind, label, text.split()) for i, (kind, label, text) in enumerate((k, lab, t) for k, rows in kinds for lab, t in rows)]


def _template_rows() -> list[tuple[int, int, int]]:
    out = []
    for i, _, _, w in templates():
        for _, at, g, _, _ in pair_hashes(pa.array([" ".join(w)])):
            out += [(int(h), i, int(p)) for h, p in zip(g, at, strict=True)]
    return out


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (place -1, its number of words, id and text hash), and one for every two words."""
    names = ["row", "place", "value", "doc_id", "th"]
    for b in batches:
        rows, ids, th = b.column("row").to_numpy(), b.column("doc_id"), b.column("th")
        for doc, at, g, lo, n in pair_hashes(b.column("text")):
            yield record(names, pa.array(rows[lo : lo + len(n)]), pa.array(np.full(len(n), -1, np.int32)), pa.array(n.astype(np.int64)), ids.slice(lo, len(n)), th.slice(lo, len(n)))
            none = pa.nulls(len(g), pa.int64())
            yield record(names, pa.array(rows[doc]), pa.array(at.astype(np.int32)), pa.array(g), none, none)


def candidate_spans(hits: DataFrame) -> DataFrame:
    """row, template, start, votes, end: whole phrases, and merged diagonals of notices with enough votes."""
    t = templates()
    pairs = F.create_map(*[F.lit(v) for i, _, _, w in t for v in (i, len(w) - 1)])
    notice = F.col("template") >= min(i for i, kind, _, _ in t if kind == "notice")
    votes = hits.where("template is not null").groupBy("row", "template", "diagonal").agg(F.count("*").alias("votes"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    phrases = votes.where(~notice & (F.col("votes") == pairs[F.col("template")])).select("row", "template", F.col("diagonal").alias("start"), "votes", (F.col("hi") + 2).alias("end"))
    # Diagonals of one notice at most NEAR apart are one span.
    by = W.partitionBy("row", "template").orderBy("diagonal")
    some = votes.where(notice & (F.col("votes") >= LEAST_VOTES))
    some = some.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(by) > NEAR).cast("int"))
    some = some.withColumn("span", F.sum(F.coalesce("new", F.lit(1))).over(by.rowsBetween(W.unboundedPreceding, 0)))
    merged = some.groupBy("row", "template", "span").agg(F.sum("votes").alias("votes"), F.min("lo").alias("start"), (F.max("hi") + 2).alias("end"))
    merged = merged.where(F.col("votes") >= (COVER - 0.3) * pairs[F.col("template")]).select("row", "template", "start", "votes", "end")
    return phrases.unionByName(merged)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate spans with their texts to how much of the template stands there, word by word."""
    t = templates()
    for b in batches:
        cover = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            w = words_of(text)
            found = []
            for s in spans:
                want, have = t[s["template"]][3], w[s["start"] : s["end"]]
                same = 1.0 if want == have else sum(m.size for m in difflib.SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks()) / len(want)
                found.append(s | {"cover": same})
            cover.append(found)
        kind = pa.list_(pa.struct([("template", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("cover", pa.float64())]))
        yield record(["row", "spans"], b.column("row"), pa.array(cover, kind))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    t = templates()
    table = docs.sparkSession.createDataFrame(_template_rows(), "value bigint, template int, at int")
    rows = input_rows(docs, doc_id, text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    grams = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_grams, "row bigint, place int, value bigint, doc_id bigint, th bigint")
    g = grams.alias("g").join(F.broadcast(table).alias("t"), (F.col("g.value") == F.col("t.value")) & (F.col("place") >= 0), "left")
    head = F.col("place") < 0
    hits = stage(g.where(head | F.col("template").isNotNull()).select("row", "place", "template", (F.col("place") - F.col("at")).alias("diagonal"), F.when(head, F.col("g.value")).alias("n_words"), "doc_id", "th"), "license-hits")
    heads = hits.where("place < 0").select("row", "doc_id", "th", "n_words")
    # The texts of documents with a candidate, found by a filter of fixed size and joined by id and text hash.
    spans = stage(candidate_spans(hits.where("place >= 0")).groupBy("row").agg(F.collect_list(F.struct("template", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("spans")).join(heads, "row"), "license-spans")
    some = bloom_of(spans, "th")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(some.has(b.column("th").to_numpy())))

    texts = rows.select("th", "doc_id", "text").mapInArrow(keep, "th bigint, doc_id bigint, text string").dropDuplicates(["th", "doc_id"])
    s, x = spans.select("row", "doc_id", "th", "spans").alias("s"), texts.alias("x")
    checked = s.join(x, (F.col("s.th") == F.col("x.th")) & F.col("s.doc_id").eqNullSafe(F.col("x.doc_id"))).select("row", "text", "spans").mapInArrow(_verify, "row bigint, spans array<struct<template:int,start:int,end:int,cover:double>>")
    label = F.create_map(*[F.lit(v) for i, _, name, _ in t for v in (i, name)])
    bases = len(BASE)
    out = heads.join(checked, "row", "left").withColumn("spans", F.filter(F.coalesce("spans", F.array().cast("array<struct<template:int,start:int,end:int,cover:double>>")), lambda z: z["cover"] >= F.when(z["template"] < bases + len(PHRASES), 1.0).otherwise(COVER)))
    out = out.withColumn("base", F.filter("spans", lambda z: z["template"] < bases))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda z: label[z["template"]]))), ",")
    places = F.transform("base", lambda z: z["start"].cast("bigint"))
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        names(F.col("base")).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda z: z["cover"])), F.lit(0.0)).alias("score"),
        F.transform("spans", lambda z: F.struct(label[z["template"]].alias("label"), z["start"].alias("start"), z["end"].alias("end"))).alias("found"),
    )
