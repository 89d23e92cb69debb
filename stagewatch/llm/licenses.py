"""Licence notices by an exact set-similarity join of text blocks with notice templates.

A block contains a template when it holds at least ``CONTAINMENT`` of the template's distinct
words. Blocks are runs of lines without a blank one between them, a single line, two lines
or a whole paragraph: a paragraph holds the words of every run inside it, so what any of them
contains the paragraph contains, and paragraphs alone are joined. Words are put in one global order, rarest in the corpus
first. Two sets that share ``need`` words share one among the first ``size - need + 1`` of
each, which gives the join key; blocks that are too short (length filter) and meetings
after which too few words are left (positional filter) go before the sets are compared.
Only words of templates matter for a containment, so a block is its words among these.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, stored

CONTAINMENT = 0.9
MAX_VOCABULARY = 20_000  # distinct words of all templates; more raise an error

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Fixed values: (label, notice).
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("cc-by", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, "
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())  # bytes.lower(): A-Z only


def _scan(batches: Iterator[pa.RecordBatch], phrases, vocabulary: dict[bytes, int], least: int) -> Iterator[pa.RecordBatch]:
    firsts: dict[bytes, list] = {}
    for words, label in phrases:
        firsts.setdefault(words[0], []).append((words, label))
    starts, known = frozenset(firsts), frozenset(vocabulary)
    for b in batches:
        out: list[list] = [[] for _ in range(7)]
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            lines = text.as_py().encode("utf-8", "surrogatepass").lower().split(b"\n")
            words, blocks, paragraph = [], [], set()
            for line in [*lines, b""]:
                own = _WORD.findall(line)
                words += own
                if line.strip():
                    paragraph |= known.intersection(own)
                else:
                    if len(paragraph) >= least:
                        blocks.append(paragraph)
                    paragraph = set()
            at, labels = [], set()
            if not starts.isdisjoint(words):
                for i, w in enumerate(words):
                    if w in starts:
                        for phrase, label in firsts[w]:
                            if words[i:i + len(phrase)] == phrase:
                                at.append(i)
                                labels.add(label)
            for c, v in zip(out, (doc_id, len(words), len(at), min(at, default=None), max(at, default=None), sorted(labels),
                                  [[vocabulary[w] for w in s] for s in blocks])):
                c.append(v)
        kinds = (*[pa.int64()] * 5, pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                         ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"])


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is 1 with a phrase, else the largest containment that reached the threshold, else 0.
    A null text is an empty one, without words. A text is one list of words in memory, however long;
    a text without blank lines is one block. Null and repeated doc_ids are rows like any
    other. No rows give no rows; other columns are ignored."""
    spark = docs.sparkSession
    sets = [(label, frozenset(words_of(text))) for label, text in templates]
    sets = [(label, s, max(1, math.ceil(containment * len(s) - 1e-9))) for label, s in sets if s]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*[s for _, s, _ in sets])))}
    if len(vocabulary) > MAX_VOCABULARY:
        raise ValueError(f"the templates have more than {MAX_VOCABULARY} words")
    least = min([need for _, _, need in sets], default=len(vocabulary) + 1)
    split = [(words_of(p), label) for p, label in phrases]
    scanned = stored(id_and_text(docs).mapInArrow(
        lambda it: _scan(it, split, vocabulary, least),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, "
        "blocks array<array<int>>").withColumn("row", F.monotonically_increasing_id()), "licenses")
    blocks = scanned.select("row", F.posexplode("blocks").alias("block", "words"))

    # The global order: as many numbers as the templates have words, wherever they come from.
    seen = {r["w"]: r["n"] for r in blocks.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = sorted(range(len(vocabulary)), key=lambda w: (seen.get(w, 0), w))
    rank = {w: r for r, w in enumerate(order)}
    prefixes, whole = [], []
    for t, (label, s, need) in enumerate(sets):
        own = sorted(rank[vocabulary[w]] for w in s)
        whole.append((t, label, own))
        prefixes += [(r, t, need, len(own), i) for i, r in enumerate(own[:len(own) - need + 1])]
    prefix = spark.createDataFrame(prefixes, "rank int, template int, need int, size int, i int")
    full = spark.createDataFrame(whole, "template int, label string, own array<int>")
    ranks = F.array(*[F.lit(rank[w]) for w in range(len(vocabulary))])
    ordered = blocks.select("row", "block", F.array_sort(F.transform("words", lambda w: F.get(ranks, w))).alias("words"))
    met = (ordered.select("row", "block", "words", F.posexplode("words").alias("j", "rank"))
           .join(F.broadcast(prefix), "rank")  # at most MAX_VOCABULARY words a template
           .where("size(words) >= need and j <= size(words) - need and 1 + least(size - i - 1, size(words) - j - 1) >= need"))
    held = (met.join(F.broadcast(full), "template")
            .withColumn("both", F.size(F.array_intersect("words", "own"))).where("both >= need")
            .groupBy("row").agg(F.collect_set("label").alias("held"), F.max(F.col("both") / F.col("size")).alias("best")))
    out = scanned.drop("blocks").join(held, "row", "left")
    none = F.expr("cast(array() as array<string>)")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("held", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
