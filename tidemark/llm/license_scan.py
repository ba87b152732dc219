"""License scans by diagonal voting.

Every rolling K-word hash of every text is joined to the positions at which the templates
have it. Hits are aggregated by diagonal (place in the text less place in the template);
neighbouring diagonals close by in the text are merged, so a few inserted or deleted words
don't part a span; a span is verified by the share of the template's words that its hits
cover, and by its length.

The base phrases are counted at every place. Defined cases: null and empty texts have no
words, labels '' and score 0; repeated rows are scanned one by one; spans that begin together
are merged in the order of their diagonals; texts of any length are scanned whole; other
columns, whatever their names, are left out; an empty table gives no rows. No text and no array of hashes is shuffled or written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage, texts
from tidemark.llm.words import Joined

K = 3
#: Diagonals that differ by this much, and less than the template's length, with spans this near are one span.
MERGE_SHIFT, MERGE_GAP = 3, 12
MIN_COVERED = 0.8
MAX_STRETCH = 1.5
GROUP = 200

#: The phrases that the base rule counts, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices as the licences' owners word them.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: The hash under which a text's own row travels through the join.
_OWN = 0

_WORDS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("grams", pa.list_(pa.int64()))])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 40
    for whole in batches:
        for start in range(0, whole.num_rows, GROUP):
            part = whole.slice(start, GROUP)
            n = part.num_rows
            joined = Joined(part.column("text").to_pylist())
            count, first, last, labels = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1), [set() for _ in range(n)]
            for phrase, label in BASE:
                for at in joined.places(phrase.split()).tolist():
                    doc = joined.owner[at]
                    at -= joined.starts[doc]
                    count[doc] += 1
                    first[doc] = at if first[doc] < 0 else min(first[doc], at)
                    last[doc] = max(last[doc], at)
                    labels[doc].add(label)
            at, grams = joined.windows(tuple(range(K)), K)
            sizes = np.maximum(joined.sizes - K + 1, 0) + 1
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            held = np.full(offsets[-1], _OWN, np.int64)
            doc = joined.owner[at]
            held[offsets[doc] + 1 + at - joined.starts[doc]] = grams.view(np.int64)
            none = first < 0
            yield pa.record_batch(
                [pa.array(np.arange(uid, uid + n)), part.column("doc_id"), pa.array(joined.sizes), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([",".join(sorted(x)) for x in labels]), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(held))],
                schema=_WORDS,
            )
            uid += n


def template_grams(spark) -> DataFrame:
    """(hash, template, label, template_at, template_words): a few hundred rows, by the constants above."""
    rows = [(_OWN, None, None, None, None)]
    for number, (label, notice) in enumerate(TEMPLATES):
        at, grams = (joined := Joined([notice])).windows(tuple(range(K)), K)
        rows += [(g, number, label, a, len(joined.hashes)) for a, g in zip(at.tolist(), grams.view(np.int64).tolist(), strict=True)]
    return spark.createDataFrame(rows, "hash long, template int, label string, template_at int, template_words int")


def scan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row per document with its base result, verified spans), both keyed by uid."""
    spark = docs.sparkSession
    scanned = texts(docs).mapInArrow(_scanned, "uid long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, grams array<long>")
    rolled = scanned.select("uid", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.posexplode("grams").alias("at", "hash"))
    met = stage(rolled.join(F.broadcast(template_grams(spark)), "hash"), "license-hits")
    own = met.where("at = 0 and template is null").drop("at", "hash", "template", "label", "template_at", "template_words")
    hits = met.where("template is not null").select("uid", "template", "label", "template_words", "template_at", (F.col("at") - 1).alias("at"))
    voted = hits.withColumn("diagonal", F.col("at") - F.col("template_at")).groupBy("uid", "template", "label", "template_words", "diagonal")
    voted = voted.agg(F.min("at").alias("low"), (F.max("at") + K - 1).alias("high"), F.collect_set("template_at").alias("votes"))
    order = Window.partitionBy("uid", "template").orderBy("low", "diagonal")
    shift = F.least(F.lit(MERGE_SHIFT), F.col("template_words") - 1)  # so notices back to back stay apart
    parted = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > shift) | (F.col("low") - F.lag("high").over(order) > MERGE_GAP)
    spans = voted.withColumn("parted", F.coalesce(parted, F.lit(False)).cast("int")).withColumn("span", F.sum("parted").over(order))
    spans = spans.groupBy("uid", "template", "label", "template_words", "span").agg(F.min("low").alias("first"), F.max("high").alias("last"), F.flatten(F.collect_list("votes")).alias("votes"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("votes", lambda v: F.sequence(v, v + K - 1)))))
    spans = spans.withColumn("covered", covered / F.col("template_words"))
    kept = (F.col("covered") >= MIN_COVERED) & (F.col("last") - F.col("first") + 1 <= F.col("template_words") * MAX_STRETCH)
    return own, spans.where(kept).select("uid", "template", "label", "first", "last", "covered")


def license_labels(docs: DataFrame) -> DataFrame:
    """What query op9 returns."""
    own, spans = scan(docs)
    of_text = spans.groupBy("uid").agg(F.collect_set("label").alias("found"), F.max("covered").alias("covered"), F.count("*").alias("n_spans"))
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",")
    score = F.greatest(F.coalesce("covered", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return own.join(of_text, "uid", "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))
