"""The pipeline's stages on their own inputs, and as a whole."""

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm.test_neardup import brute
from tests.llm.test_scans import brute_lines, words_of
from tidemark.llm import toxicity
from tidemark.llm.packing import binary_lengths
from tidemark.llm.tokens import default_path, encoder

SF = "/root/testdata/sf0.001"


def test_each_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    apply = dict(corpus_pipeline.STAGES)
    assert list(apply) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]

    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    one = apply["toxicity"](spark, docs, SF).cache()
    assert {r.doc_id for r in one.collect()} == {d for d, p in scores.items() if not p} and one.columns == columns

    two = apply["line_dedup"](spark, one, SF).cache()
    rows = [tuple(r) for r in one.select("doc_id", "text").collect()]
    group = brute(rows)
    alone = {d: group[d] == d for d in group if Counter(group.values())[group[d]] > 1}
    want = brute_lines(rows, alone)
    shortened = {(d, "\n".join(x)) for (d, t), x in want.items() if len(x) == len(t.split("\n")) or "\n".join(x).strip(" \n")}
    assert {(r.doc_id, r.text) for r in two.collect()} == shortened and two.columns == columns and alone

    three = apply["near_dedup"](spark, two, SF).cache()
    assert {r.doc_id for r in three.collect()} == set(brute([tuple(r) for r in two.select("doc_id", "text").collect()]).values()) and three.columns == columns

    four = apply["decontamination"](spark, three, SF).cache()
    items = [" ".join(words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in three.collect() if any(f" {i} " in f" {' '.join(words_of(r.text))} " for i in items)}
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect()} - leaked and four.columns == columns

    want = []
    for r in four.collect():
        ids = np.array([*encoder(default_path()).tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes()
        start = 0
        for n in binary_lengths(len(ids) // 4):
            want.append((r.doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            start += n
    packed = [(r.doc_id, r.start, r.length, r.ids_crc32) for r in apply["packing"](spark, four, SF).collect()]
    assert sorted(packed) == sorted(want)
    whole = [(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(whole) == sorted(want)


def test_no_near_duplicate_of_the_raw_texts_is_packed(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    apply = dict(corpus_pipeline.STAGES)
    left = apply["toxicity"](spark, docs, sf)
    removed = {d for d, c in brute([tuple(r) for r in left.select("doc_id", "text").collect()]).items() if d != c}
    blank = {r.doc_id for r in docs.collect() if not (r.text or "").strip()}
    packed = {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, sf).collect()}
    assert removed and not removed & set(packed) and all(n > 1 or d in blank for d, n in packed.items())


def test_kept_documents_of_groups_lose_recurring_lines(spark):
    """Two groups share a long line, and so does a document of no group: it is kept once."""
    long = " ".join("abcdefghijklmnopqrstuvwxyz"[:25])
    own = lambda k: " ".join(f"{k}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120))
    rows = [(10, f"{own('p')}\n{long}"), (11, f"{own('p')} x\n{long}"), (20, f"{own('q')}\n{long}"), (21, f"{own('q')} y\n{long}"), (5, f"{own('r')}\n{long}"), (6, own("s")), (None, "no id")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, `a.b` long")
    apply = dict(corpus_pipeline.STAGES)
    two = apply["line_dedup"](spark, docs, SF)
    assert {(r.doc_id, r.text) for r in two.collect()} == {*rows} - {rows[4]} | {(5, own("r"))}
    three = apply["near_dedup"](spark, two, SF)
    assert three.columns == docs.columns
    assert {(r.doc_id, r.text) for r in three.collect()} == {rows[0], (20, own("q")), (5, own("r")), rows[5], rows[6]}


def test_odd_rows(spark, odd, none):
    for df in (odd, none):
        for _, apply in corpus_pipeline.STAGES:
            assert apply(spark, df, SF).count() >= 0
