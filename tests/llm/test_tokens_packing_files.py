"""Ids against the library's own for whole texts; packing; Arrow files read back."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import packing, token_files
from tidemark.llm.tokens import default_path, encoder


def whole(text):
    return encoder(default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids


def ids(text):
    return np.array([*whole(text), 2], "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aBé'sStTrRe.,!?#$ \n\t\r\x0b\x1c\x1f\x85  ΣİıſKßŉ́İ語\U0001f600<|>endof0123½²ªº́")), max_size=40))
def test_pieces_give_the_ids_of_the_whole(text):
    assert encoder(default_path()).ids(text) == np.array(whole(text), "<u4").tobytes()


def test_every_letter_before_every_mark():
    e = encoder(default_path())
    letters = [chr(c) for c in range(0x21, 0x530) if chr(c).lower() != chr(c) or chr(c).upper() != chr(c) or chr(c).isalpha()]
    for mark in (".", ",", "!", "'s", ".,", "?"):
        text = " ".join(f"{c}{mark} a{c}{mark} {c}B{mark}" for c in letters)
        assert e.ids(text) == np.array(whole(text), "<u4").tobytes()
    for text in ("TARİHİ, EVİ.", "İ.", "İ,", "aİ. İa, ii̇."):
        assert e.ids(text) == np.array(whole(text), "<u4").tobytes()
    assert len(whole("TARİHİ, EVİ.")) == 10


def test_real_texts(docs):
    e = encoder(default_path())
    for (text,) in docs.select("text").limit(300).collect():
        assert e.with_end(text) == ids(text)


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 8191, 12345])
def test_binary_lengths(n):
    got = packing.binary_lengths(n)
    assert sum(got) == n and got == sorted(got, reverse=True) and all(x & (x - 1) == 0 and x <= 4096 for x in got)
    assert len([x for x in got if x < 4096]) == bin(n % 4096).count("1")


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing(which, request):
    df = request.getfixturevalue(which)
    rows = packing.packed_rows(df).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 4096
    assert len({r.sequence_id for r in rows}) == len(rows)
    texts = defaultdict(list)
    for d, t in df.select("doc_id", "text").collect():
        texts[d].append(t)
    for d, held in texts.items():
        want = []
        for t in held:
            data = ids(t)
            start = 0
            for n in packing.binary_lengths(len(data) // 4):
                want.append((start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), len(data) // 4))
                start += n
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[d]) == sorted(want)


def test_empty_table_and_buckets(spark, none, odd, tmp_path):
    assert packing.packed_rows(none).count() == 0
    packing.write_buckets(packing.pack(odd), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where(F.length("ids") != 4 * F.col("length")).count() == 0
    assert back.where(F.expr("shiftleft(1, bucket) <> length")).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_files(which, request):
    df = request.getfixturevalue(which)
    rows = token_files.read_documents(token_files.write_token_files(df)).collect()
    held = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, start = [], 0
    for d, t in held:
        data = ids(t)
        want.append((d, start, len(data) // 4, zlib.crc32(data)))
        start += len(data) // 4
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_random_access_and_masks(spark, docs):
    manifest = token_files.write_token_files(docs.limit(50), length=64).collect()
    for m in manifest:
        f = token_files.TokenFile(m.file)
        stream = np.concatenate([f.sequence(i)[0][f.sequence(i)[1]] for i in range(m.n_rows)])
        assert len(stream) == m.n_tokens
        for _, start, n in f.documents():
            assert (f.tokens(start, n) == stream[start : start + n]).all()
        first, mask = f.sequence(0)
        assert len(first) == 64 and not first.flags.owndata and mask.all()
        f.close()


def test_no_files_for_an_empty_table(none):
    assert token_files.read_documents(token_files.write_token_files(none)).count() == 0
