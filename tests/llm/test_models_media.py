"""Classifiers on held-out rows, posteriors recomputed, media round trips."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import media, quality, toxicity
from tidemark.llm.linear import BUCKETS, distinct_buckets


def auc(score, y):
    rank = pd.Series(score).rank().to_numpy()
    return (rank[y == 1].mean() - (y.sum() + 1) / 2) / (len(y) - y.sum())


@pytest.fixture(scope="module")
def tenth(spark):
    return tuple(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))


def test_toxicity_held_out(tenth):
    docs, labels = tenth
    got = toxicity.toxicity(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    own = got.merge(labels.toPandas(), on="doc_id")
    own = own[own.held_out]
    assert auc(own.score, own.toxic.to_numpy()) > 0.85
    clean = own[own.toxic == 0]
    assert (clean.predicted == 0).mean() > 0.98 and own[own.toxic == 1].predicted.mean() > 0.6


def test_held_out_labels_are_not_read(docs, labels):
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.toxicity(docs, x).orderBy("doc_id").toPandas() for x in (labels, flipped))
    assert (a.score == b.score).all()


def plain_nnpu(p, u, prior, size):
    """The fit by dense matrices, text by text gradients and its own Adam, on the same batches."""
    dense = lambda rows: np.array([[float(j in set(r.tolist())) for j in range(size)] for r in rows])
    xp, xu = dense(p), dense(u)
    rng, w, b = np.random.default_rng(5), np.zeros(size), np.log(prior / (1 - prior))
    m, v, t = np.zeros(size + 1), np.zeros(size + 1), 0
    for _ in range(toxicity.EPOCHS):
        in_p, in_u = rng.permutation(len(p)), rng.permutation(len(u))
        for a, c in zip(np.array_split(in_p, toxicity.STEPS), np.array_split(in_u, toxicity.STEPS), strict=True):
            as_positive = as_negative = unlabelled = 0.0
            g_pos, g_neg, g_unl = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
            for row in xp[a]:
                s = 1 / (1 + np.exp(-(row @ w + b)))
                as_positive += -np.log(s) / len(a)
                as_negative += -np.log(1 - s) / len(a)
                g_pos += (s - 1) * np.append(row, 1) / len(a)
                g_neg += s * np.append(row, 1) / len(a)
            for row in xu[c]:
                s = 1 / (1 + np.exp(-(row @ w + b)))
                unlabelled += -np.log(1 - s) / len(c)
                g_unl += s * np.append(row, 1) / len(c)
            negatives = unlabelled - prior * as_negative
            g = prior * g_pos + g_unl - prior * g_neg if negatives >= 0 else -(g_unl - prior * g_neg)
            g = g + toxicity.SHRINK * np.append(w, 0)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = toxicity.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:size], b - step[size]
    return w, b


def test_fit_and_scores_by_a_plain_version():
    rng = np.random.default_rng(2)
    p = [np.unique(np.append(rng.integers(1, 12, 3), 0)) for _ in range(24)]
    u = [np.unique(rng.integers(1, 12, 3)) for _ in range(60)] + [np.unique(np.append(rng.integers(1, 12, 3), 0)) for _ in range(8)]
    for prior in (0.05, 0.4):  # the bracket of the risk stays above zero, and falls below
        w, b = toxicity.fit_nnpu(p, u, prior, 12)
        want_w, want_b = plain_nnpu(p, u, prior, 12)
        assert np.allclose(w, want_w, atol=1e-4) and abs(b - want_b) < 1e-4  # Adam amplifies rounding
    words = ["alpha", "beta", "gamma", "delta"]
    of = [xxhash.xxh3_64_intdigest(x.encode()) % BUCKETS for x in words]
    model = toxicity.Model(np.array(sorted(of)), np.array([1.0, -2.0, 0.5, 0.25]), -0.3)
    weight = dict(zip(sorted(of), [1.0, -2.0, 0.5, 0.25], strict=True))
    for text in ("", "alpha", "beta gamma beta", "delta alpha unknown"):
        total = -0.3 + sum(weight[of[i]] for i, x in enumerate(words) if x in text.split())
        assert abs(model.scores([text], model.dense())[0] - 1 / (1 + np.exp(-total))) < 1e-6


def test_telling_words_are_counted_over_all_texts(docs, labels, monkeypatch):
    """Whatever the sample's bounds, the buckets are those that plain counts of every text give."""
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 7)
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 20)
    kept = lambda d: zlib.crc32(str(d).encode()) % 4 != 2
    toxic = {r.doc_id for r in labels.collect() if r.toxic == 1 and kept(r.doc_id)}
    p, u, n, m = Counter(), Counter(), 0, 0
    for r in docs.collect():
        if kept(r.doc_id):
            found = distinct_buckets([r.text or ""])[1].tolist()
            u.update(found)
            m += 1
            if r.doc_id in toxic:
                p.update(found)
                n += 1
    want = []
    for bucket, times in p.items():
        share = (times + u[bucket]) / (n + m)
        error = (max(share * (1 - share), 1e-12) * (1 / n + 1 / m)) ** 0.5
        if times >= toxicity.MIN_TEXTS and abs(times / n - u[bucket] / m) >= toxicity.MIN_Z * error:
            want.append(bucket)
    got = toxicity.fit(docs, labels)
    assert len(want) > 0 and got.buckets.tolist() == sorted(want)
    assert len(got.weights) == len(want) and np.isfinite(got.weights).all()


def test_non_negative_risk_stays_put():
    rng = np.random.default_rng(0)
    p = [np.unique(np.append(rng.integers(1, 50, 5), 0)) for _ in range(60)]
    u = [np.unique(rng.integers(1, 50, 5)) for _ in range(300)] + [np.unique(np.append(rng.integers(1, 50, 5), 0)) for _ in range(30)]
    w, b = toxicity.fit_nnpu(p, u, 0.1, 50)
    assert w[0] > 1 and w[0] == w.max() and b < 0


@pytest.mark.parametrize("which", ["odd", "none"])
def test_toxicity_odd_rows(which, request, labels):
    df = request.getfixturevalue(which)
    for held in (labels, labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int"))):
        got = toxicity.toxicity(df, held).collect()
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in df.collect())
        assert all(0 <= r.score <= 1 for r in got)
    assert toxicity.not_toxic(df, labels.limit(0)).exceptAll(df).count() == 0


def test_quality_held_out(tenth):
    docs, labels = tenth
    train = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    got = quality.quality(docs, train, F.col("source"), F.col("lang")).toPandas()
    own = got.merge(labels.join(train, "doc_id", "left_anti").toPandas(), on="doc_id")
    assert auc(own.score, own.quality.to_numpy()) > 0.99 and (own.keep == (own.quality == 1)).mean() > 0.98


def test_posteriors(docs, labels):
    got = quality.quality(docs, labels, F.col("source"), F.col("lang")).toPandas()
    good = 1 / (1 + np.exp(-got.evidence))
    base = good.mean()

    def weight(n, mean, center):
        sites = n > 1
        between = max(((n * (mean - center) ** 2)[sites].sum() - (center * (1 - center))[sites].sum()) / n[sites].sum(), 0)
        return min(max((center * (1 - center))[sites].mean() / between - 1, 1), 1e6) if between > 1e-12 else 1e6

    hosts = good.groupby(got.host).agg(["size", "sum"])
    wh = weight(hosts["size"], hosts["sum"] / hosts["size"], pd.Series(base, hosts.index))
    share = (hosts["sum"] + wh * base) / (hosts["size"] + wh)
    paths = good.groupby([got.host, got.path]).agg(["size", "sum"])
    center = share.reindex(paths.index.get_level_values(0)).set_axis(paths.index)
    wp = weight(paths["size"], paths["sum"] / paths["size"], center)
    at = pd.MultiIndex.from_frame(got[["host", "path"]])
    n, s, c = (x.reindex(at).to_numpy() for x in (paths["size"], paths["sum"], center))
    hn, hs = (hosts[k].reindex(got.host).to_numpy() for k in ("size", "sum"))
    others = (good.sum() - good) / (len(good) - 1)
    host_share = (hs - good + wh * others) / (hn - 1 + wh)  # without the document, at every level
    path_share = (s - good + wp * host_share) / (n - 1 + wp)
    logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    assert np.allclose(got.host_share, host_share) and np.allclose(got.path_share, path_share)
    assert np.allclose(logit(got.score.clip(1e-9, 1 - 1e-9)), np.clip(got.evidence + logit(path_share) - logit(others), -20.7, 20.7), atol=1e-3)


def plain_style(text):
    """The style features, one by one."""
    data = (text or "").encode()
    words, lines, size = data.split(), data.split(b"\n"), max(1, len(data))
    share = lambda keep: sum(map(keep, data)) / size
    n, other = len(words), lambda b: b < 128 and not chr(b).isalnum() and not chr(b).isspace()
    pairs = list(zip(words, words[1:], strict=False))
    return [
        np.log1p(n), len(data) / max(1, n), share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(other), share(lambda b: other(b) and chr(b) not in ".,;:'\"()-?"), share(lambda b: b >= 128),
        sum(a == b for a, b in pairs) / len(pairs) if pairs else 0.0, 1 - len(set(words)) / max(1, n), 1 - len(set(pairs)) / len(pairs) if pairs else 0.0, 1 - len(set(lines)) / len(lines), np.log1p(size / len(lines)),
    ]


def test_evidence_by_a_plain_fit(docs, labels):
    """Features, standardisation, products and the ridge logistic optimum, all anew."""
    rows = {r.doc_id: plain_style(r.text) for r in docs.select("doc_id", "text").collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in rows}
    x = np.array([rows[d] for d in sorted(known)])
    y = np.array([known[d] for d in sorted(known)], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9

    def design(v):
        z = np.clip((np.array(v) - mean) / scale, -10, 10)
        return np.array([*z, *(np.clip(z[i] * z[j], -30, 30) for i in range(len(z)) for j in range(i, len(z))), 1.0])

    z = np.array([design(v) for v in x])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), quality.RIDGE)
    ridge[-1] = 1e-6
    for _ in range(200):  # damped Newton on the penalised loss
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + np.diag(ridge), grad)
        if np.abs(grad).max() < 1e-9:
            break
    got = quality.quality(docs, labels, F.col("source"), F.col("lang")).select("doc_id", "evidence").collect()
    for r in got[::7]:
        assert abs(r.evidence - np.clip(design(rows[r.doc_id]) @ w, -quality.MOST_ODDS, quality.MOST_ODDS)) < 1e-3


def test_the_only_document_of_a_site_is_not_its_own_witness(spark):
    df = spark.createDataFrame([(i, "good words " * 9, f"h{i}", "x") for i in range(4)], "doc_id long, text string, source string, lang string")
    got = quality.quality(df, spark.createDataFrame([], "doc_id long, quality int"), F.col("source"), F.col("lang")).collect()
    assert all(abs(r.host_share - 0.5) < 1e-9 and abs(r.path_share - 0.5) < 1e-9 for r in got)


def test_a_bad_site_lowers_its_documents(spark, docs, labels):
    bad = docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.lit("bad")).otherwise("good"))
    poor = " ".join(["the the the ###"] * 60)
    bad = bad.withColumn("text", F.when((F.col("source") == "bad") & (F.col("doc_id") % 10 != 0), F.lit(poor)).otherwise(F.col("text")))
    known = labels.where("doc_id % 2 = 1 or doc_id % 10 = 0")
    got = quality.quality(bad, known, F.col("source"), F.lit("x")).groupBy("host").agg(F.avg("path_share").alias("s")).collect()
    share = {r.host: r.s for r in got}
    assert share["bad"] < share["good"]


@pytest.mark.parametrize("which", ["odd", "none"])
def test_quality_odd_rows(which, request, labels):
    df = request.getfixturevalue(which)
    for held in (labels, labels.limit(0)):
        got = quality.quality(df, held, F.col("source"), F.col("lang")).collect()
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in df.collect())
        assert all(0 <= r.score <= 1 and r.keep is not None for r in got)


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_media(which, request):
    df = request.getfixturevalue(which)
    got = media.media_columns(df).collect()
    want = []
    for d, t in df.select("doc_id", "text").collect():
        raw = (t or "").encode()
        data = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want.append((d, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:])))
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == Counter(want)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
        assert r.caption == (None if r.doc_id is None else str(r.doc_id))
    lines = lambda t: [" ".join(x.split()) for x in (t or "").split("\n")] if t else []
    shown = lambda xs: [x for x in xs if x]
    places = [(d, len(shown(lines(t)[: (len(lines(t)) + 1) // 2])), len(shown(lines(t))) + 1, zlib.crc32("\n".join(shown(lines(t))).encode())) for d, t in df.select("doc_id", "text").collect()]
    assert Counter((r.doc_id, r.pos, r.n_items, r.texts_crc32) for r in got) == Counter(places)
    if which == "docs":
        assert sum(r.pos > 0 and r.n_items > 2 for r in got) > 0.9 * len(got)


def test_png_round_trip_and_damage():
    for data in (b"\xff" * 576, bytes(range(256)) * 9):
        image = media.to_png(data)
        assert media.from_png(image).tobytes() == data
        with pytest.raises(ValueError):
            media.from_png(image[:60] + bytes([image[60] ^ 1]) + image[61:])


def test_interleaving_keeps_order_positions_and_captions(spark):
    html = """<html><head><style>x</style><title>T</title></head><body><p>One <b>two</b><figure><img src="sha256:aa" alt="no"><figcaption>cap &amp; tion</figcaption></figure>
    three<img src="sha256:bb" alt="side"> four<script>var t = "</p>";</script><p>five<img alt="no source"></body>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<figcaption>open"), (4, "<img src='sha256:zz'>")], "page_id long, html string")
    sequences = media.interleave(pages).cache()
    got = {r.page_id: [(i.pos, i.kind, i.text, i.ref, i.caption) for i in r["items"]] for r in sequences.collect()}
    assert got[1] == [(0, "text", "T", None, None), (1, "text", "One two", None, None), (2, "media", None, "sha256:aa", "cap & tion"), (3, "text", "three", None, None), (4, "media", None, "sha256:bb", "side"), (5, "text", "four", None, None), (6, "text", "five", None, None)]
    assert got[2] == [] and got[3] == []
    store = spark.createDataFrame([("aa", media.to_png(b"\1" * 576)), ("bb", media.to_png(b"\2" * 576)), ("bb", media.to_png(b"\2" * 576))], "digest string, media binary")
    found = sorted((r.page_id, r.pos, r.caption, r.payload_bytes) for r in media.resolve(sequences, media.read_payloads(store)).collect())
    assert found == [(1, 2, "cap & tion", 576), (1, 4, "side", 576), (4, 0, None, None)]


@pytest.mark.parametrize("html, want", [
    ("<figure><figcaption>first</figcaption><img src='a'></figure>after", [("media", None, "a", "first"), ("text", "after", None, None)]),
    ("<figure><img src='a'><img src='b'><figcaption>both <p>of</p> them</figure>after", [("media", None, "a", "both of them"), ("media", None, "b", "both of them"), ("text", "after", None, None)]),
    ("<figure><figcaption>no image</figcaption></figure>after", [("text", "no image", None, None), ("text", "after", None, None)]),
    ("<figcaption>loose</figcaption><p>after", [("text", "loose", None, None), ("text", "after", None, None)]),
    ("<figure><img src='a'><figcaption>open</figure><p>one<p>two", [("media", None, "a", "open"), ("text", "one", None, None), ("text", "two", None, None)]),
    ("<p>a &lt;b&gt; &amp;amp; c</p>", [("text", "a <b> &amp; c", None, None)]),
])
def test_captions_and_figures(html, want):
    assert [(i["kind"], i["text"], i["ref"], i["caption"]) for i in media.parse_html(html)] == want


def test_documents_survive_their_page():
    for text in ("one\n<b>&amp; two</b>\n\nthree", "a", "\n", "x & y < z > \" '\n&#65;\n</p><img src=q>\n<!-- -->", "tab\tand  spaces"):
        items = media.parse_html(media.page_of(text, "d", "7"))
        assert [i["text"] for i in items if i["kind"] == "text"] == [" ".join(x.split()) for x in text.split("\n") if x.split()]
        assert [(i["ref"], i["caption"]) for i in items if i["kind"] == "media"] == [("sha256:d", "7")]


def test_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = media.interleave(pages).collect()
    assert len(rows) == pages.count() and all([i.pos for i in r["items"]] == list(range(len(r["items"]))) for r in rows)
    assert not any("track(" in (i.text or "") for r in rows for i in r["items"])
