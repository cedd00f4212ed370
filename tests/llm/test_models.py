import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemlake.llm import langid, quality


@pytest.fixture(scope="module")
def corpus(spark):
    return "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark, corpus):
    got = quality.op8_quality(spark, corpus).toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda k: zlib.crc32(str(k).encode()) % 5 == 0)).all()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    labels = spark.read.parquet(f"{corpus}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.9
    good, bad = held[held["quality"] == 1]["score"], held[held["quality"] == 0]["score"]
    assert good.mean() > bad.mean() + 0.4


def test_quality_of_edge_rows(spark, edge_docs, empty_docs):
    good, bad = "a calm sentence about the weather of the day. " * 8, "BUY $$$ ### NOW %%% CLICK &&& " * 10
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) + str(i)) for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (7, None), (999, 0)], "doc_id bigint, quality int")
    model = quality.train_quality(docs, labels, F.lit(True))
    own = quality.score_quality(docs, model).collect()
    assert all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in own)
    got = quality.score_quality(edge_docs.drop("score"), model, keep=("fp",)).collect()
    assert len(got) == edge_docs.count() and all(0 <= r["score"] <= 1 and r["fp"] == "clash" for r in got)
    same = {r["score"] for r in got if r["doc_id"] in (18, 19)}
    assert len(same) == 1
    assert quality.score_quality(empty_docs, model).count() == 0
    none = quality.train_quality(docs, labels.filter("quality = 1"), F.lit(True))
    assert quality.score_quality(docs, none).first()["score"] > 0.5
    untaught = quality.score_quality(docs, quality.train_quality(empty_docs, labels, F.lit(True))).collect()
    assert len(untaught) == 60 and all(0 < r["score"] < 1 for r in untaught)


def test_evidence_covers_the_whole_text():
    good, bad = b"calm sentence about the weather of the day " * 50, b"BUY $$$ ### NOW %%% CLICK &&& " * 50
    clean = "a calm sentence about the weather of the day. " * 400
    junk_at_end = clean + "BUY $$$ ### NOW %%% CLICK &&& " * 40
    assert quality.evidence(good, bad, junk_at_end)[4] < quality.evidence(good, bad, clean)[4]
    assert quality.evidence(good, bad, "") == (0.0,) * quality.FEATURES


def test_gradients_by_differences():
    """Backpropagation through time against finite differences of the loss, with segments of several lengths."""
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (6, langid.SEGMENT)).astype(np.uint8)
    y, lengths = np.arange(6) % 3, np.array([64, 5, 64, 1, 30, 64])
    live = np.arange(langid.SEGMENT) < lengths[:, None]
    start = langid.fit(rows, lengths, y, ("a", "b", "c"), steps=0)
    m = langid.LanguageModel(start.langs, *[getattr(start, k).astype(np.float64) for k in "xubwc"])

    def loss():
        p = langid.position_probabilities(m, rows, lengths)
        picked = np.take_along_axis(p, np.broadcast_to(y[:, None, None], (6, langid.SEGMENT, 1)), axis=2)[:, :, 0]
        return -np.log(picked[live]).mean()

    for value, grad in zip((m.x, m.u, m.b, m.w, m.c), langid.gradients(m, rows, live, y)):
        for at in np.argsort(-np.abs(grad), axis=None)[:3]:
            i = np.unravel_index(at, value.shape)
            old = value[i]
            value[i] = old + 1e-2
            up = loss()
            value[i] = old - 1e-2
            slope, value[i] = (up - loss()) / 2e-2, old
            assert slope == pytest.approx(float(grad[i]), rel=0.02, abs=2e-5)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (200, langid.SEGMENT)).astype(np.uint8)
    labels, lengths = np.arange(200) % 2, np.full(200, langid.SEGMENT)
    rows[labels == 1, ::3] = 7
    m = langid.fit(rows, lengths, labels, ("a", "b"), steps=60)
    p = langid.position_probabilities(m, rows, lengths)[np.arange(200), :, labels]
    assert -np.log(p + 1e-9).mean() < 0.35


def test_language_on_held_out_rows(spark, corpus):
    got = langid.op7_language(spark, corpus).toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda k: zlib.crc32(str(k).encode()) % 3 == 1)).all()
    truth = spark.read.parquet(f"{corpus}/documents.parquet").select("doc_id", "lang").toPandas()
    held = got.merge(truth, on="doc_id")
    held = held[held["held_out"] & held["lang"].notna()]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97 and held["score"].between(0, 1).all()


def test_language_of_edge_rows(spark, edge_docs, empty_docs):
    rows = [(i, ("the house and the garden " if i % 2 else "das haus und der garten ") * 5, "en" if i % 2 else "de") for i in range(80)]
    docs = spark.createDataFrame([*rows, (None, "x", "en"), (200, None, "en"), (201, "abc", None)], "doc_id bigint, text string, lang string")
    model = langid.train_languages(docs, F.lit(True))
    assert model.langs == ("de", "en")
    own = langid.predict_languages(docs, model).filter("doc_id < 80").collect()
    assert all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in own)
    texts = {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    got = langid.predict_languages(edge_docs.drop("score"), model, keep=("fp",)).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert langid.train_languages(empty_docs, F.lit(True)) is None
    assert langid.predict_languages(docs, None).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.predict_languages(empty_docs, model).count() == 0


def test_all_positions_count():
    rng = np.random.default_rng(0)
    rows = rng.integers(97, 123, (100, langid.SEGMENT)).astype(np.uint8)
    m = langid.fit(rows, np.full(100, langid.SEGMENT), np.arange(100) % 2, ("a", "b"), steps=3)
    text = "abc def " * 1000 + "tail"
    data = text.encode()
    parts = [data[i : i + langid.SEGMENT] for i in range(0, len(data), langid.SEGMENT)]
    total = 0
    for p in parts:
        r, n = langid._segments(p)
        total = total + langid.position_probabilities(m, r, n).sum(axis=(0, 1))
    assert langid.document_probabilities(m, [text])[0] == pytest.approx(total / len(data), rel=1e-4)


def test_runs_of_positions(spark, edge_docs):
    rows = [(i, ("the house and the garden " if i % 2 else "das haus und der garten ") * 5, "en" if i % 2 else "de") for i in range(80)]
    model = langid.train_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    mixed = "the house and the garden " * 20 + "das haus und der garten " * 20
    got = langid.language_runs(spark.createDataFrame([(1, mixed), (2, None), (3, "")], "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    runs = got[0]["runs"]
    assert runs[0]["start"] == 0 and runs[-1]["end"] == len(mixed) and all(a["end"] == b["start"] and a["lang"] != b["lang"] for a, b in zip(runs, runs[1:]))
    english = sum(r["end"] - r["start"] for r in runs if r["lang"] == "en" and r["end"] <= 520)
    assert english > 400 and got[1]["runs"] == got[2]["runs"] == []
    texts = {r["doc_id"]: (r["text"] or "").lower().encode() for r in edge_docs.collect()}
    for r in langid.language_runs(edge_docs, model).collect():
        assert sum(x["end"] - x["start"] for x in r["runs"]) == len(texts[r["doc_id"]])


def test_figures_are_no_letters(spark):
    assert not any(map(langid.has_letter, ["", "12", "½ ² ①", "Ⅷ", "_ -", "🙂"])) and all(map(langid.has_letter, ["½a", "é", "中", "1x"]))
    rows = [(i, ("the house and the garden " if i % 2 else "das haus und der garten ") * 5, "en" if i % 2 else "de") for i in range(40)]
    model = langid.train_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    odd = spark.createDataFrame([(1, "½ ² ①"), (2, "Ⅷ 12"), (3, "x")], "doc_id bigint, text string")
    assert [r["lang_pred"] == "und" for r in langid.predict_languages(odd, model).orderBy("doc_id").collect()] == [True, True, False]


def test_probabilities_equal_a_network_of_plain_loops():
    """One byte and one gate at a time, over the segments of a text."""
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 123, (90, langid.SEGMENT)).astype(np.uint8)
    m = langid.fit(rows, np.full(90, langid.SEGMENT), np.arange(90) % 3, ("a", "b", "c"), steps=5)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    text = "Ein Haus, ein Garten und é 中 am Fluss " * 3
    data, total, hd = text.lower().encode(), np.zeros(3), langid.HIDDEN
    for begin in range(0, len(data), langid.SEGMENT):
        part = data[begin : begin + langid.SEGMENT]
        states = []
        for d, order in ((0, range(len(part))), (1, range(len(part) - 1, -1, -1))):
            h, own = np.zeros(hd), {}
            for t in order:
                a, v = m.x[d][part[t]].astype(float) + m.b[d], h @ m.u[d].astype(float)
                z, r = sigmoid(a[:hd] + v[:hd]), sigmoid(a[hd : 2 * hd] + v[hd : 2 * hd])
                n = np.tanh(a[2 * hd :] + r * v[2 * hd :])
                h = own[t] = (1 - z) * n + z * h
            states.append(own)
        for t in range(len(part)):
            s = np.concatenate([states[0][t], states[1][t]]) @ m.w.astype(float) + m.c
            total += np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    assert langid.document_probabilities(m, [text])[0] == pytest.approx(total / len(data), rel=1e-3)


def test_scores_equal_block_by_block_compression(spark, edge_docs):
    """The score from its definition: sizes with each dictionary, block by block, into the calibration."""
    import math

    import zstandard

    good, bad = "a calm sentence about the weather of the day. " * 8, "BUY $$$ ### NOW %%% CLICK &&& " * 10
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) + str(i)) for i in range(60)], "doc_id bigint, text string")
    model = quality.train_quality(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int"), F.lit(True))

    def size(data, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=quality.LEVEL)
        return len(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(data))

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in edge_docs.collect()}
    for r in quality.score_quality(edge_docs.drop("score"), model).collect():
        data = texts[r["doc_id"]]
        blocks = [data[i : i + quality.BLOCK] for i in range(0, len(data), quality.BLOCK)]
        f = [0.0] * 6
        if data.strip():
            sizes = [(size(b, model.good), size(b, model.bad), len(b)) for b in blocks]
            shares = [(y - x) / n for x, y, n in sizes if n >= min(quality.LEAST_BLOCK, len(data))]
            f = [
                sum(y - x for x, y, _ in sizes) / len(data), min(shares), max(shares), sum(min(x, y) for x, y, _ in sizes) / len(data),
                sum(min(0, y - x) for x, y, _ in sizes) / len(data), sum(n for x, y, n in sizes if y < x) / len(data),
            ]
        z = model.bias + sum(w * v for w, v in zip(model.weights, f))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


def test_documents_with_both_labels_count_as_bad(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(40)], "doc_id bigint, text string")
    rows = [(i, i % 2) for i in range(40)]
    clash = [(i, 1) for i in range(0, 40, 2)]
    both = [quality.train_quality(docs, spark.createDataFrame(r, "doc_id bigint, quality int"), F.lit(True)) for r in (rows, rows + clash, clash + rows)]
    assert both[0] == both[1] == both[2]
