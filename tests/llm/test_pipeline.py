import zlib
from array import array

import corpus_pipeline as cp
from tandemlake.llm import langid, packing, quality, secrets


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_stages(spark):
    assert [k for k, _ in cp.STAGES] == ["quality", "language", "near_duplicates", "secrets", "packing"]
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames = [docs]
    for _, stage in cp.STAGES:
        frames.append(stage(spark, frames[-1], folder).cache())
    assert all(f.columns == docs.columns for f in frames[:5])
    ids = [{r["doc_id"] for r in f.select("doc_id").collect()} for f in frames]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4] == ids[5] and ids[5]

    # Each stage against its operator and against brute force.
    model = quality.train_quality(docs.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet"), ~quality.held_out())
    assert ids[1] == {r["doc_id"] for r in quality.score_quality(docs, model).collect() if r["score"] >= quality.THRESHOLD}
    langs = langid.train_languages(docs, ~langid.held_out())
    assert ids[2] == {r["doc_id"] for r in langid.predict_languages(frames[1], langs).collect() if r["lang_pred"] != "und" and r["score"] >= cp.LANGUAGE_SCORE}
    rows = sorted((r["doc_id"], r["text"]) for r in frames[2].collect())
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    assert ids[3] == {rows[r][0] for r in root}
    before = {r["doc_id"]: r["text"] for r in frames[3].collect()}
    for r in frames[4].collect():
        base = secrets.base_spans(before[r["doc_id"]])
        spans = base + secrets.novel_spans(before[r["doc_id"]], base)
        assert r["text"] == secrets.masked(before[r["doc_id"]], spans) and r["n_chars"] == len(r["text"])
    assert max(r["offset"] + r["length"] for r in frames[5].collect()) <= packing.CAPACITY


def test_near_duplicates_of_odd_rows(spark, edge_docs, empty_docs):
    docs = edge_docs.select(*cp.COLUMNS)
    kept = cp.drop_near_duplicates(spark, docs, "").collect()
    texts = [r["text"] for r in kept if r["doc_id"] is not None]
    assert texts.count("same text here") == 1 and sum(r["doc_id"] is None for r in kept) == 1
    assert cp.drop_near_duplicates(spark, empty_docs, "").count() == 0
    assert cp.hide_secrets(spark, docs, "").count() == docs.count()


def test_run(spark):
    got = cp.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"} <= set(got.columns) and got.count() > 0
    for r in got.limit(300).collect():
        assert len(r["ids"]) == r["length"] and zlib.crc32(array("I", r["ids"]).tobytes()) == r["ids_crc32"]


def test_each_stage_on_odd_rows_and_on_none(spark, edge_docs, empty_docs):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing columns, and no rows at all."""
    folder = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    for name, stage in cp.STAGES:
        got = stage(spark, edge_docs, folder)
        assert got.columns == list(cp.COLUMNS) or name == "packing"
        ids = [r["doc_id"] for r in got.select("doc_id").collect()]
        assert set(ids) <= {k for k, _ in texts}
        if name == "language":
            assert sorted(map(str, ids)) == sorted(str(k) for k, t in texts if any(c.isalpha() for c in t or "") and str(k) in map(str, ids)) and {0, 1, 2, 3}.isdisjoint(ids)
        if name == "packing":
            assert set(ids) == {k for k, _ in texts}
        assert stage(spark, empty_docs, folder).count() == 0


def test_repeated_and_null_ids(spark):
    """Unrelated texts of one id stay, of copies the one with the smallest id, and null ids go last."""
    word = lambda g: " ".join(f"g{g}w{i}" for i in range(40))
    rows = [(1, word(0)), (5, word(1)), (5, word(2)), (2, word(1)), (5, word(3)), (None, word(4)), (None, word(4)), (None, word(0)), (7, word(5) + " z"), (7, word(5)), (7, word(5))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(r["doc_id"], r["text"]) for r in cp.drop_near_duplicates(spark, docs, "").collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == [(1, word(0)), (2, word(1)), (5, word(2)), (5, word(3)), (7, word(5)), (None, word(4))]


def test_workers_hold_one_thing_at_a_time(spark):
    from tandemlake.llm import common

    made = []
    common.let_go()
    for name in ("a", "a", "b", "a"):
        assert common.held(name, lambda: made.append(name) or name) == name and list(common._HELD) == [name]
    assert made == ["a", "b", "a"]
    common.let_go("a")
    assert common._HELD
    common.let_go()
    assert not common._HELD
    for i in range(5):  # models of five runs
        quality.evidence(b"good %d " % i * 99, b"bad %d " % i * 99, "some text of any kind")
    assert quality._compressor.cache_info().currsize == 2


def test_batches_are_bounded_by_bytes(spark):
    from pyspark.sql import functions as F

    from tandemlake.llm.common import BATCH_BYTES, map_columns

    rows = spark.range(0, 2_000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("t"))  # 40 MB in one partition
    map_columns(rows, "n bigint", lambda part: {"n": [len(t) for t in part["t"]]})

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    got = [r["n"] for r in rows.mapInArrow(sizes, "n bigint").collect()]
    assert len(got) > 5 and max(got) < 2 * BATCH_BYTES
