import hashlib
import zlib

from pyspark.sql import functions as F

from tandemlake.llm import media


def test_png_round_trip():
    for data in (b"", b"a", bytes(range(256)) * 3, "é🙂".encode() * 1000):
        stored = media.to_png(media.padded(data))
        back = media.from_png(stored)
        assert back[: len(data)] == data and not any(back[len(data) :]) and len(back) % 64 == 0 and back


def test_damage_is_seen():
    stored = bytearray(media.to_png(media.padded(b"payload" * 40)))
    stored[60] ^= 1
    try:
        media.from_png(bytes(stored))
    except (ValueError, zlib.error):
        return
    raise AssertionError("a damaged image was read")


def test_order_positions_and_captions():
    html = (
        '<p>one <b>two</b></p><script>var x="</p>";</script><figure><img src="a.png" alt="alt"><figcaption>the <i>caption</i></figcaption></figure>'
        'tail &amp; end<img alt="x"><img src="sha256:00" title="t"><p>last'
    )
    got = [(i["position"], i["kind"], i["text"] or i["ref"], i["caption"]) for i in media.parse_sequence(html)]
    assert got == [
        (0, "text", "one two", None), (1, "media", "a.png", "the caption"), (2, "text", "tail & end", None), (3, "media", "sha256:00", "t"), (4, "text", "last", None),
    ]
    assert media.parse_sequence(None) == media.parse_sequence("") == []


def test_resolution(spark):
    pages = spark.createDataFrame([(1, "<p>a<img src='sha256:%s' alt='c'>b<img src='sha256:none'>" % hashlib.sha256(b"pay").hexdigest()), (2, None), (1, "")], "page_id bigint, html string")
    store = media.store_media(spark.createDataFrame([(bytearray(b"pay"),), (bytearray(b"pay"),), (None,)], "payload binary"))
    assert store.count() == 2
    got = sorted(map(tuple, media.resolve(media.interleaved(pages), media.describe_media(store), "page_id").select("page_id", "position", "caption", "n_bytes").collect()))
    assert got == [(1, 1, "c", 3), (1, 3, None, None)]


def test_pages_table(spark, sf):
    got = media.interleaved(spark.read.parquet(f"{sf}/pages.parquet")).select(F.size("items").alias("n"), F.expr("transform(items, x -> x.position)").alias("p")).collect()
    assert all(r["p"] == list(range(r["n"])) for r in got) and max(r["n"] for r in got) > 3


def test_op10(spark, sf, edge_docs, tmp_path):
    for folder in (sf, str(tmp_path)):
        if folder != sf:
            edge_docs.write.parquet(f"{folder}/documents.parquet")
        docs = {}
        for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
            docs.setdefault(r["doc_id"], []).append((r["text"] or "").encode())
        got = media.op10_media(spark, folder).collect()
        assert len(got) == sum(map(len, docs.values()))
        seen = {}
        for r in got:
            data = next(d for d in docs[r["doc_id"]] if len(d) == r["n_bytes"])
            padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
            assert (r["payload_bytes"], r["payload_sha256"]) == (len(padded), hashlib.sha256(padded).hexdigest())
            assert r["tail_crc32"] == zlib.crc32(padded[-64:])
            stored = media.to_png(padded)
            assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
            assert seen.setdefault(data, r["feature"]) == r["feature"]


def test_captions_hold_within_their_figure():
    captions = lambda html: [i["caption"] or i["text"] for i in media.parse_sequence(html)]
    assert captions('<p>a</p><img src=x alt="one"><figcaption>stray</figcaption>') == ["a", "one", "stray"]
    inner = '<figure><img src=z><figcaption>in</figcaption></figure>'
    assert captions(f'<figure><img src=y alt=old>{inner}<figcaption>out</figcaption></figure><img src=w alt=last></figure>') == ["out", "in", "last"]
    assert captions('<figure><img src=a><img src=b></figure><figure><img src=c><figcaption>  </figcaption></figure>') == [None, None, None]


def test_interleaving_survives_the_join(spark):
    """Texts, media and captions of pages with several of each, in order, with their payloads."""
    loads = [f"payload {i}".encode() * (i + 1) for i in range(5)]
    digest = [hashlib.sha256(p).hexdigest() for p in loads]
    pages = []
    for page in range(30):
        own = [(page + j) % 5 for j in range(page % 4)]
        html = "<h1>head</h1>" + "".join(f"<p>text {j}</p><figure><img src='sha256:{digest[i]}'><figcaption>shows {i}</figcaption></figure>" for j, i in enumerate(own)) + "end"
        pages.append((page, html, own))
    sequences = media.interleaved(spark.createDataFrame([p[:2] for p in pages], "page_id bigint, html string")).cache()
    store = media.store_media(spark.createDataFrame([(bytearray(p),) for p in loads], "payload binary"))
    got = {}
    for r in media.resolve(sequences, media.describe_media(store), "page_id").collect():
        got.setdefault(r["page_id"], []).append((r["position"], r["caption"], r["n_bytes"]))
    texts = {r["page_id"]: [(i["position"], i["text"]) for i in r["items"] if i["kind"] == "text"] for r in sequences.collect()}
    for page, _, own in pages:
        assert sorted(got.get(page, [])) == [(2 * j + 2, f"shows {i}", len(loads[i])) for j, i in enumerate(own)]
        assert texts[page] == [(0, "head"), *[(2 * j + 1, f"text {j}") for j in range(len(own))], (2 * len(own) + 1, "end")]
