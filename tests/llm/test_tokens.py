import hashlib
import random
import zlib
from array import array

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tandemlake.llm import mergepieces, packing, wordids

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "", " ", "  ", "   a", " a", "a ", "a  b   c    d", "▁x ▁", " " * 50 + "the cat" + " " * 33, "\n\n \t x\x00y", "中文字 テスト", "é é 🙂🙂 a🙂b",
    "a" * 5000, "\x7f\u0085 q", "don't  stop", "1234567 89 3.14", "x" * 9000 + " " + "ab" * 3000, "B's it's ,'s x1y2 İstanbul ΣΑΣ ﬁ <|endoftext|>x <|endoftext|>",
    "a,,b a,. b,'. zz!!́ a! ª º µ! x² ½ ß. ÿ! ×! ÷!. a÷! of%%% the&&&   nb sp",
]


def random_texts(alphabet, n=400, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_pieces_equal_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    m = mergepieces.MergePieces(PIECES)
    for text in HARD + random_texts("ab ▁ e\nt1é🙂h  in") + random_texts("theandigo ", 300, 8):
        assert array("I", sp.encode(text)).tobytes() == m.encode(text), text[:80]


def test_backtracking_agrees_with_merging():
    m = mergepieces.MergePieces(PIECES)
    for text in random_texts("thereaoundmlsc", 500, 11):
        assert m.pieces(text) == m.merge(text)


def test_memos_may_be_dropped(monkeypatch):
    monkeypatch.setattr(mergepieces, "MEMO_PARTS", 3)
    monkeypatch.setattr(mergepieces, "MEMO_PAIRS", 3)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    m = mergepieces.MergePieces(PIECES)
    for text in random_texts("some words again ", 60, 2):
        assert array("I", sp.encode(text)).tobytes() == m.encode(text)


def test_encode_texts(edge_docs, empty_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r["doc_id"]: r["text"] or "" for r in edge_docs.collect()}
    got = mergepieces.encode_texts(edge_docs, PIECES).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        assert r["ids"] == [1, *sp.encode(texts[r["doc_id"]]), 2]
        assert r["decoded"] == sp.decode(r["ids"])
    assert mergepieces.encode_texts(empty_docs, PIECES).count() == 0


def test_op6(spark, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in mergepieces.op6_merge_pieces(spark, sf).collect():
        ids = [1, *sp.encode(texts[r["doc_id"]]), 2]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("memo", [5, wordids.MEMO_WORDS])
def test_word_ids_equal_the_library(monkeypatch, memo):
    monkeypatch.setattr(wordids, "MEMO_WORDS", memo)
    lib = Tokenizer.from_file(WORDS)
    w = wordids.WordIds(WORDS)
    texts = HARD + random_texts("abC ,.'!é\n1s%") + random_texts("the'sré ¿½ ", 200, 3)
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        want = [array("I", e.ids).tobytes() for e in lib.encode_batch(part, add_special_tokens=False)]
        assert w.encode_batch(part) == want


def check_packed(pieces, tokens, capacity):
    for k, ids in tokens:
        own = sorted((p for p in pieces if p["doc_id"] == k), key=lambda p: p["start"])
        # Rows that repeat an id have equal texts here.
        assert sum(p["length"] for p in own) % len(ids) == 0 and own
        for p in own:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(array("I", part).tobytes()) and p["doc_tokens"] == len(ids)
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sorted(by) == list(range(len(by)))
    for rows in by.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_cut_lengths_fill_places():
    for n in [*range(1, 300), 1023, 1024, 1025, 2047, 2048, 2049, 6000]:
        cut = packing.cut_lengths(n)
        assert sum(x for x, _ in cut) == n and all(0 < x <= packing.CAPACITY // k for x, k in cut)
    tail = [packing.cut_lengths(n) for n in range(200, 2048, 7)]
    waste = sum(packing.CAPACITY / k - x for c in tail for x, k in c) / sum(x for c in tail for x, _ in c)
    assert waste < 0.03


def test_packing_of_edge_rows(edge_docs, empty_docs):
    lib = Tokenizer.from_file(WORDS)
    tokens = [(r["doc_id"], lib.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in edge_docs.collect()]
    pieces = [r.asDict() for r in packing.pack_documents(edge_docs, WORDS, with_ids=True).collect()]
    check_packed(pieces, tokens, packing.CAPACITY)
    assert sum(p["length"] for p in pieces) == sum(len(t) for _, t in tokens)
    assert all(zlib.crc32(array("I", p["ids"]).tobytes()) == p["ids_crc32"] for p in pieces)
    assert packing.pack_documents(empty_docs, WORDS).count() == 0


def test_op5_has_little_padding(spark, sf):
    lib = Tokenizer.from_file(WORDS)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    tokens = [(r["doc_id"], lib.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in docs]
    pieces = [r.asDict() for r in packing.op5_packing(spark, sf).collect()]
    n = check_packed(pieces, tokens, packing.CAPACITY)
    total = sum(len(t) for _, t in tokens)
    assert sum(p["length"] for p in pieces) == total and 1 - total / (n * packing.CAPACITY) < 0.03


def test_special_tokens_are_the_library_s():
    """In other case, next to blanks or within words: the library decides before it normalises."""
    lib = Tokenizer.from_file(WORDS)
    w = wordids.WordIds(WORDS)
    texts = ["one <|endoftext|> two", "<|endoftext|>\ntwo", "<|startoftext|> a", "a <|EndOfText|>", "<|ENDOFTEXT|>x", "a<|startoftext|><|endoftext|>b"]
    rng = random.Random(5)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|STARTOFTEXT|>", " ", "\n", "one", "Two", "it's", "é", "12", "<|", "|>", "endoftext", "!", "\t", "中"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    for at in range(0, len(texts), 250):
        part = texts[at : at + 250]
        assert w.encode_batch(part) == [array("I", e.ids).tobytes() for e in lib.encode_batch(part, add_special_tokens=False)]
