"""Exact encoding with a SentencePiece model of merge type, by backtracking over longest matches.

Merging turns a text into the one sequence of pieces in which every two neighbours, merged afresh from characters, come
out as themselves. So the sequence can be built from the left: an Aho-Corasick automaton lists the pieces that start at
each position, the longest is tried first, a piece is taken if it is compatible with the one before it (found by
re-merging the two, once for each pair), and a position from which nothing fits is marked in a bitfield, so that it is
never tried again. Characters without a piece become their UTF-8 bytes' pieces.

No piece holds a blank after another character, so blanks split a text into parts that are encoded by themselves and
kept in a bounded memo. Parts that start with two or more blanks are merged outright: pieces of blanks have equal
scores, and then the order of merges depends on more than neighbours.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, read_table, whole_text

BLANK = "▁"
#: Parts and pairs kept in a Python worker; a memo starts afresh when it is full.
MEMO_PARTS = 500_000
MEMO_PAIRS = 1_000_000
MEMO_CHARS = 64


class MergePieces:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes = {}
        self.automaton = ahocorasick.Automaton()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.score[piece], self.ids[piece] = sp.get_score(i), i
                self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        #: Neighbouring characters within some piece; no merge crosses any other pair.
        self.joins = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.bos, self.eos, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """The pieces of a text by merging: the best score first, of equal scores the leftmost."""
        score, symbols = self.score, list(text)
        after = list(range(1, len(symbols))) + [-1]
        before = list(range(-1, len(symbols) - 1))
        heap = [(-score[p], i, p) for i in range(len(symbols) - 1) if (p := symbols[i] + symbols[i + 1]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j < 0 or symbols[i] + symbols[j] != piece:
                continue
            symbols[i], symbols[j], after[i] = piece, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := symbols[a] + symbols[b]) in score:
                    heapq.heappush(heap, (-score[p], a, p))
        return [s for s in symbols if s]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the two together leaves them as they are; with an empty a: whether b is reached at all."""
        if (a, b) not in self.pairs:
            if len(self.pairs) > MEMO_PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return self.pairs[a, b]

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text whose scores decide the order of merges, by backtracking."""
        sizes: list[list[int]] = [[1] for _ in text]  # of the pieces from each position, the longest last
        for end, size in self.automaton.iter(text):
            if size > 1:
                sizes[end - size + 1].append(size)
        taken: list[int] = []
        failed = 0
        at, untried = 0, len(sizes[0]) if text else 0
        while at < len(text):
            last = text[at - taken[-1] : at] if taken else ""
            for k in range(untried - 1, -1, -1):
                size = sizes[at][k]
                if not failed >> (at + size) & 1:
                    piece = text[at : at + size]
                    if (size == 1 or self.compatible("", piece)) and (not last or self.compatible(last, piece)):
                        break
            else:
                failed |= 1 << at
                if not taken:  # scores that don't decide the order
                    return self.merge(text)
                at -= taken[-1]
                untried = sizes[at].index(taken.pop())
                continue
            taken.append(size)
            at += size
            untried = len(sizes[at]) if at < len(text) else 0
        out, at = [], 0
        for size in taken:
            out.append(text[at : at + size])
            at += size
        return out

    def _ids(self, part: str) -> bytes:
        """A part's ids, run by run: between runs stand characters that no piece has side by side."""
        cuts = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in self.joins]
        known, out = self.runs, []
        for begin, end in zip([0, *cuts], [*cuts, len(part)]):
            run = part[begin:end]
            got = known.get(run)
            if got is None:
                got = self._run_ids(run)
                if len(run) <= MEMO_CHARS:
                    known[run] = got
            out.append(got)
        return b"".join(out)

    def _run_ids(self, run: str) -> bytes:
        out: list[int] = []
        for piece in self.merge(run) if run.startswith(BLANK * 2) else self._blocks(run):
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return array("I", out).tobytes()

    def _blocks(self, run: str) -> list[str]:
        """Long runs are cut where no match crosses, so that the bitfield stays short."""
        if len(run) <= 4096:
            return self.pieces(run)
        cover = bytearray(len(run) + 1)
        for end, size in self.automaton.iter(run):
            if size > 1:
                cover[end - size + 2 : end + 1] = b"\x01" * (size - 1)
        out, begin = [], 0
        for at in range(1, len(run) + 1):
            if at == len(run) or not cover[at]:
                out += self.pieces(run[begin:at])
                begin = at
        return out

    def encode(self, text: str) -> bytes:
        """Ids without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if BLANK in text or "  " in text or text[0] == " ":
            parts = re.findall(f"{BLANK}+[^{BLANK}]*", BLANK + text.replace(" ", BLANK))
        else:
            parts = [BLANK + w for w in text.split(" ")]
        known = self.parts
        if len(known) > MEMO_PARTS:
            known.clear()
        if len(self.runs) > MEMO_PARTS:
            self.runs.clear()
        out = []
        for part in parts:
            got = known.get(part)
            if got is None:
                got = self._ids(part)
                if len(part) <= MEMO_CHARS:
                    known[part] = got
            out.append(got)
        return b"".join(out)


_LOADED: dict[str, MergePieces] = {}


def loaded(path: str) -> MergePieces:
    """The model of a path, read once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = MergePieces(path)
    return _LOADED[path]


def encode_texts(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array<int>, with begin and end ids) and decoded of every row.

    Null texts count as empty: their ids are begin and end only and they decode to the empty text. Repeated rows are
    kept; other columns are ignored. model: path of a merge-type SentencePiece model, readable on every executor.
    """

    def work(rows: dict[str, list]) -> dict[str, list]:
        m = loaded(model)
        ids = [[m.bos, *memoryview(m.encode(t)).cast("I"), m.eos] for t in rows["_text"]]
        return {key: rows[key], "ids": ids, "decoded": [m.library.decode(x) for x in ids]}

    typed = df.schema[key].dataType.simpleString()
    return map_columns(df.select(key, whole_text(text).alias("_text")), f"`{key}` {typed}, ids array<int>, decoded string", work)


def digest_texts(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of what `encode_texts` gives, without sending ids to the JVM."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        m = loaded(model)
        first, last = array("I", [m.bos]).tobytes(), array("I", [m.eos]).tobytes()
        data = [first + m.encode(t) + last for t in rows["_text"]]
        decoded = [m.library.decode(memoryview(x).cast("I").tolist()) for x in data]
        return {
            key: rows[key],
            "n_tokens": [len(x) // 4 for x in data],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in data],
            "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
        }

    typed = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {typed}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_columns(df.select(key, whole_text(text).alias("_text")), schema, work)


def op6_merge_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_texts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
