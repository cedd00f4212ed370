"""Ids of a lower-casing BPE tokenizer with word ends, by a bounded memo of words.

Such a tokenizer (NFC, white space to one blank, lower case, then a split into contractions, letter runs, digits and
symbol runs) never lets a token cross white space, so a text's ids are its words' ids in a row. Corpora repeat words:
known words are looked up, and only new ones go to the library, many in one call, being told apart by their word ends.
Texts with a special token of the tokenizer, in any case, are the exception: there the library looks at the text before
it is normalised, so these go to it whole.
"""

from __future__ import annotations

import re
from array import array

#: Words kept in a Python worker, unless another number is given; the memo starts afresh when it is full (about 200 bytes a word).
MEMO_WORDS = 700_000
#: Longer words aren't kept.
MEMO_CHARS = 64
#: Words joined into one call of the library.
CALL_WORDS = 1_000

#: Lower-casing and NFC of these characters are the same one by one as in the tokenizer.
_SIMPLE = re.compile("[^\x00-\x7f\xa1-įı-ɏ]").search
#: A run of symbols (no apostrophe) between a letter or digit and a blank is a word of its own.
_TAIL = re.compile(r"(?<=[0-9a-z\xdf-\xf6\xf8-\xff])([!-&(-/:-@\[-`{-~]+)(?= )")
_PLAIN = re.compile("[!-~\xa1-įı-ɏ]+").fullmatch


class WordIds:
    """encode(text) -> the ids as little-endian unsigned 32-bit integers, equal to the library's ids of the text."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.memo_words = memo_words
        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple({token.content.lower() for token in self.tokenizer.get_added_tokens_decoder().values()})
        self.ends = {i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")}
        self.memo: dict[str, bytes] = {"": b""}

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        plain = [w for w in words if _PLAIN(w) and len(w) <= MEMO_CHARS and (w.isalpha() or _symbols(w))]
        found: dict[str, bytes] = {}
        for at in range(0, len(plain), CALL_WORDS):
            part = plain[at : at + CALL_WORDS]
            ids = self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids
            stops = [i for i, x in enumerate(ids, 1) if x in self.ends]
            if len(stops) != len(part):  # a word that the tokenizer splits further
                continue
            data, begin = array("I", ids).tobytes(), 0
            for word, stop in zip(part, stops):
                found[word] = data[4 * begin : 4 * stop]
                begin = stop
        rest = [w for w in words if w not in found]
        for word, got in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            found[word] = array("I", got.ids).tobytes()
        return found

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        low = [t.lower() for t in texts]
        whole = [i for i, t in enumerate(low) if any(s in t for s in self.special)]
        if whole:
            got = self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)
            rest = set(whole)
            plain = self.encode_batch(["" if i in rest else t for i, t in enumerate(texts)])
            for i, e in zip(whole, got):
                plain[i] = array("I", e.ids).tobytes()
            return plain
        split = []
        for text, lower in zip(texts, low):
            if not _SIMPLE(text):
                text = _TAIL.sub(r" \1", lower.replace("\n", " "))
            split.append(text.replace("\n", " ").split(" "))
        if len(self.memo) > self.memo_words:
            self.memo = {"": b""}
        memo = self.memo
        new = set().union(*split).difference(memo) if split else set()
        once = {}
        if new:
            found = self._learn(list(new))
            once = {w: b for w, b in found.items() if len(w) > MEMO_CHARS}
            memo.update((w, b) for w, b in found.items() if len(w) <= MEMO_CHARS)
        if once:
            return [b"".join([memo[w] if w in memo else once[w] for w in words]) for words in split]
        return [b"".join(map(memo.__getitem__, words)) for words in split]


def _symbols(word: str) -> bool:
    """Only symbols, so the tokenizer takes it as one run."""
    return not any(c.isalnum() or c == "'" or c > "~" for c in word)
