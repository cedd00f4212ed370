"""License scan: ordered signature rules with a keyword prefilter.

A text is reduced to its words in lower case. Of the rules whose keyword occurs, each finds its places; detections are
taken by priority (group, then length, then place), and one whose words lie within those of a detection taken before is
suppressed. Base phrases are counted apart from that and are always reported.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cache

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, read_table, whole_text
from .license_rules import GROUPS

#: The phrases that are always counted, with their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: How sure a detection of a group makes of a license, and what a base phrase does.
TRUST = (0.95, 0.95, 0.98, 0.9, 0.6)
BASE_TRUST = 0.6

#: Words are runs of 0-9, a-z and characters beyond ASCII, after A-Z has become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str) -> tuple[str, int]:
    """The words with a blank before each and one at the end, and their number."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass"), len(words)


@cache
def rules() -> tuple[tuple[int, str, str, re.Pattern], ...]:
    """(priority, label, keyword, regex) in order."""
    out = []
    for priority, group in enumerate(GROUPS):
        for line in filter(None, group.split("\n")):
            label, keyword, regex = line.split(" | ")
            out.append((priority, label, keyword, re.compile(f"(?<= )(?:{regex})(?= )")))
    return tuple(out)


@cache
def keywords() -> dict[str, tuple[int, ...]]:
    found: dict[str, list[int]] = {}
    for i, (_, _, keyword, _) in enumerate(rules()):
        found.setdefault(keyword, []).append(i)
    return {k: tuple(v) for k, v in found.items()}


@cache
def gate():
    """An automaton of all keywords: one pass tells which occur."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for keyword in keywords():
        automaton.add_word(keyword, keyword)
    automaton.make_automaton()
    return automaton


class Places:
    """Words before a place in the words' text, counted once for the whole text when the first is asked for."""

    def __init__(self, words: str):
        self.words, self.blanks = words, None

    def before(self, char: int) -> int:
        if self.blanks is None:
            self.blanks = np.flatnonzero(np.frombuffer(self.words.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        return int(np.searchsorted(self.blanks, char))


class Cover:
    """Intervals, and whether one lies within any of them.

    Of the intervals only those are kept that no other one contains: with their begins their ends ascend too, so the
    last one that begins in time has the farthest end.
    """

    def __init__(self):
        self.begins: list[int] = []
        self.ends: list[int] = []

    def holds(self, begin: int, end: int) -> bool:
        i = bisect_right(self.begins, begin) - 1
        return i >= 0 and self.ends[i] >= end

    def add(self, begin: int, end: int) -> None:
        """An interval that none holds."""
        i = bisect_left(self.begins, begin)
        j = bisect_right(self.ends, end, lo=i)
        self.begins[i:j], self.ends[i:j] = [begin], [end]


def base_places(words: str, places: Places | None = None) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase stands."""
    out, places = [], places or Places(words)
    for phrase, label in BASE:
        at = words.find(f" {phrase} ")
        while at >= 0:
            out.append((places.before(at), label))
            at = words.find(f" {phrase} ", at + 1)
    return sorted(out)


def detections(words: str, places: Places | None = None) -> list[tuple[int, int, str, int]]:
    """(first word, end word, label, priority) that remain after suppression, by place."""
    places = places or Places(words)
    present = {keyword for _, keyword in gate().iter(words)}
    found = []
    for i in sorted(i for k in present for i in keywords()[k]):
        priority, label, _, regex = rules()[i]
        found += [(priority, m.start() - m.end(), m.start(), m.end(), i, label) for m in regex.finditer(words)]
    taken, cover = [], Cover()
    for priority, _, begin, end, _, label in sorted(found):
        if not cover.holds(begin, end):
            cover.add(begin, end)
            taken.append((begin, end, label, priority))
    return [(places.before(a) - 1, places.before(b), label, p) for a, b, label, p in sorted(taken)]


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score, found of every row.

    found: array of (begin, end, label), word intervals with the end exclusive. score: 0 without a detection, else
    one less the product of the detections' doubts. Null and empty texts have no words and no detections; texts are
    scanned whole, however long; repeated rows are kept; other columns are ignored.
    """

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in (key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found")}
        for k, t in zip(rows[key], rows["_text"]):
            words, n = words_of(t)
            places = Places(words)
            base = base_places(words, places)
            found = detections(words, places)
            doubt = (1 - BASE_TRUST) if base else 1.0
            for *_, p in found:
                doubt *= 1 - TRUST[p]
            row = (
                k, n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})),
                ",".join(sorted({x for _, x in base} | {x for _, _, x, _ in found})), 1.0 - doubt, [(a, b, x) for a, b, x, _ in found],
            )
            for c, v in zip(out, row):
                out[c].append(v)
        out["found"] = [[{"begin": a, "end": b, "label": x} for a, b, x in v] for v in out["found"]]
        return out

    typed = df.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {typed}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, found array<struct<begin:bigint,end:bigint,label:string>>"
    )
    return map_columns(df.select(key, whole_text(text).alias("_text")), schema, work)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("found")


