"""Secret scan: fixed patterns, and zstandard novelty for strings in sensitive context.

The patterns find assignments, access keys and long hexadecimal runs. Beyond them, each candidate string near a
sensitive word is compressed with a dictionary made of the text around it and of common code identifiers. What
zstandard still needs for it, less what it needs for nothing, is its marginal size: words, paths and names that the
surroundings or the identifiers predict cost little, random keys cost nearly their whole length, and those are reported.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from functools import cache, lru_cache

from pyspark.sql import DataFrame, SparkSession

from .common import map_columns, read_table, whole_text

KINDS = ("assign", "access", "hex", "novel")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: A word that makes its surroundings sensitive, and what may be a secret near it.
_CONTEXT = re.compile(
    r"password|passwd|passphrase|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|credential|bearer"
    r"|authorization|auth[_-]key|client[_-]?id|session[_-]?id|signature|encryption|ssh-rsa|-----begin",
    re.IGNORECASE | re.ASCII,
)
LEAST = 16
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: The head of a PEM block, its header lines, and what separates its lines: breaks, also as written in strings.
_PEM = re.compile(r"-----BEGIN [^\r\n-]{1,64}-----", re.IGNORECASE)
_PEM_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*: ")
_PEM_BREAK = re.compile(r"[\r\n]|\\[nr]")
_PEM_TOKEN = re.compile(r"(?P<line>[\r\n]|\\[nr])|(?:[^\s\"',\\]|\\(?![nr]))+")
_PEM_PIECE = re.compile(r"[A-Za-z0-9+/=]+")
#: Characters between the end of a sensitive word, or of a secret found, and a candidate's start; the text around that
#: primes the dictionary; characters of a candidate that are judged at a time.
REACH = 48
AROUND = 512
WINDOW = 512
#: Marginal compressed bytes for each byte of a candidate from which it counts as incompressible.
NOVELTY = 0.72

#: Identifiers and words that code and configuration files are full of.
IDENTIFIERS = """
import export default function return const let var class public private static void string int bool true false null none
self this new delete try except catch finally raise throw async await yield lambda def if else elif for while switch case
username user_name password passwd passphrase secret secret_key client_secret client_id token access_token refresh_token
auth_token api_key apikey api_secret access_key access_key_id secret_access_key private_key public_key bearer authorization
credential credentials session session_id cookie signature encryption_key ssh-rsa begin rsa private key end certificate
config configuration settings environment development production staging localhost example.com http https www database
connection_string host hostname port username: password: localhost:8080 127.0.0.1 0.0.0.0 application/json content-type
get post put patch delete request response status code error message value values name names type types data index key keys
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef your_token_here your-api-key changeme
xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 00000000000000000000000000000000 ================================ --------------------------------
""".encode()


@cache
def _floor() -> int:
    """What an empty frame takes."""
    return len(_compressor(b"").compress(b""))


def _compressor(around: bytes):
    import zstandard

    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)


def novelty(candidate: str, around: str) -> float:
    """Marginal compressed bytes of the candidate, given its surroundings, for each of its bytes."""
    data = candidate.encode()
    return max(0, len(_compressor(around.encode("utf-8", "surrogatepass")).compress(data)) - _floor()) / len(data)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns; of each kind leftmost and not overlapping."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8] if ":" in text or "=" in text else []
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _without_copies(text: str, begin: int, end: int, copy: str) -> str:
    """text[begin:end] without what copies of `copy` cover, also of those that reach over its ends."""
    margin = len(copy) - 1
    out, at = [], begin
    found = text.find(copy, max(0, begin - margin), end + margin)
    while 0 <= found < end:
        out.append(text[at : max(at, found)])
        at = max(at, found + len(copy))
        found = text.find(copy, found + len(copy), end + margin)
    return " ".join([*out, text[at:end]])


def _incompressible(text: str, begin: int, end: int) -> bool:
    """Whether the candidate mixes letters and digits and a window of it is novel.

    Copies of the candidate, and of the window, are no surroundings: a key that stands twice is as novel as one.
    """
    s = text[begin:end]
    if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
        return False
    core = s.strip("=+/_-")
    core = core if len(core) >= LEAST else s
    before = _without_copies(text, max(0, begin - AROUND), begin, core)
    after = _without_copies(text, end, min(len(text), end + AROUND), core)
    # A last window shorter than a candidate is joined to the one before.
    cuts = [*range(0, max(1, len(s) - LEAST + 1), WINDOW), len(s)]
    return any(novelty(s[a:b], f"{before.replace(s[a:b], ' ')} {after.replace(s[a:b], ' ')}") >= NOVELTY for a, b in zip(cuts, cuts[1:]))


def _union(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """(begins, ends) of the disjoint intervals that the spans cover."""
    begins: list[int] = []
    ends: list[int] = []
    for a, b, _ in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


def _outside(begin: int, end: int, known: tuple[list[int], list[int]]) -> list[tuple[int, int, str]]:
    """The parts of an interval that no known span covers."""
    out, (begins, ends) = [], known
    for i in range(bisect_right(ends, begin), len(begins)):
        if begins[i] >= end:
            break
        if begins[i] > begin:
            out.append((begin, begins[i], "novel"))
        begin = ends[i]
    return [*out, (begin, end, "novel")] if begin < end else out


@lru_cache(maxsize=1)
def _line_ends(text: str) -> list[int]:
    return [m.end() for m in _PEM_BREAK.finditer(text)]


def _pem_pieces(text: str, at: int) -> list[tuple[int, int]]:
    """The lines of a PEM block's body from the end of its head on, up to a shorter one, which is the last.

    A line with blanks is a body whose breaks have become blanks, if only its last piece is short. Pieces are read one
    by one, and none beyond dashes, so heads that follow one another don't read each other's bodies.
    """
    out: list[tuple[int, int]] = []
    line: list[tuple[int, int]] = []
    while True:
        m = _PEM_TOKEN.search(text, at)
        closed = m is not None and not m["line"] and "-----" in m[0]
        if m is None or m["line"] or closed:
            if closed and (cut := m.start() + m[0].index("-----")) > m.start():
                line.append((m.start(), cut))
            whole = all(_PEM_PIECE.fullmatch(text, a, b) for a, b in line) and all(b - a >= LEAST for a, b in line[:-1])
            if not whole or (line and not out and line[0][1] - line[0][0] < LEAST):
                break
            out += line
            if m is None or closed or (line and line[-1][1] - line[-1][0] < out[0][1] - out[0][0]):
                break
            line, at = [], m.end()
        elif not out and not line and _PEM_HEADER.match(text, m.start()):
            ends = _line_ends(text)
            if (i := bisect_right(ends, m.end())) == len(ends):
                break
            at = ends[i]
        elif not _PEM_PIECE.fullmatch(m[0]) or (line and line[-1][1] - line[-1][0] < LEAST):
            break
        else:
            line.append(m.span())
            at = m.end()
    return out


def novel_spans(text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates in sensitive context that are incompressible, without what known spans cover.

    Context reaches on from every secret, so all of those that follow one another are found, and so are the parts of a
    token that dots join; the body of a PEM block goes as a whole.
    """
    out: list[tuple[int, int, str]] = []
    covered = _union(known)
    done = -1
    for word in _CONTEXT.finditer(text):
        pem = _PEM.match(text, word.start())
        if pem and pem.end() > done:
            pieces = _pem_pieces(text, pem.end())
            if any(_incompressible(text, a, b) for a, b in pieces):
                for a, b in pieces:
                    out += _outside(a, b, covered)
                done = pieces[-1][1]
                continue
        limit = word.end() + REACH
        at = max(done, word.end())
        while at <= limit:
            m = _CANDIDATE.search(text, at, min(len(text), limit + LEAST))
            if not m:
                break
            begin, end = m.start(), _CANDIDATE.match(text, m.start()).end()
            at = done = end
            if _incompressible(text, begin, end):
                out += _outside(begin, end, covered)
                limit = max(limit, end + REACH)
            elif text[end : end + 1] == ".":
                limit = max(limit, end + 1)
    return out


def written(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end, by start and kind, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def masked(text: str, spans: list[tuple[int, int, str]], mask: str = "[SECRET]") -> str:
    """The text with every span, or run of overlapping spans, replaced."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans (array of start, end, kind in code points, end exclusive) of every row.

    Kinds are assign, access, hex and novel; spans of different base kinds may overlap, novel ones overlap none. Null
    and empty texts have no spans; texts are scanned whole; repeated rows are kept; other columns are ignored.
    """

    def work(rows: dict[str, list]) -> dict[str, list]:
        out = []
        for t in rows["_text"]:
            base = base_spans(t)
            out.append([{"start": a, "end": b, "kind": k} for a, b, k in sorted(base + novel_spans(t, base))])
        return {key: rows[key], "spans": out}

    typed = df.schema[key].dataType.simpleString()
    return map_columns(df.select(key, whole_text(text).alias("_text")), f"`{key}` {typed}, spans array<struct<start:bigint,end:bigint,kind:string>>", work)


def mask_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows, all columns kept, with every secret in the text replaced by [SECRET]; null texts stay null."""
    names = df.columns

    def work(rows: dict[str, list]) -> dict[str, list]:
        got = []
        for t in rows[text]:
            base = base_spans(t) if t else []
            spans = base + novel_spans(t, base) if t else []
            got.append(masked(t, spans) if spans else t)
        return {c: got if c == text else rows[c] for c in names}

    return map_columns(df, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), work)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's spans and their digests."""
    found = scan_secrets(read_table(spark, sf_dir, "documents"))

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for k, spans in zip(rows["doc_id"], rows["spans"]):
            got = [(s["start"], s["end"], s["kind"]) for s in spans]
            base = [s for s in got if s[2] != "novel"]
            row = (k, *[sum(s[2] == kind for s in base) for kind in KINDS[:3]], hashlib.sha256(written(base).encode()).hexdigest(), written(got))
            for c, v in zip(out, row):
                out[c].append(v)
        return out

    return map_columns(found, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", work)
