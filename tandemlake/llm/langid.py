"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The lower-cased UTF-8 bytes of a text are cut into segments; over each, one gated recurrent layer runs forwards and one
backwards, and both states together give every byte position's language probabilities. A document's probabilities are
the mean over all its positions. Training is backpropagation through time over segments drawn from a bounded sample of
labelled documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_fold, map_columns, read_table, whole_text

#: State size of each direction, and bytes of a segment.
HIDDEN = 12
SEGMENT = 64
#: Segments that run side by side.
BATCH = 2_048
#: Labelled documents of each language that training reads, in expectation; segments drawn from each, from all over it.
SAMPLE_ROWS = 400
#: Labelled documents of all languages together: with very many languages each has its share of these.
ALL_ROWS = 120_000
SEGMENTS_EACH = 6
STEPS = 260
TRAIN_BATCH = 192
RATE = 0.02
UNKNOWN = "und"

_WORD_CHARACTERS = re.compile(r"[^\W\d_]").finditer


def has_letter(text: str) -> bool:
    """Whether a character is alphabetic; figures such as a superscript two or a circled one are not."""
    return any(m[0].isalpha() for m in _WORD_CHARACTERS(text))


@dataclass(frozen=True)
class LanguageModel:
    """x: (2, 256, 3H) input tables; u: (2, H, 3H); b: (2, 3H); w: (2H, K); c: (K,). Gates: update, reset, candidate."""

    langs: tuple[str, ...]
    x: np.ndarray
    u: np.ndarray
    b: np.ndarray
    w: np.ndarray
    c: np.ndarray


def _segments(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(segments, lengths): the bytes cut into rows of SEGMENT, the last one padded with zeros."""
    n = max(1, -(-len(data) // SEGMENT))
    rows = np.frombuffer(data + bytes(n * SEGMENT - len(data)), np.uint8).reshape(n, SEGMENT)
    lengths = np.full(n, SEGMENT)
    lengths[-1] = len(data) - (n - 1) * SEGMENT
    return rows, lengths


def _states(m, d: int, rows: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction, (L, B, H), and what backpropagation needs of each step."""
    size, length = len(rows), rows.shape[1]
    hidden = m.u.shape[1]
    table, u = m.x[d] + m.b[d], m.u[d]
    h = np.zeros((size, hidden), np.float32)
    out, saved = np.empty((length, size, hidden), np.float32), []
    order = range(length) if d == 0 else range(length - 1, -1, -1)
    full = bool(live.all())
    for t in order:
        a = table[rows[:, t]]
        v = h @ u
        gates = np.tanh((a[:, : 2 * hidden] + v[:, : 2 * hidden]) * np.float32(0.5))
        gates *= np.float32(0.5)
        gates += np.float32(0.5)
        z, r = gates[:, :hidden], gates[:, hidden:]
        n = np.tanh(a[:, 2 * hidden :] + r * v[:, 2 * hidden :])
        new = n + z * (h - n)
        if not full:
            new = np.where(live[:, t, None], new, h)
        if keep:
            saved.append((t, h, z, r, n, v[:, 2 * hidden :]))
        out[t] = h = new
    return out, saved


def position_probabilities(m: LanguageModel, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(B, L, K) language probabilities of every byte position; positions past a segment's length are zero."""
    live = np.arange(rows.shape[1]) < lengths[:, None]
    hidden = m.u.shape[1]
    z = _states(m, 0, rows, live, False)[0] @ m.w[:hidden]
    z += _states(m, 1, rows, live, False)[0] @ m.w[hidden:]
    z += m.c
    z -= z.max(axis=2, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=2, keepdims=True)
    z *= live.T[:, :, None]
    return z.transpose(1, 0, 2)


def document_probabilities(m: LanguageModel, texts: list[str]) -> np.ndarray:
    """(texts, K): the mean over all byte positions of each whole text."""
    total = np.zeros((len(texts), len(m.langs)))
    size = np.zeros(len(texts))
    rows, lengths, owner, held = [], [], [], 0

    def flush():
        r, n, o = np.concatenate(rows), np.concatenate(lengths), np.concatenate(owner)
        for at in range(0, len(r), BATCH):
            p = position_probabilities(m, r[at : at + BATCH], n[at : at + BATCH]).sum(axis=1)
            np.add.at(total, o[at : at + BATCH], p)

    for i, text in enumerate(texts):
        r, n = _segments(text.lower().encode("utf-8", "surrogatepass"))
        size[i] = n.sum()
        rows.append(r)
        lengths.append(n)
        owner.append(np.full(len(r), i))
        held += len(r)
        if held >= 4 * BATCH:
            flush()
            rows, lengths, owner, held = [], [], [], 0
    if rows:
        flush()
    return total / np.maximum(size, 1)[:, None]


def gradients(m: LanguageModel, rows: np.ndarray, live: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy over all live positions, for x, u, b, w and c."""
    hd = m.u.shape[1]
    params = [m.x, m.u, m.b, m.w, m.c]
    runs = [_states(m, d, rows, live, True) for d in (0, 1)]
    p = runs[0][0] @ m.w[:hd] + runs[1][0] @ m.w[hd:] + m.c
    p = np.exp(p - p.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    p[:, np.arange(len(y)), y] -= 1
    p *= (live.T / live.sum()).astype(np.float32)[:, :, None]
    grads = [np.zeros_like(q) for q in params]
    grads[4] += p.sum(axis=(0, 1))
    for d, (states, saved) in enumerate(runs):
        w = m.w[d * hd : (d + 1) * hd]
        grads[3][d * hd : (d + 1) * hd] = np.einsum("tbh,tbk->hk", states, p, optimize=True)
        from_above = p @ w.T
        dh = np.zeros((len(y), hd), np.float32)
        for t, h, z, r, n, vn in reversed(saved):
            dh = dh + from_above[t]
            on = live[:, t, None]
            dn = dh * (1 - z) * on
            dz = dh * (h - n) * z * (1 - z) * on
            da = dn * (1 - n * n)
            dr = da * vn * r * (1 - r)
            flat = np.concatenate([dz, dr, da], axis=1)
            into = np.concatenate([dz, dr, da * r], axis=1)
            np.add.at(grads[0][d], rows[:, t], flat)
            grads[1][d] += h.T @ into
            grads[2][d] += flat.sum(axis=0)
            dh = into @ m.u[d].T + np.where(on, dh * z, dh)
    return grads


def fit(segments: np.ndarray, lengths: np.ndarray, labels: np.ndarray, langs: tuple[str, ...], steps: int = STEPS, seed: int = 7) -> LanguageModel:
    """Adam on the mean cross-entropy of all positions, gradients by backpropagation through time."""
    rng = np.random.default_rng(seed)
    k, hd = len(langs), HIDDEN
    start = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    m = LanguageModel(
        langs, start(2, 256, 3 * hd, scale=0.3), start(2, hd, 3 * hd, scale=hd**-0.5), np.zeros((2, 3 * hd), np.float32),
        start(2 * hd, k, scale=0.3), np.zeros(k, np.float32),
    )
    params = [m.x, m.u, m.b, m.w, m.c]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    groups = [np.flatnonzero(labels == i) for i in range(k)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, -(-TRAIN_BATCH // k)) for g in groups])
        rows, live, y = segments[pick], np.arange(SEGMENT) < lengths[pick, None], labels[pick]
        grads = gradients(m, rows, live, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, step / 20) * (0.1 if step > 0.8 * steps else 1.0)
        for q, g, a, b in zip(params, grads, first, second):
            g *= min(1.0, 1.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


def train_languages(docs: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """Fit on rows for which `learn` holds and lang is not null; some `sample_rows` of each language are read.

    docs: doc_id, text, lang. Every language is learned, however rare: of more than ALL_ROWS / sample_rows languages each
    has fewer rows. None without a labelled text that has a letter.
    """
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return None
    each = max(1, min(sample_rows, ALL_ROWS // len(sizes)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) / 1e6
    chances = docs.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in sizes.items()], "lang string, chance double")
    known = known.select("doc_id", "text", "lang").join(F.broadcast(chances), "lang")  # a row a language
    # The places of the segments within a text: evenly spread over all of it.
    n = F.length("text")
    places = F.transform(
        F.sequence(F.lit(0), F.lit(SEGMENTS_EACH - 1)),
        lambda i: F.substring(F.col("text"), (F.greatest(n - SEGMENT, F.lit(0)) * i / (SEGMENTS_EACH - 1)).cast("int") + 1, F.lit(SEGMENT)),
    )
    rows = known.filter(F.coalesce(draw < F.col("chance"), F.lit(False))).select("doc_id", "lang", places.alias("parts")).orderBy("doc_id").limit(4 * each * len(sizes)).collect()
    langs = tuple(sorted({r["lang"] for r in rows}))
    cut = [(p.lower().encode("utf-8", "surrogatepass")[:SEGMENT], langs.index(r["lang"])) for r in rows for p in set(r["parts"]) if has_letter(p)]
    if not cut:
        return None
    segments, lengths = (np.concatenate(x) for x in zip(*[_segments(p) for p, _ in cut]))
    labels = np.array([y for _, y in cut])
    present = sorted(set(labels.tolist()))
    return fit(segments, lengths, np.searchsorted(present, labels), tuple(langs[i] for i in present))


def predict_languages(docs: DataFrame, model: LanguageModel | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns `keep`, lang_pred and score, the pooled probability of the predicted language.

    Texts that are null or have no letter get `und` with score 0, as do all texts without a model. Ties go to the
    language first in the alphabet. Repeated rows are kept and get equal predictions.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers
    names = [key, *keep]

    def work(rows: dict[str, list]) -> dict[str, list]:
        m = shared.value
        pred, score = [UNKNOWN] * len(rows["_text"]), [0.0] * len(rows["_text"])
        known = [i for i, t in enumerate(rows["_text"]) if m is not None and has_letter(t)]
        if known:
            p = document_probabilities(m, [rows["_text"][i] for i in known])
            for i, best, q in zip(known, p.argmax(axis=1), p.max(axis=1)):
                pred[i], score[i] = m.langs[best], float(min(1.0, q))
        return {c: rows[c] for c in names} | {"lang_pred": pred, "score": score}

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", lang_pred string, score double"
    return map_columns(docs.select(*names, whole_text(text).alias("_text")), schema, work)


def language_runs(docs: DataFrame, model: LanguageModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, runs: (start, end, lang) of byte positions in the lower-cased text with the same label, end exclusive.

    Null and empty texts, and all texts without a model, have no runs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def runs(t: str) -> list[dict]:
        m = shared.value
        if m is None or not t:
            return []
        rows, lengths = _segments(t.lower().encode("utf-8", "surrogatepass"))
        best = np.concatenate([position_probabilities(m, rows[a : a + BATCH], lengths[a : a + BATCH]).argmax(axis=2).ravel() for a in range(0, len(rows), BATCH)])
        best = best[: int(lengths.sum())]
        ends = np.flatnonzero(np.append(best[1:] != best[:-1], True)) + 1
        return [{"start": int(a), "end": int(b), "lang": m.langs[best[a]]} for a, b in zip([0, *ends[:-1]], ends)]

    def work(rows: dict[str, list]) -> dict[str, list]:
        return {key: rows[key], "runs": [runs(t) for t in rows["_text"]]}

    typed = docs.schema[key].dataType.simpleString()
    return map_columns(docs.select(key, whole_text(text).alias("_text")), f"`{key}` {typed}, runs array<struct<start:bigint,end:bigint,lang:string>>", work)


def held_out() -> Column:
    return F.coalesce(id_fold("doc_id", 3) == 1, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_languages(docs, ~held_out())
    return predict_languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
