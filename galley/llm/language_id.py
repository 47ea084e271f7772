"""Language identification with a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into stretches of ``span`` bytes. Two gated recurrent layers read each stretch, one forwards and
one backwards; their states together label every byte position with a probability per language, and a document's
probabilities are the mean over all its positions. The network is trained in numpy by backpropagation through time.

Arrays are laid out features first, so each time step is a few products and elementwise passes over many stretches at once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galley.llm.common import held_out, pick

#: Letters, and the number signs that Python takes for word characters as well.
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: A document whose score is below this share of what its language usually gets is in none of the learned languages.
LEAST_SHARE = 0.35


def has_letter(text: str) -> bool:
    return any(unicodedata.category(m[0])[0] == "L" for m in LETTER.finditer(text))


@dataclass
class Network:
    """Per direction: ``x`` (3h, 256) input by byte with the bias, ``u`` (3h, h) recurrence; rows are update, reset, candidate."""

    langs: list[str]
    x: list[np.ndarray]
    u: list[np.ndarray]
    v: np.ndarray  # (languages, 2h)
    c: np.ndarray  # (languages, 1)
    span: int
    usual: np.ndarray | None = None  # mean probability of each language on the stretches it was learned from

    @property
    def hidden(self) -> int:
        return self.u[0].shape[1]

    def weights(self) -> list[np.ndarray]:
        return [*self.x, *self.u, self.v, self.c]


def fresh(langs: list[str], hidden: int, span: int, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    x = [0.3 * draw(3 * hidden, 256) for _ in range(2)]
    u = [draw(3 * hidden, hidden) / np.float32(np.sqrt(hidden)) for _ in range(2)]
    return Network(langs, x, u, draw(len(langs), 2 * hidden) / np.float32(np.sqrt(2 * hidden)), np.zeros((len(langs), 1), np.float32), span)


def _scan(x: np.ndarray, u: np.ndarray, data: np.ndarray, out: np.ndarray, order: range, tape: list | None = None) -> None:
    """Run one direction over data (span, n); states go to out (h, span, n)."""
    h3, h = u.shape
    n = data.shape[1]
    state = np.zeros((h, n), np.float32)
    half = x.copy()
    half[: 2 * h] *= 0.5  # the logistic function is a shifted tanh of half its argument
    rec = u.copy()
    rec[: 2 * h] *= 0.5
    gates, back = np.empty((h3, n), np.float32), np.empty((h3, n), np.float32)
    for t in order:
        np.take(half, data[t], axis=1, out=gates, mode="clip")
        np.dot(rec, state, out=back)
        zr = gates[: 2 * h]
        zr += back[: 2 * h]
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        cand = gates[2 * h :]
        inner = back[2 * h :]
        if tape is not None:
            inner = inner.copy()
            tape.append([t, state, zr.copy(), inner, None])
            cand = cand + zr[h:] * inner
            np.tanh(cand, out=cand)
            tape[-1][4] = cand
            state = cand + zr[:h] * (state - cand)
        else:
            inner *= zr[h:]
            cand += inner
            np.tanh(cand, out=cand)
            state -= cand
            state *= zr[:h]
            state += cand
        out[:, t] = state


def _forward(net: Network, data: np.ndarray, tapes: list[list] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States (2h, span, n) and probabilities (languages, span, n) of stretches given as data (span, n)."""
    span, n = data.shape
    h = net.hidden
    states = np.empty((2 * h, span, n), np.float32)
    for side, order in enumerate((range(span), range(span - 1, -1, -1))):
        _scan(net.x[side], net.u[side], data, states[side * h : (side + 1) * h], order, tapes[side] if tapes is not None else None)
    p = net.v @ states.reshape(2 * h, span * n)
    p += net.c
    np.clip(p, -30, 30, out=p)
    np.exp(p, out=p)
    p /= p.sum(axis=0, keepdims=True)
    return states, p.reshape(len(net.langs), span, n)


def _gradients(net: Network, data: np.ndarray, valid: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over positions and its gradients, by backpropagation through time."""
    span, n = data.shape
    h = net.hidden
    tapes: list[list] = [[], []]
    states, p = _forward(net, data, tapes)
    rows = np.arange(n)
    total = max(1, int(valid.sum()))
    loss = -float((np.log(p[label, :, rows].T + 1e-9) * valid).sum()) / total
    d = p.copy()
    for k in range(len(net.langs)):
        d[k][:, label == k] -= 1
    d *= valid / np.float32(total)
    flat = d.reshape(len(net.langs), span * n)
    dv, dc = flat @ states.reshape(2 * h, span * n).T, flat.sum(axis=1, keepdims=True)
    dstates = (net.v.T @ flat).reshape(2 * h, span, n)
    dx, du = [], []
    for side in range(2):
        u, tape = net.u[side], tapes[side]
        carry = np.zeros((h, n), np.float32)
        gu = np.zeros_like(u)
        dgates = np.empty((3 * h, span, n), np.float32)
        for t, before, zr, inner, cand in reversed(tape):
            z, r = zr[:h], zr[h:]
            carry = carry + dstates[side * h : (side + 1) * h, t]
            dcand = carry * (1 - z) * (1 - cand * cand)
            dinner = dcand * r
            g = np.concatenate([carry * (before - cand) * z * (1 - z), dcand * inner * r * (1 - r), dinner])
            gu += g @ before.T
            carry = carry * z + u.T @ g
            dgates[: 2 * h, t] = g[: 2 * h]
            dgates[2 * h :, t] = dcand
        at = data.reshape(-1)
        dx.append(np.stack([np.bincount(at, row, 256) for row in dgates.reshape(3 * h, -1)]).astype(np.float32))
        du.append(gu)
    return loss, [*dx, *du, dv, dc]


def train(stretches: np.ndarray, sizes: np.ndarray, labels: np.ndarray, langs: list[str], hidden: int = 8, steps: int = 200, batch: int = 256, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam over random batches, the same number of each language; stretches (n, span) bytes of which the first ``sizes`` count."""
    net = fresh(langs, hidden, stretches.shape[1], seed)
    rng = np.random.default_rng(seed)
    by_lang = [np.flatnonzero(labels == k) for k in range(len(langs))]
    by_lang = [b for b in by_lang if len(b)]
    weights = net.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        at = np.concatenate([rng.choice(b, batch // len(by_lang) + 1) for b in by_lang])
        valid = (np.arange(net.span)[:, None] < sizes[at]).astype(np.float32)
        _, grads = _gradients(net, np.ascontiguousarray(stretches[at].T), valid, labels[at])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        speed = rate * 0.5 * (1 + np.cos(np.pi * step / steps)) * min(1.0, 1.0 / (norm + 1e-9))
        for w, g, a, b in zip(weights, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (speed * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def cut(texts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All stretches of all texts (n, span), the bytes each holds, and the text each is from."""
    sizes = np.array([len(t) for t in texts], np.int64)
    count = -(-sizes // span)
    body = np.frombuffer(b"".join(t.ljust(int(c) * span, b" ") for t, c in zip(texts, count)), np.uint8)
    owner = np.repeat(np.arange(len(texts)), count)
    rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return body.reshape(-1, span), np.minimum(span, sizes[owner] - rank * span), owner


def probabilities(net: Network, texts: list[bytes], lanes: int = 1024) -> np.ndarray:
    """Mean probabilities (texts, languages) over all byte positions; zeros for an empty text."""
    sums, sizes = np.zeros((len(texts), len(net.langs))), np.maximum(1, [len(t) for t in texts])
    # Batches of texts bound the memory; a single longer text is cut into stretches all the same.
    stretches, held, owner = cut(texts, net.span)
    for lo in range(0, len(stretches), lanes):
        data = np.ascontiguousarray(stretches[lo : lo + lanes].T)
        _, p = _forward(net, data)
        short = np.flatnonzero(held[lo : lo + lanes] < net.span)
        for k in short:
            p[:, held[lo + k] :, k] = 0
        each = p.sum(axis=1)
        for k in range(len(net.langs)):
            sums[:, k] += np.bincount(owner[lo : lo + lanes], each[k], len(texts))
    return sums / sizes[:, None]


def sample(docs: DataFrame, per_lang: int, per_doc: int, span: int, most_docs: int, key: str, text: str, lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Stretches to learn from: at most ``per_lang`` documents of each language, and fewer where there are so many languages that
    all together would be more than ``most_docs`` (but one of each); chosen by the hash of their id, ``per_doc`` stretches of
    each at places drawn from the same hash. Every labelled language is learned."""
    rows = pick(docs, key, text, lang).where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(text) != "") & ~held_out(key))
    counts = rows.groupBy(lang).count().collect()
    langs = sorted(r[lang] for r in counts)
    if not langs:
        return np.zeros((0, span), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    per_lang = max(1, min(per_lang, most_docs // len(langs)))
    # About twice as many as needed by a share of the hash (all of a rare language), then exactly as many by rank: nothing large is sorted.
    shares = [(r[lang], 1.0 if r["count"] <= 20 * per_lang and r["count"] < 1000 else min(1.0, 2.0 * per_lang / r["count"] + 0.001)) for r in counts]
    # One row per label, and the network has weights for each label anyway.
    share = docs.sparkSession.createDataFrame(shares, f"{lang} string, _share double")
    unit = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = rows.join(F.broadcast(share), lang).where(unit <= F.col("_share")).select(lang, text, F.xxhash64(F.col(key)).alias("h"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for language, body, h in zip(*(c.to_pylist() for c in batch.columns)):
                raw, rng = body.encode(), np.random.default_rng(h & 0xFFFFFFFF)
                starts = sorted(int(rng.integers(0, max(1, len(raw) - span + 1))) for _ in range(per_doc))
                out.append((language, h, [raw[a : a + span] for a in starts]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.binary()))], names=["lang", "h", "bits"]
            )

    drawn = near.mapInArrow(draw, "lang string, h long, bits array<binary>")
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "bits"))).where(F.col("rank") <= per_lang)
    found = ranked.select("lang", "bits").orderBy("lang", "rank").collect()
    bits = [bytes(b) for r in found for b in r["bits"]]
    number = {x: i for i, x in enumerate(langs)}
    labels = np.array([number[r["lang"]] for r in found for _ in r["bits"]], np.int64)
    body = np.frombuffer(b"".join(b.ljust(span, b" ") for b in bits), np.uint8).reshape(-1, span)
    return body, np.array([len(b) for b in bits], np.int64), labels, langs


def usual_scores(net: Network, body: np.ndarray, sizes: np.ndarray, labels: np.ndarray, lanes: int = 1024) -> np.ndarray:
    """Mean probability that each language's own stretches get for it."""
    sums, count = np.zeros(len(net.langs)), np.zeros(len(net.langs))
    for lo in range(0, len(body), lanes):
        _, p = _forward(net, np.ascontiguousarray(body[lo : lo + lanes].T))
        mine, held = labels[lo : lo + lanes], sizes[lo : lo + lanes]
        own = p[mine, :, np.arange(len(mine))]
        own = np.where(np.arange(own.shape[1])[None, :] < held[:, None], own, 0).sum(axis=1)
        sums += np.bincount(mine, own, len(net.langs))
        count += np.bincount(mine, held, len(net.langs))
    return sums / np.maximum(count, 1)


def fit(docs: DataFrame, per_lang: int = 600, per_doc: int = 6, span: int = 64, most_docs: int = 60_000, hidden: int = 8, steps: int = 200, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """Train on the bounded sample; None if there is nothing to learn from. Labels of held-out documents are never read."""
    body, sizes, labels, langs = sample(docs, per_lang, per_doc, span, most_docs, key, text, lang)
    if not langs:
        return None
    net = train(body, sizes, labels, langs, hidden, steps)
    net.usual = usual_scores(net, body, sizes, labels)
    return net


def identify(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, *keep, held_out, lang_pred, score, sure`` of every document; the score is the mean probability of the language, and
    it is sure if it is at least LEAST_SHARE of what that language's own stretches got when they were learned.

    Null texts and texts without a letter are ``und`` with score 0; so is everything if there was nothing to learn from.
    Repeated rows each get a row, an empty table gives none, other columns are ignored. Each task holds 200 texts at a time.
    """
    rows = pick(docs, *dict.fromkeys((key, *keep, text))).select(key, *keep, F.col(text).alias("_body"), held_out(key).alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = rows.drop("_body").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).withColumn("sure", F.lit(False)).schema
    at = rows.columns.index("_body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = part.column(at).to_pylist()
                known = [i for i, t in enumerate(texts) if model is not None and t and has_letter(t)]
                best, score, sure = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
                p = probabilities(model, [texts[i].encode() for i in known]) if known else np.zeros((0, 1))
                for i, row in zip(known, p):
                    k = int(row.argmax())
                    best[i], score[i] = model.langs[k], float(min(1.0, row[k]))
                    sure[i] = bool(row[k] >= LEAST_SHARE * model.usual[k])
                cols = [c for i, c in enumerate(part.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)
