"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads a whole text's bytes in both directions and labels every position with a probability for each language; a
document's probabilities are the mean over all its positions that hold a letter. So that a text of any length is read
in parallel, it is read in chunks: the state that enters a chunk comes from the CONTEXT bytes beside it, so each
label rests on at least that many bytes on either side, across words and chunks. Training is backpropagation through time
with Adam on a bounded, documented sample of labelled rows.

For reading, weights are multiples of 1/64 and states of 1/1024: sums of their products are exact in single precision
whatever their order, so a text's numbers do not depend on what is read beside it, nor on how rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandfold.llm.common import fresh, spread, text_slices

UNKNOWN = "und"
CHUNK, CONTEXT, ROWS = 256, 32, 1024
#: No byte of UTF-8 has this value.
NONE = 255
_LETTER = np.array([chr(b).isalpha() if b < 128 else b != NONE for b in range(256)])


@dataclass
class Model:
    """Weights (float32) and the learned language values."""

    langs: list[str]
    weights: dict[str, np.ndarray]


def _gate(x: np.ndarray) -> np.ndarray:
    """Piecewise linear sigmoid, several times cheaper than an exponential."""
    return np.clip(0.25 * x + 0.5, 0, 1)


def _gate_slope(g: np.ndarray) -> np.ndarray:
    return np.where((g > 0) & (g < 1), np.float32(0.25), np.float32(0))


def _run(w: dict, d: str, gates: np.ndarray, keep: bool = False):
    """One direction over input gates (steps, batch, 3 hidden): hidden states, and what backward needs."""
    steps, batch, n = gates.shape[0], gates.shape[1], w["u" + d].shape[0]
    h = np.zeros((batch, n), np.float32)
    out, kept = np.empty((steps, batch, n), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        zr = _gate(gates[t, :, : 2 * n] + h @ w["u" + d][:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(gates[t, :, 2 * n :] + (r * h) @ w["u" + d][:, 2 * n :])
        new = h + z * (c - h)
        if keep:
            kept.append((t, h, z, r, c))
        h = new
        out[t] = h
    return out, kept


def _on_grid(x: np.ndarray) -> np.ndarray:
    """States between -1 and 1 as multiples of 1/1024."""
    x *= np.float32(1024)
    np.rint(x, out=x)
    x *= np.float32(1 / 1024)
    return x


def _coarse(u: np.ndarray) -> np.ndarray:
    """Weights as multiples of 1/64, at most 16: with states on their grid, 16 products add up exactly."""
    return np.clip(np.rint(u * 64), -1024, 1024).astype(np.float32) / np.float32(64)


def _read(w: dict, d: str, ids: np.ndarray, first: int, last: int) -> np.ndarray:
    """Hidden states (steps first to last, batch, hidden) of one direction over ids (steps, batch). Before a text's first
    byte (in reading order) the state stays zero."""
    # A byte's input gates are one row of a table of 256; the gates' slope and middle are in the tables as well.
    n, u = w["u" + d].shape[0], w["u" + d]
    table = (w["e"] @ w["w" + d] + w["b" + d]).astype(np.float32)
    gates, rest = np.ascontiguousarray(table[:, : 2 * n] * np.float32(0.25) + np.float32(0.5)), np.ascontiguousarray(table[:, 2 * n :])
    u_gates, u_rest = np.ascontiguousarray(_coarse(u[:, : 2 * n]) * np.float32(0.25)), np.ascontiguousarray(_coarse(u[:, 2 * n :]))
    h = np.zeros((ids.shape[1], n), np.float32)
    out = np.empty((last - first, ids.shape[1], n), np.float32)
    inside = ids != NONE
    full = inside.all(axis=1)
    for t in range(last) if d == "f" else range(len(ids) - 1, first - 1, -1):
        zr = gates.take(ids[t], axis=0)
        zr += h @ u_gates
        np.clip(zr, 0, 1, out=zr)
        c = rest.take(ids[t], axis=0)
        c += _on_grid(zr[:, n:] * h) @ u_rest
        np.tanh(c, out=c)
        c -= h
        c *= zr[:, :n]
        h = _on_grid(h + c)
        if not full[t]:
            h *= inside[t, :, None]
        if first <= t < last:
            out[t - first] = h
    return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Over the first axis."""
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def _chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of each row, first byte of each row's chunk, ids (CONTEXT + chunk + CONTEXT, ROWS)) of all texts' chunks."""
    n = -(-np.diff(offsets) // CHUNK)
    text = np.repeat(np.arange(len(n)), n)
    start = offsets[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * CHUNK
    size = np.minimum(offsets[text + 1] - start, CHUNK)
    order = np.argsort(size, kind="stable")
    for at in range(0, len(order), ROWS):
        rows = order[at : at + ROWS]
        steps = 2 * CONTEXT + int(size[rows].max())
        place = start[rows] - CONTEXT + np.arange(steps)[:, None]
        ids = np.full((steps, ROWS), NONE, np.uint8)
        inside = (place >= offsets[text[rows]]) & (place < offsets[text[rows] + 1])
        ids[:, : len(rows)] = np.where(inside, data[np.clip(place, 0, len(data) - 1)], NONE)
        yield text[rows], start[rows], ids


def _labels(w: dict, ids: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
    """(first step, probabilities (languages, steps, batch)) of the chunk's steps, some at a time."""
    end, batch, o = len(ids) - CONTEXT, ids.shape[1], _coarse(w["o"]).T
    both = np.concatenate([_read(w, d, ids, CONTEXT, end) for d in "fb"], axis=2)
    some = max(1, most // (batch * len(o)))
    for t in range(0, len(both), some):
        part = both[t : t + some]
        yield t, _softmax((o @ part.reshape(-1, part.shape[2]).T + w["ob"][:, None]).reshape(len(o), len(part), batch))


def _gradients(w: dict, ids: np.ndarray, target: np.ndarray) -> tuple[dict, float]:
    """Backpropagation through time of the mean cross-entropy over all positions."""
    steps, batch = ids.shape
    x = w["e"][ids]
    runs = {d: _run(w, d, x @ w["w" + d] + w["b" + d], True) for d in "fb"}
    both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
    logits = both @ w["o"] + w["ob"]
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    loss = -float(np.log(p[:, np.arange(batch), target] + 1e-9).mean())
    p[:, np.arange(batch), target] -= 1
    p /= steps * batch
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["o"] = np.einsum("tbh,tbl->hl", both, p)
    g["ob"] = p.sum(axis=(0, 1))
    d_both = p @ w["o"].T
    n = w["uf"].shape[0]
    d_x = np.zeros_like(x)
    for k, d in enumerate("fb"):
        u, d_h = w["u" + d], np.zeros((batch, n), np.float32)
        for t, h, z, r, c in reversed(runs[d][1]):
            d_h = d_h + d_both[t, :, k * n : (k + 1) * n]
            d_c = d_h * z * (1 - c * c)
            d_rh = d_c @ u[:, 2 * n :].T
            d_z = d_h * (c - h) * _gate_slope(z)
            d_r = d_rh * h * _gate_slope(r)
            d_gate = np.concatenate([d_z, d_r, d_c], axis=1)
            g["u" + d][:, : 2 * n] += h.T @ d_gate[:, : 2 * n]
            g["u" + d][:, 2 * n :] += (r * h).T @ d_c
            g["w" + d] += x[t].T @ d_gate
            g["b" + d] += d_gate.sum(axis=0)
            d_x[t] += d_gate @ w["w" + d].T
            d_h = d_h * (1 - z) + d_rh * r + d_gate[:, : 2 * n] @ u[:, : 2 * n].T
    np.add.at(g["e"], ids, d_x)
    return g, loss


def fit(texts: list[tuple[str, str]], hidden: int = 8, embedding: int = 10, steps: int = 550, batch: int = 128, length: int = 40, seed: int = 7) -> Model:
    """Train on (text, language) pairs. Batches hold windows of `length` bytes, as many of each language."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in texts})
    data = []
    for lang in langs:
        own = np.frombuffer(b"\n".join(t.encode() for t, x in texts if x == lang) + b"\n", np.uint8)
        data.append(np.tile(own, -(-length // len(own))))
    init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"e": init(256, embedding) * 4, "o": init(2 * hidden, len(langs)), "ob": np.zeros(len(langs), np.float32)}
    for d in "fb":
        w |= {"w" + d: init(embedding, 3 * hidden), "u" + d: init(hidden, 3 * hidden), "b" + d: np.zeros(3 * hidden, np.float32)}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        target = rng.integers(len(langs), size=batch)
        ids = np.empty((length, batch), np.uint8)
        for k, t in enumerate(target.tolist()):
            at = rng.integers(len(data[t]) - length + 1)
            ids[:, k] = data[t][at : at + length]
        g, _ = _gradients(w, ids, target)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = 0.01 * min(1, 2 * (1 - step / (steps + 1)))
        for k, x in g.items():
            x = x * min(1, 1 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(langs, w)


def pooled(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, languages): the mean label probabilities over the positions of each text that hold a letter."""
    total, n = np.zeros((len(offsets) - 1, len(model.langs))), np.zeros(len(offsets) - 1)
    for text, _, ids in _chunks(data, offsets):
        letter = _LETTER[ids[CONTEXT : len(ids) - CONTEXT, : len(text)]]
        own = np.zeros((len(text), len(model.langs)), np.int64)
        for t, p in _labels(model.weights, ids):
            # Whole numbers add up to the same in any order.
            p = p[:, :, : len(text)] * (letter[t : t + p.shape[1]] * np.float32(1 << 20))
            own += np.rint(p, out=p).sum(axis=1, dtype=np.float64).astype(np.int64).T
        np.add.at(total, text, own)
        np.add.at(n, text, letter.sum(axis=0))
    return total / (np.maximum(n, 1) * (1 << 20))[:, None]


def training_rows(df: DataFrame, text: str, lang: str, per_language: int, languages: int = 1000) -> list[tuple[str, str]]:
    """At most about `per_language` different whole texts of each language, chosen by a hash of the text; of the
    `languages` with the most different texts, ties by name, if there are more."""
    own = df.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null and t != ''")
    h = F.xxhash64("t", F.lit(11))
    # Only different texts count: copies hash alike and are one text of the sample.
    counts = {r["l"]: r["n"] for r in own.groupBy("l").agg(F.countDistinct(h).alias("n")).orderBy(F.desc("n"), "l").limit(languages).collect()}
    if not counts:
        return []
    every = F.coalesce(*(F.when(F.col("l") == k, F.lit(max(1, n // per_language))) for k, n in counts.items()))
    # A language of few texts may have none at a multiple of the step; its smallest hash is taken as well.
    own = own.where(F.col("l").isin(list(counts)))
    least = own.groupBy("l").agg(F.min(h).alias("least"))
    picked = own.withColumn("h", h).join(F.broadcast(least), "l").where((F.pmod("h", every) == 0) | (F.col("h") == F.col("least")))
    rows = picked.select("t", "l", "h").dropDuplicates(["h", "l"]).orderBy("h", "l").collect()
    # Hashes are even, so twice the number wanted is not exceeded in practice; the rows of a language beyond it are left.
    kept, taken = [], dict.fromkeys(counts, 0)
    for r in rows:
        taken[r["l"]] += 1
        if taken[r["l"]] <= 2 * per_language:
            kept.append((r["t"], r["l"]))
    return kept


def train(df: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 300, languages: int = 1000, **options) -> Model | None:
    """Fit on a sample of about `per_language` labelled texts of each language; None if there is no labelled text.

    Only the `languages` with the most different texts are learned (bound of the sample and of the network's last layer);
    texts of any other are predicted like all texts, as the learned language that their bytes are most like.
    """
    rows = training_rows(df, text, lang, per_language, languages)
    return fit(rows, **options) if rows else None


def predict(df: DataFrame, model: Model | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """df with lang_pred and score (0 to 1): the language of the largest pooled probability over the whole text.

    A text that is null or has no letter, and every text if there is no model, gives `und` with score 0. Ties go to the
    first language in alphabetical order. Rows are independent and keep their number; repeated rows give equal results;
    columns named lang_pred or score are replaced. keep_text=False leaves the text out.
    """
    df = df.select(*(c for c in df.columns if c.lower() not in ("lang_pred", "score")))
    kept = [c for c in df.columns if keep_text or c != text]
    (letter,) = fresh(df, "has_letter")
    schema = ", ".join([*([df.select(*kept)._jdf.schema().toDDL()] if kept else []), "lang_pred string, score double"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = batch.column(letter).to_numpy(zero_copy_only=False)
            names, scores = np.full(len(has), UNKNOWN, object), np.zeros(len(has))
            for i, j, data, offsets in text_slices(batch, text) if model else ():
                p = pooled(model, data, offsets)
                best = p.argmax(axis=1)
                known = has[i:j]
                names[i:j][known] = np.array(model.langs, object)[best[known]]
                scores[i:j][known] = np.minimum(p.max(axis=1)[known], 1.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores)], names=[*kept, "lang_pred", "score"])

    return spread(df).withColumn(letter, F.coalesce(F.rlike(F.col(text), F.lit(r"\p{L}")), F.lit(False))).mapInArrow(work, schema)


def label_positions(text: Column, model: Model) -> Column:
    """array<struct<start,end,lang>>: the label of every byte of the text, equal neighbours as one run. A null or empty text
    has none; rows are independent, so repeated rows give equal results and an empty table gives no rows."""

    @F.pandas_udf("array<struct<start:int,end:int,lang:string>>")
    def label(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            data = np.frombuffer((t or "").encode(), np.uint8)
            best = np.zeros(len(data), np.int64)
            for rows, start, ids in _chunks(data, np.array([0, len(data)])):
                for t0, p in _labels(model.weights, ids):
                    place = start + t0 + np.arange(p.shape[1])[:, None]
                    inside = ids[CONTEXT + t0 : CONTEXT + t0 + p.shape[1], : len(rows)] != NONE
                    best[place[inside]] = p[:, :, : len(rows)].argmax(axis=0)[inside]
            cuts = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)] if len(best) else [0]
            out.append([{"start": a, "end": b, "lang": model.langs[best[a]]} for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        return pd.Series(out)

    return label(text)


def keep_known(df: DataFrame, model: Model | None, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows whose language is identified with a pooled probability of at least `least`; columns as in df. Null and empty
    texts and texts without a letter go; repeated rows and null keys are judged like any other; an empty table, and any
    table without a model, gives an empty one."""
    found = predict(df, model, text)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*df.columns)
