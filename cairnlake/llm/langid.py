"""Language identification by a byte convolutional network, trained and applied in numpy.

A text, in lower case, is its UTF-8 bytes cut into windows of WINDOW bytes, the last padded
with zeros. Filters of the widths in WIDTHS slide over one-hot bytes, each filter's largest
response in a window (max pooling, not below 0) is a feature, and a softmax over a linear
layer gives the languages' probabilities. A text's answer is the mean of its windows'
log-probabilities, weighted by their bytes. All windows of all texts are looked at.

Training uses a bounded sample: at most PER_LANG texts of each language, those whose text has
the least hash, and of each text at most SNIPPETS pieces of WINDOW characters, evenly spread.
Only text and lang of rows that aren't held out are learnt from; lang, source and doc_id are no
inputs of a prediction. A count for each language sets a bound on the hash that lets about four
times as many rows pass as are wanted, so that what is shuffled doesn't grow with the table.

Cases: a null text, or one without a letter, is "und" with score 0, and so is every text if
there is nothing to learn from; rows without a lang are predicted but not learnt from; a null
doc_id isn't held out and isn't learnt from; repeated rows are answered alike; other columns
are ignored. Equal probabilities go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workers import let_workers_import
from .common import cut, table

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
PER_LANG, SNIPPETS, EPOCHS, SEED = 1500, 3, 4, 20
#: The counts of so many languages, 1 MB at most, are broadcast; those of more are joined by a shuffle.
MANY_LANGS = 10_000


@dataclass
class Network:
    langs: list[str]
    filters: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, the text that each is of, and its count of bytes."""
    size = np.array([len(t) for t in texts], np.int64)
    per = np.maximum(-(-size // WINDOW), 1)
    start = np.cumsum(per) - per
    out = np.zeros(int(per.sum()) * WINDOW, np.uint8)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    shift = start * WINDOW - (np.cumsum(size) - size)
    out[np.arange(len(flat)) + np.repeat(shift, size)] = flat
    owner = np.repeat(np.arange(len(texts)), per)
    left = size[owner] - (np.arange(len(owner)) - start[owner]) * WINDOW
    return out.reshape(-1, WINDOW), owner, np.clip(left, 1, WINDOW)


def _responses(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    span = WINDOW - len(w) + 1
    return sum(np.take(w[k], x[:, k : k + span], axis=0) for k in range(len(w)))


def loss_and_gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The weighted mean cross entropy of windows x with languages y, and its gradient."""
    n, seen = len(x), np.arange(FILTERS)
    places, pooled = {}, []
    for w in WIDTHS:
        r = _responses(x, p[f"w{w}"])
        places[w] = r.argmax(axis=1)
        pooled.append(np.take_along_axis(r, places[w][:, None, :], 1)[:, 0])
    h = np.concatenate(pooled, 1) + p["b"]
    a = np.maximum(h, 0)
    z = a @ p["d"] + p["e"]
    z = np.exp(z - z.max(1, keepdims=True))
    z /= z.sum(1, keepdims=True)
    loss = -(weight * np.log(z[np.arange(n), y])).sum() / n
    z[np.arange(n), y] -= 1
    z *= weight[:, None] / n
    g = {"d": a.T @ z, "e": z.sum(0)}
    back = (z @ p["d"].T) * (h > 0)
    g["b"] = back.sum(0)
    for k, w in enumerate(WIDTHS):
        gw = np.zeros_like(p[f"w{w}"])
        own = back[:, k * FILTERS : (k + 1) * FILTERS]
        for j in range(w):
            np.add.at(gw[j], (np.take_along_axis(x, places[w] + j, 1), seen[None, :]), own)
        g[f"w{w}"] = gw
    return float(loss), g


def train(texts: list[str], labels: list[str]) -> Network:
    rng = np.random.default_rng(SEED)
    langs = sorted(set(labels))
    x, owner, _ = windows([t.lower().encode()[:WINDOW] for t in texts])
    y = np.array([langs.index(v) for v in labels])[owner]
    total = FILTERS * len(WIDTHS)
    p = {f"w{w}": rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    p |= {"b": np.zeros(total, np.float32), "d": rng.normal(0, 0.1, (total, len(langs))).astype(np.float32), "e": np.zeros(len(langs), np.float32)}
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    weight = (len(y) / np.maximum(np.bincount(y, minlength=len(langs)), 1) / len(langs)).astype(np.float32)
    step, batch = 0, 64
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            i = order[at : at + batch]
            _, g = loss_and_gradient(p, x[i], y[i], weight[y[i]])
            step += 1
            rate = 0.01 / (1 + epoch)
            for k, v in g.items():
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.001 * (v * v - s[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Network(langs, {w: p[f"w{w}"] for w in WIDTHS}, p["b"], p["d"], p["e"])


class Predictor:
    """The network with its filters' first two (and last two) bytes in tables by byte pair."""

    def __init__(self, net: Network):
        self.net = net
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        f = net.filters
        self.tables = {w: (pair(v[0], v[1]), v[2] if w == 3 else pair(v[2], v[3]) if w == 4 else None) for w, v in f.items()}

    def features(self, x: np.ndarray) -> np.ndarray:
        pairs = x[:, :-1].astype(np.uint16) * 256 + x[:, 1:]
        out = []
        for w in WIDTHS:
            first, last = self.tables[w]
            span = WINDOW - w + 1
            r = np.take(first, pairs[:, :span], axis=0)
            if w == 3:
                r += np.take(last, x[:, 2 : 2 + span], axis=0)
            elif w == 4:
                r += np.take(last, pairs[:, 2 : 2 + span], axis=0)
            out.append(r.max(axis=1))
        return np.maximum(np.concatenate(out, 1) + self.net.bias, 0)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        x, owner, weight = windows(texts)
        logs = np.empty((len(x), len(self.net.langs)))
        for at in range(0, len(x), 256):
            z = self.features(x[at : at + 256]) @ self.net.dense + self.net.dense_bias
            z = z - z.max(1, keepdims=True)
            logs[at : at + 256] = z - np.log(np.exp(z).sum(1, keepdims=True))
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        mean = np.add.reduceat(logs * weight[:, None], start) / np.add.reduceat(weight, start)[:, None]
        chance = np.exp(mean - mean.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        best = chance.argmax(1)
        return [self.net.langs[b] for b in best], chance[np.arange(len(best)), best]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list[str], list[str]]:
    """The bounded sample that the network learns from: snippets and their languages."""
    text, n = F.col("text"), F.length("text")
    own = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = cut(own.groupBy("lang").agg(F.count(F.lit(1)).alias("__n")))
    counts = F.broadcast(counts) if counts.count() <= MANY_LANGS else counts
    # About four times the rows wanted pass by their hash, whatever the size of the table.
    h = F.xxhash64("text", "doc_id")
    near = (h / 2.0**64 + 0.5) * F.col("__n") < 4 * per_lang
    snippets = F.array_distinct(F.array(*[F.substring(text, (F.greatest(n - WINDOW, F.lit(0)) * (k / max(SNIPPETS - 1, 1))).cast("int") + 1, F.lit(WINDOW)) for k in range(SNIPPETS)]))
    few = own.select("lang", "doc_id", "text").join(counts, "lang").where(near & text.rlike(r"\p{L}")).select("lang", h.alias("h"), snippets.alias("cut"))
    by = Window.partitionBy("lang").orderBy("h", "cut")
    rows = few.withColumn("n", F.row_number().over(by)).where(F.col("n") <= per_lang).select("lang", F.explode("cut").alias("t"))
    got = sorted((r.lang, r.t) for r in rows.where(F.col("t").rlike(r"\p{L}")).collect())
    return [t for _, t in got], [v for v, _ in got]


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; trains on docs if no network is given."""
    let_workers_import(docs.sparkSession)
    if net is None:
        texts, labels = sample(docs)
        net = train(texts, labels) if texts else None
    model = docs.sparkSession.sparkContext.broadcast(net)  # 150 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = None if model.value is None else Predictor(model.value)
        for batch in batches:
            raw = batch.column("text").to_pylist()
            lang, score = ["und"] * len(raw), np.zeros(len(raw))
            known = [k for k, t in enumerate(raw) if t is not None] if predictor else []
            at = 0
            while at < len(known):  # about 4 MB of text at a time
                end, size = at, 0
                while end < len(known) and (end == at or size < 1 << 22):
                    size += len(raw[known[end]])
                    end += 1
                own = known[at:end]
                names, chance = predictor.predict([raw[k].lower().encode() for k in own])
                score[own] = chance
                for k, name in zip(own, names, strict=True):
                    lang[k] = name
                at = end
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    return seen.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op10_langid(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
