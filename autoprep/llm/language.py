"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import fold_table, hash_spans, pieces, word_spans

#: The sample the network learns from: documents per language and words per document, at most about.
DOCS_PER_LANGUAGE, WORDS_PER_DOC = 500, 120
HIDDEN, STEPS, BATCH, RATE = 16, 600, 256, 0.02
#: The network starts afresh at every word; longer runs of bytes are cut.
WINDOW = 32
REMEMBERED = 400_000
UNDETERMINED = "und"


def _letters_table() -> bytes:
    table = bytearray(fold_table(letters_only=True))
    for b in b"0123456789":
        table[b] = 32
    return bytes(table)


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, long ones in windows."""
    starts, ends = word_spans(data)
    count = -(-(ends - starts) // WINDOW)
    if len(count) and count.max() > 1:
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        begin = np.repeat(starts, count) + nth * WINDOW
        return begin, np.minimum(begin + WINDOW, np.repeat(ends, count))
    return starts, ends


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _padded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the spans as rows, and which places hold one."""
    size = ends - starts
    place = np.arange(int(size.max()))
    inside = place < size[:, None]
    return np.where(inside, data[np.minimum(starts[:, None] + place, len(data) - 1)], 0), inside


@dataclass
class Network:
    """Two gated recurrent layers, one per direction, and a softmax at every byte."""

    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 3, kind: type = np.float32) -> Network:
        rng = np.random.default_rng(seed)
        w = {}
        for d in ("f", "b"):
            w[f"in_{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            w[f"rec_{d}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
        w["out"] = rng.normal(0, 0.3, (2 * hidden, len(languages)))
        w["bias"] = np.zeros(len(languages))
        return cls(languages, {k: v.astype(kind) for k, v in w.items()})

    def _forward(self, x: np.ndarray, inside: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """States of one direction at all places, time first. Outside a word the state stays as it is."""
        w_in, w_rec = self.weights[f"in_{d}"], self.weights[f"rec_{d}"]
        n, steps, k = len(x), x.shape[1], w_rec.shape[0]
        h = np.zeros((n, k), w_in.dtype)
        states = np.zeros((steps, n, k), w_in.dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, u = w_in[x[:, t]], h @ w_rec
            gates = _sigmoid(a[:, : 2 * k] + u[:, : 2 * k])
            z, r = gates[:, :k], gates[:, k:]
            new = np.tanh(a[:, 2 * k :] + r * u[:, 2 * k :])
            on = inside[:, t, None]
            if trace is not None:
                trace.append((t, h, z, r, new, u[:, 2 * k :], on))
            h = np.where(on, new + z * (h - new), h)
            states[t] = h
        return states

    def _softmax(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = f.shape[2]
        y = f @ self.weights["out"][:k] + b @ self.weights["out"][k:] + self.weights["bias"]
        y = np.exp(y - y.max(2, keepdims=True))
        return y / y.sum(2, keepdims=True)

    def probabilities(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Language probabilities at every place: (word, place, language)."""
        return self._softmax(self._forward(x, inside, "f"), self._forward(x, inside, "b")).transpose(1, 0, 2)

    def loss_and_gradients(self, x: np.ndarray, inside: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all places, and its gradients by backpropagation through time."""
        traces = {"f": [], "b": []}
        states = {d: self._forward(x, inside, d, traces[d]) for d in "fb"}
        p = self._softmax(states["f"], states["b"])
        on = inside.T
        total = on.sum()
        loss = -np.log(np.maximum(p[:, np.arange(len(x)), label], 1e-12))[on].sum() / total
        p[:, np.arange(len(x)), label] -= 1
        dy = p * (on[:, :, None] / p.dtype.type(total))
        k = states["f"].shape[2]
        grads = {"bias": dy.sum((0, 1)), "out": np.zeros_like(self.weights["out"])}
        for d, part in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
            flat = dy.reshape(-1, dy.shape[2])
            grads["out"][part] = states[d].reshape(-1, k).T @ flat
            into = dy @ self.weights["out"][part].T
            w_rec = self.weights[f"rec_{d}"]
            g_in, g_rec = np.zeros_like(self.weights[f"in_{d}"]), np.zeros_like(w_rec)
            dh = np.zeros_like(states[d][0])
            for t, h, z, r, new, u, here in reversed(traces[d]):
                dh = dh + into[t]
                live = np.where(here, dh, 0)
                dn = live * (1 - z) * (1 - new * new)
                dz = live * (h - new) * z * (1 - z)
                dr = dn * u * r * (1 - r)
                da = np.concatenate([dz, dr, dn], 1)
                du = np.concatenate([dz, dr, dn * r], 1)
                np.add.at(g_in, x[:, t], da)
                g_rec += h.T @ du
                dh = np.where(here, live * z + du @ w_rec.T, dh)
            grads[f"in_{d}"], grads[f"rec_{d}"] = g_in, g_rec
        return float(loss), grads

    def fit(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, label: np.ndarray, steps: int = STEPS, seed: int = 5) -> None:
        """Adam over random batches with as many words of each language."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(label == i) for i in range(len(self.languages))]
        groups = [g for g in groups if len(g)]
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        for step in range(1, steps + 1):
            picked = np.concatenate([rng.choice(g, max(1, BATCH // len(groups))) for g in groups])
            x, inside = _padded(data, starts[picked], ends[picked])
            _, grads = self.loss_and_gradients(x, inside, label[picked])
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.weights[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(g.dtype)

    def pooled(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sum of the place probabilities of each word."""
        out = np.zeros((len(starts), len(self.languages)), np.float32)
        size = ends - starts
        order = np.argsort(size, kind="stable")
        for at in range(0, len(order), 4096):
            part = order[at : at + 4096]
            x, inside = _padded(data, starts[part], ends[part])
            out[part] = (self.probabilities(x, inside) * inside[:, :, None]).sum(1)
        return out

    def label_bytes(self, text: str) -> list[str | None]:
        """The most likely language at every byte of the lower-cased text; None where no word is."""
        data = np.frombuffer(text.lower().encode().translate(_letters_table()) + b" ", np.uint8)
        out: list[str | None] = [None] * (len(data) - 1)
        for a, b in zip(*(s.tolist() for s in _spans(data))):
            x, inside = _padded(data, np.array([a]), np.array([b]))
            out[a:b] = [self.languages[i] for i in self.probabilities(x, inside)[0].argmax(1)]
        return out


def train(docs: DataFrame, learns: Column, docs_per_language: int = DOCS_PER_LANGUAGE, words_per_doc: int = WORDS_PER_DOC) -> Network | None:
    """A network fitted on a bounded sample of the rows where ``learns`` holds; None if there is none.

    Documents are sampled by a hash of their text, alike per language, and of each whole text
    evenly spaced words; only those words reach the driver.
    """
    rows = docs.where(learns & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, min(1.0, docs_per_language / counts[lang])).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("language"), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    table = _letters_table()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for text in batch.column(1).to_pylist():
                data = np.frombuffer(text.lower().encode().translate(table) + b" ", np.uint8)
                starts, ends = _spans(data)
                some = np.unique(np.linspace(0, len(starts) - 1, min(len(starts), words_per_doc)).astype(np.int64)) if len(starts) else []
                words.append(b" ".join(data[starts[i] : ends[i]].tobytes() for i in some))
            yield pa.record_batch([batch.column(0), pa.array(words, pa.binary())], ["lang", "words"])

    sample = rows.where(draw < share).mapInArrow(pick, "lang string, words binary").collect()
    sample = sorted((r["lang"], bytes(r["words"])) for r in sample if r["words"])
    network = Network.fresh(languages)
    if sample and len(languages) > 1:
        data = np.frombuffer(b" ".join(w for _, w in sample) + b" ", np.uint8)
        starts, ends = word_spans(data)
        owner = np.searchsorted(np.cumsum([len(w) + 1 for _, w in sample]), starts, "right")
        label = np.array([languages.index(lang) for lang, _ in sample])[owner]
        network.fit(data, starts, ends, label)
    return network


def predict(docs: DataFrame, network: Network | None, held_out: Column) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: the language with the largest mean probability over all places.

    Only the text is read. Null texts and texts without a letter are undetermined with score 0, as
    is everything without a network. Each different word of a group of texts is run once.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), held_out.alias("held_out"), F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(network)
    table = _letters_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        count = len(net.languages) if net else 1
        seen, held = np.zeros(0, np.uint64), np.zeros((0, count), np.float32)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            total, n = np.zeros((batch.num_rows, count)), np.zeros(batch.num_rows)
            folded = [(t or "").lower().encode().translate(table) for t in texts]
            for which, parts in pieces(folded) if net else ():
                data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
                starts, ends = _spans(data)
                if not len(starts):
                    continue
                owner = np.asarray(which)[np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), starts, "right")]
                words, first, back = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
                at = np.searchsorted(seen, words)
                new = (at == len(seen)) | (seen[np.minimum(at, len(seen) - 1)] != words) if len(seen) else np.ones(len(words), bool)
                if new.any():
                    if len(seen) > REMEMBERED:
                        seen, held, new = np.zeros(0, np.uint64), np.zeros((0, count), np.float32), np.ones(len(words), bool)
                    fresh = net.pooled(data, starts[first[new]], ends[first[new]])
                    seen, held = np.concatenate([seen, words[new]]), np.concatenate([held, fresh])
                    order = np.argsort(seen)
                    seen, held = seen[order], held[order]
                sums = held[np.searchsorted(seen, words)][back]
                for c in range(count):
                    total[:, c] += np.bincount(owner, sums[:, c], batch.num_rows)
                n += np.bincount(owner, ends - starts, batch.num_rows)
            best = total.argmax(1)
            score = np.clip(total[np.arange(len(n)), best] / np.maximum(n, 1), 0, 1)
            known = [net is not None and x > 0 and any(map(str.isalpha, t)) for x, t in zip(n.tolist(), texts)]
            names = [net.languages[i] if k else UNDETERMINED for i, k in zip(best.tolist(), known)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Predict every text's language, learning from rows whose ``crc32(doc_id as text) mod folds`` is not ``held``.

    A null doc_id is nobody's fold and is not held out. Repeated rows stay repeated and are alike;
    extra columns are ignored; an empty table gives an empty result. Equal probabilities go to the
    language first in order.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))
    return predict(docs, train(docs, ~held_out), held_out)
