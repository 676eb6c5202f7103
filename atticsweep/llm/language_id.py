"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text in windows of ``SPAN`` bytes, forwards and backwards, and
gives every byte a distribution over languages; a document's distribution is the
mean over all its bytes. Windows start afresh, so texts of any length take bounded
memory, and all windows of a slice of rows run as one batch.

Training is backpropagation through time in numpy, in one Spark task, over windows of
at most ``max_rows`` labelled documents chosen by a hash of the id: the sample and
the weights are bounded by parameters. Scoring is a map without a shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without
labelled rows every document is; rows with a null ``lang`` teach nothing; repeated rows
are judged each; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atticsweep.llm.common import remainder, rows_of, texts
from atticsweep.session import written

SPAN = 64
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


@dataclass
class Network:
    """Weights: per direction the gates' byte table (256 x 3H) and recurrence (H x 3H); the output layer."""

    languages: list[str]
    tables: list[np.ndarray]
    recurrences: list[np.ndarray]
    output: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
        def normal(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)

        return cls(
            languages, [0.5 * normal(256, 3 * hidden) for _ in range(2)], [normal(hidden, 3 * hidden) for _ in range(2)],
            normal(2 * hidden, len(languages)), np.zeros(len(languages), np.float32),
        )

    def packed(self) -> bytes:
        """Plain lists and arrays, readable whether or not the package is installed on the other side."""
        return pickle.dumps((self.languages, self.tables, self.recurrences, self.output, self.bias))

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrences, self.output, self.bias]

    def direction(self, which: int, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states, time first, of windows ``x`` (time, batch); ``keep`` gets what backpropagation needs."""
        steps, batch = x.shape
        table, recurrence = self.tables[which], self.recurrences[which]
        n = recurrence.shape[0]
        h = np.zeros((batch, n), np.float32)
        states = np.empty((steps, batch, n), np.float32)
        for t in range(steps) if which == 0 else range(steps - 1, -1, -1):
            inward, back = table[x[t]], h @ recurrence
            gates = _sigmoid(inward[:, : 2 * n] + back[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            candidate = np.tanh(inward[:, 2 * n :] + r * back[:, 2 * n :])
            if keep is not None:
                keep.append((t, h, z, r, candidate, back[:, 2 * n :]))
            h = (candidate + z * (h - candidate)) * mask[t][:, None]
            states[t] = h
        return states

    def states(self, which: int, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """As ``direction``, in place and without masks where all windows are full."""
        steps, batch = x.shape
        n = self.recurrences[which].shape[0]
        # sigmoid(x) = 1 / (1 + exp(-x)) and tanh(x) = 2 / (1 + exp(-2 x)) - 1, with the factors put into the
        # weights; exp is the cheaper function. It may overflow to infinity, of which the inverse is right.
        factor = np.concatenate([np.full(2 * n, -1.0), np.full(n, -2.0)]).astype(np.float32)
        table, recurrence = self.tables[which] * factor, self.recurrences[which] * factor
        h = np.zeros((batch, n), np.float32)
        inward, back = np.empty((batch, 3 * n), np.float32), np.empty((batch, 3 * n), np.float32)
        gates, candidate = np.empty((batch, 2 * n), np.float32), np.empty((batch, n), np.float32)
        found = np.empty((steps, batch, n), np.float32)
        old = np.seterr(over="ignore")
        for t in range(steps) if which == 0 else range(steps - 1, -1, -1):
            np.take(table, x[t], axis=0, out=inward, mode="clip")
            np.matmul(h, recurrence, out=back)
            np.add(inward[:, : 2 * n], back[:, : 2 * n], out=gates)
            np.exp(gates, out=gates)
            gates += np.float32(1)
            np.reciprocal(gates, out=gates)
            np.multiply(gates[:, n:], back[:, 2 * n :], out=candidate)
            candidate += inward[:, 2 * n :]
            np.exp(candidate, out=candidate)
            candidate += np.float32(1)
            np.divide(np.float32(2), candidate, out=candidate)
            candidate -= np.float32(1)
            h = found[t]
            np.subtract(found[t - 1] if which == 0 and t else found[t + 1] if which and t < steps - 1 else np.float32(0), candidate, out=h)
            h *= gates[:, :n]
            h += candidate
            if mask is not None:
                h *= mask[t][:, None]
        np.seterr(**old)
        return found

    def distributions(self, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """A distribution over the languages for every byte: (languages, time, batch)."""
        n = self.recurrences[0].shape[0]
        scores = self.states(0, x, mask).reshape(-1, n) @ self.output[:n]
        scores += self.states(1, x, mask).reshape(-1, n) @ self.output[n:]
        scores += self.bias
        p = np.ascontiguousarray(scores.T)
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return p.reshape(-1, *x.shape)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of the bytes, and its gradient in the order of ``parameters``."""
        kept: list[list] = [[], []]
        n = self.recurrences[0].shape[0]
        both = np.concatenate([self.direction(d, x, mask, kept[d]) for d in (0, 1)], axis=2)
        scores = both @ self.output + self.bias
        p = np.exp(scores - scores.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        total = max(mask.sum(), 1.0)
        rows = np.arange(x.shape[1])
        loss = float(-(np.log(p[:, rows, y] + 1e-9) * mask).sum() / total)
        p[:, rows, y] -= 1
        p *= (mask / total)[:, :, None]
        flat = p.reshape(-1, p.shape[2])
        d_output, d_bias = both.reshape(-1, 2 * n).T @ flat, flat.sum(axis=0)
        d_both = p @ self.output.T
        d_tables, d_recurrences = [], []
        for which in (0, 1):
            recurrence = self.recurrences[which]
            d_table, d_recurrence = np.zeros_like(self.tables[which]), np.zeros_like(recurrence)
            d_next = np.zeros((x.shape[1], n), np.float32)
            for t, h, z, r, candidate, back in reversed(kept[which]):
                d = (d_both[t, :, which * n : (which + 1) * n] + d_next) * mask[t][:, None]
                d_z = d * (h - candidate) * z * (1 - z)
                d_candidate = d * (1 - z) * (1 - candidate * candidate)
                d_r = d_candidate * back * r * (1 - r)
                d_in = np.concatenate([d_z, d_r, d_candidate], axis=1)
                d_back = np.concatenate([d_z, d_r, d_candidate * r], axis=1)
                np.add.at(d_table, x[t], d_in)
                d_recurrence += h.T @ d_back
                d_next = d * z + d_back @ recurrence.T
            d_tables.append(d_table), d_recurrences.append(d_recurrence)
        return loss, [*d_tables, *d_recurrences, d_output, d_bias]


def windows(texts_: list[bytes], span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, (batch, span), how many bytes each has, and whose it is."""
    counts = np.array([-(-len(t) // span) for t in texts_], np.int64)
    owner = np.repeat(np.arange(len(texts_)), counts)
    padded = b"".join(t + b"\0" * (-len(t) % span) for t in texts_)
    x = np.frombuffer(padded, np.uint8).reshape(-1, span)
    sizes = np.full(len(x), span, np.int64)
    last = np.cumsum(counts) - 1
    for i, t in enumerate(texts_):
        if len(t) % span:
            sizes[last[i]] = len(t) % span
    return x, sizes, owner


def train(rows: pd.DataFrame, hidden: int, rounds: int, batch: int, rate: float = 0.01, seed: int = 7) -> Network | None:
    """A network from windows (bytes) and their languages, by Adam on batches with equal shares of all languages."""
    languages = sorted(rows["lang"].unique())
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    net = Network.fresh(languages, hidden, rng)
    x, sizes, owner = windows([bytes(w) for w in rows["window"]])
    y = np.searchsorted(languages, rows["lang"].to_numpy())[owner]
    of = [np.flatnonzero(y == i) for i in range(len(languages))]
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    each = max(1, batch // len(languages))
    for step in range(1, rounds + 1):
        at = np.concatenate([rng.choice(rows_, each) for rows_ in of])
        mask = (np.arange(SPAN)[:, None] < sizes[at]).astype(np.float32)
        _, grads = net.gradients(x[at].T, mask, y[at])
        pace = rate * (1 - 0.9 * step / rounds)
        for p, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame, max_rows: int, per_row: int) -> DataFrame:
    """``lang`` and ``window`` of at most ``max_rows`` documents, up to ``per_row`` windows each, evenly spaced."""
    known = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "lang"
    )
    taught = known.filter(remainder(F.col("doc_id"), 5) != 0).distinct()
    # At most max_rows rows: broadcast to the texts.
    chosen = written(taught.orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(max_rows))
    own = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            out = []
            for doc_id, lang, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                data = text.encode("utf-8")
                if not LETTER.search(text):
                    continue
                starts = np.unique(np.linspace(0, max(len(data) - SPAN, 0), per_row).astype(int))
                out += [(doc_id, int(s), lang, data[s : s + SPAN]) for s in starts]
            a, b, c, d = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.binary())],
                names=["doc_id", "start", "lang", "window"],
            )

    return own.mapInArrow(cut, "doc_id bigint, start bigint, lang string, window binary")


def fit(docs: DataFrame, max_rows: int = 2000, per_row: int = 6, hidden: int = 16, rounds: int = 250, batch: int = 128) -> Network | None:
    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([f for f in frames], ignore_index=True)
        rows = rows.sort_values(["doc_id", "start", "lang", "window"], ignore_index=True)
        net = train(rows, hidden, rounds, batch)
        yield pd.DataFrame({"net": [net.packed() if net else None]})

    # max_rows * per_row windows of SPAN bytes: a bounded table, trained on in one task.
    windows_ = written(sample(docs, max_rows, per_row))
    made = windows_.coalesce(1).mapInPandas(learn, "net binary").first() if not windows_.isEmpty() else None
    return Network(*pickle.loads(bytes(made[0]))) if made and made[0] else None


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score and agreement: the share of bytes labelled with the document's language."""
    schema = "doc_id bigint, lang_pred string, score double, agreement double"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 4 << 20):
            given = rows.column("text").to_pylist()
            known = [i for i, t in enumerate(given) if LETTER.search(t)] if net else []
            lang, score, agreement = [UNKNOWN] * len(given), np.zeros(len(given)), np.zeros(len(given))
            if known:
                x, sizes, owner = windows([given[i].encode("utf-8") for i in known])
                total, votes = (np.zeros((len(known), len(net.languages))) for _ in range(2))
                order = np.argsort(sizes < SPAN, kind="stable")  # full windows first: they need no mask
                full = int((sizes == SPAN).sum())
                for at in [*range(0, full, 1024), *range(full, len(x), 1024)]:
                    part = order[at : min(at + 1024, full if at < full else len(x))]
                    mask = None if at < full else (np.arange(SPAN)[:, None] < sizes[part]).astype(np.float32)
                    p = net.distributions(np.ascontiguousarray(x[part].T), mask)
                    first = p == p.max(axis=0)
                    if mask is not None:
                        p *= mask
                        first &= mask > 0
                    for k in range(len(net.languages)):
                        total[:, k] += np.bincount(owner[part], p[k].sum(axis=0), len(known))
                        votes[:, k] += np.bincount(owner[part], first[k].sum(axis=0), len(known))
                total /= total.sum(axis=1, keepdims=True)
                votes /= votes.sum(axis=1, keepdims=True)
                chosen = total.argmax(axis=1)
                for j, i in enumerate(known):
                    lang[i] = net.languages[chosen[j]]
                score[known] = np.clip(total[np.arange(len(known)), chosen], 0, 1)
                agreement[known] = votes[np.arange(len(known)), chosen]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(agreement)],
                names=["doc_id", "lang_pred", "score", "agreement"],
            )

    return texts(docs).mapInArrow(judge, schema)


def language_id(docs: DataFrame, **settings: int) -> DataFrame:
    """``predict`` with a network fitted on the rows whose crc32 modulo 5 is not 0, and which rows were held out."""
    found = predict(docs, fit(docs, **settings))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "agreement")
