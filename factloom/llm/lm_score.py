"""Document log-likelihood by a gated recurrent language model in numpy.

Tokens are lower-cased words (runs of anything but ASCII white space) and one end token a document.  Word counts cover all
training documents (crc32(id as text) mod ``folds`` is not 0) and come from one shuffle of partial counts.

The output softmax is factored by class.  The ``HEAD`` most frequent words form classes whose members the network tells
apart by a second softmax.  All other words are classed by topic (that in which they occur most; topics are k-means
centroids of hashed word counts of all training documents, seeded on a sample) and by frequency; inside such a class a word has its share of the
class's count.  The class of words seen once keeps half of its mass for unseen words, which count as one type, as they do
in the unigram base.  So the probabilities of all known words, the end and the unseen type sum to one.

Training is truncated backpropagation through time: first on a bounded sample on the driver, then in ``rounds`` of local
training, after each of which the parameters are averaged by token counts.  Each training document is in one round, so
the rounds together pass over all of them.  Scoring
deals a batch's documents to slots and runs them window by window with the state carried over, so a document's
likelihood covers its whole text.

The word table is broadcast while it has at most ``most_words`` words.  Beyond that a join of documents' rarer words with
the counts supplies their codes and counts, and documents are coded once for training and scoring; the codes, shares and
base are the same on both ways.

Defined results: a null text is empty and is its end token alone; without training documents every token has base
probability one; rows that repeat an id are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordarrays as wa
from .common import blocks, cut, lean, require

HEAD, HEAD_CLASS, TOPICS, HIDDEN = 256, 32, 8, 32
#: Least counts of the frequency classes of all other words.
BINS = (1, 2, 4, 16, 128)
HEADS = HEAD // HEAD_CLASS
TAILS = TOPICS * len(BINS)
END_CLASS, CLASSES = HEADS + TAILS, HEADS + TAILS + 1
#: Codes of tokens: head words, tail classes, end, unseen.
END, UNSEEN, CODES = HEAD + TAILS, HEAD + TAILS + 1, HEAD + TAILS + 2
END_HASH = 0x1D8AF066E4B1C3A5
BUCKETS = 512
ONCE = np.array([HEADS + t * len(BINS) for t in range(TOPICS)])
_U, _F = np.uint64, np.float32


def is_training(id_col: str, folds: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")), F.lit(folds)), F.lit(0)) != 0


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all rows, first token of each row); every row ends with the end token."""
    words = wa.words_of(column, wa.SPACED)
    rows = len(words.first) - 1
    first = words.first + np.arange(rows + 1)
    out = np.full(first[-1], END_HASH, dtype=_U)
    out[np.arange(len(words.hashes)) + words.row_of()] = words.hashes
    return out, first


# --- topics and counts -----------------------------------------------------------------------------------------------


def _profiles(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Unit vectors of damped hashed word counts."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    flat = np.bincount(row * BUCKETS + (hashes >> _U(40)).astype(np.int64) % BUCKETS, minlength=n * BUCKETS).reshape(n, BUCKETS)
    x = np.sqrt(flat).astype(_F)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)


def _centroids(x: np.ndarray, rounds: int = 20) -> np.ndarray:
    if not len(x):
        return np.zeros((TOPICS, BUCKETS), _F)
    rng = np.random.default_rng(5)
    centres = [x[0]]
    for _ in range(TOPICS - 1):
        near = np.max(x @ np.array(centres).T, axis=1)
        weight = np.maximum(1 - near, 0) + 1e-9
        centres.append(x[rng.choice(len(x), p=weight / weight.sum())])
    c = np.array(centres)
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        for k in range(TOPICS):
            if (at == k).any():
                c[k] = x[at == k].mean(axis=0)
                c[k] /= max(np.linalg.norm(c[k]), 1e-6)
    return c.astype(_F)


def _topics(train_rows: DataFrame, seeds: np.ndarray) -> np.ndarray:
    """``seeds`` moved to the mean direction of all training documents next to each."""
    shared = train_rows.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((TOPICS, BUCKETS))
        for batch in (part for whole in batches for part in blocks(whole, "text")):
            x = _profiles(*tokens_of(batch.column(1)))
            at = np.argmax(x @ shared.value.T, axis=1)
            for k in range(TOPICS):
                sums[k] += x[at == k].sum(axis=0)
        if sums.any():
            i = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(sums.ravel()[i])], names=["i", "x"])

    sums = np.zeros(TOPICS * BUCKETS)
    found = train_rows.select("id", "text").mapInArrow(lean(run), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    sums[found.column("i").to_numpy()] = found.column("x").to_numpy()
    sums = sums.reshape(TOPICS, BUCKETS)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.where(norm > 0, sums / np.maximum(norm, 1e-6), seeds).astype(_F)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.withColumn("uid", F.xxhash64("id", "text"))


def _in_round(k: int, rounds: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(31)), F.lit(rounds)) == k


def _chance(seed: int, rate: float) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, rate))


def word_counts(train: DataFrame, centres: np.ndarray) -> DataFrame:
    """(h, c, topic) of each distinct token of all training documents."""
    shared = train.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def merged():
            h, t, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((t, h))
            h, t, c = h[order], t[order], c[order]
            start = np.flatnonzero(np.append([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])))
            return h[start], t[start], np.add.reduceat(c, start)

        def emit():
            h, t, c = held[0]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t, pa.int32()), pa.array(c, pa.int64())], names=["h", "t", "c"])

        for batch in (part for whole in batches for part in blocks(whole, "text")):
            hashes, first = tokens_of(batch.column(1))
            if not len(hashes):
                continue
            topic = np.argmax(_profiles(hashes, first) @ shared.value.T, axis=1)
            per_token = np.repeat(topic, np.diff(first))
            for k in range(TOPICS):
                h, c = np.unique(hashes[per_token == k], return_counts=True)
                if len(h):
                    held.append((h, np.full(len(h), k, np.int32), c))
                    size += len(h)
            if size > 800_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 500_000:
                    yield emit()
                    held, size = [], 0
        if held:
            held = [merged()]
            yield emit()

    parts = train.select("id", "text").mapInArrow(lean(run), "h long, t int, c long")
    by_topic = [F.sum(F.when(F.col("t") == k, F.col("c"))).alias(f"t{k}") for k in range(TOPICS)]
    total = parts.groupBy("h").agg(F.sum("c").alias("c"), *by_topic)
    counts = F.array(*(F.coalesce(f"t{k}", F.lit(0)) for k in range(TOPICS)))
    return total.select("h", "c", (F.array_position(counts, F.array_max(counts)) - 1).cast("byte").alias("topic"))


def tail_codes(topics: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Codes of words outside the head."""
    bins = np.maximum(np.searchsorted(BINS, counts, side="right") - 1, 0)
    return (HEAD + topics.astype(np.int16) * len(BINS) + bins).astype(np.int16)


class Vocabulary:
    """Counts and codes of words, sorted by hash.

    A table of some words has at least the head words and the end; ``tails`` are then the counts of all words by tail class.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, topics: np.ndarray, total: int, distinct: int, tails: np.ndarray | None = None):
        self.total, self.distinct = total, distinct
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.counts = counts[order].astype(np.int32 if not len(counts) or counts.max() < 1 << 31 else np.int64)
        self.codes = tail_codes(topics[order], self.counts)
        del order
        end = np.searchsorted(self.hashes, _U(END_HASH))
        end = int(end) if end < len(self.hashes) and self.hashes[end] == _U(END_HASH) else None
        kept = min(HEAD + 1, len(self.counts))
        near = np.flatnonzero(self.counts >= np.partition(self.counts, -kept)[-kept]) if kept else np.zeros(0, np.int64)
        near = near[near != end] if end is not None else near
        head = near[np.lexsort((self.hashes[near], -self.counts[near].astype(np.int64)))[:HEAD]]
        apart = np.append(head, end) if end is not None else head
        if tails is not None:
            tails = tails - np.bincount(self.codes[apart] - HEAD, weights=self.counts[apart], minlength=TAILS)
        self.codes[head] = np.arange(len(head))
        if end is not None:
            self.codes[end] = END
        self.code_counts = np.bincount(self.codes, weights=self.counts, minlength=CODES)
        if tails is not None:
            self.code_counts[HEAD:END] = tails
        self.class_totals = self.code_counts[HEAD:END]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, code) of tokens."""
        if not len(self.hashes) or not len(hashes):
            return np.zeros(len(hashes), np.int64), np.full(len(hashes), UNSEEN, np.int16)
        asked, inverse = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        known = self.hashes[at] == asked
        return np.where(known, self.counts[at], 0)[inverse], np.where(known, self.codes[at], UNSEEN)[inverse].astype(np.int16)

    def share(self, counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Natural log of a tail word's share of its class; 0 for other codes."""
        out = np.zeros(len(codes))
        tail = (codes >= HEAD) & (codes < END)
        k = codes[tail] - HEAD
        once = k % len(BINS) == 0
        out[tail] = np.log(counts[tail] / np.maximum(self.class_totals[k], 1)) - np.where(once, math.log(2), 0.0)
        return out


def _measures(vocab: Vocabulary, counts: np.ndarray, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base score, sum of shares, known tokens) of each document."""
    floor = math.log10(vocab.total + 0.1 * (vocab.distinct + 1))
    sums = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0)
    return sums(np.log10(counts + 0.1) - floor), sums(vocab.share(counts, codes)), sums((counts > 0).astype(np.int64)).astype(np.int64)


# --- the network -----------------------------------------------------------------------------------------------------


class_of_code = np.concatenate([np.arange(HEAD) // HEAD_CLASS, HEADS + np.arange(TAILS), [END_CLASS, 0]]).astype(np.int64)
SHAPES = {"g": (CODES, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wh": (HEADS, HIDDEN, HEAD_CLASS), "bh": (HEADS, HEAD_CLASS)}


def new_parameters(code_counts: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    p = {k: (rng.standard_normal(s) * (0.1 if k != "u" else 0.15)).astype(_F) for k, s in SHAPES.items()}
    p["g"][:, HIDDEN : 2 * HIDDEN] += 1.0  # remember by default
    by_class = np.bincount(class_of_code[:UNSEEN], weights=code_counts[:UNSEEN], minlength=CLASSES) + 0.5
    p["bc"] = np.log(by_class / by_class.sum()).astype(_F)
    head = code_counts[:HEAD].reshape(HEADS, HEAD_CLASS) + 0.5
    p["bh"] = np.log(head / head.sum(axis=1, keepdims=True)).astype(_F)
    return p


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflatten(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s).astype(_F)
        at += n
    return out


def deal(first: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token index or -1 [steps, slots], whether a document begins there, slots still in use at each step).

    Longest documents first, each to the slot that is free earliest; slots are in order of falling length.
    """
    lengths = np.diff(first)
    slots = max(1, min(slots, len(lengths)))
    queue = [(0, s) for s in range(slots)]
    lists: list[list[int]] = [[] for _ in range(slots)]
    for d in np.argsort(-lengths, kind="stable"):
        n, s = heapq.heappop(queue)
        lists[s].append(int(d))
        heapq.heappush(queue, (n + int(lengths[d]), s))
    lists = [x for _, _, x in sorted(((-n, s, lists[s]) for n, s in queue), key=lambda y: y[:2])]
    totals = np.array([lengths[x].sum() for x in lists])
    steps = int(totals[0]) if len(totals) else 0
    index = np.full((steps, slots), -1, dtype=np.int32)
    begins = np.zeros((steps, slots), dtype=bool)
    for s, docs in enumerate(lists):
        at = 0
        for d in docs:
            n = lengths[d]
            index[at : at + n, s] = np.arange(first[d], first[d + 1])
            begins[at, s] = True
            at += n
    return index, begins, (totals[None, :] > np.arange(steps)[:, None]).sum(axis=1)


def _inputs(codes: np.ndarray, index: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Code of the token before each; the end's at a document's start."""
    before = codes[np.maximum(index - 1, 0)].astype(np.int64)
    before[begins | (index < 0)] = END
    return before


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def log_likelihoods(p: dict[str, np.ndarray], codes: np.ndarray, first: np.ndarray, slots: int = 256, window: int = 64) -> np.ndarray:
    """Natural log of each token's class (and head word) probability given all earlier tokens of its document."""
    out = np.zeros(len(codes), _F)
    index, begins, used = deal(first, slots)
    n = HIDDEN
    state = np.zeros((index.shape[1], n), _F)
    for t0 in range(0, len(index), window):
        t1, k = min(t0 + window, len(index)), int(used[t0])
        at, fresh = index[t0:t1, :k], begins[t0:t1, :k]
        gates = p["g"][_inputs(codes, at, fresh)]
        h, hidden = state[:k], np.empty((t1 - t0, k, n), _F)
        some = fresh.any(axis=1)
        for t in range(t1 - t0):
            if some[t]:
                h = np.where(fresh[t][:, None], _F(0), h)
            hu = h @ p["u"]
            x = gates[t]
            rz = _sigmoid(x[:, : 2 * n] + hu[:, : 2 * n])
            cand = np.tanh(x[:, 2 * n :] + rz[:, :n] * hu[:, 2 * n :])
            h = cand + rz[:, n:] * (h - cand)
            hidden[t] = h
        state[:k] = h
        live = at >= 0
        flat, where = hidden[live], at[live]
        target = codes[where].astype(np.int64)
        raised = np.exp(flat @ p["wc"] + p["bc"])
        total = raised.sum(axis=1)
        mass = raised[np.arange(len(flat)), class_of_code[target]]
        unseen = target == UNSEEN
        if unseen.any():
            mass[unseen] = raised[unseen][:, ONCE].sum(axis=1) / 2
        got = np.log(np.maximum(mass, 1e-30) / total)
        for c in range(HEADS):
            mine = np.flatnonzero((target >= c * HEAD_CLASS) & (target < (c + 1) * HEAD_CLASS))
            if len(mine):
                e = np.exp(flat[mine] @ p["wh"][c] + p["bh"][c])
                got[mine] += np.log(e[np.arange(len(mine)), target[mine] - c * HEAD_CLASS] / e.sum(axis=1))
        out[where] = got
    return out


def gradients(p: dict[str, np.ndarray], codes: np.ndarray, at: np.ndarray, fresh: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], int]:
    """(state after a window, gradients of its mean loss, tokens that count) by backpropagation to the window's first step.

    ``at`` and ``fresh`` [steps, slots] are token indexes (or -1) and whether a document begins there.
    """
    (steps, k), n, kind = at.shape, HIDDEN, p["u"].dtype.type
    x = _inputs(codes, at, fresh)
    gates = p["g"][x]
    h = state
    before, rs, zs, cands, hus, hidden = (np.empty((steps, k, n), kind) for _ in range(6))
    for t in range(steps):
        h = np.where(fresh[t][:, None], kind(0), h)
        hu = h @ p["u"]
        rz = _sigmoid(gates[t][:, : 2 * n] + hu[:, : 2 * n])
        before[t], rs[t], zs[t], hus[t] = h, rz[:, :n], rz[:, n:], hu[:, 2 * n :]
        cands[t] = np.tanh(gates[t][:, 2 * n :] + rs[t] * hus[t])
        h = cands[t] + zs[t] * (h - cands[t])
        hidden[t] = h
    live = (at >= 0) & (codes[np.maximum(at, 0)] != UNSEEN)
    count = int(live.sum())
    if not count:
        return h, {}, 0
    flat, target = hidden[live], codes[at[live]].astype(np.int64)
    scale = kind(1 / count)
    probs = np.exp(flat @ p["wc"] + p["bc"])
    probs /= probs.sum(axis=1, keepdims=True)
    probs[np.arange(count), class_of_code[target]] -= 1
    probs *= scale
    grad = {"wc": flat.T @ probs, "bc": probs.sum(axis=0), "wh": np.zeros_like(p["wh"]), "bh": np.zeros_like(p["bh"])}
    d_flat = probs @ p["wc"].T
    for c in range(HEADS):
        mine = np.flatnonzero((target >= c * HEAD_CLASS) & (target < (c + 1) * HEAD_CLASS))
        if len(mine):
            e = np.exp(flat[mine] @ p["wh"][c] + p["bh"][c])
            e /= e.sum(axis=1, keepdims=True)
            e[np.arange(len(mine)), target[mine] - c * HEAD_CLASS] -= 1
            e *= scale
            grad["wh"][c], grad["bh"][c] = flat[mine].T @ e, e.sum(axis=0)
            d_flat[mine] += e @ p["wh"][c].T
    d_hidden = np.zeros((steps, k, n), kind)
    d_hidden[live] = d_flat
    d_gates, d_u, carry = np.empty((steps, k, 3 * n), kind), np.zeros_like(p["u"]), np.zeros((k, n), kind)
    for t in range(steps - 1, -1, -1):
        dh = d_hidden[t] + carry
        r, z, cand = rs[t], zs[t], cands[t]
        dc = dh * (1 - z) * (1 - cand * cand)
        dg = d_gates[t]
        dg[:, :n] = dc * hus[t] * r * (1 - r)
        dg[:, n : 2 * n] = dh * (before[t] - cand) * z * (1 - z)
        dg[:, 2 * n :] = dc
        dhu = np.concatenate([dg[:, : 2 * n], dc * r], axis=1)
        d_u += before[t].T @ dhu
        carry = dh * z + dhu @ p["u"].T
        carry[fresh[t]] = 0
    grad["u"] = d_u
    order = np.argsort(x.ravel(), kind="stable")
    ids, start = np.unique(x.ravel()[order], return_index=True)
    grad["g"] = np.zeros_like(p["g"])
    grad["g"][ids] = np.add.reduceat(d_gates.reshape(-1, 3 * n)[order], start)
    return h, grad, count


def train(p: dict[str, np.ndarray], codes: np.ndarray, first: np.ndarray, rate: float, slots: int = 64, window: int = 24, moments: dict | None = None) -> dict:
    """One pass of truncated backpropagation with Adam, in place; state is carried across windows, gradients aren't."""
    moments = moments if moments is not None else {"t": 0, "m": {k: np.zeros_like(v) for k, v in p.items()}, "v": {k: np.zeros_like(v) for k, v in p.items()}}
    index, begins, used = deal(first, slots)
    state = np.zeros((index.shape[1], HIDDEN), _F)
    for t0 in range(0, len(index), window):
        t1, k = min(t0 + window, len(index)), int(used[t0])
        state[:k], grad, count = gradients(p, codes, index[t0:t1, :k], begins[t0:t1, :k], state[:k])
        if not count:
            continue
        norm = math.sqrt(sum(float((v * v).sum()) for v in grad.values()))
        clip = min(1.0, 1.0 / max(norm, 1e-9))
        moments["t"] += 1
        b1, b2 = 1 - 0.9 ** moments["t"], 1 - 0.99 ** moments["t"]
        for key, value in grad.items():
            value = value * _F(clip)
            m, v = moments["m"][key], moments["v"][key]
            m += _F(0.1) * (value - m)
            v += _F(0.01) * (value * value - v)
            p[key] -= _F(rate) * (m / _F(b1)) / (np.sqrt(v / _F(b2)) + _F(1e-6))
    return moments


# --- on the corpus ---------------------------------------------------------------------------------------------------


def _bytes_of(codes: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.array([codes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())


def _coded(rows: DataFrame, vocabulary) -> DataFrame:
    """(id, uid, codes, n_tokens, n_known, base_score, shares) of each document, codes of 16 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole, "text", 2 << 20)):
            hashes, first = tokens_of(batch.column(1))
            c, code = vocabulary.value.find(hashes)
            base, shares, known = _measures(vocabulary.value, c, code, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), _bytes_of(code, first), pa.array(np.diff(first)), pa.array(known), pa.array(base), pa.array(shares)],
                names=["id", "uid", "codes", "n_tokens", "n_known", "base_score", "shares"],
            )

    return rows.mapInArrow(lean(run), "id long, uid long, codes binary, n_tokens long, n_known long, base_score double, shares double")


def _coded_by_join(rows: DataFrame, counts: DataFrame, vocabulary) -> DataFrame:
    """(id, uid, codes, n_tokens, n_known, base_score, shares) of each document where the table has only some of the words."""

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole, "text")):
            hashes, first = tokens_of(batch.column(1))
            at = np.flatnonzero(vocabulary.value.find(hashes)[1] == UNSEEN)
            h, r = hashes[at], np.repeat(np.arange(len(first) - 1), np.diff(first))[at]
            order = np.lexsort((h, r))
            h, r = h[order], r[order]
            start = np.flatnonzero(np.append([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1]))) if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(r[start])), pa.array(h[start].view(np.int64))], names=["uid", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole, "text")):
            hashes, first = tokens_of(batch.column(1))
            c, code = vocabulary.value.find(hashes)
            h, count, topic = (x.to_numpy(zero_copy_only=False) for x in batch.column(3).flatten().flatten())
            h, at = np.unique(h.view(_U), return_index=True)
            if len(h):
                spot = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
                found = (code == UNSEEN) & (h[spot] == hashes)
                c[found] = count[at][spot[found]]
                code[found] = tail_codes(topic[at], count[at])[spot[found]]
            base, shares, known = _measures(vocabulary.value, c, code, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), _bytes_of(code, first), pa.array(np.diff(first)), pa.array(known), pa.array(base), pa.array(shares)],
                names=["id", "uid", "codes", "n_tokens", "n_known", "base_score", "shares"],
            )

    rare = rows.mapInArrow(lean(beyond), "uid long, h long").join(counts, "h").groupBy("uid").agg(F.collect_set(F.struct("h", "c", "topic")).alias("rare"))
    both = rows.join(rare, "uid", "left").select("id", "text", "uid", "rare")
    return both.mapInArrow(lean(run), "id long, uid long, codes binary, n_tokens long, n_known long, base_score double, shares double")


def _join(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), dtype=np.int16), np.concatenate([[0], np.cumsum([len(x) // 2 for x in parts])]).astype(np.int64)


def fit(coded: Callable[[Column], DataFrame], vocabulary, total: int, warm_tokens: int, rounds: int) -> dict[str, np.ndarray]:
    """Parameters after a start on the driver and ``rounds`` of averaged local training over all documents.

    ``coded`` gives (uid, codes) of the training documents for which a condition on id holds.
    """
    p = new_parameters(vocabulary.value.code_counts)
    if not total:
        return p
    sample = coded(_chance(21, warm_tokens / total))
    start = [bytes(r["codes"]) for r in sorted(sample.collect(), key=lambda r: r["uid"])]
    if start:
        codes, first = _join(start)
        passes = max(1, min(12, math.ceil(2 * warm_tokens / max(len(codes), 1))))
        moments = None
        for k in range(passes):
            moments = train(p, codes, first, 0.01 * (1 - 0.8 * k / passes), moments=moments)
    for k in range(rounds):
        shared = sample.sparkSession.sparkContext.broadcast(flatten(p))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            mine, moments, seen = unflatten(shared.value), None, 0
            held: list[bytes] = []

            def step() -> None:
                nonlocal moments, seen
                codes, first = _join(held)
                moments = train(mine, codes, first, 0.002, slots=256, moments=moments)
                seen += len(codes)
                held.clear()

            size = 0
            for batch in batches:
                for x in batch.column(0):
                    held.append(x.as_py())
                    size += len(held[-1])
                    if size > 4_000_000:
                        step()
                        size = 0
            if held:
                step()
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([flatten(mine).tolist()], pa.list_(pa.float32())), pa.array([seen], pa.int64())], names=["p", "n"])

        local = coded(_in_round(k, rounds)).select("codes").mapInArrow(lean(run), "p array<float>, n long")
        mean = local.select("n", F.posexplode("p").alias("i", "x")).groupBy("i").agg((F.sum(F.col("x").cast("double") * F.col("n")) / F.sum("n")).alias("x")).toArrow()
        if mean.num_rows:
            flat = np.zeros(mean.num_rows, _F)
            flat[mean.column("i").to_numpy()] = mean.column("x").to_numpy()
            p = unflatten(flat)
    return p


def scores(docs: DataFrame, id_col="doc_id", text_col="text", folds=10, topic_docs=4_000, warm_tokens=1_000_000, rounds=2, most_words=16_000_000, pool_bytes=16 << 20) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    train_rows = rows.where(is_training("id", folds))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole, "text")):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in _profiles(*tokens_of(batch.column(1)))], pa.binary())], names=["x"])

    count = train_rows.count()
    sample = train_rows.where(_chance(7, topic_docs / max(count, 1))).mapInArrow(lean(profile), "x binary").limit(2 * topic_docs).collect()
    centres = _topics(train_rows, _centroids(np.array([np.frombuffer(r[0], dtype=_F) for r in sample])))
    counts = cut(word_counts(train_rows, centres))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    whole = distinct <= most_words
    vocabulary = spark.sparkContext.broadcast(_vocabulary(counts, most_words, total, distinct))
    every = cut(_coded(rows, vocabulary) if whole else _coded_by_join(rows, counts, vocabulary))  # texts are coded once
    training = is_training("id", folds)
    coded = lambda keep: every.where(training & keep).select("uid", "codes")
    network = spark.sparkContext.broadcast(flatten(fit(coded, vocabulary, total, warm_tokens, rounds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = unflatten(network.value)
        for batch in (pool for whole_batch in batches for pool in blocks(whole_batch, "codes", pool_bytes // 3)):
            flat, first = _join(batch.column(1).to_pylist())
            model = np.add.reduceat(log_likelihoods(p, flat, first), first[:-1], dtype=np.float64) if len(flat) else np.zeros(batch.num_rows)
            score = (model + batch.column(5).to_numpy()) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:5], pa.array(score)], names=["id", "n_tokens", "n_known", "base_score", "score"])

    out = every.select("id", "codes", "n_tokens", "n_known", "base_score", "shares").mapInArrow(lean(run), "id long, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        F.col("id").alias(id_col), (~is_training("id", folds)).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def _least_count(counts: DataFrame, most: int) -> int:
    """Least count such that at most ``most`` words reach it."""
    sizes = counts.groupBy(F.least("c", F.lit(1_000_000)).alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).toLocalIterator()
    held, least = 0, 1_000_001
    for r in sizes:
        held += r["n"]
        if held > most:
            break
        least = r["c"]
    return least


def _vocabulary(counts: DataFrame, most_words: int, total: int, distinct: int) -> Vocabulary:
    """All words, or the most frequent ones with the head words and the end."""
    arrays = lambda t: (t.column("h").to_numpy().view(_U), t.column("c").to_numpy(), t.column("topic").to_numpy())
    if distinct <= most_words:
        return Vocabulary(*arrays(counts.toArrow()), total, distinct)
    seen = counts.where(F.col("c") >= _least_count(counts, most_words))
    end = int(np.array(END_HASH, _U).view(np.int64))
    head = counts.orderBy(F.desc("c"), F.col("h").bitwiseXOR(F.lit(-(1 << 63)))).limit(HEAD + 1)
    h, c, topic = (np.concatenate(x) for x in zip(*(arrays(x.toArrow()) for x in (seen, head, counts.where(F.col("h") == end))), strict=True))
    h, at = np.unique(h, return_index=True)
    tails = np.zeros(TAILS)
    least = sum((F.col("c") >= b).cast("int") for b in BINS[1:])
    for r in counts.groupBy((F.col("topic").cast("int") * len(BINS) + least).alias("k")).agg(F.sum("c").alias("n")).collect():
        tails[r["k"]] = r["n"]
    return Vocabulary(h, c[at], topic[at], total, distinct, tails)
