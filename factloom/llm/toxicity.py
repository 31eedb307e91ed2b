"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

1. Learned lexicons: words, and word prefixes of 4, 5 and 6 bytes, that labelled toxic training documents have far more often
   than clean ones, by more than chance allows among so many features.  Counts cover all labelled training rows; only
   features of at least ``support`` of the toxic rows are counted, so there are at most (features of a text) / ``support`` of
   them, whatever the size of the corpus.  The ``items`` most telling are the model's inputs; that bounds its size, not the
   rows it is learned from or applied to.
2. Voters: the learned lexicon of words and those of each length of prefix, fixed lists of insults and of threats near a
   second person, hits addressed to a second person, hits spelt with digits or signs, shouting, runs of exclamation marks.
   Each document's votes are one small bit pattern; patterns are counted over all documents.
3. Label model: class-conditional trees over the voters (accuracies, and the strongest correlations as tree edges), fitted by
   expectation maximisation on the pattern counts.  Unlabelled and held-out documents enter with their class unknown, labelled
   training rows with it known, as without these anchors a false hit that several voters share counts as agreement.
4. Classifier: logistic regression on lexicon items and totals, fitted to the posteriors of a bounded sample of training
   documents (``most_rows``); it scores every whole text.

Labels are read for rows whose crc32(id as text) mod 5 is not 0, at most ``most_labels`` of them (by hash of the id).
Neither labels nor language nor source nor id is an input of a score.

Defined results: null, empty and wordless texts have no hits and get the score of a text without any; without labelled
toxic rows there is no classifier and all scores are low; of several labels of one id the largest counts; rows that repeat an
id are scored each; an empty table gives no rows; other columns pass through ``clean`` untouched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from . import wordarrays as wa
from .common import blocks, cut, lean, per_block, require

_U = np.uint64
VOTERS = ["words", "prefixes_4", "prefixes_5", "prefixes_6", "insults", "addressed", "threats", "disguised", "shouting", "exclaiming"]
#: The voters that first decide how toxic a pattern is.
LEXICONS = 5
# Common insults, words of threats, and second persons.
INSULTS = """asshole bastard bitch coward creep cretin degenerate dickhead disgusting dumb dumbass dunce fool freak garbage idiot idiotic idiots imbecile jerk
 loser losers lowlife maggot moron moronic morons motherfucker parasite pathetic pig prick retard retarded scum scumbag shithead slut stupid subhuman swine trash
 twat ugly vermin whore worthless abschaum arschloch depp drecksack dummkopf hurensohn idioten schlampe schwachkopf trottel wichser connard connasse crétin débile
 enculé imbécile ordure pute salaud salope cabrón estúpido gilipollas hijoputa idiota imbécil mierda pendejo puta tonto""".split()
THREATS = "kill die hurt hang shoot stab burn beat destroy rape umbringen sterben töten crève crever tuer mourir matar muérete morir".split()
SECOND_PERSONS = "you your you're youre yourself u ur ya du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
# End of fixed values.
#: Digits and signs that stand for letters.
_DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_LEET = wa.ALNUM.copy()
for _sign, _letter in _DISGUISE.items():
    _LEET[ord(_sign)] = ord(_letter)


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")), F.lit(folds)), F.lit(0))


def features_of(column: pa.Array) -> tuple[wa.Words, list[np.ndarray]]:
    """Words of all texts, and for each word four feature ids: itself and its prefixes (0 where it is shorter)."""
    words = wa.words_of(column, wa.ALNUM)
    size = words.ends - words.starts
    packed, prefixes = np.zeros(len(size), dtype=_U), []
    top = max(len(words.data) - 1, 0)
    for j in range(6):
        byte = wa.ALNUM[words.data[np.minimum(words.starts + j, top)]].astype(_U) if len(size) else packed
        packed = packed | np.where(size > j, byte, _U(0)) << _U(8 * j)
        if j >= 3:
            prefixes.append(np.where(size > j, wa.mix(packed + (_U(j) << _U(56))), _U(0)))
    return words, [words.hashes, *prefixes]


def _hashes(words: list[str]) -> np.ndarray:
    found = wa.words_of(pa.array([" ".join(words)]), wa.ALNUM)
    return np.unique(found.hashes)


class Lexicon:
    """Feature ids with their kinds, and a table that rules most words out at once."""

    def __init__(self, ids: np.ndarray, kinds: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.kinds = ids[order], kinds[order]
        self.table = np.zeros(1 << 16, dtype=bool)
        self.table[(self.ids >> _U(48)).astype(np.int64)] = True
        self.insults, self.threats, self.persons = _hashes(INSULTS), _hashes(THREATS), _hashes(SECOND_PERSONS)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions that hit, items they hit)."""
        at = np.flatnonzero(self.table[(ids >> _U(48)).astype(np.int64)])
        if not len(at) or not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        item = np.minimum(np.searchsorted(self.ids, ids[at]), len(self.ids) - 1)
        hit = self.ids[item] == ids[at]
        return at[hit], item[hit]


def _per_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n)


def _near(a: np.ndarray, b: np.ndarray, row_of: np.ndarray, reach: int = 4) -> np.ndarray:
    """Those of the positions ``a`` that have one of ``b`` in the same row at most ``reach`` words away."""
    if not len(a) or not len(b):
        return a[:0]
    after = np.minimum(np.searchsorted(b, a), len(b) - 1)
    before = np.maximum(after - 1, 0)
    close = lambda at: (np.abs(b[at] - a) <= reach) & (row_of[b[at]] == row_of[a])
    return a[close(after) | close(before)]


def examine(column: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(vote patterns, feature matrix) of texts."""
    words, ids = features_of(column)
    n, m = len(words.first) - 1, len(lexicon.ids)
    row_of = words.row_of()
    x = np.zeros((n, m + 4))
    votes = np.zeros((n, len(VOTERS)), dtype=bool)
    vote = lambda name, at: votes.__setitem__((row_of[at], VOTERS.index(name)), True)
    hit_words = []
    for kind, values in enumerate(ids):
        at, item = lexicon.find(values)
        keep = lexicon.kinds[item] == kind
        at, item = at[keep], item[keep]
        x[row_of[at], item] = 1.0
        vote(VOTERS[kind], at)
        hit_words.append(at)
    hits = np.unique(np.concatenate(hit_words))
    insults, threats, persons = (np.flatnonzero(np.isin(words.hashes, known)) for known in (lexicon.insults, lexicon.threats, lexicon.persons))
    vote("insults", insults)
    vote("addressed", _near(np.union1d(hits, insults), persons, row_of))
    vote("threats", _near(threats, persons, row_of))
    count = _per_row(row_of[hits], n)
    n_words = np.diff(words.first)
    odd = wa.words_of(column, _LEET)
    at, item = lexicon.find(odd.hashes)
    at = np.union1d(at[lexicon.kinds[item] == 0], np.flatnonzero(np.isin(odd.hashes, lexicon.insults)))
    at = at[~np.isin(odd.starts[at], words.starts[np.union1d(hits, insults)])]
    hidden = _per_row(odd.row_of()[at], n)
    votes[:, VOTERS.index("disguised")] = hidden > 0
    data, bounds = words.data, words.bounds
    upper, mark = (data >= 65) & (data <= 90), data == 33
    letter = upper | ((data >= 97) & (data <= 122))
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])
    letters = sums(letter)
    votes[:, VOTERS.index("shouting")] = (letters >= 20) & (sums(upper) * 2 > letters)
    double = np.zeros(len(data), dtype=bool)
    double[1:] = mark[1:] & mark[:-1]
    votes[:, VOTERS.index("exclaiming")] = sums(double) > 0
    x[:, m] = np.log1p(count)
    x[:, m + 1] = np.log1p(1000 * count / np.maximum(n_words, 1))
    x[:, m + 2] = np.log1p(hidden)
    x[:, m + 3] = np.log1p(_per_row(row_of[insults], n))
    return votes @ (1 << np.arange(len(VOTERS))), x


def fit_label_model(patterns: np.ndarray, unknown: np.ndarray, clean: np.ndarray | float = 0.0, toxic: np.ndarray | float = 0.0, rounds: int = 60) -> dict:
    """EM over pattern counts.  Returns the posterior of each pattern, the voters' rates by class, the tree and the correlations."""
    v = (patterns[:, None] >> np.arange(len(VOTERS)) & 1).astype(float)
    m = v.shape[1]
    q = 1 / (1 + np.exp(3 - 2 * v[:, :LEXICONS].sum(axis=1)))
    for _ in range(rounds):
        weights = [unknown * (1 - q) + clean, unknown * q + toxic]
        logs, info, tables = [], np.zeros((m, m)), []
        for w in weights:
            total = w.sum() + 4.0
            both = v.T @ (w[:, None] * v)
            one = v.T @ w
            joint = np.empty((2, 2, m, m))
            joint[1, 1] = (both + 1) / total
            joint[1, 0] = (one[:, None] - both + 1) / total
            joint[0, 1] = (one[None, :] - both + 1) / total
            joint[0, 0] = 1 - joint[1, 1] - joint[1, 0] - joint[0, 1]
            joint = np.maximum(joint, 1e-12)
            left, right = joint.sum(axis=1, keepdims=True), joint.sum(axis=0, keepdims=True)
            info += w.sum() * (joint * np.log(joint / (left * right))).sum(axis=(0, 1))
            tables.append(joint)
        parent = _tree(info)
        for w, joint in zip(weights, tables, strict=True):
            log = np.full(len(patterns), math.log((w.sum() + 1) / (sum(x.sum() for x in weights) + 2)))
            for j, up in enumerate(parent):
                mine = v[:, j].astype(int)
                if up < 0:
                    log += np.log(joint[:, :, j, (j + 1) % m].sum(axis=1))[mine]
                else:
                    above = v[:, up].astype(int)
                    pair = joint[:, :, j, up]
                    log += np.log(pair[mine, above] / pair.sum(axis=0)[above])
            logs.append(log)
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        done, q = np.abs(new - q).max() < 1e-7, new
        if done:
            break
    rates = [(v.T @ w + 1) / (w.sum() + 2) for w in weights]
    excess = [joint[1, 1] - np.outer(r, r) for joint, r in zip(tables, rates, strict=True)]
    return {"posterior": q, "rates": rates, "parent": parent, "correlations": excess}


def _tree(info: np.ndarray) -> list[int]:
    """Parents in the maximum spanning tree; -1 at the root, voter 0."""
    m = len(info)
    parent, inside = [-1] * m, {0}
    while len(inside) < m:
        _, i, j = max((info[i, j], -i, -j) for i in inside for j in range(m) if j not in inside)
        parent[-j] = -i
        inside.add(-j)
    return parent


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, the intercept last, by iteratively reweighted least squares."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _count_features(docs: DataFrame, id_col: str, text_col: str, labels, only: int | None, known: np.ndarray | None) -> DataFrame:
    """(f, kind, c): in how many labelled texts of class ``only`` each feature, or each of ``known``, occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(batches):
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def emit():
            for kind, (f, c) in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(np.full(len(f), kind, np.int32)), pa.array(c)], names=["f", "kind", "c"])
            total.clear()

        ids, classes = labels.value
        for batch in (part for whole in batches for part in blocks(whole, "text")):
            key = batch.column(0).fill_null(-1).to_numpy()
            at = np.minimum(np.searchsorted(ids, key), max(len(ids) - 1, 0))
            mine = (ids[at] == key) & (classes[at] == only) if len(ids) else np.zeros(len(key), bool)
            mine &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            words, values = features_of(batch.column(1).filter(pa.array(mine)))
            row_of = words.row_of()
            for kind, ids_of in enumerate(values):
                keep = ids_of != 0
                if shared is not None and len(shared.value):
                    place = np.minimum(np.searchsorted(shared.value, ids_of), len(shared.value) - 1)
                    keep &= shared.value[place] == ids_of
                order = np.lexsort((row_of[keep], ids_of[keep]))
                f, r = ids_of[keep][order], row_of[keep][order]
                new = np.ones(len(f), bool)
                new[1:] = (f[1:] != f[:-1]) | (r[1:] != r[:-1])
                f, c = np.unique(f[new], return_counts=True)
                if kind in total:
                    f, inverse = np.unique(np.concatenate([total[kind][0], f]), return_inverse=True)
                    c = np.bincount(inverse, weights=np.concatenate([total[kind][1], c]), minlength=len(f)).astype(np.int64)
                total[kind] = f, c.astype(np.int64)
            if sum(len(f) for f, _ in total.values()) > 1_000_000:
                yield from emit()
        yield from emit()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "f long, kind int, c long")
    return rows.groupBy("f", "kind").agg(F.sum("c").alias("c"))


def _labels(labels: DataFrame, id_col: str, label_col: str, folds: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, class) of labelled training rows, by id."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold_of(id_col, folds) != 0))
    rows = rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    count = rows.count()
    if count > most:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * most / count))
    table = rows.toArrow()
    ids = table.column("id").to_numpy()
    order = np.argsort(ids)
    return ids[order], table.column("y").to_numpy()[order].astype(np.int8)


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", folds=5, support=0.005, least_odds=2.0, chance=1.0, items=256, most_labels=2_000_000, most_rows=20_000) -> dict:
    """Lexicon, label model and classifier weights."""
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    spark = docs.sparkSession
    known = _labels(labels, id_col, label_col, folds, most_labels)
    shared = spark.sparkContext.broadcast(known)
    n_toxic, n_clean = int((known[1] == 1).sum()), int((known[1] == 0).sum())
    lexicon = Lexicon(np.zeros(0, _U), np.zeros(0, np.int64))
    if n_toxic:
        least = max(3, math.ceil(support * n_toxic))
        found = _count_features(docs, id_col, text_col, shared, 1, None).where(F.col("c") >= least).toArrow().sort_by([("f", "ascending")])
        ids, kinds, pos = (found.column(c).to_numpy() for c in ("f", "kind", "c"))
        other = _count_features(docs, id_col, text_col, shared, 0, np.unique(ids.view(_U))).toArrow()
        seen = {(f, k): c for f, k, c in zip(*(other.column(c).to_pylist() for c in ("f", "kind", "c")), strict=True)}
        neg = np.array([seen.get((f, k), 0) for f, k in zip(ids.tolist(), kinds.tolist(), strict=True)], dtype=float)
        odds = np.log((pos + 0.5) / (n_toxic + 1)) - np.log((neg + 0.5) / (n_clean + 1))
        share = min(n_toxic / (n_toxic + n_clean), 1 - 1e-9)
        gain = 2 * (pos * np.log(pos / ((pos + neg) * share)) + neg * np.log(np.maximum(neg, 1e-9) / ((pos + neg) * (1 - share))))
        keep = np.flatnonzero((odds >= least_odds) & (gain >= 2 * math.log(max(len(pos), 1) / chance)))  # of all features, few by chance
        keep = keep[np.argsort(-odds[keep] * np.log1p(pos[keep]), kind="stable")[:items]]
        lexicon = Lexicon(ids[keep].view(_U), kinds[keep].astype(np.int64))

    tool = spark.sparkContext.broadcast(lexicon)
    total = docs.count()
    rate = min(1.0, 1.2 * most_rows / max(total, 1))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        votes, x = examine(batch.column(1), tool.value)
        ids, classes = shared.value
        key = batch.column(0).fill_null(-1).to_numpy()
        at = np.minimum(np.searchsorted(ids, key), max(len(ids) - 1, 0))
        label = np.where(ids[at] == key, classes[at], -1) if len(ids) else np.full(len(key), -1)
        label[batch.column(0).is_null().to_numpy(zero_copy_only=False)] = -1
        rows = [row.astype(np.float32).tobytes() if d else None for row, d in zip(x, batch.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(votes, pa.int32()), pa.array(label, pa.int32()), pa.array(rows, pa.binary())], names=["votes", "label", "x"])

    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(9)), F.lit(1 << 40))
    chosen = (fold_of(id_col, folds) != 0) & (chance < int((1 << 40) * rate))
    seen_rows = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), chosen.alias("drawn")).mapInArrow(per_block(run, "text"), "votes int, label int, x binary"))
    counts = seen_rows.groupBy("votes").agg(*(F.count_if(F.col("label") == k).alias(f"n{k + 1}") for k in (-1, 0, 1))).orderBy("votes").toArrow()
    patterns = counts.column("votes").to_numpy().astype(np.int64)
    model = fit_label_model(patterns, *(counts.column(f"n{k}").to_numpy().astype(float) for k in range(3))) if len(patterns) else {"posterior": np.zeros(0)}
    sample = seen_rows.where("x is not null").select("votes", "x").limit(most_rows).toArrow()
    width = len(lexicon.ids) + 4
    weights = np.zeros(width + 1)
    weights[-1] = -4.0
    if n_toxic and sample.num_rows:
        x = np.frombuffer(b"".join(sample.column("x").to_pylist()), dtype=np.float32).reshape(-1, width).astype(float)
        y = model["posterior"][np.searchsorted(patterns, sample.column("votes").to_numpy())]
        weights = fit_logistic(x, y)
    return {"lexicon": lexicon, "weights": weights, "label_model": model, "patterns": patterns}


def _scored(docs: DataFrame, model: dict, text_col: str) -> DataFrame:
    """(doc, score): each row as a struct, and its score."""
    shared = docs.sparkSession.sparkContext.broadcast((model["lexicon"], model["weights"]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lexicon, weights = shared.value
        _, x = examine(batch.column(1), lexicon)
        score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -500, 500)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc", "score"])

    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), docs[text_col].alias("text"))
    return rows.mapInArrow(per_block(run, "text"), StructType().add("doc", rows.schema["doc"].dataType).add("score", DoubleType()))


def scores(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", folds=5, **options) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col, folds=folds, **options)
    out = _scored(docs.select(id_col, text_col), model, text_col).select(F.col("doc").getField(id_col).alias(id_col), "score")
    return out.select(F.col(id_col), (fold_of(id_col, folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", most=0.5, **options) -> DataFrame:
    """The documents that score below ``most``, with all their columns."""
    model = train(docs, labels, id_col, text_col, **options)
    return _scored(docs, model, text_col).where(F.col("score") < most).select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
