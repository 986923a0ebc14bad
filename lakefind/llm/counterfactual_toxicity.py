"""Toxicity classifier with counterfactual logit pairing.

A logistic model over the words of a text and their beginnings (so that an
insult counts with every ending) is fitted on labelled documents.  For
every labelled text that names a group of people, counterfactual texts are made
by swapping each identity term (with its stems) for the other terms of its set,
and the squared change of the score is added to the loss.  What the labels say about the
neighbourhood of a group name then cannot be learned as a property of the name,
which lowers false positives on neutral mentions.

Only the fit is bounded (``max_rows`` labelled rows of each class, chosen by a
hash of their ids, of texts of at most ``max_text_bytes``, so that the driver gets
no more than twice their product); scoring covers every whole text and is one pass without a
shuffle.  The model that tasks receive holds the words kept by the L1 penalty,
so it does not grow with the corpus.

Defined results
---------------
* A null or empty text has no words; its score is the model's prior with no
  evidence and it is never rejected.
* Labels that are null, or whose document is missing, or whose text is null or
  longer than ``max_text_bytes`` are not used in the fit.  Repeated labels of one
  document count once, with the larger value; of rows that repeat a labelled
  doc_id the first text counts.
* Each identity term is one token.
* Without rows of both classes nothing can be fitted: every score is null and
  nothing is rejected.
* Rows are scored one by one: repeated rows, null or repeated doc_ids and extra
  columns of any name pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens as tk
from .common import bounded_batches, col, column_of, keep_rows, slices

#: Sets of identity terms; a term is swapped for every other term of its set.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"), ("she", "he"), ("her", "his"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("gay", "straight", "lesbian", "bisexual", "homosexual", "heterosexual", "queer", "transgender"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab"),
    ("immigrants", "citizens", "refugees", "foreigners", "natives"), ("disabled", "deaf", "blind"), ("old", "young", "elderly"),
    ("frauen", "männer"), ("juden", "christen", "muslime"), ("femmes", "hommes"), ("juifs", "chrétiens", "musulmans"),
    ("mujeres", "hombres"), ("judíos", "cristianos", "musulmanes"),
)

_PIECE = 1 << 20

#: Lengths in bytes of the word beginnings that are features besides the words.
STEMS = (5, 6, 7, 8)

#: Labelled rows of each class that the model is fitted on, and the longest text among them.
MAX_ROWS, MAX_TEXT_BYTES = 2000, 32 << 10

#: Weight of the squared score change under swaps.
PENALTY = 5.0

#: A text that scores this much is rejected.
THRESHOLD = 0.3


def _pairs(t: tk.Tokens) -> tuple[np.ndarray, np.ndarray, int]:
    """(text number, feature hash) of every word and stem, and the number of texts."""
    owner = t.owners()
    rows, hashes = [owner], [t.hash]
    for s in t.stems:
        at = np.flatnonzero(s)
        rows.append(owner[at])
        hashes.append(s[at])
    return np.concatenate(rows), np.concatenate(hashes), len(t.doc) - 1


@dataclass
class Model:
    """Weights of a logistic model on the presence of words and stems."""

    words: np.ndarray  # sorted token hashes
    weights: np.ndarray
    bias: float

    def logits(self, texts) -> np.ndarray:
        """The logit of each text of an Arrow string column."""
        owner, h, n = _pairs(tk.tokenize(texts, STEMS))
        if not len(self.words) or not len(h):
            return np.full(n, self.bias)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == h)
        key = np.unique(owner[hit] * len(self.words) + at[hit])
        return self.bias + np.bincount(key // len(self.words), self.weights[key % len(self.words)], n)


def _term_features(sets) -> list[dict[int, frozenset[int]]]:
    """For each set of terms, the features (word and stems) of each term, by the term's hash."""
    out = []
    for terms in sets:
        t = tk.tokenize(pa.array(list(terms), pa.large_string()), STEMS)
        if len(t.hash) != len(terms):
            raise ValueError("each identity term must be exactly one token")
        out.append({int(h): frozenset([int(h), *(int(s[i]) for s in t.stems if s[i])]) for i, h in enumerate(t.hash)})
    return out


def _swaps(t: tk.Tokens, sets: list[dict[int, frozenset[int]]], base: int) -> tuple[list, list, list, int]:
    """Changed features of the swapped texts of a few texts.

    For each text and identity term in it, one swap for every other term of the
    set: lists (swap number from base, feature hash, +1 or -1) of what the swap
    adds to and takes from the text's features.  A stem that another word of the
    text has too stays.
    """
    swap, feature, sign, n = [], [], [], base
    terms = np.unique(np.array([h for s in sets for h in s], np.uint64))
    every = np.unique(np.array([f for s in sets for fs in s.values() for f in fs], np.uint64))
    if not len(terms) or not len(t.hash):
        return swap, feature, sign, n
    owner = t.owners()
    for r in np.unique(owner[np.isin(t.hash, terms)]):
        lo, hi = t.doc[r], t.doc[r + 1]
        words, at = np.unique(t.hash[lo:hi], return_index=True)
        seen = np.concatenate([words, *(s[lo:hi][at] for s in t.stems)])
        seen, times = np.unique(seen[np.isin(seen, every)], return_counts=True)
        count = dict(zip(seen.tolist(), times.tolist()))
        have = set(words[np.isin(words, terms)].tolist())
        for s in sets:
            for a in s.keys() & have:
                for b in s.keys() - {a}:
                    gone = [f for f in s[a] - s[b] if count.get(f) == 1]
                    new = [f for f in s[b] - s[a] if f not in count]
                    swap += [n] * (len(gone) + len(new))
                    feature += gone + new
                    sign += [-1.0] * len(gone) + [1.0] * len(new)
                    n += 1
    return swap, feature, sign, n


def _features(texts: list[str], min_df: int, sets: list[dict[int, frozenset[int]]]):
    """Distinct (text, feature) pairs as (row numbers, feature numbers, vocabulary), and the swaps as (number, feature, sign, how many).

    The vocabulary has the features of min_df texts, and all of the identity
    terms: a swap may bring a term that no text has.
    """
    rows, hashes, i = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], 0
    swap, feature, sign, ns = [], [], [], 0
    while i < len(texts):  # few texts at a time: long ones have many pairs before they are made distinct
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= 1 << 20):
            size += len(texts[j])
            j += 1
        t = tk.tokenize(pa.array(texts[i:j], pa.large_string()), STEMS)
        owner, h, n = _pairs(t)
        words, inv = np.unique(h, return_inverse=True)
        key = np.unique(owner * max(1, len(words)) + inv)
        rows.append((key // max(1, len(words)) + i).astype(np.int32))
        hashes.append(words[key % max(1, len(words))])
        more = _swaps(t, sets, ns)
        ns = more[3]
        for all_, part in zip((swap, feature, sign), more):
            all_ += part
        i = j
    row, h = np.concatenate(rows), np.concatenate(hashes)
    words, df = np.unique(h, return_counts=True)
    extra = np.array([f for s in sets for fs in s.values() for f in fs], np.uint64)
    vocabulary = np.union1d(words[df >= min_df], extra)
    at = np.searchsorted(vocabulary, h)
    use = (at < len(vocabulary)) & (vocabulary[np.minimum(at, max(0, len(vocabulary) - 1))] == h) if len(vocabulary) else np.zeros(len(h), bool)
    places = np.searchsorted(vocabulary, np.array(feature, np.uint64))
    return row[use].astype(np.int64), at[use], vocabulary, (np.array(swap, np.int64), places, np.array(sign), ns)


def fit(texts: list[str], labels: list[int], *, penalty: float = PENALTY, l1: float = 0.015, min_df: int = 3, steps: int = 200, identity_terms=IDENTITY_TERMS) -> Model | None:
    """Fit the model: weighted logistic loss + penalty * mean squared score change under swaps + L1.

    FISTA on the smooth part with soft thresholding.  The L1 weight is l1 over the
    square root of the toxic texts, as what chance adds to a weight falls with
    their number.  None without both classes.
    """
    y = np.asarray(labels, float)
    if not (y > 0.5).any() or not (y <= 0.5).any():
        return None
    row, word, vocabulary, (swap, sf, ss, ns) = _features(texts, min_df, _term_features(identity_terms))
    n, m = len(texts), len(vocabulary)
    l1 /= np.sqrt((y > 0.5).sum())
    weight = np.where(y > 0.5, 0.5 / (y > 0.5).sum(), 0.5 / (y <= 0.5).sum())
    use_swaps = penalty > 0 and ns > 0

    def gradient(w, b):
        z = b + np.bincount(row, w[word], n)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        g = weight * (p - y)
        gw = np.bincount(word, g[row], m)
        if use_swaps:
            change = np.bincount(swap, ss * w[sf], ns)
            gw += penalty * 2 / ns * np.bincount(sf, ss * change[swap], m)
        return gw, g.sum()

    def curvature(w, b):
        z = b + np.bincount(row, w[word], n)
        hw = weight * 0.25 * z
        gw = np.bincount(word, hw[row], m)
        if use_swaps:
            gw += penalty * 2 / ns * np.bincount(sf, ss * np.bincount(swap, ss * w[sf], ns)[swap], m)
        return gw, hw.sum()

    # the step: a bound of the curvature by power iteration
    v, c, top = np.ones(m), 1.0, 1.0
    for _ in range(20):
        top = np.sqrt((v**2).sum() + c**2)
        v, c = curvature(v / top, c / top)
    rate = 1 / (1.05 * max(np.sqrt((v**2).sum() + c**2), 1e-9))
    w, b, uw, ub, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(steps):
        gw, gb = gradient(uw, ub)
        nw, nb = uw - rate * gw, ub - rate * gb
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * l1, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        uw, ub = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    kept = np.flatnonzero(w)
    return Model(vocabulary[kept], w[kept], float(b))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", label="toxic", max_rows: int = MAX_ROWS, max_text_bytes: int = MAX_TEXT_BYTES) -> tuple[list[str], list[int]]:
    """At most max_rows labelled texts of each class, of at most max_text_bytes, the same ones every time.

    The ids are chosen from the labels alone, so only a table of bounded size is
    sent to the scan of the documents.
    """
    l = labels.select(col(labels, doc_id).alias("i"), col(labels, label).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isNotNull())
    l = l.groupBy("i").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("i"))
    part = [l.where(F.col("y") == k if k else F.col("y") <= 0).orderBy("h", "i").limit(max_rows) for k in (0, 1)]
    chosen = part[0].unionByName(part[1]).collect()
    if not chosen:
        return [], []
    spark = docs.sparkSession
    id_type = labels.schema[doc_id].dataType.simpleString()
    # at most 2 * max_rows ids
    table = F.broadcast(spark.createDataFrame([(r["i"], r["y"]) for r in chosen], f"i {id_type}, y int"))
    d = docs.select(col(docs, doc_id).alias("d"), col(docs, text).alias("t")).where(F.octet_length("t") <= max_text_bytes)
    rows = d.join(table, F.col("d") == F.col("i")).groupBy("i", "y").agg(F.min("t").alias("t")).collect()
    rows = sorted((r["i"], r["y"], r["t"]) for r in rows)
    return [t for *_, t in rows], [min(1, max(0, y)) for _, y, _ in rows]


def train(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", label="toxic", max_rows: int = MAX_ROWS, max_text_bytes: int = MAX_TEXT_BYTES, **options) -> Model | None:
    """Fit the model on a bounded sample of the labelled documents."""
    texts, y = labelled_sample(docs, labels, doc_id=doc_id, text=text, label=label, max_rows=max_rows, max_text_bytes=max_text_bytes)
    return fit(texts, y, **options)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(docs: DataFrame, model: Model | None, *, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id and score, the probability that the text is toxic, of every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in slices(batches, "t", _PIECE):
            z = pa.array(_sigmoid(model.logits(column_of(b, "t")))) if model else pa.nulls(b.num_rows, pa.float64())
            yield pa.RecordBatch.from_arrays([column_of(b, "d"), z], names=["doc_id", "score"])

    return bounded_batches(docs).select(col(docs, doc_id).alias("d"), col(docs, text).alias("t")).mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, model: Model | None, *, text="text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, or is null or empty; columns as they were."""
    if model is None:
        return docs

    def stay(t):
        empty = np.asarray(pc.fill_null(pc.binary_length(t.cast(pa.large_string())), 0)) == 0
        return (_sigmoid(model.logits(t)) < threshold) | empty

    return keep_rows(docs, text, stay, _PIECE)
