"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence's score is a logistic model of its distinct words; a document's score is the noisy-or of
its sentences' scores, 1 - (1 - p1)(1 - p2)... Only documents have labels. The gradient of the
document's likelihood gives each sentence its share of the blame, so the model learns which sentences
offend and can point at them.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, received, sent, without

#: Bounds of the sample that the model is fitted to: labelled documents, and their characters.
SAMPLE_DOCS = 5_000
SAMPLE_CHARS = 16_000_000
#: Texts of more characters come into the sample after all others.
LONG_CHARS = 500_000
LEAST_WORDS = 5  # of a sentence
LEAST_DOCS = 3  # documents of the sample that must hold a feature
ROUNDS = 60
RATE = 0.5
DECAY = 0.03  # of a document, by which each weight is drawn to zero
#: A sentence starts this much (in logits) below an even share of the toxic documents, so that long clean texts stay low.
HEADROOM = 3.0
OFFENDING = 0.5
#: Logit of a sentence's score up to which its words are taken for chance and add nothing to the document.
EVIDENCE = -2.0
#: Bias of a model without words to learn from: every text, of any length, scores 0.
NO_EVIDENCE = -math.inf
#: Words whose weights a task remembers.
REMEMBERED = 200_000

SENTENCE = re.compile(r"[^.!?\n]+")
WORDS = re.compile(r"[^\W_]+")
RESULT = "struct<score:double,sentences:array<struct<start:int,end:int,score:double>>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
_RESULT = pa.struct([("score", pa.float64()), ("sentences", _SPANS)])


def features(word: str) -> list[str]:
    """What a word shows: itself, its beginnings and endings."""
    marked = f"<{word}>"
    n = len(marked)
    return [marked, *[marked[:k] for k in range(4, min(n, 8))], *[marked[n - k :] for k in range(4, min(n, 8))]]


def sentence_words(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and distinct words of each sentence that has any; fragments are joined up to LEAST_WORDS words."""
    start, end, words, count = 0, 0, set(), 0
    for m in SENTENCE.finditer(text):
        found = WORDS.findall(m.group().lower())
        if not found:
            continue
        start = start if words else m.start()
        end, count = m.end(), count + len(found)
        words.update(found)
        if count >= LEAST_WORDS:
            yield start, end, words
            words, count = set(), 0
    if words:
        yield start, end, words


def bounded_sample(
    docs: DataFrame, known: DataFrame, text: str, key: str, most_docs: int, most_chars: int, seed: int = 42,
    long_chars: int = LONG_CHARS,
) -> tuple[Iterator[str], np.ndarray]:
    """Texts and labels (0 or 1) of the first ``known`` rows (k, y) in a seeded order, within both bounds.

    A text longer than ``most_chars`` can't be in the sample and takes no room in it. Texts longer than
    ``long_chars`` come after the others, so that one of them keeps no shorter one out.

    Keys are chosen before their texts are looked up, so that only the sample's texts leave their
    tasks. A key that several rows share counts with the rows that fit.
    """
    order = F.xxhash64(F.lit(seed), "k")
    first = known.filter("k IS NOT NULL AND y IN (0, 1)").orderBy(order, "k", "y").limit(most_docs)
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    texts = texts.filter(F.length("t") <= most_chars)
    upto = Window.orderBy(F.length("t") > long_chars, order, "k", F.xxhash64("t"), "y").rowsBetween(Window.unboundedPreceding, 0)
    numbered = texts.join(first, "k").withColumns({"n": F.count(F.lit(1)).over(upto), "chars": F.sum(F.length("t")).over(upto)})
    rows = numbered.filter((F.col("n") <= most_docs) & (F.col("chars") <= most_chars)).select("n", "t", "y").toArrow().sort_by("n")
    return (t.as_py() for t in rows.column("t")), np.array(rows.column("y").to_pylist(), int)


class Model:
    """Weights of features and a bias; scores sentences and documents."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights, self.known = bias, weights, {}

    def __getstate__(self):
        return self.bias, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def word(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            get = self.weights.get
            found = sum(get(f, 0.0) for f in features(word))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found

    def document(self, text: str) -> tuple[float, list[dict]]:
        """Noisy-or score and the offending sentences.

        A document without evidence scores by the bias, once and not for each of its sentences, and a sentence adds
        what it scores beyond a sentence of no evidence: a clean text scores the same however long it is.
        """
        spans, none = [], softplus(self.bias)
        clean = -none
        for start, end, words in sentence_words(text):
            z = self.bias + sum(map(self.word, sorted(words)))
            if z > EVIDENCE:
                clean -= softplus(z) - none
            if z >= 0:  # a score of OFFENDING or more
                spans.append({"start": start, "end": end, "score": 1 / (1 + math.exp(-z))})
        return 0.0 - math.expm1(clean), spans


def softplus(z: float) -> float:
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


def fit(texts: Iterable[str], labels: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Weights by gradient ascent (Adagrad) on the likelihood of the documents' labels under noisy-or."""
    numbers: dict[str, int] = {}
    words, sentences, documents = array("i"), array("i"), array("i")
    seen = array("i")  # documents that hold a word
    for text in texts:
        own: set[int] = set()
        count = 0
        for _, _, found in sentence_words(text):
            ids = [numbers.setdefault(w, len(numbers)) for w in sorted(found)]
            words.extend(ids)
            sentences.append(len(ids))
            own.update(ids)
            count += 1
        documents.append(count)
        seen.extend(own)
    keep = np.array(documents, np.int64) > 0
    y, documents = np.asarray(labels, float)[keep], np.array(documents, np.int64)[keep]
    if not len(y) or not words:
        return Model(NO_EVIDENCE, {})
    holders = np.bincount(np.array(seen), minlength=len(numbers))
    names: dict[str, int] = {}
    flat, lengths = array("i"), array("i")
    for w in numbers:
        ids = [names.setdefault(f, len(names)) for f in features(w)]
        flat.extend(ids)
        lengths.append(len(ids))
    flat, lengths = np.array(flat, np.int32), np.array(lengths, np.int64)
    of_word = np.repeat(np.arange(len(numbers), dtype=np.int32), lengths)
    # words that share a feature may share documents too: an upper bound of its documents
    enough = np.bincount(flat, np.repeat(holders, lengths), minlength=len(names)) >= LEAST_DOCS
    use = enough[flat]
    flat, of_word = flat[use], of_word[use]
    words = np.array(words, np.int32)
    first_word = np.concatenate([[0], np.cumsum(sentences)[:-1]])
    first_sentence = np.concatenate([[0], np.cumsum(documents)[:-1]])
    sentences = np.array(sentences)
    weights, squares = np.zeros(len(names)), np.full(len(names), 1e-3)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias, bias_squares = math.log(share / documents.mean()) - HEADROOM, 1e-3
    for _ in range(rounds):
        by_word = np.bincount(of_word, weights[flat], minlength=len(numbers))
        z = bias + np.add.reduceat(by_word[words], first_word)
        clean = -np.add.reduceat(np.logaddexp(0, z), first_sentence)
        p = -np.expm1(clean)
        # of the log-likelihood by a sentence's logit: its score times (1 - p) / p, or its score less
        blame = np.where(y == 1, np.exp(clean) / np.maximum(p, 1e-12), -1.0)
        slope = np.repeat(blame, documents) / (1 + np.exp(-np.clip(z, -60, 60)))
        up = np.bincount(words, np.repeat(slope, sentences), minlength=len(numbers))
        gradient = np.bincount(flat, up[of_word], minlength=len(names)) - DECAY
        squares += gradient**2
        weights = np.maximum(weights + RATE * gradient / np.sqrt(squares), 0)
        push = slope.sum()
        bias_squares += push**2
        bias += RATE * push / math.sqrt(bias_squares)
    # the bias moves slowly among so many weights: the likeliest one for these weights
    z = np.add.reduceat(np.bincount(of_word, weights[flat], minlength=len(numbers))[words], first_word)

    def likelihood(b: float) -> float:
        clean = -np.add.reduceat(np.logaddexp(0, z + b), first_sentence)
        return float(np.where(y == 1, np.log(np.maximum(-np.expm1(clean), 1e-12)), clean).sum())

    bias = max((bias + d for d in np.linspace(-3, 3, 25)), key=likelihood)
    names_of = list(names)
    return Model(bias, {names_of[i]: float(weights[i]) for i in np.flatnonzero(np.abs(weights) > 1e-3)})


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
    sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS,
    long_chars: int = LONG_CHARS,
) -> Model:
    """A model from a bounded sample of the labelled rows that are not held out.

    At most ``sample_docs`` documents with at most ``sample_chars`` characters in all are fitted to, in
    the driver; texts of more than ``long_chars`` come last. Rows with a null key or
    label teach nothing; without labelled rows that have words in their texts every score is 0.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter(~held_out(F.col("k")))
    return fit(*bounded_sample(docs, known, text, key, sample_docs, sample_chars, long_chars=long_chars))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Every row with ``out``: its ``score`` (0 to 1) and the offending ``sentences`` (start, end, score).

    Starts and ends count code points. A map over rows: no shuffle; the model's size is bounded by the
    sample it was fitted to.

    The model is fitted with a floor (the bias) for every sentence; a document's score counts that floor once, and of its
    sentences what they add to it, if their evidence is more than chance. So a clean text scores the same
    however long it is (tested up to 10 million characters).

    Defined cases: null and empty texts and texts without words score by the bias alone (near 0);
    repeated rows score alike; an empty table gives no rows. ``out`` replaces an input column of its name.
    """
    keep = without(docs.columns, out)
    [whole] = fresh([*keep, out], "whole")
    known = sent(docs.sparkSession, model)
    rows = docs.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").cast("string").alias(whole))
    schema = rows.drop(whole).withColumn(out, F.lit(None).cast(RESULT)).schema

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(known)
        for batch in batches:
            found = [model.document(t.as_py() or "") for t in batch.column(batch.num_columns - 1)]
            scores = pa.StructArray.from_arrays(
                [pa.array([s for s, _ in found], pa.float64()), pa.array([x for _, x in found], _SPANS)], fields=list(_RESULT)
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*keep, out])

    return rows.mapInArrow(find, schema)
