"""LM scoring by masked pseudo-likelihood: every token is predicted from both sides, and the log-probabilities are summed.

Method: words become tokens of a vocabulary counted over the whole corpus (the most frequent ones, the others by hash
buckets). A network of numpy arrays sees two tokens to the left and two to the right of a position, joins their
embeddings, and predicts the token in the middle by a two-step softmax (class, then token within the class). There are as
many classes as tokens in a class, 32 or more: tokens, a quarter of them hash buckets, grow with the root of the number of
distinct words, since the weights of all of them meet in every round.
Training runs where the data are: in every round each block of documents starts from the shared weights, takes its
gradient steps over its own tokens, and sends its weights back; the weights are averaged by the blocks' token counts,
summed up on the executors. Every token trains: a round takes every ``STRIDE``-th position of every text, in
another phase each round, and there are as many rounds as phases.

Score of a document: the sum over all positions of ln p(token | both sides), and its mean per token. Defined cases: null
or empty text has no tokens, score 0 and a null mean; positions beyond the text's ends are a padding token; equal texts
have equal scores up to rounding; rows are independent, so repeated rows repeat their result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm import core
from fieldtrace.llm.registry import query

LEAST = 32  # classes, and tokens of a class, of a small vocabulary
TOKENS = LEAST * LEAST  # 0 is padding; then frequent words; the last quarter is shared by the rest
GROWTH = 2.25  # tokens for the root of the number of distinct words
SIDE, WIDTH, HIDDEN = 2, 12, 32  # tokens on a side, embedding, hidden layer
STRIDE, RATE = 3, 4.0
ROUNDS = STRIDE  # all phases, so all tokens
PER_CLASS = 32  # tokens of a step for each class


def room(classes: int) -> int:
    """Words that have a token of their own with this many classes."""
    return classes * classes - classes * classes // 4 - 1


def classes_for(n_words: int) -> int:
    """The least number of classes that has room for so many words."""
    c = LEAST
    while room(c) < n_words:
        c += 1
    return c


def shapes(classes: int) -> dict[str, tuple]:
    return {"embed": (classes * classes, WIDTH), "hidden": (2 * SIDE * WIDTH, HIDDEN), "bias": (HIDDEN,), "to_class": (HIDDEN, classes), "class_bias": (classes,),
            "to_token": (classes, HIDDEN, classes), "token_bias": (classes, classes)}


def classes_of(weights: np.ndarray) -> int:
    """Number of classes of a row of weights: it grows with the row's length."""
    per, fixed = WIDTH + HIDDEN + 1, 2 * SIDE * WIDTH * HIDDEN + HIDDEN
    return round((((HIDDEN + 1) ** 2 + 4 * per * (len(weights) - fixed)) ** 0.5 - HIDDEN - 1) / (2 * per))


def start(seed: int = 7, classes: int = LEAST) -> np.ndarray:
    """All weights in one row, small and random."""
    rng = np.random.default_rng(seed)
    return np.concatenate([(rng.normal(0, 0.1 if len(s) > 1 else 0, s)).ravel() for s in shapes(classes).values()]).astype(np.float32)


def views(weights: np.ndarray) -> dict[str, np.ndarray]:
    own = shapes(classes_of(weights))
    parts = np.split(weights, np.cumsum([int(np.prod(s)) for s in own.values()])[:-1])
    return {k: p.reshape(s) for (k, s), p in zip(own.items(), parts, strict=True)}


class Vocabulary:
    """Words to token ids: frequent words have their own, the others one of the hashed ones."""

    def __init__(self, words: list[bytes]):
        self._known = {w: k + 1 for k, w in enumerate(words)}
        classes = classes_for(len(words))
        self._first, self._shared = room(classes) + 1, classes * classes - room(classes) - 1

    def _rare(self, word: bytes) -> int:
        return self._first + xxhash.xxh3_64_intdigest(word) % self._shared

    def tokens(self, text: bytes) -> bytes:
        """Tokens of a text as little-endian 32-bit integers."""
        known, rare = self._known, self._rare
        return np.array([known[w] if w in known else rare(w) for w in text.lower().split()], "<u4").tobytes()


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all texts with SIDE paddings before and after each, number of tokens of each text)."""
    gap = bytes(4 * SIDE)
    return np.frombuffer(gap + b"".join(t + gap for t in texts), "<u4").astype(np.int32), np.array([len(t) // 4 for t in texts], np.int64)


def positions(lengths: np.ndarray) -> np.ndarray:
    """Places of the tokens in a padded row of texts."""
    begin = np.cumsum(lengths + SIDE) - lengths
    return np.repeat(begin - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def phase(lengths: np.ndarray, turn: int) -> np.ndarray:
    """Places of every ``STRIDE``-th token of each text, from its token ``turn`` on."""
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return positions(lengths)[within % STRIDE == turn]


def _context(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([row[at + d] for d in range(-SIDE, SIDE + 1) if d], 1)


def _forward(w: dict, context: np.ndarray):
    x = w["embed"][context].reshape(len(context), -1)
    h = np.tanh(x @ w["hidden"] + w["bias"])
    return x, h


def _softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(-1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(-1, keepdims=True)
    return z


def _runs(classes: np.ndarray):
    """(class, from, upto) of runs in a sorted row of classes."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(classes)) + 1, [len(classes)]])
    return [(int(classes[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def log_likelihood(weights: np.ndarray, row: np.ndarray, at: np.ndarray, piece: int = 1 << 16) -> np.ndarray:
    """ln p of the token at each place, given both sides."""
    w, out = views(weights), np.empty(len(at), np.float64)
    members = len(w["class_bias"])
    for a in range(0, len(at), piece):
        own = at[a:a + piece]
        target = row[own]
        order = np.argsort((target // members).astype(np.int16), kind="stable")
        own, target = own[order], target[order]
        _, h = _forward(w, _context(row, own))
        z = h @ w["to_class"] + w["class_bias"]
        got = z[np.arange(len(own)), target // members] - np.log(np.exp(z).sum(1))
        for c, i, j in _runs(target // members):
            z = h[i:j] @ w["to_token"][c] + w["token_bias"][c]
            got[i:j] += z[np.arange(j - i), target[i:j] % members] - np.log(np.exp(z).sum(1))
        out[a + order] = got
    return out


def step(weights: np.ndarray, row: np.ndarray, at: np.ndarray, rate: float = RATE) -> None:
    """One gradient step on the tokens at these places, in place."""
    w, target = views(weights), row[at]
    members = len(w["class_bias"])
    order = np.argsort((target // members).astype(np.int16), kind="stable")
    at, target = at[order], target[order]
    context = _context(row, at)
    x, h = _forward(w, context)
    scale = np.float32(rate / len(at))
    p = _softmax(h @ w["to_class"] + w["class_bias"])
    p[np.arange(len(at)), target // members] -= 1
    back = p @ w["to_class"].T
    w["to_class"] -= scale * (h.T @ p)
    w["class_bias"] -= scale * p.sum(0)
    for c, i, j in _runs(target // members):
        q = _softmax(h[i:j] @ w["to_token"][c] + w["token_bias"][c])
        q[np.arange(j - i), target[i:j] % members] -= 1
        back[i:j] += q @ w["to_token"][c].T
        w["to_token"][c] -= scale * (h[i:j].T @ q)
        w["token_bias"][c] -= scale * q.sum(0)
    back *= 1 - h * h
    down = (back @ w["hidden"].T).reshape(-1, WIDTH)
    w["hidden"] -= scale * (x.T @ back)
    w["bias"] -= scale * back.sum(0)
    flat = context.ravel()
    order = np.argsort(flat, kind="stable")
    edges = np.flatnonzero(np.diff(flat[order], prepend=-1))
    w["embed"][flat[order][edges]] -= scale * np.add.reduceat(down[order], edges, axis=0)


def _tokens(words: list[bytes]):
    def run(batches):
        known = Vocabulary(words)
        for batch in core.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([known.tokens(x) for x in core.blobs(batch)], pa.binary())], names=["doc_id", "data"])

    return run


def tokenised(docs: DataFrame, words: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, data): whole texts as tokens, stored once for all rounds and the scores."""
    return core.cut(core.texts(docs, id_col, text_col).mapInArrow(_tokens(words), "doc_id long, data binary"))


def _train(weights: bytes, turn: int):
    """The tokens of one partition train from the shared weights; out come weights times tokens, and tokens."""

    def run(batches):
        own, count = np.frombuffer(weights, np.float32).copy(), 0
        size = PER_CLASS * classes_of(own)
        for batch in core.slices(batches):
            row, lengths = padded(core.blobs(batch))
            at = phase(lengths, turn)
            for a in range(0, len(at), size):
                step(own, row, at[a:a + size])
            count += len(at)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([(own.astype(np.float64) * count).tobytes()], pa.binary()), pa.array([count], pa.int64())], names=["total", "n"])

    return run


def _add(batches):
    """Sums of weights and of tokens."""
    total, n = None, 0
    for batch in batches:
        for data, k in zip(batch.column("total").to_pylist(), batch.column("n").to_pylist(), strict=True):
            part = np.frombuffer(data, np.float64)
            total, n = part.copy() if total is None else total + part, n + k
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["total", "n"])


_SUMS = "total binary, n long"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[bytes]:
    """The most frequent words of all texts, most frequent first, as many as the number of distinct words asks for."""
    counts = core.texts(docs, id_col, text_col).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = core.cut(counts)
    classes = max(LEAST, round((GROWTH * counts.count() ** 0.5) ** 0.5))
    return [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(room(classes)).collect()]


def _count(batches):
    from collections import Counter

    counts: Counter = Counter()
    for batch in core.slices(batches):
        for text in core.blobs(batch):
            counts.update(text.lower().split())
        if len(counts) > 200_000:  # pre-aggregated in bounded memory; the sum follows after the shuffle
            yield _counted(counts)
            counts = Counter()
    yield _counted(counts)


def _counted(counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def train(rows: DataFrame, rounds: int = ROUNDS, n_words: int = 0) -> np.ndarray:
    """Weights after ``rounds`` rounds of training in all partitions of ``tokenised`` rows and averaging.

    ``n_words`` is the size of the vocabulary that the rows were tokenised with.
    """
    weights = start(classes=classes_for(n_words))
    # as many tasks as the root of the partitions add up what these send, and one adds those few rows
    fan = max(1, int(rows.rdd.getNumPartitions() ** 0.5))
    for turn in range(rounds):
        sums = rows.mapInArrow(_train(weights.tobytes(), turn % STRIDE), _SUMS)
        total = sums.repartition(fan).mapInArrow(_add, _SUMS).repartition(1).mapInArrow(_add, _SUMS).collect()
        if total:
            weights = (np.frombuffer(total[0]["total"], np.float64) / total[0]["n"]).astype(np.float32)
    return weights


def _score(weights: bytes):
    def run(batches):
        own = np.frombuffer(weights, np.float32)
        for batch in core.slices(batches):
            row, lengths = padded(core.blobs(batch))
            each = log_likelihood(own, row, positions(lengths))
            total = np.array([each[e - n:e].sum() for e, n in zip(np.cumsum(lengths), lengths, strict=True)])  # one by one: equal texts, equal sums
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths), pa.array(total, pa.float64()),
                                              pa.array([t / n if n else None for t, n in zip(total.tolist(), lengths.tolist(), strict=True)], pa.float64())],
                                             names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return run


def score(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of whole texts, from ``tokenised`` rows."""
    return rows.mapInArrow(_score(weights.tobytes()), "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


@query("op6_pseudo_likelihood")
def op6(spark, sf_dir):
    docs = core.read(spark, sf_dir, "documents")
    words = vocabulary(docs)
    rows = tokenised(docs, words)
    return score(rows, train(rows, n_words=len(words)))
