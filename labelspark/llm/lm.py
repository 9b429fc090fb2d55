"""Language-model scores from a weighted backoff automaton.

Counts of all n-grams of the training rows are summed over the corpus by packed
exchange (see ``exchange``): every batch of documents sends its distinct
n-grams with their training counts and gets back the corpus totals of just
those.  From these it compiles the part of the automaton that its own texts can
reach: states are n-gram histories, a seen n-gram is an arc with the log of its
smoothed probability, and every state has a failure arc, weighted with the mass
it leaves to unseen words, to the state of the next shorter history.  Texts are
then traversed once from left to right.

Smoothing is Dirichlet at every order above one,
``p(w | h) = (c(h w) + mu p(w | h')) / (c(h) + mu)`` with h' the shorter
history; unigrams get ``(c + 0.1) / (N + 0.1 (V + 1))``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm import exchange
from labelspark.llm.shared import fold_of
from labelspark.llm.superminhash import WORD, Shingler, lower_az, mix

_U = np.uint64
END, START = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)
ADD = 0.1
_words = Shingler(1)  # caches word hashes for the life of a Python worker


class _Stream:
    """Tokens of a batch of texts, one end after each text."""

    def __init__(self, texts: list[str], ids: list, order: int, mod: int):
        parts, lengths = [], []
        for t in texts:
            h = _words.word_hashes(WORD.findall(lower_az(t)))
            parts += [h, np.array([END], _U)]
            lengths.append(len(h) + 1)
        self.lengths = np.array(lengths)
        self.held = np.array([fold_of(i, mod) == 0 for i in ids])
        tokens = np.concatenate(parts)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.at = np.arange(len(tokens)) - np.repeat(self.first, self.lengths)
        self.train = np.repeat(~self.held, self.lengths)
        # grams[j]: hash of the last j + 1 tokens up to here; a text's start
        # stands in the place before its first token
        self.grams = [tokens]
        for _ in range(1, order):
            before = np.concatenate((np.array([START], _U), self.grams[-1][:-1]))
            before[self.first] = START
            self.grams.append(mix(before * _U(0x9E3779B97F4A7C15) + tokens))
        # per order: distinct n-grams (sorted), place of one of each, and for
        # every token the number of its n-gram
        self.distinct = [np.unique(g, return_index=True, return_inverse=True) for g in self.grams]

    def counts(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of order j + 1 and how often each occurs in training rows."""
        keys, _, index = self.distinct[j]
        return keys, np.bincount(index, self.train, len(keys)).astype(np.uint32)


class Automaton:
    """The arcs that a batch can take.

    Per order, for each distinct n-gram: the weight of the arc it takes (nan
    where the n-gram is unseen, so the failure arc is taken), and the weight of
    the failure arc of the state (history) it starts from.
    """

    def __init__(self, stream: _Stream, totals: list[np.ndarray], n: int, v: int, starts: int, mu: float):
        self.orders, lower, history = [], None, None
        for j, counted in enumerate(totals):
            keys, place, here = stream.distinct[j]
            if j == 0:
                p = (counted + ADD) / (n + ADD * (v + 1))
                arc, fail = np.log10(p), np.zeros(len(keys))
            else:
                rest = lower[place]  # p(w | shorter history), where this n-gram occurs
                h = history[place]
                # near a text's start the history is no longer than that of
                # the order below: same state, same weight
                same = stream.at[place] + 1 < j
                p = np.where(same, rest, (counted + mu * rest) / (h + mu))
                arc = np.where(counted > 0, np.log10(p), np.nan)
                fail = np.where(same, 0.0, np.log10(mu / (h + mu)))
            self.orders.append((arc, fail))
            lower = p[here]
            c = counted[here]
            history = np.concatenate(([0], c[:-1])).astype(float)
            history[stream.first] = starts

    def traverse(self, stream: _Stream) -> np.ndarray:
        """log10 probability of every token, carrying the state along: the arc
        of the longest history that has one, after the failure arcs to it."""
        out = np.zeros(len(stream.train))
        for (arc, fail), (_, _, at) in zip(self.orders, stream.distinct):
            out = np.where(np.isnan(arc[at]), out + fail[at], arc[at])
        return out


def _send(order: int, mod: int, cells: int):
    def run(left: pa.Table) -> pa.Table:
        x, batch = _Stream(left["text"].to_pylist(), left["id"].to_pylist(), order, mod), left["batch"][0].as_py()
        out = []
        for j in range(order):
            keys, count = x.counts(j)
            if j == 1:  # the number of training texts travels as an n-gram of its own
                at = np.searchsorted(keys, START)
                keys, count = np.insert(keys, at, START), np.insert(count, at, np.uint32((~x.held).sum()))
            out.append(exchange.send(batch, keys, count, cells, first=j * cells))
        return pa.concat_tables(out)

    return run


def _sum_cell(table: pa.Table) -> pa.Table:
    """Corpus totals of a cell's n-grams, answered to every batch that asked.  A
    row for no batch (-1) has the cell's tokens and distinct n-grams as text."""
    batches, lengths, keys, count = exchange.gather(table, np.uint32)
    distinct, index = np.unique(keys, return_inverse=True)
    totals = np.bincount(index, count, len(distinct)).astype(np.uint64)
    head = f"{int(totals.sum())} {np.count_nonzero(totals)}".encode()
    small = np.min_scalar_type(int(totals.max(initial=0)))
    data = [bytes([small.itemsize]) + x.tobytes() for x in np.split(totals[index].astype(small), np.cumsum(lengths)[:-1])]
    return exchange.answer(0, table["cell"][0].as_py(), [-1, *batches], [head, *data])


def _score(order: int, mod: int, cells: int, mu: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left["text"].to_pylist()
        if not texts:
            return _table(left, *[[]] * 6)
        x = _Stream(texts, left["id"].to_pylist(), order, mod)
        totals, n, v = [[np.empty(0)] for _ in range(order)], right["n"][0].as_py(), right["v"][0].as_py()
        for cell, data in exchange.answers(right, 0):
            totals[cell // cells].append(np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.float64))
        totals = [np.concatenate(t) for t in totals]
        starts = 0
        if order > 1:
            at = int(np.searchsorted(x.distinct[1][0], START))
            starts, totals[1] = totals[1][at], np.delete(totals[1], at)
        logs = Automaton(x, totals, n, v, starts, mu).traverse(x)
        c = totals[0][x.distinct[0][2]]
        base = np.log10((c + ADD) / (n + ADD * (v + 1)))
        per_text = [np.add.reduceat(a, x.first) for a in ((c > 0).astype(np.int64), base, logs)]
        return _table(left, x.held, x.lengths, per_text[0], [n] * len(texts), per_text[1], per_text[2])

    return run


def _table(left: pa.Table, held, tokens, known, train, base, score) -> pa.Table:
    return pa.table({
        "id": left["id"], "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(tokens, pa.int64()),
        "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(train, pa.int64()),
        "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})


def score(docs: DataFrame, order: int = 2, mod: int = 10, mu: float = 50.0,
          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """log10 probability of every text under a model of all training rows
    (those whose crc32 of the id as text is not 0 modulo ``mod``).

    One row per row of ``docs``: the id, ``held_out``, ``n_tokens`` (words and
    the end), ``n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (unigrams) and ``score``.  Null and empty texts are one end
    token; a null id counts as the empty text for the fold; repeated rows are
    scored and learned each; without training rows every token has the same
    unseen mass; other columns are not read; an empty table gives none.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    rows, cells = exchange.batched(docs, doc_id, text)
    id_type = dict(rows.dtypes)["id"]
    sent = rows.groupBy("batch").applyInArrow(_send(order, mod, cells), exchange.SENT)
    totals = sent.groupBy("cell").applyInArrow(_sum_cell, exchange.ANSWER)
    # tokens and distinct ones of all unigram cells: one row, for every batch
    head = F.split(F.decode("data", "utf-8"), " ")
    corpus = totals.where((F.col("batch") < 0) & (F.col("cell") < cells)).agg(
        F.sum(head[0].cast("long")).alias("n"), F.sum(head[1].cast("long")).alias("v"))
    totals = totals.where("batch >= 0").crossJoin(F.broadcast(corpus))
    schema = (f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint,"
              " base_score double, score double")
    return (rows.groupBy("batch").cogroup(totals.groupBy("batch"))
            .applyInArrow(_score(order, mod, cells, mu), schema).withColumnRenamed("id", doc_id))
