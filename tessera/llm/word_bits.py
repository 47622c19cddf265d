"""Bits of a known word's code, mixed from hashed contexts.

A word's code is 8 bits of its hash, two nibbles of four.  Three predictors give
each bit a probability, from counts of the training corpus: the text's class, the
previous word, and the previous two (contexts across a document's border are
empty).  A context and the nibbles before name a row of 16 counts, one for each
value of the nibble; sums of halves of a row give the counts of a bit.  The class
has rows of its own, the other contexts share 2^17 hashed rows each.  A logistic
mixer adds the predictors up; its weight set is picked by the nibble and by how
often both hashed contexts have been seen.  Weights are learned online, a block of
tokens at a time, each token leaving its own occurrence out of the counts.

Counts of all tasks add up, whatever the order.  No tokens give no counts and an
empty result; a context that was never seen has no vote.
"""

from __future__ import annotations

from copy import copy

import numpy as np

from . import kernel as K

CODES = 256
CONTEXTS = 2
ROW_BITS = 17
_LEVELS = 2
_BLOCK = 4000
_SCORED = 4000
_RATE = 0.05
_FAR = 60  # a bit's probability is at least e ** -60
_SOME = 0.1  # added to both counts of a bit
_STEPS = 8  # steps of a context's count that pick weights
_START = 0.3


def code(h: np.ndarray) -> np.ndarray:
    return (K.mix(h + np.uint64(3)) >> np.uint64(56)).astype(np.int64)


def contexts(h: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Hashes of the previous word and of the previous two of each token, from the
    tokens' hashes and their places in their documents."""
    zero = np.zeros(2, np.uint64)
    one = K.mix(np.where(place >= 1, np.r_[zero[:1], h][: len(h)], np.uint64(0)) + np.uint64(1))
    two = K.mix(one + np.where(place >= 2, np.r_[zero, h][: len(h)], np.uint64(0)))
    return [one, two]


def _hashed(context: np.ndarray, codes: np.ndarray, level: int) -> np.ndarray:
    part = (codes >> 4) + 1 if level else np.zeros(len(codes), np.int64)
    return (K.mix(context + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - ROW_BITS)).astype(np.int64)


def _of_class(cls: np.ndarray, codes: np.ndarray, level: int, classes: int) -> np.ndarray:
    return classes + cls * 16 + (codes >> 4) if level else cls


def _nibble(codes: np.ndarray, level: int) -> np.ndarray:
    return codes & 15 if level else codes >> 4


def no_counts() -> np.ndarray:
    return np.zeros((CONTEXTS, 16 << ROW_BITS), np.int64)


def add_counts(table: np.ndarray, h: np.ndarray, place: np.ndarray) -> None:
    """Adds the tokens' nibbles to the rows of the hashed contexts."""
    codes = code(h)
    for o, context in enumerate(contexts(h, place)):
        for level in range(_LEVELS):
            at = _hashed(context, codes, level) * 16 + _nibble(codes, level)
            table[o] += np.bincount(at, minlength=table.shape[1])


def class_rows(counts: np.ndarray) -> np.ndarray:
    """Rows of the class predictor from the counts [class, code]."""
    return np.concatenate([counts.reshape(-1, 16, 16).sum(2), counts.reshape(-1, 16)])


def _nodes(rows: np.ndarray):
    """For the 15 bits of each row's tree (bit i at place i, from 1): the stretched
    probability, and the step of its count."""
    x, n = np.zeros(rows.shape, np.float32), np.zeros(rows.shape, np.uint8)
    for depth in (3, 2, 1, 0):
        zero, one = rows[:, 0::2], rows[:, 1::2]
        at = slice(1 << depth, 2 << depth)
        x[:, at] = np.log((one + _SOME) / (zero + _SOME))
        rows = zero + one
        n[:, at] = np.minimum(np.log2(rows + 1.0), _STEPS - 1)
    return x, n


def _left_out(rows: np.ndarray):
    """As ``_nodes``, for a token that leaves its own occurrence out: the stretched
    probability at the place of the bit's outcome (2 i + bit), and the step."""
    x, n = np.zeros((len(rows), 32), np.float32), np.zeros(rows.shape, np.uint8)
    for depth in (3, 2, 1, 0):
        zero, one = rows[:, 0::2], rows[:, 1::2]
        x[:, 2 << depth : 4 << depth : 2] = np.log((one + _SOME) / (np.maximum(zero - 1, 0) + _SOME))
        x[:, (2 << depth) + 1 : 4 << depth : 2] = np.log((np.maximum(one - 1, 0) + _SOME) / (zero + _SOME))
        rows = zero + one
        n[:, 1 << depth : 2 << depth] = np.minimum(np.log2(np.maximum(rows, 1)), _STEPS - 1)
    return x, n


#: The outcomes (2 i + bit) of the four bits i of every nibble, and their signs.
_OUTCOMES = (16 | np.arange(16)) >> np.arange(3, -1, -1)[:, None]
_SIGNS = ((_OUTCOMES & 1) * 2 - 1).astype(np.float32)
_SETS = _STEPS * _STEPS
_OF_BIT = np.arange(4)[:, None] * _SETS


class CodeMixer:
    """Mixes the predictors of code bits; ``rows`` are those of the class and of
    each hashed context."""

    def __init__(self, by_class: np.ndarray, hashed: np.ndarray):
        self.classes = len(by_class) // 17
        self.rows = [by_class, *(t.reshape(-1, 16) for t in hashed)]
        self.nodes = self.left_out = None
        self.weights = np.full((_LEVELS, _SETS, 1 + CONTEXTS), _START)
        self.weights[:, :, 0] = 1 - _START

    def ready(self, weights: np.ndarray) -> CodeMixer:
        """For scoring: the votes of all rows, without the counts."""
        self.weights = weights
        self.nodes = [_nodes(r) for r in self.rows]
        self.rows = self.left_out = None
        return self

    def learner(self) -> CodeMixer:
        """A copy with weights of its own; the votes without a token's own occurrence
        are kept here, for all tasks of a process."""
        if self.left_out is None:
            self.left_out = [_left_out(r) for r in self.rows]
        other = copy(self)
        other.weights = self.weights.copy()
        return other

    def _places(self, cls, around, codes, level):
        return [_of_class(cls, codes, level, self.classes), *(_hashed(c, codes, level) for c in around)]

    def learn(self, h: np.ndarray, place: np.ndarray, cls: np.ndarray, used: np.ndarray) -> None:
        """Moves the weights after every block; ``used`` counts what moved each."""
        if self.left_out is None:
            self.left_out = [_left_out(r) for r in self.rows]
        codes, around = code(h), contexts(h, place)
        flat = [[t.reshape(-1) for t in pair] for pair in self.left_out]
        for i in range(0, len(h), _BLOCK):
            now = slice(i, i + _BLOCK)
            for level in range(_LEVELS):
                value = _nibble(codes[now], level)
                outcome = _OUTCOMES.take(value, 1)
                start = [at * 32 for at in self._places(cls[now], [c[now] for c in around], codes[now], level)]

                def vote(o, node):
                    at = start[o] + outcome
                    return flat[o][0].take(at), flat[o][1].take(at >> 1) if o else None

                self._bits(value, level, vote, used)

    def log10(self, h: np.ndarray, place: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token's code."""
        codes, around = code(h), contexts(h, place)
        out = np.zeros(len(h))
        flat = [[t.reshape(-1) for t in pair] for pair in self.nodes]
        for i in range(0, len(h), _SCORED):
            now = slice(i, i + _SCORED)
            for level in range(_LEVELS):
                start = [at * 16 for at in self._places(cls[now], [c[now] for c in around], codes[now], level)]

                def vote(o, node):
                    at = start[o] + node
                    return flat[o][0].take(at), flat[o][1].take(at) if o else None

                out[now] -= self._bits(_nibble(codes[now], level), level, vote)
        return out / np.log(10)

    def _bits(self, value, level, vote, used=None):
        """The natural logarithms that the nibbles cost; with ``used`` the weights learn instead.
        The four bits of a nibble are rows of one array."""
        w, sign = self.weights[level], _SIGNS.take(value, 1)
        node = _OUTCOMES.take(value, 1) >> 1
        votes = [vote(o, node) for o in range(1 + CONTEXTS)]
        step = (votes[1][1] * np.uint8(_STEPS) + votes[2][1]).astype(np.intp)
        columns = np.ascontiguousarray(w.T, np.float32)
        x = votes[0][0] * columns[0].take(step)
        for o in range(1, 1 + CONTEXTS):
            x += votes[o][0] * columns[o].take(step)
        x *= -sign
        odds = np.exp(np.clip(x, -_FAR, _FAR, out=x), out=x)
        if used is not None:
            gate = (step + _OF_BIT).reshape(-1)
            error = sign * odds / (1 + odds)
            n = np.bincount(gate, minlength=4 * _SETS).reshape(4, _SETS)
            used[level] += n.sum(0)
            rate = _RATE / np.sqrt(n + 1)
            for o, v in enumerate(votes):
                w[:, o] += (rate * np.bincount(gate, (error * v[0]).reshape(-1), 4 * _SETS).reshape(4, _SETS)).sum(0)
            return None
        return np.log(np.prod(1 + odds, 0, np.float64))  # four factors of at most e ** _FAR + 1
