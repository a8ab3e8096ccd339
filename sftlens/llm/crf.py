"""A linear-chain conditional random field in numpy, for small label sets.

Positions are described by rows of a 0/1 feature matrix (one row per distinct description,
so repeated descriptions cost nothing); chains are rows of description numbers padded
with -1.  Training is maximum likelihood with a quadratic penalty (scaled forward-backward,
Adam steps) over a bounded labelled table; decoding is Viterbi over batches of chains.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    weights: np.ndarray  # features x labels
    steps: np.ndarray    # label x next label
    start: np.ndarray    # labels

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return features @ self.weights


def pad(chains: list[np.ndarray]) -> np.ndarray:
    """Chains as rows of one array, -1 beyond their ends."""
    out = np.full((len(chains), max(map(len, chains), default=0)), -1, np.int64)
    for row, c in zip(out, chains, strict=True):
        row[:len(c)] = c
    return out


def fit(features: np.ndarray, chains: np.ndarray, labels: np.ndarray, n_labels: int,
        rounds: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> Chain:
    """Chain fitted to ``chains`` (description numbers, -1 padded) and their ``labels``.
    No chains: all weights are zero, so every position decodes to label 0."""
    n_feat, k = features.shape[1], n_labels
    theta = [np.zeros((n_feat, k)), np.zeros((k, k)), np.zeros(k)]
    if not chains.size:
        return Chain(*theta)
    b, t = chains.shape
    on = chains >= 0
    ids = np.where(on, chains, 0)
    gold = np.where(on, labels, 0)
    seen = np.zeros((len(features), k))
    np.add.at(seen, (ids[on], gold[on]), 1)
    moves = np.zeros((k, k))
    both = on[:, 1:] & on[:, :-1]
    np.add.at(moves, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    first = np.bincount(gold[on[:, 0], 0], minlength=k).astype(float)
    target = [features.T @ seen, moves, first]
    m1, m2 = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for step in range(1, rounds + 1):
        e = features @ theta[0]
        e = np.exp(e - e.max(axis=1, keepdims=True))
        go, begin = np.exp(theta[1]), np.exp(theta[2])
        em = np.where(on[:, :, None], e[ids], 1.0)
        alpha = np.empty((b, t, k))
        a = begin * em[:, 0]
        alpha[:, 0] = a = a / a.sum(axis=1, keepdims=True)
        for i in range(1, t):
            a2 = (a @ go) * em[:, i]
            a = np.where(on[:, i, None], a2 / a2.sum(axis=1, keepdims=True), a)
            alpha[:, i] = a
        beta = np.ones((b, k))
        post = np.empty((b, t, k))
        exp_moves = np.zeros((k, k))
        for i in range(t - 1, -1, -1):
            p = alpha[:, i] * beta
            post[:, i] = np.where(on[:, i, None], p / p.sum(axis=1, keepdims=True), 0)
            if i:
                right = em[:, i] * beta
                joint = alpha[:, i - 1][:, :, None] * go * right[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                exp_moves += joint[on[:, i]].sum(axis=0)
                nb = right @ go.T
                beta = np.where(on[:, i, None], nb / nb.max(axis=1, keepdims=True), beta)
        per = np.zeros((len(features), k))
        for y in range(k):
            per[:, y] = np.bincount(ids[on], weights=post[:, :, y][on], minlength=len(features))
        model = [features.T @ per, exp_moves, post[:, 0].sum(axis=0)]
        for j in range(3):
            g = (target[j] - model[j]) / b - penalty * theta[j]
            m1[j] = 0.9 * m1[j] + 0.1 * g
            m2[j] = 0.999 * m2[j] + 0.001 * g * g
            theta[j] = theta[j] + rate * (m1[j] / (1 - 0.9 ** step)) / (np.sqrt(m2[j] / (1 - 0.999 ** step)) + 1e-8)
    return Chain(*theta)


def viterbi(em: np.ndarray, lengths: np.ndarray, chain: Chain) -> np.ndarray:
    """Best labels for padded chains: ``em`` is chains x positions x labels; ties go to the
    lower label.  Positions beyond a chain's length are -1."""
    b, t, k = em.shape
    out = np.full((b, t), -1, np.int8)
    if not b or not t:
        return out
    back = np.zeros((b, t, k), np.int8)
    best = chain.start + em[:, 0]
    rows = np.arange(b)
    for i in range(1, t):
        score = best[:, :, None] + chain.steps
        arg = score.argmax(axis=1)
        new = np.take_along_axis(score, arg[:, None, :], axis=1)[:, 0] + em[:, i]
        live = (lengths > i)[:, None]
        back[:, i] = np.where(live, arg, np.arange(k))
        best = np.where(live, new, best)
    y = best.argmax(axis=1)
    for i in range(t - 1, -1, -1):
        live = lengths > i
        out[live, i] = y[live]
        y = back[rows, i, y]
    return out


def decode(em: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chain: Chain, cells: int = 200_000) -> np.ndarray:
    """Labels of many chains laid end to end: ``em`` is positions x labels, chain j covers
    ``starts[j] : starts[j] + lengths[j]``.  Chains of like length are decoded together, about
    ``cells`` positions at a time, whatever the number or length of chains."""
    out = np.zeros(len(em), np.int8)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * lengths[order[j]] <= cells and lengths[order[j]] <= 1.3 * lengths[order[i]] + 2:
            j += 1
        part = order[i:j]
        t = int(lengths[part[-1]])
        at = starts[part][:, None] + np.arange(t)
        live = np.arange(t) < lengths[part][:, None]
        at = np.where(live, at, 0)
        y = viterbi(em[at], lengths[part], chain)
        out[at[live]] = y[live]
        i = j
    return out
