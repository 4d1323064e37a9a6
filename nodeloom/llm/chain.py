"""Forward-backward over linear chains, many chains side by side.

All chains of a slice are one sequence in which the first word of a chain starts afresh: its step
sends any state to the start weights, so nothing crosses. A step is linear, so the sequence is
cut into blocks of about the root of its length: the product of each block's steps is formed for all
blocks at once, the blocks are passed one after another, and each block's words are filled in, again
for all blocks at once. The result is exact, and a long chain takes no more steps than short ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Marginals:
    """``word[i, y]``, the summed ``pair[x, y]`` of neighbours in a chain, and the log of all chains' sums."""

    word: np.ndarray
    pair: np.ndarray
    log_sum: float


#: Steps after which running products are scaled back to 1; a step loses at most the spread of its weights.
RESCALE = 4
TINY = 1e-300


def _top(x: np.ndarray) -> np.ndarray:
    return np.maximum(x.max(axis=1, keepdims=True), TINY)


def forward_backward(unary: np.ndarray, start: np.ndarray, move: np.ndarray, first: np.ndarray) -> Marginals:
    """Marginals of chains that begin at the words ``first`` marks; all weights are logarithms."""
    n, labels = unary.shape
    if not n:
        return Marginals(np.zeros((0, labels)), np.zeros((labels, labels)), 0.0)
    peak = unary.max(axis=1)
    top_move, top_start = move.max(), start.max()
    step, begin = np.exp(move - top_move), np.exp(start - top_start)
    width = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // width)
    emit = np.ones((blocks * width, labels))
    np.exp(unary - peak[:, None], out=emit[:n])
    fresh = np.ones(blocks * width, bool)
    fresh[:n] = first
    fresh[0] = True
    emit = np.ascontiguousarray(emit.reshape(blocks, width, labels).transpose(1, 0, 2))  # the words of one step lie together
    new = [np.flatnonzero(x) for x in fresh.reshape(blocks, width).T]

    product = np.broadcast_to(np.eye(labels), (blocks, labels, labels)).copy()
    for t in range(width):
        moved = (product.reshape(-1, labels) @ step).reshape(product.shape)
        if len(new[t]):
            moved[new[t]] = product[new[t]].sum(axis=2, keepdims=True) * begin
        moved *= emit[t][:, None, :]
        if t % RESCALE == 0:
            moved /= _top(moved.reshape(blocks, -1))[:, None]
        product = moved

    into, out_of = np.empty((blocks, labels)), np.empty((blocks, labels))
    state = np.full(labels, 1.0 / labels)
    for b in range(blocks):
        into[b] = state
        state = state @ product[b]
        state /= max(state.sum(), TINY)
    state = np.ones(labels)
    for b in range(blocks - 1, -1, -1):
        out_of[b] = state
        state = product[b] @ state
        state /= max(state.max(), TINY)

    ahead, before, scales = np.empty_like(emit), np.empty_like(emit), np.empty((width, blocks))
    state = into
    for t in range(width):
        before[t] = state
        moved = state @ step
        moved[new[t]] = begin
        moved *= emit[t]
        scales[t] = np.maximum(moved.sum(axis=1), TINY)
        state = ahead[t] = moved / scales[t][:, None]
    behind = np.empty_like(emit)
    state = out_of
    for t in range(width - 1, -1, -1):
        behind[t] = state
        seen = emit[t] * state
        state = seen @ step.T
        state[new[t]] = (seen[new[t]] @ begin)[:, None]
        if t % RESCALE == 0:
            state /= _top(state)

    def in_order(x: np.ndarray) -> np.ndarray:
        return x.transpose(1, 0, 2).reshape(-1, labels)[:n]

    word = in_order(ahead * behind)
    word /= word.sum(axis=1, keepdims=True)
    linked = ~fresh[:n]
    left, right = in_order(before)[linked], in_order(emit * behind)[linked]
    total = np.maximum(((left @ step) * right).sum(axis=1, keepdims=True), TINY)
    pair = step * ((left / total).T @ right)
    starts = int(n - linked.sum())
    log_sum = float(np.log(scales.T.reshape(-1)[:n]).sum() + peak.sum()) + top_move * (n - starts) + top_start * starts
    return Marginals(word, pair, log_sum)
