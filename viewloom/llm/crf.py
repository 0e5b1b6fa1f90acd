"""Linear-chain conditional random fields in numpy, over many sequences at once.

Items (lines, words) of all sequences lie behind each other; `lengths` says how many belong
to each sequence. Steps in time run over all sequences that are long enough.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Steps:
    """For each step the positions of the items at that step, longest sequences first."""

    at: list[np.ndarray]

    @classmethod
    def of(cls, lengths: np.ndarray) -> Steps:
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        sizes = -np.sort(-lengths)
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
        return cls([starts[:n] + t for t, n in enumerate(active)])


def marginals(scores: np.ndarray, trans: np.ndarray, start: np.ndarray, steps: Steps, edges: bool = False):
    """Forward-backward: the marginal of each state at each item.

    With `edges` also the log normaliser of all sequences together and the expected number of
    transitions between states.
    """
    top = scores.max(axis=1, keepdims=True) if len(scores) else scores[:, :1]
    local, moves = np.exp(scores - top), np.exp(trans)
    forward, norm = np.empty_like(local), np.ones(len(local), local.dtype)
    for t, at in enumerate(steps.at):
        if t:
            here = (forward[steps.at[t - 1][: len(at)]] @ moves) * local[at]
        else:
            here = np.exp(start) * local[at]
        norm[at] = total = here.sum(axis=1)
        forward[at] = here / total[:, None]
    backward = np.ones_like(local)
    for t in range(len(steps.at) - 2, -1, -1):
        later = steps.at[t + 1]
        ahead = local[later] * backward[later] / norm[later, None]
        backward[steps.at[t][: len(later)]] = ahead @ moves.T
    nodes = forward * backward
    nodes /= np.maximum(nodes.sum(axis=1, keepdims=True), 1e-30)
    if not edges:
        return nodes
    log_norm = float(np.log(norm).sum() + top.sum())
    if len(steps.at) < 2:
        return nodes, log_norm, np.zeros_like(moves)
    before = np.concatenate([steps.at[t][: len(steps.at[t + 1])] for t in range(len(steps.at) - 1)])
    later = np.concatenate(steps.at[1:])
    ahead = local[later] * backward[later] / norm[later, None]
    return nodes, log_norm, moves * (forward[before].T @ ahead)


BLOCK = 1024  # items of a long sequence that are gone through one after the other


def sequence_marginals(scores: np.ndarray, trans: np.ndarray, start: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """As `marginals`, for sequences of any length: one of n items takes about n / block + block steps, not n.

    Steps compose: what a block does to the states is a small matrix, and the blocks' matrices are found
    side by side. The product of those before (behind) a block tells how it begins (ends).
    """
    if not len(lengths) or lengths.max() <= 2 * block:
        return marginals(scores, trans, start, Steps.of(lengths))
    n_blocks = -(-lengths // block)
    first_of = np.cumsum(n_blocks) - n_blocks
    sizes = np.full(int(n_blocks.sum()), block, np.int64)
    sizes[first_of + n_blocks - 1] = lengths - (n_blocks - 1) * block
    steps = Steps.of(sizes)
    local, moves = np.exp(scores - scores.max(axis=1, keepdims=True)), np.exp(trans)
    states = scores.shape[1]

    # blocks by falling size, as `steps` has them; `at` is where each stands there
    order = np.argsort(-sizes, kind="stable")
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    through = np.tile(np.eye(states), (len(sizes), 1, 1))
    for t, items in enumerate(steps.at):
        now = through[: len(items)]
        now = (now @ moves if t else now) * local[items][:, None, :]
        through[: len(items)] = now / now.max(axis=(1, 2), keepdims=True)

    begin, end = np.empty((len(sizes), states)), np.ones((len(sizes), states))
    begin[at[first_of]] = np.exp(start)
    for k in range(1, int(n_blocks.max())):
        now = first_of[n_blocks > k] + k
        ahead = np.einsum("ij,ijk->ik", begin[at[now - 1]], through[at[now - 1]]) @ moves
        begin[at[now]] = ahead / ahead.sum(axis=1, keepdims=True)
    for k in range(int(n_blocks.max()) - 2, -1, -1):
        now = first_of[n_blocks > k + 1] + k
        back = np.einsum("ijk,ik->ij", through[at[now + 1]], end[at[now + 1]]) @ moves.T
        end[at[now]] = back / back.sum(axis=1, keepdims=True)

    forward, backward = np.empty_like(local), np.empty_like(local)
    for t, items in enumerate(steps.at):
        here = (forward[steps.at[t - 1][: len(items)]] @ moves if t else begin) * local[items]
        forward[items] = here / here.sum(axis=1, keepdims=True)
    for t in range(len(steps.at) - 1, -1, -1):
        items, n_later = steps.at[t], len(steps.at[t + 1]) if t + 1 < len(steps.at) else 0
        backward[items] = end[: len(items)]
        if n_later:
            later = steps.at[t + 1]
            ahead = (local[later] * backward[later]) @ moves.T
            backward[items[:n_later]] = ahead / ahead.sum(axis=1, keepdims=True)
    nodes = forward * backward
    return nodes / np.maximum(nodes.sum(axis=1, keepdims=True), 1e-30)


def fit(
    score: Callable[[np.ndarray], np.ndarray],
    backprop: Callable[[np.ndarray], np.ndarray],
    shape: tuple[int, int],
    gold: np.ndarray,
    lengths: np.ndarray,
    rounds: int,
    rate: float,
    penalty: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximise the conditional likelihood of the gold states; returns weights, transitions, start.

    `score` maps the weights to state scores per item, `backprop` a gradient by item to one by
    weight. Full gradients and Adam steps from zero, so the result is the same on every run.
    """
    states, steps = shape[1], Steps.of(lengths)
    params = [np.zeros(shape), np.zeros((states, states)), np.zeros(states)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    if not len(gold):
        return tuple(params)
    target = np.eye(states)[gold]
    starts = steps.at[0]
    before = np.concatenate([steps.at[t][: len(steps.at[t + 1])] for t in range(len(steps.at) - 1)] or [starts[:0]])
    later = np.concatenate(steps.at[1:] or [starts[:0]])
    moved = target[before].T @ target[later]
    for step in range(1, rounds + 1):
        nodes, _, edges = marginals(score(params[0]), params[1], params[2], steps, edges=True)
        wrong = target - nodes
        grads = [backprop(wrong), moved - edges, wrong[starts].sum(axis=0)]
        for k, g in enumerate(grads):
            g = g / len(gold) - penalty * params[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] = params[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    return tuple(params)
