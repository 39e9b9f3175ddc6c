"""Gap-weighted subsequence features of short strings, in numpy.

A feature is an ordered choice of ``ORDERS`` characters that skips at most ``GAP`` others in all; it counts ``DECAY`` to
the power of the characters skipped. Letters and digits only: a sign inside a word is skipped for free, any other
inserted character costs one power of ``DECAY``. Two codes mark the ends of a string. Features are numbered by a hash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

ORDERS = (4, 5)
GAP = 2
DECAY = 0.6
BITS = 20
FEATURES = 1 << BITS
_FIRST, _LAST = 62, 63
_LIMIT = 0x250


def _codes() -> np.ndarray:
    table = np.zeros(_LIMIT, np.uint32)
    for cp in range(_LIMIT):
        c = chr(cp)
        if c.isalnum():
            low = c.lower()[0]
            table[cp] = (ord(low) - 96 if "a" <= low <= "z" else 27 + int(low) if "0" <= low <= "9" else 37 + ord(low) % 25)
    return table


_TABLE = _codes()
#: Offsets of the characters after the first, and the weight, of every shape of a feature.
SHAPES = [(rest, DECAY ** (rest[-1] + 1 - n)) for n in ORDERS for rest in combinations(range(1, n + GAP), n - 1)]

_WEIGHT = dict(SHAPES)
#: The offsets that can follow the first offsets of a shape.
_NEXT = {p: sorted({rest[len(p)] for rest, _ in SHAPES if len(rest) > len(p) and rest[:len(p)] == p}) for p in {rest[:k] for rest, _ in SHAPES for k in range(len(rest))}}


def encode(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all tokens one after the other, each between its marks, with the start and length of each."""
    cps = np.frombuffer("\n".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(cps < _LIMIT, _TABLE[np.minimum(cps, _LIMIT - 1)], 37 + (cps % 25))
    which = np.cumsum(cps == 10)
    keep = (codes > 0) & (cps != 10)
    codes, which = codes[keep], which[keep]
    lengths = np.bincount(which, minlength=len(tokens)) + 2
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out = np.empty(int(lengths.sum()), np.uint32)
    out[starts], out[starts + lengths - 1] = _FIRST, _LAST
    out[np.arange(len(codes)) + 2 * which + 1] = codes
    return out, starts, lengths


def _blocks(tokens: list[str]):
    """Tokens of one coded length at a time: their numbers, and a row of codes for each."""
    codes, starts, lengths = encode(tokens)
    order = np.argsort(lengths, kind="stable")
    for who in np.split(order, np.nonzero(np.diff(lengths[order]))[0] + 1):
        yield who, codes[starts[who][:, None] + np.arange(lengths[who[0]])]


def _numbers(block: np.ndarray, rest: tuple[int, ...]) -> np.ndarray:
    n = block.shape[1] - rest[-1]
    x = block[:, :n]
    for at in rest:
        x = x * np.uint32(0x01000193) ^ block[:, at: at + n]
    return (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def _norm(length: int) -> float:
    return float(np.sqrt(max(1e-9, sum(w * w * max(0, length - rest[-1]) for rest, w in SHAPES))))


def _stages(block: np.ndarray):
    """(shape, numbers) for every shape that fits; shapes with the same first offsets share the work up to there.

    A token is a column here, so that a step runs over many tokens at a stretch."""
    stack = [((), block)]
    while stack:
        rest, x = stack.pop()
        if rest in _WEIGHT:
            yield rest, (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        for at in _NEXT.get(rest, ()):
            n = len(block) - at
            if n > 0:
                stack.append(((*rest, at), x[:n] * np.uint32(0x01000193) ^ block[at: at + n]))


def score(tokens: list[str], weights: np.ndarray) -> np.ndarray:
    """Inner product of each token's normalised features with ``weights``; tokens must not hold a line feed."""
    out = np.zeros(len(tokens))
    if not tokens:
        return out
    for who, block in _blocks(tokens):
        total = np.zeros(len(who))
        columns = np.ascontiguousarray(block.T)
        spans: dict[float, np.ndarray] = {}
        for rest, number in _stages(columns):
            w = _WEIGHT[rest]
            if w not in spans:
                spans[w] = np.zeros(columns.shape, np.float32)
            spans[w][:len(number)] += weights.take(number)
        for w, values in spans.items():
            total += w * values.sum(0, dtype=np.float64)
        out[who] = total / _norm(block.shape[1])
    return out


def features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised features as (token number, feature, weight), for fitting."""
    parts = [(np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0))]
    for who, block in _blocks(tokens) if tokens else ():
        for rest, w in SHAPES:
            if block.shape[1] > rest[-1]:
                number = _numbers(block, rest)
                parts.append((np.repeat(who, number.shape[1]), number.ravel(), np.full(number.size, w / _norm(block.shape[1]))))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
