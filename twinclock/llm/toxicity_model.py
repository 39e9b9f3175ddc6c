"""Support vector machine over a subsequence string kernel with Nyström landmarks, fitted on a bounded sample.

The kernel of two words is the inner product of their normalised features (``strings``). A landmark is a word of the
sample; a word's Nyström features are its kernels with the landmarks, whitened. The machine is linear in them, and the
kernel is linear in the string features, so the fitted machine folds into one weight per string feature: scoring a word
costs its own length, whatever the number of landmarks, and gives the same value.

A label marks a text, not a word: a text is toxic if one of its words is (multiple instances). Fitting starts with the
words that toxic texts alone hold, and then keeps as positive those words the machine itself finds, at least one in
each toxic text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np

from twinclock.llm import strings

#: A run of at least four lone characters, as in "s p a c e d": read as one word.
SPACED = re.compile(r"(?<!\S)(?:\S\s+){3,}\S(?!\S)")
#: Characters of two neighbouring words that can be read as one, "gap ped"; most words that are known to be whole.
JOINED, MOST_WHOLE = range(4, 25), 50_000
#: Characters scored at a time, words gathered from texts before they are scored.
PIECE, TOKENS = 1 << 18, 300_000


_ODD, _HEAD = 1, 2


@lru_cache(2)
def _kinds(whole: frozenset[str], insults: frozenset[str]) -> tuple[dict[str, int], int]:
    """Of a word: whether it is not known to be one (_ODD), and whether an insult begins with it (_HEAD); the kind of all others."""
    other = _ODD if whole else 0
    kinds = dict.fromkeys(whole, 0)
    for head in {w[:k] for w in insults for k in range(len(w) + 1)}:
        kinds[head] = kinds.get(head, other) | _HEAD
    return kinds, other


def parts(text: str, whole: frozenset[str] = frozenset(), insults: frozenset[str] = frozenset()) -> tuple[list[str], list[str]]:
    """The words of a text; its spaced words, and each two neighbours read as one, if that is one of ``insults`` or one of
    the two is not known to be a word (``whole``; nothing is known if it is empty, and nothing else is joined)."""
    text = text.lower()
    own = text.split()
    kinds, other = _kinds(whole, insults)
    find, size = kinds.get, np.array(list(map(len, own)), np.int64)
    kind = np.array([find(w, other) for w in own], np.uint8)
    both = size[:-1] + size[1:]
    odd = ((kind[:-1] | kind[1:]) & _ODD > 0) & (both >= JOINED.start) & (both < JOINED.stop)
    joined = [own[k] + own[k + 1] for k in np.flatnonzero(odd).tolist()]
    if insults:
        head = (kind[:-1] & _HEAD > 0) & ~odd
        joined += [w for w in (own[k] + own[k + 1] for k in np.flatnonzero(head).tolist()) if w in insults]
    lone = size == 1
    spaced = SPACED.findall(text) if (lone[:-3] & lone[1:-2] & lone[2:-1] & lone[3:]).any() else []
    return own, joined + ["".join(m.split()) for m in spaced]


def words(text: str, whole: frozenset[str] = frozenset(), insults: frozenset[str] = frozenset()) -> list[str]:
    own, made = parts(text, whole, insults)
    return own + made


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    levels: np.ndarray
    shares: np.ndarray
    landmarks: list[str]
    whole: frozenset[str] = frozenset()
    insults: frozenset[str] = frozenset()

    def decide(self, tokens: list[str]) -> np.ndarray:
        return strings.score(tokens, self.weights) + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        """Share of toxic texts at a margin: a rising curve through held-out texts, with a slight slope throughout."""
        return 0.98 * np.interp(margin, self.levels, self.shares) + 0.02 / (1 + np.exp(-np.clip(margin, -30, 30)))


class Scorer:
    """Margins of texts: the largest margin of their words.

    Remembers the margins of at most ``remember`` words, those in use longest: when half of them are new, the older half that
    no text has used since is forgotten. Words made of two neighbours rarely come again and are not remembered."""

    def __init__(self, model: Model, remember: int = 600_000):
        self.model, self.remember, self.known, self.older = model, remember, {}, {}

    def _margins(self, fresh: set[str]) -> dict[str, float]:
        tokens, out = list(fresh), {}
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 2)
        at = 0
        while at < len(tokens):
            # up to the token that passes PIECE
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")) + 1
            out.update(zip(tokens[at: to], self.model.decide(tokens[at: to]).tolist(), strict=True))
            at = to
        return out

    def _some(self, bags: list[set[str]], made: list[set[str]]) -> list[float]:
        if len(self.known) > self.remember // 2:
            self.known, self.older = {}, self.known
        needed = set().union(*bags) - self.known.keys()
        again = needed & self.older.keys()
        self.known.update((t, self.older[t]) for t in again)
        self.known.update(self._margins(needed - again))
        once = self._margins(set().union(*made) - self.known.keys())
        once.update((t, self.known[t]) for own in made for t in own if t in self.known)
        return [max(max(map(self.known.__getitem__, own), default=self.model.bias), max(map(once.__getitem__, more), default=-np.inf)) if own or more else self.model.bias
                for own, more in zip(bags, made, strict=True)]

    def margins(self, texts: list[str | None]) -> np.ndarray:
        out, bags, made, size = [], [], [], 0
        for text in texts:
            own, more = parts(text, self.model.whole, self.model.insults) if text else ((), ())
            bags.append(set(own))
            made.append(set(more))
            size += len(bags[-1]) + len(made[-1])
            if size > TOKENS:
                out += self._some(bags, made)
                bags, made, size = [], [], 0
        return np.array(out + self._some(bags, made), float) if bags else np.array(out, float)


_own: list[Scorer] = []


def scorer_of(model: Model) -> Scorer:
    """The scorer of this Python worker, which keeps what it remembers from task to task."""
    if not _own or _own[0].model is not model:
        _own[:] = [Scorer(model)]
    return _own[0]


def _newton(x: np.ndarray, y: np.ndarray, c: np.ndarray, w: np.ndarray, steps: int = 12) -> np.ndarray:
    """Squared-hinge support vector machine in the primal; the last column of x is the bias."""
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        # rows inside the margin, a block at a time: no second copy of x
        active = np.nonzero(y * (x @ w) < 1)[0]
        left, right = ridge.copy(), np.zeros(x.shape[1])
        for at in range(0, len(active), 2048):
            rows = active[at: at + 2048]
            weighed = x[rows] * c[rows, None]
            left += x[rows].T @ weighed
            right += weighed.T @ y[rows]
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-5:
            return new
        w = new
    return w


def _rising(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: margins and the shares of label 1 there, never falling (pool adjacent violators)."""
    if not len(margin):
        return np.zeros(1), np.full(1, 0.5)
    x, first, n = np.unique(margin, return_index=True, return_counts=True)
    hits = np.bincount(np.searchsorted(x, margin), weights=y, minlength=len(x))
    blocks: list[list[float]] = []
    for at, k, h in zip(x, n, hits, strict=True):
        blocks.append([at, at, k, h])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            low, high, k, h = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + k, blocks[-1][3] + h]
    q = y.mean()
    share = [(h + q) / (k + 1) for _, _, k, h in blocks]
    return np.array([m for b in blocks for m in b[:2]]), np.maximum.accumulate(np.repeat(share, 2))


def _kernel(tokens: list[str], marks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kernels of ``tokens`` with ``marks``, and the marks over their own string features."""
    who, feat, val = strings.features(marks)
    live, feat = np.unique(feat, return_inverse=True)
    basis = np.zeros((len(marks), len(live)), np.float32)
    np.add.at(basis, (who, feat), val)
    column = np.full(strings.FEATURES, -1)
    column[live] = np.arange(len(live))
    k = np.zeros((len(tokens), len(marks)))
    for at in range(0, len(tokens), 128):
        part = tokens[at: at + 128]
        who, feat, val = strings.features(part)
        hit = column[feat] >= 0
        dense = np.zeros((len(part), len(live)), np.float32)
        np.add.at(dense, (who[hit], column[feat[hit]]), val[hit])
        k[at: at + 128] = dense @ basis.T
    return k, basis, live


def _inserted(word: str, turn: int = 0) -> list[str]:
    """The word with one letter inserted, once at each place inside; the letters go around the alphabet, from ``turn`` on."""
    return [word[:k] + chr(97 + (7 * k + len(word) + turn) % 26) + word[k:] for k in range(1, len(word))]


def _disguised(text: str, insults: frozenset[str], n: int) -> list[str]:
    """The text with a letter inserted into each of its ``insults``, and with a blank put into each; ``n`` picks letter and
    place. Without insults, the text as it is."""
    own = text.lower().split()
    marred = [_inserted(w, 1 + n % 25)[n % (len(w) - 1)] if w in insults else w for w in own]
    gapped = [f"{w[: 1 + n % (len(w) - 1)]} {w[1 + n % (len(w) - 1):]}" if w in insults else w for w in own]
    return [" ".join(marred), " ".join(gapped)]


def fit(texts: list[tuple[str, int]], landmarks: int = 300, instances: int = 6_000, rounds: int = 4, cost: float = 100.0, evidence: float = 5.0) -> Model:
    """``texts``: (text, label) of a bounded sample. One third of them only sets the probabilities, each text as it is and
    in two forms with its learned insults disguised; a text without any counts as often, so the share of toxic texts stays.
    A sample that lies elsewhere (``apart``) is fitted there."""
    if hasattr(texts, "apart"):
        return texts.apart(partial(fit, landmarks=landmarks, instances=instances, rounds=rounds, cost=cost, evidence=evidence))
    held = [(t, y) for n, (t, y) in enumerate(texts) if n % 3 == 2]
    kept = [(t, y) for n, (t, y) in enumerate(texts) if n % 3 != 2]
    n1, n0 = sum(y for _, y in kept), sum(1 - y for _, y in kept)
    share = sum(y for _, y in texts) / len(texts) if texts else 0.0
    untrained = Model(np.zeros(strings.FEATURES, np.float32), 0.0, np.zeros(1), np.full(1, min(share, 0.5)), [])
    if not n1 or not n0:
        return untrained
    # words are numbered, and a text is an array of numbers: the sample takes little memory
    seen: dict[str, int] = {}
    often = Counter(w for t, y in kept if not y for w in set(t.lower().split()) if len(w) < JOINED[-1])
    # words of a single clean text count as odd, so that joined words of clean texts teach as well
    whole = frozenset(w for w, n in often.most_common(MOST_WHOLE) if n > 1)
    train = [(np.array([seen.setdefault(w, len(seen)) for w in sorted(set(words(t, whole)))], np.int32), y) for t, y in kept]
    names = list(seen)
    neg, pos = (np.bincount(np.concatenate([bag for bag, y in train if y == label]), minlength=len(names)).astype(float) for label in (0, 1))
    # evidence that a word goes with toxic texts: signed log-likelihood ratio against the share of toxic texts
    q, p = n1 / (n1 + n0), pos / (pos + neg)
    gain = pos * np.log(np.maximum(p, 1e-9) / q) + neg * np.log(np.maximum(1 - p, 1e-9) / (1 - q))
    gain = np.where(p > q, gain, -gain)
    strong = np.nonzero((gain >= evidence) & (p > (1 + q) / 2))[0]
    strong = strong[np.argsort(-gain[strong], kind="stable")][:instances]
    clean = np.nonzero((neg > 0) & (p <= q))[0]
    if not len(strong) or not len(clean):
        return untrained
    only_toxic = neg == 0
    # words that clean texts never hold also teach with a letter inserted, unless that is a word of a clean text
    marred = [v for i in strong[: landmarks // 2] if only_toxic[i] for v in _inserted(names[i]) if v not in seen]
    bags = [bag[only_toxic[bag]] for bag, y in train if y]
    positive, negative = strong, clean[:: max(1, len(clean) // instances)]
    model = untrained
    for step in range(rounds):
        rows = np.concatenate([positive, negative])
        tokens = [names[i] for i in rows] + marred
        y = np.where((np.arange(len(tokens)) < len(positive)) | (np.arange(len(tokens)) >= len(rows)), 1.0, -1.0)
        marks = [names[i] for i in positive[: landmarks // 2]]
        marks += [names[i] for i in negative[::-1][: max(1, landmarks - len(marks))]]
        k, basis, live = _kernel(tokens, marks)
        gram = (basis @ basis.T).astype(float)  # the kernels of the marks with each other
        values, vectors = np.linalg.eigh(gram + 1e-6 * np.eye(len(marks)))
        white = vectors / np.sqrt(np.maximum(values, 1e-4)) @ vectors.T
        x = np.ones((len(tokens), len(marks) + 1))
        np.matmul(k, white, out=x[:, :-1])
        del k
        c = np.where(y > 0, cost * max(1.0, 0.25 * len(negative) / len(positive)), cost)
        w = _newton(x, y, c, np.zeros(len(marks) + 1))
        del x
        weights = np.zeros(strings.FEATURES, np.float32)
        weights[live] = (white @ w[:-1]) @ basis
        model = Model(weights, float(w[-1]), np.zeros(1), np.zeros(1), marks)
        if step == rounds - 1:
            break
        f = np.concatenate([model.decide(names[at: at + 20_000]) for at in range(0, len(names), 20_000)])
        hard = clean[np.argsort(-f[clean], kind="stable")][: instances // 2]
        negative = np.union1d(negative, hard[f[hard] > -1])
        negative = negative[np.argsort(f[negative], kind="stable")]
        found = np.unique(np.concatenate([bag[f[bag] > 0] for bag in bags]))
        positive = np.union1d(strong, found[np.argsort(-f[found], kind="stable")][:instances])
        positive = positive[np.argsort(-gain[positive], kind="stable")]
    model.whole, model.insults = whole, frozenset(names[i] for i in positive if only_toxic[i] and len(names[i]) > 3)
    scorer = Scorer(model)
    margin = scorer.margins([t for t, _ in held])
    disguised = [scorer.margins(_disguised(t, model.insults, n)) if y else margin[[n, n]] for n, (t, y) in enumerate(held)]
    label = np.array([y for _, y in held], float)
    model.levels, model.shares = _rising(np.concatenate([margin, *disguised]), np.concatenate([label, np.repeat(label, 2)]))
    return model
