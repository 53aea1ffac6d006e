"""Probabilistic automata by state merging (grammar inference from positive samples).

A prefix tree of the sample is folded: the states nearest to the root are kept, and each of their children, the
heaviest first, is merged into a kept state that it is compatible with, or kept itself.  Two states are
compatible if the relative frequencies of every next character, of every character class and of the end differ by
less than Hoeffding's bound, and so do those of the states that the same characters lead to.  Of several
compatible states the one that explains the child's observations best is taken.  Fixed prefixes stay as chains of
states, random parts become loops.
"""

from __future__ import annotations

from math import log, sqrt

#: Confidence of the compatibility test: it fails wrongly with this probability.
ALPHA = 0.05
#: Depth to which the test follows common characters.
DEPTH = 4
#: Weight of unseen characters of a class against the state's observations.
SMOOTH = 1.0
_CLASS = {c: k for k, chars in (("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("a", "abcdefghijklmnopqrstuvwxyz"), ("0", "0123456789")) for c in chars}
_SIZE = {"A": 26, "a": 26, "0": 10}
#: Classes: upper, lower, digits, and any other sign by itself (of at most these many).
KINDS = 10


def class_of(c: str) -> str:
    return _CLASS.get(c, c)


class State:
    __slots__ = ("n", "end", "count", "next", "kinds")

    def __init__(self):
        self.n = self.end = 0
        self.count: dict[str, int] = {}
        self.next: dict[str, State] = {}
        self.kinds: dict[str, int] = {}

    def add(self, c: str, times: int) -> None:
        self.count[c] = self.count.get(c, 0) + times
        k = class_of(c)
        self.kinds[k] = self.kinds.get(k, 0) + times


def prefix_tree(sample: list[str]) -> State:
    root = State()
    for word in sample:
        at = root
        at.n += 1
        for c in word:
            at.add(c, 1)
            at = at.next.setdefault(c, State())
            at.n += 1
        at.end += 1
    return root


def _near(x: int, n: int, y: int, m: int) -> bool:
    return abs(x / n - y / m) < sqrt(0.5 * log(2 / ALPHA)) * (1 / sqrt(n) + 1 / sqrt(m))


def compatible(a: State, b: State, depth: int = DEPTH) -> bool:
    if a is b:
        return True
    if not _near(a.end, a.n, b.end, b.n):
        return False
    for x, y in ((a.kinds, b.kinds), (a.count, b.count)):
        if any(not _near(x.get(c, 0), a.n, y.get(c, 0), b.n) for c in {*x, *y}):
            return False
    return depth == 0 or all(compatible(s, b.next[c], depth - 1) for c, s in a.next.items() if c in b.next)


def _share(s: State, kind: str) -> float:
    return (s.kinds.get(kind, 0) + 0.01) / (s.n + 0.01 * KINDS)


def explained(s: State, tree: State, inside: set[int]) -> float:
    """Log-likelihood of a subtree's observations from state ``s`` on; a state that is not kept yet counts as a loop."""
    total, todo = 0.0, [(s, tree)]
    while todo:
        a, b = todo.pop()
        for c, times in b.count.items():
            k = class_of(c)
            total += times * log((a.count.get(c, 0) + SMOOTH * _share(a, k) / _SIZE.get(k, 1)) / (a.n + SMOOTH))
            after = a.next.get(c)
            todo.append((after if after is not None and id(after) in inside else a, b.next[c]))
    return total


def _fold(into: State, tree: State) -> None:
    """Add a subtree's observations to a state and the states behind it."""
    todo = [(into, tree)]
    while todo:
        a, b = todo.pop()
        a.n += b.n
        a.end += b.end
        for c, times in b.count.items():
            a.add(c, times)
            if c in a.next:
                todo.append((a.next[c], b.next[c]))
            else:
                a.next[c] = b.next[c]


def learn(sample: list[str]) -> list[State]:
    """States of the automaton, the start first."""
    kept = [prefix_tree(sample)]
    while True:
        inside = {id(s) for s in kept}
        fringe = [(s.next[c].n, i, c) for i, s in enumerate(kept) for c in s.next if id(s.next[c]) not in inside]
        if not fringe:
            return kept
        _, i, c = max(fringe, key=lambda x: (x[0], -x[1], x[2]))
        child = kept[i].next[c]
        fits = [(explained(s, child, inside), -k) for k, s in enumerate(kept) if compatible(s, child)]
        if fits:
            k = -max(fits)[1]
            kept[i].next[c] = kept[k]
            _fold(kept[k], child)
        else:
            kept.append(child)


class Automaton:
    """Log-likelihoods of strings; picklable tables of a few states."""

    def __init__(self, sample: list[str]):
        self.least, self.most = (min(map(len, sample)), max(map(len, sample))) if sample else (0, 0)
        states = learn(sample) if sample else []
        number = {id(s): i for i, s in enumerate(states)}
        self.steps, self.ends = [], []
        for s in states:
            total = s.n + SMOOTH
            step = {}
            for c, times in s.count.items():
                share = _share(s, class_of(c)) / _SIZE.get(class_of(c), 1)
                step[c] = (log((times + SMOOTH * share) / total), number[id(s.next[c])])
            other = {}
            for k in {*s.kinds, *_SIZE}:
                heaviest = max((c for c in s.count if class_of(c) == k), key=lambda c: (s.count[c], c), default=None)
                other[k] = (log(SMOOTH * _share(s, k) / _SIZE.get(k, 1) / total), number[id(s)] if heaviest is None else step[heaviest][1])
            self.steps.append((step, other, (log(SMOOTH * 0.01 / (s.n + 0.01 * KINDS) / total), number[id(s)])))
            self.ends.append(log((s.end + 0.01) / total))

    def loglike(self, word: str) -> float:
        """Natural logarithm of the word's probability; minus infinity for an automaton without sample."""
        if not self.steps:
            return float("-inf")
        total, at = 0.0, 0
        for c in word:
            step, other, rare = self.steps[at]
            got = step.get(c) or other.get(class_of(c)) or rare
            total += got[0]
            at = got[1]
        return total + self.ends[at]
