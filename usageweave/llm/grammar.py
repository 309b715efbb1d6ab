"""Grammar inference: probabilistic automata from labelled strings.

The strings' prefix tree is folded from the root: a state whose ending and branching
frequencies do not differ significantly (Hoeffding bound) from those of a state that is
already settled, nor do those of their successors, is merged into it. What remains gives
the likelihood of any string.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass


@dataclass
class _State:
    seen: int = 0
    ends: int = 0

    def __post_init__(self) -> None:
        self.count: dict[str, int] = {}
        self.to: dict[str, int] = {}


class Automaton:
    """Learned by :meth:`learn`; ``log_likelihood`` scores a string of symbols."""

    def __init__(self, alphabet: str) -> None:
        self.alphabet = alphabet
        self.states = [_State()]

    @classmethod
    def learn(cls, strings: list[str], alphabet: str, alpha: float = 0.05) -> Automaton:
        made = cls(alphabet)
        for s in strings:
            made._add(s)
        made._merge(math.sqrt(0.5 * math.log(2 / alpha)))
        made._settle()
        return made

    def _add(self, string: str) -> None:
        at = 0
        for symbol in string:
            state = self.states[at]
            state.seen += 1
            state.count[symbol] = state.count.get(symbol, 0) + 1
            if symbol not in state.to:
                state.to[symbol] = len(self.states)
                self.states.append(_State())
            at = state.to[symbol]
        self.states[at].seen += 1
        self.states[at].ends += 1

    def _differ(self, a: _State, b: _State, bound: float) -> bool:
        near = bound * (1 / math.sqrt(a.seen) + 1 / math.sqrt(b.seen))
        if abs(a.ends / a.seen - b.ends / b.seen) > near:
            return True
        return any(
            abs(a.count.get(x, 0) / a.seen - b.count.get(x, 0) / b.seen) > near
            for x in {*a.count, *b.count}
        )

    def _compatible(self, settled: int, other: int, bound: float) -> bool:
        todo = [(settled, other)]
        while todo:
            i, j = todo.pop()
            a, b = self.states[i], self.states[j]
            if self._differ(a, b, bound):
                return False
            todo += [(a.to[x], b.to[x]) for x in b.to if x in a.to]
        return True

    def _fold(self, into: int, other: int) -> None:
        todo = [(into, other)]
        while todo:
            i, j = todo.pop()
            a, b = self.states[i], self.states[j]
            a.seen += b.seen
            a.ends += b.ends
            for x, n in b.count.items():
                a.count[x] = a.count.get(x, 0) + n
                if x in a.to:
                    todo.append((a.to[x], b.to[x]))
                else:
                    a.to[x] = b.to[x]

    def _merge(self, bound: float) -> None:
        settled = [0]
        known = {0}
        edge = deque((0, x) for x in sorted(self.states[0].to))
        while edge:
            parent, symbol = edge.popleft()
            child = self.states[parent].to[symbol]
            if child in known:
                continue
            for i in settled:
                if self._compatible(i, child, bound):
                    self.states[parent].to[symbol] = i
                    self._fold(i, child)
                    # Folding may have given settled states new successors.
                    waiting = set(edge)
                    edge.extend(
                        (s, x)
                        for s in settled
                        for x in sorted(self.states[s].to)
                        if self.states[s].to[x] not in known and (s, x) not in waiting
                    )
                    break
            else:
                settled.append(child)
                known.add(child)
                edge.extend((child, x) for x in sorted(self.states[child].to))

    def _settle(self) -> None:
        """Smoothed logarithms of the probabilities, for reachable states only."""
        self.table: dict[int, tuple[dict[str, tuple[float, int]], float, float]] = {}
        todo = [0]
        while todo:
            i = todo.pop()
            if i in self.table:
                continue
            s = self.states[i]
            total = s.seen + 0.5 * (len(self.alphabet) + 1)
            self.table[i] = (
                {x: (math.log((n + 0.5) / total), s.to[x]) for x, n in s.count.items()},
                math.log((s.ends + 0.5) / total),
                math.log(0.5 / total),
            )
            todo += list(s.to.values())
        self.states = []

    def log_likelihood(self, string: str) -> float:
        """Natural logarithm of the probability; a symbol unknown to a state costs its
        smoothed share and leaves the state as it is.
        """
        at, total = self.table[0], 0.0
        for symbol in string:
            step = at[0].get(symbol)
            if step is None:
                total += at[2]
            else:
                total += step[0]
                at = self.table[step[1]]
        return total + at[1]
