"""Levenshtein automata of all terms of a lexicon, intersected with its trie and made deterministic step by step."""

from __future__ import annotations

#: Steps remembered; beyond it they are worked out anew.
REMEMBERED = 200_000


def edits(term: str) -> int:
    """The edits that a spelling of a term may have."""
    return 0 if len(term) < 4 else 1 if len(term) < 10 else 2


class Automaton:
    """Reads a word and tells the term it spells, with how many edits: the nearest, then the first in order.

    A state is a set of (trie node, edits so far), as the automata of all terms reach them together. States get
    numbers when first met, and a step from a state over a character is worked out once; characters that no term has
    are one character. State 0 is dead: a word is left as soon as no term can be reached.
    """

    def __init__(self, terms: list[str]):
        self.terms = sorted(set(terms))
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.slack: list[int] = [0]  # the most edits that a term below a node allows
        for i, t in enumerate(self.terms):
            node, allowed = 0, edits(t)
            self.slack[0] = max(self.slack[0], allowed)
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.term)
                    self.children.append({})
                    self.term.append(-1)
                    self.slack.append(0)
                node = self.children[node][c]
                self.slack[node] = max(self.slack[node], allowed)
            self.term[node] = i
        self.alphabet = {c for t in self.terms for c in t}
        self.reset()

    def reset(self) -> None:
        self.number: dict[frozenset, int] = {frozenset(): 0}
        self.states: list[dict[int, int]] = [{}]
        self.ends: list[tuple[int, int] | None] = [None]
        self.steps: dict[tuple[int, str], int] = {}
        self.start = self._named({0: 0})

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With what is reached by leaving out characters of terms."""
        todo = list(nodes)
        while todo:
            n = todo.pop()
            for child in self.children[n].values():
                e = nodes[n] + 1
                if e <= self.slack[child] and e < nodes.get(child, 99):
                    nodes[child] = e
                    todo.append(child)
        return nodes

    def _named(self, nodes: dict[int, int]) -> int:
        nodes = self._closed(nodes)
        key = frozenset(nodes.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(nodes)
            done = [(e, self.term[n]) for n, e in nodes.items() if self.term[n] >= 0 and e <= edits(self.terms[self.term[n]])]
            self.ends.append(min(done, default=None))
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for n, e in self.states[state].items():
            if e < self.slack[n] and e + 1 < out.get(n, 99):
                out[n] = e + 1  # a character too many
            for k, child in self.children[n].items():
                cost = e + (k != c)
                if cost <= self.slack[child] and cost < out.get(child, 99):
                    out[child] = cost
        return self._named(out)

    def match(self, word: str, anew: bool = False) -> tuple[int, int] | None:
        """(edits, number of the term), or None."""
        state = self.start
        for c in word:
            key = (state, c if c in self.alphabet else "")
            after = self.steps.get(key)
            if after is None:
                if len(self.steps) >= REMEMBERED and not anew:
                    self.reset()
                    return self.match(word, anew=True)
                after = self.steps[key] = self._step(state, key[1])
            if not after:
                return None
            state = after
        return self.ends[state]
