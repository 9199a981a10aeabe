"""Misspelled terms: Levenshtein automata intersected with a trie of the terms.

A state is a set of (trie node, edits so far): where in the lexicon a token may be. The sets
that can be reached are numbered once, which gives one table from state and character to the
next state. Many tokens are then read at the same time, one character per step.

The number of sets grows faster than the number of terms, so there is one table per block of
terms. Every token is read with all blocks, and the closest term of all counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Terms of one block.
BLOCK_TERMS = 32


def allowed_edits(term: str) -> int:
    """Edits within which a token counts as this term."""
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class _Trie:
    def __init__(self, terms: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        #: Most edits that any term below a node allows.
        self.edits: list[int] = [0]
        for number, term in enumerate(terms):
            node, edits = 0, allowed_edits(term)
            self.edits[0] = max(self.edits[0], edits)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(-1)
                    self.edits.append(0)
                node = self.next[node][c]
                self.edits[node] = max(self.edits[node], edits)
            self.term[node] = number


@dataclass(frozen=True)
class _Block:
    """The numbered states of a block of terms. State 0 is dead, state 1 the start."""

    step: np.ndarray
    term: np.ndarray
    edits: np.ndarray
    longest: int

    def read(self, column: np.ndarray, starts: np.ndarray, length: np.ndarray):
        """Yield (tokens, states) of the tokens that match, by index; each token once."""
        alive = np.flatnonzero((length > 0) & (length <= self.longest))
        state = np.ones(len(alive), dtype=np.int32)
        at = 0
        while len(alive):
            state = self.step[state, column[starts[alive] + at]]
            at += 1
            over = length[alive] == at
            hit = over & (self.term[state] >= 0)
            yield alive[hit], state[hit]
            keep = ~over & (state > 0)
            alive, state = alive[keep], state[keep]


@dataclass(frozen=True)
class SpellingTable:
    """All terms in order, their letters, and the states of each block of terms."""

    terms: list[str]
    letters: np.ndarray
    blocks: list[_Block]

    def read(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(tokens, terms, edits): the tokens that match, by index, with the closest term.

        Of several terms as close the first in order counts.
        """
        column = np.searchsorted(self.letters, codes)
        column[column == len(self.letters)] = 0
        other = self.letters[column] != codes if len(self.letters) else np.ones(len(codes), bool)
        column[other] = len(self.letters)
        length = ends - starts
        none = np.iinfo(np.int64).max
        # Edits first, then the number of the term.
        best = np.full(len(starts), none, dtype=np.int64)
        n = max(len(self.terms), 1)
        for block in self.blocks:
            for token, state in block.read(column, starts, length):
                found = block.edits[state].astype(np.int64) * n + block.term[state]
                best[token] = np.minimum(best[token], found)
        token = np.flatnonzero(best < none)
        return token, best[token] % n, best[token] // n


def spelling_table(terms: list[str], block_terms: int = BLOCK_TERMS) -> SpellingTable:
    """Build the tables; their size is in proportion to the lexicon."""
    terms = sorted(set(terms))
    letters = sorted({c for t in terms for c in t})
    return SpellingTable(
        terms, np.array([ord(c) for c in letters], dtype=np.uint32),
        [_block(terms[low:low + block_terms], low, letters)
         for low in range(0, len(terms), block_terms)],
    )


def _block(terms: list[str], first: int, letters: list[str]) -> _Block:
    """States of the terms of a block, numbered from ``first``."""
    trie = _Trie(terms)

    def closed(places: dict[int, int]) -> frozenset[tuple[int, int]]:
        """Add what a missing character leads to; keep the fewest edits of each node."""
        open_ = list(places.items())
        while open_:
            node, edits = open_.pop()
            if places.get(node) != edits or edits >= trie.edits[node]:
                continue
            for child in trie.next[node].values():
                if edits + 1 <= trie.edits[child] and edits + 1 < places.get(child, 99):
                    places[child] = edits + 1
                    open_.append((child, edits + 1))
        return frozenset(places.items())

    def after(state: frozenset[tuple[int, int]], letter: str | None):
        places: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= trie.edits[node] and edits < places.get(node, 99):
                places[node] = edits

        for node, edits in state:
            reach(node, edits + 1)
            for c, child in trie.next[node].items():
                reach(child, edits if c == letter else edits + 1)
        return closed(places)

    start = closed({0: 0})
    number = {frozenset(): 0, start: 1}
    rows: list[list[int]] = [[0] * (len(letters) + 1), []]
    todo = [start]
    while todo:
        state = todo.pop()
        # A letter that no place goes on with leads where any other letter leads.
        going_on = {c for node, _ in state for c in trie.next[node]}
        numbers = {}
        for letter in [None, *sorted(going_on)]:
            target = after(state, letter)
            if target not in number:
                number[target] = len(rows)
                rows.append([])
                todo.append(target)
            numbers[letter] = number[target]
        rows[number[state]] = [numbers.get(c, numbers[None]) for c in [*letters, None]]
    best_term = np.full(len(rows), -1, dtype=np.int32)
    best_edits = np.zeros(len(rows), dtype=np.int32)
    for state, at in number.items():
        ends = [(edits, trie.term[node]) for node, edits in state
                if trie.term[node] >= 0 and edits <= allowed_edits(terms[trie.term[node]])]
        if ends:
            edits, term = min(ends)
            best_edits[at], best_term[at] = edits, first + term
    longest = max(len(t) + allowed_edits(t) for t in terms)
    return _Block(np.array(rows, dtype=np.int32), best_term, best_edits, longest)
