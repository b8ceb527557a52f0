"""Probabilistic automata learnt from examples: prefix trees whose statistically compatible states merge.

States of the prefix tree are visited in breadth-first order. One is merged with an earlier state when
a Hoeffding bound cannot tell their ends and their next symbols apart, and neither their successors',
with the one under which its own continuations are likeliest if there are several; otherwise it stays a
state of its own. The chain of states that all examples pass, their common beginning, takes no other
state in, so that a format's literal stays literal. What is left is a deterministic automaton whose transitions
carry the relative frequencies of the examples. A state that was left by VARIED symbols or more also
lets the alphabet's other symbols pass, to where most of its own lead, as one unseen example would.
"""

from __future__ import annotations

import math
from collections import deque

VARIED = 4


class Automaton:
    """arcs[state][symbol] = (next state, bits); ends[state] = bits of ending there (inf: never seen)."""

    def __init__(self, arcs: list[dict[str, tuple[int, float]]], ends: list[float]):
        self.arcs, self.ends = arcs, ends

    def bits(self, text: str, limit: float = math.inf) -> float:
        """Code length of the text in bits; inf where the automaton has no such path, or beyond limit."""
        state, total = 0, 0.0
        for c in text:
            arc = self.arcs[state].get(c)
            if arc is None:
                return math.inf
            state = arc[0]
            total += arc[1]
            if total > limit:
                return math.inf
        return total + self.ends[state]


def infer(examples: list[str], alpha: float = 0.05) -> Automaton:
    """The automaton of the examples (repeats count); no examples give one that accepts nothing."""
    kids: list[dict[str, int]] = [{}]
    seen, ended, through = [0], [0], [{}]  # through[s][c]: examples that leave s by c
    for x in sorted(examples):
        s = 0
        seen[0] += 1
        for c in x:
            through[s][c] = through[s].get(c, 0) + 1
            if c not in kids[s]:
                kids[s][c] = len(kids)
                kids.append({})
                seen.append(0)
                ended.append(0)
                through.append({})
            s = kids[s][c]
            seen[s] += 1
        ended[s] += 1
    literal, s = set(), 0
    while len(kids[s]) == 1 and not ended[s]:
        literal.add(s)
        s = next(iter(kids[s].values()))
    width = len({c for x in examples for c in x})
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b or not seen[a] or not seen[b]:
                continue
            if differ(ended[a], seen[a], ended[b], seen[b]):
                return False
            for c in through[a].keys() | through[b].keys():
                if differ(through[a].get(c, 0), seen[a], through[b].get(c, 0), seen[b]):
                    return False
            todo.extend((kids[a][c], kids[b][c]) for c in kids[b] if c in kids[a])
        return True

    def likeness(a: int, b: int) -> float:
        """Log likelihood of all that follows b, read from a with half a count added to each symbol; where a has no path, all symbols are as likely."""
        total, todo = 0.0, [(a, b)]
        while todo:
            a, b = todo.pop()
            if a is None:
                total -= math.log(width + 1) * (ended[b] + sum(through[b].values()))
            else:
                size = math.log(seen[a] + 0.5 * (width + 1))
                total += ended[b] * (math.log(ended[a] + 0.5) - size)
                total += sum(n * (math.log(through[a].get(c, 0) + 0.5) - size) for c, n in through[b].items())
            todo.extend((None if a is None else kids[a].get(c), k) for c, k in kids[b].items())
        return total

    def fold(into: int, tree: int) -> None:
        """Adds the counts of the subtree at `tree` to the automaton at `into`."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            seen[a] += seen[b]
            ended[a] += ended[b]
            for c, n in through[b].items():
                through[a][c] = through[a].get(c, 0) + n
                if c in kids[a]:
                    todo.append((kids[a][c], kids[b][c]))
                else:
                    kids[a][c] = kids[b][c]

    kept, queue = [0], deque((0, c) for c in sorted(kids[0]))
    fixed = {0}
    while queue:
        parent, c = queue.popleft()
        state = kids[parent][c]
        if state in fixed:
            continue
        match = max((r for r in kept if r not in literal and compatible(r, state)), key=lambda r, state=state: (likeness(r, state), -r), default=None)
        if match is None:
            kept.append(state)
            fixed.add(state)
            queue.extend((state, d) for d in sorted(kids[state]))
        else:
            kids[parent][c] = match
            fold(match, state)
            queue.extend((r, d) for r in kept for d in sorted(kids[r]) if kids[r][d] not in fixed and (r, d) not in queue)
    number = {s: i for i, s in enumerate(kept)}
    alphabet = sorted({c for s in kept for c in through[s]})
    arcs = []
    for s in kept:
        own = {c: (number[kids[s][c]], -math.log2(n / seen[s])) for c, n in through[s].items()}
        if len(own) >= VARIED:
            most = max(sorted(own), key=lambda c, s=s: through[s][c])
            own |= {c: (own[most][0], math.log2(seen[s] + 1)) for c in alphabet if c not in own}
        arcs.append(own)
    ends = [-math.log2(ended[s] / seen[s]) if ended[s] else math.inf for s in kept]
    return Automaton(arcs, ends)
