"""Byte automata for a set of regular expressions: subset construction and minimisation.

Understood are literals, classes, groups, alternatives and repeats over ASCII; that
is what rules for tokens need. Expressions are parsed by Python's own parser.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass


class _Nfa:
    """Thompson's construction; ``backwards`` builds the automaton of the reversed strings."""

    def __init__(self, backwards: bool = False) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.backwards = backwards

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Append ``tree`` after the state ``start``; the state behind it."""
        for op, arg in reversed(list(tree)) if self.backwards else tree:
            if op in (sre.LITERAL, sre.IN):
                end = self.state()
                self.moves[start].append((_bytes_of(op, arg), end))
            elif op is sre.SUBPATTERN:
                end = self.add(arg[-1], start)
            elif op is sre.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    self.empty[self.add(branch, start)].append(end)
            elif op is sre.MAX_REPEAT:
                least, most, part = arg
                end = start
                for _ in range(least):
                    end = self.add(part, end)
                if most is sre.MAXREPEAT:
                    loop = self.state()
                    self.empty[end].append(loop)
                    self.empty[self.add(part, loop)].append(loop)
                    end = loop
                else:
                    out = self.state()
                    self.empty[end].append(out)
                    for _ in range(most - least):
                        end = self.add(part, end)
                        self.empty[end].append(out)
                    end = out
            else:
                raise ValueError(f"not understood in a rule: {op}")
            start = end
        return start

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _bytes_of(op, arg) -> frozenset[int]:
    if op is sre.LITERAL:
        return frozenset([arg])
    found: set[int] = set()
    for kind, x in arg:
        if kind is sre.LITERAL:
            found.add(x)
        elif kind is sre.RANGE:
            found.update(range(x[0], x[1] + 1))
        else:
            raise ValueError(f"not understood in a class: {kind}")
    return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """``table[state + class]`` is the next state, states being multiples of the number of classes.

    ``classes`` maps each byte to its class. States from ``accepting`` on accept
    what ``masks`` says, a bit for each rule. ``dead`` is the state that nothing leaves, or -1.
    """

    table: list[int]
    classes: bytes
    start: int
    accepting: int
    masks: dict[int, int]
    dead: int


def compile_rules(patterns: list[str], search: bool = True, backwards: bool = False) -> Automaton:
    """One minimal automaton for all patterns. With ``search`` a match may begin at any byte."""
    nfa = _Nfa(backwards)
    root = nfa.state()
    finals: dict[int, int] = {}
    for k, pattern in enumerate(patterns):
        first = nfa.state()
        nfa.empty[root].append(first)
        finals[nfa.add(parser.parse(pattern), first)] = 1 << k
    used = {m[0] for moves in nfa.moves for m in moves}
    signature = [tuple(b in chars for chars in sorted(used, key=sorted)) for b in range(256)]
    kinds = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    example = {kinds[s]: b for b, s in enumerate(signature)}
    begin = nfa.closure([root])
    reach = [nfa.closure([s]) for s in range(len(nfa.empty))]
    steps: list[list[frozenset[int]]] = [
        [frozenset().union(*(reach[t] for chars, t in moves if example[c] in chars)) for c in range(len(kinds))]
        for moves in nfa.moves
    ]
    moving = {s for s, moves in enumerate(nfa.moves) if moves}
    again = begin if search else frozenset()
    number, order, rows = {begin: 0}, [begin], []
    for states in order:
        live, row = states & moving, []
        for c in range(len(kinds)):
            nxt = again.union(*(steps[s][c] for s in live))
            if nxt not in number:
                number[nxt] = len(order)
                order.append(nxt)
            row.append(number[nxt])
        rows.append(row)
    masks = [sum({finals[s] for s in states if s in finals}) for states in order]
    part = masks
    while True:  # Moore: split classes of states until their successors agree
        ids: dict[tuple, int] = {}
        refined = [ids.setdefault((part[i], *(part[t] for t in rows[i])), len(ids)) for i in range(len(rows))]
        if len(ids) == len(set(part)):
            break
        part = refined
    blocks = {p: i for i, p in reversed(list(enumerate(refined)))}  # a state for each class
    ranked = sorted(blocks, key=lambda p: masks[blocks[p]] != 0)
    place = {p: i * len(kinds) for i, p in enumerate(ranked)}
    table = [place[refined[t]] for p in ranked for t in rows[blocks[p]]]
    quiet = sum(masks[blocks[p]] == 0 for p in ranked) * len(kinds)
    dead = next((place[p] for p in ranked if not masks[blocks[p]] and all(refined[t] == p for t in rows[blocks[p]])), -1)
    return Automaton(
        table,
        bytes(kinds[s] for s in signature),
        place[refined[0]],
        quiet,
        {place[p]: masks[blocks[p]] for p in ranked if masks[blocks[p]]},
        dead,
    )
