"""Rule regexes over bytes compiled into one deterministic automaton.

A small regex syntax (literals, \\xHH and \\c escapes, classes, groups, |, ?, *, +, {m}, {m,}, {m,n}) is parsed into a
nondeterministic automaton with one labelled end for each rule. Bytes that no rule tells apart share a class. Subset
construction gives the deterministic automaton, of which a state knows the rules that end there, and Moore's partition
refinement minimises it. The result is three arrays: class of a byte, transitions, and the set of rules of a state, by its number in a list
of sets; there may be any number of rules.

Two kinds are built: ``Starts`` reads texts from their end and keeps every start state alive, so that it says of every place which rules have a match that begins there;
``Ends`` begins at one place and says where the longest match of each rule ends.
"""

from __future__ import annotations

import numpy as np

#: With fewer texts than this left, a plain loop over the rest of each is quicker than a step for all.
FEW = 100


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def alternatives(self):
        out = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            out.append(self.sequence())
        return out[0] if len(out) == 1 else ("or", out)

    def peek(self):
        return self.p[self.i] if self.i < len(self.p) else ""

    def sequence(self):
        out = []
        while self.peek() not in ("", "|", ")"):
            out.append(self.repeated())
        return ("seq", out)

    def repeated(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                stop = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : stop].partition(",")
                self.i = stop + 1
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def atom(self):
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            node = self.alternatives()
            self.i += 1
            return node
        if c == "[":
            return ("set", self.klass())
        return ("set", frozenset([self.char()]))

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def klass(self) -> frozenset[int]:
        self.i += 1
        out: set[int] = set()
        while self.p[self.i] != "]":
            low = self.char()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                out.update(range(low, self.char() + 1))
            else:
                out.add(low)
        self.i += 1
        return frozenset(out)


def reversed_tree(node):
    """The expression of the reversed strings."""
    kind = node[0]
    if kind == "seq":
        return ("seq", [reversed_tree(x) for x in reversed(node[1])])
    if kind == "or":
        return ("or", [reversed_tree(x) for x in node[1]])
    if kind == "rep":
        return ("rep", reversed_tree(node[1]), *node[2:])
    return node


class _Nfa:
    """Thompson's construction; state -> (set of bytes, next) and state -> empty moves."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, node, start: int) -> int:
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "seq":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if kind == "or":
            end = self.state()
            for x in node[1]:
                self.empty[self.add(x, self.fork(start))].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            loop, end = self.fork(start), self.state()
            self.empty[self.add(inner, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        end = self.state()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.add(inner, start)
            self.empty[start].append(end)
        return end

    def fork(self, start: int) -> int:
        s = self.state()
        self.empty[start].append(s)
        return s

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Automaton:
    """``klass`` (256 bytes -> class), ``step`` (state x class -> state), ``mark`` (state -> number in ``sets``) and ``sets`` (tuples of rules; the first is
    empty). ``start`` is the state to begin with; the states with a rule come last, from ``first`` on."""

    def __init__(self, patterns: list[str], anywhere: bool, backwards: bool):
        nfa, ends = _Nfa(), {}
        root = nfa.state()
        for k, p in enumerate(patterns):
            tree = _Parser(p).alternatives()
            ends[nfa.add(reversed_tree(tree) if backwards else tree, nfa.fork(root))] = k
        kinds = sorted({s for m in nfa.moves for s, _ in m}, key=sorted)
        signature = [tuple(b in s for s in kinds) for b in range(256)]
        order = {x: i for i, x in enumerate(dict.fromkeys(signature))}
        self.klass = np.array([order[x] for x in signature], np.uint8)
        byte_of = [signature.index(x) for x in order]
        closures = [nfa.closure([s]) for s in range(len(nfa.moves))]
        by_class = [[[t for s, t in m if b in s] for b in byte_of] for m in nfa.moves]
        busy = [bool(m) or s in ends for s, m in enumerate(nfa.moves)]
        begin = frozenset(s for s in closures[root] if busy[s])
        always = begin if anywhere else frozenset()
        after = [[frozenset(u for t in by_class[s][c] for u in closures[t] if busy[u]) for c in range(len(byte_of))] for s in range(len(nfa.moves))]
        number = {begin: 0}
        todo, step = [begin], []
        while len(step) < len(number):
            now, row = todo[len(step)], []
            for c in range(len(byte_of)):
                key = always.union(*(after[s][c] for s in now))
                if key not in number:
                    number[key] = len(number)
                    todo.append(key)
                row.append(number[key])
            step.append(row)
        found = [tuple(sorted(ends[s] for s in states if s in ends)) for states in todo]
        self.sets = sorted(set(found) | {()})
        place = {x: i for i, x in enumerate(self.sets)}
        self.unminimised = len(step)
        self._minimise(np.array(step, np.int64), np.array([place[x] for x in found], np.int32))

    def _minimise(self, step: np.ndarray, mark: np.ndarray) -> None:
        group = np.unique(mark, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == group.max():
                break
            group = finer
        sample = np.unique(group, return_index=True)[1]
        order = np.argsort(mark[sample] != 0, kind="stable")  # the states that have a rule come last
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        sample = sample[order]
        self.step = np.ascontiguousarray(rank[group[step[sample]]].astype(np.int32))
        self.mark = mark[sample]
        self.start, self.first = int(rank[group[0]]), int(np.count_nonzero(self.mark == 0))


class Starts(Automaton):
    """Of every byte of a text the rules with a match that begins there, in one pass from the text's end."""

    def __init__(self, patterns: list[str]):
        super().__init__(patterns, True, True)

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, number in ``sets``) of the places with a rule, sorted: all texts advance together, a byte a step."""
        n = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-sizes, kind="stable")
        data = self.klass[np.frombuffer(b"".join(texts), np.uint8)] if n else np.zeros(0, np.uint8)
        ends = np.cumsum(sizes)[order] - 1
        sizes = sizes[order]
        width = self.step.shape[1]
        # states are kept multiplied by the number of classes, so that a step is one addition and one lookup
        flat = (self.step * width).ravel()
        accepting = self.first * width
        state = np.full(n, self.start * width, np.int32)
        lengths = -sizes
        which, where, what = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        t, active = 0, int(np.searchsorted(lengths, 0, side="left"))
        while active >= FEW:
            now = state[:active]
            np.take(flat, now + data[ends[:active] - t], out=now)
            if now.max() >= accepting:
                hit = np.flatnonzero(now >= accepting)
                which.append(hit)
                where.append(sizes[hit] - 1 - t)
                what.append(now[hit] // width)
            t += 1
            active = int(np.searchsorted(lengths, -t, side="left"))
        rows = self.step.tolist()
        for i in range(active):
            s, places, states = int(state[i]) // width, [], []
            last = int(sizes[i]) - 1 - t
            for back, c in enumerate(data[ends[i] - t - last : ends[i] - t + 1][::-1].tobytes()):
                s = rows[s][c]
                if s >= self.first:
                    places.append(last - back)
                    states.append(s)
            which.append(np.full(len(places), i))
            where.append(np.array(places, np.int64))
            what.append(np.array(states, np.int64))
        text, place, found = order[np.concatenate(which)], np.concatenate(where), np.concatenate(what)
        by = np.lexsort((place, text))
        return text[by], place[by], self.mark[found[by]]


class Ends(Automaton):
    """Where the longest match of each rule ends that begins at a given place."""

    def __init__(self, patterns: list[str]):
        super().__init__(patterns, False, False)
        self.rows, self.of_byte, self.marks = self.step.tolist(), self.klass.tolist(), self.mark.tolist()
        self.dead = [self.mark[s] == 0 and set(r) == {s} for s, r in enumerate(self.rows)]

    def walk(self, text: bytes, start: int) -> dict[int, int]:
        """rule -> end; rules without a match are absent."""
        s, last, rows, of_byte = self.start, {}, self.rows, self.of_byte
        for at in range(start, len(text)):
            s = rows[s][of_byte[text[at]]]
            if s >= self.first:
                last[self.marks[s]] = at + 1
            elif self.dead[s]:
                break
        out: dict[int, int] = {}
        for mark, end in sorted(last.items(), key=lambda x: x[1]):
            for rule in self.sets[mark]:
                out[rule] = end
        return out
