"""Best output of one broadcast machine for each string of a column.

The machine is composed with every string and the best path's output is read, without building the product: for a
block of strings, a matrix of distances (string x state) moves along the strings byte by byte. Arcs that read
nothing are folded into the arcs before them beforehand. All strings of a block have about the same length.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from weftline.functions.machine import Machine
from weftline.semiring import INF
from weftline.session import ship_by_value

ship_by_value(__name__)


def _silent(m: Machine) -> list[dict[int, tuple[float, int, bytes]]]:
    """For each state the best way to others over arcs that read nothing: weight, arcs, output."""
    out = []
    for s in range(m.num_states):
        best, todo = {s: (0.0, 0, b"")}, [s]
        for _ in range(m.num_states + 1):
            moved = []
            for q in todo:
                w, n, text = best[q]
                for i, o, v, d in m.arcs[q]:
                    if i == 0 and v != INF:
                        way = (w + v, n + 1, text + (bytes([o - 1]) if o else b""))
                        if d not in best or way < best[d]:
                            best[d] = way
                            moved.append(d)
            todo = sorted(set(moved))
            if not todo:
                break
        else:
            raise ValueError("a cycle that reads nothing and has negative weight")
        out.append(best)
    return out


class Kernel:
    """A machine over bytes (labels 1 to 256), ready to be sent to executors."""

    def __init__(self, machine: Machine):
        silent = _silent(machine)
        moves: dict[tuple[int, int], dict[int, tuple[float, int, bytes]]] = {}
        for s, arcs in enumerate(machine.arcs):
            for i, o, w, m in arcs:
                if i == 0 or w == INF:
                    continue
                for d, (v, n, text) in silent[m].items():
                    way = (w + v, n, (bytes([o - 1]) if o else b"") + text)
                    at = moves.setdefault((s, d), {})
                    if i not in at or way < at[i]:
                        at[i] = way
        self.pairs = sorted(moves)
        self.weight = np.full((len(self.pairs), 257), INF)
        self.text: list[list[bytes]] = []
        for k, p in enumerate(self.pairs):
            row = [b""] * 257
            for label, (w, _, text) in moves[p].items():
                self.weight[k, label], row[label] = w, text
            self.text.append(row)
        self.finals = np.array(machine.finals or [INF])
        self.n = max(1, machine.num_states)
        self.first = np.full(self.n, INF)
        self.lead = {}
        if machine.start is not None:
            for d, (w, _, text) in silent[machine.start].items():
                self.first[d], self.lead[d] = w, text

    def run(self, strings: list[bytes], cells: int = 1 << 24) -> list[tuple[bytes | None, float]]:
        """(output or None, weight) of each string."""
        out: list = [None] * len(strings)
        order = sorted(range(len(strings)), key=lambda i: len(strings[i]))
        at = 0
        while at < len(order):
            longest = len(strings[order[at]])
            stop = at
            while stop < len(order) and len(strings[order[stop]]) <= longest * 5 // 4 + 1 and (stop == at or (stop - at + 1) * (longest * 5 // 4 + 2) * self.n <= cells):
                stop += 1
            self._block([strings[i] for i in order[at:stop]], order[at:stop], out)
            at = stop
        return out

    def _block(self, strings: list[bytes], places: list[int], out: list) -> None:
        lengths = np.array([len(s) for s in strings])
        b, t = len(strings), int(lengths.max(initial=0))
        text = np.zeros((b, t), np.int64)
        for i, s in enumerate(strings):
            text[i, : len(s)] = np.frombuffer(s, np.uint8).astype(np.int64) + 1
        dist = np.tile(self.first, (b, 1))
        end = np.where((lengths == 0)[:, None], dist, INF)
        came = np.full((t, b, self.n), -1, np.int32)
        for p in range(t):
            now = np.full((b, self.n), INF)
            label = text[:, p]
            for k, (s, d) in enumerate(self.pairs):
                way = dist[:, s] + self.weight[k, label]
                better = way < now[:, d]
                now[better, d] = way[better]
                came[p, better, d] = k
            dist = now
            done = lengths == p + 1
            end[done] = dist[done]
        total = end + self.finals[None, : self.n]
        best = np.argmin(total, axis=1)
        for i, place in enumerate(places):
            state, weight = int(best[i]), float(total[i, best[i]])
            if weight == INF:
                out[place] = (None, INF)
                continue
            parts = []
            for p in range(int(lengths[i]) - 1, -1, -1):
                k = came[p, i, state]
                parts.append(self.text[k][text[i, p]])
                state = self.pairs[k][0]
            parts.append(self.lead[state])
            out[place] = (b"".join(reversed(parts)), weight)


def pieces(text: bytes, cut: bytes) -> Iterable[bytes]:
    """text split before and after each byte of cut: those bytes stay pieces of their own."""
    start = 0
    for i, x in enumerate(text):
        if x in cut:
            if i > start:
                yield text[start:i]
            yield text[i : i + 1]
            start = i + 1
    if start < len(text):
        yield text[start:]
