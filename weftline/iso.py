"""Whether two small machines are the same but for the numbers of their states."""

from __future__ import annotations

from weftline.functions.machine import Machine
from weftline.semiring import INF


def isomorphic(a: Machine, b: Machine, tolerance: float = 1e-5) -> bool:
    if (a.num_states, a.num_arcs) != (b.num_states, b.num_arcs) or (a.start is None) != (b.start is None):
        return False
    if a.start is None:
        return True
    near = lambda x, y: x == y or abs(x - y) <= tolerance

    def pair(to: dict[int, int], back: dict[int, int], s: int, t: int) -> bool:
        """Extends the pairing by s and t and all that follows from it; tries each order of arcs that look alike."""
        todo = [(s, t)]
        while todo:
            s, t = todo.pop()
            if s in to or t in back:
                if to.get(s) != t or back.get(t) != s:
                    return False
                continue
            to[s], back[t] = t, s
            if (a.finals[s] == INF) != (b.finals[t] == INF) or (a.finals[s] != INF and not near(a.finals[s], b.finals[t])):
                return False
            x, y = sorted(a.arcs[s]), sorted(b.arcs[t])
            if len(x) != len(y):
                return False
            used = set()
            for i, o, w, d in x:
                fits = [k for k, (j, p, v, e) in enumerate(y) if k not in used and (i, o) == (j, p) and near(w, v) and (to.get(d, e) == e)]
                if not fits:
                    return False
                best = next((k for k in fits if to.get(d) == y[k][3]), fits[0])
                used.add(best)
                todo.append((d, y[best][3]))
        return True

    to: dict[int, int] = {}
    return pair(to, {}, a.start, b.start) and len(to) == a.num_states
