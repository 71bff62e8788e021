"""A small machine built on the driver: rules, lexicons and other machines that are broadcast once they are made."""

from __future__ import annotations

from pyspark.sql import SparkSession

from weftline.model import ARCS, META, STATES, Fst, InvalidMachine
from weftline.semiring import INF, SEMIRINGS
from weftline.session import ship_by_value

ship_by_value(__name__)


class Machine:
    """States 0, 1, ...; arcs are (ilabel, olabel, weight, dst) lists by state; finals hold weights, INF for none."""

    def __init__(self) -> None:
        self.start: int | None = None
        self.finals: list[float] = []
        self.arcs: list[list[tuple[int, int, float, int]]] = []

    def clone(self) -> Machine:
        out = Machine()
        out.start, out.finals, out.arcs = self.start, list(self.finals), [list(a) for a in self.arcs]
        return out

    def add_state(self) -> int:
        self.finals.append(INF)
        self.arcs.append([])
        return len(self.finals) - 1

    def add_states(self, n: int) -> None:
        for _ in range(n):
            self.add_state()

    def _check(self, *states: int) -> None:
        for s in states:
            if not 0 <= s < len(self.finals):
                raise InvalidMachine(f"no state {s}")

    def set_start(self, state: int) -> None:
        self._check(state)
        self.start = state

    def set_final(self, state: int, weight: float = 0.0) -> None:
        self._check(state)
        self.finals[state] = INF if abs(weight) == INF else float(weight)

    def add_arc(self, src: int, ilabel: int, olabel: int, weight: float, dst: int) -> None:
        self._check(src, dst)
        self.arcs[src].append((ilabel, olabel, float(weight), dst))

    def delete_arcs(self, state: int) -> None:
        self._check(state)
        self.arcs[state] = []

    def delete_states(self) -> None:
        self.start, self.finals, self.arcs = None, [], []

    def sort_arcs(self) -> None:
        for a in self.arcs:
            a.sort()

    @property
    def num_states(self) -> int:
        return len(self.finals)

    @property
    def num_arcs(self) -> int:
        return sum(map(len, self.arcs))

    def is_final(self, state: int) -> bool:
        return self.finals[state] != INF

    def labels(self) -> set[int]:
        return {i for a in self.arcs for i, _, _, _ in a if i}

    def embed(self, other: Machine) -> int:
        """Copies other's states and arcs behind the own ones; returns how far its ids moved."""
        base = len(self.finals)
        self.finals += other.finals
        self.arcs += [[(i, o, w, d + base) for i, o, w, d in a] for a in other.arcs]
        return base

    def frame(self, spark: SparkSession, fst_id: int = 0, semiring: str = "tropical", encoding: str = "byte_plus_one") -> Fst:
        meta = spark.createDataFrame([(fst_id, self.start)], META)
        states = spark.createDataFrame([(fst_id, i, None if w == INF else w) for i, w in enumerate(self.finals)], STATES)
        arcs = spark.createDataFrame([(fst_id, s, i, o, w, d) for s, a in enumerate(self.arcs) for i, o, w, d in a], ARCS)
        return Fst(meta, states, arcs, SEMIRINGS[semiring], encoding)

    @staticmethod
    def of(fst: Fst, max_arcs: int = 5_000_000) -> Machine:
        """The only machine of a batch, brought to the driver; its size is checked first."""
        if fst.arcs.limit(max_arcs + 1).count() > max_arcs:
            raise InvalidMachine(f"more than {max_arcs} arcs: too large for one process")
        ids = fst.meta.collect()
        if len(ids) != 1:
            raise InvalidMachine(f"{len(ids)} machines where one is wanted")
        out, number = Machine(), {}
        for r in sorted(fst.states.collect(), key=lambda r: r["state"]):
            number[r["state"]] = out.add_state()
            out.set_final(number[r["state"]], INF if r["final_weight"] is None else r["final_weight"])
        for r in fst.arcs.collect():
            out.add_arc(number[r["src"]], r["ilabel"], r["olabel"], r["weight"], number[r["dst"]])
        out.start = None if ids[0]["start"] is None else number[ids[0]["start"]]
        out.sort_arcs()
        return out


def chain(ilabels: list[int], olabels: list[int] | None = None, weight: float = 0.0) -> Machine:
    """A linear machine; the shorter tape is filled up with epsilons."""
    olabels = ilabels if olabels is None else olabels
    n, out = max(len(ilabels), len(olabels)), Machine()
    out.add_states(n + 1)
    at = lambda x, i: x[i] if i < len(x) else 0
    for i in range(n):
        out.add_arc(i, at(ilabels, i), at(olabels, i), 0.0, i + 1)
    out.set_start(0)
    out.set_final(n, weight)
    return out


def spell(text: str | bytes) -> list[int]:
    return [b + 1 for b in (text.encode() if isinstance(text, str) else text)]


def acceptor(text: str | bytes) -> Machine:
    return chain(spell(text))


def transducer(one: str | bytes, other: str | bytes) -> Machine:
    return chain(spell(one), spell(other))


def any_of(machines: list[Machine]) -> Machine:
    """The union: one start with an epsilon to each machine's start."""
    out = Machine()
    out.set_start(out.add_state())
    for m in machines:
        if m.start is not None:
            base = out.embed(m)
            out.add_arc(0, 0, 0, 0.0, m.start + base)
    return out


def trie(words: list[str], weights: list[float] | None = None) -> Machine:
    """A deterministic acceptor of words; of a word that comes twice the smaller weight stays."""
    out = Machine()
    out.set_start(out.add_state())
    to: list[dict[int, int]] = [{}]
    for word, w in zip(words, weights or [0.0] * len(words), strict=True):
        s = 0
        for label in spell(word):
            if label not in to[s]:
                to[s][label] = out.add_state()
                to.append({})
                out.add_arc(s, label, label, 0.0, to[s][label])
            s = to[s][label]
        out.set_final(s, min(w, out.finals[s]))
    return out


def edit_transducer(alphabet: list[int]) -> Machine:
    """One state: match 0, substitute, insert and delete 1."""
    out = Machine()
    out.set_start(out.add_state())
    out.set_final(0)
    for a in alphabet:
        out.add_arc(0, a, 0, 1.0, 0)
        out.add_arc(0, 0, a, 1.0, 0)
        for b in alphabet:
            out.add_arc(0, a, b, float(a != b), 0)
    return out
