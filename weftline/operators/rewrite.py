"""Context-dependent rewriting: tau between a left and a right context.

A rule is the star of (left tau right) or any symbol of sigma; copying a symbol costs 1, symbols inside a match cost
nothing, and the best path wins. So matches are chosen to cover as much as possible, contexts are consumed, and a
symbol outside sigma and outside all matches leaves no path: the result is null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from weftline.functions.machine import Machine, acceptor, any_of, spell, transducer
from weftline.plans.kernel import Kernel
from weftline.plans.packed import Packed
from weftline.semiring import INF
from weftline.session import ship_by_value, text_batches

ship_by_value(__name__)

COPY = 1.0
BLOCK = 1 << 20  # bytes of text that the kernel rewrites at once: its pieces are objects, some 50 times as large


class UnsupportedRewrite(ValueError):
    pass


def _unit(m: Machine, what: str) -> None:
    if any(w != 0 for a in m.arcs for _, _, w, _ in a) or any(w not in (0, INF) for w in m.finals):
        raise UnsupportedRewrite(f"{what} has weights")


def _accepts_nothing_read(m: Machine) -> bool:
    seen, todo = {m.start}, [m.start]
    while todo:
        s = todo.pop()
        if m.is_final(s):
            return True
        for i, _, _, d in m.arcs[s]:
            if i == 0 and d not in seen:
                seen.add(d)
                todo.append(d)
    return False


def _without_epsilons(m: Machine) -> Machine:
    """The same transducer without arcs that are epsilon on both tapes, for non-negative weights."""
    out = Machine()
    out.add_states(m.num_states)
    out.start = m.start
    for s in range(m.num_states):
        near, todo = {s: 0.0}, [s]
        while todo:
            q = todo.pop()
            for i, o, w, d in m.arcs[q]:
                if i == 0 and o == 0 and near[q] + w < near.get(d, INF):
                    near[d] = near[q] + w
                    todo.append(d)
        arcs: dict[tuple[int, int, int], float] = {}
        for q, v in near.items():
            out.finals[s] = min(out.finals[s], v + m.finals[q])
            for i, o, w, d in m.arcs[q]:
                if i or o:
                    arcs[i, o, d] = min(arcs.get((i, o, d), INF), v + w)
        out.arcs[s] = sorted((i, o, w, d) for (i, o, d), w in arcs.items())
    return out


def cdrewrite(tau: Machine, left: Machine | None = None, right: Machine | None = None, sigma: Machine | set[int] | None = None) -> Machine:
    """The rule as a machine. Contexts that are empty stand for no condition; of sigma only the labels count (default: all bytes)."""
    if tau.start is None:
        return Machine()
    contexts = [c if c is not None and c.start is not None else acceptor("") for c in (left, right)]
    for what, m in (("tau", tau), ("left context", contexts[0]), ("right context", contexts[1])):
        _unit(m, what)
    if _accepts_nothing_read(tau):
        raise UnsupportedRewrite("tau accepts the empty string, so where it applies is undefined")
    symbols = set(range(1, 257)) if sigma is None else sigma if isinstance(sigma, set) else sigma.labels()
    rule = Machine()
    rule.set_start(rule.add_state())
    rule.set_final(0)
    at = [(0, 0.0)]
    for m in (contexts[0], tau, contexts[1]):
        base = rule.embed(m)
        for s, w in at:
            rule.add_arc(s, 0, 0, w, m.start + base)
        at = [(s + base, m.finals[s]) for s in range(m.num_states) if m.is_final(s)]
        for s, _ in at:
            rule.finals[s] = INF
    for s, w in at:
        rule.add_arc(s, 0, 0, w, 0)
    for x in sorted(symbols):
        rule.add_arc(0, x, x, COPY, 0)
    return _without_epsilons(rule)


def _cut_bytes(tau: Machine, contexts: list[Machine | None], symbols: set[int]) -> bytes:
    used = set().union(*(m.labels() for m in [tau, *contexts] if m is not None))
    return bytes(x - 1 for x in sorted(symbols - used) if x - 1 in b" \n\t\r.,;:!?")


@dataclass
class Rule:
    """A rule from literal strings: tau maps strings, contexts are sets of strings, sigma the bytes that may be copied.

    apply() picks the cheapest way that gives the rule's result: a native replacement where matches can't meet, else the kernel,
    on the pieces between bytes that no match can contain.
    """

    tau: dict[str, str]
    left: list[str] = field(default_factory=lambda: [""])
    right: list[str] = field(default_factory=lambda: [""])
    sigma: bytes | None = None

    def machine(self) -> Machine:
        sets = [any_of([acceptor(x) for x in c]) for c in (self.left, self.right)]
        return cdrewrite(any_of([transducer(a, b) for a, b in self.tau.items()]), *sets, None if self.sigma is None else set(spell(self.sigma)))

    def packed(self) -> Packed:
        return Packed.of(self.machine())

    def patterns(self) -> dict[str, str] | None:
        """What each string of left tau right becomes; None where one string has two readings."""
        out: dict[str, str] = {}
        for a, (x, y), b in product(self.left, self.tau.items(), self.right):
            if out.setdefault(a + x + b, a + y + b) != a + y + b:
                return None
        return out

    def lowered(self, text: Column) -> Column | None:
        """The rule in native functions, or None where that isn't known to give the same result.

        Several strings are replaced one after the other only where no result can take part in a later match: results
        share no character with other strings, and of empty results, which join their neighbours, only the last
        replacement may have one.
        """
        found = self.patterns()
        if not found:
            return None
        for p, q in product(found, found):
            if not p or (p != q and p in q) or any(p[-n:] == q[:n] for n in range(1, min(len(p) - 1, len(q)) + 1)):
                return None
        if all(len(p) == 1 and len(x) <= 1 for p, x in found.items()):
            in_order = sorted(found, key=lambda p: not found[p])  # characters without a counterpart are deleted
            out = F.translate(text, "".join(in_order), "".join(found[p] for p in in_order))
        elif len(found) == 1 or (sum(not x for x in found.values()) <= 1 and not any(set(x) & set(q) for p, x in found.items() for q in found if q != p)):
            out = text
            for p in sorted(found, key=lambda p: not found[p]):
                out = F.replace(out, F.lit(p), F.lit(found[p]))
        else:
            return None
        if self.sigma is not None:
            try:
                known = self.sigma.decode("ascii")
            except UnicodeDecodeError:
                return None
            quote = lambda s: "".join(f"\\x{{{ord(c):x}}}" for c in s)
            every = "|".join([quote(p) for p in found] + ([f"[{quote(known)}]"] if known else []))
            out = F.when(F.regexp_replace(text, every, "") == "", out)
        return out

    def apply(self, text: Column, lower: bool = True) -> Column:
        native = self.lowered(text) if lower else None
        return self.kernel(text) if native is None else native

    def kernel(self, text: Column) -> Column:
        """The rule by its machine, for any rule."""
        if session := SparkSession.getActiveSession():
            text_batches(session)  # whole texts are large rows
        return self.function()(text)

    def function(self, memo_bytes: int = 1 << 26) -> Callable[[Column], Column]:
        """The rule as a function of a string column; pieces that come again are looked up, up to memo_bytes of them.

        A result that is no UTF-8, which rules over single bytes can make, is null.
        """
        kernel = Kernel(self.machine())
        symbols = set(spell(self.sigma)) if self.sigma is not None else set(range(1, 257))
        cut = _cut_bytes(any_of([transducer(a, b) for a, b in self.tau.items()]), [any_of([acceptor(x) for x in c]) for c in (self.left, self.right)], symbols)
        split = re.compile(b"([" + re.escape(cut) + b"]+)") if cut else None
        memo: dict[bytes, bytes | None] = {}
        held = [0]

        def block(rows: list) -> list:
            step = 2 if split else 1  # odd parts are cut bytes, which copy themselves
            new = list({x for r in rows for x in r[::step] if x not in memo})
            fresh = dict(zip(new, (y for y, _ in kernel.run(new)), strict=True))
            out = []
            for r in rows:
                done = [x if i % step else (fresh[x] if x in fresh else memo[x]) for i, x in enumerate(r)]
                out.append(None if None in done else b"".join(done))
            for x, y in fresh.items():
                if len(x) <= 64:
                    memo[x] = y
                    held[0] += 200 + len(x) + len(y or b"")
            if held[0] > memo_bytes:
                memo.clear()
                held[0] = 0
            return out

        def run(texts: pa.Array) -> pa.Array:
            found: list = [[] if x.is_valid else None for x in texts]  # each text's rewritten windows
            todo: list[tuple[int, list[bytes]]] = []
            size = 0

            def flush() -> None:
                for (i, _), y in zip(todo, block([r for _, r in todo]), strict=True):
                    found[i].append(y)
                todo.clear()

            for i, x in enumerate(texts):
                for w in windows(x.as_py().encode(), split, BLOCK) if x.is_valid else ():
                    todo.append((i, split.split(w) if split else [w]))
                    size += len(w)
                    if size >= BLOCK or len(todo) >= 1000:
                        flush()
                        size = 0
            flush()
            return pa.array([None if x is None or None in x else utf8(b"".join(x)) for x in found], pa.string())

        return F.arrow_udf(run, "string")


def windows(text: bytes, split: re.Pattern | None, most: int) -> Iterator[bytes]:
    """text in parts that end with cut bytes, each of about `most` bytes, or longer where no cut byte comes."""
    at = 0
    while split and len(text) - at > most and (cut := split.search(text, at + most)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def utf8(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def best_output(text: Column, machine: Machine) -> Column:
    """Output and weight of the best path of text composed with a machine: a struct, with nulls where there is none.

    An output that is no UTF-8 is null beside its weight.
    """
    return best_output_function(machine)(text)


def best_output_function(machine: Machine) -> Callable[[Column], Column]:
    kernel = Kernel(machine)

    def run(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        found = iter(kernel.run([x.encode() for x in rows if x is not None]))
        out = []
        for x in rows:
            y, w = next(found) if x is not None else (None, INF)
            out.append({"output": None if y is None else utf8(y), "weight": None if w == INF else w})
        return pa.array(out, pa.struct([("output", pa.string()), ("weight", pa.float64())]))

    return F.arrow_udf(run, "output string, weight double")


def accepts(text: Column, machine: Machine) -> Column:
    """Whether an acceptor accepts the text."""
    return best_output(text, machine)["weight"].isNotNull()
