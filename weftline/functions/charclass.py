"""Acceptors of single characters, labels being bytes plus one."""

from __future__ import annotations

from weftline.functions.machine import Machine


def byte_range(*ranges: tuple[int, int]) -> Machine:
    """Any one byte of the ranges (both ends included)."""
    out = Machine()
    out.add_states(2)
    out.set_start(0)
    out.set_final(1)
    for lo, hi in ranges:
        for b in range(lo, hi + 1):
            out.add_arc(0, b + 1, b + 1, 0.0, 1)
    return out


def any_byte() -> Machine:
    return byte_range((0, 255))


def alpha() -> Machine:
    return byte_range((65, 90), (97, 122))


def digit() -> Machine:
    return byte_range((48, 57))


def sigma_star() -> Machine:
    """Every byte string."""
    out = Machine()
    out.set_start(out.add_state())
    out.set_final(0)
    for b in range(256):
        out.add_arc(0, b + 1, b + 1, 0.0, 0)
    return out


#: fixed values: lead bytes of sequences of 1 to 4 bytes; every continuation byte is 80 to BF
LEADS = ((0x00, 0x7F), (0xC2, 0xDF), (0xE0, 0xEF), (0xF0, 0xF4))
CONTINUATION = (0x80, 0xBF)


def utf8_char() -> Machine:
    """One lead byte with its number of continuation bytes: all of UTF-8 and some sequences that it forbids.

    Each length has its own chain of states, so there are 8: start, end and 1 + 2 + 3 between.
    """
    out = Machine()
    out.add_states(2)
    out.set_start(0)
    out.set_final(1)

    def arcs(src: int, lo: int, hi: int, dst: int) -> None:
        for b in range(lo, hi + 1):
            out.add_arc(src, b + 1, b + 1, 0.0, dst)

    for more, (lo, hi) in enumerate(LEADS):
        states = [out.add_state() for _ in range(more)] + [1]
        arcs(0, lo, hi, states[0])
        for a, b in zip(states, states[1:], strict=False):
            arcs(a, *CONTINUATION, b)
    return out
