"""Adaptive context-mixing range coder for token ids, over many independent blocks at once.

An id is coded whole, in one step, under a mix of an order-0, an order-1 and an order-2 model (contexts: nothing, the id before,
the two before) and of a share for ids that are new to the block. The ids of a block are its symbols, numbered as they first come.

* Order 0 gives every symbol met so far a share by its number: what comes often comes early.
* Orders 1 and 2 each name the symbol that last followed their context, with a confidence: how often in a row it did.
* The shares of the mix stand in rows by both confidences; a row moves towards what came (order 2, order 1, a new id, order 0)
  each time it is used.

On the line from 0 to 1 << TOTAL first comes the share of new ids, then the symbols by number, each with its order-0 share and what
the other orders add to it. A new id follows in a second step under fixed shares of all ids, which fall with the id, as a
vocabulary made by merges numbers its commonest first. All of it is integer arithmetic, elementwise, so encoder and decoder agree
bit for bit. Every block starts from a fresh model.

A lane is a block; numpy steps through the lanes' ids together, so the cost of a step is shared by up to LANES blocks.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

LANES, BLOCK = 3072, 2048
#: Order-0 shares run from 0 to 1 << ORDER0, the mix's from 0 to 1 << MIX, their products to 1 << TOTAL; shares of new ids to 1 << FIRST.
ORDER0, MIX, FIRST = 12, 16, 22
TOTAL = ORDER0 + MIX
#: Order-0 shares are as 1 / (symbol + FLAT), first shares as 1 / (id + COMMON).
FLAT, COMMON = 10, 600
#: How far a row of the mix moves, a right shift.
SHIFT = 5
#: Slots of a lane for order 1 (a slot for each symbol) and for order 2 (contexts share slots by hash), as powers of two.
ONE, TWO = 11, 11
#: The range is at least 1 << BOTTOM wide before a step and at most 1 << WIDTH; words have WORD bits. No share is so small that a step
#: takes more than one word.
WORD, BOTTOM = 32, 29
WIDTH = WORD + BOTTOM


def _order0() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of symbols fall into classes (steps of a twelfth): the class of each; by class and symbol, cumulative shares; by class
    and share, the symbol."""
    of, cumulative, inverse = np.zeros(BLOCK + 1, np.int64), [], []
    low = 0
    while low <= BLOCK:
        high = min(max(low, low * 12 // 11), BLOCK)
        of[low : high + 1] = len(cumulative)
        n = max(high, 1)
        weights = (1 << 32) // (np.arange(n) + FLAT)
        shares = 1 + weights * ((1 << ORDER0) - n) // weights.sum()
        shares[0] += (1 << ORDER0) - shares.sum()
        line = np.full(BLOCK + 1, 1 << ORDER0)
        line[: n + 1] = np.append(0, np.cumsum(shares))
        cumulative.append(line)
        inverse.append(np.repeat(np.arange(n), shares))
        low = high + 1
    return of, np.concatenate(cumulative), np.concatenate(inverse)


def _firsts() -> np.ndarray:
    """Cumulative shares of all 65,536 ids."""
    weights = (1 << 40) // (np.arange(1 << 16) + COMMON)
    shares = 1 + weights * ((1 << FIRST) - (1 << 16)) // weights.sum()
    shares[0] += (1 << FIRST) - shares.sum()
    return np.append(0, np.cumsum(shares))


_CLASS, _SHARES, _SYMBOL = _order0()
_FIRSTS = _firsts()
#: A row of the mix holds the shares of order 2, order 1 and new ids in fields of 16 bits; order 0 has the rest. A field that nothing
#: moves up stays at 31 or more; their sum stays below 1 << MIX, as what a step adds is 8 short of what a full row gives up.
_FIELD, _FIELDS = (1 << 16) - 1, 0x0001_0001_0001
_GIVEN = _FIELDS * ((1 << 16 - SHIFT) - 1)
_STEP = (1 << 16 - SHIFT) - 8
#: What a step adds to a row, by what came: 1 if order 1 was right, 2 if order 2 was, 3 if both were, 4 for a new id.
_CAME = np.array([0, _STEP << 16, _STEP, _STEP, _STEP << 32])
#: A row at first, in hundredths by confidence 1 and 2.
_TRUST = (0, 30, 55, 75)


def _rows() -> np.ndarray:
    rows = []
    for one in _TRUST:
        for two in _TRUST:
            second = two
            first = (100 - second) * one // 100
            new = (100 - first - second) * 40 // 100
            rows.append(sum((40 + x * 650) << 16 * i for i, x in enumerate((second, first, new))))
    return np.array(rows)


class Model:
    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        # Slots hold symbol << 2 | confidence; an unused one expects what never came with confidence 0.
        self.base = np.stack([lane << ONE, (lanes << ONE) + (lane << TWO)])
        self.slots = np.full((lanes << ONE) + (lanes << TWO), (BLOCK - 1) << 2)
        self.rows, self.row = np.tile(_rows(), lanes), lane << 4
        self.one, self.two = np.zeros((2, lanes), np.int64)
        self.n = np.zeros(lanes, np.int64)  # symbols met
        self.line, self.turn = np.zeros((2, lanes), np.int64)  # where order 0's shares, and their symbols, for so many stand
        self.at, self.added = np.empty((2, 2, lanes), np.int64)

    def keep(self, lanes: int) -> None:
        """Go on with the first lanes alone."""
        for name in ("base", "row", "one", "two", "n", "line", "turn", "at", "added"):
            setattr(self, name, getattr(self, name)[..., :lanes].copy())

    def expect(self) -> None:
        """What orders 1 and 2 expect, and the shares of the mix on the line."""
        at, added = self.at, self.added
        at[0] = self.one
        np.multiply(self.one, 0x9E3779B1, out=at[1])
        at[1] ^= self.two
        at[1] &= (1 << TWO) - 1
        at += self.base
        held = self.slots.take(at)
        self.sure = held & 3
        held >>= 2
        self.symbols = held
        self.use = self.sure[0] << 2
        self.use += self.sure[1]
        self.use += self.row
        self.mix = mix = self.rows.take(self.use)
        np.right_shift(mix, 16 - ORDER0, out=added[0])
        np.left_shift(mix, ORDER0, out=added[1])
        added &= _FIELD << ORDER0
        self.old = mix >> 32
        self.fresh = self.old << ORDER0
        self.old += mix & _FIELD
        self.old += mix >> 16 & _FIELD
        np.subtract(1 << MIX, self.old, out=self.old)

    def find(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at a place on the line, and the lanes where it is new."""
        t -= self.fresh
        new = (t < 0).nonzero()[0]
        t[new] = 0
        # What the orders add stands behind a symbol's own share, order 1 before order 2.
        ends = self.symbols + 1
        ends += self.line
        ends = _SHARES.take(ends)
        ends *= self.old
        ends -= 1
        later = self.symbols[0] <= self.symbols[1]
        ends[1] += self.added[0] * later
        ends[0] += self.added[1] * ~later
        np.subtract(t, ends, out=ends)
        np.maximum(ends, 0, out=ends)
        np.minimum(ends, self.added, out=ends)
        t -= ends[0]
        t -= ends[1]
        t //= self.old
        t += self.turn
        symbol = _SYMBOL.take(t)
        symbol[new] = self.n[new]
        return symbol, new

    def share(self, symbol: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the symbol's share starts, and its size."""
        at = self.line + symbol
        start = _SHARES.take(at)
        at += 1
        size = _SHARES.take(at)
        size -= start
        size *= self.old
        self.hit = self.symbols == symbol
        more = self.added * self.hit
        size += more[0]
        size += more[1]
        start *= self.old
        start += self.fresh
        np.multiply(self.added, self.symbols < symbol, out=more)
        start += more[0]
        start += more[1]
        start[new] = 0
        size[new] = self.fresh[new]
        return start, size

    def learn(self, symbol: np.ndarray, new: np.ndarray) -> None:
        hit = self.hit.view(np.int8)
        came = hit[1] << 1
        came += hit[0]
        came[new] = 4
        mix = self.mix
        mix -= mix >> SHIFT & _GIVEN
        mix += _CAME.take(came)
        self.rows[self.use] = mix
        sure = self.sure
        np.minimum(sure, 2, out=sure)
        sure *= hit
        sure += (symbol << 2) + 1
        self.slots[self.at] = sure
        n = self.n[new] + 1
        self.n[new] = n
        n = _CLASS.take(n)
        self.line[new] = n * (BLOCK + 1)
        self.turn[new] = n << ORDER0
        self.two, self.one = self.one, symbol


def _grouped(items: list, lengths: list[int], run) -> list:
    """run over up to LANES blocks at a time, longest first; results in the order of items."""
    order = sorted(range(len(items)), key=lambda i: -lengths[i])
    made: dict[int, object] = {}
    for low in range(0, len(order), LANES):
        own = order[low : low + LANES]
        made |= zip(own, run([items[i] for i in own], [lengths[i] for i in own]), strict=True)
    return [made[i] for i in range(len(items))]


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The payload of each block (1 to BLOCK ids below 65,536; a larger id is an error)."""
    if any(int(b.max()) >> 16 for b in blocks):
        raise ValueError("an id needs more than 16 bits")
    if any(len(b) > BLOCK for b in blocks):
        raise ValueError("a block is too long")
    return _grouped(blocks, list(map(len, blocks)), _encode)


def _symbols(ids: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """Ids numbered as they first come. scratch: 65,536 places, of any content."""
    ids, places = ids.astype(np.int64), np.arange(len(ids))
    scratch[ids[::-1]] = places[::-1]  # of equal ids the last written is the first
    first = scratch.take(ids)
    return (np.cumsum(first == places) - 1).take(first)


def _encode(blocks: list[np.ndarray], lengths: list[int]) -> list[bytes]:
    lanes, steps = len(blocks), lengths[0]
    symbols, ids = np.zeros((2, steps, lanes), np.uint16)
    scratch = np.zeros(1 << 16, np.int64)
    for i, b in enumerate(blocks):
        ids[: len(b), i] = b
        symbols[: len(b), i] = _symbols(b, scratch)
    model = Model(lanes)
    low, width = np.zeros(lanes, np.int64), np.full(lanes, 1 << WIDTH)
    size = 2 * steps + 1
    words = np.zeros(lanes * size, np.int64)  # with carries, which are added in later
    at = np.arange(lanes) * size
    ended = np.zeros(lanes, np.int64)
    bottom, kept, left = 1 << BOTTOM, (1 << BOTTOM) - 1, Counter(lengths)

    def emit(which):
        own, place = low.take(which), at.take(which)
        words[place] = own >> BOTTOM
        own &= kept
        own <<= WORD
        low[which] = own
        place += 1
        at[which] = place
        width[which] = width.take(which) << WORD

    for step in range(steps):
        symbol = symbols[step, :lanes].astype(np.int64)
        new = (symbol == model.n).nonzero()[0]
        model.expect()
        start, share = model.share(symbol, new)
        width >>= TOTAL
        start *= width
        low += start
        width *= share
        emit((width < bottom).nonzero()[0])
        if len(new):
            own = ids[step].take(new).astype(np.int64)
            start = _FIRSTS.take(own)
            unit = width.take(new) >> FIRST
            low[new] += unit * start
            own += 1
            unit *= _FIRSTS.take(own) - start
            width[new] = unit
            emit(new[unit < bottom])
        model.learn(symbol, new)
        if done := left[step + 1]:  # one word names a place in the range, which is no narrower than its unit; zeros follow it
            lanes -= done
            words[at[lanes:]] = (low[lanes:] + kept) >> BOTTOM
            ended[lanes : lanes + done] = at[lanes:] + 1
            low, width, at = low[:lanes], width[:lanes], at[:lanes]
            model.keep(lanes)
    out = []
    for i, end in enumerate(ended):
        own = words[i * size : end]
        over = np.flatnonzero(own >> WORD)
        while len(over):  # carries run towards the first word
            own[over] -= 1 << WORD
            over -= 1
            own[over] += 1
            over = over[own[over] >> WORD > 0]
        out.append(own.astype("<u4").tobytes())
    return out


def decode(payloads: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of each block, as uint16."""
    return _grouped(payloads, lengths, _decode)


def _decode(payloads: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    lanes, steps = len(payloads), lengths[0]
    size = max(len(p) // 4 for p in payloads) + 3
    words = np.zeros((lanes, size), np.int64)
    for i, p in enumerate(payloads):
        words[i, : len(p) // 4] = np.frombuffer(p, "<u4")
    model = Model(lanes)
    # The range starts with a word and BOTTOM bits of the next; so words are read from there on.
    code = words[:, 0] << BOTTOM
    words = (words[:, :-1] << BOTTOM & (1 << WORD) - 1) + (words[:, 1:] >> WORD - BOTTOM)
    code += words[:, 0] & (1 << BOTTOM) - 1
    size -= 1
    at = np.arange(lanes) * size + 1
    words = words.ravel()
    width = np.full(lanes, 1 << WIDTH)
    bottom, top, left = 1 << BOTTOM, (1 << TOTAL) - 1, Counter(lengths)
    symbols = np.zeros((steps, lanes), np.uint16)
    met = np.zeros(lanes << ONE, np.uint16)  # ids by symbol

    def fill(which):
        place = at.take(which)
        own = code.take(which) << WORD
        own += words.take(place)
        code[which] = own
        place += 1
        at[which] = place
        width[which] = width.take(which) << WORD

    for step in range(steps):
        model.expect()
        width >>= TOTAL
        t = code // width
        np.minimum(t, top, out=t)
        symbol, new = model.find(t)
        start, share = model.share(symbol, new)
        start *= width
        np.subtract(code, start, out=code)
        width *= share
        fill((width < bottom).nonzero()[0])
        if len(new):
            unit = width.take(new) >> FIRST
            own = code.take(new)
            t = own // unit
            np.minimum(t, (1 << FIRST) - 1, out=t)
            first = _FIRSTS.searchsorted(t, "right") - 1
            met[model.base[0].take(new) + symbol.take(new)] = first
            start = _FIRSTS.take(first)
            code[new] = own - unit * start
            first += 1
            unit *= _FIRSTS.take(first) - start
            width[new] = unit
            fill(new[unit < bottom])
        model.learn(symbol, new)
        symbols[step, :lanes] = symbol
        if done := left[step + 1]:
            lanes -= done
            code, width, at = code[:lanes], width[:lanes], at[:lanes]
            model.keep(lanes)
    return [met[i << ONE : i + 1 << ONE].take(symbols[:n, i]) for i, n in enumerate(lengths)]
