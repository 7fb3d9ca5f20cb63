"""Token ids by the tokenizers library, with each distinct word encoded once.

Both vocabularies split a text into words before they merge, and no merge crosses a word, so a text's ids are those of its
chunks one after another. A chunk stands between white space; a final comma or full stop after a letter is one of its own. Chunks are
cut, looked up and replaced by their ids in numpy, all of a call at once; a worker keeps a hash table of chunks it has met, of
bounded size (it is emptied when full). A chunk is known by its first and last eight bytes and its length, a longer one than these
cover also by a 64-bit hash. Texts that hold one of the tokenizer's special strings are encoded whole.

A new chunk of Latin letters, digits and ASCII signs is split here as the tokenizer's pattern splits it and goes straight to
the tokenizer's merges, many chunks in one call; any other chunk passes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import regex
import xxhash

from relictum.llm.windows import mix

#: Chunks kept by a worker and their ids; the longest chunk kept, in bytes.
WORDS, IDS, LONGEST = 1_200_000, 8_000_000, 48
#: New chunks encoded in one call.
TOGETHER = 2_000
#: Words as byte-level BPE splits them (public GPT-2 pattern, a fixed value).
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def place(name: str, folder: str | None = None) -> str:
    """The vocabulary's file: in `folder`, or where the installed public_tokenizers package has it."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def spaced(text: str) -> bool:
    """Whether white space stands together so that it is not one word for each character."""
    if "  " in text or "\n " in text or " \n" in text or "\n\n\n" in text or text.endswith(("\n\n", " ")):
        return True
    return not text.replace("\n", "").isprintable() and _SPACED(text) is not None


_SPACED = re.compile(r"\s[^\S \n]|[^\S \n]\s").search


def separated(text: str) -> bool:
    """Whether a control sign stands in the text that some hold for white space."""
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


#: Latin letters but for the one whose lower case is two characters, and ASCII signs but for the apostrophe, which both
#: patterns treat by itself; for use in brackets.
_LATIN, _SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f", r"!-&(-/:-@\[-`{-~"


def _stands() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from
    U+0100 on in their order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_STANDS = _stands()
_MARK = _STANDS[127]
#: Their code points by byte; a line feed stays, as it parts words.
_SPELLED = np.array([10 if b == 10 else ord(_STANDS[b]) for b in range(256)], "<u4")


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_GAP = np.isin(np.arange(256), [10, 32])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_STOP = np.isin(np.arange(256), [44, 46])
#: By number of bytes, up to 8: those bytes of a little-endian word.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_KIND = np.uint64((1 << 17) - 1)


class Table:
    """Chunks and their ids. A row: first eight bytes, last eight, hash of a longer chunk, and start and number of its ids and its kind
    (length and whether a space stands before) in one word. Places are found by open addressing."""

    def __init__(self, bits: int = 22):
        self.bits = bits
        self.rows = np.zeros((WORDS + 1, 4), np.uint64)
        self.pool = np.zeros(IDS, "<u4")
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.n = self.used = 0

    def place(self, key: np.ndarray) -> np.ndarray:
        h = mix(key[0] * np.uint64(0x9E3779B97F4A7C15) ^ mix(key[1] + key[2] * np.uint64(3)) ^ key[3] * np.uint64(0xC2B2AE3D27D4EB4F))
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """key: four lines (first, last, hash, kind). Start and number of each chunk's ids; number -1 for a new chunk."""
        n = key.shape[1]
        start, count = np.zeros(n, np.int64), np.full(n, -1)
        live, at = None, self.place(key)
        while live is None or len(live):
            own = key if live is None else key[:, live]
            slot = self.slots.take(at)
            row = self.rows.take(slot, axis=0)
            there = slot >= 0
            same = there & (row[:, 0] == own[0]) & (row[:, 1] == own[1]) & (row[:, 2] == own[2]) & ((row[:, 3] & _KIND) == own[3])
            hit = np.flatnonzero(same)
            to = hit if live is None else live[hit]
            meta = row[hit, 3]
            start[to] = meta >> np.uint64(33)
            count[to] = meta >> np.uint64(17) & np.uint64(0xFFFF)
            on = np.flatnonzero(there & ~same)
            live, at = (on if live is None else live[on]), (at[on] + 1) & (1 << self.bits) - 1
        return start, count

    def store(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Put ids into the pool; their starts and numbers."""
        count = np.array([len(x) // 4 for x in ids], np.int64)
        start = self.used + np.cumsum(count) - count
        flat = np.frombuffer(b"".join(ids), "<u4")
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], flat, np.zeros(len(flat) + IDS // 4, "<u4")])
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return start, count

    def add(self, key: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        """Distinct new chunks."""
        m = key.shape[1]
        if self.n + m > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((m, 4), np.uint64)])
        own = self.rows[self.n : self.n + m]
        own[:, :3] = key[:3].T
        own[:, 3] = start.astype(np.uint64) << np.uint64(33) | count.astype(np.uint64) << np.uint64(17) | key[3]
        at, number = self.place(key), np.arange(self.n, self.n + m, dtype=np.int32)
        self.n += m
        while len(at):
            free = np.flatnonzero(self.slots[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.slots[at[won]] = number[won]
            rest = np.ones(len(at), bool)
            rest[won] = False
            at, number = (at[rest] + 1) & (1 << self.bits) - 1, number[rest]


class Encoder:
    """A byte-level text is cut at a line feed, which is a word of its own, and before a single space; a word-level text at any white
    space; texts where that would not hold (`odd`) are split by the tokenizer's own pattern instead."""

    def __init__(self, name: str, folder: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(place(name, folder))
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes = name.startswith("byte")
        self.odd = spaced if self.bytes else separated
        self.split = regex.compile(BYTE_PATTERN if self.bytes else r"[^\x20\x09-\x0D]+").findall
        # The vocabulary's merges alone, for words that are split and spelled here.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        # Chunks are parted by a byte that no plain chunk holds and that is one id.
        (self.mark_id,) = self.merges.encode(_MARK, add_special_tokens=False).ids
        own = _LATIN + _SIGNS + "0-9"
        self.plain = re.compile(f"[{own}]+").fullmatch
        self.parts = re.compile(f"[{_LATIN}]+|[0-9]{'+' * self.bytes}|[{_SIGNS}]+").findall
        self.table = Table()
        self.known: dict[str, bytes] = {}  # words of odd texts

    def ids(self, text: str | None) -> np.ndarray:
        """uint32 ids of the text (null: empty), without special tokens added."""
        return self.batch([text])[0]

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """ids of each text; new chunks of all texts are encoded together."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, odd = [], []
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, np.uint32)
            elif any(x in text for x in self.special):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                (odd if self.odd(text) else plain).append(i)
        for i, ids in zip(plain, self.cut([texts[i].encode() for i in plain]), strict=True):
            out[i] = ids
        if odd:
            split = [self.split(texts[i]) for i in odd]
            new = set().union(*split).difference(self.known)
            if len(self.known) + len(new) > WORDS:
                self.known.clear()
                new = set().union(*split)
            self.known |= self.learn(new, "")
            for i, words in zip(odd, split, strict=True):
                out[i] = np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4")
            for w in new:
                if len(w) > LONGEST:
                    del self.known[w]
        return out

    def cut(self, raws: list[bytes]) -> list[np.ndarray]:
        """ids of plain texts. They stand in one buffer, a line feed between them."""
        if not raws:
            return []
        text = b"\n" + b"\n".join(raws) + b"\n"
        buffer = np.frombuffer(bytes(7) + text + bytes(8), np.uint8)  # so that eight bytes can be read anywhere
        own = buffer[7:-8]
        ends = np.cumsum([len(r) + 1 for r in raws])  # of each text, the line feed behind it
        gap = (_GAP if self.bytes else _SPACE)[own]
        inside = ~gap
        last = inside & np.append(gap[1:], True)
        stop = last & _STOP[own]
        stop[1:] &= _LETTER[own[:-1]]
        first = stop.copy()
        first[1:] |= inside[1:] & gap[:-1]
        last[:-1] |= stop[1:]
        if self.bytes:  # a line feed is a word, but for those between texts
            line = own == 10
            line[0] = False
            line[ends] = False
            first |= line
            last |= line
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        length = last + 1 - first
        words = np.ndarray((len(buffer) - 7,), "<u8", buffer.data, strides=(1,))
        short = np.minimum(length, 8)
        key = np.zeros((4, len(first)), np.uint64)
        key[0] = words[first + 7] & _LOW[short]
        key[1] = words[last] >> (8 * (8 - short)).astype(np.uint64)
        long = np.flatnonzero(length > 16)
        one = xxhash.xxh3_64_intdigest
        key[2, long] = np.array([one(text[a : b + 1]) for a, b in zip(first[long].tolist(), last[long].tolist())], np.uint64)
        before = own[first - 1] == 32 if self.bytes else np.zeros(len(first), bool)
        key[3] = np.minimum(length, 0xFFFF) * 2 + before
        table = self.table
        if table.n > WORDS - len(first) // 4 or table.used > IDS - len(first):
            table.clear()
        start, count = table.find(key)
        lost = np.flatnonzero(count < 0)
        if len(lost):
            number: dict[tuple[bytes, bool], int] = {}
            which = [number.setdefault((text[a : b + 1], s), len(number)) for a, b, s in zip(first[lost].tolist(), last[lost].tolist(), before[lost].tolist())]
            new = [(w.decode(), s) for w, s in number]
            known = [self.learn({w for w, s in new if s == side}, " " if side else "") for side in (False, True)]
            s, c = table.store([known[side][w] for w, side in new])
            start[lost], count[lost] = s[which], c[which]
            example = np.empty(len(number), np.int64)
            example[which] = lost
            kept = np.flatnonzero(length[example] <= LONGEST)
            table.add(key[:, example[kept]], s[kept], c[kept])
        upto = np.cumsum(count)
        ids = table.pool[np.repeat(start - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)]
        cuts = np.append(0, upto)[np.searchsorted(first, ends)]
        return [ids[a:b] for a, b in zip(np.append(0, cuts[:-1]), cuts)]

    def learn(self, new: set[str], before: str) -> dict[str, bytes]:
        """ids of new chunks that stand after `before`."""
        known: dict[str, bytes] = {}
        rest = set(new)
        letters = [w for w in rest if w.isascii() and w.isalpha()]
        lead = _STANDS[32] if before else ""
        for at in range(0, len(letters), TOGETHER):
            own = letters[at : at + TOGETHER]
            text = lead + f"\n{_MARK}\n{lead}".join(own)
            self.merge(own, text if self.bytes else text.lower(), known)
        rest.difference_update(letters)
        plain = [w for w in rest if self.plain(w)]
        for at in range(0, len(plain), TOGETHER):
            own = plain[at : at + TOGETHER]
            text = "\n\x7f\n".join([before + "\n".join(self.parts(w)) for w in own])
            text = text if self.bytes else self.tokenizer.normalizer.normalize_str(text).replace(" ", "\n")
            self.merge(own, _SPELLED[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le"), known)
        rest.difference_update(plain)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([before + w for w in rest], add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()
        return known

    def merge(self, chunks: list[str], text: str, known: dict[str, bytes]) -> None:
        """Plain chunks by the tokenizer's merges alone. text: their words, spelled in the characters that stand for their
        bytes, a line each, with the mark between chunks."""
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        stops = np.append(np.flatnonzero(ids == self.mark_id), len(ids)) * 4
        if len(stops) != len(chunks):
            raise RuntimeError("chunks were parted otherwise than by their marks")
        raw, stops = ids.tobytes(), stops.tolist()
        known.update(zip(chunks, [raw[a:b] for a, b in zip([0, *[x + 4 for x in stops]], stops)]))


@lru_cache(4)
def encoder(name: str, folder: str | None = None) -> Encoder:
    """One encoder for each Python worker, so that its table lives on between tasks."""
    return Encoder(name, folder)


def groups(texts: list[str | None], size: int = 600_000):
    """Texts in their order, in lists of about `size` characters."""
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text or "")
        if n > size:
            yield held
            held, n = [], 0
    if held:
        yield held
