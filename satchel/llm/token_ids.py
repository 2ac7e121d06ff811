"""Token ids of whole texts under a public byte-level BPE vocabulary: numpy cuts texts into pre-tokens, the library merges each different one once."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import regex
from tokenizers import Tokenizer

from .token_counts import PRE_TOKEN, byte_letters
from .tokens import U, mix

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Code points that are cut and looked up at once, unless a text has no space to cut it at.
AT_ONCE = 1_000_000
#: Different pre-tokens that a worker remembers; beyond that it starts anew. Bounds memory, not results.
REMEMBERED = 600_000
#: Longer pre-tokens are merged where they stand and never remembered.
LONG = 64
#: What the pattern splits off after an apostrophe (fixed values).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, as the pattern has it."""
    points = np.array([i for i in range(0x110000) if not 0xD800 <= i < 0xE000])
    every = "".join(map(chr, points.tolist()))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start() : m.end()]] = kind
    return out


def cut(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in texts laid end to end; starts: where the texts begin (increasing, none empty).

    A pre-token is a run of one class. The last white space before another run stands alone, or joins that run if it is a space; an apostrophe that begins
    a pre-token takes an ending with it.
    """
    n = len(points)
    kind = classes()[points]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    first = np.zeros(n + 3, bool)
    first[starts], first[n:] = True, True
    after = np.flatnonzero(new[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:n]) + 1
    new[after - 1] = True
    new[after[points[after - 1] == 0x20]] = False
    mark = np.flatnonzero(new & (points == 0x27))
    padded = np.append(points, [0, 0, 0])
    new = np.append(new, [True, True, True])
    for ending in ENDINGS:
        hit = mark
        for j, c in enumerate(ending, 1):
            hit = hit[(padded[hit + j] == ord(c)) & ~first[hit + j]]
        for j in range(1, len(ending) + 1):
            new[hit + j] = False
        new[hit + len(ending) + 1] = True
    return np.flatnonzero(new[:n])


@functools.cache
def _marks() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=U) * U(0x9E3779B97F4A7C15))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD6E8FEB86659FD93
    up, down = np.full(n, U(base)), np.full(n, U(pow(base, -1, 2**64)))
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Encoder:
    """texts -> ids, as the library gives them without added special tokens."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.len, self.flat = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def merged(self, token: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(token.encode().decode("latin-1").translate(self.letters))]

    def _learn(self, names: np.ndarray, tokens: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.forget()
        ids = list(map(self.merged, tokens))
        size = np.array([len(x) for x in ids], np.int64)
        known, at, n = np.append(self.known, names), np.append(self.at, len(self.flat) + np.cumsum(size) - size), np.append(self.len, size)
        self.flat = np.append(self.flat, np.array([i for x in ids for i in x], np.uint32))
        order = np.argsort(known, kind="stable")
        self.known, self.at, self.len = known[order], at[order], n[order]

    def _find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table of what is known, and which names are there."""
        if not len(self.known):
            return np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        at = np.minimum(np.searchsorted(self.known, names), len(self.known) - 1)
        return at, self.known[at] == names

    def together(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts without special strings, AT_ONCE code points or so in all."""
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum():
            return [np.zeros(0, np.uint32)] * len(texts)
        every = "".join(texts)
        points = np.frombuffer(every.encode("utf-32-le"), np.uint32)
        begins = cut(points, (np.cumsum(sizes) - sizes)[sizes > 0])
        ends = np.append(begins[1:], len(points))
        up, down = _powers(1 << int(len(points)).bit_length())
        with np.errstate(over="ignore"):
            total = np.zeros(len(points) + 1, U)
            np.cumsum(_marks()[points] * up[: len(points)], out=total[1:])
            names = mix((total[ends] - total[begins]) * down[begins])
        names, first, of = np.unique(names, return_index=True, return_inverse=True)
        spelled = lambda k: every[begins[k] : ends[k]]
        long = ends - begins > LONG
        at, there = self._find(names)
        unknown = np.flatnonzero(~there & ~long[first])
        if len(unknown):
            if len(self.known) > REMEMBERED:
                unknown = np.flatnonzero(~long[first])  # all of this slice, since the rest is forgotten
            self._learn(names[unknown], [spelled(k) for k in first[unknown]])
            at, there = self._find(names)
        n = np.where(there, self.len[at] if len(self.len) else 0, 0)[of]
        begin = (self.at[at] if len(self.at) else np.zeros(len(names), np.int64))[of]
        own = [self.merged(spelled(k)) for k in np.flatnonzero(long)]
        n[long] = size = np.array([len(x) for x in own], np.int64)
        begin[long] = len(self.flat) + np.cumsum(size) - size
        flat = np.append(self.flat, np.array([i for x in own for i in x], np.uint32)) if own else self.flat
        after = np.cumsum(n)
        ids = flat[np.repeat(begin - (after - n), n) + np.arange(after[-1])]
        upto = np.append(0, after)[np.searchsorted(begins, np.append(0, np.cumsum(sizes)))]
        return [ids[a:b] for a, b in zip(upto[:-1], upto[1:])]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text of any length: special strings by the library, long texts cut before spaces that follow a letter."""
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        parts, begin = [], 0
        while len(text) - begin > AT_ONCE:
            end = text.find(" ", begin + AT_ONCE)
            while end > 0 and not text[end - 1].isalpha():
                end = text.find(" ", end + 1)
            if end < 0:
                break
            parts.append(self.together([text[begin:end]])[0])
            begin = end
        return np.concatenate([*parts, self.together([text[begin:]])[0]])

    def all_ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text in turn."""
        held, size = [], 0
        for text in texts:
            if len(text) > AT_ONCE or any(s in text for s in self.special):
                yield from self.together(held)
                held, size = [], 0
                yield self.encode(text)
                continue
            held.append(text)
            size += len(text)
            if size >= AT_ONCE:
                yield from self.together(held)
                held, size = [], 0
        yield from self.together(held)


@functools.cache
def encoder(path: str) -> Encoder:
    """One a Python worker."""
    return Encoder(path)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text by the pattern itself, to hold cut() against."""
    return PRE_TOKEN.findall(text)
