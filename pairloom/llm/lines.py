"""Statistics of the lines of many texts at once, on the UTF-8 bytes.

A text is cut at line feeds. Every byte has a class; one histogram of (line, class) gives most
statistics of all lines, and the runs of letters give the words. Nothing loops over characters,
words or lines in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Classes of bytes.
LOWER, UPPER, DIGIT, BLANK, TAB, PIPE, STOP, COMMA, SEMI, QUOTE, SYMBOL, MARK, LETTER2, OTHER2, TAIL, END = range(16)


def _classes() -> np.ndarray:
    out = np.full(256, SYMBOL, np.uint8)
    for chars, kind in (
        (b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"0123456789", DIGIT), (b" \r\x0b\x0c", BLANK), (b"\t", TAB), (b"|", PIPE),
        (b".!?", STOP), (b",", COMMA), (b";:", SEMI), (b"'\"()[]-", QUOTE), (b"<>", MARK), (b"\n", END),
    ):
        out[np.frombuffer(chars, np.uint8)] = kind
    out[0x80:0xC0] = TAIL
    out[0xC0:] = OTHER2
    out[0xC3:0xD4] = LETTER2  # leading bytes of Latin, Greek and Cyrillic letters
    return out


CLASS = _classes()
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
#: Multiplier of the word hash (fixed value, the 64-bit FNV prime).
PRIME = np.uint64(1099511628211)


def word_key(word: str) -> int:
    """The hash of a lower-cased word, as :func:`measure` computes it of the words in a text."""
    h = 0
    for byte in word.lower().encode():
        h = ((h ^ byte) * int(PRIME)) & (2**64 - 1)
    return h


@dataclass(frozen=True)
class Words:
    """Known words: sorted hashes, the number of each, and the longest length in bytes."""

    keys: np.ndarray
    ids: np.ndarray
    longest: int

    @classmethod
    def of(cls, words: list[str]) -> Words:
        known = sorted({w.lower() for w in words if w})
        keys = np.array([word_key(w) for w in known], np.uint64)
        order = np.argsort(keys)
        return cls(keys[order], (order + 1).astype(np.int32), max((len(w.encode()) for w in known), default=0))

    def __len__(self) -> int:
        return len(self.keys)


@dataclass
class Lines:
    """Of each line that is not blank: the text it is of and its statistics."""

    doc: np.ndarray
    chars: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    letters: np.ndarray
    titled: np.ndarray
    common: np.ndarray
    gaps: np.ndarray
    first: np.ndarray
    second: np.ndarray
    last: np.ndarray
    blank_before: np.ndarray
    stutter: np.ndarray
    pair_line: np.ndarray
    pairs: np.ndarray


def measure(data: np.ndarray, offsets: np.ndarray, known: Words) -> Lines:
    """Statistics of the lines of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    base = offsets[0]
    b = data[base : offsets[-1]]
    offsets = (offsets - base).astype(np.int64)
    kind = CLASS[b]
    # Full blocks (U+2588) black out words of any text; they count as quotes do.
    block = np.flatnonzero((b[:-2] == 0xE2) & (b[1:-1] == 0x96) & (b[2:] == 0x88)) if len(b) > 2 else np.zeros(0, np.int64)
    kind[block] = QUOTE
    breaks = np.flatnonzero(kind == END)
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    starts = np.unique(np.concatenate([begins, breaks + 1]))
    starts = starts[starts < len(b)]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Lines(none, none, np.zeros((0, 16), np.int64), *[none] * 12)
    ends = np.append(starts[1:], len(b))
    line = np.repeat(np.arange(len(starts), dtype=np.int32), ends - starts)
    counts = np.bincount(line.astype(np.int64) * 16 + kind, minlength=len(starts) * 16).reshape(-1, 16)
    seen = counts.sum(1) - counts[:, BLANK] - counts[:, TAB] - counts[:, END] > 0

    blankish = (kind == BLANK) | (kind == TAB)
    solid = np.flatnonzero(~blankish & (kind != END))
    head = solid[np.searchsorted(solid, starts[seen])]
    tail = solid[np.searchsorted(solid, ends[seen]) - 1]
    # A gap: two or more blanks within a line.
    gap_at = np.flatnonzero(blankish[1:-1] & blankish[:-2] & ~blankish[2:] & (kind[2:] != END)) + 1 if len(b) > 2 else np.zeros(0, np.int64)
    inner = np.zeros(len(starts), np.int64)
    inner[seen] = head
    gap_line = line[gap_at]
    gap_at_ok = gap_at > inner[gap_line]
    gaps = np.bincount(gap_line[gap_at_ok], minlength=len(starts))

    letter = (kind == LOWER) | (kind == UPPER) | (kind == LETTER2)
    letter[1:] |= (kind[1:] == TAIL) & (kind[:-1] == LETTER2)
    fresh = letter.copy()
    fresh[1:] &= ~letter[:-1]
    fresh[offsets[1:-1][offsets[1:-1] < len(b)]] |= letter[offsets[1:-1][offsets[1:-1] < len(b)]]
    stop = letter.copy()
    stop[:-1] &= ~letter[1:]
    cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] <= len(b))] - 1
    stop[cut] |= letter[cut]
    word_at, word_end = np.flatnonzero(fresh), np.flatnonzero(stop) + 1
    size = word_end - word_at
    word_line = line[word_at]
    words = np.bincount(word_line, minlength=len(starts))
    letters = np.bincount(word_line, weights=size, minlength=len(starts))
    after = np.minimum(word_at + 1, len(b) - 1)
    title = (kind[word_at] == UPPER) & (size > 1) & (kind[after] != UPPER)
    titled = np.bincount(word_line[title], minlength=len(starts))

    ident = np.zeros(len(word_at), np.int32)
    if known.longest:
        short = np.flatnonzero(size <= known.longest)
        at, n = word_at[short], size[short]
        h = np.zeros(len(short), np.uint64)
        before = np.zeros(len(short), np.uint8)
        for i in range(known.longest):
            live = n > i
            if not live.any():
                break
            raw = b[np.minimum(at + i, len(b) - 1)]
            byte = FOLD[raw]
            byte = np.where((before == 0xC3) & (raw >= 0x80) & (raw <= 0x9E), raw + 0x20, byte)
            h = np.where(live, (h ^ byte.astype(np.uint64)) * PRIME, h)
            before = raw
        place = np.minimum(np.searchsorted(known.keys, h), len(known) - 1)
        hit = known.keys[place] == h
        ident[short[hit]] = known.ids[place[hit]]
    common = np.bincount(word_line[ident > 0], minlength=len(starts))
    follow = np.flatnonzero(word_line[1:] == word_line[:-1])
    pairs = ident[follow].astype(np.int64) * (len(known) + 1) + ident[follow + 1]

    first_byte, last_byte = FOLD[b[word_at]], b[word_end - 1]
    echo = (size[1:] == size[:-1]) & (first_byte[1:] == first_byte[:-1]) & (last_byte[1:] == last_byte[:-1]) & (word_line[1:] == word_line[:-1])
    stutter = np.bincount(word_line[1:][echo], minlength=len(starts))

    doc = np.searchsorted(offsets, starts, side="right") - 1
    number = np.cumsum(seen) - 1
    gone = np.concatenate([[True], ~seen[:-1]])
    chars = counts.sum(1) - counts[:, TAIL] - counts[:, END] - counts[:, BLANK] - counts[:, TAB]
    second = np.minimum(head + 1, len(b) - 1)
    return Lines(
        doc[seen], chars[seen], counts[seen], words[seen], letters[seen], titled[seen], common[seen], gaps[seen],
        kind[head] | (b[head].astype(np.int64) << 8), kind[second] | (b[second].astype(np.int64) << 8), kind[tail] | (b[tail].astype(np.int64) << 8),
        gone[seen], stutter[seen], number[word_line[follow]], pairs,
    )


#: The features of a line; each is a small number below :data:`SIZES`.
FEATURES = ("words", "length", "word_length", "digits", "symbols", "foreign", "common", "fluency", "end", "begin", "columns", "commas", "titled", "capitals", "repeats", "spaced", "stutter", "copies", "blanks", "stops")
SIZES = (8, 7, 7, 8, 8, 6, 8, 8, 6, 8, 6, 6, 6, 5, 6, 2, 5, 4, 7, 5)


def _shape(lines: Lines) -> np.ndarray:
    """A rough form of each line: equal for the rows of a list or a table."""
    kind, byte = lines.first & 255, lines.first >> 8
    begin = np.where(kind == SYMBOL, byte, kind)
    c = lines.counts
    cells = np.minimum(c[:, PIPE], 7) * 64 + np.minimum(c[:, TAB] + lines.gaps, 7) * 8 + np.minimum(c[:, SEMI], 7)
    marks = np.minimum(c[:, MARK], 7)
    ends = np.where((lines.last & 255) == STOP, 1, np.where((lines.last & 255) >= COMMA, 2, 0))
    return ((begin * 512 + cells) * 8 + marks) * 3 + ends


def codes(lines: Lines, fluency: np.ndarray | None) -> np.ndarray:
    """The features of every line, as numbers. ``fluency`` has the log probability of each pair of word classes."""
    n = len(lines.doc)
    if not n:
        return np.zeros((0, len(FEATURES)), np.uint8)
    c = lines.counts.astype(np.float64)
    chars = np.maximum(lines.chars, 1)
    words = np.maximum(lines.words, 1)
    token = c[:, DIGIT]
    odd = c[:, SYMBOL] + c[:, MARK] + c[:, PIPE]
    foreign = (c[:, LETTER2] + c[:, OTHER2]) / chars
    if fluency is None:
        fluent = np.zeros(n, np.int64)
    else:
        # What follows a common word tells the same in every language; how often common words come does not.
        said = lines.pairs >= round(len(fluency) ** 0.5)
        sums = np.bincount(lines.pair_line[said], weights=fluency[lines.pairs[said]], minlength=n)
        held = np.bincount(lines.pair_line[said], minlength=n)
        fluent = np.where(held < 3, 0, 1 + np.digitize(sums / np.maximum(held, 1), [-3.0, -2.5, -2.0, -1.4, -0.9, -0.5]))
    last, first, second = lines.last & 255, lines.first & 255, lines.second & 255
    end = np.select([last == STOP, last == COMMA, last == SEMI, last == DIGIT, (last == LOWER) | (last == UPPER) | (last == TAIL)], [0, 1, 2, 3, 4], 5)
    marker = lines.first >> 8
    bullet = (first == QUOTE) & (marker == ord("-")) | (first == SYMBOL) & (marker == ord("*")) | (first == OTHER2) & (marker == 0xE2) | (first == LOWER) & (second == BLANK) & (marker == ord("o"))
    lettered = (marker == ord("(")) & (second == LOWER)
    numbered = (first == DIGIT) | (marker == ord("[")) | (marker == ord("(")) & (second == DIGIT) | (first == OTHER2) & (marker == 0xC2)
    begin = np.select([bullet, lettered, numbered, (first == UPPER) | (first == LOWER), first == PIPE, first == MARK, (first == SYMBOL) | (first == OTHER2)], [0, 1, 2, 3, 4, 5, 6], 7)
    columns = c[:, PIPE] + c[:, TAB] + lines.gaps + np.where(c[:, SEMI] >= 3, c[:, SEMI], 0)
    shape = _shape(lines)
    same = np.zeros(n, bool)
    same[1:] = (shape[1:] == shape[:-1]) & (lines.doc[1:] == lines.doc[:-1])
    # The length of the run of equal forms that a line stands in.
    run = np.cumsum(~same) - 1
    bare = ((first == UPPER) | (first == LOWER)) & (c[:, PIPE] + c[:, TAB] + c[:, SEMI] + c[:, MARK] + lines.gaps == 0) & ((last == LOWER) | (last == UPPER))
    repeats = np.where(bare, 1, np.bincount(run)[run])  # lines of mere words look alike in any text
    # Lines of a text that look the same in all counts are copies of each other.
    look = np.stack([lines.doc, lines.chars, lines.letters.astype(np.int64), lines.words, lines.first, lines.last, c[:, STOP].astype(np.int64)], 1)
    mix = (look.astype(np.uint64) * np.array([3, 5, 7, 11, 13, 17, 19], np.uint64) ** np.uint64(13)).sum(1)
    _, where, copies = np.unique(mix, return_inverse=True, return_counts=True)
    copies = copies[where]
    capitals = c[:, UPPER] / np.maximum(c[:, UPPER] + c[:, LOWER], 1)
    columns_of = (
        np.digitize(lines.words, [1, 2, 4, 6, 9, 13, 20]),
        np.digitize(lines.chars, [8, 20, 40, 80, 160, 400]),
        np.digitize(lines.letters / words, [2.0, 3.0, 3.8, 4.6, 5.5, 7.0]),
        np.digitize(token / chars, [0.001, 0.04, 0.1, 0.2, 0.35, 0.55, 0.8]),
        np.digitize(odd / chars, [0.001, 0.01, 0.03, 0.06, 0.12, 0.2, 0.4]),
        np.digitize(foreign, [0.001, 0.03, 0.08, 0.15, 0.3]),
        np.digitize(lines.common / words, [0.001, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6]),
        fluent,
        end,
        begin,
        np.digitize(columns, [1, 2, 3, 4, 6]),
        np.digitize((c[:, COMMA] + c[:, SEMI]) / words, [0.001, 0.08, 0.16, 0.3, 0.6]),
        np.digitize(lines.titled / words, [0.001, 0.15, 0.3, 0.5, 0.8]),
        np.digitize(capitals, [0.001, 0.1, 0.3, 0.7]),
        np.digitize(repeats, [2, 3, 5, 8, 16]),
        lines.blank_before.astype(np.int64),
        np.digitize(lines.stutter / words, [0.001, 0.1, 0.2, 0.4]),
        np.digitize(copies, [2, 3, 5]),
        np.digitize(c[:, BLANK] / chars, [0.01, 0.08, 0.12, 0.16, 0.21, 0.3]),
        np.digitize(c[:, STOP] / chars, [0.001, 0.02, 0.06, 0.15]),
    )
    return np.stack(columns_of, 1).astype(np.uint8)
