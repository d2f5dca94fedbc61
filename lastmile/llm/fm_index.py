"""A compressed FM-index over a text of word numbers, and matching statistics against it.

The Burrows-Wheeler transform is held in a Huffman-shaped wavelet tree: frequent words lie near the root, so
it takes about the zero-order entropy of the text in bits, with a running count for every 64 of them.
Backward search runs for many patterns at once, one numpy step per symbol.

Suffixes are sorted by their first ``DEPTH`` symbols only. For patterns up to that length the ranges are the
same as under the full order, since a range is bounded by the suffixes that differ from the pattern within it.
"""

from __future__ import annotations

import numpy as np

DEPTH = 48
PROBE = 8
MOST_TRIPLED = 1 << 21  # symbols of which three make one key
PIECE_WINDOWS = 96  # windows of a pattern that are sought in one go


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols or more, by prefix doubling from three symbols on.

    With so many different symbols that three do not fit into 63 bits, from two on.
    """
    padded = np.concatenate((text.astype(np.int64) + 1, [0, 0]))
    base = int(padded.max()) + 1
    rank, sorted_by = padded[:-2] * base + padded[1:-1], 2
    if base <= MOST_TRIPLED:
        rank, sorted_by = rank * base + padded[2:], 3
    while True:
        order = np.argsort(rank)
        ordered = rank[order]
        fresh = np.empty(len(text), np.int64)
        fresh[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        if sorted_by >= depth or fresh[order[-1]] == len(text) - 1:
            return order
        after = np.zeros(len(text), np.int64)
        after[:-sorted_by] = fresh[sorted_by:] + 1
        rank = fresh * (len(text) + 1) + after
        sorted_by *= 2


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths; a symbol that does not occur gets 0. Leaves and inner nodes come in rising order of weight."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    used = used[np.argsort(counts[used], kind="stable")]
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    many = len(used)
    weight = counts[used].tolist()
    up = [0] * (2 * many - 1)
    leaf, inner = 0, many
    for node in range(many, 2 * many - 1):
        total = 0
        for _ in range(2):
            if leaf < many and (inner >= node or weight[leaf] <= weight[inner]):
                pick, leaf = leaf, leaf + 1
            else:
                pick, inner = inner, inner + 1
            up[pick] = node
            total += weight[pick]
        weight.append(total)
    depth = [0] * (2 * many - 1)
    for node in range(2 * many - 3, -1, -1):
        depth[node] = depth[up[node]] + 1
    lengths[used] = depth[:many]
    return lengths


#: Masks of the bits below a place of a word.
BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(counts) - counts).astype(np.int32)

    def ones(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & BELOW[place & 63])


class Wavelet:
    """Rank of symbols in a sequence, by a wavelet tree in the shape of the Huffman code."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        length = code_lengths(np.bincount(sequence, minlength=symbols))
        used = np.flatnonzero(length)
        used = used[np.argsort(length[used], kind="stable")]
        code, value, last = np.zeros(symbols, np.int64), 0, 0
        for k in used:
            value <<= int(length[k]) - last
            last = int(length[k])
            code[k] = value
            value += 1
        # a byte of length lets the sort by it be a radix sort
        self.length, self.code, self.deepest = length.astype(np.uint8), code, np.uint8(length.max())
        self.levels: list[Bits] = []
        self.starts: list[np.ndarray] = []  # by level and symbol: where its node begins, and the ones before that
        self.ones: list[np.ndarray] = []
        held = sequence
        for level in range(int(length.max())):
            held = held[length[held] > level]
            prefix = code[held] >> (length[held] - level)
            bit = (code[held] >> (length[held] - level - 1)) & 1
            bits = Bits(bit.astype(np.uint8))
            here = np.flatnonzero(length > level)
            start = np.zeros(symbols, np.int64)
            start[here] = np.searchsorted(prefix, code[here] >> (length[here] - level), "left")
            ones = np.zeros(symbols, np.int64)
            ones[here] = bits.ones(start[here].astype(np.int32))
            self.levels.append(bits)
            self.starts.append(start.astype(np.int32))
            self.ones.append(ones.astype(np.int32))
            held = self.divided(held, prefix, bit)

    @staticmethod
    def divided(held: np.ndarray, prefix: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Each node's symbols with bit 0 before those with bit 1, otherwise in their order."""
        change = np.concatenate(([True], prefix[1:] != prefix[:-1]))
        first = np.flatnonzero(change)
        node = np.cumsum(change) - 1
        zeros = np.cumsum(1 - bit)
        before = zeros - (1 - bit) - np.concatenate(([0], zeros[first[1:] - 1]))[node]
        in_node = np.add.reduceat(1 - bit, first)
        start = first[node]
        place = np.where(bit == 0, start + before, start + in_node[node] + (np.arange(len(held)) - start - before))
        out = np.empty_like(held)
        out[place] = held
        return out

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often ``symbol[k]`` stands before ``place[:, k]``, for each row of places."""
        order = np.argsort(self.deepest - self.length[symbol], kind="stable")
        sorted_symbol, at = symbol[order], place[:, order]
        sorted_length, sorted_code = self.length[sorted_symbol], self.code[sorted_symbol]
        sorted_length = sorted_length.astype(np.int64)
        still = np.searchsorted(-sorted_length, -np.arange(len(self.levels)), "left")
        for level, many in enumerate(still):
            if not many:
                break
            s = sorted_symbol[:many]
            here = at[:, :many]
            ones = self.levels[level].ones(self.starts[level][s] + here) - self.ones[level][s]
            bit = (sorted_code[:many] >> (sorted_length[:many] - level - 1)) & 1 == 1
            np.copyto(here, np.where(bit, ones, here - ones))
        out = np.empty_like(at)
        out[:, order] = at
        return out


class FMIndex:
    """Counts occurrences of patterns of up to ``DEPTH`` symbols; each place of the text has a weight."""

    def __init__(self, text: np.ndarray, symbols: int, weight: np.ndarray):
        order = suffix_order(text, DEPTH)
        self.size = len(text)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols)))).astype(np.int32)
        self.tree = Wavelet(text[order - 1], symbols)
        self.weight = np.concatenate(([0], np.cumsum(weight[order])))

    def step(self, symbol: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        """Ranges of the patterns with one more symbol in front; an empty pattern has the range of all suffixes."""
        out = np.empty_like(ranges)
        fresh = ranges[1] - ranges[0] == self.size
        out[0], out[1] = self.first[symbol], self.first[symbol + 1]
        if not fresh.all():
            old = np.flatnonzero(~fresh)
            out[:, old] = self.first[symbol[old]] + self.tree.rank(symbol[old], ranges[:, old])
        return out

    def count(self, ranges: np.ndarray) -> np.ndarray:
        return self.weight[ranges[1]] - self.weight[ranges[0]]


def in_pieces(start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and end of pieces of the patterns. Every run of ``least`` symbols of a pattern lies whole in a piece.

    All patterns go on together, one numpy step per symbol, so a few very long ones would cost as many steps nearly alone.
    """
    windows = np.maximum(end - start - (least - 1), 1)
    many = -(-windows // PIECE_WINDOWS)
    owner = np.repeat(np.arange(len(start)), many)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    low = start[owner] + number * PIECE_WINDOWS
    return owner, low, np.minimum(low + PIECE_WINDOWS + least - 1, end[owner])


def matched(index: FMIndex, stream: np.ndarray, start: np.ndarray, end: np.ndarray, need: np.ndarray, least: int) -> np.ndarray:
    """Which symbols of the stream lie in a match of at least ``least`` symbols that occurs ``need`` times or more.

    Pattern k is ``stream[start[k]:end[k]]``, sought in overlapping pieces; a negative symbol is unknown to the index. Its matching statistics
    are found from the right: a match is extended to the left as far as it occurs often enough; then the right
    end moves to the next place from which a match of ``least`` symbols is still open. Where a match stopped short,
    the few symbols from the stopping place on are tried first: mostly they do not occur either, and
    then no match over that place is left.
    """
    if not PROBE < least <= DEPTH:
        raise ValueError(f"matches must be longer than {PROBE} and at most {DEPTH} symbols long")
    owner, start, end = in_pieces(start, end, least)
    need = need[owner]
    change = np.zeros(len(stream) + 1, np.int64)
    active = np.flatnonzero(end - start >= least)
    lower, right, need = start[active], end[active], need[active]
    left = right.copy()
    floor = lower.copy()  # how far the current match may go
    resume = np.full(len(active), -1)  # while trying a stopping place: where to go on if it holds
    ranges = np.vstack([np.zeros(len(active), np.int32), np.full(len(active), index.size, np.int32)])
    while len(lower):
        symbol = stream[left - 1]
        known = symbol >= 0
        ranges = index.step(np.where(known, symbol, 0), ranges)
        more = known & (index.count(ranges) >= need)
        left = left - more
        stop = ~more | (left == floor) | (right - left == DEPTH)
        if not stop.any():
            continue
        at = np.flatnonzero(stop)
        trying, held = resume[at] >= 0, more[at]
        length = right[at] - left[at]
        enough = at[~trying & (length >= least)]
        np.add.at(change, left[enough], 1)
        np.add.at(change, right[enough], -1)
        # a stop short of a match at left - 1 is tried from there on, unless next to nothing is between
        try_it = ~trying & ~held & (length < least) & (length > PROBE)
        onward = np.minimum(right[at] - 1, left[at] + least - 1)
        after_try = np.where(held, resume[at], floor[at] + PROBE - 1)
        resume[at] = np.where(try_it, right[at] - 1, -1)
        floor[at] = np.where(try_it, left[at] - 1, lower[at])
        right[at] = np.where(trying, after_try, np.where(try_it, left[at] - 1 + PROBE, onward))
        left[at] = right[at]
        ranges[0, at], ranges[1, at] = 0, index.size
        open_still = (right - lower >= least) | (resume >= 0)
        if not open_still.all():
            lower, right, left, need, floor, resume, ranges = (x[..., open_still] for x in (lower, right, left, need, floor, resume, ranges))
    return np.cumsum(change[:-1]) > 0
