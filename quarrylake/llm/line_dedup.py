"""Line dedup: equal lines, and fuzzy ones by SimHash blocks, verified by edit similarity.

Lines (between line feeds) that hold a word are normalised: A-Z lower-cased, blanks
collapsed. Equal lines are one node. Lines of five words or more (``min_words``) are
also compared: two of them link if their edit similarity, 1 - (inserted + deleted
words) / (words of both), is 0.8 or more. One occurrence of each connected group is
kept: the first by document id and line number. Blank lines are left alone.

Candidates: a line's SimHash is cut into blocks, and every distinct word votes in one
block only, the one that its own hash names. A word that is changed, added or left out
thus disturbs one block, the others keep all their bits: of b blocks at least b - D
survive D such words, and two lines meet at any block they share. (With words that vote
in all bits, as is usual, lines of similarity 0.8 differ in a fifth of the bits and
hardly ever agree on a whole block.) Blocks are ranges of word hashes, halved as long as
each half would hold the information that singles a line out: the words' rarities, the
logarithms of their shares of lines, add up to the logarithm of the number of lines. So
common words make wide blocks and rare ones narrow blocks, the same in both lines, and a
block is shared by few lines that are unlike. Lines of little information have blocks of
less too, one at least. Up to ``POSTED`` blocks of a line, the
same ones in all lines, are posted. Lines under ``PAIRED`` words have few words to vote;
their blocks are pairs of lead words instead, which lose no link: lines of n and m words and
similarity 0.8 share 0.4 (n + m) words, so two of any order's first
n - ceil(2 n / 3) + 2. For longer lines tests measure the recall at the very limit,
against pairs chosen by edit similarity alone (over 0.9; nearly 1 from 0.9 on). Rarities
are counted over all lines of the table, by buckets of word hashes. Of the
pairs that share a block, those whose sizes or word parities (256 bits) differ too much
for a link are left out inside the join.

Scale: what is shuffled is a narrow row per line (digest and place) and two numbers per
posted block, packed by ranges of keys and sorted in the Python tasks; the words of a line are fetched only for lines that share a
block with another. A block shared by many lines is compared through leaders (see
``links``), not squared. Broadcasts are bounded by their counted bytes.

Null texts stay null, empty ones empty; a text of any length is read whole. Documents
with a null id are left alone. Rows that repeat an id are one document: their equal
lines stay or go together. Of equal ids and line numbers (a repeated id with another
text) the first is any; both stay or go by their own words. An empty table gives an
empty one. Columns n_lines and n_dropped of the input are replaced; others stay,
whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, links

MIN_WORDS = 5
SIMILARITY = 0.8
#: Buckets of word hashes that rarities are kept for, and the bits of information beyond
#: which words are as rare as any.
BUCKETS, RAREST = 1 << 20, 15
#: Blocks posted of a line.
POSTED = 10
#: Bits of a line's number in a slice and of a block's place, and halvings of blocks
#: beyond one word a block.
LINE_BITS, PLACE_BITS, DEEPER = 22, 24, 0
#: Bits that hashes are turned by for the second SimHash.
TURN = 12
#: Lines that hold less than so many blocks' information have narrower blocks too,
#: halved in information up to so often.
POOR, HALVED = 3, 6
#: Lines of fewer words have pairs of lead words for blocks; lines of fewer have the
#: blocks of a second SimHash too, by other hashes.
PAIRED, TWICE = 16, 28
#: Bits of a block's SimHash: votes are counted in bytes, eight to a number.
VOTES, BLOCK_BITS = 6, 48
#: Bytes of text that are taken at once.
SLICE = 2 << 20
#: Bits of a line's parities.
PARITY_BITS = 256
PARITIES = PARITY_BITS // 64
BITS = [f"bits{i}" for i in range(PARITIES)]
#: Bits of the finer parities that lines get where many of them are compared, and lines
#: whose ones are counted at once.
FINE_BITS, COUNTED = 1024, 1_000
#: Pairs per posting up to which pairs are left to the join with its parities, the same
#: once a round of leaders settles few, and rounds before that happens anyway.
PAIRS_PER_POSTING, SLOWLY, ROUNDS = 8, 64, 6
#: Ranges of buckets whose counts make a row; postings that a task packs at once; bits of
#: the least number of parts that keys are packed into, and of the lines for each part
#: beyond; rows of a part that are sorted at once.
RANGES, PACKED, PART_BITS, LINES_A_PART, SORTED = 64, 1 << 18, 8, 16, 1 << 21
#: Odd numbers that mix hashes (arbitrary fixed values).
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

#: Which bytes are blanks.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Masks that keep so many of eight bytes.
KEPT = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

#: The bits of a byte, a byte each.
SPREAD = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], np.uint64)


def normal_words(line: bytes) -> list[bytes]:
    """The words of a normalised line, as the digests and comparisons see them: A-Z
    lower-cased, split at ASCII blanks."""
    return line.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * MIX[0]
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return x ^ (x >> np.uint64(32))


def line_words(texts: list[bytes], both: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the lines that hold a word, in order: text, number in the text, and words;
    then two independent 64-bit hashes of every word, from its bytes, eight at a time;
    unless ``both`` the second one is left out."""
    raw = np.frombuffer(b"\n".join(texts).lower() + b"\n" + bytes(8), np.uint8)
    size = len(raw) - 8
    blank = BLANK[raw[:size]]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]  # the last byte is a blank, so they alternate
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    eights = np.ndarray((size,), np.uint64, raw.data, 0, (1,))
    left = ends - starts
    one, two = left.astype(np.uint64) * MIX[1], left.astype(np.uint64) * MIX[2]
    own, at = slice(None), starts
    while len(at):
        chunk = eights[at] & KEPT[np.minimum(left, 8)]
        one[own] = mixed(one[own] ^ chunk)
        if both:
            two[own] = mixed((two[own] ^ chunk) * MIX[2] + MIX[1])
        more = np.flatnonzero(left > 8)
        own = more if isinstance(own, slice) else own[more]
        at, left = at[more] + 8, left[more] - 8
    feeds = np.flatnonzero(raw[:size] == 10)  # also between the texts
    sizes = np.diff(np.searchsorted(starts, feeds), prepend=0)
    line = np.flatnonzero(sizes)
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    last = np.searchsorted(feeds, text_ends)
    owner = np.searchsorted(last, line)
    first = np.concatenate([[0], last[:-1] + 1])
    return owner, line - first[owner], sizes[line], one, two


def line_digests(sizes: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each line, from its words' two hashes in order."""
    ends = np.cumsum(sizes)
    nth = (np.arange(len(one)) - np.repeat(ends - sizes, sizes)).astype(np.uint64)
    out = []
    for h, step in ((one, MIX[1]), (two, MIX[2])):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h + (nth + np.uint64(1)) * step))])
        out.append(mixed(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def parities(sizes: np.ndarray, one: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    """So many bits a line, each the parity of the number of words that fall on it:
    where two lines differ in a bit, they differ in a word."""
    line = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(line * bits + (one % np.uint64(bits)).astype(np.int64), minlength=len(sizes) * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sizes), bits // 64)


def simhash(words: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BLOCK_BITS bits of each block of word hashes: those for which more than half vote."""
    out = np.zeros(len(starts), np.uint64)
    many = np.flatnonzero(counts > 255)  # more votes than a byte holds
    votes = mixed(words ^ MIX[2])
    for i in range(VOTES):  # a byte for each of eight bits, all added at once
        column = SPREAD[((votes >> np.uint64(8 * i)) & np.uint64(255)).astype(np.intp)]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(column)])
        found = total[starts + counts] - total[starts]
        for k in range(8):
            ones = ((found >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)
            for b in many.tolist():
                ones[b] = int(((column[starts[b] : starts[b] + counts[b]] >> np.uint64(8 * k)) & np.uint64(1)).sum())
            out |= (2 * ones > counts).astype(np.uint64) << np.uint64(8 * i + k)
    return out


def blocks(line: np.ndarray, hashes: np.ndarray, rarity: np.ndarray, sizes: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """The narrowest blocks whose words' rarities add up to ``least``: line, place, and
    from and to which of the words they reach. The words of a line are together, in the
    order of their hashes; ``sizes`` are those of all lines."""
    depth = np.minimum(np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64) + DEEPER, PLACE_BITS)
    places = (1 << PLACE_BITS) - 1
    node = line << PLACE_BITS | (hashes >> (np.uint64(64) - depth[line].astype(np.uint64))).astype(np.int64)
    info, start = rarity.astype(np.float64), np.arange(len(node))
    end = start + 1
    found = []
    up = 0
    while len(node):
        heads = np.flatnonzero(np.diff(node, prepend=-1))
        if len(heads) < len(node):
            end = end[np.append(heads[1:], len(end)) - 1]
            node, info, start = node[heads], np.add.reduceat(info, heads), start[heads]
        hit = np.flatnonzero(info >= least)
        own = node[hit] >> PLACE_BITS
        found.append((own, (depth[own] - up) << PLACE_BITS | node[hit] & places, start[hit], end[hit]))
        info[hit] = -np.inf  # what holds such a block is no block
        up += 1
        left = depth[node >> PLACE_BITS] >= up
        if not left.all():
            node, info, start, end = node[left], info[left], start[left], end[left]
        node = node & ~places | (node & places) >> 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def block_keys(sizes: np.ndarray, words: np.ndarray, rarity: Callable[[np.ndarray], np.ndarray], least: float, posted: int = POSTED) -> tuple[np.ndarray, np.ndarray]:
    """Line and key of each posted block, from the hashes of the lines' words."""
    line = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    code = np.sort(line << np.uint64(64 - LINE_BITS) | words >> np.uint64(LINE_BITS))
    fresh = np.ones(len(code), bool)
    fresh[1:] = code[1:] != code[:-1]  # a word votes once
    code = code[fresh]
    line, words = (code >> np.uint64(64 - LINE_BITS)).astype(np.int64), code << np.uint64(LINE_BITS)
    rare = rarity(words)
    found = [blocks(line, words, rare, sizes, least)]
    heads = np.searchsorted(line, np.arange(len(sizes) + 1))
    total = np.add.reduceat(rare, heads[:-1]) if len(sizes) else rare
    halved = np.clip(np.ceil(np.log2(POOR * least / np.maximum(total, 1e-9))), 0, HALVED).astype(np.int64)
    for k in range(1, int(halved.max(initial=0)) + 1):  # partners' numbers differ by one at most, so each has two
        own = ((halved == k) | (halved == k + 1))[line]
        if not own.any():
            continue
        part = blocks(line[own], words[own], rare[own], sizes, least / 2**k)
        found.append((*part[:2], *(np.flatnonzero(own)[x - i] + i for i, x in enumerate(part[2:]))))
    own, place, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    without = np.setdiff1d(np.arange(len(sizes)), own)  # all their words are one block
    own, place = np.append(own, without), np.append(place, np.zeros(len(without), np.int64))
    start, end = np.append(start, heads[without]), np.append(end, heads[without + 1])
    chance = (mixed(place.astype(np.uint64)) >> np.uint64(30)).astype(np.int64)
    order = np.argsort(own << 34 | chance)
    own, place, start, end = own[order], place[order], start[order], end[order]
    heads = np.flatnonzero(np.diff(own, prepend=-1))
    nth = np.arange(len(own)) - np.repeat(heads, np.diff(np.append(heads, len(own))))
    own, place, start, end = (x[nth < posted] for x in (own, place, start, end))
    counts = end - start
    ends = np.cumsum(counts)
    words = words[np.arange(int(counts.sum())) + np.repeat(start - (ends - counts), counts)]
    bits = simhash(words, ends - counts, counts)
    return own, mixed(mixed(bits + np.uint64(1)) ^ place.astype(np.uint64) * MIX[1]).view(np.int64)


def pair_keys(sizes: np.ndarray, words: np.ndarray, starts: np.ndarray, rarity: Callable[[np.ndarray], np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Line and key of each pair of a short line's lead words, rare words first, from
    the words' hashes. A word's k-th occurrence is a word of its own."""
    lines, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        full = words[starts[at][:, None] + np.arange(n)]
        rare = rarity(full.ravel()).reshape(full.shape)
        same = np.sort(full, axis=1)
        for i in np.flatnonzero((same[:, 1:] == same[:, :-1]).any(axis=1)).tolist():
            seen: Counter = Counter()
            for j, h in enumerate(full[i].tolist()):
                full[i, j] = h if not seen[h] else mixed(np.array([h], np.uint64) + np.uint64(seen[h]))[0]
                seen[h] += 1
        order = np.lexsort((full, -rare), axis=1)
        full = np.take_along_axis(full, order, axis=1)
        leads = min(n, n - int(np.ceil(similarity / (2 - similarity) * n - 1e-9)) + 2)
        for i, j in combinations(range(leads), 2):
            low, high = np.minimum(full[:, i], full[:, j]), np.maximum(full[:, i], full[:, j])
            lines.append(at)
            keys.append(mixed(mixed(low) + high))
    return np.concatenate(lines), np.concatenate(keys).view(np.int64)


def words_of(lines: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of the words of some lines, where all lines' words are in a row."""
    n = sizes[lines]
    return np.arange(int(n.sum())) + np.repeat((np.cumsum(sizes) - sizes)[lines] - (np.cumsum(n) - n), n)


def candidate_keys(sizes: np.ndarray, one: np.ndarray, two: np.ndarray, rarity: Callable[[np.ndarray], np.ndarray], least: float, min_words: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Line and key of everything that the lines post, in the order of lines."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    short = np.flatnonzero((sizes >= min_words) & (sizes < PAIRED))
    if len(short):
        at, keys = pair_keys(sizes[short], one, (np.cumsum(sizes) - sizes)[short], rarity, similarity)
        found.append((short[at], keys))
    # Also lines whose longest partner has no pairs.
    long = (sizes >= min_words) & (sizes * (2 - similarity) / similarity + 1e-9 >= PAIRED)
    for some, turned in ((np.flatnonzero(long), False), (np.flatnonzero(long & (sizes < TWICE)), True)):
        if len(some):
            words = one[words_of(some, sizes)]
            # Turned, other bits of the hash name the block; rarity goes by the same ones.
            how = (lambda w: rarity(turn(w, 64 - TURN))) if turned else rarity
            at, keys = block_keys(sizes[some], turn(words, TURN) if turned else words, how, least)
            found.append((some[at], mixed(keys.view(np.uint64)).view(np.int64) if turned else keys))
    line, keys = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(line, kind="stable")
    return line[order], keys[order]


def turn(words: np.ndarray, by: int) -> np.ndarray:
    """Hashes rotated to the left."""
    return words << np.uint64(by) | words >> np.uint64(64 - by)


class Rarity:
    """Rarities of words, and of lines: logarithms of 1 / share of lines, by buckets of
    hashes, from the number of lines that hold a word of the bucket."""

    def __init__(self, held: np.ndarray, lines: int):
        lines = max(lines, 2)
        self.rarity = np.minimum(np.log2(lines / np.clip(held, 1, lines)), RAREST).astype(np.float32)
        self.line = float(np.log2(lines))

    @staticmethod
    def bucket(words: np.ndarray) -> np.ndarray:
        """From bits that a block's words have kept, turned or not."""
        return ((words >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.intp)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        return self.rarity[self.bucket(words)]


def word_rarity(df: DataFrame, text: str) -> Rarity:
    """Rarities from all lines of the table; a count per bucket reaches the driver. Tasks
    give ranges of buckets as one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for group in pieces(batch.column(0), SLICE):
                _, _, sizes, one, _ = line_words([t for *_, t in group], both=False)
                code = np.sort(np.repeat(np.arange(len(sizes)), sizes) * BUCKETS + Rarity.bucket(one))
                code = code[np.flatnonzero(np.diff(code, prepend=-1))]  # a line counts once
                held += np.bincount(code % BUCKETS, minlength=BUCKETS)
                total += len(sizes)
        if total:
            parts = [x.tobytes() for x in held.reshape(RANGES, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, RANGES), pa.int32()), pa.array([np.int64(total).tobytes(), *parts])], names=["part", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "n"])

    counts = df.select(F.col(text).cast("string")).mapInArrow(lambda it: common.released(run(it)), "part int, n binary")
    counts = dict(zip(*(c.to_pylist() for c in counts.repartition("part").mapInArrow(lambda it: common.released(add(it)), "part int, n binary").toArrow().columns), strict=True))
    if not counts:
        return Rarity(np.zeros(BUCKETS), 0)
    return Rarity(np.concatenate([np.frombuffer(counts[i], np.int64) for i in range(RANGES)]), int(np.frombuffer(counts[-1], np.int64)[0]))


def pieces(texts: pa.Array, limit: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, number of the first line, lines) of about ``limit`` bytes; a
    longer text is cut between lines."""
    group, size = [], 0
    for i, t in enumerate(pc.cast(texts, pa.binary()).to_pylist()):
        at, number = 0, 0
        while t and at < len(t):
            end = len(t) if len(t) - at <= limit else t.find(b"\n", at + limit)
            end = len(t) if end < 0 else end
            part = t[at:end]
            group.append((i, number, part))
            size += len(part)
            if size >= limit:
                yield group
                group, size = [], 0
            if end < len(t):
                number += part.count(b"\n") + 1
            at = end + 1
    if group:
        yield group


def with_packed(lines: pa.RecordBatch, posted: list[np.ndarray], part_bits: int) -> pa.RecordBatch:
    """The lines, the first with the postings (key, d1) by the first bits of their keys."""
    rows = np.concatenate(posted) if posted else np.zeros((0, 2), np.int64)
    part = (rows[:, 0].view(np.uint64) >> np.uint64(64 - part_bits)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, rows = part[order], np.ascontiguousarray(rows[order])
    heads = np.flatnonzero(np.diff(part, prepend=-1))
    ends = (16 * np.append(heads, len(part))).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(ends), pa.py_buffer(rows)])
    both = pa.StructArray.from_arrays([pa.array(part[heads], pa.int32()), packed], names=["part", "rows"])
    lists = np.full(lines.num_rows + 1, len(heads), np.int32)
    lists[0] = 0
    return lines.append_column("packed", pa.ListArray.from_arrays(pa.array(lists), both))


def _lines(df: DataFrame, key: str, text: str, min_words: int, similarity: float) -> DataFrame:
    """id, no, digest (d1, d2) and size (words) of every line that holds a word; of
    the first of equal ones in a slice also the parities. Their posted keys are packed:
    some rows have those of many lines."""
    known = word_rarity(df, text)
    part_bits = max(PART_BITS, int(np.ceil(known.line)) - LINES_A_PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, posted, held = None, [], 0
        for batch in batches:
            for group in pieces(batch.column(1), SLICE):
                owner, number, sizes, one, two = line_words([t for *_, t in group])
                if not len(one):
                    continue
                if ready:
                    yield with_packed(ready, posted if held >= PACKED else [], part_bits)
                    posted, held = ([], 0) if held >= PACKED else (posted, held)
                d1, d2 = line_digests(sizes, one, two)
                number = number + np.array([n for _, n, _ in group], np.int64)[owner]
                owner = np.array([i for i, *_ in group], np.int64)[owner]
                fresh = np.unique(d1 ^ mixed(d2.view(np.uint64)).view(np.int64), return_index=True)[1]
                fresh = np.sort(fresh[sizes[fresh] >= min_words])
                n, place = sizes[fresh], words_of(fresh, sizes)
                line, keys = candidate_keys(n, one[place], two[place], known, known.line, min_words, similarity)
                posted.append(np.stack([keys, d1[fresh][line]], axis=1))
                held += len(keys)
                none = np.ones(len(sizes), bool)
                none[fresh] = False
                bits = np.zeros((len(sizes), PARITIES), np.int64)
                bits[fresh] = parities(n, one[place])
                columns = [batch.column(0).take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(d1), pa.array(d2), pa.array(sizes, pa.int32())]
                ready = pa.RecordBatch.from_arrays([*columns, *(pa.array(bits[:, i], mask=none) for i in range(PARITIES))], names=["id", "no", "d1", "d2", "size", *BITS])
        if ready:
            yield with_packed(ready, posted, part_bits)

    long = lambda name: T.StructField(name, T.LongType())
    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("no", T.IntegerType()), long("d1"), long("d2"), T.StructField("size", T.IntegerType()), *map(long, BITS), T.StructField("packed", T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("rows", T.BinaryType())])))])
    return df.where(F.col(key).isNotNull()).select(F.col(key), F.col(text).cast("string")).mapInArrow(lambda it: common.released(run(it)), schema)


def edit_similar(a: list[str], b: list[str], least: float) -> bool:
    """Whether 1 - D / (len(a) + len(b)) >= ``least`` for the least number D of words
    inserted and deleted. Common ends are cut off; the rest's longest common subsequence
    is found bit-parallel, a number holding a row of the table."""
    most = int((1 - least) * (len(a) + len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    cut = 0
    while cut < high - low and a[-1 - cut] == b[-1 - cut]:
        cut += 1
    a, b = a[low : len(a) - cut], b[low : len(b) - cut]
    if len(a) + len(b) <= most:
        return True
    if len(a) + len(b) > 160:  # long: the words alone may tell sooner
        left, right = Counter(a), Counter(b)
        if (left - right).total() + (right - left).total() > most:
            return False
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for w in b:
        if w in places:
            met = row & places[w]
            row = (row + met | row - met) & full
    same = len(a) - row.bit_count()
    return len(a) + len(b) - 2 * same <= most


def _texts(df: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """place and its normalised line, from the documents that hold the wanted lines
    (id, no, place, d1)."""
    numbers = common.materialize(wanted.groupBy("id").agg(F.collect_list(F.struct("no", "place", "d1")).alias("numbers")), "numbers")
    own = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t")).join(common.small_enough(numbers), "id").select("t", "numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in common.slices(b, 0):
                places, found, want = [], [], []
                for t, numbers in zip(pc.cast(part.column(0), pa.binary()).to_pylist(), part.column(1).to_pylist(), strict=True):
                    lines = (t or b"").split(b"\n")
                    for x in numbers:
                        if x["no"] < len(lines):
                            places.append(x["place"])
                            want.append(x["d1"])
                            found.append(b" ".join(normal_words(lines[x["no"]])))
                _, _, sizes, one, two = line_words(found)
                full = np.fromiter(map(bool, found), bool, len(found))
                keep = np.zeros(len(found), bool)
                if len(one):  # an id may repeat with another text
                    keep[full] = line_digests(sizes, one, two)[0] == np.array(want, np.int64)[full]
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([x.decode() for x in found], pa.string())], names=["place", "line"]).filter(pa.array(keep))

    return own.mapInArrow(lambda it: common.released(run(it)), "place long, line string"), numbers


def _fetched(df: DataFrame, key: str, text: str, lines: DataFrame, places: DataFrame) -> DataFrame:
    """place and normalised line of a written table of places, written."""
    wanted = lines.select("place", "id", "no", "d1").join(common.small_enough(places), "place")
    texts, numbers = _texts(df, key, text, wanted)
    words = common.materialize(texts, "words")
    common.discard(numbers)
    if words.count() > places.count():  # ids that repeat
        words, before = common.materialize(words.dropDuplicates(["place"]), "words"), words
        common.discard(before)
    return words


def _finer(df: DataFrame, key: str, text: str, lines: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Makes FINE_BITS parities of some nodes' lines, for the links' last step."""
    names = [f"fine{i}" for i in range(FINE_BITS // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 1, max_bytes=SLICE, max_rows=COUNTED):
                _, _, sizes, one, _ = line_words(pc.cast(part.column(1), pa.binary()).to_pylist(), both=False)
                bits = parities(sizes, one, FINE_BITS)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(bits[:, i]) for i in range(len(names)))], names=["node", *names])

    def make(nodes: DataFrame) -> DataFrame:
        places = common.materialize(nodes.withColumnRenamed("node", "place"), "places")
        words = _fetched(df, key, text, lines, places)
        made = words.mapInArrow(lambda it: common.released(run(it)), ", ".join(f"{c} long" for c in ["node", *names]))
        made = common.materialize(made.select("node", F.struct(*names).alias("bits")), "finer")
        common.discard(places, words)
        return made

    return make


def _verifier(df: DataFrame, key: str, text: str, lines: DataFrame, least: float):
    """Links among pairs of places, whose words are fetched from the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [edit_similar(x.split(" "), y.split(" "), least) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = common.materialize(pairs, "pairs")
        found = common.materialize(pairs.select(F.explode(F.array("a", "b")).alias("place")).distinct(), "found")
        words = _fetched(df, key, text, lines, found)
        side = common.small_enough(words)
        both = pairs.join(side.select(F.col("place").alias("a"), F.col("line").alias("x")), "a").join(side.select(F.col("place").alias("b"), F.col("line").alias("y")), "b")
        linked = common.materialize(both.select("a", "b", "x", "y").mapInArrow(lambda it: common.released(run(it)), "a long, b long"), "linked")
        common.discard(pairs, found, words)
        return linked

    return verify


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, d1) in the order of keys, those that are not their key's first:
    with the first one and whether the key has another such row. Repeated rows of a
    batch count once. A key of any number of rows costs no memory."""
    none = np.zeros(0, np.int64)
    held = (none, none, none, none)  # the last row: key, d1, first, and rows of the key before it

    def rows(key, d1, first, nth, more):
        out = d1 != first
        return pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, d1, first, more | (nth > 1))], names=["key", "d1", "first", "more"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, d1 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        heads = np.flatnonzero(np.diff(key, prepend=key[0] ^ 1))
        lone = np.diff(np.append(heads, len(key))) == 1
        if not lone.all():  # only keys of several rows need an order within
            order = np.lexsort((d1, key))
            key, d1 = key[order], d1[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (d1[1:] != d1[:-1])
            key, d1 = key[fresh], d1[fresh]
            heads = np.flatnonzero(np.diff(key, prepend=key[0] ^ 1))
        sizes = np.diff(np.append(heads, len(key)))
        first, nth = np.repeat(d1[heads], sizes), np.arange(len(key)) - np.repeat(heads, sizes)
        if len(held[0]):
            goes_on = key[0] == held[0][0]
            if goes_on:
                first[: sizes[0]] = held[2][0]
                nth[: sizes[0]] += held[3][0] + 1
            yield rows(*held, np.array([goes_on]))
        yield rows(*(x[:-1] for x in (key, d1, first, nth)), key[1:] == key[:-1])
        held = (key[-1:], d1[-1:], first[-1:], nth[-1:])
    if len(held[0]):
        yield rows(*held, np.zeros(1, bool))


def _shared_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_shared``, from packed rows in the order of their parts. Of a part of very
    many rows those of keys of three lines or more go out early; what stays in memory is
    their first lines, and two rows at most of other keys."""
    names = ["key", "d1", "first", "more"]
    none = np.zeros(0, np.int64)

    def settled(held: list[np.ndarray], known: tuple[np.ndarray, np.ndarray], last: bool):
        """Rows to give out, rows that are left, and the keys (in order) and first lines of those that go out at once."""
        key, d1 = np.concatenate(held).T
        out = []
        if len(known[0]):
            at = np.minimum(np.searchsorted(known[0], key), len(known[0]) - 1)
            met = known[0][at] == key
            first, new = known[1][at], met & (d1 != known[1][at])
            out.append(pa.RecordBatch.from_arrays([pa.array(x) for x in (key[new], d1[new], first[new], np.ones(int(new.sum()), bool))], names=names))
            key, d1 = key[~met], d1[~met]
        order = np.argsort(key)
        key, d1 = key[order], d1[order]
        if last:  # only keys of several rows matter
            same = key[1:] == key[:-1]
            several = np.append(same, False) | np.append(False, same) if len(key) else np.zeros(0, bool)
            out += _shared(iter([pa.RecordBatch.from_arrays([pa.array(key[several]), pa.array(d1[several])], names=names[:2])]))
            return out, [], known
        order = np.lexsort((d1, key))
        key, d1 = key[order], d1[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (d1[1:] != d1[:-1])) if len(key) else np.zeros(0, bool)
        key, d1 = key[fresh], d1[fresh]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else none
        sizes = np.diff(np.append(heads, len(key)))
        first, many = np.repeat(d1[heads], sizes), np.repeat(sizes > 2, sizes)
        new = many & (d1 != first)
        out.append(pa.RecordBatch.from_arrays([pa.array(x) for x in (key[new], d1[new], first[new], many[new])], names=names))
        keys, firsts = (np.concatenate([x, y[heads[sizes > 2]]]) for x, y in zip(known, (key, d1), strict=True))
        order = np.argsort(keys)
        return out, [np.stack([key[~many], d1[~many]], axis=1)], (keys[order], firsts[order])

    part, held, size, most, known = None, [], 0, SORTED, (none, none)
    for batch in batches:
        for p, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part and held:
                yield from settled(held, known, True)[0]
                held, size, most, known = [], 0, SORTED, (none, none)
            part = p
            held.append(np.frombuffer(rows, np.int64).reshape(-1, 2))
            size += len(held[-1])
            if size >= most:
                out, held, known = settled(held, known, False)
                yield from out
                size = len(held[0])
                most = size + SORTED
    if held:
        yield from settled(held, known, True)[0]


def dropped_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """id and the numbers of its lines that repeat a kept one, written."""
    common.bound_batches(df.sparkSession)
    lines = common.materialize(_lines(df, key, text, min_words, similarity).withColumn("place", F.monotonically_increasing_id()), "lines")  # places are fixed from here on
    nodes = lines.groupBy("d1", "d2").agg(F.min("place").alias("place"), F.count("*").alias("n"), *(F.max(c).alias(c) for c in ("size", *BITS)))
    nodes = common.materialize(nodes, "nodes")
    # Equal lines of several slices post the same keys; only keys of different lines count.
    posted = lines.select(F.explode("packed").alias("p")).select("p.part", "p.rows")
    shared = common.materialize(posted.repartition("part").sortWithinPartitions("part").mapInArrow(_shared_packed, "key long, d1 long, first long, more boolean"), "shared")

    def alike(x, y):
        total = (1 - similarity) * (x["size"] + y["size"]) + 1e-9
        apart = sum(F.bit_count(x[c].bitwiseXOR(y[c])) for c in BITS)
        return (F.abs(x["size"] - y["size"]) <= total) & (apart <= total)

    def alike_finely(x, y, size_x, size_y):
        return sum(F.bit_count(x[f"fine{i}"].bitwiseXOR(y[f"fine{i}"])) for i in range(FINE_BITS // 64)) <= (1 - similarity) * (size_x["size"] + size_y["size"]) + 1e-9

    # All lines of a key are held against its first; a key of two is settled by that.
    own = nodes.select("d1", "place", F.struct("size", *BITS).alias("size"))
    heads = shared.select("first", "d1").distinct().join(own.withColumnRenamed("place", "y").withColumnRenamed("size", "size_y"), "d1")
    heads = heads.join(own.select(F.col("d1").alias("first"), F.col("place").alias("x"), F.col("size").alias("size_x")), "first").where(alike(F.col("size_x"), F.col("size_y")))
    verify = _verifier(df, key, text, lines, similarity)
    linked = verify(heads.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    groups = common.materialize(links.components(linked), "labels")
    postings = common.materialize(shared.where("more").join(own, "d1").select("key", F.col("place").alias("node"), F.lit(0).alias("rank"), "size"), "postings")
    common.discard(shared, linked)
    groups = links.shared_key_components(postings, verify, alike, rounds=ROUNDS, sketch=(_finer(df, key, text, lines), alike_finely), per_posting=PAIRS_PER_POSTING, labels=groups, slow=SLOWLY)
    common.discard(postings)
    repeated = nodes.join(common.small_enough(groups).withColumnRenamed("node", "place"), "place", "left").where("n > 1 or component is not null")
    repeated = common.materialize(repeated.select("d1", "d2", F.coalesce("component", "place").alias("component")), "repeated")
    hits = common.materialize(lines.select("id", "no", "d1", "d2").join(common.small_enough(repeated), ["d1", "d2"]).select("id", "no", "component"), "hits")
    firsts = common.materialize(hits.groupBy("component").agg(F.min(F.struct("id", "no")).alias("kept")), "firsts")
    gone = hits.join(common.small_enough(firsts), "component").where("id <> kept.id or no <> kept.no")
    gone = common.materialize(gone.groupBy("id").agg(F.collect_set("no").alias("numbers")), "dropped")
    common.discard(lines, nodes, groups, repeated, hits, firsts)
    return gone


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The operator: ``df`` with repeated lines taken out of its text, and n_lines and
    n_dropped (replacing columns of those names)."""
    gone = dropped_lines(df, key, text, min_words, similarity)
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    at = names.index(text)
    numbers = common.small_enough(gone).toDF("gone", "numbers")
    rows = df.select(*(F.col(f"`{c}`").cast("string") if c == text else F.col(f"`{c}`") for c in names))
    fields = [T.StructField(c, f.dataType) for c, f in zip(names, rows.schema, strict=True)]
    rows = rows.toDF(*(f"c{i}" for i in range(len(names))))  # no name of theirs can clash
    rows = rows.join(numbers, F.col(f"c{names.index(key)}") == F.col("gone"), "left").drop("gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, at, max_bytes=16 << 20, max_rows=10_000):
                texts, gone = part.column(at), part.column(part.num_columns - 1)
                n_lines = pc.fill_null(pc.add(pc.count_substring(texts, "\n"), 1), 0).cast(pa.int64())
                hit = pc.and_(pc.is_valid(gone), pc.is_valid(texts))
                rebuilt = []
                for t, numbers in zip(texts.filter(hit).to_pylist(), gone.filter(hit).to_pylist(), strict=True):
                    numbers = set(numbers)
                    rebuilt.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in numbers))
                new = pc.replace_with_mask(texts, hit, pa.array(rebuilt, texts.type))
                dropped = pc.fill_null(pc.list_value_length(gone), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*(new if i == at else part.column(i) for i in range(len(names))), n_lines, dropped], names=[*names, "n_lines", "n_dropped"])

    return rows.mapInArrow(lambda it: common.released(run(it)), T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))
