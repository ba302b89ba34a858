"""Words, word shingles and fragments of their global order.

Texts become arrays of word hashes in the JVM; everything on shingles is
vectorised numpy over whole Arrow batches.
"""

from __future__ import annotations

import math
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table of document frequencies (2**18), and steps of its information per nat.
SLOT_BITS, STEPS = 18, 8
#: Nats by which a fragment may be more frequent than one of all sets by chance, shares of the groups that are matched one after the other.
SLACK, TURNS = 6.0, 2
#: What a pair's partial overlaps must come to, fragments of a set that are expected, shingles of a batch cut at once.
UNIT, PER_SET, SLICE = 1 << 16, 256, 1 << 18
KEY_MASK = np.uint64((1 << 40) - 1)
#: Sizes of sets at which the number of groups grows (1, 6, then fourfold), and the steps in which a fragment tells how many of them are in use.
BOUNDS, IN_USE = 20 * 4 ** np.arange(20, dtype=np.int64), np.array([1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 20, 23, 24, 46, 92])
GROUPS = np.concatenate([[1], 6 * 4 ** np.arange(20, dtype=np.int64)]).astype(np.uint64)
#: Classes of shingles whose parities a fragment tells, of its group and of the group after it.
ODD, ODD_NEXT = 10, 21
_MASK40 = np.uint64((1 << 40) - 1)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def word_array(c: Column) -> Column:
    """Lower-cased maximal runs of letters or digits, without tags, entities and invisible characters; null gives none."""
    c = F.when(c.contains("<") | c.contains("&"), F.regexp_replace(c, r"<[^>]*>|&[#A-Za-z0-9]{1,10};", " ")).otherwise(c)
    c = F.when(c.rlike("[​‌‍⁠﻿­]"), F.regexp_replace(c, "[​‌‍⁠﻿­]", "")).otherwise(c)
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def word_hashes(df: DataFrame, id_col: str, texts: list[str], last_at_least: int) -> DataFrame:
    """``id, words`` (64-bit hashes) of rows whose last text has at least so many words."""
    cols = [word_array(F.col(t)).alias(f"w{k}") for k, t in enumerate(texts)]
    last = f"w{len(texts) - 1}"
    split = df.select(F.col(id_col).alias("id"), F.inline(F.array(F.struct(*cols)))).where(F.size(last) >= last_at_least)
    return split.select("id", F.transform(F.concat(*[f"w{k}" for k in range(len(texts))]), lambda w: F.xxhash64(w)).alias("words"))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def shingle_sets(words: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``doc, hash`` of every distinct shingle, sorted by both; hashes have 40 bits.

    ``doc`` numbers the rows of the batch, of which there may be 2**24 at most.
    """
    off = words.offsets.to_numpy().astype(np.int64)
    flat = words.values.to_numpy(zero_copy_only=False).view(np.uint64)[off[0] : off[-1]] if len(words) else np.empty(0, np.uint64)
    off = off - off[0]
    n = off[1:] - off[:-1]
    doc = np.repeat(np.arange(len(words), dtype=np.uint64), np.maximum(n - width + 1, 0))
    ok = np.ones(len(flat), dtype=bool)
    for k in range(1, width):  # the last positions of each text begin no shingle
        at = off[1:] - k
        ok[at[(at >= off[:-1])]] = False
    at = np.flatnonzero(ok)
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = mixed(h * _M1 + flat[at + k])
    key = np.sort((doc << np.uint64(40)) | (h & _MASK40))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(40)).astype(np.int64), key & _MASK40


def set_identity(doc: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 128-bit identity, in two halves, and the size of each row's set."""
    size = np.bincount(doc, minlength=rows)
    ends = np.cumsum(size)
    halves = []
    for salt in (_M1, _M2):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(mixed(h * _M3 + salt)), dtype=np.uint64)])
        halves.append(mixed(total[ends] - total[ends - size] + salt * size.astype(np.uint64)))
    return halves[0], halves[1], size


def slots(h: np.ndarray) -> np.ndarray:
    """The slot of each shingle in the table of document frequencies, which has a fixed size."""
    return (mixed(h * _M3 + _M2) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def information(frequency: np.ndarray, sets: int) -> np.ndarray:
    """``-ln(share of sets that hold it)`` of the shingles of each slot, in steps of 1 / STEPS."""
    share = np.clip(frequency / max(1, sets), 1e-300, 1.0)
    return np.minimum(255, np.rint(-np.log(share) * STEPS)).astype(np.uint8)


def distance_share(similarity: float) -> tuple[int, int]:
    """p, q: sets are at least so similar if, of the sizes of both together, at most p / q are shingles of one of them only."""
    least = Fraction(repr(float(similarity)))
    share = (1 - least) / (1 + least)
    return share.numerator, share.denominator


def fragment_keys(
    doc: np.ndarray, h: np.ndarray, size: np.ndarray, weight: np.ndarray, sets: int, similarity: float, turn: int | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc, key, info``: fragments of which any pair of similar sets has enough in common (see :func:`partial_overlap`).

    Hashes put all shingles into groups, of which a set uses about one for each 3
    to 14 shingles; a pair meets in the groups of its larger set, so a set is also
    cut into those of the largest set that may be similar to it. With groups in a
    ring, sets that are similar as a whole are so within some group, and also
    within it and the group after it together. From each group, rare shingles
    before common ones, and on into the next, a fragment is made of the shingles
    that both sets of such a pair share, until these are so rare together that few
    sets hold them by chance, or both groups end. Which ones are shared isn't known,
    so every choice is made that leaves out no more than similarity within the
    group, and within both, allows. Nothing is drawn by chance and no fragment is
    left out.

    ``info`` packs the size of the set's part of the group (31: not known), how
    many of its shingles the fragment left out so far, how many groups are in use,
    the parities of its shingles that aren't in the fragment, by classes of them,
    and the size (15: not known) and parities of the part in the next group.
    ``turn`` asks for one of ``TURNS`` shares of the groups only, which is a ring of
    its own; a similar pair is similar within one of the shares.
    """
    p, q = distance_share(similarity)
    least = np.rint(max(2.0, math.log(max(1, sets)) - SLACK) * STEPS)
    level = np.searchsorted(BOUNDS, size, side="right")
    reach = np.searchsorted(BOUNDS, np.floor(size / similarity + 1e-9), side="right")
    docs, keys, infos = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    ends = np.cumsum(np.bincount(doc, minlength=len(size)))
    upto = first = 0
    while upto < len(h):  # whole sets, about a slice of shingles at once
        begin = upto
        last = max(first + 1, int(np.searchsorted(ends, begin + SLICE, side="right")))
        upto, first = int(ends[last - 1]), last
        for up in range(int((reach - level)[doc[begin:upto]].max()) + 1 if upto > begin else 0):
            at = begin + np.flatnonzero((level + up <= reach)[doc[begin:upto]])
            parts = GROUPS[level[doc[at]] + up]
            group = (mixed(mixed(h[at] + _M1)) >> np.uint64(8)) % parts
            if turn is not None:
                mine = group % np.uint64(TURNS) == np.uint64(turn)
                at, group, parts = at[mine], group[mine], parts[mine]
            for out, x in zip((docs, keys, infos), _choices(doc[at], h[at], np.clip(weight[slots(h[at])], 1, least).astype(np.float64), group, parts, least, p, q, 1 if turn is None else TURNS)):
                out.append(x)
    return np.concatenate(docs), np.concatenate(keys), np.concatenate(infos)


def _choices(doc: np.ndarray, h: np.ndarray, w: np.ndarray, group: np.ndarray, parts: np.ndarray, least: float, p: int, q: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    # by set, group and rarity; hashes are in order already
    order = np.argsort((doc - doc[0]).astype(np.uint64) << np.uint64(46) | group << np.uint64(8) | (255 - w).astype(np.uint64), kind="stable")
    doc, h, w, group, parts = doc[order], h[order], w[order], group[order], parts[order]
    start = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (group[1:] != group[:-1])]))
    end = np.concatenate([start[1:], [len(doc)]])
    held = end - start
    most = held * (2 * p) // (p + q)
    in_use = np.bincount(doc[start])[doc[start]]
    told = (np.searchsorted(IN_USE, in_use, side="right") - 1).astype(np.int64)
    kind = mixed(mixed(h + _M2)) >> np.uint64(20)
    bit = np.int64(1) << (kind % np.uint64(ODD)).astype(np.int64)
    odd_all = np.bitwise_xor.reduceat(np.int64(1) << (kind % np.uint64(ODD_NEXT)).astype(np.int64), start)
    # the part in the group after each one, if there is any
    base = (doc[start] - doc[0]) << 39
    place, after = base | group[start].astype(np.int64), base | ((group[start] + np.uint64(step)) % parts[start]).astype(np.int64)
    beside = np.minimum(np.searchsorted(place, after), len(place) - 1)
    there = place[beside] == after
    about = told << 8 | np.where(there, np.minimum(held[beside], 15) | odd_all[beside] << 4, 0) << 13 + ODD
    there &= place != after
    most_both = (held + held[beside]) * (2 * p) // (p + q)
    # states: cell, next shingle, where the part ends, how many may be left out, left out in all and in the first part, parities of what isn't shared there, information, key, whether in the first part
    cell, j, stop, limit, miss, own = np.arange(len(start)), start, end, most, np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    odd, total, key, at_first = np.bitwise_xor.reduceat(bit, start), np.zeros(len(start)), mixed(mixed(group[start] * _M3 + parts[start]) + _M2), np.ones(len(start), bool)
    docs, keys, infos = [], [], []
    while len(cell):
        skip = np.flatnonzero(miss < limit)
        left = at_first[skip]
        state = (cell, j, stop, limit, miss, own, odd ^ np.where(at_first, bit[j], 0), total + w[j], mixed(key * _M1 + h[j]), at_first), (cell[skip], j[skip], stop[skip], limit[skip], miss[skip] + 1, own[skip] + left, odd[skip], total[skip], key[skip], left)
        cell, j, stop, limit, miss, own, odd, total, key, at_first = (np.concatenate(x) for x in zip(*state))
        j = j + 1
        full, ended = total >= least - 1e-6, j >= stop
        on = np.flatnonzero(ended & ~full & at_first & there[cell])
        to = beside[cell[on]]
        out = full | ended
        j[on], stop[on], limit[on], at_first[on], out[on] = start[to], end[to], most_both[cell[on]], False, False
        c, m = cell[out], own[out]
        docs.append(doc[start[c]])
        keys.append(key[out] & KEY_MASK)
        infos.append(np.where(m < 7, np.minimum(held[c], 31), 31) | np.minimum(m, 7) << 5 | about[c] | odd[out] << 13)
        rest = np.flatnonzero(~out)
        cell, j, stop, limit, miss, own, odd, total, key, at_first = (x[rest] for x in (cell, j, stop, limit, miss, own, odd, total, key, at_first))
    return np.concatenate(docs), np.concatenate(keys), np.concatenate(infos)


def told_by(info: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """What infos tell, as small numbers: size, left out, parities, groups in use, size and parities of the next part."""
    p, q = distance_share(similarity)
    small = np.int16 if 62 * (p + q) < 1 << 15 else np.int64
    n, left = (info & 31).astype(small), (info >> 5 & 7).astype(small)
    return n, left, (info >> 13 & (1 << ODD) - 1).astype(np.uint16), (info >> 8 & 15).astype(np.uint8), (info >> 13 + ODD & 15).astype(small), (info >> 17 + ODD).astype(np.uint32)


def own_gain(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], similarity: float) -> np.ndarray:
    """p * s - q * d of the group at most (see :func:`partial_overlap`); not negative where it isn't known."""
    p, q = distance_share(similarity)
    (n, left, odd), (m, out, odd_b) = a[:3], b[:3]
    apart = np.maximum(left + out + np.abs((n - left) - (m - out)), np.bitwise_count(odd ^ odd_b))
    return np.where((n == 31) | (m == 31), p, p * (n + m) - q * apart)


def shares(gain: np.ndarray, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], similarity: float) -> np.ndarray:
    p, q = distance_share(similarity)
    x, y = a[4], b[4]
    known = (a[0] < 31) & (b[0] < 31)
    loss = np.where((x < 15) & (y < 15), np.minimum(p * (x + y) - q * np.maximum(np.abs(x - y), np.bitwise_count(a[5] ^ b[5])), 0), 0)
    value = gain.astype(np.int64) + loss
    share = np.minimum(-(-(2 * value + 1 + (loss < 0)) * UNIT // IN_USE[np.maximum(a[3], b[3])]), UNIT)
    return np.where(known, np.where(value >= 0, share, 0), UNIT)


def partial_overlap(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """What a fragment in common (its infos in both sets) counts at most; all of a similar pair's come to ``UNIT`` or more, none are negative.

    Within a group let s be the sizes of both parts together, d the shingles of one
    only, and g = p * s - q * d. Of similar sets the sum of g over the m groups in
    use is not negative. A group with g >= 0 counts v: g, and the next group's g if
    that is negative. Each negative group is the next of one group only, so the sum
    of all v >= 0 comes at least to the number of groups whose v is negative and of
    negative groups that are counted in no v. Of m those are all but the groups with
    v >= 0, each with its next one if that is negative, and the next ones of those
    with negative v; so the sum of 2 * v + 1, and 1 more if the next is negative,
    comes to m at least. Where v is negative there need not be a fragment in common.
    What both left out before the fragment's end and the difference in what is left
    come to d at most, and so do the classes whose parities differ.
    """
    a, b = (told_by(x.astype(np.int64), similarity) for x in (a, b))
    gain = own_gain(a, b, similarity)
    return np.where(gain >= 0, shares(gain, a, b, similarity), 0)


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs: all first bytes, then all second bytes and so on, Huffman-coded where this saves anything."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    out = [bytes([width])]
    for plane in np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T):
        share = np.bincount(plane, minlength=256) / max(1, len(plane))
        coded = -(share * np.log2(np.maximum(share, 1e-12))).sum() < 7.5
        coder = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
        data = coder.compress(plane.tobytes()) + coder.flush() if coded else plane.tobytes()
        out += [bytes([int(coded)]), len(data).to_bytes(4, "little"), data]
    return b"".join(out)


def unpacked(data: bytes) -> np.ndarray:
    planes, at = [], 1
    for _ in range(data[0]):
        coded, size = data[at], int.from_bytes(data[at + 1 : at + 5], "little")
        part = data[at + 5 : at + 5 + size]
        planes.append(np.frombuffer(zlib.decompress(part) if coded else part, np.uint8))
        at += 5 + size
    out = np.zeros((len(planes[0]), 8), np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = plane
    return out.view("<u8").ravel()
