"""Substring dedup with compact windows.

Equal texts are one class and go on as its first row (by key and place). A text
is its sequence of five-word shingles. Under one hash function, the node of the
Cartesian tree (by hash value) at place c with extent [l, r] is the compact
window (l, c, r): it stands for all passages [i, j] with l <= i <= c <= j <= r,
whose min-hash is the value at c. Only windows of ``LEAST`` shingles (50 words)
or more are made, about 2/LEAST of a text's length for each function.

Windows of one value are linked to the value's first; those that do not agree
with it 23 shingles to the left or to the right also to the first that shares
their left, and their right. This is done for the texts of a batch first: only
a batch's first windows are shuffled, so a value that a third of all texts hold
is a few rows of each batch. A pair of texts is a candidate where windows of two
functions overlap by a passage's length in both, or where one agrees also in its
surroundings. Candidates are verified on the texts: the alignment is grown from
c to both sides over edits of any length that the threshold allows (a passage has
edits of a quarter of its common shingles at most, and what lies behind an edit is
a passage with windows of its own unless it is shorter than one), and the passages' shingle sets must have 50 words or more and
a Jaccard similarity of 0.8 or more.

Where a link that agreed in its surroundings fails this test (the first window
shares a phrase only, too short for a passage), its window meets others once more.
Two windows share more with each other than with their first one only if they
part from it at the same distance to the left or to the right (where first ones
differ by batch, failed windows of equal distances meet too). Such windows are
linked under each of the 46 pairs of places (c-i, c-i+45) at which both ends
agree: two texts that share a passage with c in it share such a pair, except
where edits hit it.

Rows that come out link each passage to an earlier one; passages that many texts
hold form stars or short trees, never all pairs. A window whose link has been
verified looks no further under its value.

Defined results: null, empty and short texts have no passages; rows of equal
text are one class, linked to its first row over their whole length (if that is
50 words or more); a passage repeated within one text is reported if the two
places do not overlap; null ids are kept (rows are told apart by place); a text
of any length is taken whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles

FUNCTIONS, SEED = 4, 10
LEAST_WORDS, THRESHOLD = 50, 0.8
LEAST = LEAST_WORDS - shingles.WORDS + 1
_ASIDE = LEAST // 2
#: Shingles within which the next common one is looked for first, and then; how far beyond is bounded by the threshold alone.
_EDITS = (8, 32)
#: Shingles of two texts that are compared as Python numbers, and blocks.
_FEW, _FEW_BLOCKS = 256, 32
#: Shingles of texts that are looked at together.
_TOGETHER = 1_000_000
_AT_ONCE = 131_072
#: Parts in which the rows of one class of copies are joined.
_SALTS = 16
#: Rows of copies that are broadcast; beyond it the join shuffles.
MOST_BROADCAST = 1_000_000
_FAR = (1 << 15) - 1
#: Bits of the shingles to both sides of a window that travel with it.
_SIDE, _LOW = np.uint64(20), np.uint64((1 << 20) - 1)


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) value of every window of the width, in linear time."""
    f = np.minimum if least else np.maximum
    n = len(x) - width + 1
    pad = np.full(-len(x) % width, np.iinfo(np.uint64).max if least else 0, np.uint64)
    blocks = np.concatenate([x, pad]).reshape(-1, width)
    ahead = f.accumulate(blocks, axis=1).ravel()
    back = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[:n], ahead[width - 1 : width - 1 + n])


def compact_windows(h: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(l, c, r) of the Cartesian tree's nodes of at least the given extent.

    Such a node holds the least value of some stretch of that length, and so do
    the smaller values that bound it: the tree is built over those places only.
    """
    if len(h) < least:
        return np.empty((0, 3), np.int64)
    low = _slide(h, least, True)
    edge = np.zeros(least - 1, np.uint64)
    places = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), least, False) == h)
    values = h[places]
    # neighbours that are equal are one, so that "la la la" is no long way
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    heads, run = np.flatnonzero(new), np.cumsum(new) - 1
    ends, of_run = np.append(heads[1:], len(values)) - 1, values[heads]
    left = np.append(-1, places[ends])[_bound(of_run, np.less_equal)][run]
    left[~new] = places[np.flatnonzero(~new) - 1]
    right = np.append(places[heads], len(h))[len(heads) - _bound(of_run[::-1], np.less)[::-1]][run]
    out = np.column_stack([left + 1, places, right - 1])
    return out[out[:, 2] - out[:, 0] + 1 >= least]


def _bound(values: np.ndarray, stops) -> np.ndarray:
    """For each value how many places the last one before it that stops it is from the start, from 1; 0 if there is none.

    All values before which the nearest one is too great go on to where that one's own look has got to, in rounds.
    """
    to, going = np.arange(len(values)), np.arange(1, len(values))
    while len(going):
        going = going[~stops(values[to[going] - 1], values[going])]
        to[going] = to[to[going] - 1]
        going = going[to[going] > 0]
    return to


def _place(c: np.ndarray, left: np.ndarray | int, right: np.ndarray | int, f: np.ndarray | int) -> np.ndarray:
    """A window's place, its reach to both sides (as far as that matters) and its function, in one number."""
    return c.astype(np.int64) << 32 | np.minimum(left, _FAR) << 17 | np.minimum(right, _FAR) << 2 | f


def _place_of(x: np.ndarray) -> dict[str, np.ndarray]:
    c = x >> 32
    return {"c": c, "l": c - (x >> 17 & _FAR), "r": c + (x >> 2 & _FAR), "f": x & 3}


def _joined(texts: list[np.ndarray], margin: int) -> tuple[np.ndarray, np.ndarray]:
    """Several texts one behind the other with zeros between them, and where each starts."""
    size = np.array([len(t) for t in texts])
    gap = np.zeros(margin, np.uint64)
    return np.concatenate([x for t in texts for x in (gap, t)] + [gap]), np.cumsum(size + margin) - size


def _thinned(values: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which windows to keep of those whose value comes again within half a passage, as in "la la la": of such a chain the first, the last, and one in each half passage."""
    order = np.lexsort((c, values))
    values, c = values[order], c[order]
    new = np.ones(len(c), bool)
    new[1:] = (values[1:] != values[:-1]) | (c[1:] - c[:-1] >= _ASIDE)
    first = c[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(c) else c
    step = (c - first) // _ASIDE
    keep = new.copy()
    keep[1:] |= step[1:] != step[:-1]
    keep[:-1] |= new[1:]
    keep[-1:] = True
    return np.sort(order[keep])


def _windows_of(rows: list[int], texts: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Windows of texts, of so many at once as a processor's cache holds."""
    sizes = np.cumsum([len(t) for t in texts])
    cuts = [0, *np.flatnonzero(np.diff(sizes // _AT_ONCE)) + 1, len(texts)]
    found = [_windows_at_once(rows[a:b], texts[a:b]) for a, b in pairwise(cuts)]
    return {k: np.concatenate([w[k] for w in found]) for k in found[0]}


def _windows_at_once(rows: list[int], texts: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Windows of several texts: the zeros between them are smaller than any hash, so no window crosses."""
    s, starts = _joined(texts, _ASIDE)
    inside = s != 0
    a, b = shingles.permutations(FUNCTIONS, SEED)
    found = []
    for f in range(FUNCTIONS):
        h = np.where(inside, s * a[f] + b[f] | np.uint64(1), np.uint64(0))
        w = compact_windows(h)
        w = w[inside[w[:, 1]]]
        w = w[_thinned(h[w[:, 1]], w[:, 1])]
        c = w[:, 1]
        aside = (s[c - _ASIDE] & _LOW) << _SIDE | s[c + _ASIDE] & _LOW
        text = np.searchsorted(starts, c, "right") - 1
        place = _place(c - starts[text], c - w[:, 0], w[:, 2] - c, f)
        found.append(((h[c] ^ np.uint64(2 * f)).view(np.int64), np.array(rows, np.int64)[text], place, aside.view(np.int64)))
    return dict(zip(("value", "row", "place", "aside"), map(np.concatenate, zip(*found)), strict=True))


def _firsts(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """The first row of each row's group, for rows in order and the group's keys."""
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order[np.flatnonzero(new)[np.cumsum(new) - 1]]


def _stars(w: dict[str, np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Links (member, first, sure) of windows that share a value, and a mask of those that others may still have to meet.

    A member that agrees with its value's first window in its surroundings is sure
    and done. Another also meets the first of those that share its left, and its right.
    Windows of an ``old`` batch come first.
    """
    rank = (w["place"], w["row"], ~w["old"])
    order = np.lexsort((*rank, w["value"]))
    first = np.empty(len(order), np.int64)
    first[order] = _firsts(order, [w["value"]])
    left, right = w["aside"].view(np.uint64) >> _SIDE, w["aside"].view(np.uint64) & _LOW
    lone = first == np.arange(len(order))
    sure = ((left == left[first]) & (left != 0) | (right == right[first]) & (right != 0)) & ~lone
    links, ahead = [(np.flatnonzero(~lone), first[~lone], sure[~lone])], lone.copy()
    rest = np.flatnonzero(~sure & ~lone)
    for side in (left, right):
        own = rest[side[rest] != 0]
        if len(own):
            own = own[np.lexsort((*[x[own] for x in rank], side[own], w["value"][own]))]
            one = _firsts(own, [w["value"], side])
            met = one != own
            links.append((own[met], one[met], np.ones(int(met.sum()), bool)))
            ahead[one] = True
    ahead[rest[w["aside"][rest] == 0]] = True
    return [np.concatenate(x) for x in zip(*links, strict=True)], ahead


_WINDOWS = "value long, row long, place long, aside long, row1 long, place1 long, sure byte"
_OWN = ("value", "row", "place", "aside")


def _linked(w: dict[str, np.ndarray], member: np.ndarray, first: np.ndarray, sure: np.ndarray) -> pd.DataFrame:
    """New links as rows, the earlier place as row1. Near places of one text are none."""
    row1, row2, p1, p2 = w["row"][first], w["row"][member], w["place"][first], w["place"][member]
    good = ~w["old"][member] & ((row1 != row2) | (np.abs((p1 >> 32) - (p2 >> 32)) >= LEAST))
    back = (row1 > row2) | (row1 == row2) & (p1 > p2)
    one, two = np.where(back, member, first)[good], np.where(back, first, member)[good]
    first_ = {f"{k}1": w[k][one] for k in ("row", "place")}
    return pd.DataFrame({**{k: w[k][two] for k in _OWN}, **first_, "sure": sure[good].astype(np.int8)})


def _batched(windows_of):
    """Texts in batches of ``_TOGETHER`` shingles: the links among a batch's windows, and the windows that must meet other batches'."""

    def gathered(w: dict[str, np.ndarray]):
        w["old"] = np.zeros(len(w["row"]), bool)
        links, ahead = _stars(w)
        yield _linked(w, *links)
        yield pd.DataFrame({**{k: w[k][ahead] for k in _OWN}, "row1": -1, "place1": -1, "sure": np.int8(0)})

    def run(frames):
        held, size = [], 0
        for frame in frames:
            for x in zip(*[frame[c] for c in frame.columns], strict=True):
                s = _shingles_of(x[1])
                if len(s) >= LEAST:
                    held.append((x[0], s, *x[2:]))
                    size += len(s)
                if size >= _TOGETHER:
                    yield from gathered(windows_of(*zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield from gathered(windows_of(*zip(*held, strict=True)))

    return run


def _met(frames):
    """Links among the batches' windows, sorted by value; of a value that goes on in the next frame the first windows are kept."""
    kept = None
    for frame in frames:
        link = frame["row1"].to_numpy() >= 0
        yield frame[link]
        w = {c: frame[c].to_numpy()[~link] for c in _OWN}
        if not len(w["row"]):
            continue
        w["old"] = np.zeros(len(w["row"]), bool)
        if kept is not None:
            w = {c: np.concatenate([kept[c], v]) for c, v in w.items()}
        links, ahead = _stars(w)
        yield _linked(w, *links)
        on = ahead & (w["value"] == w["value"][-1])
        on &= (w["aside"] != 0) | (np.cumsum(on) == 1)
        kept = {c: v[on] for c, v in w.items()}
        kept["old"] = np.ones(int(on.sum()), bool)


def _links(windows: DataFrame) -> DataFrame:
    """Every link once, out of the batches' rows."""
    deal = F.when(F.col("row1") < 0, F.col("value")).otherwise(F.xxhash64("row1", "row"))
    return common.staged(windows.repartition(deal).sortWithinPartitions("value").mapInPandas(_met, _WINDOWS))


def _candidates(links: DataFrame) -> DataFrame:
    """(row1, row2, place, place1, sure, value): pairs of texts with the links that bring them together, as arrays in order of place."""
    seed = F.struct("place", "place1", "sure", "value").alias("seed")
    f = F.col("seed.place").bitwiseAND(F.lit(3))
    pairs = links.select("row1", F.col("row").alias("row2"), seed)
    grouped = pairs.groupBy("row1", "row2").agg(F.array_sort(F.collect_list("seed")).alias("seeds"), F.max("seed.sure").alias("sure"), F.min(f).alias("f_min"), F.max(f).alias("f_max"))
    kept = common.filter_after(grouped, (F.col("sure") == 1) | (F.col("f_min") < F.col("f_max")))
    return kept.select("row1", "row2", *[F.col(f"seeds.{name}").alias(name) for name in _SEED])


_SEED = ("place", "place1", "sure", "value")


def _supported(seeds: dict[str, np.ndarray]) -> np.ndarray:
    """Places of seeds that agree in their surroundings, or overlap with one of another function by a passage in both texts.

    Seeds stand in order of c; windows that overlap around one passage are near each other there.
    """
    out = seeds["sure"] > 0
    if not out.all():
        w = _place_of(np.array([seeds["place"], seeds["place1"]]))
        l, r, f = w["l"], w["r"], w["f"][0]
        for d in range(1, min(2 * FUNCTIONS, len(out) - 1) + 1):
            near = np.minimum(r[:, :-d], r[:, d:]) - np.maximum(l[:, :-d], l[:, d:]) >= LEAST - 1
            met = near[0] & near[1] & (f[:-d] != f[d:])
            out[:-d] |= met
            out[d:] |= met
    return np.flatnonzero(out)


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common start, looked at in growing steps."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        end = min(at + step, n)
        differ = a[at:end] != b[at:end]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = end, step * 4
    return n


def _nearest(x: np.ndarray, y: np.ndarray) -> tuple[int, int] | None:
    """The nearest places (p, q) with x[p] == y[q]."""
    if len(x) + len(y) <= _FEW:
        return _nearest_of_few(x.tolist(), y.tolist())
    values, at = np.unique(y, return_index=True)
    near = np.minimum(np.searchsorted(values, x), len(values) - 1)
    p = np.flatnonzero(values[near] == x)
    q = at[near[p]]
    if not len(p):
        return None
    k = int(np.argmin(np.maximum(p, q) * (len(x) + len(y)) + p + q))
    return int(p[k]), int(q[k])


def _nearest_of_few(x: list[int], y: list[int]) -> tuple[int, int] | None:
    """The same; what is found bounds how far is looked."""
    last = len(y) - 1
    at = dict(zip(reversed(y), range(last, -1, -1)))
    found, best = None, (len(x) + len(y), 0)
    for p, v in enumerate(x):
        if p > best[0]:
            break
        q = at.get(v)
        if q is not None and (far := (max(p, q), p + q)) < best:
            found, best = (p, q), far
    return found


def _longest_edit(same: int) -> int:
    """How long an edit can be behind so many common shingles, if less than a passage of common ones lies beyond it.

    The shingles of either text that the other lacks are a share of the common ones, and the words around an edit are in a few more.
    """
    return int((same + LEAST) * (1 / THRESHOLD - 1)) + shingles.WORDS


def _extended(a: np.ndarray, b: np.ndarray, blocks: list[tuple[int, int, int]], same: int) -> int:
    """Adds equal blocks (place in a, place in b, length), with edits between them, behind those at hand.

    ``same`` shingles agree in all, on the other side of the start too; the number afterwards is returned.
    """
    i, j = blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]
    while i < len(a) and j < len(b):
        near, longest = None, _longest_edit(same)
        for edit in (*[e for e in _EDITS if e < longest], longest):
            near = _nearest(a[i : i + edit], b[j : j + edit])
            if near is not None:
                break
        if near is None:
            break
        i, j = i + near[0], j + near[1]
        run = _run(a[i:], b[j:])
        blocks.append((i, j, run))
        i, j, same = i + run, j + run, same + run
    return same


def _alignment(s1: np.ndarray, s2: np.ndarray, c1: int, c2: int) -> np.ndarray:
    """The blocks around a common place, in order: rows (start1, start2, length)."""
    sides = ((s1[: c1 + 1][::-1], s2[: c2 + 1][::-1]), (s1[c1:], s2[c2:]))
    back, on = blocks = [[(0, 0, _run(*x))] for x in sides]
    same, tried = back[0][2] + on[0][2] - 1, [0, 0]
    # what is found on one side allows longer edits on the other, until no side can go on
    while min(tried) < _longest_edit(same):
        for k in (0, 1):
            if tried[k] < _longest_edit(same):
                same = _extended(*sides[k], blocks[k], same)
                tried[k] = _longest_edit(same)
    behind = [(c1 - i - n + 1, c2 - j - n + 1, n) for i, j, n in back][::-1]
    ahead = [(c1 + i, c2 + j, n) for i, j, n in on]
    # both hold the place itself: their blocks there are one
    first = (behind[-1][0], behind[-1][1], behind[-1][2] + ahead[0][2] - 1)
    return np.array([*behind[:-1], first, *ahead[1:]])


def _stretches(blocks: np.ndarray) -> list[tuple[int, int]]:
    """Runs of blocks, as long as they can be from each start, that agree at the threshold and have a passage's length."""
    if len(blocks) <= _FEW_BLOCKS:
        return _stretches_of_few(blocks.tolist())
    a, b, n = blocks.T
    total, out, s, rows = np.concatenate([[0], np.cumsum(n)]), [], 0, 1
    # no start from which less than this is left has a passage
    most = int(np.searchsorted(-(total[-1] - total), -THRESHOLD * LEAST, "right"))
    while s < min(most, len(n)):
        # a start by itself, then more and more at once while none has a passage
        at = np.arange(s, min(s + rows, most, len(n)))[:, None]
        span1, span2 = a[s:] + n[s:] - a[at], b[s:] + n[s:] - b[at]
        same = total[s + 1 :] - total[at]
        good = (same >= THRESHOLD * (span1 + span2 - same)) & (np.minimum(span1, span2) >= LEAST)
        some = good.any(axis=1)
        k = int(some.argmax())
        if some[k]:
            end = len(n) - 1 - int(good[k, ::-1].argmax())
            out.append((s + k, end))
            s, rows = end + 1, 1
        else:
            s, rows = s + len(at), min(4 * rows, 64)
    return out


def _stretches_of_few(blocks: list[list[int]]) -> list[tuple[int, int]]:
    total = [0, *accumulate(n for _, _, n in blocks)]
    out, s = [], 0
    while s < len(blocks) and total[-1] - total[s] >= THRESHOLD * LEAST:
        a, b, _ = blocks[s]
        for end in range(len(blocks) - 1, s - 1, -1):
            a2, b2, n = blocks[end]
            span1, span2, same = a2 + n - a, b2 + n - b, total[end + 1] - total[s]
            if span1 < LEAST or span2 < LEAST:
                end = s
                break
            if same >= THRESHOLD * (span1 + span2 - same):
                out.append((s, end))
                break
        else:
            end = s
        s = end + 1
    return out


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    if np.array_equal(a, b):
        return 1.0
    x, y = np.unique(a), np.unique(b)
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(x) + len(y) - shared)


def passages(s1: np.ndarray, s2: np.ndarray, c2: np.ndarray, c1: np.ndarray, within: bool = False) -> tuple[list[tuple[int, int, int, int, float]], np.ndarray, np.ndarray]:
    """Verified passages (start2, end2, start1, end1 in words, similarity) of two shingle sequences, around the places (c2, c1), in order of c2.

    A place on an alignment that has been followed already is not followed again.
    ``within``: both are one text, and passages must not overlap. Also, for each place
    how many shingles around it agree to the left and to the right, -1 if it was not looked at.
    """
    out, done = [], -1
    left, right = np.full(len(c2), -1), np.full(len(c2), -1)
    for k, (x2, x1) in enumerate(zip(c2.tolist(), c1.tolist(), strict=True)):
        if left[k] >= 0 or x2 <= done or x1 >= len(s1) or x2 >= len(s2) or s1[x1] != s2[x2]:
            continue
        blocks = _alignment(s1, s2, x1, x2)
        on, l, r = _reach(blocks, c2[k:], c1[k:])
        left[k:][on], right[k:][on] = l, r
        for x, y in _stretches(blocks):
            a1, a2 = blocks[x, :2].tolist()
            b1, b2 = (blocks[y, :2] + blocks[y, 2]).tolist()
            over = b1 + shingles.WORDS - 1 - a2
            if within and over > 0:
                b1, b2 = b1 - over, b2 - over
            if min(b1 - a1, b2 - a2) < LEAST or a2 <= done:
                continue
            similarity = _similarity(s1[a1:b1], s2[a2:b2])
            if similarity >= THRESHOLD:
                out.append((a2, b2 + shingles.WORDS - 1, a1, b1 + shingles.WORDS - 1, round(similarity, 6)))
                done = b2 - 1
    return out, left, right


def _reach(blocks: np.ndarray, c2: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which places lie in the blocks, and how far their blocks go on to the left and to the right."""
    a, b, n = blocks.T
    at = np.maximum(np.searchsorted(b, c2, "right") - 1, 0)
    on = np.flatnonzero((b[at] <= c2) & (c2 < b[at] + n[at]) & (a[at] - b[at] == c1 - c2))
    at = at[on]
    return on, c2[on] - b[at], b[at] + n[at] - 1 - c2[on]


def _shingles_of(text: str | None) -> np.ndarray:
    return shingles.shingle_hashes(shingles.hash_text(text))


_shingled = lru_cache(64)(_shingles_of)
_PASSAGE = ("row1", "row2", "start", "end", "start1", "end1", "similarity")
_VERIFIED = "row1 long, row2 long, start long, end long, start1 long, end1 long, similarity double, value long, failed byte"


def _verify(frames):
    """For each candidate pair its passages (``failed`` is -1), and the sure links with their reach, as other rows; such a link has failed if it lies in no passage."""
    for frame in frames:
        found, looked_at = [], []
        for pair in frame.itertuples():
            seeds = {k: getattr(pair, k) for k in _SEED}
            chosen = _supported(seeds)
            if not len(chosen):
                continue
            c2, c1 = seeds["place"][chosen] >> 32, seeds["place1"][chosen] >> 32
            own, left, right = passages(_shingled(pair.t1), _shingled(pair.t2), c2, c1, pair.row1 == pair.row2)
            failed = np.ones(len(c2), bool)
            for start, end, *_ in own:
                failed &= (c2 < start) | (c2 > end - shingles.WORDS)
            sure = (seeds["sure"][chosen] > 0) & (left >= 0)
            found += [(pair.row1, pair.row2, *p) for p in own]
            rows = [np.full(int(sure.sum()), r) for r in (pair.row1, pair.row2)]
            looked_at.append(np.array([*rows, *[x[sure] for x in (c2, left, c1, right, seeds["value"][chosen], failed)]]))
        yield pd.DataFrame(found, columns=_PASSAGE).assign(value=0, failed=-1)
        if looked_at:
            row1, row2, c, left, c1, right, value, failed = np.concatenate(looked_at, axis=1)
            yield pd.DataFrame({"row1": row1, "row2": row2, "start": c, "end": left, "start1": c1, "end1": right, "similarity": 0.0, "value": value, "failed": failed})


def _verified(links: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The passages of the linked texts, and the sure links that have been looked at."""
    found = common.staged(_candidates(links))
    one = rows.select(F.col("_row").alias("row1"), F.col("t").alias("t1"))
    two = rows.select(F.col("_row").alias("row2"), F.col("t").alias("t2"))
    pairs = found.join(two, "row2").join(one, "row1").select("row1", "row2", "t1", "t2", *_SEED)
    out = common.staged(pairs.mapInPandas(_verify, _VERIFIED))
    common.release(found)
    of_seed = {"row1": "row1", "row2": "row", "start": "c", "end": "left", "start1": "c1", "end1": "right", "value": "value"}
    seeds = out.filter("failed >= 0").select(*[F.col(a).alias(b) for a, b in of_seed.items()], (F.col("failed") == 1).alias("failed"))
    return out.filter("failed < 0").select(*_PASSAGE), seeds


def _ends_of(rows, texts, values, places, lows, highs) -> dict[str, np.ndarray]:
    """For places of texts, a window for each pair of ends (c-i, c-i+45) with i in the place's range."""
    s, starts = _joined(list(texts), LEAST)
    size = [len(x) for x in places]
    flat = lambda x: np.concatenate([np.asarray(y, np.int64) for y in x])
    c, low, high = flat(places), flat(lows), flat(highs)
    at = c + np.repeat(starts, size)
    row, value = np.repeat(np.array(rows, np.int64), size), flat(values).view(np.uint64)
    found = []
    for i in range(LEAST):
        one, two = s[at - i], s[at - i + LEAST - 1]
        some = (one != 0) & (two != 0) & (low <= i) & (i <= high)
        key = shingles.mixed(shingles.mixed(shingles.mixed(value[some] + np.uint64(i)) + one[some]) + two[some])
        found.append((key.view(np.int64), row[some], _place(c[some], 0, 0, 0), np.ones(int(some.sum()), np.int64)))
    return dict(zip(_OWN, map(np.concatenate, zip(*found)), strict=True))


def _again(seeds: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """Links by both ends of a passage, among the windows of failed links and those that part from the same window at the same distance.

    A failed link counts that agrees without an edit as far as its side, so that what is shared is a phrase.
    """
    phrase = F.greatest("left", "right") >= _ASIDE
    seeds = seeds.withColumn("failed", F.col("failed") & phrase)
    total = seeds.count()
    # a passage that goes beyond the first window's on one side only, or on both
    last = LEAST - 1
    right = F.struct(F.lit(1).alias("side"), F.col("right").alias("reach"), F.lit(0).alias("low"), F.least(last - 1 - F.col("right"), F.col("left")).alias("high"))
    left = F.struct(F.lit(0).alias("side"), F.col("left").alias("reach"), F.greatest(F.col("left") + 1, last - F.col("right")).alias("low"), F.lit(last).alias("high"))
    sides = seeds.withColumn("p", F.explode(F.array(left, right))).select("value", "row", "row1", "c", "c1", "failed", "p.*").filter("low <= high")

    def met(of: DataFrame, on: list[str]) -> DataFrame:
        keys = common.staged(of.groupBy(*on).agg(F.max("failed").alias("any"), F.count("*").alias("n")).filter("any and n > 1").drop("any"))
        return common.join_groups(of, keys.drop("n"), on, keys.filter(F.col("n") * common.HOT > total).select(*on)).select("value", "row", "c", "side", "low", "high")

    # by the window they part from, or, of failed links only, wherever that lies: a shared phrase ends where it ends
    failed = sides.filter("failed")
    own = ["failed", "side", "reach", "low", "high"]
    both = failed.select("value", "row", "c", *own).union(failed.select("value", "row1", "c1", *own)).distinct()
    every = met(sides, ["value", "row1", "c1", "side", "reach"]).union(met(both, ["value", "side", "reach"]))
    # on both sides: every pair of ends that is not within what both share with the first
    every = every.groupBy("value", "row", "c").agg(F.count_distinct("side").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    every = every.select("value", "row", "c", F.when(F.col("n") > 1, 0).otherwise(F.col("low")).alias("low"), F.when(F.col("n") > 1, last).otherwise(F.col("high")).alias("high"))
    places = every.groupBy("row").agg(F.collect_list(F.struct("value", "c", "low", "high")).alias("x")).withColumnRenamed("row", "_row")
    held = rows.select("_row", "t").join(places, "_row").select("_row", "t", "x.value", "x.c", "x.low", "x.high")
    links = _links(held.mapInPandas(_batched(_ends_of), _WINDOWS))
    each = links.select("row1", "row", "place", "place1", "sure", F.lit(0).cast("long").alias("value")).distinct()
    # not where the two texts have a passage already
    known = found.select("row1", F.col("row2").alias("row"), "start", "end")
    c = F.shiftright("place", 32)
    inside = (each["row1"] == known["row1"]) & (each["row"] == known["row"]) & (c >= F.col("start")) & (c <= F.col("end") - shingles.WORDS)
    new = common.staged(each.join(known, inside, "left_anti"))
    common.release(links)
    return new


def copies(rows: DataFrame) -> DataFrame:
    """(_row, first): rows whose text an earlier row has, and the first such row. ``rows`` has _row, key, t."""
    digest = rows.filter("t <> ''").select("_row", "key", F.unhex(F.md5("t")).alias("digest"))
    digest = digest.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(_SALTS)).cast("int"))
    firsts = digest.groupBy("digest").agg(F.min(F.struct("key", "_row")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = firsts.select("digest", F.col("first._row").alias("first"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    return digest.join(firsts, ["digest", "salt"]).filter("_row <> first").select("_row", "first")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key2, start, end, key1, start1, end1, similarity), places in words, ends exclusive.

    Each row is a passage of a document and its match in an earlier one, or
    earlier in the same one. ``docs`` must be read from files.
    """
    rows = common.with_row_id(docs.select(F.col(key).alias("key"), F.col(text).alias("t")))
    same = common.staged(copies(rows))
    gone = same.select("_row")
    of_class = rows.join(F.broadcast(gone) if same.count() <= MOST_BROADCAST else gone, "_row", "left_anti")
    links = _links(of_class.select("_row", "t").mapInPandas(_batched(_windows_of), _WINDOWS))
    first, seeds = _verified(links, rows)
    common.release(links)
    links = _again(seeds, first, rows)
    second, _ = _verified(links, rows)
    common.release(links)
    found = first.union(second)
    n_words = F.size(F.split(F.trim(F.regexp_replace("t", r"(?U)\s+", " ")), " ")).cast("long")
    # the words of copies only: a plain filter would count those of all texts, below the join
    whole = common.filter_after(rows.join(same, "_row").withColumn("end", n_words), F.col("end") >= LEAST_WORDS)
    whole = whole.select(F.col("first").alias("row1"), F.col("_row").alias("row2"), F.lit(0).cast("long").alias("start"), "end", F.lit(0).cast("long").alias("start1"), F.col("end").alias("end1"), F.lit(1.0).alias("similarity"))
    found = found.distinct().unionByName(whole)
    keys = rows.select("_row", "key")
    out = found.join(keys.withColumnsRenamed({"_row": "row1", "key": "key1"}), "row1").join(keys.withColumnsRenamed({"_row": "row2", "key": "key2"}), "row2")
    return out.select("key2", "start", "end", "key1", "start1", "end1", "similarity")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage of 50 words or more, with an earlier place that has it; a copy is linked to its class's first document."""
    found = repeated_passages(common.read(spark, sf_dir, "documents"))
    return found.withColumnsRenamed({"key2": "doc_id", "key1": "first_doc_id", "start": "start_word", "end": "end_word", "start1": "first_start_word", "end1": "first_end_word"})


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
