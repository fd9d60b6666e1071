"""Suffix-array dedup over bytes, by a hash-compared suffix sort.

1. Candidates. Each window of WINDOW bytes has an anchor: the first of its smallest GRAM-byte hashes. Equal windows have equal anchors at equal
   places, so suffixes only need sorting within an anchor. The stretch of all windows with one anchor occurrence is its context.
   Anchors travel as hashes with their contexts' places, no text, and with two more hashes: of the anchor with the bytes just before it, and with
   those just after. A window reaches over half of what it holds beside its anchor to one side or the other, so of equal windows one of the two is
   equal. A context goes further where another document has one of its two hashes, and only with the windows on that side: the phrases of
   GRAM bytes that documents share by chance grow faster than the table, longer ones hardly.
2. The texts of these contexts are fetched.
3. Suffix sort. Suffixes of an anchor are sorted by merging; two of them are compared by the length of their common extension, found by binary
   search over prefix polynomial hashes, and by the byte after it. Neighbours that extend far enough, verified byte by byte, form a class.
   First the suffixes at which contexts begin are sorted: those equal for the whole context form a class, and one is left of each. Then all window
   starts of what is left are. Members of a class in documents after the class's first are removed.

A removal is only ever decided where both texts are at hand and their bytes are equal; hashes choose what is compared.

An anchor with over CROWD contexts, and over a CROWD_PART-th of its bucket's, is not sorted in one task: its windows are dealt one by one by their hash, and
sorted there, in bounded pieces. As windows a context takes some ten times its bytes, and the anchors with over a fixed number of contexts are more in larger tables.
Copies within a map task's share are sorted out there, in the same way, so a hot passage costs one record per share and anchor.

Defined results: a null or empty text has no bytes; matches never cross documents; a very long text is read in overlapping pieces of PIECE bytes; rows
without a doc_id come after all others, and rows with one doc_id do not remove one another's bytes; rows repeated whole get the same result each; an
empty table gives an empty result; other columns are ignored, or pass through `strip`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import common, flows

WINDOW, GRAM, CROWD, CROWD_PART = 50, 20, 4096, 32
#: A longer document is read in pieces of this many bytes, overlapping by a window less one byte.
PIECE = 4 << 20
#: Bytes of fetched contexts in a share.
FETCHED = 8 << 20
#: Suffixes that are sorted at once (more only where one anchor has more).
SORTED = 1 << 17
_PLACE = np.uint64((1 << 24) - 1)


def anchors(prefix: common.Prefix, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor place, first and last window start) of each anchor occurrence in documents laid end to end."""
    n, span = int(offsets[-1]), window - gram + 1
    empty = (np.zeros(0, dtype=np.uint64), *(np.zeros(0, dtype=np.int64),) * 3)
    if n < window:
        return empty
    grams = common.mix(prefix.rolling(gram))
    key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)  # the smallest, then the first
    width = 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    starts = np.arange(len(key))  # of windows; one that crosses a document's end has no anchor
    ok = np.ones(len(key) + 1, dtype=np.int64)
    for b in offsets[1:-1]:
        ok[max(0, b - window + 1) : min(b, len(key))] = 0
    starts = starts[ok[: len(key)] > 0]
    if not len(starts):
        return empty
    place = (key[starts] & _PLACE).astype(np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (np.diff(place) != 0) | (np.diff(starts) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return grams[place[first]], place[first], starts[first], starts[last]


def _pieces(data: np.ndarray, offsets: np.ndarray, window: int):
    """common.slices, with a long document in overlapping pieces: (row, end, bytes, offsets, where the piece begins)."""
    for first, end, part, begin in common.slices(data, offsets, min(PIECE, common.SLICE_BYTES)):
        if len(part) <= PIECE:
            yield first, end, part, begin, 0
        else:
            for at in range(0, len(part), PIECE):
                piece = part[at : at + PIECE + window - 1]
                yield first, end, piece, np.array([0, len(piece)]), at


def gather(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of ranges, one range after the other."""
    return np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _small8(x: np.ndarray, window: int) -> np.ndarray:
    return x.astype(np.uint8 if window <= 255 else np.uint32)


def _halves(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48 bits of an anchor."""
    return (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32), (anchor >> np.uint64(32)).astype(np.uint16)


def _whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(32)) | low


def _shared(anchor: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The records, by anchor, of anchors that several documents hold."""
    order = np.argsort(anchor, kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = anchor[order][1:] != anchor[order][:-1]
    return order[flows.smallest(new, rank[order]) != flows.largest(new, rank[order])]


def sides(prefix: common.Prefix, place: np.ndarray, start: np.ndarray, stop: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts: 16 bits of the hash of the anchor with half of a window's other bytes before it, and after it; 0 where no window of the context
    reaches that far."""
    half, out = (window - gram) // 2, []
    for ok, a, b in ((place - start >= half, place - half, place + gram), (place - stop < half, place, place + gram + half)):
        x = np.zeros(len(place), dtype=np.uint16)
        x[ok] = common.mix(prefix.ranges(a[ok], b[ok])) % np.uint64(0xFFFF) + np.uint64(1)
        out.append(x)
    return out[0], out[1]


def spread(grams: np.ndarray) -> np.ndarray:
    """48 bits of an anchor's hash. Smallest hashes are small: they are spread before they are dealt."""
    return common.mix(grams ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64((1 << 48) - 1)


def contexts(batches, n: int, window: int, gram: int, by_id: bool = False):
    """Blobs of (anchor, document, place, sides) by anchor, without contexts that an earlier document of the share has too: these are verdicts."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush():
        anchor, ids, hashes, start, stop, offset, at, before, after = (np.concatenate([x[k] for x in held]) for k in range(9))
        text = np.concatenate([x[9] for x in held])
        stay = np.ones(len(anchor), dtype=bool)
        rank = flows.ranked(ids, hashes)
        few = _shared(anchor, rank)
        if len(few):
            lengths = (stop - start)[few] + window
            later = few[later_contexts(text, at[few], lengths, anchor[few], offset[few], rank[few])]
            stay[later] = False
            yield from flows.verdicts(ids[later], hashes[later], start[later], stop[later] + window, n)
        rest = np.flatnonzero(stay)
        yield from flows.dealt(
            flows.bucket_of(anchor[rest] << np.uint64(16), n), 1,
            lambda x: (*flows.Docs(ids[rest[x]], hashes[rest[x]]).table(), *_halves(anchor[rest[x]]), flows.steps(start[rest[x]]), _small8(stop[rest[x]] - start[rest[x]], window), _small8(offset[rest[x]], window), before[rest[x]], after[rest[x]]),
        )

    size = base_text = 0
    for batch in batches:
        ids, missing = flows.ids_of(batch.column(0))
        data, offsets = common.flat(batch.column(1))
        own: dict[int, np.ndarray] = {}
        for first, end, part, begin, base in _pieces(data, offsets, window):
            if first not in own:
                raw = data[offsets[first] : offsets[end]].tobytes()
                cut = (offsets[first : end + 1] - offsets[first]).tolist()
                own = {first: flows.doc_hashes([raw[a:b] for a, b in zip(cut[:-1], cut[1:])], missing[first:end], by_id)}
            prefix = common.Prefix(part)
            anchor, place, start, stop = anchors(prefix, begin, window, gram)
            if not len(anchor):
                continue
            both = sides(prefix, place, start, stop, window, gram)
            row = np.searchsorted(begin, start, side="right") - 1
            held.append((spread(anchor), ids[first:end][row], own[first][row], start - begin[row] + base, stop - begin[row] + base, place - start, start + base_text, *both, part))
            size += len(anchor)
            base_text += len(part)
            if size > flows.share(n):
                yield from flush()
                held.clear()
                size = base_text = 0
    if held:
        yield from flush()


def shared_contexts(blobs: list[bytes], n: int, window: int, crowd: int, gram: int = GRAM):
    """Kind 3: the contexts of anchors that several documents hold with the bytes on one side, by document, as (document, first window and how many follow,
    anchor's place, crowded); of a context of which only one side is shared, the windows that reach to that side."""
    columns: list[list[np.ndarray]] = [[] for _ in range(8)]
    for blob in blobs:
        *table, low, high, step, length, offset, before, after = flows.unpack(blob)
        docs = flows.Docs.read(*table)
        for held, x in zip(columns, (_whole(low, high), docs.ids, docs.hashes, flows.unsteps(step), length.astype(np.int64), offset.astype(np.int64), before, after)):
            held.append(x)
    anchor, ids, hashes, start, length, offset, before, after = map(np.concatenate, columns)
    rank, crowd = flows.ranked(ids, hashes), max(crowd, len(anchor) // CROWD_PART)
    few = _shared(anchor, rank)
    anchor, ids, hashes, start, length, offset, before, after, rank = (x[few] for x in (anchor, ids, hashes, start, length, offset, before, after, rank))
    shared = []
    for side in (before, after):
        own = np.flatnonzero(side)
        own = own[_shared((anchor[own] << np.uint64(16)) | side[own], rank[own])]
        shared.append(np.zeros(len(anchor), dtype=bool))
        shared[-1][own] = True
    left, right = shared
    half = (window - gram) // 2
    length = np.where(left & ~right, np.minimum(length, offset - half), length)
    skip = np.where(right & ~left, np.maximum(offset - half + 1, 0), 0)
    start, length, offset = start + skip, _small8(length - skip, window), _small8(offset - skip, window)
    asked = np.flatnonzero(left | right)
    if not len(asked):
        return
    new = np.append(True, anchor[asked][1:] != anchor[asked][:-1])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(asked)))
    crowded = np.repeat(sizes > crowd, sizes)
    order = np.lexsort((start[asked], hashes[asked], ids[asked]))
    asked, crowded = asked[order], crowded[order]
    yield from flows.dealt(
        flows.destination(ids[asked], hashes[asked], n), 3,
        lambda x: (*flows.Docs(ids[asked[x]], hashes[asked[x]]).table(), flows.steps(start[asked[x]]), length[asked[x]], offset[asked[x]], crowded[x]),
    )


def fetch(stream, n: int, window: int, gram: int = GRAM):
    """The texts of the contexts asked for, dealt by anchor (a crowded anchor's windows one by one, by their hash). Neither what is asked nor what is
    fetched names the anchor: it is read from the text."""
    held: list[tuple] = []
    seen, asked, size = None, None, 0

    def flush():
        ids, hashes, start, offset, lengths, where = (np.concatenate([x[k] for x in held]) for k in range(6))
        data = np.concatenate([x[6] for x in held])
        begin = np.cumsum(lengths) - lengths

        def columns(x):
            return (*flows.Docs(ids[x], hashes[x]).table(), flows.steps(start[x]), _small8(offset[x], window), flows.small(lengths[x]), data[gather(begin[x], lengths[x])])

        yield from flows.dealt(where, 4, columns, level=3)

    for replies, ids, hashes, data, offsets, _ in stream:
        if replies is not seen:
            seen, columns = replies, [[] for _ in range(6)]
            for blob in replies.get(3, []):
                *table, step, length, offset, crowded = flows.unpack(blob)
                docs = flows.Docs.read(*table)
                for own, x in zip(columns, (docs.ids, docs.hashes, flows.unsteps(step), length.astype(np.int64), offset.astype(np.int64), crowded)):
                    own.append(x)
            asked = flows.ByDocument(*map(np.concatenate, columns)) if columns[0] else None
        for k in range(len(ids)) if asked else ():
            found = asked.get(int(ids[k]), int(hashes[k]))
            if not found:
                continue
            start, length, offset, crowded = found
            many = np.where(crowded, length + 1, 1)
            which = np.repeat(np.arange(len(start)), many)
            within = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            first = start[which] + within
            sizes = np.where(crowded[which], window, length[which] + window)
            own = data[offsets[k] : offsets[k + 1]]
            prefix = common.Prefix(own)
            anchor = spread(common.mix(prefix.ranges(start + offset, start + offset + gram)))
            where = flows.bucket_of(anchor[which] << np.uint64(16), n)
            if crowded.any():
                hot = crowded[which]
                where[hot] = flows.bucket_of(common.mix(prefix.ranges(first[hot], first[hot] + window)), n)
            text = own[gather(first, sizes)]
            held.append((np.full(len(which), ids[k]), np.full(len(which), hashes[k]), first, offset[which] - within, sizes, where, text))
            size += len(text)
            if size > flows.large(FETCHED, n):
                yield from flush()
                held.clear()
                size = 0
    if held:
        yield from flush()


class SuffixSort:
    """Sorts suffixes of a text within groups, comparing by common extensions of up to a limit, which is one for each group."""

    def __init__(self, text: np.ndarray):
        self.text, self.prefix = text, common.Prefix(text)

    def extension(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at x and y, at most the limit, by binary search on hashes."""
        p, length = self.prefix, np.zeros(len(x), dtype=np.int64)
        if not len(x):
            return length
        whole = p.ranges(x, x + limit) == p.ranges(y, y + limit)
        length[whole] = limit[whole]
        step = 1 << (int(limit.max()).bit_length() - 1)
        while step:
            longer = length + step
            ok = np.flatnonzero(longer < limit)
            a, b, l = x[ok], y[ok], longer[ok]
            same = p.ranges(a, a + l) == p.ranges(b, b + l)
            length[ok[same]] = l[same]
            step >>= 1
        return length

    def before(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether the suffix at x sorts before that at y (or, where asked for, equals it up to the limit)."""
        length = self.extension(x, y, limit)
        whole = length >= limit
        at = np.where(whole, 0, length)
        return np.where(whole, or_equal, self.text[x + at] < self.text[y + at])

    def sort(self, suffixes: np.ndarray, groups: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """An order of the suffixes in which each group (they come grouped) is sorted: merges of doubling width, all groups at once. Equal
        suffixes keep the order in which they come."""
        n = len(suffixes)
        order = np.arange(n)
        if not n:
            return order
        new = np.ones(n, dtype=bool)
        new[1:] = groups[1:] != groups[:-1]
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, n))
        begin, end = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
        width = 1
        while width < sizes.max():
            local = np.arange(n) - begin
            run = local // width
            pair = begin + (run & ~1) * width  # where the two runs to merge begin
            left = (run & 1) == 0
            other = np.minimum(np.where(left, pair + width, pair), end)
            stop = np.minimum(np.where(left, pair + 2 * width, pair + width), end)
            lo, hi = np.zeros(n, dtype=np.int64), stop - other
            while True:  # rank of each suffix among the other run's
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                # on the left, count what is smaller; on the right, also what is equal: the merge is stable
                right = self.before(suffixes[order[other[open_] + mid]], suffixes[order[open_]], limit[open_], ~left[open_])
                lo[open_[right]] = mid[right] + 1
                hi[open_[~right]] = mid[~right]
            place = pair + (local - (local // width) * width) + lo
            merged = np.full(n, -1)
            merged[place] = order
            order = order[np.argsort(place, kind="stable")] if (merged < 0).any() else merged  # hashes that collide may contradict one another
            width *= 2
        return order

    def classes(self, suffixes: np.ndarray, groups: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """For sorted suffixes: whether each begins a class of those equal up to the limit, bytes compared."""
        new = np.ones(len(suffixes), dtype=bool)
        pairs = np.flatnonzero(groups[1:] == groups[:-1])
        pairs = pairs[self.extension(suffixes[pairs], suffixes[pairs + 1], limit[pairs]) >= limit[pairs]]
        for part in np.array_split(pairs, len(pairs) // (1 << 16) + 1):
            if len(part):
                sizes = limit[part]
                same = self.text[gather(suffixes[part], sizes)] == self.text[gather(suffixes[part + 1], sizes)]
                new[part[np.logical_and.reduceat(same, np.cumsum(sizes) - sizes)] + 1] = False
        return new


def twins(prefix: common.Prefix, suffixes: np.ndarray, groups: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes (equal groups together), those that share a hash of the first half up to the limit with another of the group, in a stable order by group
    and hash; and their groups by both. What has no such twin has no equal either, and needs no sorting."""
    half = prefix.ranges(suffixes, suffixes + (limit + 1) // 2)
    order = np.lexsort((half, groups))
    same = (groups[order][1:] == groups[order][:-1]) & (half[order][1:] == half[order][:-1])
    ties = np.append(False, same) | np.append(same, False) if len(order) else order.astype(bool)
    return order[ties], np.cumsum(np.append(True, ~same))[: len(order)][ties]


def later_contexts(text: np.ndarray, begin: np.ndarray, lengths: np.ndarray, anchor: np.ndarray, offset: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of contexts in a text, which are equal (anchor and its place, bytes) to one of a document with a smaller id: indices. Equal ones of the
    smallest id are all left, for later documents of other shares."""
    order = np.lexsort((ids, lengths, offset, anchor))
    same = (anchor[order][1:] == anchor[order][:-1]) & (offset[order][1:] == offset[order][:-1]) & (lengths[order][1:] == lengths[order][:-1])
    ties = np.append(False, same) | np.append(same, False) if len(order) else order.astype(bool)  # alone, a context is its own class
    groups, order = np.cumsum(np.append(True, ~same))[: len(order)][ties], order[ties]
    if not len(order):
        return order
    sizes = lengths[order]
    sorter = SuffixSort(text[gather(begin[order], sizes)])
    suffix = np.cumsum(sizes) - sizes
    few, groups = twins(sorter.prefix, suffix, groups, sizes)
    order, suffix, sizes = order[few], suffix[few], sizes[few]
    place = sorter.sort(suffix, groups, sizes)
    new = sorter.classes(suffix[place], groups, sizes)  # a group's limits are the same
    order = order[place]
    return order[ids[order] > flows.smallest(new, ids[order])]


def _shares(anchor: np.ndarray, weight: np.ndarray, most: int):
    """Rows in order of their anchors (equal ones must stand together), cut into whole anchors of about `most` together."""
    share = (np.cumsum(weight) - 1) // most
    head = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    share = np.repeat(share[head], np.diff(np.append(head, len(anchor))))
    return np.split(np.arange(len(anchor)), np.flatnonzero(np.diff(share)) + 1)


def sort_suffixes(blobs: list[bytes], n: int, window: int, gram: int = GRAM):
    columns: list[list[np.ndarray]] = [[] for _ in range(7)]
    for blob in blobs:
        *table, step, offset, lengths, data = flows.unpack(blob)
        docs = flows.Docs.read(*table)
        offset, lengths = offset.astype(np.int64), lengths.astype(np.int64)
        at = np.cumsum(lengths) - lengths + offset
        for held, x in zip(columns, (docs.ids, docs.hashes, spread(common.mix(common.Prefix(data).ranges(at, at + gram))), flows.unsteps(step), offset, lengths, data)):
            held.append(x)
    ids, hashes, anchor, start, offset, lengths, data = map(np.concatenate, columns)
    begin, many = np.cumsum(lengths) - lengths, lengths - window + 1
    rank = flows.ranked(ids, hashes)
    rows = np.argsort(anchor, kind="stable")

    # whole contexts. What is equal in a piece leaves one; then pieces of what is left, until every anchor is in one piece (or nothing more goes)
    while True:
        parts = [own for own in np.array_split(rows, len(rows) // SORTED + 1)]
        left = []
        for own in parts:
            gone = own[later_contexts(data, begin[own], lengths[own], anchor[own], offset[own], rank[own])]
            yield from flows.verdicts(ids[gone], hashes[gone], start[gone], start[gone] + lengths[gone], n)
            left.append(own[~np.isin(own, gone)])
        apart = any(anchor[a[-1]] == anchor[b[0]] for a, b in zip(parts[:-1], parts[1:]))
        before, rows = len(rows), np.concatenate(left)
        if not apart:
            break
        if len(rows) > 0.9 * before:  # one piece after all
            gone = rows[later_contexts(data, begin[rows], lengths[rows], anchor[rows], offset[rows], rank[rows])]
            yield from flows.verdicts(ids[gone], hashes[gone], start[gone], start[gone] + lengths[gone], n)
            rows = rows[~np.isin(rows, gone)]
            break

    # windows, of anchors with contexts of several kinds. Contexts of one window each are done
    if not len(rows):
        return
    head = np.append(True, anchor[rows][1:] != anchor[rows][:-1])
    group = np.cumsum(head) - 1
    open_ = (np.bincount(group) > 1) & (np.maximum.reduceat(many[rows], np.flatnonzero(head)) > 1)
    rows = rows[open_[group]]
    for share in _shares(anchor[rows], many[rows], SORTED) if len(rows) else ():
        own = rows[share]
        which = np.repeat(own, many[own])
        within = np.arange(len(which)) - np.repeat(np.cumsum(many[own]) - many[own], many[own])
        place = offset[which] - within  # of the anchor in the window
        order = np.lexsort((rank[which], place, anchor[which]))
        which, within, place = which[order], within[order], place[order]
        same = (anchor[which][1:] == anchor[which][:-1]) & (place[1:] == place[:-1])
        moved = np.zeros(len(lengths), dtype=np.int64)
        moved[own] = np.cumsum(lengths[own]) - lengths[own]
        sorter = SuffixSort(data[gather(begin[own], lengths[own])])  # the texts of these contexts alone
        suffix = moved[which] + within
        few, groups = twins(sorter.prefix, suffix, np.cumsum(np.append(True, ~same)), np.full(len(which), window))
        if not len(few):
            continue
        which, within, suffix, limit = which[few], within[few], suffix[few], np.full(len(few), window)
        order = sorter.sort(suffix, groups, limit)
        which, within, suffix = which[order], within[order], suffix[order]
        new = sorter.classes(suffix, groups, limit)
        later = rank[which] > flows.smallest(new, rank[which])
        which, first = which[later], (start[which] + within)[later]
        yield from flows.verdicts(ids[which], hashes[which], first, first + window, n)


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> tuple[DataFrame, int, bool]:
    """Blobs (kind 0) of the byte ranges to remove, by document; the number of destinations; and whether documents are named by their ids alone."""
    n, by_id = common.buckets(docs.sparkSession), flows.named_by_id(docs)
    rows = flows.texts(docs)
    first = common.arrow(rows, lambda b: flows.rows(contexts(b, n, window, gram, by_id)), flows.BLOBS)
    asked = common.settled(flows.in_buckets(first, n, lambda x: shared_contexts(x, n, window, crowd, gram), done=0), "asked")
    fetched = flows.at_documents(asked.where("kind = 3"), flows.packed(rows, n, by_id=by_id), n, lambda s: flows.rows(fetch(s, n, window, gram)), flows.BLOBS)
    sorted_ = common.settled(flows.in_buckets(fetched, n, lambda x: sort_suffixes(x, n, window, gram)), "sorted")
    return asked.where("kind = 0").unionByName(sorted_), n, by_id


def _kept(stream):
    """Each pack with the bytes kept of each document, and how many runs went."""
    seen, gone = None, None
    for replies, ids, hashes, data, offsets, others in stream:
        if replies is not seen:
            seen, gone = replies, flows.ByDocument(*flows.read_verdicts(replies.get(0, [])))
        raw, kept, spans = data.tobytes(), [], []
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            text, n_spans = raw[a:b], 0
            if x := gone.get(int(ids[k]), int(hashes[k])):
                starts, stops = common.intervals(*x)
                n_spans = len(starts)
                text = b"".join(text[p:q] for p, q in zip([0, *stops.tolist()], [*starts.tolist(), b - a]))
            kept.append(text)
            spans.append(n_spans)
        yield flows.ids_back(ids, hashes), np.diff(offsets), kept, spans, others


def dedup_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD, with_text: bool = True) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and the remaining bytes (kept), if asked for."""
    rows = flows.texts(docs)
    found, n, by_id = removed(docs, window, gram, crowd)

    def finish(stream):
        for ids, sizes, kept, spans, _ in _kept(stream):
            columns = [ids, pa.array(sizes, pa.int64()), pa.array(sizes - np.array([len(x) for x in kept], dtype=np.int64), pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.binary())] if with_text else [])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return flows.at_documents(found, flows.packed(rows, n, by_id=by_id), n, finish, schema)


def strip(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """docs, all columns, with the remaining text; a character of which only some bytes remain goes as a whole."""
    rows, names, schema = flows.texts(docs, others=True), docs.columns, docs.schema
    found, n, by_id = removed(docs, window, gram, crowd)

    def finish(stream):
        for _, _, kept, _, others in _kept(stream):
            text = pa.array([x.decode(errors="ignore") for x in kept], pa.string())
            for batch in pa.table([text if c == "text" else others.column(f"_{k}") for k, c in enumerate(names)], names=names).combine_chunks().to_batches():
                yield batch

    return flows.at_documents(found, flows.packed(rows, n, by_id=by_id), n, finish, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


def oracle_sql() -> str:
    """Bytes as pairs of hexadecimal digits; every window is a row."""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    win AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, {2 * WINDOW}) AS s
            FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - {WINDOW - 1})) AS i FROM d WHERE length(h) >= {2 * WINDOW})),
    first_in AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
    hit AS (SELECT r, i FROM win JOIN first_in USING (s) WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL)),
    begun AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + {WINDOW}, true) AS begins FROM hit),
    runs AS (SELECT r, i, sum(begins::INT) OVER (PARTITION BY r ORDER BY i) AS g FROM begun),
    spans AS (SELECT r, g, min(i) AS a, max(i) + {WINDOW} AS b FROM runs GROUP BY r, g),
    cut AS (SELECT r, g, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY g), 0) AS last FROM spans),
    kept AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS b,
                    string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY g) AS s FROM cut JOIN d USING (r) GROUP BY r)
    SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
           sha256(unhex(coalesce(s, '') || substr(h, 2 * coalesce(b, 0) + 1))) AS kept_sha256
    FROM d LEFT JOIN kept USING (r)"""
