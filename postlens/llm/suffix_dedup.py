"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier in the corpus. Not every suffix has to be sorted for that: of the
``LENGTH - ANCHOR + 1`` strings of ``ANCHOR`` bytes in such a window the one of smallest hash is its anchor, so equal windows have equal anchors at
equal places, and about one position in 35 is one. The steps are:

1. Anchors whose bytes occur once in the corpus are dropped by hash counts (packed blocks, fragment by fragment). What remains are
   anchors in repeated text. Where a block holds a hash twice or more it is known to repeat, so only one occurrence goes to the fragment.
2. Each task sorts the suffixes at its anchors, cut where no window reaches further (``LENGTH`` bytes on, then the bytes before the anchor, backwards), and front-codes
   the runs: a suffix is the length of its common prefix with the one before it and the rest. Of equal contexts in a run only the earliest is exchanged; the others
   are repeated as a whole already, so a passage in any share of the corpus is as many rows as there are runs. Runs are exchanged by ranges of
   suffixes, split at anchors taken from a bounded sample of documents (it moves work between tasks, not results).
3. A range's runs are merged by a loser tree. Each entry carries the length of its common prefix with the last suffix put out; where two
   lengths differ the longer one wins at once, and else comparison goes on behind the known prefix, which is never read again.
4. In the merged order equal contexts lie together with their common prefix at full length: all but the earliest are repeated as a whole.
   Suffixes that share the anchor but differ further on mark the ends of repeated passages: there each of the windows around the
   anchor is told by its hash, and the earliest of equal ones stays.

Documents are ordered by id; among rows of equal id by a hash of the text, and rows equal in both are one document whose result each of them gets. Null text
counts as empty; a null id comes after all others; texts under ``LENGTH`` bytes repeat nothing; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .ngram_join import _eight, _five, _LOW, _packed, _unpacked
from .shingles import _BYTE, _INVERSE, _ROOT, _kept_powers, mix, powers
from .storage import in_arrow, written

LENGTH, ANCHOR = 100, 32
SPAN = LENGTH - ANCHOR + 1
BEFORE = SPAN - 1
KEY = BEFORE + LENGTH
#: Anchors for a fragment's task, anchors that a block gathers, suffixes in a sorted run, suffixes for a range's task, documents in the sample.
FRAGMENT, BLOCK, RUN, RANGE, SAMPLED = 2_000_000, 1_000_000, 80_000, 150_000, 2_000
#: Suffixes whose bytes are gathered at once.
SLICE = 4_096


def _raw(docs: DataFrame) -> DataFrame:
    """doc (the place in order: id, nulls last), hash of the text, bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).alias("h"), text.cast("binary").alias("raw"))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over x[i : i + width] for each i that has so many."""
    done, out = 1, x
    while 2 * done <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(x) - width + 1], out[width - done : width - done + len(x) - width + 1]) if done < width else out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and hash of all anchors, in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(joined) < LENGTH:
        return none
    starts = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(_BYTE[joined] * _kept_powers(_ROOT, len(joined)), out=sums[1:])
        hashes = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * _kept_powers(_INVERSE, len(joined) - ANCHOR + 1)) | np.uint64(1)
    least = _slide(hashes, SPAN, np.minimum)
    # windows that cross from one text to the next don't count
    ends = np.cumsum(sizes)[:-1]
    if len(ends):
        crossing = np.zeros(len(least) + 1, np.int64)
        np.add.at(crossing, np.clip(ends - LENGTH + 1, 0, len(least)), 1)
        np.add.at(crossing, np.clip(ends, 0, len(least)), -1)
        least[np.cumsum(crossing)[:-1] > 0] = 0
    padded = np.zeros(len(hashes) + BEFORE, np.uint64)
    padded[BEFORE : BEFORE + len(least)] = least
    at = np.flatnonzero(_slide(padded, SPAN, np.maximum)[: len(hashes)] == hashes)
    owner = np.searchsorted(starts + sizes, at, side="right")
    return owner, at - starts[owner], hashes[at]


def _by_slot(slot: np.ndarray, owner: np.ndarray, docs: np.ndarray, hs: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """For each slot a block: id and hash of each document once, how many items it has, and the columns of the items. Items come sorted by owner."""
    order = np.argsort(slot, kind="stable")
    slot, owner, more = slot[order], owner[order], [m[order] for m in more]
    edges = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1], [True]))) if len(slot) else np.zeros(0, np.int64)
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = owner[low:high]
        at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        yield int(slot[low]), _packed(docs[own[at]], hs[own[at]], np.diff(np.append(at, high - low)).astype(np.uint32), *[_five(m[low:high]) if m.dtype == np.uint64 else m[low:high] for m in more])


def _here(docs: np.ndarray, count: int) -> np.ndarray:
    """Negative slots, by document, of what is settled where it was found."""
    return -1 - (mix(docs.view(np.uint64)) % np.uint64(count)).astype(np.int32)


def _posted(count: int):
    """(fragment, block): hashes and places of the anchors of a task's documents. A hash that a block holds twice or more is posted once; the places of the others go by document."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        sizes = [len(x[0]) for x in held]
        docs, hs = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        shift = np.repeat(np.cumsum(sizes) - sizes, [len(x[2]) for x in held])
        owner, place, values = np.concatenate([x[2] for x in held]) + shift, np.concatenate([x[3] for x in held]).astype(np.uint32), np.concatenate([x[4] for x in held])
        order = np.argsort(values)
        ordered = values[order]
        same = np.concatenate(([False], ordered[1:] == ordered[:-1], [False]))
        again, known = np.zeros(len(values), bool), np.zeros(len(values), bool)
        again[order], known[order] = same[:-1], same[:-1] | same[1:]
        sent = ~again
        rows = list(_by_slot((values[sent] % np.uint64(count)).astype(np.int32), owner[sent], docs, hs, values[sent] // np.uint64(count) & _LOW, place[sent]))
        rows += _by_slot(_here(docs[owner[known]], count), owner[known], docs, hs, place[known])
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["fragment", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            docs, hs = (batch.column(i).to_numpy() for i in (0, 1))
            for low, high, texts in shingles.slices(batch.column(2)):
                owner, place, values = anchors(texts)
                held.append((docs[low:high], hs[low:high], owner, place, values))
                size += len(values)
                if size >= BLOCK:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """doc, h, places of one fragment's anchors whose hash occurs more than once; what was known before the exchange passes as it is."""
    here = table.column("fragment")[0].as_py() < 0
    parts = [_unpacked(x.as_py(), np.int64, np.int64, np.uint32, *([] if here else [np.uint8]), np.uint32) for x in table.column("block")]
    docs, hs, k, place = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, -1))
    use = np.ones(len(place), bool)
    if not here:
        tokens = _eight(np.concatenate([p[3] for p in parts]))
        order = np.argsort(tokens)
        ordered = tokens[order]
        same = ordered[1:] == ordered[:-1]
        use[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    del parts
    owner = np.repeat(np.arange(len(docs)), k)[use]
    at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    own = owner[at]
    places = pa.ListArray.from_arrays(pa.array(np.append(at, len(owner)), pa.int32()), pa.array(place[use].astype(np.int32)))
    return pa.table({"doc": pa.array(docs[own]), "h": pa.array(hs[own]), "places": places})


def contexts(joined: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (rows of KEY bytes, padded with 0), bytes before and bytes from the anchor on, of anchors at ``place`` in texts that begin at ``begin`` of ``joined``."""
    left, right = np.minimum(BEFORE, place), np.minimum(LENGTH, size - place)
    keys = np.zeros((len(place), KEY), np.uint8)
    j = np.arange(KEY, dtype=np.int32)[None, :]
    for low in range(0, len(place), SLICE):
        part = slice(low, low + SLICE)
        r = right[part].astype(np.int32)[:, None]
        at = np.where(j < r, j, r - 1 - j) + (begin[part] + place[part])[:, None]
        found = joined[np.clip(at, 0, max(len(joined) - 1, 0))]
        found[j >= (left + right)[part][:, None]] = 0
        keys[part] = found
    return keys, left, right


def front_coded(keys: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: common prefix with the one before, and the rests joined."""
    prefix = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        differ = keys[1:] != keys[:-1]
        prefix[1:] = np.where(differ.any(1), differ.argmax(1), KEY)
        prefix[1:] = np.minimum(prefix[1:], np.minimum(lengths[1:], lengths[:-1]))
    j = np.arange(KEY, dtype=np.int16)[None, :]
    return prefix.astype(np.uint8), keys[(j >= prefix[:, None].astype(np.int16)) & (j < lengths[:, None].astype(np.int16))]


def _settled(again: np.ndarray, owner: np.ndarray, docs: np.ndarray, hs: np.ndarray, start: np.ndarray, end: np.ndarray, count: int) -> Iterator[tuple[int, bytes]]:
    """Blocks, by document, of the stretches that an earlier context of the run repeats."""
    at = np.flatnonzero(again)
    at = at[np.lexsort((start[at], owner[at]))]
    yield from _by_slot(_here(docs[owner[at]], count), owner[at], docs, hs, start[at].astype(np.uint32), end[at].astype(np.uint32))


def _runs(splits: list[bytes]):
    """(range, block): sorted front-coded runs of a task's suffixes, cut by range."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs, hs, places, texts = [], [], [], []
        for d, h, p, t in held:
            docs.append(d)
            hs.append(h)
            places.append(p)
            texts.append(t)
        sizes = np.array([len(t) for t in texts], np.int64)
        many = np.array([len(p) for p in places])
        owner = np.repeat(np.arange(len(texts)), many)
        place = np.concatenate(places).astype(np.int64)
        keys, left, right = contexts(np.frombuffer(b"".join(texts), np.uint8), (np.cumsum(sizes) - sizes)[owner], sizes[owner], place)
        docs, hs = np.array(docs, np.int64), np.array(hs, np.int64)
        # by place first, so that of equal contexts the earliest comes first in the stable sort
        turn = np.lexsort((place, hs[owner], docs[owner]))
        order = turn[np.argsort(keys[turn].view(f"S{KEY}").reshape(-1), kind="stable")]
        keys, left, right, owner, place = keys[order], left[order], right[order], owner[order], place[order]
        # padding hides the lengths, so only neighbours of one length are equal; others in between cost an exchange, not a result
        again = np.concatenate(([False], (keys[1:] == keys[:-1]).all(1) & (left[1:] == left[:-1]) & (right[1:] == right[:-1])))
        rows = list(_settled(again, owner, docs, hs, place - left, place + right, max(16, len(splits) + 1)))
        keys, left, right, owner, place = (x[~again] for x in (keys, left, right, owner, place))
        heads = np.ascontiguousarray(keys[:, :ANCHOR]).view(f"S{ANCHOR}").reshape(-1)
        part = np.searchsorted(np.array(splits, f"S{ANCHOR}"), heads, side="right") if splits else np.zeros(len(heads), np.int64)
        edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            prefix, rest = front_coded(keys[low:high], (left + right)[low:high])
            own, number = np.unique(owner[low:high], return_inverse=True)
            rows.append((int(part[low]), _squeezed(_packed(docs[own], hs[own], number.astype(np.uint32), place[low:high].astype(np.uint32), left[low:high].astype(np.uint8), right[low:high].astype(np.uint8), prefix, rest))))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            docs, hs = (batch.column(i).to_numpy() for i in (0, 1))
            lists = batch.column(3)
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i in range(len(docs)):
                held.append((docs[i], hs[i], flat[ends[i] : ends[i + 1]], batch.column(2)[i].as_py()))
                size += int(ends[i + 1] - ends[i])
                if size >= RUN:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _squeezed(block: bytes) -> bytes:
    """Length and compressed bytes: suffixes of text take about half, which the exchange of runs is mostly made of."""
    return len(block).to_bytes(8, "little") + pa.compress(block, codec="zstd", asbytes=True)


def _opened(block: bytes) -> bytes:
    return pa.decompress(block[8:], decompressed_size=int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True)


def _expanded(prefix: list[int], lengths: list[int], rest: bytes) -> list[bytes]:
    out, at, last = [], 0, b""
    for p, n in zip(prefix, lengths, strict=True):
        if p == n and n == len(last):
            out.append(last)
            continue
        stop = at + n - p
        last = last[:p] + rest[at:stop]
        at = stop
        out.append(last)
    return out


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes aren't looked at."""
    x, y = a[known:], b[known:]
    n = min(len(x), len(y))
    apart = int.from_bytes(x[:n]) ^ int.from_bytes(y[:n])
    return known + n - (apart.bit_length() + 7) // 8


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Order (numbers through all runs) and common prefixes with the suffix before, by a loser tree over front-coded runs (keys, prefixes)."""
    base, total = [], 0
    for keys, _ in runs:
        base.append(total)
        total += len(keys)
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * len(runs)
    key: list[bytes | None] = [(runs[i][0][0] if runs[i][0] else None) if i < len(runs) else None for i in range(k)]
    prefix = [0] * k  # with the last suffix put out

    def better(i: int, j: int) -> tuple[int, int]:
        """(winner, loser) of two entries; the loser's prefix becomes that with the winner."""
        a, b = key[i], key[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        p, q = prefix[i], prefix[j]
        if p != q:
            return (i, j) if p > q else (j, i)
        n = _common(a, b, p)
        if a[n:] <= b[n:]:
            prefix[j] = n
            return i, j
        prefix[i] = n
        return j, i

    tree = [0] * k
    level = list(range(k))
    width = k
    while width > 1:
        nxt = []
        for m in range(0, width, 2):
            win, lose = better(level[m], level[m + 1])
            tree[(width + m) // 2] = lose
            nxt.append(win)
        level, width = nxt, width // 2
    win = level[0]
    order, common = [], []
    push_order, push_common = order.append, common.append
    while key[win] is not None:
        i = at[win]
        push_order(base[win] + i)
        push_common(prefix[win])
        keys, front = runs[win]
        at[win] = i = i + 1
        if i < len(keys):
            key[win], prefix[win] = keys[i], front[i]
        else:
            key[win], prefix[win] = None, -1
        node = (k + win) // 2
        while node:
            j = tree[node]
            a, b = key[win], key[j]
            if a is None:
                if b is not None:
                    tree[node], win = win, j
            elif b is not None:
                p, q = prefix[win], prefix[j]
                if p < q:
                    tree[node], win = win, j
                elif p == q:
                    n = _common(a, b, p)
                    if a[n:] <= b[n:]:
                        prefix[j] = n
                    else:
                        prefix[win] = n
                        tree[node], win = win, j
            node //= 2
    return order, common


def covered(keys: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts in order of place, grouped by anchor: first and last window (by start, 0 is BEFORE bytes ahead of the anchor) that an earlier one has too; -1 where none.

    All windows around an anchor overlap, so what repeats of them covers one stretch.
    """
    first, last = np.full(len(keys), -1), np.full(len(keys), -1)
    if not len(keys):
        return first, last
    j = np.arange(KEY)
    at = j[None, :] - BEFORE
    source = np.where(at >= 0, at, right[:, None] - 1 - at)
    text = np.take_along_axis(keys, np.clip(source, 0, KEY - 1), 1)
    text[(at < -left[:, None]) | (at >= right[:, None])] = 0
    with np.errstate(over="ignore"):
        sums = np.zeros((len(keys), KEY + 1), np.uint64)
        np.cumsum(_BYTE[text] * powers(_ROOT, KEY)[None, :], axis=1, out=sums[:, 1:])
        windows = sums[:, LENGTH:] - sums[:, : SPAN]
        c = np.arange(SPAN)
        values = mix(mix(windows) + group.astype(np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93) + c.astype(np.uint64)[None, :] * np.uint64(0xA0761D6478BD642F))
    valid = (c[None, :] >= BEFORE - left[:, None]) & (c[None, :] + LENGTH <= BEFORE + right[:, None])
    flat = np.flatnonzero(valid.reshape(-1))
    _, earliest = np.unique(values.reshape(-1)[flat], return_index=True)
    again = np.ones(len(flat), bool)
    again[earliest] = False
    marked = np.zeros(valid.shape, bool)
    marked.reshape(-1)[flat[again]] = True
    some = marked.any(1)
    first[some] = marked[some].argmax(1)
    last[some] = SPAN - 1 - marked[some][:, ::-1].argmax(1)
    return first, last


def _spans(table: pa.Table) -> pa.Table:
    """doc, h, starts, ends of what repeats, of one range of suffixes; what was settled before the exchange passes as it is."""
    if table.column("part")[0].as_py() < 0:
        parts = [_unpacked(x.as_py(), np.int64, np.int64, np.uint32, np.uint32, np.uint32) for x in table.column("block")]
        doc, h, k, start, end = (np.concatenate([p[i] for p in parts]) for i in range(5))
        return _stretches(np.repeat(doc, k), np.repeat(h, k), start.astype(np.int64), end.astype(np.int64))
    kinds = (np.int64, np.int64, np.uint32, np.uint32, np.uint8, np.uint8, np.uint8, np.uint8)
    blocks = [_unpacked(_opened(x), *kinds) for x in table.column("block").to_pylist()]
    runs, docs, hs, places, lefts, rights = [], [], [], [], [], []
    for d, h, number, place, left, right, prefix, rest in blocks:
        runs.append((_expanded(prefix.tolist(), (left.astype(np.int64) + right).tolist(), rest.tobytes()), prefix.tolist()))
        docs.append(d[number])
        hs.append(h[number])
        places.append(place)
        lefts.append(left)
        rights.append(right)
    del blocks
    order, common = merged(runs)
    flat = [key for keys, _ in runs for key in keys]
    order, common = np.array(order, np.int64), np.array(common, np.int64)
    doc, h, place, left, right = (np.concatenate(x)[order].astype(np.int64) for x in (docs, hs, places, lefts, rights))
    same = np.zeros(len(order), bool)
    same[1:] = (common[1:] == (left + right)[1:]) & (left[1:] == left[:-1]) & (right[1:] == right[:-1])
    context, group = np.cumsum(~same), np.cumsum(common < ANCHOR)
    by_place = np.lexsort((place, h, doc, context))
    first = by_place[np.flatnonzero(np.concatenate(([True], context[by_place][1:] != context[by_place][:-1])))]
    start, end = place - left, place + right
    whole = np.ones(len(order), bool)
    whole[first] = False
    # contexts that share an anchor: only their earliest places are told window by window
    alone = np.bincount(group[first], minlength=group[-1] + 1)
    open_ = first[alone[group[first]] > 1]
    open_ = open_[np.lexsort((group[open_],))]
    use = whole.copy()
    edges = np.flatnonzero(np.concatenate(([True], group[open_][1:] != group[open_][:-1], [True]))) if len(open_) else np.zeros(1, np.int64)
    low = 0
    while low < len(open_):
        high = int(edges[min(np.searchsorted(edges, low + 8_000), len(edges) - 1)])
        some = open_[low:high]
        some = some[np.lexsort((place[some], h[some], doc[some]))]
        keys = np.frombuffer(b"".join([flat[i].ljust(KEY, b"\0") for i in order[some].tolist()]), np.uint8).reshape(-1, KEY)
        a, b = covered(keys, left[some], right[some], group[some])
        hit = some[a >= 0]
        start[hit] = place[hit] - BEFORE + a[a >= 0]
        end[hit] = place[hit] - BEFORE + b[a >= 0] + LENGTH
        use[hit] = True
        low = high
    return _stretches(doc[use], h[use], start[use], end[use])


def _stretches(doc: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    """doc, h, starts, ends: the stretches of each document in order."""
    by = np.lexsort((start, h, doc))
    doc, h, start, end = doc[by], h[by], start[by], end[by]
    at = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))) if len(doc) else np.zeros(0, np.int64)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)), pa.int32()), pa.array(x, pa.int64()))
    return pa.table({"doc": pa.array(doc[at]), "h": pa.array(h[at]), "starts": lists(start), "ends": lists(end)})


def united(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of what the intervals cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b"".join(parts)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for raw, starts, ends in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            runs = united(starts or [], ends or [])
            rows.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(raw, runs)).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _splits(rows: DataFrame, count: int, total: int) -> list[bytes]:
    """Ends of ``count`` ranges of anchors, from about SAMPLED documents chosen by hash."""
    every = max(1, total // SAMPLED)
    few = rows.where(F.pmod(F.xxhash64(F.lit(3), "doc", "h"), F.lit(every)) == 0)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            owner, place, _ = anchors(texts)
            yield pa.RecordBatch.from_arrays([pa.array([texts[o][p : p + ANCHOR] for o, p in zip(owner.tolist(), place.tolist(), strict=True)][::16], pa.binary())], ["head"])

    found = sorted(few.select("raw").mapInArrow(heads, "head binary").distinct().toArrow().column("head").to_pylist())
    return sorted({found[i * len(found) // count] for i in range(1, count)}) if found else []


def spans(docs: DataFrame) -> DataFrame:
    """doc, h, starts, ends: all stretches of each document that repeat (they may overlap)."""
    rows = _raw(docs).drop("doc_id")
    spark = docs.sparkSession
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw")).alias("b")).first()
    guess = (size["b"] or 0) // 34
    count = max(16, -(-guess // FRAGMENT))
    parts = max(count, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = in_arrow(rows, _posted(count), "fragment int, block binary").repartition(parts, "fragment")
    again = written(blocks.groupBy("fragment").applyInArrow(_repeated, "doc long, h long, places array<int>"), "anchors")
    many = again.agg(F.sum(F.size("places"))).first()[0] or 0
    ranges = max(24, -(-many // RANGE))
    splits = _splits(rows, ranges, size["n"])
    lists = again.groupBy("doc", "h").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    # rows of equal id and text are one document, so one of them stands for all, and each place that they posted counts once
    joined = rows.join(lists, ["doc", "h"]).dropDuplicates(["doc", "h"]).select("doc", "h", "raw", "places")
    once = in_arrow(joined, _runs(splits), "part int, block binary")
    return written(once.repartition(max(ranges, parts), "part").groupBy("part").applyInArrow(_spans, "doc long, h long, starts array<long>, ends array<long>"), "spans")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    found = spans(docs).groupBy("doc", "h").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    rows = _raw(docs).join(found, ["doc", "h"], "left").select("doc_id", "raw", "starts", "ends")
    return in_arrow(rows, _digested, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, kept: the bytes that stay of every row (cut at bytes, so not always valid UTF-8)."""
    found = spans(docs).groupBy("doc", "h").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_kept(raw, united(a or [], b or [])) for raw, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], ["doc_id", "kept"])

    return in_arrow(_raw(docs).join(found, ["doc", "h"], "left").select("doc_id", "raw", "starts", "ends"), run, "doc_id long, kept binary")
