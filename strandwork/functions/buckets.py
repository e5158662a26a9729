"""Windows sent to tasks as stretches of text: neighbours of one bucket travel together, two bits a letter.

A window's bucket is named by the least hash among its short words of both strands, so both strands of a k-mer share it and
so do most neighbours. A task holds whole buckets: it counts their k-mers for good, without rows for single windows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import packed as P

BUCKETS = 1 << 12
#: Windows of a stretch at most, stretches that a task gathers before it hands them on, and windows spelt at a time.
STRETCH, HELD, WINDOWS = 4096, 400_000, 1 << 20
#: Windows whose buckets are taken together.
TOGETHER = 1 << 18
_SENT = "home int, sizes binary, beside binary, letters binary, ids binary, places binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of numbers, all bits mixed."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def homes(codes: np.ndarray, k: int) -> np.ndarray:
    """The bucket of each window of k letters (0 to 3, others in windows that do not count)."""
    m = min(13, k // 2 + 1)
    least = _mixed(np.minimum(*P.roll(codes, m)))
    wide, size = k - m + 1, 1
    while 2 * size <= wide:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    n = len(codes) - k + 1
    return (np.minimum(least[:n], least[wide - size : wide - size + n]) & np.uint64(BUCKETS - 1)).astype(np.int32)


def _runs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of the given sizes, laid end to end: each element's run and its place in it."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _cut(body: bytes, k: int, more: int = 0):
    """(first window, windows, bucket, letters beside it, bytes, packed letters) of a buffer's stretches.

    more: so many letters come after each stretch, and how many of them are bases up to the first that is none, in place of the letters beside it.
    """
    codes = P._CODE[np.frombuffer(body, dtype=np.uint8)]
    bad = np.concatenate([[0], np.cumsum(codes > 3, dtype=np.int64)])
    place = np.flatnonzero(bad[k:] == bad[: len(bad) - k])
    if not len(place):
        return None
    # Hashes of letters in windows that count only: runs of such windows, put side by side.
    jump = np.diff(place) > 1
    edge = np.flatnonzero(jump)
    begin, last = place[np.append(0, edge + 1)], place[np.append(edge, len(place) - 1)]
    run, step = _runs(last - begin + k)
    home = homes(codes[begin[run] + step], k)[np.arange(len(place)) + (k - 1) * np.append(0, np.cumsum(jump))]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (np.diff(place) != 1) | (np.diff(home) != 0)
    at = np.arange(len(place)) - np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
    first = np.flatnonzero(at % STRETCH == 0)
    size = np.diff(np.append(first, len(place)))
    start = place[first]
    around = np.concatenate([[4], codes, [4, 4, 4]])
    if more:
        after, going = np.zeros(len(start), dtype=np.int64), np.ones(len(start), dtype=bool)
        for d in range(more):
            going &= around[np.minimum(start + size + k + d, len(around) - 1)] < 4
            after += going
        beside = after
    else:
        beside = around[start] * 8 + around[start + size + k]
    low = around[1:] & 3
    packed = low[:-3] << 6 | low[1:-2] << 4 | low[2:-1] << 2 | low[3:]
    n = (size + k + more + 2) // 4
    run, step = _runs(n)
    return start, size, home[first], beside.astype(np.uint8), n, packed[np.minimum(start[run] + 4 * step, len(packed) - 1)].astype(np.uint8)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value for each of the given ends in data."""
    offsets = np.concatenate([[0], ends * data.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _sent(held: list, tagged: bool):
    size, home, beside, n, ids, places = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2, 3, 5, 6))
    data = np.concatenate([x[4] for x in held])
    order = np.argsort(home, kind="stable")
    begin = (np.cumsum(n) - n)[order]
    run, step = _runs(n[order])
    letters = data[begin[run] + step]
    last = np.append(np.flatnonzero(np.diff(home[order])), len(order) - 1)
    ends = last + 1
    tag = [_binary(x[order], ends) for x in (ids, places)] if tagged else [pa.nulls(len(ends), pa.binary())] * 2
    columns = [pa.array(home[order][last]), _binary(size[order].astype(np.uint16), ends), _binary(beside[order], ends), _binary(letters, np.cumsum(n[order])[last]), *tag]
    return pa.RecordBatch.from_arrays(columns, names=["home", "sizes", "beside", "letters", "ids", "places"])


def _sending(batches, k: int, tagged: bool, known: bool = False, more: int = 0):
    held, count = [], 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False) if tagged else None
        for body, rows, starts, at in P._laid_out(P._texts(batch.column(batch.num_columns - 1)), k):
            made = _cut(body, k, more)
            if made is None:
                continue
            start, *rest = made
            part = np.searchsorted(at, start, side="right") - 1
            place = (starts[part] + start - at[part]).astype(np.int64)
            tag = (ids[rows[part]].astype(np.int64), ~place if known else place) if tagged else (start, start)
            held.append((*rest, *tag))
            count += len(start)
            if count >= HELD:
                yield _sent(held, tagged)
                held, count = [], 0
    if held:
        yield _sent(held, tagged)


class Group:
    """Stretches of whole buckets: sizes (windows), beside, packed letters, ids and places of their first windows."""

    def __init__(self, rows: list, name: int):
        join = lambda i, kind: np.frombuffer(b"".join(r[i] for r in rows), dtype=kind)
        self.name, self.sizes, self.beside, self.letters = name, join(0, np.uint16).astype(np.int64), join(1, np.uint8), join(2, np.uint8)
        self.tagged = rows[0][3] is not None
        if self.tagged:
            self.ids, self.places = join(3, np.int64), join(4, np.int64)

    def slices(self, k: int):
        """(first stretch, its end, letters, place of each window in them, stretch of each, its place there), about WINDOWS windows at a time."""
        n = (self.sizes + k + 2) // 4
        ends, done = np.cumsum(n), np.cumsum(self.sizes)
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + WINDOWS, side="right")))
            data = self.letters[ends[a] - n[a] : ends[b - 1]]
            letters = np.stack([data >> 6, data >> 4 & 3, data >> 2 & 3, data & 3], axis=1).reshape(-1)
            run, step = _runs(self.sizes[a:b])
            start = 4 * (ends[a:b] - n[a:b] - (ends[a] - n[a]))
            yield a, b, letters, start[run] + step, run, step
            a = b


    def codes(self, k: int):
        """(first stretch, its end, code of each window as it stands), about WINDOWS windows at a time: cut from the packed letters."""
        n = (self.sizes + k + 2) // 4
        begin, done = np.cumsum(n) - n, np.cumsum(self.sizes)
        packed = np.append(self.letters, np.zeros(9, dtype=np.uint8))
        eight = np.ndarray((len(packed) - 7,), dtype=">u8", buffer=packed, strides=(1,))
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + WINDOWS, side="right")))
            run, step = _runs(self.sizes[a:b])
            at, shift = begin[a:b][run] + (step >> 2), (2 * (step & 3)).astype(np.uint64)
            code = eight[at].astype(np.uint64) << shift | packed[at + 8].astype(np.uint64) >> (np.uint64(8) - shift)
            yield a, b, code >> np.uint64(64 - 2 * k)
            a = b


def _groups(batches, windows: int):
    rows, name, home, size = [], None, None, 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for h, *row in zip(*columns, strict=True):
            if rows and h != home and size >= windows:
                yield Group(rows, name)
                rows, size = [], 0
            if not rows:
                name = h
            home = h
            rows.append(row)
            size += int(np.frombuffer(row[0], dtype=np.uint16).sum())
    if rows:
        yield Group(rows, name)


def _in_groups(batches, work, k: int, together: int):
    for group in _groups(batches, together):
        yield from work(group, k)


def by_bucket(df: DataFrame, seq: str, k: int, work, schema: str, tag: str | None = None, known: DataFrame | None = None, more: int = 0) -> DataFrame:
    """work(Group, k) -> Arrow batches of the schema, over whole buckets of the valid windows of k letters of a column.

    tag: a column of longs that comes with every stretch, and so does the place (from 0) of its first window. Buckets are
    taken together up to about TOGETHER windows; each k-mer is in one group, whichever strand a text holds. known: further
    texts (a long, text) of the same buckets; their places come as ~place. more: letters that come after each stretch (_cut).
    """
    P.check(k + more)
    rows = df.select(*([tag] if tag else []), seq).mapInArrow(partial(_sending, k=k, tagged=tag is not None, more=more), _SENT)
    if known is not None:
        rows = rows.union(known.mapInArrow(partial(_sending, k=k, tagged=True, known=True, more=more), _SENT))
    return rows.repartition("home").sortWithinPartitions("home").mapInArrow(partial(_in_groups, work=work, k=k, together=TOGETHER), schema)


def _reduced(code: np.ndarray, *values):
    """Sorted distinct codes, and the values (a row a code each) added up."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.array([], dtype=np.int64)
    return code[first], *(np.add.reduceat(v[order], first, axis=0) if len(code) else v for v in values)


def counted(group: Group, k: int, both: bool = True, least: int = 1):
    """(code, cov) of the k-mers of a group that are met at least so often."""
    codes, counts = [], []
    for _, _, ahead in group.codes(k):
        code, n = np.unique(np.minimum(ahead, P.turned(ahead, k)) if both else ahead, return_counts=True)
        codes.append(code)
        counts.append(n)
    code, n = _reduced(np.concatenate(codes), np.concatenate(counts)) if len(codes) > 1 else (codes[0], counts[0])
    kept = n >= least
    yield pa.RecordBatch.from_arrays([pa.array(code[kept].view(np.int64)), pa.array(n[kept].astype(np.int64))], names=["code", "cov"])


def solid_by_tag(group: Group, k: int):
    """(tag, n): of each tag of a group how many of its windows are k-mers that are met twice or more; none without."""
    counts = [np.unique(np.minimum(*(x[place] for x in P.roll(letters, k))), return_counts=True) for _, _, letters, place, _, _ in group.slices(k)]
    code, n = _reduced(*(np.concatenate(x) for x in zip(*counts, strict=True)))
    for a, b, letters, place, run, _ in group.slices(k):
        ahead, rear = P.roll(letters, k)
        solid = n[np.searchsorted(code, np.minimum(ahead[place], rear[place]))] > 1
        tag, many = _reduced(group.ids[a:b], np.bincount(run[solid], minlength=b - a))
        yield pa.RecordBatch.from_arrays([pa.array(tag[many > 0]), pa.array(many[many > 0])], names=["tag", "n"])


def _met(group: Group, k: int):
    """(sorted codes of the canonical k-mers, times met, times met beside each letter: a column for each bit of a mask, the lowest first)."""
    parts = []
    for a, b, letters, place, run, step in group.slices(k):
        ahead, rear = P.roll(letters, k)
        ahead, rear = ahead[place], rear[place]
        same, beside = ahead <= rear, group.beside[a:b]
        left = np.where(step == 0, beside[run] >> 3, letters[np.maximum(place - 1, 0)]).astype(np.int64)
        right = np.where(step == group.sizes[a:b][run] - 1, beside[run] & 7, letters[np.minimum(place + k, len(letters) - 1)]).astype(np.int64)
        code, at, n = np.unique(np.where(same, ahead, rear), return_inverse=True, return_counts=True)
        cells = np.concatenate([(at * 8 + np.where(same, 3 - right, 4 + right))[right < 4], (at * 8 + np.where(same, 7 - left, left))[left < 4]])
        parts.append((code, n, np.bincount(cells, minlength=8 * len(code)).reshape(-1, 8)))
    return _reduced(*(np.concatenate([p[i] for p in parts]) for i in range(3))) if len(parts) > 1 else parts[0]


class _Solid:
    """The solid k-mers of a group and what lies beside them.

    code, cov, times (a column a mask bit); state: 0 no neighbour, 1 one of this group, 2 not of this group, so maybe not
    solid; to: a neighbour of this group as an oriented vertex (2 i is the i-th code as it stands, 2 i + 1 its reverse complement).
    """

    def __init__(self, group: Group, k: int):
        self.k, (all_codes, n, times) = k, _met(group, k)
        kept = np.flatnonzero(n > 1)
        number = np.full(len(n), -1)
        number[kept] = np.arange(len(kept))
        self.all, self.number = all_codes, number
        self.code, self.cov, self.times = all_codes[kept], n[kept], times[kept]
        self.state, self.to = np.zeros((len(kept), 8), dtype=np.int8), np.zeros((len(kept), 8), dtype=np.int64)
        for bit in range(8):
            row = np.flatnonzero(self.times[:, bit])
            c = self.code[row]
            if bit < 4:
                beside = (c & np.uint64((1 << 2 * (k - 1)) - 1)) << np.uint64(2) | np.uint64(3 - bit)
            else:
                beside = c >> np.uint64(2) | np.uint64((7 - bit) << 2 * (k - 1))
            own = np.minimum(beside, P.turned(beside, k))
            at = np.minimum(np.searchsorted(all_codes, own), len(all_codes) - 1)
            here = all_codes[at] == own
            self.state[row, bit] = np.where(~here, 2, np.where(number[at] >= 0, 1, 0))
            self.to[row, bit] = 2 * number[at] + (own != beside)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The numbers of canonical k-mers of this group, -1 where one is not solid."""
        return self.number[np.searchsorted(self.all, codes)]


def masked(group: Group, k: int):
    """(code, sure, open) of the solid k-mers of a group: mask bits of solid neighbours, and of those that another group knows."""
    s = _Solid(group, k)
    bits = 1 << np.arange(8)
    columns = [s.code.view(np.int64), *(((s.state == x) @ bits).astype(np.int32) for x in (1, 2))]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["code", "sure", "open"])


def _paths(s: _Solid) -> tuple[np.ndarray, np.ndarray]:
    """(head, rank) of every oriented vertex on its path of links that are sure; vertices on circles are paths of their own."""
    n = 2 * len(s.code)
    degree, after = np.zeros(n, dtype=np.int64), np.full(n, -1)
    for strand, columns in ((0, slice(0, 4)), (1, slice(4, 8))):
        met = s.state[:, columns] > 0
        degree[strand::2] = met.sum(axis=1)
        only = np.argmax(met, axis=1)
        rows = np.arange(len(s.code))
        sure = (degree[strand::2] == 1) & (s.state[:, columns][rows, only] == 1)
        after[strand::2] = np.where(sure, s.to[:, columns][rows, only] ^ strand, -1)
    v = np.flatnonzero(after >= 0)
    w = after[v]
    good = (degree[w ^ 1] == 1) & (w != v) & (w != v ^ 1)
    before = np.full(n, -1)
    before[w[good]] = v[good]
    head, rank = np.where(before >= 0, before, np.arange(n)), (before >= 0).astype(np.int64)
    for _ in range(max(n, 1).bit_length() + 1):
        if not (before[head] >= 0).any():
            break
        head, rank = head[head], rank + rank[head]
    circle = before[head] >= 0
    return np.where(circle, np.arange(n), head), np.where(circle, 0, rank)


PIECES = "kind int, id long, seq string, n long, what long, place int, sure boolean"


def _piece_rows(kind: int, **columns):
    n = len(columns["id"])
    types = {"kind": pa.int32(), "id": pa.int64(), "seq": pa.string(), "n": pa.int64(), "what": pa.int64(), "place": pa.int32(), "sure": pa.bool_()}
    columns["kind"] = np.full(n, kind)
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if name not in columns else columns[name] if isinstance(columns[name], pa.Array) else pa.array(columns[name], t) for name, t in types.items()], names=list(types))


def pieced(group: Group, k: int):
    """Rows of three kinds (PIECES): the solid k-mers of a group joined to pieces, their ends, and where texts begin on them. k is odd.

    0: a piece (id, seq, n: its windows in the texts); 1: a neighbour at an end (id, place: 1 the last k-mer's, 0 the
    first's, what: the k + 1 letters of both on the lesser strand, n: times met, sure: it is of this group); 2: a tag
    (what), the place of the first solid window that this group knows of it, and the piece (id) that holds that.
    """
    s = _Solid(group, k)
    if not len(s.code):
        return
    head, rank = _paths(s)
    n = len(head)
    order = np.lexsort((rank, head))
    first = np.flatnonzero(rank[order] == 0)
    size = np.diff(np.append(first, n))
    start, end = order[first], order[first + size - 1]
    kept = start < end ^ 1
    piece, step = _runs(size)
    order, step, piece = order[kept[piece]], step[kept[piece]], (np.cumsum(kept) - 1)[piece[kept[piece]]]
    start, end, size = start[kept], end[kept], size[kept]
    ids = (np.int64(group.name) << 32) + 1 + np.arange(len(start))
    turned = P.turned(s.code, k)
    code = lambda v: np.where(v & 1, turned[v >> 1], s.code[v >> 1])
    length = size + k - 1
    begin = np.cumsum(length) - length
    text = np.empty(int(length.sum()), dtype=np.uint8)
    whole = code(start)
    for i in range(k):
        text[begin + i] = whole >> np.uint64(2 * (k - 1 - i)) & np.uint64(3)
    text[begin[piece] + step + k - 1] = code(order) & np.uint64(3)
    letters = np.frombuffer(b"ACGT", dtype=np.uint8)[text]
    seq = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(np.append(begin, len(text)).astype(np.int64)), pa.py_buffer(letters)]).cast(pa.string())
    yield _piece_rows(0, id=ids, seq=seq, n=np.add.reduceat(s.cov[order >> 1], np.cumsum(size) - size))
    for side, v in ((1, end), (0, start)):
        i, flipped, whole = v >> 1, (v & 1).astype(bool), code(v)
        for b in range(4):
            bit = np.where(flipped, 4 + b, 3 - b) if side else np.where(flipped, b, 7 - b)
            at = np.flatnonzero(s.state[i, bit])
            edge = whole[at] << np.uint64(2) | np.uint64(b) if side else whole[at] | np.uint64(b << 2 * k)
            yield _piece_rows(1, id=ids[at], what=np.minimum(edge, P.turned(edge, k + 1)).view(np.int64), place=np.full(len(at), side), n=s.times[i, bit][at], sure=(s.state[i, bit] == 1)[at])
    if group.tagged:
        of = np.empty(len(s.code), dtype=np.int64)
        of[order >> 1] = ids[piece]
        for a, _, letters, place, run, step in group.slices(k):
            ahead, rear = P.roll(letters, k)
            found = s.find(np.minimum(ahead[place], rear[place]))
            hit = np.flatnonzero(found >= 0)
            hit = hit[np.unique(run[hit], return_index=True)[1]]
            yield _piece_rows(2, id=of[found[hit]], what=group.ids[a + run[hit]], place=group.places[a + run[hit]] + step[hit])


RUNS = "read_id long, pos int, n int, node long, off int"


def located(group: Group, k: int):
    """Rows (RUNS): of the group's stretches of reads the windows that known texts hold as they stand; adjacent ones on adjacent places of one text are a run of n.

    No window stands in the known texts twice. pos counts from 1, off from 0.
    """
    known = group.places < 0
    codes, at = [], []
    for a, b, letters, place, run, step in group.slices(k):
        of = known[a:b][run]
        codes.append(P.roll(letters, k)[0][place[of]])
        at.append(np.stack([group.ids[a:b][run[of]], ~group.places[a:b][run[of]] + step[of]]))
    code, (node, off) = np.concatenate(codes), np.concatenate(at, axis=1)
    order = np.argsort(code)
    code, node, off = code[order], node[order], off[order]
    if not len(code):
        return
    for a, b, letters, place, run, step in group.slices(k):
        of = ~known[a:b][run]
        run, step, seen = run[of], step[of], P.roll(letters, k)[0][place[of]]
        found = np.minimum(np.searchsorted(code, seen), len(code) - 1)
        hit = code[found] == seen
        run, step, found = run[hit], step[hit], found[hit]
        if not len(run):
            continue
        on, there = node[found], off[found]
        new = np.ones(len(run), dtype=bool)
        new[1:] = (np.diff(run) != 0) | (np.diff(step) != 1) | (np.diff(on) != 0) | (np.diff(there) != 1)
        first = np.flatnonzero(new)
        columns = [group.ids[a:b][run[first]], (group.places[a:b][run[first]] + step[first] + 1).astype(np.int32), np.diff(np.append(first, len(run))).astype(np.int32), on[first], there[first].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["read_id", "pos", "n", "node", "off"])


def met(group: Group, k: int, more: int):
    """(query_id, size, n): of each read of a group how often the known texts hold its windows of k to k + more letters as they stand, added up; none without.

    A window of more letters is in the bucket of its first k.
    """
    known = group.places < 0

    def windows(of_known: bool):
        """Of each slice (first stretch, its end, for each size the codes of the windows of known texts or of reads and their stretches)."""
        for a, b, letters, place, run, step in group.slices(k + more):
            of = known[a:b][run] == of_known
            place, run, step = place[of], run[of], step[of]
            left = group.sizes[a:b][run] - 1 - step + group.beside[a:b][run]
            made = []
            for d in range(more + 1):
                there = left >= d
                made.append((P.roll(letters, k + d)[0][place[there]], run[there]))
            yield a, b, made

    parts = [made for _, _, made in windows(True)]
    codes = [np.unique(np.concatenate([p[d][0] for p in parts]), return_counts=True) for d in range(more + 1)]
    for a, b, made in windows(False):
        for d, ((code, n), (seen, run)) in enumerate(zip(codes, made, strict=True)):
            if not len(code) or not len(seen):
                continue
            at = np.minimum(np.searchsorted(code, seen), len(code) - 1)
            total = np.bincount(run, np.where(code[at] == seen, n[at], 0), minlength=b - a).astype(np.int64)
            tag, total = _reduced(group.ids[a:b][total > 0], total[total > 0])
            yield pa.RecordBatch.from_arrays([pa.array(tag), pa.array(np.full(len(tag), k + d, dtype=np.int32)), pa.array(total)], names=["query_id", "size", "n"])
