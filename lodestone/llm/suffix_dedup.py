"""Operator 3: removal of repeated byte strings by a hash-compared suffix sort.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier (smaller doc_id, or earlier in the same document).

1. Anchors. In every LENGTH-byte string the 32-byte string of smallest hash is its anchor, so equal strings have equal anchors at the
   same place. Neighbouring strings share anchors: about 3 % of all positions are anchors, each standing for a stretch of starts.
2. Stretches of one content are one item of the sort: the first of them stands for all. A task settles those of its own slice of text
   before the shuffle, so a stretch that very many documents share sends one row a slice; the others meet by (anchor, hash of the bytes).
   Repeated stretches that follow one another in both documents form runs. Each run's bytes are read in both places, and their SHA-256
   compared; where one differs (a collision of the 61-bit hash), all is done again with another hash.
3. The distinct stretches that share an anchor get their bytes and are suffix-sorted: a bottom-up mergesort compares suffixes by the
   length of their common extension, found by binary search over prefix polynomial hashes, and by the byte behind it. The order is
   verified byte by byte between neighbours (a wrong one is sorted again by bytes alone); all but the first of equal strings are removed.
   Strings of an anchor with more than `most` distinct stretches are sorted where they are first, and what is left of them is dealt over
   tasks by the strings' hashes and sorted there; so no anchor is held by one task. The results are the same.
4. Removed runs are joined with their documents and cut out.

Texts of more than PIECE bytes are read in chunks that overlap by LENGTH - 1 bytes.

Defined results: null text counts as empty; null doc_id comes before all others and stays null; texts shorter than LENGTH bytes lose
nothing; rows that repeat doc_id and text are one document and get equal results; rows that repeat a doc_id with other texts are ordered
by a hash of the text; extra columns aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, skew, textnp

ANCHOR = 32
CHUNK = 3 << 20
#: Bytes of a slice whose places are hashed at a time (about 100 bytes of memory each).
PIECE = 1 << 19
#: Distinct stretches of one anchor beyond which its strings are dealt over tasks.
MOST = 2000
#: Largest number of such anchors that may be broadcast (8 bytes each).
BROADCAST_ROWS = 500_000
#: `first` is -1 where nothing is decided yet. Of a decided run, anchor and bytes hold the first one's `same` and `doc`, shape its starts.
STRETCH = "anchor long, bytes long, doc long, same long, start int, shape int, first int"
RUN = "doc long, same long, from int, n int, first_doc long, first_same long, first int"
MERSENNE = np.uint64((1 << 61) - 1)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    mid = ah * bl + al * bh
    total = ((ah * bh) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << half) + al * bl
    total = (total & MERSENNE) + (total >> np.uint64(61))
    return np.where(total >= MERSENNE, total - MERSENNE, total)


def _prime_powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The seed's base to the powers i and -i modulo 2**61 - 1, for i < n at least."""
    if seed not in _tables or len(_tables[seed][0]) < n:
        base = int.from_bytes(hashlib.sha256(f"base {seed}".encode()).digest()[:8], "big") % (int(MERSENNE) - 2) + 2
        found = []
        for b in (base, pow(base, -1, int(MERSENNE))):
            out = np.ones(1 << max(16, int(n).bit_length()), np.uint64)
            width = 1
            while width < len(out):
                out[width : 2 * width] = _times(out[:width], np.uint64(pow(b, width, int(MERSENNE))))
                width *= 2
            found.append(out)
        _tables[seed] = (found[0], found[1])
    return _tables[seed]


def _range_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """The polynomial hash modulo 2**61 - 1 of each range data[a:b]."""
    up, down = _prime_powers(len(data) + 1, seed)
    value = data.astype(np.uint64) + np.uint64(1)
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    parts = []
    for powers in (up[: len(data)] & low, up[: len(data)] >> half):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value * powers, out=sums[1:])
        part = sums[b] - sums[a]
        part = (part & MERSENNE) + (part >> np.uint64(61))
        parts.append(np.where(part >= MERSENNE, part - MERSENNE, part))
    whole = parts[0] + _times(parts[1], np.full(1, 1 << 31, np.uint64))
    return _times(np.where(whole >= MERSENNE, whole - MERSENNE, whole), down[a])


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = textnp.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, seed: int = 0) -> dict[str, np.ndarray]:
    """row, first start, number of starts, place of the anchor after the first start, anchor hash, hash of the stretch's bytes."""
    names = ("row", "start", "n", "place", "anchor", "bytes")
    n, window = len(data), length - ANCHOR + 1
    if n < length:
        return {k: np.zeros(0, np.int64) for k in names}
    sums, down = prefix_hashes(data)
    hashes = textnp.mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1])
    low = np.uint64((1 << max(24, int(n).bit_length())) - 1)
    tagged = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)  # ties: the first place
    least, width = tagged, 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    m = len(tagged) - window + 1
    least = np.minimum(least[:m], least[window - width : window - width + m])
    at = (least & low).astype(np.int64)
    start = np.arange(m)
    row = np.searchsorted(offsets, start, "right") - 1
    inside = start + length <= offsets[row + 1]
    start, at, row = start[inside], at[inside], row[inside]
    if not len(start):
        return {k: np.zeros(0, np.int64) for k in names}
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    a = np.flatnonzero(new)
    count = np.diff(np.append(a, len(start)))
    first, anchor = start[a], at[a]
    last = first + count - 1 + length
    shape = (count * 256 + (anchor - first)).astype(np.uint64)
    whole = textnp.mix(_range_hashes(data, first, last, seed) + shape * textnp.PRIME)
    return {"row": row[a], "start": first - offsets[row[a]], "n": count, "place": anchor - first, "anchor": hashes[anchor].view(np.int64), "bytes": whole.view(np.int64)}


def _chunks(part: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes, row offsets and the place of the first byte in its row; a single large row comes in overlapping chunks."""
    data, offsets = textnp.utf8(part.column("text"))
    most = min(CHUNK, PIECE)
    if part.num_rows > 1 or len(data) <= most:
        yield data, offsets, 0
        return
    for at in range(0, len(data) - length + 1, most):
        piece = data[at : at + most + length - 1]
        yield piece, np.array([0, len(piece)]), at


def _links(doc, same, start, n, first_doc, first_same, first) -> np.ndarray:
    """Where runs begin: rows that don't go on from the row before both here and at their first place."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (same[1:] != same[:-1]) | (start[1:] != start[:-1] + n[:-1]) | (first_doc[1:] != first_doc[:-1]) | (first_same[1:] != first_same[:-1]) | (first[1:] != first[:-1] + n[:-1])
    return np.flatnonzero(new)


def _stretcher(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnp.slices(batch, "text", CHUNK):
                found = []
                for piece in textnp.slices(part, "text", PIECE):
                    for data, offsets, place in _chunks(piece, length):
                        s = stretches(data, offsets, length, seed)
                        doc, same = (piece.column(c).to_numpy(zero_copy_only=False)[s["row"]] for c in ("doc", "same"))
                        start, shape = (s["start"] + place).astype(np.int32), (s["n"] * 256 + s["place"]).astype(np.int32)
                        found.append((s["anchor"], s["bytes"], doc, same, start, shape))
                        if sum(len(x[0]) for x in found) >= CHUNK // 8:  # of a single large text
                            yield from _settled(*map(np.concatenate, zip(*found, strict=True)))
                            found = []
                if found:
                    yield from _settled(*map(np.concatenate, zip(*found, strict=True)))

    return run


def _settled(anchor, content, doc, same, start, shape) -> Iterator[pa.RecordBatch]:
    """The first of each content within the slice, undecided, and runs of the others with the places of their firsts."""
    key = textnp.mix(anchor.view(np.uint64) * textnp.PRIME ^ content.view(np.uint64))
    order = np.argsort(key, kind="stable")
    twin = np.zeros(len(key), bool)
    equal = key[order[1:]] == key[order[:-1]]
    twin[order[1:][equal]] = twin[order[:-1][equal]] = True
    some = np.flatnonzero(twin)
    some = some[np.lexsort((start[some], same[some], doc[some], content[some], anchor[some]))]
    new = np.ones(len(some), bool)
    new[1:] = (anchor[some[1:]] != anchor[some[:-1]]) | (content[some[1:]] != content[some[:-1]])
    first = some[np.flatnonzero(new)][np.cumsum(new) - 1] if len(some) else some
    gone, model = some[~new], first[~new]
    stays = np.ones(len(key), bool)
    stays[gone] = False
    names = ["anchor", "bytes", "doc", "same", "start", "shape", "first"]
    yield pa.RecordBatch.from_arrays([*(pa.array(x[stays]) for x in (anchor, content, doc, same, start, shape)), pa.array(np.full(int(stays.sum()), -1, np.int32))], names)
    if len(gone):
        back = np.argsort(gone)
        gone, model = gone[back], model[back]
        d, e, f, n = doc[gone], same[gone], start[gone], shape[gone] >> 8
        a = _links(d, e, f, n, doc[model], same[model], start[model])
        total = np.add.reduceat(n, a).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (same[model][a], doc[model][a], d[a], e[a], f[a], total, start[model][a])], names)


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (decided, anchor, bytes, doc, same, start): the decided ones and those repeated as a whole, with their first
    places (sure; shape counts their starts), and the first of each differing stretch of an anchor with several (not sure). Keeps one undecided row between batches."""
    names = ["anchor", "doc", "same", "start", "shape", "sure", "first_doc", "first_same", "first"]
    held: tuple | None = None  # the row that began the current anchor, while no second kind of it was seen
    anchor = content = None
    kind_first = (0, 0, 0)
    several = False

    def out(a, d, s, f, shape, sure, fd, fs, ff) -> pa.RecordBatch:
        i64 = lambda x: pa.array(np.asarray(x, np.int64))
        i32 = lambda x: pa.array(np.asarray(x, np.int32))
        return pa.RecordBatch.from_arrays([i64(a), i64(d), i64(s), i32(f), i32(shape), pa.array(np.asarray(sure, bool)), i64(fd), i64(fs), i32(ff)], names)

    for batch in batches:
        a, c, d, s, f, shape, first = (batch.column(x).to_numpy() for x in ("anchor", "bytes", "doc", "same", "start", "shape", "first"))
        known = first >= 0
        if known.any():
            k = np.flatnonzero(known)
            yield out(np.zeros(len(k)), d[k], s[k], f[k], shape[k], np.ones(len(k)), c[k], a[k], first[k])
            a, c, d, s, f, shape = (x[~known] for x in (a, c, d, s, f, shape))
        n = len(a)
        if not n:
            continue
        new_anchor, new_kind = np.ones(n, bool), np.ones(n, bool)
        new_anchor[1:] = a[1:] != a[:-1]
        new_kind[1:] = new_anchor[1:] | (c[1:] != c[:-1])
        new_anchor[0] = anchor is None or a[0] != anchor
        new_kind[0] = new_anchor[0] or c[0] != content
        group = np.cumsum(new_anchor)  # 0: goes on from the batch before
        kinds = np.bincount(group[new_kind], minlength=int(group[-1]) + 1)
        carried = not new_anchor[0]
        mixed = kinds > 1
        mixed[0] = carried and (several or kinds[0] > 0)
        at, kind = np.flatnonzero(new_kind), np.cumsum(new_kind)
        fd, fs, ff = (np.concatenate([[x], y[at]]).astype(np.int64)[kind] for x, y in zip(kind_first, (d, s, f), strict=True))
        # the last anchor's only kind so far may still be joined by another
        if carried and mixed[0] and held is not None:
            yield out(*([x] for x in held), [False], [0], [0], [0])
            held = None
        again = ~new_kind
        if again.any():
            yield out(np.zeros(int(again.sum())), d[again], s[again], f[again], shape[again] >> 8, np.ones(int(again.sum())), fd[again], fs[again], ff[again])
        open_ = new_kind & mixed[group]
        if open_.any():
            zero = np.zeros(int(open_.sum()))
            yield out(a[open_], d[open_], s[open_], f[open_], shape[open_], zero, zero, zero, zero)
        last = int(group[-1])
        several = bool(mixed[last])
        if last > 0 or not carried:
            i = int(np.flatnonzero(group == last)[0])
            held = None if several else (a[i], d[i], s[i], f[i], shape[i])
        anchor, content, kind_first = a[-1], c[-1], (fd[-1], fs[-1], ff[-1])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated stretches, from rows sorted by (doc, same, start)."""
    for batch in batches:
        if batch.num_rows:
            doc, same, start, n, first_doc, first_same, first = (batch.column(c).to_numpy() for c in ("doc", "same", "start", "shape", "first_doc", "first_same", "first"))
            a = _links(doc, same, start, n, first_doc, first_same, first)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[a], same[a], start[a], np.add.reduceat(n, a).astype(np.int32), first_doc[a], first_same[a], first[a])], ["doc", "same", "from", "n", "first_doc", "first_same", "first"])


def common(sums: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """How many bytes, up to length, the suffixes at a and b share: binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), length)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) >> 1
        same = (sums[a + mid] - sums[a]) * down[a] == (sums[b + mid] - sums[b]) * down[b]
        low, high = np.where(same & open_, mid, low), np.where(same | ~open_, high, mid - 1)


def suffix_sort(data: np.ndarray, sums: np.ndarray, down: np.ndarray, group: np.ndarray, at: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """The order of the suffixes data[at:at+length] by (group, bytes, rank): bottom-up mergesort, all merges of a level at once."""
    order = np.lexsort((rank, group))
    g = group[order]
    edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(g)))
    begin, total = np.repeat(edge, size), np.repeat(size, size)
    local = np.arange(len(g)) - begin
    width = 1
    while len(g) and width < size.max():
        pair = local // (2 * width) * (2 * width)
        right = local - pair >= width
        low = np.where(right, pair, np.minimum(pair + width, total))
        high = np.where(right, pair + width, np.minimum(pair + 2 * width, total))
        work = np.flatnonzero(low < high)
        lo, hi = low[work], high[work]
        mine = order[work]
        while len(work):
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            mid = (lo[live] + hi[live]) >> 1
            other = order[begin[work[live]] + mid]
            x, y = at[mine[live]], at[other]
            shared = common(sums, down, x, y, length)
            end = shared == length
            inside = np.minimum(shared, length - 1)
            bx, by = data[x + inside], data[y + inside]
            less = np.where(end, rank[other] < rank[mine[live]], by < bx)  # the other one sorts before mine
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
        before = np.zeros(len(g), np.int64)
        before[work] = lo - np.where(right[work], pair[work], pair[work] + width)
        own = np.where(right, local - pair - width, local - pair)
        target = begin + pair + own + before
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        width *= 2
    return order


def repeated(stretch_bytes: list[bytes], anchor: np.ndarray, n: np.ndarray, place: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of differing stretches: (stretch, start within it) of every string that stands in one of smaller rank or earlier in the same one."""
    data = np.frombuffer(b"".join(stretch_bytes), np.uint8)
    sizes = np.fromiter(map(len, stretch_bytes), np.int64, len(stretch_bytes))
    base = np.cumsum(sizes) - sizes
    sums, down = prefix_hashes(data)
    owner = np.repeat(np.arange(len(n)), n)
    shift = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = base[owner] + shift
    # equal strings have their anchor at the same place: only those are compared
    keys = textnp.mix(anchor[owner].view(np.uint64) * np.uint64(256) + (place[owner] - shift).astype(np.uint64))
    order_rank = np.argsort(np.argsort(rank, kind="stable"), kind="stable")
    string_rank = order_rank[owner] * np.int64(256) + shift
    order = suffix_sort(data, sums, down, keys, at, string_rank, length)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(keys[a] == keys[b])
    a, b = a[near], b[near]
    shared = common(sums, down, at[a], at[b], length)
    # verified on the bytes: what is said to be shared is, and the byte behind it (or the rank of equal strings) is in order
    behind = np.minimum(shared, length - 1)
    right = np.where(shared == length, string_rank[a] < string_rank[b], data[at[a] + behind] < data[at[b] + behind])
    right &= textnp.same_bytes(data, at[a], data, at[b], shared, length)
    equal = shared == length
    if not right.all():  # two prefix hashes collided: sorted by the bytes alone
        raw = data.tobytes()
        order = np.array(sorted(range(len(at)), key=lambda i: (keys[i], raw[at[i] : at[i] + length], string_rank[i])), np.int64)
        a, b = order[:-1], order[1:]
        equal = np.fromiter((keys[x] == keys[y] and raw[at[x] : at[x] + length] == raw[at[y] : at[y] + length] for x, y in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
    hit = b[equal]
    return owner[hit], shift[hit]


WANTED = "array<struct<kind:int,anchor:long,start:int,shape:int,first_doc:long,first_same:long,first:int>>"
READ = "kind int, anchor long, doc long, same long, start int, shape int, first_doc long, first_same long, first int, raw binary, d0 long, d1 long, d2 long, d3 long"
#: What is read of a document: bytes of stretches, of those of crowded anchors, digests of runs, and of the places where runs stand first.
STRETCH_KIND, CROWDED, TARGET, SOURCE = range(4)


def _bytes(length: int, most: int = 1 << 15):
    """The bytes of undecided stretches and the digests of runs, of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in READ.split(", ")]
        for batch in batches:
            data, offsets = textnp.utf8(batch.column("text"))
            load = memoryview(np.ascontiguousarray(data))
            lists = batch.column("wanted")
            counts = np.diff(lists.offsets.to_numpy())
            items = lists.flatten()
            fields = {x: items.field(x).to_numpy(zero_copy_only=False) for x in ("kind", "anchor", "start", "shape", "first_doc", "first_same", "first")}
            row = np.repeat(np.arange(batch.num_rows), counts)
            doc, same = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc", "same"))
            for open_ in (True, False):
                which = np.flatnonzero((fields["kind"] <= CROWDED) == open_)
                for i in range(0, len(which), most):
                    k = which[i : i + most]
                    begin = offsets[row[k]] + fields["start"][k]
                    if open_:
                        size = (fields["shape"][k] >> 8).astype(np.int64) - 1 + length
                        stop = np.cumsum(size)
                        at = np.arange(stop[-1]) + np.repeat(begin - (stop - size), size)
                        raw = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(np.concatenate([[0], stop]).astype(np.int32)), pa.py_buffer(data[at])])
                        digests = [pa.nulls(len(k), pa.int64())] * 4
                    else:
                        raw = pa.nulls(len(k), pa.binary())
                        ends = offsets[row[k]] + fields["shape"][k]
                        whole = b"".join(hashlib.sha256(load[a:b]).digest() for a, b in zip(begin.tolist(), ends.tolist(), strict=True))
                        digests = [pa.array(x) for x in np.frombuffer(whole, "<i8").reshape(-1, 4).T.copy()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fields["kind"][k]), pa.array(fields["anchor"][k]), pa.array(doc[k]), pa.array(same[k]), *(pa.array(fields[x][k]) for x in ("start", "shape", "first_doc", "first_same", "first")), raw, *digests], names
                    )

    return run


def _ranked(table: pa.Table) -> tuple[np.ndarray, ...]:
    """anchor, doc, same, start, number of starts, place of the anchor, rank by (doc, same, start)."""
    anchor, doc, same, start, shape = (table.column(c).to_numpy() for c in ("anchor", "doc", "same", "start", "shape"))
    order = np.lexsort((start, same, doc))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return anchor, doc, same, start, (shape >> 8).astype(np.int64), (shape & 255).astype(np.int64), rank


def _runs(owner: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and last shift of each run of neighbouring strings."""
    by = np.lexsort((shift, owner))
    owner, shift = owner[by], shift[by]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shift[1:] != shift[:-1] + 1)
    a = np.flatnonzero(new)
    return owner[a], shift[a], shift[np.append(a[1:], len(owner))[: len(a)] - 1]


def _judge(length: int, most_strings: int = 400_000):
    """Removed runs of the undecided stretches, rows sorted by anchor; whole anchors are gathered up to about `most_strings` strings."""

    def emit(table: pa.Table) -> pa.RecordBatch:
        anchor, doc, same, start, n, place, rank = _ranked(table)
        o, a, b = _runs(*repeated(table.column("raw").to_pylist(), anchor, n, place, rank, length))
        return pa.RecordBatch.from_arrays([pa.array(doc[o]), pa.array(same[o]), pa.array((start[o] + a).astype(np.int32)), pa.array((start[o] + b + length).astype(np.int32))], ["doc", "same", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            at = 0
            anchors = batch.column("anchor").to_numpy()
            strings = np.cumsum(batch.column("shape").to_numpy() >> 8)
            while at < batch.num_rows:
                done = int(strings[at - 1]) if at else 0
                to = int(np.searchsorted(strings, done + max(1, most_strings - count), "right"))
                to = max(at + 1, min(to, batch.num_rows))
                while to < batch.num_rows and anchors[to] == anchors[to - 1]:
                    to += 1
                held.append(batch.slice(at, to - at))
                count += int(strings[to - 1]) - done
                at = to
                if to < batch.num_rows and count >= most_strings:
                    yield emit(pa.Table.from_batches(held).combine_chunks())
                    held, count = [], 0
        if held:
            yield emit(pa.Table.from_batches(held).combine_chunks())

    return run


def _strings(length: int, most_strings: int = 400_000):
    """Of crowded anchors' stretches: removed runs, told by sorting about `most_strings` strings at a time, and each string that is left,
    with its hash for an anchor, as a stretch of one start (`to` is null)."""
    names = ["anchor", "doc", "same", "start", "shape", "raw", "to"]

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, doc, same, start, n, place, rank = _ranked(table)
        raw = table.column("raw").to_pylist()
        gone_owner, gone_shift = repeated(raw, anchor, n, place, rank, length)
        o, a, b = _runs(gone_owner, gone_shift)
        none = np.zeros(len(o), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(none), pa.array(doc[o]), pa.array(same[o]), pa.array((start[o] + a).astype(np.int32)), pa.array(none.astype(np.int32)), pa.nulls(len(o), pa.binary()), pa.array((start[o] + b + length).astype(np.int32))], names)
        base = np.cumsum(n) - n
        stays = np.ones(int(n.sum()), bool)
        stays[base[gone_owner] + gone_shift] = False
        owner, shift = np.repeat(np.arange(len(n)), n)[stays], (np.arange(int(n.sum())) - np.repeat(base, n))[stays]
        data = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        at = (np.cumsum(sizes) - sizes)[owner] + shift
        sums, down = prefix_hashes(data)
        key = textnp.mix((sums[at + length] - sums[at]) * down[at]).view(np.int64)
        for i in range(0, len(at), 1 << 15):
            k = slice(i, i + (1 << 15))
            m = len(at[k])
            own = data[at[k][:, None] + np.arange(length)]
            each = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(0, (m + 1) * length, length, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(own))])
            yield pa.RecordBatch.from_arrays([pa.array(key[k]), pa.array(doc[owner[k]]), pa.array(same[owner[k]]), pa.array((start[owner[k]] + shift[k]).astype(np.int32)), pa.array(np.full(m, 256, np.int32)), each, pa.nulls(m, pa.int32())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                held.append(part)
                count += int((part.column("shape").to_numpy() >> 8).sum())
                if count >= most_strings:
                    yield from emit(pa.Table.from_batches(held).combine_chunks())
                    held, count = [], 0
        if count:
            yield from emit(pa.Table.from_batches(held).combine_chunks())

    return run


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, runs in zip(*(batch.column(c).to_pylist() for c in ("text", "runs")), strict=True):
                raw = text.encode()
                at, kept, spans = 0, [], 0
                end = -1
                for r in runs or ():
                    a, b = r["from"], r["to"]
                    if a > end:
                        if end >= 0:
                            at = end
                        kept.append(raw[at:a])
                        spans += 1
                        end = b
                    else:
                        end = max(end, b)
                kept.append(raw[max(end, 0) :])
                rest = b"".join(kept)
                for column, value in zip(out, (len(raw), len(raw) - len(rest), spans, hashlib.sha256(rest).hexdigest(), rest if keep_text else None), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _repeats(texts: DataFrame, length: int, most: int, seed: int) -> DataFrame | None:
    """(doc, same, from, to) of removed runs; None where two contents shared the seed's hash."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = texts.select("doc", "same", "text").mapInArrow(_stretcher(length, seed), STRETCH)
    decided = F.col("first") >= 0
    ordered = found.repartition(parts, F.when(decided, F.xxhash64("doc", "start")).otherwise(F.col("anchor"))).sortWithinPartitions(decided, "anchor", "bytes", "doc", "same", "start")
    sifted = scratch.saved(ordered.mapInArrow(_sift, "anchor long, doc long, same long, start int, shape int, sure boolean, first_doc long, first_same long, first int"), "sifted")
    del ordered, found
    scratch.tidy(spark)
    sure = sifted.where("sure").select("doc", "same", "start", "shape", "first_doc", "first_same", "first")
    runs = scratch.saved(sure.repartition(parts, "doc", "same").sortWithinPartitions("doc", "same", "start").mapInArrow(_chain, RUN), "runs")
    open_ = sifted.where("not sure").select("anchor", "doc", "same", "start", "shape")
    crowded = scratch.saved(open_.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > most).select("anchor", F.lit(True).alias("crowded")), "crowded")
    busy = not crowded.isEmpty()
    if busy:
        few = crowded.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        open_ = open_.join(F.broadcast(crowded), "anchor", "left") if few else skew.lookup(open_, crowded, ["anchor"], F.struct("doc", "start"))
    kind = F.when(F.col("crowded"), CROWDED).otherwise(STRETCH_KIND) if busy else F.lit(STRETCH_KIND)
    size = F.col("n") - 1 + length
    zero, none = F.lit(0).cast("long"), F.lit(0)
    wanted = open_.select("doc", "same", F.struct(kind.alias("kind"), "anchor", "start", "shape", zero.alias("first_doc"), zero.alias("first_same"), none.alias("first")).alias("x"))
    ends = lambda at, d, s, f: F.struct(F.lit(at).alias("kind"), zero.alias("anchor"), f.alias("start"), (f + size).alias("shape"), d.alias("first_doc"), s.alias("first_same"), F.col("first").alias("first"))
    first_doc, first_same, first = F.col("first_doc"), F.col("first_same"), F.col("first")
    targets = runs.select("doc", "same", ends(TARGET, first_doc, first_same, F.col("from")).alias("x"))
    sources = runs.select("first_doc", "first_same", "first", "n").distinct().select(first_doc.alias("doc"), first_same.alias("same"), ends(SOURCE, first_doc, first_same, first).alias("x"))
    per_doc = wanted.unionByName(targets).unionByName(sources).groupBy("doc", "same").agg(F.collect_list("x").cast(WANTED).alias("wanted"))
    read = scratch.saved(texts.join(per_doc, ["doc", "same"]).select("text", "doc", "same", "wanted").mapInArrow(_bytes(length), READ), "read")
    scratch.tidy(spark)
    digests = read.where(F.col("kind") >= TARGET).groupBy("first_doc", "first_same", "first", (F.col("shape") - F.col("start")).alias("size")).agg(*(f(f"d{i}").alias(f"{n}{i}") for i in range(4) for f, n in ((F.min, "a"), (F.max, "b"))))
    if not digests.where(" or ".join(f"a{i} <> b{i}" for i in range(4))).isEmpty():
        return None
    raw = read.where(F.col("kind") == STRETCH_KIND).select("anchor", "doc", "same", "start", "shape", "raw")
    judge = lambda rows: rows.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_judge(length), "doc long, same long, from int, to int")
    gone = runs.select("doc", "same", "from", (F.col("from") + size).alias("to")).unionByName(scratch.saved(judge(raw), "judged"))
    if busy:
        strings = scratch.saved(read.where(F.col("kind") == CROWDED).select("anchor", "doc", "same", "start", "shape", "raw").mapInArrow(_strings(length), "anchor long, doc long, same long, start int, shape int, raw binary, to int"), "strings")
        gone = gone.unionByName(strings.where("to is not null").select("doc", "same", F.col("start").alias("from"), "to"))
        gone = gone.unionByName(scratch.saved(judge(strings.where("to is null").drop("to")), "judged"))
    return gone


def apply(docs: DataFrame, length: int = 100, text: str = "text", doc_id: str = "doc_id", most: int = MOST, keep_text: bool = True, seed: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (the remaining bytes)."""
    spark = docs.sparkSession
    scratch.ship(spark)
    id_ = docs[doc_id].cast("long")
    given = docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(-(1 << 63))).alias("doc"), F.coalesce(docs[text], F.lit("")).alias("text"))
    unique = given.groupBy("doc").agg(F.count("*").alias("c"), F.max(F.col("doc_id").isNull()).alias("none")).where("c > 1 or none").isEmpty()
    given = given.withColumn("same", F.lit(0).cast("long") if unique else F.xxhash64(F.col("doc_id").isNotNull(), "text"))
    texts = given.select("doc", "same", "text")
    texts = texts if unique else scratch.saved(texts.dropDuplicates(["doc", "same"]), "texts")
    for again in range(8):
        gone = _repeats(texts, length, most, seed + again)
        if gone is not None:
            break
    else:
        raise RuntimeError("eight hashes in a row collided: the texts were made for that")
    cuts = gone.groupBy("doc", "same").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))
    out = given.join(cuts, ["doc", "same"], "left").select("doc_id", "text", "runs").mapInArrow(_cut(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_text else out.drop("kept")
