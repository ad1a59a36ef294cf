"""Exact substring removal by distributed prefix doubling.

A position's rank at a length is a 64-bit fingerprint of that many bytes from there, so equal
strings have equal ranks and the rank at twice a length is made of a pair of ranks, at the position
and at an offset. Spark sorts (rank, document) rows, and what is unique to one document is dropped
before the next, longer rank:

1. Ranks at the first length, of sampled positions only. Which position of a window is sampled
   depends on the window's bytes alone, so a string of the threshold's length has its sample in
   each place where it stands. A sample whose rank no other document has ends there.
2. Ranks of what is left over all windows that hold the sample. A smaller document with the same
   rank covers them all at once, and the sample ends there.
3. The first documents of those ranks, sorted by their rank at the first length once more: what is
   now unique to one document ends.
4. Ranks at the threshold, as pairs at an offset, of each position whose window's sample is left.
   A position goes if a smaller document holds its rank.

Before each sort the mapper settles what it can see among its own rows and sends one document's
rows for each rank, so a string that stands in every document gives no more rows than there are
map tasks. Documents that are whole copies of a smaller one are found by SHA-256 and leave the work
after the first sort. Matches never cross documents. Ranks of 64 bits say what to compare: the rows
of the first and third sort are a filter, which a false match makes longer. Before the second and
fourth call a byte covered, a mapper compares the bytes of its rows, and rows of different mappers
must agree in a second fingerprint of the bytes too, made with other numbers: together 128 bits, a
chance of about n * n / 2**129 for one false match among n distinct strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, mixed, small, stored, text_chunks

THRESHOLD = 50
FLUSH = 1_500_000
#: A mapper also sends its rows when the texts that they come from have so many bytes.
HELD_BYTES = 1 << 25
#: Held rows are settled and sent by runs of about so many.
SENT = 1 << 16
#: Rows whose bytes are compared at a time.
COMPARED = 1 << 14
#: Whole copies of one text beyond this number are marked without a shuffle by their digest.
HOT_COPIES = 1_000
#: Digests that so many documents have are broadcast up to this number.
BROADCAST_ROWS = 100_000
LAST = (1 << 63) - 1
#: Documents without an id come after all others, in the order of their text's hash of so many bits.
NAMELESS = 1 << 40
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64))
_OTHER = mixed(np.arange(1 << 32, (1 << 32) + 256, dtype=np.uint64))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int):
        if n > self.n:
            self.n = max(n, 1 << 20)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                x = np.full(self.n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


class Ranks:
    """Ranks of the positions of some whole texts that stand one after another."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, powers: _Powers, threshold: int):
        self.offsets, self.n, self.threshold, self.data = offsets, len(data), threshold, data
        up, self.down = powers.upto(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: self.n], out=self.sums[1:])
        #: Where a string of the threshold's length starts.
        fits = np.ones(self.n, bool)
        for end in offsets[1:].tolist():
            fits[max(end - threshold + 1, 0) : end] = False
        for i in np.flatnonzero(np.diff(offsets) < threshold).tolist():
            fits[offsets[i] : offsets[i + 1]] = False
        self.starts = np.flatnonzero(fits)

    def doc(self, where: np.ndarray) -> np.ndarray:
        """The indices of the documents of some positions."""
        return np.searchsorted(self.offsets, where, "right") - 1

    def at(self, length: int, where: np.ndarray | None = None) -> np.ndarray:
        if where is None:
            return mixed((self.sums[length:] - self.sums[: self.n + 1 - length]) * self.down[: self.n + 1 - length])
        return mixed((self.sums[where + length] - self.sums[where]) * self.down[where])

    def pairs(self, where: np.ndarray) -> np.ndarray:
        """Ranks at the threshold, each of the rank there and the one at an offset."""
        half = -(-self.threshold // 2)
        return mixed(self.at(half, where) * np.uint64(_BASE) + self.at(half, where + self.threshold - half))

    def samples(self) -> np.ndarray:
        """For each start, the position in its window that is sampled: the leftmost smallest hash
        of a few bytes, modulo the number of places where the first length fits."""
        first, width, few = lengths(self.threshold)
        if not len(self.starts):
            return self.starts
        least = (self.sums[few:] - self.sums[: self.n + 1 - few]) * self.down[: self.n + 1 - few]
        least *= np.uint64(0xC4CEB9FE1A85EC53)
        least &= np.uint64(0xFFFFFFFF00000000)
        least |= np.arange(self.n + 1 - few, dtype=np.uint64)
        span, done = self.threshold - few + 1, 1
        while done < span:
            step = min(done, span - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        place = (least[self.starts] & np.uint64(0xFFFFFFFF)).view(np.int64) - self.starts
        return self.starts + (np.arange(span) % width)[place]


def lengths(threshold: int) -> tuple[int, int, int]:
    """The first length, the number of places it has in a window, and the bytes whose hash picks
    one: equal to the first length modulo those places, which keeps samples few."""
    first = (threshold * 5 + 7) // 8 - 1 if threshold >= 16 else threshold
    width = threshold - first + 1
    few = first % width
    while few < min(first, 8):
        few += width
    return first, width, min(few, first)


def _sort_rows(keys, docs, kinds, *more):
    import pyarrow as pa

    cols = [pa.array(keys.view(np.int64)), pa.array(docs), pa.array(kinds), *map(pa.array, more)]
    return pa.RecordBatch.from_arrays(cols, names=["key", "doc_id", "kind", "pos", "check", "rank"][: len(cols)])


SETTLED, OPEN, SHOWN = 1, 0, 2
#: In a place: the document has the rank elsewhere too.
MANY = 1 << 30


def _by_rank(rank, doc):
    order = np.argsort(rank)
    rank, doc = rank[order], doc[order]
    new = np.r_[True, rank[1:] != rank[:-1]]
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    return order, rank, doc, at, np.minimum.reduceat(doc, at)[group], np.maximum.reduceat(doc, at)[group]


def _dealt(parts):
    """Held parts, each the columns of some rows with their ranks first, as runs of about SENT rows.
    All rows of a rank are in one run, so that no more than a run is sorted, and sent, at a time."""
    n = 1
    while n * SENT < sum(len(p[0]) for p in parts):
        n *= 2
    for i in range(n):
        own = [np.flatnonzero(p[0] & np.uint64(n - 1) == i) for p in parts]
        if any(map(len, own)):
            yield tuple(np.concatenate([c[at] for c, at in zip(col, own, strict=True)]) for col in zip(*parts, strict=True))


def _shown(parts):
    """Rows that tell which ranks more than one document has, from parts of (rank, document)."""
    for rank, doc in _dealt(parts):
        yield from _shown_run(rank, doc)


def _shown_run(rank, doc):
    """A rank of two documents here is settled for both: their rows go under keys of their own, and
    one of them is shown under the rank for other mappers' rows."""
    order = np.argsort(rank)
    rank, doc = rank[order], doc[order]
    new = np.r_[True, rank[1:] != rank[:-1]]
    many = ~(new & np.r_[new[1:], True])
    alone = _sort_rows(rank[~many], doc[~many], np.zeros(len(rank) - many.sum(), np.int8))
    if not many.any():
        return [alone]
    _, rank, doc, at, low, high = _by_rank(rank[many], doc[many])
    known = low < high
    head = np.zeros(len(rank), bool)
    head[at] = True
    kind = np.where(known, np.where(head, SHOWN, SETTLED), OPEN).astype(np.int8)
    keep = known | head
    key = np.where(kind == SETTLED, rank ^ mixed(doc.astype(np.uint64)), rank)
    return [alone, _sort_rows(key[keep], doc[keep], kind[keep])]


def _first_rows(threshold: int):
    """Rows for the first sort, from (doc_id, text)."""

    def run(batches):
        powers, first = _Powers(), lengths(threshold)[0]
        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, offsets, data in text_chunks(batch.column(1), 1 << 18):
                r = Ranks(offsets, data, powers, threshold)
                hit = np.zeros(r.n + 1, bool)
                hit[r.samples()] = True
                where = np.flatnonzero(hit)
                parts.append((r.at(first, where), ids[i + r.doc(where)]))
                held += len(where)
                if held > FLUSH:
                    yield from _shown(parts)
                    parts, held = [], 0
        if held:
            yield from _shown(parts)

    return run


def _third_rows(batches):
    """Rows for the third sort, from (doc_id, rank)."""
    parts, held = [], 0
    for batch in batches:
        parts.append((batch.column(1).to_numpy().view(np.uint64), batch.column(0).to_numpy()))
        held += batch.num_rows
        if held > FLUSH:
            yield from _shown(parts)
            parts, held = [], 0
    if held:
        yield from _shown(parts)


def _whole_groups(batches):
    """Sorted rows as arrays, cut only between keys."""
    import pyarrow as pa

    rest = None
    for batch in batches:
        rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if rest.num_rows < 200_000:
            continue
        key = rest["key"].to_numpy()
        last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if last:
            yield [c.to_numpy() for c in rest.slice(0, last).columns]
            rest = pa.table([c.combine_chunks() for c in rest.slice(last).columns], names=rest.column_names)
    if rest is not None and rest.num_rows:
        yield [c.to_numpy() for c in rest.columns]


def _low_high(key, doc, kind):
    """The smallest and largest document of each key, among rows that stand for a rank."""
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    group = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(key)]))
    big = np.iinfo(np.int64)
    low = np.minimum.reduceat(np.where(kind == SETTLED, big.max, doc), at)
    high = np.maximum.reduceat(np.where(kind == SETTLED, big.min, doc), at)
    return low[group], high[group]


def _same(text, a, b) -> np.ndarray:
    """Whether rows a have the bytes of rows b, a few at a time."""
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), COMPARED):
        out[i : i + COMPARED] = (text(a[i : i + COMPARED]) == text(b[i : i + COMPARED])).all(1)
    return out


def _first_of_equals(key, doc, kind, check) -> np.ndarray:
    """The smallest document of each row's key and check."""
    low, high = _low_high(key, doc, kind)
    rows = np.flatnonzero((kind == OPEN) & (low < high))
    if not len(rows):
        return low
    new = np.r_[True, key[rows][1:] != key[rows][:-1]]
    head = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
    for k in np.unique(key[rows[check[rows] != check[head]]]).tolist():
        # One rank, different bytes: each string for itself.
        own, least = rows[key[rows] == k], {}
        for c, d in zip(check[own].tolist(), doc[own].tolist(), strict=True):
            least[c] = min(least.get(c, LAST), d)
        low[own] = [least[c] for c in check[own].tolist()]
    return low


def _shared(batches):
    """(doc_id, rank) of the ranks that more than one document has."""
    import pyarrow as pa

    for key, doc, kind in _whole_groups(batches):
        low, high = _low_high(key, doc, kind)
        keep = (kind != OPEN) | (low < high)
        key, doc, kind = key[keep].view(np.uint64), doc[keep], kind[keep]
        rank = np.where(kind == SETTLED, key ^ mixed(doc.astype(np.uint64)), key)
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(rank.view(np.int64))], names=["doc_id", "rank"])


def _chosen(batches, threshold: int):
    """From (doc_id, text, ranks that are shared): for each run of texts its ids, its ranks, its
    starts' samples and which of them have a shared rank."""
    powers, (first, _, _) = _Powers(), lengths(threshold)
    for batch in batches:
        ids, shared = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
        for i, offsets, data in text_chunks(batch.column(1), 1 << 18):
            r = Ranks(offsets, data, powers, threshold)
            own = shared.slice(i, len(offsets) - 1)
            # Which document has which rank: both in one number, told apart well enough to choose
            # candidates; a false one only costs a row.
            flat = own.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            index = np.repeat(np.arange(len(own)), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            tag = lambda d: mixed(d.astype(np.uint64) + np.uint64(1))
            have = np.unique(flat ^ tag(index))
            sample = r.samples()
            # Neighbouring starts share their sample.
            head = np.flatnonzero(np.r_[True, sample[1:] != sample[:-1]][: len(sample)])
            want = r.at(first, sample[head]) ^ tag(r.doc(sample[head]))
            spot = np.minimum(np.searchsorted(have, want), max(len(have) - 1, 0))
            ok = have[spot] == want if len(have) else np.zeros(len(want), bool)
            yield ids[i : i + len(own)], r, sample, np.repeat(ok, np.diff(np.r_[head, len(sample)]))


def _settle(rank, doc, place, text):
    """(order, doc, key, kind, place) of the rows to send. What a smaller document of this mapper
    covers is settled, under a key of its own; the smallest document's rows go under their rank,
    and if it has a rank several times, one row, marked MANY in its place, stands for all. text
    gives the bytes of some rows; rows of one rank whose bytes differ are all sent as they are."""
    order, rank, doc, at, low, _ = _by_rank(rank, doc)
    group = np.cumsum(np.r_[True, rank[1:] != rank[:-1]]) - 1
    rows = np.flatnonzero(np.arange(len(rank)) != at[group])
    mixed_up = np.zeros(len(at), bool)
    mixed_up[group[rows[~_same(text, order[rows], order[at[group[rows]]])]]] = True
    plain = ~mixed_up[group]
    gone, place = (doc > low) & plain, place[order]
    key = np.where(gone, mixed(doc.astype(np.uint64)) ^ mixed(place.astype(np.uint64)), rank)
    open_ = np.flatnonzero(~gone & plain)
    head = np.r_[True, rank[open_][1:] != rank[open_][:-1]][: len(open_)]
    keep = gone | ~plain
    keep[open_[head]] = True
    place[open_[head & ~np.r_[head[1:], True][: len(head)]]] |= MANY
    kind = np.where(gone, SETTLED, OPEN).astype(np.int8)
    return order[keep], doc[keep], key[keep], kind[keep], place[keep].astype(np.int32)


def _checked(text: np.ndarray) -> np.ndarray:
    """A second fingerprint of each row of bytes, by other numbers than a rank's: a sum of a number
    for each byte, weighted by its place."""
    n = text.shape[1]
    weights = mixed(np.arange(1 << 20, (1 << 20) + n, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros(len(text), np.uint64)
    for place in range(n):
        out += _OTHER[text[:, place]] * weights[place]
    return mixed(out)


class _Rows:
    """Rows of a mapper until it sends them, with the texts that their bytes are read from."""

    def __init__(self, width: int):
        self.width, self.parts, self.texts, self.rows, self.bytes = width, [], [], 0, 0

    def add(self, data, low, size, *cols):
        """cols: rank, document, place and others; the bytes of a row are size bytes from low."""
        rank, doc, place, *more = cols
        self.parts.append((rank, doc, place.astype(np.int32), *more, (low + self.bytes).astype(np.uint32), size.astype(np.int32)))
        self.texts.append(np.array(data))
        self.rows += len(low)
        self.bytes += len(data)

    def full(self) -> bool:
        return self.rows > FLUSH or self.bytes > HELD_BYTES

    def sent(self):
        """The batches of rows to send."""
        parts, data = self.parts, np.concatenate(self.texts)
        self.__init__(self.width)
        for run in _dealt(parts):
            yield self._batch(data, *run)

    def _batch(self, data, rank, doc, place, *more):
        *more, low, size = more
        span = np.arange(self.width)

        def text(rows):
            """Bytes of some rows, filled up with zeros, and how many there are."""
            n = size[rows][:, None]
            out = data[np.minimum(low[rows].astype(np.int64)[:, None] + span, len(data) - 1)]
            out[span >= n] = 0
            return np.concatenate([out, n.astype("<u4").view(np.uint8)], 1)

        order, doc, key, kind, place = _settle(rank, doc, place, text)
        check, open_ = np.zeros(len(key), np.uint64), np.flatnonzero(kind == OPEN)
        for i in range(0, len(open_), COMPARED):
            rows = open_[i : i + COMPARED]
            check[rows] = _checked(text(order[rows]))
        return _sort_rows(key, doc, kind, place, check.view(np.int64), *(m[order].view(np.int64) for m in more))


def _second_rows(threshold: int):
    """Rows for the second sort: samples with the rank of all their windows together."""
    first, width, _ = lengths(threshold)

    def run(batches):
        rows = _Rows(threshold + width - 1)
        for ids, r, sample, ok in _chosen(batches, threshold):
            at = np.unique(sample[ok])
            index = r.doc(at)
            low = np.maximum(r.offsets[index], at - width + 1)
            high = np.minimum(r.offsets[index + 1], at + threshold)
            # Where the sample lies in its windows is part of the rank, and of the bytes by their number.
            rank = (r.sums[high] - r.sums[low]) * r.down[low] + mixed((at - low).astype(np.uint64) << np.uint64(32) | (high - low).astype(np.uint64))
            if len(at):
                rows.add(r.data, low, high - low + ((at - low) << 16), mixed(rank), ids[index], at - r.offsets[index], r.at(first, at))
            if rows.full():
                yield from rows.sent()
        if rows.rows:
            yield from rows.sent()

    return run


def _wide(batches):
    """(doc_id, pos, rank): rank is null where a smaller document covers the sample's windows."""
    import pyarrow as pa

    for key, doc, kind, pos, check, rank in _whole_groups(batches):
        gone = (kind == SETTLED) | (doc > _first_of_equals(key, doc, kind, check))
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos), pa.array(rank, mask=gone)], names=["doc_id", "pos", "rank"])


def _fourth_rows(threshold: int):
    """Rows for the fourth sort: positions with their rank at the threshold."""

    def run(batches):
        rows = _Rows(threshold)
        for ids, r, _, ok in _chosen(batches, threshold):
            at = r.starts[ok]
            index = r.doc(at)
            if len(at):
                rows.add(r.data, at, np.full(len(at), threshold), r.pairs(at), ids[index], at - r.offsets[index])
            if rows.full():
                yield from rows.sent()
        if rows.rows:
            yield from rows.sent()

    return run


def _covered(batches):
    """(doc_id, pos) of the positions whose string stands in a smaller document."""
    import pyarrow as pa

    for key, doc, kind, pos, check in _whole_groups(batches):
        keep = (kind == SETTLED) | (doc > _first_of_equals(key, doc, kind, check))
        yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(pos[keep])], names=["doc_id", "pos"])


def _spans(place: np.ndarray, data: bytes, threshold: int, powers: _Powers) -> list[list[int]]:
    """[start, end) of the maximal runs that go, from what covered() says of a text."""
    n, width = len(data), lengths(threshold)[1]
    wide = place < 0
    at = np.where(wide, ~place, place)
    many, at = at & MANY > 0, at & ~MANY
    low, high = np.where(wide, np.maximum(at - width + 1, 0), at), np.minimum(at + threshold, n)
    if many.any():
        # What covers one place of a string covers all places that have it.
        r = Ranks(np.array([0, n]), np.frombuffer(data, np.uint8), powers, threshold)
        known = np.zeros(n + 1, bool)
        for a, b in zip(low[many].tolist(), high[many].tolist(), strict=True):
            known[a : b - threshold + 1] = True
        strings = {data[a : a + threshold] for a in np.flatnonzero(known).tolist()}
        more = r.starts[np.isin(r.pairs(r.starts), r.pairs(np.flatnonzero(known)))]
        more = np.array([a for a in more.tolist() if data[a : a + threshold] in strings], np.int64)
        low, high = np.concatenate([low, more]), np.concatenate([high, more + threshold])
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
    return np.c_[low[new], high[np.r_[new[1:] - 1, len(low) - 1]]].tolist()


def _cut(text: str | None, place, copy: bool, threshold: int, powers: _Powers):
    """(bytes, what is left of them, spans) of one text."""
    data = (text or "").encode()
    n = len(data)
    spans: list[list[int]] = []
    if copy and n >= threshold:
        spans = [[0, n]]
    elif place.is_valid and len(place):
        spans = _spans(place.values.to_numpy(zero_copy_only=False).astype(np.int64), data, threshold, powers)
    if not spans:
        return data, data, spans
    ends = [0, *(e for _, e in spans)]
    return data, b"".join(data[a:b] for a, b in zip(ends, [*(s for s, _ in spans), n], strict=True)), spans


def _digests(threshold: int):
    def run(batches):
        import pyarrow as pa

        powers = _Powers()
        for batch in batches:
            out: list[tuple] = []
            ids, texts, places, copies = (batch.column(i) for i in range(4))
            for doc, text, place, copy in zip(ids.to_pylist(), texts, places, copies.to_pylist(), strict=True):
                data, kept, spans = _cut(text.as_py(), place, copy, threshold, powers)
                out.append((doc, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.list_(pa.int64()))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def _kept_texts(threshold: int):
    def run(batches):
        import pyarrow as pa

        powers = _Powers()
        for batch in batches:
            texts, places, copies = batch.columns[-3:]
            out = []
            for text, place, copy in zip(texts, places, copies.to_pylist(), strict=True):
                text = text.as_py()
                data, kept, _ = _cut(text, place, copy, threshold, powers)
                out.append(text if len(kept) == len(data) else kept.decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(out, pa.string())], names=[*batch.schema.names[:-3], "text"])

    return run


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key")


def _with_ranks(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    return docs.join(ranks.groupBy("doc_id").agg(F.collect_set("rank").alias("ranks")), "doc_id")


def _place_of(doc_id: str, text: str) -> Column:
    """A document's place in the order of documents."""
    own = F.lit(LAST) - F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(NAMELESS))
    return F.coalesce(F.col(doc_id).cast("long"), own)


def copies(docs: DataFrame) -> DataFrame:
    """A stored table: doc_id of texts equal to a smaller document's. docs: (doc_id, text), no
    nulls. Documents of a digest that many have are told by a broadcast of that digest."""
    digest = stored(docs.select("doc_id", F.sha2("text", 256).alias("d")), "digests")
    firsts = digest.groupBy("d").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    firsts = stored(firsts.where("first < last").select("d", "first", "n"), "first-copies")
    hot = small(firsts.where(F.col("n") > HOT_COPIES).select("d", "first"), BROADCAST_ROWS)
    cold = firsts.where(F.col("n") <= HOT_COPIES).select("d", "first")
    met = digest.join(hot, "d").unionByName(digest.join(hot, "d", "left_anti").join(cold, "d"))
    out = stored(met.where("doc_id > first").select("doc_id").distinct(), "copies")
    discard(digest, firsts)
    return out


def covered(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: copies(), and, for the other documents, (doc_id, pos) of strings that also
    start in a smaller document. A pos below zero, -1 - s, says it of all strings that hold the
    sample at s; one with MANY set, of all strings equal to those."""
    docs = docs.select(_place_of("doc_id", "text").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    whole = copies(docs)

    rows, open_ = "key long, doc_id long, kind byte", "doc_id long, rank long"
    one = _sorted(docs.mapInArrow(_first_rows(threshold), rows)).mapInArrow(_shared, open_)
    one = stored(one.join(whole, "doc_id", "left_anti"), "shared")

    two = _with_ranks(docs, one).mapInArrow(_second_rows(threshold), f"{rows}, pos int, check long, rank long")
    two = stored(_sorted(two).mapInArrow(_wide, "doc_id long, pos int, rank long"), "wide")
    discard(one)

    left = two.where("rank is not null").select("doc_id", "rank")
    three = stored(_sorted(left.mapInArrow(_third_rows, rows)).mapInArrow(_shared, open_), "shared-still")

    four = _with_ranks(docs, three).mapInArrow(_fourth_rows(threshold), f"{rows}, pos int, check long")
    four = _sorted(four).mapInArrow(_covered, "doc_id long, pos int")
    wide = two.where("rank is null").select("doc_id", (-1 - F.col("pos")).alias("pos"))
    four = stored(four.unionByName(wide), "covered")
    discard(two, three)
    return whole, four


def _judged(docs: DataFrame, threshold: int) -> DataFrame:
    """docs, text before two more columns, with what covered() says of each row: its places, and
    whether it is a whole copy."""
    whole, places = covered(docs, threshold)
    key, found, copy = (fresh(c, docs.columns) for c in ("place", "places", "copy"))
    places = places.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list("pos").alias(found))
    marks = whole.select(F.col("doc_id").alias(key), F.lit(True).alias(copy))
    joined = docs.withColumn(key, _place_of("doc_id", "text")).join(places, key, "left").join(marks, key, "left")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return joined.select(*rest, "text", found, F.coalesce(copy, F.lit(False)).alias(copy))


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row for each row of docs: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans).
    Texts are UTF-8 bytes, null is empty. A byte goes if a string of threshold bytes over it also
    starts in a document of smaller doc_id, as the input has it; rows of one doc_id, which are
    taken to be one document come again, never remove each other's bytes. spans are [start, end)
    of the maximal removed runs. Shorter and empty texts stay; an empty table gives no rows; other
    columns are ignored. Rows without doc_id come
    after all others, in the order of their texts' hashes. A text is read whole
    by one task, with about forty times its size of memory, and has less than 1 GiB."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _judged(docs, threshold).mapInArrow(
        _digests(threshold),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string,"
        " spans array<array<long>>",
    )


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs with the repeated bytes taken out of text and n_chars set anew, all rows and columns
    kept. A character of which a byte goes is taken out whole; null texts stay null."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    cut = _judged(docs, threshold).mapInArrow(_kept_texts(threshold), docs.select(*rest, "text").schema)
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", n_chars).select(*(F.col(f"`{c}`") for c in docs.columns))
