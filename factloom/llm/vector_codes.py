"""Vectors as short codes: product quantisation whose nearest entries come from memoised grid cells.

A vector of whole numbers is cut into parts, each with a codebook. To find a part's nearest entry,
its coarse grid cell is hashed and looked up in a memo. The memo keeps, for each cell met, the
entries that some point of the cell's box could be nearest to: an entry whose least distance to the
box is beyond another's greatest is dominated and never looked at again. Only the others are
evaluated, exactly, so the codes are those of a full search.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, small, stored, worker_cache

SCALE = 4096.0
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: A cell's side, in units of the scaled components.
SIDE = 512
#: Scaled components are held within this, so that every sum of squares fits.
LIMIT = 1 << 24
#: Cells remembered for one part; what is met beyond is worked out each time.
MEMO_CELLS = 1 << 17
BROADCAST_ROWS = 10_000


class Grid:
    """One part's codebook, (entries, dimensions), and its memo."""

    def __init__(self, book: np.ndarray, side: int = SIDE, memo_cells: int = MEMO_CELLS):
        self.book, self.side, self.memo_cells = book, side, memo_cells
        self.keys = np.zeros(0, np.uint64)
        self.cells, self.masks = np.zeros((0, book.shape[1]), np.int64), np.zeros(0, np.uint64)
        self.evaluated = self.searched = 0

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """A bit for each entry that no other dominates across a cell's box."""
        low = (cells * self.side)[:, None, :]
        below, above = low - self.book, self.book - (low + self.side - 1)
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
        most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(2)
        near = least <= most.min(1)[:, None]
        return (near.astype(np.uint64) << np.arange(len(self.book), dtype=np.uint64)).sum(1, dtype=np.uint64)

    def lookup(self, cells: np.ndarray) -> np.ndarray:
        key = np.zeros(len(cells), np.uint64)
        for column in cells.T:
            key = mixed(key * np.uint64(31) + column.astype(np.uint64))
        keys, first, at = np.unique(key, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        own, masks = cells[first], np.zeros(len(keys), np.uint64)
        own[known], masks[known] = self.cells[place[known]], self.masks[place[known]]
        masks[~known] = self.candidates(own[~known])
        if not known.all() and len(self.keys) < self.memo_cells:
            self.keys = np.concatenate([self.keys, keys[~known]])
            order = np.argsort(self.keys)
            self.keys = self.keys[order]
            self.cells = np.concatenate([self.cells, own[~known]])[order]
            self.masks = np.concatenate([self.masks, masks[~known]])[order]
        # A cell that shares its hash with another is told apart and has every entry.
        same = (own[at] == cells).all(1)
        return np.where(same, masks[at], np.uint64((1 << len(self.book)) - 1))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's nearest entry, ties to the lower, and its squared distance."""
        masks = self.lookup(points // self.side)
        code, best = np.zeros(len(points), np.int64), np.full(len(points), np.iinfo(np.int64).max)
        for j, entry in enumerate(self.book):
            rows = np.flatnonzero(masks >> np.uint64(j) & np.uint64(1))
            distance = ((points[rows] - entry) ** 2).sum(1)
            better = distance < best[rows]
            best[rows[better]], code[rows[better]] = distance[better], j
            self.evaluated += len(rows)
        self.searched += len(points) * len(self.book)
        return code, best


def _grids(books: np.ndarray) -> list[Grid]:
    """The grids of these codebooks; a worker keeps the memos of the last ones from task to task."""
    kept = worker_cache("grids", dict)
    name = hashlib.sha256(books.tobytes() + repr(books.shape).encode()).digest()
    if name not in kept:
        kept.clear()
        kept[name] = [Grid(b) for b in books]
    return kept[name]


def _assigned(books: np.ndarray, batch):
    """(parts of the batch's vectors, codes, squared distances), each rows by parts."""
    parts, _, width = books.shape
    column = batch.column(batch.num_columns - 1)
    points = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, parts, width).astype(np.int64)
    found = [g.nearest(points[:, i]) for i, g in enumerate(_grids(books))]
    return points, np.stack([c for c, _ in found], 1), np.stack([d for _, d in found], 1)


def _sums(books: np.ndarray):
    parts, entries, width = books.shape

    def run(batches):
        import pyarrow as pa

        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            points, codes, _ = _assigned(books, batch)
            for i in range(parts):
                np.add.at(total[i], codes[:, i], points[:, i])
                count[i] += np.bincount(codes[:, i], minlength=entries)
        used = np.argwhere(count > 0)
        place = (used @ [entries, 1])[:, None] * max(width, 1) + np.arange(width)
        columns = [place.ravel(), np.repeat(count[count > 0], width), total[count > 0].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["place", "n", "s"])

    return run


def _codes(books: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            _, codes, distances = _assigned(books, batch)
            text = [bytes(x).hex() for x in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text), pa.array(distances.sum(1))], names=["vec_id", "label", "code", "error"]
            )

    return run


def whole_vectors(rows: DataFrame, scale: float = SCALE, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, v) with components floor(scale * x), held within LIMIT. Vectors that are null
    or hold a null or non-finite component are left out; shorter ones are filled with zeros to the
    longest one's length, and that to a multiple of parts."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(x, lambda e: F.floor(F.least(F.greatest(e * scale, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    kept = rows.where("embedding is not null").where(fine).select(F.col("vec_id").cast("long"), "label", whole.alias("v"))
    kept = stored(kept, "vectors")
    sizes = kept.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    dims = -(-(sizes.most or 0) // parts) * parts
    if sizes.least in (None, dims):
        return kept
    return kept.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(dims) - F.size("v"))))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks, (parts, entries, dimensions of a part), from (vec_id, v): the first vectors by id,
    those without one last, moved so many times to the floor of their points' mean. All vectors
    count each time; what reaches the driver is a codebook."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1) if first else np.zeros((0, parts, 0), np.int64)
    books = np.ascontiguousarray(books.transpose(1, 0, 2))
    for _ in range(rounds if books.size else 0):
        sums = vectors.select("v").mapInArrow(_sums(books), "place long, n long, s long")
        flat = books.reshape(-1).copy()
        for r in sums.groupBy("place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
            flat[r.place] = r.s // r.n
        books = flat.reshape(books.shape)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): two hex digits for each part, and the squared distances."""
    schema = f"vec_id long, label {dict(vectors.dtypes)['label']}, code string, error long"
    return vectors.select("vec_id", "label", "v").mapInArrow(_codes(books), schema)


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes with v: the entries that each code names, joined."""
    parts, _, width = books.shape
    book = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in b]) for b in books])
    entry = lambda i: F.conv(F.substring("code", 2 * i + 1, 2), 16, 10).cast("int")
    return codes.withColumn("book", book).withColumn("v", F.concat(*[F.get(F.get("book", F.lit(i)), entry(i)) for i in range(parts)])).drop("book")


def compress(embeddings: DataFrame, scale: float = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256, label): one row for each vector that
    whole_vectors keeps. Repeated rows are vectors of their own, and so are rows without vec_id;
    fewer vectors than entries make a smaller codebook; other columns are ignored; an empty table
    gives no rows. label_error sums the errors of one label, nulls together."""
    if not 1 <= entries <= 64:
        raise ValueError("a code has 1 to 64 entries")
    vectors = whole_vectors(embeddings, scale, parts)
    books = train(vectors, parts, entries, rounds)
    coded = stored(encode(vectors, books), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = small(stored(sums, "labels"), BROADCAST_ROWS)
    out = coded.join(sums, coded["label"].eqNullSafe(sums["label"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), coded["label"])


def _sql(width: int = 8) -> str:
    """The same by a full search, for DuckDB and vectors of one length."""
    dims = range(1, width + 1)
    distance = " + ".join(f"(p.x[{i}] - b.x[{i}]) * (p.x[{i}] - b.x[{i}])" for i in dims)
    mean = ", ".join(f"(sum(x[{i}]) - (sum(x[{i}]) % count(*) + count(*)) % count(*)) // count(*)" for i in dims)
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT k, part, any_value(p.x) AS x, min(CAST({distance} AS HUGEINT) * {ENTRIES} + entry) AS best FROM p JOIN b{r} b USING (part) GROUP BY k, part
)""")
        if r < ROUNDS:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (
    SELECT part, best % {ENTRIES} AS entry, list_transform([{mean}], lambda y: CAST(y AS BIGINT)) AS x FROM a{r} GROUP BY 1, 2
  ) m USING (part, entry)
)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS k, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT k, part, v[part * {width} + 1 : part * {width} + {width}] AS x FROM v, (SELECT unnest(range({PARTS})) AS part)
), b0 AS (
  SELECT part, k - 1 AS entry, x FROM p WHERE k <= {ENTRIES}
), {", ".join(steps)}, c AS (
  SELECT k, string_agg(printf('%02x', CAST(best % {ENTRIES} AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY k
), h AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256, label FROM v JOIN c USING (k), h
"""


ORACLE_SQL = _sql()
