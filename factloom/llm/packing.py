"""Packing documents into fixed windows by best-fit decreasing.

Tokenising, cutting overlong documents into full windows and hashing the ids of each piece happen
where the text is read, so only piece lengths are shuffled. A full window
fills a sequence alone. Pieces are dealt by hash into groups of a bounded number, and each group is packed by best-fit
decreasing with a segment tree over remaining capacity; a group of many thousands of pieces leaves
as little padding as one packing of all.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, worker_cache

WINDOW = 2048
GROUP_PIECES = 20_000
END_ID = 1
CACHED_WORDS = 800_000
#: Texts of these characters only are split here at white space, which the tokenizer never joins
#: across; others, and those that hold a special token's text, go to the tokenizer as a whole.
PLAIN = r"[\t-\r -~\xa0-įı-ɏ]*+"
#: Fixed value: the pattern in the tokenizer's file.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 characters
    stand for themselves, the other bytes, in order, for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Parts(dict):
    """What the tokenizer's own pattern cuts out, to its ids as little-endian bytes."""

    def __init__(self, tok):
        super().__init__()
        self.model = tok.model
        self.letters = _byte_letters()

    def __missing__(self, part: str) -> bytes:
        mapped = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        ids = self[part] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])
        return ids


class _Words(dict):
    """What stands between white space, lower-cased, to its ids as little-endian bytes."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.cut, self.plain = regex.compile(PARTS).findall, regex.compile(PLAIN).fullmatch
        self.parts = _Parts(self.tok)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = b"".join([self.parts[p] for p in self.cut(word)])
        return ids

    def encode(self, text: str) -> bytes:
        import unicodedata

        if len(self) + len(self.parts) > CACHED_WORDS:
            self.clear()
            self.parts.clear()
        own = text if text.isascii() else unicodedata.normalize("NFC", text)
        if self.plain(own) and not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, own.lower().split()))
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


def _pieces(path: str, window: int):
    def run(batches):
        import pyarrow as pa

        words = worker_cache(f"words:{path}", lambda: _Words(path))
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out: list[tuple] = []
            for doc, text in zip(ids, texts, strict=True):
                data = words.encode(text.as_py() or "") + end
                n = len(data) // 4
                for s in range(0, n, window):
                    piece = data[4 * s : 4 * (s + window)]
                    out.append((doc, s, len(piece) // 4, zlib.crc32(piece), n))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return run


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing. Returns each piece's sequence number and its offset there. The segment
    tree has a leaf for each remaining capacity and tells whether an open window has it; the
    tightest window that takes a piece is the leftmost leaf set at or right of its length."""
    size = 1 << int(window).bit_length()
    tree = np.zeros(2 * size, np.int64).tolist()
    open_: list[list[int]] = [[] for _ in range(window + 1)]

    def add(leaf: int, by: int) -> None:
        leaf += size
        while leaf:
            tree[leaf] += by
            leaf >>= 1

    def tightest(least: int) -> int:
        i = least + size
        if tree[i]:
            return least
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < size:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - size
            i >>= 1
        return -1

    seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        k = int(lengths[i])
        room = tightest(k)
        if room < 0:
            room, s = window, n
            n += 1
        else:
            s = open_[room].pop()
            add(room, -1)
        seq[i], off[i] = s, window - room
        if room > k:
            open_[room - k].append(s)
            add(room - k, 1)
    return seq, off


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = WINDOW, group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """One row for each piece of each document: (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset). A null or empty text is the end id alone; repeated rows are packed as
    often as they come; an empty table gives no rows; other columns are ignored. The pieces of a
    sequence lie gapless from offset 0. Ties in length fall to the smaller (doc_id, start)."""
    pieces = stored(
        docs.select("doc_id", "text").mapInArrow(
            _pieces(tokenizer_path, window),
            "doc_id long, start long, length long, ids_crc32 long, doc_tokens long",
        ),
        "pieces",
    )
    groups = max(1, -(-pieces.count() // group_pieces))

    def packed(key, pdf):
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        seq, off = best_fit(pdf["length"].to_numpy(), window)
        return pdf.drop(columns="grp").assign(sequence_id=seq * groups + int(key[0]), offset=off)

    # Dealt by the piece's place too: a document that comes a million times is in all groups.
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(
        packed,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
        " sequence_id long, offset long",
    )
