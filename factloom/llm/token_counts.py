"""Token counts without tokens: best segmentation into vocabulary pieces by a Viterbi pass that
carries only the best score and its piece count.

Pieces are matched by an Aho-Corasick automaton. A text is cut before each run of space marks that
follows another sign, where no piece of the vocabulary spans the cut, so that what stands between
two cuts is segmented alone and its count kept for its next use; a vocabulary with a piece that
does span such a place has its texts segmented whole. The pass keeps as many positions as the
longest piece has signs. Ties follow the unigram tokenizer: of equal scores the segment that starts
first, the longest, stays. A character without a piece costs the lowest score less a fixed penalty
and counts as its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import worker_cache

SPACE = "▁"
#: Fixed value: the unigram tokenizer's cost of an unknown character beyond the lowest score.
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 1_000_000
#: Longer words are counted each time.
CACHED_LENGTH = 64
#: A text's words are listed for about so many characters at a time.
LISTED = 1 << 20

_CUT = re.compile(f"(?<=[^{SPACE}]){SPACE}")
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model's ordinary pieces, all of them."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    return [(m.id_to_piece(i), m.get_score(i)) for i in ids]


class Counter(dict):
    """Word, with the run of space marks before it, to its number of pieces."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.longest = max(len(p) for p, _ in pieces)
        self.cuts = not any(_CUT.search(p) for p, _ in pieces)

    def __missing__(self, word: str) -> int:
        n, m = len(word), self.longest + 1
        # Position i has place i % m: nothing reaches further back than the longest piece.
        score: list[float | None] = [0.0] + [None] * self.longest
        count, at, single = [0] * m, 0, False

        def go_to(end: int) -> None:
            """Ends the positions before end: one that no piece of one sign reaches may be reached
            by an unknown sign."""
            nonlocal at, single
            while at < end:
                if at and not single:
                    last = (at - 1) % m
                    s = score[last] + self.unknown
                    if score[at % m] is None or s > score[at % m]:
                        score[at % m], count[at % m] = s, count[last] + len(word[at - 1].encode(errors="replace"))
                at, single = at + 1, False
                score[at % m] = None

        # Where matches end, the automaton gives the longest first: starts in rising order.
        for last, (length, own) in self.automaton.iter(word):
            end = last + 1
            if at < end:
                go_to(end)
            s = score[(end - length) % m] + own
            if score[end % m] is None or s > score[end % m]:
                score[end % m], count[end % m] = s, count[(end - length) % m] + 1
            single = single or length == 1
        go_to(n + 1)
        if n <= CACHED_LENGTH:
            self[word] = count[n % m]
        return count[n % m]

    def words(self, text: str) -> Iterator[list[str]]:
        """The parts of a text that are segmented alone, a list at a time."""
        if not self.cuts:
            yield [text]
            return
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + LISTED)
            end = cut.start() if cut else len(text)
            yield _WORD.findall(text, at, end)
            at = end

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(self) > CACHED_WORDS:
            self.clear()
        text = text.replace(" ", SPACE)
        text = text if text[0] == SPACE else SPACE + text
        return sum(self[w] for words in self.words(text) for w in words)


def _counted(path: str):
    def run(batches):
        import pyarrow as pa

        counter = worker_cache(f"pieces:{path}", lambda: Counter(vocabulary(path)))
        for batch in batches:
            n = [counter.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens): one row for each row of docs, as a unigram tokenizer of the model's
    pieces and scores counts them, with the space mark put before a text that has none. A null or
    empty text has 0; repeated rows stay; an empty table gives no rows."""
    return docs.select("doc_id", "text").mapInArrow(_counted(model_path), "doc_id long, n_tokens long")
