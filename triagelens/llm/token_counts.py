"""Token counts of a unigram tokenizer without making its tokens.

The vocabulary's pieces are put into an Aho-Corasick automaton, which enumerates every
occurrence of every piece in one pass. Dynamic programming over the end positions
carries only the best score and the number of pieces of the best segmentation. Rules
follow the public unigram tokenizers:

* Blanks become the mark ``▁``, one is put in front of the text, and each mark begins a
  new part; no piece spans two parts.
* Pieces that end at a position are compared in order of their start, the longest
  first, and only a strictly better score replaces an earlier one.
* Where no piece of a single character fits, the character is unknown, with a score of
  10 below the lowest of the vocabulary. Each unknown character counts as one piece for
  every byte of its UTF-8 form if the vocabulary has byte pieces, otherwise a stretch of
  unknown characters counts as one piece.

A worker remembers the counts of parts it has seen, which are mostly words.

Defined results: null and empty texts have 0 pieces; repeated rows are each counted; an
empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from triagelens.llm.common import documents, small_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 300_000  # parts


def pieces_of(model_path: str) -> tuple[list[tuple[str, float]], bool]:
    """Ordinary pieces of a vocabulary file with their scores; whether it has byte pieces."""
    processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces, has_bytes = [], False
    for i in range(processor.get_piece_size()):
        if processor.is_byte(i):
            has_bytes = True
        elif not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)):
            pieces.append((processor.id_to_piece(i), processor.get_score(i)))
    return pieces, has_bytes


class Counter:
    """Counts pieces; ``pieces`` are (text, score)."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.byte_pieces = byte_pieces
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def part(self, text: str) -> int:
        """Pieces of the best segmentation of one part."""
        ends: list[list[tuple[int, float]]] = [[] for _ in range(len(text) + 1)]
        for end, piece in self.automaton.iter(text):
            ends[end + 1].append(piece)
        score = [0.0] * (len(text) + 1)
        count = [0] * (len(text) + 1)
        gap = [False] * (len(text) + 1)  # the best segmentation ends with an unknown character
        for end in range(1, len(text) + 1):
            best = None
            single = False
            # Longest first: starts in ascending order.
            for length, value in sorted(ends[end], reverse=True):
                single = single or length == 1
                total = score[end - length] + value
                if best is None or total > best:
                    best, count[end] = total, count[end - length] + 1
            if not single:
                total = score[end - 1] + self.unknown
                if best is None or total > best:
                    best, gap[end] = total, True
                    more = len(text[end - 1].encode("utf-8", "surrogatepass")) if self.byte_pieces else int(not gap[end - 1])
                    count[end] = count[end - 1] + more
            score[end] = best
        return count[-1]

    def text(self, text: str) -> int:
        if not text:
            return 0
        total = 0
        known = self.known
        marked = text.replace(" ", MARK)
        if not marked.startswith(MARK):
            marked = MARK + marked
        for word in marked.split(MARK)[1:]:
            found = known.get(word)
            if found is None:
                found = self.part(MARK + word)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(word) <= 64:
                    known[word] = found
            total += found
        return total


@lru_cache(maxsize=2)
def counter(model_path: str) -> Counter:
    """One counter per worker and vocabulary."""
    return Counter(*pieces_of(model_path))


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_chars, n_tokens`` of every row."""

    def run(batches):
        count = counter(model_path).text
        for batch in batches:
            texts = batch.column("text").to_pylist()
            columns = [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([count(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "n_tokens"])

    small_batches(docs.sparkSession)
    return documents(docs).mapInArrow(run, "doc_id long, n_chars long, n_tokens long")
