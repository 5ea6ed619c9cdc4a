"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own,
wherever the row landed. A chunk's first boundaries may be wrong, because the cut
can fall inside a pre-token; but once it starts a pre-token where the chunk before
it starts one too, both see the same text from there on and agree for good. The
chunks are stitched at that position and the pieces between two stitches are
encoded in parallel. Where an overlap holds no common boundary (a pre-token longer
than the overlap) the open end is pre-tokenised again together with the next chunk.

A text of one chunk has nothing to stitch and is encoded where it is read, split by the
encoder itself. Chunks are split by another engine, to know the boundaries; the classes of
letters and numbers it splits by are read off the encoder's, code point by code point.

Defined results: null and empty texts have no ids; repeated rows are each encoded;
a null id is kept. Other columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelens.llm.common import documents, small_batches

CHUNK = 1 << 16  # code points
OVERLAP = 512
LOOKAHEAD = 2  # code points beyond a pre-token that the pattern may look at
CACHE = 200_000  # pieces whose ids a worker remembers

KEYS = "doc_id long, text_key string, copies long"


@lru_cache(maxsize=4)
def encoding(vocabulary: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file, made once per worker."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


EVERY = [*range(0xD800), *range(0xE000, 0x110000)]  # code points of texts


def counted_to(escape: str) -> set[int]:
    """The code points that the encoder's own engine counts to a class such as ``\\p{L}``."""
    single = tiktoken.Encoding("class", pat_str=escape, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    # Text between matches has no tokens, so what comes back are the matches.
    return set(map(ord, single.decode_bytes(single.encode_ordinary("".join(map(chr, EVERY)))).decode()))


def ranges(points: set[int]) -> str:
    """``points`` as the inside of a class."""
    begins = sorted(c for c in points if c - 1 not in points)
    ends = sorted(c for c in points if c + 1 not in points)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if a < b else f"\\U{a:08x}" for a, b in zip(begins, ends, strict=True))


class Splitter:
    """The pattern as the encoder's engine reads it, on another engine, whose Unicode tables
    are of another year: property escapes are replaced by the encoder's classes. Texts
    without any code point on which the two differ are split by the pattern as it is."""

    def __init__(self, pattern: str):
        self.plain = regex.compile(pattern)
        known: dict[str, str] = {}
        differ: set[int] = set()
        out, inside = [], False
        for part in regex.finditer(r"\\[pP]\{\^?\w+\}|\\.|[\[\]]|[^\\\[\]]+", pattern):
            text = part[0]
            if text in "[]":
                inside = text == "["
            elif text.startswith(("\\p{", "\\P{")):
                if text not in known:
                    points = counted_to(text)
                    known[text] = ranges(points)
                    differ |= points ^ set(map(ord, regex.findall(text, "".join(map(chr, EVERY)))))
                text = known[text] if inside else f"[{known[text]}]"
            out.append(text)
        self.exact = regex.compile("".join(out)) if differ else self.plain
        self.beyond = regex.compile(f"[\\U{min(differ, default=0x10FFFF):08x}-\\U0010ffff]")
        self.differ = regex.compile(f"[{ranges(differ or {0x10FFFF})}]")

    def finditer(self, text: str) -> Iterator[regex.Match]:
        exact = self.beyond.search(text) and self.differ.search(text)
        return (self.exact if exact else self.plain).finditer(text)


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Splitter:
    """Made once per worker."""
    return Splitter(pattern)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema, weight, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded weight."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += weight(row)
        if total >= limit or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


# ---------------------------------------------------------------- texts of one chunk


def encode_whole(docs: DataFrame, vocabulary: str, pattern: str, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, part, ids`` of the texts that fit one chunk; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        encoder = encoding(vocabulary, pattern)
        rows = ((doc_id, 0, encoder.encode_ordinary(text)) for doc_id, text in rows_of(batches))
        yield from batched(rows, schema, lambda row: 4 * len(row[2]) + 64)

    small_batches(docs.sparkSession)
    short = documents(docs).where(F.length("text") <= chunk)
    return short.mapInArrow(run, "doc_id long, part int, ids array<int>")


# ------------------------------------------------------------- texts of several chunks


def cut(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping chunks of the longer texts: ``doc_id, text_key, chunk_no, last, text``.

    ``text_key`` tells rows of one id with different texts apart.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("text", pa.string())]
    )

    def pieces(doc_id, text):
        key = hashlib.md5(text.encode()).hexdigest()
        count = -(-len(text) // chunk)
        for k in range(count):
            yield doc_id, key, k, k == count - 1, text[k * chunk : (k + 1) * chunk + overlap]

    def run(batches):
        rows = (piece for doc_id, text in rows_of(batches) for piece in pieces(doc_id, text))
        yield from batched(rows, schema, lambda row: len(row[4]))

    small_batches(docs.sparkSession, 64)
    longer = documents(docs).where(F.length("text") > chunk)
    return longer.mapInArrow(run, "doc_id long, text_key string, chunk_no int, last boolean, text string")


def starts_of(pattern, text: str, open_end: bool) -> list[int]:
    """Where pre-tokens start, and the end of the text.

    With an open end, matches that end within ``LOOKAHEAD`` of it are not sure, as
    more text could change them: only the start of the first of them is given.
    """
    starts = []
    for match in pattern.finditer(text):
        starts.append(match.start())
        if open_end and match.end() + LOOKAHEAD > len(text):
            return starts
    return starts if open_end and starts else [*starts, len(text)]


def pretokenise(chunks: DataFrame, pattern: str) -> DataFrame:
    """Chunks with the boundaries found in them."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("text", pa.string()), ("starts", pa.list_(pa.int32()))]
    )

    def run(batches):
        compiled = splitter(pattern)
        rows = ((*row, starts_of(compiled, row[4], not row[3])) for row in rows_of(batches))
        yield from batched(rows, schema, lambda row: 2 * len(row[4]))

    spread = chunks.repartition(F.col("doc_id"), F.col("text_key"), F.col("chunk_no"))
    return spread.mapInArrow(
        run, "doc_id long, text_key string, chunk_no int, last boolean, text string, starts array<int>"
    )


class Stitcher:
    """Joins the chunks of one text, given in order; holds one chunk at a time."""

    def __init__(self, pattern, chunk: int):
        self.pattern, self.chunk = pattern, chunk
        self.base, self.text, self.starts, self.begin = 0, "", [], 0
        self.empty = True

    def segment(self, until: int) -> Iterator[tuple[str, list[int]]]:
        """Text from the last stitch up to ``until`` with the ends of its pieces."""
        if until > self.begin:
            first = bisect_left(self.starts, self.begin - self.base)
            stop = bisect_left(self.starts, until - self.base)
            ends = [p + self.base - self.begin for p in self.starts[first + 1 : stop + 1]]
            yield self.text[self.begin - self.base : until - self.base], ends
            self.begin = until

    def add(self, number: int, last: bool, text: str, starts: list[int]) -> Iterator[tuple[str, list[int]]]:
        base = number * self.chunk
        if self.empty:
            self.base, self.text, self.starts, self.empty = base, text, starts, False
            return
        ours = {p + self.base for p in self.starts if p + self.base >= base}
        meet = next((p + base for p in starts if p + base in ours), None)
        if meet is not None:
            yield from self.segment(meet)
            self.base, self.text, self.starts = base, text, starts
            return
        sure = self.starts[-1] + self.base
        yield from self.segment(sure)
        self.text = self.text[sure - self.base :] + text[self.base + len(self.text) - base :]
        self.base = sure
        self.starts = starts_of(self.pattern, self.text, not last)

    def end(self) -> Iterator[tuple[str, list[int]]]:
        yield from self.segment(self.base + len(self.text))


def stitch(tokenised: DataFrame, pattern: str, chunk: int = CHUNK) -> DataFrame:
    """Segments of text between stitches, each with the ends of its pieces."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.string()), ("copies", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("ends", pa.list_(pa.int32()))]
    )

    def segments(rows):
        compiled = splitter(pattern)
        owner = stitcher = None
        copies = part = number = 0
        # A segment waits for the number of copies, known when chunk 1 arrives.
        for doc_id, key, chunk_no, last, text, starts in rows:
            if (doc_id, key) != owner:
                if stitcher:
                    for piece in stitcher.end():
                        yield (*owner, copies, part, *piece)
                owner, stitcher, copies, part, number = (doc_id, key), Stitcher(compiled, chunk), 0, 0, -1
            copies += chunk_no == 0
            if chunk_no == number:  # the same row again
                continue
            number = chunk_no
            for piece in stitcher.add(chunk_no, last, text, starts):
                yield (*owner, copies, part, *piece)
                part += 1
        if stitcher:
            for piece in stitcher.end():
                yield (*owner, copies, part, *piece)

    def run(batches):
        yield from batched(segments(rows_of(batches)), schema, lambda row: 2 * len(row[4]))

    ordered = tokenised.repartition(F.col("doc_id"), F.col("text_key")).sortWithinPartitions("doc_id", "text_key", "chunk_no")
    return ordered.mapInArrow(run, f"{KEYS}, part int, text string, ends array<int>")


def encode_segments(segments: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id, text_key, copies, part, ids`` of stitched segments, piece by piece."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.string()), ("copies", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int32()))]
    )

    def run(batches):
        encoder = encoding(vocabulary, pattern)
        known: dict[str, list[int]] = {}

        def ids_of(text, ends):
            out, begin = [], 0
            for end in ends:
                piece, begin = text[begin:end], end
                ids = known.get(piece)
                if ids is None:
                    ids = encoder.encode_ordinary(piece)
                    if len(known) < CACHE and len(piece) < 64:
                        known[piece] = ids
                out += ids
            return out

        rows = ((*row[:4], ids_of(*row[4:])) for row in rows_of(batches))
        yield from batched(rows, schema, lambda row: 4 * len(row[4]) + 64)

    spread = segments.repartition(F.col("doc_id"), F.col("text_key"), F.col("part"))
    return spread.mapInArrow(run, f"{KEYS}, part int, ids array<int>")


def encode_long(
    docs: DataFrame, vocabulary: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``doc_id, text_key, copies, part, ids`` of the texts longer than one chunk."""
    tokenised = pretokenise(cut(docs, chunk, overlap), pattern)
    return encode_segments(stitch(tokenised, pattern, chunk), vocabulary, pattern)


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """Token ids of every text as ``doc_id, text_key, part, ids``.

    A text's ids are those of its parts in order. Rows of one id share nothing but
    the id; ``text_key`` (null for texts of one part) tells longer ones apart.
    """
    whole = encode_whole(docs, vocabulary, pattern, chunk)
    parts = encode_long(docs, vocabulary, pattern, chunk, overlap)
    parts = parts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return whole.select("doc_id", F.lit(None).cast("string").alias("text_key"), "part", "ids").unionByName(
        parts.select("doc_id", "text_key", "part", "ids")
    )


def decode(parts: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``content``: the raw bytes of each part's ``ids``; a text is their concatenation.

    A part may begin or end inside a character only if its ids do; the bytes are
    never decoded one part at a time.
    """
    kept = [c for c in parts.columns if c != "ids"]
    schema_sql = ", ".join(f"`{c}` {t}" for c, t in parts.select(*kept).dtypes) + ", content binary"

    def run(batches):
        encoder = encoding(vocabulary, pattern)
        for batch in batches:
            content = [encoder.decode_bytes(ids) for ids in batch.column("ids").to_pylist()]
            columns = [batch.column(c) for c in kept] + [pa.array(content, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "content"])

    return parts.mapInArrow(run, schema_sql)


# ----------------------------------------------------------------------------- digests

DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DIGEST_SQL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Digest:
    """Count of ids, hash of the ids as text and of the decoded bytes, part by part."""

    def __init__(self, encoder):
        self.encoder, self.count = encoder, 0
        self.ids, self.content = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: list[int]) -> None:
        if ids:
            joined = ",".join(map(str, ids))
            self.ids.update((f",{joined}" if self.count else joined).encode())
            self.content.update(self.encoder.decode_bytes(ids))
            self.count += len(ids)

    def row(self, doc_id) -> tuple:
        return doc_id, self.count, self.ids.hexdigest(), self.content.hexdigest()


def digests(docs: DataFrame, vocabulary: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""

    def of_whole(batches):
        encoder = encoding(vocabulary, pattern)

        def one(doc_id, ids):
            digest = Digest(encoder)
            digest.add(ids)
            return digest.row(doc_id)

        yield from batched((one(d, ids) for d, _, ids in rows_of(batches)), DIGEST, lambda row: 256)

    def of_parts(batches):
        encoder = encoding(vocabulary, pattern)

        def texts():
            owner = digest = None
            copies = 0
            for doc_id, key, times, _, ids in rows_of(batches):
                if (doc_id, key) != owner:
                    for _ in range(copies):
                        yield digest.row(owner[0])
                    owner, digest = (doc_id, key), Digest(encoder)
                copies = times
                digest.add(ids)
            for _ in range(copies):
                yield digest.row(owner[0])

        yield from batched(texts(), DIGEST, lambda row: 256)

    whole = encode_whole(docs, vocabulary, pattern, chunk).mapInArrow(of_whole, DIGEST_SQL)
    parts = encode_long(docs, vocabulary, pattern, chunk, overlap)
    ordered = parts.repartition(F.col("doc_id"), F.col("text_key")).sortWithinPartitions("doc_id", "text_key", "part")
    return whole.unionByName(ordered.mapInArrow(of_parts, DIGEST_SQL))
