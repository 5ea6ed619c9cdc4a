"""N-gram Jaccard join by parity sketches.

A document's set holds the 64-bit hashes of its distinct word shingles. Two sets of
sizes a and b have a Jaccard similarity of at least t exactly if their symmetric
difference has at most D = (1 - t) / (1 + t) * (a + b) members.

The parity sketch of a set XORs the hashes of its members into bit blocks; XORing two
sketches gives the sketch of the symmetric difference, so the blocks (or bits) in
which two sketches differ are at most as many as the members in which the sets do.
That is used twice:

* Pigeonhole join. For each band of a + b the hash range is cut into a little more
  than D + 1 blocks. If at most D members differ, all but D of a set's non-empty blocks
  are equal in the other sketch, so among the first D + 1 non-empty blocks of each set
  there is one they share. Each set sends those block signatures as join keys to the
  one or two bands its partners can be in. A set with no more than D non-empty blocks
  also sends one key that all such sets of the band share, so nothing is missed.
* Filter. Of the pairs that meet, those whose bit sketches differ in more than D bits
  are dropped before any set is moved.

The rest is verified on the sets. Components need not be found pair by pair: in every
bucket each set is first paired with the bucket's smallest one only, which joins groups
of near copies at linear cost. What remains are buckets with sets of different
components; only there, sets of different components are compared with each other, by
their sketches. No pair leaves that comparison, only the sets that are close to one of
another component; components with such sets form clusters, and inside the cells of a
cluster close pairs are verified, the closest first, until links span the cell's components.

Equal sets are one set from the start: a task sends the keys of a set once, however
many copies of the document it sees. Set ids are 64-bit hashes as well: among N
different sets, N * N / 2**65 are expected to be taken for one another.

Defined results: null and empty texts and texts without words have an empty set and
are linked with nothing; fewer words than a shingle make one shingle of the whole
sequence; repeated rows are equal sets; a null id never names a component unless no
other id is in it; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelens.llm.common import documents, small_batches, written

WORDS = 5
PERCENT = 80
BAND_RATIO = 1.6
MIN_BLOCKS = 32
SLAB = 1 << 20  # bytes of a text that are split into words at once
SMALL = 256  # bytes of a folded sketch at most
CELL = 1024  # sets of a bucket that are compared with each other in one place, about
CELL_MEMBERS = 1 << 20  # members of the sets of a part, about
SEEN = 200_000  # sets a task remembers, to send copies once

MIX1, MIX2, MIX3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
BLANK = re.compile(rb"[\x20\x09-\x0d]")


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * MIX3
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    content = text.encode("utf-8", "surrogatepass").lower()
    parts, begin = [], 0
    while begin < len(content):
        gap = BLANK.search(content, min(begin + SLAB, len(content)))
        end = gap.start() if gap else len(content)
        words = content[begin:end].split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)))
        begin = end + 1
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``text``."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    count = len(hashes) - width + 1
    joined = np.full(count, width, dtype=np.uint64)
    for i in range(width):
        joined = mixed(joined * MIX1 + hashes[i : i + count])
    return np.unique(joined)


def set_id_of(members: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(members.tobytes())).view(np.int64))


class Bands:
    """Bands of a + b and what follows from them for a similarity of ``percent``."""

    def __init__(self, percent: int = PERCENT, largest: int = 1 << 40):
        self.percent = percent
        self.edges = [0, 16]
        while self.edges[-1] <= 3 * largest:
            self.edges.append(int(self.edges[-1] * BAND_RATIO))
        self.uppers = np.array(self.edges[1:])

    def allowed(self, total: int) -> int:
        """Largest symmetric difference of linked sets whose sizes add up to ``total``."""
        return (100 - self.percent) * total // (100 + self.percent)

    def of(self, n: int) -> Iterator[tuple[int, int, int]]:
        """Band, blocks and allowed difference for every band that partners of a set
        of ``n`` members can lie in."""
        low = n + -(-n * self.percent // 100)
        high = n + n * 100 // self.percent
        for band in range(int(np.searchsorted(self.uppers, low, "right")), int(np.searchsorted(self.uppers, high, "right")) + 1):
            widest = self.allowed(int(self.uppers[band]) - 1)
            blocks = max(MIN_BLOCKS, int(1.06 * (widest + 1)) + 3)
            yield band, blocks, min(widest, self.allowed(high))


def join_keys(members: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of the blocks by which linked sets meet."""
    other = mixed(members * MIX1)
    keys = []
    for band, blocks, allowed in bands.of(len(members)):
        block = ((members >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        begins = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        if len(begins) <= allowed:
            keys.append(mixed(np.array([band + 1], dtype=np.uint64) * MIX3))
        parity = np.bitwise_xor.reduceat(other, begins)[: allowed + 1]
        place = block[begins[: allowed + 1]] * MIX2 + np.uint64(band)
        keys.append(mixed(parity + mixed(place * MIX1)))
    return np.concatenate(keys).view(np.int64)


def bit_sketch(members: np.ndarray) -> bytes:
    """Parity bits of the members, two to four bits for each."""
    bits = max(64, 2 << (len(members) - 1).bit_length())
    place = (mixed(members * MIX1) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded onto the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


# ----------------------------------------------------------------------------- stages


def sketch(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_key, n, set_id, bits, small, keys`` of every row; keys are empty for a copy
    of a set that the task has already sent, set and bits are null for an empty set.
    ``text_key`` tells rows of one id with different texts apart."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int32()), ("set_id", pa.int64()), ("bits", pa.binary()), ("small", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        bands, seen = Bands(percent), set()
        for batch in batches:
            ids, texts, text_keys = batch.columns
            sizes, sets, bits, small, keys = [], [], [], [], []
            for text in texts.to_pylist():
                members = shingle_set(text, words)
                sizes.append(len(members))
                if not len(members):
                    sets.append(None), bits.append(None), small.append(None), keys.append([])
                    continue
                set_id = set_id_of(members)
                sets.append(set_id)
                bits.append(bit_sketch(members))
                small.append(folded(bits[-1]))
                keys.append([] if set_id in seen else join_keys(members, bands))
                if len(seen) < SEEN:
                    seen.add(set_id)
            columns = [ids, text_keys, pa.array(sizes, pa.int32()), pa.array(sets, pa.int64()), pa.array(bits, pa.binary()), pa.array(small, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    small_batches(docs.sparkSession)
    rows = documents(docs).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n int, set_id long, bits binary, small binary, keys array<long>")


def similar_sizes(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def buckets(sketched: DataFrame) -> DataFrame:
    """Sets that share a key with a smaller one: ``key, lead, n_lead, set_id, n``.

    ``lead`` is the smallest set id of the bucket.
    """
    rows = sketched.select("set_id", "n", F.explode("keys").alias("key"))
    lead = F.first(F.struct("set_id", "n")).over(Window.partitionBy("key").orderBy("set_id"))
    return (
        rows.withColumn("_lead", lead)
        .where("set_id <> _lead.set_id")
        .select("key", F.col("_lead.set_id").alias("lead"), F.col("_lead.n").alias("n_lead"), "set_id", "n")
    )


def near_pairs(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs ``a, b`` whose bit sketches allow the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    bands = Bands(percent)

    def run(batches):
        for batch in batches:
            a, b, n, m, x, y = (column.to_pylist() for column in batch.columns)
            near = [i for i in range(len(a)) if differing_bits(x[i], y[i]) <= bands.allowed(n[i] + m[i])]
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in near], pa.int64()) for c in (a, b)], schema=schema)

    left = sets.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = sets.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return joined.mapInArrow(run, "a long, b long")


def members_of(needed: DataFrame, docs: DataFrame, sets: DataFrame, words: int = WORDS) -> DataFrame:
    """``set_id, members`` of the sets ``needed``, from the text of one document each."""
    schema = pa.schema([("set_id", pa.int64()), ("members", pa.binary())])

    def run(batches):
        for batch in batches:
            ids, texts = batch.columns
            found = [shingle_set(text, words) for text in texts.to_pylist()]
            # An id can stand for several texts: only the one asked for is kept.
            kept = [i for i, wanted in enumerate(ids.to_pylist()) if set_id_of(found[i]) == wanted]
            columns = [ids.take(pa.array(kept, pa.int64())), pa.array([found[i].tobytes() for i in kept], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    places = needed.distinct().join(sets, "set_id").select("set_id", "place")
    texts = documents(docs).join(places, F.expr("doc_id <=> place")).select("set_id", "text")
    return written(texts.mapInArrow(run, "set_id long, members binary").dropDuplicates(["set_id"]), "members")


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs whose sets have the similarity, counted exactly."""
    pair_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches):
        for batch in batches:
            a, b, x, y = (column.to_pylist() for column in batch.columns)
            kept = []
            for i in range(len(a)):
                p, q = np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in kept], pa.int64()) for c in (a, b)], schema=pair_schema)

    needed = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b"))
    members = members_of(needed, docs, sets, words)
    left = members.select(F.col("set_id").alias("a"), F.col("members").alias("x"))
    right = members.select(F.col("set_id").alias("b"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """``node, label`` for the ends of ``links``; the label is the component's smallest node.

    Labels spread along links and then jump to the label of their label, so the rounds
    grow with the logarithm of a chain's length. Each round is a written table.
    """
    both = written(links.union(links.select("b", "a")).toDF("u", "v").where("u <> v").distinct(), "links")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        top = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = spread.join(top, "label").select("node", "before", F.least("label", "top").alias("label"))
        step = written(jumped, "labels")
        labels = step.select("node", "label")
        if step.where("before <> label").isEmpty():
            return labels


def folded(bits: bytes, most: int = SMALL) -> bytes:
    """A sketch of at most ``most`` bytes: longer ones XORed onto themselves."""
    x = np.frombuffer(bits, np.uint8)
    return np.bitwise_xor.reduce(x.reshape(-1, most), axis=0).tobytes() if len(x) > most else bits


def close_to(i: int, bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places after ``i`` of sets with another label, a similar size and a close sketch, and
    in how many bits those differ."""
    others = slice(i + 1, None)
    near = labels[others] != labels[i]
    near &= 100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])
    places = np.flatnonzero(near) + i + 1
    apart = np.bitwise_count(bits[places] ^ bits[i]).sum(axis=1, dtype=np.int64)
    close = apart <= (100 - percent) * (sizes[places] + sizes[i]) // (100 + percent)
    return places[close], apart[close]


def stacked(sketches: list[bytes]) -> np.ndarray:
    """Sketches of a cell as rows, folded to the shortest of them."""
    shortest = min(map(len, sketches))
    return np.stack([np.frombuffer(folded(x, shortest), np.uint8) for x in sketches]).view(np.uint64)


class Groups:
    """Union-find over labels."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def cells_of(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows of each cell, from batches that are sorted by the columns that name it."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        changes = np.zeros(whole.num_rows, bool)
        for name in names:
            values = whole.column(name).to_numpy()
            changes[1:] |= values[1:] != values[:-1]
        begins = [0, *np.flatnonzero(changes).tolist()]
        for begin, end in zip(begins, begins[1:], strict=False):
            yield whole.slice(begin, end - begin)
        held = whole.slice(begins[-1])
    if held is not None:
        yield held


def open_sets(met: DataFrame, labels: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """What is left to verify once the smallest set of every bucket has been compared with
    the others: ``set_id, label, null`` for each set that is close to one of another
    component in some bucket, and ``null, label, other`` for components that hold such sets.

    The sets of a bucket are compared by their folded sketches inside the task that holds
    the bucket. A bucket of more than ``CELL`` sets is split into parts, and every two parts
    meet in a cell of their own, so no task holds more than two parts at once. A cell sends
    no pair of sets: each set once at most, and of the components a spanning forest.
    """
    of_lead = labels.select(F.col("node").alias("lead"), F.col("label").alias("lead_label"))
    of_set = labels.select(F.col("node").alias("set_id"), "label")
    rows = met.join(of_lead, "lead", "left").join(of_set, "set_id", "left")
    rows = rows.select("key", "set_id", "n", F.coalesce("label", "set_id").alias("label"), F.coalesce("lead_label", "lead").alias("lead_label"))
    rows = written(rows, "labelled")
    open_keys = (
        rows.groupBy("key")
        .agg(F.count("*").alias("in_bucket"), F.max(F.col("label") != F.col("lead_label")).alias("open"))
        .where("open and in_bucket > 1")
        .select("key", F.ceil(F.col("in_bucket") / CELL).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64("set_id", F.lit(2)), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(F.col("part"), j).alias("i"), F.greatest(F.col("part"), j).alias("j")))
    in_cells = (
        rows.join(open_keys, "key")
        .withColumn("part", part)
        .withColumn("cell", F.explode(cells))
        .join(sets.select("set_id", "small"), "set_id")
        .select("key", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "set_id", "n", "label", "small")
    )
    schema = pa.schema([("set_id", pa.int64()), ("label", pa.int64()), ("other", pa.int64())])

    def compare(batches):
        known: set[int] = set()  # sets meet in many buckets: once per task is enough
        joined = Groups()  # components that the task has sent edges of
        for cell in cells_of(batches, ("key", "i", "j")):
            if cell.num_rows < 2:
                continue
            ids, sizes, marks = cell.column("set_id").to_numpy(), cell.column("n").to_numpy().astype(np.int64), cell.column("label").to_numpy()
            bits = stacked(cell.column("small").to_pylist())
            close, edges = np.zeros(len(ids), bool), []
            for i in range(len(ids) - 1):
                places, _ = close_to(i, bits, sizes, marks, percent)
                if len(places):
                    close[i] = True
                    close[places] = True
                    edges += [(marks[i].item(), other) for other in np.unique(marks[places]).tolist() if joined.join(marks[i].item(), other)]
            found = {i: m for i, m in zip(ids[close].tolist(), marks[close].tolist(), strict=True) if i not in known}
            if len(known) < SEEN:
                known.update(found)
            if len(joined.parent) > SEEN:
                joined = Groups()
            if found or edges:
                columns = ([*found, *[None] * len(edges)], [*found.values(), *[a for a, _ in edges]], [*[None] * len(found), *[b for _, b in edges]])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    dealt = in_cells.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(compare, "set_id long, label long, other long").distinct()


def spanning_links(
    ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray, sketches: list[bytes], members: list[bytes], percent: int
) -> list[tuple[int, int]]:
    """Verified links that join all components which links of the cell join, the closest
    pairs first; one less than there are components at most."""
    bits = stacked(sketches)
    found = [(places, apart) for places, apart in (close_to(i, bits, sizes, labels, percent) for i in range(len(ids) - 1))]
    left = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
    if not len(left):
        return []
    right = np.concatenate([p for p, _ in found])
    order = np.argsort(np.concatenate([a for _, a in found]), kind="stable")
    sets = [np.frombuffer(m, np.uint64) for m in members]
    groups, links = Groups(), []
    for begin in range(0, len(order), 4096):
        for k in order[begin : begin + 4096].tolist():
            a, b = int(left[k]), int(right[k])
            x, y = labels[a].item(), labels[b].item()
            if groups.find(x) == groups.find(y):
                continue
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                groups.join(x, y)
                links.append((ids[a].item(), ids[b].item()))
    return links


def open_links(found: DataFrame, docs: DataFrame, sets: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Verified links ``a, b`` between the components of ``open_sets``, enough to join all
    that links join.

    Components that hold close sets form clusters; a set is in one cluster, however many
    buckets it shares with others. The sets of a cluster are dealt by size, in bands so wide
    that linked sets are in one or in neighbouring ones, and every two parts of such bands
    meet in a cell with the sets' members, where close pairs are verified.
    """
    clusters = connected(found.where("set_id is null").select(F.col("label").alias("a"), F.col("other").alias("b")))
    rows = found.where("set_id is not null").select("set_id", "label").distinct()
    rows = rows.join(clusters.toDF("label", "cluster"), "label").join(sets.select("set_id", "n", "small"), "set_id")
    rows = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.01 * 100 / percent))).cast("int"))
    rows = written(rows, "open")
    parts = rows.groupBy("cluster", "band").agg(F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("n") / CELL_MEMBERS)).cast("int").alias("parts"))
    parts = written(parts, "parts")
    own = rows.join(parts, ["cluster", "band"]).withColumn("part", F.pmod(F.xxhash64("set_id", F.lit(3)), F.col("parts")).cast("int")).drop("parts")
    near = own.withColumn("other_band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    near = near.join(parts.toDF("cluster", "other_band", "parts"), ["cluster", "other_band"]).withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    here, there = F.struct(F.col("band").alias("b"), F.col("part").alias("p")), F.struct(F.col("other_band").alias("b"), F.col("other_part").alias("p"))
    near = near.withColumn("low", F.least(here, there)).withColumn("high", F.greatest(here, there))
    cell = near.select("cluster", F.col("low.b").alias("b1"), F.col("low.p").alias("p1"), F.col("high.b").alias("b2"), F.col("high.p").alias("p2"), "set_id", "n", "label", "small")
    members = members_of(rows.select("set_id"), docs, sets, words)
    names = ("cluster", "b1", "p1", "b2", "p2")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches):
        for batch in cells_of(batches, names):
            ids, sizes, marks = batch.column("set_id").to_numpy(), batch.column("n").to_numpy().astype(np.int64), batch.column("label").to_numpy()
            links = spanning_links(ids, sizes, marks, batch.column("small").to_pylist(), batch.column("members").to_pylist(), percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], schema=schema)

    dealt = cell.join(members, "set_id").repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(verify, "a long, b long").distinct()


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_key, n, class`` of every row; the class of an empty set is null."""
    sketched = written(sketch(docs, words, percent), "sketches")
    sets = sketched.where("set_id is not null").groupBy("set_id")
    sets = sets.agg(F.min("doc_id").alias("place"), *[F.first(c).alias(c) for c in ("n", "bits", "small")])
    sets = written(sets, "sets")
    met = written(buckets(sketched), "buckets")
    stars = met.where(similar_sizes("n", "n_lead", percent)).select(F.col("lead").alias("a"), F.col("set_id").alias("b")).distinct()
    near = written(near_pairs(stars, sets, percent), "pairs")
    links = written(verified(near, docs, sets, words, percent), "verified")
    labels = connected(links)
    found = written(open_sets(met, labels, sets, percent), "close")
    if not found.isEmpty():
        labels = connected(links.union(open_links(found, docs, sets, words, percent)))
    rows = sketched.select("doc_id", "text_key", "n", "set_id").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    return rows.select("doc_id", "text_key", "n", F.coalesce("label", "set_id").alias("class"))


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    rows = classes(docs, words, percent)
    first = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "class", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id")
    )


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each class, that of the smallest id, all columns unchanged; rows
    without words are in no class and all stay."""
    rows = written(classes(docs, words, percent), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    first = rows.where("class is not null").groupBy("class").agg(F.min(order).alias("f"))
    kept = first.select(F.col("f.doc_id").alias("_id"), F.col("f.text_key").alias("_key"), F.lit(False).alias("_empty"))
    empty = rows.where("class is null").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.lit(True).alias("_empty"))
    kept = kept.union(empty.distinct())
    keyed = docs.withColumn("_text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(kept, F.expr("doc_id <=> _id and _text_key = _key"))
    copy = F.row_number().over(Window.partitionBy("_id", "_key").orderBy("_empty"))
    return joined.withColumn("_copy", copy).where("_empty or _copy = 1").select(*docs.columns)
