"""SimHash near-dedup: 64-bit fingerprints of word shingles, compared exactly tile by tile.

Texts go to Python workers whole, and numpy hashes the shingles of many texts at once: words as JVM objects fill an executor's heap.

Two fingerprints within radius r have population counts that differ by r at most, over any split of their bits by the sum
of the differences. Cells are the population counts of 4, 8 or 16 segments; a fingerprint is at home in its own cell and
visits the cells after it whose counts differ by r in all. Tile pairs farther apart are never formed. In each tile pair numpy
compares by exclusive-or and bit counts, and hands on a spanning forest of its links instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravec.llm.arrow import Forest, byte_groups, groups, spans, trimmed
from terravec.llm.common import components, cut, partitions, table, tile_pairs

SHINGLE_WORDS = 3
#: Of XXH64.
SEED = 42
XXH64_PRIMES = tuple(map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)))
#: Bytes of texts whose words are found at once (a longer text alone), and shingles hashed at once.
GROUP, SHINGLES = 1 << 20, 1 << 14
RADIUS = 2
#: Segments of the bits by the number of distinct fingerprints: more of them make smaller cells and more visits, for the same links.
SEGMENTS = ((2_000_000, 4), (200_000_000, 8), (float("inf"), 16))
PER_TILE = 16384
#: A fingerprint with more rows than this meets its component in several parts, at most so many.
COPIES, PARTS = 4096, 1024
#: Pairs compared at once.
BLOCK = 1 << 22


def _word_bounds(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the words in the bytes of texts that lie one after the other up to ``ends``."""
    inside = (text != 32) & ((text < 9) | (text > 13))
    edge = np.zeros(len(text) + 1, dtype=bool)
    edge[0], edge[ends] = True, True
    first = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
    last = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False)))
    return first, last + 1


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(data: np.ndarray, first: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64, unsigned, of each stretch of ``size`` bytes from ``first``; all stretches take each step together."""
    p1, p2, p3, p4, p5 = XXH64_PRIMES
    # the eight bytes from each byte on, as a number
    at = np.ascontiguousarray(np.ndarray(len(data) + 1, dtype="<u8", buffer=np.append(data, np.zeros(8, dtype=np.uint8)), strides=(1,)))
    mixed = lambda v: _rotated(v * p2, 31) * p1
    h = np.full(len(first), seed, dtype=np.uint64) + p5
    pos, left = first.copy(), size.copy()
    if len(some := np.flatnonzero(left >= 32)):
        lanes = np.full((4, len(some)), seed, dtype=np.uint64)
        lanes[0] += p1
        lanes[:2] += p2
        lanes[3] -= p1
        begin, stripes = pos[some], left[some] // 32
        for k in range(int(stripes.max())):
            on = np.flatnonzero(stripes > k)
            for lane in range(4):
                lanes[lane, on] = _rotated(lanes[lane, on] + at[begin[on] + (32 * k + 8 * lane)] * p2, 31) * p1
        whole = sum(_rotated(lane, by) for lane, by in zip(lanes, (1, 7, 12, 18), strict=True))
        for lane in lanes:
            whole = (whole ^ mixed(lane)) * p1 + p4
        h[some] = whole
        pos[some] += 32 * stripes
        left[some] -= 32 * stripes
    h += size.astype(np.uint64)
    for width, most, step in (
        (8, 3, lambda h, v: _rotated(h ^ mixed(v), 27) * p1 + p4),
        (4, 1, lambda h, v: _rotated(h ^ (v & np.uint64(0xFFFFFFFF)) * p1, 23) * p2 + p3),
        (1, 3, lambda h, v: _rotated(h ^ (v & np.uint64(0xFF)) * p5, 11) * p1),
    ):
        for _ in range(most):
            on = np.flatnonzero(left >= width)
            h[on] = step(h[on], at[pos[on]])
            pos[on] += width
            left[on] -= width
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def shingle_hashes(texts: pa.Array, shingle: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, many): XXH64 of the shingles of words of each text, A-Z lower-cased, space-joined, repeats included, and how many it has.

    A text of fewer words has one shingle, of all of them; one without words has none.
    """
    size = pc.binary_length(texts).to_numpy()
    ends = np.cumsum(size, dtype=np.int64)
    offset = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offset : offset + ends[-1]].copy()
    data[(data >= ord("A")) & (data <= ord("Z"))] += 32
    word, to = _word_bounds(data, ends)
    upto = np.searchsorted(word, ends)
    n_words = np.diff(upto, prepend=0)
    many = np.where(n_words >= shingle, n_words - (shingle - 1), np.minimum(n_words, 1))
    first = spans(upto - n_words, many)
    last = first + np.repeat(np.minimum(n_words, shingle) - 1, many)
    out = np.zeros(len(first), dtype=np.uint64)
    for k in range(0, len(first), SHINGLES):
        a, b = first[k : k + SHINGLES], last[k : k + SHINGLES]
        w, t = word[a[0] : b[-1] + 1], to[a[0] : b[-1] + 1]
        # these words alone, one space after each
        begin = np.cumsum(t - w + 1) - (t - w + 1)
        joined = np.full(begin[-1] + t[-1] - w[-1] + 1, 32, dtype=np.uint8)
        in_word = np.ones(len(joined), dtype=bool)
        in_word[begin + (t - w)] = False
        part = data[w[0] : t[-1]]
        depth = np.zeros(len(part) + 1, dtype=np.int8)
        depth[w - w[0]] += 1
        depth[t - w[0]] -= 1
        joined[in_word] = part[np.cumsum(depth[:-1], dtype=np.int8) > 0]
        out[k : k + SHINGLES] = xxh64(joined, begin[a - a[0]], begin[b - a[0]] + (t - w)[b - a[0]] - begin[a - a[0]])
    return out, many


def _majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(hashes)).view(">u8")[0]


def _fingerprinted(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Replaces the column _t of texts by fp."""
        for batch in batches:
            at = batch.schema.get_field_index("_t")
            texts, fp = pc.fill_null(batch.column(at), ""), np.zeros(batch.num_rows, dtype=np.uint64)
            for a, b in byte_groups(texts, GROUP) if batch.num_rows else ():
                hashes, many = shingle_hashes(texts.slice(a, b - a), shingle)
                ends = np.cumsum(many)
                for i in np.flatnonzero(many).tolist():
                    fp[a + i] = _majority(hashes[ends[i] - many[i] : ends[i]])
            yield batch.remove_column(at).append_column("fp", pa.array(fp.view(np.int64)))

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc, text_hash, fp long) of each row; a null, empty or blank text has fingerprint 0."""
    own = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_t"))
    return own.mapInArrow(trimmed(_fingerprinted(shingle)), f"doc {docs.schema[id_col].dataType.simpleString()}, text_hash bigint, fp bigint")


def neighbour_cells(radius: int, segments: int) -> list[tuple[int, ...]]:
    """Differences of segment counts of at most radius in all that are zero or lexicographically positive."""
    found = [((), 0)]
    for _ in range(segments):
        found = [((*o, x), used + abs(x)) for o, used in found for x in range(used - radius, radius - used + 1)]
    return sorted(o for o, _ in found if o >= (0,) * segments)


def dealt_to_cells(fps: DataFrame, radius: int = RADIUS, segments: int = 4) -> DataFrame:
    """Each row (fp, ...) in its home cell and in the cells it visits: adds cell and home."""
    width = 64 // segments
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit((1 << width) - 1))) for k in range(segments)]
    struct = lambda o: F.struct(*(F.lit(x).alias(f"o{k}") for k, x in enumerate(o)))
    near = fps.withColumns({f"_p{k}": c for k, c in enumerate(counts)}).withColumn("_o", F.explode(F.array(*map(struct, neighbour_cells(radius, segments)))))
    at = [F.col(f"_p{k}") + F.col(f"_o.o{k}") for k in range(segments)]
    cell, home, inside = F.lit(0).cast("long"), F.lit(True), F.lit(True)
    for k, c in enumerate(at):
        cell, home, inside = cell * (width + 1) + c, home & (F.col(f"_o.o{k}") == 0), inside & c.between(0, width)
    return near.filter(inside).select(*fps.columns, cell.alias("cell"), home.alias("home"))


def _linked(radius: int):
    def near(forest: Forest, fp: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        step = max(1, BLOCK // max(1, len(right)))
        for a in range(0, len(left), step):
            hits = np.bitwise_count(fp[left[a : a + step], None] ^ fp[None, right]) <= radius
            if hits.any():
                forest.link(hits, left[a : a + step], right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["cell", "tile_i", "tile_j"]):
            home = g.column("home").to_numpy(zero_copy_only=False)
            if g.num_rows < 2 or not home.any():
                continue
            fp, tile = g.column("fp").to_numpy().view(np.uint64), g.column("tile").to_numpy()
            forest, every = Forest(g.num_rows), np.arange(g.num_rows)
            if g.column("tile_i")[0] == g.column("tile_j")[0]:
                near(forest, fp, every[home], every)
            else:
                first = tile == g.column("tile_i")[0].as_py()
                near(forest, fp, every[home & first], every[~first])
                near(forest, fp, every[~home & first], every[home & ~first])
            child, root = forest.edges()
            if len(child):
                rep = g.column("rep")
                yield pa.RecordBatch.from_arrays([rep.take(pa.array(child)), rep.take(pa.array(root))], names=["a", "b"])

    return run


def fingerprint_links(reps: DataFrame, radius: int = RADIUS, segments: int | None = None, per_tile: int = PER_TILE) -> DataFrame:
    """(fp, rep) of distinct fingerprints -> links (a, b) of reps whose closure is that of all pairs within radius."""
    if segments is None:
        n = reps.count()
        segments = next(k for most, k in SEGMENTS if n <= most)
    cells = tile_pairs(dealt_to_cells(reps, radius, segments), ["cell"], "fp", per_tile)
    keys = ["cell", "tile_i", "tile_j"]
    sorted_tiles = cells.repartition(partitions(reps.sparkSession), *keys).sortWithinPartitions(*keys)
    kind = reps.schema["rep"].dataType.simpleString()
    return sorted_tiles.mapInArrow(trimmed(_linked(radius)), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, radius: int = RADIUS, segments: int | None = None, per_tile: int = PER_TILE) -> DataFrame:
    """(doc, text_hash, fp, component) of each row: component is the smallest id whose text is reachable over links of
    fingerprints within radius; text_hash is that of xxhash64.

    Copies have one fingerprint and are linked through it. Repeated rows stay, and rows of one id with several texts may be in
    several components. Rows with a null id get a component but never name one; a component of only null ids is null. Texts
    without a word have fingerprint 0. Texts of any length are taken whole. Other columns aren't looked at. An empty table
    gives an empty result.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    reps = cut(fps.groupBy("fp").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n")))
    found = components(fingerprint_links(reps.filter("rep IS NOT NULL").select("fp", "rep"), radius, segments, per_tile))
    # a fingerprint of many copies is dealt over parts, and its component goes to each of them
    parts = F.least(F.ceil(F.col("n") / COPIES), F.lit(PARTS)).cast("int")
    named = reps.join(found, reps["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = fps.join(reps.filter(F.col("n") > COPIES).select("fp", parts.alias("_parts")), "fp", "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc", "text_hash"), F.coalesce("_parts", F.lit(1))).cast("int"))
    return dealt.join(named, ["fp", "part"]).select("doc", "text_hash", "fp", "component")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
