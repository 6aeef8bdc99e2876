"""Best-fit packing: documents cut to pieces of at most one sequence, and few sequences that hold all pieces.

Only the histogram of piece lengths decides which lengths share a sequence, and it has as many entries as a sequence has
tokens, however large the corpus is. The dual of the configuration linear program over it is solved by multiplicative weights:
each length has a price, a knapsack dynamic program finds the fills of greatest price, and the prices of the lengths that these
cover too often fall. The program is rounded by handing out whole sequences at these prices, by knapsacks over the pieces that are
left; only the last few and the emptiest sequences are packed best-fit decreasing. The prices also prove a lower bound. Each piece
then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravec.llm.arrow import Known, byte_groups, spans, strings, trimmed
from terravec.llm.common import cut, table

CAPACITY = 2048
SEPARATOR = 0
#: Parts in which the sequences are handed out (more where lengths are few, as fine steps cost little there), and in which those
#: without a long piece are. Rounds of multiplicative weights, and after how many they end if none bettered the plain bound of all
#: lengths over the capacity.
ROUNDS, STEPS = 16, 128
WEIGHINGS, PLAIN = 100, 12
#: Learning rates, in the order they are tried. The first little more than breaks ties between equally full sequences.
RATES = (0.02, 0.5, 2.0, 8.0)
LEAD = 0.5
#: The knapsack first looks for a full sequence among so many lengths of each band; if there is none it takes all lengths.
BANDS, PER_BAND = 16, 12
#: So many sequences at the end are packed best-fit; and these shares of the emptiest ones are, one after another, where it helps.
LAST = 4
REOPENED = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9)
#: Pieces of one length are ranked in buckets, by a hash of document and piece: so many, or more with more than so many pieces each.
BUCKETS, BUCKET_ROWS = 256, 1_000_000
#: Texts are encoded in groups of about so many bytes, and so many distinct words of a group in one call; a worker keeps so many bytes
#: of words and their ids.
GROUP_BYTES, TOGETHER, WORD_BYTES = 2 << 20, 4_000, 32 << 20
#: Text that isn't Latin-1 or may hold a special token, and words that the tokenizer's normalizing and splitting leave as they are.
SPECIAL_TEXT, PLAIN_WORD = r"[^\x00-\x{ff}]|<\|", r"^[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+$"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> dict[int, str]:
    """For str.translate: the Latin-1 characters as the tokenizer spells their UTF-8 bytes, one letter a byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class WordIds:
    """The ids of texts, by their distinct white-space-free chunks. White space only separates in this tokenizer, so a text's ids are
    those of its chunks in a row.

    Texts are worked in groups, whose distinct chunks Arrow finds. Chunks of Latin-1 characters are lower-cased, split and spelled
    as letters of bytes like the tokenizer does, and their distinct parts that aren't kept from earlier groups go to its BPE model in a
    few calls. Others, and those that may hold special tokens, are encoded one by one.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread
        self.tokenizer = Tokenizer.from_file(path)
        self.joint = Tokenizer(self.tokenizer.model)
        self.joint.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.words = Known(self._of_parts, WORD_BYTES)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.letters = byte_letters() | {ord(" "): " "}
        # the tokenizer's parts, and line feeds; its white space in Latin-1 is written out
        self.parts = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0\p{L}\p{N}]+").findall

    def _of_parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, many) of distinct parts."""
        parts, ids = strings(words), [np.zeros(0, dtype="<u4")]
        for a in range(0, len(parts), TOGETHER):
            text = " ".join(parts[a : a + TOGETHER]).translate(self.letters)
            ids.append(np.array(self.joint.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4"))
        ids = np.concatenate(ids)
        to = np.flatnonzero(self.ends[ids]).astype(np.int32) + np.int32(1)
        many = np.diff(to, prepend=np.int32(0))
        return ids, to - many, many

    def _of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, many): the ids of all chunks, where those of each begin and how many it has."""
        special, plain = (pc.match_substring_regex(chunks, p).to_numpy(zero_copy_only=False) for p in (SPECIAL_TEXT, PLAIN_WORD))
        kind = np.where(special, 2, np.where(plain, 0, 1))
        order, (a, n, _) = np.argsort(kind, kind="stable"), np.bincount(kind, minlength=3).tolist()
        of_kind = lambda k: chunks.filter(pa.array(kind == k))
        mixed = self.parts("\n".join(strings(of_kind(1))).lower())
        line = np.cumsum(np.fromiter((p == "\n" for p in mixed), bool, len(mixed)))
        coded = pa.concat_arrays([of_kind(0), pa.array(mixed, pa.string())]).dictionary_encode()
        parts, index = coded.dictionary, coded.indices.to_numpy()
        feed = pc.index(parts, "\n").as_py()
        of_part, first, many = self.words.of(parts.filter(pc.not_equal(parts, "\n")))
        if feed >= 0:
            first, many = np.insert(first, feed, 0), np.insert(many, feed, 0)
        one_by_one = [np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, dtype="<u4") for c in of_kind(2).to_pylist()]
        ids = np.concatenate([of_part[spans(first[index], many[index])], *one_by_one])
        of_mixed = np.bincount(line, weights=many[index[a:]], minlength=n)
        lengths = np.concatenate([many[index[:a]], of_mixed, np.fromiter(map(len, one_by_one), np.int32, len(one_by_one))]).astype(np.int32)
        first, many = np.empty((2, len(order)), dtype=np.int32)
        first[order], many[order] = np.cumsum(lengths) - lengths, lengths
        return ids, first, many

    def of_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each whole text as little-endian unsigned 32-bit bytes, in order; a null text has none."""
        texts = pc.fill_null(texts, "")
        for a, b in byte_groups(texts, GROUP_BYTES):
            some = texts.slice(a, b - a)
            # where the tokenizer would do the same, lower-casing makes for fewer chunks; it looks for special tokens before it does
            some = pc.if_else(pc.match_substring_regex(some, SPECIAL_TEXT), some, pc.ascii_lower(some))
            words = pc.ascii_split_whitespace(some)
            chunks = words.values.dictionary_encode()
            ids, first, many = self._of_chunks(chunks.dictionary)
            index = chunks.indices.to_numpy()
            raw = ids[spans(first[index], many[index])].tobytes()
            ends = np.insert(np.cumsum(many[index], dtype=np.int64), 0, 0)[words.offsets.to_numpy()] * 4
            for at, to in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                yield raw[at:to]

    def of(self, text: str) -> bytes:
        """The ids of a whole text."""
        return next(self.of_all(pa.array([text], pa.string())))


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for each Python worker, which outlives its tasks."""
    return WordIds(path)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc, piece, start, length, ids_crc32 [, ids]) of each row; a null text is empty and gives the separator alone."""
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    end = np.array([SEPARATOR], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, raw in enumerate(ids_of.of_all(batch.column("_text"))):
                raw += end
                for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[a : a + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            columns = [batch.column("doc").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=schema.fieldNames())

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text")).mapInArrow(trimmed(run), schema)


def candidates(ahead: np.ndarray, left: np.ndarray, capacity: int, bands: int = BANDS, per_band: int = PER_BAND) -> np.ndarray:
    """The lengths that the knapsack chooses from: of each band of lengths, those least ahead (so highest in price for their size)."""
    have = np.flatnonzero(left)
    band = have * bands // (capacity + 1)
    order = np.lexsort((-have, ahead[have], band))
    rank = np.arange(len(have)) - np.searchsorted(band[order], band[order])
    return np.sort(have[order[rank < per_band]])


def knapsack(price: np.ndarray, left: np.ndarray, capacity: int, lengths: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], list[np.ndarray]]:
    """Bounded knapsack by dynamic programming: the greatest total price in each room up to the capacity, of these lengths, each as
    often as pieces are left (in powers of two); and what ``traced`` needs to say which they are."""
    value, spare = np.zeros(capacity + 1), np.empty(capacity + 1)
    items, taken = [], []
    for length in lengths.tolist():
        many, size = min(int(left[length]), capacity // length), 1
        while many > 0:
            n = min(size, many)
            many, size = many - n, size * 2
            room = value[length * n :]
            with_it = spare[: len(room)]
            np.add(value[: len(room)], price[length] * n, out=with_it)
            items.append((length, n))
            taken.append(with_it > room)
            np.maximum(room, with_it, out=room)
    return value, items, taken


def traced(rooms: np.ndarray, items: list[tuple[int, int]], taken: list[np.ndarray], width: int) -> np.ndarray:
    """(rooms, lengths): how often each length is in the best fill of each room."""
    rooms, out = rooms.copy(), np.zeros((len(rooms), width), dtype=np.int64)
    for (length, n), better in zip(reversed(items), reversed(taken), strict=True):
        rows = np.flatnonzero(rooms >= length * n)
        rows = rows[better[rooms[rows] - length * n]]
        out[rows, length] += n
        rooms[rows] -= length * n
    return out


def fill(price: np.ndarray, left: np.ndarray, capacity: int, lengths: np.ndarray) -> tuple[int, ...]:
    """Of these lengths those of greatest total price that fit together, longest first: the same as ``traced`` of the one room."""
    _, items, taken = knapsack(price, left, capacity, lengths)
    room, many = capacity, Counter()
    for (length, n), better in zip(reversed(items), reversed(taken), strict=True):
        if room >= length * n and better[room - length * n]:
            many[length] += n
            room -= length * n
    return tuple(length for length in sorted(many, reverse=True) for _ in range(many[length]))


def relaxation(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = WEIGHINGS) -> tuple[np.ndarray, float]:
    """(prices, bound): dual prices of the configuration linear program, by multiplicative weights, and the best lower bound on the
    number of sequences that any of them proved.

    A piece of over half a sequence needs one of its own, so its price is what the best fill of the room beside it leaves of 1.
    In a round one knapsack table gives the best fill beside each such length, and of a sequence without one. The prices of the
    other lengths, scaled so that no sequence is worth more than 1, prove a bound; then they fall or rise by how far these fills
    would cover each length more or less than its pieces.
    """
    half, size = capacity // 2, np.arange(len(counts))
    big, small = half + 1 + np.flatnonzero(counts[half + 1 :]), np.flatnonzero(counts[: half + 1])
    price, bound = size / capacity, float((counts * size).sum()) / capacity
    if not len(small):
        return price, max(bound, float(counts[big].sum()))
    n, logs, top = counts[small].astype(float), np.log(small / capacity), -1.0
    for t in range(rounds):
        p = np.zeros(len(counts))
        p[small] = np.exp(logs)
        value, items, taken = knapsack(p, counts, capacity, small)
        beside = np.maximum(0, 1 - value[capacity - big] / value[capacity])
        proved = float((p[small] * n).sum() / value[capacity] + (counts[big] * beside).sum())
        if proved > top:
            top, price = proved, p / value[capacity]
            price[big] = beside
        if t >= PLAIN and top <= bound * (1 + 1e-6):
            break
        fills = traced(np.append(capacity - big, capacity), items, taken, half + 1)[:, small]
        alone = max(0.0, max(top, bound) - float(counts[big].sum()))
        covered = counts[big] @ fills[:-1] + alone * fills[-1]
        logs -= 0.5 / np.sqrt(t + 1) * np.clip(covered / n - 1, -1, 2)
        logs -= np.log((np.exp(logs) * n).sum() / (n * small).sum() * capacity)
    return price, max(bound, top)


def configurations(counts: np.ndarray, price: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, rate: float = RATES[0]) -> tuple[dict[tuple[int, ...], int], np.ndarray]:
    """The program rounded: configurations in whole numbers, and the pieces that are left for the last sequences.

    A round fills the room beside a ``rounds``-th of each length over half a sequence, at the dual prices times
    exp(-rate * ahead), ahead being by how much the covered share of a length is before that of the long pieces. What is left is
    handed out in the same way, at prices in proportion to length. No configuration is taken more often than pieces are left, so
    rounding leaves no surplus, and each next knapsack is over what is there.
    """
    half, size, left, numbers = capacity // 2, np.arange(len(counts)), counts.copy(), Counter()
    rounds *= min(32, max(1, 4000 // max(1, np.count_nonzero(counts))))
    big = half + 1 + np.flatnonzero(counts[half + 1 :])
    tie = 1e-9 * size

    def take(config: np.ndarray, most: int, first: int = 0) -> None:
        need = np.flatnonzero(config)
        times = min(most, int((left[need] // config[need]).min())) if len(need) else most
        if times > 0:
            numbers[(first,) * (first > 0) + tuple(np.repeat(need, config[need])[::-1].tolist())] += times
            left[need] -= times * config[need]
            left[first] -= times * (first > 0)

    for r in range(rounds):
        here = big[left[big] > 0][::-1]
        if not len(here):
            break
        ahead = (counts - left) / np.maximum(counts, 1) - (1 - left[big].sum() / counts[big].sum())
        _, items, taken = knapsack(price * np.exp(-rate * np.clip(ahead, -1, 1)) + tie, left, capacity, np.flatnonzero(left[: half + 1]))
        for length, config in zip(here.tolist(), traced(capacity - here, items, taken, half + 1), strict=True):
            take(config, -(-int(left[length]) // (rounds - r)), length)
    for length in big[::-1].tolist():  # whose fills others have taken
        while left[length]:
            beside = fill(price + tie, left, capacity - length, np.flatnonzero(left[: capacity - length + 1]))
            take(np.bincount(beside, minlength=half + 1) if beside else np.zeros(half + 1, dtype=np.int64), int(left[length]), length)
    start, total = left.copy(), int((left * size).sum())
    step = max(1, -(-total // (capacity * STEPS)))
    while (rest := int((left * size).sum())) > LAST * capacity:
        ahead = (start - left) / np.maximum(start, 1) - (1 - rest / total) - LEAD * size / capacity
        p = size * np.exp(-rate * np.clip(ahead, -1, 1))
        config = fill(p, left, capacity, candidates(ahead, left, capacity))
        if sum(config) < capacity:  # a full sequence can't be bettered; else all lengths are priced
            config = fill(p, left, capacity, np.flatnonzero(left))
        take(np.bincount(config, minlength=len(counts)), step)
    return dict(numbers), left


def best_fit_decreasing(counts: np.ndarray, capacity: int = CAPACITY) -> dict[tuple[int, ...], int]:
    """Longest first, each into the fullest sequence that still has room, all pieces of a length at once."""
    by_room: dict[int, list[list]] = {}
    rooms = 0  # a bit for each room that sequences have left

    def put(room: int, group: list) -> None:
        nonlocal rooms
        by_room.setdefault(room, []).append(group)
        rooms |= 1 << room

    for length in range(len(counts) - 1, 0, -1):
        n = int(counts[length])
        while n > 0:
            fitting = rooms >> length
            if not fitting:
                fit = min(capacity // length, n)
                put(capacity - fit * length, [(length,) * fit, n // fit])
                n -= (n // fit) * fit
                continue
            room = length + (fitting & -fitting).bit_length() - 1
            group = by_room[room][-1]
            fit = min(room // length, n)
            take = min(group[1], n // fit)
            put(room - fit * length, [group[0] + (length,) * fit, take])
            group[1] -= take
            n -= take * fit
            if not group[1]:
                by_room[room].remove(group)
                if not by_room[room]:
                    rooms ^= 1 << room
    out: Counter = Counter()
    for groups in by_room.values():
        for config, n in groups:
            out[config] += n
    return dict(out)


def repaired(found: Counter, counts: np.ndarray, capacity: int = CAPACITY) -> Counter:
    """The same pieces in fewer sequences, where opening the emptiest ones and packing them again does that."""
    for share in REOPENED:
        kept, left, open_ = Counter(found), np.zeros(len(counts), dtype=np.int64), int(share * found.total())
        for config, n in sorted(found.items(), key=lambda c: (sum(c[0]), c[0])):
            times = min(n, open_)
            if times <= 0:
                break
            open_ -= times
            kept[config] -= times
            left += times * np.bincount(config, minlength=len(counts))
        again = +kept
        again.update(best_fit_decreasing(left, capacity))
        if again.total() < found.total():
            found = again
    return found


def plan(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> dict[tuple[int, ...], int]:
    """Configurations for exactly these pieces: the program rounded, the last LAST sequences best-fit, and the emptiest repaired.

    A low rate does where full sequences abound, a high one where lengths go badly together. Rates are tried from the lowest on,
    as long as each takes fewer sequences than the one before and none has reached the bound that the dual prices prove.
    """
    price, bound = relaxation(counts, capacity)
    best: Counter = Counter()
    for rate in RATES:
        numbers, left = configurations(counts, price, capacity, rounds, rate)
        found = Counter(numbers)
        found.update(best_fit_decreasing(left, capacity))
        found = repaired(found, counts, capacity)
        if best and found.total() >= best.total():
            break
        best = found
        if best.total() <= np.ceil(bound - 1e-6):
            break
    return dict(best)


def places(configs: dict[tuple[int, ...], int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank of each run of places, its first sequence, its offset)."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for config, n in sorted(configs.items(), reverse=True):
        offset = 0
        for length in config:
            runs.setdefault(length, []).append((n, base, offset))
            offset += length
        base += n
    out = {}
    for length, found in runs.items():
        n, first, offset = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
        out[length] = (np.cumsum(n) - n, first, offset)
    return out


def packed(parts: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to rows with doc, piece and length (1 to capacity); parts is read several times.

    The driver gets the histogram, at most ``capacity`` rows. Ranks within a length are made by bucket, with the buckets'
    counts added up before them, so that a length with a third of all pieces isn't one task.
    """
    keyed = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc", "piece"), F.lit(max(BUCKETS, -(-parts.count() // BUCKET_ROWS)))))
    sizes = cut(keyed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum("_n")).collect():
        counts[length] = n
    shared = parts.sparkSession.sparkContext.broadcast(places(plan(counts, capacity, rounds)))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    tie = [c for c in ("ids_crc32",) if c in parts.columns]
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc", "piece", *tie)) - 1)
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before")).select(*parts.columns, "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                rows = np.flatnonzero(length == k)
                starts, first, at = shared.value[int(k)]
                run = np.searchsorted(starts, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = first[run] + rank[rows] - starts[run], at[run]
            yield batch.drop_columns(["_rank"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    fields = [*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return ranked.mapInArrow(place, T.StructType(fields))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc, piece, start, length, ids_crc32 [, ids], sequence_id, offset) of all pieces.

    Null and empty texts are one piece of one id; a text of any length is cut into as many pieces as it takes, all but the last
    full. Rows that share an id, repeated ones too, are packed each by itself; which of equal rows gets which place is of no
    account. Null ids are ids. Other columns of docs aren't looked at. An empty table gives an empty result.
    """
    return packed(cut(pieces(docs, path or tokenizer_path(), id_col, text_col, capacity, with_ids)), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("doc", "doc_id")
