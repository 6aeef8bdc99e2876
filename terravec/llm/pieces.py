"""SentencePiece encoding and decoding, giant documents by a parallel max-plus scan.

The model is of the BPE kind. A row of pieces is the encoding of its text exactly if each two neighbours are: merging the two
pieces' text alone gives the two back (merges within a piece don't depend on what stands beside it, and a first merge across
a border would also happen with the two alone). So an encoding is the one path without forbidden neighbours through the lattice
of pieces: in max-plus terms, weight 0 for a pair that stays apart and minus infinity for one that doesn't, over the states
"last piece, and how far it reaches over a cut".

Where no piece can cross (before a space, around characters without a piece) there is one state, and units between such
places are cached. A document longer than a chunk is cut anywhere: each chunk gives the transfer matrix of its boundary
states, sparse since few pieces cover a cut; matrices of a document combine associatively into the states at each cut; then
each chunk is traced back by itself.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravec.llm.arrow import Known, byte_groups, groups, spans, strings, trimmed
from terravec.llm.common import cut, partitions, table

SPACE_MARK = "▁"
#: Characters of a chunk of a long document.
CHUNK = 1 << 15
#: Texts are encoded in groups of about so many bytes; a worker keeps so many bytes of words and their ids.
GROUP_BYTES, WORD_BYTES = 2 << 20, 48 << 20
#: Entries of a worker's other caches: endings and pairs, and each of two generations of units that aren't words between single spaces.
CACHE, OTHER_CACHE = 100_000, 20_000
#: Chunks of long texts that are worked together.
CHUNKS = 64
#: Text with spaces, line ends or beginnings beside one another, whose units aren't all words with one space before.
_ODD = r"  |^[ \n]| $| \n|\n "
_UNITS = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class _Cache(dict):
    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = got
        return got


class Vocabulary:
    """The pieces of a model file with byte fallback, and which of them stay apart as neighbours."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.longest = max(map(len, self.id))
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.raw = [b""] * n
        for p, i in self.id.items():
            self.raw[i] = p.replace(SPACE_MARK, " ").encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.bytes = _Cache(lambda p: np.array(self.ids(p), dtype="<i4").tobytes(), CACHE)
        self.rows: dict[str, dict[str, bool]] = {}
        self.pairs = 0

    def stays_apart(self, a: str, b: str) -> bool:
        row = self.rows.setdefault(a, {})
        known = row.get(b)
        if known is None:
            known = row[b] = self.merged_apart(a, b)
            self.pairs += 1
        return known

    def merged_apart(self, a: str, b: str) -> bool:
        """Whether merging a + b from its characters gives a and b."""
        symbols, score, border = [*a, *b], self.score, len(a)
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                s = score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return symbols == [a, b]
            start = sum(map(len, symbols[:at]))
            if start < border < start + len(symbols[at]) + len(symbols[at + 1]):
                return False
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def ids(self, piece: str) -> list[int]:
        """The id of a piece, or those of the bytes of a character without one."""
        i = self.id.get(piece)
        return [i] if i is not None else [self.byte[b] for b in piece.encode("utf-8", "replace")]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker, which outlives its tasks."""
    return Vocabulary(path)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


#: A state at a cut: the piece that covers the character before it, and how many characters it reaches beyond.
State = tuple[str, int]
FREE: State = ("", 0)


def states_at(v: Vocabulary, left: str, right: str) -> list[State]:
    """All states that text can be in at the cut between left and right (of which the nearest characters matter)."""
    out = []
    for back in range(1, min(v.longest, len(left)) + 1):
        for over in range(0, min(v.longest - back, len(right)) + 1):
            p = left[len(left) - back :] + right[:over]
            if p in v.id or len(p) == 1:
                out.append((p, over))
    return out or [FREE]


def scan(v: Vocabulary, text: str, starts: dict[State, int], beyond: str = "") -> tuple[list[dict[str, tuple[int, list[str]]]], dict[State, int]]:
    """Max-plus over a text: from start states (a bit mask each) to the states at its end, for all starts at once.

    At each place: the pieces that end there, with the starts that reach them and the pieces before them. ``beyond`` is the
    text after the end, which the last piece may reach into.
    """
    whole, n = text + beyond, len(text)
    ends: list[dict[str, list]] = [{} for _ in range(len(whole) + 1)]
    for (piece, over), mask in starts.items():
        if over <= len(whole):
            ends[over].setdefault(piece, [0, []])[0] |= mask
    finals: dict[State, int] = {}
    known, longest, apart = v.id, v.longest, v.stays_apart
    for at in range(n + 1):
        here = ends[at]
        if not here:
            continue
        if at == n:
            for piece, (mask, _) in here.items():
                finals[piece, 0] = finals.get((piece, 0), 0) | mask
            break
        for to in range(at + 1, min(at + longest, len(whole)) + 1):
            piece = whole[at:to]
            if piece not in known and to > at + 1:
                continue
            mask, before = 0, []
            for p, (m, _) in here.items():
                if not p or apart(p, piece):
                    mask |= m
                    before.append(p)
            if mask:
                if to > n:
                    finals[piece, to - n] = finals.get((piece, to - n), 0) | mask
                got = ends[to].setdefault(piece, [0, []])
                got[0] |= mask
                got[1].extend(before)
    for (piece, over), mask in starts.items():
        if n < over <= len(whole):  # it reaches beyond all of the text
            finals[piece, over - n] = finals.get((piece, over - n), 0) | mask
    return ends, finals


def trace(ends: list[dict[str, list]], at: int, piece: str, stop: int) -> list[str]:
    """The pieces that start at ``stop`` or after it, up to ``piece``, which ends at ``at``."""
    out = []
    while at - len(piece) >= stop and piece:
        out.append(piece)
        before = ends[at][piece][1]
        at -= len(piece)
        piece = before[0] if before else ""
    return out[::-1]


class Encoder:
    """Encodes texts, unit by unit. The distinct words of a group of texts are found by Arrow and kept with their ids; units that aren't
    words between single spaces have a cache of their own."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.unit = _Cache(self.encode_unit, OTHER_CACHE)
        self.last: dict[str, str] = {}
        self.words = Known(self.encode_words, WORD_BYTES)
        self.newline = self.encode_unit("\n")

    def last_piece(self, unit: str) -> str:
        """The last piece of a unit: the one piece that ends it and stays apart from the last one of what is before it.

        What is before it is itself a unit, so the answers are kept, and words of one beginning share them. The longest
        ending is tried first; only one can pass, so the first that does is it.
        """
        v, got = self.v, self.last.get(unit)
        if got is not None:
            return got
        n, known = len(unit), v.id
        for k in range(max(0, n - v.longest), n):
            piece = unit[k:]
            if (piece in known or k == n - 1) and (not k or v.stays_apart(self.last_piece(unit[:k]), piece)):
                break
        if len(self.last) >= CACHE:
            self.last.clear()
        self.last[unit] = piece
        return piece

    def encode_unit(self, unit: str) -> bytes:
        """The scan with the one start state. Long units go forward, place by place, short ones by their kept endings."""
        v, out, raw = self.v, [], self.v.bytes
        if len(unit) > 64:
            ends, _ = scan(v, unit, {FREE: 1})
            return b"".join(raw[p] for p in trace(ends, len(unit), next(iter(ends[len(unit)])), 0))
        if v.pairs > 2 * CACHE:
            v.rows, v.pairs = {}, 0
        while unit:
            piece = self.last_piece(unit)
            out.append(raw[piece])
            unit = unit[: -len(piece)]
        out.reverse()
        return b"".join(out)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, many) of words: of one after a line end that end goes before, before others a space does."""
        of, end, mark = self.encode_unit, self.newline, SPACE_MARK
        ids = [of(mark + w) if w and w[0] != "\n" else end + of(w[1:]) if w else b"" for w in strings(words)]
        many = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        return np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(many, dtype=np.int32) - many, many

    def texts(self, texts: pa.Array) -> list[bytes]:
        """Ids (little-endian 32 bits) of each whole text, with the space that goes before it. The texts make one group."""
        texts = pc.replace_substring(texts, SPACE_MARK, " ")
        odd = pc.match_substring_regex(texts, _ODD)
        words = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), " ")
        chunks = words.values.dictionary_encode()
        ids, first, many = self.words.of(chunks.dictionary)
        index = chunks.indices.to_numpy()
        raw = ids[spans(first[index], many[index])].tobytes()
        ends = (np.insert(np.cumsum(many[index], dtype=np.int64), 0, 0)[words.offsets.to_numpy()] * 4).tolist()
        out = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.text_marked(SPACE_MARK + texts[i].as_py().replace(" ", SPACE_MARK))
        return out

    def texts_marked(self, marked: list[str]) -> list[bytes]:
        """The same of texts as ``text_marked`` takes them."""
        spaced = [len(m) > 1 and m[0] == SPACE_MARK for m in marked]
        found = self.texts(pa.array([m[1:] if x else "" for m, x in zip(marked, spaced, strict=True)], pa.string()))
        return [ids if x else self.text_marked(m) for ids, x, m in zip(found, spaced, marked, strict=True)]

    def text_marked(self, marked: str) -> bytes:
        """Ids of text whose spaces are marked, and that begins and ends where no piece can cross."""
        out: list[bytes] = []
        for k, line in enumerate(marked.split("\n")):
            if k:
                out.append(self.newline)
            out.extend(map(self.unit.__getitem__, _UNITS.findall(line)))
        return b"".join(out)


def first_free(marked: str) -> int:
    """The first place where no piece can cross: before a space that follows something else, or around a line end. -1: none."""
    m = re.search(f"(?<=[^{SPACE_MARK}])(?={SPACE_MARK})|\n", marked)
    return m.start() if m else -1


def last_free(marked: str) -> int:
    k = max((i for i in (marked.rfind("\n") + 1 or -1, _last_gap(marked)) if i >= 0), default=-1)
    return k


def _last_gap(marked: str) -> int:
    at = len(marked)
    while (at := marked.rfind(SPACE_MARK, 0, at)) > 0:
        if marked[at - 1] != SPACE_MARK:
            return at
    return -1


def matrix(v: Vocabulary, core: str, left: str, right: str) -> dict[State, list[State]]:
    """Of a chunk between two cuts, with the text around it: the end states that each start state can lead to."""
    starts = states_at(v, left, core + right) if left else [FREE]
    a, b = first_free(core), last_free(core)
    if a < 0:
        _, finals = scan(v, core, {s: 1 << k for k, s in enumerate(starts)}, right)
        return {s: [e for e, mask in finals.items() if mask >> k & 1] for k, s in enumerate(starts)}
    _, heads = scan(v, core[:a], {s: 1 << k for k, s in enumerate(starts)})
    reach = 0
    for (_, over), mask in heads.items():
        reach |= mask if over == 0 else 0
    _, finals = scan(v, core[b:], {FREE: 1}, right) if b < len(core) else (None, {(core[-1], 0): 1})
    return {s: list(finals) for k, s in enumerate(starts) if reach >> k & 1}


def combine(m: dict[State, list[State]], n: dict[State, list[State]]) -> dict[State, list[State]]:
    """The max-plus product: the matrix of two chunks in a row. It is associative."""
    return {s: got for s, ends in m.items() if (got := list(dict.fromkeys(x for e in ends for x in n.get(e, ()))))}


def resolve(matrices: list[dict[State, list[State]]]) -> list[State]:
    """The state before each chunk of a document and after the last, from products of all chunks up to each cut."""
    products = [matrices[0]]
    for m in matrices[1:]:
        products.append(combine(products[-1], m))
    state = next(s for s in products[-1][FREE] if s[1] == 0)
    states = [state]
    for k in range(len(matrices) - 1, 0, -1):
        state = next(s for s in products[k - 1][FREE] if state in matrices[k].get(s, ()))
        states.append(state)
    return [FREE, *states[::-1]]


def trace_chunk(enc: Encoder, core: str, right: str, start: State, end: State | None) -> tuple[bytes, str, bytes]:
    """Of the pieces that start within a chunk, between two known states (end None: the end of the text): ids, the marked text whose
    ids follow, ids."""
    v = enc.v
    a, b = first_free(core), last_free(core)
    if a < 0:
        ends, finals = scan(v, core, {start: 1}, right if end else "")
        return _ids(v, _way(ends, finals, len(core), end, start)), "", b""
    ends, finals = scan(v, core[:a], {start: 1})
    head = _ids(v, _way(ends, finals, a, None, start))
    if b >= len(core):
        return head, core[a:], b""
    ends, finals = scan(v, core[b:], {FREE: 1}, right if end else "")
    return head, core[a:b], _ids(v, _way(ends, finals, len(core) - b, end, FREE))


def _way(ends, finals, n: int, end: State | None, start: State) -> list[str]:
    goal = end if end is not None else next((s for s in finals if s[1] == 0), None)
    if goal is None or n + goal[1] - len(goal[0]) < start[1]:
        return []
    return trace(ends, n + goal[1], goal[0], start[1])


def _ids(v: Vocabulary, pieces: list[str]) -> bytes:
    return np.array([i for p in pieces for i in v.ids(p)], dtype="<i4").tobytes()


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """Pieces' texts in a row, without the space that goes before a whole text. Broken bytes become replacement characters."""
    raw = v.raw
    text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def _chunks(text: str, size: int, margin: int) -> list[tuple[str, str, str]]:
    marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
    return [(marked[c : c + size], marked[max(0, c - margin) : c], marked[c + size : c + size + margin]) for c in range(0, len(marked), size)]


def _pack(states: list) -> str:
    import json

    return json.dumps(states)


def _state(x: list) -> State:
    return (x[0], x[1])


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in parts, so that what is made of them is small."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def _with_text(v: Vocabulary, b: pa.RecordBatch, ids: list[np.ndarray]) -> pa.RecordBatch:
    """b with the decoded text and the CRC-32 of the ids of its rows."""
    return b.append_column("text", pa.array([decode_ids(v, x) for x in ids], pa.string())).append_column("ids_crc32", pa.array([zlib.crc32(x) for x in ids], pa.int64()))


def _lists(ids: list[bytes]) -> pa.Array:
    """Little-endian 32-bit ids of each row as a list array."""
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, decoded: bool = False) -> DataFrame:
    """(doc, ids array<int>) of each row; decoded: with the columns that ``decode`` adds, for most texts in the task that encodes. A null or empty text has no ids. Repeated rows stay, null ids are ids, and other columns
    aren't looked at; an empty table gives an empty result.

    Texts of up to ``chunk`` characters are encoded where they are read. Longer ones become chunk rows, dealt over all tasks:
    transfer matrices, their products by document, then ids by chunk.
    """
    import json

    path = path or model_path()
    n = partitions(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(text_col, F.lit("")).alias("_t"))
    long_text = F.char_length("_t") > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for at, to in byte_groups(b.column("_t"), GROUP_BYTES):
                found = enc.texts(b.column("_t").slice(at, to - at))
                out = pa.RecordBatch.from_arrays([b.column("doc").slice(at, to - at), _lists(found)], names=["doc", "ids"])
                yield _with_text(enc.v, out, [np.frombuffer(x, "<u4") for x in found]) if decoded else out

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = vocabulary(path).longest
        for b in batches:
            for i in range(b.num_rows):
                parts = _chunks(b.column("_t")[i].as_py(), chunk, margin)
                owner = b.slice(i, 1).select(["uid", "doc"])
                for k in range(0, len(parts), 64):
                    some = parts[k : k + 64]
                    at = pa.array([0] * len(some))
                    yield pa.RecordBatch.from_arrays([owner.column(0).take(at), owner.column(1).take(at), pa.array(range(k, k + len(some)), pa.int32()), *(pa.array(c, pa.string()) for c in zip(*some, strict=True))], names=["uid", "doc", "k", "core", "left", "right"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in _small(batches, CHUNKS):
            out = [_pack(list(matrix(v, *x).items())) for x in zip(*(b.column(c).to_pylist() for c in ("core", "left", "right")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("k"), pa.array(out)], names=["uid", "k", "m"])

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["uid"]):
            ms = [{_state(s): [_state(e) for e in ends] for s, ends in json.loads(m.as_py())} for m in g.column("m")]
            states = resolve(ms)
            yield pa.RecordBatch.from_arrays([g.column("uid"), g.column("k"), pa.array([_pack([states[i], states[i + 1] if i + 1 < len(ms) else None]) for i in range(len(ms))])], names=["uid", "k", "states"])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in _small(batches, CHUNKS):
            found = []
            for core, right, states in zip(*(b.column(c).to_pylist() for c in ("core", "right", "states")), strict=True):
                start, end = json.loads(states)
                found.append(trace_chunk(enc, core, right, _state(start), end and _state(end)))
            heads, middles, tails = zip(*found, strict=True)
            ids = [b"".join(x) for x in zip(heads, enc.texts_marked(list(middles)), tails, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc"), b.column("k"), _lists(ids)], names=["uid", "doc", "k", "ids"])

    schema = lambda *fields: T.StructType([T.StructField(x, t) for x, t in fields])
    text = (("text", T.StringType()), ("ids_crc32", T.LongType())) if decoded else ()
    ids, uid, k = ("ids", T.ArrayType(T.IntegerType())), ("uid", T.LongType()), ("k", T.IntegerType())
    short = rows.filter(~long_text).mapInArrow(trimmed(whole), schema(("doc", kind), ids, *text))
    parts = rows.filter(long_text).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(trimmed(split), schema(uid, ("doc", kind), k, ("core", T.StringType()), ("left", T.StringType()), ("right", T.StringType())))
    parts = cut(parts.repartition(n, "uid", "k"))
    found = parts.select("uid", "k", "core", "left", "right").mapInArrow(trimmed(matrices), schema(uid, k, ("m", T.StringType())))
    states = found.repartition(n, "uid").sortWithinPartitions("uid", "k").mapInArrow(trimmed(cuts), schema(uid, k, ("states", T.StringType())))
    done = parts.join(states, ["uid", "k"]).mapInArrow(trimmed(traced), schema(uid, ("doc", kind), k, ids))
    joined = done.groupBy("uid").agg(F.first("doc").alias("doc"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    joined = joined.select("doc", "ids")
    return short.unionByName(decode(joined, path) if decoded else joined)


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """Adds text, and ids_crc32 (of the ids as little-endian unsigned 32 bits), to rows with ids; no ids or null: the empty text.
    Columns of these names are replaced, others pass through."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        none = np.zeros(0, dtype="<u4")
        for b in _small(batches):
            yield _with_text(v, b, [x.values.to_numpy().astype("<u4") if x.is_valid else none for x in b.column(ids_col)])

    own = encoded.drop("text", "ids_crc32")
    return own.mapInArrow(trimmed(run), T.StructType([*own.schema.fields, T.StructField("text", T.StringType()), T.StructField("ids_crc32", T.LongType())]))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_ids, the CRC-32 of its ids, and the SHA-256 of the text decoded from them."""
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return coded.select(F.col("doc").alias("doc_id"), F.size("ids").cast("bigint").alias("n_ids"), "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))
