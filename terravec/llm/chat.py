"""Chat formatting: who speaks in a transcript, by a hidden Markov model, and a canonical rendering of its turns.

A text cell is cut into messages at the lines that begin with a speaker marker, where it has markers of several speakers; a cell
of one speaker is one message. The hidden states are roles. A message shows a speaker marker, its length, its line count, how it
ends and how its lines begin; the roles' shares of these are emissions, and roles follow each other by learnt odds. Viterbi
decoding is a max-plus product, so messages are range-partitioned in order and each partition gives one small matrix for each
conversation it holds a part of; a conversation over several partitions is joined by its matrices, as many as there are
partitions at most, and then traced back within each. No task needs a whole conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravec.llm.arrow import groups
from terravec.llm.common import cut, partitions, table

#: Bounds of the labelled sample: conversations by a hash of the id, and turns of one.
SAMPLE_CONVERSATIONS = 3000
SAMPLE_TURNS = 64
#: Speaker markers at the start of a message, by the role they name: they are no part of its text.
MARKERS = {
    "system": re.compile(r"\s*(?:<\|(?:im_start\|>)?\s*system\b(?:\|>)?|\[?#*\s*system\]?\s*[:>\]\n]|<<SYS>>)\s*:?\s*", re.I),
    "user": re.compile(r"\s*(?:<\|(?:im_start\|>)?\s*user\b(?:\|>)?|\[?#*\s*(?:user|human|prompter)\]?\s*[:>\]]|#+\s*(?:human|user|instruction)\s*:?|\[INST\])\s*:?\s*", re.I),
    "assistant": re.compile(r"\s*(?:<\|(?:im_start\|>)?\s*assistant\b(?:\|>)?|\[?#*\s*(?:assistant|ai|bot|gpt)\]?\s*[:>\]]|#+\s*(?:assistant|response)\s*:?|\[/INST\])\s*:?\s*", re.I),
}
#: Words that may be a marker or the text's own: the text keeps them, and what they say of the role is learnt.
_MAYBE = (re.compile(r"\s*(?:q|question|customer|me)\s*:", re.I), re.compile(r"\s*(?:a|answer|model|agent|response)\s*:", re.I))
_SPEAKER = re.compile(r"\s*[A-Z][\w .-]{0,30}:\s")
_END = re.compile(r"\s*(?:<\|im_end\|>|<\|end\|>|</s>)\s*$")
#: Log odds of a speaker marker of another role.
MARKER_DOUBT = -12.0
_FEATURES = (7, 16, 6, 5, 2)


def marker(text: str) -> tuple[int, int]:
    """(0 none, 1 system, 2 user, 3 assistant, 4 another name, 5 maybe a user's, 6 maybe an assistant's; characters of the marker)."""
    for k, (_, pattern) in enumerate(MARKERS.items()):
        if m := pattern.match(text):
            return k + 1, m.end()
    for k, pattern in enumerate(_MAYBE):
        if pattern.match(text):
            return 5 + k, 0
    return (4, 0) if _SPEAKER.match(text) else (0, 0)


def messages(text: str | None) -> list[str]:
    """A cell's messages: a line with a marker begins one, if the cell has markers of several roles. Lines before the first are one too."""
    text = text or ""
    begins, roles, at = [], set(), 0
    for line in text.split("\n"):
        kind, size = marker(line + "\n")
        if size and line.strip():
            begins.append(at)
            roles.add(kind)
        at += len(line) + 1
    if len(roles) < 2:
        return [text]
    cuts = [*([0] if text[: begins[0]].strip() else []), *begins, len(text)]
    return [text[a:b].rstrip("\n") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def features(text: str | None) -> tuple[int, ...]:
    """Marker, length (powers of two), lines, ending, and whether a code fence or list begins a line."""
    text = text or ""
    last = text.rstrip()[-1:]
    ending = 1 if last in "?¿" and last else 2 if last in ".!" and last else 3 if last == ":" else 4 if not last else 0
    return marker(text)[0], min(15, len(text).bit_length()), min(5, text.count("\n")), ending, int(bool(re.search(r"^\s*(?:```|[-*•]\s|\d+[.)]\s)", text, re.M)))


@dataclass
class Model:
    roles: list[str]
    start: np.ndarray  # log odds of the first unit's role
    move: np.ndarray  # [from, to], when a new message begins
    emit: list[np.ndarray]  # for each feature: [role, value]

    def emissions(self, shown: np.ndarray) -> np.ndarray:
        return sum(e[:, shown[:, k]].T for k, e in enumerate(self.emit))


def fit(conversations: list[list[tuple[str, tuple[int, ...]]]]) -> Model:
    """Counts of labelled (role, features) turns, each count plus one half."""
    roles = sorted({r for c in conversations for r, _ in c}) or ["assistant", "system", "user"]
    at, n = {r: k for k, r in enumerate(roles)}, len(roles)
    start, move, emit = np.full(n, 0.5), np.full((n, n), 0.5), [np.full((n, f), 0.5) for f in _FEATURES]
    for c in conversations:
        start[at[c[0][0]]] += 1
        for (a, _), (b, _) in zip(c[:-1], c[1:], strict=True):
            move[at[a], at[b]] += 1
        for r, shown in c:
            for e, v in zip(emit, shown, strict=True):
                e[at[r], v] += 1
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    logs = [log(e) for e in emit]
    for k, r in enumerate(("system", "user", "assistant")):
        if r in at:  # what a marker names holds whether or not the sample has any
            logs[0][:, k + 1] = MARKER_DOUBT
            logs[0][at[r], k + 1] = 0.0
    return Model(roles, log(start), log(move), logs)


def viterbi(m: Model, shown: np.ndarray, before: int | None, first: bool, after: int | None) -> np.ndarray:
    """The best roles of consecutive messages. before: the role of the message before these (None and first: there is none); after:
    the role the last one must have, if known. Ties go to the role that sorts first."""
    e = m.emissions(shown)
    n, k = e.shape
    score = e[0] + (m.start if before is None and first else np.zeros(k) if before is None else m.move[before])
    back = np.zeros((n, k), dtype=np.int16)
    for i in range(1, n):
        ways = score[:, None] + m.move
        back[i] = ways.argmax(axis=0)
        score = ways.max(axis=0) + e[i]
    out = np.empty(n, dtype=np.int64)
    out[-1] = score.argmax() if after is None else after
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def transfer(m: Model, shown: np.ndarray, first: bool) -> np.ndarray:
    """The max-plus matrix of a run of messages: from the role before it (all rows alike if it is the first) to its last role."""
    e = m.emissions(shown)
    total = (np.repeat(m.start[None], len(m.roles), axis=0) if first else m.move) + e[0]
    for i in range(1, len(e)):
        total = (total[:, :, None] + m.move[None]).max(axis=1) + e[i]
    return total


def through(matrices: list[np.ndarray]) -> list[int]:
    """The last role of each run of a conversation on its best path."""
    scores = [matrices[0][0]]
    for x in matrices[1:]:
        scores.append((scores[-1][:, None] + x).max(axis=0))
    out = [int(scores[-1].argmax())]
    for k in range(len(matrices) - 1, 0, -1):
        out.append(int((scores[k - 1] + matrices[k][:, out[-1]]).argmax()))
    return out[::-1]


def render(role: str, text: str | None) -> str:
    """A turn in the canonical form: its role, its text without markers and outer white space, and an end mark."""
    text = text or ""
    text = _END.sub("", text[marker(text)[1]:]).strip()
    return f"<|{role}|>\n{text}\n<|end|>\n"


def recovered(units: DataFrame, m: Model) -> DataFrame:
    """units (conv, order columns o1, o2, o3, text) with role, in conversation order within each partition."""
    shared = units.sparkSession.sparkContext.broadcast(m)
    order = ["conv", "o1", "o2", "o3"]
    ranged = cut(units.withColumn("slot", F.xxhash64("conv")).repartitionByRange(partitions(units.sparkSession), *order).sortWithinPartitions(*order))
    shown_in = lambda g: np.array([features(t.as_py()) for t in g.column("text")])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, model = TaskContext.get().partitionId(), shared.value
        ends: list[pa.RecordBatch] = []  # only the first and last conversation of a partition can go on in another
        for g in groups(batches, ["slot"]):
            ends[1 if ends else 0 :] = [g]
        for g in ends:
            shown = shown_in(g)
            both = [transfer(model, shown, first).reshape(-1).tolist() for first in (True, False)]
            yield pa.RecordBatch.from_arrays([g.column("slot").slice(0, 1), pa.array([pid], pa.int32()), pa.array([both[0]]), pa.array([both[1]])], names=["slot", "pid", "whole", "inner"])

    found = ranged.mapInArrow(matrices, "slot bigint, pid int, whole array<double>, inner array<double>")
    # at most two rows of each partition
    across = {}
    for r in sorted(cut(found).collect(), key=lambda r: r["pid"]):
        across.setdefault(r["slot"], []).append(r)
    k, known = len(m.roles), {}
    for slot, rows in across.items():
        if len(rows) > 1:
            last = through([np.array(rows[0]["whole"]).reshape(k, k), *(np.array(r["inner"]).reshape(k, k) for r in rows[1:])])
            for i, r in enumerate(rows):
                known[slot, r["pid"]] = (last[i - 1] if i else None, last[i])
    borders = units.sparkSession.sparkContext.broadcast(known)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, model = TaskContext.get().partitionId(), shared.value
        for g in groups(batches, ["slot"]):
            before, after = borders.value.get((g.column("slot")[0].as_py(), pid), (None, None))
            roles = [model.roles[x] for x in viterbi(model, shown_in(g), before, before is None, after)]
            yield g.append_column("role", pa.array(roles, pa.string()))

    return ranged.mapInArrow(decoded, T.StructType([*ranged.schema.fields, T.StructField("role", T.StringType())])).drop("slot")


def labelled_sample(turns: DataFrame, where: Column, conv: str, turn: str, role: str, text: str, conversations: int = SAMPLE_CONVERSATIONS, most: int = SAMPLE_TURNS) -> list[list[tuple[str, tuple[int, ...]]]]:
    """Roles and features of up to ``conversations`` conversations of up to ``most`` turns with roles, by a hash of the id. Features
    are of whole texts and made where the texts are."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), where.alias("fine"))
    rows = rows.filter(F.col("fine") & F.col("role").isNotNull() & F.col("conv").isNotNull())
    sized = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= most)
    ids = F.broadcast(sized.orderBy(F.xxhash64("conv", F.lit(42)), "conv").limit(conversations).select("conv"))

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [list(features(t.as_py())) for t in b.column("text")]
            yield b.select(["conv", "turn", "role"]).append_column("shown", pa.array(found, pa.list_(pa.int32())))

    met = rows.join(ids, "conv").select("conv", "turn", "role", "text")
    fields = [met.schema[c] for c in ("conv", "turn", "role")]
    out: dict = {}
    for r in sorted(met.mapInArrow(shown, T.StructType([*fields, T.StructField("shown", T.ArrayType(T.IntegerType()))])).collect(), key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[3])):
        out.setdefault(r[0], []).append((r[2], tuple(r[3])))
    return list(out.values())


def format_turns(turns: DataFrame, m: Model, conv: str = "conv_id", turn: str | None = "turn", text: str = "text") -> DataFrame:
    """(conv, turn, part, role, rendered): the messages of each row, part numbering those of one, with roles recovered from the texts
    in the order of turn, then text.

    Roles given in the input aren't looked at. Null and empty texts are empty messages; a text of any length is cut whole; a null
    turn comes first; rows with a null conversation are one conversation. Of equally likely roles the first in order is taken.
    Repeated rows stay, as messages of their own. Other columns aren't looked at. An empty table gives an empty result.
    """
    at = F.col(turn) if turn else F.lit(0)
    cells = turns.select(F.col(conv).alias("conv"), F.coalesce(at.cast("bigint"), F.lit(-(1 << 62))).alias("o1"), F.xxhash64(text).alias("o2"), at.alias("turn"), F.col(text).alias("text"))
    fields = {f.name: f for f in cells.schema.fields}
    schema = T.StructType([*(fields[c] for c in ("conv", "o1", "o2", "turn")), T.StructField("o3", T.IntegerType()), T.StructField("text", T.StringType())])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [messages(t.as_py()) for t in b.column("text")]
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            part = pa.array([k for x in found for k in range(len(x))], pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in ("conv", "o1", "o2", "turn")), part, pa.array([t for x in found for t in x], pa.string())], names=schema.fieldNames())

    done = recovered(cells.mapInArrow(cut_up, schema), m)

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("rendered", pa.array([render(r.as_py(), t.as_py()) for r, t in zip(b.column("role"), b.column("text"), strict=True)], pa.string()))

    out = done.mapInArrow(rendered, T.StructType([*done.schema.fields, T.StructField("rendered", T.StringType())]))
    return out.select("conv", "turn", F.col("o3").alias("part"), "role", "rendered")


def parse_transcripts(docs: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(conv, part, role, rendered) of raw transcripts, one in each row; edge cases as in format_turns."""
    return format_turns(docs, m, id_col, None, text_col).drop("turn")


def held_out(id_col: str = "conv_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per message: whether its conversation was held out from training, the recovered role, and the rendered turn's SHA-256 and length."""
    turns = table(spark, sf_dir, "conversations")
    m = fit(labelled_sample(turns, ~held_out(), "conv_id", "turn", "role", "text"))
    out = format_turns(turns, m)
    return out.select(F.col("conv").alias("conv_id"), "turn", "part", held_out("conv").alias("held_out"), F.col("role").alias("role_recovered"), F.char_length("rendered").cast("bigint").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))
