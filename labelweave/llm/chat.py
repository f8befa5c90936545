"""Roles of transcript lines by a hidden Markov model, and canonical rendering of the turns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import materialise
#: Lines that one task decodes together.
BLOCK_LINES = 50_000
#: Probabilities are fitted on at most this many labelled lines, those of the conversations with the least hash, and as
#: many again of each role that has none among them. The roles are those of all labelled lines.
FIT_LINES = 20_000
# Speaker words of common transcript styles.
SPEAKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "answer", "a"),
}
_MARKER = re.compile(r"\s*(?:#{1,6}\s*|\*\*|<\|?|\[)?([A-Za-z]{1,20})(?:\*\*|\|?>|\])?\s*:(?:\*\*)?\s*")
_ROLE_OF = {word: role for role, words in SPEAKERS.items() for word in words}
_KINDS = ("none", "other", *SPEAKERS)
_SIZES = (0, 40, 200)
SYMBOLS = len(_KINDS) * 2 * (len(_SIZES) + 1)


def symbol(line: str) -> int:
    """What the model sees of a line: speaker marker, question mark at the end, and length class."""
    found = _MARKER.match(line)
    kind = _KINDS.index(_ROLE_OF.get(found[1].lower(), "other")) if found else 0
    body = line.strip()
    size = sum(len(body) > n for n in _SIZES)
    return (kind * 2 + body.endswith("?")) * (len(_SIZES) + 1) + size


def unmarked(line: str) -> str:
    """The line without its marker, if that names a known speaker."""
    found = _MARKER.match(line)
    return line[found.end() :] if found and found[1].lower() in _ROLE_OF else line


@dataclass(frozen=True)
class ChatModel:
    """Log probabilities. State 2r opens a turn of role r, state 2r + 1 goes on with it."""

    roles: tuple[str, ...]
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def fit(lines: pd.DataFrame, smooth: float = 0.5, apart: pd.DataFrame | None = None) -> ChatModel:
    """Smoothed counts over labelled lines (conv, role, opens, symbol) in their order.

    ``apart`` are lines of other roles, without their neighbours: they count for what their role looks like, not for
    which role follows which. The known speakers are roles too. Without labelled lines: these alone, all states and
    symbols alike but for each speaker's own marker.
    """
    more = [] if apart is None else apart["role"]
    seen_roles = {*lines["role"].dropna(), *more}
    roles = tuple(sorted({*seen_roles, *SPEAKERS})) if seen_roles else tuple(SPEAKERS)
    n = 2 * len(roles)
    start, step, emit = np.full(n, 1e-9), np.full((n, n), 1e-9), np.full((n, SYMBOLS), smooth)
    start[::2] += smooth
    for a in range(n):
        step[a, ::2] += smooth
        step[a, a | 1] += smooth
    per_kind = SYMBOLS // len(_KINDS)
    for r, role in enumerate(roles):
        if role in _KINDS:
            at = _KINDS.index(role) * per_kind
            emit[2 * r, at : at + per_kind] += 1
    last = None
    for conv, role, opens, seen in lines.dropna(subset=["role"])[["conv", "role", "opens", "symbol"]].itertuples(index=False):
        state = 2 * roles.index(role) + (not opens)
        if last is not None and last[0] == conv:
            step[last[1], state] += 1
        else:
            start[state] += 1
        emit[state, seen] += 1
        last = conv, state
    if apart is not None:
        for role, opens, seen in apart[["role", "opens", "symbol"]].itertuples(index=False):
            emit[2 * roles.index(role) + (not opens), seen] += 1
    return ChatModel(roles, np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), np.log(emit / emit.sum(1, keepdims=True)))


def _best(model: ChatModel, symbols: np.ndarray, enter: int | None, leave: int | None) -> np.ndarray:
    """The most likely states of a segment, after state ``enter`` (None: from the start) and ending in ``leave`` (None: any)."""
    score = (model.start if enter is None else model.step[enter]) + model.emit[:, symbols[0]]
    back = np.empty((len(symbols), len(score)), np.int16)
    for i in range(1, len(symbols)):
        ways = score[:, None] + model.step
        back[i] = ways.argmax(0)
        score = ways.max(0) + model.emit[:, symbols[i]]
    states = np.empty(len(symbols), np.int64)
    states[-1] = score.argmax() if leave is None else leave
    for i in range(len(symbols) - 1, 0, -1):
        states[i - 1] = back[i, states[i]]
    return states


def _summary(model: ChatModel, symbols: np.ndarray) -> np.ndarray:
    """Best scores from each state before a segment (last row: from the start) to each state at its end."""
    score = np.vstack([model.step, model.start]) + model.emit[:, symbols[0]]
    for seen in symbols[1:]:
        score = (score[:, :, None] + model.step).max(1) + model.emit[:, seen]
    return score


def _edges(model: ChatModel, rows: pd.DataFrame) -> pd.DataFrame:
    """For the blocks a conversation spans, in order: the state before each and the state at its end, on the best path."""
    rows = rows.sort_values("part")
    n = len(model.roles) * 2
    tables = [np.array(s).reshape(n + 1, n) for s in rows["scores"]]
    score, back = tables[0][n], []
    for table in tables[1:]:
        ways = score[:, None] + table[:n]
        back.append(ways.argmax(0))
        score = ways.max(0)
    leave = [int(score.argmax())]
    for b in reversed(back):
        leave.append(int(b[leave[-1]]))
    leave = leave[::-1]
    return pd.DataFrame({
        "part": rows["part"].to_numpy(), "conv": rows["conv"].to_numpy(),
        "enter": np.array([-1, *leave[:-1]], np.int32), "leave": np.array(leave, np.int32),
        "final": [False] * (len(rows) - 1) + [True],
    })


def _segments(block: pd.DataFrame) -> Iterator[tuple[str, int, int]]:
    conv = block["conv"].to_numpy()
    cuts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
    for a, b in zip(cuts, np.append(cuts[1:], len(conv)), strict=True):
        yield conv[a], int(a), int(b)


_ORDER = ["conv", "turn", "line", "tie"]


def parse_lines(lines: DataFrame, model: ChatModel) -> DataFrame:
    """(conv_id, turn, line, role, opens, rendered) for each line (conv_id, turn, line, text).

    Lines of a conversation are ordered by turn, then line. Viterbi finds the likeliest roles of the whole
    conversation; a line that opens a turn is rendered after the close of the turn before it and the tag
    of its role, without its marker; the last line closes its turn. The rendered lines put together, each
    ending in a line feed, are the canonical transcript.

    Lines are cut into blocks by their order, so a conversation of any length is spread over tasks. Each block gives the
    best scores from any state before it to any state at its end; these tables, chained, settle the states at block
    bounds, and each block then decodes on its own: the result is that of one pass over the whole.

    - Missing text counts as empty. Lines without conv_id are one conversation. Missing turn or line numbers come
      first; ties are ordered by text, and repeated rows all stay.
    - An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark = lines.sparkSession

    def see(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = pa.array([symbol(v.as_py()) for v in batch.column(batch.num_columns - 1)], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, seen], [*batch.schema.names, "symbol"])

    narrow = lines.select(
        _key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.col("line").cast("long").alias("line"), F.monotonically_increasing_id().alias("tie"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    read = narrow.mapInArrow(see, StructType([*narrow.schema, StructField("symbol", IntegerType())]))
    stored = materialise(read, "lines")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), stored.count() // BLOCK_LINES)
    order = ["conv", F.col("turn").asc_nulls_first(), F.col("line").asc_nulls_first(), "text", "tie"]
    blocks = materialise(stored.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "blocks")

    def ordered(block: pd.DataFrame) -> pd.DataFrame:
        return block.sort_values(["conv", "turn", "line", "text", "tie"], na_position="first", kind="stable").reset_index(drop=True)

    def summarise(block: pd.DataFrame) -> pd.DataFrame:
        block = ordered(block)
        seen = block["symbol"].to_numpy()
        ends = list(_segments(block))
        rows = [
            (int(block["part"].iloc[0]), conv, _summary(model, seen[a:b]).ravel().tolist())
            for conv, a, b in dict.fromkeys([ends[0], ends[-1]])
        ]
        return pd.DataFrame(rows, columns=["part", "conv", "scores"])

    summaries = blocks.select("part", *_ORDER, "text", "symbol").groupBy("part").applyInPandas(
        summarise, "part int, conv string, scores array<double>"
    )
    edges = summaries.groupBy("conv").applyInPandas(
        lambda rows: _edges(model, rows), "part int, conv string, enter int, leave int, final boolean"
    )
    bounds = materialise(edges, "bounds")

    def decode(block: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        block = ordered(block)
        seen, at = block["symbol"].to_numpy(), {row.conv: row for row in known.itertuples()}
        states, first, last = np.empty(len(block), np.int64), np.zeros(len(block), bool), np.zeros(len(block), bool)
        for conv, a, b in _segments(block):
            edge = at.get(conv)
            inside = edge is not None and edge.enter >= 0
            states[a:b] = _best(model, seen[a:b], edge.enter if inside else None, None if edge is None else edge.leave)
            first[a], last[b - 1] = not inside, edge is None or edge.final
        opens = (states % 2 == 0) | first
        roles = np.array(model.roles, object)[states // 2]
        rendered = [
            (("" if f else "<|end|>\n") + f"<|{r}|>\n{unmarked(t)}" if o else t) + "\n" + ("<|end|>\n" if z else "")
            for t, r, o, f, z in zip(block["text"], roles, opens, first, last, strict=True)
        ]
        return pd.DataFrame({
            "conv": block["conv"], "turn": block["turn"].astype("Int64"), "line": block["line"].astype("Int64"),
            "role": roles, "opens": opens, "rendered": rendered,
        })

    kind = lines.schema["conv_id"].dataType.simpleString()
    decoded = blocks.groupBy("part").cogroup(bounds.groupBy("part")).applyInPandas(
        decode, "conv string, turn long, line long, role string, opens boolean, rendered string"
    )
    named = F.when(F.substring("conv", 1, 1) == "c", F.expr("substring(conv, 2)").cast(kind)).alias("conv_id")
    return decoded.select(named, "turn", "line", "role", "opens", "rendered")


def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("c"), conv.cast("string")), F.lit("n"))


def transcript_lines(conversations: DataFrame, marked: float = 0.9) -> DataFrame:
    """(conv_id, turn, line, text, role, opens): conversations written as plain transcripts, with the true roles.

    The first line of a turn starts with one of its role's speaker words, drawn by the hash of the turn; a share of
    the turns has none. Missing roles are written without a marker.
    """
    draw = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(1000))
    word = F.lit(None).cast("string")
    for role, words in SPEAKERS.items():
        named = F.array(*[F.lit(w.capitalize()) for w in words])
        word = F.when(F.col("role") == role, F.element_at(named, (F.pmod(draw, F.lit(len(words))) + 1).cast("int"))).otherwise(word)
    prefix = F.when((draw < int(marked * 1000)) & word.isNotNull(), F.concat(word, F.lit(": "))).otherwise(F.lit(""))
    text = F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")
    return conversations.select("conv_id", "turn", "role", prefix.alias("prefix"), F.posexplode(text).alias("line", "body")).select(
        "conv_id", "turn", "line", F.when(F.col("line") == 0, F.concat("prefix", "body")).otherwise(F.col("body")).alias("text"),
        "role", (F.col("line") == 0).alias("opens"),
    )


def train(labelled: DataFrame, fit_lines: int = FIT_LINES) -> ChatModel:
    """The model of labelled lines (conv_id, turn, line, text, role, opens): all their roles, and the probabilities of
    at most ``fit_lines`` lines, with as many of each role that these lack."""
    key = F.xxhash64("conv_id")
    known = labelled.filter("conv_id IS NOT NULL AND role IS NOT NULL")

    def read(rows: DataFrame) -> pd.DataFrame:
        table = rows.select(_key(F.col("conv_id")).alias("conv"), "role", "opens", "text").toPandas()
        table["symbol"] = [symbol(t or "") for t in table["text"]]
        return table

    table = read(known.orderBy(key, "conv_id", "turn", "line", "text").limit(fit_lines))
    roles = {r[0] for r in labelled.filter("role IS NOT NULL").select("role").distinct().collect()}
    lines = labelled.withColumn("hash", F.xxhash64("conv_id", "turn", "line", "text"))
    apart = [
        read(lines.filter(F.col("role") == role).orderBy("hash", "conv_id", "turn", "line", "text").limit(fit_lines))
        for role in sorted(roles - set(table["role"]))
    ]
    return fit(table, apart=pd.concat(apart) if apart else None)
