"""Chat transcripts: a hidden Markov model over speaker markers and line features recovers who speaks, then turns are rendered.

Input rows are (conversation, turn, text); a text may be one message or a whole transcript with markers such as ``User:``.
Each line gives one observation: the kind of its speaker marker, and a code of its length, place and form. States are the roles.
The speaker can change only where a row begins or a known marker stands.

Learning counts, over all rows with a known role, how often each role makes each code and which role follows which; only these
counts, of fixed size, reach the driver. How a marker tells its role is given (``MARKER_TELLS``), as labelled rows need not have any.

Decoding is Viterbi's, in three steps so that a conversation of any length is never one task's work: a conversation is
cut into chunks of ``CHUNK`` rows by their rank; each chunk is reduced to the best score between every entry and exit role; these small
matrices, one per chunk, give the roles at the chunks' borders; and each chunk is decoded between its borders.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import stored
from tidemark.operators.ordered import rank_by_range

ROLES = ("system", "user", "assistant")
# Names that stand for a role, in markers and in role columns.
NAMES = {
    "system": "system", "instruction": "system", "instructions": "system", "context": "system",
    "user": "user", "human": "user", "customer": "user", "question": "user", "q": "user", "prompter": "user",
    "assistant": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant", "gpt": "assistant",
    "answer": "assistant", "a": "assistant", "response": "assistant", "agent": "assistant",
}
MARKER_TELLS = 0.97
CHUNK = 512
FORMS, SIZES = 4, 16
CODES = 2 * SIZES * FORMS
START = len(ROLES)
_MARKER = re.compile(r"^[\s#>*\[<|\-]{0,8}([A-Za-z]{1,12})[\s*|\])>]{0,4}[:>\]][\s*>]{0,4}")
_LISTED = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s|```")


def split_marker(line: str) -> tuple[int, str]:
    """(place of the role that a marker names or -1, the line without the marker)."""
    found = _MARKER.match(line)
    role = NAMES.get(found[1].lower()) if found else None
    return (ROLES.index(role), line[found.end() :]) if role else (-1, line)


def observe(text: str | None) -> list[int]:
    """One number per line: (marker's role + 1) * CODES + code. A null text is one empty line."""
    lines = (text or "").split("\n")
    out = []
    for place, line in enumerate(lines):
        marker, rest = split_marker(line)
        size = len(rest) if place or marker >= 0 else len(text or "")
        form = 2 * bool(_LISTED.search(rest)) + rest.rstrip().endswith("?")
        code = ((place == 0) * SIZES + min(SIZES - 1, (2 * max(1, size)).bit_length() - 1)) * FORMS + form
        out.append((marker + 1) * CODES + code)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def observed(texts: pd.Series) -> pd.Series:
    return pd.Series([observe(t) for t in texts], dtype=object)


def _emissions(made: np.ndarray) -> np.ndarray:
    """log P(observation | role) for every marker and code, the start state last; ``made`` counts (role, code)."""
    by_code = np.log((made + 0.5) / (made.sum(axis=1, keepdims=True) + 0.5 * CODES))
    wrong = (1 - MARKER_TELLS) / (len(ROLES) - 1)
    markers = np.vstack([np.ones(len(ROLES)), np.where(np.eye(len(ROLES)) > 0, MARKER_TELLS, wrong)])
    table = np.log(markers)[:, :, None] + by_code
    full = np.full((len(ROLES) + 1, len(ROLES) + 1, CODES), -np.inf)
    full[:, : len(ROLES)] = table
    return full.transpose(0, 2, 1).reshape(-1, len(ROLES) + 1)


def _transitions(first: np.ndarray, follows: np.ndarray) -> np.ndarray:
    out = np.full((len(ROLES) + 1, len(ROLES) + 1), -np.inf)
    out[:START, :START] = np.log((follows + 0.5) / (follows + 0.5).sum(axis=1, keepdims=True))
    out[START, :START] = np.log((first + 0.5) / (first + 0.5).sum())
    return out


def _steps(rows: list) -> list[tuple[int, bool]]:
    """(observation, whether the speaker may change) of all lines of a chunk's rows."""
    return [(int(o), i == 0 or o >= CODES) for codes in rows for i, o in enumerate(codes)]


def reduce_chunk(rows: list, emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Best score from the role before the chunk to the role at its end, for all pairs."""
    best = np.where(np.eye(START + 1) > 0, 0.0, -np.inf)
    for o, change in _steps(rows):
        if change:
            best = (best[:, :, None] + transition[None]).max(axis=1)
        best = best + emission[o]
    return best


def borders(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(role before, role at the end) of each chunk of a conversation on the best path."""
    score = np.where(np.arange(START + 1) == START, 0.0, -np.inf)
    came = []
    for matrix in matrices:
        ways = score[:, None] + matrix
        came.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    at, out = int(score[:START].argmax()), []
    for back in reversed(came):
        out.append((int(back[at]), at))
        at = int(back[at])
    return out[::-1]


def decode_chunk(rows: list, entry: int, leave: int, emission: np.ndarray, transition: np.ndarray) -> list[list[int]]:
    """The role of every line of a chunk's rows on the best path between the given roles."""
    score = np.where(np.arange(START + 1) == entry, 0.0, -np.inf)
    came = []
    stay = np.arange(START + 1)
    for o, change in _steps(rows):
        if change:
            ways = score[:, None] + transition
            came.append(ways.argmax(axis=0))
            score = ways.max(axis=0)
        else:
            came.append(stay)
        score = score + emission[o]
    at, path = leave, []
    for back in reversed(came):
        path.append(at)
        at = int(back[at])
    path = path[::-1]
    out, i = [], 0
    for codes in rows:
        out.append(path[i : i + len(codes)])
        i += len(codes)
    return out


def render(text: str | None, roles: list[int]) -> tuple[list[str], str]:
    """Roles of the turns in a row and their canonical form; a turn begins with the row, at a marker or with a new role."""
    turns: list[tuple[int, list[str]]] = []
    for place, (line, role) in enumerate(zip((text or "").split("\n"), roles, strict=True)):
        marker, rest = split_marker(line)
        if place == 0 or marker >= 0 or role != turns[-1][0]:
            turns.append((role, []))
        turns[-1][1].append(rest)
    blocks = []
    for role, lines in turns:
        body = "\n".join(lines).strip()
        blocks.append(f"<|{ROLES[role]}|>\n{body}\n<|end|>")
    return [ROLES[role] for role, _ in turns], "\n".join(blocks)


def known_role(role: Column) -> Column:
    """The canonical name of a role, or null."""
    plain = F.lower(F.trim(role))
    out = F.when(F.lit(False), "")
    for name, canonical in NAMES.items():
        out = out.when(plain == name, canonical)
    return out


def _chunks(rows: DataFrame, conv_id: str, turn: str, text: str, role: str) -> DataFrame:
    """One row per chunk: its rows in order as structs (turn, text hash, codes, role)."""
    keyed = rows.select(*_keys(conv_id, turn, text), observed(F.col(text)).alias("codes"), known_role(F.col(role)).alias("role"))
    # chunks are cut by position, so that turns without a number, or with one number, do not meet in one chunk
    placed = rank_by_range(keyed.dropDuplicates(["conv", "at", "th"]), ["conv"], ["at", "th"], "place")
    return placed.groupBy("conv", F.floor((F.col("place") - 1) / CHUNK).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("at", "th", "codes", "role"))).alias("rows")
    )


def _keys(conv_id: str, turn: str, text: str) -> list[Column]:
    """Conversation, place and text hash of a row, none of them null; a row without a conversation is one of its own."""
    th = F.xxhash64(F.col(text))
    conv = F.coalesce(F.concat(F.lit("c"), F.col(conv_id).cast("string")), F.concat_ws(":", F.lit("r"), F.col(turn), th))
    return [conv.alias("conv"), F.coalesce(F.col(turn).cast("long"), F.lit(-1)).alias("at"), th.alias("th")]


def learn(chunks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(emission, transition) from the chunks' rows of known role."""
    place = {role: i for i, role in enumerate(ROLES)}
    rows = chunks.select(F.explode("rows").alias("r")).where("r.role is not null")
    made = np.zeros((len(ROLES), CODES))
    lines = rows.select("r.role", F.explode("r.codes").alias("o")).groupBy("role", (F.col("o") % CODES).alias("code"))
    for row in lines.count().collect():
        made[place[row["role"]], row["code"]] += row["count"]
    ordered = Window.partitionBy("conv").orderBy("chunk")
    roles = chunks.select("conv", "chunk", F.col("rows.role").alias("roles"))
    # within a chunk each row and the next; over a border the last row before it and the first after it
    joined = roles.withColumn("before", F.lag(F.element_at("roles", -1)).over(ordered)).withColumn(
        "is_first", F.row_number().over(ordered) == 1
    )
    pairs = joined.select(
        F.explode(F.arrays_zip(F.concat(F.array("before"), F.col("roles")).alias("a"), F.col("roles").alias("b"))).alias("p")
    ).where("p.a is not null and p.b is not null")
    follows, first = np.zeros((len(ROLES), len(ROLES))), np.zeros(len(ROLES))
    for row in pairs.groupBy("p.a", "p.b").count().collect():
        follows[place[row["a"]], place[row["b"]]] += row["count"]
    begins = joined.where("is_first").select(F.element_at("roles", 1).alias("role")).where("role is not null")
    for row in begins.groupBy("role").count().collect():
        first[place[row["role"]]] += row["count"]
    return _emissions(made), _transitions(first, follows)


def held_out(conv_id: Column) -> Column:
    """The fold that no learning sees: crc32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(conv_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def recovered(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role"
) -> DataFrame:
    """One row per input row: conv_id, turn, held_out, roles (array, one per turn found in the text), rendered.

    ``role`` teaches the model on conversations that are not held out and is never looked at in decoding. Rows are ordered by turn, null turns
    first, then by a hash of the text; equal rows of a conversation are one in the path and share its answer. A null text is an empty one.
    A row without a conv_id is a conversation of its own. Without any known role the model is uniform but for markers.
    """
    chunks = stored(_chunks(rows, conv_id, turn, text, role), "chunks")
    kept = ~held_out(F.substring("conv", 2, 1 << 30))
    emission, transition = learn(chunks.where(kept))
    shared = rows.sparkSession.sparkContext.broadcast((emission, transition))

    @F.pandas_udf("array<double>")
    def reduced(codes: pd.Series) -> pd.Series:
        return pd.Series([reduce_chunk(c, *shared.value).ravel() for c in codes], dtype=object)

    @F.pandas_udf("array<array<int>>")
    def at_borders(matrices: pd.Series) -> pd.Series:
        side = START + 1
        return pd.Series([borders([np.asarray(m).reshape(side, side) for m in ms]) for ms in matrices], dtype=object)

    @F.pandas_udf("array<array<int>>")
    def decoded(codes: pd.Series, border: pd.Series) -> pd.Series:
        return pd.Series([decode_chunk(c, b[0], b[1], *shared.value) for c, b in zip(codes, border, strict=True)], dtype=object)

    @F.pandas_udf("roles array<string>, rendered string")
    def rendered(texts: pd.Series, path: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([render(t, p) for t, p in zip(texts, path, strict=True)], columns=["roles", "rendered"])

    small = chunks.select("conv", "chunk", reduced("rows.codes").alias("m")).groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "m"))).alias("ms")
    )
    border = small.select("conv", F.explode(F.arrays_zip(F.col("ms.chunk").alias("chunk"), at_borders("ms.m").alias("border"))).alias("b"))
    border = border.select("conv", "b.chunk", "b.border")
    path = chunks.join(border, ["conv", "chunk"]).select(
        "conv", F.explode(F.arrays_zip(F.col("rows"), decoded("rows.codes", "border").alias("path"))).alias("z")
    )
    path = path.select("conv", F.col("z.rows.at").alias("at"), F.col("z.rows.th").alias("th"), F.col("z.path").alias("path"))
    whole = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(text).alias("text"), *_keys(conv_id, turn, text))
    answered = whole.join(path, ["conv", "at", "th"]).select("conv_id", "turn", rendered("text", "path").alias("r"))
    return answered.select("conv_id", "turn", held_out(F.col("conv_id")).alias("held_out"), "r.roles", "r.rendered")
