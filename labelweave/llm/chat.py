"""Chat formatting with loss masks that are aligned by offsets.

A conversation is rendered whole by a template, which marks each turn by control strings and escapes these inside roles and texts, reversibly. The rendering
is encoded once; each token's offsets are the running sum of its bytes, and each turn's text has its span there. Both lists are sorted, so binary search
finds the tokens of every span: those of assistant texts are the loss mask. A control string is one token (ids after the vocabulary's), so no
token crosses the end of a span, and the text under the mask is exactly the assistants'.

Plans: rows meet by conversation and block of TURNS turn numbers, sorted, and stream through a task: memory follows one piece (PIECE characters, or one
longer text), and one endless conversation is encoded in as many tasks as it has blocks. A conversation of fewer turns and characters is one row.
Since control strings end every token, encoding piece by piece gives the ids of the whole.

Defined results: a null text or role is an empty one; turns go by number, missing numbers first, equal ones by role, then text, so repeated rows are kept, each a
turn; rows without a conv_id are one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import bpe, common

#: Characters after which a piece of a conversation ends, turn numbers of a block (512), bytes of pieces that leave a task together.
PIECE, BLOCK_BITS, BATCH = 1 << 20, 9, 4 << 20
ASSISTANT = "assistant"
SCHEMA = "conv_id long, block long, piece int, n_turns int, formatted string, ids array<int>, mask array<boolean>"


@dataclass(frozen=True)
class Template:
    """A turn is opens, role, says, text, closes. A control string begins with the same character as the others, holds it once and holds no backslash: a
    backslash after that character keeps it from being one."""

    opens: str = "<turn>"
    says: str = "<says>"
    closes: str = "</turn>"

    def __post_init__(self):
        if len({x[:1] for x in self.controls}) != 1 or len(set(self.controls)) != 3 or any(x.count(x[0]) != 1 or "\\" in x or len(x) < 2 for x in self.controls):
            raise ValueError(f"no control strings: {self.controls}")

    @property
    def controls(self) -> tuple[str, str, str]:
        return self.opens, self.says, self.closes

    def escape(self, text: str) -> str:
        first = self.opens[0]
        text = text.replace("\\", "\\\\")
        if first not in text:
            return text
        rest = "|".join(re.escape(x[1:]) for x in self.controls)
        return re.sub(f"{re.escape(first)}(?={rest})", lambda m: first + "\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


class ChatCodec:
    """Encodes renderings: text by the vocabulary's merges, each control string as one id."""

    def __init__(self, ranks: bytes, pattern: str, template: Template):
        self.codec, self.template = bpe.Codec(bpe.read_ranks(ranks), pattern), template
        self.first = len(self.codec.table)  # id of the first control string
        self.table = [*self.codec.table, *(x.encode() for x in template.controls)]
        self.length = np.array([len(x) for x in self.table], dtype=np.int64)
        self._control = {x: np.array([self.first + i], dtype="<u4").tobytes() for i, x in enumerate(template.controls)}
        self._split = re.compile("(" + "|".join(map(re.escape, template.controls)) + ")")

    def encode(self, rendered: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): token i has the bytes from offsets[i] to offsets[i + 1]."""
        raw = b"".join(self._control.get(x) or self.codec.encode(x) for x in self._split.split(rendered) if x)
        ids = np.frombuffer(raw, dtype="<u4").astype(np.int32)
        return ids, np.concatenate([[0], np.cumsum(self.length[ids])])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))


def covered(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie inside one of the spans (rows of start and end; sorted, disjoint)."""
    n = len(offsets) - 1
    first = np.searchsorted(offsets[:-1], spans[:, 0], side="left")  # the first token that starts in the span
    stop = np.searchsorted(offsets[1:], spans[:, 1], side="right")  # after the last that ends in it
    edge = np.zeros(n + 1, dtype=np.int64)
    some = stop > first
    np.add.at(edge, first[some], 1)
    np.add.at(edge, stop[some], -1)
    return np.cumsum(edge[:n]) > 0


def render(turns: list[tuple[str, str]], template: Template) -> tuple[str, np.ndarray]:
    """(the rendering, the spans of assistant texts in its bytes)."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = template.opens + template.escape(role) + template.says, template.escape(text)
        start = at + len(head.encode())
        end = start + len(body.encode())
        if role == ASSISTANT:
            spans.append((start, end))
        out += [head, body, template.closes]
        at = end + len(template.closes.encode())
    return "".join(out), np.array(spans, dtype=np.int64).reshape(-1, 2)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((conv_id, block), number of the piece, its turns) from sorted rows."""
    key, number, turns, size = None, 0, [], 0
    for batch in batches:
        for conv, block, role, text in zip(*(batch.column(i) for i in (0, 1, 2, 3))):
            now = (conv.as_py(), block.as_py())
            role, text = role.as_py(), text.as_py()
            if turns and (now != key or size + len(text) > PIECE):
                yield key, number, turns
                number, turns, size = (number + 1 if now == key else 0), [], 0
            key = now
            turns.append((role, text))
            size += len(role) + len(text)
    if turns:
        yield key, number, turns


def format_conversations(conversations: DataFrame, ranks: bytes, pattern: str, template: Template = Template()) -> DataFrame:
    """(conv_id, block, piece, n_turns, formatted, ids, mask) of each conversation (conv_id, turn, role, text)."""
    held = conversations.sparkSession.sparkContext.broadcast(ranks)  # the file: its size is fixed

    def run(batches):
        codec, rows, size = ChatCodec(held.value, pattern, template), [], 0
        for (conv, block), number, turns in _pieces(batches):
            rendered, spans = render(turns, template)
            ids, offsets = codec.encode(rendered)
            rows.append((conv, block, number, len(turns), rendered, ids, covered(offsets, spans)))
            size += len(rendered)
            if size > BATCH:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.col("turn").cast("long")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.shiftright(turn, BLOCK_BITS).alias("block"), text("role").alias("role"), text("text").alias("text"), turn.alias("turn"))
    return common.arrow(rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text"), run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, block, piece, n, rendered, ids, mask = zip(*rows)
    types = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((conv, block, piece, n, rendered, ids, mask), types)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def read_back(codec: ChatCodec, ids: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], list[str]]:
    """(the turns, the texts under the mask) of a piece, from its tokens alone."""
    data, at = codec.decode(ids), np.concatenate([[0], np.cumsum(codec.length[ids])])
    back = lambda a, b: codec.template.unescape(data[a:b].decode())
    opens, says, closes = (np.flatnonzero(ids == codec.first + i) for i in range(3))
    turns = [(back(at[o + 1], at[s]), back(at[s + 1], at[c])) for o, s, c in zip(opens, says, closes, strict=True)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return turns, [back(at[a], at[b]) for a, b in edges.reshape(-1, 2)]


def digests(formatted: DataFrame, ranks: bytes, pattern: str, template: Template = Template()) -> DataFrame:
    """Per conversation, read back from ids and mask: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A digest runs through its conversation in order, so the
    pieces of one stream through one task, a piece at a time."""
    held = formatted.sparkSession.sparkContext.broadcast(ranks)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()

    def run(batches):
        codec, rows, key, some = ChatCodec(held.value, pattern, template), [], None, False
        for batch in batches:
            for conv, text, ids, mask in zip(*(batch.column(i) for i in range(4))):
                if some and conv.as_py() != key:
                    rows.append((key, n, said.hexdigest(), chars, lost.hexdigest(), long))
                    some = False
                if not some:
                    key, some, n, chars, long, said, lost = conv.as_py(), True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                text, ids = text.as_py(), ids.values.to_numpy()
                if codec.decode(ids) != text.encode():
                    raise ValueError(f"conversation {key}: the ids do not give its rendering back")
                turns, learnt = read_back(codec, ids, mask.values.to_numpy(zero_copy_only=False))
                for role, body in turns:
                    said.update(f"{role}\n{body}\n".encode())
                for body in learnt:
                    lost.update(body.encode())
                n, chars, long = n + len(turns), chars + sum(map(len, learnt)), long + len(text)
            if len(rows) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)
                rows = []
        if some:
            rows.append((key, n, said.hexdigest(), chars, lost.hexdigest(), long))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    sorted_ = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block", "piece").select("conv_id", "formatted", "ids", "mask")
    return common.arrow(sorted_, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the query adds.
ADDED, SAID = -7, "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    common.prepare(spark)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(ADDED, 0, "user", SAID), (ADDED, 1, ASSISTANT, SAID)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(given.unionByName(added), ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)


def oracle_sql() -> str:
    escaped = lambda c: f"length({c}) + length({c}) - length(replace({c}, '\\', '')) + len(regexp_extract_all({c}, '<turn>|<says>|</turn>'))"
    return rf"""
    WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT {ADDED}, 0, 'user', '{SAID}' UNION ALL SELECT {ADDED}, 1, 'assistant', '{SAID}')
    SELECT conv_id, count(*)::BIGINT AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(19 + {escaped("role")} + {escaped("text")})::BIGINT AS formatted_chars
    FROM a GROUP BY conv_id"""
