"""Byte-level BPE encoding and decoding with a public rank file.

Overlapping chunk encoding: a long text is cut into chunks that overlap, each is split into pre-tokens on its own
(in threads: the pattern engine lets go of the interpreter lock), and neighbours are stitched at the first pre-token
boundary that both have in the overlap. From such a boundary on the pattern sees the same text, so it splits alike. A boundary near a chunk's
end does not count, for the pattern looks ahead there. Where an overlap holds no common boundary, splitting goes on
from the last sure one. The pieces are then encoded one by one, through a bounded memory of pieces seen before;
decoding concatenates the bytes of the ids.

Defined results: a null text is an empty one and has no ids; repeated rows are encoded alike, each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import common

#: Characters in a chunk, in the overlap of neighbours, and before a chunk's end in which its boundaries do not count.
CHUNK, OVERLAP, MARGIN = 1 << 16, 1 << 10, 8
#: Pieces kept with their ids, and the length up to which a piece is kept.
MEMORY, KEPT_LENGTH = 1 << 18, 64


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The lines "base64 rank" of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def pre_tokens(pattern: regex.Pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, threads: int = 2) -> list[str]:
    """All matches of pattern in text, which must leave no character between two matches."""
    if len(text) <= chunk + overlap:
        return pattern.findall(text)
    starts = range(0, len(text), chunk)
    with ThreadPoolExecutor(threads) as pool:
        ends = list(pool.map(lambda a: [m.end() for m in pattern.finditer(text, a, min(len(text), a + chunk + overlap), concurrent=True)], starts))
    cuts: list[int] = []
    at = 0
    for k, a in enumerate(starts):
        limit, found = min(len(text), a + chunk + overlap), ends[k]
        if at != a:  # not in step yet: go on only from a boundary that this chunk has too
            known = set(found)
            while at not in known and at < limit:
                m = pattern.match(text, at)
                at = m.end()
                cuts.append(at)
        last = k + 1 == len(starts)
        for b in found:
            if b > at and (last or b <= limit - MARGIN):
                cuts.append(b)
                at = b
            if not last and at >= a + chunk + overlap // 2:
                break
    while at < len(text):
        at = pattern.match(text, at).end()
        cuts.append(at)
    return [text[a:b] for a, b in zip([0, *cuts], cuts)]


class Codec:
    """Encodes with the merges of a rank file as the tiktoken library would, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.pattern = regex.compile(pattern)
        own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._encode = own._core_bpe.encode_single_piece  # merges one piece of bytes, without another split
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.table[rank] = piece
        self._known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = np.array(self._encode(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self._known) >= MEMORY:
                self._known.clear()
            self._known[piece] = ids
        return ids

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known, piece = self._known.get, self._piece
        return b"".join([known(x) or piece(x) for x in pre_tokens(self.pattern, text, chunk, overlap)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, with_ids: bool = True) -> DataFrame:
    """Per document: its number of ids, the ids (an array, if asked for), the SHA-256 of their bytes and of the bytes that they decode to."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)  # the file: its size is fixed

    def run(batches):
        codec = Codec(read_ranks(held.value), pattern)
        for batch in batches:
            n, sums, backs, lists = [], [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                sums.append(hashlib.sha256(ids).hexdigest())
                backs.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(np.frombuffer(ids, dtype="<u4").astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(backs, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return common.arrow(common.with_key(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """(doc_id, ids array<int>) as (doc_id, bytes binary): the bytes of all ids end to end. Null ids: no bytes."""
    held = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        table = {rank: piece for piece, rank in read_ranks(held.value).items()}
        for batch in batches:
            out = [b"".join(map(table.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return common.arrow(encoded.select(F.col("doc_id").cast("long"), "ids"), run, "doc_id long, bytes binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    common.prepare(spark)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, public_tokenizers.PATTERN, with_ids=False)
