"""SimHash near-dedup with pigeonring filtering.

A signature is a ring of segments. If two signatures differ by at most `t` over `m` segments, then from some segment
on every chain of l consecutive ones differs by at most l * t / m: the budget grows in proportion. So two signatures are
compared only if some segment is equal and the chains from it stay within budget; the last chain is the full check.

`similar_fingerprints` does this for 64-bit SimHash fingerprints (4 segments of 16 bits, at most 3 bits). Fingerprints
are made distinct first. Each goes into one bucket per segment; in a bucket the next segment, with at most one bit
flipped, is looked up by sorting, so no bucket is compared all against all, and only a spanning forest of its links leaves it.

`near_duplicates` serves similarity thresholds, for which 64 bits of SimHash are too coarse (at a Jaccard similarity of
0.8 fingerprints differ by 10 bits on average, and budgets for that many prune nothing): its ring has 32 segments, each the low 16
bits of a minimum hash of the shingles, and its candidates are checked on their whole shingle sets.

Defined results: null and empty texts have the zero fingerprint, linked like any other, and empty shingle sets, which
are copies of one another; rows without a doc_id take part (component_id null if no row of the component has one); repeated rows
share fingerprint and component; a very long text is hashed whole, shingle by shingle; an empty table gives an empty result; other columns are ignored, or pass through `keep_one`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import common
from labelweave.llm.components import components

SHINGLE, BITS, SEGMENTS, SEED = 3, 3, 4, 42
#: near_duplicates: shingle words, similarity, segments, and how many segments may differ in a candidate.
WORDS, SIMILARITY, RING, RING_BUDGET = 5, 0.8, 32, 12
#: Segments that may differ from a bucket's leader so that a member needs no other leader there, at first.
CLOSE = 6
#: Members from which on a bucket's leaders are chosen, not just taken in order.
CROWD = 16
PAIRS = 1 << 22
#: Pairs of one node that meet its shingle set in one task, on average.
MEET = 1000
#: Bins of the sketch that candidates of the second round must agree in.
BINS = 2048


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of `width` words, joined by one space; of all words if there are fewer; none if there are none."""
    words = text.lower().split()  # of bytes: A-Z, and white space 0x20, 0x09-0x0D
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, stops[:-1] + 1)
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), stops[width - 1 :].tolist())), dtype=np.uint64, count=len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, -(-len(hashes) // 4096)):
        counts += np.unpackbits(np.ascontiguousarray(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""

    def run(batch):
        fps = [fingerprint(shingle_hashes(x.as_py() or b"", shingle)) for x in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return common.map_arrow(common.with_key(docs).withColumn("text", F.col("text").cast("binary")), run, "doc_id long, fp long")


def labels_of(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The smallest index in each of n items' component, given links (and labels found so far)."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:  # every item to its root
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def _flips(values: np.ndarray, order: np.ndarray, asked: np.ndarray):
    """Pairs (index in asked, index in values) of 16-bit values that differ in at most one bit, in pieces."""
    held = values[order]
    for flip in (0, *(1 << k for k in range(16))):
        want = asked ^ np.uint16(flip)
        lo, hi = np.searchsorted(held, want), np.searchsorted(held, want, side="right")
        sizes = hi - lo
        ends = np.cumsum(sizes)
        at = 0
        while at < len(asked):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            n = sizes[at:stop]
            if n.sum():
                left = np.repeat(np.arange(at, stop), n)
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield left, order[np.repeat(lo[at:stop], n) + within]
            at = stop


def bucket_forest(fps: np.ndarray, segment: int) -> np.ndarray:
    """Of distinct fingerprints that agree in a segment: the first one of each one's component."""
    part = lambda k: ((fps >> np.uint64(16 * ((segment + k) % SEGMENTS))) & np.uint64(0xFFFF)).astype(np.uint16)
    labels = np.arange(len(fps))
    second, third, fourth = part(1), part(2), part(3)
    order = np.argsort(second, kind="stable")
    _, counts = np.unique(second, return_counts=True)
    if 17 * int((counts.astype(np.int64) ** 2).sum()) <= 16 * PAIRS:
        pieces = _flips(second, order, second)
    else:  # of at most 3 bits in two segments one has at most one: look the crowd up by each of them
        pieces = (x for v in (third, fourth) for x in _flips(v, np.argsort(v, kind="stable"), v))
    for a, b in pieces:
        first = np.bitwise_count(second[a] ^ second[b])
        ok = (a < b) & (first <= 2 * BITS // SEGMENTS)
        a, b, first = a[ok], b[ok], first[ok]
        next_ = first + np.bitwise_count(third[a] ^ third[b])
        ok = next_ <= 3 * BITS // SEGMENTS
        a, b, next_ = a[ok], b[ok], next_[ok]
        ok = next_ + np.bitwise_count(fourth[a] ^ fourth[b]) <= BITS
        labels = labels_of(len(fps), a[ok], b[ok], labels)
    return labels


def similar_fingerprints(distinct: DataFrame) -> DataFrame:
    """(fp), distinct, to edges (u, v) between fingerprints that connect all of those at most 3 bits apart."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segment = lambda k: F.lit(k << 16) + F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)

    def run(batches):
        for key, fps, _ in _groups(batches):
            if len(fps) > 1:
                labels = bucket_forest(fps.view(np.uint64), int(key >> 16))
                more = np.flatnonzero(labels != np.arange(len(labels)))
                if len(more):
                    yield pa.RecordBatch.from_arrays([pa.array(fps[more]), pa.array(fps[labels[more]])], names=["u", "v"])

    ring = distinct.select(F.explode(F.array(*(segment(k).cast("long") for k in range(SEGMENTS)))).alias("key"), "fp")
    return common.arrow(ring.repartition(n, "key").sortWithinPartitions("key").select("key", "fp", "fp"), run, "u long, v long").distinct()


def _groups(batches):
    """(key, second column, third column) for each run of equal keys in sorted batches of (key, x, y)."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        key = columns[0]
        if not len(key):
            continue
        cuts = np.flatnonzero(np.diff(key)) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(key))):
            if held and held[0][0][0] != key[a]:
                yield held[0][0][0], *(np.concatenate(x) for x in list(zip(*held))[1:])
                held = []
            held.append(tuple(c[a:b] for c in columns))
    if held:
        yield held[0][0][0], *(np.concatenate(x) for x in list(zip(*held))[1:])


def link_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs."""
    prints = common.written(fingerprints(docs, shingle), "fingerprints")
    distinct = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(similar_fingerprints(distinct.select("fp"))).withColumnRenamed("node", "fp")
    own = distinct.join(found, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = own.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = own.join(least, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity thresholds -------------------------------------------------------------------------------------------

_SALTS = common.mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def ring_signature(hashes: np.ndarray, segments: int = RING) -> np.ndarray:
    """Low 16 bits of the smallest of all hashes under each of `segments` permutations."""
    out = np.full(segments, (1 << 64) - 1, dtype=np.uint64)
    for part in np.array_split(hashes, max(1, -(-len(hashes) // 4096))):
        for k in range(segments if len(part) else 0):
            x = (part ^ _SALTS[k]) * np.uint64(0xD6E8FEB86659FD93)
            out[k] = min(out[k], (x ^ (x >> np.uint64(32))).min())
    return (common.mix(out) & np.uint64(0xFFFF)).astype(np.uint16)


def sketch(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation sketch: the smallest hash of each bin, as 1 to 255; 0 for an empty bin."""
    out, x = np.zeros(bins, dtype=np.uint8), np.sort(common.mix(hashes ^ _SALTS[0]))
    where = (x >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64)
    first = np.flatnonzero(np.diff(where, prepend=-1))
    out[where[first]] = (common.mix(x[first]) % np.uint64(255)).astype(np.uint8) + 1
    return out


class Sketches:
    """The sketches of a bucket's members, kept packed if there are many: indexed by members, they come as rows."""

    MANY = 16384

    def __init__(self, packed: list[bytes]):
        self.packed = packed
        self.rows = np.stack([self._row(x) for x in packed]) if len(packed) <= self.MANY else None

    @staticmethod
    def _row(x: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.decompress(x), dtype=np.uint8)

    def __getitem__(self, at):
        if self.rows is not None:
            return self.rows[at]
        return self._row(self.packed[at]) if np.ndim(at) == 0 else np.stack([self._row(self.packed[i]) for i in at])


def may_be_similar(one: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
    """Which sketches agree with one in as many bins as sets of that similarity do, less three standard deviations. The bins are a sample of the two
    sets' union, drawn without putting back: of short texts, whose shingles have bins of their own, it is nearly all."""
    used = ((others | one) != 0).sum(axis=1)
    agree = ((others == one) & (others != 0)).sum(axis=1)
    bins = others.shape[1]
    union = -bins * np.log1p(-np.minimum(used, bins - 0.5) / bins)
    unseen = 1 - used / np.maximum(union, used + 0.5)
    return agree >= similarity * used - 3 * np.sqrt(similarity * (1 - similarity) * used * unseen) - 1.5


def ring_pairs(nodes: np.ndarray, signatures: np.ndarray, budget: int = RING_BUDGET, close: int = CLOSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First candidate links (member, leader) in a bucket. A leader is compared with all others; those not close to it are compared with the
    next one. In a crowd the leader is the member that agrees with most of the medians of all segments, its centre if it has one, so
    that a large group of near copies needs one leader, and much the same one in each bucket. The signatures begin at the bucket's segment.
    Third, the members among which pairs are left uncompared (none, if no member was close to a leader before its turn): once the first
    links are verified, `ring_rest` finds what those pairs can still link."""
    m = signatures.shape[1]
    allowed = np.arange(1, m + 1) * budget // m
    left, right, rest, open_ = [], [], np.argsort(nodes, kind="stable"), None
    while len(rest) > 1:
        at = 0
        if len(rest) > CROWD:
            crowd = signatures[rest]
            at = int((crowd == np.partition(crowd, len(rest) // 2, axis=0)[len(rest) // 2]).sum(axis=1).argmax())
        leader, rest = rest[at], np.delete(rest, at)
        differ = np.cumsum(signatures[rest] != signatures[leader], axis=1, dtype=np.int16)
        near = differ[:, -1] <= close
        hit = rest[near | (differ <= allowed).all(axis=1)]  # a pair within budget keeps to it from some segment on
        if len(hit):
            left.append(nodes[hit])
            right.append(np.full(len(hit), nodes[leader]))
        if open_ is None and len(rest) > 1 and near.any():
            open_ = nodes[rest]  # leaders before this one were compared with all
        rest = rest[~near]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right), none if open_ is None else open_) if left else (none, none, none)


def _runs(*segments: np.ndarray):
    """Members that agree in all these segments, two or more of them."""
    key = sum(s.astype(np.int64) << 16 * k for k, s in enumerate(segments))
    order = np.argsort(key, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if len(run) > 1:
            yield run


def _earlier(differ: np.ndarray, segment: int, allowed: np.ndarray) -> np.ndarray:
    """For pairs as differing segments from `segment` on: whether they keep to the budget from a segment before it, too, and so meet in its bucket."""
    m = differ.shape[1]
    sums = np.cumsum(np.concatenate([np.zeros((len(differ), 1), dtype=bool), differ, differ], axis=1), axis=1, dtype=np.int16)
    out = np.zeros(len(differ), dtype=bool)
    for j in range(segment):
        r = (j - segment) % m
        out |= (sums[:, r + 1 : r + 1 + m] - sums[:, r : r + 1] <= allowed).all(axis=1)
    return out


def ring_rest(nodes: np.ndarray, signatures: np.ndarray, labels: np.ndarray, budget: int = RING_BUDGET, segment: int = 0, sketches: Sketches | None = None, similarity: float = SIMILARITY, sets: list[bytes] | None = None):
    """All pairs of a bucket's members (the smaller first) that are within budget, have different labels and sketches that may be of similar sets, in
    pieces, but for those that meet in an earlier segment's bucket; a pair may come up to three times.
    With the members' shingle sets, pairs are verified here, and of the links a forest is given: a pair that verified links have brought together is not
    looked at any more.
    Of the three segments after the bucket's two, a pair within budget has two equal, so a crowd is looked up by each two of them."""
    m = signatures.shape[1]
    allowed = np.arange(1, m + 1) * budget // m
    crowded = len(nodes) > CROWD and m >= 5 and allowed[4] <= 1
    held, size = [], 0
    roots = np.unique(labels, return_inverse=True)[1]  # of members, as verified links bring them together
    for run in (r for a, b in ((2, 3), (2, 4), (3, 4)) for r in _runs(signatures[:, a], signatures[:, b])) if crowded else [np.arange(len(nodes))]:
        _, label, counts = np.unique(labels[run], return_inverse=True, return_counts=True)
        order = np.lexsort((label, -counts[label]))  # the largest label's members are not compared with one another, nor any other's
        run, label = run[order], label[order]
        own, first = signatures[run], np.append(0, np.flatnonzero(np.diff(label)) + 1)
        for k, before in zip(range(len(run)), np.repeat(first, np.diff(np.append(first, len(run)))).tolist()):
            if before:
                differ = own[:before] != own[k]
                ok = np.flatnonzero((np.cumsum(differ, axis=1, dtype=np.int16) <= allowed).all(axis=1))
                if len(ok) and segment:
                    ok = ok[~_earlier(differ[ok], segment, allowed)]
                if sets is not None:
                    ok = ok[roots[run[ok]] != roots[run[k]]]
                if len(ok) and sketches is not None:
                    ok = ok[may_be_similar(sketches[run[k]], sketches[run[ok]], similarity)]
                if len(ok) and sets is not None:
                    ok = _linked(run, k, ok, roots, sets, similarity)
                if len(ok):
                    u, v = nodes[run[ok]], nodes[run[k]]
                    held.append((np.minimum(u, v), np.maximum(u, v)))
                    size += len(ok)
                    if size > PAIRS >> 4:
                        yield tuple(np.concatenate(x) for x in zip(*held))
                        held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _linked(run: np.ndarray, k: int, others: np.ndarray, roots: np.ndarray, sets: list[bytes], similarity: float) -> np.ndarray:
    """One of the others for each root to which the member at k has a link; the roots are then one."""
    out, own = [], sets[run[k]]
    for i in others.tolist():
        if roots[run[i]] != roots[run[k]] and jaccard(sets[run[i]], own) >= similarity:
            roots[roots == roots[run[i]]] = roots[run[k]]
            out.append(i)
    return np.array(out, dtype=np.int64)


def _set(text: bytes, width: int) -> bytes:
    return np.unique(shingle_hashes(text, width).astype(np.uint32)).tobytes()


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def near_duplicates(docs: DataFrame, width: int = WORDS, similarity: float = SIMILARITY, segments: int = RING, budget: int = RING_BUDGET) -> DataFrame:
    """(doc_id, digest, component), one row per row of docs. Texts of one digest (MD5) are one node, named by 64 bits of the digest's hash; components are
    of nodes linked by at least `similarity` between shingle sets. Of m different texts m * m / 2**65 pairs share a node's name on average, and so
    a component: one pair in 370 runs with 10**8 texts, 1.4 pairs in one with 7 * 10**9."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = common.with_key(docs).select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    docs = docs.withColumn("digest", F.unhex(F.md5("text")))

    def sign(batch):
        out = []
        for x in batch.column(2):
            hashes = shingle_hashes(x.as_py(), width)
            out.append(ring_signature(hashes, segments).tobytes() + zstandard.compress(sketch(hashes).tobytes(), 1))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "digest", "signature"])

    signed = common.written(common.map_arrow(docs.select("doc_id", "digest", "text"), sign, "doc_id long, digest binary, signature binary"), "signatures")
    ring = common.written(signed.groupBy("digest").agg(F.any_value("signature").alias("both"), F.min("doc_id").alias("doc_id")).select("digest", "doc_id", F.xxhash64("digest").alias("node"), F.col("both").substr(1, 2 * segments).alias("signature"), F.col("both").substr(2 * segments + 1, BINS + 100).alias("sketch")), "distinct")

    def keys(batch):
        s = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, segments).astype(np.int64)
        key = (np.arange(segments) << 32) | (s << 16) | np.roll(s, -1, axis=1)
        nodes = np.repeat(batch.column(0).to_numpy(), segments)
        return pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(nodes)], names=["key", "node"])

    members = common.map_arrow(ring.select("node", "signature"), keys, "key long, node long")
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = members.join(shared, "key").join(ring.select("node", "signature"), "node").select("key", "node", "signature")

    def compare(batches):
        for key, nodes, signatures in _groups(batches):
            s = np.frombuffer(b"".join(signatures.tolist()), dtype=np.uint16).reshape(-1, segments)
            u, v, rest = ring_pairs(nodes, np.roll(s, -int(key >> 32), axis=1), budget)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.nulls(len(u), pa.int64())], names=["u", "v", "key"])
            if len(rest):
                yield pa.RecordBatch.from_arrays([pa.array(rest), pa.nulls(len(rest), pa.int64()), pa.array(np.full(len(rest), key))], names=["u", "v", "key"])

    compared = common.arrow(members.repartition(n, "key").sortWithinPartitions("key"), compare, "u long, v long, key long")
    compared = common.settled(compared.distinct(), "candidates")
    candidates = compared.where("key IS NULL").select("u", "v")
    rest = compared.where("key IS NOT NULL").select("key", F.col("u").alias("node"))
    asked = compared.select(F.col("u").alias("node")).unionByName(candidates.select(F.col("v").alias("node"))).distinct()
    asked = ring.join(asked, "node").select(F.col("digest").alias("_digest"), F.col("doc_id").alias("_doc"), "node")

    def shingle_sets(batch):
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([_set(x, width) for x in batch.column(1).to_pylist()], pa.binary())], names=["node", "shingles"])

    # the text of one row of each digest: its copies share no key and are not looked at. The join is a shuffle at every size: ids grow with the texts
    same = (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    texts = docs.join(asked.hint("shuffle_merge"), same).select("node", "text")
    sets = common.settled(common.map_arrow(texts, shingle_sets, "node long, shingles binary").dropDuplicates(["node"]), "sets")

    def verify(batch):
        u, v, a, b = (c.to_pylist() for c in batch.columns)
        ok = [i for i in range(len(u)) if jaccard(a[i], b[i]) >= similarity]
        return pa.RecordBatch.from_arrays([pa.array([u[i] for i in ok], pa.int64()), pa.array([v[i] for i in ok], pa.int64())], names=["u", "v"])

    def with_sets(pairs, side, other, name):
        """pairs with the set of one side. One that stands in many pairs (a leader) is sent to as many tasks as it takes for MEET pairs each."""
        parts = pairs.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") > MEET).select(side, F.ceil(F.col("n") / MEET).cast("int").alias("parts"))
        dealt = pairs.join(parts, side, "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        own = sets.select(F.col("node").alias(side), F.col("shingles").alias(name)).join(parts, side, "left")
        own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return dealt.join(own, [side, "part"]).drop("part")

    def verified(pairs):
        met = with_sets(with_sets(pairs, "u", "v", "a"), "v", "u", "b")
        return common.map_arrow(met.select("u", "v", "a", "b"), verify, "u long, v long")

    found = components(verified(candidates))

    # what the first links leave apart: every pair within budget that was not compared, unless one component holds it already
    labelled = rest.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    apart = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    labelled = apart_ = common.written(labelled.join(apart, "key"), "apart")
    here = labelled.select("node").distinct()
    member = ring.drop("digest", "doc_id").join(here, "node").join(sets, "node").select("node", F.concat(F.col("signature"), F.unhex(F.lpad(F.hex(F.length("sketch")), 8, "0")), F.col("sketch"), F.col("shingles")).alias("member"))
    labelled = labelled.join(member, "node").select("key", "node", F.concat(F.unhex(F.lpad(F.hex("label"), 16, "0")), "member").alias("member"))

    def compare_rest(batches):
        for key, nodes, held in _groups(batches):
            x, head = held.tolist(), 8 + 2 * segments
            first = np.frombuffer(b"".join(m[:head] for m in x), dtype=np.uint8).reshape(len(x), head)
            cut = [head + 4 + int.from_bytes(m[head : head + 4], "big") for m in x]
            sketches, own = Sketches([m[head + 4 : c] for m, c in zip(x, cut)]), [m[c:] for m, c in zip(x, cut)]
            labels, s = np.ascontiguousarray(first[:, :8]).view(">i8").ravel().astype(np.int64), np.ascontiguousarray(first[:, 8:]).view(np.uint16)
            k = int(key >> 32)
            for u, v in ring_rest(nodes, np.roll(s, -k, axis=1), labels, budget, k, sketches, similarity, own):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    more = common.settled(common.arrow(labelled.repartition(n, "key").sortWithinPartitions("key"), compare_rest, "u long, v long").distinct(), "more")
    if more.limit(1).count():
        found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    by_digest = ring.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    judged = common.written(signed.select("doc_id", "digest").join(by_digest, "digest"), "judged")
    common.drop(signed, ring, compared, sets, more, apart_)
    return judged


def keep_one(docs: DataFrame, width: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, of the document that stands for its component: the smallest doc_id (rows without one come last; of several texts with one
    doc_id that of the smallest digest). Of rows with that doc_id and text, which may differ in other columns, any one is left."""
    judged = near_duplicates(docs, width, similarity)
    rows = judged.groupBy("component", "doc_id", "digest").agg(F.count("*").alias("n"))
    firsts = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("x"))
    rows = common.written(rows.join(firsts, "component").withColumn("first", F.col("doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("digest") == F.col("x.digest"))).drop("x"), "rows")
    common.drop(judged)
    digest = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    gone = common.free_prefix(docs.columns, "_gone_", ["id", "digest"])
    named = lambda part: rows.where(part).select(F.col("doc_id").alias(f"{gone}id"), F.col("digest").alias(f"{gone}digest")).hint("shuffle_merge")
    same = (digest == F.col(f"{gone}digest")) & F.col("doc_id").cast("long").eqNullSafe(F.col(f"{gone}id"))
    if not rows.where("first AND n > 1").limit(1).count():
        return docs.join(named("NOT first"), same, "left_anti")
    kept = docs.join(named("NOT first OR n > 1"), same, "left_anti")
    return kept.unionByName(docs.join(named("first AND n > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return link_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
