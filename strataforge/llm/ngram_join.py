"""N-gram Jaccard join: a size-aware heavy-light set join, and the components of its links.

A text's set is its distinct ``n``-word shingles as 64-bit hashes. Candidates are found by these; how many shingles two candidates
share is counted by a second hash, of other hashes of the words, and whether sets are equal is decided by both. All tokens have one
global order, rare ones first, by the smaller of two counts in a sketch of fixed size (the order decides speed only). Sets that link
share, among the first s - t + k tokens of that order (s the set's size, t the least overlap a partner can have), at least k tokens. So

* small sets enumerate the fixed-size subsets (pairs, k = 2) of that prefix, and meet where a subset is equal;
* large sets post the tokens of their prefix (k = 1) to inverted lists, which are scanned; small sets whose size allows a
  large partner look into the lists too.

The boundary between small and large is the size at which enumerating and scanning together cost least, from the
number of sets of every size and the mean list length that the sketch gives.

Only components are wanted, so a list of m sets need not give all m (m - 1) / 2 pairs. First every set is checked against the
list's first one and one random neighbour; after that, only pairs of sets in one list that are still in
different components are checked, all of them: no link between components is lost, and a list of near copies, however
long, gives pairs in proportion to its length. A list with many members in one slice of the input is tied together
there, and only its first member meets the other slices. Sets of equal texts are one from the start. A pair's sizes
and parity bits (two sets differ in as many tokens as bits at least) rule most others out; large sets have as many bits as tokens
at least, so that few pairs which don't link are left. What is left is verified by the exact overlap of the two sets.

Edge cases: null and empty texts have no shingles and are components of their own; a text of fewer than ``n`` words is one
shingle; rows that share an id are judged each by its own text; a row with a null id has a null component; an empty table gives
an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm import textkit as K
from strataforge.llm.bloom import may_match
from strataforge.llm.components import components
from strataforge.llm.staging import drop, lanes, parts, passing, small_batches, stage

SKETCH_BITS, SKETCH_ROWS = 20, 2
CHUNK = 4096
SLICE_BYTES = 1 << 20
PARITY_BYTES = 128
LOCAL_LIST = 8
LONG_LIST = 4096
#: Signatures and members of open lists that one bucket, which is one task's, has on average at most.
BUCKET_POSTS, BUCKET_MEMBERS = 4_000_000, 100_000


def shingle_sets(s: K.Slice, n: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    return [x for piece in s.pieces() for x, _ in _shingle_sets(piece, n, False)]


def wide_sets(s: K.Slice, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct shingles, and a second hash of each, of other words' hashes: together 128 bits of each."""
    return [x for piece in s.pieces() for x in _shingle_sets(piece, n, True)]


def _shingle_sets(s: K.Slice, n: int, wide: bool) -> list[tuple[np.ndarray, np.ndarray | None]]:
    buf = K.LOWER[s.buf]
    starts, ends, doc = K.spans(s, K.SPACED, buf)
    words = [K.span_hashes(buf, starts, ends, seed) for seed in range(1 + wide)]
    edge = K.bounds(doc, s.n)
    grams = [K.gram_hashes(w, n) for w in words]
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        both = [g[a : b - n + 1] for g in grams] if b - a >= n else [K.gram_hashes(w[a:b], b - a) if b > a else w[:0] for w in words]
        if not wide:
            out.append((np.unique(both[0]), None))
        else:
            tokens, at = np.unique(both[0], return_index=True)
            out.append((tokens, both[1][at]))
    return out


def name_of(tokens: np.ndarray) -> int:
    """A sum over a set, equal for equal sets, as a signed 64-bit number."""
    return int(tokens.sum(dtype=np.uint64).view(np.int64))


def _chunks(array: np.ndarray) -> pa.RecordBatch:
    array = array.astype(np.int32) if array.max(initial=0) < 1 << 31 and array.min(initial=0) >= 0 else array
    some = [i for i in range(0, len(array), CHUNK) if array[i : i + CHUNK].any()]
    return pa.RecordBatch.from_arrays([pa.array([i // CHUNK for i in some], pa.int32()), pa.array([array[i : i + CHUNK].tobytes() for i in some], pa.binary())], names=["chunk", "v"])


def _sum_chunks(df: DataFrame, size: int) -> np.ndarray:
    """The sum over all tasks of arrays of a fixed size, of which each row holds ``CHUNK`` values."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for x in table.column("v").to_pylist():
            total += np.frombuffer(x, np.int64 if len(x) == 8 * CHUNK else np.int32)
        return pa.table({"chunk": table.column("chunk")[:1], "v": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(size, np.int64)
    for r in df.groupBy("chunk").applyInArrow(add, "chunk int, v binary").collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["v"], np.int64)
    return out


def _places(tokens: np.ndarray) -> np.ndarray:
    """Where the sketch counts a token: a place in each of its rows."""
    high = (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    low = (tokens & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)
    return np.stack([high, low + (1 << SKETCH_BITS)])


def parity(tokens: np.ndarray, size: int = PARITY_BYTES) -> bytes:
    """One bit per place: whether an odd number of tokens falls on it. Two sets differ in as many tokens as bits at least."""
    count = np.bincount((tokens & np.uint64(8 * size - 1)).astype(np.int64), minlength=8 * size)
    return np.packbits((count & 1).astype(bool)).tobytes()


def fine_parity(tokens: np.ndarray) -> bytes | None:
    """The same with a bit for each token at least, of sets for which ``PARITY_BYTES`` are fewer."""
    size = 1 << max(len(tokens) - 1, 0).bit_length() >> 3
    return parity(tokens, size) if size > PARITY_BYTES else None


def differing(x: bytes, y: bytes) -> int:
    """In how many bits two parities differ, the longer one folded to the other's length."""
    a, b = sorted((np.frombuffer(z, np.uint64) for z in (x, y)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


class Rule:
    """Two sets link when ``den`` times their overlap is ``num`` times their union or more."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def least(self, size: np.ndarray) -> np.ndarray:
        """The least overlap of a set with any partner."""
        return -(-self.num * size // self.den)

    def prefix(self, size: np.ndarray, k: int) -> np.ndarray:
        return np.minimum(size, size - self.least(size) + k)

    def possible(self, n_a: np.ndarray, n_b: np.ndarray, differ: np.ndarray) -> np.ndarray:
        """Whether sets of these sizes that differ in ``differ`` tokens at least can link."""
        fits = self.den * np.minimum(n_a, n_b) >= self.num * np.maximum(n_a, n_b)
        return fits & (differ * (self.den + self.num) <= (self.den - self.num) * (n_a + n_b))

    def links(self, a: np.ndarray, b: np.ndarray) -> bool:
        if self.den * min(len(a), len(b)) < self.num * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * both >= self.num * (len(a) + len(b) - both)


def boundary(sizes: dict[int, int], scan: float, rule: Rule) -> int:
    """The largest small size: where enumerated subsets plus posted and scanned tokens are fewest."""
    if not sizes:
        return 0
    size = np.array(sorted(sizes), np.int64)
    number = np.array([sizes[int(s)] for s in size], np.float64)
    p2, p1 = rule.prefix(size, 2).astype(float), rule.prefix(size, 1).astype(float)
    enumerate_ = np.r_[0, np.cumsum(number * p2 * (p2 - 1) / 2)]
    scanned = np.r_[0, np.cumsum(number * p1 * (1 + scan))]
    best, cost = 0, np.inf
    for i in range(len(size) + 1):
        small = int(size[i - 1]) if i else 0
        first = np.searchsorted(size, -(-rule.num * (small + 1) // rule.den))
        here = enumerate_[i] + scanned[-1] - scanned[first]
        if here < cost:
            best, cost = small, here
    return best


def posted(sizes: dict[int, int], small: int, rule: Rule) -> int:
    """How many signatures sets of these sizes have."""
    out = 0
    for n, number in sizes.items():
        pair, one = (int(rule.prefix(np.int64(n), k)) for k in (2, 1))
        out += number * ((pair * (pair - 1) // 2 if n <= small else 0) + (one if rule.den * n >= rule.num * (small + 1) else 0))
    return out


def list_length(sketch: np.ndarray, share: float) -> float:
    """The mean length of a list that a prefix looks into: over the rarest ``share`` of all tokens, less what tokens that fall
    on the same count by chance add, 1 at least."""
    count = np.sort(sketch[sketch > 0]).astype(float)
    if not len(count):
        return 1.0
    low = count[: int(np.searchsorted(np.cumsum(count), share * count.sum())) + 1]
    return max(1.0, float((low**2).sum() / low.sum() - low.mean()) + 1)


def signatures(tokens: np.ndarray, rank: np.ndarray, small: int, rule: Rule) -> np.ndarray:
    """What a set meets its partners by."""
    n = len(tokens)
    size = np.int64(n)
    out = []
    if n <= small:
        p = int(rule.prefix(size, 2))
        first = np.sort(tokens[np.lexsort((tokens, rank))[:p]])
        i, j = np.triu_indices(p, 1)
        out.append(K.mix(first[i] * np.uint64(0xD6E8FEB86659FD93) + first[j] + np.uint64(2)))
    if rule.den * n >= rule.num * (small + 1):
        p = int(rule.prefix(size, 1))
        kept = np.argpartition(rank, p - 1)[:p] if p < n else np.arange(n)
        limit = rank[kept].max() if p < n else 0
        if p < n and (rank == limit).sum() > (rank[kept] == limit).sum():  # ties at the edge go by the token itself
            kept = np.lexsort((tokens, rank))[:p]
        out.append(K.mix(tokens[kept]))
    return np.concatenate(out) if out else tokens[:0]


def _partners(sig: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Pairs of each list's members with its first and with the next in a random order of the list's own, so that a long list's members are tied
    in many ways; sorted by (sig, own), without repeats."""
    if not len(sig):
        return np.zeros((0, 2), np.int64)
    first = np.r_[True, sig[1:] != sig[:-1]]
    at = np.flatnonzero(first)
    hub = np.repeat(own[at], np.diff(np.r_[at, len(sig)]))
    near = own[np.lexsort((K.mix(own.view(np.uint64) ^ sig), sig))]
    pairs = np.r_[np.stack([hub, own], 1)[~first], np.stack([near, np.roll(near, 1)], 1)[~first]]
    return np.unique(np.sort(pairs, 1), axis=0)


def jaccard_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """Per row: the id (a whole number), ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    ``key_col``, a whole number that tells rows with one id apart, is handed on if it is named.
    """
    with small_batches(docs.sparkSession), passing() as kept:
        out = _jaccard_components(docs, n, num, den, id_col, text_col, key_col)
        kept.append(out)
        return out


def _jaccard_components(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str, key_col: str | None) -> DataFrame:
    spark = docs.sparkSession
    rule, buckets = Rule(num, den), parts(spark)
    least_size = next(s for s in range(1, 10_000) if den * s >= num * (s + 1))  # no smaller set links with a different one
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"), (F.col(key_col) if key_col else F.lit(None)).cast("bigint").alias("k"))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH_ROWS << SKETCH_BITS, np.int64)
        for batch in batches:
            for s in K.slices(batch.column(1), SLICE_BYTES):
                both = wide_sets(s, n)
                sets = [x for x, _ in both]
                sketch += np.bincount(_places(np.concatenate(sets)).reshape(-1), minlength=len(sketch))
                marks = [(name_of(x), name_of(y)) for x, y in both]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, s.n), batch.column(2).slice(s.first, s.n), pa.array([len(x) for x in sets], pa.int64()), pa.array([a for a, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.int64()), pa.nulls(s.n, pa.int32()), pa.array([parity(x) if len(x) >= least_size else None for x in sets], pa.binary()), pa.array([fine_parity(x) for x in sets], pa.binary())],
                    names=["id", "k", "n", "d", "d2", "chunk", "v", "w"],
                )
        rows = _chunks(sketch)
        none = pa.nulls(rows.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, *rows.columns, pa.nulls(rows.num_rows, pa.binary())], names=["id", "k", "n", "d", "d2", "chunk", "v", "w"])

    surveyed = stage(narrow.mapInArrow(survey, "id bigint, k bigint, n bigint, d bigint, d2 bigint, chunk int, v binary, w binary"), "sets")
    rows = surveyed.where("chunk is null")
    members = rows.select("id", "k", "n", "d", "d2")
    sketch = _sum_chunks(surveyed.where("chunk is not null").select("chunk", "v"), SKETCH_ROWS << SKETCH_BITS)
    classes = stage(members.where(f"n >= {least_size} and id is not null").groupBy("d", "d2", "n").agg(F.min("id").alias("rep")), "classes")
    sizes = {r["n"]: r["c"] for r in classes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    small = boundary(sizes, list_length(sketch[: 1 << SKETCH_BITS], 1 - num / den), rule)
    buckets = max(buckets, -(-posted(sizes, small, rule) // BUCKET_POSTS))
    shared, lane = spark.sparkContext.broadcast(sketch), lanes(spark, buckets)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(0), 2 * SLICE_BYTES):
                sigs, owner = [], []
                for x in shingle_sets(s, n):
                    if len(x) >= least_size:
                        rank = shared.value[_places(x)].min(0)
                        sigs.append(signatures(x, rank, small, rule))
                        owner.append(np.full(len(sigs[-1]), name_of(x)))
                if not sigs:
                    continue
                sig, own = np.concatenate(sigs), np.concatenate(owner)
                order = np.lexsort((own, sig))
                sig, own = sig[order], own[order]
                new = np.r_[True, (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])]
                sig, own = sig[new], own[new]
                first = np.r_[True, sig[1:] != sig[:-1]]
                at = np.flatnonzero(first)
                length = np.diff(np.r_[at, len(sig)])
                long = np.repeat(length > LOCAL_LIST, length)
                if long.any():  # such a list is tied together here, and only its first set goes on
                    pairs = _partners(sig[long], own[long])
                    for x, y, z in ((sig[long].view(np.int64), own[long], None), (None, pairs[:, 0], pairs[:, 1])):
                        to = (K.mix(y.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                        order = np.argsort(to, kind="stable")
                        edge = np.searchsorted(to[order], np.arange(buckets + 1))
                        some = np.flatnonzero(np.diff(edge))
                        cut = [[v[order][edge[k] : edge[k + 1]].tobytes() if v is not None else None for k in some] for v in (x, y, z)]
                        yield pa.RecordBatch.from_arrays([pa.array(lane[some]), pa.nulls(len(some), pa.binary()), *(pa.array(c, pa.binary()) for c in cut)], names=["bucket", "sigs", "tied", "owners", "others"])
                    sig, own = sig[~long | first], own[~long | first]
                bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                edge = np.searchsorted(bucket, np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(edge))
                sent = [pa.array([x[edge[b] : edge[b + 1]].tobytes() for b in some], pa.binary()) for x in (sig, own)]
                none = pa.nulls(len(some), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(lane[some]), sent[0], none, sent[1], none], names=["bucket", "sigs", "tied", "owners", "others"])

    def meet(table: pa.Table) -> pa.Table:
        """Lists of two sets or more: their members, and each member's two partners of the first round."""
        table = table.select(["sigs", "tied", "owners", "others"])
        rows = table.to_pylist()
        plain = [r for r in rows if r["sigs"] is not None]
        tied = [r for r in rows if r["tied"] is not None]
        given = [r for r in rows if r["others"] is not None]
        join = lambda some, k, kind: np.concatenate([np.frombuffer(r[k], kind) for r in some]) if some else np.zeros(0, kind)
        sig, own = join(plain, "sigs", np.uint64), join(plain, "owners", np.int64)
        order = np.lexsort((own, sig))
        sig, own = sig[order], own[order]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])] if len(sig) else np.zeros(0, bool)
        sig, own = sig[new], own[new]
        first = np.r_[True, sig[1:] != sig[:-1]] if len(sig) else np.zeros(0, bool)
        length = np.diff(np.r_[np.flatnonzero(first), len(sig)])
        keep = np.repeat(length > 1, length)
        sig, own = sig[keep], own[keep]
        pairs = _partners(sig, own)
        lists = np.r_[sig.view(np.int64), join(tied, "tied", np.int64)], np.r_[own, join(tied, "owners", np.int64)]
        pairs = np.r_[pairs, np.stack([join(given, "owners", np.int64), join(given, "others", np.int64)], 1)]
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
        k, m = len(lists[0]), len(pairs)
        K.trim()
        return pa.table({"sig": pa.array(np.r_[lists[0], np.zeros(m, np.int64)], mask=np.r_[np.zeros(k, bool), np.ones(m, bool)]), "a": np.r_[lists[1], pairs[:, 0]], "b": np.r_[lists[1], pairs[:, 1]]})

    met = stage(narrow.where("id is not null").select("t").mapInArrow(post, "bucket int, sigs binary, tied binary, owners binary, others binary").groupBy("bucket").applyInArrow(meet, "sig bigint, a bigint, b bigint"), "lists")
    lists = met.where("sig is not null").select("sig", F.col("a").alias("d"))
    pairs = met.where("sig is null").select("a", "b").distinct()

    marks = stage(rows.where(f"n >= {least_size} and id is not null").groupBy("d").agg(F.min("n").alias("n"), F.min("v").alias("v")).join(lists.select("d").distinct(), "d", "left_semi"), "marks")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose sizes and parities allow a link."""
        for batch in batches:
            n_a, n_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            bits = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, PARITY_BYTES // 8) for i in (4, 5)]
            ok = pa.array(rule.possible(n_a, n_b, np.bitwise_count(bits[0] ^ bits[1]).sum(1).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in batch.columns[:2]], names=["a", "b"])

    def hopeful(pairs: DataFrame, name: str) -> DataFrame:
        pairs = stage(pairs, name)
        one = pairs.join(marks.select(F.col("d").alias("a"), F.col("n").alias("na"), F.col("v").alias("va")), "a")
        two = one.join(marks.select(F.col("d").alias("b"), F.col("n").alias("nb"), F.col("v").alias("vb")), "b")
        return stage(two.select("a", "b", "na", "nb", "va", "vb").mapInArrow(differ, "a bigint, b bigint"), name + "-hopeful")

    def finely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose sizes and fine parities, where both have some, allow a link."""
        for batch in batches:
            a, b, n_a, n_b, w_a, w_b = (c.to_pylist() for c in batch.columns)
            ok = [x is None or y is None or bool(rule.possible(np.int64(i), np.int64(j), np.int64(differing(x, y)))) for i, j, x, y in zip(n_a, n_b, w_a, w_b, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    def finer(pairs: DataFrame, name: str) -> DataFrame:
        """``pairs``: staged."""
        ends = pairs.select(F.col("a").alias("d")).unionByName(pairs.select(F.col("b").alias("d"))).distinct()
        fine = stage(rows.where("w is not null and id is not null").select("d", "n", "w").join(ends, "d", "left_semi").groupBy("d").agg(F.min("n").alias("n"), F.min("w").alias("w")), name + "-fine")
        one = pairs.join(fine.select(F.col("d").alias("a"), F.col("n").alias("na"), F.col("w").alias("wa")), "a", "left")
        two = one.join(fine.select(F.col("d").alias("b"), F.col("n").alias("nb"), F.col("w").alias("wb")), "b", "left")
        return stage(two.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(finely, "a bigint, b bigint"), name + "-fine-hopeful")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(0), SLICE_BYTES):
                sets = [(x, y) for x, y in wide_sets(s, n) if len(x) >= least_size]
                yield pa.RecordBatch.from_arrays([pa.array([name_of(x) for x, _ in sets], pa.int64()), pa.array([y.tobytes() for _, y in sets], pa.binary())], names=["d", "tokens"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                ok = [rule.links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in part.columns[:2]], names=["a", "b"])

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """``pairs``: staged. The sets of one document of each class are read again, then the overlap is counted."""
        ends = pairs.select(F.col("a").alias("d")).unionByName(pairs.select(F.col("b").alias("d"))).distinct()
        wanted = stage(classes.join(ends, "d", "left_semi").select(F.col("rep").alias("id")), name + "-wanted")
        sets = stage(may_match(narrow.where("id is not null").select("id", "t"), wanted).join(wanted, "id", "left_semi").select("t").mapInArrow(gather, "d bigint, tokens binary"), name + "-tokens")
        one = pairs.join(sets.select(F.col("d").alias("a"), F.col("tokens").alias("ta")), "a")
        two = one.join(sets.select(F.col("d").alias("b"), F.col("tokens").alias("tb")), "b")
        out = stage(two.select("a", "b", "ta", "tb").mapInArrow(verify, "a bigint, b bigint"), name + "-links")
        drop(sets)
        return out

    def cross(table: pa.Table) -> pa.Table:
        """Pairs of a bucket's lists that are in different components and whose sizes and parities allow a link."""
        sig, d, c, n = (table.column(k).to_numpy() for k in ("sig", "d", "c", "n"))
        bits = np.frombuffer(b"".join(table.column("v").to_pylist()), np.uint64).reshape(-1, PARITY_BYTES // 8)
        order = np.argsort(sig, kind="stable")
        edge = np.flatnonzero(np.r_[True, np.diff(sig[order]) != 0, True])
        found = [np.zeros((0, 2), np.int64)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            at = order[a:b]
            for i in range(len(at) - 1):
                rest, me = at[i + 1 :], at[i]
                rest = rest[(c[rest] != c[me]) & (den * np.minimum(n[rest], n[me]) >= num * np.maximum(n[rest], n[me]))]
                if len(rest):
                    rest = rest[rule.possible(n[rest], n[me], np.bitwise_count(bits[rest] ^ bits[me]).sum(1).astype(np.int64))]
                if len(rest):
                    found.append(np.sort(np.stack([np.full(len(rest), d[me]), d[rest]], 1), 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        K.trim()
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (d, sig, c, n, v) with the parity bits as whole numbers."""
        for batch in batches:
            by = dict(zip(batch.schema.names, batch.columns, strict=True))
            bits = np.frombuffer(b"".join(by["v"].to_pylist()), np.int64).reshape(-1, PARITY_BYTES // 8)
            yield pa.RecordBatch.from_arrays([by["sig"], by["d"], by["c"], by["n"], *(pa.array(np.ascontiguousarray(x)) for x in bits.T)], names=["sig", "d", "c", "n", *(f"v{i}" for i in range(PARITY_BYTES // 8))])

    def merged(found: DataFrame, links: DataFrame) -> DataFrame:
        """``found`` (node, component) after further links: a graph of the components that they join only."""
        ends = found.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        across = links.join(ends, F.col("a") == F.col("_n"), "left").select(F.coalesce("_c", "a").alias("a"), "b")
        across = across.join(ends, F.col("b") == F.col("_n"), "left").select("a", F.coalesce("_c", "b").alias("b"))
        more = components(across)
        renamed = found.join(more.select(F.col("node").alias("component"), F.col("component").alias("_c")), "component", "left").select("node", F.coalesce("_c", "component").alias("component"))
        return stage(renamed.unionByName(more.join(found, "node", "left_anti")), "components")

    # Sets are read and compared for one pair of each set first, the one with its least partner; then for what is still apart.
    likely = finer(hopeful(pairs, "pairs"), "pairs")
    least = likely.unionByName(likely.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"))
    chosen = stage(least.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "chosen")
    found = components(linked(chosen, "chosen"))
    for x, y in (("a", "ca"), ("b", "cb")):
        likely = likely.join(found.select(F.col("node").alias(x), F.col("component").alias(y)), x, "left").withColumn(y, F.coalesce(y, x))
    apart = stage(likely.where("ca != cb").select("a", "b").join(chosen, ["a", "b"], "left_anti"), "apart")
    if apart.limit(1).count():
        found = merged(found, linked(apart, "apart"))
    # Members of lists with more than one component, and their pairs across components.
    named = stage(lists.join(found.select(F.col("node").alias("d"), "component"), "d", "left").select("sig", "d", F.coalesce("component", "d").alias("c")), "named")
    mixed = stage(named.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("sig", "m"), "mixed")
    open_ = stage(named.join(mixed.where(F.col("m") <= LONG_LIST), "sig", "left_semi").join(marks, "d"), "open")
    groups = max(parts(spark), -(-open_.count() // BUCKET_MEMBERS))
    crossing = open_.groupBy(F.pmod(F.xxhash64("sig"), F.lit(groups)).alias("bucket")).applyInArrow(cross, "a bigint, b bigint")
    # Lists too long for one task: the pairs come from a join that Spark can split. Sizes and parity bits are looked at inside
    # the join, so that only what can link is shuffled.
    long = stage(named.join(mixed.where(F.col("m") > LONG_LIST), "sig", "left_semi").join(marks, "d").mapInArrow(opened, f"sig bigint, d bigint, c bigint, n bigint, {', '.join(f'v{i} bigint' for i in range(PARITY_BYTES // 8))}"), "long")
    left, right = (long.select(*(F.col(c).alias(x + c) for c in long.columns)) for x in "lr")
    apart_bits = sum((F.bit_count(F.col(f"lv{i}").bitwiseXOR(F.col(f"rv{i}"))) for i in range(PARITY_BYTES // 8)), F.lit(0))
    fits = (F.col("lc") < F.col("rc")) & (den * F.least("ln", "rn") >= num * F.greatest("ln", "rn")) & (apart_bits * (den + num) <= (den - num) * (F.col("ln") + F.col("rn")))
    crossing_long = left.join(right, (F.col("lsig") == F.col("rsig")) & fits).select(F.least("ld", "rd").alias("a"), F.greatest("ld", "rd").alias("b"))
    second = linked(finer(stage(crossing.unionByName(crossing_long).distinct(), "crossing"), "crossing"), "crossing")
    if second.limit(1).count():  # links between components of the first round: a graph of those components only
        found = merged(found, second)
    # A component's name is so far its smallest digest; the smallest id takes its place.
    by_class = classes.join(found.select(F.col("node").alias("d"), "component"), "d", "left").withColumn("component", F.coalesce("component", "d"))
    by_class = stage(by_class.select("d", "d2", "n", "rep", F.col("component").alias("c")), "named-classes")
    lowest = stage(by_class.groupBy("c").agg(F.min("rep").alias("component_id")), "lowest")
    final = stage(by_class.join(lowest, "c").select("d", "d2", "n", "component_id"), "final")
    # Sets too small to link with a different one still are one with their copies.
    tiny = stage(members.where(f"n > 0 and n < {least_size} and id is not null").groupBy("d", "d2", "n").agg(F.min("id").alias("component_id")), "tiny")
    joined = members.where("n > 0 and id is not null").join(final.unionByName(tiny), ["d", "d2", "n"], "left").select("id", "k", "n", "component_id")
    alone = members.where("n = 0 or id is null").select("id", "k", "n", F.col("id").alias("component_id"))
    kept = [F.col("k").alias(key_col)] if key_col else []
    return joined.unionByName(alone).select(F.col("id").alias(id_col), *kept, F.col("n").alias("n_shingles"), "component_id")
