"""N-gram Jaccard join by PartEnum signatures.

The sets are distinct five-word shingles.  Sizes fall into bands whose ends
are a factor 1/threshold apart; two sets that link lie in one band or in
neighbouring ones, so each set is signed for its own band and for the next.
Inside a band the shingle domain is cut into ``n`` hash ranges.  Sets that
differ in at most k shingles spoil at most k ranges, so among the first k + 1
ranges that hold anything (in one fixed order) both sets have one range with
the very same content: the hash of that content is their shared signature.
Subsets of ranges are enumerated at size one first.  Where a signature's group
stays too large, its members are signed with subsets of two, three and four
ranges that extend it: two linking sets share at least s ranges among the first
k + s, so they share a subset of every size, and the enumeration goes on only
below signatures that common passages have made unselective.
The fixed order puts ranges that hold more shingles first, which keeps common
passages from pairing texts that share nothing else.  A band has the fewest
ranges for which those that hold something outnumber k by 7.5 standard
deviations; where no number does (small bands), every shingle has a range of
its own, and the guarantee is strict.

Signatures travel packed (12 bytes each) and are grouped by sorting.  In each
group of equal signatures the member whose signatures occur most is compared
with all others.  Of the groups that this leaves in several components, those
of up to ``REFINE`` members are compared in blocks, a member being copied once
for each block; where that would be more copies than there are subsets, the
group is refined by larger subsets (and compared in blocks only if it is still
as large at the last level).  Sizes and parity bitmaps, which cannot discard a true link, thin out
the pairs, and every link is verified on the exact sets.  Equal sets are one
node throughout.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from treeloom.llm._bytes import SPACE, Words, mix, shingle_sets, text_slices
from treeloom.llm._components import components
from treeloom.llm._store import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIGS_PER_PARTITION = 1_000_000
BUCKETS = 8  # of a partition; one is held at a time
FLUSH = 400_000  # signatures that a task packs at once
GROUPED = 500_000  # signatures that are grouped at once
PAIRS = 50_000  # pairs that a task holds
BLOCK = 1024
REFINE = 32_768  # members from which on larger subsets cost less than blocks
LEVELS = 4  # largest subsets of ranges
MAP_BITS = 1 << 16  # of the largest bitmap
BROADCAST_IDS = 1_000_000


def bands(limit: int, num: int, den: int) -> list[tuple[int, int]]:
    out, low = [], 1
    while low <= limit:
        high = max(low, low * den // num)
        out.append((low, high))
        low = high + 1
    return out


class Scheme:
    """Bands, ranges and distance bounds of threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.bands = bands(1 << 40, num, den)
        self.lows = np.array([b[0] for b in self.bands])
        self.plans: dict[int, list] = {}

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.lows, size, "right")) - 1

    def ranges(self, band: int) -> int:
        """0: each shingle has its own."""
        low, high = self.bands[band]
        for share in (0.34, 0.36, 0.38, 0.4, 0.43, 0.46, 0.5, 0.55, 0.6, 0.7, 0.8, 1.0):
            n, fits = math.ceil(share * high), True
            for size in {high, (low + high) // 2, low, (low * self.num // self.den + low) // 2, low * self.num // self.den}:
                k, empty = self.distance(size, min(high, size * self.den // self.num)), math.exp(-size / n)
                spread = math.sqrt(max(n * empty * (1 - (1 + size / n) * empty), 0.01))
                fits &= n * (1 - empty) - 7.5 * spread >= k + 1
            if fits:
                return n
        return 0

    def distance(self, size: int, other: int) -> int:
        """Most shingles in which two linking sets of these sizes can differ."""
        num, den = self.num, self.den
        return (den - num) * (size + other) // (den + num)

    def tokens(self, own: np.ndarray, spread: np.ndarray, high: np.ndarray, take: int, n: int, salt: np.uint64) -> np.ndarray:
        """The first ``take`` ranges that hold anything, as sums of content."""
        if n == 0:
            return spread[:take] ^ salt
        part = (high * np.uint64(n)) >> np.uint64(32)
        at = np.flatnonzero(part[1:] != part[:-1])
        ends = np.empty(len(at) + 2, np.int64)
        ends[0], ends[1:-1], ends[-1] = 0, at + 1, len(own)
        # fuller ranges first, then in the domain's order
        order = np.argsort(ends[:-1] - ends[1:], kind="stable")[:take]
        return np.add.reduceat(spread, ends[:-1])[order] ^ salt

    def plan(self, size: int) -> list[tuple[int, int, np.uint64]]:
        """(signatures to take, ranges, salt) of each band of a set."""
        if size in self.plans:
            return self.plans[size]
        out, own = [], self.band(size)
        for band in (own, own + 1):
            partner = size * self.den // self.num
            if band == own:
                partner = min(partner, self.bands[own][1])
            elif partner < self.bands[band][0]:
                continue
            salt = np.uint64((0xD1B54A32D192ED03 * (band + 1)) & (2**64 - 1))
            out.append((self.distance(size, partner) + 1, self.ranges(band), salt))
        self.plans[size] = out
        return out

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of non-empty sorted sets, and how many each has."""
        joined, sizes = np.concatenate(sets), [len(s) for s in sets]
        spread, high = mix(joined ^ np.uint64(0x5851F42D4C957F2D)), joined >> np.uint64(32)
        out, counts, a = [], np.zeros(len(sets), np.int64), 0
        for i, size in enumerate(sizes):
            b = a + size
            for take, n, salt in self.plan(size):
                out.append(self.tokens(joined[a:b], spread[a:b], high[a:b], take, n, salt))
                counts[i] += len(out[-1])
            a = b
        return mix(np.concatenate(out)), counts

    def extended(self, own: np.ndarray, held: list[tuple[int, list[int]]], level: int) -> list[tuple[int, list[int]]]:
        """Signatures of the subsets of ``level`` ranges that extend the held
        ones (signature, places of its ranges) of one set by any other range.
        On level 2 the place of the one range is looked up; there a packed
        signature holds the lower 32 bits of the range's own."""
        spread, high = mix(own ^ np.uint64(0x5851F42D4C957F2D)), own >> np.uint64(32)
        lists, out = [mix(self.tokens(own, spread, high, take + level - 1, n, salt)) for take, n, salt in self.plan(len(own))], {}
        for gid, at in held:
            low = np.uint32(gid & 0xFFFFFFFF)
            # a place is the list's number in bit 30 and the place in the list
            starts = [at] if at else [[k << 30 | p] for k, x in enumerate(lists) for p in np.flatnonzero(x.astype(np.uint32) == low).tolist()]
            for places in starts:
                band = places[0] >> 30
                tokens, mine = lists[band], [p & 0x3FFFFFFF for p in places]
                every = np.setdiff1d(np.arange(len(tokens)), mine)
                sums = mix(tokens[every] + tokens[mine].sum(dtype=np.uint64) + np.uint64(level))
                out.update((s, sorted([*places, band << 30 | p])) for s, p in zip(sums.astype(np.int64).tolist(), every.tolist(), strict=True))
        return list(out.items())


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit value of each non-empty set."""
    sizes = np.array([len(s) for s in sets])
    sums = np.add.reduceat(mix(np.concatenate(sets) ^ np.uint64(0xA0761D6478BD642F)), np.cumsum(sizes) - sizes)
    return mix(sums + sizes.astype(np.uint64)).astype(np.int64)


def _sets(column):
    """(rows, shingle sets) of the texts of an Arrow column that have any."""
    for row, buf, offsets in text_slices(column):
        sets = shingle_sets(Words(buf, offsets, SPACE, True))
        rows = [i for i, s in enumerate(sets) if len(s)]
        if rows:
            yield np.array(rows) + row, [sets[i] for i in rows]


def _bitmaps(sets: list[np.ndarray]) -> list[bytes]:
    """Parity bitmaps of two to four bits a shingle, a power of two up to
    ``MAP_BITS``: two maps
    differ in at most as many bits as their sets differ in shingles, also when
    the longer one is folded onto the shorter."""
    out = []
    for s in sets:
        bits = min(MAP_BITS, 1 << max(9, (2 * len(s) - 1).bit_length()))
        odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(bool)).tobytes())
    return out


def fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    while len(bitmap) > words:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def _prints(batches):
    """(doc_id, text) -> (doc_id, n_shingles, fp, bitmap); the last two are
    null where there is no shingle."""
    for batch in batches:
        n, fp = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        maps: list[bytes | None] = [None] * batch.num_rows
        for rows, sets in _sets(batch.column(1)):
            n[rows] = [len(s) for s in sets]
            fp[rows] = fingerprints(sets)
            for row, x in zip(rows.tolist(), _bitmaps(sets), strict=True):
                maps[row] = x
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(fp, mask=n == 0), pa.array(maps, pa.binary())], ["doc_id", "n_shingles", "fp", "bitmap"])


def _emit(scheme: Scheme, buckets: int):
    def run(batches):
        sigs, fps, n, seen = [], [], 0, set()

        def flush():
            sig, fp = np.concatenate(sigs), np.concatenate(fps)
            order = np.argsort(sig)
            sig, fp = sig[order], fp[order]
            bucket = ((sig >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            at = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(sig)]])
            low = sig.astype(np.uint32)  # with the bucket, over 40 bits of the signature
            for a, b in zip(range(0, len(at) - 1, 256), [*range(256, len(at) - 1, 256), len(at) - 1], strict=True):
                span = at[a : b + 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[span[:-1]].astype(np.int32)), pa.array([low[x:y].tobytes() for x, y in zip(span[:-1], span[1:], strict=True)], pa.binary()), pa.array([fp[x:y].tobytes() for x, y in zip(span[:-1], span[1:], strict=True)], pa.binary())],
                    ["bucket", "sigs", "fps"],
                )

        for batch in batches:
            for _, sets in _sets(batch.column(0)):
                new = {}
                for i, fp in enumerate(fingerprints(sets).tolist()):
                    if fp not in seen:
                        new.setdefault(fp, i)
                if not new:
                    continue
                seen.update(new)
                own, counts = scheme.signatures([sets[i] for i in new.values()])
                sigs.append(own)
                fps.append(np.repeat(np.array(list(new), np.int64), counts))
                n += len(own)
                if n >= FLUSH:
                    yield from flush()
                    sigs, fps, n, seen = [], [], 0, set()
        if n:
            yield from flush()

    return run


def _group(limit: int):
    """Packed signatures sorted by bucket -> (gid, fp, m, again) of every
    signature that m > 1 nodes share.  One bucket is held at a time; past
    ``limit`` records of one, only one record of each signature is carried on,
    so memory stays bounded however large a group is; rows of a bucket that
    comes to this are marked ``again``, as they may repeat."""

    def run(batches):
        none = np.zeros(0, np.int64)
        held, n, cut, now, carry = [], 0, False, None, (none, none)

        def flush(again):
            sig = np.concatenate([carry[0], *[x[0] for x in held]])
            fp = np.concatenate([carry[1], *[x[1] for x in held]])
            order = np.lexsort((fp, sig))
            sig, fp = sig[order], fp[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])
            sig, fp = sig[new], fp[new]
            first = np.ones(len(sig), bool)
            first[1:] = sig[1:] != sig[:-1]
            alone = first.copy()
            alone[:-1] &= first[1:]
            sizes = np.diff(np.append(np.flatnonzero(first), len(sig)))
            m = np.repeat(sizes, sizes).astype(np.int32)[~alone]
            out = pa.RecordBatch.from_arrays([pa.array(sig[~alone]), pa.array(fp[~alone]), pa.array(m), pa.array(np.full(len(m), again))], ["gid", "fp", "m", "again"])
            return out, (sig[first], fp[first])

        for batch in batches:
            for b, s, f in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if b != now:
                    if n:
                        yield flush(cut)[0]
                    held, n, cut, now, carry = [], 0, False, b, (none, none)
                low = np.frombuffer(s.as_buffer(), np.uint32)
                # copies, so that the batch's own memory is given back
                held.append(((np.int64(b) << np.int64(32)) | low.astype(np.int64), np.frombuffer(f.as_buffer(), np.int64).copy()))
                n += len(low)
                if n >= limit:
                    out, carry = flush(True)
                    held, n, cut = [], 0, True
                    yield out
        if n:
            yield flush(cut)[0]

    return run


def _extend(scheme: Scheme, level: int):
    """(fp, text, held) with held an array of (gid, places) -> one row (gid,
    fp, places) a subset of ``level`` ranges that extends a held one."""

    def run(batches):
        schema = pa.schema([("gid", pa.int64()), ("fp", pa.int64()), ("places", pa.list_(pa.int32()))])
        for batch in batches:
            want, groups = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for rows, sets in _sets(batch.column(1)):
                out = []
                for row, own, same in zip(rows.tolist(), sets, fingerprints(sets) == want[rows], strict=True):
                    if not same:
                        continue
                    held = [(x["gid"], x["places"]) for x in groups[row].as_py()]
                    out += [{"gid": g, "fp": int(want[row]), "places": p} for g, p in scheme.extended(own, held, level)]
                    if len(out) >= PAIRS:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _shingles(batches):
    """(fp, text) -> (fp, shingles as packed sorted integers)."""
    for batch in batches:
        rows, sets = [], []
        want = batch.column(0).to_numpy(zero_copy_only=False)
        for some, found in _sets(batch.column(1)):
            same = fingerprints(found) == want[some]
            rows.extend(some[same].tolist())
            sets.extend(s.tobytes() for s, x in zip(found, same, strict=True) if x)
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(sets, pa.binary())], ["fp", "shingles"])


def _printed(batches):
    """(doc_id, text) -> (fp, text) of the texts that have a shingle."""
    for batch in batches:
        fps, at = [], []
        for rows, sets in _sets(batch.column(1)):
            fps.append(fingerprints(sets))
            at.append(rows)
        if fps:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fps)), batch.column(1).take(pa.array(np.concatenate(at)))], ["fp", "text"])


def _marked(text_at: int):
    """Rows -> the same rows with their sets' fingerprints."""

    def run(batches):
        for batch in batches:
            fp, has = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for rows, sets in _sets(batch.column(text_at).cast(pa.string())):
                fp[rows], has[rows] = fingerprints(sets), True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp, mask=~has)], [*batch.schema.names, "__fp"])

    return run


def _verify(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(a) * den < len(b) * num or len(b) * den < len(a) * num:
                    continue
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = den * inter >= num * (len(a) + len(b) - inter)
            where = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where)], ["u", "v"])

    return run


def _possible(num: int, den: int):
    """(a, b, na, nb, ma, mb) -> the pairs that sizes and bitmaps leave."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            keep = np.minimum(na, nb) * den >= np.maximum(na, nb) * num
            for i in np.flatnonzero(keep).tolist():
                a, b = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (4, 5))
                words = min(len(a), len(b))
                far = int(np.bitwise_count(fold(a, words) ^ fold(b, words)).sum())
                keep[i] = far * (den + num) <= (den - num) * (int(na[i]) + int(nb[i]))
            where = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where)], ["a", "b"])

    return run


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _cells(num: int, den: int, buckets: int):
    """Sorted (gid, i, j, block, fp, label, n, bitmap) -> pairs of different
    labels that size and bitmap leave possible, packed by bucket: the same pair
    comes from many groups, and travels as 16 bytes."""

    def pairs(rows):
        block, fp, label, n, maps = (np.concatenate([r[k] for r in rows]) if k < 4 else [m for r in rows for m in r[k]] for k in range(5))
        maps = [np.frombuffer(m, np.uint64) for m in maps]
        words = min(len(m) for m in maps)  # members of a group are of like size
        maps = np.stack([fold(m, words) for m in maps])
        i, j = int(block.min()), int(block.max())
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for a in left:
            b = right if i != j else right[right > a]
            b = b[label[b] != label[a]]
            b = b[(np.minimum(n[b], n[a]) * den >= np.maximum(n[b], n[a]) * num)]
            if len(b):
                far = np.bitwise_count(maps[b] ^ maps[a]).sum(1)
                b = b[far * (den + num) <= (den - num) * (n[b] + n[a])]
            if len(b):
                yield np.minimum(fp[a], fp[b]), np.maximum(fp[a], fp[b])

    def packed(found):
        a, b = _distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))
        bucket = a % buckets
        order = np.argsort(bucket, kind="stable")
        both, bucket = np.stack([a[order], b[order]], 1), bucket[order]
        at = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(both)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]].astype(np.int32)), pa.array([both[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["bucket", "pairs"])

    def run(batches):
        rows, key, found, n = [], None, [], 0
        for batch in batches:
            gid, i, j = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            ends = np.flatnonzero((gid[1:] != gid[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(gid)], strict=True):
                if a == b:
                    continue
                if key != (gid[a], i[a], j[a]) and rows:
                    for x, y in pairs(rows):
                        found.append((x, y))
                        n += len(x)
                        if n > PAIRS:
                            yield packed(found)
                            found, n = [], 0
                    rows = []
                key = (gid[a], i[a], j[a])
                part = batch.slice(a, b - a)
                rows.append((*(part.column(k).to_numpy(zero_copy_only=False).copy() for k in (3, 4, 5, 6)), part.column(7).to_pylist()))
        if rows:
            found.extend(pairs(rows))
        if found:
            yield packed(found)

    return run


def _unpack(batches):
    """Packed pairs of a bucket -> distinct (a, b) within bounded runs."""
    held, n = [], 0

    def distinct():
        both = np.concatenate(held)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _distinct(both[:, 0], both[:, 1])], ["a", "b"])

    for batch in batches:
        for x in batch.column(1):
            held.append(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2).copy())
            n += len(held[-1])
            if n > 4 * PAIRS:
                yield distinct()
                held, n = [], 0
    if n:
        yield distinct()


def _hubs(members: DataFrame, degree: DataFrame) -> DataFrame:
    """Each group's hub, the member whose signatures occur most (the original,
    where copies are edited apart from each other), paired with all others."""
    hubs = members.join(degree, "fp").groupBy("gid").agg(F.max(F.struct("d", "fp"))["fp"].alias("hub"))
    return members.join(hubs, "gid").where("fp <> hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()


def _classes(docs: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``docs``: (doc_id, text).  Gives (doc_id, n_shingles, fp), one row an
    input row, and (fp, root, component_id, n_verified), one row a set."""
    spark = docs.sparkSession
    scratch, scheme = Scratch(spark, "jaccard"), Scheme(num, den)
    prints = scratch.put(docs.mapInArrow(_prints, "doc_id bigint, n_shingles bigint, fp bigint, bitmap binary"))
    total = prints.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(0.65 * total / SIGS_PER_PARTITION))
    packed = docs.select("text").mapInArrow(_emit(scheme, BUCKETS * parts), "bucket int, sigs binary, fps binary")
    grouped = scratch.put(packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_group(GROUPED), "gid bigint, fp bigint, m int, again boolean"))
    # a signature lies in one bucket, so only rows marked ``again`` repeat
    once = scratch.put(grouped.where("again").groupBy("gid", "fp").agg(F.max("m").alias("m")))
    members = grouped.where("not again").select("gid", "fp", "m").unionAll(once)
    degree = scratch.put(members.groupBy("fp").agg(F.sum("m").alias("d")))
    # every set that shares a signature, with an id that has it, if any has
    held = prints.join(degree.select("fp"), "fp", "left_semi")
    nodes = scratch.put(held.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bitmap").alias("bitmap")))

    def texts_of(own: DataFrame) -> DataFrame:
        """(fp, text) of the sets in ``own`` (fp); of rows that share an id or
        have none, others come along and are told apart by their set."""
        reps = scratch.put(nodes.join(own, "fp", "left_semi").select("fp", "doc_id"))
        few = reps.count() <= BROADCAST_IDS
        known = reps.where("doc_id is not null")
        texts = docs.join(F.broadcast(known) if few else known, "doc_id").select("fp", "text")
        bare = reps.where("doc_id is null").select("fp")
        if not bare.isEmpty():
            rest = docs.where("doc_id is null").mapInArrow(_printed, "fp bigint, text string")
            texts = texts.unionAll(rest.join(F.broadcast(bare) if few else bare, "fp").select("fp", "text"))
        return texts

    def thin(p: DataFrame) -> DataFrame:
        a = nodes.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ma"))
        b = nodes.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("mb"))
        return p.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ma", "mb").mapInArrow(_possible(num, den), "a bigint, b bigint")

    def verify(p: DataFrame) -> DataFrame:
        """The pairs that link by their exact sets, which are made anew from
        the texts of the documents that occur in a pair."""
        own = p.select(F.col("a").alias("fp")).unionAll(p.select("b")).distinct()
        sets = scratch.put(texts_of(own).mapInArrow(_shingles, "fp bigint, shingles binary").dropDuplicates(["fp"]))
        a = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb"))
        joined = p.join(a, "a").join(b, "b").select("a", "b", "sa", "sb")
        return scratch.put(joined.mapInArrow(_verify(num, den), "u bigint, v bigint"))

    pairs = scratch.put(_hubs(members, degree))
    done, links = pairs, verify(scratch.put(thin(pairs)))
    label = scratch.put(components(links, scratch))

    def split(groups: DataFrame) -> DataFrame:
        """The groups that lie in several components, of groups with the very
        same members only one: rows are distinct, so their number and 96 bits
        of sums tell groups apart.  (gid, fp, places, label, m)"""
        tagged = groups.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("gid", "fp", "places", F.coalesce("root", "fp").alias("label"))
        first, second = F.xxhash64("fp"), F.xxhash64("fp", F.lit(1))
        who = [F.sum(h).alias(f"who{k}") for k, h in enumerate((F.shiftrightunsigned(first, 32), first.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(second, 32)))]
        found = tagged.groupBy("gid").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m"), *who).where("x <> y and m > 2")
        found = found.groupBy("m", "who0", "who1", "who2").agg(F.min("gid").alias("gid")).select("gid", "m")
        return scratch.put(tagged.join(found, "gid"))

    # groups that the hubs leave in several parts: small ones wait for their
    # pairs, large ones are refined by larger subsets of ranges
    left = split(members.select("gid", "fp", F.array().cast("array<int>").alias("places")))
    waiting = [left.where(F.col("m") <= REFINE)]
    for level in range(2, LEVELS + 1):
        large = left.where(F.col("m") > REFINE)
        if large.isEmpty():
            break
        # a member's groups travel with its text, in runs of bounded length
        held = large.withColumn("run", F.pmod(F.xxhash64("gid"), F.lit(16))).groupBy("fp", "run").agg(F.collect_list(F.struct("gid", "places")).alias("held"))
        held = scratch.put(held.select("fp", "held"))
        texts = texts_of(held.select("fp").distinct()).join(held, "fp").select("fp", "text", "held")
        finer = scratch.put(texts.mapInArrow(_extend(scheme, level), "gid bigint, fp bigint, places array<int>").dropDuplicates(["gid", "fp"]))
        shared = finer.groupBy("gid").agg(F.count("*").alias("m")).where("m > 1")
        finer = scratch.put(finer.join(shared, "gid").select("gid", "fp", "places"))
        more = scratch.put(_hubs(finer, degree).join(done, ["a", "b"], "left_anti"))
        links = links.unionAll(verify(scratch.put(thin(more))))
        done, label = done.unionAll(more), scratch.put(components(links, scratch))
        left = split(finer)
        waiting.append(left.where(F.col("m") <= REFINE))
    else:
        waiting.append(left.where(F.col("m") > REFINE))
    todo = waiting[0]
    for x in waiting[1:]:
        todo = todo.unionAll(x)
    # labels may have changed since a group was set aside
    todo = todo.select("gid", "fp", "m").join(label.withColumnRenamed("node", "fp"), "fp", "left").select("gid", "fp", F.coalesce("root", "fp").alias("label"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    if not todo.isEmpty():
        dealt = todo.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("gid", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "label")
        maps = nodes.select("fp", "n", "bitmap")
        dealt = dealt.join(maps, "fp").select("gid", "i", "j", "block", "fp", "label", "n", "bitmap").repartition(parts, "gid", "i", "j").sortWithinPartitions("gid", "i", "j")
        packs = dealt.mapInArrow(_cells(num, den, 4 * parts), "bucket int, pairs binary").repartition(parts, "bucket")
        rest = packs.mapInArrow(_unpack, "a bigint, b bigint").distinct().join(done, ["a", "b"], "left_anti")
        links = links.unionAll(verify(scratch.put(rest)))
        label = scratch.put(components(links, scratch))
    # smallest id of each component
    count = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy(F.col("u").alias("fp")).agg(F.count("*").alias("n_verified"))
    placed = prints.groupBy("fp").agg(F.min("doc_id").alias("low")).where("fp is not null")
    placed = placed.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    placed = placed.join(least, "root").join(count, "fp", "left").select("fp", "root", "component_id", F.coalesce("n_verified", F.lit(0)).alias("n_verified"))
    return prints.select("doc_id", "n_shingles", "fp"), placed


def jaccard_components(docs: DataFrame, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` and
    ``n_verified`` (other shingle sets that it was compared with and links to;
    pairs that a component already joins are not compared again).

    A null text and a text without words have no shingle and form components
    of their own.  Equal texts share a component.  Rows with a null id get
    the smallest id of their component, null if there is none.  Only the two
    named columns are read, so further columns may have any name.
    """
    prints, placed = _classes(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")), num, den)
    out = prints.join(placed, "fp", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_verified", F.lit(0)).alias("n_verified"))


def drop_near_copies(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """Keeps one row of each component, with all its columns: the one whose
    ``doc_id`` is the smallest; of a component without ids, one of its smallest
    set.  Rows without a shingle all stay.  Ids may be null or repeat: of rows
    equal in id and shingles one stays."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints, placed = _classes(own, num, den)
    scratch = Scratch(docs.sparkSession, "kept")
    kept = scratch.put(prints.join(placed, "fp", "left").where("fp is null or doc_id = component_id or (component_id is null and fp = root)").select("doc_id", "fp"))
    odd = scratch.put(prints.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("n")).where("n > 1 or __id is null").select("__id"))
    ids = kept.select(F.col("doc_id").alias("__kept")).distinct()
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col("__kept"))
    if odd.isEmpty():
        return docs.join(ids, docs["doc_id"].cast("bigint") == F.col("__kept"), "left_semi")
    # an id that several rows share says nothing of its rows: they are told apart by their sets
    is_odd = docs["doc_id"].cast("bigint").eqNullSafe(F.col("__id"))
    plain = docs.join(odd, is_odd, "left_anti").join(ids, same, "left_semi")
    rows = docs.join(odd, is_odd, "left_semi")
    at, names = rows.columns.index("text"), rows.columns
    marked = rows.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(names)])
    schema = StructType([*marked.schema.fields, StructField("__fp", LongType())])
    marked = scratch.put(marked.mapInArrow(_marked(at), schema))
    key = F.col(f"__c{names.index('doc_id')}").cast("bigint")
    bare = marked.where("__fp is null").drop("__fp")
    full = marked.where("__fp is not null").join(kept.where("fp is not null").distinct(), key.eqNullSafe(F.col("doc_id")) & (F.col("__fp") == F.col("fp")), "left_semi")
    full = full.withColumn("__key", key).dropDuplicates(["__key", "__fp"]).drop("__key", "__fp")
    out = bare.unionAll(full).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])
    return plain.unionAll(out)
