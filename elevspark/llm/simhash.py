"""Operator 4: SimHash near-duplicates by bit-sliced comparison.

A text's words are lower-cased (A-Z) and taken ``shingle`` at a time; each shingle is hashed with
XXH64 (seed 42) and a fingerprint bit is set if more than half the hashes have it. Wider
fingerprints take further bits from mixes of the same hash.

Equal fingerprints are one node, so copies cost nothing further. Candidates come from tables of bit
positions: nodes alike in a table's positions share a bucket. With ``pigeonhole`` tables no link is
lost: of b blocks of bits a pair within radius r leaves b - r untouched, and there is a table for
each choice of b - r blocks. In a bucket the fingerprints are turned on their side, one machine word
holding one bit of 64 fingerprints; the differing bits against a query are summed in carry-save
counters, 64 distances at a time, and words whose distances have all passed the radius are dropped on
the way. A large bucket is dealt into tiles that pair its parts, so that no task gets all of it.
Each tile returns a spanning forest of its links, not the links; components of the forests are
found on the cluster.

Null and empty texts have fingerprint 0 and are linked like any other; texts shorter than a shingle
are one shingle. Rows may repeat, ids may be null: a component's id is its smallest id that is not
null, null if there is none. An empty table gives an empty result.

The near-duplicates of the pipeline are those of exact similarity: see ``near_dedup``.
"""

from __future__ import annotations

import hashlib
import itertools
import random
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, kept_rows, lean, sliced, staged, table
from .components import components

SHINGLE, RADIUS, BLOCKS, SEED = 4, 4, 6, 42
#: Fingerprints in one part of a bucket; a tile holds two parts.
PART = 4096
_ONES = np.uint64(0x0101010101010101)


def pigeonhole(bits: int, radius: int, blocks: int) -> list[np.ndarray]:
    """Bit positions of each table; every pair within ``radius`` agrees in one of them."""
    parts = np.array_split(np.arange(bits), blocks)
    return [np.concatenate(c) for c in itertools.combinations(parts, blocks - radius)]


def sampled(bits: int, width: int, tables: int, seed: int = 7) -> list[np.ndarray]:
    """``tables`` seeded choices of ``width`` positions: a pair that differs in a share s of the bits meets with probability 1 - (1 - (1 - s)^width)^tables."""
    rng = random.Random(seed)
    return [np.array(sorted(rng.sample(range(bits), width))) for _ in range(tables)]


def shingle_hashes(text: str | None, k: int) -> array:
    """XXH64 of each run of ``k`` words, repeats included; the whole sequence if it is shorter; none without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z only, and exactly the six white-space bytes
    joined = b" ".join(words)
    if len(words) <= k:
        return array("Q", [xxh64_intdigest(joined, SEED)] if words else [])
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    return array("Q", [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)])


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th further 64 bits of each hash (the finaliser of splitmix64 on an offset)."""
    if not i:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * i) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(hashes: list[array], words: int = 1) -> np.ndarray:
    """One row of ``words`` 64-bit words per list of hashes. Bits are counted in byte lanes, 255 hashes at a time."""
    n = np.array([len(h) for h in hashes])
    out = np.zeros((len(hashes), words), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    every = np.concatenate([np.frombuffer(hashes[i], np.uint64) for i in some])
    at = np.concatenate([[0], np.cumsum(n[some])])
    parts = [np.arange(a, b, 255) for a, b in zip(at, at[1:], strict=False)]
    firsts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
    segments = np.concatenate(parts)
    for w in range(words):
        h = _mixed(every, w)
        counts = np.empty((len(segments), 8, 8), np.int64)  # by byte, then bit
        for bit in range(8):
            lanes = np.add.reduceat((h >> np.uint64(bit)) & _ONES, segments)
            counts[:, :, bit] = lanes.view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(counts, firsts, axis=0).reshape(len(some), 64)
        out[some, w] = np.packbits(2 * total > n[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _fingerprint(shingle: int, words: int, keep: list[str], blank: array):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4 << 20):
            got = fingerprints([shingle_hashes(t, shingle) or blank for t in batch.column("text").to_pylist()], words)
            raw = got.astype(">u8").tobytes()
            fp = pa.array([raw[i : i + 8 * words] for i in range(0, len(raw), 8 * words)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), fp], [*keep, "fp"])

    return run


def _words(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def _bits(fps: np.ndarray) -> np.ndarray:
    """(rows, bits) of 0 and 1; bit j of word w is column 64 w + j."""
    return np.unpackbits(np.ascontiguousarray(fps).astype("<u8").view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def _keys(tables: list[np.ndarray], words: int, with_fp: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = _bits(_words(batch.column("fp"), words))
            for t, positions in enumerate(tables):
                key = bits[:, positions].astype(np.int64) @ (np.int64(1) << np.arange(len(positions), dtype=np.int64)) + (np.int64(t) << np.int64(40))
                columns = [pa.array(key, pa.int64())] + ([batch.column("nid"), batch.column("fp")] if with_fp else [])
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "nid", "fp"][: len(columns)])

    return run


def _add(a, b, c):
    """Full adder: (sum, carry) of three words of bits."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is above ``radius``."""
    more, same = over.copy(), ~over
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            same &= counters[i]
        else:
            more |= same & counters[i]
            same &= ~counters[i]
    return more


def close_pairs(fps: np.ndarray, first: np.ndarray, radius: int, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of rows of one run within ``radius``; ``first``: rows that begin a run.

    Rows lie in lanes in their order; row i is compared with the words that hold later rows of its run.
    """
    n = len(fps)
    bits = _bits(fps)
    lanes = np.zeros((-(-n // 64) * 64, bits.shape[1]), np.uint8)
    lanes[:n] = bits
    planes = np.ascontiguousarray(np.packbits(lanes, axis=0, bitorder="little").T).view(np.uint64)
    del lanes
    ends = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    row = np.arange(n)
    query = np.flatnonzero(row + 1 < ends)
    lo, hi = (query + 1) // 64, (ends[query] - 1) // 64
    wide = hi - lo + 1
    cuts = np.searchsorted(np.cumsum(wide), np.arange(0, int(wide.sum()), most), "right")
    for a, b in itertools.pairwise([*dict.fromkeys(cuts.tolist()), len(query)]):
        q = np.repeat(query[a:b], wide[a:b])
        w = np.repeat(lo[a:b] - np.concatenate([[0], np.cumsum(wide[a:b])[:-1]]), wide[a:b]) + np.arange(len(q))
        yield from _compare(planes, bits, q, w, ends, radius)


def _compare(planes, bits, q, w, ends, radius):
    full = np.uint64(2**64 - 1)
    low = np.clip(q + 1 - 64 * w, 0, 63).astype(np.uint64)
    high = np.clip(64 * w + 64 - ends[q], 0, 63).astype(np.uint64)
    alive = (full << low) & (full >> high)
    m = max(2, int(radius).bit_length())
    counters, over = [np.zeros(len(q), np.uint64) for _ in range(m)], np.zeros(len(q), np.uint64)
    for k in range(0, len(planes), 4):
        x = [planes[k + i][w] ^ (np.uint64(0) - bits[q, k + i].astype(np.uint64)) for i in range(4)]
        ones, t1 = _add(counters[0], x[0], x[1])
        counters[0], t2 = _add(ones, x[2], x[3])
        counters[1], carry = _add(counters[1], t1, t2)
        for i in range(2, m):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if k % 16 == 12 or k + 4 == len(planes):
            alive &= ~_beyond(counters, over, radius)
            left = np.flatnonzero(alive)
            if len(left) < 0.7 * len(alive):  # abandon the words in which every lane is beyond the radius
                q, w, alive, over, counters = q[left], w[left], alive[left], over[left], [c[left] for c in counters]
            if not len(left):
                return
    for i in range(0, len(q), 16384):
        at, lane = np.nonzero(np.unpackbits(alive[i : i + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        yield q[i + at], 64 * w[i + at] + lane


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row linked to each row."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def _by_run(act, words: int, more: tuple[str, ...] = (), held: int = 1 << 14):
    """``act(first, columns, fps)`` on some whole runs (rows of one bucket and tile) at a time; ``first``: rows that begin a run."""
    names = ("bucket", "tile", "nid", *more)

    def begins(cols):
        return (cols["bucket"][1:] != cols["bucket"][:-1]) | (cols["tile"][1:] != cols["tile"][:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, fps = {c: np.zeros(0, np.int64) for c in names}, np.zeros((0, words), np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, held):
                part = batch.slice(at, held)
                cols = {c: np.concatenate([x, part.column(c).to_numpy()]) for c, x in cols.items()}
                fps = np.concatenate([fps, _words(part.column("fp"), words)])
                cuts = np.flatnonzero(begins(cols)) if len(fps) >= held else ()
                if len(cuts):
                    cut = int(cuts[-1]) + 1
                    done = {c: x[:cut] for c, x in cols.items()}
                    yield from act(np.flatnonzero(np.concatenate([[True], begins(done)])), done, fps[:cut])
                    cols, fps = {c: x[cut:] for c, x in cols.items()}, fps[cut:]
        if len(fps):
            yield from act(np.flatnonzero(np.concatenate([[True], begins(cols)])), cols, fps)

    return lean(run)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _link(radius: int, words: int):
    """A spanning forest of the links in each run."""

    def act(first, cols, fps):
        root = forest(len(fps), close_pairs(fps, first, radius))
        some = np.flatnonzero(root != np.arange(len(fps)))
        yield _pairs(cols["nid"][some], cols["nid"][root[some]])

    return _by_run(act, words)


def linked_nodes(nodes: DataFrame, tables: list[np.ndarray], radius: int, words: int, part: int = PART) -> DataFrame:
    """Links (a, b) that join the same nodes as all pairs of ``nodes`` (nid, fp) within ``radius`` that meet in a table."""
    counts = nodes.mapInArrow(lean(_keys(tables, words, False)), "bucket long").groupBy("bucket").agg(F.count("*").alias("n"))
    large = staged(counts.where(F.col("n") > part).select(F.col("bucket").alias("large"), F.ceil(F.col("n") / part).cast("int").alias("parts")), "large-buckets")
    rows = nodes.mapInArrow(lean(_keys(tables, words, True)), "bucket long, nid long, fp binary").join(large, F.col("bucket") == F.col("large"), "left")
    mine = F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int")
    tiles = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: (F.least(mine, other).cast("long") * F.col("parts") + F.greatest(mine, other))))
    rows = rows.select("bucket", F.explode(tiles).alias("tile"), "nid", "fp")
    return rows.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile").mapInArrow(_link(radius, words), "a long, b long")


def near_groups(prints: DataFrame, tables: list[np.ndarray], radius: int, words: int) -> DataFrame:
    """(fp, component, component_id) of every fingerprint in ``prints`` (doc_id, fp, ...)."""
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("low")).withColumn("nid", F.monotonically_increasing_id()), "nodes")
    found = staged(components(linked_nodes(nodes, tables, radius, words)), "components")
    nodes = staged(nodes.join(found.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid")), "rooted")
    # Written first: a join beside the grouping it rests on could not split the nodes of a large component.
    roots = staged(nodes.groupBy("root").agg(F.min("low").alias("component_id")), "roots")
    return staged(nodes.join(roots, "root").select("fp", F.col("root").alias("component"), "component_id"), "near-groups")


def simhash_groups(docs: DataFrame, keep: list[str], shingle: int = SHINGLE, words: int = 1, radius: int = RADIUS, tables: list[np.ndarray] | None = None, blank: tuple[int, ...] = ()) -> DataFrame:
    """A row per document: the columns ``keep`` (doc_id among them), fp, component (its number) and component_id.

    ``blank``: the hashes that stand for a text without words; without any its fingerprint is 0.
    """
    tables = tables or pigeonhole(64 * words, radius, BLOCKS)
    types = dict(docs.dtypes)
    prints = docs.select(*keep, "text").mapInArrow(lean(_fingerprint(shingle, words, keep, array("Q", blank))), ", ".join(f"{c} {types[c]}" for c in keep) + ", fp binary")
    prints = staged(prints, "prints")
    return prints.join(near_groups(prints, tables, radius, words), "fp")


#: Fingerprints of distinct five-word shingles. Pairs at similarity 0.8 differ in 15 % of the bits, those of the smallest sets
#: (4 shingles of 5) in 19 %: the radius lies 3.8 standard deviations beyond these and almost 6 beyond the rest.
NEAR = {"shingle": 5, "words": 4, "radius": 72}
#: The hash that stands for a text without words there: fingerprints of two shingles have few bits, so 0 would lie near some.
BLANK = (0x9FB21C651E98DF25,)

#: Near-duplicates are alike in 4 of 5 or more of their distinct five-word shingles. Buckets are BANDS bands of ROWS smallest
#: hashes; a pair at 0.8 shares none in one of two million cases, closer pairs in fewer still.
ALIKE, OF, BANDS, ROWS = 4, 5, 48, 6
#: Sets that a task compares with one other; pairs for each row of a run above which a row gets one partner a round; rounds; shingles in one part
#: of a bucket whose sets travel.
BLOCK, DENSE, ROUNDS, HELD = 64, 4, 2, 1 << 22
_MULTIPLIERS = np.array([[random.Random(11 + i).getrandbits(64) | 1] for i in range(BANDS * ROWS)], np.uint64)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(np.array(shingle_hashes(text, k), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key of each band; none without shingles."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 512):
        np.minimum(low, (hashes[i : i + 512] * _MULTIPLIERS).min(axis=1), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        key = _mixed(key ^ row, 1)
    return key.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, each in order, have the similarity."""
    if len(a) > len(b):
        a, b = b, a
    if OF * len(a) < ALIKE * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return OF * both >= ALIKE * (len(a) + len(b) - both)


def _set_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blank = np.array(BLANK, np.uint64)
    for batch in sliced(batches, 1 << 20):
        sets = [shingle_set(text, NEAR["shingle"]) for text in batch.column("text").to_pylist()]
        raw = fingerprints([x if len(x) else blank for x in sets], NEAR["words"]).astype(">u8").tobytes()
        wide = 8 * NEAR["words"]
        fps = [raw[i : i + wide] for i in range(0, len(raw), wide)]
        digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
        bands = [band_keys(x) for x in sets]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in bands])])
        keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands), pa.int64()))
        columns = [batch.column("doc_id"), batch.column("key"), pa.array(digests, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(fps, pa.binary()), keys]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "set", "n", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 4 << 20):
        found = [shingle_set(t, NEAR["shingle"]).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("nid"), pa.array(found, pa.binary())], ["nid", "shingles"])


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nid, h): a row for each shingle, by 32 of its bits."""
    for batch in sliced(batches, 4 << 20, "shingles"):
        sets = [np.frombuffer(x.as_buffer(), "<u4")[::2] for x in batch.column("shingles")]
        nid = np.repeat(batch.column("nid").to_numpy(), [len(x) for x in sets])
        yield pa.RecordBatch.from_arrays([pa.array(nid, pa.int64()), pa.array(np.concatenate(sets).view("<i4"), pa.int32())], ["nid", "h"])


def able(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """``nodes`` (nid, n, ...) with ``shared``, how many of their shingles any other set may hold; without those that can be like none.

    Two sets have no more in common than either shares with all: in a large group of copies with edits of their own this
    leaves few pairs to compare. Digests that meet by chance count as shared, which loses nothing.
    """
    lone = sets.mapInArrow(lean(_flat), "nid long, h int").groupBy("h").agg(F.count("*").alias("c"), F.min("nid").alias("nid")).where("c = 1")
    lone = lone.groupBy("nid").agg(F.count("*").alias("alone"))
    out = nodes.join(lone, "nid", "left").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    return out.where(OF * F.col("shared") >= ALIKE * F.col("n"))


def _compare_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block follow one another; its hub's row, without ``a``, comes first."""
    hub = None
    for batch in batches:
        left, right = [], []
        for a, b, shingles in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("shingles"), strict=True):
            mine = np.frombuffer(shingles.as_buffer(), np.uint64)
            if a is None:
                hub = mine.copy()
            elif alike(mine, hub):
                left.append(a)
                right.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _alike_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose sets have the similarity. The pairs of one b are dealt into blocks."""
    pairs = staged(pairs, "near-pairs")
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = staged(pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), "parts").alias("part")), "near-blocks")
    hubs = dealt.select("b", "part").distinct().join(sets.withColumnRenamed("nid", "b"), "b").select(F.lit(None).cast("long").alias("a"), "b", "part", "shingles")
    members = dealt.join(sets.withColumnRenamed("nid", "a"), "a").select("a", "b", "part", "shingles")
    rows = hubs.unionByName(members).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    found = staged(rows.select("a", "b", "shingles").mapInArrow(lean(_compare_sets), "a long, b long"), "near-links")
    discard(pairs, dealt)
    return found


def _may(i, j, cols) -> np.ndarray:
    """Whether rows are in different components and of sizes, and shingles shared with any, that allow the similarity."""
    n, shared = cols["n"], cols["shared"]
    fit = (OF * np.minimum(n[i], n[j]) >= ALIKE * np.maximum(n[i], n[j])) & ((ALIKE + OF) * np.minimum(shared[i], shared[j]) >= ALIKE * (n[i] + n[j]))
    return fit & (cols["root"][i] != cols["root"][j])


def _candidates(seed: int):
    """(a, b) of the pairs of a run that may have the similarity: within the radius, in different components, of sizes that allow it.

    Of a run with more than ``DENSE`` of them a row ``one`` is chosen for each row, and the run's bucket is ``open``: first the
    earliest row, which joins large groups, later one by hash.
    """

    def told(a, b, one=False, open_=()):
        none = [pa.nulls(len(x), pa.int64()) for x in (open_, a)]
        columns = [pa.chunked_array([pa.array(x, pa.int64()), none[0]]).combine_chunks() for x in (a, b)]
        columns += [pa.array([one] * (len(a) + len(open_)), pa.bool_()), pa.chunked_array([none[1], pa.array(open_, pa.int64())]).combine_chunks()]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "one", "open"])

    def act(first, cols, fps):
        nid = cols["nid"]
        rows = np.diff(np.append(first, len(fps)))
        run, most, seen = np.repeat(np.arange(len(first)), rows), DENSE * rows, np.zeros(len(first), np.int64)
        chosen, kept = np.full(len(fps), 2**64 - 1, np.uint64), []
        for i, j in close_pairs(fps, first, NEAR["radius"]):
            may = _may(i, j, cols)
            i, j = i[may], j[may]
            seen += np.bincount(run[i], minlength=len(first))
            if seed:
                rank = _mixed((nid[i].astype(np.uint64) << np.uint64(32)) ^ nid[j].astype(np.uint64), seed) & np.uint64(0xFFFFFFFF00000000)
                np.minimum.at(chosen, i, rank | j.astype(np.uint64))
                np.minimum.at(chosen, j, rank | i.astype(np.uint64))
            else:
                np.minimum.at(chosen, j, i.astype(np.uint64))
            few = seen[run[i]] <= most[run[i]]
            kept.append((i[few], j[few]))
        many = seen > most
        some = np.flatnonzero(many[run] & (chosen < 2**64 - 1))
        yield told(nid[some], nid[(chosen[some] & np.uint64(0xFFFFFFFF)).astype(np.int64)], True, np.unique(cols["bucket"][first[many | (cols["whole"][first] == 0)]]))
        for i, j in kept:
            i, j = i[~many[run[i]]], j[~many[run[i]]]
            yield told(nid[j], nid[i])

    return _by_run(act, NEAR["words"], ("n", "shared", "root", "whole"))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): links that join the same components as all pairs of a run with the similarity. Rows bring their sets; a run is held whole."""
    names = ("bucket", "tile", "nid", "n", "shared", "root")

    def settled(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        cols = {c: np.concatenate([x.column(c).to_numpy() for x in rows]) for c in names}
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for r in rows for x in r.column("shingles")]
        fps = np.concatenate([_words(r.column("fp"), NEAR["words"]) for r in rows])
        up, found = {}, []

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        roots = cols["root"].tolist()
        for i, j in close_pairs(fps, np.array([0]), NEAR["radius"]):
            may = _may(i, j, cols)
            for x, y in zip(i[may].tolist(), j[may].tolist(), strict=True):
                a, b = top(roots[x]), top(roots[y])
                if a != b and alike(sets[x], sets[y]):
                    up[max(a, b)] = min(a, b)
                    found.append((x, y))
        at = np.array(found, np.int64).reshape(-1, 2)
        return _pairs(cols["nid"][at[:, 0]], cols["nid"][at[:, 1]])

    held, last = [], None
    for batch in batches:
        bucket, tile = batch.column("bucket").to_numpy(), batch.column("tile").to_numpy()
        cuts = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(cuts):
            if a < b and (bucket[a], tile[a]) != last:
                if held:
                    yield settled(held)
                held, last = [], (bucket[a], tile[a])
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield settled(held)


def _dealt(here: DataFrame, seed: int, sets: DataFrame | None = None, part: int = PART) -> DataFrame:
    """The rows of ``here`` (bucket, nid, n, shared, root, fp) in runs: a bucket of several components, or parts of a large one.

    Rows of a bucket's largest component need not meet each other: they go to one part, the others to all, where these are few
    enough. Else all go to one and the run is not ``whole``. With ``sets`` rows bring theirs, and all parts meet.
    """
    by = here.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n")).groupBy("bucket").agg(F.sum("c").alias("m"), F.sum("n").alias("n"), F.max(F.struct("c", "root")).alias("top"))
    parts = F.ceil(F.col("m") / part).cast("long")
    if sets is not None:
        parts = F.greatest(parts, F.ceil(F.col("n") / HELD).cast("long"))
    whole = (parts == 1) | ((F.col("m") - F.col("top.c")) * parts <= 2 * F.col("m"))
    by = staged(by.where("m > top.c").select("bucket", F.col("top.root").alias("top"), parts.alias("parts"), whole.cast("long").alias("whole")), "near-open")
    mine, every = F.pmod(F.xxhash64(F.lit(seed), "nid"), "parts"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    if sets is None:
        tiles = F.when((F.col("whole") == 1) & (F.col("root") != F.col("top")), every).otherwise(F.array(mine))
    else:
        tiles = F.transform(every, lambda other: F.least(mine, other) * F.col("parts") + F.greatest(mine, other))
    rows = here.join(by, "bucket").select("bucket", F.explode(tiles).alias("tile"), "nid", "n", "shared", "root", "whole", "fp")
    rows = rows if sets is None else rows.join(sets, "nid")
    return rows.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", F.xxhash64(F.lit(seed), "nid"))


def similar_roots(met: DataFrame, nodes: DataFrame, sets: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, root) of the components that pairs with the similarity make among nodes that share a bucket.

    ``met``: (bucket, nid); ``nodes``: (nid, n, shared, fp); ``sets``: (nid, shingles). Fingerprints of a bucket are compared bit-sliced; pairs
    within the radius that are not in one component already are compared by their sets. A bucket with many pairs first
    gets ``rounds`` that take some of them; if its components still leave many, the sets of its nodes come together and all
    pairs left are compared where they lie. No task returns more than a few pairs a row.
    """
    roots = None
    for k in range(rounds + 1):
        state = nodes.withColumn("root", F.col("nid")) if roots is None else nodes.join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
        here = staged(met.join(state, "nid").select("bucket", "nid", "n", "shared", "root", "fp"), "near-met")
        if k == rounds:
            links, met, found = staged(_dealt(here, k, sets).mapInArrow(lean(_settle), "a long, b long"), "near-links"), None, None
        else:
            found = staged(_dealt(here, k).mapInArrow(_candidates(k), "a long, b long, one boolean, open long"), "near-candidates")
            one = found.where("a IS NOT NULL AND one").groupBy("a").agg(F.min_by("b", F.xxhash64(F.lit(k), "b")).alias("b"))  # of the partners in all buckets
            links = _alike_pairs(found.where("a IS NOT NULL AND NOT one").select("a", "b").union(one).distinct(), sets)
            left = found.where("open IS NOT NULL").select(F.col("open").alias("bucket")).distinct()
            met = None if left.isEmpty() else staged(here.join(left, "bucket", "left_semi").select("bucket", "nid"), "near-left")
        joined = staged(components(links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "near-roots")
        discard(here, links, *(x for x in (found, roots) if x is not None))
        roots = joined
        if met is None:
            break
    return roots


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each group the one with the smallest id stays (null last).

    Texts of the same set of distinct five-word shingles are one node; other links are those of pairs whose sets are alike in 0.8
    or more. Pairs that share a band of smallest hashes are compared by their SimHash fingerprints, bit-sliced as in the
    operator; those within the radius are then compared by the sets themselves.

    Null and empty texts and those without words are one group, alike to nothing else. Rows alike in id and text are one row. An empty
    table gives an empty result; columns keep their names and values.
    """
    key = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    keyed = docs.select("doc_id", key.alias("key"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    prints = staged(keyed.mapInArrow(lean(_set_prints), f"doc_id {kind}, key string, set binary, n long, fp binary, bands array<long>"), "near-prints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))).alias("best")
    nodes = staged(prints.groupBy("set").agg(least, *[F.first(c).alias(c) for c in ("n", "fp", "bands")]).withColumn("nid", F.monotonically_increasing_id()), "near-nodes")
    shared = F.count("*").over(Window.partitionBy("bucket"))
    met = staged(nodes.select("nid", F.explode("bands").alias("bucket")).withColumn("m", shared).where("m > 1").select("bucket", "nid"), "near-buckets")
    meet = staged(met.select("nid").distinct(), "near-meet")
    wanted = nodes.join(meet, "nid").select("nid", F.col("best.doc_id").alias("low"), F.col("best.key").alias("its"))
    sets = staged(keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("key") == F.col("its"))).select("nid", "text").mapInArrow(lean(_sets), "nid long, shingles binary"), "near-sets")
    state = staged(able(nodes.join(meet, "nid").select("nid", "n", "fp"), sets.dropDuplicates(["nid"])), "near-state")
    roots = similar_roots(staged(met.join(state, "nid", "left_semi"), "near-able"), state, sets).withColumnRenamed("node", "nid")
    rooted = nodes.select("nid", "best").join(roots, "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    stay = staged(rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.doc_id", "best.key"), "near-stay")
    return kept_rows(docs, {"doc_id": F.col("doc_id"), "key": key}, stay)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_groups(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
