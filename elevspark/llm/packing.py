"""Operator 5: pack documents into sequences by linear grouping, then best fit.

A document is its ids and one end id; longer ones are cut into pieces of ``capacity``. The plan is
made from the number of pieces of each length, ``capacity`` numbers however many pieces there are:

* pieces longer than ``capacity / LARGE`` are sorted and dealt into ``GROUPS`` groups of equal
  cardinality, and each length is rounded up to the largest of its group;
* the few rounded sizes give a configuration programme (how many sequences hold which sizes), which
  column generation solves: a small simplex, priced by a knapsack over ``capacity``; whole parts of
  the solution are kept;
* actual lengths take the places of the rounded ones, longest first, which frees room;
* all that is left (the fractional remainder and the small pieces) goes, longest first, where it
  fits best; new sequences open only when nothing fits.

Sequences of one make are handled as a run, so the plan's size depends on the lengths that occur and
not on the number of pieces. Executors number the pieces of a length, dealt into salts of about
``NUMBERED`` (so a frequent length is no single task's), and look the number up in the plan.

Null text counts as empty: one piece holding the end id. Repeated rows are packed as often as they
occur. An empty table gives an empty result. Input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, sliced, staged, table
from .tokens import REMEMBERED, SLICE, encoder, vocabulary_path

CAPACITY, END_ID = 4096, 1
LARGE, GROUPS = 8, 48
#: Pieces of one length that a task numbers.
NUMBERED = 1 << 20


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each: how many of each size) and how many sequences of each, by column generation."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))  # a column is a pattern
    most = int(capacity // sizes.min())
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        best = np.zeros(capacity + 1)  # the dearest pattern of at most j pieces in each room
        picks = []
        for _ in range(most):
            step, pick = best.copy(), np.full(capacity + 1, -1)
            for i in range(k):
                worth = price[i] + best[: capacity + 1 - sizes[i]]
                better = worth > step[sizes[i] :] + 1e-12
                step[sizes[i] :][better] = worth[better]
                pick[sizes[i] :][better] = i
            if (pick < 0).all():
                break
            picks.append(pick)
            best = step
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for pick in reversed(picks):
            if pick[room] >= 0:
                column[pick[room]] += 1
                room -= sizes[pick[room]]
        way, amount = np.linalg.solve(basis, column), np.linalg.solve(basis, demand)
        able = way > 1e-9
        if not able.any():
            break
        out = np.flatnonzero(able)[np.argmin(amount[able] / way[able])]
        basis[:, out] = column
    return basis.T.round().astype(int), np.maximum(np.linalg.solve(basis, demand), 0)


class _Plan:
    """Runs of sequences alike: (first, n, room left, contents), contents a linked list of (length, copies)."""

    def __init__(self, capacity: int):
        self.capacity, self.n, self.by_room, self.rooms = capacity, 0, {}, []

    def add(self, first: int, n: int, room: int, held) -> None:
        if n:
            if room not in self.by_room:
                self.by_room[room] = []
                bisect.insort(self.rooms, room)
            self.by_room[room].append((first, n, held))

    def open(self, n: int) -> int:
        self.n += n
        return self.n - n

    def place(self, length: int, count: int) -> None:
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                whole, rest = divmod(count, each)
                if whole:
                    self.add(self.open(whole), whole, self.capacity - each * length, ((length, each), None))
                if rest:
                    self.add(self.open(1), 1, self.capacity - rest * length, ((length, rest), None))
                return
            room = self.rooms[at]
            first, n, held = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room], self.rooms[at]
            each = room // length
            whole = min(n, count // each)
            self.add(first, whole, room - each * length, ((length, each), held))
            count -= whole * each
            first, n = first + whole, n - whole
            if n and count:
                self.add(first, 1, room - count * length, ((length, count), held))
                first, n, count = first + 1, n - 1, 0
            self.add(first, n, room, held)


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY, large: int = LARGE, groups: int = GROUPS) -> dict[str, np.ndarray]:
    """The plan for ``counts[length]`` pieces, as segments sorted by place.

    Pieces are numbered by length and then by their number within the length; segment ``i`` holds
    those from ``place[i]`` up to the next: ``copies`` a sequence, in sequences from ``first`` on,
    from ``offset`` on.
    """
    counts = np.asarray(counts, np.int64).copy()
    places = np.concatenate([[0], np.cumsum(counts)])
    plan = _Plan(capacity)
    if counts[capacity]:
        plan.add(plan.open(int(counts[capacity])), int(counts[capacity]), 0, ((capacity, 1), None))
    left = counts.copy()
    left[capacity] = 0
    n_large = int(left[capacity // large + 1 :].sum())
    if n_large:
        _pack_large(plan, left, capacity, capacity // large, min(groups, n_large))
    for length in np.flatnonzero(left)[::-1]:
        plan.place(int(length), int(left[length]))
    found, taken = [], places.copy()
    for runs in plan.by_room.values():
        for first, n, held in runs:
            offset = 0
            while held:
                (length, copies), held = held
                found.append((taken[length], first, copies, offset))
                taken[length] += n * copies
                offset += length * copies
    rows = np.array(sorted(found), np.int64).reshape(-1, 4)
    return {"place": rows[:, 0], "first": rows[:, 1], "copies": rows[:, 2], "offset": rows[:, 3], "starts": places, "sequences": plan.n}


def _pack_large(plan: _Plan, left: np.ndarray, capacity: int, small: int, groups: int) -> None:
    """Pack the large lengths by configurations and take them off ``left``."""
    lengths = np.flatnonzero(left[small + 1 :])[::-1] + small + 1
    ends = np.cumsum(left[lengths])
    total = int(ends[-1])
    cuts = sorted({total * (g + 1) // groups for g in range(groups)})
    sizes, members, begin = [], [], 0
    for cut in cuts:  # pieces begin..cut in descending order, which may split the pieces of one length
        i, runs, upto = int(np.searchsorted(ends, begin, "right")), [], begin
        while upto < cut:
            n = int(min(ends[i], cut)) - upto
            runs.append([int(lengths[i]), n])
            upto, i = upto + n, i + 1
        if sizes and runs[0][0] == sizes[-1]:
            members[-1] += runs
        else:
            sizes.append(runs[0][0])
            members.append(runs)
        begin = cut
    demand = np.array([sum(n for _, n in m) for m in members], float)
    patterns, amounts = _configurations(np.array(sizes), demand, capacity)
    queues = [m[::-1] for m in members]  # the longest at the end
    remaining = demand.astype(np.int64)
    for pattern, amount in sorted(zip(patterns, amounts, strict=True), key=lambda x: -x[1]):
        used = pattern > 0
        n = int(min([np.floor(amount + 1e-9), *(remaining[used] // pattern[used])])) if used.any() else 0
        if not n:
            continue
        remaining -= n * pattern
        slots = []  # for each place in the pattern, the runs of lengths that fill it over the n sequences
        for g in np.flatnonzero(pattern):
            for _ in range(pattern[g]):
                need, runs = n, []
                while need:
                    length, have = queues[g][-1]
                    take = min(need, have)
                    runs.append((length, take))
                    left[length] -= take
                    need -= take
                    if take == have:
                        queues[g].pop()
                    else:
                        queues[g][-1][1] -= take
                slots.append(runs)
        edges = sorted({0, *(int(e) for runs in slots for e in np.cumsum([r[1] for r in runs]))})
        first, cursors = plan.open(n), [[0, runs[0][1]] for runs in slots]
        for lo, hi in zip(edges, edges[1:], strict=False):
            held, room = None, capacity
            for cursor, runs in zip(cursors, slots, strict=True):
                while cursor[1] <= lo:
                    cursor[0] += 1
                    cursor[1] += runs[cursor[0]][1]
                length = runs[cursor[0]][0]
                held, room = ((length, 1), held), room - length
            plan.add(first + lo, hi - lo, room, held)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool, remembered: int = REMEMBERED):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SLICE):
            docs, piece, start, length, crc, held = [], [], [], [], [], []
            encoded = encoder(path, remembered).encode([t or "" for t in batch.column("text").to_pylist()])
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    docs.append(doc)
                    piece.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        held.append(part)
            columns = [pa.array(docs, batch.schema.field("doc_id").type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(held, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False, numbered: int = NUMBERED, remembered: int = REMEMBERED) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset. ``remembered``: pieces of text whose ids a worker keeps."""
    spark, path = docs.sparkSession, vocabulary or vocabulary_path()
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = docs.select("doc_id", "text").mapInArrow(lean(_pieces(path, capacity, end_id, with_ids, remembered)), schema)
    pieces = staged(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    parts = np.maximum(-(-counts // numbered), 1)
    few = spark.createDataFrame([(i, int(n)) for i, n in enumerate(parts)], "length long, parts int")
    pieces = pieces.join(F.broadcast(few), "length").withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")).drop("parts")
    begin, per = np.cumsum(parts) - parts, np.zeros(int(parts.sum()), np.int64)
    for r in pieces.groupBy("length", "salt").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows and one in ``numbered`` pieces
        per[begin[r["length"]] + r["salt"]] = r["n"]
    plan = plan_packing(counts, capacity)
    plan |= {"begin": begin, "ranks": np.cumsum(per) - per}  # of a salt's first piece, over all lengths
    sent = spark.sparkContext.broadcast(plan)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            length, salt, nth = (batch.column(c).to_numpy() for c in ("length", "salt", "nth"))
            place = p["ranks"][p["begin"][length] + salt] + nth - 1
            at = np.searchsorted(p["place"], place, "right") - 1
            k = place - p["place"][at]
            sequence = p["first"][at] + k // p["copies"][at]
            offset = p["offset"][at] + k % p["copies"][at] * length
            keep = [i for i, name in enumerate(batch.schema.names) if name not in ("rid", "salt", "nth")]
            columns = [*(batch.column(i) for i in keep), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    order = [c.split()[0] for c in schema.split(", ")]
    rows = pieces.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("rid")).cast("long"))
    return rows.select(*order, "rid", "salt", "nth").mapInArrow(look_up, schema + ", sequence_id long, offset long")


def op5_pack_documents(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
