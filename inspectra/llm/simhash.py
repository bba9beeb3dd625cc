"""SimHash near-duplicates: segment-popcount embedding and a grid range join.

A 64-bit fingerprint is embedded as the bit counts of its 2-bit segments.  The
Manhattan distance of two embeddings never exceeds the Hamming distance of
the fingerprints, so it is a lower bound to join on: with the coordinates in
p = d // 2 + 1 parts, fingerprints within d bits agree on some part up to a
Manhattan distance of 1.  Each part of each fingerprint is a grid cell of its
own; a fingerprint is sent to its home cell and, for the range, to the cells one
step up in a single coordinate (of two neighbours the lower one probes).
Everything that meets in a cell is verified by its exact Hamming distance.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Rows of a cell that one task compares; a fuller cell is compared block by block over several tasks.
CELL_ROWS = 4096
#: Runs up to this length are compared by shifted arrays, longer ones by a search that emits a spanning star.
SHORT_RUN = 48
_CHUNK = 1 << 15
_PAIR_LOW = np.uint64(0x5555555555555555)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of the ASCII-lower-cased whole text over its word shingles, repeats included.

    Words are runs of anything but space and \\t-\\r; with fewer words than a
    shingle the whole sequence is the only shingle; without words it is 0.
    """
    import xxhash
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(shingle_words, len(words))
    joined = b" ".join(words)
    ends = list(itertools.accumulate((len(w) + 1 for w in words)))  # one past the space after each word
    hashed = xxhash.xxh64_intdigest
    spans = zip(itertools.chain((0,), ends), ends[k - 1:])
    n = len(words) - k + 1
    counts = np.zeros(64, np.int64)
    while chunk := [hashed(joined[a:b - 1], SEED) for a, b in itertools.islice(spans, _CHUNK)]:
        octets = np.array(chunk, "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp is the fingerprint's bits as a signed long."""
    src = docs.select("doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return src.mapInArrow(run, f"doc_id {kind}, fp long")


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def grid_cells(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index of the fingerprint) for home cells and one-step-up probes of every part."""
    counts = fps - ((fps >> np.uint64(1)) & _PAIR_LOW)  # 32 bit counts of 0..2, two bits each
    cells, index = [], []
    for part, coords in enumerate(np.array_split(np.arange(32, dtype=np.uint64), max_bits // 2 + 1)):
        mask = np.bitwise_or.reduce(np.uint64(3) << (coords * np.uint64(2)))
        own, salt = counts & mask, np.uint64(part + 1) << np.uint64(57)
        cells.append(_mix(own) ^ salt)
        index.append(np.arange(len(fps)))
        if max_bits == 0:
            continue
        for c in coords * np.uint64(2):
            up = np.nonzero((own >> c) & np.uint64(3) < 2)[0]
            cells.append(_mix(own[up] + (np.uint64(1) << c)) ^ salt)
            index.append(up)
    return np.concatenate(cells), np.concatenate(index)


def links_in_runs(cells: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links inside runs of equal ``cells`` (sorted): all of a short run, a spanning star of a long one."""
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    lengths = np.diff(np.r_[starts, len(cells)])
    a, b = [], []
    short = np.repeat(lengths <= SHORT_RUN, lengths)
    i = np.flatnonzero(short[:-1] & (cells[1:] == cells[:-1]))
    for d in range(1, SHORT_RUN):
        i = i[i + d < len(cells)]
        i = i[cells[i] == cells[i + d]]
        if not len(i):
            break
        near = np.bitwise_count(fps[i] ^ fps[i + d]) <= max_bits
        a.append(fps[i[near]])
        b.append(fps[i[near] + d])
    for s, n in zip(starts[lengths > SHORT_RUN], lengths[lengths > SHORT_RUN]):
        rest = np.unique(fps[s:s + n])
        while len(rest):
            root, rest = rest[0], rest[1:]
            todo = [root]
            while todo and len(rest):
                near = np.bitwise_count(rest ^ todo.pop()) <= max_bits
                if near.any():
                    hit, rest = rest[near], rest[~near]
                    todo.extend(hit)
                    a.append(np.full(len(hit), root))
                    b.append(hit)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(fps: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect exactly what their Hamming links connect."""

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            cells, at = grid_cells(own, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(own[at].view(np.int64))],
                                             names=["cell", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.uint64), np.empty(0, np.uint64)]

        def found(cells, fps):
            a, b = links_in_runs(cells, fps, max_bits) if len(cells) > 1 else (fps[:0], fps[:0])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1)]
            held = [np.concatenate([x, y]) for x, y in zip(held, new)]
            cut = int(np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]])[-1]) if len(held[0]) else 0
            if cut:
                yield found(held[0][:cut], held[1][:cut])
                held = [x[cut:].copy() for x in held]
        yield found(*held)

    cells = fps.mapInArrow(to_cells, "cell long, fp long")
    full = scratch.table(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS), "full")
    if not full.isEmpty():
        # a full cell: its rows fall into blocks by hash, and every pair of blocks is a cell of its own
        block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        other = F.explode(F.expr("sequence(0L, blocks - 1)"))
        cells = (cells.join(full, "cell", "left")
                 .withColumn("blocks", F.coalesce(F.ceil(F.col("n") / CELL_ROWS), F.lit(1)).cast("long"))
                 .withColumn("block", block).withColumn("other", other)
                 .select(F.when(F.col("n").isNull(), F.col("cell"))
                         .otherwise(F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other"))).alias("cell"),
                         "fp"))
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, scratch: Scratch, shingle_words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits, the document itself included.  Equal
    fingerprints (copies, reordered white space, all documents without words)
    are one node, so a group of copies costs one comparison.  A null doc_id
    never names a component unless every member's is null.  Other columns are
    ignored; an empty table gives no rows.
    """
    own = scratch.table(fingerprints(docs, shingle_words), "fingerprints")
    nodes = scratch.table(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = components(links(nodes.select("fp"), scratch, max_bits), scratch)
    members = scratch.table(found.join(nodes, F.col("node") == F.col("fp")).select("node", "component", "first"), "members")
    named = scratch.table(members.groupBy("component").agg(F.min("first").alias("component_id")), "named")
    linked = members.join(named, "component").select(F.col("node").alias("fp"), "component_id")
    ids = scratch.table(nodes.join(linked, "fp", "left")
                        .select(F.col("fp").alias("node"), F.coalesce("component_id", "first").alias("component_id")), "ids")
    return own.join(ids, F.col("fp") == F.col("node"), "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
