"""Packing token ids into windows by Karmarkar-Karp multiway differencing.

Long documents give whole windows of their own; what is left over is cut into pieces and dealt to
the fewest windows that differencing can fill without exceeding their capacity.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cardloom.llm.common import text_of
from cardloom.llm.pieces import library_encoder, text_chunks

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Sequence ids of one partition are consecutive from its number times this.
STRIDE = 1 << 40


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of sizes in k subsets of nearly equal sums.

    Every size starts as a partial partition with one filled subset.  The two partitions whose largest
    and smallest sums lie furthest apart merge, largest subset onto smallest, until one is left.
    """
    if not sizes:
        return [[] for _ in range(k)]
    heap, nodes, tie = [], [()], 0  # nodes: a leaf holds an index, an inner node two nodes; node 0 is empty
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        sums, held = np.zeros(k, np.int64), np.zeros(k, np.int64)
        nodes.append((i,))
        sums[0], held[0] = sizes[i], len(nodes) - 1
        heap.append((-sizes[i] if k > 1 else 0, tie, sums, held))
        tie += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums, y = a + b[::-1], y[::-1]
        for j in np.flatnonzero((x > 0) & (y > 0)).tolist():
            nodes.append((int(x[j]), int(y[j])))
            x[j] = len(nodes) - 1
        held = np.where(x > 0, x, y)
        order = np.argsort(-sums, kind="stable")
        sums, held = sums[order], held[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), tie, sums, held))
        tie += 1
    out = []
    for top in heap[0][3].tolist():
        leaves, stack = [], [top] if top else []
        while stack:
            node = nodes[stack.pop()]
            if len(node) == 1:
                leaves.append(node[0])
            else:
                stack += node
        out.append(sorted(leaves))
    return out


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Subsets of sizes (each at most capacity) within capacity; one more window whenever a sum exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        k += 1


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, largest: int = 256, group: int = 128, bits: int = 21) -> DataFrame:
    """Pieces of every text's ids and end_id, each with its place in a sequence of at most capacity tokens.

    docs: doc_id, text (null: empty); other columns are ignored, and every row is a document of its own,
    whatever its doc_id (null included).  A document's ids go, capacity at a time, to windows of their
    own; the rest is cut into pieces of at most `largest` ids, and whenever `group` windows' worth of
    pieces has gathered, differencing deals them out.  Memory is bounded by one group and the table of
    pieces, which forgets them all when 0.6 * 2**bits are held.  No shuffle; an empty table gives no rows.
    ids: little-endian u32.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer, bits)
        sequence = TaskContext.get().partitionId() * STRIDE
        out: list[tuple] = []
        rest: list[tuple] = []
        waiting = 0

        def deal() -> None:
            nonlocal sequence, waiting
            for window in fill([len(x[3]) for x in rest], capacity):
                offset = 0
                for i in window:
                    doc_id, start, total, ids = rest[i]
                    out.append((doc_id, start, len(ids), total, sequence, offset, ids.tobytes()))
                    offset += len(ids)
                sequence += 1
            rest.clear()
            waiting = 0

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, buf, offsets in text_chunks(batch.column(1)):
                ids, bound = encoder.ids(buf, offsets)
                ids = ids.astype("<u4", copy=False)
                for i in range(b - a):
                    mine = np.append(ids[bound[i] : bound[i + 1]], np.uint32(end_id)).astype("<u4", copy=False)
                    whole = len(mine) // capacity * capacity
                    for start in range(0, whole, capacity):
                        out.append((doc_ids[a + i], start, capacity, len(mine), sequence, 0, mine[start : start + capacity].tobytes()))
                        sequence += 1
                    for start in range(whole, len(mine), largest):
                        rest.append((doc_ids[a + i], start, len(mine), mine[start : start + largest]))
                        waiting += len(rest[-1][3])
                    if waiting >= group * capacity:
                        deal()
                yield _pieces(out)
                out.clear()
        deal()
        yield _pieces(out)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, PIECES)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def padded_length(length: int, capacity: int) -> int:
    """A sequence is padded to capacity unless its length is a power of two already."""
    return length if length & (length - 1) == 0 else capacity
