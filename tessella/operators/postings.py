"""Blocks of tokenised documents, and what batches of queries find in them.

A block holds some ten thousand documents in the order of their ids as one run of token numbers, so the
occurrences of a token, or of tokens next to each other, are found by array arithmetic.  Blocks are made where
the documents are read; no posting is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: A block is closed at so many tokens or documents; a longer document makes a block alone.
BLOCK_TOKENS, BLOCK_DOCS = 2_000_000, 32_768
#: Rows in which a block is written, each with a slice of its columns, as Spark holds several copies of a row.
PIECES = 8
#: Blocks in a written file, as a reader may hold a file's rows together; the pieces of a block are in one file.
FILE_BLOCKS = 1
#: Queries whose best documents a task holds before it hands them on, and rows handed on at once.
HELD, HANDED = 32_768, 100_000
#: Units in more than this share of a block's documents are also kept as a full vector.
DENSE = 1 / 16
# Fixed value: decimals of a score.
UNIT = 1e6


def packed(batches):
    """Blocks (block, ids, lens, words, seq) of documents (doc_id, ts)."""
    part, n, held, size, docs = TaskContext.get().partitionId(), 0, [], 0, 0

    def block():
        table = pa.Table.from_batches(held).combine_chunks()
        table = table.take(pc.sort_indices(table["doc_id"])).combine_chunks()
        ids, ts = (pa.concat_arrays(table[c].chunks) for c in ("doc_id", "ts"))
        coded = ts.flatten().dictionary_encode()
        lens = pc.list_value_length(ts).to_numpy(zero_copy_only=False).astype(np.int32)
        seq = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        columns = [[(part << 32) + n], [ids.to_pylist()], [lens.tobytes()], [coded.dictionary.to_pylist()], [seq.tobytes()]]
        types = [pa.int64(), pa.list_(ids.type), pa.binary(), pa.list_(pa.string()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["block", "ids", "lens", "words", "seq"])

    for b in batches:
        ends = np.cumsum(pc.list_value_length(b["ts"]).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, before + BLOCK_TOKENS - size, side="right"))
            to = min(max(to, at if held else at + 1), at + BLOCK_DOCS - docs, b.num_rows)
            if to > at:
                held.append(b.slice(at, to - at))
                size, docs = size + int(ends[to - 1] - before), docs + to - at
                at = to
            if at < b.num_rows:  # what comes next doesn't fit
                yield block()
                n, held, size, docs = n + 1, [], 0, 0
    if held:
        yield block()


_SLICED = ("ids", "lens", "words", "seq")


def pieces(blocks):
    """Each block as ``PIECES`` rows, one a batch: slices of its columns, in order, and ``piece``, their place."""
    for b in blocks:
        whole = [b["ids"][0].values, b["lens"][0].as_py(), b["words"][0].values, b["seq"][0].as_py()]
        for i in range(PIECES):
            own = [c[i * len(c) // PIECES : (i + 1) * len(c) // PIECES] for c in whole]
            own = [pa.array([c.to_pylist() if isinstance(c, pa.Array) else c], b[name].type) for c, name in zip(own, _SLICED)]
            yield pa.RecordBatch.from_arrays([b["block"], pa.array([i]), *own], ["block", "piece", *_SLICED])


def whole(batches):
    """The rows that hold a block's last piece, each with the whole block; a piece stands in any number of rows next to each other."""
    last, held, block = None, [], []
    for b in batches:
        others = [c for c in b.schema.names if c not in ("block", "piece", *_SLICED)]
        for r, at in enumerate(zip(b["block"].to_pylist(), b["piece"].to_pylist())):
            if at != last:
                if at[1] and last != (at[0], at[1] - 1):
                    raise ValueError(f"piece {at[1]} of block {at[0]} comes after {last}")
                held = held * bool(at[1]) + [[b[c][r].as_py() if c in ("lens", "seq") else b[c][r].values for c in _SLICED]]
                last, block = at, []
            if at[1] == PIECES - 1:
                if not block:
                    ids, lens, words, seq = zip(*held)
                    ids, words = (pa.concat_arrays(c) for c in (ids, words))
                    held = []
                    block = [pa.array([at[0]]), *(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) if isinstance(c, pa.Array) else pa.array([b"".join(c)], pa.binary()) for c in (ids, lens, words, seq))]
                yield pa.RecordBatch.from_arrays([*block, *(b[c].slice(r, 1) for c in others)], ["block", *_SLICED, *others])


class Block:
    """The postings of a block."""

    def __init__(self, ids, lens: bytes, words, seq: bytes):
        self.ids, self.lens, self.seq = ids, np.frombuffer(lens, np.int32), np.frombuffer(seq, np.int32)
        self.code = {w: i for i, w in enumerate(words)}
        self.doc = np.repeat(np.arange(len(self.lens), dtype=np.int32), self.lens)
        self.order = np.argsort(self.seq, kind="stable")
        self.start = np.concatenate(([0], np.cumsum(np.bincount(self.seq, minlength=len(words)))))

    def counts(self, unit: str) -> tuple[np.ndarray, np.ndarray]:
        """Documents, in order, in which the unit's tokens follow each other, and how often."""
        codes = [self.code.get(t) for t in unit.split(" ")]
        if None in codes:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        at = self.order[self.start[codes[0]] : self.start[codes[0] + 1]]
        for i, c in enumerate(codes[1:], 1):
            at = at[at + i < len(self.seq)]
            at = at[(self.seq[at + i] == c) & (self.doc[at + i] == self.doc[at])]
        d = self.doc[at]
        first = np.flatnonzero(np.diff(d, prepend=-1))
        return d[first], np.diff(first, append=len(d))


def _blocks(batches):
    """Every row with its block; that of the row before is used again."""
    last, known = None, None
    for b in batches:
        for r in range(b.num_rows):
            if (number := b["block"][r].as_py()) != last:
                known = Block(b["ids"][r].values, b["lens"][r].as_py(), b["words"][r].values.to_pylist(), b["seq"][r].as_py())
                last = number
            yield b, r, number, known


def frequencies(batches):
    """(unit, df) of every pair of a block and a list of ``units``."""
    for b, r, _, block in _blocks(batches):
        units = b["units"][r].values
        df = np.array([len(block.counts(u)[0]) for u in units.to_pylist()], np.int64)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([units.take(pa.array(hit)), pa.array(df[hit])], ["unit", "df"])


class Parts:
    """What each unit gives each document of a block, before its weight."""

    def __init__(self, block: Block, avg_len: float, k1: float, b: float):
        self.block, self.k1, self.n = block, k1, len(block.lens)
        self.norm = k1 * (1 - b + b * block.lens / avg_len)
        self.of: dict[str, tuple] = {}

    def __call__(self, unit: str) -> tuple[np.ndarray, np.ndarray, float, np.ndarray | None]:
        """Documents, parts, greatest part and, for a common unit, the parts of all documents."""
        if unit not in self.of:
            docs, tf = self.block.counts(unit)
            part, full = tf * (self.k1 + 1) / (tf + self.norm[docs]), None
            if len(docs) > DENSE * self.n:
                full = np.zeros(self.n)
                full[docs] = part
            self.of[unit] = docs, part, float(part.max(initial=0)), full
        return self.of[unit]


def best(batches, k: int | None, k1: float, b: float):
    """(query, doc_id, score): each query's best ``k`` documents, by score, then id, of all blocks of this task, or all for None.

    Rows: a block, and ``number``, ``asked``, ``avg_len`` of a list of queries (query, terms: unit, weight).  A query's terms
    stand by falling weight, and are added in that order everywhere, so equal texts score equally.  Once ``k``
    documents are held, terms at the end that cannot lift a document to the least of these are only looked
    up for documents that have one of the others.
    """
    held: dict[int, tuple[pa.Array, dict]] = {}  # number -> queries, place -> (scores, ids)
    kind = parts = last = None
    for row, r, number, block in _blocks(batches):
        if number != last:
            parts, last = Parts(block, row["avg_len"][r].as_py(), k1, b), number
            acc, ids, kind = np.zeros(parts.n), block.ids.to_numpy(zero_copy_only=False), block.ids.type
        asked = row["asked"][r].values
        queries, terms = asked.field("query"), asked.field("terms")
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))))
        coded = terms.flatten().field("unit").dictionary_encode()
        us, ws = coded.indices.to_numpy(zero_copy_only=False), terms.flatten().field("weight").to_numpy(zero_copy_only=False)
        of = [parts(u) for u in coded.dictionary.to_pylist()]
        most = np.array([x[2] for x in of])[us] * ws
        if (key := row["number"][r].as_py()) not in held:
            if held and sum(len(q) for q, _ in held.values()) + len(queries) > HELD:
                yield from _handed(held, kind)
                held = {}
            held[key] = queries, {}
        own = held[key][1]
        for q in range(len(queries)):
            f, t = ends[q], ends[q + 1]
            have = own.get(q)
            low = (have[0][-1] - 0.5) / UNIT - 1e-9 if have is not None and len(have[0]) == k else 0.0
            rest = np.cumsum(most[f:t][::-1])[::-1]  # the most that a term and those after it can give
            lead = f + int(np.count_nonzero(rest > low))
            if lead == f:
                continue
            acc.fill(0)
            for j in range(f, lead):
                docs, part, _, full = of[us[j]]
                if full is None:
                    acc[docs] += part * ws[j]
                else:
                    acc += full * ws[j]
            if lead == t:
                docs = np.flatnonzero(acc >= low if low > 0 else acc)
                score = acc[docs]
            else:
                docs = np.flatnonzero(acc > low - rest[lead - f])
                docs = docs[acc[docs] > 0]
                score = acc[docs]
                for j in range(lead, t):
                    some, part, _, full = of[us[j]]
                    if full is not None:
                        score += full[docs] * ws[j]
                    elif len(some):
                        at = np.minimum(np.searchsorted(some, docs), len(some) - 1)
                        score += np.where(some[at] == docs, part[at], 0.0) * ws[j]
                keep = score >= low
                docs, score = docs[keep], score[keep]
            if not len(docs):
                continue
            score = np.floor(score * UNIT + 0.5).astype(np.int64)
            if k is not None and len(docs) > k:  # documents of a block are in order of their ids
                least = np.partition(score, len(score) - k)[len(score) - k]
                over = np.flatnonzero(score > least)
                keep = np.concatenate((over, np.flatnonzero(score == least)[: k - len(over)]))
                docs, score = docs[keep], score[keep]
            own[q] = _merged(have, (score, ids[docs]), k)
        if k is None:
            yield from _handed(held, kind)
            held = {}
    yield from _handed(held, kind)


def _merged(a: tuple | None, b: tuple, k: int | None) -> tuple:
    """The first ``k`` (scores, ids) of two such lists, in order."""
    score, ids = b if a is None else (np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1])))
    if k is None:
        return score, ids
    order = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i])) if ids.dtype == object else np.lexsort((ids, -score))
    return score[order[:k]], ids[order[:k]]


def _handed(held: dict, kind):
    for queries, own in held.values():
        places, scores, ids, size = [], [], [], 0
        for n, (q, (score, found)) in enumerate(own.items(), 1):
            places.append(np.full(len(score), q))
            scores.append(score)
            ids.append(found)
            size += len(score)
            if size >= HANDED or n == len(own):
                rows = [queries.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(ids), kind), pa.array(np.concatenate(scores) / UNIT)]
                yield pa.RecordBatch.from_arrays(rows, ["query", "doc_id", "score"])
                places, scores, ids, size = [], [], [], 0
