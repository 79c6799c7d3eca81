"""Oversized symbols of source files, cut into pieces at natural boundaries.

Files are never handled whole outside the scan.  Each current file is cut into byte ranges with a
short halo on either side; everything after that works on ranges:

1. Workers detect the boundaries of their range: line starts with their strength (blank line before,
   indentation) and the nearest non-blank bytes, and, where a range has a part of a line too long for
   a piece, bit maps of its blanks and token ends.  Bit maps of bytes inside characters exist only for
   ranges that are not ASCII.  This is the boundary table; what follows needs no contents but for hashes.
2. The tables are stitched: prefix sums of line counts number the lines, and running maxima and minima
   carry the nearest non-blank byte over ranges that have none.
3. A symbol's line fields are resolved to bytes by two look-ups: which range has the line (the last
   range in order of its first line), and where in the range it starts.
4. Spans are verified against content_hash: in place where they lie in one range with its halo,
   and otherwise by hashing their range slices in order, a slice at a time.  Lines are resolved only
   for symbols whose byte fields fail.
5. A verified span is laid out in segments of ``SEGMENT`` pieces.  The cut at a segment's edge is the
   strongest boundary of the last max_bytes before it, which both neighbours find for themselves, so a
   giant symbol is cut by many workers.  Inside a segment pieces are laid from left to right: a piece
   ends at the strongest line start of its last quarter, else at the last line start it can reach.
   Only a line that no piece can hold is cut inside: at the last blank of the last quarter, else the
   last end of a token, else between characters.

Strength of line starts: a blank line before comes first, then less indentation, then the later one.

A cell of a table holds at most 2 GB, so a file has at most some 33,000 ranges and a symbol some
millions of pieces; windows per file run over ranges and asked lines, windows per symbol over pieces.

Defined results: only paths whose current state is present and has bytes; a module's text is its
whole file; other symbols need a span whose SHA-256 is content_hash.  Repeated symbol rows count
once.  Kinds without a limit, or with a null one, are not cut.  Empty files and empty tables give
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tessella.llm.docpairs import current_files
from tessella.plans.scratch import Scratch

#: Bytes of a range without its halo.
RANGE = 1 << 16
#: Bytes of a halo.
HALO = 1 << 12
#: The last part of a piece, in which the strongest boundary is the cut.
ZONE = 0.25
#: Pieces of a segment, about; bounds what one worker holds of a symbol.
SEGMENT = 32
FILE = ["repo_id", "path"]

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 11, 12, 13, 32]] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[[i for i in range(256) if i >= 128 or chr(i).isalnum() or chr(i) == "_"]] = True
_FAR = 1 << 30
_TABLE = (
    "repo_id string, path string, range_no long, n_lines long, first_ink long, last_ink long, starts array<int>, ends_before array<int>, inks_after array<int>,"
    " strengths array<int>, blanks binary, tokens binary, inside binary"
)
#: Boundaries by name, weakest first.
NAMES = ("character", "token", "blank", "line", "blank line", "end")


def byte_ranges(files: DataFrame, halo: int, width: int = RANGE) -> DataFrame:
    """(repo_id, path, size, range_no, begin, data): data is [begin - halo, begin + width + halo), clipped."""
    sized = files.withColumn("size", F.octet_length("bytes").cast("long")).filter("size > 0")
    each = sized.withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / width))))
    begin = F.greatest(F.lit(0), F.col("range_no") * width - halo)
    length = (F.col("range_no") + 1) * width + halo - begin
    return each.select(*FILE, "size", "range_no", begin.alias("begin"), F.substr("bytes", (begin + 1).cast("int"), length.cast("int")).alias("data"))


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _strengths(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The strength of each line start: less indentation counts more, a blank line before most."""
    n = len(data)
    index = np.arange(n)
    newline, ink = data == 10, ~_BLANK[data]
    next_nl = np.minimum.accumulate(np.where(newline, index, _FAR)[::-1])[::-1]
    next_ink = np.minimum.accumulate(np.where(ink, index, _FAR)[::-1])[::-1]
    last_nl = np.maximum.accumulate(np.where(newline, index, -1))
    last_ink = np.maximum.accumulate(np.where(ink, index, -1))
    some = np.minimum(at, n - 1)
    bare = next_ink[some] > next_nl[some]  # the line itself is blank
    indent = np.where(bare | (next_ink[some] >= _FAR), 1 << 20, np.minimum(next_ink[some] - some, (1 << 20) - 1))
    before = np.maximum(at - 1, 0)  # the line end before the start
    above = np.where(before > 0, last_nl[np.maximum(before - 1, 0)], -1)
    after_blank = (at > 0) & (before > 0) & (last_ink[before] <= above) & ~bare & (next_ink[some] < _FAR)
    return ((after_blank.astype(np.int64) << 21) + (1 << 20) - indent).astype(np.int32)


def _boundary_table(width: int, long_line: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, firsts, lasts, ends, flat, maps = [], [], [], [0], ([], [], [], []), ([], [], [])
            for i in range(b.num_rows):
                range_no, begin = b.column(2)[i].as_py(), b.column(3)[i].as_py()
                data = np.frombuffer(b.column(4)[i].as_buffer(), np.uint8)
                lo = range_no * width - begin  # the range's own bytes
                own = data[lo : lo + width]
                at = np.flatnonzero(own == 10) + 1  # a start at the range's end belongs to this range
                if range_no == 0:
                    at = np.r_[0, at]
                # the byte after the file's last line end starts a line only if it is there
                at = at[at < len(data) - lo]
                ink = ~_BLANK[own]
                index = np.arange(len(own))
                before = np.maximum.accumulate(np.where(ink, index + 1, -1)) if len(own) else index
                after = np.minimum.accumulate(np.where(ink, index, _FAR)[::-1])[::-1] if len(own) else index
                base = range_no * width
                eb = np.where(at > 0, before[np.maximum(at - 1, 0)], -1)
                ia = np.where(at < len(own), after[np.minimum(at, len(own) - 1)], _FAR)
                flat[0].append(at)
                flat[1].append(eb)
                flat[2].append(np.where(ia >= _FAR, -1, ia))
                flat[3].append(_strengths(data, at + lo))
                ends.append(ends[-1] + len(at))
                counts.append(len(at))
                firsts.append(base + int(after[0]) if after[0] < _FAR else None)
                lasts.append(base + int(before[-1]) if before[-1] > 0 else None)
                # bit p is about a cut before byte p of the range
                edges = np.r_[0, np.flatnonzero(data == 10) + 1, len(data)]
                right = len(data) - lo - len(own)
                beyond = (lo and edges[1] > lo) or (right and len(data) - edges[-2] > right)  # a line that fills a halo
                if beyond or np.diff(edges).max() > long_line:
                    left = np.r_[0, data[: len(data) - 1]][lo : lo + len(own)]
                    maps[0].append(_bits(_SPACE[left]))
                    maps[1].append(_bits(~(_TOKEN[left] & _TOKEN[own]) & (left != 92)))
                else:
                    maps[0].append(None), maps[1].append(None)
                maps[2].append(_bits((own & 0xC0) == 0x80) if (own >= 128).any() else None)
            offsets = pa.array(np.array(ends, np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32))) if x else pa.array([], pa.list_(pa.int32())) for x in flat]
            cols = [b.column(0), b.column(1), b.column(2), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64()), *lists, *(pa.array(m, pa.binary()) for m in maps)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.strip().split(" ")[0] for f in _TABLE.split(",")])

    return run


def boundary_tables(ranges: DataFrame, width: int = RANGE, long_line: int = 1) -> DataFrame:
    """Per range its line starts (offsets within the range) with their strength and the non-blank bytes next to them.

    ``blanks`` and ``tokens`` are there where a line may be longer than ``long_line``.
    """
    return ranges.select(*FILE, "range_no", "begin", "data").mapInArrow(_boundary_table(width, long_line), _TABLE)


def stitched(tables: DataFrame) -> DataFrame:
    """Per range: lines before it, the last non-blank end before it, the first non-blank byte after it."""
    order = W.partitionBy(*FILE).orderBy("range_no")
    past, ahead = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    return tables.select(
        *FILE,
        "range_no",
        "n_lines",
        "last_ink",
        F.coalesce(F.sum("n_lines").over(past), F.lit(0)).alias("lines_before"),
        F.max("last_ink").over(past).alias("ink_before"),
        F.min("first_ink").over(ahead).alias("ink_behind"),
    )


def line_spans(symbols: DataFrame, tables: DataFrame, width: int = RANGE) -> DataFrame:
    """(symbol_id, begin, end) of the bytes that the line fields name, without blanks at either end."""
    seams = stitched(tables)
    per_file = seams.groupBy(*FILE).agg(F.sum("n_lines").alias("all_lines"), F.max("last_ink").alias("file_end"))
    asked = symbols.filter("line_start >= 1 AND line_end >= line_start").join(per_file, FILE).filter("line_end <= all_lines")
    lines = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("line_start").alias("line")), F.struct(F.lit(1).alias("side"), (F.col("line_end") + 1).alias("line"))))
    look = asked.select(*FILE, "symbol_id", "content_hash", "all_lines", "file_end", lines.alias("l")).select("*", "l.side", F.col("l.line").cast("long").alias("line")).drop("l")
    # a line lies in the last range whose first line is no later
    marks = seams.filter("n_lines > 0").select(*FILE, (F.col("lines_before") + 1).alias("line"), "range_no", "lines_before")
    both = look.withColumn("asks", F.lit(True)).unionByName(marks.withColumn("asks", F.lit(False)), allowMissingColumns=True)
    past = W.partitionBy(*FILE).orderBy("line", "asks").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("range_no", F.last("range_no", True).over(past)).withColumn("lines_before", F.last("lines_before", True).over(past)).filter("asks")
    look = found.select(
        *FILE, "symbol_id", "content_hash", "side", "file_end", (F.col("line") > F.col("all_lines")).alias("past_end"), "range_no", (F.col("line") - F.col("lines_before")).cast("int").alias("nth")
    )
    full = tables.select(*FILE, "range_no", "starts", "ends_before", "inks_after").join(seams.drop("n_lines", "lines_before", "last_ink"), [*FILE, "range_no"])
    hit = look.join(full, [*FILE, "range_no"])
    base = F.col("range_no") * width
    end = F.try_element_at("ends_before", F.col("nth"))
    ink_after = F.try_element_at("inks_after", F.col("nth"))
    at = F.when(
        F.col("side") == 0, F.when(ink_after >= 0, base + ink_after).otherwise(F.col("ink_behind"))
    ).otherwise(F.when(F.col("past_end"), F.col("file_end")).when(end >= 0, base + end).otherwise(F.col("ink_before")))
    both = hit.select(*FILE, "symbol_id", "content_hash", "side", at.alias("at")).groupBy(*FILE, "symbol_id", "content_hash")
    return both.agg(F.max(F.when(F.col("side") == 0, F.col("at"))).alias("begin"), F.max(F.when(F.col("side") == 1, F.col("at"))).alias("end")).filter("end > begin")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash the slices of each span as they come, in order; a span's rows lie next to each other."""
    now, h, out = None, None, []
    for b in batches:
        for sid, begin, end, want, data in zip(b["symbol_id"], b["span_begin"], b["span_end"], b["content_hash"], b["slice"]):
            key = (sid, begin, end, want)
            if key != now:
                if now is not None and h.hexdigest() == now[3]:
                    out.append(now[:3])
                now, h = key, hashlib.sha256()
            h.update(data)
        if out:
            yield pd.DataFrame(out, columns=["symbol_id", "span_begin", "span_end"])
            out = []
    if now is not None and h.hexdigest() == now[3]:
        yield pd.DataFrame([now[:3]], columns=["symbol_id", "span_begin", "span_end"])


class Oversized:
    """The plan from symbols, snapshots and limits to oversized symbols and their pieces."""

    def __init__(self, symbols: DataFrame, snapshots: DataFrame, limits: DataFrame, width: int = RANGE):
        self.width = width
        self.scratch = Scratch(symbols.sparkSession)
        limits = limits.groupBy("kind").agg(F.min("max_bytes").alias("max_bytes"), F.min("overlap_bytes").alias("overlap_bytes"))
        self.limits = limits.filter("max_bytes > 0").withColumn("overlap_bytes", F.least(F.greatest(F.coalesce("overlap_bytes", F.lit(0)), F.lit(0)), F.expr("max_bytes div 2")))
        least = self.limits.agg(F.min(F.col("max_bytes") - F.col("overlap_bytes"))).first()[0] or 1
        self.ranges = self.scratch.cut(byte_ranges(current_files(snapshots), min(HALO, width), width))
        self.tables = self.scratch.cut(boundary_tables(self.ranges, width, int(least)))
        cols = ["repo_id", "symbol_id", "path", "kind", "line_start", "line_end", "byte_start", "byte_end", "content_hash"]
        once = symbols.select(cols).filter(F.col("symbol_id").isNotNull()).dropDuplicates().join(self.limits, "kind")
        self.symbols = self.scratch.cut(self._checked(once))

    def _checked(self, once: DataFrame) -> DataFrame:
        """Symbols with their file's size and whether their byte fields are right.

        ``held`` is true or false where the named bytes lie in one range with its halo and were
        hashed there, and null where they do not.
        """
        w = self.width
        module = F.col("kind") == "module"
        named = ~module & (F.col("byte_start") >= 0) & (F.col("byte_end") > F.col("byte_start"))
        keyed = once.withColumn("range_no", F.when(named, F.floor(F.col("byte_start") / w)).otherwise(0).cast("long"))
        data = self.ranges.select(*FILE, "range_no", "size", F.col("begin").alias("data_begin"), "data")
        data_end = F.col("data_begin") + F.octet_length("data")
        text = F.substr("data", (F.col("byte_start") - F.col("data_begin") + 1).cast("int"), (F.col("byte_end") - F.col("byte_start")).cast("int"))
        held = (
            F.when(~F.coalesce(named, F.lit(False)) | F.col("size").isNull() | (F.col("byte_end") > F.col("size")), False)
            .when(F.col("byte_end") > data_end, F.lit(None))
            .otherwise(F.sha2(text, 256) == F.lower("content_hash"))
        )
        joined = keyed.join(data, [*FILE, "range_no"], "left")
        out = joined.select(*[c for c in once.columns if c != "content_hash"], "size", F.when(module, True).otherwise(held).alias("held"), "content_hash")
        return out.withColumn("content_hash", F.when(F.coalesce("held", F.lit(False)), F.lit(None)).otherwise(F.lower("content_hash")))

    def spans(self) -> DataFrame:
        """Verified spans over the limit: repo_id, path, symbol_id, kind, span_begin, span_end, max_bytes, overlap_bytes."""
        columns = [*FILE, "symbol_id", "kind", "span_begin", "span_end", "max_bytes", "overlap_bytes"]
        module = F.col("kind") == "module"
        held = self.symbols.filter("held AND size IS NOT NULL")
        held = held.withColumn("span_begin", F.when(module, 0).otherwise(F.col("byte_start")).cast("long")).withColumn("span_end", F.when(module, F.col("size")).otherwise(F.col("byte_end")).cast("long"))
        held = held.filter("span_end - span_begin > max_bytes").select(columns)
        # the rest, by far the fewer: the line fields are resolved, and what is too long is hashed
        rest = self.symbols.filter("(held IS NULL OR NOT held) AND kind <> 'module'")
        by_line = line_spans(rest, self.tables, self.width).select(*FILE, "symbol_id", "content_hash", "begin", "end")
        by_byte = rest.filter("held IS NULL").select(*FILE, "symbol_id", "content_hash", F.col("byte_start").cast("long").alias("begin"), F.col("byte_end").cast("long").alias("end"))
        about = rest.select("symbol_id", *FILE, "content_hash", "kind", "max_bytes", "overlap_bytes").dropDuplicates(["symbol_id", *FILE, "content_hash"])
        long = by_line.unionByName(by_byte).distinct().join(about, ["symbol_id", *FILE, "content_hash"]).filter("end - begin > max_bytes")
        w = self.width
        parts = long.withColumn("range_no", F.explode(F.sequence(F.floor(F.col("begin") / w), F.floor((F.col("end") - 1) / w))))
        data = self.ranges.select(*FILE, "range_no", F.col("begin").alias("data_begin"), "data").join(parts.select(*FILE, "range_no").distinct(), [*FILE, "range_no"], "left_semi")
        cut_from = F.greatest("begin", F.col("range_no") * w)
        cut_to = F.least("end", (F.col("range_no") + 1) * w)
        slices = parts.join(data, [*FILE, "range_no"]).select(
            "symbol_id", F.col("begin").alias("span_begin"), F.col("end").alias("span_end"), "content_hash", "range_no",
            F.substr("data", (cut_from - F.col("data_begin") + 1).cast("int"), (cut_to - cut_from).cast("int")).alias("slice"),
        )
        keys = ["symbol_id", "span_begin", "span_end", "content_hash"]
        in_order = slices.repartition(*keys).sortWithinPartitions(*keys, "range_no")
        right = in_order.mapInPandas(_digests, "symbol_id long, span_begin long, span_end long")
        verified = long.withColumnsRenamed({"begin": "span_begin", "end": "span_end"}).join(right, ["symbol_id", "span_begin", "span_end"], "left_semi")
        return held.unionByName(verified.select(columns)).dropDuplicates(["symbol_id"])

    def pieces(self) -> DataFrame:
        """symbol_id, piece (from 1), byte_start, byte_end (in the file), boundary (what the piece ends at)."""
        w = self.width
        spans = self.scratch.cut(self.spans())
        size = F.greatest((F.col("max_bytes") - F.col("overlap_bytes")).cast("long"), F.lit(1)) * SEGMENT
        last = F.greatest(F.lit(0), F.ceil((F.col("span_end") - F.col("span_begin") - F.col("max_bytes")) / size) - 1).cast("long")
        laid = spans.withColumn("size", size).withColumn("seg", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("is_last", F.col("seg") == last)
        lo = F.col("span_begin") + F.col("seg") * F.col("size")
        laid = laid.withColumn("edge_from", lo).withColumn("edge_to", F.when(F.col("is_last"), F.col("span_end")).otherwise(lo + F.col("size"))).drop("size", "is_last")
        # a segment begins somewhere in the max_bytes before its edge
        first = F.greatest("span_begin", F.col("edge_from") - F.col("max_bytes") - F.col("overlap_bytes") - 8)
        parts = laid.withColumn("range_no", F.explode(F.sequence(F.floor(first / w), F.floor((F.col("edge_to") - 1) / w))))
        tables = self.tables.select(*FILE, "range_no", "starts", "strengths", "blanks", "tokens", "inside")
        rows = parts.join(tables, [*FILE, "range_no"]).select("symbol_id", "seg", "range_no", "span_begin", "span_end", "edge_from", "edge_to", "max_bytes", "overlap_bytes", "starts", "strengths", "blanks", "tokens", "inside")
        in_order = rows.repartition("symbol_id", "seg").sortWithinPartitions("symbol_id", "seg", "range_no")
        cut = in_order.mapInPandas(_lay_segments(w), "symbol_id long, byte_start long, byte_end long, boundary string")
        order = W.partitionBy("symbol_id").orderBy("byte_end")
        return cut.select("symbol_id", F.row_number().over(order).alias("piece"), "byte_start", "byte_end", "boundary")


class Boundaries:
    """The boundary tables of neighbouring ranges as one; positions are bytes of the file."""

    def __init__(self, width: int, ranges: list[tuple]):
        """ranges: (range_no, starts, strengths, blanks, tokens, inside), in order and without gaps."""
        self.base = ranges[0][0] * width
        size = len(ranges) * width
        self.starts = np.concatenate([np.asarray(r[1], np.int64) + r[0] * width for r in ranges])
        self.strengths = np.concatenate([np.asarray(r[2], np.int64) for r in ranges])
        self.maps = []
        for which in (3, 4, 5):
            if all(r[which] is None for r in ranges):
                self.maps.append(None)
                continue
            flags = np.zeros(size, bool)
            for k, r in enumerate(ranges):
                if r[which] is not None:
                    bits = np.unpackbits(np.frombuffer(r[which], np.uint8))[:width]
                    flags[k * width : k * width + len(bits)] = bits
            self.maps.append(flags)

    def best_line(self, lo: int, hi: int) -> tuple[int, str] | None:
        """The strongest line start in [lo, hi]; of equals the last."""
        a, z = np.searchsorted(self.starts, lo), np.searchsorted(self.starts, hi, "right")
        if a >= z:
            return None
        k = z - 1 - int(np.argmax(self.strengths[a:z][::-1]))
        return int(self.starts[k]), "blank line" if self.strengths[k] >> 21 else "line"

    def last_line(self, lo: int, hi: int) -> tuple[int, str] | None:
        z = int(np.searchsorted(self.starts, hi, "right")) - 1
        if z < 0 or self.starts[z] < lo:
            return None
        return int(self.starts[z]), "blank line" if self.strengths[z] >> 21 else "line"

    def inner(self, lo: int, hi: int) -> tuple[int, str]:
        """The last blank in [lo, hi], or else the last end of a token, or else of a character."""
        for flags, name in ((self.maps[0], "blank"), (self.maps[1], "token")):
            if flags is not None:
                at = np.flatnonzero(flags[max(0, lo - self.base) : hi + 1 - self.base])
                if len(at):
                    return max(lo, self.base) + int(at[-1]), name
        p = hi
        while p > lo and self.cuts_character(p):
            p -= 1
        return p, "character"

    def cuts_character(self, p: int) -> bool:
        flags, i = self.maps[2], p - self.base
        return flags is not None and 0 <= i < len(flags) and bool(flags[i])

    def resume(self, cut: int, overlap: int, begin: int) -> int:
        """Where the piece after a cut begins: ``overlap`` bytes before it, or a little less, at a character."""
        back = max(begin, cut - overlap)
        while back < cut and self.cuts_character(back):
            back += 1
        return back

    def edge(self, at: int, span: tuple[int, int], most: int) -> tuple[int, str]:
        """The cut that belongs to a segment's edge."""
        lo = max(span[0] + 1, at - most + 1)
        return self.best_line(lo, at) or self.inner(max(lo, at - int(most * ZONE)), at)

    def lay(self, span: tuple[int, int], edges: tuple[int, int], most: int, overlap: int) -> Iterator[tuple[int, int, str]]:
        """(begin, end, boundary) of the pieces of a segment, from left to right."""
        cut = span[0] if edges[0] <= span[0] else self.edge(edges[0], span, most)[0]
        stop, name = (span[1], "end") if edges[1] >= span[1] else self.edge(edges[1], span, most)
        while cut < stop:
            begin = self.resume(cut, overlap, span[0]) if cut > span[0] else cut
            far = begin + most
            if stop <= far:
                yield begin, stop, name
                return
            least = max(cut, begin + overlap) + 1  # so that the next piece begins later than this one
            zone = max(least, far - int(most * ZONE))
            at, kind = self.best_line(zone, far) or self.last_line(least, far) or self.inner(zone, far)
            if at <= cut:  # a character longer than the piece
                at = min(cut + most, stop)
            yield begin, at, kind
            cut = at


def _lay_segments(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, about = None, [], None

        def laid() -> list[tuple]:
            begin, end, edge_from, edge_to, most, overlap = about
            table = Boundaries(width, held)
            return [(now[0], *p) for p in table.lay((begin, end), (edge_from, edge_to), most, overlap)]

        for b in batches:
            out = []
            for sid, seg, range_no, begin, end, edge_from, edge_to, most, overlap, *table in b.itertuples(index=False, name=None):
                if (sid, seg) != now:
                    if now is not None:
                        out += laid()
                    now, held, about = (sid, seg), [], (begin, end, edge_from, edge_to, most, overlap)
                held.append((range_no, *table))
            if out:
                yield pd.DataFrame(out, columns=["symbol_id", "byte_start", "byte_end", "boundary"])
        if now is not None:
            yield pd.DataFrame(laid(), columns=["symbol_id", "byte_start", "byte_end", "boundary"])

    return run


def best_cut(view: bytes, lo: int, hi: int) -> tuple[int, str]:
    """The strongest boundary in ``view`` at positions [lo, hi], and its name."""
    data = np.frombuffer(view, np.uint8)
    at = np.r_[0, np.flatnonzero(data == 10) + 1]
    at = at[at < len(data)]
    left = np.r_[0, data[:-1]]
    maps = (_SPACE[left], ~(_TOKEN[left] & _TOKEN[data]) & (left != 92), (data & 0xC0) == 0x80)
    table = Boundaries(len(view), [(0, at, _strengths(data, at), *map(_bits, maps))])
    return table.best_line(max(1, lo), hi) or table.inner(max(1, lo), min(hi, len(view) - 1))
