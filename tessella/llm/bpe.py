"""Corpus encoding by a byte-level BPE vocabulary, as a bounded-lookahead streaming transducer.

The vocabulary is a merge list.  Two facts make a left-to-right encoder possible:

* A token sequence is what the merge list makes of its bytes exactly if every adjacent pair is
  *stable*: no merge across their seam comes before the merges that hide its parts inside the two
  tokens.  ``MergeList.stable`` decides that from the merge trees of the two tokens alone.
* So for every prefix of the input there is exactly one token that ends it: the one, of those that
  end there, whose seam with the last token of what precedes it is stable.  These last tokens form
  a tree over positions, and a token is final once the paths from all positions that a later token
  could still build on (the last ``max_token`` bytes) run through its end.

``Transducer`` keeps only the positions from the last final token on.  The number of bytes it may
have to look ahead is bounded by ``MergeList.sufficient_lookahead`` (merges x longest merge, the
general bound for a proper merge list), and is a few tokens in practice.  A window that outgrows the
bound is an error and never a guess, so memory is constant in the length of the input.

Before the merges the text is split by the pattern that the vocabulary's file names; a file with
another pre-tokenizer, a normalizer or other options than a plain byte-level merge list is refused.
Splitting streams over the value too; frequent pieces are remembered in a table of bounded size.

The vocabulary's path is a parameter.  The driver hands the file to executors that lack it.

Defined results: null and empty texts give no ids; blank texts and strings that look like special
tokens are ordinary text.
"""

from __future__ import annotations

import codecs
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from tessella.plans.ship import ship
from tessella.plans.spread import spread

# Fixed value: the public split pattern of the byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Where the vocabulary lies unless the caller says otherwise.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
REMEMBERED_PIECES = 200_000
REMEMBERED_LENGTH = 64
#: A piece longer than this is encoded with the sliding window.
WINDOW = 1024


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


def split_pattern(file: dict) -> str:
    """The pattern by which a ``tokenizers`` file splits texts before merging; ValueError if it needs more than that."""
    model = file["model"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or odd or file.get("normalizer"):
        raise ValueError(f"not a plain byte-level merge list: {odd or file.get('normalizer') or model.get('type')}")
    first = file.get("pre_tokenizer") or {}
    steps = first.get("pretokenizers", [first])
    pattern = None
    for step in steps:
        if step.get("type") == "ByteLevel" and not step.get("add_prefix_space"):
            pattern = pattern or (SPLIT if step.get("use_regex", True) else None)
        elif step.get("type") == "Split" and "Regex" in step.get("pattern", {}) and step.get("behavior") == "Isolated" and pattern is None:
            pattern = step["pattern"]["Regex"]
        else:
            raise ValueError(f"another pre-tokenizer than a split into pieces: {step.get('type')}")
    if pattern is None:
        raise ValueError("the vocabulary names no split pattern")
    return pattern


class MergeList:
    """A byte-level merge list: token bytes, ids, merge ranks, and what follows from them."""

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]], split: str | None = None):
        self.ids = ids
        self.split = split or SPLIT
        self.bytes_of = {i: b for b, i in ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> (left, right, rank)
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._stable: dict[tuple[int, int], bool] = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault((ids[a], ids[b]), r)
        # a token is usable if its own bytes come to it: its halves are, and no earlier merge crosses
        # their seam; other entries (special tokens, shadowed merges) are never produced
        self.usable = {b: i for b, i in ids.items() if len(b) == 1}
        for r, (a, b) in enumerate(merges):
            if a + b not in self.usable and a in self.usable and b in self.usable and not self._crossed(ids[a], ids[b], r):
                self.made[ids[a + b]] = (ids[a], ids[b], r)
                self.usable[a + b] = ids[a + b]
        self.max_token = max(map(len, self.usable))
        self.suffixes = {b[k:] for b in self.usable for k in range(len(b))}

    @classmethod
    def load(cls, path: str) -> MergeList:
        """From a ``tokenizers`` JSON file of a byte-level BPE."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, split = file["model"], split_pattern(file)
        alphabet = _byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        merges = [(to_bytes(a), to_bytes(b)) for a, b in merges]
        parts = {a + b for a, b in merges}
        ids = {}
        for s, i in model["vocab"].items():
            if all(c in alphabet for c in s):
                b = to_bytes(s)
                if len(b) == 1 or b in parts:
                    ids[b] = i
        return cls(ids, merges, split)

    def sufficient_lookahead(self) -> int:
        """Bytes after which a token of any text is settled: merges times the longest merge."""
        return len(self.rank) * self.max_token

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of a token at one edge, with the rank at which each is merged away."""
        out, gone = [], float("inf")
        while True:
            out.append((token, gone))
            if token not in self.made:
                return out
            *halves, gone = self.made[token]
            token = halves[side]

    def stable(self, a: int, b: int) -> bool:
        """Whether the merge list leaves the seam between tokens ``a`` and ``b`` alone."""
        known = self._stable.get((a, b))
        if known is None:
            if len(self._stable) > 2_000_000:
                self._stable.clear()
            known = self._stable[a, b] = not self._crossed(a, b, float("inf"))
        return known

    def _crossed(self, a: int, b: int, before: float) -> bool:
        """Whether some merge of lower rank than ``before`` joins parts on either side of the seam."""
        if a not in self._right:
            self._right[a] = self._spine(a, 1)
        if b not in self._left:
            self._left[b] = self._spine(b, 0)
        for x, x_gone in self._right[a]:
            for y, y_gone in self._left[b]:
                r = self.rank.get((x, y))
                # of equal merges the leftmost comes first: one inside a wins, one inside b does not
                if r is not None and r < before and r < x_gone and r <= y_gone:
                    return True
        return False


class Transducer:
    """Encodes one piece fed in any portions; ids come out as soon as they are final."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.tail = b""  # bytes of the positions still held
        self.last: list[int] = [-1]  # last[i]: the token that ends the first i held bytes
        self.size: list[int] = [0]
        self.before = -1  # the last final token
        self.bound = merges.sufficient_lookahead() + merges.max_token
        self.peak = 0

    def feed(self, data: bytes) -> Iterator[int]:
        for i in range(0, len(data), WINDOW):
            part = data[i : i + WINDOW]
            self.tail += part
            self._extend()
            self.peak = max(self.peak, len(self.tail))
            if len(self.tail) >= WINDOW:
                yield from self._settle()
                if len(self.tail) > self.bound:
                    raise RuntimeError(f"{len(self.tail)} bytes are held, more than the merge list can need ({self.bound})")

    def _extend(self) -> None:
        m, tail, last, size = self.m, self.tail, self.last, self.size
        suffixes, usable, stable, longest = m.suffixes, m.usable, m.stable, m.max_token
        for end in range(len(last), len(tail) + 1):
            found, ending = [], 1
            while ending <= end and ending <= longest:
                s = tail[end - ending : end]
                if s not in suffixes:
                    break
                t = usable.get(s)
                if t is not None:
                    found.append((t, ending))
                ending += 1
            for t, n in reversed(found):
                prior = last[end - n] if end > n else self.before
                if prior < 0 or stable(prior, t):
                    last.append(t)
                    size.append(n)
                    break
            else:
                raise AssertionError("every byte is a token, so one token always fits")

    def _settle(self) -> Iterator[int]:
        """Emit the tokens before the last position that all later tokens build on."""
        live = set(range(max(0, len(self.tail) - self.m.max_token + 1), len(self.tail) + 1))
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(top - self.size[top])
        yield from self._emit(live.pop())

    def _emit(self, upto: int) -> list[int]:
        out, at = [], upto
        while at:
            out.append(self.last[at])
            at -= self.size[at]
        out.reverse()
        if out:
            self.before = out[-1]
            self.tail = self.tail[upto:]
            self.last = [-1, *self.last[upto + 1 :]]
            self.size = [0, *self.size[upto + 1 :]]
        return out

    def finish(self) -> list[int]:
        return self._emit(len(self.tail))


class Encoder:
    """Text to ids: split by the public pattern, then one transducer per piece."""

    def __init__(self, merges: MergeList, split: str | None = None):
        self.merges = merges
        self.split = regex.compile(split or merges.split)
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        t = Transducer(self.merges)
        out = list(t.feed(piece.encode("utf-8", "surrogatepass")))
        return tuple(out + t.finish())

    def pieces(self, text: str | None) -> Iterator[tuple[int, ...]]:
        known = self.known
        for match in self.split.finditer(text or ""):
            p = match.group()
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= REMEMBERED_LENGTH:
                    if len(known) >= REMEMBERED_PIECES:
                        known.clear()
                    known[p] = ids
            yield ids

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.pieces(text) for i in ids]

    def count(self, text: str | None) -> int:
        return sum(map(len, self.pieces(text)))


class Decoder:
    """Ids to text, a few ids at a time: bytes run through an incremental UTF-8 state machine."""

    def __init__(self, merges: MergeList):
        self.bytes_of = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(self.bytes_of[i] for i in ids))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary; a file that is not at its path here was handed over."""
    return Encoder(MergeList.load(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))))


def hand_over(docs: DataFrame, path: str) -> None:
    """Give the vocabulary's file, and this package, to the executors; once per application."""
    sc = docs.sparkSession.sparkContext
    ship(docs.sparkSession)
    if (sc.applicationId, path) not in _handed and os.path.exists(path):
        sc.addFile(path)
        _handed.add((sc.applicationId, path))


_handed: set[tuple[str, str]] = set()


def encode_corpus(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: one narrow stage over the scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            for start in range(0, b.num_rows, 256):  # short lists, so long texts stay few at a time
                part = b.slice(start, 256)
                flat, ends = [], [0]
                for text in part.column(1):
                    for ids in enc.pieces(text.as_py()):
                        flat.extend(ids)
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    hand_over(docs, vocabulary)
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return spread(kept).mapInArrow(run, "doc_id long, ids array<int>")


def count_tokens(docs: DataFrame, keys: list[str], vocabulary: str = DEFAULT_VOCABULARY, text_col: str = "text") -> DataFrame:
    """``keys`` of every row and its number of tokens, ``n_tokens``; only the texts enter Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            n = pa.array([enc.count(t.as_py()) for t in b.column(b.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], "n_tokens"])

    hand_over(docs, vocabulary)
    given = docs.select(*keys, F.col(text_col).alias("__text"))
    schema = given.drop("__text").schema.add("n_tokens", "long")
    return spread(given).mapInArrow(run, schema)


def decode_corpus(encoded: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = encoder(vocabulary).merges
        for b in batches:
            texts = []
            for ids in b.column(1).to_pylist():
                d, parts = Decoder(merges), []
                for i in range(0, len(ids or ()), 4096):
                    parts.append(d.feed(ids[i : i + 4096]))
                texts.append("".join(parts) + d.finish())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    hand_over(encoded, vocabulary)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
