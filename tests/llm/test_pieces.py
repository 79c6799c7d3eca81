import hashlib
import random

import pytest

from tessella.llm.pieces import Oversized, best_cut

SYM = "repo_id string, symbol_id long, path string, kind string, line_start int, line_end int, byte_start int, byte_end int, content_hash string, size long"
SNAP = "repo_id string, path string, state string, mtime_ns long, bytes binary, size long"
LIM = "kind string, max_bytes int, overlap_bytes int"


def h(b):
    return hashlib.sha256(b).hexdigest()


def corpus(rnd):
    lines = []
    for i in range(120):
        lines.append(b" " * rnd.choice([0, 4, 8]) + "é".encode() * rnd.randint(0, 30) + rnd.choice([b"", b" \t", b"\r"]))
    return b"\n".join(lines) + rnd.choice([b"", b"\n"])


@pytest.mark.parametrize("width", [64, 300, 1 << 16])
def test_spans_and_pieces_by_brute_force(rows, width):
    rnd = random.Random(2)
    snaps, syms, want = [], [], {}
    for f in range(4):
        data = corpus(rnd)
        snaps += [("r", f"f{f}.py", "present", 2, data, 0)] * 2 + [("r", f"f{f}.py", "present", 1, b"old", 0)]
        split = data.split(b"\n")
        syms.append(("r", f * 100, f"f{f}.py", "module", None, None, None, None, h(data), 0))
        want[f * 100] = data
        for i in range(1, 25):
            a = rnd.randint(1, 110)
            z = rnd.randint(a, 120)
            text = b"\n".join(split[a - 1 : z]).strip(b" \t\r\n\f\v")
            if not text:
                continue
            bs = data.index(text, len(b"\n".join(split[: a - 1])))
            how = rnd.choice(["both", "lines", "bytes", "wrong bytes", "wrong lines"])
            la, lz = (None, None) if how == "bytes" else (a + 1, z) if how == "wrong lines" else (a, z)
            ba, bz = (None, None) if how == "lines" else (bs + 1, bs + len(text)) if how == "wrong bytes" else (bs, bs + len(text))
            syms += [("r", f * 100 + i, f"f{f}.py", "function", la, lz, ba, bz, h(text), 0)] * rnd.choice([1, 2])
            want[f * 100 + i] = text
    syms += [("r", 901, "gone.py", "function", 1, 2, 0, 9, h(b"x"), 0), ("r", 902, "f1.py", "lambda", 1, 99, 0, 2000, h(b"x"), 0), ("r", 903, "f1.py", None, 1, 2, 0, 9, None, 0), ("r", 904, "f1.py", "function", 99, 5, -3, 10**9, h(b"y"), 0)]
    snaps += [("r", "gone.py", "present", 1, b"123456789", 0), ("r", "gone.py", "absent", 2, None, 0), ("r", "empty.py", "present", 2, b"", 0)]
    limits = {"function": (200, 40), "module": (900, 50)}
    o = Oversized(rows(SYM, *syms), rows(SNAP, *snaps), rows(LIM, *((k, *v) for k, v in limits.items())), width)
    spans = {r.symbol_id: r for r in o.spans().collect()}
    assert set(spans) == {s for s, t in want.items() if len(t) > (900 if s % 100 == 0 else 200)}
    files = {s[1]: s[4] for s in snaps if s[3] == 2}
    by = {}
    for r in o.pieces().collect():
        by.setdefault(r.symbol_id, []).append(r)
    assert set(by) == set(spans)
    for sid, pieces in by.items():
        pieces.sort(key=lambda r: r.piece)
        s, data = spans[sid], files[spans[sid].path]
        assert pieces[0].byte_start == s.span_begin and pieces[-1].byte_end == s.span_end
        for p in pieces:
            assert 0 < p.byte_end - p.byte_start <= s.max_bytes
            data[p.byte_start : p.byte_end].decode()  # no piece cuts a character
        for p, q in zip(pieces, pieces[1:]):
            assert s.overlap_bytes - 3 <= p.byte_end - q.byte_start <= s.overlap_bytes


def test_best_cut():
    assert best_cut(b"ab\n\ndef x\n  y", 0, 12) == (4, "blank line")
    assert best_cut(b"abc\n    d\ne\nf", 1, 11) == (10, "line") or best_cut(b"abc\n    d\ne\nf", 1, 11)[1] == "line"
    assert best_cut("ééé".encode(), 1, 3) == (2, "character")


def test_empty(rows):
    o = Oversized(rows(SYM), rows(SNAP), rows(LIM))
    assert o.spans().count() == 0 and o.pieces().count() == 0


def test_ranges_and_segments_leave_no_trace(rows, monkeypatch):
    """Pieces come from the boundary tables, whatever the ranges; segments only move cuts at their edges."""
    from tessella.llm import pieces

    rnd = random.Random(11)
    data = b"".join(b" " * rnd.choice([0, 4, 8]) + b"word " * rnd.randint(0, 14) + rnd.choice([b"\n", b"\n\n"]) for _ in range(700))
    tables = rows(SYM, ("r", 1, "a.py", "module", None, None, None, None, h(data), 0)), rows(SNAP, ("r", "a.py", "present", 1, data, 0)), rows(LIM, ("module", 400, 50))
    cut = lambda width: sorted((r.piece, r.byte_start, r.byte_end, r.boundary) for r in Oversized(*tables, width).pieces().collect())
    whole = cut(1 << 16)
    assert whole == cut(97) == cut(1000) and len(whole) < len(data) / (400 - 50) * 1.35
    assert {x[3] for x in whole} <= {"line", "blank line", "end"}
    monkeypatch.setattr(pieces, "SEGMENT", 4)
    parted = cut(1 << 16)
    assert parted == cut(130)
    assert all(z - a <= 400 for _, a, z, _ in parted) and parted[-1][2] == len(data)
    assert all(q[1] == p[2] - 50 and data[p[2] - 1 : p[2]] == b"\n" for p, q in zip(parted, parted[1:]))
