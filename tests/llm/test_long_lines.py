import hashlib
import random

from tessella.llm.pieces import Oversized, best_cut

SYM = "repo_id string, symbol_id long, path string, kind string, line_start int, line_end int, byte_start int, byte_end int, content_hash string, size long"
SNAP = "repo_id string, path string, state string, mtime_ns long, bytes binary, size long"
LIM = "kind string, max_bytes int, overlap_bytes int"
LIMITS = {"module": (200, 40), "class": (97, 0), "function": (1000, 333)}


def text(rnd: random.Random, size: int) -> bytes:
    """Lines of which many are longer than a zone and some longer than a piece."""
    out = b""
    while len(out) < size:
        n = rnd.choice([5, 30, 60, 120, 160, 250, 700, 2500])
        word = rnd.choice([b"sketch ", b"'sketch',", b"sketch", "été".encode()])
        out += b" " * rnd.choice([0, 4]) + word * (rnd.randint(1, n) // len(word) + 1) + rnd.choice([b"\n", b"\n\n", b"\r\n"])
    return out


def test_best_cut_inside_a_line():
    assert best_cut(b"aa bb cc", 2, 7) == (6, "blank")
    assert best_cut(b"x['sketch','sketch']", 3, 15) == (12, "token")
    assert best_cut(b"sketchsketch", 3, 9) == (9, "character")


def test_lines_that_a_piece_can_hold_are_not_cut(rows):
    rnd = random.Random(7)
    files, syms = {}, []
    for i in range(24):
        kind = list(LIMITS)[i % 3]
        files[i] = text(rnd, 6000)
        end = len(files[i][: len(files[i]) - rnd.choice([0, 1, 40])].decode(errors="ignore").encode())
        syms.append(("r", i, f"{i}.py", kind, None, None, 0, end, hashlib.sha256(files[i][:end]).hexdigest(), 0))
    snaps = [("r", f"{i}.py", "present", 1, b, 0) for i, b in files.items()]
    o = Oversized(rows(SYM, *syms), rows(SNAP, *snaps), rows(LIM, *((k, *v) for k, v in LIMITS.items())), 1500)
    spans = {r.symbol_id: r for r in o.spans().collect()}
    by = {}
    for r in o.pieces().collect():
        by.setdefault(r.symbol_id, []).append(r)
    assert set(by) == set(spans) == set(files)
    counts = {}
    for sid, pieces in by.items():
        pieces.sort(key=lambda r: r.piece)
        s, data = spans[sid], files[sid]
        reach = s.max_bytes - s.overlap_bytes
        starts = [i + 1 for i, c in enumerate(data) if c == 10]
        assert pieces[0].byte_start == s.span_begin and pieces[-1].byte_end == s.span_end
        assert [p.piece for p in pieces] == list(range(1, len(pieces) + 1))
        for p, q in zip(pieces, pieces[1:]):
            assert p.byte_end < q.byte_end and s.overlap_bytes - 3 <= p.byte_end - q.byte_start <= s.overlap_bytes
        for p in pieces:
            assert 0 < p.byte_end - p.byte_start <= s.max_bytes
            data[p.byte_start : p.byte_end].decode()
            counts[p.boundary] = counts.get(p.boundary, 0) + 1
            if p.boundary == "end":
                continue
            if p.boundary in ("line", "blank line"):
                assert p.byte_end in starts
                continue
            # a line is cut inside only if no piece can hold it
            begin = max([x for x in starts if x <= p.byte_end], default=0)
            end = min([x for x in starts if x > p.byte_end and x < s.span_end], default=s.span_end)
            assert end - begin > reach, (sid, p, begin, end)
            if p.boundary == "character":  # neither a blank nor a token's end close before it
                assert data[max(begin, p.byte_end - 10) : p.byte_end + 1].decode(errors="ignore").isalnum()
    assert counts["blank"] and counts["token"] and counts["character"]
