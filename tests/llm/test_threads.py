import datetime as dt
import random

import pytest

from tessella.llm.threads import rebuild_conversations

SCHEMA = "message_id long, session_id string, uuid string, parent_uuid string, type string, subtype string, text string, ts timestamp, status string, frag string"
T0 = dt.datetime(2028, 1, 1)


def message(i, session, uuid, parent, kind="user", subtype=None, text="hi", s=0):
    return (i, session, uuid, parent, kind, subtype, text, T0 + dt.timedelta(seconds=s), "x", "y")


CASES = [
    message(1, "A", "a1", None, "human", s=5),  # clocks disagree: the links decide
    message(2, " a\n", "a2", "a1", "ASSISTANT ", s=1),
    message(3, "a", "a3", "a2", "assistant", "tool_use", None, 2),
    message(4, "a", "a4", "a3", "user", s=3),
    message(5, "a", "a5", "a4", "assistant", s=4),
    message(6, "a", "a2", "a1", "assistant", s=1),  # sent again
    message(10, "gap", "b1", None), message(11, "gap", "b2", "lost", "assistant"),
    message(20, "fork", "c1", None), message(21, "fork", "c2", "c1", "assistant"), message(22, "fork", "c3", "c1", "assistant"),
    message(30, "loop", "d1", None), message(31, "loop", "d2", "d3", "assistant"), message(32, "loop", "d3", "d2"),
    message(40, "two", "e1", None), message(41, "two", "e2", None, "assistant"), message(42, "two", "e3", "e1", "assistant"),
    message(50, "mute", "f1", None, "system", "init", None), message(51, "mute", "f2", "f1", "user", None, "  "),
    message(60, "open", "g1", None), message(61, "open", "g2", "g1", "assistant"), message(62, "open", "g3", "g2"),
    message(70, "old", "h2", None, "assistant", s=2), message(71, "old", "h1", None, "user", s=1),
    message(80, "other", "i1", None), message(81, "other", "i2", "a1", "assistant"),  # parent in another session
    message(90, None, "j1", None), message(91, "  ", "j2", None), message(92, "nouuid", None, None),
]


@pytest.mark.parametrize("chunk", [1, 2, 3, 1000])
def test_every_kind_of_session(rows, chunk):
    turns, sessions = rebuild_conversations(rows(SCHEMA, *CASES), chunk_rows=chunk)
    got = sorted((r.session_id, r.turn, r.uuid, r.role) for r in turns.collect())
    assert got == [
        ("a", 1, "a1", "user"), ("a", 2, "a2", "assistant"), ("a", 3, "a4", "user"), ("a", 4, "a5", "assistant"),
        ("old", 1, "h1", "user"), ("old", 2, "h2", "assistant"),
    ]
    status = {r.session_id: r.status for r in sessions.collect()}
    assert status == {"a": "kept", "gap": "broken", "fork": "broken", "loop": "broken", "two": "broken", "mute": "empty", "open": "missing reply", "old": "kept", "other": "broken"}


def test_long_shuffled_chain_over_many_chunks(rows):
    rnd = random.Random(3)
    n = 700
    data = [message(i, "long", f"u{i}", f"u{i - 1}" if i else None, "user" if i % 2 == 0 else "assistant", s=rnd.randint(0, 10**6)) for i in range(n)]
    rnd.shuffle(data)
    turns, _ = rebuild_conversations(rows(SCHEMA, *data), chunk_rows=50)
    assert [r.uuid for r in turns.orderBy("turn").collect()] == [f"u{i}" for i in range(n)]


def test_empty_table(rows):
    turns, sessions = rebuild_conversations(rows(SCHEMA))
    assert turns.count() == 0 and sessions.count() == 0
