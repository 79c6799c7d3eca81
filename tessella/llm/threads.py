"""Conversations from message rows, by pointer jumping over parent links.

The links of a session form a chain of any length, so the order is found by pointer jumping:
every row points to its parent, and in each round a row's pointer becomes its pointer's pointer,
which doubles the distance covered.  It runs on two levels:

1. Rows are range-partitioned by (session, time), which cuts a hot session over many tasks.  Each
   task reads its partition in bounded chunks and jumps pointers inside the chunk (arrays only).
   A session that begins and ends inside one chunk is settled there.  Of a session that reaches
   over a chunk's edge, only *fragments* remain: a maximal chain of linked rows, with its first
   row's outer parent, its last row, its length and its turn counts.
2. Fragments are linked (outer parent = another fragment's last row) and jumped by joins, one
   written table per round, for as many rounds as the longest session has binary digits of
   fragments.  Whatever then has not reached the session's first row hangs from a missing row or
   lies on a cycle.

A session is one unbroken chain exactly if it has one row without a parent, every row reaches it,
and the deepest row lies as deep as there are rows.

Shuffles: one on uuid (rows sent again), one range exchange, and one on fragment ids for the rows
of edge-crossing sessions only.  No task ever holds a session, only a chunk.

Defined results: rows without uuid or session belong to nothing; of rows with one uuid the one
with a session and the lowest message_id counts; equal times are ordered by message_id, missing
times come first.  A parent in another session is a missing parent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.plans.scratch import Scratch

SPACE = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85                 　"
#: Spellings of a role besides its own name.
ROLE_ALIASES = {"human": "user"}
TURN, FRAGMENT, SETTLED = 0, 1, 2
USER, ASSISTANT, OTHER = 1, 2, 0

_PART = T.StructType(
    [
        T.StructField("kind", T.ByteType()),
        T.StructField("session", T.StringType()),
        T.StructField("frag", T.LongType()),
        T.StructField("uuid", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("role", T.ByteType()),
        T.StructField("turn", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("turns", T.LongType()),
        T.StructField("parents", T.LongType()),
        T.StructField("roots", T.LongType()),
        T.StructField("first_role", T.ByteType()),
        T.StructField("last_role", T.ByteType()),
        T.StructField("bad", T.BooleanType()),
        T.StructField("unanswered", T.BooleanType()),
        T.StructField("status", T.StringType()),
    ]
)


def normalised_messages(messages: DataFrame) -> DataFrame:
    """One row per uuid: session, uuid, parent, ts, message_id, role (0 where the row is no turn)."""
    kind = F.lower(F.btrim("type", F.lit(SPACE)))
    for alias, role in ROLE_ALIASES.items():
        kind = F.when(kind == alias, role).otherwise(kind)
    spoken = F.col("subtype").isNull() & (F.length(F.btrim("text", F.lit(SPACE))) > 0)
    role = F.when(spoken & (kind == "user"), USER).when(spoken & (kind == "assistant"), ASSISTANT).otherwise(OTHER)
    session = F.lower(F.btrim("session_id", F.lit(SPACE)))
    rows = messages.select(
        F.when(session != "", session).alias("session"),
        "uuid",
        F.when(F.length("parent_uuid") > 0, F.col("parent_uuid")).alias("parent"),
        "ts",
        F.col("message_id").cast("long").alias("message_id"),
        role.cast("byte").alias("role"),
    ).filter(F.col("uuid").isNotNull())
    pick = F.min(F.struct(F.col("session").isNull().alias("lost"), "message_id", "session", "parent", "ts", "role"))
    return (
        rows.groupBy("uuid").agg(pick.alias("r")).select("uuid", "r.session", "r.parent", "r.ts", "r.message_id", "r.role")
    ).filter(F.col("session").isNotNull())


def _jump(parent: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Root, depth, and whether a root was reached, of each row; ``parent`` is -1 at roots."""
    n = len(parent)
    ptr = np.where(parent >= 0, parent, np.arange(n))
    depth = (parent >= 0).astype(np.int64)
    for _ in range(max(1, math.ceil(math.log2(max(2, longest))) + 1)):
        step = depth[ptr]
        if not step.any():
            break
        depth = depth + step
        ptr = ptr[ptr]
    return ptr, depth, parent[ptr] < 0


def _chunk(df: pd.DataFrame, first_id: int) -> pd.DataFrame:
    """Settle the sessions that lie whole in the chunk, and cut the first and last into fragments."""
    n = len(df)
    session = df["session"].to_numpy()
    starts = np.flatnonzero(np.r_[True, session[1:] != session[:-1]])
    sess = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
    n_sess = len(starts)
    role = df["role"].to_numpy().astype(np.int8)
    has_parent = df["parent"].notna().to_numpy()

    at = pd.Index(df["uuid"]).get_indexer(df["parent"])
    at = np.where(has_parent, at, -1)
    at = np.where((at >= 0) & (sess[at] == sess), at, -1)
    parents = np.bincount(sess, has_parent, n_sess).astype(np.int64)
    unlinked = parents == 0
    size = np.bincount(sess, minlength=n_sess)

    root, depth, reached = _jump(at, int(size.max()))
    loose = unlinked[sess]  # without links, a session's rows are one fragment in order of time
    root = np.where(loose, starts[sess], root)
    depth = np.where(loose, np.arange(n) - starts[sess], depth)
    reached = reached | loose
    root = np.where(reached, root, starts[sess])

    order = np.lexsort((depth, root))
    heads, frag_of = np.unique(root[order], return_inverse=True)
    n_frag = len(heads)
    begin = np.searchsorted(frag_of, np.arange(n_frag))
    end = np.r_[begin[1:], n]
    rows = end - begin
    tail = order[end - 1]
    f_sess = sess[heads]
    stuck = np.bincount(frag_of, ~reached[order], n_frag) > 0
    forked = depth[tail] + 1 != rows
    roots = np.bincount(frag_of, (~has_parent)[order], n_frag).astype(np.int64)

    is_turn = role[order] > 0
    t_row, t_frag = order[is_turn], frag_of[is_turn]
    turns = np.bincount(t_frag, minlength=n_frag).astype(np.int64)
    t_begin = np.searchsorted(t_frag, np.arange(n_frag))
    t_no = np.arange(len(t_row)) - t_begin[t_frag] + 1
    t_role = role[t_row]
    follows = np.r_[t_frag[1:] == t_frag[:-1], False] if len(t_row) else np.zeros(0, bool)
    nxt = np.r_[t_role[1:], [0]] if len(t_row) else t_role
    unanswered = np.bincount(t_frag[follows & (t_role == USER) & (nxt != ASSISTANT)], minlength=n_frag) > 0
    some = turns > 0
    first_role = np.where(some, t_role[np.minimum(t_begin, max(0, len(t_role) - 1))] if len(t_role) else 0, 0)
    last_at = np.clip(t_begin + turns - 1, 0, max(0, len(t_role) - 1)).astype(int)
    last_role = np.where(some, t_role[last_at] if len(t_role) else 0, 0)
    bad = stuck | forked

    closed = np.ones(n_sess, bool)
    closed[0] = closed[-1] = False
    n_frags = np.bincount(f_sess, minlength=n_sess)
    broken = (n_frags != 1) | (np.bincount(f_sess, bad, n_sess) > 0)
    broken |= ~unlinked & (np.bincount(f_sess, roots, n_sess) != 1)
    empty = np.bincount(f_sess, turns, n_sess) == 0
    missing = (np.bincount(f_sess, unanswered, n_sess) > 0) | (np.bincount(f_sess, last_role == USER, n_sess) > 0)
    status = np.select([broken, empty, missing], ["broken", "empty", "missing reply"], "kept")

    f_closed, s_closed = closed[f_sess], np.flatnonzero(closed)
    kept = closed & (status == "kept")
    ids = first_id + np.arange(n_frag)
    t_kept, t_open = kept[sess[t_row]], ~closed[sess[t_row]]
    uuid = df["uuid"].to_numpy()
    parent = df["parent"].to_numpy()
    fo = np.flatnonzero(~f_closed)
    blank = {f.name: None for f in _PART}
    parts = [
        pd.DataFrame(blank | {"kind": np.int8(TURN), "session": session[t_row[t_kept]], "uuid": uuid[t_row[t_kept]], "role": t_role[t_kept], "turn": t_no[t_kept]}),
        pd.DataFrame(blank | {"kind": np.int8(TURN), "frag": ids[t_frag[t_open]], "uuid": uuid[t_row[t_open]], "role": t_role[t_open], "turn": t_no[t_open]}),
        pd.DataFrame(
            blank
            | {"kind": np.int8(FRAGMENT), "session": session[heads[fo]], "frag": ids[fo], "uuid": uuid[tail[fo]], "parent": parent[heads[fo]], "rows": rows[fo], "turns": turns[fo]}
            | {"parents": np.bincount(frag_of, has_parent[order], n_frag)[fo].astype(np.int64), "roots": roots[fo], "first_role": first_role[fo], "last_role": last_role[fo], "bad": bad[fo], "unanswered": unanswered[fo]}
        ),
        pd.DataFrame(blank | {"kind": np.int8(SETTLED), "session": session[starts[s_closed]], "status": status[s_closed], "rows": size[s_closed], "turns": np.bincount(f_sess, turns, n_sess)[s_closed].astype(np.int64)}),
    ]
    return pd.concat([p for p in parts if len(p)], ignore_index=True) if any(len(p) for p in parts) else pd.DataFrame(blank, index=[])


def _contract(chunk_rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        next_id, held, n = TaskContext.get().partitionId() << 36, [], 0
        for b in batches:
            if n and n + len(b) > chunk_rows:
                yield _chunk(pd.concat(held, ignore_index=True), next_id)
                next_id, held, n = next_id + n, [], 0
            if len(b):
                held.append(b)
                n += len(b)
        if n:
            yield _chunk(pd.concat(held, ignore_index=True), next_id)

    return run


def _resolve(parts: DataFrame, scratch: Scratch) -> DataFrame:
    """Fragments with their session's verdict, the rows and the turns that lie before them."""
    spark = parts.sparkSession
    frags = parts.filter(F.col("kind") == FRAGMENT)
    about = frags.groupBy("session").agg(
        F.count("*").alias("frags"),
        F.sum("parents").alias("all_parents"),
        F.sum("roots").alias("all_roots"),
        F.max("bad").alias("any_bad"),
    )
    with_about = frags.join(about, "session")
    linked = F.col("all_parents") > 0
    sound = ~F.col("any_bad") & (~linked | (F.col("all_roots") == 1))
    base = scratch.cut(with_about.withColumn("linked", linked).withColumn("sound", sound))
    longest = base.filter("linked AND sound").agg(F.max("frags")).first()[0] or 1

    chain = base.filter("linked AND sound AND frags > 1")
    tails = chain.select("session", F.col("uuid").alias("parent"), F.col("frag").alias("ptr"), F.col("rows").alias("before"), F.col("turns").alias("turns_before"))
    # ptr: null at the session's first fragment, -1 where the parent is no fragment's last row
    state = chain.select("session", "frag", "parent").join(tails, ["session", "parent"], "left")
    state = state.select(
        "frag",
        F.when(F.col("parent").isNull(), F.lit(None)).otherwise(F.coalesce("ptr", F.lit(-1))).cast("long").alias("ptr"),
        F.coalesce("before", F.lit(0)).alias("before"),
        F.coalesce("turns_before", F.lit(0)).alias("turns_before"),
    )
    if longest > 1:
        state = scratch.cut(state)
        for _ in range(math.ceil(math.log2(longest)) + 1):
            old = scratch.last
            up = state.select(F.col("frag").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("before").alias("b2"), F.col("turns_before").alias("t2"), F.lit(True).alias("hit"))
            state = scratch.cut(
                state.join(up, "ptr", "left").select(
                    "frag",
                    F.when(F.col("hit"), F.col("ptr2")).otherwise(F.col("ptr")).alias("ptr"),
                    (F.col("before") + F.coalesce("b2", F.lit(0))).alias("before"),
                    (F.col("turns_before") + F.coalesce("t2", F.lit(0))).alias("turns_before"),
                )
            )
            scratch.drop(old)
    else:
        state = spark.createDataFrame([], "frag long, ptr long, before long, turns_before long")

    # sessions without links go in order of time, which is the order of fragment ids; they have one per chunk
    from pyspark.sql import Window as W

    past = W.partitionBy("session").orderBy("frag").rowsBetween(W.unboundedPreceding, -1)
    loose = base.filter("NOT linked AND sound").select(
        "frag", F.lit(None).cast("long").alias("ptr"), F.coalesce(F.sum("rows").over(past), F.lit(0)).alias("before"), F.coalesce(F.sum("turns").over(past), F.lit(0)).alias("turns_before")
    )
    lone = base.filter("linked AND sound AND frags = 1").select("frag", F.when(F.col("parent").isNotNull(), -1).cast("long").alias("ptr"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("turns_before"))
    placed = base.join(state.unionByName(loose).unionByName(lone), "frag", "left")
    # a user turn that ends a fragment must be answered by the next fragment that has turns, which is the
    # one whose first turn has the next number
    placed = scratch.cut(placed)
    firsts = placed.filter((F.col("turns") > 0) & F.col("turns_before").isNotNull()).groupBy("session", F.col("turns_before").alias("next_turn")).agg(F.min("first_role").alias("answer"))
    placed = placed.withColumn("next_turn", F.col("turns_before") + F.col("turns")).join(firsts, ["session", "next_turn"], "left")
    placed = placed.withColumn("open_end", (F.col("turns") > 0) & (F.col("last_role") == USER) & (F.coalesce("answer", F.lit(OTHER)) != ASSISTANT))
    verdict = placed.groupBy("session").agg(
        F.sum("rows").alias("rows"),
        F.sum("turns").alias("turns"),
        F.min("sound").alias("sound"),
        F.max(F.col("ptr").isNotNull() | F.col("before").isNull()).alias("unreached"),
        F.max(F.col("before") + F.col("rows")).alias("deepest"),
        F.max(F.col("unanswered") | F.col("open_end")).alias("unanswered"),
    )
    verdict = verdict.select(
        "session",
        F.when(~F.col("sound") | F.col("unreached") | (F.col("deepest") != F.col("rows")), "broken")
        .when(F.col("turns") == 0, "empty")
        .when(F.col("unanswered"), "missing reply")
        .otherwise("kept")
        .alias("status"),
        F.col("rows").alias("all_rows"),
        F.col("turns").alias("all_turns"),
    )
    return placed.select("session", "frag", "turns_before").join(verdict, "session")


def rebuild_conversations(messages: DataFrame, chunk_rows: int = 250_000) -> tuple[DataFrame, DataFrame]:
    """(turns, sessions): the ordered turns of kept sessions, and every session's verdict.

    turns: session_id, turn (from 1), uuid, role.  sessions: session_id, status ('kept', 'broken',
    'empty', 'missing reply'), n_rows, n_turns.  ``chunk_rows`` bounds a task's memory only; any
    value gives the same result.
    """
    scratch = Scratch(messages.sparkSession)
    key = ["session", "ts", "message_id", "uuid"]
    ordered = normalised_messages(messages).repartitionByRange(*key).sortWithinPartitions(*key)
    parts = scratch.cut(ordered.select("session", "uuid", "parent", "role").mapInPandas(_contract(chunk_rows), _PART))
    frags = scratch.cut(_resolve(parts, scratch))
    role = F.when(F.col("role") == USER, "user").otherwise("assistant").alias("role")
    whole = parts.filter((F.col("kind") == TURN) & F.col("session").isNotNull()).select(F.col("session").alias("session_id"), "turn", "uuid", role)
    kept = frags.filter(F.col("status") == "kept").select("session", "frag", "turns_before")
    cut = (
        parts.filter((F.col("kind") == TURN) & F.col("frag").isNotNull())
        .select("frag", "uuid", "role", "turn")
        .join(kept, "frag")
        .select(F.col("session").alias("session_id"), (F.col("turn") + F.col("turns_before")).alias("turn"), "uuid", role)
    )
    settled = parts.filter(F.col("kind") == SETTLED).select(F.col("session").alias("session_id"), "status", F.col("rows").alias("n_rows"), F.col("turns").alias("n_turns"))
    others = frags.select(F.col("session").alias("session_id"), "status", F.col("all_rows").alias("n_rows"), F.col("all_turns").alias("n_turns")).distinct()
    return whole.unionByName(cut), settled.unionByName(others)
