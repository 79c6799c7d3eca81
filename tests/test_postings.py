"""BM25 over blocks of documents: against brute force, and what it moves."""

import math
import random

import pyarrow as pa
import pytest

from tessella.operators import postings, retrieval

WORDS = [f"w{i}" for i in range(12)]


def _corpus(n, ids=lambda i: i):
    rnd = random.Random(5)
    docs = [(ids(i), [WORDS[min(rnd.randrange(12), rnd.randrange(12))] for _ in range(rnd.randrange(9))]) for i in range(n)]
    docs += [(ids(n + i), list(ts)) for i, (_, ts) in enumerate(docs[: n // 3])]  # equal texts, so equal scores
    rnd.shuffle(docs)
    asked = {f"q{i}": sorted(((w, rnd.choice([1e-6, 0.5, 1.0, 3.0])) for w in rnd.sample([*WORDS, "w0 w1", "w1 w1", "none"], 4)), key=lambda t: (-t[1], t[0])) for i in range(30)}
    return docs, asked


def _places(ts, unit):
    u = unit.split(" ")
    return sum(ts[i : i + len(u)] == u for i in range(len(ts)))


def _brute(docs, asked, k, avg):
    out = {}
    for q, terms in asked.items():
        rows = []
        for i, ts in docs:
            s, hit = 0.0, False
            for u, w in terms:
                if tf := _places(ts, u):
                    hit, s = True, s + w * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / avg)))
            if hit:
                rows.append((-math.floor(s * 1e6 + 0.5) / 1e6, i))
        out[q] = sorted(rows)[:k]
    return out


@pytest.mark.parametrize("k, kind, held", [(3, "int", 100), (3, "text", 100), (3, "int", 8), (None, "int", 100), (200, "text", 100)])
def test_blocks_give_what_brute_force_gives(monkeypatch, k, kind, held):
    monkeypatch.setattr(postings, "BLOCK_DOCS", 17)
    monkeypatch.setattr(postings, "BLOCK_TOKENS", 60)
    monkeypatch.setattr(postings, "HELD", held)
    monkeypatch.setattr(postings, "HANDED", 50)
    monkeypatch.setattr(postings, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 0})())}))
    docs, asked = _corpus(150, (lambda i: i) if kind == "int" else (lambda i: f"é{i}"))
    avg = sum(len(ts) for _, ts in docs) / len(docs)
    table = pa.table({"doc_id": [i for i, _ in docs], "ts": pa.array([ts for _, ts in docs], pa.list_(pa.string()))})
    blocks = list(postings.packed(table.to_batches(max_chunksize=23)))
    assert len(blocks) > 10 and sum(len(b["ids"][0]) for b in blocks) == len(docs)
    assert all(len(b["ids"][0]) <= 17 and len(b["seq"][0].as_py()) <= 240 for b in blocks)
    lists = [dict(list(asked.items())[:20]), dict(list(asked.items())[20:])]
    shape = pa.list_(pa.struct([("query", pa.string()), ("terms", pa.list_(pa.struct([("unit", pa.string()), ("weight", pa.float64())])))]))

    def pairs():
        for b in blocks:
            for n, own in enumerate(lists):
                rows = [{"query": q, "terms": [{"unit": u, "weight": w} for u, w in terms]} for q, terms in own.items()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([n]), pa.array([rows], shape), pa.array([avg])], [*b.schema.names, "number", "asked", "avg_len"])

    got = {q: [] for q in asked}
    for b in postings.best(pairs(), k, 1.2, 0.75):
        for r in b.to_pylist():
            got[r["query"]].append((-r["score"], r["doc_id"]))
    assert {q: sorted(rows)[:k] for q, rows in got.items()} == _brute(docs, asked, k, avg)
    counted = {}
    for b in blocks:
        units = pa.array([["w0", "w0 w1", "w1 w1", "none"]])
        for out in postings.frequencies([pa.RecordBatch.from_arrays([*b.columns, units], [*b.schema.names, "units"])]):
            for r in out.to_pylist():
                counted[r["unit"]] = counted.get(r["unit"], 0) + r["df"]
    assert counted == {u: n for u in ("w0", "w0 w1", "w1 w1", "none") if (n := sum(bool(_places(ts, u)) for _, ts in docs))}


def _shuffled(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_neither_postings_nor_pairs_are_shuffled(spark, rows):
    """Moved are texts of this small table, units and a query's best of each task, not its matches: 5,013 rows; with postings joined and scored by shuffles it was 585,135."""
    rnd = random.Random(7)
    vocabulary = [f"term{i}" for i in range(40)]
    docs = rows("doc_id long, text string", *((i, " ".join(rnd.choices(vocabulary, k=60))) for i in range(2000)))
    asked = rows("query_id long, query string", *((i, " ".join(rnd.sample(vocabulary, 4))) for i in range(50)))
    before = _shuffled(spark)
    assert retrieval.bm25(docs, asked).count() == 500
    assert _shuffled(spark) - before < 20_000


@pytest.mark.parametrize("name", ["f9_seed_merge", "f6_rank_fusion"])
def test_queries_shuffle_less_than_their_tokens(spark, name):
    """Rows shuffled on sf0.01, where 20 queries ask 1,000 texts: 10,147; with postings joined and scored by shuffles 23,531."""
    import __spark_entry__

    before = _shuffled(spark)
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.01").count() == 200
    assert _shuffled(spark) - before < 15_000


@pytest.mark.parametrize("name", ["f9_seed_merge"])
def test_no_row_holds_much_of_a_block(spark, monkeypatch, name):
    """A written row is an eighth of its block; with whole blocks as rows one JVM of 750 MB ran out of heap on 600,000 documents."""
    import __spark_entry__
    from pyspark.sql import functions as F

    written, cut = [], retrieval.Scratch.cut
    monkeypatch.setattr(retrieval.Scratch, "cut", lambda self, *a, **b: written.append(cut(self, *a, **b)) or written[-1])
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.01").count() == 200
    blocks = next(t for t in written if "seq" in t.columns)
    row, block = blocks.groupBy("block").agg(F.max(F.length("seq")).alias("most"), F.sum(F.length("seq")).alias("all")).agg(F.max("most"), F.max("all")).first()
    assert block > 10_000 and row < block / 4


def test_pieces_make_their_block_again():
    block = {"block": [7], "ids": [[3, 5, 8]], "lens": [b"abcdefgh"], "words": [["é", "", "w0"]], "seq": [b"x" * 36]}
    blocks = pa.table(block, pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lens", pa.binary()), ("words", pa.list_(pa.string())), ("seq", pa.binary())])).to_batches()
    rows = [(b, n) for b in postings.pieces([*blocks, *blocks]) for n in range(2)]  # each with two lists
    rows = [pa.RecordBatch.from_arrays([*b.columns, pa.array([n])], [*b.schema.names, "number"]) for b, n in rows]
    assert len(rows) == 4 * postings.PIECES
    together = pa.Table.from_batches(rows).combine_chunks().to_batches()
    for batches in (rows, together):
        assert [b.to_pydict() for b in postings.whole(batches)] == [block | {"number": [n]} for n in (0, 1, 0, 1)]
    with pytest.raises(ValueError, match="piece 2"):
        list(postings.whole(rows[:2] + rows[4:]))


@pytest.mark.parametrize("name", ["f6_rank_fusion"])
def test_blocks_go_to_python_in_small_batches(spark, monkeypatch, name):
    """All that holds blocks is run under the limit, and the query that is left holds none; with batches of 64 MB the JVM held much more."""
    import __spark_entry__

    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    limits, cut = [], retrieval.Scratch.cut

    def seen(self, df, file_rows=0, batch_bytes=None):
        limits.extend([batch_bytes] * ("MapInArrow" in plan(df)))
        return cut(self, df, file_rows, batch_bytes) if batch_bytes else cut(self, df, file_rows)

    monkeypatch.setattr(retrieval.Scratch, "cut", seen)
    left = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.01")
    assert "MapInArrow" not in plan(left) and limits == ["8m"] * 3
    assert left.count() == 200


def test_a_cut_bounds_what_goes_to_python_at_once(spark):
    from pyspark.sql import functions as F

    name, scratch = "spark.sql.execution.arrow.maxBytesPerBatch", retrieval.Scratch(spark)
    before = spark.conf.get(name)
    sizes = spark.range(0, 64, 1, 1).select(F.expr("repeat('x', 100000)").alias("t")).mapInArrow(lambda rows: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in rows), "n long")
    most = lambda **limit: scratch.cut(sizes, **limit).agg(F.max("n")).first()[0]
    assert most() > 6_000_000 and most(batch_bytes="500k") < 1_000_000
    assert spark.conf.get(name) == before
