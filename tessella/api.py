"""A facade over one or many repositories: build an index, search it, look at it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions.text import is_test_path
from tessella.operators import code, extract, retrieval, tours
from tessella.operators.claims import relinked
from tessella.plans.merge import VersionedFolder
from tessella.plans.ship import ship
from tessella.sources.files import read_tree

SCHEMA_VERSION = 2
#: The claim store, which outlives the code graph.
CARRIED = ("assertions", "verdicts")


class IndexReplaced(RuntimeError):
    """The index has been built anew since it was opened."""


class RepoMismatch(ValueError):
    """The index holds other repositories, or the same ones from another place."""


class Index:
    """Tables of an index: snapshots, symbols, edges and chunks, as parquet in the current version of a folder."""

    TABLES = ("snapshots", "symbols", "edges", "chunks")

    def __init__(self, spark: SparkSession, folder: str, expect: dict[str, str] | None = None):
        """``expect`` (repo_id -> root) must be what the index was built from."""
        ship(spark)
        self.spark, self.versions = spark, VersionedFolder(spark, folder)
        self.identity = self.versions.current()
        if self.identity is None:
            raise FileNotFoundError(f"no index at {folder}")
        self.folder = self.versions.path(self.identity)
        meta = spark.read.json(f"{self.folder}/meta").first()
        if meta["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"index of version {meta['schema_version']}; this engine reads {SCHEMA_VERSION}")
        self.roots = dict(zip(meta["repos"], meta["roots"]))
        self.repos = set(meta["repos"])
        if expect is not None and expect != self.roots:
            raise RepoMismatch(f"built from {self.roots}, not from {expect}")

    def check_identity(self) -> None:
        """Raise if another version has become current."""
        if self.versions.current() != self.identity:
            raise IndexReplaced("index_replaced")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @classmethod
    def build(cls, spark: SparkSession, folder: str, repos: dict[str, str], carry: bool = True) -> Index:
        """Index working trees (repo_id -> path); each table is partitioned by repository.

        The new version becomes current only when all of it is written.  With ``carry`` the claim store
        of the version before comes along, its claims tied to the symbols of now.
        """
        ship(spark)
        versions = VersionedFolder(spark, folder)
        before, version = versions.current(), versions.new()
        to = versions.path(version)
        trees = [read_tree(spark, path, repo) for repo, path in repos.items()]
        snapshots = trees[0]
        for t in trees[1:]:
            snapshots = snapshots.unionByName(t)
        snapshots.write.partitionBy("repo_id").parquet(f"{to}/snapshots")
        snapshots = spark.read.parquet(f"{to}/snapshots").withColumn("repo_id", F.col("repo_id").cast("string"))
        symbols, edges = extract.extract_graph(snapshots)
        symbols = symbols.withColumn("symbol_id", F.xxhash64("repo_id", "qualname"))
        symbols.write.partitionBy("repo_id").parquet(f"{to}/symbols")
        extract.resolve(edges.join(symbols.select("repo_id").distinct(), "repo_id", "left_semi"), symbols).write.partitionBy("repo_id").parquet(f"{to}/edges")
        chunks = code.container_chunks(symbols).unionByName(code.source_chunks(symbols, snapshots))
        chunks.write.partitionBy("repo_id").parquet(f"{to}/chunks")
        if carry and before is not None:
            cls._carry(spark, versions.path(before), to)
        roots = sorted(repos.items())
        meta = spark.createDataFrame([(SCHEMA_VERSION, [r for r, _ in roots], [p for _, p in roots])], "schema_version int, repos array<string>, roots array<string>")
        meta.coalesce(1).write.json(f"{to}/meta")
        versions.publish(version)
        return cls(spark, folder)

    @staticmethod
    def _carry(spark: SparkSession, old: str, new: str) -> None:
        from pyspark.errors import AnalysisException

        for name in CARRIED:
            try:
                rows = spark.read.parquet(f"{old}/{name}")
            except AnalysisException:  # nothing to carry
                continue
            if name == "assertions":
                now = relinked(rows, spark.read.parquet(f"{new}/symbols")).withColumnRenamed("symbol_id", "subject_symbol_id")
                rows = rows.drop("subject_symbol_id").join(now, "assertion_id", "left")
            rows.write.parquet(f"{new}/{name}")

    def store_claims(self, **tables: DataFrame) -> None:
        """Keep claim tables (assertions, verdicts) with this version; later builds carry them along."""
        for name, rows in tables.items():
            if name not in CARRIED:
                raise ValueError(f"no table of the claim store: {name}")
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def _call_edges(self) -> DataFrame:
        names = self.table("symbols").select("repo_id", F.col("qualname").alias("q"), "symbol_id")
        calls = self.table("edges").filter("kind = 'calls' AND dst IS NOT NULL")
        linked = calls.join(names.select("repo_id", F.col("q").alias("src"), F.col("symbol_id").alias("a")), ["repo_id", "src"]).join(names.select("repo_id", F.col("q").alias("dst"), F.col("symbol_id").alias("b")), ["repo_id", "dst"])
        return linked.select(F.col("a").alias("src"), F.col("b").alias("dst"), "confidence", F.struct("path", "ord").alias("edge_id"))

    def _asked(self, queries: dict[int, str]) -> DataFrame:
        if not queries:
            raise ValueError("no query")
        return self.spark.createDataFrame(list(queries.items()), "query_id long, query string")

    def search(self, queries: dict[int, str], k: int = 10, graph: bool = True) -> DataFrame:
        """(query_id, symbol_id, score, modality, rank): BM25, spread over calls, fused; tests demoted."""
        asked = self._asked(queries)
        docs = self.table("chunks").select(F.col("symbol_id").alias("doc_id"), "text")
        lexical = retrieval.bm25(docs, asked, k * 4).withColumnRenamed("doc_id", "id")
        tests = self.table("symbols").filter(is_test_path(F.col("path"))).select(F.col("symbol_id").alias("id"))
        if graph:
            hits = retrieval.hybrid(lexical, lexical.limit(0), self._call_edges(), tests, k)
        else:
            hits = retrieval.fuse(lexical.select("query_id", F.lit("lexical").alias("modality"), "rank", "id"), k, tests)
        return hits.withColumnRenamed("id", "symbol_id")

    def reading_path(self, topics: dict[int, str], limit: int = tours.STOPS) -> DataFrame:
        """(query_id, symbol_id, stop, tier, reason): what to read, and in which order, for each topic."""
        from tessella.operators.graph import pagerank

        asked = self._asked(topics)
        symbols = self.table("symbols").filter(F.col("kind").isin("function", "method", "class") & ~is_test_path(F.col("path")))
        edges = self._call_edges().join(symbols.select(F.col("symbol_id").alias("src")), "src", "left_semi").join(symbols.select(F.col("symbol_id").alias("dst")), "dst", "left_semi")
        ranks = pagerank(edges.select("src", "dst")).withColumnRenamed("rank", "centrality")
        nodes = ranks.join(symbols.select(F.col("symbol_id").alias("id"), "qualname", F.col("path").alias("module")), "id")
        docs = self.table("chunks").select(F.col("symbol_id").alias("doc_id"), "text")
        hits = retrieval.bm25(docs, asked, limit).withColumnRenamed("doc_id", "id")
        return tours.reading_paths(asked, hits, edges, nodes, limit).withColumnRenamed("id", "symbol_id")

    def get_symbol(self, repo_id: str, qualname: str, most: int | None = None) -> dict:
        """A symbol with all its callees, callers and unresolved references; with ``most`` the first ones, and ``more`` says which lists go on."""
        symbol = self.table("symbols").filter((F.col("repo_id") == repo_id) & (F.col("qualname") == qualname)).first()
        edges = self.table("edges").filter(F.col("repo_id") == repo_id)
        out = edges.filter(F.col("src") == qualname)
        lists = {"callees": (out.filter("dst IS NOT NULL"), "dst"), "callers": (edges.filter(F.col("dst") == qualname), "src"), "unresolved": (out.filter("dst IS NULL"), "dst_name")}
        found, more = {}, []
        for name, (rows, c) in lists.items():
            rows = rows.orderBy("line", c).select(c)
            got = [r[0] for r in (rows if most is None else rows.limit(most + 1)).toLocalIterator()]
            if most is not None and len(got) > most:
                more.append(name)
                got = got[:most]
            found[name] = got
        return {"symbol": symbol.asDict() if symbol else None, **found, "more": more}

    def stats(self) -> dict:
        counts = {r["kind"]: r["count"] for r in self.table("symbols").groupBy("kind").count().collect()}
        by = {r["resolver"]: r["count"] for r in self.table("edges").groupBy("resolver").count().collect()}
        return {"repos": sorted(self.repos), "symbols": counts, "edges_by_resolver": by, "chunks": self.table("chunks").count()}
