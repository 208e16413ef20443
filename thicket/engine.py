"""One entry point per question, over tables of your own.

``Engine`` holds DataFrames in the shapes below and answers each question with a
DataFrame. Depth and size limits are honoured as given.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from thicket.functions import sig
from thicket.operators import graph, logs, search, source, topology


@dataclass
class Engine:
    """The tables of a program.

    edges: repo_id, caller, callee, call_type, enabled, line_number, call_id
    methods: repo_id, full_method, class_name, file_path, start_line, end_line, call_summary
    endpoints: repo_id, full_method, endpoint_type, http_method, url_path, class_name
    boundaries: repo_id, full_method, boundary_type, context, callee_method
    repositories: id, name, git_url, url_path_identifier
    lines: repo_id, file_path, line_no, text (optional)
    vectors: full_method, embedding (optional)
    """

    spark: SparkSession
    edges: DataFrame
    methods: DataFrame
    endpoints: DataFrame
    boundaries: DataFrame
    repositories: DataFrame
    lines: DataFrame | None = None
    vectors: DataFrame | None = None

    def _start(self, *methods: str) -> DataFrame:
        return self.spark.createDataFrame([(m,) for m in methods], "node string")

    @cached_property
    def calls(self) -> DataFrame:
        return graph.valid_edges(self.edges)

    @cached_property
    def inheritance(self) -> DataFrame:
        """(child, parent, kind) from the inheritance edges."""
        i = self.edges.where(F.col("call_type").isin("EXTENDS", "IMPLEMENTS"))
        return i.select(F.col("caller").alias("child"), F.col("callee").alias("parent"), F.col("call_type").alias("kind")).distinct()

    @cached_property
    def bridged(self) -> DataFrame:
        """Call edges (caller, callee) with the bridges from interface methods that call nothing to their implementations."""
        own = self.calls.select("caller", "callee").distinct()
        return own.unionByName(graph.bridge(self.inheritance.select("child", "parent"), own, self.methods))

    # --- listings ---

    def list_repositories(self) -> DataFrame:
        n = self.methods.groupBy(F.col("repo_id").alias("id")).agg(F.count("*").alias("n_methods"), F.count_distinct("class_name").alias("n_classes"))
        return self.repositories.join(n, "id", "left").na.fill({"n_methods": 0, "n_classes": 0})

    def list_api_endpoints(self, repo_id: int | None = None, endpoint_type: str | None = None, text: str | None = None) -> DataFrame:
        e = self.endpoints
        if repo_id is not None:
            e = e.where(F.col("repo_id") == repo_id)
        if endpoint_type:
            e = e.where(F.lower("endpoint_type") == endpoint_type.lower())
        if text:
            parts = (F.col("url_path"), sig.simple_class(F.col("class_name")), sig.method_name(F.col("full_method")))
            e = e.where(search.keyword_score([text], [(c, 1, 1) for c in parts]) > 0)
        return e

    def resolve_method(self, ref: str, most: int = 10) -> DataFrame:
        return graph.short_ref_targets(self.methods, self.spark.createDataFrame([(ref,)], "ref string"), most)

    # --- graph ---

    def callees(self, method: str) -> DataFrame:
        return graph.callees(self.edges, self._start(method), self.inheritance.select("child", "parent"), self.methods)

    def callers(self, method: str, depth: int = 10) -> DataFrame:
        """(node, depth) of transitive callers."""
        return graph.reach(graph.arrows(self.edges.where(~F.col("call_type").isin("EXTENDS", "IMPLEMENTS")), upward=True), self._start(method), depth)

    def call_tree(self, method: str, max_depth: int = 10) -> DataFrame:
        """(caller, callee, depth): the edges of the tree, each once."""
        return graph.tree_edges(self.bridged, self._start(method), max_depth).distinct()

    def call_tree_rows(self, method: str, max_depth: int = 10, cap: int = 8000) -> list[dict]:
        """The tree depth first, assembled on the driver from the ``cap`` + 1 nearest nodes; ``cut`` and lazy where callees beyond them are missing."""
        return graph.assemble_tree(self.bridged.withColumn("call_id", F.lit(0)), method, max_depth, cap)

    def impact(self, method: str, depth: int = 15) -> DataFrame:
        """(full_method, depth, repo_id, endpoint_type, url_path) of everything that reaches ``method``; endpoints end a path."""
        stops = self.endpoints.select(F.col("full_method").alias("node")).where("node is not null")
        hit = graph.reach(graph.arrows(self.calls, upward=True), self._start(method), depth, stops).withColumnRenamed("node", "full_method")
        owner = self.methods.select("full_method", "repo_id").distinct()
        ep = self.endpoints.select("full_method", "repo_id", "endpoint_type", "url_path").distinct()
        return hit.join(owner, "full_method", "left").join(ep, ["full_method", "repo_id"], "left")

    def impact_with_source(self, method: str, depth: int = 15, radius: int = 3) -> DataFrame:
        """:meth:`impact` with the lines around the start of each method."""
        hit = self.impact(method, depth).join(self.methods.select("repo_id", "full_method", "file_path", F.col("start_line").alias("line")), ["repo_id", "full_method"], "left")
        parts = source.snippets(self._lines(), hit.where("line is not null and file_path is not null"), radius)
        return hit.join(parts, [*source.FILE, "line"], "left")

    def upstream_tree(self, method: str, max_depth: int = 10, max_rows: int = 5000) -> DataFrame:
        """All paths upward without repeated method; endpoints do not end them."""
        return graph.simple_paths(graph.arrows(self.calls, upward=True), self._start(method), max_depth, max_rows)

    def cross_repo_tree(self, method: str, max_depth: int = 15) -> DataFrame:
        """:meth:`call_tree` with the repositories of both ends; null where several hold the method, ``crosses`` where they differ."""
        g = self.methods.groupBy("full_method").agg(F.min("repo_id").alias("a"), F.max("repo_id").alias("b"))
        owner = g.select("full_method", F.when(F.col("a") == F.col("b"), F.col("a")).alias("repo"), (F.col("a") != F.col("b")).alias("ambiguous"))
        side = lambda end: owner.select(F.col("full_method").alias(end), F.col("repo").alias(f"{end}_repo"), F.col("ambiguous").alias(f"{end}_ambiguous"))
        t = self.call_tree(method, max_depth).join(side("caller"), "caller", "left").join(side("callee"), "callee", "left")
        return t.withColumn("crosses", F.col("caller_repo") != F.col("callee_repo"))

    def external_calls(self, method: str, depth: int | None = None) -> DataFrame:
        """Boundaries of everything ``method`` reaches."""
        near = graph.reach(graph.arrows(self.bridged), self._start(method), depth).withColumnRenamed("node", "full_method")
        return near.join(self.boundaries, "full_method")

    def chain_outline(self, method: str, max_nodes: int = 300, max_depth: int = 10) -> list[dict]:
        """Visiting order of the tree, cut at ``max_nodes``, with ``truncated`` on the last row where more would follow."""
        rows = self.call_tree_rows(method, max_depth, max_nodes + 1)
        cut = [{**r, "truncated": False} for r in rows[:max_nodes]]
        if cut and (len(rows) > max_nodes or any(r["cut"] for r in rows)):
            cut[-1]["truncated"] = True
        return cut

    def topology(self, segments: int = 3) -> DataFrame:
        calls = self.calls.groupBy("repo_id", "callee").agg(F.count("*").alias("n"))
        return topology.service_edges(calls, self.endpoints, self.methods, segments)

    # --- source, search, logs ---

    def _lines(self) -> DataFrame:
        if self.lines is None:
            raise ValueError("the engine has no source lines")
        return self.lines

    def method_source(self, method: str) -> DataFrame:
        """Lines (repo_id, file_path, line_no, text) of a method, in order."""
        at = self.methods.where(F.col("full_method") == method).select("repo_id", "file_path", "start_line", "end_line")
        return self._lines().join(at, source.FILE).where("line_no between start_line and end_line").select(*source.FILE, "line_no", "text").orderBy(*source.FILE, "line_no")

    def keyword_search(self, words: list[str], k: int = 20) -> DataFrame:
        urls = self.endpoints.groupBy("repo_id", "full_method").agg(F.min("url_path").alias("url_path"))
        pool = self.methods.join(urls, ["repo_id", "full_method"], "left")
        fields = [(F.col("url_path"), 50, 1), (sig.simple_class(F.col("class_name")), 30, 1), (sig.method_name(F.col("full_method")), 20, 1), (F.col("call_summary"), 5, 3)]
        return search.best(pool, search.keyword_score(words, fields), k, "full_method")

    def semantic_search(self, query: list[float], words: list[str] = (), k: int = 20) -> DataFrame:
        """Nearest methods by vector; endpoints count 100, other methods 80 times their similarity. Without vectors the words decide."""
        if self.vectors is None:
            return self.keyword_search(list(words), k)
        near = search.nearest(self.vectors, "embedding", query, k, "full_method")
        ep = self.endpoints.select("full_method", F.lit(100).alias("w")).distinct()
        score = F.floor(F.col("similarity") * F.coalesce("w", F.lit(80))).cast("int")
        return near.join(ep, "full_method", "left").withColumn("score", score).drop("w").orderBy(F.desc("score"), "full_method")

    def analyze_log(self, method: str, log: str, depth: int = 10) -> DataFrame:
        """ERROR, OK or UNKNOWN for every method of a chain, by the log's stack traces."""
        chain = graph.reach(graph.arrows(self.bridged), self._start(method), depth)
        parts = chain.select(sig.class_name(F.col("node")).alias("class_name"), sig.method_name(F.col("node")).alias("method_name")).distinct()
        return logs.diagnose(parts, logs.frames(self.spark.createDataFrame([(0, log)], "id int, log string"), "id", "log"))
