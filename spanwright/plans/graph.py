"""The network of a feature table: every derived table as a DataFrame, and the compact form that searches use."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions.geometry import Metric
from spanwright.operators import chains as ch
from spanwright.operators import topology as tp
from spanwright.operators.engine import Net
from spanwright.plans.materialise import settled

#: Bytes of a compact network that may be sent to the executors.
BROADCAST_BOUND = 512 << 20
#: Networks of so many segments are sent whole; of larger ones routes get the part around their places.
WHOLE_SEGMENTS = 1 << 14
#: Ids that are sent to all tasks rather than shuffled.
FEW_IDS = 1 << 17
#: Groups that a table of levels may name.
MOST_LEVELS = 100_000
FORMAT = "spanwright-graph"
VERSION = 1
REPAIR = "kind string, x double, y double, feature_a long, feature_b long, gap double"
TABLES = ("vertices", "segments", "chains", "edges", "nodes", "repairs")


@dataclass
class Options:
    """How a network is built. Expressions are over feature columns (group, end_group, node_id) or segment columns (weight).

    levels(group_key, ordinal, elevation) tells of groups; connectors are the stops of rides, see levels.ride_pairs.
    """

    metric: str = "euclidean"
    weight: Column | None = None
    tolerance: float = 0.0
    snap_dangles: float = 0.0
    split_intersections: bool = False
    compact: bool = True
    group: Column | None = None
    end_group: Column | None = None
    node_id: Column | None = None
    zero_weight: str = "impassable"
    levels: DataFrame | None = None
    connectors: DataFrame | None = None

    def __post_init__(self) -> None:
        for name in ("tolerance", "snap_dangles"):
            value = getattr(self, name)
            if not 0 <= value < float("inf"):
                raise ValueError(f"{name} must be finite and not negative")
        if self.zero_weight not in ("impassable", "free"):
            raise ValueError("zero_weight is 'impassable' or 'free'")


@dataclass
class Graph:
    spark: SparkSession
    metric: Metric
    vertices: DataFrame
    segments: DataFrame
    chains: DataFrame
    edges: DataFrame
    nodes: DataFrame
    repairs: DataFrame
    levels: DataFrame | None = None
    per_level: float = 0.0
    marks: tuple[list[int], DataFrame] | None = None  # landmarks of a large network, and their landmark, node, d_from, d_to
    _sent: dict = field(default_factory=dict)

    def find_vertex(self, points: DataFrame, tolerance: float = 0.0) -> DataFrame:
        """vertex for each row of points(x, y): the one at that place (the least, if several groups have one), else null."""
        at = self.vertices.groupBy(F.col("vx").alias("x"), F.col("vy").alias("y")).agg(F.min("vertex").alias("vertex"))
        return points.join(at, ["x", "y"], "left")

    def component_summary(self) -> DataFrame:
        return ch.component_summary(self.chains, self.nodes.select("node", "component"))

    def node_features(self) -> DataFrame:
        """node, features: the distinct features that touch each node, in order."""
        touching = self.segments.select(F.explode(F.array("u", "v")).alias("node"), "feature_idx").join(self.nodes.select("node"), "node", "left_semi")
        return touching.groupBy("node").agg(F.array_sort(F.collect_set("feature_idx")).alias("features"))

    def stats(self) -> dict[str, int]:
        """Counts of nodes, chains, edges, alive segments and components."""
        return {"nodes": self.nodes.count(), "chains": self.chains.count(), "edges": self.edges.count(), "alive_segments": self.segments.count(), "components": self.nodes.select("component").distinct().count()}

    def heuristic_scale(self) -> float:
        """The least cost per unit of straight distance over chain segments, a little less; 0 if one with length is free."""
        if "scale" not in self._sent:
            straight = self.metric.distance(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy"))
            least = self.segments.filter(straight > 0).agg(F.min(F.least("cost_along", "cost_against") / straight)).first()[0]
            self._sent["scale"] = 0.0 if least is None else float(least) * (1 - 1e-6)
        return self._sent["scale"]

    def extent(self) -> tuple[int, float, float, float, float]:
        """Count of segments, and the least and greatest x and y of nodes."""
        if "extent" not in self._sent:
            box = self.nodes.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
            self._sent["extent"] = (self.segments.count(), *(0.0 if v is None else v for v in box))
        return self._sent["extent"]

    def _level_table(self) -> dict[str, tuple[float, float]] | None:
        """Ordinal and elevation by group, of at most MOST_LEVELS groups."""
        if self.levels is None:
            return None
        rows = self.levels.select("group_key", F.col("ordinal").cast("double"), F.col("elevation").cast("double")).limit(MOST_LEVELS + 1).collect()
        if len(rows) > MOST_LEVELS:
            raise ValueError(f"more than {MOST_LEVELS} levels")
        return {r[0]: tuple(np.nan if v is None else v for v in r[1:]) for r in rows}

    def net(self) -> Net:
        """The compact form. Raises ValueError beyond BROADCAST_BOUND, which is checked before anything is fetched."""
        if "net" in self._sent:
            return self._sent["net"]
        net = self._compacted(self.nodes, self.chains, self.segments, self.edges)
        self._sent["net"] = net
        return net

    def part(self, box: tuple[float, float, float, float], touched: DataFrame) -> Net:
        """The compact form of the nodes in a box (least x and y, greatest x and y), with all of their chains and those touched(chain_id).

        A node outside the box has some of its chains only: it is cut, and a search that would go on from it stops.
        """
        inside = F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])
        seen = _sendable(settled(self.nodes.filter(inside).select("node")))
        ends = self.chains.select("chain_id", F.explode(F.array("from_node", "to_node")).alias("node"))
        ids = _sendable(settled(ends.join(seen, "node", "left_semi").select("chain_id").unionByName(touched.select("chain_id")).distinct()))
        chains = settled(self.chains.join(ids, "chain_id", "left_semi"))
        held = _sendable(settled(chains.select(F.explode(F.array("from_node", "to_node")).alias("node")).distinct()))
        nodes = self.nodes.join(held, "node", "left_semi").withColumn("cut", ~inside)
        return self._compacted(nodes, chains, self.segments.join(ids, "chain_id", "left_semi"), self.edges.join(ids, "chain_id", "left_semi"))

    def _compacted(self, nodes: DataFrame, chains: DataFrame, segments: DataFrame, edges: DataFrame) -> Net:
        levels = self._level_table()
        counts = segments.count(), edges.count(), nodes.count()
        marked = 16 * len(self.marks[0]) if self.marks else 0
        if counts[0] * 120 + counts[1] * 24 + counts[2] * (40 + marked) > BROADCAST_BOUND:
            raise ValueError("the network is too large to be sent to executors; use search.costs_from for whole-network costs")
        landmarks = self._marked(nodes) if self.marks else None
        nodes = nodes.orderBy("node").toArrow().to_pandas()
        index = {int(n): i for i, n in enumerate(nodes["node"])}
        _, component = np.unique(nodes["component"].to_numpy(), return_inverse=True) if len(nodes) else (None, np.zeros(0, np.int64))
        chain = chains.orderBy("chain_id").toArrow().to_pandas()
        chain_index = {int(c): i for i, c in enumerate(chain["chain_id"])}
        segs = segments.orderBy("chain_id", "pos").toArrow().to_pandas()
        edges = edges.toArrow().to_pandas()
        src = np.array([index[int(n)] for n in edges["src"]], np.int64)
        dst = np.array([index[int(n)] for n in edges["dst"]], np.int64)
        ref = np.array([2 * chain_index[int(c)] + int(r) for c, r in zip(edges["chain_id"], edges["reversed"], strict=True)], np.int64)
        order = np.lexsort((ref, src)) if len(src) else np.zeros(0, np.int64)
        offset = np.searchsorted(src[order], np.arange(len(nodes) + 1))
        count = chain["n_segments"].to_numpy(np.int64) if len(chain) else np.zeros(0, np.int64)
        points = np.array([self.metric.embed_py(x, y) for x, y in zip(nodes["x"], nodes["y"], strict=True)]).reshape(len(nodes), -1)
        table = {
            "ids": chain["chain_id"].to_numpy(np.int64), "first": np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64), "count": count,
            "from": np.array([index[int(n)] for n in chain["from_node"]], np.int64), "to": np.array([index[int(n)] for n in chain["to_node"]], np.int64),
            "along": segs["cost_along"].to_numpy(float), "against": segs["cost_against"].to_numpy(float), "length": segs["length"].to_numpy(float),
            "feature": segs["feature_idx"].to_numpy(np.int64), "part": segs["part"].to_numpy(np.int64), "seg": segs["seg_id"].to_numpy(np.int64),
            **{k: segs[k].to_numpy(float) for k in ("ux", "uy", "uz", "vx", "vy", "vz", "u_measure", "v_measure")},
            "u_grp": segs["u_grp"].to_numpy(object), "v_grp": segs["v_grp"].to_numpy(object),
        }
        ordinals = None
        if levels is not None:
            ordinals = np.array([levels.get(g, (np.nan, np.nan))[0] for g in nodes["grp"]], float)
            table |= {f"{k}_elevation": segs[f"{k}_elevation"].to_numpy(float) for k in "uv"}
        cut = np.flatnonzero(nodes["cut"].to_numpy(bool)).tolist() if "cut" in nodes else []
        return Net(nodes["node"].to_numpy(np.int64), offset, dst[order], edges["cost"].to_numpy(float)[order] if len(edges) else np.zeros(0), ref[order], component, points, self.heuristic_scale(), self.per_level, ordinals, table, landmarks, levels=None if levels is None else {g: o for g, (o, _) in levels.items()}, cut=frozenset(cut))

    def _marked(self, nodes: DataFrame) -> tuple[list[list[float]], list[list[float]]]:
        """Costs from each landmark to these nodes in ascending order, and back."""
        rows = self.marks[1].join(_sendable(settled(nodes.select("node"))), "node", "left_semi").orderBy("landmark", "node").toArrow().to_pandas()
        by = {int(k): one for k, one in rows.groupby("landmark")}
        return tuple([by[k][c].tolist() for k in self.marks[0] if k in by] for c in ("d_from", "d_to"))

    def shared_net(self):
        """The compact form as a broadcast variable, made once."""
        if "broadcast" not in self._sent:
            self._sent["broadcast"] = self.spark.sparkContext.broadcast(self.net())
        return self._sent["broadcast"]

    # --- persistence ---

    def save(self, path: str, meta: dict | None = None) -> None:
        """Writes each table as Parquet under path, and _meta, one JSON line with the format, metric, counts and ``meta``."""
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        head = {"format": FORMAT, "version": VERSION, "metric": self.metric.name, "latitude": self.metric.latitude, "per_level": self.per_level, "stats": self.stats(), "meta": tagged(meta or {})}
        self.spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta.json")

    @staticmethod
    def inspect(spark: SparkSession, path: str) -> dict:
        """The header alone: format, version, metric, stats and meta. Raises TypeError for another format, ValueError for another version."""
        head = json.loads(spark.read.text(f"{path}/_meta.json").first()[0])
        if head.get("format") != FORMAT:
            raise TypeError("not a saved graph")
        if head["version"] != VERSION:
            raise ValueError(f"unknown version {head['version']}")
        return head | {"meta": untagged(head["meta"])}

    @staticmethod
    def load(spark: SparkSession, path: str) -> Graph:
        head = Graph.inspect(spark, path)
        return Graph(spark, Metric(head["metric"], head["latitude"]), *(spark.read.parquet(f"{path}/{name}") for name in TABLES), per_level=head["per_level"])


def _sendable(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids


def tagged(value):
    """JSON cannot hold NaN, infinities and -0: they become {"$number": name}."""
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf")) or (value == 0 and str(value)[0] == "-")):
        return {"$number": str(value)}
    if isinstance(value, dict):
        return {k: tagged(v) for k, v in value.items()}
    return [tagged(v) for v in value] if isinstance(value, list) else value


def untagged(value):
    if isinstance(value, dict):
        return float(value["$number"]) if set(value) == {"$number"} else {k: untagged(v) for k, v in value.items()}
    return [untagged(v) for v in value] if isinstance(value, list) else value


def build(features: DataFrame, options: Options | None = None, extra_segments: DataFrame | None = None) -> Graph:
    """The network of features(feature_idx, id, geom_type, parts, props), each stage settled where several follow."""
    from spanwright.operators import levels as lv
    from spanwright.operators import repair

    o = options or Options()
    spark = features.sparkSession
    table = None if o.levels is None else o.levels.withColumns({k: (F.col(k) if k in o.levels.columns else F.lit(None)).cast("double") for k in ("ordinal", "elevation")})
    coords = tp.coordinates(features, o.group, o.end_group, o.node_id)
    rides = None
    if o.connectors is not None:
        rides = settled(lv.ride_features(o.connectors, table, features.agg(F.coalesce(F.max("feature_idx"), F.lit(-1))).first()[0] + 1))
        coords = coords.unionByName(tp.coordinates(rides, F.col("grp_a"), F.col("grp_b")))
    metric = Metric(o.metric)
    if metric.geographic:
        tp.check_geographic(coords)
        box = tp.extent(coords).first()
        metric = Metric(o.metric, 0.0 if not box["n"] else (box["min_y"] + box["max_y"]) / 2)
    repairs = spark.createDataFrame([], REPAIR)
    if o.tolerance > 0 or o.node_id is not None:
        placed, log = tp.merged_vertices(coords, metric, o.tolerance)
        repairs = repairs.unionByName(log.select(F.lit("merge").alias("kind"), "x", "y", F.lit(None).cast("long").alias("feature_a"), F.lit(None).cast("long").alias("feature_b"), "gap"))
    else:
        placed = tp.exact_vertices(coords)
    segs = tp.segments(settled(placed), metric)
    if o.snap_dangles > 0:
        segs, log = repair.snap_dangles(segs, metric, o.snap_dangles, o.tolerance)
        repairs = repairs.unionByName(log)
    if o.split_intersections:
        segs, log = repair.split_intersections(segs, metric, o.tolerance)
        repairs = repairs.unionByName(log)
    segs = tp.with_measures(segs)
    if extra_segments is not None:
        segs = segs.unionByName(extra_segments, allowMissingColumns=True)
    if o.weight is not None and "props" in features.columns:
        segs = segs.join(features.select("feature_idx", "props"), "feature_idx", "left")
    weight = o.weight
    if rides is not None:
        own = rides.select("feature_idx", F.struct(F.col("forward").alias("forward"), F.col("backward").alias("backward")).alias("ride"))
        segs = segs.join(own, "feature_idx", "left")
        plain = weight if weight is not None else F.struct(F.col("length").alias("forward"), F.col("length").alias("backward"))
        weight = F.when(F.col("ride").isNotNull(), F.col("ride")).otherwise(plain)
    weighted = settled(ch.weighted(segs, weight, o.zero_weight == "free").drop("props", "ride"))
    if table is None:
        return assemble(weighted, metric, o.compact, repairs)
    graph = assemble(lv.elevations(weighted, table), metric, o.compact, repairs)
    runs = lv.connector_runs(weighted.filter("alive"), table, metric)
    least = lv.per_level_bound(runs, graph.heuristic_scale()).first()["per_level"]
    return replace(graph, levels=settled(table), per_level=float(least) * (1 - 1e-6))


def assemble(segs: DataFrame, metric: Metric, compact: bool = True, repairs: DataFrame | None = None) -> Graph:
    """The network of weighted segments."""
    spark = segs.sparkSession
    if repairs is None:
        repairs = spark.createDataFrame([], REPAIR)
    linked = settled(ch.chain_segments(segs, ch.chains(segs, compact)))
    totals = settled(ch.chain_totals(linked))
    edges = settled(ch.directed_edges(totals))
    places = linked.select(F.explode(F.array(F.struct(F.col("u").alias("vertex"), F.col("ux").alias("vx"), F.col("uy").alias("vy"), F.col("uz").alias("vz"), F.col("u_grp").alias("grp")), F.struct(F.col("v").alias("vertex"), F.col("vx").alias("vx"), F.col("vy").alias("vy"), F.col("vz").alias("vz"), F.col("v_grp").alias("grp")))).alias("p")).select("p.*").dropDuplicates(["vertex"])
    vertices = settled(places)
    labels = ch.weak_components(totals)
    nodes = settled(labels.join(vertices.select(F.col("vertex").alias("node"), F.col("vx").alias("x"), F.col("vy").alias("y"), "grp"), "node"))
    return Graph(spark, metric, vertices, linked, totals, edges, nodes, repairs)
