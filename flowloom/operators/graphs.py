"""Graphs of flows and of hosts, and propagation of features along edges."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions import numeric
from flowloom.operators.neighbours import knn_edges
from flowloom.operators.ordering import sorted_ordinal
from flowloom.operators.skew import hot_keys, lookup_join, skew_join
from flowloom.sources import scratch


def knn_graph(df, key, labeled, features="features", k=10, edges="labeled", least=3, **search):
    """(nodes, edges): every row is a node, edges join labelled rows only.

    ``labeled`` is a table of keys. ``edges="all"`` searches among all rows.
    Fewer than ``least`` rows have no neighbours worth the name; each then has
    only a loop to itself. ``search`` goes to ``knn_edges``, ``mode="lsh"`` for one.
    """
    pool = df if edges == "all" else df.join(labeled.select(key), key, "left_semi")
    if pool.limit(least).count() < least:
        loops = self_loops(pool, key)
        return df, loops.withColumns({"rank": F.lit(1), "distance": F.lit(0.0)})
    return df, knn_edges(pool, key, features, k, **search)


def endpoints(flows, src, dst):
    """Each flow once per end: column ``node``, and ``side`` 0 for the source."""
    ends = F.explode(
        F.array(
            F.struct(F.col(src).alias("node"), F.lit(0).alias("side")),
            F.struct(F.col(dst).alias("node"), F.lit(1).alias("side")),
        )
    )
    return flows.withColumn("_end", ends).select(*flows.columns, "_end.node", "_end.side")


def hosts(flows, src, dst):
    return flows.select(F.col(src).alias("node")).union(flows.select(F.col(dst))).distinct()


def host_features(flows, src, dst, columns):
    """Mean of the flows at either end of a host."""
    return endpoints(flows, src, dst).groupBy("node").agg(*[F.avg(c).alias(c) for c in columns])


FIXED_WIDTH = (T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def host_votes(flows, src, dst, columns, label, order):
    """Per host and label the votes, the least value of the first ``order`` column, sums and counts.

    What decides most ties has a fixed width, so rows are hashed and neither sorted nor
    sent with the whole order; ``_open`` tells of a missing value, which comes first.
    """
    dated = isinstance(flows.schema[order[0]].dataType, FIXED_WIDTH)
    votes = endpoints(flows, src, dst).groupBy("node", label).agg(
        F.count(F.lit(1)).alias("_votes"),
        *([F.min(order[0]).alias("_early"), F.max(F.col(order[0]).isNull()).alias("_open")] if dated else []),
        *[F.sum(c).alias(f"_s_{c}") for c in columns],
        *[F.count(c).alias(f"_n_{c}") for c in columns],
    )
    early = F.when(~F.col("_open"), F.col("_early")) if dated else F.lit(None)
    return votes.withColumns({"_open": F.col("_open") if dated else F.lit(True), "_early": early})


def host_nodes(flows, src, dst, columns, label, order):
    """(node, label, mean features): one row per host.

    Sums and votes are taken per host and label first, which also splits a busy
    host between the map sides of both shuffles. Only hosts whose first labels have as
    many votes and start at the same value of the first ``order`` column are read again,
    by the whole order.
    """
    host = Window.partitionBy("node")
    place = F.struct((-F.col("_votes")).alias("votes"), (~F.col("_open")).alias("known"), "_early")
    leading = (
        host_votes(flows, src, dst, columns, label, order)
        .withColumns({"_place": place, "_best": F.min(place).over(host)})
        .withColumns({c: F.try_divide(F.sum(f"_s_{c}").over(host), F.sum(f"_n_{c}").over(host)) for c in columns})
        .filter(F.col("_place") == F.col("_best"))
        .withColumn("_tied", F.count(F.lit(1)).over(host))
        .select("node", label, *columns, "_early", "_tied")
    )
    leading = scratch.materialise(leading, "hosts")
    tied = leading.filter("_tied > 1")
    if tied.isEmpty():
        return leading.select("node", label, *columns)
    asked = scratch.broadcast_if_small(
        tied.select(F.col("node").alias("_node"), F.col(label).alias("_label"), F.col("_early").alias("_from"))
    )
    same = F.col("node").eqNullSafe(F.col("_node")) & F.col(label).eqNullSafe(F.col("_label"))
    if isinstance(flows.schema[order[0]].dataType, FIXED_WIDTH):
        same = same & F.col(order[0]).eqNullSafe(F.col("_from"))
    ends = endpoints(flows.select(*dict.fromkeys([src, dst, label, *order])), src, dst)
    seen = ends.join(asked, same).groupBy("_node", "_label").agg(
        F.min(F.struct(*[F.col(c) for c in order], F.col("side"))).alias("_seen")
    )
    won = scratch.materialise(seen.groupBy("_node").agg(F.min_by("_label", "_seen").alias("_label")), "hosts")
    same = F.col("node").eqNullSafe(F.col("_node")) & F.col(label).eqNullSafe(F.col("_label"))
    settled = leading.filter("_tied = 1").unionByName(tied.join(won, same, "left_semi"))
    return settled.select("node", label, *columns)


def host_labels(flows, src, dst, label, order):
    """Majority label per host; a tie goes to the label that was seen first."""
    return host_nodes(flows, src, dst, [], label, order)


def host_ids(flows, src, dst):
    """(node, node_id): hosts numbered in sorted order."""
    return sorted_ordinal(hosts(flows, src, dst), ["node"], (), "node_id")


def numbered(nodes):
    """``nodes`` with ``node_id``, hosts in sorted order; a host without an address takes a number and goes."""
    return sorted_ordinal(nodes, ["node"], (), "node_id").filter(F.col("node").isNotNull())


def host_edges(flows, src, dst, columns, ids=None):
    """(src, dst, columns): one directed edge per flow, hosts by number."""
    ids = host_ids(flows, src, dst) if ids is None else ids
    return edge_ids(flows, ids, src, dst).select("src", "dst", *columns)


def host_graph(flows, src, dst, columns, label, order):
    """(nodes, edges): one node per host, one directed edge per flow.

    Nodes carry the mean features and majority label of their flows, edges the
    flow's own features; parallel edges are kept. Who needs one of the two calls
    ``host_nodes`` or ``host_edges``.
    """
    nodes = numbered(host_nodes(flows, src, dst, columns, label, order))
    return nodes, host_edges(flows, src, dst, columns, nodes.select("node", "node_id"))


def edge_ids(flows, ids, src, dst):
    """Both addresses looked up in ``ids``; a busy host does not skew the join."""
    start = ids.select(F.col("node").alias(src), F.col("node_id").alias("src"))
    end = ids.select(F.col("node").alias(dst), F.col("node_id").alias("dst"))
    return lookup_join(lookup_join(flows, start, src), end, dst)


def degree_stats(n_nodes, n_edges):
    """One row from two counts (frames with a single ``n``)."""
    nodes, edges = n_nodes.first()[0], n_edges.first()[0]
    spark = n_nodes.sparkSession
    return spark.createDataFrame(
        [(nodes, edges, edges / nodes if nodes else None)],
        "nodes long, edges long, avg_degree double",
    )


def self_loops(nodes, key):
    return nodes.select(F.col(key).alias("src"), F.col(key).alias("dst"))


def neighbour_mean(nodes, edges, key, columns):
    """Plain mean of the rows that point to a row."""
    source = nodes.select(F.col(key).alias("src"), *columns)
    return (
        skew_join(edges.select("src", "dst"), source, "src")
        .groupBy(F.col("dst").alias(key))
        .agg(*[F.avg(c).alias(c) for c in columns])
    )


def propagate(nodes, edges, key, columns, hops=1):
    """Symmetric-normalised propagation with self-loops, ``hops`` times.

    A row becomes the sum over incoming edges i->j of x_i / sqrt(d_i d_j) plus
    x_j / d_j, where d is the in-degree plus one. A self-loop among the edges
    is not counted twice. Values travel divided by sqrt(d), which leaves one
    join and one sum per hop, and a hop is read once, by the next.
    """
    kept = [c for c in nodes.columns if c not in columns]
    loops = nodes.select(F.col(key).alias("src"), F.col(key).alias("dst"))
    links = edges.select("src", "dst").filter(F.col("src") != F.col("dst")).unionByName(loops)
    if hops > 1:
        links = scratch.materialise(links, "links")
    hot = hot_keys(links, "src")
    degree = links.groupBy(F.col("dst").alias(key)).agg(F.count(F.lit(1)).alias("_d"))
    sent = nodes.join(degree, key).selectExpr(
        f"`{key}` AS src", *[f"`{c}` / sqrt(_d) AS `{c}`" for c in columns]
    )
    for hop in range(hops):
        got = (
            skew_join(links, sent, "src", hot=hot)
            .groupBy("dst")
            .agg(F.expr("count(1) AS _d"), *[F.expr(f"sum(`{c}`) AS `{c}`") for c in columns])
        )
        last = hop + 1 == hops
        scale = "sqrt(_d)" if last else "_d"
        sent = got.selectExpr(
            f"dst AS {'`' + key + '`' if last else 'src'}",
            *[f"`{c}` / {scale} AS `{c}`" for c in columns],
        )
    return nodes.select(*kept).join(sent, key).select(*kept, *columns)


def seeded_layers(widths, seed=42):
    """Reproducible dense layers with neutral normalisation, for smoke runs."""
    rng = np.random.default_rng(seed)
    layers = []
    for wide, narrow in zip(widths[:-1], widths[1:]):
        limit = np.sqrt(6.0 / (wide + narrow))
        layers.append(
            {
                "weight": rng.uniform(-limit, limit, (wide, narrow)),
                "bias": np.zeros(narrow),
                "gain": np.ones(narrow),
                "shift": np.zeros(narrow),
                "mean": np.zeros(narrow),
                "var": np.ones(narrow),
            }
        )
    return layers


def dense(nodes, columns, layer, outputs, activate=True, eps=1e-5):
    """Rows times a weight matrix, then the stored normalisation and ReLU."""
    kept = [f for f in nodes.schema.fields if f.name not in columns]
    schema = T.StructType([*kept, *[T.StructField(c, T.DoubleType()) for c in outputs]])
    names = [f.name for f in kept]

    def run(batches):
        for part in batches:
            out = part[columns].to_numpy(dtype=np.float64) @ layer["weight"] + layer["bias"]
            if activate:
                out = (out - layer["mean"]) / np.sqrt(layer["var"] + eps)
                out = np.maximum(out * layer["gain"] + layer["shift"], 0.0)
            result = part[names].copy()
            for i, c in enumerate(outputs):
                result[c] = out[:, i]
            yield result

    return nodes.mapInPandas(run, schema)


def gcn_layer(nodes, edges, key, columns, layer):
    """Propagate, multiply, normalise, ReLU."""
    outputs = [f"h{i}" for i in range(layer["weight"].shape[1])]
    return dense(propagate(nodes, edges, key, columns), columns, layer, outputs), outputs


def gcn_logits(nodes, edges, key, columns, layers, head):
    """Graph layers followed by the dense head: columns z0, z1, ..."""
    for layer in layers:
        nodes, columns = gcn_layer(nodes, edges, key, columns, layer)
        nodes = scratch.materialise(nodes, "gcn")
    for layer in head[:-1]:
        outputs = [f"h{i}" for i in range(layer["weight"].shape[1])]
        nodes, columns = dense(nodes, columns, layer, outputs), outputs
    classes = [f"z{i}" for i in range(head[-1]["weight"].shape[1])]
    return dense(nodes, columns, head[-1], classes, activate=False), classes


def class_scores(df, logits):
    """Log-probabilities, probabilities and the arg-max class of logit columns."""
    columns = [F.col(c) for c in logits]
    logs = numeric.log_softmax(columns)
    out = df.withColumns({f"logp{i}": v for i, v in enumerate(logs)})
    out = out.withColumns({f"p{i}": F.exp(f"logp{i}") for i in range(len(logits))})
    probs = F.array(*[F.col(f"p{i}") for i in range(len(logits))])
    return out.withColumn(
        "pred", (F.array_position(probs, F.array_max(probs)) - 1).cast("int")
    )
