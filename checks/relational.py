"""Scans, filters, aggregates, equi-joins and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import COUNTS, EVENTS, POINTS, RAW, query, r, with_
from gridloom.operators import matrix as M
from gridloom.operators import numbering as N
from gridloom.operators import sampling as S
from gridloom.operators import standardize as ST
from gridloom.operators.assignment import backfill_thresholds, decode_cells, keep_best_rows
from gridloom.operators.buffered_counts import merge_counts, panel_order
from gridloom.operators.contamination import type_shares
from gridloom.operators.graph import reference_edges, training_points
from gridloom.operators.outlines import boundary_union, flag_nuclei, ring_offsets
from gridloom.operators.tiling import tile_sizes
from gridloom.plans.export import build_matrix, load_assigned
from gridloom.schemas import COSMX_POINTS, XENIUM_POINTS, XENIUM_V1_POINTS
from gridloom.sources.tables import cell_labels, read_region, xy_bounds

_CONTROL = "regexp_matches(feature_name, 'NegControlProbe_*|antisense_*|NegControlCodeword*|BLANK_*|DeprecatedCodeword_*|UnassignedCodeword_*')"

# --- scans and filters ----------------------------------------------------------


@query(
    "s_overlap_points",
    with_(RAW)
    + f"""SELECT row_index, x, y, feature_name, cell_id,
      CASE WHEN l_returnflag = 'R' THEN 2 WHEN cell_id IS NOT NULL THEN 1 ELSE 0 END AS cell_compartment
      FROM raw WHERE qv >= 20 AND NOT {_CONTROL}""",
)
def s_overlap_points(t):
    return ST.standardize_overlap_points(t.raw_points, XENIUM_POINTS)


@query(
    "s_overlap_points_v1",
    with_(RAW)
    + f"""SELECT row_index, x, y, feature_name, cell_id,
      CASE WHEN l_returnflag = 'R' THEN 2 WHEN cell_id IS NOT NULL THEN 1 ELSE 0 END AS cell_compartment
      FROM raw WHERE qv >= 20 AND NOT {_CONTROL}""",
)
def s_overlap_points_v1(t):
    raw = t.raw_points.withColumn(
        "cell_id", F.when(F.col("cell_id") == "UNASSIGNED", "-1").otherwise(F.col("cell_id")).cast("binary")
    )
    return ST.standardize_overlap_points(raw, XENIUM_V1_POINTS)


@query(
    "s_compartment_points",
    with_(RAW)
    + """SELECT row_index, x, y, feature_name,
      CASE WHEN l_returnflag <> 'N' THEN cell_id END AS cell_id,
      CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS cell_compartment
      FROM raw WHERE NOT regexp_matches(feature_name, 'Negative*|SystemControl*|NegPrb*')""",
)
def s_compartment_points(t):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    name = (
        F.when(flag == "R", "Nuclear")
        .when((flag == "A") & (status == "F"), "Membrane")
        .when(flag == "A", "Cytoplasm")
        .when(status == "O", "None")
    )
    raw = t.raw_points.select(
        "row_index",
        F.col("x_location").alias("x_global_px"),
        F.col("y_location").alias("y_global_px"),
        F.col("feature_name").alias("target"),
        F.col("cell_id").alias("cell"),
        name.alias("CellComp"),
    )
    return ST.standardize_compartment_points(raw, COSMX_POINTS)


@query(
    "s_region_scan",
    "SELECT value, user_id, event_type FROM events WHERE value > 20 AND value < 200 AND user_id > 10 AND user_id < 90 AND event_type <> 'click'",
)
def s_region_scan(t):
    return read_region(
        t.spark, t.path("events"), "value", "user_id", (20, 10, 200, 90), ["event_type"], F.col("event_type") != "click"
    )


@query(
    "s_xy_bounds",
    """SELECT min(l_extendedprice) AS x_min, min(l_quantity) AS y_min, max(l_extendedprice) AS x_max,
       max(l_quantity) AS y_max FROM lineitem""",
)
def s_xy_bounds(t):
    return xy_bounds(t.spark, t.path("lineitem"), "l_extendedprice", "l_quantity")


@query("s_cell_labels", "SELECT DISTINCT event_type AS cell_id FROM events")
def s_cell_labels(t):
    return cell_labels(t.events.select(F.concat("event_type", F.lit("\u0000\u0000")).alias("cell_id")))


@query(
    "s_version_numbers",
    "SELECT p_partkey, p_size AS major, p_partkey % 10 AS minor, 2 AS parts FROM part",
)
def s_version_numbers(t):
    text = F.concat(F.lit("Soft-ware-"), F.col("p_size").cast("string"), F.lit("."), F.pmod("p_partkey", F.lit(10)).cast("string"))
    v = ST.version_numbers(text)
    return t.part.select("p_partkey", v[0].alias("major"), v[1].alias("minor"), F.size(v).alias("parts"))


@query(
    "s_fov_names",
    """SELECT n_nationkey, 'c_1_' || n_nationkey || '_' || n_regionkey AS cell_id,
       'CellLabels_F' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '.tif' AS file FROM nation""",
)
def s_fov_names(t):
    return t.nation.select(
        "n_nationkey",
        ST.fov_cell_id(F.lit(1), F.col("n_nationkey"), F.col("n_regionkey")).alias("cell_id"),
        ST.fov_file_name("CellLabels", F.col("n_nationkey")).alias("file"),
    )


@query("s_parquet_row_index", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM events")
def s_parquet_row_index(t):
    return N.parquet_row_index(t.events).select("row_index")


@query("s_file_order_index", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM events")
def s_file_order_index(t):
    return N.file_order_index(t.events).select("row_index")


@query(
    "s_panel_order",
    with_(POINTS)
    + """SELECT cell_id, CAST(substr(feature_name, 7) AS INT) AS gene_order, upper(feature_name) AS gene_name, count(*) AS n
      FROM points WHERE cell_id IS NOT NULL GROUP BY ALL""",
)
def s_panel_order(t):
    panel = t.part.select(
        F.col("p_brand").alias("codeword"),
        F.substring("p_brand", 7, 5).cast("int").alias("gene_order"),
        F.upper("p_brand").alias("gene_name"),
    ).distinct()
    return panel_order(M.count_matrix(t.points).withColumnRenamed("feature_name", "codeword_index"), panel)


@query(
    "f_regex_control",
    "SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, 'page_*|ref=*|index*')",
)
def f_regex_control(t):
    return t.pages.where(ST.not_control(F.col("url"), ["page_*", "ref=*", "index*"])).select("page_id", "url")


@query(
    "f_quality_both",
    """SELECT l_suppkey, count(*) FILTER (l_quantity >= 20) AS ingest, count(*) FILTER (l_quantity > 20) AS metric
       FROM lineitem GROUP BY l_suppkey""",
)
def f_quality_both(t):
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count_if(q >= 20).alias("ingest"), F.count_if(q > 20).alias("metric")
    )


@query(
    "f_reference_mask",
    with_(POINTS)
    + """SELECT cell_compartment, cell_compartment = 2 AS in_nucleus, cell_compartment IN (1, 2) AS in_cell, count(*) AS n
      FROM points GROUP BY ALL""",
)
def f_reference_mask(t):
    c = F.col("cell_compartment")
    return t.points.groupBy(
        c, ST.reference_mask(c, "nucleus").alias("in_nucleus"), ST.reference_mask(c, "cell").alias("in_cell")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f_null_sentinel",
    "SELECT l_returnflag, nullif(l_returnflag, 'N') AS flag, count(*) AS n FROM lineitem GROUP BY ALL",
)
def f_null_sentinel(t):
    return t.lineitem.groupBy(
        "l_returnflag", ST.null_if_sentinel(F.col("l_returnflag"), "N").alias("flag")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f_strict_map",
    """SELECT event_type, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 WHEN 'purchase' THEN 4
       ELSE 5 END AS code, count(*) AS n FROM events GROUP BY ALL""",
)
def f_strict_map(t):
    # Known names get their code; a name outside the list is passed as null, which has its own code.
    names = {"click": 1, "view": 2, "error": 3, "purchase": 4}
    known = F.when(F.col("event_type").isin(list(names)), F.col("event_type"))
    return t.events.groupBy("event_type", ST.strict_map(known, names, 5).alias("code")).agg(F.count(F.lit(1)).alias("n"))


# --- aggregates -----------------------------------------------------------------


@query("a_cell_gene_counts", with_(POINTS, COUNTS) + "SELECT * FROM counts")
def a_cell_gene_counts(t):
    return M.count_matrix(t.points)


@query(
    "a_mean_score",
    with_(POINTS)
    + "SELECT cell_id, feature_name, round(avg(qv), 6) + 0 AS mean_score FROM points WHERE cell_id IS NOT NULL GROUP BY ALL",
)
def a_mean_score(t):
    return M.mean_score_layer(t.points, "qv").withColumn("mean_score", r("mean_score"))


@query(
    "a_centroids",
    with_(POINTS)
    + "SELECT cell_id, round(avg(x), 4) + 0 AS x, round(avg(y), 4) + 0 AS y FROM points WHERE cell_id IS NOT NULL GROUP BY ALL",
)
def a_centroids(t):
    return M.centroids(t.points).select("cell_id", r("x", 4).alias("x"), r("y", 4).alias("y"))


@query(
    "a_totals",
    with_(POINTS, COUNTS)
    + """SELECT cell_id AS key, CAST(sum(n) AS BIGINT) AS n_counts FROM counts GROUP BY 1
      UNION ALL SELECT feature_name, CAST(sum(n) AS BIGINT) FROM counts GROUP BY 1""",
)
def a_totals(t):
    c = M.count_matrix(t.points)
    by_cell = M.totals(c, "cell_id").withColumnRenamed("cell_id", "key")
    return by_cell.unionByName(M.totals(c, "feature_name").withColumnRenamed("feature_name", "key"))


_KEPT = """genes AS (SELECT feature_name FROM counts GROUP BY 1 HAVING sum(n) >= 1500),
kept AS (SELECT * FROM counts WHERE feature_name IN (SELECT feature_name FROM genes)),
cells AS (SELECT cell_id, CAST(sum(n) AS BIGINT) AS n_counts, sum(n) >= 380 AS filtered FROM kept GROUP BY 1)"""


def _kept(t):
    counts = M.keep_genes(M.count_matrix(t.points), 1500)
    return counts, M.cell_totals(counts, 380)


@query("a_keep_thresholds", with_(POINTS, COUNTS, _KEPT) + "SELECT * FROM cells")
def a_keep_thresholds(t):
    return _kept(t)[1]


@query(
    "a_exact_median",
    with_(POINTS, COUNTS, _KEPT) + "SELECT CAST(median(n_counts) AS DOUBLE) AS median FROM cells WHERE filtered",
)
def a_exact_median(t):
    return t.spark.range(1).select(M.exact_median(_kept(t)[1].where("filtered"), "n_counts").alias("median"))


@query(
    "m_depth_normalize",
    with_(POINTS, COUNTS, _KEPT)
    + """SELECT cell_id, feature_name, n, filtered,
      round(n * (SELECT median(n_counts) FROM cells WHERE filtered) / n_counts, 6) + 0 AS norm FROM kept JOIN cells USING (cell_id)""",
)
def m_depth_normalize(t):
    return M.depth_normalize(*_kept(t)).withColumn("norm", r("norm"))


@query(
    "a_type_shares",
    "SELECT p_type AS cell_type, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1",
)
def a_type_shares(t):
    return type_shares(t.part.withColumnRenamed("p_type", "cell_type")).withColumn("share", r("share"))


@query(
    "a_gene_correlation",
    with_(POINTS, COUNTS)
    + """, g AS (SELECT feature_name, c.cell_id, coalesce(n, 0) AS v FROM (SELECT DISTINCT feature_name FROM counts)
        CROSS JOIN (SELECT DISTINCT cell_id FROM counts) c LEFT JOIN counts USING (cell_id, feature_name))
      SELECT a.feature_name AS gene_a, b.feature_name AS gene_b, round(coalesce(corr(a.v, b.v), 0), 6) + 0 AS r
      FROM g a JOIN g b ON a.cell_id = b.cell_id AND a.feature_name <= b.feature_name GROUP BY 1, 2""",
)
def a_gene_correlation(t):
    counts = M.count_matrix(t.points)
    n_cells = counts.agg(F.countDistinct("cell_id")).scalar()
    out = M.gene_correlation(counts.withColumn("norm", F.col("n").cast("double")), n_cells)
    return out.withColumn("r", r("r"))


@query(
    "a_bool_any",
    """SELECT l_suppkey AS cell_id, l_returnflag AS boundary, bool_or(l_returnflag = 'R' AND l_quantity = 50)
       OVER (PARTITION BY l_suppkey) AS contains_nucleus FROM lineitem""",
)
def a_bool_any(t):
    kind = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") == 50), "nucleus").otherwise("cell")
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("cell_id"), F.col("l_returnflag").alias("boundary"), kind.alias("boundary_type")
    )
    return flag_nuclei(rows).select("cell_id", "boundary", "contains_nucleus")


@query(
    "a_merge_counts",
    with_(POINTS)
    + "SELECT cell_id, feature_name, count(*) AS n FROM points WHERE cell_id IS NOT NULL GROUP BY ALL",
)
def a_merge_counts(t):
    low, high = t.points.where("qv < 20"), t.points.where("qv >= 20")
    return merge_counts(M.count_matrix(low), M.count_matrix(high))


@query(
    "a_dense_codes",
    "SELECT p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT p_brand FROM part)",
)
def a_dense_codes(t):
    return N.encode(t.part, "p_brand", "code")


@query(
    "a_tile_sizes",
    """SELECT tile_id, count(*) AS size, CAST(coalesce(sum(count(*)) OVER (ORDER BY tile_id ROWS BETWEEN UNBOUNDED PRECEDING
       AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM (SELECT o_custkey AS tile_id FROM orders) GROUP BY tile_id""",
)
def a_tile_sizes(t):
    return tile_sizes(t.orders.select(F.col("o_custkey").alias("tile_id")))


@query(
    "a_backfill_thresholds",
    """WITH th AS (SELECT p_partkey, p_retailprice AS v, p_size % 4 <> 0 AS converged FROM part)
       SELECT p_partkey, converged, CASE WHEN converged THEN v ELSE (SELECT quantile_cont(v, 0.5) FROM th WHERE converged) END
       AS similarity_threshold FROM th""",
)
def a_backfill_thresholds(t):
    return backfill_thresholds(
        t.part.select(
            "p_partkey", F.col("p_retailprice").alias("similarity_threshold"), (F.pmod("p_size", F.lit(4)) != 0).alias("converged")
        )
    )


# --- joins ----------------------------------------------------------------------

_TRAIN = """genes AS (SELECT p_brand AS feature_name, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INT) AS gene_encoding
  FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand <> 'Brand#7')),
cells AS (SELECT CAST(s_suppkey AS VARCHAR) AS cell_id, CAST(s_suppkey AS INT) AS cell_encoding, s_nationkey AS cluster
  FROM supplier WHERE s_suppkey % 5 <> 0),
training AS (SELECT p.row_index, p.x, p.y, p.feature_name, p.cell_id, p.cell_compartment, c.cell_encoding, g.gene_encoding,
  coalesce(c.cluster, -1) AS cell_cluster, g.gene_encoding % 3 AS gene_cluster
  FROM points p JOIN genes g ON p.feature_name = g.feature_name
  LEFT JOIN cells c ON c.cell_id = CASE WHEN p.cell_compartment = 2 THEN p.cell_id END)"""


def _genes(t):
    g = N.encode(t.part.where("p_brand <> 'Brand#7'"), "p_brand", "gene_encoding").withColumnRenamed("p_brand", "feature_name")
    return g.withColumn("cluster", F.pmod("gene_encoding", F.lit(3)))


def _cells(t):
    return t.supplier.where("s_suppkey % 5 <> 0").select(
        F.col("s_suppkey").cast("string").alias("cell_id"),
        F.col("s_suppkey").alias("cell_encoding"),
        F.col("s_nationkey").alias("cluster"),
    )


@query("j_training_points", with_(POINTS, _TRAIN) + "SELECT * FROM training")
def j_training_points(t):
    return training_points(t.points, _genes(t), _cells(t), "nucleus")


@query(
    "j_reference_edges",
    with_(POINTS, _TRAIN)
    + """SELECT row_index AS src, CAST(cell_encoding AS BIGINT) AS dst FROM training
      WHERE cell_compartment = 2 AND cell_encoding IS NOT NULL""",
)
def j_reference_edges(t):
    return reference_edges(training_points(t.points, _genes(t), _cells(t), "nucleus"), "nucleus")


_PRED = """pred AS (SELECT row_index, CASE WHEN cell_id IS NULL THEN -1 ELSE CAST(cell_id AS BIGINT) END AS cell_encoding,
  qv / 50 AS similarity, CAST(substr(feature_name, 7) AS BIGINT) AS gene_encoding FROM points
  UNION ALL SELECT row_index, 3, round(x / 1100, 3), CAST(substr(feature_name, 7) AS BIGINT) FROM points WHERE cell_compartment = 1)"""


def _predictions(t):
    gene = F.substring("feature_name", 7, 5).cast("long").alias("gene_encoding")
    first = t.points.select(
        "row_index", F.coalesce(F.col("cell_id").cast("long"), F.lit(-1)).alias("cell_encoding"), (F.col("qv") / 50).alias("similarity"), gene
    )
    second = t.points.where("cell_compartment = 1").select(
        "row_index", F.lit(3).cast("long").alias("cell_encoding"), F.round(F.col("x") / 1100, 3).alias("similarity"), gene
    )
    return first.unionByName(second)


_BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_index ORDER BY similarity DESC, cell_encoding) AS k
  FROM pred) WHERE k = 1)"""


@query(
    "w_keep_best_rows",
    with_(POINTS, _PRED, _BEST) + "SELECT row_index, cell_encoding, similarity, gene_encoding FROM best",
)
def w_keep_best_rows(t):
    return keep_best_rows(_predictions(t))


@query(
    "j_decode_cells",
    with_(POINTS, _TRAIN, _PRED, _BEST)
    + """SELECT row_index, similarity, gene_encoding, c.cell_id AS assigned_cell_id FROM best b
      LEFT JOIN cells c ON c.cell_encoding = nullif(b.cell_encoding, -1)""",
)
def j_decode_cells(t):
    return decode_cells(keep_best_rows(_predictions(t)), _cells(t))


@query(
    "j_exactly_one",
    "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
)
def j_exactly_one(t):
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return M.join_exactly_one(t.orders.select("o_orderkey", "o_custkey"), customers, "o_custkey")


@query(
    "j_lookup_default",
    "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)",
)
def j_lookup_default(t):
    return N.lookup_with_default(t.documents.select("doc_id"), "doc_id", t.labels, "quality")


@query("j_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j_anti(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query(
    "j_reference_genes",
    with_(POINTS, COUNTS) + "SELECT * FROM counts WHERE feature_name IN (SELECT p_brand FROM part WHERE p_type = 'ECONOMY')",
)
def j_reference_genes(t):
    known = t.part.where("p_type = 'ECONOMY'").select(F.col("p_brand").alias("feature_name"), F.lit(1000).alias("n"))
    return M.check_reference_genes(M.count_matrix(t.points), known, "remove")


@query(
    "u_boundary_union",
    """SELECT CAST(c_custkey AS VARCHAR) AS cell_id, 'cell' AS boundary_type, c_custkey IN (SELECT o_custkey FROM orders
         WHERE o_orderstatus = 'P') AS contains_nucleus, c_custkey || '_1' AS "key" FROM customer
       UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'nucleus', TRUE, o_custkey || '_0' FROM orders WHERE o_orderstatus = 'P'""",
)
def u_boundary_union(t):
    ring = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))).alias("ring")
    cells = t.customer.select(F.col("c_custkey").alias("cell_id"), ring)
    nuclei = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("cell_id"), ring)
    return boundary_union(cells, nuclei).drop("ring")


# --- windows and sampling -------------------------------------------------------


@query(
    "w_ring_offsets",
    """WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS s
         FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
       g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e)
       SELECT user_id, event_type, min(event_id) AS "first", max(event_id) AS "last" FROM g GROUP BY user_id, run, event_type""",
)
def w_ring_offsets(t):
    return ring_offsets(t.events, ident="event_type", order="event_id", by=["user_id"])


@query(
    "w_group_transform",
    """SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS size,
       round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) + 0 AS total FROM orders""",
)
def w_group_transform(t):
    w = Window.partitionBy("o_custkey")
    return t.orders.select(
        "o_orderkey", F.count(F.lit(1)).over(w).alias("size"), r(F.sum("o_totalprice").over(w), 2).alias("total")
    )


@query(
    "w_positions",
    """SELECT event_type, count(*) AS n, CAST(min(pos) AS BIGINT) AS lowest, CAST(max(pos) AS BIGINT) AS highest,
       count(DISTINCT pos) AS different, CAST(max(n_all) AS BIGINT) AS of_all FROM
       (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos,
        count(*) OVER (PARTITION BY event_type) AS n_all FROM events) GROUP BY 1""",
)
def w_positions(t):
    placed = N.position_in_group(t.events.select("event_type", "event_id"), "event_type", "event_id", "pos", 100)
    return placed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("pos").alias("lowest"),
        F.max("pos").alias("highest"),
        F.countDistinct("pos").alias("different"),
        F.max("pos_of").alias("of_all"),
    )


# A draw of the sampling operators: 52 bits of md5(key:seed).
_DRAW = "CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':0'), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"


@query(
    "o_sample_per_group",
    with_(POINTS)
    + f"""SELECT row_index % 100000 AS l_suppkey, row_index FROM points
      QUALIFY row_number() OVER (PARTITION BY row_index % 100000 ORDER BY {_DRAW.format(key="row_index")}, row_index) <= 120""",
)
def o_sample_per_group(t):
    lines = t.points.select(F.pmod("row_index", F.lit(100000)).alias("l_suppkey"), "row_index")
    return S.sample_per_group(lines, "l_suppkey", "row_index", 120)


@query("o_split_tiles", f"SELECT c_custkey AS tile_id, {_DRAW.format(key='c_custkey')} < 0.75 AS is_train FROM customer")
def o_split_tiles(t):
    return S.split_tiles(t.customer.select(F.col("c_custkey").alias("tile_id")), 0.75)


# --- export ---------------------------------------------------------------------

_SEG = """seg AS (SELECT b.row_index, similarity, c.cell_id AS assigned_cell_id, gene_encoding / CAST(40 AS DOUBLE) AS similarity_threshold
  FROM best b LEFT JOIN cells c ON c.cell_encoding = nullif(b.cell_encoding, -1)),
j AS (SELECT p.row_index, p.x, p.y, p.feature_name, p.cell_compartment, p.qv, similarity, assigned_cell_id, similarity_threshold
  FROM points p LEFT JOIN seg USING (row_index) WHERE assigned_cell_id IS NOT NULL)"""


def _segmentation(t):
    decoded = decode_cells(keep_best_rows(_predictions(t)), _cells(t))
    return decoded.select(
        "row_index", "similarity", "assigned_cell_id", (F.col("gene_encoding") / 40.0).alias("similarity_threshold")
    )


@query(
    "e_load_assigned",
    with_(POINTS, _TRAIN, _PRED, _BEST, _SEG)
    + """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY assigned_cell_id) AS k FROM j
        WHERE similarity >= similarity_threshold) WHERE k >= 300""".replace("SELECT * FROM (", "SELECT * EXCLUDE (k) FROM (", 1),
)
def e_load_assigned(t):
    return load_assigned(_segmentation(t), t.points, min_transcripts=300)


@query(
    "e_load_fixed_similarity",
    with_(POINTS, _TRAIN, _PRED, _BEST, _SEG)
    + "SELECT assigned_cell_id, count(*) AS n FROM j WHERE similarity >= 0.75 GROUP BY 1 HAVING count(*) >= 10",
)
def e_load_fixed_similarity(t):
    kept = load_assigned(_segmentation(t), t.points, min_similarity=0.75)
    return kept.groupBy("assigned_cell_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e_matrix_cells",
    with_(POINTS, _TRAIN, _PRED, _BEST, _SEG)
    + """SELECT assigned_cell_id AS cell_id, count(*) AS n_transcripts, round(avg(x), 4) + 0 AS x, round(avg(y), 4) + 0 AS y,
      'cell_boundaries' AS region FROM j GROUP BY 1""",
)
def e_matrix_cells(t):
    _, cells, _ = build_matrix(load_assigned(_segmentation(t), t.points, include_all=True, min_transcripts=0))
    return cells.withColumn("x", r("x", 4)).withColumn("y", r("y", 4))


@query(
    "f_box_flags",
    with_(EVENTS)
    + """SELECT owner, count(*) FILTER (x BETWEEN 100 AND 500 AND y BETWEEN 100 AND 1000) AS centre, count(*) AS total
      FROM ev GROUP BY 1""",
)
def f_box_flags(t):
    inside = F.col("x").between(100, 500) & F.col("y").between(100, 1000)
    return t.event_points.groupBy("owner").agg(F.count_if(inside).alias("centre"), F.count(F.lit(1)).alias("total"))
