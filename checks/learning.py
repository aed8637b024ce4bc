"""Vectors, clusters, scores, thresholds, losses, the encoder and contamination."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import COUNTS, EVENTS, POINTS, TYPED_CELLS, VECTORS, query, r, with_
from gridloom.functions import vectors as V
from gridloom.operators import assignment as A
from gridloom.operators import clustering as C
from gridloom.operators import contamination as CT
from gridloom.operators import embedding as E
from gridloom.operators import encoder as EN
from gridloom.operators import losses as L
from gridloom.operators import matrix as M
from gridloom.operators.knn import knn_within
from gridloom.operators.neighbours import knn_vectors
from gridloom.operators.numbering import position_in_group
from gridloom.session import cut_lineage

# --- vectors and clusters -------------------------------------------------------

_PAIR = """pr AS (SELECT a.vec_id AS id, b.vec_id AS other, a.label, b.label AS other_label, a.embedding AS ea, b.embedding AS eb
  FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings)),
pe AS (SELECT id, other, label, other_label, CAST(unnest(ea) AS DOUBLE) AS x, CAST(unnest(eb) AS DOUBLE) AS y FROM pr)"""


def _pairs(t):
    v = t.vectors
    n = v.agg(F.count(F.lit(1))).scalar()
    left = v.select("id", F.col("embedding").alias("ea"), F.pmod(F.col("id") * 7 + 3, n).alias("other"))
    return left.join(v.select(F.col("id").alias("other"), F.col("embedding").alias("eb")), "other")


@query(
    "v_vector_functions",
    with_(_PAIR)
    + """SELECT id, other, round(sum(x * y), 6) + 0 AS dot, round(sqrt(sum(x * x)), 6) + 0 AS length,
      round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) + 0 AS cosine, round(sqrt(sum((x - y) * (x - y))), 6) + 0 AS distance
      FROM pe GROUP BY 1, 2""",
)
def v_vector_functions(t):
    a, b = F.col("ea"), F.col("eb")
    return _pairs(t).select(
        "id",
        "other",
        r(V.dot(a, b)).alias("dot"),
        r(V.norm(a)).alias("length"),
        r(V.cosine(a, b)).alias("cosine"),
        r(V.distance(a, b)).alias("distance"),
    )


@query(
    "v_l2_normalize",
    """WITH e AS (SELECT vec_id AS id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
       SELECT id, CAST(dim AS INT) AS dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 5) + 0 AS v FROM e""",
)
def v_l2_normalize(t):
    out = t.vectors.select("id", F.posexplode(V.l2_normalize(F.col("embedding"))).alias("dim", "v"))
    return out.withColumn("v", r("v", 5))


@query(
    "a_cluster_similarity",
    with_(VECTORS)
    + """, u AS (SELECT id, label, d, CAST(v AS DOUBLE) / sqrt(sum(CAST(v AS DOUBLE) * v) OVER (PARTITION BY id)) AS v FROM vec),
      m AS (SELECT label, d, avg(v) AS m FROM u GROUP BY 1, 2)
      SELECT a.label AS a, b.label AS b, round(sum(a.m * b.m), 6) + 0 AS sim FROM m a JOIN m b USING (d) GROUP BY 1, 2""",
)
def a_cluster_similarity(t):
    return C.cluster_similarity(t.vectors, cluster="label").withColumn("sim", r("sim"))


_NEAR = """dist AS (SELECT a.vec_id AS src, b.vec_id AS dst, sum((CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)) AS d2 FROM
  (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) a JOIN
  (SELECT vec_id, unnest(embedding) AS y, generate_subscripts(embedding, 1) AS d FROM embeddings) b ON a.d = b.d GROUP BY 1, 2),
near AS (SELECT * FROM (SELECT src, dst, d2, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM dist) WHERE rank <= 10)"""


@query("j_knn_vectors", with_(_NEAR) + "SELECT src, dst, round(sqrt(d2), 5) + 0 AS distance, CAST(rank AS INT) AS rank FROM near")
def j_knn_vectors(t):
    return knn_vectors(t.vectors, 10).withColumn("distance", r("distance", 5))


@query(
    "j_jaccard_edges",
    with_(_NEAR)
    + """, bi AS (SELECT src, dst FROM near UNION SELECT dst, src FROM near), deg AS (SELECT src, count(*) AS n FROM bi GROUP BY 1),
      common AS (SELECT p.src, p.dst, count(b.dst) AS c FROM near p JOIN bi a ON a.src = p.src LEFT JOIN bi b ON b.src = p.dst AND b.dst = a.dst GROUP BY 1, 2)
      SELECT c.src, c.dst, round(c / CAST(x.n + y.n - c AS DOUBLE), 6) + 0 AS weight FROM common c JOIN deg x ON x.src = c.src JOIN deg y ON y.src = c.dst""",
)
def j_jaccard_edges(t):
    return C.jaccard_edges(knn_vectors(t.vectors, 10)).withColumn("weight", r("weight"))


@query("m_cluster_vectors", "SELECT vec_id AS id, TRUE AS labelled FROM embeddings")
def m_cluster_vectors(t):
    """Every vector gets one label; labels run from -1 (small) up to the number of clusters."""
    found = C.cluster_vectors(t.vectors, 10, 1.0, min_size=5)
    sizes = found.where("cluster >= 0").groupBy("cluster").count().agg(F.max("cluster"), F.count(F.lit(1)), F.min("count")).first()
    top = -1 if sizes[0] is None else sizes[0]
    dense = top + 1 == sizes[1] and (sizes[2] or 6) > 5
    return found.select("id", (F.col("cluster").between(-1, top) & F.lit(dense)).alias("labelled"))


@query(
    "m_louvain_planted",
    """SELECT s_suppkey AS id, min(s_suppkey) OVER (PARTITION BY n_regionkey) AS community FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def m_louvain_planted(t):
    """Suppliers tied to others of their region, and weakly to the next supplier: communities are the regions."""
    nations = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region"))
    placed = position_in_group(t.supplier.select("s_suppkey", "s_nationkey").join(nations, "s_nationkey"), "region", "s_suppkey", "at")
    stepped = placed.withColumn("step", F.explode(F.array(*[F.lit(x) for x in (1, 2, 5, 9, 14, 20, 31, 47)])))
    ahead = stepped.select("region", F.col("s_suppkey").alias("src"), F.pmod(F.col("at") + F.col("step"), F.col("at_of")).alias("at"))
    strong = ahead.join(placed.select("region", "at", F.col("s_suppkey").alias("dst")), ["region", "at"]).where("src <> dst")
    count = t.supplier.agg(F.count(F.lit(1))).scalar()
    weak = t.supplier.select(F.col("s_suppkey").alias("src"), F.pmod(F.col("s_suppkey") + 1, count).alias("dst"))
    edges = strong.select("src", "dst", F.lit(1.0).alias("weight")).unionByName(weak.withColumn("weight", F.lit(0.05)))
    found = C.louvain(edges)
    return found.select("id", F.min("id").over(Window.partitionBy("community")).alias("community"))


@query(
    "w_relabel_by_size",
    """SELECT p_partkey AS id, CAST(CASE WHEN n <= 75 THEN -1 ELSE rk END AS INT) AS cluster FROM part JOIN
       (SELECT p_brand, n, row_number() OVER (ORDER BY n DESC, p_brand) - 1 AS rk FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)) USING (p_brand)""",
)
def w_relabel_by_size(t):
    return C.relabel_by_size(t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community")), 75)


# --- embeddings -----------------------------------------------------------------


def _norm(t):
    counts = M.count_matrix(t.points)
    cells = M.cell_totals(counts, 380)
    return M.depth_normalize(counts, cells), cells.where("filtered").agg(F.count(F.lit(1))).scalar()


def _energy(table, key):
    """Squared length of each embedding: free of the sign of the components."""
    return table.select(key, F.size("embedding").alias("size"), r(V.dot(F.col("embedding"), F.col("embedding")), 4).alias("energy"))


_G = """norm AS (SELECT cell_id, feature_name, n * med / tot AS v, tot >= 380 AS filtered FROM counts JOIN
  (SELECT cell_id, sum(n) AS tot FROM counts GROUP BY 1) USING (cell_id),
  (SELECT median(tot) AS med FROM (SELECT cell_id, sum(n) AS tot FROM counts GROUP BY 1 HAVING sum(n) >= 380))),
gn AS (SELECT DISTINCT feature_name FROM counts), cl AS (SELECT DISTINCT cell_id, filtered FROM norm),
full_m AS (SELECT cl.cell_id, cl.filtered, gn.feature_name, coalesce(v, 0) AS v FROM gn CROSS JOIN cl LEFT JOIN norm USING (cell_id, feature_name))"""


@query(
    "m_gene_embedding",
    with_(POINTS, COUNTS, _G)
    + """, rr AS (SELECT a.feature_name AS a, b.feature_name AS b, coalesce(corr(a.v, b.v), 0) AS r FROM full_m a JOIN full_m b USING (cell_id)
        WHERE a.filtered GROUP BY 1, 2), mu AS (SELECT b, avg(r) AS m FROM rr GROUP BY 1)
      SELECT a AS feature_name, CAST((SELECT count(*) FROM gn) AS INT) AS size, round(sum((r - m) * (r - m)), 4) + 0 AS energy FROM rr JOIN mu USING (b) GROUP BY 1""",
)
def m_gene_embedding(t):
    """With all components kept, a score vector is as long as its centred correlation row."""
    norm, n = _norm(t)
    return _energy(E.gene_embedding(norm.where("filtered"), n, 128), "feature_name")


@query(
    "m_cell_embedding",
    with_(POINTS, COUNTS, _G)
    + """, mu AS (SELECT feature_name, avg(v) AS m FROM full_m WHERE filtered GROUP BY 1)
      SELECT cell_id, CAST((SELECT count(*) FROM gn) AS INT) AS size, round(sum((v - m) * (v - m)), 4) + 0 AS energy FROM full_m JOIN mu USING (feature_name) GROUP BY 1""",
)
def m_cell_embedding(t):
    norm, n = _norm(t)
    return _energy(E.cell_embedding(norm, n, 128), "cell_id")


# --- scores and thresholds ------------------------------------------------------

_SCORED = """cand AS (SELECT DISTINCT l_partkey % (SELECT count(*) FROM embeddings) AS src, (l_suppkey * 3) % (SELECT count(*) FROM embeddings) AS dst FROM lineitem),
emb AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
len AS (SELECT vec_id, sqrt(sum(CAST(v AS DOUBLE) * v)) AS n FROM emb GROUP BY 1),
gram AS (SELECT a.vec_id AS src, b.vec_id AS dst, sum(CAST(a.v AS DOUBLE) * b.v) AS p FROM emb a JOIN emb b USING (d) GROUP BY 1, 2),
sc AS (SELECT src, dst, round(p / (x.n * y.n), 6) + 0 AS similarity FROM cand JOIN gram USING (src, dst) JOIN len x ON x.vec_id = src JOIN len y ON y.vec_id = dst)"""


def _scored(t):
    n = t.vectors.agg(F.count(F.lit(1))).scalar()
    edges = t.lineitem.select(
        F.pmod("l_partkey", n).alias("src"), F.pmod(F.col("l_suppkey") * 3, n).alias("dst")
    ).distinct()
    ends = t.vectors.select("id", "embedding")
    return A.score_edges(edges, ends, ends).withColumn("similarity", r("similarity"))


@query("m_score_edges", with_(_SCORED) + "SELECT * FROM sc")
def m_score_edges(t):
    return _scored(t)


@query(
    "m_predict",
    with_(_SCORED)
    + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS k FROM sc) WHERE k = 1)
      SELECT vec_id AS row_index, CAST(CASE WHEN similarity >= 0.2 THEN dst ELSE -1 END AS BIGINT) AS cell_encoding, coalesce(similarity, 0) AS similarity, CAST(label AS BIGINT) AS gene_encoding
      FROM embeddings LEFT JOIN best ON src = vec_id WHERE vec_id % 3 <> 0""",
)
def m_predict(t):
    nodes = t.vectors.select(
        F.col("id").alias("row_index"), F.col("label").alias("gene_encoding"), (F.pmod("id", F.lit(3)) != 0).alias("is_core")
    )
    return A.predict(nodes, _scored(t), 0.2)


_SIM = "sim AS (SELECT row_index, feature_name, qv / 50 * (x / 1100) AS s FROM points WHERE cell_id IS NOT NULL)"


def _similarities(t):
    return t.points.where(F.col("cell_id").isNotNull()).select(
        "row_index", "feature_name", (F.col("qv") / 50 * (F.col("x") / 1100)).alias("similarity")
    )


_YEN = """rg AS (SELECT feature_name, min(s) AS lo, max(s) AS hi FROM sim GROUP BY 1),
bn AS (SELECT feature_name, lo, hi, least(CAST(floor((s - lo) / (hi - lo) * 256) AS INT), 255) AS b, CAST(count(*) AS DOUBLE) AS c FROM sim JOIN rg USING (feature_name) GROUP BY ALL),
cm AS (SELECT *, sum(c) OVER w AS p, sum(c * c) OVER w AS q, sum(c) OVER (PARTITION BY feature_name) AS n, sum(c * c) OVER (PARTITION BY feature_name) AS q_all
  FROM bn WINDOW w AS (PARTITION BY feature_name ORDER BY b)),
cr AS (SELECT *, round(ln(((p * (n - p)) * (p * (n - p))) / (q * (q_all - q))), 9) AS crit FROM cm WHERE p < n),
yen AS (SELECT feature_name, lo + (arg_max(b, (crit, -b)) + CAST(0.5 AS DOUBLE)) * (hi - lo) / 256 AS yen FROM cr GROUP BY feature_name, lo, hi)"""


@query("m_yen_thresholds", with_(POINTS, _SIM, _YEN) + "SELECT feature_name, round(yen, 6) + 0 AS yen FROM yen")
def m_yen_thresholds(t):
    return A.yen_thresholds(_similarities(t), gene="feature_name").withColumn("yen", r("yen"))


# The iteration unrolled by recursion; 60 steps are far more than it needs here.
_LI = """lo AS (SELECT feature_name, min(s) AS lo, avg(s) - min(s) AS t0 FROM sim GROUP BY 1),
vv AS (SELECT feature_name, s - lo AS v FROM sim JOIN lo USING (feature_name))"""
_LI_STEPS = """li(feature_name, k, t) AS (SELECT feature_name, 0, t0 FROM lo UNION ALL
  SELECT l.feature_name, l.k + 1, (SELECT (avg(v) FILTER (v <= l.t) - avg(v) FILTER (v > l.t)) / (ln(avg(v) FILTER (v <= l.t)) - ln(avg(v) FILTER (v > l.t)))
    FROM vv WHERE vv.feature_name = l.feature_name) FROM li l WHERE l.k < 60)"""


@query(
    "m_li_thresholds",
    "WITH RECURSIVE " + ",\n".join([POINTS, _SIM, _LI, _LI_STEPS])
    + "\nSELECT feature_name, round(t + lo, 5) + 0 AS li, TRUE AS converged FROM li JOIN lo USING (feature_name) WHERE k = 60",
)
def m_li_thresholds(t):
    return A.li_thresholds(_similarities(t), gene="feature_name").withColumn("li", r("li", 5))


@query(
    "m_gene_thresholds",
    "WITH RECURSIVE " + ",\n".join([POINTS, _SIM, _YEN, _LI, _LI_STEPS])
    + """\nSELECT feature_name, round(least(yen, t + lo), 5) + 0 AS similarity_threshold, TRUE AS converged
      FROM li JOIN lo USING (feature_name) JOIN yen USING (feature_name) WHERE k = 60""",
)
def m_gene_thresholds(t):
    out = A.gene_thresholds(_similarities(t), gene="feature_name")
    return out.withColumn("similarity_threshold", r("similarity_threshold", 5))


_KEPT = """kept AS (SELECT * FROM (SELECT *, qv / 50 * (x / 1100) AS similarity, row_number() OVER
  (PARTITION BY row_index ORDER BY qv / 50 * (x / 1100) DESC, coalesce(CAST(cell_id AS BIGINT), -1)) AS k FROM points) WHERE k = 1),
sim AS (SELECT row_index, feature_name, similarity AS s FROM kept WHERE cell_id IS NOT NULL)"""


@query(
    "m_assign",
    "WITH RECURSIVE " + ",\n".join([POINTS, _KEPT, _YEN, _LI, _LI_STEPS])
    + """, th AS (SELECT feature_name, round(least(yen, t + lo), 5) + 0 AS similarity_threshold
      FROM li JOIN lo USING (feature_name) JOIN yen USING (feature_name) WHERE k = 60)
      SELECT row_index, similarity, cell_id AS assigned_cell_id, similarity_threshold, CASE WHEN similarity_threshold IS NOT NULL THEN TRUE END AS converged
      FROM kept LEFT JOIN th USING (feature_name)""",
)
def m_assign(t):
    cells = t.supplier.select(F.col("s_suppkey").cast("string").alias("cell_id"), F.col("s_suppkey").alias("cell_encoding"))
    predictions = t.points.select(
        "row_index",
        F.coalesce(F.col("cell_id").cast("long"), F.lit(-1)).alias("cell_encoding"),
        (F.col("qv") / 50 * (F.col("x") / 1100)).alias("similarity"),
        F.substring("feature_name", 7, 5).cast("long").alias("gene_encoding"),
    )
    return A.assign(predictions, cells).withColumn("similarity_threshold", r("similarity_threshold", 5))


# --- losses ---------------------------------------------------------------------

_SIMTAB = """simtab AS (SELECT a, b, round(sin(a * 7 + b * 3 + a * b), 6) AS sim FROM (SELECT DISTINCT label AS a FROM embeddings), (SELECT DISTINCT label AS b FROM embeddings))"""


def _simtab(t):
    labels = t.vectors.select("label").distinct()
    a, b = F.col("a"), F.col("b")
    every = labels.agg(F.collect_set("label")).scalar()  # ten labels
    grid = labels.select(F.col("label").alias("a")).withColumn("b", F.explode(every))
    return grid.select("a", "b", F.round(F.sin(a * 7 + b * 3 + a * b), 6).alias("sim"))


@query(
    "w_cluster_cdf",
    with_(_SIMTAB)
    + """, w AS (SELECT a, b, greatest(CASE WHEN a = b THEN 1 ELSE sim END, 1e-8) AS w FROM simtab)
      SELECT a, b, CASE WHEN b = max(b) OVER (PARTITION BY a) THEN 1 ELSE round(sum(w) OVER (PARTITION BY a ORDER BY b) / sum(w) OVER (PARTITION BY a), 6) END AS upper FROM w""",
)
def w_cluster_cdf(t):
    return L.cluster_cdf(_simtab(t), t.vectors.select("label").distinct()).withColumn("upper", r("upper"))


# Draws of the sampling operators: 52 bits of md5(keys:seed).
def _draw(*keys, seed):
    joined = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST('0x' || substr(md5({joined} || ':{seed}'), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


def _drawn(kind, weight, offset):
    """CTEs: the cluster and the member that each vector draws."""
    return f"""{kind}_w AS (SELECT a, b, greatest({weight}, 1e-8) AS w FROM simtab),
{kind}_c AS (SELECT a, b, CASE WHEN b = max(b) OVER (PARTITION BY a) THEN 1 ELSE sum(w) OVER (PARTITION BY a ORDER BY b) / sum(w) OVER (PARTITION BY a) END AS upper FROM {kind}_w),
{kind}_l AS (SELECT vec_id, min(b) AS drawn FROM embeddings JOIN {kind}_c ON a = label AND upper >= {_draw("vec_id", seed=offset)} GROUP BY 1),
{kind} AS (SELECT l.vec_id, drawn, m.vec_id AS member FROM {kind}_l l JOIN sizes s ON s.label = drawn
  JOIN placed m ON m.label = drawn AND m.pos = CAST(floor({_draw("l.vec_id", seed=offset + 4)} * s.n) AS BIGINT))"""


_OWN = "CASE WHEN a = b THEN 1 ELSE sim END"


@query(
    "m_sample_triplets",
    with_(
        _SIMTAB,
        "placed AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings), "
        "sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)",
        _drawn("p", _OWN, 0),
        _drawn("q", f"-({_OWN})", 1),
    )
    + """SELECT vec_id AS id, label, p.member AS positive, p.drawn AS positive_label, q.member AS negative, q.drawn AS negative_label
      FROM embeddings JOIN p USING (vec_id) JOIN q USING (vec_id)""",
)
def m_sample_triplets(t):
    """The triplets themselves: clusters and members drawn by md5."""
    return L.sample_triplets(t.vectors, _simtab(t))


@query(
    "m_stratified_anchors",
    with_(
        f"""k AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_draw("vec_id", seed=0)}) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
g AS (SELECT greatest(CAST(round(count(*) / CAST(count(DISTINCT label) AS DOUBLE)) AS BIGINT), 1) AS goal FROM embeddings)"""
    )
    + "SELECT vec_id AS id, label, unnest(range((goal - pos - 1) // n + 1)) AS copy FROM k, g WHERE pos < goal",
)
def m_stratified_anchors(t):
    return L.stratified_anchors(t.vectors)


_TRI = """tri AS (SELECT a.vec_id AS id, a.label, p.label AS pl, n.label AS nl, a.embedding AS ea, p.embedding AS ep, n.embedding AS en FROM embeddings a
  JOIN embeddings p ON p.vec_id = (a.vec_id + 10) % (SELECT count(*) FROM embeddings) JOIN embeddings n ON n.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings)),
te AS (SELECT id, label, pl, nl, CAST(unnest(ea) AS DOUBLE) AS a, CAST(unnest(ep) AS DOUBLE) AS p, CAST(unnest(en) AS DOUBLE) AS n FROM tri)"""


def _triplets(t):
    v = t.vectors
    count = v.agg(F.count(F.lit(1))).scalar()
    drawn = v.select(
        "id", "label", F.pmod(F.col("id") + 10, count).alias("positive"), F.pmod(F.col("id") * 7 + 3, count).alias("negative")
    )
    p = v.select(F.col("id").alias("positive"), F.col("label").alias("positive_label"))
    n = v.select(F.col("id").alias("negative"), F.col("label").alias("negative_label"))
    return drawn.join(p, "positive").join(n, "negative")


@query(
    "m_triplet_loss",
    with_(_TRI)
    + """SELECT round(avg(greatest(g, 0)), 6) + 0 AS loss FROM (SELECT sqrt(sum((a - p) * (a - p))) - sqrt(sum((a - n) * (a - n))) + 0.3 AS g FROM te GROUP BY id)""",
)
def m_triplet_loss(t):
    return L.triplet_loss(_triplets(t), t.vectors, 0.3).withColumn("loss", r("loss"))


@query(
    "m_metric_loss",
    with_(_TRI, _SIMTAB)
    + """, c AS (SELECT id, label, pl, nl, sum(a * p) / (sqrt(sum(a * a)) * sqrt(sum(p * p))) AS cp, sum(a * n) / (sqrt(sum(a * a)) * sqrt(sum(n * n))) AS cn FROM te GROUP BY ALL),
      s AS (SELECT a, b, CASE WHEN a = b THEN 1 ELSE sim END AS sim FROM simtab)
      SELECT round(avg((cp - x.sim) ** 2) + avg((cn - y.sim) ** 2), 6) + 0 AS loss FROM c JOIN s x ON x.a = label AND x.b = pl JOIN s y ON y.a = label AND y.b = nl""",
)
def m_metric_loss(t):
    return L.metric_loss(_triplets(t), t.vectors, _simtab(t)).withColumn("loss", r("loss"))


def _belongs(t):
    """Parts as points, suppliers as cells: every vector is a point and a cell."""
    n = t.vectors.agg(F.count(F.lit(1))).scalar()
    edges = t.lineitem.select(F.pmod("l_partkey", n).alias("src"), F.pmod("l_suppkey", n).alias("dst")).distinct()
    nodes = t.vectors.select("id", "embedding")
    return edges, nodes, nodes, t.vectors.count()


_SEGMENT = f"""c AS (SELECT count(*) AS n FROM embeddings), e AS (SELECT DISTINCT l_partkey % n AS src, l_suppkey % n AS dst, n FROM lineitem, c),
f AS (SELECT src, dst, (dst + CAST(floor({_draw("src", "dst", seed=0)} * (n - 1)) AS BIGINT) + 1) % n AS far FROM e),
t AS (SELECT src, dst, a.embedding AS ea, p.embedding AS ep, q.embedding AS eq FROM f JOIN embeddings a ON a.vec_id = src
  JOIN embeddings p ON p.vec_id = dst JOIN embeddings q ON q.vec_id = far),
u AS (SELECT src, dst, CAST(unnest(ea) AS DOUBLE) AS a, CAST(unnest(ep) AS DOUBLE) AS p, CAST(unnest(eq) AS DOUBLE) AS q FROM t),
m AS (SELECT sqrt(sum((a - p) ** 2)) AS dp, sqrt(sum((a - q) ** 2)) AS dq, sum(a * p) AS sp, sum(a * q) AS sq FROM u GROUP BY src, dst)"""


@query("m_segmentation_loss_triplet", with_(_SEGMENT) + "SELECT round(avg(greatest(dp - dq + 0.4, 0)), 6) + 0 AS loss FROM m")
def m_segmentation_loss_triplet(t):
    edges, src, dst, n = _belongs(t)
    return L.segmentation_loss(edges, src, dst, n, "triplet").withColumn("loss", r("loss"))


@query(
    "m_segmentation_loss_bce",
    with_(_SEGMENT)
    + """SELECT round(avg((greatest(-sp, 0) + ln(1 + exp(-abs(sp))) + greatest(sq, 0) + ln(1 + exp(-abs(sq)))) / 2), 6) + 0 AS loss FROM m""",
)
def m_segmentation_loss_bce(t):
    edges, src, dst, n = _belongs(t)
    return L.segmentation_loss(edges, src, dst, n, "bce").withColumn("loss", r("loss"))


# --- encoder --------------------------------------------------------------------


@query(
    "m_position_codes",
    with_(EVENTS)
    + """, b AS (SELECT owner, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ev GROUP BY 1),
      s AS (SELECT row_index, 'px' AS axis, (x - x0) / (x1 - x0 + 1e-8) AS v FROM ev JOIN b USING (owner) UNION ALL
        SELECT row_index, 'py', (y - y0) / (y1 - y0 + 1e-8) FROM ev JOIN b USING (owner))
      SELECT row_index, axis, CAST(i AS INT) AS dim, round(CASE WHEN i < 4 THEN cos(v * exp(0 - ln(10000.0::DOUBLE) * i / 4)) ELSE sin(v * exp(0 - ln(10000.0::DOUBLE) * (i - 4) / 4)) END, 6) + 0 AS code
      FROM s, range(8) a(i)""",
)
def m_position_codes(t):
    coded = EN.position_codes(t.event_points.withColumnRenamed("owner", "tile_id"), size=8)
    axes = [coded.select("row_index", F.lit(axis).alias("axis"), F.posexplode(axis).alias("dim", "code")) for axis in ("px", "py")]
    return axes[0].unionByName(axes[1]).withColumn("code", r("code"))


def _encoder_tables(t):
    ev = t.event_points
    kinds = F.dense_rank().over(Window.orderBy("feature_name")) - 1
    genes = ev.select("feature_name").distinct().withColumn("gene_encoding", kinds)
    tx = ev.join(genes, "feature_name").select(F.lit(0).alias("tile_id"), F.col("row_index").alias("id"), "x", "y", "gene_encoding", "owner")
    size = ev.groupBy(F.col("owner").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
    bd = size.select(F.lit(0).alias("tile_id"), "id", "x", "y", F.array(F.log1p("n"), F.lit(1.0)).alias("features"))
    near = knn_within(ev, 3, 5.0).select(F.lit(0).alias("tile_id"), F.lit("tx-tx").alias("edge_type"), "src", "dst")
    belongs = tx.select("tile_id", F.lit("tx-belongs-bd").alias("edge_type"), F.col("id").alias("src"), F.col("owner").alias("dst"))
    return tx, bd, near.unionByName(belongs)


@query("m_encoder", with_(EVENTS) + "SELECT owner AS id, CAST(8 AS INT) AS size, CAST(1 AS DOUBLE) AS length FROM ev GROUP BY 1")
def m_encoder(t):
    """Cell embeddings of the whole event graph: one unit vector per owner."""
    weights = EN.initial_weights(
        5, 2, in_channels=8, hidden_channels=4, out_channels=8, n_mid_layers=0, n_heads=2, frequency_size=16
    )
    out = EN.encode(*_encoder_tables(t), weights, materialise=cut_lineage)
    return out["bd"].select("id", F.size("embedding").alias("size"), r(V.norm(F.col("embedding"))).alias("length"))


@query(
    "m_attention_weights",
    with_(EVENTS) + "SELECT owner AS dst, CAST(h AS INT) AS head, CAST(1 AS DOUBLE) AS total, count(*) AS n FROM ev, range(2) a(h) GROUP BY 1, 2",
)
def m_attention_weights(t):
    """Soft-max weights of the point-cell layer sum to 1 per cell and head."""
    tx, bd, edges = _encoder_tables(t)
    w = EN.initial_weights(5, 2, in_channels=8, hidden_channels=4, n_mid_layers=0, use_positions=False)
    layer = w.layers[0]["tx-belongs-bd"]
    src = tx.select("tile_id", "id", F.array(*[F.sin(F.col("x") * (i + 1) / 100) for i in range(8)]).alias("h"))
    dst = bd.select("tile_id", "id", F.array(*[F.cos(F.col("y") * (i + 1) / 100) for i in range(8)]).alias("h"))
    belongs = edges.where("edge_type = 'tx-belongs-bd'").select("tile_id", "src", "dst")
    weights = EN.attention_weights(EN.attention_edges(belongs, src, dst, layer, 2))
    return weights.groupBy("dst", "head").agg(r(F.sum("weight")).alias("total"), F.count(F.lit(1)).alias("n"))


# --- contamination --------------------------------------------------------------

_SUMMARY = """lib AS (SELECT cell_id, sum(n) AS tot FROM counts GROUP BY 1),
val AS (SELECT cell_type, feature_name, ln(1 + CAST(10000 AS DOUBLE) * n / tot) AS v FROM counts JOIN lib USING (cell_id) JOIN typed_cells USING (cell_id)
  WHERE n >= {m}),
sizes AS (SELECT cell_type, count(*) AS cells FROM typed_cells GROUP BY 1),
summary AS (SELECT cell_type AS cell_type_name, feature_name AS gene_name, count(*) AS n, avg(v) AS me, cells AS n_cells_cell_type,
  count(*) / CAST(cells AS DOUBLE) AS pc FROM val JOIN sizes USING (cell_type) GROUP BY cell_type, feature_name, cells)"""


def _reference(t, min_counts=18):
    cells = t.typed_cells
    return CT.expression_summary(M.count_matrix(t.points), cells, min_counts)


@query(
    "v_expression_summary",
    with_(POINTS, COUNTS, TYPED_CELLS, _SUMMARY.format(m=18))
    + "SELECT cell_type_name, gene_name, n, round(me, 6) + 0 AS me, n_cells_cell_type, round(pc, 6) + 0 AS pc FROM summary",
)
def v_expression_summary(t):
    return _reference(t).withColumn("me", r("me")).withColumn("pc", r("pc"))


@query(
    "v_group_reference",
    with_(POINTS, COUNTS, TYPED_CELLS, _SUMMARY.format(m=18))
    + """, cs AS (SELECT *, CASE WHEN cell_type_name IN ('T0', 'T1') THEN 'low' ELSE cell_type_name END AS k FROM summary),
      cn AS (SELECT k, sum(c) AS cells FROM (SELECT DISTINCT k, cell_type_name, n_cells_cell_type AS c FROM cs) GROUP BY 1)
      SELECT k AS cell_type_name, gene_name, CAST(sum(n) AS BIGINT) AS n, round(sum(me * n) / sum(n), 6) + 0 AS me, CAST(cells AS BIGINT) AS n_cells_cell_type,
        round(sum(n) / CAST(cells AS DOUBLE), 6) + 0 AS pc FROM cs JOIN cn USING (k) GROUP BY k, gene_name, cells""",
)
def v_group_reference(t):
    merged = CT.group_reference(_reference(t), {"T0": "low", "T1": "low"})
    return merged.withColumn("me", r("me")).withColumn("pc", r("pc"))


_FREQ = """nb AS (SELECT * FROM (SELECT a.cell_id, b.cell_type AS t, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d,
  row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.cell_id) AS k FROM typed_cells a, typed_cells b)
  WHERE k <= 10 AND d <= 900),
freq AS (SELECT cell_id, t AS neighbour_type, count(*) / CAST(sum(count(*)) OVER (PARTITION BY cell_id) AS DOUBLE) AS freq FROM nb GROUP BY 1, 2)"""


@query(
    "v_neighbour_frequencies",
    with_(POINTS, TYPED_CELLS, _FREQ) + "SELECT cell_id, neighbour_type, round(freq, 6) + 0 AS freq FROM freq",
)
def v_neighbour_frequencies(t):
    return CT.neighbour_frequencies(t.typed_cells, 10, 30.0).withColumn("freq", r("freq"))


# The reference leaves out one gene, so that a gene unknown to it occurs.
_SCORES = """rf AS (SELECT cell_type_name AS t, gene_name AS g, pc * me AS w FROM summary WHERE gene_name <> 'Brand#7' AND cell_type_name <> 'T4'),
rt AS (SELECT DISTINCT t FROM rf), rg AS (SELECT DISTINCT g FROM rf),
grid AS (SELECT rt.t, rg.g, coalesce(w, 0) + 1e-6 AS l FROM rt CROSS JOIN rg LEFT JOIN rf USING (t, g)),
sh AS (SELECT cell_type AS t, count(*) / CAST((SELECT count(*) FROM typed_cells) AS DOUBLE) AS a FROM typed_cells GROUP BY 1),
base AS (SELECT c.cell_id, tc.cell_type, c.feature_name, c.n FROM counts c JOIN typed_cells tc USING (cell_id)),
pb AS (SELECT g, sum(a * l) + 1e-6 AS pb FROM grid JOIN sh USING (t) GROUP BY 1),
pn AS (SELECT b.cell_id, b.feature_name, sum(f.freq * l) AS pn FROM base b JOIN freq f ON f.cell_id = b.cell_id AND f.neighbour_type <> b.cell_type
  JOIN grid ON grid.t = f.neighbour_type AND grid.g = b.feature_name GROUP BY 1, 2),
q AS (SELECT b.*, rg.g IS NOT NULL AS known, 0.8::DOUBLE * coalesce(l, 1e-6) AS qa, 0.15::DOUBLE * (coalesce(pn, 0) + 1e-6) AS qb, 0.05::DOUBLE * pb AS qc FROM base b
  LEFT JOIN rg ON rg.g = b.feature_name LEFT JOIN grid ON grid.t = b.cell_type AND grid.g = b.feature_name
  LEFT JOIN pn ON pn.cell_id = b.cell_id AND pn.feature_name = b.feature_name LEFT JOIN pb ON pb.g = b.feature_name),
scores AS (SELECT cell_id, cell_type, feature_name, n, CASE WHEN known THEN qa / (qa + qb + qc) ELSE 0 END AS q_self,
  CASE WHEN known THEN qb / (qa + qb + qc) ELSE 0 END AS q_neighbor, CASE WHEN known THEN qc / (qa + qb + qc) ELSE 0 END AS q_background,
  known AND qa / (qa + qb + qc) < 0.84 AS contaminated FROM q)"""

_CONT = (POINTS, COUNTS, TYPED_CELLS, _SUMMARY.format(m=18), _FREQ, _SCORES)


def _contamination(t):
    """Counts, cells and reference as the written tables they are in use."""
    counts, cells = cut_lineage(M.count_matrix(t.points)), cut_lineage(t.typed_cells)
    reference = CT.expression_summary(counts, cells, 18)
    reference = cut_lineage(reference.where("gene_name <> 'Brand#7' AND cell_type_name <> 'T4'"))
    return CT.contamination_scores(counts, cells, reference, max_neighbor_distance=30.0, cutoff=0.84), reference


@query(
    "v_contamination_scores",
    with_(*_CONT)
    + """SELECT cell_id, cell_type, feature_name, n, round(q_self, 5) + 0 AS q_self, round(q_neighbor, 5) + 0 AS q_neighbor,
      round(q_background, 5) + 0 AS q_background, contaminated FROM scores""",
)
def v_contamination_scores(t):
    scores, _ = _contamination(t)
    for c in ("q_self", "q_neighbor", "q_background"):
        scores = scores.withColumn(c, r(c, 5))
    return scores


@query(
    "v_percent_contamination",
    with_(*_CONT)
    + """SELECT cell_id, round(100 * coalesce(sum(n) FILTER (contaminated), 0) / CAST(sum(n) AS DOUBLE), 6) + 0 AS percent_contamination FROM scores GROUP BY 1""",
)
def v_percent_contamination(t):
    return CT.percent_contamination(_contamination(t)[0]).withColumn("percent_contamination", r("percent_contamination"))


@query(
    "v_contamination_flow",
    with_(*_CONT)
    + """, sp AS (SELECT t, g, w / sum(w) OVER (PARTITION BY g) AS w FROM rf), lb AS (SELECT cell_id, sum(n) AS l FROM scores GROUP BY 1),
      fl AS (SELECT sp.t AS source, s.cell_type AS host, sum(100 * n * w / l) AS total FROM scores s JOIN lb USING (cell_id) JOIN sp ON sp.g = s.feature_name WHERE contaminated GROUP BY 1, 2)
      SELECT rt.t AS source, z.cell_type AS host, round(coalesce(total, 0) / z.cells, 6) + 0 AS percent FROM rt CROSS JOIN sizes z LEFT JOIN fl ON fl.source = rt.t AND fl.host = z.cell_type""",
)
def v_contamination_flow(t):
    scores, reference = _contamination(t)
    return CT.contamination_flow(scores, t.typed_cells, reference).withColumn("percent", r("percent"))
