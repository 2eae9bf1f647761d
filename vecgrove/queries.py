"""Registered queries over the driver's tables, each with the SQL that must give the same rows.

``ann_*`` queries run the whole pipeline of an index (trees, leaves, codes, candidate pool, reranking); brute
force is in their SQL alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecgrove.config import Field, IndexConfig, SearchOptions
from vecgrove.functions.predicate import And, Compare, In, IsNotNull, IsNull, Not, Or, Predicate, classify, to_column, truths, validate
from vecgrove.functions.rabitq import encode
from vecgrove.index import Index, Runtime
from vecgrove.operators import build, maintain, mutate, recall, refine, scan, search, verify
from vecgrove.plans import treekeys
from vecgrove.sources.scratch import folder
from vecgrove.streaming.ingest import latest

Query = Callable[[SparkSession, str], DataFrame]

FIELDS = (Field("label", "i64"), Field("half", "bool"), Field("lang", "string", True, 256), Field("n_chars", "i64", True), Field("quality", "i64", True), Field("score", "f64", True))


def config_of(metric: str = "l2", key: tuple[str, ...] = ("label",)) -> IndexConfig:
    return IndexConfig(64, metric, FIELDS, key, leaf_min=8, leaf_max=32, internal_min=2, internal_max=16)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record fixture: scaled vectors, so that the metrics differ, with fields of every type."""
    e, d, labels = (table(spark, sf_dir, t) for t in ("embeddings", "documents", "labels"))
    rows = e.join(d.select(F.col("doc_id").alias("vec_id"), "lang", "n_chars"), "vec_id", "left").join(labels.select(F.col("doc_id").alias("vec_id"), "quality"), "vec_id", "left")
    scale = (1 + F.col("vec_id") % 5).cast("float")
    return rows.select(
        F.col("vec_id").alias("id"),
        F.transform("embedding", lambda x: (x * scale).cast("float")).alias("vector"),
        F.col("label").cast("long").alias("label"),
        (F.col("vec_id") % 2 == 0).alias("half"),
        "lang",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.col("quality").cast("long").alias("quality"),
        F.when(F.col("vec_id") % 7 == 3, F.lit(None).cast("double")).otherwise(F.col("vec_id") + F.lit(0.5)).cast("double").alias("score"),
    )


R = """r AS (
  SELECT e.vec_id AS id, list_transform(e.embedding, lambda x: (x * (1 + e.vec_id % 5)::float)::float) AS v, e.label::bigint AS label,
         e.vec_id % 2 = 0 AS half, d.lang, d.n_chars::bigint AS n_chars, l.quality::bigint AS quality,
         CASE WHEN e.vec_id % 7 = 3 THEN NULL ELSE e.vec_id + 0.5::double END::double AS score
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = e.vec_id)"""


def sql_dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double))"


def sql_l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))"


def sql_rank(metric: str, a: str, b: str) -> str:
    if metric == "l2":
        return sql_l2(a, b)
    if metric == "inner_product":
        return f"-({sql_dot(a, b)})"
    return f"1.0::double - {sql_dot(a, b)} / (sqrt({sql_dot(a, a)}) * sqrt({sql_dot(b, b)}))"


def sql_knn(metric: str, k: int, where: str = "TRUE", queries: str = "id % 100 = 0", relation: str = R) -> str:
    shown = "sqrt(rank)" if metric == "l2" else "rank"
    return f"""WITH {relation}, q AS (SELECT id AS qid, v AS qv FROM r WHERE {queries}),
      d AS (SELECT qid, id, {sql_rank(metric, 'qv', 'v')} AS rank FROM q, r WHERE {where}),
      t AS (SELECT qid, id, rank, row_number() OVER (PARTITION BY qid ORDER BY rank, id) AS position FROM d)
      SELECT qid, id, {shown} AS distance, position FROM t WHERE position <= {k}"""


def stated(rows: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    return rows.filter("id % 100 = 0").select(F.col("id").alias("qid"), "vector")


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# Exact nearest neighbours, alone and under predicates.

for _metric in ("l2", "cosine", "inner_product"):
    _short = {"inner_product": "ip"}.get(_metric, _metric)

    @add(f"knn_batch_{_short}", sql_knn(_metric, 10))
    def _(spark, d, metric=_metric):
        r = records(spark, d)
        return search.exact_knn(r, stated(r), metric, 10)


@add("knn_ties_by_id", sql_knn("l2", 20, relation="r AS (SELECT vec_id AS id, list_transform(embedding, lambda x: (x > 0)::float) AS v FROM embeddings)"))
def _(spark, d):
    """Of vectors of zeros and ones, among which ties abound."""
    r = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: (x > 0).cast("float")).alias("vector"))
    return search.exact_knn(r, stated(r), "l2", 20)


PREDICATES: dict[str, tuple[Predicate, str]] = {
    "eq": (Compare("label", "eq", 3), "label = 3"),
    "ne": (Compare("quality", "ne", 1), "quality <> 1"),
    "lt": (Compare("score", "lt", 100.5), "score < 100.5"),
    "le": (Compare("score", "le", 100.5), "score <= 100.5"),
    "gt": (Compare("n_chars", "gt", 2000), "n_chars > 2000"),
    "ge": (Compare("n_chars", "ge", 2000), "n_chars >= 2000"),
    "in": (In("lang", ("de", "fr")), "lang IN ('de', 'fr')"),
    "in_empty": (In("quality", ()), "FALSE"),
    "not_in": (Not(In("quality", (0,))), "NOT (quality IN (0))"),
    "not_in_empty": (Not(In("quality", ())), "TRUE"),
    "is_null": (IsNull("score"), "score IS NULL"),
    "is_not_null": (IsNotNull("quality"), "quality IS NOT NULL"),
    "and_or_not_nested": (
        And((Or((Compare("lang", "eq", "en"), Compare("quality", "ge", 1))), Not(And((Compare("label", "le", 4), Compare("score", "gt", 50.0)))))),
        "(lang = 'en' OR quality >= 1) AND NOT (label <= 4 AND score > 50.0)",
    ),
    "and_empty": (And(()), "TRUE"),
    "or_empty": (Or(()), "FALSE"),
    "bool_order": (Compare("half", "gt", False), "half > FALSE"),
    "string_bytes": (Compare("lang", "ge", "eo"), "lang >= 'eo'"),
}
PREDICATES["neg_zero"] = (Compare("score", "gt", -0.0), "score > 0.0")

for _name, (_predicate, _where) in PREDICATES.items():

    @add(f"filter_{_name}", sql_knn("l2", 10, where=_where))
    def _(spark, d, predicate=_predicate):
        r = records(spark, d)
        return search.exact_knn(r, stated(r), "l2", 10, predicate, config_of())


@add(
    "filter_truth_table",
    " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) FILTER (({w}) IS TRUE) AS n_true, count(*) FILTER (({w}) IS FALSE) AS n_false, count(*) FILTER (({w}) IS NULL) AS n_unknown FROM r"
        for n, (_, w) in PREDICATES.items()
    ).join([f"WITH {R} ", ""]),
)
def _(spark, d):
    r, c = records(spark, d), config_of()
    aggregates = []
    for name, (p, _) in PREDICATES.items():
        value = to_column(validate(p, c), c)
        aggregates.append(F.struct(F.lit(name).alias("name"), F.count(F.when(value, 1)).alias("n_true"), F.count(F.when(~value, 1)).alias("n_false"), F.count(F.when(value.isNull(), 1)).alias("n_unknown")))
    return r.agg(F.array(*aggregates).alias("a")).select(F.inline("a"))


@add("bridge_num_ge", sql_knn("cosine", 10, where="n_chars >= 1000"))
def _(spark, d):
    r = records(spark, d)
    return search.exact_knn(r, stated(r), "cosine", 10, Compare("n_chars", "ge", 1000), config_of())


@add("bridge_label_eq", sql_knn("cosine", 10, where="lang = 'de'"))
def _(spark, d):
    r = records(spark, d)
    return search.exact_knn(r, stated(r), "cosine", 10, Compare("lang", "eq", "de"), config_of())


# Trees: directory, planning, budget.

TREE_KEY = ("label", "half")


def tree_directory(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy(*TREE_KEY).agg(F.count("*").alias("records")).withColumn("tree_id", F.xxhash64(*TREE_KEY))


@add("tree_directory", f"WITH {R} SELECT label, half, count(*) AS records FROM r GROUP BY label, half")
def _(spark, d):
    return tree_directory(spark, d).select("label", "half", "records")


TREE_PLANS: dict[str, tuple[Predicate | None, int, str, str]] = {
    "eq": (Compare("label", "eq", 3), 4096, "label = 3", "TRUE"),
    "in": (And((In("label", (1, 4, 8)), Compare("half", "eq", True))), 4096, "label IN (1, 4, 8) AND half", "TRUE"),
    "range": (And((Compare("label", "ge", 2), Compare("label", "lt", 6), Compare("score", "gt", 1.0))), 4096, "label >= 2 AND label < 6", "TRUE"),
    "not": (Not(Compare("label", "le", 5)), 4096, "label > 5", "TRUE"),
    "or_widen": (Or((Compare("label", "eq", 3), Compare("lang", "eq", "en"))), 4096, "TRUE", "TRUE"),
    "residual": (And((Compare("label", "ge", 2), Compare("half", "eq", False))), 4096, "label >= 2", "NOT half"),
    "impossible": (And((Compare("label", "lt", 2), Compare("label", "gt", 5))), 4096, "FALSE", "TRUE"),
}

for _name, (_predicate, _budget, _range, _rest) in TREE_PLANS.items():

    @add(
        f"tree_plan_{_name}",
        f"WITH {R}, t AS (SELECT label, half, row_number() OVER (ORDER BY label, half) AS tree_rank FROM (SELECT DISTINCT label, half FROM r) WHERE {_range}) SELECT label, half, tree_rank FROM t WHERE {_rest}",
    )
    def _(spark, d, predicate=_predicate, budget=_budget):
        c = config_of(key=TREE_KEY)
        return treekeys.enumerate_trees(tree_directory(spark, d), validate(predicate, c), c, budget)[0].select("label", "half", F.col("tree_rank").cast("long").alias("tree_rank"))


@add("tree_budget", f"WITH {R}, t AS (SELECT DISTINCT label, half FROM r WHERE label >= 2) SELECT least(count(*), 5) AS scanned_tree_keys, count(*) > 5 AS tree_keys_exhausted FROM t")
def _(spark, d):
    c = config_of(key=TREE_KEY)
    return treekeys.enumerate_trees(tree_directory(spark, d), Compare("label", "ge", 2), c, 5)[1].select(F.col("scanned_tree_keys").cast("long").alias("scanned_tree_keys"), "tree_keys_exhausted")


# Synopses and leaf classes; a leaf is a label here.


def leaf_rows(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).withColumn("tree_id", F.lit(0).cast("long")).withColumn("leaf_id", F.col("label") * 2 + F.col("half").cast("long"))


_SYNOPSIS_SQL = f"""WITH {R}, s AS (SELECT label * 2 + half::bigint AS leaf_id, count(*) AS entries,
  {", ".join(f"bool_or({f.name} IS NULL) AS {f.name}_has_null, min({f.name}) AS {f.name}_min, max({f.name}) AS {f.name}_max" for f in FIELDS)}
  FROM r GROUP BY 1)"""


@add("synopsis_minmax", _SYNOPSIS_SQL + " SELECT * FROM s")
def _(spark, d):
    return build.synopses(leaf_rows(spark, d), config_of()).drop("tree_id", "lang_bloom")


@add("synopsis_bloom_bits")
def _(spark, d):
    return build.synopses(leaf_rows(spark, d), config_of()).select("leaf_id", "lang_bloom", (F.size("lang_bloom") / F.lit(256.0)).alias("fill"))


_CLASS_PREDICATES = {"label": Compare("label", "eq", 3), "score": Compare("score", "lt", 250.0), "null": IsNull("quality")}


@add(
    "synopsis_classify",
    _SYNOPSIS_SQL
    + """ SELECT leaf_id, CASE WHEN label_min <= 3 AND label_max >= 3 THEN CASE WHEN label_min = label_max THEN 'AllMatch' ELSE 'MayMatch' END ELSE 'NoMatch' END AS by_label,
  CASE WHEN score_min IS NULL OR score_min >= 250 THEN 'NoMatch' WHEN score_max < 250 AND NOT score_has_null THEN 'AllMatch' ELSE 'MayMatch' END AS by_score,
  CASE WHEN NOT quality_has_null THEN 'NoMatch' WHEN quality_min IS NULL THEN 'AllMatch' ELSE 'MayMatch' END AS by_null FROM s""",
)
def _(spark, d):
    c = config_of()
    s = build.synopses(leaf_rows(spark, d), c)
    return s.select("leaf_id", *[classify(validate(p, c), c, F.col("entries")).alias(f"by_{n}") for n, p in _CLASS_PREDICATES.items()])


_SOUND = {n: p for n, (p, _) in PREDICATES.items()}


@add("synopsis_is_sound", " UNION ALL ".join(f"SELECT '{n}' AS name, 0::bigint AS missed" for n in _SOUND))
def _(spark, d):
    """Rows whose truth value their leaf's synopsis rules out: none."""
    c = config_of()
    rows, s = leaf_rows(spark, d), build.synopses(leaf_rows(spark, d), c)
    counts = []
    joined = rows
    for i, p in enumerate(_SOUND.values()):
        t, f, u = truths(validate(p, c), c)
        s = s.withColumn(f"t{i}", t).withColumn(f"f{i}", f).withColumn(f"u{i}", u)
    flags = s.select("leaf_id", *[f"{k}{i}" for i in range(len(_SOUND)) for k in "tfu"])
    joined = joined.join(flags, "leaf_id")
    for i, (n, p) in enumerate(_SOUND.items()):
        value = to_column(validate(p, c), c)
        missed = F.when(value.isNull(), ~F.col(f"u{i}")).when(value, ~F.col(f"t{i}")).otherwise(~F.col(f"f{i}"))
        counts.append(F.struct(F.lit(n).alias("name"), F.count(F.when(missed, 1)).alias("missed")))
    return joined.agg(F.array(*counts).alias("a")).select(F.inline("a"))


# Codes.


def codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of vectors as they are, without rotation."""

    def run(batches):
        for pdf in batches:
            c = encode(np.stack(pdf["vector"].to_numpy())) if len(pdf) else None
            if c is not None:
                yield pd.DataFrame({"id": pdf["id"], "code": list(c.code.astype(np.int32)), "scale": c.scale, "norm_sq": c.norm_sq.astype(np.int64), "err": c.err, "vector": pdf["vector"]})

    return records(spark, d).select("id", "vector").mapInPandas(run, "id long, code array<int>, scale float, norm_sq long, err float, vector array<float>")


_CODES_SQL = f"""WITH {R}, m AS (SELECT id, v, list_max(list_transform(v, lambda x: abs(x)::double)) / 63 AS step FROM r),
  c AS (SELECT id, v, list_transform(v, lambda x: (sign(x) * least(63.0, round(abs(x)::double / step)))::int) AS code FROM m),
  s AS (SELECT id, v, code, ({sql_dot('v', 'code')} / {sql_dot('code', 'code')})::float AS scale, ({sql_dot('code', 'code')})::bigint AS norm_sq FROM c)"""


@add("rabitq_codes", _CODES_SQL + " SELECT id, array_to_string(code, ',') AS code, scale, norm_sq FROM s")
def _(spark, d):
    return codes(spark, d).select("id", F.concat_ws(",", F.transform("code", lambda x: x.cast("string"))).alias("code"), "scale", "norm_sq")


@add("rabitq_error", _CODES_SQL + " SELECT id, round(sqrt(list_sum(list_transform(list_zip(v, code), lambda p: (p[1]::double - scale::double * p[2]) * (p[1]::double - scale::double * p[2])))), 5) AS err FROM s")
def _(spark, d):
    return codes(spark, d).select("id", F.round(F.col("err").cast("double"), 5).alias("err"))


_ROUGH_SQL = (
    _CODES_SQL
    + f""", q AS (SELECT id AS qid, v AS qv, list_max(list_transform(v, lambda x: abs(x)::double)) / 32767 AS s, {sql_dot('v', 'v')} AS qq FROM r WHERE id % 100 = 0),
  a AS (SELECT qid, s, qq, list_transform(qv, lambda x: round(x::double / s)) AS a FROM q),
  d AS (SELECT qid, id, greatest(0, qq + scale::double * scale::double * norm_sq - 2 * ({sql_dot('a', 'code')} * a.s * scale::double)) AS rough FROM a, s),
  t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rough, id) AS rough_rank FROM d)"""
)


@add("rabitq_rough_topr", _ROUGH_SQL + " SELECT qid, id, round(rough, 6) AS rough, rough_rank FROM t WHERE rough_rank <= 64")
def _(spark, d):
    r = records(spark, d)
    ranked = search.top_k(scan.roughly_nearest(r, stated(r), 64), 64)
    return ranked.select("qid", "id", F.round("rank", 6).alias("rough"), F.col("position").cast("long").alias("rough_rank"))


@add("interval_contains_exact", "SELECT count(*) AS pairs, count(*) AS inside FROM embeddings, (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0)")
def _(spark, d):
    r = records(spark, d)
    return scan.inside(r, stated(r))


@add("interval_exclusion", sql_knn("l2", 10).replace("SELECT qid, id, sqrt(rank) AS distance, position", "SELECT qid, id, position"))
def _(spark, d):
    """The k-th least upper bound excludes candidates by their lower bound; what stays still has the exact top k."""
    r = records(spark, d)
    ranked = scan.not_excluded(r, stated(r), 10).withColumn("u", F.row_number().over(Window.partitionBy("qid").orderBy("upper", "id")))
    cut = F.max(F.when(F.col("u") == 10, F.col("upper"))).over(Window.partitionBy("qid"))
    left = ranked.withColumn("cut", cut).filter("lower <= cut")
    return search.top_k(left.select("qid", "id", F.col("exact").alias("rank")), 10).select("qid", "id", "position")


@add("rotation_preserves_norm", "SELECT vec_id AS id, true AS same FROM embeddings")
def _(spark, d):
    kernel = build.kernel_of(config_of())

    def run(batches):
        for pdf in batches:
            x = np.stack(pdf["vector"].to_numpy()).astype(np.float32)
            y = kernel.rotation(x)
            yield pd.DataFrame({"id": pdf["id"], "same": np.abs((x.astype(float) ** 2).sum(1) - (y.astype(float) ** 2).sum(1)) < 1e-4})

    return records(spark, d).select("id", "vector").mapInPandas(run, "id long, same boolean")


# Construction and maintenance steps.

_MEAN_SQL = "e AS (SELECT id, label, unnest(v) AS c, generate_subscripts(v, 1) AS pos FROM r), m AS (SELECT label, pos, sum(c::decimal(20, 12)) / count(*) AS m, count(*) AS n FROM e GROUP BY label, pos)"


@add("leaf_centroids", f"WITH {R}, {_MEAN_SQL} SELECT label, pos::bigint AS pos, round(m::double, 3) + 0.0::double AS mean, n FROM m")
def _(spark, d):
    rows = records(spark, d).select(F.lit(0).cast("long").alias("tree_id"), F.col("label").alias("leaf_id"), "id", "vector")
    made = refine._centres(rows, config_of()).select("leaf_id", "entry_count", F.posexplode("centroid").alias("pos", "m"))
    return made.select(F.col("leaf_id").alias("label"), (F.col("pos") + 1).cast("long").alias("pos"), (F.round(F.col("m").cast("double"), 3) + 0.0).alias("mean"), F.col("entry_count").alias("n"))


@add(
    "leaf_dispersion",
    f"""WITH r AS (SELECT vec_id AS id, label::bigint AS label, embedding AS v FROM embeddings), {_MEAN_SQL}
  SELECT label, round(sqrt(least(1, greatest(0, 1 - sum(m::double * m::double)))), 5) AS dispersion FROM m GROUP BY label""",
)
def _(spark, d):
    kernel = build.kernel_of(config_of("cosine"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mean = np.stack(pdf["embedding"].to_numpy()).astype(float).mean(axis=0)
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "dispersion": [kernel.dispersion(mean)]})

    rows = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("label"), "embedding")
    return rows.groupBy("label").applyInPandas(run, "label long, dispersion double").select("label", F.round("dispersion", 5).alias("dispersion"))


def seeds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows in leaves by label, and leaves whose centre is their first member."""
    rows = records(spark, d).select(F.lit(0).cast("long").alias("tree_id"), F.col("label").alias("leaf_id"), "id", "vector")
    first = rows.groupBy("tree_id", "leaf_id").agg(F.min(F.struct("id", "vector")).alias("f"), F.count("*").alias("entry_count"))
    return rows, first.select("tree_id", "leaf_id", F.col("f.vector").alias("centroid"), "entry_count")


_SEEDS_SQL = f"WITH {R}, f AS (SELECT label, arg_min(v, id) AS c FROM r GROUP BY label)"


@add(
    "nearest_centroid_assign",
    _SEEDS_SQL + f", d AS (SELECT r.id, f.label, {sql_l2('r.v', 'f.c')} AS d FROM r, f), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, label) AS n FROM d) SELECT id, label AS leaf_id FROM t WHERE n = 1",
)
def _(spark, d):
    rows, leaves = seeds(spark, d)
    targets = leaves.select(F.lit(0).cast("long").alias("tree_id"), F.col("leaf_id").alias("part_id"), "centroid")
    found = maintain.nearest(rows.select(F.lit(0).cast("long").alias("tree_id"), "id", "vector"), targets, config_of(), True)
    return found.select("id", F.col("new_part").alias("leaf_id"))


_PROPOSE_SQL = (
    _SEEDS_SQL
    + f""", g AS (SELECT a.label, b.label AS target, b.c, {sql_l2('a.c', 'b.c')} AS d FROM f a, f b WHERE a.label <> b.label),
  n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, target) AS n FROM g)"""
)


@add("refine_candidate_neighbors", _PROPOSE_SQL + " SELECT label AS leaf_id, target FROM n WHERE n <= 3")
def _(spark, d):
    return refine.neighbour_leaves(seeds(spark, d)[1], build.kernel_of(config_of()), 3).select("leaf_id", "target")


@add(
    "refine_positive_moves",
    _PROPOSE_SQL
    + f""", p AS (SELECT r.id, r.label, n.target, {sql_l2('r.v', 'f.c')} AS now, {sql_l2('r.v', 'n.c')} AS d FROM r JOIN f USING (label) JOIN n ON n.label = r.label AND n.n <= 3),
  t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, target) AS k FROM p)
  SELECT id, label AS leaf_id, target, now - d AS gain FROM t WHERE k = 1 AND d < now""",
)
def _(spark, d):
    rows, leaves = seeds(spark, d)
    return refine.proposals(rows, leaves, build.kernel_of(config_of()), 3).select("id", "leaf_id", "target", "gain")


_ACTION_SQL = f"WITH {R}, p AS (SELECT label, lang, count(*) AS n FROM r GROUP BY label, lang)"


@add("actionable_partitions", _ACTION_SQL + " SELECT label AS tree_id, n AS entry_count, CASE WHEN n > 32 THEN 'split' WHEN n < 8 THEN 'merge' END AS action FROM p WHERE n > 32 OR n < 8")
def _(spark, d):
    p = records(spark, d).groupBy(F.col("label").alias("tree_id"), "lang").agg(F.count("*").alias("entry_count"))
    p = p.select("tree_id", "entry_count", F.lit(2).alias("part_id"), F.lit(1).alias("level"), F.lit("Ready").alias("state"))
    return maintain.actionable(p, config_of()).select("tree_id", "entry_count", "action")


@add(
    "merge_target_select",
    f"""WITH {R}, p AS (SELECT label * 2 + half::bigint AS part_id, arg_min(v, id) AS c, count(*) FILTER (id % 3 = 0) AS n FROM r GROUP BY 1),
  t AS (SELECT a.part_id AS source, b.part_id AS target, row_number() OVER (PARTITION BY a.part_id ORDER BY {sql_l2('a.c', 'b.c')}, b.part_id) AS k FROM p a, p b WHERE a.n < 8 AND a.part_id <> 1 AND a.part_id <> b.part_id)
  SELECT source, target FROM t WHERE k = 1""",
)
def _(spark, d):
    rows = records(spark, d).withColumn("part_id", F.col("label") * 2 + F.col("half").cast("long"))
    p = rows.groupBy("part_id").agg(F.min(F.struct("id", "vector")).alias("f"), F.count(F.when(F.col("id") % 3 == 0, 1)).alias("entry_count"))
    p = p.select(F.lit(0).cast("long").alias("tree_id"), "part_id", F.lit(1).alias("level"), F.lit("Ready").alias("state"), "entry_count", F.col("f.vector").alias("centroid"))
    return maintain.merge_targets(p, config_of()).select("source", "target")


# The index.

_built: dict[tuple, Index] = {}


def index(spark: SparkSession, d: str, metric: str = "l2") -> Index:
    """Built once per session and input; the snapshot is on disk."""
    key = (spark.sparkContext.applicationId, d, metric)
    if key not in _built:
        _built[key] = Runtime(spark, folder(spark, "index")).create_index("fixture", config_of(metric), records(spark, d))
    return _built[key]


WIDE = SearchOptions(k=10, leaf_beam=None, partitions=None)


for _name, _metric, _predicate, _where in (
    ("full_beam", "l2", None, "TRUE"),
    ("full_beam_cosine", "cosine", None, "TRUE"),
    ("full_beam_ip", "inner_product", None, "TRUE"),
    ("filtered", "l2", PREDICATES["and_or_not_nested"][0], PREDICATES["and_or_not_nested"][1]),
    ("filtered_tree_key", "l2", And((In("label", (2, 5)), Compare("lang", "eq", "en"))), "label IN (2, 5) AND lang = 'en'"),
    ("filtered_null", "cosine", IsNull("score"), "score IS NULL"),
):

    @add(f"ann_search_{_name}", sql_knn(_metric, 10, where=_where))
    def _(spark, d, metric=_metric, predicate=_predicate):
        return index(spark, d, metric).search(stated(records(spark, d)), predicate, WIDE).hits


@add("fanout_knn_by_tree", sql_knn("l2", 5, where="label IN (SELECT DISTINCT label FROM r ORDER BY label LIMIT 2)"))
def _(spark, d):
    return index(spark, d).search(stated(records(spark, d)), None, SearchOptions(k=5, leaf_beam=None, partitions=None, tree_keys=2)).hits


@add("ann_search_narrow_beam")
def _(spark, d):
    return index(spark, d).search(stated(records(spark, d)), None, SearchOptions(k=10, leaf_beam=1)).hits


@add("ann_search_graph_routing", "SELECT count(*) AS queries, TRUE AS walked, TRUE AS recall_reached FROM embeddings WHERE vec_id % 100 = 0")
def _(spark, d):
    """One tree of small leaves under a root with over 64 children, which a graph routes among; a beam of a quarter of the leaves."""
    key = (spark.sparkContext.applicationId, d, "graph")
    if key not in _built:
        config = config_of("cosine", ()).with_(leaf_min=2, leaf_max=4, internal_min=2, internal_max=16384)
        _built[key] = Runtime(spark, folder(spark, "index")).create_index("fixture", config, records(spark, d))
    leaves = _built[key].snapshot().table("partitions").filter("level = 1").count()
    out = _built[key].search(stated(records(spark, d)), None, SearchOptions(k=10, leaf_beam=leaves // 4, partitions=16384, routing="hnsw", ef=leaves // 2))
    found = recall.summary(recall.per_query(search.exact_knn(records(spark, d), stated(records(spark, d)), "cosine", 10), out.hits))
    walked = out.usage.agg((F.min("graph_walks") > 0).alias("walked"))
    return found.join(walked).select("queries", "walked", (F.col("mean_recall") >= 0.9).alias("recall_reached"))


@add("ann_usage_report")
def _(spark, d):
    return index(spark, d).search(stated(records(spark, d)), PREDICATES["gt"][0], SearchOptions(k=10, leaf_beam=2, partitions=24)).usage


@add("ann_search_beam_sweep")
def _(spark, d):
    r = records(spark, d)
    truth = search.exact_knn(r, stated(r), "l2", 10)
    return recall.sweep(index(spark, d).snapshot(), config_of(), stated(r), truth, (1, 2, 4))


@add("recall_at_k", _ROUGH_SQL + f", b AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS n FROM (SELECT q.qid, r.id, {sql_l2('q.qv', 'r.v')} AS d FROM q, r)) SELECT b.qid, count(*) AS wanted, count(t.id) AS found, count(t.id) / count(*)::double AS recall FROM b LEFT JOIN (SELECT qid, id FROM t WHERE rough_rank <= 10) t ON t.qid = b.qid AND t.id = b.id WHERE n <= 10 GROUP BY b.qid")
def _(spark, d):
    r = records(spark, d)
    rough = search.top_k(scan.roughly_nearest(r, stated(r), 10), 10)
    return recall.per_query(search.exact_knn(r, stated(r), "l2", 10), rough)


@add("diagnostics_truth_coverage", "SELECT vec_id AS qid, 10::bigint AS truth, 10::bigint AS in_leaf, 10::bigint AS in_pool, 10::bigint AS reranked FROM embeddings WHERE vec_id % 100 = 0")
def _(spark, d):
    i, r = index(spark, d), records(spark, d)
    out = i.search(stated(r), None, WIDE)
    return recall.coverage(search.exact_knn(r, stated(r), "l2", 10), i.snapshot().table("leaf_entries"), out.visited, out.pool)


_PER_TREE = f"WITH {R} SELECT label, count(*) AS records FROM r GROUP BY label"


def per_tree(partitions: DataFrame, trees: DataFrame) -> DataFrame:
    """Entries of all leaves of each tree, by its key."""
    held = partitions.filter("level = 1").groupBy("tree_id").agg(F.sum("entry_count").alias("records"))
    return trees.select("tree_id", "label").join(held, "tree_id").select("label", "records")


@add("topology_entries_by_tree", _PER_TREE)
def _(spark, d):
    now = index(spark, d).snapshot()
    return per_tree(now.table("partitions"), now.table("trees"))


@add("split_wave_keeps_entries", _PER_TREE)
def _(spark, d):
    """A wave that splits every leaf over eight."""
    i = index(spark, d)
    made = maintain.split_leaves(i.snapshot(), i.config.with_(leaf_min=2, leaf_max=8))
    return per_tree(made["partitions"], made["trees"])


@add("merge_wave_keeps_entries", _PER_TREE)
def _(spark, d):
    """A wave that merges every leaf under sixteen into its nearest neighbour that stays."""
    i = index(spark, d)
    made = maintain.merge_leaves(i.snapshot(), i.config.with_(leaf_min=16))
    return per_tree(made["partitions"], i.snapshot().table("trees"))


@add("verify_clean", "SELECT 'x' AS kind, 'x' AS subject WHERE FALSE")
def _(spark, d):
    return verify.issues(index(spark, d).snapshot(), config_of())


# Damaged copies: what verification must find.


def sound(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = leaf_rows(spark, d)
    return rows, rows.drop("vector")


@add(
    "verify_membership",
    f"WITH {R} SELECT 'Membership' AS kind, id::varchar AS subject FROM r WHERE id % 50 = 1 UNION ALL SELECT 'Membership', (id + 1000000)::varchar FROM r WHERE id % 50 = 2 UNION ALL SELECT 'Membership', id::varchar FROM r WHERE id % 50 = 3",
)
def _(spark, d):
    rows, entries = sound(spark, d)
    damaged = entries.filter("id % 50 <> 1").withColumn("id", F.when(F.col("id") % 50 == 2, F.col("id") + 1000000).otherwise(F.col("id")))
    damaged = damaged.unionByName(entries.filter("id % 50 = 3"))
    missing = rows.filter("id % 50 <> 2")
    return verify.membership(missing, damaged)


@add("verify_projection", f"WITH {R} SELECT 'RecordProjectionMismatch' AS kind, id::varchar AS subject FROM r WHERE (id % 50 = 4) OR (id % 50 = 5 AND quality IS NOT NULL)")
def _(spark, d):
    rows, entries = sound(spark, d)
    damaged = entries.withColumn("n_chars", F.when(F.col("id") % 50 == 4, F.coalesce("n_chars", F.lit(0)) + 1).otherwise(F.col("n_chars")))
    damaged = damaged.withColumn("quality", F.when(F.col("id") % 50 == 5, F.lit(None)).otherwise(F.col("quality")))
    return verify.projection(rows, damaged, config_of())


@add("verify_counts", f"WITH {R} SELECT DISTINCT 'CountMismatch' AS kind, '0/' || (label * 2 + half::bigint) AS subject FROM r WHERE label * 2 + half::bigint IN (4, 7)")
def _(spark, d):
    _, entries = sound(spark, d)
    p = entries.groupBy("tree_id", F.col("leaf_id").alias("part_id")).agg(F.count("*").alias("entry_count")).select("tree_id", "part_id", F.lit(None).cast("long").alias("parent_id"), F.lit(1).alias("level"), "entry_count")
    return verify.counts(p.withColumn("entry_count", F.col("entry_count") - F.col("part_id").isin(4, 7).cast("int")), entries)


@add("verify_synopsis", f"WITH {R} SELECT 'SynopsisNotConservative' AS kind, '0/' || (label * 2 + half::bigint) AS subject FROM r WHERE label IN (2, 3) GROUP BY 2 HAVING count(n_chars) > 0")
def _(spark, d):
    rows, entries = sound(spark, d)
    s = build.synopses(rows, config_of())
    narrow = s.withColumn("n_chars_max", F.when(F.col("leaf_id").between(4, 7), F.col("n_chars_max") - 1).otherwise(F.col("n_chars_max") + 5))
    return verify.narrow_synopses(narrow, entries, config_of())


@add("verify_reachability", f"WITH {R} SELECT DISTINCT 'Reachability' AS kind, '0/' || (label * 2 + half::bigint + 2) AS subject FROM r WHERE label = 4 UNION ALL SELECT DISTINCT 'Reachability', '0/' || (label * 2 + half::bigint + 2) FROM r WHERE label = 4")
def _(spark, d):
    """Leaves of one label lose their parent edge, and entries of another lose their leaf."""
    _, entries = sound(spark, d)
    entries = entries.withColumn("leaf_id", F.col("leaf_id") + 2)
    leaves = entries.select("tree_id", F.col("leaf_id").alias("part_id")).distinct().withColumn("parent_id", F.lit(1).cast("long")).withColumn("level", F.lit(1))
    root = spark.range(1).select(F.col("id").alias("tree_id"), F.lit(1).cast("long").alias("part_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(2).alias("level"))
    cut = leaves.withColumn("parent_id", F.when(F.col("part_id").isin(10, 11), F.lit(None)).otherwise(F.col("parent_id")))
    one = verify.reachability(root.select("tree_id"), root.unionByName(cut), entries)
    return one.unionByName(verify.reachability(root.select("tree_id"), root.unionByName(leaves.filter("part_id not in (10, 11)")), entries))


# Reads and mutations.


@add("batch_get_ordered", f"WITH {R}, i AS (SELECT unnest([7, 3, 7, 99999999, 0]) AS id, generate_subscripts([7, 3, 7, 99999999, 0], 1) - 1 AS pos) SELECT pos::bigint AS pos, i.id::bigint AS id, label, lang, score, 'NotLoaded' AS payload_status FROM i LEFT JOIN r ON r.id = i.id")
def _(spark, d):
    ids = spark.createDataFrame(list(enumerate([7, 3, 7, 99999999, 0])), "pos long, id long")
    return search.get(index(spark, d).snapshot(), ids).select("pos", "id", "label", "lang", "score", "payload_status")


@add("payload_projection", "SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN 'Absent' ELSE 'Present' END AS payload_status, CASE WHEN item_id % 3 = 0 THEN NULL WHEN item_id % 3 = 1 THEN 0 ELSE strlen(text) END::bigint AS bytes FROM benchmark")
def _(spark, d):
    raw = table(spark, d, "benchmark")
    b = raw.select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 3 == 1, F.lit(b"")).when(F.col("item_id") % 3 == 2, F.encode("text", "utf-8")).alias("payload"))
    made = b.select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector"), "payload")
    i = Runtime(spark, folder(spark, "index")).create_index("payloads", IndexConfig(2), made)
    got = i.get(b.select(F.col("id").alias("pos"), "id"), payload=True)
    return got.select("id", "payload_status", F.octet_length("payload").cast("long").alias("bytes"))


def batch(rows: DataFrame) -> DataFrame:
    """By the last digit of the id: upsert it, delete it, insert a new one, delete a missing one, create one."""
    digit = F.col("id") % 10
    op = F.when(digit.isin(0, 4), "upsert").when(digit.isin(1, 3), "delete").when(digit == 2, "insert")
    new = F.when(digit == 2, F.col("id") + 1000000).when(digit == 3, F.col("id") + 2000000).when(digit == 4, F.col("id") + 3000000).otherwise(F.col("id"))
    changed = rows.withColumn("op", op).filter("op is not null").withColumn("pos", F.col("id")).withColumn("id", new)
    return changed.withColumn("vector", F.transform("vector", lambda x: -x)).withColumn("label", (F.col("label") + 1) % 10)


_BATCH_SQL = f"""WITH {R}, b AS (SELECT id AS pos, CASE WHEN id % 10 IN (0, 4) THEN 'upsert' WHEN id % 10 IN (1, 3) THEN 'delete' ELSE 'insert' END AS op,
  id + CASE id % 10 WHEN 2 THEN 1000000 WHEN 3 THEN 2000000 WHEN 4 THEN 3000000 ELSE 0 END AS id, list_transform(v, lambda x: -x) AS v, (label + 1) % 10 AS label FROM r WHERE id % 10 <= 4)"""


@add("mutate_outcomes", _BATCH_SQL + " SELECT pos, b.id, CASE WHEN op = 'insert' THEN 'Inserted' WHEN op = 'upsert' THEN CASE WHEN r.id IS NULL THEN 'Created' ELSE 'Replaced' END ELSE CASE WHEN r.id IS NULL THEN 'Missing' ELSE 'Deleted' END END AS outcome FROM b LEFT JOIN r ON r.id = b.id")
def _(spark, d):
    r = records(spark, d)
    return mutate.outcomes(batch(r), r)


@add("mutate_insert_conflicts", f"WITH {R} SELECT id AS pos, id FROM r WHERE id % 10 = 5")
def _(spark, d):
    r = records(spark, d)
    wanted = r.filter("id % 10 in (5, 6)").select(F.col("id").alias("pos"), F.lit("insert").alias("op"), F.when(F.col("id") % 10 == 6, F.col("id") + 1000000).otherwise(F.col("id")).alias("id"))
    return mutate.conflicts(wanted, r)


_AFTER_SQL = _BATCH_SQL + ", a AS (SELECT id, label, v FROM r WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, label, v FROM b WHERE op <> 'delete')"


@add("mutate_records", _AFTER_SQL + " SELECT id, label, v[1] AS first FROM a")
def _(spark, d):
    """The records after the batch."""
    i = index(spark, d)
    now = i.snapshot()
    new = mutate.apply(now, batch(records(spark, d)), i.config)["records"]
    whole = now.table("records").filter(~F.col("shard").isin(new.shards)).unionByName(new.rows)
    return whole.select("id", "label", F.col("vector")[0].alias("first"))


_mutated: dict[tuple, Index] = {}


def mutated(spark: SparkSession, d: str) -> Index:
    """An index of its own after the batch and upkeep."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _mutated:
        made = Runtime(spark, folder(spark, "mutated")).create_index("fixture", config_of(), records(spark, d))
        made.batch_mutate(batch(records(spark, d)))
        made.maintain()
        _mutated[key] = made
    return _mutated[key]


@add("mutate_then_search", sql_knn("l2", 10, relation=_AFTER_SQL.removeprefix("WITH ").replace("r AS (", "r0 AS (", 1).replace("FROM r WHERE id % 10", "FROM r0 WHERE id % 10").replace("FROM r WHERE id NOT", "FROM r0 WHERE id NOT").replace(", a AS (", ", r AS (")))
def _(spark, d):
    """Search after mutations, splits and merges equals brute force over the changed records."""
    i = mutated(spark, d)
    return i.search(stated(i.snapshot().table("records").select("id", "vector")), None, WIDE).hits


@add("mutate_then_verify", "SELECT 'x' AS kind, 'x' AS subject WHERE FALSE")
def _(spark, d):
    return verify.issues(mutated(spark, d).snapshot(), config_of())


@add("refine_then_verify", "SELECT 'x' AS kind, 'x' AS subject WHERE FALSE")
def _(spark, d):
    made = Runtime(spark, folder(spark, "refined")).create_index("fixture", config_of(), records(spark, d))
    made.refine()
    return verify.issues(made.snapshot(), config_of())


@add("latest_vector_from_event_stream", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(spark, d):
    return latest(table(spark, d, "events"), "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type", "value")


@add("budget_distribution", f"WITH {R} SELECT count(n_chars) AS n, round(avg(n_chars), 6) AS mean, min(n_chars) AS least, max(n_chars) AS most FROM r WHERE n_chars IS NOT NULL")
def _(spark, d):
    out = recall.distribution(records(spark, d).filter("n_chars is not null"), "n_chars")
    return out.select("n", F.round("mean", 6).alias("mean"), "least", "most")


