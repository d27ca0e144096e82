"""Queries of the structure-dataset operators on the relational test tables.

Orders stand for structures, order lines for atoms and for paired values,
embeddings for descriptors.  The key of each query is its inventory id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.expression import compile_predicate
from framelake.operators.audit import exact_quantile, gcd_of
from framelake.operators.cells import supercell
from framelake.operators.filters import combine, element_condition, index_positions, parse_elements, tag_groups, text_condition
from framelake.operators.vectors import distance, farthest_points, pairwise_distances, principal_variances, sqrt_quotas
from framelake.runtime import read_table


def query_registry() -> tuple[dict, dict[str, str], object]:
    """Empty tables of queries and their SQL, and the decorator that fills them."""
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None):
        """Register a query under its function's name, with its SQL."""

        def add(f):
            queries[f.__name__] = lambda spark, sf_dir, f=f: f(lambda name: read_table(spark, sf_dir, name))
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query


QUERIES, ORACLE, query = query_registry()


def _error():
    return F.col("l_extendedprice") - F.col("l_quantity") * F.col("p_retailprice")


def _pairs(t) -> DataFrame:
    """Order lines with their prediction and reference values."""
    return t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))


def _structures(t) -> DataFrame:
    """Structures with atom counts, element fractions and the largest magnitude of the atoms' values."""
    frac = lambda e: F.avg(F.when(F.col("l_returnflag") == e, 1.0).otherwise(0.0))
    return t("lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("natoms"), frac("A").alias("frac_A"), frac("N").alias("frac_N"), frac("R").alias("frac_R"),
        F.max(F.abs("l_extendedprice")).alias("price"), F.array_sort(F.collect_set("l_returnflag")).alias("elements"),
    )


def _as_elements():
    """Return flags A, N and R as the elements H, N and B."""
    return F.transform("elements", lambda e: F.when(e == "A", "H").when(e == "R", "B").otherwise(e))


@query("SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' AND o_totalprice > 200000")
def f1_composite_all(t):
    o = t("orders")
    return o.where(combine([text_condition(F.col("o_orderpriority"), ["URGENT"]), compile_predicate("price > 200000", {"price": F.col("o_totalprice")})])).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), '^(small|large).*ring')")
def f2_text_regex(t):
    return t("part").where(text_condition(F.col("p_name"), ["^(small|large).*ring"], "regex")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE lower(p_type) = 'promo' OR lower(p_brand) LIKE 'brand#1%' OR lower(p_name) LIKE '%ring'")
def f2_text_modes(t):
    tests = [text_condition(F.col("p_type"), ["PROMO"], "exact"), text_condition(F.col("p_brand"), ["brand#1"], "prefix"), text_condition(F.col("p_name"), ["ring"], "suffix")]
    return t("part").where(combine(tests, "any")).select("p_partkey")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(CASE WHEN l_returnflag='R' THEN 1 END) > 0 AND count(CASE WHEN l_returnflag='A' THEN 1 END) = 0")
def f3_required_excluded(t):
    return _structures(t).where(element_condition(_as_elements(), required=["B"], excluded=["H"])).select("l_orderkey")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(CASE WHEN l_returnflag NOT IN ('R','N') THEN 1 END) = 0")
def f4_element_query(t):
    return _structures(t).where(element_condition(_as_elements(), **parse_elements("B,N"))).select("l_orderkey")


@query("SELECT doc_id FROM documents WHERE (lang LIKE '%en%' OR lang LIKE '%de%') AND NOT (source LIKE '%board%')")
def f6_tag_groups(t):
    d = t("documents")
    return d.where(tag_groups(F.col("lang"), [("any", [("en", False), ("de", False)])]) & tag_groups(F.col("source"), [("all", [("board", True)])])).select("doc_id")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 3 AND avg(CASE WHEN l_returnflag='R' THEN 1.0 ELSE 0.0 END) >= 0.5 AND max(abs(l_extendedprice)) > 20000")
def f7_expression(t):
    fields = {"natoms": F.col("natoms"), "frac.R": F.col("frac_R"), "price": F.col("price")}
    return _structures(t).where(compile_predicate("natoms > 3 and frac.R >= 0.5 AND price > 20000", fields)).select("l_orderkey")


@query("SELECT DISTINCT record_id FROM audit_records WHERE NOT coalesce(max_force > 1 AND NOT isnan(max_force), false) AND coalesce(isnan(energy_per_atom) OR energy_per_atom <> -5, true)")
def f7_missing_semantics(t):
    fields = {"force": F.col("max_force"), "energy": F.col("energy_per_atom")}
    return t("audit_records").where(compile_predicate("not (force > 1) and energy != -5", fields)).select("record_id").distinct()


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) t WHERE (i < 100 AND i % 3 = 0) OR i >= n - 5")
def f8_index_expression(t):
    return index_positions(t("orders").select("o_orderkey"), ["o_orderkey"], "0:100:3,-5:")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount BETWEEN 0.02 AND 0.04")
def f9_scatter_box(t):
    return t("lineitem").where(F.col("l_quantity").between(10, 12) & F.col("l_discount").between(0.02, 0.04)).select("l_orderkey").distinct()


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sqrt(power(sum(l_quantity-25),2) + power(sum(l_discount-0.05),2) + power(sum(l_tax-0.04),2)) > 40")
def f12_net_vector(t):
    square = lambda c, m: F.pow(F.sum(F.col(c) - m), F.lit(2))
    net = F.sqrt(square("l_quantity", 25) + square("l_discount", 0.05) + square("l_tax", 0.04))
    return t("lineitem").groupBy("l_orderkey").agg(net.alias("net")).where(F.col("net") > 40).select("l_orderkey")


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'P')")
def j2_active_view(t):
    removed = t("orders").where("o_orderstatus = 'P'")
    return t("lineitem").join(removed, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT DISTINCT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority IN ('1-URGENT','2-HIGH')")
def j9_tags_any(t):
    return t("customer").join(t("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT model_version_id FROM model_version_tags WHERE tag_id IN (1, 2) GROUP BY model_version_id HAVING count(DISTINCT tag_id) = 2")
def j10_tags_all(t):
    return t("model_version_tags").where(F.col("tag_id").isin(1, 2)).groupBy("model_version_id").agg(F.count_distinct("tag_id").alias("n")).where("n = 2").select("model_version_id")


@query("SELECT DISTINCT m.id FROM model_versions m WHERE m.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM model_version_tags x WHERE x.model_version_id = m.id AND x.tag_id = 1)")
def j11_tags_none(t):
    tagged = t("model_version_tags").where("tag_id = 1").select(F.col("model_version_id").alias("id"))
    return t("model_versions").where("id IS NOT NULL").join(tagged, "id", "left_anti").select("id").distinct()


@query("SELECT t.f AS target, min(abs(p.x - t.f)) AS dist FROM (VALUES (CAST(0.0 AS DOUBLE)), (CAST(0.055 AS DOUBLE)), (CAST(0.5 AS DOUBLE))) AS t(f) CROSS JOIN (SELECT DISTINCT l_discount AS x FROM lineitem) p GROUP BY t.f")
def j16_nearest_target(t):
    targets = F.array(*(F.lit(x) for x in (0.0, 0.055, 0.5)))
    return t("lineitem").select("l_discount").distinct().withColumn("target", F.explode(targets)).groupBy("target").agg(F.min(F.abs(F.col("l_discount") - F.col("target"))).alias("dist"))


@query("SELECT l_returnflag, round(sqrt(avg(power(l_extendedprice - l_quantity*p_retailprice, 2))), 4) AS rmse FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag")
def a1_rmse(t):
    return _pairs(t).groupBy("l_returnflag").agg(F.round(F.sqrt(F.avg(F.pow(_error(), F.lit(2)))), 4).alias("rmse"))


@query("SELECT l_orderkey, max(round(abs(l_extendedprice - l_quantity*p_retailprice), 4)) AS err FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey ORDER BY err DESC, l_orderkey LIMIT 10")
def a2_top_error(t):
    return _pairs(t).groupBy("l_orderkey").agg(F.max(F.round(F.abs(_error()), 4)).alias("err")).orderBy(F.desc("err"), "l_orderkey").limit(10)


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 3")
def a3_completer(t):
    return t("part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(3)


@query("SELECT l_orderkey, count(CASE WHEN l_returnflag='A' THEN 1 END) AS a, count(CASE WHEN l_returnflag='N' THEN 1 END) AS n, count(CASE WHEN l_returnflag='R' THEN 1 END) AS r FROM lineitem GROUP BY l_orderkey")
def a4_element_pivot(t):
    return t("lineitem").groupBy("l_orderkey").agg(*(F.count_if(F.col("l_returnflag") == e).alias(e.lower()) for e in "ANR"))


@query("SELECT l_returnflag, bin, count(*) AS n FROM (SELECT l_returnflag, CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin FROM lineitem CROSS JOIN (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) m) t GROUP BY l_returnflag, bin")
def a5_distribution(t):
    x, edges = t("lineitem"), t("lineitem").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    place = F.least(F.floor((F.col("l_extendedprice") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 20)), F.lit(19)).cast("int")
    return x.join(F.broadcast(edges)).groupBy("l_returnflag", place.alias("bin")).agg(F.count("*").alias("n"))  # one row of edges


@query("SELECT event_type, count(*) AS total, min(value) AS mn, max(value) AS mx, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def a5_stats(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("total"), F.min("value").alias("mn"), F.max("value").alias("mx"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query("SELECT b, count(*) AS n FROM (SELECT CASE WHEN f < 0.05 THEN 0 WHEN f < 0.20 THEN 1 WHEN f < 0.40 THEN 2 WHEN f < 0.60 THEN 3 WHEN f < 0.80 THEN 4 WHEN f < 0.95 THEN 5 ELSE 6 END AS b FROM (SELECT CAST(count(CASE WHEN l_returnflag='R' THEN 1 END) AS DOUBLE) / count(*) AS f FROM lineitem GROUP BY l_orderkey) s) t GROUP BY b")
def a8_composition_bins(t):
    b = sum(((F.col("frac_R") >= e).cast("int") for e in (0.05, 0.2, 0.4, 0.6, 0.8, 0.95)), F.lit(0))
    return _structures(t).groupBy(b.alias("b")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(nullif(trim(config_type), ''), 'missing') AS label, count(DISTINCT record_id) AS n FROM audit_records GROUP BY 1")
def a9_config_types(t):
    label = F.coalesce(F.nullif(F.trim("config_type"), F.lit("")), F.lit("missing"))
    return t("audit_records").groupBy(label.alias("label")).agg(F.count_distinct("record_id").alias("n"))


@query("SELECT a // g AS a, n // g AS n, r // g AS r, count(*) AS structures FROM (SELECT *, gcd(gcd(a, n), r) AS g FROM (SELECT count(CASE WHEN l_returnflag='A' THEN 1 END) AS a, count(CASE WHEN l_returnflag='N' THEN 1 END) AS n, count(CASE WHEN l_returnflag='R' THEN 1 END) AS r FROM lineitem GROUP BY l_orderkey) c) d GROUP BY 1, 2, 3")
def a10_inventory(t):
    counts = a4_element_pivot(t)
    g = gcd_of(F.array("a", "n", "r"))
    return counts.withColumn("g", g).groupBy(*((F.col(c) / F.col("g")).cast("bigint").alias(c) for c in "anr")).agg(F.count("*").alias("structures"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT quantile_cont(o_totalprice, 0.95) FROM orders)")
def a13_tail(t):
    limit = exact_quantile(t("orders"), "o_totalprice", 0.95)
    return t("orders").where(F.col("o_totalprice") > limit).select("o_orderkey", "o_totalprice")


@query("SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def a15_duplicates(t):
    return t("documents").groupBy("text").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("first_id", "n")


@query("SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1 AND min(source) <> max(source)")
def a16_conflicts(t):
    return t("documents").groupBy("text").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.min("source").alias("lo"), F.max("source").alias("hi")).where("n > 1 AND lo <> hi").select("first_id", "n")


@query("SELECT p.id AS project_id, count(DISTINCT m.id) AS n FROM (SELECT DISTINCT id FROM projects) p LEFT JOIN model_versions m ON m.project_id = p.id GROUP BY p.id")
def a21_project_counts(t):
    m = t("model_versions").select(F.col("id").alias("mid"), "project_id").distinct().groupBy("project_id").agg(F.count("mid").alias("n"))
    p = t("projects").select(F.col("id").alias("project_id")).distinct()
    return p.join(m, "project_id", "left").select("project_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT nb, count(*) AS n FROM (SELECT a.event_id, count(b.event_id) AS nb FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND b.ts BETWEEN a.ts - INTERVAL '30' SECOND AND a.ts + INTERVAL '30' SECOND GROUP BY a.event_id) t GROUP BY nb")
def j7_range_neighbours(t):
    # a range frame over time counts neighbours without joining pairs; a user's time is cut into hours, so that no
    # user is one task, and rows near an hour's end stand in the next hour's frame as well
    reach, hour = 30_000_000, 3_600_000_000
    e = t("events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    slots = F.array_distinct(F.array(*(F.floor((F.col("us") + s) / hour) for s in (-reach, 0, reach))))
    e = e.withColumn("own", F.floor(F.col("us") / hour)).withColumn("slot", F.explode(slots))
    w = Window.partitionBy("user_id", "slot").orderBy("us").rangeBetween(-reach, reach)
    counted = e.withColumn("nb", F.count("*").over(w) - 1).where("slot = own")
    return counted.groupBy("nb").agg(F.count("*").alias("n"))


@query("SELECT i, j FROM (SELECT a.p_partkey AS i, b.p_partkey AS j, row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(a.p_retailprice - b.p_retailprice), b.p_partkey) AS rk FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey) t WHERE rk <= 2")
def j8_knn(t):
    # the nearest lie among the two prices below, the own, and the two above, and of equal ones the three smallest keys
    by = ["p_brand", "p_size"]
    p = t("part").select("p_partkey", *by, "p_retailprice")
    prices = p.groupBy(*by, "p_retailprice").agg(F.slice(F.array_sort(F.collect_set("p_partkey")), 1, 3).alias("keys"))
    here = F.struct("p_retailprice", "keys")
    w = Window.partitionBy(*by).orderBy("p_retailprice")
    around = prices.withColumn("near", F.array_compact(F.array(here, *(f(here, n).over(w) for f in (F.lag, F.lead) for n in (1, 2)))))
    close = p.join(around.drop("keys"), [*by, "p_retailprice"])
    options = F.flatten(F.transform("near", lambda g: F.transform(g["keys"], lambda k: F.struct(F.abs(g["p_retailprice"] - F.col("p_retailprice")).alias("d"), k.alias("j")))))
    best = F.slice(F.array_sort(F.filter(options, lambda o: o["j"] != F.col("p_partkey"))), 1, 2)
    return close.select(F.col("p_partkey").alias("i"), F.explode(best).alias("b")).select("i", "b.j")


@query("SELECT id FROM (SELECT o_custkey AS id FROM orders WHERE o_totalprice > 400000 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000) t EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def u2_selection_algebra(t):
    c = t("customer")
    picked = t("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id")).union(c.where("c_acctbal > 9000").select("c_custkey"))
    return picked.subtract(c.where("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def u8_scope_intersect(t):
    o = t("orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("SELECT o_orderkey, round(o_totalprice - shift, 2) AS energy FROM orders JOIN (SELECT l_orderkey, count(CASE WHEN l_returnflag='A' THEN 1 END)*10.0 + count(CASE WHEN l_returnflag='N' THEN 1 END)*20.0 + count(CASE WHEN l_returnflag='R' THEN 1 END)*30.0 AS shift FROM lineitem GROUP BY l_orderkey) s ON l_orderkey = o_orderkey")
def e1_baseline_shift(t):
    shift = F.col("a") * 10.0 + F.col("n") * 20.0 + F.col("r") * 30.0
    return t("orders").join(a4_element_pivot(t), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.round(F.col("o_totalprice") - shift, 2).alias("energy"))


@query("SELECT n_nationkey * 6 + ia * 3 + ic AS atom_id, n_nationkey, ia, ic FROM nation CROSS JOIN (VALUES (0),(1)) AS a(ia) CROSS JOIN (VALUES (0),(1),(2)) AS c(ic)")
def c7_supercell(t):
    return supercell(t("nation").select("n_nationkey"), 2, 1, 3).select((F.col("n_nationkey") * 6 + F.col("ia") * 3 + F.col("ic")).alias("atom_id"), "n_nationkey", "ia", "ic")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1) AND o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 5")
def d1_search_models(t):
    inside = t("customer").join(t("nation").where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"))
    return t("orders").where("o_orderstatus = 'F'").join(inside, F.col("o_custkey") == F.col("c_custkey"), "left_semi").orderBy("o_orderdate", "o_orderkey").offset(5).limit(20).select("o_orderkey")


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(lower(p_name), ' '))), '|') AS tags FROM part")
def p17_config_tags(t):
    return t("part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.split(F.lower("p_name"), " "))), "|").alias("tags"))


@query("SELECT DISTINCT o_orderpriority, ('0x' || substr(sha1(o_orderpriority), 1, 8))::BIGINT % 1000003 AS config_id FROM orders")
def p18_config_id(t):
    return t("orders").select("o_orderpriority").distinct().withColumn("config_id", F.conv(F.substring(F.sha1("o_orderpriority"), 1, 8), 16, 10).cast("bigint") % 1000003)


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '-' ORDER BY l_returnflag) AS element_set FROM lineitem GROUP BY l_orderkey")
def p20_element_set(t):
    return _structures(t).select("l_orderkey", F.array_join("elements", "-").alias("element_set"))


@query("SELECT a.vec_id AS i, b.vec_id AS j, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS d FROM embeddings a, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 4) b")
def t11_distances(t):
    """Distances of all vectors to a stated set: the first four."""
    e = t("embeddings")
    few = e.orderBy("vec_id").limit(4).select(F.col("vec_id").alias("j"), F.col("embedding").alias("other"))
    return e.join(F.broadcast(few)).select(F.col("vec_id").alias("i"), "j", F.round(distance(F.col("embedding"), F.col("other")), 5).alias("d"))


@query("SELECT a.vec_id AS i, b.vec_id AS j, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS d FROM embeddings a, embeddings b")
def t11_all_distances(t):
    """Distances of all pairs of vectors."""
    return pairwise_distances(t("embeddings"), "vec_id", "embedding").withColumn("d", F.round("d", 5))


@query()
def t3_farthest_points(t):
    e = t("embeddings")
    return e.sparkSession.createDataFrame(list(enumerate(farthest_points(e, "vec_id", "embedding", 8))), "step int, vec_id bigint")


@query()
def t10_principal_variances(t):
    return principal_variances(t("embeddings"), "embedding", 5)


@query()
def t6_sqrt_quotas(t):
    sizes = {str(r["label"]): r["count"] for r in t("embeddings").groupBy("label").count().collect()}
    return t("embeddings").sparkSession.createDataFrame(sorted(sqrt_quotas(sizes, 100).items()), "label string, quota int")
