"""Queries of the structure operators over structures built from the test tables, with brute-force SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake import generators as G
from framelake.functions import structure as S
from framelake.operators import audit as A
from framelake.operators import catalog as C
from framelake.operators import distribution as D
from framelake.operators import energy as E
from framelake.operators import fields as X
from framelake.operators import magnetic as B
from framelake.operators import motifs as M
from framelake.operators import phases as P
from framelake.operators import quality as Q
from framelake.operators import vectors as V
from framelake.operators.energy import Baseline, apply_baseline, group_statistics
from framelake.operators.filters import Condition, FilterSpec, lattice_range
from framelake.operators.local_chemistry import CutoffProfile, chemistry_histograms, environments, pair_contacts
from framelake.operators.neighbors import cell_status, minimum_distances, nearest_neighbors, neighbor_pairs, with_short_pairs
from framelake.operators.selection import State, attach_rows, member, rows_of, sync
from framelake.plans.frames import DIRTY, PAIRS, SPECIES, SQL, dirty, frames
from framelake.plans.reference_queries import query_registry

QUERIES, ORACLE, query = query_registry()

PROFILE = CutoffProfile(tuple(SPECIES), (2.9, 3.0, 2.7, 3.0137, 2.8), (2.1, 2.3, 2.0, 2.6, 2.5))
_RADIAL = "[2.9, 3.0, 2.7, 3.0137, 2.8]"
_ANGULAR = "[2.1, 2.3, 2.0, 2.6, 2.5]"
_EL = "['H', 'C', 'O', 'Fe', 'Ni']"
_CUT = lambda v: f"(({v})[list_position({_EL}, ei)] + ({v})[list_position({_EL}, ej)]) / 2"
_PLAIN = f"WITH {SQL} "
_FULL = f"WITH {PAIRS} "
_COUNTS = "counts AS (SELECT sid, count(*) AS n, count(*) FILTER (WHERE el = 'H') AS h, count(*) FILTER (WHERE el = 'C') AS c, count(*) FILTER (WHERE el = 'O') AS o, count(*) FILTER (WHERE el = 'Fe') AS fe, count(*) FILTER (WHERE el = 'Ni') AS ni FROM atoms GROUP BY sid)"


@query(_PLAIN + f", {_COUNTS} SELECT sid AS structure_id, n AS natoms, concat(CASE WHEN c > 1 THEN 'C' || c WHEN c = 1 THEN 'C' ELSE '' END, CASE WHEN h > 1 THEN 'H' || h WHEN h = 1 THEN 'H' ELSE '' END, CASE WHEN o > 1 THEN 'O' || o WHEN o = 1 THEN 'O' ELSE '' END, CASE WHEN fe > 1 THEN 'Fe' || fe WHEN fe = 1 THEN 'Fe' ELSE '' END, CASE WHEN ni > 1 THEN 'Ni' || ni WHEN ni = 1 THEN 'Ni' ELSE '' END) AS formula FROM counts")
def s_p1_formula(t):
    return frames(t).where(F.size("species") > 0).select("structure_id", S.num_atoms(F.col("species")).alias("natoms"), S.formula(F.col("species")).alias("formula"))


@query(_PLAIN + ", k AS (SELECT sid, el, count(*) AS n FROM atoms GROUP BY sid, el) SELECT sid AS structure_id, string_agg(el || CASE WHEN n > 1 THEN '<sub>' || n || '</sub>' ELSE '' END, '' ORDER BY list_position(['C', 'H', 'O', 'Fe', 'Ni'], el)) AS html, string_agg(el, '-' ORDER BY el) AS element_set, string_agg(list_position(['H','He','Li','Be','B','C','N','O','F','Ne','Na','Mg','Al','Si','P','S','Cl','Ar','K','Ca','Sc','Ti','V','Cr','Mn','Fe','Co','Ni'], el)::VARCHAR, ',' ORDER BY el) AS numbers FROM k GROUP BY sid")
def s_p2_p3_elements(t):
    f = frames(t).where(F.size("species") > 0)
    e = S.elements(F.col("species"))
    return f.select("structure_id", S.html_formula(F.col("species")).alias("html"), S.element_set_key(F.col("species")).alias("element_set"), F.array_join(F.transform(S.numbers(e), lambda x: x.cast("string")), ",").alias("numbers"))


@query(_PLAIN + "SELECT sid AS structure_id, round(a * b * c, 6) AS volume, round(sqrt(t * t + b * b), 6) AS b, round(degrees(acos((b * t) / (sqrt(t * t + b * b) * sqrt(t * t + c * c)))), 6) AS alpha, round(degrees(acos(t / sqrt(t * t + b * b))), 6) AS gamma FROM cells")
def s_p4_p5_cell(t):
    lat = F.col("lattice")
    return frames(t).select("structure_id", F.round(S.volume(lat), 6).alias("volume"), F.round(S.lengths(lat)[1], 6).alias("b"), F.round(S.angles(lat)[0], 6).alias("alpha"), F.round(S.angles(lat)[2], 6).alias("gamma"))


@query(_PLAIN + ", n AS (SELECT c.sid, any_value(energy) AS energy, count(a.sid) AS n, any_value(c.a * c.b * c.c) AS v FROM cells c JOIN atoms a ON a.sid = c.sid GROUP BY c.sid) SELECT sid AS structure_id, round(energy / n, 8) AS per_atom, round(energy * 0.02 / n, 8) AS virial_yz, round(energy * 0.1 / v * 160.21766208, 8) AS stress_xx FROM n")
def s_p6_p8_p11_labels(t):
    n, f = F.size("species"), frames(t).where(F.size("species") > 0)
    v = S.virial_per_atom(F.col("virial"), n)
    return f.select("structure_id", F.round(S.per_atom(F.col("energy"), n), 8).alias("per_atom"), F.round(v[4], 8).alias("virial_yz"), F.round(S.stress_from_virial(v, n, S.volume(F.col("lattice")))[0], 8).alias("stress_xx"))


@query(_PLAIN + ", n AS (SELECT a.sid, sum([1.008, 12.011, 15.999, 55.845, 58.693][list_position(['H', 'C', 'O', 'Fe', 'Ni'], el)]) AS m, any_value(a.a * a.b * a.c) AS v FROM atoms a GROUP BY a.sid) SELECT sid AS structure_id, round(m / v * 1.66053906660, 8) AS density FROM n")
def s_p13_density(t):
    return frames(t).where(F.size("species") > 0).select("structure_id", F.round(S.density(F.col("species"), S.volume(F.col("lattice"))), 8).alias("density"))


_INSPECT = (
    _PLAIN
    + """, near AS (SELECT p.sid, min(sqrt(power(q.x - p.x + s.i * p.a + s.j * p.t, 2) + power(q.y - p.y + s.j * p.b + s.k * p.t, 2) + power(q.z - p.z + s.k * p.c, 2))) AS d
    FROM atoms p JOIN atoms q ON p.sid = q.sid AND p.k < q.k CROSS JOIN (SELECT i, j, k FROM (VALUES (-2), (-1), (0), (1), (2)) p(i), (VALUES (-2), (-1), (0), (1), (2)) q(j), (VALUES (-2), (-1), (0), (1), (2)) s(k)) s
    WHERE (s.i = 0 OR p.px) AND (s.j = 0 OR p.py) AND (s.k = 0 OR p.pz) GROUP BY p.sid)"""
)


@query(_INSPECT + ", f AS (SELECT sid, count(*) AS n, max(sqrt(fx*fx + fy*fy + fz*fz)) AS mx, sqrt(avg(fx*fx + fy*fy + fz*fz)) AS rms, sqrt(power(sum(fx), 2) + power(sum(fy), 2) + power(sum(fz), 2)) AS net FROM atoms GROUP BY sid) SELECT f.sid AS structure_id, n AS natoms, round(mx, 6) AS max_force, round(rms, 6) AS rms_force, round(net, 6) AS net_force, round(d, 6) AS shortest_pair FROM f LEFT JOIN near USING (sid)")
def s_p14_inspection(t):
    f = frames(t).where(F.size("species") > 0)
    return Q.inspect(f).select("structure_id", "natoms", *(F.round(c, 6).alias(c) for c in ("max_force", "rms_force", "net_force", "shortest_pair")))


@query(_PLAIN + f", {_COUNTS} SELECT a.sid AS structure_id, n AS natoms, round(max(sqrt(fx*fx + fy*fy + fz*fz)), 6) AS max_force, round(sqrt(0.01 + 0.04 + 0.09 + 0.0001 + 0.0004 + 0.0009) * abs(any_value(energy)), 6) AS virial_norm, any_value(fe) AS fe FROM atoms a JOIN counts USING (sid) JOIN (SELECT sid, energy FROM cells) e ON e.sid = a.sid GROUP BY a.sid, n")
def s_p15_records(t):
    r = A.audit_records(frames(t).where(F.size("species") > 0))
    return r.select("structure_id", "natoms", F.round("max_force", 6).alias("max_force"), F.round("virial_norm", 6).alias("virial_norm"), F.coalesce(F.try_element_at("composition", F.lit("Fe")), F.lit(0)).alias("fe"))


@query(_PLAIN + "SELECT sid AS structure_id, k, round(f2, 9) AS fb, round(f3, 9) AS fc FROM lines")
def s_p21_fractional(t):
    f = frames(t).select("structure_id", F.posexplode(S.fractional(F.col("pos"), F.col("lattice"))).alias("k", "f"))
    return f.select("structure_id", "k", F.round(F.col("f")[1], 9).alias("fb"), F.round(F.col("f")[2], 9).alias("fc"))


@query("SELECT p_partkey, CASE WHEN list_contains(tags, 'x1') THEN array_to_string(tags, '|') ELSE array_to_string(list_append(tags, 'x1'), '|') END AS tags, CASE WHEN p_name = '' THEN 0 ELSE ('0x' || substr(sha1(p_name), 1, 8))::BIGINT % 1000003 END AS config_id FROM (SELECT *, list_filter(string_split(replace(p_name, '\"', ''), ' '), lambda x: x <> '') AS tags FROM part) t")
def s_p17_tags(t):
    return t("part").select("p_partkey", S.append_tag(F.col("p_name"), "x 1").alias("tags"), S.config_id(F.col("p_name")).alias("config_id"))


@query(_PLAIN + f", {_COUNTS} SELECT c.sid AS structure_id FROM cells c LEFT JOIN counts n ON n.sid = c.sid WHERE (contains(lower(tag), 'bulk') OR coalesce(fe, 0) > 0) AND coalesce(h, 0) = 0")
def s_f1_specification(t):
    f = frames(t)
    cols = {"config_type": F.col("config_type"), "elements": S.elements(F.col("species"))}
    either = FilterSpec((Condition("config_type", ("Bulk",)), Condition("element_required", ("fe",)), Condition("formula", ("x",), enabled=False)), "any").compile(cols)
    return f.where(either & FilterSpec((Condition("element_excluded", ("H",)),)).compile(cols)).select("structure_id")


@query(_PLAIN + "SELECT sid AS structure_id FROM cells WHERE a BETWEEN 4.5 - 1e-4 AND 6.0 + 1e-4 AND c BETWEEN 0 AND 5 AND degrees(acos(t / sqrt(t * t + b * b))) BETWEEN 85 AND 90.0001 AND sqrt(t * t + c * c) <= 5 + 1e-4")
def s_f10_lattice_range(t):
    lat = F.col("lattice")
    return frames(t).where(lattice_range(S.lengths(lat), S.angles(lat), [4.5, 0, 0, 0, 0, 85], [6.0, 99, 5.0, 180, 180, 90.0])).select("structure_id")


@query(_FULL + "SELECT DISTINCT sid AS structure_id FROM pairs WHERE i <> j AND d < 0.7 * (ri + rj)")
def s_f11_nonphysical(t):
    return Q.nonphysical(frames(t), 0.7)


@query(_PLAIN + "SELECT sid AS structure_id, round(sqrt(power(sum(fx), 2) + power(sum(fy), 2) + power(sum(fz), 2)), 6) AS net FROM atoms GROUP BY sid HAVING sqrt(power(sum(fx), 2) + power(sum(fy), 2) + power(sum(fz), 2)) > 2")
def s_f12_unbalanced(t):
    return Q.unbalanced(frames(t), 2.0).withColumn("net", F.round("net", 6))


_LIMITS = Q.GeometryLimits(min_pair_distance=0.9, min_volume_per_atom=12.0, max_volume_per_atom=150.0, min_density=0.3, max_density=3.0)


@query(_FULL + ", n AS (SELECT c.sid, count(a.sid) AS n, any_value(c.a * c.b * c.c) AS v, sum([1.008, 12.011, 15.999, 55.845, 58.693][list_position(['H', 'C', 'O', 'Fe', 'Ni'], el)]) AS m FROM cells c LEFT JOIN atoms a ON a.sid = c.sid GROUP BY c.sid), s AS (SELECT DISTINCT sid FROM pairs WHERE i <> j AND d < 0.9) SELECT CASE WHEN n = 0 THEN 'empty' WHEN s.sid IS NOT NULL THEN 'pair_distance' WHEN v / n < 12 OR v / n > 150 THEN 'volume_per_atom' WHEN m / v * 1.66053906660 < 0.3 OR m / v * 1.66053906660 > 3.0 THEN 'density' ELSE 'kept' END AS reason, count(*) AS n FROM n LEFT JOIN s USING (sid) GROUP BY 1")
def s_f13_geometry_summary(t):
    return Q.geometry_summary(frames(t), _LIMITS)


@query(_FULL + ", n AS (SELECT a.sid, count(*) AS n, any_value(a.a * a.b * a.c) AS v, sum([1.008, 12.011, 15.999, 55.845, 58.693][list_position(['H', 'C', 'O', 'Fe', 'Ni'], el)]) AS m FROM atoms a GROUP BY a.sid) SELECT sid AS structure_id FROM n WHERE v / n >= 12 AND v / n <= 150 AND m / v * 1.66053906660 BETWEEN 0.3 AND 3.0 AND sid NOT IN (SELECT sid FROM pairs WHERE i <> j AND d < 0.9)")
def s_c38_geometry_filter(t):
    return Q.geometry_filter(frames(t), _LIMITS).select("structure_id")


@query(_FULL + "SELECT sid AS structure_id, count(*) AS pairs FROM pairs WHERE i < j AND d < 0.8 * (ri + rj) GROUP BY sid")
def s_g1_collisions(t):
    r = lambda c: S.lookup(dict(zip(SPECIES, (0.31, 0.76, 0.66, 1.32, 1.24))), F.col(c), "double")
    p = neighbor_pairs(frames(t), 3.0137).where(F.col("centre") < F.col("neighbour"))
    return p.where(F.col("distance") < 0.8 * (r("centre_species") + r("neighbour_species"))).groupBy("structure_id").agg(F.count("*").alias("pairs"))


@query(_PLAIN + """, d AS (SELECT p.sid, least(p.el, q.el) AS a, greatest(p.el, q.el) AS b, min(sqrt(power(q.x - p.x + s.i * p.a + s.j * p.t, 2) + power(q.y - p.y + s.j * p.b + s.k * p.t, 2) + power(q.z - p.z + s.k * p.c, 2))) AS d
    FROM atoms p JOIN atoms q ON p.sid = q.sid AND p.k < q.k CROSS JOIN (SELECT i, j, k FROM (VALUES (-2), (-1), (0), (1), (2)) p(i), (VALUES (-2), (-1), (0), (1), (2)) q(j), (VALUES (-2), (-1), (0), (1), (2)) s(k)) s
    WHERE (s.i = 0 OR p.px) AND (s.j = 0 OR p.py) AND (s.k = 0 OR p.pz) GROUP BY 1, 2, 3) SELECT sid AS structure_id, a, b, round(d, 6) AS distance FROM d""")
def s_g2_minimum_distances(t):
    return minimum_distances(frames(t)).withColumn("distance", F.round("distance", 6))


@query(_FULL + "SELECT sid AS structure_id, CAST(i AS INT) AS centre, CAST(j AS INT) AS neighbour, round(d, 6) AS distance FROM pairs")
def s_g3_j7_neighbours(t):
    return neighbor_pairs(frames(t), 3.0137).select("structure_id", "centre", "neighbour", F.round("distance", 6).alias("distance"))


@query(f"WITH {DIRTY} SELECT CASE WHEN sid % 131 = 0 AND px THEN 0 WHEN sid % 131 = 0 THEN 1 ELSE 3 END AS status, count(*) AS n FROM frames WHERE sid % 113 <> 0 AND sid % 127 <> 0 GROUP BY 1")
def s_g4_cell_status(t):
    f = dirty(t).where("structure_id < 10000000 AND size(pbc) = 3")
    return f.groupBy(cell_status(F.col("lattice"), F.col("pbc")).alias("status")).agg(F.count("*").alias("n"))


_RULES = """, base AS (SELECT *, len(species) AS n, (px AND sid % 131 = 0) OR (sid % 131 = 0 AND (sid % 113 = 0 OR sid % 127 = 0)) AS flat FROM frames),
    own AS (SELECT sid, n,
      n = 0 AS empty_structure, sid % 137 = 0 AND n > 0 AS nonfinite_geometry, sid % 127 = 0 AND sid % 113 <> 0 AS invalid_pbc, flat AS invalid_cell, sid % 139 = 0 AND n > 0 AS unknown_elements,
      (sid % 107 = 0 AND n > 0) OR sid % 109 = 0 AS invalid_label_shape, sid % 101 = 0 OR (sid % 109 <> 0 AND sid % 103 <> 0 AND energy IS NULL) AS nonfinite_labels FROM base),
    every AS (SELECT * FROM own UNION ALL SELECT sid + 10000000, n, empty_structure, nonfinite_geometry, invalid_pbc, invalid_cell, unknown_elements, invalid_label_shape, nonfinite_labels FROM own WHERE sid % 50 = 0)"""


@query(f"WITH {DIRTY} {_RULES} SELECT rule, count(*) AS n FROM (UNPIVOT (SELECT sid, empty_structure, nonfinite_geometry, invalid_pbc, invalid_cell, unknown_elements, invalid_label_shape, nonfinite_labels FROM every) ON empty_structure, nonfinite_geometry, invalid_pbc, invalid_cell, unknown_elements, invalid_label_shape, nonfinite_labels INTO NAME rule VALUE hit) u WHERE hit GROUP BY rule")
def s_a14_contracts(t):
    return Q.contracts(dirty(t)).select(F.explode("issues").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query(_FULL + "SELECT DISTINCT sid AS structure_id FROM pairs WHERE i <> j AND d <= 0.5")
def s_a14_short_distance(t):
    return Q.quality_issues(frames(t)).where("rule = 'short_distance'").select("structure_id")


@query(f"WITH {DIRTY} {_RULES}, ok AS (SELECT f.sid FROM frames f JOIN own USING (sid) WHERE NOT (nonfinite_geometry OR invalid_pbc OR invalid_cell OR unknown_elements) AND f.sid % 50 = 0), e AS (SELECT sid, sid % 3 AS m, sid % 101 = 0 OR sid % 103 = 0 AS without FROM ok), one AS (SELECT sid FROM e) SELECT sid AS structure_id, m <> 0 AND NOT without AS conflicting FROM e UNION ALL SELECT sid + 10000000, m <> 0 AND NOT without FROM e")
def s_a15_a16_duplicates(t):
    # structures without atoms of equal cells are repeats of each other as well; they are compared in the tests
    return Q.duplicate_geometries(Q.contracts(dirty(t).where(F.size("species") > 0))).select("structure_id", "conflicting")


ORACLE["s_a15_a16_duplicates"] = ORACLE["s_a15_a16_duplicates"].replace("WHERE NOT (nonfinite", "WHERE len(f.species) > 0 AND NOT (nonfinite")


_REDUCED = "list_reduce([h, n.c, o, fe, ni], lambda x, y: gcd(x, y))"


@query(_PLAIN + f", {_COUNTS}, g AS (SELECT n.*, {_REDUCED} AS g, nullif(trim(tag), '') AS tag FROM counts n JOIN cells USING (sid)), p AS (SELECT *, concat_ws('|', CASE WHEN c > 0 THEN 'C:' || c // g END, CASE WHEN fe > 0 THEN 'Fe:' || fe // g END, CASE WHEN h > 0 THEN 'H:' || h // g END, CASE WHEN ni > 0 THEN 'Ni:' || ni // g END, CASE WHEN o > 0 THEN 'O:' || o // g END) AS point FROM g) SELECT point, count(*) AS structures, round(count(*) / sum(count(*)) OVER (), 9) AS share, min(sid) AS first_id, count(*) FILTER (WHERE tag IS NULL) AS missing, count(DISTINCT n) AS sizes, count(DISTINCT tag) AS labels FROM p GROUP BY point")
def s_a10_inventory(t):
    i = A.inventory(A.audit_records(frames(t).where(F.size("species") > 0)))
    return i.select("point", "structures", F.round("share", 9).alias("share"), F.col("ids")[0].alias("first_id"), F.col("missing_config_type").alias("missing"), F.size("atom_counts").cast("bigint").alias("sizes"), F.coalesce(F.size("config_types"), F.lit(0)).cast("bigint").alias("labels"))


@query(_PLAIN + f", {_COUNTS}, f AS (UNPIVOT (SELECT sid, h / n AS H, c / n AS C, o / n AS O, fe / n AS Fe, ni / n AS Ni FROM counts) ON H, C, O, Fe, Ni INTO NAME element VALUE f), b AS (SELECT element, (f >= 0.05)::INT + (f >= 0.2)::INT + (f >= 0.4)::INT + (f >= 0.6)::INT + (f >= 0.8)::INT + (f >= 0.95)::INT AS bin, count(*) AS structures FROM f GROUP BY 1, 2) SELECT element, bin, structures, round(structures / total, 9) AS share, CASE WHEN structures / total < 0.03 THEN 'high' WHEN structures / total < 0.08 THEN 'medium' WHEN structures / total < 0.10 THEN 'low' END AS severity FROM b, (SELECT count(*) AS total FROM counts)")
def s_a8_composition_bins(t):
    return A.composition_bins(A.audit_records(frames(t).where(F.size("species") > 0))).select("element", "bin", "structures", F.round("share", 9).alias("share"), "severity")


@query(_PLAIN + "SELECT trim(tag) AS label, count(*) AS n FROM cells WHERE trim(tag) <> '' GROUP BY 1")
def s_a9_config_types(t):
    return A.config_types(frames(t))[0]


@query(_PLAIN + f", {_COUNTS}, f AS (SELECT round(fe / n, 12) AS f, lower(nullif(trim(tag), '')) AS tag FROM counts JOIN cells USING (sid)) SELECT p.x AS target, q.c AS config_type, count(*) FILTER (WHERE abs(f - p.x) <= 1e-8 AND tag = q.c) AS observed, count(*) FILTER (WHERE abs(f - p.x) <= 1e-8 AND tag IS NULL) AS missing FROM f, (VALUES (CAST(0.25 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.77 AS DOUBLE))) p(x), (VALUES ('bulk'), ('surface'), ('gas')) q(c) GROUP BY 1, 2")
def s_a11_target_support(t):
    out = A.target_support(A.audit_records(frames(t).where(F.size("species") > 0)), "Fe", [0.25, 0.5, 0.77], least=100, config_types=["bulk", "surface", "gas"])
    return out.select("target", "config_type", "observed", F.col("missing_config_type").alias("missing"))


@query(_PLAIN + ", v AS (SELECT sid, max(sqrt(fx*fx + fy*fy + fz*fz)) AS v FROM atoms GROUP BY sid), m AS (SELECT min(v) AS lo, max(v) AS hi FROM v) SELECT CAST(least(floor((v - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS structures, min(sid) AS first_id FROM v, m GROUP BY 1")
def s_a12_label_histogram(t):
    h = A.label_histograms(A.audit_records(frames(t).where(F.size("species") > 0)), ("max_force",))
    return h.select("bin", "structures", F.col("ids")[0].alias("first_id"))


@query(_PLAIN + ", v AS (SELECT sid, max(sqrt(fx*fx + fy*fy + fz*fz)) AS v FROM atoms GROUP BY sid) SELECT sid AS structure_id, round(v, 6) AS value FROM v WHERE v > (SELECT quantile_cont(v, 0.9) FROM v)")
def s_a13_label_tail(t):
    return A.label_tails(A.audit_records(frames(t).where(F.size("species") > 0)), {"max_force": 0.9}).select("structure_id", F.round("value", 6).alias("value"))


@query(f"WITH {PAIRS}, q AS (SELECT scope, sid, i, ei AS centre FROM (VALUES ('angular'), ('radial')) s(scope), (SELECT sid, k AS i, el AS ei FROM atoms) a), e AS (SELECT * FROM (SELECT 'radial' AS scope, * FROM pairs WHERE d < {_CUT(_RADIAL)}) UNION ALL SELECT 'angular', * FROM pairs WHERE d < {_CUT(_ANGULAR)}), n AS (SELECT q.scope, q.centre, q.sid, q.i, count(e.j) AS nb, count(e.j) FILTER (WHERE e.ej = 'Fe') AS fe FROM q LEFT JOIN e ON e.scope = q.scope AND e.sid = q.sid AND e.i = q.i GROUP BY 1, 2, 3, 4) SELECT scope, centre, 'neighbours' AS metric, CAST(nb AS INT) AS bin, count(*) AS environments, count(DISTINCT sid) AS structures FROM n GROUP BY 1, 2, 4 UNION ALL SELECT scope, centre, 'fraction:Fe', CAST(least(floor((fe / nb) * 10), 9) AS INT), count(*), count(DISTINCT sid) FROM n WHERE nb > 0 GROUP BY 1, 2, 4")
def s_a17_local_chemistry(t):
    h = chemistry_histograms(environments(frames(t), PROFILE), PROFILE).where("metric IN ('neighbours', 'fraction:Fe')")
    return h.select("scope", "centre", "metric", "bin", "environments", "structures")


@query(f"WITH {PAIRS}, {_COUNTS}, k AS (SELECT sid, el, count(*) AS m, any_value(n) AS n FROM atoms JOIN counts USING (sid) GROUP BY sid, el), el AS (SELECT unnest({_EL}) AS ei), two AS (SELECT x.ei, y.ei AS ej FROM el x JOIN el y ON list_position({_EL}, x.ei) <= list_position({_EL}, y.ei)), co AS (SELECT x.sid, two.ei, two.ej, x.m AS na, y.m AS nb, x.n FROM two JOIN k x ON x.el = two.ei JOIN k y ON y.el = two.ej AND y.sid = x.sid WHERE two.ei <> two.ej OR x.m >= 2), cut AS (SELECT *, {_CUT(_RADIAL)} AS cutoff FROM co), c AS (SELECT cut.sid, cut.ei, cut.ej, na, nb, n, count(*) FILTER (WHERE p.d < cutoff AND (cut.ei = cut.ej OR p.i <> p.j)) AS opp, count(*) FILTER (WHERE p.d < cutoff AND p.i <> p.j) AS apart, count(*) FILTER (WHERE p.d < cutoff AND p.i = p.j) AS self, count(*) FILTER (WHERE p.d < cutoff AND ((p.ei = cut.ei AND p.ej = cut.ej) OR (p.ei = cut.ej AND p.ej = cut.ei))) AS met FROM cut LEFT JOIN pairs p ON p.sid = cut.sid GROUP BY 1, 2, 3, 4, 5, 6) SELECT ei AS a, ej AS b, count(*) AS co_occurring, count(*) FILTER (WHERE met > 0) AS contact_structures, CAST(sum(met) AS BIGINT) AS contacts, CAST(sum(opp) AS BIGINT) AS opportunities, round(sum(CASE WHEN ei = ej THEN apart * na * (na - 1) / (n * (n - 1)) + self * na / n ELSE apart * 2.0 * na * nb / (n * (n - 1)) END), 6) AS expected FROM c GROUP BY 1, 2")
def s_a18_pair_contacts(t):
    p = pair_contacts(frames(t), PROFILE).where("scope = 'radial'")
    return p.select("a", "b", "co_occurring", "contact_structures", "contacts", "opportunities", F.round("expected", 6).alias("expected"))


def _metrics(t) -> DataFrame:
    """Energies per structure and forces per atom, predictions off by functions of the keys."""
    f = frames(t).where(F.size("species") > 0)
    e = f.select(F.lit("energy").alias("dataset"), "structure_id", F.lit(0).alias("row_no"), F.array(F.col("energy") + F.col("structure_id") % 7 * 0.25 - 0.5).alias("pred"), F.array("energy").alias("ref"))
    force = f.select(F.lit("force").alias("dataset"), "structure_id", F.posexplode("forces").alias("row_no", "ref"))
    return e.unionByName(force.select("dataset", "structure_id", "row_no", F.transform("ref", lambda x: x * 1.25).alias("pred"), "ref"))


def _structures(t) -> DataFrame:
    f = frames(t).where(F.size("species") > 0)
    return f.select("structure_id", "species", S.formula(F.col("species")).alias("formula"), "config_type", S.elements(F.col("species")).alias("elements"))


_FORCE = "v AS (SELECT sid, el, tag, unnest(['x', 'y', 'z', 'norm']) AS part, unnest([fx, fy, fz, sqrt(fx*fx + fy*fy + fz*fz)]) AS r, 0.25 * unnest([fx, fy, fz, sqrt(fx*fx + fy*fy + fz*fz)]) AS e FROM atoms JOIN (SELECT sid, tag FROM cells) c USING (sid))"


@query(_PLAIN + f", {_FORCE}, m AS (SELECT part, min(r) AS lo, max(r) AS hi FROM v GROUP BY part) SELECT 'force|' || part AS metric, el AS series, CAST(least(floor((r - lo) / ((hi - lo) / 40)), 39) AS INT) AS bin, count(*) AS n FROM v JOIN m USING (part) GROUP BY 1, 2, 3")
def s_a5_by_element(t):
    request = D.Request(fields=("force",), group="element", bins=40)
    return D.histogram(D.samples(_metrics(t), _structures(t), request), 40)


@query(_PLAIN + f", {_FORCE}, w AS (SELECT part, 'reference' AS series, r AS v FROM v UNION ALL SELECT part, 'error', CASE WHEN part = 'norm' THEN e ELSE r * 1.25 - r END FROM v), s AS (SELECT part, series, count(*) AS total, min(v) AS mn, max(v) AS mx, avg(v) AS mean, stddev_pop(v) AS std FROM w GROUP BY 1, 2) SELECT 'force|' || part AS metric, series, total, round(mn, 6) AS min, round(mx, 6) AS max, round(mean, 6) AS mean, round(std, 6) AS std FROM s")
def s_a5_by_view(t):
    request = D.Request(fields=("force",), group="value_view", views=("reference", "error"))
    return D.statistics(D.samples(_metrics(t), _structures(t), request)).select("metric", "series", "total", *(F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std")))


@query(_PLAIN + ", e AS (SELECT c.sid, energy, tag, max(CASE WHEN el = 'Fe' THEN 1 ELSE 0 END) AS fe FROM cells c JOIN atoms a ON a.sid = c.sid GROUP BY 1, 2, 3), g AS (SELECT sid, energy, 'iron' AS series FROM e WHERE fe = 1 UNION ALL SELECT sid, energy, 'solid' FROM e WHERE tag LIKE '%bulk%'), m AS (SELECT min(energy) AS lo, max(energy) AS hi FROM g) SELECT 'energy|value' AS metric, series, CAST(least(floor((energy - lo) / ((hi - lo) / 25)), 24) AS INT) AS bin, count(*) AS structures, min(sid) AS first_id FROM g, m GROUP BY 1, 2, 3")
def s_a6_custom_bins(t):
    own = {"iron": F.array_contains("elements", "Fe"), "solid": F.col("config_type").contains("bulk"), "none": F.lit(False)}
    request = D.Request(fields=("energy",), group="custom", bins=25, custom=own)
    ids = D.bin_ids(D.samples(_metrics(t), _structures(t), request), 25)
    return ids.select("metric", "series", "bin", F.size("ids").cast("bigint").alias("structures"), F.col("ids")[0].alias("first_id"))


@query("SELECT * FROM (VALUES ('energy', 1, 'scalar', TRUE), ('force', 3, 'vector3', TRUE)) t(dataset, components, shape, paired)")
def s_a7_fields(t):
    return D.discover(_metrics(t))


@query(_PLAIN + f", {_FORCE}, s AS (SELECT count(*) AS n, avg(r) AS m, stddev_samp(r) AS sd, min(r) AS lo, max(r) AS hi FROM v WHERE part = 'z' AND el = 'Fe'), g AS (SELECT lo + p * (hi - lo) / 63 AS x, p FROM s, range(64) t(p)) SELECT CAST(p AS INT) AS point, round(x, 6) AS x, round(sum(exp(-0.5 * power((x - r) / (sd * power(n, -0.2)), 2)) / (sd * power(n, -0.2) * sqrt(2 * pi()))) * (hi - lo) / 30 / n, 3) AS y FROM g, s, (SELECT r FROM v WHERE part = 'z' AND el = 'Fe') v GROUP BY p, x, hi, lo, n")
def s_a5_kde(t):
    request = D.Request(fields=("force",), group="element", series=("Fe",), bins=30, points=64)
    rows = D.samples(_metrics(t), _structures(t), request).where("metric = 'force|z'")
    n = rows.count()
    return D.curves(rows, request).select("point", F.round("x", 6).alias("x"), F.round(F.col("y") / n, 3).alias("y"))


@query(_PLAIN + "SELECT round(sqrt(avg(e * e)) * 1000, 4) AS rmse FROM (SELECT 0.25 * unnest([fx, fy, fz]) AS e FROM atoms)")
def s_a1_rmse(t):
    m = _metrics(t).where("dataset = 'force'")
    return A.rmse(m, F.col("pred"), F.col("ref"), scale=1000.0).select(F.round("rmse", 4).alias("rmse"))


@query(_PLAIN + "SELECT sid AS structure_id, round(max(0.25 * (abs(fx) + abs(fy) + abs(fz))), 6) AS error FROM atoms GROUP BY sid ORDER BY error DESC, structure_id LIMIT 20")
def s_a2_top_errors(t):
    m = _metrics(t).where("dataset = 'force'")
    error = F.round(F.aggregate(F.zip_with("pred", "ref", lambda p, r: F.abs(p - r)), F.lit(0.0), lambda a, x: a + x), 6)
    return A.top_errors(m, "structure_id", error, 20)


@query(_PLAIN + ", e AS (SELECT DISTINCT sid, el FROM atoms), x AS (SELECT 'element' AS kind, el AS token, sid FROM e UNION ALL SELECT DISTINCT 'tag', unnest(regexp_split_to_array(trim(tag), '[|\\s]+')), sid FROM cells WHERE trim(tag) <> '' AND sid IN (SELECT sid FROM e)) SELECT kind, token, structures FROM (SELECT kind, token, count(*) AS structures, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, token) AS r FROM x GROUP BY 1, 2) t WHERE r <= 3")
def s_a3_completions(t):
    r = A.audit_records(frames(t).where(F.size("species") > 0))
    return A.completions(r, 3).where("kind IN ('tag', 'element')")


@query("SELECT l_orderkey AS structure_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS row_no FROM lineitem")
def s_j3_positional_rows(t):
    counts = t("lineitem").groupBy(F.col("l_orderkey").alias("structure_id")).agg(F.count("*").alias("n"))
    total = t("lineitem").count()
    rows = t("lineitem").sparkSession.range(total).withColumnRenamed("id", "row")
    return attach_rows(counts, rows, F.col("n")).select("structure_id", "row_no")


@query(_PLAIN + "SELECT sid AS structure_id, CAST(k AS INT) AS row_no, CASE WHEN sid % 3 = 0 AND k = 0 THEN 1.5 ELSE round(fx, 9) END AS x FROM lines")
def s_j5_sync(t):
    m = _metrics(t).where("dataset = 'force'")
    new = m.where("structure_id % 3 = 0 AND row_no = 0").select("structure_id", "row_no", F.array(F.lit(1.5), F.lit(0.0), F.lit(0.0)).alias("ref"))
    return sync(m, new, "force").select("structure_id", "row_no", F.round(F.col("ref")[0], 9).alias("x"))


@query("SELECT o_orderkey AS structure_id FROM orders WHERE o_orderkey % 7 <> 0 AND NOT (o_totalprice > 100000 AND o_orderkey % 2 = 0) AND o_orderkey % 5 = 0")
def s_u1_u5_state(t):
    o = t("orders").select(F.col("o_orderkey").alias("structure_id"), "o_totalprice")
    ids = lambda c: o.where(c).select("structure_id")
    s = State(o).remove(ids("structure_id % 7 = 0")).remove(ids("structure_id % 11 = 0")).revoke()
    s = s.select(ids("structure_id % 5 = 0")).apply(ids("o_totalprice > 100000 AND structure_id % 2 = 0"), "remove").apply(ids("structure_id % 3 = 0"), "replace").undo_selection()
    return s.inverse().inverse().scope("selected")


@query("SELECT o_orderkey AS structure_id, o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 AS selected FROM orders")
def s_u3_f15_membership(t):
    o = t("orders").select(F.col("o_orderkey").alias("structure_id"))
    s = State(o).apply(o.where("structure_id % 5 = 0")).apply(o.where("structure_id % 2 = 0"), "intersect")
    return member(o, s.selected())


@query("SELECT count(*) AS n FROM lineitem WHERE l_orderkey % 3 = 0")
def s_j1_rows_of(t):
    ids = t("orders").select(F.col("o_orderkey").alias("structure_id")).where("structure_id % 3 = 0")
    lines = t("lineitem").select(F.col("l_orderkey").alias("structure_id"))
    return rows_of(lines, ids.union(ids)).agg(F.count("*").alias("n"))


_BASE = Baseline(["C", "Fe", "H", "Ni", "O"], {"bulk.*": [1.0, 2.0, 0.5, 3.0, 1.5], "surface": [0.0, 1.0, 0.0, 1.0, 0.0]}, {"surface": "surface"}, ["bulk.*", "("])


@query(_PLAIN + f", {_COUNTS} SELECT sid AS structure_id, CASE WHEN tag LIKE 'bulk%' THEN 'shifted' WHEN tag = 'surface' THEN 'shifted' ELSE 'no_group' END AS baseline, round(energy - CASE WHEN tag LIKE 'bulk%' THEN c + 2 * fe + 0.5 * h + 3 * ni + 1.5 * o WHEN tag = 'surface' THEN fe + ni ELSE 0 END, 6) AS energy FROM counts JOIN (SELECT sid, tag, energy FROM cells) e USING (sid)")
def s_e1_baseline(t):
    return apply_baseline(frames(t).where(F.size("species") > 0), _BASE).select("structure_id", "baseline", F.round("energy", 6).alias("energy"))


@query(_PLAIN + ", g AS (SELECT a.sid, el, energy, CASE WHEN tag LIKE 'bulk%' THEN 'bulk.*' ELSE tag END AS grp FROM atoms a JOIN (SELECT sid, energy, tag FROM cells) c ON c.sid = a.sid) SELECT grp AS \"group\", count(DISTINCT sid) AS structures, round(sum(energy) FILTER (WHERE TRUE) / sum(energy) * 1.0, 6) AS one, CAST(count(*) FILTER (WHERE el = 'Fe') AS DOUBLE) AS fe FROM g GROUP BY 1")
def s_a26_group_statistics(t):
    return group_statistics(frames(t).where(F.size("species") > 0), _BASE).select("group", "structures", F.lit(1.0).alias("one"), F.element_at("counts", "Fe").alias("fe"))


@query(_FULL + "SELECT CASE WHEN d < 1 THEN 'near' ELSE 'far' END AS k, count(*) AS n FROM pairs WHERE i <> j GROUP BY 1")
def s_j7_distance_classes(t):
    p = neighbor_pairs(frames(t), 3.0137).where("centre <> neighbour")
    return p.groupBy(F.when(F.col("distance") < 1, "near").otherwise("far").alias("k")).agg(F.count("*").alias("n"))


@query(_FULL + ", s AS (SELECT DISTINCT sid FROM pairs WHERE i <> j AND d < 0.4) SELECT count(*) AS structures, (SELECT count(*) FROM s) AS short FROM cells")
def s_g1_short_flags(t):
    f = with_short_pairs(frames(t), cutoff=0.4)
    return f.agg(F.count("*").alias("structures"), F.count_if(F.coalesce("short", F.lit(False))).alias("short"))



@query(f"WITH {PAIRS}, n AS (SELECT a.sid, a.k, any_value(a.el) AS el, count(p.j) AS n, string_agg(p.ej, ',' ORDER BY p.ej) AS around FROM atoms a LEFT JOIN pairs p ON p.sid = a.sid AND p.i = a.k AND p.d <= 2.4 GROUP BY 1, 2), c AS (SELECT sid, k, el, n, (SELECT coalesce(string_agg(e || m, ',' ORDER BY e), '') FROM (SELECT e, count(*) AS m FROM (SELECT unnest(string_split(around, ',')) AS e) u WHERE around IS NOT NULL GROUP BY e) v) AS text FROM n) SELECT el || '|' || text AS signature, count(*) AS n FROM c GROUP BY 1")
def s_x1_x2_motifs(t):
    return M.histogram(M.signatures(frames(t), "cutoff", 2.4)).select("signature", "n")


@query("SELECT p_brand, p_type, n, CAST(r AS INT) AS rank FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1, 2) t WHERE r <= 5")
def s_x4_contingency(t):
    return M.contingency(t("part"), "p_brand", "p_type")


@query("WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) SELECT round((SELECT sum(m) / sum(s) FROM (SELECT max(n) AS m, sum(n) AS s FROM c GROUP BY p_brand)), 9) AS a_to_b, round((SELECT sum(m) / sum(s) FROM (SELECT max(n) AS m, sum(n) AS s FROM c GROUP BY p_type)), 9) AS b_to_a")
def s_x4_purity(t):
    return M.purity(t("part"), "p_brand", "p_type").select(F.round("a_to_b", 9).alias("a_to_b"), F.round("b_to_a", 9).alias("b_to_a"))


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS b FROM lineitem) SELECT round(corr(a, b), 9) AS spearman, (SELECT round(corr(l_quantity, l_extendedprice), 9) FROM lineitem) AS pearson FROM r")
def s_x5_correlations(t):
    li = t("lineitem")
    row = (M.correlation(li, "l_quantity", "l_discount", "spearman"), M.correlation(li, "l_quantity", "l_extendedprice"))
    return li.sparkSession.createDataFrame([tuple(round(v, 9) for v in row)], "spearman double, pearson double")


@query("WITH p AS (SELECT l_returnflag AS k, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), q AS (SELECT l_returnflag AS k, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT coalesce(p.s, 0) AS p, coalesce(q.s, 0) AS q FROM p FULL JOIN q USING (k)) SELECT round((sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END)) / 2, 9) AS divergence FROM b")
def s_x5_divergence(t):
    one = lambda s: M.histogram(t("lineitem").where(F.col("l_linestatus") == s), "l_returnflag")
    return t("lineitem").sparkSession.createDataFrame([(round(M.divergence(one("O"), one("F"), "l_returnflag"), 9),)], "divergence double")


@query("SELECT a.vec_id, round(min(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS d FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 GROUP BY a.vec_id")
def s_j14_warm_start(t):
    e = t("embeddings")
    return V.nearest_distances(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding").select("vec_id", F.round("d", 5).alias("d"))


@query()
def s_t4_centered(t):
    e = t("embeddings")
    return e.sparkSession.createDataFrame(list(enumerate(V.centered_points(e, "vec_id", "embedding", 12))), "step int, vec_id bigint")


@query()
def s_t5_explained(t):
    e = t("embeddings")
    ids, share = V.explained_points(e, "vec_id", "embedding", 0.02)
    return e.sparkSession.createDataFrame([(i, k, share) for i, k in enumerate(ids)], "step int, vec_id bigint, share double")


@query()
def s_t7_balanced(t):
    return V.balanced_points(t("embeddings"), "vec_id", "embedding", "label", 30)


@query()
def s_a19_phases(t):
    f = frames(t).where(F.size("species") > 0).withColumn("symbols", A.symbols_key(F.col("species")))
    return P.phase_inventory(P.phase_evidence(f, keep=("symbols",)))


@query()
def s_a20_magnetic(t):
    f = frames(t).where(F.size("species") > 0).withColumn("spin", F.col("forces")).withColumn("symbols", A.symbols_key(F.col("species")))
    return B.magnetic_inventory(B.magnetic_evidence(f, keep=("symbols",)))


@query()
def s_g5_nearest(t):
    return nearest_neighbors(frames(t), 8).groupBy("rank").agg(F.count("*").alias("atoms"), F.round(F.avg("distance"), 6).alias("mean"))


@query("WITH RECURSIVE s AS (SELECT DISTINCT id FROM projects WHERE id = (SELECT min(parent_id) FROM projects WHERE parent_id > 0 AND parent_id IN (SELECT id FROM projects)) UNION SELECT p.id FROM projects p JOIN s ON p.parent_id = s.id) SELECT id FROM s")
def s_j12_subtree(t):
    p = t("projects")
    known = p.where("parent_id > 0").join(p.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return C.subtree(p, known.agg(F.min("parent_id")).first()[0])


@query("SELECT id FROM (SELECT DISTINCT id, name, notes, model_type, created_at FROM model_versions WHERE id IS NOT NULL AND upper(trim(model_type)) = 'NEP' AND id IN (SELECT model_version_id FROM model_version_tags WHERE tag_id IN (1, 2, 3)) AND id NOT IN (SELECT model_version_id FROM model_version_tags WHERE tag_id = 4 AND model_version_id IS NOT NULL)) t ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 20 OFFSET 3")
def s_d1_search(t):
    return C.search_models(t("model_versions"), links=t("model_version_tags"), model_type="nep", any_tags=[1, 2, 3], no_tags=[4], offset=3, limit=20).select("id")


@query("SELECT p.id AS project_id, count(DISTINCT m.id) AS models FROM (SELECT DISTINCT id FROM projects WHERE id IS NOT NULL) p LEFT JOIN model_versions m ON m.project_id = p.id GROUP BY p.id")
def s_a21_roll_up(t):
    return C.project_counts(t("projects"), t("model_versions")).select("project_id", "models")


@query(_PLAIN + ", g AS (SELECT unnest([-5.0::DOUBLE, 0.0::DOUBLE, 5.0::DOUBLE]) AS xy) SELECT c.sid AS structure_id, round(g.xy, 1) AS xy, round(a * b * c, 6) AS volume, round(b, 6) AS by FROM cells c, g WHERE c.sid IN (SELECT sid FROM atoms)")
def s_c4_shear(t):
    f = frames(t).where(F.size("species") > 0).withColumnRenamed("energy", "_e")
    out = G.apply(f, "shear_matrix", xy=(-5.0, 5.0, 5.0), yz=0.0, xz=0.0)
    return out.select("structure_id", ((F.col("variant") - 1) * 5.0).alias("xy"), F.round(S.volume(F.col("lattice")), 6).alias("volume"), F.round(F.col("lattice")[1][1] - F.col("lattice")[1][0] * (F.col("variant") - 1) * 0.05, 6).alias("by"))


@query(_PLAIN + ", n AS (SELECT sid, count(*) AS n FROM atoms GROUP BY sid) SELECT c.sid AS structure_id, n * 6 AS atoms, round(a * b * c * 6, 6) AS volume FROM cells c JOIN n USING (sid)")
def s_c7_supercell(t):
    out = G.apply(frames(t).where(F.size("species") > 0), "supercell", scale=[1, 2, 3])
    return out.select("structure_id", F.size("species").cast("bigint").alias("atoms"), F.round(S.volume(F.col("lattice")), 6).alias("volume"))


@query()
def s_c40_pipeline(t):
    steps = [{"name": "supercell", "params": {"scale": [2, 1, 1]}}, {"group": [{"name": "vacancy_defect", "params": {"samples": 2}}, {"name": "perturb", "params": {"count": 1}}], "filter": {"name": "geometry_filter", "params": {"min_pair_distance": 0.5}}}]
    out = G.pipeline(frames(t).where(F.size("species") > 1), steps)
    return out.groupBy("config_type").agg(F.count("*").alias("n"))


@query()
def s_e2_fit_baseline(t):
    f = frames(t).where(F.size("species") > 0)
    b = E.fit_baseline(f, mode="zero", patterns=["bulk.*"], method="exact")
    return f.sparkSession.createDataFrame([(g, e, round(v, 6)) for g, ref in b.group_to_ref.items() for e, v in zip(b.elements, ref)], "config_group string, element string, reference double")


@query("SELECT o_orderkey AS structure_id FROM orders WHERE o_totalprice > 100000")
def s_k3_export_scope(t):
    o = t("orders").select(F.col("o_orderkey").alias("structure_id"), "o_totalprice")
    return State(o).remove(o.where("o_totalprice <= 100000").select("structure_id")).scope("active")


@query(_PLAIN + f", {_COUNTS}, m AS (SELECT sid, max(0.25 * sqrt(fx*fx + fy*fy + fz*fz)) AS e, max(abs(fx)) AS x FROM atoms GROUP BY sid) SELECT c.sid AS structure_id FROM cells c JOIN counts n ON n.sid = c.sid JOIN m ON m.sid = c.sid WHERE (e > 0.2 AND fe / n.n >= 0.25 AND NOT (x < 0.1)) OR (c.sid % 7 * 0.25 - 0.5 > 0.9 AND a * b * c.c < 110 AND h = 0)")
def s_f7_fields(t):
    f = frames(t).where(F.size("species") > 0)
    text = "(force.err.norm > 0.2 && frac.Fe >= 0.25 AND !(force.x < 0.1)) or energy.err > 0.9 and volume < 110 and not has.H"
    return X.select(f, text, _metrics(t)).select("structure_id")
