"""ANSI SQL twins of the catalog queries, over the same tables."""

from __future__ import annotations

from .. import constants as C

# --- shared relations -------------------------------------------------------------

GRID = """
raw AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
g AS (SELECT vec_id, label, 50.0 + 5 * (i - 1) AS mz, abs(v) AS it, max(abs(v)) OVER (PARTITION BY vec_id) AS top FROM raw),
f AS (SELECT vec_id, label, mz, it / sum(it) OVER (PARTITION BY vec_id) AS p FROM g WHERE it >= top * 0.01 AND it > 0),
meta AS (SELECT vec_id, label, 600.0 + (vec_id * 37) % 1000 AS ri, 'COMPOUND-' || lpad(CAST(label AS VARCHAR), 5, '0') AS prefix,
         'COMPOUND-' || lpad(CAST(label AS VARCHAR), 5, '0') || '-' || CAST(vec_id % 7 AS VARCHAR) AS inchikey FROM embeddings)
"""


def values(rows):
    return ", ".join(f"({i}, {float(e)!r}, '{fm}', '{cl}')" for i, (_, e, fm, cl) in enumerate(rows))


def derived(losses=None):
    """Detected losses, reference mass and the three difference spectra of the grid."""
    rows = values(losses or C.CORE_LOSSES)
    return GRID + f""",
losses(idx, exact, formula, cls) AS (VALUES {rows}),
tops AS (SELECT vec_id, max(mz) AS mx FROM f GROUP BY 1),
found AS (SELECT f.vec_id, l.idx, l.formula, l.cls, f.mz + l.exact AS m, f.p FROM f JOIN tops t USING (vec_id), losses l
          WHERE abs(f.mz - t.mx) <= 50 AND f.p > 0.02 AND abs(f.mz + l.exact - t.mx) <= greatest((f.mz + l.exact) * 20e-6 * 3, 1)),
nf AS (SELECT vec_id, count(*) AS n, sum(p) AS s, max(m) AS m FROM found GROUP BY 1),
hi AS (SELECT f.vec_id, max(f.p) AS h FROM f JOIN tops t USING (vec_id) WHERE f.mz > t.mx - 50 GROUP BY 1),
mref AS (SELECT t.vec_id, greatest(t.mx, coalesce(nf.m, t.mx)) AS mref,
         0.4 * least(1, coalesce(nf.n, 0) / 3.0) + 0.4 * least(1, coalesce(nf.s, 0) / 0.05) + 0.2 * least(1, hi.h / 0.03) AS conf
         FROM tops t LEFT JOIN nf USING (vec_id) JOIN hi USING (vec_id)),
ranked AS (SELECT vec_id, mz, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, mz) AS rk FROM f),
anch0 AS (SELECT f.vec_id, m.mref - f.mz AS d, f.p FROM f JOIN mref m USING (vec_id) WHERE m.mref - f.mz BETWEEN 5 AND 350),
pair0 AS (SELECT a.vec_id, abs(a.mz - b.mz) AS d, least(a.p, b.p) AS p FROM ranked a JOIN ranked b ON a.vec_id = b.vec_id AND a.rk < b.rk
          WHERE b.rk <= 40 AND abs(a.mz - b.mz) BETWEEN 5 AND 350),
anch1 AS (SELECT vec_id, round(d, 3) AS mz, sum(p) AS it FROM anch0 GROUP BY 1, 2),
pair1 AS (SELECT vec_id, round(d, 3) AS mz, sum(p) AS it FROM pair0 GROUP BY 1, 2),
loss1 AS (SELECT vec_id, round(d, 3) AS mz, sum(p) AS it FROM (SELECT * FROM anch0 UNION ALL SELECT * FROM pair0) GROUP BY 1, 2),
anch AS (SELECT vec_id, mz, it / sum(it) OVER (PARTITION BY vec_id) AS p FROM anch1),
pairw AS (SELECT vec_id, mz, it / sum(it) OVER (PARTITION BY vec_id) AS p FROM pair1),
loss AS (SELECT vec_id, mz, it / sum(it) OVER (PARTITION BY vec_id) AS p FROM loss1)
"""


def typical(channel="loss", losses=None, ppm=1200.0):
    return f"""
near AS (SELECT x.vec_id, x.mz, x.p, l.idx, row_number() OVER (PARTITION BY x.vec_id, x.mz ORDER BY abs(l.exact - x.mz), l.idx) AS rn
         FROM {channel} x, losses l WHERE abs(l.exact - x.mz) <= x.mz * {ppm} * 1e-6),
typ0 AS (SELECT n.vec_id, l.idx, l.formula, l.cls, l.exact, sum(n.p) AS it FROM near n JOIN losses l USING (idx) WHERE rn = 1 GROUP BY ALL),
typ AS (SELECT vec_id, idx, formula, cls, exact, it / sum(it) OVER (PARTITION BY vec_id) AS p FROM typ0)
"""


def pair_cosine(name, rel, self_pairs=False):
    """name(q, l, d): cosine distance of every ordered pair of relation rel(vec_id, mz, p)."""
    cond = "" if self_pairs else "AND a.vec_id <> b.vec_id"
    return f"""
{name}_n AS (SELECT vec_id, sqrt(sum(p * p)) AS s FROM {rel} GROUP BY 1),
{name}_d AS (SELECT a.vec_id AS q, b.vec_id AS l, sum(a.p * b.p) AS dot FROM {rel} a JOIN {rel} b ON a.mz = b.mz {cond} GROUP BY 1, 2),
{name} AS (SELECT q, l, 1 - dot / (x.s * y.s) AS d FROM {name}_d JOIN {name}_n x ON q = x.vec_id JOIN {name}_n y ON l = y.vec_id)
"""


def fuzzy_graph(n_neighbors: int, penalty: str = "1.0"):
    """Fuzzy union of the strengths that spectra give their nearest; scales by bisection; ``penalty`` as in ``density``."""
    return f"""WITH RECURSIVE {GRID}, {pair_cosine('d0', 'f')},
d AS (SELECT q, l, round(1 - (1 - greatest(0, least(1, round(d, 13)))) * {penalty}, 13) AS d FROM d0 JOIN meta a ON q = a.vec_id JOIN meta b ON l = b.vec_id),
nn AS (SELECT q, l, d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, l) AS rn FROM d) WHERE rn < {n_neighbors}),
rh AS (SELECT q, coalesce(min(d) FILTER (d > 0), 0) AS rho, avg(d) AS mean FROM nn GROUP BY 1),
gp AS (SELECT nn.q, l, greatest(d - rho, 0) AS gap, mean FROM nn JOIN rh ON nn.q = rh.q),
gl AS (SELECT q, list(gap) AS gaps, any_value(mean) AS mean FROM gp GROUP BY 1),
bis AS (SELECT q, gaps, mean, -20e0 AS lo, 20e0 AS hi, 0 AS step FROM gl
    UNION ALL SELECT q, gaps, mean, CASE WHEN over THEN lo ELSE (lo + hi) / 2 END, CASE WHEN over THEN (lo + hi) / 2 ELSE hi END, step + 1
    FROM (SELECT *, list_sum(list_transform(gaps, lambda x: exp(-x / pow(2e0, (lo + hi) / 2)))) > log2({n_neighbors}e0) AS over FROM bis WHERE step < 48)),
sc AS (SELECT q, greatest(pow(2e0, (lo + hi) / 2), 1e-3 * mean) AS scale FROM bis WHERE step = 48),
st AS (SELECT gp.q, l, exp(-gap / scale) AS w FROM gp JOIN sc ON gp.q = sc.q),
pr AS (SELECT least(q, l) AS x, greatest(q, l) AS y, sum(w) AS s, CASE WHEN count(*) > 1 THEN min(w) * max(w) ELSE 0 END AS m FROM st GROUP BY 1, 2)
SELECT x AS a, y AS b, {r6('s - m', 'weight')} FROM pr UNION ALL SELECT y, x, {r6('s - m', 'weight')} FROM pr"""


def density(eps: float, least: int, penalty: str = "1.0"):
    """Clusters of core spectra and their borders; ``penalty`` weighs the similarity of a and b (meta rows)."""
    return f"""WITH RECURSIVE {GRID}, {pair_cosine('d0', 'f')},
d AS (SELECT q, l, round(1 - (1 - greatest(0, least(1, d))) * {penalty}, 13) AS d FROM d0 JOIN meta a ON q = a.vec_id JOIN meta b ON l = b.vec_id),
near AS (SELECT q, l, d FROM d WHERE d <= {eps}),
core AS (SELECT vec_id AS id FROM meta LEFT JOIN near ON q = vec_id GROUP BY 1 HAVING count(l) + 1 >= {least}),
link AS (SELECT q, l FROM near WHERE q IN (SELECT id FROM core) AND l IN (SELECT id FROM core)),
reach AS (SELECT id AS a, id AS b FROM core UNION SELECT a, l FROM reach JOIN link ON b = q),
grp AS (SELECT a AS id, min(b) AS g FROM reach GROUP BY 1),
member AS (SELECT * FROM grp UNION ALL SELECT q, g FROM (SELECT q, l, row_number() OVER (PARTITION BY q ORDER BY d, l) AS r FROM near
    WHERE q NOT IN (SELECT id FROM core) AND l IN (SELECT id FROM core)) JOIN grp ON l = grp.id WHERE r = 1),
names AS (SELECT g, row_number() OVER (ORDER BY min(id)) AS n FROM member GROUP BY g)
SELECT vec_id AS id, coalesce(CAST(n AS VARCHAR), '0') AS cluster FROM meta LEFT JOIN member ON vec_id = member.id LEFT JOIN names USING (g)"""


COMBINED = pair_cosine("df", "f") + "," + pair_cosine("dl", "loss") + """,
dd AS (SELECT df.q, df.l, df.d AS d_frag, dl.d AS d_loss, sqrt(0.7 * df.d * df.d + 0.3 * dl.d * dl.d) AS d FROM df JOIN dl ON df.q = dl.q AND df.l = dl.l)
"""


def top_hits(k, rel="d"):
    return f"""
SELECT q AS query_id, CAST(rank AS BIGINT) AS rank, l AS library_id, round(d, 6) + 0.0 AS distance
FROM (SELECT q, l, d, row_number() OVER (PARTITION BY q ORDER BY d, l) AS rank FROM {rel}) WHERE rank <= {k}"""


def peaks_of(rel):
    return f"SELECT vec_id AS id, mz, round(p, 6) + 0.0 AS intensity FROM {rel}"


ORDER_PEAKS = """
op AS (SELECT l_orderkey AS id, 35 + l_partkey % 600 + l_linenumber / 1000.0 AS mz, l_quantity AS it FROM lineitem),
om AS (SELECT o_orderkey AS id, o_totalprice AS mz, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS rt,
       o_orderstatus AS mode, o_orderpriority AS adduct, CAST(o_orderkey % 40 AS DOUBLE) AS ce
       FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
"""

ION_AXIS = [39.0235, 41.0391, 43.0184, 43.0548, 44.0262, 44.0626, 45.0340, 55.0548, 57.0704, 58.0419, 61.0290, 68.0262,
            69.0704, 71.0861, 73.0474, 77.0391, 78.0470, 83.0861, 85.1017, 91.0548, 93.0704, 99.1174, 115.0943,
            136.1252, 147.0654, 161.1330, 204.1878]

IONS = f"""
axis(i, mz) AS (VALUES {', '.join(f'({i}, {m!r})' for i, m in enumerate(ION_AXIS))}),
ion0 AS (SELECT l_orderkey AS id, mz, sum(l_quantity) AS it FROM lineitem JOIN axis ON l_partkey % {len(ION_AXIS)} = i GROUP BY 1, 2),
ion1 AS (SELECT id, mz, it FROM (SELECT *, max(it) OVER (PARTITION BY id) AS top FROM ion0) WHERE it >= 0.01 * top),
ion AS (SELECT id, mz, it / sum(it) OVER (PARTITION BY id) AS p FROM ion1),
w AS (SELECT id, {', '.join(f'max(CASE WHEN mz = {m!r} THEN p ELSE 0 END) AS i{int(round(m * 1e4))}' for m in ION_AXIS)} FROM ion GROUP BY id)
"""

CLASS_RULES = """
cls0 AS (
 SELECT id, 1 AS o, 'alkane' AS c, i570704 AS k FROM w WHERE (i430548>.05)::INT+(i570704>.05)::INT+(i710861>.05)::INT+(i851017>.05)::INT+(i991174>.05)::INT >= 4
 UNION ALL SELECT id, 2, 'alkene', i410391 FROM w WHERE (i410391>.05)::INT+(i550548>.05)::INT+(i690704>.05)::INT+(i830861>.05)::INT >= 3 AND i410391 > .08
 UNION ALL SELECT id, 3, 'aromatic', greatest(i770391, i780470) FROM w WHERE i770391 > .03 OR i780470 > .05
 UNION ALL SELECT id, 4, 'alkylbenzene', i910548 FROM w WHERE i910548 > .08
 UNION ALL SELECT id, 5, 'monoterpene_HC', i930704 FROM w WHERE i930704 > .08 AND i1361252 > .02
 UNION ALL SELECT id, 6, 'sesquiterpene', i1611330 FROM w WHERE i1611330 > .03 AND i2041878 > .02
 UNION ALL SELECT id, 7, 'methyl_ketone', i430184 FROM w WHERE i430184 > .20 AND i580419 > .05
 UNION ALL SELECT id, 8, 'acetyl_compound', i430184 FROM w WHERE i430184 > .10 AND i430184 > i430548 * 1.5 AND NOT (i430184 > .20 AND i580419 > .05)
 UNION ALL SELECT id, 11, 'acetate_ester', i430184 FROM w WHERE i430184 > .15 AND i610290 > .03
 UNION ALL SELECT id, 13, 'furan', i680262 FROM w WHERE i680262 > .10 AND i390235 > .10),
cls AS (SELECT id, string_agg(c, ';' ORDER BY k DESC, o) AS label FROM
        (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC, o) AS rn FROM cls0) WHERE rn <= 3 GROUP BY id),
labelled AS (SELECT w.id, coalesce(cls.label, 'unclassified') AS label FROM w LEFT JOIN cls USING (id))
"""


def deriv_rule(lo="0.02", hi="0.08"):
    tms = f"(i730474 >= {lo} AND (i1470654 >= {lo} / 2 OR i730474 >= {hi}))"
    tbd = f"(i1150943 >= {lo} AND (i570704 >= {lo} / 2 OR i1150943 >= {hi}))"
    return (f"CASE WHEN {tms} AND (NOT {tbd} OR i730474 + 0.5 * i1470654 >= i1150943 + 0.2 * i570704) THEN 'TMS' "
            f"WHEN {tbd} THEN 'TBDMS' ELSE 'none' END")


TRUTH = """
tr AS (SELECT w.*, CASE o_orderstatus WHEN 'F' THEN 'TMS' WHEN 'O' THEN 'TBDMS' ELSE 'none' END AS t
       FROM w JOIN orders ON w.id = o_orderkey)
"""

FEATURES = """
wide AS (SELECT l_partkey AS k, sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN l_quantity END) AS blk,
         sum(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN l_quantity END) AS s1,
         sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN l_quantity END) AS s2,
         sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN l_quantity END) AS s3 FROM lineitem GROUP BY 1),
feat AS (SELECT p_partkey AS id, p_name || ' ' || p_brand AS name,
         CASE WHEN p_size % 3 > 0 THEN p_brand || '-' || p_type || '-' || CAST(p_size AS VARCHAR) END AS ikey,
         CASE WHEN p_size % 5 = 0 THEN '4' ELSE '1' END AS tag, blk, s1, s2, s3,
         (coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0)) / nullif((s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT, 0) AS mean
         FROM part LEFT JOIN wide ON p_partkey = k),
k1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY mean DESC, id) AS rn FROM feat WHERE tag <> '4' AND mean > 0) WHERE rn = 1),
k2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(ikey, 'p' || CAST(id AS VARCHAR)) ORDER BY mean DESC, id) AS rn2 FROM k1) WHERE rn2 = 1),
zf AS (SELECT id, tag, name, coalesce(blk, 0) AS bm, CASE WHEN s1 > coalesce(blk, 0) THEN s1 WHEN s1 <= coalesce(blk, 0) THEN 0 END AS s1,
       CASE WHEN s2 > coalesce(blk, 0) THEN s2 WHEN s2 <= coalesce(blk, 0) THEN 0 END AS s2,
       CASE WHEN s3 > coalesce(blk, 0) THEN s3 WHEN s3 <= coalesce(blk, 0) THEN 0 END AS s3 FROM feat)
"""

EVENTS = """
ev AS (SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS score, event_type = 'purchase' AS pos FROM events),
lists AS (SELECT user_id AS q, event_id AS l, CAST(floor(score / 5000.0) AS DOUBLE) AS d, pos AS rel FROM ev),
blk AS (SELECT q, d, count(*) AS n, sum(rel::INT) AS h FROM lists GROUP BY 1, 2),
runs AS (SELECT *, coalesce(sum(n) OVER w, 0) AS before, coalesce(sum(h) OVER w, 0) AS rel_before FROM blk
         WINDOW w AS (PARTITION BY q ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""

KEYED = pair_cosine("d0", "f") + """,
kp AS (SELECT q, l, d, x.prefix AS qk, y.prefix AS lk, x.inchikey AS qi, y.inchikey AS li, x.label AS ql, y.label AS ll, x.ri AS qri, y.ri AS lri
       FROM d0 JOIN meta x ON q = x.vec_id JOIN meta y ON l = y.vec_id)
"""


def r6(expr, name):
    return f"round({expr}, 6) + 0.0 AS {name}"


def msp_expected(where=""):
    return f"""WITH {ORDER_PEAKS},
        a AS (SELECT id, count(*) AS n, sum(it) AS s FROM op GROUP BY 1)
        SELECT 'order' || CAST(a.id AS VARCHAR) AS name, rt AS ri, mode AS ion_mode, 'Origin=' || adduct AS other_metadata,
        n AS declared, n AS parsed, {r6('s', 'total')}, CAST(0 AS BIGINT) AS issues FROM a JOIN om ON a.id = om.id {where}"""


def neighbours(body):
    return f"WITH {GRID}, {body} {top_hits(5)}"


def entropy_pairs(weighted):
    power = "CASE WHEN s.e < 3 THEN power(p, 0.25 + 0.25 * s.e) ELSE p END" if weighted else "p"
    return f"""
s AS (SELECT vec_id, -sum(p * ln(p)) AS e FROM f GROUP BY 1),
w0 AS (SELECT f.vec_id, mz, {power} AS p FROM f JOIN s USING (vec_id)),
w AS (SELECT vec_id, mz, p / sum(p) OVER (PARTITION BY vec_id) AS p FROM w0),
d AS (SELECT a.vec_id AS q, b.vec_id AS l,
      least(greatest(1 - sum((a.p + b.p) * ln(a.p + b.p) - a.p * ln(a.p) - b.p * ln(b.p)) / (2 * ln(2)), 0), 1) AS d
      FROM w a JOIN w b ON a.mz = b.mz AND a.vec_id <> b.vec_id GROUP BY 1, 2)"""


COMPOSITE = """
w AS (SELECT vec_id, mz, p, power(mz, 3) * sqrt(p) AS w FROM f),
n AS (SELECT vec_id, sqrt(sum(w * w)) AS s, count(*) AS nx FROM w GROUP BY 1),
j AS (SELECT a.vec_id AS q, b.vec_id AS l, a.w * b.w AS ww, a.p AS p1, b.p AS p2,
      lead(a.p) OVER o AS p1n, lead(b.p) OVER o AS p2n
      FROM w a JOIN w b ON a.mz = b.mz AND a.vec_id <> b.vec_id WINDOW o AS (PARTITION BY a.vec_id, b.vec_id ORDER BY a.mz)),
k AS (SELECT q, l, sum(ww) AS dot, count(*) AS nxy, avg(least(p1 / p1n, p2 / p2n) / greatest(p1 / p1n, p2 / p2n)) AS sr FROM j GROUP BY 1, 2),
d AS (SELECT q, l, 1 - least(greatest(CASE WHEN nxy < 2 THEN dot / (x.s * y.s) ELSE (x.nx * dot / (x.s * y.s) + nxy * sr) / (x.nx + nxy) END, 0), 1) AS d
      FROM k JOIN n x ON q = x.vec_id JOIN n y ON l = y.vec_id)"""

OVERLAP = """
d AS (SELECT a.vec_id AS q, b.vec_id AS l, 1 - sum(least(a.p, b.p)) AS d FROM f a JOIN f b ON a.mz = b.mz AND a.vec_id <> b.vec_id GROUP BY 1, 2)"""

HELLINGER = """
d AS (SELECT a.vec_id AS q, b.vec_id AS l, sqrt(greatest(1 - sum(sqrt(a.p) * sqrt(b.p)), 0)) AS d
      FROM f a JOIN f b ON a.mz = b.mz AND a.vec_id <> b.vec_id GROUP BY 1, 2)"""

WASSERSTEIN = """
full0 AS (SELECT g.vec_id, g.mz, coalesce(f.p, 0) AS p FROM g LEFT JOIN f ON g.vec_id = f.vec_id AND g.mz = f.mz),
cum AS (SELECT vec_id, mz, sum(p) OVER (PARTITION BY vec_id ORDER BY mz ROWS UNBOUNDED PRECEDING) AS c FROM full0),
ends AS (SELECT vec_id, min(mz) AS lo, max(mz) AS hi FROM f GROUP BY 1),
d AS (SELECT a.vec_id AS q, b.vec_id AS l, sum(abs(a.c - b.c)) * 5 / (greatest(max(x.hi), max(y.hi)) - least(min(x.lo), min(y.lo))) AS d
      FROM cum a JOIN cum b ON a.mz = b.mz AND a.vec_id <> b.vec_id JOIN ends x ON a.vec_id = x.vec_id JOIN ends y ON b.vec_id = y.vec_id GROUP BY 1, 2)"""

WCOS = """
w AS (SELECT vec_id, mz, power(mz, 3) * sqrt(p) AS p FROM f),""" + pair_cosine("d", "w")

CLUSTERED = """
cl AS (SELECT vec_id, CAST(label AS VARCHAR) AS cluster, ri, CASE WHEN vec_id % 4 = 0 THEN 'F' ELSE 'T' END AS known,
       CASE WHEN vec_id % 2 = 0 THEN 'class' || CAST(label % 3 AS VARCHAR) ELSE 'other' END AS cc FROM meta)
"""


def all_sql() -> dict:
    D = derived()
    DT = derived(C.CORE_LOSSES + C.EXTENDED_LOSSES)
    sql = {}
    # per-spectrum operators
    sql["parse_peaks"] = f"""WITH {ORDER_PEAKS} SELECT id, count(*) AS n, {r6('sum(it)', 'total')}, {r6('min(mz)', 'low')}, {r6('max(mz)', 'high')}
        FROM op WHERE id IN (SELECT id FROM om) GROUP BY id"""
    sql["tic_normalize"] = f"""WITH {ORDER_PEAKS} SELECT id, {r6('mz', 'mz')}, {r6('it / sum(it) OVER (PARTITION BY id)', 'intensity')}
        FROM op WHERE id IN (SELECT id FROM om)"""
    sql["prep_peaks"] = f"WITH {GRID} {peaks_of('f')}"
    sql["intensity_at_mass"] = f"""WITH {GRID} SELECT vec_id AS id, {r6('max(CASE WHEN mz = 100 THEN p ELSE 0 END)', 'i100')}, 0.0::DOUBLE AS i101 FROM f GROUP BY 1"""
    sql["mz_frequency"] = f"""WITH {GRID} SELECT mz + 0.5 AS mz_bin, count(*) AS n_spectra, {r6('count(*)::DOUBLE / (SELECT count(*) FROM embeddings)', 'frequency')} FROM f GROUP BY 1"""
    sql["frequency_weights"] = f"""WITH {GRID}, fr AS (SELECT mz, count(*)::DOUBLE / (SELECT count(*) FROM embeddings) AS q FROM f GROUP BY 1),
        w AS (SELECT vec_id, mz, sqrt(p) * sqrt(q) AS v FROM f JOIN fr USING (mz))
        SELECT vec_id AS id, mz, {r6('v / sum(v) OVER (PARTITION BY vec_id)', 'intensity')} FROM w"""
    sql["reference_mass"] = f"WITH {D} SELECT vec_id AS id, {r6('mref', 'mref')}, {r6('conf', 'confidence')} FROM mref"
    sql["neutral_losses"] = f"""WITH {D} SELECT DISTINCT vec_id AS id, formula FROM found UNION ALL
        SELECT vec_id, 'none' FROM tops WHERE vec_id NOT IN (SELECT vec_id FROM found)"""
    sql["functional_groups"] = f"""WITH {D} SELECT cls AS "group", count(*) AS n FROM (SELECT DISTINCT vec_id, cls FROM found) GROUP BY 1"""
    for name, rel in (("derived_pooled", "loss"), ("derived_anchored", "anch"), ("derived_pairwise", "pairw")):
        sql[name] = f"WITH {D} {peaks_of(rel)}"
    sql["typical_projection"] = f"WITH {DT}, {typical()} SELECT vec_id AS id, formula, {r6('p', 'intensity')} FROM typ"
    sql["compound_class"] = f"WITH {IONS}, {CLASS_RULES} SELECT id, label AS compound_class FROM labelled"
    sql["class_counts"] = f"WITH {IONS}, {CLASS_RULES} SELECT unnest(string_split(label, ';')) AS class, count(*) AS n FROM labelled GROUP BY 1"
    sql["derivatization_detect"] = f"""WITH {IONS} SELECT id, {deriv_rule()} AS type, {r6('i730474 + 0.5 * i1470654', 'score_tms')},
        {r6('i1150943 + 0.2 * i570704', 'score_tbdms')} FROM w"""
    sql["derivatization_confusion"] = f"""WITH {IONS}, {TRUTH}, lv(v) AS (VALUES ('none'), ('TMS'), ('TBDMS')),
        c AS (SELECT t, {deriv_rule()} AS y, count(*) AS n FROM tr GROUP BY 1, 2)
        SELECT a.v AS truth, b.v AS predicted, coalesce(n, 0) AS n FROM lv a CROSS JOIN lv b LEFT JOIN c ON c.t = a.v AND c.y = b.v"""
    lo, hi = [round(0.01 + 0.005 * i, 3) for i in range(9)], [round(0.05 + 0.01 * i, 2) for i in range(11)]
    sql["derivatization_sweep"] = f"""WITH {IONS}, {TRUTH}, a(lo) AS (VALUES {', '.join(f'({x}::DOUBLE)' for x in lo)}), b(hi) AS (VALUES {', '.join(f'({x}::DOUBLE)' for x in hi)}),
        x AS (SELECT lo, hi, t, {deriv_rule('lo', 'hi')} AS y FROM tr, a, b)
        SELECT lo AS min_int, hi AS strong_int, {r6('avg((t = y)::INT)', 'accuracy')},
        {', '.join(r6(f"avg(CASE WHEN t = '{v}' THEN (t = y)::INT END)", f'recall_{v}') for v in ('none', 'TMS', 'TBDMS'))} FROM x GROUP BY 1, 2"""
    sql["shared_peak_flags"] = f"""WITH {GRID}, s AS (SELECT vec_id, mz, 100 * p / max(p) OVER (PARTITION BY vec_id) AS v FROM f)
        SELECT a.vec_id AS id, 'A' AS side, a.mz, {r6('a.v', 'intensity')}, b.mz IS NOT NULL AS shared FROM s a LEFT JOIN s b ON b.vec_id = a.vec_id + 1 AND a.mz = b.mz
        WHERE a.vec_id + 1 IN (SELECT vec_id FROM embeddings)
        UNION ALL SELECT b.vec_id - 1, 'B', b.mz, {r6('-b.v', 'v')}, a.mz IS NOT NULL FROM s b LEFT JOIN s a ON b.vec_id = a.vec_id + 1 AND a.mz = b.mz
        WHERE b.vec_id - 1 IN (SELECT vec_id FROM embeddings)"""
    sql["mixture_fixed_pair"] = f"""WITH {GRID}, x AS (SELECT vec_id AS id, mz, 0.2 * p AS v FROM f UNION ALL SELECT vec_id - 1, mz, 0.8 * p FROM f)
        SELECT id, mz, {r6('sum(v)', 'intensity')} FROM x WHERE id IN (SELECT vec_id FROM embeddings) AND id + 1 IN (SELECT vec_id FROM embeddings) GROUP BY 1, 2"""
    sql["systematic_drift"] = f"""WITH {GRID} SELECT vec_id AS id, {r6('mz * (1 + (10 * cos(0.5) + 0.1 * sin(0.5) * (mz - 100)) * 1e-6)', 'mz')}, {r6('p', 'intensity')} FROM f"""
    # sources
    sql["msp_parse"] = msp_expected()
    sql["msp_embedded_repair"] = msp_expected()
    sql["msp_convert"] = f"""WITH {ORDER_PEAKS}, n AS (SELECT id, count(*) AS n FROM op GROUP BY 1),
        x AS (SELECT om.*, mode || '/' || CAST(CAST(rt AS BIGINT) AS VARCHAR) AS k FROM om),
        y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS rn FROM x)
        SELECT k AS id, y.id AS pos, 'T' AS known, rt AS ri, n AS n_peaks FROM y JOIN n ON y.id = n.id WHERE rn = 1"""
    sql["msp_peak_encodings"] = f"""WITH {ORDER_PEAKS} SELECT CAST(0 AS BIGINT) AS colon_lines, count(*) AS whitespace_lines, CAST(0 AS BIGINT) AS annotated_lines
        FROM op WHERE id IN (SELECT id FROM om)"""
    sql["msp_write"] = f"""WITH {GRID}, t AS (SELECT vec_id, mz, round_even(p / max(p) OVER (PARTITION BY vec_id) * 999, 0) AS v FROM f),
        b AS (SELECT vec_id, count(*) AS n, string_agg(printf('%.4f %.0f', mz, v), chr(10) ORDER BY mz) AS body FROM t GROUP BY 1),
        x AS (SELECT vec_id, n, 'NAME: ' || CAST(vec_id AS VARCHAR) || chr(10) || 'RI: ' || CAST(CAST(ri AS BIGINT) AS VARCHAR) || chr(10)
              || 'INCHIKEY: ' || inchikey || chr(10) || 'Num Peaks: ' || CAST(n AS VARCHAR) || chr(10) || body || chr(10) AS txt FROM b JOIN meta USING (vec_id))
        SELECT vec_id AS id, CAST(length(txt) AS BIGINT) AS chars, n + 5 AS lines, md5(txt) AS digest FROM x"""
    sql["lc_metadata"] = f"""WITH {ORDER_PEAKS} SELECT id, round(CAST(mz AS DECIMAL(12, 2))::DOUBLE, 6) + 0.0 AS precursor_mz, rt,
        CASE mode WHEN 'O' THEN 'positive' WHEN 'F' THEN 'negative' END AS ion_mode, upper(replace(adduct, ' ', '')) AS adduct, ce AS collision_energy FROM om"""
    sql["unique_record_ids"] = """WITH n AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 7 = 0 THEN p_name || '__' || CAST(p_partkey % 3 + 1 AS VARCHAR) ELSE p_name END AS name FROM part),
        j AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) - 1 AS j FROM n), d AS (SELECT name, max(j) AS most FROM j GROUP BY 1),
        k AS (SELECT name, unnest(generate_series(1, CAST(most AS BIGINT) + (SELECT count(*) FROM d x WHERE starts_with(x.name, d.name || '__')))) AS k FROM d WHERE most > 0),
        f AS (SELECT name, k, row_number() OVER (PARTITION BY name ORDER BY k) AS j FROM k WHERE name || '__' || CAST(k AS VARCHAR) NOT IN (SELECT name FROM d))
        SELECT pos, CASE WHEN j.j = 0 THEN j.name ELSE j.name || '__' || CAST(f.k AS VARCHAR) END AS id FROM j LEFT JOIN f ON j.name = f.name AND j.j = f.j"""
    # feature tables
    sql["known_dedup"] = f"""WITH {FEATURES} SELECT id, name, {r6('mean', 'mean')}, CAST(CASE WHEN ikey IS NULL THEN 1 ELSE 0 END AS BIGINT) AS part FROM k2"""
    sql["unknown_filter"] = f"WITH {FEATURES} SELECT id, name, {r6('mean', 'mean')} FROM feat WHERE tag = '4' AND mean > 0"
    sql["blank_filter"] = f"WITH {FEATURES} SELECT id, bm AS blank_mean, s1 AS S01, s2 AS S02, s3 AS S03 FROM zf"
    sql["nonzero_filter"] = f"""WITH {FEATURES}, n AS (SELECT id, CAST((s1 > 0)::INT + (s2 > 0)::INT + (s3 > 0)::INT AS BIGINT) AS nonzero FROM zf)
        SELECT id, nonzero FROM n WHERE nonzero > 1.5"""
    sql["reference_normalize"] = f"""WITH {FEATURES}, r AS (SELECT s1 AS r1, s2 AS r2, s3 AS r3 FROM feat WHERE id = 1)
        SELECT id, {', '.join(r6(f'CASE WHEN r{i} <> 0 THEN s{i} / r{i} ELSE s{i} END', f'S0{i}') for i in (1, 2, 3))} FROM feat, r"""
    sql["quant_pipeline"] = f"""WITH {FEATURES}, u AS (SELECT id, 'T' AS known FROM k2 UNION ALL SELECT id, 'F' FROM feat WHERE tag = '4' AND mean > 0),
        x AS (SELECT zf.*, known, (coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0)) / nullif((s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT, 0) AS m FROM zf JOIN u USING (id))
        SELECT id, CASE WHEN tag = '4' THEN name || '_' || CAST(id AS VARCHAR) ELSE name END AS compound_id, known, {r6('m', 'mean')}, s1 AS S01, s2 AS S02, s3 AS S03
        FROM x WHERE m > 0 AND (s1 > 0)::INT + (s2 > 0)::INT + (s3 > 0)::INT > 1.5"""
    # distances
    sql["cosine_neighbours"] = neighbours(pair_cosine("d", "f"))
    sql["weighted_cosine_neighbours"] = neighbours(WCOS)
    sql["hellinger_neighbours"] = neighbours(HELLINGER)
    sql["composite_neighbours"] = neighbours(COMPOSITE)
    sql["entropy_weighted_neighbours"] = neighbours(entropy_pairs(True))
    sql["entropy_unweighted_neighbours"] = neighbours(entropy_pairs(False))
    sql["wasserstein_neighbours"] = neighbours(WASSERSTEIN)
    sql["ppm_wasserstein_neighbours"] = neighbours(OVERLAP)
    sql["distance_profile"] = f"""WITH {D}, {COMBINED} SELECT q AS query_id, count(*) AS n, {r6('avg(d)', 'mean_distance')}, {r6('min(d)', 'low')}, {r6('max(d)', 'high')} FROM dd GROUP BY 1"""
    sql["close_pairs"] = f"WITH {GRID}, {pair_cosine('d', 'f')} SELECT q AS query_id, l AS library_id, {r6('d', 'distance')} FROM d WHERE q < l AND d < 0.22"
    split_cte = f"""{D}, {pair_cosine('df', 'f')}, {pair_cosine('da', 'anch')}, {pair_cosine('dp', 'pairw')},
        wt AS (SELECT df.q, df.l, df.d AS d_frag, coalesce(da.d, 1) AS d_anchor, coalesce(dp.d, 1) AS d_pair, 0.6 * sqrt(least(greatest(x.conf, 0), 1) * least(greatest(y.conf, 0), 1)) AS wa
               FROM df LEFT JOIN da ON df.q = da.q AND df.l = da.l LEFT JOIN dp ON df.q = dp.q AND df.l = dp.l JOIN mref x ON df.q = x.vec_id JOIN mref y ON df.l = y.vec_id),
        sp AS (SELECT q, l, d_frag, d_anchor, d_pair, wa / (wa + 0.4) AS wa, 0.4 / (wa + 0.4) AS wp FROM wt),
        sd AS (SELECT *, sqrt(wa * d_anchor * d_anchor + wp * d_pair * d_pair) AS d_loss FROM sp),
        d AS (SELECT *, sqrt(0.7 * d_frag * d_frag + 0.3 * d_loss * d_loss) AS d FROM sd)"""
    sql["split_neighbours"] = f"WITH {split_cte} {top_hits(3)}"
    typ_cte = f"""{D}, {typical()}, {COMBINED}, tt AS (SELECT vec_id, exact AS mz, p FROM typ), tn AS (SELECT vec_id, sqrt(sum(p * p)) AS s FROM tt GROUP BY 1),
        td AS (SELECT a.vec_id AS q, b.vec_id AS l, sum(a.p * b.p) AS dot FROM tt a JOIN tt b ON a.mz = b.mz GROUP BY 1, 2),
        tb AS (SELECT dd.q, dd.l, d_frag, d_loss, CASE WHEN x.s IS NULL OR y.s IS NULL THEN NULL ELSE 1 - coalesce(dot, 0) / (x.s * y.s) END AS t
               FROM dd LEFT JOIN td ON dd.q = td.q AND dd.l = td.l LEFT JOIN tn x ON dd.q = x.vec_id LEFT JOIN tn y ON dd.l = y.vec_id),
        d AS (SELECT q, l, sqrt(0.7 * d_frag * d_frag + 0.3 * (CASE WHEN t IS NULL THEN d_loss * d_loss ELSE (1 - (1 - 0.8)) * d_loss * d_loss + (1 - 0.8) * t * t END)) AS d FROM tb)"""
    sql["typical_blend_neighbours"] = f"WITH {typ_cte} {top_hits(3)}"
    best = f"{D}, {COMBINED}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, l) AS rn FROM dd) WHERE rn = 1)"
    share = "0.7 * d_frag * d_frag / (d * d)"
    sql["component_shares"] = f"""WITH {best} SELECT q AS query_id, l AS library_id, {r6('d', 'distance')}, {r6('d_frag', 'd_frag')}, {r6('d_loss', 'd_loss')},
        {r6(share, 'c_frag_total')}, {r6('0.3 * d_loss * d_loss / (d * d)', 'c_loss_total')} FROM best"""
    sql["component_long"] = f"""WITH {best}, u AS (SELECT * FROM best WHERE q < l) SELECT q AS query_id, l AS library_id, 'd_frag' AS component, {r6('d_frag', 'value')} FROM u
        UNION ALL SELECT q, l, 'd_loss', {r6('d_loss', 'v')} FROM u UNION ALL SELECT q, l, 'c_frag_total', {r6(share, 'v')} FROM u"""
    sql["composite_direction"] = f"""WITH {GRID}, {COMPOSITE}, {pair_cosine('c', 'f')}, b AS (SELECT q, l FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, l) AS rn FROM c) WHERE rn = 1)
        SELECT b.q AS query_id, b.l AS library_id, {r6('x.d', 'd_ab')}, {r6('y.d', 'd_ba')} FROM b JOIN d x ON b.q = x.q AND b.l = x.l JOIN d y ON b.q = y.l AND b.l = y.q"""
    # search
    sql["library_search"] = f"""WITH {D}, {COMBINED} SELECT q AS query_id, CAST(rank AS BIGINT) AS rank, l AS library_id, {r6('1 - d', 'similarity')},
        abs(x.ri - y.ri) AS delta_ri, CAST(y.label AS BIGINT) AS label FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, l) AS rank FROM dd) h
        JOIN meta x ON h.q = x.vec_id JOIN meta y ON h.l = y.vec_id WHERE rank <= 5"""
    sql["ri_band_search"] = f"""WITH {D}, {COMBINED}, h AS (SELECT dd.*, abs(x.ri - y.ri) AS gap FROM dd JOIN meta x ON q = x.vec_id JOIN meta y ON l = y.vec_id WHERE abs(x.ri - y.ri) <= 25)
        SELECT q AS query_id, CAST(rank AS BIGINT) AS rank, l AS library_id, {r6('1 - d', 'similarity')}, gap AS delta_ri
        FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, l) AS rank FROM h) WHERE rank <= 5"""
    sql["rerank_topk"] = f"""WITH {GRID}, {entropy_pairs(True)}, a AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, l) AS r1 FROM d),
        o AS (SELECT a.vec_id AS q, b.vec_id AS l, 1 - sum(least(a.p, b.p)) AS d FROM f a JOIN f b ON a.mz = b.mz AND a.vec_id <> b.vec_id GROUP BY 1, 2),
        z AS (SELECT a.q, a.l, o.d, a.d AS d1, r1, row_number() OVER (PARTITION BY a.q ORDER BY o.d, a.l) AS rank FROM a JOIN o ON a.q = o.q AND a.l = o.l WHERE r1 <= 20)
        SELECT q AS query_id, CAST(rank AS BIGINT) AS rank, l AS library_id, {r6('d', 'distance')}, {r6('d1', 'first_pass_distance')}, CAST(r1 AS BIGINT) AS first_pass_rank FROM z WHERE rank <= 5"""
    # on isolated peaks every smeared pattern has one shape, so the bin cosine is the plain one
    sql["sparse_bin_search"] = f"WITH {GRID}, {pair_cosine('d', 'f', True)} {top_hits(6)}"
    sql["indexed_bin_search"] = f"""WITH {ORDER_PEAKS}, e AS (
        SELECT id, CAST(least(greatest(floor(ln(CAST(mz AS DOUBLE) / 35.0) / ln(1 + 2e-6) + 0.5) + 1, 1), {_n_bins() - 1}) AS BIGINT) + k AS bin, it * (1 - abs(k) / 11e0) AS v
        FROM op, unnest(range(-10, 11)) AS u(k) WHERE id IN (SELECT id FROM om)),
        b AS (SELECT id, bin, sum(v) AS v FROM e WHERE bin BETWEEN 1 AND {_n_bins()} GROUP BY id, bin),
        n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM b GROUP BY 1),
        w AS (SELECT b.id, bin, v / norm AS v FROM b JOIN n ON b.id = n.id),
        d AS (SELECT x.id AS q, y.id AS l, round(1 - sum(x.v * y.v), 10) AS d FROM w x JOIN w y ON x.bin = y.bin GROUP BY x.id, y.id HAVING round(1 - sum(x.v * y.v), 10) < 1),
        f AS (SELECT om.id AS q, h.id AS l, 1.0 AS d FROM om, (SELECT id FROM om ORDER BY id LIMIT 10) h WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.q = om.id AND d.l = h.id)),
        z AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, l) AS rank FROM (SELECT * FROM d UNION ALL SELECT * FROM f))
        SELECT q AS query_id, CAST(rank AS BIGINT) AS rank, l AS library_id, {r6('d', 'distance')} FROM z WHERE rank <= 5"""
    sql["density_clusters"] = density(0.28, 3)
    sql["density_clusters_hard"] = density(0.73, 3, "CASE WHEN abs(a.ri - b.ri) > 40 THEN 0.0 ELSE 1.0 END")
    sql["density_clusters_soft"] = density(0.4, 4, "exp(-pow((a.ri - b.ri) / 60.0, 2))")
    sql["neighbour_graph"] = fuzzy_graph(10)
    sql["neighbour_graph_soft"] = fuzzy_graph(6, "exp(-pow((a.ri - b.ri) / 60.0, 2))")
    sql["smeared_bins"] = f"""WITH {GRID}, b AS (SELECT vec_id, least(greatest(floor(ln(mz / 35.0) / ln(1 + 2e-6) + 0.5) + 1, 1), {_n_bins() - 1}) AS b FROM f)
        SELECT vec_id AS id, count(*) * 21 AS n_bins, 1.0::DOUBLE AS total, CAST(min(b) - 10 AS BIGINT) AS first_bin, CAST(max(b) + 10 AS BIGINT) AS last_bin FROM b GROUP BY 1"""
    gates = [("after_precursor", "TRUE"), ("after_ion_mode", "a.mode = b.mode"), ("after_adduct", "a.adduct = b.adduct"), ("after_rt", "abs(a.rt - b.rt) <= 600"),
             ("after_collision_energy", "abs(a.ce - b.ce) <= 20"), ("after_same_id", "a.id <> b.id")]
    cols, cond = [], []
    for n, c in gates:
        cond.append(c)
        cols.append(f"CAST(sum(CASE WHEN {' AND '.join(cond)} THEN 1 ELSE 0 END) AS BIGINT) AS {n}")
    sql["lc_candidate_audit"] = f"""WITH {ORDER_PEAKS} SELECT a.id AS query_id, (SELECT count(*) FROM om) AS initial, {', '.join(cols)},
        CAST(sum(CASE WHEN {' AND '.join(cond)} THEN 1 ELSE 0 END) AS BIGINT) AS final
        FROM om a JOIN om b ON b.mz BETWEEN a.mz * 0.9997 AND a.mz * 1.0003 AND abs(b.mz - a.mz) / a.mz * 1e6 <= 200 GROUP BY a.id"""
    sql["topk_accuracy"] = f"""WITH {GRID}, {pair_cosine('d', 'f')}, h AS (SELECT q, l FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, l) AS rn FROM d) WHERE rn <= 5),
        x AS (SELECT q, max((a.label = b.label)::INT) AS hit FROM h JOIN meta a ON q = a.vec_id JOIN meta b ON l = b.vec_id GROUP BY 1)
        SELECT {r6('avg(hit)', 'accuracy')}, count(*) AS n_queries FROM x"""
    sql["rerank_quality"] = f"""WITH {GRID}, {pair_cosine('c', 'f')}, t AS (SELECT q, l FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, l) AS rn FROM c) WHERE rn = 1),
        h AS (SELECT a.vec_id AS q, b.vec_id AS l, sqrt(greatest(1 - sum(sqrt(a.p) * sqrt(b.p)), 0)) AS d FROM f a JOIN f b ON a.mz = b.mz AND a.vec_id <> b.vec_id GROUP BY 1, 2),
        c1 AS (SELECT q, l FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, l) AS rn FROM h) WHERE rn <= 10), {entropy_pairs(False)},
        z AS (SELECT q, l, rank FROM (SELECT c1.q, c1.l, row_number() OVER (PARTITION BY c1.q ORDER BY d.d, c1.l) AS rank FROM c1 JOIN d ON c1.q = d.q AND c1.l = d.l) WHERE rank <= 5)
        SELECT {r6('avg((c1.l IS NOT NULL)::INT)', 'candidate_retention')}, {r6('avg(coalesce((z.rank = 1)::INT, 0))', 'top1')}, {r6('avg(coalesce(1.0 / z.rank, 0))', 'mrr')},
        count(*) AS n_queries FROM t LEFT JOIN c1 ON t.q = c1.q AND t.l = c1.l LEFT JOIN z ON t.q = z.q AND t.l = z.l"""
    # graph and clusters
    for name, k, sim in (("analog_graph", 3, "CASE WHEN abs(x.ri - y.ri) > 100 THEN 0 ELSE 1 - d END"),
                         ("analog_graph_soft", 2, "(1 - d) * exp(-power((x.ri - y.ri) / 200.0, 2))")):
        sql[name] = f"""WITH {GRID}, {pair_cosine('d', 'f')}, s AS (SELECT q, l, {sim} AS s FROM d JOIN meta x ON q = x.vec_id JOIN meta y ON l = y.vec_id),
            e AS (SELECT q, l, s FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, l) AS rn FROM s WHERE s > 0) WHERE rn <= {k})
            SELECT a_pos, b_pos, {r6('max(s)', 'similarity')} FROM (SELECT q AS a_pos, l AS b_pos, s FROM e UNION ALL SELECT l, q, s FROM e) GROUP BY 1, 2"""
    sql["core_spectra"] = f"""WITH {GRID}, {pair_cosine('d', 'f')}, n AS (SELECT q, count(*) + 1 AS n FROM d WHERE d < 0.28 GROUP BY 1)
        SELECT vec_id AS id, coalesce(n, 1) AS n_near FROM embeddings LEFT JOIN n ON vec_id = q"""
    sql["nmi_ari"] = """WITH e AS (SELECT event_type AS t, user_id % 6 AS p FROM events WHERE user_id % 6 <> 0), c AS (SELECT t, p, count(*)::DOUBLE AS n FROM e GROUP BY 1, 2),
        r AS (SELECT t, sum(n) AS a FROM c GROUP BY 1), k AS (SELECT p, sum(n) AS b FROM c GROUP BY 1), tot AS (SELECT sum(n) AS n FROM c),
        h AS (SELECT (SELECT -sum(a / n * ln(a / n)) FROM r, tot) AS ht, (SELECT -sum(b / n * ln(b / n)) FROM k, tot) AS hp, (SELECT sum(a * (a - 1) / 2) FROM r) AS sa, (SELECT sum(b * (b - 1) / 2) FROM k) AS sb,
              (SELECT sum(c.n * (c.n - 1) / 2) FROM c) AS sij, (SELECT sum(c.n / tot.n * ln(c.n * tot.n / (a * b))) FROM c JOIN r USING (t) JOIN k USING (p), tot) AS mi, (SELECT n FROM tot) AS n)
        SELECT round(2 * mi / (ht + hp), 6) + 0.0 AS nmi, round((sij - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) + 0.0 AS ari, CAST(n AS BIGINT) AS n FROM h"""
    sql["silhouette"] = f"""WITH {GRID}, {KEYED}, m AS (SELECT q, ql, ll, avg(d) AS d FROM kp GROUP BY 1, 2, 3), ab AS (SELECT q, ql, max(CASE WHEN ql = ll THEN d END) AS a, min(CASE WHEN ql <> ll THEN d END) AS b FROM m GROUP BY 1, 2)
        SELECT q AS query_id, CAST(ql AS VARCHAR) AS label, {r6('coalesce((b - a) / greatest(a, b), 0)', 'silhouette')} FROM ab"""
    members = f"""{D}, {CLUSTERED}, {COMBINED}, mem AS (SELECT x.cluster, q, avg(d) AS ad, sum(d) AS sd, count(*) AS n, sum({share}) AS cf, sum(0.3 * d_loss * d_loss / (d * d)) AS clo
        FROM dd JOIN cl x ON q = x.vec_id JOIN cl y ON l = y.vec_id WHERE x.cluster = y.cluster GROUP BY 1, 2)"""
    md = "md AS (SELECT cluster, q AS medoid FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY ad, q) AS rn FROM mem) WHERE rn = 1)"
    sql["cluster_drivers"] = f"""WITH {members}, {md}, base AS (SELECT cluster, count(*) AS n, CAST(sum((known = 'T')::INT) AS BIGINT) AS nk, min(ri) AS lo, median(ri) AS mid, max(ri) AS hi FROM cl GROUP BY 1),
        mode AS (SELECT cluster, cc FROM (SELECT cluster, cc, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, cc) AS rn FROM cl GROUP BY 1, 2) WHERE rn = 1),
        s AS (SELECT cluster, 1 - sum(sd) / sum(n) AS ms, sum(cf) / sum(n) AS cf, sum(clo) / sum(n) AS clo FROM mem GROUP BY 1),
        z AS (SELECT *, CASE WHEN cf >= 0.6 THEN 'frag' WHEN clo >= 0.6 THEN 'loss' ELSE 'mixed' END AS dm FROM s)
        SELECT base.cluster, base.n, nk AS n_known, {r6('nk::DOUBLE / base.n', 'frac_known')}, lo AS RI_min, mid AS RI_median, hi AS RI_max, cc AS top_class, base.n * (base.n - 1) / 2.0 AS pairs,
        {r6('ms', 'mean_sim_cluster')}, medoid AS medoid_id, {r6('cf', 'c_frag_total_mean')}, {r6('clo', 'c_loss_total_mean')}, dm AS driver_main,
        CASE dm WHEN 'frag' THEN 'frag-driven' ELSE dm END AS label FROM base JOIN mode USING (cluster) JOIN z USING (cluster) JOIN md USING (cluster) WHERE base.cluster <> '0'"""
    sql["medoids"] = f"WITH {members}, {md} SELECT cluster, medoid AS medoid_id FROM md"
    sql["medoid_partners"] = f"""WITH {members}, {md}, p AS (SELECT md.cluster, l, d, y.cluster AS pc FROM md JOIN dd ON medoid = q JOIN cl y ON l = y.vec_id),
        u AS (SELECT cluster, 'within_top' AS kind, row_number() OVER (PARTITION BY cluster ORDER BY d, l) AS rank, l, d, 5 AS k FROM p WHERE cluster = pc
              UNION ALL SELECT cluster, 'within_worst', row_number() OVER (PARTITION BY cluster ORDER BY d DESC, l), l, d, 1 FROM p WHERE cluster = pc
              UNION ALL SELECT cluster, 'outside_top', row_number() OVER (PARTITION BY cluster ORDER BY d, l), l, d, 3 FROM p WHERE cluster <> pc)
        SELECT cluster, kind, CAST(rank AS BIGINT) AS rank, l AS partner_id, {r6('1 - d', 'similarity')} FROM u WHERE rank <= k"""
    sql["cluster_drivers_split"] = f"""WITH {split_cte}, {CLUSTERED}, mem AS (SELECT x.cluster, q, avg(d) AS ad, count(*) AS n, sum(wa * d_anchor * d_anchor / (d_loss * d_loss)) AS ca, sum(wp * d_pair * d_pair / (d_loss * d_loss)) AS cp,
          sum({share}) AS cf FROM d JOIN cl x ON q = x.vec_id JOIN cl y ON l = y.vec_id WHERE x.cluster = y.cluster AND x.cluster <> '0' GROUP BY 1, 2), {md},
        s AS (SELECT cluster, count(*) AS n, sum(ca) / sum(n) AS ca, sum(cp) / sum(n) AS cp, sum(cf) / sum(n) AS cf FROM mem GROUP BY 1),
        z AS (SELECT *, CASE WHEN cf >= 0.6 THEN 'frag' WHEN 1 - cf >= 0.6 THEN 'loss' ELSE 'mixed' END AS dm FROM s),
        y AS (SELECT *, CASE WHEN dm = 'loss' THEN CASE WHEN ca >= 0.6 THEN 'anchored' WHEN cp >= 0.6 THEN 'pairwise' ELSE 'mixed' END END AS sub FROM z)
        SELECT cluster, n, medoid AS medoid_id, {r6('ca', 'c_anchor_in_loss_mean')}, {r6('cp', 'c_pair_in_loss_mean')}, sub AS driver_loss_sub,
        CASE dm WHEN 'frag' THEN 'frag-driven' WHEN 'mixed' THEN 'mixed' ELSE 'loss-' || sub END AS label FROM y JOIN md USING (cluster)"""
    motif = f"""{DT}, {typical()}, {CLUSTERED}, mem AS (SELECT vec_id, cluster FROM cl WHERE cluster <> '0'), sz AS (SELECT cluster, count(*) AS n FROM mem GROUP BY 1),
        dense AS (SELECT m.cluster, m.vec_id, l.formula, coalesce(t.p, 0) AS v FROM mem m CROSS JOIN losses l LEFT JOIN typ t ON t.vec_id = m.vec_id AND t.formula = l.formula),
        rk AS (SELECT *, row_number() OVER (PARTITION BY cluster, formula ORDER BY v, vec_id) AS r FROM dense),
        st AS (SELECT cluster, formula, n, avg((v > 0)::INT) AS pr, avg(v) AS mu, stddev_samp(v) AS sd, sum(v) AS s1, sum(v * v) AS s2, sum(v * (n - r)) / (n * (n - 1) / 2) AS ov
               FROM rk JOIN sz USING (cluster) GROUP BY 1, 2, 3),
        gp AS (SELECT formula, -ln(greatest(avg((v > 0)::INT), 1e-6)) AS idf FROM dense GROUP BY 1),
        mo AS (SELECT st.*, sd / (mu + 1e-12) AS cv, 1 / (1 + sd / (mu + 1e-12)) AS stab, CASE WHEN s2 > 0 THEN s1 * s1 / (n * s2) END AS un, idf FROM st JOIN gp USING (formula))"""
    sql["cluster_motifs"] = f"""WITH {motif} SELECT cluster, n AS n_members, formula, {r6('pr', 'presence')}, {r6('mu', 'mean_intensity')}, {r6('sd', 'sd_intensity')}, {r6('cv', 'cv_intensity')}, {r6('stab', 'stability')},
        {r6('un', 'uniformity')}, {r6('ov', 'pairwise_overlap')}, {r6('idf', 'idf')}, {r6('ov', 'score')}, {r6('ov * idf', 'score_idf')}, {r6('ov * stab', 'score_consistency')}, {r6('ov * stab * idf', 'score_consistency_idf')} FROM mo"""
    sql["motif_labels"] = f"""WITH {motif} SELECT cluster, string_agg(formula, ';' ORDER BY rn) AS top_typical_losses FROM
        (SELECT cluster, formula, row_number() OVER (PARTITION BY cluster ORDER BY ov * idf DESC, formula) AS rn FROM mo) WHERE rn <= 3 GROUP BY 1"""
    sql["typical_match_table"] = f"""WITH {DT}, {typical()}, m AS (SELECT a.vec_id AS pair_id, a.formula, a.cls, a.exact, a.p AS x, b.p AS y FROM typ a JOIN typ b ON b.vec_id = a.vec_id + 1 AND a.formula = b.formula),
        r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY least(x, y) DESC, formula) AS rank FROM m)
        SELECT pair_id, CAST(rank AS BIGINT) AS rank, formula, cls AS class, exact, {r6('x', 'intensity_A')}, {r6('y', 'intensity_B')}, {r6('least(x, y)', 'overlap')}, {r6('sqrt(x * y)', 'score')}, {r6('abs(x - y)', 'delta')}
        FROM r WHERE rank <= 5"""
    # evaluation
    sql["replicate_consistency"] = f"""WITH {GRID}, {KEYED}, r AS (SELECT q, qi, li, rank() OVER (PARTITION BY q ORDER BY d) AS rk FROM kp), b AS (SELECT q, min(rk) AS rk FROM r WHERE qi = li GROUP BY 1)
        SELECT {r6('avg((rk = 1)::INT)', 'top1_accuracy')}, {r6('avg((rk <= 5)::INT)', 'top5_accuracy')}, {r6('avg(1.0 / rk)', 'mrr')}, count(*) AS n_queries FROM b"""
    ranked = f"{GRID}, {KEYED}, r AS (SELECT q, qk = lk AS rel, row_number() OVER w AS rk, sum((qk = lk)::INT) OVER (PARTITION BY q ORDER BY d, l ROWS UNBOUNDED PRECEDING) AS hits FROM kp WINDOW w AS (PARTITION BY q ORDER BY d, l))"
    pk = ", ".join(f"sum((rel AND rk <= {k})::INT)::DOUBLE / {k} AS p{k}" for k in (1, 5, 10, 20))
    sql["precision_at_k"] = f"""WITH {ranked}, u AS (SELECT q, {pk}, sum(CASE WHEN rel THEN hits::DOUBLE / rk END) / sum(rel::INT) AS ap FROM r GROUP BY 1 HAVING sum(rel::INT) > 0)
        SELECT {', '.join(r6(f'avg(p{k})', f'p_at_{k}') for k in (1, 5, 10, 20))}, {r6('avg(ap)', 'mean_average_precision')}, count(*) AS n_queries FROM u"""
    sql["library_retrieval"] = f"""WITH {GRID}, {KEYED}, lib AS (SELECT prefix, count(*) AS n FROM meta WHERE vec_id % 2 = 1 AND label <> 3 GROUP BY 1), b AS (SELECT vec_id AS q, n FROM meta JOIN lib USING (prefix) WHERE vec_id % 2 = 0),
        c AS (SELECT q, l, d, qk = lk AS rel FROM kp WHERE q % 2 = 0 AND l % 2 = 1 AND ll <> 3 AND abs(qri - lri) <= 200),
        r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, l) AS rk, sum(rel::INT) OVER (PARTITION BY q ORDER BY d, l ROWS UNBOUNDED PRECEDING) AS h, count(*) OVER (PARTITION BY q) AS nn FROM c),
        u AS (SELECT q, sum(CASE WHEN rel THEN h::DOUBLE / rk END) AS ap, min(CASE WHEN rel THEN rk END) AS first, {', '.join(f'sum((rel AND rk <= {k})::INT)::DOUBLE / max(least({k}, nn)) AS p{k}' for k in (1, 5, 10, 20))} FROM r GROUP BY 1)
        SELECT {r6('avg(coalesce(ap / n, 0))', 'map')}, {r6('avg(coalesce(1.0 / first, 0))', 'mrr')}, {', '.join(r6(f'avg(coalesce(p{k}, 0))', f'p_at_{k}') for k in (1, 5, 10, 20))}, count(*) AS n_queries FROM b LEFT JOIN u USING (q)"""
    auc = """a AS (SELECT s, sum(y::INT) AS np, sum((NOT y)::INT) AS nn FROM sc GROUP BY 1), b AS (SELECT *, coalesce(sum(nn) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM a)
        SELECT round(sum(np::DOUBLE * (below + nn / 2.0)) / (sum(np)::DOUBLE * sum(nn)), 6) + 0.0 AS auc, CAST(sum(np) AS BIGINT) AS n_positive, CAST(sum(nn) AS BIGINT) AS n_negative FROM b"""
    sql["auc_roc"] = f"WITH {GRID}, {KEYED}, sc AS (SELECT 1 - d AS s, qk = lk AS y FROM kp WHERE q < l), {auc}"
    sql["ordered_auc"] = f"WITH {GRID}, {COMPOSITE}, sc AS (SELECT 1 - d AS s, x.prefix = y.prefix AS y FROM d JOIN meta x ON q = x.vec_id JOIN meta y ON l = y.vec_id), {auc}"
    fdr = """, th(t) AS (VALUES {t}) SELECT t AS threshold, count(*) FILTER (s >= t) AS n_matches, count(*) FILTER (s >= t AND y) AS n_true_pos, count(*) FILTER (s >= t AND NOT y) AS n_false_pos,
        round(coalesce(count(*) FILTER (s >= t AND NOT y)::DOUBLE / nullif(count(*) FILTER (s >= t), 0), 0), 6) + 0.0 AS fdr FROM sc, th GROUP BY t"""
    fdr = fdr.replace("{t}", ", ".join(f"({round(0.5 + 0.05 * i, 2)}::DOUBLE)" for i in range(10)))
    sql["fdr_curve"] = f"""WITH {GRID}, {KEYED}, mm AS (SELECT min(d) AS lo, max(d) AS hi FROM kp WHERE q < l),
        sc AS (SELECT least(greatest(1 - (d - lo) / (hi - lo), 0), 1) AS s, qk = lk AS y FROM kp, mm WHERE q < l){fdr}"""
    sql["event_fdr"] = f"WITH {EVENTS}, sc AS (SELECT score / 49002.0::DOUBLE AS s, pos AS y FROM ev){fdr}"
    trs = (("linear", "1 - d"), ("linear_clamp", "1 - least(greatest(d, 0), 1)"), ("minmax", "least(greatest(1 - (d - lo) / (hi - lo), 0), 1)"),
           ("reciprocal", "1 / (1 + greatest(d, 0))"), ("exponential", "exp(-greatest(d, 0) / md)"))
    sql["similarity_transforms"] = f"""WITH {GRID}, {KEYED}, u AS (SELECT * FROM kp WHERE q < l), mm AS (SELECT min(d) AS lo, max(d) AS hi, median(CASE WHEN d > 0 THEN d END) AS md FROM u) """ + " UNION ALL ".join(
        f"SELECT '{n}' AS transform, {r6(f'avg({e})', 'mean')}, {r6(f'min({e})', 'low')}, {r6(f'max({e})', 'high')} FROM u, mm" for n, e in trs)
    sql["homolog_score"] = f"""WITH {GRID}, {KEYED}, h AS (SELECT * FROM kp WHERE q < l AND d < 1 - 0.65 AND abs(qri - lri) > 50)
        SELECT count(*) AS n_pairs, count(*) FILTER (ql = ll) AS n_true, {r6('coalesce(avg((ql = ll)::INT), 0)', 'homolog_score')} FROM h"""
    sql["homolog_groups"] = """WITH c AS (SELECT c_custkey AS id, substr(rpad(c_mktsegment, 10, 'X') || '-' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0'), 1, 14) AS g FROM customer)
        SELECT id, g AS "group" FROM c WHERE g IN (SELECT g FROM c GROUP BY 1 HAVING count(*) >= 3)"""
    sql["event_auc"] = f"WITH {EVENTS}, sc AS (SELECT score AS s, pos AS y FROM ev), {auc}"
    sql["roc_points"] = f"""WITH {EVENTS}, a AS (SELECT score AS s, sum(pos::INT) AS np, sum((NOT pos)::INT) AS nn FROM ev GROUP BY 1),
        b AS (SELECT s, sum(np) OVER w AS tp, sum(nn) OVER w AS fp, sum(np) OVER () AS tpn, sum(nn) OVER () AS fpn FROM a WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
        SELECT s::DOUBLE AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {r6('tp::DOUBLE / tpn', 'tpr')}, {r6('fp::DOUBLE / fpn', 'fpr')} FROM b
        UNION ALL SELECT 'Infinity'::DOUBLE, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE
        UNION ALL SELECT '-Infinity'::DOUBLE, CAST(max(tpn) AS BIGINT), CAST(max(fpn) AS BIGINT), 1.0::DOUBLE, 1.0::DOUBLE FROM b"""
    # ties: the first relevant of a block of n with h relevant sits at offset r with chance C(n-1-r, h-1) / C(n, h)
    chance = "exp(lgamma(n - r) - lgamma(h) - lgamma(n - r - h + 1) - (lgamma(n + 1) - lgamma(h + 1) - lgamma(n - h + 1)))"
    tops = ", ".join(f"max((before + 1 <= {k})::INT)::DOUBLE AS top{k}_optimistic, max((before + n - h + 1 <= {k})::INT)::DOUBLE AS top{k}_pessimistic, "
                     f"{r6(f'sum({chance} * (before + r + 1 <= {k})::INT)', f'top{k}_fractional')}" for k in (1, 5, 10))
    sql["tie_aware_first"] = f"""WITH {EVENTS}, f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d) AS rn FROM runs WHERE h > 0) WHERE rn = 1),
        x AS (SELECT q, before, n, h, unnest(generate_series(0, CAST(n - h AS BIGINT))) AS r FROM f1)
        SELECT q AS q_pos, CAST(max(before + 1) AS BIGINT) AS best_rank, CAST(max(before + n - h + 1) AS BIGINT) AS worst_rank, {r6('max(1.0::DOUBLE / (before + 1))', 'rr_optimistic')}, {r6('max(1.0::DOUBLE / (before + n - h + 1))', 'rr_pessimistic')},
        {r6(f'sum({chance} / (before + r + 1))', 'rr_fractional')}, {tops} FROM x GROUP BY 1"""
    coarse = """, blk2 AS (SELECT user_id AS q, floor(CAST(round(value * 100) AS BIGINT) / 5000.0) AS d, count(*) AS n, count(*) FILTER (event_type IN ('purchase', 'click')) AS h FROM events GROUP BY 1, 2),
        runs2 AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY q ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM blk2)"""
    per = f"""f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d) AS rn FROM runs WHERE h > 0) WHERE rn = 1),
        f2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d) AS rn FROM runs2 WHERE h > 0) WHERE rn = 1)"""
    policies = []
    for metric, table, k in (("top1", "f1", 1), ("top5", "f1", 5), ("top10", "f1", 10), ("p_at_1", "f2", 1)):
        policies += [(metric, "optimistic", table, f"(before + 1 <= {k})::INT"), (metric, "pessimistic", table, f"(before + n - h + 1 <= {k})::INT"),
                     (metric, "fractional", table, f"list_sum([{chance} * (before + r + 1 <= {k})::INT for r in generate_series(0, CAST(n - h AS BIGINT))])")]
    policies += [("mrr", "optimistic", "f1", "1.0::DOUBLE / (before + 1)"), ("mrr", "pessimistic", "f1", "1.0::DOUBLE / (before + n - h + 1)"),
                 ("mrr", "fractional", "f1", f"list_sum([{chance} / (before + r + 1) for r in generate_series(0, CAST(n - h AS BIGINT))])")]
    sql["tie_sensitivity"] = f"WITH {EVENTS}{coarse}, {per} " + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, '{p}' AS tie_policy, {r6(f'avg({v})', 'estimate')}, count(*) AS n_queries FROM {t}" for m, p, t, v in policies)
    sql["tie_effects"] = f"WITH {EVENTS}{coarse}, {per} " + " UNION ALL ".join(
        f"""SELECT '{level}' AS identity_level, '{m}' AS metric, {k}::BIGINT AS cutoff, count(*) AS n_queries_evaluated, count(*) FILTER (n > 1) AS n_with_relevant_tie,
        {r6('count(*) FILTER (n > 1)::DOUBLE / count(*)', 'proportion_with_relevant_tie')}, count(*) FILTER (before < {k} AND before + n > {k}) AS n_tie_blocks_crossing_cutoff,
        count(*) FILTER ({a}) AS n_optimistic_pessimistic_crossings, count(*) FILTER ({a}) AS n_affected, {r6(f'count(*) FILTER ({a})::DOUBLE / count(*)', 'proportion_affected')},
        count(*) FILTER (n > 1 AND NOT ({a})) AS n_tied_not_affected, 'n_better < cutoff and n_better + tie_size > cutoff' AS tie_block_crossing_definition,
        'optimistic_hit_differs_from_pessimistic_hit_at_cutoff; tie_size_greater_than_1_alone_is_not_affected' AS affected_definition FROM {t}"""
        for level, m, t, k in (("fine", "top1", "f1", 1), ("fine", "top5", "f1", 5), ("fine", "top10", "f1", 10), ("coarse", "p_at_1", "f2", 1))
        for a in [f"(before + 1 <= {k}) <> (before + n - h + 1 <= {k})"])
    inside = {k: f"greatest(0, least(n, {k} - before))" for k in (1, 5, 10)}
    sql["tie_aware_precision"] = f"""WITH {EVENTS}, x AS (SELECT *, unnest(generate_series(1, CAST(n AS BIGINT))) AS j FROM runs),
        ap AS (SELECT q, sum(CASE WHEN h > 0 THEN h::DOUBLE / n * (rel_before + 1 + (j - 1) * CASE WHEN n > 1 THEN (h - 1)::DOUBLE / (n - 1) ELSE 0 END) / (before + j) END) AS s FROM x GROUP BY 1),
        t AS (SELECT q, sum(h) AS h, sum(n) AS n, {', '.join(f'sum({inside[k]} * h::DOUBLE / n) AS e{k}' for k in inside)} FROM runs GROUP BY 1)
        SELECT q AS q_pos, {r6('s / h', 'average_precision')}, {', '.join(r6(f'e{k} / least({k}, n)', f'p_at_{k}') for k in inside)} FROM ap JOIN t USING (q) WHERE h > 0"""
    sql["tie_diagnostics"] = f"""WITH {EVENTS} SELECT q AS q_pos, CAST(sum(n) AS BIGINT) AS n_candidates, count(*) AS n_distinct, max(n) AS largest_tie, arg_min(n, d) AS best_tie FROM blk GROUP BY 1"""
    sql["single_target"] = f"""WITH {EVENTS}, t AS (SELECT q, min(l) AS l FROM lists GROUP BY 1), o AS (SELECT lists.q, lists.d AS own FROM lists JOIN t ON lists.q = t.q AND lists.l = t.l),
        c AS (SELECT q, count(*) FILTER (d < own) AS closer, count(*) FILTER (d = own) AS tied FROM lists JOIN o USING (q) GROUP BY 1),
        x AS (SELECT *, unnest(generate_series(0, tied - 1)) AS i FROM c)
        SELECT q AS q_pos, max(closer) + 1 AS best_rank, max(closer + tied) AS worst_rank, {r6('max(greatest(0, least(1, (1 - closer)::DOUBLE / tied)))', 'top1_fractional')}, {r6('avg(1.0::DOUBLE / (closer + 1 + i))', 'rr_fractional')} FROM x GROUP BY 1"""
    sql["replicate_summary"] = f"""SELECT nullif(event_type, 'error') AS event_type, count(*) AS n, count(*) AS n_finite, {r6('avg(value)', 'mean')}, {r6('stddev_samp(value)', 'sd')} FROM events GROUP BY 1"""
    top1 = f"{GRID}, {pair_cosine('d', 'f')}, h AS (SELECT q, l FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, l) AS rn FROM d) WHERE rn = 1)"
    sql["class_metrics"] = f"""WITH {top1}, x AS (SELECT a.label AS t, b.label AS s, count(*) AS n FROM h JOIN meta a ON q = a.vec_id JOIN meta b ON l = b.vec_id WHERE a.label <> b.label GROUP BY 1, 2)
        SELECT 'cosine' AS method, CAST(t AS BIGINT) AS truth, CAST(s AS BIGINT) AS found, n, {r6('n::DOUBLE / sum(n) OVER ()', 'share')}, FALSE AS same_class FROM x"""
    sql["capped_sample"] = "SELECT o_custkey AS grp, least(count(*), 5) AS n FROM orders GROUP BY 1"
    return sql


def _n_bins():
    import math
    return int(math.ceil(math.log(650.0 / 35.0) / math.log1p(2e-6))) + 1
