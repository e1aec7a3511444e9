"""SQL that states the expected result of each registered query, for DuckDB.

Written from the definitions, with whole-series windows, all-pairs distances and
recursive folds, so it shares no plan shape with the Spark side.
"""

from __future__ import annotations

from statistics import NormalDist

ET = ["event_type"]

EVENTS = """ev AS (
  SELECT event_type, ts, event_id, user_id, CAST(value AS DECIMAL(12,2)) AS x, CAST(value >= 150 AS INTEGER) AS label
  FROM events)"""

NUMBERED = EVENTS + """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos,
    count(*) OVER (PARTITION BY event_type) AS n FROM ev)"""


def chrono(src: str = "numbered", out: str = "roles", train: float = 0.6, val: float = 0.2) -> str:
    return f"""{src}_ends AS (
  SELECT *, CAST(floor(n * {train}::DOUBLE) AS BIGINT) AS te,
    CAST(floor(n * {train}::DOUBLE) + floor(n * {val}::DOUBLE) AS BIGINT) AS ve FROM {src}),
{out} AS (
  SELECT * EXCLUDE (pos, n, te, ve),
    CASE WHEN pos < te THEN 'train' WHEN pos < ve THEN 'val' ELSE 'test' END AS role,
    CASE WHEN pos < te THEN pos WHEN pos < ve THEN pos - te ELSE pos - ve END AS pos,
    CASE WHEN pos < te THEN te WHEN pos < ve THEN ve - te ELSE n - ve END AS n FROM {src}_ends)"""


ROLES = NUMBERED + ", " + chrono()


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def symbols(src: str, keys: list[str], a: int, w: int, s: int = 5, tag: str = "") -> str:
    """CTEs segs, letters, steps over a source with keys, pos, n, x, label."""
    k = ", ".join(keys)
    cuts = " + ".join(f"CAST(z > CAST({NormalDist().inv_cdf(i / a)!r} AS DOUBLE) AS INTEGER)" for i in range(1, a))
    return f"""segs{tag} AS (
  SELECT {k}, pos // {s} AS seg, CAST(sum(x) AS DOUBLE) / count(*) AS paa, max(CAST(label = 1 AS INTEGER)) AS seg_label
  FROM {src} WHERE pos < n - n % {s} GROUP BY {k}, pos // {s}),
zs{tag} AS (
  SELECT *, CASE WHEN stddev_pop(paa) OVER q = 0 THEN 0 ELSE (paa - avg(paa) OVER q) / stddev_pop(paa) OVER q END AS z
  FROM segs{tag} WINDOW q AS (PARTITION BY {k})),
letters{tag} AS (SELECT *, chr(97 + {cuts}) AS letter FROM zs{tag}),
runs{tag} AS (
  SELECT {k}, seg, string_agg(letter, '') OVER q AS pattern, max(seg_label) OVER q AS label, count(*) OVER q AS c
  FROM letters{tag} WINDOW q AS (PARTITION BY {k} ORDER BY seg ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)),
steps{tag} AS (
  SELECT {k}, seg, pattern, label, lag(pattern) OVER (PARTITION BY {k} ORDER BY seg) AS prev FROM runs{tag} WHERE c = {w})"""


def model(keys: list[str], tag: str = "", src: str | None = None) -> str:
    """CTEs edges and states from the train steps."""
    k = ", ".join(keys)
    return f"""counts{tag} AS (
  SELECT {k}, prev AS s_from, pattern AS s_to, count(*) AS cnt, min(seg) - 1 AS first_seg
  FROM {src or 'steps' + tag} WHERE role = 'train' AND prev IS NOT NULL GROUP BY {k}, prev, pattern),
edges{tag} AS (SELECT *, CAST(cnt AS DOUBLE) / sum(cnt) OVER (PARTITION BY {k}, s_from) AS p FROM counts{tag}),
states{tag} AS (SELECT {k}, s_from AS state FROM edges{tag} UNION SELECT {k}, s_to FROM edges{tag})"""


def scoring(mkeys: list[str], keys: list[str], tag: str = "", src: str | None = None, threshold: float = 0.05) -> str:
    """CTEs resolved and scored for the steps in `src`; `mkeys` name the model."""
    mk, k = ", ".join(mkeys), ", ".join(keys)
    src = src or f"(SELECT * FROM steps{tag} WHERE role = 'test')"
    on = " AND ".join(f"q.{c} = s.{c}" for c in mkeys)
    same = " AND ".join(f"t.{c} = {{0}}.{c}" for c in mkeys)
    return f"""asked{tag} AS (SELECT DISTINCT {mk}, pattern FROM {src}),
near{tag} AS (
  SELECT {", ".join("q." + c for c in mkeys)}, q.pattern, s.state, levenshtein(q.pattern, s.state) AS dist,
    row_number() OVER (PARTITION BY {", ".join("q." + c for c in mkeys)}, q.pattern
                       ORDER BY levenshtein(q.pattern, s.state), s.state) AS rk
  FROM asked{tag} q LEFT JOIN states{tag} s ON {on}),
resolved{tag} AS (
  SELECT {mk}, pattern, CASE WHEN dist = 0 THEN 'seen' ELSE 'unseen' END AS status,
    CASE WHEN dist > 0 THEN state END AS mapped_to, state AS resolved, dist FROM near{tag} WHERE rk = 1),
scored{tag} AS (
  SELECT {", ".join("t." + c for c in keys)}, t.seg AS time_step, c.resolved AS state, t.pattern, c.status, c.mapped_to,
    CASE WHEN t.prev IS NULL THEN 1.0 ELSE coalesce(e.p, 0.0) END AS probability, t.label,
    CASE WHEN t.prev IS NULL OR coalesce(e.p, 0.0) >= {threshold} THEN 'normal' ELSE 'anomaly' END AS decision
  FROM {src} t
  JOIN resolved{tag} c ON {same.format('c')} AND t.pattern = c.pattern
  LEFT JOIN resolved{tag} b ON {same.format('b')} AND t.prev = b.pattern
  LEFT JOIN edges{tag} e ON {same.format('e')} AND e.s_from = b.resolved AND e.s_to = c.resolved)"""


def metrics(keys: list[str], src: str = "scored", pred: str = "CAST(decision = 'anomaly' AS INTEGER)", out: str = "metrics") -> str:
    k = ", ".join(keys)
    return f"""{out}_cells AS (
  SELECT {k}, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
    count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 0) AS tn
  FROM (SELECT *, {pred} AS pred FROM {src}) GROUP BY {k}),
{out} AS (
  SELECT {k}, tp + fp + fn + tn AS steps, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy,
    CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS precision,
    CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
    CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp::DOUBLE / (2 * tp + fp + fn) END AS f1 FROM {out}_cells)"""


METRIC_COLS = ", ".join(r(c, c) for c in ("accuracy", "precision", "recall", "f1"))
RKEYS = ["event_type", "role"]


def detector(a: int = 4, w: int = 3) -> str:
    """Roles to scored steps for the event series."""
    return f"{ROLES}, {symbols('roles', RKEYS, a, w)}, {model(ET)}, {scoring(ET, ET)}"


SENSOR = """sensor AS (
  SELECT event_id, ts, user_id % 7 AS source_file, 'valve' || (user_id % 2 + 1) AS source_group,
    CAST(value AS DECIMAL(12,2)) AS x, CAST(value >= 150 AS INTEGER) AS label FROM events)"""


def greedy_folds(src: str, group: str, k: int = 5) -> str:
    """CTE folds: each group, largest first, into the lightest fold."""
    return f"""sized AS (
  SELECT {group}, count(*) AS rows, row_number() OVER (ORDER BY count(*) DESC, {group} DESC) AS rn FROM {src} GROUP BY {group}),
walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, [0 FOR i IN range(0, {k})]::BIGINT[] AS loads, CAST(-1 AS BIGINT) AS fold
  UNION ALL
  SELECT walk.rn + 1,
    [CASE WHEN list_position(loads, list_min(loads)) = i + 1 THEN loads[i + 1] + sized.rows ELSE loads[i + 1] END
     FOR i IN range(0, {k})]::BIGINT[],
    CAST(list_position(loads, list_min(loads)) - 1 AS BIGINT)
  FROM walk JOIN sized ON sized.rn = walk.rn + 1),
folds AS (SELECT sized.*, CAST(walk.fold AS INTEGER) AS fold FROM walk JOIN sized USING (rn))"""


FOLDED = SENSOR + ", " + greedy_folds("sensor", "source_file") + """,
each AS (
  SELECT sensor.*, CAST(f.i AS INTEGER) AS fold, folds.fold = f.i AS held
  FROM sensor JOIN folds USING (source_file), range(0, 5) f(i)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY fold, held ORDER BY source_group, source_file, ts, event_id) - 1 AS p0,
    count(*) OVER (PARTITION BY fold, held) AS n0 FROM each),
folded AS (
  SELECT event_id, fold, x, label,
    CASE WHEN held THEN 'test' WHEN p0 >= n0 - floor(n0 * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS role,
    CAST(CASE WHEN NOT held AND p0 >= n0 - floor(n0 * 0.2::DOUBLE) THEN p0 - (n0 - floor(n0 * 0.2::DOUBLE)) ELSE p0 END AS BIGINT) AS pos,
    CAST(CASE WHEN held THEN n0 WHEN p0 >= n0 - floor(n0 * 0.2::DOUBLE) THEN floor(n0 * 0.2::DOUBLE)
         ELSE n0 - floor(n0 * 0.2::DOUBLE) END AS BIGINT) AS n
  FROM placed)"""

FOLD_METRICS = f"""WITH RECURSIVE {FOLDED}, {symbols('folded', ['fold', 'role'], 4, 3)}, {model(['fold'])},
{scoring(['fold'], ['fold'])}, {metrics(['fold'])}"""

FEATURES = """feat AS (
  SELECT event_type, event_id, value AS f1, CAST(hour(ts) AS DOUBLE) AS f2,
    CAST(user_id AS DOUBLE) AS f3, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS f4,
    CAST(value >= 150 AS INTEGER) AS label,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos,
    count(*) OVER (PARTITION BY event_type) AS n FROM events), """ + chrono("feat", "froles")
COLS = ["f1", "f2", "f3", "f4"]


def scale(method: str) -> str:
    if method == "minmax":
        stats = [f"min({c}) AS {c}_shift, max({c}) - min({c}) AS {c}_d" for c in COLS]
    else:
        stats = [f"avg({c}) AS {c}_shift, stddev_pop({c}) AS {c}_d" for c in COLS]
    return f"""fit AS (SELECT event_type, {', '.join(stats)} FROM froles WHERE role = 'train' GROUP BY event_type),
scaled AS (SELECT froles.* REPLACE ({', '.join(f'({c} - {c}_shift) / CASE WHEN {c}_d = 0 THEN 1 ELSE {c}_d END AS {c}' for c in COLS)})
  FROM froles JOIN fit USING (event_type))"""


def axis2(src: str, a: str, b: str, keys: str, out: str = "axis") -> str:
    """First principal axis of two columns: angle atan2(2q, p - r) / 2, larger loading positive."""
    return f"""{out}_m AS (
  SELECT {keys}, avg({a}) AS ma, avg({b}) AS mb, var_pop({a}) AS p, covar_pop({a}, {b}) AS q, var_pop({b}) AS r
  FROM {src} GROUP BY {keys}),
{out}_t AS (SELECT *, atan2(2 * q, p - r) / 2 AS t FROM {out}_m),
{out} AS (
  SELECT {keys}, ma, mb, cos(t) * sg AS wa, sin(t) * sg AS wb FROM (
    SELECT *, CASE WHEN (CASE WHEN round(abs(cos(t)), 9) >= round(abs(sin(t)), 9) THEN cos(t) ELSE sin(t) END) < 0 THEN -1 ELSE 1 END AS sg
    FROM {out}_t))"""


def first_axis(src: str, cols: list[str], key: str, squarings: int = 45) -> str:
    """CTE axis: means m_c and first principal axis w_c, from the covariance squared again and again.

    Powers of the matrix come to the outer product of the axis with itself; the largest loading is positive.
    """
    cells = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    at = lambda a, b: f"a_{a}_{b}" if cols.index(a) <= cols.index(b) else f"a_{b}_{a}"
    means = ", ".join(f"m_{c}" for c in cols)
    out = [f"""sq0 AS (SELECT {key}, {', '.join(f'avg({c}) AS m_{c}' for c in cols)}, {', '.join(f'covar_pop({a}, {b}) AS {at(a, b)}' for a, b in cells)}
  FROM {src} GROUP BY {key})"""]
    for i in range(squarings):
        square = ", ".join(f"{' + '.join(f'{at(a, c)} * {at(c, b)}' for c in cols)} AS {at(a, b)}" for a, b in cells)
        trace = " + ".join(at(c, c) for c in cols)
        out.append(f"sq{i + 1} AS (SELECT {key}, {means}, {', '.join(f'{at(a, b)} / ({trace}) AS {at(a, b)}' for a, b in cells)} FROM (SELECT {key}, {means}, {square} FROM sq{i}))")
    size = {c: f"round(sqrt(greatest({at(c, c)}, 0)), 9)" for c in cols}
    lead = " ".join(f"WHEN {size[c]} = greatest({', '.join(size.values())}) THEN {{{c}}}" for c in cols)
    loadings = ", ".join("CASE " + lead.format(**{p: f"{at(c, p)} / sqrt({at(p, p)})" for p in cols}) + f" END AS w_{c}" for c in cols)
    return ", ".join(out) + f", axis AS (SELECT {key}, {means}, {loadings} FROM sq{squarings})"


PCA = f"{FEATURES}, {scale('minmax')}, ptrain AS (SELECT * FROM scaled WHERE role = 'train'), {first_axis('ptrain', COLS, 'event_type')}"
PCA_FIT = "WITH " + PCA + " SELECT event_type, " + ", ".join(r(f"m_{c}", f"mean_{c}") + ", " + r(f"w_{c}", f"axis_{c}") for c in COLS) + " FROM axis"
PROJECTED = PCA + f""", projected AS (
  SELECT scaled.*, {' + '.join(f'({c} - m_{c}) * w_{c}' for c in COLS)} AS x FROM scaled JOIN axis USING (event_type))"""

ERRORS = f"""{ROLES}, pairs AS (
  SELECT event_type, role, pos AS start, CAST(x AS DOUBLE) AS a, label,
    lead(CAST(x AS DOUBLE)) OVER w AS b, lead(label) OVER w AS end_label FROM roles
  WINDOW w AS (PARTITION BY event_type, role ORDER BY pos)),
ptrain AS (SELECT * FROM pairs WHERE role = 'train' AND b IS NOT NULL), {axis2('ptrain', 'a', 'b', 'event_type')},
errors AS (
  SELECT event_type, role, start, end_label AS label,
    pow((b - mb) * wa - (a - ma) * wb, 2) / 2 AS score
  FROM pairs JOIN axis USING (event_type) WHERE b IS NOT NULL AND role <> 'val')"""


def window_flags(source: str) -> str:
    return f"""limits AS (SELECT event_type, quantile_cont(score, 0.95::DOUBLE) AS threshold FROM errors WHERE role = '{source}' GROUP BY event_type),
wflags AS (
  SELECT event_type, start, start + 1 AS "end", score, label, CAST(score > threshold AS INTEGER) AS pred
  FROM errors JOIN limits USING (event_type) WHERE role = 'test')"""


def compared(aligned: bool) -> str:
    source, on = ("train", '(w."end" // 5) - 2') if aligned else ("test", "w.start")
    return f"""{ERRORS}, {window_flags(source)}, {symbols('roles', RKEYS, 4, 3)}, {model(ET)}, {scoring(ET, ET)},
met AS (
  SELECT w.event_type, w."end", w.label, CAST(s.decision = 'anomaly' AS INTEGER) AS pred_a, w.pred AS pred_b
  FROM wflags w JOIN scored s ON s.event_type = w.event_type AND s.time_step = {on}),
tab AS (
  SELECT event_type, count(*) FILTER (pred_a = label AND pred_b = label) AS both_correct,
    count(*) FILTER (pred_a = label AND pred_b <> label) AS a_only,
    count(*) FILTER (pred_a <> label AND pred_b = label) AS b_only,
    count(*) FILTER (pred_a <> label AND pred_b <> label) AS neither FROM met GROUP BY event_type)"""


MCNEMAR = """, st AS (
  SELECT *, CASE WHEN a_only + b_only = 0 THEN NULL
    ELSE pow(abs(a_only - b_only) - 1, 2)::DOUBLE / (a_only + b_only) END AS statistic FROM tab),
pt AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * sqrt(statistic / 2)) AS t FROM st),
pv AS (SELECT *, t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE
    + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-statistic / 2) AS p_value FROM pt)
SELECT event_type, both_correct, a_only, b_only, neither, """ + r("statistic", "statistic") + ", " + r("p_value", "p_value", 5) + """,
  p_value < 0.05 AS significant FROM pv"""

ROC = detector() + """, pts AS (
  SELECT event_type, 1 - probability AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM scored GROUP BY event_type, 1 - probability),
curve AS (
  SELECT event_type, threshold, pos, neg, sum(pos) OVER q AS tp, sum(neg) OVER q AS fp,
    sum(pos) OVER (PARTITION BY event_type) AS np, sum(neg) OVER (PARTITION BY event_type) AS nn
  FROM pts WINDOW q AS (PARTITION BY event_type ORDER BY threshold DESC)),
roc AS (
  SELECT event_type, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
    CASE WHEN nn = 0 THEN 0 ELSE fp::DOUBLE / nn END AS fpr, CASE WHEN np = 0 THEN 0 ELSE tp::DOUBLE / np END AS tpr FROM curve
  UNION ALL SELECT DISTINCT event_type, NULL, 0, 0, 0.0, 0.0 FROM curve)"""

def uniform(parts: list[str], draw: int = 0) -> str:
    """52 bits of the MD5 digest of the values, as a number in (0, 1)."""
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"((CAST('0x' || substr(md5({text}), {1 + 13 * draw}, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496)"


def normal(parts: list[str]) -> str:
    return f"sqrt(-2 * ln({uniform(parts)})) * cos(2 * pi() * {uniform(parts, 1)})"


LEVELS = (0.0, 0.05, 0.1, 0.2, 0.5)
# The seeds that runs are repeated with.
SEEDS = (42, 123, 2026, 7, 999)


def noisy(col: str, values: tuple, std: str, seed: str) -> str:
    """Train rows as they are, test rows once per noise variant."""
    listed = ", ".join(f"({v})" for v in values)
    cast = "DOUBLE" if col == "std" else "BIGINT"
    return f"""{ROLES}, hundreds AS (SELECT * REPLACE (CAST(x / 100 AS DECIMAL(14,4)) AS x) FROM roles),
variants AS (
  SELECT event_type, 'test' AS role, v.{col}, pos, n, label,
    CAST(x AS DOUBLE) + {std} * {normal(['event_type', 'pos', seed])} AS x
  FROM hundreds, (SELECT CAST(c AS {cast}) AS {col} FROM (VALUES {listed}) t(c)) v WHERE role = 'test'),
base AS (SELECT * FROM hundreds WHERE role = 'train'),
{symbols('base', RKEYS, 4, 3)}, {model(ET)}, {symbols('variants', ['event_type', 'role', col], 4, 3, tag='_v')},
{scoring(ET, ['event_type', col], tag='', src='steps_v')}, {metrics(['event_type', col])}"""


def grid() -> str:
    """One model per window and alphabet, stacked."""
    parts, tables = [ROLES], []
    for w in (3, 4, 5, 6):
        for a in (3, 4, 5, 6):
            t = f"_{w}{a}"
            parts += [
                symbols("roles", RKEYS, a, w, tag=t), model(ET, tag=t),
                scoring(ET, ET, tag=t), metrics(ET, src="scored" + t, out="metrics" + t),
            ]
            tables.append(
                f"SELECT m.event_type, {w} AS window_size, {a} AS alphabet_size,"
                f" CAST(u.c AS DOUBLE) AS unique_states, m.f1 AS f1_score, m.accuracy FROM metrics{t} m"
                f" JOIN (SELECT event_type, count(DISTINCT s_from) AS c FROM edges{t} GROUP BY event_type) u USING (event_type)"
            )
    return ", ".join(parts) + ", grid AS (" + " UNION ALL ".join(tables) + ")"


GRID_COLS = "window_size, alphabet_size, unique_states, " + r("f1_score", "f1_score") + ", " + r("accuracy", "accuracy")

FIRST = """, firsts AS (
  SELECT event_type, s_from, row_number() OVER (PARTITION BY event_type ORDER BY min(first_seg)) AS nth
  FROM edges GROUP BY event_type, s_from),
top20 AS (SELECT event_type, s_from, nth - 1 AS rk FROM firsts WHERE nth <= 20)"""

TWO_SOURCES = """src AS (
  SELECT 'events' AS dataset, ts AS t, event_id AS id, CAST(value AS DECIMAL(12,2)) AS x, CAST(value >= 150 AS INTEGER) AS label FROM events
  UNION ALL
  SELECT 'orders', o_orderdate, o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)), CAST(o_totalprice >= 400000 AS INTEGER) FROM orders),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY t, id) - 1 AS pos, count(*) OVER (PARTITION BY dataset) AS n FROM src),
""" + chrono()
DK = ["dataset"]


DF = ["dataset", "fold"]
BOTH = FOLDED + ", " + TWO_SOURCES + """, both_ AS (
  SELECT 'events' AS dataset, fold, x, label, role, pos, n FROM folded
  UNION ALL SELECT dataset, 0, x, label, role, pos, n FROM roles WHERE dataset = 'orders')"""


def cross_folds(first_only: bool) -> str:
    """Models of every fold, or of the first ones, on the test rows of both datasets."""
    met = "m.fold = 0" if first_only else "(m.dataset <> t.dataset OR m.fold = t.fold)"
    scored = scoring(["train_dataset", "train_fold"], ["train_dataset", "train_fold", *DF], src="pairs")
    return f"""WITH RECURSIVE {BOTH}, {symbols('both_', [*DF, 'role'], 4, 3)}, {model(DF)},
named AS (SELECT dataset AS train_dataset, fold AS train_fold, * EXCLUDE (dataset, fold) FROM edges),
nstates AS (SELECT dataset AS train_dataset, fold AS train_fold, state FROM states),
pairs AS (SELECT m.dataset AS train_dataset, m.fold AS train_fold, t.* FROM steps t, (SELECT DISTINCT dataset, fold FROM edges) m WHERE t.role = 'test' AND {met}),
{scored.replace("JOIN states s", "JOIN nstates s").replace("JOIN edges e", "JOIN named e")}, {metrics(["train_dataset", "train_fold", *DF])}
SELECT train_dataset, {r("avg(f1) FILTER (dataset = 'events')", 'events')}, {r("avg(f1) FILTER (dataset = 'orders')", 'orders')} FROM metrics GROUP BY train_dataset"""


def grid_folds() -> str:
    parts, tables = [BOTH], []
    for w in (3, 5):
        for a in (3, 4):
            t = f"_{w}{a}"
            parts += [symbols("both_", [*DF, "role"], a, w, tag=t), model(DF, tag=t), scoring(DF, DF, tag=t), metrics(DF, src="scored" + t, out="metrics" + t)]
            tables.append(
                f"SELECT dataset, {w} AS window_size, {a} AS alphabet_size, {r('avg(u.c)', 'unique_states')}, {r('avg(f1)', 'f1_score')}, {r('avg(accuracy)', 'accuracy')}"
                f" FROM metrics{t} JOIN (SELECT dataset, fold, count(DISTINCT s_from) AS c FROM edges{t} GROUP BY dataset, fold) u USING (dataset, fold) GROUP BY dataset"
            )
    return "WITH RECURSIVE " + ", ".join(parts) + " " + " UNION ALL ".join(tables)


def oracle_sql() -> dict[str, str]:
    W = "WITH "
    scored_cols = "event_type, time_step, state, pattern, status, mapped_to, " + r("probability", "probability") + ", decision"
    quantile = """lim AS (SELECT event_type, quantile_cont(CAST(x AS DOUBLE), 0.95::DOUBLE) AS threshold FROM numbered GROUP BY event_type)"""
    suppliers = """numbered AS (
      SELECT l_suppkey, CAST(l_extendedprice AS DECIMAL(12,2)) AS x, CAST(l_returnflag = 'R' AS INTEGER) AS label,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS pos,
        count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)"""
    return {
        # sources and sinks
        "grouped_csv": """SELECT event_id, 'valve' || (user_id % 2 + 1) AS source_group, CAST(user_id // 2 % 4 AS INTEGER) AS source_file,
            value AS sensor_0, CAST(user_id AS DOUBLE) AS sensor_1, CAST(value >= 150 AS INTEGER) AS label FROM events""",
        "single_csv": """SELECT event_id, ts AS "DATETIME", value AS sensor_0, CAST(user_id AS DOUBLE) AS sensor_1,
            CAST(value >= 150 AS INTEGER) AS label FROM events""",
        "column_roles": """SELECT event_id, ts AS datetime, CAST(value >= 150 AS INTEGER) AS label, value AS sensor_0,
            CAST(user_id AS DOUBLE) AS sensor_1 FROM events""",
        "column_roles_unlabelled": """SELECT event_id, ts AS datetime, 0 AS label, value AS sensor_0 FROM events""",
        "synthetic_series": f"""WITH made AS (SELECT event_type, n, unnest(range(n)) AS pos FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)),
            waves AS (SELECT *, sin(pos * 20::DOUBLE / greatest(n - 1, 1)) AS wave FROM made)
            SELECT event_type, pos, TIMESTAMP '2026-05-01' + to_minutes(pos) AS ts,
              {r(f"wave + 0.1::DOUBLE * {normal(['event_type', 'pos', '0', '42'])}", 'sensor_0')}, {r(f"wave + 0.1::DOUBLE * {normal(['event_type', 'pos', '1', '42'])}", 'sensor_1')},
              CAST({uniform(['event_type', 'pos', "'label'", '42'])} < 0.05 AS INTEGER) AS label FROM waves""",
        "changepoint": W + NUMBERED + """ SELECT event_type, pos, label,
            CASE WHEN lag(label) OVER (PARTITION BY event_type ORDER BY pos) <> label THEN 1 ELSE 0 END AS changepoint FROM numbered""",
        "features_roundtrip": W + ROLES + " SELECT event_type, role, pos, CAST(x AS DOUBLE) AS x, label FROM roles",
        "labels_times_roundtrip": W + ROLES + " SELECT event_type, role, event_id, ts, label FROM roles",
        "automaton_tables": W + ROLES + ", " + symbols("roles", RKEYS, 4, 3) + ", " + model(ET) + """
            SELECT event_type, s_from, s_to, cnt, first_seg, """ + r("p", "p") + """,
              (SELECT count(*) FROM states s WHERE s.event_type = e.event_type) AS states FROM edges e""",
        "automaton_json": W + ROLES + ", " + symbols("roles", RKEYS, 4, 3) + ", " + model(ET) + f" SELECT s.event_type, s.state AS s_from, s_to, {r('p', 'p')} FROM states s LEFT JOIN edges e ON e.event_type = s.event_type AND e.s_from = s.state",
        "fit_roundtrip": W + FEATURES + ", " + scale("standard") + " SELECT event_type, " + ", ".join(
            f"{r(c + '_shift', c + '_shift')}, {r(c + '_d', c + '_span')}" for c in COLS) + " FROM fit",
        "metrics_files": W + detector() + ", " + metrics(ET) + f""" SELECT event_type, 'symbols' AS experiment, steps, {r('f1', 'f1')}, CAST(NULL AS DOUBLE) AS threshold FROM metrics
            UNION ALL SELECT event_type, 'limits', NULL, NULL, {r("quantile_cont(CAST(x AS DOUBLE), 0.95::DOUBLE)", 'threshold')} FROM numbered GROUP BY event_type""",
        "results_files": W + detector() + ", " + metrics(ET) + f" SELECT event_type, steps, {METRIC_COLS}, format FROM metrics, (VALUES ('json'), ('csv')) f(format)",
        # order and splits
        "positions": W + NUMBERED + " SELECT event_type, event_id, pos, n FROM numbered",
        "positions_one_series": """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events""",
        "positions_many_series": W + suppliers + " SELECT l_suppkey, pos, n, CAST(x AS DOUBLE) AS x FROM numbered",
        "chrono_split": W + ROLES + " SELECT event_type, event_id, role, pos, n FROM roles",
        "group_kfold": "WITH RECURSIVE " + greedy_folds("events", "user_id") + " SELECT user_id, rows, fold FROM folds",
        "fold_roles": "WITH RECURSIVE " + FOLDED + " SELECT event_id, fold, role, pos, n FROM folded",
        "distinct_groups": "SELECT event_type, count(DISTINCT user_id) AS groups FROM events GROUP BY event_type",
        # scaling and projection
        "minmax_fit": W + FEATURES + ", " + scale("minmax") + " SELECT event_type, " + ", ".join(
            f"{r(c + '_shift', c + '_shift')}, {r(c + '_d', c + '_span')}" for c in COLS) + " FROM fit",
        "minmax_apply": W + FEATURES + ", " + scale("minmax") + " SELECT event_type, role, pos, " + ", ".join(r(c, c) for c in COLS) + " FROM scaled",
        "standard_fit": W + FEATURES + ", " + scale("standard") + " SELECT event_type, " + ", ".join(
            f"{r(c + '_shift', c + '_shift')}, {r(c + '_d', c + '_span')}" for c in COLS) + " FROM fit",
        "standard_apply": W + FEATURES + ", " + scale("standard") + " SELECT event_type, role, pos, " + ", ".join(r(c, c) for c in COLS) + " FROM scaled",
        "pca_fit": PCA_FIT,
        "pca_roundtrip": PCA_FIT,
        "pca_apply": W + PROJECTED + f" SELECT event_type, role, pos, {r('x', 'pc_1')} FROM projected",
        # symbols
        "z_normalize": W + NUMBERED + f""" SELECT event_type, pos, {r('''CASE WHEN stddev_pop(CAST(x AS DOUBLE)) OVER q = 0 THEN 0
            ELSE (CAST(x AS DOUBLE) - avg(CAST(x AS DOUBLE)) OVER q) / stddev_pop(CAST(x AS DOUBLE)) OVER q END''', 'z')}
            FROM numbered WINDOW q AS (PARTITION BY event_type)""",
        "paa": W + NUMBERED + ", " + symbols("numbered", ET, 4, 3) + f" SELECT event_type, seg, {r('paa', 'paa')}, seg_label FROM segs",
        "sax_letters": W + NUMBERED + ", " + symbols("numbered", ET, 4, 3) + f" SELECT event_type, seg, {r('z', 'z')}, letter FROM letters",
        "sax_string": W + NUMBERED + ", " + symbols("numbered", ET, 4, 3) + """ SELECT event_type, seg // 65536 AS chunk,
            string_agg(letter, '' ORDER BY seg) AS symbols FROM letters GROUP BY event_type, seg // 65536""",
        "patterns": W + NUMBERED + ", " + symbols("numbered", ET, 4, 3) + " SELECT event_type, seg, pattern FROM steps",
        "unique_states": W + NUMBERED + ", " + symbols("numbered", ET, 4, 3) + " SELECT DISTINCT event_type, pattern AS state FROM steps",
        "pattern_labels": W + NUMBERED + ", " + symbols("numbered", ET, 4, 3) + " SELECT event_type, seg, label FROM steps",
        # automaton
        "transition_counts": W + ROLES + ", " + symbols("roles", RKEYS, 4, 3) + ", " + model(ET) + " SELECT event_type, s_from, s_to, cnt, first_seg FROM counts",
        "transition_probs": W + ROLES + ", " + symbols("roles", RKEYS, 4, 3) + ", " + model(ET) + f" SELECT event_type, s_from, s_to, {r('p', 'p')} FROM edges",
        "state_set": W + ROLES + ", " + symbols("roles", RKEYS, 4, 3) + ", " + model(ET) + " SELECT event_type, state FROM states",
        "source_state_count": W + ROLES + ", " + symbols("roles", RKEYS, 4, 3) + ", " + model(ET) + " SELECT event_type, count(DISTINCT s_from) AS source_states FROM edges GROUP BY event_type",
        "edit_distance": W + ROLES + ", " + symbols("roles", RKEYS, 6, 6) + " SELECT event_type, role, seg, CAST(levenshtein(prev, pattern) AS INTEGER) AS distance FROM steps WHERE prev IS NOT NULL",
        "nearest_state": W + detector(6, 4) + " SELECT event_type, pattern, mapped_to, CAST(dist AS INTEGER) AS distance FROM resolved WHERE status = 'unseen'",
        "nearest_state_12": W + detector(6, 12) + " SELECT event_type, pattern, mapped_to, CAST(dist AS INTEGER) AS distance FROM resolved WHERE status = 'unseen'",
        "nearest_state_no_model": W + detector(6, 4) + " SELECT DISTINCT event_type || '?' AS event_type, pattern, CAST(NULL AS VARCHAR) AS mapped_to, CAST(NULL AS INTEGER) AS distance FROM resolved",
        "nearest_state_all_unseen": W + detector(6, 6) + " SELECT event_type, pattern, mapped_to, CAST(dist AS INTEGER) AS distance FROM resolved WHERE status = 'unseen'",
        "transition_probability": W + detector(6, 4) + f""" SELECT DISTINCT t.event_type, t.prev AS s_from, t.pattern AS s_to, {r('coalesce(e.p, 0)', 'probability')}
            FROM steps t LEFT JOIN edges e ON e.event_type = t.event_type AND e.s_from = t.prev AND e.s_to = t.pattern
            WHERE t.role = 'test' AND t.prev IS NOT NULL""",
        "evaluate_transitions": W + detector(6, 4) + f""" SELECT DISTINCT t.event_type, t.prev AS s_from, t.pattern AS s_to,
            b.status AS s_from_status, b.mapped_to AS s_from_mapped, c.status AS s_to_status, c.mapped_to AS s_to_mapped, {r('coalesce(e.p, 0)', 'probability')}
            FROM steps t JOIN resolved b ON b.event_type = t.event_type AND b.pattern = t.prev
            JOIN resolved c ON c.event_type = t.event_type AND c.pattern = t.pattern
            LEFT JOIN edges e ON e.event_type = t.event_type AND e.s_from = b.resolved AND e.s_to = c.resolved
            WHERE t.role = 'test' AND t.prev IS NOT NULL""",
        "explain_path": W + detector(6, 4) + f" SELECT {scored_cols} FROM scored",
        "explain_path_default": W + detector() + f" SELECT {scored_cols} FROM scored",
        "decisions": W + detector() + " SELECT event_type, decision, count(*) AS steps FROM scored GROUP BY event_type, decision",
        "path_summary": W + detector() + f""" SELECT event_type, {r('coalesce(product(p), 1)', 'path_probability')},
            {r('CASE WHEN min(p) > 0 THEN sum(ln(CASE WHEN p > 0 THEN p END)) END', 'log_probability')}, {r('coalesce(avg(p), 1)', 'confidence')}, count(*) AS steps
            FROM (SELECT *, CASE WHEN time_step > 0 THEN probability END AS p FROM scored) GROUP BY event_type""",
        "justification_json": W + detector(6, 4) + f" SELECT {scored_cols} FROM scored",
        # windows
        "sliding_windows": W + NUMBERED + """ SELECT event_type, pos AS start, w AS "window" FROM (
            SELECT event_type, pos, string_agg(CAST(x AS VARCHAR), ',') OVER q AS w, count(*) OVER q AS c FROM numbered
            WINDOW q AS (PARTITION BY event_type ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) WHERE c = 10""",
        "reconstruction_error": W + ERRORS + f" SELECT event_type, start, {r('score', 'score', 4)} FROM errors WHERE role = 'test'",
        "percentile_threshold": W + NUMBERED + ", " + quantile + f" SELECT event_type, {r('threshold', 'threshold')} FROM lim",
        "flag_above": W + NUMBERED + ", " + quantile + " SELECT event_type, pos, CAST(x > threshold AS INTEGER) AS pred FROM numbered JOIN lim USING (event_type)",
        "detect_windows": W + ERRORS + ", " + window_flags("train") + ', ' + metrics(ET, "wflags", "pred", "wm").replace("SELECT *, pred AS pred FROM", "SELECT * FROM") + f" SELECT event_type, steps, {METRIC_COLS} FROM wm",
        # evaluation
        "align_pairs": W + detector() + " SELECT event_type, time_step, label, CAST(decision = 'anomaly' AS INTEGER) AS pred FROM scored",
        "binary_metrics": W + detector() + ", " + metrics(ET) + f" SELECT event_type, steps, {METRIC_COLS} FROM metrics",
        "confusion_matrix": W + detector() + ", " + metrics(ET) + """ SELECT event_type, 1 AS label, 1 AS pred, tp AS cnt FROM metrics_cells
            UNION ALL SELECT event_type, 0, 1, fp FROM metrics_cells UNION ALL SELECT event_type, 1, 0, fn FROM metrics_cells
            UNION ALL SELECT event_type, 0, 0, tn FROM metrics_cells""",
        "roc_points": W + ROC + f" SELECT event_type, {r('threshold', 'threshold')}, tp, fp, {r('fpr', 'fpr')}, {r('tpr', 'tpr')} FROM roc",
        "auc": W + ROC + f""" SELECT event_type, {r('CASE WHEN max(fpr) > 0 AND max(tpr) > 0 THEN sum(area) END', 'auc')} FROM (
            SELECT event_type, fpr, tpr, (fpr - lag(fpr) OVER q) * (tpr + lag(tpr) OVER q) / 2 AS area FROM roc
            WINDOW q AS (PARTITION BY event_type ORDER BY threshold DESC NULLS FIRST)) GROUP BY event_type""",
        "mcnemar_aligned": W + compared(True) + MCNEMAR,
        "mcnemar_positional": W + compared(False) + MCNEMAR,
        # experiments
        "detect": W + detector() + ", " + metrics(ET) + f" SELECT event_type, steps, {METRIC_COLS} FROM metrics",
        "detect_short_series": W + suppliers.replace("l_suppkey", "l_partkey").replace("l_linenumber, l_partkey)", "l_linenumber, l_suppkey)") + ", " + chrono(train=0.5, val=0.0) + ", " + symbols("roles", ["l_partkey", "role"], 4, 3) + ", " + model(["l_partkey"]) + ", "
            + scoring(["l_partkey"], ["l_partkey"]) + ", " + metrics(["l_partkey"]) + f" SELECT l_partkey, steps, {METRIC_COLS} FROM metrics WHERE steps > 0",
        "detect_many_series": W + suppliers + ", " + chrono() + ", " + symbols("roles", ["l_suppkey", "role"], 4, 3) + ", " + model(["l_suppkey"]) + ", "
            + scoring(["l_suppkey"], ["l_suppkey"]) + ", " + metrics(["l_suppkey"]) + f" SELECT l_suppkey, steps, {METRIC_COLS} FROM metrics",
        "skipped_series": """SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING (CAST(floor(count(*) * 0.6::DOUBLE) AS BIGINT) // 5) < 4""",
        "sensor_pipeline": W + PROJECTED + ", " + symbols("projected", RKEYS, 4, 3) + ", " + model(ET) + ", " + scoring(ET, ET) + ", " + metrics(ET) + f" SELECT event_type, steps, {METRIC_COLS} FROM metrics",
        "fold_metrics": FOLD_METRICS + f" SELECT fold, steps, {METRIC_COLS} FROM metrics",
        "fold_mean": FOLD_METRICS + f" SELECT 'events' AS dataset, {', '.join(r(f'avg({c})', c) for c in ('accuracy', 'precision', 'recall', 'f1'))} FROM metrics",
        "run_all": W + TWO_SOURCES + ", " + symbols("roles", ["dataset", "role"], 4, 3) + ", " + model(DK) + ", " + scoring(DK, DK) + ", " + metrics(DK) + f" SELECT dataset, {METRIC_COLS} FROM metrics",
        "seed_summary": W + noisy("seed", SEEDS, "0.2::DOUBLE", "v.seed") + " SELECT event_type, " + ", ".join(
            f"{r(f'avg({c})', c + '_mean')}, {r(f'stddev_samp({c})', c + '_std')}" for c in ("accuracy", "precision", "recall", "f1")) + " FROM metrics GROUP BY event_type",
        "gaussian_noise": W + NUMBERED + f" SELECT event_type, pos, {r(f'CAST(x AS DOUBLE) + {normal(["event_type", "pos", "7"])}', 'x')} FROM numbered",
        "robustness": W + noisy("std", LEVELS, "v.std", "42") + " SELECT event_type, " + ", ".join(
            r(f"avg(f1) FILTER (std = {s})", "automaton_" + ("original_f1" if s == 0 else f"noise_{s}_f1".replace(".", "_"))) for s in LEVELS) + " FROM metrics GROUP BY event_type",
        "cross_dataset": W + TWO_SOURCES + ", " + symbols("roles", ["dataset", "role"], 4, 3) + ", " + model(DK)
            + """, pairs AS (SELECT m.dataset AS train_dataset, t.* FROM steps t, (SELECT DISTINCT dataset FROM edges) m WHERE t.role = 'test'),
            named AS (SELECT dataset AS train_dataset, * EXCLUDE (dataset) FROM edges), nstates AS (SELECT dataset AS train_dataset, state FROM states), """
            + scoring(["train_dataset"], ["train_dataset", "dataset"], src="pairs").replace("JOIN states s", "JOIN nstates s").replace("JOIN edges e", "JOIN named e")
            + ", " + metrics(["train_dataset", "dataset"])
            + f" SELECT train_dataset, {r(chr(39).join(['max(f1) FILTER (dataset = ', 'events', ')']), 'events')}, {r(chr(39).join(['max(f1) FILTER (dataset = ', 'orders', ')']), 'orders')} FROM metrics GROUP BY train_dataset",
        "cross_dataset_folds": cross_folds(False),
        "cross_dataset_first_fold": cross_folds(True),
        "run_all_folds": f"WITH RECURSIVE {BOTH}, {symbols('both_', [*DF, 'role'], 4, 3)}, {model(DF)}, {scoring(DF, DF)}, {metrics(DF)}"
            + f" SELECT dataset, {', '.join(r(f'avg({c})', c) for c in ('accuracy', 'precision', 'recall', 'f1'))} FROM metrics GROUP BY dataset",
        "grid_search_folds": grid_folds(),
        "grid_search": W + grid() + f" SELECT event_type, {GRID_COLS} FROM grid",
        "report_rows": W + grid() + f" SELECT event_type, {GRID_COLS} FROM (SELECT * FROM grid ORDER BY event_type, window_size, alphabet_size LIMIT 10)",
        "parameter_sensitivity": W + grid() + f" SELECT event_type, alphabet_size, window_size, {r('f1_score', 'f1_score')} FROM grid",
        "transition_heatmap": W + ROLES + ", " + symbols("roles", RKEYS, 4, 3) + ", " + model(ET) + FIRST + " SELECT f.event_type, f.s_from, CAST(f.rk AS INTEGER) AS from_rank, " + ", ".join(
            r(f"coalesce(max(e.p) FILTER (t.rk = {j}), 0)", f"to_{j}") for j in range(20)) + """ FROM top20 f
            LEFT JOIN edges e ON e.event_type = f.event_type AND e.s_from = f.s_from
            LEFT JOIN top20 t ON t.event_type = e.event_type AND t.s_from = e.s_to GROUP BY f.event_type, f.s_from, f.rk""",
        "significant_edges": W + ROLES + ", " + symbols("roles", RKEYS, 4, 3) + ", " + model(ET) + FIRST + f""" SELECT e.event_type, e.s_from, e.s_to, {r('e.p', 'p')} FROM edges e
            SEMI JOIN top20 f ON f.event_type = e.event_type AND f.s_from = e.s_from
            SEMI JOIN top20 t ON t.event_type = e.event_type AND t.s_from = e.s_to WHERE e.p > 0.05""",
        "metrics_summary": W + noisy("seed", SEEDS, "0.2::DOUBLE", "v.seed") + " SELECT 'automaton' AS experiment, " + ", ".join(
            r(f"avg({c})", c) for c in ("accuracy", "precision", "recall", "f1")) + " FROM metrics",
    }
