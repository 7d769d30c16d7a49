"""DuckDB SQL for the registered queries.

Written from the operators' definitions, not from the Spark code: groups are
numbered with plain windows, top-k with sorting, grids with joins.
"""

from __future__ import annotations

import math

TWO_52 = "CAST(4503599627370496 AS DOUBLE)"
NUMERICS = ["temperature", "humidity", "moisture", "nitrogen", "phosphorous", "potassium"]
CLIMATE = NUMERICS[:3]
STRINGS = ["crop_type", "soil_type"]


def u(text: str, lane: int = 0) -> str:
    return f"(CAST(concat('0x', substr(md5({text}), {1 + 13 * lane}, 13)) AS BIGINT) / {TWO_52})"


def text(*parts: str) -> str:
    """SQL string of the parts joined by ':'; parts are SQL expressions."""
    return "concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def lit(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def rnd(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits})"


SAMPLES = """samples AS MATERIALIZED (
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                 CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                 CAST(CAST(round(l_extendedprice*100) AS BIGINT) AS VARCHAR)) AS id,
       CAST(10 + p_size % 31 AS INT) AS temperature,
       CAST(30 + l_partkey % 61 AS INT) AS humidity,
       CAST(20 + l_suppkey % 61 AS INT) AS moisture,
       CAST(l_quantity AS INT) % 43 AS nitrogen,
       CAST(l_orderkey % 20 AS INT) AS potassium,
       CAST(l_partkey % 43 AS INT) AS phosphorous,
       CASE p_type WHEN 'ECONOMY' THEN 'Maize' WHEN 'STANDARD' THEN 'Sugarcane'
                   WHEN 'MEDIUM' THEN 'Cotton' WHEN 'SMALL' THEN 'Paddy'
                   WHEN 'LARGE' THEN 'Wheat' ELSE 'Quinoa' END AS crop_type,
       CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'Loamy' WHEN '2' THEN 'Black'
                   WHEN '3' THEN 'Clayey' WHEN '4' THEN 'Red' ELSE 'Sandy' END AS soil_type,
       concat('class', CAST(l_linenumber AS VARCHAR)) AS label
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""

SPLIT = """train AS (SELECT * FROM samples WHERE substr(md5(concat(id, ':split')), 1, 1) < 'c'),
test AS (SELECT * FROM samples WHERE substr(md5(concat(id, ':split')), 1, 1) >= 'c')"""

AUX = f"""aux AS (SELECT id, crop_type, soil_type, nitrogen, potassium, phosphorous,
  CASE WHEN {u(text('id', "'aux'"))} < 0.3 THEN concat(label, 'x') ELSE label END AS label FROM test),
kept AS (SELECT * FROM aux WHERE label IN (SELECT label FROM train))"""

COMBO = "concat(coalesce(crop_type, 'nan'), '_', coalesce(soil_type, 'nan'))"


def score_cte(name: str = "scores", model: str = "p") -> str:
    return f"""{name} AS MATERIALIZED (SELECT id, label, y, class_idx,
  round(0.0001::DOUBLE + 0.9::DOUBLE * {u(text('id', f"'{model}'", 'class_idx'))} / 7
    + CASE WHEN class_idx = y AND {u(text('id', "'hit'"))} < 0.9
           THEN 0.3::DOUBLE + 0.55::DOUBLE * {u(text('id', "'lift'"))} ELSE 0 END, 6) AS p
FROM (SELECT id, label, CAST(substr(label, 6, 1) AS INT) - 1 AS y FROM samples) a
CROSS JOIN (SELECT CAST(unnest(range(0, 7)) AS INT) AS class_idx) b)"""


PLACED = """placed AS MATERIALIZED (SELECT *, row_number() OVER
  (PARTITION BY id ORDER BY p DESC, class_idx DESC) AS place FROM scores)"""
ARGMAX = """best AS (SELECT id, class_idx FROM (SELECT *, row_number() OVER
  (PARTITION BY id ORDER BY p DESC, class_idx) AS r FROM scores) WHERE r = 1)"""
AP = """ap AS (SELECT id, label, y, CASE WHEN place <= 3 THEN CAST(1 AS DOUBLE) / place ELSE 0 END AS ap
  FROM placed WHERE class_idx = y)"""


def query(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([SAMPLES, *ctes]) + "\n" + select


def wide(source: str, value: str = "p", digits: int = 9) -> str:
    cols = ", ".join(
        f"round(max(CASE WHEN class_idx = {i} THEN {value} END), {digits}) AS p{i}" for i in range(7)
    )
    return f"SELECT id, {cols} FROM {source} GROUP BY id"


# --- feature formulas --------------------------------------------------------

N, P, K = (f"CAST({c} AS DOUBLE)" for c in ("nitrogen", "phosphorous", "potassium"))
T, H, M = (f"CAST({c} AS DOUBLE)" for c in CLIMATE)
NP, NK, PK = f"({N}/({P}+1e-8))", f"({N}/({K}+1e-8))", f"({P}/({K}+1e-8))"
MEAN = f"(({N}+{P}+{K})/3)"
STD = f"sqrt((pow({N}-{MEAN},2)+pow({P}-{MEAN},2)+pow({K}-{MEAN},2))/2)"

ENV = {
    "env_max": "greatest(temperature, humidity, moisture)",
    "temp_humidity_index": rnd(f"{T}*{H}/100"),
    "climate_comfort": rnd(f"({T}+{H}+{M})/3"),
    "temp_stress": "CAST(temperature < 20 OR temperature > 35 AS INT)",
    "humidity_stress": "CAST(humidity < 40 OR humidity > 80 AS INT)",
    "moisture_stress": "CAST(moisture < 30 OR moisture > 70 AS INT)",
}
NPK = {
    "N_P_ratio": rnd(f"least(greatest({NP}, 0), 10)"),
    "N_K_ratio": rnd(f"least(greatest({NK}, 0), 10)"),
    "P_K_ratio": rnd(f"least(greatest({PK}, 0), 10)"),
    "Total_NPK": "nitrogen + phosphorous + potassium",
    "NPK_balance": rnd(STD),
    "NPK_17_17_17_score": rnd(f"1/(1+abs({NP}-1)+abs({NK}-1))"),
    "NPK_28_28_score": rnd(f"1/(1+abs({NP}-1))"),
    "NPK_10_26_26_score": rnd(f"1/(1+abs({NP}-0.38::DOUBLE)+abs({PK}-1))"),
    "NPK_20_20_score": rnd(f"1/(1+abs({NP}-1))"),
    "NPK_14_35_14_score": rnd(f"1/(1+abs({NP}-0.4::DOUBLE)+abs({NK}-1))"),
    "DAP_score": rnd(f"1/(1+abs({NP}-0.78::DOUBLE))"),
    "Urea_score": rnd(f"{N}/({N}+{P}+{K}+1e-8)"),
}
SUITABLE = {
    "temp_suitability": """CAST(CASE crop_type WHEN 'Maize' THEN temperature BETWEEN 25 AND 32
      WHEN 'Sugarcane' THEN temperature BETWEEN 26 AND 35
      WHEN 'Cotton' THEN temperature BETWEEN 25 AND 35
      WHEN 'Paddy' THEN temperature BETWEEN 25 AND 35
      WHEN 'Wheat' THEN temperature BETWEEN 20 AND 30
      ELSE temperature BETWEEN 20 AND 32 END AS INT)"""
}
STRENGTH = {
    "Crop_Soil_combo": COMBO,
    "crop_soil_strength": f"""CAST(CASE WHEN {COMBO} IN ('Maize_Loamy','Sugarcane_Black','Cotton_Black',
      'Paddy_Clayey','Wheat_Loamy') THEN 1.0 WHEN {COMBO} IN ('Maize_Black','Sugarcane_Red',
      'Cotton_Red','Paddy_Loamy','Wheat_Black') THEN 0.8 ELSE 0.5 END AS DOUBLE)""",
}
EXTRA = {
    "NPK_polynomial": rnd(f"{N}*{N}+{P}*{P}+{K}*{K}"),
    "NPK_log_sum": rnd(f"ln(1+{N}+{P}+{K})"),
    "env_polynomial": rnd(f"{T}*{T}+{H}*{H}+{M}*{M}"),
    "temp_humidity_interaction": rnd(f"{T}*{H}/1000"),
    "advanced_crop_suitability": rnd(
        f"""1/(1+abs({T} - CASE crop_type WHEN 'Sugarcane' THEN 30 WHEN 'Maize' THEN 28
        WHEN 'Wheat' THEN 25 WHEN 'Paddy' THEN 30 WHEN 'Cotton' THEN 30 ELSE 27 END))"""
    ),
    "fertilizer_effectiveness": rnd(f"exp(-0.1::DOUBLE*{STD})"),
    "NPK_harmonic_mean": rnd(f"3/(1/greatest({N},1)+1/greatest({P},1)+1/greatest({K},1))"),
    "env_npk_interaction": rnd(
        f"CAST(greatest(temperature, humidity, moisture) AS DOUBLE)*({N}+{P}+{K})/1000"
    ),
}


def cols(exprs: dict[str, str]) -> str:
    return ", ".join(f'{e} AS "{n}"' for n, e in exprs.items())


def edge_list(source: str, bins: int, columns: list[str], value=lambda c: c) -> str:
    probs = "[" + ", ".join(str(i / bins) for i in range(bins + 1)) + "]"
    return ", ".join(
        f"(SELECT list_sort(list_distinct(quantile_cont(CAST({value(c)} AS DOUBLE), {probs}))) FROM {source}) AS {c}"
        for c in columns
    )


def code(x: str, edges: str) -> str:
    return f"""CASE WHEN {x} IS NULL OR len({edges}) < 2 THEN NULL ELSE
      CAST(len(list_filter({edges}[2:len({edges})-1], lambda e: e < {x})) AS INT) END"""


def base_ctes() -> list[str]:
    return [
        SPLIT,
        f"e10 AS MATERIALIZED (SELECT {edge_list('train', 10, NUMERICS)})",
        f"e5 AS MATERIALIZED (SELECT {edge_list('train', 5, CLIMATE)})",
        "med AS MATERIALIZED (SELECT "
        + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}" for c in NUMERICS)
        + " FROM train)",
        "flagged AS MATERIALIZED (SELECT "
        + ", ".join(f"CAST(t.{c} > med.{c} AS INT) AS {c}" for c in NUMERICS)
        + " FROM train t, med)",
        f"ef AS MATERIALIZED (SELECT {edge_list('flagged', 10, NUMERICS)})",
        "base AS MATERIALIZED (SELECT s.*, "
        + ", ".join(
            f"{code(f's.{c}', f'e10.{c}')} AS {c}_cat, CAST(s.{c} > med.{c} AS INT) AS {c}_high, "
            f"{code(f'CAST(s.{c} > med.{c} AS INT)', f'ef.{c}')} AS {c}_high_cat"
            for c in NUMERICS
        )
        + ", "
        + ", ".join(f"{code(f's.{c}', f'e5.{c}')} AS {c}_zone" for c in CLIMATE)
        + " FROM samples s, e10, e5, med, ef)",
        "full_base AS MATERIALIZED (SELECT *, 1 AS const, "
        + cols({**ENV, **NPK, **SUITABLE, **STRENGTH})
        + " FROM base)",
    ]


BASE_NAMES = (
    NUMERICS
    + STRINGS
    + [f"{c}_{s}" for c in NUMERICS for s in ("cat", "high", "high_cat")]
    + [f"{c}_zone" for c in CLIMATE]
    + ["const", *ENV, *NPK, *SUITABLE, *STRENGTH]
)


def kind(name: str) -> str:
    for parts, k in (
        (("_cat", "_zone"), "categorical_binned"),
        (("_ratio",), "npk_ratio"),
        (("_score",), "fertilizer_score"),
        (("env_",), "environmental"),
    ):
        if any(p in name for p in parts):
            return k
    return "constant" if name == "const" else "original"


# --- augmentation ------------------------------------------------------------

STRATUM = text(*STRINGS)


def mix_ctes(source: str) -> list[str]:
    """Pairs by plain row numbers over whole strata."""
    draw_text = f"concat({STRATUM}, ':mix:42:', CAST(draw AS VARCHAR))"
    return [
        f"""ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY crop_type, soil_type
  ORDER BY md5(concat(id, ':mix:42')), id) - 1 AS place FROM {source})""",
        "sizes AS (SELECT crop_type, soil_type, count(*) AS n FROM ranked GROUP BY ALL HAVING count(*) >= 2)",
        """draws AS (SELECT crop_type, soil_type, n,
  unnest(range(1, least(n // 2, 10) + 1)) AS draw FROM sizes)""",
        f"""picks AS (SELECT *, CAST(floor({u(draw_text)} * n) AS BIGINT) AS r1,
  CAST(floor({u(draw_text, 1)} * (n - 1)) AS BIGINT) AS step FROM draws)""",
        """pairs AS MATERIALIZED (SELECT p.crop_type, p.soil_type, CAST(draw AS INT) AS draw,
  a.id AS id_a, b.id AS id_b
  FROM picks p
  JOIN ranked a ON a.crop_type = p.crop_type AND a.soil_type = p.soil_type AND a.place = r1
  JOIN ranked b ON b.crop_type = p.crop_type AND b.soil_type = p.soil_type
    AND b.place = (r1 + 1 + step) % n)""",
    ]


def lam() -> str:
    tries = []
    for i in range(16):
        t = f"concat({STRATUM}, ':lam:42:', CAST(draw AS VARCHAR), ':{i}')"
        x, y = f"pow({u(t)}, 5)", f"pow({u(t, 1)}, 5)"
        tries.append(f"CASE WHEN {x}+{y} <= 1 AND {x}+{y} > 0 THEN {x}/({x}+{y}) END")
    return f"coalesce({', '.join(tries)}, 0.5::DOUBLE)"


def mixed_ctes(source: str, more: str = "") -> list[str]:
    mixed = ", ".join(f"lam*a.{c}+(1-lam)*b.{c} AS {c}" for c in NUMERICS)
    return mix_ctes(source) + [
        f"weighted AS MATERIALIZED (SELECT *, {lam()} AS lam FROM pairs)",
        f"""mixed AS (SELECT concat('mix:', w.crop_type, ':', w.soil_type, ':', CAST(draw AS VARCHAR)) AS id,
  w.crop_type, w.soil_type, CASE WHEN lam > 0.5 THEN a.label ELSE b.label END AS label, {mixed} {more}
  FROM weighted w JOIN {source} a ON a.id = id_a JOIN {source} b ON b.id = id_b)""",
    ]


def jitter(c: str, place: int) -> str:
    t = text("id", "'jitter'", "42", "copy", str(place // 2))
    trig = "sin" if place % 2 else "cos"
    z = f"sqrt(-2*ln(1-{u(t)}))*{trig}({lit(2 * math.pi)}*{u(t, 1)})"
    return f"CASE WHEN copy = 0 THEN CAST({c} AS DOUBLE) ELSE greatest({c}*(1+0.01::DOUBLE*{z}), 0) END"


COPIES = "(SELECT CAST(unnest(range(0, 3)) AS INT) AS copy)"


def folds(source: str, k: int = 5) -> str:
    return f"""folded AS MATERIALIZED (SELECT *, CAST((row_number() OVER (PARTITION BY label
  ORDER BY md5(concat(id, ':42')), id) - 1) % {k} AS INT) AS fold FROM {source})"""


def coded(source: str = "train") -> list[str]:
    return [
        f"""dict AS (SELECT label, CAST(row_number() OVER (ORDER BY f) - 1 AS INT) AS code
  FROM (SELECT label, min(id) AS f FROM {source} GROUP BY label))""",
        f"coded AS MATERIALIZED (SELECT s.*, code, {COMBO} AS combo FROM {source} s JOIN dict USING (label))",
    ]


# --- calibration -------------------------------------------------------------


def loss(p: str, t: str) -> str:
    a, b = f"pow({p}, 1/{t})", f"pow(1-{p}, 1/{t})"
    return f"-ln(least(greatest({a}/({a}+{b}), 1e-15::DOUBLE), 1-1e-15::DOUBLE))"


def fit_ctes(rounds: int, points: int = 20) -> list[str]:
    out = [
        "own AS MATERIALIZED (SELECT y, p FROM scores WHERE class_idx = y)",
        "grid AS (SELECT CAST(unnest(range(0, 20)) AS INT) AS point)",
        "span0 AS (SELECT y, 0.1::DOUBLE AS lo, 10::DOUBLE AS hi FROM own GROUP BY y)",
    ]
    for r in range(rounds):
        out += [
            f"""g{r} AS MATERIALIZED (SELECT y, point, lo, hi, lo + (hi - lo) * point / {points - 1} AS t
  FROM span{r}, grid)""",
            f"""l{r} AS MATERIALIZED (SELECT g.y, point, t, avg({loss('p', 't')}) AS loss
  FROM g{r} g JOIN own USING (y) GROUP BY g.y, point, t)""",
            f"b{r} AS (SELECT y, point, t FROM l{r} QUALIFY row_number() OVER (PARTITION BY y ORDER BY loss, point) = 1)",
            f"""span{r + 1} AS (SELECT b.y,
  (SELECT t FROM g{r} g WHERE g.y = b.y AND g.point = greatest(b.point - 1, 0)) AS lo,
  (SELECT t FROM g{r} g WHERE g.y = b.y AND g.point = least(b.point + 1, {points - 1})) AS hi FROM b{r} b)""",
        ]
    return out


FACTORS = (0.5, 0.7, 0.85, 0.95, 1.05, 1.15, 1.4, 2.0)
PLANTED = f"""planted AS (SELECT id, concat('class', CAST(1 + CAST(CASE WHEN {u(text('id', "'plant'"))} < 0.75
  THEN (ascii(crop_type) + ascii(soil_type) + nitrogen // 15) % 7
  ELSE floor({u(text('id', "'noise'"))} * 7) END AS INT) AS VARCHAR)) AS label,
  substr(md5(concat(id, ':split')), 1, 1) < 'c' AS is_train FROM samples)"""


def weight_rounds(most: int) -> list[str]:
    """Coordinate search of class weights, one CTE per round; once no move helps, nothing changes.

    Precisions are counted in sixths, so sums are whole numbers.
    """
    rival = "list_transform(range(0, 7), lambda j: p[j + 1] * w[j + 1] * CASE WHEN j = moved THEN factor ELSE 1::DOUBLE END)"
    out = [
        "wide AS MATERIALIZED (SELECT id, any_value(y) AS y, list(p ORDER BY class_idx) AS p FROM scores GROUP BY id)",
        f"moves AS MATERIALIZED (SELECT CAST(m.i AS INT) AS moved, f.x AS factor FROM (SELECT unnest(range(0, 7)) AS i) m, (SELECT unnest([{', '.join(lit(f) for f in FACTORS)}]) AS x) f)",
        """base AS MATERIALIZED (SELECT sum(CASE WHEN ahead < 3 THEN 6 // (ahead + 1) ELSE 0 END) AS score, count(*) AS n FROM
  (SELECT len(list_filter(range(0, 7), lambda j: p[j + 1] > p[y + 1] OR (p[j + 1] = p[y + 1] AND j > y))) AS ahead FROM wide))""",
        "s0 AS MATERIALIZED (SELECT list_transform(range(0, 7), lambda j: 1::DOUBLE) AS w, score, n, 0 AS steps FROM base)",
    ]
    for r in range(most):
        out.append(
            f"""c{r} AS MATERIALIZED (SELECT moved, factor, sum(CASE WHEN ahead < 3 THEN 6 // (ahead + 1) ELSE 0 END) AS score FROM
  (SELECT moved, factor, len(list_filter(range(0, 7), lambda j: x[j + 1] > x[y + 1] OR (x[j + 1] = x[y + 1] AND j > y))) AS ahead FROM
   (SELECT moved, factor, y, {rival} AS x FROM wide, moves, s{r} WHERE steps = {r})) GROUP BY moved, factor)"""
        )
        out.append(
            f"""t{r} AS MATERIALIZED (SELECT moved, factor, c.score, list_transform(range(0, 7), lambda j: w[j + 1] * CASE WHEN j = moved THEN factor ELSE 1::DOUBLE END) AS u
  FROM c{r} c, s{r} s WHERE c.score > s.score)"""
        )
        out.append(
            f"""m{r} AS MATERIALIZED (SELECT list_transform(u, lambda x: x * 7 / list_sum(u)) AS w, score FROM t{r}
  WHERE len(list_filter(u, lambda x: x * 7 / list_sum(u) < 0.1 OR x * 7 / list_sum(u) > 5)) = 0 ORDER BY score DESC, moved, factor LIMIT 1)"""
        )
        out.append(
            f"""s{r + 1} AS MATERIALIZED (SELECT coalesce(m.w, s.w) AS w, coalesce(m.score, s.score) AS score, s.n,
  s.steps + CASE WHEN m.w IS NULL THEN 0 ELSE 1 END AS steps FROM s{r} s LEFT JOIN m{r} m ON true)"""
        )
    return out


def weight_table() -> str:
    """Class weights after each move of the first search round, as VALUES."""
    rows = [
        f"({moved}, {lit(f)}, {c}, {lit(f if c == moved else 1.0)})"
        for moved in range(7)
        for f in (0.5, 0.7, 0.85, 0.95, 1.05, 1.15, 1.4, 2.0)
        for c in range(7)
    ]
    return "weights(moved, factor, class_idx, w) AS (VALUES " + ", ".join(rows) + ")"


WEIGHT_ROUNDS = 20


def build(fit_rounds: int, shown_temperatures: list[float], model_folds: int) -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_samples"] = query("SELECT * FROM samples")
    q["dataset_summary"] = query(
        """SELECT 'train' AS split, count(*) AS n_rows FROM train
           UNION ALL SELECT 'test', count(*) FROM test""",
        SPLIT,
    )
    q["rename_typo"] = query("SELECT id, temperature FROM samples")
    q["known_class_filter"] = query("SELECT id, label FROM kept", SPLIT, AUX)
    q["align_columns"] = query("SELECT id, nitrogen, crop_type, label FROM samples")
    q["combine_features"] = query(
        f"""SELECT id, {', '.join(NUMERICS)}, CAST(0 AS DOUBLE) AS "NPK_polynomial",
        {cols({k: EXTRA[k] for k in ('NPK_log_sum', 'env_polynomial', 'temp_humidity_interaction')})}
        FROM samples"""
    )
    gaps = """gaps AS (SELECT id, temperature, humidity, moisture, nullif(nitrogen, 0) AS nitrogen,
      nullif(potassium, 7) AS potassium, phosphorous, nullif(crop_type, 'Quinoa') AS crop_type,
      soil_type, label, substr(md5(concat(id, ':split')), 1, 1) < 'c' AS is_train FROM samples)"""
    q["null_report"] = query(
        " UNION ALL ".join(
            f"""SELECT '{frame}' AS frame, '{c}' AS column_name, count(*) - count({c}) AS n_missing
            FROM gaps WHERE is_train = {flag} HAVING count(*) > count({c})"""
            for frame, flag in (("train", "true"), ("test", "false"))
            for c in [*NUMERICS, *STRINGS, "id", "label"]
        ),
        gaps,
    )
    q["schema_diff"] = query(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature,
            {'NULL' if c == 'extra' else f'count({c}) FILTER (is_train)'} AS train_values,
            {'NULL' if c == 'moisture' else f"count({'humidity' if c == 'extra' else c}) FILTER (NOT is_train)"} AS test_values,
            {int(c != 'extra')} AS in_train, {int(c != 'moisture')} AS in_test FROM gaps"""
            for c in [*NUMERICS, *STRINGS, "extra"]
        ),
        gaps,
    )
    q["label_distribution"] = query(
        """SELECT label, n, CAST((SELECT min(n) = max(n) FROM c) AS INT) AS balanced FROM c""",
        "c AS (SELECT label, count(*) AS n FROM samples GROUP BY label)",
    )
    q["replicate_rows"] = query(f"SELECT id, label, copy FROM samples CROSS JOIN {COPIES}")
    q["expand_training"] = query(
        f"""SELECT id, temperature, humidity, moisture, nitrogen, potassium, phosphorous, crop_type,
        soil_type, label, copy FROM train CROSS JOIN {COPIES}
        UNION ALL SELECT id, NULL, NULL, NULL, nitrogen, potassium, phosphorous, crop_type, soil_type,
        label, copy FROM kept CROSS JOIN (SELECT CAST(unnest(range(0, 2)) AS INT) AS copy)""",
        SPLIT,
        AUX,
    )
    q["base_features"] = query("SELECT * FROM full_base", *base_ctes())
    q["env_features"] = query(
        f"SELECT id, {cols(ENV)}, {', '.join(f'{c}_zone' for c in CLIMATE)} FROM zoned",
        f"e5 AS MATERIALIZED (SELECT {edge_list('samples', 5, CLIMATE)})",
        f"""zoned AS (SELECT s.*, {', '.join(f"{code(f's.{c}', f'e5.{c}')} AS {c}_zone" for c in CLIMATE)}
        FROM samples s, e5)""",
    )
    q["npk_features"] = query(f"SELECT id, {cols(NPK)} FROM samples")
    q["temp_suitability"] = query(f"SELECT id, {cols(SUITABLE)} FROM samples")
    q["crop_soil_strength"] = query(f"SELECT id, {cols(STRENGTH)} FROM samples")
    q["hill_features"] = query(
        f"SELECT id, {cols({'env_max': ENV['env_max'], 'Total_NPK': NPK['Total_NPK'], **EXTRA})} FROM samples"
    )
    q["threshold_flags"] = query(
        "SELECT id, "
        + ", ".join(f"CAST(s.{c} > med.{c} AS INT) AS {c}_high" for c in NUMERICS)
        + " FROM samples s, med",
        "med AS (SELECT " + ", ".join(f"median({c}) AS {c}" for c in NUMERICS) + " FROM samples)",
    )
    q["quantile_edges"] = query(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, CAST({b} AS BIGINT) AS bins,
            unnest(range(0, len({c}))) AS place, round(unnest({c}), 6) AS edge FROM q{b}"""
            for c in NUMERICS
            for b in (5, 10, 20)
        ),
        *[f"q{b} AS MATERIALIZED (SELECT {edge_list('samples', b, NUMERICS)})" for b in (5, 10, 20)],
    )
    q["quantile_bins"] = query(
        "SELECT id, " + ", ".join(f"{code(f's.{c}', f'e.{c}')} AS {c}_cat" for c in NUMERICS)
        + " FROM samples s, e",
        f"e AS MATERIALIZED (SELECT {edge_list('samples', 20, NUMERICS)})",
    )
    q["equal_width_bins"] = query(
        "SELECT id, " + ", ".join(f"{code(f's.{c}', f'e.{c}')} AS {c}_cat" for c in NUMERICS)
        + " FROM samples s, e",
        "r AS (SELECT "
        + ", ".join(
            f"min({c})::DOUBLE AS lo_{c}, max({c})::DOUBLE AS hi_{c}" for c in NUMERICS
        )
        + " FROM samples)",
        "e AS MATERIALIZED (SELECT "
        + ", ".join(
            f"list_transform(range(0, 21), lambda j: lo_{c} + (hi_{c} - lo_{c}) * j / 20) AS {c}"
            for c in NUMERICS
        )
        + " FROM r)",
    )
    cats = [
        n
        for n in BASE_NAMES
        if n in (*STRINGS, "Crop_Soil_combo")
        or any(p in n for p in ("_cat", "_zone", "_high", "_stress", "_suitability"))
    ]
    q["categorical_columns"] = query(
        " UNION ALL ".join(
            f"""SELECT '{n}' AS column_name, count(DISTINCT "{n}") AS n_levels,
            count("{n}") AS n_values FROM full_base"""
            for n in cats
        ),
        *base_ctes(),
    )
    q["feature_catalog"] = query(
        " UNION ALL ".join(
            f"""SELECT '{n}' AS feature, '{kind(n)}' AS kind, count("{n}") AS n_values FROM full_base"""
            for n in BASE_NAMES
        ),
        *base_ctes(),
    )
    q["factorize_labels"] = query(
        """SELECT label, CAST(row_number() OVER (ORDER BY f) - 1 AS INT) AS code, n_rows
        FROM (SELECT label, min(id) AS f, count(*) AS n_rows FROM samples GROUP BY label)"""
    )
    q["label_index"] = query(
        "SELECT id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INT) AS class_idx FROM samples"
    )
    names = {"crop_type": "crop_type", "soil_type": "soil_type", "Crop_Soil_combo": COMBO}
    q["category_codes"] = query(
        "SELECT id, "
        + ", ".join(f'coalesce(d_{n}.code, -1) AS "{n}_code"' for n in names)
        + " FROM samples "
        + " ".join(f"LEFT JOIN d_{n} ON d_{n}.v = {e}" for n, e in names.items()),
        SPLIT,
        *[
            f"""d_{n} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code
            FROM (SELECT DISTINCT {e} AS v FROM train WHERE crop_type <> 'Cotton'))"""
            for n, e in names.items()
        ],
    )
    q["stratified_folds"] = query("SELECT id, label, fold FROM folded", folds("samples"))
    q["target_encode_apply"] = query(
        f"""SELECT id, {COMBO} AS "Crop_Soil_combo",
        round(coalesce(e, (SELECT avg(code) FROM seen)), 9) AS encoded
        FROM test LEFT JOIN enc ON enc.combo = {COMBO}""",
        SPLIT,
        *coded(),
        "seen AS (SELECT * FROM coded WHERE combo <> 'Wheat_Red')",
        "enc AS (SELECT combo, avg(code) AS e FROM seen GROUP BY combo)",
    )
    q["target_encode_oof"] = query(
        """SELECT id, combo AS "Crop_Soil_combo", fold,
        round(coalesce((t.s - p.s) / nullif(t.n - p.n, 0), (SELECT avg(code) FROM coded)), 9) AS encoded
        FROM folded f JOIN parts p USING (combo, fold) JOIN totals t USING (combo)""",
        SPLIT,
        *coded(),
        folds("coded"),
        "parts AS (SELECT combo, fold, sum(code)::DOUBLE AS s, count(*) AS n FROM folded GROUP BY ALL)",
        "totals AS (SELECT combo, sum(s) AS s, sum(n) AS n FROM parts GROUP BY combo)",
    )
    jittered = ["nitrogen", "phosphorous", "potassium"] + [
        n for n in NPK if "npk" in n.lower()
    ]
    q["jitter_columns"] = query(
        " UNION ALL ".join(
            f"SELECT '{n}' AS column_name, count(\"{n}\") AS n_values FROM npk" for n in jittered
        ),
        SPLIT,
        f"npk AS (SELECT *, {cols(NPK)} FROM train)",
    )
    nutrients = ["nitrogen", "phosphorous", "potassium"]
    q["jitter_expand"] = query(
        "SELECT id, copy, "
        + ", ".join(f"round({jitter(c, i)}, 6) AS {c}" for i, c in enumerate(nutrients))
        + f" FROM samples CROSS JOIN {COPIES}"
    )
    q["mixup_pairs"] = query(
        "SELECT crop_type, soil_type, draw, id_a, id_b FROM pairs", *mix_ctes("samples")
    )
    q["mixup"] = query(
        "SELECT id, crop_type, soil_type, label, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in NUMERICS)
        + " FROM mixed",
        *mixed_ctes("samples"),
    )
    # Nutrients are jittered in the frame's column order: nitrogen, potassium, phosphorous.
    in_order = ["nitrogen", "potassium", "phosphorous"]
    outs = ", ".join(f"round({c}, 6) AS {c}" for c in NUMERICS)
    q["augment_all"] = query(
        f"""SELECT id, crop_type, soil_type, label, copy, source, {outs} FROM expanded
        UNION ALL BY NAME SELECT id, crop_type, soil_type, label, copy, CAST(NULL AS VARCHAR) AS source, {outs} FROM mixed""",
        "expanded AS MATERIALIZED (SELECT concat(id, '#', CAST(copy AS VARCHAR)) AS id, id AS source, "
        "crop_type, soil_type, label, copy, "
        + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in CLIMATE)
        + ", "
        + ", ".join(f"{jitter(c, i)} AS {c}" for i, c in enumerate(in_order))
        + f" FROM samples CROSS JOIN {COPIES})",
        *mixed_ctes("expanded", ", a.copy"),
    )
    q["top3_array"] = query(
        "SELECT id, "
        + ", ".join(f"max(CASE WHEN place = {i} THEN class_idx END) AS top{i}" for i in (1, 2, 3))
        + " FROM placed GROUP BY id",
        score_cte(),
        PLACED,
    )
    q["map_at_3"] = query(
        "SELECT count(*) AS n_rows, round(avg(ap), 9) AS map_at_3 FROM ap", score_cte(), PLACED, AP
    )
    hits = "hits AS (SELECT id, CAST(best.class_idx = y AS DOUBLE) AS hit FROM best JOIN ap USING (id))"
    q["accuracy_top1"] = query(
        "SELECT count(*) AS n_rows, round(avg(hit), 9) AS accuracy FROM hits",
        score_cte(),
        PLACED,
        ARGMAX,
        AP,
        hits,
    )
    q["fold_score_stats"] = query(
        """SELECT round(avg(m), 9) AS map_at_3_mean, round(avg(a), 9) AS accuracy_mean,
        round(stddev_pop(m), 9) AS map_at_3_std, round(stddev_pop(a), 9) AS accuracy_std FROM per""",
        score_cte(),
        PLACED,
        ARGMAX,
        AP,
        hits,
        folds("samples"),
        """per AS (SELECT fold, avg(ap) AS m, avg(hit) AS a
        FROM folded JOIN ap USING (id) JOIN hits USING (id) GROUP BY fold)""",
    )
    shares = [
        f"n_{m} AS (SELECT id, class_idx, p / sum(p) OVER (PARTITION BY id) AS p FROM s_{m})"
        for m in "pqr"
    ]
    q["soft_vote"] = query(
        wide("v", digits=6),
        *[score_cte(f"s_{m}", m) for m in "pqr"],
        *shares,
        """v AS (SELECT id, class_idx, avg(p) AS p FROM (SELECT * FROM n_p UNION ALL SELECT * FROM n_q
        UNION ALL SELECT * FROM n_r) GROUP BY id, class_idx)""",
    )
    q["score_softmax"] = query(
        wide("v"),
        score_cte(),
        "v AS (SELECT id, class_idx, exp(10*p) / sum(exp(10*p)) OVER (PARTITION BY id) AS p FROM scores)",
    )
    q["top1_decode"] = query(
        "SELECT id, concat('class', CAST(class_idx + 1 AS VARCHAR)) AS label FROM best",
        score_cte(),
        ARGMAX,
    )
    submission = """submission AS (SELECT id, string_agg(concat('class', CAST(class_idx + 1 AS VARCHAR)), ' '
      ORDER BY place) AS label FROM placed WHERE place <= 3 GROUP BY id)"""
    q["top3_submission"] = query("SELECT * FROM submission", score_cte(), PLACED, submission)
    q["submission_summary"] = query(
        """SELECT count(*) AS n_rows, CAST(2 AS INT) AS n_columns,
        count(DISTINCT label) AS n_predictions FROM submission""",
        score_cte(),
        PLACED,
        submission,
    )
    q["submission_head"] = query(
        "SELECT * FROM submission ORDER BY id LIMIT 10", score_cte(), PLACED, submission
    )
    q["temperature_loss"] = query(
        f"""SELECT y AS class_idx, point, round(t, 6) AS temperature, round(loss, 6) AS loss FROM l0""",
        score_cte(),
        *fit_ctes(1),
    )
    q["temperature_fit"] = query(
        f"""SELECT y AS class_idx, round(t, 3) AS temperature FROM b{fit_rounds - 1}
        UNION ALL SELECT c, CAST(1 AS DOUBLE) FROM (SELECT CAST(unnest(range(0, 7)) AS INT) AS c)
        WHERE c NOT IN (SELECT y FROM b{fit_rounds - 1})""",
        score_cte(),
        *fit_ctes(fit_rounds),
    )
    powers = "CASE class_idx " + " ".join(
        f"WHEN {i} THEN {lit(t)}" for i, t in enumerate(shown_temperatures)
    ) + " END"
    q["temperature_apply"] = query(
        wide("v"),
        score_cte(),
        f"s AS (SELECT id, class_idx, pow(p, 1/{powers}) AS p FROM scores)",
        "v AS (SELECT id, class_idx, p / sum(p) OVER (PARTITION BY id) AS p FROM s)",
    )
    q["class_weight_search"] = query(
        """SELECT CAST(moved AS INT) AS class_idx, factor,
        round(avg(CASE WHEN place <= 3 THEN CAST(1 AS DOUBLE)/place ELSE 0 END), 9) AS map_at_3
        FROM r WHERE class_idx = y GROUP BY moved, factor""",
        score_cte(),
        weight_table(),
        """r AS (SELECT moved, factor, y, s.class_idx, row_number() OVER (PARTITION BY moved, factor, id
        ORDER BY p * w DESC, s.class_idx DESC) AS place FROM scores s JOIN weights USING (class_idx))""",
    )
    q["class_weight_fit"] = query(
        f"""SELECT CAST(j AS INT) AS class_idx, round(w[j + 1], 9) AS weight,
        round(CAST(s.score AS DOUBLE) / (6 * s.n) - CAST(b.score AS DOUBLE) / (6 * s.n), 9) AS gain, CAST(steps + 1 AS INT) AS rounds
        FROM (SELECT *, unnest(range(0, 7)) AS j FROM s{WEIGHT_ROUNDS}) s, base b""",
        score_cte(),
        *weight_rounds(WEIGHT_ROUNDS),
    )
    # Models are checked by what must hold of every row, and of all rows together.
    distribution = "CAST(7 AS INT) AS n_slots, CAST(1 AS DOUBLE) AS total, CAST(0 AS INT) AS out_of_range"
    summary = "SELECT 'all rows', CAST(count(*) AS INT), CAST(1 AS DOUBLE), CAST(0 AS INT)"
    scored = query(f"SELECT id, {distribution} FROM planted WHERE NOT is_train UNION ALL {summary} FROM planted WHERE NOT is_train", PLANTED)
    for name in ("stacking", "single_model", "snapshot_vote", "candidate_ranking", "model_selection", "base_learners"):
        q[name] = scored
    q["oof_meta_features"] = query(
        f"""SELECT id, fold, {distribution} FROM folded UNION ALL
        SELECT 'all rows', CAST(-1 AS INT), CAST(count(*) AS INT), CAST(1 AS DOUBLE), CAST(0 AS INT) FROM folded""",
        PLANTED,
        "plant AS (SELECT id, label FROM planted WHERE is_train)",
        folds("plant", model_folds),
    )
    q["pipeline_stack"] = query("SELECT id, CAST(3 AS INT) AS n_labels, CAST(3 AS INT) AS n_known FROM planted WHERE NOT is_train", PLANTED)
    return q
