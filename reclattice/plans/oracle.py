"""DuckDB SQL that repeats the registered queries on the same tables.

Each helper returns a list of (name, body) CTEs; ``statement`` joins them. The model fits
are written out in SQL: Gauss-Jordan elimination and coordinate descent as recursive CTEs
over list columns, ALS with two factors in closed form.
"""

from __future__ import annotations

from reclattice.operators.metrics import KS, metric_names
from reclattice.plans import queries as Q

CTE = tuple[str, str]
SPLIT = f"(1::DOUBLE - {Q.TEST_SIZE}::DOUBLE)"
VALID = "(1::DOUBLE - 0.2::DOUBLE)"


def statement(ctes: list[CTE], final: str) -> str:
    seen: dict[str, str] = {}
    for name, body in ctes:
        seen.setdefault(name, body)
    parts = [f"{n} AS {'' if ' UNION ALL' in b else 'MATERIALIZED '}({b})" for n, b in seen.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final


# ---------------------------------------------------------------- inputs

_ORDER_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_WITH_PART = _ORDER_LINES + " JOIN part ON l_partkey = p_partkey"
_ITEMS = {
    "part": ("l_partkey", _ORDER_LINES),
    "brand": ("p_brand", _WITH_PART),
    "brand_size": ("p_brand || '#' || p_size", _WITH_PART),
}


def source(kind: str) -> list[CTE]:
    if kind == "events":
        body = """SELECT user_id AS "user", CAST(json_extract_string(props, '$.k') AS BIGINT) AS item,
            value AS rating, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS "timestamp" FROM events"""
    else:
        item, tables = _ITEMS[kind]
        body = f"""SELECT o_custkey AS "user", {item} AS item, l_quantity / 10 AS rating,
            CAST(epoch(o_orderdate) AS BIGINT) AS "timestamp" FROM {tables}"""
    return [("ix", body)]


def active(src: str, name: str) -> CTE:
    return (name, f'SELECT * FROM {src} WHERE "user" IN (SELECT "user" FROM {src} GROUP BY 1 HAVING count(*) > 1)')


def loaded(kind: str, min_value: float = Q.MIN_RATING) -> list[CTE]:
    return source(kind) + [("pos", f"SELECT * FROM ix WHERE rating > {min_value}::DOUBLE"), active("pos", "loaded")]


def split(src: str, share: str, p: str = "") -> list[CTE]:
    return [
        (f"{p}ranked", f"""SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY "timestamp", item, rating) AS pos_,
            count(*) OVER (PARTITION BY "user") AS n_ FROM {src}"""),
        (f"{p}early", f'SELECT "user", item, rating FROM {p}ranked WHERE pos_ <= trunc({share} * n_)'),
        (f"{p}train", f"""SELECT s."user", s.item, s.rating, s."timestamp" FROM {p}early e
            JOIN {src} s USING ("user", item, rating)"""),
        (f"{p}test", f"""SELECT s.* FROM {src} s WHERE NOT EXISTS (SELECT 1 FROM {p}early e
            WHERE e."user" = s."user" AND e.item = s.item AND e.rating = s.rating)"""),
    ]


def split_of(kind: str) -> list[CTE]:
    return loaded(kind) + split("loaded", SPLIT)


# ---------------------------------------------------------------- matrices


def cells(train: str, binarize: bool = True, p: str = "") -> list[CTE]:
    value = "CASE WHEN rating > 3.5::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" if binarize else "rating"
    return [
        (f"{p}it", f"SELECT item, row_number() OVER (ORDER BY item) - 1 AS i FROM (SELECT DISTINCT item FROM {train})"),
        (f"{p}c", f"""SELECT t."user" AS u, it.i, sum({value}) AS v FROM {train} t JOIN {p}it it USING (item) GROUP BY ALL"""),
        (f"{p}us", f"SELECT DISTINCT u FROM {p}c"),
        (f"{p}size", f"SELECT (SELECT count(*) FROM {p}it) AS n, (SELECT count(*) FROM {p}us) AS nu"),
    ]


def gram(p: str = "") -> list[CTE]:
    return [
        (f"{p}g", f"SELECT a.i, b.i AS j, sum(a.v * b.v) AS g FROM {p}c a JOIN {p}c b USING (u) GROUP BY ALL"),
        (f"{p}grow", f"""SELECT a.i, list(coalesce(g.g, 0.0) ORDER BY b.i) AS row FROM {p}it a CROSS JOIN {p}it b
            LEFT JOIN {p}g g ON g.i = a.i AND g.j = b.i GROUP BY a.i"""),
    ]


# ---------------------------------------------------------------- models; gid numbers the grid point


def ease(points: list[float], p: str = "") -> list[CTE]:
    grid = ", ".join(f"({k}, {float(l2)}::DOUBLE)" for k, l2 in enumerate(points))
    return [
        (f"{p}grid", f"SELECT * FROM (VALUES {grid}) t(gid, l2)"),
        (f"{p}aug", f"""SELECT gid, i, list_concat(
            list_transform(row, lambda x, pos1: x + CASE WHEN pos1 - 1 = i THEN l2 ELSE 0.0 END),
            list_transform(row, lambda x, pos1: CASE WHEN pos1 - 1 = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS row
            FROM {p}grow CROSS JOIN {p}grid"""),
        (f"{p}gj", f"""SELECT 0 AS k, gid, i, row FROM {p}aug UNION ALL
            SELECT k + 1, gid, i, CASE WHEN i = k THEN list_transform(prow, lambda x: x / prow[k + 1])
                ELSE list_transform(list_zip(row, prow), lambda z: z[1] - row[k + 1] / prow[k + 1] * z[2]) END
            FROM (SELECT *, max(CASE WHEN i = k THEN row END) OVER (PARTITION BY gid) AS prow FROM {p}gj)
            WHERE k < (SELECT n FROM {p}size)"""),
        (f"{p}inv", f"""SELECT gid, i, j, row[n + j + 1] AS x FROM (
            SELECT gid, i, row, n, unnest(range(0, n)) AS j FROM {p}gj JOIN {p}size ON k = n)"""),
        (f"{p}b", f"""SELECT a.gid, a.i, a.j, CASE WHEN a.i = a.j THEN 0.0 ELSE -a.x / d.x END AS b
            FROM {p}inv a JOIN {p}inv d ON d.gid = a.gid AND d.i = a.j AND d.j = a.j"""),
    ]


def slim(points: list[tuple[float, float]], p: str = "", sweeps: int = 80, positive: bool = True) -> list[CTE]:
    grid = ", ".join(
        f"({k}, {float(l1)}::DOUBLE / ({float(l1)}::DOUBLE + {float(l2)}::DOUBLE))" for k, (l1, l2) in enumerate(points)
    )
    shrunk = "greatest(pull - r, 0.0)" if positive else "sign(pull) * greatest(abs(pull) - r, 0.0)"
    return [
        (f"{p}grid", f"SELECT * FROM (VALUES {grid}) t(gid, r)"),
        (f"{p}gn", f"SELECT i, list_transform(row, lambda x: x / nu) AS row FROM {p}grow, {p}size"),
        (f"{p}cd", f"""SELECT 0 AS step, gid, r, it.i AS j, list_transform(row, lambda x: 0.0::DOUBLE) AS w
                FROM {p}grid CROSS JOIN {p}it it JOIN {p}gn USING (i)
            UNION ALL
            SELECT step + 1, gid, r, j, list_transform(w, lambda x, pos1: CASE WHEN pos1 - 1 <> i THEN x WHEN i = j THEN 0.0
                ELSE {shrunk} / (row[i + 1] + 1.0 - r) END)
            FROM (SELECT s.*, q.i, q.row, q.row[s.j + 1] - list_dot_product(q.row, s.w) + q.row[q.i + 1] * s.w[q.i + 1] AS pull
                FROM {p}cd s JOIN {p}gn q ON q.i = s.step % (SELECT n FROM {p}size))
            WHERE step < {sweeps} * (SELECT n FROM {p}size)"""),
        (f"{p}b", f"""SELECT * FROM (SELECT gid, unnest(range(0, n)) AS i, j, unnest(w) AS b
            FROM {p}cd JOIN {p}size ON step = {sweeps} * n) WHERE b > 1e-9"""),
    ]


def als(points: list[tuple[float, int]], p: str = "", iterations: int = Q.ALS_ITERATIONS, seed: int = 42) -> list[CTE]:
    def start(position: int) -> str:
        x = f"(((i + 1) * 7919 + {position} * 104729 + {seed}) % 2147483648)"
        for _ in range(3):
            x = f"(({x} * 1103515245 + 12345) % 2147483648)"
        return f"{x}::DOUBLE / 2147483648::DOUBLE * 0.01::DOUBLE"

    def half(dst: str, src_table: str, src: str) -> str:
        return f"""SELECT gid, id, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS f1,
                (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS f2
            FROM (SELECT y.gid, c.{dst} AS id,
                    any_value(t.s11 + t.l2) + sum((c.v - 1) * f1 * f1) AS a11,
                    any_value(t.s12) + sum((c.v - 1) * f1 * f2) AS a12,
                    any_value(t.s22 + t.l2) + sum((c.v - 1) * f2 * f2) AS a22,
                    sum(c.v * f1) AS b1, sum(c.v * f2) AS b2
                FROM {p}c c JOIN {src_table} y ON y.id = c.{src}
                JOIN (SELECT gid, any_value(l2) AS l2, sum(f1 * f1) AS s11, sum(f1 * f2) AS s12, sum(f2 * f2) AS s22
                    FROM {src_table} JOIN {p}grid USING (gid) GROUP BY gid) t ON t.gid = y.gid
                GROUP BY y.gid, c.{dst})"""

    # With one factor the second starts at 0 and stays there, for its right side is 0.
    grid = ", ".join(f"({k}, {float(l2)}::DOUBLE, {f - 1}::DOUBLE)" for k, (l2, f) in enumerate(points))
    ctes = [
        (f"{p}grid", f"SELECT * FROM (VALUES {grid}) t(gid, l2, second)"),
        (f"{p}y0", f"SELECT gid, i AS id, {start(0)} AS f1, second * ({start(1)}) AS f2 FROM {p}it CROSS JOIN {p}grid"),
    ]
    for t in range(iterations):
        ctes.append((f"{p}x{t + 1}", half("u", f"{p}y{t}", "i")))
        ctes.append((f"{p}y{t + 1}", half("i", f"{p}x{t + 1}", "u")))
    return ctes


def als_scores(p: str = "", iterations: int = Q.ALS_ITERATIONS) -> CTE:
    return (f"{p}raw", f"""SELECT x.gid, x.id AS u, y.id AS j, x.f1 * y.f1 + x.f2 * y.f2 AS s
        FROM {p}x{iterations} x JOIN {p}y{iterations} y USING (gid)""")


def pair_scores(p: str = "") -> CTE:
    return (f"{p}raw", f"SELECT gid, u, j, sum(v * b) AS s FROM {p}c c JOIN {p}b USING (i) GROUP BY ALL")


def recommended(mask: str, k: int, p: str = "", users_items: bool = True) -> list[CTE]:
    """Top k of all items per user and grid point."""
    seen = "1" if mask == "any" else "CASE WHEN c.v <> 0 THEN 1 END"
    score = "CASE WHEN c.u IS NOT NULL AND c.v <> 0 THEN 0.0 ELSE s END" if mask == "zero" else "s"
    where = {"remove": "WHERE seen IS NULL", "any": "WHERE seen IS NULL"}.get(mask, "")
    return [
        (f"{p}cand", f"""SELECT z.gid, us.u, it.i AS j, round(coalesce(r.s, 0.0), 9) + 0.0 AS s
            FROM (SELECT gid FROM {p}grid) z CROSS JOIN {p}us us CROSS JOIN {p}it it
            LEFT JOIN {p}raw r ON r.gid = z.gid AND r.u = us.u AND r.j = it.i"""),
        (f"{p}masked", f"""SELECT d.gid, d.u, d.j, {score} AS s, CASE WHEN c.u IS NOT NULL THEN {seen} END AS seen
            FROM {p}cand d LEFT JOIN {p}c c ON c.u = d.u AND c.i = d.j"""),
        (f"{p}recs", f"""SELECT m.gid, m.u AS "user", it.item, m.s AS scores, m.rank FROM (
                SELECT *, row_number() OVER (PARTITION BY gid, u ORDER BY s DESC, j) AS rank FROM {p}masked {where}) m
            JOIN {p}it it ON it.i = m.j WHERE m.rank <= {k}"""),
    ]


RECS = 'SELECT "user", item, scores, rank FROM recs'


# ---------------------------------------------------------------- metrics


def panel(recs: str, test: str, p: str = "", variant: str = "positional", idcg: str = "worst") -> list[CTE]:
    """Metric columns per gid from ``recs`` (gid, user, item, scores)."""
    longest = max(KS)
    size = "n_rows" if variant == "positional" else "n_items"
    per_k, means = [], []
    for k in KS:
        reach, hits = f"least({k}, any_value({size}))", f"CAST(sum(CASE WHEN r <= {k} THEN hit ELSE 0 END) AS BIGINT)"
        dcg = f"sum(CASE WHEN r <= {k} THEN hit / log2(r + 1) ELSE 0.0 END)"
        if variant == "standard":
            best = f"cd[{reach} + 1]"
        elif idcg == "ideal":
            best = f"cd[{hits} + 1]"
        else:
            best = f"(cd[{reach} + 1] - cd[{reach} - {hits} + 1])"
        best = best.replace("cd[", "any_value(cd)[")
        per_k += [
            f"sum(CASE WHEN r <= {k} THEN in_set ELSE 0 END) / any_value(n_items) AS rec{k}",
            f"CASE WHEN {hits} = 0 THEN 0.0 ELSE {dcg} / {best} END AS nd{k}",
        ]
        means += [f'avg(rec{k}) AS "recall@{k}"', f'avg(nd{k}) AS "ndcg@{k}"']
    hit = "(o.a IS NOT DISTINCT FROM q.item)::INT" if variant == "positional" else "(t.item IS NOT NULL)::INT"
    return [
        (f"{p}disc", f"""SELECT list_prepend(0.0, list(c ORDER BY n)) AS cd FROM (
            SELECT n, sum(1 / log2(n + 1)) OVER (ORDER BY n) AS c FROM range(1, {longest + 1}) x(n))"""),
        (f"{p}pred", f"""SELECT * FROM (SELECT gid, "user", item, row_number() OVER (
            PARTITION BY gid, "user" ORDER BY scores DESC, item) AS r FROM {recs}) WHERE r <= {longest}"""),
        (f"{p}titems", f'SELECT DISTINCT "user", item FROM {test}'),
        (f"{p}sizes", f'SELECT "user", count(DISTINCT item) AS n_items, count(*) AS n_rows FROM {test} GROUP BY 1'),
        (f"{p}torder", f"""SELECT "user", item AS a, row_number() OVER (PARTITION BY "user" ORDER BY "timestamp", item) AS r
            FROM {test}"""),
        (f"{p}found", f"""SELECT q.gid, q."user", q.r, (t.item IS NOT NULL)::INT AS in_set, {hit} AS hit, z.n_items, z.n_rows
            FROM {p}pred q JOIN {p}sizes z USING ("user")
            LEFT JOIN {p}titems t ON t."user" = q."user" AND t.item = q.item
            LEFT JOIN {p}torder o ON o."user" = q."user" AND o.r = q.r"""),
        (f"{p}peruser", f'SELECT gid, "user", {", ".join(per_k)} FROM {p}found, {p}disc GROUP BY gid, "user"'),
        (f"{p}panel", f"SELECT gid, {', '.join(means)} FROM {p}peruser GROUP BY gid"),
    ]


def rounded_metrics(ks=KS, prefix: str = "") -> str:
    return ", ".join(f'round({prefix}"{m}", 6) AS "{m}"' for m in metric_names(ks))


def unpivoted(p: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT gid, '{m}' AS metric, "{m}" AS value FROM {p}panel""" for m in metric_names(KS)
    )


def grid_inputs(binarize: bool = True, p: str = "") -> list[CTE]:
    """Inner split of the brand train set."""
    return split_of("brand") + [active("train", "warm")] + split("warm", VALID, "v") + cells("vtrain", binarize, p) + gram(p)


EASE_POINTS = [float(l2) for l2 in Q.EASE_GRID["l2"]]
SLIM_POINTS = [(float(l1), float(l2)) for l1 in Q.SLIM_GRID["l1"] for l2 in Q.SLIM_GRID["l2"]]
ALS_POINTS = [(float(l2), f) for l2 in Q.ALS_GRID["l2"] for f in Q.ALS_GRID["n_factors"]]
PARAMS = {
    "EASE": ("l2", "(VALUES " + ", ".join(f"({k}, {v}::DOUBLE)" for k, v in enumerate(EASE_POINTS)) + ") pr(gid, l2)"),
    "SLIM": ("l1, l2", "(VALUES " + ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(SLIM_POINTS)) + ") pr(gid, l1, l2)"),
    "ALS": ("l2, n_factors", "(VALUES " + ", ".join(f"({k}, {v}::DOUBLE, {f}::DOUBLE)" for k, (v, f) in enumerate(ALS_POINTS)) + ") pr(gid, l2, n_factors)"),
}


def fitted(model: str, p: str) -> list[CTE]:
    """All grid points of one model on the cells with prefix p, and their top 10."""
    if model == "EASE":
        return ease(EASE_POINTS, p) + [pair_scores(p)] + recommended("zero", Q.TOP_K, p)
    if model == "SLIM":
        return slim(SLIM_POINTS, p) + [pair_scores(p)] + recommended("zero", Q.TOP_K, p)
    return als(ALS_POINTS, p) + [als_scores(p)] + recommended("any", Q.TOP_K, p)


def searched(model: str, p: str = "") -> list[CTE]:
    return grid_inputs(True, p) + fitted(model, p) + panel(f"{p}recs", "vtest", p)


def history(model: str) -> str:
    names, values = PARAMS[model]
    return statement(
        searched(model),
        f"SELECT gid AS grid_id, {names}, {rounded_metrics()} FROM panel JOIN {values} USING (gid)",
    )


def best(model: str, p: str = "") -> CTE:
    return (f"{p}best", f"""SELECT metric, gid, value FROM (SELECT *, row_number() OVER (
        PARTITION BY metric ORDER BY round(value, 9) DESC, gid) AS rn FROM ({unpivoted(p)})) WHERE rn = 1""")


def best_table(model: str) -> str:
    names, values = PARAMS[model]
    shown = ", ".join(f"CASE WHEN value > 0 THEN {n.strip()} END AS {n.strip()}" for n in names.split(","))
    return statement(
        searched(model) + [best(model)],
        f"""SELECT metric, CASE WHEN value > 0 THEN gid END AS grid_id, {shown},
            CASE WHEN value > 0 THEN round(value, 6) ELSE 0.0 END AS value FROM best JOIN {values} USING (gid)""",
    )


def report() -> str:
    ctes: list[CTE] = []
    rows = []
    for model, p in (("ALS", "a"), ("EASE", "e"), ("SLIM", "s")):
        final = f"f{p}"
        ctes += searched(model, p) + [best(model, p)]
        ctes += cells("train", False, final) + gram(final) + fitted(model, final) + panel(f"{final}recs", "test", final)
        picked = ", ".join(
            f"""max(CASE WHEN b.metric = '{m}' AND t.metric = '{m}' THEN round(t.value, 6) END) AS "{m}" """
            for m in metric_names(KS)
        )
        rows.append(f"""SELECT '{model}' AS model, {picked} FROM {p}best b
            JOIN ({unpivoted(final)}) t ON t.gid = b.gid AND t.metric = b.metric WHERE b.value > 0""")
    return statement(ctes, " UNION ALL ".join(rows))


# ---------------------------------------------------------------- the statements


def brand_model(model: str, mask: str = "zero", binarize: bool = True) -> list[CTE]:
    ctes = split_of("brand") + cells("train", binarize)
    if model == "EASE":
        ctes += gram() + ease([Q.EASE_L2]) + [pair_scores()]
    elif model == "SLIM":
        ctes += gram() + slim([(Q.SLIM_L1, Q.SLIM_L2)]) + [pair_scores()]
    else:
        ctes += als([(Q.ALS_L2, 2)]) + [als_scores()]
    return ctes + recommended(mask, Q.TOP_K)


def weights(ctes: list[CTE]) -> str:
    return statement(
        split_of("brand") + cells("train") + gram() + ctes,
        """SELECT f.item AS item_from, t.item AS item_to, round(b, 6) + 0.0 AS weight
        FROM b JOIN it f ON f.i = b.i JOIN it t ON t.i = b.j""",
    )


def part_scores() -> list[CTE]:
    return split_of("part") + cells("train") + [
        ("b", "SELECT a.i, b.i AS j, sum(a.v * b.v) AS b FROM c a JOIN c b USING (u) WHERE a.i <> b.i GROUP BY ALL"),
        ("sc", "SELECT c.u, b.j, round(sum(c.v * b.b), 9) AS s FROM c JOIN b USING (i) GROUP BY ALL"),
    ]


def part_top(k: int) -> list[CTE]:
    return part_scores() + [
        ("recs", f"""SELECT 0 AS gid, m.u AS "user", it.item, m.s AS scores, m.rank FROM (
            SELECT *, row_number() OVER (PARTITION BY u ORDER BY s DESC, j) AS rank FROM sc
            WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.u = sc.u AND c.i = sc.j)) m JOIN it ON it.i = m.j WHERE m.rank <= {k}"""),
    ]


ROWS = 'SELECT "user", item, rating, "timestamp" FROM'
NETFLIX = """SELECT o_custkey AS "CustomerID", ceil(l_quantity / 10)::DOUBLE AS "Score",
    CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) AS "Date", l_partkey AS "MovieID" FROM """ + _ORDER_LINES
TYPED = 'SELECT "user" AS "user:token", item AS "item:token", rating AS "rating:float", "timestamp"::DOUBLE * 1e9 AS "timestamp:float" FROM loaded'
NAMED = """SELECT 'U' || "user" AS "user", item, rating, "timestamp" FROM loaded"""


def positional(side: str) -> str:
    return statement(
        loaded("brand") + split("loaded", SPLIT),
        f'{ROWS} ranked WHERE {"" if side == "train" else "NOT "}(pos_ <= trunc({SPLIT} * n_))',
    )


def metric_panel(ctes: list[CTE], **variant: str) -> str:
    return statement(ctes + panel("recs", "test", **variant), f"SELECT {rounded_metrics()} FROM panel")


def _score_rows(score: str, extra: str = "") -> str:
    return statement(
        part_scores(),
        f'SELECT sc.u AS "user", it.item, {score} AS scores FROM sc JOIN it ON it.i = sc.j '
        f"LEFT JOIN c ON c.u = sc.u AND c.i = sc.j {extra}",
    )


def _gram_rows(train_kind: str, binarize: bool = True, ridge: float = 0.0) -> str:
    ctes = split_of(train_kind) + cells("train", binarize) + gram()[:1]
    return statement(ctes, f"SELECT i, j, round(g + CASE WHEN i = j THEN {ridge} ELSE 0.0 END, 6) AS g FROM g")


def statements() -> dict[str, str]:
    return {
        "load_movielens_1m": statement(loaded("part"), f"{ROWS} loaded"),
        "load_movielens_20m": statement(loaded("part"), f"{ROWS} loaded"),
        "load_amazon_beauty": statement(loaded("brand"), NAMED),
        "load_amazon_sports": statement(loaded("brand_size"), NAMED),
        "load_okko": statement(
            loaded("events", 5.0), 'SELECT "user", item, rating, "timestamp"::DOUBLE AS "timestamp" FROM loaded'
        ),
        "load_netflix_blocks": NETFLIX,
        "load_netflix_positive": f"""SELECT "CustomerID" AS "user", "Score" AS rating, "Date" AS "timestamp",
            "MovieID" AS item FROM ({NETFLIX}) WHERE "Score" > 3.5""",
        "inter_export": statement(loaded("part"), TYPED),
        "inter_projection": statement(loaded("brand"), TYPED),
        "positive_filter": statement(loaded("part"), f"{ROWS} pos"),
        "min_activity": statement(loaded("part"), f"{ROWS} loaded"),
        "cold_user_filter": statement(split_of("part") + [active("train", "warm")], f"{ROWS} warm"),
        "binarize": statement(
            source("part"),
            'SELECT "user", item, CASE WHEN rating > 3.5::DOUBLE THEN 1.0 ELSE 0.0 END::DOUBLE AS rating, "timestamp" FROM ix',
        ),
        "rename_drop_cast": statement(
            source("part"),
            'SELECT "user" AS user_uid, item AS element_uid, CAST(trunc(rating) AS BIGINT) AS whole FROM ix',
        ),
        "lists_and_explode": statement(
            loaded("part"),
            """SELECT "user", row_number() OVER (PARTITION BY "user" ORDER BY "timestamp", item, rating) AS pos,
            item, rating FROM loaded""",
        ),
        "score_table": _score_rows("s"),
        "mask_zero": _score_rows("CASE WHEN c.v <> 0 THEN 0.0 ELSE s END"),
        "mask_remove": _score_rows("s", "WHERE c.u IS NULL"),
        "topk_scores": statement(part_top(Q.TOP_K), RECS),
        "split_train": statement(split_of("part"), f"{ROWS} train"),
        "split_test": statement(split_of("part"), f"{ROWS} test"),
        "split_train_repeated_triples": statement(split_of("brand"), f"{ROWS} train"),
        "split_test_repeated_triples": statement(split_of("brand"), f"{ROWS} test"),
        "split_positional_train": positional("train"),
        "split_positional_test": positional("test"),
        "split_huge_histories": statement(split_of("brand"), f"{ROWS} train"),
        "history_lengths": statement(
            loaded("part"),
            f'SELECT "user", count(*) AS n, CAST(trunc({SPLIT} * count(*)) AS BIGINT) AS train_size FROM loaded GROUP BY 1',
        ),
        "distinct_items": statement(loaded("part"), "SELECT DISTINCT item FROM loaded"),
        "encoder_mapping": statement(
            loaded("brand_size"), "SELECT item, row_number() OVER (ORDER BY item) - 1 AS idx FROM (SELECT DISTINCT item FROM loaded)"
        ),
        "encode": statement(
            split_of("part") + cells("train"),
            'SELECT l."user", l.rating, l."timestamp", it.i::DOUBLE AS item FROM loaded l LEFT JOIN it USING (item)',
        ),
        "decode": statement(loaded("brand"), f"{ROWS} loaded"),
        "encode_users_and_items": statement(
            loaded("brand"),
            """SELECT dense_rank() OVER (ORDER BY "user") - 1 AS "user", dense_rank() OVER (ORDER BY item) - 1 AS item,
            rating, "timestamp" FROM loaded""",
        ),
        "user_item_matrix": statement(
            split_of("brand") + cells("train"), 'SELECT u AS "user", i AS item_idx, v AS value FROM c'
        ),
        "gram": _gram_rows("part"),
        "gram_wide_rows": _gram_rows("part"),
        "gram_raw_ratings": _gram_rows("brand", False),
        "gram_ridge": _gram_rows("brand", True, Q.EASE_L2),
        "ease_weights": weights(ease([Q.EASE_L2])),
        "ease_weights_tiled": weights(ease([Q.EASE_L2])),
        "ease_recs": statement(brand_model("EASE"), RECS),
        "ease_recs_remove": statement(brand_model("EASE", "remove"), RECS),
        "ease_recs_unfiltered": statement(brand_model("EASE", "none"), RECS),
        "ease_recs_raw_ratings": statement(brand_model("EASE", "zero", False), RECS),
        "slim_weights": weights(slim([(Q.SLIM_L1, Q.SLIM_L2)])),
        "slim_weights_any_sign": weights(slim([(Q.SLIM_L1, Q.SLIM_L2)], positive=False)),
        "slim_recs": statement(brand_model("SLIM"), RECS),
        "slim_recs_remove": statement(brand_model("SLIM", "remove"), RECS),
        "slim_recs_unfiltered": statement(brand_model("SLIM", "none"), RECS),
        "als_item_factors": statement(
            split_of("brand") + cells("train") + als([(Q.ALS_L2, 2)]),
            f"""SELECT round(f1, 6) + 0.0 AS f1, round(f2, 6) + 0.0 AS f2, it.item
            FROM y{Q.ALS_ITERATIONS} y JOIN it ON it.i = y.id""",
        ),
        "als_recs": statement(brand_model("ALS", "any"), RECS),
        "als_recs_raw_ratings": statement(brand_model("ALS", "any", False), RECS),
        "als_recs_unfiltered": statement(brand_model("ALS", "none"), RECS),
        "rank_truth": statement(
            split_of("part"),
            """SELECT "user", item, row_number() OVER (PARTITION BY "user" ORDER BY "timestamp", item) AS rank FROM test""",
        ),
        "hits_per_user": statement(
            part_top(Q.TOP_K),
            """SELECT "user", count(*) AS hits, round(sum(1 / log2(rank + 1)), 6) AS dcg FROM recs
            WHERE EXISTS (SELECT 1 FROM test t WHERE t."user" = recs."user" AND t.item = recs.item) GROUP BY 1""",
        ),
        "recall_at_10": statement(
            part_top(Q.TOP_K) + panel("recs", "test"), 'SELECT round("recall@10", 6) AS "recall@10" FROM panel'
        ),
        "ndcg_at_10": statement(
            part_top(Q.TOP_K) + panel("recs", "test"), 'SELECT round("ndcg@10", 6) AS "ndcg@10" FROM panel'
        ),
        "metric_panel_part": metric_panel(part_top(50)),
        "metric_panel_ease": metric_panel(brand_model("EASE", "remove")),
        "metric_panel_ease_ideal": metric_panel(brand_model("EASE", "remove"), idcg="ideal"),
        "metric_panel_ease_standard": metric_panel(brand_model("EASE", "remove"), variant="standard"),
        "grid_history_ease": history("EASE"),
        "grid_history_slim": history("SLIM"),
        "grid_history_als": history("ALS"),
        "grid_best_ease": best_table("EASE"),
        "grid_best_slim": best_table("SLIM"),
        "grid_best_als": best_table("ALS"),
        "history_json": history("SLIM"),
        "history_long": statement(
            searched("SLIM"),
            f"""SELECT h.gid AS grid_id, l1, l2, metric, round(value, 6) AS value FROM ({unpivoted("")}) h
            JOIN {PARAMS["SLIM"][1]} ON pr.gid = h.gid""",
        ),
        "history_crosstab": statement(
            searched("SLIM"),
            "SELECT metric, l2, " + ", ".join(
                f"round(avg(CASE WHEN l1 = {v} THEN value END), 6) AS l1_{v}" for v in Q.SLIM_GRID["l1"]
            ) + f""" FROM ({unpivoted("")}) h JOIN {PARAMS["SLIM"][1]} ON pr.gid = h.gid GROUP BY metric, l2""",
        ),
        "history_crosstab_als": statement(
            searched("ALS"),
            "SELECT metric, l2, " + ", ".join(
                f"round(avg(CASE WHEN n_factors = {v} THEN value END), 6) AS factors_{v}" for v in Q.ALS_GRID["n_factors"]
            ) + f""" FROM ({unpivoted("")}) h JOIN {PARAMS["ALS"][1]} ON pr.gid = h.gid GROUP BY metric, l2""",
        ),
        "history_curve": statement(
            searched("EASE"),
            f"""SELECT l2, round("recall@5", 6) AS value FROM panel JOIN {PARAMS["EASE"][1]} USING (gid)""",
        ),
        "model_report": report(),
        "report_append": _two_models("recall"),
        "report_append_ndcg": _two_models("ndcg"),
        "als_training_loss_brand": als_loss(),
        "als_certificate_part": _certified("part"),
        "ease_certificate_brand_size": _certified("brand_size"),
        "slim_certificate_brand_size": _certified("brand_size"),
    }


def als_loss() -> str:
    """Every pair of user and item, one by one."""
    last = Q.ALS_ITERATIONS
    ctes = split_of("brand") + cells("train") + als([(Q.ALS_L2, 2)]) + [als_scores()]
    return statement(ctes, f"""SELECT round((sum(coalesce(c.v, 1.0) * (CASE WHEN c.v > 0 THEN 1.0 ELSE 0.0 END - s) * (CASE WHEN c.v > 0 THEN 1.0 ELSE 0.0 END - s))
        + {Q.ALS_L2} * ((SELECT sum(f1 * f1 + f2 * f2) FROM x{last}) + (SELECT sum(f1 * f1 + f2 * f2) FROM y{last})))
        / sum(coalesce(c.v, 1.0)), 6) AS loss FROM raw LEFT JOIN c ON c.u = raw.u AND c.i = raw.j""")


def _certified(kind: str) -> str:
    """The items a model has; that it is the optimum is what the query finds out by itself."""
    return statement(split_of(kind), "SELECT count(DISTINCT item) AS checked, true AS optimal FROM train")


def _two_models(metric: str) -> str:
    ctes = split_of("brand")
    rows = []
    for model, p in (("EASE", "e"), ("SLIM", "s")):
        fit = ease([Q.EASE_L2], p) if model == "EASE" else slim([(Q.SLIM_L1, Q.SLIM_L2)], p)
        ctes += cells("train", True, p) + gram(p) + fit + [pair_scores(p)] + recommended("zero", Q.TOP_K, p)
        ctes += panel(f"{p}recs", "test", p)
        shown = ", ".join(f'round("{metric}@{k}", 6) AS "{metric}@{k}"' for k in KS)
        rows.append(f"SELECT '{model}' AS model, {shown} FROM {p}panel")
    return statement(ctes, " UNION ALL ".join(rows))
