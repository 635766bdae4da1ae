"""Panel estimators as grouped aggregates: group-time effects, absorbed regressions, inference by draws.

Only cell tables (years squared), k x k moment matrices and single numbers come to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.operators.aggregate import running_total
from panelworks.session import saved


def changes(panel: DataFrame, unit: str, year: str, y: str, first: str, keys: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """(keys, unit, base, year, dy, treated, control, carry): every change from a base year to a later one, by unit.

    A row is treated in the cell of cohort base + 1 and a control while the unit is untreated. Rows that are neither
    are dropped at once, so a unit has at most years squared rows."""
    keys, carry = keys or [], carry or []
    a = panel.select(*keys, unit, F.col(year).alias("base"), F.col(y).alias("_y0"))
    b = panel.select(*keys, unit, year, F.col(y).alias("_y1"), F.col(first).alias("_f"), *carry)
    treated = F.coalesce(F.col("_f") == F.col("base") + 1, F.lit(False))
    control = F.col("_f").isNull() | (F.col("_f") > F.col(year))
    out = a.join(b, [*keys, unit]).where(F.col(year) > F.col("base")).select(*keys, unit, "base", year, (F.col("_y1") - F.col("_y0")).alias("dy"), treated.alias("treated"), control.alias("control"), *carry)
    return out.where("treated or control")


def group_time(d: DataFrame, year: str, keys: list[str] | None = None, never_only: Column | None = None) -> DataFrame:
    """(keys, cohort, year, att, n_treated, n_control) from ``changes``."""
    keys = keys or []
    control = F.col("control") if never_only is None else F.col("control") & never_only
    t, c = F.when(F.col("treated"), F.col("dy")), F.when(control & ~F.col("treated"), F.col("dy"))
    g = d.groupBy(*keys, (F.col("base") + 1).alias("cohort"), year).agg(F.avg(t).alias("_t"), F.avg(c).alias("_c"), F.count(t).alias("n_treated"), F.count(c).alias("n_control"))
    return g.where("n_treated > 0 and n_control > 0").select(*keys, "cohort", year, (F.col("_t") - F.col("_c")).alias("att"), "n_treated", "n_control")


def overall(cells: DataFrame, by: list[Column] | None = None) -> DataFrame:
    """Averages of cells weighted by treated units, in all or by any columns."""
    g = cells.groupBy(*by) if by else cells.groupBy()
    return g.agg((F.sum(F.col("att") * F.col("n_treated")) / F.sum("n_treated")).alias("att"), F.sum("n_treated").alias("n_treated"))


def splits(panel: DataFrame, y: str, table: list[tuple[str, str, str, str]]) -> DataFrame:
    """(split, level, n_near, diff): mean of ``y`` near minus far, for every row (split, level, near, rows) of SQL conditions.

    A row of the panel goes on once for each split that has it, and only with its value and side."""
    parts = [F.when(F.expr(rows), F.struct(F.lit(k).alias("split"), F.lit(v).alias("level"), F.expr(near).alias("near"))) for k, v, near, rows in table]
    long = panel.select(F.col(y).alias("_y"), F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("s"))
    near = F.col("s.near")
    return long.groupBy("s.split", "s.level").agg(F.count_if(near).alias("n_near"), (F.avg(F.when(near, F.col("_y"))) - F.avg(F.when(~near, F.col("_y")))).alias("diff"))


def att_error(d: DataFrame, year: str, cluster: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, att, se, n_clusters): influence values of the overall effect summed inside clusters, by the keys of ``changes``."""
    keys = keys or []
    t, c = F.when(F.col("treated"), F.col("dy")), F.when(F.col("control") & ~F.col("treated"), F.col("dy"))
    cells = d.groupBy(*keys, "base", year).agg(F.avg(t).alias("mt"), F.avg(c).alias("mc"), F.count(t).alias("nt"), F.count(c).alias("nc")).where("nt > 0 and nc > 0")
    total = cells.groupBy(*keys).agg(F.sum("nt").alias("n"), (F.sum((F.col("mt") - F.col("mc")) * F.col("nt")) / F.sum("nt")).alias("att"))
    j = d.join(cells, [*keys, "base", year])
    j = j.join(total, keys) if keys else j.crossJoin(F.broadcast(total))
    psi = F.col("nt") / F.col("n") * F.when(F.col("treated"), (F.col("dy") - F.col("mt")) / F.col("nt")).otherwise(-(F.col("dy") - F.col("mc")) / F.col("nc"))
    by = j.groupBy(*keys, cluster).agg(F.sum(psi).alias("s"), F.max("att").alias("att"))
    return by.groupBy(*keys).agg(F.max("att").alias("att"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("se"), F.count(F.lit(1)).alias("n_clusters"))


def doubly_robust(d: DataFrame, year: str, x: str, rounds: int = 8) -> DataFrame:
    """(cohort, year, att, n_treated): inverse-probability weights by a logit on ``x`` and a linear outcome model on controls.

    The logit of every cell is fitted at once: a round adds up five moments for each cell and solves its 2 x 2 step."""
    s = d.groupBy("base", year).agg(F.avg(x).alias("_mx"), F.stddev_samp(x).alias("_sx"), F.count_if("treated").alias("nt"), F.count_if(~F.col("treated")).alias("nc")).where("nt > 4 and nc > 4 and _sx > 0")
    rows = saved(d.join(s, ["base", year]).withColumn("z", (F.col(x) - F.col("_mx")) / F.col("_sx")).select("base", year, "dy", "treated", "z"), "dr")
    par = saved(s.select("base", year, F.ln(F.col("nt") / F.col("nc")).alias("a"), F.lit(0.0).alias("b")), "logit")
    z, t = F.col("z"), F.col("treated").cast("double")
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * z)))
        w, r = p * (1 - p), t - p
        m = rows.join(par, ["base", year]).groupBy("base", year, "a", "b").agg(F.sum(w).alias("w0"), F.sum(w * z).alias("w1"), F.sum(w * z * z).alias("w2"), F.sum(r).alias("r0"), F.sum(r * z).alias("r1"))
        det = F.col("w0") * F.col("w2") - F.col("w1") * F.col("w1")
        par = saved(m.select("base", year, F.when(det > 1e-12, F.col("a") + (F.col("w2") * F.col("r0") - F.col("w1") * F.col("r1")) / det).otherwise(F.col("a")).alias("a"),
                             F.when(det > 1e-12, F.col("b") + (F.col("w0") * F.col("r1") - F.col("w1") * F.col("r0")) / det).otherwise(F.col("b")).alias("b")), "logit")
    odds = F.exp(F.least(F.col("a") + F.col("b") * z, F.lit(30.0)))
    full = rows.join(par, ["base", year]).withColumn("w", F.when(F.col("treated"), 0.0).otherwise(odds))
    w, dy = F.col("w"), F.col("dy")
    line = full.groupBy("base", year).agg(F.sum(w).alias("s0"), F.sum(w * z).alias("s1"), F.sum(w * z * z).alias("s2"), F.sum(w * dy).alias("y0"), F.sum(w * z * dy).alias("y1"), F.count_if("treated").alias("n_treated"),
                                          F.avg(F.when(F.col("treated"), dy)).alias("mt"), F.avg(F.when(F.col("treated"), z)).alias("mz"))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    slope = F.when(det > 1e-12, (F.col("s0") * F.col("y1") - F.col("s1") * F.col("y0")) / det).otherwise(0.0)
    level = (F.col("y0") - slope * F.col("s1")) / F.col("s0")
    return line.select((F.col("base") + 1).alias("cohort"), year, (F.col("mt") - level - slope * F.col("mz")).alias("att"), "n_treated")


#: Coefficients of the smaller factors that are solved for at once, on the driver; beyond that factors take turns.
DIRECT = 512


def solved_effects(rows: DataFrame, taken: list[tuple[str, str | None]], values: list[str], main: int, levels: dict[int, list[str]]) -> list[DataFrame | None]:
    """The effects of all factors but ``main``, exactly: the normal equations of their dummies and slopes with ``main``'s means taken out.

    ``levels``: every level of the other factors, few enough to solve for. The equations are sums over rows and over the levels of ``main``,
    of which each meets no more coefficients than there are; the rows are read three times, however unbalanced they are."""
    spark, at, entries = rows.sparkSession, 0, []
    offset, d = {}, rows.select("_w", f"_l{main}", *values, *[c for k in levels for c in (f"_l{k}", *([f"_x{k}"] if taken[k][1] else []))])
    for k, names in levels.items():
        offset[k] = at
        coded = spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"_l{k} string, _i{k} int")
        d = d.join(F.broadcast(coded), f"_l{k}")  # at most DIRECT rows
        entries.append(F.struct((F.col(f"_i{k}") + at).alias("p"), F.lit(1.0).alias("z")))
        at += len(names)
        if taken[k][1]:
            entries.append(F.struct((F.col(f"_i{k}") + at).alias("p"), F.col(f"_x{k}").alias("z")))
            at += len(names)
    one = d.select("_w", F.col(f"_l{main}").alias("m"), *values, F.array(*entries).alias("all")).select("_w", "m", *values, "all", F.inline("all"))
    two = one.select("_w", "p", "z", F.inline("all").alias("q", "y")).groupBy("p", "q").agg(F.sum(F.col("_w") * F.col("z") * F.col("y")).alias("s"))
    sums = saved(one.groupBy("m", "p").agg(F.sum(F.col("_w") * F.col("z")).alias("s"), *[F.sum(F.col("_w") * F.col("z") * F.col(v)).alias(v) for v in values]), "level-sums")
    whole = saved(rows.groupBy(F.col(f"_l{main}").alias("m")).agg(F.sum("_w").alias("w"), *[F.sum(F.col("_w") * F.col(v)).alias(f"_t{v}") for v in values]), "level-totals")
    left = sums.join(whole, "m")
    cross = left.select("m", "p", "s", "w").join(sums.select("m", F.col("p").alias("q"), F.col("s").alias("s2")), "m").groupBy("p", "q").agg(F.sum(F.col("s") * F.col("s2") / F.col("w")).alias("s"))
    grid, right = np.zeros((at, at)), np.zeros((at, len(values)))
    for table, sign in ((two, 1.0), (cross, -1.0)):
        got = table.toArrow()
        grid[got["p"].to_numpy(), got["q"].to_numpy()] += sign * got["s"].to_numpy()
    got = left.groupBy("p").agg(*[F.sum(F.col(v) - F.col("s") * F.col(f"_t{v}") / F.col("w")).alias(v) for v in values]).toArrow()
    for c, v in enumerate(values):
        right[got["p"].to_numpy(), c] = got[v].to_numpy()
    beta = np.linalg.lstsq(grid, right, rcond=1e-11)[0]
    out: list[DataFrame | None] = [None] * len(taken)
    for k, names in levels.items():
        slope = beta[offset[k] + len(names):offset[k] + 2 * len(names)] if taken[k][1] else np.zeros((len(names), len(values)))
        data = [(n, *[float(x) for c in range(len(values)) for x in (beta[offset[k] + i, c], slope[i, c])]) for i, n in enumerate(names)]
        out[k] = spark.createDataFrame(data, f"_l{k} string, " + ", ".join(f"_a{v} double, _b{v} double" for v in values))
    return out


def demeaned(df: DataFrame, cols: list[str], factors: list[str], weight: str | None = None, tolerance: float = 1e-9, rounds: int = 500, slopes: list[tuple[str, str]] | None = None) -> DataFrame:
    """``df`` with ``cols`` replaced by what the factors and the slopes leave of them, weighted.

    ``slopes``: (factor, covariate) pairs; the covariate's own slope in each level of the factor goes out, along with the level's mean.
    A null level is a level like any other. Rows with weight 0 or null, or a null in ``cols`` or a covariate, are dropped, as in any
    regression. The factor with most levels is averaged out, and the others are solved for at once if they have up to ``DIRECT``
    coefficients; else factors take turns: what the others leave of each column is regressed inside the levels. The rows
    are written once; a turn writes one row for each level. Turns stop when a whole round has changed no level of any factor
    by more than ``tolerance`` times the column's spread."""
    slopes = slopes or []
    taken = [(f, x) for f, x in slopes] + [(f, None) for f in factors if f not in {g for g, _ in slopes}]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    own = {c: f"_v{i}" for i, c in enumerate(cols)}
    used = list(dict.fromkeys([*cols, *[x for _, x in slopes], *([weight] if weight else [])]))
    rows = df.dropna(subset=used).withColumn("_w", w).where("_w > 0").withColumns({v: F.col(c).cast("double") for c, v in own.items()})
    rows = rows.withColumns({f"_l{k}": F.coalesce(F.concat(F.lit("v"), F.col(f).cast("string")), F.lit("n")) for k, (f, _) in enumerate(taken)})
    for k, (_, x) in enumerate(taken):
        if x:
            middle = rows.groupBy(f"_l{k}").agg((F.sum(F.col("_w") * F.col(x)) / F.sum("_w")).alias("_m"))
            rows = rows.join(middle, f"_l{k}").withColumn(f"_x{k}", F.col(x).cast("double") - F.col("_m")).drop("_m")
    rows = saved(rows, "absorb")
    spread = rows.agg(*[F.stddev_pop(v) for v in own.values()]).first()
    scale = {v: float(x) if x else 1.0 for v, x in zip(own.values(), spread, strict=True)}
    effects: list[DataFrame | None] = [None] * len(taken)

    def left(but: int | None = None) -> DataFrame:
        out = rows
        for k, e in enumerate(effects):
            if e is not None and k != but:
                out = out.join(e, f"_l{k}", "left")
                out = out.withColumns({v: F.col(v) - F.col(f"_a{v}") - (F.col(f"_b{v}") * F.col(f"_x{k}") if taken[k][1] else F.lit(0.0)) for v in own.values()}).drop(*[f"_{q}{v}" for q in "ab" for v in own.values()])
        return out

    counts = rows.agg(*[F.count_distinct(f"_l{k}") for k in range(len(taken))]).first()
    plain = [k for k, (_, x) in enumerate(taken) if not x]
    main = max(plain, key=lambda k: counts[k], default=None)
    direct = main is not None and 0 < sum(counts[k] * (2 if x else 1) for k, (_, x) in enumerate(taken) if k != main) <= DIRECT
    if direct:
        names = {k: sorted(r[0] for r in rows.select(f"_l{k}").distinct().collect()) for k in range(len(taken)) if k != main}
        effects = solved_effects(rows, taken, list(own.values()), main, names)
    for _ in range(rounds):
        moved = 0.0
        for k, (_, x) in [(main, taken[main])] if direct else enumerate(taken):
            w, z = F.col("_w"), F.col(f"_x{k}") if x else F.lit(0.0)
            fit = left(k).groupBy(f"_l{k}").agg(*[e for v in own.values() for e in ((F.sum(w * F.col(v)) / F.sum(w)).alias(f"_a{v}"), F.coalesce(F.sum(w * z * F.col(v)) / F.nullif(F.sum(w * z * z), F.lit(0.0)), F.lit(0.0)).alias(f"_b{v}"))], F.sqrt(F.sum(w * z * z) / F.sum(w)).alias("_s"))
            before, fit = effects[k], saved(fit, "effects")
            step = fit if before is None else fit.join(before.withColumnsRenamed({f"_{q}{v}": f"_o{q}{v}" for q in "ab" for v in own.values()}), f"_l{k}")
            old = (lambda q, v: F.lit(0.0)) if before is None else (lambda q, v: F.col(f"_o{q}{v}"))
            change = [F.max((F.abs(F.col(f"_a{v}") - old("a", v)) + F.abs(F.col(f"_b{v}") - old("b", v)) * F.col("_s")) / scale[v]) for v in own.values()]
            moved = max([moved, *[x or 0.0 for x in step.agg(*change).first()]])
            effects[k] = fit.drop("_s")
        if direct or len(taken) == 1 or moved < tolerance:
            return left().withColumns({c: F.col(v) for c, v in own.items()}).drop(*own.values(), "_w", *[f"_l{k}" for k in range(len(taken))], *[f"_x{k}" for k in range(len(taken))])
    raise RuntimeError("absorption did not settle")


def models(df: DataFrame, y: str, terms: dict[str, list[str]], factors: list[str], cluster: str, weight: str | None = None, slopes: list[tuple[str, str]] | None = None) -> dict[str, tuple[list[dict], dict]]:
    """Absorbed regressions of ``y`` on several lists of terms over the same rows: model -> (rows, more), as ``regression`` returns them.

    All columns are absorbed together, all moments are one aggregate and all clustered scores another; the k x k systems are solved here."""
    every = list(dict.fromkeys(x for xs in terms.values() for x in xs))
    keep = list(dict.fromkeys([*factors, cluster, *[f for f, _ in slopes or []], *[x for _, x in slopes or []], *([weight] if weight else [])]))
    names = {c: f"_c{i}" for i, c in enumerate([y, *every])}
    d = saved(demeaned(df.select(*keep, *[F.col(c).cast("double").alias(v) for c, v in names.items()]), list(names.values()), factors, weight, slopes=slopes), "absorbed")
    w = F.col(weight) if weight else F.lit(1.0)
    pairs = list(dict.fromkeys((a, b) for xs in terms.values() for a in xs for b in (*xs, y)))
    m = d.agg(*[F.sum(w * F.col(names[a]) * F.col(names[b])) for a, b in pairs], F.count(F.lit(1))).first()
    moment, n = {p: float(v or 0.0) for p, v in zip(pairs, m, strict=False)}, m[-1]
    solved, scores = {}, []
    for k, (name, xs) in enumerate(terms.items()):
        inverse = np.linalg.pinv(np.array([[moment[a, b] for b in xs] for a in xs]))
        b = inverse @ np.array([moment[a, y] for a in xs])
        solved[name] = inverse, b
        u = F.col(names[y]) - sum((F.lit(float(v)) * F.col(names[x]) for v, x in zip(b, xs, strict=True)), F.lit(0.0))
        scores += [F.sum(w * F.col(names[x]) * u).alias(f"_s{k}_{i}") for i, x in enumerate(xs)]
    by = saved(d.groupBy(cluster).agg(*scores), "scores")
    crossed = [(k, i, j) for k, xs in enumerate(terms.values()) for i in range(len(xs)) for j in range(len(xs))]
    s = by.agg(*[F.sum(F.col(f"_s{k}_{i}") * F.col(f"_s{k}_{j}")) for k, i, j in crossed], F.count(F.lit(1))).first()
    g, square = s[-1], {c: float(v or 0.0) for c, v in zip(crossed, s, strict=False)}
    out = {}
    for k, (name, xs) in enumerate(terms.items()):
        inverse, b = solved[name]
        meat = np.array([[square[k, i, j] for j in range(len(xs))] for i in range(len(xs))])
        v = inverse @ meat @ inverse * (g / max(g - 1, 1)) * ((n - 1) / max(n - len(xs), 1))
        se = np.sqrt(np.maximum(np.diag(v), 0))
        rows = [{"term": x, "coef": float(c), "se": float(e), "t": float(c / e) if e else None} for x, c, e in zip(xs, b, se, strict=True)]
        out[name] = rows, {"n": n, "clusters": g, "V": v, "b": b, "data": d, "scores": by.select(cluster, *[F.col(f"_s{k}_{i}").alias(f"_s{i}") for i in range(len(xs))])}
    return out


def regression(df: DataFrame, y: str, xs: list[str], factors: list[str], cluster: str, weight: str | None = None, slopes: list[tuple[str, str]] | None = None) -> tuple[list[dict], dict]:
    """Absorbed regression: rows (term, coef, se, t) with a clustered covariance, and (n, clusters, V, b) beside."""
    return models(df, y, {"": xs}, factors, cluster, weight, slopes)[""]


def equal_terms(b: np.ndarray, v: np.ndarray, i: int = 0, j: int = 1) -> float:
    """The squared t statistic of the hypothesis that two coefficients are equal."""
    spread = float(v[i, i] + v[j, j] - 2 * v[i, j])
    return float(b[i] - b[j]) ** 2 / spread if spread > 0 else float("nan")


def wald(b: np.ndarray, v: np.ndarray) -> float:
    return float(b @ np.linalg.pinv(v) @ b)


def shuffled(index: np.ndarray, n: int, draw: int, seed: int) -> np.ndarray:
    """Where a draw's permutation of 0 .. n - 1 takes each index, computed for each alone.

    Four rounds swap and mix two halves of the index's bits, which is one to one on a range of a power of four; an index that leaves 0 .. n - 1
    goes on until it is back."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, out = np.uint64((1 << half) - 1), index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> np.uint64(half), out[todo] & low
        for k in range(4):
            h = b + np.uint64((seed * 0x9E3779B97F4A7C15 + draw * 0xC2B2AE3D27D4EB4F + k * 0x165667B19E3779F9) & (2**64 - 1))
            for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
            a, b = b, a ^ ((h >> np.uint64(33)) & low)
        out[todo] = a << np.uint64(half) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a gapless number from 0 in this order, by range partitions."""
    return running_total(df, order, F.lit(1), name).withColumn(name, F.col(name).cast("long"))


def permuted_first(units: DataFrame, unit: str, first: str, draws: int, seed: int) -> DataFrame:
    """(draw, unit, first): the treatment years shuffled over the units in each draw.

    A draw takes each unit's number to another one and gives it the year that stands there when the years are in order, so each draw
    has every year as often as the units do, at any partitioning. No draw is sorted; a row for each draw and unit comes out."""
    table = saved(numbered(units.select(unit, first), [F.col(unit)], "_n"), "units")
    n, years, ends = year_counts(table, first)

    def draw(frames):
        for f in frames:
            for k in range(1, draws + 1):
                at = np.searchsorted(ends, shuffled(f["_n"].to_numpy(), n, k, seed), side="right")
                yield f[[unit]].assign(draw=k, first=[years[x] for x in at]).rename(columns={"first": first})[["draw", unit, first]]

    kind = {c: t for c, t in table.dtypes}
    return table.select(unit, "_n").mapInPandas(draw, f"draw int, `{unit}` {kind[unit]}, `{first}` {kind[first]}")


def year_counts(table: DataFrame, first: str) -> tuple[int, list, np.ndarray]:
    """(units, treatment years in order with null last, where each one's run of units ends)."""
    counts = {r[0]: r[1] for r in table.groupBy(first).count().collect()}
    years = sorted((y for y in counts if y is not None)) + [None] * (None in counts)
    return sum(counts.values()), years, np.cumsum([counts[y] for y in years]).astype(np.int64)


def randomized_effects(panel: DataFrame, unit: str, year: str, y: str, first: str, draws: int, seed: int, block: int = 4096) -> DataFrame:
    """(draw, att): the overall effect with the treatment years as they are (draw 0) and shuffled over the units.

    A unit is one row, its outcomes by year. A task holds a block of units as a matrix of all changes and adds up, for every
    draw, the changes of the treated and of the controls in each cell; what leaves it is a row for each draw and cell. The panel
    itself is never copied. Draws are bijections of the units' numbers (see ``shuffled``), the same at any partitioning."""
    every = [r[0] for r in panel.select(year).distinct().orderBy(year).collect()]
    wide = panel.groupBy(unit, first).agg(*[F.avg(F.when(F.col(year) == v, F.col(y))).alias(f"_y{i}") for i, v in enumerate(every)])
    wide = saved(numbered(wide.withColumnRenamed(first, "_f"), [F.col(unit)], "_n"), "units")
    n, years, ends = year_counts(wide, "_f")
    cells = [(i, j) for i in range(len(every)) for j in range(i + 1, len(every))]
    begun = np.array([[v is not None and v == every[i] + 1 for v in years] for i, _ in cells])
    not_yet = np.array([[v is None or v > every[j] for v in years] for _, j in cells])

    def add(frames):
        total = np.zeros((draws + 1, len(cells), 4))
        for whole in frames:
            for at in range(0, len(whole), block):
                f = whole.iloc[at:at + block]
                level = f[[f"_y{i}" for i in range(len(every))]].to_numpy(float)
                change = np.stack([level[:, j] - level[:, i] for i, j in cells], axis=1)
                there = ~np.isnan(change)
                both = np.concatenate([np.where(there, change, 0.0), there], axis=1)
                own = np.array([years.index(None if v is None or v != v else v) for v in f["_f"]])
                for k in range(draws + 1):
                    group = np.searchsorted(ends, shuffled(f["_n"].to_numpy(), n, k, seed), side="right") if k else own
                    sums = np.zeros((len(years), both.shape[1]))
                    for g in range(len(years)):
                        sums[g] = both[group == g].sum(0)
                    s, c = sums[:, :len(cells)].T, sums[:, len(cells):].T
                    total[k] += np.stack([(s * begun).sum(1), (c * begun).sum(1), (s * not_yet).sum(1), (c * not_yet).sum(1)], axis=1)
        k, c = np.meshgrid(np.arange(draws + 1), np.arange(len(cells)), indexing="ij")
        yield pd.DataFrame({"draw": k.ravel(), "cell": c.ravel(), **{name: total[..., i].ravel() for i, name in enumerate(("st", "nt", "sc", "nc"))}})

    sums = wide.drop(unit).mapInPandas(add, "draw int, cell int, st double, nt double, sc double, nc double").groupBy("draw", "cell").agg(*[F.sum(c).alias(c) for c in ("st", "nt", "sc", "nc")])
    att = F.col("st") / F.col("nt") - F.col("sc") / F.col("nc")
    return sums.where("nt > 0 and nc > 0").groupBy("draw").agg((F.sum(att * F.col("nt")) / F.sum("nt")).alias("att"))


#: Webb's six points.
WEBB = [-math.sqrt(1.5), -1.0, -math.sqrt(0.5), math.sqrt(0.5), 1.0, math.sqrt(1.5)]


def wild_bootstrap(scores: DataFrame, cluster: str, score: str, draws: int, seed: int, block: int = 1024) -> DataFrame:
    """(t_stat, p_value, draws): null-imposed cluster scores with Webb weights from a hash of (draw, cluster).

    A task weighs a block of clusters for all draws at once and sends a row for each draw, so clusters are never copied."""
    def add(frames):
        points, numbers = np.array(WEBB), np.arange(draws + 1, dtype=np.uint64)[:, None]
        one, two = np.zeros(draws + 1), np.zeros(draws + 1)
        for whole in frames:
            for at in range(0, len(whole), block):
                f = whole.iloc[at:at + block]
                h = f["h"].to_numpy().view(np.uint64)[None, :] ^ (numbers * np.uint64(0x9E3779B97F4A7C15))
                for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                    h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
                w = points[((h >> np.uint64(32)) * np.uint64(6) >> np.uint64(32)).astype(np.int64)]
                w[0] = 1.0
                s = w * f["s"].to_numpy()[None, :]
                one += s.sum(1)
                two += (s * s).sum(1)
        yield pd.DataFrame({"draw": np.arange(draws + 1), "one": one, "two": two})

    own = scores.select(F.xxhash64(F.lit(seed), F.col(cluster).cast("string")).alias("h"), F.col(score).cast("double").alias("s"))
    t = own.mapInPandas(add, "draw int, one double, two double").groupBy("draw").agg((F.abs(F.sum("one")) / F.sqrt(F.sum("two"))).alias("t"))
    t = saved(t, "draws")
    real = t.where("draw = 0").select(F.col("t").alias("t_stat"))
    return t.where("draw > 0").crossJoin(F.broadcast(real)).groupBy("t_stat").agg(((F.count_if(F.col("t") >= F.col("t_stat") * (1 - 1e-9)) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.count(F.lit(1)).alias("draws"))
