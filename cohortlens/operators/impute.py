"""Chained-equation imputation from sufficient statistics.

Semantics follow the iterative imputer of the modelled workflow: start from
column means, then for ``max_iter`` rounds regress every column (ascending
by missing fraction, stable) on all others using the current values of the
rows where it is observed, and overwrite its missing cells with the
prediction (Gauss-Seidel order).  The default regressor is Bayesian ridge
(evidence maximisation of alpha and lambda); ``estimator='least_squares'``
gives plain OLS with intercept.  A round stops the loop when the matrix
inf-norm of the change is below ``tol * max|observed|``.

Distributed form: a row with missing-pattern p (bitmask over the columns)
always equals ``T_p @ z`` with ``z = [1, x with missing cells = 0]``, because
every update is affine in the row's observed values.  So one Spark pass
collects ``S_p = sum z z'`` per pattern (at most 2^d small matrices, map-side
partial aggregation); every regression needs only ``sum_p T_p S_p T_p'`` over
the patterns where the target is observed.  Columns are shifted by their means
first (which changes no regression), so that the sums keep their digits when
values are large and spread little.  The rounds run on those small matrices on
the driver; the final ``T_p`` are applied in one Arrow pass.
The early-stop test needs the row-wise change: one aggregate pass per round
(``early_stop='exact'``) or none (``'off'``: fixed rounds).

Where the rows have more patterns than the driver should hold, the same rounds
run over the rows instead: a table of current values, one pass of normal
equations per regression ((d+1)^2 sums in a tree), and one pass per round that
writes the new values and measures their change.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators import sums as S
from cohortlens.session import materialize

EPS = np.finfo(np.float64).eps
#: Columns at most (the pattern is a 32-bit mask).
MAX_COLUMNS = 30
#: Bytes of pattern statistics and transforms that the driver holds; with more patterns the rounds run over the rows.
STATE_BYTES = 160 << 20


def most_patterns(d: int, max_iter: int) -> int:
    """Patterns whose matrices (statistics, and a transform per round) fit into ``STATE_BYTES``."""
    return max(1, STATE_BYTES // (8 * (d + 1) ** 2 * (max_iter + 2)))


def count_patterns(df: DataFrame, cols: Sequence[str], most: int) -> int:
    """Distinct missing patterns, counted up to ``most`` + 1."""
    return df.select(*[F.col(c).isNull().alias(c) for c in cols]).distinct().limit(most + 1).count()


# ------------------------------------------------------------------ estimators on statistics
def _centered(M: np.ndarray, m: np.ndarray, n: float, nb: np.ndarray, j: int):
    """Centered cross products for regressing column j on columns nb."""
    x_off, y_off = m[nb] / n, m[j] / n
    XtX = M[np.ix_(nb, nb)] - n * np.outer(x_off, x_off)
    Xty = M[nb, j] - n * x_off * y_off
    yty = M[j, j] - n * y_off * y_off
    return XtX, Xty, yty, x_off, y_off


def bayesian_ridge(XtX, Xty, yty, n, max_iter=300, tol=1e-3, a1=1e-6, a2=1e-6, l1=1e-6, l2=1e-6):
    """Bayesian ridge (evidence maximisation) from centered sufficient statistics; returns coef."""
    ev, V = np.linalg.eigh(XtX)
    ev = np.clip(ev, 0.0, None)
    VtXty = V.T @ Xty
    alpha, lam = 1.0 / (yty / n + EPS), 1.0

    def coef_rmse(alpha, lam):
        c = V @ (VtXty / (ev + lam / alpha))
        rmse = yty - 2 * c @ Xty + c @ XtX @ c
        return c, max(rmse, 0.0)

    coef_old = None
    for it in range(max_iter):
        coef, rmse = coef_rmse(alpha, lam)
        gamma = np.sum((alpha * ev) / (lam + alpha * ev))
        lam = (gamma + 2 * l1) / (np.sum(coef ** 2) + 2 * l2)
        alpha = (n - gamma + 2 * a1) / (rmse + 2 * a2)
        if it != 0 and np.sum(np.abs(coef_old - coef)) < tol:
            break
        coef_old = coef.copy()
    coef, _ = coef_rmse(alpha, lam)
    return coef


def least_squares(XtX, Xty, yty, n):
    return np.linalg.lstsq(XtX, Xty, rcond=None)[0]


ESTIMATORS = {"bayesian_ridge": bayesian_ridge, "least_squares": least_squares}


# ------------------------------------------------------------------ Spark passes
def pattern_statistics(df: DataFrame, cols: Sequence[str], with_bounds: bool = False):
    """S_p = sum over rows of pattern p of z z' (z = [1, filled values]); one pass.

    Each task builds its partial S_p with NumPy over Arrow batches and emits
    long rows (pattern, entry, value); a Spark ``groupBy`` adds the partials
    (and takes max |z_k| for the early-stop bounds).  The driver receives at
    most 2^d x ((d+1)(d+2)/2 + d+1) numbers: bounded by d, not by rows.  (A
    single SQL aggregate with one sum per entry would exceed the whole-stage
    codegen field limit for 13 columns.)
    """
    d = len(cols)
    if d > MAX_COLUMNS:
        raise ValueError(f"{d} columns to impute; at most {MAX_COLUMNS}")
    iu = np.triu_indices(d + 1)
    n_tri = len(iu[0])
    schema = T.StructType([T.StructField("p", T.IntegerType()), T.StructField("e", T.IntegerType()),
                           T.StructField("s", T.DoubleType()), T.StructField("m", T.DoubleType())])

    def partial(batches):
        acc: dict[int, list] = {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = pdf[list(cols)].to_numpy(dtype=np.float64, na_value=np.nan)
            miss = np.isnan(X)
            pat = (miss * (1 << np.arange(d))).sum(axis=1)
            Z = np.concatenate([np.ones((len(X), 1)), np.where(miss, 0.0, X)], axis=1)
            for p in np.unique(pat):
                zp = Z[pat == p]
                S, m = zp.T @ zp, np.abs(zp).max(axis=0)
                if int(p) in acc:
                    acc[int(p)][0] += S
                    acc[int(p)][1] = np.maximum(acc[int(p)][1], m)
                else:
                    acc[int(p)] = [S, m]
        if acc:
            ps, es, ss, ms = [], [], [], []
            for p, (S, m) in acc.items():
                ps += [p] * (n_tri + d + 1)
                es += list(range(n_tri + d + 1))
                ss += list(S[iu]) + [0.0] * (d + 1)
                ms += [0.0] * n_tri + list(m)
            yield pd.DataFrame({"p": ps, "e": es, "s": ss, "m": ms})
    sums = (df.select(*cols).mapInPandas(partial, schema)
            .groupBy("p", "e").agg(F.sum("s").alias("s"), F.max("m").alias("m")))
    # the caller has counted the patterns
    rows = sums.collect()
    out, bounds = {}, {}
    for r in rows:
        p, e = int(r["p"]), int(r["e"])
        if p not in out:
            out[p] = np.zeros((d + 1, d + 1))
            bounds[p] = np.zeros(d + 1)
        if e < n_tri:
            a, b = iu[0][e], iu[1][e]
            out[p][a, b] = out[p][b, a] = r["s"]
        else:
            bounds[p][e - n_tri] = r["m"]
    return (out, bounds) if with_bounds else out


def _apply_frame(df: DataFrame, cols: Sequence[str], transforms: dict[int, np.ndarray], keep: Sequence[str],
                 out_prefix: str = "", other=None) -> DataFrame:
    """Rows -> T_p @ z per pattern, one NumPy matmul per (batch, pattern); ``other`` makes T_p of further patterns."""
    d = len(cols)
    keep = [k for k in keep if k not in cols]
    src = df.select(*keep, *cols)
    schema = T.StructType([src.schema[k] for k in keep] +
                          [T.StructField(out_prefix + c, T.DoubleType()) for c in cols])
    Ts = {p: np.asarray(t, dtype=np.float64) for p, t in transforms.items()}

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = pdf[list(cols)].to_numpy(dtype=np.float64, na_value=np.nan)
            miss = np.isnan(X)
            pat = (miss * (1 << np.arange(d))).sum(axis=1)
            Z = np.concatenate([np.ones((len(X), 1)), np.where(miss, 0.0, X)], axis=1)
            Y = np.where(miss, np.nan, X)
            for p in np.unique(pat):
                idx = pat == p
                if p == 0:
                    continue
                if int(p) not in Ts:
                    Ts[int(p)] = other(int(p))
                Y[idx] = Z[idx] @ Ts[int(p)].T
            out = pdf[keep].copy()
            for i, c in enumerate(cols):
                out[out_prefix + c] = Y[:, i]
            yield out
    return src.mapInPandas(run, schema)


def _max_changes(df: DataFrame, cols: Sequence[str], deltas: list[dict[int, np.ndarray]]) -> list[float]:
    """Matrix inf-norm of several rounds' changes in one pass:
    for each round r, max over rows of sum_j |(dT_p^r z)_j|."""
    d = len(cols)
    R = len(deltas)
    D = [{p: np.asarray(t) for p, t in dl.items()} for dl in deltas]
    schema = T.StructType([T.StructField("r", T.IntegerType()), T.StructField("m", T.DoubleType())])

    def run(batches):
        best = np.zeros(R)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = pdf[list(cols)].to_numpy(dtype=np.float64, na_value=np.nan)
            miss = np.isnan(X)
            pat = (miss * (1 << np.arange(d))).sum(axis=1)
            Z = np.concatenate([np.ones((len(X), 1)), np.where(miss, 0.0, X)], axis=1)
            for p in np.unique(pat):
                zp = Z[pat == p]
                for r in range(R):
                    if int(p) in D[r]:
                        best[r] = max(best[r], float(np.abs(zp @ D[r][int(p)].T).sum(axis=1).max()))
        yield pd.DataFrame({"r": np.arange(R, dtype=np.int32), "m": best})
    rows = df.select(*cols).mapInPandas(run, schema).groupBy("r").agg(F.max("m").alias("m")).collect()
    out = [0.0] * R
    for row in rows:
        out[int(row["r"])] = float(row["m"])
    return out


# ------------------------------------------------------------------ driver rounds
def pattern_transform(p: int, means: np.ndarray, rounds: Sequence[Sequence[tuple]] = ()) -> np.ndarray:
    """T_p (d x (d+1)) of any pattern: mean start, then the regressions (column, coef, intercept) of ``rounds``."""
    d = len(means)
    t = np.zeros((d, d + 1))
    gaps = [j for j in range(d) if (p >> j) & 1]
    for j in range(d):
        t[j, 0 if j in gaps else j + 1] = means[j] if j in gaps else 1.0
    for steps in rounds:
        for j, coef, intercept in steps:
            if j in gaps:
                new = coef @ np.delete(t, j, axis=0)
                new[0] += intercept
                t[j] = new
    return t


def fit_transforms(stats: dict[int, np.ndarray], d: int, max_iter: int = 10, estimator: str = "bayesian_ridge",
                   all_columns: bool = False):
    """Run all imputation rounds on pattern statistics.

    Returns (T0, history, means, rounds): the mean-imputation transforms; per
    round the transforms {pattern: T_p (d x (d+1))} after it; the column
    means; and per round its regressions, from which ``pattern_transform``
    makes the transform of a pattern that the statistics lack.
    ``all_columns`` also fits columns without a gap (for other rows' gaps).
    The rounds do not depend on the early-stop test, so it can be decided
    afterwards.
    """
    est = ESTIMATORS[estimator]
    pats = sorted(stats)
    miss = {p: np.array([(p >> j) & 1 for j in range(d)], dtype=bool) for p in pats}
    counts = {p: stats[p][0, 0] for p in pats}
    n_obs = np.array([sum(counts[p] for p in pats if not miss[p][j]) for j in range(d)])
    sums = np.array([sum(stats[p][0, j + 1] for p in pats if not miss[p][j]) for j in range(d)])
    if np.any(n_obs == 0):
        raise ValueError("a column has no observed value")
    means = sums / n_obs
    Tm = {p: pattern_transform(p, means) for p in pats}
    T0 = {p: t.copy() for p, t in Tm.items()}
    n_total = sum(counts.values())
    frac = np.array([1 - n_obs[j] / n_total for j in range(d)])
    order = np.argsort(frac, kind="mergesort")
    history, rounds = [], []
    for _ in range(max_iter):
        rounds.append([])
        for j in order:
            obs_p = [p for p in pats if not miss[p][j]]
            mis_p = [p for p in pats if miss[p][j]]
            if not (mis_p or all_columns):
                continue
            A = sum(Tm[p] @ stats[p] @ Tm[p].T for p in obs_p)
            m = sum(Tm[p] @ stats[p][:, 0] for p in obs_p)
            n = sum(counts[p] for p in obs_p)
            nb = np.array([k for k in range(d) if k != j])
            XtX, Xty, yty, x_off, y_off = _centered(A, m, n, nb, j)
            coef = est(XtX, Xty, yty, n)
            intercept = y_off - x_off @ coef
            rounds[-1].append((int(j), coef, intercept))
            for p in mis_p:
                new = coef @ Tm[p][nb]
                new[0] += intercept
                Tm[p][j] = new
        history.append({p: t.copy() for p, t in Tm.items()})
    return T0, history, means, rounds


def stopping_round(T0, history, stats, bounds, limit: float, exact_fn) -> int:
    """Index of the round whose result is returned: the first round whose change
    (matrix inf-norm over rows) is below ``limit``, else the last one.

    Per-pattern bounds decide most rounds (upper: triangle inequality with
    max |z_k|; lower: the change at the pattern's mean row, by convexity);
    all undecided rounds before the first certain stop are measured exactly
    in one Spark pass.
    """
    def delta(r):
        prev = T0 if r == 0 else history[r - 1]
        return {p: history[r][p] - prev[p] for p in history[r] if p != 0}
    undecided = []
    certain = len(history) - 1
    for r in range(len(history)):
        dl = delta(r)
        upper = max((float((np.abs(D) @ bounds[p]).sum()) for p, D in dl.items()), default=0.0)
        lower = max((float(np.abs(D @ (stats[p][:, 0] / stats[p][0, 0])).sum()) for p, D in dl.items()), default=0.0)
        if upper < limit:
            certain = r
            break
        if lower < limit:
            undecided.append(r)
    if undecided:
        changes = exact_fn([delta(r) for r in undecided])
        for r, c in zip(undecided, changes):
            if c < limit:
                return r
    return certain


# ------------------------------------------------------------------ rounds over rows
def _replay(X: np.ndarray, miss: np.ndarray, steps: Sequence[tuple]) -> np.ndarray:
    """Current values after the regressions (column, coef, intercept), in place."""
    for j, coef, intercept in steps:
        gaps = miss[:, j]
        if gaps.any():
            X[gaps, j] = np.delete(X[gaps], j, axis=1) @ coef + intercept
    return X


def _filled(pdf: pd.DataFrame, cols: Sequence[str], means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    X = pdf[list(cols)].to_numpy(dtype=np.float64, na_value=np.nan)
    miss = np.isnan(X)
    return np.where(miss, means, X), miss


def _current(cols: Sequence[str], pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    d = len(cols)
    X = np.array(pdf[list(cols)].to_numpy(dtype=np.float64))
    return X, (pdf["_gaps"].to_numpy()[:, None] >> np.arange(d)) & 1 == 1


def row_rounds(df: DataFrame, cols: Sequence[str], max_iter: int, estimator: str, all_columns: bool = False,
               limit: float | None = None) -> tuple[np.ndarray, list[list[tuple]]]:
    """Column means and the regressions of every round, as ``fit_transforms`` gives them, without any state per pattern.

    A regression takes one pass, which replays the round's earlier regressions
    on the rows; a round ends with a pass that writes the current values.  With
    ``limit`` the rounds end behind the first whose change (matrix inf-norm
    over rows) is below it.
    """
    d, est = len(cols), ESTIMATORS[estimator]
    if d > MAX_COLUMNS:
        raise ValueError(f"{d} columns to impute; at most {MAX_COLUMNS}")
    first = df.agg(F.count(F.lit(1)), *[F.count(c) for c in cols], *[F.avg(c) for c in cols]).first()
    n_total, n_obs = first[0], np.array(first[1:d + 1], float)
    if n_total == 0 or np.any(n_obs == 0):
        raise ValueError("a column has no observed value")
    means = np.array(first[d + 1:], float)
    order = np.argsort(1 - n_obs / n_total, kind="mergesort")
    schema = T.StructType([*[T.StructField(c, T.DoubleType()) for c in cols], T.StructField("_gaps", T.LongType()), T.StructField("_change", T.DoubleType())])

    def start(batches):
        for pdf in batches:
            X, miss = _filled(pdf, cols, means)
            out = pd.DataFrame(X, columns=list(cols))
            yield out.assign(_gaps=(miss * (1 << np.arange(d))).sum(axis=1).astype(np.int64), _change=0.0)

    def equations(j: int, steps: list):
        def run(batches):
            total = np.zeros((d + 1, d + 1))
            for batch in batches:
                X, miss = _current(cols, batch.to_pandas())
                Z = _replay(X, miss, steps)[~miss[:, j]]
                Z = np.column_stack([np.ones(len(Z)), Z])
                total += Z.T @ Z
            yield S.partial(total.ravel())
        return run

    def write(steps: list):
        def run(batches):
            for pdf in batches:
                X, miss = _current(cols, pdf)
                new = _replay(X.copy(), miss, steps)
                yield pd.DataFrame(new, columns=list(cols)).assign(_gaps=pdf["_gaps"].to_numpy(), _change=np.abs(new - X).sum(axis=1))
        return run

    state = materialize(df.select(*cols).mapInPandas(start, schema))
    rounds: list[list[tuple]] = []
    for _ in range(max_iter):
        steps: list[tuple] = []
        for j in order:
            if n_obs[j] == n_total and not all_columns:
                continue
            sums = S.tree_sum(state.mapInArrow(equations(int(j), steps), S.SCHEMA), state.rdd.getNumPartitions()).reshape(d + 1, d + 1)
            nb = np.array([k for k in range(d) if k != j])
            XtX, Xty, yty, x_off, y_off = _centered(sums[1:, 1:], sums[0, 1:], sums[0, 0], nb, j)
            coef = est(XtX, Xty, yty, sums[0, 0])
            steps.append((int(j), coef, y_off - x_off @ coef))
        rounds.append(steps)
        state = materialize(state.mapInPandas(write(steps), schema))
        if limit is not None and (state.agg(F.max("_change")).first()[0] or 0.0) < limit:
            break
    return means, rounds


def _replay_frame(df: DataFrame, cols: Sequence[str], means: np.ndarray, rounds: list[list[tuple]], keep: Sequence[str]) -> DataFrame:
    """Rows with all regressions replayed from the column means on: ``keep`` and the imputed ``cols``."""
    src = df.select(*keep, *cols)
    schema = T.StructType([*[src.schema[k] for k in keep], *[T.StructField(c, T.DoubleType()) for c in cols]])

    def run(batches):
        for pdf in batches:
            X, miss = _filled(pdf, cols, means)
            for steps in rounds:
                X = _replay(X, miss, steps)
            out = pdf[list(keep)].copy()
            for i, c in enumerate(cols):
                out[c] = X[:, i]
            yield out
    return src.mapInPandas(run, schema)


def chained_impute(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), max_iter: int = 10,
                   estimator: str = "bayesian_ridge", tol: float = 1e-3, early_stop: str = "exact",
                   fit_on: DataFrame | None = None, by_rows: bool | None = None) -> DataFrame:
    """Returns ``keep`` columns plus the imputed ``cols`` (observed cells unchanged).

    ``fit_on`` fits the rounds on another frame (default: ``df`` itself, all rows);
    rows of ``df`` may then have gaps that no fitted row has.
    The input projection is checkpointed once (reliable storage) and serves the
    statistics pass, any exact early-stop pass and the final apply pass.
    ``by_rows`` chooses the form of the rounds; by default rounds over rows
    are taken where the patterns would not fit on the driver.
    """
    cols = list(cols)
    keep = [k for k in keep if k not in cols]
    fitted = df if fit_on is None else fit_on
    centre = fitted.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                        *[F.max(F.abs(F.col(c).cast("double"))).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    shift = [centre[f"m{i}"] or 0.0 for i in range(len(cols))]
    moved = [(F.col(c).cast("double") - F.lit(m)).alias(c) for c, m in zip(cols, shift)]
    # observed cells are carried along, so that they stay as they are to the last digit
    seen = [f"_seen{i}" for i in range(len(cols))]
    src = materialize(df.select(*keep, *[F.col(c).cast("double").alias(o) for c, o in zip(cols, seen)], *moved))
    base = materialize(fit_on.select(*moved)) if fit_on is not None else src
    max_abs = max((centre[f"a{i}"] or 0.0) for i in range(len(cols)))
    if by_rows is None:
        most = most_patterns(len(cols), max_iter)
        by_rows = count_patterns(base, cols, most) > most
    if by_rows:
        limit = tol * max_abs if early_stop == "exact" else None
        out = _replay_frame(src, cols, *row_rounds(base, cols, max_iter, estimator, fit_on is not None, limit), [*keep, *seen])
        return out.select(*keep, *[F.coalesce(F.col(o), F.col(c) + F.lit(m)).alias(c) for c, o, m in zip(cols, seen, shift)])
    stats, bounds = pattern_statistics(base, cols, with_bounds=True)
    T0, history, means, rounds = fit_transforms(stats, len(cols), max_iter, estimator, fit_on is not None)
    r = len(history) - 1
    if history and early_stop == "exact":
        r = stopping_round(T0, history, stats, bounds, tol * max_abs, lambda ds: _max_changes(base, cols, ds))
    done = rounds[:r + 1]
    out = _apply_frame(src, cols, history[r] if history else T0, [*keep, *seen], other=lambda p: pattern_transform(p, means, done))
    return out.select(*keep, *[F.coalesce(F.col(o), F.col(c) + F.lit(m)).alias(c) for c, o, m in zip(cols, seen, shift)])
