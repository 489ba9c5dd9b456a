"""Least squares over windows from factors that merge: exact where sums of squares would cancel, at any number of features.

Rows of (x_1..x_k, y) are held as a count, a mean and a triangular factor R of the rows' deviations from it, with
R'R their co-moments. Two such states merge by one more QR of both factors and the difference of the means, so
they add up over batches, tasks and months as sums do, without ever squaring a value: a spread keeps its
precision whatever its level. A window's least-squares problem is the factor's own, k + 1 rows instead of the
window's, and so are its residual spread and its solution of least norm.

Spark does the rest: Arrow batches of rows become a state for each key, month and stage inside the task, states
(not rows) are shuffled and merged as a stream, and each key's months slide through its windows: the months of a
window are the end of one block of months and the beginning of the next, so each month is merged twice, however
long windows are. The plan is the same for 3 features and for 300: they travel as one array.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import ship

EPS = float(np.finfo(float).eps)
#: Bytes of states that a task holds before it hands them on.
HELD_BYTES = 64_000_000
#: The month of a training window that begins and ends inside months.
MID = -1_000_000


class State:
    """Rows with a target: their number, each feature's known values (count, mean, squared deviations), and the complete rows' factor."""

    __slots__ = ("n_rows", "known", "mu", "m2", "n", "mean", "r")

    def __init__(self, n_rows: int, known: np.ndarray, mu: np.ndarray, m2: np.ndarray, n: int, mean: np.ndarray, r: np.ndarray):
        self.n_rows, self.known, self.mu, self.m2, self.n, self.mean, self.r = n_rows, known, mu, m2, n, mean, r

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray) -> State:
        """x: rows x features, NaN for unknown values; y: known targets."""
        has = ~np.isnan(x)
        known = has.sum(axis=0).astype(float)
        at = np.where(known > 0, x[has.argmax(axis=0), np.arange(x.shape[1])], 0.0) if len(x) else np.zeros(x.shape[1])
        d = np.where(has, x - at, 0.0)  # from a value of each column, so that what does not vary has exactly no spread
        shift = d.sum(axis=0) / np.maximum(known, 1)
        m2 = (np.where(has, d - shift, 0.0) ** 2).sum(axis=0)
        full = has.all(axis=1) & ~np.isnan(y)
        rows = np.column_stack([x[full], y[full]])
        if len(rows):
            d = rows - rows[0]
            mean = d.sum(axis=0) / len(rows)
            out = State(len(y), known, at + shift, m2, len(rows), rows[0] + mean, d - mean)
        else:
            out = State(len(y), known, at + shift, m2, 0, np.zeros(x.shape[1] + 1), np.zeros((0, x.shape[1] + 1)))
        return out.small()

    def small(self) -> State:
        """The factor has no more rows than twice its columns."""
        if len(self.r) > 2 * self.r.shape[1]:
            self.r = np.linalg.qr(self.r, mode="r")
        return self

    def merge(self, o: State) -> State:
        if not o.n_rows:
            return self
        if not self.n_rows:
            return o
        known = self.known + o.known
        w = o.known / np.maximum(known, 1)
        d = np.where(self.known > 0, o.mu - self.mu, 0.0)
        mu = np.where(self.known > 0, self.mu + d * w, o.mu)
        m2 = self.m2 + o.m2 + d * d * self.known * w
        if not (self.n and o.n):
            other = self if self.n else o
            return State(self.n_rows + o.n_rows, known, mu, m2, other.n, other.mean, other.r)
        n = self.n + o.n
        d = o.mean - self.mean
        r = np.vstack([self.r, o.r, (np.sqrt(self.n * (o.n / n)) * d)[None, :]])
        return State(self.n_rows + o.n_rows, known, mu, m2, n, self.mean + d * (o.n / n), r).small()

    def pack(self) -> bytes:
        head = np.array([self.n_rows, self.n, len(self.r), len(self.mean)], float)
        return np.concatenate([head, self.known, self.mu, self.m2, self.mean, self.r.ravel()]).tobytes()

    @staticmethod
    def unpack(b: bytes) -> State:
        a = np.frombuffer(b)
        n_rows, n, rows, p = (int(v) for v in a[:4])
        k, at, parts = p - 1, 4, []
        for size in (k, k, k, p):
            parts.append(a[at : at + size])
            at += size
        return State(n_rows, parts[0], parts[1], parts[2], n, parts[3], a[at:].reshape(rows, p))

    def spread(self) -> np.ndarray:
        """Population deviations of the known values; NaN where they do not vary or there are none."""
        sd = np.sqrt(self.m2 / np.maximum(self.known, 1))
        return np.where(sd > 0, sd, np.nan)

    def solve(self, standardised: bool = True, constant: bool = True) -> np.ndarray | None:
        """Intercept and coefficients by least squares, of least norm (among standardised features, if so) where they are collinear.

        None without complete rows or, for standardised features, where one does not vary.
        """
        k = len(self.mean) - 1
        mu, sd = (self.mu, self.spread()) if standardised else (np.zeros(k), np.ones(k))
        if not self.n or np.isnan(sd).any():
            return None
        r, root = self.r[:, :k] / sd, np.sqrt(self.n)
        if not constant:
            rows = np.vstack([root * self.mean[:k] / sd, r])
            b = np.linalg.lstsq(rows, np.append(root * self.mean[k], self.r[:, k]), rcond=EPS * max(self.n, k))[0]
            return np.concatenate([[0.0], b / sd])
        level, own = (self.mean[:k] - mu) / sd, np.sqrt((r * r).sum(axis=0))
        varies = own > 0
        scale = np.where(varies, own, 1.0)
        u, size, vt = np.linalg.svd(r / scale, full_matrices=True) if len(r) else (np.zeros((0, 0)), np.zeros(0), np.eye(k))
        noise = EPS * max(self.n, k + 1, 8 * (np.abs(self.mean[:k]) / sd * root / scale)[varies].max(initial=0.0))  # rounding of the values themselves
        rank = int((size > noise * size.max(initial=0.0)).sum())
        b = vt[:rank].T @ ((u[:, :rank].T @ self.r[:, k]) / size[:rank]) / scale
        out = np.concatenate([[self.mean[k] - b @ level], b])
        if rank < k:  # directions in which the fit does not change, the intercept with them: what lies in them goes
            free = vt[rank:].T / scale[:, None]
            flat = np.vstack([-(level @ free), free])
            q = np.linalg.qr(flat / np.linalg.norm(flat, axis=0))[0]
            out -= q @ (q.T @ out)
        slopes = out[1:] / sd
        return np.concatenate([[out[0] - slopes @ mu], slopes])

    def residual_spread(self, b: np.ndarray) -> float | None:
        """The population deviation of y - b'x over the complete rows; None without any."""
        if not self.n:
            return None
        return float(np.linalg.norm(self.r @ np.append(-b[1:], 1.0)) / np.sqrt(self.n))


def slide(states: dict[int, State], lows: Sequence[int], length: int) -> Iterator[State | None]:
    """For each start of a window, ascending, the state of the ``length`` months from it on; None without rows.

    Blocks of ``length`` months: a window is a block's end and the next block's beginning. One block's ends are held.
    """
    block, ends, ahead_block, ahead, ahead_to = None, {}, None, None, 0

    def plus(a: State | None, b: State | None) -> State | None:
        return b if a is None else a if b is None else a.merge(b)

    for lo in lows:
        b = lo // length
        if b != block:
            block, ends, last = b, {}, None
            for m in range((b + 1) * length - 1, b * length - 1, -1):
                last = plus(states.get(m), last)
                ends[m] = last
        if ahead_block != b + 1:
            ahead_block, ahead, ahead_to = b + 1, None, (b + 1) * length
        while ahead_to < lo + length:
            ahead, ahead_to = plus(ahead, states.get(ahead_to)), ahead_to + 1
        yield plus(ends[lo], ahead)


def vector(xs: Sequence[str] | str) -> Column:
    """Feature columns as one array, or the array column that holds them already."""
    return F.col(xs).cast("array<double>") if isinstance(xs, str) else F.array(*[F.col(x).cast("double") for x in xs])


def month_number(day: Column) -> Column:
    """Months since 1900, for a date."""
    return ((F.year(day) - 1900) * 12 + F.month(day) - 1).cast("int")


def month_of(day: date) -> int:
    return (day.year - 1900) * 12 + day.month - 1


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Arrays of one length as rows; NaN for what is null or not finite, and for a null array."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    values[~np.isfinite(values)] = np.nan
    there = len(lists) - lists.null_count
    k = len(values) // max(1, there)
    if not lists.null_count:
        return values.reshape(len(lists), k)
    out = np.full((len(lists), k), np.nan)
    out[lists.is_valid().to_numpy(zero_copy_only=False)] = values.reshape(there, k)
    return out


def states(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, state): rows of keys, y double (not null) and x array<double> are summed up in their tasks, then by key, without holding more than a state of each."""
    ship(rows.sparkSession)
    keys = list(keys)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "state binary"])

    def batch(found: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*types, pa.binary()], strict=True)], names=[*keys, "state"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, types = {}, 0, None
        for b in batches:
            types = [b.schema.field(c).type for c in keys]
            n = b.num_rows
            if not n:
                continue
            x, y = matrix(b.column("x")), b.column("y").to_numpy(zero_copy_only=False).astype(float)
            y[~np.isfinite(y)] = np.nan
            own = [b.column(c).to_pylist() for c in keys]
            codes = np.zeros(n, np.int64)
            for c in own:
                f, u = pd.factorize(pd.Series(c, dtype=object), use_na_sentinel=False)
                codes = pd.factorize(codes * (len(u) + 1) + f)[0]
            order = np.argsort(codes, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
                key, s = tuple(c[part[0]] for c in own), State.of(x[part], y[part])
                old = held.get(key)
                held[key] = s if old is None else old.merge(s)
                size += held[key].r.nbytes - (old.r.nbytes if old is not None else 0) + 8 * 4 * x.shape[1]
            if size > HELD_BYTES:
                yield batch([(*k, s.pack()) for k, s in held.items()], types)
                held, size = {}, 0
        if held:
            yield batch([(*k, s.pack()) for k, s in held.items()], types)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, types = None, None, None
        for b in batches:
            types, out = [b.schema.field(c).type for c in keys], []
            for *key, packed in zip(*(b.column(c).to_pylist() for c in [*keys, "state"]), strict=True):
                s = State.unpack(packed)
                if now == key:
                    state = state.merge(s)
                    continue
                if now is not None:
                    out.append((*now, state.pack()))
                now, state = key, s
            if out:
                yield batch(out, types)
        if now is not None:
            yield batch([(*now, state.pack())], types)

    found = rows.select(*keys, "y", "x").mapInArrow(partial, schema)
    if not keys:
        return found.coalesce(1).mapInArrow(merged, schema)  # one state for each task
    return found.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merged, schema)


FIT = "refit_date date, n_rows long, n long, coef array<double>, sigma double, mu array<double>, sd array<double>, stages array<struct<stage: string, n_rows: long, n: long, coef: array<double>, sigma: double>>"


def _fit_types() -> dict[str, pa.DataType]:
    stage = pa.struct([("stage", pa.string()), ("n_rows", pa.int64()), ("n", pa.int64()), ("coef", pa.list_(pa.float64())), ("sigma", pa.float64())])
    return {"refit_date": pa.date32(), "n_rows": pa.int64(), "n": pa.int64(), "coef": pa.list_(pa.float64()), "sigma": pa.float64(), "mu": pa.list_(pa.float64()), "sd": pa.list_(pa.float64()), "stages": pa.list_(stage)}


def _plain(v: np.ndarray | None) -> list | None:
    return None if v is None else [None if np.isnan(x) else float(x) for x in v]


def _fit(own: dict[str, State]) -> dict:
    """What is known of a window from the states of its stages."""
    total = None
    for s in sorted(own, key=str):
        total = own[s] if total is None else total.merge(own[s])
    b = total.solve()
    stages = [{"stage": s, "n_rows": w.n_rows, "n": w.n, "coef": _plain(b if len(own) == 1 else w.solve()), "sigma": None if b is None else w.residual_spread(b)} for s, w in own.items()]
    return {"n_rows": total.n_rows, "n": total.n, "coef": _plain(b), "sigma": None if b is None else total.residual_spread(b), "mu": _plain(np.where(total.known > 0, total.mu, np.nan)), "sd": _plain(total.spread()), "stages": stages}


def single_fits(found: DataFrame) -> DataFrame:
    """A ``FIT`` for each refit date of (refit_date, stage, state): windows that share no rows, as each has its own."""
    ship(found.sparkSession)

    def fit(table: pa.Table) -> pa.Table:
        row = {"refit_date": table["refit_date"][0].as_py(), **_fit({s: State.unpack(b) for s, b in zip(table["stage"].to_pylist(), table["state"].to_pylist(), strict=True)})}
        return pa.table([pa.array([row[c]], t) for c, t in _fit_types().items()], names=list(_fit_types()))

    return found.groupBy("refit_date").applyInArrow(fit, FIT)


def window_fits(monthly: DataFrame, keys: Sequence[str], refits: Sequence[date], window_months: int) -> DataFrame:
    """(keys, a ``FIT``) for each refit date and key with a row in its window. monthly: (keys, month, stage, state).

    Stages merge to the overall window. sigma: the residual spread of the overall model, over all rows and for each
    stage; coef of a stage: its own model. A key's months pass through one task; they are as many as the calendar has.
    """
    ship(monthly.sparkSession)
    keys = list(keys)
    grouped = keys or ["__all"]
    monthly = monthly if keys else monthly.withColumn("__all", F.lit(0))
    kinds = dict(monthly.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in grouped], FIT])
    whole = [r for r in refits if r.day == 1]
    mid = [r for r in refits if r.day != 1]

    def fits(table: pa.Table) -> pa.Table:
        by: dict[str, dict[int, State]] = {}
        for month, stage, packed in zip(*(table[c].to_pylist() for c in ("month", "stage", "state")), strict=True):
            by.setdefault(stage, {})[month] = State.unpack(packed)
        lows = [month_of(r) - window_months for r in whole]
        windows = {stage: slide(found, lows, window_months) for stage, found in by.items()}
        out = []
        for r in [*mid, *whole]:
            own = {s: by[s].get(MID) for s in by} if r.day != 1 else {s: next(w) for s, w in windows.items()}
            own = {s: w for s, w in own.items() if w is not None and w.n_rows}
            if not own:
                continue
            out.append({"refit_date": r, **_fit(own)})
        first = [pa.array([table[c][0].as_py()] * len(out), table.schema.field(c).type) for c in grouped]
        return pa.table([*first, *[pa.array([o[c] for o in out], t) for c, t in _fit_types().items()]], names=[*grouped, *_fit_types()])

    found = monthly.groupBy(*grouped).applyInArrow(fits, schema)
    return found if keys else found.drop("__all")


def predicted(coef: Column, x: Column) -> Column:
    """coef[0] + coef[1:] . x; null where the model or a feature is."""
    return F.aggregate(F.zip_with(F.slice(coef, 2, F.greatest(F.size(coef) - 1, F.lit(0))), x, lambda b, v: b * v), F.get(coef, 0), lambda s, v: s + v)
