"""Logistic models of many expanding blocks at once, by Newton steps that Spark adds up.

Block b is fitted on the rows whose position is before warm + b * step - ahead,
so a row belongs to a block and to all later ones.  Tasks read their rows once a
step and send, once, for each block, the gradient and the curvature at its
present weights: a table of blocks by coefficients, whatever the number of rows.
No task holds the history, and no row is copied for later blocks.  Exact
quantiles of the fitted scores are found the same way, by counts within ever
narrower ranges.  Rows are laid in pieces of one kind once, so that later
readings move bytes, not rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newstide.sources import readers


@dataclass
class Blocks:
    """Fitted blocks: their numbers, and weights on the columns as they are (intercept first)."""

    number: list[int]
    weights: list[list[float]]
    #: A sample of under MANY rows, where there are more.
    few: DataFrame | None = None


def first_block(pos: str, warm: int, ahead: int, step: int):
    """The first block that a row at ``pos`` is learned from in."""
    return F.greatest(F.lit(0), F.floor((F.col(pos) - warm + ahead) / step) + 1).cast("int")


#: Rows that are held against all blocks at once (a table of blocks by rows that stays in a core's cache), of one piece, and that a task puts in order at once.
ROWS, PIECE, PACKED = 256, 1024, 1 << 17
PIECES = "_first int, hit double, n long, mean array<double>, spread array<double>, x binary"


def pieces(features: list[str], event: str | None) -> Callable:
    """A task's rows(_first, features, event) for mapInPandas as PIECES, each of one ``_first`` and event.

    ``x`` holds the piece's features as doubles, one after the other; ``mean``
    is theirs, and ``spread`` their sums of squares from it.
    """
    import numpy as np
    import pandas as pd

    def laid(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame["_first"].to_numpy(np.int64)
        hit = frame[event].to_numpy(float) if event else np.zeros(len(frame))
        order = np.lexsort((hit, first))
        first, hit = first[order], hit[order]
        x = np.empty((len(features), len(order)))
        for row, name in zip(x, features, strict=True):
            np.take(frame[name].to_numpy(float), order, out=row)
        ends = [0, *(np.flatnonzero((np.diff(first) != 0) | (np.diff(hit) != 0)) + 1).tolist(), len(order)]
        out = []
        for low, high in zip(ends, ends[1:], strict=False):
            for at in range(low, high, PIECE):
                own = np.ascontiguousarray(x[:, at : min(at + PIECE, high)])
                mean = own.mean(axis=1)
                out.append((int(first[at]), hit[at], own.shape[1], mean, ((own - mean[:, None]) ** 2).sum(axis=1), own.tobytes()))
        return pd.DataFrame(out, columns=["_first", "hit", "n", "mean", "spread", "x"])

    def run(batches):
        held: list = []
        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) >= PACKED:
                yield laid(pd.concat(held, ignore_index=True))
                held = []
        if held:
            yield laid(pd.concat(held, ignore_index=True))

    return run


def packed(rows: DataFrame, features: list[str], event: str | None = None) -> DataFrame:
    """Rows as PIECES, stored: what all later readings read, without taking a row apart again.  Pieces stay as they are."""
    if "spread" in rows.columns:
        return rows
    made = rows.select("_first", *features, *([event] if event else [])).mapInPandas(pieces(features, event), PIECES)
    # small row groups: a reader holds one of them at once
    return readers.stored(made, "known-pieces", **{"parquet.block.size": 16 << 20, "parquet.enable.dictionary": "false"})


def thinned(rows: DataFrame, k: int, p: int) -> DataFrame:
    """Each k-th row of the pieces of a task, as pieces."""
    import numpy as np
    import pandas as pd

    def run(batches):
        at, held = 0, {}
        for batch in batches:
            for first, hit, x in zip(batch["_first"], batch["hit"], batch["x"], strict=True):
                x = np.frombuffer(x).reshape(p, -1)
                held.setdefault((first, hit), []).append(x[:, at::k].copy())
                at = (at - x.shape[1]) % k
        out = []
        for (first, hit), parts in held.items():
            x = np.concatenate(parts, axis=1)
            if x.shape[1]:
                mean = x.mean(axis=1)
                out.append((first, hit, x.shape[1], mean, ((x - mean[:, None]) ** 2).sum(axis=1), x.tobytes()))
        yield pd.DataFrame(out, columns=["_first", "hit", "n", "mean", "spread", "x"])

    return readers.stored(rows.mapInPandas(run, PIECES), "few-rows")


def _chunks(batch, p: int, numbers):
    """Of pieces: (event, features by rows, the first block of ``numbers`` that learns from them), at most ROWS rows at once."""
    import numpy as np

    for first, hit, x in zip(batch["_first"], batch["hit"], batch["x"], strict=True):
        since = int(np.searchsorted(numbers, first))
        if since < len(numbers):
            x = np.frombuffer(x).reshape(p, -1)
            for at in range(0, x.shape[1], ROWS):
                yield hit, x[:, at : at + ROWS], since


def scores(x, w):
    """Of features by rows, the scores by blocks and rows, added up from left to right, so that a row's score doesn't hang on the rows beside it."""
    import numpy as np

    out = np.repeat(w[0][:, None], x.shape[1], axis=1)
    term = np.empty_like(out)
    for j in range(len(x)):
        np.multiply(w[j + 1][:, None], x[j], out=term)
        out += term
    return out


def slopes_and_bends(features: list[str], event: str, shift, numbers, raw, one, zero) -> Callable:
    """A task's sums for mapInPandas, (block, place, value): of each of ``numbers``, the gradient and the upper half of the curvature at its column of ``raw``.

    Rows, or pieces of them, meet all their blocks in matrix products: a row's
    cross products are made once, whatever the number of blocks, and a task
    sends its sums once.
    """
    import itertools

    import numpy as np
    import pandas as pd

    i, j = np.triu_indices(len(raw))

    def run(batches):
        total = np.zeros((len(raw) + len(i), len(numbers)))
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        batches = itertools.chain([head], batches)
        minus = np.ascontiguousarray(-raw.T)
        held = [np.empty(k * ROWS) for k in (len(raw), len(i), len(i), len(numbers), len(numbers))]  # the tables of a chunk, made once
        for batch in batches if "spread" in head.columns else pieces(features, event)(batches):
            for hit, x, since in _chunks(batch, len(features), numbers):
                size = x.shape[1]
                a, cross, other, prob, bend = (t[: k * size].reshape(k, size) for t, k in zip(held, (len(raw), len(i), len(i), len(numbers) - since, len(numbers) - since), strict=True))
                a[0] = 1.0
                np.subtract(x, shift[:, None], out=a[1:])
                np.matmul(minus[since:], a, out=prob)
                np.clip(prob, -30, 30, out=prob)
                np.exp(prob, out=prob)
                prob += 1
                np.reciprocal(prob, out=prob)
                np.subtract(1, prob, out=bend)
                bend *= prob
                prob -= hit
                np.take(a, i, axis=0, out=cross, mode="clip")
                np.take(a, j, axis=0, out=other, mode="clip")
                cross *= other
                weight = (one if hit == 1 else zero)[since:]
                total[: len(raw), since:] += (a @ prob.T) * weight
                total[len(raw) :, since:] += (cross @ bend.T) * weight
        if total.any():
            place, block = np.indices(total.shape)
            yield pd.DataFrame({"block": numbers[block.ravel()].astype("int32"), "place": place.ravel().astype("int32"), "value": total.ravel()})

    return run


#: Rows from which a fit starts at that of one row in THIN, and the largest first step from there (else it starts at zero).
MANY, THIN, NEAR = 1_000_000, 8, 0.5


def fit(rows: DataFrame, features: list[str], event: str, blocks: int, c: float = 1.0, balanced: bool = False, standardise: bool = True, rounds: int = 50) -> Blocks:
    """The l2-penalised logistic fit (intercept free) of each block of rows(_first, features, event), read once a Newton step.

    Penalties are on the columns in units of their standard deviation within the
    block if standardise.  Blocks without both classes are left out.  A fit of
    many rows starts at the fit of a few of them, which saves it readings; where
    it ends is for all rows to say.
    """
    import numpy as np

    p = len(features)
    rows = packed(rows, features, event)
    n, mean = F.col("n"), [F.col("mean")[i] for i in range(p)]
    shift = rows.agg(F.sum("n").alias("n"), *[F.sum(n * m).alias(f"m{i}") for i, m in enumerate(mean)]).first()
    shift = np.array([(shift[f"m{i}"] or 0.0) / (shift["n"] or 1) for i in range(p)])
    off = [m - float(s) for m, s in zip(mean, shift, strict=True)]
    told = rows.groupBy("_first").agg(F.sum("n").alias("n"), F.sum(n * F.col("hit")).alias("n1"), *[F.sum(n * o).alias(f"s{i}") for i, o in enumerate(off)], *[F.sum(F.col("spread")[i] + n * o * o).alias(f"q{i}") for i, o in enumerate(off)]).collect()
    sums = np.zeros((blocks, 2 + 2 * p))
    for r in told:  # a row for each block
        if r["_first"] < blocks:
            sums[r["_first"]] += [r["n"], r["n1"], *[r[f"s{i}"] for i in range(p)], *[r[f"q{i}"] for i in range(p)]]
    sums = sums.cumsum(axis=0)
    n, n1 = sums[:, 0], sums[:, 1]
    live = np.flatnonzero((n1 > 0) & (n1 < n))
    safe = np.maximum(n, 1)[:, None]
    mean, square = sums[:, 2 : 2 + p] / safe, sums[:, 2 + p :] / safe
    sd = np.sqrt(np.maximum(square - mean**2, 0))
    sd = np.where(sd > 1e-12 * np.sqrt(square + 1e-300), sd, 1.0)
    if not standardise:
        mean, sd = np.zeros_like(mean) - shift, np.ones_like(sd)
    one, zero = (n / (2 * np.maximum(n1, 1)), n / (2 * np.maximum(n - n1, 1))) if balanced else (np.ones(blocks), np.ones(blocks))
    turn = {}  # weights on standard columns to weights on centred ones
    for b in live:
        turn[b] = np.diag(np.append(1.0, 1 / sd[b]))
        turn[b][0, 1:] = -mean[b] / sd[b]
    ridge = np.diag(np.append(1e-9, np.full(p, 1 / c)))
    w = {b: np.zeros(p + 1) for b in live}
    started, sample = set(), None
    if len(live) and n[live[-1]] >= MANY:
        part = thinned(rows, THIN, p)
        few = fit(part, features, event, blocks, c, balanced, standardise, rounds)
        sample = part if few.few is None else few.few
        for b, beta in zip(few.number, few.weights, strict=True):
            if b in w and np.isfinite(beta).all():
                w[b] = np.linalg.solve(turn[b], [beta[0] + float(np.dot(beta[1:], shift)), *beta[1:]])
                started.add(b)
    at = np.triu_indices(p + 1)
    going, last = list(live), dict.fromkeys(live, np.nan)
    for _ in range(rounds):
        if not going:
            break
        numbers = np.array(going)
        raw = np.column_stack([turn[b] @ w[b] for b in going])
        sums_of = slopes_and_bends(features, event, shift, numbers, raw, one[numbers], zero[numbers])
        found = np.zeros((blocks, p + 1 + len(at[0])))
        for r in rows.select("_first", "hit", "x", "spread").mapInPandas(sums_of, "block int, place int, value double").groupBy("block", "place").agg(F.sum("value").alias("value")).collect():
            found[r["block"], r["place"]] = r["value"]
        still = []
        for b in going:
            bend = np.zeros((p + 1, p + 1))
            bend[at] = found[b, p + 1 :]
            bend = bend + np.triu(bend, 1).T
            move = np.linalg.solve(turn[b].T @ bend @ turn[b] + ridge, turn[b].T @ found[b, : p + 1] + ridge @ w[b])
            if b in started and not np.abs(move).max() <= NEAR:
                w[b], move = np.zeros(p + 1), np.array([np.inf])
            else:
                w[b] = w[b] - move
            far = np.abs(move).max()
            # a step is some constant times the last one's square: another is not made where it would be far below 1e-10
            if far > 1e-10 and not (far < 1e-3 * last[b] and far * (far / last[b]) ** 2 < 1e-12):
                still.append(b)
            last[b] = far if np.isfinite(far) else np.nan
        going, started = still, set()
    out = []
    for b in live:
        beta = turn[b] @ w[b]
        beta[0] -= float(beta[1:] @ shift)
        out.append(beta.tolist())
    return Blocks([int(b) for b in live], out, sample)


#: Parts of a range that a reading counts, scores that are few enough to send as they are, scores that a task holds before it counts them, and rows of the sample that tells the first range.
PARTS, FEW, COUNTED, SAMPLE = 1 << 11, 3_000, 1 << 20, 100_000
LEAST, MOST = -(2**63), 2**63 - 1


def _ordered(s):
    """Doubles as long integers in the same order; and back."""
    import numpy as np

    bits = np.ascontiguousarray(s).view(np.int64)
    flip = bits >> np.int64(63)
    flip &= np.int64(2**63 - 1)
    flip ^= bits
    return flip


def _doubles(keys, beyond: float):
    """The doubles of such integers; ``beyond`` for what is none."""
    import numpy as np

    value = _ordered(keys.view(np.float64)).view(np.float64)
    return np.where(np.isnan(value), beyond, value)


def counts_within(features: list[str], numbers, w, low, high, shift) -> Callable:
    """A task's counts for mapInPandas, (block, bucket, n): of each block, the scores from ``low`` to ``high`` by their distance from low in units of 2 ** shift, and those below as bucket -1.

    Bounds are integers as :func:`_ordered` has them.  A matrix product tells
    which scores are near the range, and these are added up as scores() does.
    """
    import numpy as np
    import pandas as pd

    wide = np.abs(w)
    ends = _doubles(low, -np.inf), _doubles(high, np.inf)

    def run(batches):
        below, whole = np.zeros(len(numbers), dtype=np.int64), None
        held, size = [], 0

        def added():
            got = pd.DataFrame({"block": np.concatenate([p for p, _ in held]), "bucket": np.concatenate([k for _, k in held])}).groupby(["block", "bucket"]).size()
            held.clear()
            return got if whole is None else whole.add(got, fill_value=0).astype("int64")

        for batch in batches:
            for _, x, since in _chunks(batch, len(features), numbers):
                a = np.vstack([np.ones(x.shape[1]), x])
                slack = 1e-9 * (1 + wide[:, since:].T @ np.abs(a).max(axis=1))
                score = w.T[since:] @ a
                under = score < (ends[0][since:] - slack)[:, None]
                at, row = np.nonzero(~(under | (score > (ends[1][since:] + slack)[:, None])))
                below[since:] += np.count_nonzero(under, axis=1)
                exact = w[0, at + since].copy()
                for j in range(len(x)):
                    exact += x[j, row] * w[j + 1, at + since]
                key, at = _ordered(exact), at + since
                before = key < low[at]
                below += np.bincount(at[before], minlength=len(numbers))
                sure = ~before & (key <= high[at])
                at, key = at[sure], key[sure]
                held.append((at, ((key - low[at]).view(np.uint64) >> shift[at]).view(np.int64)))
                size += len(at)
                if size >= COUNTED:
                    whole, size = added(), 0
        if held:
            whole = added()
        if below.any():
            yield pd.DataFrame({"block": numbers.astype("int32"), "bucket": -1, "n": below})
        if whole is not None:
            got = whole.reset_index(name="n")
            yield got.assign(block=numbers[got["block"].to_numpy()].astype("int32"))

    return run


def _near_quantile(few: DataFrame, features: list[str], numbers, w, q: float):
    """Bounds that hold the blocks' q-quantiles but by rare chance, from a sample of some SAMPLE rows."""
    import numpy as np

    n = few.agg(F.sum("n")).first()[0] or 0
    told = thinned(few, max(1, n // SAMPLE), len(features)).select("_first", "x").collect()  # bounded by SAMPLE
    first = np.concatenate([np.full(len(r["x"]) // 8 // len(features), r["_first"]) for r in told])
    score = scores(np.concatenate([np.frombuffer(r["x"]).reshape(len(features), -1) for r in told], axis=1), w)
    low, high = np.full(len(numbers), LEAST), np.full(len(numbers), MOST)
    for i, b in enumerate(numbers):
        own = np.sort(score[i, first <= b])
        away = 8 * np.sqrt(q * (1 - q) * len(own)) + 8
        for bound, at in ((low, int(q * len(own) - away)), (high, int(q * len(own) + away))):
            if 0 <= at < len(own):
                bound[i] = _ordered(own[at : at + 1])[0]
    return low, high


def score_quantile(rows: DataFrame, features: list[str], fitted: Blocks, q: float) -> list[float]:
    """Of each fitted block, the score at the q-quantile of its rows' probabilities (linear between the two beside it).

    The two are found exactly: each reading counts the scores below a range that
    holds both, and those in the range's parts, until few scores are left or
    the parts are single doubles.  Where a sample's range doesn't hold them, the
    search starts again at that of all doubles.
    """
    import numpy as np

    if not fitted.number:
        return []
    rows = packed(rows, features)
    numbers = np.array(fitted.number)
    w = np.array(fitted.weights).T.copy()
    sizes = {r["_first"]: r["n"] for r in rows.groupBy("_first").agg(F.sum("n").alias("n")).collect()}  # a row for each block
    total = [sum(n for first, n in sizes.items() if first <= b) for b in fitted.number]
    part = [(n - 1) * q - int((n - 1) * q) for n in total]
    rank = [(int((n - 1) * q), min(int((n - 1) * q) + 1, n - 1)) for n in total]
    low, high = np.full(len(numbers), LEAST), np.full(len(numbers), MOST)
    if fitted.few is not None:
        low, high = _near_quantile(fitted.few, features, numbers, w, q)
    left = None
    while True:
        shift = np.array([max(0, (int(h) - int(lo)).bit_length() - PARTS.bit_length() + 1) for lo, h in zip(low, high, strict=True)], dtype=np.uint64)
        if left is not None and left <= FEW:
            shift[:] = 0
        told = rows.select("_first", "hit", "x").mapInPandas(counts_within(features, numbers, w, low, high, shift), "block int, bucket long, n long").groupBy("block", "bucket").agg(F.sum("n").alias("n")).collect()
        by: dict = {b: [] for b in fitted.number}
        for r in told:
            by[r["block"]].append((r["bucket"], r["n"]))
        found, left = np.zeros((2, len(numbers)), dtype=np.int64), 0
        for i, b in enumerate(fitted.number):
            listed = sorted(by[b])
            upto = np.cumsum([n for _, n in listed])
            at = np.searchsorted(upto, rank[i], side="right")
            if at[1] == len(listed) or listed[at[0]][0] < 0:  # not in the range
                left = None
                break
            a, z = (int(low[i]) + (listed[k][0] << int(shift[i])) for k in at)
            found[:, i] = a, z
            left = max(left, sum(n for _, n in listed[at[0] : at[1] + 1]))
            high[i] = min(int(high[i]), z + (1 << int(shift[i])) - 1)
            low[i] = a
        if left is None:
            low, high = np.full(len(numbers), LEAST), np.full(len(numbers), MOST)
        elif not shift.any():
            break
    out = []
    for (one, two), p in zip(_doubles(found, np.nan).T.tolist(), part, strict=True):
        if one == two or not p:
            out.append(one)
        else:
            prob = (1 - p) / (1 + np.exp(-one)) + p / (1 + np.exp(-two))
            out.append(float(np.log(prob / (1 - prob))))
    return out


def with_scores(rows: DataFrame, features: list[str], fitted: Blocks, block, **more: list[float]) -> DataFrame:
    """Rows of fitted blocks with ``score`` by the weights of their ``block`` (an expression), and the columns ``more`` of the block."""
    names = [f"_w{i}" for i in range(len(features) + 1)]
    values = [(b, *w, *[m[i] for m in more.values()]) for i, (b, w) in enumerate(zip(fitted.number, fitted.weights, strict=True))]
    table = rows.sparkSession.createDataFrame(values, "_block int" + "".join(f", {n} double" for n in [*names, *more]))
    out = F.col(names[0])
    for name, feature in zip(names[1:], features, strict=True):
        out = out + F.col(feature) * F.col(name)
    return rows.withColumn("_block", block).join(F.broadcast(table), "_block").withColumn("score", out).drop("_block", *names)


def expanding(rows: DataFrame, features: list[str], event: str, warm: int, ahead: int, step: int, **how) -> tuple[Blocks, DataFrame]:
    """The blocks of rows(pos, features, event) up to its last position, and the stored pieces of the rows that they learn from."""
    last = rows.agg(F.max("pos")).first()[0]
    blocks = 0 if last is None or last < warm else (int(last) - warm) // step + 1
    known = rows.where(F.col(event).isNotNull()).select(first_block("pos", warm, ahead, step).alias("_first"), *features, F.col(event).cast("double").alias(event))
    known = packed(known.where(F.col("_first") < blocks), features, event)
    return fit(known, features, event, blocks, **how), known
