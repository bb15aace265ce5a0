"""Reproducible exact-size samples, splits and folds.

Rows are ordered by a hash of their key and a seed.  A sample of n rows is
"every row up to the n-th hash", so once that one hash is known the sample is a
plain filter: nothing is sorted and nothing is exchanged.  The n-th hash is
found by counting hash prefixes, a few thousand counters at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.fixed_values import CV_FOLDS, RANDOM_SEED, SAMPLE_ROWS, TEST_FRACTION
from panelweave.operators.columns import quoted

_PREFIX_STEP = 3
_FETCH_ROWS = 10_000
_HASH_DIGITS = 32


def row_token(keys: list[str], seed: int = RANDOM_SEED) -> Column:
    """32 hexadecimal digits that order rows at random but reproducibly.

    Different keys, NULLs and separators in them included, are different texts.
    """

    def written(key: str) -> Column:
        text = F.replace(F.col(quoted(key)).cast("string"), F.lit("\\"), F.lit("\\\\"))
        return F.coalesce(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\\N"))

    return F.md5(F.concat_ws("|", *[written(k) for k in keys], F.lit(str(seed))))


def hash_cuts(
    df: DataFrame, token: Column, ranks: Callable[[int], list[int]]
) -> tuple[int, dict[int, str]]:
    """(number of rows, token found at each 1-based rank of the token order).

    ``ranks`` maps the number of rows to the ranks wanted.  The driver sees
    at most 4096 counters per open prefix, never rows in proportion to the data.
    """
    tokens = df.select(token.alias("t"))

    def count_prefixes(inside: DataFrame, width: int) -> list:
        return sorted(inside.groupBy(F.substring("t", 1, width).alias("p")).count().collect())

    width = _PREFIX_STEP
    counted = count_prefixes(tokens, width)
    rows = sum(n for _, n in counted)
    cuts: dict[int, str] = {}
    open_ranks = {r: ("", r) for r in set(ranks(rows)) if r > 0}
    while open_ranks:
        still_open, ready = {}, {}
        for rank, (prefix, left) in open_ranks.items():
            for p, n in counted:
                if not p.startswith(prefix):
                    continue
                if left > n:
                    left -= n
                    continue
                if width == _HASH_DIGITS:
                    cuts[rank] = p
                elif n <= _FETCH_ROWS:
                    ready[rank] = (p, left)
                else:
                    still_open[rank] = (p, left)
                break
            else:
                raise ValueError(f"rank {rank} is beyond the number of rows")
        if ready:
            found = _nth_tokens(tokens, width, set(ready.values()))
            cuts.update({rank: found[place] for rank, place in ready.items()})
        open_ranks = still_open
        if open_ranks:
            prefixes = sorted({p for p, _ in open_ranks.values()})
            inside = tokens.filter(F.substring("t", 1, width).isin(prefixes))
            width = min(width + _PREFIX_STEP, _HASH_DIGITS)
            counted = count_prefixes(inside, width)
    return rows, cuts


def _nth_tokens(tokens: DataFrame, width: int, places: set[tuple[str, int]]) -> dict:
    """The n-th token within each (prefix, n), from one pass.

    A prefix is asked for once it holds few rows, so the windows are small.
    """
    prefix = F.substring("t", 1, width)
    within = F.row_number().over(Window.partitionBy("p").orderBy("t"))
    numbered = (
        tokens.filter(prefix.isin(*sorted({p for p, _ in places})))
        .select(prefix.alias("p"), "t")
        .withColumn("n", within)
        .filter(F.col("n").isin(*sorted({n for _, n in places})))
    )
    return {(r["p"], r["n"]): r["t"] for r in numbered.collect()}


def sample_capped(
    df: DataFrame, keys: list[str], n: int = SAMPLE_ROWS, seed: int = RANDOM_SEED
) -> DataFrame:
    """At most ``n`` rows without replacement; ``keys`` must identify a row."""
    token = row_token(keys, seed)
    rows, cuts = hash_cuts(df, token, lambda rows: [n] if rows > n else [])
    return df if rows <= n else df.filter(token <= F.lit(cuts[n]))


def split_train_test(
    df: DataFrame, keys: list[str], test: float = TEST_FRACTION, seed: int = RANDOM_SEED
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly ceil(test x rows) test rows."""
    token = row_token(keys, seed)
    _, cuts = hash_cuts(df, token, lambda rows: [ceil(round(rows * test, 6))])
    cut = F.lit(next(iter(cuts.values()), ""))
    return df.filter(token > cut), df.filter(token <= cut)


def kfold(
    df: DataFrame, keys: list[str], k: int = CV_FOLDS, seed: int = RANDOM_SEED, out: str = "fold"
) -> DataFrame:
    """Shuffled fold number; fold sizes differ by at most one row."""

    def fold_ends(rows: int) -> list[int]:
        if rows < k:
            raise ValueError(f"{rows} rows cannot fill {k} folds")
        sizes = [rows // k + (1 if fold < rows % k else 0) for fold in range(k)]
        return list(accumulate(sizes))[:-1]

    token = row_token(keys, seed)
    _, cuts = hash_cuts(df, token, fold_ends)
    fold = F.lit(0)
    for cut in cuts.values():
        fold = fold + (token > F.lit(cut)).cast("int")
    return df.withColumn(out, fold)
