"""Pairs of rows that share a bucket, with no bucket held by one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import BLOCK, pairs_within
from ..session import cut


#: More elements than a set has.
ANY = 1 << 30


def may_share(m_a: np.ndarray, s_a: np.ndarray, m_b: np.ndarray, s_b: np.ndarray, share: float, differ: int = ANY) -> np.ndarray:
    """Whether sets with these maps of 64 bits (or rows of several) and sizes can have `share` of the larger in common, and `differ` elements apart at most."""
    common = np.maximum(s_a, s_b) * share - 1e-6
    own_a, own_b = (np.bitwise_count((x & ~y).view(np.uint64)).reshape(len(x), -1).sum(1, dtype=np.int64) if len(x) else np.zeros(0) for x, y in ((m_a, m_b), (m_b, m_a)))
    return (own_a <= np.minimum(s_a - common, differ)) & (own_b <= np.minimum(s_b - common, differ))


def bucket_pairs(rows: DataFrame, key: str, id_col: str, block: int = BLOCK, bits: str | Sequence[str] = (), size: str | None = None, share: float = 0.0, differ: int = ANY) -> DataFrame:
    """Distinct (a, b), a < b, of ids that share a bucket (equal key). rows: each (key, id) once, both numbers.

    The rows are shuffled once, by bucket. A bucket of at most `block` rows is paired where it
    arrives; of a larger one a task keeps nothing but passes the rows on, and they are then cut into
    blocks by the hash of the id: each row goes once to every pair of blocks that its own block is
    in, and the pairs of blocks are joined as separate keys. So every pair is met, by many tasks.

    bits, size: a map of 64 bits with one bit for each element of the row's set (or several, which share
    the elements among them), and the set's size.
    Pairs whose maps alone show that less than `share` of the larger set is common, or that more than
    `differ` elements of one are not in the other, are not given; no other pair is lost.
    """
    bits = [bits] if isinstance(bits, str) else list(bits)
    maps = [f"m{i}" for i in range(len(bits))]
    carried = [*[F.col(c).cast("bigint").alias(m) for c, m in zip(bits, maps)], F.col(size).cast("int").alias("s")] if bits else []
    spread = rows.select(F.col(key).cast("bigint").alias("k"), F.col(id_col).cast("bigint").alias("i"), *carried).repartition("k").sortWithinPartitions("k")

    def paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, passing = None, None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(held):
                continue
            # the last bucket may go on in the next batch
            keys = held.k.to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))
            yield from _runs(held.iloc[:last], block, passing, share, differ)
            held = held.iloc[last:]
            if len(held) > block or held.k.iloc[0] == passing:
                passing = held.k.iloc[0]
                yield _large(held)
                held = held.iloc[:0]
        if held is not None:
            yield from _runs(held, block, passing, share, differ)

    met = cut(spread.mapInPandas(paired, ", ".join(["a bigint, b bigint", *[f"{m} bigint" for m in maps], "s int, large boolean"])))
    pairs = met.filter("NOT large").select("a", "b").distinct()
    large = met.filter("large").select(F.col("a").alias("k"), F.col("b").alias("i"), *maps, "s")
    if large.isEmpty():
        return pairs
    alike = None
    if bits:
        most = F.greatest("a.s", "b.s") * F.lit(share) - 1e-6
        apart = lambda x, y: sum((F.bit_count(F.col(f"{x}.{m}").bitwiseAND(F.bitwise_not(F.col(f"{y}.{m}")))) for m in maps), F.lit(0))
        own = lambda x, y: apart(x, y) <= F.least(F.col(f"{x}.s") - most, F.lit(float(differ)))
        alike = own("a", "b") & own("b", "a")
    return pairs.unionByName(pairs_within(large, block, alike).select("a", "b")).distinct()


def _maps(rows: pd.DataFrame) -> list[str]:
    return [c for c in rows.columns if c[0] == "m"]


def _large(rows: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({"a": rows.k.to_numpy(), "b": rows.i.to_numpy(), "s": np.int32(0), "large": True})
    return out.assign(**{c: rows[c].to_numpy() for c in (*_maps(rows), "s")}) if "s" in rows else out


def _runs(rows: pd.DataFrame, block: int, passing: int | None, share: float, differ: int) -> Iterator[pd.DataFrame]:
    """The pairs of whole buckets; buckets above `block`, and the one that is passing, as they are."""
    if not len(rows):
        return
    keys, ids = rows.k.to_numpy(), rows.i.to_numpy()
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    as_is = sizes > block
    if passing is not None:
        as_is |= keys[starts] == passing
    if as_is.any():
        yield _large(rows[np.repeat(as_is, sizes)])
    maps = _maps(rows)
    m, s = (np.ascontiguousarray(rows[maps].to_numpy()), rows.s.to_numpy()) if maps else (None, None)
    for n in np.unique(sizes[(sizes > 1) & ~as_is]):
        at = starts[(sizes == n) & ~as_is]
        x, y = np.triu_indices(n, 1)
        step = max(1, 1_000_000 // len(x))
        for i in range(0, len(at), step):
            part = at[i : i + step, None]
            p, q = (part + x).ravel(), (part + y).ravel()
            if m is not None:
                ok = may_share(m[p], s[p], m[q], s[q], share, differ)
                p, q = p[ok], q[ok]
            if len(p):
                yield pd.DataFrame({"a": np.minimum(ids[p], ids[q]), "b": np.maximum(ids[p], ids[q])}).drop_duplicates().assign(**{c: np.int64(0) for c in maps}, s=np.int32(0), large=False)
