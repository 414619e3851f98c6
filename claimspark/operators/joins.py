"""Join helpers shared by the operators: order-preserving semi-join, a runtime
filter below its shuffle, and a skew-safe (salted) equi-join."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.plans.inspect import estimated_bytes
from claimspark.plans.session import byte_setting, save

# A key with at least this many rows on the big side is worth splitting; ~4M
# rows of a narrow fact row is a few hundred MB of shuffle data.
DEFAULT_ROWS_PER_SPLIT = 1 << 22

_SALT = "__salt"
_SALTS = "__salts"


def semi_join(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose ``on`` values occur in ``keys`` (null never matches).

    A left semi-join never repeats a row, however often its key occurs on the
    right.  The planner broadcasts ``keys`` only when its measured size is
    under the broadcast threshold, otherwise both sides are shuffled on ``on``
    (and a skewed key partition can be split).  The column order of ``df`` is
    kept (a join on column names would move the keys first).
    """
    return df.join(keys.select(*on), list(on), "left_semi").select(*df.columns)


# A runtime filter is one array of longs: 2 MB of bits at most, at 16 bits a key.
FILTER_WORDS = 1 << 18
BITS_PER_KEY = 16

KeyFilter = Callable[[DataFrame], DataFrame]


def _bit_places(key: Column, words: int) -> list[Column]:
    """Two places of a key among ``64 * words`` bits, from the two halves of its hash."""
    h = F.xxhash64(key)
    return [F.pmod(x, F.lit(64 * words)) for x in (h, F.shiftright(h, 32))]


def key_filter(keys: DataFrame, on: str, max_words: int = FILTER_WORDS, from_bytes: int | None = None) -> KeyFilter:
    """A function that drops most rows of a table whose ``on`` is not in the written table ``keys``.

    The keys' Bloom filter is aggregated by Spark, one long for each 64 bits,
    and written as one row.  The returned function reads it as a scalar
    subquery, so its test is a plain codegen filter right above the scan, below
    the exchange of a later semi-join: rows of other keys are not shuffled.
    Some of them pass, so an exact semi-join has to follow.

    Where ``keys`` is small enough to be broadcast (up to ``from_bytes``, by default
    the session's broadcast limit) there is no shuffle to spare, and where it has more keys than ``max_words`` can tell apart most
    rows would pass; then nothing is dropped.  Results are the same either way.
    """
    spark = keys.sparkSession
    limit = byte_setting(spark, "spark.sql.autoBroadcastJoinThreshold") if from_bytes is None else from_bytes
    if estimated_bytes(keys) <= limit:
        return lambda df: df
    n = keys.count()
    words = 1 << max(4, (n * BITS_PER_KEY // 64).bit_length())
    if words > max_words:
        return lambda df: df
    kind = keys.schema[on].dataType
    places = keys.select(F.explode(F.array(*_bit_places(F.col(on), words))).alias("place"))
    bits = places.select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bits"))
    bits = spark.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")).unionByName(bits)
    bits = bits.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    row = bits.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))
    row = save(row, "key-filter")  # ``words`` longs

    def keep(df: DataFrame) -> DataFrame:
        held = row.scalar()

        def found(place: Column) -> Column:
            word = F.get(held, F.shiftright(place, 6).cast("int"))
            return F.getbit(word, place.bitwiseAND(63).cast("int")) == 1
        a, b = _bit_places(F.col(on).cast(kind), words)
        return df.filter(found(a) & found(b))
    return keep


def hot_keys(df: DataFrame, on: Sequence[str], rows_per_split: int = DEFAULT_ROWS_PER_SPLIT) -> DataFrame:
    """Every key of ``df`` holding at least ``rows_per_split`` rows, with the
    number of pieces to split it into (``ceil(rows / rows_per_split)``).

    The count runs with a partial aggregate per task, so the hot keys
    themselves cost one row per task in its shuffle.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__rows"))
    hot = counts.filter(F.col("__rows") >= F.lit(rows_per_split))
    return hot.select(*on, F.ceil(F.col("__rows") / F.lit(rows_per_split)).cast("int").alias(_SALTS))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    hot: DataFrame,
    how: str = "inner",
) -> DataFrame:
    """Equi-join of ``big`` and ``small`` on ``on`` that splits known hot keys.

    For callers who know their hot keys (``hot_keys`` finds them, at the price
    of a pass over the big side); a join of two shuffled tables needs no
    salting, since adaptive execution splits it as it runs.

    Rows of a hot key on the big side are spread over its pieces by a hash of
    ``salt_by`` (deterministic, so a retried task sends every row to the same
    piece); the small side's rows of that key are replicated once per piece;
    all other keys get piece 0 and join as usual.  Each big row meets its
    key's small rows exactly once, so the result equals the plain join.
    Whether ``hot`` is broadcast is left to the planner, which checks its size.
    ``how`` is ``inner`` or ``left_semi`` (the big side's columns, in order).
    """
    if how not in ("inner", "left_semi"):
        raise ValueError(f"how must be 'inner' or 'left_semi', not {how!r}")
    keys = list(on)
    hk = hot.select(*keys, _SALTS)
    salted_big = big.join(hk, keys, "left").withColumn(
        _SALT,
        F.when(F.col(_SALTS).isNull(), F.lit(0))
         .otherwise(F.pmod(F.xxhash64(*salt_by), F.col(_SALTS)).cast("int")),
    ).drop(_SALTS)
    replicated_small = small.join(hk, keys, "left").withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_SALTS), F.lit(1)) - 1)),
    ).drop(_SALTS)
    if how == "left_semi":
        return (salted_big.join(replicated_small.select(*keys, _SALT), [*keys, _SALT], "left_semi")
                .select(*big.columns))
    return salted_big.join(replicated_small, [*keys, _SALT], "inner").drop(_SALT)
