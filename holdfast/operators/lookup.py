"""Feature lookups: left joins from a frame of keys to keyed feature tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators.profile import numeric_columns
from holdfast.operators.sketches import by_lane, frequent_sketch, merged_frequent
from holdfast.sources.feature_tables import primary_keys_of

# A key with fewer rows is no trouble for one task, whatever its share.
HOT_ROWS = 1_000_000
# Hot keys that are joined apart, at most; the most frequent ones.
HOT_KEYS = 4_096
# Items that their sketch keeps.
HOT_ITEMS = 16_384
# Bytes of keys or features that may be broadcast.
FEW_BYTES = 64 * 1024 * 1024
# Parts among which rows that need no partner in a join are dealt.
SPREAD = 1_024
# Parts among which rows of hot keys are dealt where their features are too large to be broadcast; those are repeated per part.
SALTS = 32


class LabelLeakage(ValueError):
    """The label is among the features."""


@dataclass(frozen=True)
class FeatureLookup:
    """Which features to fetch from which table by which key.

    ``lookup_key`` names columns of the input frame, in the order of the table's primary keys. Without
    ``feature_names`` every column that is no key is fetched.
    """

    table: str | DataFrame
    lookup_key: str | Sequence[str]
    feature_names: Sequence[str] | None = None

    @property
    def keys(self) -> list[str]:
        return [self.lookup_key] if isinstance(self.lookup_key, str) else list(self.lookup_key)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.table) if isinstance(self.table, str) else self.table

    def table_keys(self, spark: SparkSession) -> list[str]:
        stored = primary_keys_of(spark, self.table) if isinstance(self.table, str) else []
        keys = stored or self.keys
        if len(keys) != len(self.keys):
            raise ValueError(f"the feature table is keyed by {keys}, the lookup by {self.keys}")
        return keys

    def features(self, spark: SparkSession, without: Sequence[str] = ()) -> list[str]:
        """The feature names, resolved; ``without`` is left out unless it is asked for by name."""
        if self.feature_names is not None:
            return list(self.feature_names)
        skip = {name.lower() for name in [*self.table_keys(spark), *without]}
        return [name for name in self.frame(spark).columns if name.lower() not in skip]


def label_guard(spark: SparkSession, lookups: Sequence[FeatureLookup], label: str) -> None:
    """Refuse lookups that fetch the label as a feature."""
    for lookup in lookups:
        if label.lower() in (name.lower() for name in lookup.feature_names or ()):
            raise LabelLeakage(f"{label} is the label and cannot be a looked-up feature")


def _hash_of(columns: Sequence[Column]) -> Column:
    return F.xxhash64(*columns)


def hot_key_hashes(
    df: DataFrame, keys: Sequence[str | Column], min_rows: int = HOT_ROWS, most: int = HOT_KEYS
) -> list[int]:
    """Hashes of the keys that hold at least ``min_rows`` rows, the ``most`` frequent ones of them.

    A frequent-items sketch finds them in one pass over the key columns without a shuffle; NULL counts as a key. It
    decides only which join a row takes, never whether it is kept.
    """
    return [found for found, rows in key_counts(df, keys, most).items() if rows >= min_rows]


def key_counts(df: DataFrame, keys: Sequence[str | Column], most: int = HOT_KEYS) -> dict[int, int]:
    """The hashes of the ``most`` frequent keys and about their rows, from the same sketch."""
    columns = [F.col(key) if isinstance(key, str) else key for key in keys]
    found = by_lane(
        df.select(_hash_of(columns).alias("key_hash")),
        {"sketch": frequent_sketch(F.col("key_hash"), HOT_ITEMS)},
        {"top": merged_frequent(F.col("sketch"), most, HOT_ITEMS)},
    ).first()
    return {item["item"]: item["count"] for item in found["top"] or []}


def lookup_key_columns(df: DataFrame, lookup: FeatureLookup) -> list[Column]:
    """The keys of a frame in the types in which a lookup compares, and hashes, them."""
    features, joined = _renamed(lookup.frame(df.sparkSession), lookup.table_keys(df.sparkSession), [])
    return [F.col(key).cast(kind) for key, kind in zip(lookup.keys, _common_types(df, features, lookup.keys, joined))]


def _measured_bytes(df: DataFrame) -> Column:
    return F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))


def _planned_bytes(df: DataFrame) -> int:
    """What the optimizer thinks the frame weighs; it broadcasts a join side by the same number."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _broadcast_limit(spark: SparkSession) -> int:
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def wanted_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct keys of a frame, to be broadcast if they are measured to be small."""
    wanted = df.select(*[F.col(key).alias(f"__want_{i}") for i, key in enumerate(keys)]).distinct()
    return F.broadcast(wanted) if wanted.agg(_measured_bytes(wanted)).first()[0] <= FEW_BYTES else wanted


def features_of(wanted: DataFrame, features: DataFrame, joined: Sequence[str]) -> DataFrame:
    """The feature rows of the wanted keys only, so that a lookup shuffles no more than these."""
    same = reduce(lambda a, b: a & b, [features[key] == wanted[w] for key, w in zip(joined, wanted.columns)])
    return features.join(wanted, same, "left_semi")


def _renamed(features: DataFrame, table_keys: Sequence[str], names: Sequence[str]) -> tuple[DataFrame, list[str]]:
    joined = [f"__key_{i}" for i in range(len(table_keys))]
    columns = [F.col(key).alias(alias) for key, alias in zip(table_keys, joined)]
    return features.select(*columns, *names), joined


def _common_types(df: DataFrame, features: DataFrame, keys: Sequence[str], joined: Sequence[str]) -> list[T.DataType]:
    """The type in which each pair of keys is compared."""
    pairs = [
        F.coalesce(F.lit(None).cast(df.schema[k].dataType), F.lit(None).cast(features.schema[j].dataType)).alias(j)
        for k, j in zip(keys, joined)
    ]
    return [f.dataType for f in df.sparkSession.range(0).select(*pairs).schema.fields]


def _left_join(df: DataFrame, features: DataFrame, keys: Sequence[str], joined: Sequence[str]) -> DataFrame:
    matches = reduce(lambda a, b: a & b, [df[key] == features[alias] for key, alias in zip(keys, joined)])
    return df.join(features, matches, "left").drop(*joined)


def _dealt(df: DataFrame) -> Column:
    """A number by which rows are dealt over parts; a stream numbers no rows, so there those of a task stay together."""
    return F.spark_partition_id() if df.isStreaming else F.monotonically_increasing_id()


def _split_join(
    df: DataFrame, features: DataFrame, keys: Sequence[str], joined: Sequence[str], names: Sequence[str], hot: int | Sequence[int]
) -> DataFrame:
    """The left join, in which rows of hot keys take their features from a broadcast of just those.

    Features of hot keys that are too large for that are salted instead, see ``_salted_join``. All rows stay in one frame. In the shuffled join a row of a hot key has no key but a part number, which no
    feature row has, so such rows are dealt evenly; the broadcast join that follows knows them by their key. ``hot`` are
    the hashes of these keys, or the rows from which on a key is looked for as one.
    """
    types = _common_types(df, features, keys, joined)
    key_columns = [F.col(k).cast(t) for k, t in zip(keys, types)]
    typed = features.withColumns({j: F.col(j).cast(t) for j, t in zip(joined, types)})
    hashes = hot_key_hashes(df, key_columns, hot) if isinstance(hot, int) else list(hot)
    if not hashes:
        return _left_join(df, features, keys, joined)
    few = typed.where(_hash_of([F.col(j) for j in joined]).isin(hashes))
    if few.agg(_measured_bytes(few)).first()[0] > FEW_BYTES:
        return _salted_join(df, typed, key_columns, joined, names, hashes)
    is_hot = _hash_of(key_columns).isin(hashes)
    cold = {f"__cold_{i}": F.when(~is_hot, c) for i, c in enumerate(key_columns)}
    part = F.when(is_hot, F.pmod(_dealt(df), F.lit(SPREAD)) + 1).otherwise(0)
    routed = df.withColumns({**cold, "__hot": is_hot, "__part": part})
    # Always 0, but not a literal, which the optimizer would make a filter and no longer deal rows by.
    zero = F.pmod(_hash_of([F.col(j) for j in joined]), F.lit(1)).alias("__zero")
    plain = typed.select(*[F.col(j).alias(f"__c{j}") for j in joined], *[F.col(n).alias(f"__c_{n}") for n in names], zero)
    same = [F.col(f"__cold_{i}") == F.col(f"__c{j}") for i, j in enumerate(joined)]
    result = routed.join(plain, reduce(lambda a, b: a & b, [*same, F.col("__part") == F.col("__zero")]), "left")
    hot = few.select(*[F.col(j).alias(f"__h{j}") for j in joined], *[F.col(n).alias(f"__h_{n}") for n in names])
    known = [F.col(k).cast(t) == F.col(f"__h{j}") for k, t, j in zip(keys, types, joined)]
    result = result.join(F.broadcast(hot), reduce(lambda a, b: a & b, [F.col("__hot"), *known]), "left")
    chosen = [F.when(F.col("__hot"), F.col(f"__h_{n}")).otherwise(F.col(f"__c_{n}")).alias(n) for n in names]
    return result.select(*df.columns, *chosen)


def _salted_join(
    df: DataFrame, features: DataFrame, keys: Sequence[Column], joined: Sequence[str], names: Sequence[str], hashes: Sequence[int]
) -> DataFrame:
    """The left join by key and part: rows of hot keys are dealt over the parts, their features are repeated in each.

    All other rows and features are in part 0, so nothing but the features of hot keys grows. Rows of a NULL key, which
    finds no features, are dealt like those of any hot key.
    """
    one, many = F.array(F.lit(0)), F.sequence(F.lit(1), F.lit(SALTS))
    repeated = features.select(
        *[F.col(j).alias(f"__s{j}") for j in joined],
        *[F.col(n).alias(f"__s_{n}") for n in names],
        F.explode(F.when(_hash_of([F.col(j) for j in joined]).isin(list(hashes)), many).otherwise(one)).alias("__of_part"),
    )
    is_hot = _hash_of(keys).isin(list(hashes))
    part = F.when(is_hot, F.pmod(_dealt(df), F.lit(SALTS)) + 1).otherwise(0).cast("int")
    routed = df.withColumns({**{f"__salted_{i}": key for i, key in enumerate(keys)}, "__part": part})
    same = [F.col(f"__salted_{i}") == F.col(f"__s{j}") for i, j in enumerate(joined)]
    result = routed.join(repeated, reduce(lambda a, b: a & b, [*same, F.col("__part") == F.col("__of_part")]), "left")
    return result.select(*df.columns, *[F.col(f"__s_{n}").alias(n) for n in names])


def lookup_features(
    df: DataFrame,
    lookups: Sequence[FeatureLookup],
    without: Sequence[str] = (),
    hot_rows: int | None = HOT_ROWS,
    prefilter: bool = False,
    known_hot: Mapping[tuple[str, ...], Sequence[int]] | None = None,
) -> DataFrame:
    """Add the features of every lookup, keeping every input row; an unknown or NULL key gets NULL features.

    Tables must be unique by their keys, as ``create_feature_table`` checks. The input is scanned once, whatever the
    number of keys. A table that the optimizer broadcasts is simply joined. For a larger one, one pass over the keys
    looks for those with at least ``hot_rows`` rows (NULL included), whose features are measured and broadcast or, if they
    are too large, repeated per part, so their rows are dealt evenly in the shuffled join. ``hot_rows=None`` leaves that out, and a stream cannot
    be searched so: its hot keys, or those of any frame, can be given as ``known_hot``, hashes by lookup key. ``prefilter`` is for few keys and large tables: it reduces each
    table to the wanted keys first.
    """
    spark = df.sparkSession
    taken = {name.lower() for name in df.columns}
    by_key: dict[tuple[str, ...], list[tuple[DataFrame, list[str], list[str]]]] = {}
    for lookup in lookups:
        names = lookup.features(spark, without)
        clash = taken.intersection(name.lower() for name in names)
        if clash:
            raise ValueError(f"looked-up features already in the frame: {sorted(clash)}")
        taken.update(name.lower() for name in names)
        renamed, joined = _renamed(lookup.frame(spark), lookup.table_keys(spark), names)
        by_key.setdefault(tuple(lookup.keys), []).append((renamed, joined, names))
    result, limit = df, _broadcast_limit(spark)
    for keys, tables in by_key.items():
        if prefilter:
            wanted = wanted_keys(df, keys)
            tables = [(features_of(wanted, features, joined), joined, names) for features, joined, names in tables]
        for features, joined, names in tables:
            hot = known_hot.get(keys, ()) if known_hot is not None else None if df.isStreaming else hot_rows
            if hot is None or 0 <= _planned_bytes(features) <= limit:
                result = _left_join(result, features, keys, joined)
            else:
                result = _split_join(result, features, keys, joined, names, hot)
    return result


@dataclass(frozen=True)
class TrainingSet:
    """A labelled frame with looked-up features, and what is needed to look them up again."""

    frame: DataFrame
    lookups: tuple[FeatureLookup, ...]
    label: str

    def load_df(self) -> DataFrame:
        return self.frame


def create_training_set(
    df: DataFrame,
    lookups: Sequence[FeatureLookup],
    label: str,
    exclude_columns: str | Sequence[str] = (),
    hot_rows: int | None = HOT_ROWS,
) -> TrainingSet:
    """Label frame plus features minus excluded columns, the label last.

    A lookup without feature names leaves the label out; a lookup that names it is refused.
    """
    if label not in df.columns:
        raise ValueError(f"the label {label} is not a column of the frame")
    label_guard(df.sparkSession, lookups, label)
    excluded = [exclude_columns] if isinstance(exclude_columns, str) else list(exclude_columns)
    if label in excluded:
        raise ValueError("the label cannot be excluded")
    joined = lookup_features(df, lookups, without=[label], hot_rows=hot_rows)
    kept = [name for name in joined.columns if name not in excluded and name != label]
    return TrainingSet(joined.select(*kept, label), tuple(lookups), label)


def leakage_scan(
    df: DataFrame, label: str, positive: str, columns: Sequence[str] | None = None, threshold: float = 0.95
) -> DataFrame:
    """Correlation of each numeric or boolean feature with the label; a near-perfect one hints at a leaked label.

    A constant feature has no correlation: NULL.
    """
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    names = list(columns or [n for n in df.columns if n in {*numeric_columns(df), *flags} and n != label])
    target = (F.col(label) == F.lit(positive)).cast("double")
    measures = []
    for name in names:
        value = F.col(name).cast("double")
        both = value.isNotNull() & target.isNotNull()
        x, y = F.when(both, value), F.when(both, target)
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        measures.append(
            F.struct(
                F.lit(name).alias("feature"),
                F.count_if(both).alias("rows"),
                F.try_divide(F.covar_pop(x, y), spread).alias("correlation"),
            ).alias(name)
        )
    wide = df.agg(*measures)
    return wide.select(F.inline(F.array(*[F.col(f"`{n}`") for n in names]))).withColumn(
        "suspicious", F.coalesce(F.abs("correlation") >= threshold, F.lit(False))
    )
