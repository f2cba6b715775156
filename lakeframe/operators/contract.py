"""Admission of frames: coercion, all violations at once, audits, encoding."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import unpivot
from ..functions.ranks import bucket_of, exact_quantiles
from ..functions.storage import stored
from ..spec import SETTINGS, Feature, Problem, Settings, compare_schema

#: Types whose least and greatest value Spark does not keep in a hash table.
_LONG = ("string", "varchar", "char", "binary", "array", "struct")
_CAST = {"numeric": "double", "categorical": "string", "boolean": "boolean", "datetime": "timestamp"}


def coerce(df: DataFrame, problem: Problem, target: bool = True) -> DataFrame:
    """Every declared column in its declared type; what cannot be read becomes null. Undeclared columns stay."""
    declared = {f.name: f for f in [*problem.features, *([problem.target] if target else [])]}
    return df.select(*[F.expr(f"try_cast(`{c}` AS {_CAST[declared[c].kind]})").alias(c) if c in declared else F.col(f"`{c}`") for c in df.columns])


def _checks(f: Feature, is_target: bool) -> list[tuple[str, Column]]:
    cast = F.expr(f"try_cast(`{f.name}` AS {_CAST[f.kind]})")
    found = [("dtype", F.col(f.name).isNotNull() & cast.isNull())]
    if f.levels:
        found.append(("level", ~cast.isin(*f.levels)))
    if f.minimum is not None:
        found.append(("minimum", cast < f.minimum))
    if f.maximum is not None:
        found.append(("maximum", cast > f.maximum))
    if is_target or not f.nullable:
        found.append(("null", F.col(f.name).isNull()))
    return found


def violations(df: DataFrame, problem: Problem, key: str) -> DataFrame:
    """(column, check, row, value) of everything that breaks the contract; one pass, no shuffle."""
    found = []
    for f in [*problem.features, problem.target]:
        for check, broken in _checks(f, f is problem.target):
            found.append(F.when(broken, F.struct(F.lit(f.name).alias("column"), F.lit(check).alias("check"), F.col(f.name).cast("string").alias("value"))))
    return df.select(F.col(key).alias("row"), F.explode(F.array_compact(F.array(*found))).alias("v")).select("v.column", "v.check", "row", "v.value")


def violation_summary(found: DataFrame, examples: int = 20) -> DataFrame:
    """How often each check fails, with the first rows by name."""
    order = Window.partitionBy("column", "check").orderBy("row")
    counts = found.groupBy("column", "check").agg(F.count("*").alias("n"))
    first = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= examples).groupBy("column", "check").agg(F.array_join(F.sort_array(F.collect_list("row")), ",").alias("examples"))
    return counts.join(first, ["column", "check"]).withColumn("n_more", F.greatest(F.col("n") - examples, F.lit(0)))


def column_audit(df: DataFrame, problem: Problem, settings: Settings = SETTINGS, approximate: bool = False) -> DataFrame:
    """Nulls and distinct values of every declared column, and what is wrong with them; one aggregation."""
    declared = [*problem.features, problem.target]
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    aggregates = [F.count("*").alias("n_rows")]
    for f in declared:
        aggregates += [F.sum(F.col(f.name).isNull().cast("long")).alias(f"{f.name}__null"), distinct(f.name).alias(f"{f.name}__distinct")]
    return _issues(df.agg(*aggregates), declared, settings)


def _issues(one: DataFrame, declared: Sequence[Feature], settings: Settings, keep: Sequence[str] = ()) -> DataFrame:
    """A row for each declared column, from one row with n_rows, keep, <column>__null and <column>__distinct."""
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.kind).alias("kind"), F.lit(len(f.levels)).alias("n_levels"), F.lit(f.nullable).alias("nullable"), F.col(f"{f.name}__null").alias("n_null"), F.col(f"{f.name}__distinct").alias("n_unique")) for f in declared])
    long = one.select("n_rows", *keep, F.explode(rows).alias("c")).select("n_rows", *keep, "c.*")
    long = long.withColumn("null_share", F.round(F.try_divide("n_null", "n_rows"), 6)).withColumn("cardinality_share", F.round(F.try_divide("n_unique", "n_rows"), 6))
    issues = F.array_compact(F.array(
        F.when(F.col("n_unique") <= 1, "constant"), F.when(F.col("null_share") >= settings.high_null_share, "mostly null"),
        F.when((F.col("kind") == "categorical") & (F.col("cardinality_share") >= settings.high_cardinality_share), "id-like"),
        F.when((F.col("n_levels") > 0) & (F.col("n_unique") > F.col("n_levels")), "more values than levels"), F.when(F.col("kind") == "datetime", "datetime"),
        F.when((F.col("n_null") > 0) & ~F.col("nullable"), "null in non-nullable"),
    ))
    return long.select("column", "n_rows", "n_null", "null_share", "n_unique", "cardinality_share", F.array_join(issues, "; ").alias("issues"), *keep)


def _broken_and_audited(df: DataFrame, problem: Problem, settings: Settings) -> DataFrame:
    """One row: n_violations, as many as violations() has rows, and _audit, the issues of column_audit(), from one pass.

    Levels alone need their distinct values counted, from rows grouped by all of them; of other columns an issue asks no
    more than whether two values differ.
    """
    declared, kinds = [*problem.features, problem.target], dict(df.dtypes)
    levels = [f.name for f in declared if f.kind == "categorical" or kinds[f.name].startswith(_LONG)]
    ends = [f.name for f in declared if f.name not in levels]
    broken = sum((F.count_if(check) for f in declared for _, check in _checks(f, f is problem.target)), F.lit(0).cast("long"))
    counts = [F.count("*").alias("n_rows"), broken.alias("n_violations"), *[F.count_if(F.col(f.name).isNull()).alias(f"{f.name}__null") for f in declared]]
    grouped = df.groupBy(*levels).agg(*counts, *[f(c).alias(f"{c}__{name}") for c in ends for name, f in (("low", F.min), ("high", F.max))])
    low, high = ({c: f(f"{c}__{name}") for c in ends} for name, f in (("low", F.min), ("high", F.max)))
    different = [F.when(low[c].isNull(), 0).when(low[c] == high[c], 1).otherwise(2).cast("long").alias(f"{c}__distinct") for c in ends]
    summed = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_rows", "n_violations", *[f"{f.name}__null" for f in declared])]
    one = grouped.agg(*summed, *different, *[F.count_distinct(c).alias(f"{c}__distinct") for c in levels])
    texts = F.array_sort(F.collect_list(F.when(F.col("issues") != "", F.concat_ws(": ", "column", "issues"))))  # a text for each column
    return _issues(one, declared, settings, ["n_violations"]).agg(F.max("n_violations").alias("n_violations"), texts.alias("_audit"))


def one_hot(df: DataFrame, problem: Problem, keep: list[str]) -> DataFrame:
    """keep, then a 0/1 column for each declared level, numbers as they are, booleans and times as numbers.

    Unknown levels give zeros; undeclared columns go; a missing declared column is an error.
    """
    missing = [f.name for f in problem.features if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    made = []
    for f in problem.features:
        if f.kind == "categorical":
            made += [F.coalesce(F.when(F.col(f.name) == level, 1.0), F.lit(0.0)).alias(level_column(f.name, level)) for level in sorted(f.levels)]
        else:
            made.append(F.col(f.name).cast("double").alias(f.name))
    return df.select(*keep, *made)


def level_column(name: str, level: str) -> str:
    return f"{name}_{''.join(c if c.isalnum() else '_' for c in level)}"


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns; those that df lacks are 0."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns])


def impute(df: DataFrame, training: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Missing values from the training frame's medians and modes; which ones, in imputed_features."""
    medians = exact_quantiles(training, numeric, [0.5]) if numeric else {}
    fill = {c: F.lit(medians[c][0] if medians[c] else None).cast("double") for c in numeric} | modes(training, categorical)
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in [*numeric, *categorical]]))
    return df.select(*[F.coalesce(F.col(c), fill[c]).alias(c) if c in fill else F.col(c) for c in df.columns], names.alias("imputed_features"))


def modes(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Each column's commonest level, the first by name of equals; null for a column without levels."""
    if not columns:
        return {}
    counted = unpivot(df, [], columns, "column", "level").where("level is not null").groupBy("column", "level").agg(F.count("*").alias("n"))
    best = counted.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "level"))["level"].alias("level"))
    found = {r["column"]: r["level"] for r in best.collect()}  # a row for each column
    return {c: F.lit(found.get(c)).cast("string") for c in columns}


def unknown_keys(declared: list[str], features: str) -> Column:
    return F.array_except(F.map_keys(features), F.array(*map(F.lit, declared)))


def duplicate_shares(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Share of rows where a feature's trimmed, case-folded text is the target's; one aggregation."""
    text = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    real = [c for c, t in df.dtypes if t == "double"]
    same = {c: text(c) == text(target) for c in features}
    if target in real:  # numbers of equal text are equal, so few are written out
        same |= {c: F.when(F.col(c) == F.col(target), same[c]) for c in features if c in real}
    return unpivot_row(df.agg(*[F.avg(F.coalesce(same[c].cast("double"), F.lit(0.0))).alias(c) for c in features]), features, "share")


def correlations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Absolute Pearson correlation over complete pairs; null for fewer than two distinct values."""
    made = []
    for c in features:
        x, y = F.when(F.col(target).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(target))
        made.append(F.abs(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias(c))
    return unpivot_row(df.agg(*made), features, "correlation")


def unpivot_row(one: DataFrame, columns: list[str], value: str) -> DataFrame:
    return unpivot(one, [], columns, "feature", value, "double")


def _binned(df: DataFrame, features: list[str], bins: int, kept: dict[str, Column]) -> DataFrame:
    """kept, number (nth) of the feature and cell (bin of a number, level) of each row and feature: numbers between exact quantiles, levels as they are."""
    kinds = dict(df.dtypes)
    numeric = [c for c in features if kinds[c] in ("double", "float", "int", "bigint")]
    edges = exact_quantiles(df, numeric, [i / bins for i in range(1, bins)]) if numeric else {}
    rows = df.select(*[c.alias(f"_k_{name}") for name, c in kept.items()], *[(F.col(c).cast("double") + 0.0 if c in numeric else F.col(c).cast("string")).alias(f"_f{i}") for i, c in enumerate(features)])
    binned = []
    for i, c in enumerate(features):
        of = F.col(f"_f{i}")
        if c in numeric:
            cuts = sorted(set(edges[c] or []))
            if cuts and all(map(math.isfinite, cuts)):  # found by halving in a loop: as an expression, 63 cuts are too long to be compiled
                rows = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=f"_f{i}", outputCol=f"_b{i}", handleInvalid="keep").transform(rows)
                of = F.when(of.isNotNull(), F.least(F.col(f"_b{i}").cast("int"), F.lit(len(cuts))))  # keep: what is NaN or null has a bucket beyond
            else:
                of = F.when(of.isNotNull(), bucket_of(of, cuts))
            cell = of.cast("int").alias("bin"), F.lit(None).cast("string").alias("level")  # as numbers, which are hashed faster than their texts
        else:
            cell = F.lit(None).cast("int").alias("bin"), F.coalesce(of, F.lit("(missing)")).alias("level")
        binned.append(F.struct(F.lit(i).alias("nth"), *cell))
    return rows.select(*[F.col(f"_k_{name}").alias(name) for name in kept], F.explode(F.array(*binned)).alias("b")).select(*kept, "b.*")


_CELL = ["nth", "bin", "level"]


def _name(features: list[str]) -> Column:
    """The name of the feature nth."""
    return F.element_at(F.array(*map(F.lit, features)), F.col("nth") + 1).alias("feature")


def enough_for_leakage(df: DataFrame, target: str, settings: Settings = SETTINGS) -> None:
    if df.where(F.col(target).isNotNull()).limit(settings.leakage_min_rows).count() < settings.leakage_min_rows:
        raise ValueError(f"leakage needs {settings.leakage_min_rows} labelled rows: on fewer, a feature scores 1 by chance")


def single_feature_accuracy(df: DataFrame, features: list[str], target: str, fold: Column, bins: int = 64, allow: tuple[str, ...] = (), settings: Settings = SETTINGS) -> DataFrame:
    """(feature, accuracy, majority, leaks): each feature's commonest class by bin, as trained, on the held-out rows.

    A feature leaks if it reaches the threshold and beats the held-out share of the commonest class; those allowed are
    not judged. Of equally common classes the last by name is meant.
    """
    enough_for_leakage(df, target, settings)
    features = [f for f in features if f not in allow]
    rows = _binned(df, features, bins, {"t": F.col(target).cast("string"), "train": fold}).where("t is not null")
    cells = rows.groupBy(*_CELL, "t").agg(F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_test"))
    best = F.max(F.struct("n_train", "t"))["t"]
    whole = cells.groupBy("nth", "t").agg(F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test")).groupBy("nth").agg(best.alias("common"), (F.max("n_test") / F.sum("n_test")).alias("majority"))
    by = cells.withColumn("cell", F.struct(*_CELL)).drop("bin", "level")  # which is never null
    fits = by.groupBy("nth", "cell").agg(F.when(F.max("n_train") > 0, best).alias("fit"))
    joined = by.join(fits, ["nth", "cell"]).join(F.broadcast(whole), "nth")  # a row for each feature
    right = F.sum(F.when(F.col("t") == F.coalesce("fit", "common"), F.col("n_test")).otherwise(0))
    made = joined.groupBy("nth").agg((right / F.sum("n_test")).alias("accuracy"), F.first("majority").alias("majority"))
    return made.select(_name(features), "accuracy", "majority", ((F.col("accuracy") >= settings.leakage_threshold) & (F.col("accuracy") > F.col("majority"))).alias("leaks"))


def single_feature_scores(df: DataFrame, features: list[str], target: str, fold: Column, bins: int = 64) -> DataFrame:
    """Held-out r2 of each feature's binned means, for all features at once; fold says which rows train.

    Numbers fall into quantile bins, levels are their own; a bin that training has not seen predicts the mean.
    """
    rows = _binned(df, features, bins, {"t": F.col(target).cast("double"), "train": fold}).where("t is not null")
    # all that r2 needs of the test rows of a bin are their count, sum and sum of squares
    sides = rows.groupBy(*_CELL, "train").agg(F.count("*").alias("n"), F.sum("t").alias("s"), F.sum(F.col("t") * F.col("t")).alias("ss"))
    of = lambda c, train: F.sum(F.when(F.col("train") if train else ~F.col("train"), F.col(c)))
    cells = sides.groupBy(*_CELL).agg(of("s", True).alias("train_s"), of("n", True).alias("train_n"), F.coalesce(of("n", False), F.lit(0)).alias("n"), of("s", False).alias("s"), of("ss", False).alias("ss"))
    within = Window.partitionBy("nth")  # as many rows as a feature has bins or levels
    mean = F.try_divide(F.sum("train_s").over(within), F.sum("train_n").over(within))
    cells = cells.withColumn("fit", F.coalesce(F.try_divide("train_s", "train_n"), mean)).where("n > 0")
    scores = cells.groupBy("nth").agg(
        (1 - F.try_divide(F.sum(F.col("ss") - 2 * F.col("fit") * F.col("s") + F.col("n") * F.col("fit") * F.col("fit")), F.sum("ss") - F.sum("s") * F.sum("s") / F.sum("n"))).alias("r2"), F.sum("n").alias("n_test")
    )
    return scores.select(_name(features), "r2", "n_test")


def leakage_signals(df: DataFrame, problem: Problem, fold: Column, allow: tuple[str, ...] = (), bins: int = 64, settings: Settings = SETTINGS) -> DataFrame:
    """(feature, kind, score, baseline, leaks) of every declared feature that df has, over its labelled rows.

    duplicate: the share of rows where its text is the target's; correlation: of numbers with a numeric target;
    single_feature: r2 or accuracy on held-out rows from its bins alone, which must also beat the baseline (the share of
    the commonest class). The labelled rows are written once; each probe measures all features in one pass over them.
    Those allowed are not judged. A score that cannot be computed is null and no leak.
    """
    target = problem.target.name
    features = [f.name for f in problem.features if f.name in df.columns and f.name not in allow]
    numeric = [f.name for f in problem.of_kind("numeric", "boolean", "datetime") if f.name in features]
    rows = df.where(F.col(target).isNotNull()).select(*features, target, fold.alias("_train"))
    rows = stored(rows.select(*[F.col(c).cast("double").alias(c) if c in numeric else F.col(c) for c in features], target, "_train"))
    enough_for_leakage(rows, target, settings)
    kinds = [("duplicate", duplicate_shares(rows, features, target).withColumnRenamed("share", "score"), F.lit(0.0))]
    if problem.task == "regression":
        if numeric:
            kinds.append(("correlation", correlations(rows, numeric, target).withColumnRenamed("correlation", "score"), F.lit(0.0)))
        kinds.append(("single_feature", single_feature_scores(rows, features, target, F.col("_train"), bins).withColumnRenamed("r2", "score"), F.lit(0.0)))
    else:
        found = single_feature_accuracy(rows, features, target, F.col("_train"), bins, settings=settings).withColumnRenamed("accuracy", "score")
        kinds.append(("single_feature", found, F.col("majority")))
    leaks = F.coalesce((F.col("score") >= settings.leakage_threshold) & (F.col("score") > F.col("baseline")), F.lit(False))
    made = None
    for kind, found, baseline in kinds:
        part = found.select("feature", F.lit(kind).alias("kind"), "score", baseline.alias("baseline")).withColumn("leaks", leaks)
        made = part if made is None else made.unionByName(part)
    return made


def contract_verdict(df: DataFrame, problem: Problem, key: str, leaks: DataFrame | None, probe: DataFrame | None, strict: bool = False, settings: Settings = SETTINGS) -> DataFrame:
    """One row: the schema, violations, what leaks, learnability, then issues, warnings, ok and the first failure.

    leaks are leakage_signals (None: too few labelled rows, which is a warning), probe is a row of learnability (None:
    not measured, which is an issue). Columns come before values, values before leaks, leaks before learnability: what
    comes first explains what follows. Findings of single columns and a target that is too easy are warnings. leaking
    names feature and probe; strongest is the highest score. strict refuses undeclared columns as well and raises the
    first failure.
    """
    missing, undeclared = compare_schema(problem, df.columns, strict=True)
    present = replace(problem, features=tuple(f for f in problem.features if f.name not in missing))
    if leaks is None:
        found = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_leaks"), F.lit("").alias("leaking"), F.lit(None).cast("string").alias("strongest"))
    else:
        name = F.concat_ws(": ", "feature", "kind")
        found = leaks.where("leaks").agg(
            F.count("*").alias("n_leaks"), F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("leaking"),
            F.max(F.struct(F.round("score", 6).alias("score"), name.alias("name")))["name"].alias("strongest"),
        )
    unmeasured = "n_rows long, r2 double, learnable boolean, too_easy boolean"
    probe = df.sparkSession.createDataFrame([(None, None, None, None)], unmeasured) if probe is None else probe
    one = _broken_and_audited(df, present, settings).crossJoin(found).crossJoin(probe)  # one row each
    columns = [f"missing columns: {', '.join(missing)}"] if missing else []
    columns += [f"undeclared columns: {', '.join(undeclared)}"] if strict and undeclared else []
    issues = F.array_compact(F.array(
        *map(F.lit, columns), F.when(F.col("n_violations") > 0, F.format_string("contract: %d violations", "n_violations")),
        F.when(F.col("n_leaks") > 0, F.format_string("leakage: %d signals, strongest is %s", "n_leaks", "strongest")),
        F.when(F.col("learnable").isNull(), "learnability was not measured").when(~F.col("learnable"), "not learnable"),
    ))
    warned = [F.lit(f"{c}: absent") for c in missing] + ([F.lit("leakage was not measured")] if leaks is None else [])
    warned.append(F.when(F.col("too_easy"), "too easy"))
    made = one.withColumn("_issues", issues).withColumn("warnings", F.array_join(F.concat(F.array_compact(F.array(*warned)), "_audit"), " | "))
    first = F.when(F.size("_issues") > 0, F.regexp_extract(F.col("_issues")[0], "^[^:]*", 0))
    made = made.select(
        F.lit(",".join(missing)).alias("missing"), F.lit(",".join(undeclared)).alias("undeclared"), (F.lit(not columns) & (F.col("n_violations") == 0)).alias("schema_ok"),
        *[c for c in one.columns if c != "_audit"], F.array_join("_issues", " | ").alias("issues"), "warnings", (F.size("_issues") == 0).alias("ok"), first.alias("first_failure"),
    )
    if strict and (failure := made.first().first_failure):
        raise ValueError(f"the frame breaks its contract: {failure}")
    return made
