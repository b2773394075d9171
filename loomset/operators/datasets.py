"""Reports and samples of whole datasets, from one pass of pre-aggregated counts each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomset.operators.splits import shuffled_by


def statistics(items: DataFrame, labels: str, groups: dict[str, str]) -> DataFrame:
    """metric, name, value: items in all and with labels, counts of each label and of each value of `groups`, and the labels' imbalance.

    Imbalance is the largest label count over the smallest.
    """
    def one(metric: str, name: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), F.coalesce(name.cast("string"), F.lit("none")).alias("name"))

    own = [one("items", F.lit("all")), F.when(F.size(labels) > 0, one("items", F.lit("labelled"))), *(one(k, F.col(c)) for k, c in groups.items())]
    named = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: one("label", x))
    counts = items.select(F.explode(F.concat(F.array_compact(F.array(*own)), named)).alias("x")).groupBy("x.metric", "x.name").agg(F.count("*").cast("double").alias("value"))
    spread = counts.filter("metric = 'label'").agg(F.round(F.max("value") / F.min("value"), 4).alias("value")).filter("value is not null")
    return counts.unionByName(spread.select(F.lit("imbalance").alias("metric"), F.lit("label").alias("name"), "value"))


def stratified_sample(items: DataFrame, key: str, labels: str, size: int, seed: int = 42) -> DataFrame:
    """A sample that keeps the shares of first labels, in the order of a seeded hash.

    A label gets the whole part of its share, one at least; unlabelled items get theirs; the rest is topped up from
    what is left. Places come from ranks within 256 ranges of the hash, as in stratified_split(). So that every label is there, the sample may exceed `size` by the number of labels at most.
    """
    h = shuffled_by(key, seed)
    x = items.select(key, F.element_at(F.when(F.size(labels) > 0, F.col(labels)), 1).alias("label"), h.alias("h"))
    total = x.count()
    counts = x.groupBy("label").agg(F.count("*").alias("n"))
    share = F.floor(F.lit(size) * F.col("n") / F.lit(max(total, 1)))
    quota = counts.withColumn("quota", F.least("n", F.when(F.col("label").isNull(), share).otherwise(F.greatest(F.lit(1), share))))
    if total <= size:
        return x.select(key, F.coalesce("label", F.lit("none")).alias("label"))
    missing = size - int(quota.agg(F.sum("quota")).first()[0] or 0)
    ranges = x.withColumn("part", F.substring("h", 1, 2))
    sizes = ranges.groupBy("label", "part").agg(F.count("*").alias("s"))
    before = sizes.select(F.col("label").alias("l"), F.col("part").alias("p"), (F.sum("s").over(Window.partitionBy("label").orderBy("part")) - F.col("s")).alias("before"))
    ranked = ranges.withColumn("rank", F.row_number().over(Window.partitionBy("label", "part").orderBy("h", key)))
    ranked = ranked.join(before, ranked["label"].eqNullSafe(before["l"]) & (ranked["part"] == before["p"])).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(quota, ranked["label"].eqNullSafe(quota["label"])).select(key, ranked["label"], "h", (F.col("rank") <= F.col("quota")).alias("chosen"))
    out = placed.filter("chosen")
    if missing > 0:
        out = out.unionByName(placed.filter("not chosen").orderBy("h", key).limit(missing))
    return out.select(key, F.coalesce("label", F.lit("none")).alias("label"))


def validation_report(items: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, broken and share of rows that keep it, and the row `all` for rows that keep every rule."""
    kept = {name: F.coalesce(c, F.lit(False)) for name, c in rules.items()}
    every = F.lit(True)
    for c in kept.values():
        every = every & c
    n = items.agg(F.count("*").alias("rows"), *(F.count_if(~c).alias(name) for name, c in {**kept, "all": every}.items()))
    return n.unpivot(["rows"], [*kept, "all"], "rule", "broken").select("rule", "broken", F.round(1 - F.col("broken") / F.col("rows"), 4).alias("validity"))


BOOLEAN_WORDS = ["true", "false", "yes", "no", "0", "1", "t", "f", "y", "n"]  # fixed values


def column_kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """The kind of each column by its values: empty, id, boolean, numeric, datetime, categorical or text.

    An id's name ends in `id` or `key` and its values are distinct; numeric are over 90 % numbers, datetime over 80 %
    dates; categorical have at most 50 values, and at most one in twenty rows a new one.
    """
    # the name is a value of the grouping key, so all columns are profiled in one shuffle of distinct values
    cells = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "value")
    values = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    value = F.trim("value")
    known = values.filter("value is not null").groupBy("column").agg(
        F.sum("n").alias("filled"), F.count("*").alias("distinct"),
        F.sum(F.when(F.expr("try_cast(value as double)").isNotNull(), F.col("n")).otherwise(0)).alias("numbers"),
        F.sum(F.when(F.lower(value).isin(BOOLEAN_WORDS), F.col("n")).otherwise(0)).alias("booleans"),
        F.sum(F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.col("n")).otherwise(0)).alias("dates"),
    )
    x = values.groupBy("column").agg(F.sum("n").alias("rows")).join(known, "column", "left").na.fill(0)
    kind = (
        F.when(F.col("filled") == 0, "empty").when(F.col("column").rlike("(?i)(id|key)$") & (F.col("distinct") > 0.99 * F.col("filled")), "id")
        .when(F.col("booleans") == F.col("filled"), "boolean").when(F.col("numbers") > 0.9 * F.col("filled"), "numeric").when(F.col("dates") > 0.8 * F.col("filled"), "datetime")
        .when((F.col("distinct") <= 50) & (F.col("distinct") * 20 <= F.col("filled")), "categorical").otherwise("text")
    )
    return x.select("column", kind.alias("kind"), "filled", "distinct", F.round(1 - F.col("filled") / F.col("rows"), 4).alias("null_share"))
