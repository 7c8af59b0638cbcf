"""Value frequencies (u) by pool, their field aggregates, and pair priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fslink.functions.evidence import m_of, prior_bits
from fslink.spec import CATEGORICAL, CORE, CROSS_TYPE, SAME_FAMILY, SAME_TYPE, LinkageSpec


def cells(cases: DataFrame, spec: LinkageSpec, *keep: str) -> DataFrame:
    """One row per recorded field of a case: cls, family, section, field, kind and its values (one
    for a categorical field; a tag array as it is).  Fields without evidence have no row."""
    each = []
    for f in spec.fields:
        values = F.array(F.col(f.name).cast("string")) if f.kind == CATEGORICAL else F.col(f.name).cast("array<string>")
        there = F.col(f.name).isNotNull()
        if f.families:
            there = there & F.col("family").isin(*f.families)
        each.append(F.when(there, F.struct(F.lit(f.section).alias("section"), F.lit(f.name).alias("field"), F.lit(f.kind).alias("kind"), values.alias("values"))))
    rows = spec.with_family(cases).select(*keep, F.col(spec.cls).alias("cls"), "family", F.explode(F.array(*each).cast("array<struct<section:string,field:string,kind:string,values:array<string>>>")).alias("cell"))
    return rows.where("cell is not null").select(*keep, "cls", "family", "cell.*")


def _pools(rows: DataFrame) -> DataFrame:
    pool = lambda name, key: F.struct(F.lit(name).alias("pool"), key.alias("key"))
    core = F.array(pool(SAME_TYPE, F.col("cls")), pool(CROSS_TYPE, F.lit("")))
    return rows.withColumn("p", F.explode(F.when(F.col("section") == CORE, core).otherwise(F.array(pool(SAME_FAMILY, F.col("family")))))).select("p.*", "field", "kind", "values")


def frequencies(cases: DataFrame, spec: LinkageSpec) -> DataFrame:
    """(pool, key, field, kind, value, n, total, u): the share of recorded cases with a value.

    Three pools: core fields per class, ext fields per family, core fields over all.  Tags have
    independent rates over the cases with a recorded array, empty ones included; a tag that stands
    twice in one array counts twice.  Cells are counted per (class, family) first, so the pools are
    made from a few rows.
    """
    recorded = cells(cases, spec)
    keys = ["cls", "family", "section", "field", "kind"]
    total = _summed(recorded.groupBy(*keys).agg(F.count("*").alias("n")), "total")
    found = _summed(recorded.withColumn("value", F.explode("values")).groupBy(*keys, "value").agg(F.count("*").alias("n")), "n", "value")
    both = found.join(total.select(F.col("pool"), F.col("key"), F.col("field"), "total"), ["pool", "key", "field"])
    return both.select("pool", "key", "field", "kind", "value", "n", "total", (F.col("n") / F.col("total")).alias("u"))


def _summed(counts: DataFrame, name: str, *more: str) -> DataFrame:
    pooled = _pools(counts.withColumn("values", F.struct("n", *more)))
    return pooled.groupBy("pool", "key", "field", "kind", *(F.col(f"values.{c}").alias(c) for c in more)).agg(F.sum("values.n").alias(name))


def shares_by_window(cases: DataFrame, cls: str, value: str) -> DataFrame:
    """The same shares for one categorical column with a window over the counts, per class."""
    counts = cases.where(F.col(value).isNotNull()).groupBy(cls, value).agg(F.count("*").alias("n"))
    return counts.withColumn("u", F.col("n") / F.sum("n").over(Window.partitionBy(cls)))


def shares_by_grouping_sets(cases: DataFrame, cls: str, value: str) -> DataFrame:
    """Counts per (class, value) and per value over all classes in one pass; class is null there."""
    rows = cases.where(F.col(value).isNotNull()).select(F.col(cls).alias("cls"), F.col(value).alias("value"))
    return rows.groupingSets([[F.col("cls"), F.col("value")], [F.col("value")]], F.col("cls"), F.col("value")).agg(F.count("*").alias("n"))


def field_aggregates(u: DataFrame, alpha: Column | float) -> DataFrame:
    """(pool, key, field, u_field, m_field): the chance of any agreement, unrelated and related."""
    return u.groupBy("pool", "key", "field").agg(F.sum(F.col("u") * F.col("u")).alias("u_field"), F.sum(F.col("u") * m_of(F.col("u"), alpha)).alias("m_field"))


def _pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def _class_counts(cases: DataFrame, spec: LinkageSpec) -> tuple[DataFrame, DataFrame]:
    per = cases.groupBy(spec.entity, spec.cls).agg(F.count("*").alias("n"))
    per_class = per.groupBy(F.col(spec.cls).alias("cls")).agg(F.sum(F.when(F.col(spec.entity).isNotNull(), _pairs(F.col("n"))).otherwise(0)).alias("t"), F.sum("n").alias("n"))
    return per, per_class


def priors(cases: DataFrame, spec: LinkageSpec) -> DataFrame:
    """(pair_class, key, true_pairs, all_pairs, prior): per class, for pairs of different classes,
    and over all.  Pairs are counted from group sizes, never listed."""
    per, per_class = _class_counts(cases, spec)
    same = per_class.select(F.lit(SAME_TYPE).alias("pair_class"), F.col("cls").alias("key"), F.col("t").alias("true_pairs"), _pairs(F.col("n")).alias("all_pairs"))
    entity = per.where(F.col(spec.entity).isNotNull()).groupBy(spec.entity).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0)).alias("t"))
    sums = per_class.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("same"), F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0)).alias("within")).join(entity)
    whole = sums.select(F.explode(F.array(
        F.struct(F.lit(CROSS_TYPE).alias("pair_class"), F.lit("").alias("key"), (F.col("t") - F.col("same")).alias("true_pairs"), (_pairs(F.col("n")) - F.col("within")).alias("all_pairs")),
        F.struct(F.lit("all").alias("pair_class"), F.lit("").alias("key"), F.col("t").alias("true_pairs"), _pairs(F.col("n")).alias("all_pairs")),
    )).alias("r")).select("r.*")
    return same.unionByName(whole).withColumn("prior", prior_bits(F.col("true_pairs"), F.col("all_pairs")))


def true_pairs(cases: DataFrame, spec: LinkageSpec) -> DataFrame:
    """(entity, id_a, id_b, pair_class) of all unordered pairs of one entity, id_a < id_b."""
    side = lambda x: cases.where(F.col(spec.entity).isNotNull()).select(F.col(spec.entity).alias("entity"), F.col(spec.id).alias(f"id_{x}"), F.col(spec.cls).alias(f"cls_{x}"))
    rows = side("a").join(side("b"), "entity").where("id_a < id_b")
    return rows.select("entity", "id_a", "id_b", F.when(F.col("cls_a") == F.col("cls_b"), SAME_TYPE).otherwise(CROSS_TYPE).alias("pair_class"))


def cross_repeat_rate(cases: DataFrame, spec: LinkageSpec) -> DataFrame:
    """(agreed, compared, rate) over the core categorical fields of same-entity pairs of different
    classes, fields without evidence on either side left out.

    Counted from group sizes: pairs that agree are those of one value, pairs compared those of any,
    both less the pairs within a class.
    """
    long = cells(cases, spec, spec.entity).where((F.col("section") == CORE) & (F.col("kind") == CATEGORICAL) & F.col(spec.entity).isNotNull())
    n = long.select(spec.entity, "cls", "field", F.col("values")[0].alias("value")).groupBy(spec.entity, "field", "value", "cls").agg(F.count("*").alias("n"))

    def across(*keys: str) -> DataFrame:
        per_class = n.groupBy(spec.entity, "field", *keys, "cls").agg(F.sum("n").alias("n"))
        whole = per_class.groupBy(spec.entity, "field", *keys).agg(_pairs(F.sum("n")).alias("all"), F.sum(_pairs(F.col("n"))).alias("within"))
        return whole.agg(F.coalesce(F.sum(F.col("all") - F.col("within")), F.lit(0)).alias("agreed" if keys else "compared"))

    both = across("value").join(across())
    return both.withColumn("rate", F.when(F.col("compared") > 0, F.col("agreed") / F.col("compared")))
