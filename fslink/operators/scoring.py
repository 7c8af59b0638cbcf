"""Scoring pairs: evidence per field in bits, totals, ranks and feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fslink.functions.evidence import agreement_bits, bits_sort_key, disagreement_bits, m_of
from fslink.operators.frequencies import field_aggregates
from fslink.spec import CATEGORICAL, CORE, CROSS_TYPE, SAME_FAMILY, SAME_TYPE, LinkageSpec


def sides(pairs: DataFrame, cases: DataFrame, spec: LinkageSpec) -> DataFrame:
    """Both cases of each pair (id_a, id_b, ...) as structs a and b."""
    full = spec.with_family(cases)
    side = lambda x: full.select(F.col(spec.id).alias(f"id_{x}"), F.struct(F.col(spec.cls).alias("cls"), "family", *(f.name for f in spec.fields)).alias(x))
    return pairs.join(side("a"), "id_a").join(side("b"), "id_b")


def evidence(hydrated: DataFrame, spec: LinkageSpec, *keep: str) -> DataFrame:
    """One row per comparable field (per tag of either side, for tags) of each pair.

    The classes decide the pool of core fields, the families whether ext fields count at all, so a
    pair of one family and two classes scores core fields as cross-type and still its ext fields.
    """
    none = F.lit(None).cast("string")
    same = F.col("a.cls") == F.col("b.cls")
    kin = F.col("a.family") == F.col("b.family")
    rows = []
    for f in spec.fields:
        va, vb = F.col(f"a.{f.name}"), F.col(f"b.{f.name}")
        there = va.isNotNull() & vb.isNotNull()
        if f.section == CORE:
            pool, key = F.when(same, SAME_TYPE).otherwise(CROSS_TYPE), F.when(same, F.col("a.cls")).otherwise(F.lit(""))
        else:
            there = there & kin
            pool, key = F.lit(SAME_FAMILY), F.col("a.family")
        if f.families:
            there = there & F.col("a.family").isin(*f.families) & F.col("b.family").isin(*f.families)
        row = lambda value, agree, a, b, tag, pool=pool, key=key, f=f: F.struct(pool.alias("pool"), key.alias("key"), F.lit(f.name).alias("field"), F.lit(f.kind).alias("kind"), value.alias("value"), agree.alias("agree"), a.alias("value_a"), b.alias("value_b"), tag.alias("tag"))
        if f.kind == CATEGORICAL:
            found = F.array(row(va.cast("string"), va == vb, va.cast("string"), vb.cast("string"), none))
        else:
            found = _tags(va.cast("array<string>"), vb.cast("array<string>"), row)
        rows.append(F.when(there, found))
    made = hydrated.withColumn("e", F.explode(F.flatten(F.array_compact(F.array(*rows)))))
    return made.select("id_a", "id_b", F.when(same, SAME_TYPE).otherwise(CROSS_TYPE).alias("pair_class"), F.when(same, F.col("a.cls")).otherwise(F.lit("")).alias("class_key"), *keep, "e.*")


def _tags(a: Column, b: Column, row) -> Column:
    said = lambda has: F.when(has, "True").otherwise("False")
    return F.transform(F.array_sort(F.array_union(a, b)), lambda t: row(t, F.array_contains(a, t) & F.array_contains(b, t), said(F.array_contains(a, t)), said(F.array_contains(b, t)), t))


def contributions(pairs: DataFrame, cases: DataFrame, u: DataFrame, spec: LinkageSpec, alpha_same: float, alpha_cross: float, *keep: str) -> DataFrame:
    """(id_a, id_b, pair_class, class_key, field, value_a, value_b, u, m, bits) per contribution.

    Agreement is weighed by the value's own u (no evidence if the pool lacks it), categorical
    disagreement by the field's aggregates, a tag on one side only by that tag's u.  The frequency
    tables have a row per known value; Spark broadcasts them while they are small.
    """
    rows = evidence(sides(pairs, cases, spec), spec, *keep)
    alpha = F.when(F.col("pair_class") == SAME_TYPE, F.lit(float(alpha_same))).otherwise(F.lit(float(alpha_cross)))
    known = u.select("pool", "key", "field", "value", "u")
    # m of a field is linear in sum(u*u): one aggregate serves both alphas.
    squares = field_aggregates(u, 0.0).select("pool", "key", "field", "u_field", F.col("m_field").alias("sum_u"))
    joined = rows.join(known, ["pool", "key", "field", "value"], "left").join(squares, ["pool", "key", "field"], "left")
    m_field = (alpha * F.col("u_field") + F.col("sum_u")) / (alpha + 1)
    tag = F.col("tag").isNotNull()
    m = m_of(F.col("u"), alpha)
    by_field = ~F.col("agree") & ~tag
    scored = joined.select(
        "id_a", "id_b", "pair_class", "class_key", *keep,
        F.when(tag, F.concat_ws(":", "field", "tag")).otherwise(F.col("field")).alias("field"), "value_a", "value_b",
        F.when(by_field, F.col("u_field")).otherwise(F.col("u")).alias("u"),
        F.when(by_field, m_field).otherwise(m).alias("m"),
        F.when(F.col("agree"), agreement_bits(m, F.col("u"))).when(tag, disagreement_bits(m, F.col("u"))).otherwise(disagreement_bits(m_field, F.col("u_field"))).alias("bits"),
    )
    return scored.where("bits is not null")


def totals(pairs: DataFrame, cases: DataFrame, scored: DataFrame, priors: DataFrame, spec: LinkageSpec) -> DataFrame:
    """(id_a, id_b, pair_class, prior_bits, total_bits) of every pair, also those without evidence;
    a null prior counts as 0 in the total and stays null."""
    cls = cases.select(F.col(spec.id).alias("i"), F.col(spec.cls).alias("c"))
    typed = pairs.select("id_a", "id_b").join(cls.select(F.col("i").alias("id_a"), F.col("c").alias("ca")), "id_a").join(cls.select(F.col("i").alias("id_b"), F.col("c").alias("cb")), "id_b")
    same = F.col("ca") == F.col("cb")
    typed = typed.select("id_a", "id_b", F.when(same, SAME_TYPE).otherwise(CROSS_TYPE).alias("pair_class"), F.when(same, F.col("ca")).otherwise(F.lit("")).alias("class_key"))
    sums = scored.groupBy("id_a", "id_b").agg(F.sum("bits").alias("evidence"))
    known = priors.select("pair_class", F.col("key").alias("class_key"), F.col("prior").alias("prior_bits"))
    joined = typed.join(sums, ["id_a", "id_b"], "left").join(known, ["pair_class", "class_key"], "left")
    return joined.select("id_a", "id_b", "pair_class", "prior_bits", (F.coalesce("prior_bits", F.lit(0.0)) + F.coalesce("evidence", F.lit(0.0))).alias("total_bits"))


def collapsed(scored: DataFrame, spec: LinkageSpec) -> DataFrame:
    """A row per pair with one column of bits per field of the spec; tags sum into their field."""
    names = [f.name for f in spec.fields]
    wide = scored.withColumn("base", F.split_part("field", F.lit(":"), F.lit(1))).groupBy("id_a", "id_b").pivot("base", names).agg(F.sum("bits"))
    return wide.select("id_a", "id_b", *(F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names))


def ranked(directed: DataFrame) -> DataFrame:
    """Adds rank (1, 2, ...) by total bits within each case, ties in the order of retrieval, then of
    the partner's id.  Columns: case_id, partner_id, total_bits, retrieval_rank, ..."""
    order = Window.partitionBy("case_id").orderBy(F.col("total_bits").desc(), "retrieval_rank", "partner_id")
    return directed.withColumn("rank", F.row_number().over(order))


def with_contributions(links: DataFrame, scored: DataFrame) -> DataFrame:
    """Adds the array of contributions, by absolute bits descending, to links (case_id, partner_id)."""
    item = F.struct((-F.abs("bits")).alias("order"), "field", "value_a", "value_b", "u", "m", "bits")
    made = scored.groupBy(F.col("id_a").alias("case_id"), F.col("id_b").alias("partner_id")).agg(F.array_sort(F.collect_list(item)).alias("found"))
    joined = links.join(made, ["case_id", "partner_id"], "left")
    return joined.withColumn("contributions", F.transform(F.coalesce("found", F.array().cast(made.schema["found"].dataType)), lambda x: F.struct(*(x[k].alias(k) for k in ("field", "value_a", "value_b", "u", "m", "bits"))))).drop("found")


def driven_by(scored: DataFrame, top: int = 3) -> DataFrame:
    """(id_a, id_b, place, label) of the strongest contributions: field=value, or field disagrees."""
    order = Window.partitionBy("id_a", "id_b").orderBy(F.abs("bits").desc(), "field")
    label = F.when(F.col("value_a") == F.col("value_b"), F.concat_ws("=", "field", "value_a")).otherwise(F.concat(F.col("field"), F.lit(" disagrees")))
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("id_a", "id_b", "place", label.alias("label"))


def driven_by_labels(contributions: Column, top: int = 3) -> Column:
    """array<string>: the labels of the strongest of an array of contributions (field, value_a,
    value_b, bits), strongest first."""
    order = F.sort_array(F.transform(contributions, lambda x: F.struct((-F.abs(x["bits"])).alias("order"), x["field"].alias("field"), x["value_a"].alias("value_a"), x["value_b"].alias("value_b"))))
    label = lambda x: F.when(x["value_a"] == x["value_b"], F.concat_ws("=", x["field"], x["value_a"])).otherwise(F.concat(x["field"], F.lit(" disagrees")))
    return F.transform(F.slice(order, 1, top), label)


def raw_comparison(cases: DataFrame, spec: LinkageSpec, id_a, id_b) -> DataFrame:
    """(field, value_a, value_b) of the core fields that both cases have, side by side, as they were
    recorded; tags joined by commas, none for none."""
    core = spec.of(CORE)
    shown = lambda f: F.when(F.size(f.name) == 0, "none").otherwise(F.array_join(f.name, ", ")) if f.kind != CATEGORICAL else F.col(f.name).cast("string")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(f.name).alias("field"), F.when(F.col(f.name).isNotNull(), shown(f)).alias("value")) for k, f in enumerate(core)))).alias("x")
    side = lambda id, x: cases.where(F.col(spec.id) == id).select(each).select("x.place", "x.field", F.col("x.value").alias(f"value_{x}")).where(f"value_{x} is not null")
    return side(id_a, "a").join(side(id_b, "b"), ["place", "field"]).orderBy("place").drop("place")


def waterfall(scored: DataFrame, totals_: DataFrame) -> DataFrame:
    """(id_a, id_b, step, field, before, after) from the prior through every contribution."""
    order = Window.partitionBy("id_a", "id_b").orderBy(F.abs("bits").desc(), "field")
    rows = scored.join(totals_.select("id_a", "id_b", F.coalesce("prior_bits", F.lit(0.0)).alias("base")), ["id_a", "id_b"])
    run = F.col("base") + F.sum("bits").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("id_a", "id_b", F.row_number().over(order).alias("step"), "field", (run - F.col("bits")).alias("before"), run.alias("after"))


def scoped(links: DataFrame, case_id, scope: str | None = None, limit: int = 10) -> DataFrame:
    """A case's links, most bits first; scope keeps one pair class after ranking, ranks stay."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be 1 to 50")
    found = links.where(F.col("case_id") == case_id)
    if scope is not None:
        found = found.where(F.col("pair_class") == scope)
    return found.orderBy("rank").limit(limit)


def sort_keys(links: DataFrame) -> DataFrame:
    return links.withColumn("sk", bits_sort_key(F.col("total_bits"), F.col("partner_id")))
