"""The serving surface as functions over tables: each returns (status, DataFrame or dict)."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fslink.functions.evidence import bits_sort_key
from fslink.operators.scoring import driven_by_labels, scoped
from fslink.sources.tables import get_item
from fslink.spec import SAME_TYPE

PRIVATE = ("pii_ref", "sk", "crime_type_year_quarter", "needs_enrichment")
STATUSES = ("confirmed", "rejected", "unsure")
#: What a caller may ask for: one pair class, or both.
SCOPES = {"same": SAME_TYPE, "all": None}
#: Links of a case that are read before they are narrowed to a scope.
FETCHED = 200
#: Which tables a role reaches; personal data is reached by one role alone, which reads nothing else but its audit.
ROLES = {
    "ingest": frozenset({"raw", "cases", "audit"}),
    "link": frozenset({"cases", "links", "config", "audit"}),
    "api": frozenset({"cases", "links", "feedback", "audit"}),
    "pii": frozenset({"pii", "audit"}),
}


def reaches(role: str, table: str) -> bool:
    return table in ROLES.get(role, ())


def public(cases: DataFrame) -> DataFrame:
    """Cases without internal and personal columns."""
    return cases.drop(*PRIVATE)


def get_case(cases: DataFrame, case_id) -> tuple[int, DataFrame | None]:
    found = public(get_item(cases, "case_id", case_id))
    return (200, found) if found.take(1) else (404, None)


def get_links(cases: DataFrame, links: DataFrame, case_id, scope: str = "same", limit: int = 10) -> tuple[int, DataFrame | None]:
    """A case's links, most bits first, with what drives them if they carry contributions; of one
    class unless the scope is all, ranks as they are over both.  404 for an unknown case, 400 for a limit
    outside 1 to 50 or a wrong scope."""
    if not 1 <= limit <= 50 or scope not in SCOPES:
        return 400, None
    if not get_item(cases, "case_id", case_id).take(1):
        return 404, None
    fetched = links.where(F.col("case_id") == case_id).orderBy(bits_sort_key(F.col("total_bits"), F.col("partner_id"))).limit(FETCHED)
    found = scoped(fetched, case_id, SCOPES[scope], limit)
    return 200, found.withColumn("driven_by", driven_by_labels(F.col("contributions"))) if "contributions" in links.columns else found


def case_record(cases: DataFrame) -> DataFrame:
    """Cases as the service shows them: without internal columns and the register number, times in
    ISO 8601."""
    shown = public(cases).drop("fir_no")
    times = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c, kind in shown.dtypes if kind.startswith("timestamp")}
    return shown.withColumns(times) if times else shown


def link_record(links: DataFrame) -> DataFrame:
    """Links as the service shows them: bits as decimals of six places, each contribution with what
    drives it and where both values come from."""
    decimal = lambda c: c.cast("decimal(18,6)")
    item = lambda x: F.struct(x["field"].alias("field"), x["value_a"].alias("value_a"), x["value_b"].alias("value_b"), decimal(x["u"]).alias("u"), decimal(x["bits"]).alias("bits"), *([x["provenance"].alias("provenance")] if "provenance" in _fields(links) else []))
    return links.select("case_id", "partner_id", "rank", decimal(F.col("total_bits")).alias("total_bits"), decimal(F.col("prior_bits")).alias("prior_bits"), "pair_class", driven_by_labels(F.col("contributions")).alias("driven_by"), F.transform("contributions", item).alias("contributions"))


def _fields(links: DataFrame) -> list[str]:
    return links.schema["contributions"].dataType.elementType.fieldNames()


def post_feedback(spark: SparkSession, path: str, actor: str, body: dict, at: datetime | None = None) -> tuple[int, dict]:
    """Appends a validated judgement of a directed pair."""
    if body.get("status") not in STATUSES or not str(body.get("reason") or "").strip() or not body.get("case_id_a") or not body.get("case_id_b"):
        return 400, {"error": "status, reason, case_id_a and case_id_b are required"}
    row = {k: str(body[k]) for k in ("case_id_a", "case_id_b", "status", "reason")} | {"actor_id": actor, "pair_id": f"{body['case_id_a']}#{body['case_id_b']}", "submitted_at": (at or datetime.now(UTC)).isoformat()}
    spark.createDataFrame([row]).write.mode("append").parquet(path)
    return 201, row


def audit(spark: SparkSession, path: str, actor: str, action: str, detail: str) -> None:
    spark.createDataFrame([{"actor_id": actor, "action": action, "detail": detail, "at": datetime.now(UTC).isoformat()}]).write.mode("append").parquet(path)


def request_pii(spark: SparkSession, pii: DataFrame, audit_path: str, actor: str, pii_ref, reason: str | None) -> tuple[int, DataFrame | None]:
    """Personal data by reference, with a stated reason only; either way the request is audited."""
    allowed = bool((reason or "").strip())
    audit(spark, audit_path, actor, "pii_allow" if allowed else "pii_deny", str(pii_ref))
    return (200, get_item(pii, "pii_ref", pii_ref)) if allowed else (403, None)


def clusters_of(clusters: DataFrame, case_id) -> DataFrame:
    return clusters.where(F.array_contains("members", case_id))
