"""The rule engine: facts, versions by date, applicability, checks, findings; one plan without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import downgrade
from ..sources import seed
from .applicability import decide
from .checks import REVIEW, _as, check
from .conditions import Facts

#: Columns of a product that are facts under another name.
RENAMED = {"product_name": "common_generic_name", "quantity": "net_quantity", "manufacturing_date": "mfg_month_year", "source_listing_url": "ecommerce_declarations", "country_of_origin_filter": "ecommerce_coo_filter"}
#: Units of mass and volume, with their share of a kilogram or litre.
MASS, VOLUME = {"kg": 1.0, "g": 0.001, "gm": 0.001, "gram": 0.001, "grams": 0.001}, {"l": 1.0, "litre": 1.0, "liter": 1.0, "ml": 0.001}


#: Sources whose versions may decide.
VERIFIED = ("VERIFIED_PRIMARY", "VERIFIED_SECONDARY")


def origin_of(engine: Column) -> Column:
    """Where a reading comes from, by the engine that made it: a person, an assumption or a recogniser."""
    name = F.lower(F.coalesce(engine, F.lit("")))
    return F.when(name.isin("", "manual", "manual-entry"), "MANUAL").when(name.startswith("test") | name.startswith("assumed"), "ASSUMED").otherwise("OCR")


def build_facts(products: DataFrame, declarations: DataFrame | None = None, fields: list[str] | None = None, id_: str = "product_id") -> DataFrame:
    """Products with their facts as columns.

    ``declarations`` (id, ``field``, ``value``, ``confidence``, ``origin``, ``at``) override
    columns for the named ``fields``; of several, the newest that isn't empty. Each
    such field gets ``<field>__confidence`` and ``<field>__origin``.
    """
    out = products
    for column, field in RENAMED.items():
        if column in out.columns and field not in out.columns:
            out = out.withColumn(field, F.col(column))
    if declarations is not None and fields:
        own = declarations.where(F.col("value").isNotNull() & (F.col("value") != ""))
        newest = own.groupBy(id_).pivot("field", fields).agg(F.max_by(F.struct("value", "confidence", "origin"), F.col("at")))
        newest = newest.select(id_, *(F.col(f).alias(f"__{f}") for f in fields))
        out = out.join(newest, id_, "left")
        for f in fields:
            base = F.col(f).cast("string") if f in products.columns or f in RENAMED.values() and f in out.columns else F.lit(None).cast("string")
            out = out.withColumns({f: F.coalesce(F.col(f"__{f}.value"), base), f"{f}__confidence": F.col(f"__{f}.confidence"), f"{f}__origin": F.col(f"__{f}.origin")}).drop(f"__{f}")
    facts = Facts(out)
    if "qr_declared" not in out.columns:
        out = out.withColumn("qr_declared", facts.present("qr_code"))
    unit, amount = F.lower(F.coalesce(facts.text("quantity_unit"), F.lit(""))), facts.number("net_quantity")
    for name, shares in (("quantity_kg", MASS), ("quantity_litre", VOLUME)):
        value = F.lit(None).cast("double")
        for u, share in shares.items():
            value = F.when(unit == u, amount * share).otherwise(value)
        out = out.withColumn(name, value)
    return out


def findings(facts_df: DataFrame, day: str, id_: str = "product_id", checks: dict[str, str] | None = None, sources: dict[str, str] | None = None) -> DataFrame:
    """One row a product and check in force on ``day``: result, detected value, applicability, weight.

    ``sources``: the authenticity of versions' sources, verified where none is given; a
    version of another source asks for review wherever it applies.

    All checks of a product are computed in one row and then laid out, so there is
    neither a join nor a shuffle, however many rules are in force.
    """
    facts, rows = Facts(facts_df), []
    for check_id, version in (checks or seed.versions_on(day)).items():
        field, kind, mandatory, weight, severity = seed.CHECKS[check_id]
        appl = decide([{"result": r, "condition": c, "reason": w} for r, c, w in seed.APPLICABILITY.get(version, [])], facts, mandatory, version)
        run = check(kind, facts, field) if (sources or {}).get(version, VERIFIED[0]) in VERIFIED else _as(REVIEW, facts.text(field), "the source is not verified")
        confidence = F.col(f"{field}__confidence") if f"{field}__confidence" in facts_df.columns else F.lit(None).cast("double")
        origin = F.col(f"{field}__origin") if f"{field}__origin" in facts_df.columns else F.lit("MANUAL")
        rows.append(F.struct(F.lit(check_id).alias("check_id"), F.lit(version).alias("version"), F.lit(field).alias("field"), F.lit(weight).alias("weight"), F.lit(severity).alias("severity"), appl.alias("appl"), run.alias("run"), confidence.cast("double").alias("confidence"), F.coalesce(origin, F.lit("MANUAL")).alias("origin")))
    laid = facts_df.select(id_, F.inline(F.array(*rows)))
    ran = downgrade(F.col("run.result"), F.col("origin"), F.col("confidence"))
    result = F.when(F.col("appl.applicable"), ran).when(~F.col("appl.applicable"), "NOT_APPLICABLE").otherwise("NEEDS_REVIEW")
    return laid.select(id_, "check_id", "version", "field", "weight", "severity", result.alias("result"), F.when(F.col("appl.applicable"), F.col("run.detected")).otherwise("").alias("detected"), F.col("appl.status").alias("applicability"), F.coalesce(F.when(F.col("appl.applicable"), F.col("run.note")), F.col("appl.reason")).alias("explanation"), "confidence", "origin")


def violations(found: DataFrame) -> DataFrame:
    """One open violation a failed finding."""
    kind = F.when(F.col("detected") == "", "MISSING_DECLARATION").otherwise("INVALID_DECLARATION")
    return found.where("result = 'FAIL'").withColumn("violation_type", kind).withColumn("inspector_status", F.lit("PENDING"))
