"""The rule base: checks, dated versions, applicability rows and weights, stated as fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values. check: (field, type, mandatory, weight, severity).
CHECKS = {
    "CHK-MANUFACTURER": ("manufacturer", "QR_OR_ON_PACKAGE", True, 15.0, "HIGH"),
    "CHK-COMMON-NAME": ("common_generic_name", "FIELD_PRESENT", True, 5.0, "LOW"),
    "CHK-NET-QTY": ("net_quantity", "UNIT_NORMALIZATION", True, 15.0, "HIGH"),
    "CHK-MFG-DATE": ("mfg_month_year", "DATE_VALID", True, 10.0, "MEDIUM"),
    "CHK-MRP": ("mrp", "FIELD_PRESENT", True, 20.0, "HIGH"),
    "CHK-DIMENSIONS": ("dimensions", "CONDITIONAL_FIELD_PRESENT", False, 5.0, "LOW"),
    "CHK-OTHER-MATTERS": ("other_declarations", "MANUAL_REVIEW", False, 0.0, "LOW"),
    "CHK-COUNTRY-ORIGIN": ("country_of_origin", "CONDITIONAL_FIELD_PRESENT", False, 15.0, "HIGH"),
    "CHK-BEST-BEFORE": ("best_before", "DATE_REQUIRED_IF", False, 10.0, "MEDIUM"),
    "CHK-CONSUMER-CARE": ("consumer_care", "FIELD_PRESENT", True, 15.0, "MEDIUM"),
    "CHK-GM-FOOD": ("gm_label", "CONDITIONAL_FIELD_PRESENT", False, 15.0, "HIGH"),
    "CHK-VEG-NONVEG": ("veg_nonveg_dot", "CONDITIONAL_FIELD_PRESENT", False, 10.0, "MEDIUM"),
    "CHK-UNIT-SALE-PRICE": ("unit_sale_price", "CONDITIONAL_FIELD_PRESENT", False, 10.0, "MEDIUM"),
    "CHK-ECOMMERCE-DECL": ("ecommerce_declarations", "PLATFORM_FILTER_PRESENT", False, 15.0, "HIGH"),
    "CHK-ECOMMERCE-COO-FILTER": ("ecommerce_coo_filter", "PLATFORM_FILTER_PRESENT", False, 10.0, "MEDIUM"),
}
#: Fixed values. (version, check, in force from, until before; None: open, status).
VERSIONS = [
    ("01", "CHK-MANUFACTURER", "2011-06-01", "2023-06-23", "SUPERSEDED"),
    ("25", "CHK-MANUFACTURER", "2023-06-23", None, "IN_FORCE"),
    ("09", "CHK-COMMON-NAME", "2011-06-01", "2023-06-23", "SUPERSEDED"),
    ("26", "CHK-COMMON-NAME", "2023-06-23", None, "IN_FORCE"),
    ("02", "CHK-NET-QTY", "2011-06-01", None, "IN_FORCE"),
    ("04", "CHK-MFG-DATE", "2011-06-01", "2022-10-01", "SUPERSEDED"),
    ("29", "CHK-MFG-DATE", "2022-10-01", None, "IN_FORCE"),
    ("03", "CHK-MRP", "2011-06-01", "2022-10-01", "SUPERSEDED"),
    ("30", "CHK-MRP", "2022-10-01", None, "IN_FORCE"),
    ("10", "CHK-DIMENSIONS", "2011-06-01", "2023-06-23", "SUPERSEDED"),
    ("27", "CHK-DIMENSIONS", "2023-06-23", None, "IN_FORCE"),
    ("11", "CHK-OTHER-MATTERS", "2011-06-01", None, "IN_FORCE"),
    ("17", "CHK-COUNTRY-ORIGIN", "2018-01-01", None, "IN_FORCE"),
    ("18", "CHK-BEST-BEFORE", "2011-04-01", None, "IN_FORCE"),
    ("05", "CHK-CONSUMER-CARE", "2011-06-01", "2016-01-01", "SUPERSEDED"),
    ("06", "CHK-CONSUMER-CARE", "2016-01-01", "2023-06-23", "SUPERSEDED"),
    ("28", "CHK-CONSUMER-CARE", "2023-06-23", None, "IN_FORCE"),
    ("19", "CHK-GM-FOOD", "2013-01-01", None, "IN_FORCE"),
    ("20", "CHK-VEG-NONVEG", "2014-07-01", None, "IN_FORCE"),
    ("12", "CHK-UNIT-SALE-PRICE", "2022-04-01", "2022-10-01", "SUPERSEDED"),
    ("13", "CHK-UNIT-SALE-PRICE", "2022-10-01", None, "IN_FORCE"),
    ("22", "CHK-ECOMMERCE-DECL", "2018-01-01", None, "IN_FORCE"),
    ("07", "CHK-ECOMMERCE-COO-FILTER", "2026-07-01", "2027-07-01", "IN_FORCE"),
    ("08", "CHK-ECOMMERCE-COO-FILTER", "2027-07-01", None, "NOT_YET_IN_FORCE"),
]


def _eq(field, value):
    return {"field": field, "eq": value}


def _plain(mode):
    return {"all": [_eq("quantity_type", mode), *(_eq(f, False) for f in PACKAGES)]}


PACKAGES = ("combination_package", "group_package", "multi_piece_package")
_COSMETICS = {"all": [_eq("category", "COSMETIC"), {"field": "subcategory", "in": ["SOAP", "SHAMPOO", "TOOTHPASTE", "COSMETIC_TOILETRY"]}]}
_NOTICE = {"all": [_eq("electronic_product", True), _eq("qr_declared", True), _eq("package_qr_notice_present", True)]}
#: Fixed values. version: its applicability rows (outcome, condition, reason), in order.
APPLICABILITY = {
    "07": [("REQUIRED", {"all": [_eq("ecommerce", True), _eq("imported", True)]}, "online sale of imported goods"), ("NOT_APPLICABLE", _eq("imported", False), "domestic goods")],
    "04": [("CONDITIONAL", _eq("category", "COSMETIC"), "some cosmetics are excluded")],
    "13": [
        ("REQUIRED", {"field": "quantity_type", "in": ["weight", "volume", "length", "number"]}, "sold by a comparable quantity"),
        *(("REQUIRED", _plain(mode), f"ordinary package by {mode}") for mode in ("weight", "volume", "length", "number")),
        ("NOT_REQUIRED", {"any": [_eq(f, True) for f in PACKAGES]}, "combination, group or multi-piece package"),
    ],
    "17": [("REQUIRED", _eq("imported", True), "imported goods")],
    "18": [("CONDITIONAL", _eq("may_become_unfit", True), "goods that may become unfit")],
    "19": [("REQUIRED", _eq("genetically_modified", True), "genetically modified food")],
    "20": [("CONDITIONAL", _COSMETICS, "listed cosmetics")],
    "22": [("REQUIRED", _eq("ecommerce", True), "online sale")],
    "25": [("CONDITIONAL", _NOTICE, "electronic product with a code and its notice")],
    "26": [("CONDITIONAL", _NOTICE, "electronic product with a code and its notice")],
    "27": [("CONDITIONAL", _NOTICE, "electronic product with a code and its notice")],
    "28": [("CONDITIONAL", _eq("electronic_product", True), "electronic product")],
}
#: Statuses of a version that take part in the choice by date.
SELECTABLE = ("IN_FORCE", "SUPERSEDED", "NOT_YET_IN_FORCE")


def rule_versions(spark: SparkSession) -> DataFrame:
    """All versions with their check, as a small table."""
    rows = [(v, c, CHECKS[c][0], CHECKS[c][1], CHECKS[c][2], CHECKS[c][3], CHECKS[c][4], a, b, s) for v, c, a, b, s in VERSIONS]
    df = spark.createDataFrame(rows, "version string, check_id string, field string, check_type string, mandatory boolean, weight double, severity string, valid_from string, valid_to string, status string")
    return df.withColumns({k: df[k].cast("date") for k in ("valid_from", "valid_to")})


def versions_on(day: str) -> dict[str, str]:
    """The version of each check in force on an ISO date; of several, the latest."""
    found: dict[str, tuple[str, str]] = {}
    for v, c, a, b, s in VERSIONS:
        if s in SELECTABLE and a <= day and (b is None or day < b) and (c not in found or a > found[c][0]):
            found[c] = (a, v)
    return {c: v for c, (_, v) in sorted(found.items())}
