"""Registry records: officers, controllers, filings and places out of nested JSON, and the rules on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.functions import identity as ident
from scoutline.functions.ladders import months

# --- fixed values ---------------------------------------------------------------------------------------
CORPORATE_ROLES = (
    "corporate-director",
    "corporate-secretary",
    "corporate-nominee-director",
    "corporate-nominee-secretary",
    "corporate-llp-designated-member",
    "corporate-llp-member",
    "corporate-managing-officer",
    "corporate-member-of-a-management-organ",
    "corporate-member-of-a-supervisory-organ",
    "corporate-member-of-an-administrative-organ",
)
SECRETARY_ROLES = ("secretary", "corporate-secretary", "nominee-secretary", "corporate-nominee-secretary")
FOUNDER_ROLES = ("director", "llp-designated-member", "llp-member", "member-of-a-management-organ", "managing-officer", "judicial-factor")
SHARE_ISSUE_MONTHS = 18
OFFICERS = "struct<items: array<struct<name: string, officer_role: string, appointed_on: string, resigned_on: string, identification: string, links: struct<officer: struct<appointments: string>>>>>"
CONTROLLERS = "struct<items: array<struct<name: string, kind: string, notified_on: string, ceased_on: string, ceased: boolean, natures_of_control: array<string>>>>"
FILINGS = "struct<items: array<struct<type: string, date: string, transaction_id: string>>>"


def officers(df: DataFrame, id_col: str, raw: str) -> DataFrame:
    """One row per named officer; only what a founder record may hold is read from the JSON."""
    items = df.select(id_col, F.posexplode(F.from_json(raw, OFFICERS)["items"]).alias("at", "o"))
    role = F.nullif(F.lower(F.trim("o.officer_role")), F.lit(""))
    link = F.regexp_extract(F.coalesce("o.links.officer.appointments", F.lit("")), "/officers/([^/]+)/", 1)
    rows = items.select(id_col, "at", ident.display_name(F.col("o.name")).alias("name"), role.alias("role"), F.try_to_date("o.appointed_on").alias("appointed_on"), (F.coalesce(role.isin(*CORPORATE_ROLES), F.lit(False)) | F.col("o.identification").isNotNull()).alias("corporate"), (F.coalesce("o.resigned_on", F.lit("")) != "").alias("resigned"), F.nullif(link, F.lit("")).alias("officer_id"))
    return rows.where("name <> ''").withColumn("person", ident.person_key(F.col("name")))


def controllers(df: DataFrame, id_col: str, raw: str) -> DataFrame:
    """One row per named controller; protected ones are left out."""
    items = df.select(id_col, F.posexplode(F.from_json(raw, CONTROLLERS)["items"]).alias("at", "p"))
    kind = F.lower(F.coalesce("p.kind", F.lit("")))
    rows = items.where(~F.contains(kind, F.lit("super-secure"))).select(id_col, "at", ident.display_name(F.col("p.name")).alias("name"), F.try_to_date("p.notified_on").alias("notified_on"), (~F.contains(kind, F.lit("individual")) & ~F.contains(kind, F.lit("legal-person"))).alias("corporate"), ((F.coalesce("p.ceased_on", F.lit("")) != "") | F.coalesce("p.ceased", F.lit(False))).alias("ceased"), F.size(F.coalesce("p.natures_of_control", F.array().cast("array<string>"))).alias("controls"))
    return rows.where("name <> ''").withColumn("person", ident.person_key(F.col("name")))


def founder_candidate() -> Column:
    """Serving natural persons in a founder's role, or in none that is stated."""
    return ~F.col("corporate") & ~F.col("resigned") & (F.col("role").isNull() | F.col("role").isin(*FOUNDER_ROLES))


def founders(officer_rows: DataFrame, controller_rows: DataFrame, id_col: str) -> DataFrame:
    """Candidates and controlling persons, one row per person, with who controls and who is an officer."""
    holds = controller_rows.where("not corporate and not ceased").groupBy(id_col, "person").agg(F.min("name").alias("held_name"), F.min("notified_on").alias("notified_on"))
    serve = officer_rows.where(founder_candidate()).groupBy(id_col, "person").agg(F.min("name").alias("name"), F.min("role").alias("role"), F.min("appointed_on").alias("appointed_on"))
    both = serve.join(holds, [id_col, "person"], "full_outer")
    return both.select(id_col, "person", F.coalesce("name", "held_name").alias("name"), "role", F.coalesce("appointed_on", "notified_on").alias("since"), F.col("held_name").isNotNull().alias("controls"))


def only_corporate_secretary(officer_rows: DataFrame, id_col: str) -> DataFrame:
    """(id, only): true if all serving officers are corporate secretaries; no serving officer is no evidence."""
    secretary = F.col("corporate") & F.coalesce(F.col("role").isin(*SECRETARY_ROLES), F.lit(False))
    serving = ~F.col("resigned")
    return officer_rows.groupBy(id_col).agg((F.count_if(serving) > 0).alias("some"), F.coalesce(F.bool_and(F.when(serving, secretary)), F.lit(False)).alias("all")).select(id_col, (F.col("some") & F.col("all")).alias("only"))


def share_issues(df: DataFrame, id_col: str, raw: str, *keep: str) -> DataFrame:
    """One row per share issue filed."""
    items = df.select(id_col, *keep, F.explode(F.from_json(raw, FILINGS)["items"]).alias("f"))
    return items.where(F.upper(F.trim("f.type")) == "SH01").select(id_col, *keep, F.try_to_date("f.date").alias("filed_on"), F.col("f.transaction_id").alias("transaction_id"))


def early_issue(filed: Column, born: Column, within: int = SHARE_ISSUE_MONTHS) -> Column:
    """True if filed within so many months of incorporation; an unknown date counts."""
    gap = months(born, filed, "calendar")
    return F.coalesce(gap.between(0, within), F.lit(True))


def prior_appointments(total: Column) -> Column:
    """Appointments besides the one that is known."""
    return F.greatest(total - 1, F.lit(0))


def denied_only(codes: Column, denied: tuple[str, ...]) -> Column:
    """True if there are codes and all are on the list; no code is no reason."""
    return (F.size(codes) > 0) & (F.size(F.array_except(codes, F.array(*map(F.lit, denied)))) == 0)


def region_enabled(region: Column, enabled: tuple[str, ...]) -> Column:
    """Unknown regions pass; ``uk_wide`` among the enabled ones accepts all."""
    return F.lit(True) if "uk_wide" in enabled else region.isNull() | region.isin(*enabled)


def first_filled(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: F.trim(x) != ""), F.lit(0))


def date_windows(df: DataFrame, id_col: str, first: Column, last: Column, days: int) -> DataFrame:
    """Inclusive windows of so many days that cover a span; the last one ends with it."""
    starts = df.select(id_col, last.alias("_last"), F.explode(F.sequence(first, last, F.expr(f"interval {days} days"))).alias("start"))
    return starts.select(id_col, "start", F.least(F.date_add("start", days - 1), "_last").alias("end"))
