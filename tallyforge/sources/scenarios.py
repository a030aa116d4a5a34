"""Scenario packs: documents, money and the expected outcome of a case, read from JSON and checked in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.vocabulary import COMPONENT_TYPES, DELIVERY_ROLES, MERCHANT_ROLES, PLATFORM_ROLES, SUMMARY_ROLES
from tallyforge.operators.invariants import broken, repeated

#: A pack's layout (fixed values).
COMPONENTS = "array<struct<component_id: string, component_type: string, amount: decimal(18,2), currency: string, source_document_id: string>>"
PACK = f"""scenario_id string, title string, capabilities array<string>,
documents array<struct<document_id: string, role: string, occurred_at: string>>,
components {COMPONENTS},
untrusted_evidence_instructions array<string>,
expected struct<status: string, reconciliation_status: string, residual: decimal(18,2), abstention_reason: string>"""
#: Fixed values.
CAPABILITIES = ("multi_document_reconciliation", "membership_economics", "refund_timeline", "conflicting_authority", "prompt_injection", "required_abstention")
FINDINGS = ("supported", "refuted", "inconclusive")
RECONCILIATIONS = ("exact", "within_source_precision", "within_rounding", "partial", "conflicting", "unresolved")
ROLES = (*SUMMARY_ROLES, *MERCHANT_ROLES, *PLATFORM_ROLES, *DELIVERY_ROLES, "unknown")
PACK_ID, DOCUMENT_ID, MONEY_ID = "^scenario-pack:[a-z0-9-]+$", "^scenario-doc:[a-z0-9-]+$", "^scenario-money:[a-z0-9-]+$"


def read_packs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Packs of a JSON array, or of JSON lines; a file that isn't of a pack's types ends the run."""
    return spark.read.schema(PACK).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


def _all(array: str, rule) -> Column:
    """Whether a rule holds for each entry; a null entry or answer counts as no."""
    return F.forall(array, lambda x: F.coalesce(rule(x), F.lit(False)))


def _once(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def pack_rules() -> dict[str, Column]:
    """What holds for every pack, each decided within its row. Roles are compared in lower case."""
    ids = F.transform("documents", lambda d: d["document_id"])
    expected = F.col("expected")
    has = lambda name: F.array_contains("capabilities", name)
    return {
        "id_has_its_form": F.col("scenario_id").rlike(PACK_ID),
        "title_is_long_enough": F.length("title") >= 12,
        "capabilities_are_known": (F.size("capabilities") > 0) & _all("capabilities", lambda x: x.isin(*CAPABILITIES)),
        "capabilities_are_unique": _once(F.col("capabilities")),
        "documents_are_two_or_more": F.size("documents") >= 2,
        "documents_have_their_form": _all("documents", lambda d: d["document_id"].rlike(DOCUMENT_ID) & F.lower(d["role"]).isin(*ROLES) & d["occurred_at"].rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T")),
        "documents_are_unique": _once(ids),
        "money_is_there": F.size("components") > 0,
        "money_has_its_form": _all("components", lambda c: c["component_id"].rlike(MONEY_ID) & c["component_type"].isin(*COMPONENT_TYPES) & c["amount"].isNotNull() & c["currency"].rlike("^[A-Z]{3}$")),
        "money_names_a_declared_document": _all("components", lambda c: F.array_contains(ids, c["source_document_id"])),
        "outcome_is_known": expected["status"].isin(*FINDINGS) & expected["reconciliation_status"].isin(*RECONCILIATIONS),
        "abstention_fits_the_capability": has("required_abstention") == expected["abstention_reason"].isNotNull(),
        "instructions_fit_the_capability": has("prompt_injection") == (F.coalesce(F.size("untrusted_evidence_instructions"), F.lit(0)) > 0),
    }


def pack_faults(packs: DataFrame) -> DataFrame:
    """(rule, key): rules that packs break, and ids of packs that come more than once. A missing array breaks the rules about it."""
    return broken(packs, "scenario_id", pack_rules()).unionByName(repeated(packs, "scenario_id"))


def uncited_money(packs: DataFrame) -> DataFrame:
    """Money whose document its pack doesn't declare: scenario_id, component_id, source_document_id. Found within the pack, without a join."""
    ids = F.transform("documents", lambda d: d["document_id"])
    lost = F.filter("components", lambda c: ~F.coalesce(F.array_contains(ids, c["source_document_id"]), F.lit(False)))
    return packs.select("scenario_id", F.explode(lost).alias("c")).select("scenario_id", "c.component_id", "c.source_document_id")
