"""Responses of an outside annotator: the JSON object is recovered from what it wrote, then held against its batch.

Batches are bounded by their plan, so a batch's chunks are one row's array and every rule is an expression over that
row; the only shuffle is by batch. The first broken rule, in the order below, is the reason a response is set aside.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The keys and kinds of a response.
RESPONSE = """struct<batch_id: string, covered_source_chunk_ids: array<string>, covered_money_component_ids: array<string>, regions: array<struct<
bundle_id: string, source_chunk_ids: array<string>,
candidate_facts: array<struct<source_chunk_id: string, source_span_start: int, source_span_end: int, raw_value_private: string>>,
entity_candidates: array<struct<source_chunk_id: string, raw_value_private: string>>,
money_interpretations: array<struct<source_chunk_id: string, source_component_id: string>>,
relation_candidates: array<struct<subject_private: string, object_private: string, evidence_chunk_ids: array<string>>>>>, broken: string>"""
#: The lists of a region that may be left out, and how many items each may have.
LISTS = {"candidate_facts": 64, "entity_candidates": 32, "money_interpretations": 64, "relation_candidates": 32}
#: Ends of relations that needn't occur in the evidence.
SYMBOLIC_ENDS = ("ORDER", "DOCUMENT", "MESSAGE")
#: What is wrong with a response, or with its first wrong region, in order of precedence.
REASONS = ("invalid_model_json", "invalid_model_schema", "batch_id_mismatch", "coverage_manifest_mismatch", "incomplete_batch_coverage", "money_coverage_manifest_mismatch", "incomplete_money_component_coverage")
REGION_REASONS = ("cross_bundle_region", "bundle_id_mismatch", "unsupported_fact_candidate", "unsupported_entity_candidate", "unsupported_money_interpretation", "unsupported_relation_candidate")


@F.udf(T.StringType(), useArrow=True)
def recovered(raw):
    """The first JSON object in a text that has batch_id and regions, with sorted keys and no spaces; null if there is none.

    Objects start at any brace, inside others too. A text without both keys behind a brace isn't tried from there.
    """
    if raw is None:
        return None
    last = min(raw.rfind('"batch_id"'), raw.rfind('"regions"'))
    decode, at = json.JSONDecoder().raw_decode, raw.find("{")
    while 0 <= at < last:
        try:
            found, _ = decode(raw, at)
        except (ValueError, RecursionError):
            found = None
        if isinstance(found, dict) and "batch_id" in found and "regions" in found:
            return json.dumps(found, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        at = raw.find("{", at + 1)
    return None


def _any(items: Column, wrong) -> Column:
    """Whether one of an array's items is wrong, an item for which that can't be told included."""
    return F.exists(items, lambda x: F.coalesce(wrong(x), F.lit(True)))


def _has_nulls(array: Column) -> Column:
    return array.isNull() | F.exists(array, lambda x: x.isNull())


def _schema_fault(r: Column, canonical: Column) -> Column:
    """Whether a parsed response lacks a field, has one of another kind, an unknown key, or an empty list where one is needed."""
    part = lambda x, *names: sum((x[n].isNull().cast("int") for n in names), F.lit(0)) > 0
    region = lambda x: (
        x.isNull() | part(x, "bundle_id", "source_chunk_ids") | sum(((F.size(x[n]) > most).cast("int") for n, most in LISTS.items()), F.lit(0)).cast("boolean")
        | _has_nulls(x["source_chunk_ids"]) | (F.size(x["source_chunk_ids"]) == 0)
        | _any(x["candidate_facts"], lambda y: part(y, "source_chunk_id", "source_span_start", "source_span_end", "raw_value_private") | (y["source_span_start"] < 0) | (y["source_span_end"] <= y["source_span_start"]))
        | _any(x["entity_candidates"], lambda y: part(y, "source_chunk_id", "raw_value_private"))
        | _any(x["money_interpretations"], lambda y: part(y, "source_chunk_id", "source_component_id"))
        | _any(x["relation_candidates"], lambda y: part(y, "subject_private", "object_private", "evidence_chunk_ids") | _has_nulls(y["evidence_chunk_ids"]) | (F.size(y["evidence_chunk_ids"]) == 0))
    )
    known = F.array(*[F.lit(x) for x in ("batch_id", "covered_money_component_ids", "covered_source_chunk_ids", "regions")])
    whole = r.isNull() | r["broken"].isNotNull() | part(r, "batch_id", "covered_source_chunk_ids", "covered_money_component_ids", "regions") | (F.size(F.array_except(F.json_object_keys(canonical), known)) > 0)
    lists = _has_nulls(r["covered_source_chunk_ids"]) | _has_nulls(r["covered_money_component_ids"]) | (F.size(r["covered_source_chunk_ids"]) == 0) | (F.size(r["regions"]) == 0)
    return F.coalesce(whole | lists | _any(r["regions"], region), F.lit(True))


def _region_fault(region: Column, chunks: Column) -> Column:
    """The first broken rule of a region; `chunks`: a map of the batch's chunks by id."""
    ids = region["source_chunk_ids"]
    source = lambda x: F.try_element_at(chunks, x)
    bundles = F.array_distinct(F.transform(ids, lambda x: source(x)["bundle_id"]))
    inside = lambda x: F.array_contains(ids, x)
    length = lambda x: x["source_span_end"] - x["source_span_start"]
    fact = lambda x: ~inside(x["source_chunk_id"]) | (x["source_span_end"] > F.length(source(x["source_chunk_id"])["text"])) | (F.substring(source(x["source_chunk_id"])["text"], x["source_span_start"] + 1, length(x)) != x["raw_value_private"])
    entity = lambda x: ~inside(x["source_chunk_id"]) | ~source(x["source_chunk_id"])["text"].contains(x["raw_value_private"])
    money = lambda x: ~inside(x["source_chunk_id"]) | ~F.array_contains(source(x["source_chunk_id"])["component_ids"], x["source_component_id"])
    loose = lambda end, x: ~end.isin(*SYMBOLIC_ENDS) & ~F.exists(x["evidence_chunk_ids"], lambda y: source(y)["text"].contains(end))
    relation = lambda x: (F.size(F.array_except(x["evidence_chunk_ids"], ids)) > 0) | loose(x["subject_private"], x) | loose(x["object_private"], x)
    checks = (
        F.size(bundles) != 1,
        bundles[0] != region["bundle_id"],
        _any(region["candidate_facts"], fact),
        _any(region["entity_candidates"], entity),
        _any(region["money_interpretations"], money),
        _any(region["relation_candidates"], relation),
    )
    return F.coalesce(*[F.when(check, F.lit(name)) for name, check in zip(REGION_REASONS, checks, strict=True)])


def validate(responses: DataFrame, chunks: DataFrame) -> DataFrame:
    """batch_id, status, reason, response_sha256, regions of each response (batch_id, raw) to a batch.

    `chunks`: batch_id, place, bundle_id, chunk_id, text, component_ids, each chunk once; their order in a batch is that of `place`, of a chunk's
    components that of the array. Null text is empty, null components none. Regions are null unless accepted; a response to a batch that isn't known
    has the reason batch_id_mismatch. A missing or null raw text is invalid_model_json.
    """
    one = F.struct("place", "chunk_id", "bundle_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("component_ids", F.array().cast("array<string>")).alias("component_ids"))
    batches = chunks.groupBy("batch_id").agg(F.array_sort(F.collect_list(one)).alias("chunks"))
    # The parsed object is used many times over; a join's input is worked out once for it.
    parsed = responses.select("batch_id", recovered(F.col("raw")).alias("canonical")).select("batch_id", "canonical", F.from_json("canonical", RESPONSE, {"columnNameOfCorruptRecord": "broken"}).alias("r"))
    regions = "transform(r.regions, x -> named_struct('bundle_id', x.bundle_id, 'source_chunk_ids', x.source_chunk_ids, " + ", ".join(f"'{n}', coalesce(x.{n}, array())" for n in LISTS) + "))"
    parsed = parsed.withColumn("r", F.col("r").withField("regions", F.expr(regions)))
    both = parsed.join(batches, "batch_id", "left").withColumn("expected", F.expr("transform(chunks, x -> x.chunk_id)")).withColumn("money", F.expr("flatten(transform(chunks, x -> x.component_ids))"))
    named = F.sort_array(F.flatten(F.expr("transform(r.regions, x -> x.source_chunk_ids)")))
    interpreted = F.sort_array(F.flatten(F.expr("transform(r.regions, x -> transform(x.money_interpretations, y -> y.source_component_id))")))
    r, by_id = F.col("r"), F.map_from_entries(F.expr("transform(chunks, x -> struct(x.chunk_id, x))"))
    checks = (
        F.col("canonical").isNull(),
        _schema_fault(r, F.col("canonical")),
        F.col("chunks").isNull() | (r["batch_id"] != F.col("batch_id")),
        r["covered_source_chunk_ids"] != F.col("expected"),
        named != F.sort_array("expected"),
        r["covered_money_component_ids"] != F.col("money"),
        interpreted != F.sort_array("money"),
    )
    whole = F.coalesce(*[F.when(F.coalesce(check, F.lit(False)), F.lit(name)) for name, check in zip(REASONS, checks, strict=True)])
    first = F.get(F.filter(F.transform(r["regions"], lambda x: _region_fault(x, F.col("by_id"))), lambda x: x.isNotNull()), F.lit(0))
    judged = both.withColumn("whole", whole).withColumn("by_id", F.when(F.col("whole").isNull(), by_id)).withColumn("reason", F.coalesce("whole", F.when(F.col("by_id").isNotNull(), first)))
    fine = F.col("reason").isNull()
    return judged.select(
        "batch_id",
        F.when(fine, "accepted").otherwise("quarantined").alias("status"),
        "reason",
        F.when(fine, F.sha2(F.col("canonical").cast("binary"), 256)).alias("response_sha256"),
        F.when(fine, r["regions"]).alias("regions"),
    )
