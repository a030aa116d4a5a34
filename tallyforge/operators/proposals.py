"""Batches of evidence for an outside annotator, and what becomes of its proposals.

Proposals come in as rows; nothing here calls a model. Chunks: bundle_id, cohort, chunk_id,
place, text, and where they are known table_id and output_tokens. Proposed regions: region_id, bundle_id, chunk_ids, facts, entities, title, summary,
embedding_text, notes, money (interpretations' texts), relations, conflicts (flags).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.session import materialise

#: How much an issue counts against a region (fixed values); others count OTHER_WEIGHT.
ISSUE_WEIGHTS = {"uncited_amount_conflict": 10, "short_structurally_sparse": 5, "deterministic_fallback": 2, "duplicate_retrieval_text": 2}
OTHER_WEIGHT = 100
ALIAS = r"\b(c\d{4})\b"
NUMBER = r"\d[\d,]*(?:\.\d+)?"


@dataclass(frozen=True)
class BatchPolicy:
    """Limits of a batch; a batch is closed at the target and never exceeds the ceilings.

    `most_output_tokens`: a ceiling for the column `output_tokens` (what a chunk's answer may take) plus `output_base`
    for the batch; none: no such ceiling.
    """

    target_tokens: int = 20_000
    most_tokens: int = 40_000
    least_chunks: int = 2
    most_chunks: int = 96
    most_bundles: int = 32
    most_output_tokens: int | None = None
    output_base: int = 1_200


def input_tokens(text: Column) -> Column:
    """An upper estimate: a token for every three ASCII letters and for every byte beyond."""
    plain = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return (F.ceil(plain / 3) + F.octet_length(text) - plain).cast("bigint")


def output_tokens(facts: Column, entities: Column, components: Column, relations: Column, families: Column) -> Column:
    """What a chunk's answer may take, by how many candidates of each kind it has; null counts as 0. The weights are fixed values."""
    weights = (180, 180, 500, 120, 50)
    return sum((F.coalesce(n, F.lit(0)) * w for n, w in zip((facts, entities, components, relations, families), weights, strict=True)), F.lit(220)).cast("bigint")


class _Walk:
    """One cohort's batches as they are planned: the last closed batch and the open one are all that is held.

    Chunks are tuples (bundle, chunk, tokens, output tokens).
    """

    def __init__(self, policy: BatchPolicy):
        self.policy, self.last, self.open, self.closed = policy, None, [], []

    def fits(self, chunks: list[tuple]) -> bool:
        p = self.policy
        if len(chunks) > p.most_chunks or len({x[0] for x in chunks}) > p.most_bundles or sum(x[2] for x in chunks) > p.most_tokens:
            return False
        return p.most_output_tokens is None or p.output_base + sum(x[3] for x in chunks) <= p.most_output_tokens

    def _close(self, chunks: list[tuple]) -> None:
        if self.last:
            self.closed.append(self.last)
        self.last = chunks

    def add(self, unit: list[tuple]) -> None:
        """Puts a unit (chunks that stay together if a batch can hold them) into the open batch, or closes that first."""
        if not self.fits(unit):
            part: list[tuple] = []
            for chunk in unit:
                if part and not self.fits([*part, chunk]):
                    self._place(part)
                    part = []
                part = [*part, chunk]
            unit = part
        self._place(unit)

    def _place(self, unit: list[tuple]) -> None:
        p, held = self.policy, self.open
        full = len(held) >= p.least_chunks and sum(x[2] for x in held) >= p.target_tokens
        if held and (full or not self.fits([*held, *unit])):
            self._close(held)
            held = []
        self.open = [*held, *unit]

    def finish(self) -> list[list[tuple]]:
        """The batches, the last one repaired where it is too small.

        It joins the one before it, or takes that one's last chunks if these are all of their bundles there and
        both batches are then sound.
        """
        p, before, last = self.policy, self.last, self.open
        if last and before and len(last) < p.least_chunks:
            moved = before[len(before) - (p.least_chunks - len(last)) :]
            counts = Counter(x[0] for x in before)
            rest = before[: len(before) - len(moved)]
            if self.fits([*before, *last]):
                before, last = [*before, *last], []
            elif all(counts[x[0]] == 1 for x in moved) and len(rest) >= p.least_chunks and self.fits(rest) and self.fits([*moved, *last]):
                before, last = rest, [*moved, *last]
        out = [*self.closed, *(x for x in (before, last) if x)]
        self.last, self.open, self.closed = None, [], []
        return out

    def drain(self) -> list[list[tuple]]:
        """The batches that nothing can change any more."""
        out, self.closed = self.closed, []
        return out


def _walked(rows: DataFrame, policy: BatchPolicy, keys: list[str], unit: str, whole: str | None) -> DataFrame:
    """Walks each group of `keys` through sorted rows: batch number, and whether the batch is sound, small (fits, but too few chunks) or unfit.

    Rows of one `unit` stay together if they can; rows of one `whole` too, all units of it as one if that fits.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, name, held = None, None, []
        walk, number = _Walk(policy), 0
        done: list[tuple] = []

        def out(found):
            nonlocal number
            for chunks in found:
                state = "unfit" if not walk.fits(chunks) else "small" if len(chunks) < policy.least_chunks else "sound"
                done.extend((*group, number, place, state, *x[:4]) for place, x in enumerate(chunks))
                number += 1

        def settle():
            """The rows of one `whole` at once if they fit, else by units, in order of each unit's first row."""
            if not held:
                return
            if walk.fits([x[1] for x in held]):
                walk.add([x[1] for x in held])
            else:
                units: dict = {}
                for at, (key, chunk) in enumerate(held):
                    units.setdefault(("alone", at) if key is None else key, []).append(chunk)
                for chunks in units.values():
                    walk.add(chunks)
            held.clear()
            out(walk.drain())

        for batch in batches:
            names = batch[whole] if whole else batch[unit]
            for row in zip(*(batch[k] for k in keys), names, batch[unit], batch.bundle_id, batch.chunk_id, batch.tokens, batch.output_tokens, strict=True):
                now, this, key, chunk = row[: len(keys)], row[len(keys)], row[len(keys) + 1], row[len(keys) + 2 :]
                if now != group:
                    settle()
                    out(walk.finish()) if group else None
                    group, name, number = now, this, 0
                elif this != name:
                    settle()
                    name = this
                held.append((key, chunk))
            yield pd.DataFrame(done, columns=columns)
            done.clear()
        settle()
        if group:
            out(walk.finish())
        yield pd.DataFrame(done, columns=columns)

    columns = [*keys, "number", "at", "state", "bundle_id", "chunk_id", "tokens", "output_tokens"]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "number bigint", "at int", "state string", f"bundle_id {kinds['bundle_id']}", f"chunk_id {kinds['chunk_id']}", "tokens bigint", "output_tokens bigint"])
    return rows.mapInPandas(work, schema)


def plan_batches(chunks: DataFrame, policy: BatchPolicy = BatchPolicy(), shards: int = 64) -> DataFrame:
    """batch_id, bundle_id, chunk_id for every chunk once; batch_id is null for those that fit nowhere.

    A bundle goes into a batch whole if it can; else its tables (chunks of one `table_id`, if there is such a column) do, else each chunk.
    Bundles are filled in order, one after another, which no window can express; so each cohort is
    walked in sorted batches, with two batches and one bundle as the only state. A cohort is dealt to `shards`
    walks by its bundles' hashes, so that a large one isn't one task's work. What is left too small at the end of a walk and can't be
    repaired there is walked once more across cohorts, at most one batch of each walk, dealt by the cohort's hash.
    Null texts count as empty. `output_tokens` is a column of its own if the policy has a ceiling for it.
    """
    has = set(chunks.columns)
    sized = chunks.select(
        F.coalesce("cohort", F.lit("")).alias("cohort"), F.coalesce("bundle_id", F.lit("")).alias("bundle_id") if chunks.schema["bundle_id"].dataType.simpleString() == "string" else F.col("bundle_id"), "chunk_id", "place",
        (F.col("table_id") if "table_id" in has else F.lit(None)).cast("string").alias("table_id"),
        input_tokens(F.coalesce("text", F.lit(""))).alias("tokens"), (F.coalesce("output_tokens", F.lit(0)) if "output_tokens" in has else F.lit(0)).cast("bigint").alias("output_tokens"),
        F.pmod(F.xxhash64("bundle_id"), F.lit(shards)).cast("int").alias("shard"),
    )
    sized = sized.repartition("cohort", "shard").sortWithinPartitions("cohort", "shard", "bundle_id", "place", "chunk_id")
    first = materialise(_walked(sized, policy, ["cohort", "shard"], "table_id", "bundle_id"), "batches")
    small = first.where("state = 'small'").withColumn("deal", F.pmod(F.xxhash64("cohort"), F.lit(shards)).cast("int"))
    small = small.withColumn("unit", F.concat_ws("/", "cohort", "shard", "number")).select("deal", "cohort", "shard", "number", "unit", "bundle_id", "chunk_id", "tokens", "output_tokens", "at")
    again = _walked(small.repartition("deal").sortWithinPartitions("deal", "cohort", "shard", "number", "at"), policy, ["deal"], "unit", None)
    named = lambda frame, *parts: frame.select(F.when(F.col("state") == "sound", F.concat_ws("/", *parts, "number")).alias("batch_id"), "bundle_id", "chunk_id")
    return named(first.where("state <> 'small'"), "cohort", "shard").unionByName(named(again, F.lit("*"), "deal"))


def coverage_faults(chunks: DataFrame, regions: DataFrame) -> DataFrame:
    """Chunks that proposals don't name exactly once, and named chunks of another bundle: bundle_id, chunk_id, fault."""
    named = regions.select("bundle_id", F.explode("chunk_ids").alias("chunk_id")).groupBy("bundle_id", "chunk_id").agg(F.count("*").alias("times"))
    both = chunks.select("bundle_id", "chunk_id").withColumn("known", F.lit(True)).join(named, ["bundle_id", "chunk_id"], "full_outer")
    fault = F.when(F.col("known").isNull(), "foreign_chunk").when(F.col("times").isNull(), "missing_chunk").when(F.col("times") > 1, "repeated_chunk")
    return both.withColumn("fault", fault).where("fault is not null").select("bundle_id", "chunk_id", "fault")


def span_faults(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Facts (chunk_id, start, end, value) whose text isn't at their place."""
    joined = facts.join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    there = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return joined.where(~F.coalesce(there == F.col("value"), F.lit(False))).select("chunk_id", "start", "end", "value")


def audit(regions: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds to each region its issues, in order (names and rules are fixed values).

    `sources` has region_id, source_text, source_facts, source_entities: what the region's chunks hold. Null arrays
    count as empty, null texts as empty text. `notes` is an array of texts.
    """
    held = regions.join(sources, "region_id", "left")
    some = lambda name: F.coalesce(F.col(name), F.array().cast("array<string>"))
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    lacks = lambda a, b: F.size(F.array_except(a, b)) > 0
    texts = F.concat_ws("\n", "title", "summary", "embedding_text")
    aliases = F.filter(F.regexp_extract_all(texts, F.lit(ALIAS), F.lit(1)), lambda x: ~text("source_text").contains(x))
    numbers = lambda x: F.transform(F.regexp_extract_all(x, F.lit(f"({NUMBER})"), F.lit(1)), lambda y: F.replace(y, F.lit(","), F.lit("")))
    says_something = ("facts", "entities", "money", "relations", "conflicts", "notes")
    sparse = (sum((F.size(some(x)) for x in says_something), F.lit(0)) == 0) & (F.size(F.filter(F.split(text("summary"), r"\s+"), lambda x: x != "")) < 8)
    fallback = text("title").startswith("Preserved ") | F.exists(some("money"), lambda x: x.contains("Deterministic fallback"))
    checks = (
        ("temporary_source_alias", F.size(aliases) > 0),
        ("missing_fact_candidate", lacks(some("source_facts"), some("facts"))),
        ("missing_entity_candidate", lacks(some("source_entities"), some("entities"))),
        ("unsupported_fact_candidate", lacks(some("facts"), some("source_facts"))),
        ("unsupported_entity_candidate", lacks(some("entities"), some("source_entities"))),
        ("duplicate_retrieval_text", F.trim(text("summary")) == F.trim(text("embedding_text"))),
        ("deterministic_fallback", fallback),
        ("short_structurally_sparse", sparse),
        ("uncited_amount_conflict", F.array_contains(some("conflicts"), "amount_scope_conflict") & lacks(numbers(F.array_join(some("notes"), " ")), numbers(text("source_text")))),
    )
    found = F.filter(F.array(*[F.when(check, F.lit(name)) for name, check in checks]), lambda x: x.isNotNull())
    return held.withColumn("issues", found)


def repair(audited: DataFrame) -> DataFrame:
    """Drops what the sources don't support, restores what they hold, and takes temporary aliases out of texts."""
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\s*\(?\bc\d{4}\b\)?", ""), r"\s+([,.;:])", "$1"))
    keep = lambda mine, source: F.array_sort(F.array_union(F.array_intersect(mine, source), source))
    named = F.array_contains("issues", "temporary_source_alias")
    texts = {x: F.when(named, clean(F.col(x))).otherwise(F.col(x)) for x in ("title", "summary", "embedding_text")}
    return audited.withColumns({"facts": keep(F.col("facts"), F.col("source_facts")), "entities": keep(F.col("entities"), F.col("source_entities"))} | texts)


def quality_score(issues: Column) -> Column:
    """(weight, number) of issues; less is better."""
    weight = lambda x: F.coalesce(*[F.when(x == name, w) for name, w in ISSUE_WEIGHTS.items()], F.lit(OTHER_WEIGHT))
    return F.struct(F.aggregate(issues, F.lit(0), lambda a, x: a + weight(x)).alias("weight"), F.size(issues).alias("number"))


def better_retries(base: DataFrame, retry: DataFrame) -> DataFrame:
    """For each bundle whether its retry is strictly better: bundle_id, use_retry. Both have bundle_id and issues."""
    total = lambda frame, name: frame.withColumn("s", quality_score(F.col("issues"))).groupBy("bundle_id").agg(F.struct(F.sum("s.weight").alias("w"), F.sum("s.number").alias("n")).alias(name))
    return total(base, "old").join(total(retry, "new"), "bundle_id").select("bundle_id", (F.col("new") < F.col("old")).alias("use_retry"))


def unfinished(planned: DataFrame, done: DataFrame, calls: int | None = None) -> DataFrame:
    """Batches still to do, the first `calls` of them if given: a restarted run goes on where it stopped."""
    left = planned.select("batch_id").where("batch_id is not null").distinct().join(done.select("batch_id"), "batch_id", "left_anti")
    return left.orderBy("batch_id").limit(calls) if calls is not None else left
