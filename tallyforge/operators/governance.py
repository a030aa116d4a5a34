"""Guardrails, routing of questions, privacy checks and session context, as columns over question tables."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a question must not ask for (case aside), by the reason that is given.
PROMPT_EXTRACTION = (
    r"\b(?:give|show|reveal|print|display|share|provide|output|repeat|recite|tell\s+me)\b.{0,60}\b(?:your|the)\b.{0,30}\b(?:full|complete|entire|exact|verbatim|hidden|internal)?\s*(?:system|developer|assistant|hidden|internal)\s*(?:prompt|instructions?|message|policy|policies|rules?)\b",
    r"\b(?:what|where|which)\b.{0,40}\b(?:system|developer|hidden|internal)\s*(?:prompt|instructions?|message|policy|policies|rules?)\b",
    r"\b(?:ignore|disregard|forget|override|bypass|replace|jailbreak)\b.{0,100}\b(?:previous|prior|above|system|developer|assistant|instruction|policy|rule)s?\b",
    r"\b(?:repeat|quote|recite|copy|print)\b.{0,60}\b(?:above|hidden|system|developer|prompt|instructions?)\b.{0,30}\b(?:verbatim|exactly|word[- ]for[- ]word)?\b",
    r"\b(?:reveal|show|give|print|list|expose|dump|tell\s+me)\b.{0,70}\b(?:api\s*keys?|access\s*tokens?|secret(?:s|\s+keys?)?|credentials?|environment\s+variables?|tool\s+definitions?|function\s+schemas?)\b",
    r"\b(?:dan\s+mode|developer\s+mode|unfiltered|uncensored|unrestricted|no\s+guardrails?|without\s+(?:limits|restrictions))\b",
)
ARBITRARY_QUERY = (
    r"\b(?:MATCH|MERGE|CREATE)\s*\(",
    r"\bCALL\s+(?:DBMS|APOC|DB)\.",
    r"\b(?:DETACH\s+)?DELETE\s+[A-Za-z_]",
    r"\b(?:DROP|TRUNCATE|ALTER)\s+(?:DATABASE|TABLE|INDEX|CONSTRAINT)\b",
    r"\b(?:SELECT|INSERT|UPDATE|DELETE)\b.{0,100}\b(?:FROM|INTO|SET|WHERE)\b",
    r"\b(?:run|execute|perform|send)\b.{0,40}\b(?:cypher|neo4j|sql|database)\b",
)
#: The first five of these are refused even if the question also has a word of the domain.
OFF_SCOPE = (
    r"\b(?:write|draft|create|generate|improve|edit|rewrite|review|tailor|format)\b.{0,60}\b(?:resume|curriculum\s+vitae|cv|cover\s+letter|linkedin)\b",
    r"\b(?:resume|curriculum\s+vitae|cv|cover\s+letter|linkedin)\b.{0,60}\b(?:write|draft|create|generate|improve|edit|rewrite|review|tailor)\b",
    r"\b(?:write|generate|create|build|debug|fix|review|refactor|implement|explain)\b.{0,60}\b(?:code|script|program|python|javascript|typescript|react|sql|api|function|class|software|application|website)\b",
    r"\b(?:code|programming|software\s+development)\b.{0,60}\b(?:write|generate|create|build|debug|fix|review|refactor|implement)\b",
    r"\b(?:write|draft|compose|generate|create)\b.{0,50}\b(?:essay|story|poem|song|email|letter|blog\s+post)\b",
    r"\b(?:translate|translation|paraphrase)\b.{0,50}\b(?:this|text|paragraph|document|sentence|into|from)\b",
    r"\b(?:plan|book|recommend|organize)\b.{0,60}\b(?:trip|travel|vacation|flight|hotel|itinerary)\b",
    r"\b(?:solve|answer|do|complete|write)\b.{0,50}\b(?:homework|exam|assignment|quiz|thesis)\b",
    r"\b(?:give|provide|offer|seek|need|want|request)\b.{0,50}\b(?:medical|health|symptom|diagnos|treatment|medication|legal|lawyer|lawsuit|contract\s+advice|tax\s+advice)\b",
    r"\b(?:medical|health|symptom|diagnos|treatment|medication|legal|lawyer|lawsuit|contract\s+advice|tax\s+advice)\b.{0,50}\b(?:advice|help|diagnos|treatment)\b",
    r"\b(?:give|provide|write|create|recommend|suggest)\b.{0,40}\b(?:recipe|cooking|meal\s+plan|workout|fitness\s+plan)\b",
)
ALWAYS_OFF_SCOPE = 5
#: Words of the domain.
IN_SCOPE = (
    r"\b(?:order|invoice|receipt|meal|food|restaurant|merchant|outlet|item|price|cost|fee|delivery|discount|promotion|tax|payment|refund|spend(?:ing)?|membership|subscription|platform|"
    r"swiggy|zomato|biryani|grocery|instamart|history|reconcile|reconciliation|elasticity|substitution|anomaly|financial|economic|evidence|document|transaction|charge|tip|coupon|total)\b"
)
#: Keywords that a read-only query text can't have.
WRITES = r"\b(?:CREATE|MERGE|DELETE|DETACH|SET|REMOVE|DROP)\b"

#: What a public payload can't hold.
EMAIL, LONG_NUMBER, CONTENT_HASH = r"\b[^\s@]+@[^\s@]+\.[^\s@]+\b", r"(?<!\d)\d{10,}(?!\d)", r"\b[0-9a-fA-F]{64}\b"
#: Words by which a question's component type is known; the first group that has a match counts.
COMPONENT_WORDS = (
    ("platform_fee", ("platform fee", "platform-fee")),
    ("delivery_charge", ("delivery fee", "delivery charge")),
    ("packing_charge", ("packing fee", "packing charge")),
    ("handling_fee", ("handling fee", "handling charge")),
    ("coupon_discount", ("discount", "promotion", "coupon")),
    ("tax", ("tax", "gst")),
    ("refund", ("refund", "refunded")),
)
PLATFORM_WORDS = ("swiggy", "zomato")
#: Names that a public payload can't have.
FORBIDDEN_NAMES = ("address", "document_id", "email", "fssai", "gstin", "invoice_id", "message_id", "order_id", "pan", "payment_reference", "phone", "sha256", "source_hash")
#: The data files that a repository may have, and the endings of private files.
PUBLIC_DATA = ("data/public/README.md", "data/evals/README.md")
PRIVATE_ENDINGS = (".eml", ".key", ".mbox", ".pdf", ".pem", ".zip")


@F.udf(T.StringType(), useArrow=True)
def _normal_form(text):
    """NFKC; null for null and if a control or format character is in it."""
    if text is None:
        return None
    text = unicodedata.normalize("NFKC", text)
    if any(unicodedata.category(c) in ("Cc", "Cf") and c not in "\n\r\t" for c in text):
        return None
    return " ".join(text.split())


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns is found, case aside; one expression, so generated code stays small."""
    return text.rlike("(?i)" + "|".join(f"(?:{x})" for x in patterns))


def clean_question(text: Column) -> Column:
    """The question in compatibility form with single spaces; null where a control or format character makes it unfit."""
    plain = text.rlike(r"^[\x20-\x7E\s]*$") & ~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
    # Python sees every row before the choice is made, so plain texts are handed over as null.
    return F.when(plain, F.trim(F.regexp_replace(text, r"\s+", " "))).otherwise(_normal_form(F.when(~plain, text)))


def refusal(question: Column) -> Column:
    """Why a cleaned question is refused, null if it isn't."""
    off = _any(question, OFF_SCOPE) & (_any(question, OFF_SCOPE[:ALWAYS_OFF_SCOPE]) | ~question.rlike("(?i)" + IN_SCOPE))
    return (
        F.when(question.isNull(), "control_or_format_character")
        .when(_any(question, PROMPT_EXTRACTION), "prompt_or_secret_extraction")
        .when(_any(question, ARBITRARY_QUERY), "arbitrary_query")
        .when(off, "off_scope")
        .when(question == "", "empty")
    )


def _has(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is in the text."""
    return text.rlike("|".join(re.escape(x) for x in words))


def intent(question: Column) -> Column:
    """One of six intents; rules are tried in order. Their words are fixed values."""
    q = F.lower(F.trim(F.regexp_replace(question, r"\s+", " ")))
    starts = q.startswith("find ") | q.startswith("search ") | q.startswith("locate ")
    return (
        F.when(_has(q, ("offset", "comparable", "multi-hop")) & _has(q, ("discount", "fee", "price", "meal")), "multi_hop_economic")
        .when(_has(q, ("prove", "show evidence", "source for")), "evidence_request")
        .when(starts | _has(q, ("containing", "invoice rows")), "lexical_lookup")
        .when(_has(q, ("felt ", "seemed ", "which orders")), "semantic_discovery")
        .when(_has(q, ("how much", "total fee", "total spend", "did i pay", "sum of")), "financial_aggregation")
        .otherwise("exact_graph")
    )


def templates(question: Column) -> Column:
    """The governed templates that answer a question. The words are fixed values."""
    q, kind = F.lower(F.trim(F.regexp_replace(question, r"\s+", " "))), intent(question)
    names = lambda *x: F.array(*[F.lit(y) for y in x])
    return (
        F.when(q.contains("delivery") & _has(q, ("who", "person", "times", "delivered")), names("delivery_mention_count"))
        .when(_has(q, ("price", "cost")) & _has(q, ("ago", "history", "year", "same")), names("merchant_item_price_history"))
        .when(kind == "financial_aggregation", names("financial_component_sum"))
        .when(kind == "evidence_request", names("evidence_for_money_component"))
        .when(kind == "lexical_lookup", names("fulltext_evidence"))
        .when(kind == "semantic_discovery", names("fulltext_evidence", "order_reconstruction"))
        .when(kind == "multi_hop_economic", names("merchant_item_price_history", "financial_component_sum"))
        .otherwise(names("merchant_order_count"))
    )


def slots(question: Column) -> Column:
    """The slots that a question names surely: a struct of platform and component_type."""
    q = F.lower(F.trim(F.regexp_replace(question, r"\s+", " ")))
    platform = F.coalesce(*[F.when(q.rlike(rf"\b{x}\b"), x) for x in PLATFORM_WORDS])
    kind = F.coalesce(*[F.when(_has(q, words), name) for name, words in COMPONENT_WORDS])
    return F.struct(platform.alias("platform"), kind.alias("component_type"))


def contextual_question(previous: Column, current: Column, limit: int = 500) -> Column:
    """The new question whole, after as much of the previous one as the limit leaves."""
    marker = " Follow-up: "
    room = F.greatest(F.lit(0), F.lit(limit - len(marker)) - F.length(current))
    joined = F.concat(F.left(previous, room), F.lit(marker), current)
    return F.when(previous.isNull() | (F.length(current) >= limit), F.left(current, F.lit(limit))).otherwise(joined)


def carry_slots(turns: DataFrame, session: str, order: str, names: list[str]) -> DataFrame:
    """Each slot's last value up to a turn: what a turn doesn't name stays as it was."""
    so_far = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumns({name: F.last(name, ignorenulls=True).over(so_far) for name in names})


def last_turns(turns: DataFrame, session: str, order: str, n: int = 8) -> DataFrame:
    """The last n turns of each session."""
    place = Window.partitionBy(session).orderBy(F.desc(order))
    return turns.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n).drop("place")


def private_columns(frame: DataFrame) -> list[str]:
    """Names of columns, nested ones too, that a public frame can't have."""
    def walk(kind, path):
        found = []
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                name = field.name.lower()
                here = f"{path}.{field.name}" if path else field.name
                found += [here] if name in FORBIDDEN_NAMES or "private" in name or name.startswith("raw_") else walk(field.dataType, here)
        elif isinstance(kind, T.ArrayType):
            found += walk(kind.elementType, path)
        elif isinstance(kind, T.MapType):
            found += walk(kind.valueType, path)
        return found

    return walk(frame.schema, "")


def private_values(frame: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose string columns hold something like an email, a long number or a content hash: key, column, kind."""
    kinds = (("email", EMAIL), ("long_number", LONG_NUMBER), ("content_hash", CONTENT_HASH))
    checks = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(c).rlike(p).alias("found")) for c in columns for k, p in kinds])
    return frame.select(key, F.explode(checks).alias("x")).where("x.found").select(key, "x.column", "x.kind")


def repository_fault(path: Column) -> Column:
    """Why a file path can't be tracked in public, null if it can: data files, private endings (case aside) and environment files."""
    path = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")
    name = F.substring_index(path, "/", -1)
    return (
        F.when(path.startswith("data/") & ~path.isin(*PUBLIC_DATA), "data_file")
        .when(path.rlike("(?i)(?:" + "|".join(map(re.escape, PRIVATE_ENDINGS)) + r")\z"), "private_file")
        .when((name != ".env.example") & ((name == ".env") | name.startswith(".env.")), "secret_file")
    )
