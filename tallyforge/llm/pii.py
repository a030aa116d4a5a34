r"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and
identifier cues. From each anchor a small parser expands to both sides and validates what it
found. Base kinds and their rules (leftmost, not overlapping within a kind, failing matches
dropped):

email  `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`
ip     four dotted numbers of at most 255
card   12 to 19 digits, single spaces or hyphens between them, right Luhn sum
phone  a plus sign and 9 to 15 digits with spaces, dots, brackets or hyphens

Added kinds: url (a scheme and what follows), secret (a cue like `token` with = or : and a value
of 16 or more letters and digits, digits among them), iban (right check digits), account (a cue
and 6 to 17 digits) and address (house number, capitalised street name, street word).

Offsets are code points, ends exclusive. Null or empty text has no spans. Rows, repeated or not,
are judged one by one; only the two named columns are read. An empty table gives an empty result. A
very long text is read whole by the task that has it; parsers walk back over words and not characters
of a fixed number, so no length hides a span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.batches import id_and_text, map_batches, pieces, texts
from tallyforge.session import table

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "secret", "iban", "account", "address")
KINDS = BASE + ADDED
ORDER = {kind: i for i, kind in enumerate(KINDS)}

#: Anchors of each kind; letters match in either case.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "s3://", "mailto:")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "private_key")
ACCOUNT_CUES = ("account", "acct", "routing", "sort code", "passport", "ssn")
STREET_WORDS = ("street", "avenue", "road", "boulevard", "lane", "drive", "square", "straße", "strasse")
REDACTED = {kind: f"[{kind.upper()}]" for kind in KINDS}

_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'|]+")
_SECRET = re.compile(r"\s?[=:]\s?([\"']?)([A-Za-z0-9_+/=.-]{16,})")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?: (?:number|no\.?|nr\.?))?\s?[:#=]?\s?#?([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
_HOUSE, _NAME = re.compile(r"(?<![\w.])[0-9]{1,5}[A-Za-z]?\Z"), re.compile(r"[A-Z][\w.'-]*")


def luhn(digits: str) -> bool:
    """Whether the Luhn sum of the digits ends in 0."""
    odd = [int(x) for x in digits[-1::-2]]
    even = [2 * int(x) for x in digits[-2::-2]]
    return (sum(odd) + sum(x - 9 * (x > 9) for x in even)) % 10 == 0


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark in "@+0123456789":
        found.add_word(mark, (mark if mark in "@+" else "digit", 1))
    for kind, cues in (("scheme", SCHEMES), ("secret", SECRET_CUES), ("account", ACCOUNT_CUES), ("street", STREET_WORDS)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


class Finder:
    """Finds spans in texts; holds the automaton."""

    def __init__(self) -> None:
        self.anchors = _automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind."""
        out: list[tuple[str, int, int]] = []
        ends = dict.fromkeys(KINDS, 0)
        run = -2
        for last, (anchor, size) in self.anchors.iter(text):
            at = last - size + 1
            if anchor == "digit":
                inside, run = at == run + 1, at
                self._number(text, at, inside, ends, out)
            elif anchor == "@":
                self._email(text, at, ends, out)
            elif anchor == "+":
                self._phone(text, at, ends, out)
            elif anchor == "scheme":
                self._url(text, at, last + 1, ends, out)
            elif anchor == "secret":
                self._cued("secret", _SECRET, 2, text, last + 1, ends, out)
            elif anchor == "account":
                self._cued("account", _ACCOUNT, 1, text, last + 1, ends, out)
            else:
                self._address(text, at, last + 1, ends, out)
        return sorted(out, key=lambda x: (x[1], ORDER[x[0]], x[2]))

    @staticmethod
    def _email(text, at, ends, out):
        begin, least = at, ends["email"]
        while begin > least and text[begin - 1] in _LOCAL_SET:
            begin -= 1
        if begin < at and at >= least and (domain := _DOMAIN.match(text, at + 1)):
            out.append(("email", begin, domain.end()))
            ends["email"] = domain.end()

    @staticmethod
    def _phone(text, at, ends, out):
        if at >= ends["phone"] and (found := _PHONE.match(text, at)):
            ends["phone"] = found.end()
            if 9 <= sum(c.isdigit() for c in found.group()) <= 15:
                out.append(("phone", at, found.end()))

    @staticmethod
    def _number(text, at, inside, ends, out):
        if (not inside or at == ends["ip"]) and at >= ends["ip"] and (found := _IP.match(text, at)):
            ends["ip"] = found.end()
            if all(int(x) <= 255 for x in (y.lstrip("0")[:4] or "0" for y in found.group().split("."))):
                out.append(("ip", at, found.end()))
        if at >= ends["card"] and (found := _CARD.match(text, at)):
            ends["card"] = found.end()
            digits = re.sub("[ -]", "", found.group()) if found.end() - at < 40 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", at, found.end()))
        # Two check digits stand behind a country's two letters.
        if not inside and at >= 2 and at - 2 >= ends["iban"] and text[at - 2 : at].isupper() and text[at - 3 : at - 2].isalnum() is False and (found := _IBAN.match(text, at - 2)):
            compact = found.group().replace(" ", "")
            if 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1:
                out.append(("iban", at - 2, found.end()))
                ends["iban"] = found.end()

    @staticmethod
    def _url(text, at, body, ends, out):
        if at >= ends["url"] and not (at and text[at - 1].isalnum()) and (found := _URL.match(text, body)):
            end = body + len(found.group().rstrip(".,;:!?)]}"))
            if end > body:
                out.append(("url", at, end))
                ends["url"] = end

    @staticmethod
    def _cued(kind, pattern, group, text, after, ends, out):
        if (found := pattern.match(text, after)) and found.start(group) >= ends[kind]:
            value = found.group(group)
            if kind != "secret" or any(c.isdigit() for c in value):
                out.append((kind, found.start(group), found.end(group)))
                ends[kind] = found.end(group)

    @staticmethod
    def _address(text, at, end, ends, out):
        if text[end : end + 1].isalnum():
            return
        # Back over up to four names, each followed by one white space, to a house number and a space.
        stop, low = at, ends["address"]
        for names in range(5):
            if stop <= low or not text[stop - 1].isspace():
                return
            last = begin = stop - 1
            while begin > low and not text[begin - 1].isspace():
                begin -= 1
            if not _NAME.fullmatch(text, begin, last):
                break
            stop = begin
        else:
            return
        if names and text[last] == " " and (found := _HOUSE.search(text, max(begin, last - 6), last)):
            out.append(("address", found.start(), end))
            ends["address"] = end


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones as one, named by the first) replaced by its kind's mark."""
    out, at = [], 0
    for kind, begin, end in spans:
        if begin >= at:
            out += [text[at:begin], REDACTED[kind]]
        at = max(at, end)
    return "".join(out) + text[at:]


def _written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found (array of kind, start, end), base and spans (the base ones and all, written kind:start:end)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        finder = Finder()
        for batch in pieces(batches, "text"):
            found = [finder.spans(x) for x in texts(batch)]
            yield {
                "doc_id": batch.column("doc_id"),
                "found": [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found],
                "base": [_written(s for s in x if s[0] in BASE) for x in found],
                "spans": [_written(x) for x in found],
            }

    frame = id_and_text(docs, id_col, text_col)
    kind = frame.schema["doc_id"].dataType.simpleString()
    return map_batches(frame, work, f"doc_id {kind}, found array<struct<kind: string, start: bigint, `end`: bigint>>, base string, spans string")


def redacted(text_col: str = "text") -> Column:
    """A column of whole texts with every span replaced; null stays null."""

    @F.pandas_udf("string")
    def clean(column):
        finder = Finder()
        return column.map(lambda x: redact(x, finder.spans(x)), na_action="ignore")

    return clean(F.col(text_col).cast("string"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id", *map(count, BASE), F.sha2("base", 256).alias("base_sha256"), "spans", *map(count, ADDED)
    )
