import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm.pii import BASE, Finder, find, luhn, redact, redacted

FINDER = Finder()
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    """The contract's patterns over the whole text."""
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], list(RULES).index(x[0])))


def base(text):
    return [x for x in FINDER.spans(text) if x[0] in BASE]


CASES = [
    "", "a@b.c..d x@y", "a@b@c.d", "a@b.c@d.e", "x@y.z.w@q.r", "1.2.3.4.5.6.7.8", "999.1.1.1", "1.2.3.256 0001.2.3.4", "4111 1111 1111 1111",
    "4111-1111-1111-1112", "+1 (499) 555-6503", "++12 345678901", "+1", "+12 ", "4111111111111111.1.2.3", "é 1.2.3.4@5.6", "1 2 3 4 5 6 7 8 9 0 1 2 3",
    "+49 4111 1111 1111 1111", "1.2.3", "5" * 50_000, "@" * 1000, "+" * 1000, "a" * 100_000 + "@x.y", "a.b@c.d.e-f_g", "١٢.1.1.1",
]


@pytest.mark.parametrize("text", CASES)
def test_base_cases(text):
    assert base(text) == brute(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aZ0125@.+-() %é\n", max_size=60))
def test_base_fuzz(text):
    assert base(text) == brute(text)


def test_added_kinds():
    text = 'see https://a.example/x?y=1. token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" IBAN DE89 3704 0044 0532 0130 00, account no. 12345678 at 12 Long Acre Street here'
    assert {text[a:b] for k, a, b in FINDER.spans(text)} >= {
        "https://a.example/x?y=1", "9c8b45435718dcc700c184a7e303cdc64c6a8f7f", "DE89 3704 0044 0532 0130 00", "12345678", "12 Long Acre Street"
    }
    long = "(7 " + " ".join("N" + "a" * 60 for _ in range(4)) + " Street)"
    assert [(k, long[a:b]) for k, a, b in FINDER.spans(long)] == [("address", long[1:-1])]
    assert FINDER.spans("a123456 Long Acre Street, x.12 Long Street, 12  Long Street, Long Street") == []
    assert FINDER.spans("the token of the road was an account, street by street") == []


def test_frame_and_redaction(spark):
    rows = [(1, "mail a@b.cd now"), (2, None), (3, ""), (1, "mail a@b.cd now"), (None, "+1 (499) 555-6503; 1.2.3.4")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, spans string")
    got = find(docs).collect()
    assert sorted((str(r.doc_id), r.spans) for r in got) == [("1", "email:5:11"), ("1", "email:5:11"), ("2", ""), ("3", ""), ("None", "phone:0:17,ip:19:26")]
    clean = docs.withColumn("text", redacted()).collect()
    assert [r.text for r in clean] == ["mail [EMAIL] now", None, "", "mail [EMAIL] now", "[PHONE]; [IP]"]
    assert find(docs.limit(0)).count() == 0
    assert redact("abcdef", [("email", 0, 3), ("ip", 2, 4), ("card", 5, 6)]) == "[EMAIL]e[CARD]"
    assert hashlib.sha256(b"").hexdigest() == find(docs).selectExpr("sha2(base, 256) s").collect()[1].s
