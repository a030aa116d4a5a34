"""A small collection with bundles, mailboxes, equal messages and documents, and broken bundles."""

import hashlib
import json

import pytest

from tallyforge.sources.inventory import build_inventory

ZOMATO, SWIGGY = "1234567890", "123456789012345"
sha = lambda x: hashlib.sha256(x).hexdigest()


def bundle(root, platform, name, attachments=(), mail=None, body=None, order="", category="food", **broken):
    place = root / platform / name
    place.mkdir(parents=True)
    declared = []
    for filename, payload in attachments:
        (place / "files").mkdir(exist_ok=True)
        (place / "files" / filename).write_bytes(payload)
        declared.append({"path": f"files/{filename}", "filename": filename, "mimeType": "application/pdf", "bytes": len(payload), "sha256": sha(payload), "validPdfSignature": True} | broken)
    manifest = {"vendor": platform.upper(), "category": category, "orderId": order, "email": {"from": f"no-reply@{platform}.com", "subject": f"About {name}", "internalDate": "1704067200000"}, "attachments": declared}
    (place / "manifest.json").write_text(json.dumps(manifest, indent=1))
    if mail is not None:
        (place / "email.eml").write_bytes(mail)
    if body is not None:
        (place / "body.html").write_bytes(body)


PDF = {name: b"%PDF-1.4 " + name.encode() for name in ("a", "b", "history", "shared")}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("mail collection")
    bundle(root, "zomato", "b1", [("order_invoice.pdf", PDF["a"]), ("x.pdf", PDF["shared"])], b"mail one", f"<p>Order ID: {ZOMATO}</p>\xff".encode("latin-1"), "77")
    bundle(root, "zomato", "b2", [("again.pdf", PDF["shared"])], b"mail two", b"")
    bundle(root, "zomato", "b3", (), b"mail one", b"<p>other body</p>")
    bundle(root, "zomato", "no_mail", (), None, b"<p>nothing</p>", "x1")
    bundle(root, "swiggy", "history", [("report.pdf", PDF["history"])], b"mail three", None, category="Instamart")
    bundle(root, "swiggy", "wrong_size", [("x.pdf", PDF["b"])], b"mail four", None, bytes=3)
    bundle(root, "swiggy", "wrong_sum", [("x.pdf", PDF["b"])], b"mail five", None, sha256="0" * 64)
    bundle(root, "swiggy", "lost", [("x.pdf", PDF["b"])], b"mail six", None, path="files/y.pdf")
    bundle(root, "swiggy", "escape", [("x.pdf", PDF["b"])], b"mail seven", None, path="../lost/files/x.pdf")
    bundle(root, "swiggy", "no_pdf", [("x.pdf", b"plain text")], b"mail eight", None)
    bundle(root, "swiggy", "unsigned", [("x.pdf", PDF["b"])], b"mail nine", None, validPdfSignature=False)
    box = root / "takeout-1" / "Takeout" / "Mail"
    box.mkdir(parents=True)
    one = f"From: Shop <x@swiggy.in>\nSubject: Your order\nMessage-ID: <1@x>\n\nOrder ID: {SWIGGY}\n"
    other = "From: friend@home.org\nSubject: hello\n\nnot an order\n"
    (box / "All mail.mbox").write_text("".join(f"From a@b Mon Jan  1 00:00:00 2024\n{x}\n" for x in (one, other, one, other)))
    (root / "swiggy" / "stray.txt").write_text("no bundle")
    return root


@pytest.fixture(scope="module")
def inventory(spark, root):
    texts = [(sha(PDF["a"]), f"Order ID: {ZOMATO}", 2), (sha(PDF["history"]), "Number of orders\nOrder details\n01-02-2024 9876543210123 x\n02-02-2024 123456789012345 y", 3), (sha(PDF["shared"]), "", 1)]
    return build_inventory(spark, str(root), spark.createDataFrame(texts, "sha256 string, text string, pages int"))


def test_messages(inventory):
    got = {r.locator.rpartition("collection0/")[2]: r for r in inventory.messages.collect()}
    assert set(got) == {"zomato/b1/email.eml", "zomato/b2/email.eml", "zomato/no_mail/manifest.json", "swiggy/history/email.eml", *(k for k in got if "mbox" in k)} and len(got) == 5
    one = got["zomato/b1/email.eml"]
    assert one.message_id == "msg_" + sha(b"mail one")[:16] and one.raw_sha256 == sha(b"mail one") and one.platform == "zomato" and one.category == "food"
    assert one.body.startswith(f"Order ID: {ZOMATO}") and one.document_ids == ["doc_" + sha(PDF[k])[:16] for k in ("a", "shared")]
    assert [(c.value, c.source, str(c.confidence)) for c in one.order_candidates] == [(ZOMATO, "EMAIL_FIELD", "0.95"), (ZOMATO, "PDF_LABEL", "1.00"), ("77", "MANIFEST_HINT", "0.50")]
    assert got["swiggy/history/email.eml"].category == "instamart" and got["zomato/no_mail/manifest.json"].order_candidates == []
    mailed = next(r for k, r in got.items() if "mbox" in k)
    assert mailed.provider_id == "<1@x>" and [c.value for c in mailed.order_candidates] == [SWIGGY]


def test_documents(inventory):
    got = {r.sha256: r for r in inventory.documents.collect()}
    assert set(got) == {sha(PDF[k]) for k in ("a", "shared", "history")}
    assert got[sha(PDF["shared"])].filename == "x.pdf" and got[sha(PDF["shared"])].role == "unknown" and not got[sha(PDF["shared"])].has_text
    assert (got[sha(PDF["a"])].role, got[sha(PDF["a"])].pages, got[sha(PDF["history"])].role) == ("zomato_merchant_invoice", 2, "swiggy_order_history_report")


def test_evidence(inventory):
    got = {(r.kind, r.platform, r.order_id): r for r in inventory.evidence.collect()}
    assert set(got) == {("PDF_BUNDLE", "zomato", ZOMATO), ("PDF_BUNDLE", "zomato", None), ("EMAIL_ONLY", "zomato", None), ("HISTORY_ROW", "swiggy", "9876543210123"), ("HISTORY_ROW", "swiggy", SWIGGY), ("EMAIL_ONLY", "swiggy", SWIGGY)}
    one = got["PDF_BUNDLE", "zomato", None]
    assert one.evidence_id == "ev_" + sha(f"{one.message_id}|PDF_BUNDLE|provisional".encode())[:16]


def test_faults_and_summary(inventory):
    assert {(r.locator.split("/")[-2], r.fault) for r in inventory.faults.collect()} == {
        ("wrong_size", "size_differs"), ("wrong_sum", "digest_differs"), ("lost", "missing"), ("escape", "outside_bundle"), ("no_pdf", "not_a_pdf"), ("unsigned", "not_a_pdf"),
    }
    assert inventory.excluded.count() == 2
    assert inventory.summary().first().asDict() == {
        "relevant_messages": 5, "excluded_messages": 2, "unique_documents": 3, "pages": 6, "history_reports": 1, "repeated_documents": 1, "with_documents": 2, "mail_only": 2,
        "resolved": 3, "history_duplicates": 1, "provisional": 2, "total": 5,
    }


def test_an_empty_collection(spark, tmp_path):
    found = build_inventory(spark, str(tmp_path))
    assert found.messages.count() == found.documents.count() == found.evidence.count() == 0
    assert found.summary().first().relevant_messages == 0
