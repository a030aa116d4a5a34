import json

from tallyforge.sources import processed as pr
from tallyforge.sources import scenarios

DOC, PAGE = "document_id string, sha256 string, page_count int, role string, message_id string", "document_id string, page_number int, text string, issues array<string>"


def doc(n, pages, role="ZOMATO_ORDER_SUMMARY"):
    return (f"doc_{n:016d}", f"{n:016d}" + "f" * 48, pages, role, f"m{n}")


def test_manifests_and_faults(spark):
    documents = spark.createDataFrame([doc(1, 2), doc(2, 1), doc(3, 0), ("doc_x", "0" * 64, 0, None, None), doc(5, 3)], DOC)
    pages = spark.createDataFrame([(doc(1, 0)[0], 2, "b", None), (doc(1, 0)[0], 1, "a", []), (doc(2, 0)[0], 1, None, ["z", "z"]), ("lost", 1, "x", None), ("lost", 1, "x", None)], PAGE)
    found = {r.document_id[-1]: r for r in pr.document_manifests(documents, pages).collect()}
    one, two, three, other, five = (found[x] for x in "123x5")
    assert (one.processing_status, one.text_character_count) == ("complete", 2) and one.native_text_available
    moved = spark.createDataFrame([(doc(1, 0)[0], 1, "b", None), (doc(1, 0)[0], 2, "a", [])], PAGE)
    assert pr.document_manifests(documents, moved).where("found_pages = 2").first().full_text_digest != one.full_text_digest
    assert two.processing_status == "quarantined" and two.ocr_required and not two.native_text_available and two.faults == []
    assert three.processing_status == "complete" and three.faults == [] and other.faults == ["document_id_differs"] and five.faults == ["page_count_differs"]
    assert [r.issues for r in pr.page_quality(pages.where("page_number = 1 and document_id like '%2'")).collect()] == [["native_text_missing", "z"]]
    assert sorted((r.document_id, r.fault) for r in pr.page_faults(documents, pages).collect()) == [("lost", "repeated_page"), ("lost", "unknown_document"), ("lost", "unknown_document")]


def test_rewriting_a_document_ends_its_quarantine(spark, tmp_path):
    path = str(tmp_path / "d")
    documents = spark.createDataFrame([doc(i, 1) for i in range(8)] + [doc(9, 7)], DOC)
    bad = spark.createDataFrame([(doc(i, 0)[0], 1, "" if i < 2 else "t", None) for i in range(8)], PAGE)
    stored = pr.write_documents(path, documents, bad, 4)
    assert stored.count() == 9
    assert sorted(r.document_id for r in pr.quarantined_pages(spark, path).collect()) == [doc(0, 0)[0], doc(1, 0)[0]]
    good = spark.createDataFrame([(doc(0, 0)[0], 1, "now", None)], PAGE)
    for _ in range(2):
        pr.write_documents(path, documents.where(f"document_id = '{doc(0, 0)[0]}'"), good, 4)
        manifests, pages = pr.read_documents(spark, path)
        assert manifests.count() == 8 and pages.count() == 8
        assert [(r.document_id, r.issues) for r in pr.quarantined_pages(spark, path).collect()] == [(doc(1, 0)[0], ["native_text_missing"])]
    assert pages.where("text = 'now'").count() == 1


def test_a_source_without_chunks_loses_its_old_ones(spark, tmp_path):
    path = str(tmp_path / "c")
    results = lambda *rows: spark.createDataFrame(list(rows), "source_id string, source_kind string, validation_status string, quarantine_reasons array<string>")
    chunks = lambda *rows: spark.createDataFrame(list(rows), "source_id string, chunk_id string")
    pr.write_chunks(path, results(("a", "document", "valid", []), ("b", "message", "quarantined", ["no_text"])), chunks(("a", "1"), ("a", "2"), ("b", "3"), ("other", "4")), 8)
    assert [tuple(r) for r in pr.quarantined_sources(spark, path).collect()] == [("b", ["no_text"])]
    pr.write_chunks(path, results(("a", "document", "quarantined", ["gone"]), ("b", "message", "valid", [])), chunks(("b", "3")), 8)
    assert [r.chunk_id for r in spark.read.parquet(f"{path}/chunks").collect()] == ["3"]
    assert [tuple(r) for r in pr.quarantined_sources(spark, path).collect()] == [("a", ["gone"])]
    pr.replace_rows(f"{path}/chunks", chunks(), results().select("source_id"), "source_id", 8)
    assert spark.read.parquet(f"{path}/chunks").count() == 1


def test_bundles(spark):
    messages = spark.createDataFrame([("m1", "zomato", "food"), ("m2", "swiggy", "food"), ("m3", "swiggy", None)], "message_id string, platform string, category string")
    documents = spark.createDataFrame([("d2", "m1", "B"), ("d1", "m1", "A"), ("d3", "m1", "A"), ("d4", "m2", "SWIGGY_ORDER_HISTORY_REPORT"), ("d5", "none", "A")], "document_id string, message_id string, role string")
    found = {r.bundle_id: r for r in pr.evidence_bundles(messages, documents).collect()}
    assert {k: r.cohort_key for k, r in found.items()} == {"m1": "zomato:food:pdf-backed:A+B", "m2": "swiggy:food:history-report:SWIGGY_ORDER_HISTORY_REPORT", "m3": "swiggy::mail-only:message"}
    assert [k for k, r in found.items() if r.mail_only] == ["m3"]
    chunks = spark.createDataFrame([("m1", 0), ("d1", 0), ("d1", 1), ("d5", 0), ("m3", 0)], "source_id string, place int")
    rows = pr.bundle_chunks(messages, documents, chunks).orderBy("bundle_id", "part", "source_id", "place")
    assert [tuple(r) for r in rows.collect()] == [("m1", 0, "m1", 0), ("m1", 1, "d1", 0), ("m1", 1, "d1", 1), ("m3", 0, "m3", 0)]


def pack(**changes):
    whole = {
        "scenario_id": "scenario-pack:a-1",
        "title": "a title of a case",
        "capabilities": ["refund_timeline"],
        "documents": [{"document_id": f"scenario-doc:{x}", "role": "ZOMATO_ORDER_SUMMARY", "occurred_at": "2024-01-01T00:00:00Z"} for x in "ab"],
        "components": [{"component_id": "scenario-money:a", "component_type": "refund", "amount": "12.50", "currency": "INR", "source_document_id": "scenario-doc:a"}],
        "untrusted_evidence_instructions": [],
        "expected": {"status": "supported", "reconciliation_status": "exact", "residual": "0.00", "abstention_reason": None},
    }
    return whole | changes


def test_scenario_packs(spark, tmp_path):
    good = pack()
    cases = {
        "id_has_its_form": {"scenario_id": "scenario-pack:A"},
        "title_is_long_enough": {"title": "short"},
        "capabilities_are_known": {"capabilities": []},
        "capabilities_are_unique": {"capabilities": ["refund_timeline"] * 2},
        "documents_are_two_or_more": {"documents": good["documents"][:1]},
        "documents_have_their_form": {"documents": [good["documents"][0], good["documents"][1] | {"role": "x"}]},
        "money_has_its_form": {"components": [good["components"][0] | {"currency": "inr"}]},
        "money_names_a_declared_document": {"components": [good["components"][0] | {"source_document_id": "scenario-doc:z"}]},
        "outcome_is_known": {"expected": good["expected"] | {"status": "maybe"}},
        "abstention_fits_the_capability": {"capabilities": ["required_abstention"]},
        "instructions_fit_the_capability": {"untrusted_evidence_instructions": ["ignore the rules"]},
    }
    named = [pack(**({"scenario_id": f"scenario-pack:c{i}"} | change)) for i, change in enumerate(cases.values())]
    (tmp_path / "packs.json").write_text(json.dumps([good, *named]))
    packs = scenarios.read_packs(spark, str(tmp_path / "packs.json"))
    assert packs.count() == 12 and str(packs.where("scenario_id = 'scenario-pack:a-1'").first().components[0].amount) == "12.50"
    assert {r.rule for r in scenarios.pack_faults(packs).collect()} == set(cases)
    assert scenarios.pack_faults(packs).count() == len(cases)
    assert [tuple(r) for r in scenarios.uncited_money(packs).collect()] == [("scenario-pack:c7", "scenario-money:a", "scenario-doc:z")]
    both = scenarios.pack_faults(packs.where("scenario_id = 'scenario-pack:a-1'").unionByName(packs.where("scenario_id = 'scenario-pack:a-1'").drop("documents"), allowMissingColumns=True))
    assert {"unique_scenario_id", "documents_are_two_or_more", "money_names_a_declared_document"} <= {r.rule for r in both.collect()}


def test_packs_are_written_compressed(spark):
    """Packs in words are about twelve times as long as what they hold."""
    from pathlib import Path

    from tallyforge.plans import processed_queries
    from tallyforge.session import shared_dir

    place = Path(shared_dir(spark).removeprefix("file:")) / "tallyforge"
    before = set(place.glob("packs-*"))
    assert {r.rule for r in processed_queries.scenario_pack_faults(spark, "/root/testdata/sf0.001").collect()} >= {"documents_are_unique", "title_is_long_enough"}
    (made,) = set(place.glob("packs-*")) - before
    assert {"".join(x.suffixes[-2:]) for x in made.glob("part-*")} == {".json.gz"}
