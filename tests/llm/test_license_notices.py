"""A file of several licences gets a label for each."""

from __future__ import annotations

from corpora import frame

from sonde.llm import license_scan


def test_every_notice_of_a_file_is_found(spark):
    every = " . ".join(text for _, text, _ in license_scan.TEMPLATES)
    five = " and then ".join(text for label, text, _ in license_scan.TEMPLATES if label in ("mit", "bsd", "mpl", "unlicense", "cc-by"))
    rows = [(1, every, "s"), (2, five, "s"), (3, "free software " * 3, "s")] + [(10 + k, text, "s") for k, (_, text, _) in enumerate(license_scan.TEMPLATES)]
    got = {r["doc_id"]: r for r in license_scan.license_scan(frame(spark, rows).select("doc_id", "text")).collect()}
    assert got[1]["labels"] == ",".join(sorted({label for label, _, _ in license_scan.TEMPLATES}))
    assert (got[2]["labels"], got[2]["score"], got[3]["labels"], got[3]["score"]) == ("bsd,cc-by,mit,mpl,unlicense", 1.0, "", 0.0)
    for k, (label, _, _) in enumerate(license_scan.TEMPLATES):
        assert label in got[10 + k]["labels"].split(",") and got[10 + k]["score"] == 1.0
