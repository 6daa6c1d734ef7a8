"""Whole notices, edited notices, and notices that differ in a version or variant only."""

import random

from copyledger.llm import license_scan
from copyledger.llm.license_texts import NOTICES


def labels(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    return [got[i]["labels"].split(",") if got[i]["labels"] else [] for i in range(len(texts))]


def edited(text, rng, each=25):
    """Every ``each``-th word replaced, away from the version words' neighbourhood at the front."""
    words = text.split()
    for i in range(each, len(words), each):
        words[i] = rng.choice(["xa", "xb", "xc"])
    return " ".join(words)


def test_every_notice_finds_its_label_and_no_other_version(spark):
    filler = "some words before the notice stand here and "
    got = labels(spark, [filler + text + " and some after it" for _, _, text in NOTICES])
    # Short forms that a longer notice holds, and base phrases inside notices, come with it.
    held = {"bsd-2": {"bsd"}, "bsd-3": {"bsd"}, "gpl-2": {"gpl"}, "gpl-3": {"gpl"}}
    for (label, _, text), found in zip(NOTICES, got):
        assert label in found and set(found) <= {label} | held.get(label, set()), (label, found, text[:60])


def test_edited_notices_keep_their_label(spark):
    rng = random.Random(6)
    whole = [(label, text) for label, needed, text in NOTICES if not needed and len(text.split()) > 60]
    assert {label for label, _ in whole} >= {"mit", "isc", "bsd-2", "bsd-3"}
    got = labels(spark, [edited(text, rng) for _, text in whole])
    for (label, _), found in zip(whole, got):
        assert label in found, (label, found)
    assert all(not ({"bsd-2", "bsd-3"} <= set(found)) for found in got)


def test_versions_are_not_settled_by_coverage(spark):
    gnu = next(text for label, _, text in NOTICES if label == "gpl-3" and len(text) > 200)
    got = labels(spark, [gnu.replace("version 3 of", "version 9 of"), gnu,
                         "licensed under the GNU General Public License version 4",
                         "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
                         "licensed under a Creative Commons Attribution-ShareAlike 3.0 International License",
                         "all rights reserved", "", None])
    assert got == [["gpl"], ["gpl", "gpl-3"], [], ["cc-by-sa"], [], [], [], []]
