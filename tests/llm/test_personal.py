import random

import pytest
from pyspark.sql import functions as F

from rolloutlake.llm import personal as p

GIVEN = {"tamsel", "corwin", "mirelle"}
FAMILY = {"ostrelli", "thornquill", "sorvino-hale"}


@pytest.fixture(scope="module")
def model():
    return p.NameModel(GIVEN, FAMILY, {"thanks to": 2.5, "my name is": 3.0, "annotator:": 2.5, "cc": 1.7, "mr.": 2.2}, {"for the fix": 3.5, "asked for": 3.1}, plain={"loss", "bound", "scored", "seats", "room", "tape"})


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (None, set()),
        ("", set()),
        (" \n", set()),
        ("cc A_b.c+d@Mail.Example.org, thanks. Next", {("email", "a_b.c+d@mail.example.org")}),
        ("write to marou319 AT uni-nord [dot] example now", {("email", "marou319@uni-nord.example")}),
        ("write to a.b [at] lab . example about it", {("email", "a.b@lab.example")}),
        ("x elspira736＠example(dot)com", {("email", "elspira736@example.com")}),
        ("Send it to a@lab.example. Then stop", {("email", "a@lab.example")}),
        ("Ping gpu@rack22:8443, loader@2.63, acc@259=0.1 and train@node-50; look at the dot", set()),
        ("phone: +44 (20) 79460405; or (614) 555-0186", {("phone", "442079460405"), ("phone", "6145550186")}),
        ("tel 0044  20 7946 0158, fax 367/555 0188", {("phone", "00442079460158"), ("phone", "3675550188")}),
        ("Run 2025-0555-0160 finished, Sample 900-88-77 skipped, 123456789012345678901234567890", set()),
        ("her SSN=988-46-3297 and insurance number qq 75 72 27 d", {("identity", "988463297"), ("identity", "QQ757227D")}),
        ("passport no. ZZ6127026.", {("identity", "ZZ6127026")}),
        ("They live at No. 662a, Juniper Way, Apt 4 and film", {("address", "662a juniper way")}),
        ("is at 830 Millrace Rd. Or 388, rue Owlsgate", {("address", "830 millrace rd"), ("address", "388 rue owlsgate")}),
        ("They live at Calle Tinderbox, 707 and Owlsgatestraße 599, 90221 X", {("address", "calle tinderbox 707"), ("address", "owlsgatestraße 599")}),
        ("Ship 34 road noise samples. Unit 42 Drive failed after 84 hours. We kept 74 lane clips.", set()),
        ("Thanks to Mr. Tamsel K. Sorvino-Hale for the fix!", {("name", "tamsel sorvino hale")}),
        ("annotator: Ostrelli, Corwin asked for a rerun.", {("name", "corwin ostrelli")}),
        ("Thanks to hedra corrigane for the fix!", {("name", "hedra corrigane")}),
        ("annotator: Blyvoet, Jessamy asked for a rerun.", {("name", "jessamy blyvoet")}),
        ("The Corwin loss and the Ostrelli bound differ. Corwin and Mirelle both scored 3. Room Tamsel seats 9.", set()),
        ("The Thornquill Basin tape; thread Ostrelli-norm; corwin.ostrelli@example.com", {("email", "corwin.ostrelli@example.com")}),
    ],
)
def test_findings(model, text, found):
    assert {(k, f) for _, _, k, f in p.findings(text, model)} == found


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("call 212 867 5309 after six", {("phone", "2128675309")}),
        ("Tel. 030 1234567, phone 020 7946 0958, fax 01 23 45 67 89.", {("phone", "0301234567"), ("phone", "02079460958"), ("phone", "0123456789")}),
        ("shard 212 867 5309 done, step 020 7946 0958, run 0123456789", set()),
        ("the form holds 123-45-6789 and 000-12-3456 and 666-12-3456", {("identity", "123456789")}),
        ("NI\tno: QQ 75 72 27 D", {("identity", "QQ757227D")}),
        ("run 2128675309 of 9, later +1 212 867 5309", {("phone", "2128675309"), ("phone", "12128675309")}),
        ("run 2128675309 of 9, again 2128675309 and 2128675309", set()),
        ("SSN 123-45-6789, row 123 45 6789", {("identity", "123456789")}),
    ],
)
def test_general_forms_and_skip_potentials(model, text, found):
    assert {(k, f) for _, _, k, f in p.findings(text, model)} == found


def test_second_occurrences_are_replaced(model):
    far = " the tape runs on and on," * 12
    text = f"call 212 867 5309,{far} row 2128675309;{far} My name is Zorbina Quellhart.{far} Later Zorbina Quellhart went home."
    done = p.replaced(text, p.findings(text, model))
    assert done == f"call [PHONE],{far} row [PHONE];{far} My name is [NAME].{far} Later [NAME] went home."


def test_cues_are_learned(spark):
    rng = random.Random(3)
    docs = []
    for k in range(120):
        g, f = rng.choice(sorted(GIVEN)).title(), rng.choice(["ostrelli", "thornquill"]).title()
        docs.append((k, rng.choice([f"the stage was built by maestro {g} {f} who left early.", f"ring the bell at +44 20 7946 {rng.randrange(1000, 9999)} twice", "the lamp was lit and the tape ran on."])))
    docs += [(1000, "it was made by maestro Hedra Corrigane who left"), (1001, "the ring the bell at 2128675309 now")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    names = spark.createDataFrame([(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY], "name_part string, kind string")
    fitted = p.fitted_model(df, names)
    assert fitted.left["maestro"] > 1 and fitted.right["who"] > 1 and fitted.numbers["bell at"] > 1 and "tape" in fitted.plain
    got = {(r.doc_id, r.kind, r.found) for r in p.scan(df, names).where("doc_id >= 1000").collect()}
    assert got == {(1000, "name", "hedra corrigane"), (1001, "phone", "2128675309")}


def test_cues_are_learned_from_all_documents(spark):
    # Five known pairs in 40,000 documents: a sample of a quarter holds too few of them.
    rare = F.when(F.col("doc_id") < 5, "the stage was built by maestro Corwin Ostrelli who left early.").when(F.col("doc_id") == 5, "it was made by maestro Hedra Corrigane who left")
    df = spark.range(40_000).withColumnRenamed("id", "doc_id").withColumn("text", F.coalesce(rare, F.lit("the lamp was lit and the tape ran on.")))
    names = spark.createDataFrame([(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY], "name_part string, kind string")
    fitted = p.fitted_model(df, names)
    assert fitted.left["maestro"] > 1 and fitted.right["who left"] > 1
    assert {(r.doc_id, r.found) for r in p.scan(df, names).collect()} == {(k, "corwin ostrelli") for k in range(5)} | {(5, "hedra corrigane")}


def test_replacing_keeps_the_rest(model):
    text = "Thanks to Tamsel Ostrelli for the fix! a@b.example, a@b.example"
    assert p.replaced(text, p.findings(text, model)) == "Thanks to [NAME] for the fix! [EMAIL], [EMAIL]"
    assert p.replaced(None, []) is None


def test_repeated_names_help_each_other(model):
    text = "Thanks to Hedra Corrigane for the fix! " + "Much later the log shows Hedra Corrigane cc again. " * 2
    assert {f for _, _, k, f in p.findings(text, model) if k == "name"} == {"hedra corrigane"}


def test_frame(spark):
    docs = spark.createDataFrame([(1, "cc Tamsel Ostrelli", "z"), (1, "cc Tamsel Ostrelli", "z"), (2, None, "z"), (3, "x " * 200_000 + "a@b.example", "z")], "doc_id long, text string, kind string")
    names = spark.createDataFrame([(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY] + [(None, "given")], "name_part string, kind string")
    got = sorted(tuple(r) for r in p.scan(docs, names).collect())
    assert got == [(1, "name", "tamsel ostrelli")] * 2 + [(3, "email", "a@b.example")]
    assert p.scan(docs.limit(0), names).collect() == []
    assert {r.text for r in p.scan(docs, names, replace=True).collect() if r.doc_id != 3} == {None, "cc [NAME]"}


def test_far_repeats_of_an_unlisted_name_are_replaced(model):
    far = " the tape runs on and on," * 12
    text = f"Thanks to Hedra Corrigane for the fix!{far} then Hedra Corrigane is heard{far} and hedra corrigane again{far}"
    assert p.replaced(text, p.findings(text, model)) == f"Thanks to [NAME] for the fix!{far} then [NAME] is heard{far} and [NAME] again{far}"
