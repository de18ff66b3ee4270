import pytest
from pyspark.sql import functions as F

from prosewright.functions import text as T
from prosewright.operators import claims as C
from prosewright.operators import segments as G
from prosewright.operators import stylometry as S


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def features(spark, text):
    return S.features(one(spark, text)).first().asDict(recursive=True)


@pytest.mark.parametrize("text", ["As shown in Fig. 2 it holds. It is clear.", "Smith et al. found it. We agree."])
def test_abbreviations_end_no_sentence(spark, text):
    assert one(spark, text).select(F.size(T.sentences(F.col("text")))).first()[0] == 2


def test_lengths(spark):
    f = features(spark, "One two three four five. Six seven.")
    assert (f["mean_length"], f["min_length"], f["max_length"], f["length_variance"]) == (3.5, 2, 5, 2.25)


def test_hedges_passive_nominal_depth(spark):
    assert features(spark, "This may suggest a link to age.")["hedging_density"] == pytest.approx(200 / 7)
    f = features(spark, "The cells were counted. We left early.")
    assert (f["passive_ratio"], f["active_to_passive"]) == (0.5, 1.0)
    assert features(spark, "We run.")["active_to_passive"] is None
    assert features(spark, "The utilisation improved their assessment.")["nominalisation_rate"] == 40.0
    assert features(spark, "We stopped because it failed when it rained.")["clause_depth"] == 3.0


def test_paragraphs_and_tells(spark):
    f = features(spark, "We ran. They sat. It fell.\n\nShe won. He lost.")
    assert (f["paragraph_lengths"], f["paragraph_mean"]) == ([3, 2], 2.5)
    f = features(spark, "The fast, cheap, and simple way. Moreover, in addition, yes — maybe. The end.")
    assert (f["n_tricolons"] >= 1, f["n_moreover"], f["n_dashes"], f["top_opening"], f["top_opening_count"]) == (True, 2, 1, "the", 2)
    assert f["connectives"] == {"in addition": 1, "moreover": 1}


@pytest.mark.parametrize(("text", "tier"), [("word " * 90 + ".", "ok"), ("Few words.", "low"), ("", "none"), (None, "none")])
def test_confidence(spark, text, tier):
    assert features(spark, text)["confidence"] == tier


@pytest.mark.parametrize(
    ("text", "level"),
    [("This may suggest a link.", 1), ("Data suggest a link.", 2), ("It shows a link.", 3), ("It confirms a link.", 4), ("It clearly confirms a link.", 5), ("It demonstrates a link.", 5), ("X is associated with Y.", 3), ("X are associated with Y.", 4)],
)
def test_hedge_levels(spark, text, level):
    assert C.claims(one(spark, text)).first()["hedge"] == level


def test_no_claim(spark):
    assert C.claims(one(spark, "It may be. Results.")).count() == 0


@pytest.mark.parametrize(
    ("block", "title"),
    [("# Intro ##", "Intro"), ("2.1 Materials", "Materials"), ("IV. Results", "Results"), ("METHODS AND DATA", "METHODS AND DATA"), ("Related Work", "Related Work"), ("1. this is an item.", None), ("Plain sentence here.", None)],
)
def test_headings(spark, block, title):
    assert spark.createDataFrame([(block,)], "b string").select(G.heading_title(F.col("b"))).first()[0] == title


def test_segments(spark):
    text = "# Methods\r\n\r\nWe did it.\n\n$$ x = 1 $$\n\nTable 2. Counts\n\n## References\n\n[1] A. B."
    rows = G.segments(one(spark, text)).orderBy("seg_idx").collect()
    assert [r["kind"] for r in rows] == ["heading", "paragraph", "equation", "caption", "heading", "reference"]
    assert [r["section"] for r in rows] == ["methods"] * 4 + ["references"] * 2
    assert {r["section"] for r in G.segments(one(spark, "First here.\n\nSecond there.")).collect()} == {None}
