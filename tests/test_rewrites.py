import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from prosewright.operators import changelog as C
from prosewright.operators import evaluate as E
from prosewright.operators import protection as P
from prosewright.operators import rewrite as R
from prosewright.operators import segments as G
from prosewright.operators import verify as V
from prosewright.plans import queries, runs
from prosewright.sources import files
from prosewright.sources import providers as M

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # for the providers below


@pytest.mark.parametrize("text", ["See [12] and [3-5, 9], p < 0.05.", "(see Figure 2; Smith, 2020) and 10 mL of CO2 at 1,000 mL", "at https://a.org/x?y=1 doi: 10.1234/ab.c", r"\begin{eq}1\end{eq} $x$ $$y$$", "a ⟦PA⟧ b 12", "", None])
def test_round_trip(spark, text):
    df = spark.createDataFrame([(text,)], "t string").withColumn("p", P.protect(F.col("t")))
    row = df.select(P.restore(F.col("p.masked"), F.col("p.spans")).alias("r"), P.integrity(F.col("p.masked"), P.top_tokens(F.col("p.spans"))).alias("v")).first()
    assert row["r"] == text
    assert text is None or row["v"]["ok"]


def test_token_order(spark):
    text = "We saw 12.4% of cells [17] (p < 0.05)."
    got = {s["kind"]: s["token"] for s in P.mask_text(text, P.patterns())["spans"]}
    assert got == {"cite_num": "⟦PA⟧", "p_value": "⟦PB⟧", "quantity_unit": "⟦PC⟧"}


def test_integrity(spark):
    tokens = F.array(F.lit("⟦PA⟧"), F.lit("⟦PB⟧"))
    v = spark.range(1).select(P.integrity(F.lit("⟦PA⟧ ⟦PA⟧ ⟦PZ⟧"), tokens).alias("v")).first()["v"]
    assert (v["ok"], v["missing"], v["duplicated"], v["unexpected"]) == (False, ["⟦PB⟧"], ["⟦PA⟧"], ["⟦PZ⟧"])


def sides(spark, before, after, section=None):
    schema = "doc_id long, seg_idx int, text string, section string, frozen boolean"
    rows = lambda texts: spark.createDataFrame([(1, i, t, section, False) for i, t in enumerate(texts)], schema)
    return rows(before), rows(after)


def test_gates(spark):
    assert not V.verify(*sides(spark, ["As shown [3]."], ["As shown."])).first()["passed"]
    assert not V.verify(*sides(spark, ["A.", "B."], ["A."])).first()["passed"]
    o, r = sides(spark, ["The drug may suggest a benefit."], ["The drug demonstrates a benefit."])
    row = V.verify(o, r).first()
    assert (row["passed"], row["claim_flags"]) == (True, 1)
    assert V.claim_flags(V.pair_segments(o, r)).first()["kind"] == "strengthened"
    five, three = "We ran. They sat. It fell. She won. He lost.", "We ran. They sat. It fell."
    assert V.sentence_flags(V.pair_segments(*sides(spark, [five], [three], "methods"))).count() == 1
    assert V.sentence_flags(V.pair_segments(*sides(spark, [five], [three], "discussion"))).count() == 0


@pytest.mark.parametrize(
    ("before", "after", "reason"),
    [
        ("We ran the test.", "We ran the test.", "unchanged"),
        ("Moreover, the cells grew well.", "However, the cells grew well.", "connective replaced"),
        ("The utilisation of the tool helped us.", "The use of the tool helped us.", "deverbalised"),
        ("The cat sat down on the old red mat.", "The cat sat on the mat.", "redundancy removed"),
        ("The cat sat on the mat.", "The cat lay on the mat.", "reworded"),
    ],
)
def test_reasons(before, after, reason):
    assert [e["reason"] for e in C.align([before], [after])] == [reason]


def test_merge_split_delete_add():
    a, b = "The first group received the drug daily.", "The second group received a placebo daily."
    both = "The first group received the drug daily and the second group received a placebo daily."
    assert [(e["reason"], e["original_indices"], e["rewritten_indices"]) for e in C.align([a, b], [both])] == [("merged", [0, 1], [0])]
    assert [(e["reason"], e["original_indices"], e["rewritten_indices"]) for e in C.align([both], [a, b])] == [("split", [0], [0, 1])]
    assert [e["reason"] for e in C.align(["zzz qqq."], ["12345 67890!"])] == ["deleted", "added"]


DRAFT = "# Introduction\n\nMoreover, the utilisation of care may suggest a benefit [3].\n\n## References\n\n[1] Smith 2020."


def clean():
    return M.Stub(lambda p: p.replace("Moreover, the", "The"))


def stronger():
    return M.Stub(lambda p: p.replace("may suggest", "demonstrates"))


class Broken:
    def complete(self, prompt, system=None):
        return M.Completion("lost it all")


def test_run_and_compare(spark):
    docs = spark.createDataFrame([(1, DRAFT)], "doc_id long, text string")
    out = runs.run_pipeline(docs, clean)
    assert "The utilisation of care may suggest a benefit [3]." in out["documents"].first()["text"]
    assert out["verdict"].first()["passed"]
    assert [r["stage"] for r in out["audit"].orderBy("stage_idx").collect()] == ["segment", "rewrite", "verify"]
    ranked = runs.compare(docs, {"echo": M.Stub, "broken": Broken, "strengthen": stronger, "clean": clean}, {"keyless": "no key"}).orderBy("rank").collect()
    assert [r["model_id"] for r in ranked][:3] == ["clean", "echo", "strengthen"]
    assert ranked[0]["tier"] == 0 and ranked[2]["tier"] == 1 and {r["tier"] for r in ranked[3:]} == {2}


def test_broken_segment_keeps_its_text(spark):
    docs = spark.createDataFrame([(1, DRAFT)], "doc_id long, text string")
    rows = R.rewrite(G.segments(docs), Broken)
    report = R.rewrite_report(rows).first()
    assert (report["failed"], report["retries"]) == (1, 2)
    assert rows.filter("text <> rewritten").count() == 0


def test_retry_and_backoff():
    naps = []
    stub = M.Stub(fail_first=2)
    assert M.with_retry(lambda: stub.complete("a b"), sleep=naps.append).prompt_tokens == 2
    assert naps == [0.5, 1.0] and M.backoff(20) == 8.0
    with pytest.raises(ValueError):
        M.provider("nothing")


def test_catalog():
    good = '[[model]]\nid = "a"\ndisplay_name = "A"\nprovider = "stub"\nmodel = "m"\n'
    assert files.model_rows(good)[0]["enabled"] is True
    for bad in (good + good, good + "colour = 1\n"):
        with pytest.raises(ValueError):
            files.model_rows(bad)


def test_verdicts(spark):
    replies = [(1, ["a", "b"], '{"best": "a", "ranking": ["b", "a", "z"], "rationale": {"a": "x", "z": "y"}}'), (2, ["a", "b"], 'so {"best": "z", "ranking": ["b"]} ok'), (3, ["a"], "garbage"), (4, ["a"], None)]
    rows = E.verdicts(spark.createDataFrame(replies, "id int, labels array<string>, reply string")).orderBy("id").collect()
    assert [(r["best_label"], r["ranking"]) for r in rows] == [("a", ["b", "a"]), ("b", ["b"]), (None, None), (None, None)]
    assert rows[0]["rationale"] == {"a": "x"}


def test_change_ratio(spark):
    row = spark.range(1).select(C.change_ratio(F.lit("a b"), F.lit("a b")), C.change_ratio(F.lit("a b"), F.lit("c d"))).first()
    assert tuple(row) == (0.0, 1.0)


def test_changelog_of_segments_that_differ(spark):
    a, b = "Qq 12345 67890 zz!", "It rained in Spain."
    o, r = sides(spark, [a, b], [b])
    rows = C.changelog(V.pair_segments(o, r)).orderBy("entry_idx").collect()
    assert [(x["seg_idx"], x["reason"], x["original_text"], x["rewritten_text"]) for x in rows] == [(0, "deleted", a, ""), (0, "unchanged", b, b)]
    schema = "doc_id long, seg_idx int, text string, section string, frozen boolean"
    head = spark.createDataFrame([(1, 0, "Title", None, True), (1, 1, a, None, False)], schema)
    rows = C.changelog(V.pair_segments(head, head)).orderBy("seg_idx").collect()
    assert [(x["seg_idx"], x["reason"], x["original_indices"]) for x in rows] == [(0, "unchanged", [0]), (1, "unchanged", [0])]


def test_whole_texts(spark):
    texts = spark.createDataFrame([(1, "We counted cells [3].", "We counted cells."), (2, "The drug may suggest a benefit.", "The drug demonstrates a benefit.")], "doc_id long, original string, rewritten string")
    rows = V.verify_pairs(V.whole_pairs(texts)).orderBy("doc_id").collect()
    assert [(r["passed"], r["claim_flags"]) for r in rows] == [(False, 0), (True, 1)]


def test_voice_without_a_sample(spark):
    from prosewright.operators import stylometry as S

    df = spark.createDataFrame([(1, "We ran the test.")], "doc_id long, rewritten string")
    none = S.features(spark.createDataFrame([], "doc_id long, text string"))
    row = E.match_voice(df, none).first()
    assert (row["voice_available"], row["voice_distance"], row["voice_score"]) == (False, 0.0, 1.0)


def test_frozen_text_is_kept(spark):
    segs = spark.createDataFrame([(1, 0, "Title", True), (1, 1, "We ran.", False)], "doc_id long, seg_idx int, text string, frozen boolean")
    same = G.with_text(segs, F.when(F.col("frozen"), F.col("text")).otherwise(F.upper("text")))
    assert [r["text"] for r in same.orderBy("seg_idx").collect()] == ["Title", "WE RAN."]
    with pytest.raises(Exception, match="segment 0 is frozen"):
        G.with_text(segs, F.upper("text")).collect()


PROMPTS = {"system/rewrite.v1.md": "Old {{INTENSITY}}", "system/rewrite.v2.md": "Rewrite. {{INTENSITY}} {{STYLE}}", "system/intensity/balanced.v1.md": " Gently.\n", "system/style/plain.v1.md": "Plainly.", "system/style/odd.v1.md": "{{X}}", "fewshot/cs.v1.txt": "A to B.\n"}


def test_prompts(spark, tmp_path):
    for name, text in PROMPTS.items():
        (tmp_path / "prompts" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "prompts" / name).write_text(text)
    prompts = files.read_prompts(spark, str(tmp_path / "prompts"))
    assert [r["id"] for r in files.prompt_ids(prompts).collect()] == ["fewshot/cs", "system/intensity/balanced", "system/rewrite", "system/style/odd", "system/style/plain"]
    assert files.prompt(prompts, "system/rewrite").first()["version"] == 2 and files.prompt(prompts, "system/rewrite", 1).first()["text"] == "Old {{INTENSITY}}"
    for bad in (("system/none", None), ("system/rewrite", 3)):
        with pytest.raises(KeyError):
            files.prompt(prompts, *bad)
    text, refs = files.compose(prompts, "balanced", "plain", "cs")
    assert text == "Rewrite. Gently. Plainly.\n\nExample of the transformation in this field:\n\nA to B.\n"
    assert [r.split(":")[0] for r in refs] == ["system/rewrite@v2", "system/intensity/balanced@v1", "system/style/plain@v1", "fewshot/cs@v1"] and all(len(r.split(":")[1]) == 8 for r in refs)
    with pytest.raises(ValueError):
        files.compose(prompts, "balanced", "odd")
    with pytest.raises(KeyError):
        files.compose(prompts, "balanced", "none")


def listening():
    return M.Stub(lambda p: p)


class Echoing:
    """Answers with what it was told."""

    def complete(self, prompt, system=None):
        return M.Completion(f"{prompt} {system}")


def test_refs_and_voice_in_the_report(spark):
    segs = G.segments(spark.createDataFrame([(1, DRAFT)], "doc_id long, text string"))
    voice = spark.createDataFrame([(14.0, 0.25, 1.5, 3.0, "ok", " My own words. ")], "mean_length double, passive_ratio double, hedging_density double, nominalisation_rate double, confidence string, exemplar string")
    rows = R.rewrite(segs, Echoing, system=F.lit("Base."), voice=voice, refs=["a@v1:00000000", "b@v2:11111111"])
    report = R.rewrite_report(rows).first()
    assert (report["voice"], report["prompt_refs"], report["failed"]) == ("ok", ["a@v1:00000000", "b@v2:11111111"], 0)
    said = rows.filter("not frozen").first()["rewritten"]
    assert "Base.\n\nAim for sentences of 14.0 words" in said and said.endswith("for feel:\nMy own words.")
    none = R.rewrite_report(R.rewrite(segs, listening, voice=voice.filter("false"))).first()
    assert none["voice"] == "none"


def test_catalog_lookups(spark):
    two = '[[model]]\nid = "b"\ndisplay_name = "B"\nprovider = "stub"\nmodel = "m"\n[[model]]\nid = "a"\ndisplay_name = "A"\nprovider = "stub"\nmodel = "n"\n'
    models = spark.createDataFrame(files.model_rows(two), files.MODEL_SCHEMA)
    assert files.model(models, "a")["model"] == "n" and [r["id"] for r in files.model_ids(models).collect()] == ["b", "a"]
    with pytest.raises(KeyError):
        files.model(models, "c")


def picky():
    return M.Stub(lambda p: 'so {"best": "clean", "ranking": ["clean", "echo", "zz"], "rationale": {"clean": "x"}}' if "[clean]" in p and p.startswith("ORIGINAL:\n#") else "nothing")


class Down:
    def complete(self, prompt, system=None):
        raise M.ProviderError("down")


def test_judge_and_console(spark):
    docs = spark.createDataFrame([(1, DRAFT)], "doc_id long, text string")
    ranked = runs.compare(docs, {"echo": M.Stub, "strengthen": stronger, "clean": clean}, {"keyless": "no key"})
    row = E.judge(ranked, picky).first()
    assert (row["labels"], row["best_label"], row["ranking"], row["rationale"]) == (["echo", "clean"], "clean", ["clean", "echo"], {"clean": "x"})
    row = E.judge(ranked, Down).first()
    assert row["best_label"] is None and row["ranking"] is None and "down" in row["reply"]
    assert E.judge(ranked.filter("model_id = 'echo'"), picky).count() == 0
    shown = runs.console(ranked, 1)
    assert "winner: clean" in shown and "note: no key" in shown and shown.index("clean") < shown.index("echo")
    assert "No candidate passed" in runs.console(ranked.filter("tier > 0"), 1)


def test_no_key_no_header():
    seen = []
    chat = M.ChatHttp("m", "http://x", transport=lambda url, body, headers, timeout: seen.append(headers) or {"choices": [{"message": {"content": "hi"}}]})
    assert chat.complete("p").text == "hi" and seen == [{}]


def test_equal_texts_of_a_draft_are_made_once(spark, tmp_path):
    texts = ["It is robust, large, and new. The dose may suggest harm — we found it clearly, fast, or late.", "", None, "Plain words.\n\nA test, e.g. this one, shows\nthat, in short, and so on."]
    how = {"same": F.col("text"), "firm": F.replace("text", F.lit("may suggest"), F.lit("demonstrates")), "gone": F.lit(None).cast("string"), "token": F.concat(F.col("text"), F.lit(" ⟦PA⟧"))}
    drafts = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = [F.struct(F.lit(i).alias("input_pos"), F.lit(m).alias("model_id"), t.alias("rewritten")) for i, (m, t) in enumerate(how.items())]
    pairs = drafts.select("doc_id", F.col("text").alias("original"), F.explode(F.array(*one)).alias("c")).select("doc_id", "original", "c.*")
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(E.scorecards(E.candidates(drafts, one))) == key(E.scorecards(pairs))
    # a file of keys is read once, by one task, and its texts are dealt to all
    spark.range(100).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    ranked = queries.QUERIES["model_ranking"](spark, str(tmp_path))
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Repartition" in plan
    assert ranked.count() == 400
