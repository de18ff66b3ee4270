"""Style features of a text, in one projection without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

PASSIVE = r"(?iU)\b(?:" + "|".join(L.BE_FORMS) + r")\b(?:\s+\w+){0,2}?\s+(?:\w+ed|" + "|".join(L.PARTICIPLES) + r")\b"
#: From the start of a part on: a match of a later start has one from there, too.
TRICOLON = r"(?i)(?<![^,.;:!?()\n])[^,.;:!?()\n]++,\s+[^,.;:!?()\n]+,\s+(?:and|or)\s+[^,.;:!?()\n]+"
DASH = "[—–]"
NOMINAL = "(?i)(?:" + "|".join(L.NOMINAL_ENDINGS) + ")$"


def base(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the arrays that all features share, each made once: _sents, _words, _per (words per sentence)."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_sents", T.sentences(t)).withColumn("_words", T.words(t))
    return df.withColumn("_per", F.filter(F.transform("_sents", lambda s: F.size(T.words(s))), lambda n: n > 0))


def length_stats() -> dict[str, Column]:
    per, n = F.col("_per"), F.size("_per")
    mean = T.ratio(T.total(per), n)
    spread = T.let(mean, lambda m: F.aggregate(per, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
    return {
        "n_sentences": F.size("_sents"),
        "n_words": F.size("_words"),
        "mean_length": mean,
        "min_length": F.coalesce(F.array_min(per), F.lit(0)),
        "max_length": F.coalesce(F.array_max(per), F.lit(0)),
        "length_variance": F.when(n < 2, F.lit(0.0)).otherwise(spread / F.when(n > 0, n)),
    }


def lexicon_counts(text: Column) -> dict[str, Column]:
    return {
        "n_connectives": T.count(text, T.any_of(L.CONNECTIVES)),
        "n_hedges": T.count(text, T.any_of(L.HEDGES)),
        "n_moreover": T.count(text, T.any_of(L.MOREOVER_FAMILY)),
        "n_diction": T.count(text, T.any_of(L.DICTION)),
    }


def connective_map(text: Column) -> Column:
    """Connective to its count, those that occur."""
    found = F.regexp_extract_all(F.lower(text), F.lit(T.any_of(L.CONNECTIVES)), F.lit(0))
    counted = lambda f: F.transform(F.array_sort(F.array_distinct(f)), lambda c: F.struct(c, F.size(F.filter(f, lambda x: x == c))))
    return F.map_from_entries(T.let(found, counted))


def hollow(text: Column) -> Column:
    def total(low: Column) -> Column:
        out = F.lit(0)
        for phrase in L.HOLLOW:
            out = out + T.count_plain(low, phrase)
        return out

    return T.let(F.lower(text), total)


def passives() -> Column:
    """Sentences in the passive."""
    return F.size(F.filter("_sents", lambda s: s.rlike(PASSIVE)))


def nominalisations() -> Column:
    return F.size(F.filter("_words", lambda w: (F.length(w) > 5) & w.rlike(NOMINAL)))


def clause_depth() -> Column:
    """Mean over sentences of 1 + subordinators."""
    n = F.size("_sents")
    subs = F.transform("_sents", lambda s: F.size(F.filter(T.words(F.lower(s)), lambda w: w.isin(L.SUBORDINATORS))) + 1)
    return T.ratio(T.total(subs), n)


def openings() -> dict[str, Column]:
    """Sentences whose first word opens two or more, and the most frequent opening (first seen on ties)."""
    first = F.filter(F.transform("_sents", lambda s: F.lower(F.get(T.words(s), F.lit(0)))), lambda w: w.isNotNull())
    # equal words side by side, each with its place
    placed = F.array_sort(F.transform(first, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    fresh = F.struct(F.lit("").alias("w"), F.lit(0).alias("i"), F.lit(0).alias("n"))
    empty = F.struct(F.lit(0).alias("uniform"), F.lit(None).cast("string").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("i"), fresh.alias("run"))

    def close(a: Column) -> Column:
        run, often = a["run"], a["run"]["n"] >= 2
        wins = often & ((run["n"] > a["n"]) | ((run["n"] == a["n"]) & (run["i"] < a["i"])))
        return F.struct((a["uniform"] + F.when(often, run["n"]).otherwise(0)).alias("uniform"), F.when(wins, run["w"]).otherwise(a["w"]).alias("w"), F.when(wins, run["n"]).otherwise(a["n"]).alias("n"), F.when(wins, run["i"]).otherwise(a["i"]).alias("i"), run.alias("run"))

    def step(a: Column, x: Column) -> Column:
        same = (a["run"]["n"] > 0) & (a["run"]["w"] == x["w"])
        longer = F.struct(a["run"]["w"].alias("w"), a["run"]["i"].alias("i"), (a["run"]["n"] + 1).alias("n"))
        anew = F.struct(x["w"].alias("w"), x["i"].alias("i"), F.lit(1).alias("n"))
        keep = F.struct(a["uniform"].alias("uniform"), a["w"].alias("w"), a["n"].alias("n"), a["i"].alias("i"), longer.alias("run"))
        turn = T.let(close(a), lambda c: F.struct(c["uniform"].alias("uniform"), c["w"].alias("w"), c["n"].alias("n"), c["i"].alias("i"), anew.alias("run")))
        return F.when(same, keep).otherwise(turn)

    type_ = "struct<uniform:int,w:string,n:int,i:int,run:struct<w:string,i:int,n:int>>"
    found = F.aggregate(placed, empty.cast(type_), lambda a, x: step(a, x).cast(type_), close)
    return {"_open": found}


def opening_columns(df: DataFrame) -> DataFrame:
    """Adds uniform_openings, top_opening and top_opening_count; needs the arrays of :func:`base`."""
    df = df.withColumns(openings())
    return df.withColumns({"uniform_openings": F.col("_open.uniform"), "top_opening": F.col("_open.w"), "top_opening_count": F.col("_open.n")}).drop("_open")


def confidence(n_words: Column) -> Column:
    return F.when(n_words == 0, "none").when(n_words < L.RELIABLE_WORDS, "low").otherwise("ok")


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """All features beside the columns of ``df``: lengths, densities, ratios, tells and the tier of confidence."""
    keep = df.columns
    t = F.coalesce(F.col(text), F.lit(""))
    df = base(df, text)
    nw, ns = F.size("_words"), F.size("_sents")
    df = opening_columns(df)
    per_para = F.transform(T.paragraphs(t), lambda p: F.size(T.sentences(p)))
    df = df.withColumns(length_stats() | lexicon_counts(t) | {"n_passive": passives(), "n_nominal": nominalisations(), "clause_depth": clause_depth(), "paragraph_lengths": per_para, "n_tricolons": T.count(t, TRICOLON), "n_dashes": T.count(t, DASH), "n_hollow": hollow(t), "connectives": connective_map(t)})
    more = {
        "connective_max": F.coalesce(F.array_max(F.map_values("connectives")), F.lit(0)),
        "hedging_density": T.ratio(F.col("n_hedges") * 100.0, nw),
        "passive_ratio": T.ratio(F.col("n_passive") * 1.0, ns),
        "active_to_passive": F.when(F.col("n_passive") > 0, (ns - F.col("n_passive")) / F.when(F.col("n_passive") > 0, F.col("n_passive"))),
        "nominalisation_rate": T.ratio(F.col("n_nominal") * 100.0, nw),
        "paragraph_mean": T.ratio(T.total(F.col("paragraph_lengths")) * 1.0, F.size("paragraph_lengths")),
        "confidence": confidence(nw),
    }
    df = df.withColumns(more).drop("_sents", "_words", "_per")
    return df.select(*keep, *[c for c in df.columns if c not in keep])


def style_report(df: DataFrame, text: str = "text") -> DataFrame:
    """The author's view: ten figures."""
    out = features(df, text)
    new = ["n_words", "n_sentences", "mean_length", "length_variance", "passive_ratio", "hedging_density", "nominalisation_rate", "clause_depth", "paragraph_mean", "confidence"]
    return out.withColumn("length_variance", F.bround("length_variance", 2)).select(*df.columns, *new)
