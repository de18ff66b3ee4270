"""Each operator against a brute-force version, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prosewright.llm import embedding, kernels, langid, line_dedup, minhash, mixing, packing, quality, shared, sharding, suffix_dedup, token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, words int"
rng = random.Random(3)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + ("." if i % 9 == 8 else "") + ("\n" if i % 31 == 30 else "") for i in range(n))


def edited(text, n, seed):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(VOCAB)
    return " ".join(w)


def corpus():
    texts = [prose(40 + 17 * (i % 13), i) for i in range(60)]
    texts += [texts[0], texts[0], texts[1]]
    texts += [edited(texts[2], 1, i) for i in range(30)] + [edited(texts[3], 4, i) for i in range(20)]
    texts += [texts[i] + "\n" + texts[5][:400] for i in (6, 7, 8)]
    texts += [None, "", " \n ", "one two", "one two", "a" * 3000, "x y " * 400, "é ü " * 30, "bad### " * 60, "LOUD!! " * 60]
    return [(i, t, "abcd"[i % 4] if i % 7 else None, None if i % 11 == 0 else f"s{i % 3 if i % 2 else 0}", 0, "x", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def roots(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def near(texts):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s = [grams(t) for t in texts]
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 10 * len(s[i] & s[j]) >= 8 * len(s[i] | s[j])]
    return roots(len(s), links)


def test_minhash(docs, rows, empty):
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    want = near([r[1] for r in rows])
    assert [got[i] for i in range(len(rows))] == want
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_large_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    base = prose(60, 99)
    texts = [edited(base, 1 + i % 6, i) for i in range(60)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(60)] == near(texts)


def test_minhash_bands_of_repeated_passages():
    texts = []
    for i in range(100):
        r = random.Random(1000 + i)
        w = [f"w{i}x{r.randrange(10**6)}" for _ in range(204)]
        passage = [f"p{i}x{j}" for j in range(30)]
        changed = [x if n not in (20, 60, 100, 140) else x + "z" for n, x in enumerate(w)]
        texts += [" ".join(w + passage), " ".join(changed + passage * 100)]
    sets = [set(zip(*(t.split()[j:] for j in range(5)), strict=False)) for t in texts]
    assert all(10 * len(a & b) >= 8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["row", "doc_id", "text"])
    bands = [set(x) for out in minhash.signatures([batch]) for x in out.column("bands").to_pylist()]
    assert sum(not a & b for a, b in zip(bands[::2], bands[1::2], strict=True)) <= 1


def test_probminhash_estimates():
    r = np.random.default_rng(0)
    a = r.integers(1, 1 << 43, 400).astype(np.uint64)
    b = np.concatenate([a[:300], r.integers(1, 1 << 43, 100).astype(np.uint64)])
    sig = minhash.probminhash(np.concatenate([a, b]), np.repeat([0, 1], 400), np.ones(800), 2, 1024)
    assert abs((sig[0] == sig[1]).mean() - 300 / 500) < 0.06


def line_brute(rows):
    first, occ = {}, []
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n") if t is not None else []):
            line = line.strip(" \t\r\x0b\x0c")
            if line:
                first.setdefault(line, (i, n))
                occ.append((i, n, line))
    lines = sorted(first, key=first.get)
    s = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    top = roots(len(lines), [(i, j) for i in range(len(s)) for j in range(i) if 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])])
    keep = {x: first[lines[top[i]]] for i, x in enumerate(lines)}
    gone = collections.defaultdict(list)
    for i, n, line in occ:
        if keep[line] != (i, n):
            gone[i].append(n)
    return gone


def test_line_dedup(docs, rows, empty):
    out, n_lines, gone = line_dedup.dedup_lines(docs)
    want = line_brute([r[:2] for r in rows])
    for r in out.collect():
        text = rows[r["doc_id"]][1]
        assert r[gone] == want[r["doc_id"]]
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in want[r["doc_id"]])
        assert (r["text"], r[n_lines], r["kept"]) == (kept, 0 if text is None else text.count("\n") + 1, "x")
    assert line_dedup.dedup_lines(empty)[0].count() == 0


def test_line_dedup_repeated_ids(spark):
    same = spark.createDataFrame([(1, "the same line of words"), (1, "the same line of words"), (None, "the same line of words")], "doc_id long, text string")
    assert sorted(r["text"] for r in line_dedup.dedup_lines(same)[0].collect()) == ["", "", "the same line of words"]


def test_line_dedup_long_words(spark):
    lines = ["https://example.com/a", "https://example.org/zzz", "1234567890123456", "1234567890129999", "key=" + "ab12" * 9, "key=ab12ab12" + "ff09" * 7]
    lines += ["今天的天气非常好我们一起去公园散步吧然后回家吃饭", "今天的天气非常好我们一起去图书馆看书吧晚上再写作业", "x" * 40 + "y" * 40]
    long = "https://example.net/" + "".join(chr(97 + i % 23) for i in range(300))
    texts = [*lines, long + "a", long + "b", "\n".join(lines)]
    out = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))[0]
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert [got[i] for i in range(len(lines) + 1)] == [*lines, long + "a"]
    assert got[len(lines) + 1] == "" and not got[len(lines) + 2].strip()


def test_packing(docs, rows, empty):
    got = packing.pack(docs, 100, 2, 40).collect()
    per = collections.defaultdict(list)
    size = collections.Counter()
    for r in got:
        size[r["doc_id"]] += r["size"]
        if r["bin"] is not None:
            per[r["bin"]].append(r)
    assert size == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    for parts in per.values():
        assert sum(r["size"] for r in parts) <= 100 and len({r["cluster"] for r in parts}) == len(parts)
        assert max(collections.Counter(r["source"] for r in parts if r["source"]).values(), default=0) <= 2
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["size"]
    assert packing.pack(empty).count() == 0


def test_packing_repeated_long_rows(spark, docs, tmp_path):
    def check(got, capacity):
        per = collections.defaultdict(list)
        for r in got:
            if r["bin"] is not None:
                per[r["bin"]].append(r)
        assert all(sum(r["size"] for r in parts) <= capacity and len({r["cluster"] for r in parts}) == len(parts) for parts in per.values())

    long = [(1, prose(250, 1), "a")] * 3 + [(2, prose(200, 2), None), (None, prose(250, 3), "b"), (None, prose(250, 3), "b")]
    got = packing.pack(spark.createDataFrame(long, "doc_id long, text string, source string").repartition(3), 100, 2, 40).collect()
    check(got, 100)
    assert len({r["bin"] for r in got if r["size"] == 100}) == 12 and sum(r["size"] for r in got) == 1450
    mixed = mixing.repeated(docs.filter("text is not null"))
    check(packing.pack(mixed, 100, 2, 40).collect(), 100)


def test_best_fit_is_the_tightest():
    r = random.Random(1)
    parts = sorted(((r.randint(1, 60), r.choice("abc"), r.randrange(30)) for _ in range(300)), key=lambda p: -p[0])
    bins = []
    seen = collections.Counter(p[2] for p in parts)
    for (size, s, c), (b, start, _) in zip(parts, packing.pack_cell(parts, 100, 2), strict=True):
        fits = [x for x in bins if x["left"] >= size and x["src"][s] < 2 and not (seen[c] > 1 and c in x["dup"])]
        if fits:
            assert bins[b]["left"] == min(x["left"] for x in fits) and bins[b] in fits
        else:
            assert b == len(bins)
            bins.append({"left": 100, "src": collections.Counter(), "dup": set()})
        assert start == 100 - bins[b]["left"]
        bins[b]["left"] -= size
        bins[b]["src"][s] += 1
        bins[b]["dup"].add(c)


def test_embedding_spread_out_vectors_are_not_copied_to_all_cells(spark, monkeypatch):
    monkeypatch.setattr(embedding, "CELL", 16)
    monkeypatch.setattr(embedding, "BLOCK", 64)
    dealt = []
    deal = embedding.dealer
    monkeypatch.setattr(embedding, "dealer", lambda p, c: dealt.append(sorted(p)) or deal(p, c))
    r = np.random.default_rng(6)
    spread, tight = r.normal(size=(400, 64)), np.eye(64)[np.arange(400) % 16] + r.normal(size=(400, 64)) * 0.01
    spread[300:] = spread[:100] + r.normal(size=(100, 64)) * 0.02
    vec, label = np.concatenate([spread, tight]).astype(np.float32), [0] * 400 + [1] * 400
    x = vec.astype(np.float64) / np.linalg.norm(vec.astype(np.float64), axis=1, keepdims=True)
    links = [(int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.93), strict=True) if i > j and label[i] == label[j]]
    top, n = roots(800, links), collections.Counter(k for p in links for k in p)
    df = spark.createDataFrame([(i, v, lab) for i, (v, lab) in enumerate(zip(vec.tolist(), label, strict=True))], "vec_id long, embedding array<float>, label int")
    got = {k["vec_id"]: (k["n_links"], k["component_id"]) for k in embedding.near_vectors(df).collect()}
    assert got == {i: (n[i], top[i]) for i in range(800)}
    assert dealt == [["1:64"]]


def test_embedding_strips_keep_components(monkeypatch):
    r = np.random.default_rng(7)
    monkeypatch.setattr(embedding, "STRIP", 100)  # a few rows each
    x = np.repeat(r.normal(size=(6, 8)), 10, axis=0)[r.permutation(60)] + r.normal(size=(60, 8)) * 0.12
    ids = r.permutation(60)
    rows = [("g", -1, 0, 1, int(k >= 30), int(ids[k]), 1, x[k].tolist()) for k in range(60)]
    t = pa.Table.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["grp", "cell", "i", "j", "side", "id", "mult", "vec"])
    out = pa.Table.from_batches(list(embedding.joiner(0.93)(iter(t.to_batches())))).to_pylist()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(int(ids[a]), int(ids[b])) for a in range(30) for b in range(30, 60) if u[a] @ u[b] >= 0.93]
    assert roots(60, [(k["id"], k["to"]) for k in out]) == roots(60, links)
    n = collections.Counter()
    for k in out:
        n[k["id"]] += k["links"]
    assert {k: v for k, v in n.items() if v} == collections.Counter(k for p in links for k in p)


@pytest.mark.parametrize("cell", [8, 10000])
def test_embedding(spark, monkeypatch, cell):
    monkeypatch.setattr(embedding, "CELL", cell)
    monkeypatch.setattr(embedding, "BLOCK", 16)
    r = np.random.default_rng(5)
    base = r.normal(size=(12, 6))
    vec = np.concatenate([base[i % 12] + r.normal(size=(1, 6)) * 0.2 * (i % 5) for i in range(150)]).astype(np.float32).tolist()
    vec += [vec[0], vec[0], [0.0] * 6, [float("nan")] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], None, [], [1.0, 2.0], [2.0, 4.0]]
    label = [None if i % 37 == 36 else i % 2 for i in range(len(vec))]
    label[150] = label[151] = label[0]
    label[-2] = label[-1] = 1
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and lab is not None for v, lab in zip(vec, label, strict=True)]
    cos = lambda a, b: np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))
    links = [(i, j) for i in range(len(vec)) for j in range(i) if ok[i] and ok[j] and label[i] == label[j] and len(vec[i]) == len(vec[j]) and cos(np.float64(vec[i]), np.float64(vec[j])) >= 0.93]
    top, n = roots(len(vec), links), collections.Counter(x for p in links for x in p)
    df = spark.createDataFrame([(i, v, lab) for i, (v, lab) in enumerate(zip(vec, label, strict=True))], "vec_id long, embedding array<float>, label int")
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in embedding.near_vectors(df).collect()}
    assert got == {i: (n[i], top[i], top[i] == i) for i in range(len(vec))}


def test_quality(docs, rows, empty):
    for r in quality.judge(docs).collect():
        t = rows[r["doc_id"]][1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        times = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = len({p for i in range(len(w) - 7) if times[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)})
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep)
        assert tuple(r[c] for c in quality.COUNTS) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * rep > 30 * len(w))
        assert r["kept"] == (r["failed_rule"] is None) and not (r["base_failed"] and r["kept"])
    kept = quality.select_clean(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
    assert quality.judge(empty).count() == 0


def test_quality_keeps_other_scripts():
    def kept(texts):
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        return (quality.cascade(quality.Texts(data, np.cumsum([0, *map(len, raw)])), list(quality.RULES)) < 0).tolist()

    words = ["сегодня мы идём в парк и потом домой", "σήμερα πάμε στο πάρκο και μετά σπίτι", "نذهب اليوم إلى الحديقة ثم نعود", "오늘 우리는 공원에 가서 산책 합니다", "𐐨𐐩𐐪 𐐫𐐬𐐭"]
    texts = [" ".join(f"{x}{i}" for i in range(15) for x in w.split()) + " IBM" for w in words]
    assert kept(texts) == [True] * len(words)
    loud = [" ".join(f"{x}{i}" for i in range(9) for x in w.split()) for w in ("TODAY WE ALL GO OUT", "ÉTÉ À LA PLAGE ÇA VA", "123 — … “4” 5 A")]
    assert kept(loud) == [False] * len(loud)


def test_quality_sql_in_other_scripts(spark):
    duckdb = pytest.importorskip("duckdb")
    words = ["привет мир IBM", "ΑΒΓ IBM ABC", "ŠČ XY ab", "Ａ Ｂ CDE", "\u212a \u212b ABC", "漢字 ABC", "ǅ ABCD", "ªº AB", "ÀÉ éà ABCDE", "ABC def"]
    texts = [" ".join(f"{w}{i}" for i in range(22)) for w in words]
    found = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(x) for x in enumerate(texts)])
    assert dict(con.execute(f"SELECT doc_id, kept FROM ({quality.ORACLE})").fetchall()) == found
    assert set(found.values()) == {True, False}


def test_shingles_of_lines_of_any_length_and_script(spark):
    piece, width = line_dedup.PIECE, line_dedup.WIDTH
    lines = ["a", "abcd", "abcde", "é漢𐐨zя", "é漢𐐨zя 漢字 😀 ok", *("".join(rng.choice("abé漢😀 ") for _ in range(n)) for n in (piece - 1, piece + 1, piece + 3, 2 * piece, 3 * piece + 5))]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    sizes = [r[0] for r in df.select(F.size(line_dedup.shingle_set(F.col("line")))).collect()]
    assert sizes == [len({x[i : i + width] for i in range(max(1, len(x) - width + 1))}) for x in lines]


def test_shingle_sets_without_interpreted_functions(spark):
    """The sets of two columns of lines, of lengths about those of windows and pieces; neither lambdas nor a shuffle of hashes."""
    r, piece, wide = random.Random(4), line_dedup.PIECE, line_dedup.WINDOW + line_dedup.WIDTH
    lines = ["a", "abcd", "abcde", "é漢𐐨zя 漢字 😀 ok", "ab" * 700]
    lines += ["".join(r.choice("abcdefghé漢😀 ") for _ in range(n)) for n in (wide - 2, wide - 1, wide, 2 * wide + 3, piece - 1, piece + 1, piece + 3, 2 * piece, 3 * piece + 5)]
    rows = [(i, x, lines[i - 1]) for i, x in enumerate(lines)]
    out = line_dedup.shingle_sets(spark.createDataFrame(rows, "id int, x string, y string").repartition(3, "id"), ["id"], ["x", "y"])
    plan = out._jdf.queryExecution().toString()
    assert "lambda" not in plan and plan.split("== Physical Plan ==")[1].count("Exchange") == 1
    got = {x["id"]: x for x in out.withColumns({f"same{i}": F.size(F.array_except(f"h{i}", line_dedup.shingle_set(F.col(c)))) for i, c in enumerate("xy")}).collect()}
    for i, x, y in rows:
        assert (got[i]["x"], got[i]["y"], got[i]["same0"], got[i]["same1"]) == (x, y, 0, 0)
        assert [len(got[i]["h0"]), len(got[i]["h1"])] == [len({z[j : j + 5] for j in range(max(1, len(z) - 4))}) for z in (x, y)]


def test_bands_begin_at_each_range(spark):
    r, size = random.Random(8), (1 << 64) // line_dedup.RANGES
    sets = [sorted({r.randrange(-(1 << 63), 1 << 63) for _ in range(n)}) for n in (1, 2, 7, 33, 40, 41, 300)] + [[-(1 << 63), 0, 1 << 61]]
    got = line_dedup.band_keys(spark.createDataFrame(list(enumerate(sets)), "i int, h array<long>")).collect()
    for row in got:
        h = sets[row["i"]]
        some = {(x + (1 << 63)) // size for x in h}
        few, more = len(h) <= line_dedup.FEW, len(h) * 100 > line_dedup.FEW * line_dedup.SIMILARITY
        want = [few and k in some for k in range(line_dedup.RANGES)] + [more and k in some for k in range(line_dedup.RANGES)]
        assert row["n"] == len(h) and [row[f"k{j}"] is not None for j in range(line_dedup.BANDS)] == want


def test_cascade_order_changes_no_verdict(rows):
    raw = [(r[1] or "").encode() for r in rows]
    off = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    names = list(quality.RULES)
    a = quality.cascade(quality.Texts(data, off), names) < 0
    assert (a == (quality.cascade(quality.Texts(data, off), names[::-1]) < 0)).all()


def test_frames_round_trip():
    r = np.random.default_rng(2)
    ids = np.where(r.random(5000) < 0.05, r.integers(0, 1 << 32, 5000), r.integers(7, 900, 5000)).astype(np.uint32)
    for n in (0, 1, 127, 128, 5000):
        frame = token_files.encode_frame(np.arange(1), np.array([n]), ids[:n])
        pos = [0]

        def read(k, frame=frame, pos=pos):
            pos[0] += k
            return frame[pos[0] - k : pos[0]]

        assert (token_files.decode_frame(read)[2] == ids[:n]).all() and token_files.decode_frame(read) is None


def test_token_files(docs, rows, spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    extra = ["A\x1cb \x85 c", "Don't I'll we'RE <|endoftext|> x", "ΣΑΣ İx É é ﬁ", "a1b2,c"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    got = token_files.read_files(token_files.write_files(docs.select("doc_id", "text").unionByName(more), P.path("word_bpe_49k.json"))).orderBy("doc_id").collect()
    at = 0
    for r, t in zip(got, [x[1] for x in rows] + extra, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_of_another_tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts = ["Hello  world, it's\n fine", "", None, "x " * 50]
    assert token_files.WordEncoder(P.path("word_bpe_49k.json")).direct
    enc, tok = token_files.WordEncoder(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids, n = enc.encode(texts)
    assert not enc.by_words and ids.tolist() == [i for t in texts for i in tok.encode(t or "", add_special_tokens=False).ids] and n.sum() == len(ids)


def odd_rows(spark):
    """Null and repeated doc_ids, repeated rows, ties, empty and long texts, and columns whose names operators use themselves."""
    a, b = prose(120, 501), prose(130, 502)
    rows = [(1, a), (1, b), (2, a), (3, b), (None, a), (None, a), (None, None), (4, None), (4, ""), (5, "x" * 70_000), (6, "y " * 30_000), (7, prose(30_000, 503))]
    more = "_row long, row long, id long, key string, h string, line string, words int, bin int, size int, kept string, copies int, sk string"
    extra = (None, 1, 1, "k", "h", "l", 1, 1, 1, "x", 1, "s")
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", *extra) for i, t in rows], f"doc_id long, text string, lang string, source string, {more}"), rows


def test_odd_rows_minhash(spark):
    df, rows = odd_rows(spark)
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    per = collections.Counter((r["doc_id"], r["class_id"], r["kept"]) for r in got)
    # (1, a), (2, a) and two rows without an id are one class, (1, b) and (3, b) another; each class has doc_id 1
    assert per[(1, 1, True)] == 2 and per[(2, 1, False)] == 1 and per[(3, 1, False)] == 1 and per[(None, 1, False)] == 2
    assert per[(None, None, True)] == 1 and per[(4, 4, True)] == 2 and per[(5, 5, True)] == per[(6, 6, True)] == per[(7, 7, True)] == 1
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and collections.Counter(r["text"] for r in kept.collect()) == {t: 1 for t in {t for _, t in rows if t}} | {None: 2, "": 1}


def test_odd_rows_elsewhere(spark, tmp_path):
    df, rows = odd_rows(spark)
    n = len(rows)
    out, n_lines, gone = line_dedup.dedup_lines(df)
    got = out.collect()
    assert len(got) == n and set(df.columns) <= set(out.columns) and sum(r[n_lines] - len(r[gone]) for r in got if r["text"] is not None) == sum(len({x for x in t.split("\n") if x.strip()}) for t in {t for _, t in rows if t}) + 1 + sum(not x.strip() for _, t in rows if t for x in t.split("\n"))
    assert packing.pack(df).agg(F.sum("size")).first()[0] == sum(len((t or "").split()) for _, t in rows)
    assert quality.judge(df).count() == n and quality.select_clean(df).columns == df.columns
    assert mixing.mix(df).count() == n and mixing.repeated(df).columns == df.columns
    shard = sharding.shards(df).collect()
    assert len(shard) == n and sorted(r["byte_start"] for r in shard) == [sum(sorted_sizes) for sorted_sizes in accumulated(sorted(shard, key=lambda r: r["byte_start"]))]
    assert langid.identify(df).count() == n and suffix_dedup.remove_repeats(df).count() == n
    import corpus_pipeline

    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    df.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def accumulated(rows):
    return [[r["size"] for r in rows[:i]] for i in range(len(rows))]


def test_mixing_repeated_rows(spark):
    rows = [(1, "a b c d e f g h i j", "x")] * 7 + [(2, " ".join("abcdefghij" * 14), "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = collections.Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"]] += r["taken"]
    got = collections.Counter()
    for r in mixing.repeated(df).collect():
        got[r["doc_id"]] += len(r["text"].split())
    assert got == want and want[1] > 0


def test_sharding_last_row(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 200_000).alias("text")).unionByName(spark.createDataFrame([(300, "")], "doc_id long, text string"))
    got = sharding.shards(df).collect()
    assert {r["shard"] for r in got} == set(range(24)) and max(r["shard"] for r in got if r["doc_id"] == 300) == 23
    wide = spark.createDataFrame([(0, 10**14), (1, 8)], "doc_id long, size long")
    end = wide.select(((F.lit(10**14).cast("decimal(30,0)") * 2 + 8) * F.lit(24).cast("decimal(6,0)")).cast("decimal(38,0)").alias("m"), F.lit(2 * (10**14 + 8)).cast("decimal(31,0)").alias("t"))
    assert end.selectExpr("cast(m div t as int) AS s").first()["s"] == 23


def test_line_recall(spark):
    """Lines of a corpus of prose with one or two characters changed: links are found as brute force finds them."""
    r, rows = random.Random(11), []
    for i in range(250):
        line = prose(r.randint(6, 40), 3000 + i).replace("\n", " ")
        at = r.randrange(len(line) - 1)
        rows += [line, line[:at] + "#" + line[at + 1 :], line[:at] + line[at + 1 :] + " z"]
    out, _, gone = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    got = {x["doc_id"] for x in out.collect() if x[gone]}
    want = set(line_brute(list(enumerate(rows))))
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 200


def test_line_blocks_compare_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    lines = [f"the line number {i // 3} of a text {'x' * (i % 3)}, with some more words" for i in range(20)]
    found = spark.createDataFrame([(i, x, 0) for i, x in enumerate(lines)], "id long, line string, n int")
    left = spark.createDataFrame([(7, i, i, len(lines)) for i in range(20)] + [(8, i, i, 3) for i in (0, 1, 19)], "key long, id long, comp long, n long")
    got = collections.Counter(tuple(sorted(r)) for r in line_dedup.block_verifier(shared.Cuts(spark), found)(left).collect())
    cut = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    want = {(i, j) for j in range(20) for i in range(j) if len(cut[i] & cut[j]) * 100 >= len(cut[i] | cut[j]) * 80}
    assert len(want) > 20 and got == collections.Counter([*want, *(p for p in want if p in {(0, 1), (0, 19), (1, 19)})])


def test_frequent_keys():
    r = np.random.default_rng(0)
    often = suffix_dedup.Frequent()
    often.KEYS = 50
    keys = np.concatenate([r.integers(0, 1 << 40, 20_000), np.full(900, 7)]).astype(np.uint64)
    r.shuffle(keys)
    for part in np.array_split(keys, 40):
        often.add(part)
    assert 900 - len(keys) / 51 <= often.count[often.key == 7][0] <= 900


def test_langid_kernel():
    """Hashed presence against exact sets of n-grams: the kernel and the predicted language agree."""
    r = random.Random(5)
    alphabet = {"en": "abcdef ", "de": "efghij ", "fr": "ijklma "}
    texts = [(k, "".join(r.choice(alphabet[k]) for _ in range(r.randint(40, 200)))) for i in range(60) for k in alphabet]
    raw = [t.encode() for _, t in texts]
    p = langid.presence(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    sets = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in raw]
    exact = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    x = langid.normal(p)
    assert np.abs(x @ x.T - exact).max() < 0.06
    near = lambda k: [texts[max((j for j in range(len(texts)) if j != i), key=lambda j: k[i, j])][0] for i in range(len(texts))]
    assert sum(a == b for a, b in zip(near(x @ x.T), near(exact), strict=True)) >= 0.98 * len(texts)


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    per = {r["source"]: (r["source_size"], r["target"]) for r in got}
    order = sorted(per, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, want = sum(v[0] for v in per.values()), {}
    while True:
        open_ = [s for s in per if s not in want]
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * per[s][0]]
        if not over:
            want |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            want[s] = 3.0 * per[s][0]
            left -= want[s]
    for s in per:
        taken = sum(r["taken"] for r in got if r["source"] == s)
        assert per[s][1] == pytest.approx(want[s]) and abs(taken - want[s]) <= max(r["size"] for r in got if r["source"] == s)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    again = collections.Counter(r["doc_id"] for r in mixing.repeated(docs).collect())
    assert again == {r["doc_id"]: r["copies"] for r in got if r["copies"]}
    assert mixing.mix(empty).count() == 0


def repeats(texts, length=200):
    at = collections.Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        at.update(b[s : s + length] for s in range(len(b) - length + 1))
    for b in raw:
        on = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if at[b[s : s + length]] > 1:
                on[s : s + length] = b"\1" * length
        yield b, on


@pytest.mark.parametrize("wide", [2048, 1])
def test_suffix_dedup(docs, rows, empty, monkeypatch, wide):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    for i, (b, on) in enumerate(repeats([r[1] for r in rows])):
        kept = bytes(c for c, x in zip(b, on, strict=True) if not x)
        spans = len(re.findall(b"\1+", bytes(on)))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(b), sum(on), spans, kept)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_repeated_ids(spark):
    text = prose(80, 1)
    same = spark.createDataFrame([(1, text), (1, text), (None, prose(80, 2))], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in suffix_dedup.remove_repeats(same).collect()) == [0, len(text), len(text)]


@pytest.mark.parametrize("length", [1, 2, 3, 7, 20])
def test_interval_expansion(length):
    r = np.random.default_rng(length)
    text = np.concatenate([r.integers(2, 5, 400), r.integers(2, 30, 200)])
    text = np.concatenate([text, text[50:120], text[300:340], [0]]).astype(np.uint16)
    hit = suffix_dedup.repeated_starts(text, length)
    b = [tuple(text[s : s + length]) for s in range(len(text) - length)]
    times = collections.Counter(b)
    assert [bool(x) for x in hit[: len(b)]] == [times[x] > 1 for x in b]


def test_langid(spark, empty):
    alphabet = {"en": "abcdef", "de": "efghij", "fr": "ijklma"}
    rows = []
    for i in range(400):
        lang = list(alphabet)[i % 3]
        r = random.Random(i)
        rows.append((i, " ".join("".join(r.choice(alphabet[lang]) for _ in range(5)) for _ in range(20)), lang))
    rows += [(400, None, "en"), (401, "12 !?", "en"), (402, "", None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in range(400) if got[i]["held_out"]} == set(held)
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) > 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (400, 401, 402)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(empty).count() == 0


def test_sharding(docs, rows, empty):
    got = sorted(sharding.shards(docs, 5).collect(), key=lambda r: r["doc_id"])
    size = [len((t or "").encode()) + 8 for _, t, *_ in rows]
    total, before, seen = sum(size), 0, collections.Counter()
    for r, (i, t, *_), s in zip(got, rows, size, strict=True):
        shard = (2 * before + s) * 5 // (2 * total)
        assert (r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) == (i, s, zlib.crc32((t or "").encode()), shard, seen[shard])
        before += s
        seen[shard] += 1
    assert sharding.shards(empty).count() == 0


def test_rolling_hash_depends_on_content_only():
    data = np.frombuffer(b"abcabcabd" * 3, np.uint8)
    roll = kernels.Rolling(data)
    h = roll.spans(np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert h[0] == h[1] != h[2]


def test_pipeline(spark, docs, rows, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "mixing", "best_fit_packing"]
    clean = {r["doc_id"]: r["text"] for r in quality.judge(docs).filter("kept").join(docs, "doc_id").select("doc_id", "text").collect()}
    gone = line_brute(sorted(clean.items()))
    left = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in clean.items()}
    left = {i: t for i, t in left.items() if not gone[i] or t.strip()}
    ids = sorted(left)
    one = {ids[i] for i, top in enumerate(near([left[i] for i in ids])) if top == i}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    words = lambda i: len(left[i].split())
    assert {r["doc_id"] for r in out} <= one
    total = collections.Counter()
    for r in out:
        total[r["doc_id"]] += r["size"]
    assert all(n % words(i) == 0 and n <= 3 * words(i) for i, n in total.items() if words(i))
    assert abs(sum(total.values()) - sum(map(words, one))) <= 4 * max(map(words, one))
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0" and out[0]["size"] <= packing.CAPACITY


def test_long_text_in_all(spark):
    long = spark.createDataFrame([(0, prose(60000, 4), "en", "s")], "doc_id long, text string, lang string, source string")
    assert suffix_dedup.remove_repeats(long).first()["n_removed"] == 0
    assert quality.judge(long).first()["n_words"] == 60000
    assert packing.pack(long).agg(F.sum("size")).first()[0] == 60000
