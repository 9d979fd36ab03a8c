import random
import zlib
from itertools import pairwise

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from llm import byte_bpe, jaccard_join, language_id, line_dedup, packing, pretokens, quality_classifier, quality_rules, substring_dedup, suffix_dedup, topk
from llm.common import map_text, scratch_dir
from llm.graph import components

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [(901, None), (902, ""), (903, " \n\t"), (904, "one"), (905, "One two"), (906, "é" * 75), (907, "word " * 3000), (907, "word " * 3000), (908, "\x00\x01 nul"), (909, "ab" * 150), (910, "\n\nx\n\n"), (911, "a <|endoftext|> b<|endoftext|>")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], SCHEMA).repartition(3)


def got(df):
    return sorted(map(tuple, df.collect()))


def texts(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def spliced(alphabet, joiner, seed, n=150):
    """Texts made of shared passages, with unique ones between, and runs of one word."""
    r = random.Random(seed)
    base = [[r.choice(alphabet) for _ in range(r.choice([40, 90, 130, 300]))] for _ in range(15)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randrange(1, 4)):
            q = r.choice(base)
            at = r.randrange(len(q))
            w += q[at : at + r.randrange(20, 250)]
            if r.random() < 0.5:
                w += [f"u{r.randrange(10**9)}" for _ in range(r.randrange(12))]
            if r.random() < 0.1:
                w += [alphabet[0]] * r.randrange(150)
        rows.append((i, joiner.join(w)))
    rows += [rows[3], rows[3], (500, rows[7][1])]
    r.shuffle(rows)
    return rows


def test_quality_rules(spark, sf):
    rows = texts(spark, sf) + EDGES
    out = {r["doc_id"]: r for r in quality_rules.apply_rules(frame(spark, rows)).collect()}
    for i, t in rows:
        want = brute.base_counts(t)
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == brute.judged(t), i
    clean = "This is a sentence of plain words that ends well.\n" + "Another one follows it, and says something else.\n" * 1
    # lines that end in letters beyond ASCII, and notices in four languages
    body = "Words that differ, one after another, number {}, and end as they should.\n"
    plain = "".join(body.format(k) for k in range(5))
    more = ["café", "«café»", "été", "中文", "Σ", "Alle Rechte vorbehalten.", "Haut de page : cliquez ici pour y aller.", "Todos los derechos reservados.", "Released under the MIT License."]
    rows = [(k, plain + f"{line}\n" * 1 + f"{line} {line}\n" + f"{line} {k}\n" * 1) for k, line in enumerate(more)]
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(frame(spark, rows)).collect()}
    assert [got[k]["kept"] for k in range(len(rows))] == [brute.judged(t) for _, t in rows]
    assert [got[k]["failed_boilerplate"] for k in range(5, 9)] == [3] * 4
    assert [got[k]["failed_punctuation"] for k in range(5)] == [3, 1, 3, 1, 3]
    rows = [(1, "Home | News | Contact | About us\n" + clean), (2, "Home | News | Contact | About"), (3, None)]
    assert {r["doc_id"]: r["text"] for r in quality_rules.clean_text(frame(spark, rows)).collect()} == {1: clean.rstrip("\n"), 2: "", 3: None}


def test_packing(spark, sf):
    rows = texts(spark, sf)[:40] + EDGES
    out = packing.pack_documents(frame(spark, rows)).toPandas()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 1024))]
    assert sorted(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy())) == sorted(want)
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert (own["offset"].to_numpy() == np.concatenate([[0], own["length"].cumsum()[:-1]])).all() and own["length"].sum() <= 1024
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 1024) + 2


def test_packing_without_broadcast(spark, sf):
    cut = packing.saved(packing.pieces(frame(spark, texts(spark, sf)[:40] + EDGES).repartition(3), public_tokenizers.path("byte_bpe_50k.json")))
    small, large = packing.pack(cut), packing.pack(cut, broadcast_rows=0)
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(small) and "SortMergeJoin" in plan(large) and "Broadcast" not in plan(large)
    assert got(small) == got(large)


def test_plans_of_bins():
    r = random.Random(1)
    for _ in range(20):
        counts = {r.randrange(1, 101): r.randrange(1, 50) for _ in range(r.randrange(1, 30))}
        plan = packing.make_plan(counts, 100)
        fill = {}
        for length, n in counts.items():
            bins, at = plan.place(np.full(n, length), np.arange(n))
            for b, o in zip(bins, at, strict=True):
                fill.setdefault(int(b), []).append((int(o), length))
        assert sorted(fill) == list(range(plan.bins))
        for own in fill.values():
            own.sort()
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(own)) and sum(n for _, n in own) <= 100
    assert packing.make_plan({60: 10, 40: 10}, 100).bins == 10
    assert packing.fullest({7: 3, 5: 2}, 19) == {7: 2, 5: 1}


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = spliced(list("abcé \n"), "", 5) + EDGES
    assert got(suffix_dedup.dedup(frame(spark, rows))) == brute.removed_bytes(rows)


def test_removed_repeats_leave_whole_characters(spark):
    rows = [(1, "é" * 60 + "x"), (2, "y" + "é" * 60), (3, "clean"), (4, None)]
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert out[3]["text"] == "clean" and out[4]["text"] is None and out[2]["text"] == "y" and out[2]["n_chars"] == 1
    assert list(out[1].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_line_dedup(spark):
    rows = [(i, "menu\nown %d\n \n" % i, "en", "a" if i < 20 else "b", 5) for i in range(40)] + [(50, "menu\nx", "en", None, 6), (51, None, "en", "a", None)]
    out = {r["doc_id"]: r for r in line_dedup.dedup_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[3]["text"] == "own 3\n \n" and out[3]["n_chars"] == 8 and out[50]["text"] == "menu\nx" and out[51]["text"] is None
    # the ratio decides on small hosts too, but one page by itself repeats nothing
    few = line_dedup.dedup_documents(spark.createDataFrame(rows[:3], SCHEMA))
    assert sorted(r["text"] for r in few.collect()) == [f"own {k}\n \n" for k in range(3)]
    assert line_dedup.dedup_documents(spark.createDataFrame(rows[:1], SCHEMA)).first()["text"].startswith("menu")


def test_line_dedup_by_salt(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "menu\nown %d" % i, "en", "a", 5) for i in range(30)], SCHEMA)
    want = got(line_dedup.dedup_documents(rows))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert got(line_dedup.dedup_documents(rows)) == want


def test_hosts(spark):
    urls = ["https://u@Www.Example.org:80/a", "ftp://x.y", "no url", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(line_dedup.host_of(F.col("u")))
    assert [r[0] for r in df.collect()] == ["www.example.org", "x.y", None, None]


def test_topk(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 8)).astype("float32")
    x[40:90] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 8), (903, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    own = topk.integers(df)
    n = np.floor(1024 * x.astype(float)).astype(np.int64)
    want = []
    for q in range(0, 300, 20):
        scores = n @ n[q]
        order = [i for i in np.lexsort((np.arange(300), -scores)) if i != q][:10]
        want += [(q, k + 1, i, scores[i]) for k, i in enumerate(order)]
    assert got(topk.search(own.where("vec_id % 20 = 0"), own)) == sorted(want)
    assert topk.search(own.where("vec_id < 0"), own).count() == 0
    few = topk.integers(df.where("vec_id < 5"))
    assert topk.search(few, few).count() == 20


def test_bpe(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    v = byte_bpe.Vocabulary.load(path)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    rows = texts(spark, sf)[:60] + EDGES
    out = {r["doc_id"]: r for r in byte_bpe.round_trip(frame(spark, rows), path).collect()}
    for i, t in rows:
        ids = ref.encode_ordinary(t or "")
        assert (out[i]["n_tokens"], out[i]["ids_sha256"]) == (len(ids), brute.sha(" ".join(map(str, ids)).encode()))
        assert out[i]["decoded_sha256"] == out[i]["text_sha256"] == brute.sha((t or "").encode())
    t = byte_bpe.Transducer(v)
    r = random.Random(2)
    for _ in range(400):
        raw = bytes(r.choice(b"aeht n\xc3\xa9\xff") for _ in range(r.randrange(20)))
        assert [v.tokens[i] for i in t.encode(raw)] == v.merge(raw)


def test_splitting():
    assert pretokens.PATTERN == public_tokenizers.PATTERN
    import pyarrow as pa
    import regex

    from llm.common import utf8

    r = random.Random(4)
    parts = ["a", "s", "re", "ll", "é", "日", "١", "1", " ", "  ", "\n", "\xa0", "　", "'", "'s", "'re", "''", "!", "😀", "\r\n", " '"]
    own = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(4000)]
    data, off = utf8(pa.array(own))
    start = pretokens.split(data, off).tolist()
    cut = [data.tobytes()[a:b].decode() for a, b in zip(start, [*start[1:], len(data)], strict=True)]
    assert cut == [m for t in own for m in regex.findall(pretokens.PATTERN, t)]


def test_streaming_decode():
    for raw in ("é日😀a".encode(), b"\xe6\x97", b"a\xffb\xf0\x9f\x98", b"\xed\xa0\x80x", b"\xc3\xc3\xa9"):
        for size in (1, 2, 3):
            s = byte_bpe.Utf8Stream()
            assert "".join(s.feed(raw[i : i + size]) for i in range(0, len(raw), size)) + s.close() == raw.decode("utf-8", "replace")


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    out = quality_classifier.op7_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = out[out["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95 and out["score"].between(0, 1).all()
    none = quality_classifier.classify(frame(spark, EDGES), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in none.collect()} == {0.5} and none.count() == len(EDGES)
    good = quality_classifier.keep_good(frame(spark, EDGES), spark.createDataFrame([(904, 1)], "doc_id long, quality int"))
    assert good.count() == len(EDGES) and good.columns == SCHEMA.replace(",", "").split()[::2]


def test_language_id(spark):
    sf = "/root/testdata/sf0.01"
    out = language_id.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (out["lang"] == out["lang_pred"])[out["held_out"]].mean() > 0.95
    odd = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(frame(spark, [(1, None), (2, ""), (3, "12 !"), (4, "the words")]), {"en": b"the words"}).collect()}
    assert odd == {1: "und", 2: "und", 3: "und", 4: "en"}
    assert language_id.dictionaries(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}


def test_dictionaries_see_whole_texts(spark):
    rows = [(i, "header " * 200 + f"body{'abcdefghij'[i % 10]} " * 600, "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = language_id.dictionaries(docs, 20_000)["en"].decode()
    assert "header" in own and sum(f"body{x}" in own for x in "abcdefghij") > 4 and len(own) == 20_000
    assert language_id.dictionaries(docs.repartition(7), 20_000) == language_id.dictionaries(docs.coalesce(1), 20_000)
    assert language_id.dictionaries(docs.limit(1).withColumn("text", F.lit(""))).keys() == {"en"}


def test_substring_dedup(spark):
    rows = spliced([f"w{i}" for i in range(4)], " ", 6) + spliced([f"v{i}" for i in range(5000)], "\n", 7, 60) + EDGES
    rows = [(i + 1000 * (k > 152), t) if k < 216 else (i, t) for k, (i, t) in enumerate(rows)]
    assert got(substring_dedup.dedup(frame(spark, rows))) == brute.removed_words(rows)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(spark, size, percent):
    r = random.Random(3)
    base = [[f"w{r.randrange(10**6)}" for _ in range(r.choice([4, 8, 12, 14, 20, 25, 40, 90, 200]))] for _ in range(40)]
    rows = []
    for i in range(300):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = f"x{r.randrange(50)}"
        rows.append((i, r.choice([" ", "\n"]).join(w)))
    rows += EDGES
    assert got(jaccard_join.join_documents(frame(spark, rows), size, percent)) == brute.components(rows, size, percent)


def test_jaccard_keeps_one_of_each(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (9, "other words stand here"), (7, None), (8, None)]
    assert sorted(r["doc_id"] for r in jaccard_join.one_of_each(frame(spark, rows)).collect()) == [3, 7, 8, 9]


def test_jaccard_links_rows_without_id(spark):
    w = [f"w{k}" for k in range(80)]
    # a and c differ by more than the bound allows, and link only by b, which has no doc_id; light sets alike
    a, b, c = w, [*w[:-3], "x", "y", "z"], ["p", "q", "r", *w[3:-3], "x", "y", "z"]
    rows = [(1, " ".join(a)), (None, " ".join(b)), (3, " ".join(c)), (None, "u " * 5 + " ".join(w[::-1])), (None, " ".join(w[::-1])), (8, "other")]
    out = jaccard_join.join_documents(frame(spark, rows)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, 1), (None, 1), (3, 1), (None, None), (None, None), (8, 8)], key=str)
    assert sorted((r["doc_id"] for r in jaccard_join.one_of_each(frame(spark, rows), 3, 90).collect()), key=str) == [1, 8, None, None, None]


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (2, 3), (7, 7), (500, 3)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**dict.fromkeys(range(100, 141), 100), 1: 1, 2: 1, 3: 1, 500: 1}


def test_empty_tables(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert quality_rules.apply_rules(e).count() == 0
    assert packing.pack_documents(e).count() == 0
    assert suffix_dedup.dedup(e).count() == suffix_dedup.remove_repeats(e).count() == 0
    assert line_dedup.dedup_documents(e).count() == 0
    assert byte_bpe.round_trip(e, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0
    assert quality_classifier.classify(e, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert language_id.identify(e, {}).count() == 0
    assert substring_dedup.dedup(e).count() == 0
    assert jaccard_join.join_documents(e).count() == 0


def test_clashing_columns(spark):
    own = frame(spark, [(1, "a b c d"), (2, "a b c d"), (3, "x")])
    odd = own.withColumns({c: F.lit(1) for c in ("row", "v", "n", "first", "last", "name", "_id", "code", "key", "root", "component_id", "pos", "at", "rest", "_host", "_kept", "__x")})
    assert got(jaccard_join.join_documents(odd)) == got(jaccard_join.join_documents(own))
    assert got(suffix_dedup.dedup(odd)) == got(suffix_dedup.dedup(own))
    assert got(substring_dedup.dedup(odd)) == got(substring_dedup.dedup(own))
    assert got(quality_rules.apply_rules(odd)) == got(quality_rules.apply_rules(own))
    assert suffix_dedup.remove_repeats(odd).columns == odd.columns
    assert line_dedup.dedup_documents(odd).columns == odd.columns
    assert jaccard_join.one_of_each(odd).columns == odd.columns


def test_pieces_do_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    count = lambda piece, data, off: {"doc_id": piece.column("doc_id"), "n": np.diff(off)}
    small, large = (map_text(docs.select("doc_id", "text"), count, "doc_id long, n long", limit=k) for k in (10, 1 << 22))
    assert got(small) == got(large)
    assert pd.DataFrame(got(small))[1].sum() == docs.select(F.sum(F.octet_length("text"))).first()[0]


def test_texts_of_one_id(spark):
    """Rows of one doc_id with different texts are one document whose strings start in any of them."""
    r = random.Random(8)
    long = "".join(r.choice("abcdefgh") for _ in range(700))
    rows = [(1, long), (1, "zz" + long[:300]), (2, long[100:400]), (1, "short"), (2, "q" * 350), (3, long[650:] + long[:260])]
    assert got(suffix_dedup.dedup(frame(spark, rows))) == brute.removed_bytes(rows)
    docs = frame(spark, rows)
    assert suffix_dedup.remove_repeats(docs).count() == len(rows)
    assert quality_classifier.keep_good(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).columns == docs.columns
    assert jaccard_join.join_documents(docs).count() == len(rows)


def test_topk_of_empty_and_huge_vectors(spark):
    rows = [(0, []), (1, []), (2, [1.0]), (3, [1e30, 1.0]), (4, [3e38, -1.0]), (5, [-3e38, 2.0]), (6, [1e9, 7.0]), (7, [1e9 + 64, -3.0])]
    df = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = {r["vec_id"]: [int(v) for v in r["x"]] for r in df.collect()}
    assert whole[3] == [int(1e30 * 1024), 1024]
    most, want = (1 << 63) - 1, []
    for q, x in whole.items():
        scores = {v: max(-most - 1, min(most, sum(a * b for a, b in zip(x, y, strict=False)))) for v, y in whole.items() if v != q}
        want += [(q, k + 1, v, scores[v]) for k, v in enumerate(sorted(scores, key=lambda v: (-scores[v], v)))]
    assert got(topk.search(df, df)) == sorted(want)
    none = topk.integers(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.search(none, none).count() == topk.search(df, none).count() == 0
    only = df.where("vec_id < 2")
    assert got(topk.search(only, only)) == [(0, 1, 1, 0), (1, 1, 0, 0)]


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace as N

    empty = N(isEmpty=lambda: True)
    cluster = N(conf=N(get=lambda *_: None), sparkContext=N(master="spark://host:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: empty))))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(cluster)


def test_matches_of_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    from llm.common import utf8

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = ["some words and more words", "", "others 12 !! words", "x <|endoftext|> y", "some words"]
    want = [list(map(int, i)) for i in _ids(packing.Encoder(path), *utf8(pa.array(own)))]
    strong = pretokens.byte_hash
    monkeypatch.setattr(pretokens, "byte_hash", lambda data: lambda s, e: strong(data)(s, e) % np.uint64(7))
    e = packing.Encoder(path)
    assert [list(map(int, i)) for i in _ids(e, *utf8(pa.array(own)))] == want == [list(map(int, i)) for i in _ids(e, *utf8(pa.array(own)))]
    assert want == [e.library.encode(t, add_special_tokens=False).ids for t in own]


def _ids(encoder, data, off):
    ids, at = encoder.encode(data, off)
    return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def test_discriminant_against_densities(spark):
    """Scores of all documents, from covariances and determinants in full."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    x = {r["doc_id"]: np.array(r["x"]) for r in quality_classifier.features(docs).collect()}
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    learnt = [i for i in x if label.get(i) is not None and zlib.crc32(str(i).encode()) % 5]
    groups = [np.array([x[i] for i in learnt if label[i] == k]) for k in (0, 1)]
    n, p = len(learnt), len(groups[0][0])
    within = sum(len(g) * np.cov(g.T, bias=True) for g in groups) / n
    logs = []
    for g in groups:
        a = min(1.0, 0.1 + p / (p + len(g)))
        cov = (1 - a) * np.cov(g.T, bias=True) + a * np.diag(np.diag(within)) + 1e-3 * np.eye(p)
        logs.append({i: np.log(len(g) / n) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (v - g.mean(0)) @ np.linalg.solve(cov, v - g.mean(0)) for i, v in x.items()})
    out = quality_classifier.classify(docs, labels).collect()
    for r in out:
        i = r["doc_id"]
        want = 1 / (1 + np.exp(np.clip(logs[0][i] - logs[1][i], -500, 500)))
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert {r["doc_id"] for r in quality_classifier.keep_good(docs, labels).collect()} == {r["doc_id"] for r in out if r["predicted"]}


def test_statistics_by_hand():
    import pyarrow as pa

    from llm.common import utf8

    t = "Go on, go! A | B\n\nGo on, go! A | B\né 12"
    x = dict(zip(quality_classifier.FEATURES, quality_classifier.statistics(*utf8(pa.array([t])))[0], strict=True))
    w = brute.WORD.findall(t)
    chars = sum(map(len, w))
    rate = lambda k, of: np.log((k + 0.5) / (of + 10.0))
    assert np.isclose(x["words"], np.log1p(len(w))) and np.isclose(x["word_length"], np.log((chars + 50) / (len(w) + 10)))
    assert np.isclose(x["exclamations"], rate(2, len(w))) and np.isclose(x["digits"], rate(2, len(w))) and np.isclose(x["repeated_lines"], rate(1, 3))
    assert np.isclose(x["repeats"], rate(brute.base_counts(t)[4], len(w))) and np.isclose(x["commas"], rate(2, len(w)))


def test_languages_against_plain_compression(spark):
    import zstandard

    content = {"a": b"one two three four five " * 40, "b": b"uno dos tres cuatro cinco " * 40, "c": b"one two three four five " * 40}
    rows = [(1, "ONE two, three 3 four!"), (2, "Cinco cuatro tres"), (3, "five " * 9000 + "dos"), (4, "zzz"), (5, "!!"), (6, None)]
    out = {r["doc_id"]: r for r in language_id.identify(frame(spark, rows).withColumns({"lang_pred": F.lit("x"), "score": F.lit(1)}), content).collect()}
    for i, t in rows:
        small = " ".join("".join(c.lower() if c.isalpha() else " " for c in t or "").split()).encode()
        sizes = {}
        for lang, raw in content.items():
            own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=6)
            c = zstandard.ZstdCompressor(level=6, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(small[k : k + 16384])) for k in range(0, len(small), 16384))
        # a tie goes to the language that sorts first, and is a narrow margin
        want = min(sizes, key=lambda x: (sizes[x], x)) if small else "und"
        assert out[i]["lang_pred"] == want, i
        assert out[i]["rejected"] == (not small or sorted(sizes.values())[1] - min(sizes.values()) < 0.01 * min(sizes.values()))


def test_clashing_columns_of_the_others(spark):
    own = frame(spark, [(1, "a b c d"), (2, "Some words. They stand here."), (3, None)])
    odd = own.withColumns({c: F.lit(1) for c in ("x", "score", "label", "held_out", "ids", "block", "local", "length", "piece", "lang_pred", "rest", "row", "quality", "rank")})
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    own_pieces, odd_pieces = (packing.pack_documents(d).select("doc_id", "piece", "start", "length", "ids_crc32") for d in (own, odd))
    assert got(odd_pieces) == got(own_pieces)
    assert got(byte_bpe.round_trip(odd, path)) == got(byte_bpe.round_trip(own, path))
    assert got(quality_classifier.classify(odd, labels)) == got(quality_classifier.classify(own, labels))
    assert quality_classifier.keep_good(odd, labels).columns == odd.columns
    assert got(language_id.identify(odd, {"en": b"words"})) == got(language_id.identify(own, {"en": b"words"}))
    empty = odd.limit(0)
    assert quality_classifier.keep_good(empty, labels).count() == jaccard_join.one_of_each(empty).count() == 0
    v = spark.createDataFrame([(1, [1.0], 2), (2, [2.0], 2)], "vec_id long, embedding array<float>, x int").withColumns({"block": F.lit(1), "score": F.lit(2)})
    assert got(topk.search(topk.integers(v), topk.integers(v))) == [(1, 1, 2, 2097152), (2, 1, 1, 2097152)]
