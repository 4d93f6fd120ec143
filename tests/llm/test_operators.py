"""The operators against brute force, exact round trips and held-out labels."""

from __future__ import annotations

import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from civicmill.llm import queries
from civicmill.llm.decontamination import contaminated_documents, tiles
from civicmill.llm.licenses import TEMPLATES, license_scan
from civicmill.llm.mixing import mixed, mixed_documents
from civicmill.llm.substrings import deduplicated, repeated_units, units
from civicmill.llm.token_counts import token_counts
from civicmill.llm.token_records import frame, frames, token_records
from civicmill.llm.topk import top_k
from civicmill.llm.toxicity import toxicity_scores
from civicmill.llm.warc import archived

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, fold int, key string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "k") for i, t, s in rows], DOCS)


ODD = [(None, "a text without an id here", "a"), (1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "one two three four", "b"), (4, "one two three four", "b"), (5, "mot " * 40_000, "c"), (6, "MIT License and the Apache  license", "c")]


def sources(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shares(sizes: dict, most: int = 3) -> dict:
    """Targets by giving out what is left again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in full]
        rest = total - sum(full.values())
        given = {s: rest * weight[s] / sum(weight[t] for t in left) for s in left}
        over = [s for s in left if given[s] >= most * sizes[s]]
        if not over:
            return full | given
        full |= {s: most * sizes[s] for s in over}


def test_mixing(spark):
    docs = sources(spark).union(docs_of(spark, ODD).select("doc_id", "text", "lang", "source", "doc_id"))
    got = mixed(docs).toPandas()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    want = shares(sizes)
    for source, rows in got.groupby("source", dropna=False):
        source = None if not isinstance(source, str) else source
        assert rows["source_size"].iloc[0] == sizes[source]
        assert rows["target"].iloc[0] == pytest.approx(want[source])
        assert rows["taken"].sum() == round(want[source])
    assert (got["taken"] <= 3 * got["size"]).all() and len(got) == docs.count()
    again = mixed(docs).toPandas()
    assert sorted(map(str, again[["doc_id", "size", "taken"]].values)) == sorted(map(str, got[["doc_id", "size", "taken"]].values))
    assert mixed(docs.limit(0)).count() == 0


def test_substrings(spark):
    shared = "this very line of words is found in many places."
    rows = [(3, f"Own opening sentence number three is here. {shared}", "a"), (1, f"{shared}\nAnd another thing that only one text says.", "a"), (2, f"{shared} {shared}", "b"), *ODD]
    docs = docs_of(spark, rows)
    got = {(r["doc_id"], r["start"], r["end"], r["kept_doc_id"]) for r in repeated_units(docs).collect()}
    first: dict = {}
    for i, t, _ in sorted((r for r in rows if r[1]), key=lambda r: 1 << 62 if r[0] is None else r[0]):
        for s, e, u in units(t, 6):
            first.setdefault(u, (i, s))
    want = {(i, s, e, first[u][0]) for i, t, _ in rows if t for s, e, u in units(t, 6) if (i, s) != first[u]}
    assert got == want and want
    kept = {r["doc_id"]: r["text"] for r in deduplicated(docs_of(spark, rows[:3])).collect()}
    assert shared in kept[1] and shared not in kept[2] and kept[3].startswith("Own opening")


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity_scores(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    judged = got.merge(labels.toPandas(), on="doc_id").query("held_out")
    assert ((judged["predicted"] == 1) == (judged["toxic"] == 1)).mean() >= 0.95
    assert toxicity_scores(docs.limit(0), labels).count() == 0
    assert toxicity_scores(docs_of(spark, ODD), labels.limit(0)).count() == len(ODD)


def test_decontamination(spark):
    items = [(1, " ".join(f"w{k}" for k in range(40)), 0), (2, " ".join(f"v{k}" for k in range(30)), 0), (3, None, 0)]
    benchmark = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    words = items[0][1].split()
    turned = " ".join([*words[20:], "and", "so", *words[:20]])
    rows = [(10, f"before {items[1][1]} after", "a"), (11, turned, "a"), (12, " ".join(words[:12]) + " and nothing else of it", "a"), (13, "clean words only in this text", "a"), *ODD]
    got = {r["doc_id"]: (r["coverage"], r["items"]) for r in contaminated_documents(docs_of(spark, rows), benchmark).collect()}
    assert got == {10: (1.0, "2"), 11: (1.0, "1")}
    shuffled = {r["doc_id"] for r in contaminated_documents(docs_of(spark, rows), benchmark, most_seeds=0).collect()}
    assert shuffled == {10, 11}
    assert sum(n for _, _, n in tiles(words, turned.split(), 4)) == 40
    assert contaminated_documents(docs_of(spark, rows), benchmark.limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).astype("float32").round(1).tolist()) for i in range(300)] + [(300, None), (301, [float("nan")] * 6), (None, [1.0] * 6), (7, [0.5] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in top_k(table, __import__("pyspark.sql.functions", fromlist=["col"]).col("vec_id") % 20 == 0, k=5, block_rows=64).collect()]
    fit = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and np.isfinite(v).all()]
    want = []
    for q, v in fit:
        if q % 20 == 0:
            best = sorted(((-int(v @ w), i) for i, w in fit if i != q))[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)


def test_token_counts_and_their_cache(spark, tmp_path):
    import sentencepiece

    docs = sources(spark).select("doc_id", "text").union(docs_of(spark, ODD).select("doc_id", "text"))
    model = public_tokenizers.path("piece_bpe_32k.model")
    encode = sentencepiece.SentencePieceProcessor(model_file=model).encode
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), n := len(encode(r["text"] or "")), n > 4096) for r in docs.collect())
    for _ in range(2):
        got = token_counts(docs, model, f"file://{tmp_path}/cache").collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
        assert spark.read.parquet(f"file://{tmp_path}/cache").count() == docs.select("text").na.fill("").distinct().count()


def test_archives(spark):
    pages = spark.createDataFrame([(1, "http://a/ b", "<p>é</p>", 1), (2, None, None, 1), (3, "http://c", "", 1), (9, "http://d", "<p>é</p>", 1), (9, "http://d", "<p>é</p>", 1)], "page_id long, url string, html string, size int")
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in archived(pages).collect())
    assert got == [(1, 9, "revisit", 9), (2, 0, "revisit", 3), (3, 0, "response", 0), (9, 9, "response", 0), (9, 9, "revisit", 9)]
    assert archived(pages.limit(0)).count() == 0


def test_licenses(spark):
    docs = sources(spark).select("doc_id", "text").union(docs_of(spark, ODD).select("doc_id", "text"))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = []
    for r in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(lower))
        at = {label: [i for i in range(len(words)) if words[i : i + len(p)] == p] for label, p in (("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"]))}
        every = sorted(sum(at.values(), []))
        want.append((str(r["doc_id"]), len(words), len(every), every[0] if every else -1, every[-1] if every else -1, ",".join(sorted(k for k, v in at.items() if v))))
    got = license_scan(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_base"], -1 if r["first_word"] is None else r["first_word"], -1 if r["last_word"] is None else r["last_word"], r["base_labels"]) for r in got) == sorted(want)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_token_records(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = sources(spark).select("doc_id", "text").union(docs_of(spark, [r for r in ODD if r[0] is not None]).select((__import__("pyspark.sql.functions", fromlist=["col"]).col("doc_id") + 10_000).alias("doc_id"), "text"))
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"], r["text"] is not None, r["text"] or "")):
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_records(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)


def test_damaged_frames_are_refused():
    content = frame(b"payload") + b"\n"
    assert [p for _, p in frames(content)] == [b"payload"]
    with pytest.raises(ValueError):
        list(frames(content.replace(b"pay", b"pax")))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name].strip()).fetchall()
    plain = lambda rows: sorted(tuple("null" if v is None else str(v) for v in r) for r in rows)
    assert plain(map(tuple, got.collect())) == plain(want)


def test_pipeline(spark):
    docs = sources(spark)
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, before, SF)
        assert kept.columns == docs.columns
        if name != "mixing":
            assert kept.exceptAll(before).count() == 0
        before = spark.createDataFrame(kept.collect(), docs.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert len(out) == before.count() == corpus_pipeline.run(spark, SF).count()


def test_pipeline_stages_on_null_and_repeated_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(None, words(0), "en", "a", 1), (None, words(0), "en", "a", 1), (1, words(1), "en", "a", 1), (1, words(1), "en", "a", 1), (1, words(1), "en", "a", 1)]
    rows += [(1, words(2), "en", "a", 1), (2, words(1), "en", "a", 1), (3, words(3), "en", "a", 1), (4, None, "en", "a", 1), (4, None, "en", "a", 1)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, schema), SF)
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()))
    assert got == [(0, words(0)), (1, words(1)), (1, words(2)), (3, words(3)), (4, "")]
    read = mixed_documents(spark.createDataFrame(rows, schema)).collect()  # one source: each row is read once
    assert sorted(map(str, read)) == sorted(str(r) for r in spark.createDataFrame([r for r in rows if r[1]], schema).collect())


def test_files_with_several_notices_keep_all_labels(spark):
    notices = ["apache-2.0", "mit-text", "bsd", "gpl-3.0", "mpl-2.0"]
    common = "any copy code files free source software terms work version public person form use "
    rows = [(1, ". ".join(TEMPLATES[n][0] for n in notices), "a"), (2, ". ".join(TEMPLATES[n][0] for n in notices[1:3]), "a"), (3, common * 50 + TEMPLATES["bsd"][0], "a")]
    rows += [(10 + k, f"ordinary text number {k} about the weather", "a") for k in range(60)] + [(100 + k, common, "b") for k in range(9)]
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in license_scan(docs_of(spark, rows)).collect()}
    assert got[1] >= set(notices) and got[2] >= set(notices[1:3]) and got[3] >= {"bsd"}


def test_long_passages_and_short_seeds_of_items_are_found(spark):
    words = [f"w{k}" for k in range(200)]
    pieces = [f"v{k}" for k in range(40)]
    benchmark = spark.createDataFrame([(1, " ".join(words), 0), (2, " ".join(pieces), 0)], "item_id long, text string, doc_id int")
    turned = " ".join(" ".join(pieces[i : i + 4]) for i in range(36, -1, -4))
    rows = [(10, "before " + " ".join(words[50:140]) + " after", "a"), (11, turned, "a"), (12, " ".join(words[:25]), "a")]
    for settings in ({}, {"most_seeds": 0}):
        assert {r["doc_id"]: r["items"] for r in contaminated_documents(docs_of(spark, rows), benchmark, **settings).collect()} == {10: "1", 11: "2"}


def test_disguised_words_are_read_to_the_end():
    from civicmill.llm.toxicity import DISGUISED, INSULTS, features

    word = next(d for w in sorted(INSULTS) for d in (w.replace("i", "1", 1), w.replace("o", "0", 1)) if d != w and DISGUISED.findall(f"a {d} b"))
    codes = " ".join(f"q{k}z{k}q" for k in range(3000))
    assert features(f"{codes} {word} {word}", {}, {})[-1] == features(codes, {}, {})[-1] + 2


def test_short_lines_and_short_sentences_go_too(spark):
    shouted = " ".join(f"W{k}!!" for k in range(60))
    passage = "First of all this is a long enough sentence. Yes. No. Then comes another sentence that is long enough."
    rows = [(1, f"All rights reserved.\nOwn one.\n{shouted}\n{passage}", "a"), (2, f"Own two.\nAll rights reserved.\n{shouted}", "a"), (3, f"Other words. {passage} Other end.\nOwn three.", "a"), (4, "Go! " * 13, "a")]
    kept = {r["doc_id"]: r["text"] for r in deduplicated(docs_of(spark, rows)).collect()}
    assert kept[1] == rows[0][1] and kept[2].split() == ["Own", "two."]
    assert kept[3].split() == "Other words. Other end. Own three.".split() and kept[4].split() == ["Go!"] * 7  # the first six, and a rest shorter than a unit


def integral(knots, time):
    """Of a piecewise-linear schedule from 0 to ``time``, by small steps."""
    at = np.linspace(0, time, 20_001)
    weight = np.interp(at, *zip(*knots, strict=True))
    return float(np.sum((weight[1:] + weight[:-1]) / 2 * np.diff(at)))


def test_positions_invert_the_schedules(spark):
    """Each reading stands where the integral of its source's schedule is the share of the source that came before."""
    from civicmill.llm.mixing import RAMPS

    rows = [(i, "w " * (1 + i % 7), f"s{i % 5}") for i in range(300)]
    got = mixed(docs_of(spark, rows)).toPandas()
    for n, (_, mine) in enumerate(sorted(got.groupby("source"), key=lambda g: g[0])):
        target, size = round(mine["target"].iloc[0]), mine["source_size"].iloc[0]
        readings = sorted((p, k, r.size) for r in mine[["positions", "size"]].itertuples(index=False) for k, p in enumerate(r.positions))
        before: dict = {}
        for p, k, words in readings:
            share = (k * size + before.get(k, 0)) / target
            before[k] = before.get(k, 0) + words
            assert integral(RAMPS[n % 3], p) == pytest.approx(share, abs=1e-6)
        assert all(len(r) == 0 or r[0] == p for r, p in zip(mine["positions"], mine["position"], strict=True))


def test_mixing_with_clashing_columns(spark):
    rows = docs_of(spark, [(i, f"some words of text {i}", "a") for i in range(20)])
    clashing = rows.selectExpr("*", "1 AS position", "2 AS taken", "3 AS row_key", "4 AS size")
    assert mixed_documents(clashing).columns == clashing.columns and mixed_documents(clashing).count() == 20
    assert deduplicated(rows.selectExpr("*", "1 AS spans", "2 AS start")).count() == 20


def test_equal_texts_have_equal_scores(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    copies = docs.join(labels.select("doc_id"), "doc_id", "left_semi").selectExpr("doc_id + 100000000 AS doc_id", "text")
    got = toxicity_scores(docs.union(copies), labels).toPandas().set_index("doc_id")["score"]
    copied = got[got.index >= 100_000_000]
    assert len(copied) > 100 and (copied.values == got[copied.index - 100_000_000].values).all()


def test_features_take_time_in_proportion():
    import time

    from civicmill.llm.toxicity import DISGUISED, features

    assert DISGUISED.findall("an id1ot, st*p*d w0rds a1 2b x!!y") == ["id1ot", "st*p*d", "w0rds", "x!!y"]
    began = time.time()
    for text in ("a" * 1_000_000, "a1" * 500_000, "A" * 1_000_000 + "b", "a" + "!" * 1_000_000):
        features(text, {}, {})
    assert time.time() - began < 20


def greedy(item, text, shortest):
    """Tiles by looking at every pair of places again for each tile."""
    mine, theirs, out = [False] * len(item), [False] * len(text), []
    while True:
        best = (shortest - 1, 0, 0)
        for t in range(len(text)):
            for i in range(len(item)):
                n = 0
                while i + n < len(item) and t + n < len(text) and not mine[i + n] and not theirs[t + n] and item[i + n] == text[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, t, i)
        n, t, i = best
        if n < shortest:
            return sorted(out)
        mine[i : i + n] = theirs[t : t + n] = [True] * n
        out.append((i, t, n))


def test_tiles_are_the_greedy_ones():
    rng = np.random.default_rng(4)
    for _ in range(150):
        letters = list("abcdefgh")[: int(rng.integers(1, 9))]
        item, text = ([str(x) for x in rng.choice(letters, int(rng.integers(0, n)))] for n in (30, 40))
        text[3:3] = item[2:9]
        assert sorted(tiles(item, text, 3)) == greedy(item, text, 3)
    assert tiles(["a"] * 20_000, ["a"] * 20_000, 4) == [(0, 0, 20_000)]


def test_contaminated_pairs_are_those_of_brute_force(spark):
    """Both ways, on whole tables: every pair is tiled here, whatever seeds it shares."""
    docs, benchmark = sources(spark).select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet")
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = {r["item_id"]: words(r["text"]) for r in benchmark.collect()}
    want: dict = {}
    for r in docs.collect():
        text = words(r["text"])
        near = {tuple(text[k : k + 4]) for k in range(len(text) - 3)}
        for i, item in items.items():
            if any(tuple(item[k : k + 4]) in near for k in range(len(item) - 3)):
                found = greedy(item, text, 4) if len(text) < 400 else tiles(item, text, 4)
                if sum(n for *_, n in found) >= 0.5 * len(item) or any(n >= 30 for *_, n in found):
                    want.setdefault(r["doc_id"], []).append(i)
    for settings in ({}, {"most_bytes": 0}):
        got = {r["doc_id"]: r["items"] for r in contaminated_documents(docs, benchmark, **settings).collect()}
        assert got == {d: ",".join(map(str, sorted(i))) for d, i in want.items()} and got


def test_too_large_vectors_are_refused(spark):
    table = spark.createDataFrame([(20, [1e18, 1.0]), (21, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ArithmeticError):
        top_k(table, __import__("pyspark.sql.functions", fromlist=["col"]).col("vec_id") % 20 == 0)


def test_archives_stay_short(spark, tmp_path):
    pages = spark.createDataFrame([(k, "http://a", f"page {k % 40} " * 50) for k in range(500)], "page_id long, url string, html string").coalesce(2)
    got = archived(pages, path=f"file://{tmp_path}", archive_bytes=1 << 14).collect()
    assert len(list(tmp_path.glob("arc/*.gz"))) > 20 and len(got) == 500
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == {(k, "response" if k >= 460 else "revisit", None if k >= 460 else 460 + (k - 20) % 40) for k in range(500)}


def test_one_document_has_its_licence(spark):
    got = license_scan(docs_of(spark, [(1, TEMPLATES["mit-text"][0], "a")])).first()
    assert got["labels"] == "mit-text" and got["score"] == 1.0
    same = license_scan(docs_of(spark, [(k, "Released under the MIT License.", "a") for k in range(3)])).collect()
    assert all(r["labels"] == "mit,mit-notice" and r["score"] == 1.0 for r in same)


def test_cached_counts_answer(spark, tmp_path):
    """A hit is not encoded again: its stored number comes back, whatever it is."""
    from civicmill.llm.token_counts import CACHE_SCHEMA, content_digest, version_digest

    model, docs = public_tokenizers.path("piece_bpe_32k.model"), docs_of(spark, [(1, "known text", "a"), (2, "other text", "a")])
    stored = docs.where("doc_id = 1").select(content_digest(docs["text"]).alias("digest"))
    cache = f"file://{tmp_path}/cache"
    spark.createDataFrame([(r["digest"], version_digest(model), 777) for r in stored.collect()], CACHE_SCHEMA).write.parquet(cache)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, model, cache).collect()}
    assert got[1] == 777 and 0 < got[2] < 777 and spark.read.parquet(cache).count() == 2


def test_files_follow_by_number(spark):
    from civicmill.llm.token_records import with_starts

    index = spark.createDataFrame([(f"file:/x/part-{n}-u.txt", 0, 1, n, 0, 2, 0) for n in ("00001", "99999", "100000", "100001")], "path string, position long, length long, doc_id string, before long, n_tokens long, ids_crc32 long")
    assert {r["doc_id"]: r["start"] for r in with_starts(index).collect()} == {"00001": 0, "99999": 2, "100000": 4, "100001": 6}


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    from civicmill.llm.token_records import WordEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, text = WordEncoder(path), "Two  Words\nand <|x|> more, don't"
    assert np.frombuffer(encoder.batch([text])[0], encoder.dtype).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
