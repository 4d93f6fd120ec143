"""Approved projects and the best of near repeats against a walk over rows in order."""

from __future__ import annotations

import random
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from civicmill.operators import approvals as a
from civicmill.operators.windows import best_of_near_repeats
from civicmill.plans import extracts

SF = "/root/testdata/sf0.001"


def py(pattern):
    flags = re.I if pattern.startswith("(?i") else 0
    pattern = re.sub(r"^\(\?[a-z]+\)", "", pattern).replace(r"\x{00A0}", r"\xa0").replace(r"\x{202F}", r"\u202f").replace(r"[\p{L}\p{N}_'’-]", r"[\w'’-]").replace(r"[\p{L}\p{N}_]", r"\w")
    return re.compile(pattern, flags)


def owner(text):
    pattern = re.compile(r"(?<!\w)(?:S[A-Z]{2,5}(?!\w)|(?i:syndicat)(?:\s+[\w'’-]+){1,4})")
    at = 0
    while found := pattern.search(text, at):
        if re.search(r"(?:M\.|Mme|Mlle|Monsieur|Madame)\s{0,9}$", text[: found.start()]):
            at = found.start() + 1
            continue
        words = found[0].split()
        kept, after = words[:1], False
        for word in words[1:]:
            bare = word.lower().rstrip(".,;:")
            glued = bool(re.match("[dl]['’]", bare))
            if not (bare in (*a.QUALIFIERS, *a.PREPOSITIONS) or glued or word[0].isupper() or after):
                break
            kept.append(word)
            after = bare in a.PREPOSITIONS or glued
        while kept[-1].lower().rstrip(".,;:") in a.PREPOSITIONS:
            kept.pop()
        return " ".join(kept)
    return None


def found_in(key, day, title, text):
    out = []
    parts = [p.strip() for p in re.split(r"(?<=[.;])\s+|\n+", text) if p.strip()]
    for at, part in enumerate(parts):
        if not py(a.VOTED).search(part):
            continue
        sums: dict = {}
        for raw, base in py(a.AMOUNT).findall(part):
            value = float(re.sub(r"\s", "", raw).replace(",", "."))
            if a.LEAST <= value <= a.MOST:
                sums.setdefault(base.upper(), value)
        if not sums:
            continue
        said = (title or "").strip()
        said = "" if py(a.SPEECH).match(said) else said
        about = f"{said} — {part}" if said and (len(said) < a.SHORT_TITLE or py(a.GENERIC).match(said)) else said or part
        out.append((key, at, day, about[:255], sums.get("HT"), sums.get("TTC"), owner(f"{part} {title or ''}"), part[:500]))
    return out


def best(rows):
    kept: list = []
    for row in sorted(rows, key=lambda r: (not re.search(a.PROPER, r[3]), -len(r[3]), r[0], r[1])):
        near = [k for k in kept if row[4] is not None and k[4] == row[4] and (k[2] is None or row[2] is None or abs((k[2] - row[2]).days) <= a.NEAR_DAYS)]
        if not near:
            kept.append(row)
    return kept


def test_approvals(spark):
    made = extracts.with_plans(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    every = [row for r in made for row in found_in(r["doc_id"], r["date"], r["title"], r["text"] or "")]
    frame = extracts.with_plans(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted(map(str, (tuple(r) for r in a.approvals(frame, "doc_id", "date", "title", "text").collect()))) == sorted(map(str, every))
    want = best(every)
    assert sorted(map(str, (tuple(r) for r in extracts.approvals(spark, SF).collect()))) == sorted(map(str, want))
    assert len(want) < len(every) and any(r[4] and r[5] for r in want) and len({r[6] for r in want}) > 3


def test_made_sentences(spark):
    text = "M. SERRE : Le SMEG propose. Le conseil approuve le projet du SMEG : 16 130,10 € HT soit 19 356,12 € TTC.\nPlan de financement 12 HT; état financier estimatif de 1500.5€HT pour M. SERRE"
    frame = spark.createDataFrame([(1, date(2024, 1, 1), None, text), (2, None, "Poste de Calviac et ses alentours", text), (3, None, None, None), (4, None, "", "")], "doc_id long, date date, title string, text string")
    got = sorted((tuple(r) for r in a.approvals(frame, "doc_id", "date", "title", "text").collect()), key=str)
    assert got == sorted((row for r in frame.collect() for row in found_in(*[r[0], r[1], r[2], r[3] or ""])), key=str)
    assert [r[4:7] for r in got if r[0] == 1] == [(16130.1, 19356.12, "SMEG"), (1500.5, None, None)]


def test_best_of_near(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([1, 2, None]), None if rng.random() < 0.05 else date(2020, 1, 1) + timedelta(days=rng.randint(0, 900)), rng.randint(0, 50)) for i in range(300)]
    rows += [(1000 + i, 3, date(2020, 1, 1) + timedelta(days=150 * i), i) for i in range(12)]  # a chain: each is near to the next
    kept: list = []
    for row in sorted(rows, key=lambda r: (-r[3], r[0])):
        if row[1] is None or not any(k[1] == row[1] and (k[2] is None or row[2] is None or abs((k[2] - row[2]).days) <= 200) for k in kept):
            kept.append(row)
    frame = spark.createDataFrame(rows, "id long, amount long, day date, worth long")
    got = best_of_near_repeats(frame, ["amount"], "day", 200, F.desc("worth"), F.col("id"))
    assert sorted(r["id"] for r in got.collect()) == sorted(k[0] for k in kept)
    assert best_of_near_repeats(frame.limit(0), ["amount"], "day", 200, F.col("id")).count() == 0
