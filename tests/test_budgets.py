"""Budget tables against a walk over the text of each act."""

from __future__ import annotations

import re
import unicodedata

from civicmill.operators import budgets as b
from civicmill.plans import extracts

SF = "/root/testdata/sf0.001"


def py(pattern):
    return re.compile(pattern.replace(r"\x{00A0}", r"\xa0").replace(r"\x{202F}", r"\u202f"), re.A)


def plain(text):
    text = (text or "").replace("Œ", "OE").replace("œ", "oe").replace("Æ", "AE").replace("æ", "ae")
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").replace("’", "'").replace("‘", "'").lower()


def name_of(words):
    out = []
    for word in reversed(re.findall(r"[a-z0-9'.-]+", words)):
        word = word.strip(".'-:")
        if not word or word in b.SENTENCE or re.fullmatch(r"[\d.'-]+", word) or len(out) == 3:
            break
        out.insert(0, word)
    name = " ".join(out)
    return "principal" if re.fullmatch(r"principal|m\s?\d{1,2}", name) else name or None


def value_after(tail):
    value, tail = None, tail[:120]
    for _ in range(3):
        found = py(rf"[ \t\n\r|:]*({b.AMOUNT})").match(tail)
        if not found:
            break
        number = float(re.sub(r"\s", "", found[1]).replace(",", "."))
        if not re.search(r"[.,]\d{1,2}$", found[1]) and abs(number) < 1000:
            break
        value, tail = number, tail[found.end() :]
    return value


def tables(title, text):
    whole = f"{plain(title)} {plain(text)}"
    heads, out = list(py(b.HEAD).finditer(whole)), []
    for n, head in enumerate(heads):
        before = whole[: head.start()]
        names = py(b.NAMED).findall(before[-200:])
        sections = py(b.SECTION).findall(before[-60:])
        scope, section, year = name_of(names[-1]) if names else None, sections[-1] if sections else None, int(head[2])
        if out and out[-1][1] == year:
            scope, section = scope or out[-1][2], section or out[-1][3]
        body = whole[head.end() : heads[n + 1].start() if n + 1 < len(heads) else None]
        labels = [*b.LABELS.items(), *([(b.BALANCES[section], b.BALANCE)] if section else [])]
        lines = []
        for label, pattern in labels:
            values = [v for m in py(pattern).finditer(body) if (v := value_after(body[m.end() :]))]
            lines += [f"{label}={values[0]:.12e}"] if values else []
        verdict = "colonne_incertaine" if py(b.LATER_COLUMN).search(body[:45]) else "sans_montant" if not lines else "lu" if scope else "budget_indetermine"
        out.append((n, year, scope, section, verdict, ";".join(lines if verdict == "lu" else [])))
    return out


def test_tables(spark):
    made = [
        ("Vote", "Principal section de fonctionnement M57 dépenses\nChap/art Intitulé Restes à réaliser CA 2025 BP 2026\n.012 Charges de personnel 900 000.00 1 035 000.00 65 Autres\nTOTAL DES DEPENSES FONCT. EXERCICE 2 270 783,59\nrecettes Chap Intitulé BP 2026 Total des recettes fonct 3 000 000,00\nSolde d'exécution 12 345.67"),
        ("", "… le budget 2025 du parc locatif, qui s’établit ainsi : parc locatif section d'investissement\nChap. Intitulé BP 2025 CA 2025\ntotal des recettes invest 1 000,00"),
        (None, "dépenses d'investissement\nChap/Art\nIntitulé\nBP 2026\nTotal des dépenses d’investissement\n4 500,00"), ("Rien", "BP 2026"), ("x", None),
        ("Chaufferie bois section de fonctionnement", "chap intitulé bp 2026 011 charges à caractère général 11 | 5 000 chap intitulé bp 2027 total des depenses fonct 0,00 solde d execution 1 500"),
    ]
    frame = spark.createDataFrame([(i, None, *row) for i, row in enumerate(made)], "doc_id long, date date, title string, text string")
    found = b.budget_tables(frame, "doc_id", "title", "text").collect()
    got = sorted(((r["doc_id"], r["nth"], r["year"], r["scope"], r["section"], r["verdict"], ";".join(f"{e['label']}={e['value']:.12e}" for e in r["lines"])) for r in found), key=str)
    assert got == sorted(((i, *row) for i, act in enumerate(made) for row in tables(*act)), key=str)
    assert got[0][3:] == ("principal", "fonctionnement", "lu", "Dépenses de fonctionnement=2.270783590000e+06;Charges de personnel=1.035000000000e+06") and got[1][3] == "principal"
    assert {r[5] for r in got} == {"lu", "colonne_incertaine", "budget_indetermine", "sans_montant"}


def test_documents(spark):
    made = extracts.with_budgets(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    want = sorted(((r["doc_id"], *row) for r in made for row in tables(r["title"], r["text"])), key=str)
    got = sorted((tuple(r) for r in extracts.budget_tables(spark, SF).collect()), key=str)
    assert got == want and {r[5] for r in got} == {"lu", "colonne_incertaine", "budget_indetermine", "sans_montant"}
    dates = {r["doc_id"]: r["date"] for r in made}
    voted: dict = {}
    for doc, n, year, scope, _, _, lines in want:
        for line in filter(None, lines.split(";")):
            label, value = line.split("=")
            key = (str(dates[doc] or ""), doc, n)
            voted[year, scope, label] = max(voted.get((year, scope, label), (key, "")), (key, value))
    result = {(r["year"], r["scope"], r["label"]): (r["doc_id"], f"{r['value']:.12e}") for r in extracts.voted_budgets(spark, SF).collect()}
    assert result == {k: (key[1], value) for k, (key, value) in voted.items()} and len(result) > 10
