"""Officers and committees against plain walks over each text."""

from __future__ import annotations

import re
import unicodedata

from civicmill.operators import people
from civicmill.plans import extracts

SF = "/root/testdata/sf0.001"


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def likely(name: str) -> bool:
    words = re.findall("[a-z0-9]+", plain(name).lower())
    own = [w for w in words if w not in ("de", "du", "des", "le", "la", "von", "van", "d", "l")]
    return 2 <= len(words) <= 5 and not re.search("[0-9]", name) and not set(words) & set(people.NO_NAMES) and len(own) >= 2 and all(len(w) > 1 for w in own)


def tidy(name: str) -> str:
    name = re.sub(people.CIVILITY, "", name.strip())
    for _ in range(3):
        name = re.sub(people.OPENERS, "", name)
    return " ".join(name.split())


def officers(text):
    spans: list = []
    out: dict = {}
    for form, pattern in (("role_name", people.RIGHT), ("name_role", people.LEFT)):
        taken = list(spans)
        for hit in pattern.finditer(text):
            name = tidy(hit["name"])
            if not likely(name) or any(hit.start() < b and hit.end() > a for a, b in taken):
                continue
            spans.append(hit.span())
            role = hit["role"].lower()
            out.setdefault((re.sub(r"[-'\s]+", " ", plain(name).upper()), people.ROLES[role]), (name, role, people.ROLES[role], form, *hit.span()))
    return list(out.values()), spans


def names_in(fragment):
    out = []
    for raw in re.split(r"\s*[,;]\s*|\s+-\s+", fragment.replace("–", "-").replace("—", "-")):
        note = re.search(r"\(([^)]*)\)", raw)
        bare = " ".join(re.sub(r"\s*\([^)]*\)", "", raw).split()).strip(" .-")
        if re.search("[A-ZÀ-Ÿ]{2,}", bare):
            out.append((bare, note[1].strip() if note else ""))
    return out


def composed(text):
    text = re.sub(r"-\s*\n\s*", "-", text)
    text = re.sub(r"([A-ZÀ-Ÿ][a-zà-ÿ]+)\s*\n\s*([A-ZÀ-Ÿ]{2,})", r"\1 \2", text)
    title, groups, now = "", [], None
    for line in map(str.strip, text.split("\n")):
        if not line or re.match(people.PAGE_NUMBER, line):
            continue
        if re.match(people.SPEECH, line):
            if groups:
                break
            title = ""
            continue
        lead, member = (re.match(p.removeprefix("(?iu)"), line, re.I) for p in (people.LEADS, people.MEMBERS))
        if lead or member:
            if now is None or now["members"] or lead and now["leads"]:
                now = {"title": title, "leads": [], "members": [], "all": []}
                groups.append(now)
            kind = "lead" if lead else "member"
            found = names_in((lead or member)[1])
            now[kind + "s"] += found
            now["all"] += [(kind, *x) for x in found]
            continue
        listing, titled = now is not None and bool(now["members"]), bool(re.match(people.COMMITTEE_TITLE, line))
        if listing and not titled:
            continue
        if listing and names_in(line) and line[0].isupper() and not re.search("[a-zà-ÿ]{6,}", line):
            now["members"] += names_in(line)
            now["all"] += [("member", *x) for x in names_in(line)]
            continue
        if not titled or re.search(r"[.!?]\s*$|^\W|\.\s+[A-ZÀ-Ÿ]", line):
            continue
        goes_on = title and line[0].islower() and len(line) <= 40 and "." not in line
        title = (f"{title} {line}" if goes_on else line).strip(" :–-")
        now = None
    return [(n, g["title"], *x) for n, g in enumerate(groups, 1) if g["title"] for x in g["all"]]


def test_officers(spark):
    made = [
        "Trésorière : Marie Martin, Secrétaire Paul Le Goff", "Jean-Luc MARTIN, président — Anne SEO, trésorière", "Pour Contacter Xavier Perret (président)", "présidée par Pierre de Cazenove depuis 2020",
        "Président : Contact", "Président Le Goff", "Mme Éva Noël (vice-présidente) ; Présidente : Éva NOËL", "Jean Dupont, Président : Marie Martin", "", None, "Directeur Jean Dupont. " * 3000,
    ]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = sorted(tuple(r) for r in people.roles(frame, "doc_id", "text").collect())
    want = sorted((i, *row) for i, t in enumerate(made) for row in officers(t or "")[0])
    assert got == want
    assert (0, "Paul Le Goff", "secrétaire", "secrétaire", "role_name") in [r[:5] for r in got] and not any(r[0] in (4, 5) for r in got)
    assert [r[1] for r in got if r[0] == 7] == ["Marie Martin"]  # its role isn't that of the name before


def test_officers_of_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in extracts.with_people(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    want, forms = [], set()
    for i, t in texts.items():
        rows, spans = officers(t or "")
        right = sorted(spans)
        assert all(a[1] <= b[0] for a, b in zip(right, right[1:], strict=False))  # no two hits overlap
        want += [(i, *row) for row in rows]
        forms |= {row[3] for row in rows}
    assert sorted(tuple(r) for r in extracts.roles(spark, SF).collect()) == sorted(want) and forms == {"role_name", "name_role"}


def test_committees(spark):
    made = [
        "M. VANTARD : Nous allons désigner les membres\nFinances – Budgets\nResponsable : Michèle FONTENAY\nMembres : Brigitte MARTIN, Philippe BRISSAC (volet agricole),\nRené\nFLOUTIER\n12\nEnvironnement :\nMembres : Jean-\nJacques LAVERGNE\nMme MARTIN : merci\nC.C.A.S.\nMembres : Ève DURAND",
        "Membres : Sans TITRE", "Cadre de vie travaux\ntechniques\nResponsables : A BB, C DD\nResponsable : E FF\nMembres : rien", "Les commissions. Les membres\n• puce\nÉcole\nMembre : Zoé ROY\nÈVE NOEL\nUne phrase bien longue.\nTravaux\nMembres : Li WU", "", None,
        "Titre\nMembres : " + ", ".join(f"Jean NOM{'ABCDEFGHIJ'[i % 10]}" for i in range(3000)),
    ]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = sorted(tuple(r) for r in people.committees(frame, "doc_id", "text").collect())
    assert got == sorted((i, *row) for i, t in enumerate(made) for row in composed(t or ""))
    assert {r[2] for r in got} >= {"Finances – Budgets", "Environnement", "Cadre de vie travaux techniques", "École"} and not any(r[0] == 1 for r in got)


def test_committees_of_documents(spark):
    texts = extracts.with_committees(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    want = sorted((r["doc_id"], *row) for r in texts for row in composed(r["text"] or ""))
    got = sorted(tuple(r) for r in extracts.committees(spark, SF).collect())
    assert got == want and {r[3] for r in got} == {"lead", "member"} and len(got) > 100
