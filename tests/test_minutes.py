"""Acts of minutes against a plain walk over the lines of each document."""

from __future__ import annotations

import re
import statistics
from collections import Counter

from pyspark.sql import functions as F

from civicmill.operators import minutes as m
from civicmill.plans import extracts
from civicmill.sources.tables import parts_of

SF = "/root/testdata/sf0.001"


def py(pattern: str) -> re.Pattern:
    """A pattern as Python spells it."""
    flags = 0
    if opened := re.match(r"\(\?([a-z]+)\)", pattern):
        flags = re.I if "i" in opened[1] else 0
        pattern = pattern[opened.end() :]
    pattern = pattern.replace(r"\x{00A0}", r"\xa0").replace(r"[\p{L}\p{N}_'’\-]", r"[\w'’\-]").replace(r"[\p{L}\p{N}_-]", r"[\w\-]").replace(r"[\p{L}\p{N}_]", r"\w").replace(r"\p{L}", r"[^\W\d_]")
    return re.compile(pattern, flags)


NUMBERED, IDENTIFIER, BULLET, ARABIC, ROMAN = map(py, (m.NUMBERED, m.IDENTIFIER, m.BULLET, m.ARABIC, m.ROMAN))
ENDS = re.compile(m.TITLE_ENDS.replace(r"[\p{L}\p{N}_]", r"\w"), re.M)


def tidy(title: str) -> str:
    return re.sub(r"\s+", " ", title).strip(" ,;:.-–—")[:255]


def plausible(title: str) -> bool:
    words = re.findall(r"\b[^\W\d_]{4,}\b", title)
    if py(m.ROLL_CALL).search(title) or words and all(w.upper() in m.COLUMN_WORDS for w in words) or len(py(m.DECIMAL).findall(title)) > 1:
        return False
    return len(words) > 1 or not py(m.AMOUNT).search(title)


def value(ordinal: str) -> int:
    if ordinal.isdigit():
        return int(ordinal)
    worth = [{"I": 1, "V": 5, "X": 10}[c] for c in ordinal]
    return sum(-w if w < (worth[i + 1] if i + 1 < len(worth) else 0) else w for i, w in enumerate(worth))


def body_of(lines, paged):
    kept = [(i, line) for i, line in enumerate(lines)]
    if paged:
        n = Counter(re.sub(r"\s+", " ", x).strip() for x in lines)
        kept = [(i, x) for i, x in kept if not (n[re.sub(r"\s+", " ", x).strip()] >= 4 and 0 < len(re.sub(r"\s+", " ", x).strip()) < 60)]
    for pattern in m.BODY_OPENS:
        at = next((k for k, (_, x) in enumerate(kept) if re.search(pattern, x)), None)
        if at is not None:
            kept = [(kept[at][0], re.sub(f"^.*?(?:{pattern})", "", kept[at][1], count=1)), *kept[at + 1 :]]
            break
    return [(i, x.strip()) for i, x in kept if x.strip()]


def capitals(line):
    letters = [c for c in line if c.isalpha()]
    noisy = any(py(p).search(line) for p in (*m.NO_HEAD, *m.NOISE))
    return 10 <= len(line) <= 250 and bool(letters) and sum(c.isupper() for c in letters) >= 0.8 * len(letters) and not noisy


def list_heads(body):
    runs = []
    for kind, pattern in enumerate((ARABIC, ROMAN)):
        run = []
        for nth, (at, line) in enumerate(body):
            if not (found := pattern.match(line)) or kind and ARABIC.match(line):
                continue
            if run and value(found[1]) != run[-1][2] + 1:
                runs.append((len(run), -kind, len(runs), run))
                run = []
            run.append((nth, at, value(found[1]), found[2].strip()))
        if run:
            runs.append((len(run), -kind, len(runs), run))
    if not runs:
        return set()
    run = max(runs)[3]
    persons = sum(bool(re.match(m.PERSON, item)) for *_, item in run)
    gaps = sorted(b[0] - a[0] for a, b in zip(run, run[1:], strict=False))
    close = bool(gaps) and statistics.median_high(gaps) <= m.CLOSE
    if len(run) < m.LEAST_RUN or persons * 2 >= len(run) or close and run[0][0] > len(body) * m.OPENING:
        return set()
    return {at for _, at, *_ in run}


def cut(lines, layout, paged):
    """[(head lines, other lines)] of a layout."""
    rows, heads = list(enumerate(lines)), {}
    if layout == "numerote":
        heads = {i: [i] for i, x in rows if NUMBERED.match(x)}
    elif layout == "puces":
        heads = {i: [i] for i, x in rows if BULLET.match(x)}
    elif layout == "acte_final":
        before = -1
        for i, x in rows:
            if found := IDENTIFIER.search(x):
                start, top = i, x[: found.start()].strip()
                while i - start < 3 and start - 1 > before and (re.match(r"[^a-z]{8,}$", lines[start - 1].strip()) or re.match(r"[a-z0-9«»(,]", top or "x")):
                    start -= 1
                    top = lines[start].strip()
                heads[start], before = list(range(start, i + 1)), i
    else:
        rows = body_of(lines, paged)
        heads = {i: [i] for i in list_heads(rows)} if layout == "liste" else {i: [i] for i, x in rows if capitals(x)}
    out = []
    for i, x in rows:
        if i in heads:
            out.append(([], []))
        if out:
            out[-1][0 if any(i in h for h in heads.values()) else 1].append(x)
    return out


def named(head, body, layout):
    text = "\n".join(head)
    if layout == "numerote":
        whole = "\n".join(x for x in (NUMBERED.sub("", text, count=1), body) if x)
        end = ENDS.search(whole)
        title = tidy(whole[: end.start()] if end else whole[:300])
        return title, len(title) >= 5
    if layout == "acte_final":
        found = IDENTIFIER.search(text)
        return tidy(text[: found.start()]) or f"Délibération {found[1]}", True
    if layout == "puces":
        return tidy(BULLET.match(text)[1]), True
    if layout == "liste":
        title = tidy(py(m.VOTE_AT_END).sub("", (ARABIC.match(text) or ROMAN.match(text))[2]))
        return title, len(title) >= 8
    title = tidy(text)
    return title, len(title) >= 6 and bool(body) and len(re.findall(r"\b(?:M\.|Mme|Mlle)\s", title)) < 2


def brute(text, paged=True):
    lines = re.split(r"\r?\n", text)
    for layout in m.LAYOUTS:
        found = [("\n".join(h), "\n".join(b)) for h, b in cut(lines, layout, paged)]
        if layout == "liste" and found:
            head, body = found[-1]
            closes = py(m.LIST_CLOSES).search(body)
            found[-1] = (head, body[: closes.start()].rstrip() if closes else body)
        titles = [named(h.split("\n"), b, layout) for h, b in found]
        if not any(ok for _, ok in titles):
            continue
        out = []
        for (head, body), (title, ok) in zip(found, titles, strict=True):
            if ok and plausible(title):
                rest = {"numerote": lambda h: NUMBERED.sub("", h, count=1), "acte_final": lambda h: h[IDENTIFIER.search(h).end() :], "puces": lambda h: BULLET.sub("", h, count=1)}.get(layout, lambda h: "")(head)
                number = NUMBERED.match(head)[3] if layout == "numerote" else IDENTIFIER.search(head)[1] if layout == "acte_final" else None
                session = "/".join(NUMBERED.match(head).groups()[:2]) if layout == "numerote" else None
                out.append([layout, session, number, title, "\n".join(x for x in (rest.strip(" "), body) if x)])
            elif out:
                out[-1][4] += "\n" + "\n".join(x for x in (head, body) if x)
        return [(n, *row[:4], row[4].strip(" ")) for n, row in enumerate(out, 1)]
    return []


MADE = [
    "PROCÈS\n48/2026 : n° 4713 : Vente du terrain\nActe rendu exécutoire\nVu la loi\n49/2026 – n° 4714\nBail\nrural de la ferme\nMonsieur le Maire\n50/2026 x\n51/2026 : n° 99999 : Titre trop long " + "mot " * 120,
    "Délibérations du conseil :\nVOTE DU BUDGET PRINCIPAL\nDE LA COMMUNE (N° DE_2026_001) suite\nle texte\n\nTarifs du camping\net de la piscine (N°DE_2026_002)\ntexte\n(N° DE_2026_003)\nfin (N° AB_2020_9)",
    "intro\n• Subvention au club de boules : accordée\ndétail\n(cid:12) CD30 8 800,00 € : x\n▪ Total des charges : 12\n– Déneigement des routes :\ntexte",
    "Présents\nSecrétaire de séance : Mme A\n1. Approbation du compte rendu, adopté à l'unanimité\ntexte un\nHAUT DE PAGE\n2) Vente de parcelles\n\nHAUT DE PAGE\ntexte\n3 . Questions\nHAUT DE PAGE\n4. Motion\nHAUT DE PAGE\ntexte\nLa séance est levée.\nsuite",
    "a\nb\nc\nd\ne\nf\ng\nh\ni\nj\nk\nl\n1. Lui donne acte\n2. Constate les valeurs\n3. Vote le compte",
    "1. Jean DUPONT\n2. DURAND Marie\n3. Anne-Marie LEROY",
    "I. Première affaire du jour\nx\ny\nII. Deuxième affaire\nx\ny\nz\nIII. Troisième affaire\nIV. 2024\nV. Suite",
    "ORDRE DU JOUR\nAPPROBATION DU COMPTE RENDU\ntexte\nM. BENEFICE : \nDEPENSES\nTOTAL DES CHARGES\nCHARGES ET PRODUITS\n12\nVENTE DU TERRAIN DE LA GARE\nVENTE DU LOGEMENT\nsuite et fin\nMme DUPONT ET M. DURAND SONT SORTIS\nx",
    "", "rien à dire", "\n\n", "12/2024",
]


def rows_of(spark, docs, paged=True):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(tuple(r) for r in m.acts(frame, "doc_id", "text", paged).collect())


def test_layouts(spark):
    docs = list(enumerate(MADE))
    for paged in (True, False):
        want = sorted((i, *row) for i, text in docs for row in brute(text, paged))
        assert rows_of(spark, [*docs, (99, None)], paged) == want
    assert {row[2] for row in want} == set(m.LAYOUTS)
    assert rows_of(spark, []) == []


def test_whole_documents(spark):
    made = extracts.with_minutes(spark.read.parquet(f"{SF}/documents.parquet"))
    want = sorted((r["doc_id"], *row) for r in made.where("text IS NOT NULL").collect() for row in brute(r["text"]))
    got = sorted(tuple(r) for r in extracts.acts(spark, SF).collect())
    assert got == want and {row[2] for row in got} == set(m.LAYOUTS)


def test_no_line_is_lost(spark):
    """Of a numbered document every line from the first act on stands in one act, once."""
    text = "\n".join(f"{i}/2024 : n° {4000 + i} : DETR 52 655.52 € 27.62 %" if i % 3 else f"{i}/2024 : n° {4000 + i} : Affaire numéro {i}\nligne {i}" for i in range(30))
    acts = rows_of(spark, [(1, text)])
    joined = "\n".join(a[6] for a in acts)
    assert len(acts) == 10 and all(joined.count(f"n° {4000 + i} :") == 1 for i in range(30) if i % 3) and all(joined.count(f"ligne {i}\n") + joined.endswith(f"ligne {i}") <= 1 for i in range(30))


def test_texts_are_shuffled_once(spark):
    made = spark.createDataFrame(list(enumerate(MADE)), "doc_id long, text string")
    whole = sorted(tuple(r) for r in m.acts(made, "doc_id", "text").collect())
    for parts in (3, 40):
        df = m.acts(made, "doc_id", "text", parts=parts)
        assert sorted(tuple(r) for r in df.collect()) == whole
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert shuffles and all(f", {parts}), REPARTITION_BY_NUM" in line for line in shuffles) and len({re.search(r"plan_id=(\d+)", line)[1] for line in shuffles}) == 1, plan


def test_parts_grow_with_the_texts(spark):
    rows = spark.createDataFrame([(i, "é" * 500) for i in range(100)] + [(100, None)], "doc_id long, text string")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts_of(rows, F.octet_length("text"), 1000) == 100
    assert parts_of(rows, F.octet_length("text"), 10**9) == parts_of(rows.where("false"), F.octet_length("text"), 1000) == least
