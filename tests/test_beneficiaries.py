"""Beneficiaries against deciding one name after the other."""

from __future__ import annotations

import random
import re

from civicmill.operators.resolve import BENEFICIARY_STOP, resolved_beneficiaries

ALIASES = {"ape": "Parents d'élèves", "les  boulistes": "never met", "les boulistes": "amicale boules"}


def tokens(name):
    plain = name.translate(str.maketrans("éèàç’", "eeac'")).lower()
    return {w for w in re.findall("[a-z0-9]+", plain) if len(w) > 1 and w not in BENEFICIARY_STOP}


def brute(mentions, entities, paid):
    names: dict = {}
    out = {}
    for mention, name in sorted(mentions):
        if name is None:
            out[mention] = (None, None, "nothing")
            continue
        said = re.sub(r"\s+", " ", name.translate(str.maketrans("éèàç’", "eeac'")).lower()).strip()
        meant = ALIASES.get(said, name)
        names.setdefault(meant.replace("’", "'").strip().lower(), []).append((mention, meant, meant != name))
    kinds = [(i, n, t == "association") for i, n, t in entities if t != "person"]
    exact: dict = {}
    for i, n, asso in sorted(kinds, key=lambda e: (not e[2], e[0])):
        exact.setdefault(n.replace("’", "'").strip().lower(), i)
    made: list = []
    for key, told in sorted(names.items(), key=lambda kv: kv[1][0][0]):
        own = tokens(told[0][1])
        found = []
        for i, n, asso in kinds:
            shared = len(own & tokens(n))
            if own and shared / len(own) >= 0.6 - 1e-9:
                found.append((i not in paid, -(shared / len(own) + 0.5 * (own <= tokens(n))), not asso, len(tokens(n)), i))
        twins = [(-(len(own & w) / len(own) + 0.5 * (own <= w)), len(w), first) for first, w in made if own and len(own & w) / len(own) >= 0.6 - 1e-9]
        if key in exact:
            for mention, _, aliased in told:
                out[mention] = (exact[key], None, "alias" if aliased else "exact")
            continue
        if found:
            best = min(found)
            for mention, *_ in told:
                out[mention] = (best[-1], None, "known" if best[0] else "subsidised")
            continue
        by = min(twins)[-1] if twins else told[0][0]
        if not twins:
            made.append((by, own))
        for mention, *_ in told:
            out[mention] = (None, by, "registered" if mention == by else "new")
    return sorted((m, *row) for m, row in out.items())


def test_resolver(spark):
    rng = random.Random(7)
    vocabulary = ["club", "boules", "foot", "ecole", "musique", "ruche", "vallee", "gardon", "amis", "anciens", "chasse", "peche", "velo", "theatre"]
    name = lambda words: " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
    entities = [(i, name(vocabulary[:7]).title(), rng.choice(["association", "business", "service", "person"])) for i in range(1, 40)]
    entities += [(90, "La Soierie", "business"), (91, "LA SOIERIE", "association"), (92, "Parents d’élèves", "association"), (93, "de la", "place")]
    told = [name(vocabulary) for _ in range(250)] + ["la soierie", "APE", "Les Boulistes", None, "", "de", "DE LA", "l'été", "L’été", "Amicale  Boules", "amicale des boules du gardon"]
    rng.shuffle(told)
    mentions = [(1000 + i, n) for i, n in enumerate(told)]
    paid = {3, 5, 8, 13, 91}
    frames = spark.createDataFrame(mentions, "mention_id long, name string").repartition(5), spark.createDataFrame(entities, "id long, name string, type string")
    got = resolved_beneficiaries(*frames, spark.createDataFrame([(i,) for i in paid], "id long"), ALIASES)
    want = brute(mentions, entities, paid)
    assert sorted((tuple(r) for r in got.collect())) == want
    assert {row[3] for row in want} == {"alias", "exact", "subsidised", "known", "registered", "new", "nothing"}
    assert resolved_beneficiaries(frames[0].limit(0), frames[1], frames[1].select("id"), {}).count() == 0
