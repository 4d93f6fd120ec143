"""Minutes of a council cut into acts: heads of lines in one of five layouts, acts as runs of lines between heads.

Layouts are tried in order of how much they prove: a number in the session, an identifier that closes the title, bullets,
a numbered list, capitals. A document is cut by the first that gives an act with a title. Everything is windows over a
document's lines; an act is a running count of heads.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicmill.sources.tables import placed

LAYOUTS = ("numerote", "acte_final", "puces", "liste", "capitales")

#: How minutes word the heads of acts.
NUMBERED = r"^[ \x{00A0}]*(\d{1,3})\s*/\s*(20\d{2})\s*(?:[:–—-]\s*)?(?:n[°ºo]\s*(\d{3,5}))?\s*:?\s*"
IDENTIFIER = r"\(\s*N[°ºo]?\s*(?:DE\s*)?([A-Z]{2}_\d{4}_\d+)\s*\)"
BULLET = r"^\s*(?:\(cid:\d+\)|[•▪–])\s*(.{6,150}?)\s*:(?:\s|$)"
ARABIC = r"^(\d{1,2})\s*[.)]\s*(?=\p{L})(\S.*)$"
ROMAN = r"^([IVX]{1,7})\s*[.)]\s+(?=\p{L})(\S.*)$"
TITLE_ENDS = r"Acte rendu exécutoire|^\s*(?:Vu|Considérant|Monsieur|Madame|Le Conseil|Après)(?![\p{L}\p{N}_])"
VOTE_AT_END = r"(?iu)[,\s]+((?:approuv|adopt|rejet|refus|valid)[eé]{1,2}s?\s+)?[àa]\s+(?:l['’]unanimité|la majorité)[^.]*$"
LIST_CLOSES = r"(?iu)(?:La séance est levée|La séance se termine|Fait et délibéré|Le Maire,|La Présidente,|Le Président,)"
BODY_OPENS = (r"[Ss]ecrétaire de séance", r"^_{5,}$", r"ORDRE DU JOUR")
PERSON = (
    r"^(?:[A-ZÀ-Ÿ][a-zà-ÿ'’\-]+(?:[- ][A-ZÀ-Ÿ][a-zà-ÿ'’\-]+)*\s+[A-ZÀ-Ÿ][A-ZÀ-Ÿ'’\-]{2,}"
    r"|[A-ZÀ-Ÿ][A-ZÀ-Ÿ'’\-]{2,}\s+[A-ZÀ-Ÿ][a-zà-ÿ'’\-]+)(?:\s+\d[\d/.,\s€%]*)?$"
)
#: Lines in capitals that are no head.
NO_HEAD = (
    r"^(?:M|MM|Mme|Mmes)\.?\s+[A-ZÀ-Ÿ][\p{L}\p{N}_-]+(?:\s+[A-ZÀ-Ÿ][\p{L}\p{N}_-]+)?\s*:?\s*$",
    r"\.\.\.\.", r"^[\d\s€,.+-]+$", r"^[_\-=*]+$", r"^[A-ZÀÂÇÉÈÊËÎÏÔÙÛÜ\s'\-.]{0,47}:\s*$",
)
#: What opens a line of attendance, a date, or a row of a table in capitals.
NOISE = (
    r"(?iu)^(PRÉSENTS?|ABSENTS?|PROCÈS-VERBAL|SECTION\s+D|SECTION\s+DE|RECETTES?|DÉPENSES?|TOTAL|PAR\s+MOIS|FONCTIONNEMENT|INVESTISSEMENT|SOLDE|"
    r"COMMUNE\s*:|EXERCICE\s*$|A\s+REPRENDRE\s*$|SECTIONS?\s*$|RÉSULTAT\s*$|DU\s+\d+\s+[\p{L}\p{N}_]+\s+\d{4}|"
    r"CANDIDATS\s*$|CLASSEMENT\s*$|DENOMINATION\s*$|PÉRIODE\s+SCOLAIRE|PÉRISCOLAIRE\s*$|DEPENSES\s*$|RECETTES\s*$|__+)",
    r"(?i)^(?:[\d\s\x{00A0},.€%+\-/]+|TOTAL\s+(?:DES\s+)?(?:DEPENSES?|RECETTES?)|(?:DEPENSES?|RECETTES?)\s+(?:DE\s+)?(?:FONCT|INVEST)[a-z]*|C\.?F\.?E\.?\s*[.:…])[\s:€%.]*$",
)
#: A roll call, amounts, and words that head columns of tables: titles made of these are no titles.
ROLL_CALL = r"(?iu)^(?:MM?|Mme|Mmes|Mlle)\.?\s+[A-ZÀ-Ÿ][\p{L}\p{N}_'’\-]*(?:\s+[A-ZÀ-Ÿ][\p{L}\p{N}_'’\-]*)?\s*:\s*(?:oui|non|abstention|pour|contre|ne\s+prend\s+pas\s+part)(?![\p{L}\p{N}_])"
AMOUNT = r"\d{1,3}(?:[ \x{00A0}]\d{3})*[.,]\d{1,2}\s*[€%]|\d[\d \x{00A0}]*\s*[€%]"
DECIMAL = r"(?<![\d.,])\d{1,3}(?:[ \x{00A0}]\d{3})*[.,]\d{1,2}(?![\d.,])"
COLUMN_WORDS = (
    "DEPENSES", "DÉPENSES", "DEPENSE", "DÉPENSE", "RECETTES", "RECETTE", "CHARGES", "PRODUITS", "MONTANT", "MONTANTS", "TOTAL", "TOTAUX", "CHAP", "LIBELLE", "LIBELLÉ",
    "INTITULE", "INTITULÉ", "FONCTIONNEMENT", "INVESTISSEMENT", "REALISE", "RÉALISÉ", "PREVU", "PRÉVU", "SOLDE", "CREDIT", "CREDITS", "CRÉDIT", "CRÉDITS",
)
#: Three ordinals in a row prove a list; one whose items stand this close must open in the first part of the document.
LEAST_RUN, CLOSE, OPENING = 3, 2, 0.25


def plausible_title(title: Column) -> Column:
    """Whether a title names an act: not a roll call, not a row or the head of a table."""
    words = F.regexp_extract_all(title, F.lit(r"(?<![\p{L}\p{N}_])\p{L}{4,}(?![\p{L}\p{N}_])"), F.lit(0))
    heads = (F.size(words) > 0) & F.forall(words, lambda w: F.upper(w).isin(*COLUMN_WORDS))
    decimals = F.regexp_count(title, F.lit(DECIMAL))
    return ~title.rlike(ROLL_CALL) & ~heads & (decimals < 2) & (~title.rlike(AMOUNT) | (F.size(words) >= 2))


def without_running_heads(lines: DataFrame, key: str, least: int = 4, longest: int = 60) -> DataFrame:
    """``lines`` (key, at, line) without the short ones that recur in a paged document: heads and feet of pages."""
    bare = F.trim(F.regexp_replace("line", r"\s+", " "))
    n = F.count("*").over(Window.partitionBy(key, bare))
    return lines.withColumn("_n", n).where(~((F.col("_n") >= least) & (F.length(bare) < longest) & (bare != ""))).drop("_n")


def _body(lines: DataFrame, key: str, paged: bool) -> DataFrame:
    """Lines (key, at, line, nth, total) after the block of attendance, running heads and blank lines left out."""
    whole = Window.partitionBy(key)
    rows = without_running_heads(lines, key) if paged else lines
    opens = [F.min(F.when(F.col("line").rlike(p), F.col("at"))).over(whole) for p in BODY_OPENS]
    rows = rows.withColumns({f"_opens{i}": o for i, o in enumerate(opens)})
    cut = F.coalesce(*[F.col(f"_opens{i}") for i in range(len(opens))], F.lit(-1))
    mark = reduce(lambda rest, i: F.when(F.col(f"_opens{i}").isNotNull(), F.lit(BODY_OPENS[i])).otherwise(rest), reversed(range(len(opens))), F.lit(None).cast("string"))
    after = F.when(F.col("at") == cut, F.regexp_replace("line", F.concat(F.lit("^.*?(?:"), mark, F.lit(")")), "")).otherwise(F.col("line"))
    rows = rows.where(F.col("at") >= cut).withColumn("line", F.trim(F.regexp_replace(after, r"^\s+|\s+$", ""))).where("line <> ''")
    return rows.select(key, "at", "line", (F.row_number().over(whole.orderBy("at")) - 1).alias("nth"), F.count("*").over(whole).alias("total"))


def roman(digits: Column) -> Column:
    """The value of a Roman numeral in I, V and X; a smaller digit before a larger one counts against it."""
    value = lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).otherwise(0)
    chars = F.split(digits, "")
    return F.aggregate(F.transform(chars, lambda c, i: F.when(value(F.coalesce(F.get(chars, i + 1), F.lit(""))) > value(c), -value(c)).otherwise(value(c))), F.lit(0), lambda a, b: a + b)


def _list_heads(body: DataFrame, key: str) -> DataFrame:
    """``body`` and ``opens``: whether a line is in the longest run of ordinals that go up by one, the last of equally long ones, if that is a list of acts.

    Arabic and Roman ordinals (``kind``) make runs of their own. What a run sums up is told by running figures, less what
    they were where the run began, so one order of the lines serves all of it.
    """
    over, whole = Window.partitionBy(key).orderBy("at"), Window.partitionBy(key)
    before, upto = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(Window.unboundedPreceding, 0)
    kind, value, breaks = F.col("kind"), F.col("value"), F.col("breaks") == 1
    own = lambda f: F.when(kind == 0, f(0)).when(kind == 1, f(1))  # noqa: E731  the figure of the line's own kind
    latest = lambda c, test, window: own(lambda k: F.last(F.when((kind == k) & test, c), ignorenulls=True).over(window))
    tally = lambda c: own(lambda k: F.sum(F.when(kind == k, c)).over(upto))

    marks = body.withColumn("kind", F.when(F.col("line").rlike(ARABIC), 0).when(F.col("line").rlike(ROMAN), 1))
    item = F.trim(F.when(kind == 0, F.regexp_extract("line", ARABIC, 2)).otherwise(F.regexp_extract("line", ROMAN, 2)))
    number = F.when(kind == 0, F.regexp_extract("line", ARABIC, 1).cast("int")).when(kind == 1, roman(F.regexp_extract("line", ROMAN, 1)))
    marks = marks.withColumns({"value": number, "person": F.when(kind.isNotNull(), item.rlike(PERSON).cast("int"))})
    marks = marks.withColumn("previous", latest(F.struct("value", "nth"), kind.isNotNull(), before))
    marks = marks.withColumn("breaks", F.when(kind.isNotNull(), F.coalesce((value != F.col("previous.value") + 1).cast("int"), F.lit(1))))
    near = F.when(~breaks & (F.col("nth") - F.col("previous.nth") <= CLOSE), 1).otherwise(0)
    marks = marks.withColumns({"run": tally(F.col("breaks")), "n": tally(F.lit(1)), "persons": tally(F.col("person")), "near": tally(near)})
    begun = F.struct((F.col("n") - 1).alias("n"), (F.col("persons") - F.col("person")).alias("persons"), "near", F.col("nth").alias("first"))
    marks = marks.withColumn("begun", latest(begun, breaks, upto))
    since = [(F.col(c) - F.col(f"begun.{c}")).alias(c) for c in ("n", "persons", "near")]
    run = F.struct(since[0], (-kind).alias("of"), "run", *since[1:], "begun.first")
    marks = marks.withColumn("best", F.max(F.when(kind.isNotNull(), run)).over(whole))
    n = F.col("best.n")
    close = F.col("best.near") > F.floor((n - 1) / 2)  # so is the median of the n - 1 gaps
    acts = (n >= LEAST_RUN) & (F.col("best.persons") * 2 < n) & (~close | (F.col("best.first") <= F.col("total") * OPENING))
    opens = F.coalesce((kind == -F.col("best.of")) & (F.col("run") == F.col("best.run")) & acts, F.lit(False))
    return marks.select(key, "at", "line", opens.alias("opens"))


def _capitals(line: Column) -> Column:
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    refused = reduce(lambda a, b: a | b, [line.rlike(p) for p in (*NO_HEAD, *NOISE)])
    return F.length(line).between(10, 250) & (letters > 0) & (F.regexp_count(line, F.lit(r"\p{Lu}")) >= 0.8 * letters) & ~refused


def _titles(layout: Column, head: Column, body: Column) -> Column:
    numbered = F.regexp_replace(head, NUMBERED, "")
    text = F.concat_ws("\n", F.nullif(numbered, F.lit("")), F.nullif(body, F.lit("")))
    until = F.regexp_extract(text, rf"(?msu)\A(.*?)(?:{TITLE_ENDS})", 1)
    first = F.when(text.rlike(rf"(?mu){TITLE_ENDS}"), until).otherwise(F.substring(text, 1, 300))
    raw = (
        F.when(layout == 0, first)
        .when(layout == 1, F.regexp_extract(head, rf"(?s)\A(.*?){IDENTIFIER}", 1))
        .when(layout == 2, F.regexp_extract(head, BULLET, 1))
        .when(layout == 3, F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(head, ARABIC, 2), F.lit("")), F.regexp_extract(head, ROMAN, 2)), VOTE_AT_END, ""))
        .otherwise(head)
    )
    bare = F.regexp_replace(F.regexp_replace(raw, r"\s+", " "), r"^[ ,:;.–—-]+|[ ,:;.–—-]+$", "")
    named = F.when((layout == 1) & (bare == ""), F.concat(F.lit("Délibération "), F.regexp_extract(head, IDENTIFIER, 1))).otherwise(bare)
    return F.substring(named, 1, 255)


def acts(minutes: DataFrame, key: str, text: str, paged: bool = True, parts: int | None = None) -> DataFrame:
    """(key, n, layout, session, number, title, text): the acts of each document, in order; none where no layout holds.

    ``paged`` tells documents with pages, whose running heads are no heads of acts, from web pages, where a repeated line
    is the head of a table. A title that names no act (a row of a table, a roll call, too short) shows a cut in the wrong
    place: its lines go back to the act before it. So every line from the first act on is in one act, once, but the lines
    that a layout leaves out: blank ones, running heads and what follows the end of a list.

    Whole texts are shuffled once, into ``parts`` partitions (default: as the session has it); their lines, windows and
    acts stay where the text is. The lines of a partition are sorted in memory, some ten times its text.
    """
    texts = placed(minutes.where(F.col(text).isNotNull()).select(key, text), key, parts)
    lines = texts.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("at", "line"))
    body = _body(lines, key, paged)
    over = Window.partitionBy(key).orderBy("at")

    closes = F.col("line").rlike(IDENTIFIER)
    room = F.col("at") - F.coalesce(F.max(F.when(closes, F.col("at"))).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) - 1
    starts_ill = lambda c: F.coalesce(c, F.lit("x")).rlike(r"^[a-z0-9«»(,]")
    above = [F.trim(F.lag("line", j).over(over)) if j else F.trim(F.regexp_extract("line", rf"^(.*?){IDENTIFIER}", 1)) for j in range(4)]
    reach = F.lit(0)
    for j in (3, 2, 1):  # of up to three lines above those that still belong to the title
        goes = (room >= j) & (above[j].rlike(r"^[^a-z]{8,}$") | starts_ill(F.nullif(above[j - 1], F.lit(""))))
        reach = F.when(goes, (1 + reach) if j < 3 else F.lit(1)).otherwise(0)
    marked = lines.withColumns({"reach": F.when(closes, reach), "numbered": F.col("line").rlike(NUMBERED), "bullet": F.col("line").rlike(BULLET)})
    ahead = [F.lead("reach", j).over(over) for j in range(4)]
    either = lambda tests: reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])
    marked = marked.withColumns({"opens": either([r == j for j, r in enumerate(ahead)]), "in_title": either([r >= j for j, r in enumerate(ahead)])})

    upto = over.rowsBetween(Window.unboundedPreceding, 0)

    def cut(rows: DataFrame, layouts: dict[int, tuple[str, str]]) -> DataFrame:
        """Lines from the first act on, once for each layout that has one; ``layouts``: columns that tell what opens an act, and what is in its head."""
        counted = rows.withColumns({f"act{i}": F.sum(F.col(opens).cast("int")).over(upto) for i, (opens, _) in layouts.items()})
        each = [F.struct(F.lit(i).alias("layout"), F.col(f"act{i}").alias("act"), F.col(inside).alias("head")) for i, (_, inside) in layouts.items()]
        return counted.select(key, "at", "line", F.inline(F.filter(F.array(*each), lambda e: e["act"] > 0)))

    three = cut(marked, {0: ("numbered", "numbered"), 1: ("opens", "in_title"), 2: ("bullet", "bullet")})
    two = cut(_list_heads(body, key).withColumn("capital", _capitals(F.col("line"))), {3: ("opens", "opens"), 4: ("capital", "capital")})
    part = lambda inside: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head") == inside, F.struct("at", "line")))), lambda r: r["line"]), "\n")
    found = three.unionByName(two).groupBy(key, "layout", "act").agg(part(True).alias("head"), part(False).alias("body"))

    layout, last = F.col("layout"), F.max("act").over(Window.partitionBy(key, "layout"))
    ended = F.regexp_replace(F.regexp_extract("body", rf"(?s)\A(.*?){LIST_CLOSES}", 1), r"\s+$", "")
    found = found.withColumn("body", F.when((layout == 3) & (F.col("act") == last) & F.col("body").rlike(LIST_CLOSES), ended).otherwise(F.col("body")))
    found = found.withColumn("title", _titles(layout, F.col("head"), F.col("body")))
    least = F.when(layout == 0, 5).when(layout == 3, 8).when(layout == 4, 6).otherwise(0)
    called = F.regexp_count("title", F.lit(r"(?<![\p{L}\p{N}_])(?:M\.|Mme|Mlle)\s"))
    titled = (F.length("title") >= least) & ~((layout == 4) & ((called >= 2) | (F.col("body") == "")))
    found = found.withColumn("titled", titled).withColumn("chosen", F.min(F.when(F.col("titled"), layout)).over(Window.partitionBy(key))).where("layout = chosen")

    rest = F.when(layout == 0, F.regexp_replace("head", NUMBERED, "")).when(layout == 1, F.regexp_extract("head", rf"(?s){IDENTIFIER}(.*)\z", 2)).when(layout == 2, F.regexp_replace("head", BULLET, "")).otherwise("")
    own = F.array_join(F.array_compact(F.array(F.nullif(F.trim(rest), F.lit("")), F.nullif(F.col("body"), F.lit("")))), "\n")
    given_back = F.array_join(F.array_compact(F.array(F.col("head"), F.nullif(F.col("body"), F.lit("")))), "\n")
    glued = found.withColumn("stays", F.col("titled") & plausible_title(F.col("title")))
    glued = glued.withColumn("n", F.sum(F.col("stays").cast("int")).over(Window.partitionBy(key).orderBy("act").rowsBetween(Window.unboundedPreceding, 0))).where("n > 0")
    piece = F.struct("act", F.when(F.col("stays"), own).otherwise(given_back).alias("text"))
    first = F.min_by(F.struct("layout", "head", "title"), "act")
    joined = glued.groupBy(key, "n").agg(first.alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "\n").alias("text"))
    head, which = F.col("first.head"), F.col("first.layout")
    session = F.when(which == 0, F.concat(F.regexp_extract(head, NUMBERED, 1), F.lit("/"), F.regexp_extract(head, NUMBERED, 2)))
    number = F.when(which == 0, F.nullif(F.regexp_extract(head, NUMBERED, 3), F.lit(""))).when(which == 1, F.regexp_extract(head, IDENTIFIER, 1))
    return joined.select(key, "n", F.element_at(F.array(*map(F.lit, LAYOUTS)), which + 1).alias("layout"), session.alias("session"), number.alias("number"), F.col("first.title").alias("title"), F.trim("text").alias("text"))
