"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

A repaired conversation reads (s?(ua)+)? in its roles' initials, or is empty. Edits are Keep (0), Rerole to user or
assistant (3), Delete (4, required for blank and repeated rows) and Insert of an empty turn (3); a truncated row that
stays costs 3 more. Of the cheapest edits those whose initials are ASCII-least win.

The search is a rank-compressed dynamic program. A macro edit is a run of inserts and the edit of the next row; its
initials, such as ``IK``, form a prefix-free code, so the audits of equally many rows compare macro by macro. A layer (the
rows read so far) holds for each of four roles read last the least cost, and in place of the audit string its rank in
the layer, with a pointer to the parent and the macro; strings are put together afterwards, from the end. Costs count
from the layer's least, roles far above it are hopeless, and ranks are dense, so few layers differ: each transition is worked out once and then looked up.

Rows are range-sorted by conversation and turn, so a conversation may lie in several partitions. A task reads its
partition as segments, at most ``SEGMENT_ROWS`` rows or ``SEGMENT_CHARS`` characters of one conversation. Those that are
a whole conversation are repaired at once. Of the rest (the first and last of each partition, and long conversations)
texts that stand in an earlier segment are found by grouping digests, each segment becomes a table from the four roles
it may start in to the four it may end in, (cost, rank) each, and those tables, some numbers per segment, are chained;
then each segment is repaired for the ends chosen. Only SHA-256, which is sequential, and the audit run through one
task per conversation, as a stream.

Edge cases: rows without a conversation are one conversation; null roles and texts read as one space, so such texts are
blank; of equal turns (null ones come first) rows go by the MD5 of role and text; repeated rows are duplicates; roles of
other initials must be changed or deleted; conversations of which no row is left give zeros, an empty audit and the
hash of the empty string; other columns of the input don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from civicmill.llm.common import ASCII_SPACE, saved

SEGMENT_ROWS, SEGMENT_CHARS = 4096, 4 << 20
#: What was read last: nothing, a system turn, a user turn, an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: Costs of the edits, and of a truncated row that stays.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A role that costs more than the least by this is never on a cheapest way: two inserts and a deletion stand in for any of its futures.
HOPELESS = 2 * INSERT + DELETE
BLANK, DUPLICATE, CUT, SOUND = "bdts"
BEYOND = 1 << 60

Layer = tuple[tuple[int, int], ...]  # (cost, rank) by role read last
Step = tuple[int, tuple[tuple[int, str], ...], Layer]  # cost taken off, (parent, macro) by role, the layer after it


def _after(role: int, inserts: int) -> int:
    for _ in range(inserts):
        role = ASSISTANT if role == USER else USER
    return role


def _next(role: int, initial: str) -> int | None:
    """The role read last after a turn of that initial; None if it may not stand here."""
    if initial == "s":
        return SYSTEM if role == NOTHING else None
    if initial == "u":
        return None if role == USER else USER
    return ASSISTANT if role == USER and initial == "a" else None


def macros(kind: str) -> dict[tuple[int, int], list[tuple[int, str]]]:
    """(role before, role after) -> (cost, code) of the macro edits of a row; ``kind`` is its initial and its fault.

    Three inserts leave the same role as one, so runs end at two.
    """
    initial, fault = kind
    found: dict[tuple[int, int], list[tuple[int, str]]] = {}
    for role in range(4):
        for inserts in range(3):
            at, code, cost = _after(role, inserts), "I" * inserts, INSERT * inserts
            found.setdefault((role, at), []).append((cost + DELETE, code + "D"))
            if fault in (BLANK, DUPLICATE):
                continue
            more = TRUNCATED if fault == CUT else 0
            if (then := _next(at, initial)) is not None:
                found.setdefault((role, then), []).append((cost + more, code + "K"))
            for new in "ua":
                if (then := _next(at, new)) is not None:
                    found.setdefault((role, then), []).append((cost + more + RENAME, code + "R"))
    return found


class Machine:
    """Layers of the dynamic program, each transition worked out once."""

    def __init__(self) -> None:
        self.macros: dict[str, dict[tuple[int, int], tuple[int, str]]] = {}
        self.known: dict[tuple[Layer, str], Step] = {}

    @staticmethod
    def start(role: int) -> Layer:
        return tuple((0, 0) if r == role else (BEYOND, 0) for r in range(4))

    def step(self, layer: Layer, kind: str) -> Step:
        if (found := self.known.get((layer, kind))) is None:
            if kind not in self.macros:
                self.macros[kind] = {ends: min(codes) for ends, codes in macros(kind).items()}
            best: list[tuple[int, int, str, int]] = [(BEYOND, 0, "", 0)] * 4
            for (before, after), (cost, code) in self.macros[kind].items():
                if layer[before][0] < BEYOND:
                    best[after] = min(best[after], (layer[before][0] + cost, layer[before][1], code, before))
            least = min(b[0] for b in best)
            best = [b if b[0] <= least + HOPELESS else (BEYOND, 0, "", 0) for b in best]
            order = sorted({b[1:3] for b in best if b[0] < BEYOND})
            after = tuple((b[0] - least, order.index(b[1:3])) if b[0] < BEYOND else (BEYOND, 0) for b in best)
            found = self.known[layer, kind] = (least, tuple((b[3], b[2]) for b in best), after)
        return found

    def run(self, kinds: list[str], role: int) -> tuple[list[tuple[tuple[int, str], ...]], list[tuple[int, int]]]:
        """Pointers of each layer, and (cost, rank) by role at the end."""
        layer, spent, pointers = self.start(role), 0, []
        for kind in kinds:
            least, back, layer = self.step(layer, kind)
            spent += least
            pointers.append(back)
        return pointers, [(spent + cost if cost < BEYOND else BEYOND, rank) for cost, rank in layer]

    def codes(self, kinds: list[str], role: int, end: int) -> list[str]:
        """The macro codes of the best way from one role to another."""
        pointers, out = self.run(kinds, role)[0], []
        for back in reversed(pointers):
            end, code = back[end]
            out.append(code)
        return out[::-1]


def last(reached: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(cost, role, inserts) at the end: inserts that close the conversation come after the last row."""
    ways = [(cost + INSERT * n, rank, n, role) for role, (cost, rank) in enumerate(reached) if cost < BEYOND for n in range(3) if _after(role, n) in ENDS]
    cost, _, n, role = min(ways)
    return cost, role, n


def repaired(rows: list[tuple[str, str]], codes: list[str], role: int, closing: int) -> Iterator[str]:
    """``role:text`` of the turns that stand after the edits."""
    names = {USER: "user", ASSISTANT: "assistant"}
    for (name, text), code in zip([*rows, ("", "")], [*codes, "I" * closing], strict=True):
        for edit in code:
            if edit == "I":
                role = _after(role, 1)
                yield f"{names[role]}:"
            elif edit == "K":
                role = _next(role, name[:1])  # type: ignore[assignment]
                yield f"{name}:{text}"
            elif edit == "R":
                role = _after(role, 1)
                yield f"{names[role]}:{text}"


def fault_of(role: str, text: str, seen: set[bytes]) -> str:
    """The first fault of a row; ``seen`` holds digests of the rows before it, and gets its own."""
    digest = hashlib.md5(f"{role}\0{text}".encode("utf-8", "surrogatepass")).digest()
    known = digest in seen
    seen.add(digest)
    words = text.rstrip(ASCII_SPACE)
    if not words:
        return BLANK
    if known:
        return DUPLICATE
    return SOUND if words[-1] in ".!?" else CUT


def kind_of(role: str, fault: str) -> str:
    return (role[:1] if role[:1] in ("s", "u", "a") else "?") + fault


def legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


DONE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PARSED = f"conv_id {{kind}}, part int, segment int, done boolean, {DONE}, turns array<long>, roles array<string>, texts array<string>, digests array<binary>"


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _arrow(conv: pa.DataType, schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, conv if kind == "{kind}" else kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def _whole(machine: Machine, turns: list, rows: list[tuple[str, str]]) -> dict:
    """The result of a conversation that lies in one segment."""
    seen: set[bytes] = set()
    faults = [fault_of(role, text, seen) for role, text in rows]
    kinds = [kind_of(role, fault) for (role, _), fault in zip(rows, faults, strict=True)]
    cost, end, closing = last(machine.run(kinds, NOTHING)[1])
    codes = machine.codes(kinds, NOTHING, end)
    known = {t for t in turns if t is not None}
    return {
        "done": True, "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT), "illegal": sum(not legal(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False)),
        "cost": cost, "audit": "".join(codes) + "I" * closing, "repaired_sha256": hashlib.sha256("\n".join(repaired(rows, codes, NOTHING, closing)).encode("utf-8", "surrogatepass")).hexdigest(),
    }


def _parse(conv: pa.DataType, segment_rows: int, segment_chars: int):
    """Sorted rows of a partition to results of whole conversations and segments of the others."""
    schema = _arrow(conv, PARSED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, machine = TaskContext.get().partitionId(), Machine()
        held: list[dict] = []
        turns: list = []
        rows: list[tuple[str, str]] = []
        current, number, chars, began = None, 0, 0, False

        def close(whole: bool) -> None:
            nonlocal number, chars, turns, rows
            out = {"conv_id": current, "part": part, "segment": number, "done": False}
            if whole:
                out |= _whole(machine, turns, rows)
            else:
                digests = [hashlib.md5(f"{r}\0{t}".encode("utf-8", "surrogatepass")).digest() for r, t in rows]
                out |= {"turns": turns, "roles": [r for r, _ in rows], "texts": [t for _, t in rows], "digests": digests}
            held.append(out)
            number, chars, turns, rows = number + 1, 0, [], []

        edge = True  # the partition's first conversation may have begun in another one; a cut one goes on
        for batch in batches:
            for conv_id, turn, role, text, times in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "times")), strict=True):
                if began and conv_id != current:
                    close(whole=not edge)
                    edge = False
                current, began = conv_id, True
                for _ in range(times):
                    if len(rows) >= segment_rows or chars + len(text) > segment_chars and rows:
                        close(whole=False)
                        edge = True
                    turns.append(turn)
                    rows.append((role, text))
                    chars += len(text)
            if held:
                yield _table(held, schema)
                held = []
        if began:
            close(whole=False)
        if held:
            yield _table(held, schema)

    return run


SUMMARY = (
    "conv_id {kind}, part int, segment int, n long, gaps long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, "
    "first_role string, last_role string, costs array<long>, ranks array<long>, kinds array<string>"
)


def _summarise(conv: pa.DataType):
    """Each segment as a table from the role before it to the role after it."""
    schema = _arrow(conv, SUMMARY)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                seen, rows = set(r["earlier"] or ()), list(zip(r["roles"], r["texts"], strict=True))
                faults = [fault_of(role, text, seen) for role, text in rows]
                kinds = [kind_of(role, fault) for (role, _), fault in zip(rows, faults, strict=True)]
                ends = [machine.run(kinds, role)[1] for role in range(4)]
                known = sorted({t for t in r["turns"] if t is not None})
                out.append({
                    "conv_id": r["conv_id"], "part": r["part"], "segment": r["segment"], "n": len(rows),
                    "gaps": len(known), "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
                    "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT), "illegal": sum(not legal(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False)),
                    "first_role": rows[0][0][:1] if rows else "", "last_role": rows[-1][0][:1] if rows else "",
                    "costs": [cost for row in ends for cost, _ in row], "ranks": [rank for row in ends for _, rank in row], "kinds": kinds,
                })
            yield _table(out, schema)

    return run


CHAINED = "conv_id {kind}, part int, segment int, begins int, ends int, closing int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _chain(conv: pa.DataType):
    """Of one conversation: its segments' tables, in order, to the roles at each segment's ends."""
    schema = _arrow(conv, CHAINED)

    def run(table: pa.Table) -> pa.Table:
        segments = sorted(table.to_pylist(), key=lambda r: (r["part"], r["segment"]))
        layer, pointers = list(Machine.start(NOTHING)), []
        total = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0)
        low = high = role = None
        for r in segments:
            ways = [min(((layer[b][0] + r["costs"][4 * b + e], layer[b][1], r["ranks"][4 * b + e], b) for b in range(4) if layer[b][0] < BEYOND and r["costs"][4 * b + e] < BEYOND), default=(BEYOND, 0, 0, 0)) for e in range(4)]
            order = sorted({w[1:3] for w in ways if w[0] < BEYOND})
            layer = [(w[0], order.index(w[1:3])) if w[0] < BEYOND else (BEYOND, 0) for w in ways]
            pointers.append([w[3] for w in ways])
            total = {k: v + r[k] for k, v in total.items()}
            if r["n"]:
                total["illegal"] += role is not None and not legal(role, r["first_role"])
                role = r["last_role"]
            if r["first_turn"] is not None:
                total["gaps"] -= high is not None and high == r["first_turn"]
                low, high = r["first_turn"] if low is None else low, r["last_turn"]
        total["gaps"] = high - low + 1 - total["gaps"] if low is not None else 0
        cost, end, closing = last(layer)
        out = []
        for r, back in zip(reversed(segments), reversed(pointers), strict=True):
            out.append({"conv_id": r["conv_id"], "part": r["part"], "segment": r["segment"], "begins": back[end], "ends": end, "closing": closing if not out else 0, **total, "cost": cost})
            end = back[end]
        return pa.Table.from_pylist(out, schema)

    return run


PIECE = "conv_id {kind}, part int, segment int, audit string, repaired string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _replay(conv: pa.DataType):
    """Segments with their ends to pieces of the audit and of the repaired conversation."""
    schema = _arrow(conv, PIECE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                codes = machine.codes(r["kinds"], r["begins"], r["ends"])
                turns = list(repaired(list(zip(r["roles"], r["texts"], strict=True)), codes, r["begins"], r["closing"]))
                out.append({name: r.get(name) for name in schema.names} | {"audit": "".join(codes) + "I" * r["closing"], "repaired": "\n".join(turns) if turns else None})
            yield _table(out, schema)

    return run


def _joined(conv: pa.DataType):
    """Pieces in order, streamed: one row a conversation."""
    schema = _arrow(conv, f"conv_id {{kind}}, {DONE}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, audit, digest, empty, first = None, [], hashlib.sha256(), True, None
        result = lambda: _table([{name: first.get(name) for name in schema.names} | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)
        for batch in batches:
            for r in batch.to_pylist():
                if first is None or r["conv_id"] != current:
                    if first is not None:
                        yield result()
                    current, audit, digest, empty, first = r["conv_id"], [], hashlib.sha256(), True, r
                audit.append(r["audit"])
                if r["repaired"] is not None:
                    digest.update(("" if empty else "\n").encode() + r["repaired"].encode("utf-8", "surrogatepass"))
                    empty = False
        if first is not None:
            yield result()

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): rows as a crc32 of ``conv_id:turn`` damages them; ``times`` 0 drops a row, 2 repeats it."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(how == 1, "").when(how == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(how == 4, "user").otherwise(part("role")).alias("role"),
        F.when(how == 0, "").otherwise(text).alias("text"), F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("times"),
    )


def repair(turns: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    ``turns`` holds (conv_id, turn, role, text, times); a row of ``times`` 0 only makes its conversation known.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    conv = to_arrow_type(turns.schema["conv_id"].dataType)
    made = lambda schema: schema.replace("{kind}", kind)
    keyed = turns.withColumn("tie", F.md5(F.concat("role", F.lit("\0"), "text"))).withColumn("spread", F.monotonically_increasing_id())
    keys = ("conv_id", "turn", "tie", "spread")
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    parsed = saved(ordered.mapInArrow(_parse(conv, segment_rows, segment_chars), made(PARSED)), "segments")
    done = parsed.where("done").select("conv_id", *_names(DONE))

    parts = parsed.where("not done").select("conv_id", "part", "segment", "turns", "roles", "texts", "digests")
    at = F.struct("part", "segment")
    stands = parts.select("conv_id", "part", "segment", F.explode(F.array_distinct("digests")).alias("digest"))
    firsts = stands.groupBy("conv_id", "digest").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("conv_id", "conv")
    again = stands.join(firsts.drop("n").withColumnRenamed("digest", "known"), F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("digest") == F.col("known"))).where(at > F.col("first"))
    earlier = again.groupBy("part", "segment").agg(F.collect_list("digest").alias("earlier"))  # at most a segment's rows
    summed = saved(parts.join(earlier, ["part", "segment"], "left").mapInArrow(_summarise(conv), made(SUMMARY)), "summaries")
    chained = summed.drop("kinds").groupBy("conv_id").applyInArrow(_chain(conv), made(CHAINED))
    replayed = parts.drop("conv_id").join(summed.select("part", "segment", "kinds"), ["part", "segment"]).join(chained, ["part", "segment"]).mapInArrow(_replay(conv), made(PIECE))
    rest = replayed.repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment").mapInArrow(_joined(conv), made(f"conv_id {{kind}}, {DONE}"))
    return done.unionByName(rest)

