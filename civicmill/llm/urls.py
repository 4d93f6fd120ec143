"""URL filters: wildcard rules simulated together by a bit-parallel Shift-And automaton.

Every rule becomes a pattern over the canonical URL, ``.`` + host + path (scheme, query and fragment dropped, A-Z of the
host lower-cased). In a glob ``?`` stands for one character but ``/``, ``*`` for any run without ``/``, ``**`` for any
run. A pattern of m characters takes m + 1 bits of one multiword state: bit i says that its first i characters are
read. A character moves the bits that it fits up by one; a wildcard run keeps its bit in place. So a step costs a few
operations on words, however many rules there are, and many URLs take the same step at once.

Prefix rules (host, path, verdict) fit their host and all its subdomains where the path starts with the rule's; they are
packed into the same automaton. The longest one that fits decides; without one the longest glob, ties to the earlier in
the list; without one ``default``.

Nothing is shuffled and no row meets another, so hot hosts and repeated URLs cost nothing extra. Memory: a block of
URLs holds one state each, ``STATE_BYTES`` in all, and two tables of 256 states.

Edge cases: null URLs and those without ``://`` have an empty host and path, so only globs that fit ``.`` or everything
match; an empty path isn't ``/``; characters beyond ASCII are single characters to ``?``; very long URLs are read
whole; repeated rows are judged each; other columns of the input don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of automaton states that are advanced at once.
STATE_BYTES = 16 << 20

#: Prefix rules of the query: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Globs of the query: what no prefix rule decides.
GLOBS = (
    ("*spam**", "block"), ("*.cheap-**", "block"), ("*pills**", "block"), ("*casino**", "block"), ("**/login**", "block"), ("**/cart/**", "block"), ("**/tag/*/page/**", "block"),
    ("**.exe", "block"), ("**.zip", "block"), ("m.*.example.net/es/9??**", "block"), ("**/en/**/page/?", "block"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Sets of bytes, as a truth value for each.
ANY = np.ones(256, bool)
NO_SLASH = np.arange(256) != ord("/")
STARTS = NO_SLASH & ((np.arange(256) < 0x80) | (np.arange(256) >= 0xC0))
CONTINUES = (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)
NONE = np.zeros(256, bool)

#: What a pattern's states do: (bytes that lead to the next state, None at the end; bytes that stay).
States = list[tuple[np.ndarray | None, np.ndarray]]


def _literal(text: str) -> list[np.ndarray]:
    return [np.arange(256) == b for b in text.encode("utf-8")]


def glob_states(glob: str) -> States:
    states: States = []
    stays = NONE
    i = 0
    while i < len(glob):
        if glob[i] == "*":
            run = len(glob[i:]) - len(glob[i:].lstrip("*"))
            stays = stays | (ANY if run > 1 else NO_SLASH)
            i += run
            continue
        for step in [STARTS] if glob[i] == "?" else _literal(glob[i]):
            states.append((step, stays))
            stays = NONE
        if glob[i] == "?":
            stays = CONTINUES
        i += 1
    return [*states, (None, stays)]


def rule_states(host: str, path: str) -> States:
    steps = _literal((f".{host}" if host else "") + path)
    return [(steps[0] if steps else None, NO_SLASH), *((s, NONE) for s in steps[1:]), *([(None, ANY)] if steps else [])]


class Automaton:
    """All patterns at once over byte strings."""

    def __init__(self, patterns: Sequence[States]) -> None:
        n = sum(map(len, patterns))
        self.words = max(1, -(-n // 64))
        self.moves, self.stays = (np.zeros((256, self.words), np.uint64) for _ in range(2))
        self.start = np.zeros(self.words, np.uint64)
        self.ends: list[tuple[int, np.uint64]] = []
        at = 0
        for states in patterns:
            self.start[at // 64] |= np.uint64(1 << at % 64)
            for move, stay in states:
                word, bit = at // 64, np.uint64(1 << at % 64)
                if move is not None:
                    self.moves[move, word] |= bit
                self.stays[stay, word] |= bit
                at += 1
            self.ends.append(((at - 1) // 64, np.uint64(1 << (at - 1) % 64)))

    def matches(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(strings, patterns): whether the pattern fits the whole string."""
        out = np.zeros((len(sizes), len(self.ends)), bool)
        step = max(1, STATE_BYTES // (8 * self.words))
        longest_first = np.argsort(-sizes, kind="stable")
        for i in range(0, len(sizes), step):
            rows = longest_first[i : i + step]
            begin, size = starts[rows], sizes[rows]
            state = np.tile(self.start, (len(rows), 1))
            active = len(rows)
            for at in range(int(size[0]) if len(rows) else 0):
                while size[active - 1] <= at:
                    active -= 1
                byte = data[begin[:active] + at]
                now = state[:active]
                moved = now & self.moves[byte]
                carry = moved[:, :-1] >> np.uint64(63)
                moved <<= np.uint64(1)
                moved[:, 1:] |= carry
                state[:active] = moved | (now & self.stays[byte])
            for j, (word, bit) in enumerate(self.ends):
                out[rows, j] = (state[:, word] & bit) != 0
        return out


def _longest(found: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """For each row the index of its longest pattern, the earlier of equal ones; -1 for none."""
    best = np.full(len(found), -1)
    for j in sorted(range(len(sizes)), key=lambda j: (sizes[j], -j)):
        best[found[:, j]] = j
    return best


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, globs: Sequence[tuple[str, str]] = GLOBS, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every row of ``pages``."""
    kind = pages.schema["page_id"].dataType.simpleString()
    rest = F.when(F.contains("url", F.lit("://")), F.expr("substr(url, locate('://', url) + 3)")).otherwise("")
    parted = pages.select("page_id", rest.alias("rest")).select(
        "page_id",
        F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    names, glob_names = [host + path for host, path, _ in rules], [g for g, _ in globs]

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([*(rule_states(h, p) for h, p, _ in rules), *(glob_states(g if g.startswith(("*", ".")) else f".{g}") for g in glob_names)])
        for batch in batches:
            texts = batch["url"].cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            found = automaton.matches(data, offsets[:-1], np.diff(offsets))
            rule = _longest(found[:, : len(rules)], list(map(len, names)))
            glob = _longest(found[:, len(rules) :], list(map(len, glob_names)))
            pick = lambda values, at: pa.array([values[i] if i >= 0 else None for i in at], pa.string())
            verdict = [rules[r][2] if r >= 0 else globs[g][1] if g >= 0 else default for r, g in zip(rule, glob, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["host"], batch["path"], pick(names, rule), pa.array(verdict, pa.string()), pick(glob_names, glob)],
                names=["page_id", "host", "path", "rule", "verdict", "pattern"],
            )

    canonical = F.concat(F.lit("."), "host", "path").cast("binary").alias("url")
    return parted.select("*", canonical).mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string, pattern string")
