"""Secrets found by one automaton for all rules.

Every byte of every text is read once: one minimal automaton, compiled from all rules,
tells after each byte which rules match there. From each such place an automaton of the
reversed rule gives the match's start and one of the rule itself its greedy end. Matches
of a rule are leftmost and do not overlap; those that fail the rule's length test are
dropped, without another try inside them.

Defined results: null text counts as empty; a text without secrets has no spans, counts
of 0 and the hash of the empty string. Offsets are code points, ends exclusive. Rows are
independent, so repeated rows repeat and an empty table gives none. Very long texts are
scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Automaton, compile_rules, scan
from .text import Block, per_document

# The rules of the contract, then those added.
ASSIGN_HEAD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN_VALUE = r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"


@dataclass(frozen=True)
class Rule:
    """head and tail: what matches, one after the other; fold: letters in either case.

    least: bytes that what follows the longest head must have.
    """

    kind: str
    head: str
    tail: str
    fold: bool = False
    least: int = 1

    @property
    def pattern(self) -> str:
        return self.head + self.tail


RULES = (
    Rule("assign", ASSIGN_HEAD, ASSIGN_VALUE, True, 8),
    Rule("access", "", ACCESS, False, 16),
    Rule("hex", "", HEX),
    Rule("key", "", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]+", False, 30),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]+", False, 10),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"bearer ", r"[A-Za-z0-9._~+/=-]+", True, 20),
)
BASE = ("assign", "access", "hex")


@cache
def _compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, list[Automaton], list[Automaton], list[Automaton | None]]:
    """For all rules together, and for each one forwards, backwards, and its head."""
    pairs = [(r.pattern, r.fold) for r in rules]
    heads = [compile_rules([(r.head, r.fold)], False) if r.head else None for r in rules]
    return compile_rules(pairs, True), [compile_rules([p], False) for p in pairs], [compile_rules([p], False, True) for p in pairs], heads


def _longest(auto: Automaton, data: bytes, at: int, stop: int, way: int) -> int:
    """The farthest place where auto accepts, running from at towards stop; -1: nowhere."""
    s, best = 0, -1
    while at != stop:
        s = int(auto.step[s + int(auto.byte_class[data[at if way > 0 else at - 1]])])
        at += way
        if s == auto.dead:
            break
        if auto.accepts[s // auto.classes]:
            best = at
    return best


def find_spans(texts: list[bytes], rules: tuple[Rule, ...] = RULES, automata=None) -> list[list[tuple[int, int, str]]]:
    """For each text its (start, end, kind), in byte offsets, by start, then by the rules' order."""
    union, forward, backward, heads = automata or _compiled(rules)
    block = Block(texts, sep=0xFF)  # no text has this byte, so no match crosses it
    hits = scan(union, block.data)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    places = np.flatnonzero(hits)
    owner = np.searchsorted(block.end, places)
    for r, rule in enumerate(rules):
        mine = (hits[places] >> r & 1).astype(bool)
        done, last = -1, 0
        for at, doc in zip(places[mine].tolist(), owner[mine].tolist(), strict=True):
            if doc != done:
                done, last = doc, int(block.start[doc])
            if at < last:
                continue  # inside the match before
            start = _longest(backward[r], block.data, at + 1, last, -1)
            if start < 0:
                continue
            last = _longest(forward[r], block.data, start, int(block.end[doc]), 1)
            body = _longest(heads[r], block.data, start, last, 1) if heads[r] else start
            if last - body < rule.least:
                continue
            found[doc].append((start - int(block.start[doc]), last - int(block.start[doc]), r))
    return [[(s, e, rules[r].kind) for s, e, r in sorted(x, key=lambda y: (y[0], y[2]))] for x in found]


def code_points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    if not spans or text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[s]), int(before[e]), kind) for s, e, kind in spans]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans: an array of (start, end, kind, secret) for each row."""

    automata = _compiled(rules)  # once, on the driver; the arrays go to the executors

    def score(texts: list[bytes]) -> dict:
        out = []
        for text, spans in zip(texts, find_spans(texts, rules, automata), strict=True):
            points = code_points(text, spans)
            out.append([{"start": s, "end": e, "kind": k, "secret": text[a:b].decode()} for (a, b, k), (s, e, _) in zip(spans, points, strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("secret", pa.string())]))
        return {"spans": pa.array(out, kind)}

    return per_document(docs, "spans array<struct<start: long, end: long, kind: string, secret: string>>", score)


def secret_digest(docs: DataFrame) -> DataFrame:
    """The operator's spans as counts, a hash of the base kinds' spans, and text."""
    from pyspark.sql import functions as F

    found = scan_secrets(docs)
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


