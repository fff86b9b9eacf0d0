"""Which passages stand in which documents, by the tiers of matching: a multi-pattern automaton for all passages at once.

Every form of every passage goes into one automaton (Aho-Corasick), so a line is read once however many passages there are; a join on
containment would be a nested loop. A block of passages is sent to all executors once its size is checked; more make more blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.functions.text import BREAKS, ESCAPES, SPACES, forms

#: Code points of forms in a block at most.
BLOCK = 20_000_000


def _python(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern)


class Finder:
    """Passages by the forms of a line."""

    def __init__(self, passages: list[tuple[int, list[tuple[str, str]]]]):
        import ahocorasick

        self.breaks, self.spaces = re.compile(_python(BREAKS)), re.compile(_python(SPACES) + "+")
        self.automata = []
        for tier in (0, 1):
            owners: dict[str, set[int]] = {}
            for ident, found in passages:
                for f in found:
                    if f[tier]:
                        owners.setdefault(f[tier], set()).add(ident)
            automaton = ahocorasick.Automaton() if owners else None
            for form, own in owners.items():
                automaton.add_word(form, frozenset(own))
            if automaton:
                automaton.make_automaton()
            self.automata.append(automaton)

    def lines(self, text: str) -> list[str]:
        parts = self.breaks.split(text)
        return parts[:-1] if parts[-1] == "" else parts

    def in_line(self, line: str) -> set[int]:
        plain = self.spaces.sub(" ", line).strip(" ")
        for old, new in ESCAPES if "\\" in plain else ():
            line = line.replace(old, new)
        found: set[int] = set()
        for automaton, form in zip(self.automata, (plain, self.spaces.sub("", line)), strict=True):
            if automaton and form:
                for _, own in automaton.iter(form):
                    found |= own
        return found


def locate_passages(docs: DataFrame, passages: DataFrame, doc_key: str = "doc_id", key: str = "item_id", block: int = BLOCK) -> DataFrame:
    """(doc_key, key, n_lines, first_line, outcome): the lines (from 0) of a document that hold a line, or all, of a passage.

    outcome is unique or ambiguous, by the number of lines. Passages that share a key are one, whatever the block. Null texts hold nothing; repeated documents are told apart by row.
    """
    rows = passages.select(key, forms(F.col("text")).alias("forms")).filter(F.size("forms") > 0)
    rows = rows.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("forms"))).alias("forms"))  # the rows of a key are one passage, in one block
    sized = rows.select(key, "forms", F.aggregate("forms", F.lit(0), lambda n, f: n + F.length(f["norm"]) + F.length(f["compact"])).alias("size"))
    out, now, held = None, [], 0

    def search(block_rows: list) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(block_rows)  # kept in a file, not in the driver's memory
        kinds = [f"{doc_key} {docs.schema[doc_key].dataType.simpleString()}", f"{key} {passages.schema[key].dataType.simpleString()}"]
        part = docs.select(doc_key, "text").mapInArrow(_search(sent, doc_key, key, docs.schema[doc_key].dataType, passages.schema[key].dataType), ", ".join([*kinds, "n_lines int", "first_line int"]))
        return part if out is None else out.unionByName(part)

    for r in sized.toLocalIterator():  # one block is held at a time
        if now and held + r["size"] > block:
            out, now, held = search(now), [], 0
        now.append((r[key], [(f["norm"], f["compact"]) for f in r["forms"]]))
        held += r["size"]
    out = search(now)
    return out.withColumn("outcome", F.when(F.col("n_lines") == 1, "unique").otherwise("ambiguous"))


def _search(sent, doc_key: str, key: str, doc_type, key_type):
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(doc_type), to_arrow_type(key_type), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(sent.value)
        for batch in batches:
            rows = []
            for ident, text in zip(batch.column(0), batch.column(1), strict=True):
                found: dict[int, list[int]] = {}
                for at, line in enumerate(finder.lines(text.as_py() or "")):
                    for own in finder.in_line(line):
                        found.setdefault(own, []).append(at)
                rows += [(ident.as_py(), own, len(ats), ats[0]) for own, ats in found.items()]
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=[doc_key, key, "n_lines", "first_line"])

    return run
