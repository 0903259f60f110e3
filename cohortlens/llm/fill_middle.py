"""op11: fill-in-the-middle rewriting, with both cuts from one repeated-capture match.

One ``fullmatch`` of ``(unit)*`` covers a whole text and keeps the end of
every repetition: ``ends(1)`` gives the number of units and both cut offsets.
The inner quantifiers are possessive, as no two ways of matching a text exist,
so the match takes time in proportion to the text.  The regex library keeps
some 200 bytes per unit while it matches, and fails beyond a few million of
them; so a text of over ``BLOCK`` characters is matched block by block, cut
where a word ends, which no unit crosses.  Draws come from a digest of the
seed and the row's id alone.  ``restore`` rebuilds the exact
text from the output and its form with column functions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

#: A unit: a word with the white space before it, or the white space at the end of a text.
UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*")
#: A place that no unit crosses: behind a word that white space follows.
WORD_END = regex.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
#: Characters that one match covers, unless a single word is longer.
BLOCK = 1 << 22
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters of output that one Arrow batch holds, unless a single text is longer.
STEP = 1 << 24
_SCHEMA = "id long, n long, form string, prefix_chars long, middle_chars long, output string"
_NAMES = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]


@dataclass(frozen=True)
class Params:
    """``fim_percent`` of the texts are rewritten, ``spm_percent`` of these with the suffix first."""

    seed: int = 42
    fim_percent: int = 50
    spm_percent: int = 80


def unit_ends(text: str, block: int = BLOCK) -> np.ndarray:
    """End of every unit of the text, in code points."""
    ends, at = [np.zeros(0, np.int64)], 0
    while at < len(text):
        edge = WORD_END.search(text, at + block) if len(text) - at > block else None
        to = edge.end() if edge else len(text)
        ends.append(np.array(UNITS.fullmatch(text, at, to).ends(1), np.int64))
        at = to
    return np.concatenate(ends)


def cut_text(ident: int | None, text: str, p: Params) -> tuple[int, str, int | None, int | None, str]:
    """n, form, characters of prefix and middle, and the output of one text."""
    ends = unit_ends(text)
    n = len(ends)
    digest = hashlib.sha256(f"{p.seed}:{'' if ident is None else ident}".encode()).hexdigest()
    one, two, rewrite, order = (int(digest[at:at + 8], 16) for at in (0, 8, 16, 24))
    if not text or rewrite % 100 >= p.fim_percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (int(ends[k - 1]) if k else 0 for k in sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < p.spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _rewrite(p: Params):
    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for ident, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                rows.append((ident, *cut_text(ident, text.as_py() or "", p)))
                held += len(rows[-1][-1])
                if held >= STEP:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)
                rows, held = [], 0
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def fill_in_middle(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n (units), form, prefix_chars, middle_chars, output.

    A null text counts as empty; an empty text, one that contains a marker and
    one that the draw leaves alone are ``plain``: the output is the text and
    both character counts are null.  A null id draws as the empty string; rows
    with equal ids draw alike, and repeated rows give repeated results.  Texts
    of white space only are one unit.  Other columns are not read; an empty
    table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_rewrite(p), _SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The exact text of an output: no rewritten text contains a marker, so its output has just the three written."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))
