"""op11 on edge cases, against a version that walks the units one by one."""

import hashlib
import re

import pytest

from brute import edge_docs, edge_rows, stored
from cohortlens.llm import fill_middle
from pyspark.sql import functions as F

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def walked(ident, text):
    """One unit at a time."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), "<S>" + suf + "<P>" + pre + "<M>" + mid
    return n, "psm", len(pre), len(mid), "<P>" + pre + "<S>" + suf + "<M>" + mid


def test_edge_table(spark):
    docs = edge_docs(spark)
    got = fill_middle.fill_in_middle(docs)
    rows = got.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(str, r))
    want = [(r[0], *walked(r[0], r[1]), r[1] or "") for r in edge_rows()]
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert fill_middle.fill_in_middle(docs.where("false")).count() == 0


def test_markers_and_near_markers(spark):
    texts = ["a <P> b", "<S>", "x<M", "< S> <", "<P", "a < b > c <", "P>S>M>", "é ü <ß\n\n", " lead", "trail \t"]
    rows = [(i, t) for i in range(40) for t in texts]
    docs = stored(spark, rows, "doc_id long, text string")
    got = fill_middle.fill_in_middle(docs)
    out = got.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    assert sorted((r.id, r.back) for r in out) == sorted(rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert all(r.form == "plain" for r in out if "<P>" in r.back or "<S>" in r.back)


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", "ab  cd\n ef \t", "x" * 50, " " * 50, "é\x85ü\xa0 z"])
@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_blocks_do_not_change_units(text, block):
    assert fill_middle.unit_ends(text, block).tolist() == [m.end() for m in UNIT.finditer(text)]


def test_text_beyond_one_match():
    text = "word \n" * 1_500_000
    n, form, a, b, out = fill_middle.cut_text(12, text, fill_middle.Params(fim_percent=100))
    assert n == 1_500_001 and form in ("psm", "spm") and len(out) == len(text) + 9
