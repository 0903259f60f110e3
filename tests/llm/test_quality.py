"""op13: held-out accuracy, edge cases, and the vectors against a word-by-word version."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from brute import edge_docs, edge_rows, stored
from conftest import SF_MID
from cohortlens.llm import quality
from cohortlens.llm.common import table
from cohortlens.llm.hashing import text_bytes

TOKEN = re.compile(r"[A-Za-z\x80-\U0010FFFF]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D\x80-\U0010FFFF]+")


def walked(text):
    """Words of one text, repeats marked, one by one."""
    raw = TOKEN.findall(text)
    return ["<again>" if w[0].isalpha() and w in raw[max(0, i - 2):i] else w for i, w in enumerate(raw)]


TEXTS = ["The cat, the cat sat; sat sat!! ab12", "", "é é ü 1 1 1 !! !!", " x\n", "a b a b a", "***$$ word*** " * 5]


@pytest.mark.parametrize("step", [1, 5, 1000])
def test_words_and_contexts(step):
    p = quality.Params(bits=8, dims=8)
    data, offsets = text_bytes(pa.array(TEXTS))
    sums = np.zeros((1 << p.bits, p.dims + 1), np.int64)
    got = defaultdict(list)
    for words, rows, carried in quality.word_stream(data, offsets, step):
        quality._add_contexts(sums, words, rows, carried, p)
        for w, r in zip(words[carried:].tolist(), rows[carried:].tolist()):
            got[r].append(w)
    name = {}
    for i, t in enumerate(TEXTS):
        assert len(got[i]) == len(walked(t))
        for h, w in zip(got[i], walked(t)):
            assert name.setdefault(h, w) == w
    want = np.zeros_like(sums)

    def index_vector(h, side):
        draw = int(quality.mix(np.array([h], np.uint64) + np.uint64(side + 1))[0])
        out = np.zeros(p.dims, np.int64)
        for k in range(p.index_ones):
            out[(draw >> 20 * k) % p.dims] += -1 if (draw >> 20 * k + 19) & 1 else 1
        return out

    for words in got.values():
        for i, w in enumerate(words):
            want[w >> 64 - p.bits, -1] += 1
            for d in (1, 2):
                if i + d < len(words):
                    want[w >> 64 - p.bits, :-1] += index_vector(words[i + d], 0)
                if i >= d:
                    want[w >> 64 - p.bits, :-1] += index_vector(words[i - d], 1)
    assert (sums == want).all()


def test_vectors_do_not_depend_on_the_split(spark):
    docs = edge_docs(spark)
    one = quality.word_vectors(docs.coalesce(1))
    many = quality.word_vectors(docs.repartition(40))
    assert (one.table == many.table).all() and np.allclose(one.mean, many.mean)


def test_temperature_of_known_odds():
    rng = np.random.default_rng(1)
    logits = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert abs(quality.fit_temperature(3 * logits, y) - 3) < 0.15
    assert quality.fit_temperature(np.zeros(0), np.zeros(0)) == 1.0


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF_MID, "documents"), table(spark, SF_MID, "labels")
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert len(got) == docs.count()
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    judged = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, poor = [s for s, q in judged if q], [s for s, q in judged if not q]
    assert sum((g > b) + (g == b) / 2 for g in good for b in poor) / (len(good) * len(poor)) > 0.9
    assert np.mean([s >= 0.3 for s in good]) > 0.95


def test_edges(spark):
    docs = edge_docs(spark)
    labels = stored(spark, [(5, 1), (5, 0), (8, 0), (None, 1), (9, None), (3, 0)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1
    assert {r.score for r in quality.quality(docs, labels.where("false")).collect()} == {0.5}
    assert quality.quality(docs.where("false"), labels).count() == 0
    kept = quality.drop_poor(docs, labels.where("false"))
    assert kept.columns == docs.columns and kept.count() == len(edge_rows())
