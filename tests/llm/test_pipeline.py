"""The whole pipeline on given tables, its stages against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from codeloom.llm.common import table

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def alike(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before the first stage and behind each, as ``run`` writes them."""
    out, write = [table(spark, SF, "documents")], P.stored
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(P, "stored", lambda df, name: out.append(write(df, name)) or out[-1])
        assert P.run(spark, SF) is out[-1] and len(out) == len(P.STAGES) + 1
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_stay(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns and not Counter(rows(df)) - Counter(rows(steps[0]) * 4)


def test_toxic_texts_go(steps, spark):
    kept = {d for d, _ in rows(steps[1])}
    toxic = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect() if r.toxic is not None}
    given = [d for d, _ in rows(steps[0])]
    bad, good = [d for d in given if toxic.get(d) == 1], [d for d in given if toxic.get(d) == 0]
    assert sum(d in kept for d in good) >= 0.95 * len(good)
    assert sum(d not in kept for d in bad) >= 0.5 * len(bad)


def test_one_of_each_group_stays(steps):
    before, kept = rows(steps[1]), rows(steps[2])
    left = list((Counter(before) - Counter(kept)).elements())
    sets = [shingles(t) for _, t in kept]
    assert not [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j]) >= 0.8]
    every = [shingles(t) for _, t in before]
    for _, t in left:  # what went has a near copy, kept or gone
        own = shingles(t)
        assert sum(alike(own, s) >= 0.8 for s in every) >= 2


def test_benchmark_passages_go(steps, spark):
    items = [" ".join(words(r.text)).lower() for r in table(spark, SF, "benchmark").collect()]
    kept = rows(steps[3])
    assert not [d for d, t in kept for i in items if len(i.split()) >= 13 and i in " ".join(words(t)).lower()]
    grams = {g for i in items for g in zip(*(i.split()[k:] for k in range(5)))}
    for _, t in (Counter(rows(steps[2])) - Counter(kept)).elements():  # what went shares words in a row with an item
        assert grams & shingles(t) or len(words(t)) < 13


def test_mix_takes_whole_copies(steps):
    before, after = Counter(rows(steps[3])), Counter(rows(steps[4]))
    assert all(n <= 2 * before[k] for k, n in after.items())
    size = lambda c: sum(n * len(words(t)) for (_, t), n in c.items())
    assert 0.8 * size(before) <= size(after) <= 1.7 * size(before)


def test_files_hold_every_copy(steps):
    path = public_tokenizers.path(P.TOKENIZER)
    tokenizer = Tokenizer.from_file(str(path))
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    want = Counter((d, crc(t)) for d, t in rows(steps[4]))
    got = steps[5].collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))

