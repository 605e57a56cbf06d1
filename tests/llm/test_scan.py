import random
import hashlib
import re

import numpy as np
import pytest

from chronolith.llm import decontaminate, licenses
from chronolith.llm.text_arrays import chunks

from .helpers import corpus, documents


def _brute(docs, items):
    low = lambda t: (t or "").translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, held = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if found := windows.get(tuple(w[p : p + n])):
                    held |= found
                    hit |= set(range(p, p + n))
        out.append((i, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_contamination_is_brute_force(spark, limit):
    texts = corpus(seed=7)
    items = [(10, texts[0]), (9, " ".join((texts[2] or "").split()[:20]).upper()), (3, "WORT1 wort2"), (4, None), (5, "..."), (6, "the the the"), (7, "ab" * 400), (8, "Ai. Ai. Ai.")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = decontaminate.contamination(documents(spark, texts), table, broadcast_bytes=limit).orderBy("doc_id").collect()
    assert [tuple(r)[:6] for r in got] == _brute(list(enumerate(texts)), items)
    bad = {r.doc_id for r in got if r.contaminated}
    kept = decontaminate.remove_contaminated(documents(spark, texts), table)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - bad and kept.columns == documents(spark, ["x"]).columns
    spans = {r.doc_id: r for r in decontaminate.remove_spans(documents(spark, texts), table).collect()}
    assert all(len(spans[r.doc_id].text.split()) == r.n_words - r.n_hit for r in got if r.n_hit)
    assert decontaminate.contamination(documents(spark, texts).limit(0), table).count() == 0
    assert decontaminate.contamination(documents(spark, texts), table.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_runs_no_python(spark):
    docs, items = documents(spark, ["a b c"]), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = decontaminate.contamination(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_license_windows_are_brute_force(spark):
    notice = licenses.NOTICES["GPL-3.0"]
    texts = corpus(seed=9)
    texts[3] = f"{texts[3]} {notice} {texts[4]}"
    texts[5] = f"{notice.upper()}\n\n{licenses.NOTICES['MIT']}"
    texts[8] = "Licensed under the Apache License, Version 3.0. " + " ".join(notice.split()[:9])
    library = licenses.Library(licenses.NOTICES)
    import pyarrow as pa

    want, got = [], []
    for row, _, raw, off in chunks(pa.array(texts)):
        h, out = licenses.shingles(raw, off)
        want += sorted((d + row, *x) for d, *x in library.scan(h, out, banded=False))
        got += sorted((d + row, *x) for d, *x in library.scan(h, out))
    assert got == want and want
    rows = licenses.scan_licenses(documents(spark, texts)).collect()
    assert {(r.doc_id, r.license) for r in rows} == {(d, library.names[t]) for d, t, *_ in want}
    assert {(3, "GPL-3.0"), (5, "MIT"), (5, "GPL-3.0")} <= {(r.doc_id, r.license) for r in rows}
    assert licenses.scan_licenses(documents(spark, texts).limit(0)).count() == 0
    assert licenses.scan_licenses(documents(spark, texts), {"none": ""}).count() == 0


def test_license_bands_collide(spark):
    """At the least Jaccard similarity that a match can have, the bands miss next to none."""
    r = np.random.default_rng(2)
    missed = 0
    for _ in range(300):
        own = r.integers(0, 2**63, 7).astype(np.uint64)
        window = np.concatenate((own[:6], r.integers(0, 2**63, 10).astype(np.uint64)))
        missed += not any(licenses._values(own, b).min() == licenses._values(window, b).min() for b in range(licenses.BANDS))
    assert missed <= 1


def _contained(text, template):
    """The greatest share of a template's shingles in any run of words as long as two blocks, by sets of words."""
    words = lambda t: [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t)]
    runs = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    held, want = runs(words(text)), set(runs(words(template)))
    block = 1
    while block < len(want):
        block *= 2
    return max((len(set(held[i : i + 2 * block]) & want) / len(want) for i in range(0, max(1, len(held)), block)), default=0.0)


def test_licenses_are_those_of_plain_sets(spark):
    """Whole bodies among other words, cut, changed, repeated and mixed, against sets of shingles."""
    r = random.Random(9)
    say = lambda n: " ".join(f"word{r.randrange(500)}" for _ in range(n))
    texts = [say(300), None, "", "short"]
    for name in ("MIT-text", "BSD-2-Clause-text", "ISC-text", "Apache-2.0-notice", "GPL-3.0-notice", "MIT"):
        body = licenses.NOTICES[name]
        words = body.split()
        texts += [f"{say(r.randrange(400))} {body} {say(90)}", body.upper(), f"{say(40)} {' '.join(words[: len(words) * 9 // 10])}", " ".join(words[: len(words) // 2]), " ".join(w for i, w in enumerate(words) if i % 40), f"{body} {say(700)} {body}"]
    got = {(x.doc_id, x.license): x.containment for x in licenses.scan_licenses(documents(spark, [*texts, texts[4]], [*range(len(texts)), 4])).collect()}
    want = {(i, name): share for i, t in enumerate(texts) for name, body in licenses.NOTICES.items() if (share := _contained(t or "", body)) >= licenses.CONTAINMENT}
    assert len(want) > 30 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
