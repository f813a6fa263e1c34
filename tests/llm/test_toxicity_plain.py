"""The lexicon, the features and the score against plain loops."""

import math
import random

import numpy as np
import pytest

from varloom.llm import toxicity


def distance(a, b, stem):
    """Edits that turn a word into the term b; a stem may be followed by anything."""
    row = list(range(len(a) + 1))
    for i, y in enumerate(b, 1):
        new = [i]
        for j, x in enumerate(a, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row) if stem else row[-1]


def plain_features(text, terms, clean):
    words = text.lower().split()
    flat = " ".join(words)
    bare = [w.strip(toxicity._EDGE) for w in words]
    exact = near = quoted = 0
    for k, w in enumerate(bare):
        found = []
        for t in terms:
            body = t.rstrip("*")
            e = distance(w, body, t.endswith("*"))
            if e <= toxicity.allowance(body):
                found.append((e, len(body), body))
        if not found or not w or (min(found)[0] and w in clean):
            continue
        # marks before the word's own first letter open, its own and later ones close
        start = sum(len(x) + 1 for x in words[:k]) + words[k].find(w)
        end = sum(len(x) + 1 for x in words[: k + 1]) - 1
        before, own, after = flat[max(0, start - 96) : start].split()[-8:], flat[start:end], flat[end : end + 96].split()[:8]
        count = lambda some: sum(c in toxicity.QUOTES for x in some for c in x)
        if count(before) % 2 and count([own, *after]) or any(x.strip(toxicity._EDGE) in toxicity.REPORTING for x in before[-4:]):
            quoted += 1
        elif min(found)[0]:
            near += 1
        else:
            exact += 1
    plain = exact + 0.6 * near + 0.3 * quoted
    return [math.log1p(8 * plain), float(plain > 0.25), 100 * plain / (len(words) + 20), math.log1p(quoted) if exact + near == 0 else 0.0]


def test_score_of_a_text():
    rng = random.Random(7)
    terms = ["zat", "vexmo", "grumbledor", "plonk*", "w" * 3 + "yxkq" * 14 + "z", "snarfl*"]
    clean = {"vexma"}
    model = toxicity.Model(terms, sorted(clean), [0.7, 1.1, 0.02, -0.4, -2.0])
    score = model.scorer()
    near = ["zat", "zot", "vexmo", "vexma", "vexno", "grumbldor", "grumbeldor", "plonker", "plunker", "plonk", "snarflings", terms[4], terms[4][1:], "Zat,", "«vexmo»", '"plonky"']
    for _ in range(300):
        text = " ".join(rng.choice([rng.choice(near), "said", '"', "fine", "the", "word:", "tree"]) for _ in range(rng.randrange(0, 25)))
        x = plain_features(text, terms, clean)
        want = 1 / (1 + math.exp(-(np.dot(model.weights[:4], x) + model.weights[4])))
        assert score(text)[0] == pytest.approx(want), text


def test_a_lexicon_of_any_size_and_words_of_any_length(spark):
    rng = random.Random(3)
    letters = "bcdfghjklmnpqrstvwxz"
    bad = ["".join(rng.choice(letters) for _ in range(12)) for _ in range(720)] + ["qzj", "x" + "qk" * 30 + "v"]
    good = ["".join(rng.choice("aeiou") for _ in range(9)) for _ in range(900)]
    docs, labels = [], []
    for k in range(5400):
        toxic = k < 2700
        words = rng.sample(good, 12) + ([bad[(4 * k + j) % len(bad)] for j in range(4)] if toxic else [])
        if 2600 <= k < 2700:  # nothing else marks these
            words = [w for w in words if w in good] + [bad[-1 - k % 2]]
        rng.shuffle(words)
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id", "text", 4, 9)
    assert len(model.terms) > 512 and "qzj" in model.terms
    assert any(("x" + "qk" * 30 + "v").startswith(t.rstrip("*")) for t in model.terms)
    score = model.scorer()
    assert score(f"aeiou {bad[-2]} eee")[0] > 0.3 and score(f"aeiou {bad[-1]} eee")[0] > 0.3 and score("aeiou qzk eee")[0] < 0.3


def test_cover_takes_the_most_needed_first():
    rng = random.Random(4)
    units = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "*"]) for _ in range(150)})
    texts = [sorted(rng.sample(range(len(units)), rng.randrange(0, 12))) for _ in range(300)]
    want, wanted = [], [toxicity.COVER] * len(texts)
    left = set(range(len(units)))
    while left:
        gain = {u: sum(u in t and (wanted[k] > 0) for k, t in enumerate(texts)) for u in left}
        best = min(gain, key=lambda u: (-gain[u], units[u].endswith("*"), -len(units[u]), units[u]))
        if gain[best] < toxicity.MIN_DOCS:
            break
        want.append(units[best])
        for k, t in enumerate(texts):
            wanted[k] -= best in t
        body = units[best].rstrip("*")
        left = {u for u in left if not units[u].rstrip("*").startswith(body) and not body.startswith(units[u].rstrip("*"))}
    assert toxicity.cover(units, texts) == want and len(want) > 5
